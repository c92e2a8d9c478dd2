"""Plain finds of the secret scanner against a scanner that goes through texts character by character."""

import hashlib
import random

from radiolith.llm import secret_scan

KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
UPPER = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def assignment(text, low, at):
    """The end and the value's length of an assignment that begins at ``at``."""
    for key in KEYS:
        if not low.startswith(key, at):
            continue
        to = at + len(key)
        for quote in (True, False):  # an optional character is taken first, and given back if nothing follows
            p = to
            if quote:
                if text[p : p + 1] not in ("'", '"') or p >= len(text):
                    continue
                p += 1
            while text[p : p + 1] == " ":
                p += 1
            if text[p : p + 1] not in (":", "=") or p >= len(text):
                continue
            p += 1
            while text[p : p + 1] == " ":
                p += 1
            if p < len(text) and text[p] in "'\"":
                p += 1
            end = p
            while end < len(text) and text[end] in VALUE:
                end += 1
            if end > p:
                return end, end - p
            # spaces and signs can be read in one way only: nothing to give back
    return None


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def finds(text):
    low, out, at = lowered(text), [], 0
    while at < len(text):
        m = assignment(text, low, at)
        if m:
            if m[1] >= 12:
                out.append((at, 0, m[0]))
            at = m[0]
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run_of(text, at + 4, UPPER) if text.startswith("AKIA", at) else at
        if end > at + 4:
            if end - at >= 18:
                out.append((at, 1, end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run_of(text, at, "0123456789abcdef")
        if end - at >= 16:
            out.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(out)


PIECES = ["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "apı_key", "ſecret", "'", '"', ":", "=", " ", "  ", "\t", "AKIA", "AKIAAKIA", "A1B2", "0123456789abcdef", "deadbeef", "0F", "x", "Zz9+/_.-", "longvalue1234", "é", "\n", "abc"]


def texts(n):
    rng = random.Random(8)
    return [None, "", "token=", "token:" + "a" * 11, "token:" + "a" * 12, "AKIA" + "A" * 13, "AKIA" + "A" * 14, "0" * 15, "0" * 16, "x" * 3000 + " password = 'hunter2hunter2'"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 25))) for _ in range(n)]


def test_plain_finds_by_hand(spark):
    rows = list(enumerate(texts(3000))) + [(None, "token=abcdefghijkl"), (5, "token=abcdefghijkl"), (5, "token=abcdefghijkl")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string").repartition(3)
    got = sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.find_secrets(docs).collect()], key=repr)
    want = []
    for i, text in rows:
        own = finds(text or "")
        kinds = [k for _, k, _ in own]
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in own)
        want.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(named.encode()).hexdigest()))
    assert got == sorted(want, key=repr) and sum(w[1] for w in want) > 100
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0
