"""Each operator against brute force or a round trip on small tables, with nulls, ties, repeats and odd texts."""

import base64
import gzip
import hashlib
import random
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from radiolith.llm import decontaminate, language_id, mixing, preferences, queries, secret_scan, simhash_dedup, suffix_dedup, token_records, vector_tree, warc_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key string, h long, size int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ou", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts():
    long = prose(1, 30_000)
    base = prose(2, 300)
    return [None, "", " \t\n", "a", "One two", "one TWO", "123 456", "a　b", base, base, base.replace("th", "TH", 1), base + " tail", base[:1200], long, "x" * 5000, prose(3, 40) + " " + base, "\x00\x1f naïve \U0001f600 ﬁ", prose(4, 200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "a￿", "a\U00010000")[i % 5], None, "clash", "clash", 7, 1) for i, t in enumerate(odd_texts())]
    rows += [(None, prose(5, 60), "en", "b", None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1


def test_warc(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 3_000_000, "<p>é</p>", ""]
    urls = ["http://www.Example.com:80/a?b=1", None, "not a url", "https://sub.example.com/z", "http://[bad", "http://example.com/\nline", ""]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(None, "http://n/", "lone", "c"), (3, urls[3], html[3], "c")], "page_id long, url string, html string, sha string")
    got = warc_index.archive_pages(pages).collect()
    assert len(got) == 9
    for r in got:
        raw = b"lone" if r.page_id is None else (html[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = None if r.page_id is None else next(i for i, h in enumerate(html) if (h or "") == raw.decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    assert warc_index.archive_pages(pages.limit(0)).count() == 0


def test_many_revisits_of_one_payload(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}", "hot" if i % 3 else f"own {i}") for i in range(3000)], "page_id long, url string, html string").repartition(9)
    got = {r.page_id: r for r in warc_index.archive_pages(pages).collect()}
    assert len(got) == 3000
    assert all((r.record_type, r.refers_to) == (("revisit", 1) if i % 3 and i != 1 else ("response", None)) for i, r in got.items())


def test_capture_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK", 7)
    from radiolith.llm.common import scratch

    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example.com/p{i % 20}", f"page {i}") for i in range(100)], "page_id long, url string, html string")
    root = scratch(spark, "t")
    directory = warc_index.save_directory(warc_index.build_index(warc_index.write_archives(pages, root), root), root)
    urls = spark.createDataFrame([("http://h3.example.com/p3",), ("http://none/",)], "url string")
    got = warc_index.lookup(spark, urls, directory, root).collect()
    assert sorted(r.page_id for r in got) == [3, 23, 43, 63, 83]
    reader = warc_index.IndexReader(directory, root)
    assert {reader.read(r.path, r.offset, r.length)[1] for r in got} == {f"page {i}".encode() for i in (3, 23, 43, 63, 83)}
    odd = ["http://example.com/\nline", "http://example.com/a\r", None, "http://[bad"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)], "page_id long, url string, html string")
    directory = warc_index.save_directory(warc_index.build_index(warc_index.write_archives(pages, root), root), root)
    assert sorted((r.page_id, r.url or "") for r in warc_index.lookup(spark, pages, directory, root).collect()) == [(i, u or "") for i, u in enumerate(odd)]
    assert warc_index.capture_key("http://www.Example.com:8080/a?b") == "com,example:8080)/a?b"


# 2


def nearest_by_hand(rows, every, k):
    fine = [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for i, v in fine:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in fine if j != i)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[0][1]) for i in range(300)]  # a class of copies, which asks and answers
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (2400, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int")
    got = {}
    for r in vector_tree.nearest(table, every=50, k=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = nearest_by_hand(rows, 50, 10)
    assert set(got) == set(want)
    hits = sum(len({x[1] for x in got[q].values()} & {x[1] for x in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, ranked in got.items():
        assert [ranked[i] for i in range(1, 11)] == sorted(ranked.values())
    assert [x[1] for x in sorted(got[1500].values())] == [0, *range(1501, 1510)]
    assert vector_tree.nearest(table.limit(0)).count() == 0
    assert vector_tree.nearest(table.where("vec_id in (0, 1)"), every=1).count() == 2


def test_recall_on_embeddings(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.collect()]
    got = {}
    for r in vector_tree.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i, v in rows:
        if i % 100 == 0:
            best = sorted((float(((v - w) ** 2).sum()), j) for j, w in rows if j != i)[:10]
            hit += len(got[i] & {j for _, j in best})
            total += len(best)
    assert hit / total >= 0.9


def test_tree_that_prunes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 12)) * 8
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 12))
    tree = vector_tree.fit(x[:3072])
    visits = vector_tree.calibrate(tree, x[:4096], 1024, 10, 0.97)
    assert visits * 4 < tree.leaves
    sizes = np.bincount(tree.assign(x), minlength=tree.leaves)
    met = np.mean([sizes[tree.visits(x[i], visits)].sum() for i in range(0, 6000, 100)])
    assert met < 0.25 * len(x)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vector_tree.nearest(table, sample=4096).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(np.linalg.norm(x[r.query_id] - x[r.vec_id])), abs=1e-12)
    found = []
    for i in range(0, len(x), 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        found.append(len(got[i] & set(np.argsort(d)[1:11].tolist())) / 10)
    assert np.mean(found) >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 31)] + [(100, [3.25, 1.0]), (100, [20.25, 1.0]), (None, [3.0, 1.0]), (200, [1e200, 0.0]), (201, [1e200, 3e199]), (300, [1e-200, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_tree.nearest(table, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {100, 200, 300}
    assert sorted(by[100])[0][1:] == (3, 0.25) and all(v not in (None, 100) for _, v, _ in by[100])
    assert sorted(by[200])[0][1] == 201 and sorted(by[200])[0][2] == pytest.approx(3e199)
    assert [v for _, v, _ in sorted(by[300])] == [1, 2, 3]


# 3


def test_language(spark, docs, nothing):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.9
    odd = language_id.identify(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    texts = dict(texts_of(docs))
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters(spark):
    assert [language_id.has_letter(t) for t in ("² ½ ³", "Ⅷ", "٣", "_", "a", "あ", "é", "ǅ", "ʰ", "")] == [False, False, False, False, True, True, True, True, True, False]
    rows = spark.createDataFrame([(1, "² ½ ³", "en"), (3, "the cat and the hat", "en"), (4, "le chat noir", "fr"), (5, None, "fr"), (None, "le chien", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(rows).collect()}[1] == "und"
    model = language_id.fit(["the cat", "le chat"], ["en", "fr"], landmarks=2)
    extra = rows.withColumn("lang_pred", F.lit(7))
    got = language_id.relabel(extra, model)
    assert got.columns == extra.columns
    assert sorted((r.doc_id or 0, r.lang, r.lang_pred) for r in got.collect()) == [(0, "fr", 7), (1, "und", 7), (3, "en", 7), (4, "fr", 7), (5, "und", 7)]


def test_kernel_by_hand():
    texts = ["the cat", "le chat noir", "the hat", "xyz"]
    m = language_id.fit(texts, ["en", "fr", "en", "fr"], landmarks=4)
    grams = lambda t: {t.encode()[i : i + n] for n in range(1, 5) for i in range(len(t.encode()) - n + 1)}
    k = m.kernel(texts)
    order = ["the cat", "le chat noir", "the hat", "xyz"]
    for i, a in enumerate(texts):
        for j, b in enumerate(order):
            want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
            assert any(abs(k[i, c] - want) < 1e-6 for c in range(4))


# 4


def fingerprint_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(pairs):
    ids, root = [f for _, f in pairs], list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i] ^ ids[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(pairs))


def test_simhash(docs, nothing):
    want = components_by_hand([(d, fingerprint_by_hand(t)) for d, t in texts_of(docs)])
    assert Counter(tuple(r) for r in simhash_dedup.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash_dedup.simhash_components(nothing).count() == 0


@pytest.mark.parametrize("bucket", [256, 3])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    rows = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = simhash_dedup.links(spark.createDataFrame([(f, 0) for f in rows], "fp long, least long")).collect()
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 2 for e in edges)
    from radiolith.llm.graph import connected_components

    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = components_by_hand([(f, f & (1 << 64) - 1) for f in rows])
    assert Counter((f, f"{f & (1 << 64) - 1:016x}", got.get(f, f)) for f in rows) == want


# 5


def test_preferences(spark, duck):
    df = queries.op5_preferences(spark, DATA)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(duck.execute(f"select {', '.join(cols)} from ({preferences.ORACLE_SQL})").fetchall())
    turns = [(0, 0, "user", "q", "x"), (0, 1, "assistant", "a", "x"), (0, 2, "user", None, "x"), (1, 0, None, "q", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (2, None, "assistant", "", "x"), (3, 0, "user", "only", "x"), (None, 0, "assistant", "lost", "x")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in preferences.format_pairs(preferences.exchanged_replies(t)).collect()}
    assert set(got) == {0, 1}
    assert (got[0].n_common, got[0].prompt, got[0].chosen, got[0].chosen_mask, got[0].rejected) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\na<|end|>\n", "14:23", "<|assistant|>\n<|end|>\n")
    many = [(i, k, ("user", "assistant")[k % 2], f"{i} {k}" if k % 4 else "ok") for i in range(16) for k in range(8)]
    got = {r.conv_id: r.n_common for r in preferences.format_pairs(preferences.exchanged_replies(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {i: 2 * (i // 2 % 4) + 1 for i in range(16)}
    assert preferences.format_pairs(preferences.exchanged_replies(t.limit(0))).count() == 0


# 6


def mix_by_hand(rows):
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    goal, target, left = 1.5 * sum(size.values()), {}, set(sources)
    while left:
        rest = goal - sum(target.values())
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 2 * size[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in left}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left.discard(s)
    return size, target


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix(docs, nothing, block):
    got = mixing.mixed_sizes(docs, block).collect()
    again = mixing.mixed_sizes(docs.repartition(5), block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.select("doc_id", "source", "text").collect()]
    size, target = mix_by_hand(rows)
    by_id = {d: (s, n) for d, s, n in rows}
    taken = Counter()
    for r in got:
        s, n = by_id[r.doc_id]
        assert (r.size, r.source_size) == (n, size[s]) and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mixed_sizes(nothing).count() == 0


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 0, 1, 5000.0), ("b", 1, 1, 2000.0), ("c", 2, 1, 1000.0)], "source string, rank int, source_size long, target double")
    slots = mixing.schedule(t, 10).where("slot is not null").collect()
    for r, share in ((0, 0.625), (1, 0.25), (2, 0.125)):
        at = sorted(s.slot for s in slots if s.rank == r)
        assert all(abs(i + 1 - share * (x + 1)) < 8 for i, x in enumerate(at))
    assert len({(s.rank, s.slot_no) for s in slots}) == len(slots)


# 7


def edits_by_hand(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontaminate(spark, docs, nothing):
    items = [(0, prose(2, 300)[100:260]), (1, prose(4, 200)[30:90]), (2, None), (3, "  "), (4, prose(9, 30)), (4, prose(9, 30)), (5, "a")]
    rng = random.Random(3)
    edited = list(items[4][1])
    for _ in range(3):
        edited[rng.randrange(len(edited))] = "z"
    rows = [(100, "before " + "".join(edited).upper().replace(" ", " \n ") + " after"), (101, "nothing"), (102, None), (103, items[4][1] + " x " * 20 + items[4][1])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, distance int")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(both, bench).collect())
    want = {}
    for d, t in set(texts_of(both)):
        for i, p in set(items):
            p = decontaminate.normalize(p or "")
            if p and t and len(t) < 20_000:
                n = edits_by_hand(p, decontaminate.normalize(t))
                if n <= int(0.05 * len(p)):
                    want[d, i, n] = 1
    assert {k for k in got if k[0] != 13} == set(want)
    spans = decontaminate.find_passages(both.where("doc_id = 103"), bench).where("item_id = 4").distinct().collect()
    assert sorted((r.start, r.end) for r in spans) == [(0, len(items[4][1])), (len(items[4][1]) + 60, 2 * len(items[4][1]) + 60)]
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# 8


def test_secrets(docs, nothing, spark):
    secret = "password = hunter2hunter2xx"
    uni = "".join(f"\\u{ord(c):04x}" for c in secret)
    b64 = base64.b64encode(secret.encode()).decode()
    for enc in (urllib.parse.quote(secret, safe=""), uni, b64, base64.b64encode(gzip.compress(secret.encode())).decode(), base64.b64encode(b64.encode()).decode(), urllib.parse.quote(b64, safe=""), base64.b64encode(uni.encode()).decode(), "".join(f"&#{ord(c)};" for c in secret)):
        text = "Thé start " + enc + " end"
        plain, every = secret_scan.scan(text)
        assert [k for _, k, _ in every] == [0] and not plain
        a, _, b = every[0]
        assert text.index(enc) <= a < b <= text.index(enc) + len(enc)
    text = "api-key token : \"Abcdefghijklm\" AKIA" + "A" * 14 + " é deadbeefdeadbeef0 tOKEN=short secret=" + "f" * 20
    want = [(8, 0, 30), (32, 1, 50), (53, 2, 70), (83, 0, 110), (90, 2, 110)]
    assert secret_scan.base_finds(text) == want
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(500, text)], "doc_id long, text string"))
    got = {r.doc_id: r for r in secret_scan.find_secrets(rows).collect()}
    listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert (got[500].n_assign, got[500].n_access, got[500].n_hex, got[500].base_sha256, got[500].spans) == (2, 1, 2, hashlib.sha256(listed.encode()).hexdigest(), listed)
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and secret_scan.find_secrets(nothing).count() == 0
    loop = "%25" * 30 + "41"
    secret_scan.scan(loop + " " + loop)


# 9


SECRET = "password=Zx81kQmPq77wLtRr9"


def finds_of(text):
    return {(k, a, b) for a, k, b in secret_scan.scan(text)[1]} - {(k, a, b) for a, k, b in secret_scan.scan(text)[0]}


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_secrets_in_wrapped_base64(width, pack):
    value = base64.b64encode(pack((prose(90, 60) + " " + SECRET + " " + prose(91, 60)).encode())).decode()
    lines = "\n".join(value[i : i + width] for i in range(0, len(value), width))
    text = "see this\n" + lines + "\nthe end"
    assert any(k == 0 for k, _, _ in finds_of(text))
    assert any(k == 0 for k, _, _ in finds_of("it is: " + lines))
    one = base64.b64encode((prose(90, 7) + " " + SECRET).encode()).decode()
    assert {k for k, _, _ in finds_of("\n".join(one[i : i + 64] for i in range(0, len(one), 64)))} == {0}


@pytest.mark.parametrize("before", ["https://x/cb/", "blob_", "a-", "ab-", "x", ""])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_secrets_in_base64_within_longer_runs(before, pack):
    value = base64.urlsafe_b64encode(pack((SECRET + " and so on").encode())).decode().rstrip("=")
    for after in ("", "/x", "Q"):
        assert any(k == 0 for k, _, _ in finds_of(f"at {before}{value}{after} end")), (before, after)


def test_secrets_behind_far_escapes():
    value = base64.b64encode(gzip.compress((prose(92, 80) + SECRET).encode())).decode() + base64.b64encode(bytes(range(200, 256)) * 9).decode()
    value = value.replace("+", "\\u002B", 1)
    cut = value.index("\\u002B") if "\\u002B" in value else 0
    text = 'x \\u0041 {"v": "' + value + '"}'
    assert cut and any(k == 0 for k, _, _ in finds_of(text))
    far = "token=" + "aB3" * 40 + "\\u002B" + "cD4" * 40 + "\\u002B" + "z9"
    assert (0, 0, len(far)) in finds_of(far)


def test_secrets_over_the_edge_of_a_piece():
    rng = random.Random(93)
    inner = base64.b64encode((prose(94, 3000) + " " + SECRET + " " + prose(95, 1500)).encode()).decode()
    assert len(inner) > 20_000
    for near in (-21_000, -10_000, -100, 5):
        fill = "".join(rng.choice("abcdefgh ijkl, ") for _ in range(4096))
        before = (fill * (2 * secret_scan.LAYER // 4096 + 1))[: secret_scan.LAYER + near] + "\n"
        packed = base64.b64encode(gzip.compress((before + inner + "\n" + fill).encode())).decode()
        assert any(k == 0 for k, _, _ in finds_of("x " + packed + " y")), near
        split = base64.b64encode(gzip.compress((before[:-1] + " token = abcDEF123456789 " + fill).encode())).decode()
        assert any(k == 0 for k, _, _ in finds_of(split)), near


def test_secrets_of_more_kinds_of_layers():
    packed = gzip.compress(prose(96, 90).encode()) + gzip.compress((prose(97, 20) + " " + SECRET).encode())
    import zstandard

    frames = zstandard.ZstdCompressor().compress(prose(96, 90).encode()) + zstandard.ZstdCompressor().compress(SECRET.encode())
    forms = {
        "second member": base64.b64encode(packed).decode(),
        "second frame": base64.b64encode(frames).decode(),
        "compressed under URL escapes": urllib.parse.quote(gzip.compress(SECRET.encode())),
        "the same, blanks as plus": urllib.parse.quote_plus(gzip.compress((prose(98, 60) + SECRET).encode())),
        "compressed under escapes": "".join(f"\\x{c:02x}" for c in zlib.compress(SECRET.encode())),
        "Latin-1": base64.b64encode(("é" * 40 + " " + SECRET + " ü" * 30).encode("latin-1")).decode(),
        "16-bit": base64.b64encode(SECRET.encode("utf-16-le")).decode(),
    }
    for name, text in forms.items():
        assert any(k == 0 for k, _, _ in finds_of(f"see {text} end")), name


def repeats_by_hand(texts, w):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1000, 1])
def test_repeats(spark, docs, nothing, shard_bytes):
    rng = random.Random(8)
    shared = prose(7, 60)
    more = [(200 + i, prose(20 + i, 30) + shared[rng.randrange(150) : rng.randrange(160, len(shared))] + prose(60 + i, 20)) for i in range(12)]
    more += [(300, "ab" * 400), (301, "c" * 101), (301, shared), (None, shared)]
    # one passage in many surroundings, some of which repeat on one side only
    sides = [prose(400 + i, 25) for i in range(5)]
    more += [(500 + i, rng.choice(sides)[rng.randrange(40) :] + shared[30 : 30 + rng.choice((60, 75, 99, 100, 130))] + rng.choice(sides)[: rng.randrange(20, 90)] + prose(600 + i, 3)) for i in range(60)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    every = texts_of(rows)
    want = Counter((d, *x) for (d, _), x in zip(every, repeats_by_hand([t for _, t in every], 100), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(rows, 100, shard_bytes=shard_bytes).collect()) == want
    assert suffix_dedup.remove_repeats(nothing, 100).count() == 0


def test_prefixes_at_borders():
    rng = random.Random(9)
    for _ in range(200):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30)))
        least, most = rng.randint(0, 3), rng.randint(3, 8)
        for at_end in (False, True):
            edge = own[-1 if at_end else 0]
            shared = [next((i for i, (x, y) in enumerate(zip(s, edge, strict=False)) if x != y), min(len(s), len(edge))) for s in own]
            assert suffix_dedup.border_prefixes(own, at_end, least, most).tolist() == [max(least - 1, min(k, most)) for k in shared]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(20):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 200)))
        sa, _ = suffix_dedup.suffix_array(np.frombuffer(t, dtype=np.uint8))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


# 10


def test_records(spark, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    special = [(900, "a<|endoftext|>b"), (901, "ΣΑΣ don't. It's, x́ y \x1c z")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(special, "doc_id long, text string"))
    got = token_records.token_records(rows, queries.vocabulary()).collect()
    want = Counter()
    for d, t in texts_of(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert token_records.token_records(nothing, queries.vocabulary()).count() == 0


def test_records_of_another_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), ["A  b\n\tc", "don't<|endoftext|> x", "", "É é"]
    assert not token_records.Encoder(path).by_words and token_records.Encoder(queries.vocabulary()).by_words
    enc = token_records.Encoder(path)
    assert [np.frombuffer(x, dtype=enc.kind).tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_order_of_equal_ids(spark):
    rows = spark.createDataFrame([(7, f"text {i % 50}") for i in range(500)], "doc_id long, text string").repartition(5)
    runs = [[(r.start, r.ids_crc32) for r in sorted(token_records.token_records(rows, queries.vocabulary()).collect(), key=lambda r: r.start)] for _ in range(2)]
    assert runs[0] == runs[1] and len({c for _, c in runs[0]}) == 50
    assert sum(a[1] != b[1] for a, b in zip(runs[0], runs[0][1:], strict=False)) == 49


def test_index_and_broken_records(spark, docs):
    import io
    import struct

    from radiolith.llm.common import scratch

    out = scratch(spark, "r")
    files = token_records.write_records(docs, queries.vocabulary(), 1, out).where("records > 1").first()
    payload = token_records.read_one(out, files["path"], files["index"], 1)
    assert struct.unpack_from(token_records.HEADER, payload)[3] >= 1
    raw = token_records.frame(b"abc") + token_records.frame(b"")
    assert list(token_records.records(io.BytesIO(raw).read)) == [b"abc", b""]
    for i in range(len(raw)):
        with pytest.raises(ValueError):
            list(token_records.records(io.BytesIO(raw[:i] + bytes([raw[i] ^ 1]) + raw[i + 1 :]).read))


def test_stages_with_odd_rows(spark):
    """Null and repeated ids, null texts and sources, clashing texts: every stage treats rows, not ids."""
    import corpus_pipeline as pipeline

    item = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if len(r.text) > 60)
    clean = [prose(700 + i, 40) for i in range(9)]
    rows = [(None, clean[0], "en", "a"), (None, clean[1], "en", "b"), (None, f"{clean[2]} {item} end", "en", "a"), (1, clean[3], None, "a"), (1, f"{item} {clean[4]}", "en", "a"), (1, clean[5], "en", None)]
    rows += [(2, None, "en", "b"), (3, "12 34 ² ½", "en", "b"), (4, "", "en", None), (5, clean[6], "en", "b"), (5, clean[6], "en", "b"), (None, clean[7], "en", None), (None, clean[7], "en", None), (-7, clean[8], "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    of = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    named = pipeline.identify_language(spark, docs, DATA)
    assert named.columns == docs.columns
    assert of(named) == Counter((d, t, s) for d, t, _, s in rows if t and any(c.isalpha() for c in t))
    once = pipeline.drop_near_copies(spark, named, DATA)
    assert of(once) == Counter(dict.fromkeys(of(named), 1))
    left = pipeline.drop_benchmark(spark, once, DATA)
    assert of(left) == Counter({k: n for k, n in of(once).items() if item not in k[1]}) and len(of(left)) == len(of(once)) - 2
    for given in (left, docs.where("text is not null")):  # the mix also on repeated rows
        given = spark.createDataFrame(given.collect(), docs.schema)
        mixed = pipeline.mix_sources(spark, given, DATA).collect()
        words = Counter()
        for r in mixed:
            words[r.doc_id, r.source] += len((r.text or "").split())
        want = Counter()
        sized = mixing.mix(given).groupBy("doc_id", "source").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).collect()
        for r in sized:
            want[r.doc_id, r.source] += r.n
        assert +words == +want and sum(want.values()) > 0
        assert {r.text for r in mixed} <= {" ".join(t.split()[:k]) for t in {r.text for r in given.collect()} for k in range(1, len(t.split()) + 1)} | {r.text for r in given.collect()}
    tokens = pipeline.write_tokens(spark, left, DATA).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in left.collect())


# all


def test_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
        assert norm(map(tuple, df.select(*cols).collect())) == norm(duck.execute(f"select {', '.join(cols)} from ({sql})").fetchall()), name


def first_of_copies(texts):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept, ids = {}, sorted(sets)
    for n, d in enumerate(ids):
        root = d
        for o in ids[:n]:
            if texts[o] == texts[d] or len(sets[o] & sets[d]) >= 0.8 * len(sets[o] | sets[d]):
                a, b = kept[o], root
                root = min(a, b)
                kept = {k: root if v in (a, b) else v for k, v in kept.items()}
        kept[d] = root
    return {d for d, r in kept.items() if d == r}


def test_near_copies_with_odd_rows(spark, docs, nothing):
    import corpus_pipeline as P

    rows = docs.select(*P.COLUMNS)
    kept = P.drop_near_copies(spark, rows, DATA).collect()
    texts = {}
    for d, t in texts_of(docs):
        texts.setdefault(d, t or "")
    lone = {d for d in texts if d is None}
    assert {r.doc_id for r in kept} == first_of_copies({d: t for d, t in texts.items() if d is not None and t.split()}) | {min(d for d, t in texts.items() if d is not None and not t.strip())} | {2} | lone
    assert P.drop_near_copies(spark, nothing.select(*P.COLUMNS), DATA).count() == 0


def classes(texts, found):
    hashes = {r.th: r.text for r in texts.select("text", F.xxhash64("text").alias("th")).collect()}
    out = {}
    for r in found.collect():
        out.setdefault(r.root, set()).add(hashes[r.th])
    return sorted(map(sorted, out.values()))


def test_near_copies_that_share_all_words(spark):
    rnd, groups = random.Random(5), []
    for _ in range(8):  # the same words in other orders: every bit of a SimHash over words is the same
        words = [f"w{i}" for i in range(80)]
        rnd.shuffle(words)
        groups.append(sorted(" ".join(words + words[:k]) for k in range(0, 12, 2)))
    texts = spark.createDataFrame([(t,) for g in groups for t in g], "text string")
    assert classes(texts, simhash_dedup.similar_components(texts)) == sorted(groups)


def test_near_copies_just_alike_enough(spark):
    rnd, groups = random.Random(6), []
    for _ in range(60):
        words = [f"v{rnd.randrange(5000)}" for _ in range(248)]
        groups.append(sorted([" ".join(words[:200]), " ".join(words)]))  # 196 of 244 shingles
    far = [f"v{rnd.randrange(5000)}" for _ in range(250)]
    texts = spark.createDataFrame([(t,) for g in groups for t in g] + [(" ".join(far),), (" ".join(far[:200]),)], "text string")
    assert classes(texts, simhash_dedup.similar_components(texts)) == sorted(groups)


def test_benchmark_and_mix_with_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").first().text
    bad = prose(70, 20) + " " + item + " " + prose(71, 20)
    rows = [(None, bad, "a"), (1, bad, "a"), (1, prose(72, 90), "a"), (None, prose(73, 50), "a"), (None, prose(74, 60), None), (2, prose(75, 70), "a"), (2, prose(76, 40), "a"), (3, prose(77, 30), "b"), (3, prose(77, 30), "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = P.drop_benchmark(spark, docs, DATA)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t, _ in rows if t != bad)
    pieces = mixing.mix(clean).where("length is not null").groupBy("uid", "doc_id", "source", "pass_no").agg(F.sum("length").alias("n")).collect()
    mixed = P.mix_sources(spark, clean, DATA).collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed) == Counter((p.doc_id, p.source, p.n) for p in pieces)
    assert all(any(t.split()[: len(r.text.split())] == r.text.split() for i, t, s in rows if (i, s) == (r.doc_id, r.source)) for r in mixed)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, ids = docs, []
    for _, stage in P.STAGES[:3]:
        kept = P.materialize(stage(spark, kept, DATA), "t")
        assert kept.columns == docs.columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    texts = dict(texts_of(docs))
    assert ids[0] == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert ids[1] == first_of_copies({d: texts[d] for d in ids[0]})
    items = [decontaminate.normalize(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert ids[2] == {d for d in ids[1] if not any(i in decontaminate.normalize(texts[d]) for i in items)}
    mixed = P.STAGES[3][1](spark, kept, DATA).collect()
    size, target = mix_by_hand([(r.doc_id, r.source, len(r.text.encode().split())) for r in kept.collect()])
    got = Counter()
    for r in mixed:
        got[r.source] += len(r.text.encode().split())
    assert all(abs(got[s] - target[s]) <= 1 for s in target)
    assert P.run(spark, DATA).count() == len(mixed)
