"""Filter audit, Jaccard join and kd-tree clustering against brute force, with nulls, ties, repeats and odd texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from radiolith.llm import filter_audit, jaccard_join, kd_means

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, mask int, digest string, label string"


def doc_rows():
    rng = random.Random(3)
    texts = [None, "", " \t", "One", "X" * 40, "a&b c", " ".join(f"w{i}" for i in range(250)), "one two " * 150, "ÄÖ  no ascii capitals", " ".join(f"Cap{i % 90}" for i in range(300)), "x " * 5000]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["en", "", None, "de"]), "clash", 9, "clash", "clash") for _ in range(90)]
    return rows + [(None, texts[6], "en", "c", 1, None, None), (None, texts[6], "en", "c", 1, None, None), rows[0], rows[0]]


def label_rows():
    rng = random.Random(4)
    return [(rng.choice([*range(70), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "clash") for _ in range(60)]


def fails_of(text, doc_id, all_rows):
    text = text or ""
    words = WORD.findall(text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in all_rows),
    }


def test_audit(spark):
    rows, labels = doc_rows(), label_rows()
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    want = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], {f for f, x in fails_of(r[1], r[0], rows).items() if x}) for r in rows if (r[2] or "") == part]
        removed_in = {f: 0 for f in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_in[f] += len(gone)
                failing = [x for x in own if f in x[1]]
                want[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(removed_in[order[step - 1]])
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, good string")).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame(doc_rows(), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit(docs, labels).collect()
    assert rows and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_cells_from_signed_sums(spark):
    rng = random.Random(6)
    rows = [("p", rng.randrange(32), False, False) for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))
    r = sums.select("w", filter_audit.cells(sums["w"]).alias("c")).first()
    assert r["c"] == [sum(m == k for _, m, _, _ in rows) for k in range(32)]
    assert r["w"] == [sum((-1) ** (m & s).bit_count() for _, m, _, _ in rows) for s in range(32)]


# sets of shingles


def similar(rows, percent, shingle=3):
    """(doc_id, size, smallest reachable id) of each row, all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    smallest = lambda ids: min((d for d in ids if d is not None), default=None)
    return sorted([(d, len(sets[i]), smallest(least[find(i)])) for i, (d, _) in enumerate(rows)], key=repr)


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(k)] for k in (11, 20, 45, 150)]
    line = words[:9]
    out = [None, "", " \n", "a", "A", "a b", "A\tb", "one two three", "x y " * 8000]
    for _ in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(2)] = rng.choices(words, k=rng.randrange(3))
        out += [" ".join(b), " ".join([*line, *rng.choices(words, k=2)])]
    return out + out[9:15]


@pytest.mark.parametrize(("percent", "sample"), [(90, jaccard_join.SAMPLE), (90, 1), (80, 1)])
def test_jaccard_join(spark, percent, sample):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(near_copies(percent + sample, 150))]
    rows += [rows[12], rows[12], (5, rows[20][1])]
    docs = spark.createDataFrame([(*r, "clash", 7, 1) for r in rows], "doc_id long, text string, th string, n_shingles int, key int").repartition(4)
    got = jaccard_join.similar_documents(docs, percent=percent, sample=sample).collect()
    assert sorted(map(tuple, got), key=repr) == similar(rows, percent)


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard_join.similar_documents(docs).count() == 0
    lone = spark.createDataFrame([(1, None), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.similar_documents(lone).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("percent", [60, 90, 100])
def test_similar_sets_share_a_key_under_every_allotment(percent):
    rng = np.random.default_rng(percent)
    bands = jaccard_join.Bands(percent, 1 << 20)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, int(rng.integers(0, 5)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        band = max(bands.of(len(a)), bands.of(len(b)))
        assert abs(bands.of(len(a)) - bands.of(len(b))) <= 1
        m = bands.segments(band)
        pairs = rng.permutation(m)
        moved = int(rng.integers(0, m // 2 + 1))
        d = np.zeros(m, dtype=np.int8)
        d[pairs[:moved]], d[pairs[m - moved :]] = -1, 1
        keys = [{(k, t) for k, t in zip(*[x.tolist() for x in jaccard_join.band_keys(g, band, m, d)[::2]], strict=True)} for g in (a, b)]
        assert any((k, s) in keys[1] for k, t in keys[0] for s in (0, 1) if s + t < 2)


def test_allotment_pays_for_what_it_leaves_out():
    cost = pd.DataFrame({"seg": [0, 1, 2, 3], "full": [9e6, 10, 8e6, 0], "less": [9e6, 500, 8e6, 100], "shingles": [900, 800, 900, 700]})
    d = jaccard_join.allot(cost, 4, 100)
    assert d.tolist() == [-1, 1, -1, 1] and (d + 1).sum() >= 4
    assert jaccard_join.allot(cost.assign(full=1), 4, 100).tolist() == [0, 0, 0, 0]


# clustering


def clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [v for _, v in (first + [x for x in kept if x[0] is None])[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, x, d in out if x == c) for _, c, _ in out}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out], key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, x int"


def vector_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(size=64) * 0.2).astype(np.float32).tolist(), "clash", 1) for i in range(n)]
    hot = rows[0][1]
    rows += [(n + i, hot, "clash", 1) for i in range(n // 2)]  # more than a third of all
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63, [0.0] * 64, [-0.0] * 64, [-0.001] * 64]
    rows += [(1000 + i, v, "c", 2) for i, v in enumerate(odd)]
    return rows + [(None, rows[3][1], "c", 1), rows[1], rows[1]]


def test_kd_means(spark):
    rows = vector_rows(300)
    got = kd_means.cluster(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == clusters([r[:2] for r in rows])


def test_kd_means_of_few(spark):
    rows = vector_rows(300)[:5]
    got = kd_means.cluster(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=repr) == clusters([r[:2] for r in rows])
    assert kd_means.cluster(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 33, 500, 3000])
def test_filtering_prunes_and_stays_exact(n):
    rng = np.random.default_rng(n)
    middle = rng.integers(-500, 500, (12, 8))
    x = (middle[rng.integers(0, 12, n)] + rng.integers(-20, 20, (n, 8))).astype(np.int32)
    z = np.concatenate([middle[:6], middle[:2], x[:1]]).astype(np.int64)  # equal centroids too
    order, low, high, sums = kd_means.plant(x)
    d = ((x[order].astype(np.int64)[:, None, :] - z[None]) ** 2).sum(axis=2)
    own = kd_means.Filter(z)
    assert own.assign(x[order], low, high).tolist() == d.argmin(axis=1).tolist()
    whole = []
    label = own.assign(x[order], low, high, lambda node, count, c: whole.append((node, count, c)))
    assert sum(c for _, c, _ in whole) + (label >= 0).sum() == n
    total = np.zeros_like(z)
    for node, _, c in whole:
        total[c] += sums[node]
    for c in range(len(z)):
        assert (total[c] + x[order][label == c].sum(axis=0) == x[order][d.argmin(axis=1) == c].sum(axis=0)).all()
    if n >= 3000:
        assert sum(c for _, c, _ in whole) > n // 2  # most vectors go with a whole node
