"""The pipeline's stages on empty tables, on rows that repeat and on columns with clashing names."""

import random

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from radiolith.llm import simhash_dedup, sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("th", "member", "root", "kept_doc_id", "gone", "key", "uid", "taken", "fp", "size")


def test_every_stage_of_an_empty_table(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([], DOCS)
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        if name != P.STAGES[-1][0]:
            docs = out


def test_kept_row_does_not_depend_on_the_order(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, lang, source, n) for lang in ("en", "de", None) for source in ("d", "c", None, "b") for n in (5, 4)]
    seen = set()
    for k in range(4):
        random.Random(k).shuffle(rows)
        seen.add(tuple(P.drop_near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(1 + k), DATA).collect()))
    assert seen == {((7, text, None, "b", 4),)}  # nulls first among what only breaks ties


def test_stages_with_clashing_columns(spark):
    import corpus_pipeline as P

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"word{rng.randrange(900)}" for _ in range(60)), "en", "a", 1) for i in range(12)], DOCS)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(docs.select(*P.COLUMNS).collect(), DOCS)
        out = stage(spark, docs.withColumns({c: F.lit("clash") for c in CLASHES}), DATA)
        assert out.columns == list(P.COLUMNS) and out.count() >= 12
        docs = out


def test_sketches_never_lose_a_pair():
    rng = np.random.default_rng(3)
    for n in (1, 20, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.int64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, n // 9 + 1, dtype=np.int64)]))
        apart = int(np.bitwise_count((sketch.sketch(a) ^ sketch.sketch(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b)) and not (sketch.sketch(a) ^ sketch.sketch(a)).any()


def test_a_large_group_under_common_shingles(spark):
    """Texts that share most shingles and are not alike, among pairs that are: no link is lost or made up."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts, groups = [], []
    for k in range(120):
        own = list(base)
        for _ in range(7):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        pair = [" ".join(own), " ".join([*own, f"tail{k}"])]
        texts += pair
        groups.append(pair)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(find(i), set()).add(t)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = {r.th: r.text for r in df.select("text", F.xxhash64("text").alias("th")).collect()}
    got = {}
    for r in simhash_dedup.similar_components(df).collect():
        got.setdefault(r.root, set()).add(hashes[r.th])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
