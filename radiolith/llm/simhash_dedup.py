"""SimHash near-duplicate classes through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word of the
perfect binary Golay code. Two words at distance 2 or less have a common neighbour at distance 1 or less
from both, so decoding the 24 words of the radius-1 ball around each gives the two at least one codeword
index in common (a ball decodes to 1 or 6 indices). Of at most 2 differing bits over 3 segments, one
segment has none (pigeonhole); a key joins that segment's exact bits with an index of the next segment.
Every link therefore shares a key; equal keys are candidates, and the differing bits are counted.

Keys are made for distinct fingerprints only. A key held by more than ``BUCKET`` of them is not paired:
its fingerprints are linked through the 65 words of the radius-1 ball around each instead, where equal
words mean a distance of 2 or less, and at most 65 distinct fingerprints can meet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, discard, materialize, shuffle_width, trim
from .graph import connected_components
from .sketch import SENT, near, side, sketches

#: Generator polynomial of the [23, 12] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET = 256
SEED = 42


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.array([_remainder(w) for w in range(1 << 12)], dtype=np.uint32)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], dtype=np.uint32)
    error = np.zeros(1 << 11, dtype=np.uint32)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            error[_remainder(e)] = e
    return low, high, error


_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    if not _TABLES:
        _TABLES.append(_tables())
    low, high, error = _TABLES[0]
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the distinct keys of each unsigned fingerprint."""
    ball = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = np.sort(golay_index(parts[(i + 1) % 3][:, None] ^ ball), axis=1)
        new = np.ones(index.shape, dtype=bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append((np.int64(i) << 34) | (parts[i][r].astype(np.int64) << 12) | index[r, c].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash over word shingles, repeats included; zero for a text without words or null."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(ends))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of each row; ``fp`` holds the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keys(distinct: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield batch(schema, [keys, fps[rows]])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _bucket_links(buckets: DataFrame, bits: int) -> DataFrame:
    """A spanning forest of the links in each bucket; ``fps`` has at most ``BUCKET`` entries."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        left = np.ones(len(fps), dtype=bool)
        for root in range(len(fps)):
            if not left[root]:
                continue
            left[root], stack = False, [root]
            while stack:
                at = stack.pop()
                for to in np.nonzero(near[at] & left)[0].tolist():
                    left[to] = False
                    stack.append(to)
                    yield at, to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for fps in b.column(0).to_pylist():
                own = np.array(fps, dtype=np.int64)
                for i, j in forest(own.view(np.uint64)):
                    a.append(fps[i])
                    c.append(fps[j])
            yield batch(schema, [a, c])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` at ``bits`` (2 at most) or fewer differing bits.

    Links within a bucket are thinned to a spanning forest: components are those of all links.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the keys are complete for 2 differing bits at most")
    keys = materialize(_keys(distinct), "golay-keys")
    first = Window.partitionBy("key").orderBy("fp")
    buckets = keys.withColumn("rn", F.row_number().over(first)).where(f"rn <= {BUCKET + 1}").groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    buckets = materialize(buckets, "golay-buckets")
    small = _bucket_links(buckets.where(f"size(fps) <= {BUCKET}"), bits)
    full = materialize(buckets.where(f"size(fps) > {BUCKET}").select("key"), "golay-full")
    crowd = keys.join(full, "key").select("fp").distinct()
    words = F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")
    if bits < 2:  # with fewer bits the common word is one of the two itself
        met = crowd.select(F.col("fp").alias("a"), F.explode(words).alias("b")).where("a <> b") if bits else crowd.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
        big = met.join(crowd, met["b"] == crowd["fp"], "left_semi")
    else:
        met = crowd.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
        big = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return small.union(big).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits. ``component_id`` is the smallest id that is reachable over
    links of ``bits`` or fewer differing bits, the row's own id included. Null and wordless texts have the
    fingerprint zero and link like any other; equal rows are one class; null ids are never the smallest, and
    a class with null ids only has the component null. Other columns are not read. An empty table gives no rows.
    """
    own = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    edges = links(classes, bits)
    member = materialize(connected_components(edges, "a", "b"), "fp-members")
    named = member.join(classes, member["node"] == classes["fp"]).select("fp", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("cid"))
    named = member.join(least, "root").select(F.col("node").alias("fp"), "cid")
    labels = materialize(classes.join(named, "fp", "left").select(F.col("fp").alias("class"), F.coalesce("cid", "least").alias("component_id")), "fp-labels")
    out = own.join(labels, own["fp"] == labels["class"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: prefixes of shingle sets, complete, and the sets themselves to verify

#: Shingles met in so many texts of the sample come last in the order of shingles; at most ``HOT_MOST`` of them are told apart.
HOT = 8
HOT_MOST = 1 << 16
#: Texts up to which all are the sample; of more, one in ``SAMPLE_STEP``.
SAMPLE = 1 << 14
SAMPLE_STEP = 8
#: Two like texts of ``n`` shingles or more have one and one for each ``SPARE`` of these in common in their prefixes.
SPARE = 16
ROUNDING = 1e-9


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, in order; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))}
    return np.sort(np.fromiter(hashes, dtype=np.uint64, count=len(hashes)).view(np.int64))


def _once(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(th, shingle set)`` of each text of a task; equal texts once."""
    seen: set[int] = set()
    for b in batches:
        for th, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if th not in seen:
                seen.add(th)
                yield th, shingle_set(text.as_py(), shingle)


def _hot_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order and how often each was met in a sample. They set an order only: any of them may be missing."""
    schema = pa.schema([("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in _once(batches, shingle):
            yield batch(schema, [grams])
        trim()

    if texts.count() > SAMPLE:
        texts = texts.where(F.pmod("th", F.lit(SAMPLE_STEP)) == 0)
    met = texts.select("th", "text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(f"n >= {HOT}")
    rows = sorted((r["gram"], r["n"]) for r in met.orderBy(F.desc("n"), "gram").limit(HOT_MOST).collect())
    return np.array([g for g, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def _prefixes(texts: DataFrame, shingle: int, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(key, th, n, at)``: the first shingles of each text in one order of all shingles.

    A text of ``n`` shingles shares ``similarity * n`` or more with a like one. So all but that many and ``k`` more, its prefix,
    hold the first ``k`` shingles in common, for ``k`` of 1 and one for each ``SPARE`` shingles (or all in common, if fewer).
    Uncommon shingles come first, by hash, then the common ones by frequency.
    """
    schema = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
    common, times = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for th, grams in _once(batches, shingle):
            n = len(grams)
            if len(common):
                place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                grams = grams[np.lexsort((grams, np.where(common[place] == grams, times[place], 0)))]
            most = min(n, n - max(1, math.ceil(similarity * n - ROUNDING)) + 1 + n // SPARE)
            out.append((grams[:most], np.full(most, th, dtype=np.int64), np.full(most, n, dtype=np.int32), np.arange(most, dtype=np.int32)))
            size += most
            if size >= 1 << 16:
                yield batch(schema, [np.concatenate(c) for c in zip(*out, strict=True)])
                out, size = [], 0
        if out:
            yield batch(schema, [np.concatenate(c) for c in zip(*out, strict=True)])
        trim()

    return texts.select("th", "text").mapInArrow(run, "key long, th long, n int, at int")


def _shared(keys: DataFrame, width: int) -> DataFrame:
    """The rows whose key another text has too, each text once a key, with the first and the previous text of the key."""
    schema = pa.schema([(c, pa.int32() if c in ("n", "at") else pa.int64()) for c in ("key", "th", "n", "at", "first", "before")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = last = held = None  # the first row of the key, the row before, a first row that nothing has followed yet
        for b in batches:
            if b.num_rows > 2:  # keys held once within the batch go at once
                key = b.column(0).to_numpy(zero_copy_only=False)
                same = key[1:] == key[:-1]
                keep = np.concatenate([[True], same]) | np.concatenate([same, [True]])
                b = b.filter(pa.array(keep))
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lead is None or row[0] != lead[0]:
                    lead = last = held = row
                elif row[1] != last[1]:
                    if held:
                        rows.append(held + (held[1], held[1]))
                        held = None
                    rows.append(row + (lead[1], last[1]))
                    last = row
            if rows:
                yield batch(schema, list(zip(*rows, strict=True)))
        trim()

    text = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
    return keys.repartition(width, "key").sortWithinPartitions("key", "n", "th").mapInArrow(run, text)


def _spare(n: Column) -> Column:
    return F.floor(n / SPARE)


def _meet(one: DataFrame, two: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of different roots that have as many shingles in common in their prefixes as like texts do, and whose sketches allow it.

    Of the shingles in common the first ones count, after which enough are left for ``similarity``. The sketches stand in the join's condition, so that
    unlike texts under a common shingle give no rows.
    """
    (n, at), (m, to) = [(F.col(f"n_{side}"), F.col(f"at_{side}")) for side in "xy"]
    spare = _spare(F.least(n, m))
    room = F.least(n - at, m - to) + spare >= F.lit(similarity / (1 + similarity)) * (n + m) - 1e-6
    allowed = near("x", "y", (1 - similarity) / (1 + similarity))
    met = one.join(two, (F.col("key_x") == F.col("key_y")) & (F.col("th_x") < F.col("th_y")) & (F.col("root_x") != F.col("root_y")) & room & allowed)
    most = F.greatest(F.ceil(F.lit(similarity) * F.greatest(n, m) - ROUNDING), F.lit(1))
    need = F.least(1 + spare, most)
    return met.groupBy(F.col("th_x").alias("a"), F.col("th_y").alias("b")).agg(F.count("*").alias("met"), F.max(need).alias("need")).where("met >= need").select("a", "b")


def _alike(pairs: DataFrame, own: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are alike."""
    pairs = materialize(pairs, "near-pairs")
    asked = asked_of = materialize(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "near-asked")
    if asked.count() <= SENT:  # or all texts are shuffled for a list of ids
        asked = F.broadcast(asked)
    texts = own.join(asked, own["th"] == asked["t"], "left_semi")
    sets = materialize(_shingle_sets(texts, shingle).dropDuplicates(["th"]), "near-sets")
    left = sets.select(F.col("th").alias("ta"), F.col("grams").alias("ga"))
    half = materialize(pairs.join(left, pairs["a"] == left["ta"]).select("a", "b", "ga"), "near-half")
    right = sets.select(F.col("th").alias("tb"), F.col("grams").alias("gb"))
    met = half.join(right, half["b"] == right["tb"])
    both = F.size(F.array_intersect("ga", "gb"))
    links = materialize(met.where(both >= F.lit(similarity) * (F.size("ga") + F.size("gb") - both)).select("a", "b"), "near-links")
    discard(pairs, asked_of, sets, half)
    return links


def _rooted(rows: DataFrame, member: DataFrame, name: str) -> DataFrame:
    """The rows of keys that texts of different roots share, with ``root``."""
    met = rows.select("key", "th", "n", "at").join(member, F.col("th") == F.col("node"), "left")
    rooted = materialize(met.select("key", "th", "n", "at", F.coalesce("root", "th").alias("root")), name)
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    open_ = materialize(open_, "near-open")
    rest = materialize(rooted.join(open_, F.col("key") == F.col("k"), "left_semi"), "near-rest")
    discard(rooted, open_)
    return rest


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    schema = pa.schema([("th", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], []]
        for th, grams in _once(batches, shingle):
            out[0].append(th)
            out[1].append(grams)
            if len(out[0]) == 256:
                yield batch(schema, out)
                out = [[], []]
        if out[0]:
            yield batch(schema, out)
        trim()

    return texts.select("th", "text").mapInArrow(run, "th long, grams array<long>")


def _fuzzy_pairs(signs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link all texts whose fingerprints differ in 2 bits or fewer, by their Golay keys."""
    prints = signs.select(F.col("t").alias("doc_id"), "fp")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-least")
    same = prints.join(least, "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    ends = [least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(f"least_{x}")) for x in "xy"]
    apart = links(least, 2).join(ends[0], F.col("a") == F.col("fp_x")).join(ends[1], F.col("b") == F.col("fp_y"))
    return same.union(apart.select("least_x", "least_y"))


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(th, root)``: the class of each distinct text that is like another, ``th`` being the XXH64 of the text by Spark.

    Texts are like if the sets of their word shingles (A-Z in lower case) have a Jaccard similarity of ``similarity`` or more.
    Any two like texts have shingles of their prefixes in common. The texts that share such a shingle at all are first linked by the Golay keys of their
    fingerprints; then, under each such shingle, every text meets the first and the one before it. These pairs are verified. What is alike is linked, and then every text meets all those under its shingles
    that are not linked to it and that its parity sketch may be alike to. So the classes are those of all pairs, and a large group of copies needs few of them. Equal texts are one
    row from the start. Null and wordless texts are like nothing else. Other columns are not read. Without like texts the result is empty.
    """
    width = shuffle_width(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    shared = materialize(_shared(_prefixes(own, shingle, similarity, _hot_shingles(own, shingle)), width), "near-shared")
    ids = materialize(shared.select(F.col("th").alias("t")).distinct(), "near-ids")
    whole = materialize(sketches(own, ids, lambda batches: _once(batches, shingle), prints=True), "near-sketches")
    stars = shared.select("th", "n", F.explode(F.array_distinct(F.array("first", "before"))).alias("to")).where("th <> to")
    stars = stars.groupBy(F.least("th", "to").alias("a"), F.greatest("th", "to").alias("b")).agg(F.count("*").alias("met"), F.max("n").alias("n"))
    fuzzy = _fuzzy_pairs(whole).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(stars.where(F.col("met") >= 1 + _spare(F.col("n") / 2)).select("a", "b").union(fuzzy).distinct(), "near-stars")
    signs = whole.drop("fp")
    allowed = near("x", "y", (1 - similarity) / (1 + similarity))
    half = pairs.join(side(signs, "x"), F.col("a") == F.col("t_x")).drop("t_x")
    found = _alike(half.join(side(signs, "y"), (F.col("b") == F.col("t_y")) & allowed).select("a", "b"), own, shingle, similarity)
    member = materialize(connected_components(found, "a", "b"), "near-members")
    # what is linked meets no more
    rest = _rooted(shared, member, "near-rooted")
    rows = materialize(rest.join(signs, F.col("th") == F.col("t")).drop("t"), "near-signed")
    candidates = materialize(_meet(side(rows, "x"), side(rows, "y"), similarity), "near-candidates")
    discard(shared, pairs, ids, whole, rest, rows)
    if not candidates.isEmpty():
        found = found.union(_alike(candidates, own, shingle, similarity))
        member = materialize(connected_components(found, "a", "b"), "near-members")
    return member.select(F.col("node").alias("th"), "root")
