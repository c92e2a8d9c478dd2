"""Exact join of word-shingle sets by Jaccard similarity, by partitioning the universe of shingles.

Deng, Li, Wen and Feng, "An Efficient Partition Based Method for Exact Set Similarity Joins" (2016). Sets are banded by size, so that
similar ones are in the same band or the next. For a band, shingles are hashed into one segment more than two similar sets can differ
by shingles: so some segment holds the same subset of both. Segment ``i`` may be allotted a distance ``d``: -1 (left out), 0 (its subset is a key), or
1 (its subset is a key, and so is its neighbourhood, the subset less any one shingle). As long as ``d + 1`` adds up to the number of
segments, similar sets share a key. The allotment of a band is the cheapest by the numbers of keys and of pairs seen in a sample of the sets;
the sample sets the cost alone, not the result.

Under each key every set meets the first and the one before it; verified links make components, and only sets of different components
meet then. Two sets that share a key are a candidate only if parity sketches allow it: bit ``h(shingle)`` is flipped for each shingle, so the
sketches of two sets differ in no more bits than the sets in shingles. That test stands in the join's condition, so that the many unlike sets
under a common key give no rows. Candidates are verified on their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, materialize, shuffle_width, trim
from .graph import connected_components
from .sketch import A as _A
from .sketch import B as _B
from .sketch import C as _C
from .sketch import asked, buffered, mixed, near, side, sketches

SEED = 42
#: Of the sets, one in so many is asked what keys of a band cost.
SAMPLE = 32
#: Words remembered by a task, each once hashed.
WORDS = 1 << 18


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < WORDS:
            self[word] = h
        return h


def shingle_hashes(text: str, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the distinct word shingles of a text (A-Z in lower case), in order; a text of fewer words is one shingle, one without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * _A + h[i : i + len(out)])
    return np.unique(out)


class Bands:
    """Sizes from ``edge[i]`` to below ``edge[i + 1]`` are band ``i``; sets alike to ``percent`` are in the same band or in neighbours."""

    def __init__(self, percent: int, most: int = 1 << 40) -> None:
        self.percent, self.edge = percent, [1]
        while self.edge[-1] <= most:
            self.edge.append(self.edge[-1] * 100 // percent + 1)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edge, n, side="right")) - 1

    def segments(self, band: int) -> int:
        """One more than the shingles by which similar sets of this band and the one below can differ."""
        return self.budget(2 * (self.edge[band + 1] - 1)) + 1

    def budget(self, both: int) -> int:
        """Shingles by which similar sets of ``both`` shingles together can differ."""
        return both * (100 - self.percent) // (100 + self.percent)


def _subsets(grams: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment of each shingle, code of each shingle, key of each segment)``; a key is a sum, so that one shingle less is a difference."""
    seg = (mixed(grams * _C + np.uint64(band)) >> np.uint64(20)) % np.uint64(m)
    code = mixed(grams * _A + _C)
    own = np.zeros(m, dtype=np.uint64)
    np.add.at(own, seg.astype(np.int64), code)
    return seg.astype(np.int64), code, own


def _named(own: np.ndarray, seg: np.ndarray, band: int) -> np.ndarray:
    """Keys of segments in a band, as signed integers."""
    place = (seg.astype(np.uint64) << np.uint64(20)) + np.uint64(band)
    return mixed(own + mixed(place * _B + _C)).view(np.int64)


def band_keys(grams: np.ndarray, band: int, m: int, allotted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, segments, kinds)`` of a set in a band; kind 1 is a subset less one shingle. Without an allotment each segment has both kinds."""
    seg, code, own = _subsets(grams, band, m)
    all_ = np.arange(m)
    full = all_ if allotted is None else all_[allotted >= 0]
    less = np.arange(len(grams)) if allotted is None else np.flatnonzero(allotted[seg] > 0)
    at = np.concatenate([full, seg[less]])
    keys = _named(np.concatenate([own[full], own[seg[less]] - code[less]]), at, band)
    return keys, at, np.repeat(np.array([0, 1], dtype=np.int8), [len(full), len(less)])


def allot(cost: pd.DataFrame, m: int, sets: int) -> np.ndarray:
    """``d`` of each of ``m`` segments of a band, from ``cost(seg, full, less, shingles)``: pairs that share its subset, further ones that share a neighbourhood, and shingles in it over ``sets`` sets.

    Leaving the dearest segment out is paid for with the neighbourhood of the cheapest, as long as that saves pairs and keys.
    """
    out = np.zeros(m, dtype=np.int8)
    cost = cost.set_index("seg").reindex(range(m), fill_value=0)
    dear = cost["full"].to_numpy(dtype=np.float64) + sets
    more = cost["less"].to_numpy(dtype=np.float64) + cost["shingles"].to_numpy(dtype=np.float64)
    going, coming = np.argsort(-dear, kind="stable").tolist(), np.argsort(more, kind="stable").tolist()
    while going and coming:
        out_at, in_at = going.pop(0), coming.pop(0)
        if out_at == in_at or out[out_at] or out[in_at] or dear[out_at] <= more[in_at]:
            break
        out[out_at], out[in_at] = -1, 1
    return out


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(th, shingles)`` of each text of a task that has words; equal texts once."""
    seen: set[int] = set()
    known = _Words()
    for b in batches:
        for th, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if th not in seen:
                seen.add(th)
                grams = shingle_hashes(text.as_py(), shingle, known)
                if len(grams):
                    yield th, grams


def _allotments(own: DataFrame, shingle: int, bands: Bands, sample: int) -> dict[int, np.ndarray]:
    """The allotment of each band that has one other than 0 throughout, from one in ``sample`` sets."""
    schema = pa.schema([("band", pa.int32()), ("seg", pa.int32()), ("key", pa.int64()), ("kind", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for _, grams in _sets(batches, shingle):
                for band in (bands.of(len(grams)), bands.of(len(grams)) + 1):
                    m = bands.segments(band)
                    if m > 1:
                        keys, seg, kind = band_keys(grams, band, m, None)
                        yield np.full(len(keys), band, dtype=np.int32), seg.astype(np.int32), keys, kind

        yield from buffered(schema, parts())

    drawn = own.where(F.pmod("th", F.lit(sample)) == 0)
    one = lambda k: F.sum(F.when(F.col("kind") == k, 1.0).otherwise(0.0))
    keys = drawn.mapInArrow(run, "band int, seg int, key long, kind byte").groupBy("band", "seg", "key").agg(one(0).alias("f"), one(1).alias("l"))
    cost = keys.groupBy("band", "seg").agg(F.sum(F.col("f") * (F.col("f") - 1) / 2 * sample * sample).alias("full"), F.sum(F.col("f") * F.col("l") * sample * sample).alias("less"), (F.sum("l") * sample).alias("shingles"), (F.sum("f") * sample).alias("sets"))

    def choose(key: tuple, cost: pd.DataFrame) -> pd.DataFrame:
        d = allot(cost, bands.segments(int(key[0])), int(cost["sets"].max()))
        at = np.flatnonzero(d)
        return pd.DataFrame({"band": np.full(len(at), key[0], dtype=np.int32), "seg": at.astype(np.int32), "d": d[at].astype(np.int32)})

    out: dict[int, np.ndarray] = {}
    for r in cost.groupBy("band").applyInPandas(choose, "band int, seg int, d int").collect():  # fewer than the longest text has shingles, over all bands
        out.setdefault(r["band"], np.zeros(bands.segments(r["band"]), dtype=np.int8))[r["seg"]] = r["d"]
    return out


def _keys(own: DataFrame, shingle: int, bands: Bands, allotted: dict[int, np.ndarray]) -> DataFrame:
    """``(key, th, n, kind)`` of each set in its band and the one above."""
    schema = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("kind", pa.int8())])
    held = own.sparkSession.sparkContext.broadcast(allotted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.zeros(0, dtype=np.int8)

        def parts() -> Iterator[tuple]:
            for th, grams in _sets(batches, shingle):
                for band in (bands.of(len(grams)), bands.of(len(grams)) + 1):
                    m = bands.segments(band)
                    d = held.value.get(band, plain)
                    keys, _, kind = band_keys(grams, band, m, d if len(d) else np.zeros(m, dtype=np.int8))
                    yield keys, np.full(len(keys), th, dtype=np.int64), np.full(len(keys), len(grams), dtype=np.int32), kind

        yield from buffered(schema, parts())

    return own.mapInArrow(run, "key long, th long, n int, kind byte")


def _shared(keys: DataFrame, width: int) -> DataFrame:
    """The rows whose key another set has too, each set once a key and kind, with the first and the previous set of the key."""
    schema = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("kind", pa.int8()), ("first", pa.int64()), ("before", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = last = held = None  # the key's first row, the row before, a first row that no other set has followed yet
        for b in batches:
            if b.num_rows > 2:  # keys that the batch holds once go at once
                key = b.column(0).to_numpy(zero_copy_only=False)
                same = key[1:] == key[:-1]
                b = b.filter(pa.array(np.concatenate([[True], same]) | np.concatenate([same, [True]])))
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lead is None or row[0] != lead[0]:
                    lead = last = held = row
                elif row[1] != last[1] or row[3] != last[3]:
                    if held is not None and row[1] != lead[1]:
                        out.append((*held, held[1], held[1]))
                        held = None
                    if held is None:
                        out.append((*row, lead[1], last[1]))
                    last = row
            if out:
                yield batch(schema, list(zip(*out, strict=True)))
        trim()

    return keys.repartition(width, "key").sortWithinPartitions("key", "n", "th", "kind").mapInArrow(run, "key long, th long, n int, kind byte, first long, before long")


def _alike(pairs: DataFrame, own: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose shingle sets are similar."""
    ids = materialize(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct(), "join-asked")
    schema = pa.schema([("th", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, grams in _sets(batches, shingle):
            yield batch(schema, [[th], [grams.view(np.int64)]])
        trim()

    sets = materialize(asked(own, ids).mapInArrow(run, "th long, grams array<long>").dropDuplicates(["th"]), "join-sets")
    left = sets.select(F.col("th").alias("ta"), F.col("grams").alias("ga"))
    right = sets.select(F.col("th").alias("tb"), F.col("grams").alias("gb"))
    half = materialize(pairs.join(left, F.col("a") == F.col("ta")).select("a", "b", "ga"), "join-half")
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    links = half.join(right, F.col("b") == F.col("tb")).where(both * 100 >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b")
    links = materialize(links, "join-links")
    discard(ids, sets, half)
    return links


def links(own: DataFrame, shingle: int = 3, percent: int = 90, sample: int = SAMPLE) -> DataFrame:
    """``(node, root)`` of the components of all links between the different texts of ``own(th, text)``; texts without links have no row."""
    bands, width = Bands(percent), shuffle_width(own.sparkSession)
    own = own.select("th", "text")
    shared = materialize(_shared(_keys(own, shingle, bands, _allotments(own, shingle, bands, sample)), width), "join-shared")
    ids = materialize(shared.select(F.col("th").alias("t")).distinct(), "join-ids")
    signs = materialize(sketches(own, ids, lambda batches: _sets(batches, shingle)), "join-sketches")
    stars = shared.select("th", F.explode(F.array_distinct(F.array("first", "before"))).alias("to")).where("th <> to")
    stars = materialize(stars.select(F.least("th", "to").alias("a"), F.greatest("th", "to").alias("b")).distinct(), "join-stars")
    half = stars.join(side(signs, "x"), F.col("a") == F.col("t_x")).drop("t_x")
    close = half.join(side(signs, "y"), (F.col("b") == F.col("t_y")) & near("x", "y", (100 - percent) / (100 + percent))).select("a", "b")
    close = materialize(close, "join-near")
    found = _alike(close, own, shingle, percent)
    member = materialize(connected_components(found, "a", "b"), "join-members")
    # what is linked already meets no more
    rooted = materialize(shared.select("key", "th", "kind").join(member, F.col("th") == F.col("node"), "left").select("key", "th", "kind", F.coalesce("root", "th").alias("root")), "join-rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    open_ = materialize(open_, "join-open")
    rest = rooted.join(open_, F.col("key") == F.col("k"), "left_semi").join(signs, F.col("th") == F.col("t")).drop("t")
    rest = materialize(rest, "join-rest")
    one, two = side(rest, "x"), side(rest, "y")
    condition = (F.col("key_x") == F.col("key_y")) & (F.col("th_x") < F.col("th_y")) & (F.col("root_x") != F.col("root_y")) & (F.col("kind_x") + F.col("kind_y") < 2) & near("x", "y", (100 - percent) / (100 + percent))
    met = materialize(one.join(two, condition).select(F.col("th_x").alias("a"), F.col("th_y").alias("b")).distinct(), "join-met")
    discard(shared, ids, signs, stars, close, rooted, open_, rest)
    if met.isEmpty():
        return member
    found = found.union(_alike(met, own, shingle, percent))
    return materialize(connected_components(found, "a", "b"), "join-members")


def similar_documents(docs: DataFrame, shingle: int = 3, percent: int = 90, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row of ``docs``.

    A row's set are the distinct ``shingle``-word shingles of its text, A-Z in lower case; of fewer words it is the whole sequence. Rows link whose sets have
    ``percent`` hundredths or more of their union in common. ``component_id`` is the smallest id that is reachable over links, the row's own included. Null
    texts and texts without words have no shingles and link with nothing, not even with their equals. Equal texts are one set, however many there are; null ids are never
    the smallest, and a class of null ids only has the component null. Rows that repeat are rows of their own. Other columns are not read. An empty table gives no rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Words(), {}
        for b in batches:
            n = []
            for th, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if th not in seen:
                    seen[th] = len(shingle_hashes(text.as_py(), shingle, known))
                n.append(seen[th])
            yield batch(schema, [b.column(0), b.column(1), n])
        trim()

    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(count, "doc_id long, th long, n_shingles long"), "join-rows")
    member = links(own, shingle, percent, sample)
    classes = materialize(rows.where("n_shingles > 0").groupBy("th").agg(F.min("doc_id").alias("least")), "join-classes")
    named = classes.join(member, F.col("th") == F.col("node"), "left").select("th", "least", F.coalesce("root", "th").alias("root"))
    named = materialize(named, "join-named")
    least = materialize(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component")), "join-least")
    labels = materialize(named.join(least, F.col("root") == F.col("r")).select(F.col("th").alias("t"), "component"), "join-labels")
    out = rows.join(labels, F.col("th") == F.col("t"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


__all__ = ["Bands", "allot", "band_keys", "links", "shingle_hashes", "similar_documents"]
