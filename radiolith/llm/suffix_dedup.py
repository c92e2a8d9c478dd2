"""Exact removal of repeated byte strings with sharded suffix arrays.

A byte goes if a string of ``window`` bytes that covers it starts anywhere else too. Texts are UTF-8 bytes.

1. *Blocks.* Every window is assigned to the leftmost smallest hash of the ``GRAM``-byte strings within it.
   Equal windows have equal smallest strings at equal offsets, so they meet under one hash. Consecutive
   windows with the same smallest string form a block: its hash, a digest of its bytes and its place.
2. *Copies.* Blocks with the same hash and bytes are one content. Windows of a content that occurs twice are
   repeated; hashes with one content of one occurrence hold no repeated window and are done.
3. *Shards.* The distinct contents of the other hashes are cut from their texts and ranged by hash and by their bytes
   from the smallest string on. A task cuts its range into shards of bounded size, sorts the suffixes of each by
   Larsson-Sadakane refinement and takes common prefixes by Kasai's rule, in lock step over its contents.
4. *Merging.* A hash that goes on beyond a shard can have a window in another one only where a content shares
   the window's part from the smallest string on with the content at the shard's border, as everything between the two
   does. Binary search for the border's prefixes tells which contents those are. They are ranged and sharded once more,
   by their bytes before the smallest string, backwards. A window at the borders of shards in both orders is fixed by
   these borders; one of each shard is told by its digest, and a digest of two shards is repeated.
5. The repeated windows of contents go back to all texts that hold them, and the bytes are removed.

No step depends on how many contents a hash has: shards are cut by size alone, also within a hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, materialize, shuffle_width, small_range_samples

GRAM = 32
SHARD_BYTES = 1 << 20
CHUNK = 1 << 19
SEPARATOR = 0xFF  # not a byte of UTF-8

_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)])) for x in (_ODD, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return _mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum, by the upper 44 bits, of each ``width`` consecutive values."""
    n = len(h)
    ranked = h >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64)
    full = np.concatenate([ranked, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()[:n]
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return (np.minimum(back[: n - width + 1], ahead[width - 1 :]) & np.uint64((1 << 20) - 1)).astype(np.int64)


def blocks(data: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first window, number of windows, place of the smallest string from the first window on)`` of the blocks of a text."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 3)
    hashes, places = [], []
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        h = gram_hashes(data[lo : hi - 1 + window], gram)
        at = _leftmost_least(h, window - gram + 1)
        hashes.append(h[at])
        places.append(at + lo)
    h, at = np.concatenate(hashes), np.concatenate(places)
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    return h[first], first, np.diff(np.concatenate([first, [n]])), at[first] - first


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffixes in order, packed first 8 bytes)``: Larsson-Sadakane refinement, doubling over unsettled groups."""
    n = len(text)
    packed = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for i in (1, 2, 4):
        packed[:-i] = packed[:-i] << np.uint64(8 * i) | packed[i:]
    packed = packed[:n]
    sa = np.argsort(packed)
    new = np.concatenate([[True], packed[sa[1:]] != packed[sa[:-1]]])
    slot = np.arange(n, dtype=np.int64)
    start = np.maximum.accumulate(np.where(new, slot, 0))
    rank = np.zeros(n + 1, dtype=np.int64)  # 0: past the end; else 1 + first slot of the group
    rank[sa] = start + 1
    alone = new & np.concatenate([new[1:], [True]])
    open_, h = slot[~alone], 8
    while len(open_):
        idx = sa[open_]
        key = rank[idx] << 32 | rank[np.minimum(idx + h, n)]
        order = np.argsort(key)
        idx, key = idx[order], key[order]
        sa[open_] = idx
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        rank[idx] = start + 1
        alone = new & np.concatenate([new[1:], [True]])
        open_, h = open_[~alone], 2 * h
    return sa, packed


def repeated_starts(parts: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, which of its windows' starts have the same ``window`` bytes start elsewhere in the parts, and which are the first such suffixes in order."""
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in parts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = lengths - window  # windows of each part
    sa, packed = suffix_array(text)
    packed = np.concatenate([packed, np.zeros(window + 8, dtype=np.uint64)])
    before = np.full(len(text), -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    again, lead = np.zeros(len(text), dtype=bool), np.ones(len(text), dtype=bool)
    have = np.zeros(len(parts), dtype=np.int64)
    for t in range(int(count.max(initial=0))):  # Kasai: one step further in every part at once
        live = np.nonzero(count > t)[0]
        p = begin[live] + t
        q = before[p]
        got = np.maximum(have[live] - 1, 0)
        got[q < 0] = 0
        left = np.nonzero((q >= 0) & (got < window))[0]
        while len(left):
            x = packed[p[left] + got[left]] ^ packed[q[left] + got[left]]
            same = sum(((x < (np.uint64(1) << np.uint64(8 * i))).astype(np.int64) for i in range(1, 8)), (x == 0).astype(np.int64))
            got[left] = np.minimum(got[left] + same, window)
            left = left[(same == 8) & (got[left] < window)]
        have[live] = got
        hit = got >= window
        again[p[hit]] = True
        again[q[hit]] = True
        lead[p[hit]] = False
    return [(again[b : b + c], lead[b : b + c]) for b, c in zip(begin.tolist(), np.maximum(count, 0).tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last positions of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()


_BLOCK = "h long, c long, doc_id long, th long, first long, n int, off int"


def _block_rows(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("off", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                out: list[list] = [[] for _ in schema]
                for doc, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = text.encode()
                    h, first, n, off = blocks(np.frombuffer(raw, dtype=np.uint8), window)
                    ends = (first + n + window - 1).tolist()
                    first = first.tolist()
                    digests = [_digest(raw[f:e]) for f, e in zip(first, ends, strict=True)]
                    for col, values in zip(out, (h.view(np.int64).tolist(), digests, [doc] * len(first), [th] * len(first), first, n.tolist(), off.tolist()), strict=True):
                        col += values
                    if len(out[0]) > 100_000:
                        yield batch(schema, out)
                        out = [[] for _ in schema]
                yield batch(schema, out)

    return docs.select("doc_id", "th", "text").mapInArrow(run, _BLOCK)


def _cut(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The bytes of each wanted content before and from its smallest string on: ``(h, c, n, before, onward)``; repeated rows give repeated contents."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("before", pa.binary()), ("onward", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for x in cuts:
                    at = x["first"] + x["off"]
                    for col, v in zip(out, (x["h"], x["c"], x["n"], raw[x["first"] : at], raw[at : x["first"] + x["n"] + window - 1]), strict=True):
                        col.append(v)
            yield batch(schema, out)

    by_text = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "c", "n", "off", "first")).alias("cuts"))
    by_text = by_text.withColumnsRenamed({"doc_id": "doc", "th": "hash"})
    met = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["doc"]) & (docs["th"] == by_text["hash"]))
    return met.select("text", "cuts").mapInArrow(run, "h long, c long, n int, before binary, onward binary")


def border_prefixes(strings: list[bytes], at_end: bool, least: int, most: int) -> np.ndarray:
    """Length of the prefix of each of the sorted ``strings`` that it shares with the last (``at_end``) or the first one, by binary search.

    Lengths over ``most`` count as ``most``, those below ``least`` as ``least - 1``.
    """
    edge = strings[-1 if at_end else 0]
    lengths = range(least, min(most, len(edge)) + 1)
    if at_end:  # those from the prefix's place on have it
        reach = np.array([bisect_left(strings, edge[:k]) for k in lengths], dtype=np.int64)
        return least - 1 + np.searchsorted(reach, np.arange(len(strings)), side="right")
    reach = np.array([bisect_left(strings, edge[:k] + bytes([SEPARATOR])) for k in lengths], dtype=np.int64)
    return least - 1 + np.searchsorted(-reach, -np.arange(len(strings)), side="left")


def _cut_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[list[tuple], bool, bool]]:
    """Shards of rows ``(h, c, ...)`` in order, repeated contents once; whether the first and the last hash may go on in the shard before and after."""
    held, size, below = [], 0, True
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if held and row[:2] == held[-1][:2]:
                continue
            same = bool(held) and row[0] == held[-1][0]
            if size >= (2 if same else 1) * shard_bytes:
                yield held, below, same
                held, size, below = [], 0, same
            held.append(row)
            size += len(row[3]) + len(row[4])
    if held:
        yield held, below, True


def _at_borders(held: list[tuple], column: int, below: bool, above: bool, least: int, window: int) -> dict[int, int]:
    """For the rows of a shard that share ``least`` or more bytes of ``column`` with its first or last row of the same hash, if that goes on: how many."""
    found: dict[int, int] = {}
    for end, goes_on in ((False, below), (True, above)):
        if not goes_on:
            continue
        h = held[-1 if end else 0][0]
        rows = [i for i, x in enumerate(held) if x[0] == h]
        for i, k in zip(rows, border_prefixes([held[i][column] for i in rows], end, least, window).tolist(), strict=True):
            if k >= least:
                found[i] = max(found.get(i, 0), k)
    return found


_FOUND = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _repeats(held: list[tuple], flags: list[tuple[np.ndarray, np.ndarray]]) -> list[list]:
    out: list[list] = [[], [], [], []]
    for (h, c, *_), (again, _) in zip(held, flags, strict=True):
        for lo, hi in zip(*_runs(again), strict=True):
            for col, v in zip(out, (h, c, lo, hi), strict=True):
                col.append(v)
    return out


def _onward_shards(contents: DataFrame, window: int, width: int, shard_bytes: int) -> DataFrame:
    """Repeated windows of the shards, first and last of each run, and the contents whose windows other shards may hold.

    The latter have a null ``lo``, their bytes, and ``least``, the bytes before the smallest string of the first such window.
    """
    schema = pa.schema([*_FOUND, ("n", pa.int32()), ("least", pa.int32()), ("backward", pa.binary()), ("onward", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, below, above in _cut_shards(batches, shard_bytes):
            out = _repeats(held, repeated_starts([x[3] + x[4] for x in held], window))
            out += [[None] * len(out[0]) for _ in range(4)]
            for i, k in _at_borders(held, 4, below, above, GRAM, window).items():
                h, c, n, before, onward = held[i]
                least = max(window - k, len(before) - n + 1)
                if least <= len(before):
                    for col, v in zip(out, (h, c, None, None, n, least, before[::-1], onward), strict=True):
                        col.append(v)
            yield batch(schema, out)

    rows = contents.repartitionByRange(width, "h", "onward", "c").sortWithinPartitions("h", "onward", "c").select("h", "c", "n", "before", "onward")
    return rows.mapInArrow(run, "h long, c long, lo int, hi int, n int, least int, backward binary, onward binary")


def _backward_shards(contents: DataFrame, window: int, width: int, shard_bytes: int) -> DataFrame:
    """As :func:`_onward_shards`, of contents ranged by the bytes before their smallest strings; rows with ``d1, d2``, a window's digest,
    stand for the windows at borders in both orders: the first of its kind in the shard."""
    schema = pa.schema([*_FOUND, ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, below, above in _cut_shards(batches, shard_bytes):
            raws = [x[3][::-1] + x[4] for x in held]
            flags = repeated_starts(raws, window)
            out = _repeats(held, flags)
            out += [[None] * len(out[0]) for _ in range(2)]
            for i, k in _at_borders(held, 3, below, above, 0, window).items():
                h, c, n, back, _, least = held[i]
                first = len(back) - min(k, len(back))  # windows from here on have no more than k bytes before
                for lo in (first + np.flatnonzero(flags[i][1][first : min(n, len(back) - least + 1)])).tolist():
                    d = hashlib.blake2b(raws[i][lo : lo + window], digest_size=16).digest()
                    for col, v in zip(out, (h, c, lo, lo, *np.frombuffer(d, dtype=np.int64).tolist()), strict=True):
                        col.append(v)
            yield batch(schema, out)

    rows = contents.repartitionByRange(width, "h", "backward", "c").sortWithinPartitions("h", "backward", "c").select("h", "c", "n", "backward", "onward", "least")
    return rows.mapInArrow(run, "h long, c long, lo int, hi int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, th, spans)``: the repeated bytes of each text that has some, as runs ``lo, hi`` (end exclusive) that may overlap."""
    width = shuffle_width(docs.sparkSession)
    rows = materialize(_block_rows(docs, window), "sa-blocks")
    place = F.min(F.struct("doc_id", "th", "first", "n", "off")).alias("at")
    contents = materialize(rows.groupBy("h", "c").agg(F.count("*").alias("times"), place).select("h", "c", "times", "at.*"), "sa-contents")
    per_hash = contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1")
    per_hash = materialize(per_hash, "sa-hashes")
    cut = materialize(_cut(contents.join(per_hash, "h"), docs, window), "sa-bytes")
    with small_range_samples(docs.sparkSession):
        onward = materialize(_onward_shards(cut, window, width, shard_bytes), "sa-onward")
    discard(cut)
    edge = materialize(onward.where("lo is null").select("h", "c", "n", "least", "backward", "onward"), "sa-edge")
    with small_range_samples(docs.sparkSession):
        backward = materialize(_backward_shards(edge, window, width, shard_bytes), "sa-backward")
    told = backward.where("d1 is not null")
    twice = materialize(told.groupBy("d1", "d2").count().where("count > 1").select(F.col("d1").alias("x1"), F.col("d2").alias("x2")), "sa-twice")
    met = told.join(twice, (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")))
    runs = ("h", "c", "lo", "hi")
    copies = contents.where("times > 1").select("h", "c", F.lit(0).alias("lo"), F.expr("n - 1").alias("hi"))
    found = copies.union(onward.where("lo is not null").select(*runs)).union(backward.where("d1 is null").select(*runs)).union(met.select(*runs))
    found = found.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    found = materialize(found, "sa-found")
    discard(contents, per_hash, onward, edge, backward, twice)
    own = rows.select(F.col("h").alias("bh"), F.col("c").alias("bc"), "doc_id", "th", "first")
    met = own.join(found, (own["bh"] == found["h"]) & (own["bc"] == found["c"]))
    spans = met.select("doc_id", "th", F.explode("runs").alias("run"), "first")
    spans = spans.select("doc_id", "th", F.struct((F.col("first") + F.col("run.lo")).alias("lo"), (F.col("first") + F.col("run.hi") + window).alias("hi")).alias("span")).distinct()
    spans = materialize(spans.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans")), "sa-spans")
    discard(rows, found)
    return spans


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row, with ``kept`` (binary) if ``with_text``.

    ``n_spans`` counts the maximal removed runs; ``kept_sha256`` is of the bytes that stay, in order. A null
    text counts as empty, a text shorter than ``window`` bytes stays whole, equal rows of ``window`` bytes or
    more remove each other wholly, a string that overlaps its own second occurrence counts, null ids are kept.
    Texts may have any length. Other columns are not read. An empty table gives no rows. ``shard_bytes`` sets the size of
    a shard (twice that within one hash), not the result.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(docs, window, shard_bytes).withColumnsRenamed({"doc_id": "doc", "th": "hash"})
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, kept, at, runs = text.encode(), [], 0, 0
                for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
                    if lo > at or not runs:
                        runs += 1
                        kept.append(raw[at:lo])
                    at = max(at, hi)
                kept = b"".join([*kept, raw[at:]])
                values = (doc, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)
                for col, v in zip(out, values[: len(schema)], strict=True):
                    col.append(v)
            yield batch(schema, out)

    met = docs.join(spans, docs["doc_id"].eqNullSafe(spans["doc"]) & (docs["th"] == spans["hash"]), "left")
    return met.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
