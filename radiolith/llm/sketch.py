"""Parity sketches of sets: how far two sets can be from each other, from bits alone.

Each member of a set flips one of the sketch's bits (Mitzenmacher, Pagh and Pham, "Efficient Estimation for High Similarities using Odd
Sketches", 2014). Two sketches differ in no more bits than the sets in members, so that pairs that are too far apart for
a similarity are told without the sets, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, trim

#: Words of a sketch, 64 bits each.
WORDS = 16
#: Most ids of texts that are sent to every executor; for more, texts are shuffled.
SENT = 1 << 21
ROWS = 1 << 16
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * B
    return x ^ (x >> np.uint64(29))


def buffered(schema: pa.Schema, parts: Iterator[tuple], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches of columns that come in pieces."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            yield batch(schema, [np.concatenate(c) for c in zip(*held, strict=True)])
            held, size = [], 0
    if held:
        yield batch(schema, [np.concatenate(c) for c in zip(*held, strict=True)])
    trim()


def asked(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose ``th`` is among ``ids(t)``."""
    return own.join(F.broadcast(ids) if ids.count() <= SENT else ids, own["th"] == ids["t"], "left_semi")


def columns() -> list[str]:
    return [f"s{i}" for i in range(WORDS)]


def sketch(members: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, as signed words."""
    bit = (mixed(members.view(np.uint64) * B + A) >> np.uint64(17)) % np.uint64(64 * WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def majority(members: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, as one signed word: a bit is 1 if over half the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(members), 1 << 15):
        ones += np.unpackbits(members[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(members), bitorder="little").view(np.int64)


def sketches(own: DataFrame, ids: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], prints: bool = False) -> DataFrame:
    """``(t, size, s0, s1, ...)`` of the texts of ``own(th, text)`` that ``ids(t)`` names; ``sets`` gives the ``(th, set)`` of each text of a task.

    With ``prints`` there is ``fp`` too, the SimHash of the set.
    """
    schema = pa.schema([("t", pa.int64()), ("size", pa.int32()), *[(c, pa.int64()) for c in columns()], *([("fp", pa.int64())] if prints else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for th, members in sets(batches):
                words = sketch(members)
                yield np.array([th]), np.array([len(members)], dtype=np.int32), *[words[i : i + 1] for i in range(WORDS)], *([majority(members)] if prints else [])

        yield from buffered(schema, parts(), 1024)

    text = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
    return asked(own, ids).mapInArrow(run, text).dropDuplicates(["t"])


def side(table: DataFrame, name: str) -> DataFrame:
    """The table with its columns named for one side of a join."""
    return table.select(*[F.col(c).alias(f"{c}_{name}") for c in table.columns])


def near(a: str, b: str, share: float) -> Column:
    """Whether the sketches of sides ``a`` and ``b`` allow that the sets differ in no more than ``share`` of their sizes together."""
    apart = F.lit(0)
    for s in columns():
        apart = apart + F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}")))
    return apart <= F.lit(share) * (F.col(f"size_{a}") + F.col(f"size_{b}")) + 1e-6
