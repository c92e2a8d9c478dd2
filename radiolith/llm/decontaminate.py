"""Benchmark passages in documents, within a bounded number of edits.

An item of ``m`` characters may be held with up to ``e = floor(rate * m)`` insertions, deletions and
substitutions. Cut into ``e + 1`` pieces, one piece of it must then stand unchanged in the document
(pigeonhole): all pieces of all items are searched for in one Aho-Corasick pass over the whole text, and
each place that a hit points to is verified by Myers' bit-parallel edit distance. Texts are compared in
lower case with white space collapsed.

Items travel to the tasks in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark takes one
pass over the documents for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, trim

BLOCK_CHARS = 8_000_000


def normalize(text: str) -> str:
    """Lower case, white space collapsed and stripped."""
    return " ".join(text.lower().split())


def _places(text: str) -> list[int]:
    """For each character of ``normalize(text)``, where it comes from in ``text``; one more for the end."""
    out, lead = [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not lead and out:
                out.append(i)
            lead = True
        else:
            out += [i] * len(c.lower())
            lead = False
    if out and lead:
        out.pop()
    return [*out, (out[-1] + 1) if out else 0]


class Pattern:
    """Bit masks of an item's characters for Myers' algorithm."""

    def __init__(self, item: str) -> None:
        self.m = len(item)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def distances(self, text: str) -> list[int]:
        """For each end in ``text``, the least edits between the item and a piece of ``text`` that ends there."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, out, eqs = full, 0, self.m, [], self.eq
        for c in text:
            eq = eqs.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full  # a match may start anywhere
            pv = (mh << 1 & full) | (~(xv | ph) & full)
            mv = ph & xv
            out.append(score)
        return out


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of ``item`` of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = []
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalize(text)
            if not norm:
                continue
            errors = int(rate * len(norm))
            self.items.append((item_id, Pattern(norm), Pattern(norm[::-1]), errors))
            for offset, piece in pieces(norm, errors):
                held.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        if held:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, start, end)`` of the finds in ``text``; those of one item do not overlap."""
        if not self.items:
            return []
        norm = normalize(text)
        windows: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(norm):
            for k, offset in places:
                windows.setdefault(k, set()).add(last - size + 1 - offset)
        out, where = [], None
        for k, starts in sorted(windows.items()):
            item_id, ahead, back, errors = self.items[k]
            spans: list[list[int]] = []
            for s in sorted(starts):
                lo, hi = max(0, s - errors), min(len(norm), s + ahead.m + errors)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                for d, a, b in self._verify(norm[lo:hi], ahead, back, errors):
                    where = where or _places(text)
                    out.append((item_id, d, where[lo + a], where[lo + b - 1] + 1))
        return out

    @staticmethod
    def _verify(window: str, ahead: Pattern, back: Pattern, errors: int) -> list[tuple[int, int, int]]:
        """Best finds in a window, left and right of each other: ``(distance, start, end)``."""
        out, work = [], [(0, len(window))]
        while work:
            lo, hi = work.pop()
            if hi - lo < ahead.m - errors:
                continue
            scores = ahead.distances(window[lo:hi])
            best = min(scores)
            if best > errors:
                continue
            end = lo + scores.index(best) + 1
            reverse = back.distances(window[max(lo, end - ahead.m - errors) : end][::-1])
            # the longest piece with the best score: the match reaches back at least that far
            start = end - 1 - max(i for i, s in enumerate(reverse) if s == min(reverse))
            out.append((best, start, end))
            work += [(lo, start), (end, hi)]
        return out


_SEARCHERS: dict[str, Searcher] = {}


def searcher_of(name: str, held) -> Searcher:
    """The worker's searcher of a broadcast block of the benchmark; a worker keeps the last one for its next task."""
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[name] = Searcher(*held.value)
    return _SEARCHERS[name]


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance, start, end)`` of each find, ``start`` and ``end`` being code points of the document.

    Null or blank items and texts match nothing; repeated items and documents are each reported; ids may be null;
    items so short that ``rate`` leaves no error are matched exactly. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def passes(block: list[tuple[int, str]]) -> DataFrame:
        held, name = spark.sparkContext.broadcast((block, rate)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = searcher_of(name, held)
            for b in batches:
                out: list[list] = [[] for _ in schema]
                for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for found in searcher.find(text):
                        for col, v in zip(out, (doc, *found), strict=True):
                            col.append(v)
                yield batch(schema, out)
            trim()

        return docs.mapInArrow(run, "doc_id long, item_id long, distance int, start long, end long")

    result, block, size = None, [], 0
    for r in benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        if size + len(r["t"]) > BLOCK_CHARS and block:
            result = passes(block) if result is None else result.union(passes(block))
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    last = passes(block)
    return last if result is None else result.union(last)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """``(doc_id, item_id, distance, n_found)``: the least distance and the number of finds of each item in each document."""
    found = find_passages(docs, benchmark, rate)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.count("*").alias("n_found"))
