"""Plain files of a batch, walked side by side: one step reads the next header of all of them.

A file is plain if it has its preamble and its meta group's length, and then nothing but public elements in ascending order, without a
sequence, a character set, or anything that calls for a warning. All others are left to :class:`~radiolith.sources.part10.Parser`, which is also
what tells how tags and representations are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from radiolith.functions.values import KNOWN_VRS, LONG_FORM_VRS
from radiolith.operators import dictionary as D

from .part10 import INFLATED, UNDEFINED, Parsed, Parser, PartError, _View

#: Longer files are read one at a time: there the values are long, not many.
LONGEST = 1 << 18
#: With fewer files left in step, one at a time is faster.
FEWEST = 16
_CHARSET = 0x00080005
_ITEMS = 0xFFFE
_SHORT, _LONG = 1, 2


def _code(vr: str) -> int:
    return ord(vr[0]) << 8 | ord(vr[1])


_FORMS = np.zeros(65536, np.uint8)
for _vr in KNOWN_VRS:
    _FORMS[_code(_vr)] = _LONG if _vr in LONG_FORM_VRS else _SHORT
_FORMS[_code("SQ")] = 0  # left to the parser


@dataclass
class Plain:
    """Root elements of plain files, in the order of files and elements; an element's ``raw`` is a slice of ``arena``."""

    file: np.ndarray  # the files' places in the batch
    metas: list[tuple[dict, list]]
    meta: np.ndarray  # a place in ``metas`` for each file
    ends: np.ndarray  # where each file's elements begin, and the end
    arena: np.ndarray
    ord: np.ndarray
    tag: pa.Array
    vr: pa.Array
    length: np.ndarray
    offset: np.ndarray
    little: np.ndarray
    at: np.ndarray  # where each value begins in ``arena``


def _gathered(arena: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of slices, one behind the other."""
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return ends, arena[np.repeat(at - ends[:-1], lengths) + np.arange(ends[-1])]


class Walker:
    """Finds the plain files of batches and reads them; ``parser`` has the dictionary and reads file meta."""

    def __init__(self, parser: Parser) -> None:
        self.parser = parser
        self.heads: dict[bytes, tuple[str, dict, list] | None] = {}
        self.tags: dict[tuple[int, bool], int] = {}

    def _head(self, head: bytes) -> tuple[str, dict, list] | None:
        """Kind of syntax, meta and residue of a file meta group; None if it calls for a warning or an error."""
        if head not in self.heads:
            if len(self.heads) > 4096:
                self.heads.clear()
            parser, found = self.parser, None
            parser.out = Parsed()
            try:
                end = parser._meta(_View(head, "input"), 0)
                kind = D.TRANSFER_SYNTAXES.get(parser.out.meta["transfer_syntax_uid"])
                if end == len(head) and kind and not parser.out.warnings:
                    found = kind, parser.out.meta, parser.out.residue
            except PartError:
                pass
            self.heads[head] = found
        return self.heads[head]

    def _vr(self, tag: int, explicit: bool) -> int:
        """The representation of a public tag: that of an implicit data set, or the one that an explicit one must have, 0 for any."""
        if (got := self.tags.get((tag, explicit))) is None:
            if len(self.tags) > 65536:
                self.tags.clear()
            name = f"{tag:08X}"
            vr = self.parser.vrs.get(name, "") if explicit else self.parser._implicit_vr(None, name, {}, 0)
            got = self.tags[tag, explicit] = _code(vr) if vr else 0
        return got

    def read(self, content: pa.Array) -> Plain | None:
        """The plain files of ``content``, binary values; None if there is none."""
        content = content.cast(pa.large_binary())
        places = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
        data = content.buffers()[2].to_pybytes() if content.buffers()[2] else b""
        arena = np.frombuffer(data, np.uint8)
        begin, end = places[:-1], places[1:]
        able = (end - begin >= 144) & (end - begin <= LONGEST)
        if content.null_count:
            able &= content.is_valid().to_numpy(zero_copy_only=False)
        files = np.flatnonzero(able)
        mark = np.frombuffer(b"DICM\x02\0\0\0UL\x04\0", np.uint8)
        files = files[(arena[begin[files][:, None] + np.arange(128, 140)] == mark).all(axis=1)] if len(files) else files
        if len(files) < FEWEST:
            return None

        kept, kinds, starts, stops, heads, metas, extra, extra_at = [], [], [], [], [], {}, [], len(arena)
        sizes = np.ascontiguousarray(arena[begin[files][:, None] + np.arange(140, 144)]).view("<u4")[:, 0]
        for i, a, z, size in zip(files.tolist(), begin[files].tolist(), end[files].tolist(), sizes.tolist(), strict=True):
            body = a + 144 + size
            if body > z or data[body : min(body + 2, z)] == b"\x02\0" or (head := self._head(data[a + 132 : body])) is None:
                continue
            kind = head[0]
            if kind == "deflated-le":
                engine = zlib.decompressobj(-15)
                try:
                    inflated = engine.decompress(data[body:z], INFLATED)
                except zlib.error:
                    continue
                if engine.unconsumed_tail or len(inflated) > LONGEST:
                    continue
                extra.append(inflated)
                body, z = extra_at, extra_at + len(inflated)
                extra_at = z
            kept.append(i)
            kinds.append(kind)
            starts.append(body)
            stops.append(z)
            heads.append(metas.setdefault(id(head), (len(metas), head))[0])
        if not kept:
            return None
        if extra:
            arena = np.concatenate([arena, np.frombuffer(b"".join(extra), np.uint8)])
        kept, kinds, starts, stops = np.array(kept), np.array(kinds), np.array(starts), np.array(stops)
        # offsets count from the file's first byte, or from the inflated data set's
        zero = np.where(kinds == "deflated-le", starts, begin[kept])
        plain, parts = np.ones(len(kept), bool), []
        for names, explicit, little in ((("implicit-le",), False, True), (("explicit-le", "deflated-le"), True, True), (("explicit-be",), True, False)):
            own = np.flatnonzero(np.isin(kinds, names))
            parts += self._walk(arena, own, starts, stops, explicit, little, plain)
        if not plain.any():
            return None
        names = ("own", "step", "start", "tag", "vr", "length", "value", "little")
        columns = dict(zip(names, (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)) if parts else {n: np.zeros(0, np.int64) for n in names}
        mine = plain[columns["own"]] if parts else np.zeros(0, bool)
        columns = {n: c[mine] for n, c in columns.items()}
        counts = np.bincount(columns["own"], minlength=len(kept))
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.empty(len(mine[mine]), np.int64)
        at[ends[columns["own"]] + columns["step"]] = np.arange(len(at))
        columns = {n: c[at] for n, c in columns.items()}
        tags = pa.array(columns["tag"].astype(np.uint32)).dictionary_encode()
        vrs = pa.array(columns["vr"].astype(np.uint32)).dictionary_encode()
        tag = pa.array([f"{t:08X}" for t in tags.dictionary.to_pylist()], pa.string()).take(tags.indices)
        vr = pa.array([chr(v >> 8) + chr(v & 255) for v in vrs.dictionary.to_pylist()], pa.string()).take(vrs.indices)
        ends = np.concatenate([[0], np.cumsum(counts[plain])])
        return Plain(kept[plain], [h[1:] for _, h in metas.values()], np.array(heads)[plain], ends, arena, columns["step"], tag, vr, columns["length"], columns["start"] - zero[columns["own"]], columns["little"].astype(bool), columns["value"])

    def _walk(self, arena: np.ndarray, own: np.ndarray, starts: np.ndarray, stops: np.ndarray, explicit: bool, little: bool, plain: np.ndarray) -> list[tuple]:
        """Elements of the files ``own``, a tuple of columns a step; takes files that are not plain out of ``plain``."""
        at, end, last, parts, step = starts[own], stops[own], np.full(len(own), -1, np.int64), [], 0
        kind = "<" if little else ">"
        while True:
            more = at < end
            own, at, end, last = own[more], at[more], end[more], last[more]
            if not len(own):
                return parts
            if len(own) < FEWEST:
                plain[own] = False
                return parts
            fine = at + 8 <= end
            head = arena[np.where(fine, at, 0)[:, None] + np.arange(8)]
            halves = head[:, :4].view(kind + "u2").astype(np.int64)
            tag = halves[:, 0] << 16 | halves[:, 1]
            fine &= (tag > last) & (halves[:, 0] % 2 == 0) & (halves[:, 0] != _ITEMS) & (halves[:, 1] != 0) & (tag != _CHARSET)
            size = np.full(len(own), 8, np.int64)
            if explicit:
                vr = head[:, 4].astype(np.int64) << 8 | head[:, 5]
                form = _FORMS[vr]
                length = np.ascontiguousarray(head[:, 6:]).view(kind + "u2")[:, 0].astype(np.int64)
                long = form == _LONG
                if long.any():
                    fine &= ~long | ((length == 0) & (at + 12 <= end))
                    wide = np.flatnonzero(long & fine)
                    length[wide] = arena[at[wide][:, None] + np.arange(8, 12)].view(kind + "u4")[:, 0]
                    size[long] = 12
                fine &= (form != 0) & (length % 2 == 0)
            else:
                vr = np.zeros(len(own), np.int64)
                length = np.ascontiguousarray(head[:, 4:]).view(kind + "u4")[:, 0].astype(np.int64)
            value = at + size
            fine &= (length != UNDEFINED) & (value + length <= end)
            known = pa.array(np.where(fine, tag, -1)).dictionary_encode()
            read = np.array([0 if t < 0 else self._vr(t, explicit) for t in known.dictionary.to_pylist()], np.int64)[known.indices.to_numpy()]
            if explicit:
                fine &= (read == 0) | (read == vr)
            else:
                fine &= read != _code("SQ")
                vr = read
            plain[own[~fine]] = False
            own, at, end, tag, vr, length, value = own[fine], at[fine], end[fine], tag[fine], vr[fine], length[fine], value[fine]
            parts.append((own, np.full(len(own), step), at, tag, vr, length, value, np.full(len(own), little)))
            at, last, step = value + length, tag, step + 1
