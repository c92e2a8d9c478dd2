"""Part 10 bytes to element rows, one file at a time: the only place where bytes are walked in Python.

A data set is read in one pass. Nested items become rows with a path; a repeated tag keeps its first place and its
last value. Deviations that can be read over are warnings; others end the file with a :class:`PartError`.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from radiolith.functions.charset import LABELS, WITHHELD
from radiolith.functions.values import KNOWN_VRS, LONG_FORM_VRS
from radiolith.operators import dictionary as D
from radiolith.operators.profiles import Profile

UNDEFINED = 0xFFFFFFFF
DEPTH = 64
INFLATED = 256 << 20
META = {"00020000": "group_length", "00020001": "version", "00020002": "media_storage_sop_class_uid", "00020003": "media_storage_sop_instance_uid", "00020010": "transfer_syntax_uid", "00020012": "implementation_class_uid", "00020013": "implementation_version_name", "00020016": "source_application_entity_title"}


class PartError(ValueError):
    """A file that cannot be read on: what, where, in which coordinates, and the bytes there."""

    def __init__(self, code: str, offset: int, frame: str, snippet: bytes, what: str) -> None:
        super().__init__(f"{code} at {offset} of {frame}: {what}")
        self.code, self.offset, self.frame, self.snippet, self.what = code, offset, frame, snippet[:16].hex(), what


@dataclass(slots=True)
class Element:
    tag: str
    vr: str
    length: int
    offset: int
    raw: bytes
    little: bool
    charset: tuple[str, ...]
    creator: str | None = None
    promoted: bool = False
    full_span: bool = False
    items: list[dict[str, Element]] | None = None


@dataclass
class Parsed:
    meta: dict = field(default_factory=dict)
    residue: list[tuple[str, str, bytes]] = field(default_factory=list)
    had_preamble: bool = True
    data: dict[str, Element] = field(default_factory=dict)
    warnings: list[tuple] = field(default_factory=list)


_STRUCTS = {little: tuple(struct.Struct(("<" if little else ">") + x) for x in ("H", "HH", "I")) for little in (True, False)}
_LONG, _KNOWN = frozenset(LONG_FORM_VRS), frozenset(KNOWN_VRS)


class _View:
    """Bytes with their coordinates and byte order."""

    __slots__ = ("data", "deflated", "frame", "h", "hh", "i", "little")

    def __init__(self, data: bytes, frame: str, little: bool = True, deflated: bool = False) -> None:
        self.data, self.frame, self.little, self.deflated = data, frame, little, deflated
        self.h, self.hh, self.i = _STRUCTS[little]

    def fail(self, at: int, what: str, code: str = "INVALID_DATASET") -> PartError:
        return PartError(code, at, self.frame, self.data[at : at + 16], what)


class Parser:
    """Reads one file. ``profile`` names private representations, and what to drop or to make fatal."""

    def __init__(self, profile: Profile | None = None, strict: bool = False, preamble: str = "auto", vrs: dict[str, str] | None = None) -> None:
        self.profile, self.strict, self.preamble = profile, strict, preamble
        self.vrs = vrs or D.vr_of()
        self.families = [(p, v) for p, v, _ in D.family_rows()]
        self.out, self.depth = Parsed(), 0
        self.seen: dict[bool, dict[bytes, tuple[int, int, str]]] = {True: {}, False: {}}

    def _tag(self, view: _View, at: int) -> tuple[int, int, str]:
        """Group, element and name of the tag at a place; each is made once."""
        seen, key = self.seen[view.little], view.data[at : at + 4]
        if (known := seen.get(key)) is None:
            if len(seen) > 65536:
                seen.clear()
            group, element = view.hh.unpack(key)
            known = seen[key] = group, element, f"{group:04X}{element:04X}"
        return known

    def warn(self, view: _View, code: str, at: int, tag: str | None = None, vr: str | None = None, meta: bool = False) -> None:
        if self.strict or (self.profile and code in self.profile.escalate):
            raise _Escalated(code, at, view.frame, view.data[at : at + 16], "a warning that is an error here")
        if not (self.profile and code in self.profile.suppress):
            self.out.warnings.append((code, tag, vr, at, meta, view.deflated))

    def parse(self, data: bytes) -> Parsed:
        self.out, self.depth = Parsed(), 0
        view = _View(data, "input")
        if not data:
            raise view.fail(0, "no bytes", "EMPTY_INPUT")
        at = 0
        if data[128:132] == b"DICM":
            at = 132
        elif self.preamble == "require" or not (data[:8] == b"\x02\0\0\0UL\x04\0" and len(data) >= 12):
            raise view.fail(0, "no preamble", "NOT_PART10")
        else:
            self.out.had_preamble = False
            self.warn(view, "MISSING_PREAMBLE", 0)
        at = self._meta(view, at)
        kind = D.TRANSFER_SYNTAXES.get(self.out.meta["transfer_syntax_uid"])
        if kind is None:
            raise view.fail(at, "this transfer syntax is not read", "UNSUPPORTED_TRANSFER_SYNTAX")
        if kind == "deflated-le":
            engine = zlib.decompressobj(-15)
            try:
                data = engine.decompress(data[at:], INFLATED)
            except zlib.error as e:
                raise view.fail(at, "the deflated data set is broken") from e
            if engine.unconsumed_tail:
                raise view.fail(at, "the inflated data set is too long")
            view, at = _View(data, "inflated-dataset", deflated=True), 0
        elif kind == "explicit-be":
            view = _View(data, "input", little=False)
        try:
            self.out.data, _ = self._data_set(view, at, len(view.data), kind != "implicit-le", (), False)
        except RecursionError as e:
            raise view.fail(at, "nested too deeply") from e
        return self.out

    # file meta

    def _meta_element(self, view: _View, at: int) -> tuple[str, str, bytes, int]:
        d = view.data
        if at + 8 > len(d):
            raise view.fail(at, "file meta is cut off")
        tag = self._tag(view, at)[2]
        vr = d[at + 4 : at + 6].decode("latin1")
        size = 8
        if vr in _LONG:
            if at + 12 > len(d):
                raise view.fail(at, "file meta is cut off")
            size, (n,) = 12, view.i.unpack_from(d, at + 8)
        else:
            (n,) = view.h.unpack_from(d, at + 6)
        if at + size + n > len(d):
            raise view.fail(at, "file meta is cut off")
        return tag, vr, d[at + size : at + size + n], at + size + n

    def _meta(self, view: _View, begin: int) -> int:
        d, found = view.data, []
        at, declared = begin, None
        if at + 2 <= len(d) and view.h.unpack_from(d, at)[0] == 2:
            tag, vr, raw, to = self._meta_element(view, at)
            if (tag, vr, len(raw)) == ("00020000", "UL", 4):
                declared, at = view.i.unpack(raw)[0], to
                if at + declared > len(d):
                    raise view.fail(begin, "the file meta length passes the end")
                self.out.meta["group_length"] = str(declared)
        if declared is None:
            self.warn(view, "FILE_META_GROUP_LENGTH_MISSING", begin, meta=True)
        first = at
        while at + 2 <= len(d) and view.h.unpack_from(d, at)[0] == 2:
            start = at
            *e, at = self._meta_element(view, at)
            found.append((*e, start))
        if declared is not None and at - first != declared:
            self.warn(view, "FILE_META_GROUP_LENGTH_MISMATCH", begin, meta=True)
        seen = {"00020000"} if declared is not None else set()
        syntax = None
        for tag, vr, raw, start in found:
            if tag not in META:
                self.out.residue.append((tag, vr, raw))
                continue
            if tag in seen:
                self.warn(view, "DUPLICATE_FILE_META_ELEMENT", start, tag, meta=True)
                continue
            seen.add(tag)
            if tag == "00020010":
                syntax = vr
            text = raw.decode("latin1")
            self.out.meta[META[tag]] = raw.hex() if tag == "00020001" else text.rstrip(" \0") if vr == "UI" else text.strip(" ").rstrip("\0")
        if syntax != "UI":
            raise view.fail(begin, "no transfer syntax", "MISSING_TRANSFER_SYNTAX")
        return at

    # data sets

    def _private_vr(self, tag: str, creators: dict) -> str | None:
        creator = creators.get((tag[:4], tag[4:6]))
        if self.profile and creator in self.profile.private:
            known = self.profile.private[creator].get(f"{tag[:4]}XX{tag[6:]}")
            return known[0] if known else None
        return None

    def _implicit_vr(self, view: _View, tag: str, creators: dict, at: int) -> str:
        if tag[3] in "13579BDF":
            if "0010" <= tag[4:] <= "00FF":
                return "LO"
            if (vr := self._private_vr(tag, creators)) is None:
                self.warn(view, "IMPLICIT_VR_FOR_PRIVATE_TAG_WITHOUT_VR", at, tag)
                return "UN"
            return vr
        if tag in self.vrs:
            return self.vrs[tag]
        if tag[4:] == "0000":
            return "UL"
        return next((v for p, v in self.families if all(a in ("x", b) for a, b in zip(p, tag, strict=True))), "UN")

    def _put(self, view: _View, data: dict[str, Element], e: Element) -> None:
        if e.tag in data:
            self.warn(view, "DUPLICATE_TAG_IN_DATA_SET", e.offset, e.tag)
        data[e.tag] = e  # a known key keeps its place

    def _data_set(self, view: _View, at: int, end: int, explicit: bool, charset: tuple[str, ...], in_item: bool) -> tuple[dict[str, Element], int]:
        d, data, creators = view.data, {}, {}
        while at < end:
            start = at
            if at + 8 > end:
                raise view.fail(start, "an element header is cut off")
            group, element, tag = self._tag(view, at)
            if group == 0xFFFE:
                if in_item and tag == "FFFEE00D":
                    return data, at + 8
                raise view.fail(start, "an item mark among elements")
            if explicit:
                vr = d[at + 4 : at + 6].decode("latin1")
                if vr in _LONG or vr not in _KNOWN:
                    if at + 12 > end:
                        raise view.fail(start, "an element header is cut off")
                    if d[at + 6 : at + 8] != b"\0\0":
                        self.warn(view, "NONZERO_RESERVED_BYTES", start, tag)
                    length, at = view.i.unpack_from(d, at + 8)[0], at + 12
                else:
                    length, at = view.h.unpack_from(d, at + 6)[0], at + 8
                if not group % 2 and self.vrs.get(tag, vr) != vr:
                    self.warn(view, "VR_MISMATCH", start, tag, vr)
                if length != UNDEFINED and length % 2:
                    self.warn(view, "ODD_LENGTH_VALUE_PADDED", start, tag)
            else:
                (length,), at = view.i.unpack_from(d, at + 4), at + 8
                vr = self._implicit_vr(view, tag, creators, start)
            e = Element(tag, vr, length, start, b"", view.little, charset)
            if group % 2 and tag[4:6] >= "10":
                own = creators.get((tag[:4], tag[4:6]))
                if own is None:
                    self.warn(view, "PRIVATE_TAG_NO_CREATOR", start, tag)
                else:
                    known = self.profile and own in self.profile.private
                    if self.profile and not known:
                        self.warn(view, "PRIVATE_CREATOR_UNKNOWN", start, tag)
                    e.creator = own if known else WITHHELD
            at = self._value(view, e, at, end, explicit, in_item)
            if tag == "00080005":
                terms = [t.strip(" ") for t in e.raw.decode("latin1").rstrip(" \0").split("\\")]
                if any(t and t not in LABELS for t in terms):
                    self.warn(view, "UNSUPPORTED_CHARSET", start, tag)
                charset = tuple(t if not t or t in LABELS else WITHHELD for t in terms)
                e.charset = charset
            elif group % 2 and "0010" <= tag[4:] <= "00FF":
                if text := e.raw.decode("latin1").strip(" \0"):
                    creators[tag[:4], tag[6:]] = text
            elif element == 0:
                self.warn(view, "GROUP_LENGTH_IN_DATASET", start, tag)
            self._put(view, data, e)
        return data, at

    def _value(self, view: _View, e: Element, at: int, end: int, explicit: bool, in_item: bool) -> int:
        """Reads an element's value from ``at`` on; returns where the next element begins."""
        d = view.data
        if e.length == UNDEFINED:
            pixel = explicit and e.tag == "7FE00010" and e.vr == "OB"
            if e.vr == "SQ" or pixel:
                if explicit and not pixel:
                    self.warn(view, "UNDEFINED_LENGTH_IN_EXPLICIT_VR", e.offset, e.tag)
                e.items, to = self._items(view, at, None, end, explicit, e.charset, pixel)
            elif e.vr == "UN":
                tried = self._try(lambda: self._items(_View(d[at:end], "value-slice", True, view.deflated), 0, None, end - at, False, e.charset, False))
                if tried is not None:
                    self.warn(view, "UN_PARSED_AS_SQ", at, e.tag)
                    e.vr, e.promoted, e.items, to = "SQ", True, tried[0], at + tried[1]
                elif explicit:
                    to = end
                else:
                    raise view.fail(e.offset, "undefined length on a value")
            else:
                raise view.fail(e.offset, "undefined length on a value")
            e.raw, e.full_span = d[e.offset : to], True
            return to
        to = at + e.length
        if e.vr == "SQ" and explicit:
            e.items, to = self._items(view, at, e.length, end, explicit, e.charset, False)
            e.raw, e.full_span = d[e.offset : to], True
            return to
        if to > end:
            raise view.fail(e.offset, "a value passes the end")
        e.raw = d[at:to]
        if e.vr == "SQ":
            tried = self._try(lambda: self._items(_View(e.raw, "value-slice", True, view.deflated), 0, e.length, e.length, False, e.charset, False))
            if tried is None:
                self.warn(view, "SQ_NOT_DESCENDED", at, e.tag)
            else:
                e.items = tried[0]
        return to

    def _try(self, read):
        """What ``read`` returns, or None with all that it changed undone."""
        depth, warned = self.depth, len(self.out.warnings)
        try:
            return read()
        except _Escalated:
            raise
        except PartError:
            self.depth = depth
            del self.out.warnings[warned:]
            return None

    def _items(self, view: _View, at: int, length: int | None, limit: int, explicit: bool, charset: tuple[str, ...], pixel: bool) -> tuple[list[dict[str, Element]], int]:
        self.depth += 1
        if self.depth > DEPTH:
            self.depth -= 1
            raise view.fail(at, "nested too deeply")
        d, items = view.data, []
        end = len(d) if length is None else at + length
        try:
            while at < min(end, max(limit, end)):
                start = at
                if at + 8 > len(d):
                    raise view.fail(start, "an item header is cut off")
                mark = view.hh.unpack_from(d, at)
                (size,), at = view.i.unpack_from(d, at + 4), at + 8
                if mark == (0xFFFE, 0xE0DD):
                    return items, at
                if mark != (0xFFFE, 0xE000):
                    raise view.fail(start, "no item where one must be")
                if size == 0:
                    self.warn(view, "EMPTY_ITEM_IN_SEQUENCE", start)
                    items.append({})
                elif pixel:
                    if at + size > len(d):
                        raise view.fail(start, "a fragment passes the end")
                    at += size
                    items.append({})
                elif size == UNDEFINED:
                    data, at = self._data_set(view, at, len(d), explicit, charset, True)
                    items.append(data)
                else:
                    if length is not None and end < len(d) and at + size > end:
                        self.warn(view, "ITEM_CROSSES_SEQUENCE_END", start)
                    if at + size > len(d):
                        raise view.fail(start, "an item passes the end")
                    inner = _View(d[at : at + size], "value-slice", view.little, view.deflated)
                    data, _ = self._data_set(inner, 0, size, explicit, charset, False)
                    items.append(data)
                    at += size
            return items, at
        finally:
            self.depth -= 1


class _Escalated(PartError):
    """A warning made fatal; speculation does not swallow it."""


def rows(data: dict[str, Element], path: str = "", out: list[dict] | None = None) -> list[dict]:
    """Element rows in order, items after their sequence; ``leave`` is the last row within a sequence."""
    out = [] if out is None else out
    for e in data.values():
        own = {"path": path, "ord": len(out), "leave": len(out), "tag": e.tag, "vr": e.vr, "length": e.length, "byte_offset": e.offset, "little_endian": e.little, "charset": list(e.charset), "private_creator": e.creator, "cp246_promoted": e.promoted, "item_count": None if e.items is None else len(e.items), "full_span": e.full_span, "raw": e.raw}
        out.append(own)
        for i, item in enumerate(e.items or ()):
            rows(item, f"{path}/{e.tag}[{i}]" if path else f"{e.tag}[{i}]", out)
        own["leave"] = len(out) - 1
    return out
