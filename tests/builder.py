"""Part 10 files built in code, with knobs for what can be wrong with them."""

from __future__ import annotations

import struct
import zlib

LONG = ("OB", "OW", "OF", "OD", "OL", "OV", "SQ", "UT", "UN", "UC", "UR", "SV", "UV")
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
UNDEFINED = 0xFFFFFFFF


def element(tag: str, vr: str, value: bytes, syntax: str = EXPLICIT, length: int | None = None, reserved: bytes = b"\0\0") -> bytes:
    order = ">" if syntax == BIG else "<"
    n = len(value) if length is None else length
    head = struct.pack(order + "HH", int(tag[:4], 16), int(tag[4:], 16))
    if syntax == IMPLICIT:
        return head + struct.pack("<I", n) + value
    if vr in LONG or not vr.isalpha() or vr == "ZZ":
        return head + vr.encode() + reserved + struct.pack(order + "I", n) + value
    return head + vr.encode() + struct.pack(order + "H", n) + value


def item(body: bytes, syntax: str = EXPLICIT, undefined: bool = False, length: int | None = None) -> bytes:
    order = ">" if syntax == BIG else "<"
    n = UNDEFINED if undefined else len(body) if length is None else length
    end = struct.pack(order + "HHI", 0xFFFE, 0xE00D, 0) if undefined else b""
    return struct.pack(order + "HHI", 0xFFFE, 0xE000, n) + body + end


def sequence(tag: str, items: list[bytes], syntax: str = EXPLICIT, undefined: bool = False, delimiter: bool = True, vr: str = "SQ") -> bytes:
    order = ">" if syntax == BIG else "<"
    body = b"".join(items)
    if undefined:
        return element(tag, vr, body + struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0) * delimiter, syntax, UNDEFINED)
    return element(tag, vr, body, syntax)


def build(body: bytes, syntax: str = EXPLICIT, preamble: bool = True, group_length: int | str | None = None, meta: bytes = b"", with_syntax: bool = True) -> bytes:
    own = element("00020010", "UI", (syntax + "\0" * (len(syntax) % 2)).encode()) if with_syntax else b""
    own += meta
    if group_length != "omit":
        own = element("00020000", "UL", struct.pack("<I", len(own) if group_length is None else group_length)) + own
    if syntax == DEFLATED:
        engine = zlib.compressobj(wbits=-15)
        body = engine.compress(body) + engine.flush()
    return (b"\0" * 128 + b"DICM") * preamble + own + body
