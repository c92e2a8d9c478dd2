"""Element rows back to Part 10 bytes, one object at a time: what the writer is compared with."""

from __future__ import annotations

import struct
import zlib

from radiolith.functions.values import LONG_FORM_VRS, KNOWN_VRS, NUL_PADDED
from radiolith.operators.dictionary import TRANSFER_SYNTAXES

from radiolith.sources.part10 import META, UNDEFINED
from radiolith.sources.writer import IMPLEMENTATION_UID


class SerializeError(ValueError):
    """A file that cannot be written; ``code`` says why."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def pad(raw: bytes, vr: str) -> bytes:
    return raw + (b"\0" if vr in NUL_PADDED else b" ") if len(raw) % 2 else raw


def encode_element(tag: str, vr: str, raw: bytes, kind: str, undefined: bool = False) -> bytes:
    """Header and even value. ``undefined`` writes an undefined length."""
    order = ">" if kind == "explicit-be" else "<"
    raw = pad(raw, vr)
    head = struct.pack(order + "HH", int(tag[:4], 16), int(tag[4:], 16))
    length = UNDEFINED if undefined else len(raw)
    if kind == "implicit-le":
        return head + struct.pack("<I", length) + raw
    code = vr.encode("latin1")
    if vr in LONG_FORM_VRS or vr not in KNOWN_VRS:
        return head + code + b"\0\0" + struct.pack(order + "I", length) + raw
    if len(raw) > 0xFFFF:
        raise SerializeError("VALUE_TOO_LONG")
    return head + code + struct.pack(order + "H", length) + raw


def encode_meta(meta: dict[str, str], residue: list[tuple[str, str, bytes]]) -> bytes:
    """File meta in tag order with its length; version and implementation are filled in."""
    vrs = {"00020001": "OB", "00020013": "SH", "00020016": "AE"}
    parts = [(t, vrs.get(t, "UI"), bytes.fromhex(meta[n]) if t == "00020001" else meta[n].encode("latin1")) for t, n in META.items() if n in meta and n != "group_length"]
    have = {t for t, _, _ in parts}
    if "00020001" not in have:
        parts.append(("00020001", "OB", b"\0\1"))
    if "00020012" not in have:
        parts.append(("00020012", "UI", IMPLEMENTATION_UID.encode()))
    body = b"".join(encode_element(t, v, r, "explicit-le") for t, v, r in sorted([*parts, *residue]))
    return encode_element("00020000", "UL", struct.pack("<I", len(body)), "explicit-le") + body


def by_path(rows: list[dict]) -> dict[str, list[dict]]:
    """The rows of each data set in order."""
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        out.setdefault(r["path"], []).append(r)
    return out


def encode_items(sets: dict[str, list[dict]], path: str, tag: str, count: int, kind: str) -> bytes:
    """The items of a sequence from the rows of all data sets, with defined lengths."""
    order = ">" if kind == "explicit-be" else "<"
    out = []
    for i in range(count):
        body = encode_rows(sets, f"{path}/{tag}[{i}]" if path else f"{tag}[{i}]", kind, True)
        out.append(struct.pack(order + "HHI", 0xFFFE, 0xE000, len(body)) + body)
    return b"".join(out)


def encode_rows(sets: dict[str, list[dict]], path: str, kind: str, rebuild: bool) -> bytes:
    """A data set in row order, group lengths left out. Whole spans are copied unless ``rebuild`` writes sequences from their rows."""
    out = []
    for r in sets.get(path, ()):
        if r["tag"][4:] == "0000":
            continue
        if r["vr"] == "SQ" and rebuild and r["item_count"] is not None:
            out.append(encode_element(r["tag"], "SQ", encode_items(sets, path, r["tag"], r["item_count"], kind), kind))
        elif r["full_span"] and r["raw"]:
            out.append(bytes(r["raw"]))
        else:
            out.append(encode_element(r["tag"], r["vr"], bytes(r["raw"]), kind))
    return b"".join(out)


def encode_file(meta: dict[str, str], residue: list[tuple[str, str, bytes]], rows: list[dict], rebuild: bool = False) -> bytes:
    """A whole file. ``rebuild`` for rows that were changed, so that sequences show the changes."""
    if "transfer_syntax_uid" not in meta:
        raise SerializeError("MISSING_TRANSFER_SYNTAX")
    kind = TRANSFER_SYNTAXES.get(meta["transfer_syntax_uid"])
    if kind is None:
        raise SerializeError("UNSUPPORTED_TRANSFER_SYNTAX")
    body = encode_rows(by_path(rows), "", "explicit-le" if kind == "deflated-le" else kind, rebuild)
    if kind == "deflated-le":
        engine = zlib.compressobj(wbits=-15)
        body = engine.compress(body) + engine.flush()
        body += b"\0" * (len(body) % 2)
    return b"\0" * 128 + b"DICM" + encode_meta(meta, residue) + body
