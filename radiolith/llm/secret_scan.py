"""Secrets in whole texts and in what is encoded within them.

A worklist holds layers: the text itself first. Each layer is scanned, then unwrapped: runs of URL escapes,
of Unicode, hexadecimal and HTML number escapes, base64 runs, and gzip (all members), zlib or Zstandard data under
base64 or escapes give new layers, until no layer is new. A digest of each layer's content ends cycles. A layer knows
for each of its characters the code points of the text that it comes from, so that every find is reported
as a span of the text. Decompressed text is scanned while it unfolds, in pieces of ``LAYER`` characters or
more that end between two words where no find and no encoded run can cross; without such a place a piece goes on.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # maximal runs: the same as shorter ones dropped later
HEX = re.compile(r"[0-9a-f]{16,}")
LAYER = 1 << 20
LOOK_BACK = 1 << 16

_URL = re.compile(r"[A-Za-z0-9_.~+/=:\"'%-]+")  # a maximal run: one pass, however long it is
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_PERCENT_BYTES = re.compile(rb"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r?\n[ \t]*|\\r\\n|\\n)[A-Za-z0-9+/_-]++)+={0,2}")  # a run over line breaks, or escapes for these
_PART = re.compile(r"(?<![A-Za-z0-9+/_\\-])[A-Za-z0-9+/_-]+|(?<=\\n)[A-Za-z0-9+/_-]+")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
_PACKED_TEXT = re.compile(r"\x1f\x8b\x08|\x78[\x01\x9c\xda]|\x28\xb5\x2f\xfd")
_BYTES = re.compile(r"[\x00-\xff]+")
_BETWEEN = re.compile(r"(?<=[A-Za-z0-9,.!?]) (?=[A-Za-z])")
_NOT_BEFORE = re.compile(r"[\\&%]|(?:password|passwd|secret|token|api_?key)$", re.IGNORECASE)
WRAP = 48
_HINT = re.compile(r"pass|secret|token|api", re.IGNORECASE)


def base_finds(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain finds in ``text``, in order."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Layer:
    """Decoded text; piece ``i`` begins at ``at[i]`` and comes from ``lo[i]`` to ``hi[i]`` of the root, by ``step`` characters each if it is plain."""

    text: str
    at: list[int]
    lo: list[int]
    hi: list[int]
    plain: list[bool]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Root span of the characters ``start`` to ``end``."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        lo = self.lo[first] + (start - self.at[first]) * self.plain[first]
        hi = self.lo[last] + (end - self.at[last]) if self.plain[last] else self.hi[last]
        return lo, hi


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(c < 32 and c not in (9, 10, 13) for c in raw)
    return text if text and odd * 20 <= len(raw) else None


def _wide(raw: bytes) -> str | None:
    """The text of 16-bit characters of which most are below 256."""
    for first, kind in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(raw) >= 24 and raw[first::2].count(0) * 4 > len(raw):
            return raw[: len(raw) // 2 * 2].decode(kind, errors="replace")
    return None


def _inflated(raw: bytes) -> Iterator[bytes]:
    """What gzip, zlib or Zstandard data hold, all members of it, up to where they break off."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0):
        try:
            while raw:
                engine, source = zlib.decompressobj(47), raw
                while not engine.eof:
                    piece = engine.decompress(source, LAYER)
                    source = engine.unconsumed_tail
                    if piece:
                        yield piece
                    elif not source:
                        return
                raw = engine.unused_data if engine.unused_data[:2] == b"\x1f\x8b" else b""
        except zlib.error:
            return
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        import io

        import zstandard

        try:
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(io.BytesIO(raw), read_across_frames=True) as f:
                while piece := f.read(LAYER):
                    yield piece
        except zstandard.ZstdError:
            return


def _end_of_piece(text: str) -> int:
    """The last place near the end that neither a find nor an encoded run can cross, whatever follows; 0 without one."""
    for m in reversed(list(_BETWEEN.finditer(text, max(1, len(text) - LOOK_BACK)))):
        word = text[max(text.rfind(c, 0, m.start()) for c in " \t\r\n") + 1 : m.start()]
        if not _NOT_BEFORE.search(word):
            return m.start()
    return 0


def _unfold(raw: bytes) -> Iterator[str]:
    """The text of compressed data in pieces."""
    read, held, least = codecs.getincrementaldecoder("utf-8")("replace"), "", LAYER
    for piece in _inflated(raw):
        held += read.decode(piece)
        if len(held) >= least:
            at = _end_of_piece(held)
            if at:
                yield held[:at]
                held = held[at:]
            least = max(LAYER, 2 * len(held))
    held += read.decode(b"", True)
    if held:
        yield held


def _whole(layer: Layer, start: int, end: int, text: str) -> Layer:
    lo, hi = layer.span(start, end)
    return Layer(text, [0], [lo], [hi], [False])


def _joined(layer: Layer, start: int, pieces: list[tuple[int, int, str, bool]]) -> Layer:
    """A layer of pieces ``(start, end, decoded, plain)`` of ``layer``."""
    at, lo, hi, plain, texts, size = [], [], [], [], [], 0
    for a, b, s, same in pieces:
        if not s:
            continue
        if same:  # as fine as the layer itself
            for i in range(bisect_right(layer.at, a) - 1, bisect_right(layer.at, b - 1)):
                u, v = max(a, layer.at[i]), min(b, layer.at[i + 1]) if i + 1 < len(layer.at) else b
                x, y = layer.span(u, v)
                at.append(size + u - a)
                lo.append(x)
                hi.append(y)
                plain.append(layer.plain[i])
            texts.append(s)
            size += len(s)
            continue
        x, y = layer.span(a, b)
        at.append(size)
        lo.append(x)
        hi.append(y)
        plain.append(False)
        texts.append(s)
        size += len(s)
    return Layer("".join(texts), at, lo, hi, plain)


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    s = layer.text
    for m in _URL.finditer(s):
        if "%" not in m.group() or not _PERCENT.search(m.group()):
            continue
        pieces, i = [], m.start()
        while i < m.end():
            j = i
            if _PERCENT.match(s, i, m.end()):
                raw = bytearray()
                while _PERCENT.match(s, j, m.end()):
                    raw.append(int(s[j + 1 : j + 3], 16))
                    j += 3
                if all(c < 0x80 for c in raw):
                    pieces += [(i + 3 * k, i + 3 * k + 3, chr(c), False) for k, c in enumerate(raw)]
                elif (text := _readable(bytes(raw))) is not None:
                    pieces.append((i, j, text, False))
                else:
                    pieces.append((i, j, s[i:j], True))
            else:
                found = _PERCENT.search(s, i, m.end())
                j = found.start() if found else m.end()
                pieces.append((i, j, s[i:j], True))
            i = j
        new = _joined(layer, m.start(), pieces)
        if new.text and new.text != m.group():
            yield new
        for run in {m.group(), m.group().replace("+", " ")}:
            raw = _PERCENT_BYTES.sub(lambda x: bytes([int(x.group()[1:], 16)]), run.encode())
            for packed in _PACKED.finditer(raw):
                yield from (_whole(layer, m.start(), m.end(), t) for t in _unfold(raw[packed.start() :]))


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The whole layer without its escapes: what they are part of may begin and end far from them."""
    s = layer.text
    if "\\" not in s and "&#" not in s:
        return
    pieces, i = [], 0
    for m in _ESCAPE.finditer(s):
        digits = m.group().strip("\\&#;{}uUxX").strip("{}")
        code = int(digits, 10 if m.group().startswith("&#") and m.group()[2] not in "xX" else 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        pieces += [(i, m.start(), s[i : m.start()], True), (m.start(), m.end(), chr(code), False)]
        i = m.end()
    if pieces:
        yield _joined(layer, 0, [*pieces, (i, len(s), s[i:], True)])


def _packed_text(layer: Layer) -> Iterator[Layer]:
    """Compressed data whose bytes escapes have given as characters."""
    for m in _PACKED_TEXT.finditer(layer.text):
        run = _BYTES.match(layer.text, m.start())
        yield from (_whole(layer, m.start(), run.end(), t) for t in _unfold(run.group().encode("latin-1")))


def _decoded(layer: Layer, at: list[int] | range, end: int) -> tuple[bool, list[tuple[int, Layer]]]:
    """What the base64 digits at the places ``at`` of a layer decode to, each with its first place; whether it is all of them.

    If they are not one text or one compressed stream from the first digit, all four alignments are tried: stretches of
    text, and compressed data from wherever it can begin; other bytes before or after do not matter.
    """
    s = layer.text
    body = (s[at[0] : at[-1] + 1] if isinstance(at, range) else "".join([s[i] for i in at])).replace("-", "+").replace("_", "/")

    def text_at(text: str, skip: int, first: int) -> tuple[int, Layer]:  # character i comes from two of the digits
        ends = []
        for i in range(first, first + len(text)):
            lo, hi = skip + i * 4 // 3, skip + -(-(i + 1) * 4 // 3) - 1
            ends.append(layer.span(at[lo], at[hi] + 1))
        return at[skip + first * 4 // 3], Layer(text, list(range(len(text))), [x for x, _ in ends], [y for _, y in ends], [False] * len(text))

    out: list[tuple[int, Layer]] = []
    for skip in range(4):
        own = body[skip:]
        own = own[: len(own) - (len(own) % 4 == 1)]
        if not own:
            break
        raw = binascii.a2b_base64(own + "=" * (-len(own) % 4))
        if not skip and len(own) == len(body):
            if (text := _readable(raw)) is not None:
                return True, [text_at(text, 0, 0) if text.isascii() else (at[0], _whole(layer, at[0], end, text))]
            if pieces := [(at[0], _whole(layer, at[0], end, p)) for p in _unfold(raw)]:
                return True, pieces
            if (text := _wide(raw)) is not None:
                return True, [(at[0], _whole(layer, at[0], end, text))]
        out += [text_at(m.group().decode(), skip, m.start()) for m in _STRETCH.finditer(raw)]
        for m in _PACKED.finditer(raw):
            first = at[skip + m.start() * 4 // 3]
            out += [(first, _whole(layer, first, end, p)) for p in _unfold(raw[m.start() :])]
    return False, out


def _base64(layer: Layer) -> Iterator[Layer]:
    s, done = layer.text, []
    for m in _LINES.finditer(s):
        parts = [x.span() for x in _PART.finditer(s, m.start(), m.end())]
        at = [i for a, b in parts for i in range(a, b)]
        if len(at) < 16 or len(parts) < 2:
            continue
        _, found = _decoded(layer, at, m.end())
        yield from (x for _, x in found)
        sizes = [b - a for a, b in parts]
        if found and sizes[-2] >= WRAP and len(set(sizes[1:-1])) <= 1 and sizes[-1] <= sizes[-2]:  # lines of one value, not a value a line
            done.append((min(i for i, _ in found), m.end()))
    i = 0
    for m in _BASE64.finditer(s):
        while i < len(done) and done[i][1] < m.end():
            i += 1
        if i < len(done) and done[i][0] <= m.start():
            continue
        yield from (x for _, x in _decoded(layer, range(m.start(), m.start() + len(m.group().rstrip("="))), m.end())[1])


def _inner_runs(layer: Layer) -> Iterator[Layer]:
    yield from _url(layer)
    yield from _escapes(layer)
    yield from _packed_text(layer)
    yield from _base64(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(plain finds, all finds)`` of one text as ``(start, kind, end)`` in code points, in order, none twice."""
    plain = base_finds(text)
    every = set(plain)
    root = Layer(text, [0], [0], [len(text)], [True])
    seen, work = {hashlib.blake2b(text.encode(), digest_size=16).digest()}, list(_inner_runs(root))
    while work:
        layer = work.pop()
        digest = hashlib.blake2b(f"{layer.lo[0]}:{layer.hi[-1]}:{layer.text}".encode(errors="replace"), digest_size=16).digest() if layer.text else None
        if digest is None or digest in seen:
            continue
        seen.add(digest)
        for start, kind, end in base_finds(layer.text):
            lo, hi = layer.span(start, end)
            every.add((lo, kind, hi))
        work += _inner_runs(layer)
    return plain, sorted(every)


def _named(finds: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in finds)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, finds)`` of each row.

    The counts and the digest are of the plain finds; ``spans`` names all finds as ``kind:start:end``, by start, then
    kind, then end, and ``finds`` holds them as structs with ``decoded`` for those from a decoded layer only. A null
    text counts as empty; ids may be null; equal rows give equal rows; other columns are not read; an empty table
    gives no rows.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
        + [("finds", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("decoded", pa.bool_())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                plain, every = scan(text)
                kinds, own = [k for _, k, _ in plain], set(plain)
                values = (doc, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_named(plain).encode()).hexdigest(), _named(every), [{"kind": KINDS[k], "start": a, "end": e, "decoded": (a, k, e) not in own} for a, k, e in every])
                for col, v in zip(out, values, strict=True):
                    col.append(v)
            yield batch(schema, out)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, finds array<struct<kind:string,start:long,end:long,decoded:boolean>>"
    )
