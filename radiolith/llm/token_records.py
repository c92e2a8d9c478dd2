"""Token ids as length-delimited binary records with a separate offset index.

A record is framed as: length of the payload (8 bytes, little-endian), masked CRC-32 of those 8 bytes,
payload, masked CRC-32 of the payload (the CRC of zlib, rotated and shifted so that checksums of data that
hold checksums stay sound). The payload starts with ``HEADER``: the document's id, whether it
has one, the width of an id in bytes (2 if the vocabulary fits, else 4) and the number of ids; the ids
follow. An index file beside each data file holds the 8-byte offset of each record, so that a shuffled
reader can take any record with one range read. Files are in ascending order of ids, and so are the
records in each.

Every task writes files of names of its own; only files named by the manifest, a table that is written by
Spark's commit protocol, count. A lost executor or a second attempt leaves at most an unnamed file.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, filesystem, materialize, scratch, shuffle_width, trim

HEADER = "<q?BQ"
FILE_BYTES = 64 << 20
CACHE = 400_000

_MASK = 0xA282EAD8


def masked(crc: int) -> int:
    """The stored form of a checksum, so that checksums of checksums stay sound."""
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def records(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Payloads of a stream of records; a broken length or checksum raises ``ValueError``."""
    while head := read(12):
        if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(zlib.crc32(head[:8])):
            raise ValueError("broken record length")
        (size,) = struct.unpack_from("<Q", head)
        body = read(size + 4)
        if len(body) < size + 4 or struct.unpack_from("<I", body, size)[0] != masked(zlib.crc32(body[:size])):
            raise ValueError("broken record")
        yield body[:size]


#: The steps before the model of a vocabulary that can be used word by word.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_END = "</w>"


def takes_words(config: dict) -> bool:
    """Whether a tokenizer normalizes and splits as stated above, ends words by ``WORD_END`` and has marked added tokens only."""
    normal, split, model = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}, config["model"]
    steps = split.get("pretokenizers") or [{}]
    return (
        normal.get("type") == "Sequence" and tuple(normal["normalizers"]) == NORMALIZERS
        and split.get("type") == "Sequence" and steps[0] == SPLIT and [x["type"] for x in steps[1:]] == ["ByteLevel"]
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["dropout"]
        and all(x["content"].startswith("<|") for x in config["added_tokens"])
    )


class Encoder:
    """Ids of whole texts, by a vocabulary file of the ``tokenizers`` library.

    A tokenizer that :func:`takes_words` takes no account of what lies beyond white space. So a text is split at spaces and line
    feeds, and the ids of frequent pieces are kept: two generations of ``CACHE`` pieces at most. Others get whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_words = takes_words(json.loads(self.tokenizer.to_str()))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece. Pieces of letters alone are encoded as one text, and told apart by the tokens that end a word."""
        new, words = {}, [p for p in pieces if p.isalpha()]
        if words and self.ends.any():
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(words) and stops[-1] == len(ids):
                raw, size = ids.tobytes(), self.kind.itemsize
                new = {p: raw[a * size : b * size] for p, a, b in zip(words, [0, *stops], stops, strict=False)}
        pieces = [p for p in pieces if p not in new]
        for p, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            new[p] = np.array(e.ids, dtype=self.kind).tobytes()
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        if not self.by_words:
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = []
        for t in texts:
            if "<|" in t:  # a special token may hold white space or stand against a word
                split.append(None)
                continue
            if t.isascii() or ("Σ" not in t and "İ" not in t and unicodedata.is_normalized("NFC", t)):
                t = t.lower()  # as the tokenizer does, letter by letter
            split.append(t.replace("\n", " ").split(" "))
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing: dict[str, tuple[str, str]] = {}
        learn: dict[str, None] = {}
        for p in set().union(*filter(None, split)).difference(known):
            if p in older:
                known[p] = older[p]
            else:
                marked = p[-1:] in (",", ".", ";", ":", "!", "?") and p[:-1].isalpha()  # letters and one mark are always apart
                missing[p] = (p[:-1], p[-1]) if marked else (p, "")
        for x in (x for pair in missing.values() for x in pair):
            if x not in known:
                if x in older:
                    known[x] = older[x]
                else:
                    learn[x] = None
        if learn:
            known.update(self._learn(list(learn)))
        for p, (a, b) in missing.items():
            if b:
                known[p] = known[a] + known[b]
        get = self.known.__getitem__
        out = []
        for t, pieces in zip(texts, split, strict=True):
            if pieces is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=self.kind).tobytes())
            else:
                out.append(b"".join(map(get, pieces)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_MANIFEST = pa.schema([("pid", pa.int32()), ("seq", pa.int64()), ("path", pa.string()), ("index", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("tokens", pa.int64())])


class _File:
    def __init__(self, fs, root: str, pid: int) -> None:
        name = f"{root}/part-{pid:05d}-{uuid.uuid4().hex}"
        self.path, self.index = f"{name}.records", f"{name}.index"
        self.fs, self.sink, self.offsets, self.size, self.tokens = fs, fs.open_output_stream(self.path), [], 0, 0

    def add(self, payload: bytes, tokens: int) -> None:
        self.offsets.append(self.size)
        data = frame(payload)
        self.sink.write(data)
        self.size += len(data)
        self.tokens += tokens

    def close(self) -> tuple:
        self.sink.close()
        with self.fs.open_output_stream(self.index) as out:
            out.write(np.array(self.offsets, dtype="<u8").tobytes())
        return self.path, self.index, self.size, len(self.offsets), self.tokens


def write_records(docs: DataFrame, vocabulary: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token-id records of ``docs`` below the folder ``out`` and return the manifest, one row a file in order.

    Order is by id, nulls first, then by XXH64 of the text and by text, so that equal ids have a defined order too.
    """
    spark = docs.sparkSession
    out = out or scratch(spark, "records")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        enc, file, done = encoder(vocabulary), None, []
        end = np.array([end_id], dtype=enc.kind).tobytes()
        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < 1 << 20:
                    size += len(texts[to])
                    to += 1
                for doc, raw in zip(ids[at:to], enc.encode(texts[at:to]), strict=True):
                    file = file or _File(fs, root, pid)
                    n = len(raw) // enc.kind.itemsize + 1
                    file.add(struct.pack(HEADER, doc or 0, doc is not None, enc.kind.itemsize, n) + raw + end, n)
                    if file.size >= FILE_BYTES:
                        done.append(file.close())
                        file = None
                at = to
        if file:
            done.append(file.close())
        trim()
        yield batch(_MANIFEST, [[pid] * len(done), list(range(len(done))), *([x[i] for x in done] for i in range(5))])

    rows = docs.repartitionByRange(shuffle_width(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return materialize(rows.mapInArrow(run, "pid int, seq long, path string, index string, bytes long, records long, tokens long"), "records-manifest")


def read_records(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each record, read from the files; ``start`` counts the ids of all earlier records.

    The window over the manifest has one row for each 64 MB of records, or each task that wrote fewer.
    """
    before = F.sum("tokens").over(Window.orderBy("pid", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0))).select("path", "before")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(out)
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[list] = [[], [], [], []]
                with fs.open_input_stream(path) as source:
                    for payload in records(source.read):
                        doc, has, width, n = struct.unpack_from(HEADER, payload)
                        ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(HEADER))
                        for col, v in zip(rows, (doc if has else None, start, n, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(v)
                        start += n
                        if len(rows[0]) >= 10_000:
                            yield batch(schema, rows)
                            rows = [[], [], [], []]
                yield batch(schema, rows)

    return files.repartition(shuffle_width(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the records of ``docs`` and return, from the files, ``(doc_id, start, n_tokens, ids_crc32)`` of each.

    A null or empty text is one record of the end id alone. Null ids come first; rows with equal ids are ordered by
    a hash of the text, and equal rows give equal rows but for ``start``. Texts are encoded whole. Other columns are not read. An empty table gives no rows.
    """
    out = scratch(docs.sparkSession, "records")
    return read_records(docs.sparkSession, write_records(docs, vocabulary, end_id, out, id_col, text_col), out)


def read_one(root: str, path: str, index: str, at: int) -> bytes:
    """The payload of record ``at`` of a file, by its index: one range read of each."""
    fs, _ = filesystem(root)
    with fs.open_input_file(index) as f:
        (offset,) = struct.unpack("<Q", f.read_at(8, 8 * at))
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return next(records(f.read))
