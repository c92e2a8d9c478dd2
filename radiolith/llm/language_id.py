"""Language identification with string kernels.

The kernel of two texts is the blended spectrum presence kernel: the number of byte n-grams of 1 to ``MAX_N``
bytes that occur in both, over the geometric mean of the numbers that occur in each. Nyström landmarks are
whole labelled texts; one-versus-rest kernel ridge regression is solved on them, and texts are scored by
matrix products of blocks of presence rows with the landmarks' rows. The rows have a column for each n-gram of
a landmark, so the kernel is exact.

The model is fitted on a bounded sample: at most ``per_label`` rows of each label and ``most`` rows in
all, those of the smallest hashes. It is the sample's size that is bounded; texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trim

MAX_N = 4
_ASCII_LETTER = re.compile(r"[A-Za-z]")
BLOCK = 32


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is a letter by Unicode's general category."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """The n-grams in ``text``, ascending: ``n`` in the upper half of a 64-bit number, the bytes in the lower."""
    data = np.frombuffer(" ".join(text.lower().split()).encode(), dtype=np.uint8).astype(np.uint32)
    grams, found = data, []
    for n in range(1, min(MAX_N, len(data)) + 1):
        if n > 1:
            grams = (grams[:-1] << np.uint32(8)) | data[n - 1 :]
        found.append(np.unique(grams).astype(np.uint64) | np.uint64(n << 32))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


class Model:
    """Landmarks and regression weights. ``labels`` may be empty: nothing was there to learn from."""

    def __init__(self, labels: list[str], active: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        self.labels, self.active, self.rows, self.weights = labels, active, rows, weights

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        x = np.zeros((len(texts), len(self.active)), dtype=np.float32)
        norm = np.ones(len(texts), dtype=np.float32)
        for i, t in enumerate(texts):
            found = presence(t)
            norm[i] = max(1, len(found)) ** 0.5
            if len(self.active):
                slot = np.minimum(np.searchsorted(self.active, found), len(self.active) - 1)
                x[i, slot[self.active[slot] == found]] = 1
        return (x @ self.rows) / norm[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and winning score, held to 0 to 1, of each text; ``und`` and 0 for null, without a letter or a label learned."""
        label, score = ["und"] * len(texts), [0.0] * len(texts)
        fit_for = [i for i, t in enumerate(texts) if self.labels and t is not None and has_letter(t)]
        if fit_for:
            s = self.scores([texts[i] for i in fit_for])
            for i, k, v in zip(fit_for, s.argmax(axis=1).tolist(), s.max(axis=1).tolist(), strict=True):
                label[i], score[i] = self.labels[k], min(1.0, max(0.0, v))
        return label, score


def fit(texts: list[str], labels: list[str], landmarks: int = 48, ridge: float = 1e-3) -> Model:
    """Nyström kernel ridge regression on the rows given; landmarks are taken in turn from each label."""
    names = sorted(set(labels))
    by_label = {x: [i for i, y in enumerate(labels) if y == x] for x in names}
    turns = [by_label[x][k] for k in range(max(map(len, by_label.values()), default=0)) for x in names if k < len(by_label[x])]
    marks = turns[: max(landmarks, len(names))]
    found = [presence(texts[i]) for i in marks]
    active = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
    rows = np.zeros((len(active), len(marks)), dtype=np.float32)
    for j, f in enumerate(found):
        rows[np.searchsorted(active, f), j] = 1 / max(1, len(f)) ** 0.5
    model = Model(names, active, rows, np.zeros((len(marks), len(names)), dtype=np.float32))
    if not marks:
        return model
    knm = np.concatenate([model.kernel(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)]).astype(np.float64)
    kmm = knm[marks]
    y = np.array([[x == name for name in names] for x in labels], dtype=np.float64)
    balance = 1 / y.sum(axis=0)[y.argmax(axis=1)]  # labels count alike
    a = (knm * balance[:, None]).T @ knm + ridge * kmm + 1e-9 * np.eye(len(marks))
    model.weights = np.linalg.solve(a, (knm * balance[:, None]).T @ y).astype(np.float32)
    return model


def learn(labelled: DataFrame, per_label: int = 192, most: int = 1536, landmarks: int = 48) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``: rows with null text or label are passed over.

    The sample is drawn on ids and labels alone; then only its texts reach the driver.
    """
    known = labelled.where("text is not null and lang is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("x", "doc_id"))
    drawn = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("x")).withColumn("rn", rank).where(F.col("rn") <= per_label)
    ids = [r["doc_id"] for r in drawn.orderBy("rn", "lang").limit(most).collect()]
    rows = known.where(F.col("doc_id").isin(ids)).select("doc_id", "text", "lang").limit(2 * most).collect() if ids else []
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in rows if has_letter(r["text"]))
    order = np.random.default_rng(0).permutation(len(rows)).tolist()
    return fit([rows[i][2] for i in order], [rows[i][1] for i in order], landmarks)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row; ``score`` is the winning regression value, held to 0 to 1.

    ``und`` with score 0 for null texts, texts without a letter, and without a label learned. Equal texts get equal
    results, ties go to the label first in order, ids may be null, texts of any length count whole. Other columns
    are not read. An empty table gives no rows.
    """
    held = _held(docs, model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                pred, score = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score, type=pa.float64())], schema=schema)
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _held(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((model.labels, model.active, model.rows, model.weights))


def relabel(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with ``lang_col`` replaced by the label predicted: see :func:`classify`. All columns are kept."""
    held, text, lang = _held(docs, model), docs.columns.index(text_col), docs.columns.index(lang_col)
    docs = docs.withColumn(lang_col, F.col(lang_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                pred, _ = own.predict(part.column(text).to_pylist())
                columns = [pa.array(pred) if i == lang else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        trim()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: remainder 2 of the CRC-32 of its id's text by 4. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(doc_id, text, lang)`` that may be learned from."""
    return rows.where(~held_out() & F.col("doc_id").isNotNull())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learns from the rows that are not held out, then classifies all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = learn(learnable(rows))
    return classify(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
