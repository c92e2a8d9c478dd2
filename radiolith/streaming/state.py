"""Elements that arrive in pieces: the last version of each wins over all micro-batches, object by object.

An object's elements are keyed state, by data set and tag. It is given out whole once the watermark has passed its last row by a
quiet time, and its state is dropped then, so that state is bounded by the objects that are open. An object with an escalated warning is given out
as quarantined, all of it, whichever micro-batch the warning came in.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "object_id string, path string, tag string, vr string, version bigint, raw binary, fate string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT, QUARANTINED = "kept", "quarantined"


class LastVersions(StatefulProcessor):
    """State of one object, one value: when it will have been quiet for long enough, whether it is fatal, and its elements.

    An object is given out whole, so its state is read and written whole too: a call to the state store costs more than its elements do.
    """

    def __init__(self, quiet_ms: int, escalate: frozenset[str]) -> None:
        self.quiet_ms, self.escalate = quiet_ms, escalate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.object = handle.getValueState("object", "due bigint, fatal boolean, elements binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.object.get()
        before, fatal, held = (known[0], known[1], pickle.loads(bytes(known[2]))) if known is not None else (None, False, {})
        due = before if before is not None else 0
        for path, tag, vr, version, seen_ms, raw, code in ((r["path"], r["tag"], r["vr"], r["version"], r["seen_ms"], r["raw"], r["code"]) for r in rows):
            due, fatal = max(due, (seen_ms or 0) + self.quiet_ms), fatal or code in self.escalate
            old, raw = held.get((path, tag)), None if raw is None else bytes(raw)
            # of one version the larger bytes count, so that the order of rows does not
            if old is None or (version, raw or b"") > (old[1], old[2] or b""):
                held[path, tag] = (vr, version, raw)
        self.object.update((due, fatal, pickle.dumps(held, protocol=5)))
        if before is None:
            self.handle.registerTimer(due)  # put off when it expires, if rows have come since
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        due, fatal, held = self.object.get()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        self.object.clear()
        for (path, tag), (vr, version, raw) in pickle.loads(bytes(held)).items():
            yield Row(object_id=key[0], path=path, tag=tag, vr=vr, version=version, raw=raw, fate=QUARANTINED if fatal else KEPT)

    def close(self) -> None:
        pass


def last_versions(elements: DataFrame, quiet: str = "1 hour", escalate: frozenset[str] = frozenset()) -> DataFrame:
    """``(object_id, path, tag, vr, version, raw, fate)`` of a stream ``elements(object_id, path, tag, vr, version, seen, raw, code)``.

    ``version`` orders the values of one element; ``seen`` is the row's event time, and ``code`` a warning with it, if any. ``fate`` is kept, or quarantined for all of an
    object with a warning in ``escalate``. Rows that come after their object has been given out open it anew. Needs the state store of ``stateful``.
    """
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = elements.select("object_id", "path", "tag", "vr", "version", "seen", "raw", "code").withWatermark("seen", quiet).withColumn("seen_ms", F.unix_millis("seen"))
    return rows.groupBy("object_id").transformWithState(LastVersions(quiet_ms, escalate), outputStructType=ROW, outputMode="Append", timeMode="EventTime")


def stateful(spark: SparkSession) -> None:
    """Sets the state store that ``last_versions`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def closing_row(spark: SparkSession, seen: str) -> DataFrame:
    """A row that moves the watermark to ``seen``, for an input that ends: its own object stays open and is not given out."""
    row = spark.createDataFrame([("", "", "", "", 0, seen)], "object_id string, path string, tag string, vr string, version bigint, seen string")
    return row.select("object_id", "path", "tag", "vr", "version", F.to_timestamp("seen").alias("seen"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("code"))
