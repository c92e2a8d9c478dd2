"""The last version of an element over micro-batches, against the same in one batch."""

import random

import pytest
from pyspark.sql import functions as F

from radiolith.streaming import state

SCHEMA = "object_id string, path string, tag string, vr string, version bigint, seen timestamp, raw binary, code string"


def rows_of(seed, objects):
    rng, out = random.Random(seed), []
    for o in range(objects):
        for v in range(rng.randint(1, 12)):
            minute = o * 20 + rng.randint(0, 9)
            code = "VR_MISMATCH" if rng.random() < 0.04 else "ODD_LENGTH_VALUE_PADDED" if rng.random() < 0.2 else None
            out.append((f"o{o}", rng.choice(["", "00081140[0]"]), rng.choice(["00100010", "00100020"]), "PN", v, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", rng.randbytes(3), code))
    rng.shuffle(out)
    return out


def run(spark, tmp_path, rows, batches):
    source, sink = tmp_path / "in", tmp_path / "out"
    make = lambda part: spark.createDataFrame(part, SCHEMA.replace("seen timestamp", "seen string")).withColumn("seen", F.to_timestamp("seen")).select(*[c.split()[0] for c in SCHEMA.split(", ")])
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        make(rows[i : i + size]).coalesce(1).write.mode("append").parquet(str(source))
    state.closing_row(spark, "2030-01-01 00:00:00").coalesce(1).write.mode("append").parquet(str(source))
    state.stateful(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = state.last_versions(stream, "12 hours", frozenset({"VR_MISMATCH"})).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(sink)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.schema(state.ROW).parquet(str(sink)).collect(), q


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_one_batch(spark, tmp_path, batches):
    rows = rows_of(batches, 12)
    got, q = run(spark, tmp_path, rows, batches)
    fatal = {o for o, *_, code in rows if code == "VR_MISMATCH"}
    want = {}
    for o, path, tag, _, version, _, raw, _ in rows:
        want[o, path, tag] = max(want.get((o, path, tag), (-1, b"")), (version, raw))
    assert {(r.object_id, r.path, r.tag): (r.version, bytes(r.raw), r.fate) for r in got} == {k: (*v, state.QUARANTINED if k[0] in fatal else state.KEPT) for k, v in want.items()}
    assert len(got) == len(want) and fatal


def test_an_object_costs_few_calls_to_the_state_store():
    """However many elements it has: one read and one write a micro-batch, and a timer when it is new."""
    calls = []

    class Store:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Store()

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    p = state.LastVersions(1000, frozenset({"VR_MISMATCH"}))
    p.init(Handle())
    for batch in range(3):
        rows = [{"path": "", "tag": f"0010{k:04X}", "vr": "PN", "version": batch * 100 + k, "seen_ms": k, "raw": None if k % 2 else b"a", "code": None} for k in range(100)]
        assert list(p.handleInputRows(("o",), iter(rows), None)) == []
    assert calls == ["get", "update", "timer", "get", "update", "get", "update"]
