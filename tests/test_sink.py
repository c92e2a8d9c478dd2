"""The sink's files: all of a job or none, once each, whatever attempts there were."""

import pathlib
import pickle

import pyarrow as pa
import pytest
from builder import EXPLICIT, element
from pyspark.sql import functions as F

from radiolith.sources import reader, sink, writer

SCHEMA = "object_id string, content binary, error string"


def files_of(path):
    return sorted(p.name for p in pathlib.Path(path).glob("part-*/*"))


def left_over(path):
    return [p for p in pathlib.Path(path).rglob("*") if "_staging" in str(p)]


@pytest.fixture(scope="module")
def format_(spark):
    spark.dataSource.register(sink.Part10Sink)
    return sink.NAME


def test_objects_become_files(spark, format_, tmp_path):
    files = spark.range(50).select(F.concat(F.lit("a/b."), F.col("id").cast("string")).alias("object_id"), F.create_map(F.lit("transfer_syntax_uid"), F.when(F.col("id") % 10 == 3, "1.2").otherwise(EXPLICIT)).alias("meta"), F.array().cast("array<struct<tag:string,vr:string,value:binary>>").alias("residue"))
    rows = files.select("object_id", F.lit("").alias("path"), F.lit(0).alias("ord"), F.lit("00100010").alias("tag"), F.lit("PN").alias("vr"), F.lit(None).cast("int").alias("item_count"), F.encode(F.lit("DOE^JANE"), "UTF-8").alias("raw"))
    out = str(tmp_path / "out")
    writer.serialize(files, rows).repartition(4).write.format(format_).mode("append").save(out)
    assert files_of(out) == sorted(sink.file_name(f"a/b.{i}") for i in range(50) if i % 10 != 3) and not left_over(out)
    assert {(r.object_id, r.error) for r in spark.read.parquet(f"{out}/_errors").collect()} == {(f"a/b.{i}", "UNSUPPORTED_TRANSFER_SYNTAX") for i in range(3, 50, 10)}
    again = reader.elements(reader.read_files(spark, out, glob="*.dcm"))
    assert again.count() == 45 and {r.value for r in again.collect()} == {"DOE^JANE"}
    one = spark.createDataFrame([("x", element("00100010", "PN", b"A "), None)], SCHEMA)
    one.write.format(format_).mode("append").save(out)
    assert len(files_of(out)) == 46
    one.write.format(format_).mode("overwrite").save(out)
    assert files_of(out) == ["x.dcm"] and not (pathlib.Path(out) / "_errors").exists()


def test_a_failed_job_leaves_no_file(spark, format_, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("object_id"), F.encode(F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("x"), "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format(format_).mode("append").save(out)
    assert files_of(out) == [] and not left_over(out)


def batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(("object_id", "content", "error"), r, strict=True)) for r in rows], schema=pa.schema([("object_id", pa.string()), ("content", pa.binary()), ("error", pa.string())]))


def test_retried_and_lost_attempts_leave_no_second_copy(tmp_path):
    w = sink.Part10Writer(str(tmp_path), False)
    lost = w.write(iter([batch([("a", b"1", None)])]))  # its executor is lost after writing
    half = w.write(iter([batch([("a", b"1", None), ("b", b"2", None), ("b", b"3", None), (None, b"4", None), ("c", None, None), ("d", None, "VALUE_TOO_LONG")])]))
    empty = w.write(iter([]))
    assert lost.attempt != half.attempt and (half.files, half.errors, empty.files) == (2, 4, 0)
    w.commit([half, None, empty])
    assert files_of(tmp_path) == ["a.dcm", "b.dcm"] and not left_over(tmp_path)
    import pyarrow.parquet as pq

    assert {(r["object_id"], r["error"]) for r in pq.read_table(tmp_path / "_errors").to_pylist()} == {("b", "REPEATED_OBJECT"), (None, "NO_OBJECT_ID"), ("c", "NO_CONTENT"), ("d", "VALUE_TOO_LONG")}
    other = sink.Part10Writer(str(tmp_path), False)
    other.write(iter([batch([("z", b"1", None)])]))
    other.abort([None])
    assert files_of(tmp_path) == ["a.dcm", "b.dcm"] and not left_over(tmp_path)


def test_attempts_that_outlive_their_job_leave_nothing(tmp_path):
    w = sink.Part10Writer(str(tmp_path / "late"), False)
    late = pickle.loads(pickle.dumps(w))  # as a task has it, which starts when the job has failed
    w.abort([None])
    with pytest.raises(OSError):
        late.write(iter([batch([("a", b"1", None)])]))
    assert files_of(tmp_path / "late") == [] and not left_over(tmp_path)
    for end in (lambda w: w.abort([None]), lambda w: w.commit([None])):
        for first, last in ((("a", b"1", None), ("b", b"2", None)), (("a", None, "LOST"), ("b", None, "LOST"))):
            w = sink.Part10Writer(str(tmp_path / "half"), False)

            def rows(w=w, end=end, first=first, last=last):
                yield batch([first])
                end(pickle.loads(pickle.dumps(w)))
                yield batch([last])

            with pytest.raises(OSError):
                w.write(rows())
            assert files_of(tmp_path / "half") == [] and not left_over(tmp_path)


def test_names_stay_within_the_folder():
    names = ["../../etc/x", "a/b", "", ".", "ü\n", "A.dcm", "a%2Fb"]
    made = [sink.file_name(n) for n in names]
    assert len(set(made)) == len(names) and not any("/" in m or m.startswith(".") and m != ".dcm" for m in made)


def test_rows_that_the_sink_cannot_take(spark, format_, tmp_path):
    with pytest.raises(Exception, match="columns"):
        spark.createDataFrame([("x",)], "object_id string").write.format(format_).mode("append").save(str(tmp_path))
