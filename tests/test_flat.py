"""Files that are read side by side give the rows that the parser gives one at a time, and files are written and viewed without rows that meet again."""

import random
import struct

import pyarrow as pa
from builder import BIG, DEFLATED, EXPLICIT, IMPLICIT, build, element, item, sequence
from conftest import DATA

from radiolith.operators import dictionary as D
from radiolith.operators import views
from radiolith.plans import bridge, catalogue
from radiolith.sources import flat, reader, writer
from radiolith.sources.part10 import Parser, PartError
from pyspark.sql import functions as F

SYNTAXES = (IMPLICIT, EXPLICIT, BIG, DEFLATED)


def plain(rng, s):
    two = struct.pack(">H" if s == BIG else "<H", rng.randrange(65536))
    own = [("00080018", "UI", b"1.2.840.%04d" % rng.randrange(10000)), ("00100010", "PN", b"DOE^J "), ("00280010", "US", two), ("00281050", "DS", b"1.5\\bad "), ("00420011", "OB", bytes(rng.randrange(9) * 2)), ("30080012", "UT", b"text")]
    return build(b"".join(element(t, v, x, s) for t, v, x in own if rng.random() < 0.8), s, meta=element("00020016", "AE", b"AE%02d" % rng.randrange(30)) if rng.random() < 0.5 else b"")


def odd(rng, s):
    """What must go to the parser, and some of what looks so."""
    name = element("00100010", "PN", b"DOE^J ", s)
    bodies = [
        element("00080005", "CS", b"ISO_IR 192", s) + name, element("00090010", "LO", b"ACME", s) + element("00091001", "LO", b"XX", s), name + name, name + element("00080018", "UI", b"1.2\0", s), element("00100010", "PN", b"DOE", s), element("00080000", "UL", b"\0\0\0\0", s),
        sequence("00081140", [item(element("00081155", "UI", b"1.2\0", s), s)], s), sequence("00081140", [item(name, s, True)], s, True), element("00100010", "LO", b"AB", s), element("00100010", "ZZ", b"AB", s), element("00420011", "OB", b"AB", s, reserved=b"\1\0"), element("00100010", "PN", b"AB", s, length=9000), name[:-3], name + b"\0\0\0", b"",
        element("FFFEE00D", "OB", b"", s), element("00420011", "OB", b"AB", s, length=0xFFFFFFFF) if s != IMPLICIT else name, element("60003000", "OW", bytes(64), s), element("00420011", "OB", bytes(flat.LONGEST), s),
    ]
    files = [build(b, s) for b in bodies] + [build(name, s, group_length=n) for n in ("omit", 4, 900)] + [build(name, s, preamble=False), build(name, "1.2.840.10008.1.2.4.50"), build(name, s, meta=element("00020099", "LO", b"AB")), build(name, s, meta=element("00020010", "UI", b"1.2\0"))]
    return [*files, b"", None, b"x" * 400, build(b"", DEFLATED)[:-2], build(name, s)[:150]]


def one_at_a_time(files, schema):
    held, parser = reader._Batch(schema), Parser()
    for path, data in files:
        file = {}
        try:
            got = parser.parse(data or b"")
            file = {"had_preamble": got.had_preamble, "meta": list(got.meta.items()), "residue": [dict(zip(("tag", "vr", "value"), r, strict=True)) for r in got.residue]}
            held.add(got.data, "", 0)
        except PartError as e:
            file["error"] = {"code": e.code, "offset": e.offset, "frame": e.frame, "snippet": e.snippet, "message": e.what}
        held.end(parser.out.warnings, object_id=path, **file)
    return held.done().to_pylist()


def test_side_by_side_as_one_at_a_time(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rng = random.Random(7)
    content = [plain(rng, s) for s in SYNTAXES for _ in range(300)] + [x for s in SYNTAXES for x in odd(rng, s)]
    for s in SYNTAXES:
        for _ in range(500):  # bytes changed or cut off anywhere behind the preamble
            data = bytearray(plain(rng, s))
            for _ in range(rng.randrange(1, 3)):
                data[rng.randrange(132, len(data))] = rng.choice((0, 1, 2, 8, 16, 255, rng.randrange(256)))
            content.append(bytes(data[: rng.randrange(132, len(data) + 1)] if rng.random() < 0.2 else data))
    rng.shuffle(content)
    files = [(f"{i:05d}", x) for i, x in enumerate(content)]
    schema = to_arrow_schema(StructType.fromDDL(reader.FILE))
    want = {r["object_id"]: r for r in one_at_a_time(files, schema)}
    rows = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    got = {r["object_id"]: r for r in reader.parse_content(rows).toArrow().to_pylist()}
    assert len(want) == len(files) and got.keys() == want.keys()
    assert [k for k in want if got[k] != want[k]] == []


def test_plain_files_are_read_side_by_side():
    rng = random.Random(1)
    content = [plain(rng, s) for s in SYNTAXES for _ in range(200)]
    got = flat.Walker(Parser()).read(pa.array([*content, b"junk", None], pa.binary()))
    assert got is not None and got.file.tolist() == list(range(len(content)))


def test_columns_as_rows_to_the_byte(spark):
    syntaxes = tuple(D.TRANSFER_SYNTAXES)
    new, old = bridge.image_files(spark, DATA, syntaxes), bridge.part10(bridge.images(spark, DATA), bridge.syntax_of(syntaxes))
    assert {r.path: bytes(r.content) for r in new.collect()} == {r.path: bytes(r.content) for r in old.collect()}
    fields = [("00100010", "PN", F.col("a")), ("00420011", "OB", F.col("b"))]
    rows = [(f"{u}/{i}", u, a, b) for u in (*syntaxes, "1.2.3") for i, (a, b) in enumerate([(b"A" * 5, b"x"), (b"A" * 65534, b"x" * 70001), (b"A" * 65535, None), (None, b"y" * 300), (b"A" * 70000, b"")])]
    objects = spark.createDataFrame(rows, "object_id string, u string, a binary, b binary")
    got = {r.object_id: r.content and bytes(r.content) for r in writer.serialize_columns(objects, fields, F.col("u")).collect()}
    cells = F.array(F.struct(F.lit(0).alias("ord"), F.lit("00100010").alias("tag"), F.lit("PN").alias("vr"), F.col("a").alias("raw")), F.struct(F.lit(1).alias("ord"), F.lit("00420011").alias("tag"), F.lit("OB").alias("vr"), F.col("b").alias("raw")))
    elements = objects.select("object_id", F.lit("").alias("path"), F.explode(cells).alias("e")).select("object_id", "path", "e.*", F.lit(None).cast("int").alias("item_count"))
    files = objects.select("object_id", F.create_map(F.lit("transfer_syntax_uid"), F.col("u")).alias("meta"), F.array().cast("array<struct<tag:string,vr:string,value:binary>>").alias("residue"))
    assert got == {r.object_id: r.content and bytes(r.content) for r in writer.serialize(files, elements, False).collect()}
    assert {k for k, v in got.items() if v is None} == {f"1.2.3/{i}" for i in range(5)} | {f"{u}/{i}" for u in syntaxes if u != IMPLICIT for i in (2, 4)}


def test_views_of_files_as_of_elements(spark):
    rng = random.Random(3)
    content = [plain(rng, s) for s in SYNTAXES for _ in range(40)] + [x for s in SYNTAXES for x in odd(rng, s)]
    files = reader.parse_content(spark.createDataFrame([(f"{i}", x) for i, x in enumerate(content)], "path string, content binary"))
    assert sorted(map(repr, views.image_view_of_files(files).collect())) == sorted(map(repr, views.image_view(reader.elements(files)).collect()))


def test_objects_are_shuffled_once(spark):
    """``parse_files`` groups the line items, ``base64_objects`` also what it found by text; no rows are joined."""
    for name, shuffles in (("parse_files", 1), ("base64_objects", 2)):
        got = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert got.count("Exchange hashpartitioning") == shuffles and "Join" not in got
