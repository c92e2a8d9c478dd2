"""Sequences as intervals and as bytes again, against objects written one at a time."""

import random

import pytest
from builder import BIG, DEFLATED, EXPLICIT, IMPLICIT, build, element, item, sequence
from plain_writer import SerializeError, by_path, encode_file, encode_items
from pyspark.sql import functions as F

from radiolith.operators import nesting
from radiolith.sources import reader, writer
from radiolith.sources.part10 import Parser, rows

SYNTAXES = (IMPLICIT, EXPLICIT, BIG, DEFLATED)


def data_set(rng, s, levels):
    """Elements of all kinds; sequences with empty items, items of undefined length and deeper sequences."""
    out = b""
    for tag in sorted(rng.sample(["00080060", "00100010", "00081140", "00081199", "00200011", "00280010", "00400275", "0040A730", "00180010", "7FE00010"], rng.randint(0, 6))):
        if tag in ("00081140", "00081199", "00400275", "0040A730"):
            if levels:
                items = [item(b"" if rng.random() < 0.3 else data_set(rng, s, levels - 1), s, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
                out += sequence(tag, items, s, rng.random() < 0.3)
        else:
            vr = {"00080060": "CS", "00100010": "PN", "00200011": "IS", "00280010": "US", "00180010": "LO", "7FE00010": "OW"}[tag]
            out += element(tag, vr, rng.randbytes(2 * rng.randint(0, 5)), s)
    return out


@pytest.fixture(scope="module")
def objects(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("objects"), random.Random(11)
    for k in range(80):
        s = SYNTAXES[k % 4]
        body = data_set(rng, EXPLICIT if s == DEFLATED else s, 4)
        if k % 9 == 1 and s == EXPLICIT:
            body += sequence("7FE00010", [item(b""), item(b"abcd")], undefined=True, vr="OB") + element("FFFCFFFC", "ZZ", b"odd")
        (folder / f"{k:03d}").write_bytes(build(body, s, meta=element("00020016", "AE", b"ODD") + element("00020102", "OB", b"\1\2")))
    return reader.read_files(spark, str(folder)).cache(), {f"{p.name}": p.read_bytes() for p in folder.iterdir()}


def last(name):
    return name.rsplit("/", 1)[-1]


@pytest.mark.parametrize("rebuild", [True, False])
def test_same_bytes_as_one_at_a_time(objects, rebuild):
    files, content = objects
    got = {last(r.object_id): r for r in writer.serialize(files, reader.elements(files), rebuild).collect()}
    assert len(got) == len(content) and not any(r.error for r in got.values())
    for name, data in content.items():
        p = Parser().parse(data)
        assert bytes(got[name].content) == encode_file(p.meta, p.residue, rows(p.data), rebuild), name


def test_errors_as_one_at_a_time(spark):
    files = spark.createDataFrame([("a", {}, None), ("b", {"transfer_syntax_uid": "1.2"}, None), ("c", {"transfer_syntax_uid": EXPLICIT}, []), ("d", {"transfer_syntax_uid": EXPLICIT}, None), ("e", {"transfer_syntax_uid": EXPLICIT, "source_application_entity_title": "x" * 70000}, None)], "object_id string, meta map<string,string>, residue array<struct<tag:string,vr:string,value:binary>>")
    own = spark.createDataFrame([("c", "", 0, "00081140", "SQ", 1, False, b""), ("c", "00081140[0]", 1, "00100010", "PN", None, False, b"x" * 65536)], "object_id string, path string, ord int, tag string, vr string, item_count int, full_span boolean, raw binary")
    got = {r.object_id: r for r in writer.serialize(files, own).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": "MISSING_TRANSFER_SYNTAX", "b": "UNSUPPORTED_TRANSFER_SYNTAX", "c": "VALUE_TOO_LONG", "d": None, "e": "VALUE_TOO_LONG"}
    assert bytes(got["d"].content) == encode_file({"transfer_syntax_uid": EXPLICIT}, [], [])
    with pytest.raises(SerializeError):
        encode_file({"transfer_syntax_uid": EXPLICIT}, [], [{"path": "", "ord": 0, "tag": "00100010", "vr": "PN", "item_count": None, "full_span": False, "raw": b"x" * 65536}])


def test_intervals_from_paths_are_the_parsers(objects):
    e = reader.elements(objects[0])
    both = nesting.intervals(e.drop("leave").withColumn("given", F.lit(None))).select(F.col("object_id").alias("o"), F.col("ord").alias("n"), F.col("leave").alias("found"))
    met = e.join(both, (F.col("object_id") == F.col("o")) & (F.col("ord") == F.col("n")))
    assert met.count() == e.count() and met.where("found <> leave").count() == 0


def test_inside_a_flagged_sequence(objects):
    rng = random.Random(2)
    e = reader.elements(objects[0])
    flagged = {(r.object_id, r.ord): nesting_key(r) for r in e.where("vr = 'SQ'").collect() if rng.random() < 0.3}
    table = e.sparkSession.createDataFrame([(*k, True) for k in flagged], "o string, n int, flagged boolean")
    got = e.join(table, (F.col("object_id") == F.col("o")) & (F.col("ord") == F.col("n")), "left").withColumn("lost", nesting.inside(F.col("flagged"))).collect()
    for r in got:
        assert r.lost == any(o == r.object_id and r.path.startswith(key + "[") for (o, _), key in flagged.items())


def nesting_key(r):
    return f"{r.path}/{r.tag}" if r.path else r.tag


def test_rebuilt_sequences_hold_their_items(objects):
    files, content = objects
    e = reader.elements(files)
    was = {(r.object_id, r.ord): r for r in e.collect()}
    sets = {name: by_path(rows(Parser().parse(data).data)) for name, data in content.items()}
    for r in nesting.rebuild(e).collect():
        if r.vr == "SQ" and r.item_count is not None:
            assert bytes(r.raw) == encode_items(sets[last(r.object_id)], r.path, r.tag, r.item_count, r.encoding)
            assert r.length == len(r.raw) and not r.full_span
        else:
            assert r == was[r.object_id, r.ord]


def test_inherited_over_any_depth(spark):
    rng = random.Random(7)
    out = []

    def walk(o, path, depth, values, n):
        own = list(values)
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.35:
                own.append(f"v{len(out)}")
                out.append((o, path, len(out), "00080005", "CS", own[-1], values and own[-2:-1] and own[-2] or (own[-2] if len(own) > 1 else None)))
            elif depth and rng.random() < 0.6:
                out.append((o, path, len(out), f"0040A7{n:02X}", "SQ", "", own[-1] if own else None))
                for i in range(2):
                    walk(o, (path + "/" if path else "") + f"0040A7{n:02X}[{i}]", depth - 1, own[-1:], n + 1)
                n += 7
            else:
                out.append((o, path, len(out), "00100010", "PN", "x", own[-1] if own else None))

    for o in range(25):
        walk(f"o{o}", "", 5, [], 0)
    e = spark.createDataFrame(out, "object_id string, path string, ord int, tag string, vr string, value string, want string")
    got = nesting.inherited(e, F.when(F.col("tag") == "00080005", F.col("value")), "found")
    assert got.count() == len(out) and got.where("not (found <=> want)").collect() == []
