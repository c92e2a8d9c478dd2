"""Nothing that was removed is left: in no column of the de-identified table, and in no byte of what is written."""

import pytest
from builder import BIG, EXPLICIT, IMPLICIT, build, element, item, sequence
from pyspark.sql import functions as F

from radiolith.functions import uids
from radiolith.operators import deident, dictionary, nesting
from radiolith.operators.profiles import define_profile
from radiolith.sources import reader, writer
from radiolith.sources.part10 import Parser

SYNTAXES = (("explicit", EXPLICIT), ("implicit", IMPLICIT), ("big", BIG))
SECRETS = ("DOE^JANE", "SECRET^NAME", "ID123456", "1.2.840.99.1", "1.2.840.99.2", "RESIDUE77", "PRIVATE88", "INNER99")
ACME = define_profile("acme", private={"ACME": {"0009XX01": ("SQ", "Items", "Items"), "0009XX02": ("LO", "Value", "Value"), "0009XX03": ("SQ", "Hidden", "Hidden"), "0009XX04": ("LO", "Empty", "Empty")}})


def body(s):
    private = element("00090010", "LO", b"ACME", s) + sequence("00091001", [item(element("00090010", "LO", b"ACME", s) + element("00091002", "LO", b"INNER99 ", s) + element("00100010", "PN", b"SECRET^NAME ", s) + element("00080060", "CS", b"CT", s), s)], s)
    private += element("00091002", "LO", b"PRIVATE88 ", s) + element("00091003", "UN", b"PRIVATE88 ", s) + element("00091004", "LO", b"", s)
    out = element("00080018", "UI", b"1.2.840.99.1", s) + private + element("00100010", "PN", b"DOE^JANE", s) + element("00100020", "LO", b"ID123456", s)
    out += element("0020000D", "UI", b"1.2.840.99.2", s)
    return out + sequence("00540016", [item(element("00080060", "CS", b"PT", s) + element("00100010", "PN", b"SECRET^NAME ", s) + sequence("00540300", [item(element("00100020", "LO", b"ID123456", s), s)], s), s)], s, s == EXPLICIT)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("leaks")
    for name, s in SYNTAXES:
        meta = element("00020003", "UI", b"1.2.840.99.1") + element("00020100", "UI", b"1.2.840.99.2") + element("00020102", "OB", b"RESIDUE77 ")
        (folder / name).write_bytes(build(body(s), s, meta=meta))
    vrs = dictionary.vr_of() | {"00540016": "SQ", "00540300": "SQ"}
    return reader.read_files(spark, str(folder), vrs=vrs, profile=ACME).withColumn("object_id", F.substring_index("object_id", "/", -1)).cache()


def texts(rows):
    """All that the rows hold, as Latin-1."""
    def flat(x):
        if isinstance(x, (bytes, bytearray)):
            return [bytes(x).decode("latin1")]
        if isinstance(x, dict):
            return [t for k, v in x.items() for t in flat(k) + flat(v)]
        if isinstance(x, (list, tuple)):
            return [t for v in x for t in flat(v)]
        return [str(x)]

    return "\n".join(t for r in rows for t in flat(tuple(r)))


@pytest.mark.parametrize("retain", [(), ("RetainSafePrivate",)])
def test_no_column_and_no_byte_leaks(files, retain):
    elements = reader.elements(files)
    assert all(s in texts(elements.collect()) + texts(files.select("residue").collect()) for s in SECRETS)
    done = deident.deidentify_files(files, elements, retain, profile=ACME)
    out = done.elements.cache()
    found = texts(out.collect()) + texts(nesting.rebuild(out).collect()) + texts(done.files.collect()) + texts(done.audit.collect())
    assert not [s for s in SECRETS if s in found]
    for r in writer.serialize(done.files, out).collect():
        assert r.error is None and not [s for s in SECRETS if s.encode() in bytes(r.content)]
        p = Parser(vrs=dictionary.vr_of() | {"00540016": "SQ", "00540300": "SQ"}).parse(bytes(r.content))
        assert p.meta["media_storage_sop_instance_uid"] == uids._remap("1.2.840.99.1", "2.25") == p.data["00080018"].raw.decode().rstrip("\0")
        inner = p.data["00540016"].items[0]
        assert inner["00080060"].raw == b"PT" and inner["00100010"].raw == b""
        assert ("00091001" in p.data) == bool(retain)
        if retain:
            kept = p.data["00091001"].items[0] if p.data["00091001"].items else {}
            if dict(SYNTAXES)[r.object_id] != IMPLICIT:  # unknown there without the profile
                assert set(kept) == {"00090010", "00100010", "00080060"} and kept["00100010"].raw == b"" and kept["00080060"].raw == b"CT"
            assert p.data["00091003"].raw == b"" and p.data["00091004"].raw == b"" and "00091002" not in p.data


def test_each_removed_element_has_an_audit_row(files):
    elements = reader.elements(files).cache()
    for retain in ((), ("RetainSafePrivate",)):
        out, audit = deident.deidentify(elements, retain, profile=ACME)
        left = {(r.object_id, r.ord) for r in out.where("tag not in ('00120062', '00120063')").collect()}
        told = {(r.object_id, r.ord): r.applied for r in audit.collect()}
        gone = {(r.object_id, r.ord) for r in elements.collect()} - left
        assert gone and all(told[k] in ("removed", "unenumerable") for k in gone)


def test_report_has_nine_tables(files):
    elements = reader.elements(files)
    done = deident.deidentify_files(files, elements, ("RetainSafePrivate",), profile=ACME)
    tables = deident.report(elements, done.audit, dictionary.attributes(files.sparkSession), deident.METHOD, retain=("RetainSafePrivate",), uids=done.uids)
    assert set(tables) == {"attributes", "removed_private", "embedded", "unauditable", "unenumerable", "undefined_vr", "warnings", "uid_map", "retained"}
    assert {(r.tag, r.path) for r in tables["unenumerable"].collect()} == {("00091002", "00091001[0]"), ("00091002", "")}
    assert {r.tag for r in tables["unauditable"].collect()} == {"00091003"}
    # the implicit syntax has it as the sequence that the profile says it is
    assert {(r.object_id, r.code) for r in tables["warnings"].collect()} == {("explicit", "DEIDENT_PRIVATE_CARRIER_NOT_AUDITABLE"), ("big", "DEIDENT_PRIVATE_CARRIER_NOT_AUDITABLE"), ("implicit", "DEIDENT_SEQUENCE_NOT_AUDITABLE")}
    assert {r.original for r in tables["uid_map"].collect()} == {"1.2.840.99.1", "1.2.840.99.2"} and [r.option for r in tables["retained"].collect()] == ["RetainSafePrivate"]


def test_uid_map_over_runs(spark, files):
    elements = reader.elements(files)
    given = spark.createDataFrame([("1.2.840.99.1", "9.9.1"), ("5.5", "9.9.5"), ("5.5", "9.9.4"), (None, "x"), ("6.6", None)], "original string, replacement string")
    done = deident.deidentify_files(files, elements, uid_map=given)
    want = {"1.2.840.99.1": "9.9.1", "5.5": "9.9.4", "1.2.840.99.2": uids._remap("1.2.840.99.2", "2.25")}
    assert {r.original: r.replacement for r in done.uids.collect()} == want
    assert {r.meta["media_storage_sop_instance_uid"] for r in done.files.collect()} == {"9.9.1"}
    assert {r.value for r in done.elements.where("tag = '00080018'").collect()} == {"9.9.1"}
    assert {r.value for r in done.elements.where("tag = '0020000D'").collect()} == {want["1.2.840.99.2"]}
    again = deident.deidentify_files(files, elements, uid_map=done.uids)
    assert {r.original: r.replacement for r in again.uids.collect()} == want
    kept = deident.deidentify_files(files, elements, ("RetainUIDs",), uid_map=given)
    assert {r.meta["media_storage_sop_instance_uid"] for r in kept.files.collect()} == {"1.2.840.99.1"}


def test_columns_of_other_kinds_are_not_passed_on(files):
    elements = reader.elements(files).withColumn("note", F.col("value")).withColumn("applied", F.lit("clash"))
    out, _ = deident.deidentify(elements)
    assert not {"note", "applied"} & set(out.columns)
