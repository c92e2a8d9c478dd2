import struct

import pytest
from builder import BIG, DEFLATED, EXPLICIT, IMPLICIT, UNDEFINED, build, element, item, sequence
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_writer import SerializeError, encode_file
from pyspark.sql import functions as F

from radiolith.functions.values import KNOWN_VRS, LONG_FORM_VRS
from radiolith.operators.embedded import find_embedded, find_in_batch
from radiolith.operators.profiles import LENIENT, SIEMENS, STRICT, ProfileError, define_profile
from radiolith.sources.part10 import Parser, PartError, rows

SYNTAXES = (IMPLICIT, EXPLICIT, BIG, DEFLATED)
NAME = b"DOE^JANE"


def inner(s):
    return EXPLICIT if s == DEFLATED else s


def codes(p):
    return [w[0] for w in p.warnings]


@pytest.mark.parametrize("s", SYNTAXES)
def test_reads_every_syntax(s):
    p = Parser().parse(build(element("00100010", "PN", NAME, inner(s)) + element("00280010", "US", struct.pack((">" if s == BIG else "<") + "H", 512), inner(s)), s))
    assert [(e.tag, e.vr, e.raw) for e in p.data.values()][0] == ("00100010", "PN", NAME)
    assert p.data["00280010"].little == (s != BIG) and not p.warnings and p.meta["transfer_syntax_uid"] == s


@pytest.mark.parametrize("data,code", [(b"", "EMPTY_INPUT"), (b"x" * 400, "NOT_PART10"), (build(b"", with_syntax=False), "MISSING_TRANSFER_SYNTAX"), (build(b"", "1.2.840.10008.1.2.4.50"), "UNSUPPORTED_TRANSFER_SYNTAX")])
def test_fatal(data, code):
    with pytest.raises(PartError) as e:
        Parser().parse(data)
    assert e.value.code == code


def test_recoverable():
    assert "MISSING_PREAMBLE" in codes(Parser().parse(build(element("00100010", "PN", NAME), preamble=False)))
    assert "FILE_META_GROUP_LENGTH_MISSING" in codes(Parser().parse(build(element("00100010", "PN", NAME), group_length="omit")))
    assert "FILE_META_GROUP_LENGTH_MISMATCH" in codes(Parser().parse(build(element("00100010", "PN", NAME), group_length=4)))
    assert "ODD_LENGTH_VALUE_PADDED" in codes(Parser().parse(build(element("00100010", "PN", b"ABC"))))
    assert "NONZERO_RESERVED_BYTES" in codes(Parser().parse(build(element("7FE00010", "OW", b"ab", reserved=b"\1\0"))))
    assert "VR_MISMATCH" in codes(Parser().parse(build(element("00100010", "LO", NAME))))
    assert "GROUP_LENGTH_IN_DATASET" in codes(Parser().parse(build(element("00080000", "UL", b"\0\0\0\0"))))
    p = Parser().parse(build(element("00100020", "LO", b"AA") + element("00100010", "PN", NAME) + element("00100020", "LO", b"BB")))
    assert list(p.data) == ["00100020", "00100010"] and p.data["00100020"].raw == b"BB" and codes(p) == ["DUPLICATE_TAG_IN_DATA_SET"]


@pytest.mark.parametrize("s", SYNTAXES)
@pytest.mark.parametrize("undefined", [False, True])
def test_sequences(s, undefined):
    i = inner(s)
    body = sequence("00081140", [item(element("00080060", "CS", b"CT", i), i, undefined), item(b"", i), item(element("00080060", "CS", b"MR", i), i)], i, undefined)
    p = Parser().parse(build(body + element("00100010", "PN", NAME, i), s))
    got = rows(p.data)
    assert [(r["path"], r["tag"], r["raw"]) for r in got if r["path"]] == [("00081140[0]", "00080060", b"CT"), ("00081140[2]", "00080060", b"MR")]
    assert got[0]["item_count"] == 3 and "EMPTY_ITEM_IN_SEQUENCE" in codes(p) and "00100010" in p.data


def test_sequence_edges():
    open_end = sequence("00081140", [item(element("00080060", "CS", b"CT"))], undefined=True, delimiter=False)
    assert len(Parser().parse(build(open_end)).data["00081140"].items) == 1
    broken = element("00081140", "SQ", b"\1\2\3\4\5\6\7\x08", IMPLICIT)
    p = Parser().parse(build(broken, IMPLICIT))
    assert p.data["00081140"].items is None and codes(p) == ["SQ_NOT_DESCENDED"]
    un = sequence("00091001", [item(element("00080060", "CS", b"CT", IMPLICIT), IMPLICIT)], undefined=True, vr="UN")
    e = Parser().parse(build(un)).data["00091001"]
    assert (e.vr, e.promoted) == ("SQ", True)
    with pytest.raises(PartError):
        Parser().parse(build(item(b"")))
    with pytest.raises(PartError):
        Parser().parse(build(element("00100010", "PN", NAME, length=99)))
    with pytest.raises(PartError):
        Parser().parse(build(element("00104000", "UT", b"", length=UNDEFINED)))


def nested(n, s=EXPLICIT):
    body = element("00080060", "CS", b"CT", s)
    for _ in range(n):
        body = sequence("00081140", [item(body, s)], s)
    return body


def test_depth():
    assert len(rows(Parser().parse(build(nested(64))).data)) == 65
    with pytest.raises(PartError):
        Parser().parse(build(nested(65)))


def test_encapsulated_pixels():
    body = sequence("7FE00010", [item(b""), item(b"abcd")], undefined=True, vr="OB")
    e = Parser().parse(build(body)).data["7FE00010"]
    assert (e.vr, len(e.items), e.full_span, e.raw) == ("OB", 2, True, body)


def test_charset_and_creators():
    body = element("00080005", "CS", b"ISO_IR 192") + element("00100010", "PN", NAME) + sequence("00081140", [item(element("00080005", "CS", b"ISO_IR 100") + element("00080060", "CS", b"CT")), item(element("00080060", "CS", b"MR"))])
    got = {(r["path"], r["tag"]): r["charset"] for r in rows(Parser().parse(build(body)).data)}
    assert got["", "00100010"] == ["ISO_IR 192"] and got["00081140[0]", "00080060"] == ["ISO_IR 100"] and got["00081140[1]", "00080060"] == ["ISO_IR 192"]
    assert "UNSUPPORTED_CHARSET" in codes(Parser().parse(build(element("00080005", "CS", b"ISO_IR 9999 "))))
    private = element("00290010", "LO", b"SIEMENS CSA HEADER", IMPLICIT) + element("00291010", "UN", b"\1\2\3\4", IMPLICIT)
    p = Parser(SIEMENS).parse(build(private, IMPLICIT))
    assert (p.data["00291010"].vr, p.data["00291010"].creator) == ("OB", "SIEMENS CSA HEADER")
    assert Parser().parse(build(private, IMPLICIT)).data["00291010"].creator == "<withheld>"
    assert "PRIVATE_TAG_NO_CREATOR" in codes(Parser().parse(build(element("00291010", "OB", b"\1\2"))))


def test_profiles():
    odd = build(element("00100010", "PN", b"ABC"), preamble=False)
    assert codes(Parser(LENIENT).parse(odd)) == []
    with pytest.raises(PartError):
        Parser(STRICT).parse(build(element("00100010", "LO", NAME)))
    with pytest.raises(PartError):
        Parser(strict=True).parse(odd)
    for bad in ({"name": ""}, {"name": "x", "escalate": ["NO"]}, {"name": "x", "private": {"C": {"0008XX01": ("LO", "a", "b")}}}, {"name": "x", "escalate": ["VR_MISMATCH"], "suppress": ["VR_MISMATCH"]}):
        with pytest.raises(ProfileError):
            define_profile(**bad)
    both = define_profile("both", extends=(STRICT, LENIENT))
    assert both.lineage == ("strict", "lenient", "both") and both.description == STRICT.description


_values = st.binary(max_size=40).map(lambda b: b + b"\0" * (len(b) % 2))
_flat = st.dictionaries(st.sampled_from(["00080060", "00100010", "00100020", "00181030", "0020000D", "00280010", "7FE00010"]), _values, max_size=6)
_VR = {"00080060": "CS", "00100010": "PN", "00100020": "LO", "00181030": "LO", "0020000D": "UI", "00280010": "US", "7FE00010": "OW"}


@settings(max_examples=150, deadline=None)
@given(_flat, st.lists(_flat, max_size=3), st.sampled_from(SYNTAXES), st.booleans())
def test_round_trip(flat, items, s, rebuild):
    i = inner(s)
    body = b"".join(element(t, _VR[t], v, i) for t, v in flat.items())
    body += sequence("00081140", [item(b"".join(element(t, _VR[t], v, i) for t, v in x.items()), i) for x in items], i)
    p = Parser().parse(build(body, s))
    again = Parser().parse(encode_file(p.meta, p.residue, rows(p.data), rebuild))
    keep = lambda q: [(r["path"], r["tag"], r["vr"], r["item_count"], r["raw"] if not r["full_span"] else None) for r in rows(q.data)]
    assert keep(again) == keep(p) and not [w for w in again.warnings if w[0] != "EMPTY_ITEM_IN_SEQUENCE"]


@settings(max_examples=300, deadline=250)
@given(st.binary(max_size=400), st.sampled_from(SYNTAXES), st.integers(0, 200))
def test_fuzz(noise, s, cut):
    for data in (noise, b"\0" * 128 + b"DICM" + noise, build(noise, s), build(nested(3, inner(s)), s)[: -cut or None]):
        try:
            Parser().parse(data)
        except PartError:
            pass


def test_serialize_errors():
    for meta, code in (({}, "MISSING_TRANSFER_SYNTAX"), ({"transfer_syntax_uid": "1.2"}, "UNSUPPORTED_TRANSFER_SYNTAX")):
        with pytest.raises(SerializeError) as e:
            encode_file(meta, [], [])
        assert e.value.code == code


def test_embedded():
    hidden = element("00100010", "PN", NAME)
    acts = lambda t: t == "00100010"
    assert find_embedded(b"COMMENT " + hidden, "LT", "explicit-le", acts) == (["00100010"], 1)
    assert find_embedded(b"COMMENT " + hidden, "OB", "explicit-le", acts) is None
    assert find_embedded(b"just a comment, no more", "LT", "explicit-le", acts) is None
    assert find_embedded(b"COMMENT " + hidden + b"tail", "LT", "explicit-le", acts) is None
    assert find_embedded(b"\0" * 4096, "LT", "implicit-le", acts) is None


def embedded_by_hand(value, vr, encoding, acts):
    """Every start tried on its own, by the standard's header rules."""
    def header(at):
        order = ">" if encoding == "explicit-be" else "<"
        if at + 8 > len(value):
            return None
        g, e = struct.unpack_from(order + "HH", value, at)
        if g == 0xFFFE:
            return at + 8, None
        if (g, e) == (0, 0):
            return None
        if encoding == "implicit-le":
            size, n = 8, struct.unpack_from("<I", value, at + 4)[0]
        elif (code := value[at + 4 : at + 6].decode("latin1")) in LONG_FORM_VRS:
            if at + 12 > len(value) or value[at + 6 : at + 8] != b"\0\0":
                return None
            size, n = 12, struct.unpack_from(order + "I", value, at + 8)[0]
        elif code in KNOWN_VRS:
            size, n = 8, struct.unpack_from(order + "H", value, at + 6)[0]
        else:
            return None
        return None if n == 0xFFFFFFFF or n % 2 or at + size + n > len(value) else (at + size + n, f"{g:04X}{e:04X}")

    for start in range(0, len(value), 2):
        at, tags, count = start, [], 0
        while at < len(value) and (found := header(at)):
            at, tag = found
            count += tag is not None
            tags += [tag] if tag and acts(tag) else []
        if at == len(value) and tags:
            fine = {"LT": (9, 10, 12, 13, 27), "LO": (27,)}.get(vr, ())
            return (tags, count) if any((b < 32 and b not in fine) or b == 127 for b in value[start:]) else None
    return None


_part = st.one_of(
    st.binary(max_size=6), st.text("AB \n", max_size=6).map(str.encode),
    st.tuples(st.sampled_from(["00100010", "00080060", "7FE00010", "FFFEE000"]), st.sampled_from(["PN", "CS", "OW"]), st.sampled_from([b"", b"AB", b"ABCD"]), st.sampled_from([EXPLICIT, IMPLICIT, BIG])).map(lambda x: element(*x)),
)


@settings(max_examples=600, deadline=None)
@given(st.lists(_part, max_size=5).map(b"".join), st.sampled_from(["LT", "LO", "CS"]), st.sampled_from(["explicit-le", "implicit-le", "explicit-be"]))
def test_embedded_as_by_hand(value, vr, encoding):
    acts = lambda t: t in ("00100010", "7FE00010")
    want = embedded_by_hand(value, vr, encoding, acts) if len(value) >= 8 and len(value) % 2 == 0 else None
    assert find_embedded(value, vr, encoding, acts) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(_part, max_size=5).map(b"".join)), st.sampled_from(["LT", "LO", "CS", "OB"]), st.sampled_from(["explicit-le", "implicit-le", "explicit-be"])), max_size=12))
def test_embedded_in_a_batch_as_one_at_a_time(rows):
    acts = lambda t: t in ("00100010", "7FE00010")
    got = find_in_batch([v for v, _, _ in rows], [r for _, r, _ in rows], [e for _, _, e in rows], acts)
    assert got.tolist() == [v is not None and find_embedded(v, r, e, acts) is not None for v, r, e in rows]


def test_embedded_in_long_values(monkeypatch):
    from radiolith.operators import embedded

    hidden = element("00100010", "PN", NAME)
    values = [b"x" * (1 << 20) + hidden, b"y" * ((1 << 20) + 1) + hidden, hidden * 9000, b"\0" * 5000, hidden + b"z" * (1 << 20), b"A" * 7 + hidden]
    acts = lambda t: t == "00100010"
    want = [find_embedded(v, "LT", "explicit-le", acts) is not None for v in values]
    for chunk in (1, 1 << 16, 1 << 22):
        monkeypatch.setattr(embedded, "CHUNK", chunk)
        assert find_in_batch(values, ["LT"] * len(values), ["explicit-le"] * len(values), acts).tolist() == want
    assert want == [True, True, True, False, False, False]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    """One object in each of three syntaxes, and two with other character sets."""
    from radiolith.sources import reader

    folder = tmp_path_factory.mktemp("parsed")
    for name, s in (("explicit", EXPLICIT), ("implicit", IMPLICIT), ("big", BIG)):
        o = ">" if s == BIG else "<"
        pack = lambda kind, x: struct.pack(o + kind, x)  # noqa: B023, E731
        body = element("00080005", "CS", b"ISO_IR 192", s) + element("00100010", "PN", "Müller^Jürg".encode() + b" ", s) + element("00100024", "SQ", item(element("00400031", "UT", b"1.2 ", s), s), s)
        body += sequence("00101002", [item(element("00100020", "LO", b"A1", s) + element("00100022", "CS", b"TEXT", s), s), item(element("00100021", "LO", b"II", s), s)], s)
        body += element("00280010", "US", pack("H", 512), s) + element("00280011", "US", pack("H", 256), s) + element("00280103", "US", pack("H", 1), s)
        maps = element("00409224", "FD", pack("d", -1024.25), s) + element("00409225", "FD", pack("d", 0.1), s) + sequence("004008EA", [item(element("00080100", "SH", b"HU", s), s)], s)
        body += sequence("00409096", [item(maps, s)], s)
        (folder / name).write_bytes(build(body, s))
    (folder / "latin2").write_bytes(build(element("00080005", "CS", b"ISO_IR 101") + element("00100010", "PN", "Łucja^Ż".encode("iso8859-2") + b" ")))
    (folder / "kanji").write_bytes(build(element("00080005", "CS", b"\\ISO 2022 IR 87 ") + element("00100010", "PN", "Yamada^Tarou=山田^太郎".encode("iso2022_jp"))))
    return reader.elements(reader.read_files(spark, str(folder))).withColumn("object_id", F.substring_index("object_id", "/", -1)).cache()


def test_views_of_files(parsed):
    from radiolith.operators import views

    three = {"explicit", "implicit", "big"}
    images = {r.object_id: r for r in views.image_view(parsed).collect()}
    assert all((images[k].rows, images[k].columns, images[k].pixel_representation, images[k].signed) == (512, 256, 1, True) for k in three)
    patients = {r.object_id: r for r in views.patient_view(parsed).collect()}
    for k in three:
        p = patients[k]
        assert (p.name.alphabetic.family, p.name.alphabetic.given) == ("Müller", "Jürg")
        assert [tuple(x) for x in p.other_ids] == [("A1", None, "TEXT"), (None, "II", None)] and len(p.issuer_qualifiers) == 1
    assert patients["latin2"].name.alphabetic.family == "Łucja" and patients["latin2"].other_ids == []
    assert patients["kanji"].name.ideographic.family == "山田"
    maps = {r.object_id: (r.slope, r.intercept, r.units) for r in views.real_world_value_maps(parsed).collect()}
    assert maps == dict.fromkeys(three, (0.1, -1024.25, "HU"))
    assert {(r.object_id, r.item, r.id) for r in views.other_patient_ids(parsed).collect()} >= {(k, 0, "A1") for k in three}
    codes_of = views.coded_concepts(parsed.where("path like '%004008EA[0]'"), ("object_id",)).collect()
    assert {(r.value_code, r.scheme_uid) for r in codes_of} == {("HU", None)}
    assert not any(r.enhanced for r in views.has_functional_groups(parsed).collect())
    assert {r.encoding for r in parsed.select("encoding").distinct().collect()} == {"explicit-le", "implicit-le", "explicit-be"}


def test_dates_by_the_rules(spark):
    from radiolith.functions import values as V

    got = spark.createDataFrame([(x,) for x in ("20240115", "2024.01.15", "20241399", "ANON", "")], "t string").select("t", V.parse_date(F.col("t")).alias("d")).collect()
    assert [(r.d.valid, r.d.legacy) for r in got] == [(True, False), (True, True), (False, False), (False, True), (False, False)]
    got = spark.createDataFrame([(x,) for x in ("20240115+99", "garbage+99", "20240115-0500", "2024-01-15", "20240115+1500", "+2024")], "t string").select(V.parse_date_time(F.col("t")).alias("d")).collect()
    assert [(r.d.valid, r.d.odd_offset, r.d.offset_minutes) for r in got] == [(True, True, None), (False, False, None), (True, False, -300), (True, True, None), (True, True, None), (False, False, None)]


def test_hidden_attributes_in_each_encoding(spark, tmp_path):
    from radiolith.operators import deident
    from radiolith.sources import reader

    for name, s in (("explicit", EXPLICIT), ("implicit", IMPLICIT), ("big", BIG)):
        hidden = b"COMMENT " + element("00100010", "PN", NAME, s)
        (tmp_path / name).write_bytes(build(element("00181030", "LO", b"KNEE", s) + element("00104000", "LT", b"x ", s) + element("00180015", "CS", hidden + b" " * (len(hidden) % 2), s), s))
    out, audit = deident.deidentify(reader.elements(reader.read_files(spark, str(tmp_path))))
    assert {r.raw for r in out.where("tag = '00180015'").collect()} == {b""}
    assert audit.where("applied = 'embedded'").count() == 3


def test_disputed_boundary_and_report(spark):
    from radiolith.operators import deident, dictionary
    from radiolith.operators.profiles import define_profile

    acme = define_profile("acme", private={"ACME": {"0009XX01": ("LO", "Kept", "Kept")}})
    pair = lambda o, path, n, at: [(o, path, n, "00090010", "LO", b"ACME", None, 4, at), (o, path, n + 1, "00091001", "LO", b"SAFE", None, 4, at + 10)]
    over = ("b", "", 2, "00400275", "SQ", b"x" * 60, 1, 20, 200)
    rows = pair("a", "", 0, 100) + pair("b", "", 0, 100) + [over] + pair("b", "", 3, 300) + pair("b", "00400275[0]", 5, 10) + [("a", "", 8, "7FE00010", "OW", b"ab", None, 2, 900), ("a", "", 9, "00120063", "LO", b"OLD METHOD", None, 10, 950)]
    e = spark.createDataFrame(rows, "object_id string, path string, ord int, tag string, vr string, raw binary, item_count int, length long, byte_offset long")
    rules = dictionary.actions(spark).where("tag <> '00400275'")
    out, audit = deident.deidentify(e, ("RetainSafePrivate",), profile=acme, actions=rules, private_values="kept")
    kept = {(r.object_id, r.path, r.ord) for r in out.where("tag = '00091001'").collect()}
    assert kept == {("a", "", 1), ("b", "", 1)}
    tables = deident.report(e, audit, dictionary.attributes(spark), deident.METHOD, cap=1)
    assert {(r.object_id, r.code) for r in tables["warnings"].collect()} == {("a", "BURNED_IN_ANNOTATION_NOT_REMOVED"), ("a", "DEIDENT_METHOD_PRIOR_RETAINED")}
    gone = tables["removed_private"].collect()
    assert [(r.object_id, r.withheld) for r in gone] == [("b", 3)]
    method = {r.object_id: bytes(r.raw).decode() for r in out.where("tag = '00120063'").collect()}
    assert method["a"].startswith("OLD METHOD\\") and not method["b"].startswith("OLD")


def test_file_meta_remap(spark):
    from radiolith.functions import uids
    from radiolith.operators import deident

    files = spark.createDataFrame([("a", {"media_storage_sop_instance_uid": "1.2.3", "version": "0001"}), ("b", {"version": "0001"})], "object_id string, meta map<string,string>")
    got = {r.object_id: r.meta for r in deident.remap_file_meta(files, "meta").collect()}
    assert got == {"a": {"media_storage_sop_instance_uid": uids._remap("1.2.3", "2.25"), "version": "0001"}, "b": {"version": "0001"}}
    assert {r.object_id: r.meta for r in deident.remap_file_meta(files, "meta", ("RetainUIDs",)).collect()}["a"]["media_storage_sop_instance_uid"] == "1.2.3"


def test_objects_in_base64(spark):
    import base64

    from radiolith.operators import phi_scan

    whole, bare = build(element("00100010", "PN", NAME)), build(element("00100010", "PN", NAME), preamble=False)
    texts = spark.createDataFrame([("p", f"x {base64.b64encode(whole).decode()} y {base64.b64encode(b'z' * 400).decode()}"), ("q", base64.b64encode(bare).decode().rstrip("=")), ("r", None)], "path string, text string")
    assert {r.path: bytes(r.content) for r in phi_scan.base64_objects(texts, "path", "text").collect()} == {"p#0": whole, "q#0": bare}


def test_files_as_tables(spark, tmp_path):
    from radiolith.operators import deident
    from radiolith.operators.views import patient_view
    from radiolith.sources import reader, writer

    body = element("00100010", "PN", NAME) + element("00100020", "LO", b"ID01") + sequence("00081111", [item(element("00081155", "UI", b"1.2.3\0"))]) + sequence("0040A730", [item(element("00100020", "LO", b"ID02"))]) + element("0020000D", "UI", b"1.2.840.1\0") + element("00091001", "LO", b"XX")
    (tmp_path / "a.dcm").write_bytes(build(body))
    (tmp_path / "b.dcm").write_bytes(b"junk")
    files = reader.read_files(spark, str(tmp_path)).cache()
    assert [r.code for r in reader.errors(files).collect()] == ["NOT_PART10"]
    assert [r.code for r in reader.warnings(files).collect()] == ["PRIVATE_TAG_NO_CREATOR"]
    e = reader.elements(files)
    assert patient_view(e).first()["name"]["alphabetic"]["family"] == "DOE"
    out, audit = deident.deidentify(e)
    good = files.where("error is null")
    content = writer.serialize(good, out).first()["content"]
    p = Parser().parse(bytes(content))
    assert "00081111" not in p.data and "00091001" not in p.data
    assert p.data["00100020"].raw == b"" and p.data["0040A730"].items == [] and p.data["0020000D"].raw.startswith(b"2.25.")
    assert p.data["00120062"].raw == b"YES " and {r.applied for r in audit.collect()} >= {"removed", "emptied", "remapped"}


def test_stream(spark, tmp_path):
    from radiolith.streaming.files import stream_elements

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dcm").write_bytes(build(element("00100010", "PN", NAME)))
    q = stream_elements(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.sql("select tag from streamed").first()["tag"] == "00100010"


def test_deidentify_by_the_whole_table(spark):
    from radiolith.operators import deident, dictionary

    tags = {"00321032": "PN", "00400006": "PN", "00380500": "LO", "00400241": "AE", "00180015": "CS"}
    rows = [("o", t, i, t, vr, b"PRIVATE1", None) for i, (t, vr) in enumerate(tags.items())]
    e = spark.createDataFrame(rows, "object_id string, path string, ord int, tag string, vr string, raw binary, item_count int")
    out, audit = deident.deidentify(e)
    assert {r.tag for r in out.collect() if r.raw and r.ord < len(tags)} - {"00120062", "00120063"} == {"00180015"}
    assert {r.tag for r in audit.collect()} == set(tags) - {"00180015"}
    content = spark.createDataFrame([("o", "0040A730", 0, "0040A730", "SQ", None, 1)], e.schema)
    counts = lambda out: {r.item_count for r in out.where("tag = '0040A730'").collect()}
    assert counts(deident.deidentify(content)[0]) == {0}
    assert counts(deident.deidentify(content, actions=dictionary.actions(spark, content=False))[0]) == {1}
    assert len(dictionary.action_rows()) == len({t for t, _, _ in dictionary.action_rows()}) == 652
    assert dictionary.uids(spark).count() == dictionary.uids(spark).select("uid").distinct().count() == 494
