import struct

import pytest

from lodestone.sources import files
from lodestone.sources.tables import TableStore


def test_store_round_trip_and_drift(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    store.write(spark.createDataFrame([(1, 2)], "id int, x int"), "t", "test", "a")
    store.write(spark.createDataFrame([(2, "z")], "id int, x string"), "t", "test", "b")
    assert store.sources("t") == ["a", "b"]
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "2"), (2, "z")]
    assert [n["rows"] for n in store.notes("t")] == [1, 1]
    assert store.lookup("t", {"id": [2]}) == [{"id": 2, "x": "z"}]
    store.write(spark.createDataFrame([(9, 9)], "id int, x int"), "t", "test", "a")
    assert store.read("t", source="a").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read("missing")


def test_a_write_that_fails_leaves_the_old_table_and_readers_keep_theirs(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    write = lambda rows: store.write(spark.createDataFrame(rows, "id int"), "t", "test")
    write([(1,), (2,)])
    reader = store.read("t")
    with pytest.raises(Exception, match="broken"):
        store.write(spark.range(2).selectExpr("CASE WHEN id = 1 THEN raise_error('broken') ELSE 1 END AS id"), "t", "test")
    assert store.read("t").count() == 2 and store.notes("t")[0]["rows"] == 2
    write([(3,)])
    assert reader.count() == 2 and [r.id for r in store.read("t").collect()] == [3] and store.notes("t")[0]["rows"] == 1
    write([(4,)])
    write([(5,)])
    assert len(list((tmp_path / "table=t" / "source=main").glob("version=*"))) == 3  # the last two and what the failed write left
    with pytest.raises(FileNotFoundError):
        store.read("t", source="other")


def test_delimited_and_fixed_width(spark, tmp_path):
    (tmp_path / "a.txt").write_text("GEO_ID|E1\n0500000US01001|5\n0400000US01|x\n")
    got = files.read_levels(spark, str(tmp_path / "a.txt"), "GEO_ID", ["0500000US"]).collect()
    assert [tuple(r) for r in got] == [("0500000US01001", 5.0)]
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path / "a.txt"), "|", ["nope"])
    (tmp_path / "f.txt").write_text("00001 A00   1 Cholera\n")
    assert tuple(files.read_fixed_width(spark, str(tmp_path / "f.txt"), {"code": (7, 6), "name": (15, 20)}).first()) == ("A00", "Cholera")


def test_stanzas_and_markdown(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: one\nis_a: X:0 ! root\nsynonym: "uno" EXACT []\n\n[Typedef]\nid: r\n')
    r = files.read_stanzas(spark, str(tmp_path / "o.obo")).collect()
    assert [(x.id, x.name, x.parents, x.synonyms, x.obsolete) for x in r] == [("X:1", "one", ["X:0"], ["uno"], False)]
    md = spark.createDataFrame([("x <!-- a -->\n| k | v |\n|---|---|\n| 1 | 2 |\n<!-- b -->",)], "t string")
    assert [x.cells for x in files.markdown_table(md, "t", "<!-- a -->", "<!-- b -->").orderBy("row").collect()] == [["k", "v"], ["1", "2"]]


def test_json_and_fhir(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": 2}]}'), (2, "broken")], "id int, j string")
    assert sorted(map(tuple, files.flatten_json(df, "j", "a array<struct<b:int>>", "a").collect()), key=str) == [(1, 1), (1, 2), (2, None)]
    bundle = spark.createDataFrame([('{"entry": [{"resource": {"resourceType": "Patient", "id": "p"}}, {"resource": {"resourceType": "Other"}}]}',)], "j string")
    assert [r.id for r in files.fhir_resources(bundle, "j", "Patient", "id string").collect()] == ["p"]


def test_xport(spark, tmp_path):
    def pad(b):
        return b + b" " * (-len(b) % 80)

    def name(kind, length, n, place):
        return struct.pack(">hhhh", kind, 0, length, 0) + n.ljust(8).encode() + b" " * 60 + b"\0" * 8 + struct.pack(">i", place) + b"\0" * 52

    one = bytes([0x41, 0x10]) + b"\0" * 6
    raw = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!".ljust(80, b"0") * 2
    raw += (b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!000000000200000000000000000000  ").ljust(80)
    raw += pad(name(1, 8, "SEQN", 0) + name(2, 4, "SEX", 8))
    raw += b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!".ljust(80, b"0") + pad(one + b"M   " + b"." + b"\0" * 7 + b"F   ")
    (tmp_path / "x.xpt").write_bytes(raw)
    got = files.read_xport(spark, str(tmp_path / "x.xpt"), ["SEQN", "SEX"]).orderBy("row", "name").collect()
    assert [(r.row, r.name, r.number, r.text) for r in got] == [(0, "SEQN", 1.0, None), (0, "SEX", None, "M"), (1, "SEQN", None, None), (1, "SEX", None, "F")]
