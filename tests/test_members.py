import gzip
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import members as M


def got(rows):
    return sorted(((r.file or "").rsplit("/", 1)[-1], r.member, r.row, dict(r.cells) if r.cells is not None else None, r.corrupt) for r in rows.collect())


def xport(rows):
    """A small XPORT v5 table of a number (8 bytes) and a text (4 bytes)."""
    pad = lambda b, n: b + b" " * (n - len(b))
    name = lambda kind, length, n, place: struct.pack(">hhhh", kind, 0, length, 0) + pad(n, 8) + b" " * 68 + struct.pack(">i", place) + b" " * 52

    def number(v):
        e, f = 64, v
        while f >= 1:
            f, e = f / 16, e + 1
        return bytes([e]) + int(f * (1 << 56)).to_bytes(7, "big")

    names = name(1, 8, b"SEQN", 0) + name(2, 4, b"CODE", 8)
    body = b"".join(number(n) + pad(c, 4) for n, c in rows)
    fill = lambda b: b + b" " * (-len(b) % 80)
    head = b"HEADER RECORD*******"
    return pad(head + b"LIBRARY HEADER RECORD!!!!!!!", 80) + pad(head + b"NAMESTR HEADER RECORD!!!!!!!" + b"000000" + b"0002", 80) + fill(names) + pad(head + b"OBS     HEADER RECORD!!!!!!!", 80) + fill(body)


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "id;name\n1;Zoë\n2;NA\n".encode("cp1252"))
        z.writestr("deep/two.tsv", "id\tname\r\n3\t日本\r\n\r\n4\t\r\n".encode("utf-8-sig"))
        z.writestr("deep/three.txt", "id|name\n5|ü\n".encode("utf-16"))
        z.writestr("x.xpt", xport([(7, b"ab"), (4096, b"")]))
        z.writestr("lines.jsonl", '{"id": 8, "name": "x", "more": {"k": [1]}}\n{"id": 9,\n[1]\n\n{"id": null}\n')
        z.writestr("../out.csv", "id\n99\n")
        z.writestr("/abs.csv", "id\n98\n")
        z.writestr("__MACOSX/m.csv", "id\n97\n")
        z.writestr("deep/.hidden.csv", "id\n96\n")
        z.writestr("picture.png", b"\x89PNG")
    (tmp_path / "plain.csv").write_text('id,name,name\n10,"a, b",c\n11\n12,x,y,z\n13,"two\nlines",q\n14,"never ends\n15,fine,r\n')
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.write("id,name\n16,g\n")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "list.json").write_text(json.dumps([{"id": 17}, {"id": "18"}]))
    (tmp_path / "empty.csv").write_text("")
    return tmp_path


def expected():
    return sorted(
        [
            ("a.zip", "one.csv", 0, {"id": "1", "name": "Zoë"}, None), ("a.zip", "one.csv", 1, {"id": "2", "name": None}, None),
            ("a.zip", "deep/two.tsv", 0, {"id": "3", "name": "日本"}, None), ("a.zip", "deep/two.tsv", 1, {"id": "4", "name": None}, None),
            ("a.zip", "deep/three.txt", 0, {"id": "5", "name": "ü"}, None),
            ("a.zip", "x.xpt", 0, {"SEQN": "7", "CODE": "ab"}, None), ("a.zip", "x.xpt", 1, {"SEQN": "4096", "CODE": None}, None),
            ("a.zip", "lines.jsonl", 0, {"id": "8", "name": "x", "more": '{"k": [1]}'}, None), ("a.zip", "lines.jsonl", 1, None, '{"id": 9,'), ("a.zip", "lines.jsonl", 2, None, "[1]"), ("a.zip", "lines.jsonl", 3, {"id": None}, None),
            ("a.zip", "picture.png", 0, None, "unknown format: .png"),
            ("plain.csv", None, 0, {"id": "10", "name": "a, b", "name.1": "c"}, None), ("plain.csv", None, 1, {"id": "11", "name": None, "name.1": None}, None), ("plain.csv", None, 2, None, "12,x,y,z"),
            ("plain.csv", None, 3, {"id": "13", "name": "two\nlines", "name.1": "q"}, None), ("plain.csv", None, 4, None, '14,"never ends'), ("plain.csv", None, 5, {"id": "15", "name": "fine", "name.1": "r"}, None),
            ("packed.csv.gz", None, 0, {"id": "16", "name": "g"}, None), ("broken.zip", None, 0, None, "BadZipFile: not an archive"),
            ("list.json", None, 0, {"id": "17"}, None), ("list.json", None, 1, {"id": "18"}, None),
        ],
        key=lambda r: (r[0], r[1] or "", r[2]),
    )


def test_mixed_formats_encodings_and_broken_rows(spark, folder):
    rows = M.read_members(spark, str(folder))
    assert sorted(((r.file.rsplit("/", 1)[-1], r.member, r.row, dict(r.cells) if r.cells is not None else None, r.corrupt) for r in rows.collect()), key=lambda r: (r[0], r[1] or "", r[2])) == expected()
    # a partition for each member and file
    assert rows.rdd.getNumPartitions() == 6 + 5


def test_a_store_that_only_spark_reads(spark, folder):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.members.link./in", f"file://{folder}")
    rows = M.read_members(spark, "viewfs://members/in")
    assert sorted(((r.file.rsplit("/", 1)[-1], r.member, r.row, dict(r.cells) if r.cells is not None else None, r.corrupt) for r in rows.collect()), key=lambda r: (r[0], r[1] or "", r[2])) == expected()


def test_a_member_larger_than_a_batch_is_streamed(spark, tmp_path, monkeypatch):
    n = 30_000
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.csv", "id,text\n" + "".join(f"{k},{'x' * (k % 50)}\n" for k in range(n)))
        z.writestr("cut.csv.gz", gzip.compress("".join(["id\n", *(f"{k * 7919 % 100003}\n" for k in range(40_000))]).encode())[:-3000])
    read = 0
    with zipfile.ZipFile(tmp_path / "big.zip") as z, z.open("big.csv") as stream:
        rows = M._batches("f", "m", M.rows_of(stream, "big.csv"))
        assert next(rows).num_rows == M.BATCH and stream.tell() < 1_000_000 and stream.tell() > read
    df = M.read_members(spark, f"{tmp_path}/*.zip")
    one = M.columns_of(df.filter("member = 'big.csv'"), ["id", "text", "absent"]).agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("s"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("l"), F.count("absent").alias("a")).first()
    assert tuple(one) == (n, n * (n - 1) // 2, sum(k % 50 for k in range(n)), 0)
    cut = df.filter("member = 'cut.csv.gz'")
    assert cut.filter("row = -1 AND corrupt LIKE '%Error%'").count() == 1 and cut.filter("corrupt IS NULL").count() > 10_000


@pytest.mark.parametrize(("raw", "name"), [(b"a\xe9b", "cp1252"), ("aé".encode(), "utf-8-sig"), (b"a\x81", "latin-1"), ("é".encode()[:1], "utf-8-sig"), (b"", "utf-8-sig")])
def test_encodings(raw, name):
    assert M.encoding_of(raw, False) == name


def test_delimiters_and_names():
    assert M.delimiter_of("a;b\n1,5;2,5\n", ".csv") == ";" and M.delimiter_of("a\n1\n", ".tsv") == "\t" and M.delimiter_of("a|b|c\n1|2|3\n", ".txt") == "|"
    assert [M.safe(n) for n in ("a.csv", "d/a.csv", "d/", "/a.csv", "d/../a.csv", "..\\a.csv", "C:/a.csv", "__MACOSX/a", ".a")] == [True, True, *[False] * 7]
