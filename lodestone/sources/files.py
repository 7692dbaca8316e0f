"""File formats as Spark reads: delimited text, fixed width, stanzas, Markdown tables, XPORT, nested JSON."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, sep: str = ",", required: list[str] | None = None) -> DataFrame:
    """All columns as text; a missing required column is an error before any scan."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_levels(spark: SparkSession, path: str, key: str, prefixes: list[str], width: int = 9) -> DataFrame:
    """Pipe-delimited rows whose key begins with one of the prefixes; other columns as numbers, null where they aren't."""
    df = read_delimited(spark, path, "|", [key]).filter(F.substring(key, 1, width).isin(prefixes))
    return df.select(key, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in df.columns if c != key])


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """columns: name to (first place from 1, width); trimmed, blank to null."""
    lines = spark.read.text(path)
    return lines.select(*[F.nullif(F.trim(F.substring("value", a, n)), F.lit("")).alias(c) for c, (a, n) in columns.items()])


def read_stanzas(spark: SparkSession, path: str, kind: str = "Term") -> DataFrame:
    """[Term] stanzas: id, name, parents (is_a), synonyms, obsolete."""
    s = spark.read.text(path, lineSep="\n\n").filter(F.ltrim("value").startswith(f"[{kind}]"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{tag}: ([^\n]*)$", 1)), F.lit(""))
    many = lambda p: F.expr(f"regexp_extract_all(value, r'{p}', 1)")
    return s.select(one("id").alias("id"), one("name").alias("name"), many(r"(?m)^is_a: (\S+)").alias("parents"), many(r'(?m)^synonym: "([^"]*)"').alias("synonyms"), (F.coalesce(one("is_obsolete"), F.lit("false")) == "true").alias("obsolete"))


def read_commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", header=True, inferSchema=False)


def markdown_table(text: DataFrame, column: str, begin: str, end: str) -> DataFrame:
    """Rows of the pipe table between two markers as (row, cells); the header is row 0, the rule line is left out."""
    inner = F.regexp_extract(column, rf"(?s){begin}(.*?){end}", 1)
    lines = F.filter(F.transform(F.split(inner, "\n"), lambda c: F.trim(c)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return text.select(F.posexplode(F.transform(lines, cells)).alias("row", "cells"))


def flatten_json(df: DataFrame, column: str, schema: str, path: str | None = None) -> DataFrame:
    """A JSON text column to columns; with path, one row for each element of that array field."""
    parsed = df.withColumn("_j", F.from_json(column, schema)).drop(column)
    if path is None:
        return parsed.select(*[c for c in parsed.columns if c != "_j"], "_j.*")
    return parsed.withColumn("_e", F.explode_outer(F.col(f"_j.{path}"))).select(*[c for c in parsed.columns if c != "_j"], "_e.*")


def fhir_resources(bundles: DataFrame, column: str, kind: str, schema: str) -> DataFrame:
    """Resources of one type out of FHIR bundles in a JSON text column."""
    entries = F.from_json(F.get_json_object(column, "$.entry"), "array<string>")
    resource = bundles.select(F.explode(entries).alias("_e")).select(F.get_json_object("_e", "$.resource").alias("_r"))
    return resource.filter(F.get_json_object("_r", "$.resourceType") == kind).select(F.from_json("_r", schema).alias("_j")).select("_j.*")


def ibm_double(raw: bytes) -> float | None:
    """An IBM/360 hexadecimal float of up to eight bytes; a missing-value code gives None."""
    raw = raw.ljust(8, b"\0")
    if raw[1:] == b"\0" * 7 and raw[:1] in b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        return None
    sign = -1.0 if raw[0] & 0x80 else 1.0
    return sign * int.from_bytes(raw[1:], "big") / float(1 << 56) * 16.0 ** ((raw[0] & 0x7F) - 64)


def xport_layout(raw: bytes) -> tuple[list[dict], int]:
    """Variables (name, kind, length, place) of the first member of an XPORT v5 file, and where its records begin."""
    at = raw.index(b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!")
    count = int(raw[at + 54 : at + 58])
    at += 80
    names = []
    for i in range(count):
        rec = raw[at + 140 * i : at + 140 * (i + 1)]
        kind, _, length, _ = struct.unpack(">hhhh", rec[:8])
        names.append({"name": rec[8:16].decode("ascii").strip(), "label": rec[16:56].decode("ascii", "replace").strip(), "number": kind == 1, "length": length, "place": struct.unpack(">i", rec[84:88])[0]})
    head = raw.index(b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!", at)
    return names, head + 80


def read_xport(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SAS XPORT v5 files as long rows (file, row, name, number, text); files are dealt to tasks, records decoded there."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    want = set(columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                names, start = xport_layout(raw)
                size = sum(v["length"] for v in names)
                body = raw[start:]
                out = []
                for i in range(len(body) // size):
                    rec = body[i * size : (i + 1) * size]
                    if not rec.strip(b" "):
                        continue
                    for v in names:
                        if v["name"] in want:
                            cell = rec[v["place"] : v["place"] + v["length"]]
                            number = ibm_double(cell) if v["number"] else None
                            out.append((name, i, v["name"], number, None if v["number"] else cell.decode("latin-1").strip()))
                yield pd.DataFrame(out, columns=["file", "row", "name", "number", "text"])

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("name", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType())])
    return files.mapInPandas(rows, schema)
