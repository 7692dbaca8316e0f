import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import governance

GENERIC = {
    "Research Site": True, "Pfizer Investigational Site": True, "Local Institution - 0012": True, "Investigational Site Number : 8400001": True, "Site 101": True, "Novartis Investigative Site": True,
    "For additional information regarding investigative sites for this trial, contact 1-877-CTLILLY": True, "Johns Hopkins University Clinical Research Site": False, "Duke Clinical Research Site": False,
    "Mayo Clinic in Rochester": False, "Stanford University": False, None: False, "": False,
    "Site Reference ID/Investigator# 56266": True, "SIte reference ID 304": True, "Contact Medtronic for Exact Locations": True, "Contact Medtronic for exact location": True, "IQVIA Virtual Site": True,
    "Remote trial - anyone residing in the United States": True, "Online Patient Enrollment System": True, "Nationwide home based study program": True, "Alethios Digital Research Platform (Decentralized)": True,
    "Participants' homes": True, "Remote Monitoring Clinic": False, "Virginia Mason Medical Center": False, "Contact Lens Institute": False,
    "Clinical Research Site": True, "Clinical Trial Sites": True, "Acme clinical trial site 7": True, "Three Words Before Research Site": False, "Opposite House": False,
}


def test_generic_names(spark):
    df = spark.createDataFrame([(n,) for n in GENERIC], "n string")
    got = {r.n: r.g for r in df.select("n", S.generic_name(F.col("n"), F.lit(None).cast("string")).alias("g")).collect()}
    assert got == GENERIC


def test_names_that_are_only_the_city(spark):
    cases = [("Denver", "Denver", "Colorado", True), ("Denver, Colorado", "Denver", "Colorado", True), ("Denver Health", "Denver", "Colorado", False), ("Denver", "Aurora", "Colorado", False), ("Denver", None, None, False), ("Denver USA", "Denver", None, True), ("Denver, Colorado (USA)", "Denver", "Colorado", True), ("", "", "", False)]
    df = spark.createDataFrame(cases, "n string, c string, s string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", S.generic_name(F.col("n"), F.col("c"), F.col("s"))).collect())


FORBIDDEN = {
    "this proves X": [(1, "proves")], 'the word "proves" and `cures`': [], 'he said "this proves all"': [(1, "proves")],
    "Avoid (unless directly supported): diagnosed by AI; proves; cures; x": [], "Never write proves or cures.": [(1, "proves")], "Never write: proves or cures.": [], "this proves X, never Y": [(1, "proves")], "It cures.\nIt PROVES\r\nnothing": [(1, "cures"), (2, "PROVES")],
    "approves and cured": [], "diagnosed by AI (x)": [(1, "diagnosed by AI")], "never a, proves it": [(1, "proves")], "“cures” ‘proves’": [], None: [], "": [],
}


def test_forbidden_uses(spark):
    df = spark.createDataFrame([(t,) for t in FORBIDDEN], "t string")
    got = {r.t: [tuple(h) for h in r.h] for r in df.select("t", S.forbidden_hits(F.col("t"), ["proves", "cures", "diagnosed by AI"]).alias("h")).collect()}
    assert got == FORBIDDEN
    # a phrase is text and no pattern
    odd = spark.createDataFrame([("a.b and axb and a+b",)], "t string").select(S.forbidden_hits(F.col("t"), ["a.b", "a+b"]).alias("h")).first().h
    assert [h.term for h in odd] == ["a.b", "a+b"]


@pytest.mark.parametrize(("text", "key"), [("São Paulo", "sao paulo"), ("St. Paul", "saint paul"), ("Saint Paul", "saint paul"), ("L'Anse", "lanse"), ("Ft Worth,", "fort worth"), ("Mt. Vernon", "mount vernon"), ("Ste. Genevieve", "sainte genevieve"), ("", ""), ("Winston-Salem", "winston salem")])
def test_city_keys(spark, text, key):
    assert spark.createDataFrame([(text,)], "t string").select(S.city_key(F.col("t"))).first()[0] == key


@pytest.mark.parametrize(("name", "kind"), [
    ("birthdate", "date"), ("zipcode", "geography"), ("o_orderdate", "date"), ("c_nationkey", "geography"), ("homeAddress", "geography"), ("patientName", "identity"), ("first_names", "identity"), ("DOB", "date"), ("ageAtVisit", "age"),
    ("age_years", "age"), ("SSN4", "identity"), ("Lat", "geography"), ("ZIP_plus4", "geography"), ("shipdate", "date"), ("page", None), ("stage", None), ("message", None), ("update", None), ("candidate", None), ("latest", None), ("statement", None),
    ("average", None), ("l_quantity", None), ("namespace", None), ("username", "identity"), ("capacity", None), ("scale", None),
])
def test_kinds_of_column_names(name, kind):
    assert S.sensitive_kind(name) == kind


def test_columns_are_judged_by_names_and_values(spark):
    df = spark.createDataFrame([("a@b.org", "x", 1, None), ("no", "555-123-4567", 2, None), (None, "y", 3, None)], "note string, contact string, age int, birthdate string")
    got = {r.column: (r.by_name, r.refused, r.filled) for r in governance.sensitive_columns(df).collect()}
    assert got == {"note": (None, 1, 2), "contact": (None, 1, 3), "birthdate": ("date", 0, 0)}
    assert governance.sensitive_columns(df.select("age")).collect() == []


def test_values_within_longer_numbers_count_in_columns(spark):
    df = spark.createDataFrame([("id 123-45-67890",), ("x2024-01-31y",), ("2024-01-3",), (None,)], "note string")
    assert [tuple(r) for r in governance.sensitive_columns(df).collect()] == [("note", None, 2, 3)]


def test_word_borders_are_those_of_ascii(spark, tmp_path):
    from lodestone.plans import QUERIES

    df = spark.createDataFrame([(1, "CI\u00d3NBO, model"), (2, "xNBO model"), (3, "\u00e9123-45-6789"), (4, "\u00e9licensed under\u00e9"), (5, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda q, c: {r.doc_id: r[c] for r in QUERIES[q](spark, str(tmp_path)).collect()}
    assert run("phrase_tiers", "acronym") == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert run("pii_scan", "kind") == {1: None, 2: None, 3: "ssn", 4: None, 5: None}
    assert run("mention_scan", "mention") == {4: "licensed under"}
