"""Records, places and runs on small frames."""
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import records
from lodestone.operators import timeseries as T


def test_nearest_alarm(spark):
    infections = spark.createDataFrame([("a", 30), ("b", 30)], "id string, day long")
    alarms = spark.createDataFrame([("a", 1), ("a", 20), ("a", 29), ("b", 1)], "id string, alarm long")
    got = T.nearest_event(infections, "id", "day", alarms, "alarm", -14, 7).collect()
    assert {r.id: r.offset for r in got} == {"a": -1, "b": None}


def test_bouts_and_gaps(spark):
    on = [1] * 6 + [0, 0] + [1] * 4 + [0] * 3 + [1] * 9
    df = spark.createDataFrame([("p", i, bool(x), True) for i, x in enumerate(on)] + [("q", i, True, i != 5) for i in range(12)] + [("r", i + (i > 5), True, True) for i in range(12)], "id string, m long, a boolean, ok boolean")
    got = {r.id: r.minutes for r in T.bout_minutes(df, "id", "m", F.col("a"), F.col("ok"), 10, 2).collect()}
    assert got == {"p": 12, "q": 0, "r": 0}
    rest = {r.id: (r.start, r.end) for r in T.main_rest_window(df, ["id"], "m", F.col("a"), 2).collect()}
    assert rest == {"p": (0, 11), "q": (0, 11), "r": (0, 5)}


def test_ranks_limits_and_coverage(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, 5.0, True), (3, 4.0, True), (4, 9.0, False), (5, None, True)], "id int, s double, ok boolean").withColumn("g", F.lit("x"))
    assert {r.id: r.rk for r in records.competition_rank(df, "s", F.col("ok"), ["g"], "rk").collect()} == {1: 1, 2: 1, 3: 3, 4: None, 5: None}
    kept, record = records.limit_with_record(df, ["g"], [F.col("id")], 2)
    assert sorted(r.id for r in kept.collect()) == [1, 2] and tuple(record.first()) == ("x", 5, 2, True)
    c = records.coverage(df.select("id"), df.filter("id > 3").select("id").union(spark.createDataFrame([(9,)], "id int")), "id").first()
    assert (c.wanted, c.matched, c.missing, c.extra) == (5, 2, 3, 1)


def test_text_keys(spark):
    row = spark.createDataFrame([("12 Main St., Suite 4", "mondo_0005148", 'a "cure" and a CURE', "Site 12")], "a string, c string, t string, n string")
    got = row.select(S.address_key(F.col("a")), S.curie(F.col("c")), S.forbidden_hits(F.col("t"), ["cure"]), S.generic_name(F.col("n"), F.lit("x"))).first()
    assert tuple(got) == ("12 MAIN ST", "MONDO:0005148", [(1, "CURE")], True)
