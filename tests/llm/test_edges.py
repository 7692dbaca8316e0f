"""Every operator and stage on an empty table, and on one with nulls, repeated rows, very long texts and columns of clashing names."""
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, exact_dedup, language, licences, line_dedup, near_dedup, pieces, pii, queries, urls, warc

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"palabra{k % 4001}" for k in range(60_000))
ONE_WORD = "ab" * 150_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"), (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"), (1, "Another text of the same id, which stands alone here.", "en"),
    (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (5, LONG, "es"), (6, LONG, "es"), (7, ONE_WORD, None), (None, None, None), (None, "The quick brown fox jumps over the lazy dog and runs away from it.", None), (8, "x", "en"), (9, "\U0001f600 \u0000 end", "en"),
]
CLASHING = ["ID", "Mark", "n", "row", "digest", "lang_pred", "ids", "key", "gone", "n_tokens"]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumns({c: F.lit(c) for c in CLASHING}).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))


BENCHMARK = [(1, "jumps over the lazy dog and runs away from it"), (2, None), (3, "")]

#: Operator on (spark, docs), and whether it gives a row for each document.
OPERATORS = {
    "op1": (lambda spark, d: pieces.digests(d, queries.piece_model()), True), "op2": (lambda spark, d: near_dedup.near_duplicates(d), True),
    "op3": (lambda spark, d: language.predict(d, language.fit(d)), True), "op4": (lambda spark, d: decontamination.leaks(d, spark.createDataFrame(BENCHMARK, "item_id long, text string")), False),
    "op5": (lambda spark, d: licences.scan(d), True), "op6": (lambda spark, d: line_dedup.repeated_lines(d), False), "op7": (lambda spark, d: exact_dedup.duplicates(d), True),
    "op10": (lambda spark, d: pii.mask(d, key="k"), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    run, each = OPERATORS[name]
    empty = run(spark, frame(spark, []))
    assert empty.collect() == []
    found = run(spark, frame(spark, ROWS))
    assert found.columns == empty.columns
    rows = found.collect()
    if each:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    else:
        assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS} and rows


def test_what_the_odd_rows_get(spark):
    docs = frame(spark, ROWS)
    near = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(docs).collect()))
    assert ("5", 4001, "5", True) in near and ("6", 4001, "5", False) in near and ("None", 10, "1", False) in near and ("4", 0, "4", True) in near and near.count(("1", 10, "1", True)) == 2
    exact = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.duplicates(docs).collect()}
    assert {(5, 6, 2), (3, 3, 3), (2, 3, 3), (1, 1, 3), (None, 1, 3), (7, 7, 1)} <= exact
    base = {(r.doc_id, r.n_words) for r in licences.scan(docs).collect()}
    assert {(5, 60_000), (7, 1), (2, 0)} <= base
    leaks = {(r.doc_id, r.item_id) for r in OPERATORS["op4"][0](spark, docs).collect()}
    assert leaks == {(1, 1), (None, 1)}
    assert {r.doc_id: r.n_tokens for r in pieces.digests(docs.filter("doc_id IN (2, 3)"), queries.piece_model()).collect()} == {2: 2, 3: 2}  # begin and end
    judged = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs)).collect() if r.doc_id in (2, 3, 4, 5)}
    assert judged == {2: "und", 3: "und", 4: "und", 5: "es"}


DROPS = {
    "near": near_dedup.drop_near_duplicates, "exact": exact_dedup.drop_duplicates, "lines": line_dedup.drop_repeated_lines, "language": language.drop_rejected,
    "leaks": lambda d: decontamination.drop_leaks(d, d.sparkSession.createDataFrame(BENCHMARK, "item_id long, text string")),
}


@pytest.mark.parametrize("name", DROPS)
def test_drops_keep_columns_and_rows_of_other_texts(spark, name):
    drop, docs = DROPS[name], frame(spark, ROWS)
    assert drop(frame(spark, [])).collect() == [] and drop(frame(spark, [])).columns == docs.columns
    left = drop(docs)
    assert left.columns == docs.columns and left.select(*CLASHING).distinct().count() == 1
    texts = [r.text for r in left.select("text").collect()]
    assert set(texts) <= {r[1] for r in ROWS} or name == "lines"
    assert "Another text of the same id, which stands alone here." in texts


def test_urls_and_records_of_empty_and_odd_pages(spark):
    model = urls.fit(spark.createDataFrame(urls.LABELLED, "url string, label int"))
    odd = [(1, None, None), (2, "", ""), (2, "", ""), (None, "http://Example.com/en/" + "a" * 100_000, "x" * 200_000), (3, "://", "y")]
    for rows in ([], odd):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("HOST", "slot", "rule", "ts", "record_id")})
        got = urls.judge(pages, model).collect()
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows) and all(r.verdict in ("allow", "block") for r in got)
        records = warc.resolve(warc.records_of_pages(pages)).collect()
        assert len(records) == 2 * len(rows)


@pytest.mark.parametrize("rows", [[], ROWS], ids=["empty", "odd"])
def test_stages(spark, tmp_path, rows):
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows).drop("ids", "n_tokens")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        n = docs.count()
        docs = corpus_pipeline.scratch.table(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.count() <= n, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert set(columns) < set(docs.columns) and docs.filter("n_tokens <> size(ids)").isEmpty()
    if rows:
        kept = [r.text for r in docs.select("text").collect()]
        assert kept.count(LONG) <= 1 and not any(t and "over the lazy dog" in t for t in kept)
