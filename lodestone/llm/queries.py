"""The registered queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import centroids, decontamination, exact_dedup, language, licences, line_dedup, near_dedup, pieces, pii, resampling, set_join, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def piece_model(path: str | None = None) -> bytes:
    """The SentencePiece model at path, by default the installed public one; about 0.5 MB, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.read_model(path)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), piece_model())


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=5, threshold=(85, 100))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held))
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item: doc_id, item_id, distance, budget."""
    found = decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "budget")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line: doc_id, line (from 0), of_doc, of_line (the earliest line that it repeats), exact."""
    return line_dedup.repeated_lines(_read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_read(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records of the pages, resolved: record_id, canonical_url, ts, resolution, refers_to, headers (as sorted text)."""
    found = warc.resolve(warc.records_of_pages(_read(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(lines, ";"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(spark.createDataFrame(urls.LABELLED, "url string, label int"))
    return urls.judge(_read(spark, sf_dir, "pages"), model)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text masked: doc_id, n_entities, text."""
    return pii.mask(_read(spark, sf_dir, "documents"), key=PII_KEY).select("doc_id", "n_entities", "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_read(spark, sf_dir, "embeddings"))


#: The key of the registered query; in production it comes from a secret store.
PII_KEY = "registered-query"

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_near_dedup, op3_language_id, op4_decontamination, op5_licence_scan,
        op6_line_dedup, op7_exact_dedup, op8_warc_revisits, op9_url_filter, op10_pii_surrogates,
        op11_importance_resampling, op12_ngram_jaccard_join, op13_centroid_clustering,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def jaccard_sql(width: int, per_cent: int, more: str = "") -> str:
    """Components of documents (unique doc_ids) whose sets of shingles agree to so many hundredths; every pair that shares a shingle is counted."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS p FROM w WHERE len(w) > 0),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + {width - 1}], ' ') AS g FROM placed),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {per_cent} * (x.n + y.n - c)),
  both_ways AS (FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(first, doc_id) AS component_id{more}
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS first FROM reach GROUP BY node) USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
  lines AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS line, translate(trim(unnest(l), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{UPPER}', '{LOWER}') AS s FROM cut),
  whole AS (SELECT doc_id, line, s FROM lines WHERE s <> ''),
  firsts AS (SELECT s, min({{'d': doc_id, 'l': line}}) AS w FROM whole GROUP BY s),
  places AS (SELECT s, w, unnest(range(length(s))) AS p FROM firsts WHERE length(s) >= {line_dedup.NEAR_CHARS}),
  variants AS (SELECT s, w, p, substr(s, 1, p) || substr(s, p + 2) AS v FROM places),
  replaced AS (SELECT s, min(other) AS other FROM (SELECT s, w, min(w) OVER (PARTITION BY v, p) AS other FROM variants) WHERE other < w GROUP BY s),
  shorter AS (SELECT a.s, min(b.w) AS other FROM variants a JOIN firsts b ON a.v = b.s WHERE b.w < a.w AND length(b.s) >= {line_dedup.NEAR_CHARS} GROUP BY a.s),
  longer AS (SELECT b.s, min(a.w) AS other FROM variants a JOIN firsts b ON a.v = b.s WHERE a.w < b.w AND length(b.s) >= {line_dedup.NEAR_CHARS} GROUP BY b.s),
  near AS (SELECT s, min(other) AS other FROM (FROM replaced UNION ALL FROM shorter UNION ALL FROM longer) GROUP BY s),
  found AS (SELECT doc_id, line, CASE WHEN {{'d': doc_id, 'l': line}} > f.w THEN f.w ELSE n.other END AS place, {{'d': doc_id, 'l': line}} > f.w AS exact
    FROM whole JOIN firsts f USING (s) LEFT JOIN near n USING (s))
SELECT doc_id, line, place.d AS of_doc, place.l AS of_line, exact FROM found WHERE place IS NOT NULL""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS s FROM documents),
  g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""",
    "op8_warc_revisits": f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag FROM pages),
  records AS (
    SELECT page_id * 2 AS record_id, url, page_id * 10 AS ts, CASE WHEN page_id % 5 = 0 THEN 304 ELSE 200 END AS status, tag, tag AS raw_tag, n AS size, false AS again FROM p
    UNION ALL SELECT page_id * 2 + 1, url, page_id * 10 + 5, 304, CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE tag END, CASE WHEN page_id % 7 = 0 THEN '"changed"' ELSE 'W/' || tag END, 0, true FROM p),
  bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS b FROM records),
  canon AS (SELECT *, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www[.]|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') ||
      coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{warc.TRACKING}'))), '&'), ''), '') AS canonical_url, ts::HUGEINT * 1000000000000 + record_id AS moment FROM bare),
  fulls AS (SELECT canonical_url, moment, record_id, tag, raw_tag, size FROM canon WHERE status = 200),
  joined AS (SELECT c.*, f.record_id AS ref, f.tag AS ref_tag, f.size AS ref_size FROM canon c ASOF LEFT JOIN fulls f ON c.canonical_url = f.canonical_url AND c.moment > f.moment),
  judged AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN ref IS NULL THEN 'missing' WHEN tag = ref_tag THEN 'resolved' ELSE 'validator-mismatch' END AS resolution FROM joined)
SELECT record_id, canonical_url, ts, resolution, CASE WHEN resolution = 'resolved' THEN ref END AS refers_to,
  (CASE WHEN again THEN 'cache-control=max-age=60;' ELSE '' END) || 'content-length=' || (CASE WHEN resolution = 'resolved' THEN ref_size ELSE size END) ||
  (CASE WHEN NOT again OR resolution = 'resolved' THEN ';content-type=text/html' ELSE '' END) || ';date=' || ts || ';etag=' || raw_tag AS headers
FROM judged""",
    "op9_url_filter": urls.oracle(),
    "op11_importance_resampling": resampling.oracle(),
    "op2_near_dedup": jaccard_sql(5, 85, ", coalesce(first, doc_id) = doc_id AS kept"),
    "op12_ngram_jaccard_join": jaccard_sql(3, 90),
    "op13_centroid_clustering": centroids.oracle(),
}
