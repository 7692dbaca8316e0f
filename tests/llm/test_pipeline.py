"""Each stage of the pipeline on its own input."""
import pytest

from tests.llm.data import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out = corpus_pipeline.scratch.table(out, "stage")
        left = out.count()
        assert left <= n and out.select("doc_id").distinct().count() == left
        last = k == len(corpus_pipeline.STAGES) - 1
        assert out.columns[: len(columns)] == columns and (last or len(out.columns) == len(columns))
        docs, n = out, left
    assert docs.filter("n_tokens <> size(ids)").isEmpty() and docs.filter("round_trip").count() > 0.9 * n
    assert n > 0.5 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rows_equal_a_plain_pipeline(spark, tmp_path):
    """run() over a small corpus with planted copies, lines, leaks and foreign texts, row by row against plain Python; the classifier's judgement is taken from its own query, which test_language checks."""
    import random

    import sentencepiece

    from lodestone.llm import decontamination, language
    from tests.llm.data import rows, texts_of
    from tests.llm.test_decontamination import least
    from tests.llm.test_dedup import components_of, lines_by_force
    from tests.llm.test_pieces import PATH

    rng = random.Random(3)
    langs = dict(rows("documents", "doc_id", "lang"))
    docs = [(i, t, langs[i]) for i, t in texts_of("documents") if t and 150 < len(t) < 1500][:45]
    items = [(i, t) for i, t in rows("benchmark", "item_id", "text") if 80 <= len(t) <= 200][:6]
    plain = [t for _, t, lang in docs if lang]
    docs += [(2000 + k, plain[k] + " y al fin" * (k % 2), None) for k in range(6)]  # near and exact copies
    docs += [(3000 + k, plain[10 + k] + "\n" + "a line that many of these texts share, word for word" + "s" * (k % 2) + "\nits own end " + str(k), None) for k in range(5)]
    docs += [(4000 + k, "before it " + items[k][1][:30] + "#" + items[k][1][31:] + " after it", None) for k in range(4)]
    docs += [(5000, "Ω ψ ξ " * 200, None), (5001, None, None), (5002, "12 34 !!", None)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    judged = {r.doc_id: r.rejected for r in language.predict(frame, language.fit(frame)).collect()}
    texts = {i: t for i, t, _ in docs if not judged[i]}
    assert not {5000, 5001, 5002} & set(texts) and len(texts) > 50
    drop = {}
    for doc, line, *_ in lines_by_force(list(texts.items())):
        drop.setdefault(doc, set()).add(line)
    texts = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop.get(i, ())) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if i not in drop or any(x.strip() for x in t.split("\n"))}
    texts = {i: texts[i] for i, (_, first) in components_of(list(texts.items()), 80).items() if first == i}

    def leaks(text):
        body = decontamination.normal(text)
        for _, t in items:
            p = decontamination.normal(t)
            if least(p, body) <= max(0, min(int(len(p) * decontamination.RATE), len(p) // 8 - 1)):
                return True
        return False

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    assert not {4000, 4001, 4002, 4003} & set(texts) and drop and len(texts) > 40
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == texts
    for i, t in texts.items():
        ids = library.encode(t, out_type=int, add_bos=True, add_eos=True)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and got[i].round_trip == (library.decode(ids) == t)
        assert got[i].n_chars == len(t)
