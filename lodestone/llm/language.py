"""Language ID by nearest centroids.

A text becomes a vector of hashed character 1- to 3-grams over its letters, weighted by
log term frequency and inverse document frequency and scaled to length one.  Each
language has several centroids, from spherical k-means; the nearest centroid by cosine
names the language, and its cosine is the score.  A text whose cosine stays under the
floor of that language for texts of its length is rejected as unlike all that was learned.

Floors come from held-out cosines: each half of the sample is scored against centroids of
the other half, whole and cut to every power of two of letters, and a floor is SLACK of
the 1% quantile in its band.  A band that no held-out text reached takes the floor of the
nearest shorter one.  Texts of a few letters have floors near 0: they are too short to reject.

Document frequencies and the number of documents come from all training rows; the centroids are fitted on a
bounded sample: SAMPLE rows a language at about, chosen by a hash of doc_id and text, repeated rows once.  Each
language is fitted in a task of its own; only centroids and floors go to the driver, so their size grows with the
number of languages, which MAX_LANGUAGES bounds (more is an error: such labels name no languages).  Texts that
are null or have no letter (a symbol such as an emoji is none) get `und`, score 0, and are rejected.
With nothing to learn from, every text gets `und`.  Ties go to the language that sorts first.
Rows are judged each for themselves, whatever their doc_id; extra columns don't matter.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch

BITS, SAMPLE, CENTROIDS, MAX_LANGUAGES = 16, 250, 4, 1000
DIMENSIONS = 1 << BITS
#: Share of the 1% quantile of held-out own-language cosines that a text must reach.
SLACK = 0.5
GRAMS = 3
#: Bands of text length: band b has texts of 2**b characters to twice that, the last one all longer texts.
BANDS = 18


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; planes from the fourth on have none."""
    table = np.zeros(0x110000, bool)
    table[:0x40000] = [chr(i).isalpha() for i in range(0x40000)]
    return table


def codes(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Code points of the lower-cased letters, other runs as one space, without the outer spaces; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters[code]
    if not ok.any():
        return None
    code = np.where(ok, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = ok[1:] | ok[:-1]
    code = code[keep]
    return code[int(code[0] == 32) : len(code) - int(code[-1] == 32)]


def count_grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the hashed 1- to 3-grams of codes."""
    code = np.concatenate([[32], code, [32]]).astype(np.uint64)
    slots = []
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, GRAMS + 1):
        rolled = rolled[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        slots.append((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    counts = np.bincount(np.concatenate(slots).view(np.int64), minlength=DIMENSIONS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def gram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    code = codes(text, letters)
    return None if code is None else count_grams(code)


def band(n: int) -> int:
    return min(BANDS - 1, n.bit_length() - 1)


def weights(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf[slots]).astype(np.float32)
    n = float(np.sqrt(np.dot(v, v)))
    return v / n if n else v


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray  # slot by centroid
    idf: np.ndarray
    floors: np.ndarray  # language by band of length

    def score(self, code: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine and whether it is under the floor."""
        slots, counts = count_grams(code)
        cos = weights(slots, counts, self.idf) @ self.centroids[slots]
        best = np.full(len(self.languages), -1.0, np.float32)
        np.maximum.at(best, self.owner, cos)
        k = int(np.argmax(best))
        score = min(1.0, max(0.0, float(best[k])))
        return self.languages[k], score, score < self.floors[k, band(len(code))]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean and then the rows farthest from those chosen."""
    centre = [int(np.argmax(x @ x.mean(0)))]
    while len(centre) < min(k, len(x)):
        centre.append(int(np.argmin((x @ x[centre].T).max(1))))
    c = x[centre]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _frequencies(batches):
    letters, total, n = letter_table(), np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts = gram_counts(text.as_py(), letters)
            if counts is not None:
                total[counts[0]] += 1
                n += 1
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n))], ["slot", "n"])


def _vectors(idf: np.ndarray):
    """Slots and weights of each text (band -1), and of its letters up to each power of two."""

    def run(batches):
        letters = letter_table()
        for batch in batches:
            rows = []
            for lang, text, half in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "half")), strict=True):
                code = codes(text, letters)
                for b in range(-1, 0 if code is None else band(len(code)) + 1):
                    if code is not None:
                        slots, counts = count_grams(code if b < 0 else code[: 1 << b])
                        rows.append((lang, half, b, len(code), slots.astype(np.int32).tobytes(), weights(slots, counts, idf).tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lang", "half", "band", "n", "slots", "v"])

    return run


def dense(rows: list, seen: np.ndarray) -> np.ndarray:
    """Rows (slots, v) as a matrix over the slots of `seen`, which has all of theirs that matter."""
    x = np.zeros((len(rows), len(seen)), np.float32)
    for i, r in enumerate(rows):
        slots = np.frombuffer(r.slots, np.int32)
        at = np.minimum(np.searchsorted(seen, slots), len(seen) - 1)
        ok = seen[at] == slots
        x[i, at[ok]] = np.frombuffer(r.v, np.float32)[ok]
    return x


def held_out_cosines(rows: list, cut: list, seen: np.ndarray) -> list[list[float]]:
    """By band, cosines of the texts of each half, whole and cut, with centroids of the other half."""
    found = [[] for _ in range(BANDS)]
    for half in (0, 1):
        fitted, judged = [r for r in rows if r.half != half], [r for r in rows + cut if r.half == half]
        if not fitted or not judged:
            continue
        c = k_means(dense(fitted, seen), CENTROIDS)
        for at in range(0, len(judged), SAMPLE):
            part = judged[at : at + SAMPLE]
            for r, best in zip(part, (dense(part, seen) @ c.T).max(1).tolist(), strict=True):
                found[band(r.n) if r.band < 0 else r.band].append(best)
    return found


def floors_of(raw: np.ndarray) -> np.ndarray:
    """Floors by language and band; a language without held-out texts takes the least floor of the others, or 0."""
    with np.errstate(all="ignore"):
        least = np.fmin.reduce(raw, 0)
    return np.nan_to_num(np.where(np.isnan(raw), least, raw), nan=0.0)


def raw_floors(found: list[list[float]]) -> np.ndarray:
    """One language's floors by band, NaN before the first band that a held-out text reached."""
    out = np.full(BANDS, np.nan)
    for b, cosines in enumerate(found):
        out[b] = SLACK * float(np.quantile(cosines, 0.01)) if cosines else out[b - 1] if b else np.nan
    return out


def _fit_language(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids (at 0, 1, ..) and floors (at -1) of one language's sample."""
    rows = list(pdf.sort_values(["band", "v", "slots"]).itertuples(index=False))
    whole, cut = ([r for r in rows if (r.band < 0) == w] for w in (True, False))
    seen = np.unique(np.concatenate([np.frombuffer(r.slots, np.int32) for r in whole]))
    c = k_means(dense(whole, seen), CENTROIDS)
    floors = raw_floors(held_out_cosines(whole, cut, seen))
    out = [(rows[0].lang, -1, b"", floors.tobytes()), *[(rows[0].lang, k, seen.astype(np.int32).tobytes(), row.tobytes()) for k, row in enumerate(c)]]
    return pd.DataFrame(out, columns=["lang", "at", "slots", "v"])


def fit(train: DataFrame) -> Model | None:
    """A model from train (doc_id, text, lang); rows with a null lang teach nothing."""
    train = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = scratch.few(train.groupBy("lang").count(), MAX_LANGUAGES)
    if counts is None:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = train.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS)
    total = 0
    for slot, n in found:
        if slot < 0:
            total = n
        else:
            df[slot] = n
    if not counts or not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 0.05
    grain = 1 << 30
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(int(grain * min(1.0, SAMPLE / n))))])
    drawn = train.withColumn("draw", F.xxhash64("doc_id", "text")).filter(F.pmod("draw", F.lit(grain)) < share[F.col("lang")]).dropDuplicates(["lang", "draw"])
    half = F.pmod(F.shiftright("draw", 40), F.lit(2)).cast("int").alias("half")
    rows = drawn.select("text", "lang", half).mapInArrow(_vectors(idf), "lang string, half int, band int, n long, slots binary, v binary")
    parts = rows.groupBy("lang").applyInPandas(_fit_language, "lang string, at int, slots binary, v binary").collect()
    languages = sorted({r["lang"] for r in parts})
    if not languages:
        return None
    owner, centres, floors = [], [], []
    for r in sorted(parts, key=lambda r: (r["lang"], r["at"])):
        if r["at"] < 0:
            floors.append(np.frombuffer(r["v"], float))
            continue
        owner.append(languages.index(r["lang"]))
        one = np.zeros(DIMENSIONS, np.float32)
        one[np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["v"], np.float32)
        centres.append(one)
    return Model(languages, np.array(owner), np.stack(centres, 1), idf.astype(np.float32), floors_of(np.stack(floors)))


def _predict(model: Model | None):
    def run(batches):
        letters = letter_table()
        for batch in batches:
            langs, scores, gone = [], [], []
            for text in batch.column("text"):
                code = codes(text.as_py(), letters) if model else None
                lang, score, under = ("und", 0.0, True) if code is None else model.score(code)
                langs.append(lang)
                scores.append(score)
                gone.append(bool(under))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
        kernel.release()

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, rejected; text is all that a prediction sees."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without those whose text is like none of the languages of its own labelled rows; all columns stay."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))

    def run(batches):
        judge = _predict(model)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            verdict = next(judge(iter([texts])))
            yield batch.filter(pc.invert(verdict.column("rejected")))

    return docs.mapInArrow(run, docs.schema)
