"""Line dedup by a deletion-neighbourhood join.

Lines are compared after stripping and A-Z lower-casing; blank ones take no part.  The edit bound is
one character for lines of at least `near_chars` characters and none for shorter ones, whose
neighbours are other lines rather than copies.  Equal lines of any length meet by a 128-bit digest
of their bytes.  Lines at one edit (a character inserted, deleted or replaced) are found through their
deletion neighbourhoods: every variant with one character deleted is emitted as a hashed key.  Two lines are one
replacement apart exactly when they share a variant deleted at the same place, and one
insertion apart exactly when one of them is a variant of the other, so minima by key give
each line its earliest neighbour, without pairs within a key.  The pair is then verified
by edit distance on the lines themselves.

Before that, a filter: an edit leaves the first or the last half of a line unchanged, so only
lines that share half with a different line of the same length, or one character more or
less, emit variants.

A line goes when an equal line, or a line within the bound, stands earlier: in a row with a smaller
doc_id (a null one counts as the largest; of equal ones by a hash of the text), or further up in the same
row; whether the earlier line itself stays does not matter.  Null texts stay null; rows that lose every
line they had go; empty ones stay.  Rows that repeat doc_id and text are treated alike: the later repeats
of a line go in each.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch

#: Lines of so many characters or more may differ by one edit; shorter ones must be equal.
NEAR_CHARS = 24
#: So many lines, of 16 bytes each, may be broadcast.
FEW = 1_000_000
#: Variants made at a time.
SLICE = 1 << 18
U = kernel.U
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def line_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end (both stripped), row and number in its row of every line of a chunk, blank lines included."""
    cut = np.flatnonzero(low == 10)
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]))
    row = np.searchsorted(offsets[1:-1], start, "right")
    # the line after a row's last line feed begins where the next row does: its row is the earlier one
    own = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1])
    order = np.lexsort((np.concatenate([offsets[:-1], cut + 1]), own))
    start, row = np.concatenate([offsets[:-1], cut + 1])[order], own[order]
    end = np.concatenate([start[1:] - 1, offsets[-1:]])
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    end[last] = offsets[row[last] + 1]
    first = np.searchsorted(row, row)
    number = np.arange(len(row)) - first
    # strip: next and previous byte that is not blank
    solid = np.flatnonzero(~_BLANK[low])
    at = np.append(solid, len(low))[np.searchsorted(solid, start)]
    to = np.concatenate([[0], solid + 1])[np.searchsorted(solid, end)]
    to = np.maximum(to, start)
    blank = at >= end
    return np.where(blank, start, at), np.where(blank, start, to), row, number


class Characters:
    """Where the characters of a chunk begin; lines are measured and cut in them."""

    def __init__(self, low: np.ndarray):
        self.begin = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))

    def number(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at)


def _lines(near_chars: int):
    """Every line that is not blank, with its digest; those of near_chars characters with the hashes of their halves."""

    def run(batches):
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("id", "mark"))
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                low = kernel.LOWER[data]
                start, end, row, number = line_bounds(low, offsets)
                keep = end > start
                start, end, row, number = start[keep], end[keep], row[keep], number[keep]
                raw = low.tobytes()
                sums = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                d1, d2 = np.frombuffer(sums, np.int64).reshape(-1, 2).T
                at = Characters(low)
                head, tail = at.number(start), at.number(end)
                n = tail - head
                short = n < near_chars
                long = np.flatnonzero(~short)
                edges = np.zeros((4, len(n)), U)
                if len(long):
                    roll = kernel.Rolling(low)
                    s, e, n = start[long], end[long], n[long]
                    # head and tail of half the length that the shorter of two lines has: this line's, or one character less
                    for k, size in enumerate((n, n - 1)):
                        half, tag = np.maximum(size - 1, 0) // 2, size.astype(U) << U(1)
                        edges[2 * k, long] = kernel.mix(roll.hash(s, at.begin[head[long] + half]) + tag)
                        edges[2 * k + 1, long] = kernel.mix(roll.hash(at.begin[tail[long] - half], e) + tag + U(1))
                columns = [pa.array(ids[first + row]), pa.array(marks[first + row]), pa.array(number), pa.array(d1.copy()), pa.array(d2.copy())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.view(np.int64), mask=short) for x in edges]], ["id", "mark", "line", "d1", "d2", "e0", "e1", "e2", "e3"])
        kernel.release()

    return run


def _chosen(batch: pa.RecordBatch):
    """Bytes, id, mark and number, start and end of the lines of a batch that `wanted` names, by chunk."""
    wanted, ids, marks = batch.column("wanted").to_pylist(), batch.column("id").to_numpy(), batch.column("mark").to_numpy()
    for first, data, offsets in kernel.text_chunks(batch.column("text")):
        low = kernel.LOWER[data]
        start, end, row, number = line_bounds(low, offsets)
        named = {(i, x) for i in range(len(offsets) - 1) for x in wanted[first + i]}
        keep = np.fromiter(((r, x) in named for r, x in zip(row.tolist(), number.tolist(), strict=True)), bool, len(row))
        yield low, ids[first + row[keep]], marks[first + row[keep]], number[keep], start[keep], end[keep]


def _variants(batches):
    """The deletion neighbourhood of the named lines; kind 0: the line itself, kind p + 1: the character at p deleted."""
    for batch in batches:
        for low, ids, marks, number, start, end in _chosen(batch):
            if not len(start):
                continue
            roll, at = kernel.Rolling(low), Characters(low)
            head = at.number(start)
            size = at.number(end) - head
            # kind 0 first: a line has size + 1 variants, laid out one line after the other
            total = np.concatenate([[0], np.cumsum(size + 1)])
            for begin in range(0, int(total[-1]), SLICE):
                flat = np.arange(begin, min(begin + SLICE, int(total[-1])))
                who = np.searchsorted(total, flat, "right") - 1
                kind = flat - total[who]
                s, e, place = start[who], end[who], head[who] + np.maximum(kind - 1, 0)
                cut = roll.joined(s, at.begin[place], np.where(kind == 0, at.begin[place], at.begin[place + 1]), e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cut.view(np.int64)), pa.array(kind), pa.array(ids[who]), pa.array(marks[who]), pa.array(number[who])], ["variant", "kind", "id", "mark", "line"]
                )
    kernel.release()


def _bodies(batches):
    for batch in batches:
        for low, ids, marks, number, start, end in _chosen(batch):
            texts = [low[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(number), pa.array(texts, pa.string())], ["id", "mark", "line", "body"])
    kernel.release()


def _with_lines(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (id, mark, text) that have a place (id, mark, line), with their lines as `wanted`.

    Up to FEW places are broadcast, so that texts don't shuffle; more are joined by shuffle.
    """
    wanted = places.groupBy("id", "mark").agg(F.collect_set("line").alias("wanted"))
    return rows.join(F.broadcast(wanted) if places.count() <= FEW else wanted, ["id", "mark"]).select("id", "mark", "text", "wanted")


def within_one(a: str | bytes, b: str | bytes) -> bool:
    """Edit distance of at most one, by common prefix and suffix."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def _check(batches):
    for batch in batches:
        ok = [within_one(a, b) for a, b in zip(batch.column("body").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield batch.filter(pa.array(ok, pa.bool_())).select(["at", "of"])


PLACE = "struct<id:bigint,mark:bigint,line:bigint>"


def _repeats(rows: DataFrame, near_chars: int) -> DataFrame:
    """rows (id, mark, text) -> at, of (places: id, mark, line), exact."""
    tables = scratch.Tables()
    lines = tables.table(rows.mapInArrow(_lines(near_chars), "id long, mark long, line long, d1 long, d2 long, e0 long, e1 long, e2 long, e3 long"), "lines")
    place = F.struct("id", "mark", "line")
    distinct = tables.table(
        lines.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.first(e).alias(e) for e in ("e0", "e1", "e2", "e3")])
        .select("d1", "d2", "first", (F.col("first") != F.col("last")).alias("many"), "e0", "e1", "e2", "e3"),
        "distinct",
    )
    edges = distinct.select("d1", "first", F.explode(F.array("e0", "e1", "e2", "e3")).alias("edge")).filter("edge IS NOT NULL")
    shared = edges.groupBy("edge").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo <> hi").select("edge")
    suspects = tables.table(edges.join(shared, "edge", "left_semi").select("first.*").distinct(), "suspects")
    variants = tables.table(_with_lines(rows, suspects).mapInArrow(_variants, "variant long, kind long, id long, mark long, line long"), "variants")
    at_hash = F.xxhash64("id", "mark", "line")
    met = variants.groupBy("variant").agg(F.min(at_hash).alias("lo"), F.max(at_hash).alias("hi"))
    # few of them are left, as a table of known size
    met = tables.table(met.filter("lo <> hi").select("variant"), "met")
    keyed = tables.table(variants.join(met, "variant", "left_semi").select("variant", "kind", place.alias("at")), "keyed")
    tables.drop(variants, met, suspects)
    # replaced: same variant, same place; inserted or deleted: one line is the other's variant
    classes = tables.table(keyed.groupBy("variant", "kind").agg(F.min("at").alias("low")), "classes")
    whole = classes.groupBy("variant").agg(F.min(F.when(F.col("kind") == 0, F.col("low"))).alias("self"), F.min(F.when(F.col("kind") > 0, F.col("low"))).alias("longer"))
    near = (
        keyed.join(tables.table(whole, "whole"), "variant").join(classes.filter("kind > 0"), ["variant", "kind"], "left")
        .select("at", F.when(F.col("kind") == 0, F.col("longer")).otherwise(F.least("self", "low")).alias("other"))
        .filter("other < at").groupBy("at").agg(F.min("other").alias("of"))
    )
    near = tables.table(near, "pairs")
    places = near.select("at.*").union(near.select("of.*")).distinct()
    bodies = _with_lines(rows, places).mapInArrow(_bodies, "id long, mark long, line long, body string").dropDuplicates(["id", "mark", "line"])
    bodies = tables.table(bodies.select(place.alias("at"), "body"), "bodies")
    near = near.join(bodies, "at").join(bodies.select(F.col("at").alias("of"), F.col("body").alias("other")), "of")
    near = tables.table(near.select("at", "of", "body", "other").mapInArrow(_check, f"at {PLACE}, of {PLACE}"), "near")
    firsts = distinct.join(near.select(F.col("at").alias("first"), F.col("of").alias("near")), "first", "left").filter("many OR near IS NOT NULL")
    firsts = tables.table(firsts.select("d1", "d2", "first", "near"), "firsts")
    out = lines.select("d1", "d2", place.alias("at")).join(firsts, ["d1", "d2"]).select(
        "at", F.when(F.col("at") > F.col("first"), F.col("first")).otherwise(F.col("near")).alias("of"), (F.col("at") > F.col("first")).alias("exact")
    )
    return out.filter("of IS NOT NULL")


def repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, line, of_doc, of_line, exact: each line that goes, and the earliest line it repeats; rows that repeat doc_id and text give theirs once."""
    known = lambda c: F.nullif(F.col(c), F.lit(scratch.NO_ID))
    found = _repeats(scratch.marked(docs), near_chars).distinct()
    return found.select(known("at.id").alias("doc_id"), F.col("at.line").alias("line"), known("of.id").alias("of_doc"), F.col("of.line").alias("of_line"), "exact")


def _cut(name: str):
    return lambda batches: _without(batches, name)


def _without(batches, name: str):
    for batch in batches:
        texts, gone = batch.column("text").to_pylist(), batch.column(name).to_pylist()
        out, left = [], []
        for text, drop in zip(texts, gone, strict=True):
            if text is None or not drop:
                out.append(text)
                left.append(True)
                continue
            drop = set(drop)
            kept = [x for i, x in enumerate(text.split("\n")) if i not in drop]
            out.append("\n".join(kept))
            left.append(any(x.strip() for x in kept))
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, "text", pa.array(out, batch.schema.field("text").type)).drop_columns([name]).filter(pa.array(left, pa.bool_()))


def drop_repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the repeated lines cut out of text; rows left without any line go.  Other columns are unchanged; n_chars, if there, is counted again."""
    a, b, name = (scratch.fresh(x, docs.columns) for x in ("id", "mark", "gone"))
    gone = _repeats(scratch.marked(docs), near_chars).groupBy(F.col("at.id").alias(a), F.col("at.mark").alias(b)).agg(F.collect_set("at.line").alias(name))
    rows = docs.withColumn(a, scratch.identity(F.col("doc_id"))).withColumn(b, scratch.mark(F.col("text")))
    cut = rows.join(gone, [a, b], "left").select(*docs.columns, name).mapInArrow(_cut(name), docs.schema)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
