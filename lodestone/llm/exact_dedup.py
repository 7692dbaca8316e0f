"""Exact dedup by two-pass Bloom filtering.

Pass one counts, for each row, the slots that its text's hash falls on; only slots, summed
in each task first, are shuffled.  Slots met at least twice form the filter.  Pass two
tests every row: a row with a slot that was met once is certainly unique and passes
straight through; only the others shuffle on their digest and are counted exactly.

A filter has MAX_SLOTS slots at most, so it may be broadcast; more rows are dealt by ranges of their
hash, each with a filter of its own, so that the share of unique rows that pass doesn't fall with
the input.  Ranges are folders of one table and are tested one after another, each by a job of its own that reads its folder and
deletes its filter when done, so neither plans nor broadcasts grow with the rows.  A fuller filter lets more unique rows through to the exact count and changes no
result.  A null text counts as empty; texts are compared after lower-casing A-Z only.
Of equal texts the largest doc_id stays (a null doc_id only if there is no other); rows
that repeat text and doc_id stay together, and rows of one doc_id with different texts are judged each for
themselves.  Other columns are ignored by `duplicates` and kept by `drop_duplicates`.
"""
from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Slots of the filter for each row, and of one filter at most: twice 2**29 slots are 128 MB as bits.
SLOTS_PER_ROW, MAX_SLOTS = 16, 1 << 29


def _digest(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        sums = [hashlib.sha256(t.as_py().lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sums, pa.binary())], ["doc_id", "mark", "digest"])


def _slots(digest, slots: int, which: int):
    eight = F.conv(F.hex(F.substring(digest, 1 + 7 * which, 7)), 16, 10).cast("long")
    return eight % F.lit(slots)


def _tested(rows: DataFrame, n: int, tables: scratch.Tables) -> tuple[DataFrame, DataFrame]:
    """rows (.., digest) with `maybe`: false where no other of them can have the same digest; and the filter, to be deleted afterwards."""
    slots = min(MAX_SLOTS, 1 << max(10, (n * SLOTS_PER_ROW - 1).bit_length()))
    marks = rows.select(F.explode(F.array(_slots(F.col("digest"), slots, 0), _slots(F.col("digest"), slots, 1) + slots)).alias("slot"))
    twice = marks.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    # as bits: rows of 32,768 slots, at most 2 * MAX_SLOTS / 32,768 of them
    blocks = tables.table(
        twice.groupBy(F.expr("bitmap_bucket_number(slot)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")), "bloom"
    )

    def hit(frame: DataFrame, which: int) -> DataFrame:
        name = f"bits{which}"
        slot = _slots(F.col("digest"), slots, which) + which * slots
        frame = frame.withColumn("slot", slot)
        side = F.broadcast(blocks.select(F.col("block").alias(f"block{which}"), F.col("bits").alias(name)))
        frame = frame.join(side, F.expr("bitmap_bucket_number(slot)") == F.col(f"block{which}"), "left")
        byte = F.conv(F.hex(F.expr(f"substring({name}, cast(bitmap_bit_position(slot) div 8 + 1 as int), 1)")), 16, 10).cast("int")
        bit = F.expr("cast(bitmap_bit_position(slot) % 8 as int)")
        return frame.withColumn(f"hit{which}", F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(1) == 1, F.lit(False))).drop(name, f"block{which}", "slot")

    return hit(hit(rows, 0), 1).select("doc_id", "mark", "digest", (F.col("hit0") & F.col("hit1")).alias("maybe")), blocks


def _groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, mark, digest, keep_id, group_size."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scratch.mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    ranges = max(1, -(-n * SLOTS_PER_ROW // MAX_SLOTS))
    rows = docs.mapInArrow(_digest, "doc_id long, mark long, digest binary")
    if ranges > 1:
        rows = rows.withColumn("range", (F.conv(F.hex(F.substring("digest", 20, 6)), 16, 10).cast("long") % ranges).cast("int"))
    tables = scratch.Tables()
    rows = tables.table(rows, "digest", "range" if ranges > 1 else None)
    path = f"{scratch.shared_dir(docs.sparkSession)}/tested-{uuid.uuid4().hex}"
    schema = None
    for k in range(ranges):
        part, blocks = _tested(rows.filter(F.col("range") == k) if ranges > 1 else rows, -(-n // ranges), tables)
        part.write.mode("append").parquet(path)
        schema = part.schema
        tables.drop(blocks)
    tables.drop(rows)
    tested = docs.sparkSession.read.schema(schema).parquet(path)
    maybe = tested.filter("maybe").select("doc_id", "mark", "digest")
    # a table of its own: a hot digest then meets in a plain join, which Spark splits
    groups = scratch.table(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    again = maybe.join(groups, "digest").select("doc_id", "mark", "digest", "keep_id", "group_size")
    alone = tested.filter("NOT maybe").select("doc_id", "mark", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.union(again)


def duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    return _groups(docs).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is that of a row with a larger doc_id."""
    gone = _groups(docs).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(scratch.identity(F.col("doc_id")).alias("id"), "mark")
    return scratch.without(docs, gone)
