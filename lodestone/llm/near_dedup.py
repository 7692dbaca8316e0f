"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds the hashes of its distinct word shingles.  One hash per shingle
chooses a bucket; a bucket keeps the smallest remainder, compressed to a register of
its count of leading zeros and the mantissa bits that follow.  Registers are banded;
equal bands make candidates; a candidate's Jaccard similarity is estimated from equal
registers, less the share expected to agree by chance at the two sets' sizes, and what may reach
the threshold is verified on the full sets.

Buckets that a small set leaves empty borrow, for the bands only, from other buckets in a
fixed order for each bucket, so that every band rests on five registers.  A pair at 0.85
shares no band of 32 with a probability of 7e-9, at 0.80 of 3e-6, were registers independent.

Equal sets, by a 128-bit digest of all their hashes, collapse to one node.  No group is expanded
into all pairs.  Nodes of a band bucket are tested against one central node.  Nodes that are
then still in another component than most of their bucket meet all nodes of such buckets again, now by
prefix filtering: two sets within the threshold share one of the rarest shingles of either, as
many as it may lack and one more.  Rarity is a count by slot over those sets, which gives one order
for all, so that step is exact, and what very many documents have in common is no key.  Pairs it
finds must leave the threshold within reach by size and by sketches of PARITY_BITS parities (sets whose
sketches differ in d bits differ in d shingles at least), and are verified too.

Nulls, empty and blank texts have empty sets and link with nothing.  Rows are told apart by doc_id and
text: each gets the component of its own text, also where a doc_id repeats.  A null doc_id counts as
the largest: it links, and goes as a duplicate of any other; without another in its component its
component_id is null and it is kept.  Rows that repeat doc_id and text stay or go together.  Extra columns of the
input don't matter to `near_duplicates`; `drop_near_duplicates` keeps all columns.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch
from lodestone.llm.graph import components

BANDS, ROWS, MANTISSA_BITS = 32, 5, 10
BUCKETS = BANDS * ROWS
EMPTY = 0xFFFF
PARITY_BITS = 512
#: Slots that shingles are counted by, 4 bytes each, for their order by rarity.
SLOT_BITS = 18


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUCKETS 16-bit registers for each set; EMPTY where a bucket has no shingle."""
    U = kernel.U
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((flat >> U(32)) * U(BUCKETS)) >> U(32)
    rest = kernel.mix(flat + U(0x5851F42D4C957F2D)) >> U(8)  # 56 bits
    low = np.full(len(sets) * BUCKETS, 1 << 56, U)
    np.minimum.at(low, owner * BUCKETS + bucket.astype(np.int64), rest)
    full = low < U(1 << 56)
    length = np.frexp(np.maximum(low, U(1)).astype(np.float64))[1].astype(np.int64)
    over = (length > 1) & (low < (U(1) << np.maximum(length - 1, 0).astype(U)))  # rounded up to the next power of two
    length -= over
    zeros = np.clip(56 - length, 0, 62)
    shift = length - 1 - MANTISSA_BITS
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(U), low << np.maximum(-shift, 0).astype(U)) & U((1 << MANTISSA_BITS) - 1)
    return np.where(full, (zeros.astype(U) << U(MANTISSA_BITS)) | mantissa, U(EMPTY)).astype(np.uint16).reshape(len(sets), BUCKETS)


def lenders() -> np.ndarray:
    """For each bucket the order in which it asks the others."""
    return np.random.default_rng(20).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """Hashes of the bands of each row, after empty buckets have borrowed; rows need one full bucket."""
    filled, order = regs.copy(), lenders()
    row, col = np.nonzero(regs == EMPTY)
    for k in range(BUCKETS):
        if not len(row):
            break
        filled[row, col] = regs[row, order[col, k]]
        still = filled[row, col] == EMPTY
        row, col = row[still], col[still]
    out = np.tile(np.arange(BANDS, dtype=kernel.U), (len(regs), 1))
    for k in range(ROWS):
        out = kernel.mix(out * kernel.U(0x100000001B3) + filled[:, k::ROWS].astype(kernel.U) + kernel.U(1))
    return out


def _bands(batches):
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        ids = batch.column("node").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(band_hashes(regs).view(np.int64).ravel())], ["node", "band"])
    kernel.release()


def parities(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s >> kernel.U(64 - 9)).view(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketch(width: int):
    """Size, digest and registers of each row's set, chunk by chunk."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                sets = kernel.chunk_shingles(data, offsets, width)
                prints = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                d1, d2 = np.frombuffer(prints, np.int64).reshape(-1, 2).T
                named = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        named.column("id"), named.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(d1.copy()), pa.array(d2.copy()), pa.array([r.tobytes() for r in registers(sets)], pa.binary()),
                    ],
                    ["id", "mark", "n", "d1", "d2", "registers"],
                )
        kernel.release()

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(width: int):
    """The full sets of the nodes' rows; a task gives each node once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                nodes = batch.column("node").slice(first, len(offsets) - 1).to_pylist()
                new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
                sets = kernel.chunk_shingles(data, offsets, width)
                sets = [sets[i] for i in new]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), _lists(sets), _lists([parities(x) for x in sets])], ["node", "shingles", "parity"])
        kernel.release()

    return run


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of a and b shingles agree where both buckets are full.

    Each of the 2**MANTISSA_BITS cells that halve again with every leading zero holds a bucket's minimum with a density
    of rate * exp(-rate * x), the rate being shingles a bucket; the product over both is summed cell by cell.
    """
    x, y = (np.maximum(np.asarray(v, float), 1.0)[..., None] / BUCKETS for v in (a, b))
    top = 0.5 ** np.arange(56)
    level = x * y / (x + y) * (top / 2 / (1 << MANTISSA_BITS)) * (np.exp(-(x + y) * top / 2) - np.exp(-(x + y) * top))
    return level.sum(-1) / np.maximum((1 - np.exp(-x[..., 0])) * (1 - np.exp(-y[..., 0])), 1e-300)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of rows of registers of sets of na and nb shingles, and how many buckets each rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    by_chance = chance(na, nb)
    return np.maximum(0.0, (equal / np.maximum(used, 1) - by_chance) / (1 - by_chance)), used


def _estimated(num: int, den: int):
    limit = num / den

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            found, used = estimate(a, b, *(batch.column(c).to_numpy() for c in ("na", "nb")))
            # six standard deviations below the threshold: discards nothing that could pass
            ok = found >= limit - 6 * np.sqrt(limit * (1 - limit) / np.maximum(used, 1)) - 1 / np.maximum(used, 1)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        kernel.release()

    return run


def _side(nodes: DataFrame, x: str, **columns: str) -> DataFrame:
    return nodes.select(F.col("node").alias(x), *[F.col(old).alias(new) for new, old in columns.items()])


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that the threshold holds for: sizes, then the estimate, then the full sets."""
    sized = pairs.join(_side(nodes, "a", na="n", ra="registers"), "a").join(_side(nodes, "b", nb="n", rb="registers"), "b")
    sized = sized.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    likely = sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(num, den), "a long, b long")
    both = likely.join(_side(sets, "a", sa="shingles"), "a").join(_side(sets, "b", sb="shingles"), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(common * den >= (F.size("sa") + F.size("sb") - common) * num).select("a", "b").distinct()


def _slot(h: np.ndarray) -> np.ndarray:
    return (kernel.mix(h.view(np.uint64)) >> kernel.U(64 - SLOT_BITS)).view(np.int64)


def _slot_counts(batches):
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_slot(batch.column("shingles").flatten().to_numpy()), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefixes(counts: np.ndarray, num: int, den: int):
    """The rarest shingles of each set, by count and then by hash: as many as it may lack, and one."""

    def run(batches):
        for batch in batches:
            column = batch.column("shingles")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            rare = counts[_slot(flat)]
            keys, sizes = [], []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = j - i
                keys.append(flat[i:j][np.lexsort((flat[i:j], rare[i:j]))[: n - -(-num * n // den) + 1]])
                sizes.append(len(keys[-1]))
            spread = np.repeat(np.arange(len(sizes)), sizes)
            out = [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *[batch.column(c).take(pa.array(spread)) for c in ("node", "comp", "n", "apart")]]
            yield pa.RecordBatch.from_arrays(out, ["key", "node", "comp", "n", "apart"])
        kernel.release()

    return run


def _left_over(members: DataFrame, found: DataFrame, first: DataFrame, sets: DataFrame, num: int, den: int, tables: scratch.Tables) -> DataFrame:
    """Pairs (a, b) of different components, one of them outside the component that most of a bucket is in, that the threshold may hold for."""
    placed = members.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    per = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    open_ = per.groupBy("band").agg(F.max(F.struct("n", -F.col("comp"))).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    open_ = tables.table(open_.select("band", (-F.col("top.col2")).alias("main")), "open")
    alive = placed.join(open_, "band").groupBy("node", "comp").agg(F.bool_or(F.col("comp") != F.col("main")).alias("apart"))
    alive = tables.table(sets.join(alive, "node").select("node", "comp", "apart", F.size("shingles").cast("long").alias("n"), "shingles"), "alive")
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    for slot, n in alive.select("shingles").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = min(n, 2**32 - 1)
    keys = tables.table(alive.mapInArrow(_prefixes(counts, num, den), "key long, node long, comp long, n long, apart boolean"), "keys")
    # keys that only one component has are no use
    met = keys.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("apart").alias("any")).filter("lo <> hi AND any").select("key")
    words = [F.element_at("parity", k + 1).alias(f"p{k}") for k in range(PARITY_BITS // 64)]
    keys = tables.table(keys.join(met, "key", "left_semi").join(sets.select("node", *words), "node"), "keys")
    x, y = keys.filter("apart").alias("x"), keys.alias("y")
    # in the join, so that what can't be within the threshold is never a row
    differ = sum(F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITY_BITS // 64))
    within = F.greatest(differ, F.abs(F.col("x.n") - F.col("y.n"))) * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & within)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")


def _grouped(docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """docs (doc_id, text) -> id, mark, n, first: the row (id, mark) that stands first in each row's component; null for empty sets."""
    num, den = threshold
    tables = scratch.Tables()
    rows = scratch.marked(docs)
    sketch = tables.table(rows.mapInArrow(_sketch(width), "id long, mark long, n long, d1 long, d2 long, registers binary"), "sketch")
    classes = sketch.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = tables.table(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    bands = nodes.select("node", "registers").mapInArrow(_bands, "node long, band long")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = tables.table(bands.join(shared, "band").distinct(), "members")
    # the central node of a bucket: the one whose buckets are largest in all
    central = members.groupBy("node").agg(F.sum("size").alias("mass"))
    hubs = members.join(central, "node").groupBy("band").agg(F.max(F.struct("mass", -F.col("node"))).alias("top"))
    hubs = tables.table(hubs.select("band", (-F.col("top.col2")).alias("hub")), "hubs")
    first = members.join(hubs, "band").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = tables.table(first, "first")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first.id", "first.mark")
    sets = rows.join(wanted, ["id", "mark"]).select("node", "text").mapInArrow(_sets(width), "node long, shingles array<long>, parity array<long>")
    sets = tables.table(sets.withColumn("n", F.size("shingles").cast("long")), "sets")
    links = tables.table(_links(first, nodes, sets, num, den), "links")
    found = components(links)
    more = _left_over(members, found, first, sets, num, den, tables)
    more = tables.table(_links(more, nodes, sets, num, den), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = nodes.join(found, "node", "left").select("d1", "d2", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    groups = tables.table(named.drop("first").join(least, "component").select("d1", "d2", "first"), "groups")
    return sketch.select("id", "mark", "n", "d1", "d2").join(groups, ["d1", "d2"], "left").select("id", "mark", "n", "first")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs.

    Documents are linked when intersection / union >= threshold[0] / threshold[1].
    """
    known = lambda c: F.nullif(c, F.lit(scratch.NO_ID))
    doc_id, component = known(F.col("id")), known(F.coalesce("first.id", "id"))
    kept = F.coalesce(doc_id == component, component.isNull() & (F.coalesce("first.mark", "mark") == F.col("mark")))
    return _grouped(docs, width, threshold).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the near duplicates: of each component the row with the smallest doc_id stays (of equal ones one text, by its hash)."""
    gone = _grouped(docs, width, threshold).filter("first IS NOT NULL AND (first.id <> id OR first.mark <> mark)").select("id", "mark")
    return scratch.without(docs, gone)
