"""N-gram Jaccard join by partitioning the universe of shingles: exact, for high thresholds.

Two sets within the threshold differ in at most H shingles, H following from their sizes.  Every shingle hash falls into one of m
segments, more than H; so two such sets agree wholly in one segment at least.  m and the hash belong to a scheme, one for each
size band; a band reaches from a size to the largest size that may link with it, so a set takes part in the scheme of its own band
(at home) and in that of the band below (as a guest), and a pair is found in the home scheme of its smaller set.

1. Equal sets collapse to one node, by a 128-bit digest.  Each node emits one hashed subset for each segment of its two schemes; only
   subsets that several nodes share go on.  A node that shares none links with nothing.
2. The nodes of a shared subset are verified against one central node, and components are made of what links.
3. Subsets whose nodes still lie in several components are open.  There the larger set of a pair looks for smaller ones outside its
   component and chooses, by cost, how to look: each segment is looked up not at all (0), for equal subsets (1), or for those that
   differ by one shingle at most (2), which its own one-deletion neighbourhood finds in the index of subsets and its own subset
   in the index of one-deletion neighbourhoods.  If the numbers add up to more than H, no partner is missed: one that were
   would differ by at least that number in every segment.  Cost is the number of index entries that a look-up meets.  One look-up of
   each segment (all 1) is taken where that costs less than emitting a neighbourhood; else the cheapest choices are taken, so that subsets
   that very many sets share (few common shingles, or none) are skipped.
4. What is found must leave the threshold within reach by size and by PARITY_BITS parities, inside the join, and is verified on the full sets of
   64-bit shingle hashes.

Nothing caps a group, and no group is expanded into all pairs: a component found in step 2 isn't searched again.

Nulls, empty and blank texts have empty sets and link with nothing.  Rows are told apart by doc_id and text, so rows that repeat a
doc_id with another text are judged each for themselves.  A null doc_id counts as the largest; a component of such rows alone has a null component_id.
Texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch
from lodestone.llm.graph import components

U = kernel.U
PARITY_BITS = 512
WORDS = [f"p{k}" for k in range(PARITY_BITS // 64)]
#: Sizes of sets that bands are made for.
LARGEST = 1 << 40
#: Slots of the filter of either kind of index entries, at most.
FILTER = 1 << 25


class Bands:
    """Size bands of a threshold num / den, and the number of segments of each one's scheme (0 where only equal sets can link)."""

    def __init__(self, num: int, den: int):
        self.num, self.den, ends = num, den, [1]
        while ends[-1] <= LARGEST:
            ends.append(ends[-1] * den // num + 1)
        self.first = np.array(ends, np.int64)
        self.last = self.first[1:] - 1
        most = np.array([self.differ(int(x), int(x) * den // num) for x in self.last], np.int64)
        self.segments = np.where(most > 0, most + 1, 0)

    def differ(self, a: int, b: int) -> int:
        """In how many members two linked sets of these sizes may differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, n: np.ndarray, guest: bool) -> tuple[np.ndarray, np.ndarray]:
        """Band and segments of the scheme of sets of n members, at home or as a guest."""
        k = np.searchsorted(self.first, n, "right") - 1 - guest
        return k, np.where((k >= 0) & (n > 0), self.segments[np.maximum(k, 0)], 0)

    def wanted(self, n: int, k: int) -> int:
        """What a set's choices must add up to in scheme k, whose sets of at most its own size it looks for."""
        return self.differ(min(n, int(self.last[k])), n) + 1


def placed(h: np.ndarray, band: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment and code of shingle hashes in a scheme."""
    x = kernel.mix(h + (band.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    return (((x >> U(32)) * m.astype(U)) >> U(32)).astype(np.int64), kernel.mix(x + U(0xD6E8FEB86659FD93))


def keyed(sums: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    return kernel.mix(sums + kernel.mix((band.astype(U) << U(40)) + segment.astype(U) + U(1)))


def subset_keys(sets: list[np.ndarray], bands: Bands, guest: bool) -> list[np.ndarray]:
    """For each set the keys of its subset in every segment: sums of codes, so members' order doesn't matter."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band, m = bands.of(sizes, guest)
    base = np.concatenate([[0], np.cumsum(m)])
    owner = np.repeat(np.arange(len(sets)), np.where(m > 0, sizes, 0))
    flat = np.concatenate([s for s, k in zip(sets, m, strict=True) if k] or [np.zeros(0, U)])
    segment, code = placed(flat, band[owner], m[owner])
    sums = np.zeros(base[-1], U)
    np.add.at(sums, base[owner] + segment, code)
    of = np.repeat(np.arange(len(sets)), m)
    keys = keyed(sums, band[of], np.arange(base[-1]) - base[of])
    return np.split(keys.view(np.int64), base[1:-1])


def neighbourhood(s: np.ndarray, bands: Bands, guest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one set's subsets, by segment; and segment and key of each subset with one member left out."""
    band, m = bands.of(np.array([len(s)]), guest)
    segment, code = placed(s, band, m)
    sums = np.zeros(int(m[0]), U)
    np.add.at(sums, segment, code)
    exact = keyed(sums, band, np.arange(len(sums)))
    return exact.view(np.int64), segment, keyed(sums[segment] - code, band, segment).view(np.int64)


def parities(s: np.ndarray) -> bytes:
    bits = np.bincount((s >> U(64 - 9)).view(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


SKETCH = "id long, mark long, n long, d1 long, d2 long, " + ", ".join(f"{w} long" for w in WORDS) + ", home array<long>, guest array<long>"


def _sketch(width: int, bands: Bands):
    """Size, digest, parities and subset keys of each row's set."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                sets = kernel.chunk_shingles(data, offsets, width)
                prints = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                d1, d2 = np.frombuffer(prints, np.int64).reshape(-1, 2).T
                words = np.frombuffer(b"".join(map(parities, sets)), np.int64).reshape(-1, len(WORDS)).T
                named = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        named.column("id"), named.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.copy()), pa.array(d2.copy()),
                        *[pa.array(w.copy()) for w in words], _lists(subset_keys(sets, bands, False)), _lists(subset_keys(sets, bands, True)),
                    ],
                    ["id", "mark", "n", "d1", "d2", *WORDS, "home", "guest"],
                )
        kernel.release()

    return run


def _sets(width: int):
    """The full sets of the nodes' rows; a task gives each node once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for first, data, offsets in kernel.text_chunks(batch.column("text")):
                nodes = batch.column("node").slice(first, len(offsets) - 1).to_pylist()
                new = [i for i, x in enumerate(nodes) if x not in seen and not seen.add(x)]
                sets = kernel.chunk_shingles(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), _lists([sets[i] for i in new])], ["node", "shingles"])
        kernel.release()

    return run


def _each(batches):
    """(row as a dict, its set) of batches with shingles."""
    for batch in batches:
        rest = batch.select([c for c in batch.schema.names if c != "shingles"]).to_pylist()
        for row, s in zip(rest, batch.column("shingles"), strict=True):
            yield row, s.values.to_numpy().view(U)


def _index(bands: Bands):
    """node, comp, shingles -> the keys of its subsets (kind 0) and of its one-deletion neighbourhood (kind 1), at home."""

    def run(batches):
        for row, s in _each(batches):
            exact, _, without = neighbourhood(s, bands, False)
            n = len(exact) + len(without)
            kind = np.repeat(np.array([0, 1], np.int32), [len(exact), len(without)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([exact, without])), pa.array(kind), pa.array(np.full(n, row["node"])), pa.array(np.full(n, row["comp"]))], ["key", "kind", "node", "comp"])

    return run


def _known(index: DataFrame) -> np.ndarray:
    """A filter of the index's keys, as bits: which slots of either kind have a key; of a bounded size, so that it only leaves out look-ups that meet nothing."""
    slots = min(FILTER, 1 << max(15, (16 * index.count()).bit_length()))
    slot = F.col("key").bitwiseAND(slots - 1) + F.col("kind") * slots + 1
    rows = index.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = np.zeros((2 * slots) // 8, np.uint8)
    for block, bits in rows.collect():  # at most 2 * FILTER bits
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bits, np.uint8)
    return out


def may_meet(known: np.ndarray, keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
    slots = len(known) * 4
    slot = (keys & np.int64(slots - 1)) + kind * slots
    return (known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _lookups(bands: Bands, known: np.ndarray):
    """node, comp, home, shingles -> what a choice of 2 in a segment looks up beyond equal subsets, but for what the filter rules out: key, kind to look in."""

    def run(batches):
        for row, s in _each(batches):
            exact, segment, without = neighbourhood(s, bands, not row["home"])
            key, kind = np.concatenate([exact, without]), np.repeat(np.array([1, 0], np.int32), [len(exact), len(without)])
            at = np.concatenate([np.arange(len(exact)), segment]).astype(np.int64)
            ok = may_meet(known, key, kind)
            n = int(ok.sum())
            out = [pa.array(np.full(n, row["node"])), pa.array(np.full(n, row["comp"])), pa.array(np.full(n, row["home"])), pa.array(at[ok]), pa.array(key[ok]), pa.array(kind[ok])]
            yield pa.RecordBatch.from_arrays(out, ["node", "comp", "home", "segment", "key", "kind"])

    return run


def allocated(one: np.ndarray, two: np.ndarray, wanted: int) -> np.ndarray:
    """A choice of 0, 1 or 2 for each segment that adds up to `wanted` at least, cheapest first.

    one is the cost of a choice of 1, two what a 2 adds.  Where 2 adds less than 1 costs, a segment is offered as a whole, at its mean.
    """
    whole = two < one
    cost = np.concatenate([np.where(whole, (one + two) / 2, one), np.where(whole, (one + two) / 2, two)])
    order = np.lexsort((np.tile(np.arange(len(one)), 2), cost))[:wanted]
    out = np.bincount(order % len(one), minlength=len(one)) if len(one) else np.zeros(0, np.int64)
    return np.where(whole & (out == 1), 2, out)


def _choices(bands: Bands):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, m = (int(x[0]) for x in bands.of(np.array([row["n"]]), not row["home"]))
                at = np.array([x["segment"] for x in row["costs"]])
                one, two = np.zeros(m), np.zeros(m)  # a segment that isn't listed costs nothing
                one[at], two[at] = [x["one"] for x in row["costs"]], [x["two"] for x in row["costs"]]
                v = allocated(one, two, bands.wanted(row["n"], k))[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), row["node"])), pa.array(np.full(len(v), row["home"])), pa.array(at), pa.array(v.astype(np.int32))], ["node", "home", "segment", "choice"])

    return run


def _within(x: str, y: str, num: int, den: int):
    """Whether sizes and parities of two sides leave the threshold within reach."""
    differ = sum(F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in WORDS)
    return F.greatest(differ, F.abs(F.col(f"{x}.n") - F.col(f"{y}.n"))) * (num + den) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (den - num)


def _smaller(x: str, y: str):
    return F.struct(F.col(f"{x}.n"), F.col(f"{x}.node")) < F.struct(F.col(f"{y}.n"), F.col(f"{y}.node"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) within the threshold on full sets.  Only a's set travels with its pair; b may be a node of very many pairs."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(common * den >= (F.size("sa") + F.size("sb") - common) * num).select("a", "b").distinct()


def _open_pairs(members: DataFrame, found: DataFrame, nodes: DataFrame, sets: DataFrame, bands: Bands, tables: scratch.Tables, emitting: float) -> DataFrame:
    """Pairs (a, b) of different components that the threshold may hold for; a is the larger set."""
    num, den = bands.num, bands.den
    comp = members.join(found, "node", "left").select("key", "home", "segment", "node", F.coalesce("component", "node").alias("comp"))
    comp = tables.table(comp, "placed")
    per = tables.table(comp.groupBy("key", "comp").agg(F.count_if("home").alias("own")), "per")
    keys = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("own").alias("entries")).filter("comps > 1 AND entries > 0").select("key", "entries")
    narrow = nodes.select("node", "n", *WORDS)
    open_ = tables.table(comp.join(keys, "key").join(per, ["key", "comp"]).withColumn("cost", F.col("entries") - F.col("own")).drop("entries", "own").join(narrow, "node"), "open")
    # who looks each segment up once, and who must choose
    total = open_.groupBy("node", "home", "comp", "n").agg(F.sum("cost").alias("cost")).filter("cost > 0")
    heavy = tables.table(total.filter(F.col("cost") > emitting * F.col("n")).select("node", "home", "comp", "n"), "heavy")
    y, x = open_.filter("cost > 0").join(heavy, ["node", "home"], "left_anti").alias("y"), open_.filter("home").alias("x")
    wanted = (F.col("x.comp") != F.col("y.comp")) & _smaller("x", "y") & _within("x", "y", num, den)
    pairs = y.join(x, (F.col("x.key") == F.col("y.key")) & wanted).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    if heavy.isEmpty():
        return pairs.distinct()
    reached = open_.join(heavy.select("node", "home"), ["node", "home"], "left_semi").select("key").distinct()
    targets = open_.filter("home").join(reached, "key", "left_semi").select("node", "comp").distinct()
    index = tables.table(targets.join(sets, "node").mapInArrow(_index(bands), "key long, kind int, node long, comp long"), "index")
    shape = "node long, comp long, home boolean, segment long, key long, kind int"
    looks = heavy.join(sets, "node").select("node", "comp", "home", "shingles").mapInArrow(_lookups(bands, _known(index)), shape)
    met = tables.table(index.groupBy("key", "kind", "comp").agg(F.count("*").alias("own")), "met")
    # look-ups that meet another component's entries; all others cost nothing and find nothing
    hits = looks.join(met.groupBy("key", "kind").agg(F.sum("own").alias("entries")), ["key", "kind"]).join(met, ["key", "kind", "comp"], "left")
    hits = hits.withColumn("cost", F.col("entries") - F.coalesce("own", F.lit(0))).filter("cost > 0").withColumn("level", F.lit(2))
    equal = open_.filter("cost > 0").join(heavy.select("node", "home"), ["node", "home"]).withColumn("kind", F.lit(0)).withColumn("level", F.lit(1))
    columns = ["node", "home", F.col("segment").cast("long").alias("segment"), "key", "kind", "comp", "cost", "level"]
    hits = tables.table(hits.select(*columns).union(equal.select(*columns)), "hits")
    split = lambda level: F.sum(F.when(F.col("level") == level, F.col("cost")).otherwise(0))
    costs = hits.groupBy("node", "home", "segment").agg(split(1).alias("one"), split(2).alias("two"))
    # a row for each set and scheme, at most as long as the set has segments
    costs = costs.groupBy("node", "home").agg(F.collect_list(F.struct("segment", "one", "two")).alias("costs")).join(heavy.select("node", "home", "n"), ["node", "home"])
    choices = tables.table(costs.mapInArrow(_choices(bands), "node long, home boolean, segment long, choice int"), "choices")
    y = hits.join(choices, ["node", "home", "segment"]).filter("choice >= level").join(narrow, "node").alias("y")
    x = index.join(narrow, "node").alias("x")
    more = y.join(x, (F.col("x.key") == F.col("y.key")) & (F.col("x.kind") == F.col("y.kind")) & wanted)
    return pairs.union(more.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))).distinct()


def _grouped(docs: DataFrame, width: int, threshold: tuple[int, int], emitting: float) -> DataFrame:
    """docs (doc_id, text) -> id, n, links, first: the row (id, mark) that stands first in each row's component; null for empty sets."""
    num, den = threshold
    bands, tables = Bands(num, den), scratch.Tables()
    rows = scratch.marked(docs)
    sketch = tables.table(rows.mapInArrow(_sketch(width, bands), SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketch")
    classes = sketch.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "mark", "row")).alias("first"))
    classes = tables.table(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    nodes = tables.table(classes.select("node", "first", F.col("first.row").alias("row")).join(sketch.drop("id", "mark", "d1", "d2"), "row"), "nodes")
    of = lambda c, home: nodes.select("node", F.posexplode(c).alias("segment", "key"), F.lit(home).alias("home"))
    keys = of("home", True).union(of("guest", False))
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("home").alias("any")).filter("size > 1 AND any").select("key", "size")
    members = tables.table(keys.join(shared, "key"), "members")
    # the central node of a subset: the one whose subsets are shared by most in all
    mass = members.groupBy("node").agg(F.sum("size").alias("mass"))
    hubs = members.join(mass, "node").groupBy("key").agg(F.max(F.struct("mass", -F.col("node"))).alias("top"))
    hubs = tables.table(hubs.select("key", (-F.col("top.col2")).alias("hub")), "hubs")
    narrow = nodes.select("node", "n", *WORDS)
    star = members.join(hubs, "key").filter("node <> hub").select("node", "hub").distinct().join(narrow, "node").alias("y")
    star = star.join(narrow.select(F.col("node").alias("centre"), "n", *WORDS).alias("x"), (F.col("y.hub") == F.col("x.centre")) & _within("x", "y", num, den))
    star = tables.table(star.select(F.col("y.node").alias("a"), F.col("x.centre").alias("b")), "star")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    once = rows.join(wanted, ["id", "mark"]).select("node", "text").mapInArrow(_sets(width), "node long, shingles array<long>")
    sets = tables.table(once, "sets")
    links = tables.table(_verified(star, sets, num, den), "links")
    found = components(links)
    more = _open_pairs(members, found, nodes, sets, bands, tables, emitting)
    tried = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = tables.table(_verified(more.join(tried, ["a", "b"], "left_anti"), sets, num, den), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.join(found, "node", "left").select("d1", "d2", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    groups = tables.table(named.drop("first").join(least, "component").select("d1", "d2", "first"), "groups")
    return sketch.select("id", "n", "d1", "d2").join(groups, ["d1", "d2"], "left").select("id", "n", "first")


def jaccard_components(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100), emitting: float = 1.0) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; one row for each row of docs.

    Documents link when intersection / union >= threshold[0] / threshold[1]; component_id is the smallest doc_id reachable by links.
    A set's neighbourhood is emitted where looking each segment up once would meet more than `emitting` entries a shingle.
    """
    known = lambda c: F.nullif(c, F.lit(scratch.NO_ID))
    out = _grouped(docs, width, threshold, emitting)
    return out.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("first.id", "id")).alias("component_id"))
