"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased by one rule (Unicode lower case letter by letter, the final sigma as any
other), runs of white space become one space.  An item of m bytes may differ in k = floor(m * rate) byte
edits.  Cut into k + 1 pieces, at least one piece of a match is unchanged: pieces are found exactly (their
first eight bytes at every position of the text, then their last eight, then whole), and each place so
proposed is verified by Myers' bit-parallel edit distance.  An item too short for an edit is found verbatim,
as whole words: neither letters nor digits of other words adjoin it.

The items are shipped to the tasks in blocks of bounded size; a larger benchmark takes more
passes over the texts, none of which drops anything.  Null and blank items identify no text.
Null texts match nothing.  Repeated rows are matched each for themselves; a text with several places
of an item reports the nearest, then earliest.  Rows are told apart by doc_id and text, so of rows that
share a doc_id, null or not, only those go whose own text leaks.  Extra columns don't matter.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel, scratch

RATE, BLOCK_BYTES, Q = 0.05, 4_000_000, 8
U = kernel.U
_SALT = U(0x9E3779B97F4A7C15)
#: Bytes that make words: ASCII letters and digits, and all of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(column: pa.Array) -> pa.Array:
    """The one lower-casing of texts and items."""
    return pc.replace_substring(pc.utf8_lower(column.cast(pa.large_string())), "ς", "σ")


def normal(text: str) -> bytes:
    return b" ".join(lowered(pa.array([text]))[0].as_py().encode().split())


def _squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with white space runs as one space, new offsets, and where each byte was; leading white space goes."""
    space = kernel.SPACE[data]
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1])
        heads = offsets[:-1][offsets[:-1] < len(data)]
        keep[heads] = ~space[heads]
    where = np.flatnonzero(keep)
    out = np.where(space, np.uint8(32), data)[where]
    return out, np.searchsorted(where, offsets), where


def masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[int, int], m: int, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text, and the first end of such a substring."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, at


class Items:
    """Items with the pieces that a text must hold one of."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids, self.texts, self.budget = [], [], []
        pieces: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for item, text in items:
            body = normal(text or "")
            if not body:
                continue
            k = max(0, min(int(len(body) * rate), len(body) // Q - 1))
            cuts = [len(body) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                q = min(Q, b - a)
                pieces.setdefault(q, []).append((int.from_bytes(body[a : a + q], "little"), int.from_bytes(body[b - q : b], "little"), len(self.ids), a, b - a))
            self.ids.append(item)
            self.texts.append(body)
            self.budget.append(k)
        #: By width of the first bytes (eight, or a shorter piece's all): those, the last ones, owner, place and length, in order.
        self.pieces = {}
        for q, found in pieces.items():
            seeds, tails, *rest = zip(*sorted(found), strict=True)
            self.pieces[q] = (np.array(seeds, U), np.array(tails, U), *[np.array(x, np.int64) for x in rest])
        self.peq: dict[int, dict[int, int]] = {}

    def places(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, proposed start) of exact piece hits, sorted, without repeats."""
        raw, found = data.tobytes(), []
        padded = raw + bytes(2 * Q)
        for q, (seeds, tails, owner, begin, length) in self.pieces.items():
            table = np.zeros(1 << 20, bool)
            table[(seeds * _SALT) >> U(44)] = True
            keep = U((1 << 8 * q) - 1)
            for shift in range(Q):
                value = np.frombuffer(padded, "<u8", -(-max(0, len(raw) - shift) // Q), shift) & keep
                at = np.flatnonzero(table[(value * _SALT) >> U(44)])
                value = value[at]
                lo, hi = np.searchsorted(seeds, value, "left"), np.searchsorted(seeds, value, "right")
                n = hi - lo
                piece = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(at * Q + shift, n)
                row = np.searchsorted(offsets, pos, "right") - 1
                end = pos + length[piece]
                ok = end <= offsets[row + 1]
                piece, pos, row, end = piece[ok], pos[ok], row[ok], end[ok]
                tail = np.zeros(len(pos), U)
                for i in range(q):
                    tail |= data[end - q + i].astype(U) << U(8 * i)
                ok = tail == tails[piece]
                for p, x, r in zip(piece[ok].tolist(), pos[ok].tolist(), row[ok].tolist(), strict=True):
                    o, b, n_ = int(owner[p]), int(begin[p]), int(length[p])
                    if raw[x : x + n_] == self.texts[o][b : b + n_] and (self.budget[o] or self._stands_alone(data, x, x + n_, offsets[r], offsets[r + 1])):
                        found.append((r, o, x - b))
        return sorted(set(found))

    @staticmethod
    def _stands_alone(data: np.ndarray, a: int, b: int, low: int, high: int) -> bool:
        before = a > low and _WORD[data[a]] and _WORD[data[a - 1]]
        after = b < high and _WORD[data[b - 1]] and _WORD[data[b]]
        return not (before or after)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> (distance, start of the window, end of the match) of the nearest match within budget."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        raw, done = data.tobytes(), {}
        for row, o, start in self.places(data, offsets):
            body, k = self.texts[o], self.budget[o]
            if not k:  # found whole by its only piece
                best.setdefault((row, o), (0, start, start + len(body)))
                continue
            a, b = max(int(offsets[row]), start - k), min(int(offsets[row + 1]), start + len(body) + k)
            if done.get((row, o), (-1, 0))[0] == 0 or a < done.get((row, o), (0, -1))[1]:
                if done[(row, o)][0] == 0:
                    continue
                if b <= done[(row, o)][1]:
                    continue
            x = raw.find(body, a, b)
            if x >= 0:
                hit = (0, x, x + len(body))
            else:
                peq = self.peq.setdefault(o, masks(body))
                d, end = myers(peq, len(body), raw[a:b])
                hit = (d, a, a + end)
            done[(row, o)] = (hit[0], b)
            if hit[0] <= k and ((row, o) not in best or hit < best[(row, o)]):
                best[(row, o)] = hit
        return best


def _match(items: list[tuple[int, str]], rate: float):
    def run(batches):
        known = Items(items, rate)
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            rows = []
            for first, data, offsets in kernel.text_chunks(lowered(batch.column("text"))):
                body, cuts, _ = _squeeze(data, offsets)
                for (row, o), (d, a, b) in sorted(known.matches(body, cuts).items()):
                    rows.append((ids[first + row], marks[first + row], known.ids[o], d, known.budget[o], a - int(cuts[row]), b - int(cuts[row])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "mark", "item_id", "distance", "budget", "window_start", "match_end"])
        kernel.release()

    return run


def _leaks(rows: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """rows (id, mark, text) -> id, mark, item_id, distance, budget, window_start, match_end."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = rows.mapInArrow(_match([(r.item_id, r.text) for r in part], rate), "id long, mark long, item_id long, distance long, budget long, window_start long, match_end long")
        out = found if out is None else out.union(found)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, distance, budget, window_start, match_end (bytes of the normalised text).

    One row for each document and item that it holds within the item's budget of edits.
    """
    found = _leaks(scratch.marked(docs), benchmark, rate)
    return found.select(F.nullif("id", F.lit(scratch.NO_ID)).alias("doc_id"), "item_id", "distance", "budget", "window_start", "match_end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay."""
    return scratch.without(docs, _leaks(scratch.marked(docs), benchmark, rate).select("id", "mark"))
