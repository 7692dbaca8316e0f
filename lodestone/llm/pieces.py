"""SentencePiece encoding and decoding with alignment to the source.

Normalisation walks the text through the model's compiled character map by longest prefix
and records, for every normalised character, the bytes of the source that it came from.
Byte-pair merges then run on segments that no piece of the model crosses, each distinct
segment of a run of texts once and all of them at the same time; every piece projects to the
source bytes of its characters.  Characters without a piece fall back to byte pieces, which all project to
that character.

A null text is encoded as empty.  Long texts and long unbroken runs take the same way:
a text is never cut, and merges of a long segment use a heap.
Repeated rows and extra columns don't matter.
"""
from __future__ import annotations

import hashlib
import heapq
import struct
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import kernel, scratch

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts are encoded together in runs of so many characters; a longer text is a run of its own.
RUN_CHARS = 1 << 19


def fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message; a length-delimited value is bytes."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 0x7F) << shift
            shift += 7
            i += 1
            if data[i - 1] < 0x80:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie of source bytes and the replacements that its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest source prefix at `at` that the map knows, and that prefix's length."""
        if not self.units:
            return None
        found, node = None, 0
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node ^= offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, n = found
        return self.texts[start : self.texts.index(b"\0", start)], n


class Model:
    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        charmap = b""
        self.dummy_prefix = self.squeeze = self.escape = True
        self.bos, self.eos, self.unknown_surface, self.fallback = "<s>", "</s>", " ⁇ ", False
        for number, value in fields(blob):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, v in fields(value):
                    if n == 3 and v != 2:
                        raise ValueError("only byte-pair models are supported")
                    if n == 35:
                        self.fallback = bool(v)
                    if n == 44:
                        self.unknown_surface = v.decode()
                    if n == 46:
                        self.bos = v.decode()
                    if n == 47:
                        self.eos = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        charmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        self.map = CharacterMap(charmap)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, UNUSED)}
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.fallback else []
        self.unknown = self.kinds.index(UNKNOWN)
        self.bos_id, self.eos_id = self.pieces.index(self.bos), self.pieces.index(self.eos)
        # where no piece runs from a character that is not the space mark to the mark, segments end
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.decoded = [self._bytes(i) for i in range(len(self.pieces))]

    def _bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_surface.encode()
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        return self.pieces[i].replace(SPACE, " ").encode()

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and the source byte at which each of its characters begins (one more at the end).

        The alignment is None where each character but a leading mark is one source character.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        mark = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze:
            return (mark if self.dummy_prefix else "") + text.replace(" ", mark), None
        raw, out, at = text.encode(), [], []
        i, n = 0, len(raw)

        def step(i: int) -> tuple[str, int]:
            hit = self.map.longest(raw, i)
            if hit:
                return hit[0].decode(), hit[1]
            k = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
            return raw[i : i + k].decode(), k

        if self.squeeze:
            while i < n:
                piece, k = step(i)
                if piece != " ":
                    break
                i += k
            if i == n:
                return "", np.array([n])
        if self.dummy_prefix:
            out.append(mark)
            at.append(i)
        spaced = self.squeeze
        while i < n:
            piece, k = step(i)
            if spaced:
                piece = piece.lstrip(" ")
            if piece:
                out += [mark if c == " " else c for c in piece]
                at += [i] * len(piece)
                spaced = self.squeeze and piece.endswith(" ")
            i += k
            if not self.squeeze:
                spaced = False
        end = n
        if self.squeeze:
            while out and out[-1] == mark:
                out.pop()
                end = at.pop()
        return "".join(out), np.array([*at, end], np.int64)

    # merges

    def merge(self, segment: str) -> list[str]:
        """Joins the best-ranked adjacent pair, the leftmost of equals, until no pair is a piece."""
        if len(segment) > 64:
            return self._merge_long(segment)
        get, none = self.rank.get, float("inf")
        parts = list(segment)
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, segment: str) -> list[str]:
        rank, parts, n = self.rank, list(segment), len(segment)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                r = rank.get(parts[i] + parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]


class PairTable:
    """(left symbol, right symbol) -> rank and symbol of their join, as hash tables for whole arrays.

    Symbols are piece ids, and after those one for each character that stands in a piece but is none.
    """

    BITS = 19
    NONE = np.int32(2**31 - 1)

    def __init__(self, model: Model):
        order = {r: i for i, r in enumerate(sorted(set(model.rank.values())))}
        self.symbols = dict(model.ids)
        for p in model.ids:
            for c in p:
                self.symbols.setdefault(c, len(model.pieces) + len(self.symbols))
        key, rank, join = [], [], []
        for p, i in model.ids.items():
            for k in range(1, len(p)):
                x, y = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if x is not None and y is not None:
                    key.append(x << 20 | y)
                    rank.append(order[model.rank[p]])
                    join.append(i)
        key, rank, join = np.array(key, np.int64), np.array(rank, np.int32), np.array(join, np.int32)
        self.levels = []
        while len(key):
            slot = self._slot(key, len(self.levels))
            keys = np.full(1 << self.BITS, -1, np.int64)
            ranks, joins = np.full(1 << self.BITS, self.NONE, np.int32), np.zeros(1 << self.BITS, np.int32)
            keys[slot], ranks[slot], joins[slot] = key, rank, join  # the last of those that share a slot stays
            self.levels.append((keys, ranks, joins))
            left = keys[slot] != key
            key, rank, join = key[left], rank[left], join[left]
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    def _slot(self, key: np.ndarray, level: int) -> np.ndarray:
        odd = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * level & (1 << 64) - 1)
        return ((key.view(np.uint64) * odd) >> np.uint64(64 - self.BITS)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        rank, join = np.full(len(key), self.NONE, np.int32), np.zeros(len(key), np.int32)
        rest = np.arange(len(key))
        for level, (keys, ranks, joins) in enumerate(self.levels):
            slot = self._slot(key, level)
            there = keys[slot]
            hit = there == key
            rank[rest[hit]], join[rest[hit]] = ranks[slot[hit]], joins[slot[hit]]
            more = ~hit & (there != -1)
            rest, key = rest[more], key[more]
            if not len(rest):
                break
        return rank, join


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .., one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def distinct_segments(code: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of segments that differ, and for every segment which of these it equals; those that hash alike are compared."""
    hashes = kernel.Rolling(code).hash(start, start + length) if len(code) else np.zeros(0, np.uint64)
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    like = one[which]
    wrong = length != length[like]
    tested = np.flatnonzero(~wrong & (like != np.arange(len(like))))
    n = length[tested]
    differ = code[ranges(start[tested], n)] != code[ranges(start[like[tested]], n)]
    wrong[np.repeat(tested, n)[differ]] = True
    if wrong.any():
        own: dict[bytes, int] = {}
        one = one.tolist()
        for k in np.flatnonzero(wrong).tolist():
            text = code[start[k] : start[k] + length[k]].tobytes()
            if text not in own:
                own[text] = len(one)
                one.append(k)
            which[k] = own[text]
        one = np.array(one)
    return one, which


class Codec:
    """Encodes many texts at once and decodes, with one model."""

    #: Longer segments are merged one by one, with a heap.
    LONG = 64

    def __init__(self, model: Model):
        self.model, self.pairs = model, PairTable(model)

    @classmethod
    def of(cls, blob: bytes) -> Codec:
        """The codec of a model; a worker process keeps the last one for its later tasks."""
        kept = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
        key = hashlib.sha256(blob).hexdigest()
        if getattr(kept, "codec", (None,))[0] != key:
            kept.codec = (key, cls(Model(blob)))
        return kept.codec[1]

    def _merged(self, code: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, first character and symbol of what remains of each segment after all merges, in order."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(length > self.LONG).tolist():
            text = code[start[k] : start[k] + length[k]].tobytes().decode("utf-32-le", "surrogatepass")
            parts = self.model.merge(text)
            at = start[k] + np.cumsum([0, *map(len, parts[:-1])])
            symbol = [self.pairs.symbols.get(p, -1) for p in parts]
            done.append((np.full(len(parts), k), at, np.array(symbol, np.int32)))
        short = np.flatnonzero(length <= self.LONG)
        owner = np.repeat(short, length[short])
        at = ranges(start[short], length[short])
        symbol = self.pairs.of_char[code[at]]
        while len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank, join = self.pairs.find(symbol[:-1], symbol[1:])
            rank = np.append(rank, self.pairs.NONE)
            rank[first[1:] - 1] = self.pairs.NONE
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            live = np.repeat(best < self.pairs.NONE, size)
            done.append((owner[~live], at[~live], symbol[~live]))
            hit = np.flatnonzero((rank == np.repeat(best, size)) & live)
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])] if len(hit) else hit
            symbol[hit] = join[hit]
            live[hit + 1] = False
            owner, at, symbol = owner[live], at[live], symbol[live]
        owner, at, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((at, owner))
        return owner[order], at[order], symbol[order]

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with begin and end ids, and of each id the span of source bytes; begin and end have empty spans."""
        m = self.model
        norms, aligns = [], []
        for text in texts:
            norm, align = m.normalise(text or "")
            if align is None and SPACE in text:
                widths = [0] * m.dummy_prefix + [len(c.encode()) for c in text]
                align = np.concatenate([[0], np.cumsum(widths)])
            norms.append(norm)
            aligns.append(align)
        code = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(x) for x in norms], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        mark = code == 0x2581
        source = np.where(mark, 1, width)
        heads = begins[sizes > 0]
        if m.dummy_prefix:
            source[heads] = 0
        total = np.concatenate([[0], np.cumsum(source)])
        if self.model.crosses:
            start = heads
        else:
            cut = mark.copy()
            cut[1:] &= ~mark[:-1]
            cut[heads] = True
            start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(code)))
        one, which = distinct_segments(code, start, length)
        owner, at, symbol = self._merged(code, start[one], length[one]) if len(one) else (np.zeros(0, np.int64),) * 3
        # symbols to ids; a character without a piece becomes its bytes, or unknown
        end = np.append(at[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        end[last] = (start[one] + length[one])[owner[last]]
        bare = (symbol < 0) | (symbol >= len(m.pieces))
        count = np.where(bare, width[at], 1) if m.fallback else np.ones(len(at), np.int64)
        ids = np.repeat(np.where(bare, m.unknown, symbol), count)
        begin, end = np.repeat(at - start[one][owner], count), np.repeat(end - start[one][owner], count)
        if m.fallback and bare.any():
            c, n = code[at[bare]].astype(np.int64), width[at[bare]]
            byte = ranges(np.zeros(len(n), np.int64), n)
            c, n = np.repeat(c, n), np.repeat(n, n)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
            value = np.where(byte == 0, lead | c >> 6 * (n - 1), 0x80 | c >> 6 * (n - 1 - byte) & 0x3F)
            ids[np.repeat(bare, count)] = np.array(m.byte_ids)[value]
        per = np.bincount(owner, count, len(one)).astype(np.int64)
        take = ranges((np.cumsum(per) - per)[which], per[which])
        shift = np.repeat(start, per[which])
        ids, begin, end = ids[take].astype("<u4"), begin[take] + shift, end[take] + shift
        cuts = np.append(np.cumsum(per[which]), 0)[np.searchsorted(start, ends) - 1] if len(start) else np.zeros(len(texts), np.int64)
        cuts[sizes == 0] = 0
        cuts = np.maximum.accumulate(cuts)
        out, a = [], 0
        for k, b in enumerate(cuts.tolist()):
            x, y = begin[a:b], end[a:b]
            if aligns[k] is None:
                base = total[begins[k]]
                spans, size = np.stack([total[x] - base, total[y] - base], 1), total[ends[k]] - base
            else:
                align = aligns[k]
                spans, size = np.stack([align[x - begins[k]], align[y - begins[k]]], 1), align[-1]
            out.append((np.concatenate([[m.bos_id], ids[a:b], [m.eos_id]]).astype("<u4"), np.concatenate([[[0, 0]], spans, [[size, size]]])))
            a = b
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a leading space mark goes, byte pieces join to characters, broken ones become U+FFFD each."""
        m = self.model
        try:
            out = b"".join(map(m.decoded.__getitem__, ids))
        except TypeError:
            raise ValueError("ids must be integers") from None
        if m.dummy_prefix or m.squeeze:
            for i in ids:
                if m.kinds[i] != CONTROL:
                    if m.kinds[i] == NORMAL and m.pieces[i].startswith(SPACE):
                        out = out[1:]
                    break
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids, out)

    def _decode_broken(self, ids: list[int], joined: bytes) -> str:
        text, i = [], 0
        while i < len(joined):
            for n in (1, 2, 3, 4):
                try:
                    text.append(joined[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                text.append("�")
                i += 1
        return "".join(text)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _runs(column):
    """The texts of a column in runs of about RUN_CHARS characters."""
    run, size = [], 0
    for text in column.to_pylist():
        run.append(text)
        size += len(text or "")
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _encode(blob: bytes, spans: bool):
    def run(batches):
        codec = Codec.of(blob)
        for batch in batches:
            ids, begin, end = [], [], []
            for i, s in (x for run_ in _runs(batch.column("text")) for x in codec.encode_many(run_)):
                ids.append(i.astype(np.int32))
                begin.append(s[:, 0])
                end.append(s[:, 1])
            columns = [pa.array(ids, pa.list_(pa.int32()))] + ([pa.array(x, pa.list_(pa.int64())) for x in (begin, end)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "begin", "end"][: 2 + 2 * spans])

    return run


def encode(docs: DataFrame, model: bytes, spans: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, and with spans begin and end: each piece's bytes of the text's UTF-8."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(model, spans), "doc_id long, ids array<int>" + (", begin array<long>, end array<long>" if spans else ""))


def _decode(blob: bytes):
    def run(batches):
        codec = Codec.of(blob)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text; null ids give a null text."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(model), "doc_id long, text string")


def _digests(blob: bytes):
    def run(batches):
        codec = Codec.of(blob)
        for batch in batches:
            n, ids_sum, text_sum, span_sum = [], [], [], []
            for ids, spans in (x for run_ in _runs(batch.column("text")) for x in codec.encode_many(run_)):
                n.append(len(ids))
                ids_sum.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sum.append(hashlib.sha256(codec.decode(ids.tolist()).encode()).hexdigest())
                span_sum.append(hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
            columns = [pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (ids_sum, text_sum, span_sum)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
        kernel.release()

    return run


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens and SHA-256 of the ids (32-bit little-endian), of the text decoded from them, and of the spans (64-bit pairs)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def _with_ids(blob: bytes, ids_name: str, same_name: str):
    def run(batches):
        codec = Codec.of(blob)
        for batch in batches:
            ids, same = [], []
            for texts in _runs(batch.column("text")):
                for text, (found, _) in zip(texts, codec.encode_many(texts), strict=True):
                    ids.append(found.astype(np.int32))
                    same.append(codec.decode(found.tolist()) == (text or ""))
            batch = batch.append_column(ids_name, pa.array(ids, pa.list_(pa.int32())))
            yield batch.append_column(same_name, pa.array(same, pa.bool_()))
        kernel.release()

    return run


def with_ids(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with all their columns, ids, and round_trip: whether ids decode to the text again (names that are taken get an underscore)."""
    ids, same = scratch.fresh("ids", docs.columns), scratch.fresh("round_trip", docs.columns)
    schema = T.StructType([*docs.schema.fields]).add(ids, T.ArrayType(T.IntegerType())).add(same, T.BooleanType())
    return docs.mapInArrow(_with_ids(model, ids, same), schema)
