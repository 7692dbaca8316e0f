"""Encoding and decoding against the sentencepiece library, spans against the source bytes."""
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces, queries
from tests.llm.data import SF, texts_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "▁", "a▁b", "\n\t\r\n", "é é ﬁ Ａ", "日本語テキスト", "👩‍👩‍👧 🇩🇪", "\x00\x01\x7f", "x" * 300, "ab" * 5000, "<s> </s> <unk> <0x41>", "​﻿­", "über straße МОСКВА مرحبا"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec.of(queries.piece_model())


def check(library, codec, texts):
    for text, (ids, spans) in zip(texts, codec.encode_many(texts), strict=True):
        want = library.encode(text, out_type=int, add_bos=True, add_eos=True)
        assert ids.tolist() == want, repr(text)[:80]
        assert codec.decode(want) == library.decode(want), repr(text)[:80]
        raw = text.encode()
        assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(raw)] * 2
        assert (spans[1:, 0] >= spans[:-1, 0]).all() and (spans[:, 0] <= spans[:, 1]).all()
        for k, (i, (a, b)) in enumerate(zip(ids[1:-1].tolist(), spans[1:-1].tolist(), strict=True)):
            if codec.model.kinds[i] == pieces.NORMAL and "▁" not in text:
                assert raw[a:b].decode().replace(" ", "▁") == codec.model.pieces[i][k == 0 :], repr(text)[:80]


def test_odd_texts(library, codec):
    check(library, codec, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(texts):
    check(sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Codec.of(queries.piece_model()), texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_any_ids_decode(ids):
    codec, library = pieces.Codec.of(queries.piece_model()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert codec.decode(ids) == library.decode(ids)


def test_query_equals_library(spark, library):
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    for doc_id, text in texts_of("documents"):
        ids = library.encode(text or "", out_type=int, add_bos=True, add_eos=True)
        r = got.pop(doc_id)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not got


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a b", "y"), (2, "a b", "y")], "doc_id int, text string, ids string")
    model = queries.piece_model()
    encoded = pieces.encode(docs, model)
    assert [len(r.ids) for r in encoded.orderBy("doc_id").collect()] == [2, 4, 4]
    assert sorted(r.text for r in pieces.decode(encoded, model).collect()) == ["", "a b", "a b"]
    assert pieces.with_ids(docs, model).columns == ["doc_id", "text", "ids", "_ids", "round_trip"]
    assert pieces.encode(docs.limit(0), model).count() == 0


def with_map(squeeze, prefix):
    """The public model with a compiled character map (NFKC and more), as the library's own normalizer compiles it."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze).serialized_model_proto()
    spec = next(v for n, v in pieces.fields(spec) if n == 3)
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    out = b"".join(varint(n << 3 | 2) + varint(len(v)) + v for n, v in pieces.fields(queries.piece_model()) if n in (1, 2))
    return out + varint(3 << 3 | 2) + varint(len(spec)) + spec


MAPPED = [*ODD, "ﬁne ﬀ ½ ㍿ Å", "ａｂｃ　ｄ", "カ゛ガ ｶﾞ", "é é ǅ ſt", "  lead and   trail ﬁ  ", "①②③ 𝔄𝔅 ℌ", "  x​y", "한국어 각"]


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_longest_prefix_normalisation(squeeze, prefix):
    """Ids, texts and spans through the compiled map equal the library's."""
    blob = with_map(squeeze, prefix)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.Codec(pieces.Model(blob))
    assert codec.model.map.units and codec.model.squeeze == squeeze
    for text, (ids, spans) in zip(MAPPED, codec.encode_many(MAPPED), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert codec.decode(want) == library.decode(want), text
        proto = library.encode(text, return_type="proto")
        raw = text.encode()
        assert [(p.id, p.surface) for p in proto.pieces if p.surface] == [(i, raw[a:b].decode()) for i, (a, b) in zip(ids[1:-1].tolist(), spans[1:-1].tolist(), strict=True) if a < b and i not in set(codec.model.byte_ids)] or set(ids.tolist()) & set(codec.model.byte_ids), text


def test_a_ligature_projects_to_its_own_bytes():
    codec = pieces.Codec(pieces.Model(with_map(True, True)))
    ids, spans = codec.encode("ﬁx")
    assert "".join(codec.model.pieces[i] for i in ids[1:-1]) == "▁fix" and codec.model.normalise("ﬁx")[1].tolist() == [0, 0, 0, 3, 4]
    assert spans[-2].tolist()[1] == 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text_through_the_map(texts):
    blob = with_map(True, True)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.Codec.of(blob)
    for text, (ids, spans) in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert (spans[1:, 0] >= spans[:-1, 0]).all() and (spans[:, 0] <= spans[:, 1]).all()


@pytest.mark.parametrize("n", [11, 13])
def test_segments_that_hash_alike_are_compared(library, codec, monkeypatch, n):
    word = [0]
    for _ in range(n):
        word += [1 - x for x in word]
    a = "".join("ab"[x] for x in word)
    texts = [a, a.translate({97: 98, 98: 97}), f"{a} x {a.translate({97: 98, 98: 97})}", "one two one"]
    check(library, codec, texts)
    # even if every segment hashes alike
    monkeypatch.setattr(pieces.kernel.Rolling, "hash", lambda self, start, end: start.astype("u8") * 0)
    check(library, codec, [*texts, *ODD])
