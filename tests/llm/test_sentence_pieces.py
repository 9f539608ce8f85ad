"""Piece encoding against the public library: ids, spans, decoded texts, normalisation and its offsets."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from barloom.llm import sentence_pieces as S
from barloom.llm.catalog import LLM_QUERIES

PATH = public_tokenizers.path(S.MODEL)
CODEC = S.Codec(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "  a", "a  b   ", "a▁b", "▁", "▁▁ ▁", "日本語のテキスト 😀👍 x", "a\x00b", "\n\t x", "x" * 300, "é" * 100, " 😀", "ﬁ ① Ａ",
    "<s> </s> <0x41> <unk>", "�", "  ﬁ①  Ａ　b ", "ｶﾞ x", " a​ b", "ÄÖ",
]


def same(text: str):
    ids, begins, ends = CODEC.encode(text.encode())
    expected = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == expected
    assert CODEC.decode(ids).decode() == LIBRARY.decode(expected)
    spans = [(p.begin, p.end) for p in LIBRARY.encode(text.encode(), return_type="proto").pieces]
    assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist())) == spans


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁.é日😀\n"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(259, 31_999)), max_size=10))
def test_any_ids(ids):
    assert CODEC.decode(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids)


def test_short_and_long_merges_agree():
    rng = random.Random(3)
    for _ in range(300):
        chunk = "".join(rng.choice("thereaonlsi") for _ in range(rng.randint(1, 60)))
        assert CODEC._merged_short(chunk) == CODEC._merged_long(chunk)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("trim", [False, True])
def test_character_maps(rule, prefix, trim):
    library = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = S.Normaliser(model.normalizer_spec.precompiled_charsmap, prefix, trim)
    rng = random.Random(1)
    texts = [t.encode() for t in ODD] + ["".join(rng.choice("ab  ▁éﬁ①Ａ日😀\n　") for _ in range(12)).encode() for _ in range(200)]
    for text in [*texts, b"a\xff\xc3 b", b"\xe2\x96"]:
        new, offsets = library.normalize(text, with_offsets=True)
        mine, own_offsets = own(text)
        assert mine == (new if isinstance(new, bytes) else new.encode())
        assert not offsets or own_offsets.tolist() == list(offsets)


def test_query_equals_library(spark, small_sf):
    import hashlib

    rows = spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in LLM_QUERIES["op12_sentence_pieces"][0](spark, small_sf).collect()}
    assert len(found) == len(rows)
    for doc, text in rows:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        r = found[doc]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_rows_round_trip_and_spans(spark):
    rows = [(1, "Le château d'été"), (1, "Le château d'été"), (2, None), (None, "日 😀"), (4, ""), (5, "z" * 50_000), (6, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("ids", "body", "begins")})
    encoded = S.encode(docs).collect()
    texts = sorted((str(d), t) for d, t in S.decode(S.encode(docs)).collect())
    assert texts == sorted((str(d), t or "") for d, t in rows)
    for r in encoded:
        if r["doc_id"] == 1:  # the spans of a text without spaces of its own tile it
            text = rows[0][1].encode()
            assert b"".join(text[b:e] for b, e in zip(r["begins"], r["ends"])) == text
    assert S.encode(docs.limit(0)).count() == 0 and S.digest(docs.limit(0)).count() == 0
    assert S.digest(docs).count() == len(rows)
    broken = docs.limit(1).select("doc_id", F.expr("cast(X'61FF20C3' as string)").alias("text"))
    assert S.decode(S.encode(broken)).first()["text"] == "a� �"
