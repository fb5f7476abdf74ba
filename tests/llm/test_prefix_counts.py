"""Prefix token counts against the tokenizer itself, prefix by prefix."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_counts as pc
from tidemark.llm.q_packing import tokenizer_path
from tidemark.llm.q_prefix import op12_prefix_token_counts

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["a", " ", "   ", "  a  b ", "a\tb\n\n c", "</s> <s><unk> <0x0A>", "▁x ▁", "aaaaaaaaaaaaaaaaaaaaaaa" * 3, "x\r\n y",
         "wörd éü ñ ß 漢字 ☃ \U0001f600\U0001f600", "don't stop-believing, 12345 67,89", "\0 b", "internationalization of tokenizers",
         "　x y", " " * 45 + "z" + " " * 17, "the the the", "é ½", "==== ---- ....", "ofthethemthere"]


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(model, text):
    got, = pc.prefix_counter(PATH)(text)
    assert got == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]
    assert pc.total_counter(PATH)(text) == (got[-1],)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(model, seed):
    rng = random.Random(seed)
    pieces = [model.id_to_piece(i).replace(pc.SPACE, " ") for i in range(300, model.get_piece_size())]
    text = "".join(rng.choice(pieces + [" ", "é", "\n", "q"]) for _ in range(60))
    got, = pc.prefix_counter(PATH)(text)
    assert got == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_long_word_and_long_text(model):
    for text in ("xyz" * 30_000, "lorem ipsum dolor " * 8_000):
        assert pc.total_counter(PATH)(text) == (len(model.encode(text)),)


def test_whole_documents(spark, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op12_prefix_token_counts(spark, "/root/testdata/sf0.001").collect():
        text = docs[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(model.encode(text)), len(text.encode()))
        assert r.over_limit == (r.n_tokens > 4096)


ODD = [(1, None, "x"), (None, "", "y"), (2, "twice here", None), (2, "twice here", None)]


def test_odd_rows_and_clashing_columns(spark, model):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, counts string").withColumn("n_tokens", F.lit("clash"))
    rows = pc.prefix_table(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.counts) for r in rows) == sorted(
        (i or 0, [len(model.encode(t[:k])) for k in range(1, len(t) + 1)] if t else []) for i, t, _ in ODD)
    assert sorted((r.n_bytes, r.n_tokens) for r in pc.token_totals(docs, PATH).collect()) == [
        (0, 0), (0, 0), (10, len(model.encode("twice here"))), (10, len(model.encode("twice here")))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pc.prefix_table(docs, PATH).count() == 0
    assert pc.token_totals(docs, PATH).count() == 0


def test_questions_are_answered_from_the_counts(spark, model):
    texts = [t for t in TEXTS if t]
    table = pc.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    got = table.select("doc_id", *[pc.longest_within(F.col("counts"), b).alias(f"w{b}") for b in (0, 2, 7)],
                       *[pc.first_over(F.col("counts"), b).alias(f"o{b}") for b in (0, 2, 7)],
                       *[pc.tokens_of_prefix(F.col("counts"), F.lit(n)).alias(f"t{n}") for n in (0, 3, 10_000)]).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        n = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        for b in (0, 2, 7):
            assert r[f"w{b}"] == max(i for i, x in enumerate(n) if x <= b)
            assert r[f"o{b}"] == next((i for i, x in enumerate(n) if x > b), None)
        assert (r.t0, r.t3, r.t10000) == (0, n[min(3, len(text))], n[-1])
