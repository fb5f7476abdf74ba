"""Token alignment against whole-text encodings and plain overlaps."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import token_alignment as ta
from tidemark.llm.q_alignment import op13_token_alignment
from tidemark.llm.q_packing import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = ["a", " ", "a ", "  a  b \n c ", "a\n b\t c\n\n", "<|endoftext|> </s> <0x0A>", "bad ▁ mark", "", None, "wörd éü ñ 漢字 \U0001f600",
         "don't stop, 12345 67,89!!", "\0 b", "same same", "same same", "x" * 3000, "one two three " * 900, "\x1c \x85 z", "a　 b",
         "word,next word.\nBar |, Æ.x ß?! a.b ..| é|é ². x", "Ünder.Ünder,  ., x"]


@pytest.fixture(scope="module")
def whole():
    """text -> tokens (id, bytes) of both sides by the libraries on the whole text, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel
    t, s = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    marks = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in marks} | {chr(256 + k): x for k, x in enumerate(y for y in range(256) if y not in marks)}
    assert set(code) == set(ByteLevel.alphabet())

    def run(text):
        if not text:
            return None
        a = [(i, bytes(code[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())
             for i in s.encode(text)]
        full = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == full == b"".join(x for _, x in b) else None
    return run


def plain(pair):
    """Groups and links by trying every pair of tokens."""
    spans = []
    for side in pair:
        at, out = 0, []
        for i, raw in side:
            out.append((at, at + len(raw), i))
            at += len(raw)
        spans.append(out)
    a, b = spans
    both = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    groups, lo = [], 0
    for hi in both:
        groups.append([[i for s, e, i in side if lo <= s and e <= hi] for side in (a, b)])
        lo = hi
    links, first = [], 0
    for s, e, i in a:
        while b[first][1] <= s:
            first += 1
        k = first
        while k < len(b) and b[k][0] < e:
            links.append((i, b[k][2]))
            k += 1
    return groups, links


def report(texts, whole):
    """Expected rows of a corpus."""
    found = [None if whole(t) is None else (*whole(t), *plain(whole(t))) for t in texts]
    count = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
                    sum(count[x] for x in links), sha256(shown.encode()).hexdigest()))
    return out


def values(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


@pytest.mark.parametrize("share", [1e-6, 0.01, 2.0])
def test_odd_texts(spark, whole, share):
    """With a large share some or all counts come by the join; the sums are the same."""
    docs = spark.createDataFrame([(i % 11, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = ta.alignment_report(docs, A, B, ta.Config(share)).collect()
    want = [(i % 11, *x) for i, x in enumerate(report(TEXTS, whole))]
    assert sorted((r.doc_id, *v) for r, v in zip(got, values(got))) == sorted(want)


def test_whole_table(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = op13_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in docs]
    assert values(got) == report([r.text for r in docs], whole)


@pytest.mark.parametrize("seed", range(30))
def test_stretches_against_the_common_ends(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 9, 60, 400])
    keep = rng.choice([0.1, 0.5, 0.9, 0.99])
    a, b = ([x for x in range(1, size) if rng.random() < keep] + [size] for _ in range(2))
    parts = list(ta.stretches(a, b))
    ends, i, j = [], 0, 0
    for p, q, n, m in parts:
        assert (p, q) == (i, j)
        ends += a[p:p + n] if a[p] == b[q] else [a[p + n - 1]]
        i, j = p + n, q + m
    assert (i, j) == (len(a), len(b)) and ends == sorted(set(a) & set(b))
    straight = [x[0] for x in parts if a[x[0]] == b[x[1]]]
    assert all(y - x > 1 for x, y in zip(straight, straight[1:]))  # stretches are as long as they can be
    ends = ta.group_ends(np.array(a), np.array(b), parts)
    assert [a[i - 1] for i in ends[0]] == [b[j - 1] for j in ends[1]] == sorted(set(a) & set(b))
    left, right = (x.tolist() for x in ta.links(np.array(a), np.array(b)))
    starts = [[0] + x[:-1] for x in (a, b)]
    assert list(zip(left, right)) == [(x, y) for x in range(len(a)) for y in range(len(b))
                                      if starts[0][x] < b[y] and starts[1][y] < a[x]]


def test_groups_column(spark, whole):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    for r in docs.select("id", ta.groups_column(A, B)("text").alias("g")).collect():
        pair = whole(TEXTS[r.id])
        assert [[list(x.a), list(x.b)] for x in r.g] == (plain(pair)[0] if pair else [])


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = ta.alignment_report(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in got) == [(0, 2, 4), (0, 2, 4), (3, 0, 0)]
    assert ta.alignment_report(docs.where("false"), A, B).count() == 0
