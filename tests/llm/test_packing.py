"""Token pieces and their packing: exact ids, whole documents, full and gapless sequences."""

from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing
from tidemark.llm.q_packing import packed_digest, tokenizer_path

TEXTS = ["a  b c", " x", "x ", "a\n b", "a \nb", "\n a b\n", "  ", "don't it's  a", "<|endoftext|> a", "tab\t b", "",
         None, "same same", "same same", "wörd éü " * 900, "x" * 5000, "one two three " * 400]


def whole(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def test_parts_encode_like_the_whole_text():
    one = packing.encoder(tokenizer_path())
    for text in TEXTS:
        assert np.frombuffer(one(text), "<u4").tolist() == whole(text)[:-1]


def test_pieces_rebuild_every_document(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = defaultdict(list)
    for r in packing.pieces(docs, tokenizer_path()).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for i, text in enumerate(TEXTS):
        parts, ids = sorted(got[i]), whole(text)
        assert [x for p in parts for x in p[3]] == ids
        assert [p[0] for p in parts] == list(range(-(-len(ids) // 1024)))
        assert all(p[2] == len(p[3]) == (1024 if k else len(ids) - 1024 * (len(parts) - 1)) for k, p in enumerate(parts))
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))]


def test_sequences_are_gapless_and_within_capacity(spark):
    rows = [(None if i % 7 == 0 else i % 5, t) for i, t in enumerate(TEXTS * 3)]
    out = packed_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    assert len(out) == sum(-(-len(whole(t)) // 1024) for _, t in rows)


def test_empty_table(spark):
    assert packed_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute(lengths, cap):
    """The rule by trying every open sequence; squares are summed anew each time."""
    gaps, total = [], lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
    for size in lengths:
        tries = [(total(gaps[:i] + [g - size] + gaps[i + 1:]), g, i) for i, g in enumerate(gaps) if g >= size and g]
        if tries:
            best = min(tries, key=lambda x: x[:2])
            gaps[best[2]] -= size
        else:
            gaps.append(cap - size)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_place_follows_the_rule(seed):
    lengths = np.random.default_rng(seed).integers(1, 31, 80)
    seq, off = packing.place(lengths, 30)
    left = [30] * (seq.max() + 1)
    for s, o, n in zip(seq, off, lengths):
        assert o == 30 - left[s]
        left[s] -= n
    assert sorted(left) == brute(lengths.tolist(), 30)
