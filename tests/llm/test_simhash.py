"""SimHash classes against a brute-force version."""

import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, p, least.get(top(i))) for i, (d, p) in enumerate(prints)), key=str)


BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [(5, BASE), (3, BASE + " tail"), (9, BASE.upper()), (2, None), (8, ""), (7, " \n\t "), (1, "One two"), (4, "one  TWO"),
        (6, "é x y z"), (6, "é x y z"), (None, "alone here now and then"), (None, "\x0b"), (12, BASE.replace("word7 ", "other "))]


def test_classes_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert got == brute_classes(ROWS)


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_class_stays(spark):
    rows = [(d, t, "x") for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_classes(ROWS)}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [1, 2, 9])
def test_components_of_a_chain_and_a_hub(spark, n):
    edges = [(i, i + 1) for i in range(100, 100 + n)] + [(7, k) for k in range(20, 20 + n)] + [(4, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 101 + n)}, 7: 7, **{k: 7 for k in range(20, 20 + n)}}


def test_links_at_two_bits_and_not_at_three(spark):
    far = [0, 1 << 63, 0b11, 0b111, 0b11111]
    rows = [((x ^ 1 << 63) - (1 << 63),) for x in far]
    got = components(simhash.links(spark.createDataFrame(rows, "fp long")))
    assert {r.root for r in got.collect()} == {-(1 << 63)}
    assert simhash.links(spark.createDataFrame([(0,), (0b111,)], "fp long")).count() == 0
