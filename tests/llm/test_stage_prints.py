"""The near-duplicate stage of the pipeline joins what op2 joins."""

from __future__ import annotations

from tidemark.llm import simhash, similar, stages


def test_documents_with_near_fingerprints_are_joined(spark):
    words = [f"w{i}" for i in range(600)]
    same = "a " * 800
    rows = [(1, " ".join(words)), (2, same), (3, same + "c d e f g"), (4, " ".join(reversed(words))), (5, None), (6, "")]
    near = (simhash.fingerprint(rows[1][1]) ^ simhash.fingerprint(rows[2][1])) & (2**64 - 1)
    assert near.bit_count() <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.drop_similar(spark, docs, "").collect()) == [1, 2, 4, 5]


def test_links_of_fingerprints_need_no_component_search(spark, monkeypatch):
    """They join the sets of a chain of fingerprints, and the sets of one fingerprint, as components would."""
    rows = [(10, 0), (11, 0), (20, 3), (30, 15), (30, 1 << 60), (40, 1 << 60), (50, 0xFFFF << 20)]
    monkeypatch.setattr(similar, "components", None)
    found = similar.print_links(spark.createDataFrame(rows, "fp long, print long"))
    group = {fp: fp for fp, _ in rows}
    for a, b in [tuple(r) for r in found.collect()]:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {fp: new if g == old else g for fp, g in group.items()}
    assert group == {10: 10, 11: 10, 20: 10, 30: 10, 40: 10, 50: 50}
