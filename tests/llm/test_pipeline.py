"""Each stage against a brute-force version of its decision, and the whole on the smallest table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from tidemark.llm import decontaminate, packing, secrets, simhash, stages, toxicity
from tidemark.llm.common import table
from tidemark.llm.q_packing import tokenizer_path

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """The smallest table with a clashing column, nulls, empties and repeats."""
    docs = table(spark, PATH, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'k' as _key")
    extra = spark.createDataFrame([(None, None, None, None, None, "k"), (5, "", "en", "s", 0, "k"), (5, "", "en", "s", 0, "k")], docs.schema)
    return docs.unionByName(extra).cache()


def test_toxic_rows_go_and_others_stay(spark, odd):
    out = stages.drop_toxic(spark, odd, PATH)
    assert out.columns == odd.columns
    one = toxicity.scorer(toxicity.train(odd, table(spark, PATH, "labels"), stages.id_bucket(stages.F.col("doc_id"), 5) != 0))
    want = sorted(str(r) for r in odd.collect() if one(r.text)[0] < 0.5)
    assert sorted(map(str, out.collect())) == want


def test_one_of_each_class_stays(spark, odd):
    rows = odd.collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    out = simhash.keep_first(odd).collect()
    assert sorted(r.doc_id for r in out) == sorted(least[g] for g in set(group))


def test_leaks_go(spark, odd):
    find = decontaminate.finder(decontaminate.build([tuple(r) for r in table(spark, PATH, "benchmark").select("item_id", "text").collect()]))
    want = sorted(str(r) for r in odd.collect() if not find(r.text)[0])
    assert sorted(map(str, stages.drop_leaks(spark, odd, PATH).collect())) == want


def test_secrets_are_masked(spark, odd):
    out = stages.mask_secrets(spark, odd, PATH)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert secrets.scan(out).where("exists(spans, s -> s.kind in ('access', 'hex'))").count() == 0
    assert out.where("n_chars <> length(text)").count() == odd.where("n_chars <> length(text)").count()


def test_packing_holds_every_token(spark, odd):
    one = packing.encoder(tokenizer_path())
    out = stages.pack_tokens(spark, odd, PATH).collect()
    assert sum(r.length for r in out) == sum(len(one(r.text)) // 4 + 1 for r in odd.collect())


def test_whole_pipeline(spark):
    docs = table(spark, PATH, "documents").select("doc_id")
    out = corpus_pipeline.run(spark, PATH).select("doc_id").distinct()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "secrets", "packing"]
    assert 0 < out.count() < docs.count() and out.subtract(docs).count() == 0


def test_edited_copies_go_in_the_near_duplicate_stage(spark, odd):
    words = [f"u{i}" for i in range(100)]
    chain = [" ".join(words[k:] + [f"v{i}" for i in range(k)]) for k in (20, 10, 0)]  # least id far from the last, joined by the middle
    docs = odd.unionByName(spark.createDataFrame([(9001 + i, t, "en", "s", 1, "k") for i, t in enumerate(chain)], odd.schema))
    rows = docs.collect()
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := simhash.words_of(r.text)) else set() for r in rows]
    group, near = list(range(len(rows))), 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                near += bin((simhash.fingerprint(rows[i].text) ^ simhash.fingerprint(rows[j].text)) & (2**64 - 1)).count("1") > 2
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    out = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, PATH)
    assert near > 2 and out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(least[g] for g in set(group))
