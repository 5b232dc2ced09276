import pytest

import corpus_pipeline as cp
from lintel.llm import common, decontamination, packing, quality, queries, simhash, toxicity
from oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == sql_rows(connect(sf), queries.oracle_sql()[name])


def test_stages(spark):
    """Each stage keeps what its operator keeps, of all that the stage before kept."""
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents").cache()
    labels, bench = common.table(spark, sf, "labels"), common.table(spark, sf, "benchmark")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    by = dict(cp.STAGES)
    assert list(by) == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]

    one = common.materialize(by["quality"](spark, docs, sf), "t1")
    assert one.schema == docs.schema and ids(one) == ids(quality.score_quality(docs, quality.train(docs, labels)).filter("predicted = 1"))
    two = common.materialize(by["toxicity"](spark, one, sf), "t2")
    assert two.schema == docs.schema and ids(two) == ids(toxicity.score_toxicity(one, toxicity.train(one, labels)).filter("predicted = 0"))
    three = common.materialize(by["near_duplicates"](spark, two, sf), "t3")
    assert three.schema == docs.schema and ids(three) == ids(simhash.similar_documents(two).filter("doc_id = component_id"))
    four = common.materialize(by["decontamination"](spark, three, sf), "t4")
    dirty = {r["doc_id"] for r in decontamination.contaminated_pairs(three, bench).collect()}
    assert four.schema == docs.schema and ids(four) == [i for i in ids(three) if i not in dirty] and dirty
    last = by["packing"](spark, four, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, last.select(*key).collect())) == sorted(map(tuple, packing.pack(four).select(*key).collect())) and set(ids(last)) == set(ids(four))
    clean = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()}
    lost = clean - set(ids(two))
    assert len(lost) <= 0.02 * len(clean)


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_odd_rows(spark, odd):
    """With the labels and the benchmark of the small tables."""
    for name, stage in cp.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.count() >= 0 and (name == "packing" or out.columns == odd.columns)
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").collect() == []


def test_near_duplicate_stage_finds_edited_copies(spark):
    """Of pairs of different texts with 0.8 or more of their five-word shingles in common, nearly all lose a document."""
    import random

    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        copy = list(words)
        for at in rng.sample(range(300), 5):
            copy[at] = f"x{k}"
        shingles = [{tuple(w[i : i + 5]) for i in range(296)} for w in (words, copy)]
        if len(shingles[0] & shingles[1]) >= 0.8 * len(shingles[0] | shingles[1]):
            pairs.append((2 * k, 2 * k + 1))
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in cp.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(pairs) > 20 and {a for a, _ in pairs} <= kept
    assert sum(b not in kept for _, b in pairs) >= 0.8 * len(pairs)
