import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm import common


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\v\f\r\x1c\x85\xa0 ab")), max_size=30)), max_size=6))
def test_words(texts):
    off, codes, words = common.split_words(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert len(set(words)) == len(words)
    for k, t in enumerate(texts):
        assert [words[c] for c in codes[off[k] : off[k + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_of_a_slice():
    whole = pa.array(["a b", None, "c  d", "", "b e"])
    off, codes, words = common.split_words(whole.slice(2, 3))
    assert [words[int(c)].as_py() for c in codes] == ["c", "d", "b", "e"] and off.tolist() == [0, 2, 2, 4]


@pytest.mark.parametrize("most", [1, 5, 100])
def test_slices(most):
    texts = ["", None, "aaaa", "b" * 50, "c", "", "dd"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(common.byte_slices(batch, "t", most))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= most for p in parts)
    assert list(common.byte_slices(batch.slice(0, 0), "t")) == []


def test_added_columns_replace_and_others_pass(spark):
    df = spark.createDataFrame([(1, "ab", [1, 2], "x"), (2, None, None, None)], "id long, text string, more array<int>, `odd.name` string").withColumn("N", F.lit("old"))
    out = common.map_rows(df, ["text"], lambda c: {"n": np.array([len(x or "") for x in c["text"].to_pylist()])}, [("n", T.LongType())])
    assert out.columns == ["id", "text", "more", "odd.name", "n"] and [tuple(r) for r in out.orderBy("id").collect()] == [(1, "ab", [1, 2], "x", 2), (2, None, None, None, 0)]
    replaced = common.map_rows(df, ["text"], lambda c: {"text": [f"{x}!" for x in c["text"].to_pylist()]}, [("text", T.StringType())])
    assert sorted(r["text"] for r in replaced.collect()) == ["None!", "ab!"]
    kept = common.map_rows(df, ["text"], lambda c: {"_keep": [x is None for x in c["text"].to_pylist()]}, [])
    assert kept.schema == df.schema and [r["id"] for r in kept.collect()] == [2]


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in (*range(50), -7, 2**40, None)], "doc_id long")
    for r in df.withColumn("h", common.held_out()).collect():
        assert r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_tables_are_in_the_shared_folder_and_go(spark):
    df = common.materialize(spark.range(5), "t")
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir") and df._lintel_path.startswith(common.shared_dir(spark)) and df.count() == 5
    at = df._lintel_path.removeprefix("file://")
    common.discard(spark.range(1))
    common.discard(df)
    assert not __import__("os").path.exists(at)


def test_spread(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert common.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10_000_000).selectExpr("id", "id * 2 as x")
    assert common.spread(large) is large
