import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import decontamination as dc


def brute_tiles(p, t, least):
    used_p, used_t, total = [0] * len(p), [0] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not used_p[i + n] and not used_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            used_p[i + k] = used_t[j + k] = 1
        total += n


@pytest.mark.parametrize("seed", range(60))
def test_tiles(seed):
    rng = np.random.default_rng(seed)
    p, t = [f"w{x}" for x in rng.integers(0, 4, rng.integers(4, 25))], [f"w{x}" for x in rng.integers(0, 5, rng.integers(0, 60))]
    got = [m for _, _, m, _, _ in dc.Benchmark([7], [" ".join(p)], 4).matches(pa.array([" ".join(t)], pa.string()), 1e-4)]
    assert (got[0] if got else 0) == brute_tiles(p, t, 4)


@pytest.mark.parametrize("rows", [1, 7, 1 << 20])
@pytest.mark.parametrize("clash", [False, True])
def test_tiles_in_slices_and_with_clashing_hashes(monkeypatch, rows, clash):
    """Many texts and items at a time, pairs in slices of any size, and hashes that say nothing."""
    monkeypatch.setattr(dc, "SEED_ROWS", rows)
    if clash:
        monkeypatch.setattr(dc, "_hashes", lambda prefix, power, at, size: np.zeros(len(at), np.uint64))
    rng = np.random.default_rng(rows)
    items, texts = ([[f"w{x}" for x in rng.integers(0, 3, rng.integers(0, n))] for _ in range(12)] for n in (20, 50))
    bench = dc.Benchmark(list(range(12)), [" ".join(p) for p in items], 4)
    got = {(r, i): m for r, i, m, _, n in bench.matches(pa.array([" ".join(t) for t in texts], pa.string()), 0.6)}
    want = {(r, i): m for r, t in enumerate(texts) for i, p in enumerate(items) if (m := brute_tiles(p, t, 4)) and m >= 0.6 * len(p)}
    assert want and got == want


def test_common_seeds_cost_no_product():
    """A phrase of 3,000 items that a text holds 800 times, and a text and an item of one word alone."""
    phrase = "one and the same phrase"
    items = [f"{phrase} " + " ".join(f"i{k}x{j}" for j in range(15)) for k in range(3000)]
    bench = dc.Benchmark(list(range(3001)), [*items, "a " * 200], 4)
    start = time.time()
    assert list(bench.matches(pa.array([f"{phrase} and more " * 800], pa.string()), 0.5)) == []
    assert [(i, m) for _, i, m, _, _ in bench.matches(pa.array([items[5] + f" {phrase}" * 800, "a " * 30_000], pa.string()), 0.5)] == [(5, 20), (3000, 200)]
    assert time.time() - start < 10


ITEM = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs, said the waltzing wizard quietly."
FILL = " ".join(f"filler{i}" for i in range(300))
PARTS = ["pack my box with five dozen liquor jugs", "the quick brown fox jumps over the lazy dog", "said the waltzing wizard quietly"]
DOCS = [
    (1, f"{FILL} {ITEM} {FILL}"), (2, f"{FILL} {PARTS[0]} {FILL} {PARTS[2]} x {PARTS[1]}"), (3, FILL), (4, ITEM.upper().replace(" ", "*** ")), (5, f"{FILL} the quick brown fox jumps {FILL}"), (6, ITEM), (6, ITEM), (None, ITEM), (7, None), (8, ""), (9, "\n".join(ITEM.split())),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(100, ITEM), (100, ITEM), (101, "one two"), (102, None), (None, FILL), (103, ""), (104, "entirely other words stand in this item here")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_pairs(spark, benchmark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("coverage", F.lit(5))
    once = benchmark.dropDuplicates(["item_id", "text"])
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in dc.contaminated_pairs(docs, once).collect())
    assert got == sorted([("1", 100), ("2", 100), ("4", 100), ("6", 100), ("6", 100), ("None", 100), ("9", 100)])
    kept = dc.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7, 8]


def test_odd_and_empty(spark, odd, none, benchmark):
    assert dc.contaminated_pairs(odd, benchmark).collect() == [] and dc.drop_contaminated(odd, benchmark).count() == odd.count()
    assert dc.contaminated_pairs(none, benchmark).collect() == [] and dc.contaminated_pairs(odd, benchmark.limit(0)).collect() == [] and dc.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_query_against_all_pairs(spark, sf):
    import re

    words = lambda s: [w for w in (x.strip(dc._MARKS) for x in re.findall(r"[^\x20\x09-\x0D]+", s.lower())) if w]
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = words(r["text"])
        grams = {tuple(t[i : i + 4]) for i in range(len(t) - 3)}
        for k, p in items.items():
            hit = {j for i in range(len(p) - 3) if tuple(p[i : i + 4]) in grams for j in range(i, i + 4)}
            if len(hit) >= dc.THRESHOLD * len(p) and brute_tiles(p, t, 4) >= dc.THRESHOLD * len(p):
                want.add((r["doc_id"], k))
    got = [(r["doc_id"], r["item_id"]) for r in dc.op6_greedy_tiling(spark, sf).collect()]
    assert want and set(got) == want and len(got) == len(want)
