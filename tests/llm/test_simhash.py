import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lintel.llm import simhash as sh


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = ["A b C d e É", "one", "one two three", "", None, "\x1c x", " \x0b\x0c ", "w " * 1000, "Ab ab AB ab ab", "\x85 \xa0 nbsp is a word"]
    assert [int(x) for x in sh.fingerprints(pa.array(texts, pa.string()))] == [brute_fp(t) for t in texts]


def test_bound():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)
    count = lambda v: np.stack([(v >> np.uint64(2 * k) & np.uint64(1)) + (v >> np.uint64(2 * k + 1) & np.uint64(1)) for k in range(32)]).astype(int)
    manhattan = np.abs(count(x) - count(y)).sum(0)
    assert (np.bitwise_count(sh._unary(x) ^ sh._unary(y)) == manhattan).all() and (manhattan <= np.bitwise_count(x ^ y)).all()


@pytest.mark.parametrize("cell_rows", [16384, 60])
@pytest.mark.parametrize("groups", [None, 5, 8])
def test_links_close_as_all_pairs(spark, cell_rows, groups):
    """Dense balls, chains and scattered ones; small cells are cut into blocks."""
    rng = np.random.default_rng(1)
    flip = lambda b, n, k: b ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    chain = np.bitwise_xor.accumulate(np.concatenate([base[:1], np.uint64(15) << (np.arange(15, dtype=np.uint64) * np.uint64(4))]))
    x = np.unique(np.concatenate([flip(base[1], 300, 3), flip(base[2], 100, 2), flip(base[3], 40, 4), chain, base, np.array([0, 1, 2**64 - 1], np.uint64)]))
    df = spark.createDataFrame(pd.DataFrame({"fp": x.view(np.int64)}))
    links = sh.fingerprint_links(df, groups=groups, cell_rows=cell_rows).cache()
    assert all((int(r["a"]) ^ int(r["b"])).bit_count() <= 4 or bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    got = {r["node"]: r["component"] for r in sh.components(links).collect()}
    want = brute_components(x)
    label = [got.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for c, (d, _) in zip(comp, rows):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted((str(d), f, str(least.get(c))) for (d, _), f, c in zip(rows, fps, comp))


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in sh.near_duplicates(odd).collect())
    assert got == brute(rows)


def test_query(spark, sf):
    got = sh.op8_simhash_near_dedup(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((str(r[0]), int(r[1], 16), str(r[2])) for r in got.collect()) == brute(rows) and got.filter(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y)


def edited(text, share, rng):
    w = text.split(" ")
    for i in rng.choice(len(w), max(1, round(share * len(w))), replace=False):
        w[i] = f"word{rng.integers(1000)}"
    return " ".join(w)


@pytest.mark.parametrize("star", [64, 2])
def test_similar_documents_against_all_pairs(spark, sf, star, monkeypatch):
    """Every class is held together by pairs of 0.8 or more of their shingles, and nearly all such pairs are in one class."""
    monkeypatch.setattr(sh, "STAR", star)
    rng = np.random.default_rng(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    long = [t for _, t in rows if 60 < len(t.split(" ")) < 3000][:40]
    rows += [(10_000 + k, edited(t, (0.004, 0.01, 0.02, 0.04)[k % 4], rng)) for k, t in enumerate(long * 2)] + [(20_000 + k, long[0].upper()) for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    together = [got[rows[i][0]] == got[rows[j][0]] for i, j in pairs]
    assert len(pairs) > 60 and np.mean(together) >= 0.9
    joined = {d: d for d, _ in rows}
    for i, j in sorted(pairs):
        if got[rows[i][0]] == got[rows[j][0]]:
            x, y = joined[rows[i][0]], joined[rows[j][0]]
            joined = {d: min(x, y) if v in (x, y) else v for d, v in joined.items()}
    assert joined == got


def test_similar_odd_rows(spark, odd):
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in sh.similar_documents(odd).collect())
    empty = {"2", "3", "4"}
    want = [(str(r["doc_id"]), "1" if str(r["doc_id"]) in ("1", "7") else "2" if str(r["doc_id"]) in empty or r["text"] is None else str(r["doc_id"])) for r in odd.collect()]
    assert got == sorted(want)


def test_deduplicate(spark, odd):
    out = sh.deduplicate(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    comp = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(odd).collect() if r["doc_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(comp.values())) and ids.count(None) == 2


def test_one_id_of_two_texts(spark):
    """Each row is decided on by its own text, and no group goes as a whole."""
    a, b = "alpha beta gamma delta epsilon zeta", "some other words stand here in line"
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (5, b, "z"), (5, b, "z"), (6, "on its own it stays whole", None), (6, "on its own it stays whole", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    assert sorted(tuple(r)[:2] for r in sh.deduplicate(df).collect()) == [(1, a), (2, b), (6, "on its own it stays whole")]


def test_empty(spark, none):
    assert sh.near_duplicates(none).collect() == [] and sh.similar_documents(none).collect() == [] and sh.deduplicate(none).collect() == []


def test_tables_in_one_pass(spark):
    """Rows of different tables never link, whether a cell is cut into blocks or not."""
    rows = [(t, base ^ (1 << b)) for t, base in ((0, 0), (1, 0), (2, 12345 << 20)) for b in range(40)]
    df = spark.createDataFrame([(t, f, 1000 * t + k % 40, (1 << 40) - 1 if k % 40 >= 30 else 0) for k, (t, f) in enumerate(rows)], "t int, fp long, node long, own long")
    for cell_rows in (16384, 10):
        links = sh.fingerprint_links(df, groups=6, cell_rows=cell_rows, by="t", own_radius=20).collect()
        assert all(r["a"] // 1000 == r["b"] // 1000 for r in links)
        for t in range(3):  # the last ten are far off by their own fingerprints
            mine = range(1000 * t, 1000 * t + 40)
            assert brute_closure(mine, [(r["a"], r["b"]) for r in links if r["a"] in mine]) == 2


def brute_closure(nodes, links):
    label = {n: n for n in nodes}
    for a, b in links:
        x, y = label[a], label[b]
        label = {n: x if v == y else v for n, v in label.items()}
    return len(set(label.values()))


def all_pairs(rows):
    """The least id of each row's class, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = [d for d, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return {d: c for (d, _), c in zip(rows, label)}


def test_failed_candidate_hides_no_link(spark):
    """Texts around one that is close to all by fingerprints, and similar to few: what it fails to link, others do; edits from just above to just below 0.8."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = " ".join(f"w{x}" for x in rng.integers(0, 4000, 150))
        for k in range(10):
            rows.append((100 * g + k, edited(base, (2 + k % 3) / 150, rng)))
    got = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs(rows)


@pytest.mark.parametrize("full, common", [(8, 3), (1, 3), (2, 10**9)])
def test_similar_documents_are_all_pairs(spark, sf, full, common, monkeypatch):
    """No link of 0.8 or more is lost: texts with a line in common, groups of near copies, tiny texts; one comparison a round or more, with and without an order by how common shingles are."""
    monkeypatch.setattr(sh, "FULL", full)
    monkeypatch.setattr(sh, "COMMON", common)
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    line = words(12)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 1500][:60]
    base = words(120)
    rows += [(1000 + k, edited(base, (1 + k % 4) / 120, rng)) for k in range(60)] + [(2000 + k, f"{line} {words(14)}") for k in range(60)]
    rows += [(3000 + k, f"{line} {line.replace('w', 'v', k % 3)} tail") for k in range(9)] + [(4000, "a b"), (4001, "A  b"), (4002, "a c"), (4003, " "), (4004, None)]
    parts = base.split(" ")
    rows += [(5000 + k, " ".join(parts[k:] + parts[:k])) for k in (0, 13, 59, 100)]
    got = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = all_pairs(rows)
    assert got == {d: 4003 if d == 4004 else c for d, c in want.items()} and len(set(want.values())) < len(rows) - 40


def test_shared_passage_makes_no_candidates(spark, monkeypatch):
    """Texts that only have a passage in common, which nothing has counted as common, are no candidates, and their sets aren't dealt out; near copies among them are found, of long and of short texts."""
    monkeypatch.setattr(sh, "COMMON", 10**9)
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50_000, n))
    line = words(60)
    rows = [(k, f"{line} {words(200 + 7 * k)}") for k in range(60)]
    rows += [(1000 + k, edited(t, 0.02, rng)) for k, t in rows[::20]] + [(2000 + k, edited(words(30), 0.01, rng)) for k in range(3)]
    seen = {}
    kept = sh.materialize

    def noted(df, name):
        out = kept(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(sh, "materialize", noted)
    got = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs(rows) and len(set(got.values())) == len(rows) - 3
    assert sum(seen["candidates"]) < 100 and seen["shingles"][0] < 60


def test_sketches_rule_out_no_similar_text():
    """Of texts of any length and likeness: a pair of 0.8 or more passes, and of unlike ones nearly none."""
    rng = np.random.default_rng(12)
    unlike = near = passed = 0
    for n in (1, 4, 30, 70, 130, 600, 2100, 9000, 30_000):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
        texts = [base, *[base[: int(n * s) + 4] for s in (0.5, 0.79, 0.8, 0.81, 0.95)]]
        texts += [[f"x{k}" if k in at else w for k, w in enumerate(base)] for at in (set(rng.choice(n, max(1, int(n * s))).tolist()) for s in (0.005, 0.02, 0.024, 0.03, 0.2))] + [[f"y{w}" for w in base]]
        t = sh._Texts(pa.array([" ".join(x) for x in texts]))
        sets, bits = t.sets(5), np.array(t.sketches(5), object)
        test = sh._unlike(np.array([len(x) for x in sets], np.int32), bits, 0.8)
        i, j = map(np.ravel, np.indices((len(texts), len(texts))))
        out = test(i, j)
        for a, b, o in zip(i, j, out):
            both = len(np.intersect1d(sets[a], sets[b]))
            share = both / (len(sets[a]) + len(sets[b]) - both)
            assert not (o and share >= 0.8)
            near += share >= 0.8
            if share < 0.3 and 100 < n < 10_000:
                unlike, passed = unlike + 1, passed + (not o)
    assert near > 100 and unlike > 50 and passed < 0.05 * unlike


def test_texts_of_repeated_ids_keep_their_rows(spark):
    """Only rows whose id is repeated or goes are looked at again; others, and rows without an id, come through once, with any column."""
    far = sh.SLOTS + 3  # the same slot as 3
    rows = [(3, "one two three four five six", 1), (far, "another text of some words here", 2), (9, "one two three four five six", 3), (None, "one two three four five six", 4), (7, "x y", 5), (7, "x y", 5)]
    out = sh.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, `a.b` int"))
    assert sorted(r["a.b"] for r in out.collect()) == [1, 2, 4, 5]
