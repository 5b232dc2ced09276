import re
from collections import Counter

import numpy as np
import pytest

from lintel.llm import repetition as rp


def heights(x):
    out = []
    for i in range(len(x)):
        best = 0
        for j in range(len(x)):
            n = 0
            while i != j and i + n < len(x) and j + n < len(x) and x[i + n] == x[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_heights(seed):
    rng = np.random.default_rng(seed)
    docs = [list(rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]
    off = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    got, sa = rp.repeats(off, np.array(sum(docs, []), np.int32))
    for d, (a, b) in zip(docs, zip(off, off[1:])):
        assert got[a:b].tolist() == heights(d)
    assert sorted(sa.tolist()) == list(range(off[-1]))
    for d, (a, b) in enumerate(zip(off, off[1:])):  # suffixes of a text are in order
        mine = [int(s - a) for s in sa if a <= s < b]
        assert [docs[d][s:] for s in mine] == sorted(docs[d][s:] for s in mine)


def twice(w, k):
    """Places in windows of k words that are found twice."""
    seen = {}
    for i in range(len(w) - k + 1):
        seen.setdefault(hash(tuple(w[i : i + k])), []).append(i)
    return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}


def longest_twice(w):
    low, high = 0, len(w)
    while low < high:  # a passage that is there twice has parts of every length that are
        k = (low + high + 1) // 2
        low, high = (k, high) if twice(w, k) else (low, k - 1)
    return low


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    covered = len(twice(w, rp.MIN_WORDS))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w)}, covered, longest_twice(w)


def same(rows):
    for text, r in rows:
        base, covered, longest = brute(text)
        assert {k: r[k] for k in base} == base
        assert (r["n_covered"], r["longest_repeat"]) == (covered, longest)
        n = r["n_words"]
        assert r["kept"] == (not r["base_failed"] and 100 * r["n_covered"] <= rp.MAX_COVERED * n and not (r["longest_repeat"] > rp.MAX_LONGEST and 5 * r["longest_repeat"] > n) and r["longest_repeat"] <= rp.MOST_LONGEST)


def test_odd_rows(spark, odd, none):
    got = rp.repetition_rules(odd).collect()
    assert len(got) == odd.count()
    same([(r["text"], r) for r in got])
    assert rp.repetition_rules(none).collect() == []


def test_verdicts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, f"{a} {b}", True), (2, f"{a} x {a}", False), (3, f"{a} {b}\n#*|<&\n{' '.join(a.split()[:8])}", True), (4, "a b c " * 40, False), (5, "word", False)]
    got = {r["doc_id"]: r for r in rp.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string, want boolean")).collect()}
    assert all(r["kept"] == r["want"] for r in got.values()) and got[3]["n_symbols"] == 5 and got[3]["n_covered"] == 16


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = rp.op5_suffix_repetition(spark, sf).collect()
    assert len(rows) == len(docs)
    same([(docs[r["doc_id"]], r) for r in rows])
