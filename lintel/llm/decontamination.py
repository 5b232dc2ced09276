"""Benchmark decontamination by greedy string tiling.

Tokens are words in lower case without punctuation around them. Documents meet benchmark items at shared seeds, windows of LEAST tokens with equal
Karp-Rabin hashes; for each document and item that could reach the threshold, running Karp-Rabin at falling lengths finds matches, and the longest that overlaps
no earlier one is marked, again and again, down to LEAST tokens. What share of the item's tokens is marked doesn't depend on the order in which its parts stand.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_rows, release, split_words, spread, table, tune

#: The shortest match in tokens, and the share of an item's tokens from which a document counts as contaminated.
LEAST = 4
THRESHOLD = 0.5
#: Benchmark text that workers hold at a time, in bytes; a larger benchmark is gone through in blocks.
BLOCK_BYTES = 2 << 20

_MARKS = ".,;:!?*%&$#|\"'`()[]{}<>«»„“”‘’…-–—_/\\~^+=@"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Places of seeds in items that are looked at together.
SEED_ROWS = 1 << 20


def _norm(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), _MARKS)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct tokens): words that are punctuation alone are no tokens."""
    off, codes, words = split_words(texts)
    norm = _norm(words).dictionary_encode()
    distinct = norm.dictionary
    codes = norm.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
    if empty.any():
        full = ~empty[codes]
        off = np.concatenate([[0], np.cumsum(full)])[off]
        codes = codes[full]
    return off, codes, distinct


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes, and the powers of the base: a window's hash rolls on from those at its ends, whatever its size."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(value), _BASE)]))
    return _scan(value, power), power


def _scan(value: np.ndarray, power: np.ndarray) -> np.ndarray:
    # the sum of value[i] * inverse**(i + 1), times power[n], is the prefix's polynomial: all arithmetic is modulo 2**64, where an odd base has an inverse
    inverse = np.cumprod(np.full(len(value), _INVERSE))
    return np.concatenate([[np.uint64(0)], np.cumsum(value * inverse)]) * power


def _hashes(prefix: np.ndarray, power: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of `size` tokens from each place."""
    if not len(at):
        return np.zeros(0, np.uint64)
    return prefix[at + size] - prefix[at] * power[size]


def _stretched(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... up to n[0] numbers, then those from lo[1] on."""
    before = np.cumsum(n) - n
    return np.repeat(lo - before, n) + np.arange(int(n.sum()))


class Benchmark:
    """The items of one block, with their seeds in order of hash and a bit for each hash that can be a seed."""

    def __init__(self, ids: list, texts: list[str], least: int = LEAST):
        self.ids, self.least = ids, least
        self.off, codes, self.words = _tokens(pa.array(texts, pa.large_string()))
        self.codes = codes + 1  # 0 is any other token
        rng = np.random.default_rng(11)
        self.value = rng.integers(1, 1 << 63, len(self.words) + 1).astype(np.uint64)
        item = np.repeat(np.arange(len(texts)), np.diff(self.off))
        at = np.arange(len(codes))
        at = at[at + least <= self.off[1:][item]]
        h = _hashes(*_prefixes(self.value[self.codes]), at, least)
        order = np.lexsort((at, item[at], h))
        self.seed, self.seed_at, self.seed_item = h[order], at[order], item[at][order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, texts: pa.Array, threshold: float):
        """(row, item, marked tokens, tiles, tokens of the item) of each document and item at or over the threshold.

        A seed joins with items once a document, however often the document holds it; only pairs whose shared seeds cover enough of the item
        for the threshold go on to their places and to tiling.
        """
        off, codes, words = _tokens(texts)
        if not len(codes) or not len(self.seed):
            return
        known = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ids = known[codes]
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        k = self.least
        if len(ids) < k:
            return
        ok = np.lib.stride_tricks.sliding_window_view(ids > 0, k).all(axis=1) & (row[: len(ids) - k + 1] == row[k - 1 :])
        at = np.flatnonzero(ok)
        if not len(at):
            return
        h = _hashes(*_prefixes(self.value[ids]), at, k)
        few = self.bits[(h >> np.uint64(42)).astype(np.int64)]
        at, h = at[few], h[few]
        lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
        at, lo, n = at[lo < hi], lo[lo < hi], (hi - lo)[lo < hi]
        bounds = np.searchsorted(row[at], np.arange(len(off)))
        for r, item in self._reachable(row[at], lo, n, threshold):
            own = slice(bounds[r], bounds[r + 1])
            places = self._places(at[own], lo[own], n[own], item)
            a, z = self.off[item], self.off[item + 1]
            marked, tiles = tile(self.codes[a:z], ids[off[r] : off[r + 1]], places - off[r], self.value, k)
            if marked >= threshold * (z - a):
                yield int(r), int(item), marked, tiles, int(z - a)

    def _reachable(self, row: np.ndarray, lo: np.ndarray, n: np.ndarray, threshold: float):
        """(row, item) of which the row's seeds, each a run of n places from lo on, cover as much as the threshold asks for: tiles can't cover more.

        Rows are taken together while their places are no more than SEED_ROWS; one row has at most as many as the block.
        """
        k, size = self.least, np.diff(self.off)
        _, first = np.unique(row * len(self.seed) + lo, return_index=True)
        row, lo, n = row[first], lo[first], n[first]
        ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row)) if len(row) else np.zeros(0, int)
        total = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(row):
            z = int(ends[max(np.searchsorted(total[ends], total[a] + SEED_ROWS, "right") - 1, np.searchsorted(ends, a, "right"))])
            s, r = _stretched(lo[a:z], n[a:z]), np.repeat(row[a:z], n[a:z])
            order = np.lexsort((self.seed_at[s], r))
            s, r = s[order], r[order]
            item, at = self.seed_item[s], r * (len(self.codes) + k) + self.seed_at[s]
            gap = np.minimum(np.diff(np.append(at, at[-1] + k)), k)  # seeds of two items are at least k apart
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(item) != 0)]))
            enough = np.add.reduceat(gap, starts) >= threshold * size[item[starts]]
            yield from zip(r[starts][enough], item[starts][enough])
            a = z

    def _places(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray, item: int) -> np.ndarray:
        """Those of the document's places whose seed stands in the item."""
        seeds, back = np.unique(lo, return_inverse=True)
        counts = np.zeros(len(seeds), np.int64)
        counts[back] = n
        # a seed's places are in order of item: one search in each run, by halves
        a, z = seeds.copy(), seeds + counts
        last = z.copy()
        while (open_ := a < z).any():
            mid = (a + z) // 2
            less = np.zeros(len(a), bool)
            less[open_] = self.seed_item[mid[open_]] < item
            a, z = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, z)
        found = np.zeros(len(a), bool)
        inside = a < last
        found[inside] = self.seed_item[a[inside]] == item
        return at[found[back]]


def tile(pattern: np.ndarray, text: np.ndarray, starts: np.ndarray, value: np.ndarray, least: int) -> tuple[int, int]:
    """Greedy string tiling by running Karp-Rabin: (marked pattern tokens, tiles).

    pattern and text are codes of tokens, `value` the random number of each, `starts` the text's places at which a match of `least` tokens may begin.
    A search of some length finds all windows of that length that have no marked token and equal hashes, compared token by token; windows that follow each
    other are one maximal match. Matches are marked from the longest on, the earliest in the pattern, then in the text, of equals. One that an
    earlier tile cuts goes back as its parts, if these aren't shorter than the search. The first search is for half the pattern, and each
    further one for half the length before, down to `least`: matches of a search are all longer than those which only later ones find.
    """
    used_p, used_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    in_p, in_t = _prefixes(value[pattern]), _prefixes(value[text])
    marked = tiles = 0
    size = max(least, len(pattern) // 2)
    while True:
        for n, p, t in _longest_first(_search(pattern, text, starts, in_p, in_t, used_p, used_t, size), used_p, used_t, size):
            used_p[p : p + n] = used_t[t : t + n] = True
            marked += n
            tiles += 1
        if size == least:
            return marked, tiles
        size = max(least, size // 2)


def _free(used: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Those places at which `size` tokens are there and none is marked."""
    at = at[at + size <= len(used)]
    total = np.concatenate([[0], np.cumsum(used)])
    return at[total[at + size] == total[at]]


def _search(pattern, text, starts, in_p, in_t, used_p, used_t, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in pattern, place in text) of at least `size` unmarked tokens.

    Equal hashes are no proof: each window is compared with the first window of the pattern that has its hash, and each pair only if two windows of the
    pattern differ in spite of equal hashes. Pairs are gone through in slices of about SEED_ROWS, and only maximal matches are kept of each.
    """
    p, t = _free(used_p, np.arange(len(pattern)), size), _free(used_t, starts, size)
    if not len(p) or not len(t):
        return []
    hp, ht = _hashes(*in_p, p, size), _hashes(*in_t, t, size)
    order = np.argsort(hp, kind="stable")
    p, hp = p[order], hp[order]
    lo, n = np.searchsorted(hp, ht, "left"), np.searchsorted(hp, ht, "right")
    n = n - lo
    t, lo, n = t[n > 0], lo[n > 0], n[n > 0]
    doubt = not _equal(pattern, p, pattern, p[np.searchsorted(hp, hp, "left")], size).all()
    if not doubt:
        same = _equal(text, t, pattern, p[lo], size)
        t, lo, n = t[same], lo[same], n[same]
    runs = []
    step = max(1, SEED_ROWS // max(1, int(n.max(initial=1))))
    for a in range(0, len(t), step):
        y, x = np.repeat(t[a : a + step], n[a : a + step]), p[_stretched(lo[a : a + step], n[a : a + step])]
        if doubt:
            same = _equal(text, y, pattern, x, size)
            y, x = y[same], x[same]
        runs.append(_runs(y - x, x, np.ones(len(x), np.int64)))
    if not runs:
        return []
    diagonal, x, n = _runs(*map(np.concatenate, zip(*runs)))
    return list(zip((n + size - 1).tolist(), x.tolist(), (x + diagonal).tolist()))


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: int) -> np.ndarray:
    same = np.ones(len(at), bool)
    for j in range(size):
        same &= a[at + j] == b[bt + j]
    return same


def _runs(diagonal: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (diagonal, place, length) put together where one ends before the next."""
    order = np.lexsort((x, diagonal))
    diagonal, x, n = diagonal[order], x[order], n[order]
    if not len(x):
        return diagonal, x, n
    first = np.flatnonzero(np.concatenate([[True], (np.diff(diagonal) != 0) | (x[1:] != x[:-1] + n[:-1])]))
    return diagonal[first], x[first], np.add.reduceat(n, first)


def _longest_first(found: list[tuple[int, int, int]], used_p: np.ndarray, used_t: np.ndarray, size: int):
    """The matches to mark, in order; the caller marks each before it asks for the next."""
    heap = [(-n, p, t) for n, p, t in found]
    heapq.heapify(heap)
    while heap:
        n, p, t = heapq.heappop(heap)
        busy = used_p[p : p - n] | used_t[t : t - n]
        if not busy.any():
            yield -n, p, t
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], busy, [1]])))
        for a, z in zip(edges[0::2], edges[1::2]):
            if z - a >= size:
                heapq.heappush(heap, (-int(z - a), p + int(a), t + int(a)))


def _blocks(benchmark: DataFrame, least: int):
    """The benchmark as blocks of a bounded size, each read by the driver when its turn comes. Null texts and ids are passed over."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        if rows:
            yield Benchmark([r[0] for r in rows], [r[1] for r in rows], least)


PAIRS = "doc_id long, item_id long, coverage double, marked_words long, tiles long"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """One row for each document and benchmark item of which at least `threshold` of the tokens are tiled by the document's.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Rows: doc_id, item_id, coverage, marked_words, tiles. Null and empty texts match
    nothing, nor do items of fewer than `least` tokens; repeated rows give repeated pairs, a document without an id gives a null one, and empty
    tables give no rows. Each document is read whole, where it lies: nothing is shuffled. A benchmark of over BLOCK_BYTES is gone through in
    blocks, one pass over the documents each.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("marked_words", pa.int64()), ("tiles", pa.int64())])
            for batch in batches:
                for part in byte_slices(batch, "text"):
                    ids = part.column("doc_id")
                    rows = [(ids[r].as_py(), shared.value.ids[i], marked / size, marked, tiles) for r, i, marked, tiles, size in shared.value.matches(part.column("text"), threshold)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            release()

        found = src.mapInArrow(run, PAIRS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], PAIRS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """The rows of docs (a text column) that match no benchmark item, with all their columns."""
    spark = docs.sparkSession
    for block in _blocks(benchmark, least):
        shared = spark.sparkContext.broadcast(block)

        def run(c, shared=shared):
            keep = np.ones(len(c["text"]), bool)
            keep[[r for r, *_ in shared.value.matches(c["text"], threshold)]] = False
            return {"_keep": keep}

        docs = map_rows(docs, ["text"], run, [], True)
    return docs


def op6_greedy_tiling(spark, sf_dir):
    tune(spark)
    return contaminated_pairs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
