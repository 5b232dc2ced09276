"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to the number of bits set in each of 32 segments of two bits. The Manhattan distance of two such vectors is never
more than the Hamming distance of the fingerprints, so pairs within a Hamming radius lie within the same radius in the embedding. A grid over
groups of segments finds these (at radius r, some g - r of g groups agree wholly), Manhattan distance thins them and Hamming distance verifies.

Near-duplicates by word shingles (`similar_documents`) don't use fingerprints, which miss some at any radius. Of each text's shingles, in one order for all texts, so many come
first that similar texts have one of these in common; texts that share one are candidates, and verified by all their shingles. Only what candidates link is joined: a
candidate that fails joins nothing, so it can't stand in for a link. Before that, sketches of the texts rule most candidates out: a bit says whether an odd number of a text's
shingles falls on it, so each bit in which two sketches differ stands for a shingle that only one of the texts has.

The vectors are held in unary: a segment's count 0, 1, 2 as 00, 01, 11. Manhattan distance is then the popcount of an exclusive or.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, map_rows, materialize, release, split_words, spread, table, tune

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Rows of one grid cell that one task compares; a larger cell is cut into blocks, and all pairs of blocks are compared by tasks of their own.
CELL_ROWS = 16_384
#: Near-duplicates by shingles: words of a shingle, and the share of the shingles of two texts, of either, that both have.
WORDS, SIMILARITY = 5, 0.8
#: The order of shingles puts common ones last. They are counted in one of STEP texts, in more while these are fewer than COUNTED; those that COMMON of these hold are common, at most
#: MOST_COMMON. Any order gives the same links: this one makes few texts share a shingle that comes first.
COUNTED, STEP, COMMON, MOST_COMMON = 8_192, 64, 3, 500_000
#: Texts that share a shingle are all compared at once if they are at most so many; of more texts the first is compared with all, then the next few, as far as they aren't joined yet.
FULL = 32
#: Rows of a cell that are all compared by their sketches, before a round begins: those without a partner go. A larger cell keeps all rows.
NEAR = 1024
#: For rounding: bounds that only spare work are looser by so much.
SLACK = 1e-6
#: Links of one text that are verified together.
STAR = 64
#: Bits of a text's sketch: 0.6 to 1.2 times its shingles, within these bounds. A text of over LONG times the most, which no sketch of so many bits can tell from another, has the least.
LEAST_BITS, MOST_BITS, LONG = 64, 8_192, 2.25
#: Words of sketches that are compared at once.
SKETCH_WORDS = 1 << 20
#: Slots of a filter of keys: some 2 MB, whatever the number of keys. It lets all of these through and, the more they are, other ones too, which a join drops.
SLOTS = 1 << 24

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _windows(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text's windows begin, the first and the last word of each): `size` words, or a whole shorter text; none for no words."""
    n = np.diff(off)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    total = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(off[:-1] - total[:-1], count) + np.arange(total[-1])
    return total, first, first + np.repeat(np.minimum(n, size), count) - 1


def _majority(h: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's hashes, of which h[total[i] : total[i + 1]] are the i-th text's."""
    count = np.diff(total)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    # Byte lanes hold up to 255, so texts are cut into runs of that many shingles.
    runs = (count[full] + 254) // 255
    run_doc = np.concatenate([[0], np.cumsum(runs)])
    cut = np.repeat(total[:-1][full], runs) + 255 * (np.arange(run_doc[-1]) - np.repeat(run_doc[:-1], runs))
    byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    fp = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[byte[:, j]], cut).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), run_doc[:-1], axis=0)
        bits = (2 * ones > count[full][:, None]).astype(np.uint64)
        fp |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * j)
    out[full] = fp
    return out


class _Texts:
    """Words of texts, A-Z in lower case, with what is worked out from them."""

    def __init__(self, texts: pa.Array):
        self.off, self.codes, self.words = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
        self.joined = " ".join(self.words.take(pa.array(self.codes)).to_pylist()).encode()
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)[self.codes] if len(self.codes) else np.zeros(0, np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    def _digests(self, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        import xxhash

        digest, buf = xxhash.xxh64_intdigest, self.joined
        return np.fromiter((digest(buf[s:e], seed) for s, e in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))

    def fingerprints(self, shingle: int, seed: int) -> np.ndarray:
        """SimHash of the XXH64 of shingles, repeats included; no word gives 0."""
        total, first, last = _windows(self.off, shingle)
        return _majority(self._digests(self.begin[first], self.end[last], seed), total)

    def keys(self) -> np.ndarray:
        """XXH64 of each text's words, space-joined."""
        full = np.flatnonzero(np.diff(self.off))
        out = np.zeros(len(self.off) - 1, np.uint64)
        out[full] = self._digests(self.begin[self.off[:-1][full]], self.end[self.off[1:][full] - 1], SEED)
        return out

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's windows begin, a hash of each window of `size` words), without a call for each."""
        import xxhash

        word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.words.to_pylist()), np.uint64, len(self.words))
        total, first, last = _windows(self.off, size)
        h = np.zeros(len(first), np.uint64)
        for k in range(size):
            at = np.minimum(first + k, last)
            h = np.where(first + k <= last, _mixed(h ^ word[self.codes[at]], 1), h)
        return total, h

    def sets(self, size: int) -> list[np.ndarray]:
        """The distinct window hashes of each text, sorted."""
        total, h = self.hashes(size)
        return [np.unique(h[a:b]) for a, b in zip(total[:-1], total[1:])]

    def sketches(self, size: int) -> list[bytes]:
        """Which of a text's bits an odd number of its distinct window hashes falls on."""
        out = []
        for x in self.sets(size):
            m = LEAST_BITS if len(x) > LONG * MOST_BITS else min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, 0.6 * len(x))))))
            odd = np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
            out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        return out

    def leading(self, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, number of the text's distinct window hashes, place) of the hashes that come first, one of which any two texts of such a similarity share."""
        total, h = self.hashes(size)
        text = np.repeat(np.arange(len(total) - 1), np.diff(total))
        order = np.lexsort((h, _ranks(h, common), text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        text, h = text[new], h[new]
        n = np.bincount(text, minlength=len(total) - 1)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        n = n[text]
        first = place <= n - np.ceil(similarity * n - SLACK)
        return text[first], h[first], n[first], place[first]


def _ranks(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each hash is, by (sorted hashes, how often each was counted); 0 for others."""
    known, count = common
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, count[at], 0)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: A-Z in lower case, words [^\\x20\\x09-\\x0D]+, shingles with repeats; no word gives 0."""
    return _Texts(texts).fingerprints(shingle, seed)


def _mixed(h: np.ndarray, table: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * table % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fingerprint(docs: DataFrame, text: str = "text", keep: bool | list[str] = True) -> DataFrame:
    """docs with its text's fingerprint as a long, fp. A null text has that of an empty one."""
    from pyspark.sql import types as T

    return map_rows(docs, [text], lambda c: {"fp": fingerprints(c[text]).view(np.int64)}, [("fp", T.LongType())], keep)


def with_key(docs: DataFrame, text: str = "text", keep: bool | list[str] = True) -> DataFrame:
    """docs with `key`, a hash of its text's words as a long. A null text has that of an empty one."""
    from pyspark.sql import types as T

    return map_rows(docs, [text], lambda c: {"key": _Texts(c[text]).keys().view(np.int64)}, [("key", T.LongType())], keep)


def with_sketch(docs: DataFrame, words: int, text: str = "text", keep: bool | list[str] = True) -> DataFrame:
    """docs with `key`, as with_key, and `bits`, the sketch of its text's shingles."""
    from pyspark.sql import types as T

    def run(c):
        t = _Texts(c[text])
        return {"key": t.keys().view(np.int64), "bits": pa.array(t.sketches(words), pa.binary())}

    return map_rows(docs, [text], run, [("key", T.LongType()), ("bits", T.BinaryType())], keep)


def _masks(groups: int, radius: int) -> list[int]:
    """A mask over the 64 unary bits for each choice of groups that agree."""
    edge = [round(32 * k / groups) * 2 for k in range(groups + 1)]
    block = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(groups)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[k] for k in c)) for c in combinations(range(groups), groups - radius)]


def _nearness(x: np.ndarray, radius: int, own: np.ndarray | None, own_radius: int):
    """Of candidate pairs i, j, which link: first by Manhattan distance of the embedding, then by Hamming distance, then by that of the texts' own fingerprints."""
    u = _unary(x)

    def near(i, j):
        got = np.bitwise_count(u[i] ^ u[j]) <= radius
        for y, r in ((x, radius), *([(own, own_radius)] if own is not None else [])):
            k = j if np.isscalar(j) else j[got]
            got[got] = np.bitwise_count(y[i[got]] ^ y[k]) <= r
        return got

    return near


def _forest(key: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within each run of equal keys: a few more than a spanning forest, never all pairs. near says which of candidate pairs link."""
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, n))
    a, b = [], []
    label = np.arange(n)
    act = np.flatnonzero(np.repeat(size <= 256, size))
    at = np.repeat(start, size)
    d = 0
    while len(act := act[act > at[act] + d]):  # each row against its cell's first one, second one, ...: links lead to few rows
        hub = at[act] + d
        i = act[label[act] != label[hub]]
        i = i[near(i, at[i] + d)]
        j = at[i] + d
        if len(i):
            a.append(j)
            b.append(i)
            lo, hi = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, hi, lo)
            while not np.array_equal(nxt := label[label], label):
                label = nxt
        d += 1
    for s, m in zip(start[size > 256], size[size > 256]):  # a search from each row through those not reached so far
        rest = np.arange(s, s + m)
        todo: list[int] = []
        while len(rest) or todo:
            if not todo:
                todo.append(int(rest[0]))
                rest = rest[1:]
            v = todo.pop()
            if not len(rest):
                break
            got = near(rest, v)
            if got.any():
                found = rest[got]
                a.append(np.full(len(found), v))
                b.append(found)
                todo.extend(found.tolist())
                rest = rest[~got]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _unary(x: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    y = x >> np.uint64(1)
    return ((x | y) & low) | (((x & y) & low) << np.uint64(1))


LINK = "combo int, cell long, a long, b long, hot boolean"


def _link(radius: int, most: int | None, own_radius: int):
    """Rows (combo, cell, fp) or (combo, cell, fp, node, own), sorted by the first three, to links of fp or node; a cell of over `most` rows comes out as it
    is, marked hot, with the row's own three numbers.
    """

    def links(c):
        change = np.concatenate([[False], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])])
        i, j = _forest(np.cumsum(change), _nearness(c[2].view(np.uint64), radius, c[4].view(np.uint64) if len(c) > 3 else None, own_radius))
        node = c[3] if len(c) > 3 else c[2]
        return out(c[0][i], c[1][i], node[i], node[j], [c[0][i]] * (len(c) - 3), False)

    def out(combo, cell, a, b, more, hot):
        cols = {"combo": pa.array(combo, pa.int32()), "cell": pa.array(cell, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "hot": pa.array(np.full(len(a), hot))}
        return pa.RecordBatch.from_pydict(cols | {n: pa.array(v, pa.int64()) for n, v in zip(("node", "own"), more)})

    def passed(c):
        return out(c[0], c[1], c[2], c[2], c[3:], True)

    def whole(c):
        """Of whole cells: the large ones as they are, the links of the others."""
        if most:
            change = np.flatnonzero(np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]))
            size = np.diff(np.append(change, len(c[0])))
            big = np.repeat(size > most, size)
            if big.any():
                yield passed([x[big] for x in c])
                c = [x[~big] for x in c]
        if len(c[0]):
            yield links(c)

    def run(batches):
        kept: list[list] = []
        rows = 0
        hot = None  # the cell that is passed through
        for batch in batches:
            now = [x.to_numpy() for x in batch.columns]
            if hot is not None:
                own = (now[0] == hot[0]) & (now[1] == hot[1])
                if own.any():
                    yield passed([x[own] for x in now])
                if own.all():
                    continue
                hot, now = None, [x[~own] for x in now]
            kept.append(now)
            rows += len(now[0])
            if rows < 65_536:
                continue
            c = [np.concatenate(x) for x in zip(*kept)]
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from whole([x[:cut] for x in c])
            c = [x[cut:] for x in c]
            if most and len(c[0]) > most:
                hot = (c[0][0], c[1][0])
                yield passed(c)
                c = [x[:0] for x in c]
            kept, rows = [c], len(c[0])
        if rows:
            yield from whole([np.concatenate(x) for x in zip(*kept)])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, groups: int | None = None, cell_rows: int = CELL_ROWS, by: str | None = None, own_radius: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` (long) whose closure is that of all pairs within the radius.

    With `by`, an int column from 0 on, only rows of the same number are compared, all numbers in one pass. With `own_radius` rows also have a `node` (long), which links
    name instead, and another fingerprint `own` (long) within whose radius a link must be too.

    Within a cell of the grid only enough links come out to join what is linked, so a dense group of n gives about n links, not n * n. `groups` sets
    how fine the grid is, and by default follows the number of fingerprints; any value gives the same closure. A cell of over `cell_rows` rows
    is cut into blocks by hash, and each pair of blocks is compared in a task of its own: no cell has to fit a task.
    """
    if groups is None:
        n = fps.count()
        groups = radius + (2 if n < (1_000_000 if by else 20_000) else 3 if n < 50_000_000 else 4 if n < 5_000_000_000 else 6)
    more = ["node", "own"] if own_radius is not None else []
    low = F.lit(0x5555555555555555).cast("long")
    x, y = F.col("fp"), F.shiftrightunsigned("fp", 1)
    unary = x.bitwiseOR(y).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(y).bitwiseAND(low), 1))
    masks = _masks(groups, radius)
    first = F.col(by) * len(masks) if by else F.lit(0)
    cells = fps.select("fp", *more, unary.alias("u"), first.alias("first")).select(
        "fp", *more, F.explode(F.array(*[F.struct((F.col("first") + k).alias("combo"), F.col("u").bitwiseAND(F.lit(m).cast("long")).alias("cell")) for k, m in enumerate(masks)])).alias("c")
    )
    schema = LINK + "".join(f", {n} long" for n in more)
    compare = lambda df, most: df.repartition("combo", "cell").sortWithinPartitions("combo", "cell", *(more[:1] or ["fp"])).mapInArrow(_link(radius, most, own_radius or 0), schema)
    found = materialize(compare(cells.select("c.combo", "c.cell", "fp", *more), cell_rows), "links")
    links = found.filter(~F.col("hot")).select("a", "b")
    hot = found.filter("hot").select("combo", "cell", F.col("a").alias("fp"), *more)
    if not hot.isEmpty():
        blocks = hot.groupBy("combo", "cell").agg(F.ceil(F.count("*") * 2 / cell_rows).cast("int").alias("blocks"))
        mine = hot.join(blocks, ["combo", "cell"]).withColumn("own_block", F.pmod(F.xxhash64("fp", *more), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = mine.select("combo", F.xxhash64("cell", F.least("own_block", "other"), F.greatest("own_block", "other")).alias("cell"), "fp", *more)
        links = links.unionByName(materialize(compare(pair, None), "hot-links").select("a", "b"))
    return links.distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes of links (a, b): component is the least node that can be reached.

    Alternates large-star and small-star steps, which shorten paths by half or so; each round's edges are a table in the shared folder.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.persist()  # used twice; lost parts are worked out again from the edges' table
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, edges = edges, materialize(small, "edges")
        large.unpersist()
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = tuple(now)
    raise RuntimeError("components didn't settle")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classes(rows: DataFrame, nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """rows with component_id, the least id of the nodes (node, least) that links join with its own."""
    found = components(links).withColumnRenamed("node", "n")
    linked = nodes.join(found, F.col(node) == F.col("n")).select(node, "least", "component")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(node, "component_id")
    alone = nodes.join(found, F.col(node) == F.col("n"), "left_anti").select(node, F.col("least").alias("component_id"))
    return rows.join(materialize(named.unionByName(alone), "components"), node)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text; other columns are ignored).

    Rows link if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that can be reached, the row's own included. Null and
    empty texts have fingerprint 0, which links like any other. Repeated rows come out as often as they go in; a row without an id takes part in
    links but names no component (where no row has an id, component_id is null). An empty table gives no rows.

    Texts are read once. Equal fingerprints are one node, with its least id, before anything is compared.
    """
    rows = materialize(with_fingerprint(_source(docs), keep=["doc_id"]), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return _classes(rows, nodes, fingerprint_links(nodes.select("fp"), radius), "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, key and component_id of each row of docs (doc_id, text; other columns are ignored), by word shingles.

    Texts of equal words, but for the case of A-Z, are one node, told by `key`. Nodes link if of the distinct shingles of `words` words that either has, at least
    the share `similarity` (over 0) is in both (a shorter text is one shingle). Classes are the closure of all such links. Null, empty and repeated rows, rows without an id and
    empty tables are as in near_duplicates.
    """
    source = _source(docs)
    rows = materialize(with_sketch(source, words, keep=["doc_id"]), "keys")
    nodes = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits")), "nodes")
    sharing = materialize(_sharing(source, _common(source, nodes, words), similarity, words), "sharing")
    close = materialize(_close(sharing, nodes, similarity), "close")
    discard(sharing)
    links = _joined(close, source, similarity, words)
    return _classes(rows.select("doc_id", "key"), nodes.select("key", "least"), links, "key").select("doc_id", "key", "component_id")


def _slots(keys: DataFrame, name: str) -> np.ndarray:
    """A filter of the keys for _held: a bit for each slot that a key falls on."""
    slots = keys.select(F.pmod(F.col(name), F.lit(SLOTS)).alias("slot"))
    found = slots.groupBy(F.expr("shiftright(slot, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(max(1, SLOTS >> 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _held(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys fall on a slot of the filter: all that it was made of, and some others."""
    slot = key.astype(np.int64) & (SLOTS - 1)
    return (slots[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _fresh(seen: set[int], key: np.ndarray) -> np.ndarray:
    """Which keys haven't been seen: spares a task most copies; those that it lets through are dropped later."""
    if len(seen) > 200_000:
        seen.clear()
    return np.array([not (k in seen or seen.add(k)) for k in key.tolist()], bool)


def _common(source: DataFrame, nodes: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of common shingles, how often each was counted): a bounded list that only the order of shingles is taken from."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                t = _Texts(part.column("text"))
                total, h = t.hashes(words)
                for i in np.flatnonzero(_fresh(seen, t.keys())):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[total[i] : total[i + 1]]).view(np.int64))], names=["h"])
        release()

    step = min(STEP, max(1, nodes.count() // COUNTED))
    some = source.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    found = materialize(some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON), "common")
    most, least = 0, COMMON
    for count, n in sorted((tuple(r) for r in found.groupBy("count").agg(F.count("*")).collect()), reverse=True):
        if (most := most + n) > MOST_COMMON:
            least = count + 1
            break
    got = found.filter(F.col("count") >= least).toArrow()
    h, count = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def _whole(batches, rows: int = 65_536):
    """The columns of batches that are sorted by the first one, in parts of whole runs of it."""
    kept, count, most = [], 0, rows
    for batch in batches:
        kept.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        count += batch.num_rows
        if count < most:
            continue
        c = [np.concatenate(x) for x in zip(*kept)]
        other = np.flatnonzero(c[0] != c[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield [x[:cut] for x in c]
        kept, count = [[x[cut:] for x in c]], len(c[0]) - cut
        most = max(rows, 2 * count)
    if count:
        yield [np.concatenate(x) for x in zip(*kept)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the run of equal values begins that each value is in, how long it is)."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(start, len(x)))
    return np.repeat(start, size), np.repeat(size, size)


def _meet(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows i and j may be as similar as that. Texts that share no earlier shingle have at most those from this one on in common; if they share one, they meet there."""
    return np.minimum(n[i] - place[i], n[j] - place[j]) >= similarity / (1 + similarity) * (n[i].astype(np.int64) + n[j]) - SLACK


def _unlike(n: np.ndarray, bits: np.ndarray, similarity: float):
    """A function of rows i and j, to those for which the sketches rule out that they are as similar as that. The larger of two sketches is folded: its bits that fall on one of the smaller are
    added modulo 2, which gives the sketch of that size.
    """
    words, size = np.frombuffer(b"".join(bits), np.uint64), np.array([len(x) >> 3 for x in bits])
    at, n = np.cumsum(size) - size, n.astype(np.int64)

    def folded(i, m):
        w = int(size[i[0]])
        return np.bitwise_xor.reduce(words[at[i][:, None] + np.arange(w)].reshape(len(i), w // m, m), axis=1)

    def unlike(i, j):
        most = (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + SLACK
        out = np.zeros(len(i), bool)
        kind = size[i] * (1 << 32) + size[j]
        for k in np.unique(kind):
            same = np.flatnonzero(kind == k)
            x, y = int(k) >> 32, int(k) & 0xFFFFFFFF
            for part in np.array_split(same, max(1, len(same) * max(x, y) // SKETCH_WORDS)):
                if len(part):
                    differ = folded(i[part], min(x, y)) ^ folded(j[part], min(x, y))
                    out[part] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) > most[part]
        return out

    return unlike


def _paired(h: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float, unlike=None) -> np.ndarray:
    """Which rows may be similar to another one of their cell, also by their sketches where there are such; of a large cell all."""
    at, size = _runs(h)
    out = size > (NEAR if unlike else 2 * FULL)
    act = np.flatnonzero(~out)
    d = 1
    while len(act := act[act - d >= at[act]]):
        got = act[~(out[act] & out[act - d])]
        got = got[_meet(n, place, got, got - d, similarity)]
        if unlike:
            got = got[~unlike(got, got - d)]
        out[got] = out[got - d] = True
        d += 1
    return out


CELLS = "h long, node long, n int, place int"
CLOSE = f"{CELLS}, bits binary, other long"


def _sharing(source: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float, words: int) -> DataFrame:
    """Rows (h, node, n, place): a shingle that comes first in several nodes' texts, such a node, how many shingles its text has and where h is among these."""

    def leading(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                t = _Texts(part.column("text"))
                key = t.keys().view(np.int64)
                fresh = _fresh(seen, key)
                text, h, n, place = t.leading(words, similarity, common)
                got = fresh[text]
                yield pa.RecordBatch.from_arrays([pa.array(h[got].view(np.int64)), pa.array(key[text[got]]), pa.array(n[got], pa.int32()), pa.array(place[got], pa.int32())], names=["h", "node", "n", "place"])
        release()

    def shared(batches):
        for c in _whole(batches):
            new = np.ones(len(c[0]), bool)
            new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
            c = [x[new] for x in c]
            several = _paired(*c, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in c], names=["h", "node", "n", "place"])
        release()

    return source.select("text").mapInArrow(leading, CELLS).repartition("h").sortWithinPartitions("h", "node").mapInArrow(shared, CELLS)


def _close(sharing: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of a cell of at most FULL rows the candidates (node, other), all at once; of a larger one its rows with their sketches (bits; other is null), but for those that these leave no partner in the cell."""
    names = [x.split(" ")[0] for x in CLOSE.split(", ")]

    def run(batches):
        for h, node, n, place, bits in _whole(batches):
            unlike = _unlike(n, bits, similarity)
            few = _runs(h)[1] <= FULL
            for i, j in _candidates(h, node, n, place, node, unlike, 0, FULL, similarity, few):
                none = pa.nulls(len(i))
                yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(node[j]), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(node[i])], names=names)
            many = np.flatnonzero(~few)
            if len(many):
                c = [x[many] for x in (h, node, n, place, bits)]
                near = _paired(*c[:4], similarity, _unlike(c[2], c[4], similarity))
                yield pa.RecordBatch.from_arrays([*[pa.array(x[near]) for x in c[:4]], pa.array(c[4][near], pa.binary()), pa.nulls(int(near.sum()), pa.int64())], names=names)
        release()

    known = sharing.join(nodes.select(F.col("key").alias("node"), "bits"), "node").select("h", "node", "n", "place", "bits")
    return known.repartition("h").sortWithinPartitions("h", "node").mapInArrow(run, CLOSE)


def _candidates(h, node, n, place, label, unlike, lo: int, hi: int, similarity: float, of: np.ndarray | None = None):
    """Rows i and j, again and again, of candidates of different labels, of which j is one of the lo-th to hi-th row of the cell; of few rows all. `of`: the rows whose cells are gone through."""
    at, size = _runs(h)
    index = np.arange(len(h)) - at
    end = np.where(size <= FULL, FULL, hi)
    act = np.flatnonzero(index > lo if of is None else (index > lo) & of)
    k = lo
    while len(act := act[(index[act] > k) & (end[act] > k)]):
        i = act[label[act] != label[at[act] + k]]
        j = at[i] + k
        got = _meet(n, place, i, j, similarity)
        got[got] = ~unlike(i[got], j[got])
        if got.any():
            yield i[got], j[got]
        k += 1


def _pairs(lo: int, hi: int, similarity: float):
    """Rows (h, node, n, place, bits, label), sorted by the first two, to candidates (a, b) of different labels, of which a is one of the lo-th to hi-th node of h; of few nodes all."""

    def run(batches):
        for h, node, n, place, bits, label in _whole(batches):
            for i, j in _candidates(h, node, n, place, label, _unlike(n, bits, similarity), lo, hi, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(node[j]), pa.array(node[i])], names=["a", "b"])
        release()

    return run


def _joined(close: DataFrame, source: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a, b) of nodes that are as similar as that, whose closure is that of all such links.

    The candidates of small cells are there at once. Rounds: of a larger cell, the nodes that share a shingle, first one is compared with all others, then 7, 56, ... more with those that verified links haven't joined with them yet, until each pair
    of nodes has been compared or joined. So a dense group of n takes about n comparisons, and no candidate is left out.
    """
    small = close.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    cells = close.filter("other is null").drop("other")
    shingles = materialize(_shingles(source, small.select(F.col("a").alias("key")).union(small.select("b")).union(cells.select("node")), words), "shingles")
    lo, hi, links = 0, 1, None
    now = cells.withColumn("label", F.col("node"))
    while True:
        met = now.repartition("h").sortWithinPartitions("h", "node").mapInArrow(_pairs(lo, hi, similarity), "a long, b long")
        met = met if links is not None else met.union(small)
        found = _verified(materialize(met.distinct(), "candidates"), shingles, similarity)
        links = found if links is None else links.unionByName(found)
        large = now.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > max(hi, FULL)).select("h")
        if large.isEmpty():
            return links
        cells = materialize(now.join(large, "h", "left_semi").select("h", "node", "n", "place", "bits"), "cells")
        labels = components(links).withColumnRenamed("component", "label")
        named = cells.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h")
        now = materialize(named.join(apart, "h", "left_semi").select("h", "node", "n", "place", "bits", "label"), "cells")
        if now.isEmpty():
            return links
        lo, hi = hi, 8 * hi


SETS = "key long, shingles binary"


def _shingles(source: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the nodes (key): the hashes of each text's distinct shingles, sorted. Texts aren't dealt out: a task reads its own, and gives the sets of those that the nodes' filter
    holds. So there are sets of a few other texts too, and a set may be there again, by another task.
    """
    slots = _slots(nodes, "key")

    def sets(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                t = _Texts(part.column("text"))
                key = t.keys()
                total, h = t.hashes(words)
                held = np.flatnonzero(_held(slots, key) & _fresh(seen, key))
                found = [np.unique(h[total[i] : total[i + 1]]).tobytes() for i in held]
                yield pa.RecordBatch.from_arrays([pa.array(key[held].view(np.int64)), pa.array(found, pa.binary())], names=["key", "shingles"])
        release()

    return source.select("text").mapInArrow(sets, SETS)


def _verified(links: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts are as similar as that.

    A link's texts meet in a group of about STAR links of one text, so a text of many links is no single group.
    """
    many = links.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("stars"))
    stars = links.join(many, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("stars"))).alias("star"), "a", "b")
    wanted = stars.select("star", F.col("a").alias("key"), F.lit(True).alias("middle")).distinct().union(stars.select("star", F.col("b").alias("key"), F.lit(False).alias("middle")))

    def run(batches):
        star = middle = key = last = None
        for batch in batches:
            a, b = [], []
            for s, m, k, x in zip(*(c.to_pylist() for c in batch.columns)):
                if last == (last := (s, m, k)):
                    continue  # a set that is there again
                x = np.frombuffer(x, np.uint64)
                if m:
                    star, middle, key = s, x, k
                elif s == star:
                    both = len(np.intersect1d(middle, x, assume_unique=True))
                    if both >= similarity * (len(middle) + len(x) - both):
                        a.append(key)
                        b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    met = wanted.join(shingles, "key").select("star", "middle", "key", "shingles").repartition("star").sortWithinPartitions("star", F.desc("middle"), "key")
    return materialize(met.mapInArrow(run, "a long, b long"), "verified")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs with one document of each group of near-duplicates by word shingles, that of the smallest doc_id; all columns stay.

    Repeated rows of that id come down to one, and of an id of several texts each is decided on by its own. Rows without an id all stay: nothing can name them.
    """
    found = materialize(similar_documents(docs, similarity, words), "near-duplicates").filter("doc_id is not null")
    per = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")), "decisions")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    slots = _slots(per.filter("not stays or n > 1"), "doc_id")
    alone, others = _by_id(docs, slots, False), _by_id(docs, slots, True)  # only of the latter texts are dealt out
    kept = others.join(per.filter("not stays").select("doc_id"), "doc_id", "left_anti").select(*columns)
    twice = per.filter("stays and n > 1").select("doc_id")
    if twice.isEmpty():
        return alone.unionByName(kept)
    once = kept.join(twice, "doc_id", "left_anti").select(*columns)
    several = kept.join(twice, "doc_id", "left_semi").select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    keyed = with_key(several).select("row", "id", "key")
    stays = found.filter("doc_id = component_id").select(F.col("doc_id").alias("id"), "key").distinct()
    return alone.unionByName(once).unionByName(keyed.join(stays, ["id", "key"], "left_semi").dropDuplicates(["id"]).select("row.*"))


def _by_id(docs: DataFrame, slots: np.ndarray, held: bool) -> DataFrame:
    """The rows of docs whose id the filter holds, or else the others; those without an id are among the latter."""

    def run(c):
        ids = c["doc_id"].cast(pa.int64())
        return {"_keep": (_held(slots, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & pc.is_valid(ids).to_numpy(zero_copy_only=False)) == held}

    return map_rows(docs, ["doc_id", "text"], run, [])


def op8_simhash_near_dedup(spark, sf_dir):
    tune(spark)
    found = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
