"""Best-fit packing by a plan over the histogram of lengths.

The plan is made over counts of lengths, of which there are at most `capacity`, never over documents; documents then take their planned
slots by joining on their rank within their length.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, byte_slices, fresh_path, release, shared_dir, split_words, spread, table, tune

CAPACITY = 2048
#: Words whose ids a worker remembers.
MEMORY_WORDS = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters that end many words and always make one pre-token together.
_TAIL = ".,;:!?*%&$#|"
_workers: dict = {}


def _tokenizer(path: str, plain_specials: bool):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain_specials
    return tok


@functools.cache
def loose_letters(path: str) -> list[str]:
    """Letters that join the punctuation behind them once the tokenizer has normalised them: U+0130 becomes an i with a combining dot, and
    the dot is no letter. All of Unicode is asked.
    """
    tok = _tokenizer(path, True)
    every = pa.array([chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000])  # the planes behind these have no letters
    letters = every.filter(pc.utf8_is_alpha(every)).to_pylist()
    forms = tok.normalizer.normalize_str(" ".join(letters)).split(" ")
    dots = np.cumsum([len(f) + 2 for f in forms]) - 2
    starts = {a for _, (a, _) in tok.pre_tokenizer.pre_tokenize_str(" ".join(f + "." for f in forms))}
    return [c for c, at in zip(letters, dots.tolist()) if at not in starts]


class WordIds:
    """Token ids of texts, by way of their distinct words.

    The tokenizer's normaliser and pre-tokeniser never join what white space parts, nor letters with the punctuation behind them (but for the `loose`
    ones, whose words stay whole), and fold case. So a text's ids are those of its words' letters and tails in order, and each of these is worked out
    once and remembered.
    """

    def __init__(self, path: str, plain_specials: bool = False, loose: list[str] | None = None):
        self.tok = _tokenizer(path, plain_specials)
        self.loose = pa.array(loose_letters(path) if loose is None else loose, pa.large_string())
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.forget()

    @classmethod
    def here(cls, path: str, plain_specials: bool, loose: list[str]) -> WordIds:
        """This worker process's own: what it remembers outlives a task."""
        key = (path, plain_specials)
        if key not in _workers:
            _workers[key] = cls(path, plain_specials, loose)
        return _workers[key]

    def forget(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.n = 0

    def _add(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = int(self.ends[self.n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at : at + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(units)] = at + np.cumsum(lengths)
        self.known.update(zip(units, range(self.n, self.n + len(units))))
        self.n += len(units)

    def _learn(self, units: list[str]) -> None:
        odd = [u for u in units if not u.isalpha()]
        plain = [u for u in units if u.isalpha()]
        for at in range(0, len(plain), 200):  # a word of letters is one pre-token, whose last id says so
            some = plain[at : at + 200]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(some):
                self._add(some, ids, np.diff(ends, prepend=-1))
            else:
                odd += some
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            ids = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.fromiter((x for i in ids for x in i), np.uint32), np.array([len(i) for i in ids], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, of length rows + 1; all ids)."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's string is one in its own case only
            texts = pc.ascii_lower(texts)
        off, codes, words = split_words(texts)
        if not len(codes):
            return off, np.zeros(0, np.uint32)
        core = pc.ascii_rtrim(words, _TAIL)
        last = pc.utf8_slice_codeunits(core, -1)
        core = pc.if_else(pc.and_not(pc.utf8_is_alpha(core), pc.is_in(last, value_set=self.loose.cast(last.type))), core, words)
        tail = self._tails(words, core)
        cores, tails = core.dictionary_encode(), tail.dictionary_encode()
        lists = [cores.dictionary.to_pylist(), tails.dictionary.to_pylist()]
        if len(self.known) + len(lists[0]) + len(lists[1]) > MEMORY_WORDS:
            self.forget()
        known = self.known
        if new := [u for u in dict.fromkeys(lists[0] + lists[1]) if u not in known]:
            self._learn(new)
        place = [np.fromiter(map(known.__getitem__, x), np.int64, len(x))[d.indices.to_numpy()] for x, d in zip(lists, (cores, tails))]
        unit = np.empty(2 * len(codes), np.int64)
        unit[0::2], unit[1::2] = place[0][codes], place[1][codes]
        first = self.ends[unit]
        lengths = self.ends[unit + 1] - first
        total = np.concatenate([[0], np.cumsum(lengths)])
        first -= total[:-1]
        ids = self.flat[np.repeat(first, lengths) + np.arange(total[-1])]
        return total[2 * off], ids

    @staticmethod
    def _tails(words: pa.Array, core: pa.Array) -> pa.Array:
        """What each word has behind its core: the bytes from the core's end, cut out of the words' own buffer."""
        w = words.cast(pa.large_string())
        offsets = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
        data = np.frombuffer(w.buffers()[2] or b"", np.uint8)
        size = pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, end = offsets[:-1] + size, offsets[1:]
        n = end - begin
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin - total[:-1], n) + np.arange(total[-1])
        return pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(total), pa.py_buffer(data[at].tobytes()))


def _pieces(path: str, eos: int, capacity: int, plain_specials: bool):
    loose = loose_letters(path)

    def run(batches):
        enc = WordIds.here(path, plain_specials, loose)
        ranks = np.zeros(capacity + 1, np.int64)
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in byte_slices(batch, "text", BATCH_BYTES):
                off, ids = enc.encode(part.column("text"))
                doc = part.column("doc_id").to_pylist()
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for i, d in enumerate(doc):
                    seq = np.append(ids[off[i] : off[i + 1]], np.uint32(eos)).astype("<u4")
                    for k, at in enumerate(range(0, len(seq), capacity)):
                        piece = seq[at : at + capacity]
                        rows["doc_id"].append(d)
                        rows["piece"].append(k)
                        rows["start"].append(at)
                        rows["length"].append(len(piece))
                        rows["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                length = np.array(rows["length"], np.int64)
                order = np.argsort(length, kind="stable")
                new = np.bincount(length, minlength=capacity + 1)
                within = np.empty_like(length)
                within[order] = np.arange(len(length)) - (np.cumsum(new) - new)[length[order]]
                local = ranks[length] + within
                ranks += new
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
                        pa.array(length, pa.int64()), pa.array(rows["ids_crc32"], pa.int64()), pa.array(np.full(len(length), task), pa.int32()), pa.array(local, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
                )
        release()

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset) per run of slots.

    Groups hold bins that are filled alike, so work depends on the number of distinct lengths and fillings, not on documents. Each length, from
    the longest, goes to the group with the least room that fits, and then to new bins.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that some group has
    groups: dict[int, list[tuple[int, int]]] = {}  # room: runs of (first sequence, bins)
    next_seq = 0

    def put(room, run):
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, first, bins = capacity, next_seq, -(-left // (capacity // length))
                next_seq += bins
            else:
                room = rooms[k]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            # Best fit fills one bin as long as this length fits before it goes to the next.
            each = room // length
            full, rest = divmod(min(left, bins * each), each)
            for n_bins, n in ((full, each), (1 if rest else 0, rest)):
                for j in range(n if n_bins else 0):
                    slots.append((length, rank, n_bins, first, capacity - room + j * length))
                    rank += n_bins
                if n_bins and room - n * length:
                    put(room - n * length, (first, n_bins))
                first, bins = first + n_bins, bins - n_bins
            if bins:
                put(room, (first, bins))
            left -= full * each + rest
    return slots


def _place(slots):
    """Fill in sequence_id and offset by rank within length: a lookup in the plan, whose size is bounded by the lengths."""
    by: dict[int, np.ndarray] = {}
    rows = np.array(sorted(slots), np.int64).reshape(-1, 5)
    for length in np.unique(rows[:, 0]):
        by[int(length)] = rows[rows[:, 0] == length]

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                p = by[int(x)]
                k = np.searchsorted(p[:, 1], rank[at], side="right") - 1
                seq[at] = p[k, 3] + rank[at] - p[k, 1]
                off[at] = p[k, 4]
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, eos: int = 0, capacity: int = CAPACITY, plain_specials: bool = False) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    docs: doc_id, text; other columns are ignored. A document is its text's ids (strings of special tokens in it give those, or plain text with `plain_specials`) and then `eos`; a null or
    empty text is `eos` alone. Only longer documents are cut, into pieces of `capacity`. Returns per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset; a row that is repeated is packed as often, a null doc_id stays null, and an empty table gives no rows. Which of the
    pieces of equal length takes which slot isn't fixed.

    Pieces without ids go to the shared folder once, each with its task and its rank among that task's pieces of its length. Counts a task and
    length, summed over tasks before it, make ranks within lengths, so no length has to meet in one task. Only the histogram, at most `capacity`
    numbers, comes to the driver.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    shared_dir(spark)
    path = fresh_path(spark, "pieces")
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, eos, capacity, plain_specials), PIECES + ", part int, local long").write.parquet(path)
    pieces = spark.read.schema(PIECES + ", part int, local long").parquet(path)
    per = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_place(plan(counts, capacity)), PIECES + ", sequence_id long, offset long")


def op7_best_fit_packing(spark, sf_dir):
    tune(spark)
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
