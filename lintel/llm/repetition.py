"""Quality rules by suffix-array repetition.

A suffix array over the words of each text, with longest common prefixes of neighbours, gives intervals of suffixes that share a prefix: the
maximal repeated passages. The union of their spans and the longest of them are held against limits. Many texts share one array: the first
rank of a word depends on its text, so no passage goes over a text's end or from one text into another.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, split_words, spread, table, tune

#: A repeated passage counts from so many words on.
MIN_WORDS = 8
#: The share of words in repeated passages up to which a text stays, in hundredths.
MAX_COVERED = 50
#: The longest repeated passage up to which a text stays, in words, for texts of which it is over a fifth as well; and that up to which any text stays.
MAX_LONGEST, MOST_LONGEST = 50, 200

SYMBOLS = "#*$%&|<>"


def _levels(rank: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of prefixes of 1, 2, 4, ... words, until all are different; positions at a text's end go before longer ones.

    Prefix doubling; from one level to the next only positions that share their rank are sorted again.
    """
    n = len(rank)
    levels = [rank]
    width = 1
    while True:
        order = np.argsort(rank, kind="stable")
        r = rank[order]
        same = np.zeros(n, bool)
        eq = r[1:] == r[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        tied = order[same]
        if not len(tied):
            return levels
        nxt = tied + width
        inside = nxt < ends[tied]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[tied]))
        t, s = tied[again], second[again]
        first = rank[t]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        # A rank is the place of its group's first member, so ranks of other groups stay.
        at = np.arange(len(t))
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        differs = new_group | np.concatenate([[True], s[1:] != s[:-1]])
        offset = np.maximum.accumulate(np.where(differs, at, 0)) - start
        if not (differs & ~new_group).any() and not inside.any():
            return levels
        rank = rank.copy()
        rank[t] = first + offset
        levels.append(rank)
        width *= 2
        if width >= n:
            return levels


def _first_rank(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys: the number of smaller ones."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.arange(len(k))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), at, 0))
    rank = np.empty(len(k), np.int32 if len(k) < 1 << 31 else np.int64)  # levels are copies of it
    rank[order] = start
    return rank


def repeats(off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length, in words, of the longest passage from there that the text has elsewhere too; and its suffix array.

    It is the larger of the longest common prefixes with both neighbours in the suffix array, and so the height of the position's deepest interval.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ends = off[1:][doc]
    levels = _levels(_first_rank(doc.astype(np.int64) << 32 | codes), ends)
    sa = np.lexsort((-np.arange(n), levels[-1])) if len(levels) > 1 else np.argsort(levels[-1], kind="stable")
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(doc[i] == doc[j])
    for k in range(len(levels) - 1, -1, -1):
        if not len(live):
            break
        a, b = i[live] + lcp[live], j[live] + lcp[live]
        fits = (np.maximum(a, b) + (1 << k)) <= ends[i[live]]
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        equal = fits & (levels[k][a] == levels[k][b])
        lcp[live[equal]] += 1 << k
    height = np.zeros(n, np.int64)
    height[sa[:-1]] = lcp
    height[sa[1:]] = np.maximum(height[sa[1:]], lcp)
    return height, sa


def _covered(height: np.ndarray, least: int, off: np.ndarray) -> np.ndarray:
    """Words of each text in the union of spans of repeated passages of at least `least` words."""
    n = len(height)
    reach = np.maximum.accumulate(np.where(height >= least, np.arange(n) + height, 0)) if n else np.zeros(0, np.int64)
    inside = np.concatenate([[0], np.cumsum(reach > np.arange(n))])
    return inside[off[1:]] - inside[off[:-1]]


def _rules(min_words: int, max_covered: int, max_longest: int, most_longest: int):
    def run(c):
        texts = pc.fill_null(c["text"], "")
        off, codes, words = split_words(texts)
        n = np.diff(off)
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(chars[codes])]) if len(codes) else np.zeros(1, np.int64)
        symbols = pc.count_substring_regex(texts, "[" + re.escape(SYMBOLS).replace("<", r"\x3c").replace(">", r"\x3e") + "]")
        height, _ = repeats(off, codes)
        top = np.concatenate([height, [0]])
        longest = np.where(n > 0, np.maximum.reduceat(top, np.minimum(off[:-1], len(height))), 0) if len(n) else n
        three = _covered(np.minimum(height, 3), 3, off)
        spans = _covered(height, min_words, off)
        lines = [_dup_lines(t) for t in texts.to_pylist()]
        failed = (n < 50) | (100 * three > 50 * n)
        bad = (100 * spans > max_covered * n) | ((longest > max_longest) & (5 * longest > n)) | (longest > most_longest)
        return {
            "n_words": n, "word_chars": total[off[1:]] - total[off[:-1]], "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": three,
            "n_covered": spans, "longest_repeat": longest, "base_failed": failed, "kept": ~failed & ~bad,
        }

    return run


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_covered", T.LongType()), ("longest_repeat", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def repetition_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST, most_longest: int = MOST_LONGEST, keep: bool | list[str] = True) -> DataFrame:
    """docs (a text column, others pass through) with counts and verdicts of each whole text.

    `n_covered` is the number of words in repeated passages of at least `min_words` words (all their occurrences), `longest_repeat` the longest of any length.
    A text fails the base rules with under 50 words, or over half of them in three-word windows found twice; the others are kept unless over
    `max_covered` hundredths of their words are covered, or the longest repeat is over `max_longest` words and a fifth of the text, or over `most_longest` words. A null or
    empty text has zeros and fails. Rows stay as they are, repeated ones too; columns of the added names are replaced.
    """
    return map_rows(docs, ["text"], _rules(min_words, max_covered, max_longest, most_longest), COLUMNS, keep)


def op5_suffix_repetition(spark, sf_dir):
    tune(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")))
    return repetition_rules(docs, keep=["doc_id"])
