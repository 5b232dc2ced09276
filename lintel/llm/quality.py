"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated probabilities.

Each word has a sparse index vector from its hash and that of its shape (Aa, a, A!!). A word's vector is the sum of its neighbours' index vectors over the
training texts; a word that these don't hold has the vector of its shape. A document pools the vectors of all its words: their mean, how they spread, and
how far each lies from the next one. Nothing else about a text is an input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, map_rows, split_words, spread, table, tune
from .nn import Adam, calibrate, sigmoid

#: The bounded sample that the model is fitted on: labelled documents of each class, and the characters that one has at most.
PER_CLASS = 1000
MAX_CHARS = 12_000
VOCABULARY = 20_000
SHAPES = 500
DIM = 32
HIDDEN = 48
EPOCHS = 80
THRESHOLD = 0.3
#: Words whose vectors are pooled at a time.
POOL_WORDS = 65_536


def _index_vectors(words: list[str]) -> np.ndarray:
    """Four places of each row are 1 or -1, by the word's hash."""
    out = np.zeros((len(words), DIM), np.float32)
    for k in range(4):
        h = np.fromiter((zlib.crc32(f"{k}{w}".encode()) for w in words), np.int64, len(words))
        out[np.arange(len(words)), (h >> 1) % DIM] += np.where(h & 1, 1.0, -1.0)
    return out


def _forms(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word in lower case, and its shape."""
    shape = words
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[^\P{L}Aa]+", "x"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    return pc.utf8_lower(words), shape


def _code(keys: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(keys, value_set=known.cast(keys.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(words: pa.Array, model) -> np.ndarray:
    """The row of the vector table for each distinct word: its own, its shape's, or the last, of zeros."""
    lower, shape = _forms(words)
    own, by_shape = _code(lower, model["words"]), _code(shape, model["shapes"])
    n = len(model["words"])
    return np.where(own >= 0, own, np.where(by_shape >= 0, n + by_shape, n + len(model["shapes"])))


def _pool(vectors: np.ndarray, rows: np.ndarray, off: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Features of each document, all of its words' vectors: their mean, their spread, and the mean step from one word's to the next one's."""
    n = np.diff(off)
    out = np.zeros((len(n), 3 * DIM), np.float32)
    doc = 0
    while doc < len(n):
        end = max(doc + 1, int(np.searchsorted(off, off[doc] + POOL_WORDS, side="right")) - 1)
        a, b = off[doc], off[end]
        if b > a:
            full = np.flatnonzero(n[doc:end])
            starts = off[doc:end][full] - a
            size = n[doc:end][full].astype(np.float32)[:, None]
            v = vectors[rows[codes[a:b]]]
            mean = np.add.reduceat(v, starts, axis=0) / size
            step = np.abs(np.diff(v, axis=0, prepend=v[:1]))
            step[starts] = 0
            out[doc + full, :DIM] = mean
            out[doc + full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / size - mean * mean, 0))
            out[doc + full, 2 * DIM :] = np.add.reduceat(step, starts, axis=0) / np.maximum(1, size - 1)
        doc = end
    return out


def _forward(net, x):
    h = np.maximum(x @ net["w1"] + net["b1"], 0)
    return h, h @ net["w2"] + net["b2"]


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = 7) -> dict:
    """A model from texts and their 0/1 labels; share is that of label 1 among all labelled documents.

    With no text of a class the model gives every document the share of the other, or 0.5 without labels.
    """
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    off, codes, words = split_words(pa.array(texts, pa.large_string()))
    lower, shape = (x.dictionary_encode() for x in _forms(words))
    lc, sc = (x.indices.to_numpy()[codes].astype(np.int64) for x in (lower, shape))
    index = _index_vectors(lower.dictionary.to_pylist())[lower.indices.to_numpy()] + _index_vectors(["shape " + s for s in shape.dictionary.to_pylist()])[shape.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    tables = []
    for own, size, most in ((lc, len(lower.dictionary), VOCABULARY), (sc, len(shape.dictionary), SHAPES)):
        top = np.argsort(-np.bincount(own, minlength=size), kind="stable")[:most]
        place = np.full(size, -1)
        place[top] = np.arange(len(top))
        vec = np.zeros((len(top), DIM))
        for step in (-2, -1, 1, 2):
            i = np.arange(max(0, -step), len(codes) - max(0, step))
            i = i[(doc[i] == doc[i + step]) & (place[own[i]] >= 0)]
            for k in range(DIM):
                vec[:, k] += np.bincount(place[own[i]], weights=index[codes[i + step], k], minlength=len(top))
        vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
        tables.append((top, vec))
    model = {"words": lower.dictionary.take(pa.array(tables[0][0])), "shapes": shape.dictionary.take(pa.array(tables[1][0]))}
    model["vectors"] = np.concatenate([tables[0][1], tables[1][1], np.zeros((1, DIM))]).astype(np.float32)
    x = _pool(model["vectors"], _rows(words, model), off, codes)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    check, learn = order[:cut], order[cut:]
    mean, std = x[learn].mean(0), x[learn].std(0) + 1e-3
    x = ((x - mean) / std).astype(np.float32)
    net = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}
    opt = Adam(net, 0.005)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            h, out = _forward(net, x[part])
            g = ((sigmoid(out) - y[part]) / len(part)).astype(np.float32)
            back = np.outer(g, net["w2"]) * (h > 0)
            opt.step({"w1": x[part].T @ back + 1e-3 * net["w1"], "b1": back.sum(0), "w2": h.T @ g + 1e-3 * net["w2"], "b2": g.sum(keepdims=True)})
    rate = y[check].mean()
    weight = np.where(y[check] == 1, share / max(rate, 1e-3), (1 - share) / max(1 - rate, 1e-3))
    prior = np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    raw = _forward(net, x[check])[1] + prior
    scale, _ = calibrate(raw, y[check], weight, shift=False)
    return model | {"net": net, "mean": mean, "std": std, "prior": float(prior), "temperature": 1 / scale}


def predict(model: dict, texts: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    off, codes, words = split_words(texts)
    x = (_pool(model["vectors"], _rows(words, model), off, codes) - model["mean"]) / model["std"]
    # Far from what was learnt, as for empty texts, features stay within what the network can judge.
    logit = _forward(model["net"], np.clip(x, -8, 8).astype(np.float32))[1].astype(np.float64) + model["prior"]
    return sigmoid(logit / model["temperature"])


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> dict:
    """Fit on the bounded sample of documents that have a label and aren't held out; null and other labels than 0 and 1 are none."""
    texts, y = labelled_sample(documents, labels, "quality", per_class, max_chars)
    share = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(texts, y, 0.5 if share is None else share)


def score_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD, keep: bool | list[str] = True) -> DataFrame:
    """docs (a text column, others pass through) with `score`, the probability of good quality of the whole text, and `predicted`, 1 from `threshold` on.

    A null text counts as empty; both have a score. Rows stay as they are, repeated ones too; columns of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        score = predict(shared.value, c["text"])
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_rows(docs, ["text"], run, [("score", T.DoubleType()), ("predicted", T.IntegerType())], keep)


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text reaches the threshold, with all their columns. A model without both classes can't tell them apart: all rows stay."""
    if "constant" in model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, ["text"], lambda c: {"_keep": predict(shared.value, c["text"]) >= threshold}, [], True)


def op1_quality_classifier(spark, sf_dir):
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(spread(docs).withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
