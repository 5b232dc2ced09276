"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

A word's input joins its own trained vector (none for a word that the sample doesn't hold often) and the sum of the trained vectors of its character
n-grams. The network reads windows of words that overlap; a document scores as its worst window. All vectors and weights are trained together by
the gradient of the windows' loss: on windows at random first, then on the worst window of each labelled document, which is found again before each round. No
statistic of labels is an input.
"""

from __future__ import annotations

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
#: How often the sample holds a word that has a vector of its own.
SEEN = 3
GRAM_BITS = 16
GRAMS = (3, 4, 5)
#: Words of a window, and from the start of one to that of the next: each run of up to WINDOW - STRIDE + 1 words is whole in some window.
WINDOW, STRIDE = 32, 16
HIDDEN = 8
#: Numbers of a word's own vector and of its characters' one.
OWN, CHARS = 8, 8
#: Rounds on windows at random, how many of a document in each, and rounds on the worst windows.
RANDOM_ROUNDS, RANDOM_WINDOWS, WORST_ROUNDS = 4, 3, 8
#: The share of words that training reads by their characters alone, as it reads those that have no vector.
HIDE = 0.3
#: Windows of a training step; fewer for small samples, so that these train by as many steps.
BATCH, LEAST_BATCH = 128, 16
DECAY = 1e-4
THRESHOLD = 0.5
#: Windows that the network reads at a time.
BLOCK = 2048
#: Distinct words whose n-grams are held at a time.
WORDS = 20_000

_MARKS = ".,;:!?*%&$#|\"'()[]{}<>«»„“”…-_"


def _norm(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), _MARKS)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams, as bytes, of words with marks at both ends: (offsets, buckets)."""
    marked = pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), words.cast(pa.large_string()), pa.scalar("$", pa.large_string()), pa.scalar("", pa.large_string()))
    off = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    size = np.diff(off)
    last = np.repeat(off[1:], size)
    found, owner = [], []
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data))
    for n in GRAMS:
        i = at[at + n <= last]
        h = np.full(len(i), np.uint64(n * 1_000_003))
        for k in range(n):
            h = (h ^ data[i + k]) * np.uint64(1_099_511_628_211)
        found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        owner.append(word[i])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(len(size) + 1)), found[order]


def _scale(n: np.ndarray) -> np.ndarray:
    return (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)[:, None]


def _ragged(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's run begins in the places, places of all runs of the rows)."""
    n = off[rows + 1] - off[rows]
    total = np.concatenate([[0], np.cumsum(n)])
    return total, np.repeat(off[rows] - total[:-1], n) + np.arange(total[-1])


def _embed(net, own: np.ndarray, off: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The input of each word: own is its row in the table of words, whose last is of zeros; its n-grams are grams[off[i] : off[i + 1]]."""
    x = np.zeros((len(own), OWN + CHARS), np.float32)
    x[:, :OWN] = net["words"][own]
    n = np.diff(off)
    full = np.flatnonzero(n)
    if len(full):
        x[full, OWN:] = np.add.reduceat(net["grams"][grams], off[:-1][full], axis=0) * _scale(n[full])
    return x


def _inputs(words: pa.Array, model) -> np.ndarray:
    """The input of each normalised word, some words at a time."""
    parts = [np.zeros((0, OWN + CHARS), np.float32)]
    for k in range(0, len(words), WORDS):
        some = words.slice(k, WORDS)
        own = pc.fill_null(pc.index_in(some, value_set=model["vocabulary"].cast(some.type)), len(model["vocabulary"])).to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append(_embed(model["net"], own, *_grams(some)))
    return np.concatenate(parts)


def _windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, document of each): every WINDOW words, STRIDE apart, to the end of each text; a text without words has an empty one."""
    n = np.diff(off)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    total = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    return off[:-1][doc] + STRIDE * (np.arange(total[-1]) - total[:-1][doc]), doc


def _positions(start, end):
    """Word positions of windows, by step; -1 behind a text's end."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < end[None, :], at, -1)


def new_net(seed: int = 3) -> dict[str, np.ndarray]:
    """The weights; the tables of vectors are not among them."""
    rng = np.random.default_rng(seed)
    h, f, n = HIDDEN, np.float32, OWN + CHARS
    net = {}
    for d in "fb":
        net |= {f"W{d}": rng.normal(0, n**-0.5, (n, 3 * h)).astype(f), f"U{d}": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f), f"c{d}": np.zeros(3 * h, f)}
    return net | {"A": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)).astype(f), "v": rng.normal(0, h**-0.5, h).astype(f), "o": rng.normal(0, (2 * h) ** -0.5, 2 * h).astype(f), "b": np.zeros(1, f)}


def _sig(x):
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _direction(net, d, proj, mask, keep):
    """Hidden states (steps, windows, hidden) of one direction; proj and mask are in page order. keep gets what the way back needs."""
    h, steps, n = HIDDEN, *mask.shape
    out = np.zeros((steps, n, h), proj.dtype)
    state = np.zeros((n, h), proj.dtype)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        u = state @ net[f"U{d}"]
        p = proj[t]
        zr = _sig(p[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(p[:, 2 * h :] + r * u[:, 2 * h :])
        nxt = new + z * (state - new)
        live = mask[t][:, None]
        if keep is not None:
            keep.append((t, state, z, r, new, u[:, 2 * h :], live))
        state = np.where(live, nxt, state)
        out[t] = state
    return out


def forward(net, x, mask, keep: dict | None = None):
    """Logits of windows: x (steps, windows, inputs) or, for speed, a pair of projections; mask (steps, windows)."""
    states = []
    for d, p in zip("fb", x if isinstance(x, tuple) else (x @ net["Wf"] + net["cf"], x @ net["Wb"] + net["cb"])):
        log = [] if keep is not None else None
        states.append(_direction(net, d, p, mask, log))
        if keep is not None:
            keep[d] = log
    hs = np.concatenate(states, axis=2)
    t = np.tanh(hs @ net["A"])
    s = np.where(mask, t @ net["v"], np.float32(-1e4))
    s = np.exp(s - s.max(0))
    s *= mask
    a = s / np.maximum(s.sum(0), 1e-9)
    pooled = (a[:, :, None] * hs).sum(0)
    logit = pooled @ net["o"] + net["b"]
    if keep is not None:
        keep |= {"hs": hs, "t": t, "a": a, "pooled": pooled, "x": x, "mask": mask}
    return logit


def backward(net, keep, g):
    """Gradients of all weights, and as "x" of the inputs, from that of the logits."""
    h = HIDDEN
    out = {"o": keep["pooled"].T @ g, "b": g.sum(keepdims=True).reshape(1)}
    dp = np.outer(g, net["o"])
    hs, a, t = keep["hs"], keep["a"], keep["t"]
    da = (hs * dp[None]).sum(2)
    ds = a * (da - (a * da).sum(0))
    dhs = a[:, :, None] * dp[None]
    out["v"] = (t * ds[:, :, None]).sum((0, 1))
    dt = ds[:, :, None] * net["v"] * (1 - t * t)
    flat = lambda q: q.reshape(-1, q.shape[-1])
    out["A"] = flat(hs).T @ flat(dt)
    dhs = dhs + dt @ net["A"].T
    x = keep["x"]
    out["x"] = np.zeros_like(x)
    for k, d in enumerate("fb"):
        W, U = np.zeros_like(net[f"W{d}"]), np.zeros_like(net[f"U{d}"])
        c = np.zeros_like(net[f"c{d}"])
        carry = np.zeros_like(dhs[0][:, :h])
        for step, state, z, r, new, un, live in reversed(keep[d]):
            total = carry + dhs[step][:, k * h : (k + 1) * h]
            dn = np.where(live, total, 0)
            carry = np.where(live, 0, total)
            dz = dn * (state - new) * z * (1 - z)
            dnew = dn * (1 - z) * (1 - new * new)
            dr = dnew * un * r * (1 - r)
            dproj = np.concatenate([dz, dr, dnew], 1)
            du = np.concatenate([dz, dr, dnew * r], 1)
            carry = carry + dn * z + du @ net[f"U{d}"].T
            U += state.T @ du
            W += x[step].T @ dproj
            out["x"][step] += dproj @ net[f"W{d}"].T
            c += dproj.sum(0)
        out |= {f"W{d}": W, f"U{d}": U, f"c{d}": c}
    return out


def _logits(net, x, codes, start, end) -> np.ndarray:
    """Of all windows, in blocks; x has a row per distinct word."""
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    table_f, table_b = x @ net["Wf"] + net["cf"], x @ net["Wb"] + net["cb"]
    codes = np.append(codes, len(x) - 1)
    out = np.empty(len(start), np.float32)
    for k in range(0, len(start), BLOCK):
        at = _positions(start[k : k + BLOCK], end[k : k + BLOCK])
        c = codes[at]
        out[k : k + BLOCK] = forward(net, (table_f[c], table_b[c]), at >= 0)
    return out


def _worst(logits, doc, n):
    """The window of the largest logit of each document; windows are in order of documents."""
    order = np.lexsort((-logits, doc))
    return order[np.searchsorted(doc[order], np.arange(n))]


class _Rows:
    """Adam for a table of vectors of which a step changes few rows."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate = table, rate
        self.m, self.v, self.t = np.zeros_like(table), np.zeros_like(table), np.zeros(len(table), np.int64)

    def step(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """rows may repeat; their gradients add up."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, r = np.add.reduceat(grad[order], first, axis=0), rows[first]
        self.t[r] += 1
        t = self.t[r][:, None]
        self.m[r] += 0.1 * (g - self.m[r])
        self.v[r] += 0.01 * (g * g - self.v[r])
        self.table[r] -= (self.rate * (self.m[r] / (1 - 0.9**t)) / (np.sqrt(self.v[r] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, share: float, seed: int = 3) -> dict:
    """A model from texts and their 0/1 labels; share is that of label 1 among all labelled documents.

    With no text of a class the model gives every document the share of the other, or 0 without labels. A fifth of the texts is kept apart for calibration.
    """
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    off, raw, words = split_words(pa.array(texts, pa.large_string()))
    norm = _norm(words).dictionary_encode()
    codes = norm.indices.to_numpy(zero_copy_only=False).astype(np.int64)[raw]
    words = norm.dictionary
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, learn = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    learns = np.zeros(len(y), bool)
    learns[learn] = True
    seen = np.bincount(codes[np.repeat(learns, np.diff(off))], minlength=len(words))
    top = np.argsort(-seen, kind="stable")[:VOCABULARY]
    top = top[seen[top] >= SEEN]
    own = np.full(len(words), len(top))
    own[top] = np.arange(len(top))
    parts = [_grams(words.slice(k, WORDS)) for k in range(0, len(words), WORDS)]
    goff = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for o, _ in parts]))]) if parts else np.zeros(1, np.int64)
    grams = np.concatenate([g for _, g in parts]) if parts else np.zeros(0, np.int64)
    net = new_net(seed)
    tables = {"words": rng.normal(0, 0.1, (len(top) + 1, OWN)).astype(np.float32), "grams": rng.normal(0, 0.1, (1 << GRAM_BITS, CHARS)).astype(np.float32)}
    tables["words"][-1] = 0
    opt, opt_words, opt_grams = Adam(net, 0.01), _Rows(tables["words"], 0.01), _Rows(tables["grams"], 0.01)
    start, wdoc = _windows(off)
    end = off[1:][wdoc]
    first = np.searchsorted(wdoc, np.arange(len(y) + 1))
    none = len(words)

    def logits():
        return _logits(net, _embed(tables, own, goff, grams), codes, start, end)

    def step(w):
        at = _positions(start[w], end[w])
        used, inverse = np.unique(np.where(at >= 0, codes[at], none), return_inverse=True)
        some = used[used < none]
        total, places = _ragged(goff, some)
        mine = own[some].copy()
        mine[rng.random(len(some)) < HIDE] = len(top)
        x = np.concatenate([_embed(tables, mine, total, grams[places]), np.zeros((len(used) - len(some), OWN + CHARS), np.float32)])
        keep: dict = {}
        out = forward(net, x[inverse].reshape(*at.shape, -1), at >= 0, keep)
        target = y[wdoc[w]]
        grads = backward(net, keep, ((sigmoid(out) - target) / len(w)).astype(np.float32))
        dx = grads.pop("x").reshape(-1, OWN + CHARS)
        by = np.argsort(inverse.ravel(), kind="stable")
        dx = np.add.reduceat(dx[by], np.searchsorted(inverse.ravel()[by], np.arange(len(used))), axis=0)[: len(some)]
        size = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        opt.step({k: g * min(1.0, 1 / max(size, 1e-9)) + 1e-4 * net[k] for k, g in grads.items()})
        told = mine < len(top)
        if told.any():
            opt_words.step(mine[told], dx[told, :OWN] + DECAY * tables["words"][mine[told]])
        if len(places):
            n = np.diff(total)
            opt_grams.step(grams[places], np.repeat(dx[:, OWN:] * _scale(n), n, axis=0) + DECAY * tables["grams"][grams[places]])

    for k in range(RANDOM_ROUNDS + WORST_ROUNDS):
        if k < RANDOM_ROUNDS:
            chosen = np.concatenate([first[learn] + (rng.random(len(learn)) * (first[learn + 1] - first[learn])).astype(np.int64) for _ in range(RANDOM_WINDOWS)])
        else:
            chosen = np.concatenate([_worst(logits(), wdoc, len(y))[learn], first[learn] + (rng.random(len(learn)) * (first[learn + 1] - first[learn])).astype(np.int64)])
            chosen = chosen[np.concatenate([np.ones(len(learn), bool), y[learn] == 0])]  # of toxic texts the worst window alone
        chosen = rng.permutation(chosen)
        for o, rate in ((opt, 0.01), (opt_words, 0.01), (opt_grams, 0.01)):  # smaller steps towards the end
            o.rate = rate * min(1.0, (RANDOM_ROUNDS + WORST_ROUNDS - k) / WORST_ROUNDS)
        for part in np.array_split(chosen, max(1, len(chosen) // min(BATCH, max(LEAST_BATCH, len(learn) // 12)))):
            step(part)
    found = logits()
    raw_score = found[_worst(found, wdoc, len(y))][check].astype(np.float64)
    rate = y[check].mean()
    weight = np.where(y[check] == 1, share / max(rate, 1e-3), (1 - share) / max(1 - rate, 1e-3))
    return {"vocabulary": words.take(pa.array(top)), "net": net | tables, "share": share, "calibration": calibrate(raw_score, y[check], weight, shift=True)}


def predict(model: dict, texts: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    off, raw, words = split_words(texts)
    if not len(off) - 1:
        return np.zeros(0)
    norm = _norm(words).dictionary_encode()
    codes = norm.indices.to_numpy(zero_copy_only=False).astype(np.int64)[raw]
    x = _inputs(norm.dictionary, model).astype(np.float32)
    start, doc = _windows(off)
    logits = _logits(model["net"], x, codes, start, off[1:][doc])
    scale, shift = model["calibration"]
    worst = np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(off) - 1)))
    return np.where(np.diff(off) > 0, sigmoid(scale * worst.astype(np.float64) + shift), model["share"])


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> dict:
    """Fit on the bounded sample of documents that have a label and aren't held out; null and other labels than 0 and 1 are none."""
    texts, y = labelled_sample(documents, labels, "toxic", per_class, max_chars)
    share = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit(texts, y, 0.5 if share is None else share)


def score_toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD, keep: bool | list[str] = True) -> DataFrame:
    """docs (a text column, others pass through) with `score`, the probability that the whole text is toxic, and `predicted`, 1 from `threshold` on.

    Every window of every text is read. A null text counts as empty; texts without words score as the share of toxic labels. Rows stay as they are, repeated ones too; columns of
    the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(c):
        score = predict(shared.value, c["text"])
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_rows(docs, ["text"], run, [("score", T.DoubleType()), ("predicted", T.IntegerType())], keep)


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text stays under the threshold, with all their columns. A model without both classes can't tell them apart: all rows stay."""
    if "constant" in model:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, ["text"], lambda c: {"_keep": predict(shared.value, c["text"]) < threshold}, [], True)


def op2_toxicity_bigru(spark, sf_dir):
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(spread(docs).withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
