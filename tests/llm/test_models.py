import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import common, quality, toxicity


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    pos = (y == 1).sum()
    return (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("op, label, threshold, least", [(quality.op1_quality_classifier, "quality", 0.3, 0.99), (toxicity.op2_toxicity_bigru, "toxic", 0.5, 0.97)])
def test_held_out_accuracy(spark, op, label, threshold, least):
    sf = "/root/testdata/sf0.1"
    rows = op(spark, sf).cache()
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in rows.collect())
    got = rows.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", F.col(label).alias("y"), "predicted").toPandas()
    assert auc(got.score.to_numpy(), got.y.to_numpy()) >= least and (got.predicted == got.y).mean() >= 0.97


@pytest.mark.parametrize("module, score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_odd_rows(spark, odd, none, module, score):
    good, bad = "the plain words of a text that goes on", "the stupidity of idiots!! #*$% #*$% #*$%"
    texts, y = [f"{good} {i}" for i in range(40)] + [f"{bad} {i}" for i in range(40)], np.repeat([1, 0] if module is quality else [0, 1], 40)
    model = module.fit(texts, y, 0.5)
    got = score(odd, model)
    assert got.count() == odd.count() and "lang" in got.columns and got.columns.count("score") == 1
    assert got.filter("score is null or predicted is null or score < 0 or score > 1").count() == 0
    assert score(none, model).collect() == []
    p = module.predict(model, pa.array([good, bad]))
    assert (p[0] - p[1]) * (1 if module is quality else -1) > 0.5
    same = [r["score"] for r in got.filter("doc_id = 1").collect()]
    assert same[0] == same[1]
    for empty in ([], ["a"]):
        one = module.fit(empty, np.zeros(len(empty), np.int64), 0.5)
        assert len(module.predict(one, pa.array(["x", None]))) == 2


def plain_quality(model, text):
    """One text's score, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    known, shapes = ({w: i for i, w in enumerate(model[k].to_pylist())} for k in ("words", "shapes"))
    zero = np.zeros(quality.DIM)

    @functools.cache
    def vector(w):
        lower, shape = (x[0].as_py() for x in quality._forms(pa.array([w], pa.large_string())))
        return model["vectors"][known[lower]] if lower in known else model["vectors"][len(known) + shapes[shape]] if shape in shapes else zero

    v = [vector(w).astype(np.float64) for w in words]
    mean = sum(v, zero) / max(1, len(v))
    spread = np.sqrt(np.maximum(sum((x * x for x in v), zero) / max(1, len(v)) - mean * mean, 0))
    step = sum((abs(a - b) for a, b in zip(v, v[1:])), zero) / max(1, len(v) - 1)
    x = np.clip((np.concatenate([mean, spread, step]) - model["mean"]) / model["std"], -8, 8)
    net = model["net"]
    logit = np.maximum(x @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"] + model["prior"]
    return 1 / (1 + np.exp(-logit / model["temperature"]))


def plain_toxicity(model, text):
    """One text's score: each window read word by word, with n-grams one at a time."""
    net, h = model["net"], toxicity.HIDDEN
    words = [toxicity._norm(pa.array([w], pa.large_string()))[0].as_py() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    known = {w: i for i, w in enumerate(model["vocabulary"].to_pylist())}

    @functools.cache
    def vector(w):
        data, grams = f"^{w}$".encode(), []
        for n in toxicity.GRAMS:
            for i in range(len(data) - n + 1):
                g = n * 1_000_003
                for c in data[i : i + n]:
                    g = (g ^ c) * 1_099_511_628_211 % 2**64
                grams.append((g ^ (g >> 29)) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - toxicity.GRAM_BITS))
        chars = sum((net["grams"][g].astype(np.float64) for g in grams), np.zeros(toxicity.CHARS)) / max(1, len(grams)) ** 0.5
        return np.concatenate([net["words"][known[w]] if w in known else np.zeros(toxicity.OWN), chars])

    def states(xs, d):
        s, out = np.zeros(h), []
        for x in xs:
            p, u = x @ net[f"W{d}"] + net[f"c{d}"], s @ net[f"U{d}"]
            z, r = (1 / (1 + np.exp(-(p[k * h : k * h + h] + u[k * h : k * h + h]))) for k in (0, 1))
            new = np.tanh(p[2 * h :] + r * u[2 * h :])
            s = (1 - z) * new + z * s
            out.append(s)
        return out

    def logit(xs):
        hs = np.array([np.concatenate(p) for p in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])])
        a = np.exp(np.tanh(hs @ net["A"]) @ net["v"])
        return (a / a.sum()) @ hs @ net["o"] + net["b"][0]

    xs = [vector(w) for w in words]
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(xs):
        starts.append(starts[-1] + toxicity.STRIDE)
    scale, shift = model["calibration"]
    return 1 / (1 + np.exp(-(scale * max(logit(xs[k : k + toxicity.WINDOW]) for k in starts) + shift)))


@pytest.mark.parametrize("module, label, plain", [(quality, "quality", plain_quality), (toxicity, "toxic", plain_toxicity)])
def test_against_a_plain_scorer(spark, sf, module, label, plain):
    """Scores of many texts at a time are those of one text alone."""
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = module.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect() if r["text"] and len(r["text"]) < 3000][:40]
    texts = [t for t in texts if t.split()] + ["x", "Ærø ¡ß! \x85 y\xa0z " * 30]
    got = module.predict(model, pa.array(texts, pa.large_string()))
    assert np.abs(got - np.array([float(np.squeeze(plain(model, t))) for t in texts])).max() < 1e-3


@pytest.mark.parametrize("module, keep", [(quality, quality.keep_good), (toxicity, toxicity.drop_toxic)])
def test_a_missing_class_keeps_all(spark, odd, module, keep):
    label = "quality" if module is quality else "toxic"
    labels = spark.range(1, 9).selectExpr("id as doc_id", f"1 as {label}")
    with pytest.warns(UserWarning, match="no usable document"):
        model = module.train(odd, labels)
    assert "constant" in model and keep(odd, model).count() == odd.count()


def test_a_shard_gives_all_the_labelled_rows_that_it_holds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    shard = docs.filter("doc_id % 16 < 2").withColumn("text", F.when(F.col("doc_id") % 32 < 2, F.col("text")).otherwise("x" * 300))
    texts, y = common.labelled_sample(shard, labels, "quality", 100, 200)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(4000) if i % 32 < 2)
    assert len(texts) == min(200, 250 - held) and abs(int(y.sum()) * 2 - len(y)) < 40


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_held_out_rows_are_not_read(spark, module):
    label = "quality" if module is quality else "toxic"
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(label))
    texts, y = common.labelled_sample(docs, labels, label, 1000, 100)
    want = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(texts) == sorted(f"t{i}" for i in want) and all(int(t[1:]) % 2 == v for t, v in zip(texts, y))
    few, _ = common.labelled_sample(docs, labels, label, 7, 100)
    assert len(few) == 14
    assert common.labelled_sample(docs, labels.limit(0), label, 7, 100)[0] == []
    odd_labels = labels.unionByName(labels.withColumn(label, F.lit(None).cast("int"))).unionByName(labels.withColumn(label, F.lit(9)))
    assert len(common.labelled_sample(docs, odd_labels, label, 7, 100)[0]) == 14


def test_gradients():
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net().items()}
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(6, 3, toxicity.OWN + toxicity.CHARS)), np.arange(6)[:, None] < np.array([6, 3, 1])[None], np.array([1.0, 0, 1])

    def loss():
        return np.log1p(np.exp(-(2 * y - 1) * toxicity.forward(net, x, mask))).sum()

    keep: dict = {}
    out = toxicity.forward(net, x, mask, keep)
    grads = toxicity.backward(net, keep, 1 / (1 + np.exp(-out)) - y)
    for name, value in (net | {"x": x}).items():  # the inputs' gradient trains the tables of vectors
        for _ in range(5 if name != "x" else 40):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_every_word_is_in_a_window():
    off = np.concatenate([[0], np.cumsum([0, 1, 31, 32, 33, 56, 57, 500])])
    start, doc = toxicity._windows(off)
    at = toxicity._positions(start, off[1:][doc])
    assert set(at[at >= 0].tolist()) == set(range(off[-1]))
    assert all((d2 != d1) or s2 - s1 == toxicity.STRIDE < toxicity.WINDOW for s1, s2, d1, d2 in zip(start, start[1:], doc, doc[1:]))


def test_one_bad_word_at_the_end_counts(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    word = lambda: words[rng.integers(400)]
    text = lambda n, bad: " ".join([word() for _ in range(n)] + [f"zzyq{word()}"] * bad)
    model = toxicity.fit([text(60, 0) for _ in range(300)] + [text(60, 2) for _ in range(300)], np.repeat([0, 1], 300), 0.5)
    p = toxicity.predict(model, pa.array([text(3000, 0), text(3000, 2)]))
    assert p[0] < 0.5 < p[1]
