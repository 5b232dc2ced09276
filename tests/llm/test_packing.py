import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintel.llm import packing as pk

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")
ANY = pk.WordIds(PATH)
ODD = ["a\x0bb", "x\x1cy", "Σας ΣΑΣ Σ", "é é ́x", "it's don't 's 'LL", "a b c", "ﬁ İI Å K", "가 ᆨ", "a\x85b", " \t\n", "", "12a3 4½ x²", "日本 語。テスト", "\U0001f469‍\U0001f469", "a%%%. b!!c ***d x,y,", "Ⅷ ⅷ ª º ǅ", "<|endoftext|> a", "<|ENDOFTEXT|> A <|StartOfText|>", "CUMHURİYETİ. BELEDİYESİ, İ! Aİ", None]


@functools.cache
def tokenizer(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return t


def brute(text, plain=False):
    return tokenizer(plain).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_the_tokenizers(plain):
    enc = pk.WordIds(PATH, plain)
    for _ in range(2):  # also from memory
        off, ids = enc.encode(pa.array(ODD, pa.string()))
        for k, text in enumerate(ODD):
            assert ids[off[k] : off[k + 1]].tolist() == brute(text, plain), text


def test_every_code_point_before_every_mark():
    """Each letter of Unicode, alone and behind another, with each mark that words end in."""
    enc = pk.WordIds(PATH)
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or c < 0x3000)]
    texts = [" ".join(f"{c}. b{c}{pk._TAIL[(k + i) % len(pk._TAIL)]}" for i, c in enumerate(letters[k : k + 200])) for k in range(0, len(letters), 200)]
    texts += [" ".join(f"{c}{m}" for c in enc.loose.to_pylist() for m in pk._TAIL)]
    off, ids = enc.encode(pa.array(texts, pa.string()))
    for k, e in enumerate(enc.tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, texts[k][:20]


@settings(max_examples=400, deadline=None, database=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("İIıΣς.,;:!?*%&$#|<> \n\u0301\u0307ab'")), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    off, ids = ANY.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == ANY.tok.encode(text, add_special_tokens=False).ids


def test_forgets(monkeypatch):
    monkeypatch.setattr(pk, "MEMORY_WORDS", 3)
    enc = pk.WordIds(PATH)
    for texts in (["a b c d"], ["e f g a"], ["a b c d"]):
        off, ids = enc.encode(pa.array(texts))
        assert ids.tolist() == brute(texts[0])


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    counts = {int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(1, capacity + 1), 12, replace=False)}
    bins, ranks = {}, Counter()
    for length, rank, n, seq, offset in pk.plan(counts, capacity):
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            bins.setdefault(seq + k, []).append((offset, length))
    assert ranks == counts
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    # Best fit decreasing, one by one, needs as many.
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(capacity - length)
    assert len(bins) == len(rooms)


def check(rows, texts, capacity):
    want = Counter()
    for doc, text in texts:
        ids = np.array([*brute(text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(spark, odd, capacity):
    rows = pk.pack(odd.repartition(5), capacity=capacity).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], capacity)


def test_empty(spark, none):
    df = pk.pack(none)
    assert df.collect() == [] and df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_query(spark, sf):
    rows = pk.op7_best_fit_packing(spark, sf).collect()
    check(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * total / 2048 + 1
