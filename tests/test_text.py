from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintel.functions import text as tx
from lintel.operators import scrub

STRIPPED = {0xAD, 0x34F, 0x180E, 0x200B, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, 0xFFF9, 0xFFFA, 0xFFFB, 0xE0001, 0x7F, *(c for c in range(32) if c not in (9, 10, 13))}


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", tx.clean_struct(F.col("t")).alias("r")).orderBy("i").select("r.*").collect()
    return [(r["cleaned"], r["removed_count"], r["removed"]) for r in rows]


def test_cases(spark):
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    persian = "می‌شود"
    got = run(spark, ["Hello​World﻿!", family, persian, "abc‮def\n", "", "x\U000e0001", "&#x200B;"])
    assert got == [("HelloWorld!", 2, {"U+200B": 1, "U+FEFF": 1}), (family, 0, {}), (persian, 0, {}), ("abcdef\n", 1, {"U+202E": 1}), ("", 0, {}), ("x", 1, {"U+E0001": 1}), ("&#x200B;", 0, {})]


def test_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(tx.strip_marks(F.col("t")), tx.count_marks(F.col("t"))).first()
    assert tuple(r) == (None, None)


def test_sweep(spark):
    """Every scalar value: these 60 go and no other does."""
    every = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    gone = {r[0] for r in every.filter(F.length(tx.strip_marks(F.col("c"))) == 0).select("id").collect()}
    assert len(STRIPPED) == 60 and gone == STRIPPED - {0}
    assert run(spark, ["a\x00b"])[0][:2] == ("ab", 1)


def test_properties(spark):
    seen = []

    @settings(max_examples=200, deadline=None, database=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([chr(c) for c in STRIPPED]))))
    def collect(x):
        seen.append(x)

    collect()
    for x, (cleaned, n, removed) in zip(seen, run(spark, seen)):
        want = "".join(c for c in x if ord(c) not in STRIPPED)
        assert (cleaned, n) == (want, len(x) - len(want)) and sum(removed.values()) == n
        assert all(removed[f"U+{ord(c):04X}"] == x.count(c) for c in set(x) if ord(c) in STRIPPED)


def test_bytes(spark):
    cases = [("café​".encode(), "café", 1), (b"\xff\xfe\xfd", None, None), (b"\xed\xa0\x80", None, None), (b"\xc0\x80", None, None), ("﻿a﻿".encode(), "a", 1), (b"", "", 0)]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, content binary")
    got = scrub.clean_bytes(df).orderBy("i").select(F.col("cleaned").cast("string"), "removed_count", "error").collect()
    for (_, text, n), r in zip(cases, got):
        assert (r[0], r[1]) == (text, n) and (r[2] is None) == (text is not None)


def test_sanitize_and_spaces(spark):
    r = spark.createDataFrame([("a\x00\n" + "x" * 600, "a b　c")], "e string, s string").select(tx.sanitize_error(F.col("e")), tx.normalize_spaces(F.col("s"))).first()
    assert r[0] == "a  " + "x" * 497 and r[1] == "a b c"
