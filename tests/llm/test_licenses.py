import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lintel.llm import licenses as lc


def test_canonical_matches(spark):
    rows = [
        ("a", "Copyright (c) 2020 Foo\nAll rights reserved.\n\n" + lc.MIT.replace("license", "licence").upper()), ("b", lc.ISC.replace("\n", "  \r\n ")), ("c", ""), ("d", None), ("e", "  (C) 2001 me\n© you"), ("f", lc.MIT + " more"),
        ("g", "licensed under the APACHE licence, version 2.0"), ("h", lc.MIT.replace('"AS IS"', "“as is”")), ("i", "x copyright 2020 y\n" + lc.ISC), ("a", lc.ZLIB), ("j", "lorem " * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("DIGEST", F.lit(1)).withColumn("license_id", F.lit(2))
    got = lc.scan(df)
    assert got.columns == ["doc_id", "text", "digest", "license_id"] and got.count() == len(rows)
    found = sorted((r["doc_id"], r["license_id"]) for r in got.filter("license_id is not null").collect())
    assert found == [("a", "MIT"), ("a", "Zlib"), ("b", "ISC"), ("g", "Apache-2.0"), ("h", "MIT")]
    assert len({r["digest"] for r in got.filter("doc_id in ('c', 'd', 'e')").collect()}) == 1


def test_known_may_be_a_table(spark):
    known = spark.createDataFrame([("L2", "My  Terms!"), ("L1", "my terms"), ("none", "Copyright me")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "MY TERMS."), (2, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in lc.scan(docs, known).collect()} == {1: "L1", 2: None}
    assert lc.scan(docs, known.limit(0)).filter("license_id is not null").count() == 0


def test_wrapping_and_list_marks_do_not_matter(spark):
    """Each known text, wrapped by paragraph and as a whole, in quotes and comments, with other marks of lists."""
    rows = []
    for k, (i, text) in enumerate(lc.KNOWN):
        whole = [textwrap.fill(text, w) for w in range(50, 101)]
        parts = ["\n\n".join(textwrap.fill(p, w) for p in text.split("\n\n")) for w in range(50, 101)]
        forms = [text, *whole, *parts, textwrap.indent(text, "// "), textwrap.indent(parts[20], " * "), text.replace("1. ", "* ").replace("2. ", "- ").replace("3. ", "(c) "), "Copyright (c) 2011, A B\n\n" + text, "/* (C) 1999-2003 X */\n" + text]
        rows += [(k, i, f) for f in forms]
    got = spark.createDataFrame(rows, "k int, i string, t string").select("k", lc.canonical(F.col("t")).alias("c")).distinct().collect()
    assert len(got) == len(lc.KNOWN)


def test_notices_and_text_that_looks_like_one(spark):
    rows = {
        "copyright notice, this list": "copyright notice this list", "Copyright 2020 me\nx": "x", "# Copyright (c) Me\nx": "x", "Copyright [yyyy] [name]\nx": "x", "(c) You must keep this": "you must keep this", "keep (c) this": "keep c this", "x\n(c) 1999 me": "x", "© me\nx": "x",
        "All rights reserved.\nx": "x", "all rights reserved to them": "all rights reserved to them", "licence licence licences": "license license licenses", "sub-licence sub license per cent per cent": "sublicense sublicense percent percent",
        "copyright holder copyright holders": "copyright owner copyright owners", "1. (a) one; ii. two 3. three. v 2. x": "one two 3 three v 2 x", "version 2. and version\n3. x": "version 2 and version 3 x", "a b. c. d": "a b d",
    }
    got = spark.createDataFrame([(k, v) for k, v in rows.items()], "t string, want string").withColumn("c", lc.canonical(F.col("t"))).collect()
    assert [(r["t"], r["c"]) for r in got if r["c"] != r["want"]] == []


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this system")
def test_digests_of_whole_texts(spark):
    """Every shipped digest is that of a text of the system, whole or up to its terms' end."""
    rows = []
    for f in Path("/usr/share/common-licenses").iterdir():
        text, end = f.read_text(errors="replace"), "END OF TERMS AND CONDITIONS"
        rows += [(text,), *([(text[: text.index(end)],), (text[: text.index(end) + len(end)],)] if end in text else [])]
    df = spark.createDataFrame(rows, "text string")
    assert {d for _, d in lc.DIGESTS} <= {r["digest"] for r in lc.scan(df).collect()}
    assert {r["license_id"] for r in lc.scan(df).collect()} - {None} == {i for i, _ in lc.DIGESTS}


def test_query_finds_what_is_planted(spark, sf):
    got = {r["doc_id"]: r["license_id"] for r in lc.op10_license_digests(spark, sf).filter("doc_id < 0").collect()}
    assert [got[-k] for k in range(1, len(lc.PLANTED) + 1)] == ["MIT", "MIT", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0", "MPL-2.0", "Unlicense", *[None] * 7]


def test_known_texts_are_apart(spark):
    df = lc.known_digests(spark.createDataFrame(list(lc.KNOWN), "license_id string, text string"))
    assert df.count() == len(lc.KNOWN) and not {r["digest"] for r in df.collect()} & {d for _, d in lc.DIGESTS}


def test_odd_and_empty(spark, odd, none):
    assert lc.scan(odd).count() == odd.count() and lc.scan(none).collect() == []
