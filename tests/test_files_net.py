import pytest
from pyspark.sql import functions as F

from lintel.functions import files as fx
from lintel.functions import net


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_extension(spark):
    names = ["notes.pdf", "shot.PNG", "noext", ".bashrc", "a/b/c.PDF", "a.b\\c", "x.", "a.tar.gz", "", "dir.d/", "a/.x"]
    assert column(spark, names, fx.extension_of) == ["pdf", "png", "", "", "pdf", "", "", "gz", "", "", ""]


def test_admission(spark):
    rows = [("notes.pdf", "application/pdf", 12, "ok"), ("x.exe", None, 12, "extension_blocked"), ("noext", None, 12, "missing_extension"), ("a.txt", "text/plain", 50, "ok"), ("a.txt", "text/plain", 1001, "file_too_large"),
            ("a.txt", None, 0, "empty_file"), ("a.zip", None, 1, "extension_not_allowed"), ("a.txt", " Application/X-Executable ;q", 1, "content_type_blocked"), ("a.txt", "", 1000, "ok"), ("a.txt", "application/x-msdownload\t; q=1", 1, "content_type_blocked"), ("a.txt", "\u00a0application/x-executable\n", 1, "content_type_blocked"), ("a.exe\n", None, 1, "extension_not_allowed")]
    df = spark.createDataFrame(rows, "n string, c string, s long, want string")
    assert df.filter(fx.admission(F.col("n"), F.col("c"), F.col("s"), 1000) != F.col("want")).count() == 0


def test_download_names(spark):
    names = ["../../etc/passwd.txt", "a b(1)[x].PDF", "é.txt", ".hidden", "", "x" * 200 + ".txt", "noext", "a.b.c"]
    assert column(spark, names, fx.download_name) == ["passwd.cleaned.txt", "a b(1)[x].cleaned.pdf", "_.cleaned.txt", "cleaned.bin", "cleaned.bin", "x" * 180 + ".cleaned.txt", "noext.cleaned.bin", "a.b.cleaned.c"]


def test_ids_and_keys(spark):
    good = "11111111-1111-4111-8111-111111111111"
    assert column(spark, [good, good.upper(), "../etc/passwd", "not-a-uuid", None, good + "\n"], fx.job_id_valid) == [True, True, False, False, False, False]
    assert column(spark, [good], lambda c: fx.object_key(c, "cleaned")) == [f"uploads/{good}/cleaned"]


def test_sizes(spark):
    assert column(spark, [0, 1023, 1024, 1280, 1536, 1 << 20, 33554432, 1048575], fx.format_size, "long") == ["0 B", "1023 B", "1.0 KiB", "1.3 KiB", "1.5 KiB", "1.0 MiB", "32.0 MiB", "1024.0 KiB"]


def test_routing(spark):
    assert column(spark, ["txt", "MD", "docx", "DOCX", "pdf", "xlsx"], fx.backend) == ["worker-layer-a"] * 2 + ["worker-ooxml"] * 2 + ["remote-cleaner"] * 2


def test_loopback(spark):
    yes = ["127.0.0.1", "127.0.0.2", "localhost", "::1", "[::1]", "::ffff:127.0.0.1", "[::ffff:127.0.0.1]", "::ffff:7f00:1"]
    no = ["cleaner.example", "8.8.8.8", "::ffff:8.8.8.8", None]
    assert column(spark, yes + no, net.loopback_host) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    "request_url, origin, allowed, want",
    [("https://a.example/x", "https://evil.example", "", None), ("https://a.example/x", "https://a.example", "", "https://a.example"), ("https://a.example/x", "https://b.example", "https://b.example", "https://b.example"), ("https://a.example/x", None, "https://b.example", None)],
)
def test_cors(spark, request_url, origin, allowed, want):
    df = spark.createDataFrame([(request_url, origin, allowed)], "u string, o string, a string")
    assert df.select(net.cors_origin(F.col("u"), F.col("o"), F.col("a"))).first()[0] == want


def test_gate(spark):
    df = spark.createDataFrame([("GET", "/api/health", None, "k"), ("POST", "/api/upload", None, "k"), ("POST", "/api/upload", "Bearer k", "k"), ("GET", "/api/x", "Bearer k", "k")], "m string, p string, h string, k string")
    assert [r[0] for r in df.select(net.gate(*map(F.col, "mphk"))).collect()] == ["health", "unauthorized", "upload", "not_found"]


def test_addresses_in_other_notations(spark):
    local = ["2130706433", "0x7f000001", "0177.0.0.1", "127.1", "0x7f.0.1", "localhost", "[0:0::1]", "[::ffff:7f00:1]", "me:pw@127.0.0.1", "127.0.0.1."]
    bad = ["256.1", "1.2.3.4.5", "4294967296", "08", "1.256.1.1"]
    fine = ["files.example", "0x7f.example", "128.1", "[2001:db8::1]"]
    df = spark.createDataFrame([(i, f"\thttp://{h}:80/\n") for i, h in enumerate(local + bad + fine)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(net.resolve_url(F.lit("production"), F.col("u"))["reason"]).collect()]
    assert got == ["loopback_unreachable_in_production"] * len(local) + ["invalid_cleaner_url"] * len(bad) + [None] * len(fine)


def test_tokens(spark):
    rows = [("Bearer k", "k", True), ("Bearer k\n", "k", False), ("bearer \t k", "\tk\u00a0", True), (None, "k", False), (None, " \t", True), ("Bearer ", "k", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, k string, want boolean")
    assert df.filter(net.bearer_ok(F.col("h"), F.col("k")) != F.col("want")).count() == 0


@pytest.mark.parametrize("kind", ["text/plain", "message/rfc822", "multipart/related; boundary=zz", "multipart/form-data; boundary=B", None])
def test_uploads_come_back_byte_by_byte(kind):
    import random

    from lintel.sources import parse_upload

    rng = random.Random(1)
    for n in (0, 1, 2, 50, 5000):
        content = bytes(rng.choice(b"\r\n-B ab\x00\xff:") for _ in range(n)).replace(b"--B0", b"")
        head = b'--B0\r\ncontent-disposition: form-data; NAME="file"; filename="a b;c.txt"\r\n' + (f"Content-Type: {kind}\r\n".encode() if kind else b"") + b"\r\n"
        got = parse_upload('multipart/form-data; charset=x; boundary="B0"', b"preamble\r\n" + head + content + b"\r\n--B0--\r\n")
        assert got == ("a b;c.txt", kind and kind.partition(";")[0], content, None)
    assert parse_upload("multipart/form-data", b"x")[3] == parse_upload("multipart/form-data; boundary=B", None)[3] == parse_upload("multipart/form-data; boundary=B", b"--B\r\nx")[3] == "missing_file"
    assert parse_upload(None, b"")[3] == "unsupported_media"
