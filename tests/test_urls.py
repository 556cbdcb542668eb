"""Addresses against literals of the URL standard."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import urls as U

BASE = "http://user:pw@h.test:8080/a/b/x?q#f"
CASES = {
    "http://u:p@H.test/x": "http://u:p@h.test/x", "http://u@h.test/": "http://u@h.test/", "http://:@h.test/x": "http://h.test/x", "http://:p@h.test": "http://:p@h.test/", "http://a@b@h.test/": "http://a%40b@h.test/",
    "http://é:ñ/@h.test/": None, "http://é:ñ@h.test/": "http://%C3%A9:%C3%B1@h.test/", "https://u:p:q@h.test/": "https://u:p%3Aq@h.test/",
    "\\a\\b": "http://user:pw@h.test:8080/a/b", "http:\\\\k.test\\a": "http://k.test/a", "\\\\k.test\\a": "http://k.test/a", "///k.test/a": "http://k.test/a", "https:k.test": "https://k.test/", "https:/k.test/p": "https://k.test/p",
    "http:y": "http://user:pw@h.test:8080/a/b/y", "http:/y": "http://user:pw@h.test:8080/y", "HTTP://K.Test:080/p/": "http://k.test/p", "https://k.test:443/": "https://k.test/", "http://k.test:443/": "http://k.test:443/", "http://k.test:/x": "http://k.test/x",
    "http://k.test:65536/": None, "http://k.test:65535/": "http://k.test:65535/", "http://k.test:x/": None, "http://": None, "http://a b/": None, "http://a%20b/": None, "http://K%41.test/": "http://ka.test/", "http://[::1]:80/x": "http://[::1]/x", "http://[::1/x": None,
    " y\t": "http://user:pw@h.test:8080/a/b/y", "y\nz": "http://user:pw@h.test:8080/a/b/yz", "": "http://user:pw@h.test:8080/a/b/x", "?z": "http://user:pw@h.test:8080/a/b/x", "#z": "http://user:pw@h.test:8080/a/b/x", "../..": "http://user:pw@h.test:8080/",
    "%2e%2E/y": "http://user:pw@h.test:8080/a/y", "./y/.": "http://user:pw@h.test:8080/a/b/y", "/../../y/..": "http://user:pw@h.test:8080/", "/y/%2e": "http://user:pw@h.test:8080/y", "..y": "http://user:pw@h.test:8080/a/b/..y", "//": None,
    "/é ü": "http://user:pw@h.test:8080/%C3%A9%20%C3%BC", "/\U0001f600": "http://user:pw@h.test:8080/%F0%9F%98%80", '/a"<>`{}|^[]': "http://user:pw@h.test:8080/a%22%3C%3E%60%7B%7D|%5E[]", "/%zz%41": "http://user:pw@h.test:8080/%zz%41", "/a'b": "http://user:pw@h.test:8080/a'b",
    "mailto:a@b": None, "javascript:x": None, "ftp://k.test/": None, "y:z": None, "./y:z": "http://user:pw@h.test:8080/a/b/y:z", "http://k.test/a//": "http://k.test/a/", "http://k.test//": "http://k.test/", "http://k.test?x": "http://k.test/", "http://k.test/.": "http://k.test/",
    "https://k.test/a/?b/c#d/": "https://k.test/a", "https://k.test/..a/.b": "https://k.test/..a/.b", "https://BÜ.test/": "https://bü.test/",
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k,) for k in CASES], "u string")


def test_normalise(rows):
    got = {r["u"]: r["n"] for r in rows.select("u", U.normalise(F.col("u"), F.lit(BASE)).alias("n")).collect()}
    assert got == CASES


def test_normalise_again_is_the_same(spark, rows):
    once = rows.select(U.normalise(F.col("u"), F.lit(BASE)).alias("n")).where("n is not null and not n like '%/'")
    assert once.where(U.normalise(F.col("n"), F.col("n")) != F.col("n")).collect() == []


def test_idn(spark):
    df = spark.createDataFrame([("http://BÜcher.test/é",), ("http://h.test/é",), ("/é",)], "u string")
    got = [r[0] for r in df.select(U.normalise(F.col("u"), F.lit("http://h.test/"), idn=True)).collect()]
    assert got == ["http://xn--bcher-kva.test/%C3%A9", "http://h.test/%C3%A9", "http://h.test/%C3%A9"]


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "u string")
    assert df.select(U.normalise(F.col("u"), F.lit(BASE)), U.normalise(F.lit("x"), F.col("u"))).first() == (None, None)
