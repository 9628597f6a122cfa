"""References resolved in the JVM against urllib."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F
from sitewarden.functions.resolve import resolve

BASES = ["http://a/b/c/d;p?q", "https://Shop.example.com", "http://x.y:8080/", "http://a/b//c/", "https://h/a/b/../c", "http://h/a;x=1/b;y", "http://h?q=1", "http://h/é/ü"]
RFC = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "HTTPS://Other/Q", "mailto:x@y", " /lead", "a\tb\n/c", "//", "?", "#", "..;x", "a//b", "/", "/..", "..//x", "a?b?c#d#e", "a;", "//h/p/../q;", "x:y/z", "1:2", "data:,x"]


def check(spark, pairs):
    rows = [(b, r, urljoin(b, r)) for b, r in pairs]
    df = spark.createDataFrame(rows, "base string, ref string, want string").select("*", resolve(F.col("base"), F.col("ref")).alias("got"))
    wrong = df.where("got is distinct from want").collect()
    assert not wrong, wrong[:8]


def test_known_references(spark):
    check(spark, [(b, r) for b in BASES for r in RFC])


def test_random_references(spark):
    rng = random.Random(3)
    piece = lambda: rng.choice(["a", "b.c", "..", ".", "", "é", ";p", "x;y=1", "%20", "a b", "-", ":"])
    ref = lambda: rng.choice(["", "/", "//h", "//h/", "http:", "./"]) + "/".join(piece() for _ in range(rng.randint(0, 5))) + rng.choice(["", "", "?", "?q=/../x", "#f", "?a=1#b/../c"])
    check(spark, [(rng.choice(BASES), ref()) for _ in range(4000)])


def test_nulls(spark):
    df = spark.createDataFrame([(None, "x"), ("http://h/", None)], "base string, ref string").select(resolve(F.col("base"), F.col("ref")).alias("u"))
    assert [r["u"] for r in df.collect()] == [None, None]
