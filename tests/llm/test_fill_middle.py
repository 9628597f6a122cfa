"""Fill-in-the-middle against a plain version, one text at a time."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sitewarden.llm import fill_middle, queries

SCHEMA = "doc_id long, text string, id string, n string, form string, output string, digest string"


def plain_version(doc_id, text, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(seed=2, n=300):
    rng = random.Random(seed)
    pieces = ["a", "Zz", "word", " ", "\n", "\r\n", "é", "中", "😀", "é", "1", "-", "<", ">", "<P", "S>", "M", "\u0000", " ", "ſ", "K"]
    texts = ["", None, "<P>", "x<S>y", "a<M>", "<", "<P", "P>", "<<", "é", "abc", "😀" * 50, "a" * 5000, "word " * 4000]
    return texts + ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


def test_every_text_as_in_the_plain_version(spark, monkeypatch):
    texts = odd_texts()
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)] + [(5, "twice the same"), (5, "twice the same"), (-3, "below zero")]
    for slice_bytes in (fill_middle.SLICE_BYTES, 100):
        monkeypatch.setattr(fill_middle, "SLICE_BYTES", slice_bytes)
        got = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restored()).collect()
        made = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=str)
        assert made == sorted(((i, *plain_version(i, t), t or "") for i, t in rows), key=str)
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_slices_in_the_kernel():
    texts = [(t or "").encode() for t in odd_texts(7)]
    raw, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rng = np.random.default_rng(1)
    draws = tuple(rng.integers(0, 1 << 32, len(texts)) for _ in range(2))
    units, first, second, n_prefix, n_middle = fill_middle.cut_all(raw, bounds, draws)
    for k, t in enumerate(texts):
        want = re.findall(r"[A-Za-z]+|[^A-Za-z]", t.decode(), re.S)
        i, j = sorted(int(d[k]) % (len(want) + 1) for d in draws)
        assert units[k] == len(want)
        assert raw[bounds[k] : first[k]].tobytes().decode() == "".join(want[:i]) and n_prefix[k] == len("".join(want[:i]))
        assert raw[first[k] : second[k]].tobytes().decode() == "".join(want[i:j]) and n_middle[k] == len("".join(want[i:j]))


def test_rates_and_seeds(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words and more").alias("text"))
    shares = {r["form"]: r["count"] for r in fill_middle.fill_in_middle(docs).groupBy("form").count().collect()}
    assert 0.07 < shares["plain"] / 2000 < 0.13 and 0.15 < shares["spm"] / (2000 - shares["plain"]) < 0.25
    assert fill_middle.fill_in_middle(docs, plain_from=0).where("form <> 'plain'").isEmpty()
    other = {r["doc_id"]: r["output"] for r in fill_middle.fill_in_middle(docs, seed="2").collect()}
    assert other[7] == plain_version(7, "some words and more", "2")[-1]


def test_empty_table_and_the_query(spark, tmp_path):
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0
    rows = [(k, t) for k, t in enumerate(odd_texts(3, 30))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_fill_in_middle(spark, str(tmp_path)).collect()}
    assert got == {i: (i, *plain_version(i, t)[:4], sha(plain_version(i, t)[4]), sha(t or "")) for i, t in rows}
