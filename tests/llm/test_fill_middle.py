"""Fill-in-middle against SQL and regular expressions."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, clashing, empty
from tidemark.llm import fill_middle, sql

SF = "/root/testdata/sf0.001"
UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|\A[\x20\x09-\x0D]+\Z"}


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_boundaries(unit):
    rnd = random.Random(1)
    texts = ["", "a", "\n", "a\n", "\n\na", "é\n한국어 😀\n x", "  lead", "lead  ", "   "] + ["".join(rnd.choice("ab é\n한😀\t") for _ in range(rnd.randrange(200))) for _ in range(200)]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = fill_middle.Boundaries(np.frombuffer(b"".join(data), np.uint8), offs)
    parts = [re.findall(UNITS[unit], t) for t in texts]
    assert list(found.count(unit)) == [len(p) for p in parts]
    for _ in range(8):
        j = np.array([rnd.randrange(len(p) + 1) for p in parts])
        assert list(found.after(unit, j) - found.begin) == [len("".join(p[:k]).encode()) for p, k in zip(parts, j)]


def test_wavelet_ranks():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 500):
        values = rnd.integers(0, 8, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(values)
        for v in range(8):
            assert list(matrix.rank(v, np.arange(n + 1))) == [int((values[:p] == v).sum()) for p in range(n + 1)]


def digests(df, **options):
    made = fill_middle.transformed(df, **options)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def marked(spark):
    extra = [(20 + i, t, "en", "m", 1) for i, t in enumerate(["a <P> b\nc", "x<S>", "<M>", "<P\n>", "a<\n<", "\n" * 500, "<\n" * 50, ">\n" * 50, "P>\nS>\nM>\n<P"])]
    return awkward(spark, extra)


@pytest.mark.parametrize("source", ["awkward", "given"])
def test_against_sql(spark, source):
    import duckdb

    if source == "given" and not os.path.isdir(SF):
        pytest.skip("given tables are absent")
    df = marked(spark) if source == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    frame = df.select("doc_id", "text").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    want = sorted(con.execute(sql.FILL_MIDDLE).fetchall(), key=str)
    assert sorted(map(tuple, digests(df).collect()), key=str) == want
    assert sorted(map(tuple, digests(clashing(df).withColumn("output", F.lit(1))).collect()), key=str) == want
    assert {w[2] for w in want} >= {"psm", "spm"} and (source == "given" or "plain" in {w[2] for w in want})


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_every_unit_restores(spark, unit):
    df = marked(spark)
    made = fill_middle.transformed(df, unit=unit, percent=60)
    rows = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r.back for r in rows) == sorted(r.text or "" for r in df.collect())
    assert any(r.form != "plain" for r in rows)
    for r in rows:
        if r.form != "plain":
            assert r.prefix_chars >= 0 and r.middle_chars >= 0 and len(r.output) == len(r.back) + 9


def test_own_marks_and_empty(spark):
    df = spark.createDataFrame([(i, "ab\nba\n" * 5 + "ab") for i in range(40)], "doc_id long, text string")
    made = fill_middle.transformed(df, marks=("ab|", "|", "|ba"))  # marks that overlap the text: what would not be rebuilt stays plain
    back = fill_middle.restored(F.col("output"), F.col("form"), ("ab|", "|", "|ba"))
    assert {r[0] for r in made.select(back).collect()} == {"ab\nba\n" * 5 + "ab"}
    assert fill_middle.transformed(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transformed(df, unit="page")
