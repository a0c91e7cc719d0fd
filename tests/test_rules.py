"""Text rules on hand-worked cases and by their properties on whole tables."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerlake.functions import text as tx
from offerlake.functions.stopwords import FRENCH_STOPWORDS
from offerlake.operators import tables as tb

STOP = set(FRENCH_STOPWORDS)


def cleaned(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", tx.fts_clean("t").alias("c")).orderBy("i").collect()]


def test_fts_clean_hand_worked(spark):
    assert cleaned(spark, ["P y t h o n  e t  D a t a", "Développeur C++, C# !", "  a  b  ", "Le Chat\n(noir) et moi"]) == [
        "python data", "développeur c++ c#", "", "chat noir"]


def test_fts_clean_properties_on_documents(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select(tx.fts_clean("text").alias("c"))
    again = rows.select("c", tx.fts_clean("c").alias("twice")).collect()
    for r in again:
        words = r.c.split(" ") if r.c else []
        assert all(len(w) > 1 and w not in STOP and w == w.lower() for w in words)
        assert r.twice == r.c or sum(map(len, words)) < 1.5 * len(words)


def test_keywords_hand_worked(spark):
    texts = ["x <b>Data Engineer</b> y <b>data engineer</b> <b>SQL!</b>", "<b>ab</b>", None, "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [list(r.k) for r in df.select("i", tx.headline_keywords("t").alias("k")).orderBy("i").collect()]
    assert got == [["data engineer", "sql"], [], [], []]


def test_keywords_properties_on_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    marked = F.regexp_replace("text", r"([^.\n<>]+)", "<b>$1</b>")
    for r in docs.select("text", tx.headline_keywords(marked).alias("k")).collect():
        assert len(r.k) <= 10 and len(set(r.k)) == len(r.k)
        assert all(len(w) > 2 for term in r.k for w in term.split(" "))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 5)), min_size=1, max_size=30))
def test_dedup_first_equals_pandas(spark, rows):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v int, pos int")
    got = sorted((r.k or "", r.v, r.pos) for r in tb.dedup_first(df, "k", "pos").collect())
    pdf = pd.DataFrame(rows, columns=["k", "v"]).assign(pos=range(len(rows)))
    want = sorted((k or "", v, p) for k, v, p in pdf.assign(k=pdf.k.fillna("")).drop_duplicates("k").itertuples(index=False))
    assert got == want
