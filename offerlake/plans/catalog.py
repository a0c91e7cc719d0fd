"""Query keys: each operator of the inventory run over the driver's test tables.

Stand-ins (see FIXTURES.md): ``documents`` plays the silver offers (title = first line, description =
text, skills = source), ``embeddings`` the gold vectors (``vec_id`` = offer key), ``benchmark`` the CVs
(a CV's vector is the ``embeddings`` row with ``vec_id = item_id``), ``pages`` raw HTML bronze, ``labels``
the keys already processed, ``events`` dates / statuses / JSON, ``orders``/``lineitem`` parent/child.
Every query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions import nested as nx
from offerlake.functions import text as tx
from offerlake.functions.stemming import stem_vocabulary
from offerlake.operators import index_store, links, search, tables as tb
from offerlake.operators.encode import encode
from offerlake.operators.ranking import global_rank
from offerlake.plans import jobs
from offerlake.plans.oracle_sql import AS_OF, BASE_URL
from offerlake.session import read_table, scratch_path
from offerlake.sources import batches as bt
from offerlake.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def _work(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for heavy work on each row (regular expressions over whole texts, vector products): a scan of fewer
    partitions than cores is spread."""
    return read_table(spark, sf, name, spread_rows=True)


# ---------------------------------------------------------------------------------------------- stand-ins


def offers(spark: SparkSession, sf: str, spread_rows: bool = True) -> DataFrame:
    d = read_table(spark, sf, "documents", spread_rows)
    return d.select(F.col("doc_id").alias("job_id"), tx.first_line("text").alias("title"),
                    F.col("text").alias("description"), F.col("source").alias("skills"), "source", "lang", "text")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    e = _work(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    return e.join(_t(spark, sf, "documents").select(F.col("doc_id").alias("job_id")), "job_id", "left_semi")


def cvs(spark: SparkSession, sf: str) -> DataFrame:
    b = _t(spark, sf, "benchmark")
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("cv_embedding"))
    return b.join(e, "item_id").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text"), "cv_embedding")


_INDEX_TABLES: dict[tuple, str] = {}


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The posting index of the offers, as the search reads it: a table written once to the shared
    checkpoint folder (the lake keeps it next to silver) and read back by every search."""
    src = f"{sf.rstrip('/')}/documents.parquet"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(src)
    st = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hpath)
    tag = (src, st.getModificationTime(), st.getLen(), spark.sparkContext.applicationId)
    path = _INDEX_TABLES.get(tag)
    if path is None:
        path = scratch_path(spark, "postings")
        # Written flat: a batch of CVs touches every lexeme bucket, so bucketed storage (write_index)
        # pays off only for small batches against a large index.
        search.build_index(offers(spark, sf, spread_rows=False)).write.parquet(path)
        _INDEX_TABLES[tag] = path
    return spark.read.parquet(path)


def link_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status per key from the latest event of each user: error -> timeout, purchase -> 404,
    signup -> exception (the check itself failed), anything else -> 200."""
    ev = _t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    last = tb.latest_per_key(ev, "user_id", ["ts", "event_id"])
    status = (F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "purchase", "404")
              .when(F.col("event_type") == "signup", "exception").otherwise("200"))
    return last.select(F.col("user_id").alias("job_id"), status.alias("status"))


def _rrf(spark: SparkSession, sf: str) -> DataFrame:
    return search.rrf_search(corpus(spark, sf), index(spark, sf), cvs(spark, sf), search.SearchConfig())


def _events_batches(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    name = F.concat(F.lit("jobs_raw_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.date_format("ts", "HH"), F.lit("0000"))
    return ev.select("event_id", name.alias("batch"))


# ---------------------------------------------------------------------------------------------- text


@query
def html_clean(spark, sf):
    return _work(spark, sf, "pages").select("page_id", tx.html_clean("html").alias("text"))


@query
def vector_text(spark, sf):
    d = _work(spark, sf, "documents")
    skills = F.array(F.struct(F.col("source").alias("libelle")))
    trainings = F.array(F.struct(F.col("lang").alias("domaineLibelle")))
    qualities = F.lit(None).cast("array<struct<libelle:string,description:string>>")
    return d.select(F.col("doc_id").alias("job_id"), tx.vector_text(
        tx.first_line("text"), tx.html_clean("text"), tx.nested_text(skills, "libelle"),
        tx.nested_text(trainings, "domaineLibelle"), tx.nested_text(qualities, "libelle")).alias("vector_text_input"))


@query
def nested_text(spark, sf):
    """Typed list, JSON list of objects, JSON list of strings, one JSON object, and plain text."""
    d = _work(spark, sf, "documents")
    lines = F.split("text", "\n")
    items = F.transform(lines, lambda line: F.struct(line.alias("libelle")))
    return d.select("doc_id", tx.nested_text(items, "libelle").alias("skills_text"),
                    tx.nested_text_from_json(F.to_json(items), "libelle").alias("skills_text_json"),
                    tx.nested_text_from_json(F.to_json(lines), "libelle").alias("skills_strings"),
                    tx.nested_text_from_json(F.to_json(F.struct(F.col("text").alias("libelle"))), "libelle").alias("skills_object"),
                    tx.nested_text_from_json(F.concat(F.lit("[CDI] "), "text"), "libelle").alias("skills_plain"))


@query
def fts_clean(spark, sf):
    return _work(spark, sf, "documents").select("doc_id", tx.fts_clean("text").alias("cleaned"))


@query
def matching_terms(spark, sf):
    """Keywords of a highlighted text (every sentence fragment of a document marked <b>..</b>)."""
    d = _work(spark, sf, "documents")
    marked = F.regexp_replace("text", r"([^.\n<>]+)", "<b>$1</b>")
    return d.select("doc_id", tx.headline_keywords(marked).alias("keywords"))


# ---------------------------------------------------------------------------------------------- tables


@query
def dedup_first(spark, sf):
    return tb.dedup_first(_t(spark, sf, "documents"), "text", "doc_id")


@query
def unprocessed(spark, sf):
    return tb.unprocessed(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars")


@query
def merge_insert_only(spark, sf):
    d = _t(spark, sf, "documents")
    target = d.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    source = d.select("doc_id", F.concat("text", F.lit(" [v2]")).alias("text"))
    return tb.merge_insert_only(source, target, "doc_id", order="doc_id")


def _events_dated(spark, sf):
    return _t(spark, sf, "events").withColumn("ingestion_date", F.to_date("ts"))


@query
def retention(spark, sf):
    return tb.retention(_events_dated(spark, sf), "ingestion_date", AS_OF, 14).select("event_id", "ingestion_date")


@query
def retention_partitions(spark, sf):
    """Retention of a table stored by date: expired dates are dropped as folders."""
    path = scratch_path(spark, "events-by-date")
    _events_dated(spark, sf).select("event_id", "ingestion_date").repartition("ingestion_date").write.partitionBy("ingestion_date").parquet(path)
    tb.drop_expired(spark, path, AS_OF, 14)
    return spark.read.schema("event_id long, ingestion_date date").parquet(path)


@query
def retention_report(spark, sf):
    return tb.retention_report(_events_dated(spark, sf), "ingestion_date", AS_OF, 14)


@query
def export_latest(spark, sf):
    silver = _events_dated(spark, sf).select("event_id", "ingestion_date", "event_type",
                                             nx.json_parse("props", "struct<k:int,note:string>").alias("props"))
    gold = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding",
                                              F.to_date(F.lit(AS_OF)).alias("ingestion_date"))
    return jobs.export_latest(silver, gold)[0]


def _orders_kept(spark, sf):
    return _t(spark, sf, "orders").filter(F.col("o_orderstatus") != "F")


@query
def cascade_delete(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return tb.cascade_delete(li, _orders_kept(spark, sf), "l_orderkey", "o_orderkey")


@query
def fk_orphans(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return tb.fk_orphans(li, _orders_kept(spark, sf), "l_orderkey", "o_orderkey")


ALIGN_TARGET = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("nation", T.IntegerType()), T.StructField("balance", T.DoubleType()),
    T.StructField("segment", T.StringType()), T.StructField("comment", T.StringType()),
    T.StructField("phone", T.IntegerType()), T.StructField("info", T.StringType()),
    T.StructField("place", T.StructType([T.StructField("nation", T.LongType()), T.StructField("city", T.StringType())])),
])


@query
def schema_align(spark, sf):
    c = _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("extra"),
        F.when(F.col("c_acctbal") < 0, "none").otherwise(F.col("c_nationkey").cast("string")).alias("phone"),
        F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("info"),
        F.struct(F.col("c_nationkey").cast("string").alias("nation"), F.lit("x").alias("zip")).alias("place"))
    out = tb.schema_align(c, ALIGN_TARGET)
    return out.select("*", F.col("place.nation").alias("place_nation"), F.col("place.city").alias("place_city")).drop("place")


@query
def union_relaxed(spark, sf):
    c = _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("info"))
    s = _t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"),
        F.col("s_acctbal").cast("float").alias("balance"), F.lit("supplier").alias("kind"),
        F.col("s_name").alias("info"))
    return tb.union_relaxed([c, s])


@query
def union_files(spark, sf):
    """Files of one folder that disagree on types and columns: a key as int, long and text, an amount as decimal and double."""
    path = scratch_path(spark, "mixed-files")
    ev = _t(spark, sf, "events")
    ev.select(F.col("event_id").cast("int").alias("id"), F.col("value").cast("decimal(12,2)").alias("value")).where("id % 3 = 0").write.parquet(f"{path}/jobs_raw_20240101_000000")
    ev.select(F.col("event_id").alias("id"), "value", "event_type").where("id % 3 = 1").write.parquet(f"{path}/jobs_raw_20240102_000000")
    ev.where("event_id % 3 = 2").select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), F.col("user_id").alias("user")).write.parquet(f"{path}/jobs_raw_20240103_000000")
    return bt.read_relaxed(spark, f"{path}/*").select("id", "value", "event_type", "user")


# ---------------------------------------------------------------------------------------------- JSON, vectors


@query
def json_field(spark, sf):
    return _t(spark, sf, "events").select("event_id", nx.json_field("props", "$.k").alias("k"))


@query
def json_parse(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select("event_id", nx.json_parse("props", "struct<k:int>")["k"].alias("k"))


@query
def json_serialize(spark, sf):
    n = _t(spark, sf, "nation")
    r = _t(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        "n_nationkey", F.struct("n_name", F.col("r_name").alias("region"), "n_regionkey").alias("payload"))
    out = j.select("n_nationkey", nx.json_serialize(j, "payload").alias("payload"))
    back = nx.json_parse("payload", "struct<n_name:string,region:string,n_regionkey:int>")
    return out.select("n_nationkey", "payload", back["n_name"].alias("name_back"), back["region"].alias("region_back"))


@query
def land_records(spark, sf):
    ev = _t(spark, sf, "events")
    kind = F.col("event_type")
    detail = (F.when(kind == "signup", F.lit("{}")).when(kind == "purchase", F.lit('{"z":1}'))
              .otherwise(F.concat(F.lit('{"v":"'), kind, F.lit('"}'))))
    record = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"detail":'), detail, F.lit("}"))
    raw = ev.select("event_id", "user_id", F.when(kind == "error", F.lit("{}")).otherwise(record).alias("record"))
    landed = bt.land_records(raw, "record", T.StructType([
        T.StructField("k", T.IntegerType()), T.StructField("detail", T.StructType([T.StructField("v", T.StringType())]))]))
    return landed.select("event_id", "user_id", "k", F.col("detail").isNull().alias("no_detail"), F.col("detail.v").alias("v"))


@query
def vector_sanitize(spark, sf):
    e = _t(spark, sf, "embeddings")
    injected = F.transform("embedding", lambda x: F.when(x < -0.25, F.lit(float("nan")).cast("float")).otherwise(x))
    clean = nx.vector_sanitize(injected)
    return e.select("vec_id", clean.alias("embedding"),
                    F.size(F.filter(clean, lambda x: x.isNull())).cast("long").alias("n_null"))


@query
def vector_parse(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", nx.vector_to_json("embedding").alias("embedding"))
    return e.select("vec_id", nx.vector_parse(e, "embedding").alias("embedding"))


@query
def vector_topk(spark, sf):
    e = _work(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")
    return search.vector_topk(e, cvs(spark, sf), search.SearchConfig())


@query
def global_rank_q(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    r = global_rank(li, [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()], "rnk")
    return r.select("l_orderkey", "l_linenumber", "rnk")


QUERIES["global_rank"] = QUERIES.pop("global_rank_q")


# ---------------------------------------------------------------------------------------------- search


@query
def fts_index(spark, sf):
    ix = search.build_index(offers(spark, sf, spread_rows=False))  # spreads the texts itself
    return ix.select("job_id", "lexeme", "n_a", "n_b", "n_c", "title_len",
                     F.round("w_f", 9).alias("w_f"), F.round("w_t", 9).alias("w_t"))


@query
def fts_rank(spark, sf):
    cfg = search.SearchConfig()
    q = search.cv_lexemes(_t(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text")), cfg)
    s = search.text_scores(index(spark, sf), q, cfg)
    return s.select("cv_id", "job_id", F.round("fts_score", 9).alias("fts_score"))


@query
def title_rank(spark, sf):
    cfg = search.SearchConfig()
    q = search.cv_lexemes(_t(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text")), cfg)
    s = search.text_scores(index(spark, sf), q, cfg)
    return s.filter(F.col("title_score") > 0).select("cv_id", "job_id", F.round("title_score", 9).alias("title_score"))


@query
def rrf_search(spark, sf):
    return _rrf(spark, sf).select(
        "cv_id", F.col("rank").cast("long").alias("rank"), "job_id", "embedding_score", "fts_score", "title_score",
        F.round("combined_score", 9).alias("combined_score"), "embed_rank", "fts_rank", "title_rank")


@query
def rrf_candidates(spark, sf):
    """The same search with the CV batch cut into slices, each scored against the vectors by itself."""
    from offerlake.operators import rrf

    top = rrf.rrf_search(corpus(spark, sf), index(spark, sf), cvs(spark, sf), search.SearchConfig(), cvs_per_slice=70)
    return top.select(
        "cv_id", F.col("rank").cast("long").alias("rank"), "job_id", "embedding_score", "fts_score", "title_score",
        F.round("combined_score", 9).alias("combined_score"), "embed_rank", "fts_rank", "title_rank")


@query
def score_map(spark, sf):
    cfg = search.SearchConfig()
    sim = tx.linear_map(F.col("combined_score"), 0.0, cfg.score_max, 0.0, 1.0)
    return _rrf(spark, sf).select("cv_id", "job_id",
                                  F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim)), 2).alias("similarity_score"))


def _result_offers(spark, sf):
    o = offers(spark, sf)
    return o.select("job_id", F.col("title").alias("intitule"), F.col("source").alias("entreprise"),
                    F.col("lang").alias("lieu"), F.lit(None).cast("string").alias("type_contrat"),
                    F.lit(None).cast("string").alias("date_creation"),
                    tx.search_text("title", "text", "skills", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("search_text"))


@query
def search_results(spark, sf):
    cfg = search.SearchConfig()
    q = search.cv_lexemes(cvs(spark, sf), cfg)
    res = search.result_rows(_rrf(spark, sf), _result_offers(spark, sf), q, cfg)
    return res.withColumn("rank", F.col("rank").cast("long"))


@query
def headline(spark, sf):
    cfg = search.SearchConfig()
    q = search.cv_lexemes(cvs(spark, sf), cfg)
    top = search.shipped(_rrf(spark, sf).select("cv_id", "rank", "job_id"), q, cfg)
    j = (_result_offers(spark, sf).select("job_id", "search_text").join(top, "job_id")
         .select("cv_id", "rank", "job_id", "search_text", "terms").repartition("cv_id", "job_id"))  # the joins may leave few tasks
    return search.headline(j, "search_text", "terms").select("cv_id", F.col("rank").cast("long").alias("rank"), "job_id", "headline")


@query
def snippet_keywords(spark, sf):
    """The chain of a result card: snippet with marks, then the keywords in its marks."""
    return headline(spark, sf).select("cv_id", "rank", "job_id", tx.headline_keywords("headline").alias("keywords"))


ENCODED_DIM = 64


@query
def hybrid_search_text(spark, sf):
    """Search from CV text alone: every document and every CV is encoded by the same encoder."""
    docs = _work(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), "text")
    cv = _t(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text"))
    top = search.hybrid_search(encode(docs, "job_id", "text", dim=ENCODED_DIM), index(spark, sf), cv, dim=ENCODED_DIM)
    return top.select("cv_id", F.col("rank").cast("long").alias("rank"), "job_id", "embedding_score", "fts_score",
                      "title_score", F.round("combined_score", 9).alias("combined_score"))


@query
def fts_stem_vocab(spark, sf):
    """French stems of the distinct words of all documents."""
    words = _work(spark, sf, "documents").select(F.explode(tx.tokens("text")).alias("lexeme"))
    return stem_vocabulary(words)


@query
def fts_rank_stored(spark, sf):
    """Text scores read from an index stored in lexeme buckets; the same rows as ``fts_rank``."""
    path = scratch_path(spark, "bucketed-postings")
    search.write_index(index(spark, sf), path, buckets=16)
    cfg = search.SearchConfig()
    q = search.cv_lexemes(_t(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text")), cfg)
    s = search.text_scores(spark.read.parquet(path), q, cfg)
    return s.select("cv_id", "job_id", F.round("fts_score", 9).alias("fts_score"))


@query
def index_after_delete(spark, sf):
    """Text scores from a stored index that was appended to twice (offers with a label first), lost its dead offers and was
    then cut down to the offers that are left in silver."""
    path = scratch_path(spark, "living-index")
    o = offers(spark, sf, spread_rows=False)  # the index spreads the texts itself
    index_store.create(spark, path, buckets=16)
    index_store.append(o.join(_t(spark, sf, "labels").select(F.col("doc_id").alias("job_id")), "job_id", "left_semi"), path)
    index_store.append(o, path)
    index_store.delete(spark, path, links.dead_keys(link_status(spark, sf)))
    index_store.keep_only(spark, path, o.filter(F.col("lang") != "de"))
    cfg = search.SearchConfig()
    q = search.cv_lexemes(_t(spark, sf, "benchmark").select(F.col("item_id").alias("cv_id"), F.col("text").alias("cv_text")), cfg)
    s = search.text_scores(index_store.postings(spark, path), q, cfg)
    return s.select("cv_id", "job_id", F.round("fts_score", 9).alias("fts_score"))


# ---------------------------------------------------------------------------------------------- links


@query
def link_classify(spark, sf):
    return links.link_classify(link_status(spark, sf), "job_id", on_exception="keep")


@query
def dead_offer_filter(spark, sf):
    top = _rrf(spark, sf).select("cv_id", F.col("rank").cast("long").alias("rank"), "job_id")
    return links.dead_offer_filter(top, link_status(spark, sf), "job_id")


@query
def dead_offer_delete(spark, sf):
    silver = _t(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    gold = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"))
    s, g = links.delete_dead(silver, gold, link_status(spark, sf), "job_id")
    return (s.select(F.lit("silver").alias("tbl"), F.col("job_id").alias("id"))
            .unionByName(g.select(F.lit("gold").alias("tbl"), F.col("job_id").alias("id"))))


@query
def result_card(spark, sf):
    ev = _t(spark, sf, "events")
    kind = F.col("event_type")
    created = (F.when(kind == "error", F.lit("not a date"))
               .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
               .when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
               .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return ev.select("event_id", tx.offer_url("event_id", BASE_URL).alias("url"),
                     tx.display_date(created).alias("date_display"),
                     tx.percent(F.least(F.col("value") / 500.0, F.lit(1.0))).alias("pct"))


# ---------------------------------------------------------------------------------------------- batches


@query
def latest_batch(spark, sf):
    return bt.latest_batch(_events_batches(spark, sf), "batch")


@query
def recent_batches(spark, sf):
    return bt.recent_batches(_events_batches(spark, sf), AS_OF, 2, "batch")


@query
def latest_day(spark, sf):
    return bt.latest_day(_events_batches(spark, sf), "batch")


@query
def batch_complete(spark, sf):
    ev = _events_dated(spark, sf)
    in_gold = F.coalesce((F.col("event_type") == "purchase") & (F.col("value") > 400), F.lit(False))
    silver, gold = ev.filter(~in_gold), ev.filter(in_gold)
    return bt.batch_complete(silver, gold)


@query
def backfill_coverage(spark, sf):
    o = _t(spark, sf, "orders")
    start = F.date_sub(F.to_date(o.select(F.min("o_orderdate")).scalar()), 20)
    end = F.date_add(F.to_date(o.select(F.max("o_orderdate")).scalar()), 45)
    return bt.backfill_coverage(o, "o_orderdate", start, end)


@query
def backfill_union(spark, sf):
    ev = _t(spark, sf, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    early = ev.filter(F.col("ts") < cut).select("event_id", "ts", F.col("user_id").cast("int").alias("user_id"), "value")
    late = ev.filter(F.col("ts") >= cut).select("event_id", "ts", "user_id", "event_type", F.col("value").cast("float").alias("value"))
    return tb.dedup_first(tb.union_relaxed([early, late]), "user_id", ["ts", "event_id"])


@query
def run_metrics(spark, sf):
    return jobs.run_metrics(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id", "text", "n_chars")


# ---------------------------------------------------------------------------------------------- jobs


def _bronze_pages(spark, sf):
    p = _work(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("intitule"),
                    F.col("html").alias("description"))


@query
def silver_build(spark, sf):
    s = jobs.build_silver(_bronze_pages(spark, sf), AS_OF)
    return s.select("job_id", "intitule", "description", "vector_text_input", "ingestion_date")


@query
def gold_build(spark, sf):
    o = offers(spark, sf)
    silver = o.select("job_id", F.concat_ws(" ", "title", "text").alias("vector_text_input"),
                      F.date_sub(F.to_date(F.lit(AS_OF)), (F.col("job_id") % 5).cast("int")).alias("ingestion_date"))
    gold = _t(spark, sf, "labels").select(F.col("doc_id").alias("job_id"))
    return jobs.build_gold(silver, gold, AS_OF, dim=ENCODED_DIM)


def _run(spark, sf, counters=None, twice=False):
    """A run over stored tables: pages with a label are stored already, under other texts and dates (some past
    retention), and those without a toxic label have vectors. With ``twice`` some pages come a second time, or without id."""
    pages = _bronze_pages(spark, sf)
    fetched = pages
    if twice:
        fetched = pages.unionByName(pages.where("id % 5 = 0")).unionByName(pages.where("id % 7 = 0").withColumn("id", F.lit(None).cast(pages.schema["id"].dataType)))
    labels = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stored = pages.join(labels, pages.id == labels.doc_id).select(
        F.col("id").cast("string").alias("job_id"), "intitule", F.lit("stored").alias("description"),
        F.concat(F.lit("stored "), "intitule").alias("vector_text_input"),
        F.date_sub(F.to_date(F.lit(AS_OF)), (F.col("id") % 90).cast("int")).alias("ingestion_date"), "toxic")
    old = stored.filter("toxic = 0").withColumn("text", F.concat(F.lit("gold "), "intitule"))
    gold = encode(old, "job_id", "text", dim=ENCODED_DIM).join(old.select("job_id", "ingestion_date"), "job_id")
    return jobs.run_batch(fetched, stored.drop("toxic"), gold, AS_OF, dim=ENCODED_DIM, counters=counters)


@query
def batch_end_to_end(spark, sf):
    """Returns all four outputs of the run, written and read as a pair."""
    silver, gold, ex_s, ex_g = _run(spark, sf)
    path = scratch_path(spark, "pairs")
    jobs.write_pair(silver, gold, path, "r1")
    silver, gold = jobs.read_pairs(spark, path)
    none = F.lit(None).cast("array<float>")
    parts = [("silver", silver.withColumn("embedding", none)), ("export_silver", ex_s.withColumn("embedding", none)),
             ("gold", gold.withColumn("vector_text_input", F.lit(None).cast("string"))),
             ("export_gold", ex_g.withColumn("embedding", nx.vector_parse(ex_g, "embedding"))
              .withColumn("vector_text_input", F.lit(None).cast("string")))]
    out = [df.select(F.lit(tbl).alias("tbl"), "job_id", F.col("ingestion_date").cast("string").alias("ingestion_date"),
                     "vector_text_input", "embedding") for tbl, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def run_counters(spark, sf):
    """What a run counted while it wrote silver and gold, read back from beside the run."""
    counters: dict = {}
    silver, gold, _, _ = _run(spark, sf, counters, twice=True)
    path = scratch_path(spark, "counted-run")
    jobs.write_pair(silver, gold, path, "r1", counters)
    return jobs.read_counters(spark, path)


@query
def serving_load(spark, sf):
    """Served rows hold other texts, vectors and dates than the batch: what is served stays as it is or expires."""
    as_of = F.to_date(F.lit(AS_OF))
    d = _t(spark, sf, "documents").withColumn("ingestion_date", as_of)
    served = d.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("served "), "source").alias("text"),
        F.date_sub(as_of, (F.col("doc_id") % 60).cast("int")).alias("ingestion_date"))
    batch = tb.dedup_first(d.select(F.col("doc_id").alias("job_id"), "text", "ingestion_date"), "job_id", "job_id")
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), nx.vector_to_json("embedding").alias("embedding"),
                                            as_of.alias("ingestion_date"))
    served_gold = (_t(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), F.reverse("embedding").alias("embedding"))
                   .join(served.select("job_id", "ingestion_date"), "job_id"))
    s_after, g_after = jobs.load_serving(batch, e, served, served_gold, AS_OF, 30)
    none = F.lit(None)
    return (s_after.select(F.lit("silver").alias("tbl"), F.col("job_id").alias("id"), "ingestion_date", "text",
                           none.cast("array<float>").alias("embedding"))
            .unionByName(g_after.select(F.lit("gold").alias("tbl"), F.col("job_id").alias("id"), "ingestion_date",
                                        none.cast("string").alias("text"), "embedding")))


@query
def stream_file_ingest(spark, sf):
    """Two availableNow runs over the events file (the second one replays it, as a retry would) into a
    fresh table in the shared checkpoint folder; the insert-only merge keeps one row per event."""
    schema = _t(spark, sf, "events").schema
    target = scratch_path(spark, "stream-events")
    for attempt in range(2):
        stream_ingest(spark, sf, schema, target, "event_id", scratch_path(spark, f"stream-ckpt-{attempt}-{uuid.uuid4().hex[:6]}"),
                      glob="events.parquet", order="ts")
    return spark.read.parquet(target).select("event_id")


def _report(spark, sf, silver: DataFrame, group: str) -> dict[str, DataFrame]:
    gold = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"))
    return jobs.lake_report(silver, gold, AS_OF, contract_col=group, sector_col=group)


def _documents_dated(spark, sf):
    return _t(spark, sf, "documents").withColumn("ingestion_date", F.to_date(F.lit(AS_OF)))


@query
def top_groups(spark, sf):
    return _report(spark, sf, _documents_dated(spark, sf), "source")["contracts"]


@query
def top_groups_events(spark, sf):
    return _report(spark, sf, _events_dated(spark, sf), "event_type")["sectors"]


@query
def total_count(spark, sf):
    return _report(spark, sf, _documents_dated(spark, sf), "source")["total"]


@query
def distinct_count(spark, sf):
    return _report(spark, sf, _documents_dated(spark, sf), "source")["gold_keys"]


@query
def count_per_day(spark, sf):
    return _report(spark, sf, _events_dated(spark, sf), "event_type")["per_day"]


@query
def rebuild_days(spark, sf):
    """Rebuild over many landed batches of differing columns: files read by a glob, relaxed union, silver with the first
    row of each id in batch and row order."""
    pages = _bronze_pages(spark, sf)
    path = scratch_path(spark, "landed")
    pages.select("id", "intitule").withColumn("description", F.lit("first <b>day</b>")).filter(F.col("id").isNotNull()) \
        .join(_t(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi") \
        .write.parquet(f"{path}/jobs_raw_20240101_000000")
    pages.withColumn("description", F.concat("description", F.lit("&amp;"))).withColumn("id", F.col("id").cast("string")) \
        .withColumn("batch_no", F.lit(2)).write.parquet(f"{path}/jobs_raw_20240102_000000")
    days = [bt.read_with_source(spark, f"{path}/jobs_raw_2024010{n}_*/*.parquet").withColumn("batch", F.lit(n)) for n in (1, 2)]
    silver = jobs.build_silver(tb.union_relaxed(days), AS_OF, order=["batch", "_file", "_row"])
    return silver.select("job_id", "intitule", "description", "vector_text_input", "batch_no")
