"""Queries that run a stream to its end and return what it left, and source round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import secondary
from glossa.plans.common import Registry, load
from glossa.sources import readers, sinks
from glossa.sources.storage import shared_dir
from glossa.streaming import counts as S

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle


@_R.query("SELECT event_type, count(*) AS n, count(*) AS n_rows FROM events GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merge-counts over a stream of the events."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = load(spark, sf_dir, "events").schema
    stream = S.stream_table(spark, f"{sf_dir}/events.parque[t]", schema)
    sink = S.CountSink(f"{root}/out", ["event_type"])
    S.run_counts(stream, sink, f"{root}/checkpoint").awaitTermination()
    return sink.totals(spark)


@_R.query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type (extension), in the batch form of windowed()."""
    w = S.windowed(load(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")
    return w.select(F.col("window.start").alias("day"), "event_type", "n")


@_R.query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps below twelve hours (extension)."""
    s = S.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "12 hours")
    return s.select("user_id", F.col("session_window.start").alias("started"), "n")


@_R.query("SELECT doc_id::VARCHAR AS doc_id, source, lang FROM documents")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through gzip tab-separated files and back."""
    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    sinks.write_tsv(load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), path, gzip=True)
    return readers.tsv(spark, path, ["doc_id", "source", "lang"])


@_R.query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1, 'new'")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts into a keyed table."""
    t = sinks.KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", "c_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    t.upsert(c)
    t.upsert(c.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("new")).unionByName(spark.range(1).select((F.col("id") - 1).alias("c_custkey"), F.lit("new").alias("segment"))))
    return t.read()


@_R.query("SELECT page_id, length(html) AS n, CASE WHEN length(html) > 500000 THEN '__TOO_LARGE__' ELSE 'ok' END AS mark FROM pages")
def capped_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n"), readers.capped_content("html").alias("c"))
    return c.select("page_id", "n", F.when(F.col("c") == readers.TOO_LARGE, F.col("c")).otherwise("ok").alias("mark"))


@_R.query("SELECT vec_id, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[-1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings")
def embedding_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at length 1 (S19): their first and last coordinates."""
    e = readers.embeddings(load(spark, sf_dir, "embeddings"), "embedding")
    return e.select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", -1), 6).alias("last"))


@_R.query()
def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of title, headers, links and body."""
    p = load(spark, sf_dir, "pages")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), T.tokens(c).alias("w")) for n, c in secondary.html_regions("html").items()]))
    return p.select("page_id", each.alias("x")).select("page_id", "x.region", F.size("x.w").alias("n"))


@_R.query()
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of pages that aren't junk, long ones cut."""
    from glossa.operators.summarize import rechunked

    s = load(spark, sf_dir, "pages").select("page_id", F.explode(T.sentences(T.html_text("html"))).alias("s")).filter(~T.is_junk_segment("s"))
    return s.select("page_id", F.explode(rechunked("s")).alias("segment"))
