"""The tables as signals and file sets, for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """Each embedding is a signal at 64 frames a second, interleaved over the channels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("pos", "v"), F.size("embedding").alias("n"))
    long = lambda c: c.cast("long")
    return rows.select(
        "path", long(F.floor(F.col("pos") / channels)).alias("frame"), long(F.col("pos") % channels).alias("channel"), F.col("v").cast("double").alias("value"),
        long(F.floor(F.col("n") / channels)).alias("num_frames"), F.lit(channels).cast("long").alias("num_channels"), F.lit(64).cast("long").alias("sample_rate"),
    )


def signals_sql(channels: int = 1, name: str = "e") -> str:
    return f"""{name} AS (SELECT vec_id AS path, pos // {channels} AS frame, pos % {channels} AS channel, v AS value, n // {channels} AS nf
        FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v, len(embedding) AS n FROM embeddings))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang-id.wav; every seventh is a .flac, every eleventh hidden."""
    d = table(spark, sf_dir, "documents")
    stem = F.concat_ws("-", "lang", F.col("doc_id").cast("string"))
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, F.lit(".")).otherwise(F.lit("")), stem, F.when(F.col("doc_id") % 7 == 0, F.lit(".flac")).otherwise(F.lit(".wav")))
    return d.select(F.concat_ws("/", "source", name).alias("path"), F.col("source").alias("folder"), stem.alias("stem"), "doc_id", "lang")


FILES_SQL = """f AS (SELECT source || '/' || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || lang || '-' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.flac' ELSE '.wav' END AS path,
        source AS folder, lang || '-' || doc_id AS stem, doc_id, lang FROM documents)"""


def takes(spark: SparkSession, sf_dir: str, each: int = 8) -> DataFrame:
    """Every document as a take: `each` neighbours are a set, the language is the microphone. The stem repeats it (`men`)."""
    d = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))
    stem = F.concat(F.lit("men-take"), F.floor(F.col("doc_id") / each).cast("string"), F.lit("-"), F.col("lang"))
    return d.select(F.concat(F.lit("room"), F.col("doc_id").cast("string"), F.lit("/"), stem, F.lit(".wav")).alias("path"), stem.alias("stem"), "lang")


TAKES_SQL = """t AS (SELECT 'room' || doc_id || '/men-take' || k || '-' || lang || '.wav' AS path, 'men-take' || k || '-' || lang AS stem, 'men-take' || k || '-*' AS set_key, lang
        FROM (SELECT doc_id, doc_id // 8 AS k, coalesce(lang, 'none') AS lang FROM documents))"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a sample: brand as folder, size as root note, which many share."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.col("p_size").cast("long").alias("root"), F.col("p_partkey").alias("file"))


ROOTS_SQL = "r AS (SELECT p_brand AS folder, p_size::BIGINT AS root, p_partkey AS file FROM part)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signals of 100 frames; their lines as regions."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("start_frame"), F.col("l_quantity").cast("long").alias("num_frames"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(item).alias("regions"))


REGIONS_SQL = "g AS (SELECT l_orderkey AS path, l_linenumber::BIGINT AS s, l_quantity::BIGINT AS n FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with k: 1, 2, ... in each order, as its own line numbers repeat."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order))


LINES_SQL = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem)"
