"""Relations of the engine made from general tables, for queries over them; each with the SQL that makes it elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("StartApp", "OnDemand", "LivePv", "Other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("bundle_name"), F.md5("text").alias("hash"), F.col("n_chars").alias("crc"), F.col("n_chars").alias("file_size"), kind.alias("category"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("download_path"), "doc_id")


CATALOGUE = """catalogue AS (SELECT source || '/' || lang || '/' || doc_id AS bundle_name, md5(text) AS hash, n_chars AS crc, n_chars AS file_size,
  CASE doc_id % 4 WHEN 0 THEN 'StartApp' WHEN 1 THEN 'OnDemand' WHEN 2 THEN 'LivePv' ELSE 'Other' END AS category, 'p' || (doc_id % 3) AS download_path, doc_id FROM documents)"""


def ledger(spark: SparkSession, folder: str, flag: str = "quality") -> DataFrame:
    labels = table(spark, folder, "labels")
    return catalogue(spark, folder).join(labels, "doc_id").select(F.col("bundle_name").alias("bundle_path"), F.when(F.col(flag) == 1, F.col("hash")).otherwise("stale").alias("hash"))


def ledger_sql(name: str = "ledger", flag: str = "quality") -> str:
    return f"{name} AS (SELECT bundle_name AS bundle_path, CASE WHEN {flag} = 1 THEN hash ELSE 'stale' END AS hash FROM catalogue JOIN labels USING (doc_id))"


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as objects of the bundles of their sizes."""
    p = table(spark, folder, "part")
    kinds = ("Texture2D", "Texture2DArray", "Texture2DArrayImage", "Sprite", "TextAsset", "MonoBehaviour", "AudioClip", "Mesh", "Animator", "Shader")
    return p.select(
        F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("bundle"), F.col("p_partkey").alias("index"), F.col("p_partkey").alias("path_id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 13 != 0, F.concat(F.lit("assets/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), (F.col("p_partkey") % 3).cast("string"), F.lit(".playable"))).alias("container"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 10 + 1).cast("int")).alias("type"), F.lit(None).cast("string").alias("unique_id"), F.round(F.col("p_retailprice")).cast("long").alias("size"), F.col("p_type").alias("data"),
    )


OBJECTS = """objects AS (SELECT 'b' || p_size AS bundle, p_partkey AS index, p_partkey AS path_id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name,
  CASE WHEN p_partkey % 13 <> 0 THEN 'assets/' || lower(replace(p_brand, '#', '_')) || '/' || (p_partkey % 3) || '.playable' END AS container,
  ['Texture2D','Texture2DArray','Texture2DArrayImage','Sprite','TextAsset','MonoBehaviour','AudioClip','Mesh','Animator','Shader'][p_partkey % 10 + 1] AS type, CAST(NULL AS VARCHAR) AS unique_id, CAST(round(p_retailprice) AS BIGINT) AS size, p_type AS data FROM part)"""


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """Events as updates of the jobs of their users."""
    kind = F.when(F.col("event_id") % 97 == 0, "Cancelled").when(F.col("event_id") % 31 == 0, "Completed").when(F.col("event_id") % 37 == 0, "Failed").when(F.col("event_id") % 10 == 1, "DownloadsPlanned").when(F.col("event_id") % 5 == 0, "BundleFailed").when(F.col("event_id") % 5 == 4, "RecordSaved").otherwise("BundleCompleted")
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("update_type"), F.col("event_type").alias("bundle"), F.floor("value").cast("long").alias("n"), F.lit("error").alias("message"))


UPDATES = """updates AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts AS moment, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'Cancelled' WHEN event_id % 31 = 0 THEN 'Completed' WHEN event_id % 37 = 0 THEN 'Failed' WHEN event_id % 10 = 1 THEN 'DownloadsPlanned' WHEN event_id % 5 = 0 THEN 'BundleFailed'
  WHEN event_id % 5 = 4 THEN 'RecordSaved' ELSE 'BundleCompleted' END AS update_type, event_type AS bundle, CAST(floor(value) AS BIGINT) AS n, 'error' AS message FROM events)"""
