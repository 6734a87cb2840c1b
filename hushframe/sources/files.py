"""File sources and sinks with explicit schemas: manifests, predictions, labelled corpora, address lists, pictures, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int>"
MANIFEST = f"id bigint, url string, screenshot string, html string, baseline_html string, viewport struct<w:int,h:int>, pii array<struct<id:string,kind:string,value:string,hard:string,box:{BOX}>>"
PREDICTION = "id bigint, mode string, kind string, text string"
LABELLED = "text string, spans array<struct<label:string,value:string,start:int,end:int>>"
MASKED = "source_text string, language string, privacy_mask array<struct<start:int,end:int,label:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_manifest(rows: DataFrame, path: str) -> DataFrame:
    """Write one JSON object a line; gives the count of pages and labels."""
    rows.write.json(path)
    return rows.agg(F.count("*").alias("pages"), F.sum(F.size(F.coalesce("pii", F.array()))).alias("labels"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED).json(path)


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """A parquet corpus with character masks, as labelled text."""
    rows = spark.read.parquet(path)
    cut = F.transform("privacy_mask", lambda m: F.struct(m["label"].alias("label"), F.expr("source_text").substr(m["start"] + 1, m["end"] - m["start"]).alias("value"), m["start"].alias("start"), m["end"].alias("end")))
    return rows.select(F.col("source_text").alias("text"), "language", cut.alias("spans"))


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Addresses separated by white space."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("url")).filter("url <> ''")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def data_url(content, kind: str = "image/webp"):
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("id", "mode", "kind", "text").write.json(path)


def payload(record: DataFrame) -> DataFrame:
    """One JSON string for each sanitised record, whitelisted columns alone."""
    allowed = [c for c in ("page_id", "schema", "url", "title", "text", "elements", "redacted_spans", "redacted_elements", "truncated", "by_kind") if c in record.columns]
    return record.select(F.to_json(F.struct(*allowed)).alias("payload"))


def padded(values, width: int, fill=0):
    """An array cut or filled to a width."""
    return F.concat(F.slice(values, 1, width), F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.size(values))))


def with_defaults(stored: DataFrame, defaults: dict) -> DataFrame:
    """Stored settings with defaults where they are null or absent."""
    return stored.withColumns({k: F.coalesce(stored[k], F.lit(v)) if k in stored.columns else F.lit(v) for k, v in defaults.items()})


def newest(history: DataFrame, order: str, keep: int = 20) -> DataFrame:
    """The newest rows, newest first."""
    return history.orderBy(F.desc(order)).limit(keep)


def newest_by(history: DataFrame, key: str, order: str, keep: int = 20) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return history.withColumn("_nth", nth).filter(F.col("_nth") <= keep).drop("_nth")
