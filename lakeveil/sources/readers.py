"""Sources and sinks (S1 to S6, K1 to K4): every input is read and every output written by Spark, by any path that it can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "name string, note string, elements array<struct<id:string,kind:string,redact:boolean,why:string>>, mustFind array<string>, mustNotFind array<string>, visionQueueMin int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where the input has fewer splits than these, as a small single file has; at
    scale, where splits are many, nothing is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file of a folder, with its path as url."""
    return spark.read.text(folder, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))


def truth_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled elements of truth files."""
    return spark.read.schema(TRUTH).json(folder, multiLine=True).select("name", F.explode("elements").alias("e")).select("name", "e.*")


def corpus_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: name and url of a list whose blank and # lines don't count."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not line like '#%'")
    return lines.select(F.split("line", r"\s+")[0].alias("name"), F.split("line", r"\s+")[1].alias("url"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a text or CSV list, lower-cased."""
    words = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("w")).select(F.lower(F.trim("w")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z][a-z'-]*$")).distinct()


def accepted_failures(spark: SparkSession, path: str) -> DataFrame:
    """Id and reason of the failures that a baseline file accepts; entries without an id don't count."""
    listed = "accepted array<struct<id:string,why:string>>"
    return spark.read.schema(listed).json(path, multiLine=True).select(F.explode("accepted").alias("a")).select("a.*").where("id is not null")


def conversation_units(turns: DataFrame) -> DataFrame:
    """One unit for each turn; the session is the conversation, so tokens are stable across turns."""
    return turns.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("unit_seq"), "role", "text")


def document_units(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("session_id"), F.lit(0).alias("unit_seq"), "text")


def payload(units: DataFrame) -> DataFrame:
    """K1: a session's sanitized units as JSON, with its size in bytes."""
    parts = F.array_sort(F.collect_list(F.struct("unit_seq", "text")))
    return units.groupBy("session_id").agg(F.to_json(parts).alias("payload")).withColumn("payload_bytes", F.octet_length("payload"))


def append_ledger(entries: DataFrame, path: str, origin: Column, at: Column) -> None:
    """K2: adds a request's entries (``audit.entries``) with its origin and time; ``audit.retain`` reads back the latest."""
    entries.withColumns({"origin": origin, "at": at.cast("timestamp")}).write.mode("append").parquet(path)


def write_report(view: DataFrame, totals: DataFrame, folder: str) -> None:
    """K3: the rows that a report shows (``audit.field_view``, ``audit.totals``) as JSON lines, in place of an earlier report."""
    view.write.mode("overwrite").json(f"{folder}/fields")
    totals.write.mode("overwrite").json(f"{folder}/totals")


def append_corpus(pages: DataFrame, counts: DataFrame, path: str, captured_at: Column) -> None:
    """K4: adds the pages that ``counts`` (``pages.capturable``) lists, with when and where each was captured and its number of nodes."""
    kept = pages.join(counts.select("page_id", F.col("nodes").alias("n_nodes")), "page_id")
    kept.select("page_id", "url", "html", "n_nodes", captured_at.cast("timestamp").alias("captured_at")).write.mode("append").parquet(path)
