"""File sources: a corpus folder, type sniffing, first-wins ingest, and JSON and CSV side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.sectioning import read_documents

# What the readers take, and the caps of an upload.
SUFFIXES = (".txt", ".docx", ".pdf")
MOST_BYTES = 25 * 1024 * 1024


def file_type(name: Column, content: Column) -> Column:
    """The suffix if name and bytes agree: %PDF- in the first kilobyte, PK\\x03\\x04 at the start, neither for text; else null."""
    low = F.lower(name)
    pdf = F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?255044462D")  # at a whole byte
    packed = F.hex(F.substring(content, 1, 4)) == "504B0304"
    return F.when(low.endswith(".pdf") & pdf, ".pdf").when(low.endswith(".docx") & packed, ".docx").when(low.endswith(".txt") & ~pdf & ~packed, ".txt")


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, sha256, kind, refused: the supported files of a folder. Oversized ones are refused, not read further."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,docx,pdf}").load(folder)
    kind = file_type(F.col("path"), F.col("content"))
    refused = F.when(F.col("length") > MOST_BYTES, "too large").when(F.col("length") == 0, "empty").when(kind.isNull(), "type")
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), refused.alias("refused"))


def ingest_corpus(files: DataFrame, reader_version: str = "v1") -> DataFrame:
    """One row for each content and reader version, the first path winning, read as text where the type is text."""
    fine = files.where("refused IS NULL")
    first = fine.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    kept = fine.join(first, ["sha256", "path"]).withColumn("doc_id", F.xxhash64("sha256"))
    texts = read_documents(kept.where("kind = '.txt'"))
    return kept.select("doc_id", "sha256", "path", "copies", "kind", F.lit(reader_version).alias("reader_version")).join(texts, "doc_id", "left")


def label_table(spark: SparkSession, path: str) -> DataFrame:
    """Expert labels: a JSON object title -> category -> spans, as rows title, category, span."""
    raw = spark.read.text(path, wholetext=True)
    titles = raw.select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("title", "by"))
    return titles.select("title", F.explode("by").alias("category", "spans")).select("title", "category", F.explode_outer("spans").alias("span"))


def task_fields(spark: SparkSession, path: str) -> DataFrame:
    """An extraction task's fields in order."""
    schema = "name string, description string, fields array<struct<key:string,label:string,question:string,cuad_category:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("name", F.posexplode("fields").alias("place", "f")).select("name", "place", "f.*")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)
