"""File sources and sinks: folders of documents, the JSON index in its layouts, keyed upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("md", "txt")
SUPPORTED = (*TEXT_SUFFIXES, "xlsx", "xlsm", "docx", "pdf")
INDEX_ITEM = "struct<id:string,text:string,metadata:map<string,string>,vector:array<double>>"
INDEX_SCHEMA = f"dim int, items array<{INDEX_ITEM}>, version string, embedding_dim int, documents array<string>, embeddings array<array<double>>, metadata array<map<string,string>>"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-01, SRC-15, PF-18: supported files below ``folder`` with owner folder, name, title and text; files that are not text
    have null text, which an extractor may fill; empty ones are left out."""
    # other files are not opened
    either_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in suffix) for suffix in SUPPORTED)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either_case}}}").load(folder)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    rows = files.select(
        path.alias("source_path"),
        F.element_at(F.split(path, "/"), -2).alias("owner_folder"),
        name.alias("file_name"),
        F.replace(F.regexp_replace(name, "\\.[^.]+$", ""), F.lit("_"), F.lit(" ")).alias("title"),
        suffix.alias("suffix"),
        F.col("modificationTime").alias("modified_at"),
        F.when(suffix.isin(*TEXT_SUFFIXES), decode_text(F.col("content"))).alias("text"),
        F.col("length").alias("size"),
    )
    return rows.filter(F.col("suffix").isin(*SUPPORTED) & (F.col("size") > 0))


def decode_text(content: Column) -> Column:
    """SRC-10: UTF-8 with bad bytes left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def department_of(folder: Column, owners: dict[str, str]) -> Column:
    """JN-18: the first owner whose name is part of the folder's, else Unknown."""
    out = None
    for owner, department in owners.items():
        hit = F.contains(F.lower(folder), F.lit(owner.lower()))
        out = F.when(hit, department) if out is None else out.when(hit, department)
    return out.otherwise("Unknown") if out is not None else F.lit("Unknown")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: id, text, metadata, vector from either layout; unreadable files give no rows."""
    raw = spark.read.schema(INDEX_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    rows = raw.select(F.explode("items").alias("i")).select("i.id", "i.text", "i.metadata", "i.vector")
    zipped = raw.select(F.posexplode(F.arrays_zip("documents", "embeddings", "metadata")).alias("k", "z"))
    columns = zipped.filter("z.documents is not null").select(
        F.concat(F.lit("doc-"), F.col("k").cast("string")).alias("id"),
        F.col("z.documents").alias("text"),
        F.coalesce("z.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.col("z.embeddings").alias("vector"),
    )
    return rows.unionByName(columns)


def document_key(source_type: Column, source_path: Column) -> Column:
    """A stable id of the natural key."""
    return F.sha2(F.concat_ws("\x1f", source_type, source_path), 256)


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """SRC-19, SRC-22, SRC-32: rows of both, the greatest version of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_new(old: DataFrame, new: DataFrame, content: str) -> DataFrame:
    """SRC-25, SRC-26: rows of ``new`` whose content hash is not there yet, once each."""
    hashed = new.withColumn("content_hash", F.md5(F.col(content))).dropDuplicates(["content_hash"])
    known = old.select(F.md5(F.col(content)).alias("content_hash"))
    return hashed.join(known, "content_hash", "left_anti")


def snapshots_to_drop(names: DataFrame, keep: int = 5) -> DataFrame:
    """SRC-24: all but the newest ``keep``."""
    return names.withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(F.desc("name")))).filter(F.col("_n") > keep).select("name")


def fold_manifest(manifest: DataFrame) -> DataFrame:
    """SRC-03, SRC-30: a landed listing (id, name, mime, size, modified, md5): folders and native sheets skipped, a hash of the
    name, size and id where no checksum came."""
    files = manifest.filter(~F.col("mime").rlike("folder$|spreadsheet$"))
    return files.withColumn("checksum", F.coalesce("md5", F.md5(F.concat_ws("_", "name", F.col("size").cast("string"), "id"))))
