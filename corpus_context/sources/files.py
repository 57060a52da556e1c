"""Sources: file trees (A1) and file-event streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context import schemas as SC


def scan_files(spark: SparkSession, roots: list[str], max_size: int | None = None, skip_unreadable: bool = False) -> DataFrame:
    """A1: every regular file under the roots with path, size, mtime and bytes.

    ``binaryFile`` reads no bytes when ``content`` is pruned from the plan, and
    pushes ``length`` filters into the listing, so size rules run before any
    read. ``root`` is the longest root that prefixes the path; roots may be given with their scheme (``file:/...``).
    Files of no bytes are left out, as by every file source of Spark. With ``skip_unreadable`` a file that vanishes or can't be read gives no row, else the job fails.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if skip_unreadable:
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = r.load(roots)
    if max_size is not None:
        df = df.where(F.col("length") <= max_size)
    path = F.regexp_replace(F.col("path"), r"^file:(//)?", "")
    clean = [x.rstrip("/") or "/" for x in (re.sub("^file:(//)?", "", r) for r in roots)]
    root = None
    for x in sorted(clean, key=len):  # the longest matching root wins (last when-branch checked first below)
        cond = path.startswith(x + "/")
        root = F.when(cond, F.lit(x)) if root is None else F.when(cond, F.lit(x)).otherwise(root)
    return df.select(root.alias("root"), path.alias("path"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("mtime"), "content")


def fs_event_source(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of file events with the fs_events schema; events of directories (rows with is_directory = true, where the
    files have that column) are dropped."""
    r = spark.readStream.schema(T.StructType([*SC.FS_EVENTS.fields, T.StructField("is_directory", T.BooleanType())])).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).where(~F.coalesce("is_directory", F.lit(False))).drop("is_directory")


def read_documents(spark: SparkSession, paths: list[str] | str, id_col: str | None = None) -> DataFrame:
    """Whole JSON documents from files -> (doc_id, json, is_valid); doc_id is the file's name without its extension, or
    the folder column ``id_col``; is_valid tells a JSON object from anything else, a cut or corrupt file included."""
    files = spark.read.text(paths, wholetext=True)
    name = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "") if id_col is None else F.col(id_col).cast("string")
    d = files.select(name.alias("doc_id"), F.col("value").alias("json"))
    valid = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("json")), F.lit("OBJECT")), F.lit(False))
    return d.select("doc_id", "json", valid.alias("is_valid"))
