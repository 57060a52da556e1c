"""2. Exact dedup as a stateful stream.

The documents are read as a stream; the state, in RocksDB on the executors' disks with its
checkpoints in the shared folder, is keyed by the text's digest and never expires. A key holds the
stable identifier (largest id so far), the content locator of that row (file and row index) and
the number of rows. After the available input is drained, every hit (row of a digest seen more than
once) is compared byte for byte with the text at the locator. Rows that share a digest but not the
bytes form classes of their own, so any digest gives right results.

Defined cases: a null text counts as the empty text (and equals it); a null id sorts below every
other; rows repeated with id and text are one class of which exactly one row stays; an empty table
gives no rows; extra columns are carried, but for ``file``, ``row``, ``digest``, ``top`` and ``n``, which are dropped, and
the result columns' names, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.llm.common import cut_lineage, keep_matching, scratch_path

#: Input drained per micro-batch, in bytes of the files read.
BYTES_PER_TRIGGER = 256 << 30
#: Digests of hits that are broadcast to drop the other texts before the shuffle; more are joined.
BROADCAST_DIGESTS = 100_000
#: Rows of one digest that meet in one task; a larger group is salted.
GROUP_ROWS = 1_000

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # else each partition's store takes some 4 MB of disk in advance, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def stream_state(spark: SparkSession, path: str, state_dir: str, id_col: str, text_col: str, digest,
                 bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """Drains the Parquet files under ``path`` into the state kept in ``state_dir``; returns it as
    (digest, top struct<id, file, row>, n). A later call with the same folder reads new files only."""
    old = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        here = f"{path[:-1]}[{path[-1]}]"  # a pattern for just this path: a stream takes a lone file only so
        src = (spark.readStream.schema(spark.read.parquet(path).schema)
               .option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(here))
        state = _rows(src, id_col, text_col, digest).groupBy("digest").agg(
            F.max(F.struct("id", "file", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
        log = f"{state_dir}/log"

        def keep(changed: DataFrame, batch: int) -> None:  # a replayed batch rewrites its folder
            changed.write.mode("overwrite").parquet(f"{log}/batch={batch}")

        query = (state.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    id_type = spark.read.parquet(path).schema[id_col].dataType.simpleString()
    changes = spark.read.schema(
        f"digest string, top struct<id:{id_type},file:string,row:bigint>, n bigint, batch int").parquet(log)
    return changes.groupBy("digest").agg(F.max_by(F.struct("top", "n"), "batch").alias("s")).select(
        "digest", "s.top", "s.n")


def _mismatches(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Hits whose bytes differ from the text at their digest's locator (digest, id, text, file, row)."""
    multi = state.where(F.col("n") > 1)
    hits = keep_matching(rows, multi.select("digest"), "digest", BROADCAST_DIGESTS).join(
        multi.select("digest", "n", F.col("top.file").alias("at_file"), F.col("top.row").alias("at_row")), "digest")
    salts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    located = hits.where((F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select(
        "digest", F.col("text").alias("at_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = hits.withColumn("salt", F.pmod(F.hash("file", "row"), salts))
    return salted.join(located, ["digest", "salt"]).where(F.col("text") != F.col("at_text")).select(
        "digest", "id", "text", "file", "row")


def dedup_path(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
               digest: Callable[[Column], Column] = sha256, state_dir: str | None = None,
               bytes_per_trigger: int = BYTES_PER_TRIGGER) -> DataFrame:
    """One row per row under ``path``: its columns, keep_id, group_size, kept, text_sha256."""
    path = path.rstrip("/")
    state_dir = state_dir or scratch_path(spark, f"dedup-{uuid.uuid4().hex}")
    state = cut_lineage(stream_state(spark, path, state_dir, id_col, text_col, digest, bytes_per_trigger))
    table = spark.read.parquet(path)
    rows = _rows(table, id_col, text_col, digest)
    other = cut_lineage(_mismatches(rows, state))

    mine = ["keep_id", "group_size", "kept", "text_sha256"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.col(f"`{c}`") for c in table.columns if c.lower() not in [*mine, "file", "row", "digest", "top", "n"]]
    all_rows = table.select(*carried, digest(text).alias("digest"), sha256(text).alias("text_sha256"),
                            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = all_rows.join(state, "digest")
    if not other.isEmpty():  # digests shared by different texts
        classes = other.groupBy("digest", "text").agg(
            F.max(F.struct("id", "file", "row")).alias("own_top"), F.count(F.lit(1)).alias("own_n"))
        own = other.join(classes, ["digest", "text"]).select("file", "row", "own_top", "own_n")
        moved = other.groupBy("digest").agg(F.count(F.lit(1)).alias("moved"))
        out = out.join(moved, "digest", "left").join(own, ["file", "row"], "left").withColumns({
            "n": F.coalesce("own_n", F.col("n") - F.coalesce("moved", F.lit(0))),
            "top": F.coalesce("own_top", "top")})
    return out.select(
        *carried, F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("top.file")) & (F.col("row") == F.col("top.row"))).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """:func:`dedup_path` for any DataFrame: written once to the shared folder, then streamed from it."""
    path = scratch_path(docs.sparkSession, f"dedup-in-{uuid.uuid4().hex}")
    docs.write.parquet(path)
    return dedup_path(docs.sparkSession, path, id_col, text_col, **options)
