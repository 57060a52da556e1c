"""Fixed logical schemas of the engine's tables."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("content", T.BinaryType()),
])

ITEMS = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("token_count", T.LongType()),
    T.StructField("strategy", T.StringType()),
])

SCAN_SETTINGS = T.StructType([
    T.StructField("include_subfolders", T.BooleanType()),
    T.StructField("ignore_folders", T.ArrayType(T.StringType())),
    T.StructField("live_watcher", T.BooleanType()),
])

GROUP = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("checked_paths", T.ArrayType(T.StringType())),
    T.StructField("last_updated", T.DoubleType()),
])

WORKSPACE = T.StructType([
    T.StructField("folder_path", T.StringType()),
    T.StructField("scan_settings", SCAN_SETTINGS),
    T.StructField("instructions", T.StringType()),
    T.StructField("active_selection_group", T.StringType()),
    T.StructField("selection_groups", T.MapType(T.StringType(), GROUP)),
    T.StructField("use_local_templates", T.BooleanType()),
    T.StructField("local_custom_instructions", T.MapType(T.StringType(), T.StringType())),
])

WORKSPACES = T.StructType([T.StructField("workspace", T.StringType())] + WORKSPACE.fields)

SELECTIONS = T.StructType([
    T.StructField("workspace", T.StringType()),
    T.StructField("group_name", T.StringType()),
    T.StructField("path", T.StringType()),
])

SELECTION_GROUPS = T.StructType([
    T.StructField("workspace", T.StringType()),
    T.StructField("group_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("last_updated", T.TimestampType()),
])

TEMPLATES = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("workspace", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("text", T.StringType()),
])

FS_EVENTS = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("action", T.StringType()),
    T.StructField("src_path", T.StringType()),
    T.StructField("dst_path", T.StringType()),
    T.StructField("tokens", T.LongType()),
])

TOKEN_CACHE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("tokens", T.LongType()),
])

CHUNKS = T.StructType([
    T.StructField("context_id", T.StringType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("tokens", T.LongType()),
    T.StructField("chars", T.LongType()),
    T.StructField("n_files", T.LongType()),
    T.StructField("text", T.StringType()),
])
