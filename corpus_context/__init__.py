"""corpus_context: token-budgeted text contexts from large file corpora, on Spark.

Tables in, tables out. Every operator takes and returns DataFrames; the
root / workspace / context is always a column, so one job serves many
workspaces at once.
"""

from corpus_context.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
