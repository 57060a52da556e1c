"""4. URL filter by a temporal list join (DataFrame functions only).

List entries are dated changes (list, verdict, key, added/removed, at). Per (list, key) they become
validity intervals [from, to); every capture is evaluated against the entries that were active when
it was fetched. A capture looks up its host, every parent domain and host + first path segment; the
most specific key that is active decides, ``allow`` before ``block`` on the same key.

Intervals are cut at month borders and joined on (key, month), so one host's captures spread over
the months (and, as an ordinary equi-join, over AQE's splits), and a capture meets only the
intervals of its own month.

Defined cases: a null or hostless URL, or a null fetch time, matches nothing and passes; a repeated
``added`` continues the interval, a ``removed`` without ``added`` does nothing; of changes with equal
time the removal comes last; an interval of no length is void; a null key or time voids an entry;
an empty list passes all; repeated captures are evaluated each; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.llm.common import with_key


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)),
                            r"\.$", "")


def keys_of(url: Column) -> Column:
    """Lookup keys, the most specific first: host/segment, host, parent domains of two labels or more."""
    h = host(url)
    seg = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda i: F.array_join(F.slice(labels, i, n), "."))
    paths = F.when(seg != "", F.array(F.concat(h, F.lit("/"), seg))).otherwise(F.array().cast("array<string>"))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.concat(paths, hosts))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, verdict, key, from, to) of dated changes (list, verdict, key, action, at); to is null
    while the entry is active."""
    w = Window.partitionBy("list", "verdict", "key").orderBy("at", "action")  # 'added' before 'removed'
    c = changes.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("added", "removed"))
    edge = c.withColumn("before", F.lag("action").over(w)).where(
        (F.col("action") != F.coalesce("before", F.lit("removed"))))
    i = edge.withColumn("to", F.lead("at").over(w)).where(F.col("action") == "added")
    return i.where(F.col("to").isNull() | (F.col("to") > F.col("at"))).select(
        "list", "verdict", F.lower("key").alias("key"), F.col("at").alias("from"), "to")


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def evaluate(captures: DataFrame, changes: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, verdict, matched_key, matched_list and n_active
    (entries active at fetch time on any of its keys)."""
    captures = with_key(captures, id_col)
    horizon = F.lit(captures.agg(F.max(_month(F.col(at_col)))).first()[0]).cast("int")  # open intervals reach so far
    last = F.least(F.coalesce(_month(F.col("to")), horizon), horizon)
    first = _month(F.col("from"))
    iv = intervals(changes).where(last >= first).withColumn("month", F.explode(F.sequence(first, last)))
    look = captures.select(F.col("_key").alias("_id"), F.col(at_col).alias("_at"),
                           F.posexplode(keys_of(F.col(url_col))).alias("rank", "key")).withColumn("month", _month(F.col("_at")))
    hit = look.join(iv, ["key", "month"]).where(
        (F.col("_at") >= F.col("from")) & (F.col("to").isNull() | (F.col("_at") < F.col("to"))))
    best = hit.groupBy("_id").agg(F.min(F.struct("rank", "verdict", "list", "key")).alias("b"),
                                  F.count(F.lit(1)).alias("n_active"))
    mine = ["blocked", "verdict", "matched_key", "matched_list", "n_active"]
    kept = captures.select(*[f"`{c}`" for c in captures.columns if c.lower() not in [*mine, "_id", "b"]])
    return kept.join(best, kept["_key"] == best["_id"], "left").select(
        *[f"`{c}`" for c in kept.columns if c != "_key"], F.coalesce(F.col("b.verdict") == "block", F.lit(False)).alias("blocked"),
        F.col("b.verdict").alias("verdict"), F.col("b.key").alias("matched_key"), F.col("b.list").alias("matched_list"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"))
