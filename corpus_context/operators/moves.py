"""What a path holds after chains of moves, without a replay (the core of S2 and S4).

A path's events in seq order are its touches. What it holds follows from the last one: a value, nothing, or, for a
touch that asks, what another touch before it held. Each touch is asked by one later touch at most, so the asking
touches form trees; :func:`settle` answers them by pointer doubling, log2 of the longest chain in joins.

S4 doesn't touch paths event by event: :class:`_Block` sums up a run of events as prefix rewrites, without knowing which paths
there are, and a path is touched once by each run that moves it or what is at it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.session import scratch_path

_FIRST = -(1 << 63)  # before every event
_GONE = (1 << 31) - 1  # after every item of a path
_REFS = 200_000  # a run of events ends when it tells so many folders and files apart
_MERGE = 2_000_000  # or when one move could make so many more
_REWRITES = "root string, block long, src string, dst string, prio int"


def writer(spark, scratch: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table below one scratch folder and reads it back."""
    scratch = scratch or scratch_path(spark, f"moves-{uuid.uuid4().hex}")

    def cut(df: DataFrame) -> DataFrame:
        path = f"{scratch}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return cut


def settle(asking: DataFrame, cut) -> DataFrame:
    """(eid, value) of the touches ``asking`` (eid, src, src_asks, dst, dst_asks): the source's value or, where it has
    none, the target's; a side is a value, null (nothing), or in ``_asks`` the eid of another touch.

    Touches whose answer is at hand take no further part. Of the rest, first those with a value anywhere below their
    source are found, which settles the side each takes; then the values travel up. Two doublings a write."""
    at_hand = F.col("src").isNotNull() | F.col("src_asks").isNull() & F.col("dst_asks").isNull()
    known = asking.select("eid", F.coalesce("src", "dst").alias("value"), at_hand.alias("done"), "src", "src_asks", "dst", "dst_asks")
    known = cut(known)
    if known.where("not done").isEmpty():
        return known.select("eid", "value")
    # whether there is a value anywhere below
    sides = known.where("not done").select("eid", F.explode(F.array("src_asks", "dst_asks")).alias("below")).where("below is not null")
    up = sides.select(F.col("below").alias("eid"), F.col("eid").alias("up"))
    some = cut(known.select("eid", F.col("value").isNotNull().alias("some")).join(up, "eid", "left"))

    def climb(some: DataFrame) -> DataFrame:
        below = some.where("up is not null")
        got = below.groupBy(F.col("up").alias("eid")).agg(F.max("some").alias("got"))
        jump = below.join(some.select(F.col("eid").alias("up"), F.col("up").alias("next")), "up").select("eid", "some", F.col("next").alias("up"))
        return some.where("up is null").unionByName(jump).join(got, "eid", "left").select(
            "eid", (F.col("some") | F.coalesce("got", F.lit(False))).alias("some"), "up")

    if not known.where("not done and src_asks is not null").isEmpty():
        while not some.where("up is not null").isEmpty():
            some = cut(climb(climb(some)))
    full = known.where("not done and src_asks is not null").select("eid", F.col("src_asks").alias("below")).join(
        some.where("some").select(F.col("eid").alias("below")), "below", "left_semi").select("eid", F.lit(True).alias("full"))
    source = F.col("full").isNotNull()
    taken = cut(known.join(full, "eid", "left").select(
        "eid", F.when(F.col("done"), F.col("value")).when(~source, F.col("dst")).alias("value"),
        F.when(F.col("done"), None).when(source, F.col("src_asks")).otherwise(F.col("dst_asks")).alias("asks")))

    def follow(taken: DataFrame) -> DataFrame:
        ahead = taken.select(F.col("eid").alias("asks"), F.col("value").alias("value2"), F.col("asks").alias("asks2"))
        jump = taken.where("asks is not null").join(ahead, "asks").select("eid", F.col("value2").alias("value"), F.col("asks2").alias("asks"))
        return taken.where("asks is null").unionByName(jump)

    while not taken.where("asks is not null").isEmpty():
        taken = cut(follow(follow(taken)))
    return taken.select("eid", "value")


def prefixes(path: Column | str) -> Column:
    """The path and every folder above it ('' and '/' are none)."""
    path = F.col(path) if isinstance(path, str) else path
    every = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))),
                        lambda i: F.call_function("substring_index", path, F.lit("/"), i.cast("int")))
    return F.filter(every, lambda p: p != "")


class _Node:
    """What is at a path after some events. refs: the old paths (each with a '/' at its end) whose content came here, None for a
    file that was created here, the last one first in rank; an old path stands for all at or below it but for kids told apart."""

    __slots__ = ("refs", "kids", "new")

    def __init__(self, refs):
        self.refs, self.kids, self.new = refs, {}, False


class _Block:
    """A run of events of one root as prefix rewrites. The paths before it are unknown; a folder is told apart from its parent
    only when an event names it, so the size follows the events, not the files."""

    def __init__(self, root, first):
        self.root, self.first, self.top, self.made, self.nodes, self.most = root, first, _Node([""]), [], 1, 1

    def full(self, refs: int) -> bool:
        return len(self.made) + self.nodes > refs or self.nodes * self.most > _MERGE

    def kid(self, node: _Node, name: str) -> _Node:
        got = node.kids.get(name)
        if got is None:
            got = node.kids[name] = _Node([x + name + "/" for x in node.refs if x is not None])
            self.made += got.refs
            self.nodes += 1
        return got

    def find(self, names) -> _Node:
        node = self.top
        for name in names:
            node = self.kid(node, name)
        return node

    def take(self, path: str) -> _Node:
        """What is at or below the path, which holds nothing then."""
        *folders, name = path.split("/")
        parent = self.find(folders)
        node = self.kid(parent, name)
        if parent.refs:
            parent.kids[name] = _Node([])
            self.nodes += 1
        else:
            del parent.kids[name]
        return node

    def put(self, node: _Node, path: str) -> None:
        """Over what is at the path."""
        rest = [(self.find(path.split("/")), node)]
        while rest:
            into, node = rest.pop()
            for name in list(node.kids):
                if into.refs or name in into.kids:
                    rest.append((self.kid(into, name), node.kids[name]))
                else:
                    into.kids[name] = node.kids[name]
            if node.refs:
                rest += [(into.kids[name], self.kid(node, name)) for name in list(into.kids) if name not in node.kids]
            if len(into.refs) < len(node.refs):
                node.refs[:0] = into.refs
                into.refs = node.refs
            else:
                into.refs += node.refs
            into.new = into.new or node.new
            self.most = max(self.most, len(into.refs))

    def create(self, path: str) -> None:
        node = self.find(path.split("/"))
        if not node.new:
            node.refs.insert(0, None)
            node.new = True

    def apply(self, events) -> None:
        """Events of one seq: all leave before one arrives."""
        arriving = []
        for _, _, action, src, dst in events:
            if action == "created":
                self.create(src)
            elif action == "moved":
                arriving.append((self.take(src), dst))
            else:
                self.take(src)
        for node, dst in arriving:
            self.put(node, dst)

    def rewrites(self) -> pa.RecordBatch:
        """(src, dst, prio): what was at or below src, unless a longer src says otherwise, is at dst now, if anywhere, and
        counts there before greater prios; without src: a file created at dst. What stays where it was alone is left out."""
        rows, at = [], {}
        rest = [("", self.top)]
        while rest:
            path, node = rest.pop()
            created = False
            alone = node.refs == [path]
            for prio, x in enumerate(reversed(node.refs)):
                if x is not None:
                    at[x] = path, prio, alone
                elif not created:
                    rows.append((None, path[:-1], prio))
                    created = True
            rest += [(path + name + "/", kid) for name, kid in node.kids.items()]
        told = {"": False}
        for x in self.made:  # a folder before what is below it
            path, prio, alone = at.get(x, (None, None, False))
            told[x] = not alone or told[x[:x.rfind("/", 0, -1) + 1]]
            if told[x]:
                rows.append((x[:-1], None if path is None else path[:-1], prio))
        src, dst, prio = zip(*rows) if rows else ((), (), ())
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([self.root] * n, pa.string()), pa.array([self.first] * n, pa.int64()), pa.array(src, pa.string()),
                                           pa.array(dst, pa.string()), pa.array(prio, pa.int32())], ["root", "block", "src", "dst", "prio"])


def _blocks(batches, refs):
    block = None
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("root", "seq", "action", "src_path", "dst_path"))))
    for (root, seq), events in groupby(rows, key=lambda r: r[:2]):
        if block is None or block.root != root or block.full(refs):
            if block is not None:
                yield block.rewrites()
            block = _Block(root, seq)
        block.apply(events)
    if block is not None:
        yield block.rewrites()


def rewrites(events: DataFrame, refs: int = _REFS) -> DataFrame:
    """Runs of events(root, seq, action, src_path, dst_path, event) as prefix rewrites (see :meth:`_Block.rewrites`); block, the
    run's first seq, orders the runs of a root."""
    x = events.repartitionByRange("root", "seq").sortWithinPartitions("root", "seq", "event")
    return x.select("root", "seq", "action", "src_path", "dst_path").mapInArrow(partial(_blocks, refs=refs), _REWRITES)


def _images(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """(root, path, block, to, prio): where the runs after ``since`` take each path, by the longest src it is at or below."""
    above = F.when(F.startswith("path", F.lit("/")) | (F.col("path") == ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    at = paths.select("root", "path", "since", F.explode(F.concat(above, prefixes("path"))).alias("src"))
    best = at.join(moves, ["root", "src"]).where("block > since").groupBy("root", "path", "block").agg(
        F.max_by(F.struct("src", "dst", "prio"), F.length("src")).alias("m"))
    return best.select("root", "path", "block", F.concat("m.dst", F.expr("substr(path, length(m.src) + 1)")).alias("to"), "m.prio")


def reachable(births: DataFrame, moves: DataFrame, cut) -> DataFrame:
    """(root, path, since): every path at which a birth (root, path, block) can be after some runs' moves (root, block, src, dst,
    prio) that come after it, and the first block from which on. Rounds: the most runs in a row that lead to a new path."""
    since = births.groupBy("root", "path").agg(F.min("block").alias("since"))
    front = cut(since)
    found = front
    while True:
        moved = _images(front, moves).where("to is not null").groupBy("root", F.col("to").alias("path")).agg(F.min("block").alias("since"))
        front = cut(moved.join(found.withColumnRenamed("since", "before"), ["root", "path"], "left").where(
            "before is null or since < before").drop("before"))
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front).groupBy("root", "path").agg(F.min("since").alias("since")))


def apply_events_keep_selection(items: DataFrame, sel: DataFrame, events: DataFrame, refs: int = _REFS) -> DataFrame:
    """The files after the events and whether each is selected -> (root, path, selected).

    items(root, path) are the files before them, sel(root, path) the selected ones. created adds an unselected file and
    leaves a present one as it is; deleted removes the path and everything below; moved takes the path and everything below
    along, with their selection, over what is at the target. A move without a target, onto itself or into itself does
    nothing; modified never does.

    Runs of events in seq order become prefix rewrites first. The paths that can ever be reached are found next, then every
    run touches those of them that it moves, removes or writes over: after it a path holds what its first source held before,
    else what the next one did. These trees are settled by pointer doubling."""
    spark = items.sparkSession
    cut = writer(spark)
    act = F.col("action")
    inside = F.col("dst_path").eqNullSafe(F.col("src_path")) | F.startswith("dst_path", F.concat("src_path", F.lit("/")))
    leaves = (F.col("root").isNotNull() & F.col("seq").isNotNull() & (F.col("src_path") != "")
              & ((act == "deleted") | (act == "moved") & F.col("dst_path").isNotNull() & ~inside))
    e = events.where(((act == "created") | leaves) & F.col("src_path").isNotNull())
    e = cut(e.select("root", F.greatest(F.col("seq").cast("long"), F.lit(_FIRST + 1)).alias("seq"), "action", "src_path", "dst_path",
                     F.monotonically_increasing_id().alias("event")))
    chosen = sel.select("root", "path").distinct().withColumn("held", F.lit(1))
    base = cut(items.select("root", "path").distinct().join(chosen, ["root", "path"], "left").select(
        "root", "path", F.lit(_FIRST).cast("long").alias("block"), F.coalesce("held", F.lit(0)).alias("held")))
    runs = cut(rewrites(e, refs))
    created = runs.where("src is null").select("root", F.col("dst").alias("path"), "block", "prio")
    moves = runs.where("src is not null")
    paths = reachable(base.select("root", "path", "block").unionByName(created.drop("prio")), moves, cut)

    leaving = cut(_images(paths, moves))
    none = F.lit(None)

    def touch(rows, path, prio, kind, held=none, origin=none):
        return rows.select("root", F.col(path).alias("path"), "block", prio.cast("int").alias("prio"), F.lit(kind).alias("kind"),
                           held.cast("int").alias("held"), origin.cast("string").alias("origin"))

    touches = touch(base, "path", F.lit(0), "present", F.col("held"))
    touches = touches.unionByName(touch(leaving.where("to is not null"), "to", F.col("prio"), "in", origin=F.col("path")))
    touches = touches.unionByName(touch(created, "path", F.col("prio"), "created")).unionByName(touch(leaving, "path", F.lit(_GONE), "gone"))
    touches = cut(touches.withColumn("eid", F.monotonically_increasing_id()))
    own = Window.partitionBy("root", "path", "block").orderBy("prio")
    t = cut(touches.withColumns({"head": F.row_number().over(own) == 1, "next": F.when(F.lead("kind").over(own) != "gone", F.lead("eid").over(own))}))
    w = Window.partitionBy("root", "path").orderBy("block")
    heads = cut(t.where("head").select("root", "path", "block", "kind", "held", "eid", F.lag("held").over(w).alias("before"),
                                       F.lead("eid").over(w).isNull().alias("last"),
                                       F.when(F.lag("kind").over(w).isin("in", "created"), F.lag("eid").over(w)).alias("asks")))
    source = heads.select("root", "block", F.col("path").alias("origin"), F.col("before").alias("src"), F.col("asks").alias("src_asks"))
    moved_in = t.where("kind = 'in'").join(source, ["root", "block", "origin"]).select(
        "eid", "src", "src_asks", none.cast("int").alias("dst"), F.col("next").alias("dst_asks"))
    new = t.where("kind = 'created'").select("eid", F.lit(0).alias("src"), none.cast("long").alias("src_asks"), none.cast("int").alias("dst"),
                                             none.cast("long").alias("dst_asks"))
    answers = settle(moved_in.unionByName(new), cut)
    last = heads.where("last")
    after = last.where("kind = 'present'").select("root", "path", F.col("held").alias("value")).unionByName(
        last.where("kind in ('in', 'created')").join(answers, "eid").select("root", "path", "value"))
    return after.where("value is not null").select("root", "path", (F.col("value") == 1).alias("selected"))
