"""8. Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation log holds events (conv_id, seq, msg, kind, role, text): ``open`` starts a message
with its role, ``delta`` appends streamed text, ``edit`` replaces the whole text so far and
``regenerate`` discards it, to be streamed anew. The log is split by message, sorted by ``seq`` and
folded, so a long conversation is spread over many tasks; only its final messages meet, in the one
string asked for. Each message is rendered as ``<|role|>\\n`` + text + ``</s>\\n``; control strings inside
roles and texts are escaped reversibly.

Defined cases: an event repeated in all fields is a redelivery and counts once; null text is
empty; a null or absent role is the empty role; a null conv_id is a conversation of its own; null
``msg`` sorts first; events of equal ``seq`` are ordered by kind, role and text; an empty log gives no
rows; unknown kinds change nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</s>\n"
#: Strings that mark turns here or in other common templates; escaped wherever a text holds them.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CODES = {"%": "%25", "<": "%3C", "[": "%5B", "|": "%7C", "\n": "%0A"}


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape_text(c: Column) -> Column:
    """Escapes ``%`` and the first character of every control string."""
    c = _replace(c, "%", _CODES["%"])
    for s in CONTROL:
        c = _replace(c, s, _CODES[s[0]] + s[1:])
    return c


def escape_role(c: Column) -> Column:
    for ch in ["%", "<", "[", "|", "\n"]:
        c = _replace(c, ch, _CODES[ch])
    return c


def unescape(c: Column) -> Column:
    """Inverse of both escapes: every ``%`` of an escaped string starts a code, ``%25`` goes last."""
    for ch in ["\n", "|", "[", "<", "%"]:
        c = _replace(c, _CODES[ch], ch)
    return c


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log."""
    e = log.select("conv_id", "msg", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    g = e.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("ev"))
    ev = F.col("ev")
    resets = F.filter(F.transform(ev, lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_max(resets), F.lit(0))  # nothing before the last reset counts
    live = F.slice(ev, first + 1, F.greatest(F.size(ev), F.lit(1)))
    text = F.array_join(F.transform(F.filter(live, lambda x: x["kind"].isin("delta", "edit")), lambda x: x["text"]), "")
    opens = F.filter(ev, lambda x: x["kind"] == "open")
    return g.select("conv_id", "msg", F.coalesce(F.get(opens, F.lit(0))["role"], F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): one string per conversation, its turns in ``msg`` order, and
    the spans (start, length, in code points from 0) of the text that ``learn`` turns wrote."""
    m = messages.select("conv_id", "msg", F.concat(F.lit("<|"), escape_role("role"), F.lit("|>\n")).alias("head"),
                        escape_text("text").alias("body"), (F.col("role") == learn).alias("learn"))
    m = m.select("conv_id", F.struct(
        "msg", "learn", F.length("head").alias("h"), F.length("body").alias("b"),
        F.concat("head", "body", F.lit(END)).alias("turn")).alias("t"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        span = F.array(F.struct((acc["at"] + t["h"]).alias("start"), t["b"].alias("length")))
        return F.struct((acc["at"] + t["h"] + t["b"] + len(END)).alias("at"),
                        F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return g.select("conv_id", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
                    F.aggregate("t", zero, step, lambda a: a["spans"]).alias("loss_mask"))


def format_log(log: DataFrame, learn: str = "assistant") -> DataFrame:
    return render(fold(log), learn)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, F.lit(END), -1), lambda p: p.startswith("<|"))
    cut = lambda p: F.instr(p, "|>\n")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring(p, F.lit(3), cut(p) - 3)).alias("role"),
        unescape(F.substring(p, cut(p) + 3, F.length(p))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["length"]))), "")


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that ends in the rows of a (conv_id, turn, role, text) table.

    By (conv_id + turn) mod 3 a message is streamed in three deltas; streamed, discarded and streamed
    again; or streamed in part and then edited. Rows repeated for a turn are messages of their own,
    ordered by role and text."""
    n = F.row_number().over(_same_turn())
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "msg", F.struct("turn", n.alias("n")))
    text, size = F.col("text"), F.length("text")
    third = F.ceil(size / 3).cast("int")
    deltas = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third),
              F.substring(text, 2 * third + 1, size)]
    none = F.lit(None).cast("string")

    def ev(k, kind, role=none, t=none):
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), role.alias("role"), t.alias("text"))

    streamed = [ev(k, "delta", t=d) for k, d in enumerate(deltas, 4)]
    start = [ev(0, "open", role=F.col("role"))]
    way = F.pmod(F.coalesce(F.col("conv_id") + F.col("turn"), F.lit(0)), F.lit(3))
    events = (F.when(way == 0, F.array(*start, *streamed))
              .when(way == 1, F.array(*start, ev(1, "delta", t=deltas[2]), ev(2, "delta", t=F.lit("draft ")),
                                      ev(3, "regenerate"), *streamed))
              .otherwise(F.array(*start, ev(1, "delta", t=deltas[0]), ev(2, "delta", t=F.lit(" teh")),
                                 ev(3, "edit", t=text))))
    e = c.select("conv_id", "msg", F.explode(events).alias("e"))
    return e.select("conv_id", F.struct("msg", "e.k").alias("seq"), "msg", "e.kind", "e.role", "e.text")


def _same_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id", "turn").orderBy("role", "text")
