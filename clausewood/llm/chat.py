"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log has one row per event: conversation, sequence number, turn, kind, role and
text. Of each turn, in the order of the sequence, ``message`` opens a message,
``delta`` appends to the open one, ``edit`` replaces its text, ``regenerate``
empties it so that later deltas fill it anew. The log is partitioned by
(conversation, turn) for the fold and then by conversation for the rendering,
so that streamed deltas never meet in one conversation-wide list.

Template: every turn is ``<|turn|>`` role newline text ``<|end|>``. Inside roles
and texts a backslash is doubled and one is put behind each ``<`` and ``[``, so
neither the template's marks nor other control strings (``</s>``, ``[INST]``) can
occur, and the escape is reversible. A newline in a role is written ``<n>``.

The loss mask holds the place (code points) of each assistant text.

Defined results: null role, text or kind count as empty, empty and ``message``;
a turn whose first event is no message opens one; events of equal conversation,
sequence and turn are ordered by kind, role and text, repeated ones all count;
a null conversation id is a conversation of its own; a sequence number may have any
type that can be ordered, null ones come first; an empty log gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n>"), F.lit("\n")))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, at, role, text): the final messages of a log (conv_id, seq, turn, kind, role, text)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0))
    event = F.struct(F.col("seq"), rank.alias("rank"), kind.alias("kind"), blank("role").alias("role"), blank("text").alias("text"))
    turns = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("log"))
    opens = F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: (i == 1) | (F.element_at("log", i)["kind"] == "message"))
    turns = turns.withColumn("opens", opens)

    def fold(begin: Column, at: Column) -> Column:
        stop = F.coalesce(F.try_element_at("opens", at + F.lit(2)), F.size("log") + 1)
        own = F.slice("log", begin, stop - begin)
        resets = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | F.element_at(own, i)["kind"].isin("edit", "regenerate"))
        last = F.element_at(resets, -1)
        kept = F.slice(own, last, F.size(own) - last + 1)
        text = F.array_join(F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
        return F.struct(F.element_at(own, 1)["seq"].alias("seq"), at.alias("at"), F.element_at(own, 1)["role"].alias("role"), text.alias("text"))

    messages = turns.select("conv_id", "turn", F.explode(F.transform("opens", fold)).alias("m"))
    return messages.select("conv_id", "turn", "m.seq", "m.at", "m.role", "m.text")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): the text of each conversation and the places of its trained texts."""
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "at")]
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = messages.select("conv_id", "seq", "turn", "at", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    own = W.partitionBy("conv_id").orderBy(*order)
    placed = parts.withColumn("n", F.row_number().over(own)).withColumn("before", F.sum(size).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - size)
    mark = F.struct((F.col("n") - 1).alias("turn"), (F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("part")))), lambda x: x["part"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained, mark))).alias("mask"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, raw) pairs of a formatted conversation, the text still escaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    opened = F.transform(parts, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(opened, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), F.substr(p, F.instr(p, F.lit("\n")) + 1).alias("raw")))


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``render``'s output."""
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["raw"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.element_at("turns", (m["turn"] + 1).cast("int"))["raw"], F.lit(1), m["length"].cast("int")))), "")
    back = back.withColumn("said", said).withColumn("loss", loss)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A log from which the rows of finished conversations can be reconstructed.

    A hash of a row's place decides how its text came about: said at once; streamed in
    deltas; written otherwise and edited; or begun otherwise, regenerated and streamed.
    Rows of equal conversation and turn follow each other by role and text.
    """
    tie = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    rows = conversations.select("conv_id", "turn", "role", "text", tie.alias("tie")).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
    third = F.floor(F.col("size") / 3).cast("int")
    begin, middle = F.substr("text", F.lit(1), third), F.substr("text", third + 1, third)
    deltas = [("delta", begin), ("delta", middle), ("delta", F.substr("text", 2 * third + 1, F.col("size")))]
    ways = [
        [("message", F.col("text"))],
        [("message", F.lit("")), *deltas],
        [("message", F.reverse("text")), ("edit", F.col("text"))],
        [("message", F.reverse("text")), ("delta", begin), ("regenerate", F.lit(None)), *deltas],
    ]

    def log(events: list[tuple[str, Column]]) -> Column:
        return F.array(*[F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (F.col("role") if step == 0 else F.lit(None)).cast("string").alias("role"), text.cast("string").alias("text")) for step, (kind, text) in enumerate(events)])

    way = F.pmod(F.xxhash64("conv_id", "turn", "tie"), F.lit(len(ways)))
    logs = log(ways[0])
    for number, events in enumerate(ways[1:], 1):
        logs = F.when(way == number, log(events)).otherwise(logs)
    events = rows.select("conv_id", "turn", "tie", F.explode(logs).alias("e"))
    return events.select("conv_id", F.struct("turn", "tie", F.col("e.step").alias("step")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


#: The added conversation -1.
PROBE = "</s>[INST] ok [/INST]"

#: DuckDB SQL of the query on conversations.
ORACLE = """
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, 8 + length(role) + 1 + length(text) + 7
        + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
