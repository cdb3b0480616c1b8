r"""Chat formatting from event logs, with DataFrame functions only.

An event is (conversation, sequence, message, kind, role, text). Folding a message's events in sequence order: ``start``
and ``edit`` set its role and text, ``regenerate`` empties its text, ``delta`` appends. What a message is in the end is
therefore the texts from its last start, edit or regenerate on.

A turn is rendered as ``### role: text</turn>\n``. Inside texts ``\`` becomes ``\b``, ``</turn>`` becomes ``\e`` and ``###``
becomes ``\h``; inside roles ``:`` becomes ``\c`` as well. No escaped text holds a mark, and each backslash begins a code,
so reading is exact. The loss mask has, for each assistant turn, its number and the place of its text within that turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
CODES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
TURN = r"(?s)^### (.*?): (.*)$"


def escape(c: Column, codes=CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


ROLE_CODES = (*CODES, (":", "\\c"))


def fold(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, message, kind, role, text) -> (conv_id, message, role, text).

    Null kinds count as delta, null texts as empty; of events with one sequence number the order is kind, role, text. A
    message whose events carry no role has the empty one. Null conversations are one conversation.
    """
    e = F.struct("seq", "kind", "role", "text")
    reset = F.when(F.col("kind").isin("start", "edit", "regenerate"), F.col("seq"))
    grouped = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(e)).alias("events"), F.max(reset).alias("last"))
    live = F.filter("events", lambda x: F.col("last").isNull() | (x["seq"] >= F.col("last")))
    roles = F.filter(F.transform("events", lambda x: x["role"]), lambda x: x.isNotNull())
    return grouped.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, message, role, text) -> (conv_id, formatted, mask): a row per conversation. mask: turn from 0,
    start from 0 within the turn and length, in code points, of each assistant text."""
    head = F.concat(F.lit("### "), escape(F.col("role"), ROLE_CODES), F.lit(": "))
    body = escape(F.col("text"))
    turn = F.struct("message", F.concat(head, body, F.lit(END)).alias("turn"), (F.col("role") == "assistant").alias("loss"), F.length(head).alias("start"), F.length(body).alias("length"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss")))
    mask = F.transform(F.filter(numbered, lambda t: t["loss"]), lambda t: F.struct(t["turn"], t["start"], t["length"]))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted) from rendered text and mask: the turns' roles and texts, the texts under the mask."""
    parts = formatted.select("conv_id", "formatted", "mask", F.split("formatted", "</turn>\n", -1).alias("all")).withColumn("parts", F.slice("all", F.lit(1), F.size("all") - 1))
    role = lambda s: unescape(F.regexp_extract(s, TURN, 1), ROLE_CODES)
    text = lambda s: unescape(F.regexp_extract(s, TURN, 2))
    turns = F.transform("parts", lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))
    losses = F.transform("mask", lambda m: unescape(F.substr(F.get(F.col("parts"), m["turn"]), m["start"] + 1, m["length"])))
    return parts.select("conv_id", turns.alias("turns"), losses.alias("losses"), "formatted")


def log_of(rows: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text): a start, a first draft that a regenerate
    discards, then the text in two deltas. Rows of one turn are ordered by role, then text; repeated rows stay apart."""
    slim = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda j, kind, role, text: F.struct((F.col("message") * 8 + j).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    events = F.array(
        event(0, "start", F.col("role"), F.lit("")), event(1, "delta", none, F.lit("draft")), event(2, "regenerate", none, none),
        event(3, "delta", none, F.substr("text", F.lit(1), half)), event(4, "delta", none, F.substr("text", half + 1)),
    )
    return slim.select("conv_id", "message", F.inline(events))


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_turns(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> (conv_id, formatted, mask) through the event log. Null text and role: empty.
    An empty table gives no row; other columns, whatever their names, are not read."""
    return render(fold(log_of(rows)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h') || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
