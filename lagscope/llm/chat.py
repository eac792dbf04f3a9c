"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events in sequence order:

* ``message``: starts message ``msg`` with a role and a text;
* ``delta``: appends its text to message ``msg``, starting it if need be;
* ``edit``: replaces the text of message ``msg``;
* ``regenerate``: takes back message ``msg`` and every message that had
  started after it; what follows in the log stands in their place, under
  new ids or under the same ones.

Logs are partitioned by conversation and folded into final messages, which
are rendered in order into one text per conversation with a loss mask over
the assistant's texts.

Bounded memory: events are sorted by (conversation, message, sequence) and
folded as a stream, one message at a time; what regenerations take back is
found before, in a stream of the conversations that have any, which holds the
ids of a conversation's standing messages and no text; rendering is a stream
over sorted messages that keeps an offset. A conversation's texts are never
collected: the rendered text is one row per message, with its offset in the
conversation's text.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside a role or a text,
every ``<`` that is followed by any number of backslashes and ``|`` gets one
more backslash, so no control string is left; taking one away restores it. In
roles ``<n|`` stands for a line break, and is itself raised in the same way.

Defined results: a null text or role is empty; an unknown kind counts as
``message``; a null message id makes an event a message of its own. Events
of equal sequence are ordered by kind, role and text; a null sequence number
comes first, a null conversation is a conversation. Repeated events are
applied each time; an edit or regeneration of an unknown message changes
nothing that came before. An empty log gives an empty result. Columns are
taken by name."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

_RAISE = re.compile(r"<(\\*)\|")
_LOWER = re.compile(r"<\\(\\*)\|")
_RAISE_BREAK = re.compile(r"<(\\*)n\|")
_LOWER_BREAK = re.compile(r"<\\(\\*)n\|")
_BREAK = "<n|"
_FIRST = -(1 << 63)


def escape(text: str) -> str:
    return _RAISE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _LOWER.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return _RAISE_BREAK.sub(r"<\\\1n|", escape(role)).replace("\n", _BREAK)


def unescape_role(role: str) -> str:
    return unescape(_LOWER_BREAK.sub(r"<\1n|", role.replace(_BREAK, "\n")))


def fold(events: DataFrame) -> DataFrame:
    """``(conv, at, role, text)``: the final messages of ``events(conv, msg,
    seq, kind, role, text)``; ``conv`` becomes text, ``at`` is the sequence
    number at which a message started."""
    rows = events.select(
        F.col("conv").cast("string").alias("conv"), "msg", F.coalesce("seq", F.lit(_FIRST)).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    # events without an id that are equal in all else share a key and are counted
    content = F.sha2(F.concat(*[x for c in ("kind", "role") for x in (F.length(c), F.lit(":"), F.col(c))], "text"), 256)
    keyed = rows.withColumn("msg", F.coalesce(F.concat(F.lit("m:"), "msg"),
                                              F.concat(F.lit("s:"), "seq", F.lit(":"), content)))
    own = keyed.where(F.col("kind") != "regenerate").unionByName(cuts(keyed))
    streamed = (own.repartition("conv", "msg")
                .sortWithinPartitions("conv", "msg", "seq", "kind", "role", "text"))

    def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for conv, msg, seq, kind, role, text in b[["conv", "msg", "seq", "kind", "role", "text"]].itertuples(
                    index=False, name=None):
                if (conv, msg) != now:
                    if state:
                        out += state.rows()
                    now, state = (conv, msg), None
                if kind == "regenerate":
                    # taken back; what follows under this id is a new message
                    state = None
                elif state is None:
                    # nothing to edit yet
                    state = _Message(conv, seq, role, [text]) if kind != "edit" else None
                elif msg.startswith("s:"):
                    state.times += 1
                elif kind == "delta":
                    state.parts.append(text)
                else:
                    state.parts = [text]
                    state.role = role or state.role
            yield pd.DataFrame(out, columns=["conv", "at", "role", "text"])
        if state:
            yield pd.DataFrame(state.rows(), columns=["conv", "at", "role", "text"])

    return streamed.mapInPandas(messages, "conv string, at long, role string, text string")


def cuts(keyed: DataFrame) -> DataFrame:
    """One ``regenerate`` event for every message that a regeneration takes
    back, at the regeneration's place in the log.

    Only conversations with a regeneration are read, each as a stream in log
    order; texts order events of equal sequence and stay out of the stream."""
    again = keyed.where(F.col("kind") == "regenerate").select(F.col("conv").alias("c")).distinct()
    log = (keyed.join(again, F.col("conv").eqNullSafe(F.col("c")), "left_semi").where(F.col("kind") != "edit")
           .repartition("conv").sortWithinPartitions("conv", "seq", "kind", "role", "text", "msg")
           .select("conv", "msg", "seq", "kind"))

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, standing = object(), {}
        for b in batches:
            out = []
            for conv, msg, seq, kind in b[["conv", "msg", "seq", "kind"]].itertuples(index=False, name=None):
                if conv != now:
                    now, standing = conv, {}   # ids in the order of their start
                if kind != "regenerate":
                    standing.setdefault(msg)
                elif msg in standing:
                    while True:
                        last, _ = standing.popitem()
                        out.append((conv, last, seq))
                        if last == msg:
                            break
            yield pd.DataFrame(out, columns=["conv", "msg", "seq"])

    return log.mapInPandas(taken, "conv string, msg string, seq long").select(
        "conv", "msg", "seq", F.lit("regenerate").alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))


class _Message:
    def __init__(self, conv, at, role, parts):
        self.conv, self.at, self.role, self.parts, self.times = conv, at, role, parts, 1

    def rows(self):
        return [(self.conv, self.at, self.role, "".join(self.parts))] * self.times


def render(messages: DataFrame) -> DataFrame:
    """``(conv, position, start, loss_start, loss_end, segment)``: the pieces
    of every conversation's text in order, with code-point offsets in that
    text; the loss mask covers [loss_start, loss_end), null for other roles.

    Rows come out partitioned by conversation and sorted by position."""
    rows = (messages.select("conv", "at", "role", "text").repartition("conv")
            .sortWithinPartitions("conv", "at", "role", "text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, position, offset = object(), 0, 0
        for b in batches:
            out = []
            for conv, role, text in b[["conv", "role", "text"]].itertuples(index=False, name=None):
                if conv != now:
                    now, position, offset = conv, 0, 0
                head = f"{START}{escape_role(role)}\n"
                body = escape(text)
                segment = f"{head}{body}{END}\n"
                learned = role == LEARNED_ROLE
                a = offset + len(head)
                out.append((conv, position, offset, a if learned else None,
                            a + len(body) if learned else None, segment))
                position, offset = position + 1, offset + len(segment)
            yield pd.DataFrame(out, columns=["conv", "position", "start", "loss_start", "loss_end", "segment"]
                               ).astype({"loss_start": "Int64", "loss_end": "Int64"})

    return rows.mapInPandas(
        pieces, "conv string, position long, start long, loss_start long, loss_end long, segment string")


def read_back(segments: DataFrame) -> DataFrame:
    """``(conv, position, role, text, loss, length)`` parsed from the rendered
    text: ``loss`` is what the mask covers, unescaped (null: nothing)."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, position, start, a, e, s in b.itertuples(index=False, name=None):
                if not s.startswith(START) or not s.endswith(f"{END}\n"):
                    raise ValueError(f"not a turn: conversation {conv}, position {position}")
                role, body = s[len(START):-len(END) - 1].split("\n", 1)
                out.append((conv, position, unescape_role(role), unescape(body),
                            None if pd.isna(a) else unescape(s[int(a) - start:int(e) - start]), len(s)))
            yield pd.DataFrame(out, columns=["conv", "position", "role", "text", "loss", "length"])

    return segments.select("conv", "position", "start", "loss_start", "loss_end", "segment").mapInPandas(
        parse, "conv string, position long, role string, text string, loss string, length long")


def digest(turns: DataFrame) -> DataFrame:
    """Digest of each conversation's turns as ``read_back`` gives them, still
    partitioned and sorted: hashes run along the stream."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            out = []
            for conv, position, role, text, loss, length in b.itertuples(index=False, name=None):
                if position == 0:
                    if now:
                        out.append(done(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss is not None:
                    now[3] += len(loss)
                    now[4].update(loss.encode("utf-8", "surrogatepass"))
                now[5] += length
            yield pd.DataFrame(out, columns=columns)
        if now:
            yield pd.DataFrame([done(now)], columns=columns)

    def done(x):
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    return turns.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")


#: The turns of conversation -1.
PROBE = f"{END}{START}assistant ok"


def as_events(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Each row of ``conversations`` and of conversation -1 as one event."""
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return rows.select(F.col("conv_id").alias("conv"), F.lit(None).cast("string").alias("msg"),
                       F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op10(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    turns = read_back(render(fold(as_events(spark, conversations))))
    return digest(turns).withColumn("conv_id", F.col("conv_id").cast("bigint"))


def _raised(column: str, end: str) -> str:
    return rf"regexp_replace({column}, '<(\\*){end}\|', '<\\\1{end}|', 'g')"


_PIECE = (f"'{START}' || replace({_raised(_raised('role', ''), 'n')}, chr(10), '{_BREAK}') || chr(10) || "
          f"{_raised('text', '')} || '{END}' || chr(10)")
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, '{LEARNED_ROLE}', '{PROBE}')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
         AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
       CAST(sum(length({_PIECE})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
