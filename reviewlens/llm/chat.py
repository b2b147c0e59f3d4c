"""Chat formatting from an event log.

A log row is (conv_id, message, seq, kind, role, text).  Rows of a conversation are ordered
by seq; ``start`` opens a message with its role, ``delta`` appends, ``edit`` replaces the
text, ``regenerate`` drops the text so far.  The fold keeps, for each message, what follows
its last edit or regeneration.  Messages are folded by (conv_id, message), so a long
conversation is spread over tasks.

Each turn is rendered as ``<s>[role] text </s>``.  Inside roles and texts ``\\``, ``<``,
``[`` and ``]`` become ``\\\\``, ``\\l``, ``\\b`` and ``\\e``, so no mark can occur there, and
unescaping is exact.  The loss mask covers the escaped text of assistant turns.

Defined cases: null roles and texts are empty; a null conversation id is a conversation of
its own; several rows of one turn are several messages ordered by (turn, role, text);
identical rows each count; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import shared

OPEN, MIDDLE, CLOSE = "<s>[", "] ", " </s>"
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
_BACK = {"\\": "\\", "l": "<", "b": "[", "e": "]"}
_TURN = re.compile(r"<s>\[([^\]]*)\] ([^<]*) </s>")
LEARNED_ROLE = "assistant"
PIECE = 2_000
RANGE_TEXT = 64  # characters of a text that range bounds look at; the sort looks at all


def escape(c: Column) -> Column:
    for plain, marked in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(marked))
    return c


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S) if "\\" in text else text


def events_from_turns(turns: DataFrame) -> DataFrame:
    """The log that streaming each turn would leave: a start, then deltas of PIECE characters.

    Rows are dealt by ranges of (conv_id, turn, role, first characters) and sorted with their whole texts, so a row's
    number is its place in (turn, role, text) order."""
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, RANGE_TEXT))
    messages = shared.written(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn(
        "message", F.struct("turn", "role", F.monotonically_increasing_id().alias("place"))), "messages")
    deltas = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))),
        lambda k: F.struct((k + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"),
                           F.substring("text", k * PIECE + 1, F.lit(PIECE)).alias("text")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")))
    return (messages.select("conv_id", "message", "role", F.explode(F.concat(start, deltas)).alias("e"))
            .select("conv_id", "message", "role", "e.*"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text."""
    key = ["conv_id", "message"]
    reset = F.max(F.when(F.col("kind").isin("start", "edit", "regenerate"), F.col("seq"))).over(
        Window.partitionBy(*key))
    text = F.coalesce("text", F.lit(""))
    kept = log.withColumn("_reset", reset).withColumn(
        "_part", F.when(F.col("kind").isin("delta", "edit")
                        & (F.col("seq") >= F.coalesce("_reset", F.col("seq"))), text))
    return kept.groupBy(*key).agg(
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("seq", F.col("_part"))))),
            lambda x: x["_part"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, formatted, loss_start, loss_length (characters of ``formatted``)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    learned = F.col("role") == LEARNED_ROLE
    return messages.select(
        "conv_id", "message",
        F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE)).alias("formatted"),
        F.when(learned, F.length(role) + len(OPEN) + len(MIDDLE)).alias("loss_start"),
        F.when(learned, F.length(text)).alias("loss_length"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from the formatted text in its order.

    Rows are streamed in (conv_id, message) order: a task holds one turn and two running
    hashes, however long a conversation is.
    """
    def run(batches):
        now, state, out = object(), None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]
            for conv, formatted, start, size in zip(*columns):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *_closed(state)))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _TURN.findall(formatted):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if size is not None:
                    learned = unescape(formatted[start:start + size])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if out:
                yield _digests(out)
                out = []
        if state is not None:
            yield _digests([(now, *_closed(state))])

    return (rendered.repartition("conv_id").sortWithinPartitions("conv_id", "message")
            .select("conv_id", "formatted", "loss_start", "loss_length")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))


def _closed(state):
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)
