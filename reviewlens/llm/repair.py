"""Conversation structure repair: the cheapest edits that leave ``(s?(ua)+)?`` by role initials.

Rows of a conversation are ordered by (turn, role, text), nulls first.  Edits: K(eep) costs 0, R(erole, to
user or assistant) 1, D(elete) 2, I(nsert an empty user or assistant message, anywhere) 5; a
truncated row that isn't deleted costs 5 more; blank rows and rows whose role and text were seen earlier in the
conversation must be deleted.  Of equally cheap audits the least one in ASCII order is taken.

Rank-convergence Viterbi.  Rows are range-partitioned and sorted, and a conversation is cut into chunks of
at most ``CHUNK`` rows that different tasks solve.  The costs to the end from the four states of the pattern (start, after
s, u, a) are computed backwards; every chunk but the last of its conversation starts from a speculative
vector of zeros.  Fix-up passes hand each chunk the vector of the one after it; a chunk is solved again
only where that vector differs from the one it used by more than a constant, and passes end when no
chunk was.  Choices depend only on differences of costs, so the stitched vectors then give
every chunk's true choices.  Which state a chunk begins in follows from the chunks before it: each maps its
four possible first states to last states, and the maps are composed in rounds of doubled
reach.  No group larger than a chunk is gathered; the last step streams a conversation in order (a digest
of the whole is sequential) and holds one row and the running hash.

Defined cases: null roles and texts are one space; null turns come first and don't count for gaps; a null
conversation id is a conversation of its own; rows of one turn are ordered by role and text; a role that begins with none of
s, u, a can be reroled or deleted; repeated rows are duplicates; a conversation without rows has
an empty audit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import shared

CHUNK = 1024  # rows of a chunk, a power of two
CELLS = 1 << 18  # rows (with padding) that are solved together
BLANKS = " \t\n\x0b\x0c\r"
RANGE_TEXT = 64  # characters of a text that range bounds look at; the sort looks at all

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = 1 << 40
_INITIALS = {"s": 0, "u": 1, "a": 2}  # any other: 3
_PAD = 12
_INSERTED = np.array([2, 2, 3, 2])  # state after an inserted (or reroled) message, by state before it
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by role, state
_FINAL = np.array([0, 2 * INSERT, INSERT, 0])
_EDITS = "DKR"
_OPS = np.array([("I" * i) + e for i in range(3) for e in _EDITS])


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults that depend on conv_id and turn: one in 20 of each of five kinds."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", kind.alias("_kind"), role.alias("role"), text.alias("text")).filter("_kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _conversation(conv):
    """A conversation id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def _ordered(turns: DataFrame) -> DataFrame:
    """k, turn, role, text, at: ``at`` numbers the rows in the order of (k, turn, role, text)."""
    rows = turns.select(_conversation("conv_id").alias("k"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "k", "turn", "role", F.substring("text", 1, RANGE_TEXT))
    return shared.written(dealt.sortWithinPartitions("k", F.asc_nulls_first("turn"), "role", "text")
                          .withColumn("at", F.monotonically_increasing_id()), "turns")


def _chunks(rows: DataFrame) -> DataFrame:
    """k, chunk, num (its place in the conversation), of (how many there are), codes, faults: bounded rows."""
    bare = F.rtrim("text", F.lit(BLANKS))
    light = rows.select(
        "k", "at", F.substring("role", 1, 1).alias("initial"), (F.length(bare) == 0).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("digest"))
    firsts = light.groupBy("k", "digest").agg(F.min("at").alias("at"))
    none = F.lit(None)
    seen = light.select("k", "at", "initial", "blank", "open").unionAll(
        firsts.select("k", "at", none.cast("string"), none.cast("boolean"), none.cast("boolean")))
    shift = CHUNK.bit_length() - 1
    grouped = (seen.withColumn("chunk", F.shiftright("at", shift)).groupBy("k", "chunk")
               .agg(F.sort_array(F.collect_list(F.struct("at", "initial", "blank", "open"))).alias("rows")))

    def code(batches):
        for batch in batches:
            out = []
            for members in batch.column("rows").to_pylist():
                first = {m["at"] for m in members if m["initial"] is None}
                codes, faults = bytearray(), ""
                for m in members:
                    if m["initial"] is not None:
                        fault = "b" if m["blank"] else "d" if m["at"] not in first else "t" if m["open"] else "-"
                        codes.append(3 * _INITIALS.get(m["initial"], 3) + (0 if fault == "-" else 2 if fault == "t" else 1))
                        faults += fault
                out.append((members[0]["at"], bytes(codes), faults))
            first_at, codes, faults = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").cast(pa.string()), batch.column("chunk"), pa.array(first_at, pa.int64()),
                 pa.array(codes, pa.binary()), pa.array(faults, pa.string())], ["k", "chunk", "at", "codes", "faults"])

    coded = shared.written(grouped.mapInArrow(code, "k string, chunk long, at long, codes binary, faults string"), "chunks")
    pieces = (coded.groupBy("k", F.shiftright("chunk", 33 - shift).alias("part"))
              .agg(F.count(F.lit(1)).alias("here"), F.min("chunk").alias("low")))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn(
        "of", F.sum("here").over(Window.partitionBy("k")))
    numbered = coded.withColumn("part", F.shiftright("chunk", 33 - shift)).join(pieces, ["k", "part"])
    return shared.written(numbered.select(
        "k", "at", "codes", "faults", (F.col("base") + F.col("chunk") - F.col("low")).alias("num"), "of"), "chunks")


def solve(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(costs at the start, op and state after each row by state before it) of padded rows of codes.

    ``codes``: (chunks, rows); ``ends``: (chunks, 4) costs after the last row."""
    n, length = codes.shape
    op, after = np.zeros((length, n, 4), np.int8), np.zeros((length, n, 4), np.int8)
    cost, every = ends.astype(np.int64), np.arange(n)[:, None]
    for i in range(length - 1, -1, -1):
        role, fault, pad = codes[:, i] // 3, codes[:, i] % 3, codes[:, i] == _PAD
        extra = np.where(fault == 2, TRUNCATED, np.where(fault == 1, _FAR, 0))[:, None]
        kept = _KEPT[np.minimum(role, 3)]
        ways = np.stack([DELETE + cost, np.where(kept < 0, _FAR, cost[every, np.maximum(kept, 0)] + extra),
                         REROLE + cost[:, _INSERTED] + extra], axis=2)
        to = np.stack([np.broadcast_to(np.arange(4), kept.shape), np.maximum(kept, 0),
                       np.broadcast_to(_INSERTED, kept.shape)], axis=2)
        edited = ways.min(axis=2)
        once = np.minimum(edited, INSERT + edited[:, _INSERTED])
        best = np.minimum(once, INSERT + once[:, _INSERTED])
        # the least audit: D, then I (and what follows it), then K, then R
        delete = ways[:, :, 0] == best
        insert = ~delete & (INSERT + best[:, _INSERTED] == best)
        edit = np.where(delete, 0, np.where(ways[:, :, 1] == best, 1, 2))
        reach = np.take_along_axis(to, edit[:, :, None], 2)[:, :, 0]
        ops, nexts = edit, reach
        for _ in range(2):  # an insertion may be followed by one more
            ops = np.where(insert, 3 + ops[:, _INSERTED], edit)
            nexts = np.where(insert, nexts[:, _INSERTED], reach)
        hold = pad[:, None]
        op[i], after[i] = np.where(hold, -1, ops), np.where(hold, np.arange(4), nexts)
        cost = np.where(hold, cost, best)
    return cost, op, after


def _padded(codes: list[bytes]):
    """(rows of the batch, padded matrix) for groups of chunks of about one length."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    while order:
        length = max(1, len(codes[order[-1]]))
        now, order = order[-max(1, CELLS // length):], order[:-max(1, CELLS // length)]
        matrix = np.full((len(now), length), _PAD, np.int8)
        for r, i in enumerate(now):
            matrix[r, :len(codes[i])] = np.frombuffer(codes[i], np.int8)
        yield np.array(now), matrix


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, 4)


def _starts(chunks: DataFrame) -> DataFrame:
    """``chunks`` (with ``end``, the vector after them) and ``start``, the vector before them less its least cost."""
    def run(batches):
        for batch in batches:
            starts = np.zeros((batch.num_rows, 4), np.int64)
            ends = _vectors(batch.column("end"))
            for at, matrix in _padded(batch.column("codes").to_pylist()):
                cost = solve(matrix, ends[at])[0]
                starts[at] = cost - cost.min(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts.tolist(), pa.list_(pa.int64()))],
                                             [*batch.schema.names, "start"])

    names = ["k", "num", "of", "codes", "end"]
    return chunks.select(*names).mapInArrow(run, "k string, num long, of long, codes binary, end array<long>, start array<long>")


def _last_vector():
    return F.array(*(F.lit(int(c)).cast("long") for c in _FINAL))


def converge(chunks: DataFrame, passes: list[int] | None = None) -> DataFrame:
    """k, num, of, codes and the true ``end`` vector (less its least cost) of each chunk of (k, num, of, codes).

    ``passes`` receives the number of chunks that each fix-up pass solved again."""
    guess = F.when(F.col("num") == F.col("of") - 1, _last_vector()).otherwise(F.array(*[F.lit(0).cast("long")] * 4))
    now = shared.written(_starts(chunks.withColumn("end", guess)), "vectors")
    while True:
        following = now.select("k", (F.col("num") - 1).alias("num"), F.col("start").alias("true_end"))
        met = shared.written(now.join(following, ["k", "num"], "left").withColumn(
            "true_end", F.coalesce("true_end", "end")), "vectors")
        moved = met.filter(F.col("end") != F.col("true_end"))  # vectors less their least cost: by more than a constant
        again = moved.count()
        if passes is not None:
            passes.append(again)
        if not again:
            return now.select("k", "num", "of", "codes", "end")
        same = met.filter(F.col("end") == F.col("true_end")).drop("true_end")
        now = shared.written(same.unionByName(_starts(moved.withColumn("end", F.col("true_end")))), "vectors")


def _first_states(solved: DataFrame, most: int) -> DataFrame:
    """k, num, state: the state that each chunk begins in; ``most``: chunks of the longest conversation."""
    def run(batches):
        for batch in batches:
            maps = np.zeros((batch.num_rows, 4), np.int64)
            ends = _vectors(batch.column("end"))
            for at, matrix in _padded(batch.column("codes").to_pylist()):
                _, _, after = solve(matrix, ends[at])
                state = np.broadcast_to(np.arange(4), (len(at), 4))
                for step in after:
                    state = np.take_along_axis(step, state, 1).astype(np.int64)
                maps[at] = state
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("num"),
                                              pa.array(maps.tolist(), pa.list_(pa.int64()))], ["k", "num", "map"])

    reach = shared.written(solved.select("k", "num", "codes", "end").mapInArrow(run, "k string, num long, map array<long>"), "maps")
    step = 1
    while step < most:
        before = reach.select("k", (F.col("num") + step).alias("num"), F.col("map").alias("first"))
        both = F.transform("first", lambda s: F.get("map", s.cast("int")))
        reach = shared.written(reach.join(before, ["k", "num"], "left").select(
            "k", "num", F.coalesce(both, "map").alias("map")), "maps")
        step *= 2
    return reach.select("k", (F.col("num") + 1).alias("num"), F.get("map", F.lit(0)).alias("state"))


def edits(rows: DataFrame) -> DataFrame:
    """k, at (the chunk's first row), ops (one word of edits for each row, then insertions at the end), faults."""
    chunks = _chunks(rows)
    many = chunks.filter("of > 1")
    most = many.agg(F.max("of")).first()[0] or 0
    zero = F.lit(0).cast("long")
    alone = chunks.filter("of = 1").withColumn("end", _last_vector()).withColumn("state", zero)
    if most:
        solved = converge(many)
        whole = (solved.join(_first_states(solved, most), ["k", "num"], "left")
                 .select("k", "num", "end", F.coalesce("state", zero).alias("state")))
        alone = alone.unionByName(many.join(whole, ["k", "num"]))

    def trace(batches):
        for batch in batches:
            ends, first = _vectors(batch.column("end")), batch.column("state").to_numpy()
            last = (batch.column("num").to_numpy() + 1) == batch.column("of").to_numpy()
            said = [""] * batch.num_rows
            for at, matrix in _padded(batch.column("codes").to_pylist()):
                _, op, after = solve(matrix, ends[at])
                state, path, every = first[at], np.zeros(matrix.shape, np.int8), np.arange(len(at))
                for i in range(matrix.shape[1]):
                    path[:, i] = op[i, every, state]
                    state = after[i, every, state].astype(np.int64)
                for r, i in enumerate(at):
                    words = _OPS[path[r][path[r] >= 0]].tolist()
                    if last[i]:
                        words.append("I" * int(_FINAL[state[r]] // INSERT))
                    said[i] = " ".join(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").cast(pa.string()), batch.column("at"), pa.array(said, pa.string()),
                 batch.column("faults").cast(pa.string())], ["k", "at", "ops", "faults"])

    return (alone.select("k", "at", "num", "of", "codes", "faults", "end", "state")
            .mapInArrow(trace, "k string, at long, ops string, faults string"))


_STEP = ("edit string, turn long, role string, text string, new_role string, fault string")


def steps(turns: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Every edit of every conversation in order, streamed: conv_id, edit (K, R, D, I), turn, role and text of the row
    that it changes, new_role and fault (b, d, t or -).  A conversation begins with a row without edit.

    ``originals``: further conversation ids, which may have no rows left."""
    kind = turns.schema["conv_id"].dataType
    rows = _ordered(turns)
    ids = turns.select("conv_id") if originals is None else turns.select("conv_id").unionAll(
        originals.select(F.col("conv_id").cast(kind)))
    null = F.lit(None)
    openings = ids.distinct().select(_conversation("conv_id").alias("k"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("order"),
                                     "conv_id", *(null.cast(t).alias(c) for c, t in (
                                         ("turn", "long"), ("role", "string"), ("text", "string"), ("ops", "string"), ("faults", "string"))))
    plans = edits(rows).select("k", "at", F.lit(0).alias("order"), null.cast(kind).alias("conv_id"), null.cast("long").alias("turn"),
                               null.cast("string").alias("role"), null.cast("string").alias("text"), "ops", "faults")
    texts = rows.select("k", "at", F.lit(1).alias("order"), null.cast(kind).alias("conv_id"), "turn", "role", "text",
                        null.cast("string").alias("ops"), null.cast("string").alias("faults"))
    together = (openings.unionAll(plans).unionAll(texts).repartition("k").sortWithinPartitions("k", "at", "order")
                .select("at", "order", "conv_id", "turn", "role", "text", "ops", "faults"))

    def run(batches):
        conv, state, ops, faults, place = None, 0, [], "", 0
        for batch in batches:
            out = []

            def inserted(count):
                nonlocal state
                for _ in range(count):
                    state = int(_INSERTED[state])
                    out.append((conv, "I", None, None, None, "user" if state == 2 else "assistant", None))

            for at, order, cid, turn, role, text, words, found in zip(*(c.to_pylist() for c in batch.columns)):
                if at == -1:
                    conv, state = cid, 0
                    out.append((conv, *[None] * 6))
                elif order == 0:
                    ops, faults, place = words.split(" "), found, 0
                    continue
                else:
                    word = ops[place]
                    inserted(len(word) - 1)
                    edit, new = word[-1], role
                    if edit == "R":
                        state = int(_INSERTED[state])
                        new = "user" if state == 2 else "assistant"
                    elif edit == "K":
                        state = int(_KEPT[_INITIALS[role[0]], state])
                    out.append((conv, edit, turn, role, text, None if edit == "D" else new, faults[place]))
                    place += 1
                    if place == len(faults) and len(ops) > place:
                        inserted(len(ops[place]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (
                        batch.schema.field("conv_id").type, *[pa.string()], pa.int64(), *[pa.string()] * 4))],
                    ["conv_id", "edit", "turn", "role", "text", "new_role", "fault"])

    return together.mapInArrow(run, f"conv_id {kind.simpleString()}, {_STEP}")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text of the messages that stay or are inserted, in order within a conversation."""
    return steps(turns).filter("edit IN ('K', 'R', 'I')").select(
        "conv_id", "edit", "turn", F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
_DIGEST = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


class _Digest:
    """Figures of one conversation from its steps in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.low, self.high, self.last = conv, 0, None, None, None
        self.faults, self.illegal, self.cost, self.initial = {"b": 0, "d": 0, "t": 0, "-": 0}, 0, 0, None
        self.audit, self.sha, self.empty = [], hashlib.sha256(), True

    def add(self, edit, turn, role, text, new_role, fault):
        self.audit.append(edit)
        self.cost += _COST[edit] + (TRUNCATED if fault == "t" and edit != "D" else 0)
        if edit != "I":
            if turn is not None:
                self.turns += self.last != turn
                self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.faults[fault] += 1
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        if edit != "D":
            self.sha.update(f"{'' if self.empty else chr(10)}{new_role}:{text or ''}".encode())
            self.empty = False

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *(self.faults[f] for f in "bdt"), self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def digest(walk: DataFrame) -> DataFrame:
    """One row per conversation of ``steps``, streamed in their order."""
    kind = walk.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for conv, edit, *step in zip(*(c.to_pylist() for c in batch.columns)):
                if edit is None:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv)
                else:
                    now.add(edit, *step)
            if out:
                yield batched(out, batch.schema.field("conv_id").type)
            of = batch.schema.field("conv_id").type
        if now is not None:
            yield batched([now.row()], of)

    def batched(out, of):
        types = (of, *[pa.int64()] * 6, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                          ["conv_id", *(c.split()[0] for c in _DIGEST.split(", "))])

    return walk.mapInArrow(run, f"conv_id {kind}, {_DIGEST}")
