"""Conversation repair against a shortest path over audits, with chunks of any size."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, messages) by Dijkstra over (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, s, said = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit, list(said)
        if (i, s) in done:
            continue
        done.add((i, s))
        to = NEXT[s]
        name = "user" if to == 2 else "assistant"
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*said, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, said))
            if faults[i] in "t-":
                more = 5 if faults[i] == "t" else 0
                if (s, role[:1]) in KEEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[s, role[:1]], (*said, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*said, f"{name}:{text}")))


def brute(rows):
    """Digest by conversation of rows (conv_id, turn, role, text)."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, members in by.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = faults_of(members)
        cost, audit, said = cheapest(members, faults)
        turns = {t for t, _, _ in members if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(members)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def talk(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            if rng.random() < 0.6:
                role = ["user", "assistant"][turn % 2]
            text = rng.choice([f"Text {c} {turn}.", "Same?", "cut off", " ", "", None, "two\nlines! \t", "é…", "ok.\n"])
            rows.append((c, None if rng.random() < 0.05 else turn + (turn > 5) * rng.randrange(2), role, text))
    return rows + [(500, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(400)] + [
        (501, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"x{t}.", f"x{t}", "again."])) for t in range(300)] + [
        (502, None, "user", "same.")] * 40 + [(503, 1, "system", "z" * 200_000 + str(t)) for t in range(9)]


SCHEMA = "conv_id long, turn long, role string, text string, k string, at int, ops string"
NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def answers(frame):
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in frame.collect()}


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (2, 4), (3, 16)])
def test_equals_shortest_path(spark, monkeypatch, seed, chunk):
    from reviewlens.llm import repair
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = talk(seed)
    turns = spark.createDataFrame([(*r, "c", 0, "K") for r in rows], SCHEMA).repartition(5)
    assert answers(repair.digest(repair.steps(turns))) == brute(rows)


def test_damage_and_conversations_without_rows(spark):
    from reviewlens.llm import repair
    rows = talk(4)
    gone = [(c, 0, "user", "all.") for c in range(9000, 9060) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    turns = spark.createDataFrame([(*r, "c", 0, "K") for r in rows + gone], SCHEMA)
    want = brute(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in {r[0] for r in rows + gone}:
        want.setdefault(conv, empty)
    assert answers(repair.digest(repair.steps(repair.damage(turns), turns))) == want
    assert all(want[r[0]] == empty for r in gone)


def test_repaired_rows(spark):
    from reviewlens.llm import repair
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Yes."), (1, 3, "user", "Hi."), (1, 4, "assistant", "A"), (2, 1, "assistant", "Z.")]
    got = [tuple(r) for r in repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert [r for r in got if r[0] == 1] == [(1, "K", 1, "user", "Hi."), (1, "R", 2, "assistant", "Yes.")]
    assert [r for r in got if r[0] == 2] == []


def test_fix_up_passes_stop_when_vectors_differ_by_constants(spark):
    """Speculative vectors converge to those of one backward pass over the whole conversation."""
    from reviewlens.llm import repair
    rng = np.random.default_rng(5)
    for codes in (rng.choice([3, 6, 0, 9], 600), np.tile([3, 6], 300), rng.integers(0, 12, 600)):
        pieces = [codes[i:i + 20].astype(np.int8).tobytes() for i in range(0, 600, 20)]
        chunks = spark.createDataFrame([("=1", i, len(pieces), p) for i, p in enumerate(pieces)], "k string, num long, of long, codes binary")
        passes = []
        got = {r.num: r.end for r in repair.converge(chunks, passes).collect()}
        for i in range(len(pieces)):
            after = codes[(i + 1) * 20:][None].astype(np.int8)
            true = repair.solve(after, repair._FINAL[None])[0][0] if after.size else repair._FINAL
            assert got[i] == (true - true.min()).tolist()
        assert passes[-1] == 0 and len(passes) < len(pieces) and sum(passes) < 3 * len(pieces)


def test_empty(spark):
    from reviewlens.llm import repair
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digest(repair.steps(none)).collect() == [] and repair.repaired(none).collect() == []


def test_first_states_reach_over_many_chunks(spark):
    from reviewlens.llm import repair
    codes = [3, 6] * 35 + [3]
    chunks = spark.createDataFrame([("=1", i, 71, bytes([c])) for i, c in enumerate(codes)], "k string, num long, of long, codes binary")
    states = {r.num: r.state for r in repair._first_states(repair.converge(chunks), 71).collect()}
    assert [states[i] for i in range(1, 71)] == [2 if i % 2 else 3 for i in range(1, 71)]
