"""Tries and repairs of conversations against plain Python, and the dynamic program against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import conversation_repair as C
from tessera.llm.conversation_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in in_order(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(donor, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    out = set()
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in held if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(held), len(path), parent, len(held), len(children), len(leaves), saved, sha(",".join(map(str, ends)))))
    return out


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    found = [tuple(r[c] for c in names) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def some_conversations(seed, convs=40, longest=14):
    rng, rows = random.Random(seed), []
    words = ["a", "bb", "", "Straße.", "ja!", "no?", "well", None, "  ", "x."]
    for c in range(-7, convs):
        for t in range(rng.randrange(longest)):
            turn = rng.choice([t, t, t, None, 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice(words)))
    rows += rows[5:9] + [(None, 1, "user", "lost"), (None, 1, "user", "lost.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, seed):
    rows = some_conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS node", "text AS digest", "1 AS length", "2 AS place").repartition(5)
    assert trie_rows(prefix_trie(df)) == plain_trie(rows)


def test_trie_of_equal_conversations_goes_to_their_depth(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(25) for t in range(12)]
    found = trie_rows(prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert found == plain_trie(rows)
    assert max(r[1] for r in found) == 12


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(10, t % 700, "user", f"t{t}") for t in range(1500)]
    assert trie_rows(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == {
        *((10, d, None if d == 0 else 10, 1, int(d < 1500), 1, 0, sha("10" if d == 1500 else "")) for d in range(1501))
    }
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = [(1, 0, "user", "only"), (6, 0, "user", "only")]  # both take over more turns than they have, of conversations that are not there
    assert trie_rows(prefix_trie(spark.createDataFrame(turnless, SCHEMA))) == plain_trie(turnless)


# -- repair ---------------------------------------------------------------------------


def cheapest(turns):
    """(cost, edits, what is left) by a best-first search over all edits; turns are (initial, must go, truncated)."""
    into = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(turns) and state in (0, 3):
            return cost, audit
        for role in "ua":
            if role in into[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, into[state][role]))
        if at < len(turns):
            initial, must, cut = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if not must:
                if initial in into[state]:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, into[state][initial]))
                for role in "ua":
                    if role in into[state]:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, into[state][role]))
    raise AssertionError


def coded(turns):
    role = {"s": 1, "u": 2, "a": 3}
    return bytes(role.get(i, 0) | (C.BLANK if must else C.CUT if cut else 0) for i, must, cut in turns)


def random_turns(rng, n):
    return [(rng.choice("suaua?"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_program_equals_search():
    rng = random.Random(3)
    every = [random_turns(rng, rng.randrange(14)) for _ in range(1500)]
    costs, audits = C.solve([coded(t) for t in every])
    for turns, cost, audit in zip(every, costs, audits):
        assert (cost, audit) == cheapest(turns), turns


def test_segments_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        whole = random_turns(rng, rng.randrange(1, 60))
        size = rng.randrange(1, 9)
        parts = [coded(whole[i : i + size]) for i in range(0, len(whole), size)]
        through = C.crossings(parts)
        ending, endings = C.relaxed(C.ENDING.astype(np.int64)), []
        for m in through[::-1]:
            endings.insert(0, ending)
            ending = np.minimum(C.NEVER, (m + ending).min(axis=1))
        states, audits = C.traced(parts, np.array(endings), np.arange(len(parts)) == len(parts) - 1)
        state, told = 0, ""
        for k in range(len(parts)):
            told += audits[k][state]
            state = states[k, state]
        costs, alone = C.solve([coded(whole)])
        assert (told, C.relaxed(C.ENDING.astype(np.int64))[0] if not parts else ending[0]) == (alone[0], costs[0])


def plain_repair(rows):
    convs = {c for c, *_ in rows}
    after = {c: [] for c in convs}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        row = (turn, "user" if kind == 4 else role, text)
        after[conv] += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    out = set()
    for conv, own in after.items():
        own, seen, turns, counts = in_order(own), set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(turns)
        known = {t for t, *_ in own if t is not None}
        lines, at = [], 0
        for edit in audit:
            turn, role, text = own[at] if at < len(own) and edit != "I" else (None, None, "")
            at += edit != "I"
            if edit == "K":
                lines.append((role, text))
            elif edit in "IR":
                lines.append(("assistant" if lines and lines[-1][0][0] == "u" else "user", text))
        told = sha("\n".join(f"{r}:{t}" for r, t in lines))
        out.add((conv, max(known) - min(known) + 1 - len(known) if known else 0, *counts.values(), illegal, cost, audit, told))
    return out


def repair_rows(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = [tuple(r[c] for c in names) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("segment", [1024, 4])
def test_repair_equals_plain_python(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = some_conversations(5, 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS place", "text AS digest", "role AS audit", "1 AS head").repartition(5)
    assert repair_rows(C.repair_conversations(df)) == plain_repair(rows)


def test_repair_of_a_long_conversation_and_of_none(spark):
    rng = random.Random(6)
    rows = [(3, t, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", f"t{t}!", f"t{t}"])) for t in range(3000)]
    assert repair_rows(C.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == plain_repair(rows)
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
