"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from plumbline.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, n int, blocks string, behind string"  # names that are used inside, too


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def plain(rows, damaged=True):
    """By conversation: what `repaired` gives, worked out row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(part, text)
            own += [(turn, "user" if part == 4 else role, text)] * {0: 0, 3: 2}.get(part, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(i, state, inserted=0):
            """Cheapest way from row i on: cost, audit, repaired rows."""
            ways = [(0, "", ())] if i == len(own) and state in (0, 3) else []
            turn = 3 if state == 2 else 2
            if inserted < 2:
                cost, audit, left = best(i, turn, inserted + 1)
                ways.append((cost + 3, "I" + audit, (("user:", "assistant:")[turn - 2], *left)))
            if i < len(own):
                _, role, text = own[i]
                cost, audit, left = best(i + 1, state)
                ways.append((cost + 4, "D" + audit, left))
                if faults[i] not in ("b", "d"):
                    more = 3 * (faults[i] == "t")
                    cost, audit, left = best(i + 1, turn)
                    ways.append((cost + 3 + more, "R" + audit, (("user:", "assistant:")[turn - 2] + text, *left)))
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                    if to:
                        cost, audit, left = best(i + 1, to)
                        ways.append((cost + more, "K" + audit, (f"{role}:{text}", *left)))
            return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

        cost, audit, left = best(0, 0)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost if own else 0, audit, digest)
    return out


def conversations(seed, n=60, longest=14):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        texts = [rng.choice(["Yes.", "No", "Why?", "", " \n", "Ümlaut!", "a.\t", "."]) + "x" * rng.randint(0, 1) if rng.random() < 0.7 else None for _ in range(longest)]
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "alien", "Sys"])
            rows.append((conv, rng.choice([turn, turn, turn // 2, None, turn * 3]), role, texts[turn]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_search(spark, seed):
    rows = conversations(seed) + [(None, 1, "user", "Hi."), (None, None, None, None), (10**12, 5, "user", None)]
    rows += rows[:40]  # repeated rows
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(table(spark, rows)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("block_rows", [1, 3, 50])
def test_a_conversation_in_many_blocks(spark, block_rows):
    """Half of all rows are one conversation, which is cut into blocks."""
    rng = random.Random(block_rows)
    rows = conversations(7, n=12) + [(99, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "", "again."])) for i in range(150)]
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.conversation_rows(table(spark, rows)), block_rows).collect()}
    assert got == plain(rows, damaged=False)


def test_of_nothing(spark):
    assert repair.repaired(table(spark, [])).collect() == []
    # All rows of a conversation may be dropped: 0 in the checksum.
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = repair.repaired(table(spark, [(conv, 1, "user", "Hi.")])).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_row_repeated_very_often(spark):
    rows = [(1, 1, "user", "Hi.")] * 3000 + [(1, 2, "assistant", "x" * 100_000 + ".")]
    row = repair.repair(repair.conversation_rows(table(spark, rows))).first()
    assert (row["duplicate"], row["illegal"], row["cost"], row["audit"]) == (2999, 2999, 4 * 2999, "K" + "D" * 2999 + "K")
    assert row["repaired_sha256"] == hashlib.sha256(("user:Hi.\nassistant:" + "x" * 100_000 + ".").encode()).hexdigest()


def test_ranks_choose_the_least_audit():
    """Random acyclic graphs, also with several edits of one initial: the path of least audit, an end before anything else."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        to = np.full((n, 5), -1)
        for i in range(n - 1):
            for e in rng.choice([1, 2, 3, 4], int(rng.integers(1, 4)), replace=False):
                to[i, e] = rng.integers(i + 1, n)

        def least(i):
            return min(("DIKR"[e - 1] + least(to[i, e]) for e in range(1, 5) if to[i, e] >= 0), default="")

        pointers, edit, length = repair.least_paths(to)
        nodes = repair.path_nodes(pointers, np.arange(n), length)
        at = 0
        for i in range(n):
            assert "".join("DIKR"[e - 1] for e in edit[nodes[at : at + length[i]]]) == least(i)
            at += length[i]
