"""Repairs conversations with the cheapest edits: blank, repeated and cut-off turns, and roles out of order.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. A row may be kept (cost 0), given the role user or assistant (3) or
deleted (4; blank and repeated rows must be), and turns without text may be inserted anywhere (3 each); a cut-off row that isn't deleted
costs 3 more. Of the cheapest repairs the one with the least audit is taken: the initials D, I, K, R of its edits in order.

1. Equal rows of a turn are combined first (a row and how often it stands there). Rows are dealt into ranges of conversation, turn, role
   and text, sorted, and cut into blocks of at most `BLOCK_ROWS` rows and `BLOCK_BYTES` of text, so that a conversation of any length is
   many blocks in many tasks.
2. A node is a place between rows and one of four states (nothing yet; behind a system, user, assistant turn). A block is a 4 x 4 matrix of
   cheapest costs from its first to its last place. Multiplied from the end (one row of 16 numbers per block), these give each block the
   costs behind it; then costs within a block follow, from its last place to its first.
3. An arc is optimal if its cost and what remains behind it add up to the node's. Nodes are ranked by their least audits of length 1, 2, 4,
   ...: with the ranks for a length and the node that many edits on, the pair of ranks gives the doubled length. Ranks choose among the
   optimal arcs of a node, and the doubled pointers give the nodes of the path, all edits at once.
4. A block gives a result for each state it may begin with; the conversation's blocks are then read in order, one state leading to the
   next. Only here does a conversation pass through one task, a block at a time: its digest has to be computed in order.

Rows are in ascending order of turn (null first), rows of one turn by role and text. Nulls in id, turn, role or text count as one space; a
null id is a conversation of its own. A role that begins with none of s, u, a can't be kept, an empty one neither. Other columns are not
read, whatever their names. Conversations without rows give zeros, an empty audit and the digest of nothing; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.tables import written

BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Costs of edits.
RELABEL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: More than any cost of 2^31 rows.
NEVER = 1 << 50
#: Edits by the order of their initials, behind nothing at all.
END, D, I, K, R = range(5)
_INITIALS = np.frombuffer(b"\0DIKR", np.uint8)
#: States: nothing yet, behind system, user, assistant; where a user or assistant turn leads from each.
STATES = 4
_TURN = np.array([2, 2, 3, 2])
_NAMES = (None, "system", "user", "assistant")
#: Where keeping a row of each initial (none of them, s, u, a) leads from each state; -1: nowhere.
_KEEP = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])

SPACES = " \t\n\x0b\x0c\r"


def conversation_rows(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Columns conv, turn, role, text (nulls in the last two: one space) and n, how often the row stands there."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))]
    return table.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *plain, F.lit(1).cast("long").alias("n"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of `conversation_rows` damaged by a checksum of conversation and turn: dropped, emptied, without stops, repeated, or the user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    part = rows.withColumn("part", F.crc32(key) % 20).where("part <> 0")
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("part") == 3, F.col("n") * 2).otherwise(F.col("n"))
    return part.select("conv", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def _same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _faults(rows: DataFrame) -> DataFrame:
    """Each different row of a turn with its first fault: `blank`, `again` (role and text stand in an earlier turn) or `cut`."""
    once = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    several = once.groupBy("conv", "role", "key").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    o, s = once.alias("o"), several.alias("s")
    judged = o.join(s, _same("o", "s", ("conv", "role", "key")), "left")
    blank = F.rtrim("o.text", F.lit(SPACES)) == ""
    again = F.coalesce((F.struct(F.col("o.turn").isNotNull().alias("some"), F.col("o.turn")) > F.col("s.first")), F.lit(False))
    cut = ~F.substring(F.rtrim("o.text", F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    faults = blank.alias("blank"), (~blank & again).alias("again"), (~blank & cut).alias("cut")
    return judged.select("o.conv", "o.turn", "o.role", "o.text", "o.n", *faults)


def initials(roles: list[str]) -> np.ndarray:
    """0, or 1 to 3 for roles that begin with s, u, a."""
    return np.array(["?sua".find(r[:1]) if r else 0 for r in roles], np.int64).clip(0)


def _cut(sizes: np.ndarray, change: np.ndarray, block_rows: int) -> np.ndarray:
    """First rows of blocks: where a conversation begins, and where a block would be too large."""
    first, rows, held = [], 0, 0
    for i, (size, new) in enumerate(zip(sizes.tolist(), change.tolist(), strict=True)):
        if new or rows >= block_rows or held + size > BLOCK_BYTES and rows:
            first.append(i)
            rows = held = 0
        rows, held = rows + 1, held + size
    return np.array(first, np.int64)


#: Lists of a block, one item per row.
_LISTS = {"turns": pa.int64(), "roles": pa.string(), "texts": pa.string(), "n": pa.int64(), "blank": pa.bool_(), "again": pa.bool_(), "cut": pa.bool_()}
_LISTS_SQL = "turns array<long>, roles array<string>, texts array<string>, n array<long>, blank array<boolean>, again array<boolean>, cut array<boolean>"


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows in order, as blocks of one conversation each: `part` and `at` give the order of all blocks."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.col("text")]
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rest, at = (yield from emit(table, at, False))
        if rest is not None:
            yield from emit(rest, at, True)

    def emit(table: pa.Table, at: int, last: bool):
        """Blocks of the rows but the last one, whose conversation may go on."""
        if not table.num_rows:
            return None, at
        table = table.combine_chunks()
        conv = table.column("conv").to_pylist()
        change = np.array([True] + [a != b for a, b in zip(conv, conv[1:])])
        sizes = np.array([len(t) for t in table.column("text").to_pylist()])
        first = _cut(sizes, change, block_rows)
        cuts = [*first.tolist(), table.num_rows]
        full = len(first) if last else len(first) - 1
        lists = {name: table.column({"turns": "turn", "roles": "role", "texts": "text"}.get(name, name)).combine_chunks() for name in _LISTS}
        ends = pa.array(cuts[: full + 1], pa.int32())
        if full:
            columns = {"part": pa.array([table.column("part")[0].as_py()] * full, pa.int32()), "at": pa.array(range(at, at + full), pa.int64())}
            columns["conv"] = table.column("conv").combine_chunks().take(pa.array(cuts[:full]))
            yield pa.record_batch(columns | {name: _list(ends, values) for name, values in lists.items()})
        return (None if last else table.slice(cuts[full])), at + full

    schema = f"part int, at long, conv {kind}, {_LISTS_SQL}"
    return dealt.mapInArrow(build, schema)


def _list(ends: pa.Array, values: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    return pa.ListArray.from_arrays(ends, values)


class Rows:
    """The rows of several blocks one behind the other, and the costs of what may be done with them."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda c: batch.column(c).flatten()
        self.roles, self.texts = flat("roles").to_pylist(), flat("texts").to_pylist()
        self.initial = initials(self.roles)
        self.n = flat("n").to_numpy()
        self.blank, self.again, self.cut = (flat(c).to_numpy(zero_copy_only=False) for c in ("blank", "again", "cut"))
        self.sizes = np.diff(batch.column("n").offsets.to_numpy())
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        must = self.blank | self.again
        extra = np.where(self.cut, CUT_OFF, 0)
        # Further copies of a row can only be deleted. Keeping and relabelling stand for what is done with the first one.
        self.drop = DELETE * self.n
        rest = DELETE * (self.n - 1)
        self.relabel = np.where(must, NEVER, RELABEL + extra + rest)
        to = _KEEP[self.initial]
        self.keep = np.where((to >= 0) & ~must[:, None], (extra + rest)[:, None], NEVER)  # by state
        self.keep_to = np.maximum(to, 0)

    def places(self) -> np.ndarray:
        """First place of each block; a block has one place more than rows."""
        return self.begins[:-1] + np.arange(len(self.sizes))


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs from the four states (last axis), when turns may be inserted first. Two inserts in a row lead back, so one or none is enough from
    behind a user or assistant turn, and two from elsewhere."""
    out = costs.copy()
    out[..., 2] = np.minimum(costs[..., 2], INSERT + costs[..., 3])
    out[..., 3] = np.minimum(costs[..., 3], INSERT + costs[..., 2])
    out[..., 0] = np.minimum(costs[..., 0], INSERT + out[..., 2])
    out[..., 1] = np.minimum(costs[..., 1], INSERT + out[..., 2])
    return out


def costs_to_end(rows: Rows, behind: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost from each place and state to the end, for costs `behind` each block (block, ..., state); inserts at the very end where `last`.

    The loop is over places, all blocks at once.
    """
    places = rows.places()
    out = np.zeros((len(rows.n) + len(rows.sizes), *behind.shape[1:]), np.int64)
    shape = (-1,) + (1,) * (behind.ndim - 2)
    final = last.reshape(shape + (1,)) if len(last) else last.reshape(0, *([1] * (behind.ndim - 1)))
    now = np.where(final, with_inserts(behind), behind)
    out[places + rows.sizes] = now
    some = np.flatnonzero(rows.sizes > 0)
    step = 1
    while len(some):
        row, place = rows.begins[:-1][some] + rows.sizes[some] - step, places[some] + rows.sizes[some] - step
        nxt = out[place + 1]
        best = nxt + rows.drop[row].reshape(shape + (1,))
        best = np.minimum(best, nxt[..., _TURN] + rows.relabel[row].reshape(shape + (1,)))
        for s in range(STATES):
            to = rows.keep_to[row, s].reshape(shape + (1,))
            kept = np.take_along_axis(nxt, np.broadcast_to(to, nxt.shape[:-1] + (1,)), axis=-1)[..., 0]
            best[..., s] = np.minimum(best[..., s], kept + rows.keep[row, s].reshape(shape))
        out[place] = np.minimum(with_inserts(best), NEVER)
        step += 1
        some = some[rows.sizes[some] >= step]
    return out


def arcs(rows: Rows, costs: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Node reached by each optimal edit of each node (columns D, I, K, R; -1: the edit isn't optimal). Nodes are place * 4 + state."""
    places, count = rows.places(), len(costs)
    flat = costs.reshape(-1)
    to = np.full((count * STATES, 5), -1, np.int64)
    state = np.arange(STATES)
    place = np.arange(len(rows.n)) + np.repeat(np.arange(len(rows.sizes)), rows.sizes)
    here, there = place[:, None] * STATES + state, (place[:, None] + 1) * STATES
    for edit, cost, target in (
        (D, rows.drop[:, None], there + state),
        (K, rows.keep, there + rows.keep_to),
        (R, rows.relabel[:, None], there + _TURN),
    ):
        good = (np.broadcast_to(cost, here.shape) < NEVER) & (flat[here] < NEVER) & (flat[target] + cost == flat[here])
        to[here[good], edit] = target[good]
    inner = np.ones(count, bool)
    inner[places + rows.sizes] = last
    here = (np.flatnonzero(inner)[:, None] * STATES + state).ravel()
    target = here // STATES * STATES + _TURN[here % STATES]
    good = (flat[here] < NEVER) & (flat[target] + INSERT == flat[here])
    to[here[good], I] = target[good]
    return to


def least_paths(to: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Doubled pointers along the least path of each node, the edit each node begins with (END: none), and the length of its path.

    Ranks order nodes by their least audits of a length, which is doubled until no pointer moves. A node's pointer leads over the optimal
    edit of which the initial, then the rank of the node behind it, is least; an audit that ends is less than one that goes on.
    """
    nodes = np.arange(len(to))
    edits = np.arange(5)
    # Length 1: the least initial; ranks for longer audits choose among targets where initials are equal.
    rank = np.where((to >= 0).any(axis=1), np.argmax(to >= 0, axis=1), END)
    while True:
        behind = np.where(to >= 0, edits * (len(to) + 1) + rank[to], np.iinfo(np.int64).max)
        edit = np.argmin(behind, axis=1)
        stop = (to < 0).all(axis=1)
        step = np.where(stop, nodes, to[nodes, edit])
        pointers, ranks = [step], np.where(stop, END, edit)
        length = (~stop).astype(np.int64)
        while True:
            jump = pointers[-1]
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            length = length + length[jump]
            ranks = np.unique(ranks * (len(to) + 1) + ranks[jump], return_inverse=True)[1]
            pointers.append(further)
        if np.array_equal(ranks, rank):
            return pointers, np.where(stop, END, edit), length
        rank = ranks


def path_nodes(pointers: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The nodes from each start, `lengths` of them, one path behind the other."""
    node = np.repeat(starts, lengths)
    at = np.arange(len(node)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for bit, jump in enumerate(pointers):
        some = at >> bit & 1 == 1
        node[some] = jump[node[some]]
    return node


def _arrow(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about a block's rows."""
    for batch in blocks:
        ends, a = np.concatenate([[0], np.cumsum(np.diff(batch.column("n").offsets.to_numpy()))]), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_ROWS, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def matrices(rows: Rows) -> np.ndarray:
    """Cheapest cost from each state at a block's first place (last axis) to each state at its last (axis before)."""
    goal = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    behind = np.broadcast_to(goal, (len(rows.sizes), STATES, STATES))
    return costs_to_end(rows, behind, np.zeros(len(rows.sizes), bool))[rows.places()]


def _summary(blocks: DataFrame) -> DataFrame:
    """Counts and the cost matrix of each block."""
    kind = blocks.schema["conv"].dataType.simpleString()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrow(batches):
            rows = Rows(batch)
            n, a, b = rows.n, rows.begins[:-1], rows.begins[1:]
            total = lambda x: np.add.reduceat(np.append(x, 0), a)[: len(a)]  # noqa: E731  no block is empty
            pair = np.zeros(len(n), np.int64)
            pair[1:] = _illegal(rows.initial[:-1], rows.initial[1:])
            pair[a] = 0
            turns = batch.column("turns").flatten()
            some = ~turns.is_null().to_numpy(zero_copy_only=False)
            value = turns.fill_null(0).to_numpy()
            new = some.copy()
            new[1:] &= ~some[:-1] | (value[1:] != value[:-1])
            new[a] = some[a]
            known = total(some.astype(np.int64))  # nulls come first
            yield pa.record_batch(
                {
                    "part": batch.column("part"),
                    "at": batch.column("at"),
                    "conv": batch.column("conv"),
                    # copies of a blank row are blank, those of any other repeat it
                    "blank": pa.array(total(n * rows.blank)),
                    "duplicate": pa.array(total(np.where(rows.blank, 0, np.where(rows.again, n, n - 1)))),
                    "truncated": pa.array(total((rows.cut & ~rows.again).astype(np.int64))),
                    "illegal": pa.array(total(pair + (n - 1))),
                    "turns": pa.array(total(new.astype(np.int64))),
                    "some": pa.array(known > 0),
                    "low": pa.array(value[np.minimum(b - known, b - 1)]),
                    "high": pa.array(value[b - 1]),
                    "first": pa.array(rows.initial[a]),
                    "last": pa.array(rows.initial[b - 1]),
                    "matrix": pa.FixedSizeListArray.from_arrays(pa.array(matrices(rows).ravel()), 16).cast(pa.list_(pa.int64())),
                }
            )

    counts = "blank long, duplicate long, truncated long, illegal long, turns long, some boolean, low long, high long, first long, last long"
    return blocks.mapInArrow(sum_up, f"part int, at long, conv {kind}, {counts}, matrix array<long>")


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Neither s before u, u before a, nor a before u."""
    return ~((a == 1) & (b == 2) | (a == 2) & (b == 3) | (a == 3) & (b == 2))


def chain(pdf: pd.DataFrame) -> tuple[dict, np.ndarray]:
    """Counts of a conversation, and the costs behind each of its blocks; `pdf` has its blocks in order."""
    behind = np.zeros((len(pdf), STATES), np.int64)
    now = _ACCEPT
    for i in range(len(pdf) - 1, -1, -1):
        behind[i] = now
        matrix = np.array(pdf["matrix"].iloc[i]).reshape(STATES, STATES)  # by state behind, state before
        now = np.minimum((matrix + (with_inserts(now) if i == len(pdf) - 1 else now)[:, None]).min(axis=0), NEVER)
    counts = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    first, last = pdf["first"].to_numpy(), pdf["last"].to_numpy()
    counts["illegal"] += int(_illegal(last[:-1], first[1:]).sum())
    known = pdf[pdf["some"]]
    low, high = known["low"].to_numpy(), known["high"].to_numpy()
    distinct = int(known["turns"].sum()) - int((low[1:] == high[:-1]).sum())
    counts["gaps"] = int(high[-1]) - int(low[0]) + 1 - distinct if len(known) else 0
    counts["cost"] = int(now[0])
    return counts, behind


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Costs behind a conversation's last row: nothing from where it may end.
_ACCEPT = np.array([0, NEVER, NEVER, 0], np.int64)


def _chained(summary: DataFrame) -> DataFrame:
    """For each block: costs behind it, its number, the conversation's blocks and counts.

    Conversations of one block are worked out many at a time. Of the others a group has one row of about 200 bytes for each 4,096 rows; an
    audit is one string, so that a conversation has less than 2^31 rows and its group less than 2^19.
    """
    kind = summary.schema["conv"].dataType.simpleString()
    schema = f"part int, at long, conv {kind}, behind array<long>, number long, blocks long, " + ", ".join(f"{c} long" for c in COUNTS)
    sized = summary.withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy("conv")))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            matrix = batch.column("matrix").flatten().to_numpy().reshape(n, STATES, STATES)
            cost = (matrix[:, :, 0] + with_inserts(_ACCEPT)).min(axis=1)
            gaps = np.where(column("some"), column("high") - column("low") + 1 - column("turns"), 0)
            made = {"behind": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * STATES, pa.int32()), pa.array(np.tile(_ACCEPT, n)))}
            made |= {"number": pa.array(np.zeros(n, np.int64)), "blocks": batch.column("blocks"), "gaps": pa.array(gaps), "cost": pa.array(cost)}
            known = {c: batch.column(c) for c in ("part", "at", "conv", *COUNTS[1:-1])} | made
            yield pa.record_batch([known[c] for c in names], names)

    names = ["part", "at", "conv", "behind", "number", "blocks", *COUNTS]

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "at"])
        counts, behind = chain(pdf)
        out = pdf[["part", "at", "conv"]].copy()
        out["behind"], out["number"], out["blocks"] = list(behind), np.arange(len(pdf)), len(pdf)
        for c in COUNTS:
            out[c] = counts[c]
        return out

    alone = sized.where("blocks = 1").mapInArrow(single, schema)
    return alone.unionByName(sized.where("blocks > 1").groupBy("conv").applyInPandas(several, schema))


def repaired_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Block, state before, state behind, audit and repaired rows, for each state a block may begin with."""
    rows = Rows(batch)
    behind = np.array(batch.column("behind").to_pylist(), np.int64).reshape(-1, STATES)
    number, blocks = batch.column("number").to_numpy(), batch.column("blocks").to_numpy()
    last = number == blocks - 1
    costs = costs_to_end(rows, behind, last)
    pointers, edit, length = least_paths(arcs(rows, costs, last))
    places = rows.places()
    pick = [(i, s) for i in range(len(places)) for s in ([0] if number[i] == 0 else range(STATES)) if costs[places[i], s] < NEVER]
    starts = np.array([places[i] * STATES + s for i, s in pick], np.int64)
    nodes = path_nodes(pointers, starts, length[starts])
    ends = np.concatenate([[0], np.cumsum(length[starts])])
    final = pointers[-1][starts] % STATES
    row_of = nodes // STATES - np.repeat([i for i, _ in pick], length[starts]).astype(np.int64)  # each block has a place more than rows
    audits = _INITIALS[edit[nodes]]
    behind_edit = pointers[0][nodes] % STATES
    for j, (i, s) in enumerate(pick):
        a, b = ends[j], ends[j + 1]
        audit, out = bytearray(), []
        for e, letter, r, state in zip(edit[nodes[a:b]].tolist(), audits[a:b].tolist(), row_of[a:b].tolist(), behind_edit[a:b].tolist(), strict=True):
            audit.append(letter)
            if e == I:
                out.append(f"{_NAMES[state]}:")
                continue
            audit += b"D" * (int(rows.n[r]) - 1)  # further copies go; what may be inserted behind them comes later in the order of audits
            if e != D:
                out.append(f"{rows.roles[r] if e == K else _NAMES[state]}:{rows.texts[r]}")
        yield i, s, int(final[j]), bytes(audit), "\n".join(out).encode() if out else None


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of `rows` (as of `conversation_rows`): conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256."""
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = written(_blocks(_faults(rows), block_rows))
    chained = written(_chained(written(_summary(blocks))))
    counts = COUNTS

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _arrow(batches):
            got = list(repaired_blocks(batch))
            if got:
                block, before, behind, audit, text = zip(*got)
                at = pa.array(block)
                columns = {c: batch.column(c).take(at) for c in ("conv", "number")} | {c: batch.column(f"n_{c}").take(at) for c in counts}
                yield pa.record_batch(
                    columns
                    | {
                        "before": pa.array(before, pa.int64()),
                        "behind": pa.array(behind, pa.int64()),
                        "audit": pa.array(audit, pa.binary()),
                        "text": pa.array(text, pa.binary()),
                    }
                )

    known = ", ".join(f"{c} long" for c in counts)
    costs = chained.select("part", "at", "behind", "number", "blocks", *(F.col(c).alias(f"n_{c}") for c in counts))
    keyed = blocks.join(costs, ["part", "at"])
    solved = keyed.mapInArrow(solve, f"conv {kind}, number long, {known}, before long, behind long, audit binary, text binary")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, audit, digest, row = 0, -1, [], None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["number"] == 0:
                    if row is not None:
                        out.append(result(row, audit, digest))
                    state, audit, digest, row, done = 0, [], None, r, -1
                if r["before"] == state and r["number"] == done + 1:
                    state, done = r["behind"], r["number"]
                    audit.append(r["audit"])
                    if r["text"] is not None:
                        if digest is None:
                            digest = hashlib.sha256(r["text"])
                        else:
                            digest.update(b"\n" + r["text"])
            if out:
                yield table(out)
        if row is not None:
            yield table([result(row, audit, digest)])

    def result(row: dict, audit: list[bytes], digest) -> dict:
        out = {c: row[c] for c in ("conv", *counts)}
        return out | {"audit": b"".join(audit).decode(), "repaired_sha256": (digest or hashlib.sha256()).hexdigest()}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=shape)

    fields = [("conv", to_arrow_type(rows.schema["conv"].dataType)), *((c, pa.int64()) for c in counts)]
    shape = pa.schema([*fields, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    order = solved.repartition("conv").sortWithinPartitions("conv", "number", "before")
    return order.mapInArrow(follow, f"conv {kind}, {known}, audit string, repaired_sha256 string")


def repaired(table: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Every conversation of `table` (conv_id, turn, role, text) after damage and repair, also those of which no row is left."""
    rows = conversation_rows(table, conv)
    every, done = rows.select("conv").distinct().alias("e"), repair(damage(rows)).alias("d")
    found = every.join(done, _same("e", "d", ("conv",)), "left")
    counts = [F.coalesce(f"d.{c}", F.lit(0).cast("long")).alias(c) for c in COUNTS]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    texts = F.coalesce("d.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", nothing).alias("repaired_sha256")
    return found.select(F.col("e.conv").alias(conv), *counts, *texts)
