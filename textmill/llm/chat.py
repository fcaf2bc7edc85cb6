"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in turn,
ending with the assistant's. Each source turn is kept (0), relabelled (RELABEL), or merged
into the turn before it (MERGE, plus RELABEL if its role differs); empty turns may be
inserted (INSERT each), also at the end. Dynamic programming over the automaton's states
(begin, system, user, assistant) picks the least total cost; among equals the smaller state,
and keeping before merging before relabelling before inserting.

Every source turn yields one row with its role in the repaired conversation and its piece
of the rendered text; the pieces of a conversation in order are the whole text, so no
conversation, however long, is ever held in one place. Turns are range-partitioned by
(conversation, turn, …). Conversations that lie inside a partition are solved there, all of a
batch together, a step of the dynamic programme at a time. Only the first and the last one of a
partition may go on in others: their stretches are summarised by 4 x 4 matrices of least
costs; these, one for each partition that a conversation spans, are multiplied (min, +) to
fix the states at the stretches' ends; then each stretch is solved by itself.

Nulls and edges: null or unknown roles are no role and always relabelled; a null text is
empty; turns that tie are ordered by role and text; null turns come first; turns with a
null conv_id are a conversation of their own; '<|' in a text is written '< |' so that it
can't pass for a marker; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_code
from .common import arrow_map, materialize

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Rows of a range partition, about.
STRETCH, MANY = 5_000, 200_000
BIG = 1 << 40


@cache
def inserted(start: int) -> tuple[tuple[int, ...], ...]:
    """The chains of empty turns that can follow a state, shortest first, at most two long."""
    one = tuple((a,) for a in NEXT[start])
    return ((), *one, *tuple((a, b) for (a,) in one for b in NEXT[a]))


@cache
def moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, state after) -> (cost, action, inserted turns) of the best way to place one turn.

    role: 0 for none, else the state that the role leads to.
    """
    out: dict = {}
    for a in range(4):
        if a != BEGIN:
            out[a, a] = (MERGE + (0 if role == a else RELABEL), "merge", ())
        for chain in inserted(a):
            at = chain[-1] if chain else a
            for b in NEXT[at]:
                cost = INSERT * len(chain) + (0 if role == b else RELABEL)
                new = (cost, "keep" if role == b else "relabel", chain)
                if (a, b) not in out or cost < out[a, b][0]:
                    out[a, b] = new
    return out


@cache
def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """(cost, inserted turns) that end a conversation in this state legally."""
    chains = [c for c in inserted(state) if (c[-1] if c else state) == ASSISTANT]
    best = min(chains, key=len)
    return INSERT * len(best), best


@cache
def matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), BIG, np.int64)
    for (a, b), (cost, _, _) in moves(role).items():
        m[a, b] = cost
    return m


IDENTITY = np.where(np.eye(4, dtype=bool), 0, BIG).astype(np.int64)
COSTS = np.stack([matrix(r) for r in range(4)])
CLOSING = np.array([BIG, *[closing(x)[0] for x in (SYSTEM, USER, ASSISTANT)]])
ACTIONS = ("keep", "merge", "relabel")
CLOSE = "<|end|>\n"


def _open(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


@cache
def _told() -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """By (role * 4 + state before) * 4 + state after: the action's number, the empty turns before it, the text before the turn's own."""
    action, added, before = np.zeros(64, np.int64), np.zeros(64, np.int32), [""] * 64
    for role in range(4):
        for (a, b), (_, what, chain) in moves(role).items():
            at = (role * 4 + a) * 4 + b
            action[at], added[at] = ACTIONS.index(what), len(chain)
            before[at] = "\n" if what == "merge" else (CLOSE if a != BEGIN else "") + "".join(_open(s) + CLOSE for s in chain) + _open(b)
    return action, added, pa.array(before)


def forward(roles: np.ndarray, cut: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """From `cost` of the four states before each stretch roles[cut[i] : cut[i + 1]]: the costs after it, the best states before each turn, and which stretches have a turn k."""
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    steps = [order[:m] for k in range(int(size.max(initial=0))) if (m := int(np.searchsorted(-size[order], -k)))]
    cost, back = cost.copy(), np.zeros((len(roles), 4), np.int8)
    for k, live in enumerate(steps):
        ways = cost[live][:, :, None] + COSTS[roles[cut[live] + k]]
        back[cut[live] + k] = ways.argmin(1)
        cost[live] = np.minimum(ways.min(1), BIG)
    return cost, back, steps


def solve(roles: np.ndarray, cut: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, state after each turn; cost of each stretch) on the cheapest ways from `first` to `last` (-1: to a legal end)."""
    cost = np.full((len(first), 4), BIG)
    cost[np.arange(len(first)), first] = 0
    cost, back, steps = forward(roles, cut, cost)
    state = np.where(last < 0, (cost + CLOSING).argmin(1), last)
    before, after = np.zeros(len(roles), np.int64), np.zeros(len(roles), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        live = steps[k]
        at = cut[live] + k
        after[at] = state[live]
        before[at] = state[live] = back[at, state[live]]
    return before, after, (cost + CLOSING).min(1)


def _codes(roles: pa.Array) -> np.ndarray:
    """The state that each role leads to, 0 for none."""
    return pc.fill_null(pc.add(pc.index_in(roles, pa.array(ROLES)), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)


SOLVED = ["new_role", "action", "inserted", "conversation_cost", "rendered"]


def _rendered(table: pa.Table, cut: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray, cost: np.ndarray | None = None) -> list[pa.Array]:
    """The columns SOLVED of some stretches: which of them end a conversation, its cost where it is more than the stretch's."""
    roles = _codes(table["role"].combine_chunks())
    before, after, total = solve(roles, cut, first, last)
    action, added, opening = _told()
    at = (roles * 4 + before) * 4 + after
    added, tails = added[at], [""] * len(at)
    for k in (cut[1:][ends] - 1).tolist():
        chain = closing(int(after[k]))[1]
        added[k] += len(chain)
        tails[k] = CLOSE + "".join(_open(s) + CLOSE for s in chain)
    text = pc.replace_substring(pc.fill_null(table["text"].combine_chunks(), ""), "<|", "< |")
    whole = pc.binary_join_element_wise(opening.take(pa.array(at)), text, pa.array(tails), "")
    paid = np.repeat(total if cost is None else cost, np.diff(cut))
    return [pa.array(ROLES).take(pa.array(after - 1)), pa.array(ACTIONS).take(pa.array(action[at])), pa.array(added, pa.int32()), pa.array(paid, pa.int64()), whole]


NAMES = ["conv_id", "part", "pos", "turn", "role", "text", "costs", *SOLVED]
SCHEMA = "conv_id long, part long, pos long, turn long, role string, text string, costs array<long>, new_role string, action string, inserted int, conversation_cost long, rendered string"


def _changes(ids: pa.Array) -> np.ndarray:
    """Places whose id differs from the one before."""
    null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero((null[1:] != null[:-1]) | (value[1:] != value[:-1])) + 1


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved turns of the conversations inside the partition; turns and cost matrices of its first and last one."""
    part = int(np.random.SeedSequence().entropy % (1 << 62))
    at, held, begun = 0, None, False
    columns = ["conv_id", "turn", "role", "text"]

    def open_(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal at
        n, roles = len(table), _codes(table["role"].combine_chunks())
        costs = forward(np.tile(roles, 4), np.arange(5) * n, IDENTITY)[0]
        blank = {"part": pa.array([part] * (n + 1)), "pos": pa.array(range(at, at + n + 1)), "costs": pa.array([None] * n + [costs.ravel().tolist()], pa.list_(pa.int64()))}
        ids = pa.concat_arrays([table["conv_id"].combine_chunks(), table["conv_id"].combine_chunks().slice(0, 1)])
        more = {c: pa.concat_arrays([table[c].combine_chunks(), pa.nulls(1, table[c].type)]) for c in columns[1:]}
        none = dict(zip(SOLVED, [pa.nulls(n + 1, t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())], strict=True))
        at += n + 1
        whole = {"conv_id": ids, **blank, **more, **none}
        yield from pa.table([whole[c] for c in NAMES], NAMES).to_batches()

    def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(table)
        cut = np.concatenate([[0], _changes(table["conv_id"].combine_chunks()), [n]])
        m = len(cut) - 1
        solved = _rendered(table, cut, np.zeros(m, np.int64), np.full(m, -1), np.ones(m, bool))
        whole = {"conv_id": table["conv_id"], "turn": table["turn"], "role": table["role"], "part": pa.nulls(n, pa.int64()), "pos": pa.nulls(n, pa.int64()), "text": pa.nulls(n, pa.string()), "costs": pa.nulls(n, pa.list_(pa.int64()))}
        whole |= dict(zip(SOLVED, solved, strict=True))
        yield from pa.table([whole[c] for c in NAMES], NAMES).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch.select(columns)])
        held = table if held is None else pa.concat_tables([held, table])
        edges = _changes(held["conv_id"].combine_chunks())
        if len(edges):
            lead = 0
            if not begun:
                begun, lead = True, int(edges[0])
                yield from open_(held.slice(0, lead))
            done = int(edges[-1])
            if done > lead:
                yield from closed(held.slice(lead, done - lead))
            held = held.slice(done)
    if held is not None and len(held):
        yield from open_(held)


def _ends(table: pa.Table) -> pa.Table:
    """For one conversation's stretches, in order: the states that the best way has at their ends."""
    order = np.argsort(table["no"].to_numpy(), kind="stable")
    mats = table["costs"].combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)[order]
    cost, back = np.array([0, BIG, BIG, BIG]), []
    for m in mats:
        ways = cost[:, None] + m
        back.append(ways.argmin(0))
        cost = np.minimum(ways.min(0), BIG)
    total, state = int((cost + CLOSING).min()), int((cost + CLOSING).argmin())
    first, last = [], []
    for prev in reversed(back):
        last.append(state)
        state = int(prev[state])
        first.append(state)
    k = len(mats)
    return pa.table(
        {
            "conv_id": table["conv_id"].take(pa.array(order)), "part": table["part"].take(pa.array(order)), "first": pa.array(first[::-1], pa.int32()), "last": pa.array(last[::-1], pa.int32()),
            "is_end": pa.array([i == k - 1 for i in range(k)]), "cost": pa.array([total] * k, pa.int64()),
        }
    )


def _render(table: pa.Table) -> pa.Table:
    """One stretch: role, action, inserted turns and rendered piece of every turn."""
    table = table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))
    one = lambda c: np.array([table[c][0].as_py()])
    end = bool(table["is_end"][0].as_py())
    solved = _rendered(table, np.array([0, len(table)]), one("first"), np.array([-1]) if end else one("last"), np.array([end]), one("cost"))
    return pa.table([table["conv_id"], table["turn"], table["role"], *solved], ["conv_id", "turn", "role", *SOLVED])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, conversation_cost, rendered: a row per source turn."""
    ship_code(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    count = turns.count()
    n = max(1, min(count // STRETCH, max(200, count // MANY)))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    rows = turns.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    rows = materialize(arrow_map(rows, _stretches, SCHEMA))
    out = ["conv_id", "turn", "role", *SOLVED]
    solved = rows.where("rendered is not null").select(out)
    # stretches of one conversation follow one another by their first turn
    heads = rows.where("rendered is null and costs is null").groupBy("conv_id", "part").agg(F.min(F.struct("turn", "role", F.xxhash64("text").alias("h"))).alias("no"))
    marks = rows.where("costs is not null").select("conv_id", "part", "costs")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    stretch = marks.join(heads, same(marks, heads)).select(marks["conv_id"], marks["part"], "costs", "no")
    stretch = stretch.withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy("no")))  # one row for each partition that it spans
    ends = materialize(stretch.groupBy("conv_id").applyInArrow(_ends, "conv_id long, part long, first int, last int, is_end boolean, cost long"))
    body = rows.where("rendered is null and costs is null").select("conv_id", "part", "pos", "turn", "role", "text")
    body = body.join(ends, same(body, ends)).select(body["conv_id"], body["part"], "pos", "turn", "role", "text", "first", "last", "is_end", "cost")
    crossing = body.groupBy("conv_id", "part").applyInArrow(
        _render, "conv_id long, turn long, role string, new_role string, action string, inserted int, conversation_cost long, rendered string"
    )
    return solved.unionByName(crossing)
