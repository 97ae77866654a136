"""Chat formatting with minimum-cost role repair.

A legal conversation is a walk of an automaton whose states are the roles of the turn before. Each turn is kept, given
another role, or merged into the turn before, with empty turns inserted where the walk needs one. A turn's effect is a matrix of costs
from state to state; a run of turns is their (min, +) product, so long conversations are cut into blocks, the blocks'
matrices settle the states at the cuts, and each block finds its cheapest walk between its two states by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Turn numbers in one block.
BLOCK = 512
#: Blocks of cut conversations that may be sent to the executors (two states and a key each); more are joined by shuffle.
SENT_BLOCKS = 200_000


@dataclass(frozen=True)
class Rules:
    """States are START and the roles; `after[state]` are the roles that may follow; conversations end in a role of `last`."""

    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "START": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)
    merge: float = 2.0
    relabel: float = 3.0
    #: For roles that the automaton does not know.
    name_unknown: float = 1.0
    insert: float = 4.0

    @property
    def states(self) -> list[str]:
        return list(self.after)

    def ways(self) -> dict[tuple[str, str], list[str]]:
        """From state to role: the empty turns to insert before it, the fewest (the earliest listed of equals)."""
        found = {}
        for start in self.after:
            reached, level = {}, [(start, [])]
            while level:
                following = []
                for state, path in level:
                    for role in self.after[state]:
                        if role not in reached:
                            reached[role] = path
                            following.append((role, [*path, role]))
                level = following
            found |= {(start, role): path for role, path in reached.items()}
        return found


class Repair:
    def __init__(self, rules: Rules) -> None:
        self.rules, self.states, self.ways = rules, rules.states, rules.ways()
        self._matrix: dict[str | None, tuple[np.ndarray, list]] = {}

    def turn(self, role: str | None) -> tuple[np.ndarray, list]:
        """Costs from state to state of a turn with this role, and the action behind each: (merge?, empty turns before)."""
        if role not in self._matrix:
            n = len(self.states)
            cost, action = np.full((n, n), np.inf), [[None] * n for _ in range(n)]
            for i, state in enumerate(self.states):
                for j, to in enumerate(self.states):
                    if to == "START":
                        continue
                    named = 0.0 if role == to else self.rules.relabel if role in self.states[1:] else self.rules.name_unknown
                    if state == to:
                        cost[i, j], action[i][j] = self.rules.merge + named, (True, [])
                    way = self.ways.get((state, to))
                    if way is not None and named + self.rules.insert * len(way) < cost[i, j]:
                        cost[i, j], action[i][j] = named + self.rules.insert * len(way), (False, way)
            self._matrix[role] = cost, action
        return self._matrix[role]

    def end(self) -> list[tuple[float, list[str]]]:
        """For each state: what ending there costs, and the empty turns to add."""
        out = []
        for state in self.states:
            best = (np.inf, [])
            for role in self.rules.last:
                way = [] if state == role else self.ways.get((state, role))
                if way is not None:
                    added = way if state == role else [*way, role]
                    best = min(best, (self.rules.insert * len(added), added), key=lambda x: x[0])
            out.append(best)
        return out

    def product(self, roles: list[str | None]) -> np.ndarray:
        n = len(self.states)
        total = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
        for role in roles:
            total = (total[:, :, None] + self.turn(role)[0][None]).min(1)
        return total

    def walk(self, roles: list[str | None], start: int, end: int) -> tuple[float, list[tuple[str, bool, list[str]]]]:
        """The cheapest walk from state to state: its cost and, for each turn, (role, merged, empty turns before)."""
        best = np.full(len(self.states), np.inf)
        best[start] = 0.0
        back = []
        for role in roles:
            all_ways = best[:, None] + self.turn(role)[0]
            back.append(all_ways.argmin(0))
            best = all_ways.min(0)
        steps, state = [], end
        for role, came in zip(reversed(roles), reversed(back)):
            before = int(came[state])
            merged, way = self.turn(role)[1][before][state]
            steps.append((self.states[state], merged, way))
            state = before
        return float(best[end]), steps[::-1]

    def cuts(self, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
        """For the blocks of one conversation in order: each one's first and last state on the cheapest walk."""
        best = np.full(len(self.states), np.inf)
        best[0] = 0.0
        back = []
        for m in matrices:
            all_ways = best[:, None] + m
            back.append(all_ways.argmin(0))
            best = all_ways.min(0)
        state = int(np.argmin(best + np.array([c for c, _ in self.end()])))
        out = []
        for came in reversed(back):
            out.append((int(came[state]), state))
            state = int(came[state])
        return out[::-1]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def format_chats(turns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Repair and render conversations: one row per conversation and block of turn numbers.

    turns: conv_id, turn, role, text; further columns are not read. Returns conv_id, block, n_in (turns), n_out (turns
    rendered, empty ones included), n_merged, n_relabelled, n_inserted, cost, rendered. A conversation's text is that of
    its blocks in order (null turn numbers, block null, come first); one with turn numbers below BLOCK has one block.
    A turn merged into the last one of the block before it continues that turn there, so such a block's text begins
    without a role. Exact copies of a row count once. Turns of one number go by role, then text. Null texts are empty;
    null and unknown roles are given one; rows with a null conv_id are one conversation. An empty table gives an
    empty result. A role is compared without outer blanks and case.

    Copies are combined before the shuffle; a block holds BLOCK turn numbers at most, however long the conversation is.
    """
    role = F.lower(F.trim("role"))
    distinct = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = distinct.groupBy("conv_id", F.expr(f"turn div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(rules)
        for batch in batches:
            products = [repair.product([t["role"] for t in own]).ravel().tolist() for own in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(products, pa.list_(pa.float64()))], names=["conv_id", "block", "turns", "matrix"])

    ids = turns.schema["conv_id"].dataType.simpleString()
    block_type = blocks.schema["block"].dataType.simpleString()
    turn_type = turns.schema["turn"].dataType.simpleString()
    whole = saved(blocks.mapInArrow(
        measured, f"conv_id {ids}, block {block_type}, turns array<struct<turn:{turn_type},role:string,text:string>>, matrix array<double>"), "chat_blocks")
    several = whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    cut = whole.select("conv_id", "block", "matrix").join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        # One small matrix for each block: a five-hundredth of the conversation's turns.
        repair = Repair(rules)
        rows = rows.sort_values("block", na_position="first")
        n = len(repair.states)
        states = repair.cuts([np.array(m).reshape(n, n) for m in rows["matrix"]])
        return pd.DataFrame({
            "c": rows["conv_id"], "b": rows["block"], "first": [s for s, _ in states], "final": [e for _, e in states],
            "ends": [False] * (len(rows) - 1) + [True]})

    states = saved(cut.groupBy("conv_id").applyInPandas(settle, f"c {ids}, b {block_type}, first int, final int, ends boolean"), "chat_cuts")
    if states.count() <= SENT_BLOCKS:
        states = F.broadcast(states)
    joined = whole.drop("matrix").join(
        states, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left").drop("c", "b")
    out = (f"conv_id {ids}, block {block_type}, n_in long, n_out long, n_merged long, n_relabelled long, n_inserted long, "
           "cost double, rendered string")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(rules)
        ends = repair.end()
        for batch in batches:
            rows = []
            for own, first, final, last in zip(*(batch.column(c).to_pylist() for c in ("turns", "first", "final", "ends"))):
                roles = [t["role"] for t in own]
                if first is None:
                    (first, final), last = repair.cuts([repair.product(roles)])[0], True
                cost, steps = repair.walk(roles, first, final)
                parts: list[tuple[str, str]] = []
                continued, relabelled, inserted, merged = "", 0, 0, 0
                for turn, (role_to, joins, way) in zip(own, steps):
                    parts += [(x, "") for x in way]
                    inserted += len(way)
                    relabelled += role_to != turn["role"]
                    merged += joins
                    if joins and parts:
                        parts[-1] = (role_to, f"{parts[-1][1]}\n{turn['text']}")
                    elif joins:
                        continued += f"{turn['text']}\n<|end|>\n"
                    else:
                        parts.append((role_to, turn["text"]))
                if last:
                    cost += ends[final][0]
                    parts += [(x, "") for x in ends[final][1]]
                    inserted += len(ends[final][1])
                rows.append((len(own), len(parts), merged, relabelled, inserted, cost, continued + render(parts)))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), *(pa.array(c, pa.int64()) for c in columns[:5]),
                 pa.array(columns[5], pa.float64()), pa.array(columns[6], pa.string())],
                names=["conv_id", "block", "n_in", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"])

    return joined.mapInArrow(rendered, out)
