"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in turn, ending with the assistant. A
dynamic program over this automaton decides for every turn whether it opens a turn (as it is, or relabelled, after
empty turns where needed) or is merged into the one before, at least total cost; then the result is rendered.

Turns are range partitioned by conversation and turn, so a very long conversation spreads over many tasks. The cost of
a stretch of turns is a small min-plus matrix (state before, state after); the stretches at the partitions' edges are joined by these
matrices, one per edge, which fixes the states between them, and every task then repairs its stretches on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import starts_of, whole_groups
from polisframe.runtime import checkpointed

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
UNKNOWN = 0
#: Costs: a merge, a new label, a label for an unknown role, an empty turn.
MERGE, RELABEL, LABEL, INSERT = 1, 2, 1, 3
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Names that data sets use for the roles.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT,
         "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
FAR = 1 << 40


def _fill(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns between ``state`` and a turn of ``role``; None if it can't follow at all."""
    paths = [((), state)]
    for _ in range(4):
        for path, at in paths:
            if role in _NEXT[at]:
                return path
        paths = [((*path, n), n) for path, at in paths for n in _NEXT[at] if n != SYSTEM]
    return None


def _step(role: int) -> list[list[tuple[int, str, tuple[int, ...]] | None]]:
    """[state before][state after]: (cost, what is done, empty turns before it) for a turn of ``role``."""
    table: list[list[tuple[int, str, tuple[int, ...]] | None]] = [[None] * 4 for _ in range(4)]
    for q in range(4):
        for x in (SYSTEM, USER, ASSISTANT):
            label = 0 if x == role else LABEL if role == UNKNOWN else RELABEL
            fill = _fill(q, x)
            if fill is not None:
                table[q][x] = (label + INSERT * len(fill), "keep" if not label else "relabel", fill)
            if q == x and (table[q][x] is None or MERGE + label < table[q][x][0]):
                table[q][x] = (MERGE + label, "merge" if not label else "relabel and merge", ())
    return table


STEPS = [_step(r) for r in range(4)]
#: Empty turns that end a conversation legally.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def forward(roles: list[int], entry: int) -> tuple[list[list[int]], list[list[int]]]:
    """Least costs of every state after each turn, from ``entry``, and the states before."""
    costs, back = [[0 if q == entry else FAR for q in range(4)]], []
    for role in roles:
        step, now = STEPS[role], costs[-1]
        best, came = [FAR] * 4, [0] * 4
        for q in range(4):
            if now[q] < FAR:
                for x in range(4):
                    move = step[q][x]
                    if move is not None and now[q] + move[0] < best[x]:
                        best[x], came[x] = now[q] + move[0], q
        costs.append(best)
        back.append(came)
    return costs, back


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[int, list[tuple[int, str, tuple[int, ...]]]]:
    """(state at the end, per turn its role, what is done, the empty turns before it). ``leave``: the state to end in; None:
    the one from which closing is cheapest."""
    costs, back = forward(roles, entry)
    if leave is None:
        leave = min(range(4), key=lambda q: (costs[-1][q] + INSERT * len(CLOSING[q]), q))
    state, out = leave, []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        _, what, fill = STEPS[role][came[state]][state]
        out.append((state, what, fill))
        state = came[state]
    return leave, out[::-1]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, "key"):
        bounds = [*starts_of(np.array(batch.column("key").to_pylist(), object)).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last stretch of the partition with their matrices."""
    first = last = None
    number = 0
    for number, part in enumerate(_stretches(batches), 1):
        last = part
        if first is None:
            first = part
    for order, part in ((0, first), (1, last)):
        if part is not None and not (order and number == 1):
            roles = part.column("kind").to_pylist()
            matrix = [c for q in range(4) for c in forward(roles, q)[0][-1]]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "order": pa.array([order], pa.int32()), "only": [number == 1],
                "key": [part.column("key")[0].as_py()], "matrix": pa.array([matrix], pa.list_(pa.int64()))})


def _plan(edges: list) -> dict[tuple[int, int], tuple[int, int | None]]:
    """(partition, first or last stretch) -> (state before, state after; None: it ends there), for conversations that
    span partitions."""
    runs: list[list] = []
    for e in sorted(edges, key=lambda e: (e["part"], e["order"])):
        if runs and runs[-1][-1]["key"] == e["key"] and runs[-1][-1]["part"] != e["part"]:
            runs[-1].append(e)
        else:
            runs.append([e])
    states: dict[tuple[int, int], tuple[int, int | None]] = {}
    for run in runs:
        if len(run) == 1:
            continue
        cost, came = [0, FAR, FAR, FAR], []
        for e in run:
            options = [[cost[q] + e["matrix"][4 * q + x] for q in range(4)] for x in range(4)]
            came.append([min(range(4), key=lambda q, o=o: (o[q], q)) for o in options])
            cost = [min(min(o), FAR) for o in options]
        leave = min(range(4), key=lambda q: (cost[q] + INSERT * len(CLOSING[q]), q))
        for i in range(len(run) - 1, -1, -1):
            entry = came[i][leave]
            states[run[i]["part"], run[i]["order"]] = (entry, None if i == len(run) - 1 else leave)
            if run[i]["only"]:
                states[run[i]["part"], 1] = states[run[i]["part"], run[i]["order"]]
            leave = entry
    return states


def _open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSE = "<|im_end|>\n"


def rendered(text: str, role: int, what: str, fill: tuple[int, ...], first: bool, closing: tuple[int, ...] | None) -> str:
    """One turn's part of the conversation; the parts of all turns joined are the whole."""
    out = []
    if "merge" in what:
        out.append("\n\n" + text)
    else:
        out += ["" if first else CLOSE, *(_open(r) + CLOSE for r in fill), _open(role) + text]
    if closing is not None:
        out += [CLOSE, *(_open(r) + CLOSE for r in closing)]
    return "".join(out)


def _repaired(batches: Iterator[pa.RecordBatch], states: dict) -> Iterator[pa.RecordBatch]:
    here, number = TaskContext.get().partitionId(), 0
    held, waiting = [], None

    def done(part, order):
        entry, leave = states.get((here, order), (START, None)) if order is not None else (START, None)
        roles, texts = part.column("kind").to_pylist(), part.column("text").to_pylist()
        end, acts = repair(roles, entry, leave)
        closing = CLOSING[end] if leave is None else None
        rows = [(NAMES[x], what, [NAMES[f] for f in fill], rendered(t, x, what, fill, i == 0 and entry == START, closing if i == len(acts) - 1 else None))
                for i, ((x, what, fill), t) in enumerate(zip(acts, texts, strict=True))]
        new, whats, fills, texts = (list(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array(new), pa.array(whats),
                                           pa.array(fills, pa.list_(pa.string())), pa.array(texts, pa.string())], OUT)

    for number, part in enumerate(_stretches(batches)):
        if waiting is not None:
            held.append(done(waiting, 0 if number == 1 else None))
        waiting = part
        if len(held) >= 500:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if waiting is not None:
        held.append(done(waiting, 1 if number or (here, 1) in states else 0))
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else []


OUT = ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"]


def repair_chats(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text): its new role, what was done (keep, relabel, merge,
    relabel and merge), the empty turns inserted before it, and its part of the rendered conversation. The parts of a conversation, in order of turn,
    join to its text; empty turns that close it are in the last part.

    Turns stand by turn, null first, those of one number by role and text. Role names are trimmed, lower-cased and
    known by ``ROLES``; null and others are unknown and take any role at a small cost. A null text is empty. Rows
    without conv_id are one conversation. Repeated rows are turns like others; other columns are ignored; no rows give no rows.
    """
    kind = F.lit(UNKNOWN)
    name = F.lower(F.trim(F.col("role")))
    for n, r in ROLES.items():
        kind = F.when(name == n, r).otherwise(kind)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("kind", kind.cast("int")).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both passes must meet the same partitions
    laid = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), layout=True)
    edges = laid.select("key", "kind").mapInArrow(_edges, "part int, order int, only boolean, key string, matrix array<bigint>").collect()  # two a partition
    states = _plan(edges)
    return laid.mapInArrow(lambda b: _repaired(b, states), "conv_id bigint, turn bigint, role string, new_role string, action string, "
                           "inserted array<string>, rendered string")
