"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system message and then user and assistant messages in
turn, from a user's to an assistant's. A turn may be merged into the message before it, given
another role, or preceded by an empty message; an empty message may end the conversation. The
repair of least total cost is found by dynamic programming over the states of the automaton.

A turn's effect is a small matrix of costs between states, and such matrices combine, so a
conversation of any length is repaired in pieces: turns are dealt to ranges in order, a range
sums up the conversations that cross its borders in one matrix each, the matrices of a
conversation are combined in order, and each range then repairs its turns between the states
it was given. Rendering is piecewise as well: the pieces of a conversation's turns, put
together in order, are the rendered conversation.

Defined results: roles are compared without case and outer spaces, and known other names are
understood; a null or unknown role may take any role at a low cost; a null text is empty;
turns with equal numbers are ordered by role, then text, repeated rows stay; a null number comes last; turns without a
conversation id are one conversation; of repairs that cost the same, the first in the order
keep, merge, relabel, insert is taken. An empty table gives no rows. Markers inside a text
are broken up, so a text cannot end its message.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import settle

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
#: Other names of the roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
         "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
#: Empty messages that a conversation needs to end in each state.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NEVER = 1 << 40


def role_of(name: str | None) -> int | None:
    return NAMES.get(name.strip().lower()) if name else None


def _moves() -> dict:
    """Per role (None: unknown) and state: the best (cost, action, inserted, state after) for
    every state after, options in order of preference."""
    table = {}
    for role in (None, SYSTEM, USER, ASSISTANT):
        def change(q: int, role=role) -> int:
            return UNKNOWN if role is None else 0 if q == role else RELABEL

        for s in NEXT:
            best: dict[int, tuple] = {}
            options = [(change(q), "relabel" if change(q) else "keep", (), q) for q in NEXT[s]]
            if s != START:
                options.insert(1, (MERGE + change(s), "merge", (), s))
            for p in NEXT[s]:
                options += [(INSERT + change(q), "insert", (p,), q) for q in NEXT[p]]
            for option in options:
                q = option[3]
                if q not in best or option[0] < best[q][0]:
                    best[q] = option
            table[role, s] = best
    return table


MOVES = _moves()


def ending_cost(state: int) -> int:
    return INSERT * len(ENDING[state])


def matrix(roles: list[int | None]) -> list[list[int]]:
    """Least cost from every state to every state over the turns."""
    rows = [[0 if s == q else NEVER for q in range(4)] for s in range(4)]
    for role in roles:
        out = []
        for row in rows:
            new = [NEVER] * 4
            for s, cost in enumerate(row):
                if cost < NEVER:
                    for q, move in MOVES[role, s].items():
                        new[q] = min(new[q], cost + move[0])
            out.append(new)
        rows = out
    return rows


def combine(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(NEVER, *(a[s][m] + b[m][q] for m in range(4))) for q in range(4)]
            for s in range(4)]


def repair(roles: list[int | None], entry: int = START, leave: int | None = None) -> list[tuple]:
    """(action, inserted, state after) per turn, at least total cost. `leave`: the state the
    turns must end in; without it they end where the conversation ends cheapest."""
    costs = [NEVER] * 4
    costs[entry] = 0
    steps: list[list] = []
    for role in roles:
        new, came = [NEVER] * 4, [None] * 4
        for s in range(4):
            if costs[s] < NEVER:
                for q, move in MOVES[role, s].items():
                    if costs[s] + move[0] < new[q]:
                        new[q], came[q] = costs[s] + move[0], (s, move)
        costs = new
        steps.append(came)
    if leave is None:
        leave = min(range(4), key=lambda s: costs[s] + ending_cost(s))
    out = []
    for came in reversed(steps):
        leave_from, move = came[leave]
        out.append((move[1], move[2], leave))
        leave = leave_from
    return out[::-1]


def _message(role: int, text: str) -> str:
    return f"{OPEN}{ROLES[role]}\n{text}"


def render(step: tuple, text: str | None, first: bool, last: bool) -> str:
    """The piece of a turn. It closes the message before it if it opens another; the last
    turn's piece closes the conversation."""
    action, inserted, state = step
    text = (text or "").replace("<|", "< |")
    if action == "merge":
        piece = "\n" + text
    else:
        piece = "" if first else CLOSE
        piece += "".join(_message(r, "") + CLOSE for r in inserted) + _message(state, text)
    if last:
        piece += CLOSE + "".join(_message(r, "") + CLOSE for r in ENDING[state])
    return piece


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows of one conversation (column 0) and range (column 1)."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][:2] != row[:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _crossing(turns: DataFrame, kind: str) -> DataFrame:
    """Per range, its first and its last conversation: their matrix over the range's turns.
    A conversation that is neither lies wholly in the range."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(run: list[tuple]) -> tuple:
            costs = matrix([role_of(t[2]) for t in run])
            return run[0][0], run[0][1], [x for r in costs for x in r]

        found, part, last = [], None, None
        for run in _runs(batches):
            if run[0][1] != part:
                if last is not None:
                    found.append(row(last))
                part, last = run[0][1], None
                found.append(row(run))
            else:
                last = run
        if last is not None:
            found.append(row(last))
        columns = list(zip(*found)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], _arrow(kind)), pa.array(columns[1], pa.int32()),
             pa.array(columns[2], pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])

    return turns.select("conv_id", "part", "role").mapInArrow(
        work, f"conv_id {kind}, part int, costs array<long>")


def _borders(crossing: DataFrame, kind: str) -> DataFrame:
    """Per range, the conversations it shares with others: entry and exit state, and whether
    it has the last turns. A conversation has as many rows here as it has ranges."""
    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "costs"))))
        matrices = [[list(c[4 * s:4 * s + 4]) for s in range(4)] for _, c in rows]
        # costs[i][s]: least cost of the ranges before i when they end in state s.
        costs = [[0, NEVER, NEVER, NEVER]]
        for m in matrices:
            costs.append([min(costs[-1][s] + m[s][q] for s in range(4)) for q in range(4)])
        state = min(range(4), key=lambda s: costs[-1][s] + ending_cost(s))
        states = [state]
        for m, before in zip(reversed(matrices), reversed(costs[:-1])):
            state = min(range(4), key=lambda s, m=m, before=before, q=state: before[s] + m[s][q])
            states.append(state)
        states.reverse()
        n = len(rows)
        conv = table.column("conv_id").to_pylist()[0]
        return pa.table({
            "conv_id": pa.array([conv] * n, _arrow(kind)), "part": pa.array([r[0] for r in rows], pa.int32()),
            "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()),
            "first": pa.array([i == 0 for i in range(n)]),
            "last": pa.array([i == n - 1 for i in range(n)])})

    return (crossing.groupBy("conv_id").applyInArrow(
        solve, f"conv_id {kind}, part int, entry int, leave int, first boolean, last boolean")
        .filter("NOT (first AND last)"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, n_inserted (empty messages put
    before the turn or, for the last, behind it) and rendered (the turn's piece). `place` gives
    the order of all rows."""
    spark = turns.sparkSession
    kind = turns.schema[conv_id].dataType.simpleString()
    turn_kind = turns.schema[turn].dataType.simpleString()
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.asc_nulls_first("role"),
             F.asc_nulls_first("text")]
    dealt = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("part", F.spark_partition_id())
                   .withColumn("place", F.monotonically_increasing_id()), "chat-turns")

    roles = (dealt.select("conv_id", "part", "role", "place").repartition(n, "part")
             .sortWithinPartitions("part", "place"))
    borders = _borders(_crossing(roles, kind), kind)
    # At most two conversations of a range cross its borders.
    known = borders.groupBy("part").agg(F.collect_list(F.struct(
        "conv_id", "entry", "leave", "first", "last")).alias("borders"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            conv, _, borders = run[0][:3]
            border = next((b for b in borders or [] if b["conv_id"] == conv), None)
            entry, leave = (border["entry"], border["leave"]) if border else (START, None)
            begins, ends = (border["first"], border["last"]) if border else (True, True)
            steps = repair([role_of(t[4]) for t in run], entry, leave)
            out = []
            for i, (t, step) in enumerate(zip(run, steps)):
                last = ends and i == len(run) - 1
                out.append((conv, t[3], t[6], t[4], ROLES[step[2]], step[0],
                            len(step[1]) + (len(ENDING[step[2]]) if last else 0),
                            render(step, t[5], begins and i == 0, last)))
            kinds = (_arrow(kind), _arrow(turn_kind), pa.int64(), pa.string(), pa.string(),
                     pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                names=["conv_id", "turn", "place", "role", "new_role", "action", "n_inserted",
                       "rendered"])

    joined = (dealt.join(known, "part", "left").repartition(n, "part")
              .sortWithinPartitions("part", "place")
              .select("conv_id", "part", "borders", "turn", "role", "text", "place"))
    return joined.mapInArrow(work, (
        f"conv_id {kind}, turn {turn_kind}, place long, role string, new_role string, "
        "action string, n_inserted int, rendered string"))
