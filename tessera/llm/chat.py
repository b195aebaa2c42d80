"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and
assistant turns in alternation, user first and assistant last.  Repairs are:
merge a turn into the one before, relabel it, or insert empty turns.  Dynamic
programming over the automaton's states finds the cheapest repair.

Costs from state to state form a small matrix for every stretch of turns, and
matrices of neighbouring stretches combine (by minimum and plus).  So a long
conversation is handled in blocks: each block's matrix, then the states at
block borders, then each block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import own_columns, staged

ROLES = ("system", "user", "assistant")
#: Costs of repairs.
MERGE, RELABEL, INSERT = 1, 2, 3
#: Turn numbers of a block, and the most rows it has before it is split further.
BLOCK_TURNS, BLOCK_ROWS = 256, 4096

_FAR = 1 << 40
# States: nothing yet, after a system, a user, an assistant turn.
_STATES = 4
_INSERTED: dict[tuple[int, int], tuple[int, ...]] = {
    (0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,), (2, 3): (), (3, 2): (),
}
_ENDING: dict[int, tuple[int, ...]] = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def _moves(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of a turn with this role."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for to in (1, 2, 3):
        label = 0 if to == own else RELABEL
        out += [(s, to, label + INSERT * len(between), False) for (s, t), between in _INSERTED.items() if t == to]
        out.append((to, to, label + MERGE, True))
    return out


_MOVES = {role: _moves(role) for role in (*ROLES, None)}


def _step(cost: list[int], role: str | None) -> tuple[list[int], list[tuple[int, bool]]]:
    new, back = [_FAR] * _STATES, [(0, False)] * _STATES
    for s, t, c, merged in _MOVES[role if role in ROLES else None]:
        if cost[s] + c < new[t]:
            new[t], back[t] = cost[s] + c, (s, merged)
    return new, back


def _run(cost: list[int], roles: list[str | None]) -> tuple[list[int], list[list[tuple[int, bool]]]]:
    backs = []
    for role in roles:
        cost, back = _step(cost, role)
        backs.append(back)
    return cost, backs


def _start(state: int) -> list[int]:
    return [0 if s == state else _FAR for s in range(_STATES)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, list[int]] = {}
        costs = []
        for turns in batch.column("roles").to_pylist():
            key = tuple(turns)
            if key not in known:
                known[key] = [c for s in range(_STATES) for c in _run(_start(s), turns)[0]]
            costs.append(known[key])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each block on the cheapest way through a conversation."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for conv, parts in zip(batch.column("conv").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            cost, backs = _start(0), []
            for p in parts:
                best = [min((cost[s] + p["costs"][s * _STATES + t], s) for s in range(_STATES)) for t in range(_STATES)]
                cost, back = [b[0] for b in best], [b[1] for b in best]
                backs.append(back)
            total, state = min((cost[s] + INSERT * len(_ENDING[s]), s) for s in range(_STATES))
            rows = []
            for p, back in zip(reversed(parts), reversed(backs), strict=True):
                rows.append((p["block"], back[state], state))
                state = back[state]
            for block, before, after in rows:
                for to, value in zip(out, (conv, block, before, after, total), strict=True):
                    to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], batch.schema.field("parts").type.value_type.field("block").type), *(pa.array(x, pa.int64()) for x in out[2:])], names=["conv", "block", "before", "after", "total"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for row in batch.to_pylist():
            turns = row["turns"]
            _, backs = _run(_start(row["before"]), [t["role"] for t in turns])
            states, state = [], row["after"]
            for back in reversed(backs):
                states.append((state, *back[state]))
                state = back[state][0]
            n_merged = n_relabelled = n_inserted = 0
            made: list[tuple[str, str]] = []
            joins = False
            for t, (to, from_, merged) in zip(turns, reversed(states), strict=True):
                n_relabelled += t["role"] != ROLES[to - 1]
                text = t["text"] or ""
                if merged:
                    n_merged += 1
                    if made:
                        made[-1] = made[-1][0], f"{made[-1][1]}\n{text}"
                    else:  # into the last turn of the block before
                        joins = True
                        made.append((ROLES[to - 1], text))
                    continue
                for r in _INSERTED[from_, to]:
                    n_inserted += 1
                    made.append((ROLES[r - 1], ""))
                made.append((ROLES[to - 1], text))
            if row["last"]:
                for r in _ENDING[row["after"]]:
                    n_inserted += 1
                    made.append((ROLES[r - 1], ""))
            rendered = "<|end|>\n".join("\n" + x if joins and not k else f"<|{r}|>\n{x}" for k, (r, x) in enumerate(made))
            # The next block may go on with this one's last turn, so it closes it if it does not.
            rendered = ("" if row["first"] or joins else "<|end|>\n") + rendered + ("<|end|>\n" if row["last"] else "")
            for to, value in zip(out, (row["conv"], row["block"], len(turns), n_merged, n_relabelled, n_inserted, row["total"], rendered, [{"role": r, "text": x} for r, x in made], joins), strict=True):
                to.append(value)
        i = pa.int64()
        types = (i, batch.schema.field("block").type, i, i, i, i, i, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.bool_())
        names = ["conv", "block", "n_turns", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered", "turns", "continues"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repair and render conversations.

    Returns one row per block of a conversation, nearly always one per
    conversation: conv, block (ascending; rendered texts of a conversation's
    blocks follow one another), n_turns, n_merged, n_relabelled, n_inserted,
    cost (of the whole conversation), rendered, turns (role and text),
    continues (the block's first turn goes on with the last one of the block
    before).  `repaired_turns` has a row for each turn instead, whatever the
    length of its conversation.

    Turns are taken by number, null first; ties by a hash of role and text.
    Any role but system, user and assistant is unknown and must be relabelled;
    a null text is empty.  Rows with a null conversation are one conversation.
    An empty table gives no rows.  Other columns are ignored.
    """
    source = own_columns(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("tie", F.xxhash64("role", "text"))
    source = source.withColumn("wide", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK_TURNS))
    heavy = staged(source.groupBy("conv", "wide").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select(F.col("conv").alias("c"), F.col("wide").alias("w")), "heavy")
    source = source.join(heavy, F.col("conv").eqNullSafe(F.col("c")) & (F.col("wide") == F.col("w")), "left")
    fine = F.col("w").isNotNull()
    block = F.struct("wide", F.when(fine, F.coalesce("turn", F.lit(-1))).otherwise(F.lit(0)).cast("long").alias("turn"), F.when(fine, F.shiftright("tie", 54)).otherwise(F.lit(0)).cast("long").alias("part"))
    blocks = source.withColumn("block", block).groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("turns"))
    blocks = staged(blocks, "blocks")
    where = "struct<wide:bigint,turn:bigint,part:bigint>"
    costs = blocks.select("conv", "block", F.expr("transform(turns, t -> t.role)").alias("roles")).mapInArrow(_matrices, f"conv long, block {where}, costs array<long>")
    parts = costs.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("parts"))
    borders = parts.mapInArrow(_borders, f"conv long, block {where}, before long, after long, total long")
    borders = staged(borders, "borders")
    ends = borders.groupBy("conv").agg(F.min("block").alias("begin"), F.max("block").alias("end")).select(F.col("conv").alias("c"), "begin", "end")
    borders = borders.join(ends, F.col("conv").eqNullSafe(F.col("c")))
    borders = borders.select(F.col("conv").alias("of"), F.col("block").alias("at"), "before", "after", "total", (F.col("block") == F.col("begin")).alias("first"), (F.col("block") == F.col("end")).alias("last"))
    joined = blocks.join(borders, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    joined = joined.select("conv", "block", "before", "after", "total", "first", "last", "turns")
    return joined.mapInArrow(_repaired, f"conv long, block {where}, n_turns long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string, turns array<struct<role:string,text:string>>, continues boolean")


def repaired_turns(chats: DataFrame) -> DataFrame:
    """The turns of repaired conversations, a row each: conv, block, place (from 1 within its block), role, text, continues, cost.

    In the order of block and place they are the conversation; a row that continues belongs to
    the turn before it, behind a line end.  The rows depend on the turns alone, so that a
    conversation of any length is in rows of the same kind, and none is gathered.
    """
    rows = chats.select("conv", "block", "cost", F.col("continues").alias("first"), F.posexplode("turns").alias("place", "turn"))
    return rows.select("conv", "block", (F.col("place") + 1).alias("place"), "turn.role", "turn.text", (F.col("first") & (F.col("place") == 0)).alias("continues"), "cost")
