"""Chat formatting with minimum-cost role repair.

A legal conversation may open with a system turn and then alternates user and assistant turns, from user to assistant.
Dynamic programming over this automaton chooses for every turn to keep it, relabel it, merge it into the turn
before, or put an empty turn in front of it, so that the summed cost is least; then the repaired turns are rendered.

The steps of a stretch of turns compose as 4 x 4 matrices of least costs.  Turns are dealt by (conversation, turn, row)
ranges into chunks, as many as ``CHUNK_ROWS`` and ``CHUNK_BYTES`` ask for, so a conversation of any length spreads over
chunks, and so do turns that are repeated any number of times: every chunk gives one
matrix per conversation, the few conversations that span chunks are routed through their matrices, and every
chunk then repairs its own turns between the states that its route prescribes.

The result has one row per input turn.  ``rendered`` is the turn's part of the conversation; the parts joined in turn
order are the whole text.

Defined results: turns are ordered by number, those without number last, ties by a hash of role and text.  A null text
is empty.  A null or unknown role is relabelled at ``UNKNOWN`` cost.  Turns without conversation id form one
conversation.  Repeated rows are turns of their own.  Other columns are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import only
from quotemill.session import materialize

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # a state is the role of the last turn
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = float("inf")
CHUNK_ROWS, CHUNK_BYTES = 50_000, 16 << 20


@dataclass(frozen=True)
class Costs:
    relabel: float = 2.0
    unknown: float = 1.0  # giving a role to a turn whose own is null or unknown
    merge: float = 1.0
    insert: float = 3.0


@dataclass(frozen=True)
class Template:
    """Text before and after a turn, and between merged texts; ``{role}`` is the repaired role."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    joint: str = "\n"


@dataclass(frozen=True)
class Step:
    cost: float
    to: int
    op: str
    inserted: int = START  # role of the empty turn put in front


def steps(state: int, role: int, costs: Costs) -> list[Step]:
    """What may be done with a turn of a role (0: unknown) after a state, in order of preference among equal costs."""

    def label(to: int) -> float:
        return 0.0 if to == role else costs.relabel if role else costs.unknown

    def name(to: int, op: str) -> str:
        return op if to == role else f"{op}+relabel" if op != "keep" else "relabel"

    out = [Step(label(q), q, name(q, "keep")) for q in LEGAL[state]]
    if state != START:
        out.append(Step(costs.merge + label(state), state, name(state, "merge")))
    for empty in LEGAL[state]:
        out += [Step(costs.insert + label(q), q, name(q, "insert"), empty) for q in LEGAL[empty]]
    return out


def closing(state: int, costs: Costs) -> tuple[float, list[int]]:
    """Cost and roles of the empty turns that end a conversation legally."""
    if state in (START, ASSISTANT):
        return 0.0, []
    if state == USER:
        return costs.insert, [ASSISTANT]
    return 2 * costs.insert, [USER, ASSISTANT]


def role_number(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _best(state_costs: list[float], role: int, table: dict) -> tuple[list[float], list[tuple[int, Step] | None]]:
    """Least cost of each state after one more turn, and the step that gave it."""
    cost, how = [FAR] * 4, [None] * 4
    for s in range(4):
        if state_costs[s] < FAR:
            for step in table[s, role]:
                total = state_costs[s] + step.cost
                if total < cost[step.to]:
                    cost[step.to], how[step.to] = total, (s, step)
    return cost, how


def _table(costs: Costs) -> dict:
    return {(s, r): steps(s, r, costs) for s in range(4) for r in range(4)}


def fold(roles: list[int], table: dict) -> list[float]:
    """The 4 x 4 matrix of least costs of a stretch of turns, row by row."""
    out = []
    for s in range(4):
        cost = [FAR] * 4
        cost[s] = 0.0
        for r in roles:
            cost, _ = _best(cost, r, table)
        out += cost
    return out


def path(roles: list[int], entry: int, leave: int | None, table: dict, costs: Costs) -> list[tuple[int, Step]]:
    """The cheapest steps from an entry state to a given state, or to any state counting its closing turns."""
    cost, trail = [FAR] * 4, []
    cost[entry] = 0.0
    for r in roles:
        cost, how = _best(cost, r, table)
        trail.append(how)
    at = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + closing(s, costs)[0], -s))
    out = []
    for how in reversed(trail):
        out.append(how[at])
        at = how[at][0]
    return out[::-1]


def route(matrices: list[list[float]], costs: Costs) -> list[tuple[int, int]]:
    """Entry and leaving state of each stretch of one conversation on its cheapest way."""
    cost, trail = [0.0, FAR, FAR, FAR], []
    for m in matrices:
        best, back = [FAR] * 4, [0] * 4
        for s in range(4):
            for t in range(4):
                if cost[s] + m[4 * s + t] < best[t]:
                    best[t], back[t] = cost[s] + m[4 * s + t], s
        cost = best
        trail.append(back)
    at = min(range(4), key=lambda s: (cost[s] + closing(s, costs)[0], -s))
    out = []
    for back in reversed(trail):
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def _turns(table: pa.Table) -> dict[str, list[dict]]:
    """Turns of a chunk by conversation, in order."""
    out: dict[str, list[dict]] = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["conv"], r["o"], r["h"])):
        out.setdefault(r["conv"], []).append(r)
    return out


def _fold_chunk(costs: Costs):
    table = _table(costs)

    def run(chunk: pa.Table) -> pa.Table:
        number = chunk.column("chunk")[0].as_py()
        rows = [{"conv": c, "chunk": number, "m": fold([role_number(r["role"]) for r in turns], table)} for c, turns in _turns(chunk).items()]
        return pa.Table.from_pylist(rows, pa.schema([("conv", pa.string()), ("chunk", pa.int32()), ("m", pa.list_(pa.float64()))]))

    return run


def _route_conversation(costs: Costs):
    def run(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: r["chunk"])
        way = route([r["m"] for r in rows], costs)
        out = [{"conv": r["conv"], "chunk": r["chunk"], "entry": a, "leave": b, "first": i == 0, "last": i == len(rows) - 1}
               for i, (r, (a, b)) in enumerate(zip(rows, way))]
        return pa.Table.from_pylist(out, _ROUTE)

    return run


_ROUTE = pa.schema([("conv", pa.string()), ("chunk", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])
_ROUTE_SQL = "conv string, chunk int, entry int, leave int, first boolean, last boolean"
_OUT = pa.schema([("id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("op", pa.string()),
                  ("cost", pa.float64()), ("rendered", pa.string()), ("o", pa.int64()), ("h", pa.int64()), ("k", pa.int64())])
_OUT_SQL = "id long, turn long, role string, new_role string, op string, cost double, rendered string, o long, h long, k long"


def _repair_chunk(costs: Costs, form: Template):
    table = _table(costs)

    def opening(state: int, role: int) -> str:
        return (form.after if state != START else "") + form.before.format(role=ROLES[role - 1])

    def run(chunk: pa.Table, routes: pa.Table) -> pa.Table:
        ways = {r["conv"]: r for r in routes.to_pylist()}
        out, before = [], chunk.column("chunk")[0].as_py() << 32  # turns that are equal may lie in several chunks, in order
        for conv, turns in _turns(chunk).items():
            way = ways.get(conv)
            entry, leave, last = (way["entry"], way["leave"], way["last"]) if way else (START, None, True)
            roles = [role_number(r["role"]) for r in turns]
            for i, (r, (state, step)) in enumerate(zip(turns, path(roles, entry, leave, table, costs))):
                text, cost = r["text"] or "", step.cost
                if step.op.startswith("merge"):
                    text = form.joint + text
                else:
                    if step.inserted:
                        text = opening(state, step.inserted) + opening(step.inserted, step.to) + text
                    else:
                        text = opening(state, step.to) + text
                if last and i == len(turns) - 1:
                    extra, empties = closing(step.to, costs)
                    at = step.to
                    for e in empties:
                        text, at = text + opening(at, e), e
                    text, cost = text + form.after, cost + extra
                out.append({"id": r["id"], "turn": r["turn"], "role": r["role"], "new_role": ROLES[step.to - 1], "op": step.op, "cost": cost,
                            "rendered": text, "o": r["o"], "h": r["h"], "k": before + i})
        return pa.Table.from_pylist(out, _OUT)

    return run


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           costs: Costs = Costs(), form: Template = Template(), chunks: int | None = None) -> DataFrame:
    """One row per turn: conversation, turn, role, ``new_role``, ``op``, ``cost``, ``rendered``, and the order (o, h, k)."""
    spark = turns.sparkSession
    rows = only(turns, id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select(
        F.col("id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("o"),
        F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("h"),
    )
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = chunks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // CHUNK_ROWS), -(-size // CHUNK_BYTES))
    # Repeated turns differ in their place in the table, so that no number of them has to share a chunk.
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(chunks, "conv", "o", "h", "place").drop("place").withColumn("chunk", F.spark_partition_id())
    dealt = materialize(dealt, "chat-turns")
    folds = dealt.select("chunk", "conv", "o", "h", "role").groupBy("chunk").applyInArrow(_fold_chunk(costs), "conv string, chunk int, m array<double>")
    folds = materialize(folds, "chat-folds")
    several = folds.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")
    routes = folds.join(several, "conv").groupBy("conv").applyInArrow(_route_conversation(costs), _ROUTE_SQL)
    fixed = dealt.groupBy("chunk").cogroup(routes.groupBy("chunk")).applyInArrow(_repair_chunk(costs, form), _OUT_SQL)
    return fixed.withColumnRenamed("id", conv_col)


def conversations(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: its repaired text and cost.  For conversations whose text fits a row."""
    part = F.struct("o", "h", "k", "rendered")
    ordered = F.sort_array(F.collect_list(part))
    return repaired.groupBy(conv_col).agg(F.sum("cost").alias("cost"), F.array_join(F.transform(ordered, lambda p: p["rendered"]), "").alias("text"))
