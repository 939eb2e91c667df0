import random

import pytest

from quotemill.llm import chat as C
from quotemill.llm.common import prepare

TURNS = "conv_id long, turn long, role string, text string, op string"


def cheapest(roles, costs):
    """All ways, tried one by one."""
    best = [C.FAR]

    def go(i, state, cost):
        if i == len(roles):
            best[0] = min(best[0], cost + C.closing(state, costs)[0])
            return
        for to in (C.SYSTEM, C.USER, C.ASSISTANT):
            label = 0 if to == roles[i] else costs.relabel if roles[i] else costs.unknown
            if to in C.LEGAL[state]:
                go(i + 1, to, cost + label)
            if state == to:
                go(i + 1, to, cost + costs.merge + label)
            for empty in C.LEGAL[state]:
                if to in C.LEGAL[empty]:
                    go(i + 1, to, cost + costs.insert + label)

    go(0, C.START, 0.0)
    return best[0]


def legal(text, form=C.Template()):
    """Roles of a rendered conversation follow the automaton."""
    state = C.START
    for part in text.split("<|end|>\n")[:-1]:
        role = C.ROLES.index(part[2 : part.index("|>")]) + 1
        assert role in C.LEGAL[state]
        state = role
    return state == C.ASSISTANT


@pytest.fixture(scope="module")
def some(spark):
    rnd, rows, roles = random.Random(6), [], {}
    for k in range(40):
        names = [rnd.choice([None, "system", "user", "assistant", "assistant", "user", "bot"]) for _ in range(rnd.randint(1, 6))]
        roles[k] = [C.role_number(r) for r in names]
        rows += [(k, i * 3, r, f"{k}.{i}", "x") for i, r in enumerate(names)]
    rnd.shuffle(rows)
    return prepare(spark).createDataFrame(rows, TURNS), roles


@pytest.mark.parametrize("chunks", [1, 9, 60])
@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(relabel=5, unknown=0.5, merge=2, insert=1)])
def test_cost_is_the_least_and_the_result_legal(some, chunks, costs):
    turns, roles = some
    fixed = C.repair(turns, costs=costs, chunks=chunks)
    got = {r.conv_id: r for r in C.conversations(fixed).collect()}
    assert {k: r.cost for k, r in got.items()} == {k: cheapest(v, costs) for k, v in roles.items()}
    for k, r in got.items():
        assert legal(r.text) and all(f"{k}.{i}" in r.text for i in range(len(roles[k])))


def test_legal_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", "")]
    got = C.conversations(C.repair(spark.createDataFrame(rows, TURNS))).first()
    assert got.cost == 0 and got.text == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"


def test_merge_relabel_and_insertion(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", ""), (2, 0, "assistant", "hi", ""), (3, 0, "user", "q", "")]
    got = {(r.conv_id, r.turn): r for r in C.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1, 1].op == "merge" and got[1, 1].rendered == "\nb" and got[1, 2].op == "keep"
    assert got[2, 0].op == "insert" and got[2, 0].rendered == "<|user|>\n<|end|>\n<|assistant|>\nhi<|end|>\n"
    assert got[3, 0].cost == 3 and got[3, 0].rendered.endswith("q<|end|>\n<|assistant|>\n<|end|>\n")
    two = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", "")], TURNS)
    assert [r.op for r in C.repair(two).orderBy("turn").collect()] == ["keep", "relabel"]  # cheaper than a merge and an empty answer


def test_one_long_conversation_spreads_over_chunks(spark):
    n = 3000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 7 = 0, 'assistant', IF(id % 2 = 0, 'user', 'assistant')) AS role", "'t' AS text")
    a, b = C.repair(turns, chunks=1), C.repair(turns, chunks=16)
    assert a.agg({"cost": "sum"}).first()[0] == b.agg({"cost": "sum"}).first()[0]
    assert legal(C.conversations(b).first().text) and b.count() == n


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "a", ""), (None, 1, "assistant", None, ""), (5, None, "assistant", "late", ""), (5, 3, "user", "x" * 200_000, ""),
            (6, 0, None, None, ""), (7, 1, "user", "same", ""), (7, 1, "user", "same", "")]
    fixed = C.repair(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in C.conversations(fixed).collect()}
    assert fixed.count() == len(rows) and got[None].cost == 0 and got[5].cost == 0 and got[5].text.endswith("late<|end|>\n")
    assert got[6].cost == 4 and got[7].cost == 2 and all(legal(r.text) for r in got.values())
    assert C.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_repeated_turns_spread_over_chunks(spark, monkeypatch):
    """A third of all turns is one and the same row; no chunk holds more than its share of them."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 100)
    same = [(1, None, "user", "again")] * 1000
    rows = same + [(i, t, r, f"{i} {t}") for i in range(2, 502) for t, r in enumerate(["system", "user", "assistant", "user"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    sizes, kept = [], C.materialize

    def watched(df, label):
        out = kept(df, label)
        if label == "chat-turns":
            sizes.extend(r["count"] for r in out.groupBy("chunk").count().collect())
        return out

    monkeypatch.setattr(C, "materialize", watched)
    got = C.repair(turns).filter("conv_id = 1").groupBy("op").count().collect()
    assert len(sizes) >= 25 and max(sizes) < 400
    assert {r.op: r["count"] for r in got} == {"keep": 1, "merge": 998, "relabel": 1}  # the last one answers
