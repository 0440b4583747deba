"""Conversation repair against all edits of short conversations, against SQL, and across batch borders."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexmill.llm import conversation_repair as C
from lexmill.llm import queries
from tests.compare import connect, difference
from tests.llm.fixtures import DATA

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def all_edits(rows):
    """Every edit string of (role, text, fault) rows with at most two insertions in a place: cost, letters, repaired rows."""
    inserted = [(), *[(x,) for x in ("user", "assistant")], ("user", "assistant"), ("assistant", "user")]
    choices = [[(5 * len(x), "I" * len(x), tuple((r, "") for r in x)) for x in inserted]]
    for role, text, fault in rows:
        late = 5 if fault == "truncated" else 0
        one = [(2, "D", ())]
        if fault not in ("blank", "duplicate"):
            one += [(late, "K", ((role, text),)), *[(1 + late, "R", ((r, text),)) for r in ("user", "assistant")]]
        choices += [one, choices[0]]
    for parts in itertools.product(*choices):
        made = [r for _, _, x in parts for r in x]
        if re.fullmatch("(s?(ua)+)?", "".join((r or " ")[:1] for r, _ in made)):
            yield sum(c for c, _, _ in parts), "".join(x for _, x, _ in parts), made


def brute(rows):
    """What one conversation's damaged rows, in order, give."""
    seen, faulty = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    cost, audit, made = min(all_edits(faulty))
    return [sum(f == x for _, _, f in faulty) for x in C.FAULTS], cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


@pytest.mark.parametrize("batch", [1, 7, C.BATCH_TURNS])
def test_repair_is_the_cheapest_of_all_edits(spark, monkeypatch, batch):
    monkeypatch.setattr(C, "BATCH_TURNS", batch)
    rng = random.Random(4)
    rows = [(c, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "usher", "", None]), rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "漢字? \t"])) for c in [*range(60), None] for t in range(rng.randrange(1, 4))]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damaged=True).collect()}
    by_id = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        by_id[r[0]].append(r)
    assert got.keys() == by_id.keys()
    for c, mine in by_id.items():
        faults, cost, audit, digest = brute([r[2:] for r in mine])
        r, turns = got[c], [x[1] for x in mine if x[1] is not None]
        pairs = [f"{a[2][:1]}{b[2][:1]}" for a, b in itertools.pairwise(mine)]
        assert [r.blank, r.duplicate, r.truncated, r.cost, r.audit, r.repaired_sha256] == [*faults, cost, audit, digest], mine
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_whole_table_equals_sql(spark):
    assert difference(queries.QUERIES["op11_conversation_repair"](spark, DATA), connect(DATA), queries.ORACLE_SQL["op11_conversation_repair"]) is None


def test_one_long_conversation_goes_over_many_batches(spark, monkeypatch):
    """As many rows as many batches take, against a walk over single rows; a conversation that holds most rows."""
    monkeypatch.setattr(C, "BATCH_TURNS", 50)
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', '', '!'])}") for t in range(700)] + [(c, 0, "user", "Hi.") for c in range(10) if c != 5]
    best = {0: (0, "")}

    def closed(states):
        for s in (0, 1, 2, 3, 2, 3):
            if s in states:
                after = C.NEXT[s][1]
                states[after] = min(states.get(after, (9e9, "")), (states[s][0] + 5, states[s][1] + "I"))
        return states

    best = closed(best)
    for _, _, role, text in rows[:700]:
        late, new = 0 if text[-1] in ".!" else 5, {}
        for s, (cost, letters) in best.items():
            steps = [(s, 2, "D"), (C.NEXT[s][1], 1 + late, "R")]
            steps += [(C.NEXT[s][1], late, "K")] if C.NEXT[s][0] == role else [(1, late, "K")] if s == 0 and role == "system" else []
            for to, price, letter in steps:
                new[to] = min(new.get(to, (9e9, "")), (cost + price, letters + letter))
        best = closed(new)
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[5].cost, got[5].audit) == min(best[s] for s in (0, 3) if s in best)
    assert got[1].audit == "D" and got[1].cost == 2


def test_other_columns_and_empty_tables(spark):
    kind = "conv_id string, turn int, role string, text string, place long, gone string, fault string, edits string, cost double"
    assert C.repair(spark.createDataFrame([], kind)).collect() == []
    (one,) = C.repair(spark.createDataFrame([("x", 1, "user", "Well.", 3, "g", "f", "e", 0.5), ("x", 2, "assistant", "y " * 200_000 + ".", 3, "g", "f", "e", 0.5)], kind)).collect()
    assert (one.conv_id, one.audit, one.cost, one.gaps) == ("x", "KK", 0, 0)
