"""Conversation repair against an enumeration of all edits and against a plain pass over the rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from tillroll.llm import repair
from tillroll.llm.repair import _as_structs, block_items, joined_items, lightest, repaired_conversations

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, uid string, audit string, block int, conv string"


def enumerated(initials, faults):
    """Every edit script with at most two inserts before each row and behind the last."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for initial, fault in zip(initials, faults):
        extra = 5 if fault == "t" else 0
        row = [(2, "D", "")]
        if fault not in "bd":
            row += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices.append([(5 * len(i) + c, "I" * len(i) + a, i + r) for i in inserts for c, a, r in row])
    choices.append([(5 * len(i), "I" * len(i), i) for i in inserts])
    best = None
    for script in product(*choices):
        if GRAMMAR.fullmatch("".join(r for _, _, r in script)):
            one = (sum(c for c, _, _ in script), "".join(a for _, a, _ in script))
            best = one if best is None or one < best else best
    return best


def best_of(items):
    return min((item[0], item[1]) for p, q, item in items if p == repair.START and q in repair.FINAL)


def test_lightest_against_all_scripts():
    rng = random.Random(7)
    cases = [("", ""), ("a", "."), ("ssu", "..."), ("?", "t"), ("sau", "tb.")]
    cases += [("".join(rng.choice("suaa?u") for _ in range(n)), "".join(rng.choice("...tbd") for _ in range(n))) for n in (1, 2, 3) for _ in range(25)]
    for initials, faults in cases:
        assert best_of(block_items(initials, faults)) == enumerated(initials, faults), (initials, faults)


def test_blocks_put_together_are_the_whole():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 40)
        initials = "".join(rng.choice("suaua?") for _ in range(n))
        faults = "".join(rng.choice("....tbd") for _ in range(n))
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(4))})
        parts = [block_items(initials[a:b], faults[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert sorted(joined_items(parts)) == sorted(block_items(initials, faults))


def test_agenda_pops_costs_in_order():
    seen = []

    def rules(at, state):
        seen.append(at)
        if at < 3:
            yield at + 1, state, (3 - at, "x", "-")
            yield at + 1, state, (9, "a", "-")
    assert lightest(3, 0, rules) == {0: (6, "xxx", "---")} and seen == [0, 1, 2, 3]
    assert _as_structs([(0, 1, (2, "a", "u"))]) == [{"p": 0, "q": 1, "cost": 2, "audit": "a", "plan": "u"}]


def expected(rows):
    """A plain pass from the first row to the last; ``rows`` as given to the operator."""
    sp = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        old = (sp(role), hashlib.sha256(sp(text).encode()).hexdigest())
        text = "" if kind == 1 else re.sub("[.!?]", "", sp(text)) if kind == 2 else sp(text)
        done = ("user" if kind == 4 else sp(role), text)
        by[conv] += [((turn is not None, turn or 0, *old, c), turn, *done) for c in range({0: 0, 3: 2}.get(kind, 1))]
    out = {}
    for conv, found in by.items():
        found.sort()
        seen, faults = set(), ""
        for _, _, role, text in found:
            if not re.search(r"[^\x20\x09-\x0d]", text):
                faults += "b"
            elif (role, text) in seen:
                faults += "d"
            else:
                faults += "." if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(r[:1] if r[:1] and r[:1] in "sua" else "?" for _, _, r, _ in found)
        cost, audit, plan = min(i for p, q, i in block_items(initials, faults) if p == 0 and q in (0, 3))
        lines, at = [], 0
        for letter, role in zip(audit, plan):
            full = {"u": "user", "a": "assistant"}.get(role)
            if letter == "I":
                lines.append(f"{full}:")
                continue
            if letter != "D":
                lines.append(f"{found[at][2] if letter == 'K' else full}:{found[at][3]}")
            at += 1
        turns = [t for _, t, _, _ in found if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
                     sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(seed=4, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Hi there.", "ok", "Yes! \n", None, "", " \t", "É 漢字?", "a.b", "x" * 3000 + "."])))
    rows += [(7, None, "user", "no turn."), (7, None, "user", "no turn."), (None, 1, "user", "no id."), (None, None, None, None)]
    rows += rows[:5]  # repeated rows
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else "again") for t in range(1200)]  # a long one
    rows += [(901, None, "assistant", "x"), (902, 5, "user", "one.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block, fan_in", [(512, 64), (4, 3)])
def test_reports_match_a_plain_pass(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(repair, "FAN_IN", fan_in)
    rows = rows_of()
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repaired_conversations(frame(spark, rows)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got.keys() == {r[0] for r in rows}
    assert got == {conv: want.get(conv, nothing) for conv in got}


def test_empty_table(spark):
    assert repaired_conversations(frame(spark, [])).collect() == []


def test_rows_carry_their_edits(spark):
    turns = repair.damage(frame(spark, rows_of(convs=20)))
    report, rows = repair.repair(turns)
    assert rows.count() == turns.count()
    letters = {r.conv: "".join(x for x in r.audit) for r in report.collect()}
    for conv, found in {r.conv: r for r in rows.collect()}.items():
        assert set(found.edits[0::2]) <= set("KRDI") and conv in letters
