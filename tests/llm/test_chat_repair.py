"""Conversation repair against a layered plain version, and its edges."""

import hashlib
import random

import pytest

from tallyrack.llm import chat_repair as C

FIELDS = "conv_id long, turn long, role string, text string"
BLANK = set("\t\n\x0b\x0c\r ")


def plain_edits(turns):
    """Least (cost, audit) layer by layer, with whole audit strings."""
    def closed(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                to = C.AFTER[C.WANTED[state][0]]
                now[to] = min(now.get(to, (9**9, "")), (cost + 5, audit + "I"))
        return now

    now = closed({C.START: (0, "")})
    for initial, must_go, cut in turns:
        after = {}
        for state, (cost, audit) in now.items():
            moves = [(state, cost + 2, "D")]
            if not must_go:
                wanted = C.WANTED[state][0]
                moves.append((C.AFTER[wanted], cost + 1 + 5 * cut, "R"))
                if initial == wanted or (initial == "s" and state == C.START):
                    moves.append((C.AFTER[initial], cost + 5 * cut, "K"))
            for to, price, letter in moves:
                after[to] = min(after.get(to, (9**9, "")), (price, audit + letter))
        now = closed(after)
    return min(now[s] for s in (C.START, C.ASSISTANT) if s in now)


def plain(rows):
    """Counts, audit and repaired turns of one conversation's rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for k, (_, role, text) in enumerate(rows):
        solid = [c for c in text if c not in BLANK]
        blank, again, cut = not solid, (role, text) in seen, not solid or solid[-1] not in ".!?"
        seen.add((role, text))
        if blank or again or cut:
            counts["blank" if blank else "duplicate" if again else "truncated"] += 1
        counts["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns.append((role[:1], blank or again, cut))
    cost, audit = plain_edits(turns)
    kept = {t for t, _, _ in rows if t is not None}
    gaps = max(kept) - min(kept) + 1 - len(kept) if kept else 0
    left, out, user = list(rows), [], False
    for e in audit:
        _, role, text = (None, None, "") if e == "I" else left.pop(0)
        if e == "D":
            continue
        role = role if e == "K" else "assistant" if user else "user"
        user = role[0] == "u"
        out.append(f"{role}:{text}")
    return {"gaps": gaps, **counts, "cost": cost, "audit": audit}, out


def test_search_equals_layers():
    rng = random.Random(1)
    for n in [*range(9)] * 40 + [60, 300]:
        turns = [(rng.choice("suatu"), rng.random() < 0.25, rng.random() < 0.3) for _ in range(n)]
        assert C.cheapest_edits(turns) == plain_edits(turns)


def test_long_conversation_of_ties():
    cost, audit = C.cheapest_edits([("u", False, False)] * 20_000)
    assert (cost, len(audit)) == (10_000, 20_000) and audit == "KR" * 10_000


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(7)
    texts = ["Yes.", "no", "", " \t", None, "Why?", "A long tale" * 3000, "a.\n", "b!\x0b "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    return {c: [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 9))] for c in [None, *range(60)]}


def test_repair_equals_plain(spark, conversations):
    rows = spark.createDataFrame([(c, *r) for c, v in conversations.items() for r in v], FIELDS).selectExpr("*", "1 AS kind", "2 AS plan", "3 AS digest", "4 AS audit").repartition(3)
    plans = C.plan_repairs(rows)
    got = {r["conv_id"]: r.asDict() for r in C.repair_digests(rows, plans).collect()}
    turns: dict = {}
    for r in C.repaired_turns(rows, plans).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert set(got) == set(conversations)
    for c, v in conversations.items():
        want, out = plain(v)
        assert {k: got[c][k] for k in want} == want
        assert turns.get(c, []) == out and got[c]["repaired_sha256"] == hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_no_rows_and_dropped_rows(spark, tmp_path):
    none = spark.createDataFrame([], FIELDS)
    assert C.repair_digests(none, C.plan_repairs(none)).count() == 0 and C.repaired_turns(none, C.plan_repairs(none)).count() == 0
    import zlib

    drop = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(drop, 0, "user", "Hi."), (None, None, None, None)], FIELDS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in C.op12_chat_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {drop, None}
    assert tuple(got[drop])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
