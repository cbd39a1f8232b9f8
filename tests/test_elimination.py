"""Marginals by elimination against enumeration of all worlds."""

import itertools
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyrack.operators import elimination as E
from tallyrack.operators.elimination import marginals

PRIORS = "model_id long, fact long, false_weight long, true_weight long"
FACTORS = "model_id long, factor_id long, scope array<long>, weights array<long>, hard boolean, dependence string"


def plain(priors, factors):
    """fact -> (mass_true, mass) over all worlds."""
    facts, out = sorted(priors), {}
    for world in itertools.product((0, 1), repeat=len(facts)):
        at = dict(zip(facts, world, strict=True))
        mass = 1
        for f in facts:
            mass *= priors[f][at[f]]
        for scope, table in factors:
            mass *= table[sum(at[f] << k for k, f in enumerate(scope))]
        for f in facts:
            yes, total = out.get(f, (0, 0))
            out[f] = (yes + mass * at[f], total + mass)
    return out


def solved(spark, priors, factors, **how):
    rows = marginals(spark.createDataFrame(priors, PRIORS), spark.createDataFrame(factors, FACTORS), **how).collect()
    return {(r["model_id"], r["fact"]): (r["status"], r["mass_true"] and int(r["mass_true"]), r["mass"] and int(r["mass"])) for r in rows}


def test_equals_enumeration_and_forty_facts_of_low_width(spark):
    """Small models by all worlds, and in the same call a ladder of 40 facts by a transfer over its rungs."""
    rng = random.Random(3)
    models = {}
    for m in range(25):
        n = rng.randint(1, 11)
        priors = {f * 3: (rng.randint(0, 3) if rng.random() < 0.2 else rng.randint(1, 4), rng.randint(1, 5)) for f in range(n)}
        factors = []
        for _ in range(rng.randint(0, 2 * n)):
            low = rng.randrange(n)
            scope = rng.sample([f * 3 for f in range(low, min(n, low + 4))], rng.randint(1, min(3, n - low)))
            factors.append((scope, [rng.choice((0, 1, 1, 2, 3)) for _ in range(1 << len(scope))]))
        models[m] = (priors, factors)
    n, table = 40, [1, 2, 1, 1]
    ladder = [(99, i, [i, i + 1], table, False, None) for i in range(n - 1)] + [(99, 100 + i, [i, i + 2], [1, 1, 0, 1], False, None) for i in range(n - 2)]
    got = solved(spark, [(m, f, *w) for m, (p, _) in models.items() for f, w in p.items()] + [(99, f, 1, 1) for f in range(n)],
                 [(m, i, s, t, m % 2 == 0, rng.choice((None, "independent"))) for m, (_, x) in models.items() for i, (s, t) in enumerate(x)] + ladder)
    for m, (p, x) in models.items():
        for f, (yes, total) in plain(p, x).items():
            status = "success" if total else "inconsistent" if x and m % 2 == 0 else "zero_normalizer"
            assert got[m, f] == (status, yes, total), (m, f)
    assert len(got) == sum(len(p) for p, _ in models.values()) + n
    ways = {(a, b): table[a + 2 * b] for a in (0, 1) for b in (0, 1)}
    for _ in range(n - 2):
        after = {}
        for (a, b), v in ways.items():
            for c in (0, 1):
                after[b, c] = after.get((b, c), 0) + v * table[b + 2 * c] * [1, 1, 0, 1][a + 2 * c]
        ways = after
    assert {got[99, f][2] for f in range(n)} == {sum(ways.values())} and got[99, n - 1][1] == sum(v for (_, c), v in ways.items() if c)


def test_hub_with_many_factors(spark, monkeypatch):
    """Stars whose leaves have three factors of one scope: groups stay at FEW."""
    monkeypatch.setattr(E, "FEW", 4)
    leaves = {1: 150, 2: 100}
    factors = [(m, 3 * f + k, [f, 0], [1, 1, 1, 1] if k else [1, 0, 1, 1], False, None) for m, n in leaves.items() for f in range(1, n + 1) for k in range(3)]
    got = solved(spark, [(m, f, 1, 1) for m, n in leaves.items() for f in range(n + 1)], factors)
    # hub true: leaves are free; hub false: all leaves are false
    assert got[2, 0] == ("success", 2**100, 2**100 + 1) and got[2, 5] == ("success", 2**99, 2**100 + 1)
    assert got[1, 0] == ("resource_limit", None, None)  # 2^150 has over 38 digits


def test_statuses(spark):
    fine = [(m, f, 1, 2) for m in range(12) for f in (1, 2)]
    priors = [*fine, (20, 1, 0, 0), (21, 1, -1, 2), (22, 1, None, 2), (23, 1, 1, 1), (23, 1, 1, 1), (24, None, 1, 1)]
    factors = [(0, 0, [1, 9], [1, 1, 1, 1], False, None), (1, 0, [1, 2], [1, 1, 1], False, None), (2, 0, [1, 1], [1, 1, 1, 1], False, None), (3, 0, [1], [1, None], False, None), (4, 0, None, [1], False, None),
               (5, 0, [1], [0, 0], True, None), (6, 0, [1], [0, 0], False, None), (7, 0, [1], [1, 1], False, "correlated"), (8, 0, [1], [1, 1], False, "unknown"), (9, 0, [1], [0, 0], False, "exact_duplicate"), (99, 0, [1], [1, 1], False, None)]
    dense = [(30, i, list(s), [1, 1, 1, 1], False, None) for i, s in enumerate(itertools.combinations(range(8), 2))]
    got = solved(spark, priors + [(30, f, 1, 1) for f in range(8)], factors + dense, width=5)
    status = {m: v[0] for (m, _), v in got.items()}
    assert [status[m] for m in range(12)] == ["invalid_schema"] * 5 + ["inconsistent", "zero_normalizer", "unsupported_input", "unsupported_input", "success", "success", "success"]
    assert [status[m] for m in range(20, 25)] == ["zero_normalizer"] + ["invalid_schema"] * 4
    assert got[9, 1] == ("success", 6, 9) and 99 not in status
    assert {got[30, f][0] for f in range(8)} == {"resource_limit"}


def test_no_rows_and_decimal_weights(spark):
    assert solved(spark, [], []) == {}
    priors = spark.createDataFrame([("a", "x", Decimal("3"), Decimal("1"))], "model_id string, fact string, false_weight decimal(10,2), true_weight decimal(10,2)")
    factors = spark.createDataFrame([], "model_id string, factor_id long, scope array<string>, weights array<int>")
    assert [tuple(map(str, r)) for r in marginals(priors, factors).collect()] == [("a", "x", "success", "1", "4")]
    assert marginals(priors.withColumn("true_weight", F.lit(0.5)), factors).first()["status"] == "invalid_schema"


def test_tables_of_models_are_never_broadcast(spark, monkeypatch):
    """Their files are small, packed, however many rows they hold; the driver would have to hold them all."""
    plans = []
    real = E.written

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(E, "written", spy)
    priors = spark.createDataFrame([(m, f, 1, 2) for m in range(3) for f in range(4)], PRIORS)
    factors = spark.createDataFrame([(m, f, [f, f + 1], [1, 2, 3, 1], False, None) for m in range(3) for f in range(3)], FACTORS)
    got = marginals(priors, factors)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert got.count() == 12


def test_small_models_are_solved_in_a_row_each_like_by_rounds(spark, monkeypatch):
    """No table of a round is written for them; numbers past 2^63, past 38 digits and broken models come out alike both ways."""
    rng, names, real = random.Random(8), [], E.written

    def spy(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(E, "written", spy)
    priors, factors = [], []
    for m in range(40):
        n, most = rng.randint(1, 6), 2**14 if m % 8 == 7 else 3
        priors += [(m, 5 - f, rng.randint(0, most), rng.randint(1, most)) for f in range(n)]
        for i in range(rng.randint(0, 7)):
            scope = rng.sample([5 - f for f in range(n)], rng.randint(1, min(3, n)))
            factors.append((m, i, scope, [rng.randint(0, 2) for _ in range(1 << len(scope))], m % 2 == 0, None))
    priors += [(50, f, 1, 2**13) for f in range(6)] + [(51, f, 1, 2**26) for f in range(5)] + [(52, 1, -1, 2), (53, 1, 0, 0), (54, 1, 1, 1), (54, 1, 1, 1), (55, 1, 1, 1), (56, 1, 1, 1), (57, None, 1, 1), (58, 1, 2, 3)]
    factors += [(55, 0, [1, 9], [1, 1, 1, 1], False, None), (56, 0, [1], [1, 1], False, "unknown"), (58, 0, [1], [5], False, "exact_duplicate"), (59, 0, [1], [1, 1], False, None)]
    got = solved(spark, priors, factors)
    assert set(names) == {"sizes"}
    monkeypatch.setattr(E, "FACTS", 0)
    assert got == solved(spark, priors, factors) and "buckets" in names
    assert got[50, 3] == ("success", 2**13 * (1 + 2**13) ** 5, (1 + 2**13) ** 6) and got[51, 0] == ("resource_limit", None, None)
    assert len(got) == len(set((m, f) for m, f, _, _ in priors)) and (59, 1) not in got
