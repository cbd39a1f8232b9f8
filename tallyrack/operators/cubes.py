"""Exact counts of formulas that one task cannot finish: partial assignments as rows, split again over all tasks."""

from __future__ import annotations

from fractions import Fraction
from math import lcm, prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.wmc import Limit, Solver
from tallyrack.sources.dimacs import Formula, parse
from tallyrack.sources.shared import written

WORK = "formula_id string, status string, satisfiable boolean, limbs array<long>, scale string, children array<array<int>>, nodes long, diagnostic string"
_BASE = 10**9


def split(f: Formula, given: list[int], ways: int) -> list[list[int]]:
    """Up to ``ways`` cubes (a few more where the last branch has two) that share out the models holding ``given``; cubes without a model may be left out."""
    solver = Solver()

    def settle(clauses, lits):
        """Unit clauses join the cube; None where they clash."""
        while clauses is not None and (unit := next((c[0] for c in clauses if len(c) == 1), None)) is not None:
            lits, clauses = [*lits, unit], solver._assign(clauses, unit)
        return None if clauses is None else (clauses, lits)

    clauses = f.clauses
    for literal in given:
        clauses = clauses if clauses is None else solver._assign(clauses, literal)
    queue, ended = [x for x in [settle(clauses, list(given))] if x], []
    while queue and len(queue) + len(ended) < ways:
        clauses, lits = queue.pop(0)
        if not clauses:
            ended.append(lits)
            continue
        v = solver._branch(clauses)
        for literal in (-v, v):
            left = solver._assign(clauses, literal)
            below = None if left is None else settle(left, [*lits, literal])
            if below:
                queue.append(below)
    return ended + [lits for _, lits in queue]


def _limbs(value: int) -> list[int]:
    out = []
    while value:
        value, low = divmod(value, _BASE)
        out.append(low)
    return out


def _reduced(limbs: pd.Series, scale: pd.Series) -> pd.DataFrame:
    out = []
    for places, den in zip(limbs, scale, strict=True):
        value = Fraction(sum(int(x["d"]) * _BASE ** int(x["place"]) for x in (places if places is not None else ())), int(den or 1))
        out.append((str(value.numerator), str(value.denominator)))
    return pd.DataFrame(out, columns=["num", "den"])


def counted(formulas: DataFrame, node_budget: int = 20_000, seconds: float = 60.0, ways: int = 8, rounds: int = 16, **options) -> DataFrame:
    """formulas: formula_id, text.  formula_id, status, satisfiable, num, den, nodes, cubes, diagnostic, equal to the counts of one solver.

    A cube (literals taken as true) that isn't counted within ``node_budget``
    nodes and ``seconds`` is replaced by up to ``ways`` cubes, which any task
    may take in the next round.  The first round takes each formula whole; later the cubes of a formula are dealt over shares,
    each of which gets the text once, so one large formula fills the cluster.
    Counts are integers over the product of the weights' denominators and are
    summed by groups of nine digits.  Each round is a written table.

    Cubes still open after ``rounds`` make the formula a ``resource_limit`` or
    ``timeout``.  Null text is a ``parse_error``; an id with unlike texts is
    ``invalid_input``; rows without an id give no row.
    """
    spark = formulas.sparkSession
    names = [c.split()[0] for c in WORK.replace(", ", ",").split(",")]

    def work(formula_id, text, unlike, cubes, last):
        blank = {"formula_id": formula_id, "satisfiable": None, "limbs": None, "scale": None, "children": None, "nodes": 0, "diagnostic": None}
        if unlike:
            return [blank | {"status": "invalid_input", "diagnostic": "one id, several texts"}]
        try:
            f = parse(text)
        except ValueError as e:
            return [blank | {"status": getattr(e, "status", "parse_error"), "diagnostic": str(e)}]
        scale = prod(lcm(a.denominator, b.denominator) for a, b in f.weights.values())
        rows = []
        for cube in cubes:
            given = [int(x) for x in cube]
            solver = Solver(node_limit=node_budget, seconds=seconds, **options)
            try:
                value, sat = solver.solve(f, given)
                row = {"status": "leaf", "satisfiable": sat, "limbs": _limbs(int(value * scale)), "scale": str(scale)}
            except Limit as e:
                row = {"status": str(e)} if last else {"status": "open", "children": split(f, given, ways)}
            rows.append(blank | row | {"nodes": solver.nodes})
        return rows

    def first(frames):
        for frame in frames:
            yield pd.DataFrame([row for r in frame.itertuples(index=False) for row in work(r.formula_id, r.text, r.unlike, [()], rounds <= 1)], columns=names)

    def later(last):
        return lambda key, texts, cubes: pd.DataFrame(work(key[0], texts["text"].iloc[0], texts["unlike"].iloc[0], cubes["lits"], last), columns=names)

    texts = written(formulas.where("formula_id IS NOT NULL").groupBy(F.col("formula_id").cast("string").alias("formula_id")).agg(
        F.min("text").alias("text"), (F.count_distinct("text") + F.max(F.col("text").isNull().cast("int")) > 1).alias("unlike")), "cube-texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    every = done = written(texts.repartition("formula_id").mapInPandas(first, WORK), "cubes")
    for turn in range(1, rounds):
        waiting = done.where("status = 'open'").select("formula_id", F.explode("children").alias("lits"))
        left, wide = waiting.groupBy("formula_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
        if not left:
            break
        shares = max(1, min(wide, 4 * parts * wide // left), wide // 10_000)  # some tasks' worth of groups in all, none without bound
        cubes = waiting.withColumn("share", F.pmod(F.xxhash64("lits"), F.lit(shares)))
        sent = texts.join(cubes.select(F.col("formula_id").alias("to"), F.col("share").alias("at")).distinct(), F.col("formula_id") == F.col("to")).select("to", "at", "text", "unlike")
        both = sent.groupBy("to", "at").cogroup(cubes.groupBy("formula_id", "share"))
        done = written(both.applyInPandas(later(turn == rounds - 1), WORK), "cubes")
        every = every.unionByName(done)
    failed = F.max(F.when(~F.col("status").isin("leaf", "open"), F.col("status")))
    sums = every.groupBy("formula_id").agg(F.coalesce(failed, F.lit("success")).alias("status"), F.coalesce(F.bool_or("satisfiable"), F.lit(False)).alias("sat"), F.max("scale").alias("scale"), F.sum("nodes").alias("nodes"), F.count("*").alias("cubes"), F.max("diagnostic").alias("diagnostic"))
    places = every.where("status = 'leaf'").select("formula_id", F.posexplode("limbs").alias("place", "d")).groupBy("formula_id", "place").agg(F.sum("d").alias("d"))
    places = places.groupBy("formula_id").agg(F.collect_list(F.struct("place", "d")).alias("limbs"))  # as long as the number is
    ok = F.col("status") == "success"
    reduced = F.pandas_udf(_reduced, "struct<num string, den string>")
    out = sums.join(places, "formula_id", "left").withColumn("r", reduced("limbs", "scale"))
    return out.select("formula_id", "status", F.when(ok, F.col("sat")).alias("satisfiable"), F.when(ok, F.col("r.num")).alias("num"), F.when(ok, F.col("r.den")).alias("den"), "nodes", "cubes", "diagnostic")
