"""Exact weighted model counting: one task per formula, or enumeration in SQL."""

from __future__ import annotations

import sys
import time
from collections import Counter
from fractions import Fraction
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.sources.dimacs import Formula, parse

RESULT = "formula_id string, status string, satisfiable boolean, num string, den string, nodes long, splits long, propagations long, diagnostic string"


class Limit(Exception):
    pass


class Solver:
    """Backtracking with unit propagation and component splitting; each can be switched off."""

    def __init__(self, propagate: bool = True, components: bool = True, by_occurrence: bool = True, node_limit: int = 10_000_000, seconds: float = 600.0, depth_limit: int = 4096):
        self.propagate, self.components, self.by_occurrence = propagate, components, by_occurrence
        self.node_limit, self.seconds, self.depth_limit = node_limit, seconds, depth_limit
        self.nodes = self.splits = self.propagations = 0

    def solve(self, f: Formula, given=()) -> tuple[Fraction, bool]:
        """The mass of the models in which the literals ``given`` hold, and whether there is one."""
        self.f, self.weights, self.until = f, {}, time.monotonic() + self.seconds if self.seconds else None
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(old, 4 * self.depth_limit + 1000))
        try:
            clauses, weight = f.clauses, 1
            for literal in given:
                weight *= self._weight(literal)
                clauses = self._assign(clauses, literal)
                if clauses is None:
                    return Fraction(0), False
            value, sat = self._count(clauses, frozenset(range(1, f.variables + 1)) - {abs(x) for x in given}, 0)
            return Fraction(weight * value), sat
        finally:
            sys.setrecursionlimit(old)

    def _weight(self, literal: int) -> int | Fraction:
        """As an int where it is whole, which multiplies faster."""
        if literal not in self.weights:
            w = self.f.weight(literal)
            self.weights[literal] = w.numerator if w.denominator == 1 else w
        return self.weights[literal]

    def _free(self, variables) -> int | Fraction:
        out = 1
        for v in variables:
            out *= self._weight(v) + self._weight(-v)
        return out

    @staticmethod
    def _assign(clauses, literal):
        """Clauses left once a literal holds; None if one became empty."""
        out = []
        for c in clauses:
            if literal in c:
                continue
            if -literal in c:
                c = tuple(x for x in c if x != -literal)
                if not c:
                    return None
            out.append(c)
        return out

    def _count(self, clauses, scope, depth) -> tuple[int | Fraction, bool]:
        self.nodes += 1
        if self.node_limit and self.nodes > self.node_limit or depth > self.depth_limit:
            raise Limit("resource_limit")
        if self.until and time.monotonic() > self.until:
            raise Limit("timeout")
        weight = 1
        if not depth and not all(clauses):  # further down none is empty
            return 0, False
        while self.propagate:
            for c in clauses:
                if len(c) == 1:
                    break
            else:
                break
            self.propagations += 1
            weight *= self._weight(c[0])
            scope = scope - {abs(c[0])}
            clauses = self._assign(clauses, c[0])
            if clauses is None:
                return 0, False
        if not clauses:
            return weight * self._free(scope), True
        if self.components:
            parts = self._split(clauses)
            if len(parts) > 1:
                self.splits += 1
                used, sat = set(), True
                for part, variables in parts:
                    used |= variables
                    value, ok = self._count(part, frozenset(variables), depth + 1)
                    weight, sat = weight * value, sat and ok
                    if not ok:
                        return 0, False
                return weight * self._free(scope - used), sat
        v = self._branch(clauses)
        total, sat = 0, False
        for literal in (-v, v):
            left = self._assign(clauses, literal)
            if left is not None:
                value, ok = self._count(left, scope - {v}, depth + 1)
                total, sat = total + self._weight(literal) * value, sat or ok
        return weight * total, sat

    def _branch(self, clauses) -> int:
        if not self.by_occurrence:
            return min(map(abs, chain.from_iterable(clauses)))
        counts = Counter(map(abs, chain.from_iterable(clauses)))
        most = max(counts.values())
        return min(v for v, n in counts.items() if n == most)

    @staticmethod
    def _split(clauses):
        seen, apart = {*clauses[0], *[-x for x in clauses[0]]}, clauses
        for _ in range(3):  # most often all hang together
            left = []
            for c in apart:
                if seen.isdisjoint(c):
                    left.append(c)
                elif not seen.issuperset(c):
                    seen.update(c, [-x for x in c])
            if not left:
                return [(clauses, seen)]
            apart = left
        lead: dict[int, int] = {}

        def find(v):
            while lead[v] != v:
                lead[v] = lead[lead[v]]
                v = lead[v]
            return v

        for c in clauses:
            for x in c:
                lead.setdefault(abs(x), abs(x))
            root = find(abs(c[0]))
            for x in c[1:]:
                lead[find(abs(x))] = root
        parts: dict[int, tuple[list, set]] = {}
        for c in clauses:
            part = parts.setdefault(find(abs(c[0])), ([], set()))
            part[0].append(c)
            part[1].update(abs(x) for x in c)
        return list(parts.values())


def count_variants(formula_id: str, text: str, variants: list[dict]) -> list[dict]:
    """Parse one formula and solve it with each set of options; data failures become statuses, never partial numbers."""
    blank = dict.fromkeys(("satisfiable", "num", "den", "diagnostic")) | {"formula_id": formula_id, "nodes": 0, "splits": 0, "propagations": 0}
    failed = lambda e: {"status": getattr(e, "status", "parse_error"), "diagnostic": str(e)}
    try:
        formula = parse(text)
    except ValueError as e:
        return [blank | failed(e) for _ in variants]
    rows = []
    for options in variants:
        solver = Solver(**options)
        try:
            value, sat = solver.solve(formula)
            row = blank | {"status": "success", "satisfiable": sat, "num": str(value.numerator), "den": str(value.denominator)}
        except Limit as e:
            row = blank | {"status": str(e)}
        except ValueError as e:
            row = blank | failed(e)
        rows.append(row | {"nodes": solver.nodes, "splits": solver.splits, "propagations": solver.propagations})
    return rows


def count_text(formula_id: str, text: str, **options) -> dict:
    """One formula with one set of options."""
    return count_variants(formula_id, text, [options])[0]


def exact_counts(formulas: DataFrame, variants: list[dict] | None = None, **options) -> DataFrame:
    """formulas: formula_id, text.  One result row each, or one for each of ``variants`` (sets of options); formulas are solved in parallel."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    each = [options | v for v in variants or [{}]]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([row for i, t in zip(frame["formula_id"], frame["text"], strict=True) for row in count_variants(i, t, each)], columns=names)

    parts = int(formulas.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = formulas.select("formula_id", "text").repartition(parts, "formula_id")  # by number, or few bytes that take long would go to few tasks
    return dealt.mapInPandas(run, RESULT)


def enumerate_counts(literals: DataFrame, sizes: DataFrame, most: int = 20) -> DataFrame:
    """literals: formula_id, clause_id, lit; sizes: formula_id, n.  Unweighted models by enumeration, in plain SQL operators.

    A clause is two bit masks, a formula an array of them; no join per world.
    """
    masks = literals.groupBy("formula_id", "clause_id").agg(
        F.bit_or(F.when(F.col("lit") > 0, F.expr("shiftleft(1L, cast(abs(lit) - 1 AS int))")).otherwise(0)).alias("pos"),
        F.bit_or(F.when(F.col("lit") < 0, F.expr("shiftleft(1L, cast(abs(lit) - 1 AS int))")).otherwise(0)).alias("neg"))
    packed = masks.groupBy("formula_id").agg(F.collect_list(F.struct("pos", "neg")).alias("clauses"))
    rows = sizes.where(F.col("n") <= most).join(packed, "formula_id", "left").withColumn("world", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(n AS int)) - 1"))))
    good = F.forall(F.coalesce("clauses", F.array().cast("array<struct<pos:bigint,neg:bigint>>")), lambda c: (c["pos"].bitwiseAND(F.col("world")) != 0) | (c["neg"].bitwiseAND(F.bitwise_not("world")) != 0))
    return rows.groupBy("formula_id").agg(F.count_if(good).alias("models"))


def normalise_clauses(literals: DataFrame) -> DataFrame:
    """formula_id, clause_id, lits (by variable, positive first, distinct), tautologies dropped."""
    sets = literals.groupBy("formula_id", "clause_id").agg(F.collect_set("lit").alias("s"))
    ordered = F.transform(F.array_sort(F.transform("s", lambda x: F.struct(F.abs(x).alias("v"), (x < 0).alias("neg"), x.alias("x")))), lambda x: x["x"])
    return sets.where(~F.exists("s", lambda x: F.array_contains("s", -x))).select("formula_id", "clause_id", ordered.alias("lits"))
