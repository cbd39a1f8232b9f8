"""Exact marginals of many Boolean belief models at once, by variable elimination over tables.

priors: model_id, fact, false_weight, true_weight.  factors: model_id,
factor_id, scope (array of facts, the first is the lowest bit), weights (array
of 2^k numbers), and, if given, hard (boolean) and dependence.  Weights are
whole numbers, not negative.

Models of up to FACTS facts, ROWS factors and ENTRIES numbers below 2^62 (nearly
all, where there are many) are a row each: one shuffle brings a model's rows together, and each
Arrow batch eliminates all its models of one shape at once, by greedy least
degree, in integers that do not overflow.  The other models go by rounds over tables.

A round takes from every model all facts with fewer neighbours than any of
their neighbours have (ties by hash), so its facts do not touch and are
eliminated side by side, in some log n rounds: the factors that hold a fact are multiplied into
its bucket, and the sum over the fact goes on as a factor over the others.
Factors of one scope are first multiplied in groups of FEW, so a fact that
stands in very many factors is no large group.  A second pass gives each
bucket, from its parent's, the mass of all the rest.  Buckets are rows whose
tables hold 2^width numbers; each round is a written table, so rounds and not
models are what the driver knows.  Tables that grow with the models meet by
sorting: their files are so small, packed, that Spark would broadcast millions of rows.

Statuses, for a whole model: ``invalid_schema`` (facts repeated or without
prior, tables of the wrong size, weights that are null, negative or not whole),
``unsupported_input`` (a factor's dependence is ``correlated`` or ``unknown``),
``resource_limit`` (a bucket over more than ``width`` facts, or numbers past
38 digits, 32 in a quotient), ``zero_normalizer``, ``inconsistent`` (no mass,
and a hard factor), ``success``.  Factors whose dependence is
``exact_duplicate`` are left out.  Models without priors have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.sources.shared import written

FEW = 32
FACTS, ROWS, ENTRIES = 32, 256, 4096
SLICE = 1 << 20
NUMBER = "decimal(38,0)"


def _times(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).cast(NUMBER)


def _plus(a: Column, b: Column) -> Column:
    return F.try_add(a, b).cast(NUMBER)


def _number(value: int) -> Column:
    return F.lit(value).cast(NUMBER)


def _right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n)


def _left(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, where a name would be put in place and worked out for each world."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _met(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """The join by sorting, never by a broadcast."""
    return left.join(right.hint("merge"), keys, how)


def _worlds(scope: Column) -> Column:
    return F.sequence(F.lit(0), _left(F.lit(1), F.size(scope)) - 1)


def _places(inner: Column, outer: Column) -> Column:
    """Where the facts of ``inner`` stand in ``outer``."""
    return F.transform(inner, lambda x: (F.array_position(outer, x) - 1).cast("int"))


def _gather(world: Column, places: Column) -> Column:
    """The bits of ``world`` at ``places``, the first one lowest."""
    return F.aggregate(places, F.struct(F.lit(0).alias("v"), F.lit(0).alias("k")), lambda a, p: F.struct((a["v"] + _left(_right(world, p).bitwiseAND(F.lit(1)), a["k"])).alias("v"), (a["k"] + 1).alias("k")))["v"]


def _scatter(world: Column, places: Column) -> Column:
    """The lowest bits of ``world`` put to ``places``."""
    return F.aggregate(places, F.struct(F.lit(0).alias("v"), F.lit(0).alias("k")), lambda a, p: F.struct((a["v"] + _left(_right(world, a["k"]).bitwiseAND(F.lit(1)), p)).alias("v"), (a["k"] + 1).alias("k")))["v"]


def _marginal(table: Column, scope: Column, onto: Column) -> Column:
    """The table over ``scope`` summed to the facts of ``onto``."""
    kept, gone = _places(onto, scope), _places(F.array_except(scope, onto), scope)
    put = lambda worlds, places: F.transform(worlds, lambda w: _scatter(w, places))
    known = F.struct(table.alias("table"), _let(kept, lambda k: put(_worlds(k), k)).alias("kept"), _let(gone, lambda g: put(_worlds(g), g)).alias("gone"))
    return _let(known, lambda x: F.transform(x["kept"], lambda k: F.aggregate(x["gone"], _number(0), lambda a, g: _plus(a, F.get(x["table"], k + g)))))


def _product(factors: DataFrame, *keys: str) -> DataFrame:
    """One factor for each key: the product of its rows' factors (scope, weights)."""
    rows = factors.groupBy(*keys).agg(F.collect_list(F.struct("scope", "weights")).alias("f"))
    rows = rows.withColumn("u", F.array_sort(F.array_distinct(F.flatten(F.transform("f", lambda x: x["scope"])))))
    rows = rows.withColumn("p", F.transform("f", lambda x: F.struct(x["weights"].alias("weights"), _places(x["scope"], F.col("u")).alias("at"))))
    table = _let(F.col("p"), lambda p: F.transform(_worlds(F.col("u")), lambda w: F.aggregate(p, _number(1), lambda a, x: _times(a, F.get(x["weights"], _gather(w, x["at"]))))))
    return rows.select(*keys, F.col("u").alias("scope"), table.alias("weights"))


def _merged(factors: DataFrame, name: str) -> DataFrame:
    """One factor for each model and scope, multiplied in groups of FEW."""
    factors = written(factors.select("model_id", "scope", "weights", F.xxhash64("weights", F.monotonically_increasing_id()).alias("salt")), name)
    while True:
        counts = factors.groupBy("model_id", "scope").agg(F.count("*").alias("n"))
        most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= 1:
            return factors.drop("salt")
        grouped = _met(factors, counts, ["model_id", "scope"]).withColumn("part", F.pmod("salt", F.ceil(F.col("n") / FEW)))
        factors = written(_product(grouped.withColumnRenamed("scope", "s").withColumn("scope", F.col("s")), "model_id", "s", "part").withColumn("salt", F.xxhash64("part", F.lit(most))).drop("s", "part"), name)


def _complete(factors: DataFrame) -> DataFrame:
    """The factors that count, with hard and dependence."""
    for name, default in (("hard", F.lit(False)), ("dependence", F.lit(None).cast("string"))):
        if name not in factors.columns:
            factors = factors.withColumn(name, default)
    return factors.where(F.coalesce(F.col("dependence") != "exact_duplicate", F.lit(True)))


def _whole(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c.cast(NUMBER) == c), F.lit(False))


def _bad_prior() -> Column:
    return ~_whole(F.col("false_weight")) | ~_whole(F.col("true_weight")) | F.col("fact").isNull()


def _zero_prior() -> Column:
    return F.coalesce(F.col("false_weight") + F.col("true_weight") == 0, F.lit(False))


def _okay_factor() -> Column:
    shape = F.coalesce((F.size("scope") == F.size(F.array_distinct("scope"))) & ~F.exists("scope", lambda x: x.isNull()) & (F.size("scope") > 0) & (F.size("scope") <= 24), F.lit(False))
    return shape & F.coalesce((F.size("weights") == F.when(shape, _left(F.lit(1), F.size("scope")))) & F.forall("weights", _whole), F.lit(False))


def _dependent() -> Column:
    return F.coalesce(F.col("dependence").isin("correlated", "unknown"), F.lit(False))


def checked(priors: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models: model_id, status or null; priors and factors of the models without one, as factors)."""
    factors = _complete(factors)
    own = priors.groupBy("model_id").agg((F.max(_bad_prior()) | (F.count("fact") != F.count_distinct("fact"))).alias("bad"), F.max(_zero_prior()).alias("zero"))
    per = factors.groupBy("model_id").agg(F.max(~_okay_factor()).alias("bad_factor"), F.max(_dependent()).alias("dependent"), F.max(F.coalesce("hard", F.lit(False))).alias("hard"))
    unknown = _met(factors.select("model_id", F.explode("scope").alias("fact")), priors.select("model_id", "fact"), ["model_id", "fact"], "left_anti").select("model_id", F.lit(True).alias("unknown")).distinct()
    no = lambda c: F.coalesce(c, F.lit(False))
    models = _met(_met(own, per, "model_id", "left"), unknown, "model_id", "left")
    status = F.when(F.col("bad") | no("bad_factor") | no("unknown"), "invalid_schema").when(no("dependent"), "unsupported_input").when(F.col("zero"), "zero_normalizer")
    models = written(models.select("model_id", status.alias("status"), no("hard").alias("hard")), "models")
    fine = models.where("status IS NULL").select("model_id")
    numbers = lambda c: F.transform(c, lambda x: x.cast(NUMBER))
    return models, _met(priors, fine, "model_id").select("model_id", F.array("fact").alias("scope"), numbers(F.array("false_weight", "true_weight")).alias("weights")), _met(factors, fine, "model_id").select("model_id", "scope", numbers(F.col("weights")).alias("weights"))


def _chosen(factors: DataFrame) -> DataFrame:
    """model_id, fact: the facts with fewer neighbours than their neighbours (ties by hash, so that a chain of equals is no chain of rounds)."""
    edges = factors.select("model_id", F.explode("scope").alias("fact"), "scope").select("model_id", "fact", F.explode("scope").alias("other")).distinct()
    degrees = edges.groupBy("model_id", "fact").agg(F.count("*").alias("degree"))
    around = _met(edges, degrees.withColumnsRenamed({"fact": "other", "degree": "d"}), ["model_id", "other"])
    least = around.groupBy("model_id", "fact").agg(F.min(F.struct("d", F.xxhash64("other").alias("h"), "other")).alias("m"))  # a fact is its own neighbour
    return least.where(F.col("m.other") == F.col("fact")).select("model_id", "fact")


def marginals(priors: DataFrame, factors: DataFrame, width: int = 12) -> DataFrame:
    """model_id, fact, status, mass_true, mass: one row for each prior; masses are null unless the status is success, zero_normalizer or inconsistent."""
    sizes = _sizes(priors, factors)
    small = _small(priors, factors, sizes.where("small").select("model_id"), width)
    large = sizes.where("NOT small").select("model_id")
    if large.isEmpty():
        return small
    return small.unionByName(_by_rounds(_met(priors, large, "model_id", "left_semi"), _met(factors, large, "model_id", "left_semi"), width))


def _sizes(priors: DataFrame, factors: DataFrame) -> DataFrame:
    """model_id, small: the models with priors, and whether one row may hold them."""
    fits = lambda c: F.coalesce(F.abs(c.try_cast("double")) < 2.0**62, c.isNull())
    own = priors.select("model_id", F.lit(1).alias("facts"), F.lit(0).alias("rows"), F.lit(0).alias("entries"), (fits(F.col("false_weight")) & fits(F.col("true_weight"))).alias("fits"))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    rest = factors.select("model_id", F.lit(0).alias("facts"), F.lit(1).alias("rows"), (size("scope") + size("weights")).alias("entries"), F.coalesce(F.forall("weights", fits), F.lit(True)).alias("fits"))
    counts = own.unionByName(rest).where("model_id IS NOT NULL").groupBy("model_id").agg(*[F.sum(c).alias(c) for c in ("facts", "rows", "entries")], F.min("fits").alias("fits"))
    small = (F.col("facts") <= FACTS) & (F.col("rows") <= ROWS) & (F.col("entries") <= ENTRIES) & F.col("fits")
    return written(counts.where("facts > 0").select("model_id", small.alias("small")), "sizes")


def _small(priors: DataFrame, factors: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The marginals of the models of ``ids``, a row each until the end."""
    factors = _complete(factors)
    whole = lambda c: F.transform(c, lambda x: x.try_cast("long"))
    units = priors.select("model_id", F.struct("fact", whole(F.array("false_weight", "true_weight")).alias("w")).alias("prior"), _bad_prior().alias("bad"), _zero_prior().alias("zero"))
    tables = factors.select("model_id", F.struct("scope", whole(F.col("weights")).alias("w")).alias("factor"), (~_okay_factor()).alias("bad"), _dependent().alias("dependent"), F.coalesce("hard", F.lit(False)).alias("hard"))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False)).alias(c)
    rows = _met(units.unionByName(tables, allowMissingColumns=True), ids, "model_id")
    rows = rows.groupBy("model_id").agg(F.array_sort(F.collect_list("prior")).alias("priors"), F.array_sort(F.collect_list("factor")).alias("factors"), *map(any_, ("bad", "zero", "dependent", "hard")))
    rows = rows.withColumn("facts", F.col("priors.fact")).withColumn("scopes", F.col("factors.scope"))
    unlike = F.col("bad") | (F.size("facts") != F.size(F.array_distinct("facts"))) | (F.size(F.array_except(F.flatten("scopes"), "facts")) > 0)
    status = F.when(F.coalesce(unlike, F.lit(True)), "invalid_schema").when(F.col("dependent"), "unsupported_input").when(F.col("zero"), "zero_normalizer")
    rows = rows.withColumn("status", status)
    places = F.transform("scopes", lambda s: F.array_join(_places(s, F.col("facts")).cast("array<string>"), ","))
    rows = rows.select("model_id", "facts", "status", "hard",
                       F.when(F.col("status").isNull(), F.concat_ws(";", F.size("facts").cast("string"), places)).alias("shape"),
                       F.when(F.col("status").isNull(), F.concat(F.flatten("priors.w"), F.flatten("factors.w"))).alias("numbers"))
    kept = ["model_id", "facts", "status", "hard"]
    masses = T.StructType([*rows.select(*kept).schema.fields, T.StructField("yes", T.ArrayType(T.DecimalType(38, 0))), T.StructField("mass", T.DecimalType(38, 0))])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes, mass = _batch(batch.column("shape"), batch.column("numbers"), pa.compute.list_value_length(batch.column("facts")), width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), yes, mass], names=[*kept, "yes", "mass"])

    rows = rows.mapInArrow(solved, masses)
    found = F.coalesce(F.col("status"), F.when(F.col("mass").isNull(), "resource_limit").when(F.col("mass") > 0, "success").when(F.col("hard"), "inconsistent").otherwise("zero_normalizer"))
    rows = rows.select("model_id", found.alias("status"), "mass", F.explode(F.arrays_zip("facts", "yes")).alias("x"))
    return rows.select("model_id", F.col("x.facts").alias("fact"), "status", F.col("x.yes").alias("mass_true"), "mass")


def _batch(shapes: pa.Array, numbers: pa.ListArray, sizes: pa.Array, width: int) -> tuple[pa.Array, pa.Array]:
    """For each model (one without a shape has nulls) the mass of each fact and its own."""
    codes = shapes.dictionary_encode()
    of, starts = np.asarray(codes.indices.fill_null(-1)), np.asarray(numbers.offsets)
    flat, ends = np.asarray(numbers.values.fill_null(0)), np.cumsum(np.asarray(sizes))
    at = np.concatenate(([0], ends)).astype(np.int32)
    yes, mass = np.full(at[-1], None, object), np.full(len(of), None, object)
    for code, shape in enumerate(codes.dictionary.to_pylist()):
        first, *scopes = shape.split(";")
        scopes = [(f,) for f in range(int(first))] + [tuple(map(int, s.split(","))) for s in scopes]
        plan = _plan(scopes, width)
        models = np.flatnonzero(of == code)
        if plan is None:
            continue
        step = max(1, SLICE // sum(1 << len(over) for _, over, _ in plan))
        for chunk in (models[i:i + step] for i in range(0, len(models), step)):
            rows = flat[starts[chunk][:, None] + np.arange(sum(1 << len(s) for s in scopes))]
            with np.errstate(over="ignore", invalid="ignore"):
                fits = _solve(rows.astype(float), scopes, plan)[2] < 2.0**62  # false for what is no number
            for some, kind in ((fits, np.int64), (~fits, object)):
                if some.any():
                    each, total, _ = _solve(rows[some].astype(kind), scopes, plan)
                    told = total < 10**38
                    mass[chunk[some]] = np.where(told, total, None)
                    yes[at[chunk[some]][:, None] + np.arange(int(first))] = np.where(told[:, None], each, None)
    number = pa.decimal128(38, 0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(yes.tolist(), number)), pa.array(mass.tolist(), number)


def _plan(scopes: list[tuple[int, ...]], width: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]] | None:
    """(fact, bucket's facts, facts left) in order of elimination, by least degree; None where a bucket is over more than ``width`` facts."""
    near = {s[0]: {s[0]} for s in scopes if len(s) == 1}
    for s in scopes:
        for f in s:
            near[f] |= set(s)
    out = []
    while near:
        fact = min(near, key=lambda f: (len(near[f]), f))
        over = near.pop(fact)
        if len(over) > width:
            return None
        left = over - {fact}
        for f in left:
            near[f] = (near[f] | left) - {fact}
        out.append((fact, tuple(sorted(over)), tuple(sorted(left))))
    return out


def _spread_over(table: np.ndarray, scope: tuple[int, ...], over: tuple[int, ...]) -> np.ndarray:
    """``table`` (models, then an axis for each fact of ``scope``) with an axis for each fact of ``over``."""
    order = sorted(range(len(scope)), key=scope.__getitem__)
    return table.transpose(0, *[i + 1 for i in order]).reshape(len(table), *[2 if f in scope else 1 for f in over])


def _solve(rows: np.ndarray, scopes: list, plan: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masses of facts and of models that share ``scopes`` and differ in their numbers, and the greatest number met (of floats only)."""
    n, at, factors, parts, buckets = len(rows), 0, [], {}, []
    peak = np.zeros(n) if rows.dtype == float else None

    def met(table: np.ndarray) -> np.ndarray:
        if peak is not None:
            np.maximum(peak, table.reshape(n, -1).max(1), out=peak)
        return table

    for s in scopes:  # the first fact is the lowest bit, so the last axis
        factors.append((s[::-1], rows[:, at:at + (1 << len(s))].reshape(n, *[2] * len(s))))
        at += 1 << len(s)
    for fact, over, left in plan:
        table = np.ones((n, *[2] * len(over)), rows.dtype)
        for s, t in factors:
            if fact in s:
                table = met(table * _spread_over(t, s, over))
        message = met(table.sum(over.index(fact) + 1))
        factors = [(s, t) for s, t in factors if fact not in s]
        if left:
            factors.append((left, message))
        else:
            parts[fact] = message
        buckets.append((table, message))
    mass = met(prod(parts.values(), start=np.ones(n, rows.dtype)))
    yes, beliefs = np.empty((n, len(plan)), rows.dtype), {}
    for (fact, over, left), (table, message) in reversed(list(zip(plan, buckets, strict=True))):
        if left:
            up = next(f for f, _, _ in plan if f in left)  # the first one to go
            wide, belief = beliefs[up]
            outer = belief.sum(tuple(i + 1 for i, f in enumerate(wide) if f not in left)) // np.where(message == 0, 1, message)
        else:
            outer = prod((p for f, p in parts.items() if f != fact), start=np.ones(n, rows.dtype))
        whole = met(table * _spread_over(met(outer), left, over))
        beliefs[fact] = over, whole
        yes[:, fact] = whole.sum(tuple(i + 1 for i, f in enumerate(over) if f != fact))[:, 1]
    return yes, mass, peak


def _by_rounds(priors: DataFrame, factors: DataFrame, width: int) -> DataFrame:
    models, units, rest = checked(priors, factors)
    scopes = units.unionByName(rest).withColumn("order", F.array_sort("scope"))
    sorted_table = _let(_places(F.col("scope"), F.col("order")), lambda at: F.transform(_worlds(F.col("order")), lambda w: F.get(F.col("weights"), _gather(w, at))))
    open_ = _merged(scopes.select("model_id", sorted_table.alias("weights"), F.col("order").alias("scope")), "factors")
    pending, rounds, parents, wide = None, [], [], []
    while not open_.isEmpty():
        chosen = written(_chosen(open_), "chosen")
        at = _met(open_.select("*", F.explode("scope").alias("fact")), chosen, ["model_id", "fact"])
        span = at.groupBy("model_id", "fact").agg(F.size(F.array_distinct(F.flatten(F.collect_set("scope")))).alias("n"))
        too_wide = written(span.where(F.col("n") > width).select("model_id").distinct(), "too-wide")
        wide.append(too_wide)
        none_wide = too_wide.isEmpty()  # mostly so, and then the tables need not move for it
        narrow = lambda t: t if none_wide else _met(t, too_wide, "model_id", "left_anti")  # noqa: B023, E731
        buckets = _product(narrow(at), "model_id", "fact").withColumn("left", F.array_remove("scope", F.col("fact")))
        buckets = written(buckets.withColumn("message", _marginal(F.col("weights"), F.col("scope"), F.col("left"))), "buckets")
        rounds.append(buckets)
        if pending is not None:
            found = _met(pending.select("model_id", "child", F.explode("left").alias("fact")), chosen, ["model_id", "fact"]).withColumnRenamed("fact", "parent")
            parents.append(written(found, "parents"))
            pending = _met(pending, parents[-1], ["model_id", "child"], "left_anti")
        sent = buckets.where(F.size("left") > 0)
        fresh = sent.select("model_id", F.col("fact").alias("child"), "left")
        pending = written(fresh if pending is None else pending.unionByName(fresh), "pending")
        stay = narrow(_met(open_, at.select("model_id", "scope").distinct(), ["model_id", "scope"], "left_anti"))
        open_ = _merged(stay.unionByName(sent.select("model_id", F.col("left").alias("scope"), F.col("message").alias("weights"))), "factors")
    return _spread(priors, models, rounds, parents, wide)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _spread(priors: DataFrame, models: DataFrame, rounds: list[DataFrame], parents: list[DataFrame], wide: list[DataFrame]) -> DataFrame:
    """The second pass: each bucket's whole table, from the last round to the first, and the facts' masses."""
    spark = models.sparkSession
    done: list[DataFrame] = []
    up = _union(parents) if parents else spark.createDataFrame([], models.select("model_id").schema.add("child", priors.schema["fact"].dataType).add("parent", priors.schema["fact"].dataType))
    for buckets in reversed(rounds):
        roots = buckets.where(F.size("left") == 0).select("model_id", "fact", "scope", F.col("weights").alias("whole"), F.col("fact").alias("root"))
        now = roots
        if done:
            above = _union(done).select("model_id", F.col("fact").alias("parent"), F.col("scope").alias("over"), "whole", "root")
            met = _met(_met(buckets.where(F.size("left") > 0), up.withColumnRenamed("child", "fact"), ["model_id", "fact"]), above, ["model_id", "parent"])
            met = met.withColumn("outer", F.zip_with(_marginal(F.col("whole"), F.col("over"), F.col("left")), F.col("message"), lambda b, m: F.when(m == 0, _number(0)).otherwise(F.try_divide(b, m).cast(NUMBER))))
            known = F.struct("outer", _places(F.col("left"), F.col("scope")).alias("at"))
            table = _let(known, lambda x: F.transform(F.col("weights"), lambda v, w: _times(v, F.get(x["outer"], _gather(w, x["at"])))))
            now = now.unionByName(met.select("model_id", "fact", "scope", table.alias("whole"), "root"))
        done.append(written(now, "beliefs"))
    total = lambda t: F.aggregate(t, _number(0), _plus)
    empty = models.select("model_id").where("false").withColumn("fact", F.lit(None).cast(priors.schema["fact"].dataType)).selectExpr("*", f"CAST(NULL AS {NUMBER}) yes", f"CAST(NULL AS {NUMBER}) part", "fact AS root")
    alone = _union([empty, *[d.select("model_id", "fact", F.get(_marginal(F.col("whole"), F.col("scope"), F.array("fact")), F.lit(1)).alias("yes"), total(F.col("whole")).alias("part"), "root") for d in done]])
    # the masses of a model's components multiply
    trees = _union([empty.select("model_id", "root", "part"), *[r.where(F.size("left") == 0).select("model_id", F.col("fact").alias("root"), total(F.col("weights")).alias("part")) for r in rounds]])
    mass = _components(trees)
    rows = _met(_met(_met(priors, models, "model_id"), alone, ["model_id", "fact"], "left"), mass, "model_id", "left")
    if wide:
        rows = _met(rows, _union(wide).distinct().withColumn("wide", F.lit(True)), "model_id", "left")
    else:
        rows = rows.withColumn("wide", F.lit(None).cast("boolean"))
    yes = F.when(F.col("part") == 0, _number(0)).otherwise(_times(F.col("yes"), F.try_divide(F.col("mass"), F.col("part")).cast(NUMBER)))
    rows = written(rows.withColumn("mass_true", yes), "masses")
    lost = written(rows.groupBy("model_id").agg(F.max(F.col("mass").isNull() | F.col("mass_true").isNull()).alias("lost")), "lost")
    rows = _met(rows, lost, "model_id")
    status = F.coalesce(F.col("status"), F.when(F.coalesce("wide", F.lit(False)) | F.col("lost"), "resource_limit").when(F.col("mass") > 0, "success").when(F.col("hard"), "inconsistent").otherwise("zero_normalizer"))
    told = status.isin("success", "inconsistent") | ((status == "zero_normalizer") & F.col("status").isNull())
    return rows.select("model_id", "fact", status.alias("status"), F.when(told, F.col("mass_true")).alias("mass_true"), F.when(told, F.col("mass")).alias("mass"))


def _components(trees: DataFrame) -> DataFrame:
    """model_id, mass: the product of the parts, in groups of FEW; null past 38 digits (but 0 if a part is 0)."""
    rows = written(trees.select("model_id", "part", F.xxhash64("root").alias("salt")), "components")
    while True:
        counts = rows.groupBy("model_id").agg(F.count("*").alias("n"))
        most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= 1:
            return rows.select("model_id", F.col("part").alias("mass"))
        grouped = _met(rows, counts, "model_id").withColumn("g", F.pmod("salt", F.ceil(F.col("n") / FEW)))
        parts = grouped.groupBy("model_id", "g").agg(F.collect_list(F.struct("part")).alias("p"), F.count_if(F.col("part") == 0).alias("zeros"))
        product = F.when(F.col("zeros") > 0, _number(0)).otherwise(F.aggregate("p", _number(1), lambda a, x: _times(a, x["part"])))
        rows = written(parts.select("model_id", product.alias("part"), F.xxhash64("g", F.lit(most)).alias("salt")), "components")
