"""Registered queries of the core operators over the test tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrack.functions import canonical
from tallyrack.functions import scalars as S
from tallyrack.operators import audit, calibration, count_index, cubes, decision, digests, elimination, evidence, finite, graph, guarded, learning, monitor, protocol, records, run, search, shards, similarity, validate, wmc
from tallyrack.sources import archive
from tallyrack.sources.shared import shared_dir, written
from tallyrack.streaming import controller, learner
from tallyrack.streaming.rocks import state_on_disk

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- exact inference

@query("""
WITH c AS (SELECT c_mktsegment AS seg, n_regionkey AS region, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT DISTINCT seg FROM c), r AS (SELECT r_regionkey AS region FROM region),
rel AS (SELECT seg, region FROM c WHERE k % 3 <> 0)
SELECT CAST(sum(CASE WHEN region <= 1 THEN (length(seg) + 0) * (region + 1) ELSE 0 END) AS BIGINT) AS numerator,
       CAST(sum((length(seg) + 0) * (region + 1)) AS BIGINT) AS denominator, count(*) > 0 AS satisfiable, 'success' AS status
FROM s CROSS JOIN r SEMI JOIN rel USING (seg, region) WHERE seg <> 'BUILDING'
""")
def finite_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("seg"), F.col("n_regionkey").alias("region")).agg(F.count("*").alias("k"))
    domains = {
        "seg": pairs.select("seg").distinct().withColumn("w_seg", F.length("seg")),
        "region": _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), (F.col("r_regionkey") + 1).alias("w_region")),
    }
    got = finite.conditional_mass(domains, [pairs.where("k % 3 <> 0").select("seg", "region")], F.expr("seg <> 'BUILDING'"), F.expr("region <= 1"))
    return got.select(F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), "satisfiable", "status")


@query("""
SELECT CAST(0 AS BIGINT) AS numerator, CAST(0 AS BIGINT) AS denominator, count(*) > 0 AS satisfiable,
       CASE WHEN count(*) = 0 THEN 'inconsistent' ELSE 'zero_normalizer' END AS status
FROM region WHERE r_regionkey < 0
UNION ALL SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) > 0, CASE WHEN count(*) = 0 THEN 'inconsistent' ELSE 'zero_normalizer' END FROM region
""")
def finite_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("x"))
    none = finite.conditional_mass({"x": region.withColumn("w_x", F.lit(1))}, [region.where("x < 0")])
    zero = finite.conditional_mass({"x": region.withColumn("w_x", F.lit(0))}, [region])
    return none.union(zero).select(F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), "satisfiable", "status")


@query("""
WITH f AS (SELECT l_orderkey AS model_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS fact, CAST(l_quantity AS BIGINT) % 4 + 1 AS w0, l_suppkey % 5 AS w1, l_partkey AS p FROM lineitem),
g AS (SELECT model_id, list(f ORDER BY fact) AS f, count(*) AS n FROM f GROUP BY model_id),
w AS (SELECT model_id, f, n, unnest(range(CAST(1 << n AS BIGINT))) AS w FROM g),
m AS (SELECT model_id, n, w, list_reduce(list_transform(range(n), lambda i: CASE WHEN (w >> i) & 1 = 1 THEN f[i + 1].w1 ELSE f[i + 1].w0 END
  * CASE WHEN i + 1 = n THEN 1 ELSE [1 + f[i + 1].p % 2, f[i + 1].p % 3, f[i + 1].p // 2 % 3, 1 + f[i + 1].p % 4][CAST(((w >> i) & 1) + 2 * ((w >> (i + 1)) & 1) + 1 AS BIGINT)] END), lambda a, b: a * b) AS m FROM w),
t AS (SELECT model_id, unnest(range(n)) AS i, w, m FROM m)
SELECT model_id, CAST(i + 1 AS BIGINT) AS fact, CASE WHEN sum(m) > 0 THEN 'success' ELSE 'zero_normalizer' END AS status, CAST(coalesce(sum(m) FILTER ((w >> i) & 1 = 1), 0) AS BIGINT) AS mass_true, CAST(sum(m) AS BIGINT) AS mass FROM t GROUP BY model_id, i
""")
def belief_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a model, its lines are facts, and lines that follow each other share a factor."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    facts = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.row_number().over(order).cast("long").alias("fact"), F.col("l_quantity").cast("long").alias("q"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    facts = written(facts.withColumn("last", F.max("fact").over(Window.partitionBy("model_id"))), "facts")
    priors = facts.select("model_id", "fact", (F.col("q") % 4 + 1).alias("false_weight"), (F.col("s") % 5).alias("true_weight"))
    pairs = facts.where("fact < last")
    weights = F.array(1 + F.col("p") % 2, F.col("p") % 3, F.floor(F.col("p") / 2) % 3, 1 + F.col("p") % 4)
    factors = pairs.select("model_id", F.col("fact").alias("factor_id"), F.array("fact", F.col("fact") + 1).alias("scope"), weights.alias("weights"))
    got = elimination.marginals(priors, factors)
    return got.select("model_id", "fact", "status", F.col("mass_true").cast("long").alias("mass_true"), F.col("mass").cast("long").alias("mass"))


_LITERALS = """
SELECT o_orderkey // 20 AS formula_id, o_orderkey AS clause_id,
       CAST(CASE WHEN (o_orderkey + o_custkey * i) % 2 = 0 THEN 1 ELSE -1 END * (1 + (o_custkey * (i + 1) + o_orderkey // 40 * i) % 8) AS INTEGER) AS lit
FROM orders, (SELECT unnest([0, 1, 2]) AS i)
"""


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    return rows.selectExpr("o_orderkey div 20 AS formula_id", "o_orderkey AS clause_id", "CAST(CASE WHEN (o_orderkey + o_custkey * i) % 2 = 0 THEN 1 ELSE -1 END * (1 + (o_custkey * (i + 1) + (o_orderkey div 40) * i) % 8) AS INT) AS lit")


_MODELS = f"""
WITH l AS ({_LITERALS}), f AS (SELECT DISTINCT formula_id FROM l),
w AS (SELECT formula_id, unnest(range(256)) AS world FROM f),
bad AS (SELECT formula_id, world, clause_id FROM w JOIN l USING (formula_id) GROUP BY ALL
        HAVING NOT bool_or(((world >> (abs(lit) - 1)) & 1) = CASE WHEN lit > 0 THEN 1 ELSE 0 END)),
ok AS (SELECT formula_id, count(*) AS models FROM w ANTI JOIN bad USING (formula_id, world) GROUP BY formula_id)
SELECT f.formula_id, CAST(coalesce(models, 0) AS BIGINT) AS models FROM f LEFT JOIN ok USING (formula_id)
"""


@query(_MODELS)
def wmc_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = _literals(spark, sf_dir)
    return wmc.enumerate_counts(lits, lits.select("formula_id", F.lit(8).alias("n")).distinct())


def _formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clause = _literals(spark, sf_dir).groupBy("formula_id", "clause_id").agg(F.concat(F.array_join(F.collect_list(F.col("lit").cast("string")), " "), F.lit(" 0")).alias("c"))
    return clause.groupBy("formula_id").agg(F.concat(F.lit("c t wmc\np cnf 8 "), F.count("*").cast("string"), F.lit("\n"), F.array_join(F.sort_array(F.collect_list("c")), "\n")).alias("text")).select(F.col("formula_id").cast("string").alias("formula_id"), "text")


@query(_MODELS)
def wmc_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wmc.exact_counts(_formula_texts(spark, sf_dir))
    return got.select(F.col("formula_id").cast("long").alias("formula_id"), F.col("num").cast("long").alias("models"))


@query(_MODELS)
def wmc_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts with so small a budget that many formulas are split."""
    got = cubes.counted(_formula_texts(spark, sf_dir), node_budget=24, ways=4)
    return got.select(F.col("formula_id").cast("long").alias("formula_id"), F.col("num").cast("long").alias("models"))


@query(f"""
WITH l AS ({_LITERALS}), f AS (SELECT DISTINCT formula_id FROM l),
t AS (SELECT formula_id, v, CAST((formula_id * 3 + v * 5) % 9 + 1 AS BIGINT) AS t FROM f, range(1, 9) AS r(v)),
w AS (SELECT formula_id, unnest(range(256)) AS world FROM f),
bad AS (SELECT DISTINCT formula_id, world FROM (SELECT formula_id, world, clause_id FROM w JOIN l USING (formula_id) GROUP BY ALL
        HAVING NOT bool_or(((world >> (abs(lit) - 1)) & 1) = CASE WHEN lit > 0 THEN 1 ELSE 0 END))),
ok AS (SELECT * FROM w ANTI JOIN bad USING (formula_id, world)),
m AS (SELECT formula_id, world, CAST(product(CASE WHEN (world >> (v - 1)) & 1 = 1 THEN t ELSE 10 - t END) AS BIGINT) AS mass FROM ok JOIN t USING (formula_id) GROUP BY formula_id, world)
SELECT f.formula_id, CAST(coalesce(sum(mass), 0) AS BIGINT) AS mass FROM f LEFT JOIN m USING (formula_id) GROUP BY f.formula_id
""")
def wmc_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact weights in tenths: the mass of all models in units of 10**-8."""
    tenths = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda v: F.struct(v.alias("v"), ((F.col("id") * 3 + v * 5) % 9 + 1).alias("t")))
    line = lambda v, sign, t: F.concat(F.lit("c p weight "), F.lit(sign), v.cast("string"), F.lit(" "), t.cast("string"), F.lit("/10 0"))
    lines = F.flatten(F.transform(tenths, lambda x: F.array(line(x["v"], "", x["t"]), line(x["v"], "-", 10 - x["t"]))))
    texts = _formula_texts(spark, sf_dir).withColumn("id", F.col("formula_id").cast("long"))
    texts = texts.select("formula_id", F.concat("text", F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    got = wmc.exact_counts(texts)
    mass = F.col("num").cast("decimal(20,0)") * F.lit(10**8).cast("decimal(9,0)")
    return got.select(F.col("formula_id").cast("long").alias("formula_id"), F.floor(mass / F.col("den").cast("decimal(9,0)")).cast("long").alias("mass"))


@query(f"SELECT formula_id, true AS invariant FROM ({_MODELS})")
def wmc_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = wmc.exact_counts(_formula_texts(spark, sf_dir), variants=[{}, {"propagate": False}, {"components": False}, {"by_occurrence": False}])
    return audit.invariance(runs, "formula_id", "num").select(F.col("formula_id").cast("long").alias("formula_id"), "invariant")


@query(f"""
WITH l AS ({_LITERALS}), s AS (SELECT formula_id, clause_id, list(DISTINCT lit) AS s FROM l GROUP BY ALL)
SELECT formula_id, clause_id, array_to_string([x.x FOR x IN list_sort([{{'v': abs(x), 'neg': x < 0, 'x': x}} FOR x IN s])], ' ') AS lits
FROM s WHERE len([x FOR x IN s IF list_contains(s, -x)]) = 0
""")
def clause_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wmc.normalise_clauses(_literals(spark, sf_dir))
    return got.select("formula_id", "clause_id", F.array_join(F.col("lits").cast("array<string>"), " ").alias("lits"))


# ----------------------------------------------------------- learning, monitor

_PREQ = """
WITH r AS (SELECT user_id AS stream_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS y,
             'v' || CASE WHEN event_id % 7 = 0 THEN 0 ELSE length(bin(event_id % 7)) END || ':c' || CASE WHEN user_id % 3 = 0 THEN 0 ELSE length(bin(user_id % 3)) END || ':l' || length(bin(event_id % 5 + 1)) AS context FROM events),
p AS (SELECT *, coalesce(CAST(lag(y) OVER (PARTITION BY stream_id ORDER BY seq) AS VARCHAR), 'start') AS prev FROM r),
e AS (SELECT *, (coalesce(sum(y) OVER a, 0) + 1) / (count(y) OVER a + 2) AS p_global, (coalesce(sum(y) OVER b, 0) + 1) / (count(y) OVER b + 2) AS p_context,
             (coalesce(sum(y) OVER c, 0) + 1) / (count(y) OVER c + 2) AS p_prev FROM p
      WINDOW a AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             b AS (PARTITION BY stream_id, context ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             c AS (PARTITION BY stream_id, prev ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, coalesce(sum(ln(CASE WHEN y = 1 THEN p_global ELSE 1 - p_global END)) OVER a, 0) AS lg, coalesce(sum(ln(CASE WHEN y = 1 THEN p_context ELSE 1 - p_context END)) OVER a, 0) AS lc,
             coalesce(sum(ln(CASE WHEN y = 1 THEN p_prev ELSE 1 - p_prev END)) OVER a, 0) AS lp FROM e
      WINDOW a AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (exp(lg - greatest(lg, lc, lp)) * p_global + exp(lc - greatest(lg, lc, lp)) * p_context + exp(lp - greatest(lg, lc, lp)) * p_prev)
             / (exp(lg - greatest(lg, lc, lp)) + exp(lc - greatest(lg, lc, lp)) + exp(lp - greatest(lg, lc, lp))) AS p_mix FROM l)
"""


def _prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _t(spark, sf_dir, "events")
    context = S.context_key(F.col("event_id") % 7, F.col("user_id") % 3, F.col("event_id") % 5 + 1)
    return ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "purchase").cast("int").alias("y"), context.alias("context"))


@query(_PREQ + "SELECT stream_id, seq, context, round(p_global, 7) AS p_global, round(p_context, 7) AS p_context, round(p_prev, 7) AS p_prev FROM e")
def preq_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.experts(_prequential(spark, sf_dir)).select("stream_id", "seq", "context", *[F.round(c, 7).alias(c) for c in ("p_global", "p_context", "p_prev")])


@query(_PREQ + "SELECT stream_id, seq, round(p_mix, 7) AS p_mix FROM m")
def preq_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.mixture(learning.experts(_prequential(spark, sf_dir))).select("stream_id", "seq", F.round("p_mix", 7).alias("p_mix"))


@query(_PREQ + "SELECT stream_id, seq, round(p_mix, 7) AS p_mix, round(ln(CASE WHEN y = 1 THEN p_mix ELSE 1 - p_mix END), 6) AS log_score, 'accepted' AS status FROM m")
def learner_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming learner's processor over the whole table at once."""
    rows = _prequential(spark, sf_dir).select("stream_id", "seq", F.col("seq").cast("string").alias("observation_id"), F.lit("streaming").alias("partition"), "context", F.when(F.col("y") == 1, "completed").otherwise("not_completed").alias("outcome"))
    with state_on_disk(spark):
        got = written(learner.learned(rows), "learner-replay")
    return got.select("stream_id", "seq", F.round("p_mix", 7).alias("p_mix"), F.round("log_score", 6).alias("log_score"), "status")


@query(_PREQ + "SELECT stream_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS completed, round(sum(ln(CASE WHEN y = 1 THEN p_mix ELSE 1 - p_mix END)), 5) AS log_score FROM m GROUP BY stream_id")
def preq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.mixture_summary(_prequential(spark, sf_dir)).select("stream_id", "n", "completed", F.round("log_score", 5).alias("log_score"))


@query("""
WITH r AS (SELECT user_id AS stream_id, event_id AS seq, CAST(event_id // 2 * 2 AS VARCHAR) AS oid,
             CASE WHEN event_id % 11 = 0 THEN 'final_test' WHEN event_id < 4000 OR event_id % 5 = 0 THEN 'training' ELSE 'streaming' END AS part,
             CASE WHEN event_id % 13 = 0 THEN 'non_result' WHEN event_type = 'click' THEN 'completed' ELSE 'not_completed' END AS outcome FROM events),
q AS (SELECT *, part IN ('training', 'streaming') AND outcome <> 'non_result' AS okay FROM r),
n AS (SELECT *, part IN ('training', 'streaming') AS may, outcome <> 'non_result' AS usable, row_number() OVER (PARTITION BY stream_id, oid, okay ORDER BY seq) = 1 AS first FROM q),
o AS (SELECT *, coalesce(max(CASE WHEN part = 'streaming' AND usable AND first THEN 1 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM n)
SELECT stream_id, seq, CASE WHEN NOT may THEN 'unauthorized' WHEN part = 'training' AND opened = 1 THEN 'late_training' WHEN NOT usable THEN 'non_result' WHEN NOT first THEN 'duplicate' ELSE 'accepted' END AS status FROM o
""")
def preq_accept_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").selectExpr(
        "user_id AS stream_id", "event_id AS seq", "CAST(event_id div 2 * 2 AS STRING) AS observation_id",
        "CASE WHEN event_id % 11 = 0 THEN 'final_test' WHEN event_id < 4000 OR event_id % 5 = 0 THEN 'training' ELSE 'streaming' END AS partition",
        "CASE WHEN event_id % 13 = 0 THEN 'non_result' WHEN event_type = 'click' THEN 'completed' ELSE 'not_completed' END AS outcome")
    return learning.accept(rows).select("stream_id", "seq", "status")


_CUSUM = """
WITH l AS (SELECT user_id AS stream_id, event_id AS seq, 20.0 / 900.0 * (value - 50.0) AS llr FROM events),
s AS (SELECT *, sum(llr) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM l),
w AS (SELECT stream_id, seq, p - least(0, min(p) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS w FROM s)
"""


def _cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "value")
    return monitor.cusum(rows, before=40.0, after=60.0, sigma=30.0, threshold=2.0)


@query(_CUSUM + "SELECT stream_id, seq, round(w, 6) AS w, w > 2.0 AS alarm FROM w")
def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cusum(spark, sf_dir).select("stream_id", "seq", F.round("w", 6).alias("w"), "alarm")


@query(_CUSUM + "SELECT stream_id, min(CASE WHEN w > 2.0 THEN seq END) AS first_alarm, round(max(w), 6) AS peak, count(*) AS n FROM w GROUP BY stream_id")
def cusum_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.first_alarms(_cusum(spark, sf_dir)).select("stream_id", "first_alarm", F.round("peak", 6).alias("peak"), "n")


@query("""
WITH e AS (SELECT user_id AS stream_id, event_id, {'r': event_type = 'error', 's': event_type <> 'signup', 'ok': event_id % 97 <> 0, 'n': CAST(floor(value) AS BIGINT) % 130,
  'fz': false, 'hold': 0, 'k': 0, 'w': 0.0::DOUBLE, 'c': [0, 0, 0, 0, 0, 0, 0, 0]} AS x FROM events),
f AS (SELECT stream_id, list_reduce(list(x ORDER BY event_id), lambda a, r: CASE
    WHEN r.r AND a.fz AND a.hold = 0 THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': false, 'hold': 0, 'k': 0, 'w': 0.0::DOUBLE, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 1 THEN 1 ELSE 0 END)}
    WHEN r.r THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': a.fz, 'hold': a.hold, 'k': a.k, 'w': a.w, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 2 THEN 1 ELSE 0 END)}
    WHEN NOT r.s THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': a.fz, 'hold': a.hold, 'k': a.k, 'w': a.w, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 3 THEN 1 ELSE 0 END)}
    WHEN a.fz THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': true, 'hold': greatest(0, a.hold - 1), 'k': a.k, 'w': a.w, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 4 THEN 1 ELSE 0 END)}
    WHEN NOT r.ok OR r.n = 0 OR r.n > 128 THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': true, 'hold': 3, 'k': a.k, 'w': a.w, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 5 THEN 1 ELSE 0 END)}
    WHEN (a.k + 1) % 2 = 1 THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': false, 'hold': a.hold, 'k': a.k + 1, 'w': a.w, 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 6 THEN 1 ELSE 0 END)}
    WHEN a.w + 2.0 * (ln(1 + r.n) - 3.25) > 3.0 THEN {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': true, 'hold': 3, 'k': a.k + 1, 'w': a.w + 2.0 * (ln(1 + r.n) - 3.25), 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 7 THEN 1 ELSE 0 END)}
    ELSE {'r': r.r, 's': r.s, 'ok': r.ok, 'n': r.n, 'fz': false, 'hold': a.hold, 'k': a.k + 1, 'w': greatest(0.0, a.w + 2.0 * (ln(1 + r.n) - 3.25)), 'c': list_transform(a.c, lambda v, i: v + CASE WHEN i = 8 THEN 1 ELSE 0 END)} END,
  {'r': false, 's': false, 'ok': false, 'n': 0::BIGINT, 'fz': false, 'hold': 0, 'k': 0, 'w': 0.0::DOUBLE, 'c': [0, 0, 0, 0, 0, 0, 0, 0]}) AS z FROM e GROUP BY stream_id)
SELECT stream_id, z.c[1]::BIGINT AS resets, z.c[2]::BIGINT AS blocked, z.c[3]::BIGINT AS rejected, z.c[4]::BIGINT AS held, z.c[5]::BIGINT AS broken, z.c[6]::BIGINT AS skipped, z.c[7]::BIGINT AS alarms, z.c[8]::BIGINT AS observed,
       z.fz AS frozen, z.hold::BIGINT AS hold_off, round(z.w, 6) AS cusum FROM f
""")
def controller_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller over the whole table: one search, then outcomes, rows of another partition and resets by event type."""
    ev = _t(spark, sf_dir, "events")
    rows = ev.select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "reset").otherwise("observe").alias("kind"), F.when(F.col("event_type") == "signup", "final_test").otherwise("streaming").alias("partition"),
        F.concat(F.lit("e"), F.col("event_id")).alias("source_id"), F.lit("s").alias("suite_id"), (F.col("event_id") % 97 != 0).alias("success"), (F.floor("value") % 130).alias("nodes"), F.lit(None).cast("array<struct<node_limit:bigint,completed:bigint,mean_log_nodes:double>>").alias("scores"))
    grid = F.array(*[F.struct(F.lit(n).cast("long").alias("node_limit"), F.lit(3).cast("long").alias("completed"), F.lit(m).alias("mean_log_nodes")) for n, m in ((64, 2.5), (128, 3.0))])
    first = rows.groupBy("stream_id").agg((F.min("seq") - 1).alias("seq")).select("stream_id", "seq", F.lit("search").alias("kind"), F.lit("development").alias("partition"), F.lit("suite").alias("source_id"), F.lit("s").alias("suite_id"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("long").alias("nodes"), grid.alias("scores"))
    with state_on_disk(spark):
        got = written(controller.controlled(rows.unionByName(first), controller.Detector(sigma=0.5, threshold=3.0, every=2)), "controller-replay")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    latest = lambda c: F.max_by(c, "seq").alias(c)
    return got.groupBy("stream_id").agg(
        is_("decision", "reset").alias("resets"), is_("decision", "reset_blocked").alias("blocked"), is_("decision", "rejected_partition").alias("rejected"), F.count_if((F.col("decision") == "alarm_frozen") & F.col("event").isNull()).alias("held"),
        is_("event", "invariant_rollback").alias("broken"), F.count_if((F.col("decision") == "unchanged") & F.col("event").isNull()).alias("skipped"), is_("event", "shift_alarm_rollback").alias("alarms"), is_("event", "residual_observed").alias("observed"),
        latest("frozen"), latest("hold_off"), F.round(F.max_by("cusum", "seq"), 6).alias("cusum"))


@query("SELECT stream_id, seq, k FROM (SELECT user_id AS stream_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k % 8 = 0")
def cusum_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"))
    return monitor.cadence(rows, 8).select("stream_id", "seq", F.col("k").cast("long").alias("k"))


@query("""
WITH g AS (SELECT node_limit, count(*) FILTER (n_chars <= node_limit) AS completed, CAST(sum(n_chars) FILTER (n_chars <= node_limit) AS BIGINT) AS nodes,
             avg(ln(1 + CAST(n_chars AS DOUBLE))) FILTER (n_chars <= node_limit) AS m FROM documents, (SELECT unnest([64, 128, 256, 512, 1024, 2048, 4096, 8192]) AS node_limit) GROUP BY node_limit)
SELECT node_limit, completed, nodes, round(m, 6) AS mean_log_nodes, row_number() OVER (ORDER BY completed DESC, node_limit) = 1 AS chosen FROM g
""")
def grid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.range(8).select(F.expr("cast(shiftleft(64, cast(id AS int)) AS int)").alias("node_limit"))
    got = monitor.grid_search(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("n_chars").alias("nodes")), limits)
    return got.select("node_limit", "completed", "nodes", F.round("mean_log_nodes", 6).alias("mean_log_nodes"), "chosen")


@query()
def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node budget for the formulas, each checked against its enumerated models; no SQL, as nodes are the solver's."""
    lits = _literals(spark, sf_dir)
    models = wmc.enumerate_counts(lits, lits.select("formula_id", F.lit(8).alias("n")).distinct())
    cases = _formula_texts(spark, sf_dir).withColumnRenamed("formula_id", "case_id").join(models.select(F.col("formula_id").cast("string").alias("case_id"), F.col("models").alias("expected")), "case_id")
    got = search.search(cases.selectExpr("*", "'development' AS partition", "expected > 0 AS satisfiable"), [1, 2, 4, 8, 16, 32, 64, 128])
    return got.withColumn("mean_log_nodes", F.round("mean_log_nodes", 6))


# ----------------------------------------------------------------- calibration

_FORECASTS = """
WITH f AS (SELECT d.doc_id AS observation_id, CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100.0 AS p, l.quality = 1 AS y, d.lang AS subgroup, d.doc_id % 10 = 0 AS shift
           FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("observation_id"), (((F.col("doc_id") * 37) % 101).cast("double") / 100.0).alias("p"), (F.col("quality") == 1).alias("y"), F.col("lang").alias("subgroup"), (F.col("doc_id") % 10 == 0).alias("shift"))


@query(_FORECASTS + """, s AS (SELECT 'brier' AS score, (p - CAST(y AS INTEGER)) ** 2 AS v FROM f WHERE y IS NOT NULL UNION ALL
  SELECT 'log', CASE WHEN CASE WHEN y THEN p ELSE 1 - p END > 0 THEN -ln(CASE WHEN y THEN p ELSE 1 - p END) ELSE CAST('Infinity' AS DOUBLE) END FROM f WHERE y IS NOT NULL),
a AS (SELECT score, count(*) AS n, CASE WHEN max(v) = CAST('Infinity' AS DOUBLE) THEN CAST('Infinity' AS DOUBLE) ELSE avg(v) END AS mean,
      CASE WHEN count(*) > 1 AND max(v) <> CAST('Infinity' AS DOUBLE) THEN stddev_samp(CASE WHEN v = CAST('Infinity' AS DOUBLE) THEN NULL ELSE v END) / sqrt(count(*)) END AS se FROM s GROUP BY score)
SELECT score, n, round(mean, 6) AS mean, round(se, 6) AS se, round(CASE WHEN se IS NULL THEN 0 ELSE greatest(0, mean - 1.959963984540054 * se) END, 6) AS low, round(mean + 1.959963984540054 * se, 6) AS high FROM a
""")
def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.proper_scores(_forecasts(spark, sf_dir)).select("score", "n", *[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")])


_Z = "1.959963984540054"


@query(_FORECASTS + f""", b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(p) AS mean_p, count(*) FILTER (y) AS h FROM f WHERE y IS NOT NULL GROUP BY 1),
r AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, h, CAST(h AS DOUBLE) / n AS q FROM range(10) t(i) LEFT JOIN b ON b.bin = i)
SELECT bin, n, round(mean_p, 6) AS mean_p, round(q, 6) AS rate,
  round(CASE WHEN n > 0 THEN greatest(0, ((q + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n)) - {_Z} * sqrt(q*(1-q)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)) END, 6) AS low,
  round(CASE WHEN n > 0 THEN least(1, ((q + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n)) + {_Z} * sqrt(q*(1-q)/n + {_Z}*{_Z}/(4.0*n*n)) / (1 + {_Z}*{_Z}/n)) END, 6) AS high FROM r
""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reliability(_forecasts(spark, sf_dir)).select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "rate", "low", "high")])


@query(_FORECASTS + """SELECT count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(greatest(p, 1 - p)), 6) AS mean_confidence,
  round(avg(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN 1 - p > 0 THEN -(1 - p) * ln(1 - p) ELSE 0 END), 6) AS mean_entropy, min(p) AS least, max(p) AS greatest FROM f""")
def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.sharpness(_forecasts(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("mean_p", "mean_confidence", "mean_entropy")], "least", "greatest")


@query(_FORECASTS + """SELECT subgroup, count(*) AS total, count(y) AS scored, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER ((p >= 0.5) <> y) AS errors,
  count(*) FILTER (shift) AS shifted, count(y) < 30 AS below_minimum FROM f GROUP BY subgroup""")
def subgroup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.subgroups(_forecasts(spark, sf_dir))


@query(_FORECASTS + """, g AS (SELECT greatest(p, 1 - p) AS confidence, count(*) AS n, count(*) FILTER ((p >= 0.5) <> y) AS e FROM f WHERE y IS NOT NULL GROUP BY 1),
r AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING) AS retained, sum(e) OVER (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING) AS errors, sum(n) OVER () AS total FROM g)
SELECT round(confidence, 6) AS confidence, CAST(retained AS BIGINT) AS retained, CAST(errors AS BIGINT) AS errors, round(retained / total, 6) AS coverage, round(errors / retained, 6) AS risk FROM r""")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.risk_coverage(_forecasts(spark, sf_dir)).select(F.round("confidence", 6).alias("confidence"), "retained", "errors", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


_CONFORMAL = _FORECASTS + """, s AS (SELECT CASE WHEN y THEN 1 - p ELSE p END AS score FROM f WHERE y IS NOT NULL),
r AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM s),
t AS (SELECT n, (((n + 1) * 90 + 99) // 100) AS k, coalesce(min(score) FILTER (r.k >= ((n + 1) * 90 + 99) // 100), CAST('Infinity' AS DOUBLE)) AS threshold FROM r GROUP BY n)
"""


@query(_CONFORMAL + "SELECT n, CAST(k AS BIGINT) AS k, round(threshold, 6) AS threshold FROM t")
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.conformal_threshold(_forecasts(spark, sf_dir), 10).select("n", "k", F.round("threshold", 6).alias("threshold"))


@query(_CONFORMAL + """SELECT observation_id, CAST(p <= threshold AS INTEGER) + CAST(1 - p <= threshold AS INTEGER) AS set_size,
  concat_ws(',', CASE WHEN p <= threshold THEN '0' END, CASE WHEN 1 - p <= threshold THEN '1' END) AS labels FROM f, t""")
def prediction_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    return calibration.prediction_sets(rows, calibration.conformal_threshold(rows, 10))


def _cells(section: str, item: str, sql: str, measures: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {item} AS item, '{m}' AS measure, round(CAST({m} AS DOUBLE), 6) AS value FROM ({sql})" for m in measures.split())


@query(" UNION ALL ".join([
    _cells("score", "score", SQL["calibration_scores"], "n mean se low high"), _cells("bin", "CAST(bin AS VARCHAR)", SQL["reliability_bins"], "n mean_p rate low high"),
    _cells("bin", "CAST(i AS VARCHAR)", _FORECASTS + "SELECT i, count(observation_id) AS issued FROM range(10) t(i) LEFT JOIN f ON least(CAST(floor(p * 10) AS INTEGER), 9) = i GROUP BY i", "issued"),
    _cells("sharpness", "'all'", SQL["sharpness"], "n mean_p mean_confidence mean_entropy least greatest"), _cells("subgroup", "subgroup", SQL["subgroup_counts"], "total scored missing errors shifted below_minimum"),
    _cells("risk_coverage", "CAST(retained AS VARCHAR)", SQL["risk_coverage"], "confidence retained errors coverage risk"), _cells("conformal", "'threshold'", SQL["conformal_threshold"], "n k threshold"),
    "SELECT 'conformal' AS section, 'status' AS item, 'alpha_percent' AS measure, CAST(10 AS DOUBLE) AS value"]))
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    frozen = protocol.Protocol("quality", "1", "remainder", "build-1", "labels", "documents", "1", "every document", alpha_percent=10, exchangeable=True, basis="ids say nothing about quality")
    ids = {"fitting": _t(spark, sf_dir, "customer").selectExpr("'c' || c_custkey AS observation_id"), "calibration": rows.select(F.col("observation_id").cast("string").alias("observation_id")), "final_test": _t(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS observation_id")}
    got = protocol.report(frozen, rows.withColumn("partition", F.lit("calibration")).withColumn("partition_id", F.lit("labels")), ids)
    return got.select("section", "item", "measure", F.round("value", 6).alias("value"))


# -------------------------------------------------------------------- decision

_DECIDE = """
WITH st AS (SELECT o_orderstatus AS request_id, o_orderpriority AS state_id, count(*) AS weight FROM orders GROUP BY ALL),
ac AS (SELECT request_id, n_name AS action_id, n_nationkey % 7 AS priority, n_nationkey % 6 AS cost_num, 4 AS cost_den, n_nationkey AS k FROM (SELECT DISTINCT request_id FROM st), nation),
ri AS (SELECT ac.request_id, action_id, priority, cost_num, sum(weight * ((k * 7 + length(state_id) * 3) % 11)) AS mass, sum(weight) AS total FROM ac JOIN st USING (request_id) GROUP BY ALL),
va AS (SELECT *, mass * 40 + total * cost_num * 1 AS num, total * 40 AS den FROM ri WHERE cost_num <= 4),
be AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY num, priority, action_id) AS rn FROM va)
"""


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("request_id"), F.col("o_orderpriority").alias("state_id")).agg(F.count("*").alias("weight"))
    nation = F.broadcast(_t(spark, sf_dir, "nation"))  # 25 rows
    action = state.select("request_id").distinct().join(nation, F.lit(True)).selectExpr("request_id", "n_name AS action_id", "n_nationkey % 7 AS priority", "n_nationkey % 6 AS cost_num", "4 AS cost_den")
    loss = state.join(nation, F.lit(True)).selectExpr("request_id", "n_name AS action_id", "state_id", "(n_nationkey * 7 + length(state_id) * 3) % 11 AS loss")
    return decision.expected_risks(state, action, loss, 1, 10)


@query(_DECIDE + """SELECT request_id, CASE WHEN num * 1 >= den * 8 THEN 'abstain' ELSE 'act' END AS decision, CASE WHEN num * 1 < den * 8 THEN action_id END AS action_id,
  CAST(num AS BIGINT) AS best_num, CAST(den AS BIGINT) AS best_den FROM be WHERE rn = 1""")
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decide(_risks(spark, sf_dir), 8, 1)


@query(_DECIDE + "SELECT request_id, 'abstain' AS decision, CAST(NULL AS VARCHAR) AS action_id, CAST(num AS BIGINT) AS best_num, CAST(den AS BIGINT) AS best_den FROM be WHERE rn = 1")
def decide_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decide(_risks(spark, sf_dir), 0, 1)


_GUARDED = """
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id FROM customer),
st AS (SELECT k, i, (k * (i + 3)) % 7 + 1 AS w, i = 2 AND k % 5 = 0 AS unresolved FROM c, range(3) t(i)),
rq AS (SELECT k, id, k % 11 <> 0 AS up, k % 17 <> 0 AND k % 19 <> 0 AS exact, k % 19 = 0 AS void, sum(w) AS total, sum(w) FILTER (unresolved) AS open FROM c JOIN st USING (k) GROUP BY k, id),
ac AS (SELECT k, j, (k + j) % 6 AS cost, j % 2 AS priority, (k + j) % 4 = 0 AS need, k % 3 <> 0 AND (k + j) % 8 <> 0 AS okay, k % 29 = 0 AND j = 1 AS unnamed FROM c, range(3) t(j)),
lo AS (SELECT k, j, i, (k * (j + 1) + i * 5) % 9 AS loss FROM ac JOIN st USING (k) WHERE NOT (k % 23 = 0 AND j = 1 AND i = 1)),
f AS (SELECT k, concat_ws(',', CASE WHEN void THEN 'exactness' END, CASE WHEN k % 13 = 0 THEN 'distribution' END, CASE WHEN k % 29 = 0 THEN 'action' END, CASE WHEN k % 23 = 0 THEN 'loss' END) AS faults FROM rq),
ri AS (SELECT k, j, priority, 4 * 2 * sum(loss * w) + any_value(total) * any_value(cost) AS num, any_value(total) * 8 AS den FROM ac JOIN lo USING (k, j) JOIN st USING (k, i) JOIN rq USING (k) WHERE cost <= 4 AND (NOT need OR okay) GROUP BY k, j, priority),
be AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY num, priority, j) AS rn FROM ri)
SELECT id AS request_id, CASE WHEN NOT up OR NOT exact THEN 'abstention' WHEN faults <> '' THEN 'invalid' WHEN coalesce(open, 0) * 4 > total OR num IS NULL OR num >= den * 5 THEN 'abstention' ELSE 'selected' END AS status,
  CASE WHEN NOT up THEN 'upstream' WHEN NOT exact THEN 'not_exact' WHEN faults <> '' THEN faults WHEN coalesce(open, 0) * 4 > total THEN 'unresolved' WHEN num IS NULL THEN 'no_admissible' WHEN num >= den * 5 THEN 'risk' ELSE 'least_risk' END AS reason,
  CASE WHEN up AND exact AND faults = '' AND coalesce(open, 0) * 4 <= total AND num < den * 5 THEN 'a' || j END AS action_id,
  CASE WHEN up AND exact AND faults = '' AND coalesce(open, 0) * 4 <= total AND num IS NOT NULL THEN CAST(num AS BIGINT) ELSE 0 END AS best_num, CASE WHEN up AND exact AND faults = '' AND coalesce(open, 0) * 4 <= total AND num IS NOT NULL THEN CAST(den AS BIGINT) ELSE 0 END AS best_den, CAST(coalesce(open, 0) AS BIGINT) AS unresolved
FROM rq JOIN f USING (k) LEFT JOIN be ON be.k = rq.k AND rn = 1
"""


@query(_GUARDED)
def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer, with three states and three actions, some with certificates, some broken."""
    c = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CAST(c_custkey AS STRING) AS request_id")
    state = c.select("k", "request_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).selectExpr("k", "request_id", "concat('s', i) AS state_id", "i", "(k * (i + 3)) % 7 + 1 AS weight", "i = 2 AND k % 5 = 0 AS unresolved")
    request = state.groupBy("k", "request_id").agg(F.sum("weight").alias("w")).selectExpr(
        "request_id", "CASE WHEN k % 11 = 0 THEN 'timeout' ELSE 'success' END AS upstream_status", "CASE WHEN k % 19 = 0 THEN 'not_applicable' WHEN k % 17 = 0 THEN 'approximate' ELSE 'exact' END AS exactness", "sha2(request_id, 256) AS subject_sha256", "w + CAST(k % 13 = 0 AS INT) AS total")
    okay = "k % 3 <> 0 AND (k + j) % 8 <> 0"
    action = c.select("k", "request_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).selectExpr(
        "k", "j", "request_id", "concat('a', j) AS action_id", "CASE WHEN k % 29 = 0 AND j = 1 THEN '' ELSE 'l' END AS label", "'{}' AS output", "sha2(CAST(j AS STRING), 256) AS claim_sha256", "j % 2 AS priority", "(k + j) % 6 AS cost_num", "4 AS cost_den", "(k + j) % 4 = 0 AS requires_certificate",
        "'sound' AS property_id", "concat('c', j) AS certificate_id", "sha2('d', 256) AS digest", "1 AS valid_from", "CASE WHEN k % 2 = 0 OR (k + j) % 8 <> 0 THEN 9 ELSE 2 END AS valid_to", "concat('a', j) AS for_action", "sha2(request_id, 256) AS for_subject",
        f"CASE WHEN {okay} THEN sha2(CAST(j AS STRING), 256) END AS for_claim", "'sound' AS for_property", "'v' AS verifier_id", "'1' AS verifier_version", "true AS verified")
    loss = action.select("k", "j", "request_id", "action_id").join(state.select("k", "i", "state_id"), "k").where("NOT (k % 23 = 0 AND j = 1 AND i = 1)").selectExpr("request_id", "action_id", "state_id", "(k * (j + 1) + i * 5) % 9 AS loss")
    policy = guarded.Policy(resource=(1, 2), abstain=(5, 1), unresolved=(1, 4), verifier_id="v", verifier_version="1", now=5)
    return guarded.decide(request, state.drop("k", "i"), action.drop("k", "j"), loss, policy).na.fill(0, ["best_num", "best_den"])


@query("""
WITH r AS (SELECT s_suppkey, 'a' || s_suppkey AS action_id, s_suppkey % 5 <> 0 AS need, CASE WHEN s_suppkey % 7 <> 0 THEN 'c' || s_suppkey END AS cert,
  CASE WHEN s_suppkey % 11 = 0 THEN 'zz' WHEN s_suppkey % 17 <> 1 THEN sha256(CAST(s_suppkey AS VARCHAR)) END AS digest,
  CASE WHEN s_suppkey % 19 <> 2 THEN s_suppkey % 40 END AS vf, s_suppkey % 40 + CASE WHEN s_suppkey % 29 = 3 THEN -1 ELSE 60 END AS vt,
  CASE WHEN s_suppkey % 13 = 0 THEN 'other' WHEN s_suppkey % 23 <> 4 THEN 'a' || s_suppkey END AS subj, CASE WHEN s_suppkey % 7 <> 5 THEN s_suppkey % 3 <> 0 END AS ver FROM supplier)
SELECT action_id, CASE WHEN NOT need THEN 'not_required' WHEN cert IS NULL THEN 'missing' WHEN digest IS NULL OR digest = 'zz' OR vf IS NULL OR vf > vt THEN 'invalid' WHEN vf > 30 OR vt < 30 THEN 'stale'
  WHEN subj IS DISTINCT FROM action_id THEN 'mismatch' WHEN ver IS DISTINCT FROM true THEN 'rejected' ELSE 'accepted' END AS certificate_status FROM r
""")
def certificate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").selectExpr(
        "concat('a', s_suppkey) AS action_id", "s_suppkey % 5 <> 0 AS requires_certificate", "CASE WHEN s_suppkey % 7 <> 0 THEN concat('c', s_suppkey) END AS certificate_id",
        "CASE WHEN s_suppkey % 11 = 0 THEN 'zz' WHEN s_suppkey % 17 <> 1 THEN sha2(CAST(s_suppkey AS STRING), 256) END AS digest",
        "CASE WHEN s_suppkey % 19 <> 2 THEN s_suppkey % 40 END AS valid_from", "s_suppkey % 40 + CASE WHEN s_suppkey % 29 = 3 THEN -1 ELSE 60 END AS valid_to",
        "CASE WHEN s_suppkey % 13 = 0 THEN 'other' WHEN s_suppkey % 23 <> 4 THEN concat('a', s_suppkey) END AS subject", "CASE WHEN s_suppkey % 7 <> 5 THEN s_suppkey % 3 <> 0 END AS verified")
    return decision.certificate_status(rows, 30).select("action_id", "certificate_status")


# ----------------------------------------------------------------- count index

_RECORDS = """
WITH rec AS (SELECT conv_id AS record_id, conv_id * 100 + turn AS ord, 's' || conv_id % 10 AS subject_key, role AS relation_key,
             lower(regexp_extract(text, '^[A-Za-z]+')) AS answer_key, regexp_extract(text, '^[A-Za-z]+') AS answer_surface FROM conversations WHERE regexp_matches(text, '^[A-Za-z]+')),
once AS (SELECT record_id, subject_key, relation_key, answer_key, min(ord) AS ord, arg_min(answer_surface, ord) AS answer_surface FROM rec GROUP BY ALL),
idx AS (SELECT subject_key, relation_key, answer_key, arg_min(answer_surface, ord) AS answer_surface, count(*) AS count FROM once GROUP BY ALL)
""".replace("min(ord) AS ord, arg_min(answer_surface, ord) AS answer_surface FROM rec GROUP BY ALL", "min(ord) AS ord, arg_min(answer_surface, rec.ord) AS answer_surface FROM rec GROUP BY record_id, subject_key, relation_key, answer_key").replace("count(*) AS count FROM once GROUP BY ALL", "count(*) AS count FROM once GROUP BY subject_key, relation_key, answer_key")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").withColumn("w", F.regexp_extract("text", "^[A-Za-z]+", 0)).where("w <> ''")
    return rows.selectExpr("conv_id AS record_id", "conv_id * 100 + turn AS ord", "concat('s', conv_id % 10) AS subject_key", "role AS relation_key", "lower(w) AS answer_key", "w AS answer_surface")


@query(_RECORDS + "SELECT * FROM idx")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_index.build(_records(spark, sf_dir)).drop("ord")


@query(_RECORDS + "SELECT * FROM idx")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    parts = None
    for shard in range(4):
        one = count_index.build(rows.where(F.col("record_id") % 4 == shard)).withColumn("shard", F.lit(shard))
        parts = one if parts is None else parts.unionByName(one)
    return count_index.merge(parts)


_ASKED = _RECORDS + """, q AS (SELECT DISTINCT conv_id AS query_id, role AS relation_key, conv_id FROM conversations WHERE turn = 0),
a AS (SELECT query_id, relation_key, 's' || conv_id % 10 AS subject_key FROM q UNION SELECT query_id, relation_key, 's' || (conv_id + 1) % 10 FROM q),
c AS (SELECT query_id, answer_key, max(count) AS count FROM a JOIN idx USING (subject_key, relation_key) GROUP BY query_id, answer_key),
r AS (SELECT *, sum(count) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, answer_key) AS rank FROM c)
"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").where("turn = 0").selectExpr("conv_id AS query_id", "array(concat('s', conv_id % 10), concat('s', (conv_id + 1) % 10)) AS subject_keys", "role AS relation_key", "array(lower(regexp_extract(text, '^[A-Za-z]+', 0))) AS gold").dropDuplicates(["query_id", "relation_key"])


@query(_ASKED + "SELECT query_id, answer_key, count, CAST(rank AS BIGINT) AS rank, round(count / total, 6) AS share FROM r WHERE rank <= 3")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_index.ranked(count_index.build(_records(spark, sf_dir)), _asked(spark, sf_dir), 3)
    return got.select("query_id", "answer_key", "count", F.col("rank").cast("long").alias("rank"), F.round("share", 6).alias("share"))


@query(_ASKED + """, g AS (SELECT DISTINCT conv_id AS query_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS gold FROM conversations WHERE turn = 0)
SELECT count(DISTINCT g.query_id) AS n, count(DISTINCT r.query_id) AS covered, count(*) FILTER (rank = 1 AND answer_key = gold) AS top1, count(*) FILTER (answer_key = gold) AS topk
FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r USING (query_id)""")
def index_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_index.evaluate(count_index.build(_records(spark, sf_dir)), _asked(spark, sf_dir), 3)


@query("SELECT event_id, CAST(ntile(7) OVER (ORDER BY event_id) - 1 AS INTEGER) AS shard FROM events")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_index.shard_plan(_t(spark, sf_dir, "events").select("event_id"), 7, "event_id")


# ----------------------------------------------------------------------- audit

@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.exact_duplicates(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH s AS (SELECT doc_id AS id, list_sort(list_distinct([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])) AS l FROM documents),
c AS (SELECT l, min(id) AS id, count(*) AS n FROM s WHERE len(l) > 0 GROUP BY l),
e AS (SELECT id, n, len(l) AS size, unnest(l) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, a.size AS sa, b.size AS sb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, n_a, n_b, shared, round(shared / (sa + sb - shared), 6) AS jaccard FROM p WHERE shared * 100 >= (sa + sb - shared) * 60
""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return audit.near_duplicates(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), lines.alias("elements")), 60).drop("kind").withColumn("jaccard", F.round("jaccard", 6))


@query("""
WITH s AS (SELECT doc_id % 2 AS side, coalesce(list_sort(list_distinct([md5(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])), []) AS l, coalesce(lang, '') AS kind FROM documents),
c AS (SELECT side, kind, l, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT *, unnest(l) AS x FROM c),
p AS (SELECT a.kind, a.l AS la, b.l AS lb, a.n AS left_n, b.n AS right_n, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.kind = b.kind AND a.side = 0 AND b.side = 1 GROUP BY ALL
      UNION ALL SELECT a.kind, a.l, b.l, a.n, b.n, 0 FROM c a JOIN c b ON a.kind = b.kind AND len(a.l) = 0 AND len(b.l) = 0 AND a.side = 0 AND b.side = 1)
SELECT kind, sha256(array_to_string(la, '')) AS left_set, sha256(array_to_string(lb, '')) AS right_set, left_n, right_n, shared, round(CASE WHEN len(la) = 0 THEN 1.0 ELSE shared / (len(la) + len(lb) - shared) END, 6) AS jaccard
FROM p WHERE shared * 100 >= (len(la) + len(lb) - shared) * 70
""")
def similarity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even against those of odd id, of one language, whose sets of lines are alike."""
    lines = similarity.distinct_elements(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    rows = _t(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("kind"), lines.alias("elements"), (F.col("doc_id") % 2).alias("side")).withColumn("set", similarity.set_digest(F.col("elements")))
    return similarity.set_links(rows.where("side = 0"), rows.where("side = 1"), 70).withColumn("jaccard", F.round("jaccard", 6))


@query("""
WITH d AS (SELECT doc_id, text, unnest(list_distinct([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])) AS x FROM documents),
b AS (SELECT item_id, text, unnest(list_distinct([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])) AS x FROM benchmark),
h AS (SELECT DISTINCT doc_id AS public_id, item_id AS held_id, 'element' AS reason FROM d JOIN b ON d.x = b.x UNION SELECT doc_id, item_id, 'text' FROM documents d JOIN benchmark b ON d.text = b.text)
SELECT public_id, held_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM h GROUP BY ALL
""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    sides = [_t(spark, sf_dir, t).select(F.col(i).alias(n), lines.alias("elements"), F.array("text").alias("whole")) for t, i, n in (("documents", "doc_id", "public_id"), ("benchmark", "item_id", "held_id"))]
    return audit.leakage(*sides, {"element": ("elements", "elements"), "text": ("whole", "whole")})


@query("""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(n_chars) AS least, min(n_chars) FILTER (k = n // 2 + 1) AS upper_median, max(n_chars) AS greatest, CAST(sum(n_chars) AS BIGINT) AS total FROM r GROUP BY lang
""")
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.numeric_stats(_t(spark, sf_dir, "documents"), "lang", "n_chars")


_ATTEMPTS = """
WITH a AS (SELECT event_id, event_type AS system, CASE WHEN event_id % 9 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 10 ELSE 20 END AS exit_code, event_id % 17 = 0 AS timed_out, event_id % 19 = 0 AS killed,
  CASE WHEN event_id % 4 = 0 THEN 'x' || chr(10) || 's UNSATISFIABLE' WHEN event_id % 4 = 1 THEN 'c s exact arb int ' || event_id || chr(10) || 'z' ELSE 'nothing' END AS output,
  CAST(floor(value * 10) AS BIGINT) AS wall_ms, event_id * 3 % 1000 AS peak_rss FROM events),
s AS (SELECT *, CASE WHEN timed_out THEN 'timeout' WHEN killed THEN 'memory_limit' WHEN exit_code NOT IN (0, 10, 20) THEN 'error' WHEN output LIKE '%s UNSATISFIABLE' THEN 'exact' WHEN output LIKE 'c s exact%' THEN 'exact' ELSE 'no_result' END AS system_status FROM a)
"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.classify_attempts(_t(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type AS system", "CASE WHEN event_id % 9 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 10 ELSE 20 END AS exit_code", "event_id % 17 = 0 AS timed_out", "event_id % 19 = 0 AS killed",
        "CASE WHEN event_id % 4 = 0 THEN 'x\\ns UNSATISFIABLE' WHEN event_id % 4 = 1 THEN concat('c s exact arb int ', event_id, '\\nz') ELSE 'nothing' END AS output",
        "CAST(floor(value * 10) AS BIGINT) AS wall_ms", "event_id * 3 % 1000 AS peak_rss"))


@query(_ATTEMPTS + "SELECT event_id, system_status, CASE WHEN system_status = 'exact' THEN CASE WHEN event_id % 4 = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) END END AS exact_count FROM s")
def classify_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("event_id", "system_status", "exact_count")


@query(_ATTEMPTS + "SELECT system, count(*) AS runs, count(*) FILTER (system_status = 'exact') AS solved, CAST(median(wall_ms) AS DOUBLE) AS median_wall, max(wall_ms) AS longest, max(peak_rss) AS peak_rss FROM s GROUP BY system")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bench_summary(_attempts(spark, sf_dir))


@query("""
SELECT doc_id, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS source_ok, regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS text_ok,
  CASE WHEN doc_id % 64 = 0 THEN 0 ELSE length(bin(doc_id % 64)) END AS width, CASE WHEN doc_id % 3 <> 0 THEN 'success' WHEN doc_id % 2 = 0 THEN 'non_identified' ELSE 'unsupported_input' END AS causal FROM documents
""")
def scalar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    even, yes = F.col("doc_id") % 2 == 0, F.lit(True)
    return docs.select("doc_id", S.valid_identifier(F.col("source")).alias("source_ok"), S.valid_identifier(F.col("text")).alias("text_ok"),
                       S.bit_width(F.col("doc_id") % 64).cast("long").alias("width"), S.causal_policy(F.col("doc_id") % 3 == 0, ~even, yes, yes, yes).alias("causal"))


@query()
def normalize_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", S.normalize_text("text").alias("surface"))


# ------------------------------------------------------------- records and runs

_ENVELOPES = """
SELECT CAST(s_suppkey AS VARCHAR) AS record_id, CASE s_suppkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'approximate' WHEN 2 THEN 'timeout' ELSE 'inconsistent' END AS status,
  CASE s_suppkey % 3 WHEN 0 THEN 'exact' ELSE 'not_applicable' END AS exactness, CASE s_suppkey % 5 WHEN 0 THEN 'training' WHEN 1 THEN 'streaming' WHEN 2 THEN 'other' ELSE 'not_applicable' END AS part,
  CASE WHEN s_suppkey % 7 <> 0 THEN 'p' END AS partition_id, s_suppkey % 2 = 0 AS has_result, s_suppkey % 3 AS n_errors, s_suppkey % 2 AS n_warnings, s_suppkey % 50 AS used, CASE WHEN s_suppkey % 6 <> 0 THEN 40 END AS budget FROM supplier
"""


@query(f"""
WITH r AS ({_ENVELOPES}), i AS (SELECT record_id, list_sort([x FOR x IN [
  CASE WHEN part NOT IN ('training', 'development', 'calibration', 'final_test', 'streaming', 'not_applicable') THEN 'partition' END, CASE WHEN part <> 'not_applicable' AND partition_id IS NULL THEN 'partition_id_missing' END,
  CASE WHEN status IN ('success', 'approximate') AND NOT has_result THEN 'result_missing' END, CASE WHEN status NOT IN ('success', 'approximate') AND has_result THEN 'result_forbidden' END,
  CASE WHEN status NOT IN ('success', 'approximate') AND n_errors = 0 THEN 'error_missing' END, CASE WHEN status = 'success' AND n_errors > 0 THEN 'error_forbidden' END,
  CASE WHEN status = 'approximate' AND n_warnings = 0 THEN 'warning_missing' END, CASE WHEN status NOT IN ('success', 'approximate') AND exactness <> 'not_applicable' THEN 'exactness' END,
  CASE WHEN used > budget THEN 'budget_exceeded' END] IF x IS NOT NULL]) AS issues FROM r)
SELECT record_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS ok FROM i
""")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "supplier").createOrReplaceTempView("_supplier")
    rows = spark.sql(_ENVELOPES.replace("FROM supplier", "FROM _supplier").replace("AS VARCHAR", "AS STRING")).withColumnRenamed("part", "partition")
    return records.validate_records(rows).select("record_id", F.array_join("issues", ",").alias("issues"), "ok")


@query("""
SELECT 'o' || o_orderkey AS record_id, ord, CASE ord WHEN 0 THEN 'source' ELSE 'evidence' END AS kind, CASE ord WHEN 0 THEN 'c' || o_custkey ELSE o_orderpriority END AS id,
  CASE ord WHEN 0 THEN 'derived_from' ELSE 'supports' END AS relation FROM orders, (SELECT unnest([0, 1]) AS ord)
""")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda k, i, r: F.struct(F.lit(k).alias("kind"), i.alias("id"), F.lit(r).alias("relation"))
    rows = _t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("record_id"), F.array(edge("source", F.concat(F.lit("c"), "o_custkey"), "derived_from"), edge("evidence", F.col("o_orderpriority"), "supports")).alias("lineage"))
    return records.lineage_edges(rows)


_LEDGER = """
SELECT o_orderkey % 20 AS model_id, o_orderkey AS ordinal, 'e' || (o_orderkey - CASE WHEN o_orderkey % 23 = 0 THEN 20 ELSE 0 END) AS evidence_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'correlated' ELSE 'independent' END AS dependence, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey - 20 * (o_orderkey % 4 - 1)) END AS parent_id, o_totalprice > 150000 AS factor_key
FROM orders
"""


@query(f"""
WITH r AS ({_LEDGER}), e AS (SELECT *, row_number() OVER (PARTITION BY model_id, evidence_id ORDER BY ordinal) = 1 AS first FROM r),
j AS (SELECT e.*, p.ordinal AS po, p.factor_key AS pf FROM e LEFT JOIN (SELECT * FROM e WHERE first) p ON p.model_id = e.model_id AND p.evidence_id = e.parent_id)
SELECT model_id, ordinal, evidence_id, CASE WHEN NOT first THEN 'duplicate_id' WHEN parent_id IS NOT NULL AND (po IS NULL OR po >= ordinal) THEN 'invalid_schema' WHEN dependence IN ('correlated', 'unknown') THEN 'unsupported_input'
  WHEN dependence = 'exact_duplicate' AND parent_id IS NULL THEN 'invalid_schema' WHEN dependence = 'exact_duplicate' AND factor_key <> pf THEN 'invalid_schema' ELSE 'success' END AS status FROM j
""")
def validate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return records.validate_ledger(spark.sql(_LEDGER.replace("FROM orders", "FROM _orders")))


@query(f"""
WITH RECURSIVE l AS ({_LITERALS}), v AS (SELECT DISTINCT formula_id * 100 + abs(lit) AS node, -1 - clause_id AS other FROM l),
b AS (SELECT node, other FROM v UNION SELECT other, node FROM v), r AS (SELECT node, node AS x FROM b UNION SELECT r.node, b.other FROM r JOIN b ON b.node = r.x)
SELECT node, min(x) AS component FROM r GROUP BY node
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_literals(spark, sf_dir).selectExpr("formula_id * 100 + abs(lit) AS src", "-1 - clause_id AS dst"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    return records.remaining(orders, orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 5 = 0"), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN o THEN 'unexpected' ELSE 'missing' END AS side FROM (SELECT c_custkey, c_custkey % 4 = 0 AS e, c_custkey % 6 = 0 AS o FROM customer) WHERE e <> o")
def index_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey")
    return records.set_difference_report(rows.where("c_custkey % 4 = 0"), rows.where("c_custkey % 6 = 0"), "c_custkey")


_JOBS = "SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS state, TIMESTAMP '2024-01-01 00:00:00' + s_suppkey * INTERVAL 1 MINUTE AS started FROM supplier"


@query(f"""
WITH j AS ({_JOBS}) SELECT count(*) AS total, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'in_progress') AS running, count(*) FILTER (state = 'completed') AS completed,
  max(greatest(0, epoch(TIMESTAMP '2024-01-02 00:00:00') - epoch(started)))  FILTER (state = 'in_progress')::BIGINT AS longest_running FROM j
""".replace("FILTER (state = 'in_progress')::BIGINT", "FILTER (state = 'in_progress')"))
def worker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _t(spark, sf_dir, "supplier").selectExpr("s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS state", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(s_suppkey AS INT), 0) AS started")
    return records.worker_summary(jobs, "2024-01-02 00:00:00").withColumn("longest_running", F.col("longest_running").cast("double"))


@query("SELECT job, seq, state, before FROM (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY seq) AS before FROM (SELECT user_id AS job, event_id AS seq, event_type AS state FROM events)) WHERE before IS NULL OR before <> state")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.state_changes(_t(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@query(f"""
WITH m AS ({_MODELS}) SELECT CAST(formula_id AS VARCHAR) AS formula_id, CASE WHEN formula_id % 4 = 0 THEN 'unauthorized' ELSE 'success' END AS status,
  CASE WHEN formula_id % 4 <> 0 THEN CAST(models AS VARCHAR) END AS num, CASE WHEN formula_id % 4 = 0 THEN 'abstain' ELSE 'act' END AS decision, CASE WHEN formula_id % 4 = 0 THEN 'not_applicable' ELSE 'exact' END AS exactness FROM m
""")
def run_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _formula_texts(spark, sf_dir).withColumn("partition", F.when(F.col("formula_id").cast("int") % 4 == 0, "training").otherwise("development"))
    return run.run_formulas(texts, "build-1").select("formula_id", "status", "num", "decision", "exactness")


@query(f"""
WITH n AS (SELECT formula_id, clause_id, list(DISTINCT lit) AS s FROM ({_LITERALS}) GROUP BY ALL), u AS (SELECT formula_id, clause_id, unnest(s) AS x FROM n)
SELECT u.formula_id, u.clause_id, CAST(count(DISTINCT abs(x)) AS BIGINT) AS width,
  CAST((1 << count(DISTINCT abs(x))) - CASE WHEN count(*) = count(DISTINCT abs(x)) THEN 1 ELSE 0 END AS BIGINT) AS ones FROM u GROUP BY ALL
""")
def clause_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run.clause_factors(_literals(spark, sf_dir))
    return got.select("formula_id", "clause_id", F.size("scope").cast("long").alias("width"), F.aggregate("table", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


@query(f"""
WITH n AS (SELECT formula_id, clause_id, list(DISTINCT lit) AS s FROM ({_LITERALS}) GROUP BY ALL), c AS (SELECT * FROM n WHERE len([x FOR x IN s IF list_contains(s, -x)]) = 0)
SELECT count(DISTINCT formula_id) AS formulas, count(DISTINCT formula_id) AS parsed, CAST(count(DISTINCT formula_id) * 8 AS BIGINT) AS variables, count(*) AS clauses, CAST(sum(len(s)) AS BIGINT) AS literals, CAST(max(len(s)) AS BIGINT) AS longest,
  count(*) FILTER (len(s) = 1) AS units, round(sum(len(s)) / count(*), 6) AS mean_width, CAST(0 AS BIGINT) AS weighted, CAST(0 AS BIGINT) AS parse_errors, CAST(min(n) AS BIGINT) AS least_clauses, CAST(max(n) AS BIGINT) AS greatest_clauses
FROM (SELECT *, count(*) OVER (PARTITION BY formula_id) AS n FROM c)
""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.audit_rollup(archive.audit_formulas(_formula_texts(spark, sf_dir))).select(
        "formulas", "parsed", "variables", "clauses", "literals", "longest", "units", F.round("mean_width", 6).alias("mean_width"), "weighted", "parse_errors", "least_clauses", "greatest_clauses")


@query()
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", canonical.check_canonical("props").alias("c")).select("event_id", "c.status")


# ------------------------------------------------------------------ validators

@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'schema' WHEN o_orderkey % 13 = 0 OR o_orderkey % 19 = 0 THEN 'ineligible' WHEN o_orderkey % 11 = 0 THEN 'missing'
  WHEN o_custkey * 1000 > 1000000 OR o_orderkey * 3000 > 10000000 THEN 'over_cap' ELSE 'ok' END AS status FROM orders
""")
def feature_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 34 = 0 THEN 'other' WHEN o_orderkey % 17 <> 0 THEN 'structure' END AS schema_id", "1 AS schema_version", "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 19 <> 0 END AS eligible",
        "CAST(o_custkey AS BIGINT) * 1000 AS variables", "CAST(o_orderkey AS BIGINT) * 3000 AS clauses", "CASE WHEN o_orderkey % 11 <> 0 THEN 5 END AS literals")
    return validate.feature_status(rows, "structure", 1).select("o_orderkey", "status")


@query("""
SELECT s_suppkey, s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0 AS valid FROM supplier
""")
def detector_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN 60D ELSE 40D END AS before", "CASE WHEN s_suppkey % 5 = 0 THEN double('NaN') ELSE 60D END AS after", "CASE WHEN s_suppkey % 7 = 0 THEN 1e-200 ELSE 2.0D END AS sigma",
        "CASE WHEN s_suppkey % 11 = 0 THEN double('Infinity') ELSE 2.0D END AS threshold", "CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE 1 END AS every", "CASE WHEN s_suppkey % 17 <> 0 THEN 3 END AS hold_off")
    return validate.detector_valid(rows).select("s_suppkey", "valid")


@query("""
WITH b AS (SELECT l_orderkey AS run_id, l_linenumber % 5 AS variable, CASE WHEN l_quantity > 30 THEN 'unresolved' ELSE 'resolved' END AS resolution, CASE WHEN l_partkey % 9 <> 0 AND l_quantity <= 30 THEN 'e' || l_partkey END AS entity,
             l_suppkey % 7 = 0 AS listed, l_partkey % 4 = 0 AS needed FROM lineitem),
t AS (SELECT *, count(*) OVER (PARTITION BY run_id, variable) AS times FROM b)
SELECT run_id, variable, status, count(*) AS n FROM (SELECT *, CASE WHEN variable < 1 OR variable > 3 OR times > 1 OR (resolution = 'resolved' AND (entity IS NULL OR listed)) THEN 'invalid_schema'
  WHEN needed AND resolution = 'unresolved' THEN 'unsupported_input' ELSE 'success' END AS status FROM t) GROUP BY ALL
""")
def identity_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem")
    rows = items.selectExpr(
        "l_orderkey AS run_id", "l_linenumber % 5 AS variable", "CASE WHEN l_quantity > 30 THEN 'unresolved' ELSE 'resolved' END AS resolution", "CASE WHEN l_partkey % 9 <> 0 AND l_quantity <= 30 THEN concat('e', l_partkey) END AS entity_id",
        "CASE WHEN l_suppkey % 7 = 0 THEN array('x1') END AS candidates", "l_partkey % 4 = 0 AS required")
    sizes = items.selectExpr("l_orderkey AS run_id", "3 AS variables").distinct()
    return validate.identity_status(rows, sizes).groupBy("run_id", "variable", "status").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT o_custkey AS model_id, o_orderkey // 2 AS fact_id, o_orderpriority AS predicate FROM orders), p AS (SELECT o_custkey AS model_id, o_orderkey // 2 AS fact_id, o_orderkey % 10 - 1 AS w FROM orders WHERE o_orderkey % 7 <> 0
   UNION ALL SELECT o_custkey, -o_orderkey, 1 FROM orders WHERE o_orderkey % 31 = 0),
m AS (SELECT DISTINCT model_id FROM f), a AS (SELECT model_id, fact_id, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT model_id, fact_id, count(*) AS n FROM p GROUP BY ALL),
i AS (SELECT model_id, 'semantics' AS issue FROM m WHERE model_id % 5 = 0 UNION ALL SELECT model_id, 'limits' FROM m WHERE model_id % 6 = 0
  UNION ALL SELECT model_id, 'fact_repeated' FROM a WHERE n > 1 UNION ALL SELECT model_id, 'prior_repeated' FROM b WHERE n > 1 UNION ALL SELECT model_id, 'prior_undeclared' FROM b ANTI JOIN a USING (model_id, fact_id)
  UNION ALL SELECT model_id, 'prior_missing' FROM a ANTI JOIN b USING (model_id, fact_id) UNION ALL SELECT model_id, 'predicate' FROM f WHERE NOT regexp_full_match(predicate, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}')
  UNION ALL SELECT model_id, 'prior_weight' FROM p WHERE w < 0)
SELECT model_id, issue, count(*) AS n FROM i GROUP BY ALL
""")
def belief_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    facts = orders.selectExpr("o_custkey AS model_id", "CAST(o_orderkey div 2 AS STRING) AS fact_id", "o_orderpriority AS predicate")
    priors = orders.where("o_orderkey % 7 <> 0").selectExpr("o_custkey AS model_id", "CAST(o_orderkey div 2 AS STRING) AS fact_id", "o_orderkey % 10 - 1 AS false_weight", "1 AS true_weight")
    priors = priors.union(orders.where("o_orderkey % 31 = 0").selectExpr("o_custkey", "CAST(-o_orderkey AS STRING)", "1", "1"))
    models = orders.selectExpr("o_custkey AS model_id").distinct().selectExpr("model_id", "'belief' AS schema_id", "'training' AS partition", "CASE WHEN model_id % 5 = 0 THEN 'closed_world' ELSE 'open_world' END AS semantics", "CASE WHEN model_id % 6 = 0 THEN 64 ELSE 63 END AS max_facts")
    return validate.belief_issues(models, facts, priors, "belief")


@query("""
WITH v AS (SELECT o_orderkey // 8 AS task_id, o_orderkey % 4 AS variable FROM orders WHERE o_orderkey % 8 < 4 OR o_orderkey % 37 = 0),
d AS (SELECT o_orderkey // 8 AS task_id, o_orderkey % 4 AS variable, x AS value, CASE WHEN o_orderkey % 53 = 0 AND x = 1 THEN -1 ELSE 1 END AS weight FROM orders, (SELECT unnest([0, 1, 2]) AS x) WHERE o_orderkey % 8 < 4),
r AS (SELECT DISTINCT o_orderkey // 8 AS task_id, CASE WHEN o_orderkey % 41 = 0 THEN 9 ELSE o_orderkey % 4 END AS variable, o_custkey % CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS value FROM orders),
n AS (SELECT task_id, variable, count(*) AS c FROM v GROUP BY ALL), bad AS (SELECT task_id FROM n WHERE c > 1 UNION SELECT task_id FROM d WHERE weight < 0),
u AS (SELECT task_id, count(*) AS undeclared FROM r ANTI JOIN n USING (task_id, variable) GROUP BY 1),
o AS (SELECT task_id, count(*) AS outside FROM r SEMI JOIN n USING (task_id, variable) ANTI JOIN d USING (task_id, variable, value) GROUP BY 1)
SELECT t.task_id, CASE WHEN t.task_id IN (SELECT task_id FROM bad) OR coalesce(undeclared, 0) + coalesce(outside, 0) > 0 THEN 'invalid_schema' ELSE 'success' END AS status, coalesce(undeclared, 0) AS undeclared, coalesce(outside, 0) AS outside
FROM (SELECT DISTINCT task_id FROM v) t LEFT JOIN u USING (task_id) LEFT JOIN o USING (task_id)
""")
def finite_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").withColumn("task_id", F.expr("o_orderkey div 8"))
    variable = "concat('v', o_orderkey % 4) AS variable"
    variables = orders.where("o_orderkey % 8 < 4 OR o_orderkey % 37 = 0").selectExpr("task_id", variable)
    values = orders.where("o_orderkey % 8 < 4").selectExpr("task_id", "o_orderkey", variable, "explode(array(0, 1, 2)) AS x").selectExpr("task_id", "variable", "CAST(x AS STRING) AS value", "CASE WHEN o_orderkey % 53 = 0 AND x = 1 THEN -1 ELSE 1 END AS weight")
    references = orders.selectExpr("task_id", "CASE WHEN o_orderkey % 41 = 0 THEN 'v9' ELSE concat('v', o_orderkey % 4) END AS variable", "CAST(o_custkey % CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS STRING) AS value")
    return validate.finite_task_status(variables, values, references)


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'public' ELSE 'held_out' END AS split FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 1")
def parity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "concat('dir2/case', p_partkey, '.cnf.xz') AS member", "CASE WHEN p_partkey % 3 = 1 THEN 'case' WHEN p_partkey % 3 = 2 THEN 'other' END AS schema_id", "CAST(p_partkey % 2 AS INT) AS schema_version")
    return records.parity_split(records.match_schema(part, "case", 1), "member").select("p_partkey", "p_name", "split")


@query("""
WITH r AS (SELECT event_id, CAST(floor(value * 4000) AS BIGINT) AS cpu, CAST(event_id % 4000 AS BIGINT) * 1048576 AS mem FROM events),
c AS (SELECT *, CAST(cpu AS HUGEINT) * 4294967296 > CAST(mem AS HUGEINT) * 600000 AS by_cpu FROM r), g AS (SELECT *, CASE WHEN by_cpu THEN gcd(cpu, 600000) ELSE gcd(mem, 4294967296) END AS g FROM c)
SELECT event_id, CASE WHEN by_cpu THEN cpu // g ELSE mem // g END AS cost_num, CASE WHEN by_cpu THEN 600000 // g ELSE 4294967296 // g END AS cost_den FROM g
""")
def resource_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").selectExpr("event_id", "CAST(floor(value * 4000) AS BIGINT) AS cpu_ms", "CAST(event_id % 4000 AS BIGINT) * 1048576 AS peak_bytes")
    return decision.resource_cost(rows).select("event_id", "cost_num", "cost_den")


@query("SELECT split_part(trim(x), ' ', 1) AS origin, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM conversations) WHERE regexp_matches(trim(x), '^[A-Za-z]+ ') GROUP BY 1")
def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).rlike("^[A-Za-z]+ "))
    return audit.origin_counts(_t(spark, sf_dir, "conversations").select(lines.alias("sources")))


@query(_ATTEMPTS + "SELECT system, system_status, count(*) AS n FROM s GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_histogram(_attempts(spark, sf_dir))


_RUNS = """
WITH a AS (SELECT s_suppkey AS case_id, x AS system, CASE WHEN s_suppkey % (3 + len(x)) = 0 THEN 'timeout' ELSE 'exact' END AS status, s_suppkey * 7 + CASE WHEN x = 'third' AND s_suppkey % 29 = 0 THEN 1 ELSE 0 END AS found FROM supplier, (SELECT unnest(['base', 'other', 'third']) AS x)),
b AS (SELECT a.*, e.found AS base FROM a LEFT JOIN a e ON e.case_id = a.case_id AND e.system = 'base' AND e.status = 'exact'),
c AS (SELECT system, count(*) AS runs, count(*) FILTER (status = 'exact' AND base IS NOT NULL) AS both_completed, count(*) FILTER (status = 'exact' AND base = found) AS verified FROM b WHERE system <> 'base' GROUP BY system)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS case_id", "explode(array('base', 'other', 'third')) AS system")
    return rows.selectExpr("case_id", "system", "CASE WHEN case_id % (3 + length(system)) = 0 THEN 'timeout' ELSE 'exact' END AS system_status",
                           "CASE WHEN case_id % (3 + length(system)) <> 0 THEN CAST(case_id * 7 + CASE WHEN system = 'third' AND case_id % 29 = 0 THEN 1 ELSE 0 END AS STRING) END AS exact_count")


@query(_RUNS + "SELECT system, runs, both_completed, verified, both_completed - verified AS mismatched, round(verified / both_completed, 6) AS share FROM c")
def compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.compare_systems(_compared(spark, sf_dir), "base").withColumn("share", F.round("share", 6))


@query(_RUNS + "SELECT (SELECT count(*) FROM supplier) AS records, true AS complete, CAST(sum(both_completed - verified) AS BIGINT) AS mismatches, CAST(sum(verified) AS BIGINT) AS verified, sum(both_completed - verified) = 0 AS passed FROM c")
def evaluation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.evaluation_gate(_compared(spark, sf_dir), _t(spark, sf_dir, "supplier").count(), "base")


@query("""
WITH a AS (SELECT 'fitting' AS part, o_custkey AS id FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'calibration', o_custkey FROM orders WHERE o_orderkey % 9 = 1 UNION ALL SELECT 'final', -o_orderkey FROM orders WHERE o_orderkey % 900 = 2)
SELECT CAST(id AS VARCHAR) AS observation_id, count(*) AS n, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM a GROUP BY id HAVING count(*) > 1 OR id < 0
""")
def overlapping_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    parts = {"fitting": ("o_custkey", "o_orderkey % 9 = 0"), "calibration": ("o_custkey", "o_orderkey % 9 = 1"), "final": ("-o_orderkey", "o_orderkey % 900 = 2")}
    found = calibration.overlapping_ids({name: orders.where(rows).selectExpr(f"{ids} AS observation_id") for name, (ids, rows) in parts.items()})
    return found.select("observation_id", "n", F.array_join("partitions", ",").alias("parts"))


_SNAPSHOT = _PREQ + """, k AS (SELECT stream_id, 'global' AS kind, 'all' AS key, y FROM p UNION ALL SELECT stream_id, 'context', context, y FROM p UNION ALL SELECT stream_id, 'previous', prev, y FROM p),
snap AS (SELECT stream_id, kind, key, count(*) AS seen, CAST(sum(y) AS BIGINT) AS completed FROM k GROUP BY ALL)
"""


@query(_SNAPSHOT + "SELECT * FROM snap")
def preq_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.snapshot(_prequential(spark, sf_dir))


@query(_SNAPSHOT + """, broken AS (SELECT stream_id, kind, key, seen + CASE WHEN stream_id % 5 = 0 AND kind = 'context' AND key = (SELECT min(key) FROM snap s WHERE s.stream_id = snap.stream_id AND s.kind = 'context') THEN 1 ELSE 0 END AS seen, completed FROM snap),
ids AS (SELECT stream_id, count(*) - CASE WHEN stream_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM p GROUP BY stream_id)
SELECT stream_id, concat_ws(',', CASE WHEN stream_id % 5 = 0 THEN 'context_total' END, CASE WHEN stream_id % 7 = 0 THEN 'id_total' END) AS issues FROM ids WHERE stream_id % 5 = 0 OR stream_id % 7 = 0""")
def snapshot_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prequential(spark, sf_dir)
    state = learning.snapshot(rows)
    least = state.where("kind = 'context'").groupBy("stream_id").agg(F.min("key").alias("least"))
    broken = state.join(least, "stream_id").withColumn("seen", F.col("seen") + F.when((F.col("stream_id") % 5 == 0) & (F.col("kind") == "context") & (F.col("key") == F.col("least")), 1).otherwise(0)).drop("least")
    last = rows.groupBy("stream_id").agg(F.max("seq").alias("last"))
    ids = rows.join(last, "stream_id").where("stream_id % 7 <> 0 OR seq < last").select("stream_id", F.col("seq").cast("string").alias("observation_id"))
    return validate.snapshot_issues(broken, ids)


# --------------------------------------------------------------------- digests

_TREE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def _row_sha(columns: list[str]) -> str:
    return "sha256(concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'null')" for c in columns) + "))"


def _tree_sql(table: str, columns: list[str], most: int = 6) -> str:
    level = lambda i: f"""l{i} AS (SELECT * FROM leaves WHERE level = {i} UNION ALL
      SELECT {i}, substr(prefix, 1, {i}), CAST(sum(n) AS BIGINT), sha256(string_agg(prefix || '=' || digest, chr(10) ORDER BY prefix || '=' || digest)) FROM l{i + 1} GROUP BY 2)"""  # noqa: E731
    return f"""WITH c AS (SELECT {_row_sha(columns)} AS d, count(*) AS c FROM {table} GROUP BY 1),
      k AS (SELECT CAST(greatest(0, ceil(ln(greatest(count(*), 1) / {digests.LEAF_ROWS}.0) / ln(16) - 1e-9)) AS INTEGER) AS level FROM {table}),
      leaves AS (SELECT level, substr(d, 1, level) AS prefix, CAST(sum(c) AS BIGINT) AS n, sha256(string_agg(d || 'x' || c, chr(10) ORDER BY d || 'x' || c)) AS digest FROM c, k GROUP BY ALL),
      l{most} AS (SELECT * FROM leaves WHERE level = {most}), """ + ", ".join(level(i) for i in range(most - 1, -1, -1)) + " " + " UNION ALL ".join(f"SELECT level, prefix, n, digest FROM l{i}" for i in range(most + 1))


@query(_tree_sql("lineitem", _TREE_COLUMNS))
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.tree(_t(spark, sf_dir, "lineitem"), _TREE_COLUMNS)


@query("""
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 41 = 3 THEN text || '.' ELSE text END AS text, lang FROM documents WHERE doc_id % 53 <> 7 UNION ALL SELECT doc_id, text, lang FROM documents WHERE doc_id % 61 = 11),
u AS (SELECT doc_id, text, lang, 1 AS one, 0 AS other FROM documents UNION ALL SELECT doc_id, text, lang, 0, 1 FROM b)
SELECT doc_id, sha256(text) AS text_sha256, lang, CAST(sum(one) AS BIGINT) AS n_one, CAST(sum(other) AS BIGINT) AS n_other FROM u GROUP BY doc_id, text, lang HAVING sum(one) <> sum(other)
""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edited, thinned and partly doubled version of the documents changes, found by their digest trees."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    other = docs.where("doc_id % 53 <> 7").withColumn("text", F.expr("CASE WHEN doc_id % 41 = 3 THEN concat(text, '.') ELSE text END")).unionByName(docs.where("doc_id % 61 = 11"))
    return digests.changes(docs, other).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "n_one", "n_other")


# ------------------------------------------------------------------ shard sets

def _seal_sql(rows: str) -> str:
    digest = "sha256(row || CASE WHEN line IS NULL THEN 'null' ELSE ':' || line END)"
    parts = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    return f"""SELECT shard, min(row) AS start, max(row) + 1 AS stop, count(*) AS records, CAST(coalesce(sum(strlen(line)), 0) AS BIGINT) AS bytes,
      sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {parts})) AS digest FROM (SELECT *, {digest} AS d FROM {rows}) GROUP BY shard"""


@query(f"""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, text AS line, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS shard FROM documents)
SELECT shard, start, stop, records, bytes, digest, records AS seen_records, bytes AS seen_bytes, 'ok' AS status FROM ({_seal_sql("r")})
""")
def shard_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as seven shards, written twice, and what their folder then holds against its manifest."""
    docs, path = _t(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    for _ in range(2):
        shards.write(docs, path, 7, "doc_id", F.col("text"))
    return shards.check(spark, path)


#: Losses, moves and edits of rows of shards 1 to 7; all of 2 is lost, and 8 stands under a number that is not planned.
_EDITED = [
    "CASE WHEN shard = 3 OR (shard = 6 AND row % 5 = 2) THEN row + 1 WHEN shard = 6 AND row % 5 = 3 THEN row - 1 ELSE row END AS row",
    "CASE WHEN shard = 4 AND row % 7 = 0 THEN line || '!' WHEN shard = 5 AND row % 9 = 0 THEN NULL WHEN shard = 7 AND row % 11 = 0 THEN replace(line, '-', '_') ELSE line END AS line",
    "CASE WHEN shard = 8 THEN 40 ELSE shard END AS shard",
]
_UNLOST = "shard <> 2 AND NOT (shard = 1 AND row % 13 = 0)"


@query(f"""
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_orderkey || '|' || o_orderpriority AS line, CAST(ntile(12) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders),
e AS (SELECT {", ".join(_EDITED)} FROM r WHERE {_UNLOST}), kept AS ({_seal_sql("r")}), seen AS ({_seal_sql("e")})
SELECT shard, coalesce(k.start, -1) AS start, coalesce(k.stop, -1) AS stop, coalesce(k.records, -1) AS records, coalesce(k.bytes, -1) AS bytes, k.digest, coalesce(s.records, 0) AS seen_records, coalesce(s.bytes, 0) AS seen_bytes,
  CASE WHEN k.records IS NULL THEN 'unexpected' WHEN s.records IS NULL THEN 'missing' WHEN k.records <> s.records THEN 'records' WHEN (k.start, k.stop) <> (s.start, s.stop) THEN 'range'
    WHEN k.bytes <> s.bytes THEN 'bytes' WHEN k.digest <> s.digest THEN 'digest' ELSE 'ok' END AS status
FROM kept k FULL JOIN seen s USING (shard)
""")
def shard_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest of the orders says of an edited copy of its rows."""
    rows = written(shards.placed(_t(spark, sf_dir, "orders"), 12, "o_orderkey", F.expr("o_orderkey || '|' || o_orderpriority")), "shard-rows")
    return shards.reconciled(shards.manifest(rows, 12), rows.where(_UNLOST).selectExpr(*_EDITED)).fillna(-1, ["start", "stop", "records", "bytes"])


# -------------------------------------------------------------------- evidence

_EVIDENCE = [
    "o_orderkey % 20 AS model_id", "o_orderkey AS ordinal", "'e' || (o_orderkey - CASE WHEN o_orderkey % 23 = 0 THEN 20 ELSE 0 END) AS evidence_id", "CASE WHEN o_orderkey % 19 = 4 THEN NULL ELSE 's' || o_custkey END AS source_id",
    "CASE WHEN o_orderkey % 29 = 0 THEN '2024-13-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS observed_at", "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE o_orderpriority END AS reference", "CASE WHEN o_orderkey % 37 = 0 THEN 'final_test' ELSE 'training' END AS part",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'hard_constraint' ELSE 'likelihood' END AS semantics",
    "CASE o_orderkey % 7 WHEN 0 THEN 'exact_duplicate' WHEN 1 THEN 'model_factor' WHEN 2 THEN 'correlated' WHEN 3 THEN 'unknown' WHEN 4 THEN 'other' ELSE 'independent' END AS dependence",
    "'f' || (o_custkey % 10) AS f1", "'f' || CASE WHEN o_orderkey % 17 = 0 THEN o_custkey % 10 ELSE o_custkey % 10 + 1 END AS f2", "CASE WHEN o_orderkey % 43 = 0 THEN -1 ELSE o_orderkey % 3 END AS v3", "o_orderkey % 41 = 0 AS short",
    "CASE WHEN o_orderkey % 7 IN (0, 2, 3) OR o_orderkey % 47 = 0 THEN 'e' || (o_orderkey - 20 * (o_orderkey % 5 - 1)) END AS parent_id", "CASE WHEN o_orderkey % 53 = 0 THEN 'near' WHEN o_orderkey % 7 = 0 THEN 'exact_duplicate' WHEN o_orderkey % 7 = 2 THEN 'correlated' ELSE 'unknown' END AS relation",
]


@query(f"""
WITH e AS (SELECT {", ".join(_EVIDENCE)} FROM orders), fst AS (SELECT model_id, evidence_id, min(ordinal) AS first_at FROM e GROUP BY ALL), p AS (SELECT e.* FROM e JOIN fst USING (model_id, evidence_id) WHERE ordinal = first_at),
j AS (SELECT e.*, first_at, p.ordinal AS p_at, (e.semantics, e.f1, e.f2, e.v3, e.short) = (p.semantics, p.f1, p.f2, p.v3, p.short) AS same FROM e JOIN fst USING (model_id, evidence_id) LEFT JOIN p ON p.model_id = e.model_id AND p.evidence_id = e.parent_id),
i AS (SELECT model_id, ordinal, [x FOR x IN [
  CASE WHEN source_id IS NULL THEN 'source_id' END, CASE WHEN observed_at LIKE '2024-13%' THEN 'observed_at' END, CASE WHEN reference = '' THEN 'reference' END, CASE WHEN part <> 'training' THEN 'partition' END,
  CASE WHEN dependence = 'other' THEN 'dependence' END, CASE WHEN short THEN 'table_size' END, CASE WHEN f1 = f2 OR f2 = 'f10' THEN 'scope' END, CASE WHEN v3 < 0 THEN 'likelihood' END, CASE WHEN semantics = 'hard_constraint' AND v3 NOT IN (0, 1) THEN 'hard_values' END,
  CASE WHEN ordinal > first_at THEN 'evidence_id_repeated' END, CASE WHEN parent_id IS NOT NULL AND NOT regexp_full_match(parent_id, '[A-Za-z0-9][A-Za-z0-9._:-]*') THEN 'dependency_id' END, CASE WHEN parent_id IS NOT NULL AND relation = 'near' THEN 'relation' END,
  CASE WHEN parent_id IS NOT NULL AND coalesce(p_at >= ordinal, true) THEN 'parent' END, CASE WHEN dependence = 'exact_duplicate' AND relation = 'exact_duplicate' AND p_at < ordinal AND NOT same THEN 'duplicate_factor' END,
  CASE dependence WHEN 'independent' THEN CASE WHEN parent_id IS NOT NULL THEN 'links' END WHEN 'model_factor' THEN CASE WHEN semantics <> 'hard_constraint' OR parent_id IS NOT NULL THEN 'links' END
    WHEN 'exact_duplicate' THEN CASE WHEN parent_id IS NULL OR relation <> 'exact_duplicate' THEN 'links' END WHEN 'correlated' THEN CASE WHEN parent_id IS NULL OR relation <> 'correlated' THEN 'links' END
    WHEN 'unknown' THEN CASE WHEN parent_id IS NOT NULL AND relation <> 'unknown' THEN 'links' END END
  ] IF x IS NOT NULL] AS issues FROM j)
SELECT model_id, ordinal, array_to_string(list_sort(issues), ',') AS issues, len(issues) = 0 AS ok FROM i
""")
def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").selectExpr(*_EVIDENCE)
    one = lambda v: f"named_struct('num', CAST({v} AS DECIMAL(38,0)), 'den', CAST(1 AS DECIMAL(38,0)))"
    rows = rows.selectExpr("*", "part AS partition", "'v1' AS extractor", "array(f1, f2) AS scope", f"slice(array({one(1)}, {one(0)}, {one('v3')}, {one(1)}), 1, if(short, 3, 4)) AS likelihood", "if(parent_id IS NULL, array(), array(named_struct('evidence_id', parent_id, 'relation', relation))) AS dependencies")
    models = rows.select("model_id").distinct().selectExpr("model_id", "'training' AS partition")
    facts = _t(spark, sf_dir, "orders").selectExpr("o_orderkey % 20 AS model_id", "explode(transform(sequence(0, 9), x -> 'f' || x)) AS fact_id").distinct()
    return evidence.evidence_issues(rows, models, facts).select("model_id", "ordinal", F.array_join("issues", ",").alias("issues"), "ok")
