r"""Quality rules: a learned decision list over text statistics.

Statistics are built-in expressions inside each row.  Labelled rows are joined
on the numbers alone, binned at their quantiles and summed into cells, and
sequential covering works on the cells: a rule grows one threshold at a time by
information gain on two thirds of the labelled rows, is pruned on the other
third, and must reach ``precision`` on both; what it covers then leaves.  Each
step is one aggregate whose result has a row per feature and bin.  The list is
emitted as an ordered SQL ``CASE`` expression over the statistics.

Null texts have no words.  Labels that are null are ignored; if a document has
several, the worst counts.  Without usable labels the list is empty and keeps
all.  Documents stay row by row, repeated or with null id, and other columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, SPACE, written

RUN = 5
#: Statistics that a rule may test; ratios of the counts below.
FEATURES = {
    "f_words": "cast(n_words AS double)",
    "f_word_length": "word_chars / n_words",
    "f_symbols": "n_symbols / word_chars",
    "f_upper": "n_upper / word_chars",
    "f_marks": "n_marks / word_chars",
    "f_digits": "n_digits / word_chars",
    "f_dup_lines": "n_dup_lines / n_lines",
    "f_repeats": "n_repeat_words / n_words",
    "f_distinct": "n_distinct / n_words",
}


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs again in the row."""
    def among(ranked: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ranked, k)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(ranked, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(RUN), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"],
        )
    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks, n_digits, n_distinct of each row."""
    without = lambda pattern: (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")
    words = F.col("_w")
    raw = F.col(quoted(text_col)).cast("string")
    one = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(raw).alias("text_hash"), F.coalesce(raw, F.lit("")).alias("_t"))
    two = one.withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    three = two.withColumn("_h", F.when(F.size("_w") >= RUN, F.slice(F.transform(words, lambda w, i: F.xxhash64(F.slice(words, i + 1, RUN))), 1, F.size("_w") - RUN + 1)).otherwise(F.array().cast("array<bigint>")))
    return three.select(
        "id", "text_hash",
        F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_repeat_words(F.col("_h"))).cast("long").alias("n_repeat_words"),
        without(r"\p{Lu}").alias("n_upper"), without(r"[^\p{L}\p{N}\s]").alias("n_marks"), without(r"\p{N}").alias("n_digits"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    @property
    def sql(self) -> str:
        return f"coalesce({FEATURES[self.feature]}, 0D) {'>' if self.above else '<='} {self.at!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    @property
    def sql(self) -> str:
        if not self.rules:
            return "true"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql for c in rule)} THEN false" for rule in self.rules) + " ELSE true END"


def _condition_on_bins(rule) -> str:
    return " AND ".join(f"{f} {'>' if above else '<='} {b}" for f, above, b in rule) or "true"


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if p else 0.0


def learn(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", bins: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least_share: float = 0.002) -> DecisionList:
    """Learn rules that find label 0 from the statistics of labelled rows."""
    worst = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(label_col).alias("_y"))
    values = [F.coalesce(F.expr(e), F.lit(0.0)).alias(f) for f, e in FEATURES.items()]
    known = stats.withColumn("_id", F.col("id")).where(f"NOT ({BASE_FAILED})").select("_id", *values).join(worst, "_id")
    names = list(FEATURES)
    points = [i / bins for i in range(1, bins)]
    row = known.agg(*[F.percentile_approx(f, points, 2000).alias(f) for f in names]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in names}
    index = lambda f: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)
    #: least value of each bin; thresholds lie half way below it
    binned = known.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), index(f).alias("b"), F.col(f).alias("v")) for f in names])).alias("x"))
    least = {(r["f"], r["b"]): r["v"] for r in binned.groupBy("x.f", "x.b").agg(F.min("x.v").alias("v")).collect()}
    threshold = lambda f, b: (float(cuts[f][b]) + min([v for (g, k), v in least.items() if g == f and k > b], default=float(cuts[f][b]))) / 2
    cells = written(
        known.select(*[index(f).alias(f) for f in names], (F.col("_y") == 0).alias("bad"), (F.pmod(F.xxhash64("_id"), F.lit(3)) != 0).alias("grow"))
        .groupBy(*names, "bad", "grow").agg(F.count("*").alias("n")), "quality-cells")

    def tally(df: DataFrame) -> dict:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])).alias("x")
        got = df.select(pairs, "bad", "n").groupBy("x.f", "x.b", "bad").agg(F.sum("n").alias("n")).collect()
        found: dict = {f: {} for f in names}
        for r in got:
            found[r["f"]].setdefault(r["b"], [0, 0])[0 if r["bad"] else 1] += r["n"]
        return found

    rest, rules = cells, []
    total = None
    while len(rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        p0 = n0 = None
        while len(rule) < max_conditions:
            counts = tally(rest.where("grow").where(_condition_on_bins(rule)))
            if p0 is None:
                p0, n0 = (sum(v[k] for v in counts[names[0]].values()) for k in (0, 1))
                total = total or p0 + n0
            if not p0 or not n0:
                break
            best = (0.0, None, 0, 0)
            for f in names:
                low = [0, 0]
                for b in range(len(cuts[f])):
                    cell = counts[f].get(b, (0, 0))
                    low = [low[0] + cell[0], low[1] + cell[1]]
                    for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                        if p and (g := _gain(p, n, p0, n0)) > best[0]:
                            best = (g, (f, above, b), p, n)
            if best[1] is None:
                break
            rule.append(best[1])
            _, _, p0, n0 = best
            if not n0:
                break
        if not rule:
            break
        sums = [F.sum(F.when(F.expr(_condition_on_bins(rule[:k])) & F.col("bad" if bad else "ok") & F.col("grow" if grow else "check"), F.col("n")).otherwise(0)).alias(f"s{k}{bad:d}{grow:d}") for k in range(1, len(rule) + 1) for bad in (True, False) for grow in (True, False)]
        s = rest.withColumn("ok", ~F.col("bad")).withColumn("check", ~F.col("grow")).agg(*sums).first()
        worth = lambda k, s=s: ((s[f"s{k}10"] or 0) - (s[f"s{k}00"] or 0)) / max(1, (s[f"s{k}10"] or 0) + (s[f"s{k}00"] or 0))
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:k]
        good = all((s[f"s{k}1{g}"] or 0) >= precision * ((s[f"s{k}1{g}"] or 0) + (s[f"s{k}0{g}"] or 0)) for g in (0, 1))
        if not good or (s[f"s{k}11"] or 0) < max(3, least_share * total) or not (s[f"s{k}10"] or 0):
            break
        rules.append(rule)
        rest = rest.where(f"NOT ({_condition_on_bins(rule)})")
    return DecisionList(tuple(tuple(Condition(f, above, threshold(f, b)) for f, above, b in rule) for rule in rules))


def verdict(rules: DecisionList) -> Column:
    """Whether a row of statistics is kept."""
    return ~F.expr(BASE_FAILED) & F.expr(rules.sql)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that pass the base rules and the list learned from ``labels``, all columns kept, whatever their names.

    The statistics are written once, for learning and for the verdict; texts
    then move at most once.
    """
    stats = written(statistics(docs), "quality-statistics")
    rules = learn(stats, labels)
    bad = stats.where(~verdict(rules)).select("id", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti").select("row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = written(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-statistics")
    rules = learn(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return stats.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), verdict(rules).alias("kept"))
