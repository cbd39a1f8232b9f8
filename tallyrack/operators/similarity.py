"""Exact set similarity between two tables, and the leakage audit built on it.

Rows with equal sets are one class, named by a digest of the set, so copies meet
once whatever their number and whatever their ids.  Classes meet in a prefix
join: elements are ordered from rare to common, and a class of n elements puts
down, for each band of sizes that a partner may have, its first n - a + 1
elements, where a is the overlap that the smallest partner of the band needs.
Bands are single sizes up to about percent / (100 - percent), so an element
that all rows hold stands at the end of every order and is hardly ever a key.
A place filter refuses pairs that can't reach their overlap; the others are
counted in full.

Null elements are ignored; a null array is an empty set, and two empty sets are
alike.  Ids may be null or repeated: rows, not ids, are counted.  A set must
fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.sources.shared import written

#: elements in this share of all pairs (class, element) or more are counted by a broadcast table of 1 / share rows at most
COMMON = 1e-4
MOST = (1 << 31) - 1


def distinct_elements(elements: Column) -> Column:
    """Sorted digests of the distinct elements that are not null."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(elements, F.array().cast("array<string>")), lambda x: x.isNotNull()), F.md5)))


def set_digest(elements: Column) -> Column:
    """Digest of a set given by ``distinct_elements``."""
    return F.sha2(F.array_join(elements, ""), 256)


def _classes(rows: DataFrame) -> DataFrame:
    """rows: kind, set (digest), elements.  One row a class: kind, set, elements, size, n (rows)."""
    return rows.groupBy("kind", "set").agg(F.min("elements").alias("elements"), F.count("*").alias("n")).withColumn("size", F.size("elements"))


def band_starts(percent: int) -> list[int]:
    """First size of each band; a band's sizes lie within one step of the similarity."""
    starts = [1]
    while starts[-1] <= MOST:
        starts.append(max(starts[-1] + 1, starts[-1] * 100 // percent))
    return starts


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """Common elements that sizes a and b need: the least whole number of percent (a + b) / (100 + percent) or more."""
    return F.floor((F.lit(percent) * (a + b) + 99 + percent) / (100 + percent)).cast("int")


def _ordered(classes: DataFrame) -> DataFrame:
    """kind, set, size, order: the elements from rare to common (over all ``classes``)."""
    pairs = classes.where("size > 0").select("kind", "set", "size", F.explode("elements").alias("element"))
    counts = written(pairs.groupBy("element").agg(F.count("*").alias("df")), "element-counts")
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    common = F.col("df") >= max(2, int(total * COMMON))
    heavy = F.broadcast(counts.where(common))  # at most 1 / COMMON rows
    light = pairs.join(heavy, "element", "left_anti").join(counts.where(~common), "element")
    ranked = light.unionByName(pairs.join(heavy, "element"))
    return ranked.groupBy("kind", "set", "size").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("order"))


def _keys(ordered: DataFrame, own: str, percent: int) -> DataFrame:
    """Prefix elements for each band of partners: element, left_band, right_band and, named for the side, set, size, place."""
    starts = band_starts(percent)
    table = F.array(*[F.lit(s) for s in starts])
    band = lambda size: F.size(F.filter(table, lambda s: s <= size)) - 1
    least, most = F.ceil(F.col("size") * percent / F.lit(100)).cast("int"), F.floor(F.col("size") * F.lit(100) / percent).cast("int")
    rows = ordered.withColumn("band", band(F.col("size"))).withColumn("least", least).withColumn("most", most)
    rows = rows.select("*", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("other"))
    smallest = F.greatest(F.col("least"), F.get(table, F.col("other")))
    prefix = F.col("size") - overlap_needed(F.col("size"), smallest, percent) + 1
    rows = rows.withColumn("prefix", prefix).where("prefix > 0")
    rows = rows.select("kind", "set", "size", "band", "other", F.posexplode(F.slice("order", F.lit(1), F.col("prefix"))).alias("place", "e")).where("e.df > 1")
    bands = ("band", "other") if own == "left" else ("other", "band")
    return rows.select("kind", F.col("e.element").alias("element"), F.col(bands[0]).alias("left_band"), F.col(bands[1]).alias("right_band"), F.col("set").alias(f"{own}_set"), F.col("size").alias(f"{own}_size"), (F.col("place") + 1).alias(f"{own}_place"))


def set_links(left: DataFrame, right: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """left, right: kind, set, elements (see ``distinct_elements``), a row each.

    Pairs of classes of one kind whose Jaccard is ``percent`` or more: kind,
    left_set, right_set, left_n, right_n (rows of each), shared, jaccard.
    ``once``: both sides are the same rows; each pair of different classes comes once.
    """
    sides = [written(_classes(x.select("kind", "set", "elements")), "set-classes") for x in (left, right)]
    named = [c.select("kind", F.col("set").alias(f"{s}_set"), F.col("n").alias(f"{s}_n"), F.col("elements").alias(f"{s}_elements"), F.col("size").alias(f"{s}_size")) for c, s in zip(sides, ("left", "right"), strict=True)]
    equal = named[0].join(named[1], (named[0]["left_set"] == named[1]["right_set"]) & named[0]["kind"].eqNullSafe(named[1]["kind"])).select(
        named[0]["kind"], "left_set", "right_set", "left_n", "right_n", F.col("left_size").cast("long").alias("shared"), F.lit(1.0).alias("jaccard")).where(F.lit(not once))
    if percent >= 100:
        return equal
    everything = sides[0].withColumn("side", F.lit("left")).unionByName(sides[1].withColumn("side", F.lit("right")))
    ordered = written(_ordered(everything.select(F.struct("side", "kind").alias("kind"), "set", "size", "elements")), "set-orders")
    keys = [_keys(ordered.where(F.col("kind.side") == s).withColumn("kind", F.col("kind.kind")), s, percent) for s in ("left", "right")]
    need = overlap_needed(F.col("left_size"), F.col("right_size"), percent)
    within = (F.least("left_size", "right_size") * 100 >= F.greatest("left_size", "right_size") * percent) & (F.least(F.col("left_size") - F.col("left_place"), F.col("right_size") - F.col("right_place")) + 1 >= need)
    met = keys[0].withColumnRenamed("kind", "k").join(keys[1], (F.col("k").eqNullSafe(F.col("kind"))) & (keys[0]["element"] == keys[1]["element"]) & (keys[0]["left_band"] == keys[1]["left_band"]) & (keys[0]["right_band"] == keys[1]["right_band"]))
    pairs = met.where(((F.col("left_set") < F.col("right_set")) if once else (F.col("left_set") != F.col("right_set"))) & within).select(keys[1]["kind"], "left_set", "right_set").distinct()
    full = pairs.withColumnRenamed("kind", "k")
    for side, name in zip(named, ("left", "right"), strict=True):
        full = full.join(side.withColumnRenamed("kind", f"{name}_kind").withColumnRenamed(f"{name}_set", "s"), (F.col(f"{name}_set") == F.col("s")) & F.col("k").eqNullSafe(F.col(f"{name}_kind"))).drop("s")
    full = full.withColumn("shared", F.size(F.array_intersect("left_elements", "right_elements")).cast("long"))
    union = F.col("left_size") + F.col("right_size") - F.col("shared")
    near = full.where(F.col("shared") * 100 >= union * percent).select(F.col("k").alias("kind"), "left_set", "right_set", "left_n", "right_n", "shared", (F.col("shared") / union).alias("jaccard"))
    return equal.unionByName(near)


def signatures(rows: DataFrame, id_col: str, raw: Column, canonical: Column, tags: Column, elements: Column, kind: Column) -> DataFrame:
    """What the audit compares of a row: id, raw and canonical digests, tags, set and elements, kind.  A null raw or canonical text meets none."""
    tag_list = F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")))
    out = rows.select(F.col(id_col).alias("id"), F.sha2(raw, 256).alias("raw"), F.sha2(canonical, 256).alias("canonical"), tag_list.alias("tags"), distinct_elements(elements).alias("elements"), kind.alias("kind"))
    return out.withColumn("set", set_digest(F.col("elements")))


def leakage_counts(public: DataFrame, held: DataFrame, percent: int = 95) -> DataFrame:
    """public, held: rows of ``signatures``.  One row for each held row, with the public rows that it is linked to, by reason.

    id, set, n_identical (equal raw text), n_canonical (equal canonical text),
    n_tags (of the row's tags, those that a public row has), n_near (sets of
    one kind alike by ``percent``, canonical text not equal), related.
    """
    held = written(held.withColumn("row", F.monotonically_increasing_id()), "leakage-held")  # row numbers are fixed from here on
    public = written(public, "leakage-public")
    out = held.select("row", "id", "raw", "canonical", "kind", "set")
    for column, name in (("raw", "n_identical"), ("canonical", "n_canonical")):
        out = out.join(public.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)), column, "left")
    known = public.select(F.explode("tags").alias("tag")).distinct()
    tagged = held.select("row", F.explode("tags").alias("tag")).join(known, "tag").groupBy("row").agg(F.count("*").alias("n_tags"))
    links = written(set_links(public, held, percent), "leakage-links")
    near = links.groupBy("kind", F.col("right_set").alias("set")).agg(F.sum("left_n").alias("n_alike"))
    texts = [x.where(F.col("canonical").isNotNull()).groupBy("kind", "canonical", F.col("set").alias(f"{s}_set")).agg(F.count("*").alias("n")) for x, s in ((public, "left"), (held, "right"))]
    same = texts[0].join(texts[1].drop("n").withColumnRenamed("kind", "k").withColumnRenamed("canonical", "c"), (F.col("canonical") == F.col("c")) & F.col("kind").eqNullSafe(F.col("k"))).drop("k", "c")
    pairs = links.select(F.col("kind").alias("k"), F.col("left_set").alias("l"), F.col("right_set").alias("r"))
    same = same.join(pairs, (F.col("left_set") == F.col("l")) & (F.col("right_set") == F.col("r")) & F.col("kind").eqNullSafe(F.col("k"))).groupBy("kind", F.col("right_set").alias("set"), "canonical").agg(F.sum("n").alias("n_same"))
    for found, keys in ((near, ("kind", "set")), (same, ("kind", "set", "canonical"))):
        other = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(other, on, "left").drop(*[f"_{k}" for k in keys])
    out = out.join(tagged, "row", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("id", "set", count("n_identical").alias("n_identical"), count("n_canonical").alias("n_canonical"), count("n_tags").alias("n_tags"), (count("n_alike") - count("n_same")).alias("n_near"))
    return out.withColumn("related", F.col("n_identical") + F.col("n_canonical") + F.col("n_tags") + F.col("n_near") > 0)
