"""Two-sided set similarity and the leakage audit against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import similarity as S

FIELDS = "id long, kind long, items array<string>"


def rows_of(rng, n, hot):
    rows = []
    for i in range(n):
        base = [f"b{rng.randrange(6)}-{k}" for k in range(rng.randrange(0, 45))]
        items = [x for x in base if rng.random() > 0.02] + [f"u{rng.randrange(40)}" for _ in range(rng.randrange(2))] + [hot]
        rows.append((rng.choice([None, i, i, 7]), rng.choice([1, 1, 1, None]), rng.choice([items, items, items, [], None, [hot], [hot, None]])))
    return rows + rng.sample(rows, n // 4)


def plain_links(left, right, percent):
    out = []
    for a in left:
        for b in right:
            x, y = ({v for v in r[2] or () if v is not None} for r in (a, b))
            if a[1] == b[1] and 100 * len(x & y) >= percent * len(x | y):
                out.append((a, b))
    return out


def of(spark, rows):
    return spark.createDataFrame(rows, FIELDS).withColumn("elements", S.distinct_elements(F.col("items"))).withColumn("set", S.set_digest(F.col("elements")))


@pytest.mark.parametrize("percent", [60, 80, 95, 100])
def test_links_equal_nested_loop(spark, percent):
    rng = random.Random(percent)
    left, right = rows_of(rng, 60, "hot"), rows_of(rng, 50, "hot")
    got = S.set_links(of(spark, left), of(spark, right), percent).collect()
    want = plain_links(left, right, percent)
    assert sum(r["left_n"] * r["right_n"] for r in got) == len(want)
    assert len({(r["kind"], r["left_set"], r["right_set"]) for r in got}) == len(got)
    sets = lambda v: frozenset(x for x in v or () if x is not None)
    assert len({(a[1], sets(a[2]), sets(b[2])) for a, b in want}) == len(got)


def test_common_element_is_no_key(spark):
    """3,000 different sets share a line that all hold: no pair is even counted in full."""
    left, right = ([(i, 1, ["hot", *[f"{side}{i}-{k}" for k in range(30)]]) for i in range(3000)] for side in "lr")
    keys = S._keys(S._ordered(S._classes(of(spark, left).unionByName(of(spark, right)))), "left", 95)
    assert keys.where(F.col("element") == F.md5(F.lit("hot"))).count() == 0
    assert S.set_links(of(spark, left), of(spark, right), 95).count() == 0


def test_no_rows(spark):
    none = of(spark, [])
    assert S.set_links(none, none, 95).count() == 0 and S.set_links(of(spark, [(1, 1, ["a"])]), none, 80).count() == 0


def test_leakage_counts_equal_nested_loop(spark):
    rng = random.Random(4)
    lines = [f"line {k}" for k in range(25)]

    def some(n):
        rows = []
        for i in range(n):
            text = "\n".join(x for x in rng.sample(lines, 25) if rng.random() > 0.03) if i % 3 else rng.choice(["", None, "a  b", "A b", "a b\n"])
            rows.append((i, text, rng.choice([[], None, ["t1"], ["t2", "t1", None, ""], [f"x{i}"]])))
        return rows + rows[:3]

    public, held = some(30), some(24)
    sides = [S.signatures(spark.createDataFrame(x, "id long, text string, tags array<string>"), "id", F.col("text"), F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), F.col("tags"), F.split("text", "\n"), F.lit(1)) for x in (public, held)]
    got = sorted(tuple(r[c] for c in ("id", "n_identical", "n_canonical", "n_tags", "n_near", "related")) for r in S.leakage_counts(*sides, 90).collect())
    flat = lambda t: None if t is None else " ".join(t.split()).lower()
    parts = lambda t: set() if t is None else set(t.split("\n"))
    tags = {t for r in public for t in r[2] or () if t}
    want = []
    for i, text, own in held:
        same = [p for p in public if text is not None and p[1] == text]
        alike = [p for p in public if text is not None and flat(p[1]) == flat(text)]
        near = [p for p in public if 100 * len(parts(p[1]) & parts(text)) >= 90 * len(parts(p[1]) | parts(text)) and (text is None or flat(p[1]) != flat(text))]
        n = (len(same), len(alike), len(tags & set(own or ())), len(near))
        want.append((i, *n, sum(n) > 0))
    assert got == sorted(want)
