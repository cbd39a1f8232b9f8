r"""Job 2: which held-out documents are related to the public ones, and so leave the final test.

    python -m jobs.split_audit INPUT OUTPUT [--config FILE]

The table at INPUT is split by the config's ``held`` expression (null: public).
Each held-out row gets the number of public rows that it is related to, by
reason: the same text; the same text but for case (A-Z) and white space; shared
tags (what ``tag_pattern`` finds in the whole text); sets of lines alike by
``percent``.  OUTPUT/audit has one row for each held-out row, partitioned by
verdict (``excluded`` or ``clean``); OUTPUT/summary has a row for each verdict.
Both are overwritten, so a repeated run over the same table leaves the same
rows.  Null texts are related to each other by their empty sets of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, settings
from tallyrack.operators import similarity

#: the most files that a verdict is written as
FILES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUDIT = "id bigint, set string, n_identical bigint, n_canonical bigint, n_tags bigint, n_near bigint, verdict string"


def signed(rows: DataFrame, config: dict) -> DataFrame:
    text = F.col(config["text"])
    canonical = F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), UPPER, LOWER)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return similarity.signatures(rows, config["id"], text, canonical, F.regexp_extract_all(text, F.lit(config["tag_pattern"]), F.lit(0)), lines, F.lit(0))


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Audit the split: rows of each side, and of each verdict."""
    config = config or settings("split_audit")
    rows = spark.read.parquet(source)
    side = F.coalesce(F.expr(config["held"]), F.lit(False))
    public, held = (rows.where(s) for s in (~side, side))
    count = {"public": public.count(), "held": held.count()}
    log.info("read %d public and %d held-out rows of %s", count["public"], count["held"], source)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = lambda x: signed(x.select(*{config[c]: None for c in ("id", "text")}).repartition(tasks), config)  # noqa: E731  (a file may be read by few tasks)
    found = similarity.leakage_counts(dealt(public), dealt(held), config["percent"])
    audit = found.select(F.col("id").cast("long").alias("id"), "set", "n_identical", "n_canonical", "n_tags", "n_near", F.when(F.col("related"), "excluded").otherwise("clean").alias("verdict"))
    audit.repartition("verdict", F.xxhash64("id", "set") % FILES).write.mode("overwrite").partitionBy("verdict").parquet(f"{output}/audit")
    found = read(spark, output).groupBy("verdict").agg(F.count("*").alias("rows"), *[F.count_if(F.col(c) > 0).alias(c) for c in ("n_identical", "n_canonical", "n_tags", "n_near")])
    found.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")  # a row for each verdict
    for r in spark.read.parquet(f"{output}/summary").orderBy("verdict").collect():
        count[r["verdict"]] = r["rows"]
        log.info("wrote %d %s rows to %s/audit: %s", r["rows"], r["verdict"], output, r.asDict())
    return {"public": count["public"], "held": count["held"], "excluded": count.get("excluded", 0), "clean": count.get("clean", 0)}


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(f"{output}/audit")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text, coalesce(doc_id % 2 = 1, false) AS held,
         coalesce(list_sort(list_distinct([md5(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])), []) AS l,
         translate(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS canon,
         list_distinct(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS tags
  FROM documents),
s AS (SELECT DISTINCT held, l FROM d),
e AS (SELECT held, l, unnest(l) AS x FROM s),
near AS (
  SELECT p.l AS pl, h.l AS hl FROM e p JOIN e h ON p.x = h.x AND NOT p.held AND h.held GROUP BY p.l, h.l HAVING count(*) * 100 >= (len(p.l) + len(h.l) - count(*)) * 95
  UNION ALL SELECT p.l, h.l FROM s p JOIN s h ON len(p.l) = 0 AND len(h.l) = 0 AND NOT p.held AND h.held),
n1 AS (SELECT h.row, count(*) AS n FROM d h JOIN d p ON h.held AND NOT p.held AND h.text = p.text GROUP BY h.row),
n2 AS (SELECT h.row, count(*) AS n FROM d h JOIN d p ON h.held AND NOT p.held AND h.canon = p.canon GROUP BY h.row),
n3 AS (SELECT row, count(*) AS n FROM (SELECT row, unnest(tags) AS t FROM d WHERE held) WHERE t IN (SELECT unnest(tags) FROM d WHERE NOT held) GROUP BY row),
n4 AS (SELECT h.row, count(*) AS n FROM d h JOIN near ON h.held AND h.l = near.hl JOIN d p ON NOT p.held AND p.l = near.pl WHERE h.canon IS DISTINCT FROM p.canon OR h.canon IS NULL GROUP BY h.row)
SELECT doc_id AS id, sha256(array_to_string(l, '')) AS "set", coalesce(n1.n, 0) AS n_identical, coalesce(n2.n, 0) AS n_canonical, coalesce(n3.n, 0) AS n_tags, coalesce(n4.n, 0) AS n_near,
       CASE WHEN coalesce(n1.n, n2.n, n3.n, n4.n) > 0 THEN 'excluded' ELSE 'clean' END AS verdict
FROM d LEFT JOIN n1 USING (row) LEFT JOIN n2 USING (row) LEFT JOIN n3 USING (row) LEFT JOIN n4 USING (row) WHERE held
"""

if __name__ == "__main__":
    command("split_audit", run, __doc__.splitlines()[0])
