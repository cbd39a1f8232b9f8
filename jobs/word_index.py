r"""Job 1: a count index of which word follows which, kept up to date as files arrive.

    python -m jobs.word_index INPUT OUTPUT [--config FILE]

A file stream takes the Parquet files of INPUT that its checkpoint has not seen
(``availableNow``) and ends.  Each batch leaves its own ranked counts,
partitioned by part, below OUTPUT/counts/batch=N (surfaces equal to their key
are null there); a batch that is repeated after a failure overwrites its own
folder.  The parts of OUTPUT/index that have counts later than their mark
(``upto``, the last batch in them) are then taken as they are from the one
batch that has counted them, or summed again from all of theirs, and replaced
by dynamic partition overwrite; other parts stay.  A run without new files
writes nothing, and one that was stopped anywhere is finished by the next.

A record is a row of the input: it counts a pair of words (A-Z lower-cased) of
its language once.  The surface kept is that of the least (id, place), so the
index does not depend on how files fall into batches.  Words are
``[^\x20\x09-\x0D]+`` of the whole text; null texts and texts of one word have
no pairs; null languages are ``und``.  Other columns are not read.
The number of ``parts`` must stay as it was when OUTPUT began.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import command, log, ready, settings
from tallyrack.operators import count_index

COUNTS = "subject_key string, relation_key string, answer_key string, answer_surface string, ord struct<id: bigint, place: int>, count bigint, rank int, batch bigint, part int"
INDEX = "subject_key string, relation_key string, answer_key string, answer_surface string, count bigint, rank int, upto bigint, part int"
PACKED = "subject_key string, relation_key string, pairs string"
SLICE = 16 << 20  # bytes of text whose pairs are summed at once, and whose pairs a task sorts
PAIRS = 2_500_000  # as many as a slice has


def part_of(subject: Column, parts: int) -> Column:
    return (F.conv(F.substring(F.md5(subject), 1, 4), 16, 10).cast("int") % parts).cast("int")


def records(rows: DataFrame, config: dict) -> DataFrame:
    """One row for each different pair of neighbouring words of each record, at its first place: what ``count_index.build`` takes."""
    return _unpacked(_pairs(rows, config, True)).drop("count")


def _pairs(rows: DataFrame, config: dict, apart: bool = False) -> DataFrame:
    """Pairs and in how many records each is, packed (see ``_runs``); summed over the records of a slice unless they stay ``apart``.

    Texts are dealt to all tasks first, for a file may be read by few.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.select(*{config[c]: None for c in ("id", "text", "relation")}).repartition(tasks)
    rows = rows.select(F.col(config["id"]).cast("long").alias("id"), F.col(config["text"]).alias("text"), F.coalesce(F.col(config["relation"]).cast("string"), F.lit("und")).alias("relation")).where("text IS NOT NULL")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, start = np.cumsum(np.asarray(pc.binary_length(batch["text"]).cast("int64"))), 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
                yield from _slice_pairs(batch.slice(start, stop - start), apart)
                start = stop

    return rows.mapInArrow(found, PACKED)


def _slice_pairs(batch: pa.RecordBatch, apart: bool) -> Iterator[pa.RecordBatch]:
    words = pc.ascii_split_whitespace(batch["text"])
    doc, words = np.asarray(pc.list_parent_indices(words)), pc.list_flatten(words)
    full = pc.not_equal(words, "")
    doc, surfaces = doc[np.asarray(full)], words.filter(full).dictionary_encode()
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    pair = np.flatnonzero(place[1:] > 0)  # the place of the subject; its answer comes next
    if not len(pair):
        return
    keys = pc.ascii_lower(surfaces.dictionary).dictionary_encode()
    surface = np.asarray(surfaces.indices)
    key, relations = np.asarray(keys.indices)[surface].astype(np.int64), batch["relation"].dictionary_encode()
    relation = np.asarray(relations.indices)[doc].astype(np.int64)
    of = (relation[pair] * len(keys.dictionary) + key[pair]) * len(keys.dictionary) + key[pair + 1]
    order = np.argsort(of, kind="stable")  # by pair, record and place
    of, at = of[order], pair[order] + 1
    first = np.r_[True, (of[1:] != of[:-1]) | (doc[at[1:]] != doc[at[:-1]])]
    of, at = of[first], at[first]
    new = np.r_[True, of[1:] != of[:-1]]
    starts = np.arange(len(of)) if apart else np.flatnonzero(new)
    ids = batch["id"].unique()
    ids = ids.take(pc.array_sort_indices(ids, null_placement="at_start"))
    # the least (id, place), and of equal ones the least surface
    ord_ = (np.asarray(pc.index_in(batch["id"], ids)).astype(np.int64)[doc[at]] << 32) + place[at]
    least = np.minimum.reduceat(ord_, starts)
    counts = np.diff(np.r_[starts, len(of)])
    ranked = pc.array_sort_indices(surfaces.dictionary)
    rank = np.empty(len(ranked), np.int64)
    rank[np.asarray(ranked)] = np.arange(len(ranked))
    chosen = np.minimum.reduceat(np.where(ord_ == np.repeat(least, counts), rank[surface[at]], len(rank)), starts)
    at = at[starts]
    flat = {"subject_key": keys.dictionary.take(pa.array(key[at - 1])), "relation_key": relations.dictionary.take(pa.array(relation[at])), "answer_key": keys.dictionary.take(pa.array(key[at])),
            "answer_surface": surfaces.dictionary.take(ranked.take(pa.array(chosen))), "id": ids.take(pa.array(least >> 32)), "place": pa.array((least & 0xFFFFFFFF).astype(np.int32)), "count": pa.array(counts)}
    yield _runs(flat)


def _runs(flat: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows that follow each other with one subject and relation as one row, so that a shuffle moves few bytes.

    Its pairs stand between spaces: answer, id and place in base 36, the count
    if it is not 1 and the surface if it is not the key, between tabs; words have neither.
    """
    n, cut = len(flat["count"]), np.zeros(max(len(flat["count"]) - 1, 0), bool)
    for c in ("subject_key", "relation_key"):
        cut |= np.asarray(pc.not_equal(flat[c].slice(1), flat[c].slice(0, max(n - 1, 0))))
    starts = np.r_[np.zeros(min(n, 1), np.int64), np.flatnonzero(cut) + 1]
    surface = pc.if_else(pc.equal(flat["answer_surface"], flat["answer_key"]), "", flat["answer_surface"]).fill_null("")
    count = pc.if_else(pc.equal(flat["count"], 1), "", flat["count"].cast("string"))
    pairs = pc.ascii_rtrim(pc.binary_join_element_wise(flat["answer_key"], _base36(flat["id"]), _base36(flat["place"]), count, surface, "\t"), characters="\t")
    pairs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, n].astype(np.int32)), pairs), " ")
    return pa.RecordBatch.from_arrays([*(flat[c].take(pa.array(starts)) for c in ("subject_key", "relation_key")), pairs], names=["subject_key", "relation_key", "pairs"])


def _base36(numbers: pa.Array) -> pa.Array:
    known = numbers.dictionary_encode()
    return pa.array([np.base_repr(v, 36) for v in known.dictionary.to_pylist()], "string").take(known.indices).fill_null("")


def _packed(counts: DataFrame) -> DataFrame:
    """``counts``, which lie in order of subjects, as packed rows."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _runs({c: batch[c] for c in batch.schema.names})

    return counts.select("subject_key", "relation_key", "answer_key", "answer_surface", "ord.id", "ord.place", "count").mapInArrow(packed, PACKED)


def _dealt(packed: DataFrame, tasks: float) -> DataFrame:
    """One shuffle, by what sums and ranks have in common, to so many tasks that each sorts about a slice's pairs."""
    return packed.repartition(max(math.ceil(tasks), packed.sparkSession.sparkContext.defaultParallelism), "subject_key", "relation_key")


def _unpacked(packed: DataFrame) -> DataFrame:
    rows = packed.select("subject_key", "relation_key", F.explode(F.split("pairs", " ")).alias("p")).select("subject_key", "relation_key", F.split("p", "\t").alias("p"))
    field = lambda i: F.nullif(F.get("p", F.lit(i)), F.lit(""))
    number = lambda i: F.conv(field(i), 36, -10)
    ord_ = F.struct(number(1).cast("long").alias("id"), number(2).cast("int").alias("place")).alias("ord")
    return rows.select(ord_, "subject_key", "relation_key", field(0).alias("answer_key"), F.coalesce(field(4), field(0)).alias("answer_surface"), F.coalesce(field(3).cast("long"), F.lit(1)).alias("count"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("subject_key", "relation_key").orderBy(F.desc("count"), "answer_key")))


def take_new(spark: SparkSession, source: str, output: str, config: dict) -> int:
    """Counts of the files that the checkpoint does not know; how many batches."""
    done = []

    def add(batch: DataFrame, number: int) -> None:
        path = f"{output}/counts/batch={number}"
        rows, size = batch.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(config["text"])), F.lit(0))).first()
        found = _ranked(count_index.build(_unpacked(_dealt(_pairs(batch, config), size / SLICE)))).withColumn("part", part_of(F.col("subject_key"), config["parts"]))
        found = found.withColumn("answer_surface", F.nullif("answer_surface", "answer_key"))
        found.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
        log.info("batch %d: read %d rows of %s, wrote %d counts", number, rows, source, ready(spark, path, COUNTS, "part").count())
        done.append(number)

    wanted = list(dict.fromkeys((config["id"], config["text"], config["relation"])))
    table, source = spark.read.parquet(source), source.rstrip("/")
    files = [f.rsplit("/", 1)[1] for f in table.inputFiles()]
    watched = source[:-1] + f"[{source[-1]}]" if files == [source.rsplit("/", 1)[1]] else source  # a stream takes a single file as a pattern only
    files = spark.readStream.schema(table.select(*wanted).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(watched)
    files.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return len(done)


def bring_up(spark: SparkSession, output: str, parts: int) -> list[int]:
    """Sum the parts whose counts are later than their mark; which parts."""
    counts = ready(spark, f"{output}/counts", COUNTS, "batch", "part")
    marks = ready(spark, f"{output}/index", INDEX, "part").groupBy("part").agg(F.max("upto").alias("mark"))
    latest = counts.groupBy("part").agg(F.max("batch").alias("upto"), (F.min("batch") == F.max("batch")).alias("alone"))
    behind = latest.join(marks, "part", "left").where(F.col("mark").isNull() | (F.col("upto") > F.col("mark"))).select("part", "upto", "alone")
    behind = {r["part"]: r for r in behind.collect()}  # at most ``parts`` rows
    stale = sorted(behind)
    if not stale:
        log.info("index: no part is behind")
        return stale
    alone = [p for p in stale if behind[p]["alone"]]
    if not counts.where(F.col("part").isin(alone) & F.col("rank").isNull()).isEmpty():
        alone = []  # counts from before they held ranks
    # what one batch alone has counted is neither summed nor ranked again
    fresh = counts.where(F.col("part").isin(alone)).withColumn("answer_surface", F.coalesce("answer_surface", "answer_key")).withColumnRenamed("batch", "upto")
    several = [p for p in stale if p not in alone]
    if several:
        some = counts.where(F.col("part").isin(several))
        merged = count_index.merge(_unpacked(_dealt(_packed(some), some.count() / PAIRS)).withColumn("shard", F.lit(0)))
        upto = F.create_map(*[F.lit(v).cast(kind) for p in several for v, kind in ((p, "int"), (behind[p]["upto"], "long"))])
        merged = _ranked(merged).withColumn("part", part_of(F.col("subject_key"), parts)).withColumn("upto", upto[F.col("part")])
        fresh = fresh.unionByName(merged, allowMissingColumns=True)
    fresh = fresh.select("subject_key", "relation_key", "answer_key", "answer_surface", "count", "rank", "upto", "part")
    fresh.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{output}/index")
    log.info("index: wrote %d rows in %d parts", index(spark, output).where(F.col("part").isin(stale)).count(), len(stale))
    return stale


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Take what is new and bring the index up to it: how many batches, which parts."""
    config = config or settings("word_index")
    return {"batches": take_new(spark, source, output, config), "parts": bring_up(spark, output, config["parts"])}


def index(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{output}/index")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS record, doc_id, coalesce(lang, 'und') AS lang, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
p AS (SELECT record, doc_id, lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1),
k AS (SELECT *, translate(w[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subject_key, translate(w[i + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS answer_key, w[i + 1] AS surface FROM p)
SELECT subject_key, lang AS relation_key, answer_key, arg_min(surface, (doc_id, i)) AS answer_surface, count(DISTINCT record) AS count,
       (row_number() OVER (PARTITION BY subject_key, lang ORDER BY count(DISTINCT record) DESC, answer_key))::INTEGER AS rank,
       (('0x' || substr(md5(subject_key), 1, 4))::INTEGER % 16)::INTEGER AS part
FROM k GROUP BY subject_key, lang, answer_key
"""

if __name__ == "__main__":
    command("word_index", run, __doc__.splitlines()[0])
