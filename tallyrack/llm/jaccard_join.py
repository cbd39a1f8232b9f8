"""N-gram Jaccard join by signature trees.

1.  Blocks of ascending ids send their distinct shingle hashes, as packed gaps,
    to the part that the leading bits name, and get each one's document count
    back (saturated at 255).  Shingles of one document can't be in an
    intersection, so a document of which fewer than ``threshold`` per cent are
    shared has no link; what is left are mostly true copies.
2.  Documents of equal sets become one class.
3.  Classes meet in buckets of their rarest shared and of their least shared
    shingle.  In a bucket, a signature tree has the OR of its members' bitmaps
    and their range of sizes in each node; a dual traversal drops pairs of
    nodes by the largest overlap that bitmaps and sizes allow, or if they are
    connected already, and surviving pairs are verified exactly.
4.  For the rest, prefix filtering is complete: two linked classes share one of
    the first n - ceil(t n) + 1 shingles in order of count.  Only shingles that
    still join different components count; those with the same extreme
    components are one bucket, and trees are run once more.
5.  Connected components of the verified links give component_id.

Buckets over ``BUCKET`` classes are dealt into blocks, which then meet through
two members of each component, so that a large group of near copies is mostly
one component before step 4.  In step 4 a bucket holds
sets of two neighbouring size bands only, as sizes of linked sets differ by the
threshold at most, and a larger one is dealt into the pairs of blocks that hold
different components; so no task holds an unbounded bucket and no link is lost.

Null texts and texts without words have an empty set and no link.  Null ids
come last in the order of ids.  Rows of equal id are different documents, told
apart by their texts' order.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, hashed_documents, mix64, pack_sorted, quoted, rolling, shuffle_partitions, tidy, tidy_batches, U64, unpack_sorted, utf8, written
from .components import components

BUCKET = 512
LEAF = 16
#: at most so many crowded groups (of some 30 bytes) are broadcast; beyond, joins on a group are cut into slices
FEW, SLICES = 1 << 18, 8
DOCUMENT = "uid long, key long, text_hash long, n long, fp1 long, fp2 long, rare long, low long, prefix array<long>, shared binary"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a shorter text is one shingle, an empty one none."""
    sets: list[np.ndarray] = []
    for _, counts, hashed in hashed_documents(texts, lower=True):
        whole, at = rolling(hashed, width), 0
        for n in counts.tolist():
            if n >= width:
                sets.append(np.unique(whole[at : at + n - width + 1]))
            else:
                sets.append(mix64(rolling(hashed[at : at + n], n) + U64(n)) if n else np.empty(0, dtype=U64))
            at += n
    return sets


def _sorted_block(group: pa.Table):
    group = group.sort_by([("absent", "ascending"), ("key", "ascending"), ("text", "ascending")])
    return group, utf8(group["text"].combine_chunks())


def _send(width: int, bits: int):
    @tidy
    def send(group: pa.Table) -> pa.Table:
        sets = shingle_sets(_sorted_block(group)[1], width)
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        cuts = np.searchsorted(values, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits)) if bits else []
        rows = [(p, pack_sorted(v), c.tobytes()) for p, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True)) if len(v)]
        block = group["blk"][0].as_py()
        return pa.table({
            "part": pa.array([r[0] for r in rows], pa.int32()), "blk": pa.array([block] * len(rows), pa.int32()),
            "packed": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([zlib.compress(r[2], 1) for r in rows], pa.binary()),
        })
    return send


@tidy
def _answer(group: pa.Table) -> pa.Table:
    lists = [unpack_sorted(x) for x in group["packed"].to_pylist()]
    values = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in group["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    sums = np.minimum(np.add.reduceat(counts[order], np.flatnonzero(first)), 255)
    df = np.empty(len(values), dtype=np.uint8)
    df[order] = sums[np.cumsum(first) - 1]
    found = np.split(df, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"blk": group["blk"], "part": group["part"], "df": pa.array([zlib.compress(x.tobytes(), 1) for x in found], pa.binary())})


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def _describe(width: int, threshold: int):
    kinds = pa.schema([(n, t) for n, t in zip(
        ("uid", "key", "text_hash", "n", "fp1", "fp2", "rare", "low", "prefix", "shared"),
        (*[pa.int64()] * 8, pa.list_(pa.int64()), pa.binary()), strict=True)])

    @tidy
    def describe(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return kinds.empty_table()
        docs, texts = _sorted_block(docs)
        block = docs["blk"][0].as_py()
        sets = shingle_sets(texts, width)
        values = np.unique(np.concatenate(sets))
        answers = answers.sort_by([("part", "ascending")])
        df = np.concatenate([np.empty(0, np.uint8)] + [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in answers["df"].to_pylist()])
        rows = []
        for i, (key, th, s) in enumerate(zip(docs["key"].to_pylist(), docs["text_hash"].to_pylist(), sets, strict=True)):
            n, rare, low, prefix, shared = len(s), None, None, None, None
            fp1, fp2 = (_signed(s.sum(dtype=U64)), _signed(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))) if n else (0, 0)
            if n:
                own = df[np.searchsorted(values, s)]
                common = own > 1
                m = int(common.sum())
                if 100 * m >= threshold * n:
                    kept = s[common]
                    order = np.lexsort((kept, own[common]))
                    first = n - -(-threshold * n // 100) + 1 - (n - m)
                    prefix = kept[order[: max(first, 0)]].view(np.int64).tolist()
                    if prefix:
                        rare, low, shared = prefix[0], _signed(kept[0]), kept.astype("<u8").tobytes()
                    else:
                        prefix = None
            rows.append((block << 32 | i, key, th, n, fp1, fp2, rare, low, prefix, shared))
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return describe


# ------------------------------------------------------------ signature trees


class SignatureTree:
    """Nodes over ranges of rows in order of size: OR of bitmaps, sizes, and most bits lost to collisions."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        width = 1 << max(8, min(16, (4 * max(len(s) for s in sets) - 1).bit_length()))
        self.bits = np.zeros((len(sets), width // 64), dtype=U64)
        for row, s in zip(self.bits, sets, strict=True):
            place = s & U64(width - 1)
            np.bitwise_or.at(row, (place >> U64(6)).astype(np.int64), U64(1) << (place & U64(63)))
        self.lost = np.array([len(s) for s in sets]) - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.sizes = sizes
        self.levels = []
        start = np.arange(0, len(sets), LEAF)
        end = np.minimum(start + LEAF, len(sets))
        node = (np.bitwise_or.reduceat(self.bits, start, axis=0), np.minimum.reduceat(sizes, start), np.maximum.reduceat(sizes, start), np.maximum.reduceat(self.lost, start), start, end)
        self.levels.append(node)
        while len(node[1]) > 1:
            cut = np.arange(0, len(node[1]), 4)
            last = np.minimum(cut + 4, len(node[1])) - 1
            node = (np.bitwise_or.reduceat(node[0], cut, axis=0), np.minimum.reduceat(node[1], cut), np.maximum.reduceat(node[2], cut), np.maximum.reduceat(node[3], cut), node[4][cut], node[5][last])
            self.levels.append(node)


def links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Verified links that join different components, found by a dual traversal of one tree."""
    order = np.argsort(sizes, kind="stable")
    ids, sizes, sets = ids[order], sizes[order], [sets[i] for i in order]
    _, own = np.unique(labels[order], return_inverse=True)
    tree, found = SignatureTree(sizes, sets), []

    def possible(low_a, high_a, low_b, high_b, overlap) -> bool:
        return 100 * high_a >= threshold * low_b and 100 * high_b >= threshold * low_a and (100 + threshold) * overlap >= threshold * (low_a + low_b)

    def leaf(a0: int, a1: int, b0: int, b1: int) -> None:
        overlap = np.bitwise_count(tree.bits[a0:a1, None] & tree.bits[None, b0:b1]).sum(axis=2).astype(np.int64)
        overlap += np.minimum(tree.lost[a0:a1, None], tree.lost[None, b0:b1])
        total = sizes[a0:a1, None] + sizes[None, b0:b1]
        ok = ((100 + threshold) * overlap >= threshold * total) & (100 * sizes[a0:a1, None] >= threshold * sizes[None, b0:b1]) & (100 * sizes[None, b0:b1] >= threshold * sizes[a0:a1, None])
        for i, j in zip(*np.nonzero(ok), strict=True):
            i, j = a0 + int(i), b0 + int(j)
            if i < j and own[i] != own[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= threshold * (int(sizes[i]) + int(sizes[j]) - both):
                    found.append((int(ids[i]), int(ids[j])))
                    own[own == own[j]] = own[i]

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        bits, low, high, lost, start, end = tree.levels[level]
        a0, a1, b0, b1 = int(start[a]), int(end[a]), int(start[b]), int(end[b])
        if a != b:
            overlap = int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(int(lost[a]), int(lost[b]))
            if not possible(int(low[a]), int(high[a]), int(low[b]), int(high[b]), overlap):
                continue
        if (own[a0:a1] == own[a0]).all() and (own[b0:b1] == own[a0]).all():
            continue
        if level == 0:
            leaf(a0, a1, b0, b1)
            continue
        below = len(tree.levels[level - 1][1])
        for i in range(4 * a, min(4 * a + 4, below)):
            for j in range(max(4 * b, i if a == b else 0), min(4 * b + 4, below)):
                stack.append((level - 1, i, j))
    return found


def _linked(threshold: int):
    """Over rows (bucket, uid, n, label, shared) sorted by bucket."""
    def flush(rows):
        if len(rows) < 2:
            return []
        ids, sizes, labels, sets = zip(*{r[0]: r for r in rows}.values(), strict=True)
        return links(np.array(ids), np.array(sizes), [np.frombuffer(s, dtype="<u8") for s in sets], np.array(labels), threshold)

    @tidy_batches
    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            out = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != bucket:
                    out += flush(rows)
                    bucket, rows = key, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])
        if out := flush(rows):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return run


def _in_buckets(rows: DataFrame, threshold: int) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.select("bucket", "uid", "n", "label", "shared").repartition(n, "bucket").sortWithinPartitions("bucket", "uid")
    return dealt.mapInArrow(_linked(threshold), "src long, dst long")


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with uid) left joined with the few rows of ``groups``; no group of ``rows`` meets in one task."""
    groups = written(groups, "jaccard-groups")
    if groups.count() <= FEW:
        return rows.join(F.broadcast(groups), keys, "left")  # counted here
    cut = rows.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(SLICES)).cast("int"))
    return cut.join(groups.withColumn("slice", F.explode(F.array(*[F.lit(i) for i in range(SLICES)]))), [*keys, "slice"], "left").drop("slice")


def _with_sizes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with the size of their group where it is over ``most``, null elsewhere."""
    return _meet(rows, rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > most), keys)


def _across_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets in which every two rows of a group with different labels meet: bucket, uid, n, label.

    A label with many rows has blocks of its own, other labels share blocks;
    blocks meet in pairs, but for two of the same label, which is one component.
    """
    sized = written(_with_sizes(rows, [*keys, "label"], BUCKET), "jaccard-rest")
    place = lambda salt: F.pmod(salt, F.coalesce(F.ceil(F.col("size") / BUCKET), F.lit(1)).cast("long"))
    large = sized.where("size IS NOT NULL").withColumn("own", F.col("label")).withColumn("block", place(F.xxhash64("uid", F.lit(5)))).drop("size")
    other = _with_sizes(sized.where("size IS NULL").drop("size"), keys, BUCKET).withColumn("own", F.lit(None).cast("long")).withColumn("block", place(F.xxhash64("label"))).drop("size")
    placed = written(large.unionByName(other), "jaccard-blocks")
    name = lambda x: F.concat_ws(":", x["own"], x["block"])
    lists = placed.groupBy(*keys).agg(F.collect_set(F.struct("own", "block")).alias("blocks")).where(F.size("blocks") > 1)
    met = _meet(placed, lists, keys).withColumn("me", F.struct("own", "block"))
    partners = F.filter("blocks", lambda b: F.col("own").isNull() | b["own"].isNull() | (b["own"] != F.col("own")))
    met = met.withColumn("with", F.explode(F.coalesce(partners, F.array("me"))))
    return met.select(F.xxhash64(*keys, F.least(name(F.col("me")), name(F.col("with"))), F.greatest(name(F.col("me")), name(F.col("with")))).alias("bucket"), "uid", "n", "label")


def similar_documents(docs: DataFrame, width: int, threshold: int, id_col: str = "doc_id", text_col: str = "text", units: int = 5000) -> DataFrame:
    """key (the id), text_hash, n_shingles, uid, component (least uid), component_key."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_col, text_col, units)
    bits, tasks = blocks.bits(spark), blocks.tasks(spark)
    key, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")
    dealt = docs.select(blocks.number.alias("blk"), key.isNull().alias("absent"), key.alias("key"), text.alias("text"), F.xxhash64(text).alias("text_hash")).repartition(tasks, "blk")
    sent = dealt.groupBy("blk").applyInArrow(_send(width, bits), "part int, blk int, packed binary, counts binary")
    answers = sent.repartition(tasks, "part").groupBy("part").applyInArrow(_answer, "blk int, part int, df binary")
    known = written(dealt.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_describe(width, threshold), DOCUMENT), "jaccard-documents")
    alive = known.where("prefix IS NOT NULL")
    classes = written(alive.groupBy("fp1", "fp2").agg(
        F.min("uid").alias("uid"), *[F.first(c).alias(c) for c in ("n", "rare", "low", "prefix", "shared")]), "jaccard-classes")

    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("rare").alias("token")), F.struct(F.lit(1).alias("kind"), F.col("low").alias("token")))).alias("b")
    spots = classes.select("uid", "n", "shared", kinds).select("uid", "n", "shared", "b.kind", "b.token")
    sized = _with_sizes(spots, ["kind", "token"], BUCKET)
    salt = F.pmod(F.xxhash64("uid", F.lit(3)), F.coalesce(F.ceil(F.col("size") / BUCKET), F.lit(1)).cast("long"))
    near = written(_in_buckets(sized.select(F.xxhash64("kind", "token", salt).alias("bucket"), "uid", "n", F.col("uid").alias("label"), "shared"), threshold), "jaccard-links")

    labels = components(near)
    dealt_out = written(sized.where("size IS NOT NULL").select("kind", "token", "uid"), "jaccard-dealt")
    if not dealt_out.isEmpty():  # parts of crowded buckets meet through two members of each component
        of = dealt_out.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("kind", "token", "uid", F.coalesce("label", "uid").alias("label"))
        drawn = F.struct(F.xxhash64("uid", F.lit(7)), "uid")
        ends = of.groupBy("kind", "token", "label").agg(F.min(drawn).alias("a"), F.max(drawn).alias("b")).select("kind", "token", "label", F.explode(F.array_distinct(F.array("a.uid", "b.uid"))).alias("uid"))
        salt = F.pmod(F.xxhash64("uid", F.lit(11)), F.coalesce(F.ceil(F.col("size") / BUCKET), F.lit(1)).cast("long"))
        again = _with_sizes(ends, ["kind", "token"], BUCKET).select(F.xxhash64("kind", "token", salt).alias("bucket"), "uid", "label").join(classes.select("uid", "n", "shared"), "uid")
        labels = components(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")).union(_in_buckets(again, threshold)))
    named = classes.select("uid", "n", "prefix").join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "n", F.coalesce("label", "uid").alias("label"), "prefix")
    tokens = named.select("uid", "n", "label", F.explode("prefix").alias("token"), F.pmod(F.xxhash64("uid"), F.lit(SLICES)).cast("int").alias("slice"))
    open_tokens = tokens.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z")
    open_tokens = open_tokens.withColumn("slice", F.explode(F.array(*[F.lit(i) for i in range(SLICES)])))  # a frequent one is met in several tasks
    rest = tokens.join(open_tokens, ["token", "slice"]).select("a", "z", "uid", "n", "label").distinct()
    # a little wider than the threshold allows, so rounding can't set linked sizes two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / threshold) * (1 + 1e-9))) if threshold < 100 else F.col("n")
    rest = rest.withColumn("band", F.explode(F.array(band, band + 1)))
    wide = _across_labels(rest, ["a", "z", "band"]).join(classes.select("uid", "shared"), "uid")
    far = _in_buckets(wide, threshold)

    final = components(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")).union(far))
    reps = classes.select("fp1", "fp2", "uid").join(final.withColumnRenamed("node", "uid"), "uid", "left").select("fp1", "fp2", F.coalesce("label", "uid").alias("label"))
    lead = known.select(F.col("uid").alias("label"), F.col("key").alias("component_key"))
    reps = reps.join(lead, "label")
    slim = known.select("uid", "key", "text_hash", "n", "fp1", "fp2", F.col("prefix").isNotNull().alias("alive"))
    # documents without a class keep to themselves and need no exchange
    in_class = slim.where("alive").join(reps, ["fp1", "fp2"]).select("key", "text_hash", F.col("n").alias("n_shingles"), "uid", F.col("label").alias("component"), "component_key")
    alone = slim.where("NOT alive").select("key", "text_hash", F.col("n").alias("n_shingles"), "uid", F.col("uid").alias("component"), F.col("key").alias("component_key"))
    return in_class.union(alone)


def jaccard_components(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of every document."""
    return similar_documents(docs, width, threshold).select(F.col("key").alias("doc_id"), "n_shingles", F.col("component_key").alias("component_id"))


def keep_one_per_component(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with the first document of each component only, all columns kept, whatever their names."""
    found = written(similar_documents(docs, width, threshold).select("key", "text_hash", (F.col("uid") == F.col("component")).alias("first")), "jaccard-kept")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    per_row = found.groupBy("key", "text_hash").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    kept = rows.join(per_row.where("first"), F.col("id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("text_hash")))
    if not per_row.where("first AND n > 1").isEmpty():  # of repeated rows one stays
        kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["id", "hash"]))
    return kept.select("row.*")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4, 85)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(reach.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(g)
"""
