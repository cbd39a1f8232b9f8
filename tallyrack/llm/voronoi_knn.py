r"""Exact top-k inner products by a Voronoi kNN join.

Pivots are the distinct vectors of least digest, at most ``pivots`` of them and
within PIVOT_BYTES.  Every vector joins the cell of the pivot with the least
angle.  What the driver learns of a cell is a summary: rows, bytes, greatest
angle, norms, and the k + 1 vectors nearest to the pivot.

*   A query's score with the k + 1 best of those few vectors is a floor for its
    k-th best score, itself left out.  A query cell's floor is its queries' least.
*   A vector at angle b from a query cell's pivot, whose queries lie within a,
    scores at most |q| |s| cos(max(0, b - a)) with them.  Only where that reaches
    the floor is the vector sent to the queries.

Query cells that lie near each other share a group of bounded bytes; a crowded
cell is several groups.  The data of a group is dealt evenly over slices of
bounded bytes, so one vector that fills a third of the table, or a cell that
does, is spread as any other.  A task solves one slice for one group, and the
slices' k best meet by query.

Components become floor(256 x) and are kept as the narrowest of int16, int32
and double that holds the vector.  Products whose sums might leave the exact
range of a double are taken with unbounded integers; a score beyond a long
counts as the nearest long.

On data without clusters the bound cuts nothing (64 random directions lie at
about 65 to 75 degrees from the nearest of 256 pivots): then every group gets
every vector, and the work is that of the query set against all rows in blocks.

Rows whose vector is null, or holds a null or a number that is not finite (or
not after the product with 256), take no part.  Vectors meet those of their own
length only; one vector must fit in a row.  Each row is itself alone: of
repeated rows each is a query and the others are its candidates.  Rows with a
null id are candidates, behind all ids in a tie, and never queries.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, tidy, tidy_batches, written

PIVOT_BYTES = 32 << 20
CELLS = "vec_id long, query boolean, code binary, cell int, norm double, angle double"
ROUTED = "grp int, slice int, row_no long, vec_id long, cell int, code binary"
FOUND = "row_no long, query_id long, vec_id long, score long"
#: the cell of vectors whose length no pivot has
LOOSE = -1
SLACK = 1e-6
LONG = 9e18


# ---------------------------------------------------------------- worker side


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as one byte of width and the narrowest numbers that hold them."""
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return bytes([int(kind[2])]) + values.astype(kind).tobytes()


def by_length(codes: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (places in ``codes``, matrix)."""
    places: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(codes):
        places.setdefault((c[0], len(c)), []).append(i)
    found: dict[int, list] = {}
    for (width, size), at in places.items():
        raw = np.frombuffer(b"".join(codes[i] for i in at), dtype=np.uint8).reshape(len(at), size)[:, 1:]
        kind = {2: "<i2", 4: "<i4", 8: "<f8"}[width]
        found.setdefault((size - 1) // width, []).append((np.array(at), np.ascontiguousarray(raw).view(kind).reshape(len(at), -1).astype(np.float64)))
    return {n: (np.concatenate([a for a, _ in x]), np.concatenate([m for _, m in x])) for n, x in found.items()}


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and unit vectors (a zero vector stays zero)."""
    scale = np.abs(rows).max(axis=1, initial=0, keepdims=True)
    rows = rows / np.where(scale > 0, scale, 1)
    inner = np.sqrt((rows * rows).sum(axis=1))
    return inner * scale[:, 0], rows / np.where(inner > 0, inner, 1)[:, None]


class Pivots:
    """Pivot directions by vector length; pivots number from 0."""

    def __init__(self, codes: list[bytes]):
        self.sets = {n: (at, directions(rows)[1]) for n, (at, rows) in by_length(codes).items()} if codes else {}

    def angles(self, length: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot numbers of that length, and the angle of each row with each."""
        at, pivots = self.sets[length]
        return at, np.arccos(np.clip(units @ pivots.T, -1, 1))


def _codes(batches, column: int = 1):
    """(batch, codes) with every component as floor(256 x)."""
    import pyarrow.compute as pc

    for batch in batches:
        lists = batch.column(column)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        values = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        yield batch, [pack(v) for v in np.split(values, ends)[:-1]]


def _sampler(most: int):
    """The ``most`` distinct vectors of least digest of a partition: digest, code."""
    import pyarrow as pa

    @tidy_batches
    def run(batches):
        held: dict[int, bytes] = {}
        for _, codes in _codes(batches, 0):
            for c in codes:
                held[int.from_bytes(hashlib.blake2b(c, digest_size=7).digest())] = c
            if len(held) > 4 * most:
                held = {d: held[d] for d in sorted(held)[:most]}
        least = sorted(held)[:most]
        yield pa.RecordBatch.from_pydict({"digest": pa.array(least, pa.int64()), "code": pa.array([held[d] for d in least], pa.binary())})

    return run


def _assigner(pivots: Pivots):
    import pyarrow as pa

    @tidy_batches
    def run(batches):
        for batch, codes in _codes(batches):
            n = len(codes)
            cell, norm, angle = np.full(n, LOOSE, dtype=np.int32), np.zeros(n), np.full(n, np.pi)
            for length, (at, rows) in by_length(codes).items():
                norm[at], units = directions(rows)
                if length in pivots.sets:
                    numbers, angles = pivots.angles(length, units)
                    best = angles.argmin(axis=1)
                    cell[at], angle[at] = numbers[best], angles[np.arange(len(at)), best]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "query": batch.column(2), "code": pa.array(codes, pa.binary()), "cell": cell, "norm": norm, "angle": angle})

    return run


def _floors(near: list[bytes], k: int):
    """cell, norm, angle, bytes and floor of each query: its (k + 1)-th best score among the vectors near the pivots."""
    import pyarrow as pa

    known = by_length(near)

    @tidy_batches
    def run(batches):
        for batch in batches:
            codes = batch.column("code").to_pylist()
            floor = np.full(len(codes), -np.inf)
            for length, (at, rows) in by_length(codes).items():
                few = known.get(length, (None, np.empty((0, length))))[1]
                if len(few) > k:
                    with np.errstate(all="ignore"):
                        floor[at] = np.partition(rows @ few.T, len(few) - k - 1, axis=1)[:, len(few) - k - 1]
            floor = np.where(floor >= -LONG, np.minimum(floor, LONG), -np.inf)  # scores beyond a long are ties
            yield pa.RecordBatch.from_pydict({"cell": batch.column("cell"), "norm": batch.column("norm"), "angle": batch.column("angle"), "bytes": pa.array([len(c) for c in codes], pa.int64()), "floor": floor})

    return run


def most_score(q_least, q_most, s_least, s_most, angle) -> np.ndarray:
    """The greatest inner product of vectors of these norms at ``angle`` or more."""
    cos = np.cos(np.maximum(angle, 0))
    with np.errstate(all="ignore"):
        return np.where(cos >= 0, q_most * s_most, q_least * s_least) * cos


@dataclass(frozen=True)
class Route:
    """What tasks must know: a few numbers for each query cell and group."""

    cells: np.ndarray  # query cells
    first: np.ndarray  # the first group of each, and of how many
    parts: np.ndarray
    angle: np.ndarray
    floor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    slices: np.ndarray  # of each group
    needs: dict[int, np.ndarray]  # query cell -> which data cells (shifted by one) may reach its floor


def _spread(row_no: np.ndarray) -> np.ndarray:
    from .common import mix64

    return (mix64(row_no.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)


def _rows_to(batch, take: np.ndarray, grp, part):
    import pyarrow as pa

    chosen = batch.take(pa.array(take))
    return pa.RecordBatch.from_pydict({"grp": pa.array(grp, pa.int32()), "slice": pa.array(part, pa.int32()), **{c: chosen.column(c) for c in ("row_no", "vec_id", "cell", "code")}})


def _query_router(route: Route):
    """Each query to every slice of its group."""
    where = {c: i for i, c in enumerate(route.cells.tolist())}

    @tidy_batches
    def run(batches):
        for batch in batches:
            i = np.array([where[c] for c in batch.column("cell").to_pylist()], dtype=np.int64)
            grp = route.first[i] + _spread(batch.column("row_no").to_numpy()) // 7 % route.parts[i]
            n = route.slices[grp]
            for part in range(int(n.max(initial=0))):
                take = np.flatnonzero(n > part)
                yield _rows_to(batch, take, grp[take], np.full(len(take), part))

    return run


def _data_router(route: Route, pivots: Pivots):
    """Each vector to a slice of every group that it may serve."""
    where = {c: i for i, c in enumerate(route.cells.tolist())}

    @tidy_batches
    def run(batches):
        for batch in batches:
            codes, norm = batch.column("code").to_pylist(), batch.column("norm").to_numpy()
            serves = np.zeros((len(codes), len(route.cells)), dtype=bool)
            if LOOSE in where:
                serves[batch.column("cell").to_numpy() == LOOSE, where[LOOSE]] = True
            for length, (at, rows) in by_length(codes).items():
                if length not in pivots.sets:
                    continue
                numbers, angles = pivots.angles(length, directions(rows)[1])
                for column, cell in enumerate(numbers.tolist()):
                    if cell in where:
                        i = where[cell]
                        reach = most_score(route.least[i], route.most[i], norm[at], norm[at], angles[:, column] - route.angle[i])
                        with np.errstate(all="ignore"):
                            serves[at, i] = ~(reach + SLACK * (1 + route.most[i] * norm[at]) < route.floor[i])  # what is no number serves
            spread = _spread(batch.column("row_no").to_numpy())
            wanted: dict[int, np.ndarray] = {}
            for i in range(len(route.cells)):
                for g in range(int(route.first[i]), int(route.first[i] + route.parts[i])):
                    wanted[g] = wanted[g] | serves[:, i] if g in wanted else serves[:, i]
            for g, mask in wanted.items():
                take = np.flatnonzero(mask)
                if len(take):
                    yield _rows_to(batch, take, np.full(len(take), g), spread[take] % route.slices[g])

    return run


def best_of(queries: np.ndarray, data: np.ndarray, own: np.ndarray, k: int, tile: int = 256, wide: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data row, score) of the k best of each query; equal scores go by data row.  ``own``: the row each query leaves out, or -1."""
    n = len(data)
    size = directions(queries)[0].max(initial=0) * directions(data)[0].max(initial=0)
    out: tuple[list, list, list] = ([], [], [])
    if not (size + 1) * (n + 1) < 1 << 53:  # unbounded integers
        whole = np.array([[int(v) for v in r] for r in data], dtype=object).reshape(data.shape)
        for i, q in enumerate(queries):
            scores = whole.dot(np.array([int(v) for v in q], dtype=object)) if data.shape[1] else [0] * n
            scores = [max(-(1 << 63), min((1 << 63) - 1, v)) for v in scores]
            for j in sorted((j for j in range(n) if j != own[i]), key=lambda j: (-scores[j], j))[:k]:
                for x, v in zip(out, (i, j, scores[j]), strict=True):
                    x.append(v)
        return tuple(np.array(x, dtype=np.int64) for x in out)
    for low in range(0, len(queries), tile):
        some = queries[low : low + tile]
        best = np.full((len(some), 0), -np.inf)
        for left in range(0, n, wide):
            keys = some @ data[left : left + wide].T * (n + 1) - np.arange(left, min(n, left + wide))  # no two alike
            mine = own[low : low + tile]
            inside = np.flatnonzero((mine >= left) & (mine < left + wide))
            keys[inside, mine[inside] - left] = -np.inf
            if keys.shape[1] > k:
                keys = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]
            best = np.concatenate((best, keys), axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero(best > -np.inf)
        keys = best[q, c].astype(np.int64)
        scores = -(-keys // (n + 1))
        for x, v in zip(out, (q + low, scores * (n + 1) - keys, scores), strict=True):
            x.append(v)
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out)


def _solver(route: Route, k: int):
    """One slice for one group."""
    import pyarrow as pa

    schema = pa.schema([("row_no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries, data):
        found = [schema.empty_table()]
        if queries.num_rows and data.num_rows:
            data = data.sort_by([("vec_id", "ascending")])  # null ids last
            ids, rows, cells = data.column("vec_id"), data.column("row_no").to_numpy(), data.column("cell").to_numpy()
            asked, asking = queries.column("row_no").to_numpy(), queries.column("cell").to_numpy()
            place = {r: i for i, r in enumerate(rows.tolist())}
            held = by_length(data.column("code").to_pylist())
            for length, (at, vectors) in by_length(queries.column("code").to_pylist()).items():
                if length not in held:
                    continue
                other, matrix = held[length]
                order = np.argsort(other, kind="stable")
                other, matrix = other[order], matrix[order]
                alike: dict[bytes, list[int]] = {}
                for i, c in enumerate(asking[at].tolist()):
                    alike.setdefault(route.needs[c].tobytes(), []).append(i)
                for need, members in alike.items():
                    keep = np.flatnonzero(np.frombuffer(need, dtype=bool)[cells[other] + 1])
                    if not len(keep):
                        continue
                    mine, theirs = at[members], other[keep]
                    back = {c: i for i, c in enumerate(theirs.tolist())}
                    own = np.array([back.get(place.get(r, -1), -1) for r in asked[mine].tolist()])
                    q, s, score = best_of(vectors[members], matrix[keep], own, k)
                    found.append(pa.table({"row_no": asked[mine[q]], "query_id": queries.column("vec_id").take(pa.array(mine[q])), "vec_id": ids.take(pa.array(theirs[s])), "score": score}).cast(schema))
        return pa.concat_tables(found)

    return tidy(run)


# ---------------------------------------------------------------- driver side


def usable(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, embedding (all finite), query."""
    vec = F.col(vec_col)
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * 256) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("embedding"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("query"))


def pivot_codes(rows: DataFrame, most: int, k: int) -> list[bytes]:
    longest = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    most = max(1, min(most, PIVOT_BYTES // (8 * (longest + 1) * (k + 2))))
    some = rows.select("embedding").mapInArrow(_sampler(most), "digest long, code binary")
    return [bytes(r["code"]) for r in some.groupBy("digest").agg(F.min("code").alias("code")).orderBy("digest").limit(most).collect()]


def _chain(cells: list[int], pivots: Pivots) -> list[int]:
    """The cells so that near ones follow each other; loose vectors come last."""
    out = []
    for numbers, units in (pivots.sets[n] for n in sorted(pivots.sets)):
        left = {c: units[i] for i, c in enumerate(numbers.tolist()) if c in set(cells)}
        at = min(left) if left else None
        while at is not None:
            here = left.pop(at)
            out.append(at)
            at = max(left, key=lambda c: (left[c] @ here, -c)) if left else None  # noqa: B023
    return out + [c for c in cells if c == LOOSE]


def plan_route(asks: dict, holds: dict, pivots: Pivots, tasks: int, group_bytes: int, slice_bytes: int, slice_rows: int) -> Route:
    """asks: query cell -> (rows, bytes, greatest angle, floor, least norm, most norm); holds: data cell -> (rows, bytes, greatest angle, least norm, most norm)."""
    cells = _chain(list(asks), pivots)
    count = max([LOOSE, *asks, *holds]) + 2
    needs = {c: np.zeros(count, dtype=bool) for c in cells}
    units = {c: (n, u[i]) for n, (at, u) in pivots.sets.items() for i, c in enumerate(at.tolist())}
    for c in cells:
        _, _, wide, floor, least, most = asks[c]
        for d, (_, _, far, low, high) in holds.items():
            if c == LOOSE or d == LOOSE:
                needs[c][d + 1] = c == d
            elif units[c][0] == units[d][0]:
                reach = float(most_score(least, most, low, high, np.arccos(np.clip(units[c][1] @ units[d][1], -1, 1)) - wide - far))
                needs[c][d + 1] = not reach + SLACK * (1 + most * high) < floor
    first, parts, groups, size = [], [], [], 0
    for c in cells:
        n = -(-asks[c][1] // group_bytes)
        if n > 1:  # a cell for several groups
            first.append(len(groups))
            groups += [[c] for _ in range(n)]
            size = group_bytes
        else:
            if not groups or size + asks[c][1] > group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(c)
            size += asks[c][1]
            first.append(len(groups) - 1)
        parts.append(max(1, n))
    slices = []
    for members in groups:
        wanted = np.logical_or.reduce([needs[c] for c in members])
        rows, size = (sum(v[i] for d, v in holds.items() if wanted[d + 1]) for i in (0, 1))
        slices.append(max(1, -(-size // slice_bytes), min(-(-tasks // len(groups)), -(-rows // slice_rows))))
    column = lambda i: np.array([asks[c][i] for c in cells], dtype=np.float64)
    return Route(np.array(cells), np.array(first), np.array(parts), column(2), column(3), column(4), column(5), np.array(slices), needs)


def knn_join(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 256,
             group_bytes: int = 16 << 20, slice_bytes: int = 16 << 20, slice_rows: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query row with all other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = usable(vectors, is_query, id_col, vec_col)
    chosen = pivot_codes(rows, pivots, k)
    known = Pivots(chosen)
    cells = rows.mapInArrow(_assigner(known), CELLS).withColumn("row_no", F.monotonically_increasing_id())
    cells = written(cells, "knn-cells")  # row numbers are fixed from here on
    near = cells.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("angle", "row_no"))).where((F.col("nth") <= k + 1) & (F.col("cell") != LOOSE))
    holds = {r["cell"]: (r["n"], r["bytes"], r["wide"], r["least"], r["most"]) for r in cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("code") + 32).alias("bytes"), F.max("angle").alias("wide"), F.min("norm").alias("least"), F.max("norm").alias("most")).collect()}
    queries = cells.where("query")
    floors = queries.mapInArrow(_floors([bytes(r["code"]) for r in near.select("code").collect()], k), "cell int, norm double, angle double, bytes long, floor double")
    asks = {r["cell"]: (r["n"], r["bytes"], r["wide"], r["floor"], r["least"], r["most"]) for r in floors.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(F.col("bytes") + 32).alias("bytes"), F.max("angle").alias("wide"), F.min("floor").alias("floor"), F.min("norm").alias("least"), F.max("norm").alias("most")).collect()}
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    route = plan_route(asks, holds, known, shuffle_partitions(spark), group_bytes, slice_bytes, slice_rows)
    left = queries.mapInArrow(_query_router(route), ROUTED).groupBy("grp", "slice")
    right = cells.mapInArrow(_data_router(route, known), ROUTED).groupBy("grp", "slice")
    found = left.cogroup(right).applyInArrow(_solver(route, k), FOUND)
    order = Window.partitionBy("row_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return knn_join(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
