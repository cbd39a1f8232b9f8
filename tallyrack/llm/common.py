"""Shared plumbing of the training-data operators.

Shared folder
    Intermediate tables are Parquet files below the folder that the session
    names in ``spark.checkpoint.dir``; a folder of the process is used only
    where that setting is absent (local tests).

Rows
    An operator never relies on a document id being present or unique.  Ids
    that are null sort behind all others, texts that are null count as empty.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.sources.shared import shared_dir, written

__all__ = ["shared_dir", "written"]

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id written in decimal, modulo ``buckets``; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores behind it where ``columns`` have it already (names ignore case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Blocks:
    """How documents are dealt: ``number`` names a row's block, ``base`` ascends with the id.

    Blocks of one ``base`` hold rows of one id (or of null ids) only.
    """

    number: Column
    base: Column
    count: int
    bytes: int

    def tasks(self, spark: SparkSession, per_task: int = 64 << 20) -> int:
        """Tasks that deal with about ``per_task`` bytes of text each."""
        return max(shuffle_partitions(spark), -(-self.bytes // per_task))

    def bits(self, spark: SparkSession, per_part: int = 64 << 20) -> int:
        """Leading bits of a hash that name a part of what the blocks send."""
        return min(18, max(0, (self.tasks(spark, per_part) - 1).bit_length()))


#: a row counts once for itself and once for each so many bytes
UNIT_BYTES = 4096


def blocks_of(docs: DataFrame, id_col: str, text_col: str, units: int = 5000, quantiles: int = 2048) -> Blocks:
    """Blocks of ascending ids that hold about ``units`` rows or pieces of UNIT_BYTES.

    One aggregate reads ids and lengths.  Ranges follow the quantiles of the
    ids, each row counted by its length; a range still too large is cut evenly
    between its ends, and one that holds a single id, or null ids, by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("s"))
    points = [i / quantiles for i in range(1, quantiles)]
    row = rows.select("k", "s", F.posexplode(F.sequence(F.lit(0), F.floor(F.col("s") / UNIT_BYTES).cast("int"))).alias("u", "_")).agg(
        F.count("*").alias("units"), F.coalesce(F.sum(F.when(F.col("u") == 0, F.col("s"))), F.lit(0)).alias("bytes"), F.count_if(F.col("k").isNull()).alias("absent"),
        F.min("k").alias("least"), F.max("k").alias("greatest"), F.percentile_approx("k", points, F.lit(20 * quantiles)).alias("cuts")).first()
    cell, cuts = (row["units"] - row["absent"]) / quantiles, list(row["cuts"] or [])
    #: upper bound of each range but the last, and into how many blocks it is cut; single: all rows have one id
    bounds: list[int] = []
    parts: list[tuple[int, bool]] = []
    step, inner = max(1, int(units // max(cell, 1e-9))), max(1, math.ceil(cell / units))
    held = 0
    for value, same in itertools.groupby(cuts):
        n = len(list(same))
        if n > 1 and (n + 1) * cell > 2 * units:  # an id with rows for several blocks
            if not bounds or bounds[-1] < value - 1:
                bounds.append(value - 1)
                parts.append((inner, False))
            bounds.append(value)
            parts.append((math.ceil((n + 1) * cell / units), True))
            held = 0
        else:
            held += n
            if held >= step and (not bounds or bounds[-1] < value):
                bounds.append(value)
                parts.append((inner, False))
                held = 0
    parts.append((inner, False))
    none = max(1, math.ceil(row["absent"] / units))
    first = list(itertools.accumulate([n for n, _ in parts], initial=0))
    key, by_text = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    at = range_index(key, bounds)
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)
    if max(n for n, _ in parts) == 1:
        number = base = pick(first[:-1], "int") if bounds else F.lit(0)
    else:
        low = [row["least"], *bounds]
        high = [*bounds, row["greatest"]]
        n = pick([p for p, _ in parts], "long")
        along = F.floor((key - pick(low, "long")).cast("double") / pick([max(1, b - a) for a, b in zip(low, high, strict=True)], "double") * n).cast("long")
        along = F.greatest(F.lit(0).cast("long"), F.least(n - 1, along))
        single = pick([one for _, one in parts], "boolean")
        base = (pick(first[:-1], "long") + F.when(single, F.lit(0).cast("long")).otherwise(along)).cast("int")
        number = (pick(first[:-1], "long") + F.when(single, F.pmod(by_text, n)).otherwise(along)).cast("int")
    last = F.lit(first[-1])
    absent = key.isNull()
    return Blocks(F.when(absent, (last + F.pmod(by_text, F.lit(none))).cast("int")).otherwise(number), F.when(absent, last).otherwise(base), first[-1] + none, int(row["bytes"]))


def range_index(key: Column, bounds: list[int], fan: int = 64) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, by a two-level search."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    level = F.size(F.filter(heads, lambda b: b < key))
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    within = F.size(F.filter(F.get(inner, level - 1), lambda b: b < key))
    return F.when(level == 0, F.lit(0)).otherwise((level - 1) * fan + within).cast("int")


# ---------------------------------------------------------------- worker side


@functools.cache
def _libc():
    name = ctypes.util.find_library("c")
    found = ctypes.CDLL(name) if name else None
    return found if hasattr(found, "malloc_trim") else None


def give_back() -> None:
    """Hand freed memory to the system: Python workers live on beside other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(function):
    """A grouped function of one table, or of two, that gives memory back after each group."""
    def one(table):
        try:
            return function(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return function(left, right)
        finally:
            give_back()

    return two if function.__code__.co_argcount == 2 else one


def tidy_batches(function):
    """A batch iterator that gives memory back when its task ends."""
    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()
    return run


_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_INV = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(values: np.ndarray, width: int, base: int = _ODD) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=U64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(values * powers(inverse, n), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * powers(base, n)[: n - width + 1])


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of a byte buffer."""
    if not len(buf):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
    space = _WS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * powers(_ODD_INV, len(buf)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_ODD, len(buf))[starts]
    return starts, mix64(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def hashed_documents(texts: list[bytes], lower: bool = False, chunk: int = 1 << 19):
    """Yield (index of first document, word counts, word hashes) for runs of documents."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < chunk):
            size += len(texts[j]) + 1
            j += 1
        buf = np.frombuffer(b"\n".join(texts[i:j]), dtype=np.uint8)
        if lower:
            buf = _UPPER[buf]
        starts, hashes = word_hashes(buf)
        at = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        yield i, np.diff(np.searchsorted(starts, at)), hashes
        i = j


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pack_sorted(values: np.ndarray) -> bytes:
    """An ascending, duplicate-free uint64 array as fixed-width gaps."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    body = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + values[:1].astype("<u8").tobytes() + body.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=U64)
    width = data[0]
    body = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body) + 1, 8), dtype=np.uint8)
    out[1:, :width] = body
    values = out.view("<u8").ravel()
    values[0] = np.frombuffer(data, dtype="<u8", count=1, offset=1)[0]
    return np.cumsum(values, dtype=U64)


def covered(marks: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a window of ``width`` that starts at a mark."""
    steps = np.zeros(total + 1, dtype=np.int64)
    starts = np.flatnonzero(marks)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, np.minimum(starts + width, total), 1)
    return np.cumsum(steps[:-1]) > 0
