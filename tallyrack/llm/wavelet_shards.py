"""Token ids in wavelet-matrix shards.

Documents are dealt by id range and sorted, so a partition holds consecutive
documents.  Each is tokenized, ends with an end id, and about ``shard_tokens``
ids at a time become one shard: succinct bit planes, most significant first,
each a stable partition of the one above by its bit, with a rank directory.
A shard is one self-contained, zstd-compressed byte string (see
``WaveletMatrix.to_bytes``); the shards of a task lie in one Parquet file
written by Spark, so any store and any retry works.  ``WaveletMatrix`` answers
access, rank, count, select and occurrences from it.

The start of a document over the whole corpus is its place in the partition
plus the sum of the partitions before, of which there are as many as tasks.

Null texts are empty; null ids come last, equal ids in order of their texts;
other columns are ignored; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import string
import struct
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, tidy_batches

MAGIC = b"WVMX\x01"
SHARD = "part int, seq int, first long, n_tokens long, n_docs long, payload binary"
BLOCK = 512
_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    """Bit planes over ``n`` values with rank and select; ``doc_ids`` and ``doc_sizes`` cut them into documents."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray], n: int, doc_ids: pa.Array, doc_sizes: np.ndarray):
        self.planes, self.zeros, self.ranks, self.n = planes, zeros, ranks, n
        self.levels, self.doc_ids, self.doc_sizes = len(planes), doc_ids, doc_sizes

    @classmethod
    def build(cls, values: np.ndarray, doc_ids=(), doc_sizes=()) -> WaveletMatrix:
        levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        seq = values.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (seq >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low = np.compress(~bits, seq)
            zeros.append(len(low))
            seq = np.concatenate((low, np.compress(bits, seq)))
        return cls(planes, zeros, ranks, len(values), pa.array(doc_ids, pa.int64()), np.asarray(doc_sizes, dtype=np.int64))

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        counts = np.add.reduceat(_COUNT[packed].astype(np.uint32), np.arange(0, len(packed), step)) if len(packed) else np.zeros(0, np.uint32)
        return np.concatenate(([0], np.cumsum(counts))).astype(np.uint32)

    def to_bytes(self) -> bytes:
        import zstandard

        head = struct.pack("<BQQ", self.levels, self.n, len(self.doc_ids))
        absent = np.asarray(self.doc_ids.is_null())  # written as the complement of the size
        body = [head, np.asarray(self.doc_ids.fill_null(0)).astype("<i8").tobytes(), np.where(absent, ~self.doc_sizes, self.doc_sizes).astype("<i8").tobytes()]
        for plane, zero, rank in zip(self.planes, self.zeros, self.ranks, strict=True):
            body += [struct.pack("<QQQ", zero, len(rank), len(plane)), rank.astype("<u4").tobytes(), plane.tobytes()]
        return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import zstandard

        if data[:5] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        raw = zstandard.ZstdDecompressor().decompress(data[5:])
        levels, n, docs = struct.unpack_from("<BQQ", raw)
        at = struct.calcsize("<BQQ")
        ids = np.frombuffer(raw, "<i8", docs, at)
        sizes = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        planes, zeros, ranks = [], [], []
        for _ in range(levels):
            zero, n_rank, n_plane = struct.unpack_from("<QQQ", raw, at)
            at += 24
            ranks.append(np.frombuffer(raw, "<u4", n_rank, at))
            planes.append(np.frombuffer(raw, np.uint8, n_plane, at + 4 * n_rank))
            zeros.append(zero)
            at += 4 * n_rank + n_plane
        return cls(planes, zeros, ranks, n, pa.array(ids, mask=sizes < 0), np.where(sizes < 0, ~sizes, sizes))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = i // BLOCK
        start, stop = block * (BLOCK // 8), i >> 3
        plane = self.planes[level]
        ones = int(self.ranks[level][block]) + int(_COUNT[plane[start:stop]].sum())
        return ones + bin(int(plane[stop]) & ((1 << (i & 7)) - 1)).count("1") if i & 7 else ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often ``value`` stands in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        ones = self.ranks[level].astype(np.int64)
        table = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(table, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(table[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def values(self) -> np.ndarray:
        """All values, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        below = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            here = np.empty(self.n, dtype=kind)
            zero = self.zeros[level]
            here[np.flatnonzero(~bits)] = below[:zero]
            here[np.flatnonzero(bits)] = below[zero:] | kind(1 << (self.levels - 1 - level))
            below = here
        return below

    def documents(self):
        """Yield (doc_id, start in the shard, values)."""
        values, at = self.values(), 0
        for doc, size in zip(self.doc_ids.to_pylist(), self.doc_sizes.tolist(), strict=True):
            yield doc, at, values[at : at + size]
            at += size


class _Pieces(dict):
    """Ids of stretches that start with ``lead``, as little-endian bytes."""

    def __init__(self, owner: ByteLevelEncoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, part: str) -> bytes:
        core = part.rstrip(string.punctuation)
        if not core.isalpha():
            value = self[part] = self.owner.whole(self.lead + part)
        elif len(core) < len(part):  # letters and marks never share a piece
            value = self[core] + self.owner.marks[part[len(core) :]]
            if len(self) < self.owner.most // 3:
                self[part] = value
        else:
            value = self[part] = self.owner.letters(self.lead + part)
        return value

    def shrink(self, most: int) -> None:
        """Keep the entries that came first, the common ones."""
        if len(self) > most:
            for key in list(islice(self, most * 2 // 3, None)):
                del self[key]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class ByteLevelEncoder:
    """The tokenizers library with a bounded table in front of it.

    Byte-level pre-tokenization starts a piece at a lone space between two
    other characters and treats a lone line end between two as a piece, so the
    texts of a batch are cut there, each distinct stretch is looked up or
    encoded once, and the ids are gathered by stretch.  A stretch of letters is
    one piece and goes to the library's merge model at once.  A text with any
    other white space goes to the library whole.
    """

    #: white space (fixed values) that pieces may share, or that stands at an end or next to other white space
    ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000]"

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.table = self.library.model, _byte_letters()
        self.most = most
        self.heads, self.rest = _Pieces(self, ""), _Pieces(self, " ")
        self.marks = _Marks(self)
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin1").translate(self.table))]).tobytes()

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id behind it, and their numbers."""
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        odd = pc.match_substring_regex(texts, self.ODD)
        lines = pc.split_pattern(pc.if_else(odd, "", texts), "\n")
        parts = pc.split_pattern(lines.flatten(), " ")
        coded = parts.flatten().dictionary_encode()
        words, key = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        heads = np.asarray(parts.offsets)[:-1]
        first = np.asarray(lines.offsets)[:-1]  # a text's first line; every text has one, every line has a head
        lone = np.ones(len(key), dtype=bool)
        lone[heads] = False
        used = np.zeros(len(words), dtype=bool)
        used[key[lone]] = True
        rest = np.flatnonzero(used).tolist()
        pieces = list(map(self.rest.__getitem__, words if len(rest) == len(words) else [words[i] for i in rest]))
        place = np.zeros(len(words), dtype=np.int64)
        place[used] = np.arange(len(rest))
        head = key[heads]
        key = place[key]
        # a head brings the line end before it, or the end id of the text before
        end = array("I", [end_id]).tobytes()
        for lead, which in ((self.line, np.setdiff1d(np.arange(len(heads)), first, assume_unique=True)), (end, first)):
            own, back = np.unique(head[which], return_inverse=True)
            key[heads[which]] = len(pieces) + back
            pieces += [lead + self.heads[words[i]] for i in own.tolist()]
        whole = np.flatnonzero(np.asarray(odd))
        key[heads[first[whole]]] = len(pieces) + np.arange(len(whole))
        pieces += [end + self.whole(texts[i].as_py()) for i in whole.tolist()]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        found = sizes[key]
        stop = np.cumsum(found)
        source = np.repeat((np.cumsum(sizes) - sizes)[key] - (stop - found), found)
        source += np.arange(len(source))
        ids = np.empty(len(source), dtype="<u4")
        np.take(np.frombuffer(b"".join(pieces), dtype="<u4"), source[1:], out=ids[:-1])
        ids[-1] = end_id
        self.heads.shrink(self.most // 4)
        self.rest.shrink(self.most)
        self.marks.shrink(self.most // 16)
        return ids, np.add.reduceat(found, heads[first])

    def encode(self, text: str) -> bytes:
        """The ids of one text, without an end id."""
        return self.encode_all(pa.array([text]), 0)[0][:-1].tobytes()


class _Marks(_Pieces):
    def __init__(self, owner: ByteLevelEncoder):
        super().__init__(owner, "")

    def __missing__(self, part: str) -> bytes:
        value = self[part] = self.owner.whole(part)
        return value


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def _slices(batches, most_bytes: int):
    """Cut batches (id, text, bytes of the text) to about ``most_bytes`` of text; a longer text stays whole."""
    for batch in batches:
        ends, start = np.cumsum(np.asarray(batch.column(2))), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 8 << 20) -> None:
    """Tokenize, order by id and write wavelet-matrix shards to the folder ``out``."""

    @tidy_batches
    def run(batches):
        e, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, sizes, tokens, held, first, seq = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            values = np.concatenate(tokens)
            data = WaveletMatrix.build(values, pa.concat_arrays(ids), np.concatenate(sizes)).to_bytes()
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()),
                pa.array([len(values)], pa.int64()), pa.array([sum(map(len, sizes))], pa.int64()), pa.array([data], pa.binary()),
            ], names=["part", "seq", "first", "n_tokens", "n_docs", "payload"])

        for batch in _slices(batches, slice_bytes):
            values, counts = e.encode_all(batch.column(1).fill_null(""), end_id)
            ends, start = np.cumsum(counts), 0
            while start < len(counts):  # a shard ends with the document that fills it
                before = int(ends[start - 1]) if start else 0
                stop = min(len(counts), int(np.searchsorted(ends, before + shard_tokens - held)) + 1)
                ids.append(batch.column(0).slice(start, stop - start))
                sizes.append(counts[start:stop])
                tokens.append(values[before : ends[stop - 1]])
                held += int(ends[stop - 1]) - before
                if held >= shard_tokens:
                    yield shard()
                    first, seq = first + held, seq + 1
                    ids, sizes, tokens, held = [], [], [], 0
                start = stop
        if ids:
            yield shard()

    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("id")).sortWithinPartitions(F.asc_nulls_last("id"), "text")
    dealt.mapInArrow(run, SHARD).write.option("compression", "none").parquet(out)


def read_shards(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32 and, unless left out, ids (little-endian 32-bit)."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part int, base long")

    @tidy_batches
    def run(batches):
        for batch in batches:
            for base, first, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = WaveletMatrix.from_bytes(payload)
                raw = memoryview(shard.values().astype("<u4")).cast("B")
                ends = 4 * np.cumsum(shard.doc_sizes)
                cuts = list(zip((ends - 4 * shard.doc_sizes).tolist(), ends.tolist(), strict=True))
                columns = [shard.doc_ids, pa.array(base + first + ends // 4 - shard.doc_sizes), pa.array(shard.doc_sizes), pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([raw[a:b] for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    # one row per task that wrote shards
    return shards.join(F.broadcast(offsets), "part").select("base", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op6_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_shards(spark, out, with_ids=False)
