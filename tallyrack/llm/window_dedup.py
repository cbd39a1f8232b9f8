"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark.

Documents are dealt into blocks of ascending ids, of bounded rows and bytes.  A
block sends each distinct 64-bit window hash once, as packed gaps, to the part
that its leading bits name; a part answers every block with one bit per hash:
whether a block of smaller ids has it.  So a window that a third of all
documents hold costs one entry per block, and no task ever holds the
occurrences of a window.  Back in its block, a window goes when its bit is set
or a smaller document of the block has it, and repeated windows merge into
maximal removal intervals.  Both passes read one shuffle of the texts, and the
number of parts follows the bytes.

Null texts are empty; null ids count as larger than every id and as equal to
each other; rows of equal id never remove each other's words.  Columns other
than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, covered, hashed_documents, pack_sorted, quoted, rolling, tidy, U64, unpack_sorted, utf8

ANSWER = "blk int, part int, n long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def block_windows(texts: list[bytes], width: int):
    """Word counts of the documents, and hash and document index of every window in order."""
    counts, hashes, owners = [], [], []
    for first, words, hashed in hashed_documents(texts):
        counts.append(words)
        windows = rolling(hashed, width)
        if not len(windows):
            continue
        ends = np.cumsum(words)
        owner = np.repeat(np.arange(len(words)), words)[: len(windows)]
        inside = np.arange(len(windows)) + width <= ends[owner]
        hashes.append(windows[inside])
        owners.append(owner[inside] + first)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(counts) if counts else none, np.concatenate(hashes) if hashes else none.astype(U64), np.concatenate(owners) if owners else none


def _sorted_block(group: pa.Table):
    """Ids, texts, and the rank of each id in the block, null last."""
    group = group.sort_by([("absent", "ascending"), ("key", "ascending")])
    absent, known = np.asarray(group["absent"]), np.asarray(group["key"].fill_null(0))
    rank = np.cumsum(np.concatenate(([False], (known[1:] != known[:-1]) | (absent[1:] != absent[:-1]))))
    return group["key"].combine_chunks(), utf8(group["text"].combine_chunks()), rank


def _send(width: int, bits: int):
    @tidy
    def send(group: pa.Table) -> pa.Table:
        block, base = group["blk"][0].as_py(), group["base"][0].as_py()
        _, hashes, _ = block_windows(_sorted_block(group)[1], width)
        values = np.unique(hashes)
        cuts = np.searchsorted(values, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits)) if bits else []
        rows = [(p, v) for p, v in enumerate(np.split(values, cuts)) if len(v)]
        return pa.table({
            "part": pa.array([p for p, _ in rows], pa.int32()), "blk": pa.array([block] * len(rows), pa.int32()), "base": pa.array([base] * len(rows), pa.int32()),
            "packed": pa.array([pack_sorted(v) for _, v in rows], pa.binary()),
        })
    return send


@tidy
def _answer(group: pa.Table) -> pa.Table:
    lists = [unpack_sorted(x) for x in group["packed"].to_pylist()]
    sizes = np.array([len(x) for x in lists])
    values, base = np.concatenate(lists), np.repeat(np.asarray(group["base"]), sizes)
    order = np.lexsort((base, values))
    ranked, base = values[order], base[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    seen = np.empty(len(values), dtype=bool)
    seen[order] = base > base[first][np.cumsum(first) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum(sizes)[:-1])]
    return pa.table({"blk": group["blk"], "part": group["part"], "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())}).cast(pa.schema([("blk", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]))


def _cut(width: int):
    @tidy
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array([], pa.string())})
        ids, texts, rank = _sorted_block(docs)
        counts, hashes, owners = block_windows(texts, width)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        answers = answers.sort_by([("part", "ascending")])
        earlier = np.concatenate([np.zeros(0, dtype=bool)] + [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool) for n, b in zip(answers["n"].to_pylist(), answers["bits"].to_pylist(), strict=True)])
        marked = earlier[inverse] | (rank[owners] > rank[owners[first]][inverse]) if len(hashes) else np.zeros(0, dtype=bool)
        at = np.concatenate(([0], np.cumsum(np.maximum(counts - width + 1, 0))))
        removed, spans, kept = [], [], []
        for i, text in enumerate(texts):
            marks = marked[at[i] : at[i + 1]]
            words = text.split()
            if marks.any():
                gone = covered(marks, width, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                removed.append(int(gone.sum()))
                words = [words[k] for k in np.flatnonzero(~gone)]
            else:
                spans.append([])
                removed.append(0)
            kept.append(b" ".join(words).decode())
        return pa.table({
            "doc_id": ids, "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.string()),
        })
    return cut


def remove_repeated_windows(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", units: int = 5000) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word intervals), kept_text (kept words joined by a space).

    A word goes when a window of ``width`` words over it also starts in a
    document with a smaller id.
    """
    spark = docs.sparkSession
    blocks = blocks_of(docs, id_col, text_col, units)
    bits, tasks = blocks.bits(spark), blocks.tasks(spark)
    key = F.col(quoted(id_col)).cast("long")
    dealt = docs.select(blocks.number.alias("blk"), blocks.base.alias("base"), key.isNull().alias("absent"), key.alias("key"), F.col(quoted(text_col)).cast("string").alias("text")).repartition(tasks, "blk")
    sent = dealt.groupBy("blk").applyInArrow(_send(width, bits), "part int, blk int, base int, packed binary")
    answers = sent.repartition(tasks, "part").groupBy("part").applyInArrow(_answer, ANSWER)
    return dealt.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_cut(width), RESULT)


def op10_window_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (t) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
