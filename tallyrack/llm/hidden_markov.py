"""Language-model scoring by a hidden Markov model.

Tokens are the ASCII-lower-cased words of a text and one end token.  Latent
states emit symbols: each of the commonest ``OWN`` words (and the end) is its
own symbol, all others share ``SHARED`` classes by hash, and a class emits its
words in proportion to their counts plus one, with one more share for words not
seen.  So the alphabet is bounded, and every token has its exact probability.

Word counts cover all training documents and stay a distributed table; only
the ``TOP`` commonest words go to the workers, other words meet their counts in
a join.  Texts are turned into symbols once.  Baum-Welch passes, each over all
training documents, end when the likelihood of a token grows by less than
``least_gain`` (natural log), or after ``passes``: partitions run the scaled forward and backward recursions
for many documents side by side and emit expected counts, which Spark sums by
symbol.  The scaled forward recursion then gives each text's exact likelihood.

Null texts are empty: an end token only.  Documents with null id train.
Repeated rows count each time and each get a row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, tidy_batches, utf8, written

OWN, SHARED, TOP = 8192, 8192, 1 << 18
STATES = 8
BATCH_TOKENS = 1_500_000
f32 = np.float32


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, empty for the end token), c over all rows of ``text``."""

    @tidy_batches
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for i in range(0, batch.num_rows, 1000):
                counts.update(b"\n".join(utf8(batch.column(0).slice(i, 1000))).lower().split())
            counts[b""] += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int = TOP) -> tuple[list[bytes], np.ndarray]:
    """The commonest words, about ``most``, by descending count then word, and their counts.

    Words are first counted by size class of their count (a power of 2**(1/16)),
    so only words that are kept leave the executors; of the class that does not
    fit whole, those with the least hashes are kept.
    """
    size = F.floor(F.log2(F.col("c")) * 16)
    classes = sorted(((r["k"], r["n"]) for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, held = F.lit(True), 0
    for k, n in classes:
        if held + n > most:
            kept = (size > k) | ((size == k) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < (1 << 30) * (most - held) // n))
            break
        held += n
    table = counts.where(kept).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return table["word"].to_pylist(), np.asarray(table["c"], dtype=np.int64)


class _Words(dict):
    """A common word's rank, or -1 - symbol for another word."""

    def __init__(self, top: list[bytes], own: int, shared: int):
        super().__init__(zip(top, range(len(top)), strict=True))
        self.fixed, self.own, self.shared = len(self), own, shared

    def __missing__(self, word: bytes) -> int:
        value = self[word] = -1 - self.own - (zlib.crc32(word) & (self.shared - 1))
        return value

    def shrink(self) -> None:
        if len(self) > self.fixed + 200_000:
            for word in list(islice(self, self.fixed, None)):
                del self[word]


def symbols_of(top: list[bytes], own: int, shared: int) -> np.ndarray:
    """The symbol of each common word."""
    return np.array([i if i < own else own + (zlib.crc32(w) & (shared - 1)) for i, w in enumerate(top)], dtype=np.uint16)


def symbolized(docs: DataFrame, top: list[bytes], counts: np.ndarray, own: int = OWN, shared: int = SHARED) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known, log_all, log_shared (sums of log10(c+1) of common words), symbols, rare."""

    @tidy_batches
    def run(batches):
        words = _Words(top, own, shared)
        symbol = np.append(symbols_of(top, own, shared), 0).astype(np.uint16)
        log_c = np.append(np.log10(counts + 1.0), 0.0)
        log_s = np.where(symbol >= own, log_c, 0.0)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            n, known, log_all, log_shared, symbols, rare = [], [], [], [], [], []
            for text in utf8(batch.column(3)):
                tokens = text.lower().split()
                tokens.append(b"")
                found = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                other = np.flatnonzero(found < 0)
                ranks = np.maximum(found, -1)
                ids = symbol[ranks]
                ids[other] = -1 - found[other]
                n.append(len(tokens))
                known.append(len(tokens) - len(other))
                log_all.append(float(log_c[ranks].sum()))
                log_shared.append(float(log_s[ranks].sum()))
                symbols.append(ids.tobytes())
                rare.append([{"word": w, "tf": k} for w, k in Counter([tokens[i] for i in other.tolist()]).items()])
            words.shrink()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log_all, pa.float64()),
                pa.array(log_shared, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
            ], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_shared", "symbols", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_all double, log_shared double, symbols binary, rare array<struct<word:binary,tf:long>>")


class _Packed:
    """Documents side by side: place t of all documents that are long enough, longest first."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs])
        self.order = np.argsort(-sizes, kind="stable")
        ranked = sizes[self.order]
        self.width = np.searchsorted(-ranked, -np.arange(ranked[0] if len(ranked) else 0), side="left")  # documents longer than t
        self.start = np.concatenate(([0], np.cumsum(self.width)))
        rank = np.empty(len(docs), dtype=np.int64)
        rank[self.order] = np.arange(len(docs))
        self.symbols = np.empty(int(sizes.sum()), dtype=np.int64)
        place = np.concatenate([np.arange(n) for n in sizes])
        self.symbols[self.start[place] + np.repeat(rank, sizes)] = np.concatenate(docs)


class HiddenMarkov:
    def __init__(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        """first (K,), moves (K, K) and emits (symbols, K); moves and first are rows of probabilities."""
        self.first, self.moves, self.emits = first.astype(f32), moves.astype(f32), np.ascontiguousarray(emits.astype(f32))

    @classmethod
    def start(cls, unigram: np.ndarray, states: int = STATES, seed: int = 3) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emits = unigram[:, None] * np.exp(rng.standard_normal((len(unigram), states)))
        moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return cls(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))

    def forward(self, p: _Packed, keep: bool):
        """Natural log-likelihoods in the documents' order; the scaled states if kept."""
        total, ones = np.zeros(len(p.order)), np.ones(len(self.first), dtype=f32)
        states = np.empty((len(p.symbols), len(self.first)), dtype=f32) if keep else None
        scales = np.empty(len(p.symbols), dtype=f32)
        a = np.tile(self.first, (len(p.order), 1))
        for t, n in enumerate(p.width.tolist()):
            s = p.start[t]
            a = a[:n] @ self.moves if t else a[:n]
            a *= np.take(self.emits, p.symbols[s : s + n], axis=0)
            scale = scales[s : s + n]
            np.matmul(a, ones, out=scale)
            a /= scale[:, None]
            if keep:
                states[s : s + n] = a
        logs = np.log(scales, dtype=np.float64)
        for t, n in enumerate(p.width.tolist()):
            total[:n] += logs[p.start[t] : p.start[t] + n]
        out = np.empty_like(total)
        out[p.order] = total
        return out, states, scales

    def expected(self, p: _Packed):
        """Expected first states, moves and emissions, and the summed log-likelihood."""
        logs, states, scales = self.forward(p, True)
        k = len(self.first)
        moves, back = np.zeros((k, k)), np.ones((0, k), dtype=f32)
        turned = np.ascontiguousarray(self.moves.T)
        for t in range(len(p.width) - 1, -1, -1):
            s, n = p.start[t], int(p.width[t])
            if t + 1 < len(p.width):
                m, z = int(p.width[t + 1]), p.start[t + 1]
                ahead = np.take(self.emits, p.symbols[z : z + m], axis=0)
                ahead *= back
                ahead /= scales[z : z + m, None]
                moves += states[s : s + m].T @ ahead
                back = np.ones((n, k), dtype=f32)
                np.matmul(ahead, turned, out=back[:m])
            else:
                back = np.ones((n, k), dtype=f32)
            states[s : s + n] *= back  # posteriors, now that the moves out of them are counted
        first = states[: int(p.width[0])].sum(axis=0, dtype=np.float64)
        emits = np.stack([np.bincount(p.symbols, weights=states[:, i], minlength=len(self.emits)) for i in range(k)], axis=1)
        return first, moves * self.moves, emits, float(logs.sum())


def _in_batches(batches, column: int):
    """Yield (record batches, documents) of about BATCH_TOKENS tokens."""
    held, docs, n = [], [], 0
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        found = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(column).to_pylist()]
        held.append(batch)
        docs += found
        n += sum(len(x) for x in found)
        if n >= BATCH_TOKENS:
            yield held, docs
            held, docs, n = [], [], 0
    if docs:
        yield held, docs


def baum_welch(table: DataFrame, model: HiddenMarkov, unigram: np.ndarray, prior: float = 50.0) -> tuple[HiddenMarkov, float]:
    """One pass over all training documents: the next model, and the natural log-likelihood under ``model``."""
    k, n_symbols = len(model.first), len(unigram)
    names = [f"s{i}" for i in range(k)]

    @tidy_batches
    def run(batches):
        first, moves, emits, whole = np.zeros(k), np.zeros((k, k)), np.zeros((n_symbols, k)), np.zeros(k)
        for _, docs in _in_batches(batches, 0):
            a, b, c, log = model.expected(_Packed(docs))
            whole[0] += log
            first += a
            moves += b
            emits += c
        used = np.flatnonzero(emits.any(axis=1))
        rows = np.concatenate((whole[None], first[None], moves, emits[used]))
        ids = np.concatenate((np.arange(-k - 2, 0), used))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(rows[:, i]) for i in range(k))], names=["symbol", *names])

    counted = table.where("NOT held_out").select("symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names))
    first, moves, emits, log = np.ones(k), np.ones((k, k)), prior * np.tile(unigram[:, None], (1, k)), 0.0
    for row in counted.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).collect():
        values = np.array(row[1:])
        if row[0] >= 0:
            emits[row[0]] += values
        elif row[0] == -k - 2:
            log = float(values[0])
        elif row[0] == -k - 1:
            first += values
        else:
            moves[row[0] + k] += values
    return HiddenMarkov(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0)), log


def train(table: DataFrame, unigram: np.ndarray, n: int, passes: int = 3, least_gain: float = 0.01) -> tuple[HiddenMarkov, list[float]]:
    """The model, and the log-likelihood that each pass found of the ``n`` training tokens."""
    model, logs = HiddenMarkov.start(unigram), []
    while len(logs) < passes:
        after, log = baum_welch(table, model, unigram)
        logs.append(log)
        model = after
        if len(logs) > 1 and logs[-1] - logs[-2] < least_gain * n:
            break
    return model, logs


def score_documents(docs: DataFrame, passes: int = 3, own: int = OWN, shared: int = SHARED, most: int = TOP) -> DataFrame:
    """docs: doc_id, text, held_out.  doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), passes."""
    spark = docs.sparkSession
    counts = written(word_counts(docs.where("NOT held_out")), "hmm-counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"]), int(whole["v"])
    top, c = common_words(counts, most)
    mass = np.ones(shared)
    seen = np.zeros(shared)
    for r in counts.groupBy(F.crc32("word").bitwiseAND(F.lit(shared - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r["b"]] += r["c"] + r["v"]
        seen[r["b"]] += r["c"]
    home = np.array([zlib.crc32(w) & (shared - 1) for w in top[:own]], dtype=np.int64)
    np.subtract.at(mass, home, c[:own] + 1)
    np.subtract.at(seen, home, c[:own])
    unigram = 1 + np.concatenate((np.pad(c[:own], (0, own - len(c[:own]))), seen))
    unigram /= unigram.sum()
    log_share = np.concatenate((np.zeros(own), np.log10(mass)))

    table = written(symbolized(docs, top, c, own, shared), "hmm-symbols")
    model, logs = train(table, unigram, n, passes)

    @tidy_batches
    def run(batches):
        for held, found in _in_batches(batches, 1):
            logs = model.forward(_Packed(found), False)[0] / np.log(10) - np.array([log_share[d].sum() for d in found])
            at = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs[at : at + batch.num_rows], pa.float64())], names=["uid", "log_symbols"])
                at += batch.num_rows

    scored = table.select("uid", "symbols").mapInArrow(run, "uid long, log_symbols double")
    rare = table.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.tf").join(counts, "word")
    rare = rare.groupBy("uid").agg(F.sum("tf").alias("tf"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_rare"))
    slim = table.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_shared")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return slim.join(scored, "uid").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tf", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_all") + log_rare - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("log_symbols") + F.col("log_shared") + log_rare).alias("score"), F.lit(len(logs)).cast("long").alias("passes"),
    )


def op3_hidden_markov(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False)).alias("held_out")))
