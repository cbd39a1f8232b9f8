"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text forwards and backwards in spans of ``SPAN`` bytes that
overlap by ``HALO`` bytes on either side, which warm the states up; so every
byte of a whole text is labelled with its context on both sides, and spans of
many documents run side by side as columns of one matrix.  The document's
probability of a language is the mean over its bytes.

It is trained in numpy by backpropagation through time on a bounded sample: at
most about ``per_lang`` labelled documents of each language, drawn by a hash of
id and text, and ``per_text`` windows of ``WINDOW`` bytes of each, at places
that hashes draw from equal stretches of its whole text.  Prediction sees the
text alone, and all of it.

Null texts and texts without a letter are ``und`` with score 0, as is all when
there is nothing to learn from.  Repeated rows and null ids stay rows; other
columns are ignored, whatever their names.  A text must fit in a row; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, tidy_batches

WINDOW = 64
SPAN, HALO = 256, 32
f32 = np.float32


class _Direction:
    """One gated recurrent layer; columns are windows."""

    def __init__(self, hidden: int, rng):
        self.table = (rng.standard_normal((256, 3 * hidden)) * 0.5).astype(f32)
        self.inner = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(f32)
        self.hidden = hidden

    def step(self, table: np.ndarray, h: np.ndarray, x: np.ndarray):
        k = self.hidden
        g = np.take(table, x, axis=0).T
        gates = self.inner[: 2 * k] @ h
        gates += g[: 2 * k]
        gates *= f32(0.5)
        np.tanh(gates, out=gates)
        gates *= f32(0.5)
        gates += f32(0.5)
        r, z = gates[:k], gates[k:]
        c = self.inner[2 * k :] @ (h * r)
        c += g[2 * k :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, r, z, c

    def run(self, xs: np.ndarray, order):
        h = np.zeros((self.hidden, xs.shape[1]), dtype=f32)
        trace = {}
        for t in order:
            new, r, z, c = self.step(self.table, h, xs[t])
            trace[t] = (h, r, z, c, new)
            h = new
        return trace

    def gradients(self, xs: np.ndarray, order, trace, outer):
        """outer(t): gradient that reaches the state of position t from the labels."""
        k = self.hidden
        d_inner, back = np.zeros_like(self.inner), np.zeros((k, xs.shape[1]), dtype=f32)
        pre = np.empty((len(xs), 3 * k, xs.shape[1]), dtype=f32)
        for t in reversed(order):
            h, r, z, c, _ = trace[t]
            d = back + outer(t)
            dc = d * (1 - z) * (1 - c * c)
            d_hr = self.inner[2 * k :].T @ dc
            pre[t, :k] = d_hr * h * r * (1 - r)
            pre[t, k : 2 * k] = d * (h - c) * z * (1 - z)
            pre[t, 2 * k :] = dc
            d_inner[2 * k :] += dc @ (h * r).T
            d_inner[: 2 * k] += pre[t, : 2 * k] @ h.T
            back = d * z + d_hr * r + self.inner[: 2 * k].T @ pre[t, : 2 * k]
        flat, x = pre.transpose(1, 0, 2).reshape(3 * k, -1), xs.ravel()
        return np.stack([np.bincount(x, weights=row, minlength=256) for row in flat], axis=1).astype(f32), d_inner


class ByteGru:
    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.behind = _Direction(hidden, rng), _Direction(hidden, rng)
        self.out = (rng.standard_normal((len(langs), 2 * hidden)) * 0.3).astype(f32)
        self.bias = np.zeros((len(langs), 1), dtype=f32)

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 360, batch: int = 192, rate: float = 0.02, seed: int = 11) -> None:
        """windows: (n, WINDOW) bytes; labels: the index of each window's language."""
        rng = np.random.default_rng(seed)
        by_lang = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(own, -(-batch // len(by_lang))) for own in by_lang if len(own)])
            grads = self.loss_gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
            pace = f32(rate * min(1.0, 2 * (1 - step / (steps + 1))))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                np.clip(g, -1, 1, out=g)
                m += f32(0.1) * (g - m)
                v += f32(0.01) * (g * g - v)
                p -= pace * (m / f32(1 - 0.9**step)) / (np.sqrt(v / f32(1 - 0.99**step)) + f32(1e-8))

    def params(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.inner, self.behind.table, self.behind.inner, self.out, self.bias]

    def loss_gradients(self, xs: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions of (WINDOW, n) bytes, by backpropagation through time."""
        order, k = list(range(len(xs))), self.ahead.hidden
        a, b = self.ahead.run(xs, order), self.behind.run(xs, order[::-1])
        truth = np.zeros((len(self.langs), len(y)), dtype=f32)
        truth[y, np.arange(len(y))] = 1
        errors, d_out = [], np.zeros_like(self.out)
        for t in order:
            state = np.concatenate((a[t][4], b[t][4]))
            p = self._softmax(self.out @ state + self.bias)
            errors.append((p - truth) / f32(len(xs) * len(y)))
            d_out += errors[t] @ state.T
        return [
            *self.ahead.gradients(xs, order, a, lambda t: self.out[:, :k].T @ errors[t]),
            *self.behind.gradients(xs, order[::-1], b, lambda t: self.out[:, k:].T @ errors[t]),
            d_out, sum(errors).sum(axis=1, keepdims=True),
        ]

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x -= x.max(axis=0)
        np.exp(x, out=x)
        x /= x.sum(axis=0)
        return x

    def spans(self, xs: np.ndarray, low: np.ndarray, high: np.ndarray, each=None) -> np.ndarray:
        """Summed probabilities (language, span) of (HALO + SPAN + HALO, n) bytes, of which [low, high) are text; halos don't count."""
        k, steps = self.ahead.hidden, len(xs)
        ragged = bool((low > 0).any() or (high < steps).any())
        h = np.zeros((k, xs.shape[1]), dtype=f32)
        part = np.empty((SPAN, len(self.langs), xs.shape[1]), dtype=f32)
        for t in range(HALO + SPAN):
            h = self.ahead.step(self.ahead.table, h, xs[t])[0]
            if ragged and t < HALO:
                h *= t >= low
            if t >= HALO:
                np.matmul(self.out[:, :k], h, out=part[t - HALO])
        h = np.zeros_like(h)
        total = np.zeros((len(self.langs), xs.shape[1]), dtype=f32)
        for t in range(steps - 1, HALO - 1, -1):
            h = self.behind.step(self.behind.table, h, xs[t])[0]
            if ragged:
                h *= t < high
            if t >= HALO + SPAN:
                continue
            p = self.out[:, k:] @ h
            p += part[t - HALO]
            p += self.bias
            p = self._softmax(p)
            if ragged:
                p *= t < high
            if each is not None:
                each[t - HALO] = p
            total += p
        return total

    @staticmethod
    def _laid_out(text: bytes):
        """The spans of a text with their halos, and where their text starts and ends."""
        n = -(-len(text) // SPAN)
        padded = np.zeros(n * SPAN + 2 * HALO, dtype=np.uint8)
        padded[HALO : HALO + len(text)] = np.frombuffer(text, dtype=np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(padded, SPAN + 2 * HALO)[::SPAN]
        start = SPAN * np.arange(n) - HALO
        return rows, np.maximum(0, -start), np.minimum(SPAN + 2 * HALO, len(text) - start)

    def label_bytes(self, text: bytes) -> list[str]:
        """The language of every byte."""
        rows, low, high = self._laid_out(text)
        each = np.empty((SPAN, len(self.langs), len(rows)), dtype=f32)
        self.spans(np.ascontiguousarray(rows.T), low, high, each)
        best = each.argmax(axis=1).T.ravel()[: len(text)]
        return [self.langs[i] for i in best]

    def documents(self, texts: list[bytes], columns: int = 4096) -> np.ndarray:
        """Mean probabilities (document, language) over all bytes of each text."""
        sums = np.zeros((len(texts), len(self.langs)))
        columns = max(64, min(columns, (1 << 22) // (SPAN * len(self.langs))))
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n + -(-len(texts[j]) // SPAN) <= 4 * columns):
                n += -(-len(texts[j]) // SPAN)
                j += 1
            laid = [(d, *self._laid_out(texts[d])) for d in range(i, j) if texts[d]]
            if laid:
                owner = np.repeat([d for d, *_ in laid], [len(r) for _, r, _, _ in laid])
                rows, low, high = (np.concatenate([x[c] for x in laid]) for c in (1, 2, 3))
                order = np.argsort((low > 0) | (high < SPAN + 2 * HALO), kind="stable")
                for s in range(0, len(rows), columns):
                    pick = order[s : s + columns]
                    np.add.at(sums, owner[pick], self.spans(np.ascontiguousarray(rows[pick].T), low[pick], high[pick]).T)
            i = j
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, per_text: int = 20) -> ByteGru | None:
    """Train on a bounded sample of labelled rows; None if there is none."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND length(text) > 0")
    share = (1_000_000 * F.least(F.lit(1.0), 1.5 * per_lang / F.count("*"))).cast("long")
    shares = rows.groupBy(F.col("lang").alias("of")).agg(share.alias("share"))
    counts = shares.collect()  # a row per language
    if not counts:
        return None
    shares = labelled.sparkSession.createDataFrame(counts, shares.schema)
    drawn = rows.withColumn("h", F.xxhash64("id", "text", F.lit(17))).join(F.broadcast(shares), F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
    free = F.greatest(F.length("text") - WINDOW, F.lit(0))
    pieces = F.least(F.lit(per_text), F.ceil(F.length("text") / (WINDOW // 2)).cast("int"))
    place = lambda i: F.floor(free * (i + F.pmod(F.xxhash64("h", i), F.lit(1000)) / 1000) / pieces).cast("int") + 1
    windows_of = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(F.col("text"), place(i), F.lit(WINDOW)))
    got = drawn.select("lang", "h", windows_of.alias("windows")).limit(2 * per_lang * len(counts)).collect()
    langs = sorted({r["lang"] for r in got})
    windows, labels = [], []
    for r in sorted(got, key=lambda r: (r["h"], r["lang"], r["windows"])):
        for w in r["windows"]:
            windows.append(w.encode()[:WINDOW].ljust(WINDOW, b" "))
            labels.append(langs.index(r["lang"]))
    if not windows:
        return None
    model = ByteGru(langs)
    model.train(np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WINDOW), np.array(labels))
    return model


def predict(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, lang_pred and score of every document."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if model is None:
        return rows.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @tidy_batches
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = model.documents([b"" if t is None else t.encode() for t in texts])
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(["und" if t is None else model.langs[k] for t, k in zip(texts, best, strict=True)], pa.string()),
                pa.array([0.0 if t is None else min(1.0, float(row[k])) for t, row, k in zip(texts, p, best, strict=True)], pa.float64()),
            ], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def op5_byte_gru(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
