"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the best pair
whose union is a piece merges first, the leftmost among equals, and symbols
that are no piece fall back to bytes.  Two neighbouring characters that no
piece holds side by side can never merge across, so a text is cut there and
the agenda runs once per distinct stretch; results are kept in bounded tables
of the Python worker.  In every Arrow batch, each stretch that is new to the
worker is encoded and decoded by the sentencepiece library too, and any
difference raises.

Null texts are empty and give the begin and end ids alone.  The operator is
row by row: it keeps repeated rows, null ids and row order, and ignores other
columns.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from array import array
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy_batches

SPACE = "▁"
KEPT = 450_000
ROWS = 256
SHORT = 64
#: A stretch is a run of spaces with what follows; a line end stands alone.
_CUT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_CUT_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CODECS: dict[str, PieceCodec] = {}


class Codec(Exception):
    """The agenda and the sentencepiece library disagree."""


class _Stretches(dict):
    """Ids, as little-endian bytes, of stretches up to a space or line end."""

    def __init__(self, codec: PieceCodec, prefix: str, most: int):
        super().__init__()
        self.codec, self.prefix, self.most, self.fresh = codec, prefix, most, []

    def __missing__(self, part: str) -> bytes:
        core = part.rstrip(string.punctuation)
        if core and len(core) < len(part) and (core[-1], part[len(core)]) not in self.codec.joined:
            value = self[core] + self.codec.heads[part[len(core) :]]  # no piece joins the marks to the word
            if len(self) < self.most // 3:
                self[part] = value
            return value
        ids = self.codec.agenda(self.prefix + part)
        value = self[part] = array("I", ids).tobytes()
        self.fresh.append((part, ids))
        return value

    def shrink(self) -> None:
        """Keep the entries that came first, the common ones."""
        if len(self) > self.most:
            for key in list(islice(self, self.most * 2 // 3, None)):
                del self[key]


class PieceCodec:
    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = {pieces[i]: (lib.get_score(i), i) for i in plain}
        self.scores = {p: s for p, (s, _) in self.pieces.items()}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        self.joined = {(a, b) for i in plain for a, b in zip(pieces[i], pieces[i][1:], strict=False)}
        #: Whether spaces and line ends always start a stretch of their own.
        self.by_space = not any(b == SPACE and a != SPACE for a, b in self.joined)
        self.by_line = not any("\n" in pair for pair in self.joined)
        self.check = check
        self.words = _Stretches(self, SPACE, KEPT)
        self.heads = _Stretches(self, "", KEPT // 4)
        self.line = array("I", self.agenda("\n")).tobytes()

    def agenda(self, text: str) -> list[int]:
        """Merge by score, then leftmost, until no adjacent pair is a piece."""
        if len(text) <= SHORT:
            return self.ids_of(self.short_agenda(text))
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pieces, heap = self.pieces, []

        def offer(left: int, right: int) -> None:
            union = symbols[left] + symbols[right]
            if found := pieces.get(union):
                heapq.heappush(heap, (-found[0], left, right, union))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, union = heapq.heappop(heap)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(union):
                continue
            symbols[left], symbols[right] = union, None
            after[left] = behind = after[right]
            if behind < n:
                before[behind] = left
                offer(left, behind)
            if before[left] >= 0:
                offer(before[left], left)
        return self.ids_of([s for s in symbols if s is not None])

    def ids_of(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            if found := self.pieces.get(s):
                ids.append(found[1])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in s.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def short_agenda(self, text: str) -> list[str]:
        """The same agenda kept as a list: quicker than a heap for the length of words."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        agenda = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda:
            best = max(agenda)
            if best == none:
                break
            i = agenda.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = score(parts[i] + parts[i + 1], none)
            if i:
                agenda[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, begin and end included."""
        body = b""
        if text:
            if not self.bytes or not self.by_space:
                body = array("I", self.agenda(SPACE + text.replace(" ", SPACE))).tobytes()
            else:
                body = self._by_parts(text)
        return array("I", [self.begin]).tobytes() + body + array("I", [self.end]).tobytes()

    def _by_parts(self, text: str) -> bytes:
        if not self.by_line or SPACE in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            heads, line = self.heads.__getitem__, self.line
            cuts = _CUT if self.by_line else _CUT_SPACE
            return b"".join([line if s == "\n" else heads(s) for s in cuts.findall(SPACE + text.replace(" ", SPACE))])
        words = self.words.__getitem__
        out: list[bytes] = []
        for k, row in enumerate(text.split("\n")):
            parts = row.split(" ")
            if k:
                out.append(self.line)
                if parts[0]:
                    out.append(self.heads[parts[0]])
                del parts[0]
            out += map(words, parts)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        data = b"".join([surface[i] for i in array("I", ids)])
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def verify_fresh(self) -> None:
        """Hold every stretch encoded since the last call against the library."""
        for table, lead, skip in ((self.words, "", 0), (self.heads, "\n", 2)):
            fresh, table.fresh = table.fresh, []
            if self.check and fresh:
                texts = [lead + part.replace(SPACE, " ") for part, _ in fresh]
                theirs = self.library.encode(texts, num_threads=1)
                for (part, ids), got in zip(fresh, theirs, strict=True):
                    if part and got[skip:] != ids:
                        raise Codec(f"{part!r}: {ids} but the library has {got[skip:]}")
                back = self.library.decode(theirs, num_threads=1)
                for text, got in zip(texts, back, strict=True):
                    if text.replace(SPACE, " ") != got:
                        raise Codec(f"{text!r} decodes as {got!r}")
            table.shrink()


    def forget(self) -> None:
        """Drop the tables; a worker may serve other stages next."""
        self.words.clear()
        self.heads.clear()


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _sliced(batches):
    """Record batches of few rows: what a worker holds stays small whatever arrives."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ids (little-endian 32-bit, begin and end included), n_tokens and decoded text."""

    @tidy_batches
    def run(batches):
        c = codec(model_path)
        for batch in _sliced(batches):
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            c.verify_fresh()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([c.decode(x) for x in ids], pa.string()),
            ], names=[id_col, "ids", "n_tokens", "decoded"])
        c.forget()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode_decode``, with digests in place of ids and text."""

    @tidy_batches
    def run(batches):
        c = codec(model_path)
        sha = hashlib.sha256
        for batch in _sliced(batches):
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(c.decode(ids).encode()).hexdigest())
            c.verify_fresh()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
