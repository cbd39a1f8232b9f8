"""Suffix-array dedup: remove every byte in a string of ``length`` bytes that also starts elsewhere.

1.  Pieces.  Each window of ``length`` bytes names the least hash of its
    ``GRAM``-byte grams, leftmost among equals, as its anchor, so equal windows
    name equal grams at equal distance.  Windows in a row with one anchor, at
    nearly the same distance from it, are a piece; its key hashes the bytes that
    all windows of that anchor and distance have in common, so equal windows
    stand in pieces of equal key.
2.  Routing.  Blocks of documents send their distinct keys, as packed gaps, to
    the part that the leading bits name, and learn of each whether any other
    piece has it, and whether many different ones have.
3.  Equal pieces of a block are merged by their bytes.  Pieces whose key others
    have go to a bucket by key.  Pieces of a crowded key are first cut into
    stretches of windows whose hash recurs and that stand in one order in all
    places, so a window's places lie in one stretch; each goes to its own bucket.
4.  In a bucket, equal pieces are merged by their bytes, and the suffix array of
    the stretches that may recur in different pieces, built by linear grouping,
    decides: neighbours with a common prefix of ``length`` are repeated windows.
5.  Blocks take the marked spans and cut their documents.

Hashes only say what must meet; bytes decide.  A passage that a third of all
documents hold costs one piece per block, and no bucket grows with the number
of documents around a passage.  Decisions use the input, not what is left.

Null texts are empty.  Repeated rows are different documents that repeat each
other.  Null ids are allowed.  All columns of the input are carried through,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_of, free_name, mix64, _ODD, _ODD_INV, pack_sorted, powers, quoted, tidy, tidy_batches, U64, unpack_sorted, utf8, written
from .suffix_array import suffix_array

GRAM = 32
GROUPS = 2
#: different pieces of one key past which its windows are told apart before they meet
CROWD = 64
CHUNK = 1 << 19
PIECE = [("hash", "<u8"), ("pos", "<u4"), ("len", "<u2")]
LARGEST = U64(0xFFFFFFFFFFFFFFFF)
#: for the byte beside a window: its places differ in it, or a piece ends there
OPEN = 256


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * powers(_ODD_INV, len(buf)), out=sums[1:])
    return sums


def _spans_hash(sums, start, stop):
    return mix64((sums[stop] - sums[start]) * powers(_ODD, len(sums))[start])


def block_pieces(texts: list[bytes], length: int):
    """Keys and pieces of all texts; pos counts bytes from the block's start, hash is that of the bytes."""
    keys, pieces, base, i = [], [], 0, 0
    gram = min(GRAM, length)
    reach = length - gram + 1
    step = -(-reach // GROUPS)
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        lengths = np.array([len(t) for t in texts[i:j]])
        n = int(lengths.sum())
        count = n - length + 1
        if count > 0:
            sums = _prefix_sums(np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8))
            grams = mix64((sums[gram:] - sums[:-gram]) * powers(_ODD, n)[: n - gram + 1])
            shift = U64(32)
            ranked = np.full(-(-len(grams) // reach) * reach, LARGEST)
            ranked[: len(grams)] = (grams >> shift << shift) | np.arange(len(grams), dtype=U64)
            rows = ranked.reshape(-1, reach)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count]) & ((U64(1) << shift) - U64(1))).astype(np.int64)
            owner = np.repeat(np.arange(j - i), lengths)[:count]
            inside = np.arange(count) + length <= np.cumsum(lengths)[owner]
            group = (at - np.arange(count)) // step
            cut = np.concatenate(([True], (at[1:] != at[:-1]) | (group[1:] != group[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])))
            start = np.flatnonzero(inside & cut)
            stop = np.flatnonzero(inside & np.concatenate((cut[1:] | ~inside[1:], [True]))) + length
            anchor, group = at[start], group[start]
            near, far = group * step, np.minimum((group + 1) * step, reach) - 1  # least and greatest distance of the group
            keys.append(mix64(_spans_hash(sums, anchor - near, anchor - far + length) ^ group.astype(U64)))
            e = np.zeros(len(start), dtype=PIECE)
            e["hash"], e["pos"], e["len"] = _spans_hash(sums, start, stop), start + base, stop - start
            pieces.append(e)
        base += n
        i = j
    if not pieces:
        return np.empty(0, dtype=U64), np.zeros(0, dtype=PIECE)
    return np.concatenate(keys), np.concatenate(pieces)


def _sorted_block(group: pa.Table):
    group = group.sort_by([("absent", "ascending"), ("key", "ascending"), ("text", "ascending")])
    return group, utf8(group["text"].combine_chunks())


def _parts(values: np.ndarray, bits: int) -> list[slice]:
    """Where ascending hashes fall into parts by their leading bits."""
    edges = np.searchsorted(values, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits)) if bits else []
    edges = [0, *edges, len(values)]
    return [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _by_value(ranked: np.ndarray):
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(ranked[a]), slice(a, b)


SENT = pa.schema([("part", pa.int32()), ("blk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("digests", pa.binary())])
SENT_DDL = "part int, blk int, keys binary, counts binary, digests binary"
CODES = pa.schema([("blk", pa.int32()), ("part", pa.int32()), ("codes", pa.binary())])


def _send(length: int, bits: int):
    """Each distinct key of a block, with the number (at most 255) and a digest of its different pieces."""
    @tidy
    def send(group: pa.Table) -> pa.Table:
        import zlib

        block = group["blk"][0].as_py()
        keys, e = block_pieces(_sorted_block(group)[1], length)
        order = np.lexsort((e["hash"], keys))
        keys, hashes = keys[order], e["hash"][order]
        rows = []
        if len(keys):
            new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
            distinct = new_key | np.concatenate(([True], hashes[1:] != hashes[:-1]))
            first = np.flatnonzero(new_key[distinct])
            keys, hashes = keys[new_key], hashes[distinct]
            counts = np.minimum(np.diff(np.append(first, len(hashes))), 255).astype(np.uint8)
            digests = np.add.reduceat(hashes, first).astype(np.uint32)
            rows = [(p, block, pack_sorted(keys[x]), zlib.compress(counts[x].tobytes(), 1), digests[x].tobytes()) for p, x in enumerate(_parts(keys, bits)) if x.stop > x.start]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, SENT, strict=True)], schema=SENT)
    return send


@tidy
def _route(group: pa.Table) -> pa.Table:
    """Of each key of each block: 0 if no other piece has it, 2 if over CROWD different ones may, else 1."""
    import zlib

    lists = [unpack_sorted(x) for x in group["keys"].to_pylist()]
    keys = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in group["counts"].to_pylist()]).astype(np.int64)
    digests = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["digests"].to_pylist()])
    order = np.lexsort((counts, digests, keys))
    ranked = keys[order]
    new_key = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    last_alike = np.concatenate((new_key[1:] | (digests[order][1:] != digests[order][:-1]), [True]))
    first = np.flatnonzero(new_key)
    total = np.add.reduceat(counts[order], first)
    different = np.add.reduceat(np.where(last_alike, counts[order], 0), first)
    code = np.empty(len(keys), dtype=np.uint8)
    code[order] = np.where(total < 2, 0, np.where(different > CROWD, 2, 1))[np.cumsum(new_key) - 1]
    found = np.split(code, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table([group["blk"].combine_chunks(), group["part"].combine_chunks(), pa.array([zlib.compress(x.tobytes(), 1) for x in found], pa.binary())], schema=CODES)


#: kind 0: spans pos, len of the block; 1: a piece for the bucket ``key``; 2: packed window hashes for part ``key``, with the bytes before (pos) and behind (len) them; 3: a piece of a crowded key
FOUND = pa.schema([("blk", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("at", pa.int64()), ("dup", pa.bool_()), ("data", pa.binary()), ("pos", pa.binary()), ("len", pa.binary())])
FOUND_DDL = "blk int, kind int, key long, at long, dup boolean, data binary, pos binary, len binary"
PIECES = pa.schema([("key", pa.int64()), ("blk", pa.int32()), ("at", pa.int64()), ("dup", pa.bool_()), ("data", pa.binary())])
PIECES_DDL = "key long, blk int, at long, dup boolean, data binary"


def _merge(pieces: list[bytes]) -> np.ndarray:
    """For each piece, the index of the first one with the same bytes."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, i) for i, x in enumerate(pieces)), dtype=np.int64, count=len(pieces))


def window_hashes(pieces: list[bytes], length: int):
    """Hash, piece and place in the piece of every window."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    hashes, owners, places, i = [], [], [], 0
    ends = np.cumsum(sizes)
    while i < len(pieces):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        sums = _prefix_sums(np.frombuffer(b"".join(pieces[i:j]), dtype=np.uint8))
        count = np.maximum(sizes[i:j] - length + 1, 0)
        owner = np.repeat(np.arange(i, j), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = (ends - sizes)[owner] - before + place
        hashes.append(_spans_hash(sums, start, start + length))
        owners.append(owner)
        places.append(place)
        i = j
    if not hashes:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)


def _groups(hashes: np.ndarray):
    """An order that brings equal hashes together, and where each begins in it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    return order, np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)])


def _agreed(beside: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The byte that all of a group have beside them, else OPEN."""
    if not len(first):
        return np.empty(0, dtype="<u2")
    ranked = beside[order]
    least = np.minimum.reduceat(ranked, first)
    return np.where(least == np.maximum.reduceat(ranked, first), least, OPEN).astype("<u2")


def _beside(pieces: list[bytes], owners: np.ndarray, places: np.ndarray, length: int):
    """The bytes before and behind each window in its piece, OPEN at the piece's ends."""
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype("<u2")
    at = (np.cumsum(sizes) - sizes)[owners] + places
    ends = places + length == sizes[owners]
    return np.where(places == 0, OPEN, data[at - 1]), np.where(ends, OPEN, data[np.where(ends, 0, at + length)])


def _same_windows(pieces: list[bytes], length: int):
    """Of windows whose hash recurs in the list: hashes, owners, places, and the first with the same bytes."""
    hashes, owners, places = window_hashes(pieces, length)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(counts[inverse] > 1) if len(hashes) else np.empty(0, dtype=np.int64)
    first = _merge([pieces[o][p : p + length] for o, p in zip(owners[hot].tolist(), places[hot].tolist(), strict=True)])
    return hashes, owners, places, hot, first


def _gather(length: int, bits: int):
    """What a block finds in itself, and what must meet the pieces of other blocks."""
    @tidy
    def gather(docs: pa.Table, codes: pa.Table) -> pa.Table:
        import zlib

        if not docs.num_rows or not codes.num_rows:
            return FOUND.empty_table()
        block, texts = docs["blk"][0].as_py(), _sorted_block(docs)[1]
        keys, e = block_pieces(texts, length)
        code = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in codes.sort_by([("part", "ascending")])["codes"].to_pylist()])
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        pick = np.flatnonzero((code[which] > 0) | (counts[which] > 1))
        pick = pick[np.argsort(keys[pick], kind="stable")]
        keys, code, e = keys[pick], code[which][pick], e[pick]
        data = b"".join(texts)
        pieces = [data[a : a + n] for a, n in zip(e["pos"].tolist(), e["len"].tolist(), strict=True)]
        first = _merge(pieces)
        alone = first == np.arange(len(first))
        dup = np.bincount(first, minlength=len(first))[first] > 1
        new_key = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
        kinds = np.add.reduceat(alone.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] if len(keys) else np.zeros(0, dtype=np.int64)
        spans = [(e["pos"][dup], e["len"][dup])]
        out = []
        crowded = np.flatnonzero(alone & (code == 2))
        if len(crowded):
            own = [pieces[i] for i in crowded.tolist()]
            at, twice = e["pos"][crowded].astype(np.int64), dup[crowded]
            hashes, owners, places, hot, same = _same_windows(own, length)
            if len(hot):
                many = np.bincount(same, minlength=len(same))[same] > 1
                spans.append(((at[owners[hot]] + places[hot])[many].astype("<u4"), np.full(int(many.sum()), length, dtype="<u2")))
            order, lead = _groups(hashes)
            values, (before, behind) = hashes[order[lead]], (_agreed(x, order, lead) for x in _beside(own, owners, places, length))
            out += [(block, 2, p, None, None, pack_sorted(values[x]), zlib.compress(before[x].tobytes(), 1), zlib.compress(behind[x].tobytes(), 1)) for p, x in enumerate(_parts(values, bits)) if x.stop > x.start]
            out += [(block, 3, None, a, t, x, None, None) for a, t, x in zip(at.tolist(), twice.tolist(), own, strict=True)]
        ready = np.flatnonzero(alone & (code != 2) & ((code == 1) | (kinds > 1)))
        for i in ready[np.argsort(e["pos"][ready])].tolist():  # neighbours overlap, which files keep small
            out.append((block, 1, int(keys[i] >> U64(1)), int(e["pos"][i]), bool(dup[i]), pieces[i], None, None))
        pos, size = (np.concatenate(x) for x in zip(*spans, strict=True))
        if len(pos):
            out.append((block, 0, None, None, None, None, pos.tobytes(), size.tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)
    return gather


@tidy
def _recurring(group: pa.Table) -> pa.Table:
    """Of each window hash of each block, whether another block has it, and whether all have one byte before, and one behind it."""
    import zlib

    lists = [unpack_sorted(x) for x in group["data"].to_pylist()]
    order, first = _groups(np.concatenate(lists))
    sizes = np.diff(np.append(first, len(order)))
    beside = [np.concatenate([np.frombuffer(zlib.decompress(x), dtype="<u2") for x in group[name].to_pylist()]) for name in ("pos", "len")]
    answers = np.empty((3, len(order)), dtype=bool)
    answers[:, order] = np.repeat([sizes > 1, *[_agreed(x, order, first) < OPEN for x in beside]], sizes, axis=1)
    found = np.split(answers, np.cumsum([len(x) for x in lists])[:-1], axis=1)
    return pa.table([group["blk"].combine_chunks(), group["key"].combine_chunks().cast(pa.int32()), pa.array([np.packbits(x).tobytes() for x in found], pa.binary())], schema=CODES)


def _windows(length: int, bits: int):
    """The distinct windows of crowded keys that other blocks have too, joined to stretches, each for a bucket of its own.

    A window joins the one before it if in all blocks the one stands only before
    the other and the other only behind the one.  So a stretch is the same
    wherever one of its windows stands, and the first of them names its bucket.
    """
    @tidy
    def windows(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        if not pieces.num_rows or not answers.num_rows:
            return PIECES.empty_table()
        block, data = pieces["blk"][0].as_py(), pieces["data"].to_pylist()
        at, twice = np.asarray(pieces["at"]), np.asarray(pieces["dup"])
        hashes, owners, places = window_hashes(data, length)
        values = np.unique(hashes)
        answers = answers.sort_by([("part", "ascending")])
        sizes = [x.stop - x.start for x in _parts(values, bits) if x.stop > x.start]
        known = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=3 * n).astype(bool).reshape(3, n) for n, b in zip(sizes, answers["codes"].to_pylist(), strict=True)], axis=1)
        hot, before, behind = known[:, np.searchsorted(values, hashes)]
        joined = np.zeros(len(hashes) + 1, dtype=bool)
        joined[1:-1] = hot[1:] & hot[:-1] & before[1:] & behind[:-1] & (owners[1:] == owners[:-1])
        start, stop = np.flatnonzero(hot & ~joined[:-1]), np.flatnonzero(hot & ~joined[1:])
        owners, last, places, hashes = owners[start], places[stop], places[start], hashes[start]
        found = [data[o][a : b + length] for o, a, b in zip(owners.tolist(), places.tolist(), last.tolist(), strict=True)]
        first = _merge(found)
        dup = (np.bincount(first, minlength=len(first)) > 1) | np.isin(np.arange(len(first)), first[twice[owners]])
        alone = np.flatnonzero(first == np.arange(len(first)))
        return pa.table([
            pa.array((hashes[alone] >> U64(1)).astype(np.int64)), pa.array(np.full(len(alone), block, dtype=np.int32)), pa.array(at[owners[alone]] + places[alone]),
            pa.array(dup[alone]), pa.array([found[i] for i in alone.tolist()], pa.binary())], schema=PIECES)
    return windows


def repeated_windows(pieces: list[bytes], many: np.ndarray, length: int) -> np.ndarray:
    """For the bytes of different pieces one after another, whether the window that starts there is repeated.

    All windows of the pieces that ``many`` marks are: those stand in several
    places.  For the others, stretches of windows whose hash recurs here are
    merged if equal, and the order of all their suffixes shows equal windows
    side by side.
    """
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    marked = np.zeros(int(sizes.sum()), dtype=bool)
    hashes, owners, places = window_hashes(pieces, length)
    marked[base[owners] + places] = many[owners]
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    hot = counts[inverse] > 1 if len(hashes) else np.zeros(0, dtype=bool)
    place, own = places[hot], owners[hot]
    if not len(place):
        return marked
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (own[1:] != own[:-1]), [True])))
    stretches: dict[bytes, list[int]] = {}
    sure: dict[bytes, bool] = {}
    for o, a, b in zip(own[edge[:-1]].tolist(), place[edge[:-1]].tolist(), (place[edge[1:] - 1] + length).tolist(), strict=True):
        text = pieces[o][a:b]
        stretches.setdefault(text, []).append(int(base[o]) + a)
        sure[text] = sure.get(text, False) or bool(many[o])
    joined = b"\0".join(stretches)
    starts = np.cumsum([0] + [len(t) + 1 for t in stretches])
    window, proved = np.zeros(len(joined) + 1, dtype=bool), np.zeros(len(joined) + 1, dtype=bool)
    for a, (text, at) in zip(starts.tolist(), stretches.items(), strict=False):
        window[a : a + len(text) - length + 1] = True
        proved[a : a + len(text) - length + 1] = len(at) > 1 or sure[text]
    symbols = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1
    symbols[starts[1:-1] - 1] = 0
    before, names = -1, window.tolist()
    for i in suffix_array(symbols):
        if names[i]:
            if before >= 0 and joined[i : i + length] == joined[before : before + length]:
                proved[i] = proved[before] = True
            before = i
        else:
            before = -1
    for a, (text, at) in zip(starts.tolist(), stretches.items(), strict=False):
        found = proved[a : a + len(text) - length + 1]
        for k in at:
            marked[k : k + len(found)] |= found
    return marked


SPAN = pa.schema([("blk", pa.int32()), ("pos", pa.binary()), ("len", pa.binary())])


def _compare(length: int, limit: int = CHUNK):
    """Over pieces sorted by bucket: the spans of those that repeat."""
    def flush(blk, pos, dup, pieces):
        first = _merge(pieces)
        alone = np.flatnonzero(first == np.arange(len(first)))
        many = (np.bincount(first, minlength=len(first)) > 1) | np.isin(np.arange(len(first)), first[dup])
        different = [pieces[i] for i in alone.tolist()]
        marked = repeated_windows(different, many[alone], length)
        sizes = np.array([len(x) for x in different], dtype=np.int64)
        owner, base = np.repeat(alone, sizes), np.zeros(len(pieces), dtype=np.int64)
        base[alone] = np.cumsum(sizes) - sizes
        at = np.flatnonzero(marked)
        if not len(at):
            return None
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]), [True])))
        low, own = at[edge[:-1]], owner[at[edge[:-1]]]
        size, low = at[edge[1:] - 1] - low + length, low - base[own]
        order = np.argsort(own, kind="stable")
        low, size, own = low[order], size[order], own[order]
        # each piece takes the spans of the first one with its bytes
        a, b = np.searchsorted(own, first), np.searchsorted(own, first, side="right")
        a, b = np.where(dup, 0, a), np.where(dup, 0, b)
        piece = np.repeat(np.arange(len(pieces)), b - a)
        span = np.arange(len(piece)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        order = np.argsort(blk[piece], kind="stable")
        home, start, size = blk[piece][order], (pos[piece] + low[span])[order].astype("<u4"), size[span][order].astype("<u2")
        out = [(b, start[x].tobytes(), size[x].tobytes()) for b, x in _by_value(home)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPAN, strict=True)], schema=SPAN) if out else None

    @tidy_batches
    def run(batches):
        held: list = []
        size, last = 0, None
        for batch in batches:
            keys = np.asarray(batch.column(0))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate(([keys[0] != last], keys[1:] != keys[:-1]))).tolist()
            last, done = keys[-1], 0
            weight = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(batch.column(4))).astype(np.int64))))
            for cut in cuts:
                if size + int(weight[cut] - weight[done]) >= limit:
                    held.append(batch.slice(done, cut - done))
                    if (found := flush(*_columns(held))) is not None:
                        yield found
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += int(weight[-1] - weight[done])
        if held and (found := flush(*_columns(held))) is not None:
            yield found

    return run


def _columns(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches)
    return np.asarray(table["blk"]), np.asarray(table["at"]), np.asarray(table["dup"]), table["data"].to_pylist()


def _cut(kinds: pa.Schema):
    @tidy
    def cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return kinds.empty_table()
        docs, texts = _sorted_block(docs)
        sizes = np.array([len(t) for t in texts])
        total = int(sizes.sum())
        steps = np.zeros(total + 1, dtype=np.int32)
        for pos, size in zip(spans["pos"].to_pylist(), spans["len"].to_pylist(), strict=True):
            pos = np.frombuffer(pos, "<u4").astype(np.int64)
            np.add.at(steps, pos, 1)
            np.subtract.at(steps, pos + np.frombuffer(size, "<u2"), 1)
        gone = np.cumsum(steps[:-1]) > 0
        removed, n_spans, kept, at = [], [], [], 0
        for text in texts:
            own = gone[at : at + len(text)]
            at += len(text)
            if own.any():
                removed.append(int(own.sum()))
                n_spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
                kept.append(np.compress(~own, np.frombuffer(text, dtype=np.uint8)).tobytes())
            else:
                removed.append(0)
                n_spans.append(0)
                kept.append(text)
        columns = [docs["row"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
    return cut


def remove_repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", units: int = 5000) -> DataFrame:
    """``docs`` with texts that lack the repeated bytes, and a last column ``repeated``.

    ``repeated`` (with underscores behind it where the input has that name) is a
    struct of n_bytes, n_removed, n_spans and kept, the remaining bytes; a cut
    may fall inside a character, which the text then lacks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    blocks = blocks_of(docs, id_col, text_col, units)
    bits, tasks = blocks.bits(spark), blocks.tasks(spark)
    others = [c for c in docs.columns if c != text_col]
    dealt = docs.select(
        F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"), blocks.number.alias("blk"),
        F.col(quoted(id_col)).isNull().alias("absent"), F.col(quoted(id_col)).cast("long").alias("key"),
    ).repartition(tasks, "blk")
    sent = dealt.groupBy("blk").applyInArrow(_send(length, bits), SENT_DDL)
    codes = sent.repartition(tasks, "part").groupBy("part").applyInArrow(_route, "blk int, part int, codes binary")
    found = written(dealt.groupBy("blk").cogroup(codes.groupBy("blk")).applyInArrow(_gather(length, bits), FOUND_DDL), "suffix-pieces")
    answers = found.where("kind = 2").select("key", "blk", "data", "pos", "len").groupBy("key").applyInArrow(_recurring, "blk int, part int, codes binary")
    crowded = found.where("kind = 3").select("blk", "at", "dup", "data").groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_windows(length, bits), PIECES_DDL)
    pieces = found.where("kind = 1").select("key", "blk", "at", "dup", "data").union(crowded)
    compared = pieces.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_compare(length), "blk int, pos binary, len binary")
    spans = found.where("kind = 0").select("blk", "pos", "len").union(compared)
    schema = T.StructType([dealt.schema["row"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType())])
    cut = dealt.groupBy("blk").cogroup(spans.groupBy("blk")).applyInArrow(_cut(to_arrow_schema(schema)), schema)
    report = F.struct("n_bytes", "n_removed", "n_spans", "kept").alias(free_name("repeated", docs.columns))
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns], report)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "repeated.n_bytes", "repeated.n_removed", "repeated.n_spans", F.sha2("repeated.kept", 256).alias("kept_sha256"))
