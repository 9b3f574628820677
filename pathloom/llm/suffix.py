"""Exact removal of repeated byte strings by a distributed, common-prefix-aware suffix sort.

Every byte that lies in a ``least``-byte string which also starts elsewhere, in any text, is removed. Sorting
all suffixes would move many times the corpus, so only those are sorted that can decide a window:

1. Anchors. A window (``least`` bytes) is represented by the 32-byte gram in it with the smallest hash, leftmost on
   ties. Equal windows have the anchor at the same offset; about one position in 85 is an anchor. The
   windows that share an anchor are consecutive; the bytes they span, left and right of it, are its context.
2. Distinguishing prefixes. The grams' hashes are counted; an anchor whose gram occurs once has no twin and its
   suffix is told apart already. Grams that occur very often are ranked behind all others and the
   anchors chosen anew: a window at the edge of a common passage then gets an anchor of its own.
3. Runs. A task sorts the suffixes from its remaining anchors and front-codes them (bytes shared with the
   suffix before are not repeated); of suffixes with the same gram, the contexts to the left, read backwards, are sorted and
   front-coded likewise. Contexts that the sort finds equal are settled there and go into the run once.
4. Merge. The owner of a hash range combines its runs with a loser tree. Every contender carries the length of the
   prefix known to be shared with the last suffix put out; only on equal lengths are bytes
   compared, from that length on. Where a common prefix is shorter than a gram, a group of suffixes is complete; the
   group's left contexts are merged by a tree of their own. What is in memory is an owner's runs, whose number of
   owners bounds in bytes, and a batch of groups.
5. Windows. For each offset, two anchors have equal windows if no common prefix between them is too short on the
   right nor on the left; such windows are marked and their bytes removed.

Bytes are compared throughout; hashes only choose anchors and rule out. ``kept`` may cut a UTF-8 sequence,
so the text that is left is given as bytes.

Edge cases: a null text is empty; texts shorter than a window lose nothing; rows that repeat an id are told apart by
a hash of their text, and rows that repeat both are the same text, which repeats; ids may have any type and null ids pass
through; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, shuffle_width, written

GRAM = 32
#: Texts are worked on in buffers of at most so many bytes (positions have 24 bits), whose arrays a processor's cache holds.
BUFFER = 128_000
_PLACE = np.uint64((1 << 24) - 1)
#: What an entry weighs in a run, compressed, about.
_ENTRY_BYTES = 150


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd base and of its inverse, modulo 2 ** 64."""
    rng = np.random.default_rng(7)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    found = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps, dtype=np.uint64))
    return rng.integers(0, 1 << 64, 256, np.uint64), found[0], found[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the gram at each position, by a rolling polynomial and a final mix."""
    n = len(data)
    values, powers, inverses = _powers(BUFFER + 1024)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverses[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


#: The last sorted array and its table of 20-bit prefixes.
_TABLE: list = [None, None]


def _marked(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array common: a table of prefixes rules out most. The table is kept as long as the
    same array is asked for."""
    if _TABLE[0] is not common:
        table = np.zeros(1 << 20, bool)
        table[(common >> np.uint64(44)).astype(np.int64)] = True
        _TABLE[:] = common, table
    found = _TABLE[1][(hashes >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(found)
    found[at] = _held(hashes[at], common)
    return found


def _held(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array known."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def anchors(data: np.ndarray, ends: np.ndarray, least: int, common: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) for every anchor of the texts that end at ends; hashes: of all grams,
    if they are known."""
    none = np.empty(0, np.int64)
    n = len(data) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64), none, none, none
    hashes = gram_hashes(data) if hashes is None else hashes
    keys = hashes >> np.uint64(1)
    if len(common):
        keys[_marked(hashes, common)] |= np.uint64(1 << 63)
    keys &= ~_PLACE
    keys |= np.arange(len(keys), dtype=np.uint64)
    width = least - GRAM + 1  # grams in a window
    span, low = 1, keys
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    starts = np.concatenate([[0], ends[:-1]])
    change = np.zeros(n + 1, np.int32)  # windows that lie within one text
    inside = ends - starts >= least
    np.add.at(change, starts[inside], 1)
    np.add.at(change, ends[inside] - least + 1, -1)
    window = np.flatnonzero(np.cumsum(change[:n]))
    place = (low[window] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else none
    last = np.concatenate([new[1:], [len(place)]]) - 1 if len(place) else none
    return hashes[place[new]], place[new], window[new], window[last]


def _buffers(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, ends, row of each text, base, texts) in pieces of at most BUFFER bytes. A longer text is cut into
    pieces that overlap by a window less a byte, so that each window is in one of them."""
    row = 0
    rows = len(offsets) - 1
    while row < rows:
        begin = int(offsets[row])
        if offsets[row + 1] - begin > BUFFER:
            at, end = begin, int(offsets[row + 1])
            while at < end:
                stop = min(end, at + BUFFER)
                yield data[at:stop], np.array([stop - at]), np.array([row]), np.array([at - begin])
                if stop == end:
                    break
                at = stop - least + 1
            row += 1
            continue
        stop = int(np.searchsorted(offsets, begin + BUFFER, side="right")) - 1
        stop = max(stop, row + 1)
        yield data[begin : int(offsets[stop])], offsets[row + 1 : stop + 1] - begin, np.arange(row, stop), np.zeros(stop - row, np.int64)
        row = stop


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, ends


# --- front-coded runs ------------------------------------------------------------------------------------

def _shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are known."""
    a, b = a[known:], b[known:]
    m = min(len(a), len(b))
    differ = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return known + m - (differ.bit_length() + 7) // 8


_ENTRY = np.dtype([("shared", "<u2"), ("right", "<u2"), ("left", "<u2"), ("left_shared", "<u2"), ("left_order", "<u4"), ("many", "?"), ("doc", "<i8"), ("key", "<i8"), ("place", "<i8")])


def build_run(contexts: list[tuple[bytes, bytes, int, int, int]], spans: dict[tuple[int, int], list[int]] | None = None) -> bytes:
    """A sorted, front-coded run of contexts (suffix, left context backwards, doc, key, place). Equal contexts go into it
    once; the bytes of those left out are put among the spans (start, end, ...) of their doc and key."""
    import zstandard

    contexts.sort(key=itemgetter(0, 1))
    kept, rights, before, left_before = [], [], b"", None
    groups = [0]
    for right, left, doc, key, place in contexts:
        shared = _shared(before, right)
        if shared == len(right) == len(before) and left == left_before:
            kept[-1][3] = True
            if spans is not None:
                spans.setdefault((doc, key), []).extend((place - len(left), place + len(right)))
            continue
        if kept and shared < GRAM:
            groups.append(len(kept))
        kept.append([shared, len(right), left, False, doc, key, place])
        rights.append(right[shared:])
        before, left_before = right, left
    table = np.zeros(len(kept), _ENTRY)
    lefts = []
    for a, b in zip(groups, [*groups[1:], len(kept)], strict=True):
        before = b""
        for at, i in enumerate(sorted(range(a, b), key=lambda i: kept[i][2]), a):
            left = kept[i][2]
            shared = _shared(before, left)
            table["left_order"][at], table["left_shared"][at] = i, shared
            lefts.append(left[shared:])
            before = left
    if kept:
        columns = list(zip(*kept, strict=True))
        for name, column in zip(("shared", "right", "left", "many", "doc", "key", "place"), columns, strict=True):
            table[name] = [len(x) for x in column] if name == "left" else column
    body = table.tobytes() + b"".join(rights) + b"".join(lefts)
    return struct.pack("<I", len(kept)) + zstandard.ZstdCompressor(level=1).compress(body)


class Cursor:
    """A front-coded sequence, decoded item by item."""

    def __init__(self, body: bytes, shared: list[int], length: list[int], at: int, first: int, end: int) -> None:
        self.body, self.shared, self.length, self.at = body, shared, length, at
        self.next, self.end, self.current = first, end, b""

    def advance(self) -> bool:
        if self.next == self.end:
            return False
        i = self.next
        shared = self.shared[i]
        stop = self.at + self.length[i] - shared
        self.current = self.current[:shared] + self.body[self.at : stop]
        self.at, self.next = stop, i + 1
        return True


class Run(Cursor):
    """A run's suffixes; lefts(a, b): the left contexts of its entries a to b, a group, in their order."""

    def __init__(self, blob: bytes) -> None:
        import zstandard

        n = struct.unpack_from("<I", blob)[0]
        body = zstandard.ZstdDecompressor().decompress(blob[4:])
        self.table = np.frombuffer(body, _ENTRY, n)
        super().__init__(body, self.table["shared"].tolist(), self.table["right"].tolist(), n * _ENTRY.itemsize, 0, n)
        self.order, self.left_shared = self.table["left_order"].tolist(), self.table["left_shared"].tolist()
        lengths = self.table["left"][self.table["left_order"]].astype(np.int64)
        self.left_length = lengths.tolist()
        begin = self.at + sum(self.length) - sum(self.shared)
        self.left_at = (begin + np.cumsum(lengths - self.table["left_shared"]) - (lengths - self.table["left_shared"])).tolist()

    def lefts(self, a: int, b: int) -> Cursor:
        return Cursor(self.body, self.left_shared, self.left_length, self.left_at[a], a, b)


def merge(runs: list[Cursor]) -> Iterator[tuple[int, int, int]]:
    """(run, entry, bytes shared with the suffix before) in sorted order, by a loser tree.

    known[r]: how many bytes of run r's suffix are known to agree with the last suffix put out. The longer
    one wins unseen; only equals are compared, from there on, and the loser keeps the length that it
    shares with the winner."""
    k = 1
    while k < len(runs):
        k *= 2
    suffix: list[bytes | None] = [r.current if r.advance() else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = suffix[a], suffix[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i, j = known[a], known[b]
        if i > j:
            return a, b
        if i < j:
            return b, a
        shared = _shared(x, y, i)
        if shared == len(x) or (shared < len(y) and x[shared] < y[shared]):
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        below, winners = winners, []
        for i in range(level):
            won, lost = play(below[2 * i], below[2 * i + 1])
            winners.append(won)
            loser[level + i] = lost
    best = winners[0]
    while suffix[best] is not None:
        run = runs[best]
        yield best, run.next - 1, known[best]
        if run.advance():
            suffix[best], known[best] = run.current, run.shared[run.next - 1]
        else:
            suffix[best] = None
        node = (best + k) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


#: Entries of complete groups whose windows are looked at together.
BATCH = 20_000


def merged_groups(runs: list[Run]) -> Iterator[tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], list[int]]]:
    """For each group of suffixes that begin with the same gram, if it has more than one: (run, entry) and the bytes shared
    with the one before, in the order of the suffixes, and both in the order of the left contexts."""

    def complete(members: list[tuple[int, int]], shared: list[int]):
        if len(members) == 1:
            return members, shared, members, [0]
        span: dict[int, list[int]] = {}
        for r, i in members:
            ends = span.setdefault(r, [i, i])
            ends[1] = i
        cursors = [runs[r].lefts(a, b + 1) for r, (a, b) in span.items()]
        of = list(span)
        if len(of) == 1:
            a, b = span[of[0]]
            return members, shared, [(of[0], i) for i in runs[of[0]].order[a : b + 1]], runs[of[0]].left_shared[a : b + 1]
        lefts = list(merge(cursors))
        return members, shared, [(of[c], runs[of[c]].order[i]) for c, i, _ in lefts], [x for _, _, x in lefts]

    many = [r.table["many"].tolist() for r in runs]
    members: list[tuple[int, int]] = []
    lengths: list[int] = []
    for r, i, length in merge(runs):
        if length < GRAM and members:
            if len(members) > 1 or many[members[0][0]][members[0][1]]:
                yield complete(members, lengths)
            members, lengths = [], []
        members.append((r, i))
        lengths.append(length)
    if len(members) > 1 or (members and many[members[0][0]][members[0][1]]):
        yield complete(members, lengths)


def repeated_windows(blobs: list[bytes], least: int) -> pd.DataFrame:
    """(doc, key, start, end) of the bytes in windows that two entries of the runs share."""
    runs = [Run(b) for b in blobs]
    parts = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc", "key", "start", "end")})]
    entries, right, by_left, left = [], [], [], []

    def look() -> None:
        table = np.empty(len(entries), _ENTRY)
        source, number = np.array(entries, np.int64).reshape(-1, 2).T
        for r in np.unique(source):
            mine = source == r
            table[mine] = runs[r].table[number[mine]]
        parts.append(_windows(table, np.array(right, np.int64), np.array(by_left, np.int64), np.array(left, np.int64), least))
        for x in (entries, right, by_left, left):
            x.clear()

    for members, shared, ordered, left_shared in merged_groups(runs):
        place = {m: len(entries) + k for k, m in enumerate(members)}
        entries += members
        right += shared
        by_left += [place[m] for m in ordered]
        left += left_shared
        if len(entries) >= BATCH:
            look()
    if entries:
        look()
    return pd.concat(parts, ignore_index=True)


def _windows(table: np.ndarray, right: np.ndarray, by_left: np.ndarray, left: np.ndarray, least: int) -> pd.DataFrame:
    """repeated_windows() of whole groups: right and left are the bytes shared with the entry before, in the order of the table and
    in that of by_left; both are shorter than a gram, or 0, where a group begins."""
    n = len(table)
    first, last = least - table["right"].astype(np.int64), table["left"].astype(np.int64)  # offsets of the anchor in its windows
    many = table["many"]
    before, low, found = np.zeros(n, bool), np.zeros(n, np.int64), []

    def close(rows: np.ndarray, high: int) -> None:
        if len(rows):
            place = table["place"][rows]
            found.append((table["doc"][rows], table["key"][rows], place - high, place - low[rows] + least))

    for offset in range(least - GRAM + 1):
        now = np.zeros(n, bool)
        on = np.flatnonzero((first <= offset) & (offset <= last))
        if len(on):
            group = np.cumsum(right < least - offset) * (n + 1)
            if offset:
                group[by_left] += np.cumsum(left < offset)
            group = pd.factorize(group[on])[0]
            times = np.bincount(group) + np.bincount(group, many[on]).astype(np.int64)
            now[on] = times[group] > 1
        close(np.flatnonzero(before & ~now), offset - 1)
        low[now & ~before] = offset
        before = now
    close(np.flatnonzero(before), least - GRAM)
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("doc", "key", "start", "end"), columns, strict=True)))


# --- the job ---------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = F.col(id_col)
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    return docs.select(F.coalesce(given.cast("long"), F.lit(0)).alias("doc") if whole else F.xxhash64(given).alias("doc"), F.xxhash64(text, given.isNull()).alias("key"), text.cast("binary").alias("data"), given.alias("id"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs with each text compressed: what a shuffle of the texts then writes is less than two thirds."""
    at = docs.columns.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = pa.array([compress(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, "data", small)

    return docs.mapInArrow(run, docs.schema)


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def _anchor_hashes(docs: DataFrame, least: int, shared: Broadcast) -> DataFrame:
    """For each text a mark (hash of doc and key; texts that share one only get marks too many), the hashes of its
    anchors' grams without the common ones, and how many common ones it has."""
    schema = pa.schema([("mark", pa.int64()), ("hashes", pa.list_(pa.int64())), ("common", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            data, offsets = _flat(batch.column(2))
            for piece, ends, rows, _ in _buffers(data, offsets, least):
                hashes, place, _, _ = anchors(piece, ends, least, common)
                text = np.searchsorted(ends, place, side="right")
                often = _marked(hashes, common) if len(common) else np.zeros(len(hashes), bool)
                has_common = np.bincount(text[often], minlength=len(ends))
                counts = np.bincount(text[~often], minlength=len(ends))
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                some = np.flatnonzero(counts + has_common)
                values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[~often].view(np.int64)))
                yield pa.record_batch([batch.column(0).take(pa.array(rows[some])), values.take(pa.array(some)), pa.array(has_common[some])], schema=schema)

    texts = docs.filter(F.length("data") >= least).select(_mark(), F.col("key"), F.col("data"))
    return texts.mapInArrow(run, "mark long, hashes array<long>, common long")


def _mark() -> Column:
    return F.xxhash64("doc", "key").alias("mark")


def _near_common(docs: DataFrame, least: int, shared: Broadcast, most_held: int = 1_000_000) -> DataFrame:
    """hash, n of grams within a window of a common anchor: the rest of a passage is as common as its anchors. A task
    adds its grams up before it gives them on, and leaves out those it met once: they could only lengthen the list of
    common grams, which decides nothing but where work goes."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        found, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        return [(found, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]

    def given(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for found, times in added(parts) if parts else []:
            again = times > 1
            yield pa.record_batch([pa.array(found[again].view(np.int64)), pa.array(times[again])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        common = shared.value
        for batch in batches:
            data, offsets = _flat(batch.column(0))
            for piece, ends, _, _ in _buffers(data, offsets, least):
                if len(piece) < least:
                    continue
                hashes = gram_hashes(piece)
                found, place, _, _ = anchors(piece, ends, least, np.empty(0, np.uint64), hashes)
                place = place[_marked(found, common)]
                if not len(place):
                    continue
                text = np.searchsorted(ends, place, side="right")
                begin = np.concatenate([[0], ends[:-1]])[text]
                step = np.zeros(len(piece) + 2, np.int32)
                np.add.at(step, np.maximum(place - least + GRAM, begin), 1)
                np.add.at(step, np.minimum(place + least, ends[text]) - GRAM + 1, -1)
                near = np.flatnonzero(np.cumsum(step)[: len(hashes)] > 0)
                parts.append(np.unique(hashes[near], return_counts=True))
                if sum(len(h) for h, _ in parts) > most_held:
                    parts = added(parts)
                    if len(parts[0][0]) > most_held // 2:
                        yield from given(parts)
                        parts = []
        yield from given(parts)

    texts = docs.filter(F.length("data") >= least).select("data")
    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _counted(table: DataFrame) -> DataFrame:
    return table.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


def _sorted_runs(docs: DataFrame, marks: DataFrame, least: int, shared: Broadcast, owners: int, run_entries: int) -> DataFrame:
    """Sorted, front-coded runs for each owner; and, for contexts that a run has already, their bytes as spans."""
    schema = pa.schema([("owner", pa.int32()), ("run", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def flush(contexts: dict, spans: dict) -> Iterator[pa.RecordBatch]:
        rows = [(owner, build_run(mine, spans), 0, 0, None) for owner, mine in contexts.items()]
        rows += [(doc % owners, None, doc, key, pairs) for (doc, key), pairs in spans.items()]
        contexts.clear()
        spans.clear()
        for i in range(0, len(rows), 1000):
            columns = list(zip(*rows[i : i + 1000], strict=True))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[int, list] = {}
        spans: dict[tuple[int, int], list[int]] = {}
        held, common = 0, shared.value
        for batch in batches:
            ids, keys, marked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            texts = _unpacked(batch.column(2))
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            wanted_ends = marked.offsets.to_numpy()
            wanted = marked.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for piece, ends, rows, shift in _buffers(data, offsets, least):
                hashes, place, first, last = anchors(piece, ends, least, common)
                text = np.searchsorted(ends, place, side="right")
                mine = np.unique(wanted[wanted_ends[rows[0]] : wanted_ends[rows[-1] + 1]])
                use = _held(hashes, mine) | _held(hashes, common)
                raw = piece.tobytes()
                begins = np.concatenate([[0], ends[:-1]])
                owner = (hashes % np.uint64(owners)).astype(np.int64)
                for i in np.flatnonzero(use):
                    p, a, b = int(place[i]), int(first[i]), int(last[i]) + least
                    t = int(text[i])
                    moved = int(shift[t]) - int(begins[t])
                    row = rows[t]
                    contexts.setdefault(int(owner[i]), []).append((raw[p:b], raw[a:p][::-1], ids[row], keys[row], p + moved))
                    held += 1
                if held >= run_entries:
                    yield from flush(contexts, spans)
                    held = 0
        yield from flush(contexts, spans)

    texts = _packed(docs.filter(F.length("data") >= least).select("doc", "key", "data"))
    joined = texts.join(marks, F.xxhash64("doc", "key") == marks["mark"]).select("doc", "key", "data", "hashes")
    return joined.mapInArrow(run, "owner int, run binary, doc long, key long, spans array<long>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, very_common: int = 1000, most_common: int = 1_000_000, run_entries: int = 200_000, owner_bytes: int = 2_000_000) -> DataFrame:
    """doc, key (hash of the text), start, end: byte ranges whose union is what repeats. owner_bytes: about as much an
    owner's runs may weigh.

    A gram is very common if it occurs more than very_common times and more often than one most_common-th of all
    that are counted, so at most about most_common of them (8 bytes each) are sent to the tasks."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    send = docs.sparkSession.sparkContext.broadcast  # of bounded size: see most_common
    shared = send(np.empty(0, np.uint64))
    table = written(_anchor_hashes(keyed, least, shared), "suffix-anchors")
    total = table.agg(F.sum(F.size("hashes"))).first()[0] or 0

    def often(counts: DataFrame, of: int) -> np.ndarray:
        rows = counts.filter(F.col("n") > max(very_common, of // most_common)).select("hash").collect()
        return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))

    common = often(_counted(table), total)
    if len(common):
        discard(table)
        # a text has about this many grams for each anchor
        shared = send(np.union1d(common, often(_near_common(keyed, least, send(common)), total * (least - GRAM))))
        table = written(_anchor_hashes(keyed, least, shared), "suffix-anchors-anew")
    twice = written(_counted(table).filter("n > 1").select(F.col("hash").alias("twin"), "n"), "suffix-twins")
    entries = (twice.agg(F.sum("n")).first()[0] or 0) + (table.agg(F.sum("common")).first()[0] or 0)
    exploded = table.select("mark", F.explode("hashes").alias("hash"))
    twins = exploded.join(twice, exploded["hash"] == twice["twin"]).select("mark", "hash")
    # common grams are known to every task; a text that has some is looked at, whatever else it has
    also = table.filter("common > 0").select("mark", F.lit(None).cast("long").alias("hash"))
    marks = twins.unionByName(also).groupBy("mark").agg(F.collect_set("hash").alias("hashes"))
    width = shuffle_width(docs.sparkSession)
    owners = max(width, entries * _ENTRY_BYTES // owner_bytes)
    runs = _sorted_runs(keyed, marks, least, shared, owners, run_entries)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(b) for b in group["run"] if b is not None], least)
        passed = group[group["run"].isna()]
        parts = [found]
        for doc, key, pairs in zip(passed["doc"], passed["key"], passed["spans"], strict=True):
            pairs = np.asarray(pairs, np.int64).reshape(-1, 2)
            parts.append(pd.DataFrame({"doc": doc, "key": key, "start": pairs[:, 0], "end": pairs[:, 1]}))
        return pd.concat(parts, ignore_index=True).astype({"key": "int64", "start": "int64", "end": "int64"})

    # a task has a few owners, one after the other; a given number of tasks is not made smaller for small data
    dealt = runs.repartition(max(width, min(owners, 10_000)), "owner")
    return dealt.groupBy("owner").applyInPandas(settle, "doc long, key long, start long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, with_kept: bool = False, **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs; with_kept: also removed (the
    spans) and kept (the bytes left)."""
    bounded_batches(docs.sparkSession)
    spans = repeated_spans(docs, id_col, text_col, least, **options)
    by_doc = spans.groupBy(F.col("doc").alias("s_doc"), F.col("key").alias("s_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    by_doc = by_doc.select("s_doc", "s_key", F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))).alias("bounds"))
    keyed = _packed(_keyed(docs, id_col, text_col))
    joined = keyed.join(by_doc, (keyed["doc"] == by_doc["s_doc"]) & (keyed["key"] == by_doc["s_key"]), "left").select("id", "data", "bounds")
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_kept:
        fields += [("removed", pa.list_(pa.int64())), ("kept", pa.binary())]
        ddl += ", removed array<long>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, bounds in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged: list[int] = []
                for a, b in zip((bounds or [])[::2], (bounds or [])[1::2], strict=True):
                    if merged and a <= merged[-1]:
                        merged[-1] = max(merged[-1], b)
                    else:
                        merged += [a, b]
                cuts = [0, *merged, len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if merged else data
                row = [len(data), len(data) - len(kept), len(merged) // 2, hashlib.sha256(kept).hexdigest()]
                rows.append(row + [merged, kept] if with_kept else row)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.record_batch([batch.column(0), *made], names=["id", *[name for name, _ in fields]])

    return joined.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
