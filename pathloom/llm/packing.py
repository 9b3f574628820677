"""Best-fit packing of token pieces into fixed-length sequences, certified by lower bounds.

1. Documents become pieces of at most ``capacity`` tokens (Arrow batches, one pass over the text).
2. Pieces are dealt by hash over partitions whose size is bounded; each is packed best-fit decreasing.
3. Dual feasible functions give a lower bound of every partition's bin count. A partition that
   meets its bound is certified: no packing of its pieces needs fewer bins.
4. Partitions with a gap give the pieces of their unfilled bins to a pool (certified ones give their
   emptiest bin), the pool is dealt over fewer partitions under another seed and packed again. A round
   counts only if it needs fewer bins than those pieces held before.

Nulls and edge cases: a null text is an empty one (one piece with the end token alone); a null id is
kept as it is; repeated rows are separate documents; an empty table gives an empty result; columns
other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, shuffle_width

#: Characters whose Unicode class the two tokenizer libraries certainly agree on; a text with others
#: takes the slower library, whose ids are the ones asked for.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ſ‐-‧‰-⁞€]*")
_SPECIAL = "<|endoftext|>"
_ENCODERS: dict[tuple[str, str], tuple] = {}


def _encoders(json_path: str, ranks_path: str, pattern: str) -> tuple:
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[key] = (Tokenizer.from_file(json_path), fast)
    return _ENCODERS[key]


def encode_bytes(text: str, json_path: str, ranks_path: str, pattern: str) -> bytes:
    """The ids of text as little-endian unsigned 32-bit numbers."""
    slow, fast = _encoders(json_path, ranks_path, pattern)
    if _SPECIAL not in text and _PLAIN.fullmatch(text):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    bounds = [0, *range(first or capacity, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenize(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int64()))], schema + ", ids array<long>"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            of: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode_bytes(text or "", json_path, ranks_path, pattern) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [piece, start, length, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, "<u4").astype("i8"))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    of.append(i)
            made = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *made], names=["doc_id", *[n for n, _ in fields]])

    return rows.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Open bins stand in stacks by free space, and a bit set names the
    stacks that hold one, so that the tightest bin is one shift and one lowest-bit away."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, count = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                open_mask ^= 1 << free
        else:
            b, free, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - free
        rest = free - size
        if rest:
            stacks[rest].append(b)
            open_mask |= 1 << rest
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions: the plain sum, the threshold
    functions (items over capacity - a count as whole bins, items under a as nothing) and the
    rounding functions x -> floor((k + 1) x) / k."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """lower_bound() from the number of items of each size 0..capacity."""
    size = np.arange(capacity + 1, dtype=np.int64)
    total = count * size
    best = -(-int(total.sum()) // capacity)
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # items of at least this size
    mass = np.concatenate([[0], np.cumsum(total)])  # mass of items below this size
    for a in range(1, capacity // 2 + 1):
        whole = int(above[capacity - a + 1])
        middle = int(mass[capacity - a + 1] - mass[a])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity); exact multiples keep their size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


_PACKED = T.StructType(
    [
        T.StructField("bin", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("free", T.LongType()),
        T.StructField("bins", T.LongType()),
        T.StructField("bound", T.LongType()),
        T.StructField("emptiest", T.BooleanType()),
    ]
)


def _pack_partitions(pool: DataFrame, capacity: int, seed: int, parts: int) -> DataFrame:
    dealt = pool.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(parts)))
    keep = dealt.columns

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("deal", kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths, minlength=1).astype(np.int64)
        return group.assign(
            bin=bins, offset=offsets, free=capacity - fill[bins], bins=len(fill),
            bound=lower_bound(lengths, capacity), emptiest=bins == int(fill.argmin()),
        )[[*keep, *_PACKED.names]]

    return dealt.groupBy("part").applyInPandas(pack, T.StructType([*dealt.schema, *_PACKED]))


def pack(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = 50_000, rounds: int = 4) -> DataFrame:
    """pieces with sequence_id and offset. partition_pieces bounds what one task packs; a partition's
    memory does not depend on the input. Rounds end once one gains nothing or the pool fits one partition."""
    spark = pieces.sparkSession
    payload = [c for c in pieces.columns if c not in ("deal", "part", "sequence_id", *_PACKED.names)]
    # pieces are dealt by a number of their own, which stays: rows that share an id, or have none, are spread like others
    pool = checkpointed(pieces.select(*payload).withColumn("deal", F.monotonically_increasing_id()))
    n = pool.count()
    parts = max(1, min(shuffle_width(spark), -(-n // 1000)), math.ceil(n / partition_pieces))
    done: list[DataFrame] = []
    held = None  # the pool as it was packed before, in case a round gains nothing
    for turn in range(rounds + 1):
        packed = checkpointed(_pack_partitions(pool, capacity, turn, parts))
        by_part = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        bins, gap = by_part.agg(F.sum("bins"), F.sum(F.col("bins") - F.col("bound"))).first()
        if held is not None and (bins or 0) >= held[1]:
            done.append(held[0])
            break
        sequence = F.shiftleft(F.lit(turn).cast("long"), 56).bitwiseOR(F.shiftleft(F.col("part"), 28)).bitwiseOR(F.col("bin"))
        packed = packed.withColumn("sequence_id", sequence)
        gives = (F.col("free") > 0) & ((F.col("bins") > F.col("bound")) | F.col("emptiest"))
        if turn == rounds or parts == 1 or not bins:
            done.append(packed)
            break
        done.append(packed.filter(~gives))
        given = packed.filter(gives)
        before, pieces_left = given.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        if not pieces_left:
            break
        held = (given, before)
        pool = given.select(*payload, "deal")
        parts = max(1, min(parts // 8, -(-pieces_left // 1000)), math.ceil(pieces_left / partition_pieces))
    out = done[0].select(*payload, "sequence_id", "offset")
    for more in done[1:]:
        out = out.unionByName(more.select(*payload, "sequence_id", "offset"))
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences used, and the dual-feasible bound of all pieces together. The histogram of
    lengths has at most capacity rows, whatever the input."""
    used = packed.agg(F.count_distinct("sequence_id").alias("sequences"))
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[r["length"]] = r["n"]
    return used.withColumn("bound", F.lit(bound_of_counts(count, capacity)).cast("long"))


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id with its token ids in place, from pieces that carry ids. A sequence has at most
    capacity pieces, so a group is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
