"""Quality rules with suffix arrays: how much of a text repeats itself.

Texts become word sequences. All texts of a segment share one suffix array, with words told apart by
document so that no match crosses texts. It is built by prefix doubling that goes on only with suffixes
not yet told apart, and neighbours' common prefixes follow from the ranks of every doubling. The deepest
longest-common-prefix interval over a suffix is the maximal repeated substring that starts there;
the union of those of at least ``least_words`` words is what the text repeats. A text is kept if that
union covers at most ``most_covered`` of its words and its longest repeat has at most ``most_words`` words.

The base counts come from the same arrays: a word is in a 3-word window found twice if a suffix with a
common prefix of 3 or more words starts at most 2 words before it.

Edge cases: a null text has no words; texts without words, null ids and repeated rows each give their row
(no words: base_failed); a text longer than a segment forms its own; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, bounded_batches

_WORD = re.compile(WORD_CLASS)
#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix of each text the words it shares with another suffix of the same text, at most.

    symbols: equal numbers stand for equal words; ends: of the text of each position, exclusive."""
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(ends * (int(symbols.max()) + 1) + symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (ends[order[1:]] != ends[order[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    ranks, step = [rank], 1

    def unresolved(slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return slots[~(starts & np.append(starts[1:], True))]

    slots = unresolved(np.arange(n), new)  # places in the order whose suffixes are not told apart
    paired = slots
    while len(slots):
        at = order[slots]
        far = at + step
        second = np.where(far < ends[at], rank[np.minimum(far, n)], -1)
        key = rank[at] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        starts = np.ones(len(slots), bool)
        starts[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))]
        ranks.append(rank)
        slots, step = unresolved(slots, starts), 2 * step
    # neighbours in the order that share their first word
    right = paired[1:][ranks[0][order[paired[1:]]] == ranks[0][order[paired[:-1]]]] if len(paired) else paired
    a, b = order[right - 1].copy(), order[right].copy()
    common = np.zeros(len(right), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        same = (ranks[level][np.minimum(x, n)] == ranks[level][np.minimum(y, n)]) & (x < n) & (y < n)
        common[same] += 1 << level
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Positions in the union of the repeats of at least so many words; length: only their first words."""
    step = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + (longest[at] if length is None else length), len(longest)), -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[str], least_words: int) -> dict[str, list[int]]:
    words = [_WORD.findall(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    flat = [w for one in words for w in one]
    symbols = pd.factorize(np.array(flat, object))[0].astype(np.int64) if flat else np.empty(0, np.int64)
    longest = longest_repeats(symbols, np.repeat(bounds[1:], counts))

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[bounds[1:]] - total[bounds[:-1]]

    top = np.zeros(len(texts), np.int64)
    some = counts > 0
    if some.any():
        top[some] = np.maximum.reduceat(longest, bounds[:-1][some])
    lines = [[x for x in t.split("\n") if x.strip(_SPACES)] for t in texts]
    return {
        "n_words": counts.tolist(),
        "word_chars": [sum(map(len, w)) for w in words],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": per_text(covered(longest, 3, 3)).tolist(),
        "covered_words": per_text(covered(longest, least_words)).tolist(),
        "longest_repeat": top.tolist(),
    }


def repetition(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 8,
    most_covered: float = 0.2,
    most_words: int = 100,
    segment_chars: int = 2_000_000,
) -> DataFrame:
    """id, the counts of measure(), base_failed and kept."""
    bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= segment_chars):
                    size += len(texts[stop])
                    stop += 1
                found = measure(texts[start:stop], least_words)
                yield pa.record_batch([batch.column(0).slice(start, stop - start), *[pa.array(found[x], pa.int64()) for x in names]], names=["id", *names])
                start = stop

    measured = rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{x} long" for x in names]]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_words)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & passes).withColumnRenamed("id", id_col)
