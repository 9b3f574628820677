"""Language identification by known words first, shorter and shorter character n-grams after.

A model holds the log frequencies, per language, of words and of character n-grams (of words with marked
ends, orders 1 to ``orders``). A known word scores by its own frequencies. An unseen word
backs off: it scores by the mean over its n-grams of the longest order of which any is known, less a
penalty for every order it fell. Scores add up over a text; the result is the best language and its
posterior share under a uniform prior, tempered by ``temper`` since words of a text are not independent.

Fitting takes a bounded sample: of each language about ``per_language`` documents (all if there are fewer),
chosen by a seeded hash of the id. Of the words and n-grams of each language ``most_words`` and ``most_grams`` are kept at most, the most
frequent first, so that no language takes another's place and the model's size has a bound that the input does not move. Prediction runs over every whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label are not
learned from; without any labelled row everything is ``und``; equal scores go to the language first in code
point order; null ids and repeated rows each give their row; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_MEMO = 200_000


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # word -> row of table
    grams: dict[str, int]  # marked n-gram -> row of table
    table: np.ndarray  # log frequencies, a column a language
    orders: int
    fall: float = 1.0

    def __post_init__(self) -> None:
        self._memo: dict[str, tuple[int, ...]] = {}

    def backoff(self, word: str) -> tuple[int, ...]:
        """Rows of the longest known n-grams of an unseen word."""
        rows = self._memo.get(word)
        if rows is None:
            marked, rows = f"<{word}>", ()
            for n in range(min(self.orders, len(marked)), 0, -1):
                rows = tuple(r for i in range(len(marked) - n + 1) if (r := self.grams.get(marked[i : i + n])) is not None)
                if rows:
                    break
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            self._memo[word] = rows
        return rows

    def scores(self, text: str | None) -> np.ndarray | None:
        """Log scores by language; None if the text has no letter."""
        words = Counter(_LETTERS.findall(text.lower())) if text else ()
        if not any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words) or not self.languages:
            return None
        rows, weights = [], []
        for word, n in words.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
                continue
            back = self.backoff(word)
            if back:
                rows += back
                weights += [n / len(back)] * len(back)
        if not rows:
            return np.zeros(len(self.languages))
        return np.asarray(weights) @ self.table[rows]

    def knows(self, text: str | None) -> bool:
        """Whether any word of the text is known, or any n-gram of it besides the marks of words' ends."""
        marks = {self.grams.get("<"), self.grams.get(">")}
        words = (m.group() for m in _LETTERS.finditer(text.lower())) if text else ()
        return any(w in self.words or not marks.issuperset(self.backoff(w)) for w in words)

    def predict(self, text: str | None, temper: float) -> tuple[str, float]:
        scores = self.scores(text)
        if scores is None:
            return UNDETERMINED, 0.0
        share = np.exp((scores - scores.max()) * temper)
        best = int(share.argmax())  # the first of equals
        return self.languages[best], float(share[best] / share.sum())


def _log_frequencies(counts: dict[tuple[str, str], int], languages: list[str], alpha: float) -> tuple[dict[str, int], np.ndarray]:
    keys: dict[str, int] = {}
    for _, key in sorted(counts):
        keys.setdefault(key, len(keys))
    table = np.full((len(keys), len(languages)), alpha)
    column = {x: i for i, x in enumerate(languages)}
    for (language, key), n in counts.items():
        table[keys[key], column[language]] += n
    return keys, np.log(table / np.maximum(table.sum(axis=0), alpha))


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 600,
    most_words: int = 30_000,
    most_grams: int = 30_000,
    orders: int = 4,
    seed: int = 42,
) -> Model:
    """A model from the rows of labelled that have a language."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.empty((0, 0)), orders)
    # a language's share of the hash range that holds about per_language of its documents
    limit = F.lit(0)
    for language, n in sizes.items():
        limit = F.when(F.col("lang") == language, min(1 << 30, (per_language << 30) // n)).otherwise(limit)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < limit)
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))
    words = written(
        sample.select("lang", F.explode(letters).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")),
        "langid-words",
    )

    def most(table: DataFrame, key: str, n: int) -> list:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))  # of a sample's words only
        return table.withColumn("rank", rank).filter(F.col("rank") <= n).collect()

    top = most(words, "word", most_words)
    marked = F.concat(F.lit("<"), "word", F.lit(">"))

    def cuts(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substr(marked, i, F.lit(k)))
        return F.when(F.length(marked) >= k, found).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[cuts(k) for k in range(1, orders + 1)])
    counted = words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top_grams = most(counted, "gram", most_grams)
    word_rows, word_table = _log_frequencies({(r["lang"], r["word"]): r["n"] for r in top}, languages, 0.5)
    tables, gram_rows = [word_table], {}
    for k in range(1, orders + 1):
        one = {(r["lang"], r["gram"]): r["n"] for r in top_grams if len(r["gram"]) == k}
        keys, table = _log_frequencies(one, languages, 0.5)
        base = sum(map(len, tables))
        gram_rows |= {g: base + i for g, i in keys.items()}
        tables.append(table)
    return Model(languages, word_rows, gram_rows, np.concatenate(tables).astype(np.float64), orders)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temper: float = 0.1) -> DataFrame:
    """id, lang_pred and score for every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: see fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(text, temper) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.record_batch(columns, names=["id", "lang_pred", "score"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """The fold of documents that nothing may be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def confident(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5, temper: float = 0.1) -> DataFrame:
    """docs whose language is determined with at least least_score; all columns as they were. Where no word
    or n-gram is known, no language is determined. Rows pass through the worker in Arrow batches, so nothing is shuffled and
    rows with one id are judged one by one."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [(*shared.value.predict(text, temper), shared.value.knows(text)) for text in texts]
            yield batch.filter(pa.array([language != UNDETERMINED and score >= least_score and known for language, score, known in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
