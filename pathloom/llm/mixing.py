"""Mixing sources to target weights by capped water-filling.

Targets: every source starts with its weight's share of the words wanted. A source above
``max_epochs`` times its size is clamped there and the excess is shared by weight among the others,
until none is above. That is one water level: target = min(max_epochs * size, weight * level). The loop
works on a table with a row a source, which stays a DataFrame; only sums reach the driver.

Sampling: target / size is a number of whole repetitions, which every document gets, and a fraction.
For the fraction documents stand in the order of a seeded hash and are repeated once more until the
words run out; the document in which they do is repeated in part. A source is cut into hash ranges first:
ranges wholly before or after that point are settled by their sums alone, and only the one range
that holds it is ordered, so no source, however large, comes together in a task.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; words are shared
among sources by size alone, so a source without words gets nothing; rows that repeat an id are ordered
by size (identical rows are alike, either may come first); an empty table gives an empty
result; columns other than id, text and source are ignored (repeated() keeps them; rows that share an id come as
often as the one of them that comes most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import WORD_CLASS, checkpointed, free_names, written

#: Hash ranges that a source is cut into before one of them is ordered.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0))), F.lit(0)).cast("long")


def fill_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target. Weights repeat over the sources' order."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    table = numbered(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    table = checkpointed(table.withColumn("cap", F.col("source_size") * max_epochs))
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    wanted = int(wanted) if float(wanted).is_integer() else wanted
    rest, weight = wanted, None
    clamped = F.lit(False)
    while True:
        used, left, n = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, True)),
        ).first()
        if weight is not None and n == seen:  # noqa: F821
            break
        rest, weight, seen = wanted - used, left, n
        if not weight:
            break
        # above the level: cap * weight_sum <= weight * rest, in whole numbers
        clamped = F.col("cap") * F.lit(weight) <= F.col("weight") * F.lit(rest)
    level = F.col("weight") * F.lit(rest) / F.lit(weight) if weight else F.col("cap")
    target = F.when(clamped | F.lit(not weight), F.col("cap").cast("double")).otherwise(level.cast("double"))
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_documents: bool = False,
) -> DataFrame:
    """id, size, source_size, target, taken (words, repetitions counted), whole and part (of taken:
    whole repetitions, and words of one in part).

    whole_documents: the document in which a source's words run out is repeated wholly if at least half of
    it fits and not at all otherwise, so that no text need be cut."""
    # rows without an id are told apart by their text, so that they do not share one range
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(text_col)).cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    sized = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            key.alias("key"),
            F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("range"),  # RANGES of them
        ),
        "mixing-sizes",
    )
    by_range = checkpointed(sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    by_source = by_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = fill_targets(by_source, weights, share, max_epochs)
    # at most RANGES rows a source here
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        by_range.withColumn("range_before", F.coalesce(F.sum("range_size").over(running), F.lit(0)))
        .join(targets, by_range["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.col("words") - F.col("whole") * F.col("source_size"))
    )
    plan = checkpointed(
        plan.withColumn("left", F.col("extra") - F.col("range_before"))
        .withColumn("settled", F.when(F.col("left") >= F.col("range_size"), F.lit(1)).when(F.col("left") <= 0, F.lit(0)))
        .select(F.col("source").alias("p_source"), F.col("range").alias("p_range"), "source_size", "target", "whole", "left", "settled")
    )
    on = sized["source"].eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range"))
    dealt = sized.join(plan, on).drop("p_source", "p_range")
    settled = dealt.filter("settled IS NOT NULL").withColumn("part", F.when(F.col("settled") == 1, F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.col("size"), F.greatest(room, F.lit(0)))
    if whole_documents:
        part = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(0)
    split = dealt.filter("settled IS NULL").withColumn("part", part)
    out = settled.unionByName(split)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", F.col("part").cast("long").alias("part"),
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, wholly; all columns as they were. Documents
    without words have nothing to mix by: they stay once."""
    mixed = mix(docs, id_col=id_col, whole_documents=True, **options)
    n = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + (F.col("part") > 0).cast("long"))
    of, times, copy = free_names(docs, "mix_id", "mix_times", "mix_copy")
    table = mixed.groupBy(F.col(id_col).alias(of)).agg(F.max(n).cast("int").alias(times))
    joined = docs.join(table, F.col(id_col).eqNullSafe(F.col(of))).filter(F.col(times) > 0)
    again = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return again.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || doc_id::VARCHAR) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST) AS pos FROM r
), c AS (
  SELECT *, (SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
  FROM o
), cut AS (
  SELECT min(pos) AS first_free FROM c WHERE cap * weights > weight * rest
), t AS (
  SELECT c.source, c.source_size,
         CASE WHEN cut.first_free IS NULL OR c.pos < cut.first_free THEN c.cap::DOUBLE
              ELSE (c.weight * f.rest)::DOUBLE / f.weights::DOUBLE END AS target
  FROM c CROSS JOIN cut LEFT JOIN c f ON f.pos = cut.first_free
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t
), x AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole,
         round(w.target)::BIGINT - w.whole * w.source_size
           - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(room, 0)))::BIGINT AS taken FROM x
"""
