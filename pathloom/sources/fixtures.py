"""Views of the test tables in the shapes that the operators work on, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction traces: a user is a program, a day a function, an event an instruction."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = e.select(F.col("user_id").alias("program"), day.alias("function"), "ts", "event_id", F.col("event_type").alias("mnemonic"))
    w = Window.partitionBy("program", "function").orderBy("ts", "event_id")
    return rows.select("program", "function", (F.row_number().over(w) - 1).alias("idx"), "mnemonic")


TRACES = """
t AS (
  SELECT user_id AS program, strftime(ts, '%Y-%m-%d') AS function,
         (row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1)::INT AS idx, event_type AS mnemonic
  FROM events
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binaries of traces() with a label: whether the user's number is divisible by 3."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("program")).distinct()
    return users.withColumn("label", (F.col("program") % 3 == 0).cast("int"))


SAMPLES = """
s AS (
  SELECT DISTINCT user_id AS program, (user_id % 3 = 0)::INT AS label FROM events
), split AS (
  SELECT program, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(program::VARCHAR), program) <= ceil(count(*) OVER (PARTITION BY label) * 2 / 10.0)
                             THEN 'test' ELSE 'train' END AS split FROM s
)"""


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token instructions of labelled documents: a line is a function, a token an instruction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    lines = docs.select(F.col("doc_id").alias("program"), F.col("toxic").alias("label"), F.posexplode(F.split("text", "\n")).alias("function", "line"))
    return lines.select("program", "label", "function", F.array_remove(F.split(F.lower("line"), " "), "").alias("mnemonics"))


TOKEN_LINES = """
l AS (
  SELECT d.doc_id AS program, y.toxic AS label, string_split(d.text, chr(10)) AS lines FROM documents d JOIN labels y USING (doc_id)
), tl AS (
  SELECT program, label, i - 1 AS function, list_filter(string_split(lower(lines[i]), ' '), lambda x: x <> '') AS mnemonics
  FROM (SELECT program, label, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("function"), F.col("turn").cast("int").alias("block"), "role", F.length("text").alias("chars"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic blocks: a conversation is a function, a turn a block of one instruction."""
    return _turns(spark, sf_dir).select("function", "block", F.col("block").alias("idx"), F.concat(F.lit("0X"), F.hex(F.col("block").cast("long"))).alias("address"), F.col("role").alias("mnemonic"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry addresses: that of turn 0, in the other case; every seventh function names an unknown one."""
    f = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("function")).distinct()
    return f.withColumn("entry", F.when(F.col("function") % 7 == 6, "0xffff").otherwise("0x0"))


def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the next turn, past it after even texts, and back after every third; pos orders them."""
    t = _turns(spark, sf_dir)
    ways = F.array(
        F.struct(F.lit(0).alias("k"), (F.col("block") + 1).alias("dst"), F.lit(True).alias("on")),
        F.struct(F.lit(1).alias("k"), (F.col("block") + 2).alias("dst"), (F.col("chars") % 2 == 0).alias("on")),
        F.struct(F.lit(2).alias("k"), (F.col("block") - 1).alias("dst"), ((F.col("block") % 3 == 0) & (F.col("block") > 0)).alias("on")),
    )
    e = t.select("function", F.col("block").alias("src"), F.explode(ways).alias("w")).filter("w.on")
    e = e.select("function", (F.col("src") * 3 + F.col("w.k")).alias("pos"), "src", F.col("w.dst").alias("dst"))
    return e.join(t.select("function", F.col("block").alias("dst")), ["function", "dst"], "left_semi").select("function", "pos", "src", "dst")


CFG = """
turns AS (
  SELECT conv_id AS function, turn::INT AS block, role, length(text) AS chars FROM conversations
), cb AS (
  SELECT function, block, block AS idx, '0X' || upper(to_hex(block)) AS address, role AS mnemonic FROM turns
), ce AS (
  SELECT e.function, (e.src * 3 + e.k)::INT AS pos, e.src, e.dst FROM (
    SELECT function, block AS src, 0 AS k, block + 1 AS dst FROM turns
    UNION ALL SELECT function, block, 1, block + 2 FROM turns WHERE chars % 2 = 0
    UNION ALL SELECT function, block, 2, block - 1 FROM turns WHERE block % 3 = 0 AND block > 0
  ) e WHERE EXISTS (SELECT 1 FROM turns t WHERE t.function = e.function AND t.block = e.dst)
), en AS (
  SELECT DISTINCT conv_id AS function, CASE WHEN conv_id % 7 = 6 THEN '0xffff' ELSE '0x0' END AS entry FROM conversations
), eb AS (
  SELECT cb.function, min(cb.block) AS entry_block FROM cb JOIN en ON en.function = cb.function AND lower(cb.address) = lower(en.entry) GROUP BY cb.function
), walk(function, block, path) AS (
  SELECT function, entry_block, [entry_block] FROM eb
  UNION ALL
  SELECT w.function, ce.dst, list_append(w.path, ce.dst) FROM walk w JOIN ce ON ce.function = w.function AND ce.src = w.block
  WHERE NOT list_contains(w.path, ce.dst)
), cp AS (
  SELECT function, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.function = w.function AND ce.src = w.block)
)"""


def dfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data flow between turns of one role: to the next, and to the one after after every third length."""
    t = _turns(spark, sf_dir)
    w = Window.partitionBy("function", "role").orderBy("block")
    t = t.withColumn("one", F.lead("block", 1).over(w)).withColumn("two", F.when(F.col("chars") % 3 == 0, F.lead("block", 2).over(w)))
    e = t.select("function", F.col("role").alias("var"), F.col("block").alias("src"), F.posexplode(F.array("one", "two")).alias("k", "dst")).filter("dst IS NOT NULL")
    return e.select(
        "function", "var", (F.col("src") * 2 + F.col("k")).alias("pos"), "src", "dst",
        F.when(F.col("src") % 2 == 0, "comesFrom").otherwise("computedFrom").alias("kind"), (F.col("src") % 5 == 4).alias("loop_carried"),
    )


DFG = """
dt AS (
  SELECT conv_id AS function, role AS var, turn::INT AS src, lead(turn::INT, 1) OVER w AS one,
         CASE WHEN length(text) % 3 = 0 THEN lead(turn::INT, 2) OVER w END AS two
  FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)
), da AS (
  SELECT function, var, (src * 2 + k)::INT AS pos, src, dst, CASE WHEN src % 2 = 0 THEN 'comesFrom' ELSE 'computedFrom' END AS kind, src % 5 = 4 AS loop_carried
  FROM (SELECT function, var, src, 0 AS k, one AS dst FROM dt UNION ALL SELECT function, var, src, 1, two FROM dt) WHERE dst IS NOT NULL
), de AS (
  SELECT * FROM da WHERE NOT loop_carried
), dg AS (
  SELECT function, var, node, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree
  FROM (SELECT function, var, src AS node, 0 AS i, 1 AS o FROM de UNION ALL SELECT function, var, dst, 1, 0 FROM de) GROUP BY ALL
), seg(function, var, start_pos, node, path) AS (
  SELECT de.function, de.var, de.pos, de.dst, [de.src, de.dst] FROM de JOIN dg ON dg.function = de.function AND dg.var = de.var AND dg.node = de.src
  WHERE dg.indegree <> 1 OR dg.outdegree > 1
  UNION ALL
  SELECT s.function, s.var, s.start_pos, de.dst, list_append(s.path, de.dst)
  FROM seg s JOIN dg ON dg.function = s.function AND dg.var = s.var AND dg.node = s.node AND dg.indegree = 1 AND dg.outdegree = 1
  JOIN de ON de.function = s.function AND de.var = s.var AND de.src = s.node
), sg AS (
  SELECT s.function, s.var, s.path AS segment FROM seg s JOIN dg ON dg.function = s.function AND dg.var = s.var AND dg.node = s.node
  WHERE dg.indegree <> 1 OR dg.outdegree <> 1
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with scores that tie."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y_true"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"))


SCORED = """
sc AS (
  SELECT doc_id, toxic AS y_true, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM labels
), pos AS (
  SELECT score, sum(y_true)::BIGINT AS p, sum(1 - y_true)::BIGINT AS n FROM sc GROUP BY score
), cum AS (
  SELECT score, p, n, sum(p) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS fp,
         (SELECT sum(p) FROM pos)::BIGINT AS positives, (SELECT sum(n) FROM pos)::BIGINT AS negatives FROM pos
), pr AS (
  SELECT score AS threshold, tp, fp, p, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / positives AS recall FROM cum
), f AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr
)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("y_pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))


PREDICTED = SCORED + """, pd AS (
  SELECT doc_id, y_true, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM sc
), cm AS (
  SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM pd
)"""


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions: a vector's positions as features."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature_id", "value"))
    return rows.select("vec_id", "feature_id", F.concat(F.lit("f"), F.col("feature_id").cast("string")).alias("ngram"), F.col("value").cast("double").alias("value"))


CONTRIBUTIONS = """
cn AS (
  SELECT vec_id, (i - 1)::INT AS feature_id, 'f' || (i - 1)::VARCHAR AS ngram, embedding[i]::DOUBLE AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
), tk AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, feature_id) AS rank FROM cn) WHERE rank <= 20
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge results: scores 1 to 5, status and flags by arithmetic on the id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("sample_"), d.cast("string")).alias("sample_id"), d.alias("n"),
        F.when(d % 11 == 0, "judge_error").when(d % 13 == 0, "generation_error").otherwise("success").alias("status"),
        (d % 3 != 0).alias("has_unsupported_claims"), (d % 4 != 0).alias("faithful"),
        (d % 5 + 1).cast("int").alias("technical_accuracy"), (d % 4 + 2).cast("int").alias("coherence"),
        (d % 3 + 3).cast("int").alias("cybersecurity_relevance"), (d * 7 % 5 + 1).cast("int").alias("actionable_utility"),
    )


JUDGED = """
j AS (
  SELECT 'sample_' || doc_id::VARCHAR AS sample_id, doc_id AS n,
         CASE WHEN doc_id % 11 = 0 THEN 'judge_error' WHEN doc_id % 13 = 0 THEN 'generation_error' ELSE 'success' END AS status,
         doc_id % 3 <> 0 AS has_unsupported_claims, doc_id % 4 <> 0 AS faithful,
         (doc_id % 5 + 1)::INT AS technical_accuracy, (doc_id % 4 + 2)::INT AS coherence,
         (doc_id % 3 + 3)::INT AS cybersecurity_relevance, (doc_id * 7 % 5 + 1)::INT AS actionable_utility
  FROM labels
)"""
