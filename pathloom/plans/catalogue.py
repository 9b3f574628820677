"""Registered queries over the fixture views, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbering import numbered
from ..functions.storage import written
from ..operators import features as ft
from ..operators import graphs as gr
from ..operators import judging as jd
from ..operators import metrics as mt
from ..operators import ngrams as ng
from ..operators import reports as rp
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _text(c: str = "ngram") -> Column:
    return F.array_join(c, " ").alias(c)


def _r(c: str | Column, digits: int = 9) -> Column:
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


# --- n-grams ---------------------------------------------------------------------------------------------

def _linear_sql(n: int) -> str:
    ahead = ", ".join(["mnemonic", *[f"lead(mnemonic, {k}) OVER w" for k in range(1, n)]])
    return f"""WITH {fx.TRACES}, g AS (
  SELECT program, function, idx AS start, [{ahead}] AS ngram, lead(idx, {n - 1}) OVER w AS last FROM t WINDOW w AS (PARTITION BY program, function ORDER BY idx)
) SELECT program, function, start, array_to_string(ngram, ' ') AS ngram FROM g WHERE last IS NOT NULL"""


def _linear(n: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ng.linear(fx.traces(spark, sf_dir), n, ["program", "function"]).select("program", "function", "start", _text())

    return run


for _n in (2, 3, 4):
    query(_linear_sql(_n), f"ngram_linear_{_n}")(_linear(_n))

_BIGRAMS = f"""{fx.TRACES}, g AS (
  SELECT program, function, idx AS start, [mnemonic, lead(mnemonic) OVER w] AS ngram, lead(idx) OVER w AS last FROM t WINDOW w AS (PARTITION BY program, function ORDER BY idx)
), ng AS (
  SELECT program, function, start, ngram FROM g WHERE last IS NOT NULL
)"""
_VOCAB = f"""{_BIGRAMS}, v AS (
  SELECT ngram, row_number() OVER (ORDER BY ngram) - 1 AS feature_id FROM (SELECT DISTINCT ngram FROM ng)
), fc AS (
  SELECT program, feature_id, count(*) AS n FROM ng JOIN v USING (ngram) GROUP BY program, feature_id
)"""
_TRAIN = f"""{_BIGRAMS}, {fx.SAMPLES}, v AS (
  SELECT ngram, row_number() OVER (ORDER BY ngram) - 1 AS feature_id
  FROM (SELECT DISTINCT ngram FROM ng JOIN split USING (program) WHERE split = 'train' AND ngram[1] <> 'error')
), fc AS (
  SELECT program, feature_id, count(*) AS n FROM ng JOIN v USING (ngram) GROUP BY program, feature_id
), ff AS (
  SELECT program, feature_id, n, n::DOUBLE / sum(n) OVER (PARTITION BY program) AS value FROM fc
), br AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY program) - 1 AS row_index_in_split FROM split
)"""


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.linear(fx.traces(spark, sf_dir), 2, ["program", "function"])


@query(f"""WITH {fx.TOKEN_LINES}, g AS (
  SELECT program, label, function, i - 1 AS start, mnemonics[i:i + 2] AS ngram FROM (SELECT *, unnest(range(1, len(mnemonics) - 1)) AS i FROM tl WHERE len(mnemonics) >= 3)
) SELECT program, label, function::INT AS function, start::INT AS start, array_to_string(ngram, ' ') AS ngram FROM g""")
def ngram_path_shingle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ng.shingle(fx.token_lines(spark, sf_dir), 3).select("program", "label", "function", "start", _text())


@query(f"WITH {_VOCAB} SELECT array_to_string(ngram, ' ') AS ngram, feature_id FROM v")
def vocab_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.lexicographic_vocabulary(_bigrams(spark, sf_dir)).select(_text(), "feature_id")


@query(f"""WITH {_BIGRAMS}, m AS (
  SELECT ngram, min((program, function, start)) AS seen FROM ng GROUP BY ngram
) SELECT array_to_string(ngram, ' ') AS ngram, row_number() OVER (ORDER BY seen, ngram) - 1 AS feature_id FROM m""")
def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.first_seen_vocabulary(_bigrams(spark, sf_dir), ["program", "function", "start"]).select(_text(), "feature_id")


@query(f"WITH {_VOCAB} SELECT program, feature_id, n FROM fc")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ngrams = _bigrams(spark, sf_dir)
    return ft.feature_counts(ngrams, ft.lexicographic_vocabulary(ngrams))


@query(f"WITH {_VOCAB} SELECT program, feature_id, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY program), 9) AS value FROM fc")
def feature_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.frequencies(feature_counts(spark, sf_dir)).withColumn("value", _r("value"))


def _train_only(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split samples, vocabulary of the training split, frequencies of all samples). n-grams that start with an
    error stay out of the vocabulary, so that some are unknown. n-grams are counted once and stored: vocabulary and
    features are both made from the counts."""
    split = ft.stratified_split(fx.samples(spark, sf_dir), "label", "program")
    counts = written(ft.ngram_counts(_bigrams(spark, sf_dir)), "ngram-counts")
    seen = counts.join(split.filter("split = 'train'").select("program"), "program", "left_semi").filter(F.col("ngram")[0] != "error")
    vocabulary = ft.lexicographic_vocabulary(seen)
    return split, vocabulary, ft.frequencies(ft.known_counts(counts, vocabulary))


@query(f"WITH {_TRAIN} SELECT s.program, s.split, ff.feature_id, round(ff.value, 9) AS value FROM split s LEFT JOIN ff USING (program) WHERE s.split = 'test'")
def oov_filter_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, _, freq = _train_only(spark, sf_dir)
    test = split.filter("split = 'test'").select("program", "split")
    return test.join(freq, "program", "left").select("program", "split", "feature_id", _r("value"))


@query(f"""WITH {_TRAIN} SELECT split, (row_index_in_split // 100)::INT AS batch_number, (row_index_in_split % 100)::INT AS row_index_in_batch, feature_id, round(value::FLOAT::DOUBLE, 6) AS value
FROM br JOIN ff USING (program)""")
def coo_matrix_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, _, freq = _train_only(spark, sf_dir)
    cells = ft.coordinates(ft.batch_rows(split, ["program"]), freq)
    return cells.withColumn("value", _r(F.col("value").cast("double"), 6))


_METADATA = """SELECT split, (row_index_in_split // 100)::INT AS batch_number, row_index_in_split::INT AS row_index_in_split, (row_index_in_split % 100)::INT AS row_index_in_batch, label,
CASE WHEN label = 1 THEN 'cryptojacking' ELSE 'benign' END AS class_name, '/data/' || CASE WHEN label = 1 THEN 'cryptojacking' ELSE 'benign' END || '/user ' || program::VARCHAR || '.json' AS source_path,
'user ' || program::VARCHAR || '.json' AS source_name FROM br"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = ft.stratified_split(fx.samples(spark, sf_dir), "label", "program")
    rows = ft.batch_rows(split, ["program"])
    name = F.when(F.col("label") == 1, "cryptojacking").otherwise("benign")
    rows = rows.withColumn("class_name", name).withColumn("source_path", F.concat(F.lit("/data/"), name, F.lit("/user "), F.col("program").cast("string"), F.lit(".json")))
    return rows.select("split", "batch_number", "row_index_in_split", "row_index_in_batch", "label", "class_name", "source_path", tx.base_name(F.col("source_path")).alias("source_name"))


@query(f"WITH {_TRAIN} {_METADATA}")
def row_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir)


@query(f"WITH {fx.SAMPLES} SELECT program, label, split FROM split")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.stratified_split(fx.samples(spark, sf_dir), "label", "program")


@query(f"WITH {fx.SAMPLES} SELECT split, label, count(*) AS n FROM split GROUP BY split, label")
def split_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_stratified(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(f"WITH {fx.SAMPLES} SELECT program, label, ntile(3) OVER (PARTITION BY label ORDER BY program) - 1 AS fold FROM split WHERE split = 'train'")
def cross_validation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_stratified(spark, sf_dir).filter("split = 'train'").select("program", "label")
    return ft.folds(train, "label", "program").withColumn("fold", F.col("fold").cast("long"))


@query(f"""WITH {_TRAIN} SELECT split, count(DISTINCT program) AS n_rows, (SELECT count(*) FROM v) AS n_columns, count(feature_id) AS nonzero,
round(count(feature_id)::DOUBLE / (count(DISTINCT program) * (SELECT count(*) FROM v)), 9) AS density FROM split LEFT JOIN ff USING (program) GROUP BY split""")
def matrix_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, vocabulary, freq = _train_only(spark, sf_dir)
    size = vocabulary.agg(F.count("*").alias("n_columns"))
    cells = split.join(freq, "program", "left").groupBy("split").agg(F.count_distinct("program").alias("n_rows"), F.count("feature_id").alias("nonzero"))
    cells = cells.crossJoin(F.broadcast(size))  # one row
    return cells.withColumn("density", _r(ft.density(F.col("nonzero"), F.col("n_rows"), F.col("n_columns"))))


@query(f"""WITH {_VOCAB}, x AS (SELECT program, list_sort(list({{'f': feature_id, 'n': n}})) AS l FROM fc GROUP BY program)
SELECT program, list_transform(l, lambda e: e.f) AS feature_ids, list_transform(l, lambda e: e.n) AS counts FROM x""")
def sample_count_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = feature_counts(spark, sf_dir).groupBy("program").agg(F.array_sort(F.collect_list(F.struct("feature_id", "n"))).alias("l"))
    return lists.select("program", F.col("l.feature_id").alias("feature_ids"), F.col("l.n").alias("counts"))


# --- graphs ----------------------------------------------------------------------------------------------

_CFG = f"WITH RECURSIVE {fx.CFG}"
_DFG = f"WITH RECURSIVE {fx.DFG}"


def _entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.blocks(spark, sf_dir)
    return gr.entry_blocks(b.select("function", "block", "idx"), b, fx.entries(spark, sf_dir))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.acyclic_paths(fx.blocks(spark, sf_dir), fx.cfg_edges(spark, sf_dir), _entry_blocks(spark, sf_dir))


@query(f"{_CFG} SELECT cb.function, cb.block, coalesce((SELECT list(ce.dst ORDER BY ce.pos) FROM ce WHERE ce.function = cb.function AND ce.src = cb.block), []) AS successors FROM cb")
def cfg_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.adjacency(fx.blocks(spark, sf_dir), fx.cfg_edges(spark, sf_dir))


@query(f"{_CFG} SELECT function, entry_block FROM eb")
def cfg_entry_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entry_blocks(spark, sf_dir)


@query(f"{_CFG} SELECT function, 'no block holds the entry address' AS warning FROM en WHERE function NOT IN (SELECT function FROM eb)")
def cfg_skipped_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.without_entry(fx.entries(spark, sf_dir), _entry_blocks(spark, sf_dir))


@query(f"{_CFG} SELECT function, path FROM cp")
def cfg_acyclic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("function", "path")


_CFG_NGRAMS = """cg AS (
  SELECT function, path, i - 1 AS start, path[i:i + 1] AS blocks FROM (SELECT *, unnest(range(1, len(path))) AS i FROM cp WHERE len(path) >= 2)
), cx AS (
  SELECT function, 'CFG' AS graph_type, array_to_string(path, ',') AS path, start::INT AS start,
         (SELECT role FROM turns t WHERE t.function = cg.function AND t.block = blocks[1]) || ' ' || (SELECT role FROM turns t WHERE t.function = cg.function AND t.block = blocks[2]) AS ngram
  FROM cg
)"""


def _graph_shingles(spark: SparkSession, sf_dir: str, paths: DataFrame, kind: str) -> DataFrame:
    items = gr.path_items(paths, fx.blocks(spark, sf_dir).select("function", "idx", "mnemonic"))
    rows = items.select("function", F.lit(kind).alias("graph_type"), F.array_join("path", ",").alias("path"), "mnemonics")
    return ng.shingle(rows, 2).select("function", "graph_type", "path", "start", _text())


@query(f"{_CFG}, {_CFG_NGRAMS} SELECT * FROM cx")
def cfg_path_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_shingles(spark, sf_dir, _paths(spark, sf_dir), "CFG")


@query(f"{_DFG} SELECT function, var, node, indegree, outdegree FROM dg")
def dfg_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(fx.dfg_edges(spark, sf_dir).filter("NOT loop_carried"), ["function", "var"])


@query(f"{_DFG} SELECT DISTINCT function, var, src AS node FROM de WHERE NOT EXISTS (SELECT 1 FROM de d WHERE d.function = de.function AND d.var = de.var AND d.dst = de.src)")
def dfg_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.roots(fx.dfg_edges(spark, sf_dir).filter("NOT loop_carried"), ["function", "var"])


@query(f"{_DFG} SELECT function, var, segment FROM sg")
def dfg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.segments(fx.dfg_edges(spark, sf_dir), ["function", "var"]).select("function", "var", "segment")


def _chains_sql(edges: str) -> str:
    return f"""{_DFG}, ch(function, var, node, path) AS (
  SELECT DISTINCT function, var, src, [src] FROM {edges} x WHERE NOT EXISTS (SELECT 1 FROM {edges} d WHERE d.function = x.function AND d.var = x.var AND d.dst = x.src)
  UNION ALL
  SELECT c.function, c.var, e.dst, list_append(c.path, e.dst) FROM ch c JOIN {edges} e ON e.function = c.function AND e.var = c.var AND e.src = c.node WHERE NOT list_contains(c.path, e.dst)
) SELECT function, var, path AS chain FROM ch c WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.function = c.function AND e.var = c.var AND e.src = c.node)"""


@query(_chains_sql("de"))
def dfg_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.chains(fx.dfg_edges(spark, sf_dir), ["function", "var"]).select("function", "var", "chain")


@query(_chains_sql("da"))
def dfg_variable_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.chains(fx.dfg_edges(spark, sf_dir), ["function", "var"], keep_loop_carried=True).select("function", "var", "chain")


@query(f"{_DFG} SELECT function, var, arg_min(kind, pos) AS kind FROM da GROUP BY function, var")
def dfg_kind_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.first_kinds(fx.dfg_edges(spark, sf_dir), ["function", "var"])


_UNION = f"""{_CFG}, {_CFG_NGRAMS}, {fx.DFG}, sn AS (
  SELECT function, segment, i - 1 AS start, segment[i:i + 1] AS nodes FROM (SELECT *, unnest(range(1, len(segment))) AS i FROM sg)
), un AS (
  SELECT * FROM cx UNION ALL
  SELECT function, 'DFG', array_to_string(segment, ','), start::INT,
         (SELECT role FROM turns t WHERE t.function = sn.function AND t.block = nodes[1]) || ' ' || (SELECT role FROM turns t WHERE t.function = sn.function AND t.block = nodes[2])
  FROM sn
)"""


@query(f"{_UNION} SELECT * FROM un")
def graph_ngram_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = gr.segments(fx.dfg_edges(spark, sf_dir), ["function", "var"]).select("function", F.col("segment").alias("path"))
    return cfg_path_ngrams(spark, sf_dir).unionByName(_graph_shingles(spark, sf_dir, segments, "DFG"))


@query(f"""{_UNION} SELECT ngram, count(*) AS total_occurrences, count(DISTINCT function) AS n_functions, list_sort(list(DISTINCT graph_type)) AS graph_types FROM un GROUP BY ngram""")
def graph_ngram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ngram_union(spark, sf_dir).groupBy("ngram").agg(
        F.count("*").alias("total_occurrences"), F.count_distinct("function").alias("n_functions"), F.array_sort(F.collect_set("graph_type")).alias("graph_types"),
    )


# --- occurrences and evidence ----------------------------------------------------------------------------

@query(f"""WITH {_VOCAB} SELECT program, feature_id, array_to_string(ngram, ' ') AS ngram, count(*) AS n_occurrences, list_sort(list(function || '@' || start::VARCHAR)) AS occurrences
FROM ng JOIN v USING (ngram) GROUP BY program, feature_id, ngram""")
def occurrence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ngrams = _bigrams(spark, sf_dir)
    places = ngrams.select("program", "ngram", "function", F.lit("linear").alias("graph_type"), F.array(F.col("start").cast("string")).alias("addresses"))
    report = ft.occurrence_report(places, ft.lexicographic_vocabulary(ngrams))
    shown = F.array_sort(F.transform("occurrences", lambda o: F.concat(o["function"], F.lit("@"), o["addresses"][0])))
    return report.select("program", "feature_id", _text(), F.size("occurrences").cast("long").alias("n_occurrences"), shown.alias("occurrences"))


@query(f"WITH {_BIGRAMS} SELECT array_to_string(ngram, ' ') AS ngram, list_sort(list(DISTINCT function)) AS functions FROM ng GROUP BY ngram")
def ngram_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.ngram_functions(_bigrams(spark, sf_dir)).select(_text(), "functions")


@query(f"WITH {fx.CONTRIBUTIONS} SELECT vec_id, rank::INT AS rank, feature_id, round(value, 9) AS value, CASE WHEN value > 0 THEN 'toward cryptojacking' ELSE 'toward benign' END AS direction FROM tk")
def topk_abs_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id")
    return top.select("vec_id", "rank", "feature_id", _r("value"), tx.direction(F.col("value")).alias("direction"))


@query(f"""WITH {fx.CONTRIBUTIONS}, o AS (
  SELECT 'f' || (doc_id % 50)::VARCHAR AS ngram, list_sort(list(DISTINCT 'fun_' || (doc_id % 7)::VARCHAR)) AS functions FROM labels GROUP BY 1
) SELECT vec_id, rank::INT AS rank, ngram, round(value, 9) AS value, coalesce(functions, []) AS functions FROM tk LEFT JOIN o USING (ngram)""")
def evidence_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.table(spark, sf_dir, "labels")
    places = labels.select(F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("ngram"), F.concat(F.lit("fun_"), (F.col("doc_id") % 7).cast("string")).alias("function"))
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id")
    return ft.evidence(top, ft.ngram_functions(places)).select("vec_id", "rank", "ngram", _r("value"), "functions")


# --- metrics ---------------------------------------------------------------------------------------------

@query(f"WITH {fx.PREDICTED} SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(fx.predicted(spark, sf_dir))


@query(f"WITH {fx.PREDICTED} SELECT round(fp::DOUBLE / (tn + fp), 9) AS false_positive_rate FROM cm")
def false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.false_positive_rate(fx.predicted(spark, sf_dir)).select(_r("false_positive_rate"))


_REPORT = f"""WITH {fx.PREDICTED}, k AS (
  SELECT '0' AS label, tn AS hit, fn AS wrong, fp AS missed FROM cm UNION ALL SELECT '1', tp, fp, fn FROM cm
), c AS (
  SELECT label, CASE WHEN hit + wrong > 0 THEN hit / (hit + wrong) ELSE 0 END AS precision, CASE WHEN hit + missed > 0 THEN hit / (hit + missed) ELSE 0 END AS recall, hit + missed AS support FROM k
), f1 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM c
), rep AS (
  SELECT label, precision, recall, f1, support::BIGINT AS support FROM f1
  UNION ALL SELECT 'accuracy', a, a, a, s::BIGINT FROM (SELECT (tn + tp) / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS s FROM cm)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f1
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f1
)"""


@query(f"{_REPORT} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rep")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_report(fx.predicted(spark, sf_dir)).select("label", _r("precision"), _r("recall"), _r("f1"), "support")


@query(f"{_REPORT} SELECT label, round(precision * 100, 4) AS precision, round(recall * 100, 4) AS recall, round(f1 * 100, 4) AS f1, support FROM rep")
def percent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.percent_report(mt.classification_report(fx.predicted(spark, sf_dir)))


@query(f"WITH {fx.SCORED} SELECT round(sum((2 * tp - p) * n)::DOUBLE / (2 * sum(p) * sum(n)), 9) AS roc_auc FROM cum")
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.roc_auc(fx.scored(spark, sf_dir)).select(_r("roc_auc"))


@query(f"WITH {fx.SCORED} SELECT round(sum(precision * p) / sum(p), 9) AS average_precision FROM pr")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.average_precision(fx.scored(spark, sf_dir)).select(_r("average_precision"))


@query(f"WITH {fx.SCORED} SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.pr_curve(fx.scored(spark, sf_dir)).select("threshold", "tp", "fp", _r("precision"), _r("recall"), _r("f1"))


@query(f"WITH {fx.SCORED} SELECT score AS threshold, round(fp::DOUBLE / negatives, 9) AS fpr, round(tp::DOUBLE / positives, 9) AS tpr FROM cum")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.roc_curve(fx.scored(spark, sf_dir)).select("threshold", _r("fpr"), _r("tpr"))


@query(f"WITH {fx.SCORED} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.best_f1(fx.scored(spark, sf_dir)).select("threshold", _r("precision"), _r("recall"), _r("f1"))


@query(f"WITH {fx.SCORED} SELECT score AS threshold, round(fp::DOUBLE / negatives, 9) AS fpr, round(tp::DOUBLE / positives, 9) AS tpr FROM cum ORDER BY abs(score - 0.433), score LIMIT 1")
def roc_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.nearest_threshold(mt.roc_curve(fx.scored(spark, sf_dir)), 0.433).select("threshold", _r("fpr"), _r("tpr"))


@query("""WITH x AS (SELECT (doc_id % 5 + 1) / 5.0::DOUBLE AS size, (doc_id % 17) / 17.0::DOUBLE AS a, (doc_id % 23) / 23.0::DOUBLE AS b FROM labels)
SELECT size, round(avg(a), 9) AS train_f1_mean, round(stddev_pop(a), 9) AS train_f1_std, round(avg(b), 9) AS validation_f1_mean, round(stddev_pop(b), 9) AS validation_f1_std FROM x GROUP BY size""")
def learning_curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    x = fx.table(spark, sf_dir, "labels").select(((d % 5 + 1) / 5.0).alias("size"), ((d % 17) / 17.0).alias("train_f1"), ((d % 23) / 23.0).alias("validation_f1"))
    s = mt.learning_curve_summary(x)
    return s.select("size", *[_r(c) for c in s.columns if c != "size"])


# --- judging ---------------------------------------------------------------------------------------------

_ASSESSED = f"""WITH {fx.CONTRIBUTIONS}, am AS (
  SELECT vec_id, rank, CASE WHEN rank % 9 = 0 THEN 'unknown' ELSE ngram END AS ngram, value + CASE WHEN rank % 4 = 0 THEN 0.001 WHEN rank % 5 = 0 THEN 0.0000002 ELSE 0 END AS reported FROM tk
), au AS (
  SELECT am.vec_id, am.rank, am.ngram, am.reported, tk.value AS expected, tk.value IS NULL OR abs(am.reported - tk.value) > 5e-7 + 1e-12 AS discrepancy
  FROM am LEFT JOIN tk ON tk.vec_id = am.vec_id AND tk.ngram = am.ngram
)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id").withColumn("shap_value", F.col("value"))
    off = F.when(F.col("rank") % 4 == 0, 0.001).when(F.col("rank") % 5 == 0, 0.0000002).otherwise(0.0)
    said = top.select("vec_id", "rank", F.when(F.col("rank") % 9 == 0, "unknown").otherwise(F.col("ngram")).alias("ngram"), (F.col("value") + off).alias("reported"))
    return jd.numeric_audit(top, said, ["vec_id"])


@query(f"{_ASSESSED} SELECT vec_id, count(*) AS checked, count(*) FILTER (discrepancy) AS discrepancies, count(*) FILTER (discrepancy) = 0 AS numeric_match FROM au GROUP BY vec_id")
def numeric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("discrepancy"))
    return _audit(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("checked"), n.alias("discrepancies"), (n == 0).alias("numeric_match"))


@query("""WITH s AS (
  SELECT doc_id % 40 AS sample_id, doc_id % 3 AS source_rank, doc_id AS pos, '/candidate_analysis/' || (doc_id % 4)::VARCHAR AS candidate_path, 'q' || (doc_id % 3)::VARCHAR AS quote FROM labels
) SELECT sample_id, source_rank, pos, candidate_path, quote FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, candidate_path, quote ORDER BY source_rank, pos) AS r FROM s) WHERE r = 1""")
def findings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    f = fx.table(spark, sf_dir, "labels").select(
        (d % 40).alias("sample_id"), (d % 3).alias("source_rank"), d.alias("pos"), F.concat(F.lit("/candidate_analysis/"), (d % 4).cast("string")).alias("candidate_path"), F.concat(F.lit("q"), (d % 3).cast("string")).alias("quote")
    )
    return jd.distinct_findings(f, ["sample_id"])


@query(f"WITH {fx.JUDGED} SELECT status, count(*) AS n FROM j GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.status_counts(fx.judged(spark, sf_dir))


def _share_sql(flag: str, yes: str, no: str) -> str:
    return f"""WITH {fx.JUDGED}, c AS (SELECT count(*) AS total, count(*) FILTER ({flag}) AS hits FROM j WHERE status = 'success'), r AS (
  SELECT '{no}' AS explanation, total - hits AS n, total FROM c UNION ALL SELECT '{yes}', hits, total FROM c UNION ALL SELECT 'Total evaluated', total, total FROM c
) SELECT explanation, n, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * n / total END, 6) AS percentage FROM r"""


_UNSUPPORTED = ("has_unsupported_claims", "Explanations with >=1 unsupported claim", "Explanations with no unsupported claims")
_FAITHFUL = ("faithful", "Faithful to SHAP sign and magnitude", "Faithfulness discrepancy")


@query(_share_sql(*_UNSUPPORTED))
def hallucination_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.share_table(fx.judged(spark, sf_dir), *_UNSUPPORTED).select("explanation", "n", _r("percentage", 6))


@query(_share_sql(*_FAITHFUL))
def faithfulness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.share_table(fx.judged(spark, sf_dir), *_FAITHFUL).select("explanation", "n", _r("percentage", 6))


@query(f"""WITH {fx.JUDGED}, u AS (UNPIVOT (SELECT technical_accuracy, coherence, cybersecurity_relevance, actionable_utility FROM j WHERE status = 'success')
  ON technical_accuracy, coherence, cybersecurity_relevance, actionable_utility INTO NAME dimension VALUE score)
SELECT dimension, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS sd, count(*) AS n FROM u GROUP BY dimension""")
def quality_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.quality_table(fx.judged(spark, sf_dir)).select("dimension", _r("mean_score", 6), _r("sd", 6), "n")


_RUNS = f"""WITH {fx.JUDGED}, runs AS (
  SELECT sample_id, r AS run, CASE WHEN n % 17 = 0 AND r = 3 THEN 'other' ELSE 'e' || n::VARCHAR END AS evidence_hash,
         CASE WHEN (n + r) % 6 = 0 THEN 'benign' ELSE 'high-confidence' END AS tier, CASE WHEN n % 5 = 0 AND r = 2 THEN '' WHEN n % 7 = 0 THEN 'FUN_' || (1000 + r)::VARCHAR ELSE 'FUN_1000' END AS cited
  FROM j, range(1, 4) x(r) WHERE n % 2 = 0 AND NOT (n % 10 = 4 AND r = 2)
), grp AS (
  SELECT sample_id, count(DISTINCT run) AS available_runs, count(DISTINCT evidence_hash) AS e, count(DISTINCT tier) AS t, count(*) FILTER (cited = '') AS uncited, count(DISTINCT cited) AS c FROM runs GROUP BY sample_id
), cg AS (
  SELECT sample_id, available_runs, available_runs = 3 AND e = 1 AS eligible, CASE WHEN available_runs = 3 AND e = 1 THEN t = 1 END AS tier_agreement,
         CASE WHEN available_runs = 3 AND e = 1 AND uncited = 0 THEN c = 1 END AS function_agreement FROM grp
)"""


def _repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n"), F.col("run")
    runs = fx.judged(spark, sf_dir).filter("n % 2 = 0").select("sample_id", "n", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("run")).filter(~((n % 10 == 4) & (r == 2)))
    cited = F.when((n % 5 == 0) & (r == 2), "").when(n % 7 == 0, F.concat(F.lit("calls FUN_"), (1000 + r).cast("string"))).otherwise("calls FUN_1000 and FUN_1000")
    runs = runs.withColumn("cited", tx.cited_tokens(cited))
    runs = runs.withColumn("evidence_hash", F.when((n % 17 == 0) & (r == 3), "other").otherwise(F.concat(F.lit("e"), n.cast("string"))))
    return jd.repeat_groups(runs.withColumn("tier", F.when((n + r) % 6 == 0, "benign").otherwise("high-confidence")), 3)


@query(f"{_RUNS} SELECT sample_id, available_runs, eligible, tier_agreement, function_agreement FROM cg")
def consistency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeat_groups(spark, sf_dir)


@query(f"""{_RUNS} SELECT count(*) AS samples_rerun, round(100.0::DOUBLE * count(*) FILTER (tier_agreement) / count(tier_agreement), 6) AS tier_agreement,
round(100.0::DOUBLE * count(*) FILTER (function_agreement) / count(function_agreement), 6) AS function_agreement FROM cg WHERE eligible""")
def consistency_tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.consistency_table(_repeat_groups(spark, sf_dir)).select("samples_rerun", _r("tier_agreement", 6), _r("function_agreement", 6))


_SAVED = f"""WITH {fx.JUDGED}, i AS (SELECT sample_id, 'h' || (n % 9)::VARCHAR AS input_hash, 'p1' AS protocol_hash FROM j), sv AS (
  SELECT sample_id, 'h' || (CASE WHEN n % 4 = 0 THEN n % 9 ELSE 0 END)::VARCHAR AS input_hash, CASE WHEN n % 12 = 0 THEN 'p0' ELSE 'p1' END AS protocol_hash, status FROM j WHERE n % 2 = 0
)"""


def _inputs_and_saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    j, n = fx.judged(spark, sf_dir), F.col("n")
    h = lambda c: F.concat(F.lit("h"), c.cast("string"))
    inputs = j.select("sample_id", h(n % 9).alias("input_hash"), F.lit("p1").alias("protocol_hash"))
    saved = j.filter("n % 2 = 0").select("sample_id", h(F.when(n % 4 == 0, n % 9).otherwise(0)).alias("input_hash"), F.when(n % 12 == 0, "p0").otherwise("p1").alias("protocol_hash"), "status")
    return inputs, saved


@query(f"""{_SAVED} SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM sv WHERE sv.status = 'success' AND sv.sample_id = i.sample_id AND sv.input_hash = i.input_hash AND sv.protocol_hash = i.protocol_hash)
THEN 'resumed' ELSE 'run' END AS action FROM i""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.resume(*_inputs_and_saved(spark, sf_dir))


@query(f"""{_SAVED} SELECT sv.* FROM sv WHERE sample_id IN (SELECT sample_id FROM i)
AND NOT EXISTS (SELECT 1 FROM i WHERE sv.sample_id = i.sample_id AND sv.input_hash = i.input_hash AND sv.protocol_hash = i.protocol_hash)""")
def superseded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jd.superseded(*_inputs_and_saved(spark, sf_dir))


@query("""SELECT doc_id, doc_id % 90 AS identity, CASE WHEN row_number() OVER (PARTITION BY doc_id % 90 ORDER BY doc_id) > 1 THEN 'duplicate_input' ELSE 'input_ready' END AS status FROM labels""")
def duplicate_input_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 90).alias("identity"))
    return jd.first_of_identity(items, "identity", ["doc_id"])


@query("SELECT doc_id, identity FROM (SELECT doc_id, doc_id % 300 AS identity, count(*) OVER (PARTITION BY doc_id % 300) AS n FROM labels) WHERE n = 1")
def ambiguous_repeats_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 300).alias("identity"))
    return jd.unambiguous(items, "identity")


@query(f"""WITH {fx.JUDGED} SELECT count(*) AS n_attempts, sum(CASE WHEN n % 6 <> 0 THEN n % 100 ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN n % 8 <> 0 THEN n % 50 ELSE 0 END)::BIGINT AS output_tokens,
count(*) FILTER (n % 6 <> 0 AND n % 8 <> 0) AS requests_with_reported_usage, count(*) FILTER (n % 6 = 0 OR n % 8 = 0) AS requests_without_reported_usage FROM j""")
def token_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    attempts = fx.judged(spark, sf_dir).select(F.when(n % 6 != 0, n % 100).alias("input_tokens"), F.when(n % 8 != 0, n % 50).alias("output_tokens"))
    return jd.token_usage(attempts).crossJoin(attempts.agg(F.count("*").alias("n_attempts")))  # one row each


@query(f"""WITH {_TRAIN}, md AS ({_METADATA}), m AS (SELECT *, CASE WHEN row_index_in_split = 3 THEN 1 - label ELSE label END AS matrix_label FROM md), q AS (
  SELECT *, row_number() OVER (PARTITION BY split, batch_number ORDER BY row_index_in_batch) - 1 AS spot, count(*) OVER (PARTITION BY source_name) AS names FROM m
) SELECT 'label_in_range' AS "check", count(*) FILTER (label NOT IN (0, 1)) AS n FROM q
UNION ALL SELECT 'class_name_matches', count(*) FILTER (class_name <> CASE WHEN label = 1 THEN 'cryptojacking' ELSE 'benign' END) FROM q
UNION ALL SELECT 'matrix_label_matches', count(*) FILTER (label <> matrix_label) FROM q
UNION ALL SELECT 'row_index_contiguous', count(*) FILTER (spot <> row_index_in_batch) FROM q
UNION ALL SELECT 'report_name_unique', count(*) FILTER (names > 1) FROM q""")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metadata(spark, sf_dir).withColumn("matrix_label", F.when(F.col("row_index_in_split") == 3, 1 - F.col("label")).otherwise(F.col("label")))
    return jd.manifest_violations(rows)


_REPORTS = """WITH rp AS (
  SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'bin ' || doc_id::VARCHAR END AS binary_name, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS llm_status,
         CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 14 = 0 THEN 'It Could Not Be Parsed' ELSE 'fine' END AS explanation, CASE WHEN doc_id % 8 = 0 THEN 'strange' ELSE 'benign' END AS tier,
         CASE WHEN doc_id % 15 = 0 THEN 1.5 ELSE 0.25 END AS probability, doc_id % 21 = 0 AS twice FROM labels
)"""


@query(f"""{_REPORTS} SELECT doc_id, CASE WHEN llm_status <> 'completed' THEN 'generation_error' WHEN binary_name IS NULL THEN 'input_error' WHEN explanation = '' THEN 'generation_error'
WHEN explanation = 'It Could Not Be Parsed' THEN 'generation_error' WHEN tier = 'strange' THEN 'input_error' WHEN probability > 1 THEN 'input_error' WHEN twice THEN 'input_error' ELSE 'input_ready' END AS status,
CASE WHEN llm_status <> 'completed' THEN 'explanation or SHAP not completed' WHEN binary_name IS NULL THEN 'no binary name' WHEN explanation = '' THEN 'no explanation'
WHEN explanation = 'It Could Not Be Parsed' THEN 'parse-failure fallback' WHEN tier = 'strange' THEN 'unknown tier' WHEN probability > 1 THEN 'invalid class or probability' WHEN twice THEN 'invalid or repeated n-gram' END AS reason FROM rp""")
def input_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    feature = lambda name: F.struct(F.lit(name).alias("ngram"), F.lit(0.5).alias("value"), F.lit(0.1).alias("shap_value"))
    reports = fx.table(spark, sf_dir, "labels").select(
        "doc_id", F.when(d % 19 != 0, F.concat(F.lit("bin "), d.cast("string"))).alias("binary_name"), F.lit("completed").alias("shap_status"),
        F.when(d % 7 == 0, "failed").otherwise("completed").alias("llm_status"), F.when(d % 9 == 0, "").when(d % 14 == 0, "It Could Not Be Parsed").otherwise("fine").alias("explanation"),
        F.lit(False).alias("parse_error"), F.when(d % 8 == 0, "strange").otherwise("benign").alias("tier"), F.lit(1).alias("prediction"), F.when(d % 15 == 0, 1.5).otherwise(0.25).alias("probability"),
        F.when(d % 21 == 0, F.array(feature("a b"), feature("a b"))).otherwise(F.array(feature("a b"), feature("b c"))).alias("features"),
    )
    return jd.screened(reports).select("doc_id", "status", "reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'report' WHEN doc_id % 4 IN (1, 2) THEN 'result' END AS layout, CASE WHEN doc_id % 4 < 3 THEN 2 END AS ngram_size,
CASE WHEN doc_id % 4 = 3 THEN 'input_error' WHEN doc_id % 4 = 2 THEN 'generation_error' ELSE 'input_ready' END AS status,
CASE WHEN doc_id % 4 IN (1, 2) THEN least(doc_id % 6, CASE WHEN doc_id % 8 = 1 THEN 2 ELSE 3 END)::INT END AS n_occurrences FROM labels""")
def judge_input_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    analysis = '"analysis": {"tier": "benign", "explanation": "fine"}'
    report = '{"sample": {"binary_name": "b"}, "random_forest": {"malware_probability": 0.5, "predicted_class": 1}, "shap": {"status": "completed", "top_features": [{"ngram": ["a", "b"], "value": 1, "shap_value": 0.5}]}, "llm": {"status": "completed", ' + analysis + "}}"
    times = F.array_join(F.array_repeat(F.lit('"x"'), (d % 6).cast("int")), ", ")
    result = F.concat(
        F.lit('{"binary_name": "b", "rf_prediction": 1, "rf_probability": 0.5, "evidence": [{"ngram": "a b", "frequency": 1, "shap_value": 0.5, "occurrences": ['), times, F.lit("]}], " + analysis),
        F.when(d % 8 == 1, ', "context_limits": {"occurrences_per_feature": 2}').otherwise(""), F.when(d % 4 == 2, ', "analysis_status": "failed"').otherwise(""), F.lit("}"),
    )
    files = fx.table(spark, sf_dir, "labels").select("doc_id", F.when(d % 4 == 0, report).when(d % 4 == 3, '{"other": 1}').otherwise(result).alias("text"))
    found = jd.screened(jd.judge_inputs(files))
    return found.select("doc_id", "layout", "ngram_size", "status", F.when(F.col("occurrences").isNotNull(), F.size(F.col("occurrences")[0]["records"])).alias("n_occurrences"))


@query("""WITH f AS (SELECT doc_id, map {'technical_accuracy': doc_id % 6, 'coherence': 3, 'cybersecurity_relevance': CASE WHEN doc_id % 10 = 0 THEN 2.5 ELSE 2 END, 'actionable_utility': 5} AS m, doc_id % 8 AS ref FROM labels)
SELECT doc_id, doc_id % 6 BETWEEN 1 AND 5 AND doc_id % 10 <> 0 AND ref < 6 AS valid FROM f""")
def judgement_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    scores = F.create_map(*[x for k, v in (("technical_accuracy", (d % 6).cast("double")), ("coherence", F.lit(3.0)), ("cybersecurity_relevance", F.when(d % 10 == 0, 2.5).otherwise(2.0)), ("actionable_utility", F.lit(5.0))) for x in (F.lit(k), v)])
    forms = fx.table(spark, sf_dir, "labels").select("doc_id", scores.alias("scores"), F.array(F.concat(F.lit("SHAP:"), (d % 8).cast("string"))).alias("references"))
    return jd.valid_judgements(forms, F.array(*[F.lit(f"SHAP:{i}") for i in range(6)])).select("doc_id", "valid")


@query("SELECT round(count(*) FILTER (doc_id % 5 IN (1, 2))::DOUBLE / count(*), 9) AS unsupported_claim_rate FROM labels")
def unsupported_claim_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    claims = fx.table(spark, sf_dir, "labels").select(F.when(d % 5 == 1, "unsupported").when(d % 5 == 2, "contradicted").otherwise("supported").alias("label"))
    return jd.unsupported_rate(claims).select(_r("unsupported_claim_rate"))


# --- text ------------------------------------------------------------------------------------------------

_MARKS = "CASE doc_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END"


@query(f"""WITH x AS (SELECT doc_id, {_MARKS} || lang AS value FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(value, '^[=+\\-@]') THEN '''' || value ELSE value END AS value FROM x""")
def csv_formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 6
    value = F.concat(F.when(m == 0, "=").when(m == 1, "+").when(m == 2, "-").when(m == 3, "@").otherwise(""), "lang")
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.formula_guard(value).alias("value"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(left(text, 40) || '.JSON', '(?i)\\.json$', ''), '[^\\p{L}\\p{M}\\p{N}_.-]', '_', 'g') AS name FROM documents""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.substring("text", 1, 40), F.lit(".JSON"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.safe_name(name).alias("name"))


@query("""WITH x AS (SELECT doc_id, 'sub FUN_' || upper(to_hex(doc_id * 4099 + 4096)) || ' calls FUN_12 and (FUN_00401000), then ' || lang || 'FUN_00402000 in ' || source AS t FROM documents)
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, '\\bFUN_[0-9a-fA-F]{4,}\\b'))) AS functions FROM x""")
def function_citation_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("sub FUN_"), F.hex(F.col("doc_id") * 4099 + 4096), F.lit(" calls FUN_12 and (FUN_00401000), then "), "lang", F.lit("FUN_00402000 in "), "source")
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.cited_tokens(t).alias("functions"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE '{"tier": "benign", "n": ' || doc_id::VARCHAR || '}' END AS answer,
CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id END AS n FROM labels""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in every wrapping that models use, and some without any object."""
    d = F.col("doc_id")
    one = F.concat(F.lit('{"tier": "benign", "n": '), d.cast("string"), F.lit("}"))
    raw = (
        F.when(d % 5 == 0, F.concat(F.lit("  "), one)).when(d % 5 == 1, F.concat(F.lit("<think>{not json}</think>\n"), one))
        .when(d % 5 == 2, F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```"))).when(d % 5 == 3, F.concat(F.lit("I say "), one, F.lit(" so."))).otherwise("no object here")
    )
    found = fx.table(spark, sf_dir, "labels").select("doc_id", tx.salvaged_json(raw).alias("answer"))
    return found.withColumn("answer", F.trim("answer")).withColumn("n", F.get_json_object("answer", "$.n").cast("long"))


@query("""SELECT doc_id, sha256(lang || chr(31) || source || chr(31) || n_chars::VARCHAR) AS digest FROM documents""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\x1f", "lang", "source", F.col("n_chars").cast("string")), 256).alias("digest"))


@query(f"""WITH {_VOCAB} SELECT array_to_string(ngram, ' ') AS ngram, n_total, rank FROM (
  SELECT ngram, count(*) AS n_total, row_number() OVER (ORDER BY count(*) DESC, ngram) - 1 AS rank FROM ng GROUP BY ngram)""")
def ngram_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _bigrams(spark, sf_dir).groupBy("ngram").agg(F.count("*").alias("n_total"))
    return numbered(totals, [F.col("n_total").desc(), F.col("ngram")], "rank").select(_text(), "n_total", "rank")


@query(f"""WITH {fx.CONTRIBUTIONS} SELECT vec_id, string_agg('Rank ' || rank::VARCHAR || ': ' || ngram || ' (' || CASE WHEN value > 0 THEN 'toward cryptojacking' ELSE 'toward benign' END || ')', chr(10) ORDER BY rank) AS evidence
FROM tk WHERE rank <= 5 GROUP BY vec_id""")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id", 5)
    line = F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(": "), "ngram", F.lit(" ("), tx.direction(F.col("value")), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("vec_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("evidence"))


# --- reports ---------------------------------------------------------------------------------------------

_DETECTED = """WITH dr AS (
  SELECT doc_id, toxic AS y, CASE WHEN doc_id % 6 = 0 THEN 1 - toxic ELSE toxic END AS p, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'skipped' ELSE 'completed' END AS st FROM labels
)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = F.col("doc_id"), F.col("toxic")
    p = F.when(d % 6 == 0, 1 - y).otherwise(y)
    name = F.concat(F.lit("bin"), d.cast("string"))
    status = F.when(d % 5 == 0, "failed").when(d % 5 == 1, "skipped").otherwise("completed")
    feature = F.struct(F.lit(1).alias("feature_id"), F.lit("a b").alias("ngram"), F.lit(0.5).alias("value"), F.lit(0.25).alias("shap_value"))
    return fx.table(spark, sf_dir, "labels").select(
        "doc_id",
        F.struct(name.alias("binary_name"), F.concat(name, F.lit(".json")).alias("source_name"), F.concat(F.lit("d/"), name).alias("source_path"), F.lit("test").alias("split"), F.floor(d / 100).cast("int").alias("batch_number"), (d % 100).cast("int").alias("row_index_in_batch"), y.alias("actual_label"), F.when(y == 1, "cryptojacking").otherwise("benign").alias("actual_class")).alias("sample"),
        F.struct(F.lit(2).alias("ngram_size"), (p * 0.5 + 0.25).alias("malware_probability"), p.alias("predicted_class"), F.when(p == 1, "cryptojacking").otherwise("benign").alias("predicted_class_name")).alias("random_forest"),
        F.struct(F.lit(20).alias("top_feature_limit"), F.array(feature).alias("top_features"), F.when(d % 9 == 0, "failed").otherwise("completed").alias("status"), F.when(d % 9 == 0, "no explainer").alias("error")).alias("shap"),
        F.struct(status.alias("status"), F.struct(F.when(status == "completed", "benign").alias("tier"), F.lit(None).cast("string").alias("explanation"), F.lit(0.5).alias("confidence_score")).alias("analysis"), F.when(status == "failed", "timeout").alias("error"), F.struct((d % 50).alias("input_tokens"), (d % 20).alias("output_tokens"), F.lit("mock").alias("source")).alias("token_usage")).alias("llm"),
    )


@query(f"""{_DETECTED} SELECT count(*) AS test_samples, count(*) FILTER (y = 0) AS actual_benign, count(*) FILTER (y = 1) AS actual_cryptojacking, count(*) FILTER (p = 0) AS predicted_benign,
count(*) FILTER (p = 1) AS predicted_cryptojacking, count(*) FILTER (st = 'completed') AS llm_completed, count(*) FILTER (st = 'failed') AS llm_failed, count(*) FILTER (st = 'skipped') AS llm_skipped,
count(*) FILTER (y = 1 AND p = 1) AS true_positives, count(*) FILTER (y = 0 AND p = 1) AS false_positives, count(*) FILTER (y = 1 AND p = 0) AS false_negatives,
round(count(*) FILTER (y = p)::DOUBLE / count(*), 9) AS accuracy FROM dr""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.detection_summary(_reports(spark, sf_dir)).withColumn("accuracy", _r("accuracy"))


@query(f"""{_DETECTED} SELECT 'bin' || doc_id::VARCHAR AS binary_name, p AS predicted_class, st AS llm_status, CASE WHEN st = 'completed' THEN 'benign' END AS llm_tier, doc_id % 50 AS llm_input_tokens,
CASE WHEN st = 'failed' THEN 'timeout' WHEN doc_id % 9 = 0 THEN 'no explainer' END AS error, '[{{"feature_id":1,"ngram":"a b","value":0.5,"shap_value":0.25}}]' AS top_shap_features_json FROM dr""")
def report_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rp.flat_reports(_reports(spark, sf_dir))
    return flat.select("binary_name", "predicted_class", "llm_status", "llm_tier", "llm_input_tokens", "error", "top_shap_features_json")


@query(f"{_DETECTED} SELECT doc_id FROM dr WHERE p = 1")
def rf_positive_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import graphs

    return graphs.positive_reports(_reports(spark, sf_dir)).select("doc_id")


@query(f"""{_DETECTED} SELECT doc_id, doc_id % 9 <> 0 AND st IN ('completed', 'skipped') AND doc_id % 4 <> 0 AS reuse FROM dr""")
def report_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = _reports(spark, sf_dir)
    rows = saved.select("doc_id", "sample.source_name", "sample.source_path", "sample.batch_number", "sample.row_index_in_batch", F.col("sample.actual_label").alias("label"))
    rows = rows.withColumn("source_path", F.when(F.col("doc_id") % 4 == 0, "moved").otherwise(F.col("source_path")))
    return rp.reusable(rows, saved, 2).select("doc_id", "reuse")


@query("""WITH a AS (SELECT doc_id % 30 AS run, doc_id AS pos, CASE WHEN doc_id % 7 IN (1, 2, 3, 4) THEN 'judge_error' WHEN doc_id % 7 = 5 THEN 'input_error' ELSE 'success' END AS outcome, doc_id % 101 = 7 AS fatal FROM labels), t AS (
  SELECT *, outcome = 'judge_error' AND lag(outcome, 1) OVER w = 'judge_error' AND lag(outcome, 2) OVER w = 'judge_error' OR fatal AS stop FROM a WHERE outcome <> 'input_error' WINDOW w AS (PARTITION BY run ORDER BY pos)
), s AS (SELECT run, min(pos) AS stop_pos FROM t WHERE stop GROUP BY run)
SELECT a.run, a.pos, CASE WHEN a.outcome <> 'input_error' AND a.pos > s.stop_pos THEN 'not_attempted_batch_stopped' ELSE a.outcome END AS status FROM a LEFT JOIN s USING (run)""")
def batch_stop_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    outcome = F.when((d % 7).isin(1, 2, 3, 4), "judge_error").when(d % 7 == 5, "input_error").otherwise("success")
    attempts = fx.table(spark, sf_dir, "labels").select((d % 30).alias("run"), d.alias("pos"), outcome.alias("outcome"), (d % 101 == 7).alias("fatal"))
    return rp.run_states(attempts).select("run", "pos", "status")


@query("""WITH f AS (SELECT doc_id // 10 AS batch_id, count(*) AS n_rows FROM labels WHERE doc_id // 10 % 7 <> 0 GROUP BY 1), y AS (SELECT doc_id // 10 AS batch_id, count(*) + CASE WHEN doc_id // 10 % 5 = 0 THEN 1 ELSE 0 END AS n_rows FROM labels WHERE doc_id // 10 % 11 <> 0 GROUP BY 1)
SELECT batch_id, f.n_rows AS feature_rows, y.n_rows AS label_rows, CASE WHEN y.n_rows IS NULL THEN 'no labels' WHEN f.n_rows IS NULL THEN 'no features' ELSE 'row mismatch' END AS problem
FROM f FULL JOIN y USING (batch_id) WHERE f.n_rows IS DISTINCT FROM y.n_rows""")
def batch_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.floor(F.col("doc_id") / 10)
    counts = fx.table(spark, sf_dir, "labels").groupBy(b.alias("batch_id")).agg(F.count("*").alias("n_rows"))
    i = F.col("batch_id")
    labels = counts.filter(i % 11 != 0).withColumn("n_rows", F.col("n_rows") + F.when(i % 5 == 0, 1).otherwise(0))
    return rp.paired_batches(counts.filter(i % 7 != 0), labels)


@query(f"""WITH {fx.CONTRIBUTIONS}, e AS (
  SELECT vec_id, string_agg(chr(10) || chr(10) || 'Rank ' || rank::VARCHAR || ': ' || ngram || chr(10) || '  Frequency : ' || printf('%.6f', 0.25) || chr(10) || '  SHAP      : ' || printf('%+.6f', (feature_id - 32) / 64.0::DOUBLE) || ' (' || CASE WHEN feature_id > 32 THEN 'toward cryptojacking' ELSE 'toward benign' END || ')', '' ORDER BY rank) AS lines, count(*) AS n
  FROM tk WHERE rank <= 3 GROUP BY vec_id
) SELECT vec_id AS sample_id, 'Binary Name: v' || vec_id::VARCHAR || chr(10) || 'Random Forest Prediction: MALWARE (class 1) with probability 0.7500.' || chr(10) || chr(10) || 'The following are the Top-' || n::VARCHAR || '{rp.PROMPT_INTRODUCTION}' || lines || '{rp.PROMPT_INSTRUCTIONS}' AS prompt FROM e""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id", 3)
    evidence = top.select(F.col("vec_id").alias("sample_id"), "rank", "ngram", F.lit(0.25).alias("value"), ((F.col("feature_id") - 32) / 64.0).alias("shap_value"))
    samples = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("binary_name"), F.lit(1).alias("prediction"), F.lit(0.75).alias("probability"))
    return rp.prompts(samples, evidence)


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/candidate_analysis/explanation' WHEN doc_id % 3 = 1 THEN '/candidate_analysis/notes/1' ELSE '/other' END AS candidate_path, CASE WHEN doc_id % 4 = 0 THEN 'absent' ELSE doc_id::VARCHAR END AS quote FROM labels)
SELECT doc_id AS sample_id, candidate_path, quote, doc_id % 3 <> 2 AND doc_id % 4 <> 0 AS verified FROM f""")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.when(d % 3 == 0, "/candidate_analysis/explanation").when(d % 3 == 1, "/candidate_analysis/notes/1").otherwise("/other")
    findings = fx.table(spark, sf_dir, "labels").select(d.alias("sample_id"), path.alias("candidate_path"), F.when(d % 4 == 0, "absent").otherwise(d.cast("string")).alias("quote"))
    analysis = F.to_json(F.struct(F.concat(F.lit("says "), d.cast("string")).alias("explanation"), F.array(F.lit("x"), d.cast("string")).alias("notes")))
    return rp.verified_findings(findings, fx.table(spark, sf_dir, "labels").select(d.alias("sample_id"), analysis.alias("analysis")))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '-4' WHEN 2 THEN ' 17 ' WHEN 3 THEN 'n/a' ELSE doc_id::VARCHAR END AS v, CASE doc_id % 4 WHEN 0 THEN 'LENGTH' WHEN 1 THEN 'stop' END AS reason, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS done FROM labels), c AS (
  SELECT *, CASE doc_id % 5 WHEN 2 THEN 17 WHEN 4 THEN doc_id END AS tokens FROM x
) SELECT doc_id, tokens::BIGINT AS output_tokens, coalesce(lower(reason) = 'length', false) OR coalesce(NOT done, false) OR coalesce(tokens >= 300, false) AS truncated FROM c""")
def answer_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    value = F.when(d % 5 == 0, "true").when(d % 5 == 1, "-4").when(d % 5 == 2, " 17 ").when(d % 5 == 3, "n/a").otherwise(d.cast("string"))
    reason = F.when(d % 4 == 0, "LENGTH").when(d % 4 == 1, "stop")
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", rp.token_count(value).alias("output_tokens"), reason.alias("reason"), F.when(d % 3 == 0, d % 2 == 0).alias("done"))
    return rows.select("doc_id", "output_tokens", rp.truncated(F.col("reason"), F.col("done"), F.col("output_tokens"), 300).alias("truncated"))


@query(f"""WITH {fx.CONTRIBUTIONS} SELECT vec_id AS sample_id, 'SHAP:' || rank::VARCHAR AS evidence_id, ngram AS text FROM tk WHERE rank <= 3
UNION ALL SELECT doc_id, 'DISASM:main:' || (i - 1)::VARCHAR, lines[i] FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def evidence_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ft.top_contributions(fx.contributions(spark, sf_dir), "vec_id", 3).withColumnRenamed("vec_id", "sample_id")
    code = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.lit("main").alias("function"), F.split("text", "\n").alias("lines"))
    return jd.evidence_catalog(top, code)


@query(f"WITH RECURSIVE {fx.CFG} SELECT function, path FROM cp")
def cfg_acyclic_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths by a recursive query: all of it in the JVM, level by level, for graphs of few paths."""
    fx.cfg_edges(spark, sf_dir).createOrReplaceTempView("pathloom_edges")
    _entry_blocks(spark, sf_dir).createOrReplaceTempView("pathloom_entries")
    return spark.sql("""
      WITH RECURSIVE walk(function, block, path) AS (
        SELECT function, entry_block, array(entry_block) FROM pathloom_entries
        UNION ALL
        SELECT w.function, e.dst, array_append(w.path, e.dst) FROM walk w JOIN pathloom_edges e ON e.function = w.function AND e.src = w.block
        WHERE NOT array_contains(w.path, e.dst)
      ) SELECT w.function, w.path FROM walk w LEFT ANTI JOIN pathloom_edges e ON e.function = w.function AND e.src = w.block""")


# --- models (no SQL form) --------------------------------------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") < 4, 1).otherwise(0).alias("label"), "embedding")
    rows = ft.folds(rows, "label", "vec_id")
    return rows.withColumn("vector", array_to_vector("embedding")).drop("embedding")


@query()
def forest_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import forest as fo

    scored = fo.out_of_fold(_vectors(spark, sf_dir).cache(), fo.classifier(depth=6, trees=10))
    return scored.select("vec_id", "label", "fold", "score", "prediction")


@query()
def forest_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import forest as fo

    rows = _vectors(spark, sf_dir).cache()
    model = fo.classifier(depth=5, trees=5).fit(rows)
    return ft.top_contributions(fo.contributions(model, rows, "vec_id").filter("feature_id >= 0"), "vec_id", 20, "shap_value")

