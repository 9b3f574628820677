"""Reading graph files, vocabularies, reports and feature matrices; writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered

#: One file per binary. defs and uses of instructions are part of the format but nothing reads them.
GRAPH_SCHEMA = """
binary string, label int, label_name string,
graphs array<struct<
  function: string, entry: string,
  instructions: array<struct<idx: int, addr: string, mnemonic: string, operands: string>>,
  cfg_nodes: array<struct<instr_indices: array<int>, start: string, end: string>>,
  cfg_edges: array<struct<src: int, dst: int, from: int, to: int>>,
  dfg_edges: array<struct<from: int, to: int, var: string, kind: string, loop_carried: boolean>>>>,
_corrupt_record string
"""
# Class folders and their labels.
CLASSES = {"benign": 0, "cryptojacking": 1}
#: Files are dealt to batches of so many rows.
BATCH_ROWS = 100


def read_files(spark: SparkSession, path: str, json_only: bool = True) -> DataFrame:
    """A row per graph file with its path; files that are no JSON keep their text in _corrupt_record."""
    reader = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True)
    if json_only:
        reader = reader.option("pathGlobFilter", "*.[jJ][sS][oO][nN]")
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def skipped(files: DataFrame) -> DataFrame:
    """Files that could not be parsed."""
    return files.filter("_corrupt_record IS NOT NULL").select("path", F.lit("malformed JSON").alias("error"))


def usable(files: DataFrame) -> DataFrame:
    return files.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def labelled_files(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """path, class_name, label and pos (place among the sorted files of its class) of every .json file in a class folder; all
    folders must exist and hold one."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").load(dataset_dir).select("path")
    named = listing.withColumn("class_name", F.element_at(F.split("path", "/"), -2)).filter(F.col("class_name").isin(*CLASSES))
    label = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])[F.col("class_name")]
    out = named.withColumn("label", label)
    missing = set(CLASSES) - {r[0] for r in out.select("class_name").distinct().collect()}
    if missing:
        raise FileNotFoundError(f"no files for {sorted(missing)} under {dataset_dir}")
    return numbered(out, [F.col("path")], "pos", ("class_name",))


def functions(files: DataFrame) -> DataFrame:
    """A row per function: binary, label, pos, function, entry and its four lists. An edge's ends may be
    named src and dst, or from and to; an edge without both ends is dropped."""
    row = usable(files).select("path", "binary", "label", "label_name", F.posexplode("graphs").alias("pos", "g"))
    edges = F.transform("g.cfg_edges", lambda e: F.struct(F.coalesce(e["src"], e["from"]).alias("src"), F.coalesce(e["dst"], e["to"]).alias("dst")))
    dfg = F.transform("g.dfg_edges", lambda e: F.struct(e["from"].alias("src"), e["to"].alias("dst"), e["var"].alias("var"), e["kind"].alias("kind"), F.coalesce(e["loop_carried"], F.lit(False)).alias("loop_carried")))
    nothing = lambda kind: F.array().cast(kind)
    return row.select(
        "path", "binary", "label", "label_name", "pos", F.col("g.function").alias("function"), F.col("g.entry").alias("entry"),
        F.transform("g.instructions", lambda i: F.struct(i["idx"].alias("idx"), i["addr"].alias("address"), i["mnemonic"].alias("mnemonic"), F.coalesce(i["operands"], F.lit("")).alias("operands"))).alias("instructions"),
        F.col("g.cfg_nodes").alias("blocks"),
        F.coalesce(F.filter(edges, lambda e: e["src"].isNotNull() & e["dst"].isNotNull()), nothing("array<struct<src: int, dst: int>>")).alias("cfg_edges"),
        F.coalesce(dfg, nothing("array<struct<src: int, dst: int, var: string, kind: string, loop_carried: boolean>>")).alias("dfg_edges"),
    )


def instructions(functions: DataFrame) -> DataFrame:
    """A row per instruction in program order (pos_in_function)."""
    rows = functions.select("path", "binary", "label", "pos", "function", F.posexplode("instructions").alias("pos_in_function", "i"))
    return rows.select("path", "binary", "label", "pos", "function", "pos_in_function", "i.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, ngram (array) and n of a saved vocabulary."""
    saved = spark.read.schema("n int, vocabulary_size long, features map<string, long>").option("multiLine", True).json(path)
    rows = saved.select("n", F.explode("features").alias("text", "feature_id"))
    return rows.select("feature_id", F.split(F.trim("text"), r"\s+").alias("ngram"), "n")


def write_vocabulary(vocabulary: DataFrame, n: int, path: str) -> None:
    """One JSON object {n, vocabulary_size, features}. The file format holds the whole vocabulary as one object, so
    this is for vocabularies that fit a task; larger ones stay Parquet tables."""
    pairs = F.collect_list(F.struct(F.array_join("ngram", " "), "feature_id"))
    one = vocabulary.agg(F.lit(n).alias("n"), F.count("*").alias("vocabulary_size"), F.map_from_entries(F.array_sort(pairs)).alias("features"))
    one.coalesce(1).write.mode("overwrite").json(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Entries (split, batch_number, row, feature_id, value) by split and batch; stale batches go."""
    matrix.repartition("split", "batch_number").write.mode("overwrite").partitionBy("split", "batch_number").parquet(path)


def read_matrix(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A split of a written matrix: only its folders are read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def write_split(matrix: DataFrame, labels: DataFrame, features: int, path: str) -> None:
    """A matrix and its labels (split, batch_number, row_index_in_batch, label) side by side, each by split and batch, with the number of
    features beside every label."""
    write_matrix(matrix, f"{path}/features")
    labelled = labels.select("split", "batch_number", "row_index_in_batch", "label", F.lit(features).alias("n_features"))
    labelled.repartition("split", "batch_number").write.mode("overwrite").partitionBy("split", "batch_number").parquet(f"{path}/labels")


def load_split(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame, int]:
    """(matrix entries, labels, number of features) of a written split. Refused: no labels, batches with different numbers of features, a
    row with two labels, entries beyond the features, and entries of a row or batch without a label. A row without entries is all zeros."""
    matrix = read_matrix(spark, f"{path}/features", split)
    labels = read_matrix(spark, f"{path}/labels", split)
    widths = [r[0] for r in labels.select("n_features").distinct().limit(3).collect()]
    if len(widths) != 1:
        raise ValueError(f"the batches of {split} have {sorted(widths) or 'no'} features")
    key = ["batch_number", "row_index_in_batch"]
    twice = labels.groupBy(*key).count().filter("count > 1").limit(1).count()
    beyond = matrix.filter((F.col("feature_id") < 0) | (F.col("feature_id") >= widths[0])).limit(1).count()
    lost = matrix.join(labels, key, "left_anti").limit(1).count()
    for bad, why in ((twice, "a row has two labels"), (beyond, "an entry is beyond the features"), (lost, "a row of the matrix has no label")):
        if bad:
            raise ValueError(f"{split}: {why}")
    return matrix, labels.drop("n_features"), widths[0]


def read_strict_json(spark: SparkSession, path: str) -> DataFrame:
    """path, text and valid: one JSON object a file, byte order mark allowed, repeated keys not."""
    from ..functions.text import valid_json

    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), valid_json(F.col("value")).isNotNull().alias("valid"))


def resolved_sources(rows: DataFrame, files: DataFrame, dataset_dir: str) -> DataFrame:
    """rows with source: source_path if such a file exists, else <dataset>/<class>/<name> if that does, else null; require_sources()
    refuses the last."""
    wanted = rows.withColumn("_fallback", F.concat_ws("/", F.lit(dataset_dir.rstrip("/")), "class_name", "source_name"))
    a, b = files.select(F.col("path").alias("_a")), files.select(F.col("path").alias("_b"))
    found = wanted.join(a, wanted["source_path"] == a["_a"], "left").join(b, wanted["_fallback"] == b["_b"], "left")
    return found.withColumn("source", F.coalesce("_a", "_b")).drop("_a", "_b", "_fallback")


def require_sources(resolved: DataFrame) -> DataFrame:
    """resolved, unless a row has no source."""
    lost = resolved.filter("source IS NULL").select("source_name").limit(5).collect()
    if lost:
        raise FileNotFoundError(f"no source file for {[r['source_name'] for r in lost]}")
    return resolved


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("y_true int, y_pred int").option("header", True).csv(path)


def positive_reports(reports: DataFrame) -> DataFrame:
    """Detection reports of predicted positives."""
    return reports.filter(F.col("random_forest.predicted_class") == 1)


def csv_guarded(df: DataFrame) -> DataFrame:
    """df with a quote before text that a spreadsheet would run as a formula."""
    from ..functions.text import formula_guard

    guarded: list[Column] = [formula_guard(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema]
    return df.select(*guarded)


def guarded_csv(df: DataFrame, path: str) -> None:
    """CSV with the formula guard."""
    csv_guarded(df).write.mode("overwrite").option("header", True).csv(path)
