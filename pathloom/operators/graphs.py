"""Control-flow and data-flow graph operators.

Edge tables have (graph, src, dst) and, where order matters, pos; repeated edges count as often as they
stand there. Traversals run per graph, so a task holds one function's graph at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(nodes: DataFrame, edges: DataFrame, graph: str = "function", node: str = "block") -> DataFrame:
    """Every node with its successors in edge order; none is an empty list."""
    out = edges.groupBy(graph, F.col("src").alias(node)).agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("_e"))
    listed = nodes.select(graph, node).distinct().join(out, [graph, node], "left")
    succ = F.coalesce(F.transform("_e", lambda e: e["dst"]), F.array().cast("array<int>"))
    return listed.select(graph, node, succ.alias("successors"))


def entry_blocks(blocks: DataFrame, instructions: DataFrame, entries: DataFrame, graph: str = "function") -> DataFrame:
    """The first block (by number) that holds an instruction at the entry address, compared without case.
    blocks: (graph, block, idx); graphs without such a block have no row."""
    at = blocks.join(instructions.select(graph, "idx", "address"), [graph, "idx"]).join(entries, graph)
    return at.filter(F.lower("address") == F.lower("entry")).groupBy(graph).agg(F.min("block").alias("entry_block"))


def without_entry(entries: DataFrame, found: DataFrame, graph: str = "function") -> DataFrame:
    """Functions whose control flow is skipped, with the reason."""
    return entries.join(found, graph, "left_anti").select(graph, F.lit("no block holds the entry address").alias("warning"))


def acyclic_paths(nodes: DataFrame, edges: DataFrame, entries: DataFrame, graph: str = "function", most_paths: int | None = None) -> DataFrame:
    """(graph, path_id, path): all paths from the entry block to a block without successors that visit no
    block twice, in depth-first order. A branch whose successors have all been visited gives none.

    Edges to unknown blocks raise, as a graph with such an edge is broken. most_paths stops a graph's
    enumeration (a guard against exponential graphs; off by default).
    """
    kinds = dict(nodes.dtypes)
    packed = _packed(nodes, edges, graph).join(entries.select(graph, "entry_block"), graph)

    def walk(nodes: list[int], edges: list, entry: int) -> Iterator[list[int]]:
        succ: dict[int, list[int]] = {n: [] for n in nodes}
        for _, a, b in edges:
            succ[a].append(b)
        stack = [[entry]]
        while stack:
            path = stack.pop()
            ahead = succ[path[-1]]
            if not ahead:
                yield path
            stack.extend(path + [n] for n in reversed(ahead) if n not in path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, nodes, edges, entry in zip(batch[graph], batch["nodes"], batch["edges"], batch["entry_block"], strict=True):
                found = []
                for i, path in enumerate(walk(list(nodes), _triples(edges), entry)):
                    if most_paths is not None and i >= most_paths:
                        break
                    found.append((key, i, path))
                    if len(found) == 10_000:  # a graph with very many paths does not pile up
                        yield pd.DataFrame(found, columns=[graph, "path_id", "path"])
                        found = []
                yield pd.DataFrame(found, columns=[graph, "path_id", "path"])

    return packed.mapInPandas(run, f"{graph} {kinds[graph]}, path_id int, path array<int>")


def _triples(edges) -> list[tuple[int, int, int]]:
    return [(e["pos"], e["src"], e["dst"]) for e in edges]


def _packed(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """A row per graph: its nodes and its edges in order."""
    n = nodes.groupBy(graph).agg(F.array_sort(F.collect_set("block")).alias("nodes"))
    e = edges.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("edges"))
    return n.join(e, graph, "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """In- and out-degree of every node that an edge touches; repeated edges count."""
    ends = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionByName(edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy(*by, "node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def roots(edges: DataFrame, by: list[str]) -> DataFrame:
    """Sources that are no edge's destination."""
    heads = edges.select(*by, F.col("src").alias("node")).distinct()
    return heads.join(edges.select(*by, F.col("dst").alias("node")), [*by, "node"], "left_anti")


def first_kinds(edges: DataFrame, by: list[str]) -> DataFrame:
    """The kind of each group's first edge, loop-carried ones included."""
    return edges.groupBy(*by).agg(F.min_by("kind", "pos").alias("kind"))


def _per_group(edges: DataFrame, by: list[str], column: str, walk: Callable[[list[tuple[int, int]]], Iterator[list[int]]]) -> DataFrame:
    """walk() over the edges of each group, in order."""
    kinds = dict(edges.dtypes)
    packed = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, edges in batch[[*by, "edges"]].itertuples(index=False):
                found = walk([(a, b) for _, a, b in _triples(edges)])
                rows += [(*key, i, x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*by, "chain_id", column])

    return packed.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "chain_id int", f"{column} array<int>"]))


def _successors(edges: list[tuple[int, int]]) -> dict[int, list[int]]:
    succ: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
    return succ


def segments(edges: DataFrame, by: list[str]) -> DataFrame:
    """Maximal linear segments of each group, loop-carried edges left out: from every node that starts, merges
    or branches, along each edge, to the next node that ends, branches or merges. Pure cycles have none."""

    def walk(edges: list[tuple[int, int]]) -> Iterator[list[int]]:
        succ = _successors(edges)
        indegree: dict[int, int] = defaultdict(int)
        for _, b in edges:
            indegree[b] += 1
        inner = lambda n: indegree[n] == 1 and len(succ.get(n, ())) == 1
        for start in sorted({n for e in edges for n in e}):
            if indegree[start] == 1 and len(succ.get(start, ())) < 2:
                continue
            for n in succ.get(start, ()):
                path = [start, n]
                while inner(path[-1]):
                    path.append(succ[path[-1]][0])
                yield path

    return _per_group(edges.filter(~F.col("loop_carried")), by, "segment", walk)


def chains(edges: DataFrame, by: list[str], keep_loop_carried: bool = False) -> DataFrame:
    """Every root-to-leaf chain of each group that visits no node twice."""

    def walk(edges: list[tuple[int, int]]) -> Iterator[list[int]]:
        succ = _successors(edges)
        targets = {b for _, b in edges}
        stack = [[n] for n in sorted({a for a, _ in edges} - targets, reverse=True)]
        while stack:
            path = stack.pop()
            ahead = succ.get(path[-1], [])
            if not ahead:
                yield path
            stack.extend(path + [n] for n in reversed(ahead) if n not in path)

    return _per_group(edges if keep_loop_carried else edges.filter(~F.col("loop_carried")), by, "chain", walk)


def path_items(paths: DataFrame, instructions: DataFrame, path: str = "path", graph: str = "function") -> DataFrame:
    """paths with mnemonics: those of the path's instructions, in order. instructions: (graph, idx, mnemonic);
    for a repeated idx the last one counts; an index without instruction raises."""
    lookup = instructions.groupBy(graph).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "mnemonic")))).alias("_map"))
    missing = lambda i: F.raise_error(F.concat(F.lit("no instruction "), i.cast("string")))
    items = F.transform(path, lambda i: F.coalesce(F.try_element_at("_map", i), missing(i)))
    return paths.join(lookup, graph).withColumn("mnemonics", items).drop("_map")
