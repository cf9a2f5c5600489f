"""Change coupling, dependency roll-ups and scores of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCORE, minmax, ratio


def examined_commits(changes: DataFrame, most_files: int) -> tuple[DataFrame, DataFrame]:
    """(commit_id, file_id) once each, and (commit_id, n, used): a commit of too many files isn't used."""
    touched = changes.select("commit_id", "file_id").distinct()
    per = touched.groupBy("commit_id").agg(F.count("*").alias("n")).withColumn("used", F.col("n") <= most_files)
    return touched, per


def change_coupling(changes: DataFrame, most_files: int = 100, least_changes: int = 1, least_score: float = 0.0) -> DataFrame:
    """(file_a, file_b, co_changes, score) of files that change together; the score is the share of the commits
    of the file that changes less. The cap on a commit's files bounds the pairs that one commit makes."""
    # one shuffle by commit serves the count and the pairing
    w = Window.partitionBy("commit_id")
    used = changes.select("commit_id", "file_id").distinct().withColumn("n", F.count("*").over(w)).where(F.col("n") <= most_files).select("commit_id", "file_id")
    per_file = used.groupBy("file_id").agg(F.count("*").alias("c"))
    a, b = used.withColumnRenamed("file_id", "file_a"), used.withColumnRenamed("file_id", "file_b")
    pairs = a.join(b, "commit_id").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least_changes)
    known = pairs.join(per_file.select(F.col("file_id").alias("file_a"), F.col("c").alias("ca")), "file_a").join(per_file.select(F.col("file_id").alias("file_b"), F.col("c").alias("cb")), "file_b")
    scored = known.withColumn("score", F.round(F.col("co_changes") / F.least("ca", "cb"), SCORE))
    return scored.where(F.col("score") >= least_score).select("file_a", "file_b", "co_changes", "score")


def coupled_with(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_a, file_b, co_changes), file_a < file_b, of pairs with one of the files (file_id) at least."""
    some = changes.join(files.select("file_id").distinct(), "file_id", "left_semi").select("commit_id", F.col("file_id").alias("a")).distinct()
    met = changes.select("commit_id", F.col("file_id").alias("b")).join(some, "commit_id").where("a <> b").distinct()
    counted = met.groupBy("a", "b").agg(F.count("*").alias("co_changes"))
    return counted.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"), "co_changes").distinct()


def coupling_diagnostics(changes: DataFrame, most_files: int = 100) -> DataFrame:
    """(examined, used, excluded, pairs) over all commits."""
    per = examined_commits(changes, most_files)[1].agg(F.count("*").alias("examined"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("excluded"))
    pairs = change_coupling(changes, most_files).agg(F.count("*").alias("n"))
    return per.select("examined", "used", "excluded", pairs.scalar().alias("pairs"))


def entity_change_counts(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_id, changes, authors): distinct commits and distinct authors."""
    joined = changes.select("commit_id", "file_id").distinct().join(commits.select("commit_id", "author_id"), "commit_id")
    return joined.groupBy("file_id").agg(F.count("*").alias("changes"), F.countDistinct("author_id").alias("authors"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, centrality): (in + out) / (n - 1), 0 for a single node. Parallel edges count once."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degree = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    n = nodes.agg(F.count("*")).scalar()
    joined = nodes.select("node").join(degree, "node", "left").select("node", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")))
    return joined.withColumn("centrality", F.round(F.when(n <= 1, 0.0).otherwise((F.col("fan_in") + F.col("fan_out")) / (n - 1)), SCORE))


def minmax_normalize(rows: DataFrame, level: str, value: str) -> DataFrame:
    return rows.withColumn("normalized", F.round(minmax(F.col(value), Window.partitionBy(level)), SCORE))


def hotspot_score(change: Column, centrality: Column, coupling: Column) -> Column:
    """Fixed weights of change frequency, centrality and coupling."""
    # the small amount settles halves the same way whatever rounds them
    return F.round(0.45 * change + 0.35 * centrality + 0.20 * coupling + 1e-9, SCORE)


def hotspots(changes: DataFrame, commits: DataFrame, files: DataFrame, edges: DataFrame, most_files: int = 100) -> DataFrame:
    """(file_id, changes, authors, change_score, centrality, coupling, hotspot) of each file."""
    counts = files.select("file_id").join(entity_change_counts(changes, commits), "file_id", "left").select("file_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("changes", "authors")))
    scaled = minmax_normalize(counts.withColumn("level", F.lit("file")), "level", "changes")
    pairs = change_coupling(changes, most_files)
    ends = pairs.select(F.col("file_a").alias("file_id"), "score").unionByName(pairs.select(F.col("file_b").alias("file_id"), "score"))
    coupling = ends.groupBy("file_id").agg(F.max("score").alias("coupling"))
    central = degree_centrality(edges, files.select(F.col("file_id").alias("node"))).select(F.col("node").alias("file_id"), "centrality")
    joined = scaled.join(central, "file_id").join(coupling, "file_id", "left").withColumn("coupling", F.coalesce("coupling", F.lit(0.0)))
    return joined.select("file_id", "changes", "authors", F.col("normalized").alias("change_score"), "centrality", "coupling", hotspot_score(F.col("normalized"), F.col("centrality"), F.col("coupling")).alias("hotspot"))


def file_dependencies(references: DataFrame) -> DataFrame:
    """(src, dst, weight, confidence, types): a row for each pair of files, from edges of several types. An
    import is certain, what is inferred is less so."""
    return references.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.max(F.when(F.col("type") == "IMPORTS", 1.0).otherwise(0.85)).alias("confidence"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def module_dependencies(file_edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src_module, dst_module, weight): the number of file pairs between two modules."""
    m = files.select("file_id", "module_id")
    joined = file_edges.select("src", "dst").distinct().join(m.select(F.col("file_id").alias("src"), F.col("module_id").alias("src_module")), "src").join(m.select(F.col("file_id").alias("dst"), F.col("module_id").alias("dst_module")), "dst")
    return joined.where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("weight"))


def accumulate_edges(rows: DataFrame, most_evidence: int = 20) -> DataFrame:
    """Rows (src, dst, type, weight, confidence, ordinal, evidence) by edge: summed weight, largest confidence,
    the first pieces of evidence; self-loops are dropped. An edge's evidence is cut before it is gathered."""
    w = Window.partitionBy("src", "dst", "type").orderBy("ordinal", "evidence")
    ranked = rows.where("src <> dst").withColumn("k", F.row_number().over(w))
    found = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most_evidence, F.struct("k", "evidence")))), lambda x: x["evidence"].cast("string")), ",")
    return ranked.groupBy("src", "dst", "type").agg(F.sum("weight").cast("long").alias("weight"), F.max("confidence").alias("confidence"), found.alias("evidence"))


def graph_metrics(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of averages, the number of edges, the largest degree and the size of the largest group of ties."""
    ties = metrics.groupBy((F.col("fan_in") + F.col("fan_out")).alias("d")).agg(F.count("*").alias("n")).agg(F.max("n"))
    return metrics.agg(F.count("*").alias("nodes"), F.round(F.avg("fan_in"), 3).alias("avg_fan_in"), F.round(F.avg("fan_out"), 3).alias("avg_fan_out"), F.round(F.avg("centrality"), 3).alias("avg_centrality"), F.max(F.col("fan_in") + F.col("fan_out")).alias("max_degree")).select("*", edges.agg(F.count("*")).scalar().alias("edges"), ties.scalar().alias("largest_tie"))


def graph_density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, edges, density): E / (N (N - 1)), 0 with fewer than two nodes."""
    n, e = nodes.agg(F.count("*")).scalar(), edges.select("src", "dst").distinct()
    return e.agg(F.count("*").alias("edges")).select(n.alias("nodes"), "edges").withColumn("density", F.round(ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), SCORE))
