"""The stored tables seen as change history.

Orders are commits, their lines are file changes, suppliers are files (nations their modules), parts are files
of a finer grain, customers are authors, and events are the states of long-lived entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch


class History:
    """The views over one folder of tables; each reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def commits(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author_id"), epoch("o_orderdate").alias("moment"), (F.col("o_orderstatus") == "P").alias("is_merge"), F.col("o_orderpriority").alias("message"))

    def changes(self) -> DataFrame:
        kind = F.create_map(F.lit("A"), F.lit("added"), F.lit("N"), F.lit("modified"), F.lit("R"), F.lit("renamed"))
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("change_order"),
            F.col("l_quantity").cast("long").alias("additions"), F.round(F.col("l_discount") * 100).cast("long").alias("deletions"), kind[F.col("l_returnflag")].alias("change_type"),
        )

    def authors(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"))

    def files(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("module_id"))

    def sources(self) -> DataFrame:
        """Files of the finer grain, with module, language and lines."""
        return self.table("part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("module"), F.col("p_type").alias("language"), F.col("p_size").alias("lines"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))

    def file_references(self) -> DataFrame:
        """Static references between files, a row for each line that makes one."""
        n = self.table("supplier").agg(F.max("s_suppkey").alias("n"))
        kind = F.create_map(F.lit("A"), F.lit("IMPORTS"), F.lit("N"), F.lit("CALLS"), F.lit("R"), F.lit("REFERENCES"))
        rows = self.table("lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
        return rows.select(F.col("l_suppkey").alias("src"), (1 + F.col("l_partkey") % n.scalar()).alias("dst"), kind[F.col("l_returnflag")].alias("type")).where("src <> dst")

    def module_lines(self) -> DataFrame:
        """A row for each line between two modules: of the file's nation and of the author's."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customer = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
        return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).where("src <> dst").select("src", "dst", "o_orderdate")

    def module_edges(self) -> DataFrame:
        """Edges (src, dst, weight) of the pairs of modules with more lines than chance would give: more than the
        product of the lines that leave the one and of those that reach the other, by all lines. As the bound is
        relative, the graph keeps about its shape at every size."""
        return above_chance(self.module_lines().groupBy("src", "dst").agg(F.count("*").alias("weight"))).select("src", "dst", "weight")

    def snapshots(self) -> DataFrame:
        """Edges (snapshot, src, dst, weight) of such a graph for each quarter; quarters count from year 0."""
        quarter = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
        counted = self.module_lines().groupBy(quarter.cast("long").alias("snapshot"), "src", "dst").agg(F.count("*").alias("weight"))
        return above_chance(counted, "snapshot").select("snapshot", "src", "dst", "weight")

    def versions(self) -> DataFrame:
        """States of entities in order of (at, version_id); kind is introduced, deleted or changed."""
        kind = F.when(F.col("event_type") == "signup", "introduced").when(F.col("event_type") == "error", "deleted").otherwise("changed")
        return self.table("events").select(F.col("user_id").alias("lineage"), F.col("event_id").alias("version_id"), epoch("ts").alias("moment"), F.col("event_type").alias("name"), kind.alias("kind"), "value", "props")


def above_chance(edges: DataFrame, *of: str) -> DataFrame:
    """Edges heavier than their ends' weights would have it. Edges are counts of pairs of modules, which are few
    beside the lines they count."""
    by = lambda *x: Window.partitionBy(*of, *x)
    weight = F.col("weight")
    sums = edges.withColumn("_out", F.sum(weight).over(by("src"))).withColumn("_in", F.sum(weight).over(by("dst"))).withColumn("_all", F.sum(weight).over(by()))
    return sums.where(weight * F.col("_all") > F.col("_out") * F.col("_in"))


#: The same views in SQL.
SQL = {
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS moment, o_orderstatus = 'P' AS is_merge, o_orderpriority AS message FROM orders)",
    "changes": "changes AS (SELECT l_orderkey AS commit_id, l_suppkey AS file_id, l_partkey AS part_id, l_linenumber AS change_order, CAST(l_quantity AS BIGINT) AS additions, CAST(round(l_discount * 100) AS BIGINT) AS deletions, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' WHEN 'R' THEN 'renamed' END AS change_type FROM lineitem)",
    "files": "files AS (SELECT s_suppkey AS file_id, s_name AS name, s_nationkey AS module_id FROM supplier)",
    "sources": "sources AS (SELECT p_partkey AS file_id, p_brand AS module, p_type AS language, p_size AS lines, p_brand || '/' || p_type || '/' || p_partkey AS path FROM part)",
    "refs": "refs AS (SELECT * FROM (SELECT l_suppkey AS src, 1 + l_partkey % (SELECT max(s_suppkey) FROM supplier) AS dst, CASE l_returnflag WHEN 'A' THEN 'IMPORTS' WHEN 'N' THEN 'CALLS' WHEN 'R' THEN 'REFERENCES' END AS type FROM lineitem) WHERE src <> dst)",
    "lines": "lines AS (SELECT s_nationkey AS src, c_nationkey AS dst, o_orderdate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)",
    "edges": "edges AS (SELECT src, dst, weight FROM (SELECT src, dst, count(*) AS weight FROM lines GROUP BY 1, 2) QUALIFY weight * sum(weight) OVER () > sum(weight) OVER (PARTITION BY src) * sum(weight) OVER (PARTITION BY dst))",
    "snaps": "snaps AS (SELECT snapshot, src, dst, weight FROM (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS snapshot, src, dst, count(*) AS weight FROM lines GROUP BY 1, 2, 3) QUALIFY weight * sum(weight) OVER (PARTITION BY snapshot) > sum(weight) OVER (PARTITION BY snapshot, src) * sum(weight) OVER (PARTITION BY snapshot, dst))",
    "versions": "versions AS (SELECT user_id AS lineage, event_id AS version_id, CAST(floor(epoch(ts)) AS BIGINT) AS moment, event_type AS name, CASE event_type WHEN 'signup' THEN 'introduced' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS kind, value, props FROM events)",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the named views before its own."""
    joined = ", ".join(SQL[n] for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
