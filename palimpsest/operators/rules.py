"""Architecture rules whose ends are chosen by selectors: layer, component, module or path prefix.

A node lies under keys for all selectors that could choose it, its path's prefixes among them, so that rules meet
nodes by equal keys and no rule is tried on every node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import scc_cycles


def selected(nodes: DataFrame, selectors: DataFrame, least: float = 0.8) -> DataFrame:
    """(rule, node) of selectors (rule, kind, value) over nodes (node, node_type, path, layer, confidence): layers of
    nodes that are sure enough, components and modules by their whole path, prefixes by a path's folders or itself.
    Case and a slash at the end of a prefix don't count; an unknown kind and an empty value choose nothing."""
    path = F.lower("path")
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(parts, 1, i), "/").alias("value")))
    one = lambda kind, value, holds: F.array(F.struct(F.lit(kind).alias("kind"), F.when(holds, value).alias("value")))
    own = F.concat(
        one("layer", F.lower("layer"), F.col("confidence") >= least), one("component", path, F.col("node_type") == "component"), one("module", path, F.col("node_type") == "module"),
        F.coalesce(above, F.array().cast("array<struct<kind:string,value:string>>")),
    )
    keys = nodes.select("node", F.explode(own).alias("k")).select("node", "k.kind", "k.value").where("value <> ''")
    value = F.lower(F.trim("value"))
    wanted = selectors.select("rule", "kind", F.when(F.col("kind") == "prefix", F.rtrim(value, F.lit("/"))).otherwise(value).alias("value"))
    return wanted.join(keys, ["kind", "value"]).select("rule", "node").distinct()


def broken_rules(edges: DataFrame, nodes: DataFrame, rules: DataFrame, least: float = 0.8) -> DataFrame:
    """(rule, src, dst, confidence) of rules (rule, kind, source_kind, source, target_kind, target). forbidden and allowed
    are about edges (src, dst, confidence) between modules from a node that the source selects: to one that the
    target selects, or to one that it doesn't. A forbidden_cycle is a cycle with a node that the source selects: the
    first of these and a digest of the cycle's members. What isn't sure by ``least`` doesn't count."""
    nodes = nodes.withColumn("sure", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence")))
    sources = selected(nodes, rules.select("rule", F.col("source_kind").alias("kind"), F.col("source").alias("value")), least)
    targets = selected(nodes, rules.select("rule", F.col("target_kind").alias("kind"), F.col("target").alias("value")), least)
    a, b = (nodes.where("node_type = 'module'").select(F.col("node").alias(end), F.col("sure").alias(f"{end}_sure")) for end in ("src", "dst"))
    known = edges.where(F.col("confidence") >= least).join(a, "src").join(b, "dst").select("src", "dst", F.least("confidence", "src_sure", "dst_sure").alias("confidence"))
    from_source = known.join(sources.select("rule", F.col("node").alias("src")), "src").join(rules.select("rule", F.col("kind").alias("rule_kind")), "rule")
    to_target = targets.select("rule", F.col("node").alias("dst"), F.lit(True).alias("hit"))
    told = from_source.join(to_target, ["rule", "dst"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    broken = told.where(((F.col("rule_kind") == "forbidden") & F.col("hit")) | ((F.col("rule_kind") == "allowed") & ~F.col("hit"))).select("rule", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "confidence")
    on = scc_cycles(edges.select("src", "dst"))
    members = F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), "\0")
    cycles = on.groupBy("component").agg(F.sha2(members, 256).alias("cycle"), F.count("*").alias("n")).where("n > 1").select("component", "cycle")
    chosen = sources.join(rules.where("kind = 'forbidden_cycle'").select("rule"), "rule", "left_semi").join(on, "node").join(nodes.select("node", "sure"), "node")
    cyclic = chosen.groupBy("rule", "component").agg(F.min("node").cast("string").alias("src"), F.min("sure").alias("confidence")).join(cycles, "component")
    return broken.unionByName(cyclic.select("rule", "src", F.col("cycle").alias("dst"), "confidence"))
