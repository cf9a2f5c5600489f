"""Building the dependency graph: nodes, edges, call sites, base classes and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import scc_cycles

#: Words before a bracket that call nothing, and the patterns of calls and of what a class builds on.
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "new", "def", "class", "function", "sizeof", "typeof"]
CALL = r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
CLASS_BASES, EXTENDS, IMPLEMENTS = r"\bclass\s+\w+\s*\(([^)]+)\)", r"\bextends\s+([\w.$]+)", r"\bimplements\s+([\w.$,\s]+)"
#: Kinds of symbols that can have bases.
WITH_BASES = ["class", "interface", "trait", "struct"]
#: Top folders of which the next level makes the component.
WRAPPERS = ["src", "app", "lib"]


def external_name(module: Column) -> Column:
    """The package of a module that no file has: its first segment, or the first two of a scoped one; dots in front
    don't count."""
    plain = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("\\"), F.lit("/"))
    first = F.regexp_extract(plain, r"^[^/.]*", 0)
    return F.when(plain.startswith("@"), F.substring_index(plain, "/", 2)).otherwise(F.coalesce(F.nullif(first, F.lit("")), plain))


def graph_nodes(repository: str, files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(key, kind, name) of the repository, its modules, files and symbols, and of the packages of referenced names that
    no file has (external), each once. files (file_id, path, module), symbols (symbol_id, file_id, name), references (target)."""
    spark = files.sparkSession
    root = spark.createDataFrame([(f"repository:{repository}", "repository", repository)], "key string, kind string, name string")

    def nodes(rows: DataFrame, kind: str, key: Column, name: Column) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("key"), F.lit(kind).alias("kind"), name.alias("name"))

    unknown = references.select("target").distinct().join(files.select(F.col("path").alias("target")), "target", "left_anti")
    external = unknown.select(external_name(F.col("target")).alias("target")).distinct()
    return (
        root.unionByName(nodes(files.select("module").distinct(), "module", F.col("module"), F.col("module"))).unionByName(nodes(files, "file", F.col("file_id"), F.col("path")))
        .unionByName(nodes(symbols, "symbol", F.col("symbol_id"), F.col("name"))).unionByName(nodes(external, "external", F.col("target"), F.col("target")))
    )


def containment(repository: str, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind) of CONTAINS edges: repository to module, module to file, file to symbol."""
    at = {k: lambda c, k=k: F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k in ("module", "file", "symbol")}
    some = [
        files.select(F.lit(f"repository:{repository}").alias("src"), at["module"]("module").alias("dst")).distinct(),
        files.select(at["module"]("module").alias("src"), at["file"]("file_id").alias("dst")), symbols.select(at["file"]("file_id").alias("src"), at["symbol"]("symbol_id").alias("dst")),
    ]
    return some[0].unionByName(some[1]).unionByName(some[2]).withColumn("kind", F.lit("CONTAINS"))


def call_sites(bodies: DataFrame, least_place: int = 160) -> DataFrame:
    """(symbol, qualified, name, line) of the calls in bodies (symbol, name, first_line, body): names before a
    bracket, but for keywords and a symbol's own name near its beginning, which is its definition. Bodies are
    told by their symbol, which is unique. Lines come from the lengths and line ends of the pieces before a call, in
    running sums."""
    # one regular expression takes the body apart: what lies before each call, and the call; at last what comes after
    cut = F.regexp_extract_all("body", F.lit(rf"(?s)(.*?)(?:({CALL})|\z)"), F.lit(0))
    pieces = bodies.select("symbol", F.col("name").alias("own"), "first_line", F.posexplode(cut).alias("k", "piece"))
    lines = F.length("piece") - F.length(F.replace("piece", F.lit("\n")))
    before = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    call = F.regexp_extract("piece", rf"{CALL}\z", 0)
    rows = pieces.withColumn("m", call).withColumn("gap", F.length("piece") - F.length("m"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("gap"))
    rows = rows.withColumn("row", F.coalesce(F.sum(lines).over(before), F.lit(0)) + lines - (F.length("m") - F.length(F.replace("m", F.lit("\n")))))
    each = rows.select("symbol", "own", "first_line", F.struct(F.regexp_extract("m", CALL, 1).alias("q"), "at", "row").alias("x")).where("x.q <> ''")
    name = F.element_at(F.split("x.q", r"\."), -1)
    keep = ~name.isin(NOT_CALLS) & ~((name == F.col("own")) & (F.col("x.at") < least_place))
    return each.select("symbol", F.col("x.q").alias("qualified"), name.alias("name"), (F.col("first_line") + F.col("x.row")).cast("long").alias("line"), F.coalesce(keep, F.lit(True)).alias("keep")).where("keep").drop("keep")


def inheritance(symbols: DataFrame) -> DataFrame:
    """(symbol, base, kind) from the signatures of symbols (symbol, kind, signature): bases in a class's brackets or
    after extends, INHERITS; names after implements, IMPLEMENTS."""
    signature = F.coalesce("signature", F.lit(""))

    def names(pattern: str, kind: str, cut: str | None = None) -> Column:
        listed = F.split(F.regexp_extract(signature, pattern, 1), ",")
        trimmed = F.transform(listed, lambda n: F.trim(F.element_at(F.split(n, cut), 1) if cut else n))
        return F.transform(F.filter(trimmed, lambda n: n != ""), lambda n: F.struct(n.alias("base"), F.lit(kind).alias("kind")))

    found = F.concat(names(CLASS_BASES, "INHERITS", r"\["), names(EXTENDS, "INHERITS"), names(IMPLEMENTS, "IMPLEMENTS"))
    return symbols.where(F.col("kind").isin(WITH_BASES)).select("symbol", F.explode(found).alias("x")).select("symbol", "x.base", "x.kind")


def component_of(path: Column) -> Column:
    """The component of a path: its top folder, or the first two below a wrapping one; root for a lone file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "root").when(F.lower(parts[0]).isin(WRAPPERS) & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def module_of(path: Column) -> Column:
    """The module of a path: without its ending, or its folder for a package's own file; root where none is left."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.when(name.startswith("__init__."), F.coalesce(F.nullif(folder, F.lit("")), F.lit("root"))).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.lit("root")))


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, edges, weight) between different components of edges (src, dst, weight) by (node, component)."""
    a, b = (components.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst"))
    rows = edges.join(a, "src").join(b, "dst").where("c_src <> c_dst")
    return rows.groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def forbidden_cycles(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(src, dst, component): edges that are part of a cycle among the nodes of ``scope`` (node)."""
    inside = edges.join(scope.select(F.col("node").alias("src")), "src", "left_semi").join(scope.select(F.col("node").alias("dst")), "dst", "left_semi")
    of = scc_cycles(inside)
    a, b = (of.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("src", "dst"))
    return inside.join(a, "src").join(b, "dst").where("c_src = c_dst AND src <> dst").select("src", "dst", F.col("c_src").alias("component"))
