"""Resolution of names to symbols, and the dependency graph of source texts.

Symbols are indexed once under all scopes in which a name may be meant: its qualified name, its file, its folder and
the whole repository. A reference probes them all in one join, and the scopes decide in their order: the first one
in which exactly one symbol has the name gives the target; where none does, there is none. The commonest names are
looked up in the two widest scopes by every file, so these are dealt over tasks by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .build import call_sites, containment, external_name, inheritance

#: Scopes in the order in which they decide, with the confidence of what they find.
SCOPES = [("qualified_name", 0.98), ("same_file", 0.95), ("imported_symbol", 0.90), ("same_module", 0.82), ("unique_repository", 0.72)]
#: Fixed value: symbols of a name that are looked at, in the scopes that aren't a file's own.
MOST_CANDIDATES = 25
#: Tasks over which the lookups of a common name are dealt.
SALTS = 16


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _key(scope: str, *within: Column) -> Column:
    return F.concat_ws("\0", F.lit(scope), *within)


def name_index(symbols: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(scope, name, salt, n, symbol): for each scope and name how many symbols it has, at most 2, and the first of
    them. In the scopes of imports, folders and the repository only the first ``most`` + 1 of a name count."""
    placed = symbols.join(files.select("file", folder_of(F.col("path")).alias("folder")), "file")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("file", "symbol"))
    ranked = placed.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    file = F.col("file").cast("string")
    salts = F.array(*map(F.lit, range(SALTS)))
    one = F.array(F.lit(0))
    some = [
        placed.where("qualified IS NOT NULL").select(F.lit("q").alias("scope"), F.col("qualified").alias("name"), salts.alias("salts"), "symbol"),
        placed.select(_key("f", file).alias("scope"), "name", one.alias("salts"), "symbol"),
        ranked.select(_key("i", file).alias("scope"), "name", one.alias("salts"), "symbol"),
        ranked.select(_key("m", F.col("folder")).alias("scope"), "name", one.alias("salts"), "symbol"),
        # more than may be looked at count as several
        ranked.select(F.lit("r").alias("scope"), "name", salts.alias("salts"), "symbol"),
    ]
    rows = some[0]
    for s in some[1:]:
        rows = rows.unionByName(s)
    found = rows.groupBy("scope", "name").agg(F.first("salts").alias("salts"), F.least(F.count_distinct("symbol"), F.lit(2)).alias("n"), F.min("symbol").alias("target"))
    return found.select("scope", "name", F.explode("salts").alias("salt"), "n", "target")


def resolve_names(references: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The references (ref, file, name, qualified), unique in ref, that have a target, with target, tier, confidence.

    symbols (symbol, file, name, qualified), files (file, path), imports (file, target): the files that a file
    imports. A null qualified name is not looked up as such; null names have no target; repeated symbols and imports
    count once."""
    refs = references.select("ref", "file", "name", "qualified")
    at = files.select("file", folder_of(F.col("path")).alias("folder"))
    salt = F.pmod(F.xxhash64("ref"), F.lit(SALTS)).cast("int")
    file = F.col("file").cast("string")

    def probe(tier: int, scope: Column, name: str, salt: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), scope.alias("scope"), F.col(name).alias("name"), salt.alias("salt"))

    zero = F.lit(0)
    own = refs.join(at, "file").select("ref", F.explode(F.array(
        probe(0, F.lit("q"), "qualified", salt), probe(1, _key("f", file), "name", zero), probe(3, _key("m", F.col("folder")), "name", zero), probe(4, F.lit("r"), "name", salt),
    )).alias("p"))
    through = imports.select("file", "target").where("target IS NOT NULL").distinct()
    of_import = refs.join(through, "file").select("ref", probe(2, _key("i", F.col("target").cast("string")), "name", zero).alias("p"))
    probes = own.unionByName(of_import).select("ref", "p.*").where("name IS NOT NULL")
    hits = probes.join(name_index(symbols, files, most), ["scope", "name", "salt"])
    # imports are many scopes of one tier: one symbol must be left in all of them together
    per = hits.groupBy("ref", "tier").agg(F.sum("n").alias("n"), F.min("target").alias("target")).where("n = 1")
    first = per.groupBy("ref").agg(F.min(F.struct("tier", "target")).alias("x"))
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(c).alias("confidence")) for t, c in SCOPES))
    told = F.element_at(tiers, F.col("x.tier") + 1)
    return references.join(first.select("ref", F.col("x.target").alias("target"), told["tier"].alias("tier"), told["confidence"].alias("confidence")), "ref")


def gathered(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, confidence, resolution) of edges (src, dst, kind, confidence, resolution, line): equal
    ones count together with their largest confidence and the resolution of the first line; loops are left out."""
    kept = edges.where("src <> dst")
    return kept.groupBy("src", "dst", "kind").agg(F.count("*").cast("double").alias("weight"), F.max("confidence").alias("confidence"), F.min(F.struct("line", "resolution"))["resolution"].alias("resolution"))


def import_edges(imports: DataFrame) -> DataFrame:
    """Edges of imports (file, module, target): IMPORTS to a file, else IMPORTS_EXTERNAL to a package, none for a
    relative one that no file has."""
    src = F.concat(F.lit("file:"), F.col("file").cast("string"))
    dst = F.when(F.col("target").isNotNull(), F.concat(F.lit("file:"), F.col("target").cast("string"))).when(~F.col("module").startswith("."), F.concat(F.lit("external:"), external_name(F.col("module"))))
    kind = F.when(F.col("target").isNotNull(), "IMPORTS").otherwise("IMPORTS_EXTERNAL")
    return imports.select(src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("resolution"), F.lit(0).cast("long").alias("line")).where("dst IS NOT NULL")


def symbol_references(symbols: DataFrame) -> DataFrame:
    """(ref, symbol, file, name, qualified, kind, line) of the calls and bases in symbols (symbol, file, name, kind,
    first_line, signature, body)."""
    calls = call_sites(symbols.select("symbol", "name", "first_line", "body")).select("symbol", "qualified", "name", F.lit("CALLS").alias("kind"), "line")
    bases = inheritance(symbols.select("symbol", "kind", "signature")).select("symbol", F.col("base").alias("qualified"), F.element_at(F.split("base", r"\."), -1).alias("name"), "kind")
    at = symbols.select("symbol", "file", F.col("first_line").cast("long").alias("first_line"))
    rows = calls.join(at.select("symbol", "file"), "symbol").unionByName(bases.join(at, "symbol").withColumnRenamed("first_line", "line"))
    return rows.withColumn("ref", F.sha2(F.concat_ws("\0", F.col("symbol").cast("string"), "kind", "qualified", F.col("line").cast("string")), 256))


def graph_edges(repository: str, files: DataFrame, symbols: DataFrame, imports: DataFrame, links: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """(src, dst, kind, weight, confidence, resolution): the graph of files (file, path, module), their symbols (symbol,
    file, name, qualified, kind, first_line, signature, body), imports (file, module, target) and links (file, target,
    line) to local paths: CONTAINS, IMPORTS, IMPORTS_EXTERNAL, REFERENCES, CALLS, INHERITS, IMPLEMENTS and, from
    these, DEPENDS_ON between files and modules."""
    refs = symbol_references(symbols)
    each = refs.groupBy("ref").agg(F.first("symbol").alias("symbol"), F.first("file").alias("file"), F.first("name").alias("name"), F.first("qualified").alias("qualified"), F.first("kind").alias("kind"), F.first("line").alias("line"), F.count("*").alias("times"))
    found = resolve_names(each, symbols, files, imports, most)
    at = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    told = found.select(at("symbol", "symbol").alias("src"), at("symbol", "target").alias("dst"), "kind", "confidence", F.col("tier").alias("resolution"), "line", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_t")).drop("_t")
    static = told.unionByName(import_edges(imports))
    if links is not None:
        static = static.unionByName(links.select(at("file", "file").alias("src"), at("file", "target").alias("dst"), F.lit("REFERENCES").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("exact_local_path").alias("resolution"), F.col("line").cast("long").alias("line")))
    own = gathered(static)
    held = containment(repository, files.select(F.col("file").alias("file_id"), "path", "module"), symbols.select(F.col("symbol").alias("symbol_id"), F.col("file").alias("file_id")))
    held = held.select("src", "dst", "kind", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("resolution"))
    # of which file each end is
    ends = files.select(at("file", "file").alias("node"), F.col("file").alias("of")).unionByName(symbols.select(at("symbol", "symbol").alias("node"), F.col("file").alias("of")))
    a, b = (ends.select(F.col("node").alias(end), F.col("of").alias(f"{end}_file")) for end in ("src", "dst"))
    across = own.join(a, "src").join(b, "dst").where("src_file <> dst_file")
    support = across.groupBy("src_file", "dst_file").agg(F.count("*").cast("double").alias("weight"), F.max(F.when(F.col("kind") == "IMPORTS", 1.0).otherwise(0.85)).alias("confidence"))
    of_files = support.select(at("file", "src_file").alias("src"), at("file", "dst_file").alias("dst"), F.lit("DEPENDS_ON").alias("kind"), "weight", "confidence", F.lit("aggregate").alias("resolution"))
    m, n = (files.select(F.col("file").alias(f"{end}_file"), F.col("module").alias(f"{end}_module")) for end in ("src", "dst"))
    modules = support.join(m, "src_file").join(n, "dst_file").where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count("*").cast("double").alias("weight"))
    of_modules = modules.select(at("module", "src_module").alias("src"), at("module", "dst_module").alias("dst"), F.lit("DEPENDS_ON").alias("kind"), "weight", F.lit(1.0).alias("confidence"), F.lit("aggregate").alias("resolution"))
    return held.unionByName(own).unionByName(of_files).unionByName(of_modules)
