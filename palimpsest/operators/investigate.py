"""Search for the change that brought a defect, resolution of names, and issue references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LABEL

#: Weights of signals.
SIGNALS = {"blame": 0.45, "symbol": 0.25, "file": 0.15, "range": 0.10, "text": 0.05}


def candidate_ranking(signals: DataFrame, commits: DataFrame, k: int) -> DataFrame:
    """(place, commit_id, score, label) of rows (commit_id, signal): each signal counts once; merges and changes
    of very many files count less. Of equal scores the older commit comes first."""
    weigh = sum((F.max(F.when(F.col("signal") == s, w).otherwise(0.0)) for s, w in list(SIGNALS.items())[1:]), F.max(F.when(F.col("signal") == "blame", SIGNALS["blame"]).otherwise(0.0)))
    rows = signals.groupBy("commit_id").agg(weigh.alias("raw")).join(commits, "commit_id")
    raw = F.col("raw") * F.when(F.col("is_merge") | (F.col("files_changed") > 100), 0.6).otherwise(1.0)
    rows = rows.select("commit_id", "moment", F.round(raw, 9).alias("raw"))
    label = F.when(F.col("raw") >= 0.7, "strong").when(F.col("raw") >= 0.4, "moderate").otherwise("weak")
    top = rows.orderBy(F.desc("raw"), "moment", "commit_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("raw"), "moment", "commit_id"))
    return top.select(place.alias("place"), "commit_id", F.round(F.least("raw", F.lit(1.0)), LABEL).alias("score"), label.alias("label"))


def szz_score(blamed: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_id, lines, score, label) of blamed lines (commit_id)."""
    per = blamed.groupBy("commit_id").agg(F.count("*").alias("lines"))
    most = per.agg(F.max("lines")).scalar()
    score = F.least(F.lit(1.0), 0.75 + 0.25 * F.col("lines") / most) * F.when(F.col("is_merge") | (F.col("files_changed") > 100), 0.55).otherwise(1.0)
    return per.join(commits, "commit_id").select("commit_id", "lines", F.round(score, LABEL).alias("score"), F.when(F.round(score, LABEL) >= 0.8, "strong").otherwise("moderate").alias("label"))


def szz_analysis(fixed: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_id, lines, score, label): the commits that last wrote (file_id, line, origin) what fixes (commit_id,
    file_id, line) changed, but for the fixes themselves."""
    met = fixed.join(blame, ["file_id", "line"]).where("commit_id <> origin")
    return szz_score(met.select(F.col("origin").alias("commit_id")), commits)


def investigation_report(signals: DataFrame, commits: DataFrame, authors: DataFrame, modules: DataFrame, k: int) -> DataFrame:
    """(place, commit_id, score, label, reasons, author, modules): the best candidates with the signals that speak
    for them, their author and the number of modules that they touch."""
    why = signals.groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("reasons"))
    ranked = candidate_ranking(signals, commits, k)
    return ranked.join(why, "commit_id").join(authors, "commit_id").join(modules, "commit_id", "left").select("place", "commit_id", "score", "label", "reasons", "author", F.coalesce("modules", F.lit(0)).cast("long").alias("modules"))


def bisect_midpoint(commits: DataFrame, by: str) -> DataFrame:
    """The commit in the middle, (n - 1) // 2, of each range in order of time."""
    w = Window.partitionBy(by)
    k = F.row_number().over(w.orderBy("moment", "commit_id")) - 1
    return commits.withColumn("k", k).withColumn("n", F.count("*").over(w)).where(F.col("k") == F.floor((F.col("n") - 1) / 2)).select(by, "commit_id", "n")


def bisect_step(left: Column, tested: Column, verdict: Column) -> Column:
    """What is left of an array of commits: after a good one, up to and with a bad one, without an unknown one."""
    at = F.array_position(left, tested).cast("int")
    return F.when(verdict == "good", F.slice(left, at + 1, F.greatest(F.size(left) - at, F.lit(0)))).when(verdict == "bad", F.slice(left, 1, at)).otherwise(F.array_remove(left, tested))


def interval_join(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(file_id, line, symbol) of points (file_id, line): the tightest interval (file_id, symbol, first, last)
    that holds it. Joined by file and bin of the interval's width class, so that wide intervals make few rows."""
    width = F.greatest(F.ceil(F.log2(F.col("last") - F.col("first") + 1.0)), F.lit(0)).cast("int")
    placed = intervals.withColumn("c", width)
    classes = placed.select("file_id", "c").distinct()
    bins = placed.withColumn("b", F.floor(F.col("first") / F.pow(F.lit(2.0), F.col("c"))).cast("long"))
    near = bins.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    asked = points.join(classes, "file_id").withColumn("b", F.floor(F.col("line") / F.pow(F.lit(2.0), F.col("c"))).cast("long"))
    hit = asked.join(near, ["file_id", "c", "b"]).where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")))
    return hit.groupBy("file_id", "line").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("w"), "symbol")).alias("x")).select("file_id", "line", "x.symbol")


#: Confidence of each tier of name resolution.
TIERS = [("qualified", 0.98), ("same_file", 0.95), ("imported", 0.90), ("same_module", 0.82), ("unique", 0.72)]


def resolve_references(candidates: DataFrame) -> DataFrame:
    """(ref, target, tier, confidence) of rows (ref, symbol, tier): the first tier with exactly one symbol."""
    per = candidates.groupBy("ref", "tier").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1")
    order = F.create_map(*(x for i, (t, _) in enumerate(TIERS) for x in (F.lit(t), F.lit(i))))
    sure = F.create_map(*(x for t, c in TIERS for x in (F.lit(t), F.lit(c))))
    best = per.groupBy("ref").agg(F.min(F.struct(order[F.col("tier")].alias("k"), "tier", "symbol")).alias("x"))
    return best.select("ref", F.col("x.symbol").alias("target"), F.col("x.tier").alias("tier"), sure[F.col("x.tier")].alias("confidence"))


def resolve_suffix(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file_id, how): a path given in full, or the only file that ends so, or the only one of that file
    name, or ambiguous. Files are indexed by all their suffixes."""
    parts = F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    index = files.select("file_id", F.explode(suffix).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("file_id").alias("f"))
    exact = files.select(F.col("path").alias("name"), F.col("file_id").alias("e"))
    base = files.select(F.element_at(parts, -1).alias("base"), "file_id").groupBy("base").agg(F.count("*").alias("nb"), F.min("file_id").alias("fb"))
    rows = names.join(exact, "name", "left").join(index, "name", "left").withColumn("base", F.element_at(F.split("name", "/"), -1)).join(base, "base", "left")
    how = F.when(F.col("e").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("nb") == 1, "filename").when(F.col("nb") > 1, "ambiguous").otherwise("missing")
    return rows.withColumn("how", how).select("name", F.when(F.col("how") == "exact", F.col("e")).when(F.col("how") == "suffix", F.col("f")).when(F.col("how") == "filename", F.col("fb")).alias("file_id"), "how")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, file_id) of imports (import_id, candidates): the first candidate path that exists."""
    each = imports.select("import_id", F.posexplode("candidates").alias("pos", "path"))
    return each.join(files.select("path", "file_id"), "path").groupBy("import_id").agg(F.min_by("file_id", "pos").alias("file_id"))


def issue_references(texts: DataFrame) -> DataFrame:
    """(id, owner_repo, number, kind, confidence): #n with an optional verb and repository before it."""
    pattern = r"(?i)(?:\b(fix(?:e[sd])?|close[sd]?|resolve[sd]?|refs?|see)\b:?\s+)?(?:([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+))?#([1-9][0-9]*)\b"
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = texts.select("id", F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "vrn", strict=True)))).alias("x"))
    verb = F.lower("x.v")
    kind = F.when(verb.startswith("fix"), "fixes").when(verb.startswith("clos"), "closes").when(verb.startswith("resolv"), "resolves").otherwise("mentions")
    return rows.select("id", F.lower("x.r").alias("owner_repo"), F.col("x.n").cast("long").alias("number"), kind.alias("kind"), F.when(kind == "mentions", 0.55).otherwise(0.98).alias("confidence")).distinct()


def status_normalize(rows: DataFrame) -> DataFrame:
    """(key, status) of rows (key, state, indexed_sha, head_sha)."""
    stale = ~F.col("indexed_sha").eqNullSafe(F.col("head_sha"))
    return rows.select("key", F.when(F.col("state").isNull(), "missing").when(F.col("state") == "failed", "failed").when(F.col("state") == "running", "running").when(stale, "stale").otherwise("ready").alias("status"))


def parse_status(files: DataFrame, most_bytes: int) -> DataFrame:
    """(file_id, status) of files (file_id, path, size_bytes, is_binary, supported): the first of excluded, too
    large, binary and unsupported, else parsed."""
    s = F.when(F.col("path").rlike(r"(^|/)(node_modules|vendor|dist|build)/"), "excluded").when(F.col("size_bytes") > most_bytes, "too_large").when(F.col("is_binary"), "binary").when(~F.col("supported"), "unsupported").otherwise("parsed")
    return files.select("file_id", s.alias("status"))
