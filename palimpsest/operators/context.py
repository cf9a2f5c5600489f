"""Pull requests, issues and commits in context; lineages read whole; timelines and dossiers.

Nested lists are collected by the entity they belong to (a request's comments, a lineage's versions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCORE


def listed(*order: str, values: Column) -> Column:
    """Values of a group, joined by commas in the order of some columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, values.cast("string").alias("value")))), lambda x: x["value"]), ",")


def request_list(requests: DataFrame, comments: DataFrame, links: DataFrame) -> DataFrame:
    """(request, title, comments, people, commits, last_turn) of requests (request, title) with their comments
    (request, turn, role) and commits (request, commit_id)."""
    said = comments.groupBy("request").agg(F.count("*").alias("comments"), F.countDistinct("role").alias("people"), F.max("turn").alias("last_turn"))
    done = links.groupBy("request").agg(F.countDistinct("commit_id").alias("commits"))
    rows = requests.join(said, "request", "left").join(done, "request", "left")
    return rows.select("request", "title", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("comments", "people", "commits")), "last_turn")


def request_detail(comments: DataFrame, links: DataFrame, commits: DataFrame) -> DataFrame:
    """(request, roles, commits): who said what in turn, and the commits by time."""
    said = comments.groupBy("request").agg(listed("turn", values=F.concat_ws(":", F.col("turn").cast("string"), "role")).alias("roles"))
    done = links.join(commits.select("commit_id", "moment"), "commit_id").groupBy("request").agg(listed("moment", "commit_id", values=F.col("commit_id")).alias("commits"))
    return said.join(done, "request", "left").select("request", "roles", F.coalesce("commits", F.lit("")).alias("commits"))


def commit_context(commits: DataFrame, links: DataFrame, of_commit: DataFrame, of_request: DataFrame) -> DataFrame:
    """(commit_id, requests, issues): the requests (request, commit_id) of each commit, and the issues that it
    (commit_id, issue) or one of its requests (request, issue) refers to, each once."""
    both = of_commit.select("commit_id", "issue").unionByName(links.join(of_request, "request").select("commit_id", "issue")).distinct()
    issues = both.groupBy("commit_id").agg(listed("issue", values=F.col("issue")).alias("issues"))
    asked = links.select("commit_id", "request").distinct().groupBy("commit_id").agg(listed("request", values=F.col("request")).alias("requests"))
    rows = commits.select("commit_id").join(asked, "commit_id", "left").join(issues, "commit_id", "left")
    return rows.select("commit_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("requests", "issues")))


def index_status(rows: DataFrame) -> DataFrame:
    """(key, status, stale, share) of index rows (key, state, indexed_sha, head_sha, done, wanted)."""
    stale = F.col("indexed_sha").isNotNull() & ~F.col("indexed_sha").eqNullSafe(F.col("head_sha"))
    status = F.when(F.col("state").isNull(), "missing").when(F.col("state").isin("failed", "running"), F.col("state")).when(stale, "stale").otherwise("ready")
    return rows.select("key", status.alias("status"), stale.alias("stale"), F.round(F.when(F.col("wanted") > 0, F.col("done") / F.col("wanted")).otherwise(0.0), SCORE).alias("share"))


def node_counts(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, requests): distinct neighbours each way and distinct requests (node, request)."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    asked = links.groupBy("node").agg(F.countDistinct("request").alias("requests"))
    rows = nodes.select("node").join(into, "node", "left").join(out, "node", "left").join(asked, "node", "left")
    return rows.select("node", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "requests")))


def state_counters(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def entity_contributors(knowledge: DataFrame, entity: str, concentration: DataFrame) -> DataFrame:
    """Contributors of each entity in order of their knowledge, with the entity's label: (entity, place, author_id,
    knowledge, label)."""
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("knowledge"), "author_id"))
    return knowledge.select(entity, place.cast("long").alias("place"), "author_id", "knowledge").join(concentration.select(entity, "label"), entity)


def resolve_entity(asked: DataFrame, files: DataFrame, symbols: DataFrame, lineages: DataFrame) -> DataFrame:
    """(ask, kind, entity) of rows (ask, file, symbol, lineage) that name exactly one of the three: kind error where
    they name none or several, missing where there is no such entity."""
    n = sum((F.col(c).isNotNull().cast("int") for c in ("symbol", "lineage")), F.col("file").isNotNull().cast("int"))
    rows = asked.withColumn("n", n)
    for kind, table in (("file", files), ("symbol", symbols), ("lineage", lineages)):
        rows = rows.join(table.select(F.col(kind), F.col(kind).cast("string").alias(f"_{kind}")).distinct(), kind, "left")
    entity = F.coalesce("_file", "_symbol", "_lineage")
    kind = F.when(F.col("n") != 1, "error").when(entity.isNull(), "missing").when(F.col("file").isNotNull(), "file").when(F.col("symbol").isNotNull(), "symbol").otherwise("lineage")
    return rows.select("ask", kind.alias("kind"), F.when(kind.isin("file", "symbol", "lineage"), entity).alias("entity"))


def lineage_read(versions: DataFrame, events: DataFrame) -> DataFrame:
    """(lineage, label, names, versions, events, introduced, last_seen, deleted) of versions (lineage, version_id,
    moment, name, kind) and events (lineage, version_id, event). The label is the last name; a lineage is deleted
    if its last version is."""
    order = F.struct("moment", "version_id")
    per = versions.groupBy("lineage").agg(F.count("*").alias("versions"), F.max_by("name", order).alias("label"), F.min("moment").alias("introduced"), F.max("moment").alias("last_seen"), (F.max_by("kind", order) == "deleted").alias("deleted"))
    first = versions.groupBy("lineage", "name").agg(F.min(order).alias("k")).groupBy("lineage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ",").alias("names"))
    happened = events.groupBy("lineage").agg(F.count("*").alias("events"))
    return per.join(first, "lineage").join(happened, "lineage", "left").select("lineage", "label", "names", "versions", F.coalesce("events", F.lit(0)).cast("long").alias("events"), "introduced", "last_seen", "deleted")


def file_history(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_id, place, commit_id, change_type, lines, authors_so_far): a file's changes by time with the number of
    people who had changed it by then."""
    rows = changes.join(commits.select("commit_id", "author_id", "moment"), "commit_id")
    w = Window.partitionBy("file_id").orderBy("moment", "commit_id", "change_order", "additions", "deletions", "change_type")
    first = F.row_number().over(Window.partitionBy("file_id", "author_id").orderBy("moment", "commit_id", "change_order", "additions", "deletions", "change_type")) == 1
    marked = rows.withColumn("first", first.cast("int"))
    return marked.select("file_id", F.row_number().over(w).cast("long").alias("place"), "commit_id", "change_type", (F.col("additions") + F.col("deletions")).alias("lines"), F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("authors_so_far"))


def provenance(*parts: DataFrame) -> DataFrame:
    """(entity, moment, kind, ref, place): what happened to an entity, of several tables (entity, moment, kind, ref),
    by time."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("moment", "kind", "ref")).cast("long"))


def dossier(activity: DataFrame, scores: DataFrame, counts: DataFrame, contributors: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row for each file: activity, scores, counts, the first three contributors and the last thing that happened."""
    top = contributors.where("place <= 3").groupBy("file_id").agg(listed("place", values=F.col("author_id")).alias("top_people"))
    last = timeline.groupBy(F.col("entity").alias("file_id")).agg(F.max_by("kind", F.struct("moment", "kind", "ref")).alias("last_kind"), F.count("*").alias("happened"))
    rows = activity.select("file_id", "changes", "churn", "age_days", "rewrites").join(scores, "file_id").join(counts.withColumnRenamed("node", "file_id"), "file_id", "left").join(top, "file_id", "left").join(last, "file_id", "left")
    return rows.select("file_id", "changes", "churn", "age_days", "rewrites", "volatility", "stability", "label", "fan_in", "fan_out", "requests", "top_people", "last_kind", "happened")


def link_symbols(symbols: DataFrame, lineages: DataFrame) -> DataFrame:
    """(symbol, lineage): current symbols (symbol, path, kind, qualified) tied to the living lineage (lineage, path,
    kind, qualified, deleted) of the same three, where there is just one."""
    key = ["path", "kind", "qualified"]
    alive = lineages.where(~F.col("deleted")).groupBy(*key).agg(F.count("*").alias("n"), F.min("lineage").alias("lineage")).where("n = 1")
    return symbols.join(alive, key).select("symbol", "lineage")


def baseline_changes(rows: DataFrame) -> DataFrame:
    """(lineage, version_id, event) to write for a history that begins in the middle: for a lineage whose first
    version isn't an introduction, a baseline event before its others."""
    first = rows.groupBy("lineage").agg(F.min_by(F.struct("version_id", "kind"), F.struct("moment", "version_id")).alias("x")).select("lineage", "x.version_id", "x.kind")
    return first.where("kind <> 'introduced'").select("lineage", "version_id", F.lit("baseline").alias("event"))
