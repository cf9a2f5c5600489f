"""Contributors, knowledge, activity, volatility and ages of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LABEL, SCORE, elapsed_days, first_match


def repo_stats(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: commits, merges, authors, sums of lines, first and last time, distinct files."""
    c = commits.agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.countDistinct("author_id").alias("authors"), F.min("moment").alias("first_at"), F.max("moment").alias("last_at"))
    lines = changes.agg(F.coalesce(F.sum("additions"), F.lit(0)).alias("a"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("d"), F.countDistinct("file_id").alias("f"))
    return c.select("*", *(lines.select(x).scalar().alias(y) for x, y in (("a", "insertions"), ("d", "deletions"), ("f", "files"))))


def contributor_knowledge(changes: DataFrame, commits: DataFrame, as_of: Column) -> DataFrame:
    """(file_id, author_id, commits, lines, introduced, knowledge, share) without merges. Of a commit only the
    first change of a file counts for lines. Knowledge weighs commits, recency and having introduced the file,
    as a share of the file's sum."""
    order = Window.partitionBy("file_id", "commit_id").orderBy("change_order", "additions", "deletions")
    first = changes.withColumn("k", F.row_number().over(order)).where("k = 1").select("commit_id", "file_id", (F.col("additions") + F.col("deletions")).alias("lines"))
    joined = first.join(commits.where(~F.col("is_merge")).select("commit_id", "author_id", "moment"), "commit_id")
    per = joined.groupBy("file_id", "author_id").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"), F.max("moment").alias("last_at"), F.min(F.struct("moment", "commit_id")).alias("start"))
    w = Window.partitionBy("file_id")
    per = per.withColumn("introduced", (F.col("start") == F.min("start").over(w)).cast("int"))
    raw = 0.65 * F.col("commits") + 0.25 * F.exp(-elapsed_days(as_of, F.col("last_at")) / 365.0) + 0.10 * F.col("introduced")
    per = per.withColumn("raw", raw)
    return per.select("file_id", "author_id", "commits", "lines", "introduced", F.round(F.col("raw") / F.sum("raw").over(w), SCORE).alias("knowledge"), F.round(F.col("commits") / F.sum("commits").over(w), SCORE).alias("share"))


def contributors(changes: DataFrame, commits: DataFrame, authors: DataFrame) -> DataFrame:
    """(author_id, name, commits, files, first_at, last_at) of each author with a commit."""
    files = changes.select("commit_id", "file_id").distinct().join(commits.select("commit_id", "author_id"), "commit_id").groupBy("author_id").agg(F.countDistinct("file_id").alias("files"))
    per = commits.groupBy("author_id").agg(F.count("*").alias("commits"), F.min("moment").alias("first_at"), F.max("moment").alias("last_at"))
    return per.join(files, "author_id", "left").join(authors, "author_id").select("author_id", "name", "commits", F.coalesce("files", F.lit(0)).cast("long").alias("files"), "first_at", "last_at")


def knowledge_concentration(knowledge: DataFrame) -> DataFrame:
    """(file_id, people, top_share, entropy, label): entropy by the logarithm of the number of people."""
    p = F.col("knowledge")
    per = knowledge.groupBy("file_id").agg(F.count("*").alias("people"), F.max(p).alias("top"), F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("h"))
    entropy = F.when(F.col("people") <= 1, 0.0).otherwise(F.col("h") / F.ln(F.col("people")))
    label = F.when((F.col("top") >= 0.6) | (entropy < 0.45), "concentrated").otherwise("distributed")
    return per.select("file_id", "people", F.round("top", LABEL).alias("top_share"), F.round(entropy, LABEL).alias("entropy"), label.alias("label"))


def entity_activity(changes: DataFrame, commits: DataFrame, as_of: Column, rewrite: Column, gone: Column) -> DataFrame:
    """Activity of each file up to a time: changes, churn of all rows, counts of the last 30, 90 and 180 days,
    renames, rewrites (changes for which ``rewrite`` holds), people, age and idle days, and whether the last change
    deleted it (``gone``)."""
    rows = changes.join(commits.select("commit_id", "author_id", "moment"), "commit_id")
    order = F.struct("moment", "commit_id", "change_order", "additions", "deletions")
    lines = rows.groupBy("file_id").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.sum("additions").alias("added"), F.sum("deletions").alias("removed"), F.count_if(F.col("change_type") == "renamed").alias("renames"), F.count_if(rewrite).alias("rewrites"), F.max_by(gone, order).alias("deleted"))
    once = rows.select("file_id", "commit_id", "author_id", "moment").distinct()
    recent = [F.count_if(elapsed_days(as_of, F.col("moment")) <= n).alias(f"changes_{n}") for n in (30, 90, 180)]
    per = once.groupBy("file_id").agg(F.count("*").alias("changes"), *recent, F.countDistinct("author_id").alias("people"), elapsed_days(as_of, F.min("moment")).alias("age_days"), elapsed_days(as_of, F.max("moment")).alias("idle_days"))
    return per.join(lines, "file_id")


def volatility(activity: DataFrame) -> DataFrame:
    """(file_id, volatility, stability, label); the first rule that holds names the label. The weights,
    the bounds and the order of the rules."""
    r, t, p = F.least(F.col("changes_180") / 6, F.lit(1.0)), F.least(F.col("changes") / 12, F.lit(1.0)), F.least(F.col("people") / 5, F.lit(1.0))
    w = F.least(F.col("rewrites") / 3, F.lit(1.0))
    d = F.col("idle_days")
    scored = activity.withColumn("volatility", F.round(0.35 * r + 0.30 * t + 0.20 * w + 0.15 * p, LABEL))
    scored = scored.withColumn("stability", F.round(0.50 * d / (d + 180) + 0.30 / (1 + F.col("changes") / 4) + 0.20 * (1 - r), LABEL))
    recent, age, old = F.col("changes_180"), F.col("age_days"), F.col("age_days") >= 365
    cases = [
        (F.col("deleted"), "deleted"), ((F.col("rewrites") > 0) & (recent > 0), "recently_rewritten"), (old & (recent == 0) & (F.col("changes") <= 2), "stable_legacy"), (age < 90, "new_code"),
        (F.col("volatility") >= 0.65, "frequently_changed"), (old & (recent > 0), "long_lived_active"), (recent == 0, "recently_inactive"),
    ]
    return scored.select("file_id", "volatility", "stability", first_match(cases, "active").alias("label"))


def age_median(activity: DataFrame) -> DataFrame:
    return activity.agg(F.round(F.median("age_days"), 2).alias("median_age"), F.round(F.avg("age_days"), 2).alias("mean_age"), F.count("*").alias("files"))


def age_buckets(rows: DataFrame, days: str) -> DataFrame:
    d = F.col(days)
    return rows.groupBy(F.when(d < 90, "0_under_90").when(d < 365, "1_under_365").when(d < 1095, "2_under_1095").otherwise("3_older").alias("bucket")).agg(F.count("*").alias("n"))


def language_share(sources: DataFrame) -> DataFrame:
    """(language, files, lines, percent) by language; percent of all lines to one place."""
    per = sources.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))
    return per.withColumn("percent", F.round(100 * F.col("lines") / F.sum("lines").over(Window.partitionBy()), 1))


def code_stats(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count("*").alias("files"), F.countDistinct("module").alias("modules"), F.countDistinct("language").alias("languages"), F.sum("lines").cast("long").alias("lines"), F.count_if(F.col("lines") > 40).alias("large"), F.count_if(F.col("lines") <= 5).alias("tiny"))
