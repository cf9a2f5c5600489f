"""Evidence documents, what a question is about, and direct retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCORE, first_match
from .retrieval import redacted

#: Kinds of evidence in order of priority.
KINDS = ["commit", "symbol_change", "pull_request", "issue", "pr_comment", "issue_comment", "file_current"]
#: Scores of direct evidence of a lineage by kind, and of others.
OF_LINEAGE = {"symbol_change": 0.99, "symbol_current": 0.98, "symbol_version": 0.97}
OTHER_OF_LINEAGE, OF_REQUEST, OF_ISSUE, OF_FILE, ELSE = 0.95, 0.94, 0.93, 0.78, 0.70
OF_COMMIT = {"commit": 0.96, "commit_diff": 0.95}
OTHER_OF_COMMIT = 0.90
SELECTED, INTRODUCTION = 1.00, 0.01
#: How many of the newest documents of a lineage, request, issue, commit and file are looked at, and of
#: which kinds those of a commit are.
LOOKED_AT = {"lineage": 30, "commit_id": 30, "request": 30, "issue": 30, "file": 20}
KINDS_OF_COMMIT = ["commit", "commit_diff", "pull_request", "review_comment", "pr_comment", "issue_comment"]
#: How a question names requests, issues, commits and code, and words of it that name nothing.
REQUEST, ISSUE, SHA, WORD = r"(?i)(?:\bpr\b|pull request)\s*#?(\d+)", r"(?i)\bissue\s*#?(\d+)", r"(?i)\b[0-9a-f]{7,40}\b", r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
IGNORED = ["what", "which", "where", "when", "does", "this", "that", "explain", "why"]
#: What a question asks, by what its text holds, in the order in which they are tried.
INTENTS = [
    ("introduction", ["introduced", "first added", "who added", "when was"]),
    ("impact", ["impact", "depends on", "dependent", "caller", "hotspot"]),
    ("architecture", ["architecture", "role of", "module", "component"]),
    ("history", ["history", "changed", "rename", "moved", "evolution"]),
    ("dependency", ["dependency", "imports", "calls", "uses"]),
    ("why", ["why", "reason", "exist"]),
]


def document(rows: DataFrame, kind: str, key: Column, title: Column, content: Column, moment: Column, **refs: Column) -> DataFrame:
    """Evidence documents (key, kind, title, content, moment, commit_id, file, lineage, request, issue, hash) of rows:
    content without NUL and secrets, at most 20,000 characters; hash is of title, content and the references that
    are set, in order of their names."""
    plain = F.replace(F.replace(F.coalesce(content, F.lit("")), F.lit("\0")), F.lit("\r\n"), F.lit("\n"))
    clean = F.substring(redacted(F.regexp_replace(plain, r"^\s+|\s+$", "")), 1, 20_000)
    named = [refs.get(c, F.lit(None)).cast("long").alias(c) for c in ("commit_id", "file", "lineage", "request", "issue")]
    out = rows.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("key"), F.lit(kind).alias("kind"), title.alias("title"), clean.alias("content"), moment.cast("long").alias("moment"), *named)
    set_ones = F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(refs)))
    return out.withColumn("hash", F.sha2(F.concat_ws("\n", "title", "content", set_ones), 256))


def documents(parts: list[DataFrame], most: int | None = None) -> DataFrame:
    """All parts; with ``most`` those first by the kinds' priority, the newest of a kind first."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if most is None:
        return rows
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return rows.orderBy(F.when(place > 0, place).otherwise(len(KINDS) + 1), F.col("moment").desc_nulls_last(), "key").limit(most)


def question_targets(questions: DataFrame) -> DataFrame:
    """(id, request, issue, sha, names) of questions (id, text): the pull request, issue and commit that it names,
    and the last six identifiers that look like code, the last one first."""
    text = F.coalesce("text", F.lit(""))

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")

    words = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    code = F.filter(words, lambda w: ~F.lower(w).isin(IGNORED) & (w.contains(".") | w.contains("_") | w.rlike(r"^\p{Lu}")))
    last = F.reverse(F.slice(code, F.greatest(F.size(code) - 5, F.lit(1)), 6))
    sha = F.nullif(F.lower(F.regexp_extract(text, SHA, 0)), F.lit(""))
    return questions.select("id", number(REQUEST).alias("request"), number(ISSUE).alias("issue"), sha.alias("sha"), F.array_join(last, ",").alias("names"))


def look_up_targets(targets: DataFrame, commits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, commit_id, symbol_id, lineage, path) of targets (id, sha, names) as ``question_targets`` gives them: the only
    commit (commit_id, sha) whose sha begins so, and the only symbol (symbol_id, name, qualified, lineage, path) of
    the first of the names that names one, by its name or its qualified name, in any case. Null where there is none
    or several. Shas are at least seven characters, which are what they meet by."""
    asked = targets.where("sha IS NOT NULL").select("id", F.lower("sha").alias("prefix"), F.substring(F.lower("sha"), 1, 7).alias("head"))
    known = commits.select("commit_id", F.lower("sha").alias("whole"), F.substring(F.lower("sha"), 1, 7).alias("head"))
    hit = asked.join(known, "head").where(F.col("whole").startswith(F.col("prefix"))).groupBy("id").agg(F.count_distinct("whole").alias("n"), F.min("commit_id").alias("commit_id")).where("n = 1").select("id", "commit_id")
    keys = symbols.select("symbol_id", "lineage", "path", F.explode(F.array(F.lower("name"), F.lower("qualified"))).alias("key")).where("key IS NOT NULL")
    # a name that several symbols have names none of them
    index = keys.groupBy("key").agg(F.count_distinct("symbol_id").alias("n"), F.min(F.struct("symbol_id", "lineage", "path")).alias("s")).where("n = 1").select("key", "s")
    names = targets.select("id", F.posexplode(F.split(F.lower("names"), ",")).alias("at", "key"))
    named = names.join(index, "key").groupBy("id").agg(F.min_by("s", "at").alias("s"))
    return targets.select("id").join(hit, "id", "left").join(named, "id", "left").select("id", "commit_id", "s.symbol_id", "s.lineage", "s.path")


def intent_of(question: Column) -> Column:
    """What a question asks for; general where no word tells."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return first_match([(reduce(Column.__or__, (low.contains(x) for x in terms)), intent) for intent, terms in INTENTS], "general")


def direct_evidence(docs: DataFrame, targets: DataFrame, each: int = 3, step: float = 0.03) -> DataFrame:
    """(ask, key, kind, score, reason): documents that share a lineage, request, issue, commit or file with a target
    (ask, lineage, request, issue, commit_id, file and, if it has them, symbol, the one selected, and introduced, the
    commit that brought it), unique in ask. Of each lineage, request, issue, commit and file the newest are looked
    at, LOOKED_AT of them, so that a target meets no more. The first rule that holds gives the score, and the
    introducing commit raises it; of each kind the best ``each`` stay, each after the first with ``step`` less."""
    on = list(LOOKED_AT)
    for c in ("symbol", "introduced"):
        targets = targets if c in targets.columns else targets.withColumn(c, F.lit(None).cast("long"))
    pairs = None
    for c, most in LOOKED_AT.items():
        known = docs.where(F.col(c).isNotNull() & (F.col("kind").isin(KINDS_OF_COMMIT) if c == "commit_id" else F.lit(True)))
        nth = F.row_number().over(Window.partitionBy(c).orderBy(F.col("moment").desc_nulls_last(), "key"))
        some = known.select(c, "key", nth.alias("nth")).where(F.col("nth") <= most).join(targets.select("ask", c), c).select("ask", "key")
        pairs = some if pairs is None else pairs.unionByName(some)
    met = pairs.distinct().join(targets.select("ask", "symbol", "introduced", *(F.col(c).alias(f"t_{c}") for c in on)), "ask")
    same = {c: F.coalesce(F.col(c) == F.col(f"t_{c}"), F.lit(False)) for c in on}
    selected = F.coalesce(F.col("key") == F.concat(F.lit("symbol_current:"), F.col("symbol").cast("string")), F.lit(False))
    rows = met.join(docs.select("key", "kind", "title", *on), "key")
    rows = rows.select("ask", "key", "kind", "title", selected.alias("selected"), *(same[c].alias(f"same_{c}") for c in on), F.coalesce(F.col("commit_id") == F.col("introduced"), F.lit(False)).alias("brought"))
    by_lineage, by_commit = F.lit(OTHER_OF_LINEAGE), F.lit(OTHER_OF_COMMIT)
    for kind, score in OF_LINEAGE.items():
        by_lineage = F.when(F.col("kind") == kind, score).otherwise(by_lineage)
    for kind, score in OF_COMMIT.items():
        by_commit = F.when(F.col("kind") == kind, score).otherwise(by_commit)
    commit_reason = F.when(F.col("kind").isin(*OF_COMMIT), F.concat(F.lit("direct_"), "kind")).otherwise(F.concat(F.lit("direct_commit_"), "kind"))
    rules = [
        (F.col("selected"), F.lit(SELECTED), F.lit("direct_selected_symbol")),
        (F.col("same_lineage"), by_lineage, F.concat(F.lit("direct_symbol_"), "kind")), (F.col("same_request"), F.lit(OF_REQUEST), F.lit("direct_pull_request_link")),
        (F.col("same_issue"), F.lit(OF_ISSUE), F.lit("direct_issue_reference")), (F.col("same_commit_id"), by_commit, commit_reason), (F.col("same_file"), F.lit(OF_FILE), F.concat(F.lit("direct_file_"), "kind")),
    ]
    score, reason = F.lit(ELSE), F.concat(F.lit("direct_"), "kind")
    for holds, value, why in reversed(rules):
        score, reason = F.when(holds, value).otherwise(score), F.when(holds, why).otherwise(reason)
    raised = F.col("brought") & (F.col("same_lineage") | F.col("kind").isin(*OF_COMMIT))
    score = F.when(raised, F.least(F.lit(1.0), score + INTRODUCTION)).otherwise(score)
    reason = F.when(raised, F.concat(F.lit("symbol_introduction+"), reason)).otherwise(reason)
    scored = rows.select("ask", "key", "kind", "title", F.round(score, SCORE).alias("raw"), reason.alias("reason"))
    place = F.row_number().over(Window.partitionBy("ask", "kind").orderBy(F.desc("raw"), "title", "key"))
    kept = scored.withColumn("place", place).where(F.col("place") <= each)
    return kept.select("ask", "key", "kind", F.round(F.greatest(F.lit(0.0), F.col("raw") - step * (F.col("place") - 1)), SCORE).alias("score"), "reason")


def cited_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim, cited, known, kept, valid) of claims (claim, keys): of the distinct keys that a claim cites, those among
    the evidence (key) are kept, in order of their first mention; a claim is valid while any is left."""
    each = claims.select("claim", F.posexplode_outer(F.array_distinct("keys")).alias("at", "key"))
    there = evidence.select("key", F.lit(1).alias("k")).distinct()
    kept = F.array_sort(F.collect_list(F.when(F.col("k") == 1, F.struct("at", "key"))))
    per = each.join(there, "key", "left").groupBy("claim").agg(F.count("key").alias("cited"), F.count("k").alias("known"), F.transform(kept, lambda x: x["key"]).alias("kept"))
    return per.withColumn("valid", F.col("known") > 0)


def check_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors (vec_id, embedding), once all are seen to be of this dimension and without nulls; else an error
    when they are read."""
    fine = (F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"not {dimension} numbers: "), F.col("vec_id").cast("string")))))


def to_embed(docs: DataFrame, known: DataFrame, version: str, dimension: int) -> DataFrame:
    """(key, action) of documents (key, hash) against stored vectors (key, hash, version, dimension): keep where
    hash and version agree, else embed; drop what has no document. Vectors of another dimension make all embed."""
    other = known.where(F.col("dimension") != dimension).limit(1).agg(F.count("*") > 0).scalar()
    a, b = docs.select("key", F.col("hash").alias("h")), known.select("key", F.col("hash").alias("was"), "version")
    same = (F.col("h") == F.col("was")) & (F.col("version") == version)
    action = F.when(F.col("h").isNull(), "drop").when(F.coalesce(same, F.lit(False)) & ~other, "keep").otherwise("embed")
    return a.join(b, "key", "full").select("key", action.alias("action"))
