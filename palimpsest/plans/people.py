"""People, activity and ages."""

from pyspark.sql import functions as F

from ..operators import people as P
from .registry import query

ASOF = "o AS (SELECT max(moment) AS now FROM commits)"
DAYS = "greatest(CAST(floor(({now} - {moment}) / 86400.0) AS BIGINT), 0)"
KNOW = "WITH " + ASOF + """, f1 AS (SELECT *, row_number() OVER (PARTITION BY file_id, commit_id ORDER BY change_order, additions, deletions) AS k FROM changes),
 j AS (SELECT f1.file_id, author_id, moment, f1.commit_id, additions + deletions AS lines FROM f1 JOIN commits ON f1.commit_id = commits.commit_id WHERE k = 1 AND NOT is_merge),
 p AS (SELECT file_id, author_id, count(*) AS commits, CAST(sum(lines) AS BIGINT) AS lines, max(moment) AS last_at, min((moment, commit_id)) AS start FROM j GROUP BY 1, 2),
 i AS (SELECT *, CAST(start = min(start) OVER (PARTITION BY file_id) AS INTEGER) AS introduced FROM p),
 w AS (SELECT *, 0.65 * commits + 0.25 * exp(-(""" + DAYS.format(now="(SELECT now FROM o)", moment="last_at") + """) / 365.0) + 0.10 * introduced AS raw FROM i),
 kn AS (SELECT file_id, author_id, commits, lines, introduced, round(raw / sum(raw) OVER (PARTITION BY file_id), 6) AS knowledge, round(commits / CAST(sum(commits) OVER (PARTITION BY file_id) AS DOUBLE), 6) AS share FROM w)"""
ACT = "WITH " + ASOF + """, x AS (SELECT file_id, changes.commit_id, author_id, moment, change_order, additions, deletions, change_type FROM changes JOIN commits ON changes.commit_id = commits.commit_id),
 l AS (SELECT file_id, CAST(sum(additions + deletions) AS BIGINT) AS churn, CAST(sum(additions) AS BIGINT) AS added, CAST(sum(deletions) AS BIGINT) AS removed, count(*) FILTER (WHERE change_type = 'renamed') AS renames, count(*) FILTER (WHERE additions > 48 AND deletions > 9) AS rewrites,
  arg_max(deletions >= additions, (moment, commit_id, change_order, additions, deletions)) AS deleted FROM x GROUP BY 1),
 y AS (SELECT DISTINCT file_id, commit_id, author_id, moment, """ + DAYS.format(now="(SELECT now FROM o)", moment="moment") + """ AS ago FROM x),
 act AS (SELECT y.file_id, count(*) AS changes, count(*) FILTER (WHERE ago <= 30) AS changes_30, count(*) FILTER (WHERE ago <= 90) AS changes_90, count(*) FILTER (WHERE ago <= 180) AS changes_180, count(DISTINCT author_id) AS people, max(ago) AS age_days, min(ago) AS idle_days,
  any_value(churn) AS churn, any_value(added) AS added, any_value(removed) AS removed, any_value(renames) AS renames, any_value(rewrites) AS rewrites, any_value(deleted) AS deleted FROM y JOIN l ON y.file_id = l.file_id GROUP BY 1)"""


def as_of(h):
    return h.commits().agg(F.max("moment")).scalar()


@query("commits changes", "SELECT count(*) AS commits, count(*) FILTER (WHERE is_merge) AS merges, count(DISTINCT author_id) AS authors, min(moment) AS first_at, max(moment) AS last_at, (SELECT CAST(sum(additions) AS BIGINT) FROM changes) AS insertions, (SELECT CAST(sum(deletions) AS BIGINT) FROM changes) AS deletions, (SELECT count(DISTINCT file_id) FROM changes) AS files FROM commits")
def repo_stats(h):
    return P.repo_stats(h.commits(), h.changes())


@query("commits changes", KNOW + " SELECT * FROM kn")
def contributor_knowledge(h):
    return P.contributor_knowledge(h.changes(), h.commits(), as_of(h))


@query("commits changes", "WITH f AS (SELECT author_id, count(DISTINCT file_id) AS files FROM changes JOIN commits ON changes.commit_id = commits.commit_id GROUP BY 1), c AS (SELECT author_id, count(*) AS commits, min(moment) AS first_at, max(moment) AS last_at FROM commits GROUP BY 1) SELECT c.author_id, c_name AS name, commits, coalesce(files, 0) AS files, first_at, last_at FROM c LEFT JOIN f ON c.author_id = f.author_id JOIN customer ON c.author_id = c_custkey")
def contributors(h):
    return P.contributors(h.changes(), h.commits(), h.authors())


@query("commits changes", KNOW + """, c AS (SELECT file_id, count(*) AS people, max(knowledge) AS top, sum(CASE WHEN knowledge > 0 THEN -knowledge * ln(knowledge) ELSE 0 END) AS h FROM kn GROUP BY 1), e AS (SELECT *, CASE WHEN people <= 1 THEN 0.0 ELSE h / ln(people) END AS entropy0 FROM c)
 SELECT file_id, people, round(top, 4) AS top_share, round(entropy0, 4) AS entropy, CASE WHEN top >= 0.6 OR entropy0 < 0.45 THEN 'concentrated' ELSE 'distributed' END AS label FROM e""")
def knowledge_concentration(h):
    return P.knowledge_concentration(contributor_knowledge(h))


@query("commits changes", ACT + " SELECT * FROM act")
def entity_activity(h):
    return P.entity_activity(h.changes(), h.commits(), as_of(h), (F.col("additions") > 48) & (F.col("deletions") > 9), F.col("deletions") >= F.col("additions"))


@query("commits changes", ACT + """, v AS (SELECT *, least(changes_180 / 6.0, 1.0) AS r, least(changes / 12.0, 1.0) AS t, least(people / 5.0, 1.0) AS p, least(rewrites / 3.0, 1.0) AS w FROM act),
 s AS (SELECT *, round(0.35 * r + 0.30 * t + 0.20 * w + 0.15 * p, 4) AS vol, round(0.50 * idle_days / (idle_days + 180.0) + 0.30 / (1 + changes / 4.0) + 0.20 * (1 - r), 4) AS stab FROM v)
 SELECT file_id, CAST(vol AS DOUBLE) AS volatility, CAST(stab AS DOUBLE) AS stability, CASE WHEN deleted THEN 'deleted' WHEN rewrites > 0 AND changes_180 > 0 THEN 'recently_rewritten' WHEN age_days >= 365 AND changes_180 = 0 AND changes <= 2 THEN 'stable_legacy' WHEN age_days < 90 THEN 'new_code' WHEN vol >= 0.65 THEN 'frequently_changed' WHEN age_days >= 365 AND changes_180 > 0 THEN 'long_lived_active' WHEN changes_180 = 0 THEN 'recently_inactive' ELSE 'active' END AS label FROM s""")
def volatility(h):
    return P.volatility(entity_activity(h))


@query("commits changes", ACT + " SELECT round(median(age_days), 2) AS median_age, round(avg(age_days), 2) AS mean_age, count(*) AS files FROM act")
def age_median(h):
    return P.age_median(entity_activity(h))


@query("commits", "WITH " + ASOF + ", a AS (SELECT " + DAYS.format(now="(SELECT now FROM o)", moment="moment") + " AS d FROM commits) SELECT CASE WHEN d < 90 THEN '0_under_90' WHEN d < 365 THEN '1_under_365' WHEN d < 1095 THEN '2_under_1095' ELSE '3_older' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def age_buckets(h):
    from ..functions.scalars import elapsed_days

    return P.age_buckets(h.commits().select(elapsed_days(as_of(h), F.col("moment")).alias("d")), "d")


@query("sources", "SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(100.0 * sum(lines) / CAST(sum(sum(lines)) OVER () AS DOUBLE), 1) AS percent FROM sources GROUP BY 1")
def language_share(h):
    return P.language_share(h.sources())


@query("sources", "SELECT count(*) AS files, count(DISTINCT module) AS modules, count(DISTINCT language) AS languages, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (WHERE lines > 40) AS large, count(*) FILTER (WHERE lines <= 5) AS tiny FROM sources")
def code_stats(h):
    return P.code_stats(h.sources())


@query("commits changes", ACT + " SELECT file_id, changes, age_days FROM act ORDER BY changes DESC, age_days, file_id LIMIT 10")
def overview_top_changed(h):
    return entity_activity(h).select("file_id", "changes", "age_days").orderBy(F.desc("changes"), "age_days", "file_id").limit(10)
