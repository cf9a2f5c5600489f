"""Predicates over paths, positions and inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import numbered

#: File names and endings that hold secrets.
SECRET_NAMES = ["credentials.json", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SECRET_ENDINGS = [".pem", ".key", ".p12", ".pfx", ".keystore"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def under(path: Column, prefix: str) -> Column:
    """The prefix itself, or what lies below it as a directory or as a scope."""
    return (path == prefix) | path.startswith(f"{prefix}/") | path.startswith(f"{prefix}::")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def sensitive_path(path: Column) -> Column:
    """Whether a path's name is of a file that holds secrets; a null path isn't."""
    name = F.lower(base_name(path))
    named = any_of([(name == n) | name.startswith(f"{n}.") for n in (".env", "secrets")])
    return F.coalesce(named | name.isin(SECRET_NAMES) | any_of([name.endswith(e) for e in SECRET_ENDINGS]), F.lit(False))


def valid_path(path: Column) -> Column:
    """A relative path without empty parts, parts that lead up, NUL or a leading dash."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..")) | path.contains("\0") | path.startswith("-") | path.contains("\\")
    return F.coalesce(~bad, F.lit(False))


def valid_sha(sha: Column) -> Column:
    """A full or short object name of 7 to 40 hexadecimal digits."""
    return F.coalesce(sha.rlike("^[0-9a-fA-F]{7,40}$"), F.lit(False))


def repository_name(url: Column) -> Column:
    """owner/name of a repository URL (https, no user, port, query or fragment, two parts of plain letters), without
    a final .git or slash; else null."""
    form = r"^https://[A-Za-z0-9.-]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
    return F.when(url.rlike(form), F.concat_ws("/", F.regexp_extract(url, form, 1), F.regexp_extract(url, form, 2)))


def between_positions(changes: DataFrame, commits: DataFrame, first: int, last: int) -> DataFrame:
    """The changes of the commits at positions first to last, counted from 1 in order of time and name; with their
    position."""
    placed, _ = numbered(commits.select("commit_id", "moment"), "position", "moment", "commit_id")
    return changes.join(placed.where(F.col("position").between(first, last)).select("commit_id", "position"), "commit_id")


def page_after(rows: DataFrame, wanted: Column, order: list[Column], most: int, offset: int, limit: int) -> DataFrame:
    """A page of the rows wanted among the first ``most`` in order, with their number."""
    some = rows.orderBy(*order).limit(most).where(wanted)
    return some.orderBy(*order).offset(offset).limit(limit).withColumn("total", some.agg(F.count("*")).scalar())


def sorted_by(rows: DataFrame, keys: dict[str, Column], name: str, *ties: str) -> DataFrame:
    """Rows in the order of a named key; an unknown name is an error."""
    if name not in keys:
        raise ValueError(f"{name} is none of {', '.join(keys)}")
    return rows.orderBy(keys[name], *ties)
