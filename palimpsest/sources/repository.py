"""A data source over a local Git repository: commits, parents, changes, tags, trees, blame, blobs, diffs and the
history of a file under its names, as tables.

spark.dataSource.register(RepositorySource); spark.read.format("repository").option("path", p)
.option("table", "commits").load(). Reads with the git program; a commit range (rev, such as v1 or good..bad) is split
over tasks, each of which reads one log. More options: file, lines (first,last), context, mostBytes, mostCommits.
"""

from __future__ import annotations

import re
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "position long, sha string, parents string, author_name string, author_email string, authored_at long, committer_name string, committer_email string, committed_at long, message string",
    "changes": "sha string, change_order int, change_type string, old_path string, new_path string, additions int, deletions int, similarity int",
    "tags": "name string, target string, annotated boolean",
    "tree": "path string, mode string, type string, blob string, size long",
    "blame": "line int, sha string, author string, moment long, source string, original_line int, original_path string",
    "blob": "path string, blob string, size long, truncated boolean, content binary",
    "diff": "path string, diff string, truncated boolean",
    "follow": "place int, sha string, change_type string, old_path string, new_path string",
}
#: Meanings of status letters.
STATUS = {"A": "added", "D": "deleted", "R": "renamed", "C": "copied", "M": "modified", "T": "modified"}
#: Forms of the entries of raw and numstat output with NUL after each path.
RAW = re.compile(r":\d{6} \d{6} \w+ \w+ (?:([RC])(\d*)\0([^\0]+)\0([^\0]+)|([A-Z])\d*\0([^\0]+))\0")
COUNTS = re.compile(r"(?:(\d+)|-)\t(?:(\d+)|-)\t(?:\0[^\0]+\0[^\0]+|[^\0]+)\0")


def git(path: str, *args: str, given: str | None = None) -> bytes:
    return subprocess.run(["git", "-C", path, *args], input=given.encode() if given is not None else None, capture_output=True, check=True).stdout


def text_of(path: str, *args: str, given: str | None = None) -> str:
    return git(path, *args, given=given).decode("utf-8", "replace")


def changes_of(entries: str) -> list[tuple]:
    """The changes of a commit from its raw entries and the counts after them, which come in the same order."""
    found = list(RAW.finditer(entries))
    counts = list(COUNTS.finditer(entries, found[-1].end())) if found else []
    out = []
    for k, (m, n) in enumerate(zip(found, counts, strict=True)):
        kind = STATUS.get(m[1] or m[5], "modified")
        paths = (m[3], m[4]) if m[1] else (None if kind == "added" else m[6], None if kind == "deleted" else m[6])
        out.append((k, kind, *paths, *(int(x) if x else None for x in n.groups()), int(m[2]) if m[2] else None))
    return out


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "commits")
        self.rev, self.file = options.get("rev", "HEAD"), options.get("file")
        self.lines, self.context = options.get("lines"), options.get("context", "3")
        self.most_bytes, self.most_commits = int(options.get("mostbytes", 1 << 20)), int(options.get("mostcommits", 0))

    def partitions(self):
        if self.table not in ("commits", "changes"):
            return [InputPartition(("", 0))]
        shas = text_of(self.path, "rev-list", "--reverse", "--topo-order", self.rev).split()
        if self.most_commits and len(shas) > self.most_commits:
            raise ValueError(f"{len(shas)} commits are more than mostCommits = {self.most_commits}")
        return [InputPartition(("\n".join(shas[i : i + 500]), i)) for i in range(0, len(shas), 500)] or [InputPartition(("", 0))]

    def read(self, partition):
        shas, first = partition.value
        yield from getattr(self, f"_{self.table}")(shas, first)

    def _log(self, shas: str, *args: str) -> str:
        """One log of the commits of a partition."""
        return text_of(self.path, "-c", "log.showRoot=true", "log", "--no-walk=unsorted", "--stdin", "-z", *args, given=shas) if shas else ""

    def _commits(self, shas, first):
        fields = self._log(shas, "--format=%H%x00%P%x00%an%x00%ae%x00%at%x00%cn%x00%ce%x00%ct%x00%B").split("\0")
        for k in range(len(fields) // 9):
            sha, parents, name, mail, at, by, by_mail, by_at, message = fields[9 * k : 9 * k + 9]
            yield first + k, sha, parents, name, mail, int(at), by, by_mail, int(by_at), message.rstrip("\n")

    def _changes(self, shas, first):
        log = self._log(shas, "--first-parent", "-m", "-M", "--raw", "--numstat", "--format=%x02%H")
        for part in log.split("\2")[1:]:
            for change in changes_of(part[40:]):
                yield part[:40], *change

    def _tags(self, *_):
        for row in text_of(self.path, "for-each-ref", "refs/tags", "--format=%(refname:short)%00%(objectname)%00%(*objectname)").splitlines():
            name, target, peeled = row.split("\0")
            yield name, peeled or target, bool(peeled)

    def _tree(self, *_):
        for row in text_of(self.path, "ls-tree", "-r", "-l", "-z", self.rev).split("\0"):
            if row:
                meta, path = row.split("\t", 1)
                mode, kind, blob, size = meta.split()
                yield path, mode, kind, blob, None if size == "-" else int(size)

    def _blame(self, *_):
        own = {}
        some = ("-L", self.lines) if self.lines else ()
        for row in text_of(self.path, "blame", "--line-porcelain", *some, self.rev, "--", self.file).split("\n"):
            if row.startswith("\t"):
                yield own["line"], own["sha"], own["author"], int(own["author-time"]), row[1:], own["was"], own["filename"]
            elif m := re.match(r"([0-9a-f]{40}) (\d+) (\d+)", row):
                own = {"sha": m[1], "was": int(m[2]), "line": int(m[3])}
            elif " " in row:
                name, value = row.split(" ", 1)
                own.setdefault(name, value)

    def _blob(self, *_):
        """One file at a revision, or with a blob's name as rev the blob, cut after mostBytes."""
        name = f"{self.rev}:{self.file}" if self.file else self.rev
        content = git(self.path, "cat-file", "blob", name)
        yield self.file, text_of(self.path, "rev-parse", name).strip(), len(content), len(content) > self.most_bytes, content[: self.most_bytes]

    def _diff(self, *_):
        """The diff of a revision, or of two as rev A..B, a row for each file, cut after mostBytes."""
        rev = (self.rev,) if ".." in self.rev else ("--root", self.rev)
        only = ("--", self.file) if self.file else ()
        command = "diff" if ".." in self.rev else "diff-tree"
        for part in re.split(r"(?m)^(?=diff --git )", text_of(self.path, command, "-M", "-p", f"-U{self.context}", *rev, *only))[1:]:
            path = re.search(r"(?m)^(?:\+\+\+ b/|rename to |--- a/)(.*)$", part) or re.search(r" b/(.*)", part)
            cut = part.encode()[: self.most_bytes].decode("utf-8", "ignore")
            yield path[1], cut, len(cut) < len(part)

    def _follow(self, *_):
        """The changes of a file under the names that it has had, the last one first."""
        log = text_of(self.path, "log", "--follow", "-M", "-z", "--raw", "--numstat", "--format=%x02%H", self.rev, "--", self.file)
        for k, part in enumerate(log.split("\2")[1:]):
            for change in changes_of(part[40:]):
                yield k, part[:40], *change[1:4]


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader({k.lower(): v for k, v in self.options.items()})
