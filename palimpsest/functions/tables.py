"""Table functions for SQL: ``register(spark)`` makes them known by name.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 500) c
    SELECT s.* FROM files f, LATERAL parse_symbols(f.text, 'python') s
    SELECT * FROM line_origins(TABLE(hunks) PARTITION BY file ORDER BY pos)

Their results' columns are told when a query is analysed, and wrong arguments are refused then, before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.code import python_symbols


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in columns.items()])


@udtf
class ChunkText:
    """(chunk, text) of consecutive stretches of at most ``size`` characters; none of a null or empty text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, T.StringType):
            raise ValueError("chunk_text takes a text")
        if not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1:
            raise ValueError("chunk_text takes a constant size of at least 1")
        return AnalyzeResult(_fields(chunk=T.IntegerType(), text=T.StringType()))

    def eval(self, text: str | None, size: int) -> Iterator[tuple]:
        for k in range(0, len(text or ""), size):
            yield k // size, text[k : k + size]


@udtf
class ParseSymbols:
    """(qualified, name, kind, start_line, end_line, documentation) of the symbols of a source text; none of one that
    can't be parsed."""

    @staticmethod
    def analyze(text: AnalyzeArgument, language: AnalyzeArgument) -> AnalyzeResult:
        if language.isConstantExpression and language.value != "python":
            raise ValueError(f"no parser for {language.value}")
        return AnalyzeResult(_fields(qualified=T.StringType(), name=T.StringType(), kind=T.StringType(), start_line=T.IntegerType(), end_line=T.IntegerType(), documentation=T.StringType()))

    def eval(self, text: str | None, language: str | None) -> Iterator[tuple]:
        if language == "python":
            try:
                yield from python_symbols(text or "")
            except (SyntaxError, ValueError, RecursionError):
                return


@udtf
class LineOrigins:
    """(.., first, last, origin) of a file's hunks (pos, old_start, old_count, new_start, new_count) in order of pos and
    old_start: the runs of lines of its last state by the position of the change that brought them. Lines that no
    hunk brought aren't told. The columns that the hunks are partitioned by come first.

    The state is blocks of runs, so memory follows a file's runs and not its history, and a hunk costs the blocks and
    the runs of one of them, not all runs."""

    @staticmethod
    def analyze(hunks: AnalyzeArgument) -> AnalyzeResult:
        known = {f.name: f.dataType for f in hunks.dataType.fields}
        wanted = ["pos", "old_start", "old_count", "new_start", "new_count"]
        if missing := [c for c in wanted if c not in known]:
            raise ValueError(f"line_origins needs columns {', '.join(missing)}")
        keys = [T.StructField(c, t) for c, t in known.items() if c not in wanted]
        return AnalyzeResult(T.StructType([*keys, *_fields(first=T.LongType(), last=T.LongType(), origin=T.LongType())]))

    def __init__(self) -> None:
        # blocks of runs (lines, origin) with all their lines; the last run is what no hunk has brought
        self.blocks: list[list] = [[ENDLESS, [(ENDLESS, None)]]]
        self.at: list[int] | None = None
        self.keys: tuple = ()
        self.pos: int | None = None
        self.hunks: list[tuple[int, int, int]] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.at is None:
            names = list(row.asDict())
            self.at = [names.index(c) for c in ("pos", "old_start", "old_count", "new_count")]
            wanted = ("pos", "old_start", "old_count", "new_start", "new_count")
            self.keys = tuple(row[c] for c in names if c not in wanted)
        p, old, gone, come = self.at
        pos = row[p]
        if self.pos is not None and pos != self.pos:
            self.apply()
        self.pos = pos
        self.hunks.append((row[old], row[gone], row[come]))
        return ()

    def apply(self) -> None:
        """One change's hunks, all at once: from the last on, so that none moves the lines of those that follow."""
        for old, gone, come in sorted(self.hunks, key=lambda h: h[:2], reverse=True) if len(self.hunks) > 1 else self.hunks:
            # a hunk that takes nothing stands after its old line
            self.put(old - 1 if gone else old, gone, come)
        self.hunks = []

    def put(self, left: int, gone: int, come: int) -> None:
        """Lines of the change in place of some, after the first ``left`` ones."""
        for b, (lines, runs) in enumerate(self.blocks):  # noqa: B007
            if left < lines:
                break
            left -= lines
        r = 0
        while left >= runs[r][0]:
            left -= runs[r][0]
            r += 1
        if left:
            n, origin = runs[r]
            runs[r : r + 1] = [(left, origin), (n - left, origin)]
            r += 1
        x, k, emptied = b, r, False
        while gone:
            block = self.blocks[x]
            if k == len(block[1]):
                x, k, emptied = x + 1, 0, True
                continue
            n, origin = block[1][k]
            some = min(n, gone)
            if n > ENDLESS // 2:
                break
            if n == some:
                del block[1][k]
                block[0] -= some
            else:
                block[1][k] = (n - some, origin)
                block[0] -= some
            gone -= some
        if come:
            runs.insert(r, (come, self.pos))
            self.blocks[b][0] += come
        if len(runs) > MOST_RUNS:
            half = runs[MOST_RUNS // 2 :]
            del runs[MOST_RUNS // 2 :]
            lines = sum(n for n, _ in half)
            self.blocks[b][0] -= lines
            self.blocks.insert(b + 1, [lines, half])
        if emptied or not runs:
            self.blocks = [x for x in self.blocks if x[1]]

    def terminate(self) -> Iterator[tuple]:
        if self.pos is not None:
            self.apply()
            first = 1
            for _, runs in self.blocks:
                for n, origin in runs:
                    if origin is not None:
                        yield *self.keys, first, first + n - 1, origin
                    first += n


#: Lines of a run that has no end, and runs of a block, of which a change looks into one.
ENDLESS, MOST_RUNS = 1 << 60, 128


def register(spark: SparkSession) -> None:
    """Make all table functions known to a session's SQL."""
    for name, f in (("chunk_text", ChunkText), ("parse_symbols", ParseSymbols), ("line_origins", LineOrigins)):
        spark.udtf.register(name, f)
