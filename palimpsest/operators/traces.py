"""Stack traces and diffs: frames, the files and symbols they name, and the lines that a fix points back to."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of a frame in each language's traces.
FRAMES = [
    ("python", re.compile(r'^\s*File "(?P<file>[^"]+)", line (?P<line>\d+)(?:, in (?P<function>\S+))?')),
    ("java", re.compile(r"^\s*at (?P<function>[\w.$<>]+)\((?P<file>[\w$]+\.(?:java|kt|scala)):(?P<line>\d+)\)")),
    ("javascript", re.compile(r"^\s*at (?:(?P<function>[\w.$<> ]+) \()?(?P<file>[^\s()]+\.(?:js|jsx|ts|tsx|mjs)):(?P<line>\d+):(?P<column>\d+)\)?")),
    ("go", re.compile(r"^\s*(?P<file>[^\s:]+\.go):(?P<line>\d+)")),
    ("c_cpp", re.compile(r"^\s*#\d+\s+(?:0x[0-9a-fA-F]+ in )?(?P<function>[\w:~<>]+).*? at (?P<file>[^\s:]+\.(?:c|cc|cpp|cxx|h|hpp)):(?P<line>\d+)")),
]
_FRAME = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("language", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("function", pa.string())])


def parse_trace(text: str) -> list[tuple[str, str, int, str | None]]:
    found = []
    for row in text.splitlines():
        for language, form in FRAMES:
            if m := form.match(row):
                found.append((language, m["file"], int(m["line"]), m.groupdict().get("function")))
                break
    return found


def stack_frames(texts: DataFrame) -> DataFrame:
    """(id, frame, language, file, line, function) of the traces in texts (id, text)."""

    def parse(batches):
        for b in batches:
            rows = [(i, k, *f) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True) for k, f in enumerate(parse_trace(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FRAME, strict=True)], schema=_FRAME)

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(parse, "id long, frame int, language string, file string, line long, function string")


#: The head of a hunk, and what a line that is only a comment begins with.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
COMMENT = r"^\s*(#|//|/\*|\*)"


def blamed_lines(diffs: DataFrame) -> DataFrame:
    """(id, line) of diffs (id, diff) without context: the old lines of the code that a hunk removes; where it
    removes none but comments and blanks, the old lines around it. The last hunk reaches its whole length there,
    others one line to each side. Lines before the first hunk don't count."""
    lines = diffs.select("id", F.posexplode(F.split("diff", "\r?\n")).alias("pos", "row"))
    in_order = Window.partitionBy("id").orderBy("pos")
    head = F.col("row").rlike(HUNK)
    placed = lines.withColumn("hunk", F.count_if(head).over(in_order)).where("hunk > 0")
    of_hunk = Window.partitionBy("id", "hunk")
    removes = F.col("row").startswith("-") & ~F.col("row").startswith("---")
    adds = F.col("row").startswith("+") & ~F.col("row").startswith("+++")
    content = F.expr("substring(row, 2)")
    start = F.max(F.when(head, F.regexp_extract("row", HUNK, 1).cast("long"))).over(of_hunk)
    count = F.max(F.when(head, F.coalesce(F.nullif(F.regexp_extract("row", HUNK, 2), F.lit("")).cast("long"), F.lit(1)))).over(of_hunk)
    before = F.count_if(~head & ~adds).over(of_hunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    told = placed.select(
        "id", "hunk", start.alias("start"), count.alias("count"), (start + before).alias("old"), (removes & (F.trim(content) != "") & ~content.rlike(COMMENT)).alias("code"),
        (F.col("hunk") == F.max("hunk").over(Window.partitionBy("id"))).alias("last"),
    )
    removed = told.where("code").select("id", F.col("old").alias("line"))
    none = told.groupBy("id", "hunk", "start", "count", "last").agg(F.bool_or("code").alias("some")).where("NOT some")
    low = F.greatest(F.lit(1), F.col("start") - 1)
    high = F.when(F.col("last"), F.greatest(F.lit(1), F.col("start") + F.greatest("count", F.lit(1))) + 1).otherwise(F.greatest(F.lit(1), F.col("start")) + 1)
    return removed.unionByName(none.select("id", F.explode(F.sequence(low, high)).alias("line"))).distinct()


#: Paths whose changes tell nothing about a defect.
EXCLUDED = ["node_modules", "vendor", "dist", "build", ".min.js", "package-lock.json"]


def excluded_path(path: Column) -> Column:
    """Whether a path is of generated or foreign code."""
    low = F.lower(path)
    found = low.contains(EXCLUDED[0])
    for part in EXCLUDED[1:]:
        found = found | low.contains(part)
    return found


#: Prefixes that are taken off a frame's path, and what marks foreign code in it.
SCHEMES = ["file://", "webpack://", "webpack-internal://"]
EXTERNAL = ["node_modules/", "site-packages/", "python/lib/", "jdk/", "<anonymous>"]


def resolve_frames(frames: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, frame, status, file_id, symbol, confidence) of frames (id, frame, file, line, function), against files
    (file_id, path) and symbols (file_id, symbol, name, first, last).

    external: the path is of foreign code. exact: a file has the path. Else the file whose path the frame's path
    ends with, or the only one of its file name: path_match, or ambiguous if there are several; unresolved without
    any. In a file that was found, the tightest symbol around the line is named, first those of the function's
    name, which are sure; a path_match with a symbol is a symbol_match."""
    path = F.regexp_replace(F.trim("file"), "\\\\", "/")
    path = F.regexp_replace(F.regexp_replace(path, "^[\"']+|[\"']+$", ""), "^(?:" + "|".join(SCHEMES) + ")", "")
    rows = frames.withColumn("full", F.regexp_replace(path, r"^(?:\./)+", "")).withColumn("low", F.lower("full"))
    foreign = F.lit(False)
    for mark in EXTERNAL:
        foreign = foreign | F.col("low").contains(mark)
    rows = rows.withColumn("foreign", foreign)
    known = files.select("file_id", "path", F.lower("path").alias("low_path"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("base"))
    parts = F.split("low", "/")
    # ends of the frame's path that begin after a slash
    ends = rows.where(F.size(parts) > 1).select("id", "frame", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("low_path"))
    by_end = ends.join(known, "low_path").groupBy("id", "frame").agg(F.count("*").alias("n_end"), F.min("file_id").alias("end_id"))
    by_name = known.groupBy("base").agg(F.count("*").alias("n_name"), F.min("file_id").alias("name_id"))
    whole = known.select(F.col("path").alias("full"), F.col("file_id").alias("whole_id"))
    found = rows.join(whole, "full", "left").join(by_end, ["id", "frame"], "left").withColumn("base", F.element_at(parts, -1)).join(by_name, "base", "left")
    status = (
        F.when(F.col("foreign"), "external").when(F.col("whole_id").isNotNull(), "exact").when(F.col("n_end") == 1, "path_match").when(F.col("n_end") > 1, "ambiguous")
        .when(F.col("n_name") == 1, "path_match").when(F.col("n_name") > 1, "ambiguous").otherwise("unresolved")
    )
    file_id = F.when(status == "exact", F.col("whole_id")).when(status == "path_match", F.coalesce(F.when(F.col("n_end") == 1, F.col("end_id")), F.col("name_id")))
    found = found.select("id", "frame", "line", F.element_at(F.split(F.coalesce("function", F.lit("")), r"\."), -1).alias("function"), status.alias("status"), file_id.alias("file_id"))
    around = found.join(symbols, "file_id").where(F.col("line").between(F.col("first"), F.col("last")))
    named = F.col("name") == F.col("function")
    best = around.groupBy("id", "frame").agg(F.min(F.struct((~named).alias("other"), (F.col("last") - F.col("first")).alias("width"), "first", "symbol")).alias("x"))
    out = found.join(best, ["id", "frame"], "left")
    told = F.when((F.col("status") == "path_match") & F.col("x").isNotNull(), "symbol_match").otherwise(F.col("status"))
    return out.select("id", "frame", told.alias("status"), "file_id", F.col("x.symbol").alias("symbol"), F.when(F.col("x").isNotNull(), F.when(F.col("x.other"), 0.9).otherwise(1.0)).alias("confidence"))
