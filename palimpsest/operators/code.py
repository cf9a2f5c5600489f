"""Source files: languages, ranges of lines, imports and symbols."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "php": "php", "html": "html", "css": "css",
}

#: What names an imported module in each language.
IMPORTS = {
    "python": r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))",
    "javascript": r"""(?:\bfrom\s+|\brequire\(\s*|\bimport\s+)["']([^"']+)["']()""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)()\s*;",
    "c": r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)()[>"]""",
    "go": r"""(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"()\s*$""",
}


def language_of(path: Column) -> Column:
    """The language that a path's extension names, or null."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def looks_binary(content: Column) -> Column:
    """A zero byte, or more than a tenth control characters, in the first 8 KiB."""
    head = F.substring(content, 1, 8192)
    odd = F.length(head) - F.length(F.regexp_replace(head, "[\\x01-\\x08\\x0e-\\x1f]", ""))
    return head.contains("\0") | (F.length(head) < 10 * odd)


def line_range(text: Column, first: int, last: int) -> tuple[Column, Column]:
    """Lines first to last, and whether the file goes on after them."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, first, last - first + 1), "\n"), F.size(lines) > last


def imports(files: DataFrame) -> DataFrame:
    """(file_id, module) of files (file_id, language, text), each once."""
    found = None
    for language, pattern in IMPORTS.items():
        both = F.concat(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)))
        found = F.when(F.col("language") == language, both) if found is None else found.when(F.col("language") == language, both)
    return files.select("file_id", F.explode(found).alias("module")).where("module <> ''").distinct()


_SYMBOL = pa.schema([("file_id", pa.int64()), ("qualified", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("documentation", pa.string())])


def python_symbols(text: str) -> list[tuple]:
    """(qualified, name, kind, start, end, documentation) of functions, methods, constructors and classes."""
    out: list[tuple] = []

    def visit(node: ast.AST, parents: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "constructor" if in_class and child.name == "__init__" else "method" if in_class else "function"
                out.append((".".join((*parents, child.name)), child.name, kind, child.lineno, child.end_lineno, (ast.get_docstring(child) or "")[:4000] or None))
                visit(child, (*parents, child.name), is_class)
            else:
                visit(child, parents, in_class)

    visit(ast.parse(text), (), False)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of the Python files among files (file_id, text); a file that can't be parsed has none."""

    def parse(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    rows += [(i, *s) for s in python_symbols(t or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SYMBOL, strict=True)], schema=_SYMBOL)

    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(parse, "file_id long, qualified string, name string, kind string, start_line int, end_line int, documentation string")
