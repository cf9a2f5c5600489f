"""Table functions in SQL."""

import random
from difflib import SequenceMatcher

import pytest

from palimpsest.functions import tables


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark.sql


def test_chunks_and_symbols(spark, sql):
    spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id int, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in sql("SELECT id, c.* FROM texts, LATERAL chunk_text(t, 3) c ORDER BY id, chunk").collect()] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    spark.createDataFrame([(1, "class A:\n    def f(self):\n        pass\n"), (2, "def ("), (3, None)], "id int, t string").createOrReplaceTempView("sources")
    assert [tuple(r) for r in sql("SELECT id, s.qualified, s.kind, s.end_line FROM sources, LATERAL parse_symbols(t, 'python') s ORDER BY qualified").collect()] == [(1, "A", "class", 3), (1, "A.f", "method", 3)]
    for wrong in ("SELECT * FROM texts, LATERAL chunk_text(t, 0)", "SELECT * FROM texts, LATERAL chunk_text(id, 3)", "SELECT * FROM texts, LATERAL parse_symbols(t, 'cobol')", "SELECT * FROM line_origins(TABLE(SELECT 1 AS pos))"):
        with pytest.raises(Exception, match="chunk_text takes|no parser|needs columns"):
            sql(wrong)


def test_lines_are_told_their_origin(spark, sql):
    """Against files whose lines are followed one by one, with hunks as a diff tells them."""
    r, hunks, want = random.Random(1), [], []
    for file in range(6):
        lines: list[tuple[str, int]] = []
        for pos in range(1, 30):
            new = list(lines)
            for _ in range(r.randint(1, 3)):
                a = r.randint(0, len(new))
                z = min(len(new), a + r.choice([0, 0, 1, 2, 5]))
                new[a:z] = [(f"{pos}-{r.random()}", pos) for _ in range(r.choice([0, 1, 1, 3]))]
            for tag, i1, i2, j1, j2 in SequenceMatcher(None, lines, new, autojunk=False).get_opcodes():
                if tag != "equal":
                    hunks.append((file, pos, i1 + 1 if i2 > i1 else i1, i2 - i1, j1 + 1 if j2 > j1 else j1, j2 - j1))
            lines = new
        want += [(file, k + 1, origin) for k, (_, origin) in enumerate(lines)]
    r.shuffle(hunks)
    spark.createDataFrame(hunks, "file int, pos long, old_start long, old_count long, new_start long, new_count long").repartition(3).createOrReplaceTempView("hunks")
    got = [tuple(x) for x in sql("SELECT file, explode(sequence(first, last)) AS line, origin FROM line_origins(TABLE(hunks) PARTITION BY file ORDER BY pos) ORDER BY file, line").collect()]
    assert got == want and len(want) > 60


def test_a_change_looks_into_one_block_of_runs():
    from pyspark.sql import Row

    from palimpsest.functions import tables

    f = tables.LineOrigins.func()
    for k in range(4_000):  # a run of one line each, put in the middle
        list(f.eval(Row(file=1, pos=k, old_start=k // 2, old_count=0, new_start=k // 2 + 1, new_count=1)))
    assert max(len(runs) for _, runs in f.blocks) <= tables.MOST_RUNS and len(f.blocks) > 20
    list(f.eval(Row(file=1, pos=4_000, old_start=2, old_count=3_990, new_start=2, new_count=1)))  # over many blocks
    rows = list(f.terminate())
    assert [(first, last) for _, first, last, _ in rows] == [(k, k) for k in range(1, 12)] and rows[1][3] == 4_000
