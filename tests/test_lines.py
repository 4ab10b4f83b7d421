"""The column form and the plain form of the line operators agree, and keep their invariants."""

import random
import re

import pytest

from lakepress.functions import lanes, logs, spans
from lakepress.functions import text as T

random.seed(3)
PIECES = ["", "}", "   ", "ok", "=====", "a longer line of text", "A LONGER  line of text", "batch 12 was done", "batch 13 was done", "ERROR batch 12 failed", "2024-01-01T00:00:00Z", "[debug]", "2024-01-01 00:00:00 INFO x", "tab\there", "éan x", "naïve café line"]
TEXTS = ["", "x", "a\n\n\nb", *("\n".join(random.choice(PIECES) for _ in range(random.randint(1, 160))) for _ in range(40))]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    df = logs.with_truncated(df, "text", "t", "dropped")
    df = logs.with_collapsed_runs(df, "text", "runs")
    df = logs.with_filtered_lines(df, "text", "kept")
    return df.select("*", logs.is_log_shaped(df.text).alias("shaped"), T.normalize_line(df.text).alias("n"), T.utf16_length(df.text).alias("u")).orderBy("id").collect()


def test_truncate(rows):
    assert [(r.t, r.dropped) for r in rows] == [lanes.truncate(t) for t in TEXTS]


def test_markers_add_up(rows):
    for r in rows:
        assert sum(int(n) for n in re.findall(r"\[… (\d+) lines truncated …\]", r.t)) == r.dropped


def test_severity_lines_survive(rows):
    for r in rows:
        assert r.t.count("ERROR") == r.text.count("ERROR")


def test_runs_and_filters(rows):
    assert [r.runs for r in rows] == [lanes.collapse_runs(t) for t in TEXTS]
    assert [r.kept for r in rows] == [lanes.filter_lines(t) for t in TEXTS]


def test_shapes(rows):
    assert [bool(r.shaped) for r in rows] == [lanes.log_shaped(t) for t in TEXTS]
    assert [r.n for r in rows] == [spans.normalize_line(t) for t in TEXTS]
    assert [r.u for r in rows] == [lanes.units(t) for t in TEXTS]


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    for d in (df, df.limit(0)):
        out = logs.with_truncated(logs.with_collapsed_runs(logs.with_filtered_lines(d, "text", "a"), "text", "b"), "text", "c", "n").collect()
        assert all(r.a is None and r.b is None and r.c is None for r in out)


def test_markers(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(T.elided_marker(F.lit(1)).alias("a"), T.elided_marker(F.lit(3)).alias("b"), T.elided_marker(F.lit(12)).alias("c"), T.truncated_marker(F.lit(4)).alias("d")).first()
    assert tuple(row) == ("[… one duplicate block elided …]", "[… three duplicate blocks elided …]", "[… duplicate blocks elided …]", "[… 4 lines truncated …]")


def test_lanes_by_themselves_as_columns_say(spark):
    """solo in one pass against run_step for each lane; null texts have no row."""
    from lakepress.operators import steps

    texts = [None, "", "x", "INFO a b\n" * 130 + "done 1", "a paragraph that is long enough to count as a copy of another one, it is really so\n\n" * 3, "the cat is very kind of happy, thank you, and the dog sleeps in order to rest"]
    df = spark.createDataFrame([(k, t, k % 2 == 0) for k, t in enumerate(texts)], "doc_id int, text string, is_shell_tool boolean")
    lanes = ["dedup", "rtk", "truncate", "caveman", "lite"]
    found = {(r.doc_id, r.engine): r for r in steps.solo(df, lanes).collect()}
    assert set(found) == {(k, e) for k, t in enumerate(texts) if t is not None for e in lanes}
    for e in lanes:
        for r in steps.run_step(df.where("text IS NOT NULL"), e).selectExpr("doc_id", "steps[0] AS s").collect():
            own = found[r.doc_id, e].asDict()
            assert own.pop("lane_no") == lanes.index(e) and own.pop("doc_id") == r.doc_id
            assert own == r.s.asDict(), (r.doc_id, e)
