from __future__ import annotations

import random

from kpiforge.llm.line_dedup import dedup_lines
from tests.llm import helpers

SCHEMA = "doc_id long, text string, n_lines int, id string, row string, drops string"


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x", "y", None) for i, t in rows], SCHEMA).repartition(3)
    return dedup_lines(df)


def expect(spark, rows):
    got = sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in run(spark, rows).collect()), key=repr)
    want = sorted(((i, *x) for (i, _), x in zip(rows, helpers.dedup_lines(rows))), key=repr)
    assert got == want


def test_edge_cases(spark):
    shared = "This line is shared by many of the documents"
    rows = [
        (1, f"a\n{shared}\nb"),
        (2, f"  {shared.upper()}\t\n\nshort"),
        (3, f"{shared}\n{shared}"),  # the largest id keeps both
        (4, None),
        (5, ""),
        (None, f"{shared}\nno id"),
        (None, f"{shared}"),
        (6, "\n\n"),
        (7, "short line\nshort line"),
        (7, "short line\nshort line"),  # a repeated row
        (8, "É" * 20 + "\n" + "x" * 19),
        (9, "É" * 20),
        (10, "é" * 20),  # another key: only A-Z are lower-cased
        (11, "É" * 20 + " \r"),
    ]
    expect(spark, rows)


def test_columns_stay_and_clashes_are_renamed(spark):
    out = run(spark, [(1, "a"), (2, None)])
    assert out.columns == ["doc_id", "text", "n_lines", "id", "row", "drops", "n_lines_", "n_dropped"]
    assert {(r["n_lines"], r["id"], r["row"], r["drops"]) for r in out.collect()} == {(7, "x", "y", None)}


def test_null_ids_and_repeated_ids_count_once(spark):
    line = "exactly the same long line everywhere"
    expect(spark, [(None, line), (None, line), (1, line)])  # two documents only
    expect(spark, [(1, line), (1, line + "\nmore"), (2, line)])
    expect(spark, [(None, line), (1, line), (2, line)])


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_very_long_text_and_hot_line(spark):
    hot = "a very hot line that a third of all documents hold"
    rows = [(i, (hot + "\n" if i % 3 == 0 else "") + helpers.prose(i, 5)) for i in range(3000)]
    rows.append((5000, "\n".join(f"own line number {k} of the long text" for k in range(50_000)) + "\n" + hot))
    expect(spark, rows)


def test_random_against_brute_force(spark):
    r = random.Random(3)
    pool = [helpers.prose(k, 6) for k in range(40)] + ["tiny", ""]
    rows = [(r.choice([None, *range(60)]), r.choice([None, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))])) for _ in range(200)]
    expect(spark, rows)
