"""Every registered query against its DuckDB oracle, and the pipeline against brute force."""

from __future__ import annotations


import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from kpiforge.llm.registry import ORACLES, QUERIES
from tests import oracle_harness
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, key):
    ok, n, _, detail = oracle_harness.compare(spark, oracle_harness.duck(SF), key, QUERIES[key], ORACLES[key], SF)
    assert ok and n, detail


def test_one_query_per_operator_and_the_pipeline():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    rows = [(i, text) for (i, _), (text, _, _) in zip(rows, helpers.dedup_lines(rows))]
    _, root = helpers.jaccard_roots([t for _, t in rows])
    least: dict = {}
    for (i, _), c in zip(rows, root):
        least[c] = min(least.get(c, i), i)
    kept = {i: t for (i, t), c in zip(rows, root) if least[c] == i or not helpers.shingles(t)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    out = corpus_pipeline.run(spark, SF).toPandas()
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert out.groupby("doc_id").length.sum().to_dict() == want
    rooms = out.sort_values("offset").groupby("sequence_id")
    assert rooms.length.sum().max() <= 1024
    assert all((g.length.cumsum() - g.length == g.offset).all() for _, g in rooms)
    assert rooms.ngroups <= 1.02 * helpers.best_fit_decreasing(out.length.tolist(), 1024) + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in docs.schema.fields]


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "s", 3), (2, "", "en", None, 0), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14), (4, "the other text", None, "s", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        n = d.count()
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        assert (d.count() > 0) == (n > 0)


def test_language_stage_without_labels_keeps_documents(spark):
    rows = [(1, None, None, "s", None), (2, "", None, "s", 0), (3, "12 ?!", None, "s", 5), (4, "the cat sat", None, "s", 11), (None, "漢字", None, "s", 2), (4, "the cat sat", None, "s", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.identify_language(spark, docs, SF).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(rows[3:], key=repr)
    labelled = spark.createDataFrame([*rows, (5, "a dog and a cat", "en", "s", 15), (6, "99", "en", "s", 2)], schema)
    out = corpus_pipeline.identify_language(spark, labelled, SF).collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in out) == [(0, "en"), (4, "en"), (4, "en"), (5, "en")]


def test_stages_keep_columns_that_clash_with_working_names(spark):
    """Columns named like those that operators add are neither read nor changed, and no document is lost by them."""
    names = ["lang_pred", "lang_label", "score", "key", "component_id", "n_shingles", "row", "whole", "label", "n_lines", "n_dropped"]
    texts = ["the cat sat on the mat and the dog sat on it", "el gato se sienta en la casa de la ciudad", "another text about something else entirely, more or less", "99"]
    rows = [(k, t, "es" if k == 1 else "en", "s", len(t)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    odd = spark.createDataFrame([(*r, *["und"] * len(names)) for r in rows], schema + "".join(f", {n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, odd = stage(spark, docs, SF), stage(spark, odd, SF)
        assert sorted(map(tuple, odd.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
        assert odd.columns[5:] == names and {r[n] for r in odd.collect() for n in names} == {"und"}
    assert docs.count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= 3
