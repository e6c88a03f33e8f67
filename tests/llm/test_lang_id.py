from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import lang_id

SF = "/root/testdata/sf0.01"


def test_kernel_counts_shared_ngrams():
    a, b = "abcab", "bcaX"

    def grams(t):
        x = t.lower().encode()
        return {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    assert len(lang_id.ngrams(a)) == len(grams(a)) and len(lang_id.ngrams("")) == 0 and len(lang_id.ngrams("a")) == 1
    shared = len(np.intersect1d(lang_id.ngrams(a), lang_id.ngrams(b)))
    assert shared == len(grams(a) & grams(b))
    model = lang_id.fit([a, b], ["x", "y"])
    k = model.kernel([lang_id.ngrams(a)])[0]
    assert np.allclose(k, [1.0, shared / np.sqrt(len(grams(a)) * len(grams(b)))])


def test_block_products_equal_single_ones():
    texts = [f"text number {i} " * (i % 7 + 1) for i in range(600)]
    model = lang_id.fit(texts[:40], ["a" if i % 2 else "b" for i in range(40)])
    grams = [lang_id.ngrams(t) for t in texts]
    assert np.allclose(model.kernel(grams), np.concatenate([model.kernel([g]) for g in grams]), atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = lang_id.identify(docs, ~held, key=F.col("doc_id")).filter(held & F.col("lang").isNotNull())
    n, good = out.count(), out.filter("lang = lang_pred").count()
    assert n > 200 and good / n > 0.99


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 3 == 0
    wrong = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    a = lang_id.identify(docs, ~held, key=F.col("doc_id")).select("doc_id", "lang_pred", "score").collect()
    b = lang_id.identify(wrong, ~held, key=F.col("doc_id")).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_edge_cases(spark):
    rows = [
        (1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze sind hier", "de"), (3, None, "en"), (4, "", None),
        (5, "12 34 !? ...", "en"), (6, "und die", None), (None, "the dog", None), (7, "the cat " * 200_000, None), (8, "漢字", None), (8, "漢字", None),
    ]
    df = spark.createDataFrame([(*r, "x", 9.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    out = lang_id.identify(df, F.lit(True), key=F.col("doc_id"))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "lang_pred_", "score_"]
    got = {r["doc_id"]: (r["lang_pred_"], r["score_"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == got[None][0] == got[7][0] == "en" and got[2][0] == got[6][0] == "de" and got[8][0] in ("en", "de")
    assert all(0.0 <= s <= 1.0 for _, s in got.values())
    nothing = lang_id.identify(df, F.lit(False)).select("lang_pred_", "score_").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert lang_id.identify(df.limit(0), F.lit(True)).count() == 0


def test_sample_is_bounded_and_long_rows_are_left_out(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    sample = lang_id.training_sample(df, "text", "lang", F.col("doc_id"), per_label=50)
    assert len(sample) == 50 and sample == lang_id.training_sample(df.repartition(7), "text", "lang", F.col("doc_id"), per_label=50)


def test_label_with_long_rows_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "TRAIN_MAX_CHARS", 100)
    short = [(i, f"the cat sat on the mat {i}", "en") for i in range(20)]
    long = [(100 + i, f"der hund und die katze sind hier {i} " * (4 + i % 20), "de") for i in range(40)]
    copies = [(200 + i, long[0][1], "de") for i in range(5)]
    huge = [(300, "le chien et les chats sont ici " * 1000, "fr")]
    rows = short + long + copies + huge + [(400, "english words that are too long for the sample " * 10, "en"), (401, "und die katze", None), (402, "les chats sont", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sample = lang_id.training_sample(df, "text", "lang", F.col("doc_id"), per_label=20)
    assert sample == lang_id.training_sample(df.repartition(3), "text", "lang", F.col("doc_id"), per_label=20)
    by = {v: [t for t, w in sample if w == v] for v in ("en", "de", "fr")}
    assert sorted(by["en"]) == sorted(t for _, t, _ in short)
    shortest = sorted({t for _, t, v in rows if v == "de"}, key=len)
    assert 1 < len(by["de"]) and sum(map(len, by["de"])) <= 2000 and sorted(map(len, by["de"])) == [len(t) for t in shortest[: len(by["de"])]]
    assert by["fr"] == [huge[0][1][:2000]]
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(df, F.lit(True), key=F.col("doc_id")).collect()}
    assert got[100] == got[401] == "de" and got[300] == got[402] == "fr" and got[0] == "en"


def test_fit_equals_plain_ridge_regression():
    words = {"a": "red green blue sky", "b": "rot blau himmel und", "c": "rouge vert bleu ciel"}
    rows = [(f"{words[v].split()[i % 4]} {words[v].split()[(i * 7 + 1) % 4]} {i}", v) for i in range(45) for v in words]
    model = lang_id.fit([t for t, _ in rows], [v for _, v in rows], landmarks_per_lang=6)

    def grams(t):
        x = t.lower().encode()
        return {x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    def kernel(s, t):
        return len(grams(s) & grams(t)) / np.sqrt(len(grams(s)) * len(grams(t)))

    marks = [t for v in "abc" for t in [t for t, w in rows if w == v][:6]]
    k_mm = np.array([[kernel(s, t) for t in marks] for s in marks])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(s, t) for t in marks] for s, _ in rows]) @ root
    y = np.array([[float(v == w) for w in "abc"] for _, v in rows])
    x = phi - phi.mean(axis=0)
    w = np.linalg.solve(x.T @ x + lang_id.RIDGE * len(x) * np.eye(x.shape[1]), x.T @ (y - y.mean(axis=0)))
    want = np.clip(x @ w + y.mean(axis=0), 0, 1)
    assert np.allclose(model.scores([lang_id.ngrams(t) for t, _ in rows]), want, atol=1e-3)


def test_five_thousand_labels(spark):
    label = F.concat(F.lit("lang"), F.col("n"))
    own = F.concat_ws(" ", *[F.sha2(F.concat(label, F.lit(str(k))).cast("binary"), 256) for k in range(3)])
    df = spark.range(15_000).select("id", (F.col("id") % 5000).cast("string").alias("n"))
    df = df.select(F.col("id").alias("doc_id"), F.concat_ws(" ", own, F.lit("text"), "id").alias("text"), label.alias("lang"))
    sample = lang_id.training_sample(df, "text", "lang", F.col("doc_id"))
    assert len({v for _, v in sample}) == 5000 and len(sample) <= lang_id.TRAIN_ROWS
    model = lang_id.fit([t for t, _ in sample], [v for _, v in sample])
    assert len(model.langs) == 5000 and model.presence.shape[1] <= lang_id.LANDMARKS
    out = lang_id.identify(df, F.col("doc_id") < 10_000, key=F.col("doc_id")).filter("doc_id >= 10000")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9


def test_more_labels_than_rows_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "TRAIN_ROWS", 40)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 100).alias("lang"))
    sample = lang_id.training_sample(df, "text", "lang", F.col("doc_id"))
    assert len(sample) == 40 and len({v for _, v in sample}) == 40
    assert sample == lang_id.training_sample(df.repartition(5), "text", "lang", F.col("doc_id"))
    assert lang_id.identify(df, F.lit(True)).count() == 300
