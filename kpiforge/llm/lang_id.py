"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (blended spectrum: 1 to 3
UTF-8 bytes of the lower-cased text) that both contain, divided by the
geometric mean of their own n-gram counts.  A Nystroem map on bounded
landmark documents turns it into features for one-versus-rest kernel ridge
regression.  Training uses a bounded sample of labelled rows and runs on
the driver, in blocks of rows, so its memory does not grow with the number
of labels times rows; prediction is distributed and scores whole texts with batched
matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, prepare, unboxed, written

N_MAX = 3
LANDMARKS_PER_LANG = 24
# Landmarks in all: with many languages each has fewer, and beyond this number some have none (they are still learned).
LANDMARKS = 512
# Bounds of the training sample: rows per language, and characters per row.
# Longer labelled rows are chosen only for a language that has no others, up
# to the same number of characters in all; chosen rows are used whole.
TRAIN_PER_LANG = 300
TRAIN_MAX_CHARS = 20_000
# Rows of the sample in all: with many languages each gives fewer, at least one; languages beyond this number
# (the last by a hash of the name) are not learned.
TRAIN_ROWS = 20_000
RIDGE = 1e-3
UNKNOWN = "und"
BLOCK = 256


def ngrams(text: str) -> np.ndarray:
    """Sorted distinct codes of the 1- to 3-byte n-grams of the lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
    if not len(b):
        return b
    two = (b[:-1] << 8) + b[1:]
    three = (two[:-1] << 8) + b[2:] if len(b) > 2 else b[:0]
    codes = np.concatenate([b, two + (1 << 8), three + (1 << 8) + (1 << 16)])
    codes.sort()
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])]


@dataclass
class LanguageModel:
    """Landmarks' n-gram vocabulary, presence matrix and regression weights."""

    langs: list[str]
    vocab: np.ndarray  # sorted codes of all n-grams of the landmarks
    presence: np.ndarray  # vocabulary x landmarks, 0/1
    sizes: np.ndarray  # n-grams of each landmark
    alpha: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Normalised kernel of documents with the landmarks, as one matrix product a block."""
        out = np.zeros((len(grams), len(self.sizes)), dtype=np.float32)
        for start in range(0, len(grams), BLOCK):
            part = grams[start : start + BLOCK]
            x = np.zeros((len(part), len(self.vocab)), dtype=np.float32)
            flat = np.concatenate(part)
            rows = np.repeat(np.arange(len(part)), [len(g) for g in part])
            at = np.minimum(np.searchsorted(self.vocab, flat), len(self.vocab) - 1)
            known = self.vocab[at] == flat
            x[rows[known], at[known]] = 1.0
            own = np.maximum([len(g) for g in part], 1).astype(np.float32)
            out[start : start + BLOCK] = (x @ self.presence) / np.sqrt(own[:, None] * self.sizes[None, :])
        return out

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.kernel(grams) @ self.alpha + self.bias, 0.0, 1.0)


def fit(texts: list[str], labels: list[str], landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on a bounded sample; None if it is empty.

    The first ``landmarks_per_lang`` rows of each label are the landmarks,
    fewer where there are so many labels that LANDMARKS would be exceeded.
    """
    grams = [ngrams(t) for t in texts]
    use = [i for i, g in enumerate(grams) if len(g)]
    grams, labels = [grams[i] for i in use], [labels[i] for i in use]
    if not grams:
        return None
    langs = sorted(set(labels))
    number = {lang: k for k, lang in enumerate(langs)}
    label = np.array([number[v] for v in labels])
    marks = _landmarks(label, len(langs), landmarks_per_lang)
    vocab = np.unique(np.concatenate([grams[i] for i in marks]))
    presence = np.zeros((len(vocab), len(marks)), dtype=np.float32)
    for k, i in enumerate(marks):
        presence[np.searchsorted(vocab, grams[i]), k] = 1.0
    sizes = np.array([len(grams[i]) for i in marks], dtype=np.float32)
    model = LanguageModel(langs, vocab, presence, sizes, np.zeros((len(marks), len(langs)), np.float32), np.zeros(len(langs), np.float32))
    k_mm = model.kernel([grams[i] for i in marks]).astype(float)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2), up to a rotation
    # a row's features are used for sums only; a label's column of ones and zeros is never written out
    n, width = len(grams), root.shape[1]
    phi = np.concatenate([model.kernel(grams[i : i + BLOCK]).astype(float) @ root for i in range(0, n, BLOCK)])
    mean_phi, mean_y = phi.mean(axis=0), np.bincount(label, minlength=len(langs)) / n
    phi -= mean_phi
    by_label = np.zeros((len(langs), width))
    np.add.at(by_label, label, phi)  # centred features times labels; the labels' means add nothing to centred columns
    weights = np.linalg.solve(phi.T @ phi + ridge * n * np.eye(width), by_label.T)
    model.alpha = (root @ weights).astype(np.float32)
    model.bias = (mean_y - mean_phi @ weights).astype(np.float32)
    return model


def _landmarks(label: np.ndarray, n_langs: int, per_lang: int) -> list[int]:
    """The first rows of every language, LANDMARKS in all: of languages evenly spaced by name if there are more."""
    per_lang = max(1, min(per_lang, LANDMARKS // n_langs))
    order = np.argsort(label, kind="stable")
    begin = np.searchsorted(label[order], np.arange(n_langs + 1))
    used = np.unique(np.linspace(0, n_langs - 1, min(n_langs, LANDMARKS)).astype(int))
    return [int(i) for k in used for i in order[begin[k] : min(begin[k + 1], begin[k] + per_lang)]]


def training_sample(docs: DataFrame, text_col: str, label_col: str, key: Column, per_label: int = TRAIN_PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_label`` labelled rows of each label, chosen by a hash of ``key``, TRAIN_ROWS in all.

    Counts per label thin the rows by hash first, so the ranking never
    gathers a label's rows in one task, whatever the table's size.  A label
    whose rows are all longer than TRAIN_MAX_CHARS gives its shortest ones.
    Labels are counted in a table; the driver sees their number and the
    chosen rows only.
    """
    label, text = F.col(f"`{label_col}`"), F.col(f"`{text_col}`").cast("string")
    # null or blank text holds no n-grams of a language
    every = docs.filter(label.isNotNull() & text.rlike(r"\p{L}")).select(
        label.cast("string").alias("label"), text.alias("text"), F.xxhash64(key).alias("h"), F.length(text).alias("chars")
    )
    counted = every.groupBy("label").agg(F.count_if(F.col("chars") <= TRAIN_MAX_CHARS).alias("n"))
    counts = written(counted.groupBy(F.xxhash64("label").alias("code")).agg(F.sum("n").alias("n")), "labels")
    n_labels = counts.count()
    if not n_labels:
        return []
    per_label = max(1, min(per_label, TRAIN_ROWS // n_labels))
    # two numbers a label, of TRAIN_ROWS labels at most
    chosen = F.broadcast(counts.orderBy("code").limit(TRAIN_ROWS) if n_labels > TRAIN_ROWS else counts)
    coded = every.withColumn("code", F.xxhash64("label"))
    rows = coded.filter(F.col("chars") <= TRAIN_MAX_CHARS).join(chosen, "code")
    share = F.least(F.lit(1.0), F.lit(3.0 * per_label) / F.col("n"))
    keep = F.pmod("h", F.lit(1_000_003)) <= F.floor(share * 1_000_003)
    ranked = rows.filter(keep).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "text")))
    picked = ranked.filter(F.col("k") <= per_label).orderBy("label", "k").select("text", "label").collect()
    sample = [(r["text"], r["label"]) for r in picked]
    if counts.filter("n = 0").limit(1).count():
        sample += _long_rows(coded.join(chosen.filter("n = 0"), "code"), per_label)
    return sample


def _long_rows(rows: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """The shortest distinct texts of the labels in ``rows``, of ``per_label * TRAIN_MAX_CHARS`` characters in all for each.

    A label's shortest text is always taken (cut to that bound if it is
    longer).  Ranking reads lengths and hashes of texts only.
    """
    bound = per_label * TRAIN_MAX_CHARS
    rows = rows.select("code", "label", "text", "chars", F.xxhash64("text").alias("hash"))
    order = Window.partitionBy("code").orderBy("chars", "hash")
    ranked = rows.select("code", "chars", "hash").distinct().withColumn("k", F.row_number().over(order))
    taken, total = [], {}
    for r in ranked.filter(F.col("k") <= per_label).orderBy("code", "k").collect():
        total[r["code"]] = total.get(r["code"], 0) + r["chars"]
        if r["k"] == 1 or total[r["code"]] <= bound:
            taken.append((r["code"], r["chars"], r["hash"]))
    chosen = F.broadcast(rows.sparkSession.createDataFrame(taken, "code long, chars int, hash long"))
    keys = ["label", "chars", "hash"]
    texts = rows.join(chosen, ["code", "chars", "hash"]).groupBy(keys).agg(F.min(F.substring("text", 1, bound)).alias("text"))
    return [(r["text"], r["label"]) for r in texts.orderBy(keys).collect()]


def _predictor(model: LanguageModel | None):
    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        langs, scores = [UNKNOWN] * len(values), np.zeros(len(values))
        use = [i for i, t in enumerate(values) if t and any(map(str.isalpha, t))]
        if model is not None:
            for start in range(0, len(use), BLOCK):
                part = use[start : start + BLOCK]
                s = model.scores([ngrams(values[i]) for i in part])
                best = s.argmax(axis=1)
                for i, k, v in zip(part, best, s[np.arange(len(part)), best]):
                    langs[i], scores[i] = model.langs[k], v
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return run


def identify(
    docs: DataFrame,
    train: Column,
    text_col: str = "text",
    label_col: str = "lang",
    key: Column | None = None,
) -> DataFrame:
    """Predict the language of every whole text; adds ``lang_pred`` and ``score``.

    The model learns from text and label of at most TRAIN_PER_LANG rows of
    each label, TRAIN_ROWS in all, where ``train`` holds (chosen by a hash of ``key``, by default
    the text; the shortest of a label whose rows all have more than
    TRAIN_MAX_CHARS characters).  Only the text is an input of a prediction.

    Edge cases: null, empty or letterless text, and every text when there
    are no labelled rows, gives ``und`` with score 0; equal texts get equal
    results; texts of any length are used whole; rows are never dropped; a
    clashing column name gets underscores.
    """
    prepare(docs.sparkSession)
    sample = training_sample(docs.filter(train), text_col, label_col, key if key is not None else F.col(f"`{text_col}`"))
    model = fit([t for t, _ in sample], [v for _, v in sample])
    text = F.col(f"`{text_col}`").cast("string")
    # nondeterministic only in name: else a filter on the result would run the prediction a second time
    whole = boxed(docs, done=_predictor(model).asNondeterministic()(text))
    return unboxed(whole, docs.columns, add={"lang_pred": F.col("done")["lang"], "score": F.col("done")["score"]})
