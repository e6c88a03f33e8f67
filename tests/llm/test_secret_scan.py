from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from kpiforge.llm import secret_scan
from kpiforge.llm.registry import QUERIES
from tests.conftest import SF_SMALL

KEYWORD = "password|passwd|secret|token|api_?key"


def brute(text):
    """The contract's patterns as they are written, failing matches dropped afterwards."""
    found = []
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYWORD)
    for m in re.finditer(f"""({letters})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 32]
    return [(s, e, ["assign", "access", "hex"][k]) for s, k, e in sorted(found)]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghinorstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def code(r, n=40, alphabet="0123456789abcdef"):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    with_secret = [f'{prose(r, 30)}\n{r.choice(["token", "api_key", "password"])} = "{code(r)}" {prose(r, 30)}' for _ in range(60)]
    return with_secret, [prose(r, 60) + f" {r.randint(10**6, 10**9)} {prose(r, 5)} = \"{prose(r, 1)}\"" for _ in range(60)]


def scan(spark, texts, field=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in secret_scan.scan(df, field=field).collect()}


def test_base_spans_are_the_patterns(spark):
    r = random.Random(2)
    pool = ["token", "TOKEN", "Api_Key", "apikey", "passwd", "toKen", "ſecret", "secret", "=", ":", " ", "  ", "'", '"', "AKIA", "ABCDEFGH1234", "AKIAAKIAAKIA", "0123456789abcdef", "deadbeef", "x", "é", "\U0001f511", "\n", "==", "a-b_c.d/", "İ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        assert secret_scan.base_spans(t) == brute(t)


def test_edge_cases_and_columns(spark):
    texts = [None, "", " \n", "token=12345678", "token=1234567", "é" * 50 + "a" * 32, "token = token=abcdefgh", "AKIA" + "A" * 12, "AKIA" + "A" * 11]
    got = scan(spark, texts)
    assert [[s for s in got[i] if s[2] != "crf"] for i in range(len(texts))] == [brute(t) for t in texts]
    df = spark.createDataFrame([(1, "a" * 40, "s", "d")], "doc_id long, text string, secrets string, done string")
    out = secret_scan.scan(df)
    assert out.columns == ["doc_id", "text", "secrets", "done", "secrets_"]
    assert out.first()["secrets"] == "s"
    assert secret_scan.scan(df.limit(0)).collect() == []
    assert secret_scan.train(["nothing here", ""]) is None


def test_the_field_finds_held_out_and_other_secrets_only(spark, corpus):
    with_secret, without = corpus
    field = secret_scan.train(with_secret[:40] + without[:40])
    tagger = secret_scan.Tagger(field)
    r = random.Random(11)
    assert [s for t in tagger.spans(without[40:]) for s in t] == []
    for text, spans in zip(with_secret[40:], tagger.spans(with_secret[40:])):
        assert spans == sorted(set(secret_scan._values(text)))
    # no pattern matches these: another keyword, a code too short for the hexadecimal one
    other = [f'{prose(r, 20)}\nkey = "{code(r, 26)}" {prose(r, 20)}' for _ in range(20)]
    assert not any(map(brute, other))
    hits = [spans == [(t.index('"') + 1, t.rindex('"'))] for t, spans in zip(other, tagger.spans(other))]
    assert sum(hits) >= 16


def test_added_spans_reach_the_result_beside_all_base_spans(spark, corpus):
    with_secret, without = corpus
    r = random.Random(12)
    other = [f'{prose(r, 20)}\nkey = "{code(r, 28)}" {prose(r, 20)}' for _ in range(10)]
    texts = with_secret + without + other
    # trained on another table: there, codes that no pattern matches would be tagged as clean
    got = scan(spark, texts, secret_scan.train(with_secret + without))
    assert [[s for s in got[i] if s[2] != "crf"] for i in range(len(texts))] == [brute(t) for t in texts]
    assert sum(any(s[2] == "crf" for s in got[i]) for i in range(120, 130)) >= 8
    assert not any(s[2] == "crf" for i in range(120) for s in got[i])


def test_decoding_equals_the_best_of_all_taggings():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 6)
        b, i = ([r.randint(-6, 6) for _ in range(n)] for _ in range(2))
        steps = [[0, r.randint(-4, 2), secret_scan.NEVER]] + [[r.randint(-3, 2) for _ in range(3)] for _ in range(2)]

        def value(tags):
            path = [0, *tags, 0]
            return sum(steps[x][y] for x, y in zip(path, path[1:])) + sum((0, b[k], i[k])[t] for k, t in enumerate(tags))

        best = max(value(t) for t in itertools.product(range(3), repeat=n))
        tags = secret_scan.viterbi(b, i, steps)
        assert value(tags) == best
        # positions outside the windows are outside on a best path
        enter = max(steps[0][1], steps[1][1], steps[2][1]), max(steps[1][2], steps[2][2])
        gain = np.maximum(np.array(b) + enter[0], np.array(i) + enter[1]) + max(0, steps[1][0], steps[2][0])
        near = secret_scan._windows(gain)
        assert max(value(t) for t in itertools.product(range(3), repeat=n) if all(near[k] or not tag for k, tag in enumerate(t))) == best


def test_blocks_do_not_change_results(corpus):
    with_secret, without = corpus
    tagger = secret_scan.Tagger(secret_scan.train(with_secret + without))
    texts = [*with_secret, "", *without, " ", "token"]
    alone = [tagger.spans([t])[0] for t in texts]
    assert tagger.spans(texts) == alone
    long = "\n".join(texts) * 20
    assert len(tagger.spans([long])[0]) == 20 * sum(map(len, alone))


def test_registered_query(spark):
    out = QUERIES["op13_secret_scan"](spark, SF_SMALL)
    assert out.dtypes == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    got = {r["doc_id"]: r for r in out.collect()}
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) and any(brute(t) for _, t in rows)
    for doc_id, text in rows:
        want, r = brute(text), got[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in want) for k in ("assign", "access", "hex"))
        parts = [f"{k}:{s}:{e}" for s, e, k in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(parts).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("crf:")] == parts
