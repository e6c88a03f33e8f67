"""Queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import best_fit, bm25, bpe, cover_tree, jaccard_join, lang_id, line_dedup, periodic_runs, secret_scan, sharding, token_output, vector_codes, warc
from kpiforge.llm.common import prepare
from kpiforge.session import scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(_read(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.json"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    return warc.read_archives(warc.write_archives(_read(spark, sf_dir, "pages"), folder), folder)


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"), 16)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), *_vocabulary("byte_bpe_50k.tiktoken"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter(F.col("doc_id") % 100 == 0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    out = lang_id.identify(docs.select("doc_id", "text", "lang"), ~held_out, key=F.col("doc_id"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as matrices, then read back: a row per sequence with the documents and pieces in it."""
    docs = _read(spark, sf_dir, "documents")
    folder = scratch_path(spark, "token-matrices")
    index = token_output.write_token_matrices(docs, folder, *_vocabulary("byte_bpe_50k.json"))
    read = token_output.read_checksums(index, folder)
    return read.select(
        F.monotonically_increasing_id().alias("sequence_id"), "doc_ids", "pieces", "starts", "cu_seqlens", "position_resets", "n_tokens", "ids_crc32"
    )


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a hash of the id, repeat a stretch of their own words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size("words").cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    docs = docs.withColumn("a", a).withColumn("p", p)
    return docs.select("doc_id", F.when(F.size("words") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(_with_planted_periods(_read(spark, sf_dir, "documents")))
    # greatest exact exponent first: a / b > c / d is a * d > c * b
    better = F.aggregate(
        "runs",
        F.lit(None).cast(periodic_runs.RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.col("top")
    return found.withColumn("top", better).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != secret_scan.ADDED)
    counts = [number(k) for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
), n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON v.vec_id = least.x LEFT JOIN n ON v.vec_id = n.x
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keep FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(x, CAST(i // 8 * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s
), t AS (SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.y) AS component_id
FROM n JOIN reach ON n.doc_id = reach.x GROUP BY n.doc_id, n.n
"""

OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), bad AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, bad.k IS NOT NULL AND l.doc_id <> bad.keep AS dropped FROM l LEFT JOIN bad ON l.k = bad.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


# Pairs of equal 5-word shingles in a text give, for every distance, islands of equal words at that distance.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h
  FROM documents
), e AS (
  SELECT doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS plant, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d
), f AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM e
), w AS MATERIALIZED (
  SELECT doc_id, CASE WHEN plant THEN list_transform(range(len(ws)), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM f
), t AS MATERIALIZED (
  SELECT doc_id, len(ws) AS n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM w, LATERAL (SELECT unnest(range(len(ws) - 4)) AS i) WHERE len(ws) >= 6
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 5 + q AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle
), enough AS MATERIALIZED (SELECT * FROM island WHERE e - s >= greatest(6, 4 * q)
), run AS MATERIALIZED (
  SELECT * FROM enough r WHERE NOT EXISTS (
    SELECT 1 FROM enough o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.e >= r.e)
), best AS (
  SELECT doc_id, s, e - s AS l, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(e - s AS DOUBLE) / q DESC, s, q) = 1
), digest AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w) w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i
  WHERE gone.i IS NULL GROUP BY w.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN digest USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other: assign by exact distance and index, then floor means."""
    ctes = [
        """
ok AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        f"""
p AS MATERIALIZED (
  SELECT vec_id, label, i AS part, v[i * (len(v) // {parts}) + 1 : (i + 1) * (len(v) // {parts})] AS x FROM ok, range({parts}) r(i)
)""",
        f"""
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS e FROM p QUALIFY k < {entries}
)""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min(struct_pack(d := d, k := k)) AS b FROM (
    SELECT vec_id, label, p.part, x, k, CAST(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN c{r} USING (part)) GROUP BY ALL
)"""
        )
        if r < rounds:
            ctes.append(
                f"""
c{r + 1} AS MATERIALIZED (
  SELECT part, k, coalesce(m.e, old.e) AS e FROM c{r} old LEFT JOIN (
    SELECT part, k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM (
      SELECT part, k, pos, CAST(sum(xi) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT part, b.k AS k, unnest(x) AS xi, generate_subscripts(x, 1) AS pos FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) m USING (part, k)
)"""
            )
    return (
        "WITH "
        + ",".join(ctes)
        + f""",
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, k)) AS h FROM c{rounds}),
done AS (
  SELECT vec_id, label, string_agg(printf('%02x', b.k), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM done
"""
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_warc": op3_warc,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bm25_search": op7_bm25_search,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_output": op10_token_output,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_vector_codes": _op12_sql(),
}
