"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import codes, decontamination, embedding_dedup, licenses, lm, mixing, neighbours, packing, quality, runs, simhash, substrings, toxicity
from faultlens.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("weight")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def _repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op11 looks at: about a tenth of the documents repeat from some word on; a document without an id does not."""
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or last or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a:a + p]
    return words[:a] + (again * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), _repeating)
    top = F.expr("reduce(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>),"
                 " (best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))")  # runs come by start, then period
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return (found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.label_errors(got.codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(got.digest()).alias("codebooks_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
seqs AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS seq FROM starts),
firsts AS (SELECT seq, min({'d': doc_id, 's': s}) AS f FROM seqs GROUP BY seq HAVING count(*) > 1),
late AS (SELECT DISTINCT q.doc_id, q.s FROM seqs q JOIN firsts USING (seq) WHERE f < {'d': q.doc_id, 's': q.s}),
covered AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM late) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN covered USING (doc_id)"""


def _op12_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds of op12 one after another: all parts against all entries of their book, then the floors of the means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT vec_id, p, x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
    SELECT vec_id, p, x, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM parts JOIN b{k} USING (p)) GROUP BY vec_id, p, x)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j)::DOUBLE[] AS c FROM (
    SELECT p, e, j, sum(y::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY p, e, j) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
    FROM parts JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256) USING (vec_id)),{",".join(steps)},
found AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c::BIGINT[], ',') AS s FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM found JOIN kept USING (vec_id), book"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
starts AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM starts),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM wins) WHERE len(ws) >= n),
seen AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM places),
hits AS (SELECT doc_id, n, s, win FROM seen WHERE win IN (SELECT win FROM wins)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits JOIN wins USING (win) WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_cube_mixing, op3_simhash_dedup, op4_license_scan, op5_best_fit_packing, op6_nearest_neighbours, op7_toxicity, op8_substring_dedup,
                                   op9_quality_classifier, op10_lm_scores, op11_periodic_runs, op12_vector_codes, op13_decontamination)}
ORACLE = {"op8_substring_dedup": OP8_SQL, "op12_vector_codes": _op12_sql(), "op13_decontamination": OP13_SQL}
