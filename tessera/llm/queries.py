"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annulus, bwt, crosspolytope, grulm, imatch, linecrf, minhash, mixing, packing, pii, positional, secrets, whitening
from .common import table

#: The session's setting that holds the key of surrogates. Without it the query takes a public one, which protects nothing.
PII_KEY = "spark.tessera.pii.key"
Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, "for the test tables only"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_linecrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeats(table(spark, sf_dir, "documents"))


def op10_grulm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grulm.score(table(spark, sf_dir, "documents"))


def op11_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(table(spark, sf_dir, "embeddings"))


def _rounds(k: int = 8, rounds: int = 10) -> str:
    """SQL of Lloyd's rounds, each spelled out."""
    d = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"SELECT v.r, v.vec_id, v.q, min(CAST({d} AS BIGINT) * {k} + c.c) AS x FROM v, c{{0}} c GROUP BY v.r, v.vec_id, v.q"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"s{i} AS (SELECT c, list(m ORDER BY j) AS q FROM (SELECT c, j, CAST(floor(sum(e)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT x % {k} AS c, unnest(q) AS e, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY 1, 2) GROUP BY c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(s{i}.q, c.q) AS q FROM c{i} c LEFT JOIN s{i} ON s{i}.c = c.c)")
    first = f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))"
    own = "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)"
    last = f"z AS (SELECT vec_id, x % {k} AS c, x // {k} AS d FROM ({near.format(rounds)}))"
    return f"""WITH {", ".join([own, first, *steps, last])}
SELECT z.vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(z.d AS BIGINT) AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON c.c = z.c"""


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_imatch": op4_imatch,
    "op5_minhash": op5_minhash,
    "op6_crosspolytope": op6_crosspolytope,
    "op7_mixing": op7_mixing,
    "op8_linecrf": op8_linecrf,
    "op9_bwt": op9_bwt,
    "op10_grulm": op10_grulm,
    "op11_positional": op11_positional,
    "op12_whitening": op12_whitening,
    "op13_annulus": op13_annulus,
}
#: Where SQL can say what an operator must return; the others are tested against plain Python or by held-out accuracy.
ORACLES: dict[str, str] = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
  e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op6_crosspolytope": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
  c AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, v.vec_id <= coalesce(c.least, v.vec_id) AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op11_positional": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  own AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS p, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
  p AS (SELECT DISTINCT p, n FROM own), sizes AS (SELECT DISTINCT n FROM p),
  grams AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
  hit AS (SELECT g.r, g.s, g.n, g.p FROM grams g JOIN p ON p.p = g.p AND p.n = g.n),
  words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM hit) GROUP BY r),
  items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT h.r, o.item_id FROM hit h JOIN own o ON o.p = h.p AND o.n = h.n) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op13_annulus": _rounds(),
}
