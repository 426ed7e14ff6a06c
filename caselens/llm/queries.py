"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_labeller, chosen_path, cover_tree, digest, equal_average, fm_index, matrix_packing, mixing, online_packing, pii_crf, quality, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_packing.packed_matrix(_table(spark, sf_dir, "documents"))


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbour_fingerprints(_table(spark, sf_dir, "documents"))


def op10_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_documents(_table(spark, sf_dir, "documents"))


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(_table(spark, sf_dir, "documents"))


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draws(_table(spark, sf_dir, "documents"))


def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.groups(_table(spark, sf_dir, "documents"), words=4)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_table(spark, sf_dir, "documents"))


def op2_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_average.clusters(_table(spark, sf_dir, "embeddings"))


def op12_fm_index_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.variants(_table(spark, sf_dir, "documents"))


def op13_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"



def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd rounds written out, each a cross product with the ``k`` centroids."""

    def assigned(r: int) -> str:
        return f"""a{r} AS (
            SELECT i, vec_id, q, c, d FROM (
                SELECT v.i, v.vec_id, v.q, m.c, v.qq + m.mm - 2 * list_inner_product(v.q, m.m) AS d, row_number() OVER (PARTITION BY v.i ORDER BY v.qq + m.mm - 2 * list_inner_product(v.q, m.m), m.c) AS r
                FROM v, c{r} m) WHERE r = 1)"""

    def moved(r: int) -> str:
        return f"""s{r} AS (SELECT c, j, floor(sum(q[j]) / count(*)) AS x FROM a{r - 1}, range(1, {dims + 1}) t(j) GROUP BY c, j),
        n{r} AS (SELECT c, list(x ORDER BY j) AS m FROM s{r} GROUP BY c),
        c{r} AS (SELECT o.c, coalesce(n.m, o.m) AS m, list_inner_product(coalesce(n.m, o.m), coalesce(n.m, o.m)) AS mm FROM c{r - 1} o LEFT JOIN n{r} n ON o.c = n.c)"""

    steps = ",\n        ".join(f"{moved(r)},\n        {assigned(r)}" for r in range(1, rounds + 1))
    return f"""
        WITH w AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS i, vec_id, q, list_inner_product(q, q) AS qq FROM w),
        c0 AS (SELECT i AS c, q AS m, qq AS mm FROM v WHERE i < {k}),
        {assigned(0)},
        {steps}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} USING (c)"""


#: crc32 by its table: a byte's entry is eight shifts, each with the reversed polynomial where the low bit is set.
_VARIANTS_SQL = f"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS entry FROM range(256) t(i)),
        runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, '{_LETTERS}', '{_LETTERS.lower()}') AS run
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{6,}}')) AS r FROM documents)),
        once AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run),
        bytes AS (
            SELECT id, run, n, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)),
                lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)) AS b FROM once),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, entry[(xor(c, x) & 255) + 1]), 4294967295)) AS h FROM bytes, crc),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        without AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
        known AS (
            SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        path AS (SELECT word, word AS at FROM known UNION ALL SELECT p.word, k.form FROM path p JOIN known k ON p.at = k.word WHERE k.form IS NOT NULL)
        SELECT k.word, k.form, p.at AS root, k.n, k.n_near, k.form_n
        FROM known k JOIN path p ON k.word = p.word JOIN known last ON p.at = last.word WHERE last.form IS NULL"""


_ORACLES = {
    "op12_fm_index_variants": _VARIANTS_SQL,
    "op11_equal_average_clusters": _cluster_sql(),
    "op2_cover_tree_search": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op6_chosen_path_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
        u AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT p.a, p.b FROM p JOIN s x ON p.a = x.doc_id JOIN s y ON p.b = y.doc_id WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
        r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
        FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.sh""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
