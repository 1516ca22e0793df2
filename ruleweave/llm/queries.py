"""The registered queries of this package: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_search, language, license_scan, line_dedup, near_dedup, pseudonyms, quality, source_mix, token_binary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that stand elsewhere before."""
    return line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))


def op2_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items stand in which documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share at least 85 of 100 shingles of three words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100), band_rows=near_dedup.BAND_ROWS)


def op4_fuzzy_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of each document, word for word (base) and with errors."""
    spans = license_scan.license_spans(table(spark, sf_dir, "documents"))
    names = [n.label for n in license_scan.NOTICES[: license_scan.BASE]]
    sizes = F.create_map(*[F.lit(x) for n in license_scan.NOTICES for x in (n.label, float(len(n.phrase)))])
    base = F.filter("spans", lambda s: s["exact"] & s["label"].isin(names))
    places = F.transform(base, lambda s: s["first_word"].cast("long"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    likeness = F.transform("spans", lambda s: 1 - s["edits"] / sizes[s["label"]])
    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"))


def op5_pareto_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters a mix of sources by weight."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by pseudonyms of the same form."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key=b"a key for the sample tables")


def op7_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    fourth = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit_languages(docs.where(~fourth()))
    found = language.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fourth(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of two thirds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(~third()))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(third(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", exact_search.scaled(F.col("embedding")).alias("vector"))
    return exact_search.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes the blocks and reads every document's place and checksum back."""
    return token_binary.read_token_index(spark, token_binary.write_token_blocks(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_line_dedup": op1_simhash_line_dedup,
    "op2_suffix_array_decontamination": op2_suffix_array_decontamination,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_fuzzy_license_scan": op4_fuzzy_license_scan,
    "op5_pareto_source_mix": op5_pareto_source_mix,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_centroid_language": op7_centroid_language,
    "op8_gam_quality": op8_gam_quality,
    "op9_kd_tree_top_k": op9_kd_tree_top_k,
    "op10_simple8b_tokens": op10_simple8b_tokens,
}

#: A-Z lower-cased, and words of ASCII letters, digits and characters beyond ASCII (null: no words).
_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_ALNUM = rf"regexp_extract_all({_SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_BLANK = rf"regexp_extract_all({_SQL_LOWER}, '[^\x20\x09-\x0D]+')"

_SQL_CONTAMINATION = f"""
    words AS (SELECT doc_id, {_SQL_ALNUM} AS w FROM documents),
    items AS (SELECT item_id, {_SQL_ALNUM} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS v
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    places AS (
        SELECT doc_id, i, n, w[i : i + n - 1] AS v
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT len(v) AS n FROM windows))),
    found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (v)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)"""

def _sql_mix(documents: str) -> str:
    """Sizes, targets and draws of a mix of `documents`, as common table expressions; the last is `mixed`."""
    return rf"""
    drawn AS (
        SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS one
        FROM {documents}),
    counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, one) - 1 AS number FROM drawn),
    measured AS (
        SELECT *, CASE WHEN number = 0 THEN one ELSE CAST('0x' || substr(md5(one || '|' || number), 1, 13) AS BIGINT) END AS k,
            length(bin(size)) // 2 AS class
        FROM counted),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM measured GROUP BY source),
    weighed AS (
        SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2 AS cap
        FROM sizes),
    levels AS (
        SELECT *, row_number() OVER fill AS place,
            (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER below, 0))
                / CAST(sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS DOUBLE) AS level
        FROM weighed
        WINDOW fill AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST),
            below AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    settled AS (SELECT arg_min(level, place) AS level FROM levels WHERE level <= CAST(cap AS DOUBLE) / w),
    targets AS (
        SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(settled.level * w, CAST(cap AS DOUBLE))) AS target
        FROM levels, settled),
    dues AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS rest
        FROM targets),
    classes AS (SELECT source, class, CAST(sum(size) AS DOUBLE) AS words FROM measured GROUP BY source, class HAVING sum(size) > 0),
    fills AS (
        SELECT classes.*, (rest - coalesce(sum(words) OVER below, 0)) / sum(words / power(2, class)) OVER onward AS scale
        FROM classes JOIN dues ON classes.source IS NOT DISTINCT FROM dues.source
        WINDOW below AS (PARTITION BY classes.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            onward AS (PARTITION BY classes.source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    scales AS (SELECT source, arg_min(scale, class) AS scale FROM fills WHERE scale <= power(2, class) GROUP BY source),
    chances AS (
        SELECT measured.*, source_size, target, whole, rest, least(1.0, coalesce(scale, 0) / power(2, class)) AS p,
            (((k + 0.5) / 4503599627370496) / (1 - (k + 0.5) / 4503599627370496)) AS odds
        FROM measured JOIN dues ON measured.source IS NOT DISTINCT FROM dues.source LEFT JOIN scales ON measured.source IS NOT DISTINCT FROM scales.source),
    ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN odds / (p / (1 - p)) END AS v FROM chances),
    mixed AS (
        SELECT *, CAST(whole AS BIGINT) + CASE WHEN p > 0 AND sum(size) OVER drawn - size / 2 <= rest THEN 1 ELSE 0 END AS copies
        FROM ranked
        WINDOW drawn AS (PARTITION BY source ORDER BY v, k, size ROWS UNBOUNDED PRECEDING))"""


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_suffix_array_decontamination": f"""
        WITH {_SQL_CONTAMINATION}
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_SQL_BLANK} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
                ELSE list_distinct([w[i : i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
            FROM words),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""",
    "op5_pareto_source_mix": f"""
        WITH {_sql_mix('documents')}
        SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM mixed""",
    "op9_kd_tree_top_k": """
        WITH scaled AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
            FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
}
