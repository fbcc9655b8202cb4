"""The corpus queries of the driver, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), 200).drop("spans")


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    return identify(docs, train(docs.where(~held_out & F.col("doc_id").isNotNull())), held_out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), F.coalesce(_remainder(7) == 2, F.lit(False)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontamination import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_suffix_dedup, op3_language_id, op4_lm_scoring, op5_best_fit_packing, op6_quality, op7_fingerprints, op8_sharding, op9_license_scan, op10_decontamination)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""WITH RECURSIVE
w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, u.b FROM reach JOIN both_ways u ON reach.r = u.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op2_suffix_dedup": """WITH
t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM t)),
s AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM s),
r AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY 1, 2),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, a FROM runs
  UNION ALL SELECT t.doc_id, coalesce(max(b), 0), any_value(n) FROM t LEFT JOIN runs ON runs.doc_id = t.doc_id GROUP BY t.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k FROM gaps JOIN t ON t.doc_id = gaps.doc_id GROUP BY 1)
SELECT t.doc_id, any_value(t.n) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(runs.a) AS n_spans, any_value(sha256(unhex(kept.k))) AS kept_sha256
FROM t LEFT JOIN runs ON runs.doc_id = t.doc_id JOIN kept ON kept.doc_id = t.doc_id GROUP BY t.doc_id""",
}
