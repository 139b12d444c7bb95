"""The thin queries over the operators of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idfiles, packing, tokens
from .common import read
from .exact import exact_duplicates
from .minhash import near_duplicates
from .passages import repeated_passages
from .quality import quality_scores
from .rules import quality_rules
from .urls import url_verdicts
from .warc import archived

#: The rules that op2 applies: host, path, action.
URL_RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=75)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS t(host, path, action)")
    return url_verdicts(read(spark, sf_dir, "pages"), rules)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024, payload="ids_crc32")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"), least=1000)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.with_crc32(idfiles.written_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_RULE_ROWS = ", ".join(map(str, URL_RULES))

ORACLE = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        p AS (SELECT doc_id, unnest(g) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
        r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
        SELECT s.doc_id, any_value(len(g))::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = s.doc_id AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
    "op2_url_filters": rf"""
        WITH rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(rhost, rpath, action)),
        rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM rest),
        fit AS (SELECT c.n, x.rhost || x.rpath AS rule, x.action,
                       row_number() OVER (PARTITION BY c.n ORDER BY length(x.rhost || x.rpath) DESC, length(x.rhost) DESC) AS k
                FROM cut c JOIN rules x ON (c.host = x.rhost OR ends_with(c.host, '.' || x.rhost)) AND starts_with(c.path, x.rpath))
        SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.action, 'allow') AS verdict
        FROM cut c LEFT JOIN fit f ON f.n = c.n AND f.k = 1""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM h)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to FROM m""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS points,
                          translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm)::BIGINT AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
