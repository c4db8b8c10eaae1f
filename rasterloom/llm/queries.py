"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, pii, secrets, sharding, simhash, token_counts, topk, warc

#: The tokenizer's file; it is read where it is and not kept here.
TOKENIZER = os.environ.get("TOKENIZER_FILE") or str(public_tokenizers.path("byte_bpe_50k.json"))


#: The session's setting for the secret of the pseudonyms. Unset: a random one, kept for the session.
KEY_SETTING = "spark.rasterloom.pseudonym.key"


def pseudonym_key(spark: SparkSession) -> str:
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, uuid.uuid4().hex)
    return spark.conf.get(KEY_SETTING)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), 24)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size")
    crc = F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    return placed.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_table(spark, sf_dir, "documents"), pseudonym_key(spark), keep=["doc_id", "text"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr(topk.quantised("embedding")).alias("vec"))
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), 20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(_table(spark, sf_dir, "documents"), TOKENIZER)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.inline("leaks"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, langid.train(docs), keep=["doc_id", "held_out"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
}

def _case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def _found(order: int, kind: str, pattern: str, holds: str = "true", group: int = 0) -> str:
    """Spans of an expression: what stands between matches and the matches' own lengths give the places in code points."""
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, CAST(list_sum(list_transform(piece[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(whole[i]) AS n
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS part, string_split_regex(t, '{pattern}') AS piece FROM d)) WHERE {holds}"""


_WORDS = "|".join([*map(_case, ("password", "passwd", "secret", "token")), f"{_case('api')}_?{_case('key')}"])
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, 31), lambda q: ascii(body[q])::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"
_SECRETS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    kw AS (SELECT rid, doc_id, unnest(range(1, len(word) + 1)) AS i, word, piece FROM (SELECT rid, doc_id, regexp_extract_all(t, '(?:gh[pousr]|npm)_') AS word, string_split_regex(t, '(?:gh[pousr]|npm)_') AS piece FROM d)),
    rn AS (SELECT *, regexp_extract(piece[i + 1], '^[A-Za-z0-9]*') || CASE WHEN regexp_matches(piece[i + 1], '^[A-Za-z0-9]*$') AND i < len(word) THEN word[i + 1][:3] ELSE '' END AS run FROM kw),
    ct AS (SELECT rid, doc_id, 3 AS ord, 'crc_token' AS kind, CAST(list_sum(list_transform(piece[:i], lambda x: length(x))) + 4 * (i - 1) AS BIGINT) AS a, 40 AS n, run[:30] AS body, run[31:] AS sum6 FROM rn WHERE length(run) = 36),
    cc AS (SELECT *, {_CRC} AS crc FROM ct),
    f AS ({" UNION ALL ".join([
        _found(0, "assign", f"({_WORDS})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "length(part[i]) >= 6", 2),
        _found(1, "access", "AKIA[A-Z0-9]+", "length(whole[i]) >= 20"),
        _found(2, "hex", "[0-9a-f]+", "length(whole[i]) >= 24"),
        _found(4, "web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
        _found(5, "private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    ]).replace("SELECT doc_id,", "SELECT rid,").replace("(SELECT doc_id,", "(SELECT rid,")}
      UNION ALL SELECT rid, ord, kind, a, n FROM cc WHERE list_reduce(list_transform(range(0, 6), lambda q: '{_DIGITS}'[CAST(crc // CAST(62 ** (5 - q) AS UBIGINT) % 62 AS BIGINT) + 1]), lambda x, y: x || y) = sum6),
    g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
      string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""

ORACLE_SQL: dict[str, str] = {
    "op10_secrets": _SECRETS_SQL,
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
          CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    "op5_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
