"""The queries of this subpackage by name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, lm_score, media, mixing, ngram_join, quality, toxicity, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_winnowing": winnowing.op2_winnowing,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_language": language.op4_language,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_media": media.op8_media,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
}
ORACLE_SQL: dict[str, str] = {
    "op10_warc": """with p as (select page_id, coalesce(html, '') as body from pages), s as (select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from s)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and first < page_id then first end as refers_to from f""",
}
