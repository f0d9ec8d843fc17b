"""The text operators over the driver's tables: queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .caps import near_vectors
from .codec import encode_decode
from .language import predict_languages
from .licences import licence_summary
from .minhash import fingerprint_edits
from .mixing import draw
from .pii import personal_digest
from .quality import quality
from .runs import run_digests, with_planted_repeats
from .search import search
from .simhash import near_duplicates
from .token_counts import count_tokens
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODEL = "piece_bpe_32k.model"


def query(*tables: str, sql: str | None = None):
    """Register a function of whole tables under its own name."""

    def register(build: Callable[..., DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(*[configure(spark).read.parquet(f"{folder}/{t}.parquet") for t in tables])
        if sql is not None:
            ORACLE[build.__name__] = sql
        return build

    return register


@query("documents")
def op1_minhash(docs: DataFrame) -> DataFrame:
    return fingerprint_edits(docs)


@query("documents")
def op2_language_id(docs: DataFrame) -> DataFrame:
    return predict_languages(docs)


@query("documents")
def op3_simhash_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


@query("documents")
def op4_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, public_tokenizers.path(MODEL))


@query("documents")
def op5_quality(docs: DataFrame) -> DataFrame:
    return quality(docs)


@query(
    "pages",
    sql="""
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (
      SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top,
        list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k::INT + 1, 5))::INT) AS parts
      FROM p)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
    FROM d
    """,
)
def op6_warc_round_trip(pages: DataFrame) -> DataFrame:
    return round_trip(pages)


@query("documents")
def op7_piece_codec(docs: DataFrame) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path(MODEL), keep_ids=False, keep_text=False)


@query("embeddings")
def op8_cap_filters(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


@query("documents")
def op9_licence_scan(docs: DataFrame) -> DataFrame:
    return licence_summary(docs)


MIX_ENTROPY, MIX_EPOCHS = 0.998, 1.5


@query(
    "documents",
    sql=f"""
    WITH RECURSIVE t AS (
      SELECT doc_id, source, coalesce('=' || source, '') AS s,
        CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS tok
      FROM documents),
    tot AS (SELECT s, sum(tok)::BIGINT AS tk FROM t GROUP BY s),
    p AS (SELECT s, tk, tk / (SELECT sum(tk) FROM tot)::DOUBLE AS share FROM tot WHERE tk > 0),
    bisect(step, lo, hi) AS (
      SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
      UNION ALL
      SELECT step + 1, CASE WHEN h >= goal THEN mid ELSE lo END, CASE WHEN h >= goal THEN hi ELSE mid END
      FROM (
        SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) AS h,
          {MIX_ENTROPY} * ln(count(*)) AS goal
        FROM bisect, p WHERE step < 40 GROUP BY step, lo, hi)),
    power AS (
      SELECT CASE WHEN (SELECT -sum(share * ln(share)) >= {MIX_ENTROPY} * ln(count(*)) OR count(*) < 2 FROM p) THEN 1.0
        ELSE (SELECT lo FROM bisect WHERE step = 40) END AS e),
    w AS (
      SELECT s, tk, floor(pow(share, e) / sum(pow(share, e)) OVER () * ({MIX_EPOCHS} * (SELECT sum(tk) FROM tot)) + 0.5)::BIGINT AS budget
      FROM p, power),
    plan AS (
      SELECT s, tk, budget // tk AS blocks, budget % tk AS rest FROM w
      UNION ALL SELECT s, tk, 1, -1 FROM tot WHERE tk = 0),
    drawn AS (
      SELECT doc_id, source, t.s, unnest(range(blocks + 1)) AS block, blocks, rest, tok FROM t JOIN plan USING (s)),
    keyed AS (
      SELECT *, md5(concat_ws('|', '42', s, block::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS order_key FROM drawn),
    running AS (SELECT *, sum(tok) OVER (PARTITION BY s, block ORDER BY order_key) AS upto FROM keyed)
    SELECT doc_id, source, block, order_key FROM running WHERE block < blocks OR upto <= rest
    """,
)
def op10_temperature_mix(docs: DataFrame) -> DataFrame:
    drawn = draw(docs, epochs=MIX_EPOCHS, entropy=MIX_ENTROPY, repeats=None)
    return drawn.select("doc_id", "source", "block", "order_key")


@query("documents")
def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    return run_digests(with_planted_repeats(docs))


@query(
    "documents",
    "benchmark",
    sql=r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM documents),
    held AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
    whole AS (SELECT count(*)::BIGINT AS N_, sum(n)::BIGINT AS L_ FROM held),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, N_),
    b AS (
      SELECT item, item_id, term, count(*) AS times
      FROM (
        SELECT row_number() OVER () AS item, item_id,
          unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
      GROUP BY item, item_id, term),
    s AS (
      SELECT item, item_id, r, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * N_) // L_))))::BIGINT AS score
      FROM b JOIN tf USING (term) JOIN w USING (term) JOIN held USING (r), whole
      GROUP BY item, item_id, r, doc_id)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    WHERE rank <= 20
    """,
)
def op12_reversed_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


@query("documents")
def op13_personal_data(docs: DataFrame) -> DataFrame:
    return personal_digest(docs)
