"""The queries that apply the operators to whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_path() -> str:
    """The vocabulary file of the queries; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    docs = common.table(spark, sf_dir, "documents")
    out = common.fresh_dir(spark, "token-ids")
    tokens.write(docs, out, tokenizer_path())
    return tokens.read(spark, out).withColumnRenamed("key", "doc_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngrams

    found = ngrams.score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.classify(common.only(docs, doc_id="doc_id", text="text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import surrogates

    docs = common.only(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return surrogates.replace(docs)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.cluster(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    found = substrings.dedup(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    out = common.fresh_dir(spark, "warc")
    warc.archive(common.table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    found = mixing.plan(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position")).orderBy("position", "doc_id")


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_surrogates": op2_surrogates,
    "op3_simhash": op3_simhash,
    "op4_topk": op4_topk,
    "op5_lm_scores": op5_lm_scores,
    "op6_toxicity": op6_toxicity,
    "op7_substrings": op7_substrings,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

def _time_sql(asked: str, schedule) -> str:
    """The time at which a share of a source's words has been asked for, as mixing's."""
    from .mixing import _pieces

    out, follows = None, None
    for t, f, slope, before in reversed(_pieces(schedule)):
        due = f"greatest({asked} - {before!r}::DOUBLE, 0)"
        step = f"CASE WHEN {due} = 0 THEN 0 ELSE 2 * {due} / ({f!r}::DOUBLE + sqrt(greatest({f * f!r}::DOUBLE + {due} * {2 * slope!r}::DOUBLE, 0))) END"
        here = f"{t!r}::DOUBLE + {step}"
        out = here if out is None else f"CASE WHEN {asked} < {follows!r}::DOUBLE THEN {here} ELSE {out} END"
        follows = before
    return f"least({out}, 1)"


def _mixing_sql() -> str:
    from .mixing import SCHEDULES, WEIGHTS

    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    turns = " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(WEIGHTS))
    times = " ".join(f"WHEN {i} THEN {_time_sql('asked', s)}" for i, s in enumerate(SCHEDULES))
    return rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(concat_ws(chr(31), '7', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source
        ), r AS (
            SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM s
        ), w AS (
            SELECT *, CASE sid % {len(WEIGHTS)} {turns} END AS weight FROM r
        ), u AS (
            SELECT *, 2 * n / weight AS brim FROM w
        ), l AS (
            SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(n) OVER (ORDER BY brim, sid {before}), 0) * 2)
                      / sum(weight) OVER (ORDER BY brim, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM u
        ), v AS (
            SELECT arg_min(lvl, sid) AS level FROM (SELECT lvl, row_number() OVER (ORDER BY brim, sid) AS sid FROM l WHERE brim > lvl)
        ), t AS (
            SELECT source, sid, n AS source_size, least(2.0::DOUBLE * n, coalesce(weight * level, 'inf'::DOUBLE)) AS target FROM l, v
        ), o AS (
            SELECT doc_id, size, h, sid, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
                   coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id NULLS FIRST, size {before}), 0)::BIGINT AS sofar
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), f AS (
            SELECT *, target - whole * source_size AS rest, whole < 2 AND sofar + size <= target - whole * source_size AS front,
                   whole < 2 AND sofar < target - whole * source_size AND sofar + size > target - whole * source_size AS across FROM o
        ), g AS (
            SELECT sid, any_value(rest) - coalesce(sum(size) FILTER (front), 0) AS gap, coalesce(max(size) FILTER (across), 0) AS one FROM f GROUP BY sid
        ), x AS (
            SELECT f.*, gap, one, whole < 2 AND NOT front AND NOT across AND size <= gap / 8 AS little FROM f JOIN g USING (sid)
        ), y AS (
            SELECT *, little AND coalesce(sum(CASE WHEN little THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY h, doc_id NULLS FIRST, size {before}), 0) + size / 2.0::DOUBLE < gap AS filler FROM x
        ), z AS (
            SELECT sid, abs(any_value(gap) - any_value(one)) < abs(any_value(gap) - coalesce(sum(size) FILTER (filler), 0)) AS by_across FROM y GROUP BY sid
        ), c AS (
            SELECT *, whole + (front OR across AND by_across OR filler AND NOT by_across)::BIGINT AS copies,
                   CASE WHEN target > 0 THEN least((sofar + size / 2.0::DOUBLE) / target, 1) ELSE 0 END AS asked FROM y JOIN z USING (sid)
        )
        SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size AS taken, copies,
               CASE WHEN copies > 0 THEN round(CASE sid % {len(SCHEDULES)} {times} END, 9) END AS position
        FROM c
    """


#: DuckDB SQL for those that it can express.
ORACLE_SQL: dict[str, str] = {
    "op10_mixing": _mixing_sql(),
    "op7_substrings": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50
        ), g AS (
            SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS k FROM p
        ), least AS (
            SELECT k, min(doc_id) AS least FROM g GROUP BY k
        ), gone AS (
            SELECT DISTINCT doc_id, s + unnest(range(50)) AS i FROM g JOIN least USING (k) WHERE doc_id > least
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op5_lm_scores": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), o AS (
            SELECT doc_id, unnest(w) AS b, unnest(list_prepend(NULL, w)[1:len(w)]) AS a,
                   unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS z FROM d WHERE len(w) > 0
        ), one AS (
            SELECT b AS w, count(*) AS n FROM o GROUP BY b
        ), two AS (
            SELECT a, b, count(*) AS n FROM o WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2
        ), three AS (
            SELECT z, a, b, count(*) AS n FROM o WHERE z IS NOT NULL GROUP BY z, a, b HAVING count(*) >= 2
        ), s AS (
            SELECT o.doc_id,
                   CASE WHEN three.n IS NOT NULL THEN log10(three.n) - log10(before.n)
                        ELSE CASE WHEN o.z IS NULL THEN 0 ELSE log10(0.4) END
                           + CASE WHEN two.n IS NOT NULL THEN log10(two.n) - log10(ca.n)
                                  ELSE CASE WHEN o.a IS NULL THEN 0 ELSE log10(0.4) END + log10(cb.n) - log10((SELECT count(*) FROM o)) END END AS s
            FROM o JOIN one cb ON cb.w = o.b LEFT JOIN one ca ON ca.w = o.a LEFT JOIN two ON two.a = o.a AND two.b = o.b
            LEFT JOIN two before ON before.a = o.z AND before.b = o.a LEFT JOIN three ON three.z = o.z AND three.a = o.a AND three.b = o.b
        ), t AS (
            SELECT doc_id, count(*) AS n_words, sum(s) AS s FROM s GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(round(s, 4), 0) AS log10_score, round(s / n_words, 6) AS mean_log10
        FROM d LEFT JOIN t USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS data FROM pages
        ), q AS (
            SELECT page_id, octet_length(data) AS payload_bytes, sha256(data) AS payload_digest FROM p
        ), r AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
        FROM r
    """,
}
