"""Queries of the operators in this folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.distributions import let
from quorvia.llm.alignment import align_documents, link_sums, piece_count
from quorvia.llm.ann import nearest
from quorvia.llm.chat import branch_conversations, conversations, format_preferences, spans_text
from quorvia.llm.common import cut, table
from quorvia.llm.languages import languages
from quorvia.llm.licenses import license_summary, scan_licenses
from quorvia.llm.media import scan_avi, write_avi
from quorvia.llm.minhash import groups
from quorvia.llm.mixing import mix_documents
from quorvia.llm.packing import pack_documents
from quorvia.llm.periods import RUN, periodic_runs
from quorvia.llm.sharding import shard_documents
from quorvia.llm.toxicity import toxicity
from quorvia.llm.urls import OWN_RULES, host_rule, judge_urls


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.octet_length(text).cast("long").alias("n_bytes")).alias("id"), "text")
    scanned = scan_avi(write_avi(docs, id_col="id", payload_col="text"), id_col="id")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.col("n_frames")),
        F.concat(F.lit("shots="), F.size("clips")),
        F.concat(F.lit("starts="), F.array_join(F.col("clips.first_frame").cast("array<string>"), ",")),
        F.concat(F.lit("peak="), F.round(F.array_max("clips.change"), 4)),
    )
    return scanned.select(
        "id.doc_id",
        "id.n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [*HOST_RULES, *OWN_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '^([^/]*[.])?((cheap|buy|discount)-pills|spam-farm|link-exchange)[.]') THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?(casino|poker|viagra)([.-][^/]*)?(/|$)|^([^/]*[.])?adult([.-][^/]*)?(/|$)') THEN 'block'
    WHEN regexp_matches(host || path, '^[^/]*/([^/]*/)*wp-login[.]php$|^[^/]*/cgi-bin/') THEN 'block'
    ELSE 'allow' END AS verdict FROM ruled
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hops")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "group_id", (F.col("doc_id") == F.coalesce("group_id", "doc_id")).alias("kept"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 6) AS BIGINT) AS prefix
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM n GROUP BY source
), r AS (
  SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(lvl) FROM r WHERE lvl <= ratio)) AS target FROM r
), t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t
), b AS (
  SELECT source, prefix, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY prefix) AS upto FROM n GROUP BY source, prefix
), e AS (
  SELECT b.source, b.prefix, b.size, b.upto - (t2.target - t2.times * t2.source_size) AS gap,
         row_number() OVER (PARTITION BY b.source ORDER BY b.prefix) AS k
  FROM b JOIN t2 ON b.source IS NOT DISTINCT FROM t2.source
  WHERE b.upto > t2.target - t2.times * t2.source_size
)
SELECT n.doc_id, n.size, t2.source_size, t2.target,
       CAST(n.size * (t2.times + CASE WHEN n.prefix < coalesce(e.prefix + CASE WHEN e.gap <= e.size - e.gap THEN 1 ELSE 0 END,
         CASE WHEN t2.target - t2.times * t2.source_size > 0 THEN 16777216 ELSE 0 END) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN t2 ON n.source IS NOT DISTINCT FROM t2.source
LEFT JOIN e ON e.source IS NOT DISTINCT FROM n.source AND e.k = 1
"""

def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(branch_conversations(conversations(table(spark, sf_dir, "conversations"))))
    return made.select("pair_id", "complete", "n_common", "prompt", "chosen", "rejected", spans_text(F.col("chosen_spans")).alias("chosen_spans"), spans_text(F.col("rejected_spans")).alias("rejected_spans"))


OP9_SQL = r"""
WITH u AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone, turn, role, text FROM conversations
), o AS (
  SELECT conv_id, lone, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM u
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY k) - 1 AS spot, count(*) OVER (PARTITION BY conv_id, lone) AS n FROM o WHERE role = 'assistant'
), w AS (
  SELECT x.conv_id, x.lone, x.k, x.role, CASE WHEN coalesce(y.text, '') <> coalesce(x.text, '') THEN y.text
         ELSE left(coalesce(x.text, ''), length(coalesce(x.text, '')) // 2) END AS text
  FROM a x JOIN a y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.lone = y.lone AND y.spot = (x.spot + 1) % x.n
  WHERE x.spot = (coalesce(x.conv_id, 0) % x.n + x.n) % x.n
), t AS (
  SELECT conv_id AS pair_id, lone, side, k, coalesce(role, '') AS raw_role, coalesce(text, '') AS raw_text,
         '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) AS head,
         replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body
  FROM (SELECT conv_id, lone, 0 AS side, k, role, text FROM o
    UNION ALL SELECT o.conv_id, o.lone, 1, o.k, o.role, o.text FROM o JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.lone = w.lone AND o.k < w.k
    UNION ALL SELECT conv_id, lone, 1, k, role, text FROM w)
), c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
m AS (
  SELECT c.pair_id, c.lone, c.k, r.k IS NOT NULL AND c.raw_role = r.raw_role AND c.raw_text = r.raw_text AS alike
  FROM c LEFT JOIN r ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.lone = r.lone AND c.k = r.k
), n AS (
  SELECT pair_id, lone, coalesce(min(k) FILTER (NOT alike) - 1, max(k)) AS n_common FROM m GROUP BY pair_id, lone
), x AS (
  SELECT t.*, n.n_common, CASE WHEN t.k <= n.n_common THEN NULL ELSE
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY t.pair_id, t.lone, side, t.k > n.n_common ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS pos
  FROM t JOIN n ON t.pair_id IS NOT DISTINCT FROM n.pair_id AND t.lone = n.lone
)
SELECT pair_id, bool_or(side = 0) AND bool_or(side = 1) AS complete, max(n_common) AS n_common,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k <= n_common), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 0 AND k > n_common), '') AS chosen,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (side = 1 AND k > n_common), '') AS rejected,
  coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || ':' || CAST(pos + length(head) + length(body) AS VARCHAR), ',' ORDER BY k)
    FILTER (side = 0 AND k > n_common AND raw_role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || ':' || CAST(pos + length(head) + length(body) AS VARCHAR), ',' ORDER BY k)
    FILTER (side = 1 AND k > n_common AND raw_role = 'assistant'), '') AS rejected_spans
FROM x GROUP BY pair_id, lone
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(scan_licenses(table(spark, sf_dir, "documents")))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the documents, by the checksum of the id, repeat from some place on."""
    at = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = (at / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = g % n
        places = F.struct(start.alias("a"), (1 + F.floor((n - start) / (3 + g % 8))).alias("p"))
        again = lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(let(places, again), " ")).otherwise(F.col("text"))

    # bound once: a filter on the text would else cut words anew for each of them
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    return docs.select("doc_id", F.when(at % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    # runs are in order of start and period, so the first of equal exponents stays
    best = F.aggregate("runs", F.lit(None).cast(RUN[6:-1]), lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenizer_path("piece_bpe_32k.model")
    aligned = align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    held = cut(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    sums = link_sums(held, piece_count(pieces))
    return held.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_nearest": op2_nearest,
    "op3_media": op3_media,
    "op4_url_filters": op4_url_filters,
    "op5_sharding": op5_sharding,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_preferences": op9_preferences,
    "op10_licenses": op10_licenses,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_languages": op13_languages,
}

ORACLE_SQL = {
    "op4_url_filters": OP4_SQL,
    "op8_mixing": OP8_SQL,
    "op9_preferences": OP9_SQL,
}
