"""Registered queries over what a run writes down: scoring traces, serialised chats, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.functions.chat_check import STYLES, first_differing_byte, serialization_fault, token_diagnostics
from quorvia.functions.distributions import classify_conflict, js_divergence, option_labels, override_normalized
from quorvia.functions.prompts import CONDITIONS, serialize_messages
from quorvia.operators.full_rows import COMPONENTS, full_row_rules
from quorvia.operators.metrics import UNIT, with_references
from quorvia.plans import oracle as o
from quorvia.plans import survey as sv
from quorvia.plans.contracts import _STRIPPED, ROWS, at, base, ends, planted, union

#: Which model's rows, by the last character of the population, hold which fault.
TRACE_FAULTS = {
    "token paths repeat": ("AUTOMOBILE", "0"), "token path inside another": ("BUILDING", "3"), "target positions": ("FURNITURE", "4"), "predictive positions": ("HOUSEHOLD", "7"),
    "token count": ("MACHINERY", "5"), "path score": ("AUTOMOBILE", "4"), "raw score": ("BUILDING", "8"), "candidate labels": ("FURNITURE", "0"), "answer position": ("HOUSEHOLD", "3"),
    "token alias": ("MACHINERY", "8"), "prompt tokens": ("MACHINERY", "4"), "token ids": ("AUTOMOBILE", "3"),
}
COMPONENT_FAULTS = dict(zip(COMPONENTS, [("AUTOMOBILE", "5"), ("BUILDING", "5"), ("FURNITURE", "5"), ("HOUSEHOLD", "5"), ("AUTOMOBILE", "7"), ("BUILDING", "7"), ("FURNITURE", "7")], strict=True))
METRIC_FAULTS = {"country_influence": ("BUILDING", "0"), "evidence_influence": ("HOUSEHOLD", "4"), "EO_raw": ("MACHINERY", "0"), "EO_normalized": ("FURNITURE", "8")}
CLASS_FAULT = ("MACHINERY", "3")


def full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a full run as they should be: every option scored by two tokens, divergences and metrics stored."""
    cells, _, rows = base(spark, sf_dir)
    df = with_references(rows, cells).withColumn("labels", option_labels(F.size("options")))
    pivot = df.groupBy(*UNIT).agg(*[F.max(F.when(F.col("condition") == c, F.col("p"))).alias(c) for c in CONDITIONS])
    df = df.join(pivot, UNIT).withColumn("scores", F.transform("p", lambda x: F.log(x + 0.001))).withColumn("prompt_tokens", F.lit(50) + F.length("question_id"))
    start = F.col("prompt_tokens")
    one = lambda s, i: F.struct(
        F.array(100 + i, 200 + i).alias("token_ids"), F.lit(2).alias("token_count"), F.array(start, start + 1).alias("targets"), F.array(start - 1, start).alias("predictive"),
        F.array(0.25 * s, 0.75 * s).alias("log_probabilities"), s.alias("score"),
    )
    values = {name: js_divergence(a, b) for name, (a, b) in COMPONENTS.items()}
    stored = {k: F.col("divergences")[k] for k in COMPONENTS}
    to_label, to_evidence = stored["conflict_to_label_country"], stored["conflict_to_evidence_country"]
    metrics = {
        "country_influence": stored["baseline_to_label_country"] - stored["country_label_to_label_country"],
        "evidence_influence": stored["baseline_to_label_country"] - stored["evidence_to_label_country"],
        "EO_raw": to_label - to_evidence,
        "EO_normalized": override_normalized(to_label, to_evidence, js_divergence("label_reference", "evidence_reference")),
    }
    as_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    df = df.withColumn("divergences", as_map(values)).withColumn("metrics", as_map(metrics))
    return df.select(
        *UNIT, "condition", "p", "label_reference", "evidence_reference", "labels", "prompt_tokens", start.alias("answer_target"), (start - 1).alias("answer_predictive"),
        F.map_from_arrays("labels", F.transform("scores", lambda s, i: one(s, i))).alias("candidates"), F.map_from_arrays("labels", F.transform("scores", lambda s, i: F.array(100 + i, 200 + i))).alias("token_aliases"),
        F.map_from_arrays("labels", "scores").alias("raw_scores"), "divergences", "metrics", F.when(F.col("condition") == "conflict", classify_conflict(F.col("metrics")["EO_raw"])).alias("classification"),
    )


def full_rows_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a full run's rows, each broken in the rows of one model and some populations."""
    df = full_rows(spark, sf_dir)
    here = lambda rule: at(*TRACE_FAULTS[rule])

    def changed(label, c):
        first, second = label == "A", label == "B"
        ids = c["token_ids"]
        ids = F.when(here("token paths repeat") & second, F.array(F.lit(100), F.lit(200))).when(here("token path inside another") & second, F.array(F.lit(100), F.lit(200), F.lit(7))).when(here("token ids") & second, F.array(F.lit(-1), F.lit(201))).otherwise(ids)
        grown = here("token path inside another") & second
        start = F.col("prompt_tokens")
        targets = F.when(grown, F.sequence(start, start + 2)).when(here("target positions") & first, F.array(start + 1, start + 2)).otherwise(c["targets"])
        predictive = F.when(grown, F.sequence(start - 1, start + 1)).when(here("predictive positions") & first, c["targets"]).otherwise(c["predictive"])
        logs = F.when(grown, F.concat(c["log_probabilities"], F.array(F.lit(0.0)))).otherwise(c["log_probabilities"])
        logs = F.when(here("path score") & first, F.transform(logs, lambda v: v - 1e-6)).otherwise(logs)
        n = F.when(grown, 3).otherwise(c["token_count"]) + F.when(here("token count") & first, 1).otherwise(0)
        return F.struct(ids.alias("token_ids"), n.alias("token_count"), targets.alias("targets"), predictive.alias("predictive"), logs.alias("log_probabilities"), c["score"].alias("score"))

    candidates = F.transform_values("candidates", changed)
    candidates = F.when(here("candidate labels"), F.map_filter(candidates, lambda k, _: k != "A")).otherwise(candidates)
    aliases = F.transform_values(candidates, lambda k, c: F.when(here("token alias") & (k == "A"), F.reverse(c["token_ids"])).otherwise(c["token_ids"]))
    scores = F.transform_values("raw_scores", lambda k, s: F.when(here("raw score") & (k == "A"), s + 1e-6).otherwise(s))
    off = lambda faults: lambda k, v: v + sum((F.when(at(*where) & (k == name), 1e-6).otherwise(0.0) for name, where in faults.items()), F.lit(0.0))
    df = df.withColumns(
        {
            "candidates": candidates,
            "token_aliases": aliases,
            "raw_scores": scores,
            "answer_target": F.col("answer_target") + F.when(here("answer position"), 1).otherwise(0),
            "prompt_tokens": F.when(here("prompt tokens"), 0).otherwise(F.col("prompt_tokens")),
            "divergences": F.transform_values("divergences", lambda k, v: off(COMPONENT_FAULTS)(k, v)),
            "metrics": F.transform_values("metrics", lambda k, v: off(METRIC_FAULTS)(k, v)),
            "classification": F.when(at(*CLASS_FAULT) & (F.col("condition") == "conflict"), "tie").otherwise(F.col("classification")),
        }
    )
    return full_row_rules(df)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sv.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", "m")


def chat_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in four styles, most of them damaged by a rule over the id; the acceptor's first fault."""
    shown = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), serialize_messages("m", s).alias("text")) for s in STYLES]))
    df = messages(spark, sf_dir).select("conv_id", "m", shown.alias("s")).select("conv_id", "m", "s.*")
    kind, n = F.col("conv_id") % 6, F.length("text")
    opening = F.lit("")
    for s, marks in STYLES.items():
        opening = F.when(F.col("style") == s, F.lit(marks.opening * 2)).otherwise(opening)
    third = F.floor(n / 3).cast("int")
    damaged = (
        F.when(kind == 1, F.left("text", n - 1))
        .when(kind == 2, F.substring("text", F.lit(3), n))
        .when(kind == 3, F.concat(F.left("text", third), F.substring("text", 2 * third + 1, n)))
        .when(kind == 4, F.concat(opening, "text"))
        .otherwise(F.col("text"))
    )
    df = df.withColumn("text", damaged)
    fault = F.lit(None).cast("string")
    for s in STYLES:
        fault = F.when(F.col("style") == s, serialization_fault("text", "m", s)).otherwise(fault)
    return df.select("conv_id", "style", fault.alias("fault"))


def tokens_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns against changed ones: a letter with another accent in the middle, an end cut off, an opening too many.

    Tokens are the characters' code points, behind an opening id.
    """
    df = sv.table(spark, sf_dir, "conversations").where("turn = 0 AND text IS NOT NULL").select("conv_id", "text")
    half, kind = F.floor(F.length("text") / 2).cast("int"), F.col("conv_id") % 4
    made = lambda mark: F.concat(F.left("text", half), F.lit(mark), F.substring("text", half + 1, F.length("text")))
    expected = F.when(kind == 1, made("è")).when(kind == 2, F.left(made("é"), half)).otherwise(made("é"))
    df = df.select("conv_id", made("é").alias("actual"), expected.alias("expected"), kind.alias("kind"))
    ids = lambda c: F.concat(F.array(F.lit(1)), F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x)))
    df = df.select("conv_id", "actual", "expected", F.when(F.col("kind") == 3, F.concat(F.array(F.lit(1)), ids("actual"))).otherwise(ids("actual")).alias("a"), ids("expected").alias("b"))
    found, byte = token_diagnostics("a", "b", 1), first_differing_byte("actual", "expected")
    df = df.select("conv_id", found.alias("d"), byte.alias("byte"))
    return df.select(
        "conv_id", "d.equal", "d.n_actual", "d.n_expected", "d.differs_at", "d.actual_id", "d.expected_id", "d.openings_actual", "d.openings_expected", "d.accepted",
        F.col("byte.offset").alias("byte_offset"), F.col("byte.actual").alias("actual_byte"), F.col("byte.expected").alias("expected_byte"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "full_rows_report": full_rows_report,
    "chat_faults": chat_faults,
    "token_diagnostics": tokens_apart,
}

_SUFFIXES = " ".join(f"WHEN '{s}' THEN {len(m.suffix)}" for s, m in STYLES.items())
_OPENINGS = " ".join(f"WHEN '{s}' THEN '{m.opening}'" for s, m in STYLES.items())

CHATS = rf"""
c AS (SELECT conv_id, turn, role, text AS content FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c WHERE role <> 'system'),
lead AS (SELECT conv_id, arg_min(content, turn) || chr(10) || chr(10) AS lead FROM c WHERE role = 'system' GROUP BY conv_id),
texts AS (SELECT conv_id, 'chatml' AS style, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, 'header', string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || {_STRIPPED} || '<|eot_id|>', '' ORDER BY turn)
    || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, 'turns', string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) || {_STRIPPED} || '<end_of_turn>' || chr(10), '' ORDER BY turn)
    || '<start_of_turn>model' || chr(10) FROM c GROUP BY conv_id
  UNION ALL SELECT conv_id, 'inst', '<s>' || coalesce(string_agg(CASE role WHEN 'user' THEN '[INST] ' || CASE k WHEN 1 THEN coalesce(lead, '') ELSE '' END || content || '[/INST]' ELSE ' ' || content || '</s>' END, '' ORDER BY turn), '')
    FROM n LEFT JOIN lead USING (conv_id) GROUP BY conv_id),
marked AS (SELECT *, length(text) AS n, CASE style {_OPENINGS} END AS opening, CASE style {_SUFFIXES} END AS suffix FROM texts),
damaged AS (SELECT conv_id, style, opening, suffix, right(text, suffix) AS ending, CASE conv_id % 6 WHEN 1 THEN left(text, n - 1) WHEN 2 THEN substr(text, 3) WHEN 3 THEN left(text, n // 3) || substr(text, 2 * (n // 3) + 1)
    WHEN 4 THEN opening || opening || text ELSE text END AS text FROM marked),
steps AS (
  SELECT conv_id, 'chatml' AS style, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, content, '<|im_start|>' || role || chr(10) AS head, content AS inner_text, '<|im_end|>' AS tail FROM c
  UNION ALL SELECT conv_id, 'header', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role, content, '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10), {_STRIPPED}, '<|eot_id|>' FROM c
  UNION ALL SELECT conv_id, 'turns', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role, content, '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10), {_STRIPPED}, '<end_of_turn>' FROM c
  UNION ALL SELECT conv_id, 'inst', k - 1, role, content, CASE role WHEN 'user' THEN '[INST] ' ELSE ' ' END, CASE WHEN role = 'user' AND k = 1 THEN coalesce(lead, '') ELSE '' END || content, CASE role WHEN 'user' THEN '[/INST]' ELSE '</s>' END
    FROM n LEFT JOIN lead USING (conv_id)),
judged AS (SELECT *, opening <> '' AND starts_with(text, opening) AS opened,
    CASE WHEN opening = '' THEN 0 ELSE (length(text) - length(replace(text, opening, ''))) // length(opening) END AS openings FROM damaged),
early AS (SELECT *, CASE WHEN text = '' THEN 'empty text' WHEN style = 'inst' AND NOT opened THEN 'opening mark lacks' WHEN openings > CASE WHEN opened THEN 1 ELSE 0 END THEN 'opening mark repeats'
    WHEN suffix > 0 AND NOT ends_with(text, CASE style WHEN 'chatml' THEN '<|im_start|>assistant' || chr(10) WHEN 'header' THEN '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE '<start_of_turn>model' || chr(10) END) THEN 'answer boundary' END AS fault FROM judged),
walk AS (
  SELECT conv_id, style, CAST(0 AS BIGINT) AS k, CAST(CASE WHEN opened THEN length(opening) ELSE 0 END + 1 AS BIGINT) AS cursor, CAST(NULL AS VARCHAR) AS fault FROM early WHERE fault IS NULL
  UNION ALL
  SELECT conv_id, style, k + 1, CASE WHEN ends = 0 THEN 0 ELSE ends + length(tail) END,
    CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'role' WHEN content = '' THEN 'empty content' WHEN begins = 0 THEN 'opening' WHEN inner_at = 0 THEN 'content' WHEN ends = 0 THEN 'end' END
  FROM (SELECT *, CASE WHEN inner_at = 0 OR strpos(substr(text, inner_at + length(inner_text)), tail) = 0 THEN 0 ELSE inner_at + length(inner_text) + strpos(substr(text, inner_at + length(inner_text)), tail) - 1 END AS ends
    FROM (SELECT *, CASE WHEN begins = 0 THEN 0 WHEN inner_text = '' THEN begins + length(head) WHEN strpos(substr(text, begins + length(head)), inner_text) = 0 THEN 0 ELSE begins + length(head) + strpos(substr(text, begins + length(head)), inner_text) - 1 END AS inner_at
      FROM (SELECT w.conv_id, w.style, w.k, s.role, s.content, s.head, s.inner_text, s.tail, e.text, CASE WHEN strpos(substr(e.text, w.cursor), s.head) = 0 THEN 0 ELSE w.cursor + strpos(substr(e.text, w.cursor), s.head) - 1 END AS begins
        FROM walk w JOIN steps s USING (conv_id, style, k) JOIN early e USING (conv_id, style) WHERE w.fault IS NULL)))),
final AS (SELECT conv_id, style, max(k) AS k, arg_max(fault, k) AS named, arg_max(cursor, k) AS cursor, max(fault) AS fault FROM walk GROUP BY conv_id, style)"""

ORACLE_SQL = {
    "full_rows_report": o.query(
        ROWS,
        union(
            *[planted(rule, ends(*where)) for rule, where in TRACE_FAULTS.items()],
            *[planted(f"component {name}", ends(*where)) for name, where in COMPONENT_FAULTS.items()],
            *[planted(f"metric {name}", ends(*where)) for name, where in METRIC_FAULTS.items()],
            planted("classification", f"{ends(*CLASS_FAULT)} AND condition = 'conflict'"),
        ),
    ),
    "chat_faults": "WITH RECURSIVE"
    + CHATS
    + """
SELECT conv_id, style, CASE WHEN e.fault IS NOT NULL THEN e.fault WHEN f.fault IS NOT NULL THEN 'turn ' || CAST(f.k - 1 AS VARCHAR) || ': ' || f.fault
  WHEN f.cursor > length(e.text) - e.suffix + 1 THEN 'answer boundary inside the last turn' END AS fault
FROM early e LEFT JOIN final f USING (conv_id, style)""",
    "token_diagnostics": """WITH t AS (SELECT conv_id, text, length(text) // 2 AS half, conv_id % 4 AS kind FROM conversations WHERE turn = 0 AND text IS NOT NULL),
m AS (SELECT conv_id, kind, left(text, half) || 'é' || substr(text, half + 1) AS actual, CASE kind WHEN 1 THEN left(text, half) || 'è' || substr(text, half + 1) WHEN 2 THEN left(text, half) ELSE left(text, half) || 'é' || substr(text, half + 1) END AS expected FROM t),
i AS (SELECT *, list_concat(CASE kind WHEN 3 THEN [1, 1] ELSE [1] END, list_transform(string_split(actual, ''), lambda x: unicode(x))) AS a,
  list_concat([1], CASE WHEN expected = '' THEN [] ELSE list_transform(string_split(expected, ''), lambda x: unicode(x)) END) AS b, hex(encode(actual)) AS ha, hex(encode(expected)) AS hb FROM m),
p AS (SELECT *, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda j: a[j] IS DISTINCT FROM b[j])[1] AS j,
  list_filter(range(0, greatest(length(ha), length(hb)) // 2), lambda q: substr(ha, CAST(2 * q + 1 AS BIGINT), 2) <> substr(hb, CAST(2 * q + 1 AS BIGINT), 2))[1] AS q FROM i)
SELECT conv_id, a = b AS equal, CAST(len(a) AS INT) AS n_actual, CAST(len(b) AS INT) AS n_expected, CAST(j - 1 AS INT) AS differs_at, CAST(a[j] AS INT) AS actual_id, CAST(b[j] AS INT) AS expected_id,
  CAST(len(list_filter(a, lambda x: x = 1)) AS INT) AS openings_actual, CAST(len(list_filter(b, lambda x: x = 1)) AS INT) AS openings_expected, a = b AND len(list_filter(a, lambda x: x = 1)) = 1 AND a[1] = 1 AS accepted,
  q AS byte_offset, CAST(CASE WHEN 2 * q < length(ha) THEN CAST('0x' || substr(ha, CAST(2 * q + 1 AS BIGINT), 2) AS INT) END AS INT) AS actual_byte, CAST(CASE WHEN 2 * q < length(hb) THEN CAST('0x' || substr(hb, CAST(2 * q + 1 AS BIGINT), 2) AS INT) END AS INT) AS expected_byte FROM p""",
}
