"""The dashboard's items: executive (de), seller (ds), call (dc) and administration (da)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.keys import analysis_key, period
from colloquy.functions.validation import OUTPUT, evidence_gaps, needs_review, parse_output
from colloquy.operators import analysis, detail, ingest, metrics, state
from colloquy.operators.rubric import CORE_DIMENSIONS
from colloquy.plans import flow
from colloquy.plans.base import registering
from colloquy.sources import tables as T
from colloquy.sources.store import materialise, new_path

QUERIES, ORACLES = {}, {}


query = registering(QUERIES, ORACLES)


# --- executive


@query("SELECT count(*) AS discovered FROM calls", T.PRELUDE)
def de1_discovered(spark, d):
    return T.calls(spark, d).agg(F.count(F.lit(1)).alias("discovered"))


@query("SELECT count(DISTINCT call_id) AS analysed FROM results", T.PRELUDE)
def de2_analysed(spark, d):
    return T.calls(spark, d).join(T.results(spark, d), "call_id", "left_semi").agg(F.count_distinct("call_id").alias("analysed"))


@query("SELECT count(*) AS discovered, count(r.call_id) AS analysed, CAST(count(r.call_id) AS DOUBLE) / count(*) AS coverage FROM calls c LEFT JOIN results r ON r.call_id = c.call_id", T.PRELUDE)
def de3_coverage(spark, d):
    return metrics.coverage(T.calls(spark, d), T.results(spark, d))


@query("SELECT round(avg(CASE status WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END), 9) AS conversion FROM calls", T.PRELUDE)
def de4_conversion(spark, d):
    outcome = F.when(F.col("status") == "F", 1.0).when(F.col("status") == "O", 0.0)
    return T.calls(spark, d).agg(F.round(F.avg(outcome), 9).alias("conversion"))


@query("SELECT round(avg(overall_score), 9) AS mean_score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY call_date DESC, call_id DESC) AS k FROM scored) WHERE k = 1", T.PRELUDE)
def de5_mean_score(spark, d):
    return metrics.mean_score(analysis.current_runs(T.scored_calls(spark, d), ["customer_id"], F.desc("call_date"), F.desc("call_id")), "overall_score")


@query("SELECT quality, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM scored GROUP BY quality", T.PRELUDE)
def de6_opportunity_quality(spark, d):
    return metrics.mix(T.scored_calls(spark, d), "quality")


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(failures) AS reason FROM scored WHERE status = 'O') GROUP BY 1 ORDER BY n DESC, reason LIMIT 5", T.PRELUDE)
def de7_loss_causes(spark, d):
    return metrics.top_reasons(T.scored_calls(spark, d).filter("status = 'O'"), "failures", 5)


@query("SELECT seller_id, reason, count(*) AS n FROM (SELECT seller_id, unnest(failures) AS reason FROM scored) GROUP BY 1, 2", T.PRELUDE)
def de8_failures_by_seller(spark, d):
    return metrics.count_by(T.scored_calls(spark, d).select("seller_id", F.explode("failures").alias("reason")), "seller_id", "reason")


@query("SELECT CAST(date_trunc('month', call_date) AS DATE) AS month, round(avg(overall_score), 9) AS mean_score, count(*) AS n FROM scored GROUP BY 1", T.PRELUDE)
def de9_monthly_trend(spark, d):
    return metrics.mean_score(T.scored_calls(spark, d).withColumn("month", period(F.col("call_date"))), "overall_score", "month")


# --- seller


@query("SELECT seller_id, round(avg(overall_score), 9) AS mean_score, count(*) AS n FROM scored GROUP BY 1", T.PRELUDE)
def ds1_mean_score(spark, d):
    return metrics.mean_score(T.scored_calls(spark, d), "overall_score", "seller_id")


@query("SELECT call_id, seller_id, round(avg(overall_score) OVER (PARTITION BY seller_id ORDER BY call_date, call_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS rolling FROM scored", T.PRELUDE)
def ds2_trend(spark, d):
    rows = metrics.trend(T.scored_calls(spark, d), "seller_id", [F.col("call_date"), F.col("call_id")], "overall_score")
    return rows.select("call_id", "seller_id", F.round("rolling", 9).alias("rolling"))


@query("""SELECT seller_id, dimension, mean_score, best_rank, worst_rank FROM (SELECT *, dense_rank() OVER (PARTITION BY seller_id ORDER BY mean_score DESC) AS best_rank, dense_rank() OVER (PARTITION BY seller_id ORDER BY mean_score) AS worst_rank
  FROM (SELECT seller_id, dimension, round(avg(score), 9) AS mean_score FROM dims JOIN calls USING (call_id) GROUP BY 1, 2)) WHERE best_rank <= 1 OR worst_rank <= 1""", T.PRELUDE)
def ds3_dimensions(spark, d):
    means = metrics.mean_score(T.dims(spark, d).join(T.calls(spark, d).select("call_id", "seller_id"), "call_id"), "score", "seller_id", "dimension")
    return metrics.extremes(means, "seller_id", "mean_score", 1).drop("n")


@query("""SELECT seller_id, reason, count(DISTINCT call_id) AS calls FROM (SELECT seller_id, call_id, unnest(failures) AS reason FROM
  (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY call_date DESC, call_id DESC) AS n FROM scored) WHERE n <= 20) GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 5""", T.PRELUDE)
def ds4_patterns(spark, d):
    return metrics.recurring(T.scored_calls(spark, d), "seller_id", [F.desc("call_date"), F.desc("call_id")], "failures", 20, 5)


@query("SELECT * FROM (SELECT seller_id, call_id, call_date, row_number() OVER (PARTITION BY seller_id ORDER BY call_date DESC, call_id DESC) AS recency FROM scored) WHERE recency <= 10", T.PRELUDE)
def ds5_recent_calls(spark, d):
    return metrics.recent(T.scored_calls(spark, d), "seller_id", [F.desc("call_date"), F.desc("call_id")], 10).select("seller_id", "call_id", "call_date", "recency")


@query("""SELECT seller_id, reason AS action, n FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY n DESC, reason) AS k FROM
  (SELECT seller_id, reason, count(*) AS n FROM (SELECT seller_id, unnest(failures) AS reason FROM scored) GROUP BY 1, 2)) WHERE k <= 2""", T.PRELUDE)
def ds6_coaching(spark, d):
    n = metrics.count_by(T.scored_calls(spark, d).select("seller_id", F.explode("failures").alias("action")), "seller_id", "action")
    return metrics.recent(n, "seller_id", [F.desc("n"), F.col("action")], 2).drop("recency")


# --- call: from transcripts, by text rules; their scores mean nothing


#: The text rules in SQL: counts of each transcript, and the answer's fields that follow from them.
RULES = r"""
WITH seg AS (SELECT conv_id AS call_id, turn, role AS speaker, coalesce(text, '') AS text, coalesce(role, '?') || ': ' || coalesce(text, '') AS spoken FROM conversations),
counts AS (
  SELECT call_id, count(*) AS n_segments, array_to_string(list_sort(list_distinct(list(speaker))), ',') AS speakers,
         CAST(sum(len(regexp_extract_all(spoken, '[^\t-\r\x{85}\p{Z}]+'))) AS BIGINT) AS n_words, CAST(sum(length(spoken) - length(replace(spoken, '?', ''))) AS BIGINT) AS n_questions,
         CAST(sum(len(list_filter(string_split(spoken, chr(10)), lambda x: contains(x, ',')))) AS BIGINT) AS n_objections,
         sha256(string_agg(spoken, chr(10) ORDER BY turn, speaker, text)) AS text_sha256 FROM seg GROUP BY call_id),
answers AS (
  SELECT *, sha256('{"k0":' || call_id || ',"k1":"' || text_sha256 || '","k2":"rubric-1","k3":"prompt-1","k4":"rules-2","k5":0}') AS analysis_key,
         'rules-2' AS model_version, n_words + 50 AS tokens, round(n_words * 1e-6, 6) AS cost, CAST(least(100, 20 + n_words % 61 + 5 * n_questions) AS DOUBLE) AS overall_score,
         CASE WHEN n_words > 100 THEN 'qualified' ELSE 'unclear' END AS opportunity_quality, CASE WHEN n_questions > 0 THEN 'follow_up' ELSE 'lost_by_closer' END AS call_status,
         round(least(1.0, n_words / 400.0::DOUBLE), 4) AS confidence, CASE WHEN n_words > 200 THEN 'detail' ELSE '' END AS strengths,
         CASE WHEN n_questions = 0 THEN 'no questions' ELSE '' END AS critical_failures, CASE WHEN n_questions = 0 THEN 'ask open questions' ELSE '' END AS coaching_actions,
         n_words < 30 AS requires_human_review FROM counts),
lines AS (SELECT call_id, turn, speaker, unnest(string_split(spoken, chr(10))) AS line FROM seg),
evidence AS (
  SELECT call_id, CAST(turn AS INTEGER) AS timestamp, coalesce(speaker, '?') AS speaker, string_split(spoken, chr(10))[1] AS excerpt, 'opening' AS claim
  FROM seg QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY turn, speaker, text) = 1
  UNION ALL SELECT call_id, CAST(turn AS INTEGER), coalesce(speaker, '?'), line, 'objection' FROM lines WHERE contains(line, ','))
"""
FIELDS = "overall_score, opportunity_quality, call_status, confidence, strengths, critical_failures, coaching_actions, requires_human_review"
#: The head of an answer as text: lists of tags hold one or none.
HEAD = """'{"overall_score":' || overall_score || ',"opportunity_quality":"' || opportunity_quality || '","call_status":"' || call_status || '","confidence":' || confidence || ',"strengths":[' || CASE WHEN strengths = '' THEN '' ELSE '"' || strengths || '"' END
  || '],"critical_failures":[' || CASE WHEN critical_failures = '' THEN '' ELSE '"' || critical_failures || '"' END || '],"objections":[],"coaching_actions":[' || CASE WHEN coaching_actions = '' THEN '' ELSE '"' || coaching_actions || '"' END || '],"dimensions":['
  || """ + " || ',' || ".join(f"""'{{"dimension":"{x}","score":' || (overall_score + {7 * i}) % 101 || ',"weight":1.0}}'""" for i, x in enumerate(CORE_DIMENSIONS)) + """ || '],"evidence":[],"requires_human_review":' || requires_human_review || '}'"""


def joined(column):
    """A short list of tags as text."""
    return F.array_join(column, ",")


def scored(spark, d):
    """Parsed results of all conversations, from their counts alone."""
    return parse_output(analysis.rule_answers(ingest.transcript_counts(T.segments(spark, d))))


def versioned(spark, d):
    """The same with each transcript's digest and the key of its analysis, stored: several queries' parts read it."""
    key = analysis_key(F.col("call_id"), F.col("text_sha256"), F.lit("rubric-1"), F.lit("prompt-1"), F.col("model_version"))
    answers = analysis.rule_answers(ingest.normalise_transcript(T.segments(spark, d))).withColumn("analysis_key", key)
    return parse_output(materialise(answers, "answers"))


@query(f"SELECT call_id, n_segments, speakers, n_words, n_questions, text_sha256, n_objections, n_objections + 1 AS n_evidence, model_version, tokens, cost, TRUE AS valid, {FIELDS} FROM answers", RULES)
def call_detail(spark, d):
    rows = detail.call_detail(versioned(spark, d))
    return rows.withColumns({c: joined(c) for c in ("speakers", "strengths", "critical_failures", "coaching_actions")})


@query("SELECT call_id, analysis_key, model_version, tokens, cost, CAST(NULL AS VARCHAR) AS error FROM answers", RULES)
def dc1_metadata(spark, d):
    return versioned(spark, d).select("call_id", "analysis_key", "model_version", "tokens", "cost", "error")


@query("SELECT call_id, turn, speaker, line FROM lines WHERE line <> ''", RULES)
def dc2_transcript(spark, d):
    return analysis.transcript_lines(T.segments(spark, d))


@query("SELECT call_id, overall_score, confidence, call_status, opportunity_quality FROM answers", RULES)
def dc3_score(spark, d):
    return scored(spark, d).select("call_id", "result.overall_score", "result.confidence", "result.call_status", "result.opportunity_quality")


@query("SELECT call_id, strengths, critical_failures, coaching_actions FROM answers", RULES)
def dc4_feedback(spark, d):
    return scored(spark, d).select("call_id", *(joined(f"result.{c}").alias(c) for c in ("strengths", "critical_failures", "coaching_actions")))


@query("SELECT * FROM evidence", RULES)
def dc5_evidence(spark, d):
    return analysis.evidence(T.segments(spark, d))


@query("SELECT call_id, line AS objection FROM lines WHERE contains(line, ',')", RULES)
def dc6_objections(spark, d):
    return analysis.objections(T.segments(spark, d)).select("call_id", F.col("line").alias("objection"))


@query("SELECT call_id, critical_failures AS failure FROM answers WHERE critical_failures <> ''", RULES)
def dc7_failures(spark, d):
    return scored(spark, d).select("call_id", F.explode("result.critical_failures").alias("failure"))


@query(f"""SELECT call_id, analysis_key, model_version, {HEAD} AS raw_json FROM answers
  UNION ALL SELECT a.call_id, analysis_key, model_version, '{{"objections":[' || to_json(line) || ']}}' FROM answers a JOIN lines l ON l.call_id = a.call_id WHERE contains(line, ',')
  UNION ALL SELECT a.call_id, analysis_key, model_version, '{{"evidence":[{{"timestamp":' || timestamp || ',"speaker":' || to_json(speaker) || ',"excerpt":' || to_json(excerpt) || ',"claim":"' || claim || '"}}]}}' FROM answers a JOIN evidence e ON e.call_id = a.call_id""", RULES)
def dc8_versions(spark, d):
    """An answer's head (its long lists empty), then a row for each item of the lists."""
    heads, items = versioned(spark, d), analysis.rule_items(T.segments(spark, d)).withColumnRenamed("call_id", "__call")
    keys = heads.select("call_id", "analysis_key", "model_version")
    rows = keys.join(items, F.col("call_id").eqNullSafe(F.col("__call")))
    return analysis.json_history(heads).unionByName(analysis.json_history(rows))


@query("""SELECT o_custkey AS customer_id, o_orderkey AS call_id, row_number() OVER w AS run_number, c_mktsegment AS reviewer, round(o_totalprice - lag(o_totalprice) OVER w, 9) AS delta
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def dc9_history(spark, d):
    runs = analysis.run_history(T.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")
    rows = metrics.with_dims(runs, (T.table(spark, d, "customer"), "o_custkey", "c_custkey"))
    return rows.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("call_id"), "run_number", F.col("c_mktsegment").alias("reviewer"), F.round("delta", 9).alias("delta"))


@query("SELECT call_id, TRUE AS valid, '' AS problems, requires_human_review OR confidence < 0.6 AS to_review, 0 AS evidence_gaps FROM answers", RULES)
def output_validation(spark, d):
    parsed = scored(spark, d)
    items = analysis.evidence(T.segments(spark, d)).select(F.col("call_id").alias("__call"), F.array(F.struct("timestamp", "speaker", "excerpt", "claim")).alias("evidence"))
    gaps = evidence_gaps(items).groupBy("__call").agg(F.sum("evidence_gaps").cast("int").alias("evidence_gaps"))
    rows = parsed.select("call_id", "valid", joined("problems").alias("problems"), needs_review(F.col("result.requires_human_review"), F.col("result.confidence")).alias("to_review"))
    return rows.join(gaps, F.col("call_id").eqNullSafe(F.col("__call")), "left").select(*rows.columns, F.coalesce("evidence_gaps", F.lit(0)).alias("evidence_gaps"))


#: Answers that lack what an answer must have, made from the good ones by the call's number.
BROKEN = """CASE call_id % 6 WHEN 0 THEN replace(raw, '"confidence":', '"sureness":') WHEN 1 THEN replace(raw, '"follow_up"', '"maybe"') WHEN 2 THEN replace(raw, '"confidence":', '"confidence":9') WHEN 3 THEN 'no answer' WHEN 4 THEN NULL ELSE raw END"""
MISSING = ",".join(f"missing:{f.name}" for f in OUTPUT.fields)


@query(f"""SELECT call_id, CASE call_id % 6 WHEN 0 THEN 'missing:confidence,extra:sureness' WHEN 1 THEN CASE WHEN call_status = 'follow_up' THEN 'unknown:call_status' ELSE '' END WHEN 2 THEN 'range:confidence'
    WHEN 3 THEN 'corrupt,{MISSING}' WHEN 4 THEN 'corrupt,{MISSING}' ELSE '' END AS problems FROM answers""", RULES)
def invalid_answers(spark, d):
    """What validation says of absent fields, unknown values, ranges, unknown fields, broken and absent answers."""
    raw = scored(spark, d).select("call_id", F.col("raw_json").alias("raw"))
    return parse_output(raw.withColumn("raw_json", F.expr(BROKEN))).select("call_id", joined("problems").alias("problems"))


@query("SELECT call_id, dimension, (overall_score + 7 * (k - 1)) % 101 AS score, CAST(1.0 AS DOUBLE) AS weight FROM answers, (SELECT unnest(range(1, 11)) AS k, unnest([" + ", ".join(f"'{x}'" for x in CORE_DIMENSIONS) + "]) AS dimension)", RULES)
def analysis_dimensions(spark, d):
    return analysis.explode_dimensions(scored(spark, d))


# --- administration


@query("SELECT s_suppkey AS seller_id, s_name AS name, n_name AS team FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def da1_sellers(spark, d):
    rows = metrics.with_dims(T.table(spark, d, "supplier"), (T.table(spark, d, "nation"), "s_nationkey", "n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("name"), F.col("n_name").alias("team"))


@query("SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand FROM part")
def da2_products(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


@query("SELECT s_nationkey AS seller_id, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def da3_sources(spark, d):
    """Active source locations of each seller."""
    s = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("seller_id"), (F.col("s_acctbal") > 0).alias("active"))
    return metrics.count_by(ingest.active_sources(s), "seller_id")


@query("SELECT p_type AS dimension, max(p_size) AS version, round(avg(p_retailprice), 9) AS weight FROM part GROUP BY 1")
def da4_rubrics(spark, d):
    return T.table(spark, d, "part").groupBy(F.col("p_type").alias("dimension")).agg(F.max("p_size").alias("version"), F.round(F.avg("p_retailprice"), 9).alias("weight"))


@query("SELECT o_orderstatus AS model, count(*) AS runs, min(o_orderdate) AS first_run, max(o_orderdate) AS last_run FROM orders GROUP BY 1")
def da5_models(spark, d):
    return T.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.min("o_orderdate").alias("first_run"), F.max("o_orderdate").alias("last_run"))


@query("SELECT state, count(*) AS n FROM (SELECT last(event_type ORDER BY ts, event_id) AS state FROM events GROUP BY user_id) GROUP BY 1")
def da6_status(spark, d):
    return metrics.count_by(state.current_state(T.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id"), "state")


@query("SELECT user_id, since FROM (SELECT user_id, last(event_type ORDER BY ts, event_id) AS state, max(ts) AS since FROM events GROUP BY user_id) WHERE state = 'error'")
def da7_errors(spark, d):
    now = state.current_state(T.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return now.filter(F.col("state").isin("error")).select("user_id", "since")


@query(""", now AS (SELECT a.call_id, o_orderstatus = 'F' AS again, o_orderkey IS NOT NULL AS known FROM answers a LEFT JOIN orders ON o_orderkey = a.call_id)
  SELECT n.call_id, seller_id, product_id, call_date, CASE WHEN coalesce(again, FALSE) THEN 'rubric-2' ELSE 'rubric-1' END AS rubric_version, 'prompt-1' AS prompt_version, model_version, CASE WHEN coalesce(again, FALSE) THEN 2 ELSE 1 END AS runs,
    overall_score, e.n AS evidence, o.n AS stored_objections, 10 AS dimensions, quality AS human_quality
  FROM now n JOIN answers a ON a.call_id = n.call_id LEFT JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS call_date, s.seller_id, s.product_id FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS seller_id, min(l_partkey) AS product_id FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey) c ON c.o_orderkey = n.call_id
  LEFT JOIN (SELECT call_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.call_id = n.call_id LEFT JOIN (SELECT call_id, count(*) AS n FROM evidence WHERE claim = 'objection' GROUP BY 1) o ON o.call_id = n.call_id
  LEFT JOIN labels ON doc_id = n.call_id""", RULES)
def call_page(spark, d):
    """The page of each call from what the flow has stored: its metadata, the current run's versions, evidence and dimensions of that run, and a person's verdict.

    Calls of orders in state F are analysed again under a second rubric; the first run stays.
    """
    path, parts = new_path(spark, "call-page"), T.segments(spark, d)
    again = T.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("call_id"))
    flow.analyse_new(spark, parts, path, "rubric-1", "prompt-1", "nightly", "2024-01-01")
    flow.analyse_new(spark, parts.join(again, "call_id", "left_semi"), path, "rubric-2", "prompt-1", "nightly", "2024-02-01")
    log = flow.stored(spark, path)
    now = log.snapshot()
    runs = log.read("runs", now)
    current = analysis.current_runs(runs, ["call_id"], F.desc("rubric_version"), F.col("analysis_key"))
    current = parse_output(current).select("call_id", "analysis_key", "rubric_version", "prompt_version", "model_version", "result.overall_score")
    tied = log.read("evidence", now).groupBy("analysis_key").agg(F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("claim") == "objection").alias("o"))
    dims = log.read("dimensions", now).groupBy("analysis_key").agg(F.count(F.lit(1)).cast("int").alias("dimensions"))
    history = runs.groupBy("call_id").agg(F.count(F.lit(1)).cast("int").alias("runs"))
    reviews = T.table(spark, d, "labels").select(F.col("doc_id").alias("call_id"), F.col("quality").alias("human_quality"))
    page = current.join(history, "call_id").join(tied, "analysis_key", "left").join(dims, "analysis_key", "left")
    page = page.join(T.calls(spark, d).select("call_id", "seller_id", "product_id", "call_date"), "call_id", "left").join(reviews, "call_id", "left")
    return page.withColumn("stored_objections", F.nullif("o", F.lit(0))).drop("o", "analysis_key")
