"""Queries on the stand-in tables, each with its SQL: one or more operators at work on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions.keys import artifact_role, mask_pii, meta, period
from colloquy.functions.validation import needs_review
from colloquy.operators import analysis, detail, evaluate, ingest, metrics, privacy, rubric, state
from colloquy.plans.base import registering
from colloquy.sources import tables as T

QUERIES, ORACLES = {}, {}


query = registering(QUERIES, ORACLES)


def docs(spark, d):
    return T.table(spark, d, "documents")


def line_artifacts(spark, d):
    """Order lines as artifacts of calls."""
    role = F.when(F.col("l_returnflag") == "N", "transcript").when(F.col("l_returnflag") == "R", "notes").otherwise("recording")
    return T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("artifact_id"), role.alias("role"))


# --- sources, registration, transcripts


@query("""SELECT sha256(text) AS version, min(doc_id) AS doc_id, count(*) AS copies FROM documents
  WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY text""")
def register_first_seen(spark, d):
    """Versions that the registry, here those of labelled documents, lacks."""
    rows = docs(spark, d).withColumn("version", F.sha2("text", 256)).select("doc_id", "version")
    known = rows.join(T.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    first = ingest.register_artifacts(rows, known, ["version"], [F.col("doc_id")])
    return first.select("version", "doc_id").join(rows.groupBy("version").agg(F.count(F.lit(1)).alias("copies")), "version")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_artifacts_anti(spark, d):
    return ingest.register_artifacts(docs(spark, d).select("doc_id"), T.table(spark, d, "labels"), ["doc_id"], [F.col("doc_id")])


@query("SELECT doc_id AS id, 'document' AS kind, source, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT page_id, 'page', NULL, url FROM pages")
def union_sources(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "source")
    b = T.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url")
    return ingest.union_sources(a, b)


@query("""SELECT l_orderkey AS call_id, l_partkey AS artifact_id, CASE l_returnflag WHEN 'N' THEN 'transcript' WHEN 'R' THEN 'notes' ELSE 'recording' END AS role FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_partkey) = 1""")
def pick_by_priority(spark, d):
    return ingest.pick_transcript(line_artifacts(spark, d)).select("call_id", "artifact_id", "role")


@query("""SELECT conv_id AS call_id, count(*) AS n_segments, array_to_string(list_sort(list_distinct(list(role))), ',') AS speakers,
  sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id""")
def transcript_assembly(spark, d):
    rows = ingest.normalise_transcript(T.segments(spark, d))
    return rows.select("call_id", "n_segments", F.array_join("speakers", ",").alias("speakers"), "text_sha256")


@query("""SELECT doc_id, sha256('{"k0":"' || lower(trim(source)) || '","k1":"' || doc_id || '"}') AS artifact_key,
  CASE WHEN doc_id % 3 = 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE)::VARCHAR || ' 00:00:00' ELSE sha256(text) END AS version FROM documents""")
def content_version_key(spark, d):
    checksum = F.when(F.col("doc_id") % 3 != 0, F.sha2("text", 256))
    modified = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp")
    files = docs(spark, d).select("doc_id", F.concat(F.lit(" "), F.upper("source")).alias("provider"), F.col("doc_id").cast("string").alias("external_file_id"), checksum.alias("checksum"), modified.alias("modified_time"))
    return ingest.with_keys(files).select("doc_id", "artifact_key", "version")


@query("""WITH f AS (SELECT list_extract(['audio/mp4', 'text/vtt', 'text/html', 'application/vnd.document', NULL, 'video/mp4'], CAST(page_id % 6 + 1 AS INTEGER)) AS mime,
    CASE WHEN page_id % 5 = 0 THEN 'Transcript of ' WHEN page_id % 5 = 1 THEN 'my NOTES on ' ELSE '' END || url AS name FROM pages)
  SELECT CASE WHEN mime LIKE 'audio/%' OR mime LIKE 'video/%' THEN 'recording' WHEN lower(name) LIKE '%transcri%' OR mime = 'text/vtt' THEN 'transcript'
    WHEN lower(name) LIKE '%note%' OR mime LIKE '%document%' THEN 'notes' ELSE 'other' END AS role, count(*) AS n FROM f GROUP BY 1""")
def artifact_roles(spark, d):
    kinds = F.array(*(F.lit(m) for m in ("audio/mp4", "text/vtt", "text/html", "application/vnd.document", None, "video/mp4")))
    title = F.when(F.col("page_id") % 5 == 0, "Transcript of ").when(F.col("page_id") % 5 == 1, "my NOTES on ").otherwise("")
    files = T.table(spark, d, "pages").select(F.get(kinds, (F.col("page_id") % 6).cast("int")).alias("mime"), F.concat(title, "url").alias("name"))
    return metrics.count_by(files.withColumn("role", artifact_role(F.col("mime"), F.col("name"))), "role")


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_sha256 FROM pages")
def export_page_text(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.sha2(ingest.export_text(F.col("html")), 256).alias("text_sha256"))


@query("SELECT s_suppkey AS id, s_nationkey AS seller_id FROM supplier WHERE s_acctbal > 0")
def active_sources(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("seller_id"), (F.col("s_acctbal") > 0).alias("active"))
    return ingest.active_sources(s).select("id", "seller_id")


@query("""SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT o_custkey AS k, min(o_orderdate) AS m FROM orders GROUP BY 1) ON k = o_custkey WHERE m IS NULL OR o_orderdate > m""")
def changed_since(spark, d):
    files = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    marks = files.groupBy("o_custkey").agg(F.min("o_orderdate").alias("last_synced_at"))
    return ingest.changed_since(files, marks, "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, lower(trim(p_brand)) AS p_brand, lower(trim(p_name)) AS p_name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part")
def normalise_metadata(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("size")
    return ingest.normalise_metadata(T.table(spark, d, "part").select("p_partkey", "p_brand", "p_name", raw), ["p_brand", "p_name"], ["size"])


@query("SELECT l_orderkey AS call_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'A')")
def needs_transcription(spark, d):
    return ingest.needs_transcription(line_artifacts(spark, d))


@query("SELECT l_orderkey AS call_id, l_partkey AS artifact_id, 'drive://' || l_partkey AS uri FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'A'))")
def transcription_worklist(spark, d):
    files = line_artifacts(spark, d).withColumn("uri", F.concat(F.lit("drive://"), F.col("artifact_id").cast("string")))
    return ingest.transcription_worklist(files)


@query("""SELECT conv_id AS call_id, min(turn) * 10 AS starts, max(turn) * 10 + 9 AS ends, 'export' AS origin, CASE WHEN conv_id % 4 = 0 THEN 'pt' ELSE 'en' END AS language, 'v' || conv_id % 3 AS version, FALSE AS mixed FROM conversations GROUP BY conv_id""")
def transcript_headers(spark, d):
    more = {"start": F.col("turn") * 10, "end": F.col("turn") * 10 + 9, "origin": F.lit("export"), "language": F.when(F.col("call_id") % 4 == 0, "pt").otherwise("en"), "version": F.concat(F.lit("v"), (F.col("call_id") % 3).cast("string"))}
    return ingest.transcript_headers(T.segments(spark, d).withColumns(more))


@query("""WITH f AS (SELECT 'all' AS folder_id, NULL AS parent_id UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
  SELECT 'all' AS folder_id, 0 AS depth, 'all' AS path UNION ALL SELECT folder_id, 1, 'all/' || folder_id FROM f WHERE parent_id = 'all'
  UNION ALL SELECT folder_id, 2, 'all/' || parent_id || '/' || folder_id FROM f WHERE parent_id LIKE 'r%'""")
def walk_folders(spark, d):
    r, n = T.table(spark, d, "region"), T.table(spark, d, "nation")
    folders = spark.createDataFrame([("all", None)], "folder_id string, parent_id string")
    folders = folders.unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder_id"), F.lit("all").alias("parent_id")))
    folders = folders.unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id")))
    return ingest.walk_folders(folders, "all")


# --- filters, current runs, joins


@query("""SELECT call_id, team_id, product_id FROM calls JOIN (SELECT s_suppkey AS seller_id, s_nationkey AS team_id FROM supplier) USING (seller_id) WHERE team_id = 7 AND product_id = 4""", T.PRELUDE)
def team_filter(spark, d):
    teams = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("team_id"))
    return metrics.apply_filters(T.calls(spark, d).join(teams, "seller_id"), team=7, product=4).select("call_id", "team_id", "product_id")


@query("SELECT call_id, string_agg(dimension || '=' || CAST(score AS VARCHAR), ';' ORDER BY dimension, score) AS dimensions FROM dims GROUP BY 1", T.PRELUDE)
def nested_dimensions(spark, d):
    nested = detail.nest_children(T.dims(spark, d), "call_id", "children", "dimension", "score")
    one = F.transform("children", lambda x: F.concat(x["dimension"], F.lit("="), x["score"].cast("string")))
    return nested.select("call_id", F.array_join(one, ";").alias("dimensions"))


@query("""SELECT p_partkey AS call_id, coalesce(CASE WHEN p_size = 2 THEN 77 END, version) AS prompt_version FROM part
  LEFT JOIN (SELECT p_type AS t, max(p_size) AS version FROM part WHERE p_size < 30 GROUP BY 1) ON t = p_type""")
def resolve_prompts(spark, d):
    part = T.table(spark, d, "part")
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_type").alias("stage"), F.when(F.col("p_size") == 2, 77).alias("pinned_prompt"))
    versions = part.select(F.col("p_type").alias("stage"), F.col("p_size").alias("version"), (F.col("p_size") < 30).alias("active"))
    return rubric.resolve_versions(calls, versions, "prompt", "stage", "pinned_prompt").select("call_id", "prompt_version")


@query("""SELECT status AS model_version, quality AS rubric_version, 'prompt-' || call_id % 3 AS prompt_version, count(*) AS n, round(avg(abs(score - human_score)), 9) AS mae, round(avg(score - human_score), 9) AS bias, round(corr(score, human_score), 9) AS corr
  FROM (SELECT call_id, dimension, avg(score) AS score, max(score) AS human_score FROM dims GROUP BY 1, 2) JOIN calls USING (call_id) GROUP BY 1, 2, 3""", T.PRELUDE)
def evaluator_by_version(spark, d):
    by = T.dims(spark, d).groupBy("call_id", "dimension")
    pairs = evaluate.paired_scores(by.agg(F.avg("score").alias("score")), by.agg(F.max("score").alias("human_score")))
    runs = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("model_version"), F.col("o_orderpriority").alias("rubric_version"), F.concat(F.lit("prompt-"), (F.col("o_orderkey") % 3).cast("string")).alias("prompt_version"))
    return evaluate.evaluator_quality(pairs.join(runs, "call_id"), "model_version", "rubric_version", "prompt_version")


ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in state.allowed_transitions())


@query(f"""WITH e AS (SELECT event_id, user_id, ts, list_extract({state.STATES}, CAST((event_id * 7 + user_id) % 10 + 1 AS INTEGER)) AS state FROM events),
  s AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e), ok(a, b) AS (VALUES {ALLOWED})
  SELECT event_id, previous, state FROM s WHERE (previous IS NULL AND state <> 'DISCOVERED') OR (previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ok WHERE a = previous AND b = state))""")
def illegal_steps(spark, d):
    """Steps that the pipeline's own rules forbid."""
    names = F.array(*(F.lit(x) for x in state.STATES))
    e = T.table(spark, d, "events").select("event_id", F.col("user_id").alias("call_id"), "ts", F.col("event_id").alias("seq"), F.get(names, ((F.col("event_id") * 7 + F.col("user_id")) % 10).cast("int")).alias("state"))
    return state.illegal_transitions(spark, e).select("event_id", "previous", "state")


@query("SELECT call_id, seller_id, product_id, call_date, value FROM calls WHERE seller_id = 3 AND call_date >= DATE '1995-01-01' AND call_date < DATE '1997-01-01'", T.PRELUDE)
def dashboard_filter(spark, d):
    return metrics.apply_filters(T.calls(spark, d), seller=3, start="1995-01-01", end="1997-01-01").select("call_id", "seller_id", "product_id", "call_date", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def current_per_entity(spark, d):
    return analysis.current_runs(T.table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT call_id, overall_score < 15 AS low FROM scored WHERE quality = '1-URGENT' OR overall_score < 15", T.PRELUDE)
def review_queue(spark, d):
    rows = T.scored_calls(spark, d).withColumn("confidence", F.col("overall_score") / 25)
    return rows.filter(needs_review(F.col("quality") == "1-URGENT", F.col("confidence"))).select("call_id", (F.col("overall_score") < 15).alias("low"))


@query("SELECT call_id, call_date FROM calls WHERE call_date >= DATE '1996-06-01'", T.PRELUDE)
def retention(spark, d):
    return privacy.apply_retention(T.calls(spark, d), "1996-06-01").select("call_id", "call_date")


@query("SELECT substr(sha256(CAST(conv_id AS VARCHAR)), 1, 16) AS call_id, turn, role AS speaker FROM conversations")
def log_safe(spark, d):
    return privacy.log_safe(T.segments(spark, d), ["call_id"])


@query("SELECT call_id, seller_id FROM calls WHERE seller_id = 5", T.PRELUDE)
def visible_to(spark, d):
    return privacy.visible_to(T.calls(spark, d), "seller", 5).select("call_id", "seller_id")


@query("""SELECT o_orderkey AS call_id, coalesce(bool_or(l_returnflag = 'N'), FALSE) AS has_transcript, coalesce(bool_or(l_returnflag = 'R'), FALSE) AS has_notes, coalesce(bool_or(l_returnflag = 'A'), FALSE) AS has_recording
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def material_status(spark, d):
    role = F.when(F.col("l_returnflag") == "N", "transcript").when(F.col("l_returnflag") == "R", "notes").otherwise("recording")
    artifacts = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), role.alias("role"))
    return metrics.material_status(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id")), artifacts)


@query("SELECT l_orderkey AS call_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def call_grain(spark, d):
    return metrics.call_grain(T.dims(spark, d))


@query("""SELECT call_id, s_name, p_brand, n_name FROM calls LEFT JOIN supplier ON s_suppkey = seller_id LEFT JOIN part ON p_partkey = product_id LEFT JOIN nation ON n_nationkey = s_nationkey""", T.PRELUDE)
def seller_dims_join(spark, d):
    t = lambda n: T.table(spark, d, n)
    return metrics.with_dims(T.calls(spark, d), (t("supplier"), "seller_id", "s_suppkey"), (t("part"), "product_id", "p_partkey"), (t("nation"), "s_nationkey", "n_nationkey")).select("call_id", "s_name", "p_brand", "n_name")


@query("SELECT lang, count(*) AS discovered, count(l.doc_id) AS analysed, CAST(count(l.doc_id) AS DOUBLE) / count(*) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def coverage(spark, d):
    return metrics.coverage(docs(spark, d), T.table(spark, d, "labels"), "lang", call="doc_id")


@query("""SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(b.weight, a.weight) AS weight, b.weight IS NOT NULL AS overridden FROM
  (SELECT p_type AS dimension, round(avg(p_retailprice), 9) AS weight FROM part WHERE p_size <= 40 GROUP BY 1) a FULL JOIN
  (SELECT p_type AS dimension, round(avg(p_retailprice), 9) AS weight FROM part WHERE p_size > 40 GROUP BY 1) b ON a.dimension = b.dimension""")
def effective_rubric(spark, d):
    layer = lambda which: T.table(spark, d, "part").filter(which).groupBy(F.col("p_type").alias("dimension")).agg(F.round(F.avg("p_retailprice"), 9).alias("weight"))
    return rubric.effective_rubric(layer("p_size <= 40"), layer("p_size > 40"))


@query("""SELECT p_type AS dimension, 'core' AS layer, count(*) AS n FROM part WHERE p_size <= 40 GROUP BY 1 UNION ALL SELECT p_type, 'product', count(*) FROM part WHERE p_size > 40 GROUP BY 1""")
def rubric_layers(spark, d):
    part = T.table(spark, d, "part").withColumnRenamed("p_type", "dimension")
    return rubric.rubric_layers(core=metrics.count_by(part.filter("p_size <= 40"), "dimension"), product=metrics.count_by(part.filter("p_size > 40"), "dimension"))


@query("""SELECT c_custkey AS call_id, seller_id, seller_id IS NULL AS needs_review FROM customer LEFT JOIN
  (SELECT lower(trim(s_name)) AS a, min(s_suppkey) AS seller_id FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1) ON a = lower('SUPPLIER' || substr(c_name, 9))""")
def resolve_seller(spark, d):
    people = T.table(spark, d, "customer").select(F.col("c_custkey").alias("call_id"), F.concat(F.lit(" SUPPLIER"), F.substring("c_name", 9, 40)).alias("seller_name"), F.lit(None).cast("bigint").alias("location_seller_id"))
    aliases = T.table(spark, d, "supplier").select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("seller_id"))
    return ingest.resolve_seller(people, aliases).select("call_id", "seller_id", "needs_review")


@query("""SELECT p_partkey AS call_id, product_id, coalesce(CASE WHEN p_size = 1 THEN 99 END, version) AS rubric_version FROM (SELECT p_partkey, p_size, p_brand AS product_id FROM part)
  LEFT JOIN (SELECT p_brand, max(p_size) AS version FROM part WHERE p_size < 45 GROUP BY 1) ON p_brand = product_id""")
def resolve_versions(spark, d):
    part = T.table(spark, d, "part")
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_brand").alias("product_id"), F.when(F.col("p_size") == 1, 99).alias("pinned_version"))
    versions = part.select(F.col("p_brand").alias("product_id"), F.col("p_size").alias("version"), (F.col("p_size") < 45).alias("active")).distinct()
    return rubric.resolve_versions(calls, versions).select("call_id", "product_id", "rubric_version")


@query("""SELECT e.event_id, e.user_id, b.event_id AS segment FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN
  (SELECT event_id, user_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events WHERE event_type <> 'error') b ON b.user_id = e.user_id AND e.ts >= b.s AND e.ts < b.x""")
def locate_evidence(spark, d):
    events = T.table(spark, d, "events")
    ends = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = events.filter("event_type <> 'error'").select(F.col("user_id").alias("call_id"), F.col("ts").alias("start"), ends.alias("end"), F.col("event_id").alias("segment"))
    evidence = events.filter("event_type = 'error'").select("event_id", F.col("user_id").alias("call_id"), F.col("ts").alias("timestamp"))
    return analysis.locate_evidence(evidence, spans).select("event_id", F.col("call_id").alias("user_id"), "segment")


# --- aggregates


@query("SELECT status, count(*) AS n, round(avg(value), 4) AS mean_score FROM calls GROUP BY status", T.PRELUDE)
def mean_score_by_status(spark, d):
    return metrics.mean_score(T.calls(spark, d), "value", "status", digits=4)


@query("SELECT quality, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM calls GROUP BY quality", T.PRELUDE)
def quality_mix(spark, d):
    return metrics.mix(T.calls(spark, d), "quality")


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(failures) AS reason FROM results) GROUP BY 1 ORDER BY n DESC, reason LIMIT 3", T.PRELUDE)
def top_reasons(spark, d):
    return metrics.top_reasons(T.results(spark, d), "failures", 3)


@query("SELECT call_id, round(sum(score * weight) / nullif(sum(weight), 0), 9) AS weighted_score FROM dims GROUP BY 1", T.PRELUDE)
def weighted_score(spark, d):
    return rubric.weighted_score(T.dims(spark, d), "call_id").select("call_id", F.round("weighted_score", 9).alias("weighted_score"))


@query("SELECT o_orderstatus AS model, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS cost, CAST(sum(o_orderkey) AS BIGINT) AS tokens, count(*) AS runs FROM orders GROUP BY 1")
def cost_totals(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), F.col("o_orderkey").alias("tokens"))
    return o.groupBy("model").agg(F.sum("cost").cast("decimal(28,2)").alias("cost"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("runs"))


@query("SELECT seller_id, status, date_trunc('year', call_date)::DATE AS year, count(*) AS n, round(avg(overall_score), 9) AS mean_score FROM scored GROUP BY CUBE (seller_id, status, date_trunc('year', call_date)::DATE)", T.PRELUDE)
def subtotals(spark, d):
    return metrics.performance_cube(T.scored_calls(spark, d).withColumn("year", period(F.col("call_date"), "year")), "overall_score", "seller_id", "status", "year")


@query("SELECT lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY lang")
def distinct_sources(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""WITH p AS (SELECT length(text) > 1500 AS a, quality = 1 AS b FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (a AND b) AS n11 FROM p),
  k AS (SELECT *, CAST(n00 + n01 + n10 + n11 AS DOUBLE) AS t FROM c)
  SELECT n00, n01, n10, n11, round(((n00 + n11) / t - ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11)) / (t * t)) / (1 - ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11)) / (t * t)), 9) AS kappa FROM k""")
def evaluator_confusion(spark, d):
    pairs = docs(spark, d).join(T.table(spark, d, "labels"), "doc_id")
    return evaluate.agreement(pairs, F.char_length("text") > 1500, F.col("quality") == 1)


@query("""SELECT dimension, count(*) AS n, round(avg(abs(score - human_score)), 9) AS mae, round(avg(score - human_score), 9) AS bias, round(corr(score, human_score), 9) AS corr
  FROM (SELECT call_id, dimension, avg(score) AS score, max(score) AS human_score FROM dims GROUP BY 1, 2) GROUP BY 1""", T.PRELUDE)
def evaluator_quality(spark, d):
    by = T.dims(spark, d).groupBy("call_id", "dimension")
    pairs = evaluate.paired_scores(by.agg(F.avg("score").alias("score")), by.agg(F.max("score").alias("human_score")))
    return evaluate.evaluator_quality(pairs, "dimension")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('golden' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def golden_strata(spark, d):
    return evaluate.golden_sample(docs(spark, d), ["lang"], 5, F.col("doc_id")).select("lang", "doc_id")


# --- windows


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS run_number, round(o_totalprice - lag(o_totalprice) OVER w, 9) AS delta FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def run_history(spark, d):
    rows = analysis.run_history(T.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")
    return rows.select("o_custkey", "o_orderkey", "run_number", F.round("delta", 9).alias("delta"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def rolling_score(spark, d):
    rows = metrics.trend(T.table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "value")
    return rows.select("event_id", F.round("rolling", 9).alias("rolling"))


@query("SELECT seller_id, round(regr_slope(overall_score, CAST(date_diff('day', DATE '1970-01-01', call_date) AS DOUBLE)), 5) + 0.0 AS slope, count(*) AS n FROM scored GROUP BY 1", T.PRELUDE)
def trend_slope(spark, d):
    rows = metrics.slope(T.scored_calls(spark, d), "seller_id", "overall_score", "call_date")
    return rows.select("seller_id", (F.round("slope", 5) + 0.0).alias("slope"), "n")


@query("""SELECT * FROM (SELECT p_brand, p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS best_rank, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS worst_rank FROM part) WHERE best_rank <= 3 OR worst_rank <= 3""")
def extreme_dims(spark, d):
    return metrics.extremes(T.table(spark, d, "part"), "p_brand", "p_retailprice", 3).select("p_brand", "p_partkey", "best_rank", "worst_rank")


@query("SELECT * FROM (SELECT seller_id, call_id, row_number() OVER (PARTITION BY seller_id ORDER BY call_date DESC, call_id DESC) AS recency FROM calls) WHERE recency <= 5", T.PRELUDE)
def recent_calls(spark, d):
    return metrics.recent(T.calls(spark, d), "seller_id", [F.desc("call_date"), F.desc("call_id")], 5).select("seller_id", "call_id", "recency")


@query("""SELECT seller_id, reason, count(DISTINCT call_id) AS calls FROM (SELECT seller_id, call_id, unnest(failures) AS reason FROM
  (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY call_date DESC, call_id DESC) AS n FROM scored) WHERE n <= 10) GROUP BY 1, 2 HAVING count(DISTINCT call_id) >= 3""", T.PRELUDE)
def recurring_patterns(spark, d):
    return metrics.recurring(T.scored_calls(spark, d), "seller_id", [F.desc("call_date"), F.desc("call_id")], "failures", 10, 3)


@query("SELECT previous, event_type AS state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) GROUP BY 1, 2")
def transition_counts(spark, d):
    rows = state.with_previous(T.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    return rows.groupBy("previous", F.col("event_type").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
  WHERE (previous IS NULL AND event_type <> 'signup') OR (previous IS NOT NULL AND NOT ((previous = 'signup' AND event_type = 'view') OR (previous = 'view' AND event_type IN ('click', 'view')) OR (previous = 'click' AND event_type IN ('purchase', 'error'))))""")
def illegal_transitions(spark, d):
    allowed = [("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "error")]
    return state.illegal_transitions(spark, T.table(spark, d, "events"), allowed, "signup", key="user_id", state="event_type", ts="ts", seq="event_id").select("event_id", "previous")


@query("SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS seconds FROM events QUALIFY seconds IS NOT NULL")
def dwell(spark, d):
    return state.dwell(T.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "seconds")


@query("SELECT user_id, last(event_type ORDER BY ts, event_id) AS state, max(ts) AS since FROM events GROUP BY 1")
def current_state(spark, d):
    return state.current_state(T.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT user_id AS call_id, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1
  HAVING last(event_type ORDER BY ts, event_id) = 'error' AND count(*) FILTER (event_type = 'error') < 30""")
def requeue(spark, d):
    e = T.table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.when(F.col("event_type") == "error", "FAILED_RETRYABLE").otherwise("ANALYZING").alias("state"), "ts", F.col("event_id").alias("seq"))
    return state.requeue(e, 30)


@query("SELECT DISTINCT o_custkey AS analysis_key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def pending(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("analysis_key"), "o_orderstatus")
    return state.pending(o, o.filter("o_orderstatus = 'P'")).select("analysis_key")


@query("SELECT DISTINCT call_id, 'ANALYSIS_QUEUED' AS state, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM calls WHERE call_id NOT IN (SELECT call_id FROM results)", T.PRELUDE)
def enqueue(spark, d):
    calls = T.calls(spark, d).withColumn("analysis_key", F.col("call_id"))
    runs = T.results(spark, d).select(F.col("call_id").alias("analysis_key"))
    return state.enqueue(calls, runs, "2024-01-01 00:00:00").select("call_id", "state", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT call_id FROM calls EXCEPT SELECT call_id FROM results", T.PRELUDE)
def state_gap(spark, d):
    return state.state_gap(T.calls(spark, d), T.results(spark, d))


# --- functions


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def metadata_json(spark, d):
    return T.table(spark, d, "events").select("event_id", meta(F.col("props"), "$.k").alias("k"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '\+?\d[\d ()-]{7,}\d', '<phone>', 'g')) AS masked_sha256 FROM documents")
def mask_email(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(mask_pii(F.col("text")), 256).alias("masked_sha256"))


@query("SELECT call_id, overall_score < 12 AS low, status = 'F' AND value > 200000 AS costly FROM scored", T.PRELUDE)
def qualification_rules(spark, d):
    return analysis.apply_rules(T.scored_calls(spark, d), [("low", "overall_score < 12"), ("costly", "status = 'F' AND value > 200000")]).select("call_id", "low", "costly")


@query("SELECT o_custkey AS call_id, o_orderstatus AS actor, 'analysed' AS action, o_orderdate AS ts FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, o_orderpriority, 'reviewed', o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def audit_trail(spark, d):
    o = T.table(spark, d, "orders")
    pick = lambda who, where: o.filter(where).select(F.col("o_custkey").alias("call_id"), F.col(who).alias("actor"), F.col("o_orderdate").alias("ts"))
    return analysis.audit_trail(pick("o_orderstatus", "o_orderstatus <> 'P'"), pick("o_orderpriority", "o_orderstatus = 'P'"))
