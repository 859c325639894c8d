"""Queries on what jobs store and look up again: the commit log, change feeds, folders, revised transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import excerpts, folders, golden, names, patterns, revisions
from colloquy.plans.base import registering
from colloquy.sources import tables as T
from colloquy.sources.commits import CommitLog, new_keys
from colloquy.sources.store import materialise, new_path
from colloquy.streaming import changes

QUERIES, ORACLES = {}, {}
query = registering(QUERIES, ORACLES)

RUNS = {"runs": "call_id long, arrival string", "dims": "call_id long, dimension string, score double"}


@query("""SELECT call_id, CASE WHEN call_date < DATE '1995-01-01' THEN 'first' ELSE 'second' END AS arrival, coalesce(n, 0) AS dimensions, total
  FROM calls LEFT JOIN (SELECT call_id, count(*) AS n, sum(score) AS total FROM dims GROUP BY 1) USING (call_id)""", T.PRELUDE)
def committed_runs(spark, d):
    """One job name over calls that arrive in two goes: the second go adds only what is new, and a lost attempt adds nothing."""
    log = CommitLog(spark, new_path(spark, "committed-runs"), RUNS)
    calls, dims = T.calls(spark, d).select("call_id", "call_date"), T.dims(spark, d).select("call_id", "dimension", "score")

    def adding(arrived, name):
        def build(now):
            new = new_keys(arrived.withColumn("arrival", F.lit(name)), log.read("runs", now), "call_id")
            return {"runs": new, "dims": dims.join(new, "call_id", "left_semi")}, []

        return build

    first = calls.filter("call_date < DATE '1995-01-01'")
    log.commit(adding(first, "first"), "nightly", token="first")
    log.write("dims", dims)  # an attempt that is lost before its manifest
    log.commit(adding(calls, "second"), "nightly", token="second")
    log.commit(adding(calls, "third"), "nightly", token="second")  # the same go, run again
    now = log.snapshot()
    sums = log.read("dims", now).groupBy("call_id").agg(F.count(F.lit(1)).alias("dimensions"), F.sum("score").alias("total"))
    return log.read("runs", now).join(sums, "call_id", "left").select("call_id", "arrival", F.coalesce("dimensions", F.lit(0)).alias("dimensions"), "total")


@query("SELECT call_id, call_date, status FROM calls WHERE call_date >= DATE '1996-06-01'", T.PRELUDE)
def retention_deletes(spark, d):
    """Calls stored by year; those that have expired are deleted from storage, by writing anew only the years that hold any."""
    path = new_path(spark, "retention")
    log = CommitLog(spark, path, {"calls": "call_id long, call_date date, status string, year int"}, {"calls": "year"})
    log.commit(lambda now: ({"calls": T.calls(spark, d).withColumn("year", F.year("call_date"))}, []), "ingestion")
    log.expire({"calls": F.col("call_date") < F.lit("1996-06-01").cast("date")}, "retention")
    left = spark.read.schema(log.schemas["calls"]).option("recursiveFileLookup", "true").parquet(f"{path}/calls")  # all that storage holds
    return left.select("call_id", "call_date", "status")


@query("""SELECT source, file_id, checksum FROM (SELECT c_nationkey AS source, o_custkey AS file_id, 'v' || max(o_orderkey) FILTER (WHERE n = 1) AS checksum, bool_or(o_orderstatus = 'P') FILTER (WHERE n = 1) AS gone FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2) WHERE NOT gone""")
def change_cursors(spark, d):
    """A feed of pages (an order changes its customer's file; one in state P removes it), a source a nation, followed in two goes; what it leaves."""
    root, log, checkpoint = (new_path(spark, name) for name in ("feed", "change-log", "feed-offsets"))
    rows = T.table(spark, d, "orders").join(T.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    place = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long") * 10**10 + F.col("o_orderkey")
    change = F.struct(F.col("o_custkey").cast("string").alias("file_id"), (F.col("o_orderstatus") == "P").alias("removed"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("checksum"), place.alias("position"))
    pages = rows.select(F.col("c_nationkey").cast("string").alias("source"), F.year("o_orderdate").cast("string").alias("cursor"), F.to_json(change).alias("value")).repartition("source", "cursor")
    for part in ("cursor < '1995'", "cursor >= '1995'"):
        pages.filter(part).write.mode("append").partitionBy("source", "cursor").text(root)
        changes.follow_changes(spark, root, log, checkpoint)
    files = changes.current_files(changes.change_log(spark, log).read("changes"))
    return files.select(F.col("source").cast("int").alias("source"), F.col("file_id").cast("long").alias("file_id"), "checksum")


@query("""WITH place AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
  tree AS (
    SELECT 'all' AS folder_id, CAST(NULL AS VARCHAR) AS parent_id, ['all'] AS way
    UNION ALL SELECT 'r' || r_regionkey, 'all', ['all', 'r' || r_regionkey] FROM region
    UNION ALL SELECT 'n' || n, 'r' || r, ['all', 'r' || r, 'n' || n] FROM place
    UNION ALL SELECT 's' || s_suppkey, 'r' || r, ['all', 'r' || r, 's' || s_suppkey] FROM supplier JOIN place ON n = s_nationkey
    UNION ALL SELECT 'c' || c_custkey, 'n' || n, ['all', 'r' || r, 'n' || n, 'c' || c_custkey] FROM customer JOIN place ON n = c_nationkey),
  labelled AS (SELECT *, row_number() OVER (ORDER BY way) - 1 AS pre FROM tree),
  sizes AS (SELECT f, count(*) AS n FROM (SELECT unnest(way) AS f FROM tree) GROUP BY 1)
  SELECT folder_id, parent_id, CAST(len(way) - 1 AS INTEGER) AS depth, pre, pre + n - 1 AS last FROM labelled JOIN sizes ON f = folder_id""")
def folder_intervals(spark, d):
    """Regions, nations and customers as folders; a supplier lies in its nation and its region, and each nation in its suppliers too, which makes circles."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    t = lambda n: T.table(spark, d, n)
    placed = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    pairs = [
        t("region").select(name("r", "r_regionkey"), F.lit("all")), t("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")), t("customer").select(name("c", "c_custkey"), name("n", "c_nationkey")),
        placed.select(name("s", "s_suppkey"), name("n", "n_nationkey")), placed.select(name("s", "s_suppkey"), name("r", "n_regionkey")), placed.select(name("n", "n_nationkey"), name("s", "s_suppkey")),
    ]
    edges = pairs[0].toDF("folder_id", "parent_id")
    for more in pairs[1:]:
        edges = edges.union(more)
    return folders.folder_tree(edges, "all")


REVISED = """WITH rows AS (
    SELECT conv_id AS call_id, turn, turn * 10 AS s, turn * 10 + 12 AS e, 9 AS v FROM conversations
    UNION ALL SELECT conv_id, turn, turn * 10 + 4, turn * 10 + 7, 10 FROM conversations WHERE length(text) > 120
    UNION ALL SELECT conv_id, turn, turn * 10 + 2, turn * 10 + 6, 2 FROM conversations WHERE role = 'user'
    UNION ALL SELECT conv_id, turn, NULL, turn * 10 + 6, 10 FROM conversations WHERE length(text) < 60),
  newest AS (SELECT call_id, max(v) AS v FROM rows GROUP BY 1),
  ats AS (SELECT DISTINCT call_id, m FROM (SELECT call_id, unnest([s, e]) AS m FROM rows WHERE s < e)),
  stands AS (SELECT a.call_id, a.m, max({'v': v, 's': s, 'e': e, 'turn': turn}) AS x FROM ats a LEFT JOIN rows r ON r.call_id = a.call_id AND r.s <= a.m AND a.m < r.e AND r.s < r.e GROUP BY 1, 2),
  turns AS (SELECT call_id, m, x, lag(x) OVER w AS b FROM stands WINDOW w AS (PARTITION BY call_id ORDER BY m)),
  pieces AS (SELECT call_id, m, x, lead(m) OVER (PARTITION BY call_id ORDER BY m) AS until FROM turns WHERE x.turn IS DISTINCT FROM b.turn OR x.v IS DISTINCT FROM b.v)
"""


@query(REVISED + """SELECT call_id, x.turn AS turn, 'v' || x.v AS version, m AS start, until AS end, x.s = m AND x.e = until AS whole FROM pieces WHERE x.turn IS NOT NULL
  UNION ALL SELECT DISTINCT r.call_id, turn, 'v10', NULL, e, FALSE FROM rows r JOIN newest n ON n.call_id = r.call_id AND n.v = 10 WHERE s IS NULL""")
def revised_transcript(spark, d):
    """Turns as segments of revision v9 that overlap; v10 covers the middle of long ones, v2 is covered, and some of v10 have no start."""
    c = T.table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), "turn", "role", "text")
    ten = F.col("turn") * 10
    part = lambda where, s, e, v: c.filter(where).select("call_id", "turn", (ten + s).alias("start"), (ten + e).alias("end"), F.lit(v).alias("version"))
    rows = part("TRUE", 0, 12, "v9").unionByName(part("length(text) > 120", 4, 7, "v10")).unionByName(part("role = 'user'", 2, 6, "v2")).unionByName(part("length(text) < 60", F.lit(None).cast("int"), 6, "v10"))
    return revisions.effective_segments(rows)


@query("""WITH said AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(substr(text, 3, 48)), '\\s+', ' ', 'g')) AS part, turn % 3 AS kind FROM conversations WHERE length(text) >= 60),
  folded AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations)
  SELECT s.conv_id AS call_id, s.turn, kind, CASE WHEN kind < 2 THEN min(f.turn) END AS segment, CASE WHEN kind < 2 THEN CAST(kind AS INTEGER) END AS edits
  FROM said s LEFT JOIN folded f ON f.conv_id = s.conv_id AND contains(f.t, s.part) GROUP BY s.conv_id, s.turn, kind""")
def excerpts_located(spark, d):
    """Excerpts without times: as they were said, with one letter changed, and backwards, which is found nowhere."""
    c = T.segments(spark, d)
    part = excerpts.folded(F.substring("text", 3, 48))
    changed = F.concat(F.substring(part, 1, 20), F.lit("#"), F.substring(part, 22, 60))
    kind = F.col("turn") % 3
    evidence = c.filter("length(text) >= 60").select("call_id", "turn", kind.alias("kind"), F.when(kind == 0, part).when(kind == 1, changed).otherwise(F.reverse(part)).alias("excerpt"))
    evidence = evidence.withColumn("evidence_id", F.col("call_id") * 1000000 + F.col("turn"))
    out = excerpts.locate_excerpts(evidence, c)
    return out.select("call_id", "turn", "kind", "segment", "edits")


@query(""", m AS (SELECT call_id, unnest([{'margin': 'seller', 'value': CAST(seller_id AS VARCHAR)}, {'margin': 'status', 'value': status}, {'margin': 'quality', 'value': quality}, {'margin': 'product', 'value': CAST(product_id AS VARCHAR)},
    {'margin': 'clarity', 'value': CASE WHEN overall_score > 22 AND overall_score < 28 THEN 'ambiguous' ELSE 'clear' END}]) AS x FROM scored)
  SELECT x.margin AS margin, x.value AS value, count(*) AS available, least(count(*), 3) AS wanted, TRUE AS met FROM m WHERE x.value IS NOT NULL GROUP BY 1, 2""", T.PRELUDE)
def golden_margins(spark, d):
    """How a golden set over closers, outcomes, opportunities, products and clear or ambiguous calls fills each of their values."""
    calls = materialise(T.scored_calls(spark, d).select("call_id", "seller_id", "status", "quality", "product_id", "overall_score"), "golden-calls")
    clarity = F.when((F.col("overall_score") > 22) & (F.col("overall_score") < 28), "ambiguous").otherwise("clear")
    strata = {"seller": F.col("seller_id"), "status": F.col("status"), "quality": F.col("quality"), "product": F.col("product_id"), "clarity": clarity}
    return golden.margins_met(calls, "call_id", strata, 3, golden.golden_cover(calls, "call_id", strata, 3))


@query(f""", each AS (
    SELECT status, call_id, dimension, CAST(count(*) AS DOUBLE) AS m, sum(CAST(score AS DOUBLE)) AS s1, sum(CAST(score AS DOUBLE) * score) AS s2 FROM dims JOIN (SELECT call_id, status FROM calls) USING (call_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  drawn AS (SELECT *, 2 * (m * s2 - s1 * s1) / (m - 1) AS d, CASE WHEN r = 0 THEN 1 ELSE {" + ".join(f"(u >= {x})::INT" for x in golden.POISSON)} END AS w
    FROM (SELECT *, CAST('0x' || md5('agreement|' || r || '|' || call_id || '|' || dimension)[1:8] AS BIGINT) AS u FROM each, (SELECT unnest(range(0, 41)) AS r))),
  sums AS (SELECT status, r, count(*) AS units, sum(w * m) AS n, sum(w * s1) AS s1, sum(w * s2) AS s2, sum(w * d) AS d FROM drawn GROUP BY 1, 2),
  alphas AS (SELECT status, r, units, n, 1 - (d / n) / (2 * (n * s2 - s1 * s1) / (n * (n - 1))) AS alpha FROM sums)
  SELECT status, max(units) FILTER (WHERE r = 0) AS units, CAST(max(n) FILTER (WHERE r = 0) AS BIGINT) AS ratings, round(max(alpha) FILTER (WHERE r = 0), 6) + 0.0 AS alpha,
    round(quantile_cont(alpha, 0.025) FILTER (WHERE r > 0), 6) + 0.0 AS low, round(quantile_cont(alpha, 0.975) FILTER (WHERE r > 0), 6) + 0.0 AS high FROM alphas GROUP BY 1""", T.PRELUDE)
def agreement_with_uncertainty(spark, d):
    """Lines of one call and dimension as scores of several raters, by the call's status: alpha and its bootstrap interval."""
    ratings = T.dims(spark, d).join(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("status")), "call_id")  # a call is an order
    out = golden.agreement_interval(ratings, ["call_id", "dimension"], "score", ["status"], replicates=40)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("alpha", "low", "high")})


@query(""", runs AS (SELECT seller_id, year(call_date) AS y, date_diff('day', DATE '1970-01-01', call_date) AS t, unnest(failures) AS f FROM scored),
  p1 AS (SELECT seller_id, y, f AS pattern, min(t) AS at1 FROM runs GROUP BY 1, 2, 3),
  p2 AS (SELECT p.seller_id, p.y, pattern || '>' || f AS pattern, min(t) AS at1 FROM p1 p JOIN runs r ON r.seller_id = p.seller_id AND r.y = p.y AND r.t > p.at1 GROUP BY 1, 2, 3),
  p3 AS (SELECT p.seller_id, p.y, pattern || '>' || f AS pattern, min(t) AS at1 FROM p2 p JOIN runs r ON r.seller_id = p.seller_id AND r.y = p.y AND r.t > p.at1 GROUP BY 1, 2, 3)
  SELECT seller_id, pattern, count(*) AS support FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1, 2 HAVING count(*) >= 4""", T.PRELUDE)
def ordered_patterns(spark, d):
    """Failures that follow one another in at least four of a seller's years."""
    calls = T.scored_calls(spark, d).withColumn("year", F.year("call_date"))
    out = patterns.frequent_patterns(calls, "seller_id", "year", F.datediff("call_date", F.lit("1970-01-01").cast("date")), "failures", 4)
    return out.select("seller_id", F.array_join("pattern", ">").alias("pattern"), "support")


@query("""SELECT o_orderkey AS call_id, 'Call ' || o_orderkey || ': person-' || substr(sha256('key:s' || s_suppkey), 1, 10) || ' (' || c_nationkey || ') spoke to' || chr(10) || 'person-' || substr(sha256('key:c' || c_custkey), 1, 10) || ', twice.' AS text
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = (SELECT min(s_suppkey) FROM supplier x WHERE x.s_nationkey = c_nationkey)""")
def masked_names(spark, d):
    """Notes on calls that name a seller and a customer, whom the tables know."""
    s, c = T.table(spark, d, "supplier"), T.table(spark, d, "customer")
    first = s.groupBy(F.col("s_nationkey").alias("n")).agg(F.min_by(F.struct("s_name"), "s_suppkey").alias("s")).select("n", "s.*")
    calls = T.table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(first), F.col("n") == F.col("c_nationkey"))  # 25 nations
    note = F.concat(F.lit("Call "), F.col("o_orderkey").cast("string"), F.lit(": "), F.upper("s_name"), F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(") spoke to\n"), "c_name", F.lit(", twice."))
    people = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seller_id"), F.col("s_name").alias("name")).union(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_name"))
    return names.mask_names(calls.select(F.col("o_orderkey").alias("call_id"), note.alias("text")), people, salt="key")
