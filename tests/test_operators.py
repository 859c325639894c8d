"""Operators on small hand-made rows: nulls, ties, repeats, replays."""

import datetime as dt
import json
import subprocess
import sys

from pyspark.sql import functions as F

from colloquy.functions.keys import analysis_key, artifact_key, artifact_role, mask_pii
from colloquy.functions.validation import evidence_gaps, needs_review, parse_output
from colloquy.operators import analysis, evaluate, ingest, metrics, privacy, rubric, state
from colloquy.plans import flow
from colloquy.plans import registry as base
from colloquy.streaming.poll import MANIFEST, poll_once, register_batch, registry
from tests.conftest import ROOT

GOOD = {"overall_score": 41.0, "opportunity_quality": "unclear", "call_status": "follow_up", "confidence": 0.7, "strengths": [], "critical_failures": ["x"], "objections": [], "coaching_actions": [], "dimensions": [], "evidence": [], "requires_human_review": False}


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_keys_tell_null_and_delimiters_apart(spark):
    df = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), (" A", "b|c")], "p string, i string")
    keys = [r[0] for r in df.select(artifact_key(F.col("p"), F.col("i"))).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]
    again = spark.range(1).select(analysis_key(*[F.lit(1)] * 5), analysis_key(*[F.lit(1)] * 5, F.lit(1))).first()
    assert again[0] != again[1]


def test_roles_and_masks(spark):
    df = spark.createDataFrame([("audio/mp4", "x"), (None, "Transcript 1"), ("application/document", None), (None, None)], "m string, n string")
    assert [r[0] for r in df.select(artifact_role(F.col("m"), F.col("n"))).collect()] == ["recording", "transcript", "notes", "other"]
    assert spark.createDataFrame([("mail a.b@c.org or +1 (706) 555-3138",)], "t string").select(mask_pii(F.col("t"))).first()[0] == "mail <email> or <phone>"


def test_validation_loses_no_row(spark):
    bad = [{**GOOD, "confidence": 2}, {**GOOD, "call_status": "odd"}, {k: v for k, v in GOOD.items() if k != "evidence"}, {**GOOD, "more": 1}, {**GOOD, "overall_score": "text"}]
    raws = [json.dumps(GOOD), *map(json.dumps, bad), "{broken", None]
    out = parse_output(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw_json string")).orderBy("i").collect()
    assert [r.valid for r in out] == [True] + [False] * 7
    assert "range:confidence" in out[1].problems and "unknown:call_status" in out[2].problems
    assert "missing:evidence" in out[3].problems and "extra:more" in out[4].problems


def test_evidence_and_review(spark):
    ev = [(1, [(1, "a", "x", "c"), (None, "a", "x", "c"), (1, None, "x", "c")]), (2, None)]
    df = spark.createDataFrame(ev, "i int, evidence array<struct<timestamp:int,speaker:string,excerpt:string,claim:string>>")
    assert values(evidence_gaps(df), "i", "evidence_gaps") == [(1, 2), (2, 0)]
    df = spark.createDataFrame([(True, 0.9), (False, 0.9), (False, 0.1), (None, 0.9), (False, None)], "f boolean, c double")
    assert [r[0] for r in df.select(needs_review(F.col("f"), F.col("c"))).collect()] == [True, False, True, True, True]


def test_registration_twice_adds_nothing(spark):
    t = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("d", "1", t, "c1", "u"), ("d", "1", t, "c1", "u"), ("d", "1", t, "c2", "u"), ("e", "1", t, "c1", "u"), ("d", "2", t, None, "u")], "provider string, external_file_id string, modified_time timestamp, checksum string, uri string")
    first = ingest.register_artifacts(ingest.with_keys(files), ingest.with_keys(files).limit(0))
    assert first.count() == 4
    assert ingest.register_artifacts(ingest.with_keys(files), first).count() == 0


def test_poll_is_replay_safe(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    row = lambda i, c: ("d", i, t, c, "u", None, "n", "s")
    spark.createDataFrame([row("1", "a"), row("1", "a"), row("2", "b")], MANIFEST).write.parquet(f"{tmp_path}/in/one")
    args = (spark, f"{tmp_path}/in/*", f"{tmp_path}/registry")
    poll_once(*args, f"{tmp_path}/ck")
    assert registry(spark, args[2]).count() == 2
    poll_once(*args, f"{tmp_path}/ck-lost")  # all offsets gone: everything is read again
    assert registry(spark, args[2]).count() == 2
    spark.createDataFrame([row("1", "a"), row("3", "c"), row("2", "new")], MANIFEST).write.parquet(f"{tmp_path}/in/two")
    poll_once(*args, f"{tmp_path}/ck")
    assert values(registry(spark, args[2]), "external_file_id", "checksum") == [("1", "a"), ("2", "b"), ("2", "new"), ("3", "c")]


def polled(spark, tmp_path, batches):
    """External ids in the registry after polling: each batch is (name, ids, checkpoint)."""
    t = dt.datetime(2024, 1, 1)
    for name, ids, checkpoint in batches:
        spark.createDataFrame([("d", i, t, i, "u", None, "n", "s") for i in ids], MANIFEST).write.parquet(f"{tmp_path}/in/{name}")
        if checkpoint:
            poll_once(spark, f"{tmp_path}/in/*", f"{tmp_path}/registry", f"{tmp_path}/{checkpoint}")
    return [r[0] for r in values(registry(spark, f"{tmp_path}/registry"), "external_file_id")]


def test_poll_after_two_batches_and_a_lost_checkpoint(spark, tmp_path):
    assert polled(spark, tmp_path, [("one", "12", "ck"), ("two", "23", "ck"), ("three", "34", "lost")]) == ["1", "2", "3", "4"]


def test_poll_of_new_files_only_with_a_new_checkpoint(spark, tmp_path):
    assert polled(spark, tmp_path, [("one", "12", "ck"), ("two", "3", "ck")]) == ["1", "2", "3"]
    spark.createDataFrame([("d", "9", dt.datetime(2024, 1, 1), "9", "u", None, "n", "s")], MANIFEST).write.parquet(f"{tmp_path}/other/new")
    poll_once(spark, f"{tmp_path}/other/*", f"{tmp_path}/registry", f"{tmp_path}/new")
    assert [r[0] for r in values(registry(spark, f"{tmp_path}/registry"), "external_file_id")] == ["1", "2", "3", "9"]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([("d", i, t, i, "u", None, "n", "s") for i in "12"], MANIFEST)
    for run, number in (("a", 0), ("a", 0), ("b", 0), ("a", 1)):
        register_batch(batch, f"{tmp_path}/r", "drive", run, number)
    assert values(registry(spark, f"{tmp_path}/r"), "external_file_id", "run", "batch") == [("1", "a", 0), ("2", "a", 0)]


def test_folders_of_any_depth_and_in_circles(spark):
    deep = [(f"f{k}", f"f{k - 1}") for k in range(1, 300)]
    rows = [("f0", None), *deep, ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("lost", "nowhere"), ("f2", "f0")]
    out = {(r.folder_id, r.depth): r.path for r in ingest.walk_folders(spark.createDataFrame(rows, "folder_id string, parent_id string"), "f0").collect()}
    assert out["f0", 0] == "f0" and out["f299", 299].count("/") == 299 and out["f299", 298].count("/") == 298 and out["f2", 1] == "f0/f2"
    assert {i for i, _ in out} == {f"f{k}" for k in range(300)}


def test_artifacts_by_reference(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    [r] = ingest.artifact_reference(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert r.uri.endswith("a.bin") and r["size"] == 5 and r.modified_time and len(r) == 3


def test_transcript_headers(spark):
    rows = spark.createDataFrame([(1, 0, 5, "drive", "pt", "v1"), (1, 5, 9, "drive", "pt", "v2"), (2, None, None, None, None, None)], "call_id int, start int, end int, origin string, language string, version string")
    assert values(ingest.transcript_headers(rows), "call_id", "starts", "ends", "language", "version", "mixed") == [(1, 0, 9, "pt", "v2", True), (2, None, None, None, None, False)]


def test_flow_analyses_once_for_each_set_of_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "hello, you?"), (1, 1, "assistant", "yes"), (2, 0, "user", None)], "call_id long, turn long, speaker string, text string")
    count = lambda t: spark.read.parquet(f"{tmp_path}/{t}").count()
    args = (str(tmp_path), "rubric-1", "prompt-1")
    assert flow.analyse_new(spark, rows.filter("call_id = 1"), *args, "job-1", "2024-01-01").count() == 1
    assert flow.analyse_new(spark, rows.filter("call_id = 1"), *args, "job-1", "2024-01-01").count() == 0
    assert flow.analyse_new(spark, rows, *args, "job-2", "2024-01-02").count() == 1
    assert (count("runs"), count("dimensions"), count("state_events"), count("evidence")) == (2, 20, 6, 3)
    assert flow.analyse_new(spark, rows, str(tmp_path), "rubric-2", "prompt-1", "job-3", "2024-01-03").count() == 2
    assert count("runs") == 4 and {r[0] for r in spark.read.parquet(f"{tmp_path}/state_events").select("state").collect()} == {"ANALYSIS_QUEUED", "ANALYZING", "NEEDS_REVIEW"}


def test_entry_without_a_package_that_the_corpus_operators_need():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(base.QUERIES)), "False"]


def test_transcript_choice(spark):
    a = spark.createDataFrame([(1, "r", "recording", "u"), (1, "n", "notes", "u"), (2, "r", "recording", "u"), (3, "o", "other", "u"), (4, "t2", "transcript", "u"), (4, "t1", "transcript", "u")], "call_id int, artifact_id string, role string, uri string")
    assert values(ingest.pick_transcript(a), "call_id", "artifact_id") == [(1, "n"), (2, "r"), (4, "t1")]
    assert values(ingest.transcription_worklist(a), "call_id", "artifact_id") == [(2, "r")]


def test_alias_of_two_sellers_is_for_review(spark):
    calls = spark.createDataFrame([(1, " Ann ", None), (2, "bob", None), (3, "zed", None), (4, "x", 9)], "call_id int, seller_name string, location_seller_id int")
    aliases = spark.createDataFrame([("ann", 1), ("ANN", 1), ("bob", 1), ("Bob", 2)], "alias string, seller_id int")
    assert values(ingest.resolve_seller(calls, aliases), "call_id", "seller_id", "needs_review") == [(1, 1, False), (2, None, True), (3, None, True), (4, 9, False)]


def test_state_log(spark):
    t = dt.datetime(2024, 1, 1)
    log = [(1, s, t, i) for i, s in enumerate(state.FORWARD)] + [(2, "DISCOVERED", t, 0), (2, "ANALYZED", t, 1), (3, "DISCOVERED", t, 0), (3, "FAILED_RETRYABLE", t, 1), (4, "ANALYZING", t, 0)]
    events = spark.createDataFrame(log, "call_id int, state string, ts timestamp, seq int")
    assert values(state.illegal_transitions(spark, events), "call_id", "state") == [(2, "ANALYZED"), (4, "ANALYZING")]
    assert values(state.current_state(events), "call_id", "state") == [(1, "ANALYZED"), (2, "ANALYZED"), (3, "FAILED_RETRYABLE"), (4, "ANALYZING")]
    assert values(state.requeue(events), "call_id", "attempts") == [(3, 1)]


def test_rubric(spark):
    core = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "dimension string, weight double")
    product = spark.createDataFrame([("b", 5.0), ("c", 1.0)], "dimension string, weight double")
    assert values(rubric.effective_rubric(core, product), "dimension", "weight", "overridden") == [("a", 1.0, False), ("b", 5.0, True), ("c", 1.0, True)]
    dims = spark.createDataFrame([(1, 10.0, 0.0), (1, 20.0, 0.0), (2, 10.0, 1.0), (2, 40.0, 3.0), (2, None, 1.0)], "call_id int, score double, weight double")
    assert values(rubric.weighted_score(dims.filter("score IS NOT NULL"), "call_id"), "call_id", "weighted_score") == [(1, None), (2, 32.5)]


def test_runs_are_only_added(spark, tmp_path):
    path = f"{tmp_path}/runs"
    one = spark.createDataFrame([(1, "k1", 5.0)], "call_id int, analysis_key string, score double")
    analysis.append_run(one, path)
    before = {p.name: p.read_bytes() for p in (tmp_path / "runs").glob("*.parquet")}
    analysis.append_run(spark.createDataFrame([(1, "k2", 7.0)], one.schema), path)
    assert all((tmp_path / "runs" / n).read_bytes() == b for n, b in before.items())
    runs = spark.read.parquet(path)
    assert values(analysis.current_runs(runs, ["call_id"], F.desc("analysis_key")), "call_id", "score") == [(1, 7.0)]
    requests = spark.createDataFrame([("k1",), ("k3",), ("k3",)], "analysis_key string")
    assert values(state.pending(requests, runs), "analysis_key") == [("k3",)]


def test_analyzer_failure_is_a_row(spark):
    class Broken:
        model_version = "broken"

        def analyze(self, transcript):
            raise ValueError(transcript)

    df = spark.createDataFrame([(1, "k", "a: hello?\nb: well, yes"), (2, "k2", None)], "call_id int, analysis_key string, full_text string")
    out = parse_output(analysis.run_analyzer(df)).orderBy("call_id").collect()
    assert [r.valid for r in out] == [True, True] and out[0].tokens > 0 and out[0].error is None
    failed = analysis.run_analyzer(df, Broken()).collect()
    assert [(r.error, r.raw_json, r.cost) for r in failed] == [("ValueError", None, 0.0)] * 2


def test_every_objection_is_kept_whole(spark):
    long = "but, " + "why " * 60
    rows = [(1, 0, "a", "hello\nthere, you"), (1, 1, "b", long), (1, 2, None, "x, y"), (1, 3, "a", None), (1, 4, "b", "p, q"), (2, 0, "a", "none")]
    segments = spark.createDataFrame(rows, "call_id int, turn int, speaker string, text string")
    lines = [(1, "there, you"), (1, f"b: {long}"), (1, "?: x, y"), (1, "b: p, q")]
    assert values(analysis.objections(segments), "call_id", "line") == sorted(lines, key=str)
    found = values(analysis.evidence(segments), "call_id", "excerpt", "claim")
    assert found == sorted([(1, "a: hello", "opening"), (2, "a: none", "opening"), *((*x, "objection") for x in lines)], key=str)
    text = "\n".join(f"{s or '?'}: {t or ''}" for i, _, s, t in rows if i == 1)
    answer = json.loads(analysis.RuleAnalyzer().analyze(text)[0])
    assert answer["objections"] == [x for _, x in lines]
    assert sorted((e["excerpt"], e["claim"]) for e in answer["evidence"]) == sorted(x[1:] for x in found if x[0] == 1)


def test_transcripts_are_counted_and_digested_without_gathering_them(spark):
    import hashlib

    rows = [(1, 1, "b", "yes?\nand, so"), (1, 0, "a", "x\u00a0y"), (1, 1, "b", "again"), (1, 2, None, None), (2, None, "a", ""), (None, 0, "c", "z, z")]
    segments = spark.createDataFrame(rows, "call_id int, turn int, speaker string, text string").repartition(3)
    ordered = {i: sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")) for i in (1, 2, None)}
    texts = {i: "\n".join(f"{s or '?'}: {t or ''}" for _, _, s, t in own) for i, own in ordered.items()}
    want = [(i, len(ordered[i]), len(t.split()), t.count("?"), sum("," in x for x in t.split("\n")), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()]
    out = ingest.normalise_transcript(segments)
    assert values(out, "call_id", "n_segments", "n_words", "n_questions", "n_objections", "text_sha256") == sorted(want, key=str)
    assert "collect_list" not in out._jdf.queryExecution().toString() and "full_text" not in out.columns
    answers = {r.call_id: r for r in parse_output(analysis.rule_answers(out)).collect()}
    for i, t in texts.items():
        raw, tokens, cost = analysis.RuleAnalyzer().analyze(t)
        same = {k: v for k, v in json.loads(raw).items() if k not in ("objections", "evidence")}
        mine = answers[i].result.asDict(recursive=True)
        assert answers[i].valid and (answers[i].tokens, answers[i].cost) == (tokens, cost) and {k: mine[k] for k in same} == same
        parts = [json.loads(r.raw_json) for r in analysis.rule_items(segments).filter(F.col("call_id").eqNullSafe(F.lit(i))).collect()]
        assert sorted(x for p in parts for x in p.get("objections", [])) == sorted(json.loads(raw)["objections"])
        assert sorted(e["excerpt"] for p in parts for e in p.get("evidence", [])) == sorted(e["excerpt"] for e in json.loads(raw)["evidence"])


def test_evidence_is_located_without_pairs(spark):
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 5, "none"), (1, 5, 9, "b"), (1, 12, None, "open"), (2, 0, 3, "c"), (None, 0, 9, "d")], "call_id int, start int, end int, segment string")
    times = [(1, 0), (1, 4), (1, 5), (1, 9), (1, 13), (2, 1), (3, 1), (None, 1), (1, None), (1, -1)]
    out = analysis.locate_evidence(spark.createDataFrame(times, "call_id int, timestamp int"), spans)
    found = {(1, 0): "a", (1, 4): "a", (1, 5): "b", (2, 1): "c"}
    assert values(out, "call_id", "timestamp", "segment") == sorted(((*t, found.get(t)) for t in times), key=str)
    assert out.columns == ["call_id", "timestamp", "start", "end", "segment"] and "Join" not in out._jdf.queryExecution().toString()


def test_metrics(spark):
    calls = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1)), (2, 1, dt.date(2024, 2, 1)), (3, 2, None)], "call_id int, seller_id int, call_date date")
    assert metrics.coverage(calls, spark.createDataFrame([(1,), (1,)], "call_id int")).first()[:] == (3, 1, 1 / 3)
    assert metrics.apply_filters(calls, seller=1, start="2024-01-15").count() == 1
    assert metrics.call_grain(calls.union(calls.limit(1))).count() == 1
    assert privacy.visible_to(calls, "guest").count() == 0
    assert "text" not in privacy.log_safe(calls.withColumn("text", F.lit("x")), ["call_id"]).columns


def test_agreement(spark):
    df = spark.createDataFrame([(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15, "a boolean, b boolean")
    assert abs(evaluate.agreement(df, F.col("a"), F.col("b")).first()["kappa"] - 0.4) < 1e-6
    same = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert evaluate.agreement(same, F.col("a"), F.col("b")).first()["kappa"] is None
