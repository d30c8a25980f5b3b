"""Bundles, runs, sinks: what the queries don't reach."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framescope.operators import bundles, frames, runs
from framescope.streaming import windows


def test_window_record(spark):
    good = dict(version=1, end_unix_ns=1_700_000_000_000_000_500, end_monotonic_ns=50, end_wall="2023-11-14T22:13:20.000000Z", scenario_wall="2023-11-14T23:13:19+01:00", scenario_monotonic_ns=10, capture_digest="d", found_capture_digest="d", capture_frames=2, found_frames=2, last_frame_ns=1_700_000_000_000_000_000)
    rows = [good, good | dict(end_wall="2023-11-14T22:13:21Z", last_frame_ns=1_800_000_000_000_000_000), good | dict(version=2, scenario_wall="2023-11-14T22:13:19", scenario_monotonic_ns=51, found_frames=3), dict.fromkeys(good)]
    schema = "version int, end_unix_ns long, end_monotonic_ns long, end_wall string, scenario_wall string, scenario_monotonic_ns long, capture_digest string, found_capture_digest string, capture_frames long, found_frames long, last_frame_ns long"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    out = [r.f for r in df.select(bundles.window_record_faults().alias("f")).collect()]
    assert out == [[], ["clocks_disagree", "frame_after_end"], ["version", "scenario_time", "scenario_monotonic", "capture_frames"], ["no_window"]]
    assert df.select(bundles.window_record_faults(require=False).alias("f")).collect()[3].f == []


def test_models(spark):
    rows = [("a", "https://host/v1", 100, 10), ("b", "http://u@host", 100, 10), ("b", "https://h?q=1", 10, 10), ("c", "ftp://h", 0, 1)]
    out = sorted(map(tuple, bundles.model_faults(spark.createDataFrame(rows, "name string, base_url string, context_length int, max_tokens int")).collect()))
    assert out == sorted([("b", "unique"), ("b", "base_url"), ("b", "unique"), ("b", "base_url"), ("b", "max_tokens"), ("c", "base_url"), ("c", "context_length"), ("c", "max_tokens")])


@pytest.fixture
def pair(spark):
    return spark.createDataFrame([("x", 2, "z"), ("y", 1, None)], "bundle_id string, b int, a string")


def test_freeze_exists_once(pair, tmp_path):
    bundles.freeze(pair, str(tmp_path / "freeze"))
    with pytest.raises(AnalysisException):
        bundles.freeze(pair, str(tmp_path / "freeze"))


def test_trace_is_appended(spark, pair, tmp_path):
    for _ in range(2):
        bundles.append_trace(pair, str(tmp_path / "trace"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "trace")).collect())
    assert lines == sorted(['{"a":"z","b":2,"bundle_id":"x"}', '{"a":null,"b":1,"bundle_id":"y"}'] * 2)


def test_write_by_bundle(spark, pair, tmp_path):
    bundles.write_by_bundle(pair, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"bundle_id=x", "bundle_id=y"}
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "by")).select("bundle_id", "b").collect())) == [("x", 2), ("y", 1)]


def test_write_audit(spark, pair, tmp_path):
    bundles.write_audit(pair, str(tmp_path / "audit"))
    found = spark.read.option("header", True).csv(str(tmp_path / "audit"))
    assert found.columns == pair.columns and found.count() == 2


def test_read_manifest(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"bundles": [{"id": "x", "split": "dev"}, {"id": "y", "split": "test"}]}, indent=1))
    assert sorted(map(tuple, bundles.read_manifest(spark, str(tmp_path / "manifest.json"), "id: string, split: string").collect())) == [("x", "dev"), ("y", "test")]


def test_read_prompts(spark, tmp_path):
    (tmp_path / "prompt.txt").write_text("Say what is wrong.")
    assert runs.read_prompts(spark, str(tmp_path / "prompt.txt")).first().content == "Say what is wrong."


def test_manifest_entries(spark, pair):
    files = spark.createDataFrame([("x", "b.log", "1"), ("x", "a.log", "2")], "bundle_id string, name string, digest string")
    assert bundles.manifest_entries(files, pair).where("bundle_id = 'x'").first().entry == '{"a":"z","b":2,"bundle_id":"x","files":{"a.log":"2","b.log":"1"}}'


def test_stamped_stream(spark):
    stream = windows.stamped(spark.readStream.format("rate").load())
    assert stream.isStreaming and "unix_ns" in stream.columns


def test_zoned_times_without_seconds(spark):
    texts = ["2024-01-01T10:00Z", "2024-01-01 12:00+02:00", "2024-01-01T10:00:00.5Z", "2024-01-01T10:00.5Z", "2024-01-01T10:00"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(bundles.zoned_ns(F.col("t")).alias("ns")).collect()
    assert [r.ns for r in found] == [1704103200000000000, 1704103200000000000, 1704103200500000000, None, None]


def test_log_digest_counts_null_lines(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y")], "k string, line int, text string")
    found = bundles.log_snapshots(rows, ["k"], "line", "text").first()
    assert (found.line_count, found.digest) == (3, hashlib.sha256(b"x\n\ny\n").hexdigest())


def test_pairs_that_disagree_on_the_label_do_not_count(spark):
    rows = spark.createDataFrame([("a", 1, "x", "x"), ("b", 1, "y", "z"), ("a", 2, "x", "x"), ("b", 2, "x", "y")], "g string, k int, label string, prediction string")
    assert tuple(bundles.paired_groups(rows, "g", "k", "label", "prediction").first()) == ("a", "b", 1, 1.0, 1, 0)
    assert [tuple(r) for r in bundles.pairing_faults(rows, "g", "k", "label").collect()] == [(1, "label_differs")]


def test_runs(spark):
    df = spark.createDataFrame([(1, "ap_full", 17), (2, "ok", None)], "k int, label string, status int")
    rules = runs.Rules().add("ap_full", F.col("status") == 17).add("mac_denied", F.col("status") > 0)
    assert [r.d for r in df.select(rules.diagnosis().alias("d")).collect()] == ["ap_full", "unknown"]
    assert df.select(runs.Rules().diagnosis().alias("d")).first().d == "unknown"
    checks = spark.createDataFrame([("a", "ok", "ping", True), ("b", "ok", "other", False), ("c", "new", "ping", True)], "bundle_id string, label string, name string, passed boolean")
    assert {r.bundle_id: r.faults for r in runs.verification_faults(checks, {"ok": ["ping"]}).collect()} == {"b": ["checks_missing", "check_failed"], "c": ["known_class"]}
    meta = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "bundle_id string, quarantined boolean")
    rows, left_out = runs.probe_rows(meta, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "bundle_id string, x double"))
    assert [r.bundle_id for r in rows.collect()] == ["a"] and sorted(map(tuple, left_out.collect())) == [("quarantined", 1), ("unreadable", 1)]
    lines = spark.createDataFrame([("a", "wpa_supplicant", k, "x" * 30) for k in range(1, 30)], "bundle_id string, source string, line int, text string")
    kept = bundles.shared_budget(lines, "bundle_id", 400, "client").join(lines, ["bundle_id", "source", "line"])
    message = runs.first_messages(kept, spark.createDataFrame([("a", "1 network"), ("z", "none")], "bundle_id string, summary string"), "bundle_id", "Judge.").where("bundle_id = 'a'").first().message
    assert message.startswith("Judge.\n\n1 network\n\nwpa_supplicant:\n[... ") and message.endswith("29: " + "x" * 30)
    assert sorted(r.value for r in bundles.with_defaults(spark.createDataFrame([("python", "3")], "name string, value string"), ["python", "tshark"]).collect()) == ["3", "unavailable"]
    assert bundles.range_overlaps(bundles.split_ranges(spark), ["parameter"], "split", "low", "high").isEmpty()


def test_frame_lookup_and_names(spark):
    df = spark.createDataFrame([("p", 1, bytearray(b'a"\\\xe9\x00~')), ("p", 2, None)], "path string, frame long, raw binary")
    assert frames.frame(df, 2).first().frame == 2 and frames.frame(df, 1, "p").count() == 1
    with pytest.raises(LookupError):
        frames.frame(df, 3)
    assert [r.n for r in df.select(frames.escaped_name(F.col("raw")).alias("n")).collect()] == ['a\\"\\\\\\u00e9\\u0000~', None]


def test_redaction_calls_nothing_for_each_bundle(spark):
    """A call and a table for each bundle cost more than its texts; bundles are read one after the other."""
    from framescope.operators import privacy

    rows = spark.createDataFrame([("a", 1, "at 0A0000000001, net"), ("a", 2, None), ("b", 1, "at 0a0000000001, net"), (None, 1, "x")], "bundle_id string, n int, text string")
    known = spark.createDataFrame([("a", "mac", "0a:00:00:00:00:01"), ("b", "ssid", "net"), ("c", "ssid", "x")], "bundle_id string, kind string, value string")
    found = privacy.redact(rows, known, b"k" * 16)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    bare, name = privacy.address_alias(b"k" * 16, "0a0000000001").upper(), privacy.name_alias(b"k" * 16, "net")
    assert {(r.bundle_id, r.n, r.text) for r in found.collect()} == {("a", 1, f"at {bare}, net"), ("a", 2, None), ("b", 1, f"at 0a0000000001, {name}"), (None, 1, "x")}
