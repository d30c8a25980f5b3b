import hashlib
import hmac
import math
import time

import pytest
from pyspark.sql import functions as F

from framescope.functions import scalars, statistics
from framescope.operators import citations, evaluation, integrity, privacy, relations, sequences, summaries
from framescope.streaming import windows

KEY = b"sixteen bytes or more"


def test_exact_statistics(spark):
    rows = [(0, 10), (3, 10), (10, 10), (0, 0), (480, 500)]
    out = spark.createDataFrame(rows, "k long, n long").select("k", "n", statistics.clopper_pearson(F.col("k"), F.col("n")).alias("c")).collect()
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    for r in out:
        if not r.n:
            assert r.c is None
            continue
        assert r.c.low == 0 if r.k == 0 else math.isclose(tail(r.k, r.n, r.c.low), 0.025, rel_tol=1e-6)
        assert r.c.high == 1 if r.k == r.n else math.isclose(1 - tail(r.k + 1, r.n, r.c.high), 0.025, rel_tol=1e-6)
    pairs = [(0, 0), (5, 5), (1, 9), (0, 6)]
    got = [r.p for r in spark.createDataFrame(pairs, "b long, c long").select(statistics.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    want = [min(1.0, 2 * sum(math.comb(b + c, i) for i in range(max(b, c), b + c + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in pairs]
    assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(got, want))


def test_pseudonyms(spark):
    digest = hmac.new(KEY, b"name", hashlib.sha256).hexdigest()
    assert spark.range(1).select(scalars.hmac_sha256(KEY, F.lit("name"))).first()[0] == digest
    rows = spark.createDataFrame([("a", 1, "lab and lab2 at AA:BB:CC:00:11:22, 99AABBCC00112299 AA BB  CC 00 11 22"), ("a", 2, None), ("b", 1, "lab 00-11-22-aa-bb-cc aabbcc001122"), ("a", 3, "6c6162 hunter2 /runs/a")], "bundle_id string, line int, text string")
    texts = spark.createDataFrame([("a", 'ssid="lab2" from aa-bb-cc-00-11-22'), ("a", "ssid: ''"), ("b", None)], "bundle_id string, text string")
    names = spark.createDataFrame([("a", "lab"), ("a", None), ("b", "")], "bundle_id string, ssid string")
    parameters = spark.createDataFrame([("a", "wpa_passphrase", "hunter2"), ("a", "channel", "6")], "bundle_id string, name string, value string")
    learnt = privacy.learn_identifiers(texts, names, parameters)
    known = [("mac", "aa:bb:cc:00:11:22"), ("secret", "hunter2"), ("ssid", "lab"), ("ssid", "lab2")]
    assert sorted((r.kind, r.value) for r in learnt.collect()) == known and learnt.where("bundle_id <> 'a'").isEmpty()
    paths = spark.createDataFrame([("a", "path", "/runs/a")], "bundle_id string, kind string, value string")
    out = {(r.bundle_id, r.line): r.text for r in privacy.redact(rows, learnt.unionByName(paths), KEY).collect()}
    address, lab = privacy.pseudonym(KEY, "mac", "aa:bb:cc:00:11:22"), privacy.pseudonym(KEY, "ssid", "lab")
    assert lab == "ssid-" + hmac.new(KEY, b"ssid\0lab", hashlib.sha256).hexdigest()[:8]
    assert out["a", 1] == f"{lab} and {privacy.pseudonym(KEY, 'ssid', 'lab2')} at {address}, 99{address.replace(':', '').upper()}99 {address.replace(':', ' ').upper()}"
    assert out["a", 2] is None and out["a", 3] == f"{lab} <redacted-secret> <bundle>"
    assert out["b", 1] == f"lab {privacy.pseudonym(KEY, 'mac', '00:11:22:aa:bb:cc')} aabbcc001122"
    assert int(address[:2], 16) & 3 == 2
    with pytest.raises(ValueError):
        privacy.pseudonym(b"short", "ssid", "x")


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\x0bc\x85d e\n"), (2, ""), (3, None), (4, "\n\nx")], "id int, text string")
    got = {}
    for r in sequences.lines_of(df, ["id"], "text").orderBy("id", "line").collect():
        got.setdefault(r.id, []).append(r.content)
    assert got == {1: "a\r\nb\x0bc\x85d e\n".splitlines(), 4: ["", "", "x"]}
    part = sequences.line_range(df, ["id"], "text", 2, 3).collect()
    assert sorted((r.id, r.line, r.content, r.total_lines) for r in part) == [(1, 2, "b", 5), (1, 3, "c", 5), (4, 2, "", 3), (4, 3, "x", 3)]
    with pytest.raises(ValueError):
        sequences.line_range(df, ["id"], "text", 1, 81)


def test_window_faults_and_stamps(spark):
    df = spark.createDataFrame([("b", 1, 10, 10), ("b", 2, 30, 20), ("b", 3, 15, 15), ("b", 4, None, 16)], "id string, line int, wall long, mono long")
    out = {r.fault: r.n for r in integrity.window_faults(df, ["id"], "line", "wall", "mono", F.lit(20), F.lit(18)).collect()}
    assert out == {"after_wall_end": 1, "after_monotonic_end": 1, "goes_back": 1, "receipt_missing": 1}
    lines = [("1700000000.5: up",), (" 1700000000 x",), ("170: x",), ("none",)]
    got = [r[0] for r in spark.createDataFrame(lines, "t string").select(integrity.embedded_ns(F.col("t"))).collect()]
    assert got == [1700000000500000000, 1700000000000000000, None, None]


def test_citations(spark):
    rows = spark.createDataFrame([("x", "log", k, f"line  {k % 2} of the log") for k in range(8)], "bundle_id string, source string, ref long, text string")
    said = [("x", "log", 1, "line 1 of the log", False), ("x", "log", 2, "line 1 of the log", False), ("x", "log", 3, "line 1", False), ("x", "log", 3, "line 1 of the log", True), ("x", "log", 99, "nowhere to be found", False)]
    out = citations.verify_citations(spark.createDataFrame(said, "bundle_id string, source string, ref long, quote string, auto boolean"), rows)
    assert sorted((r.ref, r.quote[:6], r.auto, r.eligible, r.valid, r.places, r.ambiguous) for r in out.collect()) == [
        (1, "line 1", False, True, True, 4, True), (2, "line 1", False, True, False, 4, True), (3, "line 1", False, False, False, 4, True), (3, "line 1", True, True, True, 4, False), (99, "nowher", False, True, False, 0, False),
    ]
    total = citations.citation_counts(out, ["bundle_id"]).first()
    assert (total.valid, total.invalid, total.ambiguous, total.eligible, total.automatic, total.all_valid) == (2, 3, 3, 4, 1, False)


def test_group_metrics(spark):
    schema = "group string, label string, prediction string, schema_failure boolean, error string, excluded boolean, exclusion_reason string, outcome string, latency_ms double, cost double"
    rows = [("g", "a", "a", False, None, False, None, "DIAGNOSED", 10.0, 1.0), ("g", "a", "unknown", True, None, False, None, "SCHEMA_FAILURE", 20.0, None), ("g", "b", "b", False, "E", True, "", "DIAGNOSED", None, 2.0), ("g", "b", "b", False, None, False, None, "TRUNCATED", 30.0, 1.0)]
    r = evaluation.group_metrics(spark.createDataFrame(rows, schema), 9).first()
    assert (r.n, r.evaluated, r.accuracy, r.unknown_rate, r.schema_failure_rate, r.execution_error_rate) == (4, 2, 0.5, 0.5, 0.5, 0.25)
    assert (r.latency_p50, r.known_cost, r.cost) == (20.0, 4.0, None) and math.isclose(r.macro_f1, 2 / 3 / 9)


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("x"))
    r = evaluation.bootstrap_interval(df, [], "x", "id", resamples=300).first()
    assert r.n == 400 and r.mean == 0.25 and 0.19 < r.low < 0.25 < r.high < 0.31


def test_passages_that_start_inside_words(spark):
    texts = spark.createDataFrame([(1, "xxthe quick brown fox jumps over"), (2, "the quick brown cat"), (3, None), (4, "a shortpassage here")], "id int, text string")
    passages = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "shortpassage"), (3, "tiny")], "pid int, text string")
    got = relations.passage_hits(texts, "id", "text", passages.withColumnRenamed("text", "passage"), "pid", "passage").collect()
    dealt = relations.passage_hits(texts, "id", "text", passages.withColumnRenamed("text", "passage"), "pid", "passage", most_bytes=100, parts=3).collect()
    assert sorted(map(str, dealt)) == sorted(map(str, got))  # whether the passages travel whole or in parts
    assert sorted((r.pid, r.id, r.first_at) for r in got) == [(1, 1, 3), (2, 4, 3)]


def test_majority_and_costs(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("m", "z")], "key string, v string")
    assert {r.key: (r.v, r.n) for r in summaries.majority(df, ["key"], "v").collect()} == {"k": ("a", 2), "m": ("z", 1)}
    calls = spark.createDataFrame([(1000, 100, 0), (1000, 100, 2000), (None, 1, 0), (1000, 100, 500)], "p long, c long, h long")
    c = scalars.call_cost(F.col("p"), F.col("c"), F.col("h"), F.lit(2.0), F.lit(10.0), F.lit(None).cast("double"))
    assert [(r[0].cost, r[0].status) for r in calls.select(c).collect()] == [(0.003, "estimated_from_returned_usage"), (None, "invalid_cached_usage"), (None, "missing_usage"), (None, "missing_price")]


def test_streams(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:01", "a"), ("u", "2024-01-01 00:00:02", "b"), ("u", "2024-01-03 00:00:00", "a")]
    spark.createDataFrame(rows, "user string, t string, step string").selectExpr("user", "timestamp(t) as ts", "step").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, step string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("kept", windows.observed_until(stream, "ts", "2024-01-02 00:00:00"), "append"), ("masks", windows.stream_step_mask(stream, ["user"], "ts", "step", ["a", "b"]), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        time.sleep(0.1)
    assert spark.table("kept").count() == 2
    assert sorted((r.mask, r.complete) for r in spark.table("masks").collect()) == [(1, False), (3, True)]


def test_leak_probe_grades_rows_it_has_not_seen(spark):
    # dimension 0 is large noise until scaled; dimension 1 tells dev's labels, and in test rows the opposite
    rows = [(k, [1000.0 * (k * 7 % 11), float(k % 2)], "ab"[k % 2 if k < 80 else 1 - k % 2]) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    r = evaluation.leak_probe(df, "id", "v", "label", F.col("id") < 80).first()
    assert (r.n, r.hits, r.base_hits, r.flagged) == (20, 0, 10, False)
    told = df.withColumn("label", F.when(F.col("v")[1] == 1, "b").otherwise("a"))
    r = evaluation.leak_probe(told, "id", "v", "label", F.col("id") < 80).first()
    assert (r.n, r.hits, r.base_hits, r.flagged) == (20, 20, 10, True) and r.shuffled_hits is not None
    r = evaluation.leak_probe(told, "id", "v", "label", F.lit(False)).first()
    assert (r.n, r.hits, r.flagged) == (100, 0, None)
    ranks = evaluation._ranks(df.select(F.col("id").alias("_id")), F.xxhash64("_id"))
    assert sorted(x._rank for x in ranks.collect()) == list(range(1, 101))


def test_registered_bootstrap_takes_all_resamples(spark, monkeypatch):
    from framescope.plans import catalogue

    asked = []
    whole = evaluation.bootstrap_interval
    monkeypatch.setattr(evaluation, "bootstrap_interval", lambda *a, **k: asked.append(k.get("resamples", 2000)) or whole(*a, **k))
    r = catalogue.QUERIES["q41_bootstrap"](spark, "/root/testdata/sf0.001").first()
    assert asked == [2000] and r.low < r.mean < r.high


def test_quantiles_are_exact_however_rows_are_spread(spark):
    rows = [("hot", float(k * k % 997)) for k in range(2000)] + [("same", 5.0)] * 300 + [("one", -1.5), ("empty", None), (None, 1.0), (None, 2.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    out = {r.k: r for r in summaries.quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "high": 0.95}, F.max("v").alias("top"), parts=8).collect()}
    for key in ("hot", "same", "one", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        for name, share in (("low", 0.0), ("mid", 0.5), ("high", 0.95)):
            at = (len(values) - 1) * share
            wanted = values[math.floor(at)] + (at - math.floor(at)) * (values[math.ceil(at)] - values[math.floor(at)])
            assert math.isclose(out[key][name], wanted), (key, name)
        assert out[key].n == len(values) and out[key].top == values[-1]
    assert out["empty"].n == 0 and out["empty"].mid is None
    assert summaries.quantiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0
    assert summaries.quantiles(df.where("k = 'same'"), [], "v", {"mid": 0.5}).first().mid == 5.0
