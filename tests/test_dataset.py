"""A dataset folder read as tables: sound bundles, and each way in which one is rejected."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framescope.sources import dataset, pcap

SECOND = 10**9
END = 1_700_000_100 * SECOND
FRAME = bytes.fromhex("80000000ffffffffffff0200000000010200000000011000") + bytes(8) + bytes.fromhex("64001104") + b"\x00\x03lab"


def write_bundle(folder, name, *, log="a line\nnext \xff line\n".encode("latin-1"), change=None, window=None, files=None, capture=None):
    home = folder / name
    home.mkdir(parents=True)
    capture = pcap.capture_bytes([((1_700_000_000 + k) * SECOND, FRAME) for k in range(3)]) if capture is None else capture
    sha = lambda b: hashlib.sha256(b).hexdigest()
    logs = {s: log if s == "hostapd" else b"" for s in dataset.SOURCES}
    marks = [{"unix_ns": END - 50 + k, "monotonic_ns": 900 + k} for k in range(log.count(b"\n"))]
    meta = {
        "label": "ok", "seed": 5, "split": "dev", "parameters": {"ssid": "lab"}, "kernel": "k", "tool_versions": {"x": "1"}, "started_at": "2023-11-14T22:13:20+00:00", "ended_at": "2023-11-14T22:16Z", "status": "ok", "generator_commit": "c",
        "injection_verified": True, "verification": [{"check": "a", "passed": True}], "capture_health": {"healthy": True, "ap_beacons": 3}, "observed": {"wpa_state": None, "ap_associated": True},
        "observation_end": {"unix_ns": END, "monotonic_ns": 1000, "wall_time": "2023-11-14T22:15:00+00:00"},
        "observation_window": {"version": 1, "capture": {"sha256": sha(capture), "frames": 3}, "logs": {s: {"sha256": sha(b), "line_count": b.count(b"\n"), "lines": marks if s == "hostapd" else []} for s, b in logs.items()}},
    }
    (change or (lambda m: None))(meta)
    (window or (lambda w: None))(meta.get("observation_window"))
    for s, b in logs.items():
        (home / f"{s}.log").write_bytes(b)
    (home / "capture.pcap").write_bytes(capture)
    (home / "meta.json").write_text(meta if isinstance(meta, str) else json.dumps(meta, indent=1))
    for f in files or ():
        (home / f).unlink()


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dataset") / "set"
    many = lambda **v: lambda m: m.update(v)
    write_bundle(folder, "good one+1")
    write_bundle(folder, "other", change=many(label="new class", seed="5", more=1))
    write_bundle(folder, "times", change=many(started_at="2023-11-14T22:13:20", status="failed"))
    write_bundle(folder, "health", change=many(capture_health={"healthy": "yes", "ap_beacons": True}))
    write_bundle(folder, "checks", change=many(verification=[{"passed": "true"}]))
    write_bundle(folder, "seen", change=many(observed={"ap_associated": "no"}))
    write_bundle(folder, "files", files=["dhcp_client.log", "capture.pcap"])
    write_bundle(folder, "scan", capture=pcap.capture_bytes([(SECOND, FRAME)]) + b"half", window=lambda w: w["capture"].update(frames=2))
    write_bundle(folder, "late", window=lambda w: w["logs"]["hostapd"]["lines"][1].update(monotonic_ns=5000))
    write_bundle(folder, "order", window=lambda w: w["logs"]["hostapd"]["lines"][0].update(monotonic_ns=950))
    write_bundle(folder, "digest", window=lambda w: w["logs"]["dhcp_client"].update(sha256="0" * 64, line_count=1))
    write_bundle(folder, "echo", log=b"CTRL_IFACE DEAUTH\n1700000200.0: later\n")
    write_bundle(folder, "open", change=lambda m: [m.pop(k) for k in ("observation_end", "observation_window")])
    write_bundle(folder, "bad")
    (folder / "bad" / "meta.json").write_text("no json")
    return dataset.read_dataset(spark, str(folder)), folder


def test_faults(read):
    found = {r.bundle_id: set(r.reject_reasons) for r in read[0].bundles.collect()}
    for sure, wanted in found.items():
        assert len(wanted) == len(set(wanted)), sure
    assert found.pop("good one+1") == set()
    assert found == {
        "other": {"label", "member_seed", "other_members"}, "times": {"times", "failure_without_error"}, "health": {"healthy", "beacons"}, "checks": {"verified_without_checks"}, "seen": {"observed_ap_associated"},
        "files": {"missing_dhcp_client.log", "missing_capture.pcap", "capture_digest", "capture_frames"}, "scan": {"capture_error"}, "late": {"log_after_end"}, "order": {"log_order"},
        "digest": {"log_digest", "log_receipts"}, "echo": {"log_echo", "log_after_end"}, "open": {"no_window"}, "bad": {"no_document"},
    }


def test_tables(spark, read):
    data, folder = read
    mine = F.col("bundle_id") == "good one+1"
    assert [(r.frame, r.subtype, r.ssid) for r in data.frames.where(mine).orderBy("frame").collect()] == [(k, "beacon", "lab") for k in (1, 2, 3)]
    assert [(r.source, r.line, r.text) for r in data.lines.where(mine).orderBy("line").collect()] == [("hostapd", 1, "a line"), ("hostapd", 2, "next � line")]
    row = data.bundles.where(mine).first()
    assert (row.seed, row.parameters, row.healthy, row.ap_beacons, row.checks_passed, row.observed.ap_associated, row.observed.wpa_state) == (5, '{"ssid":"lab"}', True, 3, [True], True, None)
    assert row.ended_ns - row.started_ns == 160 * SECOND
    open_ = dataset.read_dataset(spark, str(folder), require_window=False).bundles.where("bundle_id = 'open'").first()
    assert open_.reject_reasons == []


def test_models(spark, tmp_path):
    good = {"name": "a", "base_url": "https://h/v1", "model": "m", "api_key_env": "K", "unknown": 1}
    (tmp_path / "list.json").write_text(json.dumps([good, good | {"name": "b", "max_tokens": 9, "input_price_inr_per_million": 1.5}]))
    (tmp_path / "object.json").write_text(json.dumps({"models": [good, good | {"base_url": "https://u:p@h"}, good | {"name": "", "model": "", "rpm": 0, "retries": 9, "output_price_inr_per_million": -1}]}))
    models, faults = dataset.read_models(spark, str(tmp_path / "list.json"))
    assert faults.isEmpty() and [(r.name, r.max_tokens, r.context_length, r.rpm, r.input_price_inr_per_million) for r in models.orderBy("name").collect()] == [("a", 4096, 131072, 30.0, None), ("b", 9, 131072, 30.0, 1.5)]
    faults = sorted(map(tuple, dataset.read_models(spark, str(tmp_path / "object.json"))[1].collect()))
    assert faults == sorted([("a", "unique"), ("a", "unique"), ("a", "base_url"), ("", "name"), ("", "model"), ("", "rpm"), ("", "retries"), ("", "price")])


def test_only_folders_of_bundles_count(spark, tmp_path):
    """Files deeper than a bundle's own are none of a bundle's; a bundle's name may begin with an underscore, and blanks are names too."""
    write_bundle(tmp_path, "_first one")
    write_bundle(tmp_path, "second")
    write_bundle(tmp_path / "second", "deeper")
    data = dataset.read_dataset(spark, str(tmp_path))
    assert {(r.bundle_id, tuple(r.reject_reasons)) for r in data.bundles.collect()} == {("_first one", ()), ("second", ())}
    assert {(r.bundle_id, r["count"]) for r in data.lines.groupBy("bundle_id").count().collect()} == {("_first one", 2), ("second", 2)}


def rows_of(data):
    bundles = {(r.bundle_id, r.seed, tuple(r.reject_reasons)) for r in data.bundles.collect()}
    frames = sorted((r.bundle_id, r.frame, r.error or "", r.subtype or "") for r in data.frames.collect())
    return bundles, frames, sorted(map(tuple, data.lines.collect())), sorted(map(tuple, data.faults.collect()))


def test_driver_knows_no_files(spark, read):
    """Tasks list and read files, so the driver keeps no file's path; what Spark knows of their size is nothing that it would broadcast."""
    data, folder = read
    for df in (data.bundles, data.frames, data.lines, data.faults):
        assert not [f for f in df.inputFiles() if str(folder) in f]
    assert "Broadcast" not in data.bundles._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Names of all kinds, captures that are empty, cut short and no captures, files that are in no bundle, bundles without files, two folders."""
    folder = tmp_path_factory.mktemp("odd") / "a set+50%"
    for name in ("plain", "blank and+plus", "50%25", "\u00e9t\u00e9", "_low", ".dot"):
        write_bundle(folder / "part-1", name)
    for name, capture in (("empty", b""), ("short", b"\xd4\xc3"), ("text", b"no capture, but long enough"), ("head", pcap.capture_bytes([])), ("half", pcap.capture_bytes([(SECOND, FRAME)] * 3)[:-9]), ("large", pcap.capture_bytes([(SECOND, FRAME + bytes(60_000))] * 40))):
        write_bundle(folder / "part-2", name, capture=capture)
    write_bundle(folder / "part-2", "plain", files=["meta.json"])
    write_bundle(folder / "part-2" / "plain", "deeper")
    (folder / "part-2" / "nothing").mkdir()
    (folder / "part-2" / "hidden").mkdir()
    (folder / "part-2" / "hidden" / "_meta.json").write_text("{}")
    (folder / "part-2" / "stray.log").write_text("in no bundle\n")
    return folder


@pytest.mark.parametrize("below", ["part-*", "{part-1,part-2/plain}", "part-2/nothing"])
def test_tasks_find_what_spark_finds(spark, odd, below, monkeypatch):
    """Files that tasks list and read are those that Spark's own reader finds."""
    found = rows_of(dataset.read_dataset(spark, f"{odd}/{below}", require_window=False))
    monkeypatch.setattr(dataset, "list_files", lambda *_: None)
    assert rows_of(dataset.read_dataset(spark, f"{odd}/{below}", require_window=False)) == found
    if below == "part-*":
        assert {b for b, _, _ in found[0]} == {"plain", "blank and+plus", "50%25", "\u00e9t\u00e9", "_low", ".dot", "empty", "short", "text", "head", "half", "large"}
        assert ("half", 3, "truncated input") in {(b, f, e) for b, f, e, _ in found[1]} and len([x for x in found[1] if x[0] == "large"]) == 40


def test_stores_of_spark_only(spark, odd):
    """A store that pyarrow doesn't know is read by Spark; a folder that isn't there is an error."""
    spark.conf.set("fs.viewfs.mounttable.only.link./in", f"file://{odd}".replace("%", "%25").replace(" ", "%20"))
    try:
        found = rows_of(dataset.read_dataset(spark, "viewfs://only/in/part-*", require_window=False))
    finally:
        spark.conf.unset("fs.viewfs.mounttable.only.link./in")
    assert found == rows_of(dataset.read_dataset(spark, f"{odd}/part-*", require_window=False))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        dataset.read_dataset(spark, f"{odd}/part-3")
