"""Text forms, addresses in every style, credentials behind escapes."""

import json
import time

from pyspark.sql import functions as F

from framescope.functions import texts
from framescope.operators import accounting, bundles, integrity, privacy

KEY = b"framescope-sixteen-bytes"


def test_names_in_all_forms():
    name = 'a"\\\né'
    forms = texts.name_variants(name)
    assert {name, "61225c0ae9", "61225C0AE9", "61 22 5c 0a e9", "\\x61\\x22\\x5c\\x0a\\xe9", 'a\\"\\\\\\n\\xe9', 'a\\"\\\\\\n\\xE9', json.dumps(name)[1:-1], 'a\\"\\\\\\n\\u00E9'} <= forms
    assert texts.unescape_name('a\\"\\\\\\n\\xE9') == name
    assert texts.unescape_name("\\\\n \\u00e9 \\u1234 \\q \\x6") == "\\n é \\u1234 \\q \\x6" and texts.unescape_name("\\") == "\\"


def test_quotes_hold_whole_members():
    record = json.dumps({"b": [1, {"c": 2}], "a": '"b": [1', "n": 12})
    assert texts.quotes_member(record, '"n": 12}') and texts.quotes_member(record, '"n": 12') and not texts.quotes_member(record, '"n": 1')
    assert not texts.quotes_member(record, '"b": [1') and texts.quotes_member(record, '"b": [1, {"c": 2}], "n"') and not texts.quotes_member(record, 'x"n": 12')


def test_overlaps_of_identifiers():
    change = privacy.replacer(KEY, [("mac", "aa:bb:cc:00:11:22"), ("ssid", "net"), ("ssid", "network"), ("secret", "work at"), ("path", "/runs/net")])
    alias = privacy.pseudonym(KEY, "mac", "aa:bb:cc:00:11:22")
    assert change("network at net /runs/net") == f"{privacy.pseudonym(KEY, 'ssid', 'network')} at {privacy.pseudonym(KEY, 'ssid', 'net')} <bundle>"
    assert change("00 aa bb\tcc  00 11 22 33") == f"00 {alias.replace(':', ' ')} 33" and change("00AABBCC001122") == f"00{alias.replace(':', '').upper()}"
    assert change("AA-BB-CC-00-11-22") == alias and change("0aa:bb:cc:00:11:22") == "0aa:bb:cc:00:11:22" and change("") == ""
    assert privacy.redact_json({"net": ["net", {"x": "a net", "n": 1}]}, change) == {"net": [change("net"), {"x": change("a net"), "n": 1}]}


def test_parameters_at_any_depth(spark):
    deep = {"psk": "deepest"}
    for _ in range(6):
        deep = {"in": deep, "list": [{"ssid": "no member of an object's object"}], "none": None, "empty": {}}
    rows = [("b", json.dumps({"ssid": "x", "ap": {"psk": "y", "channel": 6}})), ("c", None), ("d", json.dumps(deep)), ("e", "no json"), ("f", "[1]"), ("g", "{}"), ("h", '"text"')]
    df = spark.createDataFrame(rows, "bundle_id string, parameters string")
    assert sorted(map(tuple, privacy.flattened_parameters(df).collect())) == [("b", "psk", "y"), ("b", "ssid", "x"), ("d", "psk", "deepest")]
    assert privacy.flattened_parameters(df.where("bundle_id = 'c'")).collect() == []


def test_bundle_is_redacted_end_to_end(spark):
    bundles_ = spark.createDataFrame([("a", json.dumps({"ap": {"ssid": "Lab net", "wpa_passphrase": "s3cret-word"}}), "/runs/ok/a1"), ("b", None, "/runs/b1")], "bundle_id string, parameters string, path string")
    records = spark.createDataFrame([("a", 1, json.dumps({"addrs": ["02:00:00:00:00:aa"], "ssid": "Lab net", "n": 1, "in": {"x": ["at a1"]}})), ("b", 1, json.dumps({"ssid": "Lab net"}))], "bundle_id string, frame int, json string")
    names = spark.createDataFrame([("b", "other")], "bundle_id string, ssid string")
    lines = spark.createDataFrame([("a", "hostapd", 1, "station 02-00-00-00-00-BB joined"), ("a", "wpa_supplicant", 1, "raw 0200000000bb and 4c6162206e6574, s3cret-word in /runs/ok/a1/x"), ("a", "wpa_supplicant", 2, None), ("b", "wpa_supplicant", 1, 'raw 0200000000bb ssid="mine" other mine')], "bundle_id string, source string, line int, text string")
    stats = spark.createDataFrame([("a", "1 of Lab net from 02:00:00:00:00:AA"), ("b", "none")], "bundle_id string, stats string")
    shown, seen, told = privacy.redact_bundles(bundles_, records, names, lines, stats, KEY, "client")
    alias = lambda kind, v: privacy.pseudonym(KEY, kind, v)
    aa, bb, net = alias("mac", "02:00:00:00:00:aa"), alias("mac", "02:00:00:00:00:bb"), alias("ssid", "Lab net")
    assert {r.bundle_id: json.loads(r.json) for r in shown.collect()} == {"a": {"addrs": [aa], "ssid": net, "n": 1, "in": {"x": ["at <bundle>"]}}, "b": {"ssid": "Lab net"}}
    assert {(r.bundle_id, r.source, r.line): r.text for r in seen.collect()} == {("a", "wpa_supplicant", 1): f"raw {bb.replace(':', '')} and {net}, <redacted-secret> in <bundle>/x", ("a", "wpa_supplicant", 2): None, ("b", "wpa_supplicant", 1): f'raw 0200000000bb ssid="{alias("ssid", "mine")}" {alias("ssid", "other")} {alias("ssid", "mine")}'}
    assert {r.bundle_id: r.stats for r in told.collect()} == {"a": f"1 of {net} from {aa}", "b": "none"}


def test_recorded_attempts(spark):
    rows = [(1, json.dumps({"attempts": [{"status": 429, "error": "slow"}, {"status": None, "error": "request timed out", "more": {}}, {"status": "x"}, 5], "z": 1})), (2, "no json"), (3, json.dumps({"attempts": "none"})), (4, None)]
    found = accounting.recorded_attempts(spark.createDataFrame(rows, "k int, trace string"), ["k"])
    assert {r.k: [tuple(a) for a in r.attempts] for r in found.collect()} == {1: [(0, 429, "slow"), (1, None, "request timed out"), (2, None, None), (3, None, None)], 2: [], 3: [], 4: []}
    again = {(r.status, r.error): (r.retryable, r.n) for r in accounting.retries(found.where("k = 1"), ["k"]).collect()}
    assert again == {(429, "slow"): (True, 1), (None, "request timed out"): (True, 1), (None, None): (False, 2)}


def test_credentials_behind_layers(spark):
    secret = 'k"e/y'
    inner = json.dumps({"auth": secret})
    bodies = [f"plain {secret}.", inner, json.dumps({"deep": json.dumps({"x": inner})}), "nothing \\u006b here", "k\\u0022e\\/y", None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    out = [r.b for r in df.select("k", accounting.scrub_credential(F.col("body"), secret).alias("b")).orderBy("k").collect()]
    mark = "[REDACTED CREDENTIAL]"
    assert out[0] == f"plain {mark}." and json.loads(out[1]) == {"auth": mark} and json.loads(json.loads(json.loads(out[2])["deep"])["x"]) == {"auth": mark}
    assert out[3:] == [bodies[3], mark, None]


def test_config_values_last_wins(spark):
    df = spark.createDataFrame([("a=1\nb = x=y\n# none\r\n a=2",), ("",), (None,)], "t string")
    out = [r.m for r in df.select(texts.config_values(F.col("t")).alias("m")).collect()]
    assert out == [{"a": "2", "b ": " x=y"}, {}, None]


def test_many_config_lines_take_one_pass(spark):
    lines = 40_000  # where a sort for each line would take over an hour
    text = "\n".join(f"key{k % 30_000}={k}" for k in range(lines))
    began = time.perf_counter()
    found = spark.createDataFrame([(text,)], "t string").select(texts.config_values(F.col("t")).alias("m")).first().m
    assert time.perf_counter() - began < 20
    assert found == {f"key{k % 30_000}": str(k) for k in range(lines)}


def test_no_character_hides_an_address():
    change = privacy.replacer(KEY, [("mac", "02:00:00:00:00:aa")])
    alias = privacy.pseudonym(KEY, "mac", "02:00:00:00:00:aa")
    bare = alias.replace(":", "")
    assert change("\u0130 raw 0200000000aa end") == f"\u0130 raw {bare} end"
    assert change("\u0130\u0130 0200000000AA \u1e9e 0200000000aa") == f"\u0130\u0130 {bare.upper()} \u1e9e {bare}"


def test_stamps_beyond_the_range_end_no_query(spark):
    lines = ["123456789012: x", "99999999999999999999999: x", "9223372036.854775807 x", "9223372036.854775808 x", "1700000000.5: x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(integrity.embedded_ns(F.col("t"))).collect()]
    top = (1 << 63) - 1
    assert got == [top, top, top, top, 1_700_000_000_500_000_000]
    cut = bundles.window_cut(spark.range(1), *(F.lit(x) for x in (1, 1, 2_000_000_000_000_000_000, 2)), F.lit("123456789012: x"))
    assert spark.range(1).select(cut.alias("c")).first().c == "own_time_after_end"
