import json

from pyspark.sql import functions as F

from framescope.functions import texts
from framescope.operators import accounting, observation

AP, STA, OTHER = "02:00:00:00:00:01", "02:00:00:00:00:02", "02:00:00:00:00:09"
FRAMES = "bundle_id string, frame long, ts_ns long, addrs array<string>, type_id int, subtype_id int, eapol_msg int, status_code int, reason_code int, bssid string"
BUNDLES = "bundle_id string, label string, ap_mac string, station_mac string, started_ns long, started_monotonic_ns long, capture_bytes long, scan_error string"


def bundles(spark):
    return spark.createDataFrame([("x", "ok", AP.upper(), STA, 1_000_000_000, 50, 10, None), ("y", "ok", AP, STA, None, None, None, None), ("z", "bad", AP, "", 0, 0, 10, "truncated input")], BUNDLES)


def frames(spark):
    rows = [
        ("x", 1, 500_000_000, [AP, STA, AP], 0, 11, None, None, None, AP),  # before the start
        ("x", 2, 2_000_000_000, [AP, STA, AP], 0, 11, None, 0, None, AP),
        ("x", 3, 3_000_000_000, [STA, AP, AP], 0, 1, None, 17, None, AP),
        ("x", 4, 3_500_000_000, [STA, OTHER, AP], 2, 8, 1, None, None, AP),  # not of the pair
        ("x", 5, 4_000_000_000, [STA, AP, AP], 2, 8, 2, None, None, AP),
        ("x", 6, 5_000_000_000, ["ff:ff:ff:ff:ff:ff", AP, AP], 0, 12, None, None, 7, AP),
        ("x", 7, 5_000_000_000, [STA, AP, AP], 0, 12, None, None, 3, AP),
        ("x", 8, 5_000_000_000, ["ff:ff:ff:ff:ff:ff", AP, AP], 0, 8, None, None, None, AP),
        ("z", 1, 5_000_000_000, [STA, AP, AP], 0, 12, None, None, 2, AP),
    ]
    return spark.createDataFrame(rows, FRAMES)


def test_runs(spark):
    lines = spark.createDataFrame([("x", "dhcp_client", 1, "starting, status_code=4", 60), ("x", "dhcp_client", 2, "DHCPDISCOVER on wlan1", 2_000_000_050), ("x", "dhcp_client", 3, "bound to 10.0.0.4 now", 3_000_000_050), ("x", "hostapd", 1, "short", 1), ("y", "dhcp_client", 1, "nothing to be seen here", 1)], "bundle_id string, source string, line int, text string, monotonic_ns long")
    firsts = observation.first_run_events(frames(spark), lines, bundles(spark))
    assert {(r.bundle_id, r.event): r.elapsed for r in firsts.collect()} == {("x", "auth"): 1.0, ("x", "assoc"): 2.0, ("x", "eapol"): 3.0, ("x", "dhcp"): 2.0}
    clocks = bundles(spark).select("bundle_id", "label", F.col("started_ns").isNotNull().alias("capture_clock"), F.lit(False).alias("log_clock"))
    summary = {(r.label, r.event): (r.n, r.available, r.median) for r in observation.run_event_summary(firsts, clocks).collect()}
    assert summary["ok", "auth"] == (1, 1, 1.0) and summary["bad", "dhcp"] == (0, 0, None) and len(summary) == 8
    codes = {r.bundle_id: r for r in observation.code_sets(frames(spark), bundles(spark)).collect()}
    assert (codes["x"].status_codes, codes["x"].reason_codes, codes["x"].ap_to_station_reasons, codes["x"].ap_to_broadcast_reasons) == ([0, 17], [3, 7], [3], [7])
    assert codes["z"].other_reasons == [2] and codes["z"].ap_to_station_reasons == []
    assert {r.bundle_id: r.lease_logged for r in observation.lease_logged(lines).collect()} == {"x": True, "y": False}
    assert [r.line for r in observation.code_lines(lines).collect()] == [1]
    health = {r.bundle_id: (r.healthy, r.ap_beacons, r.error) for r in observation.capture_health(bundles(spark), frames(spark)).collect()}
    assert health == {"x": (True, 1, None), "y": (False, 0, "capture missing or empty"), "z": (False, 0, "capture parser error: truncated input")}
    shown = spark.createDataFrame([("y", 3, "{}"), ("w", 4, '{"frame": 4}'), ("w", 2, '{"frame": 2}')], "bundle_id string, frame long, json string")
    cited = {r.bundle_id: (r.source, r.ref, r.quote) for r in observation.first_evidence(lines, shown, ["hostapd", "dhcp_client"]).collect()}
    assert cited == {"x": ("dhcp_client", 1, "starting, status_code=4"), "y": ("dhcp_client", 1, "nothing to be seen here"), "w": ("frame", 2, '{"frame": 2}')}


def test_station_listings_and_outcomes(spark):
    listing = {"a": [OTHER, "flags=[AUTH]", f" {STA.upper()} ", "x=1", "flags=[AUTH][ASSOC]"], "b": [], "c": ["no record"], "d": [STA, "flags=[ASSOC][AUTHORIZED]", STA], "e": [OTHER, "flags=[ASSOC]"]}
    lines = spark.createDataFrame([(k, n, t) for k, rows in listing.items() for n, t in enumerate(rows)], "bundle_id string, line int, text string")
    stations = spark.createDataFrame([(k, STA) for k in listing], "bundle_id string, station_mac string")
    out = {r.bundle_id: (r.associated, r.authorized, r.error and r.error.split()[0]) for r in observation.station_flags(lines, stations).collect()}
    assert out == {"a": (True, False, None), "b": (False, False, None), "c": (None, None, "AP"), "d": (None, None, "target"), "e": (False, False, None)}
    runs = spark.createDataFrame([("ok", "COMPLETED", True, True, True), ("ok", "SCANNING", None, None, None), ("bad", "COMPLETED", True, True, None), ("bad", None, False, None, None)], "label string, wpa_state string, ipv4_lease_present boolean, ap_associated boolean, ap_authorized boolean")
    counts = {(r.label, r.field, r.value): r.n for r in observation.outcome_distributions(runs).collect()}
    assert counts["ok", "ipv4_lease_present", "unknown"] == 1 and counts["bad", "wpa_state", "COMPLETED"] == 1 and counts["bad", "ap_associated", "true"] == 1
    flags = {(r.label, r.is_total): (r.runs, r.failure_completed_with_lease, r.ok_missing_completed_or_lease, r.outcome_unknown) for r in observation.outcome_mismatches(runs).collect()}
    assert flags == {("ok", False): (2, 0, 1, 1), ("bad", False): (2, 1, 0, 1), (None, True): (4, 1, 1, 2)}
    steps = spark.createDataFrame([("p", 1, "done"), ("p", 2, "ack"), ("q", 1, "ack"), ("q", 2, "done"), ("r", 1, "done")], "k string, n int, what string")
    got = observation.acknowledged_after(steps, ["k"], "n", F.col("what") == "done", F.col("what") == "ack").collect()
    assert {r.k: r.acknowledged for r in got} == {"p": True, "q": False, "r": False}


def test_call_accounts(spark):
    plans = spark.createDataFrame([(1000, True), (1000, False), (120000, True), (110000, True)], "initial long, tools boolean").select(accounting.context_plan(F.col("initial"), F.lit(4096), F.lit(131072), F.col("tools")).alias("p"))
    assert [tuple(r.p) for r in plans.collect()] == [(True, 16000, 25192), (True, 0, 9192), (False, None, None), (True, 8784, 126976)]
    schema = "run string, call_index int, estimate long, largest_prompt long, finish_reason string, error string, stage string, tokens long, attempts array<struct<index:int,status:int,error:string>>"
    ok, late, gone = [(0, 200, None)], [(0, 503, "HTTP 503"), (1, 200, None)], [(0, None, "request timed out"), (1, 400, "HTTP 400")]
    rows = [("a", 0, 5, 9, "tool_calls", None, "tool_calls", 3, ok), ("a", 1, 6, 9, "stop", None, "diagnosis", 4, late), ("b", 0, 5, 9, "length", None, None, None, ok), ("c", 0, 5, 9, None, "HTTP 400", None, 1, gone), ("d", 0, 5, 9, "stop", None, None, 1, ok), ("e", 0, 10, 9, None, None, None, 1, None)]
    calls = spark.createDataFrame(rows, schema)
    assert {r.run: r.outcome for r in accounting.run_outcomes(calls, ["run"]).collect()} == {"a": "DIAGNOSED", "b": "TRUNCATED", "c": "ERROR", "d": "SCHEMA_FAILURE", "e": "CONTEXT_REJECTED"}
    assert {r.run: r.tokens for r in accounting.run_totals(calls, ["run"], ["tokens"]).where("run < 'd'").collect()} == {"a": 7, "b": None, "c": 1}
    assert {(r.status, r.error): (r.retryable, r.n) for r in accounting.retries(calls, []).collect()} == {(200, None): (False, 4), (503, "HTTP 503"): (True, 1), (None, "request timed out"): (True, 1), (400, "HTTP 400"): (False, 1)}
    rounds = spark.createDataFrame([([("1",), ("1",)],), ([],), ([(None,)],), ([(str(k),) for k in range(6)],)], "calls array<struct<id:string>>")
    assert [r[0] for r in rounds.select(accounting.tool_round_faults(F.col("calls"))).collect()] == [["id_repeated"], ["round_size"], ["id_missing"], []]
    spent = accounting.transcript_budget(spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 4, 9), ("a", 3, 1, 9)], "run string, n int, size int, budget int"), ["run"], "n", "size", "budget")
    assert [r.omitted for r in spent.orderBy("n").collect()] == [False, False, True]
    assert [r[0] for r in spark.createDataFrame([(98, 100), (97, 100), (None, 100)], "p int, c int").select(accounting.truncation_suspected(F.col("p"), F.col("c"))).collect()] == [True, False, False]


def test_credentials_go(spark):
    secret = 'k"é/1'
    bodies = ["plain " + secret, json.dumps({"a": secret, secret: [1, secret]}), json.dumps({"arguments": json.dumps({"x": secret})}), '{"n":  1.50}', None, json.dumps("\\u006b".join(["", '\\"é/1']))]
    out = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "t string").select(accounting.scrub_credential(F.col("t"), secret)).collect()]
    mark = "[REDACTED CREDENTIAL]"
    assert out[0] == "plain " + mark and json.loads(out[1]) == {"a": mark, mark: [1, mark]} and json.loads(json.loads(out[2])["arguments"]) == {"x": mark}
    assert out[3] == '{"n":  1.50}' and out[4] is None and mark in out[5]


def test_text_forms(spark):
    assert {"caf\xe9", "caf\\u00e9", "caf\\u00E9", "636166e9", "636166E9", "63 61 66 e9", "63 61 66 E9", "caf\\xe9", "caf\\xE9", "\\x63\\x61\\x66\\xe9", "\\x63\\x61\\x66\\xE9"} == texts.name_variants("café")
    assert '\\"\\e' in texts.name_variants('"\x1b') and texts.unescape_name('a\\x41\\u00e9\\n\\\\\\"') == 'aAé\n\\"'
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(texts.canonical_json(F.col("t"))).collect()] == ['{"a": "\\u00e9", "b": 1}', None, None]
    assert df.select(texts.fingerprint(F.col("t"))).first()[0] == texts.sha256_hex('{"a":"\\u00e9","b":1}')
    record = '{"ssid": "\\"seq\\": 1", "seq": 12, "frame": 1}'
    quotes = ['"seq": 12', '"seq": 1', '"frame": 1, "s', "seq", '"frame": 1', None]
    rows = spark.createDataFrame([(record, q) for q in quotes], "r string, q string")
    assert [r[0] for r in rows.select(texts.quotes_whole_member(F.col("r"), F.col("q"))).collect()] == [True, False, True, False, True, None]
    conf = spark.createDataFrame([("a=1\n b=x=y \nnone\na=2\n",), ("",)], "t string").select(texts.config_values(F.col("t"))).collect()
    assert [r[0] for r in conf] == [{"a": "2", "b": "x=y"}, {}]
    ips = spark.createDataFrame([("10.0.0.4",), ("127.0.0.1",), ("0.0.0.0",), ("300.1.1.1",)], "t string").select(texts.assigned_ipv4(F.col("t"))).collect()
    assert [r[0] for r in ips] == [True, False, False, None]


def test_long_frames_are_cited_by_a_member(spark):
    import json

    big = json.dumps({"elements": "x" * 3000, "frame": 1, "ssid": "lab"}, sort_keys=True)
    shown = spark.createDataFrame([("a", 1, big), ("a", 2, '{"frame": 2}'), ("b", 1, json.dumps({"only": "x" * 3000})), ("b", 2, big), ("c", 5, '{"frame": 5}')], "bundle_id string, frame long, json string")
    none = spark.createDataFrame([], "bundle_id string, source string, line int, text string")
    cited = {r.bundle_id: (r.source, r.ref, r.quote) for r in observation.first_evidence(none, shown, ["hostapd"]).collect()}
    assert cited == {"a": ("frame", 1, '"frame": 1'), "b": ("frame", 2, '"frame": 1'), "c": ("frame", 5, '{"frame": 5}')}


def test_interface_answers(spark):
    told = lambda *addresses, name="wlan1": json.dumps([{"ifname": name, "addr_info": list(addresses)}])
    four = lambda local: {"family": "inet", "local": local}
    cases = [
        (told(four("192.0.2.20"), {"family": "inet6", "local": "::1"}), True, None), (told(four("127.0.0.1"), four("0.0.0.0")), False, None), (told(), False, None), (told({"family": "inet6", "local": "no"}), False, None),
        (told(four("10.1.1.1"), name="eth0"), None, observation.NO_INTERFACE), ("[]", None, observation.NO_INTERFACE), ("no json", None, observation.NO_INTERFACE), ('[{"ifname": "wlan1"}, {}]', None, observation.NO_INTERFACE),
        ('[{"ifname": "wlan1"}]', None, observation.NO_ADDRESSES), ('[{"ifname": "wlan1", "addr_info": {}}]', None, observation.NO_ADDRESSES), (told("text"), None, observation.BAD_ADDRESS), (told(four("300.1.1.1")), None, observation.BAD_ADDRESS), (told(four(None)), None, observation.BAD_ADDRESS),
        (None, None, None),
    ]
    out = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, a string").select("k", observation.interface_lease(F.col("a")).alias("s")).collect()
    assert {r.k: tuple(r.s) for r in out} == {k: tuple(c[1:]) for k, c in enumerate(cases)}
