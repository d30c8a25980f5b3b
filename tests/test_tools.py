"""The six tools from SQL: rows, bounds and wrong arguments; a search that backtracks without end."""

import json
import time

import pytest

from framescope.operators import tools

LONG = "x" * 2500
ODD = 'q"\\\n\t\x01\x7f é€ 😀'


@pytest.fixture(scope="module")
def sql(spark):
    frames = [("a", k, ["auth", "deauth", "data"][k % 3], [f"02:00:00:00:00:0{k % 4}"], k if k % 3 == 0 else None, k if k % 3 == 1 else None, 1 if k % 3 == 2 else None, None) for k in range(1, 61)] + [("a", 61, None, None, None, None, None, "truncated input")]
    frames = spark.createDataFrame(frames, "bundle_id string, frame long, subtype string, addrs array<string>, status_code int, reason_code int, eapol_msg int, error string")
    records = spark.createDataFrame([("a", k, json.dumps({"z": k, "a": ODD, "big": "y" * (40_000 if k == 60 else 1500 if k > 40 else 3)})) for k in range(1, 61)], "bundle_id string, frame long, json string")
    lines = [("a", "wpa_supplicant", k, f"Line {k} " + ("aaaa" * 1000 + "!" if k == 7 else LONG if k == 9 else ODD)) for k in range(1, 101)] + [("a", "hostapd", 1, "hidden line"), ("b", "dhcp_client", 1, "Line of b")]
    lines = spark.createDataFrame(lines, "bundle_id string, source string, line int, text string")
    stats = spark.createDataFrame([("a", "frames: 61"), ("b", "é" * 40_000)], "bundle_id string, stats string")
    assert tools.register_tools(frames, records, lines, stats, "client") == list(tools.TOOLS)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


def bounded(rows, most):
    out, used = [], 100
    for row in rows:
        size = len(json.dumps(row)) + 2
        if len(out) >= most or used + size > 32000:
            return out, True
        out.append(row)
        used += size
    return out, False


def test_list_frames(sql):
    canonical = lambda k: json.dumps({"z": k, "a": ODD, "big": "y" * (40_000 if k == 60 else 1500 if k > 40 else 3)}, sort_keys=True)
    for of, most in ((range(1, 61), 50), (range(1, 61), 7), (range(3, 61, 3), 50)):
        named = "" if len(of) == 60 else ", has_status => true"
        kept, more = bounded([{"frame": k, "json": canonical(k)} for k in of], most)
        assert sql(f"SELECT * FROM tool_list_frames('a', most => {most}{named}) ORDER BY frame") == [(r["frame"], r["json"], more, None) for r in kept]
    assert [r[0] for r in sql("SELECT frame FROM tool_list_frames('a', 'auth', '02:00:00:00:00:02') ORDER BY frame")] == [6, 18, 30, 42, 54]
    assert [r[0] for r in sql("SELECT frame FROM tool_list_frames('a', eapol_only => true, has_reason => false, most => 2) ORDER BY frame")] == [2, 5]
    assert sql("SELECT * FROM tool_list_frames('a', most => 0)") == sql("SELECT * FROM tool_list_frames('a', most => 51)") == [(None, None, None, tools.WRONG)]
    assert sql("SELECT * FROM tool_list_frames('none')") == []


def test_get_frame(sql):
    (row,) = sql("SELECT * FROM tool_get_frame('a', 3)")
    assert row[0] == 3 and json.loads(row[1])["z"] == 3 and row[2:] == (False, None)
    (row,) = sql("SELECT * FROM tool_get_frame('a', 60)")
    assert row[2] and len(json.dumps(row[1])) <= 31_900 < 2 * len(json.dumps(row[1]))
    for n in ("61", "0", "CAST(NULL AS BIGINT)"):
        assert sql(f"SELECT * FROM tool_get_frame('a', {n})") == [(None, None, None, tools.WRONG)]


def test_read_log(sql):
    out = sql("SELECT * FROM tool_read_log('a', 'wpa_supplicant', 8, 10) ORDER BY line")
    assert [(r[0], len(r[1]), *r[2:]) for r in out] == [(8, 7 + len(ODD), False, False, 100, None), (9, 2000, True, False, 100, None), (10, 8 + len(ODD), False, False, 100, None)]
    assert len(sql("SELECT * FROM tool_read_log('a', 'wpa_supplicant', 90, 169)")) == 11
    for told in ("'hostapd', 1, 2", "'wpa_supplicant', 0, 2", "'wpa_supplicant', 5, 4", "'wpa_supplicant', 1, 81", "'other', 1, 2", "NULL, 1, 2"):
        assert sql(f"SELECT * FROM tool_read_log('a', {told})") == [(None, None, None, None, None, tools.WRONG)]


def test_search_log(sql):
    assert [r[0] for r in sql("SELECT line FROM tool_search_log('a', 'wpa_supplicant', '^line 1.? ') ORDER BY line")] == [1, *range(10, 20)]
    every = sql("SELECT * FROM tool_search_log('a', 'wpa_supplicant', 'LINE') ORDER BY line")
    assert len(every) == 40 and all(r[3] for r in every) and every[0][1].startswith("Line 1 q")
    assert len(sql("SELECT * FROM tool_search_log('a', 'wpa_supplicant', 'line [56]', 3)")) == 3
    for told in ("'hostapd', 'x'", "'wpa_supplicant', '('", f"'wpa_supplicant', '{'x' * 257}'", "'wpa_supplicant', 'x', 41", "'wpa_supplicant', NULL"):
        assert [(r[0], r[-1]) for r in sql(f"SELECT * FROM tool_search_log('a', {told})")] == [(None, tools.WRONG)]


def test_endless_search_ends(spark, sql):
    began = time.perf_counter()
    assert sql("SELECT * FROM tool_search_log('a', 'wpa_supplicant', '(a+)+$')") == [(None, None, None, True, tools.SLOW)]
    assert time.perf_counter() - began < 30
    both = sql("SELECT c.p, t.line, t.error FROM VALUES ('(a+)+$'), ('line 100') AS c(p), LATERAL tool_search_log('a', 'wpa_supplicant', c.p) t ORDER BY c.p")
    assert both == [("(a+)+$", None, tools.SLOW), ("line 100", 100, None)] and spark.range(3).count() == 3


def test_codes_and_summaries(sql):
    told = "VALUES ('status', 17L), ('reason', 15L), ('reason', 60000L), ('other', 1L), ('status', -1L), ('status', 65536L), (NULL, 1L) AS c(kind, code)"
    assert sorted(sql(f"SELECT t.* FROM {told}, LATERAL tool_lookup_code(c.kind, c.code) t"), key=str) == sorted([("status", 17, tools.STATUS[17], None), ("reason", 15, tools.REASON[15], None), ("reason", 60000, "unknown", None)] + [(None, None, None, tools.WRONG)] * 4, key=str)
    assert sql("SELECT * FROM tool_capture_summary('a')") == [("frames: 61", False, None)]
    assert [(len(r[0]), r[1]) for r in sql("SELECT * FROM tool_capture_summary('b')")] == [(5000, True)]


def test_calls_in_one_plan(sql):
    calls = "VALUES (1, 'a', 'auth', 2L), (2, 'a', NULL, 1L), (3, 'b', NULL, 5L), (4, 'a', 'data', 99L), (5, 'a', 'auth', 2L) AS c(id, bundle, sub, n)"
    out = sql(f"SELECT c.id, t.frame, t.truncated, t.error FROM {calls} LEFT JOIN LATERAL tool_list_frames(c.bundle, c.sub, most => c.n) t ORDER BY 1, 2")
    assert out == [(1, 3, True, None), (1, 6, True, None), (2, 1, True, None), (3, None, None, None), (4, None, None, tools.WRONG), (5, 3, True, None), (5, 6, True, None)]


def test_records_beside_their_frames(spark):
    """Frames that carry their records need no join, and only the records that a call may return are sorted."""
    rows = [("a", k, ["auth", "deauth"][k % 2], [], None, None, None, None, f'{{"z": {k}, "a": 1}}') for k in range(1, 9)] + [("a", 9, None, [], None, None, None, "truncated input", '{"z": 9}')]
    frames = spark.createDataFrame(rows, "bundle_id string, frame long, subtype string, addrs array<string>, status_code int, reason_code int, eapol_msg int, error string, json string")
    lines, stats = spark.createDataFrame([], "bundle_id string, source string, line int, text string"), spark.createDataFrame([], "bundle_id string, stats string")
    found = []
    for records in (None, frames.select("bundle_id", "frame", "json")):
        tools.register_tools(frames.drop(*(["json"] if records is not None else [])), records, lines, stats, "client")
        listed = spark.sql("SELECT * FROM tool_list_frames('a', 'auth')")
        plan = listed._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (records is not None)
        at = min(k for k, x in enumerate(plan.splitlines()) if "ArrowEvalPython [run(" in x)
        assert any("= auth" in x for x in plan.splitlines()[at:])  # the filter stands below the sorting of records
        found.append([sorted(map(tuple, listed.collect())), spark.sql("SELECT * FROM tool_get_frame('a', 9)").collect()[0][3], spark.sql("SELECT * FROM tool_get_frame('a', 3)").collect()[0][1]])
    assert found[0] == found[1] == [[(k, f'{{"a": 1, "z": {k}}}', False, None) for k in (2, 4, 6, 8)], tools.WRONG, '{"a": 1, "z": 3}']


def test_logs_do_not_share_a_search():
    search = tools.Search()
    search.match("x", "x", ("a", "log"))
    search.left = dict.fromkeys(search.left, 0.0)  # the first log's time is spent
    assert search.match("x", "x", ("a", "log")) == (None, tools.SLOW)
    assert search.match("x", "x", ("b", "log")) == (True, None)
