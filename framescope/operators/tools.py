"""Six bounded tools over a view of bundles, as table functions of SQL: `SELECT .. FROM calls c, LATERAL tool_list_frames(c.bundle_id, ..)`.

Each has declared parameters and columns; wrong arguments give a row with an error, never a failed query. The functions are queries over temporary views,
so any number of calls is one plan: the calls' distinct arguments are joined with frames or lines of their bundles, and what a call may return is cut by
windows over it. Only sources of the view can be reached.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions.texts import canonical_json
from framescope.operators.bundles import VIEWS, visible

#: Meanings of status codes (fixed values).
STATUS = {
    0: "Successful", 1: "Unspecified failure", 10: "Cannot support all requested capabilities", 13: "Authentication algorithm not supported", 14: "Unknown authentication transaction number",
    15: "Challenge failure", 16: "Authentication timeout", 17: "AP unable to handle additional associated stations", 18: "Association denied: unsupported basic rates", 30: "Association rejected temporarily",
    31: "Robust management frame policy violation", 40: "Invalid information element", 41: "Invalid group cipher", 42: "Invalid pairwise cipher", 43: "Invalid AKMP", 44: "Unsupported RSN information element version",
    45: "Invalid RSN information element capabilities", 46: "Cipher suite rejected by security policy", 76: "Anti-clogging token required", 77: "Finite cyclic group not supported",
}
#: Meanings of reason codes (fixed values).
REASON = {
    1: "Unspecified reason", 2: "Previous authentication no longer valid", 3: "Sending station is leaving the IBSS or ESS", 4: "Disassociated due to inactivity", 5: "AP unable to handle all currently associated stations",
    6: "Class 2 frame received from nonauthenticated station", 7: "Class 3 frame received from nonassociated station", 8: "Sending station is leaving the BSS", 9: "Station requesting association is not authenticated",
    14: "MIC failure", 15: "Four-way handshake timeout", 16: "Group key handshake timeout", 17: "Information element differs from association exchange", 18: "Invalid group cipher", 19: "Invalid pairwise cipher",
    20: "Invalid AKMP", 23: "IEEE 802.1X authentication failed", 24: "Cipher suite rejected by security policy",
}
#: Characters of a tool's output, of a line and of a pattern, rows of each list, seconds of a search (fixed values).
OUTPUT, LINE, PATTERN, FRAMES, MATCHES, LINES, SECONDS = 32_000, 2_000, 256, 50, 40, 80, 2.0
#: What is said of wrong arguments, of a search that takes too long, and of names that are no tool's (fixed values).
WRONG, SLOW, UNKNOWN = "invalid arguments or reference; consult the tool schema", "regex search timed out", "invalid tool or arguments"


def json_size(text: Column) -> Column:
    """Characters that a text takes inside JSON with ASCII escapes, without its quotes."""
    short, odd, wide = (F.regexp_count(text, F.lit(p)) for p in (r'["\\\n\r\t\x08\x0c]', r"[^ -~]", r"[\x{10000}-\x{10FFFF}]"))
    brief = F.regexp_count(text, F.lit(r"[\n\r\t\x08\x0c]"))
    return F.length(text) + short + 5 * (odd - brief) + 6 * wide


class Search:
    """Whether patterns match lines, whatever the case, within SECONDS for each pattern and log. The matcher takes a deadline, so one that backtracks
    without end stops by itself and the session's other queries go on."""

    def __init__(self) -> None:
        self.left: dict[tuple[str, object], float] = {}
        self.known: dict[str, regex.Pattern | None] = {}

    def match(self, pattern: str | None, text: str | None, log: object = None) -> tuple[bool | None, str | None]:
        if pattern is None or len(pattern) > PATTERN:
            return None, WRONG
        if pattern not in self.known:
            try:
                re.compile(pattern)  # both must take it
                self.known[pattern] = regex.compile(pattern, regex.IGNORECASE)
            except (re.error, regex.error, OverflowError, RecursionError):
                self.known[pattern] = None
        if self.known[pattern] is None:
            return None, WRONG
        search = (pattern, log)
        if self.left.setdefault(search, SECONDS) <= 0:
            return None, SLOW
        began = time.perf_counter()
        try:
            return self.known[pattern].search(text or "", timeout=self.left[search]) is not None, None
        except TimeoutError:
            self.left[search] = 0
            return None, SLOW
        finally:
            self.left[search] -= time.perf_counter() - began


@F.pandas_udf(T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("error", T.StringType())]))
def _timed_match(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    search = Search()
    for patterns, texts, *logs in parts:
        yield pd.DataFrame([search.match(p, t, log) for p, t, log in zip(patterns, texts, zip(*logs))], columns=["hit", "error"], dtype=object)


@F.pandas_udf(T.StringType())
def _halved(texts: pd.Series) -> pd.Series:
    """Texts halved until their JSON fits an output."""

    def one(text: str) -> str:
        escaped = lambda t: sum(2 if c in '"\\\n\r\t\b\f' else 1 if " " <= c <= "~" else 6 if c <= "￿" else 12 for c in t) + 2
        while escaped(text) > OUTPUT - 100:
            text = text[: len(text) // 2]
        return text

    return texts.map(one, na_action="ignore").astype(object)


#: Each tool's parameters (those without a default must be given) and its columns.
TOOLS = {
    "tool_capture_summary": ("bundle STRING", "stats STRING, truncated BOOLEAN, error STRING"),
    "tool_list_frames": (
        "bundle STRING, of_subtype STRING DEFAULT NULL, with_address STRING DEFAULT NULL, has_status BOOLEAN DEFAULT NULL, has_reason BOOLEAN DEFAULT NULL, eapol_only BOOLEAN DEFAULT false, most BIGINT DEFAULT 50",
        "frame BIGINT, json STRING, truncated BOOLEAN, error STRING",
    ),
    "tool_get_frame": ("bundle STRING, number BIGINT", "frame BIGINT, json STRING, truncated BOOLEAN, error STRING"),
    "tool_search_log": ("bundle STRING, of_source STRING, pattern STRING, most BIGINT DEFAULT 40", "line BIGINT, text STRING, line_truncated BOOLEAN, truncated BOOLEAN, error STRING"),
    "tool_read_log": ("bundle STRING, of_source STRING, first BIGINT, last BIGINT", "line BIGINT, text STRING, line_truncated BOOLEAN, truncated BOOLEAN, total_lines BIGINT, error STRING"),
    "tool_lookup_code": ("kind STRING, code BIGINT", "kind STRING, code BIGINT, meaning STRING, error STRING"),
}

#: What a call may return of its rows (columns of a query, its order, the most rows): those before the rows or the characters of an output are spent.
_BOUNDED = """(SELECT *, count(*) OVER () AS total, count_if(fits) OVER () AS kept FROM (SELECT *, r <= m AND used + 100 <= {output} AS fits FROM (
  SELECT *, {most} AS m, row_number() OVER (ORDER BY {order}) AS r, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS used FROM ({rows}))))"""

_LISTED = """SELECT t.frame, t.json, t.size FROM tool_frames t WHERE t.bundle_id = bundle AND (of_subtype IS NULL OR t.subtype = of_subtype)
  AND (with_address IS NULL OR array_contains(t.addrs, with_address)) AND (has_status IS NULL OR (t.status_code IS NOT NULL) = has_status)
  AND (has_reason IS NULL OR (t.reason_code IS NOT NULL) = has_reason) AND (NOT eapol_only OR t.eapol_msg IS NOT NULL)"""

_FOUND = """SELECT line, shown, cut, size, bad FROM (SELECT *, max(told.error) OVER () AS bad FROM (
  SELECT t.line, t.shown, t.cut, t.size, tool_timed_match(pattern, t.text, t.bundle_id, t.source) AS told FROM tool_lines t WHERE t.bundle_id = bundle AND t.source = of_source)) WHERE told.hit OR bad IS NOT NULL"""

_RANGE = "SELECT t.line, t.shown, t.cut, t.size, t.total_lines FROM tool_lines t WHERE t.bundle_id = bundle AND t.source = of_source AND t.line BETWEEN first AND last"


def _bodies(shown: tuple[str, ...]) -> dict[str, str]:
    """The query of each tool. Wrong arguments have a branch of their own, with a row where they are wrong."""
    visible_ = "(" + ", ".join(f"'{s}'" for s in shown) + ")"
    codes = ", ".join(f"'{kind} {code}', '{text}'" for kind, told in (("status", STATUS), ("reason", REASON)) for code, text in told.items())
    bounded = lambda rows, order, most: _BOUNDED.format(output=OUTPUT, rows=rows, order=order, most=most)
    wrong = lambda nulls, ok: f"UNION ALL SELECT {'NULL, ' * nulls}'{WRONG}' WHERE NOT coalesce({ok}, false)"
    list_ok = f"most BETWEEN 1 AND {FRAMES} AND eapol_only IS NOT NULL"
    search_ok = f"of_source IN {visible_} AND most BETWEEN 1 AND {MATCHES} AND pattern IS NOT NULL"
    range_ok = f"of_source IN {visible_} AND first >= 1 AND last BETWEEN first AND first + {LINES - 1}"
    code_ok = "kind IN ('status', 'reason') AND code BETWEEN 0 AND 65535"
    return {
        "tool_capture_summary": "SELECT t.shown, t.shown <> t.stats, CAST(NULL AS STRING) FROM tool_stats t WHERE t.bundle_id = bundle",
        "tool_list_frames": f"SELECT frame, json, kept < total, CAST(NULL AS STRING) FROM {bounded(_LISTED, 'frame', 'most')} WHERE fits AND {list_ok} {wrong(3, list_ok)}",
        "tool_get_frame": f"SELECT max(t.frame), max(t.shown), max(t.shown) <> max(t.json), CASE WHEN count(*) = 0 THEN '{WRONG}' END FROM tool_frames t WHERE t.bundle_id = bundle AND t.frame = number",
        "tool_search_log": f"""SELECT CASE WHEN bad IS NULL THEN line END, CASE WHEN bad IS NULL THEN shown END, CASE WHEN bad IS NULL THEN cut END, bad IS NOT NULL OR kept < total, bad
            FROM {bounded(_FOUND, 'line', 'most')} WHERE CASE WHEN bad IS NULL THEN fits ELSE r = 1 END AND {search_ok} {wrong(4, search_ok)}""",
        "tool_read_log": f"SELECT line, shown, cut, kept < total, total_lines, CAST(NULL AS STRING) FROM {bounded(_RANGE, 'line', LINES)} WHERE fits AND {range_ok} {wrong(5, range_ok)}",
        "tool_lookup_code": f"SELECT kind, code, coalesce(try_element_at(map({codes}), concat_ws(' ', kind, code)), 'unknown'), CAST(NULL AS STRING) WHERE {code_ok} {wrong(3, code_ok)}",
    }


def register_tools(frames: DataFrame, records: DataFrame | None, lines: DataFrame, stats: DataFrame, view: str, key: str = "bundle_id") -> list[str]:
    """Makes the six tools known to the session's SQL, over one view of redacted bundles; their names.

    frames: decoded frames with their key; records: (key, frame, json), each frame's record, or None where the frames have a column `json`; lines: (key,
    source, line, text); stats: (key, stats), a text. A bundle without frames or lines gives no rows; see TOOLS for parameters and columns."""
    spark = frames.sparkSession
    told = frames.where("error is null").select(F.col(key).alias("bundle_id"), "frame", "subtype", "addrs", "status_code", "reason_code", "eapol_msg", *([] if records is not None else ["json"]))
    if records is not None:
        told = told.join(records.select(F.col(key).alias("bundle_id"), "frame", "json"), ["bundle_id", "frame"])
    # only the frames that a tool may return come here: their records are sorted above its filters
    canonical = told.withColumn("json", canonical_json(F.col("json")))
    # a row in an output: {"frame": 1, "json": ".."} or {"line": 1, "text": "..", "truncated": false}, and two characters between rows
    frame_size = 23 + F.length(F.col("frame").cast("string")) + json_size(F.col("json")) + 2
    canonical.withColumns({"size": frame_size, "shown": _halved("json")}).createOrReplaceTempView("tool_frames")
    seen = visible(lines, view).select(F.col(key).alias("bundle_id"), "source", F.col("line").cast("bigint").alias("line"), "text", F.substring("text", 1, LINE).alias("shown"), (F.length("text") > LINE).alias("cut"))
    counts = seen.groupBy("bundle_id", "source").agg(F.count("*").alias("total_lines"))
    line_size = 37 + F.length(F.col("line").cast("string")) + json_size(F.col("shown")) + F.when(F.col("cut"), 4).otherwise(5) + 2
    seen.join(counts, ["bundle_id", "source"]).withColumn("size", line_size).createOrReplaceTempView("tool_lines")
    stats.select(F.col(key).alias("bundle_id"), "stats", _halved("stats").alias("shown")).createOrReplaceTempView("tool_stats")
    spark.udf.register("tool_timed_match", _timed_match)
    for name, body in _bodies(VIEWS[view]).items():
        parameters, columns = TOOLS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return list(TOOLS)
