"""Queries over what a lab records: captures written and read as files, drawn parameters, tools over a view, frozen inputs, growing logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.operators import bundles, evaluation, frames, freezing, privacy, runs, scenarios, tools
from framescope.operators import captures as trimming
from framescope.plans.captures import _FRAMES, captures, decoded
from framescope.plans.catalogue import _HMAC_SQL, CUTOFF, KEY, micros, query, table
from framescope.plans.evidence import _GRADED, _graded
from framescope.sources import capture_index, capture_sink, dataset
from framescope.sources.pcap import raw_records
from framescope.sources.stores import shared_dir
from framescope.streaming import recorder


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for plans that read it several times."""
    folder = _folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _hex(value: Column, size: int, little: Column) -> Column:
    big = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.when(little, F.concat(*(F.substring(big, 2 * k + 1, 2) for k in range(size - 1, -1, -1)))).otherwise(big)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, frame, record): a capture for each user, of one of four forms (either byte order, micro- or nanoseconds), a record for each event's text."""
    user = F.col("user_id")
    little, nano = user % 2 == 0, F.floor(user / 2) % 2 == 1
    events = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("us"), F.coalesce("props", F.lit("")).cast("binary").alias("data"))
    magic = F.when(nano, F.lit(0xA1B23C4D)).otherwise(F.lit(0xA1B2C3D4))
    head = F.concat(_hex(magic, 4, little), _hex(F.lit(2), 2, little), _hex(F.lit(4), 2, little), F.lit("00" * 8), _hex(F.lit(65535), 4, little), _hex(F.lit(105), 4, little))
    heads = events.select("user_id").distinct().select(user.cast("string").alias("path"), F.lit(0).cast("bigint").alias("frame"), F.unhex(head).alias("record"))
    size = F.length("data")
    record = F.concat(_hex(F.floor(F.col("us") / 1_000_000), 4, little), _hex(F.col("us") % 1_000_000 * F.when(nano, 1000).otherwise(1), 4, little), _hex(size, 4, little), _hex(size, 4, little))
    return heads.unionByName(events.select(user.cast("string").alias("path"), (F.col("event_id") + 1).alias("frame"), F.concat(F.unhex(record), "data").alias("record")))


def written_events(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder that event_records has been written to."""
    folder = _folder(spark, name)
    capture_sink.write_captures(event_records(spark, sf_dir), folder)
    return folder


def _sql_hex(value: str, size: int) -> str:
    big = f"printf('%0{2 * size}X', ({value})::BIGINT)"
    return f"CASE WHEN u % 2 = 0 THEN {' || '.join(f'{big}[{2 * k + 1}:{2 * k + 2}]' for k in range(size - 1, -1, -1))} ELSE {big} END"


#: The same captures as hexadecimal digits.
_RECORDS = f"""e AS (SELECT event_id, user_id AS u, epoch_us(ts) AS us, encode(coalesce(props, '')) AS data, ts FROM events),
h AS (SELECT u, {_sql_hex("CASE WHEN u // 2 % 2 = 1 THEN 2712812621 ELSE 2712847316 END", 4)} || {_sql_hex("2", 2)} || {_sql_hex("4", 2)} || '0000000000000000' || {_sql_hex("65535", 4)} || {_sql_hex("105", 4)} AS head FROM (SELECT DISTINCT u FROM e)),
r AS (SELECT *, {_sql_hex("us // 1000000", 4)} || {_sql_hex("us % 1000000 * CASE WHEN u // 2 % 2 = 1 THEN 1000 ELSE 1 END", 4)} || {_sql_hex("octet_length(data)", 4)} || {_sql_hex("octet_length(data)", 4)} || hex(data) AS record FROM e)"""


@query(
    "q74_trimmed_captures",
    f"""WITH {_RECORDS},
        k AS (SELECT u, count(*) FILTER (WHERE ts <= TIMESTAMP '{CUTOFF}') AS frames, count(*) FILTER (WHERE ts > TIMESTAMP '{CUTOFF}') AS removed_frames,
              coalesce(string_agg(record, '' ORDER BY event_id) FILTER (WHERE ts <= TIMESTAMP '{CUTOFF}'), '') AS body FROM r GROUP BY u)
        SELECT u::VARCHAR AS path, frames, removed_frames, (length(head) + length(body)) // 2 AS bytes, sha256(unhex(head || body)) AS sha256 FROM k JOIN h USING (u)""",
)
def q74_trimmed_captures(spark, sf_dir):
    """Captures are written as files, read back whatever their form, cut, and written again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pcap").load(written_events(spark, sf_dir, "captures"))
    named = files.select(F.regexp_extract("path", r"([^/]*)\.pcap$", 1).alias("path"), "content")
    ends = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path")).distinct().withColumn("end_ns", F.unix_micros(F.to_timestamp(F.lit(CUTOFF))) * 1000)
    kept, report = trimming.trim_captures(raw_records(named), ends)
    folder = _folder(spark, "trimmed")
    capture_sink.write_captures(kept, folder)
    return capture_sink.written_captures(spark, folder).join(report.select("path", "removed_frames"), "path").select("path", "frames", "removed_frames", "bytes", "sha256")


@query(
    "q75_sliced_captures",
    """SELECT u::VARCHAR AS path, count(*) AS frames, max(n) AS last_frame, sum(octet_length(data))::BIGINT AS bytes, sum(n * octet_length(data))::BIGINT AS weighted, min(us) * 1000 AS first_ns, max(us) * 1000 AS last_ns
       FROM (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts) AS us, encode(coalesce(props, '')) AS data FROM events) GROUP BY u""",
)
def q75_sliced_captures(spark, sf_dir):
    """Written captures are indexed in slices of 4 KB; the index is a table, and its slices are read side by side."""
    folder, index = written_events(spark, sf_dir, "captures"), _folder(spark, "index")
    capture_index.index_captures(spark, f"{folder}/*/*.pcap", slice_bytes=4096).write.parquet(index)
    packets = capture_index.read_slices(spark.read.parquet(index))
    size = F.col("captured_len")
    return packets.groupBy(F.regexp_extract("path", r"([^/]*)\.pcap$", 1).alias("path")).agg(
        F.count("*").alias("frames"), F.max("frame").alias("last_frame"), F.sum(size).alias("bytes"), F.sum(F.col("frame") * size).alias("weighted"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )


@query("q76_drawn_parameters")
def q76_drawn_parameters(spark, sf_dir):
    """What each order's key draws as a seed. SQL can't draw so; the draws are held against the library's in the tests."""
    split = F.when(F.col("o_custkey") % 2 == 0, "dev").otherwise("test")
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", scenarios.draw_parameters(F.col("o_orderkey"), split).alias("p"))
    return drawn.select("o_orderkey", "p.*")


_LABELLED = "([" + ", ".join(f"'{x}'" for x in bundles.CLASSES) + "])[o_orderkey % 9 + 1]"
_CHANGES = [(k, f, ",".join(sorted(told))) for k, (ap, station, _) in scenarios.CAUSES.items() for f, told in (("hostapd.conf", ap), ("station.conf", station)) if told]


@query(
    "q77_changed_settings",
    f"""SELECT o_orderkey, label, file, changed FROM (SELECT o_orderkey, {_LABELLED} AS label FROM orders)
        JOIN (VALUES {", ".join(map(str, [*_CHANGES, ("pmf_required_unsupported", "occupant.conf", "ieee80211w")]))}) c(label, file, changed) USING (label)""",
)
def q77_changed_settings(spark, sf_dir):
    """Each order is a bundle of one of nine classes; its files are held against those of a sound bundle with the same draws."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, bundles.CLASSES)), (k % 9 + 1).cast("int"))
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), scenarios.draw_parameters(k, F.lit("dev")).alias("parameters"))
    changed = scenarios.changed_from_class(drawn, F.lit("/run/lab"), "ok", "o_orderkey")
    return changed.select("o_orderkey", "label", "file", F.array_join("changed", ",").alias("changed"))


#: Each user's events as lines of four logs, and six calls for each user.
_TOOL_LINES = f"""l AS (SELECT user_id, ([{", ".join(f"'{x}'" for x in bundles.SOURCES)}])[event_id % 4 + 1] AS source, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS line, coalesce(props, '') AS text FROM events),
users AS (SELECT user_id AS u, count(*) AS n, ([{", ".join(f"'{x}'" for x in bundles.SOURCES)}])[user_id % 4 + 1] AS source, user_id % 4 IN (1, 3) AS seen FROM events GROUP BY user_id)"""


@query(
    "q78_tools",
    _FRAMES
    + f""", {_TOOL_LINES},
    listed AS (SELECT u, frame, row_number() OVER (PARTITION BY u ORDER BY frame) AS r, count(*) OVER (PARTITION BY u) AS total, u % 60 AS most FROM d WHERE subtype = 'deauth'),
    found AS (SELECT u, line, text, row_number() OVER (PARTITION BY u ORDER BY line) AS r, count(*) OVER (PARTITION BY u) AS total FROM users JOIN l ON l.user_id = u AND l.source = users.source WHERE seen AND regexp_matches(text, '[13]7?\}}')),
    ranged AS (SELECT u, line, text, count(*) OVER (PARTITION BY u) AS total FROM users JOIN l ON l.user_id = u AND l.source = users.source WHERE seen)
    SELECT u AS user_id, 'list' AS tool, frame AS n, NULL AS text, total > most AS truncated, NULL AS error FROM listed WHERE r <= most AND most BETWEEN 1 AND 50
    UNION ALL SELECT u, 'list', NULL, NULL, NULL, '{tools.WRONG}' FROM users WHERE u % 60 NOT BETWEEN 1 AND 50
    UNION ALL SELECT u, 'frame', frame, NULL, false, CASE WHEN frame IS NULL THEN '{tools.WRONG}' END FROM users LEFT JOIN d USING (u) WHERE d.frame = 5 AND d.error IS NULL
    UNION ALL SELECT u, 'frame', NULL, NULL, NULL, '{tools.WRONG}' FROM users WHERE u NOT IN (SELECT u FROM d WHERE frame = 5 AND error IS NULL AND u IS NOT NULL)
    UNION ALL SELECT u, 'search', line, text, total > 40, NULL FROM found WHERE r <= 40
    UNION ALL SELECT u, 'search', NULL, NULL, NULL, '{tools.WRONG}' FROM users WHERE NOT seen
    UNION ALL SELECT u, 'read', line, text || ' of ' || total, false, NULL FROM ranged WHERE line BETWEEN 3 AND 3 + u % 90 AND u % 90 < 80
    UNION ALL SELECT u, 'read', NULL, NULL, NULL, '{tools.WRONG}' FROM users WHERE NOT seen OR u % 90 >= 80
    UNION ALL SELECT u, 'code', u, CASE u {" ".join(f"WHEN {k} THEN '{v}'" for k, v in tools.REASON.items())} ELSE 'unknown' END, NULL, NULL FROM users
    UNION ALL SELECT u, 'summary', NULL, n || ' events', false, NULL FROM users""",
)
def q78_tools(spark, sf_dir):
    """Six calls for each user over their decoded capture and logs, some with wrong arguments, as one query with LATERAL."""
    e = F.col("event_id")
    events = table(spark, sf_dir, "events")
    source = lambda at: F.element_at(F.array(*map(F.lit, bundles.SOURCES)), (at % 4 + 1).cast("int"))
    within = Window.partitionBy("user_id", e % 4).orderBy("event_id")
    lines = events.select(F.col("user_id").cast("string").alias("bundle_id"), source(e).alias("source"), F.row_number().over(within).alias("line"), F.coalesce("props", F.lit("")).alias("text"))
    users = events.groupBy("user_id").agg(F.count("*").alias("n"))
    stats = users.select(F.col("user_id").cast("string").alias("bundle_id"), F.concat(F.col("n").cast("string"), F.lit(" events")).alias("stats"))
    seen = _written(decoded(spark, sf_dir), "frames")
    tools.register_tools(seen.select(F.col("path").alias("bundle_id"), *seen.columns, frames.frame_record().alias("json")), None, lines, stats, "client")
    users.select("user_id", F.col("user_id").cast("string").alias("b"), source(F.col("user_id")).alias("s")).createOrReplaceTempView("tool_calls")
    return spark.sql(
        r"""SELECT user_id, 'list' AS tool, t.frame AS n, CAST(NULL AS STRING) AS text, t.truncated, t.error FROM tool_calls c, LATERAL tool_list_frames(c.b, 'deauth', most => user_id % 60) t
        UNION ALL SELECT user_id, 'frame', t.frame, NULL, t.truncated, t.error FROM tool_calls c, LATERAL tool_get_frame(c.b, 5) t
        UNION ALL SELECT user_id, 'search', t.line, t.text, t.truncated, t.error FROM tool_calls c, LATERAL tool_search_log(c.b, c.s, '[13]7?\}') t
        UNION ALL SELECT user_id, 'read', t.line, t.text || ' of ' || t.total_lines, t.truncated, t.error FROM tool_calls c, LATERAL tool_read_log(c.b, c.s, 3, 3 + user_id % 90) t
        UNION ALL SELECT user_id, 'code', t.code, t.meaning, NULL, t.error FROM tool_calls c, LATERAL tool_lookup_code('reason', user_id) t
        UNION ALL SELECT user_id, 'summary', NULL, t.stats, t.truncated, t.error FROM tool_calls c, LATERAL tool_capture_summary(c.b) t"""
    )


@query(
    "q79_recorded_logs",
    f"""WITH e AS (SELECT user_id, ([{", ".join(f"'{x}'" for x in bundles.SOURCES)}])[event_id % 4 + 1] AS source, event_id, epoch_us(ts) * 1000 AS unix_ns, epoch_us(ts) // 1000 - 1700000000000 + event_id % 7 * 3600000 AS monotonic_ns,
          CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000000 + event_id % 3 * 86400 END AS own FROM events),
        j AS (SELECT *, unix_ns <= epoch_us(TIMESTAMP '{CUTOFF}') * 1000 AND monotonic_ns <= epoch_us(TIMESTAMP '{CUTOFF}') // 1000 - 1700000000000 AND coalesce(own <= epoch_us(TIMESTAMP '{CUTOFF}') // 1000000, true) AS inside FROM e),
        k AS (SELECT *, monotonic_ns < lag(monotonic_ns) OVER (PARTITION BY user_id, source, inside ORDER BY event_id) AS back FROM j)
        SELECT user_id::VARCHAR AS bundle_id, source, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS omitted, count(*) FILTER (WHERE inside AND back) AS goes_back,
          coalesce(sum(event_id) FILTER (WHERE inside), 0)::BIGINT AS lines FROM k GROUP BY user_id, source""",
)
def q79_recorded_logs(spark, sf_dir):
    """Events as a stream of log lines with receipts by two clocks; each log's end comes with them. What the checkpointed stream has written is read at
    its last version."""
    e, us = F.col("event_id"), micros("ts")
    end = F.unix_micros(F.to_timestamp(F.lit(CUTOFF)))
    source = F.element_at(F.array(*map(F.lit, bundles.SOURCES)), (e % 4 + 1).cast("int"))
    text = F.when(e % 5 == 0, F.concat((F.floor(us / 1_000_000) + e % 3 * 86_400).cast("string"), F.lit(": told"))).otherwise(F.col("props"))
    line = F.struct(e.alias("line"), text.alias("text"), (us * 1000).alias("unix_ns"), (F.floor(us / 1000) - 1_700_000_000_000 + e % 7 * 3_600_000).alias("monotonic_ns"), F.lit(False).alias("ends"))
    ended = F.struct(F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("string").alias("text"), (end * 1000).alias("unix_ns"), (F.floor(end / 1000) - 1_700_000_000_000).alias("monotonic_ns"), F.lit(True).alias("ends"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("bundle_id"), source.alias("source"), F.explode(F.array(line, ended)).alias("r")).select("bundle_id", "source", "r.*")
    arriving, folder = _folder(spark, "arriving"), _folder(spark, "recorded")
    rows.write.parquet(arriving)
    query_ = recorder.write_versions(recorder.record_lines(spark.readStream.schema(rows.schema).parquet(arriving)), folder, _folder(spark, "recorded-at"))
    query_.awaitTermination()
    recorded = recorder.snapshot(spark, folder, recorder.versions(folder)[-1])
    lines = recorded.groupBy("bundle_id", "source").agg(F.coalesce(F.sum("line"), F.lit(0)).alias("lines"))
    return recorder.log_counts(recorded).join(lines, ["bundle_id", "source"])


_TREES = """f AS (SELECT 'page ' || page_id AS name, sha256(coalesce(html, '')) AS digest, page_id FROM pages),
g AS (SELECT CASE WHEN page_id % 107 = 5 THEN name || ' moved' ELSE name END AS name, CASE WHEN page_id % 101 = 7 THEN sha256(digest) ELSE digest END AS digest FROM f WHERE page_id % 103 <> 3)"""


def _sql_tree(side: str) -> str:
    key = "sha256(name)"
    low = f"(SELECT {key}[1:2] AS p, sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY name)) AS d FROM {side} GROUP BY 1)"
    mid = f"(SELECT p[1:1] AS p, sha256(string_agg(p || chr(0) || d || chr(10), '' ORDER BY p)) AS d FROM {low} GROUP BY p[1:1])"
    return f"(SELECT sha256(string_agg(p || chr(0) || d || chr(10), '' ORDER BY p)) FROM {mid})"


@query(
    "q80_frozen_pages",
    f"""WITH {_TREES}
        SELECT coalesce(f.name, g.name) AS name, CASE WHEN f.name IS NULL THEN 'added' WHEN g.name IS NULL THEN 'removed' ELSE 'changed' END AS status, {_sql_tree("f")} AS frozen_root, {_sql_tree("g")} AS present_root
        FROM f FULL JOIN g USING (name) WHERE f.digest IS DISTINCT FROM g.digest""",
)
def q80_frozen_pages(spark, sf_dir):
    """Pages as frozen files; some are changed, removed or moved since. Both trees are written, and compared from their roots down."""
    page = F.col("page_id")
    name, digest = F.concat(F.lit("page "), page.cast("string")), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    files = table(spark, sf_dir, "pages").select(F.lit("pages").alias("grp"), name.alias("name"), digest.alias("digest"), "page_id")
    since = files.where(page % 103 != 3).select("grp", F.when(page % 107 == 5, F.concat("name", F.lit(" moved"))).otherwise(F.col("name")).alias("name"), F.when(page % 101 == 7, F.sha2(F.col("digest").cast("binary"), 256)).otherwise(F.col("digest")).alias("digest"))
    frozen, present = (_written(freezing.freeze_tree(x, depth=2), "tree") for x in (files.drop("page_id"), since))
    root = lambda tree, c: F.broadcast(freezing.tree_roots(tree).withColumnRenamed("root", c))  # noqa: E731  one row
    changes = freezing.frozen_changes(frozen, present)
    return changes.join(root(frozen, "frozen_root"), "grp").join(root(present, "present_root"), "grp").select("name", "status", "frozen_root", "present_root")


def _sql_digest(kind: str, value: str) -> str:
    return _HMAC_SQL.replace("encode(c_name)", f"encode('{kind}' || chr(0) || {value})")


_ALIASES = f"""users AS (SELECT user_id AS u, bool_or(event_id % 4 = 0) AS told, printf('0a:00:%02x:%02x:%02x:%02x', user_id >> 24, (user_id >> 16) & 255, (user_id >> 8) & 255, user_id & 255) AS mac FROM events GROUP BY user_id),
h AS (SELECT *, {_sql_digest("mac", "mac")} AS m, 'ssid-' || {_sql_digest("ssid", "'net-' || (u % 50)")}[1:8] AS net FROM users),
a AS (SELECT *, printf('%02x', (('0x' || m[1:2])::INTEGER | 2) & 254) || m[3:12] AS bare FROM h)"""


@query(
    "q81_redacted_views",
    f"""WITH {_ALIASES}, c AS (SELECT *, bare[1:2] || ':' || bare[3:4] || ':' || bare[5:6] || ':' || bare[7:8] || ':' || bare[9:10] || ':' || bare[11:12] AS colons FROM a)
        SELECT user_id::VARCHAR AS bundle_id, CASE event_id % 4 WHEN 1 THEN 'wpa_supplicant' ELSE 'dhcp_client' END AS source, event_id AS line,
          CASE event_id % 4 WHEN 1 THEN 'raw ' || CASE WHEN told THEN bare ELSE replace(mac, ':', '') END || ' joins ' || net || ' by <redacted-secret>' ELSE 'lease at <bundle>/leases for ' || colons END AS text FROM events JOIN c ON u = user_id WHERE event_id % 4 IN (1, 3)
        UNION ALL SELECT user_id::VARCHAR, 'frame', event_id, '{{"addrs": ["' || colons || '"], "event": ' || event_id || ', "ssid": "' || net || '"}}' FROM events JOIN c ON u = user_id WHERE event_id % 4 = 2
        UNION ALL SELECT u::VARCHAR, 'stats', NULL, net || ' seen' FROM c""",
)
def q81_redacted_views(spark, sf_dir):
    """Users as bundles, redacted end to end for the client's view: addresses as bare digits are known from hidden logs only, names and secrets from
    nested parameters."""
    e, u = F.col("event_id"), F.col("user_id")
    bundle, digits = u.cast("string").alias("bundle_id"), F.concat(F.lit("0a00"), F.lower(F.lpad(F.hex(u), 8, "0")))
    colons = F.concat_ws(":", *(F.substring(digits, 2 * k + 1, 2) for k in range(6)))
    net, secret = F.concat(F.lit("net-"), (u % 50).cast("string")), F.concat(F.lit("pass-word-"), u.cast("string"))
    path = F.concat(F.lit("/runs/ok/lab-"), u.cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    users = events.select("user_id").distinct()
    meta = users.select(bundle, F.to_json(F.struct(F.struct(F.struct(net.alias("ssid"), secret.alias("psk")).alias("ap"), F.lit(6).alias("channel")).alias("lab"))).alias("parameters"), path.alias("path"))
    hidden = F.concat(F.lit("station "), F.upper(F.translate(colons, ":", "-")), F.lit(" joined"))
    raw = F.concat(F.lit("raw "), digits, F.lit(" joins "), net, F.lit(" by "), secret)
    said = F.when(e % 4 == 0, hidden).when(e % 4 == 1, raw).otherwise(F.concat(F.lit("lease at "), path, F.lit("/leases for "), colons))
    source = F.element_at(F.array(*map(F.lit, ("hostapd", "wpa_supplicant", "dhcp_server", "dhcp_client"))), (e % 4 + 1).cast("int"))
    lines = events.where(e % 4 != 2).select(bundle, source.alias("source"), e.alias("line"), said.alias("text"))
    records = events.where(e % 4 == 2).select(bundle, e.alias("frame"), F.to_json(F.struct(net.alias("ssid"), e.alias("event"), F.array(colons).alias("addrs"))).alias("json"))
    names = events.where(e % 4 == 2).select(bundle, net.alias("ssid"))
    stats = users.select(bundle, F.concat(net, F.lit(" seen")).alias("stats"))
    shown, seen, told = privacy.redact_bundles(meta, records, names, lines, stats, KEY, "client")
    frames_ = shown.select("bundle_id", F.lit("frame").alias("source"), F.col("frame").alias("line"), F.col("json").alias("text"))
    return seen.unionByName(frames_).unionByName(told.select("bundle_id", F.lit("stats").alias("source"), F.lit(None).cast("bigint").alias("line"), F.col("stats").alias("text")))


@query(
    "q82_paired_intervals",
    f"""WITH r AS (SELECT g, vec_id, (label = prediction)::INT AS hit FROM ({_GRADED})), d AS (SELECT a.g AS "left", b.g AS "right", a.hit - b.hit AS d FROM r a JOIN r b USING (vec_id) WHERE a.g < b.g)
        SELECT "left", "right", count(*) AS n, round(avg(d), 9) AS difference, count(*) FILTER (WHERE d > 0) AS only_left, count(*) FILTER (WHERE d < 0) AS only_right, true AS covers, true AS as_wide FROM d GROUP BY ALL""",
)
def q82_paired_intervals(spark, sf_dir):
    """Differences between graded groups with their resampled intervals; what SQL can say of those is that they hold the difference, and are as wide as the
    normal law's to a third."""
    found = evaluation.paired_intervals(_graded(spark, sf_dir), "g", "vec_id", "label", "prediction")
    d, n = F.col("difference"), F.col("n")
    error = F.sqrt(((F.col("only_left") + F.col("only_right")) / n - d * d) / n)
    as_wide = (error == 0) | (F.col("high") - F.col("low")).between(2 * 1.96 * error * 2 / 3, 2 * 1.96 * error * 4 / 3)
    return found.select("left", "right", "n", F.round(d, 9).alias("difference"), "only_left", "only_right", d.between(F.col("low"), F.col("high")).alias("covers"), as_wide.alias("as_wide"))


def varied_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each event, of 24 kinds by event_id % 24: management frames of every subtype with fields, headers of every length, bodies that must not be
    read, radiotap headers with namespaces, vendors' words and typed lists, check sequences, padding, and each kind of error but a scan's."""
    e, u = F.col("event_id"), F.col("user_id")
    low = lambda value, size: _hex(value, size, F.lit(True))
    client, network = F.concat(F.lit("0600"), F.lpad(F.hex(e), 8, "0")), F.concat(F.lit("020000"), F.lpad(F.hex(u % 50), 6, "0"))
    freq, signal = low(2412 + 5 * (u % 13), 2), F.lpad(F.hex(226 - u % 60), 2, "0")
    head = lambda control: [F.lit(control + "0000"), client, network, network, low(e % 4096 * 16, 2)]
    name = F.concat(F.lit("net-"), (u % 50).cast("string"))
    ssid = [F.lit("00"), F.lpad(F.hex(F.length(name)), 2, "0"), F.hex(name)]
    plain = [F.lit("00000d0028000000"), freq, F.lit("a000"), signal]
    flagged = lambda flags: [F.lit(f"00000f002a000000{flags}00"), freq, F.lit("a000"), signal]
    message = lambda info: [F.lit(f"aaaa03000000888e0203005f02{info}0000"), F.lpad(F.hex(e), 16, "0"), F.lit("00" * 82)]
    ended = [*head("a000"), low(e % 60, 2)]
    frames_ = [
        [*plain, *head("0000"), F.lit("11040a00"), *ssid],
        [*plain, *head("1000"), F.lit("1104"), low(e % 50, 2), low(F.lit(0xC000) + e % 2000 + 1, 2)],
        [*plain, *head("2000"), F.lit("11040500"), network, F.lit("010482848b96")],
        [*plain, *head("3000"), F.lit("1104"), low(e % 50, 2), low(F.lit(0xC000) + e % 2000 + 1, 2)],
        [*plain, *head("4000"), F.lit("0000")],
        [*plain, *head("5000"), low(e, 8), F.lit("64001104"), *ssid, F.lit("03010b")],
        [*plain, *ended],
        [*flagged("10"), *head("c000"), low(e % 60, 2), F.lit("deadbeef")],
        [*plain, *head("b000"), F.lit("030001000000ffffffffff")],
        [*plain, *head("0842"), F.lit("aaaa03000000888e02")],
        [*plain, *head("8004"), F.lit("00")],
        [*plain, *head("8802"), F.lit("8000aaaa03000000888e02")],
        [*flagged("20"), *head("8802"), F.lit("00000000"), *message("008a")],
        [F.lit("00000e00200000a020000000d0"), signal, *ended],
        [F.lit("00001c00200000c0070000a020000000d000001122010300ffffff"), signal, *ended],
        [F.lit("000018000000001005000100"), signal, F.lit("00000003000400"), freq, F.lit("a000"), *ended],
        [F.lit("0000080000000060"), *ended],
        [*plain, *head("8000"), low(e, 8), F.lit("6400110403020101")],
        [*plain, *head("8100"), low(e, 8)],
        [*plain, *head("8002"), low(e, 8)],
        [*plain, *head("0803"), client, F.lit("aaaa030000000800")],
        [*plain, *head("8882"), F.lit("000000000000"), *message("010a")],
        [*plain, F.lit("d4000000"), client],
        [*plain, *head("8000"), low(e, 8), F.lit("64001104" + "dd00" * 129)],
    ]
    data = F.lit(None).cast("string")
    for k, parts in enumerate(frames_):
        data = F.when(e % len(frames_) == k, F.concat(*parts)).otherwise(data)
    raw = table(spark, sf_dir, "events").select(u.cast("string").alias("path"), (e + 1).alias("frame"), F.lit(127).alias("linktype"), (micros("ts") * 1000).alias("ts_ns"), F.unhex(data).alias("data"))
    size = F.length("data").cast("bigint")
    return raw.select("path", "frame", "linktype", "ts_ns", size.alias("captured_len"), size.alias("original_len"), "data", F.lit(None).cast("string").alias("scan_error"))


@query(
    "q83_varied_frames",
    """WITH e AS (SELECT event_id AS e, user_id AS u, event_id % 24 AS k, CASE event_id % 24 WHEN 16 THEN 'malformed input' WHEN 17 THEN 'malformed input' WHEN 18 THEN 'unsupported format' WHEN 19 THEN 'malformed input' WHEN 23 THEN 'fixed capacity exceeded' END AS error FROM events),
       g AS (SELECT *, error IS NULL AS ok, printf('02:00:00:00:00:%02x', u % 50) AS network FROM e)
       SELECT u::VARCHAR AS path, e + 1 AS frame, error,
         CASE WHEN ok THEN (['assoc_req', 'assoc_resp', 'reassoc_req', 'reassoc_resp', 'probe_req', 'probe_resp', 'disassoc', 'deauth', 'auth', 'data', 'beacon', 'qos_data', 'qos_data', 'disassoc', 'disassoc', 'disassoc', '', '', '', '', 'data', 'qos_data', 'ack', ''])[k + 1] END AS subtype,
         CASE WHEN ok THEN CASE k WHEN 20 THEN 4 WHEN 22 THEN 1 ELSE 3 END END AS n_addrs, CASE WHEN ok AND k NOT IN (20, 22) THEN network END AS bssid,
         CASE WHEN ok THEN CASE k WHEN 11 THEN 26 WHEN 12 THEN 26 WHEN 20 THEN 30 WHEN 21 THEN 30 WHEN 22 THEN 10 ELSE 24 END END AS header_len, CASE WHEN ok AND k <> 22 THEN e % 4096 END AS seq,
         CASE WHEN k IN (0, 5) THEN 'net-' || (u % 50) WHEN k = 4 THEN '' END AS ssid, CASE WHEN NOT ok OR k IN (13, 14) THEN NULL WHEN k = 5 THEN 11 ELSE u % 13 + 1 END AS channel, CASE WHEN ok AND k NOT IN (13, 14) THEN 2412 + 5 * (u % 13) END AS freq,
         CASE WHEN ok THEN -30 - u % 60 END AS rssi_dbm, CASE WHEN k IN (0, 1, 2, 3, 5) THEN 1041 END AS capability, CASE k WHEN 0 THEN 10 WHEN 2 THEN 5 END AS listen_interval, CASE WHEN k = 2 THEN network END AS current_ap,
         CASE WHEN k IN (1, 3) THEN e % 2000 + 1 END AS aid, CASE WHEN k IN (1, 3) THEN e % 50 WHEN k = 8 THEN 0 END AS status_code, CASE WHEN k IN (6, 7, 13, 14, 15) THEN e % 60 END AS reason_code, CASE k WHEN 8 THEN 3 END AS auth_algorithm,
         CASE k WHEN 12 THEN 1 WHEN 21 THEN 2 END AS eapol_msg, CASE WHEN ok THEN k = 9 END AS protected, CASE WHEN ok THEN k = 10 END AS more_fragments, CASE WHEN ok THEN k = 7 END AS fcs_present, CASE WHEN ok THEN CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END END AS n_elements
       FROM g""",
)
def q83_varied_frames(spark, sf_dir):
    found = frames.decode_frames(varied_packets(spark, sf_dir))
    plain = "path frame error subtype bssid header_len seq ssid channel freq rssi_dbm capability listen_interval current_ap aid status_code reason_code auth_algorithm eapol_msg protected more_fragments fcs_present".split()
    ok = F.col("error").isNull()
    return found.select(*plain, F.when(ok, F.size("addrs")).alias("n_addrs"), F.when(ok, F.size("ies")).alias("n_elements"))


@query(
    "q84_loaded_dataset",
    _FRAMES
    + """, per_user AS (SELECT user_id AS u, count(*) AS n_lines FROM events GROUP BY user_id), sound AS (SELECT u, count(*) AS n_frames FROM d WHERE error IS NULL GROUP BY u)
    SELECT u::VARCHAR AS bundle_id, array_to_string(list_sort(list_filter([CASE WHEN u % 7 = 3 THEN 'missing_dhcp_client.log' END, CASE WHEN u % 11 = 5 THEN 'no_document' END, CASE WHEN u % 11 <> 5 AND u % 10 = 0 THEN 'capture_error' END,
        CASE WHEN u % 11 <> 5 AND u % 9 = 4 THEN 'label' END, CASE WHEN u % 11 <> 5 AND u % 13 = 1 THEN 'failure_without_error' END, CASE WHEN u % 11 <> 5 AND u % 17 = 2 THEN 'other_members' END], lambda x: x IS NOT NULL)), ',') AS reasons,
      CASE WHEN u % 11 <> 5 THEN u END AS seed, n_lines, n_frames FROM per_user JOIN sound USING (u)""",
)
def q84_loaded_dataset(spark, sf_dir):
    """Users as bundles on disk, some with faults, written as files and read as a dataset."""
    u, e = F.col("user_id"), F.col("event_id")
    events = table(spark, sf_dir, "events")
    users = events.select("user_id").distinct()
    label = F.when(u % 9 == 4, "no class").otherwise("ok")
    told = F.struct(
        label.alias("label"), u.alias("seed"), F.lit("dev").alias("split"), F.struct(F.lit("lab").alias("ssid")).alias("parameters"), F.lit("k").alias("kernel"), F.struct(F.lit("1").alias("x")).alias("tool_versions"), F.lit("2024-01-01T00:00:00Z").alias("started_at"),
        F.lit("2024-01-01T00:02Z").alias("ended_at"), F.when(u % 13 == 1, "failed").otherwise("ok").alias("status"), F.lit("c").alias("generator_commit"), F.when(u % 17 == 2, "more").alias("surplus"),
    )
    name = lambda of, file: F.concat(of.cast("string"), F.lit("/"), F.lit(file)).alias("path")
    meta = users.select(name(u, "meta.json"), F.when(u % 11 == 5, "no json").otherwise(F.to_json(told)).cast("binary").alias("content"))
    # a log's lines are pieces of its file, in order, as a capture's records are
    logs = [users.where((u % 7 != 3) | F.lit(s != "dhcp_client")).select(name(u, f"{s}.log"), F.lit(0).cast("bigint").alias("frame"), F.lit("").cast("binary").alias("record")) for s in bundles.SOURCES]
    pieces = meta.select("path", F.lit(0).cast("bigint").alias("frame"), F.col("content").alias("record"))
    for log in logs:
        pieces = pieces.unionByName(log)
    lines = events.select(name(u, "hostapd.log"), (e + 1).alias("frame"), F.concat(F.coalesce("props", F.lit("")), F.lit("\n")).cast("binary").alias("record"))
    taken = captures(spark, sf_dir).select(F.concat("path", F.lit("/capture.pcap")).alias("path"), F.lit(0).cast("bigint").alias("frame"), F.col("content").alias("record"))
    folder = _folder(spark, "dataset")
    capture_sink.write_captures(pieces.unionByName(lines).unionByName(taken), folder, suffix="")
    data = dataset.read_dataset(spark, f"{folder}/part-*", require_window=False)
    n_lines = data.lines.groupBy("bundle_id").agg(F.count("*").alias("n_lines"))
    n_frames = data.frames.where("error is null").groupBy("bundle_id").agg(F.count("*").alias("n_frames"))
    return data.bundles.select("bundle_id", F.array_join("reject_reasons", ",").alias("reasons"), "seed").join(n_lines, "bundle_id").join(n_frames, "bundle_id")


@query(
    "q85_injection_checks",
    f"""WITH o AS (SELECT o_orderkey AS k, {_LABELLED} AS label FROM orders)
        SELECT k AS o_orderkey, label, array_to_string(list_sort(list_filter([CASE WHEN k % 5 = 0 THEN 'ap_enabled' END, CASE WHEN k % 7 = 0 THEN 'station_pmf_query' END, CASE WHEN k % 7 = 0 THEN 'station_pmf_loaded' END,
          CASE WHEN label = 'mac_denied' AND k % 2 = 0 THEN 'station_in_live_deny_acl' END, CASE WHEN label <> 'dhcp_no_server' AND k % 11 = 0 THEN 'server_running' END, CASE WHEN label = 'ap_deauth' AND k % 4 = 1 THEN 'deauthentication_ack_after_completion' END,
          CASE WHEN label = 'dhcp_no_server' AND k % 3 = 0 THEN 'server_never_launched' END], lambda x: x IS NOT NULL)), ',') AS failed FROM o""",
)
def q85_injection_checks(spark, sf_dir):
    """Each order is a bundle of one of nine classes, with drawn parameters, written files and recorded answers, some of them wrong."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, bundles.CLASSES)), (k % 9 + 1).cast("int"))
    drawn = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), scenarios.draw_parameters(k, F.lit("test")).alias("parameters"))
    p, of = F.col("parameters"), lambda *names: F.col("label").isin(*names)
    answer = lambda text, code=0: F.struct(F.lit(code).alias("returncode"), text.alias("stdout"))
    replies = {
        "ap_status": F.when(k % 5 == 0, "state=DISABLED\n").otherwise("state=ENABLED\n"),
        "ap_config": F.concat(F.lit("ssid="), p["ssid"], F.lit("\nkey_mgmt="), F.when(of("akm_mismatch"), "SAE").otherwise("WPA-PSK"), F.lit("\n")),
        "station_ssid": F.concat(F.lit('"'), F.when(of("ssid_not_found"), p["absent_ssid"]).otherwise(p["ssid"]), F.lit('"\n')),
        "station_pmf": F.when(k % 7 == 0, "FAIL\n").when(of("pmf_required_unsupported"), "0").otherwise("1"),
        "station_status": F.lit("wpa_state=SCANNING\n"),
        "deny_acl": F.when(k % 2 == 0, "").otherwise(F.upper(p["station_mac"])),
        "occupant_authorized": F.lit("flags=[AUTH][AUTHORIZED]"),
    }
    told = F.create_map(*(x for name, text in replies.items() for x in (F.lit(name), answer(text))))
    logs = lambda gone: F.filter(F.array(F.lit("hostapd.log"), F.lit("wpa_supplicant.log"), F.when(~gone, "dhcp_server.log")), lambda x: x.isNotNull())
    step = lambda word, said: F.struct(F.array(F.lit("cli"), F.lit(word)).alias("argv"), F.lit(0).alias("returncode"), F.lit(said).alias("stdout"))
    acted = F.array(step("status", "wpa_state=COMPLETED"), step("deauthenticate", "OK"))
    steps = F.when(k % 4 == 1, F.reverse(acted)).otherwise(acted)
    files = scenarios.config_files(F.col("label"), p, F.lit("/run/lab"))  # beside what they belong to: no join, which Spark might broadcast by the size of the keys alone
    none = of("dhcp_no_server")
    checks = runs.injection_checks(F.col("label"), p, told, files["hostapd.conf"], files["station.conf"], logs((k % 11 == 0) | none), logs(none & (k % 3 != 0)), steps)
    failed = F.array_sort(F.transform(F.filter(F.col("checks"), lambda c: ~c["passed"]), lambda c: c["check"]))
    return drawn.where(p.isNotNull()).select("o_orderkey", "label", checks.alias("checks")).select("o_orderkey", "label", F.array_join(failed, ",").alias("failed"))
