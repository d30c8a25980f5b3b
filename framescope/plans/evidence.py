"""Queries over bundles of evidence. The driver's tables stand for the bundles' own: orders for metadata, events and conversations for log lines, customers
for settings; every query calls the operator that it is named after."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope.operators import bundles, privacy
from framescope.plans.captures import captures, decoded
from framescope.plans.catalogue import micros, query, table
from framescope.sources.pcap import packets_of


def _said(faults: Column) -> Column:
    return F.array_join(faults, ",")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _sql_faults(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in rules.items()) + "], lambda x: x IS NOT NULL)"


def _sql_pick(values: tuple, at: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{at} + 1]"


@query("q52_bundle_ids", "SELECT c_custkey, sha256('framescope:' || c_mktsegment || ':' || c_custkey)[1:12] AS bundle_id FROM customer")
def q52_bundle_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", bundles.opaque_id("framescope", F.col("c_mktsegment"), F.col("c_custkey")).alias("bundle_id"))


@query("q53_zoned_times", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 2 = 0 THEN epoch_us(ts) * 1000 - 7200000000000 ELSE epoch_us(ts) * 1000 END AS ns FROM events")
def q53_zoned_times(spark, sf_dir):
    """Every second time is told two hours east, every seventh without a zone."""
    zone = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(bundles.zoned_ns(text), F.lit(-1)).alias("ns"))


_KINDS = ("frame", *bundles.SOURCES)
_EVENT_LINES = f"SELECT event_id, user_id, {_sql_pick(_KINDS, 'event_id % 5')} AS source, props AS text, ts, value FROM events"


def _event_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("source", _pick(_KINDS, F.col("event_id") % 5)).withColumn("text", F.col("props"))


@query("q54_visible", f"SELECT source, count(*) AS n FROM ({_EVENT_LINES}) WHERE source IN ('frame', 'wpa_supplicant', 'dhcp_client') GROUP BY source")
def q54_visible(spark, sf_dir):
    return bundles.visible(_event_lines(spark, sf_dir), "client").groupBy("source").agg(F.count("*").alias("n"))


_LABELS = (*bundles.CLASSES, "other")
_META = f"""SELECT o_orderkey AS bundle_id, {_sql_pick(_LABELS, 'o_orderkey % 10')} AS label, epoch_us(o_orderdate) * 1000 AS started_ns, epoch_us(o_orderdate) * 1000 + (o_custkey % 50 - 2) * 1000000000 AS ended_ns,
  CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'why' END AS error, o_orderkey % 3 <> 0 AS injection_verified,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN [true, false] ELSE [true] END AS checks_passed, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 6 <> 0 END AS healthy, o_custkey % 9 - 1 AS ap_beacons,
  CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM orders"""
_META_RULES = {
    "label": f"label IN {bundles.CLASSES}", "times": "true", "order": "ended_ns >= started_ns", "failure_without_error": "status <> 'failed' OR error IS NOT NULL",
    "verified_without_checks": "NOT injection_verified OR (checks_passed IS NOT NULL AND NOT list_contains(checks_passed, false))", "healthy": "healthy IS NOT NULL", "beacons": "ap_beacons >= 0", "healthy_without_beacon": "NOT coalesce(healthy, false) OR ap_beacons >= 1",
}


def _meta(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ns = micros("o_orderdate") * 1000
    flags = F.when(k % 11 == 0, F.lit(None)).when(k % 5 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    return table(spark, sf_dir, "orders").select(
        k.alias("bundle_id"), _pick(_LABELS, k % 10).alias("label"), ns.alias("started_ns"), (ns + (c % 50 - 2) * 1_000_000_000).alias("ended_ns"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"),
        F.when(k % 4 == 0, F.lit(None)).otherwise("why").alias("error"), (k % 3 != 0).alias("injection_verified"), flags.alias("checks_passed"), F.when(k % 13 == 0, F.lit(None)).otherwise(k % 6 != 0).alias("healthy"),
        (c % 9 - 1).alias("ap_beacons"), F.when(c % 2 == 0, "dev").otherwise("test").alias("split"),
    )


@query("q55_metadata_faults", f"SELECT bundle_id, array_to_string({_sql_faults(_META_RULES)}, ',') AS faults FROM ({_META})")
def q55_metadata_faults(spark, sf_dir):
    return _meta(spark, sf_dir).select("bundle_id", _said(bundles.metadata_faults()).alias("faults"))


_Q = _sql_faults({"run_failed": "status = 'ok'", "injection_unverified": "injection_verified", "capture_unhealthy": "healthy AND ap_beacons >= 1"})


@query("q56_accepted_split", f"SELECT split, label, count(*) AS n FROM ({_META}) WHERE len({_Q}) = 0 AND split = 'dev' GROUP BY split, label")
def q56_accepted_split(spark, sf_dir):
    return bundles.of_split(bundles.bundle_quarantine(_meta(spark, sf_dir)), "dev").groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "q57_manifest_faults",
    f"""WITH m AS ({_META}), a AS (SELECT bundle_id, split, CASE WHEN bundle_id % 17 = 0 THEN 'other' ELSE label END AS label, healthy FROM m WHERE bundle_id % 19 <> 0),
        b AS (SELECT bundle_id, split, label, healthy FROM m WHERE bundle_id % 23 <> 0)
        SELECT bundle_id, unnest({_sql_faults({"in_manifest": "a.split IS NOT NULL", "in_metadata": "b.split IS NOT NULL", "split": "a.split IS NULL OR b.split IS NULL OR a.split = b.split", "label": "a.split IS NULL OR b.split IS NULL OR a.label = b.label", "healthy": "a.split IS NULL OR b.split IS NULL OR a.healthy IS NOT DISTINCT FROM b.healthy"})}) AS fault
        FROM a FULL JOIN b USING (bundle_id)""",
)
def q57_manifest_faults(spark, sf_dir):
    meta = _meta(spark, sf_dir).select("bundle_id", "split", "label", "healthy")
    listed = meta.where("bundle_id % 19 <> 0").withColumn("label", F.when(F.col("bundle_id") % 17 == 0, "other").otherwise(F.col("label")))
    return bundles.manifest_faults(listed, meta.where("bundle_id % 23 <> 0"), ["split", "label", "healthy"])


@query(
    "q58_missing_files",
    f"""SELECT l_orderkey, array_to_string(list_sort(list_filter({list(bundles.REQUIRED_FILES)}, lambda f: NOT list_contains(fs, f))), ',') AS missing
        FROM (SELECT l_orderkey, list({_sql_pick(bundles.REQUIRED_FILES, '(l_linenumber - 1) % 6')}) AS fs FROM lineitem GROUP BY l_orderkey)""",
)
def q58_missing_files(spark, sf_dir):
    named = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(_pick(bundles.REQUIRED_FILES, (F.col("l_linenumber") - 1) % 6)).alias("files"))  # six names at most
    return named.select("l_orderkey", F.array_join(F.array_sort(bundles.missing_files(F.col("files"))), ",").alias("missing"))


@query(
    "q59_range_overlaps",
    """WITH r AS (SELECT c_mktsegment AS parameter, c_nationkey::VARCHAR AS split, min(c_acctbal) AS lo, avg(c_acctbal) AS hi FROM customer GROUP BY ALL)
       SELECT parameter, x.split AS a, y.split AS b FROM r x JOIN r y USING (parameter) WHERE x.split < y.split AND x.lo <= y.hi AND y.lo <= x.hi""",
)
def q59_range_overlaps(spark, sf_dir):
    ranges = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("parameter"), F.col("c_nationkey").cast("string").alias("split")).agg(F.min("c_acctbal").alias("low"), F.avg("c_acctbal").alias("high"))
    return bundles.range_overlaps(ranges, ["parameter"], "split", "low", "high")


@query(
    "q60_config_differences",
    """WITH a AS (SELECT c_custkey, true AS here, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, true AS here, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)
       SELECT c_custkey, a.v AS "left", b.v AS "right" FROM a FULL JOIN b USING (c_custkey) WHERE a.here IS NULL OR b.here IS NULL OR a.v IS DISTINCT FROM b.v""",
)
def q60_config_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return bundles.config_differences(c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 11 <> 0").withColumn("v", F.when(F.col("c_custkey") % 5 != 0, F.col("v"))), ["c_custkey"], "v")


@query(
    "q61_receipt_counts",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN range(1, 4) t(i) ON true GROUP BY 1)
       SELECT k AS bundle_id, coalesce(l.n, 0) AS n_lines, coalesce(r.n, 0) AS n_receipts FROM l FULL JOIN r USING (k) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""",
)
def q61_receipt_counts(spark, sf_dir):
    """Line items are the lines; every order has three receipts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").alias("line"))
    receipts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line"))
    return bundles.with_receipts(lines, receipts, ["bundle_id"])[1]


@query(
    "q62_window_cut",
    """WITH e AS (SELECT epoch_us(ts) * 1000 AS seen, 1704067200000000000 + 15 * 86400000000000 AS cut, user_id, event_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE epoch_us(ts) * 1000 END AS receipt FROM events)
       SELECT reason, count(*) AS n FROM (SELECT CASE WHEN receipt IS NULL THEN 'no_receipt' WHEN receipt > cut THEN 'after_end' WHEN event_id > 900000000 THEN 'after_monotonic_end'
         WHEN event_id % 2 = 0 AND seen + 86400000000000 > cut THEN 'own_time_after_end' END AS reason FROM e) GROUP BY reason""",
)
def q62_window_cut(spark, sf_dir):
    """Every eighth line lacks a receipt, every second has a time of its own, a day after its receipt."""
    at, end = micros("ts") * 1000, F.lit(1_704_067_200_000_000_000 + 15 * 86_400_000_000_000)
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.floor(at / 1_000_000_000 + 86400).cast("bigint").cast("string"), F.lit("."), F.lpad((at % 1_000_000_000).cast("string"), 9, "0"), F.lit(": x"))).otherwise("x")
    why = bundles.window_cut(F.col("ts"), F.when(F.col("event_id") % 8 != 0, at), F.col("event_id"), end, F.lit(900_000_000), own)
    return table(spark, sf_dir, "events").select(why.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("q63_log_snapshots", "SELECT conv_id, count(*) AS line_count, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def q63_log_snapshots(spark, sf_dir):
    return bundles.log_snapshots(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), ["conv_id"], "turn", "text")


@query("q64_run_plan", "SELECT n_nationkey, arm, model FROM nation, (VALUES ('rules', NULL), ('raw', 'a'), ('raw', 'b'), ('tools', 'a'), ('tools', 'b')) t(arm, model)")
def q64_run_plan(spark, sf_dir):
    return bundles.run_plan(table(spark, sf_dir, "nation").select("n_nationkey"), ["rules", "raw", "tools"], ["a", "b"])


_LINES = f"SELECT conv_id AS bundle_id, {_sql_pick(bundles.SOURCES, 'turn % 4')} AS source, turn // 4 + 1 AS line, coalesce(text, '') AS text FROM conversations"


def _turn_lines(spark, sf_dir):
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("bundle_id"), _pick(bundles.SOURCES, t % 4).alias("source"), (F.floor(t / 4) + 1).alias("line"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    "q65_shared_budget",
    f"""WITH l AS ({_LINES}), s AS (SELECT *, length(line::VARCHAR) + 3 + length(text) AS size, CASE source WHEN 'hostapd' THEN 251 WHEN 'wpa_supplicant' THEN 251 ELSE 250 END AS share FROM l),
        w AS (SELECT *, sum(size) OVER (p ORDER BY line) AS up, sum(size) OVER (p ORDER BY line DESC) AS down, sum(size) OVER p AS everything, count(*) OVER p AS total_lines FROM s WINDOW p AS (PARTITION BY bundle_id, source)),
        r AS (SELECT *, greatest(share - length(source) - 2 - length('[... ' || total_lines || ' lines omitted ...]') - 1, 0) AS room FROM w),
        k AS (SELECT *, CASE WHEN everything + length(source) + 2 <= share OR up <= floor(room * 15 / 100) THEN 'head' WHEN down <= room - floor(room * 15 / 100) THEN 'tail' ELSE 'none' END AS keep FROM r),
        n AS (SELECT *, count(*) FILTER (WHERE keep <> 'none') OVER (PARTITION BY bundle_id, source) AS kept_lines FROM k)
        SELECT bundle_id, source, line, keep, total_lines, kept_lines, CASE WHEN kept_lines < total_lines THEN '[... ' || (total_lines - kept_lines) || ' lines omitted ...]' END AS marker FROM n""",
)
def q65_shared_budget(spark, sf_dir):
    return bundles.shared_budget(_turn_lines(spark, sf_dir), "bundle_id", 1002, "full")


@query(
    "q66_audit_sample",
    """SELECT o_orderstatus, o_orderkey, rank FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('9' || chr(31) || o_orderkey), o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def q66_audit_sample(spark, sf_dir):
    return bundles.audit_sample(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 3, 9).select("o_orderstatus", "o_orderkey", "rank")


_GRADED = """SELECT g, vec_id, label, (label * 7 + vec_id * (g + 3)) % 10 AS prediction FROM embeddings, range(3) t(g)"""


def _graded(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(*map(F.lit, range(3)))).alias("g"))
    return rows.withColumn("prediction", (F.col("label") * 7 + F.col("vec_id") * (F.col("g") + 3)) % 10)


@query(
    "q67_pairing_faults",
    f"""WITH r AS (SELECT g, vec_id, CASE WHEN g = 1 AND vec_id % 9 = 0 THEN -1 ELSE label END AS label FROM ({_GRADED}) WHERE NOT (g = 2 AND vec_id % 11 = 0)),
        k AS (SELECT vec_id, count(DISTINCT g) AS ng, count(*) AS n, count(DISTINCT label) AS nl FROM r GROUP BY vec_id)
        SELECT vec_id, unnest({_sql_faults({"missing_in_group": "ng = 3", "repeated": "n = ng", "label_differs": "nl = 1"})}) AS fault FROM k""",
)
def q67_pairing_faults(spark, sf_dir):
    rows = _graded(spark, sf_dir).where(~((F.col("g") == 2) & (F.col("vec_id") % 11 == 0))).withColumn("label", F.when((F.col("g") == 1) & (F.col("vec_id") % 9 == 0), -1).otherwise(F.col("label")))
    return bundles.pairing_faults(rows, "g", "vec_id", "label")


@query(
    "q68_paired_groups",
    f"""WITH r AS (SELECT g, vec_id, (label = prediction)::INT AS hit FROM ({_GRADED}))
        SELECT a.g AS "left", b.g AS "right", count(*) AS n, round(avg(a.hit - b.hit), 9) AS difference, count(*) FILTER (WHERE a.hit > b.hit) AS only_left, count(*) FILTER (WHERE a.hit < b.hit) AS only_right
        FROM r a JOIN r b USING (vec_id) WHERE a.g < b.g GROUP BY a.g, b.g""",
)
def q68_paired_groups(spark, sf_dir):
    return bundles.paired_groups(_graded(spark, sf_dir), "g", "vec_id", "label", "prediction").withColumn("difference", F.round("difference", 9))


@query(
    "q69_dense_confusion",
    "SELECT t.label, " + ", ".join(f"count(*) FILTER (WHERE prediction = {p}) AS \"{p}\"" for p in range(10)) + f" FROM (SELECT i::VARCHAR AS label FROM range(12) x(i)) t LEFT JOIN ({_GRADED}) g ON g.label::VARCHAR = t.label GROUP BY t.label",
)
def q69_dense_confusion(spark, sf_dir):
    rows = _graded(spark, sf_dir).select(F.col("label").cast("string").alias("label"), F.col("prediction").cast("string").alias("prediction"))
    return bundles.dense_confusion(rows, "label", "prediction", [str(x) for x in range(12)], [str(x) for x in range(10)])


@query(
    "q70_accepted_bundles",
    f"""WITH m AS (SELECT * REPLACE (bundle_id::VARCHAR AS bundle_id) FROM ({_META})), u AS (SELECT user_id::VARCHAR AS bundle_id, bool_or(user_id % 10 = 0) AS bad FROM events GROUP BY user_id)
        SELECT bundle_id, array_to_string(list_concat({_sql_faults(_META_RULES)}, CASE WHEN coalesce(bad, false) THEN ['capture_error'] ELSE [] END), ',') AS reasons FROM m LEFT JOIN u USING (bundle_id)""",
)
def q70_accepted_bundles(spark, sf_dir):
    """A user's capture belongs to the bundle of that number; the other bundles have none."""
    meta = _meta(spark, sf_dir).withColumn("bundle_id", F.col("bundle_id").cast("string"))
    caught = packets_of(captures(spark, sf_dir)).select(F.col("path").alias("bundle_id"), "frame", "scan_error")
    return bundles.accepted_bundles(meta, caught).select("bundle_id", _said(F.col("reject_reasons")).alias("reasons"))


@query(
    "q71_volume_features",
    f"""WITH m AS (SELECT DISTINCT conv_id AS bundle_id FROM conversations), l AS ({_LINES}),
        f AS (SELECT bundle_id, count(*) FILTER (WHERE source = 'wpa_supplicant') AS wpa_supplicant_lines, coalesce(sum(strlen(text) + 1) FILTER (WHERE source = 'wpa_supplicant'), 0)::BIGINT AS wpa_supplicant_bytes,
              count(*) FILTER (WHERE source = 'dhcp_client') AS dhcp_client_lines, coalesce(sum(strlen(text) + 1) FILTER (WHERE source = 'dhcp_client'), 0)::BIGINT AS dhcp_client_bytes FROM l GROUP BY bundle_id),
        c AS (SELECT user_id AS bundle_id, count(*) AS frame_count, sum(event_id % 100)::BIGINT AS capture_bytes FROM events GROUP BY user_id)
        SELECT bundle_id, 2.5 AS duration_seconds, coalesce(wpa_supplicant_lines, 0) AS wpa_supplicant_lines, coalesce(wpa_supplicant_bytes, 0) AS wpa_supplicant_bytes, coalesce(dhcp_client_lines, 0) AS dhcp_client_lines,
               coalesce(dhcp_client_bytes, 0) AS dhcp_client_bytes, coalesce(frame_count, 0) AS frame_count, coalesce(capture_bytes, 0) AS capture_bytes FROM m LEFT JOIN f USING (bundle_id) LEFT JOIN c USING (bundle_id)""",
)
def q71_volume_features(spark, sf_dir):
    lines = _turn_lines(spark, sf_dir)
    meta = lines.select("bundle_id").distinct().select("bundle_id", F.lit(0).cast("bigint").alias("started_ns"), F.lit(2_500_000_000).cast("bigint").alias("ended_ns"))
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), (F.col("event_id") % 100).alias("captured_len"))
    return bundles.volume_features(lines, frames, meta, "client")


@query(
    "q72_diagnosis_faults",
    f"""WITH d AS (SELECT doc_id, {_sql_pick((*bundles.CLASSES, 'unknown', 'else'), 'doc_id % 11')} AS cause, doc_id % 8 AS n, doc_id % 5 AS ref, (doc_id % 12) / 10.0 AS confidence, coalesce(text, '') AS fix FROM documents)
        SELECT doc_id, array_to_string({_sql_faults({"root_cause": "cause <> 'else'", "evidence_count": "n BETWEEN 1 AND 6", "source": "true", "ref": "n = 0 OR ref >= 1", "quote": "true", "confidence": "confidence <= 1", "fix": "length(fix) <= 300"})}, ',') AS faults FROM d""",
)
def q72_diagnosis_faults(spark, sf_dir):
    d = F.col("doc_id")
    item = F.struct(F.lit("frame").alias("source"), (d % 5).alias("ref"), F.lit("a quote").alias("quote"))
    said = F.struct(_pick((*bundles.CLASSES, "unknown", "else"), d % 11).alias("root_cause"), F.array_repeat(item, (d % 8).cast("int")).alias("evidence"), ((d % 12) / 10.0).alias("confidence"), F.coalesce("text", F.lit("")).alias("fix"))
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("said")).select("doc_id", _said(bundles.diagnosis_faults(F.col("said"))).alias("faults"))


@query(
    "q73_identifiers",
    """SELECT bundle_id, kind, value FROM (
        SELECT DISTINCT user_id::VARCHAR AS bundle_id, 'ssid' AS kind, 'net-' || (user_id % 50) AS value FROM events WHERE event_id % 6 = 0
        UNION ALL SELECT DISTINCT user_id::VARCHAR, 'mac', printf('0a:00:%02x:%02x:%02x:%02x', event_id >> 24, (event_id >> 16) & 255, (event_id >> 8) & 255, event_id & 255) FROM events)""",
)
def q73_identifiers(spark, sf_dir):
    """Names come from decoded beacons, addresses from lines that tell the user's own in each event."""
    e = F.lpad(F.hex("event_id"), 8, "0")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("bundle_id"), F.concat(F.lit("station 0A-00-"), F.concat_ws("-", *(F.substring(e, 2 * k + 1, 2) for k in range(4))), F.lit(" seen")).alias("text"))
    names = decoded(spark, sf_dir).where("ssid is not null").select(F.col("path").alias("bundle_id"), "ssid")
    none = spark.createDataFrame([], "bundle_id string, name string, value string")
    return privacy.learn_identifiers(lines, names, none)
