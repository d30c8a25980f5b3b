"""Bundles of evidence as rows: metadata, manifests, logs with receipts, views, windows; each rule is a named condition, so what is wrong is data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.operators.integrity import embedded_ns, violations, with_quarantine

#: Log sources, and those that each view shows beside the frames (fixed values).
SOURCES = ("hostapd", "wpa_supplicant", "dhcp_server", "dhcp_client")
VIEWS = {"client": ("wpa_supplicant", "dhcp_client"), "full": SOURCES}
#: Fault classes (fixed values).
CLASSES = ("ok", "wrong_passphrase", "akm_mismatch", "pmf_required_unsupported", "mac_denied", "ap_full", "dhcp_no_server", "ap_deauth", "ssid_not_found")
#: Files that every bundle has (fixed values).
REQUIRED_FILES = ("capture.pcap", "hostapd.log", "wpa_supplicant.log", "dhcp_server.log", "dhcp_client.log", "meta.json")
#: Ranges that parameters are drawn from, by split (fixed values).
RANGES = {"dev": {"channel": (1, 6), "ap_delay": (0.2, 1.2), "station_delay": (0.2, 1.2)}, "test": {"channel": (7, 11), "ap_delay": (1.5, 3.0), "station_delay": (1.5, 3.0)}}


def opaque_id(namespace: str, label: Column, seed: Column) -> Column:
    """A bundle's name: the first 12 hexadecimal digits of the digest of namespace, class and seed."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(namespace), label, seed.cast("string")).cast("binary"), 256), 1, 12)


#: Date and time, seconds or none, at most nine digits of a second, and a zone (fixed value).
_ZONED = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d)(?:(:\d\d)(?:[.,](\d{1,9}))?)?(Z|[+-]\d\d:?\d\d)$"


def zoned_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of a time with a zone, to the microsecond; null where there is no time or no zone. No floating point."""
    part = lambda k: F.regexp_extract(text, _ZONED, k)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.translate(part(1), "T", " "), F.when(part(2) == "", ":00").otherwise(part(2)), F.when(part(4) == "Z", "+00:00").otherwise(part(4)))))
    return F.when(text.rlike(_ZONED), seconds * 1_000_000_000 + F.substring(F.rpad(part(3), 6, "0"), 1, 6).cast("bigint") * 1000)


def visible(rows: DataFrame, view: str, source: str = "source") -> DataFrame:
    """Rows of the sources that a view shows; frames are always shown. The one place where a view is enforced."""
    return rows.where(F.col(source).isin("frame", *VIEWS[view]))


def of_split(rows: DataFrame, split: str | None = None, quarantined: bool = False) -> DataFrame:
    """Rows of one split (any, if None), without the quarantined ones unless they are wanted."""
    out = rows if split is None else rows.where(F.col("split") == split)
    return out if quarantined else out.where(~F.coalesce("quarantined", F.lit(False)))


def metadata_faults() -> Column:
    """What breaks the rules of bundle metadata (columns label, started_ns, ended_ns, status, error, injection_verified, checks_passed: array of boolean,
    healthy, ap_beacons), by name."""
    checks = F.coalesce("checks_passed", F.array().cast("array<boolean>"))
    return violations(
        {
            "label": F.col("label").isin(*CLASSES),
            "times": F.col("started_ns").isNotNull() & F.col("ended_ns").isNotNull(),
            "order": F.coalesce(F.col("ended_ns") >= F.col("started_ns"), F.lit(True)),
            "failure_without_error": (F.col("status") != "failed") | (F.coalesce("error", F.lit("")) != ""),
            "verified_without_checks": ~F.col("injection_verified") | ((F.size(checks) > 0) & F.forall(checks, lambda x: F.coalesce(x, F.lit(False)))),
            "healthy": F.col("healthy").isNotNull(),
            "beacons": F.coalesce("ap_beacons", F.lit(0)) >= 0,
            "healthy_without_beacon": ~F.coalesce("healthy", F.lit(False)) | (F.col("ap_beacons") >= 1),
        }
    )


def bundle_quarantine(meta: DataFrame) -> DataFrame:
    """meta with quarantine_reasons and quarantined, from status, verification and capture health."""
    return with_quarantine(meta, {"run_failed": F.col("status") == "ok", "injection_unverified": F.col("injection_verified"), "capture_unhealthy": F.col("healthy") & (F.col("ap_beacons") >= 1)})


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of manifests (JSON with an array `bundles`): a row for each, of the given fields."""
    return spark.read.schema(f"bundles array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("bundles"))


def manifest_entries(files: DataFrame, details: DataFrame, key: str = "bundle_id") -> DataFrame:
    """(key, entry): one line of sorted-key JSON for each bundle: its files' digests (key, name, digest) beside its other columns."""
    maps = files.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "digest")))).alias("files"))  # a few files a bundle
    joined = details.join(maps, key, "left")
    return joined.select(key, F.to_json(F.struct(*sorted(joined.columns))).alias("entry"))


def manifest_faults(manifest: DataFrame, meta: DataFrame, columns: Sequence[str], key: str = "bundle_id") -> DataFrame:
    """(key, fault): where manifest and metadata disagree: a side is missing, or a named column differs (nulls agree with nulls)."""
    a = manifest.select(key, F.struct(*columns).alias("_a"))
    b = meta.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    rules = {"in_manifest": F.col("_a").isNotNull(), "in_metadata": F.col("_b").isNotNull()} | {c: F.col("_a").isNull() | F.col("_b").isNull() | F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in columns}
    return both.select(key, F.explode(violations(rules)).alias("fault"))


def missing_files(files: Column, required: Sequence[str] = REQUIRED_FILES) -> Column:
    """Which required files a bundle's list of names lacks."""
    return F.array_except(F.array(*map(F.lit, required)), files)


def range_overlaps(ranges: DataFrame, keys: Sequence[str], split: str, low: str, high: str) -> DataFrame:
    """(keys, a, b): splits whose closed ranges of a parameter meet. One row in for each parameter and split; none should come out."""
    side = lambda x: ranges.select(*keys, F.col(split).alias(x), F.col(low).alias(f"_{x}l"), F.col(high).alias(f"_{x}h"))
    return side("a").join(side("b"), list(keys)).where("a < b and _al <= _bh and _bl <= _ah").select(*keys, "a", "b")


def split_ranges(spark: SparkSession) -> DataFrame:
    """(parameter, split, low, high): the fixed ranges."""
    return spark.createDataFrame([(name, split, float(a), float(b)) for split, held in RANGES.items() for name, (a, b) in held.items()], "parameter string, split string, low double, high double")


def config_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, left, right): settings that differ or stand on one side only."""
    a = left.select(*keys, F.col(value).alias("left"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right"), F.lit(1).alias("_r"))
    return a.join(b, list(keys), "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left").eqNullSafe(F.col("right"))).select(*keys, "left", "right")


def with_receipts(lines: DataFrame, receipts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lines with their receipts; (keys, n_lines, n_receipts) where the counts differ). Both sides have keys and `line`; lines without a receipt keep nulls."""
    count = lambda x, name: x.groupBy(*keys).agg(F.count("*").alias(name))
    counts = count(lines, "n_lines").join(count(receipts, "n_receipts"), list(keys), "full_outer").na.fill(0, ["n_lines", "n_receipts"])
    return lines.join(receipts, [*keys, "line"], "left"), counts.where("n_lines <> n_receipts")


def window_cut(lines: DataFrame, unix_ns: Column, monotonic_ns: Column, end_unix: Column, end_monotonic: Column, text: Column) -> Column:
    """Why a line lies outside its observation window, null if inside: a receipt after either clock's end, or a time of its own after the end."""
    own = embedded_ns(text)
    return F.when(unix_ns.isNull() | monotonic_ns.isNull(), "no_receipt").when(unix_ns > end_unix, "after_end").when(monotonic_ns > end_monotonic, "after_monotonic_end").when(own > end_unix, "own_time_after_end")


def window_record_faults(require: bool = True) -> Column:
    """What breaks the rules of an observation window's record, by name. Columns: version, end_unix_ns, end_monotonic_ns, end_wall (text), scenario_wall
    (text), scenario_monotonic_ns, capture_digest, found_capture_digest, capture_frames, found_frames, last_frame_ns. See window_faults for log lines."""
    none = F.col("version").isNull() & F.col("end_unix_ns").isNull()
    wall, scenario = zoned_ns(F.col("end_wall")), zoned_ns(F.col("scenario_wall"))
    rules = {
        "version": F.col("version") == 1,
        "cutoff": (F.col("end_unix_ns") >= 0) & (F.col("end_monotonic_ns") >= 0),
        "wall_time": wall.isNotNull(),
        "clocks_disagree": F.coalesce(F.abs(wall - F.col("end_unix_ns")) <= 1000, F.lit(True)),
        "scenario_time": F.col("scenario_wall").isNull() | scenario.isNotNull(),
        "scenario_after_end": F.coalesce(scenario <= F.col("end_unix_ns"), F.lit(True)),
        "scenario_monotonic": F.coalesce(F.col("scenario_monotonic_ns").between(0, F.col("end_monotonic_ns")), F.col("scenario_monotonic_ns").isNull()),
        "capture_digest": F.col("capture_digest").eqNullSafe(F.col("found_capture_digest")),
        "capture_frames": F.col("capture_frames").eqNullSafe(F.col("found_frames")),
        "frame_after_end": F.coalesce(F.col("last_frame_ns") <= F.col("end_unix_ns"), F.lit(True)),
    }
    return F.when(none, F.array().cast("array<string>") if not require else F.array(F.lit("no_window"))).otherwise(violations(rules))


def log_snapshots(lines: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """(keys, line_count, digest): a log's lines in order, each with a line feed, as one digest. A null line is an empty one."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.coalesce(x[text], F.lit("")), F.lit("\n"))), "")
    return lines.groupBy(*keys).agg(F.count("*").alias("line_count"), F.sha2(whole.cast("binary"), 256).alias("digest"))


def accepted_bundles(meta: DataFrame, frames: DataFrame, key: str = "bundle_id") -> DataFrame:
    """meta with `reject_reasons`: its metadata's faults, and those of its capture's frames (key, frame, scan_error): numbers that repeat or are no
    numbers of frames, and a scan that ended in an error. Errors of single frames are no fault."""
    each = frames.groupBy(key, "frame").agg(F.count("*").alias("n"), F.max("scan_error").alias("e"))
    seen = each.groupBy(key).agg(F.max("n").alias("_most"), F.min(F.when(F.col("e").isNull(), F.col("frame"))).alias("_least"), F.first("e", ignorenulls=True).alias("_scan"))
    rules = {"duplicate_frame": F.coalesce(F.col("_most") <= 1, F.lit(True)), "frame_number": F.coalesce(F.col("_least") >= 1, F.lit(True)), "capture_error": F.col("_scan").isNull()}
    return meta.join(seen, key, "left").withColumn("reject_reasons", F.concat(metadata_faults(), violations(rules))).drop("_most", "_least", "_scan")


def volume_features(lines: DataFrame, frames: DataFrame, meta: DataFrame, view: str, key: str = "bundle_id") -> DataFrame:
    """(key, duration_seconds, frame_count, capture_bytes, and <source>_lines, <source>_bytes of each visible source): sizes only, no contents."""
    shown = VIEWS[view]
    per = visible(lines, view).groupBy(key).agg(*(x for s in shown for x in (F.count_if(F.col("source") == s).alias(f"{s}_lines"), F.coalesce(F.sum(F.when(F.col("source") == s, F.octet_length("text") + 1)), F.lit(0)).alias(f"{s}_bytes"))))
    caught = frames.groupBy(key).agg(F.count("*").alias("frame_count"), F.sum("captured_len").alias("capture_bytes"))
    return meta.select(key, ((F.col("ended_ns") - F.col("started_ns")) / 1e9).alias("duration_seconds")).join(per, key, "left").join(caught, key, "left").na.fill(0)


def with_defaults(found: DataFrame, names: Sequence[str], missing: str = "unavailable") -> DataFrame:
    """(name, value) for each name: what was found, or `missing`. names is a literal list, so its broadcast is bounded."""
    wanted = found.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return F.broadcast(wanted).join(found, "name", "left").select("name", F.coalesce("value", F.lit(missing)).alias("value"))


def run_plan(bundles: DataFrame, arms: Sequence[str], models: Sequence[str], plain: str = "rules") -> DataFrame:
    """bundles times arms times models; the plain arm runs once, without a model. A literal list is exploded, nothing is joined."""
    steps = [(a, None) if a == plain else (a, m) for a in arms for m in ([None] if a == plain else models)]
    return bundles.withColumn("_run", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(m).cast("string").alias("model")) for a, m in steps)))).select(*bundles.columns, "_run.arm", "_run.model")


def shared_budget(lines: DataFrame, key: str, budget: int, view: str) -> DataFrame:
    """(key, source, line, keep, total_lines, kept_lines, marker): whole numbered lines of each visible source that its share of a budget of characters
    keeps. keep is head, tail or none; marker, null if all fits, tells how many lines are left out.

    The shares differ by one character at most, the first sources having more. A source over its share gives 15 of 100 of what its heading and a marker
    leave to its first lines, the rest to its last ones."""
    shown = VIEWS[view]
    place = F.array_position(F.array(*map(F.lit, shown)), F.col("source")) - 1
    share = F.lit(budget // len(shown)) + F.when(place < budget % len(shown), 1).otherwise(0)
    by = Window.partitionBy(key, "source")
    size = F.length(F.col("line").cast("string")) + 2 + F.length("text") + 1
    up, down = (by.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("line", F.desc("line")))
    d = visible(lines, view).where("source <> 'frame'").select(key, "source", "line", share.cast("int").alias("_share"), F.sum(size).over(up).alias("_up"), F.sum(size).over(down).alias("_down"), F.count("*").over(by).alias("total_lines"), F.sum(size).over(by).alias("_all"))
    heading = F.length("source") + 2
    room = F.greatest(F.col("_share") - heading - F.length(F.concat(F.lit("[... "), F.col("total_lines").cast("string"), F.lit(" lines omitted ...]\n"))), F.lit(0))
    head_room = F.floor(room * 15 / 100)
    whole = F.col("_all") + heading <= F.col("_share")
    keep = F.when(whole | (F.col("_up") <= head_room), "head").when(F.col("_down") <= room - head_room, "tail").otherwise("none")
    out = d.withColumn("keep", keep).withColumn("kept_lines", F.count_if(F.col("keep") != "none").over(by))
    marker = F.when(F.col("kept_lines") < F.col("total_lines"), F.concat(F.lit("[... "), (F.col("total_lines") - F.col("kept_lines")).cast("string"), F.lit(" lines omitted ...]")))
    return out.select(key, "source", "line", "keep", "total_lines", "kept_lines", marker.alias("marker"))


def diagnosis_faults(diagnosis: Column, sources: Sequence[str] = ("frame", *SOURCES)) -> Column:
    """What breaks the rules of a diagnosis: struct(root_cause, evidence: array of struct(source, ref, quote), confidence, fix), or null where it could not be read."""
    evidence = diagnosis["evidence"]
    each = lambda ok: F.forall(F.coalesce(evidence, F.array()), lambda x: F.coalesce(ok(x), F.lit(False)))
    rules = {
        "root_cause": diagnosis["root_cause"].isin(*CLASSES, "unknown"),
        "evidence_count": F.size(evidence).between(1, 6),
        "source": each(lambda x: x["source"].isin(*sources)),
        "ref": each(lambda x: x["ref"] >= 1),
        "quote": each(lambda x: F.length(x["quote"]).between(1, 2000)),
        "confidence": diagnosis["confidence"].between(0, 1) & ~F.isnan(diagnosis["confidence"]),
        "fix": F.length(diagnosis["fix"]) <= 300,
    }
    return F.when(diagnosis.isNull(), F.array(F.lit("unreadable"))).otherwise(violations(rules))


def model_faults(models: DataFrame) -> DataFrame:
    """(name, fault): models whose names repeat, whose address is no plain http(s) one, or whose sizes make no sense (name, base_url, context_length, max_tokens)."""
    twice = F.count("*").over(Window.partitionBy("name"))
    plain = F.col("base_url").rlike(r"^https?://[^/?#@\s]+(/[^?#\s]*)?$")
    rules = {"name": F.coalesce(F.trim("name"), F.lit("")) != "", "unique": F.col("_n") == 1, "base_url": plain, "context_length": F.col("context_length") > 0, "max_tokens": (F.col("max_tokens") > 0) & (F.col("max_tokens") < F.col("context_length"))}
    return models.withColumn("_n", twice).select("name", F.explode(violations(rules)).alias("fault"))


def freeze(rows: DataFrame, path: str) -> None:
    """Writes a record that must not exist yet."""
    rows.write.mode("errorifexists").json(path)


def append_trace(rows: DataFrame, path: str) -> None:
    """Adds rows to a trace; their members stand in sorted order, nulls too."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_by_bundle(rows: DataFrame, path: str, key: str = "bundle_id") -> None:
    """JSON lines, a folder for each bundle."""
    rows.write.partitionBy(key).json(path)


def audit_sample(rows: DataFrame, strata: Sequence[str], ids: Sequence[str], most: int, seed: int) -> DataFrame:
    """At most `most` rows of each stratum, drawn by a seeded hash of the ids: the same rows whatever the partitions."""
    by = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids)).cast("binary"), 256), *ids)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def write_audit(rows: DataFrame, path: str) -> None:
    """The sample as CSV with a header."""
    rows.write.option("header", True).csv(path)


def pairing_faults(rows: DataFrame, group: str, key: str, label: str) -> DataFrame:
    """(key, fault): rows that keep groups from being compared: a key that some group lacks, has twice, or labels otherwise."""
    n_groups = rows.agg(F.countDistinct(group)).first()[0]
    each = rows.groupBy(key).agg(F.countDistinct(group).alias("_g"), F.count("*").alias("_n"), F.countDistinct(F.coalesce(F.col(label).cast("string"), F.lit("\0"))).alias("_l"))
    return each.select(key, F.explode(violations({"missing_in_group": F.col("_g") == n_groups, "repeated": F.col("_n") == F.col("_g"), "label_differs": F.col("_l") == 1})).alias("fault"))


def paired_differences(rows: DataFrame, group: str, key: str, label: str, prediction: str) -> DataFrame:
    """(left, right, key, difference): for every two groups and each key that both label alike, right or wrong (1, 0) of the one less that of the other."""
    side = lambda x: rows.select(F.col(group).alias(x), key, F.col(label).alias(f"_{x}_label"), (F.col(label) == F.col(prediction)).cast("int").alias(f"_{x}"))
    both = side("left").join(side("right"), key).where("left < right and _left_label <=> _right_label")
    return both.select("left", "right", key, (F.col("_left") - F.col("_right")).alias("difference"))


def paired_groups(rows: DataFrame, group: str, key: str, label: str, prediction: str) -> DataFrame:
    """(left, right, n, difference, only_left, only_right) of every two groups: a partial sum for each pair of groups, after one join on the key.

    Only keys that both groups label alike count; pairing_faults lists the others."""
    d = F.col("difference")
    both = paired_differences(rows, group, key, label, prediction)
    return both.groupBy("left", "right").agg(F.count("*").alias("n"), F.avg(d).alias("difference"), F.count_if(d > 0).alias("only_left"), F.count_if(d < 0).alias("only_right"))


def dense_confusion(rows: DataFrame, label: str, prediction: str, labels: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """A row for each label and a column of counts for each prediction, zeros and all. Both are literal lists."""
    counts = rows.groupBy(F.col(label).alias("label")).pivot(prediction, list(predictions)).count()
    wanted = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return F.broadcast(wanted).join(counts, "label", "left").na.fill(0)
