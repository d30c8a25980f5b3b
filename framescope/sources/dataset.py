"""A dataset on disk as tables: a folder for each bundle with its metadata, capture and logs. What can't be used is a row with reasons, not an error.

Metadata is read as VARIANT and taken apart by the engine, so a document of any shape is a row; types are checked as they stand, and members of other names
are faults. Captures are decoded frame by frame, logs are numbered lines; each kind of file is read once, side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators.bundles import REQUIRED_FILES, SOURCES, accepted_bundles, model_faults, window_cut, window_record_faults, zoned_ns
from framescope.operators.frames import decode_frames
from framescope.operators.integrity import violations
from framescope.operators.sequences import lines_of
from framescope.sources.bundle_files import LISTING_SCHEMA, list_files, read_listed
from framescope.sources.pcap import packets_of

#: Members of a bundle's metadata: what must be there, what may be, and of which kind (fixed values).
REQUIRED = {"label": "STRING", "seed": "BIGINT", "split": "STRING", "parameters": "OBJECT", "kernel": "STRING", "tool_versions": "OBJECT", "started_at": "STRING", "ended_at": "STRING", "status": "STRING", "generator_commit": "STRING"}
OPTIONAL = {
    "error": "STRING", "commands": "ARRAY", "injection_verified": "BOOLEAN", "verification": "ARRAY", "capture_health": "OBJECT", "quarantined": "BOOLEAN", "quarantine_reasons": "ARRAY", "log_scrub": "OBJECT", "dhcp_server_started": "BOOLEAN",
    "scenario_started_at": "STRING", "scenario_started_monotonic_ns": "BIGINT", "observation_end": "OBJECT", "observation_window": "OBJECT", "observed": "OBJECT",
}
#: Members that may be null, and those of an observed outcome (fixed values).
NULLABLE = ("error", "dhcp_server_started", "scenario_started_at", "scenario_started_monotonic_ns", "observation_end", "observation_window", "observed")
OBSERVED = {"wpa_state": "STRING", "ipv4_lease_present": "BOOLEAN", "ap_associated": "BOOLEAN", "ap_authorized": "BOOLEAN"}
#: Lines of these logs that echo a control command are scrubbed before a log is shown (fixed values).
SCRUBBED, CONTROL_LINE = ("hostapd", "wpa_supplicant"), "(?i)ctrl_iface"
#: What a model's entry says, and what holds where it says nothing (fixed values).
MODEL = "name string, base_url string, model string, supports_tools boolean, rpm double, max_tokens bigint, context_length bigint, timeout double, retries bigint, input_price_inr_per_million double, output_price_inr_per_million double, cached_input_price_inr_per_million double"
MODEL_DEFAULTS = {"supports_tools": False, "rpm": 30.0, "max_tokens": 4096, "context_length": 131072, "timeout": 60.0, "retries": 2}


@dataclass
class Dataset:
    """bundles: metadata of all bundles, with reject_reasons (empty: accepted). frames: decoded, by bundle_id. lines: numbered, by bundle_id and source.
    faults: (bundle_id, fault) of all that a bundle is rejected for."""

    bundles: DataFrame
    frames: DataFrame
    lines: DataFrame
    faults: DataFrame


def _place(path: Column, k: int) -> Column:
    """The k-th part of a path from its end."""
    return F.element_at(F.split(path, "/"), -k)


def _found(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Files of a name (a glob will do) that stand in a bundle below a folder, through Spark's own reader: for stores that only it knows. Its driver holds
    every file's path.

    The folder is listed as a whole, by tasks that each take many bundles; a path for each file would be looked up by the driver, and listed by a task of
    its own. Spark passes over names with a leading underscore or dot where it lists, so bundles of such names are listed by themselves."""
    if _depth(folder) is None:
        return spark.read.format("binaryFile").load(f"{folder}/*/{name}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name)
    roots = [folder]
    try:
        reader.load(f"{folder}/[_.]*")
        roots.append(f"{folder}/[_.]*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return reader.load(roots).where(_in_bundle(folder))


_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _depth(folder: str) -> int | None:
    """How many parts the paths of a folder have (a glob will do); None for a relative one, and for alternatives of unlike depth."""
    inside = re.sub(_STORE, "", folder)
    return len([x for x in inside.split("/") if x]) if inside.startswith("/") and not re.search(r"\{[^}]*/", inside) else None


def _in_bundle(folder: str) -> Column:
    """Whether a path is that of a file right in a bundle below a folder, and not deeper."""
    depth = _depth(folder)
    return F.lit(True) if depth is None else F.size(F.split(F.ltrim(F.regexp_replace("path", _STORE, ""), F.lit("/")), "/")) == depth + 2


def _files(spark: SparkSession, folder: str, listing: str | None, names: list[str]) -> DataFrame:
    """(bundle_id, file, content) of files of some names, but empty ones."""
    if listing is not None:
        return read_listed(spark, listing, names)
    return _found(spark, folder, f"{{{','.join(names)}}}").select(_place(F.col("path"), 2).alias("bundle_id"), _place(F.col("path"), 1).alias("file"), "content")


def _captures(spark: SparkSession, folder: str, listing: str | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(packets with the bundle as path; (bundle_id, digest)) of captures, but empty ones."""
    names = ["capture.pcap"]
    if listing is not None:
        return read_listed(spark, listing, names, "packets", most), read_listed(spark, listing, names, "digest").select("bundle_id", "digest")
    whole = _files(spark, folder, None, names)
    return packets_of(whole.select(F.col("bundle_id").alias("path"), "content"), most=most), whole.select("bundle_id", F.sha2("content", 256).alias("digest"))


def _names(spark: SparkSession, folder: str, listing: str | None) -> DataFrame:
    """(bundle_id, file) of all files, empty ones too."""
    if listing is not None:
        return spark.read.schema(LISTING_SCHEMA).parquet(listing).select("bundle_id", "file")
    # names of files come from Spark's listing, which has the empty ones too
    listed = spark.createDataFrame(pa.table({"path": pa.array(_found(spark, folder, "*").inputFiles(), pa.string())}))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # these are URLs, where the reader's own column has plain paths
    return listed.where(_in_bundle(folder)).select(_place(path, 2).alias("bundle_id"), _place(path, 1).alias("file"))


def _text(content: str) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def _kind(document: Column, member: str) -> Column:
    """What a member is: STRING, BIGINT, BOOLEAN, OBJECT, ARRAY, VOID (null) and others; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(document, f"$.{member}", "variant")), r"^(\w+)", 1)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each bundle's metadata, with what its rules need, and document_faults: what is wrong with the document itself."""
    return _metadata(_files(spark, folder, list_files(spark, folder), ["meta.json"]))


def _metadata(files: DataFrame) -> DataFrame:
    v = F.col("v")
    said = files.select("bundle_id", _text("content").alias("text")).withColumn("v", F.try_parse_json("text"))
    get = lambda member, kind="string": F.try_variant_get(v, f"$.{member}", kind)
    right = {f"member_{m}": _kind(v, m) == k for m, k in REQUIRED.items()}
    for m, k in OPTIONAL.items():
        none = _kind(v, m).isNull() | (_kind(v, m).isin("", "VOID") if m in NULLABLE else _kind(v, m) == "")
        right[f"member_{m}"] = none | (_kind(v, m) == k)
    for m, k in OBSERVED.items():
        right[f"observed_{m}"] = F.coalesce(_kind(v, f"observed.{m}"), F.lit("")).isin("", "VOID", k)
    names = F.array(*map(F.lit, [*REQUIRED, *OPTIONAL]))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    faults = F.when(~is_object, F.array(F.lit("no_document"))).otherwise(
        violations(right | {"other_members": F.size(F.array_except(F.json_object_keys("text"), names)) == 0, "split": get("split").isin("dev", "test"), "status": get("status").isin("ok", "failed"), "scenario_time": get("scenario_started_at").isNull() | zoned_ns(get("scenario_started_at")).isNotNull()})
    )
    passed = F.expr("transform(try_variant_get(v, '$.verification', 'array<variant>'), x -> coalesce(schema_of_variant(try_variant_get(x, '$.passed', 'variant')) = 'BOOLEAN' AND try_variant_get(x, '$.passed', 'boolean'), false))")
    health, beacons = _kind(v, "capture_health"), _kind(v, "capture_health.ap_beacons")
    return said.select(
        "bundle_id", get("label").alias("label"), get("seed", "bigint").alias("seed"), get("split").alias("split"), F.to_json(get("parameters", "variant")).alias("parameters"), get("generator_commit").alias("generator_commit"),
        zoned_ns(get("started_at")).alias("started_ns"), zoned_ns(get("ended_at")).alias("ended_ns"), get("status").alias("status"), get("error").alias("error"), F.coalesce(get("injection_verified", "boolean"), F.lit(False)).alias("injection_verified"),
        passed.alias("checks_passed"), F.when(health.isNull() | (health == ""), False).when(_kind(v, "capture_health.healthy") == "BOOLEAN", get("capture_health.healthy", "boolean")).alias("healthy"),
        F.when(beacons.isNull() | (beacons == ""), 0).when(beacons == "BIGINT", get("capture_health.ap_beacons", "bigint")).otherwise(-1).alias("ap_beacons"),
        F.struct(*(get(f"observed.{m}", "string" if k == "STRING" else "boolean").alias(m) for m, k in OBSERVED.items())).alias("observed"),
        get("observation_window.version", "int").alias("version"), get("observation_end.unix_ns", "bigint").alias("end_unix_ns"), get("observation_end.monotonic_ns", "bigint").alias("end_monotonic_ns"), get("observation_end.wall_time").alias("end_wall"),
        get("scenario_started_at").alias("scenario_wall"), get("scenario_started_monotonic_ns", "bigint").alias("scenario_monotonic_ns"), get("observation_window.capture.sha256").alias("capture_digest"), get("observation_window.capture.frames", "bigint").alias("capture_frames"),
        F.array(*(F.struct(F.lit(s).alias("source"), get(f"observation_window.logs.{s}.sha256").alias("digest"), get(f"observation_window.logs.{s}.line_count", "bigint").alias("line_count"), F.expr(f"try_variant_get(v, '$.observation_window.logs.{s}.lines', 'array<struct<unix_ns: bigint, monotonic_ns: bigint>>')").alias("receipts")) for s in SOURCES)).alias("logs"),
        faults.alias("document_faults"),
    )


def log_window_faults(meta: DataFrame, logs: DataFrame, lines: DataFrame) -> DataFrame:
    """(bundle_id, fault): logs that are not what the observation window recorded: another digest or number of lines, receipts missing, after the end or out of
    order, a line's own time after the end, an echo of a control command.

    meta: as read_metadata gives it (logs, end_unix_ns, end_monotonic_ns). logs: bundle_id, source, digest. lines: bundle_id, source, line, text."""
    told = meta.select("bundle_id", "end_unix_ns", "end_monotonic_ns", F.inline("logs"))
    counts = lines.groupBy("bundle_id", "source").agg(F.count("*").alias("found_lines"))
    whole = told.join(logs.withColumnRenamed("digest", "found_digest"), ["bundle_id", "source"], "left").join(counts, ["bundle_id", "source"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)  # an empty log is a file without rows
    n = F.coalesce("found_lines", F.lit(0))
    marked = whole.select("bundle_id", violations({"log_digest": F.col("digest") == F.coalesce("found_digest", nothing), "log_receipts": (F.col("line_count") == n) & (F.coalesce(F.size("receipts"), F.lit(-1)) == n)}).alias("f"))
    marks = told.select("bundle_id", "source", "end_unix_ns", "end_monotonic_ns", F.posexplode("receipts").alias("at", "mark"), F.col("receipts").alias("_all"))
    before = F.get("_all", F.col("at") - 1)["monotonic_ns"]
    each = marks.select("bundle_id", "source", (F.col("at") + 1).alias("line"), "mark.unix_ns", "mark.monotonic_ns", "end_unix_ns", "end_monotonic_ns", before.alias("before")).join(lines, ["bundle_id", "source", "line"])
    cut = window_cut(each, F.col("unix_ns"), F.col("monotonic_ns"), F.col("end_unix_ns"), F.col("end_monotonic_ns"), F.col("text"))
    echo = F.col("source").isin(*SCRUBBED) & F.col("text").rlike(CONTROL_LINE)
    lined = each.select("bundle_id", violations({"log_after_end": cut.isNull() & (F.least("unix_ns", "monotonic_ns") >= 0), "log_order": F.coalesce(F.col("monotonic_ns") >= F.col("before"), F.lit(True)), "log_echo": ~F.coalesce(echo, F.lit(False))}).alias("f"))
    return marked.unionByName(lined).select("bundle_id", F.explode("f").alias("fault")).distinct()


def read_dataset(spark: SparkSession, folder: str, require_window: bool = True, most: int = 1 << 20) -> Dataset:
    """All bundles below a folder (a glob will do). A bundle is rejected for faults of its metadata, files that it lacks, a capture whose scan ended in an
    error or whose frames repeat, and a window or log that is not what was recorded; errors of single frames are no fault."""
    folder = folder.rstrip("/")
    listing = list_files(spark, folder)
    meta = _metadata(_files(spark, folder, listing, ["meta.json"]))
    packets, digests = _captures(spark, folder, listing, most)
    frames = decode_frames(packets).withColumnRenamed("path", "bundle_id")
    logs = _files(spark, folder, listing, [f"{s}.log" for s in SOURCES]).withColumn("source", F.regexp_replace("file", r"\.log$", ""))
    lines = lines_of(logs.select("bundle_id", "source", _text("content").alias("t")), ["bundle_id", "source"], "t").withColumnRenamed("content", "text")
    there = _names(spark, folder, listing).groupBy("bundle_id").agg(F.collect_set("file").alias("files"))
    seen = packets.where("frame > 0").groupBy(F.col("path").alias("bundle_id")).agg(F.count("*").alias("found_frames"), F.max("ts_ns").alias("last_frame_ns"))
    judged = accepted_bundles(meta, packets.select(F.col("path").alias("bundle_id"), "frame", "scan_error"))
    joined = there.join(judged, "bundle_id", "left").join(seen, "bundle_id", "left").join(digests.withColumnRenamed("digest", "found_capture_digest"), "bundle_id", "left").na.fill(0, ["found_frames"])
    lacks = F.array_except(F.array(*map(F.lit, REQUIRED_FILES)), F.col("files"))
    lacking = F.transform(lacks, lambda f: F.concat(F.lit("missing_"), f))
    own = F.when(F.col("document_faults").isNull(), F.array(F.lit("no_document"))).when(F.array_contains("document_faults", "no_document"), F.col("document_faults")).otherwise(F.array_distinct(F.concat("document_faults", "reject_reasons", window_record_faults(require_window))))
    faults = joined.select("bundle_id", F.explode(F.concat(lacking, own)).alias("fault"))
    windowed = meta.where("version is not null or end_unix_ns is not null")
    faults = faults.unionByName(log_window_faults(windowed, logs.select("bundle_id", "source", F.sha2("content", 256).alias("digest")), lines)).distinct()
    reasons = faults.groupBy("bundle_id").agg(F.array_sort(F.collect_set("fault")).alias("reject_reasons"))  # a few names
    bundles = there.select("bundle_id").join(meta, "bundle_id", "left").join(reasons, "bundle_id", "left").withColumn("reject_reasons", F.coalesce("reject_reasons", F.array().cast("array<string>")))
    return Dataset(bundles, frames, lines, faults)


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, (name, fault)) of a model file: a list of entries, or an object with a list `models`. Members of other names don't count."""
    v = F.try_parse_json(_text("content"))
    held = F.coalesce(F.try_variant_get(v, "$.models", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    entries = spark.read.format("binaryFile").load(path).select(F.explode(held).alias("e"))
    get = lambda c, kind: F.try_variant_get("e", f"$.{c}", kind)
    models = entries.select(*(F.coalesce(get(c, kind), F.lit(MODEL_DEFAULTS.get(c)).cast(kind)).alias(c) for c, kind in (x.split() for x in MODEL.split(", "))))
    more = violations({"model": F.coalesce("model", F.lit("")) != "", "rpm": F.col("rpm") > 0, "timeout": F.col("timeout") > 0, "retries": F.col("retries").between(0, 5), "price": F.forall(F.array(*(c.split()[0] for c in MODEL.split(", ") if "price" in c)), lambda x: x.isNull() | ((x >= 0) & (x < float("inf"))))})
    return models, model_faults(models).unionByName(models.select("name", F.explode(more).alias("fault")))
