"""What a run showed: management directions, first events, code sets, capture health, station listings, recorded outcomes, first evidence.

Bundles are a small dimension beside frames and log lines; all meet by equality of `bundle_id`, and every result is a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.texts import assigned_ipv4, fitting_member
from framescope.operators.summaries import quantiles

BROADCAST = "ff:ff:ff:ff:ff:ff"
#: Directions and kinds of events in results (fixed values).
DIRECTIONS = ("ap_to_station", "station_to_ap", "ap_to_broadcast", "other")
EVENTS = ("auth", "assoc", "eapol", "dhcp")
#: Log lines that tell of the address protocol, of an address obtained, and of a code; a line that is an address alone (fixed values).
DHCP_EVENT = r"(?i)\b(?:DHCP(?:DISCOVER|OFFER|REQUEST|ACK|NAK|DECLINE|RELEASE|INFORM)|(?:sending|broadcasting) (?:discover|select|request)|lease of|bound to)\b"
LEASE = r"(?i)\b(?:bound to\s+\d+\.\d+\.\d+\.\d+|lease of\s+\d+\.\d+\.\d+\.\d+.*obtained)"
CODE_LINE = r"(?i)\b(?:status|reason)(?:_code)?[= :]+\d+"
ADDRESS_LINE = r"^[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}$"
#: What a run's last queries tell (fixed values).
OUTCOME_FIELDS = ("wpa_state", "ipv4_lease_present", "ap_associated", "ap_authorized")


def reason_direction(addrs: Column, ap: Column, station: Column) -> Column:
    """Who sent a management frame to whom, from its receiver and transmitter; 'other' where a peer is unknown or not of the pair."""
    receiver, sender, ap, station = (F.lower(c) for c in (F.get(addrs, F.lit(0)), F.get(addrs, F.lit(1)), ap, station))
    known = (ap != "") & (station != "")
    named = F.when((sender == ap) & (receiver == station), DIRECTIONS[0]).when((sender == station) & (receiver == ap), DIRECTIONS[1]).when((sender == ap) & (receiver == BROADCAST), DIRECTIONS[2])
    return F.coalesce(F.when(known, named), F.lit(DIRECTIONS[3]))


def frame_event(type_id: Column, subtype_id: Column, message: Column) -> Column:
    """auth, assoc or eapol (one of the four key messages); null for other frames."""
    return F.when((type_id == 0) & (subtype_id == 11), "auth").when((type_id == 0) & subtype_id.isin(0, 1, 2, 3), "assoc").when(message.isin(1, 2, 3, 4), "eapol")


def first_run_events(frames: DataFrame, lines: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle_id, event, elapsed): seconds from a run's start to its first event of each kind.

    frames: bundle_id, ts_ns, addrs, type_id, subtype_id, eapol_msg; only those between access point and station count, from the start on. lines:
    bundle_id, source, text, monotonic_ns (receipt); only the address client's. bundles: bundle_id, ap_mac, station_mac, started_ns,
    started_monotonic_ns; without a start there are no events.
    """
    seen = frames.select("bundle_id", "ts_ns", "addrs", frame_event(F.col("type_id"), F.col("subtype_id"), F.col("eapol_msg")).alias("event")).where("event is not null")
    seen = seen.join(bundles.select("bundle_id", "ap_mac", "station_mac", F.col("started_ns").alias("_start")), "bundle_id")
    seen = seen.where(reason_direction(F.col("addrs"), F.col("ap_mac"), F.col("station_mac")).isin(*DIRECTIONS[:2])).select("bundle_id", "event", (F.col("ts_ns") - F.col("_start")).alias("_ns"))
    told = lines.where((F.col("source") == "dhcp_client") & F.col("text").rlike(DHCP_EVENT)).select("bundle_id", "monotonic_ns")
    told = told.join(bundles.select("bundle_id", F.col("started_monotonic_ns").alias("_start")), "bundle_id").select("bundle_id", F.lit("dhcp").alias("event"), (F.col("monotonic_ns") - F.col("_start")).alias("_ns"))
    return seen.unionByName(told).where("_ns >= 0").groupBy("bundle_id", "event").agg((F.min("_ns") / 1e9).alias("elapsed"))


def run_event_summary(firsts: DataFrame, bundles: DataFrame) -> DataFrame:
    """Per label and kind of event: n events, runs whose clock was recorded, least, median and greatest elapsed time. Kinds that never came have n 0.

    bundles: bundle_id, label, capture_clock, log_clock (booleans)."""
    kinds = bundles.select("bundle_id", "label", F.explode(F.array(*(F.struct(F.lit(e).alias("event"), F.col("log_clock" if e == "dhcp" else "capture_clock").alias("clock")) for e in EVENTS))).alias("k"))
    rows = kinds.select("bundle_id", "label", "k.event", "k.clock").join(firsts, ["bundle_id", "event"], "left")
    more = F.count_if("clock").alias("available"), F.min("elapsed").alias("least"), F.max("elapsed").alias("greatest")
    return quantiles(rows, ["label", "event"], "elapsed", {"median": 0.5}, *more).select("label", "event", "n", "available", "least", "median", "greatest")


def code_sets(frames: DataFrame, bundles: DataFrame) -> DataFrame:
    """Per bundle with frames: sorted distinct status and reason codes, and the reason codes of each direction."""
    rows = frames.select("bundle_id", "addrs", "status_code", "reason_code").where("status_code is not null or reason_code is not null")
    rows = rows.join(bundles.select("bundle_id", "ap_mac", "station_mac"), "bundle_id", "left").withColumn("_d", reason_direction(F.col("addrs"), F.col("ap_mac"), F.col("station_mac")))
    sets = [F.array_sort(F.collect_set("status_code")).alias("status_codes"), F.array_sort(F.collect_set("reason_code")).alias("reason_codes")]
    by = [F.array_sort(F.collect_set(F.when(F.col("_d") == d, F.col("reason_code")))).alias(f"{d}_reasons") for d in DIRECTIONS]
    return rows.groupBy("bundle_id").agg(*sets, *by)


def lease_logged(lines: DataFrame) -> DataFrame:
    """(bundle_id, lease_logged): whether the address client's log tells of an address obtained."""
    return lines.where(F.col("source") == "dhcp_client").groupBy("bundle_id").agg(F.coalesce(F.bool_or(F.col("text").rlike(LEASE)), F.lit(False)).alias("lease_logged"))


def code_lines(lines: DataFrame) -> DataFrame:
    """Log lines that state a status or reason code."""
    return lines.where(F.col("text").rlike(CODE_LINE))


def capture_health(bundles: DataFrame, frames: DataFrame) -> DataFrame:
    """(bundle_id, healthy, ap_beacons, error): a capture is healthy if it can be read and holds a beacon of its access point.

    bundles: bundle_id, ap_mac, capture_bytes (null: no file), scan_error (null: read to its end).
    """
    beacons = frames.where("type_id = 0 and subtype_id = 8").groupBy("bundle_id", F.lower("bssid").alias("ap_mac")).agg(F.count("*").alias("n"))
    rows = bundles.withColumn("ap_mac", F.lower("ap_mac")).join(beacons, ["bundle_id", "ap_mac"], "left").withColumn("ap_beacons", F.coalesce("n", F.lit(0)))
    error = F.when(F.coalesce("capture_bytes", F.lit(0)) == 0, "capture missing or empty").when(F.col("scan_error").isNotNull(), F.concat(F.lit("capture parser error: "), "scan_error")).when(F.col("ap_beacons") == 0, "no beacon from the configured AP")
    return rows.select("bundle_id", error.isNull().alias("healthy"), "ap_beacons", error.alias("error"))


def station_flags(lines: DataFrame, stations: DataFrame) -> DataFrame:
    """(bundle_id, associated, authorized, error) of one station in its access point's listing.

    lines: bundle_id, line, text: a line with an address begins a record, whose `flags=` line may follow. stations: bundle_id, station_mac. A
    listing without the station means neither; text without any record, or a record without flags, is an error.
    """
    text = F.trim("text")
    marked = lines.select("bundle_id", "line", F.when(text.rlike(ADDRESS_LINE), F.lower(text)).alias("_head"), F.when(text.startswith("flags="), text).alias("_flags"), (text != "").alias("_filled"))
    so_far = Window.partitionBy("bundle_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("_of", F.last("_head", ignorenulls=True).over(so_far))
    listing = owned.groupBy("bundle_id").agg(F.bool_or("_filled").alias("_filled"), F.count("_head").alias("_records"))
    records = owned.where("_of is not null and (_head is not null or _flags is not null)").groupBy("bundle_id", "_of").agg(F.max_by("_flags", "line").alias("_flags"), F.lit(True).alias("_listed"))
    rows = stations.select("bundle_id", F.lower("station_mac").alias("_of")).join(listing, "bundle_id", "left").join(records, ["bundle_id", "_of"], "left")
    error = F.when(F.col("_listed") & F.col("_flags").isNull(), "target station record is missing flags").when(F.col("_listed").isNull() & F.col("_filled") & (F.col("_records") == 0), "AP listing contains no parseable station records")
    has = lambda flag: F.when(error.isNull(), F.coalesce(F.contains("_flags", F.lit(f"[{flag}]")), F.lit(False)))
    return rows.select("bundle_id", has("ASSOC").alias("associated"), has("AUTHORIZED").alias("authorized"), error.alias("error"))


#: What is said of an interface's answer that can't be read (fixed values).
NO_INTERFACE, NO_ADDRESSES, BAD_ADDRESS = "IPv4 query did not return the station interface", "IPv4 query is missing addr_info", "malformed station address record"


def interface_lease(answer: Column, interface: str = "wlan1") -> Column:
    """struct(ipv4_lease_present, error) of what an interface's addresses were told to be: JSON, a list of the one interface with its addr_info. A lease is an
    IPv4 address that is neither loopback nor unspecified; present is null where there is an error. A null answer tells nothing."""
    document = F.try_parse_json(answer)
    only = F.when(F.size(F.try_variant_get(document, "$", "array<variant>")) == 1, F.try_variant_get(document, "$[0]", "variant"))
    named = F.coalesce(F.try_variant_get(only, "$.ifname", "string") == interface, F.lit(False))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(only, "$.addr_info", "variant")).startswith("ARRAY"), F.lit(False))
    addresses = F.coalesce(F.try_variant_get(only, "$.addr_info", "array<variant>"), F.array().cast("array<variant>"))
    records = F.forall(addresses, lambda a: F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False)))
    four = F.transform(F.filter(addresses, lambda a: F.try_variant_get(a, "$.family", "string") == "inet"), lambda a: assigned_ipv4(F.try_variant_get(a, "$.local", "string")))
    error = F.when(answer.isNotNull(), F.when(~named, NO_INTERFACE).when(~listed, NO_ADDRESSES).when(~records | F.exists(four, lambda x: x.isNull()), BAD_ADDRESS))
    return F.struct(F.when(answer.isNotNull() & error.isNull(), F.exists(four, lambda x: F.coalesce(x, F.lit(False)))).alias("ipv4_lease_present"), error.alias("error"))


def outcome_distributions(runs: DataFrame) -> DataFrame:
    """(label, field, value, n): how often each outcome field had each value; nulls are 'unknown'. runs: label and OUTCOME_FIELDS."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in OUTCOME_FIELDS))
    return runs.select("label", F.explode(fields).alias("f")).groupBy("label", "f.field", "f.value").agg(F.count("*").alias("n"))


def outcome_mismatches(runs: DataFrame) -> DataFrame:
    """Per label, and of all (label null, is_total): runs, and how many ended otherwise than their label says, or unknown. None is left out for it."""
    done, leased = F.col("wpa_state") == "COMPLETED", F.col("ipv4_lease_present")
    return runs.rollup("label").agg(
        F.count("*").alias("runs"),
        F.count_if((F.col("label") != "ok") & done & leased).alias("failure_completed_with_lease"),
        F.count_if((F.col("label") == "ok") & (F.coalesce(~done, F.lit(False)) | F.coalesce(~leased, F.lit(False)))).alias("ok_missing_completed_or_lease"),
        F.count_if(F.col("wpa_state").isNull() | leased.isNull()).alias("outcome_unknown"),
        (F.grouping("label") == 1).alias("is_total"),
    )


def acknowledged_after(df: DataFrame, keys: Sequence[str], order: str, before: Column, then: Column) -> DataFrame:
    """(keys, acknowledged): whether some `before` row comes no later than the first `then` row."""
    found = df.groupBy(*keys).agg(F.min(F.when(before, F.col(order))).alias("_b"), F.min(F.when(then, F.col(order))).alias("_t"))
    return found.select(*keys, F.coalesce(F.col("_b") <= F.col("_t"), F.lit(False)).alias("acknowledged"))


def first_evidence(lines: DataFrame, frames: DataFrame, sources: Sequence[str], least: int = 12, most: int = 2000) -> DataFrame:
    """(bundle_id, source, ref, quote): what an undecided answer cites: the first log line, by source and number, of `least` non-blank characters
    in its first `most`; else the first frame, or of a longer one its first sorted top-level
    member that fits; a frame without one is passed over. lines: bundle_id, source, line, text; frames: bundle_id, frame, json."""
    rank = F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("source"))
    quote = F.substring("text", 1, most)
    some = lines.where(F.col("source").isin(list(sources)) & (F.length(F.regexp_replace(quote, r"\s", "")) >= least))
    told = some.select("bundle_id", rank.alias("_rank"), "source", F.col("line").cast("long").alias("ref"), quote.alias("quote"))
    long = F.length("json") > most
    cut = frames.withColumn("_quote", F.coalesce(fitting_member(F.when(long, F.col("json")), most), F.when(~long, F.col("json")))).where("_quote is not null")
    shown = cut.select("bundle_id", F.lit(len(sources) + 1).cast("long").alias("_rank"), F.lit("frame").alias("source"), F.col("frame").cast("long").alias("ref"), F.col("_quote").alias("quote"))
    best = told.unionByName(shown).groupBy("bundle_id").agg(F.min_by(F.struct("source", "ref", "quote"), F.struct("_rank", "ref")).alias("b"))
    return best.select("bundle_id", "b.*")
