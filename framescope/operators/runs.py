"""Runs over bundles: rules in order, first messages, prompts with their digests, verification per class, probe rows with exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.texts import config_values
from framescope.operators.integrity import violations
from framescope.operators.relations import first_reason


class Rules:
    """Named conditions, tried in the order in which they were added; the first that holds gives the diagnosis. An empty registry knows nothing."""

    def __init__(self) -> None:
        self._rules: list[tuple[str, Column]] = []

    def add(self, diagnosis: str, condition: Column) -> Rules:
        self._rules.append((diagnosis, condition))
        return self

    def diagnosis(self, otherwise: str = "unknown") -> Column:
        return F.coalesce(first_reason(self._rules), F.lit(otherwise))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, digest) of each instruction file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("digest"))


def first_messages(kept: DataFrame, summary: DataFrame, key: str, instruction: str, total: str = "total_lines") -> DataFrame:
    """(key, message): the instruction, the capture's summary, and every source's kept lines under its name, with the marker where lines are left out.

    kept: what bundles.shared_budget gives, joined with the lines' text; a bundle's message is bounded by the budget. Sources come in name order."""
    numbered = F.concat(F.col("line").cast("string"), F.lit(": "), F.col("text"))
    shown = kept.where("keep <> 'none'").groupBy(key, "source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep") == "head", F.struct("line", numbered.alias("s"))))), lambda x: x["s"]), "\n").alias("_head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep") == "tail", F.struct("line", numbered.alias("s"))))), lambda x: x["s"]), "\n").alias("_tail"),
        F.max("marker").alias("_marker"),
    )
    part = F.concat_ws("\n", F.concat("source", F.lit(":")), F.nullif("_head", F.lit("")), "_marker", F.nullif("_tail", F.lit("")))
    whole = shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", part.alias("p")))), lambda x: x["p"]), "\n").alias("_logs"))  # a few sources a bundle
    return summary.join(whole, key, "left").select(key, F.concat_ws("\n\n", F.lit(instruction), "summary", "_logs").alias("message"))


def verification_faults(checks: DataFrame, required: Mapping[str, Sequence[str]], key: str = "bundle_id") -> DataFrame:
    """(key, label, faults): what recorded checks (key, label, name, passed) lack: those that the label's class asks for must be there, and all must pass."""
    wanted = F.create_map(*(x for label, names in required.items() for x in (F.lit(label), F.array(*map(F.lit, names)).cast("array<string>"))))
    each = checks.groupBy(key, "label").agg(F.collect_set("name").alias("_names"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("_passed"))  # a few checks a bundle
    asked = F.coalesce(wanted[F.col("label")], F.array().cast("array<string>"))
    return each.select(key, "label", violations({"known_class": F.col("label").isin(*required), "checks_missing": F.size(F.array_except(asked, F.col("_names"))) == 0, "check_failed": F.col("_passed")}).alias("faults")).where(F.size("faults") > 0)


#: Frame protection that a station must have loaded, by class (fixed values).
EXPECTED_PROTECTION = {None: "1", "pmf_required_unsupported": "0"}


def injection_checks(label: Column, parameters: Column, replies: Column, ap_file: Column, station_file: Column, active: Column, launched: Column, steps: Column) -> Column:
    """array of struct(check, passed): what recorded answers and files of a bundle tell about whether its class was really set up.

    parameters: struct as draw_parameters gives it. replies: map of a query's name to struct(returncode, stdout). ap_file, station_file: the settings
    that the running processes were given. active, launched: log names of processes that run, and that were ever started. steps: array of struct(argv,
    returncode, stdout), in order. Every class has the checks of all; then come its own. What an answer does not hold did not pass."""
    said = lambda name: F.coalesce(F.when(replies[name]["returncode"] == 0, F.btrim(replies[name]["stdout"], F.lit(" \t\r\n\x0b\x0c"))), F.lit(""))
    unquoted = lambda c: F.btrim(c, F.lit('"'))
    ap, station, live = config_values(ap_file), config_values(F.regexp_replace(station_file, r"(?m)^[ \t]+", "")), config_values(said("ap_config"))
    p = parameters
    wanted = F.when(label == "ssid_not_found", p["absent_ssid"]).otherwise(p["ssid"])
    protection = F.when(label == "pmf_required_unsupported", EXPECTED_PROTECTION["pmf_required_unsupported"]).otherwise(EXPECTED_PROTECTION[None])
    place = lambda test: F.array_position(F.transform(steps, test), F.lit(True))
    done = place(lambda s: F.coalesce(F.array_contains(s["argv"], "status") & F.contains(s["stdout"], F.lit("wpa_state=COMPLETED")), F.lit(False)))
    acted = place(lambda s: F.coalesce(F.array_contains(s["argv"], "deauthenticate") & (s["returncode"] == 0) & F.contains(s["stdout"], F.lit("OK")), F.lit(False)))
    server = F.array_contains(active, "dhcp_server.log")
    always = {
        "daemon_processes_running": F.size(F.array_except(F.array(F.lit("hostapd.log"), F.lit("wpa_supplicant.log")), active)) == 0,
        "ap_enabled": F.contains(said("ap_status"), F.lit("state=ENABLED")),
        "ap_ssid_loaded": live["ssid"] == p["ssid"],
        "station_ssid_loaded": unquoted(said("station_ssid")) == wanted,
        "station_pmf_loaded": said("station_pmf") == protection,
        "station_control_ready": F.contains(said("station_status"), F.lit("wpa_state=")),
    }
    own = {
        "wrong_passphrase": {"different_passphrase_in_consumed_config": (unquoted(station["psk"]) == p["wrong_passphrase"]) & (ap["wpa_passphrase"] == p["passphrase"]) & (p["passphrase"] != p["wrong_passphrase"])},
        "akm_mismatch": {"incompatible_akm_loaded": (F.trim(live["key_mgmt"]) == "SAE") & (station["key_mgmt"] == "WPA-PSK")},
        "pmf_required_unsupported": {"ap_pmf_required_in_consumed_config": ap["ieee80211w"] == "2"},
        "mac_denied": {"station_in_live_deny_acl": F.contains(F.lower(said("deny_acl")), F.lower(p["station_mac"]))},
        "ap_full": {"occupied_single_station_limit": (ap["max_num_sta"] == "1") & F.contains(said("occupant_authorized"), F.lit("[AUTHORIZED]"))},
        "dhcp_no_server": {"server_never_launched": ~F.array_contains(launched, "dhcp_server.log")},
        "ap_deauth": {"deauthentication_ack_after_completion": (done > 0) & (done < acted)},
        "ssid_not_found": {"distinct_networks_loaded": (p["ssid"] != wanted) & (live["ssid"] == p["ssid"])},
    }
    told = lambda checks: F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, ok in checks.items()))
    answered = F.transform(F.map_entries(replies), lambda r: F.struct(F.concat(r["key"], F.lit("_query")).alias("check"), F.coalesce((r["value"]["returncode"] == 0) & ~r["value"]["stdout"].rlike(r"(?m)^\s*FAIL(-.*|\s*)$"), F.lit(False)).alias("passed")))
    out = F
    for name, checks in own.items():
        out = out.when(label == name, told(checks if name == "dhcp_no_server" else checks | {"server_running": server}))
    return F.concat(answered, told(always), out.otherwise(told({"server_running": server})))


def injection_verified(checks: Column) -> Column:
    """Whether all checks of a bundle passed."""
    return F.forall(checks, lambda c: c["passed"])


def probe_rows(meta: DataFrame, features: DataFrame, key: str = "bundle_id") -> tuple[DataFrame, DataFrame]:
    """(rows for the leak probe, (reason, n) of what it leaves out): quarantined bundles, and those whose features could not be read."""
    both = meta.join(features.withColumn("_read", F.lit(True)), key, "left")
    why = F.when(F.coalesce("quarantined", F.lit(False)), "quarantined").when(F.col("_read").isNull(), "unreadable")
    marked = both.withColumn("_why", why).drop("_read")
    return marked.where("_why is null").drop("_why"), marked.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))
