"""Whether a class was set up, told from recorded answers and files."""

import pytest
from pyspark.sql import functions as F

from framescope.operators import runs, scenarios

SCHEMA = "label string, seed long, replies map<string, struct<returncode:int, stdout:string>>, active array<string>, launched array<string>, steps array<struct<argv:array<string>, returncode:int, stdout:string>>, change string"
DAEMONS = ["hostapd.log", "wpa_supplicant.log", "dhcp_server.log"]


@pytest.fixture(scope="module")
def verdicts(spark):
    drawn = {label: spark.createDataFrame([(7,)], "s long").select(scenarios.draw_parameters(F.col("s"), F.lit("dev")).alias("p")).first().p for label in ["ok"]}["ok"]

    def row(label, change=""):
        asked = drawn.absent_ssid if label == "ssid_not_found" else drawn.ssid
        replies = {
            "ap_status": (0, "state=ENABLED\n"), "ap_config": (0, f"ssid={drawn.ssid}\nkey_mgmt={'SAE' if label == 'akm_mismatch' else 'WPA-PSK'}\n"), "station_ssid": (0, f'"{asked}"\n'), "station_pmf": (0, "0" if label == "pmf_required_unsupported" else "1"),
            "station_status": (0, "wpa_state=SCANNING"), "deny_acl": (0, f"{drawn.station_mac.upper()} VLAN_ID=0"), "occupant_authorized": (0, "flags=[AUTH][AUTHORIZED]"),
        }
        steps = [(["x", "status"], 0, "wpa_state=COMPLETED"), (["y", "deauthenticate", "a"], 1, "OK"), (["y", "deauthenticate", "a"], 0, "OK")]
        active = DAEMONS if label != "dhcp_no_server" else DAEMONS[:2]
        launched = active
        if change == "swap":
            steps = [steps[2], steps[0], steps[2]]
        if change == "fail":
            replies["station_pmf"] = (0, "FAIL-BUSY\n")
        if change == "code":
            replies["ap_config"] = (1, replies["ap_config"][1])
        if change == "started":
            launched = DAEMONS
        if change == "down":
            active = ["hostapd.log"]
        return (label, 7, replies, active, launched, steps, change)

    rows = [row(label) for label in scenarios.CLASSES] + [row("ap_deauth", "swap"), row("ok", "fail"), row("ok", "code"), row("dhcp_no_server", "started"), row("ok", "down")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("parameters", scenarios.draw_parameters(F.col("seed"), F.lit("dev"))).withColumn("bundle_id", F.concat_ws("-", "label", "change"))
    files = scenarios.render_configs(df, F.lit("/run/x")).where("file in ('hostapd.conf', 'station.conf')").groupBy("bundle_id").pivot("file", ["hostapd.conf", "station.conf"]).agg(F.first("content"))
    checks = runs.injection_checks(F.col("label"), F.col("parameters"), F.col("replies"), F.col("`hostapd.conf`"), F.col("`station.conf`"), F.col("active"), F.col("launched"), F.col("steps"))
    out = df.join(files, "bundle_id").select("label", "change", checks.alias("c")).withColumn("ok", runs.injection_verified(F.col("c")))
    return {(r.label, r.change): (r.ok, {c.check for c in r.c}, {c.check for c in r.c if not c.passed}) for r in out.collect()}


def test_each_class_passes_its_own_checks(verdicts):
    for label in scenarios.CLASSES:
        ok, names, failed = verdicts[label, ""]
        assert ok, (label, failed)
        assert len(names) == 7 + 6 + (1 if label in ("ok", "dhcp_no_server") else 2)
    assert "server_never_launched" in verdicts["dhcp_no_server", ""][1] and "server_running" not in verdicts["dhcp_no_server", ""][1]


def test_what_fails_is_named(verdicts):
    assert verdicts["ap_deauth", "swap"] == (False, verdicts["ap_deauth", ""][1], {"deauthentication_ack_after_completion"})
    assert verdicts["ok", "fail"][2] == {"station_pmf_query", "station_pmf_loaded"}
    assert verdicts["ok", "code"][2] == {"ap_config_query", "ap_ssid_loaded"}
    assert verdicts["dhcp_no_server", "started"][2] == {"server_never_launched"}
    assert verdicts["ok", "down"][2] == {"daemon_processes_running", "server_running"}


def test_checks_need_no_join(spark):
    """A join's side of drawn parameters would be broadcast by the size of its keys, through the driver."""
    from framescope.plans import recorded

    assert "Join" not in recorded.q85_injection_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
