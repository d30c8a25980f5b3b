"""What a lab sets up for a bundle: its fault class, drawn parameters, and the files that they are written to."""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions.draws import Draws
from framescope.functions.texts import config_values
from framescope.operators.bundles import CLASSES, RANGES

#: Settings of access point and station that a class may change, and what is done besides (fixed values).
CAUSES = {
    "ok": ((), (), ()),
    "wrong_passphrase": ((), ("psk",), ()),
    "akm_mismatch": (("wpa_key_mgmt", "ieee80211w", "sae_require_mfp"), (), ()),
    "pmf_required_unsupported": (("ieee80211w",), ("ieee80211w",), ()),
    "mac_denied": (("macaddr_acl", "deny_mac_file"), (), ("deny_station",)),
    "ap_full": (("max_num_sta",), (), ("connect_occupant_first",)),
    "dhcp_no_server": ((), (), ("omit_dhcp_server",)),
    "ap_deauth": ((), (), ("deauthenticate_after_connection",)),
    "ssid_not_found": ((), ("ssid",), ()),
}
#: Settings of an access point: those of every class, in order, with a parameter's name in braces (fixed values).
AP_SETTINGS = ["interface=wlan0", "driver=nl80211", "ctrl_interface={directory}/ap-control", "ssid={ssid}", "hw_mode=g", "channel={channel}", "bssid={ap_mac}", "auth_algs=1", "wpa=2", "rsn_pairwise=CCMP", "wpa_passphrase={passphrase}"]
#: Settings that follow, by class; None: any other (fixed values).
AP_KEYS = {
    None: ["wpa_key_mgmt=WPA-PSK", "ieee80211w=0"],
    "akm_mismatch": ["wpa_key_mgmt=SAE", "ieee80211w=2", "sae_require_mfp=1"],
    "pmf_required_unsupported": ["wpa_key_mgmt=WPA-PSK", "ieee80211w=2"],
    "mac_denied": ["wpa_key_mgmt=WPA-PSK", "ieee80211w=0", "macaddr_acl=0", "deny_mac_file={directory}/deny.txt"],
    "ap_full": ["wpa_key_mgmt=WPA-PSK", "ieee80211w=0", "max_num_sta=1"],
}
#: Protection of management frames that a station asks for (fixed values).
STATION_PROTECTION = {None: "1", "pmf_required_unsupported": "0"}
#: A station's file around its network, key and protection (fixed values).
STATION_LINES = ["ctrl_interface={directory}/{control}", "update_config=0", "network={", '    ssid="{network}"', '    psk="{secret}"', "    scan_ssid=1", "    key_mgmt=WPA-PSK", "    ieee80211w={protection}", "}"]
#: Settings of the address server (fixed values).
DHCP_SETTINGS = [
    "interface=wlan0", "bind-interfaces", "port=0", "dhcp-range=192.0.2.20,192.0.2.100,255.255.255.0,10m", "dhcp-option=3,192.0.2.1", "log-dhcp", "log-facility=-",
    "dhcp-leasefile={directory}/dnsmasq.leases", "pid-file={directory}/dnsmasq.pid", "user=root",
]
#: What a station does with an address (fixed value).
DHCP_SCRIPT = ["#!/bin/sh", 'case "$1" in', "  bound|renew)", '    ip -4 address flush dev "$interface" scope global', '    ip address add "$ip/24" dev "$interface"', "    ;;", "esac", "exit 0"]
#: Lengths of drawn names and pass phrases, and what they are made of (fixed values).
NAME_LENGTH, PHRASE_LENGTH, LETTERS = 12, 20, string.ascii_letters + string.digits

PARAMETERS = "ssid string, absent_ssid string, passphrase string, wrong_passphrase string, channel int, ap_mac string, station_mac string, occupant_mac string, ap_delay double, station_delay double"


def scenarios(spark: SparkSession) -> DataFrame:
    """(label, ap_keys, station_keys, actions): a row for each of the nine classes."""
    return spark.createDataFrame([(k, *map(list, CAUSES[k])) for k in CLASSES], "label string, ap_keys array<string>, station_keys array<string>, actions array<string>")


def with_scenario(bundles: DataFrame) -> DataFrame:
    """bundles (label) with their class's keys and actions; null for labels that are no class. Nine rows are broadcast."""
    return bundles.join(F.broadcast(scenarios(bundles.sparkSession)), "label", "left")


_OCTETS = np.array([f"{x:02x}:" for x in range(256)])


def _addresses(draws: Draws, who: np.ndarray) -> np.ndarray:
    """Locally administered unicast addresses."""
    octets = np.stack([draws.below(256, who) for _ in range(6)], axis=1)
    octets[:, 0] = (octets[:, 0] | 2) & 254
    parts = np.stack([_OCTETS[octets[:, k]] for k in range(6)], axis=1)
    return parts.view("<U18").ravel().astype("<U17").astype(object)  # without the last colon


def drawn(seeds: np.ndarray, split: str, prefix: str) -> pd.DataFrame:
    """The parameters of each seed, drawn in a fixed order from its own generator. What must differ is drawn until it does; names begin with prefix."""
    draws, ranges, every = Draws(seeds), RANGES[split], np.arange(len(seeds))
    ssid, absent = (prefix + draws.texts(LETTERS, NAME_LENGTH) for _ in range(2))
    while (same := np.flatnonzero(ssid == absent)).size:
        absent[same] = prefix + draws.texts(LETTERS, NAME_LENGTH, same)
    phrase, wrong = (draws.texts(LETTERS, PHRASE_LENGTH) for _ in range(2))
    wrong = np.array([w if w != p else ("B" if p[0] == "A" else "A") + p[1:] for p, w in zip(phrase, wrong)], object)
    addresses: list[np.ndarray] = []
    for _ in range(3):
        own, open_ = np.empty(len(seeds), object), every
        while open_.size:
            own[open_] = _addresses(draws, open_)
            open_ = np.flatnonzero(np.any([own == other for other in addresses], axis=0)) if addresses else every[:0]
        addresses.append(own)
    channel = draws.between(*ranges["channel"])
    delays = [[round(x, 3) for x in draws.uniform(*ranges[k]).tolist()] for k in ("ap_delay", "station_delay")]
    return pd.DataFrame(dict(zip([c.split()[0] for c in PARAMETERS.split(", ")], [ssid, absent, phrase, wrong, channel, *addresses, *delays])))


def draw_parameters(seed: Column, split: Column, prefix: str = "lab-") -> Column:
    """struct of the parameters that a seed draws in a split (dev, test); null for a null seed or another split. The draws are those of Python's own
    generator for that seed, made for a whole batch of seeds at once."""

    @F.pandas_udf(PARAMETERS)
    def run(seeds: pd.Series, splits: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(None, index=range(len(seeds)), columns=[c.split()[0] for c in PARAMETERS.split(", ")], dtype=object)
        for name in RANGES:
            mine = np.flatnonzero((splits == name) & seeds.notna())
            if mine.size:
                out.iloc[mine] = drawn(seeds.iloc[mine].astype("int64").to_numpy(), name, prefix).to_numpy(dtype=object)
        return out

    return F.when(seed.isNotNull() & split.isin(*RANGES), run(F.coalesce(seed.cast("string"), F.lit("0")).cast("bigint"), split))


def _filled(lines: list[str], values: dict[str, Column]) -> Column:
    """The lines, each with a line feed, with the values of the names in braces."""
    parts: list[Column] = []
    for line in lines:
        at = 0
        for m in _NAME.finditer(line):
            parts += [F.lit(line[at : m.start()]), values[m[1]]]
            at = m.end()
        parts.append(F.lit(line[at:] + "\n"))
    return F.concat(*parts)


_NAME = re.compile(r"\{(\w+)\}")


def config_files(label: Column, parameters: Column, directory: Column) -> dict[str, Column]:
    """The content of each of the six files, by name, of a bundle of a class with parameters (struct as draw_parameters makes it)."""
    values = {c.split()[0]: parameters[c.split()[0]].cast("string") for c in PARAMETERS.split(", ")} | {"directory": directory}
    by_label = lambda told: _by_label(label, {k: _filled(v, values) if isinstance(v, list) else F.lit(v) for k, v in told.items()})
    asked = F.when(label == "ssid_not_found", values["absent_ssid"]).otherwise(values["ssid"])
    secret = F.when(label == "wrong_passphrase", values["wrong_passphrase"]).otherwise(values["passphrase"])
    station = lambda network, key_, control: _filled(STATION_LINES, values | {"network": network, "secret": key_, "control": F.lit(control), "protection": by_label(STATION_PROTECTION)})
    return {
        "hostapd.conf": F.concat(_filled(AP_SETTINGS, values), by_label(AP_KEYS)),
        "station.conf": station(asked, secret, "sta-control"),
        "occupant.conf": station(values["ssid"], values["passphrase"], "occupant-control"),
        "deny.txt": F.concat(values["station_mac"], F.lit("\n")),
        "dnsmasq.conf": _filled(DHCP_SETTINGS, values),
        "dhcp-script.sh": F.lit("\n".join([*DHCP_SCRIPT, ""])),
    }


def render_configs(bundles: DataFrame, directory: Column, key: str = "bundle_id", parameters: str = "parameters") -> DataFrame:
    """(key, file, content): the six files of each bundle (label, parameters: struct as draw_parameters makes it). Rows of other labels give none."""
    files = config_files(F.col("label"), F.col(parameters), directory)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("file"), content.alias("content")) for name, content in files.items())))
    return bundles.where(F.col("label").isin(*CLASSES) & F.col(parameters).isNotNull()).select(key, each.alias("f")).select(key, "f.file", "f.content")


def _by_label(label: Column, cases: dict[str | None, Column]) -> Column:
    out = F
    for name, value in cases.items():
        if name is not None:
            out = out.when(label == name, value)
    return out.otherwise(cases[None])


def changed_values(content: Column, baseline: Column) -> Column:
    """Names of the settings (key=value lines) that differ between two texts, sorted; a setting of one side only differs. Null counts as no text."""
    told, base = (F.coalesce(config_values(x), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for x in (content, baseline))
    # a let: each side is taken apart once
    both = F.array(F.struct(told.alias("a"), base.alias("b")))
    differ = lambda s: F.filter(F.array_union(F.map_keys(s["a"]), F.map_keys(s["b"])), lambda k: ~F.try_element_at(s["a"], k).eqNullSafe(F.try_element_at(s["b"], k)))
    return F.array_sort(F.get(F.transform(both, differ), F.lit(0)))


def changed_settings(configs: DataFrame, baseline: DataFrame, key: str = "bundle_id") -> DataFrame:
    """(key, file, changed): which settings of each file differ from the same file of the baseline, sorted; files without any are left out. Both sides
    are (key, file, content) of key=value lines, with a row for each file; a setting of one side only differs. Whole files meet, and only those that differ
    are taken apart."""
    side = lambda df, name: df.select(key, "file", F.col("content").alias(name))
    both = side(configs, "_a").join(side(baseline, "_b"), [key, "file"], "full_outer")
    return _with_changes(both, [key, "file"])


def changed_from_class(bundles: DataFrame, directory: Column, baseline: str = "ok", key: str = "bundle_id", parameters: str = "parameters") -> DataFrame:
    """(key, label, file, changed), as changed_settings gives it, of each bundle's files (see render_configs) against those of a bundle of another class
    with the same parameters. Both are written side by side in the bundle's own row, so nothing is drawn twice and nothing shuffled."""
    own, other = (config_files(label, F.col(parameters), directory) for label in (F.col("label"), F.lit(baseline)))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("file"), own[name].alias("_a"), other[name].alias("_b")) for name in own)))
    return _with_changes(bundles.where(F.col("label").isin(*CLASSES) & F.col(parameters).isNotNull()).select(key, "label", each.alias("f")).select(key, "label", "f.*"), [key, "label", "file"])


def _with_changes(both: DataFrame, columns: list[str]) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    # exploded, as a filter behind the projection would be moved before it and take the texts apart twice
    return both.where(~a.eqNullSafe(b)).select(*columns, F.explode(F.filter(F.array(changed_values(a, b)), lambda x: F.size(x) > 0)).alias("changed"))
