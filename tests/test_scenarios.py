"""Seeded draws against Python's generator, and the files that are written from them."""

import random
import string

import numpy as np
from pyspark.sql import functions as F

from framescope.functions.draws import Draws
from framescope.operators import scenarios

SEEDS = [0, 1, -1, 7, 2**31, 2**32 - 1, 2**32, 2**32 + 1, -(2**40) - 3, 2**63 - 1, -(2**63), *range(100, 140)]


def test_draws_are_those_of_the_library():
    draws, libraries = Draws(np.array(SEEDS, np.int64)), [random.Random(s) for s in SEEDS]
    rng = random.Random(5)
    for _ in range(700):  # beyond one block of words, with rejections that put seeds at different places
        n = rng.choice([1, 2, 3, 62, 256, 1000, 2**31 - 1])
        assert draws.below(n).tolist() == [x.randrange(n) for x in libraries]
    assert draws.uniform(0.2, 1.2).tolist() == [x.uniform(0.2, 1.2) for x in libraries]
    assert draws.between(7, 11).tolist() == [x.randint(7, 11) for x in libraries]
    some = np.array([3, 5, 8])
    assert draws.below(62, some).tolist() == [libraries[k].randrange(62) for k in some]
    assert draws.texts("abcdefg", 9).tolist() == ["".join(x.choice("abcdefg") for _ in range(9)) for x in libraries]


def one_by_one(seed, split):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    mac = lambda: ":".join(f"{x if k else (x | 2) & 254:02x}" for k, x in enumerate([rng.randrange(256) for _ in range(6)]))
    low, high = (1, 6) if split == "dev" else (7, 11)
    delay = (0.2, 1.2) if split == "dev" else (1.5, 3.0)
    return ("lab-" + text(12), "lab-" + text(12), text(20), text(20), *(m := [mac() for _ in range(3)])[:0], rng.randint(low, high), *m, round(rng.uniform(*delay), 3), round(rng.uniform(*delay), 3))


def test_parameters_are_drawn_in_order(spark):
    rows = [(s, ["dev", "test"][k % 2]) for k, s in enumerate(SEEDS)] + [(5, "other"), (None, "dev")]
    found = {(r.seed, r.split): r.p for r in spark.createDataFrame(rows, "seed long, split string").select("seed", "split", scenarios.draw_parameters(F.col("seed"), F.col("split")).alias("p")).collect()}
    assert found[5, "other"] is None and found[None, "dev"] is None
    for seed, split in rows[:-2]:
        assert tuple(found[seed, split]) == one_by_one(seed, split)


def test_only_causes_differ(spark):
    rows = [(f"{label}-{k}", label, k) for label in scenarios.CLASSES for k in range(3)] + [("x", "unknown class", 1)]
    drawn = spark.createDataFrame(rows, "bundle_id string, label string, seed long").withColumn("parameters", scenarios.draw_parameters(F.col("seed"), F.lit("test")))
    configs = scenarios.render_configs(drawn, F.lit("/run/x"))
    plain = scenarios.render_configs(drawn.where("label <> 'unknown class'").withColumn("label", F.lit("ok")), F.lit("/run/x"))
    assert configs.count() == 9 * 3 * 6
    changed = {}
    for r in scenarios.changed_settings(configs, plain).collect():
        changed.setdefault(r.bundle_id.split("-")[0], set()).add((r.file, tuple(r.changed)))
    wanted = {label: {(f, tuple(sorted(keys))) for f, keys in (("hostapd.conf", ap), ("station.conf", station)) if keys} for label, (ap, station, _) in scenarios.CAUSES.items()}
    wanted["pmf_required_unsupported"] |= {("occupant.conf", ("ieee80211w",))}
    assert changed == {k: v for k, v in wanted.items() if v}
    files = {r.file: r.content for r in configs.where("bundle_id = 'ssid_not_found-1'").collect()}
    p = drawn.where("bundle_id = 'ssid_not_found-1'").first().parameters
    assert f'\n    ssid="{p.absent_ssid}"\n    psk="{p.passphrase}"\n    scan_ssid=1\n    key_mgmt=WPA-PSK\n    ieee80211w=1\n}}\n' in files["station.conf"]
    assert f"ctrl_interface=/run/x/ap-control\nssid={p.ssid}\nhw_mode=g\nchannel={p.channel}\nbssid={p.ap_mac}\n" in files["hostapd.conf"] and files["deny.txt"] == p.station_mac + "\n"
    assert {r.label: (tuple(r.ap_keys or ()), tuple(r.actions or ())) for r in scenarios.with_scenario(drawn).collect()}["mac_denied"] == (("macaddr_acl", "deny_mac_file"), ("deny_station",))


def test_changed_files_need_no_shuffle(spark):
    """Settings of both sides were exploded, and met in a shuffle for every line of every file."""
    from framescope.plans import recorded

    plan = recorded.q77_changed_settings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
