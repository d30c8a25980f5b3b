import json
import struct

import pytest
from pyspark.sql import functions as F

from framescope.operators import frames as fr
from framescope.plans import captures
from framescope.sources import pcap

AP, STA = bytes.fromhex("02000000aa01"), bytes.fromhex("02000000bb02")


def radiotap(flags=None, mhz=2437, dbm=-42):
    present, body = 0, b""
    if flags is not None:
        present, body = present | 2, body + bytes([flags])
    present |= 8 | 32
    body = body + b"\0" * (len(body) % 2) + struct.pack("<HH", mhz, 0x00A0) + struct.pack("b", dbm)
    return struct.pack("<BBHI", 0, 0, 8 + len(body), present) + body


def mac(fc, a1, a2, a3, seq=5):
    return struct.pack("<HH", fc, 0) + a1 + a2 + a3 + struct.pack("<H", seq << 4)


def ie(kind, data):
    return bytes([kind, len(data)]) + data


def beacon(ssid=b"lab", channel=6):
    return mac(0x80, b"\xff" * 6, AP, AP) + struct.pack("<QHH", 1 << 63, 100, 0x411) + ie(0, ssid) + ie(1, b"\x82\x84") + ie(3, bytes([channel])) + ie(48, b"\x01\x00")


def key(info, up, data=b"", descriptor=2):
    body = bytes([descriptor]) + struct.pack(">HHQ", info, 16, 7) + b"\0" * 80 + struct.pack(">H", len(data)) + data
    a1, a2, ds = (AP, STA, 0x100) if up else (STA, AP, 0x200)
    return mac(0x88 | ds, a1, a2, AP) + b"\0\0" + bytes.fromhex("aaaa03000000888e") + bytes([2, 3]) + struct.pack(">H", len(body)) + body


@pytest.fixture(scope="module")
def decoded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    plain = [
        beacon(), key(0x008A, False), key(0x010A, True, b"\1\2"), key(0x13CA, False, b"\3"), key(0x030A, True),
        mac(0xC0, STA, AP, AP) + struct.pack("<H", 7),  # deauthentication
        mac(0xB0, AP, STA, AP) + struct.pack("<HHH", 3, 1, 0) + b"\x13\x00",  # an authentication whose body is no element list
        mac(0x80, STA, AP, AP) + b"\0" * 12 + b"\x00\x30",  # an element that is cut off
        mac(0x80, STA, AP, AP) + b"\0" * 12 + ie(3, b"\1\2"),  # an element of a wrong size
        b"\x80", struct.pack("<H", 0x0C), beacon(b""), mac(0x4080, STA, AP, AP),
        struct.pack("<HH", 0xD4, 0) + STA,  # acknowledgement
    ]
    (folder / "a.pcap").write_bytes(pcap.capture_bytes([(1_000_000_000 + k * 1000, d) for k, d in enumerate(plain)]))
    tapped = [radiotap() + beacon(b"caf\xe9", 0), radiotap(0x10) + beacon() + b"FCS!", radiotap(0x10) + b"\0\0", radiotap()[:9], b"\1" + radiotap()[1:] + beacon()]
    (folder / "b.pcap").write_bytes(pcap.capture_bytes([(k, d) for k, d in enumerate(tapped)], pcap.RADIOTAP))
    (folder / "c.pcap").write_bytes(pcap.capture_bytes([(0, beacon())]) + b"\0" * 10)
    (folder / "d.pcap").write_bytes(b"not a capture, though long enough")
    (folder / "e.pcap").write_bytes(b"\xd4\xc3")
    frames = fr.decode_frames(pcap.read_packets(spark, str(folder))).cache()
    return frames, {(r["path"][-6], r["frame"]): r for r in frames.collect()}


def test_fields(decoded):
    r = decoded[1]
    b = r["a", 1]
    assert (b.error, b.type, b.subtype, b.ssid, b.channel, b.bssid, b.seq, b.beacon_interval, int(b.timestamp)) == (None, "management", "beacon", "lab", 6, "02:00:00:00:aa:01", 5, 100, 1 << 63)
    assert [(x.id, x.name, x.len) for x in b.ie_summary] == [(0, "ssid", 3), (1, "supported_rates", 2), (3, "ds_parameter_set", 1), (48, "rsn", 2)]
    assert [r["a", k].eapol_msg for k in range(2, 6)] == [1, 2, 3, 4]
    assert (r["a", 6].subtype, r["a", 6].reason_code) == ("deauth", 7)
    assert (r["a", 7].auth_algorithm, r["a", 7].ies) == (3, [])
    assert r["a", 12].ssid == "" and r["a", 13].ssid is None and r["a", 13].protected
    assert (r["a", 14].subtype, r["a", 14].addrs, r["a", 14].bssid) == ("ack", ["02:00:00:00:bb:02"], None)


def test_errors(decoded):
    r = decoded[1]
    assert [r["a", k].error for k in (8, 9, 10, 11)] == [fr.TRUNCATED, fr.MALFORMED, fr.TRUNCATED, fr.UNSUPPORTED]
    assert r["a", 8].type_id is None and r["a", 8].addrs is None
    assert [r["b", k].error for k in (3, 4, 5)] == [fr.TRUNCATED, fr.TRUNCATED, fr.UNSUPPORTED]
    assert (r["c", 1].error, r["c", 2].error) == (None, "truncated input")
    assert (r["d", 0].error, r["e", 0].error) == ("unsupported format", "truncated input")


def test_radiotap(decoded):
    b = decoded[1]["b", 1]
    assert (b.freq, b.rssi_dbm, b.ssid, b.channel, bytes(b.ssid_raw)) == (2437, -42, "café", None, b"caf\xe9")
    assert decoded[1]["b", 2].fcs_present and decoded[1]["b", 2].ssid == "lab"
    # a second presence word after a namespace reset: the last value of a field counts
    assert fr.radiotap_values(struct.pack("<BBHIIBB", 0, 0, 14, 0xA0000002, 2, 8, 9)) == (14, {1: b"\x09"})
    # a typed list, whose short value ends in zeros
    assert fr.radiotap_values(struct.pack("<BBHIHHBxxx", 0, 0, 16, 1 << 28, 5, 1, 0xD6)) == (16, {5: b"\xd6"})


def test_summaries(decoded):
    frames = decoded[0]
    totals = {r.path[-6]: (r.frames, r.parsed, r.errors) for r in fr.capture_totals(frames).collect()}
    assert totals["a"] == (14, 10, 4) and totals["b"] == (5, 2, 3)
    (h,) = [r for r in fr.handshakes(frames).collect()]
    assert (h.client, h.m1, h.m2, h.m3, h.m4, h.mask, h.complete) == ("02:00:00:00:bb:02", 1, 1, 1, 1, 15, True)
    nets = {r.path[-6]: r for r in fr.network_summary(frames).collect()}
    assert nets["a"].ssid == "lab" and nets["a"].channel == 6 and nets["b"].rssi_mean == -42
    assert [(r.subtype, r.reason_code, r.n) for r in fr.reason_histogram(frames).collect()] == [("deauth", 7, 1)]
    assert [r.frame for r in fr.list_frames(frames, subtype="beacon", address="02:00:00:00:AA:01", limit=2).collect()] == [1, 12]
    with pytest.raises(ValueError):
        fr.list_frames(frames, limit=51)


def test_json(decoded):
    lines = {(r["path"][-6], r["frame"]): r["json"] for r in fr.frame_json(decoded[0]).collect()}
    first = json.loads(lines["a", 1])
    assert list(first)[:5] == ["frame", "ts", "rssi_dbm", "freq", "channel"] and first["rssi_dbm"] is None and first["ssid"] == "lab"
    assert list(json.loads(lines["a", 10])) == ["frame", "ts", "error"]
    assert '"ts":1.000000000' in lines["a", 1]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_octets_reach_the_walks(spark):
    """Whole rows went to Python and back for each walk, and a query's filters evaluated the decoding a second time."""
    packets = spark.createDataFrame([("a", 1, pcap.IEEE802_11, 0, beacon(), None)], "path string, frame long, linktype int, ts_ns long, data binary, scan_error string")
    plan = plan_of(fr.network_summary(fr.decode_frames(packets)))
    assert "MapInArrow" not in plan and "_elements(_list" in plan
    (told,) = [x for x in plan.splitlines() if "Filter" in x and "error" in x]
    assert "hex(" not in told


def test_events_travel_bare_and_once(spark):
    """Frames were made where the events are read, by few tasks, and whole captures were dealt again."""
    lines = plan_of(captures.captures(spark, "/root/testdata/sf0.001")).splitlines()
    (at,) = [k for k, x in enumerate(lines) if "Repartition" in x]
    assert not any("hex(" in x for x in lines[at:]) and any("hex(" in x for x in lines[:at])
    assert sum("Aggregate" in x for x in lines[:at]) == 1 and not any("Aggregate" in x for x in lines[at:])


def test_little_endian_digits(spark):
    for value, size in ((0, 2), (2412, 2), (0xFFFE, 2), (1_700_000_000, 4), (0xFFFFFFFF, 4), (1, 8), (2**63 - 1, 8)):
        assert spark.range(1).select(captures._flipped(F.lit(value), size)).first()[0].lower() == value.to_bytes(size, "little").hex()
