"""Decoding of 802.11 packets: fixed fields are column expressions; only the two walks of unknown length (radiotap fields and information
elements) run in Python, on Arrow batches of the octets that they need, not of whole rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions.batches import bound_batches, give_back
from framescope.functions.scalars import frequency_channel
from framescope.operators.integrity import violations
from framescope.sources.pcap import IEEE802_11, RADIOTAP

#: What can be wrong with a packet (fixed values).
TRUNCATED, MALFORMED, UNSUPPORTED, CAPACITY = "truncated input", "malformed input", "unsupported format", "fixed capacity exceeded"
#: Alignment and size of radiotap fields 0 to 27 (fixed values).
RADIOTAP_FIELDS = [(8, 8), (1, 1), (1, 1), (2, 4), (2, 2), (1, 1), (1, 1), (2, 2), (2, 2), (2, 2), (1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (1, 1), (1, 1), (4, 8), (1, 3), (4, 8), (2, 12), (8, 12), (2, 12), (2, 12), (2, 6), (1, 1), (2, 4)]
#: Subtype names of management, control and data frames in order (fixed values).
SUBTYPES = [
    ["assoc_req", "assoc_resp", "reassoc_req", "reassoc_resp", "probe_req", "probe_resp", "timing_advertisement", "reserved", "beacon", "atim", "disassoc", "auth", "deauth", "action", "action_no_ack", "reserved"],
    ["reserved", "reserved", "trigger", "tack", "beamforming_report_poll", "vht_ndp_announcement", "control_extension", "control_wrapper", "block_ack_req", "block_ack", "ps_poll", "rts", "cts", "ack", "cf_end", "cf_end_ack"],
    ["data", "data_cf_ack", "data_cf_poll", "data_cf_ack_poll", "null", "cf_ack", "cf_poll", "cf_ack_poll", "qos_data", "qos_data_cf_ack", "qos_data_cf_poll", "qos_data_cf_ack_poll", "qos_null", "reserved", "qos_cf_poll", "qos_cf_ack_poll"],
]
TYPES = ["management", "control", "data"]
#: Names of information elements, and the lengths that some must have (fixed values).
ELEMENT_NAMES = {0: "ssid", 1: "supported_rates", 3: "ds_parameter_set", 45: "ht_capabilities", 48: "rsn", 191: "vht_capabilities"}
ELEMENT_SIZES = {0: (0, 32), 1: (1, 8), 3: (1, 1), 45: (26, 26), 48: (2, 255), 191: (12, 12)}
#: Bytes of fixed fields before the elements of a management frame, by subtype (fixed values).
FIXED_SIZES = {0: 4, 1: 6, 2: 10, 3: 6, 4: 0, 5: 12, 8: 12, 10: 2, 11: 6, 12: 2}
MOST_ELEMENTS = 128


class _Bad(Exception):
    pass


def _need(ok: bool, what: str = TRUNCATED) -> None:
    if not ok:
        raise _Bad(what)


def radiotap_values(data: bytes) -> tuple[int, dict[int, bytes]]:
    """(header length, last value of each field): the fields that the presence words announce, wherever alignment puts them."""
    _need(len(data) >= 8)
    _need(data[0] == 0, UNSUPPORTED)
    size = struct.unpack_from("<H", data, 2)[0]
    _need(size >= 8, MALFORMED)
    _need(size <= len(data))
    words = []
    while not words or words[-1] >> 31:
        _need(4 * len(words) + 8 <= size)
        words.append(struct.unpack_from("<I", data, 4 * len(words) + 4)[0])
    at = 4 * len(words) + 4
    found: dict[int, bytes] = {}

    def take(align: int, length: int) -> bytes:
        nonlocal at
        start = -(-at // align) * align
        _need(start + length <= size)
        at = start + length
        return data[start:at]

    base, standard = 0, True
    for k, word in enumerate(words):
        _need(word >> 29 & 3 != 3, MALFORMED)
        for bit in (b for b in range(29) if word >> b & 1 and standard):
            field = base + bit
            if field == 28:  # the rest is a list of typed values
                _need(not word >> 29 and k == len(words) - 1, MALFORMED)
                take(4, 0)
                while at < size:
                    kind, length = struct.unpack("<HH", take(1, 4))
                    _need(kind not in (29, 31), MALFORMED)
                    found[kind] = take(1, length)
                    take(4, 0)
                return size, found
            _need(field < len(RADIOTAP_FIELDS), UNSUPPORTED)
            found[field] = take(*RADIOTAP_FIELDS[field])
        base += 32
        if word >> 29 & 1:
            base, standard = 0, True
        if word >> 30 & 1:
            take(1, struct.unpack_from("<H", take(2, 6), 4)[0])
            base, standard = 0, False
    return size, found


_RADIOTAP_COLUMNS = {"radiotap_error": pa.string(), "radiotap_len": pa.int32(), "tsft": pa.decimal128(20, 0), "radiotap_flags": pa.int32(), "rate": pa.int32(), "freq": pa.int32(), "channel_flags": pa.int32(), "rssi_dbm": pa.int32(), "mcs_known": pa.int32(), "mcs_flags": pa.int32(), "mcs_index": pa.int32()}
_RADIOTAP_TYPE = T.StructType([T.StructField(c, {pa.string(): T.StringType(), pa.int32(): T.IntegerType()}.get(t, T.DecimalType(20, 0))) for c, t in _RADIOTAP_COLUMNS.items()])
_IES_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("id", "len", "offset")]))


def _radiotap_row(data: bytes | None, linktype: int | None) -> tuple:
    if linktype != RADIOTAP or data is None:
        return (None if linktype == IEEE802_11 or data is None else UNSUPPORTED, *[None] * 10)
    try:
        size, found = radiotap_values(data)
    except _Bad as e:
        return (str(e), *[None] * 10)
    v = {k: x.ljust(8, b"\0") for k, x in found.items()}  # short values of the typed list end in zeros
    channel, mcs = v.get(3), v.get(19)
    return (
        None, size, int.from_bytes(v[0][:8], "little") if 0 in v else None, v[1][0] if 1 in v else None, v[2][0] if 2 in v else None,
        *(struct.unpack_from("<HH", channel) if channel else (None, None)), struct.unpack_from("b", v[5])[0] if 5 in v else None, *(mcs[:3] if mcs else (None, None, None)),
    )


@F.arrow_udf(_RADIOTAP_TYPE)
def _radiotap(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for data, linktypes in parts:
        rows = [_radiotap_row(d, t) for d, t in zip(data.to_pylist(), linktypes.to_pylist())]
        columns = zip(*rows) if rows else [()] * len(_RADIOTAP_COLUMNS)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _RADIOTAP_COLUMNS.values())], list(_RADIOTAP_COLUMNS))
    give_back()


def elements(body: bytes) -> tuple[list[tuple[int, int, int]], str | None]:
    """[(id, length, offset)] of an element list, and what is wrong with it."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(body):
        if at + 2 > len(body) or at + 2 + body[at + 1] > len(body):
            return out, TRUNCATED
        kind, size = body[at], body[at + 1]
        low, high = ELEMENT_SIZES.get(kind, (0, 255))
        if len(out) == MOST_ELEMENTS:
            return out, CAPACITY
        if not low <= size <= high:
            return out, MALFORMED
        out.append((kind, size, at + 2))
        at += 2 + size
    return out, None


@F.arrow_udf(T.StructType([T.StructField("ies", _IES_TYPE), T.StructField("error", T.StringType())]))
def _elements(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The element list of each body (null: no list), and what is wrong with it."""
    for bodies in parts:
        found = [elements(b) if b is not None else ([], None) for b in bodies.to_pylist()]
        every = [x for ies, _ in found for x in ies]
        parts_of = pa.StructArray.from_arrays([pa.array([x[k] for x in every], pa.int32()) for k in range(3)], ["id", "len", "offset"])
        ends = pa.array([0, *accumulate(len(ies) for ies, _ in found)], pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, parts_of), pa.array([bad for _, bad in found], pa.string())], ["ies", "error"])
    give_back()


def _digits(octets: Column, size: int) -> Column:
    """Two digits for each of the first octets: what fields are cut from, so that it is written once."""
    return F.lower(F.hex(F.substring(octets, 1, size)))


def le(digits: Column, at: int | Column, size: int) -> Column:
    """An unsigned little-endian integer of up to 4 octets at an offset; null if the octets aren't there."""
    octet = lambda k: F.substring(digits, (at if isinstance(at, Column) else F.lit(at)) * 2 + (2 * k + 1), F.lit(2))
    return F.when(F.length(octet(size - 1)) == 2, F.conv(F.concat(*(octet(k) for k in range(size - 1, -1, -1))), 16, 10).cast("int" if size < 4 else "bigint"))


def be(digits: Column, at: int, size: int, kind: str = "int") -> Column:
    part = F.substring(digits, 2 * at + 1, 2 * size)
    return F.when(F.length(part) == 2 * size, F.conv(part, 16, 10).cast(kind))


def address(digits: Column, at: int) -> Column:
    return F.concat_ws(":", *(F.substring(digits, 2 * (at + k) + 1, 2) for k in range(6)))


def decode_frames(packets: DataFrame) -> DataFrame:
    """One row per packet: path, frame, ts_ns, error, and the decoded fields, which are all null where error is not.

    Absent fields are null; an empty network name is ''. A packet of a failed scan keeps its scan error.
    """
    keys = ["path", "frame", "linktype", "ts_ns"]
    bound_batches(packets.sparkSession)
    # the walks are told to Spark as not deterministic: what a query filters by is then not evaluated below them, and again above
    d = packets.select(*keys, "data", "scan_error", _radiotap.asNondeterministic()("data", "linktype").alias("_radio")).select(*keys, "data", "scan_error", "_radio.*")
    fcs = F.coalesce(F.col("radiotap_flags").bitwiseAND(F.lit(0x10)) != 0, F.lit(False))
    start = F.coalesce("radiotap_len", F.lit(0))
    room = F.length("data") - start - F.when(fcs, 4).otherwise(0)
    d = d.withColumns({"_start": start, "fcs_present": fcs, "_room": room, "_mac": F.substring("data", start + 1, F.greatest(room, F.lit(0)))}).drop("data")
    d = d.withColumn("_head", _digits(F.col("_mac"), 32))
    mac, head = F.col("_mac"), F.col("_head")
    d = d.withColumn("frame_control", le(head, 0, 2))
    fc = F.col("frame_control")
    bit = lambda mask: fc.bitwiseAND(F.lit(mask)) != 0
    d = d.withColumns({"type_id": F.shiftright(fc, 2).bitwiseAND(F.lit(3)), "subtype_id": F.shiftright(fc, 4).bitwiseAND(F.lit(15)), "to_ds": bit(0x100), "from_ds": bit(0x200), "more_fragments": bit(0x400), "retry": bit(0x800), "protected": bit(0x4000), "_order": bit(0x8000)})
    kind, sub, both = F.col("type_id"), F.col("subtype_id"), F.col("to_ds") & F.col("from_ds")
    control = F.when(sub.isin(12, 13), 10).when((sub >= 7), 16)
    n_addrs = F.when(kind == 1, F.when(sub.isin(12, 13, 7), 1).otherwise(2)).when(both, 4).otherwise(3)
    qos = (kind == 2) & (sub.bitwiseAND(F.lit(8)) != 0)
    d = d.withColumns({"_fixed": F.when(kind == 1, control).when(both, 30).otherwise(24), "_n": n_addrs, "_qos": qos})
    header = F.col("_fixed") + F.when(F.col("_qos"), 2).otherwise(0) + F.when(F.col("_order") & (F.col("_qos") | (kind == 0)), 4).otherwise(0)
    d = d.withColumns({"header_len": header, "sequence_control": F.when(kind != 1, le(head, 22, 2)), "qos_control": F.when(F.col("_qos"), le(head, F.col("_fixed"), 2))})
    seq = F.col("sequence_control")
    opened = (kind != 1) & ~F.col("protected") & ~F.col("more_fragments") & (seq.bitwiseAND(F.lit(15)) == 0)
    size = F.lit(None).cast("int")
    for s, n in FIXED_SIZES.items():
        size = F.when(sub == s, n).otherwise(size)
    managed = opened & (kind == 0) & size.isNotNull()
    # link-layer header, then a key frame: what stands after the header of an open data frame that carries data
    padded = F.when(F.coalesce(F.col("radiotap_flags").bitwiseAND(F.lit(0x20)) != 0, F.lit(False)), F.ceil(F.col("header_len") / 4) * 4).otherwise(F.col("header_len")).cast("int")
    carries = opened & (kind == 2) & (sub.bitwiseAND(F.lit(4)) == 0) & ~F.coalesce(F.col("qos_control").bitwiseAND(F.lit(0x80)) != 0, F.lit(False))
    d = d.withColumns({"_size": F.when(managed, size), "_body": F.when(managed, F.expr("substring(_mac, header_len + 1)")), "_pad": F.when(carries, padded)})
    pad = F.col("_pad")
    keyed = F.when(F.substring("_mac", pad + 1, F.lit(8)) == F.lit(bytearray.fromhex("aaaa03000000888e")), F.substring("_mac", pad + 9, F.lit(1 << 20)))
    before = F.coalesce(
        "scan_error",
        "radiotap_error",
        F.when((F.col("_room") < 0) | (F.length("_mac") < 2), TRUNCATED),
        F.when((fc.bitwiseAND(F.lit(3)) != 0) | (kind == 3) | ((kind == 1) & (sub < 7)), UNSUPPORTED),
        F.when((kind == 0) & (F.col("to_ds") | F.col("from_ds")), MALFORMED),
        F.when(F.length("_mac") < F.col("header_len"), TRUNCATED),
        F.when(F.length("_body") < F.col("_size"), TRUNCATED),
    )
    # steps, each of which takes several times what the one before it made: Spark leaves those apart, so that each is small enough for Java's compiler
    d = d.withColumns({"_fields": _digits(F.col("_body"), 12), "_eapol": keyed, "_before": before})
    body, e = F.col("_fields"), F.col("_key")
    u16 = lambda at, *subs: F.when(sub.isin(*subs), le(body, at, 2))
    d = d.withColumns(
        {
            "_key": _digits(F.col("_eapol"), 99),
            "capability": F.coalesce(u16(0, 0, 1, 2, 3), u16(10, 5, 8)),
            "listen_interval": u16(2, 0, 2),
            "status_code": F.coalesce(u16(2, 1, 3), u16(4, 11)),
            "aid": u16(4, 1, 3).bitwiseAND(F.lit(0x3FFF)),
            "beacon_interval": u16(8, 5, 8),
            "auth_algorithm": u16(0, 11),
            "auth_seq": u16(2, 11),
            "reason_code": u16(0, 10, 12),
        }
    )
    d = d.withColumns(
        {
            "current_ap": F.when(sub == 2, address(body, 4)),
            "timestamp": F.when(sub.isin(5, 8), le(body, 0, 4).cast("decimal(20,0)") + le(body, 4, 4).cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)")).cast("decimal(20,0)"),
            "_length": be(e, 2, 2), "_packet": be(e, 1, 1), "_descriptor": be(e, 4, 1), "_key_data": be(e, 97, 2), "_info": be(e, 5, 2),
            "_first": address(head, 4), "_second": address(head, 10), "_third": address(head, 16),
        }
    )
    length, packet_type, descriptor, key_data, info = (F.col(c) for c in ("_length", "_packet", "_descriptor", "_key_data", "_info"))
    is_key = (packet_type == 3) & descriptor.isin(2, 254)
    eapol_error = (
        F.when(e.isNull(), None)
        .when(F.length("_eapol") < 4, TRUNCATED)
        .when(F.length("_eapol") < length + 4, TRUNCATED)
        .when((packet_type == 3) & (length == 0), MALFORMED)
        .when(is_key & (length < 95), TRUNCATED)
        .when(is_key & (key_data != length - 95), MALFORMED)
    )
    four = is_key & (info.bitwiseAND(F.lit(8)) != 0) & (info.bitwiseAND(F.lit(0x2C00)) == 0)
    bits = info.bitwiseAND(F.lit(0x03C0))
    message = F.when(four, F.when(bits == 0x0080, 1).when(bits == 0x0100, F.when((descriptor == 254) & (key_data == 0), 4).otherwise(2)).when(bits.isin(0x01C0, 0x03C0), 3).when(bits == 0x0300, 4))
    after = F.coalesce(F.when(F.length("_mac") < pad, TRUNCATED), eapol_error)
    first, second, third = F.col("_first"), F.col("_second"), F.col("_third")
    addresses = F.array(first, F.when(F.col("_n") > 1, second), F.when(F.col("_n") > 2, third), F.when(F.col("_n") > 3, address(head, 24)))
    own = F.when(kind == 1, F.when(sub == 10, first).when(sub.isin(14, 15), F.when(F.col("_n") > 1, second))).when(both, None).when(F.col("to_ds"), first).when(F.col("from_ds"), second).otherwise(third)
    listed = F.col("_size").isNotNull() & ~F.coalesce((sub == 11) & (F.col("auth_algorithm") >= 3), F.lit(False))
    names = F.array(*(F.array(*(F.lit(x) for x in row)) for row in SUBTYPES))
    d = d.withColumns(
        {
            "_after": after, "addrs": F.array_compact(addresses), "bssid": own, "duration": le(head, 2, 2), "eapol_msg": message,
            "eapol_key_info": F.when(is_key, info), "eapol_replay_counter": F.when(is_key, be(e, 9, 8, "decimal(20,0)")),
            "_radio_channel": frequency_channel(F.col("freq")), "_list": F.when(listed, F.expr("substring(_body, _size + 1)")),
        }
    )
    # the elements come last, so that little has to be evaluated with a query's filters
    d = d.withColumn("_walked", _elements.asNondeterministic()("_list"))
    ies, lists = F.col("_walked.ies"), F.col("_list")
    value = lambda k: F.get(F.filter(ies, lambda x: x["id"] == k), F.lit(0))
    held = lambda k: F.when(lists.isNotNull(), F.substring(lists, value(k)["offset"] + 1, value(k)["len"]))
    error = F.coalesce("_before", "_walked.error", "_after")
    ds = F.when(lists.isNotNull(), F.conv(F.hex(held(3)), 16, 10).cast("int"))
    named = F.transform(ies, lambda x: F.struct(x["id"].alias("id"), F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ELEMENT_NAMES.items() for v in kv)), x["id"]), F.lit("unknown")).alias("name"), x["len"].alias("len")))
    d = d.withColumns({"error": error, "_ds": ds})
    fields = {
        "radiotap_len": F.col("radiotap_len"), "tsft": F.col("tsft"), "radiotap_flags": F.col("radiotap_flags"), "rate": F.col("rate"), "freq": F.col("freq"), "channel_flags": F.col("channel_flags"),
        "rssi_dbm": F.col("rssi_dbm"), "mcs_known": F.col("mcs_known"), "mcs_flags": F.col("mcs_flags"), "mcs_index": F.col("mcs_index"), "fcs_present": F.col("fcs_present"),
        "frame_control": fc, "duration": F.col("duration"), "type_id": kind, "subtype_id": sub, "type": F.get(F.array(*(F.lit(x) for x in TYPES)), kind), "subtype": F.get(F.get(names, kind), sub),
        "to_ds": F.col("to_ds"), "from_ds": F.col("from_ds"), "more_fragments": F.col("more_fragments"), "retry": F.col("retry"), "protected": F.col("protected"),
        "addrs": F.col("addrs"), "bssid": F.col("bssid"), "sequence_control": seq, "seq": F.shiftright(seq, 4), "fragment": seq.bitwiseAND(F.lit(15)), "qos_control": F.col("qos_control"), "header_len": F.col("header_len"),
        **{c: F.col(c) for c in ("capability", "listen_interval", "current_ap", "aid", "timestamp", "beacon_interval", "auth_algorithm", "auth_seq", "status_code", "reason_code")},
        "channel": F.when(F.col("_ds").isNotNull(), F.nullif("_ds", F.lit(0))).otherwise(F.nullif("_radio_channel", F.lit(0))),
        "ssid_raw": held(0), "ssid": F.decode(held(0), "ISO-8859-1"), "supported_rates": held(1), "ht_cap": held(45), "rsn_raw": held(48), "vht_cap": held(191),
        "ies": F.transform(ies, lambda x: F.struct(x["id"].alias("id"), x["len"].alias("len"), (x["offset"] + F.col("_start") + F.col("header_len") + F.col("_size")).alias("offset"))), "ie_summary": named,
        **{c: F.col(c) for c in ("eapol_key_info", "eapol_replay_counter", "eapol_msg")},
    }
    return d.select(*keys, "error", *(F.when(F.col("error").isNull(), x).alias(c) for c, x in fields.items()))


def frame_record() -> Column:
    """A decoded frame's record as one line of JSON in a fixed order of keys; a failed one has its error only."""
    ts = (F.col("ts_ns").cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(20,9)").alias("ts")
    before = ["rssi_dbm", "freq", "channel", "type", "subtype", "type_id", "subtype_id", "addrs", "bssid"]
    behind = ["seq", "retry", "protected", "status_code", "reason_code", "eapol_msg", "ie_summary"]
    options = {"ignoreNullFields": "false"}
    # the name's octets have an escaped form of their own, so the record is written in two parts around it
    head = F.regexp_replace(F.to_json(F.struct("frame", ts, *before), options), r"\}$", "")
    tail = F.regexp_replace(F.to_json(F.struct(*behind), options), r"^\{", "")
    name = F.coalesce(F.concat(F.lit('"'), escaped_name(F.col("ssid_raw")), F.lit('"')), F.lit("null"))
    return F.when(F.col("error").isNull(), F.concat(head, F.lit(',"ssid":'), name, F.lit(","), tail)).otherwise(F.to_json(F.struct("frame", ts, "error"), options))


def frame_json(frames: DataFrame) -> DataFrame:
    """(path, frame, json): each frame's record."""
    return frames.select("path", "frame", frame_record().alias("json"))


def escaped_name(raw: Column) -> Column:
    """A network name's octets as the body of a JSON text: printable ASCII as it is, quotes and backslashes escaped, all else as \\u00 and two digits."""
    octets = F.regexp_extract_all(F.lower(F.hex(raw)), F.lit("(..)"), F.lit(1))
    one = lambda h: F.when(h.isin("22", "5c"), F.concat(F.lit("\\"), F.decode(F.unhex(h), "US-ASCII"))).when(h.between("20", "7e"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\u00"), h))
    return F.array_join(F.transform(octets, one), "")


def frame(frames: DataFrame, number: int, path: str | None = None) -> DataFrame:
    """The one frame of a number (and capture): an error if there is none. Only that row reaches the driver."""
    rows = frames.where((F.col("frame") == number) & (F.lit(True) if path is None else F.col("path") == path))
    if rows.isEmpty():
        raise LookupError(f"no frame {number}")
    return rows


def decode_checksum(frames: DataFrame) -> DataFrame:
    """Per capture: accepted and rejected frames, and the sum of frame control, sequence control and number of elements of the accepted ones: an action
    that reads what decoding gives, for timing it."""
    ok = F.col("error").isNull()
    part = F.coalesce("frame_control", F.lit(0)) + F.coalesce("sequence_control", F.lit(0)) + F.coalesce(F.size("ies"), F.lit(0))
    return frames.groupBy("path").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.coalesce(F.sum(F.when(ok, part.cast("bigint"))), F.lit(0)).alias("checksum"))


def decoder_faults(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """(path, frame, faults) of decoded frames that break what decoding promises; none should. packets: the rows that were decoded.

    At most four addresses and 128 elements, names of 32 octets at most, headers and elements inside the data, no fields where there is an error."""
    sized = packets.select("path", "frame", F.length("data").alias("_size"))
    rules = {
        "addresses": F.size(F.coalesce("addrs", F.array())) <= 4,
        "elements": F.size(F.coalesce("ies", F.array())) <= MOST_ELEMENTS,
        "name": F.coalesce(F.length("ssid_raw"), F.lit(0)) <= 32,
        "header": F.coalesce(F.col("header_len") + F.coalesce("radiotap_len", F.lit(0)), F.lit(0)) <= F.coalesce("_size", F.lit(0)),
        "bounds": F.forall(F.coalesce("ies", F.array().cast("array<struct<id:int,len:int,offset:int>>")), lambda x: x["offset"] + x["len"] <= F.col("_size")),
        "cleared": F.col("error").isNull() | (F.col("frame_control").isNull() & F.col("addrs").isNull() & F.col("ies").isNull()),
    }
    return frames.join(sized, ["path", "frame"]).select("path", "frame", violations(rules).alias("faults")).where(F.size("faults") > 0)


def is_unicast(mac: Column) -> Column:
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")
    return (first.bitwiseAND(F.lit(1)) == 0) & (mac != "00:00:00:00:00:00")


def capture_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("path").agg(F.count("*").alias("frames"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def network_summary(frames: DataFrame) -> DataFrame:
    """Per network (unicast bssid) of a capture: frames, last channel, last non-empty name (else '' if one was seen), signal count, least, greatest, mean, first frame."""
    rows = frames.where(F.col("error").isNull() & is_unicast(F.col("bssid")))
    named = F.when(F.col("ssid") != "", F.col("frame"))
    return rows.groupBy("path", "bssid").agg(
        F.count("*").alias("frames"),
        F.max_by("channel", F.when(F.col("channel").isNotNull(), F.col("frame"))).alias("channel"),
        F.coalesce(F.max_by("ssid", named), F.max("ssid")).alias("ssid"),
        F.count("rssi_dbm").alias("rssi_n"),
        F.min("rssi_dbm").alias("rssi_min"),
        F.max("rssi_dbm").alias("rssi_max"),
        F.avg("rssi_dbm").alias("rssi_mean"),
        F.min("frame").alias("first_frame"),
    )


def handshakes(frames: DataFrame) -> DataFrame:
    """Per (client, network) of a capture: which of the four key messages were seen, how often, and whether all were. Client: the other of the first two addresses."""
    a, b = F.get("addrs", F.lit(0)), F.get("addrs", F.lit(1))
    rows = frames.where("eapol_msg is not null and bssid is not null").withColumn("client", F.when(a == F.col("bssid"), b).otherwise(a))
    rows = rows.where(is_unicast(F.col("client")) & is_unicast(F.col("bssid")) & ((a == F.col("bssid")) | (b == F.col("bssid"))))
    counts = [F.count_if(F.col("eapol_msg") == k).alias(f"m{k}") for k in (1, 2, 3, 4)]
    found = rows.groupBy("path", "client", "bssid").agg(F.bit_or(F.expr("shiftleft(1, eapol_msg - 1)")).alias("mask"), *counts, F.min("frame").alias("first_frame"))
    return found.withColumn("complete", F.col("mask") == 15)


def reason_histogram(frames: DataFrame) -> DataFrame:
    rows = frames.where("type_id = 0 and subtype_id in (10, 12) and reason_code is not null")
    return rows.groupBy("path", "subtype", "reason_code").agg(F.count("*").alias("n"))


def list_frames(frames: DataFrame, subtype: str | None = None, address: str | None = None, has_status: bool | None = None, has_reason: bool | None = None, key_only: bool = False, limit: int = 50) -> DataFrame:
    """The first frames, in capture order, that pass all given filters."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    rows = frames.where("error is null")
    if subtype is not None:
        rows = rows.where(F.col("subtype") == subtype)
    if address is not None:
        rows = rows.where(F.array_contains("addrs", address.lower()))
    if has_status is not None:
        rows = rows.where(F.col("status_code").isNotNull() == has_status)
    if has_reason is not None:
        rows = rows.where(F.col("reason_code").isNotNull() == has_reason)
    if key_only:
        rows = rows.where("eapol_msg is not null")
    return rows.orderBy("path", "frame").limit(limit)
