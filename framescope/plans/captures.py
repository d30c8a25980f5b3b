"""Queries of the decoder: every user's events are written as a packet capture by column expressions, read back as packets, decoded and summarised.

A capture holds a frame for each event, of six kinds by event_id % 6: beacon, deauthentication, authentication, key message, one cut short, and one that
ends a block acknowledgement; captures of users divisible by 10 end in half a record header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators import frames
from framescope.plans.catalogue import micros, query, table
from framescope.sources.pcap import RADIOTAP, packets_of

KEY_BITS = ("008a", "010a", "13ca", "030a")


def _flipped(value: Column, size: int) -> Column:
    """The hexadecimal digits of a little-endian integer: its octets change places as a number, which is written once."""
    number = value.cast("bigint")
    octets = (F.shiftleft(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)), 8 * (size - 1 - k)) for k in range(size))
    return F.lpad(F.hex(reduce(Column.bitwiseOR, octets)), 2 * size, "0")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a capture for each user."""
    e, user = F.col("event_id"), F.col("user_id")
    network = F.col("network")
    client = F.concat(F.lit("0600"), F.lpad(F.hex(e), 8, "0"))
    radio = F.concat(F.lit("00000d0028000000"), _flipped(2412 + 5 * (user % 13), 2), F.lit("a000"), F.lpad(F.hex(226 - user % 60), 2, "0"))
    head = lambda control, to: F.concat(F.lit(control + "0000"), to, network, network, _flipped(e % 4096 * 16, 2))
    name = F.concat(F.lit("net-"), (user % 50).cast("string"))
    k = (e / 6).cast("bigint")
    beacon = F.concat(head("8000", F.lit("f" * 12)), _flipped(e, 8), F.lit("64001104"), F.lit("00"), F.lpad(F.hex(F.length(name)), 2, "0"), F.hex(name), F.lit("0301"), F.lpad(F.hex(user % 13 + 1), 2, "0"))
    deauth = F.concat(head("c008", client), _flipped(e % 67, 2))
    auth = F.concat(head("b000", client), F.lit("0000"), _flipped(k % 2 + 1, 2), _flipped(k % 18, 2))
    bits = F.element_at(F.array(*(F.lit(x) for x in KEY_BITS)), (k % 4 + 1).cast("int"))
    message = F.concat(head("8802", client), F.lit("0000aaaa03000000888e0203005f02"), bits, F.lit("0000"), F.lpad(F.hex(e), 16, "0"), F.lit("00" * 82))
    ended = F.concat(F.lit("9400aabb"), client, network, F.lit("05000000"))
    frame = F.when(e % 6 == 0, beacon).when(e % 6 == 1, deauth).when(e % 6 == 2, auth).when(e % 6 == 3, message).when(e % 6 == 4, F.lit("c0000000ffff")).otherwise(ended)
    data = F.concat(radio, frame)
    us = F.col("us")
    # events travel bare and once, dealt over all cores, where adaptive execution would put them together; a frame is made where its capture is. What an aggregate
    # collects is evaluated by an interpreter: the frame is a column below it, of which it takes the length and the digits
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("us")).repartition(parts, "user_id")
    events = events.withColumn("network", F.concat(F.lit("020000"), F.lpad(F.hex(user % 50), 6, "0")))
    framed = events.select("user_id", "event_id", F.concat(_flipped(F.floor(us / 1_000_000), 4), _flipped(us % 1_000_000, 4)).alias("stamp"), data.alias("data"))
    record = F.concat("stamp", F.repeat(_flipped(F.length("data") / 2, 4), F.lit(2)), "data")
    rows = framed.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rows"))
    body = F.concat(F.lit("d4c3b2a1020004000000000000000000ffff0000"), _flipped(F.lit(RADIOTAP), 4), F.array_join(F.transform("rows", lambda x: x["r"]), ""), F.when(user % 10 == 0, "0000000000").otherwise(""))
    return rows.select(user.cast("string").alias("path"), F.unhex(body).alias("content"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.decode_frames(packets_of(captures(spark, sf_dir)))


#: The frames as SQL: what decoding should give.
_FRAMES = """WITH f AS (
  SELECT user_id::VARCHAR AS path, event_id AS e, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, event_id % 6 AS kind, event_id // 6 AS k, epoch_us(ts) * 1000 AS ts_ns,
         printf('02:00:00:00:00:%02x', user_id % 50) AS network,
         printf('06:00:%02x:%02x:%02x:%02x', event_id >> 24, (event_id >> 16) & 255, (event_id >> 8) & 255, event_id & 255) AS client FROM events),
d AS (
  SELECT path, frame, ts_ns, e, u, CASE WHEN kind = 4 THEN 'truncated input' END AS error,
    CASE kind WHEN 0 THEN 'beacon' WHEN 1 THEN 'deauth' WHEN 2 THEN 'auth' WHEN 3 THEN 'qos_data' WHEN 5 THEN 'block_ack' END AS subtype,
    CASE WHEN kind = 4 THEN NULL WHEN kind = 3 THEN 'data' WHEN kind = 5 THEN 'control' ELSE 'management' END AS type,
    CASE WHEN kind IN (0, 1, 2, 3) THEN network END AS bssid, CASE WHEN kind = 0 THEN 'net-' || (u % 50) END AS ssid,
    CASE WHEN kind <> 4 THEN u % 13 + 1 END AS channel, CASE WHEN kind <> 4 THEN 2412 + 5 * (u % 13) END AS freq, CASE WHEN kind <> 4 THEN -30 - u % 60 END AS rssi_dbm,
    CASE WHEN kind IN (0, 1, 2, 3) THEN e % 4096 END AS seq, CASE WHEN kind <> 4 THEN kind = 1 END AS retry,
    CASE WHEN kind = 2 THEN k % 18 END AS status_code, CASE WHEN kind = 1 THEN e % 67 END AS reason_code, CASE WHEN kind = 3 THEN k % 4 + 1 END AS eapol_msg,
    CASE WHEN kind = 0 THEN e END AS timestamp, CASE WHEN kind = 0 THEN 100 END AS beacon_interval, CASE WHEN kind = 2 THEN k % 2 + 1 END AS auth_seq,
    CASE WHEN kind = 4 THEN NULL WHEN kind = 0 THEN 'ff:ff:ff:ff:ff:ff,' || network || ',' || network WHEN kind = 5 THEN client || ',' || network ELSE client || ',' || network || ',' || network END AS addrs,
    CASE WHEN kind = 4 THEN NULL WHEN kind = 0 THEN 2 ELSE 0 END AS n_elements, CASE WHEN kind = 4 THEN NULL WHEN kind = 3 THEN 26 WHEN kind = 5 THEN 16 ELSE 24 END AS header_len, network, client
  FROM f
  UNION ALL BY NAME SELECT user_id::VARCHAR AS path, count(*) + 1 AS frame, 'truncated input' AS error FROM events WHERE user_id % 10 = 0 GROUP BY user_id) """


@query("q43_decoded_frames", _FRAMES + "SELECT path, frame, coalesce(ts_ns, 0) AS ts_ns, error, type, subtype, bssid, ssid, channel, freq, rssi_dbm, seq, retry, status_code, reason_code, eapol_msg, timestamp, beacon_interval, auth_seq, addrs, n_elements, header_len FROM d")
def q43_decoded_frames(spark, sf_dir):
    plain = ["path", "frame", "error", "type", "subtype", "bssid", "ssid", "channel", "freq", "rssi_dbm", "seq", "retry", "status_code", "reason_code", "eapol_msg", "beacon_interval", "auth_seq", "header_len"]
    return decoded(spark, sf_dir).select(*plain, F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"), F.col("timestamp").cast("bigint").alias("timestamp"), F.array_join("addrs", ",").alias("addrs"), F.when(F.col("error").isNull(), F.size("ies")).alias("n_elements"))


@query("q44_capture_totals", _FRAMES + "SELECT path, count(*) AS frames, count(*) FILTER (WHERE error IS NULL) AS parsed, count(error) AS errors FROM d GROUP BY path")
def q44_capture_totals(spark, sf_dir):
    return frames.capture_totals(decoded(spark, sf_dir))


@query(
    "q45_networks",
    _FRAMES
    + """SELECT path, bssid, count(*) AS frames, max_by(channel, frame) AS channel, max_by(ssid, frame) FILTER (WHERE ssid IS NOT NULL) AS ssid, count(rssi_dbm) AS rssi_n,
         min(rssi_dbm) AS rssi_min, max(rssi_dbm) AS rssi_max, avg(rssi_dbm) AS rssi_mean, min(frame) AS first_frame FROM d WHERE bssid IS NOT NULL GROUP BY path, bssid""",
)
def q45_networks(spark, sf_dir):
    return frames.network_summary(decoded(spark, sf_dir))


@query(
    "q46_handshakes",
    _FRAMES
    + """SELECT path, client, bssid, bit_or(1 << (eapol_msg - 1)) AS mask, count(*) FILTER (WHERE eapol_msg = 1) AS m1, count(*) FILTER (WHERE eapol_msg = 2) AS m2,
         count(*) FILTER (WHERE eapol_msg = 3) AS m3, count(*) FILTER (WHERE eapol_msg = 4) AS m4, min(frame) AS first_frame, bit_or(1 << (eapol_msg - 1)) = 15 AS complete
         FROM d WHERE eapol_msg IS NOT NULL GROUP BY path, client, bssid""",
)
def q46_handshakes(spark, sf_dir):
    return frames.handshakes(decoded(spark, sf_dir))


@query("q47_reasons", _FRAMES + "SELECT path, subtype, reason_code, count(*) AS n FROM d WHERE reason_code IS NOT NULL GROUP BY ALL")
def q47_reasons(spark, sf_dir):
    return frames.reason_histogram(decoded(spark, sf_dir))


@query(
    "q48_frame_json",
    _FRAMES
    + """SELECT path, frame, CASE WHEN error IS NOT NULL THEN printf('{"frame":%d,"ts":', frame) || coalesce(printf('%d.%09d', ts_ns // 1000000000, ts_ns % 1000000000), 'null') || ',"error":"truncated input"}'
         ELSE printf('{"frame":%d,"ts":%d.%09d,"rssi_dbm":%d,"freq":%d,"channel":%d,"type":"%s","subtype":"%s",', frame, ts_ns // 1000000000, ts_ns % 1000000000, rssi_dbm, freq, channel, type, subtype)
              || CASE subtype WHEN 'beacon' THEN '"type_id":0,"subtype_id":8' WHEN 'deauth' THEN '"type_id":0,"subtype_id":12' WHEN 'auth' THEN '"type_id":0,"subtype_id":11' WHEN 'qos_data' THEN '"type_id":2,"subtype_id":8' ELSE '"type_id":1,"subtype_id":9' END
              || ',"addrs":["' || replace(addrs, ',', '","') || '"],"bssid":' || coalesce('"' || bssid || '"', 'null') || ',"ssid":' || coalesce('"' || ssid || '"', 'null') || ',"seq":' || coalesce(seq::VARCHAR, 'null') || ',"retry":' || retry::VARCHAR
              || ',"protected":false,"status_code":' || coalesce(status_code::VARCHAR, 'null') || ',"reason_code":' || coalesce(reason_code::VARCHAR, 'null') || ',"eapol_msg":' || coalesce(eapol_msg::VARCHAR, 'null')
              || ',"ie_summary":[' || CASE WHEN ssid IS NULL THEN '' ELSE printf('{"id":0,"name":"ssid","len":%d},{"id":3,"name":"ds_parameter_set","len":1}', length(ssid)) END || ']}' END AS json FROM d""",
)
def q48_frame_json(spark, sf_dir):
    return frames.frame_json(decoded(spark, sf_dir))


@query(
    "q49_decode_checksum",
    _FRAMES
    + """SELECT path, count(*) FILTER (WHERE error IS NULL) AS accepted, count(error) AS rejected,
         coalesce(sum(CASE subtype WHEN 'beacon' THEN 128 + 2 WHEN 'deauth' THEN 2240 WHEN 'auth' THEN 176 WHEN 'qos_data' THEN 648 WHEN 'block_ack' THEN 148 END + coalesce(seq * 16, 0))::BIGINT, 0) AS checksum
         FROM d GROUP BY path""",
)
def q49_decode_checksum(spark, sf_dir):
    return frames.decode_checksum(decoded(spark, sf_dir))


@query("q50_decoder_faults", _FRAMES + "SELECT count(*) AS frames, 0 AS faulty FROM d")
def q50_decoder_faults(spark, sf_dir):
    """How many frames there are, and how many break the decoder's promises: none may."""
    packets = packets_of(captures(spark, sf_dir))
    found = frames.decode_frames(packets)
    faulty = frames.decoder_faults(found, packets).agg(F.count("*").cast("int").alias("faulty"))
    return found.agg(F.count("*").alias("frames")).join(F.broadcast(faulty), how="cross")  # one row each


@query("q51_listed_frames", _FRAMES + "SELECT path, frame, subtype, reason_code FROM d WHERE subtype = 'deauth' ORDER BY path, frame LIMIT 50")
def q51_listed_frames(spark, sf_dir):
    return frames.list_frames(decoded(spark, sf_dir), subtype="deauth", has_reason=True).select("path", "frame", "subtype", "reason_code")
