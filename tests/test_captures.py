"""Captures written, indexed, read in slices and as they grow."""

import hashlib
import itertools
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framescope.operators import captures
from framescope.sources import capture_index, capture_sink, pcap
from framescope.streaming import captures as streamed

FORMS = list(itertools.product("<>", (1000, 1)))


def capture(order="<", unit=1000, packets=(), link=105, snaplen=65535):
    magic = 0xA1B2C3D4 if unit == 1000 else 0xA1B23C4D
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 7, snaplen, link)
    return head + b"".join(struct.pack(order + "IIII", ts // 10**9, ts % 10**9 // unit, len(d), len(d) + 3) + d for ts, d in packets)


def packets(n, first=1_700_000_000 * 10**9):
    return [(first + k * 10**6, bytes([k % 256]) * (k % 50)) for k in range(n)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k, (order, unit) in enumerate(FORMS):
        (tmp_path / "in" / f"c{k}.pcap").write_bytes(capture(order, unit, packets(40 + k)))
    return tmp_path


def raw(spark, path):
    return pcap.raw_records(spark.read.format("binaryFile").load(str(path)).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))


def test_trimmed_captures_are_the_inputs_bytes(spark, folder):
    (folder / "in" / "cut.pcap").write_bytes(capture(packets=packets(5))[:-3])
    (folder / "in" / "head.pcap").write_bytes(capture())
    end = packets(1)[0][0] + 20 * 10**6
    ends = spark.createDataFrame([(p.name, end) for p in (folder / "in").iterdir() if p.name != "c3.pcap"], "path string, end_ns long")
    kept, report = captures.trim_captures(raw(spark, folder / "in"), ends)
    assert {r.path: tuple(r)[1:] for r in report.collect()} == {**{f"c{k}.pcap": (21, 19 + k, None) for k in range(3)}, "c3.pcap": (None, None, "no end"), "cut.pcap": (None, None, "truncated input"), "head.pcap": (0, 0, None)}
    capture_sink.write_captures(kept, str(folder / "out"))
    listed = {r.path: r for r in capture_sink.written_captures(spark, str(folder / "out")).collect()}
    assert set(listed) == {"c0.pcap", "c1.pcap", "c2.pcap", "head.pcap"}
    for k, (order, unit) in enumerate(FORMS[:3]):
        written = (folder / "out" / listed[f"c{k}.pcap"].file).read_bytes()
        assert written == capture(order, unit, packets(21)) and listed[f"c{k}.pcap"].sha256 == hashlib.sha256(written).hexdigest()
        assert (listed[f"c{k}.pcap"].frames, listed[f"c{k}.pcap"].bytes) == (21, len(written))
    assert (folder / "out" / listed["head.pcap"].file).read_bytes() == capture()
    assert (folder / "out" / "_SUCCESS").exists() and not list((folder / "out").glob("_temporary*"))


def test_nothing_is_visible_after_a_failed_task(spark, folder):
    rows = raw(spark, folder / "in").drop("ts_ns", "scan_error")
    bad = rows.unionByName(spark.createDataFrame([("z", 0, bytearray(b"h")), ("z", 1, bytearray(b"x")), ("z", 1, bytearray(b"x"))], "path string, frame long, record binary"))
    with pytest.raises(PySparkException, match="must begin with frame 0 and ascend"):
        capture_sink.write_captures(bad, str(folder / "out"))
    assert not (folder / "out").exists() or not [p for p in (folder / "out").rglob("*") if p.is_file()]
    with pytest.raises(PySparkException):
        capture_sink.write_captures(rows.where("frame > 0"), str(folder / "out"))
    capture_sink.write_captures(rows, str(folder / "out"))
    capture_sink.write_captures(rows.where("path = 'c0.pcap'"), str(folder / "out"))
    assert capture_sink.written_captures(spark, str(folder / "out")).count() == 5
    capture_sink.write_captures(rows.where("path <> 'c0.pcap'"), str(folder / "out"), "overwrite")
    assert sorted(r.path for r in capture_sink.written_captures(spark, str(folder / "out")).collect()) == ["c1.pcap", "c2.pcap", "c3.pcap"]


def test_slices_read_as_the_whole(spark, folder):
    (folder / "in" / "cut.pcap").write_bytes(capture(packets=packets(30))[:-3])
    (folder / "in" / "long.pcap").write_bytes(capture(packets=[(t, d * 9) for t, d in packets(700)]))
    (folder / "in" / "none.pcap").write_bytes(capture())
    (folder / "in" / "odd.pcap").write_bytes(b"\0" * 30)
    (folder / "in" / "link.pcap").write_bytes(capture(link=1))
    (folder / "in" / "wrong.pcap").write_bytes(capture(packets=packets(9)) + struct.pack("<IIII", 1, 2_000_000, 0, 0) + b"rest")
    path = str(folder / "in")
    capture_index.index_captures(spark, path, slice_bytes=1000).write.parquet(str(folder / "index"))
    index = spark.read.parquet(str(folder / "index"))
    assert index.where("path like '%long.pcap'").count() > 50
    found = capture_index.read_slices(index)
    assert sorted(map(str, found.collect())) == sorted(map(str, pcap.read_packets(spark, path).collect()))
    tasks = found.where("path like '%long.pcap'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_growing_captures_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = {"a.pcap": capture(packets=packets(200)), "b.pcap": capture(">", 1, packets(90)), "c.pcap": capture(packets=packets(7)) + struct.pack("<IIII", 1, 2_000_000, 0, 0) + b"more"}

    def run():
        query = streamed.stream_packets(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None

    for share in (0.003, 0.3, 0.31, 0.999, 1.0):  # cuts in headers and in records; each round starts the query anew
        for name, data in whole.items():
            (tmp_path / "in" / name).write_bytes(data[: int(len(data) * share)])
        run()
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.parquet(str(tmp_path / "out")).withColumn("path", name)
    wanted = pcap.read_packets(spark, str(tmp_path / "in")).withColumn("path", name)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_whole_files_in_folders(spark, tmp_path):
    files = [("b1/meta.json", b"{}"), ("b1/log one.txt", b""), ("b 2/meta.json", b"x" * 5000)]
    capture_sink.write_files(spark.createDataFrame(files, "path string, content binary"), str(tmp_path / "out"))
    assert {p.relative_to(tmp_path / "out").as_posix().split("/", 1)[1]: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith((".", "_", "captures"))} == {"b1/meta.json": b"{}", "b1/log%20one.txt": b"", "b%202/meta.json": b"x" * 5000}


def test_captures_reach_python_in_bounded_batches(spark):
    from framescope.sources import pcap

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pcap.packets_of(spark.createDataFrame([("a", b"")], "path string, content binary"))
    assert int(spark.conf.get(key)) <= 4 << 20
