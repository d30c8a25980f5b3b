"""A recorder's stream against the batch form: restarts, late and disordered lines, and snapshots while it goes on."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framescope.operators import bundles
from framescope.streaming import recorder

LINES = "bundle_id string, source string, line long, text string, unix_ns long, monotonic_ns long, ends boolean"
END = (1_700_000_000_000_000_000, 5_000)


def lines(seed, bundle):
    rng = random.Random(seed)
    out = []
    for k in range(1, 60):
        text = rng.choice(["plain", f"{1_699_999_999 + k // 20}.5: own time", "", "999999999999: far", None])
        wall = None if k % 17 == 0 else END[0] - 30 * 10**9 + k * 10**9 + rng.randint(-(10**9), 10**9)
        out.append(dict(bundle_id=bundle, source="hostapd", line=k, text=text, unix_ns=wall, monotonic_ns=k * 100 + rng.randint(0, 300), ends=False))
    return out


@pytest.fixture
def recording(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: recorder.record_lines(spark.readStream.schema(LINES).json(str(tmp_path / "in")))

    def take(name, rows):
        (tmp_path / f"{name}.tmp").write_text("".join(json.dumps(r) + "\n" for r in rows))
        (tmp_path / f"{name}.tmp").rename(tmp_path / "in" / name)
        query = recorder.write_versions(stream(), str(tmp_path / "out"), str(tmp_path / "at"))  # a new query each time: state comes from the checkpoint
        assert query.awaitTermination(180) and query.exception() is None
        return recorder.versions(str(tmp_path / "out"))

    return take, str(tmp_path / "out")


def by_batch(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], LINES)
    cut = bundles.window_cut(df, F.col("unix_ns"), F.col("monotonic_ns"), F.lit(END[0]), F.lit(END[1]), F.col("text"))
    return df.withColumn("cut", cut).groupBy("bundle_id", "source").agg(F.count_if(F.expr("cut is null")).alias("kept"), F.count_if(F.expr("cut is not null")).alias("omitted"))


def test_stream_counts_as_the_batch(spark, recording):
    take, folder = recording
    one, two = lines(1, "a"), lines(2, "b")
    random.Random(3).shuffle(two)
    end = lambda b, **more: dict(bundle_id=b, source="hostapd", line=None, text=None, unix_ns=END[0], monotonic_ns=END[1], ends=True) | more
    assert take("1.json", one[:20] + two[:30]) == [0]  # no end is known yet
    assert recorder.snapshot(spark, folder, 0).count() == 0
    assert take("2.json", [end("a"), *one[20:40]]) == [0, 1]
    early = sorted(map(str, recorder.snapshot(spark, folder, 1).collect()))
    assert take("3.json", [*two[30:50], end("b"), end("a", unix_ns=1)]) == [0, 1, 2]
    assert take("4.json", one[40:] + two[50:]) == [0, 1, 2, 3]
    assert sorted(map(str, recorder.snapshot(spark, folder, 1).collect())) == early and early
    whole = recorder.snapshot(spark, folder, 3)
    found = {r.bundle_id: (r.kept, r.omitted) for r in recorder.log_counts(whole).collect()}
    wanted = {r.bundle_id: (r.kept, r.omitted) for r in by_batch(spark, one + two).collect()}
    assert found == wanted and all(min(v) > 0 for v in found.values())
    kept = sorted((r.bundle_id, r.line, r.text, r.unix_ns) for r in whole.where("line is not null").collect())
    assert [len([k for k in kept if k[0] == b]) for b in "ab"] == [wanted[b][0] for b in "ab"] and len(set(kept)) == len(kept)
    with pytest.raises(LookupError):
        recorder.snapshot(spark, folder, 4)
    digest = bundles.log_snapshots(whole.where("line is not null"), ["bundle_id"], "line", "text")
    assert {r.bundle_id: r.line_count for r in digest.collect()} == {b: wanted[b][0] for b in "ab"}


def test_receipts_that_go_back_are_counted(spark, recording):
    take, folder = recording
    rows = [dict(bundle_id="a", source="s", line=k, text="x", unix_ns=1, monotonic_ns=m, ends=False) for k, m in enumerate((5, 7, 6, 9, 8))]
    take("1.json", [*rows, dict(bundle_id="a", source="s", line=None, text=None, unix_ns=2, monotonic_ns=100, ends=True)])
    assert [tuple(r)[2:] for r in recorder.log_counts(recorder.snapshot(spark, folder, 0)).collect()] == [(5, 0, 2)]
