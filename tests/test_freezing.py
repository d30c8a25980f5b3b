"""Trees of digests: what was changed, added and removed is named, and nothing else."""

import hashlib

import pytest
from pyspark.sql import functions as F

from framescope.operators import freezing

FILES = "grp string, name string, digest string"


def tree(spark, rows, tmp_path, name, **more):
    freezing.freeze_tree(spark.createDataFrame(rows, FILES), **more).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_differences_are_named(spark, tmp_path):
    rows = [("rules" if k % 5 else "prompts", f"dir{k % 7}/file {k}.txt", f"{k:064x}") for k in range(800)]
    frozen = tree(spark, rows, tmp_path, "a")
    depth = freezing.tree_depth(frozen)
    assert depth == 2 and frozen.where("level = 0").count() == 2
    assert freezing.frozen_changes(frozen, tree(spark, rows[::-1], tmp_path, "same", depth=depth)).isEmpty()
    freezing.verify_frozen(frozen, spark.read.parquet(str(tmp_path / "same")), ["rules", "prompts"])
    other = [(g, n, "f" * 64 if n.endswith((" 3.txt", " 700.txt")) else d) for g, n, d in rows if not n.endswith((" 10.txt", " 11.txt"))] + [("rules", "new", "1" * 64), ("models", "m.json", "2" * 64)]
    present = tree(spark, other, tmp_path, "b", depth=depth)
    found = sorted(map(tuple, freezing.frozen_changes(frozen, present).collect()))
    assert found == sorted([("rules", "dir3/file 3.txt", "changed"), ("prompts", "dir0/file 700.txt", "changed"), ("prompts", "dir3/file 10.txt", "removed"), ("rules", "dir4/file 11.txt", "removed"), ("rules", "new", "added"), ("models", "m.json", "added")])
    with pytest.raises(ValueError, match="models, prompts, rules"):
        freezing.verify_frozen(frozen, present)
    with pytest.raises(ValueError, match="settings"):
        freezing.verify_frozen(frozen, frozen, ["settings"])
    with pytest.raises(ValueError, match="depth"):
        freezing.frozen_changes(frozen, tree(spark, rows, tmp_path, "c", depth=1))


def test_a_swap_and_a_rename_differ(spark, tmp_path):
    a = tree(spark, [("g", "x", "1"), ("g", "y", "2")], tmp_path, "a")
    b = tree(spark, [("g", "x", "2"), ("g", "y", "1")], tmp_path, "b")
    c = tree(spark, [("g", "x", "1"), ("g", "z", "2")], tmp_path, "c")
    assert sorted(map(tuple, freezing.frozen_changes(a, b).collect())) == [("g", "x", "changed"), ("g", "y", "changed")]
    assert sorted(map(tuple, freezing.frozen_changes(a, c).collect())) == [("g", "y", "removed"), ("g", "z", "added")]
    assert len({t.where("level = 0").first().digest for t in (a, b, c)}) == 3
    none = tree(spark, [], tmp_path, "none")
    assert none.isEmpty() and sorted(r.status for r in freezing.frozen_changes(a, none).collect()) == ["removed", "removed"]


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "in" / "sub" / "b.py").write_bytes(b"")
    (tmp_path / "in" / "sub" / "c.txt").write_bytes(b"no")
    found = sorted(map(tuple, freezing.file_digests(spark, str(tmp_path / "in"), "sources", "*.py").collect()))
    assert found == [("sources", "a.py", hashlib.sha256(b"x = 1\n").hexdigest()), ("sources", "sub/b.py", hashlib.sha256(b"").hexdigest())]
    docs = spark.createDataFrame([("b1", '{"b": 1, "a": [1, 2]}'), ("b2", '{"a":[1,2],"b":1}')], "id string, entry string")
    told = freezing.entry_digests(docs, "test_manifest", F.col("id"), F.col("entry")).collect()
    assert told[0].digest == told[1].digest == hashlib.sha256(b'{"a":[1,2],"b":1}').hexdigest() and [r.name for r in told] == ["b1", "b2"]
