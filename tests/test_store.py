"""The store of a fleet: versions, forgetting and compaction."""

import os

import pytest
from pyspark.sql import functions as F

from walksieve.plans.walk_run import StageTables, begin_job, end_job, inventory
from walksieve.operators import fleet
from walksieve.sources.parts import Numbers, Parts

ROWS = "walk_id long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return StageTables(spark, str(tmp_path))


def made(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def values(table):
    return sorted((r.walk_id, r.v) for r in table.collect())


def on_disk(spark, folder):
    """Every row that a plain reader finds under `folder`, whatever counts."""
    found = []
    for at, _, files in os.walk(folder):
        if any(f.endswith(".parquet") for f in files):
            found += [r.walk_id for r in spark.read.parquet(at).collect()]
    return found


def test_each_walk_has_its_newest_version(spark, store):
    store.write("t", made(spark, (1, "a"), (1, "b"), (2, "c")))
    assert values(store.write("t", made(spark, (2, "d")))) == [(2, "d")]
    store.write("t", made(spark).limit(0), made(spark, (1, "")))        # stands for walk 1, without rows
    store.write("t", made(spark, (3, "e")))
    assert values(store.read("t")) == [(2, "d"), (3, "e")]
    assert values(store.read("t", made(spark, (2, "")))) == [(2, "d")]
    # only the parts of the newest versions are opened
    files = [f for f in store.read("t").inputFiles() if "/rows/" in f]
    assert {int(f.split("/part-")[1][:12]) for f in files} == {2, 3, 4}


def test_forgetting_holds_for_every_table_and_log_and_for_the_disk(spark, store, tmp_path):
    store.write("t", made(spark, (1, "a"), (2, "b")))
    store.write("u", made(spark, (1, "c")))
    store.append("runs", made(spark, (1, "r"), (2, "s")))
    store.append("runs", made(spark, (2, "q")))
    store.forget(made(spark, (1, "")))
    assert values(store.read("t")) == [(2, "b")] and values(store.read("u")) == []
    assert values(store.log("runs")) == [(2, "q"), (2, "s")]
    # a later run of the walk counts
    store.write("t", made(spark, (1, "z")))
    assert values(store.read("t")) == [(1, "z"), (2, "b")]
    store.forget(made(spark, (1, "")))
    assert store.compact() == {"runs": 1, "t": 2, "u": 1}
    for name, want in (("t", [2]), ("u", []), ("runs", [2, 2])):
        kept = [w for part in ("rows", "log") if (tmp_path / name / part).exists() for w in on_disk(spark, tmp_path / name / part)]
        assert kept == want
    assert values(store.read("t")) == [(2, "b")] and values(store.log("runs")) == [(2, "q"), (2, "s")]
    assert store.compact() == {"runs": 0, "t": 0, "u": 0}                # nothing is left to do


def test_compaction_rewrites_what_is_outdated_and_the_small_ones_beyond(spark, store, tmp_path):
    for i in range(4):
        store.write("t", made(spark, (i, f"v{i}"), (i + 10, "x" * 1000 * i)))
    store.write("t", made(spark, (0, "new")))
    before = values(store.read("t"))
    assert store.compact() == {"t": 1} and values(store.read("t")) == before
    names = {p.name for p in Parts(spark, str(tmp_path / "t/rows")).live()}
    assert len(names) == 5 and "part-000000000002" in names
    store.compact(most=2)
    assert len(Parts(spark, str(tmp_path / "t/rows")).live()) == 2 and values(store.read("t")) == before
    # a write that began before the compaction and ends after it is there
    version = store.numbers.take()
    store._rows("t").add(made(spark, (2, "late")).withColumn("version", F.lit(version).cast("long")), version)
    store.compact(most=1)
    store._versions("t").add(made(spark, (2, "")).select("walk_id", F.lit(version).cast("long").alias("version")), version)
    assert (2, "late") in values(store.read("t"))


def test_a_writer_or_merge_that_dies_changes_nothing(spark, tmp_path):
    parts = Parts(spark, str(tmp_path / "p"))
    assert parts.read() is None
    parts.add(made(spark, (1, "a")), 1)
    parts.add(made(spark, (2, "b")), 2)
    made(spark, (9, "torn")).write.parquet(str(tmp_path / "p/part-000000000003"))
    os.remove(tmp_path / "p/part-000000000003/_SUCCESS")
    made(spark, (9, "torn")).write.parquet(str(tmp_path / "p/merged-000000000004-1"))
    assert values(parts.read()) == [(1, "a"), (2, "b")]
    parts.merge(parts.live(), parts.read(), 5)
    assert values(parts.read()) == [(1, "a"), (2, "b")] and [p.holds for p in parts.live()] == [(1, 2)]
    parts.add(made(spark, (7, "again")), 2)                             # it is in the merged part already
    assert values(parts.read()) == [(1, "a"), (2, "b")]


def test_numbers_rise_for_all_writers(spark, tmp_path):
    one, two = Numbers(spark, str(tmp_path / "n")), Numbers(spark, str(tmp_path / "n"))
    assert [one.take(), two.take(), one.take()] == [1, 2, 3]
    one.KEPT = 1
    one.trim()
    assert two.take() == 4


def test_a_dead_run_is_found_by_its_sentinel(spark, store):
    walks = made(spark, (1, ""), (2, ""), (3, "")).select("walk_id")
    begin_job(store, walks.filter("walk_id < 3"), "embed")
    end_job(store, walks.filter("walk_id = 2"))
    store.write("manifest", made(spark, (2, "m")))
    found = inventory(store, walks, walks.filter("walk_id = 1"))
    got = {(r.walk_id, r.stage, r.cause) for r in fleet.stalled_runs(found).collect()}
    assert got == {(1, "embed", "unfinished job"), (3, "stitch", "no outcome")}
