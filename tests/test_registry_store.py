"""The registry as runs in buckets: repeated and lost batches, compaction, pruning."""

import pytest

from gatewarden.operators import registry
from gatewarden.sources.registry_store import RegistryStore

SCHEMA = "full_name string, processed_at string, success boolean, message string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "full_name", "cast(processed_at as timestamp) processed_at", "success", "message")


def outcomes(spark, names, day, extra=()):
    return table(spark, [(n, f"2024-01-{day:02}", day % 2 == 0, f"d{day}") for n in names] + list(extra))


def bag(df):
    return sorted(map(str, df.select("full_name", "processed_at", "success", "message").collect()))


BATCHES = [range(0, 40), range(30, 50), range(0, 3), range(45, 60)]


def batch(spark, i):
    return outcomes(spark, [f"o/r{n}" for n in BATCHES[i]], 10 - i if i == 1 else 10 + i)


@pytest.mark.parametrize("max_runs", [2, 3, 100])
def test_batches_equal_one_upsert(spark, tmp_path, max_runs):
    store = RegistryStore(spark, str(tmp_path), 5)
    expected = table(spark, [])
    for i in range(len(BATCHES)):
        assert store.apply(batch(spark, i), "s", i, max_runs)
        # The same batch again, and an earlier one, change nothing.
        version = store.versions()[-1]
        assert not store.apply(batch(spark, i), "s", i, max_runs)
        assert not store.apply(batch(spark, 0), "s", 0, max_runs)
        assert store.versions()[-1] == version
        expected = registry.upsert(expected, batch(spark, i))
        assert bag(store.read()) == bag(expected)
        assert all(len(runs) < max(max_runs, 2) for runs in store.state()["runs"].values())


def test_a_batch_lost_before_its_version_is_not_seen(spark, tmp_path, monkeypatch):
    store = RegistryStore(spark, str(tmp_path), 4)
    store.apply(batch(spark, 0), "s", 0)
    before = bag(store.read())

    def lost(state):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.apply(outcomes(spark, ["x/half"], 20), "s", 1)
    again = RegistryStore(spark, str(tmp_path))
    assert bag(again.read()) == before and again.state()["buckets"] == 4
    # The next attempt of that batch writes over what was left.
    assert again.apply(batch(spark, 3), "s", 1)
    assert bag(again.read()) == bag(registry.upsert(batch(spark, 0), batch(spark, 3)))


def test_two_writers_do_not_write_one_version(spark, tmp_path, monkeypatch):
    store = RegistryStore(spark, str(tmp_path), 4)
    store.apply(batch(spark, 0), "s", 0)
    state = store.state()
    store.apply(batch(spark, 3), "s", 1)
    expected = bag(store.read())
    monkeypatch.setattr(RegistryStore, "state", lambda self, version=None: state)
    with pytest.raises(RuntimeError, match="someone else"):
        store.apply(outcomes(spark, ["x/y"], 20), "t", 0)
    monkeypatch.undo()
    assert bag(store.read()) == expected


def test_look_ups_read_only_their_buckets(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path), 16)
    store.apply(batch(spark, 0), "s", 0)
    store.apply(batch(spark, 3), "s", 1)
    names = spark.createDataFrame([("o/r1",), ("o/r50",), ("o/none",), ("o/r1",)], "full_name string")
    found = store.lookup(names)
    assert sorted(r.full_name for r in found.collect()) == ["o/r1", "o/r50"]
    files = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    assert files <= set(store.touched(names)) and len(store.touched(names)) <= 3
    assert [r.full_name for r in store.pending(names).distinct().collect()] == ["o/none"]


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path), 4)
    for i in range(len(BATCHES)):
        store.apply(batch(spark, i), "s", i, max_runs=3)
    expected, last = bag(store.read()), store.versions()[-1]
    earlier = bag(store.read(last - 1))
    store.vacuum(keep=2)
    assert store.versions() == [last - 1, last]
    assert bag(store.read()) == expected and bag(store.read(last - 1)) == earlier
    store.vacuum(keep=1)
    named = {run for runs in store.state()["runs"].values() for run in runs}
    assert {p.name for p in (tmp_path / "runs").iterdir()} == named and bag(store.read()) == expected


def test_edges(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path), 3)
    assert store.read().count() == 0 and store.lookup(table(spark, [])).count() == 0
    assert store.apply(table(spark, []), "s", 0)
    rows = [(None, "2024-01-01", True, "n"), ("a/a", None, None, None), ("a/a", None, None, None), ("a/b", "2024-01-01", True, "x" * 100_000)]
    store.apply(table(spark, rows).selectExpr("*", "7 as bucket", "'r' as run"), "s", 1)
    store.apply(table(spark, rows), "other", 0, max_runs=2)
    assert bag(store.read()) == bag(registry.latest(table(spark, rows))) and store.read().count() == 3
