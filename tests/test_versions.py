"""The store under writers that interleave at every step; runs and caches as logs."""

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import store
from sourceloom.sources import versions

STEPS = ("based", "checked", "written", "published")


def report(spark, research):
    analysis = spark.createDataFrame([(research, "trends", 0, 1, f"T {research}", "s", None, None, ["a"])], "research_id string, section string, at int, n int, title string, summary string, company string, event_date string, ids array<string>")
    companies = spark.createDataFrame([(research, 0, "Acme", ["Acme"], "acme.com", None, None, ["a"])], "research_id string, pos int, name string, names array<string>, domain string, country string, focus string, ids array<string>")
    return analysis, companies, spark.createDataFrame([(research, "a")], "research_id string, id string")


@pytest.mark.parametrize("at", STEPS)
@pytest.mark.parametrize("same", [True, False])
def test_two_writers_at_every_step(spark, tmp_path, at, same):
    """A second writer saves its whole report between two steps of the first: one report a research, none lost."""
    root = f"file://{tmp_path}/store"
    store.Store(spark, root).save_report(*report(spark, "before"))

    class First(store.Store):
        def step(self, name):
            if name == at:
                try:
                    store.Store(spark, root).save_report(*report(spark, "r" if same else "other"))
                    said.append("second saved")
                except ValueError:
                    said.append("second refused")

    said = []
    try:
        First(spark, root).save_report(*report(spark, "r"))
        said.append("first saved")
    except ValueError:
        said.append("first refused")
    box = store.Store(spark, root)
    want = {"before", "r"} | (set() if same else {"other"})
    for table in ("reports", "findings", "entities", "finding_sources"):
        assert sorted(r.research_id for r in box.read(table).collect()) == sorted(want), table
    if same:
        assert said == (["second refused", "first saved"] if at == "published" else ["second saved", "first refused"])
    else:
        assert said == ["second saved", "first saved"]


def test_a_save_on_an_older_version_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = lambda x: {"t": spark.createDataFrame([(x,)], "x int")}

    class Slow(versions.Store):
        def step(self, name):
            if name == "written":
                versions.Store(spark, root).save(one(2))

    with pytest.raises(versions.Conflict):
        Slow(spark, root).save(one(1))
    box = versions.Store(spark, root)
    assert [r.x for r in box.read("t").collect()] == [2] and box.last().number == 1


def test_versions_share_segments(spark, tmp_path):
    box = versions.Store(spark, f"file://{tmp_path}/store")
    one = lambda x: {"t": spark.createDataFrame([(x,)], "x int")}
    assert box.version() is None and not box.has("t")
    box.save(one(1))
    first = box.last()
    for x in (2, 3):
        box.append(one(x), lambda at: None)
    box.save({"u": spark.createDataFrame([(9, "k")], "y int, p string")}, {"u": "p"})
    assert box.last().number == 4 and box.last().tables["t"][0] == first.tables["t"][0] and len(box.last().tables["t"]) == 3
    assert sorted(r.x for r in box.read("t").collect()) == [1, 2, 3] and [r.x for r in box.read("t", first).collect()] == [1]
    assert box.read("u").collect()[0].p == "k"

    class Busy(versions.Store):
        def write(self, tables, partition_by=None):
            out = super().write(tables, partition_by)
            box.append(one(4), lambda at: None)  # rows that come while the old ones are rewritten
            return out

    Busy(spark, box.root).compact("t", 1)
    assert len(box.last().tables["t"]) == 2 and sorted(r.x for r in box.read("t").collect()) == [1, 2, 3, 4]
    assert box.compact("u") is None

    class Refused(versions.Store):
        def publish(self, base, tables):
            raise versions.Conflict("always")

    with pytest.raises(versions.Conflict, match="3 tries"):
        Refused(spark, box.root).append(one(5), lambda at: None, tries=3)


def test_runs_as_a_log(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    start = spark.createDataFrame([("a", 1), ("b", 1)], "research_id string, seq long")
    log = store.run_update(start, now, status=F.lit("planning"))
    log = log.unionByName(store.run_update(log.select("research_id", "seq"), now, constraints=F.lit("{}")))
    after = spark.createDataFrame([("a", 3)], "research_id string, seq long")
    log = log.unionByName(store.completed(after, now)).unionByName(store.failed(start.where("research_id = 'b'").withColumn("seq", F.lit(3)), now, F.lit("no source")))
    got = {r.research_id: r for r in store.run_state(log).collect()}
    assert (got["a"].status, got["a"].constraints, got["a"].error_message, got["a"].seq) == ("completed", "{}", None, 4) and got["a"].completed_at
    assert (got["b"].status, got["b"].constraints, got["b"].error_message) == ("failed", "{}", "no source") and got["b"].completed_at
    with pytest.raises(KeyError, match="mood"):
        store.run_update(start, now, mood=F.lit("x"))


def test_cache_writes_what_was_missing(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    entries = spark.createDataFrame([("p", "a", "old", "2026-01-01 10:00:00", "2026-01-01 13:00:00"), ("p", "b", "old", "2026-01-01 10:00:00", "2026-01-01 11:00:00"), ("q", "a", "other", "2026-01-01 10:00:00", "2026-01-01 13:00:00")], "provider string, cache_key string, response string, f string, e string")
    entries = entries.select("provider", "cache_key", "response", F.col("f").cast("timestamp").alias("fetched_at"), F.col("e").cast("timestamp").alias("expires_at"))
    requests = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b"), ("p", "c")], "provider string, cache_key string")
    fetched = spark.createDataFrame([("p", "a", "new"), ("p", "b", "new"), ("p", "x", "new")], "provider string, cache_key string, response string")
    answers, added = store.through_cache(requests, entries, fetched, now, F.lit(60))
    assert sorted(map(tuple, answers.collect())) == [("p", "a", "old", True), ("p", "b", "new", False)]
    (row,) = added.collect()
    assert (row.cache_key, row.response, (row.expires_at - row.fetched_at).total_seconds()) == ("b", "new", 60)
    again = entries.unionByName(added)
    assert {(r.provider, r.cache_key): r.response for r in store.cache_fresh(again, now).collect()} == {("p", "a"): "old", ("p", "b"): "new", ("q", "a"): "other"}
    assert store.cache_sweep(again, now).count() == 3
