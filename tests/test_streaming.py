"""Keyed state with timers: streams against the batch fold, restarts, late rows, re-activation and expiry."""

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ventura.plans.model import Tables
from ventura.sources import sinks
from ventura.streaming import health as H

DIR = "/root/testdata/sf0.001"
SCHEMA = "event_id long, site long, finished_at timestamp, status string"
COLUMNS = ["site", *H.Health.__annotations__]


def write(spark, folder, rows):
    """One file, and so one micro-batch; rows are (event_id, site, microseconds, status)."""
    made = spark.createDataFrame(rows, "event_id long, site long, at long, status string")
    made.select("event_id", "site", F.timestamp_micros("at").alias("finished_at"), "status").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def last_states(table):
    """The last row of each site."""
    out = {}
    for r in table.collect():
        if r["site"] not in out or r["as_of"] > out[r["site"]]["as_of"]:
            out[r["site"]] = r
    return {k: tuple(r[c] for c in COLUMNS) for k, r in out.items()}


names = (f"stream{k}" for k in itertools.count())


def test_stream_equals_batch_on_shuffled_input(spark, tmp_path):
    table = Tables(spark, DIR).runs.withColumn("status", F.when(F.col("site") % 4 == 0, "error").otherwise(F.col("status")))
    runs = table.select("event_id", "site", F.unix_micros(F.col("finished_at").cast("timestamp")).alias("at"), "status").collect()
    rnd = random.Random(4)
    runs = sorted(runs, key=lambda r: r["at"] + rnd.random() * 20 * 3_600_000_000)  # up to 20 hours out of order
    folder = str(tmp_path / "in")
    for k in range(0, len(runs), 250):
        write(spark, folder, [tuple(r) for r in runs[k : k + 250]])
    end = max(r["at"] for r in runs)
    write(spark, folder, [(10**9, -1, end + 200 * H.DAY, "success")])  # all exclusions are over
    write(spark, folder, [(10**9 + 1, -1, end + 202 * H.DAY, "success")])
    got = last_states(H.run_available(H.stream_health(read(spark, folder)), next(names), str(tmp_path / "check"), "update"))
    got.pop(-1)
    batch = H.reactivate(H.batch_health(table), end + 199 * H.DAY)
    assert got == {r["site"]: tuple(r[c] for c in COLUMNS) for r in batch.collect()}
    assert sum(s[1] == "pending" for s in got.values()) > 3


D = H.DAY


def test_restart_late_rows_reactivation_and_expiry(spark, tmp_path):
    folder, out, check, keep = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), 400 * D
    seen = set()

    def drive():
        """One run of the query to the end of its input; the states it told of."""
        sinks.stream_parts(H.stream_health(read(spark, folder), keep=keep), out, check, "update").awaitTermination()
        told = sinks.read_parts(spark, out, f"site long, {H.STATE}, as_of long")
        fresh = told.filter(~F.col("shard").isin(*seen)) if seen else told
        states = last_states(fresh)
        seen.update(r["shard"] for r in told.select("shard").distinct().collect())
        return states

    write(spark, folder, [(3, 1, 12 * D, "error"), (1, 1, 10 * D, "error"), (2, 1, 11 * D, "error"), (4, 2, 10 * D, "success")])
    write(spark, folder, [(5, 9, 14 * D, "success")])
    first = drive()
    assert first[1][1:3] == ("excluded", 3) and first[1][6] == 102 * D and first[2][1] == "healthy"
    # a restart from the checkpoint: site 1 is excluded until day 102, and a row of day 5 is too late for site 2
    write(spark, folder, [(6, 2, 5 * D, "error"), (7, 9, 101 * D, "success")])
    write(spark, folder, [(8, 9, 104 * D, "success")])
    second = drive()
    assert second[1][1:3] == ("pending", 0) and second[1][5] == 102 * D and 2 not in second
    # after 400 silent days a site is forgotten: its next run is its first
    write(spark, folder, [(9, 9, 500 * D, "success")])
    write(spark, folder, [(10, 1, 502 * D, "error"), (11, 2, 502 * D, "success")])
    write(spark, folder, [(12, 9, 505 * D, "success")])
    third = drive()
    assert third[1][1:4] == ("broken", 1, 1) and third[2][3] == 1
    state = spark.read.format("statestore").option("path", check).option("stateVarName", "health").load()
    assert state.count() == 3
    batch = {r["site"]: tuple(r[c] for c in COLUMNS) for r in H.batch_health(spark.read.parquet(folder).filter("event_id <> 6"), keep).collect()}
    assert {k: batch[k] for k in (1, 2)} == {k: third[k] for k in (1, 2)}


def test_changes_are_told_once_across_restarts(spark, tmp_path):
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    rnd = random.Random(2)
    rows = [(k, k % 3, 10 * D + k * D // 4, rnd.choice(["success", "error"])) for k in range(60)]
    for k in range(0, 60, 10):
        part = rows[k : k + 10]
        write(spark, folder, rnd.sample(part, len(part)) + part[:2])  # delivered twice
        if k % 20:
            sinks.stream_parts(H.stream_changes(read(spark, folder)), out, check).awaitTermination()
    write(spark, folder, [(999, 9, 90 * D, "success")])
    sinks.stream_parts(H.stream_changes(read(spark, folder)), out, check).awaitTermination()
    found = [tuple(r)[:4] for r in sinks.read_parts(spark, out, "site long, event_id long, before string, status string").collect()]
    want = []
    for site in range(3):
        own = [r for r in rows if r[1] == site]
        want += [(site, b[0], a[3], b[3]) for a, b in zip(own, own[1:]) if a[3] != b[3]]
    assert sorted(found) == sorted(want) and len(want) > 10


def test_batch_fold_holds_no_site_and_takes_awkward_rows(spark):
    rows = [Row(event_id=k, site=7, at=k * D, status="success") for k in range(30_000)] + [Row(event_id=1, site=None, at=None, status=None), Row(event_id=2, site=8, at=5, status="error")]
    df = spark.createDataFrame(rows, "event_id long, site long, at long, status string").select("event_id", "site", F.timestamp_micros("at").alias("finished_at"), "status")
    got = {r["site"]: r for r in H.batch_health(df).collect()}
    assert got[7]["runs"] == 30_000 and got[8]["status"] == "broken" and got[None]["runs"] == 1
    assert H.batch_health(df.limit(0)).count() == 0


@pytest.mark.parametrize(("results", "want"), [("EEE", ("excluded", 3)), ("EES", ("healthy", 0)), ("ZZ", ("degraded", 2)), ("EEEE", ("excluded", 4))])
def test_steps(results, want):
    state = H.Health()
    for k, r in enumerate(results):
        state = H.after(state, k * D, {"E": "error", "S": "success", "Z": "zero_result"}[r])
    assert (state.status, state.failures) == want
    assert H.after(state, 10_000 * D, "error").runs == 1


def test_cooldown_of_a_week_on_both_sides(spark):
    """Success a week before the date, an hour less, never; a later failure changes nothing."""
    import types

    from ventura.plans.streams import r04

    rows = [(1, "2024-01-24 00:00:00", "success"), (2, "2024-01-24 01:00:00", "success"), (3, "2024-01-30 00:00:00", "error"), (1, "2024-01-30 00:00:00", "error"), (2, "2023-01-01 00:00:00", "success")]
    runs = spark.createDataFrame(rows, "site long, at string, status string").select("site", F.col("at").cast("timestamp_ntz").alias("finished_at"), "status")
    assert {r["site"] for r in r04(types.SimpleNamespace(runs=runs)).collect()} == {1, 3}
