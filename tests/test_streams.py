"""Streams with state: against plain Python over the same events, cut off and taken up, and with timers that nothing but time sets off."""

import os
import random
import time
from collections import Counter

import pandas as pd
import pytest

from assayer.plans import QUERIES
from assayer.streaming import jobs

SF = "/root/testdata/sf0.001"
SCHEMA = "tenant long, at timestamp, seq long, action string, key string, worker long"
HOUR = 3_600_000


def queue_events(n=400, seed=2):
    rng, at, out = random.Random(seed), 1_700_000_000_000, []
    for i in range(n):
        at += rng.randrange(1, 2 * HOUR)
        out.append((rng.randrange(4), at, i, rng.choice(["enqueue", "enqueue", "claim", "claim", "beat", "succeed", "fail"]), rng.choice("abcde"), rng.randrange(2)))
    return out


def simulated(rows, policy, seen):
    """What a queue does, tenant by tenant, by its rules; leases that run out by the time `seen` are over."""
    out = Counter()
    for tenant in {r[0] for r in rows}:
        live, holds = {}, {}

        def over(now):
            for key, job in sorted(((k, j) for k, j in live.items() if j["until"] is not None and j["until"] <= now), key=lambda x: x[1]["until"]):
                holds.pop(job["worker"], None) if holds.get(job["worker"]) == key else None
                last = job["n"] >= policy.attempts
                out[tenant, key, job["id"], "failed" if last else "expired", job["until"], job["n"]] += 1
                job.update(until=None)
                if last:
                    del live[key]

        for _, at, seq, action, key, worker in sorted((r for r in rows if r[0] == tenant), key=lambda r: (r[1], r[2])):
            over(at)
            if action == "enqueue":
                what = "merged" if key in live else "queued"
                job = live.setdefault(key, {"id": seq, "n": 0, "until": None, "worker": None})
            elif action == "claim":
                free = sorted((j["id"], k) for k, j in live.items() if j["until"] is None)
                if not free or sum(j["until"] is not None for j in live.values()) >= policy.running:
                    continue
                key, what = free[0][1], "claimed"
                job = live[key]
                job.update(n=job["n"] + 1, until=at + policy.lease_ms, worker=worker)
                holds[worker] = key
            else:
                if worker not in holds:
                    continue
                key = holds[worker]
                job = live[key]
                if action == "beat":
                    what = "extended"
                    job["until"] = at + policy.lease_ms
                else:
                    del holds[worker]
                    again = action == "fail" and job["n"] < policy.attempts
                    what = "succeeded" if action == "succeed" else "retried" if again else "failed"
                    if again:
                        job["until"] = None
                    else:
                        del live[key]
            out[tenant, key, job["id"], what, at, job["n"]] += 1
        over(seen)
    return out


def written(spark, folder, rows):
    """The rows as files of one part each, in order."""
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(a, pd.Timestamp(b, unit="ms").to_pydatetime(), c, d, e, f) for a, b, c, d, e, f in part], SCHEMA)
        df.coalesce(1).write.parquet(f"{folder}/part={k}")
        time.sleep(0.05)
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_queue_survives_a_killed_run(spark, tmp_path):
    rows, policy = queue_events(), jobs.Policy(lease_ms=5 * HOUR, attempts=2, running=2)
    read = written(spark, f"file://{tmp_path}/in", [rows[:150], rows[150:300], rows[300:]])
    flag = str(tmp_path / "fault")
    open(flag, "w").close()

    class Faulty(jobs.JobQueue):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            for frame in super().handleInputRows(key, rows, timerValues):
                if os.path.exists(flag) and frame["at_ms"].max() > self.fault_at:
                    raise RuntimeError("killed")
                yield frame

    faulty = Faulty(policy)
    faulty.fault_at = rows[200][1]
    with pytest.raises(Exception, match="killed"):
        jobs.run(jobs.stateful(read(), "tenant", faulty, "1 hour"), "jobs", f"file://{tmp_path}/out")
    first = spark.read.parquet(f"file://{tmp_path}/out/rows").count()
    os.remove(flag)
    got = jobs.run(jobs.stateful(read(), "tenant", faulty, "1 hour"), "jobs", f"file://{tmp_path}/out")
    want = simulated(rows, policy, rows[-1][1] - HOUR - 1)
    assert Counter(map(tuple, got.collect())) == want and 0 < first < sum(want.values())
    assert {k[3] for k in want} == {"queued", "merged", "claimed", "extended", "expired", "succeeded", "retried", "failed"}


def test_a_lease_runs_out_without_an_event(spark, tmp_path):
    now = int(time.time() * 1000)
    read = written(spark, f"file://{tmp_path}/in", [[(1, now, 1, "enqueue", "a", 0), (1, now, 2, "claim", "a", 7)]])

    def start(writer):
        query = writer.trigger(processingTime="1 second").start()
        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] == 0 and p["stateOperators"] and p["sink"].get("numOutputRows", 0) != 0 for p in query.recentProgress) and len(query.recentProgress) < 12:
            time.sleep(0.5)
        query.stop()
        return query

    got = jobs.run(jobs.stateful(read(), "tenant", jobs.JobQueue(jobs.Policy(lease_ms=1500), event_time=False), timers="processingTime"), "live", f"file://{tmp_path}/out", start)
    rows = {r.what: r for r in got.collect()}
    assert set(rows) == {"queued", "claimed", "expired"} and rows["expired"].at_ms == rows["claimed"].at_ms + 1500


def test_streams_end_with_the_batch_rows(spark):
    rows = lambda name: Counter(tuple(r) for r in QUERIES[name](spark, SF).collect())
    assert rows("stream_counters") == rows("st_lockout")
    assert {k[:2] for k in rows("stream_enqueue")} == {k[:2] for k in rows("st_enqueue")}


def test_sessions_and_limits(spark):
    log = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    last, want = log["ts"].max() - pd.Timedelta("1 hour"), Counter()
    for user, own in log.groupby("user_id"):
        begins = (own["ts"].diff() >= pd.Timedelta("30 minutes")) | own["ts"].diff().isna()
        for _, s in own.groupby(begins.cumsum()):
            if s["ts"].iloc[-1] + pd.Timedelta("30 minutes") <= last:
                want[user, s["ts"].iloc[0].strftime("%Y-%m-%d %H:%M:%S"), len(s)] += 1
    assert Counter(map(tuple, QUERIES["stream_sessions"](spark, SF).collect())) == want and want
    allowed = Counter()
    for user, own in log.groupby("user_id"):
        began, n = None, 0
        for at, event in zip(own["ts"], own["event_id"], strict=True):
            if began is None or at - began >= pd.Timedelta("1 day"):
                began, n = at, 0
            n += 1
            allowed[user, event, n <= 3] += 1
    assert Counter(map(tuple, QUERIES["stream_limited"](spark, SF).collect())) == allowed
