"""Streams of several batches: late rows, session windows, error runs with state and timers."""

import datetime as dt

import numpy as np
import pytest

from routecast.plans import streams as P
from routecast.streaming import monitor as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "key long, ts timestamp, event_id long, error boolean, part long"


def row(key, minutes, number, error, part):
    return key, T0 + dt.timedelta(minutes=minutes), number, error, part


def last_run(flags):
    run = longest = 0
    for bad in flags:
        run = run + 1 if bad else 0
        longest = max(longest, run)
    return run, longest


@pytest.mark.parametrize("parts", [1, 5])
def test_runs_of_a_batch(spark, parts):
    """A hot key over all tasks, a key of errors only, ties in time, nulls."""
    r = np.random.default_rng(2)
    rows = [row(1, int(m), i, bool(r.random() < 0.8), 0) for i, m in enumerate(r.integers(0, 500, 4000))]
    rows += [row(2, i, 10_000 + i, True, 0) for i in range(50)] + [row(3, 5, 20_000, False, 0), row(None, 5, 20_001, True, 0), row(4, 1, 20_002, None, 0), row(4, 2, 20_003, True, 0)]
    got = {x.key: x for x in S.batch_runs(spark.createDataFrame(rows, ROWS).repartition(parts)).collect()}
    for key in (1, 2, 3, 4):
        flags = [bool(x[3]) for x in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2]))]
        lead = next((i for i, bad in enumerate(flags) if not bad), len(flags))
        assert (got[key].n, got[key].lead, got[key].tail, got[key].longest) == (len(flags), lead, *last_run(flags))
    assert set(got) == {1, 2, 3, 4}


def test_one_hot_key_over_several_batches(spark):
    r = np.random.default_rng(4)
    rows = [row(1, 100 * p + m, 1000 * p + m, bool(r.random() < 0.9), p) for p in range(4) for m in range(100)]
    rows += [row(2, 100 * p + 7, 9000 + p, True, p) for p in range(4)] + [row(3, 5, 9999, True, 0), row(3, 305, 9998, False, 3)]
    got = {x.key: (x.run, x.longest, x.alert) for x in P.run_error_runs(spark.createDataFrame(rows, ROWS), 4).collect()}
    for key in (1, 2, 3):
        run, longest = last_run([x[3] for x in sorted((x for x in rows if x[0] == key), key=lambda x: x[1:3])])
        assert got[key] == (run, longest, longest >= 4)


def test_idle_keys_are_forgotten(spark):
    """Key 1 errs on, with an hour of silence that key 2's rows let the watermark see; key 3 errs as often without."""
    rows = [row(1, m, m, True, 0) for m in range(3)] + [row(2, 90, 100, False, 1), row(2, 95, 101, False, 2)] + [row(1, 200 + m, 200 + m, True, 3) for m in range(2)]
    rows += [row(3, m, 300 + i, True, p) for i, (m, p) in enumerate([(1, 0), (40, 0), (80, 1), (94, 2), (130, 3)])]
    got = {x.key: (x.run, x.longest) for x in P.run_error_runs(spark.createDataFrame(rows, ROWS), 3, idle_ms=3_600_000).collect()}
    assert got[1] == (2, 2) and got[3] == (5, 5)
    kept = {x.key: (x.run, x.longest) for x in P.run_error_runs(spark.createDataFrame(rows, ROWS), 3).collect()}
    assert kept[1] == (5, 5)


def test_late_rows_are_lost_and_no_others(spark):
    rows = [row(1, 10 * i, i, i % 2 == 0, i // 12) for i in range(48)] + [row(1, 3, 100, True, 3), row(1, 475, 101, True, 3)] + [row(-1, 10**6, 200, True, 4)]
    got = {x.start: (x.n, x.errors) for x in P.run_parts(spark.createDataFrame(rows, ROWS), lambda e: S.failure_windows(e, "1 hour", delay="10 minutes")).collect()}
    assert len(got) == 8 and all(n == 6 for n, _ in list(dict(sorted(got.items())).values())[:7]) and got[max(got)] == (7, 4)


def test_bursts_grow_over_batches(spark):
    rows = [row(1, 0, 1, True, 0), row(1, 50, 2, True, 1), row(1, 100, 3, True, 2), row(1, 300, 4, True, 3), row(1, 20, 5, True, 3), row(2, 100, 6, False, 1), row(-1, 10**6, 9, True, 4)]
    out = P.run_parts(spark.createDataFrame(rows, ROWS), lambda e: S.error_bursts(e, "1 hour", delay="1 minute")).where("key = 1").collect()
    assert sorted(((x.end - x.start).total_seconds() / 60, x.errors) for x in out) == [(60, 1), (160, 3)]
