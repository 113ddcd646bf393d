"""Streams in many micro-batches against their batch twins; request limits against a plain loop."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from newsmart.operators import analytics as A
from newsmart.operators import enrich as E
from newsmart.sources import versions as V
from newsmart.streaming import limits as L
from newsmart.streaming import runs as R
from newsmart.streaming.state import StateTable


def plain_admission(requests, limit, window):
    kept, out = {}, {}
    for ip, t, i in sorted(requests, key=lambda r: (r[1], r[2])):
        live = [x for x in kept.get(ip, []) if t - x < window * L.MICROS]
        out[i] = len(live) < limit
        kept[ip] = live + [t] if out[i] else live
    return out


def traffic(seed, n=1500):
    """One client sends most of the requests, in bursts; others are calm; times collide."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 2, 3, 4, 30]) * L.MICROS // rnd.choice([1, 2, 5]) + (rnd.random() < 0.01) * 300 * L.MICROS
        rows.append(("hot" if rnd.random() < 0.7 else f"c{rnd.randrange(9)}", t, i))
    return rows


EDGES = [("e", s * L.MICROS, i) for i, s in enumerate([0] * 10 + [59, 60, 60, 119, 120, 120, 121])]


@pytest.mark.parametrize("seed,limit", [(1, 10), (2, 3), (3, 15)])
def test_batch_admission(spark, seed, limit):
    rows = traffic(seed)
    df = spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG").repartition(5)
    got = {r.request_id: r.admitted for r in L.admitted(df, limit=limit).collect()}
    want = plain_admission(rows, limit, 60)
    assert got == want and not all(want.values())


def test_window_edges(spark):
    df = spark.createDataFrame(EDGES, "ip STRING, t LONG, request_id LONG")
    got = {r.request_id: r.admitted for r in L.admitted(df).collect()}
    assert got == plain_admission(EDGES, 10, 60)
    assert got[10] is False and got[11] is True


def test_trailing_count(spark):
    rows = traffic(5, 600)
    df = spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG")
    got = {r.request_id: r.n_recent for r in L.trailing_count(df).collect()}
    want = {i: sum(ip2 == ip and t - 60 * L.MICROS < t2 <= t for ip2, t2, _ in rows) for ip, t, i in rows}
    assert got == want


def test_trailing_count_runs_on(spark):
    """Counts are running sums: no frame slides over a slot, whose cost would be its requests squared. Times before 1970 and
    repeated ones count as well."""
    rows = [("a", (i * 7919 % 4000 - 2000) * 100_000 // 3, i) for i in range(4000)]
    counted = L.trailing_count(spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG"))
    assert "specifiedwindowframe(RangeFrame, -" not in counted._jdf.queryExecution().toString()
    got = {r.request_id: r.n_recent for r in counted.collect()}
    at = sorted(t for _, t, _ in rows)
    assert got == {i: bisect.bisect_right(at, t) - bisect.bisect_right(at, t - 60 * L.MICROS) for _, t, i in rows}


def test_client(spark):
    df = spark.createDataFrame([("a, b", "p"), (None, "p"), (None, None)], "f STRING, r STRING")
    assert [r[0] for r in df.select(L.client(F.col("f"), F.col("r"))).collect()] == ["a", "p", "unknown"]


def land(spark, tmp_path, df, order, files):
    """Files that arrive one after the other, in the given order."""
    import os
    import time

    folder = str(tmp_path / "landing")
    os.makedirs(folder)
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = os.path.join(folder, f"{i}.parquet")
        os.link(os.path.join(part, name), target)
        os.utime(target, (time.time() - 1000 + i, time.time() - 1000 + i))
    return folder


@pytest.mark.parametrize("seed", [7, 8])
def test_streamed_admission_keeps_state(spark, tmp_path, seed):
    rows = traffic(seed, 400)
    df = spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG")
    folder = land(spark, tmp_path, df, "request_id", 4)
    stream = R.file_stream(spark, folder, df.schema, files_per_batch=1)
    base = R.new_folder(spark, "t")
    got = {r.request_id: r.admitted for r in L.admit_stream(stream, base).collect()}
    assert got == plain_admission(rows, 10, 60)
    assert spark.read.parquet(f"{base}/decided").select("batch").distinct().count() == 4
    # nothing new: nothing changes
    assert {r.request_id: r.admitted for r in L.admit_stream(stream, base).collect()} == got


def test_running_counts(spark, tmp_path):
    rows = [(i, f"S{i % 3}", [f"P{j}" for j in range(i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "pos LONG, source STRING, places ARRAY<STRING>")
    folder = land(spark, tmp_path, df, "pos", 4)
    base, keys = R.new_folder(spark, "t"), ["kind", "value"]
    counts = R.running_counts(R.file_stream(spark, folder, df.schema, files_per_batch=1))
    assert R.keep_state(counts, base, keys) == 0
    state = R.kept_state(spark, base, keys, counts.schema)
    want = sorted(map(tuple, A.value_counts(df).collect()))
    assert sorted(map(tuple, state.collect())) == want
    assert V.entry(spark, f"{base}/state", V.latest_version(spark, f"{base}/state"))["batch"] == 3
    # nothing new: nothing changes
    R.keep_state(counts, base, keys)
    assert sorted(map(tuple, R.kept_state(spark, base, keys, counts.schema).collect())) == want


def test_state_holds_each_group_once(spark):
    """Batches touch some buckets only, a repeated batch changes nothing, old versions go."""
    base = R.new_folder(spark, "t")
    make = lambda rows: spark.createDataFrame(rows, "k STRING, n LONG, note STRING")
    table = StateTable(spark, base, ["k"], make([]).schema, buckets=4)
    assert table.read().count() == 0 and table.batch() is None
    want, places = {}, {}
    for number in range(9):
        rows = [(f"k{i}", number, None if i % 2 else "x") for i in range(number % 3, 40, 3 + number)] if number != 5 else []
        assert table.merge(make(rows), number)
        assert not table.merge(make([("k0", -1, "again")]), number)
        want |= {k: (n, note) for k, n, note in rows}
        assert {r.k: (r.n, r.note) for r in table.read().collect()} == want and table.read().count() == len(want)
        now = {d.rsplit("/", 1)[1]: d for d in V.entry(spark, base, V.latest_version(spark, base))["data"]}
        assert number != 5 or now == places
        places = now
    assert len(V.names(spark, f"{base}/log")) == V.KEPT + 1
    assert V.sweep(spark, base, hours=0) >= 0 and {r.k: (r.n, r.note) for r in table.read().collect()} == want


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(0, "2024-06-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-06-02 00:00:00"), (3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "pos LONG, ts STRING").withColumn("ts", F.to_timestamp("ts"))
    folder = land(spark, tmp_path, df, "pos", 4)
    days = R.daily_counts(R.file_stream(spark, folder, df.schema, files_per_batch=1).select("ts"))
    base = R.new_folder(spark, "t")
    late = R.keep_state(days, base, ["day"])
    kept = R.kept_state(spark, base, ["day"], days.schema).agg(F.sum("n")).first()[0]
    assert late >= 1 and kept + late == 4


def test_unique_arrivals(spark, tmp_path):
    rows = [(i, f"u{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "pos LONG, url STRING").withColumn(
        "arrived", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, pos)"))
    folder = land(spark, tmp_path, df, "pos", 4)
    stream = R.file_stream(spark, folder, df.schema, files_per_batch=1)
    out = R.append_files(R.unique_arrivals(stream, ["url"], "arrived"), R.new_folder(spark, "t"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == [f"u{i}" for i in range(7)]


def test_latest_progress_and_days(spark, tmp_path):
    rows = [(f"r{i % 3}", f"2024-01-{1 + i % 5:02d} 00:00:{i:02d}", i, float(i), f"step {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "run_id STRING, ts STRING, event_id LONG, progress_pct FLOAT, current_step STRING").withColumn(
        "ts", F.to_timestamp("ts"))
    folder = land(spark, tmp_path, df, "event_id", 3)
    base, last = R.new_folder(spark, "t"), R.latest_progress(R.file_stream(spark, folder, df.schema, files_per_batch=1))
    R.keep_state(last, base, ["run_id"])
    want = {}
    for run, ts, event, _, step in sorted(rows, key=lambda r: (r[1], r[2])):
        want[run] = step
    assert {r.run_id: r.current_step for r in R.kept_state(spark, base, ["run_id"], last.schema).collect()} == want
    base, days = R.new_folder(spark, "t"), R.daily_counts(R.file_stream(spark, folder, df.schema, files_per_batch=1).select("ts"))
    R.keep_state(days, base, ["day"])
    assert {r.day: r.n for r in R.kept_state(spark, base, ["day"], days.schema).collect()} == {f"2024-01-0{d}": 6 for d in range(1, 6)}


def test_streamed_mixed_limits(spark, tmp_path):
    rows = [(ip, t, i, 15 if i % 3 else 10) for ip, t, i in traffic(11, 500)]
    df = spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG, most INT")
    kept, want = {}, {}
    for ip, t, i, most in rows:
        live = [x for x in kept.get(ip, []) if t - x < 60 * L.MICROS]
        want[i] = len(live) < most
        kept[ip] = live + [t] if want[i] else live
    assert {r.request_id: r.admitted for r in L.admitted(df.repartition(5), limit="most").collect()} == want
    folder = land(spark, tmp_path, df, "request_id", 5)
    got = L.admit_stream(R.file_stream(spark, folder, df.schema, files_per_batch=1), R.new_folder(spark, "t"), "most")
    assert {r.request_id: r.admitted for r in got.collect()} == want


def test_silent_clients_leave_the_state(spark, tmp_path):
    rows = [(f"c{b}", (b * 200 + i) * L.MICROS, b * 100 + i) for b in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "ip STRING, t LONG, request_id LONG")
    folder, base = land(spark, tmp_path, df, "request_id", 4), R.new_folder(spark, "t")
    seen = []
    for number in range(4):
        stream = R.file_stream(spark, folder, df.schema, files_per_batch=1, only=f"[0-{number}].parquet")
        L.admit_stream(stream, base)
        seen.append({r.ip for r in L.carried(spark, base).collect()})
    assert seen == [{"c0"}, {"c1"}, {"c2"}, {"c3"}]
    assert L.carried(spark, base).count() == 10  # the admitted ones of one client


def noting_model(notes):
    """Answers every article but the third of a batch; notes each call in a folder."""

    def ask(articles):
        import json
        import os
        import uuid

        with open(os.path.join(notes, uuid.uuid4().hex), "w") as f:
            f.write(",".join(a["article_id"] for a in articles))
        fixed = {"sentiment_score": 0.5, "summary": uuid.uuid4().hex, "entities_list": [], "locations_list": []}
        return json.dumps({"results": [{"article_id": a["article_id"], **fixed} for i, a in enumerate(articles) if i != 2]})

    return ask


def test_model_is_asked_once(spark, tmp_path):
    """One call a batch and one a retry; none when the micro-batch is repeated, whatever step had failed."""
    import os

    notes = tmp_path / "notes"
    notes.mkdir()
    model = noting_model(str(notes))
    rows = [(i, f"r{i % 2}", i // 10, f"a{i:02d}", f"T{i}", "text") for i in range(40)]
    df = spark.createDataFrame(rows, "pos LONG, execution_id STRING, batch_no LONG, article_id STRING, title STRING, content_snippet STRING")
    folder, base = land(spark, tmp_path, df, "pos", 2), R.new_folder(spark, "t")
    failing = {"retries": True}

    def answers(requests):
        return E.call_model(requests, model)

    def retries(first):
        if failing["retries"]:
            raise RuntimeError("lost")
        return E.call_again(first, model)

    targets = df.groupBy("execution_id").agg(F.count(F.lit(1)).alias("target"))

    def run():
        stream = R.file_stream(spark, folder, df.schema, files_per_batch=1)
        R.enrich_stream(stream, answers, retries, base, ["article_id", "execution_id", "outcome", "summary"], targets)

    calls = lambda: len(os.listdir(notes))
    with pytest.raises(Exception, match="lost"):
        run()
    assert calls() == 4  # two runs of two batches of five in the first file
    failing["retries"] = False
    run()
    assert calls() == 8 + 8  # eight batches, one article of each asked for again
    seen = lambda kind: sorted(map(tuple, spark.read.parquet(f"{base}/{kind}").collect()), key=repr)
    before = seen("metrics"), seen("events"), seen("dlq")
    commits = sorted(n for n in os.listdir(f"{base}/checkpoint/commits") if n.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the driver had died before noting the batch
        os.remove(f"{base}/checkpoint/commits/{name}")
    run()
    assert calls() == 16 and (seen("metrics"), seen("events"), seen("dlq")) == before
    events = sorted((r.execution_id, r.current, r.article_id, r.target) for r in spark.read.parquet(f"{base}/events").collect())
    assert events == [(f"r{k}", n + 1, f"a{2 * n + k:02d}", 20) for k in range(2) for n in range(20)]
    outcomes = {r.article_id: r.outcome for r in spark.read.parquet(f"{base}/metrics").collect()}
    assert len(outcomes) == 40 and sum(o == "recovered" for o in outcomes.values()) == 8


def test_enrichment_lands_in_as_many_files_as_shuffles_have_parts(spark):
    """No task writes a fixed share of all articles, however many there are; the first batches still come first."""
    from conftest import SF
    from pathlib import Path

    from newsmart.plans.catalog import QUERIES

    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    landing = Path(V.work_dir(spark)) / "landing/batches"
    old = set(landing.glob("*"))
    try:
        rows = QUERIES["stream_article_events"](spark, SF).collect()
    finally:
        spark.conf.unset(setting)
    (folder,) = set(landing.glob("*")) - old
    assert len(list(folder.glob("*.parquet"))) > 8
    by_run = {}
    for r in rows:
        by_run.setdefault(r.execution_id, []).append(r)
    for run in by_run.values():
        run.sort(key=lambda r: r.article_id)
        assert [(r.current, r.target) for r in run] == [(i + 1, len(run)) for i in range(len(run))]
