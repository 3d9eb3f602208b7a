"""Ingestions as a stream that is stopped and restarted, batches that come twice, and partitions that stay as they are."""

import random
import re
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crestline.operators import positions, ranking, refresh
from crestline.streaming import ingestion, uploads
from crestline.streaming.versions import Versions

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ingestion_id long, kind string, error string, created_at timestamp"


def some_events():
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), rng.choice(["submit", "start", "finish", "error", "retry", "other"]), rng.choice([None, "broken", "x" * 5000]), START + timedelta(minutes=rng.randrange(300))) for i in range(400)]
    return rows + [(400, None, "start", "", START), (401, 99, "start", "", START), (402, 98, "submit", "", START)]


def told(df):
    return {r["ingestion_id"]: (r["status"], r["error"], r["updated_at"]) for r in df.collect()}


def test_states_by_hand(spark):
    def of(*kinds, late=False):
        rows = [(i, 1, k, "e" if k == "error" else "", START + timedelta(minutes=i)) for i, k in enumerate(kinds)]
        as_of = START + timedelta(minutes=len(kinds) - 1 + (20 if late else 19))
        (found,) = told(ingestion.states(spark.createDataFrame(rows, EVENTS), F.lit(as_of))).values()
        return found[:2]

    assert of("submit") == ("queued", "") and of("submit", "start") == ("processing", "")
    assert of("submit", "start", late=True) == ("failed", ingestion.INTERRUPTED)
    assert of("submit", "start", "error") == ("failed", "e") and of("submit", "start", "error", "retry") == ("queued", "")
    assert of("submit", "start", "finish", "retry", "retry") == ("done", "")
    assert of("submit", "start", "retry", "start", "finish") == ("done", "")
    assert told(ingestion.states(spark.createDataFrame([], EVENTS), F.lit(START))) == {}


def test_an_ingestion_that_was_never_asked_for_is_as_its_worker_says(spark):
    rows = [(1, 1, "start", "", START), (2, 2, "error", "e", START), (3, 3, "finish", "", START)]
    assert told(ingestion.states(spark.createDataFrame(rows, EVENTS), F.lit(START))) == {1: ("processing", "", START), 2: ("failed", "e", START), 3: ("done", "", START)}


def test_stream_ends_as_the_table_after_a_restart(spark, tmp_path):
    rows = some_events()
    files, table = tmp_path / "in", Versions(spark, f"file://{tmp_path}/states", ingestion.STATES, "ingestion_id", lambda old, new: old.join(new, "ingestion_id", "left_anti").unionByName(new), buckets=4)

    def started(seconds):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(files))
        return ingestion.watched(stream, seconds).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(table.apply).start()

    def until(query, reached):
        end = time.time() + 120
        while not reached() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.5)
        query.stop()
        assert reached()

    for part in range(2):  # out of order: each file has events of all times
        spark.createDataFrame(rows[part::4], EVENTS).coalesce(1).write.mode("append").parquet(str(files))
    first = told(ingestion.states(spark.createDataFrame(rows[0::4] + rows[1::4], EVENTS), F.lit(START)))
    until(started(3600), lambda: told(table.rows()) == first)
    assert {s for s, _, _ in first.values()} == {"queued", "processing", "done", "failed"}
    for part in range(2, 4):
        spark.createDataFrame(rows[part::4], EVENTS).coalesce(1).write.mode("append").parquet(str(files))
    # From the checkpoint, with states of before the restart; what is still being processed runs out of time.
    last = told(ingestion.states(spark.createDataFrame(rows, EVENTS), F.lit(START + timedelta(days=9))))
    query = started(2)
    # Ingestions without new events have their old timers of an hour.
    again = {r[1] for r in rows[2::4] + rows[3::4] if r[1] is not None and r[2] != "other"}
    soon = {i: s for i, s in last.items() if i in again}
    until(query, lambda: {i: s for i, s in told(table.rows()).items() if i in again} == soon)
    assert any(e == ingestion.INTERRUPTED for _, e, _ in soon.values()) and set(told(table.rows())) == set(last)


UPLOADS = "upload_id long, at long, content string, full_name string, title string, contact_email string, workspace_id int"


def candidate_table(spark, path):
    return Versions(spark, f"file://{path}", uploads.CANDIDATES, "external_id", uploads.upserted, buckets=4)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    batch = lambda *rows: uploads.identified(spark.createDataFrame([(i, i, *r) for i, r in rows], UPLOADS))
    first = batch((1, ("text a", "Ann", "t1", "a@x.org", None)), (2, ("text b", "Bo", "t2", "", 3)), (3, ("text a", "Ann L", "t3", " ", 5)), (4, (None, "none", "", "", 1)))
    second = batch((7, ("text a", "Ann Lee", "t4", "", 9)), (8, ("text c", "Cy", "t5", "c@x.org", None)))
    table = candidate_table(spark, tmp_path / "t")
    table.apply(first, 0)
    rows = lambda t: sorted(map(tuple, t.rows().drop("external_id").collect()))
    want = [("Ann L", "t3", "a@x.org", "new", 5, 2), ("Bo", "t2", "", "new", 3, 1)]
    assert rows(table) == want
    table.apply(first, 0)
    assert rows(table) == want
    # A crash after the files are written and before the ledger: the batch doesn't count, and is written again.
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.apply(second, 1)
    again = candidate_table(spark, tmp_path / "t")
    assert rows(again) == want
    again.apply(second, 1)
    again.apply(second, 1)
    want = [("Ann Lee", "t4", "a@x.org", "new", 5, 3), ("Bo", "t2", "", "new", 3, 1), ("Cy", "t5", "c@x.org", "new", None, 1)]
    assert rows(again) == want and rows(table) == want
    again.apply(first.where("false"), 2)
    assert rows(again) == want and again._ledger().where("batch = 2").count() == 1


def test_hidden_rows_come_back(spark):
    up = spark.createDataFrame([(1, 10, "a", "", "", "", 3), (2, 30, "a", "", "", "", 3), (3, 40, "a", "", "", "", None), (4, 50, "b", "", "", "", 4)], UPLOADS)
    a, b = [r["external_id"] for r in uploads.identified(up).where("upload_id in (1, 4)").orderBy("upload_id").collect()]
    hidden = spark.createDataFrame([(3, a, 20), (3, b, 20), (4, b, 60), (4, a, 5), (None, a, 5)], "workspace_id int, external_id string, at long")
    assert sorted(map(tuple, uploads.still_hidden(hidden, up).collect()), key=repr) == sorted([(3, b, 20), (4, b, 60), (4, a, 5), (None, a, 5)], key=repr)


JOBS = "job_id long, workspace_id int, skills string, min_experience double, education_required string"
PEOPLE = "candidate_id long, skills string, years double, degree string"
PAIRS = "job_id long, candidate_id long, score double, similarity double"


def test_a_refresh_leaves_other_partitions(spark, tmp_path):
    rng = random.Random(6)
    jobs = [(j, j % 3, rng.choice(["python, sql", "react"]), float(j % 4), "any") for j in range(30)]
    people = [(c, rng.choice(["python", "sql, react", ""]), float(c % 6), "phd") for c in range(40)]
    pairs = [(j, c, round(rng.random(), 2), round(rng.random(), 2)) for j in range(30) for c in rng.sample(range(40), 5)]
    frames = lambda j, p, r: (spark.createDataFrame(r, PAIRS), spark.createDataFrame(j, JOBS), spark.createDataFrame(p, PEOPLE))
    old = frames(jobs, people, pairs)
    saved = refresh.SavedRankings(spark, f"file://{tmp_path}/saved", buckets=1000)
    saved.write(*old)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(tmp_path, "saved").rglob("part-*")}
    before = files()
    # A job moves to another workspace, one goes, one loses all pairs, one is new; a candidate and a pair change.
    new_jobs = [(j, 2 if j == 4 else w, s, m, e) for j, w, s, m, e in jobs if j != 6] + [(100, 1, "sql", 2.0, "any")]
    new_people = [(c, s, y + (c == 9), d) for c, s, y, d in people]
    new_pairs = [(j, c, s, m) for j, c, s, m in pairs if j not in (6, 7)] + [(100, 3, 0.5, 0.5)]
    new_pairs[0] = (*new_pairs[0][:2], 0.99, 0.01)
    new = frames(new_jobs, new_people, new_pairs)
    gone = [refresh.changed(old[1], new[1], ["job_id"]), refresh.changed(old[2], new[2], ["candidate_id"]), refresh.changed(old[0], new[0], ["job_id", "candidate_id"])]
    affected = refresh.affected_jobs(new[0], *gone)
    named = {r["job_id"] for r in affected.collect()}
    assert named == {4, 6, 7, 100, new_pairs[0][0]} | {j for j, c, *_ in new_pairs if c == 9}
    saved.refresh(affected, *new)
    whole = refresh.SavedRankings(spark, f"file://{tmp_path}/whole", buckets=1000)
    whole.write(*new)
    rows = lambda t: sorted(map(repr, t.rows().collect()))
    assert rows(saved) == rows(whole)
    after = files()
    kept = {p for p in before if p in after}
    assert len(kept) == len({j for j, *_ in jobs} - named) and all(after[p] == before[p] for p in kept)
    saved.refresh(affected.where("false"), *new)
    assert rows(saved) == rows(whole)


def test_ranking_reads_its_pairs_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 1, 0.5, 0.5), (1, 2, 0.5, 0.9), (2, 2, 0.1, 0.1), (3, 1, 0.9, 0.9), (None, 1, 0.9, 0.9)], PAIRS).write.parquet(f"file://{tmp_path}/pairs")
    pairs = spark.read.parquet(f"file://{tmp_path}/pairs")
    jobs = spark.createDataFrame([(1, 7, "python, sql", 2.0, "any"), (2, None, None, 2.0, "any")], JOBS)
    people = spark.createDataFrame([(1, "sql", 3.0, "phd"), (2, None, None, "")], PEOPLE)
    once = refresh.ranked(pairs, jobs, people, ["workspace_id"])
    assert len(re.findall(r"Relation \[job_id#", once._jdf.queryExecution().optimizedPlan().toString())) == 1
    rows = sorted(map(repr, once.collect()))
    assert [(r["job_id"], r["place"], r["candidate_id"], r["workspace_id"]) for r in once.orderBy("job_id", "place").collect()] == [(1, 1, 1, 7), (1, 2, 1, 7), (1, 3, 2, 7), (2, 1, 2, None)]
    # Lists that are too many for a table of all are compared where they meet.
    monkeypatch.setattr(ranking, "MOST_LISTS", 0)
    assert sorted(map(repr, refresh.ranked(pairs, jobs, people, ["workspace_id"]).collect())) == rows


def test_changed_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, a string, b string")
    before, after = frame([(1, "x", None), (2, "y", "z"), (3, "s", "t"), (None, "n", "n"), (5, "d", "d"), (5, "d", "d")]), frame([(1, None, "x"), (2, "y", "z"), (4, "s", "t"), (None, "n", "n"), (5, "d", "d")])
    assert sorted(r["k"] for r in refresh.changed(before, after, ["k"]).collect()) == [1, 3, 4, 5]


def test_places_over_ranges(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "v long, id long").repartition(7)
    got = {r["id"]: r["position"] for r in positions.numbered(df, F.desc("v"), F.col("id")).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert positions.numbered(df.where("false"), F.col("id")).count() == 0
