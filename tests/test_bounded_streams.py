import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from benchsieve.sources import schemas
from benchsieve.streaming import ending, jobs, rollups
from benchsieve.streaming.store import UpdateStore

START = datetime(2025, 1, 1)
TYPES = ["progress", "started", "model_failed", "file_started", "file_done", "file_delay", "chunk_ready", "chunk_forwarding", "chunk_forward_failed"]


def event(n, hours, job, kind, **fields):
    return {"event_id": n, "ts": (START + timedelta(hours=hours)).isoformat(), "job_id": job, "type": kind} | fields


def events_of(hours):
    return [
        event(
            h * 10 + j, h + j / 10, f"job{j % 3}", TYPES[(h * 3 + j) % len(TYPES)], prompt_index=h, total=99, processed_prompts=h + 1,
            file_index=h % 2, chunk_index=j % 2, file_name=f"f{h}" if h % 3 else None, message=f"m{h}" if h % 4 == 0 else None,
        )
        for h in hours
        for j in range(5)
    ]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(folder, name, rows):
    (folder / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def stream(spark, folder):
    found = jobs.read_events(spark, str(folder / "in"), files_per_batch=1)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def as_table(spark, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    found = lines.select(F.from_json("value", schemas.JOB_EVENT).alias("e")).select("e.*")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


PLAIN = [
    (rollups.JOB_PROGRESS, jobs.job_progress),
    (rollups.JOB_STATUS, jobs.job_status),
    (rollups.JOB_STARTS, jobs.job_starts),
    (rollups.FILE_LIFECYCLE, jobs.file_lifecycle),
    (rollups.CHUNK_LIFECYCLE, jobs.chunk_lifecycle),
]


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("roll_up, plain", PLAIN)
def test_parts_of_any_cut_merge_into_the_whole(spark, roll_up, plain):
    rows = events_of(range(30)) + [event(900, 12, "job1", "done"), event(901, 14, "job1", "error"), event(902, 3, None, "progress")]
    table = as_table(spark, rows)
    parts = roll_up.partial(table, (F.col("event_id") % 4).alias("cut"))
    wanted = plain(table)
    assert rows_of(roll_up.merge(parts), wanted.columns) == rows_of(wanted, wanted.columns)
    assert roll_up.merge(roll_up.partial(table.where("false"))).count() == 0


@pytest.mark.parametrize("roll_up, plain", PLAIN)
def test_bounded_roll_up_of_a_stream_with_repeated_and_late_events(spark, folder, roll_up, plain):
    kept = events_of(range(72))
    put(folder, "1", kept[:120])
    put(folder, "2", kept[110:240])  # ten events again, within the delay
    bounded = rollups.BoundedRollUp(stream(spark, folder), roll_up, str(folder / "out"), delay="6 hours", least=1)
    bounded.run()
    put(folder, "3", kept[240:] + [event(5000, -48, "job0", "progress", prompt_index=7, file_index=1, chunk_index=1)])
    put(folder, "4", [event(5001, -47, "late job", "file_done", file_index=1, chunk_index=1)])
    bounded = rollups.BoundedRollUp(stream(spark, folder), roll_up, str(folder / "out"), delay="6 hours", least=1)
    bounded.run()
    wanted = plain(as_table(spark, kept))
    assert rows_of(bounded.rows(), wanted.columns) == rows_of(wanted, wanted.columns)


def test_state_leaves_with_the_watermark(spark, folder):
    for day in range(5):
        put(folder, str(day), events_of(range(day * 24, day * 24 + 24)))
    put(folder, "9", [event(9999, 24 * 40, "other", "progress")])
    put(folder, "99", [event(10_000, 24 * 41, "other", "progress")])
    bounded = rollups.BoundedRollUp(stream(spark, folder), rollups.JOB_PROGRESS, str(folder / "out"), delay="6 hours")
    progress = bounded.run()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
    # The ids of a batch's events and of the delay before it, and three jobs in open days; not all 600.
    assert max(held) < 200 and held[-1] <= 6
    assert bounded.rows().count() == 4


def test_store_reads_the_snapshot_and_open_deltas_only(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    store = UpdateStore(spark, str(tmp_path / "s"), schema, ["k"], share=0.5, least=1)
    assert store.read().count() == 0
    for n in range(12):
        batch = spark.range(n, n + 50).select(F.col("id").alias("k"), F.lit(n).cast("long").alias("v"))
        assert store.append(batch, n)
        held = store.manifest()
        assert held.batch == n and sum(d.size for d in held.deltas) <= max(1, 0.5 * held.snapshot_size)
        on_disk = {p.name for p in (tmp_path / "s").iterdir() if p.name[0] != "_" and not p.name.startswith(".")}
        assert held.folders() <= on_disk and len(on_disk) <= 2 + len(held.deltas) + 2
    wanted = {k: min(k, 11) for k in range(61)}
    assert {r.k: r.v for r in store.read().collect()} == wanted
    again = UpdateStore(spark, str(tmp_path / "s"), schema, ["k"])
    version = again.manifest().version
    assert not again.append(spark.range(1).selectExpr("id AS k", "-1L AS v"), 11)
    assert again.manifest().version == version and {r.k: r.v for r in again.read().collect()} == wanted


def test_a_batch_that_broke_off_leaves_nothing_behind(spark, tmp_path):
    schema = spark.createDataFrame([], "k long").schema
    store = UpdateStore(spark, str(tmp_path / "s"), schema, ["k"])
    store.append(spark.range(3).toDF("k"), 0)
    store._write(spark.range(9).selectExpr("id AS k", "1L AS _batch"), "delta", 1)  # no manifest names it
    assert store.read().count() == 3
    store.append(spark.range(3, 5).toDF("k"), 1)
    assert sorted(r.k for r in store.read().collect()) == [0, 1, 2, 3, 4]


def test_snapshots_can_leave_out_expired_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    store = UpdateStore(spark, str(tmp_path / "s"), schema, ["k"], least=1, share=0, expired=lambda rows: rows.where("v > 1"))
    store.append(spark.range(4).selectExpr("id AS k", "id AS v"), 0)
    assert sorted(r.k for r in store.read().collect()) == [2, 3]


@pytest.fixture()
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    spark.conf.set(key, ending.PROVIDER)
    yield
    spark.conf.set(key, kept)


def test_streams_end_with_their_job(spark, folder, provider):
    rows = events_of(range(30))
    rows += [event(901, 12.05, "job1", "done"), event(902, 20, "job1", "error"), event(903, 25.01, "job2", "error")]
    rows.sort(key=lambda e: e["ts"])
    cuts = [rows[:40], rows[40:80], rows[80:120], rows[120:]]

    def run():
        ended = ending.until_end(stream(spark, folder), delay="6 hours", keep_hours=48)
        store = UpdateStore(spark, str(folder / "out"), ended.schema)
        return store.write_stream(ended, str(folder / "checkpoint"), "append"), store

    put(folder, "1", cuts[0])
    put(folder, "2", cuts[1] + [event(950, 12.01, "job1", "progress", prompt_index=1), event(951, 13, "job1", "progress")])
    run()
    put(folder, "3", cuts[2])
    put(folder, "4", cuts[3])
    _, store = run()
    table = as_table(spark, rows + [event(950, 12.01, "job1", "progress")])
    wanted = {r.event_id for r in jobs.until_terminal(table).collect()}
    found = [r.event_id for r in store.read().collect()]
    assert sorted(found) == sorted(wanted) and 950 in wanted and 951 not in found

    put(folder, "5", [event(5000, 24 * 30, "other", "progress")])
    put(folder, "6", [event(5001, 24 * 31, "other", "progress"), event(5002, 13, "job1", "progress")])
    put(folder, "7", [event(5003, 24 * 32, "other", "progress")])
    progress, store = run()
    assert sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) == 0
    # Late for the watermark, so it does not open the ended job again.
    assert 5002 not in {r.event_id for r in store.read().collect()}


class Held:
    """A job's state and timers, as the engine would keep them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 1000 * 3600


def test_the_end_of_a_job_is_found_from_rows():
    def row(number, seconds, kind="progress", zone=timezone.utc):
        at = datetime(1970, 1, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
        return Row(event_id=number, ts=at.astimezone(zone), job_id="j", type=kind)

    held, process = Held(), ending._UntilEnd(1000)
    process.init(held)
    far = timezone(timedelta(hours=-8))
    first = [row(1, 5), row(2, 9, "done", far), row(3, 9), row(None, 9), row(4, 20), row(5, -1, "done"), row(6, 1, zone=far)]
    assert [r.event_id for r in process.handleInputRows(("j",), iter(first), held)] == [1, 2, 6]
    assert held.value == (3609 * 10**6, 2, 3620 * 1000 + 1000) and held.timers == [held.value[2]]
    later = [row(7, 8), row(8, 7, "error"), row(9, 30)]
    assert [r.event_id for r in process.handleInputRows(("j",), iter(later), held)] == [8]
    assert held.value[:2] == (3607 * 10**6, 8) and held.timers == [held.value[2]]
    assert list(process.handleInputRows(("j",), iter([row(10, -5)]), held)) == []
