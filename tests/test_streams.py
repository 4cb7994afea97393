"""Streams against serial runs of the same machines: disorder, restarts, timers, expiry, late rows."""

import random

import pandas as pd
import pytest

from fieldlens.functions import machines as mc
from fieldlens.operators import routing as rt
from fieldlens.sources import logs
from fieldlens.streaming import streams as st

FPS = 10.0


def arrive(spark, root, number, rows, schema):
    """One file, as one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/slice{number}")
    return f"{root}/slice*"


def drain(spark, root, schema, build, out="out"):
    stream = st.stream_tracks(spark, f"{root}/slice*", spark.createDataFrame([], schema).schema, FPS, max_files=1, delay="3 seconds", start=86400.0)
    return st.checkpointed_run(build(stream), f"{root}/{out}", f"{root}/state-{out}")


def serial(machine, rows, columns, key=None):
    out = []
    for row in sorted(rows, key=lambda r: r[1]):
        out += machine.step(dict(zip(columns, row[1:])))
    return out + (machine.finish() if hasattr(machine, "finish") else [])


def disorder(rng, rows, frames):
    """Rows moved by up to ``frames`` places in time, cut in slices of 35 frames."""
    moved = sorted(rows, key=lambda r: r[1] + rng.random() * frames)
    slices = {}
    for r in moved:
        slices.setdefault(r[1] // 35, [])
    place = {id(r): k for k, r in enumerate(moved)}
    for r in moved:
        slices[min(max(r[1] // 35, place[id(r)] * len(slices) // len(moved)), max(slices))].append(r)
    return [slices[k] for k in sorted(slices) if slices[k]]


BALL = "video_id bigint, frame_idx bigint, cx double, cy double, conf double, x1 double, y1 double, x2 double, y2 double, ended boolean"
MACHINES = {
    "kalman": (lambda s: st.kalman_stream(s, FPS), lambda: mc.KalmanBall(FPS)),
    "shots": (lambda s: st.stateful_tracking(s, mc.ShotTracker, st._schema("frame_idx BIGINT, conf DOUBLE, shot STRING")), mc.ShotTracker),
    "possession": (st.possession_stream, mc.Possession),
    "deliveries": (st.delivery_sessions, mc.DeliverySession),
    "speeds": (lambda s: st.speed_stream(s, FPS), lambda: mc.SpeedWindow(FPS)),
}


def machine_rows(name, rng, video):
    rows = []
    for f in range(140):
        seen = rng.random() < 0.8
        if name == "kalman":
            box = [float(f * 3 + rng.randrange(9)), float(90 + rng.randrange(9)), 0.9, 1.0, 2.0, 3.0, 4.0]
            rows.append((video, f, *(box if seen else [None] * 7), False))
        elif name == "shots":
            rows.append((video, f, float(200 + f), float((f % 40 - 20) ** 2) if seen else None, 1280, 720, False))
        elif name == "possession":
            rows.append((video, f, rng.randrange(3) if seen else None, False))
        elif name == "deliveries":
            rows.append((video, f, f % 60 < 30 and seen, f % 3 > 0, False))
        else:
            rows.append((video, f, 7, rng.random(), False))
    return rows


SCHEMAS = {
    "kalman": BALL, "shots": "video_id bigint, frame_idx bigint, cx double, cy double, width int, height int, ended boolean",
    "possession": "video_id bigint, frame_idx bigint, candidate bigint, ended boolean",
    "deliveries": "video_id bigint, frame_idx bigint, has_ball boolean, has_batsman boolean, ended boolean",
    "speeds": "video_id bigint, frame_idx bigint, player_id bigint, dist_m double, ended boolean",
}


@pytest.mark.parametrize("name", MACHINES)
def test_disordered_feed_equals_serial_run(spark, tmp_path, name):
    rng, root, schema = random.Random(1), str(tmp_path), SCHEMAS[name]
    build, make = MACHINES[name]
    columns = [c.split()[0] for c in schema.split(", ")][1:]
    videos = {v: machine_rows(name, rng, v) for v in (1, 2)}
    slices = disorder(rng, videos[1] + videos[2], 8)
    assert any(a[1] > b[1] for s in slices for a, b in zip(s, s[1:], strict=False))
    half = len(slices) // 2
    for k, part in enumerate(slices[:half]):
        arrive(spark, root, k, part, schema)
    drain(spark, root, schema, build)
    early = spark.read.parquet(f"{root}/out").count()
    for k, part in enumerate(slices[half:], half):  # goes on after a stop
        arrive(spark, root, k, part, schema)
    ends = [tuple([v, 400, *[None] * (len(columns) - 2), True]) for v in (1, 2)]
    arrive(spark, root, 99, ends, schema)
    query = drain(spark, root, schema, build)
    got = spark.read.parquet(f"{root}/out").collect()
    skip = 2 if name == "speeds" else 1
    for v, rows in videos.items():
        want = serial(make(), rows, columns)
        assert sorted(repr(tuple(r)[skip:]) for r in got if r["video_id"] == v) == sorted(repr(tuple(x)) for x in want)
    assert name == "deliveries" or 0 < early < len(got)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # state of ended videos is gone


def test_timer_gives_out_rows_without_input_and_late_rows_are_dropped(spark, tmp_path):
    root, schema = str(tmp_path), SCHEMAS["deliveries"]
    first = [(1, f, True, True, False) for f in range(8)]
    arrive(spark, root, 0, first, schema)
    drain(spark, root, schema, st.delivery_sessions)
    assert spark.read.schema("start_frame bigint").parquet(f"{root}/out").count() == 0
    arrive(spark, root, 1, [(2, 200, False, False, False)], schema)  # another video moves the watermark
    drain(spark, root, schema, st.delivery_sessions)
    assert [tuple(r) for r in spark.read.parquet(f"{root}/out").collect()] == [(1, 0, 7, 7, 8)]
    arrive(spark, root, 2, [(1, 5, True, True, False)], schema)  # far behind the watermark
    arrive(spark, root, 3, [(2, 900, False, False, False)], schema)
    drain(spark, root, schema, st.delivery_sessions)
    assert spark.read.parquet(f"{root}/out").count() == 1


def test_late_rows_change_their_windows_only(spark, tmp_path):
    root, schema = str(tmp_path), "video_id bigint, frame_idx bigint"

    def step():
        stream = st.stream_tracks(spark, f"{root}/slice*", spark.createDataFrame([], schema).schema, FPS, max_files=1, delay="2 seconds", start=86400.0)
        st.split_late(stream, f"{root}/out", f"{root}/state")
        return {(r["video_id"], int(r["start"].timestamp()) - 86400): (r["rows"], r["restated"]) for r in st.window_counts(spark, f"{root}/out").collect()}

    arrive(spark, root, 0, [(1, f) for f in range(100) if f != 33], schema)
    before = step()
    arrive(spark, root, 1, [(1, 33), (1, 100), (1, 95)], schema)
    after = step()
    assert {k for k in after if after[k] != before.get(k)} == {(1, 3), (1, 9), (1, 10)}
    assert before[(1, 3)] == (9, False) and after[(1, 3)] == (10, True) and after[(1, 9)] == (11, False)
    late = spark.read.parquet(f"{root}/out/rows").filter("is_late = 'true'").collect()
    assert [r["frame_idx"] for r in late] == [33]


def put_log(root, number, name, text):
    folder = root / f"slice={number}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.log").write_bytes(text.encode())


def test_log_files_are_numbered_across_slices_files_and_blocks(spark, rows, tmp_path):
    rng, want, count = random.Random(4), [], {}
    for number in (0, 2, 10):  # by number, not by name
        for name, runs in (("b", (1, 2)), ("a", (3,))):
            text = ""
            for k in range(rng.randint(150, 300)):
                run = rng.choice(runs)
                line = f"step {number} {k} " + "x" * rng.randint(0, 60) + "|50%|"
                want.append((run, count.setdefault(run, 0), line))
                count[run] += 1
                text += f"{run}|{line}" + rng.choice(("\n", "\r\n", "\r", "\n\n", f"\n{run}|\n", "\nno run here\n"))
            put_log(tmp_path, number, name, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several blocks a file, in several tasks
    try:
        for span in (50, 1 << 16):
            assert rows(logs.run_logs(spark, str(tmp_path), span=span)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_slices_have_as_many_files_as_their_lines_fill(spark, rows, tmp_path):
    """Not one a task; a run's lines of a slice stay in one file."""
    data = [(run, k, f"step {run} {k}") for run in range(40) for k in range(run % 3, 300, 3)]
    log = spark.createDataFrame(data, "run_id bigint, line_no bigint, line string").repartition(6)
    logs.write_run_logs(log, str(tmp_path / "few"), 30)
    assert [len(list(d.glob("*.txt"))) for d in (tmp_path / "few").glob("slice=*")] == [1] * 10
    logs.write_run_logs(log, str(tmp_path / "more"), 30, lines_per_file=100)
    for folder in (tmp_path / "more").glob("slice=*"):
        runs = [{line.split("|")[0] for line in f.read_text().splitlines()} for f in folder.glob("*.txt")]
        assert 1 < len(runs) <= 4 and sum(map(len, runs)) == 40
    want = [(run, n, line) for run in range(40) for n, line in enumerate(x[2] for x in data if x[0] == run)]
    for path in ("few", "more"):
        assert rows(logs.run_logs(spark, str(tmp_path / path), span=64)) == sorted(want)


def test_status_of_log_files_equals_the_batch(spark, tmp_path):
    """Files come one a batch; the second file of a slice and a restart change nothing."""
    root, out = tmp_path / "logs", str(tmp_path / "out")
    put_log(root, 0, "a", "1|Auto-detected sport: CRICKET\n1|[3/7] step Total Frames: 900\n")
    put_log(root, 0, "b", "2|[1/8] step\r2|Processing: 5%|#| 40/80 [00:10<00:10, 5.5 frames/s]\r2|Processing: 9%|#| 45/80 [00:10<00:10, FPS=7.5, ETA=9s, VRAM=2GB]\r")
    put_log(root, 1, "a", "1|Processing: 50%|#| 30/60 [00:10<00:10, 5.5 frames/s]\n\n1|Processing: 50%|#| 450/900 [00:10<00:10, FPS=3, ETA=60s]\n")
    run = lambda: st.latest_run(st.run_status_stream(logs.log_stream(spark, str(root), max_files=1), idle="1 minute"), out, str(tmp_path / "state"))
    run()
    put_log(root, 3, "a", "1|Analytics Report Saved\n2|[5/8] step\n")
    want = {r.run_id: r.asDict() for r in rt.run_log_parse(logs.run_logs(spark, str(root))).collect()}
    put_log(root, 200, "z", f"1|{logs.END_OF_RUN}\n2|{logs.END_OF_RUN}\n")
    run()
    got = {}
    for r in spark.read.parquet(out).orderBy("batch_no").collect():
        got[r.run_id] = r.asDict()
    assert {k: {c: got[k][c] for c in want[k]} for k in want} == want and set(got) == {1, 2}
    assert got[1]["line_no"] == 4 and got[1]["progress_pct"] == 50 and got[1]["total_frames"] == 900 and got[1]["completed"]
    assert got[2]["line_no"] == 3 and got[2]["progress_pct"] == 100 and got[2]["vram"] == "2GB"


class Handle:
    """State and timer of one key in memory; counts the calls a state store would get."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, *schemas):
        return State(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def of(self):
        self.handle.calls += 1
        return self.handle.values.setdefault(self.name, {})

    def exists(self):
        return bool(self.of())

    def get(self):
        return self.of().get(None)

    def update(self, value):
        self.of()[None] = value

    def clear(self):
        self.of().clear()

    def keys(self):
        return list(self.of())

    def getValue(self, key):
        return self.of()[key]

    def updateValue(self, key, value):
        self.of()[key] = value

    def removeKey(self, key):
        del self.of()[key]


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def feed_key(arriving, apart_us, **options):
    """Results of one key whose rows arrive in batches of 30, a batch behind the watermark, and the calls of each batch."""
    columns = ["frame_idx", "dist_m"]
    processor = st._OrderedProcessor(lambda: mc.SpeedWindow(FPS), ["player_id"], ["frame_idx"], columns, ["frame_idx", "speed_kmh"], 1_000_000, **options)
    handle = Handle()
    processor.init(handle)
    out, calls, now = [], [], 0
    for k in range(0, len(arriving), 30):
        part = arriving[k : k + 30]
        batch = pd.DataFrame({"event_micros": [r[0] * apart_us for r in part], "frame_idx": [r[0] for r in part], "dist_m": [r[1] for r in part], "ended": None})
        handle.calls = 0
        out += list(processor.handleInputRows((7,), iter([batch[:20], batch[20:]]), Now(now)))
        calls.append(handle.calls)
        now = (k // 30 * 30 - 15) * apart_us // 1000
    out += list(processor.handleExpiredTimer((7,), Now((len(arriving) + 1) * apart_us // 1000 + 1000), None))
    assert not any(handle.values.values())  # the key is over
    return [tuple(r[1:]) for f in out for r in f.itertuples(index=False)], calls


@pytest.mark.parametrize("apart_us", [1000, 100_000, 5_000_000])
def test_a_batch_reads_and_writes_a_key_once(apart_us):
    """Also where every row of a key lies in a second of its own; a key with many rows keeps them in pieces, with equal results."""
    rng = random.Random(3)
    rows = [(f, rng.random()) for f in range(150)]
    arriving = sorted(rows, key=lambda r: r[0] + rng.random() * 10)
    machine = mc.SpeedWindow(FPS)
    want = [x for f, d in rows for x in machine.step({"frame_idx": f, "dist_m": d})]
    got, calls = feed_key(arriving, apart_us)
    assert got == want and max(calls) <= 5
    for near in (1, 4, 25):
        assert feed_key(arriving, apart_us, rows_near=near)[0] == want
