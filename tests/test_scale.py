"""Spans, halos and folds must give what one serial pass over each key gives, wherever the borders fall."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import fold
from fieldlens.fold import chunked_fold
from fieldlens.operators import court, deliveries, highlights, identity, possession, registration, shots
from fieldlens.scale import positions, running, with_halo
from fieldlens.sources import sinks


def series(seed, videos=3, frames=200, keep=0.7):
    rnd = random.Random(seed)
    return [(v, f, rnd.randint(0, 50), rnd.choice([None, rnd.randint(0, 9)])) for v in range(videos) for f in range(frames) if rnd.random() < keep]


@pytest.mark.parametrize("span", [7, 64, 100000])
def test_running_matches_serial(spark, rows, span):
    data = series(1)
    df = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, v bigint, maybe bigint").repartition(5)
    got = running(df, ["video_id"], "frame_idx", {
        "last_in": ("last", F.col("maybe"), True), "last_ex": ("last", F.col("maybe"), False),
        "total": ("sum", F.col("v"), False), "top": ("max", F.col("v"), False),
    }, span=span)
    back = running(df, ["video_id"], "frame_idx", {"next": ("last", F.col("maybe"), False)}, span=span, reverse=True)
    want, want_back = [], []
    for video in {d[0] for d in data}:
        mine = [d for d in data if d[0] == video]
        last, total, top = None, 0, None
        for _, f, v, m in mine:
            before = last
            last = m if m is not None else last
            want.append((video, f, last, before, total, top))
            total, top = total + v, v if top is None else max(top, v)
        nxt = None
        for _, f, v, m in reversed(mine):
            want_back.append((video, f, nxt))
            nxt = m if m is not None else nxt
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in got.select("video_id", "frame_idx", "last_in", "last_ex", "total", "top").collect()), key=key) == sorted(want, key=key)
    assert sorted((tuple(r) for r in back.select("video_id", "frame_idx", "next").collect()), key=key) == sorted(want_back, key=key)


def test_positions_and_halo(spark, rows):
    df = spark.createDataFrame(series(2), "video_id bigint, frame_idx bigint, v bigint, maybe bigint")
    numbered = positions(df, ["video_id"], "frame_idx", span=9)
    for video in range(3):
        got = [p for _, p in sorted((r.frame_idx, r.pos) for r in numbered.filter(F.col("video_id") == video).collect())]
        assert got == list(range(len(got)))
    halo = with_halo(df, "frame_idx", before=3, after=2, span=10)
    assert halo.filter("_core").count() == df.count()
    expected = sum(2 if f % 10 >= 7 else 1 for _, f, *_ in series(2)) + sum(1 for _, f, *_ in series(2) if f % 10 < 2)
    assert halo.count() == expected


def test_fold_repairs_wrong_starts(spark, rows):
    class Counter:
        """A machine that never forgets: warm-up cannot help it, only the repair rounds can."""

        def __init__(self):
            self.total = 0

        def state(self):
            return self.total

        def load(self, state):
            self.total = state

        def step(self, row):
            self.total += row["v"]
            return [(row["frame_idx"], self.total)]

    data = series(3, videos=2, frames=60)
    df = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, v bigint, maybe bigint").select("video_id", "frame_idx", "v")
    schema = T.StructType([T.StructField("frame_idx", T.LongType()), T.StructField("total", T.LongType())])
    got = rows(chunked_fold(df, ["video_id"], "frame_idx", Counter, schema, span=16, warmup=4))
    want, totals = [], {}
    for video, f, v, _ in data:
        totals[video] = totals.get(video, 0) + v
        want.append((video, f, totals[video]))
    assert got == sorted(want)


@pytest.mark.parametrize("gap", [3, 10])
def test_greedy_spacing(spark, rows, gap):
    rnd = random.Random(gap)
    events = [(v, f) for v in range(4) for f in range(600) if rnd.random() < (0.9 if v else 0.1)]
    want = []
    for v in range(4):
        last = None
        for _, f in (e for e in events if e[0] == v):
            if last is None or f - last >= gap:
                want.append((v, f))
                last = f
    df = spark.createDataFrame(events, "video_id bigint, frame_idx bigint")
    for span_gaps in (1, 4, 4096):
        assert rows(highlights.greedy_spacing(df, "frame_idx", gap, span_gaps=span_gaps)) == want


def test_merge_intervals(spark, rows):
    rnd = random.Random(5)
    data = [(v, s, s + rnd.randint(1, 30)) for v in range(3) for s in rnd.sample(range(1000), 60)]
    want = []
    for v in range(3):
        merged = []
        for s, e in sorted(d[1:] for d in data if d[0] == v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(v, *m) for m in merged]
    df = spark.createDataFrame(data, "video_id bigint, start_pos bigint, end_pos bigint")
    for span in (25.0, 1e6):
        assert rows(highlights.merge_intervals(df, span=span)) == sorted(want)


def near(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert (a is None and b is None) or a == b or abs(a - b) <= tol


def test_ema_matches_fold(spark, rows):
    rnd = random.Random(6)
    data = [(1, f, p, rnd.random() * 200, rnd.random() * 107) for p in (1, 2) for f in range(900) if rnd.random() < 0.8]
    df = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, player_id bigint, x double, y double")
    want, state, seen = [], {}, {}
    smooth = []
    for _, f, p, x, y in data:
        old = state.get(p)
        state[p] = (x, y) if old is None else (0.6 * x + 0.4 * old[0], 0.6 * y + 0.4 * old[1])
        want.append((1, f, p, *state[p]))
        prev = seen.get(p)
        seen[p] = (f, x, y) if prev is None or prev[0] != f - 1 else (f, 0.8 * prev[1] + 0.2 * x, 0.8 * prev[2] + 0.2 * y)
        smooth.append((1, f, p, *seen[p][1:]))
    cols = ("video_id", "frame_idx", "player_id", "x", "y")
    for span in (50, 1 << 16):
        near(rows(court.ema_positions(df, span=span), *cols), sorted(want))
        near(rows(court.minimap_smoothing(df, span=span), *cols), sorted(smooth))


def possession_serial(candidates, frames):
    from fieldlens.functions.machines import Possession

    machine = Possession()
    return [machine.step({"frame_idx": f, "candidate": candidates.get(f)})[0] for f in frames]


@pytest.mark.parametrize("span", [6, 1 << 16])
def test_possession_matches_state_machine(spark, rows, span):
    rnd = random.Random(7)
    cand, frames, want = [], [], []
    for v in range(6):
        known = {f: rnd.choice([-1, 1, 1, 2]) for f in range(150) if rnd.random() < (0.5 + v / 12)}
        cand += [(v, f, c) for f, c in known.items()]
        frames += [(v, f) for f in range(150)]
        want += [(v, *r) for r in possession_serial(known, range(150))]
    got = possession.possession(
        spark.createDataFrame(cand, "video_id bigint, frame_idx bigint, candidate bigint"),
        spark.createDataFrame(frames, "video_id bigint, frame_idx bigint"), span=span,
    )
    assert rows(got) == sorted(want)


def test_possession_restarts_with_batches(spark, rows):
    frames = [(1, f) for f in range(20)]
    cand = [(1, f, 5) for f in range(20)]
    got = possession.possession(
        spark.createDataFrame(cand, "video_id bigint, frame_idx bigint, candidate bigint"),
        spark.createDataFrame(frames, "video_id bigint, frame_idx bigint"), batch_size=10,
    )
    assert [h for *_, h in rows(got)] == ([-1] * 4 + [5] * 6) * 2


def ball_rows(seed, n=400, keep=0.7):
    rnd = random.Random(seed)
    x = y = 300.0
    out = []
    for f in range(n):
        x, y = x + rnd.uniform(-20, 20), y + rnd.uniform(-20, 20)
        if rnd.random() < 0.03:
            x, y = x + 400, y - 200
        if rnd.random() < keep:
            out.append((1, f, x - 5, y - 5, x + 5, y + 5, x, y, 0.9))
    return out


BALL = "video_id bigint, frame_idx bigint, x1 double, y1 double, x2 double, y2 double, cx double, cy double, conf double"


def test_kalman_is_the_serial_filter(spark, rows):
    """Against the matrix form of the filter, for a span that splits the video in many pieces."""
    import numpy as np

    data = ball_rows(8)
    seen = {d[1]: d for d in data}
    dt = 1 / 30
    step = np.eye(4)
    step[0, 2] = step[1, 3] = dt
    pick = np.eye(2, 4)
    noise = np.diag([5.0, 5.0, 50.0, 50.0])
    s = cov = last = None
    missed, want = 0, []
    for f in range(400):
        d = seen.get(f)
        jump = d and last and np.hypot(d[6] - last[0], d[7] - last[1]) > 150 and missed < 2
        if d is None and (s is None or missed >= 10):
            continue
        if d is None or jump:
            s, cov, missed = step @ s, step @ cov @ step.T + noise, missed + 1
            interpolated = True
        else:
            z = np.array([d[6], d[7]])
            if s is None:
                s, cov = np.array([*z, 0, 0]), np.eye(4) * 10.0
            else:
                gain = cov @ pick.T @ np.linalg.inv(pick @ cov @ pick.T + np.eye(2) * 3)
                s, cov = s + gain @ (z - pick @ s), (np.eye(4) - gain @ pick) @ cov
            missed, interpolated = 0, False
        last = (int(s[0]), int(s[1]))
        want.append((1, f, *last, interpolated))
    ball = spark.createDataFrame(data, BALL)
    frames = spark.createDataFrame([(1, f) for f in range(400)], "video_id bigint, frame_idx bigint")
    for span, warmup in ((32, 8), (1 << 16, 512)):
        got = deliveries.kalman_ball(ball, frames, span=span, warmup=warmup)
        assert rows(got, "video_id", "frame_idx", "cx", "cy", "interpolated") == want


def test_kalman_carries_states_over_spans_at_once(spark, rows, monkeypatch):
    """A ball that is never lost: nothing is forgotten, so every span's entry depends on all frames before it."""
    from fieldlens import fold
    from fieldlens.functions.machines import KalmanBall

    rnd, rounds = random.Random(11), []
    monkeypatch.setattr(fold, "_edges", lambda part, at, n, real=fold._edges: (rounds.append(n), real(part, at, n))[1])
    for kind in ("drift", "rest", "gaps"):
        data = []
        for f in range(3000):
            x, y = (640.0, 360.0) if kind == "rest" else (500 + 0.02 * f + rnd.uniform(-8, 8), 300 + rnd.uniform(-8, 8))
            if kind != "gaps" or rnd.random() < 0.9 and f % 700 > 30:
                data.append((1, f, x - 5, y - 5, x + 5, y + 5, x, y, 0.9))
        seen, machine, want = {d[1]: d for d in data}, KalmanBall(30), []
        for f in range(3000):
            d = seen.get(f, (1, f, *[None] * 7))
            want += [(1, *o) for o in machine.step(dict(zip(("frame_idx", "x1", "y1", "x2", "y2", "cx", "cy", "conf"), d[1:])))]
        rounds.clear()
        frames = spark.createDataFrame([(1, f) for f in range(3000)], "video_id bigint, frame_idx bigint")
        got = deliveries.kalman_ball(spark.createDataFrame(data, BALL), frames, span=100, warmup=20)
        assert rows(got, "video_id", "frame_idx", "cx", "cy", "interpolated") == sorted((w[0], w[1], w[2], w[3], w[5]) for w in want)
        assert len(rounds) <= 5  # log2 of 30 spans


def test_kalman_map_of_a_stretch():
    """Carried over a stretch of any pattern, a state is where the steps lead."""
    from fieldlens.functions.machines import KalmanBall

    rnd = random.Random(3)
    for _ in range(50):
        steps = [(rnd.uniform(100, 140), rnd.uniform(100, 140)) if rnd.random() < 0.7 else None for _ in range(rnd.randrange(1, 60))]
        one, two = KalmanBall(30, max_jump=1e9, max_missed=10**6), KalmanBall(30, max_jump=1e9, max_missed=10**6)
        one.load([[120.0, 110.0], [3.0, -2.0], [4.0, 0.5, 20.0], 0, [120, 110]])
        two.load([[90.0, 150.0], [0.0, 5.0], [10.0, 0.0, 10.0], 0, [90, 150]])
        one.track()
        for f, z in enumerate(steps):
            row = dict(zip(("frame_idx", "cx", "cy", "x1", "y1", "x2", "y2", "conf"), (f, *(z or (None, None)), 0, 0, 0, 0, 1)))
            one.step(row)
            two.step(row)
        start = [[90.0, 150.0], [0.0, 5.0], [10.0, 0.0, 10.0], 0, [90, 150]]
        assert two.same(two.state(), two.carry(start, one.map, one.state()))


def test_gate_and_shots_do_not_depend_on_spans(spark, rows):
    rnd = random.Random(9)
    dets = [(1, f, k, "ball", x := rnd.uniform(0, 900), y := rnd.uniform(0, 500), x + 10, y + 10, rnd.random())
            for f in range(300) for k in range(3) if rnd.random() < 0.6]
    d = spark.createDataFrame(dets, "video_id bigint, frame_idx bigint, det_id bigint, cls string, x1 double, y1 double, x2 double, y2 double, conf double")
    whole = rows(deliveries.ball_gate(d))
    assert whole and rows(deliveries.ball_gate(d, span=16, warmup=4)) == whole
    arcs = []
    for f in range(300):
        t = f % 60
        y = 500 - 14 * t + 0.35 * t * t
        if t < 45:
            arcs.append((1, f, 100.0 + 2 * t - 5, y - 5, 100.0 + 2 * t + 5, y + 5, 0.0, 0.0, 1.0))
    ball = spark.createDataFrame(arcs, BALL)
    frames = spark.createDataFrame([(1, f, 1280, 720) for f in range(300)], "video_id bigint, frame_idx bigint, width int, height int")
    whole = rows(shots.shot_state(ball, frames), "frame_idx", "conf", "shot")
    assert {c for _, c, _ in whole} > {0.0, 0.6}
    assert rows(shots.shot_state(ball, frames, span=24, warmup=8), "frame_idx", "conf", "shot") == whole


def test_shot_moments_match_polyfit():
    """The running moments give the fit of the window's points at every frame, also after clears and long gaps."""
    import numpy as np
    from fieldlens.functions.machines import ShotTracker

    rnd, tracker, frame, arcs = random.Random(3), ShotTracker(), 0, 0
    for k in range(4000):
        frame += 1 if rnd.random() < 0.97 else rnd.randint(2, 400)
        t = k % 70
        y = 900 - 30 * t + 0.5 * t * t + rnd.uniform(-3, 3) if k % 210 < 140 else rnd.uniform(0, 700)
        tracker.step({"frame_idx": frame, "width": 1280, "height": 720, "cx": 10.0, "cy": y})
        if len(tracker.points) > tracker.ENOUGH:
            ts, ys = (np.array([p[i] for p in tracker.points], dtype=float) for i in (0, 2))
            ts -= ts[0]
            a, b, c = np.polyfit(ts, ys, 2)
            r2 = 1 - ((ys - a * ts * ts - b * ts - c) ** 2).sum() / ((ys - ys.mean()) ** 2).sum()
            if abs(a - 0.1) > 1e-6 and abs(r2 - 0.8) > 1e-6:
                fits = a > 0.1 and r2 > 0.8
                assert tracker._arc() == (fits, bool(-b / (2 * a) < ts[-1]) if fits else False), k
                arcs += fits
        again = ShotTracker()
        again.load(tracker.state())
        assert again.state() == tracker.state()
    assert arcs > 100


@pytest.mark.parametrize("step", [1, 2, 3])
def test_court_shares_match_all_distances(step):
    """Ties, shared places, places off the court and frames in several pieces."""
    import numpy as np
    from fieldlens.operators.space import team1_counts

    rnd = np.random.default_rng(step)
    gx, gy = np.arange(0, 200, step), np.arange(0, 107, step)
    for n in (2, 3, 7, 12):
        xs, ys = rnd.integers(-5, 205, (40, n)).astype(float), rnd.integers(-5, 112, (40, n)).astype(float)
        xs[:10], ys[:5] = xs[:10] // 40 * 40, ys[:5] // 40 * 40
        xs[10:12], ys[10:12] = 50.0, 50.0
        team1 = rnd.random((40, n)) < 0.5
        want = []
        for x, y, team in zip(xs, ys, team1):
            near = ((gx - x[:, None]) ** 2)[:, None, :] + ((gy - y[:, None]) ** 2)[:, :, None]
            want.append(int(team[near.argmin(axis=0)].sum()))
        for cells in (1, 1 << 22):
            assert team1_counts(xs, ys, team1, step, cells).tolist() == want


def test_rolling_parabola_matches_polyfit(spark, rows):
    import numpy as np

    data = ball_rows(10, n=300)
    got = {r.frame_idx: r for r in shots.rolling_parabola(spark.createDataFrame(data, BALL), span=64).collect()}
    for i, d in enumerate(data):
        window = data[max(0, i - 44):i + 1]
        if len(window) < 16:
            assert d[1] not in got
            continue
        t = np.array([w[1] - window[0][1] for w in window], float)
        y = np.array([(w[3] + w[5]) / 2 for w in window])
        a, b, c = np.polyfit(t, y, 2)
        r2 = 1 - ((y - (a * t * t + b * t + c)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert abs(got[d[1]].a - a) < 1e-6 and abs(got[d[1]].r2 - r2) < 1e-6


def test_one_huge_video_is_spread_over_tasks(spark):
    """All rows in one video: the ordered operators still use every partition."""
    frames = spark.range(0, 40000).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(3).cast("bigint").alias("player_id"),
                                          (F.col("id") % 150).cast("double").alias("x"), (F.col("id") % 90).cast("double").alias("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = court.player_step_distance(frames, span=500)
        sizes = steps.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(s["count"] for s in sizes) < 40000 / 3


def test_rows_and_videos_do_not_interfere(spark, rows):
    """Shuffled input changes nothing, and a second video changes no row of the first."""
    rnd = random.Random(11)
    one = [(1, f, p, float(rnd.randint(0, 200)), float(rnd.randint(0, 107))) for f in range(60) for p in range(4)]
    two = [(2, *r[1:3], r[4], r[3] / 2) for r in one]
    ddl = "video_id bigint, frame_idx bigint, player_id bigint, x double, y double"
    alone = rows(court.player_speed(court.player_step_distance(spark.createDataFrame(one, ddl))))
    mixed = one + two
    rnd.shuffle(mixed)
    both = rows(court.player_speed(court.player_step_distance(spark.createDataFrame(mixed, ddl).repartition(7))))
    assert [r for r in both if r[0] == 1] == alone


def test_cascade_matches_modes(spark, rows):
    ident = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    frames = spark.createDataFrame([(1, f) for f in range(120)], "video_id bigint, frame_idx bigint")
    direct = [f for f in range(120) if f % 40 in (5, 6, 7)]
    moving = [f for f in range(120) if f % 3]
    h = spark.createDataFrame([(1, f, [1.3, 0.08, 40.0 + f, -0.04, 1.2, 70.0, 1e-4, 2e-4, 1.0]) for f in direct], "video_id bigint, frame_idx bigint, h array<double>")
    m = spark.createDataFrame([(1, f, [*ident[:2], 10.0, *ident[3:5], 5.0, *ident[6:]]) for f in moving], "video_id bigint, frame_idx bigint, m array<double>")
    whole = registration.cascade_homography(h, m, frames, budget=20)
    split = registration.cascade_homography(h, m, frames, budget=20, span=16, warmup=4)
    assert rows(whole, "frame_idx", "mode", "h") == rows(split, "frame_idx", "mode", "h")
    kps = spark.createDataFrame([(1, f, k, 1.0, 1.0) for f in direct for k in range(4)], "video_id bigint, frame_idx bigint, kp_idx bigint, x double, y double")
    modes = registration.homography_mode(kps, m.select("video_id", "frame_idx"), frames, budget=20, span=16)
    assert rows(modes, "frame_idx", "mode") == rows(whole, "frame_idx", "mode")


def test_referee_grid_finds_the_nearest(spark, rows):
    rnd = random.Random(12)
    box = lambda x, y: (x - 5, y - 5, x + 5, y + 5)
    tracks = [(1, f, p, *box(rnd.uniform(0, 300), rnd.uniform(0, 200))) for f in range(40) for p in range(30)]
    dets = [(1, f, 0, "referee", *box(rnd.uniform(0, 300), rnd.uniform(0, 200)), 0.9) for f in range(40)]
    want = []
    for _, f, _, _, x1, y1, x2, y2, _ in dets:
        d = min((((a + c) / 2 - (x1 + x2) / 2) ** 2 + ((b + e) / 2 - (y1 + y2) / 2) ** 2, p) for _, g, p, a, b, c, e in tracks if g == f)
        if d[0] < 19.2 ** 2:
            want.append((f, d[1]))
    got = identity.referee_match(
        spark.createDataFrame(tracks, "video_id bigint, frame_idx bigint, player_id bigint, x1 double, y1 double, x2 double, y2 double"),
        spark.createDataFrame(dets, "video_id bigint, frame_idx bigint, det_id bigint, cls string, x1 double, y1 double, x2 double, y2 double, conf double"),
        spark.createDataFrame([(1, f, 1280) for f in range(40)], "video_id bigint, frame_idx bigint, width int"), span=8)
    assert rows(got, "frame_idx", "player_id") == sorted(want)


def test_stored_stages_need_no_exchange(spark, rows):
    """Speeds, shots and bounces by delivery are computed where the stored points lie."""
    from fieldlens.plans.cricket_match import stored, where_they_lie

    schema = "video_id bigint, delivery_key bigint, frame_idx bigint, cx double, cy double, mx double, my double"
    rnd = random.Random(2)
    data = [(v, k, 40 * k + f, 9.0 * f + rnd.random(), abs(60.0 - 8 * f), 1.1 * f, rnd.uniform(-1, 1)) for v in range(3) for k in range(9) for f in range(15)]
    plain = spark.createDataFrame(data, schema)
    points = stored(plain, "test")
    assert rows(points) == rows(plain)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def speeds(p):
            last = p.groupBy("video_id", "delivery_key").agg((F.min("frame_idx") + 7).alias("bounce_frame"))
            return deliveries.delivery_speeds(deliveries.reconstruct_3d(p, last), last)

        with where_they_lie(spark):
            plan = speeds(points)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0, plan
        assert speeds(plain)._jdf.queryExecution().executedPlan().toString().count("Exchange") > 3
        assert rows(speeds(points)) == rows(speeds(plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_walk_over_many_keys_in_batches_of_any_cut():
    """One task walks over the spans of many keys without a call per key; a key may be cut between batches."""
    import json

    import pyarrow as pa

    edges = [(key, span, json.dumps(span if (key + span) % 3 else -1), json.dumps(span + 1), None) for key in (None, 1, 2) for span in range(4)
             if key is not None] + [(None, 0, "0", "5", None), (None, 1, "5", "6", None)]
    want = [(key, span, json.dumps(span)) for key, span, entry, *_ in edges if key is not None and span and entry == "-1"]
    schema = pa.schema([("key", pa.int64()), ("_chunk", pa.int64()), ("_forced", pa.string())])
    walk = fold._span_walk(dict, ["key"], schema)
    names = ["key", "_chunk", "_entry", "_exit", "_map"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for cut in (1, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*edges[i:i + cut]), types)], names) for i in range(0, len(edges), cut)]
        assert [tuple(r.values()) for b in walk(iter(batches)) for r in b.to_pylist()] == want


def test_centres_go_to_the_samples(spark, rows, monkeypatch):
    """No round shuffles the samples of a few videos; joined by video, many give the same teams."""
    rng = random.Random(8)
    data = [(v, p, v * 100 + k, [rng.gauss(9.0 * (p % 2), 1.0), rng.random()]) for v in range(3) for k in range(40) for p in [k % 6]]
    samples = spark.createDataFrame(data, "video_id bigint, player_id bigint, sample_id bigint, features array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = identity.team_colors(samples)
        assert "SortMergeJoin" not in sent._jdf.queryExecution().toString()
        monkeypatch.setattr(identity, "WIDELY", 0)
        joined = identity.team_colors(samples)
        assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
        assert rows(sent) == rows(joined) and len(rows(sent)) == 18
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_files_follow_the_rows(spark, rows, tmp_path):
    """A video's few players fill one file; what follows from a row may be added when it lies where it is written."""
    players = spark.createDataFrame([(v, p, f"p{p}") for v in range(3) for p in range(10)], "video_id bigint, player_id bigint, name string").repartition(5)
    videos = players.select("video_id").distinct().withColumn("n", F.lit(1))
    files = lambda root: [len(list(d.glob("*.json"))) for d in (tmp_path / root / "players").glob("video_id=*")]
    sinks.write_basketball_report(videos, players, str(tmp_path / "few"))
    sinks.write_basketball_report(videos, players, str(tmp_path / "more"), rows_per_file=4)
    assert files("few") == [1] * 3 and max(files("more")) in (2, 3)
    for root in ("few", "more"):
        assert rows(spark.read.schema(players.schema).json(str(tmp_path / root / "players")).select(*players.columns)) == rows(players)
    sinks.write_cricket_report(videos, players, str(tmp_path / "c"), lambda d: d.withColumn("text", F.concat("name", F.lit("!"))))
    assert {r.text for r in spark.read.json(str(tmp_path / "c" / "deliveries")).collect()} == {f"p{p}!" for p in range(10)}
