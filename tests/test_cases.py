"""Small cases with known answers, and boundary values of the rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.constants import court_reference
from fieldlens.functions import machines as mc
from fieldlens.functions.columns import convex_hull_area
from fieldlens.operators import court, cricket as ck, deliveries as dv, identity as ident, possession as poss, registration as rg, routing as rt, space

TRACKS = "video_id bigint, frame_idx bigint, player_id bigint, team int, is_referee boolean, is_sideline boolean, jersey string"
POS = "video_id bigint, frame_idx bigint, player_id bigint, x double, y double"


def tracks(spark, data):
    return spark.createDataFrame(data, TRACKS)


def test_possession_and_pass_summary(spark, rows):
    t = tracks(spark, [(1, f, p, p, False, False, None) for f in range(10) for p in (1, 2)])
    held = spark.createDataFrame([(1, f, 1 if f < 5 else 2) for f in range(10)], "video_id bigint, frame_idx bigint, holder_id bigint")
    assert rows(poss.possession_summary(held, t)) == [(1, 5, 5, 50.0, 50.0)]
    p = spark.createDataFrame([(1, f, v) for f, v in enumerate((1, 0, 1))], "video_id bigint, frame_idx bigint, pass_team int")
    i = spark.createDataFrame([(1, f, v) for f, v in enumerate((0, 2))], "video_id bigint, frame_idx bigint, interception_team int")
    assert rows(poss.pass_summary(p, i)) == [(1, 2, 0, 0, 1)]


def test_first_frame_never_seeds_an_interception(spark, rows):
    t = tracks(spark, [(1, f, p, p, False, False, None) for f in range(4) for p in (1, 2)])
    for holders, want in (([1, 2, 2, 2], [0, 0, 0, 0]), ([-1, 1, -1, 2], [0, 0, 0, 2])):
        held = spark.createDataFrame([(1, f, h) for f, h in enumerate(holders)], "video_id bigint, frame_idx bigint, holder_id bigint")
        assert [r[2] for r in rows(poss.interceptions(held, t))] == want
        assert sum(r[2] for r in rows(poss.passes(held, t))) == 0


def test_heatmap_filter(spark, rows):
    spots = [(1, 100.0, 50.0, False), (2, 0.0, 40.0, False), (3, -10.0, 30.0, False), (4, 120.0, 108.0, False), (5, 50.0, 50.0, True)]
    p = spark.createDataFrame([(1, 0, i, x, y) for i, x, y, _ in spots], POS)
    t = tracks(spark, [(1, 0, i, 1, False, s, None) for i, _, _, s in spots])
    assert rows(court.heatmap_point_filter(p, t), "player_id") == [(1,)]


def test_officials(spark, rows):
    data = [(1, f, p, team, ref, False, j) for f in range(20) for p, team, ref, j in ((1, 1, False, "23"), (2, 0, False, None), (3, 1, True, None))]
    t = tracks(spark, data)
    assert rows(ident.official_filter(t).filter("NOT is_official"), "player_id") == [(1,)]
    assert rows(ident.jersey_vote(t), "player_id", "jersey") == [(1, "23")]


def test_consolidation(spark, rows):
    stats = spark.createDataFrame(
        [(1, 4, 1, "7", 20, 20, 100.0, 200.0, 20, 10.0), (1, 19, 1, "7", 15, 15, 60.0, 240.0, 15, 16.0)],
        "video_id bigint, player_id bigint, team int, jersey string, jersey_votes bigint, frames bigint, dist_m double, speed_sum double, speed_samples bigint, max_speed double")
    seen = [(1, f, 4, 1, "7") for f in range(20)] + [(1, f, 19, 1, "7") for f in range(20, 35)]
    overlaps = ident.overlap_tracks(spark.createDataFrame(seen, "video_id bigint, frame_idx bigint, player_id bigint, team int, jersey string"))
    got = ident.consolidate_players(stats, overlaps).collect()
    assert len(got) == 1
    assert (got[0].track_ids, got[0].display_label, got[0].total_distance_m, got[0].max_speed_kmh) == ([4, 19], "#7", 160.0, 16.0)
    both = [(1, f, p, 1, "7") for f in range(20) for p in (4, 19)]
    clash = ident.overlap_tracks(spark.createDataFrame(both, "video_id bigint, frame_idx bigint, player_id bigint, team int, jersey string"))
    assert rows(ident.consolidate_players(stats, clash), "player_id", "display_label") == [(4, "#7"), (19, "Track #19")]


def team_positions(spark, spots):
    p = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y, _) in enumerate(spots)], POS)
    return p, tracks(spark, [(1, 0, i, t, False, False, None) for i, (_, _, t) in enumerate(spots)])


def test_dominance(spark, rows):
    even = [(50, 20, 1), (50, 53, 1), (50, 87, 1), (150, 20, 2), (150, 53, 2), (150, 87, 2)]
    control = space.voronoi_control(*team_positions(spark, even)).collect()[0]
    assert abs(control.team1_pct - 50) <= 5
    many = [(40, 30, 1), (90, 30, 1), (40, 80, 1), (120, 60, 1), (180, 20, 2), (180, 90, 2)]
    control = space.voronoi_control(*team_positions(spark, many)).collect()[0]
    assert control.team1_pct > 60 and control.dominant_team == 1
    lone = space.voronoi_control(*team_positions(spark, [(10, 10, 1)]))
    assert rows(lone, "team1_pct", "team2_pct", "dominant_team") == [(50.0, 50.0, 0)]
    assert rows(space.match_dominance(lone)) == [(1, 50.0, 50.0)]


def test_hull(spark, rows):
    p, t = team_positions(spark, [(10, 10, 1), (10, 50, 1), (50, 10, 1), (150, 50, 2)])
    areas = dict(rows(space.hull_area(p, t), "team", "hull_area_m2"))
    assert 15 < areas[1] < 16.5 and areas[2] == 0.0


def test_hull_against_brute_force(spark):
    rnd = random.Random(1)
    sets = [[(rnd.randint(0, 20), rnd.randint(0, 20)) for _ in range(rnd.randint(3, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in set(s)]) for i, s in enumerate(sets)], "i bigint, p array<struct<x:double,y:double>>")
    got = {r.i: r.a for r in df.select("i", convex_hull_area("p").alias("a")).collect()}

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    for i, s in enumerate(sets):
        pts, twice = set(s), 0
        for a, b in itertools.permutations(pts, 2):
            if all(cross(a, b, c) > 0 or (cross(a, b, c) == 0 and (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0) for c in pts):
                twice += a[0] * b[1] - a[1] * b[0]
        assert got[i] == pytest.approx(abs(twice) / 2 if len(pts) >= 3 else 0)


def test_steps_deadband_and_jumps(spark, rows):
    p = spark.createDataFrame([(1, 0, 1, 10.0, 10.0), (1, 1, 1, 10.05, 10.0), (1, 2, 1, 15.0, 10.0), (1, 3, 1, 150.0, 10.0), (1, 9, 2, 5.0, 5.0)], POS)
    got = [round(r[3], 4) for r in rows(court.player_step_distance(p), "video_id", "player_id", "frame_idx", "dist_m")]
    assert got == [0.0, 0.0, round(4.95 * 0.14, 4), 0.0, 0.0]


def test_projection_clamps(spark, rows):
    h = [1.3, 0.08, 40.0, -0.04, 1.2, 70.0, 0.0001, 0.0002, 1.0]
    calib = spark.createDataFrame([(1, 0, 10, h)], "video_id bigint, frame_from bigint, frame_to bigint, h array<double>")
    points = spark.createDataFrame([(1, 0, 1, 140.0, 30.0), (1, 0, 2, 5000.0, 9000.0), (1, 11, 3, 1.0, 1.0)], POS)
    got = rows(court.project_points(points, calib), "player_id", "x", "y")
    assert [g[0] for g in got] == [1] and 0 <= got[0][1] <= 200 and 0 <= got[0][2] <= 107


def test_homography_quality(spark, rows):
    h = [1.3, 0.08, 40.0, -0.04, 1.2, 70.0, 0.0001, 0.0002, 1.0]
    import numpy as np

    inv = np.linalg.inv(np.array(h).reshape(3, 3))
    ref = court_reference()
    shifted = []
    for i, x, y in ref:
        p = inv @ np.array([x + 600, y + 400, 1.0])
        shifted.append((1, 0, i, float(p[0] / p[2]), float(p[1] / p[2])))
    moved = np.array([[1, 0, -600.0], [0, 1, -400.0], [0, 0, 1]]) @ np.array(h).reshape(3, 3)
    calib = spark.createDataFrame([(1, 0, 0, [float(v) for v in moved.ravel()])], "video_id bigint, frame_from bigint, frame_to bigint, h array<double>")
    kps = spark.createDataFrame(shifted, "video_id bigint, frame_idx bigint, kp_idx bigint, x double, y double")
    good = rg.homography_quality(kps, calib, rg.court_reference_table(spark)).collect()[0]
    assert good.mean_error < 1e-6 and not good.is_flipped
    mirrored = calib.withColumn("h", F.transform("h", lambda v, i: F.when(i < 3, -v).otherwise(v)))
    assert rg.homography_quality(kps, mirrored, rg.court_reference_table(spark)).collect()[0].is_flipped


def test_ratio_validation_against_serial(spark, rows):
    rnd = random.Random(2)
    ref = {i: (x, y) for i, x, y in court_reference()}
    data = []
    for f in range(60):
        for i, (x, y) in ref.items():
            if rnd.random() < 0.6:
                jitter = rnd.uniform(-300, 300) if rnd.random() < 0.3 else 0
                data.append((1, f, i, max(0.0, 5.0 * x + 30 + jitter), max(0.0, 5.0 * y + 20)))
    want = []
    dist = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    for f in range(60):
        pts = {i: (x, y) for _, g, i, x, y in data if g == f}
        seen, bad = [i for i in sorted(pts) if pts[i][0] > 0 and pts[i][1] > 0], []
        for i in seen if len(seen) >= 3 else []:
            others = [j for j in seen if j != i and j not in bad]
            if len(others) < 2:
                continue
            j, k = others[:2]
            tij, tik, dik = dist(ref[i], ref[j]), dist(ref[i], ref[k]), dist(pts[i], pts[k])
            ratio = dist(pts[i], pts[j]) / dik if dik > 0 else math.inf
            if tij > 0 and tik > 0 and abs((ratio - tij / tik) / (tij / tik)) > 0.8:
                bad.append(i)
        want += [(f, i) for i in bad]
    kps = spark.createDataFrame(data, "video_id bigint, frame_idx bigint, kp_idx bigint, x double, y double")
    got = rows(rg.keypoint_ratio_validation(kps, rg.court_reference_table(spark)).filter("rejected"), "frame_idx", "kp_idx")
    assert want and got == sorted(want)


def test_continuity(spark, rows):
    m = spark.createDataFrame([(1, 0, "direct"), (1, 1, "cmc")], "video_id bigint, frame_idx bigint, mode string")
    assert rows(rg.tracking_continuity(m)) == [(1, 2, 50.0, 50.0, 100.0, 0.0)]


def test_segmentation_limits(spark, rows):
    """Gaps of 15 and 16 lost frames, and flights of 4 and 5 ball frames."""
    def run(ball, end, bat=None):
        b = spark.createDataFrame([(1, f) for f in ball], "video_id bigint, frame_idx bigint")
        t = spark.createDataFrame([(1, f, "batsman") for f in (bat if bat is not None else range(end))], "video_id bigint, frame_idx bigint, role string")
        f = spark.createDataFrame([(1, f) for f in range(end)], "video_id bigint, frame_idx bigint")
        return rows(dv.deliveries_segment(b, t, f, span=20), "start_frame", "last_ball_frame", "done_frame", "ball_frames", "forced")

    five, four = list(range(0, 5)), list(range(0, 4))
    assert run(five + [20, 21], 60) == [(0, 21, 37, 7, False)]  # 15 lost frames: one delivery
    assert run(five + [21, 22, 23, 24, 25], 60) == [(0, 4, 20, 5, False), (21, 25, 41, 5, False)]  # 16 lost frames: two
    assert run(four, 60) == [] and run(four, 15) == [(0, 3, 14, 4, True)]
    assert run(five, 60, bat=[]) == [] and run([0, 1, 2, 3, 4, 5, 6], 60, bat=[2]) == [(2, 6, 22, 5, False)]


def test_live_over(spark):
    """Six balls of 10 frames from every 40th frame, the fourth flight too short, then one cut off by the end of the video."""
    seen = [40 * k + f for k in range(8) for f in range(3 if k == 3 else 10)]
    video, frame = "video_id bigint, frame_idx bigint", range(292)
    b = spark.createDataFrame([(1, f) for f in seen], video)
    t = spark.createDataFrame([(1, f, "batsman") for f in frame], video + ", role string")
    f = spark.createDataFrame([(1, f) for f in frame] + [(2, 0)], video)
    for span in (24, 1000):
        got = {(r.video_id, r.frame_idx): r for r in ck.live_over(f, dv.flights(b, t, f, span=span), span=span).collect()}
        assert len(got) == 293 and got[2, 0].over == "0.0"
        text = lambda n: (got[1, n].over, got[1, n].in_flight, got[1, n].just_completed)
        assert text(0) == ("0.1", True, False) and text(24) == ("0.1", True, False)
        assert text(25) == ("0.1", False, True) and text(26) == ("0.1", False, False)
        assert text(120) == ("0.4", True, False) and text(138) == ("0.3", False, False)  # three frames of ball are none
        assert text(265) == ("0.6", False, True) and text(266) == ("1.0", False, False)
        assert text(280) == ("1.1", True, False) and text(291) == ("1.1", True, False)
    early = "frame_idx < 245"
    cut = dv.deliveries_segment(b.filter(early), t, f.filter(early), span=50).select("video_id", "start_frame", "forced")
    assert [r.over for r in ck.over_notation(cut, "start_frame").orderBy("start_frame").collect()] == ["0.1", "0.2", "0.3", "0.4", "0.5", "1.0"]


def test_delivery_points_take_all_since_the_last_completion(spark, rows):
    d = spark.createDataFrame([(1, 10, 36), (1, 50, 76)], "video_id bigint, start_frame bigint, done_frame bigint")
    p = spark.createDataFrame([(1, f, 0.0) for f in (2, 12, 36, 37, 60, 76, 77)], "video_id bigint, frame_idx bigint, cx double")
    for span in (10, 1000):
        assert rows(dv.delivery_points(p, d, span=span), "frame_idx", "delivery_key") == [(2, 10), (12, 10), (36, 10), (37, 50), (60, 50), (76, 50)]


@pytest.mark.parametrize("y,label", [(-0.61, "Wide Outside Off"), (-0.60, "Outside Off"), (-0.15, "On the Stumps"), (0.15, "On the Stumps"), (0.60, "Leg Stump / Pad Line"), (0.61, "Down Leg Side")])
def test_line_limits(spark, y, label):
    df = spark.createDataFrame([(1, 10.0, y)], "video_id bigint, metric_x double, metric_y double")
    assert ck.line_length(df).first().line == label


@pytest.mark.parametrize("x,label", [(20.12 - 1.9, "Yorker"), (20.12 - 2.1, "Full"), (20.12 - 4.1, "Good Length"), (20.12 - 6.6, "Short of Length"), (20.12 - 8.6, "Bouncer / Short"), (None, "Good Length")])
def test_length_limits(spark, x, label):
    df = spark.createDataFrame([(1, x, None)], "video_id bigint, metric_x double, metric_y double")
    row = ck.line_length(df).first()
    assert row.length == label and row.line == ("Middle" if x is not None else "On the Stumps")


def review(spark, **changes):
    base = dict(pitch_x=0.0, pitch_y=15.0, impact_x=0.0, impact_y=18.0, stump_x=0.0, stump_z=0.4, hand="RHB", on_field_call="NOT OUT", shot_offered=True, bat_edge=False)
    base.update(changes)
    ddl = "pitch_x double, pitch_y double, impact_x double, impact_y double, stump_x double, stump_z double, hand string, on_field_call string, shot_offered boolean, bat_edge boolean"
    return ck.lbw_verdict(spark.createDataFrame([tuple(base.values())], ddl)).first()


def test_lbw_rules(spark):
    assert review(spark).final_verdict == "OUT"
    assert review(spark, bat_edge=True).final_verdict == "NOT OUT"
    assert review(spark, pitch_x=0.12).pitching == "OUTSIDE LEG" and review(spark, pitch_x=0.1143).pitching == "IN-LINE"
    assert review(spark, pitch_x=0.12, hand="LHB").pitching == "OUTSIDE OFF"
    assert review(spark, pitch_x=None, pitch_y=None).pitching == "FULL TOSS"
    assert review(spark, impact_x=-0.2).final_verdict == "NOT OUT" and review(spark, impact_x=-0.2, shot_offered=False).final_verdict == "OUT"
    assert review(spark, stump_z=0.75).wickets == "UMPIRE'S CALL" and review(spark, stump_z=0.78).wickets == "MISSING"
    assert review(spark, stump_z=0.75, on_field_call="OUT").final_verdict == "OUT" and review(spark, stump_z=0.75).final_verdict == "NOT OUT"
    assert review(spark, pitch_y=17.7).reasons.startswith("Impact within 40cm")
    assert review(spark, impact_y=17.0, stump_x=0.1).reasons.startswith("ICC 3-Meter Law applies (3.12m")
    assert review(spark, impact_y=17.0).reasons.startswith("Three Reds despite")


def test_stumps_projection_against_plain_loop(spark):
    rnd = random.Random(3)
    data = [tuple(rnd.uniform(a, b) for a, b in ((-0.3, 0.3), (5, 20.5), (0, 1.5), (-1, 1), (-5, 40), (-5, 5))) for _ in range(100)]
    df = spark.createDataFrame(data, "x double, y double, z double, vx double, vy double, vz double")
    for r in dv.project_to_stumps(df).collect():
        x, y, z, vx, vy, vz = r.x, r.y, r.z, r.vx, r.vy, r.vz
        vy = 30.0 if vy <= 1 else vy
        pts, dt, n = [(x, y, z)], 1 / 30, 0
        while y < 20.12 and n < 100:
            n += 1
            x, y, z = x + vx * dt, y + vy * dt, z + vz * dt - 0.5 * 9.81 * dt * dt
            v = math.sqrt(vx * vx + vy * vy + vz * vz)
            vx, vy, vz = vx - 0.007 * v * vx * dt, vy - 0.007 * v * vy * dt, vz + (-0.007 * v * vz - 9.81) * dt
            pts.append((x, min(20.12, y), max(0.0, z)))
        a, b = pts[-2] if len(pts) > 1 else pts[-1], pts[-1]
        part = min(1.0, max(0.0, (20.12 - a[1]) / max(1e-5, b[1] - a[1])))
        assert r.stump_x == pytest.approx(a[0] + part * (b[0] - a[0])) and r.stump_z == pytest.approx(max(0.0, a[2] + part * (b[2] - a[2])))


def test_live_speed_equals_batch_speed(spark):
    from fieldlens.functions.machines import release_speed

    rnd = random.Random(4)
    for n in (2, 3, 4, 9, 20):
        frames = sorted(rnd.sample(range(40), n))
        pts = [[f, f * 0.9 + rnd.random(), rnd.uniform(-1, 1)] for f in frames]
        df = spark.createDataFrame([(1, 1, *p) for p in pts], "video_id bigint, delivery_key bigint, frame_idx bigint, mx double, my double")
        none = spark.createDataFrame([], "video_id bigint, delivery_key bigint, bounce_frame bigint")
        batch = dv.delivery_speeds(dv.reconstruct_3d(df, none), none).first()
        assert batch.release_speed_kmh == pytest.approx(release_speed(pts, 30.0))


def test_teams_from_two_colors(spark, rows):
    """Two videos with different colours: each gets its own two teams."""
    rnd = random.Random(5)
    kits = {1: ((20, 20, 200), (200, 200, 20)), 2: ((120, 20, 20), (220, 220, 220))}
    data = [(v, p, p * 100 + k, [rnd.gauss(c, 5) for c in kits[v][p >= 5]]) for v in kits for p in range(10) for k in range(20)]
    df = spark.createDataFrame(data, "video_id bigint, player_id bigint, sample_id bigint, features array<double>")
    got = rows(ident.team_colors(df), "video_id", "player_id", "team")
    assert got == [(v, p, 1 if p < 5 else 2) for v in kits for p in range(10)]
    low = {(v, p): t for v, p, t in rows(ident.team_colors(df, components=2), "video_id", "player_id", "team")}
    for v in kits:
        assert len({low[v, p] for p in range(5)}) == 1 and len({low[v, p] for p in range(5, 10)}) == 1 and low[v, 0] != low[v, 9]


def test_route_and_samples(spark, rows):
    v = spark.createDataFrame([(1, 30.0, 100), (2, 30.0, 0)], "video_id bigint, fps double, total_frames bigint")
    assert [r[0] for r in rows(rt.sample_frames(v), "frame_idx")] == [10, 30, 50, 70, 90]
    votes = spark.createDataFrame([(1, f, "cricket" if f < 3 else "basketball", 0.8) for f in range(5)] + [(2, f, "cricket" if f % 2 else "basketball", 0.7) for f in range(4)],
                                  "video_id bigint, frame_idx bigint, sport string, conf double")
    assert rows(rt.route_votes(votes), "video_id", "sport") == [(1, "cricket"), (2, "unknown")]


def test_empty_and_single_inputs(spark, rows):
    p = spark.createDataFrame([], POS)
    assert court.player_speed(court.player_step_distance(p)).count() == 0
    one = spark.createDataFrame([(1, 5, 1, 3.0, 4.0)], POS)
    assert rows(court.ema_positions(one)) == [(1, 5, 1, 3.0, 4.0)]
    frames = spark.createDataFrame([(1, f) for f in range(8)], "video_id bigint, frame_idx bigint")
    assert {r[3] for r in rows(court.fill_positions(one, frames))} == {3.0}
    none = spark.createDataFrame([], "video_id bigint, frame_idx bigint, candidate bigint")
    assert {r[2] for r in rows(poss.possession(none, frames))} == {-1}


def test_catalog_reads_files(spark, tmp_path):
    from fieldlens.sources import catalog

    (tmp_path / "cricket").mkdir()
    (tmp_path / "a.mp4").write_bytes(b"x" * 2048)
    (tmp_path / "cricket" / "a.mp4").write_bytes(b"y")
    (tmp_path / "cricket" / "b.MOV").write_bytes(b"z")
    (tmp_path / "notes.txt").write_text("no video")
    files = catalog.scan_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    none = spark.createDataFrame([], "path string, content string")
    got = {r.name: r for r in catalog.video_catalog(files, none, str(tmp_path), "/out").collect()}
    assert set(got) == {"a.mp4", "b.MOV"}
    assert got["a.mp4"].path == f"{tmp_path}/a.mp4" and got["b.MOV"].detected_sport == "cricket"


def test_display_rules(spark, rows):
    labels = spark.createDataFrame([("late_cut",), ("UMPIRE'S CALL",), ("good length/full",)], "t string")
    assert rows(ck.display_label(labels, "t"), "display_label") == [("Good Length/Full",), ("Late Cut",), ("UMPIRE'S CALL".replace("S ", "S "),)]
    secs = spark.createDataFrame([(5.9,), (65.0,), (3661.0,)], "seconds double")
    assert [r.duration for r in ck.format_duration(secs).collect()] == ["5s", "1m 5s", "1h 1m 1s"]


def test_delivery_session_ends_with_the_video():
    def walk(balls, last, bat=0):
        machine = mc.DeliverySession()
        given = [d for f in range(last + 1) for d in machine.step({"frame_idx": f, "has_ball": f in balls, "has_batsman": f >= bat})]
        return given + machine.finish()

    assert walk({3, 4, 5, 6}, 10) == [(3, 6, 10, 4)]  # cut off by the end: four sightings are enough
    assert walk({3, 4, 5}, 10) == []
    assert walk({3, 4, 5, 6}, 40) == []  # ran out: five are needed
    assert walk({3, 4, 5, 6, 7}, 40) == [(3, 7, 23, 5)]
    assert walk({1, 2, 3, 4, 5, 30, 31, 32, 33}, 35, bat=2) == [(30, 33, 35, 4)]


def test_fill_positions_per_batch(spark, rows):
    frames = spark.createDataFrame([(1, f) for f in range(8)], "video_id bigint, frame_idx bigint")
    seen = spark.createDataFrame([(1, 0, 1, 0.0, 0.0), (1, 2, 1, 4.0, 2.0), (1, 7, 1, 9.0, 9.0), (1, 5, 2, 1.0, 1.0)], POS)
    got = rows(court.fill_positions(seen, frames, batch_size=4), "player_id", "frame_idx", "x")
    assert got == [(1, 0, 0.0), (1, 1, 2.0), (1, 2, 4.0), (1, 3, 4.0), *[(1, f, 9.0) for f in range(4, 8)], *[(2, f, 1.0) for f in range(4, 8)]]


def test_referee_flag_from_the_deciding_batch(spark, rows):
    tracks = spark.createDataFrame([(1, f, p, False) for f in (0, 24, 25, 49, 80) for p in (1, 2)], "video_id bigint, frame_idx bigint, player_id bigint, is_referee boolean")
    matches = spark.createDataFrame([(1, 30, 1, True), (1, 60, 1, True), (1, 10, 2, False)], "video_id bigint, frame_idx bigint, player_id bigint, is_referee boolean")
    got = rows(ident.referee_tracks(tracks, matches, batch_size=25).filter("is_referee"), "player_id", "frame_idx")
    assert got == [(1, 25), (1, 49), (1, 80)]


def test_jersey_readings_without_limit(spark, rows):
    said = spark.createDataFrame([(1, f, 1, "7" if f >= 60 else "x", 0.9) for f in range(80)], "video_id bigint, frame_idx bigint, player_id bigint, text string, prob double")
    assert {r.jersey for r in ident.jersey_ocr_votes(said).collect()} == {None}
    late = rows(ident.jersey_ocr_votes(said, attempts=None).filter("jersey IS NOT NULL"), "frame_idx", "jersey", "locked")
    assert late == [(60, "7", False), (65, "7", True), (70, "7", True), (75, "7", True)]
