"""Streaming and report queries: each feeds the given tables to a stream in slices and reads what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import court, cricket as ck, highlights as hl, possession as poss
from fieldlens.plans import reports
from fieldlens.plans.court_queries import holders, six
from fieldlens.plans.cricket_queries import D, described
from fieldlens.plans.delivery_queries import modes
from fieldlens.plans.identity_queries import CUT
from fieldlens.plans.registry import Tables, derive, query, rounded as R
from fieldlens.scale import durable, shared_dir
from fieldlens.sources import catalog, logs, sinks
from fieldlens.streaming import streams as st

SLICES = (0, 37, 80, None)


def folder(t: Tables) -> str:
    """A fresh folder in the cluster's shared place."""
    return f"{shared_dir(t.spark)}/fieldlens-{uuid.uuid4().hex}"


def feed(df: DataFrame, path: str, axis: str = "frame_idx", slices=SLICES, key: str = "video_id", **options) -> DataFrame:
    """Write the table in slices, as it would arrive, and open it as a stream."""
    staged = f"{path}-staged"
    df.write.mode("overwrite").parquet(staged)
    for low, high in zip(slices, slices[1:]):
        part = df.sparkSession.read.parquet(staged).filter(F.col(axis) >= low)
        part = part if high is None else part.filter(F.col(axis) < high)
        part.repartition(key).write.mode("append").parquet(path)
    return st.stream_tracks(df.sparkSession, path, df.schema, **{"at": axis, **options})


def run(t: Tables, df: DataFrame, build, **options) -> DataFrame:
    root = folder(t)
    stream = feed(df, f"{root}/in", max_files=8, **options)
    st.checkpointed_run(build(stream), f"{root}/out", f"{root}/state")
    return t.spark.read.parquet(f"{root}/out")


JITTER, DELAY, IDLE = 10, 60, 30  # frames


def shuffled_feed(t: Tables, df: DataFrame, ends: DataFrame, root: str, axis: str, fps: float, cuts) -> DataFrame:
    """A stream of rows up to ``JITTER`` frames out of order, with the ends of the videos last.

    Slices have as many files as a batch reads, so the watermark moves with every slice.
    """
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    late = F.pmod(F.xxhash64(*df.columns), F.lit(JITTER + 1)).cast("bigint")
    rows = df.withColumn(st.ENDED, F.lit(False)).withColumn("arrival", F.col(axis) + late)
    rows = durable(rows.unionByName(ends, allowMissingColumns=True))
    cuts = [F.col("arrival") >= c for c in cuts]
    for part in [*[low & ~high for low, high in zip(cuts, cuts[1:])], cuts[-1], F.col(st.ENDED)]:
        rows.filter(part).drop("arrival").repartition(files).write.mode("append").parquet(f"{root}/in")
    schema = rows.drop("arrival").schema
    return st.stream_tracks(t.spark, f"{root}/in", schema, fps, max_files=files, delay=f"{DELAY * 1000 // int(fps)} milliseconds", at=axis, start=86400.0)


def disordered(t: Tables, df: DataFrame, build) -> DataFrame:
    """What a stream gives out for rows that arrive out of order."""
    root = folder(t)
    ends = st.video_ends(t.videos, DELAY + 2 * IDLE)
    stream = shuffled_feed(t, df, ends, root, "frame_idx", 30.0, (0, 30, 60, 90))
    st.checkpointed_run(build(stream), f"{root}/out", f"{root}/state")
    return t.spark.read.parquet(f"{root}/out")


def with_ball(t: Tables) -> DataFrame:
    boxes = t.ball.select("video_id", "frame_idx", "cx", "cy", "conf", "x1", "y1", "x2", "y2")
    return t.frames.select("video_id", "frame_idx", "width", "height").join(boxes, ["video_id", "frame_idx"], "left")


query("stream_tracks", lambda t: run(t, t.tracks, lambda s: s.drop("event_time")), ("tracks",), "SELECT * FROM tracks")


def resumed(t: Tables) -> DataFrame:
    """Process the first slices, stop, let more arrive, and go on from the checkpoint."""
    root = folder(t)
    first = feed(t.tracks, f"{root}/in", slices=(0, 37, 80), max_files=2).drop("event_time")
    st.checkpointed_run(first, f"{root}/out", f"{root}/state")
    again = feed(t.tracks, f"{root}/in", slices=(80, None), max_files=2).drop("event_time")
    st.checkpointed_run(again, f"{root}/out", f"{root}/state")
    return t.spark.read.parquet(f"{root}/out")


query("checkpointed_run", resumed, ("tracks",), "SELECT * FROM tracks")


def audio_stream(t: Tables) -> DataFrame:
    """Samples at 32 per second; every window is given out in the batch that completes it."""
    root = folder(t)
    samples = t.audio.select("video_id", "sample_idx", "amplitude")
    stream = feed(samples, f"{root}/in", axis="sample_idx", slices=(0, 300, None), fps=32.0, max_files=1 << 20)
    st.latest_run(st.audio_energy_stream(stream, hop=8), f"{root}/out", f"{root}/state")
    out = t.spark.read.parquet(f"{root}/out")
    return out.select("video_id", (F.unix_micros("start") / 250000).cast("bigint").alias("window_idx"), "energy")


query("audio_energy_stream", lambda t: six(audio_stream(t), "energy"), ("energy",), f"SELECT video_id, window_idx, {R('energy', 6)} AS energy FROM energy")


def sightings(t: Tables) -> DataFrame:
    bat = t.roles.filter("role = 'batsman'").select("video_id", "frame_idx").distinct().withColumn("has_batsman", F.lit(True))
    ball = t.ball.select("video_id", "frame_idx").distinct().withColumn("has_ball", F.lit(True))
    spine = t.frames.select("video_id", "frame_idx").join(ball, ["video_id", "frame_idx"], "left").join(bat, ["video_id", "frame_idx"], "left")
    return spine.fillna(False, ["has_ball", "has_batsman"])


query("delivery_sessions", lambda t: disordered(t, sightings(t), st.delivery_sessions),
      ("segments",), "SELECT video_id, start_frame, last_ball_frame, done_frame, ball_frames FROM segments")
query("delivery_sessions_open", lambda t: disordered(t, sightings(t), lambda s: st.delivery_sessions(s, dead_frames=30)),
      ("segments_open",), "SELECT video_id, start_frame, last_ball_frame, done_frame, ball_frames FROM segments_open")
derive("ball_islands", ("ball", "roles"), """
WITH s AS (SELECT b.video_id, b.frame_idx, r.video_id IS NOT NULL AS bat FROM ball b
    LEFT JOIN (SELECT DISTINCT video_id, frame_idx FROM roles WHERE role = 'batsman') r USING (video_id, frame_idx)),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_idx) AS isl FROM (
    SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) < 17 THEN 0 ELSE 1 END AS brk FROM s) b)
SELECT video_id, min(frame_idx) AS first_ball_frame, max(frame_idx) AS last_ball_frame, min(CASE WHEN bat THEN frame_idx END) AS start_frame, count(*) AS ball_frames
FROM i GROUP BY video_id, isl""")
query("ball_sessions", lambda t: disordered(t, sightings(t).filter("has_ball"), st.ball_sessions), ("ball_islands",), "SELECT * FROM ball_islands")
query("stateful_tracking", lambda t: six(disordered(t, with_ball(t).drop("width", "height"), st.kalman_stream), "conf"),
      ("tracked",), "SELECT * FROM tracked")


def candidate_frames(t: Tables) -> DataFrame:
    found = poss.holder_candidates(t.tracks, t.ball)
    return t.frames.select("video_id", "frame_idx").join(found, ["video_id", "frame_idx"], "left")


query("possession_stream", lambda t: disordered(t, candidate_frames(t), st.possession_stream), ("poss",), "SELECT * FROM poss")


def score_events(t: Tables) -> DataFrame:
    h = durable(holders(t))  # used twice
    team = F.when(F.col("holder_id") != -1, F.col("team")).otherwise(F.lit(-1)).alias("team")
    at = ["video_id", "frame_idx"]
    return poss.team_of_holder(h, t.tracks, 0).select(*at, team).join(poss.ball_moves(h, t.tracks), at)


def newest(t: Tables, stream: DataFrame, key: str, root: str) -> DataFrame:
    """Newest state per key of a result that changes with every batch."""
    st.latest_run(stream, f"{root}/out", f"{root}/state")
    out = t.spark.read.parquet(f"{root}/out").drop("batch")
    last = out.groupBy(key).agg(F.max_by(F.struct(*[c for c in out.columns if c not in (key, "batch_no")]), "batch_no").alias("s"))
    return last.select(key, "s.*")


def latest(t: Tables, df: DataFrame, build, key: str, **options) -> DataFrame:
    root = folder(t)
    return newest(t, build(feed(df, f"{root}/in", max_files=8, key=key, **options)), key, root)


def run_status(t: Tables) -> DataFrame:
    """Log lines a few places out of order."""
    root = folder(t)
    ends = t.run_log.groupBy("run_id").agg((F.max("line_no") + DELAY + 2 * IDLE).alias("line_no")).withColumn(st.ENDED, F.lit(True))
    return newest(t, st.run_status_stream(shuffled_feed(t, t.run_log, ends, root, "line_no", 30.0, (0, 4000))), "run_id", root)


LOG_SLICES, LOG_ROUNDS = 40, 4


def run_status_files(t: Tables) -> DataFrame:
    """Log files that arrive in four rounds, each processed from the checkpoint of the one before, then the end of every run."""
    root = folder(t)
    per_slice = t.run_log.agg(F.max("line_no")).first()[0] // LOG_SLICES + 1
    per_round = per_slice * LOG_SLICES // LOG_ROUNDS
    ends = t.run_log.groupBy("run_id").agg((F.max("line_no") + 1000 * per_slice).alias("line_no")).withColumn("line", F.lit(logs.END_OF_RUN))
    arriving = [t.run_log.filter(F.col("line_no").between(k * per_round, (k + 1) * per_round - 1)) for k in range(LOG_ROUNDS)]
    for lines in [*arriving, ends]:
        logs.write_run_logs(lines, f"{root}/logs", per_slice)
        status = newest(t, st.run_status_stream(logs.log_stream(t.spark, f"{root}/logs"), idle="5 minutes"), "run_id", root)
    return status


def run_log_files(t: Tables) -> DataFrame:
    path = f"{folder(t)}/logs"
    logs.write_run_logs(t.run_log, path, 2500)
    return logs.run_logs(t.spark, path, span=4096)


query("run_log_files", run_log_files, ("run_log",),
      "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY line_no) - 1 AS line_no, line FROM run_log")
query("live_scoreboard", lambda t: latest(t, score_events(t), st.live_scoreboard, "video_id"), ("poss_team0", "pass_events", "steal_events"), """
SELECT p.video_id, count(*) FILTER (holder_id <> -1 AND team = 1) AS team1_frames, count(*) FILTER (holder_id <> -1 AND team = 2) AS team2_frames,
  count(*) FILTER (pass_team = 1) AS team1_passes, count(*) FILTER (pass_team = 2) AS team2_passes,
  count(*) FILTER (interception_team = 1) AS team1_interceptions, count(*) FILTER (interception_team = 2) AS team2_interceptions
FROM poss_team0 p JOIN pass_events a USING (video_id, frame_idx) JOIN steal_events s USING (video_id, frame_idx) GROUP BY p.video_id""")
derive("last_line", ("run_log",), "SELECT run_id, max(line_no) AS line_no FROM run_log GROUP BY run_id")
_last = ", ".join(f"arg_max({c}, line_no) FILTER ({c} IS NOT NULL) AS {c}" for c in ("sport", "stage", "stage_name", "total_stages", "fps", "eta", "vram"))
_STATUS = f"""
SELECT s.*, line_no, progress_pct, current_frame, total_frames FROM (SELECT run_id, {_last}, coalesce(max(done) FILTER (done), false) AS completed FROM said GROUP BY run_id) s
LEFT JOIN last_line USING (run_id) LEFT JOIN (
  SELECT run_id, arg_max(pct, line_no) FILTER (pct IS NOT NULL) AS progress_pct, arg_max(cur, line_no) FILTER (cur IS NOT NULL) AS current_frame, arg_max(known, line_no) FILTER (known IS NOT NULL) AS total_frames FROM (
    SELECT run_id, line_no, pct, cur, known FROM bars UNION ALL SELECT run_id, line_no, fin, NULL, NULL FROM said WHERE fin IS NOT NULL) u GROUP BY run_id) p USING (run_id)"""
query("run_status_stream", run_status, ("said", "bars", "last_line"), _STATUS)
derive("last_place", ("run_log",), "SELECT run_id, count(*) - 1 AS line_no FROM run_log GROUP BY run_id")
query("run_status_files", run_status_files, ("said", "bars", "last_place"), _STATUS.replace("last_line", "last_place"))


def late_feed(t: Tables, step) -> str:
    """Every seventh row arrives 40 frames late and the watermark stays 30 frames behind; the slices are processed as they arrive."""
    arrival = F.col("frame_idx") + F.when((F.col("frame_idx") + F.col("player_id")) % 7 == 0, 40).otherwise(0)
    rows = t.tracks.select("video_id", "frame_idx", "player_id", arrival.cast("bigint").alias("arrival"), F.lit(1e6).alias("base_ts"))
    root = folder(t)
    for slices in zip(SLICES, SLICES[1:]):
        step(feed(rows, f"{root}/in", axis="arrival", slices=slices, at="frame_idx", fps=8.0, delay="3750 milliseconds"), root)
    return root


def late_split(t: Tables) -> DataFrame:
    root = late_feed(t, lambda stream, root: st.split_late(stream, f"{root}/out", f"{root}/state"))
    return t.spark.read.parquet(f"{root}/out/rows").select("video_id", "frame_idx", "player_id", F.col("is_late").cast("boolean").alias("is_late"))


def on_time(t: Tables) -> DataFrame:
    """The engine drops what is behind the watermark."""
    root = late_feed(t, lambda stream, root: st.checkpointed_run(st.late_data(stream).drop("event_time"), f"{root}/out", f"{root}/state"))
    return t.spark.read.parquet(f"{root}/out").select("video_id", "frame_idx", "player_id")


def late_windows(t: Tables) -> DataFrame:
    root = late_feed(t, lambda stream, root: st.split_late(stream, f"{root}/out", f"{root}/state"))
    second = ((F.unix_micros("start") / 1_000_000) - 1_000_000).cast("bigint").alias("second")
    return st.window_counts(t.spark, f"{root}/out").select("video_id", second, "rows", "late_rows", "restated")


derive("late_tracks", ("tracks",), """
SELECT video_id, frame_idx, player_id, coalesce(frame_idx <= newest - 30, false) AS is_late FROM (
  SELECT *, CASE WHEN arrival < 37 THEN 0 WHEN arrival < 80 THEN 1 ELSE 2 END AS slice FROM (
    SELECT *, frame_idx + CASE WHEN (frame_idx + player_id) % 7 = 0 THEN 40 ELSE 0 END AS arrival FROM tracks) r) a
JOIN (SELECT s AS slice, max(CASE WHEN arrival < CASE s WHEN 0 THEN 0 WHEN 1 THEN 37 ELSE 80 END THEN frame_idx END) AS newest FROM (
    SELECT frame_idx, frame_idx + CASE WHEN (frame_idx + player_id) % 7 = 0 THEN 40 ELSE 0 END AS arrival FROM tracks) r, (SELECT unnest([0, 1, 2]) AS s) n GROUP BY s) w USING (slice)""")
query("late_data", late_split, ("late_tracks",), "SELECT * FROM late_tracks")
query("late_data_dropped", on_time, ("late_tracks",), "SELECT video_id, frame_idx, player_id FROM late_tracks WHERE NOT is_late")
query("late_windows", late_windows, ("late_tracks",), """
SELECT video_id, frame_idx // 8 AS second, count(*) AS rows, count(*) FILTER (is_late) AS late_rows, count(*) FILTER (is_late) > 0 AS restated
FROM late_tracks GROUP BY ALL""")


def _Z(i: str) -> str:
    """Height of point ``i`` of ``n``: ballistic before the bounce ``b`` and after it."""
    t, tp, tb = f"({i}/{D(30)})", f"(({i}-b)/{D(30)})", f"(b/{D(30)})"
    vz = f"((({D(0.036)}-{D(2.15)}) + 0.5*{D(9.81)}*{tb}*{tb})/greatest({tb}, {D(1e-4)}))"
    up = f"{D(2.15)} + {vz}*{t} - 0.5*{D(9.81)}*{t}*{t}"
    down = f"{D(0.036)} + (-({vz} - {D(9.81)}*{tb})*{D(0.62)})*{tp} - 0.5*{D(9.81)}*{tp}*{tp}"
    return f"greatest({D(0.036)}, CASE WHEN {i} <= b THEN {up} ELSE {down} END)"


# pairs (i, j) of points of the open flight at every fourth frame: its first points three apart, or its ends if it has only three
derive("live", ("frames", "flight"), f"""
WITH s AS (SELECT f.video_id, f.frame_idx, mx, my, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS k FROM frames f LEFT JOIN flight p ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx),
  g AS (SELECT *, sum(CASE WHEN k - prev <= 16 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY k) AS isl FROM (
    SELECT *, lag(k) OVER (PARTITION BY video_id ORDER BY k) AS prev FROM s WHERE mx IS NOT NULL) a),
  p AS (SELECT *, row_number() OVER (PARTITION BY video_id, isl ORDER BY k) - 1 AS i FROM g),
  e AS (SELECT s.video_id, s.frame_idx, s.k, max(p.k) AS lk FROM s JOIN p ON p.video_id = s.video_id AND p.k <= s.k WHERE s.frame_idx%4 = 0 GROUP BY ALL HAVING s.k - max(p.k) < 16),
  n AS (SELECT e.*, p.isl, p.i + 1 AS n, greatest(1, least(greatest(1, CAST(floor((p.i+1)*{D(0.65)}) AS BIGINT)), p.i)) AS b FROM e JOIN p ON p.video_id = e.video_id AND p.k = e.lk WHERE p.i >= 2)
SELECT n.video_id, n.frame_idx, n.n, n.b, a.i, c.i AS j, a.mx AS x0, a.my AS y0, a.frame_idx AS f0, c.mx AS x1, c.my AS y1, c.frame_idx AS f1
FROM n JOIN p a ON a.video_id = n.video_id AND a.isl = n.isl JOIN p c ON c.video_id = n.video_id AND c.isl = n.isl
WHERE c.i < n.n AND ((n.n > 3 AND c.i = a.i + 3 AND a.i < 5) OR (n.n = 3 AND a.i = 0 AND c.i = 2))""")
query("live_speed", lambda t: disordered(t, t.frames.select("video_id", "frame_idx").join(
    t.flight.select("video_id", "frame_idx", "mx", "my"), ["video_id", "frame_idx"], "left"), st.live_speed), ("live",), f"""
SELECT video_id, frame_idx, n AS points, {R('greatest(40, least(160, quantile_cont(v, 0.75)))', 1)} AS speed_kmh FROM (
  SELECT *, greatest(30, least(175, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0))/(greatest(1, f1-f0)/{D(30)})*{D(3.6)})) AS v FROM (
    SELECT *, {_Z('i')} AS z0, {_Z('j')} AS z1 FROM live) a) b GROUP BY video_id, frame_idx, n""")


query("speed_stream", lambda t: disordered(t, court.player_step_distance(t.positions), st.speed_stream), ("speeds",), "SELECT * FROM speeds")


def rescanned(t: Tables) -> DataFrame:
    """The tracks as files, read back with the declared schema."""
    path = folder(t)
    t.tracks.write.parquet(path)
    return catalog.scan_tracks(t.spark, path)


query("scan_tracks", rescanned, ("tracks",), "SELECT * FROM tracks")

# ---- reports

def basketball_files(t: Tables) -> DataFrame:
    """Write the report and read its team, dominance and continuity blocks back."""
    root = folder(t)
    report = reports.basketball_report(t.tracks, t.ball, t.positions, t.frames, modes(t))
    sinks.write_basketball_report(report, reports.report_players(t.tracks, t.positions), root)
    teams = [F.col(f"team_stats.team_{k}.{c}").alias(f"team{k}_{c}") for k in (1, 2) for c in ("possession_pct", "total_passes", "total_interceptions")]
    return t.spark.read.schema(report.schema).json(f"{root}/summary").select(
        "video_id", "total_frames", "duration_seconds", *teams, "spatial_dominance_stats.*",
        "shot_events_detected", "tracking_continuity_stats.*")


def spoken(rows: DataFrame) -> DataFrame:
    """What follows from each row of ``described``: line, length and commentary."""
    return ck.commentary_line(ck.line_length(rows)).drop("event_runs")


def cricket_files(t: Tables) -> DataFrame:
    """Write the report and read its summary back."""
    root = folder(t)
    rows = described(t, labelled=False)
    facts = durable(ck.line_length(rows).select(  # used twice
        "video_id", "outcome", "is_wicket", "runs", "release_speed_kmh", "line", "length", "shot_played"))
    report = reports.cricket_report(facts, hl.fuse_highlights(t.moments, t.roars), t.videos.select("video_id", "fps", "total_frames"))
    sinks.write_cricket_report(report, rows, root, spoken)
    return t.spark.read.json(f"{root}/summary").select(F.col("video_id").cast("bigint").alias("video_id"), "summary.*").select("*", "speed_analysis_kmh.*").drop("speed_analysis_kmh")


def players_file(t: Tables) -> DataFrame:
    """The players' block as the report writes it, read back."""
    root = folder(t)
    players = reports.report_players(t.tracklets, t.tracklet_positions)
    sinks.write_basketball_report(t.videos, players, root)
    return t.spark.read.schema(players.schema).json(f"{root}/players")


def deliveries_file(t: Tables) -> DataFrame:
    """The deliveries with their commentary as the report writes them, read back."""
    root = folder(t)
    rows = described(t, labelled=False)
    sinks.write_cricket_report(t.videos, rows, root, spoken)
    back = t.spark.read.schema(spoken(rows).schema).json(f"{root}/deliveries")
    return back.select("video_id", "delivery_key", "over", "line", "length", "outcome", "runs", "is_wicket", "commentary")


query("report_players_file", players_file, ("players",), "SELECT * FROM players", CUT)
query("report_deliveries_file", deliveries_file, ("described", "spoken"), """
SELECT d.video_id, delivery_key, over, line, length, outcome, runs, is_wicket, commentary FROM described d JOIN spoken s USING (delivery_key)""")
derive("dominance", ("control",), f"""
SELECT video_id, coalesce({R('avg(team1_pct) FILTER (sampled)', 1)}, 50) AS team1_avg_dominance_pct, coalesce({R('avg(team2_pct) FILTER (sampled)', 1)}, 50) AS team2_avg_dominance_pct FROM control GROUP BY video_id""")
query("write_basketball_report", basketball_files, ("frames", "poss_team0", "pass_events", "steal_events", "dominance", "shot_walk", "modes"), f"""
SELECT f.video_id, n AS total_frames, {R('n/CAST(30 AS DOUBLE)', 1)} AS duration_seconds,
  CASE WHEN p1+p2 > 0 THEN {R('p1/(p1+p2)*100', 1)} ELSE CAST(0 AS DOUBLE) END AS team1_possession_pct, team1_total_passes, team1_total_interceptions,
  CASE WHEN p1+p2 > 0 THEN {R('p2/(p1+p2)*100', 1)} ELSE CAST(0 AS DOUBLE) END AS team2_possession_pct, team2_total_passes, team2_total_interceptions,
  team1_avg_dominance_pct, team2_avg_dominance_pct, shot_events_detected, {R('d/n*100', 2)} AS direct_keypoint_pct, {R('fb/n*100', 2)} AS optical_flow_cmc_pct,
  {R('(d+fb)/n*100', 2)} AS overall_continuity_pct, {R('l/n*100', 2)} AS lost_frames_pct
FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id) f
LEFT JOIN (SELECT video_id, count(*) FILTER (holder_id <> -1 AND team = 1) AS p1, count(*) FILTER (holder_id <> -1 AND team = 2) AS p2 FROM poss_team0 GROUP BY video_id) p USING (video_id)
LEFT JOIN (SELECT video_id, count(*) FILTER (pass_team = 1) AS team1_total_passes, count(*) FILTER (pass_team = 2) AS team2_total_passes FROM pass_events GROUP BY video_id) a USING (video_id)
LEFT JOIN (SELECT video_id, count(*) FILTER (interception_team = 1) AS team1_total_interceptions, count(*) FILTER (interception_team = 2) AS team2_total_interceptions FROM steal_events GROUP BY video_id) s USING (video_id)
LEFT JOIN dominance USING (video_id) LEFT JOIN (SELECT video_id, count(*) FILTER (conf >= 0.5) AS shot_events_detected FROM shot_walk GROUP BY video_id) w USING (video_id)
LEFT JOIN (SELECT video_id, count(*) FILTER (mode = 'direct') AS d, count(*) FILTER (mode IN ('cmc', 'static')) AS fb, count(*) FILTER (mode = 'lost') AS l FROM modes GROUP BY video_id) m USING (video_id)""")
query("write_cricket_report", cricket_files, ("deliveries", "moments", "standalone"), f"""
SELECT video_id, total_deliveries, CAST((total_deliveries - total_deliveries%6)//6 AS STRING) || '.' || CAST(total_deliveries%6 AS STRING) AS overs,
  CAST(greatest(runs, 4*fours + 6*sixes) AS BIGINT) AS estimated_runs, wickets, fours, sixes, dot_balls, {R('dot_balls/total_deliveries*CAST(100 AS DOUBLE)', 1)} AS dot_ball_pct,
  coalesce(n, 0) AS audio_visual_highlights_count, coalesce({R('fast', 1)}, 0) AS fastest_delivery, coalesce({R('slow', 1)}, 0) AS slowest_delivery, coalesce({R('mean', 1)}, 0) AS average_delivery
FROM (SELECT video_id, count(*) AS total_deliveries, sum(runs) AS runs, count(*) FILTER (is_wicket) AS wickets, count(*) FILTER (NOT is_wicket AND outcome = 'four') AS fours,
    count(*) FILTER (NOT is_wicket AND outcome = 'six') AS sixes, count(*) FILTER (NOT is_wicket AND outcome IN ('dot_ball', 'lbw_not_out')) AS dot_balls,
    max(sp) AS fast, min(sp) AS slow, avg(sp) AS mean FROM (SELECT *, CASE WHEN release_speed_kmh > 0 THEN release_speed_kmh END AS sp FROM deliveries) d GROUP BY video_id) s
LEFT JOIN (SELECT video_id, count(*) AS n FROM (SELECT video_id, frame_idx FROM moments UNION SELECT video_id, frame_idx FROM standalone) h GROUP BY video_id) h USING (video_id)""")
