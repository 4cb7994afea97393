"""Engine tables derived from the TPC-H-like test tables, as SQL valid in Spark and in DuckDB.

``{events}`` and friends are replaced by a parquet path for Spark and by the view name for DuckDB, so a
query and its check read the same rows.  All coordinates are integer arithmetic on the source keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.scale import positions

SOURCES = ("events", "orders", "embeddings", "customer")

# name -> (tables it needs, SQL)
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {}


def _add(name: str, needs: tuple[str, ...], sql: str) -> None:
    ADAPTERS[name] = (needs, " ".join(sql.split()))


# ten users make one video, six hours one frame; the first event of a user in a frame counts
_add("seen", (), """
SELECT CAST(FLOOR(user_id/10) AS BIGINT) AS video_id, frame_idx, user_id%10 AS player_id, user_id FROM (
  SELECT user_id,
    (EXTRACT(day FROM ts)-1)*4 + CAST(FLOOR(EXTRACT(hour FROM ts)/6) AS BIGINT) AS frame_idx,
    MIN(event_id) AS first_event
  FROM {events}
  GROUP BY user_id, (EXTRACT(day FROM ts)-1)*4 + CAST(FLOOR(EXTRACT(hour FROM ts)/6) AS BIGINT)) e
""")
_add("positions", ("seen",), """
SELECT video_id, frame_idx, player_id,
  CAST(ABS(((frame_idx*(2+player_id) + user_id*13) % 400) - 200) AS DOUBLE) AS x,
  CAST(ABS(((frame_idx*(1+player_id%4) + user_id*29) % 214) - 107) AS DOUBLE) AS y
FROM seen
""")
_add("tracks", ("seen",), """
SELECT video_id, frame_idx, player_id, cx - 6 AS x1, cy - 20 AS y1, cx + 6 AS x2, cy AS y2,
  CAST(1 AS DOUBLE) AS conf,
  CAST(CASE WHEN (user_id*7 + frame_idx) % 23 = 0 OR player_id = 8 THEN 0 ELSE 1 + user_id%2 END AS INT) AS team,
  (player_id = 9 AND frame_idx % 3 = 0) AS is_referee,
  (user_id + frame_idx) % 31 = 0 AS is_sideline,
  CASE WHEN (frame_idx + player_id) % 3 = 0
       THEN CAST(CASE WHEN frame_idx % 7 = 0 THEN 30 ELSE 4 + player_id % 5 END AS STRING) END AS jersey
FROM (SELECT video_id, frame_idx, player_id, user_id,
    CAST(ABS(((frame_idx*(2+player_id) + user_id*13) % 400) - 200) AS DOUBLE) AS cx,
    CAST(ABS(((frame_idx*(1+player_id%4) + user_id*29) % 214) - 107) AS DOUBLE) AS cy
  FROM seen) s
""")
# tracks cut every 24 frames, as a tracker loses people; players of one team share a jersey, so pieces of one jersey overlap or not
_add("tracklets", ("tracks",), """
SELECT video_id, frame_idx, player_id*10 + CAST(FLOOR(frame_idx/24) AS BIGINT) AS player_id, x1, y1, x2, y2, conf, team, is_referee, is_sideline,
  CASE WHEN jersey = '30' THEN jersey WHEN jersey IS NOT NULL THEN CAST(4 + player_id % 4 AS STRING) END AS jersey
FROM tracks
""")
_add("tracklet_positions", ("positions",), """
SELECT video_id, frame_idx, player_id*10 + CAST(FLOOR(frame_idx/24) AS BIGINT) AS player_id, x, y FROM positions
""")
_add("frames", ("seen",), """
SELECT video_id, frame_idx, CAST(1280 AS INT) AS width, CAST(720 AS INT) AS height
FROM (SELECT DISTINCT video_id, frame_idx FROM seen) f
""")
_add("videos", ("frames",), """
SELECT video_id, CAST(30 AS DOUBLE) AS fps, CAST(MAX(frame_idx)+1 AS BIGINT) AS total_frames FROM frames GROUP BY video_id
""")
# carrier h changes every six frames; the ball is missing in short gaps and for 20 frames in every 40
_add("ball_path", ("frames",), """
SELECT video_id, frame_idx, (frame_idx*31 + video_id) % 11 > 1 AND frame_idx % 40 < 20 AS visible,
  CAST(ABS(((frame_idx*(2+h) + (video_id*10+h)*13) % 400) - 200) + ((frame_idx+video_id)%5)*12 - 24 AS DOUBLE) AS x,
  CAST(ABS(((frame_idx*(1+h%4) + (video_id*10+h)*29) % 214) - 107) + ((frame_idx*3)%5)*6 - 12 AS DOUBLE) AS y
FROM (SELECT video_id, frame_idx, (CAST(FLOOR(frame_idx/6) AS BIGINT) + video_id) % 10 AS h FROM frames) f
""")
_add("ball", ("ball_path",), """
SELECT video_id, frame_idx, x-2 AS x1, y-2 AS y1, x+2 AS x2, y+2 AS y2, x AS cx, y AS cy,
  CAST(60 + frame_idx%40 AS DOUBLE)/100 AS conf
FROM ball_path WHERE visible
""")
# one raw detection per track row; class and size vary with the keys
_add("detections", ("seen",), """
SELECT video_id, frame_idx, player_id AS det_id,
  CASE (frame_idx + player_id) % 4 WHEN 0 THEN 'referee' WHEN 1 THEN 'player' ELSE 'ball' END AS cls,
  cx - w/2 AS x1, cy - h/2 AS y1, cx + w/2 AS x2, cy + h/2 AS y2,
  CAST((frame_idx*17 + player_id*29) % 100 AS DOUBLE)/100 AS conf
FROM (SELECT video_id, frame_idx, player_id,
    CAST(ABS(((frame_idx*(2+player_id) + user_id*13) % 400) - 200) + (frame_idx % 9) * 3 - 12 AS DOUBLE) AS cx,
    CAST(ABS(((frame_idx*(1+player_id%4) + user_id*29) % 214) - 107) - 10 + (frame_idx % 5) * 2 AS DOUBLE) AS cy,
    CAST((frame_idx*7 + player_id*11) % 90 AS DOUBLE) AS w,
    CAST((frame_idx*5 + player_id*3) % 80 AS DOUBLE) AS h
  FROM seen) s
""")
_add("keypoint_obs", ("seen",), """
SELECT video_id, frame_idx, kp_idx,
  CASE WHEN (frame_idx + kp_idx*3) % 6 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(40 + kp_idx*37 + (frame_idx % 13) * 2 AS DOUBLE) END AS x,
  CASE WHEN (frame_idx + kp_idx*3) % 6 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(70 + (kp_idx*53) % 410 + (frame_idx % 7) * 3 AS DOUBLE) END AS y,
  CAST((frame_idx*13 + kp_idx*7) % 100 AS DOUBLE)/100 AS conf
FROM (SELECT video_id, frame_idx, player_id AS kp_idx FROM seen
      UNION ALL SELECT video_id, frame_idx, player_id + 10 AS kp_idx FROM seen WHERE player_id < 8) k
""")
# the same, out of view for twelve frames in every twenty
_add("keypoints_lost", ("keypoint_obs",), """
SELECT video_id, frame_idx, kp_idx, conf, CASE WHEN shown THEN x ELSE CAST(0 AS DOUBLE) END AS x, CASE WHEN shown THEN y ELSE CAST(0 AS DOUBLE) END AS y
FROM (SELECT *, frame_idx % 20 < 8 AND frame_idx >= 3 AS shown FROM keypoint_obs) k
""")
# camera motion (1, m1, m2; m3, 1, m5; 0, 0, 1); unknown in every fifth frame
_add("camera", ("frames",), """
SELECT video_id, frame_idx, (frame_idx + video_id) % 5 <> 0 AS known, CAST(frame_idx%7 AS DOUBLE)/1000 AS m1, CAST(frame_idx%3 - 1 AS DOUBLE) AS m2,
  CAST(0 - frame_idx%5 AS DOUBLE)/1000 AS m3, CAST(frame_idx%4 - 2 AS DOUBLE) AS m5
FROM frames
""")
# one calibration per 30 frames of a video
_add("calibration_cols", ("frames",), """
SELECT video_id, 30*k AS frame_from, 30*k + 29 AS frame_to,
  CAST(80 + (video_id + k) % 20 AS DOUBLE)/100 AS h0, CAST((video_id + k) % 7 AS DOUBLE)/100 AS h1, CAST(k % 5 AS DOUBLE) AS h2,
  CAST((video_id*3 + k) % 5 - 2 AS DOUBLE)/100 AS h3, CAST(90 + (video_id + 2*k) % 15 AS DOUBLE)/100 AS h4, CAST(video_id % 5 - 2 AS DOUBLE) AS h5,
  CAST((video_id + k) % 3 AS DOUBLE)/10000 AS h6, CAST(k % 4 AS DOUBLE)/10000 AS h7, CAST(1 AS DOUBLE) AS h8
FROM (SELECT DISTINCT video_id, CAST(FLOOR(frame_idx/30) AS BIGINT) AS k FROM frames) f
""")
_add("match_calibration_cols", ("match_frames",), ADAPTERS["calibration_cols"][1].replace("FROM frames", "FROM match_frames"))
_add("confidences", ("frames",), """
SELECT video_id, frame_idx,
  CASE WHEN (CAST(FLOOR(frame_idx/9) AS BIGINT) + video_id) % 4 = 0 THEN CAST(60 + frame_idx % 5 * 10 AS DOUBLE)/100
       ELSE CAST(frame_idx % 5 AS DOUBLE)/10 END AS conf
FROM frames
""")
_add("team_votes", ("seen",), """
SELECT video_id, frame_idx, player_id,
  CAST(CASE WHEN (frame_idx*3 + player_id) % 7 < 4 THEN 1 ELSE 2 END AS INT) AS team FROM seen
""")
_add("readings", ("seen",), """
SELECT video_id, frame_idx, player_id,
  CASE (frame_idx + player_id) % 5 WHEN 0 THEN 'x7' WHEN 1 THEN '123' WHEN 2 THEN CAST(player_id + 20 AS STRING)
       ELSE CAST(player_id + 4 AS STRING) END AS text,
  CAST((frame_idx*29 + player_id*13) % 100 AS DOUBLE)/100 AS prob
FROM seen
""")
_add("roles", ("seen",), """
SELECT video_id, frame_idx, player_id, cx - 6 AS x1, cy - 20 AS y1, cx + 6 AS x2, cy AS y2,
  CASE WHEN player_id = (CAST(FLOOR(frame_idx/40) AS BIGINT) + video_id) % 10 THEN 'batsman'
       WHEN player_id = 3 THEN 'bowler' ELSE 'player' END AS role
FROM (SELECT video_id, frame_idx, player_id,
    CAST(ABS(((frame_idx*(2+player_id) + user_id*13) % 400) - 200) AS DOUBLE) AS cx,
    CAST(ABS(((frame_idx*(1+player_id%4) + user_id*29) % 214) - 107) AS DOUBLE) AS cy
  FROM seen) s
""")
# one ball flight per video and 40 frames, in camera pixels, with metric pitch coordinates
_add("flight", ("ball",), """
SELECT video_id, CAST(FLOOR(frame_idx/40) AS BIGINT) AS delivery_key, frame_idx, cx, cy, conf,
  CAST((frame_idx%40)*90 + video_id%7*3 AS DOUBLE)/100 AS mx,
  CAST(((frame_idx*5 + video_id*3) % 41) - 20 AS DOUBLE)/100 AS my
FROM ball
""")
# every event is a frame; video v holds 2^v frames, the last one the rest, so the longest holds up to half of all rows
_add("match_frames", (), """
SELECT v AS video_id, event_id + 1 - CAST(POW(2, v) AS BIGINT) AS frame_idx
FROM (SELECT event_id, CAST(LENGTH(BIN(event_id + 1)) AS BIGINT) - 1 AS v FROM {events}) e
""")
# a flight begins every 40 frames; every fifth is too short, every eighth without a batsman
_add("match_ball", ("match_frames",), """
SELECT video_id, frame_idx FROM match_frames
WHERE frame_idx % 40 < CASE WHEN FLOOR(frame_idx/40) % 5 = 4 THEN 3 ELSE 20 END AND (frame_idx*31 + video_id) % 11 > 1
""")
_add("match_roles", ("match_frames",), """
SELECT video_id, frame_idx, CAST(1 AS BIGINT) AS player_id, x1, CAST(20 AS DOUBLE) AS y1, x1 + 14 AS x2, CAST(70 AS DOUBLE) AS y2, 'batsman' AS role
FROM (SELECT video_id, frame_idx, CAST(90 + CAST(FLOOR(frame_idx/40) AS BIGINT)*13 % 60 AS DOUBLE) AS x1 FROM match_frames
  WHERE frame_idx % 40 > 1 AND FLOOR(frame_idx/40) % 8 <> 7) r
""")
# raw candidates of a ball that bounces after 5 to 7 frames and, in every third flight, comes back from frame 10 on; a weaker one far off
_add("match_detections", ("match_ball",), """
SELECT video_id, frame_idx, det_id, 'ball' AS cls, cx - 3 AS x1, cy - 3 AS y1, cx + 3 AS x2, cy + 3 AS y2, conf FROM (
  SELECT video_id, frame_idx, CAST(0 AS BIGINT) AS det_id, CAST(90 AS DOUBLE)/100 AS conf,
    CAST(CASE WHEN k % 3 = 0 AND f > 10 THEN 130 - (f-10) * (CASE WHEN k % 9 = 0 THEN 70 ELSE 14 END) ELSE f*13 END + k % 7 AS DOUBLE) AS cx,
    CAST(34 + (video_id + k) % 9 + CASE WHEN f <= 5 + k % 3 THEN f*2 ELSE (5 + k % 3)*3 - f END AS DOUBLE) AS cy
  FROM (SELECT video_id, frame_idx, frame_idx % 40 AS f, CAST(FLOOR(frame_idx/40) AS BIGINT) AS k FROM match_ball WHERE frame_idx % 40 < 14) b
  UNION ALL SELECT video_id, frame_idx, CAST(1 AS BIGINT) AS det_id, CAST(50 AS DOUBLE)/100 AS conf, CAST(500 + frame_idx % 40 AS DOUBLE) AS cx, CAST(300 AS DOUBLE) AS cy
  FROM match_ball WHERE frame_idx % 40 < 14 AND frame_idx % 3 = 0) d
""")
_add("stumps", ("flight",), """
SELECT DISTINCT video_id, delivery_key, CAST((video_id*37 + delivery_key*61) % 200 AS DOUBLE) AS sx,
  CAST((video_id*17 + delivery_key*23) % 107 AS DOUBLE) AS sy
FROM flight
""")
_add("deliveries_raw", (), """
SELECT video_id, delivery_key, metric_x, metric_y, release_speed_kmh, bounce_speed_kmh, decel_pct,
  outcome, CAST(CASE outcome WHEN 'four' THEN 4 WHEN 'six' THEN 6 WHEN 'runs' THEN 1 ELSE 0 END AS INT) AS runs,
  outcome IN ('wicket', 'lbw_wicket') AS is_wicket, shot_played, seam_deg, stump_x, stump_z
FROM (SELECT o_custkey%50 AS video_id, o_orderkey AS delivery_key,
    CASE WHEN o_orderkey%17 = 0 THEN NULL ELSE CAST((o_orderkey*7919)%2012 AS DOUBLE)/100 END AS metric_x,
    CASE WHEN o_orderkey%17 = 0 THEN NULL ELSE CAST((o_orderkey*104729)%305 AS DOUBLE)/100 - CAST(1.525 AS DOUBLE) END AS metric_y,
    CASE WHEN o_orderkey%41 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(900 + (o_custkey*31)%700 AS DOUBLE)/10 END AS release_speed_kmh,
    CAST(700 + (o_custkey*29)%500 AS DOUBLE)/10 AS bounce_speed_kmh,
    CAST(50 + (o_custkey*13)%150 AS DOUBLE)/10 AS decel_pct,
    CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_orderkey%3 = 0 THEN 'lbw_wicket' ELSE 'wicket' END
         WHEN '2-HIGH' THEN CASE WHEN o_orderkey%4 = 0 THEN 'six' ELSE 'four' END
         WHEN '3-MEDIUM' THEN 'runs' WHEN '4-NOT SPECIFIED' THEN 'lbw_not_out' ELSE 'dot_ball' END AS outcome,
    CASE (o_orderkey*31)%10 WHEN 0 THEN 'cover_drive' WHEN 1 THEN 'defense' WHEN 2 THEN 'flick' WHEN 3 THEN 'hook'
         WHEN 4 THEN 'late_cut' WHEN 5 THEN 'lofted' WHEN 6 THEN 'pull' WHEN 7 THEN 'square_cut'
         WHEN 8 THEN 'straight_drive' ELSE 'sweep' END AS shot_played,
    CAST((o_orderkey*7)%90 - 45 AS DOUBLE)/10 AS seam_deg,
    CAST((o_orderkey*613)%61 - 30 AS DOUBLE)/100 AS stump_x, CAST((o_orderkey*389)%120 AS DOUBLE)/100 AS stump_z
  FROM {orders}) d
""")
_add("deliveries", ("deliveries_raw",), """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY delivery_key) AS BIGINT) AS delivery_number FROM deliveries_raw
""")
_add("reviews", (), """
SELECT o_custkey%50 AS video_id, o_orderkey AS delivery_key,
  CASE WHEN o_orderkey%11 = 0 THEN NULL ELSE CAST((o_orderkey*37)%61 - 30 AS DOUBLE)/100 END AS pitch_x,
  CASE WHEN o_orderkey%11 = 0 THEN NULL ELSE CAST(1200 + (o_orderkey*71)%700 AS DOUBLE)/100 END AS pitch_y,
  CAST((o_orderkey*41)%51 - 25 AS DOUBLE)/100 AS impact_x, CAST(1600 + (o_orderkey*73)%400 AS DOUBLE)/100 AS impact_y,
  CAST((o_orderkey*613)%43 - 21 AS DOUBLE)/100 AS stump_x, CAST((o_orderkey*389)%90 AS DOUBLE)/100 AS stump_z,
  CASE WHEN o_custkey%4 = 0 THEN 'LHB' ELSE 'RHB' END AS hand,
  CASE WHEN (o_orderkey*3)%5 < 2 THEN 'OUT' ELSE 'NOT OUT' END AS on_field_call,
  o_orderkey%6 <> 0 AS shot_offered, o_orderkey%19 = 0 AS bat_edge
FROM {orders}
""")
_add("audio_raw", (), """
SELECT CAST(FLOOR(user_id/10) AS BIGINT) AS video_id, event_id, value/500 AS amplitude FROM {events}
""")
_add("audio", ("audio_raw",), """
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY event_id) - 1 AS BIGINT) AS sample_idx FROM audio_raw
""")
_add("moments", (), """
SELECT o_custkey%50 AS video_id, o_orderkey*5 AS frame_idx FROM {orders}
""")
_add("roars", (), """
SELECT DISTINCT user_id%50 AS video_id, event_id*9 + user_id%7 AS frame_idx FROM {events}
""")
_add("samples", (), "SELECT vec_id % 7 AS video_id, vec_id AS sample_id, vec_id % 20 AS player_id, embedding AS features, label FROM {embeddings}")
_add("run_log", (), """
SELECT user_id AS run_id, event_id AS line_no,
  CASE WHEN event_id%9 = 0 THEN concat('[', CAST(1 + event_id%8 AS STRING), '/8] step Total Frames: ', CAST(event_id%900 AS STRING))
       WHEN event_id%9 = 1 THEN concat('[', CAST(1 + event_id%7 AS STRING), '/7] step Total Frames: ', CAST(event_id%700 AS STRING))
       WHEN event_id%9 = 2 THEN 'Auto-detected sport: CRICKET'
       WHEN event_id%9 = 3 THEN concat('Auto-detected sport: BASKETBALL GPU VRAM: ', CAST(2 + event_id%7 AS STRING), '.5 GB')
       WHEN event_id%9 = 4 AND event_id%4 = 0 THEN 'Analytics Report Saved'
       WHEN event_id%9 = 5 THEN concat('Processing: ', CAST(event_id%100 AS STRING), '%|##  | ', CAST(event_id%90 AS STRING), '/', CAST(40 + event_id%600 AS STRING),
            ' [00:10<00:', CAST(10 + event_id%50 AS STRING), ', ', CAST(event_id%30 AS STRING), '.5 frames/s]')
       ELSE concat('Processing: ', CAST(event_id%100 AS STRING), '%|##  | ', CAST(event_id%300 AS STRING), '/', CAST(40 + event_id%600 AS STRING),
            ' [00:10<00:00, FPS=', CAST(event_id%30 AS STRING), '.5, ETA=', CAST(event_id%60 AS STRING), 's, VRAM=', CAST(500 + event_id%99 AS STRING), 'MB]') END AS line
FROM {events}
""")
_add("frame_stats", (), """
SELECT CAST(FLOOR(user_id/5) AS BIGINT) AS video_id, event_id AS frame_idx, value/500 AS green_ratio,
  CAST((event_id*37 + user_id*91) % 100 AS DOUBLE)/100 AS wood_ratio
FROM {events}
""")
_add("video_files", (), """
SELECT concat('/data/', CASE c_nationkey%6 WHEN 0 THEN '' WHEN 1 THEN 'videos/' WHEN 2 THEN 'basketball/' WHEN 3 THEN 'cricket/'
    WHEN 4 THEN 'videos/basketball/' ELSE 'videos/cricket/' END,
    CASE c_nationkey%5 WHEN 0 THEN 'dunk_' WHEN 1 THEN 'wicket_' ELSE 'clip_' END, CAST(CAST(FLOOR(c_custkey/2) AS BIGINT) AS STRING),
    CASE WHEN c_custkey%13 = 0 THEN '.txt' WHEN c_custkey%4 < 2 THEN '.mp4' ELSE '.MKV' END) AS path,
  c_custkey*1048577 AS length, c_custkey*7919 % 100003 AS mtime
FROM {customer}
""")
_add("output_files", (), """
SELECT concat(CASE c_custkey%4 WHEN 0 THEN '/out/' WHEN 1 THEN '/out/basketball/' WHEN 2 THEN '/out/cricket/' ELSE '/out/cricket/stats/' END,
    CASE c_nationkey%5 WHEN 0 THEN 'dunk_' WHEN 1 THEN 'wicket_' ELSE 'clip_' END, CAST(CAST(FLOOR(c_custkey/2) AS BIGINT) AS STRING),
    CASE WHEN c_custkey%4 = 3 THEN '.json' WHEN c_nationkey%3 = 0 THEN '_annotated.mp4' WHEN c_nationkey%3 = 1 THEN '_analytics.json'
         WHEN c_custkey%3 = 0 THEN '_annotated_web.mp4' ELSE '_highlights.mp4' END) AS path,
  CASE WHEN c_custkey%5 = 0 THEN '{{"deliveries": []}}' ELSE '{{"metadata": {{"sport": "basketball"}}}}' END AS content
FROM {customer}
""")


# table -> (unnumbered table, order, number column, first number)
_NUMBERED = {
    "deliveries": ("deliveries_raw", "delivery_key", "delivery_number", 1),
    "audio": ("audio_raw", "event_id", "sample_idx", 0),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in ADAPTERS[name][0]:
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def _ctes(names, tables: dict[str, str]) -> str:
    return ", ".join(f"{n} AS ({ADAPTERS[n][1].format(**tables)})" for n in _order(names))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One engine table over the parquet files in ``sf_dir``."""
    if name in _NUMBERED:  # numbered span by span, not in one window per video
        raw, axis, number, start = _NUMBERED[name]
        numbered = positions(load(spark, sf_dir, raw), ["video_id"], axis, name=number)
        return numbered.withColumn(number, F.col(number) + start)
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in SOURCES}
    needs, sql = ADAPTERS[name]
    prefix = f"WITH {_ctes(needs, tables)} " if needs else ""
    return spark.sql(prefix + sql.format(**tables))
