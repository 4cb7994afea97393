"""Delivery, highlight, shot, registration, routing and catalogue queries with their checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fieldlens.functions.ballistics import ballistic_path
from fieldlens.operators.court import homography_lookup
from fieldlens.operators import cricket as ck, deliveries as dv, highlights as hl, registration as rg, routing as rt, shots
from fieldlens.plans.court_queries import calibrations, six
from fieldlens.plans.cricket_queries import D, lbw_sql
from fieldlens.plans.cricket_match import cricket_match
from fieldlens.plans.registry import DERIVED, ORACLES, Tables, derive, derive_as, query, renamed, rounded as R
from fieldlens.scale import durable, pyround, spread
from fieldlens.sources import catalog

PTS = "PARTITION BY video_id, delivery_key ORDER BY frame_idx"

# ---- ball and segmentation
query("ball_candidate_filter", lambda t: dv.ball_candidate_filter(t.detections), ("detections",), f"""
SELECT * FROM detections WHERE cls = 'ball' AND x2-x1 BETWEEN 3 AND 75 AND y2-y1 BETWEEN 3 AND 75 AND (conf >= {D(0.2)}
  OR (conf >= {D(0.14)} AND ((x2-x1)/greatest(y2-y1, {D(1e-4)}) > {D(1.3)} OR (x2-x1)/greatest(y2-y1, {D(1e-4)}) < {D(0.77)})))""")
# the serial rules as recursions over the frames of a video
derive("gated", ("detections",), f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM (
    SELECT video_id, frame_idx, coalesce(list({{'d': det_id, 'cx': (x1+x2)/2, 'cy': (y1+y2)/2, 'conf': conf}} ORDER BY conf DESC, det_id) FILTER (
      x2-x1 BETWEEN 3 AND 75 AND y2-y1 BETWEEN 3 AND 75 AND (conf >= {D(0.2)} OR (conf >= {D(0.14)} AND ((x2-x1)/greatest(y2-y1, {D(1e-4)}) > {D(1.3)}
        OR (x2-x1)/greatest(y2-y1, {D(1e-4)}) < {D(0.77)})))), []) AS boxes FROM detections WHERE cls = 'ball' GROUP BY ALL) g),
  walk AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, CAST(NULL AS DOUBLE) AS ax, CAST(NULL AS DOUBLE) AS ay, 0 AS misses,
      CAST(NULL AS STRUCT(d BIGINT, cx DOUBLE, cy DOUBLE, conf DOUBLE)) AS pick FROM (SELECT DISTINCT video_id FROM s) v
    UNION ALL SELECT video_id, k, frame_idx, CASE WHEN p IS NOT NULL THEN p.cx WHEN misses + 1 >= 5 THEN NULL ELSE ax END, CASE WHEN p IS NOT NULL THEN p.cy WHEN misses + 1 >= 5 THEN NULL ELSE ay END,
      CASE WHEN p IS NOT NULL THEN 0 ELSE misses + 1 END, p FROM (
      SELECT s.video_id, s.k, s.frame_idx, w.ax, w.ay, w.misses, list_filter(s.boxes, lambda b: w.ax IS NULL OR sqrt((b.cx-w.ax)*(b.cx-w.ax)+(b.cy-w.ay)*(b.cy-w.ay)) <= 220)[1] AS p
      FROM walk w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1) n)
SELECT video_id, frame_idx, pick.d AS det_id, CAST(trunc(pick.cx) AS BIGINT) AS cx, CAST(trunc(pick.cy) AS BIGINT) AS cy, pick.conf AS conf FROM walk WHERE pick IS NOT NULL""")
query("ball_gate", lambda t: dv.ball_gate(t.detections), ("gated",), "SELECT * FROM gated")
_STEP = f"(1/{D(30)})"
derive("tracked", ("ball", "frames"), f"""
WITH RECURSIVE s AS (SELECT f.video_id, f.frame_idx, b.cx, b.cy, b.conf, b.x1, b.y1, b.x2, b.y2, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS k
    FROM frames f LEFT JOIN ball b ON b.video_id = f.video_id AND b.frame_idx = f.frame_idx),
  walk AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, {D(0)} AS vx, {D(0)} AS vy, {D(0)} AS a, {D(0)} AS b, {D(0)} AS c, 0 AS missed, 'none' AS mode
      FROM (SELECT DISTINCT video_id FROM s) v
    UNION ALL SELECT video_id, k,
      CASE m WHEN 'predict' THEN px + vx*{_STEP} WHEN 'start' THEN cx WHEN 'update' THEN px + a/(a+3)*(cx-px) ELSE px END,
      CASE m WHEN 'predict' THEN py + vy*{_STEP} WHEN 'start' THEN cy WHEN 'update' THEN py + a/(a+3)*(cy-py) ELSE py END,
      CASE m WHEN 'update' THEN vx + b/(a+3)*(cx-px) ELSE vx END, CASE m WHEN 'update' THEN vy + b/(a+3)*(cy-py) ELSE vy END,
      CASE m WHEN 'predict' THEN a + 2*{_STEP}*b + {_STEP}*{_STEP}*c + 5 WHEN 'start' THEN 10 WHEN 'update' THEN (1-a/(a+3))*a ELSE a END,
      CASE m WHEN 'predict' THEN b + {_STEP}*c WHEN 'start' THEN 0 WHEN 'update' THEN (1-a/(a+3))*b ELSE b END,
      CASE m WHEN 'predict' THEN c + 50 WHEN 'start' THEN 10 WHEN 'update' THEN c - b/(a+3)*b ELSE c END,
      CASE m WHEN 'predict' THEN missed + 1 WHEN 'none' THEN missed ELSE 0 END, m FROM (
      SELECT w.* EXCLUDE (k, mode), s.k, s.cx, s.cy, CASE WHEN s.cx IS NULL THEN CASE WHEN w.px IS NULL OR w.missed >= 10 THEN 'none' ELSE 'predict' END
        WHEN w.px IS NULL THEN 'start' WHEN sqrt((s.cx-trunc(w.px))*(s.cx-trunc(w.px))+(s.cy-trunc(w.py))*(s.cy-trunc(w.py))) > 150 AND w.missed < 2 THEN 'predict' ELSE 'update' END AS m
      FROM walk w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1) n)
SELECT video_id, frame_idx, CAST(lx AS BIGINT) AS cx, CAST(ly AS BIGINT) AS cy, CASE WHEN mode <> 'predict' THEN conf WHEN x1 IS NOT NULL THEN {D(0.5)} ELSE {R('greatest(CAST(0.2 AS DOUBLE), CAST(0.8 AS DOUBLE) - missed*CAST(0.1 AS DOUBLE))', 6)} END AS conf,
  mode = 'predict' AS interpolated, CASE WHEN mode <> 'predict' THEN x1 ELSE lx - coalesce((x2-x1)/2, 10) END AS x1, CASE WHEN mode <> 'predict' THEN y1 ELSE ly - coalesce((y2-y1)/2, 10) END AS y1,
  CASE WHEN mode <> 'predict' THEN x2 ELSE lx + coalesce((x2-x1)/2, 10) END AS x2, CASE WHEN mode <> 'predict' THEN y2 ELSE ly + coalesce((y2-y1)/2, 10) END AS y2
FROM (SELECT s.*, w.mode, w.missed, trunc(w.px) AS lx, trunc(w.py) AS ly FROM walk w JOIN s ON s.video_id = w.video_id AND s.k = w.k WHERE w.mode <> 'none') o""")
query("kalman_ball", lambda t: six(dv.kalman_ball(t.ball, t.frames), "conf"), ("tracked",), "SELECT * FROM tracked")


def segments(t: Tables):
    return dv.deliveries_segment(t.ball, t.roles, t.frames)


_SEGMENTS = """
WITH s AS (SELECT b.video_id, b.frame_idx, r.video_id IS NOT NULL AS bat FROM ball b
    LEFT JOIN (SELECT DISTINCT video_id, frame_idx FROM roles WHERE role = 'batsman') r USING (video_id, frame_idx)),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_idx) AS isl FROM (
    SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 < 16 THEN 0 ELSE 1 END AS brk FROM s) b),
  m AS (SELECT *, min(CASE WHEN bat THEN frame_idx END) OVER (PARTITION BY video_id, isl) AS st FROM i),
  g AS (SELECT video_id, isl, st AS start_frame, max(frame_idx) AS last_ball_frame, count(*) AS ball_frames FROM m WHERE frame_idx >= st GROUP BY ALL),
  e AS (SELECT video_id, max(frame_idx) AS fin FROM frames GROUP BY video_id)
SELECT video_id, start_frame, last_ball_frame, least(last_ball_frame + 16, fin) AS done_frame, ball_frames, last_ball_frame + 16 > fin AS forced
FROM g JOIN e USING (video_id) WHERE ball_frames >= CASE WHEN last_ball_frame + 16 > fin THEN 4 ELSE 5 END"""
derive("segments", ("ball", "roles", "frames"), _SEGMENTS)
# the test ball is never lost for so long: every video ends within a delivery
derive("segments_open", ("ball", "roles", "frames"), _SEGMENTS.replace("16", "30"))
query("deliveries_segment", segments, ("segments",), "SELECT * FROM segments")
query("deliveries_segment_open", lambda t: dv.deliveries_segment(t.ball, t.roles, t.frames, dead_frames=30), ("segments_open",), "SELECT * FROM segments_open")
_MATCH = {"ball": "match_ball", "roles": "match_roles", "frames": "match_frames"}
derive("flights", ("ball", "roles", "frames"), re.sub(r"WHERE ball_frames >= (.*)$", "", _SEGMENTS, flags=re.S).replace(
    "AS forced", "AS forced, ball_frames >= CASE WHEN last_ball_frame + 16 > fin THEN 4 ELSE 5 END AS counted"))
query("live_over", lambda t: ck.live_over(t.match_frames, dv.flights(t.match_ball, t.match_roles, t.match_frames, span=4096), span=4096),
      ("match_frames", "flights"), """
SELECT video_id, frame_idx, flying AS in_flight, done AS just_completed, n AS completed, CASE WHEN flying THEN CAST(n//6 AS STRING) || '.' || CAST(n%6 + 1 AS STRING)
  WHEN done THEN CAST((n-1)//6 AS STRING) || '.' || CAST((n-1)%6 + 1 AS STRING) ELSE CAST(n//6 AS STRING) || '.' || CAST(n%6 AS STRING) END AS over FROM (
  SELECT f.video_id, f.frame_idx, coalesce(bool_or(NOT s.forced AND s.done_frame = f.frame_idx AND s.counted), false) AS done,
    coalesce(bool_or(s.forced OR s.done_frame > f.frame_idx), false) AS flying, count(*) FILTER (NOT s.forced AND s.counted AND s.done_frame <= f.frame_idx) AS n
  FROM match_frames f LEFT JOIN flights s ON s.video_id = f.video_id AND s.start_frame <= f.frame_idx GROUP BY f.video_id, f.frame_idx) q""", _MATCH)
query("over_notation_forced", lambda t: ck.over_notation(
    dv.deliveries_segment(t.match_ball, t.match_roles, t.match_frames, span=4096).select("video_id", "start_frame", "forced"), order="start_frame", span=4096),
    ("segments",), """
SELECT video_id, start_frame, forced, n AS ball_no, CASE WHEN forced AND n%6 = 0 THEN CAST(n//6 AS STRING) || '.0'
  ELSE CAST((n-1)//6 AS STRING) || '.' || CAST((n-1)%6 + 1 AS STRING) END AS over, CAST(n//6 AS STRING) || '.' || CAST(n%6 AS STRING) AS overs_completed
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS n FROM segments) s""", _MATCH)
derive("ball_points", ("ball", "segments"), """
SELECT b.*, (SELECT min(start_frame) FROM segments s WHERE s.video_id = b.video_id AND s.done_frame >= b.frame_idx) AS delivery_key FROM ball b""")
query("delivery_points", lambda t: dv.delivery_points(t.ball, segments(t)), ("ball_points",), "SELECT * FROM ball_points WHERE delivery_key IS NOT NULL")
query("role_first_hit", lambda t: dv.role_first_hit(t.roles, segments(t)), ("roles", "segments"), """
SELECT video_id, delivery_key, frame_idx, player_id, x1, y1, x2, y2 FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx, player_id) AS rn FROM (
    SELECT r.*, (SELECT min(start_frame) FROM segments s WHERE s.video_id = r.video_id AND s.done_frame >= r.frame_idx) AS delivery_key
    FROM roles r WHERE role = 'batsman') a WHERE delivery_key IS NOT NULL) b WHERE rn = 1""")
query("last_n_points", lambda t: dv.last_n_points(t.flight.select("video_id", "delivery_key", "frame_idx", "cx", "cy"), 4), ("flight",), """
SELECT * FROM (SELECT video_id, delivery_key, frame_idx, cx, cy, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx DESC) AS rank FROM flight) r WHERE rank <= 4""")

# ---- bounce and impact
_LAGS = ", ".join(f"lag({c}, {4 - i}) OVER w AS {c}{i}" for i in range(4) for c in ("frame_idx", "cx", "cy"))
derive("turns", ("flight",), f"""
SELECT * FROM (SELECT video_id, delivery_key, frame_idx, cx AS cx4, cy AS cy4, row_number() OVER w AS rn, {_LAGS} FROM flight WINDOW w AS ({PTS})) l
WHERE rn >= 5 AND cy1-cy0 > 0 AND cy2-cy1 >= 0 AND cy4-cy3 < cy2-cy1""")
derive("spaced_turns", ("turns",), """
WITH RECURSIVE g AS (SELECT video_id, delivery_key, min(frame_idx) AS frame_idx FROM turns GROUP BY ALL
  UNION ALL SELECT g.video_id, g.delivery_key, min(t.frame_idx) FROM g JOIN turns t ON t.video_id = g.video_id AND t.delivery_key = g.delivery_key
    AND t.frame_idx >= g.frame_idx + 10 GROUP BY g.video_id, g.delivery_key, g.frame_idx)
SELECT * FROM g""")


def _angle(dx, dy):
    return f"degrees(atan(abs(CASE WHEN {dx} <> 0 THEN ({dy})/({dx}) ELSE {D(999)} END)))"


derive("bounced", ("turns", "spaced_turns"), f"""
SELECT video_id, delivery_key, frame_idx AS noticed_frame, frame_idx2 AS bounce_frame, cx2 AS bounce_x, cy2 AS bounce_y, {R('ai', 1)} AS angle_in, {R('ao', 1)} AS angle_out,
  {R('abs(ai-ao)', 1)} AS deflection FROM (
  SELECT *, {_angle('cx2-cx0', 'cy2-cy0')} AS ai, {_angle('cx4-cx2', 'cy4-cy2')} AS ao FROM turns JOIN spaced_turns USING (video_id, delivery_key, frame_idx)) a""")


def bounces(t: Tables):
    return dv.bounce_points(t.flight)


query("bounce_points", bounces, ("bounced",), "SELECT * FROM bounced")
derive("context", ("flight", "bounced"), f"""
SELECT *, point_idx >= impact_idx AS after_impact FROM (
  SELECT *, coalesce(min(CASE WHEN frame_idx >= bf + 4 THEN point_idx END) OVER p,
    CASE WHEN count(*) OVER p >= 4 THEN greatest(2, CAST(floor(count(*) OVER p*{D(0.6)}) AS BIGINT)) ELSE greatest(1, CAST(floor(count(*) OVER p/2) AS BIGINT)) END) AS impact_idx
  FROM (SELECT f.video_id, f.delivery_key, frame_idx, cx, cy, row_number() OVER (PARTITION BY f.video_id, f.delivery_key ORDER BY frame_idx) - 1 AS point_idx, bf FROM flight f
    LEFT JOIN (SELECT video_id, delivery_key, max(bounce_frame) AS bf FROM bounced GROUP BY ALL) b ON b.video_id = f.video_id AND b.delivery_key = f.delivery_key) a
  WINDOW p AS (PARTITION BY video_id, delivery_key)) c""")


def context(t: Tables):
    return dv.shot_context(t.flight.select("video_id", "delivery_key", "frame_idx", "cx", "cy"), bounces(t))


query("shot_context", context, ("context",), "SELECT * EXCLUDE (bf) FROM context")


def batsmen(t: Tables):
    """First batsman box of each block of 40 frames."""
    shown = t.roles.filter("role = 'batsman'").withColumn("delivery_key", F.floor(F.col("frame_idx") / 40).cast("bigint"))
    first = F.min(F.struct("frame_idx", "player_id", "x1", "y1", "x2", "y2"))
    return shown.groupBy("video_id", "delivery_key").agg(first.alias("f")).select("video_id", "delivery_key", "f.x1", "f.y1", "f.x2", "f.y2")


derive("batsmen", ("roles",), """
SELECT video_id, delivery_key, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx, player_id) AS rn FROM (
  SELECT *, CAST(floor(frame_idx/40) AS BIGINT) AS delivery_key FROM roles WHERE role = 'batsman') a) b WHERE rn = 1""")
derive("contact", ("flight", "batsmen"), f"""
SELECT f.video_id, f.delivery_key, frame_idx, cx, cy, cx BETWEEN x1-50 AND x2+50 AND cy BETWEEN y1-30 AND y2+30 AS bat_zone,
  cx BETWEEN x1-20 AND x2+20 AND cy BETWEEN y1+(y2-y1)*{D(0.55)}-20 AND y2+20 AS pad_zone
FROM flight f JOIN batsmen b ON b.video_id = f.video_id AND b.delivery_key = f.delivery_key""")
query("batsman_zone_contact", lambda t: dv.batsman_zone_contact(t.flight.select("video_id", "delivery_key", "frame_idx", "cx", "cy"), batsmen(t)),
      ("contact",), "SELECT * FROM contact")
derive("bowled", ("flight", "stumps"), """
SELECT video_id, delivery_key, count(*) >= 3 AND max(d < 40) AS bowled FROM (
  SELECT f.video_id, f.delivery_key, sqrt((cx-sx)*(cx-sx)+(cy-sy)*(cy-sy)) AS d, row_number() OVER (PARTITION BY f.video_id, f.delivery_key ORDER BY frame_idx DESC) AS rn
  FROM flight f JOIN stumps s ON s.video_id = f.video_id AND s.delivery_key = f.delivery_key) a WHERE rn <= 3 GROUP BY ALL""")
query("bowled_check", lambda t: dv.bowled_check(t.flight, t.stumps), ("bowled",), "SELECT * FROM bowled")


def shot_labels(t: Tables):
    return ck.shot_class(context(t).filter("after_impact"))


_ELEV = f"degrees(atan2(-dy, abs(dx)+{D(1e-5)}))"
derive("shot_labels", ("context",), f"""
SELECT video_id, delivery_key, rule[1] AS shot_label, CAST(rule[2] AS DOUBLE) AS shot_confidence FROM (
  SELECT video_id, delivery_key, string_split(CASE WHEN n < 2 THEN 'defense:0.65' WHEN sqrt(dx*dx+dy*dy) < 15 THEN 'defense:0.85' WHEN {_ELEV} > 35 THEN 'lofted:0.88'
    WHEN abs(dx) < 20 AND dy < -20 THEN 'straight_drive:0.82' WHEN dx < -20 AND {_ELEV} < 10 AND dy > 0 THEN 'late_cut:0.78'
    WHEN dx < -20 AND abs(dy) < 30 THEN 'square_cut:0.8' WHEN dx < -20 THEN 'cover_drive:0.84' WHEN dx > 20 AND {_ELEV} > 20 THEN 'hook:0.8'
    WHEN dx > 20 AND dy < 0 AND abs(dx) > 35 THEN 'pull:0.85' WHEN dx > 20 AND dy > 20 THEN 'sweep:0.79' WHEN dx > 20 THEN 'flick:0.82' ELSE 'straight_drive:0.7' END, ':') AS rule
  FROM (SELECT video_id, delivery_key, count(*) AS n, arg_max(cx, frame_idx) - arg_min(cx, frame_idx) AS dx, arg_max(cy, frame_idx) - arg_min(cy, frame_idx) AS dy
    FROM context WHERE after_impact GROUP BY ALL) a) b""")
query("shot_class", shot_labels, ("shot_labels",), "SELECT * FROM shot_labels")


def pitched(t: Tables):
    """Metric bounce and projected stump point per delivery block."""
    k = F.col("delivery_key") + F.col("video_id")
    return t.stumps.select("video_id", "delivery_key", ((k * 7 % 41 - 20) / 100).alias("pitch_x"), (k * 3 % 18).cast("double").alias("pitch_y"),
                           ((k * 11 % 31 - 15) / 100).alias("stump_x"), ((k * 5 % 90) / 100).alias("stump_z"))


derive("impacts", ("flight", "contact", "bowled"), f"""
WITH s AS (SELECT f.video_id, f.delivery_key, f.frame_idx, f.cx, f.cy, c.bat_zone, c.pad_zone, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY f.video_id, f.delivery_key) AS n,
    f.cx - lag(f.cx) OVER w AS dx1, f.cy - lag(f.cy) OVER w AS dy1, lead(f.cx) OVER w - f.cx AS dx2, lead(f.cy) OVER w - f.cy AS dy2
    FROM flight f LEFT JOIN contact c ON c.video_id = f.video_id AND c.delivery_key = f.delivery_key AND c.frame_idx = f.frame_idx
    WINDOW w AS (PARTITION BY f.video_id, f.delivery_key ORDER BY f.frame_idx)),
  h AS (SELECT video_id, delivery_key, min(frame_idx) FILTER (n >= 4 AND pos BETWEEN 1 AND n-3 AND bat_zone AND (dx1*dx2+dy1*dy2 < 0 OR (abs(dx2-dx1) > 20 AND abs(dy2-dy1) > 20))) AS bf,
    min(frame_idx) FILTER (n >= 4 AND pos >= 1 AND pad_zone) AS pf, arg_max(cx, frame_idx) AS ex, arg_max(cy, frame_idx) AS ey FROM s GROUP BY ALL),
  a AS (SELECT h.video_id, h.delivery_key, count(*) AS after, arg_min(s.cx, s.frame_idx) AS bx0, arg_min(s.cy, s.frame_idx) AS by0
    FROM h JOIN s ON s.video_id = h.video_id AND s.delivery_key = h.delivery_key AND s.frame_idx >= h.bf GROUP BY ALL)
SELECT h.video_id, h.delivery_key, bf, pf, coalesce(b.bowled, false) AS bowled, coalesce(after, 0) AS after, sqrt((ex-bx0)*(ex-bx0)+(ey-by0)*(ey-by0)) AS exit,
  bf IS NULL AND pf IS NOT NULL AS padded,
  CAST((h.delivery_key+h.video_id)*7%41 - 20 AS DOUBLE)/100 AS pitch_x, CAST((h.delivery_key+h.video_id)*3%18 AS DOUBLE) AS pitch_y,
  {D(0.02)} AS impact_x, {D(18)} AS impact_y, CAST((h.delivery_key+h.video_id)*11%31 - 15 AS DOUBLE)/100 AS stump_x, CAST((h.delivery_key+h.video_id)*5%90 AS DOUBLE)/100 AS stump_z,
  'RHB' AS hand, 'OUT' AS on_field_call, true AS shot_offered, false AS bat_edge
FROM h LEFT JOIN a ON a.video_id = h.video_id AND a.delivery_key = h.delivery_key LEFT JOIN bowled b ON b.video_id = h.video_id AND b.delivery_key = h.delivery_key""")
lbw_sql("impacts", "impact_ruled")
query("delivery_outcome", lambda t: dv.delivery_outcome(t.flight, batsmen(t), t.stumps, shot_labels(t), pitched(t)), ("impact_ruled",), """
SELECT video_id, delivery_key, outcome, outcome IN ('wicket', 'lbw_wicket') AS is_wicket, outcome IN ('four', 'six') AS is_boundary,
  coalesce(bf, CASE WHEN padded THEN pf END) AS impact_frame, padded AS is_pad_impact,
  CASE WHEN leg THEN pitching END AS pitching, CASE WHEN leg THEN impact END AS impact, CASE WHEN leg THEN wickets END AS wickets,
  CASE WHEN leg THEN final_verdict END AS final_verdict, CASE WHEN leg THEN reasons END AS reasons
FROM (SELECT *, padded AND NOT bowled AS leg, CASE WHEN bowled THEN 'wicket' WHEN padded THEN CASE WHEN final_verdict = 'OUT' THEN 'lbw_wicket' ELSE 'lbw_not_out' END
  WHEN bf IS NOT NULL AND after >= 3 THEN CASE WHEN exit > 180 THEN 'four' ELSE 'runs' END ELSE 'dot_ball' END AS outcome FROM impact_ruled) o""")

# ---- kinematics
derive("flight3d", ("flight", "bounced"), f"""
SELECT video_id, delivery_key, frame_idx, point_idx, mx, my, greatest({D(0.036)}, CASE WHEN point_idx <= b THEN {D(2.15)} + vz0*t - 0.5*{D(9.81)}*t*t
    ELSE {D(0.036)} + (-(vz0 - {D(9.81)}*tb)*{D(0.62)})*tp - 0.5*{D(9.81)}*tp*tp END) AS mz
FROM (SELECT *, (({D(0.036)}-{D(2.15)}) + 0.5*{D(9.81)}*tb*tb)/greatest(tb, {D(1e-4)}) AS vz0, point_idx/{D(30)} AS t, (point_idx-b)/{D(30)} AS tp FROM (
  SELECT *, b/{D(30)} AS tb FROM (
    SELECT *, greatest(1, coalesce(max(CASE WHEN frame_idx = bf THEN point_idx END) OVER p,
      least(greatest(1, CAST(floor(count(*) OVER p*{D(0.65)}) AS BIGINT)), count(*) OVER p - 1))) AS b
    FROM (SELECT f.video_id, f.delivery_key, frame_idx, mx, my, row_number() OVER (PARTITION BY f.video_id, f.delivery_key ORDER BY frame_idx) - 1 AS point_idx, bf FROM flight f
      LEFT JOIN (SELECT video_id, delivery_key, max(bounce_frame) AS bf FROM bounced GROUP BY ALL) b ON b.video_id = f.video_id AND b.delivery_key = f.delivery_key) a
    WINDOW p AS (PARTITION BY video_id, delivery_key)) c) d) e""")


def flight_3d(t: Tables, last):
    return dv.reconstruct_3d(t.flight.select("video_id", "delivery_key", "frame_idx", "mx", "my"), last)


def speeds(t: Tables):
    last = durable(dv.last_bounces(bounces(t)))  # one row per delivery, used by both steps
    return dv.delivery_speeds(flight_3d(t, last), last)


query("reconstruct_3d", lambda t: six(flight_3d(t, dv.last_bounces(bounces(t))), "mz"), ("flight3d",), f"SELECT * REPLACE ({R('mz', 6)} AS mz) FROM flight3d")


def _kmh(dx, dy, dz, n):
    return f"CASE WHEN ({n}) IS NOT NULL THEN greatest(30, least(175, sqrt(({dx})*({dx})+({dy})*({dy})+({dz})*({dz}))/(({n})/{D(30)})*{D(3.6)})) END"


derive("paced", ("flight3d", "bounced"), f"""
SELECT *, CASE WHEN landed >= 30 AND landed < r THEN least(landed, r*{D(0.9)}) ELSE r*{D(0.85)} END AS s FROM (
  SELECT *, greatest(40, least(160, coalesce(early, {_kmh('bx-ax', 'by_-ay', 'bz-az', 'greatest(1, bf-af)')}))) AS r FROM (
    SELECT video_id, delivery_key, count(*) AS n, quantile_cont(v, 0.75) FILTER (point_idx < 5) AS early,
      quantile_cont(v, 0.5) FILTER (point_idx BETWEEN fb AND fb+3) AS landed, min(frame_idx) AS af, max(frame_idx) AS bf, arg_min(mx, frame_idx) AS ax, arg_min(my, frame_idx) AS ay,
      arg_min(mz, frame_idx) AS az, arg_max(mx, frame_idx) AS bx, arg_max(my, frame_idx) AS by_, arg_max(mz, frame_idx) AS bz
    FROM (SELECT l.*, {_kmh('mx3-mx', 'my3-my', 'mz3-mz', 'f3-frame_idx')} AS v, min(CASE WHEN frame_idx >= lb THEN point_idx END) OVER (PARTITION BY l.video_id, l.delivery_key) AS fb FROM (
      SELECT *, lead(mx, 3) OVER w AS mx3, lead(my, 3) OVER w AS my3, lead(mz, 3) OVER w AS mz3, lead(frame_idx, 3) OVER w AS f3 FROM flight3d WINDOW w AS ({PTS})) l
      LEFT JOIN (SELECT video_id, delivery_key, max(bounce_frame) AS lb FROM bounced GROUP BY ALL) b ON b.video_id = l.video_id AND b.delivery_key = l.delivery_key) q
    GROUP BY ALL) g) h""")


def _known(expr, n):
    return f"CASE WHEN n >= 2 THEN {R(expr, n)} ELSE {D(0)} END"


query("delivery_speeds", speeds, ("paced",), f"""
SELECT video_id, delivery_key, {_known('r', 1)} AS release_speed_kmh, {_known('s', 1)} AS bounce_speed_kmh, {_known(f's*{D(0.95)}', 1)} AS crease_speed_kmh,
  {_known(f'(r+s+s*{D(0.95)})/3', 1)} AS avg_speed_kmh, {_known('r', 1)} AS max_speed_kmh, {_known('greatest(5, (r-s)/r*100)', 1)} AS pitch_deceleration_pct,
  {_known(f'greatest(1, bf-af)/{D(30)}', 2)} AS time_in_air_sec FROM paced""")


def impacts(t: Tables):
    k = F.col("delivery_key")
    cols = {"x": (k * 7 % 41 - 20) / 100, "y": (k * 13 % 2000) / 100, "z": (k * 3 % 120) / 100,
            "vx": (k * 11 % 21 - 10) / 10, "vy": (k * 5 % 400) / 10, "vz": (k * 17 % 61 - 30) / 10}
    return t.deliveries_raw.select("video_id", "delivery_key", *[v.alias(c) for c, v in cols.items()])


derive("launched", ("deliveries",), """
SELECT video_id, delivery_key, CAST(delivery_key*7%41 - 20 AS DOUBLE)/100 AS x, CAST(delivery_key*13%2000 AS DOUBLE)/100 AS y, CAST(delivery_key*3%120 AS DOUBLE)/100 AS z,
  CAST(delivery_key*11%21 - 10 AS DOUBLE)/10 AS vx, CAST(delivery_key*5%400 AS DOUBLE)/10 AS vy, CAST(delivery_key*17%61 - 30 AS DOUBLE)/10 AS vz FROM deliveries""")
_V = "sqrt(vx*vx+vy*vy+vz*vz)"
_DT = f"(1/{D(30)})"
derive("flown", ("launched",), f"""
WITH RECURSIVE fly AS (SELECT video_id, delivery_key, 0 AS step, x, y, z, vx, CASE WHEN vy <= 1 THEN {D(30)} ELSE vy END AS vy, vz, x AS px, y AS py, z AS pz FROM launched
  UNION ALL SELECT video_id, delivery_key, step+1, nx, ny, nz, vx - {D(0.007)}*v*vx*{_DT}, vy - {D(0.007)}*v*vy*{_DT}, vz + (-{D(0.007)}*v*vz - {D(9.81)})*{_DT}, nx, least({D(20.12)}, ny), greatest(0, nz)
  FROM (SELECT *, {_V} AS v, x + vx*{_DT} AS nx, y + vy*{_DT} AS ny, z + (vz*{_DT} - 0.5*{D(9.81)}*{_DT}*{_DT}) AS nz FROM fly WHERE y < {D(20.12)} AND step < 100) f)
SELECT * FROM fly""")
query("project_to_stumps", lambda t: six(dv.project_to_stumps(impacts(t)), "stump_x", "stump_z").select("video_id", "delivery_key", "stump_x", "stump_z"), ("flown",), f"""
SELECT video_id, delivery_key, {R('ax + part*(px-ax)', 6)} AS stump_x, {R('greatest(0, az + part*(pz-az))', 6)} AS stump_z FROM (
  SELECT *, greatest(0, least(1, ({D(20.12)}-ay)/greatest({D(1e-5)}, py-ay))) AS part FROM (
    SELECT *, coalesce(lag(px) OVER w, px) AS ax, coalesce(lag(py) OVER w, py) AS ay, coalesce(lag(pz) OVER w, pz) AS az, max(step) OVER (PARTITION BY delivery_key) AS top
    FROM flown WINDOW w AS (PARTITION BY delivery_key ORDER BY step)) a WHERE step = top) b""")


def paths(t: Tables):
    return ballistic_path(spread(impacts(t), "delivery_key")).select("video_id", "delivery_key", "step", "path_x", "path_y", "path_z")


query("ballistic_path", lambda t: six(paths(t), "path_x", "path_y", "path_z"), ("flown",), f"""
SELECT video_id, delivery_key, CAST(step AS INT) AS step, {R('px', 6)} AS path_x, {R('py', 6)} AS path_y, {R('pz', 6)} AS path_z FROM flown""")
derive("tail4", ("flight",), """
SELECT video_id, delivery_key, count(*) AS n, arg_min(cx, frame_idx) AS ax, arg_min(cy, frame_idx) AS ay, arg_max(cx, frame_idx) AS bx, arg_max(cy, frame_idx) AS by_ FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx DESC) AS rn FROM flight) f WHERE rn <= 4 GROUP BY ALL""")
query("project_pixels", lambda t: dv.project_pixels(t.flight), ("tail4",), """
SELECT video_id, delivery_key, CAST(i AS INT) AS step, CAST(trunc(bx + (bx-ax)/(n-1)*i) AS BIGINT) AS px, CAST(trunc(by_ + (by_-ay)/(n-1)*i + 0.25*(i*i)) AS BIGINT) AS py
FROM tail4, (SELECT unnest(range(1, 9)) AS i) s WHERE n >= 3""")
query("bezier_trail", lambda t: dv.bezier_trail(t.flight), ("flight",), f"""
WITH l AS (SELECT video_id, delivery_key, list(cx ORDER BY frame_idx) AS xs, list(cy ORDER BY frame_idx) AS ys, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx DESC) AS rn FROM flight) f WHERE rn <= 20 GROUP BY ALL),
  s AS (SELECT *, CASE WHEN n >= 3 THEN least(n*2, 40) ELSE n END AS k, unnest(range(CASE WHEN n >= 3 THEN least(n*2, 40) ELSE n END)) AS i FROM l),
  c AS (SELECT *, CASE WHEN i = k-1 THEN {D(1)} ELSE i*({D(1)}/(k-1)) END AS t, CAST(floor(n/2) AS BIGINT) + 1 AS m FROM s)
SELECT video_id, delivery_key, CAST(i AS INT) AS step,
  CAST(trunc(CASE WHEN n >= 3 THEN (1-t)*(1-t)*xs[1] + 2*(1-t)*t*xs[m] + t*t*xs[n] ELSE xs[i+1] END) AS BIGINT) AS px,
  CAST(trunc(CASE WHEN n >= 3 THEN (1-t)*(1-t)*ys[1] + 2*(1-t)*t*ys[m] + t*t*ys[n] ELSE ys[i+1] END) AS BIGINT) AS py FROM c""".replace("WITH l AS", "SELECT * FROM (WITH l AS", 1) + ") q")

# ---- highlights
derive("energy", ("audio",), """
SELECT video_id, w AS window_idx, CAST(w*8 AS DOUBLE) AS time_s, sqrt(avg(amplitude*amplitude)) AS energy FROM (
  SELECT *, CAST(floor(sample_idx/8) AS BIGINT) AS w FROM audio) a GROUP BY video_id, w HAVING count(*) = 8""")


def energies(t: Tables):
    return hl.rms_energy(t.audio, window_s=8.0, rate=1)


query("rms_energy", lambda t: six(energies(t), "energy"), ("energy",), f"SELECT * REPLACE ({R('energy', 6)} AS energy) FROM energy")
for _name, _k in (("loudness", "0.5"), ("loudness_default", "2")):
    derive(_name, ("energy",), f"""
SELECT video_id, avg(energy) AS mean_energy, avg(energy) + CAST({_k} AS DOUBLE)*stddev_pop(energy) AS threshold, count(*) AS windows FROM energy GROUP BY video_id HAVING count(*) >= 4""")
query("energy_threshold", lambda t: six(hl.energy_threshold(energies(t), k=0.5), "mean_energy", "threshold"), ("loudness",),
      f"SELECT video_id, {R('mean_energy', 6)} AS mean_energy, {R('threshold', 6)} AS threshold, windows FROM loudness")
query("energy_threshold_default", lambda t: six(hl.energy_threshold(energies(t)), "mean_energy", "threshold"), ("loudness_default",),
      f"SELECT video_id, {R('mean_energy', 6)} AS mean_energy, {R('threshold', 6)} AS threshold, windows FROM loudness_default")
derive("loud_default", ("energy", "loudness_default"), "SELECT video_id, time_s FROM energy JOIN loudness_default USING (video_id) WHERE energy > threshold")
derive("loud", ("energy", "loudness"), "SELECT video_id, time_s FROM energy JOIN loudness USING (video_id) WHERE energy > threshold")


def spaced_sql(source: str, key: str, gap: str) -> str:
    return f"""WITH RECURSIVE g AS (SELECT video_id, min({key}) AS {key} FROM {source} GROUP BY video_id
  UNION ALL SELECT g.video_id, min(t.{key}) FROM g JOIN {source} t ON t.video_id = g.video_id AND t.{key} >= g.{key} + {gap} GROUP BY g.video_id, g.{key})
SELECT * FROM g"""


derive("peaks", ("loud",), spaced_sql("loud", "time_s", D(20)))
query("audio_peaks", lambda t: (lambda e: hl.audio_peaks(e, hl.energy_threshold(e, k=0.5), fps=30.0, min_gap_s=20.0))(energies(t)), ("peaks",), f"""
SELECT video_id, {R('time_s', 2)} AS peak_time_s, CAST(round_even(time_s*30, 0) AS BIGINT) AS frame_idx FROM peaks""")
derive("peaks_default", ("loud_default",), spaced_sql("loud_default", "time_s", "2"))
query("audio_peaks_default", lambda t: (lambda e: hl.audio_peaks(e, hl.energy_threshold(e)))(energies(t)), ("peaks_default",), f"""
SELECT video_id, {R('time_s', 2)} AS peak_time_s, CAST(round_even(time_s*30, 0) AS BIGINT) AS frame_idx FROM peaks_default""")
derive("spaced_roars", ("roars",), spaced_sql("roars", "frame_idx", "600"))
query("greedy_spacing", lambda t: hl.greedy_spacing(t.roars, "frame_idx", 600), ("spaced_roars",), "SELECT * FROM spaced_roars")
_BURSTS = """
SELECT video_id, greatest(0, frame_idx-8) AS start_pos, CASE WHEN stop IS NULL THEN n ELSE least(n, stop+4) END AS end_pos FROM (
  SELECT c.*, coalesce(p.conf, 0) AS prev, (SELECT min(frame_idx) FROM confidences s WHERE s.video_id = c.video_id AND s.frame_idx > c.frame_idx AND s.conf < 0.5) AS stop,
    max(c.frame_idx) OVER (PARTITION BY c.video_id) + 1 AS n
  FROM confidences c LEFT JOIN confidences p ON p.video_id = c.video_id AND p.frame_idx = c.frame_idx - 1) a WHERE conf >= 0.5 AND prev < 0.5"""
derive("bursts", ("confidences",), _BURSTS)
derive("bursts_default", ("confidences",), _BURSTS.replace("frame_idx-8", "frame_idx-120").replace("stop+4", "stop+60"))
query("confidence_intervals_default", lambda t: hl.confidence_intervals(t.confidences), ("bursts_default",), "SELECT video_id, start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM bursts_default")


def bursts(t: Tables):
    return hl.confidence_intervals(t.confidences, fps=2.0)


query("confidence_intervals", bursts, ("bursts",), "SELECT video_id, start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM bursts")
derive("merged", ("bursts",), """
SELECT video_id, min(start_pos) AS start_pos, CAST(max(end_pos) AS BIGINT) AS end_pos FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, max(end_pos) OVER (PARTITION BY video_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bursts) a) b GROUP BY video_id, g""")
query("merge_intervals", lambda t: hl.merge_intervals(bursts(t)), ("merged",), "SELECT * FROM merged")


def clip_videos(t: Tables):
    return t.videos.select("video_id", F.lit(2.0).alias("fps"), (F.col("total_frames") / 2 - 10).alias("duration_s"))


query("clip_seconds", lambda t: six(hl.clip_seconds(hl.merge_intervals(bursts(t)), clip_videos(t)), "end_s"), ("merged", "videos"), f"""
SELECT video_id, start_s, {R('end_s', 6)} AS end_s FROM (SELECT video_id, start_pos/{D(2)} AS start_s, least(end_pos/{D(2)}, total_frames/{D(2)} - 10 - {D(0.001)}) AS end_s
  FROM merged JOIN videos USING (video_id)) a WHERE end_s > start_s + {D(0.1)}""")


def reel_videos(t: Tables):
    return t.moments.groupBy("video_id").agg((F.max("frame_idx") / 30 + 1.0).alias("duration_s")).withColumn("fps", F.lit(30.0))


query("moment_intervals", lambda t: six(hl.merge_intervals(hl.moment_intervals(t.moments, reel_videos(t))), "start_pos", "end_pos"), ("moments",), f"""
SELECT * FROM (WITH i AS (SELECT video_id, greatest(0, frame_idx/{D(30)} - 3) AS start_pos, least(dur - {D(0.05)}, frame_idx/{D(30)} + 3) AS end_pos FROM moments
    JOIN (SELECT video_id, max(frame_idx)/{D(30)} + 1 AS dur FROM moments GROUP BY video_id) v USING (video_id)),
  r AS (SELECT *, max(end_pos) OVER (PARTITION BY video_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE end_pos > start_pos + 0.5),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT video_id, {R('min(start_pos)', 6)} AS start_pos, {R('max(end_pos)', 6)} AS end_pos FROM g GROUP BY video_id, k) q""")
query("distinct_moments", lambda t: hl.distinct_moments(t.moments), ("moments",), "SELECT DISTINCT video_id, frame_idx FROM moments")
derive("cooccur", ("moments", "roars"), """
SELECT DISTINCT video_id, frame_idx FROM moments v WHERE EXISTS (SELECT 1 FROM roars a WHERE a.video_id = v.video_id AND a.frame_idx BETWEEN v.frame_idx - 75 AND v.frame_idx + 75)""")
query("audio_visual_cooccurrence", lambda t: hl.audio_visual_cooccurrence(t.moments, t.roars), ("cooccur",), "SELECT * FROM cooccur")
derive("lone_roars", ("moments", "roars"), """
SELECT video_id, frame_idx FROM roars a WHERE NOT EXISTS (SELECT 1 FROM moments v WHERE a.video_id = v.video_id AND a.frame_idx BETWEEN v.frame_idx - 75 AND v.frame_idx + 75)""")
derive("standalone", ("lone_roars",), spaced_sql("lone_roars", "frame_idx", "76"))
query("standalone_audio", lambda t: hl.standalone_audio(t.moments, t.roars), ("standalone",), "SELECT * FROM standalone")
query("fuse_highlights", lambda t: hl.fuse_highlights(t.moments, t.roars), ("moments", "standalone"),
      "SELECT video_id, frame_idx FROM moments UNION SELECT video_id, frame_idx FROM standalone")

# ---- shots
_W = "PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 44 PRECEDING AND CURRENT ROW"
derive("parab", ("ball",), f"""
SELECT *, CASE WHEN sst > {D(1e-9)} THEN 1 - greatest(0, ssr)/sst ELSE 0 END AS r2 FROM (
  SELECT video_id, frame_idx, n, a, b, list_sum(list_transform(list_zip(ts, ys), lambda p: (p[2]-(a*p[1]*p[1]+b*p[1]+c))*(p[2]-(a*p[1]*p[1]+b*p[1]+c)))) AS ssr,
    list_sum(list_transform(ys, lambda y: (y-y0/n)*(y-y0/n))) AS sst, f0 FROM (
    SELECT *, (y2*(s2*n-s1*s1) - s3*(y1*n-s1*y0) + s2*(y1*s1-s2*y0))/det AS a, (s4*(y1*n-s1*y0) - y2*(s3*n-s1*s2) + s2*(s3*y0-y1*s2))/det AS b,
      (s4*(s2*y0-y1*s1) - s3*(s3*y0-y1*s2) + y2*(s3*s1-s2*s2))/det AS c FROM (
      SELECT *, s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM (
        SELECT video_id, frame_idx, len(ts) AS n, ts, ys, f0, list_sum(ts) AS s1, list_sum(list_transform(ts, lambda t: t*t)) AS s2, list_sum(list_transform(ts, lambda t: t*t*t)) AS s3,
          list_sum(list_transform(ts, lambda t: t*t*t*t)) AS s4, list_sum(ys) AS y0, list_sum(list_transform(list_zip(ts, ys), lambda p: p[1]*p[2])) AS y1,
          list_sum(list_transform(list_zip(ts, ys), lambda p: p[1]*p[1]*p[2])) AS y2 FROM (
          SELECT video_id, frame_idx, fs[1] AS f0, list_transform(fs, lambda f: CAST(f-fs[1] AS DOUBLE)) AS ts, ys FROM (
            SELECT video_id, frame_idx, list(frame_idx) OVER w AS fs, list((y1+y2)/2) OVER w AS ys FROM ball WINDOW w AS ({_W})) q) l WHERE len(ts) >= 16) m) d) e) f""")
query("rolling_parabola", lambda t: six(shots.rolling_parabola(t.ball), "a", "r2", "apex_frame", digits=5), ("parab",), f"""
SELECT video_id, frame_idx, n AS points, {R('a', 5)} AS a, {R('r2', 5)} AS r2, a > {D(0.1)} AND r2 > {D(0.8)} AS is_arc,
  CASE WHEN a > {D(0.1)} AND r2 > {D(0.8)} THEN {R('f0 - b/(2*a)', 5)} END AS apex_frame FROM parab""")
query("shot_arcs", lambda t: six(shots.shot_arcs(t.ball), "a", "r2", "apex_frame", digits=5), ("parab",), f"""
SELECT video_id, frame_idx, n AS points, {R('a', 5)} AS a, {R('r2', 5)} AS r2, true AS is_arc, {R('f0 - b/(2*a)', 5)} AS apex_frame, f0 - b/(2*a) < frame_idx AS is_falling
FROM parab WHERE a > {D(0.1)} AND r2 > {D(0.8)}""")
def _psum(expr):
    return f"list_sum(list_transform(pts, lambda p: {expr}))"


derive("shot_walk", ("ball", "frames"), f"""
WITH RECURSIVE s AS (SELECT f.video_id, f.frame_idx, (b.x1+b.x2)/2 AS cx, (b.y1+b.y2)/2 AS cy, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS k
    FROM frames f LEFT JOIN ball b ON b.video_id = f.video_id AND b.frame_idx = f.frame_idx),
  walk AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, CAST([] AS STRUCT(f BIGINT, x DOUBLE, y DOUBLE)[]) AS pts, false AS active, CAST(NULL AS VARCHAR) AS result, {D(0)} AS conf, CAST(NULL AS VARCHAR) AS shot
      FROM (SELECT DISTINCT video_id FROM s) v
    UNION ALL SELECT video_id, k, frame_idx, CASE WHEN ended THEN [] ELSE pts END, CASE WHEN ended THEN false ELSE active OR arc END,
      CASE WHEN ended THEN NULL WHEN c = 1 THEN 'MAKE' WHEN c = 0.5 THEN 'MISS' ELSE result END, CAST(c AS DOUBLE), CASE WHEN ended THEN result END FROM (
      SELECT *, NOT arc AND active AND len(pts) > 15 AS ended, CASE WHEN NOT arc THEN 0 WHEN NOT falling THEN 0.6
          WHEN y BETWEEN 158 AND 345 AND (x BETWEEN 25 AND 204 OR x BETWEEN 1075 AND 1254) THEN 1 WHEN y > 345 THEN 0.5 ELSE 0.6 END AS c FROM (
        SELECT *, coalesce(len(pts) > 15 AND a > {D(0.1)} AND sst > 0 AND 1 - ssr/sst > {D(0.8)}, false) AS arc, -b/(2*a) < pts[-1].f - pts[1].f AS falling, pts[-1].x AS x, pts[-1].y AS y FROM (
          SELECT *, {_psum('(p.y-ym)*(p.y-ym)')} AS sst, {_psum('(p.y-(a*(p.f-f0)*(p.f-f0)+b*(p.f-f0)+c0))*(p.y-(a*(p.f-f0)*(p.f-f0)+b*(p.f-f0)+c0))')} AS ssr FROM (
            SELECT *, (y2*(s2*n-s1*s1) - s3*(y1*n-s1*y0) + s2*(y1*s1-s2*y0))/det AS a, (s4*(y1*n-s1*y0) - y2*(s3*n-s1*s2) + s2*(s3*y0-y1*s2))/det AS b,
              (s4*(s2*y0-y1*s1) - s3*(s3*y0-y1*s2) + y2*(s3*s1-s2*s2))/det AS c0, y0/n AS ym FROM (
              SELECT *, s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM (
                SELECT *, len(pts) AS n, {_psum(D('p.f-f0'))} AS s1, {_psum(D('(p.f-f0)*(p.f-f0)'))} AS s2, {_psum(D('(p.f-f0)*(p.f-f0)*(p.f-f0)'))} AS s3,
                  {_psum(D('(p.f-f0)*(p.f-f0)*(p.f-f0)*(p.f-f0)'))} AS s4, {_psum('p.y')} AS y0, {_psum('(p.f-f0)*p.y')} AS y1, {_psum('(p.f-f0)*(p.f-f0)*p.y')} AS y2 FROM (
                  SELECT *, pts[1].f AS f0 FROM (
                    SELECT w.video_id, s.k, s.frame_idx, w.active, w.result, CASE WHEN s.cx IS NULL THEN w.pts ELSE list_append(w.pts, {{'f': s.frame_idx, 'x': s.cx, 'y': s.cy}})[-45:] END AS pts
                    FROM walk w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1) q1) q2) q3) q4) q5) q6) q7) q8)
SELECT video_id, frame_idx, conf, shot FROM walk WHERE k > 0""")
query("shot_state", lambda t: shots.shot_state(t.ball, t.frames), ("shot_walk",), "SELECT * FROM shot_walk")
query("shot_frames", lambda t: shots.shot_frames(t.confidences), ("confidences",), "SELECT video_id, count(*) FILTER (conf >= 0.5) AS shot_events FROM confidences GROUP BY video_id")

# ---- registration
from fieldlens.constants import court_reference  # noqa: E402

_REF = ", ".join(f"({i}, {D(x)}, {D(y)})" for i, x, y in court_reference())
derive("court_ref", (), f"SELECT * FROM (VALUES {_REF}) v(kp_idx, ref_x, ref_y)")
derive("observed", ("keypoint_obs",), "SELECT video_id, frame_idx, count(*) FILTER (x > 0 AND y > 0 AND kp_idx < 18) AS observed FROM keypoint_obs GROUP BY ALL")
query("keypoint_observed", lambda t: rg.keypoint_observed(t.keypoint_obs), ("observed",), "SELECT *, observed >= 4 AS usable FROM observed")
query("keypoint_carry_forward", lambda t: rg.keypoint_carry_forward(t.keypoint_obs, t.frames), ("keypoint_obs", "frames"), f"""
SELECT video_id, frame_idx, kp_idx, coalesce(sx, fx, 0) AS x, coalesce(sy, fy, 0) AS y FROM (
  SELECT *, last_value(CASE WHEN conf >= {D(0.6)} THEN x END IGNORE NULLS) OVER w AS sx, last_value(CASE WHEN conf >= {D(0.6)} THEN y END IGNORE NULLS) OVER w AS sy,
    first_value(x IGNORE NULLS) OVER w AS fx, first_value(y IGNORE NULLS) OVER w AS fy
  FROM (SELECT s.video_id, s.frame_idx, s.kp_idx, k.x, k.y, k.conf FROM (SELECT video_id, frame_idx, unnest(range(18)) AS kp_idx FROM frames) s
    LEFT JOIN keypoint_obs k ON k.video_id = s.video_id AND k.frame_idx = s.frame_idx AND k.kp_idx = s.kp_idx) j
  WINDOW w AS (PARTITION BY video_id, kp_idx ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c""")
derive("rejected", ("keypoint_obs", "court_ref"), f"""
WITH RECURSIVE g AS (SELECT video_id, frame_idx, list({{'k': kp_idx, 'x': x, 'y': y, 'rx': ref_x, 'ry': ref_y}} ORDER BY kp_idx) AS p FROM keypoint_obs JOIN court_ref USING (kp_idx)
    WHERE x > 0 AND y > 0 GROUP BY ALL HAVING count(*) >= 3),
  walk AS (SELECT video_id, frame_idx, p, 0 AS i, CAST([] AS BIGINT[]) AS bad FROM g
    UNION ALL SELECT video_id, frame_idx, p, i + 1, CASE WHEN b IS NOT NULL AND tij > 0 AND tik > 0 AND (dik = 0 OR abs((dij/dik - tij/tik)/(tij/tik)) > {D(0.8)}) THEN list_append(bad, me.k) ELSE bad END FROM (
      SELECT *, sqrt((me.x-a.x)*(me.x-a.x)+(me.y-a.y)*(me.y-a.y)) AS dij, sqrt((me.x-b.x)*(me.x-b.x)+(me.y-b.y)*(me.y-b.y)) AS dik,
        sqrt((me.rx-a.rx)*(me.rx-a.rx)+(me.ry-a.ry)*(me.ry-a.ry)) AS tij, sqrt((me.rx-b.rx)*(me.rx-b.rx)+(me.ry-b.ry)*(me.ry-b.ry)) AS tik FROM (
        SELECT *, p[i+1] AS me, others[1] AS a, others[2] AS b FROM (
          SELECT *, list_filter(p, lambda q: q.k <> p[i+1].k AND NOT list_contains(bad, q.k)) AS others FROM walk WHERE i < len(p)) o) n) d)
SELECT video_id, frame_idx, bad FROM walk WHERE i = len(p)""")
query("keypoint_ratio_validation", lambda t: rg.keypoint_ratio_validation(t.keypoint_obs, rg.court_reference_table(t.spark)), ("rejected", "keypoint_obs"), """
SELECT video_id, frame_idx, kp_idx, CASE WHEN rejected THEN 0 ELSE x END AS x, CASE WHEN rejected THEN 0 ELSE y END AS y, rejected FROM (
  SELECT k.*, coalesce(list_contains(bad, kp_idx), false) AS rejected FROM keypoint_obs k LEFT JOIN rejected r USING (video_id, frame_idx)) j""")
derive("kps", ("keypoint_obs",), "SELECT * FROM keypoint_obs WHERE x > 0 AND y > 0 AND kp_idx < 18")
derive("quality", ("kps", "calibration_cols", "court_ref"), """
SELECT video_id, frame_idx, count(*) AS points, avg(sqrt((px-ref_x)*(px-ref_x)+(py-ref_y)*(py-ref_y))) AS mean_error, min(det) < 0 AS is_flipped FROM (
  SELECT k.video_id, k.frame_idx, (h0*x+h1*y+h2)/(h6*x+h7*y+h8) AS px, (h3*x+h4*y+h5)/(h6*x+h7*y+h8) AS py, ref_x, ref_y, h0*h4-h1*h3 AS det
  FROM kps k JOIN calibration_cols c ON c.video_id = k.video_id AND k.frame_idx BETWEEN frame_from AND frame_to JOIN court_ref r ON r.kp_idx = k.kp_idx) p GROUP BY ALL""")
derive("turned", ("kps",), """
WITH f AS (SELECT *, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS before FROM (SELECT DISTINCT video_id, frame_idx FROM kps) d)
SELECT k.video_id, k.frame_idx, avg(sqrt((k.x-a.x)*(k.x-a.x)+(k.y-a.y)*(k.y-a.y))) FILTER (a.kp_idx = k.kp_idx) AS same,
  avg(sqrt((k.x-a.x)*(k.x-a.x)+(k.y-a.y)*(k.y-a.y))) FILTER (a.kp_idx = 17 - k.kp_idx) AS rev
FROM kps k JOIN f USING (video_id, frame_idx) JOIN kps a ON a.video_id = k.video_id AND a.frame_idx = f.before AND (a.kp_idx = k.kp_idx OR a.kp_idx = 17 - k.kp_idx) GROUP BY ALL""")
query("homography_quality", lambda t: six(rg.homography_quality(t.keypoint_obs, calibrations(t), rg.court_reference_table(t.spark)), "mean_error"),
      ("quality", "turned"), f"""
SELECT video_id, frame_idx, points, {R('mean_error', 6)} AS mean_error, is_flipped, coalesce(rev < same, false) AS is_reversed FROM quality LEFT JOIN turned USING (video_id, frame_idx)""")


def modes(t: Tables):
    return rg.homography_mode(t.keypoints_lost, t.camera.filter("known"), t.frames, budget=8)


derive("direct_frames", ("keypoints_lost",), """
SELECT video_id, frame_idx FROM keypoints_lost WHERE x > 0 AND y > 0 AND kp_idx < 18 GROUP BY video_id, frame_idx HAVING count(*) >= 4""")
derive("modes", ("direct_frames", "camera"), """
SELECT video_id, frame_idx, CASE WHEN direct THEN 'direct' WHEN n - seen <= 8 THEN CASE WHEN known THEN 'cmc' ELSE 'static' END ELSE 'lost' END AS mode FROM (
  SELECT *, max(CASE WHEN direct THEN n END) OVER (PARTITION BY video_id ORDER BY n) AS seen FROM (
    SELECT f.video_id, f.frame_idx, f.known, d.video_id IS NOT NULL AS direct, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS n FROM camera f
    LEFT JOIN direct_frames d ON d.video_id = f.video_id AND d.frame_idx = f.frame_idx) a) b""")
query("homography_mode", modes, ("modes",), "SELECT * FROM modes")
query("tracking_continuity", lambda t: rg.tracking_continuity(modes(t)), ("modes",), f"""
SELECT video_id, n AS total_frames, {R('d/n*100', 2)} AS direct_keypoint_pct, {R('f/n*100', 2)} AS optical_flow_cmc_pct, {R('(d+f)/n*100', 2)} AS overall_continuity_pct,
  {R('l/n*100', 2)} AS lost_frames_pct FROM (SELECT video_id, count(*) AS n, count(*) FILTER (mode = 'direct') AS d, count(*) FILTER (mode IN ('cmc', 'static')) AS f,
  count(*) FILTER (mode = 'lost') AS l FROM modes GROUP BY video_id) m""")


def camera_motion(t: Tables):
    rows = [F.lit(1.0), "m1", "m2", "m3", F.lit(1.0), "m5", F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return t.camera.select("video_id", "frame_idx", F.when(F.col("known"), F.array(*rows)).alias("m"))


def frame_calibrations(t: Tables):
    """A direct homography for every frame with enough keypoints."""
    usable = rg.keypoint_observed(t.keypoints_lost).filter("usable").select("video_id", "frame_idx")
    return homography_lookup(usable, calibrations(t)).select("video_id", "frame_idx", "h")


_H = [f"h{i}" for i in range(9)]
# motion matrices here are (1, m1, m2; m3, 1, m5; 0, 0, 1); their inverse in closed form
_INV = ["1/det", "-m1/det", "(m1*m5-m2)/det", "-m3/det", "1/det", "(m2*m3-m5)/det", D(0), D(0), D(1)]
_MOVED = [" + ".join(f"h{3 * (i // 3) + k}*({_INV[3 * k + i % 3]})" for k in range(3)) for i in range(9)]
_CASCADE = f"""
WITH RECURSIVE s AS (SELECT f.*, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS k, 1 - m1*m3 AS det, {', '.join(f'c.{h} AS d{h}' for h in _H)} FROM camera f
    LEFT JOIN (SELECT d.video_id, d.frame_idx, c.* EXCLUDE (video_id) FROM direct_frames d JOIN calibration_cols c ON c.video_id = d.video_id AND d.frame_idx BETWEEN frame_from AND frame_to) c
      ON c.video_id = f.video_id AND c.frame_idx = f.frame_idx),
  walk AS (SELECT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, 'lost' AS mode, 0 AS age, {', '.join(f'CAST(NULL AS DOUBLE) AS {h}' for h in _H)} FROM (SELECT DISTINCT video_id FROM s) v
    UNION ALL SELECT video_id, k, frame_idx, mode, CASE mode WHEN 'direct' THEN 0 WHEN 'lost' THEN age ELSE age + 1 END,
      {', '.join(f"CASE WHEN mode = 'direct' AND p8 IS NOT NULL THEN ({D(0.85)}*d{h} + (1-{D(0.85)})*p{i}/p8)/({D(0.85)}*dh8 + (1-{D(0.85)})*p8/p8) WHEN mode = 'direct' THEN d{h} WHEN mode = 'cmc' THEN p{i}/p8 ELSE {h} END" for i, h in enumerate(_H))}
    FROM (SELECT *, CASE WHEN dh0 IS NOT NULL THEN 'direct' WHEN h0 IS NOT NULL AND age < 8 THEN CASE WHEN p8 IS NOT NULL THEN 'cmc' ELSE 'static' END ELSE 'lost' END AS mode FROM (
      SELECT s.*, w.age, {', '.join(f'w.{h}' for h in _H)}, {', '.join(f'CASE WHEN s.known THEN {e} END AS p{i}' for i, e in enumerate(_MOVED))} FROM walk w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1) n) m)
SELECT * FROM walk WHERE k > 0"""


def cascade(t: Tables, **options):
    found = rg.cascade_homography(frame_calibrations(t), camera_motion(t), t.frames, **options)
    return found.select("video_id", "frame_idx", "mode", *[pyround(F.col("h")[i], 6).alias(h) for i, h in enumerate(_H)])


derive("cascade", ("camera", "direct_frames", "calibration_cols"), _CASCADE)
derive("cascade_default", ("camera", "direct_frames", "calibration_cols"), _CASCADE.replace("age < 8", "age < 90"))
_KNOWN = f"""SELECT video_id, frame_idx, mode, {', '.join(f"CASE WHEN mode <> 'lost' THEN {R(h, 6)} END AS {h}" for h in _H)} FROM """
query("cascade_homography", lambda t: cascade(t, budget=8), ("cascade",), _KNOWN + "cascade")
query("cascade_homography_default", cascade, ("cascade_default",), _KNOWN + "cascade_default")

# ---- routing, catalogue, run logs
query("sample_frames", lambda t: six(rt.sample_frames(t.videos), "time_s"), ("videos",), f"""
SELECT video_id, CAST(i AS INT) AS sample_no, CAST(trunc(p*total_frames) AS BIGINT) AS frame_idx, {R('trunc(p*total_frames)/fps', 6)} AS time_s FROM (
  SELECT *, CASE WHEN i = 4 THEN {D(0.9)} ELSE {D(0.1)} + i*{D(0.2)} END AS p FROM videos, (SELECT unnest(range(5)) AS i) s) v""")
query("subsample_frames", lambda t: rt.subsample_frames(t.frames, 2, 100), ("frames",), "SELECT * FROM frames WHERE frame_idx % 2 = 0 AND frame_idx < 100")
derive("classified", ("frame_stats",), f"""
SELECT *, CASE WHEN g THEN 'cricket' WHEN w THEN 'basketball' WHEN green_ratio >= wood_ratio THEN 'cricket' ELSE 'basketball' END AS sport,
  CASE WHEN g THEN least({D(0.98)}, {D(0.6)} + green_ratio*{D(0.8)}) WHEN w THEN least({D(0.98)}, {D(0.6)} + wood_ratio*{D(0.8)}) ELSE {D(0.65)} END AS conf
FROM (SELECT *, green_ratio > {D(0.22)} AND green_ratio > wood_ratio*1.5 AS g, wood_ratio > 0.25 AND wood_ratio > green_ratio*2 AS w FROM frame_stats) f""")
query("classify_frame", lambda t: rt.classify_frame(t.frame_stats), ("classified",), "SELECT * EXCLUDE (g, w) FROM classified")
query("route_votes", lambda t: six(rt.route_votes(rt.classify_frame(t.frame_stats)), "avg_confidence"), ("classified",), f"""
SELECT video_id, CASE WHEN votes >= CAST(floor(samples/2) AS BIGINT) + 1 AND mean >= {D(0.6)} THEN sport ELSE 'unknown' END AS sport, votes, samples, {R('mean', 6)} AS avg_confidence FROM (
  SELECT *, CAST(sum(votes) OVER v AS BIGINT) AS samples, sum(c) OVER v/sum(votes) OVER v AS mean, row_number() OVER (PARTITION BY video_id ORDER BY votes DESC, first_frame) AS rn FROM (
    SELECT video_id, sport, count(*) AS votes, sum(conf) AS c, min(frame_idx) AS first_frame FROM classified GROUP BY ALL) a WINDOW v AS (PARTITION BY video_id)) b WHERE rn = 1""")
_RX = r"(\d+)%\|.*\|\s*(\d+)/(\d+)"
_STAGES = "CASE WHEN k8 <> '' THEN CASE CAST(k8 AS INT) {b} END WHEN k7 <> '' THEN CASE CAST(k7 AS INT) {c} END WHEN done THEN 'Pipeline Finished Successfully' END"
from fieldlens.constants import BASKETBALL_STAGES, CRICKET_STAGES  # noqa: E402

_STAGES = _STAGES.format(b=" ".join(f"WHEN {k} THEN '{v}'" for k, v in BASKETBALL_STAGES.items()), c=" ".join(f"WHEN {k} THEN '{v}'" for k, v in CRICKET_STAGES.items()))
derive("said", ("run_log",), rf"""
SELECT *, CASE WHEN k8 <> '' THEN CAST(k8 AS INT) WHEN k7 <> '' THEN CAST(k7 AS INT) END AS stage, {_STAGES} AS stage_name,
  CASE WHEN k8 = '1' THEN 8 WHEN k7 = '1' THEN 7 WHEN bb THEN 8 WHEN ck THEN 7 END AS total_stages, CASE WHEN bb THEN 'basketball' WHEN ck THEN 'cricket' END AS sport,
  CASE WHEN k8 = '3' OR k7 = '3' THEN CAST(nullif(regexp_extract(line, 'Total Frames:\s*(\d+)', 1), '') AS BIGINT) END AS declared,
  CASE WHEN k8 = '5' OR k7 = '5' THEN 100 END AS fin,
  CASE WHEN bar THEN coalesce(nullif(regexp_extract(line, 'FPS=([0-9.]+)', 1), ''), nullif(regexp_extract(line, '([0-9.]+)\s*(?:frames/s|it/s)', 1), '')) END AS fps,
  CASE WHEN bar THEN CASE WHEN e1 <> '' THEN CASE WHEN e1 NOT IN ('0s', '00:00', '0') THEN e1 END WHEN e2 NOT IN ('', '00:00', '0') THEN e2 END END AS eta,
  coalesce(nullif(regexp_extract(line, 'VRAM=([0-9a-zA-Z]+)', 1), ''), nullif(trim(regexp_extract(line, 'GPU VRAM:\s*([0-9.]+\s*GB)', 1)), '')) AS vram,
  CASE WHEN bar THEN CAST(nullif(regexp_extract(line, '{_RX}', 1), '') AS BIGINT) END AS pct, CASE WHEN bar THEN CAST(nullif(regexp_extract(line, '{_RX}', 2), '') AS BIGINT) END AS cur,
  CASE WHEN bar THEN CAST(nullif(regexp_extract(line, '{_RX}', 3), '') AS BIGINT) END AS tot
FROM (SELECT *, k8 = '' AND k7 = '' AND contains(line, 'Analytics Report Saved') AS done FROM (
  SELECT *, regexp_extract(line, '\[([1-8])/8\]', 1) AS k8, regexp_extract(line, '\[([1-7])/7\]', 1) AS k7, contains(line, 'sport: BASKETBALL') AS bb, contains(line, 'sport: CRICKET') AS ck,
    contains(line, 'Processing') AS bar, trim(regexp_extract(line, 'ETA=([0-9a-zA-Z\s:]+?)(?:,|$)', 1)) AS e1, regexp_extract(line, '<([0-9:]+)', 1) AS e2 FROM run_log) a) b""")
derive("bars", ("said",), """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS k FROM said WHERE declared IS NOT NULL OR tot IS NOT NULL),
  walk AS (SELECT run_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS known, false AS ok, CAST(NULL AS BIGINT) AS pct, CAST(NULL AS BIGINT) AS cur FROM (SELECT DISTINCT run_id FROM s) r
    UNION ALL SELECT w.run_id, s.k, s.line_no, CASE WHEN s.declared IS NOT NULL THEN s.declared WHEN s.tot >= greatest(50, w.known*0.5) THEN s.tot ELSE w.known END,
      s.declared IS NOT NULL OR s.tot >= greatest(50, w.known*0.5), CASE WHEN s.declared IS NULL THEN s.pct END, CASE WHEN s.declared IS NULL THEN s.cur END
    FROM walk w JOIN s ON s.run_id = w.run_id AND s.k = w.k + 1)
SELECT * FROM walk WHERE ok""")
_last = ", ".join(f"arg_max({c}, line_no) FILTER ({c} IS NOT NULL) AS {c}" for c in ("sport", "stage", "stage_name", "total_stages", "fps", "eta", "vram"))
query("run_log_parse", lambda t: rt.run_log_parse(t.run_log), ("said", "bars"), f"""
SELECT s.*, progress_pct, current_frame, total_frames FROM (SELECT run_id, {_last}, coalesce(max(done) FILTER (done), false) AS completed FROM said GROUP BY run_id) s LEFT JOIN (
  SELECT run_id, arg_max(pct, line_no) FILTER (pct IS NOT NULL) AS progress_pct, arg_max(cur, line_no) FILTER (cur IS NOT NULL) AS current_frame, arg_max(known, line_no) FILTER (known IS NOT NULL) AS total_frames FROM (
    SELECT run_id, line_no, pct, cur, known FROM bars UNION ALL SELECT run_id, line_no, fin, NULL, NULL FROM said WHERE fin IS NOT NULL) u GROUP BY run_id) p USING (run_id)""")

derive("outs", ("output_files",), r"""
SELECT path, content, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(_annotated_web\.mp4|_annotated\.mp4|_analytics\.json|_highlights\.mp4|\.json)$', '') AS stem,
  CASE WHEN path LIKE '%\_annotated\_web.mp4' ESCAPE '\' THEN 'web' WHEN path LIKE '%\_annotated.mp4' ESCAPE '\' THEN 'raw' WHEN path LIKE '%\_analytics.json' ESCAPE '\' THEN 'analytics'
    WHEN path LIKE '%\_highlights.mp4' ESCAPE '\' THEN 'highlights' ELSE 'report' END AS kind FROM output_files""")
derive("known_results", ("outs",), """
SELECT stem, coalesce(max(kind IN ('raw', 'web') AND dir IN ('/out', '/out/basketball')), false) AS ba, coalesce(max(kind = 'analytics' AND dir IN ('/out', '/out/basketball')), false) AS bn,
  coalesce(max((kind IN ('raw', 'web') AND dir = '/out/cricket') OR (kind = 'raw' AND dir = '/out')), false) AS ca, coalesce(max(kind = 'report' AND dir IN ('/out/cricket', '/out/cricket/stats')), false) AS cn,
  coalesce(max(kind = 'raw' AND dir = '/out/cricket'), false) AS cv, coalesce(max(kind = 'raw' AND dir IN ('/out', '/out/basketball')), false) AS bv,
  coalesce(contains(arg_min(content, CASE dir WHEN '/out/basketball' THEN 0 WHEN '/out' THEN 1 END) FILTER (kind = 'analytics' AND dir IN ('/out', '/out/basketball')), 'deliveries'), false) AS says
FROM outs GROUP BY stem""")
_RULE = "CASE WHEN cn THEN 'cricket' WHEN bn THEN CASE WHEN says THEN 'cricket' ELSE 'basketball' END END"
query("video_catalog", lambda t: catalog.video_catalog(t.video_files, t.output_files), ("video_files", "known_results"), rf"""
SELECT name, v.stem, path, {R('length/CAST(1048576 AS DOUBLE)', 1)} AS size_mb, coalesce((ba AND bn) OR (ca AND cn), false) AS has_results,
  coalesce({_RULE}, CASE WHEN contains(parent, 'cricket') OR regexp_matches(v.stem, 'cricket|ipl|t20|pitch|bowl|bat|wicket|overs|indiavsjapan|indvs') THEN 'cricket'
    WHEN contains(parent, 'basketball') OR regexp_matches(v.stem, 'basket|fiba|nba|dunk|hoop|court') THEN 'basketball' ELSE 'unknown' END) AS detected_sport, mtime
FROM (SELECT *, regexp_replace(name, '\.[^.]+$', '') AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS parent FROM (
  SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, row_number() OVER (PARTITION BY regexp_extract(path, '([^/]*)$', 1) ORDER BY
    CASE regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN '/data' THEN 0 WHEN '/data/videos' THEN 1 WHEN '/data/basketball' THEN 2 WHEN '/data/cricket' THEN 3 WHEN '/data/videos/basketball' THEN 4 ELSE 5 END, length) AS rn
  FROM video_files WHERE NOT path LIKE '%.txt') f WHERE rn = 1) v LEFT JOIN known_results k ON k.stem = v.stem""")


def stems(t: Tables):
    name = F.regexp_extract("path", r"([^/]*)\.[^.]+$", 1)
    return t.video_files.select(name.alias("stem")).distinct()


query("resolve_results", lambda t: catalog.resolve_results(stems(t), t.output_files).select(
    "stem", "sport", "annotated_video", "is_web_optimized", "highlights_video"), ("video_files", "outs", "known_results"), rf"""
SELECT stem, coalesce(sport, 'unknown') AS sport, coalesce(web, raw) AS annotated_video, web IS NOT NULL AS is_web_optimized, hl AS highlights_video
FROM (SELECT DISTINCT regexp_extract(path, '([^/]*)\.[^.]+$', 1) AS stem FROM video_files) v
LEFT JOIN (SELECT stem, coalesce({_RULE}, CASE WHEN cv THEN 'cricket' WHEN bv THEN 'basketball' ELSE 'unknown' END) AS sport FROM known_results) k USING (stem)
LEFT JOIN (SELECT stem, arg_min(path, r) FILTER (kind = 'web') AS web, arg_min(path, r) FILTER (kind = 'raw') AS raw, arg_min(path, r) FILTER (kind = 'highlights') AS hl FROM (
  SELECT o.*, CASE sport WHEN 'cricket' THEN CASE dir WHEN '/out/cricket' THEN 0 WHEN '/out' THEN 1 END WHEN 'basketball' THEN CASE dir WHEN '/out/basketball' THEN 0 WHEN '/out' THEN 1 END
    ELSE CASE dir WHEN '/out/basketball' THEN 0 WHEN '/out/cricket' THEN 1 WHEN '/out' THEN 2 END END AS r
  FROM outs o JOIN (SELECT stem, coalesce({_RULE}, CASE WHEN cv THEN 'cricket' WHEN bv THEN 'basketball' ELSE 'unknown' END) AS sport FROM known_results) s USING (stem)) f WHERE r IS NOT NULL GROUP BY stem) p USING (stem)""")


# ---- the whole chain: the checking SQL takes the steps above over the chain's own tables
def pitch_calibrations(t: Tables):
    """Pixels to metres: the calibrations of the test tables, shrunk."""
    h = {f"h{i}": F.col(f"h{i}") - (40 if i == 5 else 0) for i in range(9)}
    return t.match_calibration_cols.select("video_id", "frame_from", "frame_to", F.array(*[c / 8 if i < 6 else c for i, c in enumerate(h.values())]).alias("h"))


def stumps_seen(t: Tables):
    at = F.col("video_id") * 37 + F.floor(F.col("frame_idx") / 20).cast("bigint") * 61
    return t.match_frames.select("video_id", "frame_idx", (at % 200).cast("double").alias("sx"), (at % 107).cast("double").alias("sy"))


def match_rows(t: Tables):
    return cricket_match(t.match_detections, t.match_roles, t.match_frames, stumps_seen(t), pitch_calibrations(t), span=4096)


derive_as("m_", {"detections": "match_detections"}, "gated")
derive("m_ball", ("m_gated", "match_detections"), """
SELECT g.*, d.x1, d.y1, d.x2, d.y2 FROM m_gated g JOIN match_detections d USING (video_id, frame_idx, det_id)""")
derive_as("m_", {"ball": "m_ball", "frames": "match_frames"}, "tracked")
derive_as("m_", {**_MATCH, "ball": "m_tracked"}, "segments")
_KEY = "(SELECT min(start_frame) FROM m_segments s WHERE s.video_id = {0}.video_id AND s.done_frame >= {0}.frame_idx) AS delivery_key"
derive("m_flight", ("m_tracked", "m_segments", "match_calibration_cols"), f"""
SELECT * FROM (SELECT t.video_id, t.frame_idx, CAST(t.cx AS DOUBLE) AS cx, CAST(t.cy AS DOUBLE) AS cy, CASE WHEN ok THEN mx END AS mx, CASE WHEN ok THEN my END AS my, {_KEY.format('t')}
  FROM m_tracked t LEFT JOIN (SELECT *, mx BETWEEN -5 AND 26 AND my BETWEEN -6 AND 6 AS ok FROM (
    SELECT p.video_id, p.frame_idx, (h0/8*cx+h1/8*cy+h2/8)/(h6*cx+h7*cy+h8) AS mx, (h3/8*cx+h4/8*cy+(h5-40)/8)/(h6*cx+h7*cy+h8) AS my
    FROM m_tracked p JOIN match_calibration_cols c ON c.video_id = p.video_id AND p.frame_idx BETWEEN frame_from AND frame_to) q) m
  ON m.video_id = t.video_id AND m.frame_idx = t.frame_idx) f WHERE delivery_key IS NOT NULL""")
derive("m_batsmen", ("match_roles", "m_segments"), f"""
SELECT video_id, delivery_key, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY video_id, delivery_key ORDER BY frame_idx, player_id) AS rn FROM (
  SELECT r.*, {_KEY.format('r')} FROM match_roles r WHERE role = 'batsman') a WHERE delivery_key IS NOT NULL) b WHERE rn = 1""")
derive("m_stumps", ("match_frames", "m_segments"), f"""
SELECT video_id, delivery_key, arg_min(pl%200, frame_idx) AS sx, arg_min(pl%107, frame_idx) AS sy FROM (
  SELECT f.*, video_id*37 + CAST(floor(frame_idx/20) AS BIGINT)*61 AS pl, {_KEY.format('f')} FROM match_frames f) a WHERE delivery_key IS NOT NULL GROUP BY ALL""")
derive_as("m_", {"flight": "m_flight", "batsmen": "m_batsmen", "stumps": "m_stumps"},
          "turns", "spaced_turns", "bounced", "context", "contact", "bowled", "shot_labels")
derive("m_metric", ("m_flight",), "SELECT * FROM m_flight WHERE mx IS NOT NULL")
derive_as("m_", {"flight": "m_metric", "bounced": "m_bounced"}, "flight3d", "paced")
derive("m_placed", ("m_flight", "m_bounced", "m_paced", "m_segments"), f"""
SELECT d.*, bx, by_, first_x, coalesce(p.release, 0) AS release_speed_kmh, coalesce(p.landing, 0) AS bounce_speed_kmh FROM (
    SELECT video_id, start_frame AS delivery_key, done_frame, forced, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS delivery_number FROM m_segments) d
  JOIN (SELECT f.video_id, f.delivery_key, arg_min(mx, frame_idx) FILTER (mx IS NOT NULL) AS first_x, max(CASE WHEN frame_idx = bf THEN mx END) AS bx, max(CASE WHEN frame_idx = bf THEN my END) AS by_
    FROM m_flight f LEFT JOIN (SELECT video_id, delivery_key, max(bounce_frame) AS bf FROM m_bounced GROUP BY ALL) b ON b.video_id = f.video_id AND b.delivery_key = f.delivery_key
    GROUP BY ALL) c USING (video_id, delivery_key)
  LEFT JOIN (SELECT video_id, delivery_key, {_known('r', 1)} AS release, {_known('s', 1)} AS landing FROM m_paced) p USING (video_id, delivery_key)""")
derive("m_launched", ("m_placed",), f"""
SELECT video_id, delivery_key, {D(0.02)} AS x, {D(18)} AS y, {D(0.45)} AS z, {D(0.01)} AS vx, bounce_speed_kmh/{D(3.6)} AS vy, {D(1.2)} AS vz FROM m_placed""")
derive_as("m_", {"launched": "m_launched"}, "flown")
derive("m_rated", ("m_placed", "m_flown"), f"""
SELECT p.* EXCLUDE (bx, by_), bx AS metric_x, by_ AS metric_y, {D(0)} AS seam_deg, stump_x, stump_z FROM m_placed p JOIN (
  SELECT video_id, delivery_key, ax + part*(px-ax) AS stump_x, greatest(0, az + part*(pz-az)) AS stump_z FROM (
    SELECT *, greatest(0, least(1, ({D(20.12)}-ay)/greatest({D(1e-5)}, py-ay))) AS part FROM (
      SELECT *, coalesce(lag(px) OVER w, px) AS ax, coalesce(lag(py) OVER w, py) AS ay, coalesce(lag(pz) OVER w, pz) AS az, max(step) OVER (PARTITION BY video_id, delivery_key) AS top
      FROM m_flown WINDOW w AS (PARTITION BY video_id, delivery_key ORDER BY step)) a WHERE step = top) b) s USING (video_id, delivery_key)""")
derive_as("m_", {"deliveries": "m_rated"}, "zone2", "xd", "dismissal")
derive("m_impacts", ("m_flight", "m_contact", "m_bowled", "m_rated"), renamed(re.sub(
    r"CAST\(\(h\.delivery_key\+h\.video_id\)\S+( - 20| - 15)? AS DOUBLE\)(/100)? AS (pitch_x|pitch_y|stump_x|stump_z)",
    lambda m: {"pitch_x": "e.metric_y AS pitch_x", "pitch_y": "e.metric_x AS pitch_y"}.get(m[3], f"e.{m[3]}"), DERIVED["impacts"][1]),
    {n: f"m_{n}" for n in ("flight", "contact", "bowled")}).replace(
        "LEFT JOIN a ON", "JOIN m_rated e ON e.video_id = h.video_id AND e.delivery_key = h.delivery_key LEFT JOIN a ON"))
lbw_sql("m_impacts", "m_ruled")
derive("m_outcomes", ("m_ruled",), ORACLES["delivery_outcome"][ORACLES["delivery_outcome"].rindex("SELECT video_id, delivery_key, outcome,"):].replace("impact_ruled", "m_ruled"))
derive("m_bowled_at", ("m_rated",), "SELECT * REPLACE (coalesce(metric_x, first_x, 10) AS metric_x, coalesce(metric_y, 0) AS metric_y) FROM m_rated")
derive_as("m_", {"deliveries": "m_bowled_at"}, "zoned")
derive("m_described", ("m_zoned", "m_dismissal", "m_outcomes", "m_shot_labels"), """
SELECT z.video_id, z.delivery_key, z.delivery_key AS start_frame, z.done_frame, z.delivery_number AS ball_no, z.release_speed_kmh, z.bounce_speed_kmh, z.metric_x, z.metric_y, z.line, z.length, z.stump_x, z.stump_z,
  x.xd_pct, x.threat_level, coalesce(l.shot_label, 'defense') AS shot_played, o.* EXCLUDE (video_id, delivery_key),
  CASE WHEN z.forced AND z.delivery_number%6 = 0 THEN CAST(z.delivery_number//6 AS STRING) || '.0' ELSE CAST((z.delivery_number-1)//6 AS STRING) || '.' || CAST((z.delivery_number-1)%6 + 1 AS STRING) END AS over
FROM m_zoned z JOIN m_dismissal x USING (video_id, delivery_key) JOIN m_outcomes o USING (video_id, delivery_key) LEFT JOIN m_shot_labels l USING (video_id, delivery_key)""")
derive_as("m_", {"described": "m_described"}, "spoken")
_MATCH_COLUMNS = ("video_id", "delivery_key", "done_frame", "ball_no", "over", "release_speed_kmh", "bounce_speed_kmh", "line", "length", "shot_played", "outcome",
                  "is_wicket", "is_boundary", "impact_frame", "final_verdict", "xd_pct", "threat_level", "commentary")
query("cricket_match", lambda t: six(match_rows(t).select(*_MATCH_COLUMNS, "runs", "stump_x", "stump_z"), "stump_x", "stump_z"), ("m_described", "m_spoken"), f"""
SELECT {', '.join(_MATCH_COLUMNS)}, CAST(CASE outcome WHEN 'four' THEN 4 WHEN 'six' THEN 6 WHEN 'runs' THEN 1 ELSE 0 END AS INT) AS runs, {R('stump_x', 6)} AS stump_x, {R('stump_z', 6)} AS stump_z
FROM m_described JOIN m_spoken USING (video_id, delivery_key)""")
