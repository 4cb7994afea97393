"""Court, possession, identity and space queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import court, possession as poss
from fieldlens.plans.registry import Tables, derive, query, rounded as R
from fieldlens.scale import pyround


def calibrations(t: Tables):
    return t.calibration_cols.select(
        "video_id", "frame_from", "frame_to", F.array(*[f"h{i}" for i in range(9)]).alias("h")
    )


def foot_points(t: Tables):
    foot = court.bbox_geometry(t.tracks)
    return foot.select("video_id", "frame_idx", "player_id", F.col("foot_x").cast("double").alias("x"),
                       F.col("foot_y").cast("double").alias("y"))


def six(df, *columns, digits=6):
    """Round measured columns so that the order of additions does not show."""
    return df.withColumns({c: pyround(F.col(c), digits) for c in columns})


query("bbox_geometry", lambda t: court.bbox_geometry(t.tracks), ("tracks",), """
SELECT video_id, frame_idx, player_id, (x1+x2)/2 AS center_x, (y1+y2)/2 AS center_y, x2-x1 AS width, y2-y1 AS height,
  CAST(trunc((x1+x2)/2) AS BIGINT) AS foot_x, CAST(trunc(y2) AS BIGINT) AS foot_y FROM tracks""")
query("crowd_filter", lambda t: court.crowd_filter(
    t.tracks, t.frames.withColumn("height", F.lit(240))), ("tracks", "frames"), """
SELECT t.* FROM tracks t JOIN frames USING (video_id, frame_idx) WHERE y2 >= CAST(0.25 AS DOUBLE) * 240""")
derive("court_tracks", ("tracks", "positions"), """
SELECT t.* REPLACE (CAST(CASE WHEN edge THEN 0 ELSE team END AS INT) AS team, is_sideline OR edge AS is_sideline) FROM (
  SELECT t.*, coalesce(p.x <= 0.5 OR p.x >= 199.5 OR p.y <= 0.5 OR p.y >= 106.5, false) AS edge
  FROM tracks t LEFT JOIN positions p USING (video_id, frame_idx, player_id)) t""")
query("on_court_filter", lambda t: court.on_court_filter(t.tracks, t.positions), ("court_tracks",),
      "SELECT * EXCLUDE (edge) FROM court_tracks")

derive("projected", ("tracks", "calibration_cols"), """
SELECT video_id, frame_idx, player_id, (h0*x+h1*y+h2)/(h6*x+h7*y+h8) AS px, (h3*x+h4*y+h5)/(h6*x+h7*y+h8) AS py
FROM (SELECT video_id, frame_idx, player_id, trunc((x1+x2)/2) AS x, trunc(y2) AS y FROM tracks) p
JOIN calibration_cols c USING (video_id) WHERE frame_idx BETWEEN frame_from AND frame_to""")
query("project_points", lambda t: six(court.project_points(foot_points(t), calibrations(t)), "x", "y"), ("projected",), f"""
SELECT video_id, frame_idx, player_id, {R('greatest(0, least(200, px))', 6)} AS x, {R('greatest(0, least(107, py))', 6)} AS y
FROM projected WHERE px BETWEEN -30 AND CAST(230 AS DOUBLE) AND py BETWEEN -107*CAST(0.15 AS DOUBLE) AND 107*CAST(1.15 AS DOUBLE)""")
query("homography_lookup", lambda t: court.homography_lookup(foot_points(t), calibrations(t)).select(
    "video_id", "frame_idx", "player_id", "frame_from", "frame_to", *[F.col("h")[i].alias(f"h{i}") for i in range(9)]), ("tracks", "calibration_cols"), """
SELECT video_id, frame_idx, player_id, frame_from, frame_to, h0, h1, h2, h3, h4, h5, h6, h7, h8 FROM tracks t JOIN calibration_cols c USING (video_id)
WHERE frame_idx BETWEEN frame_from AND frame_to""")
derive("metric", ("ball", "calibration_cols"), """
SELECT video_id, frame_idx, CASE WHEN ok THEN mx END AS mx, CASE WHEN ok THEN my END AS my FROM (
  SELECT *, mx BETWEEN -5 AND 26 AND my BETWEEN -6 AND 6 AS ok FROM (
    SELECT video_id, frame_idx, (h0*cx+h1*cy+h2)/(h6*cx+h7*cy+h8) AS mx, (h3*cx+h4*cy+h5)/(h6*cx+h7*cy+h8) AS my
    FROM (SELECT video_id, frame_idx, cx/8 AS cx, (cy-50)/8 AS cy FROM ball) b JOIN calibration_cols c USING (video_id)
    WHERE frame_idx BETWEEN frame_from AND frame_to) p) q""")


def small_ball(t: Tables):
    """The ball path scaled down to pitch size."""
    return t.ball.select("video_id", "frame_idx", (F.col("cx") / 8).alias("cx"), ((F.col("cy") - 50) / 8).alias("cy"))


query("pitch_metric", lambda t: six(court.pitch_metric(small_ball(t), calibrations(t)), "mx", "my"), ("metric",),
      f"SELECT video_id, frame_idx, {R('mx', 6)} AS mx, {R('my', 6)} AS my FROM metric")
query("pitch_minimap", lambda t: court.pitch_minimap(
    t.deliveries_raw.select("video_id", "delivery_key", F.col("metric_x").alias("mx"), (F.col("metric_y") * 3).alias("my"))),
    ("deliveries",), """
SELECT video_id, delivery_key, mx, my,
  CASE WHEN px BETWEEN 0 AND 600 AND py BETWEEN 0 AND 320 THEN CAST(trunc(px) AS BIGINT) END AS minimap_x,
  CASE WHEN px BETWEEN 0 AND 600 AND py BETWEEN 0 AND 320 THEN CAST(trunc(py) AS BIGINT) END AS minimap_y
FROM (SELECT *, 120 + mx/CAST(20.12 AS DOUBLE)*360 AS px, 160 + my/CAST(3.05 AS DOUBLE)*80 AS py FROM (
  SELECT video_id, delivery_key, metric_x AS mx, metric_y*3 AS my FROM deliveries) d) e""")
query("pitch_minimap_camera", lambda t: court.pitch_minimap_camera(
    t.ball.select("video_id", "frame_idx", "cx", "cy"), calibrations(t)), ("ball", "calibration_cols"), """
SELECT video_id, frame_idx, CASE WHEN ok THEN CAST(trunc(x) AS BIGINT) END AS minimap_x, CASE WHEN ok THEN CAST(trunc(y) AS BIGINT) END AS minimap_y
FROM (SELECT *, x BETWEEN 0 AND 600 AND y BETWEEN 0 AND 320 AS ok FROM (
  SELECT video_id, frame_idx, (h0*cx+h1*cy+h2)/(h6*cx+h7*cy+h8) AS x, (h3*cx+h4*cy+h5)/(h6*cx+h7*cy+h8) AS y
  FROM ball JOIN calibration_cols c USING (video_id) WHERE frame_idx BETWEEN frame_from AND frame_to) p) q""")
query("pitch_minimap_list", lambda t: court.pitch_minimap_list(
    t.flight.groupBy("video_id", "delivery_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "mx", (F.col("my") * 40).alias("my")))),
                    lambda p: F.struct(p["mx"].alias("mx"), p["my"].alias("my"))).alias("path"))
).select("video_id", "delivery_key", F.transform("path", lambda p: F.concat_ws(
    ",", p["px"].cast("string"), p["py"].cast("string"))).alias("p")).select(
    "video_id", "delivery_key", F.array_join("p", " ").alias("path")), ("flight",), """
SELECT video_id, delivery_key, coalesce(string_agg(CAST(px AS STRING) || ',' || CAST(py AS STRING), ' ' ORDER BY frame_idx), '') AS path FROM (
  SELECT video_id, delivery_key, frame_idx, CASE WHEN ok THEN CAST(trunc(x) AS BIGINT) END AS px, CASE WHEN ok THEN CAST(trunc(y) AS BIGINT) END AS py
  FROM (SELECT *, x BETWEEN 0 AND 600 AND y BETWEEN 0 AND 320 AS ok FROM (
    SELECT video_id, delivery_key, frame_idx, 120 + mx/CAST(20.12 AS DOUBLE)*360 AS x, 160 + my*40/CAST(3.05 AS DOUBLE)*80 AS y FROM flight) f) g) h
GROUP BY video_id, delivery_key""")
query("ground_map", lambda t: court.ground_map(
    t.deliveries_raw.select(
        "video_id", "delivery_key", (F.col("metric_x") * 3 - 5).alias("mx"), (F.col("metric_y") * 40).alias("my"))), ("deliveries",), """
SELECT video_id, delivery_key, mx, my,
  CAST(round_even(CASE WHEN d > 250 THEN 265 + dx/d*250 ELSE px END, 0) AS BIGINT) AS ground_x,
  CAST(round_even(CASE WHEN d > 250 THEN 263 + dy/d*250 ELSE py END, 0) AS BIGINT) AS ground_y
FROM (SELECT *, px-265 AS dx, py-263 AS dy, sqrt((px-265)*(px-265)+(py-263)*(py-263)) AS d FROM (
  SELECT *, CASE WHEN pitch THEN 265 + my*(CAST(24.5 AS DOUBLE)/CAST(1.525 AS DOUBLE)) ELSE 265 + my*(CAST(254 AS DOUBLE)/70) END AS px,
    CASE WHEN pitch THEN 185 + mx/CAST(20.12 AS DOUBLE)*155 ELSE 263 + (mx - CAST(10.06 AS DOUBLE))*(CAST(254 AS DOUBLE)/70) END AS py
  FROM (SELECT *, mx BETWEEN 0 AND CAST(20.12 AS DOUBLE) AND abs(my) <= CAST(1.525 AS DOUBLE) + 0.5 AS pitch FROM (
    SELECT video_id, delivery_key, metric_x*3 - 5 AS mx, metric_y*40 AS my FROM deliveries) a) b) c) d""")
query("px_to_meters", lambda t: court.px_to_meters(t.positions), ("positions",),
      "SELECT *, x*CAST(28 AS DOUBLE)/200 AS x_m, y*CAST(15 AS DOUBLE)/107 AS y_m FROM positions")
query("keyframe_asof", lambda t: court.keyframe_asof(
    t.frames.select("video_id", "frame_idx"), t.keypoint_obs.select("video_id", "frame_idx", "kp_idx", "x", "y")),
    ("frames", "keypoint_obs"), """
SELECT f.video_id, f.frame_idx, f.k AS keyframe_idx, kp_idx, x, y FROM (
  SELECT video_id, frame_idx, CAST(floor(frame_idx/10) AS BIGINT)*10 AS k FROM frames) f
LEFT JOIN keypoint_obs o ON o.video_id = f.video_id AND o.frame_idx = f.k""")

derive("steps", ("positions",), """
SELECT video_id, frame_idx, player_id, CASE WHEN d BETWEEN CAST(0.02 AS DOUBLE) AND 2.5 THEN d ELSE CAST(0 AS DOUBLE) END AS dist_m FROM (
  SELECT *, sqrt(dx*dx+dy*dy) AS d FROM (
    SELECT *, xm - lag(xm) OVER w AS dx, ym - lag(ym) OVER w AS dy FROM (
      SELECT *, x*CAST(28 AS DOUBLE)/200 AS xm, y*CAST(15 AS DOUBLE)/107 AS ym FROM positions) m
    WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_idx)) l) s""")
derive("speeds", ("steps",), f"""
SELECT video_id, frame_idx, player_id, CASE WHEN n >= 5 THEN {R("least(total/(n/CAST(30 AS DOUBLE))*CAST(3.6 AS DOUBLE), 38)", 1)} ELSE CAST(0 AS DOUBLE) END AS speed_kmh
FROM (SELECT *, sum(dist_m) OVER w AS total, count(*) OVER w AS n FROM steps
  WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_idx RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)) s""")
derive("distances", ("steps",), f"SELECT video_id, player_id, {R('sum(dist_m)', 2)} AS total_distance_m FROM steps GROUP BY video_id, player_id")
derive("speed_stat", ("speeds",), f"""
SELECT video_id, player_id, {R('avg(speed_kmh)', 1)} AS avg_speed_kmh, max(speed_kmh) AS max_speed_kmh, count(*) AS samples
FROM speeds WHERE speed_kmh > 0 GROUP BY video_id, player_id""")
derive("team_mode", ("tracks",), """
SELECT video_id, player_id, team, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY votes DESC, first_frame) AS rn FROM (
    SELECT video_id, player_id, team, count(*) AS votes, min(frame_idx) AS first_frame FROM tracks GROUP BY ALL) v) r WHERE rn = 1""")


def player_board(t: Tables):
    """Distance and speed per player with the voted team, best first."""
    from fieldlens.operators.identity import team_vote

    steps = court.player_step_distance(t.positions)
    stats = court.player_distance(steps).join(court.speed_stats(court.player_speed(steps)), court.PLAYER, "left")
    stats = stats.join(team_vote(t.tracks).select(*court.PLAYER, "team"), court.PLAYER)
    return court.leaderboard(stats.fillna(0, ["avg_speed_kmh", "max_speed_kmh", "samples"]))


query("player_step_distance", lambda t: six(court.player_step_distance(t.positions), "dist_m"), ("steps",),
      f"SELECT video_id, frame_idx, player_id, {R('dist_m', 6)} AS dist_m FROM steps")
query("player_speed", lambda t: court.player_speed(court.player_step_distance(t.positions)), ("speeds",), "SELECT * FROM speeds")
query("player_distance", lambda t: court.player_distance(court.player_step_distance(t.positions)), ("distances",), "SELECT * FROM distances")
query("speed_stats", lambda t: court.speed_stats(court.player_speed(court.player_step_distance(t.positions))),
      ("speed_stat",), "SELECT * FROM speed_stat")
query("leaderboard", player_board, ("distances", "speed_stat", "team_mode"), """
SELECT video_id, player_id, total_distance_m, coalesce(avg_speed_kmh, 0) AS avg_speed_kmh, coalesce(max_speed_kmh, 0) AS max_speed_kmh,
  coalesce(samples, 0) AS samples, team
FROM distances LEFT JOIN speed_stat USING (video_id, player_id) JOIN team_mode USING (video_id, player_id) WHERE team IN (1, 2)""")

_FOLD = "list_reduce(list({c}) OVER (PARTITION BY {keys} ORDER BY frame_idx), lambda a, b: CAST({a} AS DOUBLE)*b + CAST({k} AS DOUBLE)*a)"


def _fold(c, keys, a, k):
    return R(_FOLD.format(c=c, keys=keys, a=a, k=k), 6)


query("ema_positions", lambda t: six(court.ema_positions(t.positions), "x", "y"), ("positions",), f"""
SELECT video_id, frame_idx, player_id, {_fold('x', 'video_id, player_id', 0.6, 0.4)} AS x, {_fold('y', 'video_id, player_id', 0.6, 0.4)} AS y FROM positions""")
derive("presence", ("positions",), """
SELECT *, sum(brk) OVER (PARTITION BY video_id, player_id ORDER BY frame_idx) AS island FROM (
  SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, player_id ORDER BY frame_idx) = 1 THEN 0 ELSE 1 END AS brk FROM positions) p""")
query("minimap_smoothing", lambda t: six(court.minimap_smoothing(t.positions), "x", "y"), ("presence",), f"""
SELECT video_id, frame_idx, player_id, {_fold('x', 'video_id, player_id, island', 0.2, 0.8)} AS x, {_fold('y', 'video_id, player_id, island', 0.2, 0.8)} AS y FROM presence""")
_BOX = ("x1", "y1", "x2", "y2")
# the test ball is lost for 20 frames at most, so a shorter coast is asked for too
for _name, _coast in (("ball_ema", 10), ("ball_ema_default", 30)):
    derive(f"{_name}_runs", ("ball",), f"""
SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM (
  SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) <= {_coast + 1} THEN 0 ELSE 1 END AS brk FROM ball) p""")
    derive(f"{_name}_smooth", (f"{_name}_runs",), f"""
SELECT video_id, frame_idx, conf, {', '.join(f"{_fold(c, 'video_id, island', 0.5, 0.5)} AS {c}" for c in _BOX)} FROM {_name}_runs""")
    query(_name, lambda t, coast=_coast: six(court.ball_ema(t.ball, t.frames, max_coast=coast), *_BOX), (f"{_name}_smooth", "frames"), f"""
SELECT video_id, frame_idx, {', '.join(f'l{c} AS {c}' for c in _BOX)}, coalesce(conf, 0.5) AS conf, conf IS NULL AS is_coasting FROM (
  SELECT f.video_id, f.frame_idx, b.conf, {', '.join(f'last_value(b.{c} IGNORE NULLS) OVER w AS l{c}' for c in _BOX)}, last_value(b.frame_idx IGNORE NULLS) OVER w AS lf
  FROM frames f LEFT JOIN {_name}_smooth b ON b.video_id = f.video_id AND b.frame_idx = f.frame_idx
  WINDOW w AS (PARTITION BY f.video_id ORDER BY f.frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) h WHERE frame_idx - lf <= {_coast}""")


def _filled(batch):
    """Filled positions in batches of so many frames."""
    return f"""
SELECT video_id, frame_idx, player_id,
  {R('CASE WHEN fb > fa THEN (1-(frame_idx-fa)/(fb-fa))*xa + (frame_idx-fa)/(fb-fa)*xb ELSE coalesce(xa, xb) END', 6)} AS x,
  {R('CASE WHEN fb > fa THEN (1-(frame_idx-fa)/(fb-fa))*ya + (frame_idx-fa)/(fb-fa)*yb ELSE coalesce(ya, yb) END', 6)} AS y
FROM (SELECT video_id, frame_idx, player_id,
    CAST(last_value(f IGNORE NULLS) OVER p AS DOUBLE) AS fa, last_value(x IGNORE NULLS) OVER p AS xa, last_value(y IGNORE NULLS) OVER p AS ya,
    CAST(first_value(f IGNORE NULLS) OVER n AS DOUBLE) AS fb, first_value(x IGNORE NULLS) OVER n AS xb, first_value(y IGNORE NULLS) OVER n AS yb
  FROM (SELECT s.video_id, s.k, s.frame_idx, s.player_id, p.frame_idx AS f, p.x, p.y
    FROM (SELECT f.video_id, k, f.frame_idx, player_id FROM (SELECT *, frame_idx//{batch} AS k FROM frames) f
      JOIN (SELECT DISTINCT video_id, player_id, frame_idx//{batch} AS k FROM positions) d USING (video_id, k)) s
    LEFT JOIN positions p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx AND p.player_id = s.player_id) j
  WINDOW p AS (PARTITION BY video_id, k, player_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY video_id, k, player_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) w"""


query("fill_positions", lambda t: six(court.fill_positions(t.positions, t.frames), "x", "y"), ("positions", "frames"), _filled(250))
query("fill_positions_short", lambda t: six(court.fill_positions(t.positions, t.frames, batch_size=20), "x", "y"), ("positions", "frames"), _filled(20))
query("fill_positions_whole", lambda t: six(court.fill_positions(t.positions, t.frames, batch_size=None), "x", "y"), ("positions", "frames"), _filled(1 << 40))

derive("heat_points", ("positions", "tracks"), """
SELECT p.video_id, p.frame_idx, p.player_id, p.x, p.y, t.team FROM positions p LEFT JOIN tracks t USING (video_id, frame_idx, player_id)
WHERE p.x BETWEEN 1 AND 199 AND p.y BETWEEN 1 AND 106 AND NOT coalesce(t.is_sideline, false) AND coalesce(t.team, -1) <> 0""")
query("heatmap_point_filter", lambda t: court.heatmap_point_filter(t.positions, t.tracks), ("heat_points",), "SELECT * FROM heat_points")


# possession
derive("candidates", ("reachable",), """
SELECT video_id, frame_idx, coalesce(CAST(player_id AS BIGINT), -1) AS candidate FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY tier NULLS LAST, score, player_id) AS rn FROM (
    SELECT video_id, frame_idx, CASE WHEN inside > CAST(0.8 AS DOUBLE) OR reach < 120 THEN player_id END AS player_id,
      CASE WHEN inside > CAST(0.8 AS DOUBLE) THEN 0 WHEN reach < 120 THEN 1 END AS tier,
      CASE WHEN inside > CAST(0.8 AS DOUBLE) THEN -inside ELSE reach END AS score
    FROM (SELECT video_id, frame_idx, player_id,
        CASE WHEN least(x2,bx2) < greatest(x1,bx1) OR least(y2,by2) < greatest(y1,by1) THEN CAST(0 AS DOUBLE)
          ELSE (least(x2,bx2)-greatest(x1,bx1))*(least(y2,by2)-greatest(y1,by1))/((bx2-bx1)*(by2-by1)) END AS inside,
        reach
      FROM reachable) c) s) r WHERE rn = 1""")


def _d(x, y):
    return f"sqrt((qx-({x}))*(qx-({x}))+(qy-({y}))*(qy-({y})))"


_ANCHORS = [("x1+(x2-x1)/2", "y1"), ("x2", "y1"), ("x1", "y1"), ("x2", "y1+(y2-y1)/2"), ("x1", "y1+(y2-y1)/2"),
            ("x1+(x2-x1)/2", "y1+(y2-y1)/2"), ("x2", "y2"), ("x1", "y2"), ("x1+(x2-x1)/2", "y2"), ("x1+(x2-x1)/2", "y1+(y2-y1)/3")]
derive("reachable", ("tracks", "ball"), f"""
SELECT b.*, player_id, x1, y1, x2, y2, least({', '.join(_d(x, y) for x, y in _ANCHORS)},
  CASE WHEN y1 < qy AND qy < y2 THEN least(abs(qx-x1), abs(qx-x2)) ELSE CAST(1e9 AS DOUBLE) END,
  CASE WHEN x1 < qx AND qx < x2 THEN least(abs(qy-y1), abs(qy-y2)) ELSE CAST(1e9 AS DOUBLE) END) AS reach
FROM (SELECT video_id, frame_idx, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2, (x1+x2)/2 AS qx, (y1+y2)/2 AS qy FROM ball) b
LEFT JOIN (SELECT video_id, frame_idx, player_id, x1, y1, x2, y2 FROM tracks) t USING (video_id, frame_idx)""")
query("holder_candidates", lambda t: poss.holder_candidates(t.tracks, t.ball), ("candidates",), "SELECT * FROM candidates")

_N = {i: " + ".join(f"CAST(c{i} = c{j} AS INT)" for j in range(5)) for i in range(5)}
derive("confirms", ("candidates", "frames"), f"""
SELECT f.video_id, f.frame_idx, rn IS NOT NULL AS has_ball, coalesce(rn >= 5, false) AS is_full,
  CASE WHEN rn >= 5 AND best >= 20 AND who <> -1 THEN who END AS sure
FROM frames f LEFT JOIN (
  SELECT *, CASE best % 10 WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS who FROM (
    SELECT *, greatest({', '.join(f"({_N[i]})*10 + {i}" for i in range(5))}) AS best FROM (
      SELECT video_id, frame_idx, row_number() OVER w AS rn, {', '.join(f"lag(candidate, {i}) OVER w AS c{i}" for i in range(5))}
      FROM candidates WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)) a) b) c USING (video_id, frame_idx)""")
derive("poss", ("confirms",), """
SELECT video_id, frame_idx, CAST(CASE WHEN hold IS NULL THEN -1 WHEN has_ball OR misses < 3 THEN hold ELSE -1 END AS BIGINT) AS holder_id FROM (
  SELECT *, last_value(sure IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx) AS hold,
    coalesce(sum(CASE WHEN NOT has_ball OR (is_full AND sure IS NULL) THEN 1 ELSE 0 END) OVER (
      PARTITION BY video_id, grp ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS misses FROM (
    SELECT *, count(sure) OVER (PARTITION BY video_id ORDER BY frame_idx) AS grp FROM confirms) g) h""")


def holders(t: Tables):
    return poss.possession(poss.holder_candidates(t.tracks, t.ball), t.frames)


query("possession", holders, ("poss",), "SELECT * FROM poss")
derive("holder_team", ("poss", "tracks"), """
SELECT p.video_id, p.frame_idx, p.holder_id, CAST(coalesce(t.team, -1) AS INT) AS team FROM poss p
LEFT JOIN tracks t ON t.video_id = p.video_id AND t.frame_idx = p.frame_idx AND t.player_id = p.holder_id""")
query("team_of_holder", lambda t: poss.team_of_holder(holders(t), t.tracks), ("holder_team",), "SELECT * FROM holder_team")
derive("pass_events", ("holder_team",), """
SELECT a.video_id, a.frame_idx, CAST(CASE WHEN a.holder_id <> -1 AND b.holder_id <> -1 AND a.holder_id <> b.holder_id AND a.team <> -1 AND a.team = b.team
  THEN a.team ELSE 0 END AS INT) AS pass_team
FROM holder_team a LEFT JOIN holder_team b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx - 1""")
query("passes", lambda t: poss.passes(holders(t), t.tracks), ("pass_events",), "SELECT * FROM pass_events")
derive("steal_events", ("holder_team",), """
SELECT video_id, frame_idx, CAST(CASE WHEN frame_idx >= 1 AND holder_id <> -1 AND ph <> holder_id AND team <> -1 AND pt <> -1 AND pt <> team
  THEN team ELSE 0 END AS INT) AS interception_team FROM (
  SELECT *, last_value(CASE WHEN holder_id <> -1 AND frame_idx >= 1 THEN holder_id END IGNORE NULLS) OVER w AS ph,
    last_value(CASE WHEN holder_id <> -1 AND frame_idx >= 1 THEN team END IGNORE NULLS) OVER w AS pt
  FROM holder_team WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s""")
query("interceptions", lambda t: poss.interceptions(holders(t), t.tracks), ("steal_events",), "SELECT * FROM steal_events")
derive("poss_team0", ("poss", "tracks"), """
SELECT p.video_id, p.frame_idx, p.holder_id, coalesce(t.team, 0) AS team FROM poss p
LEFT JOIN tracks t ON t.video_id = p.video_id AND t.frame_idx = p.frame_idx AND t.player_id = p.holder_id""")
query("possession_summary", lambda t: poss.possession_summary(holders(t), t.tracks), ("poss_team0",), f"""
SELECT *, CASE WHEN team1_frames+team2_frames > 0 THEN {R('team1_frames/(team1_frames+team2_frames)*100', 1)} ELSE CAST(0 AS DOUBLE) END AS team1_pct,
  CASE WHEN team1_frames+team2_frames > 0 THEN {R('team2_frames/(team1_frames+team2_frames)*100', 1)} ELSE CAST(0 AS DOUBLE) END AS team2_pct
FROM (SELECT video_id, count(*) FILTER (team = 1) AS team1_frames, count(*) FILTER (team = 2) AS team2_frames FROM poss_team0 WHERE holder_id <> -1 GROUP BY video_id) s""")
query("possession_running", lambda t: poss.possession_running(holders(t), t.tracks), ("poss_team0",), """
SELECT video_id, frame_idx, CAST(sum(CASE WHEN holder_id <> -1 AND team = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS team1_frames,
  CAST(sum(CASE WHEN holder_id <> -1 AND team = 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS team2_frames
FROM poss_team0 WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)""")
query("pass_summary", lambda t: poss.pass_summary(poss.ball_moves(holders(t), t.tracks)),
      ("pass_events", "steal_events"), """
SELECT video_id, count(*) FILTER (pass_team = 1) AS team1_passes, count(*) FILTER (pass_team = 2) AS team2_passes,
  count(*) FILTER (interception_team = 1) AS team1_interceptions, count(*) FILTER (interception_team = 2) AS team2_interceptions
FROM (SELECT video_id, pass_team, 0 AS interception_team FROM pass_events UNION ALL SELECT video_id, 0, interception_team FROM steal_events) u GROUP BY video_id""")
