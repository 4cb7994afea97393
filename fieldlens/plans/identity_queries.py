"""Identity and space queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import court, identity as ident, space
from fieldlens.plans import reports
from fieldlens.plans.court_queries import six
from fieldlens.plans.registry import Tables, derive, query, rounded as R

query("team_vote", lambda t: ident.team_vote(t.tracks), ("team_mode",), "SELECT * FROM team_mode")
derive("officials", ("tracks", "team_mode"), """
SELECT s.*, m.team, m.team = 0 OR official_frames/frames >= 0.25 AS is_official FROM (
  SELECT video_id, player_id, count(*) AS frames, count(*) FILTER (is_referee OR is_sideline OR team = 0) AS official_frames
  FROM tracks GROUP BY video_id, player_id) s JOIN team_mode m USING (video_id, player_id)""")
query("official_filter", lambda t: ident.official_filter(t.tracks), ("officials",), "SELECT * FROM officials")
derive("jersey_mode", ("tracks",), """
SELECT video_id, player_id, jersey, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY votes DESC, first_frame) AS rn FROM (
    SELECT video_id, player_id, trim(jersey) AS jersey, count(*) AS votes, min(frame_idx) AS first_frame
    FROM tracks WHERE regexp_full_match(trim(jersey), '[0-9]+') GROUP BY ALL) v) r WHERE rn = 1""")
query("jersey_vote", lambda t: ident.jersey_vote(t.tracks), ("jersey_mode",), "SELECT * FROM jersey_mode")


derive("stats", ("officials", "steps", "speeds", "jersey_mode"), """
SELECT o.video_id, o.player_id, o.team, o.frames, coalesce(d.dist_m, 0) AS dist_m, coalesce(s.speed_sum, 0) AS speed_sum,
  coalesce(s.speed_samples, 0) AS speed_samples, coalesce(s.max_speed, 0) AS max_speed, j.jersey, j.votes AS jersey_votes
FROM officials o LEFT JOIN (SELECT video_id, player_id, sum(dist_m) AS dist_m FROM steps GROUP BY ALL) d USING (video_id, player_id)
LEFT JOIN (SELECT video_id, player_id, sum(speed_kmh) AS speed_sum, count(*) AS speed_samples, max(speed_kmh) AS max_speed
  FROM speeds WHERE speed_kmh > 0 GROUP BY ALL) s USING (video_id, player_id)
LEFT JOIN jersey_mode j USING (video_id, player_id) WHERE NOT is_official AND o.team IN (1, 2)
  AND NOT (o.frames < 10 AND coalesce(d.dist_m, 0) < 1 AND coalesce(s.speed_samples, 0) < 5)""")


def short_stats(t: Tables):
    """Stats of track pieces: each player's track cut every 24 frames."""
    cut = t.tracks.withColumn("player_id", F.col("player_id") * 10 + F.floor(F.col("frame_idx") / 24).cast("bigint"))
    moved = t.positions.withColumn("player_id", F.col("player_id") * 10 + F.floor(F.col("frame_idx") / 24).cast("bigint"))
    steps = court.player_step_distance(moved)
    fast = court.player_speed(steps).filter("speed_kmh > 0").groupBy(*ident.PLAYER).agg(F.count("*").alias("speed_samples"))
    stats = cut.groupBy(*ident.PLAYER).agg(F.count("*").alias("frames")).join(
        steps.groupBy(*ident.PLAYER).agg(F.sum("dist_m").alias("dist_m")), ident.PLAYER, "left")
    return stats.join(fast, ident.PLAYER, "left").fillna(0)


derive("cut_positions", ("positions",), "SELECT * REPLACE (player_id*10 + CAST(floor(frame_idx/24) AS BIGINT) AS player_id) FROM positions")
query("ghost_filter", lambda t: six(ident.ghost_filter(short_stats(t)), "dist_m"), ("cut_positions", "tracks"), f"""
SELECT video_id, player_id, frames, {R('dist_m', 6)} AS dist_m, speed_samples FROM (
  SELECT video_id, player_id, count(*) AS frames, sum(dist_m) AS dist_m, count(*) FILTER (speed > 0) AS speed_samples FROM (
    SELECT *, CASE WHEN count(*) OVER w >= 5 THEN {R('least(sum(dist_m) OVER w/(count(*) OVER w/CAST(30 AS DOUBLE))*CAST(3.6 AS DOUBLE), 38)', 1)} ELSE 0 END AS speed FROM (
      SELECT video_id, frame_idx, player_id, CASE WHEN d BETWEEN CAST(0.02 AS DOUBLE) AND 2.5 THEN d ELSE CAST(0 AS DOUBLE) END AS dist_m FROM (
        SELECT *, sqrt(dx*dx+dy*dy) AS d FROM (
          SELECT *, xm - lag(xm) OVER w AS dx, ym - lag(ym) OVER w AS dy FROM (
            SELECT *, x*CAST(28 AS DOUBLE)/200 AS xm, y*CAST(15 AS DOUBLE)/107 AS ym FROM cut_positions) m
          WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_idx)) l) s) q
    WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_idx RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)) z GROUP BY ALL) g
WHERE NOT (frames < 10 AND dist_m < 1 AND speed_samples < 5)""")


def voted_tracks(t: Tables):
    voted = ident.team_vote(t.tracklets).select(*ident.PLAYER, "team").join(
        ident.jersey_vote(t.tracklets).select(*ident.PLAYER, "jersey"), ident.PLAYER)
    return t.tracklets.select("video_id", "frame_idx", "player_id").join(voted, ident.PLAYER)


derive("overlap", ("tracks", "team_mode", "jersey_mode"), """
WITH v AS (SELECT t.video_id, t.frame_idx, t.player_id, m.team, j.jersey FROM tracks t JOIN team_mode m USING (video_id, player_id)
  JOIN jersey_mode j USING (video_id, player_id))
SELECT a.video_id, a.team, a.jersey, a.player_id AS player_a, b.player_id AS player_b, count(*) AS common_frames, count(*) > 10 AS conflict
FROM v a JOIN v b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.team = b.team AND a.jersey = b.jersey AND a.player_id < b.player_id
GROUP BY ALL""")
CUT = {"tracks": "tracklets", "positions": "tracklet_positions"}
query("overlap_tracks", lambda t: ident.overlap_tracks(voted_tracks(t)), ("overlap",), "SELECT * FROM overlap", CUT)


# the greedy choice as a recursion over the tracks of one jersey in order of votes
derive("grouped", ("stats", "overlap"), """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY video_id, team, jersey ORDER BY jersey_votes DESC, player_id) AS k
    FROM stats WHERE jersey IS NOT NULL),
  clash AS (SELECT video_id, player_a AS p, player_b AS o FROM overlap WHERE common_frames > 10
    UNION ALL SELECT video_id, player_b, player_a FROM overlap WHERE common_frames > 10),
  rivals AS (SELECT video_id, p, list(o) AS os FROM clash GROUP BY ALL),
  rr AS (SELECT r.*, coalesce(os, []) AS os FROM r LEFT JOIN rivals v ON v.video_id = r.video_id AND v.p = r.player_id),
  walk AS (
    SELECT video_id, team, jersey, k, [player_id] AS members FROM rr WHERE k = 1
    UNION ALL
    SELECT w.video_id, w.team, w.jersey, rr.k, CASE WHEN list_has_any(w.members, rr.os) THEN w.members ELSE list_append(w.members, rr.player_id) END
    FROM walk w JOIN rr ON rr.video_id = w.video_id AND rr.team = w.team AND rr.jersey = w.jersey AND rr.k = w.k + 1)
SELECT video_id, unnest(members) AS player_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, team, jersey ORDER BY k DESC) AS z FROM walk) w WHERE z = 1""")
derive("players", ("stats", "grouped"), f"""
SELECT video_id, arg_min(player_id, -frames*1000000 + player_id) AS player_id, team, jersey_number, list_sort(list(player_id)) AS track_ids,
  CASE WHEN jersey_number IS NOT NULL THEN '#' || jersey_number ELSE 'Track #' || CAST(arg_min(player_id, -frames*1000000 + player_id) AS STRING) END AS display_label,
  {R('sum(dist_m)', 1)} AS total_distance_m,
  CASE WHEN sum(speed_samples) > 0 THEN {R('sum(speed_sum)/sum(speed_samples)', 1)} ELSE CAST(0 AS DOUBLE) END AS avg_speed_kmh,
  CASE WHEN sum(speed_samples) > 0 THEN {R('max(max_speed)', 1)} ELSE CAST(0 AS DOUBLE) END AS max_speed_kmh
FROM (SELECT s.*, CASE WHEN g.player_id IS NOT NULL THEN jersey END AS jersey_number, CASE WHEN g.player_id IS NULL THEN s.player_id END AS alone
  FROM stats s LEFT JOIN grouped g ON g.video_id = s.video_id AND g.player_id = s.player_id) j GROUP BY video_id, team, jersey_number, alone""")
query("consolidate_players", lambda t: reports.report_players(t.tracklets, t.tracklet_positions), ("players",), "SELECT * FROM players", CUT)


def all_tracks(t: Tables):
    steps = court.player_step_distance(t.positions)
    return ident.union_all_tracks(ident.team_vote(t.tracks), court.player_distance(steps), court.speed_stats(court.player_speed(steps)))


query("union_all_tracks", all_tracks, ("team_mode", "distances", "speed_stat"), """
SELECT video_id, player_id FROM team_mode UNION SELECT video_id, player_id FROM distances UNION SELECT video_id, player_id FROM speed_stat""")
derive("ref_matches", ("tracks", "detections"), """
SELECT video_id, frame_idx, det_id, player_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, det_id ORDER BY d2, player_id) AS rn FROM (
    SELECT d.video_id, d.frame_idx, d.det_id, t.player_id,
      ((t.x1+t.x2)/2-(d.x1+d.x2)/2)*((t.x1+t.x2)/2-(d.x1+d.x2)/2)+((t.y1+t.y2)/2-(d.y1+d.y2)/2)*((t.y1+t.y2)/2-(d.y1+d.y2)/2) AS d2
    FROM detections d JOIN tracks t USING (video_id, frame_idx) WHERE cls = 'referee' AND d.conf >= CAST(0.35 AS DOUBLE)) p) r
WHERE rn = 1 AND d2 < (1280*CAST(0.015 AS DOUBLE))*(1280*CAST(0.015 AS DOUBLE))""")
query("referee_match", lambda t: ident.referee_match(t.tracks, t.detections, t.frames), ("ref_matches",), """
SELECT *, vote_no >= 3 AS is_referee FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_idx, det_id) AS vote_no FROM ref_matches) m""")
query("referee_tracks", lambda t: ident.referee_tracks(t.tracks, ident.referee_match(t.tracks, t.detections, t.frames), batch_size=25), ("tracks", "ref_matches"), """
SELECT t.* REPLACE (is_referee OR coalesce(frame_idx >= CAST(floor(f/25) AS BIGINT)*25, false) AS is_referee) FROM tracks t LEFT JOIN (
  SELECT video_id, player_id, min(frame_idx) AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_idx, det_id) AS vote_no FROM ref_matches) m WHERE vote_no >= 3 GROUP BY ALL) d USING (video_id, player_id)""".replace("t.* REPLACE", "* EXCLUDE (f) REPLACE"))
query("running_team_votes", lambda t: ident.running_team_votes(t.team_votes), ("team_votes",), """
SELECT *, CAST(CASE WHEN votes_1 >= votes_2 THEN 1 ELSE 2 END AS INT) AS current_team FROM (
  SELECT video_id, frame_idx, player_id, CAST(sum(CASE WHEN (n-1)%5 = 0 AND team = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS votes_1,
    CAST(sum(CASE WHEN (n-1)%5 = 0 AND team = 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS votes_2
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_idx) AS n FROM team_votes) v
  WINDOW w AS (PARTITION BY video_id, player_id ORDER BY frame_idx)) c""")
_ROLES = """
SELECT video_id, player_id, role, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY votes DESC, first_batch, role) AS rn FROM (
    SELECT video_id, player_id, role, CAST(sum(n) AS BIGINT) AS votes, min(batch) AS first_batch FROM (
      SELECT *, CASE WHEN players = 1 OR dn = 2 THEN 'batsman' WHEN dn = 1 THEN 'wicketkeeper'
        WHEN up = min(CASE WHEN dn > 2 THEN up END) OVER (PARTITION BY video_id, batch) THEN 'bowler' END AS role FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, batch ORDER BY med DESC, player_id) AS dn,
          row_number() OVER (PARTITION BY video_id, batch ORDER BY med, player_id) AS up, count(*) OVER (PARTITION BY video_id, batch) AS players
        FROM (SELECT video_id, CAST(floor(frame_idx/25) AS BIGINT) AS batch, player_id, median(y2) AS med, count(*) AS n
          FROM tracks GROUP BY ALL) m) k) c WHERE role IS NOT NULL GROUP BY ALL) v) r WHERE rn = 1"""
query("role_votes", lambda t: ident.role_votes(t.tracks), ("tracks",), _ROLES.replace("/25", "/250"))
query("role_votes_short", lambda t: ident.role_votes(t.tracks, batch=25), ("tracks",), _ROLES)


def _ocr(table, most):
    """Jersey and lock after each of the first ``most`` attempts."""
    return f"""
WITH tries AS (SELECT video_id, player_id, frame_idx, text, prob, CAST((n-1)/5 AS INT) + 1 AS attempt FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, player_id ORDER BY frame_idx) AS n FROM {table}) r WHERE (n-1)%5 = 0 AND n <= {5 * most}),
  scores AS (SELECT a.video_id, a.player_id, a.frame_idx, a.attempt, b.text, {R('sum(b.prob)', 9)} AS score, min(b.attempt) AS fst
    FROM tries a JOIN tries b ON a.video_id = b.video_id AND a.player_id = b.player_id AND b.attempt <= a.attempt
    WHERE b.prob > CAST(0.35 AS DOUBLE) AND regexp_full_match(trim(b.text), '[0-9]{{1,2}}') GROUP BY ALL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, player_id, attempt ORDER BY score DESC, fst, text DESC) AS rn
    FROM scores WHERE score >= CAST(0.8 AS DOUBLE)) s WHERE rn = 1),
  state AS (SELECT t.video_id, t.player_id, t.frame_idx, t.attempt, b.text, first_value(CASE WHEN score >= 1.5 THEN b.text END IGNORE NULLS) OVER (
    PARTITION BY t.video_id, t.player_id ORDER BY t.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lockd
    FROM tries t LEFT JOIN best b USING (video_id, player_id, attempt))
SELECT video_id, player_id, frame_idx, attempt, coalesce(lockd, text) AS jersey, lockd IS NOT NULL AS locked FROM state"""


derive("ocr_state", ("readings",), _ocr("readings", 10))
derive("ocr_all", ("readings",), _ocr("readings", 1 << 30))
derive("player_readings", ("readings", "tracks"), """
SELECT r.* FROM readings r ANTI JOIN (SELECT * FROM tracks WHERE team = 0 OR is_referee OR is_sideline) t USING (video_id, frame_idx, player_id)""")
derive("ocr_players", ("player_readings",), _ocr("player_readings", 10))
query("jersey_ocr_votes", lambda t: ident.jersey_ocr_votes(t.readings), ("ocr_state",), "SELECT * FROM ocr_state")
query("jersey_ocr_votes_all", lambda t: ident.jersey_ocr_votes(t.readings, attempts=None), ("ocr_all",), "SELECT * FROM ocr_all")
query("jersey_ocr_votes_players", lambda t: ident.jersey_ocr_votes(
    t.readings, officials=t.tracks.filter("team = 0 OR is_referee OR is_sideline")), ("ocr_players",), "SELECT * FROM ocr_players")
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]-p[2])*(p[1]-p[2])))"
derive("colors", ("samples",), "SELECT video_id, player_id, sample_id, CAST(features AS DOUBLE[]) AS f FROM samples")
derive("color_start", ("colors",), f"""
WITH m AS (SELECT video_id, list(v ORDER BY d) AS m FROM (SELECT video_id, d, avg(f[d]) AS v FROM (SELECT video_id, f, unnest(range(1, len(f)+1)) AS d FROM colors) u GROUP BY ALL) a GROUP BY video_id),
  a AS (SELECT video_id, f AS c1 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_D2.format(a='f', b='m')} DESC, sample_id) AS rn FROM colors JOIN m USING (video_id)) r WHERE rn = 1)
SELECT video_id, c1, f AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_D2.format(a='f', b='c1')} DESC, sample_id) AS rn FROM colors JOIN a USING (video_id)) r WHERE rn = 1""")
derive("color_walk", ("colors", "color_start"), f"""
WITH RECURSIVE walk AS (SELECT video_id, 0 AS it, c1, c2, true AS moved FROM color_start
  UNION ALL SELECT video_id, it + 1, list(n1 ORDER BY d), list(n2 ORDER BY d), sum((n1-o1)*(n1-o1) + (n2-o2)*(n2-o2)) > 1e-12 FROM (
    SELECT video_id, it, d, coalesce(avg(f[d]) FILTER (t1), min(c1[d])) AS n1, coalesce(avg(f[d]) FILTER (NOT t1), min(c2[d])) AS n2, min(c1[d]) AS o1, min(c2[d]) AS o2 FROM (
      SELECT *, unnest(range(1, len(f)+1)) AS d FROM (
        SELECT w.video_id, w.it, w.c1, w.c2, s.f, {_D2.format(a='s.f', b='w.c1')} < {_D2.format(a='s.f', b='w.c2')} AS t1 FROM walk w JOIN colors s ON s.video_id = w.video_id WHERE w.moved) j) u
    GROUP BY video_id, it, d) g GROUP BY video_id, it)
SELECT video_id, least(c1, c2) AS c1, greatest(c1, c2) AS c2 FROM walk WHERE NOT moved""")
query("team_colors", lambda t: ident.team_colors(t.samples), ("colors", "color_walk"), f"""
SELECT *, CAST(CASE WHEN votes_1 >= votes_2 THEN 1 ELSE 2 END AS INT) AS team FROM (
  SELECT video_id, player_id, count(*) FILTER (t1) AS votes_1, count(*) FILTER (NOT t1) AS votes_2 FROM (
    SELECT s.video_id, player_id, {_D2.format(a='f', b='c1')} < {_D2.format(a='f', b='c2')} AS t1 FROM colors s JOIN color_walk w ON w.video_id = s.video_id) a GROUP BY ALL) b""")
query("team_colors_projected", lambda t: ident.team_colors(t.samples, components=2))
query("ball_select", lambda t: ident.ball_select(t.detections), ("detections",), """
SELECT video_id, frame_idx, det_id, x1, y1, x2, y2, conf FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, det_id) AS rn FROM detections WHERE cls = 'ball' AND conf > 0) r WHERE rn = 1""")

derive("spots", ("positions", "tracks"), """
SELECT p.video_id, p.frame_idx, p.player_id, p.x, p.y, t.team FROM positions p JOIN tracks t USING (video_id, frame_idx, player_id)
WHERE t.team IN (1, 2) AND p.x BETWEEN 0 AND 200 AND p.y BETWEEN 0 AND 107""")
derive("control", ("spots", "positions"), f"""
WITH cells AS (SELECT unnest(range(0, 200, 2)) AS gx), rows_ AS (SELECT unnest(range(0, 107, 2)) AS gy),
  nearest AS (SELECT video_id, frame_idx, gx, gy, arg_min(team, ((gx-x)*(gx-x)+(gy-y)*(gy-y))*16 + player_id) AS team
    FROM spots, cells, rows_ GROUP BY video_id, frame_idx, gx, gy),
  counts AS (SELECT video_id, frame_idx, count(*) FILTER (team = 1) AS n1, count(*) AS n FROM nearest GROUP BY ALL),
  crowd AS (SELECT video_id, frame_idx, count(*) AS players FROM spots GROUP BY ALL)
SELECT f.video_id, f.frame_idx, CASE WHEN players >= 2 THEN {R('n1/n*CAST(100 AS DOUBLE)', 1)} ELSE CAST(50 AS DOUBLE) END AS team1_pct,
  CASE WHEN players >= 2 THEN {R('(n-n1)/n*CAST(100 AS DOUBLE)', 1)} ELSE CAST(50 AS DOUBLE) END AS team2_pct, coalesce(players >= 2, false) AS sampled
FROM (SELECT DISTINCT video_id, frame_idx FROM positions) f LEFT JOIN counts USING (video_id, frame_idx) LEFT JOIN crowd USING (video_id, frame_idx)""")
query("voronoi_control", lambda t: space.voronoi_control(t.positions, t.tracks), ("control",), """
SELECT *, CAST(CASE WHEN team1_pct > team2_pct THEN 1 WHEN team2_pct > team1_pct THEN 2 ELSE 0 END AS INT) AS dominant_team FROM control""")
query("match_dominance", lambda t: space.match_dominance(space.voronoi_control(t.positions, t.tracks)), ("control",), f"""
SELECT video_id, coalesce({R('avg(team1_pct) FILTER (sampled)', 1)}, 50) AS team1_avg_dominance_pct,
  coalesce({R('avg(team2_pct) FILTER (sampled)', 1)}, 50) AS team2_avg_dominance_pct FROM control GROUP BY video_id""")
# an edge of the hull has every other point on its left, or on it
derive("hull_edges", ("spots",), """
SELECT video_id, frame_idx, team, sum(px*qy - py*qx) AS twice FROM (
  SELECT p.video_id, p.frame_idx, p.team, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p
  JOIN pts q ON p.video_id = q.video_id AND p.frame_idx = q.frame_idx AND p.team = q.team AND (p.x <> q.x OR p.y <> q.y)
  JOIN pts r ON p.video_id = r.video_id AND p.frame_idx = r.frame_idx AND p.team = r.team
  GROUP BY ALL HAVING bool_and((q.x-p.x)*(r.y-p.y) - (q.y-p.y)*(r.x-p.x) > 0 OR ((q.x-p.x)*(r.y-p.y) - (q.y-p.y)*(r.x-p.x) = 0
    AND (r.x-p.x)*(r.x-q.x) + (r.y-p.y)*(r.y-q.y) <= 0))) e GROUP BY ALL""".replace("pts", "(SELECT DISTINCT video_id, frame_idx, team, x, y FROM spots)"))
query("hull_area", lambda t: space.hull_area(t.positions, t.tracks), ("hull_edges",), f"""
SELECT video_id, frame_idx, team, {R('coalesce(twice, 0)/2*(CAST(28 AS DOUBLE)/200)*(CAST(15 AS DOUBLE)/107)', 1)} AS hull_area_m2
FROM (SELECT DISTINCT video_id, frame_idx, team FROM spots) g LEFT JOIN hull_edges e USING (video_id, frame_idx, team)""")


# ---- heatmaps leave out people who hardly move, judged by the merged player
derive("heat_cells", ("heat_points", "players", "team_mode", "videos"), """
SELECT video_id, player_id, px AS cell_x, py AS cell_y, team FROM (
  SELECT p.video_id, p.player_id, CAST(trunc(p.x/200*2800) AS BIGINT) AS px, CAST(trunc(p.y/107*1500) AS BIGINT) AS py,
    CASE WHEN p.team IN (1, 2) THEN p.team ELSE m.team END AS team
  FROM heat_points p LEFT JOIN team_mode m USING (video_id, player_id)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT video_id, unnest(track_ids) AS track_id, total_distance_m, avg_speed_kmh FROM players) d JOIN videos v USING (video_id)
    WHERE d.video_id = p.video_id AND d.track_id = p.player_id AND v.total_frames >= 90 AND (d.total_distance_m < 3 OR d.avg_speed_kmh < CAST(0.8 AS DOUBLE)))) q
WHERE px BETWEEN 15 AND 2784 AND py BETWEEN 15 AND 1484 AND team IN (1, 2)""")
derive("heat", ("heat_cells",), """
SELECT video_id, layer, cell_x, cell_y, count(*) AS n FROM (
  SELECT *, 'team_' || CAST(team AS STRING) AS layer FROM heat_cells UNION ALL SELECT *, 'match' AS layer FROM heat_cells) u
GROUP BY ALL""")
derive("heat20", ("heat",), """
SELECT video_id, layer, cell_x//20 AS cell_x, cell_y//20 AS cell_y, CAST(sum(n) AS BIGINT) AS n FROM heat GROUP BY ALL""")
query("heatmap_grid", lambda t: reports.heat_grid(t.tracks, t.positions, t.videos), ("heat",), "SELECT * FROM heat")
query("heatmap_grid_cells", lambda t: reports.heat_grid(t.tracks, t.positions, t.videos, cell_px=20), ("heat20",), "SELECT * FROM heat20")
# at pixel size a layer has millions of warm pixels, so a row holds a run of them in a line; checked against numpy in the tests
query("heatmap_density", lambda t: court.heatmap_lines(reports.heat_grid(t.tracks, t.positions, t.videos)))
derive("kernel", (), """
SELECT d, w/sum(w) OVER () AS w FROM (SELECT d, exp(-(d*d)/(2*CAST(3.25 AS DOUBLE)*CAST(3.25 AS DOUBLE))) AS w
  FROM (SELECT CAST(unnest(range(-13, 14)) AS BIGINT) AS d) r) k""")
derive("blur", ("heat20", "kernel"), """
SELECT video_id, layer, cell_x, image + d AS cell_y, sum(v*w) AS v FROM (
  SELECT *, unnest(list_distinct([cell_y, -cell_y, 148 - cell_y])) AS image FROM (
    SELECT video_id, layer, image + d AS cell_x, cell_y, sum(n*w) AS v
    FROM (SELECT *, unnest(list_distinct([cell_x, -cell_x, 278 - cell_x])) AS image FROM heat20), kernel WHERE image + d BETWEEN 0 AND 139
    GROUP BY ALL)) h, kernel WHERE image + d BETWEEN 0 AND 74 GROUP BY ALL""")
query("heatmap_density_cells", lambda t: six(
    court.heatmap_density(reports.heat_grid(t.tracks, t.positions, t.videos, cell_px=20), cell_px=20), "density", "alpha"), ("blur",), f"""
SELECT video_id, layer, cell_x, cell_y, {R('density', 6)} AS density,
  {R('CASE WHEN density >= CAST(0.05 AS DOUBLE) THEN least(CAST(0.7 AS DOUBLE), CAST(0.2 AS DOUBLE) + 0.5*((density - CAST(0.05 AS DOUBLE))/CAST(0.95 AS DOUBLE))) ELSE CAST(0 AS DOUBLE) END', 6)} AS alpha
FROM (SELECT *, greatest(0, least(1, v/quantile_cont(v, 0.98) OVER (PARTITION BY video_id, layer))) AS density FROM blur WHERE v > 0) b""")

