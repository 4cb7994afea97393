"""Cricket rule and scorecard queries with their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import cricket as ck
from fieldlens.plans.court_queries import six
from fieldlens.plans.registry import Tables, derive, query, rounded as R


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


derive("zoned", ("deliveries",), f"""
SELECT *, CASE WHEN metric_x IS NULL THEN 'On the Stumps' WHEN metric_y IS NULL THEN 'Middle' WHEN metric_y < {D(-0.6)} THEN 'Wide Outside Off'
    WHEN metric_y < {D(-0.15)} THEN 'Outside Off' WHEN metric_y <= {D(0.15)} THEN 'On the Stumps' WHEN metric_y <= {D(0.6)} THEN 'Leg Stump / Pad Line'
    ELSE 'Down Leg Side' END AS line,
  CASE WHEN metric_x IS NULL THEN 'Good Length' WHEN d < 2 THEN 'Yorker' WHEN d < 4 THEN 'Full' WHEN d < 6.5 THEN 'Good Length'
    WHEN d < 8.5 THEN 'Short of Length' ELSE 'Bouncer / Short' END AS length
FROM (SELECT *, greatest(0, {D(20.12)} - metric_x) AS d FROM deliveries) z""")
LL = "video_id, delivery_key, metric_x, metric_y, line, length"
query("line_length", lambda t: ck.line_length(t.deliveries_raw).select(*LL.split(", ")), ("zoned",), f"SELECT {LL} FROM zoned")
derive("zone2", ("deliveries",), f"""
SELECT *, CASE WHEN metric_x < 8 THEN 'Bouncer' WHEN metric_x < 10.5 THEN 'Short / Back of Length' WHEN metric_x <= 14.5 THEN 'Good Length'
    WHEN metric_x <= 17.5 THEN 'Full / Driving Length' ELSE 'Yorker' END AS length_zone,
  CASE WHEN metric_y < -{D(0.1143)}*2.5 THEN 'Wide Outside Off' WHEN metric_y < -{D(0.1143)} THEN 'Corridor of Uncertainty / 4th Stump'
    WHEN abs(metric_y) <= {D(0.1143)} THEN 'On The Stumps' ELSE 'Down Leg Side' END AS line_zone
FROM deliveries""")
query("length_zone", lambda t: ck.length_zone(t.deliveries_raw).select("video_id", "delivery_key", "length_zone"), ("zone2",),
      "SELECT video_id, delivery_key, length_zone FROM zone2")
query("line_zone", lambda t: ck.line_zone(t.deliveries_raw).select("video_id", "delivery_key", "line_zone"), ("zone2",),
      "SELECT video_id, delivery_key, line_zone FROM zone2")
derive("xd", ("zone2",), f"""
SELECT *, CASE WHEN metric_x IS NULL OR metric_y IS NULL THEN {D(0.15)} ELSE greatest({D(0.02)}, least({D(0.95)},
  CASE length_zone WHEN 'Good Length' THEN {D(0.42)} WHEN 'Yorker' THEN {D(0.38)} WHEN 'Full / Driving Length' THEN {D(0.28)} WHEN 'Short / Back of Length' THEN {D(0.22)} ELSE {D(0.18)} END
  * CASE line_zone WHEN 'Corridor of Uncertainty / 4th Stump' THEN {D(1.35)} WHEN 'On The Stumps' THEN {D(1.25)} WHEN 'Wide Outside Off' THEN {D(0.5)} ELSE {D(0.4)} END
  * ({D(0.85)} + {D(0.35)}*greatest(0, least(1, (release_speed_kmh-90)/60))) + least({D(0.2)}, abs(seam_deg)*{D(0.05)})
  + CASE WHEN abs(stump_x) <= {D(0.1143)} AND stump_z BETWEEN 0 AND {D(0.7112)} THEN {D(0.18)} ELSE {D(0)} END)) END AS raw FROM zone2""")
derive("dismissal", ("xd",), f"""
SELECT * REPLACE (CASE WHEN metric_x IS NULL OR metric_y IS NULL THEN 'Full Toss' ELSE length_zone END AS length_zone,
    CASE WHEN metric_x IS NULL OR metric_y IS NULL THEN 'On The Stumps' ELSE line_zone END AS line_zone),
  {R('raw', 3)} AS xd_score, {R('raw*100', 1)} AS xd_pct,
  CASE WHEN metric_x IS NULL OR metric_y IS NULL THEN 'LOW' WHEN raw >= {D(0.65)} THEN 'EXTREME' WHEN raw >= {D(0.45)} THEN 'HIGH' WHEN raw >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level
FROM xd""")
XD = "video_id, delivery_key, xd_score, xd_pct, threat_level, length_zone, line_zone"
query("expected_dismissal", lambda t: ck.expected_dismissal(t.deliveries_raw).select(*XD.split(", ")), ("dismissal",), f"SELECT {XD} FROM dismissal")


def lbw_sql(source: str, name: str) -> None:
    """The ruling as SQL over a table with the ten review columns."""
    derive(f"{name}_zones", (source,), f"""
    SELECT *, CASE WHEN bat_edge AND pitch_x IS NOT NULL THEN 'IN-LINE' WHEN pitch_x IS NULL THEN 'FULL TOSS'
        WHEN pitch_x*s > {D(0.1143)} THEN 'OUTSIDE LEG' WHEN pitch_x*s < -{D(0.1143)} THEN 'OUTSIDE OFF' ELSE 'IN-LINE' END AS pitching,
      CASE WHEN bat_edge OR abs(impact_x) <= {D(0.1143)} THEN 'IN-LINE' WHEN abs(impact_x) <= {D(0.1143)}+{D(0.036)} THEN 'UMPIRE''S CALL'
        WHEN impact_x*s < 0 THEN 'OUTSIDE OFF' ELSE 'OUTSIDE LEG' END AS impact,
      CASE WHEN bat_edge OR (abs(stump_x) <= {D(0.1143)} AND stump_z BETWEEN {D(0.036)} AND {D(0.7112)}) THEN 'HITTING'
        WHEN abs(stump_x) <= {D(0.1143)}+{D(0.036)} AND stump_z BETWEEN 0 AND {D(0.74)}+{D(0.036)} THEN 'UMPIRE''S CALL' ELSE 'MISSING' END AS wickets,
      NOT bat_edge AND greatest(0, {D(20.12)}-impact_y) >= 3 AS is_3_meter_rule,
      NOT bat_edge AND coalesce(impact_y - pitch_y < {D(0.4)}, false) AS is_close_proximity
    FROM (SELECT *, CASE WHEN hand = 'RHB' THEN 1 ELSE -1 END AS s FROM {source}) r""")
    derive(name, (f"{name}_zones",), f"""
    SELECT * EXCLUDE (s, rule), CASE WHEN rule IN (9, 12) THEN 'OUT' WHEN rule IN (10, 11) THEN on_field_call ELSE 'NOT OUT' END AS final_verdict,
      CASE rule WHEN 1 THEN 'Bat edge detected prior to pad contact (UltraEdge / Snicko). LBW invalidated.'
        WHEN 2 THEN 'Pitching outside leg stump line (Law 36.1(b)).' WHEN 3 THEN 'Impact outside leg stump line.'
        WHEN 4 THEN 'Impact outside off stump line with shot offered (Law 36.1(e)).' WHEN 5 THEN 'Projected ball trajectory missing wickets.'
        WHEN 6 THEN 'Impact within 40cm of pitch bounce. On-field call upheld.'
        WHEN 7 THEN 'ICC 3-Meter Law applies (' || printf('%.2f', greatest(0, {D(20.12)}-impact_y)) || 'm from stumps). On-field NOT OUT upheld.'
        WHEN 8 THEN 'ICC 3-Meter Law applies with Umpire''s Call on impact. On-field NOT OUT upheld.'
        WHEN 9 THEN 'Three Reds despite 3m distance (ball crashing into middle stump).'
        WHEN 10 THEN 'Umpire''s Call on Impact. On-field verdict upheld.' WHEN 11 THEN 'Umpire''s Call on Wickets. On-field verdict upheld.'
        ELSE 'Three Reds: Pitching in-line, Impact in-line, Wickets hitting.' END AS reasons
    FROM (SELECT *, CASE WHEN bat_edge THEN 1 WHEN pitching = 'OUTSIDE LEG' THEN 2 WHEN impact = 'OUTSIDE LEG' THEN 3
        WHEN impact = 'OUTSIDE OFF' AND shot_offered THEN 4 WHEN wickets = 'MISSING' THEN 5 WHEN is_close_proximity AND on_field_call = 'NOT OUT' THEN 6
        WHEN is_3_meter_rule AND on_field_call = 'NOT OUT' THEN CASE WHEN wickets LIKE 'UMP%' OR abs(stump_x) > {D(0.1143)}*0.75 THEN 7 WHEN impact LIKE 'UMP%' THEN 8 ELSE 9 END
        WHEN impact LIKE 'UMP%' THEN 10 WHEN wickets LIKE 'UMP%' THEN 11 ELSE 12 END AS rule FROM {name}_zones) z""")


lbw_sql("reviews", "ruled")
query("lbw_verdict", lambda t: ck.lbw_verdict(t.reviews), ("ruled",), "SELECT * FROM ruled")
query("verdict_class", lambda t: ck.verdict_class(ck.lbw_verdict(t.reviews)).select(
    "video_id", "delivery_key", "pitching_class", "impact_class", "wickets_class", "decision_class"), ("ruled",), """
SELECT video_id, delivery_key, CASE WHEN pitching = 'IN-LINE' THEN 'in-line' WHEN pitching LIKE 'OUTSIDE%' THEN 'missing' ELSE '' END AS pitching_class,
  CASE WHEN impact = 'IN-LINE' THEN 'in-line' WHEN impact LIKE 'OUTSIDE%' THEN 'missing' ELSE 'umpires-call' END AS impact_class,
  CASE wickets WHEN 'HITTING' THEN 'in-line' WHEN 'MISSING' THEN 'missing' ELSE 'umpires-call' END AS wickets_class,
  CASE WHEN final_verdict = 'OUT' THEN 'out' ELSE 'not-out' END AS decision_class FROM ruled""")


def reviewed(t: Tables):
    """Deliveries with a ruling where the outcome is a leg-before appeal."""
    ruling = ck.lbw_verdict(t.reviews).select("delivery_key", "pitching", "impact", "wickets", "final_verdict", "reasons")
    plain = t.deliveries.join(ruling, "delivery_key", "left")
    appeal = F.col("outcome").isin("lbw_wicket", "lbw_not_out")
    return plain.withColumns({c: F.when(appeal, F.col(c)) for c in ("pitching", "impact", "wickets", "final_verdict", "reasons")})


derive("appeals", ("deliveries", "ruled"), """
SELECT d.*, CASE WHEN a THEN pitching END AS pitching, CASE WHEN a THEN impact END AS impact, CASE WHEN a THEN wickets END AS wickets,
  CASE WHEN a THEN final_verdict END AS final_verdict, CASE WHEN a THEN reasons END AS reasons
FROM (SELECT *, outcome IN ('lbw_wicket', 'lbw_not_out') AS a FROM deliveries) d LEFT JOIN (
  SELECT delivery_key, pitching, impact, wickets, final_verdict, reasons FROM ruled) r USING (delivery_key)""")
query("drs_deliveries", lambda t: ck.drs_deliveries(reviewed(t)).select("video_id", "delivery_key", "final_verdict", "reasons"),
      ("appeals",), "SELECT video_id, delivery_key, final_verdict, reasons FROM appeals WHERE final_verdict IS NOT NULL")


def foot_landings(t: Tables):
    k = F.col("delivery_key")
    return t.deliveries_raw.select("video_id", "delivery_key", F.when(k % 9 != 0, (k * 37 % 50 + 100) / 100 + 0.003).alias("foot_y"),
                                   (k % 4 != 0).alias("is_grounded"))


query("no_ball", lambda t: ck.no_ball(foot_landings(t)), ("deliveries",), f"""
SELECT video_id, delivery_key, foot_y, is_grounded, f - {D(1.22)} > 0 AS is_no_ball, {R('f', 3)} AS heel_position_y, {R('m', 1)} AS margin_cm,
  CASE WHEN f - {D(1.22)} > 0 THEN 'NO BALL - Front foot overstepped by ' || printf('%.1f', abs(m)) || ' cm'
    ELSE 'LEGAL DELIVERY - Grounded behind crease by ' || printf('%.1f', abs(m)) || ' cm' END AS verdict_text,
  CASE WHEN is_grounded THEN {D(0.96)} ELSE {D(0.8)} END AS confidence
FROM (SELECT *, (f - {D(1.22)})*100 AS m FROM (SELECT *, coalesce(foot_y, {D(1.15)}) AS f FROM (
  SELECT video_id, delivery_key, CASE WHEN delivery_key%9 <> 0 THEN CAST(delivery_key*37%50 + 100 AS DOUBLE)/100 + {D(0.003)} END AS foot_y,
    delivery_key%4 <> 0 AS is_grounded FROM deliveries) a) b) c""")
query("runs_of_outcome", lambda t: ck.runs_of_outcome(t.deliveries_raw.select(
    "video_id", "delivery_key", "outcome", (F.col("delivery_key") % 3).cast("int").alias("event_runs"))), ("deliveries",), """
SELECT video_id, delivery_key, outcome, CAST(delivery_key%3 AS INT) AS event_runs,
  CAST(CASE WHEN outcome = 'four' THEN 4 WHEN outcome = 'six' THEN 6 WHEN outcome = 'runs' AND delivery_key%3 = 0 THEN 1 ELSE delivery_key%3 END AS INT) AS runs FROM deliveries""")


def velocities(t: Tables):
    k = F.col("delivery_key")
    cols = {"pre_vx": (k * 13 % 21 - 10) / 10, "pre_vy": (k * 7 % 300 - 20) / 10, "post_vx": (k * 17 % 31 - 15) / 10, "post_vy": (k * 11 % 250 - 10) / 10}
    return t.deliveries_raw.select("video_id", "delivery_key", *[v.alias(c) for c, v in cols.items()])


query("seam_deviation", lambda t: six(ck.seam_deviation(velocities(t)), "seam_deviation_deg"), ("deliveries",), f"""
SELECT *, {R('degrees(atan2(post_vx, greatest(CAST(0.1 AS DOUBLE), post_vy))) - degrees(atan2(pre_vx, greatest(CAST(0.1 AS DOUBLE), pre_vy)))', 6)} AS seam_deviation_deg
FROM (SELECT video_id, delivery_key, CAST(delivery_key*13%21 - 10 AS DOUBLE)/10 AS pre_vx, CAST(delivery_key*7%300 - 20 AS DOUBLE)/10 AS pre_vy,
  CAST(delivery_key*17%31 - 15 AS DOUBLE)/10 AS post_vx, CAST(delivery_key*11%250 - 10 AS DOUBLE)/10 AS post_vy FROM deliveries) v""")
query("confidence_cone", lambda t: six(ck.confidence_cone(t.deliveries_raw.select(
    "video_id", "delivery_key", (F.col("metric_x") - 3).alias("distance_m"))), "sigma_x", "sigma_z", digits=9), ("deliveries",), f"""
SELECT video_id, delivery_key, distance_m, {R(f'g*{D(0.008)}', 9)} AS sigma_x, {R(f'g*{D(0.012)}', 9)} AS sigma_z FROM (
  SELECT *, 1 + {D(0.035)}*pow(CASE WHEN distance_m IS NOT NULL THEN greatest(0, distance_m) END, {D(1.4)}) AS g FROM (
    SELECT video_id, delivery_key, metric_x - 3 AS distance_m FROM deliveries) a) b""")

query("over_notation", lambda t: ck.over_notation(t.deliveries_raw.select("video_id", "delivery_key")), ("deliveries",), """
SELECT video_id, delivery_key, delivery_number AS ball_no,
  CAST((delivery_number-1 - (delivery_number-1)%6)//6 AS STRING) || '.' || CAST((delivery_number-1)%6 + 1 AS STRING) AS over,
  CAST((delivery_number - delivery_number%6)//6 AS STRING) || '.' || CAST(delivery_number%6 AS STRING) AS overs_completed FROM deliveries""")
_SPEED = f"""coalesce({R('max(sp)', 1)}, 0) AS fastest_kmh, coalesce({R('min(sp)', 1)}, 0) AS slowest_kmh, coalesce({R('avg(sp)', 1)}, 0) AS average_kmh"""
_OVERS = "CAST((count(*) - count(*)%6)//6 AS STRING) || '.' || CAST(count(*)%6 AS STRING) AS overs"
_D = "(SELECT *, CASE WHEN release_speed_kmh > 0 THEN release_speed_kmh END AS sp FROM deliveries) d"
query("innings_summary", lambda t: ck.innings_summary(t.deliveries_raw), ("deliveries",), f"""
SELECT video_id, count(*) AS total_deliveries, {_OVERS}, CAST(sum(runs) AS BIGINT) AS total_runs,
  count(*) FILTER (outcome NOT IN ('dot_ball', 'four', 'six') AND is_wicket) AS wickets, count(*) FILTER (outcome = 'four') AS boundaries_four,
  count(*) FILTER (outcome = 'six') AS boundaries_six, {R("count(*) FILTER (outcome = 'dot_ball')/count(*)*CAST(100 AS DOUBLE)", 1)} AS dot_ball_percentage, {_SPEED}
FROM {_D} GROUP BY video_id""")
query("match_summary", lambda t: ck.match_summary(t.deliveries_raw), ("deliveries",), f"""
SELECT * REPLACE (CAST(greatest(estimated_runs, 4*fours + 6*sixes) AS BIGINT) AS estimated_runs) FROM (
  SELECT video_id, count(*) AS total_deliveries, {_OVERS}, CAST(sum(runs) AS BIGINT) AS estimated_runs, count(*) FILTER (is_wicket) AS wickets,
    count(*) FILTER (NOT is_wicket AND outcome = 'four') AS fours, count(*) FILTER (NOT is_wicket AND outcome = 'six') AS sixes,
    count(*) FILTER (NOT is_wicket AND outcome IN ('dot_ball', 'lbw_not_out')) AS dot_balls,
    {R("count(*) FILTER (NOT is_wicket AND outcome IN ('dot_ball', 'lbw_not_out'))/count(*)*CAST(100 AS DOUBLE)", 1)} AS dot_ball_pct, {_SPEED}
  FROM {_D} GROUP BY video_id) s""")
query("distribution", lambda t: six(ck.distribution(ck.line_length(t.deliveries_raw), ["line", "length", "shot_played"]), "pct"), ("zoned",), f"""
SELECT video_id, kind, label, n, {R('n/sum(n) OVER (PARTITION BY video_id, kind)*100', 6)} AS pct FROM (
  SELECT video_id, kind, label, count(*) AS n FROM (
    SELECT video_id, 'line' AS kind, line AS label FROM zoned UNION ALL SELECT video_id, 'length', length FROM zoned
    UNION ALL SELECT video_id, 'shot_played', shot_played FROM zoned) u GROUP BY ALL) c""")
query("over_summary", lambda t: ck.over_summary(t.deliveries.withColumn(
    "over_no", F.floor((F.col("delivery_number") - 1) / 6).cast("bigint"))), ("deliveries",), """
SELECT *, 'End of Over ' || CAST(over_no AS STRING) || ': ' || CAST(runs AS STRING) || CASE WHEN runs = 1 THEN ' run' ELSE ' runs' END
  || CASE WHEN wickets > 1 THEN ', ' || CAST(wickets AS STRING) || ' wickets' WHEN wickets = 1 THEN ', 1 wicket' ELSE '' END
  || ' off ' || CAST(balls AS STRING) || ' balls. ' || CASE WHEN runs <= 3 THEN 'A testing over by the bowling side.' ELSE 'A productive over for the batting side.' END AS summary
FROM (SELECT video_id, CAST(floor((delivery_number-1)/6) AS BIGINT) AS over_no, CAST(sum(runs) AS BIGINT) AS runs, count(*) FILTER (is_wicket) AS wickets, count(*) AS balls
  FROM deliveries GROUP BY ALL) o""")


def described(t: Tables, labelled: bool = True):
    """Deliveries with all that the commentary and the table show; line and length, which follow from the row, only if ``labelled``."""
    xd = ck.expected_dismissal(t.deliveries_raw).select("delivery_key", "xd_pct", "threat_level")
    rows = ck.over_notation(reviewed(t)).join(xd, "delivery_key").withColumn("event_runs", F.lit(0))
    return ck.line_length(rows) if labelled else rows  # labels follow from the row, so they are added behind the join


derive("described", ("appeals", "zoned", "dismissal"), """
SELECT a.*, z.line, z.length, x.xd_pct, x.threat_level,
  CAST((delivery_number-1 - (delivery_number-1)%6)//6 AS STRING) || '.' || CAST((delivery_number-1)%6 + 1 AS STRING) AS over
FROM appeals a JOIN (SELECT delivery_key, line, length FROM zoned) z USING (delivery_key)
JOIN (SELECT delivery_key, xd_pct, threat_level FROM dismissal) x USING (delivery_key)""")
derive("spoken", ("described",), """
SELECT video_id, delivery_key, head || CASE
  WHEN is_wicket AND final_verdict IS NOT NULL THEN ' HUGE APPEAL for LBW! Pitched ' || pitching || ', struck pad ' || impact || '. Hawk-Eye projection confirms ' || wickets || '! DECISION: ' || final_verdict || '. ' || reasons
  WHEN is_wicket AND outcome = 'wicket' THEN ' BOWLED HIM! Timber! Pitched on ' || len || ' and crashed straight through the batsman''s defense into the stumps! Crucial breakthrough!'
  WHEN is_wicket THEN ' OUT! High in the air and taken! A magnificent delivery on ' || len || ' forces the false shot.'
  WHEN outcome = 'six' THEN ' BANG! MAXIMUM! Picked up cleanly off a ' || len || ' delivery, launched high over the ropes for a towering SIX!'
  WHEN outcome = 'four' THEN ' FOUR! What a gorgeous ' || shot || '! Fed on ' || len || ' ' || lin || ', and crunched through the gap to the boundary fence.'
  WHEN outcome = 'lbw_not_out' AND final_verdict IS NOT NULL THEN ' Shouted appeal for LBW! Turned down by the umpire. Hawk-Eye shows ' || reasons || '. Not out stands.'
  WHEN outcome = 'runs' THEN ' Pushed gently into the off-side gap with a neat ' || shot || '. The batsmen scamper across for a quick single.'
  WHEN delivery_key%3 = 0 THEN ' Probing delivery on ' || len || ', ' || lin || '. The batsman plays a measured ' || shot || ' towards mid-on. No run.' || tag
  WHEN delivery_key%3 = 1 THEN ' Bowled at good pace on ' || len || '. Batsman defends solidly behind the line of the ball. Dot ball.' || tag
  ELSE ' Tight bowling! Pitched on ' || len || ', beaten on the outside edge as it zips past the off pole.' || tag END AS commentary
FROM (SELECT *, 'Over ' || over || ':' || CASE WHEN release_speed_kmh > 0 THEN printf(' (%.1f km/h)', release_speed_kmh) ELSE '' END AS head,
    lower(length) AS len, lower(line) AS lin, replace(shot_played, '_', ' ') AS shot,
    CASE WHEN xd_pct >= 40 THEN ' [Threat Index xD: ' || printf('%.1f', xd_pct) || '%]' ELSE '' END AS tag FROM described) d""")
query("commentary_line", lambda t: ck.commentary_line(described(t)).select("video_id", "delivery_key", "commentary"), ("spoken",), "SELECT * FROM spoken")
query("latest_commentary", lambda t: ck.latest_commentary(ck.commentary_line(described(t))), ("spoken",), """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY delivery_key DESC) AS INT) AS rank FROM spoken) s WHERE rank <= 5""")
query("pitch_map_points", lambda t: ck.pitch_map_points(ck.line_length(t.deliveries_raw)), ("zoned",), f"""
SELECT video_id, delivery_key, CAST(trunc(px) AS BIGINT) AS px, CAST(trunc(py) AS BIGINT) AS py,
  CASE WHEN is_wicket OR contains(outcome, 'wicket') THEN 'wicket' WHEN runs >= 4 THEN 'boundary' WHEN runs > 0 THEN 'runs' ELSE 'dot' END AS category,
  CASE WHEN release_speed_kmh > 0 THEN CAST(CAST(trunc(release_speed_kmh) AS BIGINT) AS STRING) || 'k' ELSE '#' || CAST(delivery_number AS STRING) END AS label
FROM (SELECT *, 120 + mx/{D(20.12)}*360 AS px, 160 + my/{D(3.05)}*80 AS py FROM (
  SELECT *, coalesce(metric_x, CASE length WHEN 'Yorker' THEN {D(19.1)} WHEN 'Full' THEN {D(17.5)} WHEN 'Good Length' THEN {D(14.8)} WHEN 'Short of Length' THEN {D(12.5)} ELSE {D(10)} END) AS mx,
    CASE WHEN metric_x IS NOT NULL THEN metric_y ELSE {D(0)} END AS my FROM zoned) z) p WHERE px BETWEEN 0 AND 600 AND py BETWEEN 0 AND 320""")
query("wagon_wheel_points", lambda t: ck.wagon_wheel_points(t.deliveries_raw), ("deliveries",), """
SELECT video_id, delivery_key, CASE WHEN angle IS NOT NULL THEN CAST(trunc(265 + reach*sin(radians(angle))) AS BIGINT) ELSE 265 + CASE WHEN idx%2 = 0 THEN aside ELSE -aside END END AS end_x,
  CASE WHEN angle IS NOT NULL THEN CAST(trunc(263 - reach*cos(radians(angle))) AS BIGINT) ELSE 263 + (aside - aside%2)//2 END AS end_y,
  CASE WHEN is_wicket THEN 'wicket' WHEN runs >= 4 THEN 'boundary' ELSE 'runs' END AS category,
  CASE WHEN angle IS NOT NULL THEN replace(shot_played, '_', ' ') || ' (' || CAST(runs AS STRING) || 'r)' END AS label
FROM (SELECT *, delivery_number - 1 AS idx, 20 + (delivery_number-1)*8 AS aside, least(CASE WHEN runs > 0 THEN 70 + runs*40 ELSE 60 END, 235) AS reach,
  CASE shot_played WHEN 'cover_drive' THEN -50 WHEN 'straight_drive' THEN 0 WHEN 'pull' THEN 75 WHEN 'hook' THEN 125 WHEN 'late_cut' THEN -130
    WHEN 'square_cut' THEN -90 WHEN 'flick' THEN 50 WHEN 'sweep' THEN 135 WHEN 'lofted' THEN -30 END AS angle FROM deliveries) d""")
query("format_duration", lambda t: ck.format_duration(t.deliveries_raw.select("video_id", "delivery_key", (F.col("delivery_key") * 17 % 20000 / 2).alias("seconds"))), ("deliveries",), """
SELECT video_id, delivery_key, seconds, CASE WHEN h > 0 THEN CAST(h AS STRING) || 'h ' ELSE '' END || CASE WHEN h > 0 OR m > 0 THEN CAST(m AS STRING) || 'm ' ELSE '' END
  || CAST(s AS STRING) || 's' AS duration
FROM (SELECT *, CAST(floor(seconds/3600) AS BIGINT) AS h, CAST(floor(seconds%3600/60) AS BIGINT) AS m, CAST(floor(seconds%60) AS BIGINT) AS s FROM (
  SELECT video_id, delivery_key, CAST(delivery_key*17%20000 AS DOUBLE)/2 AS seconds FROM deliveries) a) b""")
query("display_label", lambda t: ck.display_label(t.deliveries_raw.select("video_id", "delivery_key", "shot_played"), "shot_played"), ("deliveries",), """
SELECT video_id, delivery_key, shot_played, list_reduce(list_transform(string_split(shot_played, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS display_label FROM deliveries""")
query("delivery_table", lambda t: ck.delivery_table(described(t)), ("described",), """
SELECT video_id, delivery_key, over, CASE WHEN release_speed_kmh <> 0 THEN printf('%.1f', release_speed_kmh) ELSE '--' END || ' / '
    || CASE WHEN bounce_speed_kmh <> 0 THEN printf('%.1f', bounce_speed_kmh) ELSE '--' END || ' km/h' AS speeds, line, length, replace(shot_played, '_', ' ') AS shot,
  CASE WHEN contains(outcome, 'wicket') THEN 'wicket' WHEN runs >= 4 THEN 'boundary' WHEN runs > 0 THEN 'runs' ELSE 'dot' END AS outcome_class,
  CASE WHEN contains(outcome, 'wicket') THEN 'WICKET' WHEN runs = 6 THEN 'SIX (6)' WHEN runs >= 4 THEN 'FOUR (4)' WHEN runs = 1 THEN '1 Run' ELSE 'Dot Ball' END AS outcome_text,
  printf('%.1f', decel_pct) || '%' AS deceleration, printf('%.1f', xd_pct) || '%' AS xd,
  CASE threat_level WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END AS xd_class FROM described""")
