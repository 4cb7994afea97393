"""Rules and summaries over cricket deliveries: zones, verdicts, probabilities, commentary, scorecards."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.constants import (
    BAIL_HEIGHT, BALL_RADIUS, LENGTH_TO_METRES, LINE_TO_METRES, PITCH_LENGTH, PITCH_WIDTH, POPPING_CREASE,
    SHOT_ANGLES, STUMP_HALF_WIDTH, STUMP_HEIGHT,
)
from fieldlens.scale import SPAN, div_floor, positions, pyround, running

VIDEO = ["video_id"]


def steps(value: Column, limits: list[tuple[str, float, str]], otherwise: str) -> Column:
    """First label whose comparison holds: (operator, limit, label)."""
    tests = {"<": lambda v: value < v, "<=": lambda v: value <= v}
    return reduce(
        lambda rest, s: F.when(tests[s[0]](s[1]), F.lit(s[2])).otherwise(rest), reversed(limits), F.lit(otherwise)
    )


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


# ---- zones -------------------------------------------------------------------------------------------

def line_length(deliveries: DataFrame) -> DataFrame:
    """Line and length labels from the metric bounce point (metric_x along, metric_y across)."""
    from_batsman = F.greatest(F.lit(0.0), F.lit(PITCH_LENGTH) - F.col("metric_x"))
    length = steps(from_batsman, [
        ("<", 2.0, "Yorker"), ("<", 4.0, "Full"), ("<", 6.5, "Good Length"), ("<", 8.5, "Short of Length"),
    ], "Bouncer / Short")
    line = steps(F.col("metric_y"), [
        ("<", -0.60, "Wide Outside Off"), ("<", -0.15, "Outside Off"), ("<=", 0.15, "On the Stumps"),
        ("<=", 0.60, "Leg Stump / Pad Line"),
    ], "Down Leg Side")
    unknown = F.col("metric_x").isNull()
    return deliveries.withColumns({
        "line": F.when(unknown, "On the Stumps").when(F.col("metric_y").isNull(), "Middle").otherwise(line),
        "length": F.when(unknown, "Good Length").otherwise(length),
    })


def _length_zone(y: Column) -> Column:
    return steps(y, [
        ("<", 8.0, "Bouncer"), ("<", 10.5, "Short / Back of Length"), ("<=", 14.5, "Good Length"),
        ("<=", 17.5, "Full / Driving Length"),
    ], "Yorker")


def _line_zone(x: Column, right_handed: Column) -> Column:
    side = x * F.when(right_handed, 1.0).otherwise(-1.0)
    edge = STUMP_HALF_WIDTH
    return (
        F.when(side < -edge * 2.5, "Wide Outside Off").when(side < -edge, "Corridor of Uncertainty / 4th Stump")
        .when(F.abs(side) <= edge, "On The Stumps").otherwise("Down Leg Side")
    )


def length_zone(deliveries: DataFrame, along: str = "metric_x") -> DataFrame:
    return deliveries.withColumn("length_zone", _length_zone(F.col(along)))


def line_zone(deliveries: DataFrame, across: str = "metric_y", right_handed: bool | Column = True) -> DataFrame:
    hand = right_handed if isinstance(right_handed, Column) else F.lit(right_handed)
    return deliveries.withColumn("line_zone", _line_zone(F.col(across), hand))


def expected_dismissal(deliveries: DataFrame, right_handed: bool = True) -> DataFrame:
    """Chance of a wicket from bounce point, speed, movement (seam_deg) and projected stump point."""
    bounced = F.col("metric_x").isNotNull() & F.col("metric_y").isNotNull()
    zones = line_zone(length_zone(deliveries), right_handed=right_handed)
    base = lookup(F.col("length_zone"), {
        "Good Length": 0.42, "Yorker": 0.38, "Full / Driving Length": 0.28, "Short / Back of Length": 0.22, "Bouncer": 0.18,
    }, 0.25)
    line = lookup(F.col("line_zone"), {
        "Corridor of Uncertainty / 4th Stump": 1.35, "On The Stumps": 1.25, "Wide Outside Off": 0.50,
    }, 0.40)
    pace = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("release_speed_kmh") - 90.0) / 60.0))
    speed = F.lit(0.85) + F.lit(0.35) * pace
    movement = F.least(F.lit(0.20), F.abs("seam_deg") * 0.05)
    hits = (F.abs("stump_x") <= STUMP_HALF_WIDTH) & F.col("stump_z").between(0.0, STUMP_HEIGHT)
    bonus = F.when(hits, 0.18).otherwise(0.0)
    score = F.greatest(F.lit(0.02), F.least(F.lit(0.95), base * line * speed + movement + bonus))
    score = F.when(bounced, score).otherwise(0.15)
    threat = F.when(score >= 0.65, "EXTREME").when(score >= 0.45, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")
    return zones.withColumns({
        "xd_score": pyround(score, 3), "xd_pct": pyround(score * 100.0, 1),
        "threat_level": F.when(bounced, threat).otherwise("LOW"),
        "length_zone": F.when(bounced, F.col("length_zone")).otherwise("Full Toss"),
        "line_zone": F.when(bounced, F.col("line_zone")).otherwise("On The Stumps"),
    })


# ---- umpiring ----------------------------------------------------------------------------------------

def lbw_columns(r: dict[str, Column]) -> dict[str, Column]:
    """The leg-before ruling as columns.

    Inputs: pitch_x, pitch_y (NULL = full toss), impact_x, impact_y, stump_x, stump_z, hand, on_field_call,
    shot_offered, bat_edge.
    """
    edge, ball = STUMP_HALF_WIDTH, BALL_RADIUS
    right = r["hand"] == "RHB"
    toss = r["pitch_x"].isNull() | r["pitch_y"].isNull()

    def sided(x: Column) -> Column:
        """Positive toward leg."""
        return F.when(right, x).otherwise(-x)

    pitching = (
        F.when(toss, "FULL TOSS").when(sided(r["pitch_x"]) > edge, "OUTSIDE LEG")
        .when(sided(r["pitch_x"]) < -edge, "OUTSIDE OFF").otherwise("IN-LINE")
    )
    close = ~toss & ((r["impact_y"] - r["pitch_y"]) < 0.40)
    wide = F.abs(r["impact_x"])
    impact = (
        F.when(wide <= edge, "IN-LINE").when(wide <= edge + ball, "UMPIRE'S CALL")
        .when(sided(r["impact_x"]) < 0, "OUTSIDE OFF").otherwise("OUTSIDE LEG")
    )
    off_center = F.abs(r["stump_x"])
    wickets = (
        F.when((off_center <= edge) & r["stump_z"].between(ball, STUMP_HEIGHT), "HITTING")
        .when((off_center <= edge + ball) & r["stump_z"].between(0.0, BAIL_HEIGHT + ball), "UMPIRE'S CALL")
        .otherwise("MISSING")
    )
    dist = F.greatest(F.lit(0.0), F.lit(PITCH_LENGTH) - r["impact_y"])
    far = dist >= 3.0
    given = r["on_field_call"] == "OUT"
    impact_call, wickets_call = impact == "UMPIRE'S CALL", wickets == "UMPIRE'S CALL"

    # (condition, verdict, text) in the order of the rules; the first that holds decides
    not_out = F.lit("NOT OUT")
    rules: list[tuple[Column, Column, Column]] = [
        (r["bat_edge"], not_out, F.lit("Bat edge detected prior to pad contact (UltraEdge / Snicko). LBW invalidated.")),
        (pitching == "OUTSIDE LEG", not_out, F.lit("Pitching outside leg stump line (Law 36.1(b)).")),
        (impact == "OUTSIDE LEG", not_out, F.lit("Impact outside leg stump line.")),
        ((impact == "OUTSIDE OFF") & r["shot_offered"], not_out,
         F.lit("Impact outside off stump line with shot offered (Law 36.1(e)).")),
        (wickets == "MISSING", not_out, F.lit("Projected ball trajectory missing wickets.")),
        (close & ~given, not_out, F.lit("Impact within 40cm of pitch bounce. On-field call upheld.")),
        (far & ~given & (wickets_call | (off_center > edge * 0.75)), not_out,
         F.concat(F.lit("ICC 3-Meter Law applies ("), F.format_string("%.2f", dist), F.lit("m from stumps). On-field NOT OUT upheld."))),
        (far & ~given & impact_call, not_out,
         F.lit("ICC 3-Meter Law applies with Umpire's Call on impact. On-field NOT OUT upheld.")),
        (far & ~given, F.lit("OUT"), F.lit("Three Reds despite 3m distance (ball crashing into middle stump).")),
        (impact_call, r["on_field_call"], F.lit("Umpire's Call on Impact. On-field verdict upheld.")),
        (wickets_call, r["on_field_call"], F.lit("Umpire's Call on Wickets. On-field verdict upheld.")),
    ]
    verdict, reasons = F.lit("OUT"), F.lit("Three Reds: Pitching in-line, Impact in-line, Wickets hitting.")
    for test, decision, text in reversed(rules):
        verdict, reasons = F.when(test, decision).otherwise(verdict), F.when(test, text).otherwise(reasons)
    edged = r["bat_edge"]
    return {
        "pitching": F.when(edged & ~toss, "IN-LINE").otherwise(pitching),
        "impact": F.when(edged, "IN-LINE").otherwise(impact),
        "wickets": F.when(edged, "HITTING").otherwise(wickets),
        "final_verdict": verdict,
        "reasons": reasons,
        "is_3_meter_rule": ~edged & far,
        "is_close_proximity": ~edged & close,
    }


_REVIEW = ("pitch_x", "pitch_y", "impact_x", "impact_y", "stump_x", "stump_z", "hand", "on_field_call", "shot_offered", "bat_edge")


def lbw_verdict(reviews: DataFrame) -> DataFrame:
    """Full leg-before ruling per review."""
    return reviews.withColumns(lbw_columns({c: F.col(c) for c in _REVIEW}))


def drs_deliveries(deliveries: DataFrame, verdict: str = "final_verdict") -> DataFrame:
    return deliveries.filter(F.col(verdict).isNotNull())


def verdict_class(reviews: DataFrame) -> DataFrame:
    """Display class of each of the three verdict boxes and of the decision."""

    def box(name: str) -> Column:
        v = F.lower(name)
        return (
            F.when(v.contains("in-line") | v.contains("in_line") | v.contains("hitting"), "in-line")
            .when(v.contains("missing"), "missing").when(v.contains("umpire"), "umpires-call")
            .when(v.contains("outside"), "missing").otherwise("")
        )

    final = F.upper("final_verdict")
    out = final.contains("OUT") & ~final.contains("NOT")
    return reviews.withColumns({
        **{f"{c}_class": box(c) for c in ("pitching", "impact", "wickets")},
        "decision_class": F.when(out, "out").otherwise("not-out"),
    })


def no_ball(foot_landings: DataFrame) -> DataFrame:
    """Front-foot ruling from foot_y (metres from the stumps, 1.15 where unknown) and is_grounded."""
    foot = F.coalesce(F.col("foot_y"), F.lit(1.15))
    margin = (foot - POPPING_CREASE) * 100.0
    over = foot - POPPING_CREASE > 0
    shown = F.format_string("%.1f", F.abs(margin))
    return foot_landings.withColumns({
        "is_no_ball": over, "heel_position_y": pyround(foot, 3), "margin_cm": pyround(margin, 1),
        "verdict_text": F.when(over, F.concat(F.lit("NO BALL - Front foot overstepped by "), shown, F.lit(" cm")))
        .otherwise(F.concat(F.lit("LEGAL DELIVERY - Grounded behind crease by "), shown, F.lit(" cm"))),
        "confidence": F.when(F.col("is_grounded"), 0.96).otherwise(0.80),
    })


# ---- shots -------------------------------------------------------------------------------------------

def shot_columns(n: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Shot label and confidence from the number of points after impact and the exit vector."""
    speed = F.sqrt(dx * dx + dy * dy)
    elevation = F.degrees(F.atan2(-dy, F.abs(dx) + 1e-5))
    rules = [
        (n < 2, "defense", 0.65), (speed < 15.0, "defense", 0.85), (elevation > 35.0, "lofted", 0.88),
        ((F.abs(dx) < 20) & (dy < -20), "straight_drive", 0.82),
        ((dx < -20) & (elevation < 10) & (dy > 0), "late_cut", 0.78), ((dx < -20) & (F.abs(dy) < 30), "square_cut", 0.80),
        (dx < -20, "cover_drive", 0.84), ((dx > 20) & (elevation > 20), "hook", 0.80),
        ((dx > 20) & (dy < 0) & (F.abs(dx) > 35), "pull", 0.85), ((dx > 20) & (dy > 20), "sweep", 0.79), (dx > 20, "flick", 0.82),
    ]
    label, conf = F.lit("straight_drive"), F.lit(0.70)
    for test, name, value in reversed(rules):
        label, conf = F.when(test, name).otherwise(label), F.when(test, value).otherwise(conf)
    return label, conf


def shot_class(post_impact_points: DataFrame, keys: tuple[str, ...] = ("video_id", "delivery_key")) -> DataFrame:
    """Shot per delivery from the first and last ball point (frame_idx, cx, cy) after impact."""
    point = F.struct("cx", "cy")
    ends = post_impact_points.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min_by(point, "frame_idx").alias("_a"), F.max_by(point, "frame_idx").alias("_b")
    )
    label, conf = shot_columns(F.col("_n"), F.col("_b.cx") - F.col("_a.cx"), F.col("_b.cy") - F.col("_a.cy"))
    return ends.select(*keys, label.alias("shot_label"), conf.alias("shot_confidence"))


def runs_of_outcome(deliveries: DataFrame) -> DataFrame:
    given = F.coalesce(F.col("event_runs"), F.lit(0))
    runs = F.when(F.col("outcome") == "four", 4).when(F.col("outcome") == "six", 6).when(
        (F.col("outcome") == "runs") & (given == 0), 1).otherwise(given)
    return deliveries.withColumn("runs", runs.cast("int"))


def seam_deviation(df: DataFrame) -> DataFrame:
    """Degrees turned off the pitch, from the velocities before (pre_vx, pre_vy) and after (post_vx, post_vy)."""

    def heading(side: str) -> Column:
        return F.degrees(F.atan2(F.col(f"{side}_vx"), F.greatest(F.lit(0.1), F.col(f"{side}_vy"))))

    return df.withColumn("seam_deviation_deg", heading("post") - heading("pre"))


def confidence_cone(df: DataFrame, distance: str = "distance_m", sigma_x: float = 0.008, sigma_z: float = 0.012) -> DataFrame:
    known = F.when(F.col(distance).isNotNull(), F.greatest(F.lit(0.0), F.col(distance)))
    growth = F.lit(1.0) + F.lit(0.035) * F.pow(known, F.lit(1.4))
    return df.withColumns({"sigma_x": growth * sigma_x, "sigma_z": growth * sigma_z})


# ---- scorecards --------------------------------------------------------------------------------------

def over_notation(deliveries: DataFrame, order: str = "delivery_key", span: int = SPAN) -> DataFrame:
    """Number of each delivery in its video and its over: the 7th is 1.1.

    Where ``forced`` marks the delivery cut off by the end of the video, a sixth ball shows the over as full (1.0).
    """
    numbered = positions(deliveries, VIDEO, order, name="_n", span=span)
    over = div_floor(F.col("_n"), 6)
    ball = F.col("_n") - over * 6 + 1
    done = F.col("_n") + 1
    full = F.col("forced") & (ball == 6) if "forced" in deliveries.columns else F.lit(False)
    return numbered.withColumns({
        "ball_no": done,
        "over": F.when(full, F.concat((over + 1).cast("string"), F.lit(".0"))).otherwise(F.concat_ws(".", over.cast("string"), ball.cast("string"))),
        "overs_completed": F.concat_ws(".", div_floor(done, 6).cast("string"), (done % 6).cast("string")),
    }).drop("_n")


def live_over(frames: DataFrame, flights: DataFrame, span: int = SPAN) -> DataFrame:
    """Over notation shown at every frame: the ball being bowled while it is in flight, else the balls completed.

    Starts and ends of ``deliveries.flights`` are merged into the frames as +1 and -1, so running counts tell both.  The
    frame that completes a sixth ball still shows it (0.6), the next one the full over (1.0).  A flight that is cut off by the
    end of the video stays in flight, one that is too short ends without a ball.
    """
    ends = F.struct(F.col("done_frame").alias("frame_idx"), F.lit(-1).alias("_step"), F.col("counted").cast("int").alias("_ball"))
    starts = F.struct(F.col("start_frame").alias("frame_idx"), F.lit(1).alias("_step"), F.lit(0).alias("_ball"))
    marks = flights.select(*VIDEO, F.explode(F.array_compact(F.array(starts, F.when(~F.col("forced"), ends)))).alias("_m")).select(*VIDEO, "_m.*")
    spine = frames.select(*VIDEO, "frame_idx").withColumn("_shown", F.lit(True))
    merged = spine.unionByName(marks.withColumn("_shown", F.lit(False)), allowMissingColumns=True)
    # marks of a frame come before the frame
    counted = running(merged, VIDEO, "frame_idx", {
        "_flying": ("sum", F.col("_step"), True), "completed": ("sum", F.col("_ball"), True),
        "_done": ("last", F.when(F.col("_ball") == 1, F.col("frame_idx")), True),
    }, ties=["_shown"], span=span).filter("_shown")
    n = F.col("completed")
    flying, done = F.col("_flying") > 0, F.coalesce(F.col("_done") == F.col("frame_idx"), F.lit(False))
    ball = lambda k: F.concat_ws(".", div_floor(k, 6).cast("string"), (k % 6 + 1).cast("string"))
    return counted.select(
        *VIDEO, "frame_idx", flying.alias("in_flight"), done.alias("just_completed"), n.cast("bigint").alias("completed"),
        F.when(flying, ball(n)).when(done, ball(n - 1)).otherwise(_overs_text(n)).alias("over"),
    )


def _overs_text(n: Column) -> Column:
    return F.concat_ws(".", div_floor(n, 6).cast("string"), (n % 6).cast("string"))


def _speed_stats() -> list[Column]:
    speed = F.when(F.col("release_speed_kmh") > 0, F.col("release_speed_kmh"))
    return [
        F.coalesce(pyround(agg(speed), 1), F.lit(0.0)).alias(name)
        for name, agg in (("fastest_kmh", F.max), ("slowest_kmh", F.min), ("average_kmh", F.avg))
    ]


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def innings_summary(deliveries: DataFrame) -> DataFrame:
    """Totals per video by the ball-by-ball rule: the outcome counts first, then the wicket flag."""
    o = F.col("outcome")
    other = ~o.isin("dot_ball", "four", "six")
    n = F.count("*")
    return deliveries.groupBy(*VIDEO).agg(
        n.alias("total_deliveries"), _overs_text(n).alias("overs"), F.sum("runs").cast("bigint").alias("total_runs"),
        _count(other & F.col("is_wicket")).alias("wickets"), _count(o == "four").alias("boundaries_four"),
        _count(o == "six").alias("boundaries_six"), pyround(_count(o == "dot_ball") / n * 100.0, 1).alias("dot_ball_percentage"),
        *_speed_stats(),
    )


def match_summary(deliveries: DataFrame) -> DataFrame:
    """Totals per video by the report's rule: wickets count first, turned-down appeals are dots."""
    o = F.col("outcome")
    wicket = o.isin("wicket", "lbw_wicket") | F.col("is_wicket")
    n = F.count("*")
    fours, sixes = _count(~wicket & (o == "four")), _count(~wicket & (o == "six"))
    dots = _count(~wicket & o.isin("dot_ball", "lbw_not_out"))
    return deliveries.groupBy(*VIDEO).agg(
        n.alias("total_deliveries"), _overs_text(n).alias("overs"),
        F.greatest(F.sum("runs"), fours * 4 + sixes * 6).cast("bigint").alias("estimated_runs"),
        _count(wicket).alias("wickets"), fours.alias("fours"), sixes.alias("sixes"), dots.alias("dot_balls"),
        pyround(dots / n * 100.0, 1).alias("dot_ball_pct"), *_speed_stats(),
    )


def distribution(deliveries: DataFrame, cols: list[str]) -> DataFrame:
    """Count and share of every label of ``cols`` per video: one pass for all columns."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in cols]))
    labels = deliveries.select(*VIDEO, stack.alias("s")).select(*VIDEO, "s.kind", "s.label").filter("label IS NOT NULL")
    counts = labels.groupBy(*VIDEO, "kind", "label").agg(F.count("*").alias("n"))
    total = counts.groupBy(*VIDEO, "kind").agg(F.sum("n").alias("_total"))
    shares = counts.join(total, [*VIDEO, "kind"]).withColumn("pct", F.col("n") / F.col("_total") * 100)
    return shares.drop("_total").orderBy("video_id", "kind", F.col("n").desc(), "label")


def over_summary(deliveries: DataFrame) -> DataFrame:
    """Runs, wickets and balls of each over (``over_no``) with the recap line."""
    overs = deliveries.groupBy(*VIDEO, "over_no").agg(
        F.sum("runs").cast("bigint").alias("runs"), _count(F.col("is_wicket")).alias("wickets"), F.count("*").alias("balls")
    )

    def plural(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    wickets = F.when(F.col("wickets") > 0, F.concat(F.lit(", "), plural(F.col("wickets"), "wicket"))).otherwise("")
    recap = F.when(F.col("runs") <= 3, "A testing over by the bowling side.").otherwise("A productive over for the batting side.")
    return overs.withColumn("summary", F.concat(
        F.lit("End of Over "), F.col("over_no").cast("string"), F.lit(": "), plural(F.col("runs"), "run"), wickets,
        F.lit(" off "), F.col("balls").cast("string"), F.lit(" balls. "), recap,
    ))


def commentary_line(deliveries: DataFrame) -> DataFrame:
    """One line per delivery; of the three dot-ball texts ``delivery_key % 3`` picks one.

    Columns: over, release_speed_kmh, line, length, shot_played, outcome, runs, is_wicket, xd_pct and the
    verdict columns pitching, impact, wickets, final_verdict, reasons (NULL without a review).
    """
    length, line = F.lower("length"), F.lower("line")
    shot = F.replace(F.col("shot_played"), F.lit("_"), F.lit(" "))
    speed = F.when(F.col("release_speed_kmh") > 0, F.format_string(" (%.1f km/h)", "release_speed_kmh")).otherwise("")
    head = F.concat(F.lit("Over "), F.col("over"), F.lit(":"), speed)
    threat = F.when(F.col("xd_pct") >= 40.0, F.format_string(" [Threat Index xD: %.1f%%]", "xd_pct")).otherwise("")
    reviewed = F.col("final_verdict").isNotNull()
    runs = F.coalesce(F.col("event_runs"), F.lit(0))

    def text(*parts) -> Column:
        return F.concat(head, *[F.lit(p) if isinstance(p, str) else p for p in parts])

    wicket = (
        F.when(reviewed, text(
            " HUGE APPEAL for LBW! Pitched ", F.col("pitching"), ", struck pad ", F.col("impact"),
            ". Hawk-Eye projection confirms ", F.col("wickets"), "! DECISION: ", F.col("final_verdict"), ". ", F.col("reasons")))
        .when(F.col("outcome") == "wicket", text(
            " BOWLED HIM! Timber! Pitched on ", length,
            " and crashed straight through the batsman's defense into the stumps! Crucial breakthrough!"))
        .otherwise(text(
            " OUT! High in the air and taken! A magnificent delivery on ", length, " forces the false shot."))
    )
    six = text(" BANG! MAXIMUM! Picked up cleanly off a ", length, " delivery, launched high over the ropes for a towering SIX!")
    four = text(" FOUR! What a gorgeous ", shot, "! Fed on ", length, " ", line, ", and crunched through the gap to the boundary fence.")
    appeal = text(
        " Shouted appeal for LBW! Turned down by the umpire. Hawk-Eye shows ", F.col("reasons"), ". Not out stands.")
    ran = text(
        " Pushed gently into the off-side gap with a neat ", shot, ". The batsmen scamper across for a quick ",
        F.when(runs > 1, runs.cast("string")).otherwise("single"), ".")
    dots = F.array(
        text(" Probing delivery on ", length, ", ", line, ". The batsman plays a measured ", shot, " towards mid-on. No run.", threat),
        text(" Bowled at good pace on ", length, ". Batsman defends solidly behind the line of the ball. Dot ball.", threat),
        text(" Tight bowling! Pitched on ", length, ", beaten on the outside edge as it zips past the off pole.", threat),
    )
    o = F.col("outcome")
    return deliveries.withColumn("commentary", (
        F.when(F.col("is_wicket"), wicket).when(o == "six", six).when(o == "four", four)
        .when((o == "lbw_not_out") & reviewed, appeal).when((o == "runs") | (runs > 0), ran)
        .otherwise(F.get(dots, (F.col("delivery_key") % 3).cast("int")))
    ))


def latest_commentary(deliveries: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` lines per video.

    ``row_number <= n`` makes Spark keep only ``n`` rows per video in each task before the shuffle.
    """
    latest = Window.partitionBy(*VIDEO).orderBy(F.col("delivery_key").desc())
    ranked = deliveries.select(*VIDEO, "delivery_key", "commentary").withColumn("rank", F.row_number().over(latest))
    return ranked.filter(F.col("rank") <= n)


# ---- display tables ----------------------------------------------------------------------------------

def pitch_map_points(deliveries: DataFrame, span: int = SPAN) -> DataFrame:
    """Point of each delivery on the 600x320 pitch map with category and label."""
    numbered = positions(deliveries, VIDEO, "delivery_key", name="_idx", span=span)
    known = F.col("metric_x").isNotNull()
    mx = F.when(known, F.col("metric_x")).otherwise(lookup(F.coalesce("length", F.lit("Good Length")), LENGTH_TO_METRES, 15.0))
    my = F.when(known, F.col("metric_y")).otherwise(lookup(F.coalesce("line", F.lit("On the Stumps")), LINE_TO_METRES, 0.0))
    px, py = F.lit(120.0) + mx / PITCH_LENGTH * 360.0, F.lit(160.0) + my / PITCH_WIDTH * 80.0
    runs = F.coalesce(F.col("runs"), F.lit(0))
    wicket = F.col("is_wicket") | F.lower("outcome").contains("wicket")
    category = F.when(wicket, "wicket").when(runs >= 4, "boundary").when(runs > 0, "runs").otherwise("dot")
    label = F.when(
        F.col("release_speed_kmh") > 0, F.concat(F.col("release_speed_kmh").cast("bigint").cast("string"), F.lit("k"))
    ).otherwise(F.concat(F.lit("#"), (F.col("_idx") + 1).cast("string")))
    return numbered.withColumns({"_px": px, "_py": py}).filter(
        F.col("_px").between(0, 600) & F.col("_py").between(0, 320)
    ).select(
        *VIDEO, "delivery_key", F.col("_px").cast("bigint").alias("px"), F.col("_py").cast("bigint").alias("py"),
        category.alias("category"), label.alias("label"),
    )


def wagon_wheel_points(deliveries: DataFrame, span: int = SPAN) -> DataFrame:
    """End point of each shot on the ground image; shots without a direction are dotted aside."""
    numbered = positions(deliveries, VIDEO, "delivery_key", name="_idx", span=span)
    shot = F.lower(F.coalesce("shot_played", F.lit("")))
    angle = F.element_at(F.create_map(*[F.lit(x) for s, a in SHOT_ANGLES.items() for x in (s, math.radians(a))]), shot)
    runs = F.coalesce(F.col("runs"), F.lit(0))
    reach = F.least(F.when(runs > 0, 70 + runs * 40).otherwise(60), F.lit(235))
    aside = F.lit(20) + F.col("_idx") * 8
    flip = F.when(F.col("_idx") % 2 == 0, aside).otherwise(-aside)
    aimed = angle.isNotNull()
    return numbered.select(
        *VIDEO, "delivery_key",
        F.when(aimed, (F.lit(265) + reach * F.sin(angle)).cast("bigint")).otherwise(F.lit(265) + flip).alias("end_x"),
        F.when(aimed, (F.lit(263) - reach * F.cos(angle)).cast("bigint")).otherwise(F.lit(263) + div_floor(aside, 2)).alias("end_y"),
        F.when(F.col("is_wicket"), "wicket").when(runs >= 4, "boundary").otherwise("runs").alias("category"),
        F.when(aimed, F.concat(F.replace(shot, F.lit("_"), F.lit(" ")), F.lit(" ("), runs.cast("string"), F.lit("r)"))).alias("label"),
    )


def format_duration(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    """``1h 2m 3s``, leaving out leading zero parts."""
    h = F.floor(F.col(seconds) / 3600).cast("bigint")
    m = F.floor((F.col(seconds) % 3600) / 60).cast("bigint")
    s = F.floor(F.col(seconds) % 60).cast("bigint")
    part = lambda v, u: F.concat(v.cast("string"), F.lit(u))
    text = (
        F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s")))
        .when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))
    )
    return df.withColumn("duration", text)


def display_label(df: DataFrame, column: str, name: str = "display_label") -> DataFrame:
    """Underscores to spaces and the first letter of every word in upper case."""
    words = F.split(F.translate(column, "_", " "), r"(?<=\W)(?=\w)")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return df.withColumn(name, F.array_join(raised, ""))


def delivery_table(deliveries: DataFrame) -> DataFrame:
    """Rows of the deliveries table as shown."""

    def shown(column: str, suffix: str = "") -> Column:
        return F.when(F.col(column) != 0, F.concat(F.format_string("%.1f", column), F.lit(suffix))).otherwise("--")

    runs = F.coalesce(F.col("runs"), F.lit(0))
    wicket = F.col("is_wicket") | F.lower("outcome").contains("wicket")
    threat = F.upper(F.coalesce("threat_level", F.lit("LOW")))
    return deliveries.select(
        *VIDEO, "delivery_key", "over",
        F.concat(shown("release_speed_kmh"), F.lit(" / "), shown("bounce_speed_kmh"), F.lit(" km/h")).alias("speeds"),
        F.coalesce("line", F.lit("Middle")).alias("line"), F.coalesce("length", F.lit("Good Length")).alias("length"),
        F.coalesce(F.replace(F.col("shot_played"), F.lit("_"), F.lit(" ")), F.lit("N/A")).alias("shot"),
        F.when(wicket, "wicket").when(runs >= 4, "boundary").when(runs > 0, "runs").otherwise("dot").alias("outcome_class"),
        F.when(wicket, "WICKET").when(runs == 6, "SIX (6)").when(runs >= 4, "FOUR (4)")
        .when(runs > 0, F.concat(runs.cast("string"), F.lit(" Run"), F.when(runs > 1, "s").otherwise(""))).otherwise("Dot Ball").alias("outcome_text"),
        F.coalesce(F.format_string("%.1f%%", "decel_pct"), F.lit("--")).alias("deceleration"),
        F.coalesce(F.format_string("%.1f%%", "xd_pct"), F.lit("--")).alias("xd"),
        F.when(threat == "HIGH", "high").when(threat == "MEDIUM", "medium").otherwise("low").alias("xd_class"),
    )
