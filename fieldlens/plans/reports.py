"""Whole-match reports composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import court, cricket as ck, identity as ident, possession as poss, registration as rg, shots, space
from fieldlens.scale import durable, pyround
from fieldlens.sources.sinks import label_counts


def track_stats(tracks: DataFrame, positions: DataFrame, fps: float = 30.0) -> DataFrame:
    """One row per track of a player (officials and ghosts left out) with team, jersey, distance and speed sums."""
    steps = court.player_step_distance(positions)
    speeds = court.player_speed(steps, fps)
    moved = steps.groupBy(*ident.PLAYER).agg(F.sum("dist_m").alias("dist_m"))
    fast = speeds.filter("speed_kmh > 0").groupBy(*ident.PLAYER).agg(
        F.sum("speed_kmh").alias("speed_sum"), F.count("*").alias("speed_samples"), F.max("speed_kmh").alias("max_speed"))
    players = ident.official_filter(tracks).filter("NOT is_official AND team IN (1, 2)").select(*ident.PLAYER, "team", "frames")
    jersey = ident.jersey_vote(tracks).withColumnRenamed("votes", "jersey_votes")
    stats = (
        players.join(moved, ident.PLAYER, "left").join(fast, ident.PLAYER, "left").join(jersey, ident.PLAYER, "left")
        .fillna(0, ["dist_m", "speed_sum", "speed_samples", "max_speed"])
    )
    return ident.ghost_filter(stats)


def report_players(tracks: DataFrame, positions: DataFrame, fps: float = 30.0) -> DataFrame:
    stats = durable(track_stats(tracks, positions, fps))  # one row per track, used three times
    voted = tracks.select("video_id", "frame_idx", "player_id").join(stats.select(*ident.PLAYER, "team", "jersey"), ident.PLAYER)
    return ident.consolidate_players(stats, ident.overlap_tracks(voted))


def heat_grid(tracks: DataFrame, positions: DataFrame, totals: DataFrame, fps: float = 30.0, cell_px: int = 1) -> DataFrame:
    """Heat cells of a match; merged players who hardly move are left out."""
    stats = report_players(tracks, positions, fps).select(
        "video_id", F.explode("track_ids").alias("player_id"), "total_distance_m", "avg_speed_kmh")
    return court.heatmap_grid(court.heatmap_point_filter(positions, tracks), ident.team_vote(tracks), stats, totals, cell_px)


def basketball_report(
    tracks: DataFrame, ball: DataFrame, positions: DataFrame, frames: DataFrame, modes: DataFrame, fps: float = 30.0
) -> DataFrame:
    """One row per video: team blocks, dominance, shots and continuity."""
    holders = durable(poss.possession(poss.holder_candidates(tracks, ball), frames))  # used twice
    shares = poss.possession_summary(holders, tracks)
    moves = poss.pass_summary(poss.ball_moves(holders, tracks))
    dominance = space.match_dominance(space.voronoi_control(positions, tracks))
    shot_count = shots.shot_frames(shots.shot_state(ball, frames))
    continuity = rg.tracking_continuity(modes)
    base = frames.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    full = base
    for part in (shares, moves, dominance, shot_count, continuity.drop("total_frames")):
        full = full.join(part, "video_id", "left")

    def team(t: int) -> Column:
        return F.struct(
            F.coalesce(f"team{t}_pct", F.lit(0.0)).alias("possession_pct"), F.coalesce(f"team{t}_passes", F.lit(0)).alias("total_passes"),
            F.coalesce(f"team{t}_interceptions", F.lit(0)).alias("total_interceptions"))

    return full.select(
        "video_id", "total_frames", pyround(F.col("total_frames") / fps, 1).alias("duration_seconds"), F.lit(fps).alias("fps"),
        F.struct(team(1).alias("team_1"), team(2).alias("team_2")).alias("team_stats"),
        F.struct(*[F.coalesce(c, F.lit(50.0)).alias(c) for c in ("team1_avg_dominance_pct", "team2_avg_dominance_pct")]).alias("spatial_dominance_stats"),
        F.col("shot_events").alias("shot_events_detected"),
        F.struct(*[F.coalesce(c, F.lit(d)).alias(c) for c, d in (
            ("direct_keypoint_pct", 100.0), ("optical_flow_cmc_pct", 0.0), ("overall_continuity_pct", 100.0), ("lost_frames_pct", 0.0))]).alias("tracking_continuity_stats"),
    )


def cricket_report(deliveries: DataFrame, highlights: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video: metadata, summary and label counts.  ``deliveries`` carry line and length."""
    summary = ck.match_summary(deliveries)
    moments = highlights.groupBy("video_id").agg(F.count("*").alias("n"))
    joined = (
        summary.join(moments, "video_id", "left").join(videos, "video_id", "left")
        .join(label_counts(ck.distribution(deliveries, ["line", "length", "shot_played"])), "video_id", "left")
    )
    return joined.select(
        "video_id", F.struct(F.lit("cricket").alias("sport"), "fps", "total_frames").alias("metadata"),
        F.struct(
            "total_deliveries", "overs", "estimated_runs", "wickets", "fours", "sixes", "dot_balls", "dot_ball_pct",
            F.coalesce("n", F.lit(0)).alias("audio_visual_highlights_count"),
            F.struct(F.col("fastest_kmh").alias("fastest_delivery"), F.col("slowest_kmh").alias("slowest_delivery"),
                     F.col("average_kmh").alias("average_delivery")).alias("speed_analysis_kmh"),
        ).alias("summary"),
        "tactical_distributions",
    )
