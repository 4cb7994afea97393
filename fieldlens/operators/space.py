"""Control of space: nearest-player shares of the court and the area a team covers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.constants import COURT_H, COURT_W
from fieldlens.functions.columns import convex_hull_area
from fieldlens.scale import SPAN, pyround, running, spread

FRAME = ["video_id", "frame_idx"]


def frame_teams(tracks: DataFrame, frames: DataFrame, span: int = SPAN) -> DataFrame:
    """Teams valid in each frame: those of the frame itself, or of the last frame that had any."""
    filled = tracks.select(*FRAME).distinct().withColumn("_src", F.col("frame_idx"))
    spine = frames.select(*FRAME).join(filled, FRAME, "left")
    source = running(spine, ["video_id"], "frame_idx", {"_from": ("last", F.col("_src"), True)}, span=span)
    teams = tracks.select("video_id", F.col("frame_idx").alias("_from"), "player_id", "team")
    return source.select(*FRAME, "_from").join(teams, ["video_id", "_from"]).drop("_from")


def valid_players(positions: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Positions on the court of players of team 1 or 2."""
    on_court = F.col("x").between(0, COURT_W) & F.col("y").between(0, COURT_H)
    teams = frame_teams(tracks, positions.select(*FRAME).distinct(), span)
    return positions.filter(on_court).join(teams, [*FRAME, "player_id"]).filter(F.col("team").isin(1, 2))


def team1_counts(xs: np.ndarray, ys: np.ndarray, team1: np.ndarray, step: int, cells: int = 1 << 22) -> np.ndarray:
    """Cells of the court grid nearest to team 1, one number per frame (frames x players); the first listed player wins a tie.

    Along a row of the grid the squared distances are parabolas of one width, so each player holds one stretch of their
    lower envelope, bounded by the crossings with all others: players x players a row, however fine the grid.  ``cells``
    bounds the crossings held at once.
    """
    n_frames, n = xs.shape
    columns, rows = len(range(0, COURT_W, step)), np.arange(0, COURT_H, step, dtype=np.float64)
    first = np.arange(n)[:, None] < np.arange(n)  # i is listed before j
    out = np.zeros(n_frames, dtype=np.int64)
    at_once = max(1, cells // (n * n * rows.size))
    for begin in range(0, n_frames, at_once):
        part = slice(begin, begin + at_once)
        x, y = xs[part], ys[part]
        right = (x[:, None, :] - x[:, :, None])[:, None]  # of j, seen from i
        height = x[:, None, :] ** 2 + (rows[:, None] - y[:, None, :]) ** 2
        higher = height[:, :, None, :] - height[:, :, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = higher / (2.0 * step * right)  # in columns; cells up to here belong to the left one of the two
        low = np.where(right < 0, np.where(first, np.ceil(cross), np.floor(cross) + 1), 0.0).max(axis=3)
        high = np.where(right > 0, np.where(first, np.floor(cross), np.ceil(cross) - 1), columns - 1.0).min(axis=3)
        behind = ((right == 0) & ((higher < 0) | ((higher == 0) & first.T))).any(axis=3)
        held = np.where(behind, 0, np.clip(np.minimum(high, columns - 1) - np.maximum(low, 0) + 1, 0, None))
        out[part] = (held * team1[part][:, None, :]).sum(axis=(1, 2))
    return out


def _nearest_counts(step: int):
    @F.pandas_udf(T.LongType())
    def team1_cells(xs: pd.Series, ys: pd.Series, teams: pd.Series) -> pd.Series:
        sizes = xs.str.len().to_numpy()
        counts = np.zeros(len(xs), dtype=np.int64)
        for size in np.unique(sizes):  # frames with as many players go together
            at = np.flatnonzero(sizes == size)
            x, y, team = (np.stack(v.iloc[at].to_numpy()) for v in (xs, ys, teams))
            counts[at] = team1_counts(x.astype(np.float64), y.astype(np.float64), team == 1, step)
        return pd.Series(counts)

    return team1_cells, len(range(0, COURT_W, step)) * len(range(0, COURT_H, step))


def voronoi_control(positions: DataFrame, tracks: DataFrame, step: int = 2, span: int = SPAN) -> DataFrame:
    """Share of the court nearest to each team per frame; 50/50 with fewer than two players.

    The players of a frame travel as one array; neither rows nor arrays of players x cells exist.
    """
    team1_cells, n_cells = _nearest_counts(step)
    spots = spread(valid_players(positions, tracks, span), *FRAME).groupBy(*FRAME).agg(
        F.array_sort(F.collect_list(F.struct("player_id", "x", "y", "team"))).alias("p")
    )
    frames = positions.select(*FRAME).distinct().join(spots, FRAME, "left")
    enough = F.size("p") >= 2
    field = {c: F.when(enough, F.col(f"p.{c}")).otherwise(F.array(F.lit(1).cast(t)))
             for c, t in (("x", "double"), ("y", "double"), ("team", "int"))}
    counted = frames.withColumns({"_enough": F.coalesce(enough, F.lit(False)), "_n1": team1_cells(field["x"], field["y"], field["team"])})
    share1 = F.when(F.col("_enough"), pyround(F.col("_n1") / n_cells * 100.0, 1)).otherwise(F.lit(50.0))
    share2 = F.when(F.col("_enough"), pyround((F.lit(n_cells) - F.col("_n1")) / n_cells * 100.0, 1)).otherwise(F.lit(50.0))
    shares = counted.select(*FRAME, share1.alias("team1_pct"), share2.alias("team2_pct"), F.col("_enough").alias("sampled"))
    return shares.withColumn(
        "dominant_team",
        F.when(F.col("team1_pct") > F.col("team2_pct"), 1).when(F.col("team2_pct") > F.col("team1_pct"), 2).otherwise(0),
    )


def match_dominance(control: DataFrame) -> DataFrame:
    """Mean of the sampled frame shares; 50 without a sample."""
    return control.groupBy("video_id").agg(*[
        F.coalesce(pyround(F.avg(F.when(F.col("sampled"), F.col(f"team{t}_pct"))), 1), F.lit(50.0)).alias(f"team{t}_avg_dominance_pct")
        for t in (1, 2)
    ])


def hull_area(positions: DataFrame, tracks: DataFrame, span: int = SPAN) -> DataFrame:
    """Square metres of the convex hull of each team in each frame; 0 below three points."""
    teams = spread(valid_players(positions, tracks, span), *FRAME).groupBy(*FRAME, "team").agg(F.collect_set(F.struct("x", "y")).alias("p"))
    return teams.select(*FRAME, "team", pyround(convex_hull_area("p") * (28.0 / COURT_W) * (15.0 / COURT_H), 1).alias("hull_area_m2"))
