"""Who is who: teams, officials, jerseys, roles and the merging of tracks of one player."""

from __future__ import annotations

from itertools import count

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.scale import SPAN, div_floor, durable, pyround, running

PLAYER = ["video_id", "player_id"]


def _top(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Best row per key.  ``df`` holds one pre-aggregated row per label, so groups stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def team_vote(tracks: DataFrame) -> DataFrame:
    """Most frequent team of each track; the team seen first wins a tie."""
    counts = tracks.groupBy(*PLAYER, "team").agg(F.count("*").alias("votes"), F.min("frame_idx").alias("_first"))
    return _top(counts, PLAYER, F.col("votes").desc(), F.col("_first")).drop("_first")


def official_filter(tracks: DataFrame, share: float = 0.25) -> DataFrame:
    """Flag tracks voted team 0 or marked as official in at least ``share`` of their frames."""
    marked = F.col("is_referee") | F.col("is_sideline") | (F.col("team") == 0)
    shares = tracks.groupBy(*PLAYER).agg(
        F.count("*").alias("frames"), F.count(F.when(marked, 1)).alias("official_frames")
    )
    joined = shares.join(team_vote(tracks).select(*PLAYER, "team"), PLAYER)
    official = (F.col("team") == 0) | (F.col("official_frames") / F.col("frames") >= share)
    return joined.withColumn("is_official", official)


def jersey_vote(tracks: DataFrame) -> DataFrame:
    """Most frequent all-digit jersey of each track; the one seen first wins a tie."""
    trimmed = tracks.withColumn("jersey", F.trim("jersey")).filter(F.col("jersey").rlike("^[0-9]+$"))
    counts = trimmed.groupBy(*PLAYER, "jersey").agg(F.count("*").alias("votes"), F.min("frame_idx").alias("_first"))
    return _top(counts, PLAYER, F.col("votes").desc(), F.col("_first")).drop("_first")


def ghost_filter(track_stats: DataFrame) -> DataFrame:
    """Drop short tracks that hardly moved (frames, dist_m, speed_samples)."""
    ghost = (
        (F.col("frames") > 0) & (F.col("frames") < 10) & (F.col("dist_m") < 1.0) & (F.col("speed_samples") < 5)
    )
    return track_stats.filter(~ghost)


def overlap_tracks(tracks: DataFrame) -> DataFrame:
    """Common frames of tracks with the same team and jersey; more than 10 is a conflict.

    ``tracks`` (video, frame, player, team, jersey) carries the voted team and jersey of each track.
    Only the few tracks that share a jersey meet in a frame.
    """
    left = tracks.filter("jersey IS NOT NULL").select("video_id", "frame_idx", "team", "jersey", F.col("player_id").alias("player_a"))
    right = left.withColumnRenamed("player_a", "player_b")
    pairs = left.join(right, ["video_id", "frame_idx", "team", "jersey"]).filter("player_a < player_b")
    return pairs.groupBy("video_id", "team", "jersey", "player_a", "player_b").agg(
        F.count("*").alias("common_frames")
    ).withColumn("conflict", F.col("common_frames") > 10)


def consolidate_players(track_stats: DataFrame, overlaps: DataFrame, max_overlap: int = 10) -> DataFrame:
    """Merge tracks of one (team, jersey) that are never on court together.

    Tracks join the group in order of their jersey votes unless they overlap with a member; the others stand
    alone without jersey.  ``track_stats``: team, jersey, jersey_votes, frames, dist_m, speed_sum,
    speed_samples, max_speed.  The fold runs over the handful of tracks of one jersey, not over frames.
    """
    clash = overlaps.filter(F.col("common_frames") > max_overlap)
    both = clash.select("video_id", F.col("player_a").alias("player_id"), F.col("player_b").alias("other")).unionByName(
        clash.select("video_id", F.col("player_b").alias("player_id"), F.col("player_a").alias("other"))
    )
    rivals = both.groupBy(*PLAYER).agg(F.collect_set("other").alias("rivals"))
    tracks = track_stats.join(rivals, PLAYER, "left").withColumn(
        "rivals", F.coalesce("rivals", F.array().cast("array<bigint>"))
    )
    named = tracks.filter("jersey IS NOT NULL").groupBy("video_id", "team", "jersey").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("jersey_votes")).alias("o"), "player_id", "rivals"))).alias("t")
    )
    members = F.aggregate(
        "t", F.array().cast("array<bigint>"),
        lambda acc, tr: F.when(F.arrays_overlap(acc, tr["rivals"]), acc).otherwise(F.array_append(acc, tr["player_id"])),
    )
    merged = named.select("video_id", "team", "jersey", members.alias("members")).select(
        "video_id", F.explode("members").alias("player_id"), F.lit(True).alias("_in")
    )
    grouped = tracks.drop("rivals").join(merged, PLAYER, "left")
    jersey = F.when(F.col("_in"), F.col("jersey"))
    alone = F.when(F.col("_in").isNull(), F.col("player_id"))
    grouped = grouped.withColumns({"_jersey": jersey, "_alone": alone})
    first = F.min(F.struct((-F.col("frames")).alias("o"), "player_id"))
    total = grouped.groupBy("video_id", "team", "_jersey", "_alone").agg(
        first["player_id"].alias("player_id"),
        F.array_sort(F.collect_list("player_id")).alias("track_ids"),
        pyround(F.sum("dist_m"), 1).alias("total_distance_m"),
        F.sum("speed_sum").alias("_sum"), F.sum("speed_samples").alias("_n"), F.max("max_speed").alias("_max"),
    )
    return total.select(
        "video_id", "player_id", "team", F.col("_jersey").alias("jersey_number"), "track_ids",
        F.coalesce(F.concat(F.lit("#"), F.col("_jersey")), F.concat(F.lit("Track #"), F.col("player_id").cast("string"))).alias("display_label"),
        "total_distance_m",
        F.when(F.col("_n") > 0, pyround(F.col("_sum") / F.col("_n"), 1)).otherwise(F.lit(0.0)).alias("avg_speed_kmh"),
        F.when(F.col("_n") > 0, pyround(F.col("_max"), 1)).otherwise(F.lit(0.0)).alias("max_speed_kmh"),
    )


def union_all_tracks(votes: DataFrame, distances: DataFrame, speeds: DataFrame) -> DataFrame:
    """Every track known from any of the three."""
    return votes.select(*PLAYER).union(distances.select(*PLAYER)).union(speeds.select(*PLAYER)).distinct()


def referee_match(
    tracks: DataFrame, detections: DataFrame, frames: DataFrame, conf: float = 0.35, share: float = 0.015,
    votes: int = 3, span: int = SPAN,
) -> DataFrame:
    """Referee boxes matched to the closest player centre, with the running votes of that player.

    Centres are hashed to grid cells as wide as the match radius, so a box meets only the players of the
    nine cells around it, never all players of the frame.  ``is_referee`` holds once the votes are reached.
    """
    radius = F.col("width") * F.lit(share)

    def centers(df: DataFrame, ident: str) -> DataFrame:
        sized = df.join(frames.select("video_id", "frame_idx", "width"), ["video_id", "frame_idx"])
        cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        return sized.select(
            "video_id", "frame_idx", ident, cx.alias(f"{ident}_x"), cy.alias(f"{ident}_y"), radius.alias("_r"),
            F.floor(cx / radius).alias("_gx"), F.floor(cy / radius).alias("_gy"),
        )

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    boxes = centers(detections.filter((F.col("cls") == "referee") & (F.col("conf") >= conf)), "det_id")
    boxes = boxes.withColumn("_o", F.explode(around)).withColumns(
        {"_gx": F.col("_gx") + F.col("_o.i"), "_gy": F.col("_gy") + F.col("_o.j")}
    ).drop("_o")
    players = centers(tracks, "player_id").drop("_r")
    dx, dy = F.col("player_id_x") - F.col("det_id_x"), F.col("player_id_y") - F.col("det_id_y")
    pairs = boxes.join(players, ["video_id", "frame_idx", "_gx", "_gy"]).withColumn("dist2", dx * dx + dy * dy)
    near = pairs.filter(F.col("dist2") < F.col("_r") * F.col("_r"))
    best = near.groupBy("video_id", "frame_idx", "det_id").agg(F.min(F.struct("dist2", "player_id")).alias("b"))
    matches = best.select("video_id", "frame_idx", "det_id", F.col("b.player_id").alias("player_id"))
    counted = running(
        matches, PLAYER, "frame_idx", {"vote_no": ("sum", F.lit(1).cast("bigint"), True)}, ties=["det_id"], span=span
    )
    return counted.withColumn("is_referee", F.col("vote_no") >= votes)


def referee_tracks(tracks: DataFrame, matches: DataFrame, batch_size: int = 250) -> DataFrame:
    """Tracks with the flag that ``referee_match`` decides: set from the first frame of the batch in which the votes are reached."""
    decided = matches.filter("is_referee").groupBy(*PLAYER).agg(F.min("frame_idx").alias("_decided"))  # one row per referee
    start = div_floor(F.col("_decided"), batch_size) * batch_size
    flagged = F.coalesce(F.col("frame_idx") >= start, F.lit(False))
    return tracks.join(decided, PLAYER, "left").withColumn("is_referee", F.col("is_referee") | flagged).drop("_decided")


def running_team_votes(votes: DataFrame, every: int = 5, span: int = SPAN) -> DataFrame:
    """Running team of a track from every ``every``-th frame of it; team 1 without votes and on a tie."""
    numbered = running(votes, PLAYER, "frame_idx", {"_n": ("sum", F.lit(1).cast("bigint"), True)}, span=span, keep=True)
    checked = (F.col("_n") - 1) % every == 0
    counts = {
        f"votes_{k}": ("sum", (checked & (F.col("team") == k)).cast("bigint"), True) for k in (1, 2)
    }
    counted = running(numbered, PLAYER, "frame_idx", counts, span=span)
    return counted.select(
        "video_id", "frame_idx", "player_id", "votes_1", "votes_2",
        F.when(F.col("votes_1") >= F.col("votes_2"), 1).otherwise(2).alias("current_team"),
    )


def role_votes(tracks: DataFrame, batch: int = 250) -> DataFrame:
    """Keeper, batsman and bowler per video from the order of median foot positions in each batch."""
    medians = tracks.withColumn("_batch", div_floor(F.col("frame_idx"), batch)).groupBy("video_id", "_batch", "player_id").agg(
        F.percentile("y2", 0.5).alias("_med"), F.count("*").alias("_n")
    )
    keys = ["video_id", "_batch"]
    down = Window.partitionBy(*keys).orderBy(F.col("_med").desc(), "player_id")
    up = Window.partitionBy(*keys).orderBy(F.col("_med"), "player_id")
    ranked = medians.withColumns({
        "_down": F.row_number().over(down), "_up": F.row_number().over(up),
        "_players": F.count("*").over(Window.partitionBy(*keys)),
    })
    # the bowler is the lowest median among those that are neither keeper nor batsman
    rest = F.min(F.when(F.col("_down") > 2, F.col("_up"))).over(Window.partitionBy(*keys))
    ranked = ranked.withColumn("_rest", rest)
    role = (
        F.when((F.col("_players") == 1) | (F.col("_down") == 2), "batsman")
        .when(F.col("_down") == 1, "wicketkeeper")
        .when(F.col("_up") == F.col("_rest"), "bowler")
    )
    cast = ranked.withColumn("role", role).filter("role IS NOT NULL")
    votes = cast.groupBy(*PLAYER, "role").agg(F.sum("_n").cast("bigint").alias("votes"), F.min("_batch").alias("_first"))
    return _top(votes, PLAYER, F.col("votes").desc(), F.col("_first"), F.col("role")).drop("_first")


def jersey_ocr_votes(
    readings: DataFrame, min_prob: float = 0.35, accept: float = 0.8, lock: float = 1.5, attempts: int | None = 10,
    stride: int = 5, officials: DataFrame | None = None, span: int = SPAN,
) -> DataFrame:
    """Jersey known after each reading attempt of a track, and whether it is locked.

    Every ``stride``-th sighting is read, ``attempts`` times at most (``None``: always); probabilities add up per text.  Scores
    only grow, so the best text so far is a running maximum.  Sightings in ``officials`` (video, frame, player) are skipped.
    """
    at = [*PLAYER, "frame_idx"]
    one = F.lit(1).cast("bigint")
    if officials is not None:
        readings = readings.join(officials.select(*at).distinct(), at, "left_anti")
    seen = readings.groupBy(*at).agg(F.collect_list(F.struct("text", "prob")).alias("_reads"))
    numbered = running(seen, PLAYER, "frame_idx", {"_n": ("sum", one, True)}, span=span)
    due = (F.col("_n") - 1) % stride == 0
    tries = numbered.filter(due & (F.col("_n") <= stride * attempts) if attempts else due).withColumn(
        "attempt", F.floor((F.col("_n") - 1) / stride).cast("int") + 1
    )
    texts = tries.select(*at, "attempt", F.explode("_reads").alias("_r")).select(
        *at, "attempt", F.trim("_r.text").alias("text"), F.col("_r.prob").alias("prob")
    )
    valid = texts.filter((F.col("prob") > min_prob) & F.col("text").rlike("^[0-9]{1,2}$"))
    added = valid.groupBy(*at, "text").agg(F.sum("prob").alias("_add"), F.min("attempt").alias("_at"))
    sums = running(added, [*PLAYER, "text"], "frame_idx", {"_sum": ("sum", F.col("_add"), True), "_first": ("min", F.col("_at"), True)}, span=span)
    sums = sums.withColumn("score", pyround(F.col("_sum"), 9)).filter(F.col("score") >= accept)
    best = sums.groupBy(*at).agg(F.max(F.struct("score", (-F.col("_first")).alias("f"), "text")).alias("_best"))
    state = tries.select(*at, "attempt").join(best, at, "left")
    crossed = F.when(F.col("_b.score") >= lock, F.struct("attempt", F.col("_b.text").alias("text")))
    state = running(state, PLAYER, "frame_idx", {"_b": ("max", F.col("_best"), True)}, span=span)
    # once locked, later attempts are skipped: the first locked attempt decides
    state = running(state, PLAYER, "frame_idx", {"_lock": ("min", crossed, True)}, span=span)
    return state.select(
        *at, "attempt", F.coalesce("_lock.text", "_b.text").alias("jersey"), F.col("_lock").isNotNull().alias("locked"),
    )


def _dist2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


WIDELY = 4096  # videos whose pairs of centres are sent to all tasks


def team_colors(samples: DataFrame, max_iter: int | None = None, components: int | None = None) -> DataFrame:
    """Two clusters of colour or embedding samples per video and the team each player's samples vote for.

    ``samples``: video_id, player_id, sample_id, features array.  All videos are clustered by the same few jobs:
    each round joins the samples with the two centres of their video and averages them again, pre-aggregated on
    the map side.  The centres of up to ``WIDELY`` videos are broadcast, so a round shuffles no samples; those of more are joined by video.  The first centre is the sample farthest from the video's mean, the second the one farthest
    from the first.  Rounds go on until no centre moves, or for ``max_iter``.  Team 1 is the centre that comes first in order.  ``components`` projects the embeddings of
    all videos first.
    """
    rows = samples.select(*PLAYER, "sample_id", F.col("features").cast("array<double>").alias("_f"))
    if components:
        vectors = rows.withColumn("_v", array_to_vector("_f"))
        fitted = PCA(k=components, inputCol="_v", outputCol="_low").fit(vectors)
        rows = durable(fitted.transform(vectors).select(*PLAYER, "sample_id", vector_to_array("_low").alias("_f")))

    def mean(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(Summarizer.mean(array_to_vector("_f")).alias("_m")).withColumn("_m", vector_to_array("_m"))

    def farthest(df: DataFrame, origin: str, name: str) -> DataFrame:
        order = F.struct(_dist2(F.col("_f"), F.col(origin)).alias("d"), (-F.col("sample_id")).alias("s"))
        return df.groupBy("video_id").agg(F.max_by("_f", order).alias(name))

    middle = durable(mean(rows, "video_id"))
    few = middle.count() <= WIDELY  # then the centres go to the samples, which stay where they lie in every round

    def beside(df: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(df) if few else df, "video_id")

    start = durable(farthest(beside(middle), "_m", "_c1"))
    second = farthest(beside(start), "_c1", "_c2")
    centers = durable(start.join(second, "video_id"))
    nearest = F.when(_dist2(F.col("_f"), F.col("_c1")) < _dist2(F.col("_f"), F.col("_c2")), 1).otherwise(2)
    for _ in count() if max_iter is None else range(max_iter):
        means = mean(beside(centers).select("video_id", "_f", nearest.alias("_t")), "video_id", "_t")
        pair = means.groupBy("video_id").agg(*[F.first(F.when(F.col("_t") == t, F.col("_m")), ignorenulls=True).alias(f"_n{t}") for t in (1, 2)])
        moved = durable(centers.join(pair, "video_id").select(
            "video_id", *[F.coalesce(f"_n{t}", f"_c{t}").alias(f"_c{t}") for t in (1, 2)],
            (_dist2(F.coalesce("_n1", "_c1"), F.col("_c1")) + _dist2(F.coalesce("_n2", "_c2"), F.col("_c2"))).alias("_shift")))
        centers = moved.drop("_shift")
        if moved.filter("_shift > 1e-12D").isEmpty():
            break
    ordered = centers.select("video_id", F.least("_c1", "_c2").alias("_c1"), F.greatest("_c1", "_c2").alias("_c2"))
    votes = beside(ordered).select(*PLAYER, nearest.alias("team")).groupBy(*PLAYER).agg(
        F.count(F.when(F.col("team") == 1, 1)).alias("votes_1"), F.count(F.when(F.col("team") == 2, 1)).alias("votes_2")
    )
    return votes.withColumn("team", F.when(F.col("votes_1") >= F.col("votes_2"), 1).otherwise(2))


def ball_select(detections: DataFrame) -> DataFrame:
    """The ball box with the highest confidence of each frame; the first wins a tie."""
    others = [c for c in detections.columns if c not in ("video_id", "frame_idx", "det_id", "conf", "cls")]
    order = F.struct((-F.col("conf")).alias("o"), "det_id", *others)
    best = detections.filter((F.col("cls") == "ball") & (F.col("conf") > 0)).groupBy("video_id", "frame_idx").agg(
        F.min(order).alias("b")
    )
    return best.select("video_id", "frame_idx", F.col("b.det_id"), *[F.col(f"b.{c}") for c in others], (-F.col("b.o")).alias("conf"))
