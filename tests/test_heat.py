"""Heat per pixel against dense numpy arrays."""

import numpy as np
import pytest

from fieldlens.operators import court
from fieldlens.plans import all_queries
from fieldlens.sources import adapters


def dense(points, sigma, pct=98):
    """Whole canvas at once, with numpy's own mirrored padding and percentile."""
    counts = np.zeros((1500, 2800))
    for x, y, n in points:
        counts[y, x] += n
    r = int(np.ceil(4 * sigma))
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    w /= w.sum()
    padded = np.pad(counts, r, mode="reflect")
    wide = np.zeros((padded.shape[0], 2800))
    for y in np.flatnonzero(padded.any(1)):
        wide[y] = np.convolve(padded[y], w, "valid")
    heat = np.stack([np.convolve(wide[:, x], w, "valid") for x in range(2800)], axis=1)
    return heat, np.percentile(heat[heat > 0], pct)


@pytest.mark.parametrize("sigma, points", [
    (65.0, [(15, 15, 3), (2784, 1484, 1), (1400, 750, 7), (16, 1480, 2), (300, 20, 1)]), (3.0, [(0, 0, 5), (2799, 700, 2), (77, 1499, 1)]),
])
def test_heat_per_pixel(spark, sigma, points):
    rng = np.random.default_rng(0)
    if sigma > 10:
        points = points + [(int(x), int(y), 1) for x, y in zip(rng.integers(15, 2785, 60), rng.integers(15, 1485, 60))]
    grid = spark.createDataFrame(
        [(1, "match", x, y, n) for x, y, n in points] + [(2, "team_1", 500, 500, 4)], "video_id bigint, layer string, cell_x bigint, cell_y bigint, n bigint")
    heat, top = dense(points, sigma)
    want = np.clip(heat / top, 0, 1)
    stencil = court.HeatStencil(sigma, 1, 300)
    found = {r["video_id"]: r["top"] for r in court._heat_ranks(stencil.strips(grid), stencil, 0.98).collect()}
    assert found[1] == pytest.approx(top, rel=1e-12)
    levels = court.heatmap_levels(grid, sigma).filter("video_id = 1").toPandas().set_index("level")
    assert levels.cells.sum() == (heat > 0).sum()
    alpha = np.where(want >= 0.05, np.minimum(0.7, 0.2 + 0.5 * (want - 0.05) / 0.95), 0)
    assert levels.alpha.sum() == pytest.approx(alpha.sum(), rel=1e-9)
    assert abs(np.bincount((want[heat > 0] * 255).astype(int), minlength=256)[levels.index] - levels.cells).max() <= 20
    if sigma < 10:
        got = court.heatmap_density(grid, sigma).filter("video_id = 1").toPandas()
        assert len(got) == (heat > 0).sum()
        assert np.allclose(got.density, want[got.cell_y, got.cell_x], rtol=1e-9) and np.allclose(got.alpha, alpha[got.cell_y, got.cell_x])


def test_percentile_at_any_rank(spark):
    grid = spark.createDataFrame([(1, "m", 100 + 3 * k, 200 + k, 1 + k % 3) for k in range(5)], "video_id bigint, layer string, cell_x bigint, cell_y bigint, n bigint")
    stencil = court.HeatStencil(2.0, 1, 4)  # strips of a few lines
    heat = dense([(100 + 3 * k, 200 + k, 1 + k % 3) for k in range(5)], 2.0)[0]
    for pct in (0.0, 0.31, 0.5, 1.0):
        top = court._heat_ranks(stencil.strips(grid), stencil, pct).first()["top"]
        assert top == pytest.approx(np.percentile(heat[heat > 0], pct * 100), rel=1e-12)


def test_a_layer_is_smoothed_once(spark):
    """The percentile comes from the same heat as the map: no rounds of jobs over all layers, one step of Python."""
    points = [(1, "match", 40 + 3 * k, 30 + 2 * k, 1 + k % 4) for k in range(9)] + [(None, "match", 5, 70, 2)]
    grid = spark.createDataFrame(points, "video_id bigint, layer string, cell_x bigint, cell_y bigint, n bigint")
    spark.sparkContext.setJobGroup("heat", "heat")
    try:
        maps = [court.heatmap_levels(grid, cell_px=20), court.heatmap_density(grid, cell_px=20)]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("heat")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for found in maps:
        assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups") == 1
    levels, cells = (m.toPandas() for m in maps)
    assert levels.cells.sum() == len(cells) and (cells.video_id.isna()).sum() == levels[levels.video_id.isna()].cells.sum() > 0
    assert levels.alpha.sum() == pytest.approx(cells.alpha.sum(), rel=1e-9)


def test_percentile_equals_numpys_at_any_size():
    rng = np.random.default_rng(5)
    for heat in (np.ones((3, 5)), rng.random((70, 80)), np.sort(rng.random(9000)).reshape(90, 100), np.where(rng.random((200, 300)) < 0.01, 2.5, 0.0), np.eye(1, 7)):
        for pct in (0.0, 0.4, 0.98, 1.0):
            assert court.heat_top(heat, pct) == pytest.approx(np.percentile(heat[heat > 0], pct * 100), rel=1e-12)


@pytest.mark.parametrize("sigma", [65.0, 3.0])
def test_lines_hold_every_warm_pixel(spark, sigma):
    """Many runs in a line, cold lines, a run along each border, a whole warm line, a layer whose video is not known."""
    points = [(0, 0, 5), (20, 0, 1), (2799, 700, 2), (77, 1499, 1), (400, 700, 1), (404, 703, 3), (900, 700, 1)] + [(x, 1200, 1) for x in range(0, 2800, 9)]
    grid = spark.createDataFrame(
        [(1, "match", x, y, n) for x, y, n in points] + [(None, "match", 5, 70, 2)], "video_id bigint, layer string, cell_x bigint, cell_y bigint, n bigint")
    runs = court.heatmap_lines(grid, sigma)
    found = runs.filter("video_id = 1").toPandas()
    heat, top = dense(points, sigma)
    want = np.clip(heat / top, 0, 1)
    alpha = np.where(want >= 0.05, np.minimum(0.7, 0.2 + 0.5 * (want - 0.05) / 0.95), 0)
    density, opacity, seen = np.zeros(want.shape), np.zeros(want.shape), np.zeros(want.shape, int)
    for y, x, d, a in zip(found.cell_y, found.cell_x, found.density, found.alpha):
        assert len(d) == len(a) > 0
        density[y, x : x + len(d)], opacity[y, x : x + len(a)] = d, a
        seen[y, x : x + len(d)] += 1
    assert (seen == (heat > 0)).all()
    assert np.allclose(density, want, rtol=1e-6, atol=1e-12)
    steep = abs(want - 0.05) > 1e-6  # there the opacity jumps
    assert np.allclose(opacity[steep], alpha[steep], rtol=1e-6)
    assert runs.filter("video_id IS NULL").selectExpr("sum(size(density))").first()[0] > 0


def test_lines_are_the_cells_of_the_map(spark):
    grid = spark.createDataFrame([(1, "team_1", 40 + 3 * k, 30 + 2 * k, 1 + k % 4) for k in range(9)], "video_id bigint, layer string, cell_x bigint, cell_y bigint, n bigint")
    at = {(r.cell_y, r.cell_x + i): v for r in court.heatmap_lines(grid, cell_px=20).collect() for i, v in enumerate(zip(r.density, r.alpha))}
    cells = court.heatmap_density(grid, cell_px=20).collect()
    assert len(at) == len(cells) > 0
    assert all(at[r.cell_y, r.cell_x] == pytest.approx((r.density, r.alpha), rel=1e-6) for r in cells)


def test_query_gives_the_whole_map(spark, monkeypatch):
    """Of a video of two players, the density and opacity of each pixel, not only how many have which."""
    made = {
        "tracks": spark.createDataFrame(
            [(3, f, p, 1 + p, False, False, None) for f in range(12) for p in (0, 1)],
            "video_id bigint, frame_idx bigint, player_id bigint, team int, is_referee boolean, is_sideline boolean, jersey string"),
        "positions": spark.createDataFrame(
            [(3, f, p, 20.0 + 150 * p, 30.0 + 2 * f) for f in range(12) for p in (0, 1)], "video_id bigint, frame_idx bigint, player_id bigint, x double, y double"),
        "videos": spark.createDataFrame([(3, 12)], "video_id bigint, total_frames bigint"),
    }
    monkeypatch.setattr(adapters, "load", lambda spark, folder, name: made[name])
    found = all_queries()["heatmap_density"](spark, "").toPandas()
    assert set(found.layer) == {"team_1", "team_2", "match"}
    for layer, players in (("team_1", [0]), ("team_2", [1]), ("match", [0, 1])):
        points = [(int((20 + 150 * p) / 200 * 2800), int((30 + 2 * f) / 107 * 1500), 1) for f in range(12) for p in players]
        heat, top = dense(points, 65.0)
        density, seen = np.zeros(heat.shape), np.zeros(heat.shape, bool)
        for r in found[found.layer == layer].itertuples():
            density[r.cell_y, r.cell_x : r.cell_x + len(r.density)] = r.density
            seen[r.cell_y, r.cell_x : r.cell_x + len(r.density)] = True
        assert (seen == (heat > 0)).all() and np.allclose(density, np.clip(heat / top, 0, 1), rtol=1e-6, atol=1e-12)
