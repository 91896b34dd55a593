"""Operators against hand-made vectors and folds in plain Python."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from retinaspark.functions import render
from retinaspark.functions.camera import Camera
from retinaspark.functions.units import duration_us, infer_unit, scale_us
from retinaspark.operators import augment, features, feast, filters, frames, masks, motion, represent, simulate, track, transforms
from retinaspark.plans.dataset import EventReader, Slicing, open_stream
from retinaspark.sources.files import from_numpy


def stream(spark, rows, size=(4, 3)):
    return from_numpy(spark, np.array(rows, float).reshape(-1, 4), sensor_size=size)


def rows(s):
    return [tuple(r) for r in s.df.orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).collect()]


SAMPLE = [(0, 0, 10, 1), (1, 1, 20, 0), (2, 2, 30, 1), (3, 0, 40, 0)]


def test_flips_turn_back(spark):
    s = stream(spark, SAMPLE)
    assert rows(transforms.flip_x(transforms.flip_x(s))) == rows(s)
    assert rows(transforms.flip_y(transforms.flip_y(s))) == rows(s)
    t = s
    for _ in range(4):
        t = transforms.rotate90(t)
    assert rows(t) == rows(s) and t.sensor_size == s.sensor_size


def test_rotate_and_crop(spark):
    s = stream(spark, SAMPLE)
    assert rows(transforms.rotate90(s)) == [(2, 0, 10, 1), (1, 1, 20, 0), (0, 2, 30, 1), (2, 3, 40, 0)]
    assert rows(transforms.crop(s, 1, 0, 3, 2)) == [(0, 1, 20, 0), (2, 0, 40, 0)]
    assert transforms.resize(s, 0, 3).df.count() == 0


def test_time_and_order(spark):
    s = stream(spark, [(0, 0, t, 1) for t in (130, 100, 150, 110, 140, 120)])
    assert [r[2] for r in rows(transforms.time_window(s, 110, 140))] == [130, 110, 120]
    assert [r[2] for r in rows(transforms.sort_by_time(s))] == [100, 110, 120, 130, 140, 150]
    assert [r[2] for r in rows(transforms.normalize_time(s))] == [30, 0, 50, 10, 40, 20]
    assert [r[2] for r in rows(transforms.decimate(s, 4))] == [130, 140]


def test_concat(spark):
    a, b = stream(spark, SAMPLE), stream(spark, [(5, 1, 1, 1)], (6, 2))
    c = transforms.concat(a, [b])
    assert rows(c) == [*SAMPLE, (5, 1, 1, 1)] and c.sensor_size == (6, 3)


def test_voxel_micro(spark):
    s = stream(spark, [(0, 0, 0, 1), (0, 0, 15000, 0), (1, 0, 30000, 1)], (2, 1))
    assert frames.numpy(represent.voxel(s, 3, 30.0)).ravel().tolist() == [1, 0, -1, 0, 0, 1]


def test_percentile_and_countmask(spark):
    assert spark.sql("select percentile(v, 0.99) from values 1,2,3,4,7 t(v)").first()[0] == pytest.approx(6.88)
    s = stream(spark, [(x, y, 1, 1) for x in range(4) for y in range(3)] + [(0, 0, 2, 1)], (4, 3))
    data = frames.numpy(represent.countmask(s, 100))
    assert data[0, 0, 0] == 255 and data[0, 1, 1] == 127 and (data[1] == 255).all()


def test_tencode_takes_the_last_of_equal_times(spark):
    s = stream(spark, [(0, 0, 5, 1), (0, 0, 5, 0)], (1, 1))
    assert frames.numpy(represent.tencode(s, 1.0)).ravel().tolist() == [0, 0, 255]


def test_empty_stream(spark):
    s = stream(spark, np.zeros((0, 4)))
    for name in ("binary", "count", "polarity", "voxel", "tsurf", "atsurf", "tencode", "countmask", "mcts"):
        assert represent.flatten(s, name).df.count() == 0
    assert represent.redblue(s).df.where("value = 255").count() == 36  # an empty picture is white
    assert represent.event_rate(s).count() == 0
    assert filters.hot_pixel_filter(s).df.count() == 0


def shape(n=20, size=40):
    """A square that moves right and down: ON in front, OFF behind."""
    out, t = [], 0
    for k in range(n):
        for i in range(8):
            out += [(k + 8, k + i, t, 1), (k + i, k + 8, t, 1), (k, k + i, t, 0), (k + i, k, t, 0)]
        t += 100
    return [r for r in out if r[0] < size and r[1] < size]


def test_background_activity_is_the_fold(spark):
    ev, dt = shape(10), 150
    for name, near in (("block", filters.BLOCK), ("cross", filters.CROSS)):
        last, want = {}, []
        for e in ev:
            if any(e[2] - last.get((e[0] + dx, e[1] + dy), -1e18) <= dt for dx, dy in near):
                want.append(e)
            last[e[0], e[1]] = e[2]
        assert rows(filters.background_activity_filter(stream(spark, ev, (40, 40)), dt, name)) == want


def test_background_activity_sends_no_copies_for_neighbours(spark):
    ev = [(2 + k % 2, 0, k * 10 + 50_000 * (k // 500), 1) for k in range(4000)] + [(3, 1, 400_001, 0), (0, 2, 400_002, 0)]
    last, want = {}, []
    for e in ev:
        if any(e[2] - last.get((e[0] + dx, e[1] + dy), -1e18) <= 30_000 for dx, dy in filters.BLOCK):
            want.append(e)
        last[e[0], e[1]] = e[2]
    s = leaping(stream(spark, ev, (4, 3)))
    assert len(want) > 3000 and rows(filters.background_activity_filter(s, 30_000)) == want
    assert records_written(filters.background_activity_filter(stream(spark, ev, (4, 3)), 30_000).df) < 3 * len(ev)
    # slices don't see each other, and an event without a time neither asks nor answers
    keyed = spark.createDataFrame([(0, 0, 10, True, 0, 1), (1, 0, 20, True, 1, 2), (1, 1, 30, True, 2, 1), (0, 0, None, True, 3, 1), (1, 0, 45, False, 4, 1)], "x int, y int, t long, p boolean, seq long, slice int")
    kept = filters.background_activity_filter(s.with_(keyed).__class__(keyed, s.meta, ("slice",)), 20).df
    assert sorted(r["seq"] for r in kept.collect()) == [2, 4]


def test_refractory_is_the_fold(spark):
    ev = [(0, 0, t, 1) for t in (0, 4, 8, 12, 16, 30)] + [(1, 0, 5, 0)]
    kept = rows(filters.refractory_filter(stream(spark, ev), 10))
    assert [r[2] for r in kept if r[0] == 0] == [0, 12, 30]
    assert [r[2] for r in rows(filters.refractory_filter(stream(spark, ev), 10, "all")) if r[0] == 0] == [0, 30]


def efast_fold(ev, w, h):
    sae, out = {}, []

    def arc(v, lo, hi):
        n = len(v)
        return any(min(v[(i + j) % n] for j in range(k)) > max(v[(i + j) % n] for j in range(k, n)) for k in range(lo, hi + 1) for i in range(n))

    for x, y, t, p in ev:
        sae[x, y, p] = t
        if 4 <= x < w - 4 and 4 <= y < h - 4:
            r3, r4 = ([sae.get((x + dx, y + dy, p), -(2**63)) for dx, dy in ring] for ring in (features.RING_3, features.RING_4))
            if arc(r3, *features.ARC_3) and arc(r4, *features.ARC_4):
                out.append((x, y, t, p))
    return out


def test_efast_is_the_fold(spark):
    ev = shape()
    want = efast_fold(ev, 40, 40)
    assert want and rows(features.efast(stream(spark, ev, (40, 40)))) == want


def records_written(df):
    """Rows that the shuffles of a frame wrote, after it was run."""
    def walk(plan):
        m = plan.metrics().get("shuffleRecordsWritten")
        down = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan.plan()] if "QueryStage" in plan.getClass().getSimpleName() else [plan.children().apply(i) for i in range(plan.children().size())]
        return (m.get().value() if m.isDefined() and "ShuffleExchange" in plan.getClass().getSimpleName() else 0) + sum(map(walk, down))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def leaping(s):
    """The stream with ``seq`` far apart, so that it falls into many blocks."""
    return s.with_(s.df.withColumn("seq", F.col("seq") * 5000))


def test_efast_sends_no_copies_for_neighbours(spark):
    ev = [(x, y, t * 10, 1) for t, (x, y) in enumerate((x, y) for _ in range(20) for x in range(12) for y in range(12))]
    s = stream(spark, ev, (12, 12))
    assert records_written(features.efast(s).df) < 3 * len(ev)
    ev = shape()
    many = leaping(stream(spark, ev, (40, 40)))
    assert rows(features.efast(many)) == efast_fold(ev, 40, 40)
    wide = [(x * 4 + 20, y * 4 + 20, t, p) for x, y, t, p in ev] + [(x + 50, y + 50, t + 5000, p) for x, y, t, p in ev] + [(150, 3, 9000, 1)]
    want = efast_fold(wide[:-1], 150, 150)
    assert want and rows(features.efast(leaping(stream(spark, wide, (150, 150))))) == want


def test_harris_does_not_depend_on_tiles(spark):
    s = stream(spark, shape(), (40, 40))
    assert features.harris_corners(s).df.count() > 0


def tasks_with_rows(spark, df):
    """How many tasks a frame's rows come from, if small ones aren't merged."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return df.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def harris_fold(ev, w, h, scale=0.001):
    sae, out = np.full((h, w), np.nan), []
    for x, y, t, p in ev:
        sae[y, x] = t * scale
        if 5 <= x < w - 5 and 5 <= y < h - 5:
            q = sae[y - 5: y + 6, x - 5: x + 6]
            gx, gy = (q[1:-1, 2:] - q[1:-1, :-2]) / 2, (q[2:, 1:-1] - q[:-2, 1:-1]) / 2
            ok = ~(np.isnan(gx) | np.isnan(gy) | np.isnan(q[1:-1, 1:-1]))
            a, b, c = (gx * gx)[ok].sum(), (gx * gy)[ok].sum(), (gy * gy)[ok].sum()
            if ok.sum() >= 3 and a + c > 0 and (a * c - b * b) / (a + c) ** 2 - 0.04 > 0:
                out.append((x, y, t, p))
    return out


def test_harris_parts_a_tile_by_blocks(spark):
    ev = shape()
    want, many = harris_fold(ev, 40, 40), leaping(stream(spark, ev, (40, 40)))
    assert want and rows(features.harris_corners(many)) == want == rows(features.harris_corners(stream(spark, ev, (40, 40))))
    assert tasks_with_rows(spark, features.harris_corners(many).df) > 1


def test_components_and_blobs(spark):
    ev = [(x, y, 0, 1) for x in range(6) for y in range(6)] + [(x, y, 0, 1) for x in range(10, 16) for y in range(10, 16)]
    f = represent.count(stream(spark, ev, (20, 20)))
    found = frames.blobs(f, 8, 4).orderBy("label").collect()
    assert [(r["cx"], r["cy"], r["area"]) for r in found] == [(2.5, 2.5, 36), (12.5, 12.5, 36)]
    diagonal = represent.count(stream(spark, [(0, 0, 0, 1), (1, 1, 0, 1)], (2, 2)))
    assert frames.connected_components(diagonal, 8).df.agg(F.max("value")).first()[0] == 1
    assert frames.connected_components(diagonal, 4).df.agg(F.max("value")).first()[0] == 2


def test_tracker_follows(spark):
    t = track.Tracker(min_area=1)
    for k in range(5):
        t.step([(k * 2.0, 5.0), (30.0 - k, 9.0)])
    assert [x.id for x in t.tracks] == [1, 2] and [x.age for x in t.tracks] == [4, 4] and t.tracks[0].vx == 2 and t.tracks[1].vx == -1
    for _ in range(4):
        t.step([])
    assert t.tracks == []


def test_resize_keeps_the_sum(spark):
    f = represent.count(stream(spark, SAMPLE * 3))
    assert frames.numpy(frames.resize(f, 2, 2, "sum")).sum() == 12
    grown = frames.numpy(frames.resize(represent.tsurf(stream(spark, SAMPLE)), 8, 6))
    assert grown.shape == (2, 6, 8)


def test_masks(spark):
    m = masks.polygon_mask(spark, 8, 8, [(1, 1), (7, 1), (7, 7), (1, 7)])
    assert m.count() == 36 and masks.polygon_mask(spark, 8, 8, [(1, 1), (2, 2)]).count() == 0
    assert masks.invert(m, 8, 8).count() == 28
    assert (masks.to_array(masks.from_array(spark, np.eye(3)), 3, 3) == np.eye(3)).all()


def test_camera_round_trip():
    c = Camera(100, 110, 50, 40, k1=-0.1, k2=0.01, p1=1e-3, p2=-1e-3)
    u, v = c.undistort_point(*c.distort_point(70.0, 20.0))
    assert abs(u - 70) < 1e-6 and abs(v - 20) < 1e-6


def test_augmentations_do_not_depend_on_partitions(spark):
    s = stream(spark, shape(), (40, 40))
    many = s.with_(s.df.repartition(7))
    for op in (lambda s: augment.event_drop(s, 0.3, 5), lambda s: augment.spatial_jitter(s, 1.0, 5), lambda s: augment.time_jitter(s, 1.0, 5), lambda s: augment.pixel_dropout(s, 0.3, 5)):
        assert rows(op(s)) == rows(op(many))
    assert rows(augment.time_reversal(augment.time_reversal(s, 1.0), 1.0)) and rows(augment.random_flip_x(s, 0.0)) == rows(s)
    assert augment.random_crop(s, 10, 8, 1).sensor_size == (10, 8)


def test_contrast_maximisation_finds_the_motion(spark):
    ev = [(5 + int(0.02 * t + 0.5), y, t * 100, 1) for t in range(0, 500, 5) for y in range(5, 25)]
    r = motion.contrast_maximise(stream(spark, ev, (40, 30)), initial_step=100.0).first()
    assert r["params"][0] == pytest.approx(200, rel=0.15) and abs(r["params"][1]) < 30 and r["improvement"] > 1


def test_flow_points_along_the_motion(spark):
    ev = [(x, y, x * 1000, 1) for x in range(20) for y in range(12)]
    flow = frames.numpy(motion.optical_flow(stream(spark, ev, (20, 12))))
    assert flow[0, 6, 10] == pytest.approx(1.0, abs=1e-3) and flow[1, 6, 10] == pytest.approx(0.0, abs=1e-3)


def test_ideal_simulator_counts(spark):
    table = [(k, k * 1000, 0, 0, v) for k, v in enumerate((50.0, 100.0, 40.0))]
    f = spark.createDataFrame(table, "frame long, t long, y int, x int, luma double")
    s = simulate.simulate(f, 1, 1, simulate.SimulatorConfig.ideal())
    up = math.floor(math.log(2) / 0.2)
    down = math.floor((math.log(100) - (math.log(100) - (math.log(50) + up * 0.2)) - math.log(40)) / 0.2)
    assert s.df.where("p").count() == up and s.df.where("not p").count() == down
    assert simulate.interpolate(f, 2).count() == 5


def test_feast_learns(spark):
    s = stream(spark, shape(), (40, 40))
    m = feast.FEAST(n_features=6, patch=5, seed=1).fit(s)
    assert 0 <= m.missed_rate <= 1 and m.transform(s).count() == s.df.count()
    assert m.histogram(s).agg(F.sum("count")).first()[0] == m.transform(s).where("feature >= 0").count()


def feast_fold(m, ev, w, h, scale=0.001):
    """Units, thresholds and share of misses by the rule, an event at a time."""
    r, rng = m.patch // 2, np.random.default_rng(m.seed)
    u = rng.random((2, m.n_features, m.patch**2))
    u /= np.linalg.norm(u, axis=2, keepdims=True)
    th, sae, missed, seen = np.full((2, m.n_features), 0.5), np.full((2, h, w), -np.inf), 0, 0
    for x, y, t, p in ev:
        b = 0 if p else 1
        sae[b, y, x] = t * scale
        if r <= x < w - r and r <= y < h - r:
            v = np.exp((sae[b, y - r: y + r + 1, x - r: x + r + 1] - t * scale) / m.tau_ms).ravel()
            v /= np.linalg.norm(v)
            d, seen = 1 - u[b] @ v, seen + 1
            if (d > th[b]).all():
                missed, th[b] = missed + 1, th[b] + m.delta_e
                continue
            k = int(np.where(d > th[b], np.inf, d).argmin())
            u[b, k] = (1 - m.eta) * u[b, k] + m.eta * v
            u[b, k] /= np.linalg.norm(u[b, k])
            th[b, k] = max(th[b, k] - m.delta_i, 0)
    return u, th, missed / seen


def test_feast_is_the_fold_in_pieces(spark):
    import pandas as pd

    ev = shape()
    new = lambda: feast.FEAST(n_features=6, patch=5, seed=1)
    u, th, missed = feast_fold(new(), ev, 40, 40)
    many = leaping(stream(spark, ev, (40, 40)))
    m = new().fit(many)
    assert np.allclose(m.weights, u, atol=1e-12) and np.allclose(m.thresholds, th, atol=1e-12) and m.missed_rate == missed
    assert tasks_with_rows(spark, m.transform(many)) > 1
    key = ["seq", "feature"]
    assert sorted(map(tuple, m.transform(many).select(F.col("seq") / 5000, "feature").collect())) == sorted(map(tuple, m.transform(stream(spark, ev, (40, 40))).select(*key).collect()))
    # batches as they come give what the whole gives
    on = pd.DataFrame([e[:3] for e in ev * 6 if e[3]], columns=["x", "y", "t"])
    start = np.random.default_rng(0).random((6, 25)), np.full(6, 0.5)
    whole, parts = (new()._learn(iter(x), *start, (40, 40), 0.001) for x in ([on], [on[i: i + 700] for i in range(0, len(on), 700)]))
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1]) and whole[2:] == parts[2:]


def test_reader(spark):
    s = stream(spark, [(0, 0, 0, 1), (1, 0, 10_000, 1), (2, 0, 49_000, 0)], (4, 2))
    r = open_stream(s, dt_ms=10)
    assert len(r) == 5 and [x["n_events"] for x in r.summary().orderBy("slice_id").collect()] == [1, 1, 0, 0, 1]
    assert r.slice(-1).df.first()["t"] == 49_000
    with pytest.raises(IndexError):
        r.slice(5)
    assert r.flip_x().with_repr("count")[0].numpy()[0, 0, 3] == 1
    assert len(open_stream(s, max_events=2)) == 2 and len(EventReader(s, Slicing(dt=20_000, step=10_000))) == 5
    assert r.stream.meta.span() == 10
    with pytest.raises(ValueError):
        open_stream(s)


def test_tracker_numbers_are_never_used_again():
    t = track.Tracker(max_missed=0)
    first = t.step([(10.0, 10.0, 25)])[0]
    assert (first.area, first.age) == (25, 0)
    assert t.step([]) == []
    second = t.step([(10.0, 10.0, 25)])[0].id
    t.reset()
    assert first.id < second < t.step([(10.0, 10.0, 25)])[0].id


def test_kept_apart_is_the_loop():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, dt = int(rng.integers(1, 40)), int(rng.integers(0, 12))
        new = rng.random(n) < 0.2
        ts = rng.integers(0, 60, n)
        for a, b in zip(np.flatnonzero(np.append(True, new[1:])), [*np.flatnonzero(np.append(True, new[1:]))[1:], n]):
            ts[a:b] = np.sort(ts[a:b]) if rng.random() < 0.8 else ts[a:b]
        last = None if new[0] or rng.random() < 0.3 else int(ts[0] - rng.integers(0, 15))
        want, held = [], last
        for i in range(n):
            if i and new[i]:
                held = None
            want.append(held is None or ts[i] - held >= dt)
            if want[-1]:
                held = ts[i]
        assert filters.kept_apart(ts, new, dt, last).tolist() == want


def test_windows_keep_operators_and_representation(spark):
    s = stream(spark, [(13, 0, 0, 1), (1, 0, 10_000, 1), (2, 0, 49_000, 0)], (16, 2))
    r = open_stream(s, dt_ms=10).flip_x()
    assert r.windows(step_ms=20, span_us=20_000).slice(0).df.first()["x"] == 2
    assert r.slice_time(0, 5_000).df.first()["x"] == 2 and r.slice_count(0, 1).df.first()["x"] == 2
    assert len(r.windows()) == 5 and r.windows(step_ms=20).stream.meta.span() == 20 and r.slice_time(0, 5_000).meta.span() == 5
    shown = r.with_repr("count")
    assert shown.windows(step_ms=20)[0].numpy()[0, 0, 2] == 1 and shown.slice_time(0, 5_000).numpy().sum() == 1
    by_count = open_stream(s, max_events=2)
    assert by_count.windows() is by_count and len([*by_count]) == 2
    with pytest.raises(ValueError):
        by_count.windows(span_ms=3)
    with pytest.raises(ValueError):
        r.windows(step_ms=20, step_s=1)
    with pytest.raises(TypeError):
        r.windows(pace_ms=20)


def test_open(spark, tmp_path):
    from retinaspark.plans.dataset import open as open_
    from retinaspark.sources.files import save

    s = stream(spark, [(0, 0, 0, 1), (1, 0, 10_000, 1), (2, 0, 49_000, 0)], (4, 2))
    save(s, str(tmp_path / "a.npz"))
    r = open_(spark, str(tmp_path / "a.npz"), dt_us=10_000, repr="polarity", downsample=2)
    assert r.n_slices == 5 and r[0].shape == (2, 1, 2)
    assert open_(spark, s, dt_s=0.01, offset_ms=10).n_slices == 4 and open_(spark, s, max_events=2).n_slices == 2
    loose = open_(spark, np.array([[0, 0, 0, 1], [1, 0, 10_000, 1]]), sensor_size=(4, 2), hot_pixel_filter=True)
    assert loose.slice_time(0, 20_000).n_events() == 2
    for wrong in ({"dt_ms": 1, "max_events": 2}, {"dt_ms": 1, "dt_s": 1}, {"dt_ms": 1, "repr": "count", "downsample": 2}, {"dt_ms": 1, "offset": 1, "offset_s": 2}):
        with pytest.raises(ValueError):
            open_(spark, s, **wrong)
    with pytest.raises(ValueError):
        len(loose)


def test_registered_representations(spark):
    s = stream(spark, [(0, 0, 0, 1), (1, 0, 10_000, 1)], (4, 2))
    represent.register("twice", lambda s, **k: represent.count(transforms.concat(s, [s])))
    try:
        assert open_stream(s, max_events=2).with_repr("twice").slice(0).numpy().sum() == 4
    finally:
        del represent.REGISTRY["twice"]
    assert represent.flatten(s, "flow").channels == ("flow_x", "flow_y")
    with pytest.raises(ValueError):
        motion.optical_flow(s, 0)


def plain_hash(seed, salt, *values):
    h = 42
    for v in (Long(seed), salt, *values):
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if isinstance(v, Long) else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return (h >> 11) / float(1 << 53)


class Long(int):
    """A number that the stream holds in 64 bits."""


def test_augmentations_are_plain_hashes(spark):
    rng = np.random.default_rng(3)
    events = [(int(x), int(y), int(t), bool(p)) for x, y, t, p in zip(rng.integers(0, 16, 200), rng.integers(0, 12, 200), np.sort(rng.integers(0, 9_000, 200)), rng.integers(0, 2, 200))]
    s = stream(spark, events, (16, 12))
    rows = lambda s: sorted(tuple(r) for r in s.df.select("seq", "x", "y", "t", "p").collect())
    plain = rows(s)
    for seed in (1, 2, 3):
        turned = plain_hash(seed, "flip_x") < 0.5
        assert rows(augment.random_flip_x(s, 0.5, seed)) == [(q, 15 - x if turned else x, y, t, p) for q, x, y, t, p in plain]
        turned = plain_hash(seed, "flip_y") < 0.5
        assert rows(augment.random_flip_y(s, 0.5, seed)) == [(q, x, 11 - y if turned else y, t, p) for q, x, y, t, p in plain]
        turned = plain_hash(seed, "polarity") < 0.5
        assert rows(augment.random_polarity_flip(s, 0.5, seed)) == [(q, x, y, t, p != turned) for q, x, y, t, p in plain]
        assert rows(augment.event_drop(s, 0.3, seed)) == [r for r in plain if plain_hash(seed, "event", Long(r[0])) >= 0.3]
        assert rows(augment.pixel_dropout(s, 0.3, seed)) == [r for r in plain if plain_hash(seed, "pixel", r[1], r[2]) >= 0.3]
        dx, dy = (int(plain_hash(seed, f"crop_{c}") * (room + 1)) for c, room in (("x", 8), ("y", 6)))
        assert rows(augment.random_crop(s, 8, 6, seed)) == [(q, x - dx, y - dy, t, p) for q, x, y, t, p in plain if 0 <= x - dx < 8 and 0 <= y - dy < 6]
        moved = []
        for q, x, y, t, p in plain:
            r, a = (-2 * math.log(1 - plain_hash(seed, "space_u", Long(q)))) ** 0.5, 2 * math.pi * plain_hash(seed, "space_v", Long(q))
            x, y = x + half_away(r * math.cos(a)), y + half_away(r * math.sin(a))
            if 0 <= x < 16 and 0 <= y < 12:
                moved.append((q, x, y, t, p))
        assert rows(augment.spatial_jitter(s, 1.0, seed)) == moved
        times = {q: t + half_away((-2 * math.log(1 - plain_hash(seed, "time_u", Long(q)))) ** 0.5 * math.cos(2 * math.pi * plain_hash(seed, "time_v", Long(q))) * 1000) for q, _, _, t, _ in plain}
        ordered = sorted(plain, key=lambda r: (times[r[0]], r[0]))
        assert rows(augment.time_jitter(s, 1.0, seed)) == [(i, x, y, times[q], p) for i, (q, x, y, _, p) in enumerate(ordered)]


def half_away(v):
    return int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))


class PlainPixel:
    """One pixel of the simulator, event by event."""

    def __init__(self, cfg, t, luma):
        f = np.float32
        self.cfg, self.t, self.low, self.last, self.events = cfg, t, f(simulate.lin_log(luma)), -(2**62), []
        self.base = self.low

    def step(self, t, luma):
        f, cfg = np.float32, self.cfg
        dt, target = f((t - self.t) * 1e-6), f(simulate.lin_log(luma))
        if cfg.cutoff_hz > 0 and dt > 0:
            way = min(max(dt * (f(2 * math.pi * cfg.cutoff_hz) * (f(0.1) + f(0.9) * f(luma / 255.0))), f(0)), f(1))
            target = self.low + way * (target - self.low)
        self.low = target
        if cfg.leak_rate_hz > 0:
            self.base = self.base - f(cfg.pos_thres) * f(cfg.leak_rate_hz) * dt
        delta = target - self.base
        theta = f(cfg.pos_thres if delta > 0 else cfg.neg_thres)
        n = math.floor(abs(delta) / theta)
        for k in range(1, n + 1):
            at = self.t + int((t - self.t) * float(min(f(k) * theta / abs(delta), f(1))))
            if at - self.last >= cfg.refractory_us:
                self.last = at
                self.events.append((at, bool(delta > 0)))
        self.base = self.base + (f(1) if delta > 0 else f(-1)) * f(n) * theta
        self.t = t


@pytest.mark.parametrize("changes", [{}, {"cutoff_hz": 300.0, "leak_rate_hz": 40.0, "refractory_us": 700}, {"neg_thres": 0.35, "refractory_us": 2000}])
def test_simulator_is_the_pixel_model(spark, changes):
    rng = np.random.default_rng(6)
    luma = rng.integers(0, 256, (9, 5, 4)).astype(float)
    times = np.cumsum(rng.integers(500, 4000, 9))
    cfg = simulate.SimulatorConfig.ideal(**changes)
    f = spark.createDataFrame([(k, int(times[k]), y, x, float(luma[k, y, x])) for k in range(9) for y in range(5) for x in range(4)], "frame int, t long, y int, x int, luma double")
    got = sorted((r["x"], r["y"], r["t"], r["p"]) for r in simulate.simulate(f, 4, 5, cfg, tile=3).df.collect())
    want = []
    for y in range(5):
        for x in range(4):
            pixel = PlainPixel(cfg, int(times[0]), luma[0, y, x])
            for k in range(1, 9):
                pixel.step(int(times[k]), luma[k, y, x])
            want += [(x, y, t, p) for t, p in pixel.events]
    assert got == sorted(want) and len(got) > 50


def test_noise_does_not_depend_on_tiles(spark):
    f = spark.createDataFrame([(k, k * 100_000, y, x, 100.0) for k in range(4) for y in range(6) for x in range(6)], "frame int, t long, y int, x int, luma double")
    a, b = (sorted(map(tuple, simulate.simulate(f, 6, 6, simulate.SimulatorConfig(), tile=n).df.collect())) for n in (2, 6))
    assert a == b and len(a) > 20


def test_samples_on_one_clock(spark):
    from retinaspark.operators import clock

    rng = np.random.default_rng(9)
    events = np.stack([rng.integers(0, 4, 300), rng.integers(0, 3, 300), np.sort(rng.integers(0, 900_000, 300)), rng.integers(0, 2, 300)], 1)
    s = stream(spark, events, (4, 3))
    at = sorted(int(v) for v in rng.integers(50_000, 1_000_000, 40)) + [500_000, 500_000]
    samples = spark.createDataFrame([(v, float(i)) for i, v in enumerate(at)], "t long, gyro double")
    got = {r["seq"]: r["gyro"] for r in clock.latest_sample(s, samples, ["gyro"], 30_000).collect()}
    for i, e in enumerate(events.tolist()):
        before = max(((v, g) for g, v in enumerate(at) if v <= e[2]), default=None)
        assert got[i] == (None if before is None else before[1])
    assert len(got) == 300
    for r in (open_stream(s, dt_ms=100), open_stream(s, dt_ms=100).windows(step_ms=40, span_ms=100), open_stream(s, max_events=64)):
        bounds = {x["slice_id"]: (x["t0"], x["t1"]) for x in r.slices.collect()}
        want = sorted((k, v) for k, (a, b) in bounds.items() for v in at if a <= v < b)
        assert sorted((x["slice_id"], x["t"]) for x in r.alongside(samples).collect()) == want


def test_region_and_rate(spark):
    s = stream(spark, [(k % 4, k % 3, k * 100, 1) for k in range(100)])
    assert rows(transforms.roi(s, 1, 0, 2, 2)) == [r for r in rows(s) if 1 <= r[0] < 3 and r[1] < 2]
    assert rows(transforms.rate_cap(s, 4000)) == [r for r in rows(s) if r[2] % 1000 < 400]


def test_clouds(spark):
    s = stream(spark, [(0, 0, 0, 1), (1, 0, 50, 0), (1, 0, 100, 1)])
    assert sorted(r["z"] for r in represent.event_cloud(s, 2.0).collect()) == [0.0, 1.0, 2.0]
    assert sorted(tuple(r) for r in represent.cloud(represent.count(s)).collect()) == [(0, 0, 0, 1), (1, 0, 0, 2)]


def test_simulator_frame_by_frame(spark):
    rng = np.random.default_rng(2)
    luma, cfg = rng.integers(0, 256, (6, 5, 4)).astype(float), simulate.SimulatorConfig.ideal(upsample="adaptive", refractory_us=300)
    f = spark.createDataFrame([(k, k * 2000, y, x, float(luma[k, y, x])) for k in range(6) for y in range(5) for x in range(4)], "frame int, t long, y int, x int, luma double")
    sim, got = simulate.Simulator(4, 5, cfg), []
    for k in range(6):
        got += [tuple(map(int, e)) for e in zip(*sim.push(k * 2000, luma[k]))]
    assert sorted(got) == sorted(rows(simulate.simulate(f, 4, 5, cfg))) and len(got) > 50
    with pytest.raises(ValueError):
        sim.push(0, luma[0, :2])


def test_frames_between_by_a_model(spark):
    f = spark.createDataFrame([(k, k * 1000, y, x, float(10 * k + x)) for k in range(3) for y in range(2) for x in range(3)], "frame int, t long, y int, x int, luma double")
    made = {(r["frame"], r["y"], r["x"]): (r["t"], r["luma"]) for r in simulate.interpolate(f, 4, lambda a, b, share: a + (b - a) * share).collect()}
    plain = {(r["frame"], r["y"], r["x"]): (r["t"], r["luma"]) for r in simulate.interpolate(f, 4).collect()}
    assert made.keys() == plain.keys() and all(made[k] == pytest.approx(plain[k]) for k in made)


def test_units():
    assert scale_us("milliseconds") == 1000 and duration_us("dt", dt_s=0.5) == 500_000 and duration_us("dt", 2) == 2000
    assert infer_unit(1.5, True) == "s" and infer_unit(2e6, False) == "us"
    with pytest.raises(ValueError):
        duration_us("dt", dt_s=1, dt_us=3)
    with pytest.raises(ValueError):
        duration_us("dt", dt_us=0.1)


def test_render_and_png():
    image = render.render_frame(np.arange(12).reshape(1, 3, 4), "count", "viridis")
    assert image.shape == (3, 4, 3) and (render.read_png(render.png(image)) == image).all()
    assert len(render.flow_wheel()) == 55 and tuple(render.colormap(np.array([0.0]), "viridis")[0]) == (68, 1, 84)
    assert render.extent(np.array([1.0, -5.0, 0])) == 5


def test_frame_queries_have_the_whole_stream(spark):
    from retinaspark.plans import catalog

    sf = "/root/testdata/sf0.001"
    n = catalog.events(spark, sf).df.count()
    filled = catalog.QUERIES["frame_filled"](spark, sf)
    assert filled.agg(F.sum("value")).first()[0] == n
    on = filled.where("value > 0").count()
    assert catalog.QUERIES["connected_components"](spark, sf).count() == on
    assert 0 < catalog.QUERIES["blobs"](spark, sf).agg(F.sum("area")).first()[0] <= on


def test_fold_queries_take_the_whole_stream(spark, monkeypatch):
    from retinaspark.plans import catalog

    sf = "/root/testdata/sf0.01"
    t0, t1 = catalog.events(spark, sf).df.agg(F.min("t"), F.max("t")).first()
    assert catalog.QUERIES["tracker"](spark, sf).agg(F.max("slice_id")).first()[0] == (t1 - t0) // 100_000
    fit, seen = feast.FEAST.fit, []
    monkeypatch.setattr(feast.FEAST, "fit", lambda self, s, *a, **k: (seen.append(s.df.count()), fit(self, s, *a, **k))[1])
    assert catalog.QUERIES["feast_transform"](spark, sf).count() == seen[0] == 10_000
    run, given = motion.contrast_maximise, []
    monkeypatch.setattr(motion, "contrast_maximise", lambda *a, **k: (given.append(k), run(*a, **k))[1])
    assert catalog.QUERIES["contrast_maximise"](spark, sf).count() == (t1 - t0) // 500_000 + 1
    assert given[0].get("max_iterations", 200) == 200
