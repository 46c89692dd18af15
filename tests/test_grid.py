"""The grid operators against hand-made and scalar references."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.functions import pixels as P
from gridfold.operators import evaluate, kernels, mixture, planes, records, shapes, spatial
from gridfold.params import BLUR_TAPS, Params
from gridfold.plans import chains, pipeline
from gridfold.sources import carriers
from gridfold.streaming.fold import fold_stream

f = np.float32


def one_pixel(modes, n, x, alpha, p=Params()):
    """One frame of one pixel by the published rules, on a table of modes (weight, variance, mean)
    kept in order by taking a row out and putting it back in: (modes, n, mask, probability)."""
    keep, floor = f(1) - alpha, alpha * f(p.complexity)
    x, matched, background, passed, prob, k = x.astype(f), False, False, f(0), f(0), 0
    while k < n:
        mode, at = modes[k].copy(), k
        gap = mode[2:] - x
        far = np.add.accumulate(gap * gap, dtype=f)[-1]
        if not matched and far < f(p.background_threshold) * mode[1]:
            prob += mode[0]
            background |= bool(passed < f(p.background_ratio))
        mode[0] = keep * mode[0] - floor
        if not matched and far < f(p.generation_threshold) * mode[1]:
            matched = True
            mode[0] += alpha
            rate = alpha / mode[0]
            mode[1] = np.clip(mode[1] + rate * (far - mode[1]), f(p.var_min), f(p.var_max))
            mode[2:] -= rate * gap
            at = max(np.flatnonzero(modes[:k, 0] > mode[0]), default=-1) + 1
        if mode[0] < floor:
            mode[0], n = 0, n - 1
        passed += mode[0]
        modes = np.insert(np.delete(modes, k, 0), at, mode, 0)
        k += 1
    modes[:n, 0] *= f(1) / passed if abs(passed) > mixture.EPSILON else f(0)
    if not matched and alpha > 0:
        n = min(n + 1, len(modes))
        modes[: n - 1, 0] *= keep
        fresh = np.concatenate([[alpha if n > 1 else 1, p.var_init], x]).astype(f)
        at = max(np.flatnonzero(modes[: n - 1, 0] > alpha), default=-1) + 1
        modes = np.insert(np.delete(modes, n - 1, 0), at, fresh, 0)
    return modes, n, 0 if background else 255, prob


@pytest.mark.parametrize("update", [-1.0, 0.2])
def test_mixture_equals_the_model_pixel_by_pixel(update):
    r = np.random.default_rng(3)
    frames = r.choice([40, 80, 82, 200], (60, 3, 40), p=[0.5, 0.2, 0.2, 0.1]) + r.integers(0, 4, (60, 3, 40))
    state = mixture.State(40)
    held = [(np.zeros((5, 5), f), 0)] * 40
    drops = 0
    for t, x in enumerate(frames, 1):
        before = state.n.copy()
        mask, prob = state.step(x, update)
        drops += (state.n < before).sum()
        alpha = f(update) if update >= 0 and t > 1 else f(1.0 / min(2 * t, 250))
        for i, (modes, n) in enumerate(held):
            *held[i], want, p = one_pixel(modes, n, x[:, i], alpha)
            own, n = held[i]
            assert (mask[i], prob[i], state.n[i]) == (want, p, n)
            assert (state.w[:n, i] == own[:n, 0]).all() and (state.v[:n, i] == own[:n, 1]).all() and (state.m[:n, :, i] == own[:n, 2:]).all()
        if t == 1:
            assert (mask == 255).all() and (prob == 0).all() and (state.n == 1).all()
    assert update < 0 or drops > 0
    # every pixel's background is the mean of its heaviest modes
    for i, (modes, n) in enumerate(held):
        before = np.concatenate([[0], np.cumsum(modes[:n, 0], dtype=f)[:-1]])
        use = before < f(0.9)
        want = (modes[:n][use, :1] * modes[:n][use, 2:]).sum(0) / modes[:n][use, 0].sum()
        assert np.abs(state.background()[:, i] - want).max() <= 0.51


def test_colour_and_taps(spark):
    row = lambda b, g, r: spark.range(1).select(*P.ycrcb(F.lit(b), F.lit(g), F.lit(r))).first()
    assert tuple(row(7, 7, 7)) == (7, 128, 128) and row(0, 0, 255)[1] == 255
    assert tuple(P.blur_taps()) == BLUR_TAPS
    for bad in ((4, 5.0), (1, 5.0), (15, 0.0)):
        with pytest.raises(ValueError):
            P.blur_taps(*bad)


def grid(spark, m):
    return spark.createDataFrame([(1, y, x, int(v)) for y, row in enumerate(m) for x, v in enumerate(row)], "frame long, y int, x int, m int")


def back(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r.m
    return out


def test_stencils(spark):
    m = np.where(np.random.default_rng(1).random((9, 13)) > 0.5, 255, 0)
    p = np.pad(m, 2, mode="edge")
    want = np.array([[255 if (p[y : y + 5, x : x + 5] == 255).sum() >= 13 else 0 for x in range(13)] for y in range(9)])
    assert (back(spatial.median(grid(spark, m), "m"), m.shape) == want).all()
    flat = np.full((3, 1), 77)
    assert (back(spatial.blur(grid(spark, flat), "m"), flat.shape) == 77).all()
    g = np.random.default_rng(2).integers(0, 256, (5, 21))
    q = np.pad(g, 7, mode="reflect") if min(g.shape) > 7 else np.pad(np.pad(g, ((0, 0), (7, 7)), mode="reflect"), ((7, 7), (0, 0)), mode="reflect")
    h = sum(t * q[:, i : i + 21] for i, t in enumerate(BLUR_TAPS))
    v = sum(t * h[i : i + 5] for i, t in enumerate(BLUR_TAPS))
    assert (back(spatial.blur(grid(spark, g), "m"), g.shape) == (v + 32768) >> 16).all()


def walk(start, free):
    """Cells of the set `free` that side steps from `start` reach."""
    got, todo = set(), [c for c in start if c in free]
    while todo:
        y, x = todo.pop()
        if (y, x) not in got:
            got.add((y, x))
            todo += [c for c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if c in free]
    return got


def test_shapes():
    r = np.random.default_rng(17)
    for h, w, share in ((1, 1, 0.5), (7, 9, 0.6), (30, 41, 0.55), (60, 70, 0.45), (12, 3, 1.0), (5, 5, 0.0)):
        m = np.where(r.random((h, w)) < share, 255, 0)
        free = {(y, x) for y, x in zip(*np.nonzero(m == 0))}
        outside = walk([(y, x) for y in range(h) for x in range(w) if y in (0, h - 1) or x in (0, w - 1)], free)
        want = np.array([[0 if (y, x) in outside else 255 for x in range(w)] for y in range(h)])
        assert (shapes.fill_holes(m) == want).all() and (shapes.fill_reconstruct(m)[0] == want).all() and (shapes.contour_fill(m) == want).all()
        inner, holes = free - outside, 0
        while inner:
            inner, holes = inner - walk([next(iter(inner))], inner), holes + 1
        assert shapes.hole_count(m) == holes
        for seed in ((50, 50), (h // 2, w // 2)):
            want = 255 - 255 * np.array([[(y, x) in walk([seed], free) for x in range(w)] for y in range(h)])
            assert (shapes.seeded_fill(m, seed) == want).all()
    three = np.zeros((9, 31), int)
    three[1:3, 1:8], three[4:8, 10:13], three[0, 20:28] = 255, 255, 255
    one = np.zeros_like(three)
    one[1:3, 1:8] = 255
    three[4, 13] = three[5, 14] = 255  # corners touch: 14 cells on either side, the first stays
    assert (shapes.largest_component(three) == one).all() and (shapes.largest_component(one * 0) == 0).all()
    with pytest.raises(RuntimeError):
        shapes.fill_reconstruct(np.zeros((40, 40), int), most=1)


def test_frames_from_files(spark, tmp_path):
    r = np.random.default_rng(4)
    frames = {i: r.integers(0, 256, (4, 6, 3), np.uint8) for i in (3, 4, 5)}
    for i, x in frames.items():
        (tmp_path / f"in{i:06d}.ppm").write_bytes(b"P6\n# a comment\n6 4\n255\n" + x.tobytes())
    (tmp_path / "roi.pgm").write_bytes(b"P5 6 4 255 " + bytes(range(24)))
    df = carriers.netpbm_frames(spark, str(tmp_path))
    got = {x.frame_id: np.frombuffer(x.data, np.uint8).reshape(4, 6, 3) for x in df.collect()}
    assert set(got) == {3, 4, 5} and all((got[i] == frames[i]).all() for i in got)
    assert sorted(x.frame_id for x in carriers.window(df, 4, 9).collect()) == [1, 2]
    with pytest.raises(ValueError):
        carriers.window(df, 9, 1)
    cells = {(x.frame_id, x.y, x.x): (x.c0, x.c1, x.c2) for x in carriers.pixels_of(df).collect()}
    assert cells[4, 2, 5] == tuple(frames[4][2, 5]) and len(cells) == 72
    roi = carriers.netpbm((tmp_path / "roi.pgm").read_bytes())
    assert roi == (4, 6, 1, bytes(range(24)))
    for bad in (b"P6 6 4 65535 " + bytes(144), b"P6 6 4 255 " + bytes(9), b"P2 1 1 255 7"):
        with pytest.raises(ValueError):
            carriers.netpbm(bad)
    small = carriers.resized(df, 2, 3).where("frame_id = 3").first()
    want = np.rint(frames[3].astype(float).reshape(2, 2, 3, 2, 3).mean((1, 3)))  # halves are means of four
    assert (np.frombuffer(small.data, np.uint8).reshape(2, 3, 3) == want).all() and (small.height, small.width) == (2, 3)
    assert (kernels.resized(frames[3][:, :, 0], 4, 6) == frames[3][:, :, 0]).all()


def test_kernels_equal_windows(spark):
    m = np.where(np.random.default_rng(9).random((11, 17)) > 0.6, 255, 0)
    assert (kernels.majority(m) == back(spatial.median(grid(spark, m), "m"), m.shape)).all()
    assert (kernels.closed(m, 7) == back(spatial.close(grid(spark, m), "m", 7), m.shape)).all() and (kernels.closed(m, 0) == m).all()


def test_colours(spark):
    row = lambda e: spark.range(1).select(*e).first()
    for c in ((0, 0, 255), (12, 200, 99), (255, 255, 255), (255, 0, 0)):
        y, cr, cb = row(P.ycrcb(*map(F.lit, c)))
        assert max(abs(a - b) for a, b in zip(row(P.bgr(*map(F.lit, (y, cr, cb)))), c)) <= 2 or max(cr, cb) == 255
    assert row(P.ycrcb(F.lit(0), F.lit(0), F.lit(255), clamp=False))[1] > 255
    assert row([P.bus_bytes(F.lit(10), F.lit(20), x) for x in (True, False)]) == (1600, 3400)
    assert abs(row([P.grey(F.lit(10), F.lit(20), F.lit(30))])[0] - 21.85) < 1e-4


def test_records(spark):
    lines = ["first run:", " fold   12.50 ms", "blur 3 ms", "", "second run:", "fold 10.5 ms"]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    got = carriers.parse_records(df)
    assert sorted(map(tuple, got.collect())) == [("first run", "blur", 3.0), ("first run", "fold", 12.5), ("second run", "fold", 10.5)]
    assert carriers.parse_records(df.drop("line")).where("header is null").count() == 3
    assert {r.name: (r.milliseconds, r.rounds) for r in records.median_rounds(got).collect()} == {"fold": (11.5, 2), "blur": (3.0, 1)}
    shares = records.stage_shares(got)
    assert {r.name: round(r.share, 3) for r in shares.collect()} == {"fold": 0.885, "blur": 0.115}
    assert [(r.name, round(r.reached, 3)) for r in records.reached_shares(shares).orderBy("reached").collect()] == [("fold", 0.885), ("blur", 1.0)]


def test_fold_of_many_batches(spark):
    df = carriers.traffic(spark, 12, 10, 16)
    want = sorted(mixture.fold(df, rows=4).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # batches end within frames
    try:
        assert sorted(mixture.fold(df, rows=4).collect()) == want and len(want) == 12 * 160
        assert mixture.fold(df, rows=3, final=True).count() == 160
        assert mixture.fold(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_traffic_through_the_pipeline(spark):
    df = carriers.traffic(spark, 30, 24, 40, cars=2)
    late = pipeline.blur_background(df, update=0.05, close=3).where("frame_id > 20").toPandas()
    frames = df.where("frame_id > 20").toPandas()
    both = late.merge(frames, on=["stream_id", "frame_id", "y", "x"])
    car = both["c0"] > 110
    on = both["refined"] == 255
    assert len(both) == 10 * 24 * 40 and on[car].mean() > 0.5 and on[~car].mean() < 0.05
    assert (both["b"][on] == both["c0"][on]).all()
    with pytest.raises(ValueError):
        pipeline.model(df, colour="hsv")


def test_planes_equal_cells(spark):
    df = carriers.traffic(spark, 25, 33, 41, cars=3)
    frames = carriers.frames_of(df).cache()
    assert sorted(carriers.pixels_of(frames).collect()) == sorted(df.collect())
    for colour in ("ycrcb", "bgr"):
        want = sorted(pipeline.model(df, update=0.05, colour=colour).collect())
        assert sorted(pipeline.model(df, update=0.05, colour=colour, way="frames").collect()) == want
    folded = planes.fold(frames, update=0.05, cells=100)
    assert sorted(planes.cells_of_folded(folded, 100).collect()) == sorted(pipeline.model(df, update=0.05).collect())
    got = planes.cells_of_finished(planes.blur_background(frames, update=0.05, close=3))
    assert sorted(got.collect()) == sorted(pipeline.blur_background(df, update=0.05, close=3).collect())
    one = lambda d, c: sorted(map(tuple, d.selectExpr("frame.frame_id", "y", "x", c).collect()))
    blurred = pipeline.keyed(carriers.pixels_of(planes.blur(frames)))
    assert one(blurred, "c1") == one(spatial.blur(pipeline.keyed(df), "c1"), "c1")


def test_planes_of_odd_frames(spark):
    pixels = np.random.default_rng(6).integers(0, 256, (3, 5, 7), np.uint8)
    rows = [("grey", i, 5, 7, 1, p.tobytes(), "more") for i, p in enumerate(pixels, 1)]
    rows += [(None, 1, 5, 7, 1, pixels[0].tobytes(), None), ("none", 1, 0, 0, 1, b"", None), ("none", 2, 0, 0, 1, None, None)]
    frames = spark.createDataFrame(rows, f"{carriers.FRAMES}, strip string")
    want = sorted(pipeline.model(carriers.pixels_of(frames.where("stream_id = 'grey'")), colour="bgr").collect())
    got = planes.cells_of_folded(planes.fold(frames, colour="bgr"))
    assert sorted(got.where("stream_id = 'grey'").collect()) == want and got.count() == 4 * 35
    assert planes.blur_background(frames).count() == planes.blur(frames).count() == 4
    assert planes.blur_background(frames.limit(0)).count() == planes.blur(frames.limit(0)).count() == 0
    with pytest.raises(Exception, match="two sizes"):
        planes.fold(spark.createDataFrame([*rows[:2], ("grey", 9, 7, 5, 1, rows[0][5], "")], f"{carriers.FRAMES}, strip string")).count()
    for bad in ({"params": Params(propagate=True)}, {"colour": "hsv"}):
        with pytest.raises(ValueError):
            planes.fold(frames, **bad)
    with pytest.raises(ValueError):
        pipeline.model(frames, way="rows")


def test_components_of_runs():
    r = np.random.default_rng(12)
    for _ in range(40):
        on = r.random((r.integers(1, 12), r.integers(1, 12))) < r.random()
        for eight in (False, True):
            own, left, n = shapes.labels(on, eight), on.copy(), 0
            while left.any():
                n += 1
                seed = np.zeros(on.shape, bool)
                seed[np.unravel_index(left.ravel().argmax(), on.shape)] = True
                reached = shapes.spread(seed, on, eight)[0]
                assert (own[reached] == n).all()
                left &= ~reached
            assert own.max(initial=0) == n and (own[~on] == 0).all()
    maze = np.indices((40, 41)).sum(0) % 4 != 0
    assert (shapes.fill_holes(np.where(maze, 255, 0)) == shapes.fill_reconstruct(np.where(maze, 255, 0))[0]).all()


def test_scores(spark):
    rows = [(255, 255), (255, 255), (255, 0), (255, 0), (255, 255), (255, 0)]
    c = evaluate.confusion(spark.createDataFrame([(1, *r) for r in rows], "g int, pred int, truth int"), ["g"])
    assert tuple(c.first()) == (1, 3, 3, 0)
    assert evaluate.metrics(c).first().r == 1.0


def test_ellipse(spark):
    assert [k for _, k in spatial.ellipse(5)] == [0, 2, 2, 2, 0] and spatial.ellipse(1) == [(0, 0)]
    m = np.where(np.random.default_rng(5).random((9, 11)) > 0.8, 255, 0)
    for size in (3, 7, 15):
        r, want = size // 2, np.zeros_like(m)
        for dy, k in spatial.ellipse(size):
            for dx in range(-k, k + 1):
                p = np.pad(m, r)
                want = np.maximum(want, p[r + dy : r + dy + 9, r + dx : r + dx + 11])
        assert (back(spatial.dilate_ellipse(grid(spark, m), "m", size), m.shape) == want).all()
        assert (back(spatial.erode_ellipse(grid(spark, 255 - m), "m", size), m.shape) == 255 - want).all()
    assert chains.sizes(1080) == (41, 91, 59)


def cells(frames):
    return [("s", t, y, x, int(v), int(v), 9) for t, m in enumerate(frames, 1) for y, row in enumerate(m) for x, v in enumerate(row)]


PIXELS = "stream_id string, frame_id long, y int, x int, c0 int, c1 int, c2 int"


def test_stream_equals_batch(spark, tmp_path):
    frames = np.random.default_rng(6).choice([40, 44, 200], (12, 5, 4))
    rows = cells(frames)
    want = {tuple(r) for r in mixture.fold(spark.createDataFrame(rows, PIXELS), update=0.1, rows=2).collect()}
    for i in range(3):
        part = [r for r in rows if (r[1] - 1) // 4 == i and not (i == 0 and r[3] == 3)]
        late = [r for r in rows if r[3] == 3 and r[1] <= 4] if i == 1 else []
        spark.createDataFrame(part + late, PIXELS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(PIXELS).parquet(str(tmp_path / "in"))
        q = fold_stream(source, update=0.1, rows=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_propagation():
    block = mixture.Block(Params(propagate=True))
    keys = np.array([y << 32 | x for y in range(40) for x in range(40)])
    assert (block.places(keys) == np.arange(1600)).all()
    s = block.state
    s.step(np.full((3, 1600), 50, f))
    h = [(int(np.int64(y * 1000003 + x * 999983).astype(np.int32)), y, x) for y in range(40) for x in range(40)]
    want = set()
    for v, y, x in h:
        if (v & 0x7FFFFFFF) % 16 == 0:
            dy, dx = [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)][(v >> 4) & 7]
            if 0 <= y + dy < 40 and 0 <= x + dx < 40:
                want.add((y + dy) * 40 + x + dx)
    block.pass_on(np.zeros(1600, int), np.ones(1600, bool))
    assert want and set(np.flatnonzero(s.n == 2)) == want
    assert all(s.w[1, i] == f(0.1) and s.m[1, 0, i] == 50 for i in want)


def test_seed_proofs(spark):
    n, w, v = np.array([1, 1, 1]), np.zeros((5, 3), f), np.full((5, 3), 4, f)
    m = np.zeros((5, 3, 3), f)
    x = np.array([[8.0, 8.0, 30.0], [0, 0, 0], [0, 0, 0]], f)
    other = m.copy()
    other[0, 0] = [1e-4, 0, 1e-4]  # 64 = 16 * 4: at the branch, just below it
    assert evaluate.seed_proofs((n, w, v, m), (n, w, v, other), x).tolist() == [True, False, False]
    assert not evaluate.seed_proofs((n, w, v, m), (n + 1, w, v, other), x).any()
    p = spark.createDataFrame(cells(np.random.default_rng(7).choice([40, 90], (6, 2, 2))), PIXELS)
    a = mixture.fold(p, update=0.2, snapshot=True)
    assert evaluate.seeds(a, a, p).count() == 0
    assert len(a.first().w) == 5 and len(a.first().m) == 15
    evaluate.seeds(a, mixture.fold(p, Params(complexity=0.2), 0.2, snapshot=True), p).collect()


def test_verdict(spark, monkeypatch):
    frames, side = 3, 8
    schema = "stream_id string, frame_id long, y int, x int, bg_prob float, n int"
    at = [(i, y, x) for i in range(1, frames + 1) for y in range(side) for x in range(side)]
    pixels = spark.createDataFrame([("s", *c, 10 * c[1], 20 * c[2], 7) for c in at], "stream_id string, frame_id long, y int, x int, c0 int, c1 int, c2 int")
    on = {(i, y, x) for i, y, x in at if x <= 3 and (y, x) != (3, 3)}
    seed = [("s", 2, 3, 2, True)]  # y, x, frame, proven
    monkeypatch.setattr(evaluate, "seeds", lambda *_: spark.createDataFrame(seed, "stream_id string, y int, x int, frame_id long, proven boolean"))

    def run(change, base=on):
        a = {c: 0.1 if c in base else 0.9 for c in at}
        two = [spark.createDataFrame([("s", *c, p, 1) for c, p in d.items()], schema) for d in (a, a | change)]
        return evaluate.verdict(*two, pixels).first()

    assert run({}).verdict == "IDENTICAL" and run({}).pixels == len(at)
    assert run({}, set()).verdict == "DEGENERATE" and run({}, set(at)).verdict == "IDENTICAL"  # all foreground is some
    late = run({(2, 2, 3): 0.9, (2, 4, 3): 0.9})  # one after its proven seed, one for no reason
    assert (late.flips, late.cascaded, late.unexplained, late.verdict) == (2, 1, 1, "DIVERGED")
    assert late.prefill_differ > 0 and late.refined_differ > 0 and late.composite_differ > 0 and not late.integer_fault
    seed.append(("s", 4, 3, 2, True))
    assert run({(2, 2, 3): 0.9, (2, 4, 3): 0.9}).verdict == "FLOAT-BOUNDARY"
    assert run({(1, 2, 3): 0.9, (1, 4, 3): 0.9}).verdict == "DIVERGED"  # before their seeds
    seed[1] = ("s", 4, 3, 2, False)
    assert run({(2, 2, 3): 0.9, (2, 4, 3): 0.9}).verdict == "DIVERGED"


def test_compare_frame_finds_faults():
    import pandas as pd

    y, x = np.indices((8, 9)).reshape(2, -1)
    df = pd.DataFrame({"y": y, "x": x, "a": 0.9, "b": 0.9, "edge": False, "cascade": False, "real": True, "pre_a": 0, "pre_b": 0})
    for i in range(3):
        c = (37 * y + 11 * x * (i + 1)) % 256
        df[f"c{i}"], df[f"s{i}"] = c, evaluate.blurred(c.reshape(8, 9)).ravel()
    assert not evaluate.compare_frame(df).fault[0]
    worse = df.copy()
    worse.loc[5, "pre_b"] = 255  # masks differ, decisions don't
    assert evaluate.compare_frame(worse).fault[0]
    worse = df.copy()
    worse.loc[5, "s1"] += 1
    assert evaluate.compare_frame(worse).fault[0]
