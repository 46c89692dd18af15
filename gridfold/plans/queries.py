"""Queries over the synthetic tables, one for each operator, and DuckDB SQL for those it can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions import pixels as P
from gridfold.operators import evaluate, mixture, planes, records, shapes, spatial
from gridfold.params import BLUR_TAPS, Params
from gridfold.plans import chains, oracles, pipeline
from gridfold.sources.carriers import SIDE, event_pixels, frames_of, table, vector_frames, vector_grid

LOW = 0.2


def _colour(s, d) -> DataFrame:
    t = table(s, d, "lineitem")
    part = lambda c, k: (F.floor(F.col(c) * k).cast("int") % 256).cast("int")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", part("l_quantity", 5).alias("b"), part("l_orderkey", 7).alias("g"), part("l_partkey", 3).alias("r"))


def color_ycrcb(s, d):
    y, cr, cb = P.ycrcb(F.col("b"), F.col("g"), F.col("r"))
    return _colour(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", y.alias("luma"), cr.alias("cr"), cb.alias("cb"))


def alpha_ramp(s, d):
    e = table(s, d, "events").select("event_id", F.expr("row_number() over (partition by user_id order by ts, event_id)").alias("n"))
    return e.select("event_id", P.learning_rate(F.col("n")).alias("auto"), P.learning_rate(F.col("n"), LOW).alias("fixed"))


def _low(s, d, **kw):
    return mixture.fold(event_pixels(s, d), Params(**kw), LOW)


def mixture_fold(s, d):
    return _low(s, d)


def mixture_shadow(s, d):
    return _low(s, d, detect_shadows=True)


def mixture_adaptive(s, d):
    return mixture.fold(event_pixels(s, d), Params(adaptive=True))


def mixture_propagate(s, d):
    return _low(s, d, propagate=True)


def state_snapshot(s, d):
    """A row for each mode in use after each frame."""
    out = mixture.fold(event_pixels(s, d), Params(), LOW, snapshot=True)
    out = out.select("stream_id", "frame_id", "y", "x", "n", "m", F.posexplode(F.arrays_zip("w", "v")).alias("k", "_s")).where("k < n")
    means = [F.get("m", 3 * F.col("k") + i).cast("double").alias(f"m{i}") for i in range(3)]
    return out.select("stream_id", "frame_id", "y", "x", "k", F.col("_s.w").cast("double").alias("w"), F.col("_s.v").cast("double").alias("v"), *means)


def divergence_seeds(s, d):
    """Where folds under slightly different ratios part, and whether rounding explains it."""
    p = event_pixels(s, d)
    return evaluate.seeds(mixture.fold(p, Params(), LOW, snapshot=True), mixture.fold(p, Params(modes=5, complexity=0.0501), LOW, snapshot=True), p)


def background_image(s, d):
    return mixture.fold(event_pixels(s, d), Params(), LOW, final=True)


def foreground_counts(s, d):
    """The flagship: after the fold of all frames, the foreground of each later frame."""
    out = mixture_fold(s, d).where("frame_id > 5")
    return out.groupBy("stream_id", "frame_id").agg(F.count_if(P.below_confidence(F.col("bg_prob")) == 255).alias("foreground"), F.count("*").alias("pixels"))


def threshold_confidence(s, d):
    return vector_grid(s, d).select("frame", "y", "x", P.below_confidence(F.col("prob")).alias("m"))


def binarize(s, d):
    raw = F.when(F.col("e") > 0.1, 255).when(F.col("e") > 0, 127).otherwise(0)
    return vector_grid(s, d).select("frame", "y", "x", P.binarize(raw).alias("m"))


def sobel_edges(s, d):
    return spatial.sobel(vector_grid(s, d), "grey").select("frame", "y", "x", "edge")


def gates(s, d):
    g = spatial.sobel(vector_grid(s, d), "grey")
    return g.select("frame", "y", "x", P.weak_gate(F.col("edge"), F.col("prob")).alias("weak"), P.strict_gate(F.col("edge"), F.col("prob")).alias("strict"))


def _mask(f):
    return lambda s, d: f(vector_grid(s, d)).select("frame", "y", "x", "m")


def blur_q8(s, d):
    return spatial.blur(vector_grid(s, d), "grey").select("frame", "y", "x", "grey")


def composite(s, d):
    g = vector_grid(s, d)
    b = spatial.blur(g.withColumn("blurred", F.col("grey")), "blurred")
    return b.select("frame", "y", "x", spatial.composite(F.col("m"), F.col("grey"), F.col("blurred")).alias("value"))


def _holes(g):
    return shapes.by_frame(g, "m", shapes.hole_count)


def hole_count(s, d):
    return _holes(vector_grid(s, d)).groupBy("frame").agg(F.max("m").cast("long").alias("holes"))


def _scored(s, d):
    """Labelled documents as cells: predicted by their length, without the toxic ones."""
    t = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    t = t.select("lang", F.when(F.col("n_chars") > 1000, 255).otherwise(0).alias("pred"), (F.col("quality") * 255).alias("truth"), (F.col("toxic") == 0).alias("inside"))
    return t.where(P.scorable(F.col("truth"), F.col("inside")))


def confusion(s, d):
    return evaluate.confusion(_scored(s, d), ["lang"])


def metrics(s, d):
    return evaluate.metrics(confusion(s, d))


def chain_leaderboard(s, d):
    g = spatial.sobel(vector_grid(s, d), "grey").select("frame", "y", "x", "e", "m", "prob", "edge")
    truth = g.select("frame", "y", "x", F.when(F.col("e") > 0.02, 255).otherwise(0).alias("truth"))
    each = [f(g).select("frame", "y", "x", F.lit(name).alias("chain"), F.col("m").alias("pred")) for name, f in chains.chains(SIDE, (0, 0)).items()]
    both = reduce(DataFrame.unionByName, each).join(truth, ["frame", "y", "x"])
    empty = both.groupBy("chain", "frame").agg(F.max("pred").alias("top")).groupBy("chain").agg(F.count_if(F.col("top") < 255).alias("empty"))
    return evaluate.leaderboard(evaluate.metrics(evaluate.confusion(both, ["chain"])).join(empty, "chain"))


def _two(s, d):
    g = vector_grid(s, d)
    return g, g.withColumn("m", F.when(F.col("e") > 0.02, 255).otherwise(0))


def mask_diff(s, d):
    return evaluate.mask_diff(*_two(s, d), ["frame", "y", "x"], "m")


def cumulative_diff(s, d):
    return evaluate.cumulative(mask_diff(s, d))


def agreement(s, d):
    a, b = _two(s, d)
    both = a.select("frame", "y", "x", F.col("m").alias("a")).join(b.select("frame", "y", "x", F.col("m").alias("b")), ["frame", "y", "x"])
    return both.agg((F.count_if(F.col("a") == F.col("b")) / F.count("*")).alias("agreement"))


def _error(a, b):
    return F.when((a == 255) & (b == 255), "ok").when(a == 255, "fp").when(b == 255, "fn").otherwise("none")


def error_classes(s, d):
    a, b = _two(s, d)
    both = a.select("frame", "y", "x", F.col("m").alias("a")).join(b.select("frame", "y", "x", F.col("m").alias("b")), ["frame", "y", "x"])
    return both.groupBy(_error(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("cells"))


def prune_events(s, d):
    return evaluate.pruned_modes(mixture_fold(s, d))


def first_divergence(s, d):
    return evaluate.first_divergence(_low(s, d), _low(s, d, modes=3), ["stream_id", "y", "x"])


def parity_verdict(s, d):
    p = event_pixels(s, d)
    return evaluate.verdict(mixture.fold(p, Params(), LOW, snapshot=True), mixture.fold(p, Params(modes=3), LOW, snapshot=True), p)


def pipeline_frames(s, d):
    """The whole way of a frame: colour, fold, refinement, blur, composite."""
    return pipeline.blur_background(vector_frames(s, d), update=LOW)


def pipeline_planes(s, d):
    """As `pipeline_frames`, on frames as binary rows."""
    return planes.cells_of_finished(planes.blur_background(frames_of(vector_frames(s, d)), update=LOW))


def model_planes(s, d):
    """The model over luma and chroma, on frames as binary rows."""
    return pipeline.model(vector_frames(s, d), update=LOW, way="frames")


def score_chains(s, d):
    """Scores of the chains that need no edges, from frame 10 on, apart from the first cell."""
    frames = vector_frames(s, d)
    truth = frames.select("stream_id", "frame_id", "y", "x", F.when(F.col("c0") >= 160, 255).otherwise(0).alias("truth"))
    roi = s.range(SIDE * SIDE).select(F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x"), F.when(F.col("id") > 0, 255).otherwise(0).alias("roi"))
    return pipeline.score(frames, truth, roi, ("raw mask", "confidence", "mask + median", "confidence + median"), since=10, update=LOW)


def inverse_color(s, d):
    t = _colour(s, d)
    b, g, r = P.bgr(F.col("b"), F.col("g"), F.col("r"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", b.alias("b"), g.alias("g"), r.alias("r"))


def _records(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("long").cast("double").alias("milliseconds"))


def median_rounds(s, d):
    return records.median_rounds(_records(s, d))


def stage_shares(s, d):
    return records.stage_shares(_records(s, d))


def profile_shares(s, d):
    return records.reached_shares(stage_shares(s, d))


def bus_load(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1080 + 1).cast("long").alias("h"))
    return o.select("o_orderkey", P.bus_bytes(F.col("h"), F.lit(1920), False).alias("apart"), P.bus_bytes(F.col("h"), F.lit(1920), True).alias("fused"))


def queries():
    own = [pipeline_frames, pipeline_planes, model_planes, score_chains, inverse_color, median_rounds, stage_shares, profile_shares, bus_load, color_ycrcb, alpha_ramp, mixture_fold, mixture_shadow, mixture_adaptive, mixture_propagate, state_snapshot, divergence_seeds, background_image, foreground_counts, threshold_confidence, binarize, sobel_edges, gates, blur_q8, composite, hole_count, confusion, metrics, chain_leaderboard, mask_diff, cumulative_diff, agreement, error_classes, prune_events, first_divergence, parity_verdict]
    masks = {
        "median5": lambda g: spatial.median(g, "m", 5),
        "median3": lambda g: spatial.median(g, "m", 3),
        "dilate": lambda g: spatial.dilate(g, "m", 2),
        "erode": lambda g: spatial.erode(g, "m", 1),
        "close_rect": lambda g: spatial.close(g, "m", 3),
        "close_ellipse": lambda g: spatial.close_ellipse(g, "m", 5),
        "dilate_ellipse": lambda g: spatial.dilate_ellipse(g, "m", 15),
        "contour_chain": lambda g: chains.connect(g, SIDE),
        "contour_largest_chain": lambda g: chains.connect_largest(g, SIDE, (0, 0)),
        "fill_holes": lambda g: shapes.by_frame(g, "m", shapes.fill_holes),
        "fill_reconstruct": lambda g: shapes.by_frame(g, "m", lambda m: shapes.fill_reconstruct(m)[0]),
        "largest_component": lambda g: shapes.by_frame(g, "m", shapes.largest_component),
        "contour_fill": lambda g: shapes.by_frame(g, "m", shapes.contour_fill),
        "seeded_fill": lambda g: shapes.by_frame(g, "m", lambda m: shapes.seeded_fill(m, (0, 0))),
        "refine_chain": lambda g: chains.refine(g, "prob"),
    }
    return {f.__name__: f for f in own} | {k: _mask(f) for k, f in masks.items()}


_GRID = """
WITH RECURSIVE g AS (
  SELECT vec_id AS frame, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x,
         CAST(embedding[pos] AS DOUBLE) AS e,
         CAST(greatest(0, least(255, floor(CAST(embedding[pos] AS DOUBLE) * 256 + 128))) AS INTEGER) AS grey,
         CASE WHEN embedding[pos] > 0 THEN 255 ELSE 0 END AS m,
         CAST(CAST(embedding[pos] AS DOUBLE) + 0.5 AS FLOAT) AS prob
  FROM embeddings, range(1, 65) t(pos))
"""


def _near(source: str, r: int, value: str, clamp: bool, out: str = "m") -> str:
    """Cells with an aggregate over their (2r + 1) x (2r + 1) neighbours."""
    on = "b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx))" if clamp else "b.y = a.y + dy AND b.x = a.x + dx"
    return f"SELECT a.frame, a.y, a.x, {value} AS {out} FROM {source} a, range(-{r}, {r + 1}) v(dy), range(-{r}, {r + 1}) h(dx) JOIN {source} b ON b.frame = a.frame AND {on} GROUP BY a.frame, a.y, a.x"


def _ellipse_sql(source: str, size: int, value: str) -> str:
    """An aggregate over the cells of an elliptic element that lie within the frame."""
    r = size // 2
    return f"SELECT a.frame, a.y, a.x, {value} AS m FROM {source} a JOIN {source} b ON b.frame = a.frame AND abs(b.y - a.y) <= {r} AND abs(b.x - a.x) <= round_even({r} * sqrt(({r * r} - (b.y - a.y) * (b.y - a.y)) / {r * r}.0), 0) GROUP BY a.frame, a.y, a.x"


def _median_sql(source: str, size: int) -> str:
    return _near(source, size // 2, f"CASE WHEN sum(CASE WHEN b.m = 255 THEN 1 ELSE 0 END) >= {size * size // 2 + 1} THEN 255 ELSE 0 END", True)


def _flood_sql(source: str, start: str) -> str:
    return f"""flood AS (
  SELECT frame, y, x FROM {source} WHERE m = 0 AND ({start})
  UNION
  SELECT b.frame, b.y, b.x FROM flood a JOIN {source} b ON b.frame = a.frame AND b.m = 0 AND abs(a.y - b.y) + abs(a.x - b.x) = 1)"""


def _fill_sql(source: str = "g", start: str = "y IN (0, 7) OR x IN (0, 7)", before: str = "") -> str:
    return f"""{_GRID}{before}, {_flood_sql(source, start)}
SELECT frame, y, x, CASE WHEN f.frame IS NULL THEN 255 ELSE 0 END AS m FROM {source} LEFT JOIN (SELECT DISTINCT * FROM flood) f USING (frame, y, x)"""


_SOBEL = """, n AS (
  SELECT a.frame, a.y, a.x, a.prob, dy, dx, b.grey AS v FROM g a, range(-1, 2) p(dy), range(-1, 2) q(dx)
  JOIN g b ON b.frame = a.frame AND b.y = 7 - abs(7 - abs(a.y + dy)) AND b.x = 7 - abs(7 - abs(a.x + dx))),
s AS (
  SELECT frame, y, x, prob, CAST(round_even((least(255, abs(sum(v * dx * (2 - abs(dy))))) + least(255, abs(sum(v * dy * (2 - abs(dx)))))) * 0.5, 0) AS INTEGER) AS edge
  FROM n GROUP BY frame, y, x, prob)"""
_TAPS = f"(SELECT unnest(range(-7, 8)) AS k, unnest({list(BLUR_TAPS)}) AS t)"


def _mirror(x: str) -> str:
    return f"(CASE WHEN ({x} + 14) % 14 > 7 THEN 14 - ({x} + 14) % 14 ELSE ({x} + 14) % 14 END)"


_BLUR = f""", h AS (
  SELECT a.frame, a.y, a.x, a.grey, a.m, sum(b.grey * t) AS v FROM g a, {_TAPS} k JOIN g b ON b.frame = a.frame AND b.y = a.y AND b.x = {_mirror("(a.x + k)")} GROUP BY ALL),
w AS (
  SELECT a.frame, a.y, a.x, a.grey, a.m, CAST((CAST(sum(b.v * t) AS BIGINT) + 32768) >> 16 AS INTEGER) AS v FROM h a, {_TAPS} k JOIN h b ON b.frame = a.frame AND b.x = a.x AND b.y = {_mirror("(a.y + k)")} GROUP BY ALL)"""
_CONFUSION = """WITH s AS (
  SELECT lang, n_chars > 1000 AS pred, quality = 1 AS truth FROM labels JOIN documents USING (doc_id) WHERE toxic = 0),
c AS (
  SELECT lang, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn FROM s GROUP BY lang)"""
_DIFF = _GRID + ", d AS (SELECT frame, count(*) FILTER ((m = 255) <> (e > 0.02)) AS differ FROM g GROUP BY frame)"


def _fold(name: str, **kw) -> str:
    return "WITH RECURSIVE " + oracles.fold_sql(name, oracles.EVENT_PIXELS, Params(**kw), LOW)


_FOLDED = " SELECT stream_id, frame_id, y, x, mask, bg_prob, n FROM f"
_CONTOUR_CHAIN = f""", d AS ({_ellipse_sql('g', 11, 'max(b.m)')}), c AS ({_ellipse_sql('d', 7, 'max(b.m)')}), o AS ({_ellipse_sql('c', 7, 'min(b.m)')}),
{oracles.filled_contours_sql('k', 'o', 8)}, e AS ({_ellipse_sql('k', 7, 'min(b.m)')})"""
_LARGEST_FILLED = """t AS (SELECT frame, max(m) AS top FROM b GROUP BY ALL),
z AS (SELECT b.frame, b.y, b.x, CASE WHEN t.top = 0 THEN 0 WHEN f.frame IS NULL THEN 255 ELSE 0 END AS m FROM b JOIN t USING (frame) LEFT JOIN (SELECT DISTINCT * FROM flood) f USING (frame, y, x))"""
#: The frames of `vector_frames`, and in `f` the model's results over their luma and chroma.
_FRAMES = f"""{_GRID}, u AS (SELECT row_number() OVER (PARTITION BY y, x ORDER BY frame) AS frame, y, x, grey FROM g),
i AS (SELECT frame, y, x, (grey // 40) * 40 AS b, (grey // 40) * 30 AS gr, (y + x) * 9 AS r FROM u),
l AS (SELECT *, (1868 * b + 9617 * gr + 4899 * r + 8192) >> 14 AS yy FROM i),
{oracles.fold_sql('f', "SELECT 'vectors' AS stream_id, frame AS frame_id, y, x, yy AS c0, least(255, greatest(0, CAST(floor(((r - yy) * 11682 + 2105344) / 16384.0) AS INTEGER))) AS c1, least(255, greatest(0, CAST(floor(((b - yy) * 9241 + 2105344) / 16384.0) AS INTEGER))) AS c2 FROM l", Params(), LOW)},
p AS (SELECT frame_id AS frame, y, x, mask, CASE WHEN CAST(bg_prob AS FLOAT) < CAST(0.5 AS FLOAT) THEN 255 ELSE 0 END AS m FROM f)"""


def _blurred_sql(name: str, value: str) -> str:
    return f"""{name}_h AS (SELECT a.frame, a.y, a.x, sum(b.{value} * t) AS v FROM i a, {_TAPS} k JOIN i b ON b.frame = a.frame AND b.y = a.y AND b.x = {_mirror("(a.x + k)")} GROUP BY ALL),
{name} AS (SELECT a.frame, a.y, a.x, CAST((CAST(sum(b.v * t) AS BIGINT) + 32768) >> 16 AS INTEGER) AS v FROM {name}_h a, {_TAPS} k JOIN {name}_h b ON b.frame = a.frame AND b.x = a.x AND b.y = {_mirror("(a.y + k)")} GROUP BY ALL)"""


_PIPELINE = f"""{_FRAMES}, o AS ({_median_sql('p', 5)}), {_flood_sql('o', 'y IN (0, 7) OR x IN (0, 7)')},
m AS (SELECT o.frame, o.y, o.x, CASE WHEN q.frame IS NULL THEN 255 ELSE 0 END AS m FROM o LEFT JOIN (SELECT DISTINCT * FROM flood) q USING (frame, y, x)),
{_blurred_sql('b0', 'b')}, {_blurred_sql('b1', 'gr')}, {_blurred_sql('b2', 'r')}
SELECT 'vectors' AS stream_id, m.frame AS frame_id, m.y, m.x, p.mask, m.m AS refined, CAST(CASE WHEN m.m <> 0 THEN i.b ELSE b0.v END AS INTEGER) AS b, CAST(CASE WHEN m.m <> 0 THEN i.gr ELSE b1.v END AS INTEGER) AS g, CAST(CASE WHEN m.m <> 0 THEN i.r ELSE b2.v END AS INTEGER) AS r
FROM m JOIN p USING (frame, y, x) JOIN i USING (frame, y, x) JOIN b0 USING (frame, y, x) JOIN b1 USING (frame, y, x) JOIN b2 USING (frame, y, x)"""
_SCORES = f"""{_FRAMES}, n AS (SELECT frame, y, x, CASE WHEN mask = 255 THEN 255 ELSE 0 END AS m FROM p), o AS ({_median_sql('p', 5)}), on_ AS ({_median_sql('n', 5)}),
a AS (SELECT 'raw mask' AS chain, * FROM n UNION ALL SELECT 'confidence', frame, y, x, m FROM p UNION ALL SELECT 'mask + median', * FROM on_ UNION ALL SELECT 'confidence + median', * FROM o),
j AS (SELECT a.chain, a.frame, a.m = 255 AS pred, i.b >= 160 AS truth FROM a JOIN i USING (frame, y, x) WHERE a.frame >= 10 AND NOT (a.y = 0 AND a.x = 0)),
c AS (SELECT chain, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn FROM j GROUP BY ALL),
e AS (SELECT chain, count(*) FILTER (NOT any_) AS empty FROM (SELECT chain, frame, bool_or(pred) AS any_ FROM j GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tp / greatest(tp + fp + fn, 1) AS iou FROM c JOIN e USING (chain))
SELECT *, 2 * p * r / greatest(p + r, CAST(1e-9 AS DOUBLE)) AS f1 FROM s"""


def _leaderboard_sql() -> str:
    ctes = [f"{_GRID}{_SOBEL}", f"t AS ({_SELECT_M.format(_ON_CONFIDENCE)} FROM g)"]
    floods = []

    def fill(source: str) -> str:
        floods.append(source)
        name = f"{source}_f"
        ctes.append(_flood_sql(source, "y IN (0, 7) OR x IN (0, 7)").replace("flood", f"{source}_q"))
        ctes.append(f"{name} AS (SELECT s.frame, s.y, s.x, CASE WHEN q.frame IS NULL THEN 255 ELSE 0 END AS m FROM {source} s LEFT JOIN (SELECT DISTINCT * FROM {source}_q) q USING (frame, y, x))")
        return name

    def put(name: str, query: str) -> str:
        ctes.append(f"{name} AS ({query})")
        return name

    def contour(name: str, source: str) -> str:
        a = put(f"{name}_1", _ellipse_sql(source, 11, "max(b.m)"))
        b = put(f"{name}_3", _ellipse_sql(put(f"{name}_2", _ellipse_sql(a, 7, "max(b.m)")), 7, "min(b.m)"))
        ctes.append(oracles.filled_contours_sql(f"{name}_k", b, 8))
        return put(name, _ellipse_sql(f"{name}_k", 7, "min(b.m)"))

    own = {"raw mask": put("raw", "SELECT frame, y, x, m FROM g"), "mask + median": put("raw5", _median_sql("raw", 5)), "confidence": "t", "confidence + median": put("t5", _median_sql("t", 5))}
    own["mask + median + fill"], own["confidence + median + fill"] = fill("raw5"), fill("t5")
    closed = put("cl", _near(put("op", _near("t5", 7, "max(b.m)", False)), 7, "min(b.m)", False))
    own["confidence + median + close + fill"] = fill(closed)
    own["weak gate"] = put("wk", f"{_SELECT_M.format('CASE WHEN edge >= 1 AND prob <= CAST(0.4 AS FLOAT) THEN 255 ELSE 0 END')} FROM s")
    own["weak gate + median"] = put("wk3", _median_sql("wk", 3))
    own["weak gate + median + fill"] = fill("wk3")
    own["weak gate + median + contour"] = contour("wkc", "wk3")
    strict = put("st", f"{_SELECT_M.format('CASE WHEN edge >= 10 AND prob <= CAST(0.2 AS FLOAT) THEN 255 ELSE 0 END')} FROM s")
    own["strict gate + median + contour"] = contour("stc", put("st5", _median_sql(strict, 5)))
    ctes.append(oracles.largest_sql("big", "stc"))
    ctes.append(_flood_sql("big", "y = 0 AND x = 0").replace("flood", "big_q"))
    put("top_", "SELECT frame, max(m) AS top FROM big GROUP BY ALL")
    put("big_f", "SELECT b.frame, b.y, b.x, CASE WHEN o.top = 0 THEN 0 WHEN q.frame IS NULL THEN 255 ELSE 0 END AS m FROM big b JOIN top_ o USING (frame) LEFT JOIN (SELECT DISTINCT * FROM big_q) q USING (frame, y, x)")
    own["strict gate + median + contour + largest + fill"] = put("big_e", _ellipse_sql("big_f", 7, "min(b.m)"))
    put("every", " UNION ALL ".join(f"SELECT '{name}' AS chain, frame, y, x, m FROM {source}" for name, source in own.items()))
    put("j", "SELECT chain, frame, every.m = 255 AS pred, e > 0.02 AS truth FROM every JOIN g USING (frame, y, x)")
    put("c_", "SELECT chain, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn FROM j GROUP BY ALL")
    put("e_", "SELECT chain, count(*) FILTER (NOT any_) AS empty FROM (SELECT chain, frame, bool_or(pred) AS any_ FROM j GROUP BY ALL) GROUP BY ALL")
    put("s_", "SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tp / greatest(tp + fp + fn, 1) AS iou FROM c_ JOIN e_ USING (chain)")
    return ", ".join(ctes) + " SELECT *, 2 * p * r / greatest(p + r, CAST(1e-9 AS DOUBLE)) AS f1 FROM s_"


_SELECT_M = "SELECT frame, y, x, {} AS m"
_ON_CONFIDENCE = "CASE WHEN prob < CAST(0.5 AS FLOAT) THEN 255 ELSE 0 END"


def oracle_sql():
    bytes_ = "least(255, greatest(0, {})) "
    m = "SELECT frame, y, x, {} AS m FROM g"
    dilate = lambda source, r: _near(source, r, "max(b.m)", False)
    erode = lambda source, r: _near(source, r, "min(b.m)", False)
    return {
        "color_ycrcb": f"""WITH c AS (SELECT *, CAST(floor(l_quantity * 5) AS INTEGER) % 256 AS b, CAST((l_orderkey * 7) % 256 AS INTEGER) AS g, CAST((l_partkey * 3) % 256 AS INTEGER) AS r FROM lineitem),
          d AS (SELECT *, {bytes_.format('(1868 * b + 9617 * g + 4899 * r + 8192) >> 14')} AS luma, (1868 * b + 9617 * g + 4899 * r + 8192) >> 14 AS yy FROM c)
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(luma AS INTEGER) AS luma,
            CAST(least(255, greatest(0, CAST(floor(((r - yy) * 11682 + 2105344) / 16384.0) AS INTEGER))) AS INTEGER) AS cr,
            CAST(least(255, greatest(0, CAST(floor(((b - yy) * 9241 + 2105344) / 16384.0) AS INTEGER))) AS INTEGER) AS cb FROM d""",
        "alpha_ramp": "WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, 1.0 / CAST(least(2 * n, 250) AS DOUBLE) AS auto, CASE WHEN n > 1 THEN CAST(0.2 AS DOUBLE) ELSE 1.0 / CAST(least(2 * n, 250) AS DOUBLE) END AS fixed FROM e",
        "threshold_confidence": _GRID + m.format("CASE WHEN prob < CAST(0.5 AS FLOAT) THEN 255 ELSE 0 END"),
        "binarize": _GRID + m.format("CASE WHEN e > 0.1 THEN 255 ELSE 0 END"),
        "sobel_edges": _GRID + _SOBEL + " SELECT frame, y, x, edge FROM s",
        "gates": _GRID + _SOBEL + " SELECT frame, y, x, CASE WHEN edge >= 1 AND prob <= CAST(0.4 AS FLOAT) THEN 255 ELSE 0 END AS weak, CASE WHEN edge >= 10 AND prob <= CAST(0.2 AS FLOAT) THEN 255 ELSE 0 END AS strict FROM s",
        "median5": _GRID + _median_sql("g", 5),
        "median3": _GRID + _median_sql("g", 3),
        "dilate": _GRID + dilate("g", 2),
        "erode": _GRID + erode("g", 1),
        "close_rect": _GRID + f", o AS ({dilate('g', 1)}) " + erode("o", 1),
        "dilate_ellipse": _GRID + _ellipse_sql("g", 15, "max(b.m)"),
        "close_ellipse": _GRID + f", o AS ({_ellipse_sql('g', 5, 'max(b.m)')}) " + _ellipse_sql("o", 5, "min(b.m)"),
        "fill_holes": _fill_sql(),
        "fill_reconstruct": _fill_sql(),
        "contour_fill": f"{_GRID}, {oracles.filled_contours_sql('k', 'g', 8)} SELECT frame, y, x, m FROM k",
        "contour_chain": _GRID + _CONTOUR_CHAIN + " SELECT frame, y, x, m FROM e",
        "contour_largest_chain": f"{_GRID}{_CONTOUR_CHAIN}, {oracles.largest_sql('b', 'e')}, {_flood_sql('b', 'y = 0 AND x = 0')}, {_LARGEST_FILLED} {_ellipse_sql('z', 7, 'min(b.m)')}",
        "largest_component": f"{_GRID}, {oracles.largest_sql('b', 'g')} SELECT frame, y, x, m FROM b",
        "hole_count": f"""{_GRID}, {oracles.components_sql('h', 'g', 'm = 0', False)},
          e AS (SELECT frame, label FROM h GROUP BY ALL HAVING min(least(y, x)) > 0 AND max(greatest(y, x)) < 7)
          SELECT frame, (SELECT count(*) FROM e WHERE e.frame = f.frame) AS holes FROM (SELECT DISTINCT frame FROM g) f""",
        "mixture_fold": _fold("f") + _FOLDED,
        "mixture_shadow": _fold("f", detect_shadows=True) + _FOLDED,
        "mixture_adaptive": "WITH RECURSIVE " + oracles.fold_sql("f", oracles.EVENT_PIXELS, Params(adaptive=True)) + _FOLDED,
        "state_snapshot": _fold("f") + " SELECT stream_id, frame_id, y, x, CAST(k AS INTEGER) AS k, w[k + 1]::DOUBLE AS w, v[k + 1]::DOUBLE AS v, m0[k + 1]::DOUBLE AS m0, m1[k + 1]::DOUBLE AS m1, m2[k + 1]::DOUBLE AS m2 FROM f, range(0, 5) r(k) WHERE k < n",
        "chain_leaderboard": _leaderboard_sql(),
        "inverse_color": """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity * 5) AS INTEGER) % 256 AS y, CAST((l_orderkey * 7) % 256 AS INTEGER) - 128 AS cr, CAST((l_partkey * 3) % 256 AS INTEGER) - 128 AS cb FROM lineitem)
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(255, greatest(0, y + CAST(floor((cb * 29049 + 8192) / 16384.0) AS INTEGER))) AS INTEGER) AS b,
            CAST(least(255, greatest(0, y + CAST(floor((cb * -5636 + cr * -11698 + 8192) / 16384.0) AS INTEGER))) AS INTEGER) AS g,
            CAST(least(255, greatest(0, y + CAST(floor((cr * 22987 + 8192) / 16384.0) AS INTEGER))) AS INTEGER) AS r FROM c""",
        "median_rounds": "SELECT l_returnflag AS name, median(CAST(l_quantity AS DOUBLE)) AS milliseconds, count(*) AS rounds FROM lineitem GROUP BY ALL",
        "stage_shares": "SELECT l_returnflag AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS milliseconds, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) FROM lineitem) AS share FROM lineitem GROUP BY ALL",
        "profile_shares": """WITH s AS (SELECT l_returnflag AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS milliseconds FROM lineitem GROUP BY ALL)
          SELECT name, milliseconds, sum(milliseconds) OVER (ORDER BY milliseconds DESC, name) / sum(milliseconds) OVER () AS reached FROM s""",
        "bus_load": "SELECT o_orderkey, CAST(o_orderkey % 1080 + 1 AS BIGINT) * 1920 * 17 AS apart, CAST(o_orderkey % 1080 + 1 AS BIGINT) * 1920 * 8 AS fused FROM orders",
        "background_image": _fold("f") + " " + oracles.background_sql("f"),
        "foreground_counts": _fold("f") + " SELECT stream_id, frame_id, count(*) FILTER (CAST(bg_prob AS FLOAT) < CAST(0.5 AS FLOAT)) AS foreground, count(*) AS pixels FROM f WHERE frame_id > 5 GROUP BY ALL",
        "prune_events": _fold("f") + " SELECT stream_id, y, x, CAST(sum(greatest(before - n, 0)) AS BIGINT) AS pruned FROM (SELECT *, lag(n, 1, n) OVER (PARTITION BY stream_id, y, x ORDER BY frame_id) AS before FROM f) GROUP BY ALL",
        "first_divergence": f"{_fold('f')}, {oracles.fold_sql('h', oracles.EVENT_PIXELS, Params(modes=3), LOW)} SELECT stream_id, y, x, min(frame_id) AS first_frame FROM f JOIN h USING (stream_id, frame_id, y, x) WHERE abs(f.bg_prob - h.bg_prob) > 1e-4 GROUP BY ALL",
        "pipeline_frames": _PIPELINE,
        "pipeline_planes": _PIPELINE,
        "model_planes": _FRAMES + _FOLDED,
        "score_chains": _SCORES,
        "seeded_fill": _fill_sql(start="y = 0 AND x = 0"),
        "refine_chain": _fill_sql("o", before=f", b AS ({m.format('CASE WHEN prob < CAST(0.5 AS FLOAT) THEN 255 ELSE 0 END')}), o AS ({_median_sql('b', 5)})"),
        "blur_q8": _GRID + _BLUR + " SELECT frame, y, x, v AS grey FROM w",
        "composite": _GRID + _BLUR + " SELECT frame, y, x, CASE WHEN m <> 0 THEN grey ELSE v END AS value FROM w",
        "confusion": _CONFUSION + " SELECT * FROM c",
        "metrics": _CONFUSION + ", q AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tp / greatest(tp + fp + fn, 1) AS iou FROM c) SELECT *, 2 * p * r / greatest(p + r, CAST(1e-9 AS DOUBLE)) AS f1 FROM q",
        "mask_diff": _DIFF + " SELECT * FROM d",
        "cumulative_diff": _DIFF + " SELECT *, CAST(sum(differ) OVER (ORDER BY frame) AS BIGINT) AS total FROM d",
        "agreement": _GRID + " SELECT count(*) FILTER ((m = 255) = (e > 0.02)) / count(*) AS agreement FROM g",
        "error_classes": _GRID + " SELECT CASE WHEN m = 255 AND e > 0.02 THEN 'ok' WHEN m = 255 THEN 'fp' WHEN e > 0.02 THEN 'fn' ELSE 'none' END AS kind, count(*) AS cells FROM g GROUP BY ALL",
    }
