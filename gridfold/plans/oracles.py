"""DuckDB SQL of the background model and of components: a second way to the same results.

The fold is a recursive query with a step for each frame; within a step a sub-query for each mode
follows the published rules on lists, in single precision.
"""

from __future__ import annotations

from gridfold.params import Params

#: (stream_id, frame_id, y, x, c0, c1, c2) of `gridfold.sources.carriers.event_pixels`.
EVENT_PIXELS = """SELECT 'events' AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id,
  CAST(user_id // 15 AS INTEGER) AS y, CAST(user_id % 15 AS INTEGER) AS x, CAST(floor(value / 100) * 40 AS INTEGER) AS c0, 0 AS c1, 0 AS c2 FROM events"""


def _f(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


def _moved(a: str, k: str, to: str, value: str, size: int) -> str:
    """The list `a` with `value` at `to`, where what was at `k` (not before `to`) is gone."""
    return f"list_concat({a}[1:{to} - 1], [{value}], {a}[{to}:{k} - 1], {a}[{k} + 1:{size}])"


def fold_sql(name: str, pixels: str, params: Params = Params(), update: float = -1.0) -> str:
    """CTEs (for WITH RECURSIVE): `name` has a row for each pixel and frame, with mask, bg_prob,
    n and the lists w, v, m0, m1, m2 after it. Frames of a pixel are numbered from 1."""
    size, channels = params.modes, [f"m{i}" for i in range(params.channels)]
    ramp = f"CAST(1.0::DOUBLE / least(2 * t, {params.history}) AS FLOAT)"
    base = ramp if update < 0 else f"CASE WHEN t > 1 THEN {_f(update)} ELSE {ramp} END"
    q = f"""SELECT s.* REPLACE (s.t + 1 AS t), {', '.join(f'CAST(p.c{i} AS FLOAT) AS x{i}' for i in range(params.channels))},
      {_f(0)} AS total, {_f(0)} AS found, false AS back, false AS fit FROM {name}_s s JOIN {name}_p p ON p.stream_id = s.stream_id AND p.y = s.y AND p.x = s.x AND p.frame_id = s.t + 1"""
    q = f"SELECT *, {base} AS base FROM ({q})"
    q = f"SELECT *, {'a' if params.adaptive else 'base'} AS alpha FROM ({q})"
    q = f"SELECT *, {_f(1)} - alpha AS one, -alpha * {_f(params.complexity)} AS prune FROM ({q})"
    for k in range(1, size + 1):
        d2 = " + ".join(f"d{i} * d{i}" for i in range(len(channels)))
        q = f"SELECT *, {k} <= n AS live, w[{k}] AS old, {', '.join(f'{c}[{k}] - x{i} AS d{i}' for i, c in enumerate(channels))} FROM ({q})"
        q = f"SELECT *, {d2} AS far FROM ({q})"
        q = f"SELECT *, live AND NOT fit AND far < {_f(params.background_threshold)} * v[{k}] AS near, live AND NOT fit AND far < {_f(params.generation_threshold)} * v[{k}] AS close FROM ({q})"
        q = f"SELECT *, CASE WHEN close THEN one * old + prune + alpha ELSE one * old + prune END AS wk FROM ({q})"
        q = f"SELECT *, CASE WHEN close THEN alpha / wk ELSE {_f(0)} END AS rate FROM ({q})"
        above = ", ".join(f"CASE WHEN wk < w[{j}] THEN {j} ELSE 0 END" for j in range(1, k))
        q = f"SELECT *, CASE WHEN close THEN {f'1 + greatest(0, {above})' if above else 1} ELSE {k} END AS place, live AND wk < -prune AS gone FROM ({q})"
        new_v = f"CASE WHEN close THEN least(greatest(v[{k}] + rate * (far - v[{k}]), {_f(params.var_min)}), {_f(params.var_max)}) ELSE v[{k}] END"
        moved = [f"{_moved('w', str(k), 'place', f'CASE WHEN NOT live THEN old WHEN gone THEN {_f(0)} ELSE wk END', size)} AS w", f"{_moved('v', str(k), 'place', new_v, size)} AS v"]
        moved += [f"{_moved(c, str(k), 'place', f'CASE WHEN close THEN {c}[{k}] - rate * d{i} ELSE {c}[{k}] END', size)} AS {c}" for i, c in enumerate(channels)]
        q = f"""SELECT * EXCLUDE (live, old, far, near, close, wk, rate, place, gone, {', '.join(f'd{i}' for i in range(len(channels)))}) REPLACE ({', '.join(moved)},
          CASE WHEN near THEN found + old ELSE found END AS found, back OR (near AND total < {_f(params.background_ratio)}) AS back, fit OR close AS fit,
          CASE WHEN gone THEN n - 1 ELSE n END AS n, CASE WHEN NOT live THEN total WHEN gone THEN total + {_f(0)} ELSE total + wk END AS total) FROM ({q})"""
    q = f"SELECT *, CASE WHEN abs(total) > {_f(1.1920929e-07)} THEN {_f(1)} / total ELSE {_f(0)} END AS scale FROM ({q})"
    q = f"SELECT * REPLACE ([{', '.join(f'CASE WHEN {i} <= n THEN w[{i}] * scale ELSE w[{i}] END' for i in range(1, size + 1))}] AS w) FROM ({q})"
    q = f"SELECT *, NOT fit AND alpha > 0 AS fresh FROM ({q})"
    q = f"SELECT * REPLACE (CASE WHEN fresh THEN least(n + 1, {size}) ELSE n END AS n) FROM ({q})"
    q = f"SELECT * REPLACE ([{', '.join(f'CASE WHEN fresh AND {i} < n THEN w[{i}] * one ELSE w[{i}] END' for i in range(1, size + 1))}] AS w) FROM ({q})"
    above = ", ".join(f"CASE WHEN {j} < n AND alpha < w[{j}] THEN {j} ELSE 0 END" for j in range(1, size + 1))
    q = f"SELECT *, 1 + greatest({above}) AS place FROM ({q})"
    put = lambda a, value: f"CASE WHEN fresh THEN {_moved(a, 'n', 'place', value, size)} ELSE {a} END AS {a}"
    q = f"""SELECT * REPLACE ({put('w', f'CASE WHEN n = 1 THEN {_f(1)} ELSE alpha END')}, {put('v', _f(params.var_init))}, {', '.join(put(c, f'x{i}') for i, c in enumerate(channels))},
      CASE WHEN back THEN least(alpha * {_f(1.02)}, base) ELSE greatest(alpha * {_f(0.98)}, base / {_f(8)}) END AS a) FROM ({q})"""
    if params.detect_shadows:
        q = f"SELECT *, false AS dark, false AS done, {_f(0)} AS sum FROM ({q})"
        for k in range(1, size + 1):
            pairs = [(f"x{i}", f"{c}[{k}]") for i, c in enumerate(channels)]
            q = f"SELECT *, NOT done AND {k} <= n AS live, {' + '.join(f'{x} * {m}' for x, m in pairs)} AS num, {' + '.join(f'{m} * {m}' for _, m in pairs)} AS den FROM ({q})"
            q = f"SELECT * REPLACE (done OR (live AND den = 0) AS done, live AND den <> 0 AS live), CASE WHEN den <> 0 THEN num / den ELSE {_f(0)} END AS r FROM ({q})"
            off = " + ".join(f"(r * {m} - {x}) * (r * {m} - {x})" for x, m in pairs)
            q = f"SELECT *, live AND num <= den AND num >= {_f(params.shadow_ratio)} * den AND {off} < {_f(params.background_threshold)} * v[{k}] * r * r AS here FROM ({q})"
            q = f"SELECT * REPLACE (CASE WHEN live THEN sum + w[{k}] ELSE sum END AS sum) FROM ({q})"
            q = f"SELECT * EXCLUDE (live, num, den, r, here) REPLACE (dark OR here AS dark, done OR here OR (live AND sum > {_f(params.background_ratio)}) AS done) FROM ({q})"
    mask = "CASE WHEN back THEN 0 WHEN dark THEN 127 ELSE 255 END" if params.detect_shadows else "CASE WHEN back THEN 0 ELSE 255 END"
    state = ["w", "v", *channels]
    zeros = f"[{', '.join([_f(0)] * size)}]"
    return f"""{name}_p AS MATERIALIZED ({pixels}),
{name}_s AS (
  SELECT DISTINCT stream_id, y, x, CAST(0 AS BIGINT) AS t, 0 AS n, {', '.join(f'{zeros} AS {c}' for c in state)}, {_f(0.5)} AS a, 0 AS mask, {_f(0)} AS prob FROM {name}_p
  UNION ALL
  SELECT stream_id, y, x, t, n, {', '.join(state)}, a, {mask}, found FROM ({q})),
{name} AS (SELECT stream_id, t AS frame_id, y, x, mask, CAST(prob AS DOUBLE) AS bg_prob, n, {', '.join(state)} FROM {name}_s WHERE t > 0)"""


def background_sql(source: str, params: Params = Params()) -> str:
    """The learned background of every pixel from the rows of `fold_sql`."""
    q = f"SELECT *, {_f(0)} AS before, {_f(0)} AS weight, {', '.join(f'{_f(0)} AS s{i}' for i in range(params.channels))} FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY stream_id, y, x ORDER BY frame_id DESC) = 1)"
    for k in range(1, params.modes + 1):
        q = f"SELECT *, CASE WHEN {k} <= n AND before < {_f(params.background_ratio)} THEN w[{k}] ELSE {_f(0)} END AS u FROM ({q})"
        q = f"SELECT * EXCLUDE (u) REPLACE (weight + u AS weight, {', '.join(f's{i} + u * m{i}[{k}] AS s{i}' for i in range(params.channels))}, CASE WHEN {k} <= n THEN before + w[{k}] ELSE before END AS before) FROM ({q})"
    value = lambda i: f"CAST(least(255, greatest(0, CASE WHEN weight > 0 THEN round_even(CAST(s{i} / weight AS DOUBLE), 0) ELSE 0 END)) AS INTEGER) AS c{i}"
    return f"SELECT stream_id, y, x, {', '.join(value(min(i, params.channels - 1)).replace(f'AS c{params.channels - 1}', f'AS c{i}') if i >= params.channels else value(i) for i in range(3))} FROM ({q})"


def components_sql(name: str, source: str, on: str, eight: bool = True) -> str:
    """CTEs: `name` (frame, y, x, label) of the cells of `source` where `on` holds; a component's
    label is the place of its first cell in its frame."""
    step = "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1" if eight else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{name}_c AS (SELECT frame, y, x FROM {source} WHERE {on}),
{name}_r AS (
  SELECT frame, y * 1000 + x AS root, y, x FROM {name}_c
  UNION
  SELECT a.frame, a.root, b.y, b.x FROM {name}_r a JOIN {name}_c b ON b.frame = a.frame AND {step}),
{name} AS (SELECT frame, y, x, min(root) AS label FROM {name}_r GROUP BY ALL)"""


def filled_contours_sql(name: str, source: str, side: int) -> str:
    """CTEs: `name` (frame, y, x, m), every 8-connected component and all it encloses: what a
    walk around the frame by side steps can't reach without crossing the component."""
    around = f"SELECT ay.y, ax.x FROM range(-1, {side + 1}) ay(y), range(-1, {side + 1}) ax(x)"
    return f"""{components_sql(f"{name}_l", source, "m <> 0")},
{name}_o AS (
  SELECT DISTINCT frame, label, CAST(-1 AS BIGINT) AS y, CAST(-1 AS BIGINT) AS x FROM {name}_l
  UNION
  SELECT o.frame, o.label, b.y, b.x FROM {name}_o o JOIN ({around}) b ON abs(o.y - b.y) + abs(o.x - b.x) = 1
  WHERE NOT EXISTS (SELECT 1 FROM {name}_l l WHERE l.frame = o.frame AND l.label = o.label AND l.y = b.y AND l.x = b.x)),
{name}_i AS (
  SELECT DISTINCT f.frame, c.y, c.x FROM (SELECT DISTINCT frame, label FROM {name}_l) f, ({around}) c
  WHERE NOT EXISTS (SELECT 1 FROM {name}_o o WHERE o.frame = f.frame AND o.label = f.label AND o.y = c.y AND o.x = c.x)),
{name} AS (SELECT s.frame, s.y, s.x, CASE WHEN i.frame IS NULL THEN 0 ELSE 255 END AS m FROM {source} s LEFT JOIN {name}_i i USING (frame, y, x))"""


def largest_sql(name: str, source: str) -> str:
    """CTEs: `name` (frame, y, x, m), the largest component of each frame, of equal ones the first."""
    return f"""{components_sql(f"{name}_l", source, "m <> 0")},
{name}_b AS (SELECT frame, label FROM (SELECT frame, label, count(*) AS cells FROM {name}_l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY cells DESC, label) = 1),
{name} AS (SELECT s.frame, s.y, s.x, CASE WHEN b.label IS NULL THEN 0 ELSE 255 END AS m FROM {source} s LEFT JOIN {name}_l l USING (frame, y, x) LEFT JOIN {name}_b b ON b.frame = l.frame AND b.label = l.label)"""
