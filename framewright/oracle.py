"""The same queries in SQL, for comparison only."""

from __future__ import annotations

import math
import re

from .operators.motion import RINGS
from .operators.transform import QUANT


def _values(rows) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(map(repr, r))})" for r in rows) + ")"


def _axis(n: int) -> str:
    return _values([(i,) for i in range(n)])


def _basis(m: int) -> str:
    step = lambda k: 1 / math.sqrt(m) if k == 0 else math.sqrt(2.0 / m)
    rows = [(k, i, f"{step(k) * math.cos((2 * i + 1) * k * math.pi / (2 * m))!r}") for k in range(m) for i in range(m)]
    return f"SELECT k, i, CAST(w AS DOUBLE) AS w FROM {_values(rows)} t(k, i, w)"


def _quant(plane: str, m: int) -> str:
    return f"SELECT * FROM {_values([(v, u, q) for v, r in enumerate(QUANT[plane, m]) for u, q in enumerate(r)])} t(v, u, q)"


def _dct(src: str, keys: str, m: int) -> str:
    return f"""SELECT {keys}, v, u, round(s, 6) AS coef FROM (SELECT {keys}, b1.k AS v, b2.k AS u, sum((val - 128.0) * b1.w * b2.w) AS s
        FROM {src} JOIN basis{m} b1 ON b1.i = x JOIN basis{m} b2 ON b2.i = y GROUP BY {keys}, b1.k, b2.k)"""


_OBJ = "x >= ox AND x < ox + 8 AND y >= oy AND y < oy + 8"
_SIZES = {s: f"""SELECT p.video_id, p.f, p.bx, p.by, {s} AS size, r, g, b, n,
        qr - 2 * r * sr + n * r * r + qg - 2 * g * sg + n * g * g + qb - 2 * b * sb + n * b * b AS dev2
    FROM (SELECT video_id, f, x // {s} AS bx, y // {s} AS by, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r) AS qr, sum(g * g) AS qg, sum(b * b) AS qb, count(*) AS n FROM px GROUP BY ALL) p
    JOIN (SELECT video_id, f, cx // {s // 4} AS bx, cy // {s // 4} AS by, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b FROM cells GROUP BY ALL) m
    USING (video_id, f, bx, by)""" for s in (4, 8, 16, 32)}  # fmt: skip

_PARTS = {"y8": "chan = 'Y' AND size > 4", "y4": "chan = 'Y' AND size = 4", "c4": "chan <> 'Y' AND size > 4", "c2": "chan <> 'Y' AND size = 4"}

CTES = {
    "px": f"""SELECT video_id, f, x, y,
        CAST(CASE WHEN {_OBJ} THEN (x - ox) * 17 + (y - oy) * 11 + 40 ELSE (x * 2 + y * 3 + video_id * 11) % 200 END AS INT) AS r,
        CAST(CASE WHEN {_OBJ} THEN 220 - (x - ox) * 9 ELSE (x + y * 2 + video_id * 7) % 180 END AS INT) AS g,
        CAST(CASE WHEN {_OBJ} THEN (y - oy) * 25 + 30 ELSE (x * 3 + y + video_id * 5) % 220 END AS INT) AS b
        FROM (SELECT CAST(s_suppkey AS BIGINT) AS video_id, f, x, y, 4 + (s_suppkey % 4) * f AS ox, 4 + (s_suppkey % 3) * f AS oy
              FROM supplier, {_axis(6)} a(f), {_axis(32)} b(x), {_axis(32)} c(y)) WHERE NOT (f = 5 AND video_id % 10 = 7)""",
    "tiles": "SELECT vec_id AS tile, CAST((i - 1) // 8 AS INT) AS x, CAST((i - 1) % 8 AS INT) AS y, CAST(floor(CAST(embedding[i] AS DOUBLE) * 256) AS BIGINT) AS val FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
    "sub4": "SELECT tile, CAST((x // 4) * 2 + y // 4 AS INT) AS sub, x % 4 AS x, y % 4 AS y, val FROM tiles",
    "sub2": "SELECT tile, CAST((x // 2) * 4 + y // 2 AS INT) AS sub, x % 2 AS x, y % 2 AS y, val FROM tiles",
    "basis8": _basis(8), "basis4": _basis(4), "basis2": _basis(2), "qy8": _quant("Y", 8), "qc4": _quant("C", 4), "qy4": _quant("Y", 4), "qc2": _quant("C", 2),
    "d8": _dct("tiles", "tile", 8),
    "wide8": _dct("(SELECT tile, x, y, val * 40 AS val FROM tiles)", "tile", 8),
    "l8": "SELECT tile, v, u, CAST(floor(coef / q + 0.5) AS INT) AS level FROM d8 JOIN qy8 USING (v, u)",
    "fi": "SELECT video_id, f, CAST(row_number() OVER w - 1 AS INT) AS n, lag(f) OVER w AS prev_f FROM (SELECT DISTINCT video_id, f FROM px) WINDOW w AS (PARTITION BY video_id ORDER BY f)",
    "luma": "SELECT video_id, f, x, y, CAST(299 * r + 587 * g + 114 * b AS BIGINT) AS ym FROM px",
    "luma_now": "SELECT l.*, prev_f FROM luma l JOIN fi ON l.video_id = fi.video_id AND l.f = fi.f WHERE prev_f IS NOT NULL",
    "chroma": """SELECT video_id, f, x // 2 AS cx, y // 2 AS cy,
        CAST(floor(sum((128000000 - 168736 * r - 331264 * g + 500000 * b) * w) / 8000.0) AS BIGINT) AS um,
        CAST(floor(sum((128000000 + 500000 * r - 418688 * g - 81312 * b) * w) / 8000.0) AS BIGINT) AS vm
        FROM (SELECT *, CASE WHEN y % 2 = 0 THEN 1 WHEN x % 2 = 0 THEN 2 ELSE 4 END AS w FROM px) GROUP BY ALL""",
    "rgb": """SELECT video_id, f, x, y, CAST(greatest(0, least(255, floor(yy + 1.402 * v + 0.5))) AS INT) AS r,
        CAST(greatest(0, least(255, floor(yy - 0.344136 * u - 0.714136 * v + 0.5))) AS INT) AS g, CAST(greatest(0, least(255, floor(yy + 1.772 * u + 0.5))) AS INT) AS b
        FROM (SELECT l.video_id, l.f, x, y, CAST(ym AS DOUBLE) / 1000 AS yy, CAST(um AS DOUBLE) / 1000 - 128 AS u, CAST(vm AS DOUBLE) / 1000 - 128 AS v
              FROM luma l JOIN chroma c ON l.video_id = c.video_id AND l.f = c.f AND c.cx = x // 2 AND c.cy = y // 2)""",
    "cells": "SELECT video_id, f, x // 4 AS cx, y // 4 AS cy, CAST(sum(r) // 16 AS INT) AS r, CAST(sum(g) // 16 AS INT) AS g, CAST(sum(b) // 16 AS INT) AS b FROM px GROUP BY ALL",
    **{f"b{s}": q for s, q in _SIZES.items()},
    "s32": "SELECT * FROM b32 WHERE dev2 > 2025 * n",
    "s16": "SELECT b.* FROM b16 b JOIN s32 p ON b.video_id = p.video_id AND b.f = p.f AND b.bx // 2 = p.bx AND b.by // 2 = p.by WHERE b.dev2 > 2025 * b.n",
    "s8": "SELECT b.* FROM b8 b JOIN s16 p ON b.video_id = p.video_id AND b.f = p.f AND b.bx // 2 = p.bx AND b.by // 2 = p.by WHERE b.dev2 > 2025 * b.n",
    "leaves": """SELECT video_id, f, bx * size AS x, by * size AS y, size, r, g, b FROM (
        SELECT * FROM b32 WHERE NOT dev2 > 2025 * n
        UNION ALL SELECT b.* FROM b16 b JOIN s32 p ON b.video_id = p.video_id AND b.f = p.f AND b.bx // 2 = p.bx AND b.by // 2 = p.by WHERE NOT b.dev2 > 2025 * b.n
        UNION ALL SELECT b.* FROM b8 b JOIN s16 p ON b.video_id = p.video_id AND b.f = p.f AND b.bx // 2 = p.bx AND b.by // 2 = p.by WHERE NOT b.dev2 > 2025 * b.n
        UNION ALL SELECT b.* FROM b4 b JOIN s8 p ON b.video_id = p.video_id AND b.f = p.f AND b.bx // 2 = p.bx AND b.by // 2 = p.by)""",
    "change": """SELECT * FROM (SELECT l.video_id, l.f, l.x // 8 AS bx, l.y // 8 AS by, CAST(sum((l.ym - p.ym) * (l.ym - p.ym)) AS BIGINT) AS sy, count(*) AS ny
        FROM luma l JOIN fi ON l.video_id = fi.video_id AND l.f = fi.f JOIN luma p ON p.video_id = l.video_id AND p.f = fi.prev_f AND p.x = l.x AND p.y = l.y GROUP BY ALL)
        JOIN (SELECT l.video_id, l.f, l.cx // 4 AS bx, l.cy // 4 AS by, CAST(sum((l.um - p.um) * (l.um - p.um)) AS BIGINT) AS su, CAST(sum((l.vm - p.vm) * (l.vm - p.vm)) AS BIGINT) AS sv, count(*) AS nu
        FROM chroma l JOIN fi ON l.video_id = fi.video_id AND l.f = fi.f JOIN chroma p ON p.video_id = l.video_id AND p.f = fi.prev_f AND p.cx = l.cx AND p.cy = l.cy GROUP BY ALL) USING (video_id, f, bx, by)""",
    "changed": "SELECT video_id, f, bx, by FROM change WHERE sy > 1550000 * ny OR su > 3600000 * nu OR sv > 3600000 * nu",
    "refs": "SELECT a.video_id, a.f, b.f AS ref_f, CAST(4 - (b.n - greatest(0, a.n - 4)) AS INT) AS ref FROM fi a JOIN fi b ON a.video_id = b.video_id AND b.n BETWEEN a.n - 4 AND a.n - 1",
    "cand": f"""SELECT c.video_id, c.f, bx, by, ref_f, dx, dy FROM changed c JOIN refs USING (video_id, f), (SELECT i - 2 AS dx FROM {_axis(4)} t(i)), (SELECT i - 2 AS dy FROM {_axis(4)} t(i))
        WHERE bx * 8 + dx BETWEEN 0 AND 24 AND by * 8 + dy BETWEEN 0 AND 24""",
    "cost": """SELECT video_id, f, bx, by, ref_f, dx, dy, CAST(sy + 4 * su + 4 * sv AS BIGINT) AS cost FROM
        (SELECT c.video_id, c.f, bx, by, ref_f, dx, dy, sum((a.ym - b.ym) * (a.ym - b.ym)) AS sy FROM cand c
         JOIN luma a ON a.video_id = c.video_id AND a.f = c.f AND a.x // 8 = bx AND a.y // 8 = by JOIN luma b ON b.video_id = c.video_id AND b.f = ref_f AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL)
        JOIN (SELECT c.video_id, c.f, bx, by, ref_f, dx, dy, sum((a.um - b.um) * (a.um - b.um)) AS su, sum((a.vm - b.vm) * (a.vm - b.vm)) AS sv FROM cand c
         JOIN chroma a ON a.video_id = c.video_id AND a.f = c.f AND a.cx // 4 = bx AND a.cy // 4 = by
         JOIN chroma b ON b.video_id = c.video_id AND b.f = ref_f AND b.cx = CAST(floor((bx * 8 + dx) / 2.0) AS INT) + a.cx % 4 AND b.cy = CAST(floor((by * 8 + dy) / 2.0) AS INT) + a.cy % 4 GROUP BY ALL)
        USING (video_id, f, bx, by, ref_f, dx, dy)""",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY video_id, f, bx, by ORDER BY cost, ref_f, dy, dx) AS INT) AS place FROM cost",
    "vec": "SELECT r.video_id, r.f, r.ref_f, ref, bx * 8 + dx AS pos_x, by * 8 + dy AS pos_y, -dx AS span_x, -dy AS span_y, 8 AS size, cost, bx, by FROM ranked r JOIN refs USING (video_id, f, ref_f) WHERE place = 1",
    "at_y": f"SELECT video_id, f, bx, by, ref_f, i AS x, j AS y, bx * 8 + i AS ax, by * 8 + j AS ay, pos_x + i AS rx, pos_y + j AS ry FROM vec, {_axis(8)} s(i), {_axis(8)} t(j)",
    "at_c": f"SELECT video_id, f, bx, by, ref_f, i AS x, j AS y, bx * 4 + i AS ax, by * 4 + j AS ay, CAST(floor(pos_x / 2.0) AS INT) + i AS rx, CAST(floor(pos_y / 2.0) AS INT) + j AS ry FROM vec, {_axis(4)} s(i), {_axis(4)} t(j)",
    # one join a step, so that no plan joins a plane with itself first
    "cur_y": "SELECT p.*, a.ym AS am FROM at_y p JOIN luma a ON a.video_id = p.video_id AND a.f = p.f AND a.x = ax AND a.y = ay",
    "pair_y": "SELECT p.*, b.ym AS bm, CASE WHEN abs(am - b.ym) > 1000 THEN am - b.ym ELSE 0 END AS d FROM cur_y p JOIN luma b ON b.video_id = p.video_id AND b.f = ref_f AND b.x = rx AND b.y = ry",
    "cur_c": "SELECT p.*, um AS ua, vm AS va FROM at_c p JOIN chroma a ON a.video_id = p.video_id AND a.f = p.f AND a.cx = ax AND a.cy = ay",
    "pair_c": "SELECT p.*, ua - um AS du, va - vm AS dv FROM cur_c p JOIN chroma b ON b.video_id = p.video_id AND b.f = ref_f AND b.cx = rx AND b.cy = ry",
    "resid": """SELECT video_id, f, bx, by, 'Y' AS chan, x, y, d FROM pair_y
        UNION ALL SELECT video_id, f, bx, by, 'U', x, y, CASE WHEN abs(du) > 2000 THEN du ELSE 0 END FROM pair_c
        UNION ALL SELECT video_id, f, bx, by, 'V', x, y, CASE WHEN abs(dv) > 2000 THEN dv ELSE 0 END FROM pair_c""",
    "res_y": "SELECT video_id, f, bx, by, chan, x, y, d / 1000.0 AS val FROM resid WHERE chan = 'Y'",
    "res_c": "SELECT video_id, f, bx, by, chan, x, y, d / 1000.0 AS val FROM resid WHERE chan <> 'Y'",
    "coef_y": _dct("res_y", "video_id, f, bx, by, chan", 8),
    "coef_c": _dct("res_c", "video_id, f, bx, by, chan", 4),
    "levels": """SELECT video_id, f, bx, by, chan, v, u, CAST(floor(coef / q + 0.5) AS INT) AS level FROM coef_y JOIN qy8 USING (v, u)
        UNION ALL SELECT video_id, f, bx, by, chan, v, u, CAST(floor(coef / q + 0.5) AS INT) FROM coef_c JOIN qc4 USING (v, u)""",
    # blocks of the partition's sizes
    "leaf_y": "SELECT l.video_id, l.f, l.x, l.y, l.size, p.x AS px, p.y AS py, p.x - l.x AS i, p.y - l.y AS j, p.ym FROM luma p JOIN leaves l ON p.video_id = l.video_id AND p.f = l.f AND p.x // l.size * l.size = l.x AND p.y // l.size * l.size = l.y",
    "leaf_c": "SELECT l.video_id, l.f, l.x, l.y, l.size, p.cx AS px, p.cy AS py, p.cx - l.x // 2 AS i, p.cy - l.y // 2 AS j, p.um, p.vm FROM chroma p JOIN leaves l ON p.video_id = l.video_id AND p.f = l.f AND 2 * p.cx // l.size * l.size = l.x AND 2 * p.cy // l.size * l.size = l.y",
    # one join a step, so that no plan joins a plane with itself first
    "now_y": "SELECT a.*, prev_f FROM leaf_y a JOIN fi ON a.video_id = fi.video_id AND a.f = fi.f",
    "now_c": "SELECT a.*, prev_f FROM leaf_c a JOIN fi ON a.video_id = fi.video_id AND a.f = fi.f",
    "lchange_y": "SELECT a.video_id, a.f, a.x, a.y, a.size, sum((a.ym - p.ym) * (a.ym - p.ym)) AS sy, count(*) AS ny FROM now_y a JOIN luma p ON p.video_id = a.video_id AND p.f = a.prev_f AND p.x = a.px AND p.y = a.py GROUP BY ALL",
    "lchange_c": "SELECT a.video_id, a.f, a.x, a.y, a.size, sum((a.um - p.um) * (a.um - p.um)) AS su, sum((a.vm - p.vm) * (a.vm - p.vm)) AS sv, count(*) AS nu FROM now_c a JOIN chroma p ON p.video_id = a.video_id AND p.f = a.prev_f AND p.cx = a.px AND p.cy = a.py GROUP BY ALL",
    "lchange": "SELECT * FROM lchange_y JOIN lchange_c USING (video_id, f, x, y, size)",
    "lchanged": "SELECT video_id, f, x, y, size FROM lchange WHERE sy > 1550000 * ny OR su > 3600000 * nu OR sv > 3600000 * nu",
    **{name: f"""SELECT c.video_id, c.f, x, y, size, ref_f, dx, dy FROM lchanged c JOIN refs USING (video_id, f), (SELECT i - {lo} AS dx FROM {_axis(n)} t(i)), (SELECT i - {lo} AS dy FROM {_axis(n)} t(i))
        WHERE x + dx BETWEEN 0 AND 32 - size AND y + dy BETWEEN 0 AND 32 - size""" for name, lo, n in (("lcand", 2, 4), ("wcand", 4, 9))},
    **{f"{n}own_y": f"SELECT c.*, a.px + dx AS rx, a.py + dy AS ry, a.ym AS am FROM {n}cand c JOIN leaf_y a ON a.video_id = c.video_id AND a.f = c.f AND a.x = c.x AND a.y = c.y AND a.size = c.size" for n in "lw"},
    **{f"{n}own_c": f"SELECT c.*, (c.x + dx) // 2 + a.i AS rx, (c.y + dy) // 2 + a.j AS ry, a.um AS ua, a.vm AS va FROM {n}cand c JOIN leaf_c a ON a.video_id = c.video_id AND a.f = c.f AND a.x = c.x AND a.y = c.y AND a.size = c.size" for n in "lw"},
    **{f"{n}cost_y": f"SELECT c.video_id, c.f, c.x, c.y, c.size, ref_f, dx, dy, sum((am - ym) * (am - ym)) AS sy FROM {n}own_y c JOIN luma b ON b.video_id = c.video_id AND b.f = ref_f AND b.x = rx AND b.y = ry GROUP BY ALL" for n in "lw"},
    **{f"{n}cost_c": f"SELECT c.video_id, c.f, c.x, c.y, c.size, ref_f, dx, dy, sum((ua - um) * (ua - um)) AS su, sum((va - vm) * (va - vm)) AS sv FROM {n}own_c c JOIN chroma b ON b.video_id = c.video_id AND b.f = ref_f AND b.cx = rx AND b.cy = ry GROUP BY ALL" for n in "lw"},
    **{f"{n}cost": f"SELECT video_id, f, x, y, size, ref_f, dx, dy, CAST(sy + 4 * su + 4 * sv AS BIGINT) AS cost FROM {n}cost_y JOIN {n}cost_c USING (video_id, f, x, y, size, ref_f, dx, dy)" for n in "lw"},
    "ring": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {r} AS radius, i, j FROM {_values(list(ring))} t(i, j)" for r, ring in RINGS.items()) + ")",
    # a round for every block and reference: the ring's cheapest place, then the centre moves or the radius halves
    "hexa": """SELECT video_id, f, x, y, size, ref_f, dx, dy, cost FROM (WITH RECURSIVE walk AS (
            SELECT DISTINCT video_id, f, x, y, size, ref_f, 0 AS dx, 0 AS dy, 4 AS radius, CAST(NULL AS BIGINT) AS cost FROM wcand
            UNION ALL SELECT video_id, f, x, y, size, ref_f, CASE WHEN better THEN m.dx ELSE dx END, CASE WHEN better THEN m.dy ELSE dy END,
                CASE WHEN radius > 1 AND better AND (m.dx <> dx OR m.dy <> dy) THEN radius ELSE radius // 2 END, CASE WHEN better THEN m.cost ELSE cost END
            FROM (SELECT *, m.cost IS NOT NULL AND (cost IS NULL OR m.cost < cost) AS better FROM
                (SELECT w.video_id, w.f, w.x, w.y, w.size, w.ref_f, w.dx, w.dy, w.radius, w.cost, min({'cost': t.cost, 'dy': t.dy, 'dx': t.dx}) AS m
                 FROM walk w JOIN ring r ON r.radius = w.radius JOIN wcost t ON t.video_id = w.video_id AND t.f = w.f AND t.x = w.x AND t.y = w.y AND t.size = w.size AND t.ref_f = w.ref_f AND t.dx = w.dx + r.i AND t.dy = w.dy + r.j
                 WHERE w.radius > 0 GROUP BY ALL)))
        SELECT * FROM walk) WHERE radius = 0""",
    # the same walk with the whole window of 48; its frontier asks few of the places, so only those are costed
    "lpix": "SELECT p.* FROM (SELECT video_id, f, x, y, size, 'Y' AS chan, 1 AS step, 1 AS weight, i, j, ym AS val FROM leaf_y UNION ALL SELECT video_id, f, x, y, size, 'U', 2, 4, i, j, um FROM leaf_c UNION ALL SELECT video_id, f, x, y, size, 'V', 2, 4, i, j, vm FROM leaf_c) p JOIN lchanged USING (video_id, f, x, y, size)",
    "fpix": "SELECT video_id, f AS ref_f, 'Y' AS chan, x AS rx, y AS ry, ym AS was FROM luma UNION ALL SELECT video_id, f, 'U', cx, cy, um FROM chroma UNION ALL SELECT video_id, f, 'V', cx, cy, vm FROM chroma",
    "whole_hexa": """SELECT video_id, f, x, y, size, ref_f, dx, dy, cost FROM (WITH RECURSIVE walk AS (
            SELECT c.video_id, c.f, x, y, size, ref_f, 0 AS dx, 0 AS dy, 4 AS radius, CAST(NULL AS BIGINT) AS cost FROM lchanged c JOIN refs USING (video_id, f)
            UNION ALL SELECT video_id, f, x, y, size, ref_f, CASE WHEN better THEN m.dx ELSE dx END, CASE WHEN better THEN m.dy ELSE dy END,
                CASE WHEN radius > 1 AND better AND (m.dx <> dx OR m.dy <> dy) THEN radius ELSE radius // 2 END, CASE WHEN better THEN m.cost ELSE cost END
            FROM (SELECT *, m.cost IS NOT NULL AND (cost IS NULL OR m.cost < cost) AS better FROM
                (SELECT video_id, f, x, y, size, ref_f, dx, dy, radius, cost, min({'cost': CAST(c AS BIGINT), 'dy': ty, 'dx': tx}) AS m FROM
                    (SELECT a.video_id, a.f, a.x, a.y, a.size, a.ref_f, a.dx, a.dy, a.radius, a.cost, a.c_x AS tx, a.c_y AS ty, sum(a.weight * (a.val - b.was) * (a.val - b.was)) AS c FROM
                        (SELECT w.*, p.chan, p.weight, p.val, w.dx + r.i AS c_x, w.dy + r.j AS c_y, (w.x + w.dx + r.i) // p.step + p.i AS rx, (w.y + w.dy + r.j) // p.step + p.j AS ry
                         FROM walk w JOIN ring r ON r.radius = w.radius JOIN lpix p ON p.video_id = w.video_id AND p.f = w.f AND p.x = w.x AND p.y = w.y AND p.size = w.size
                         WHERE w.radius > 0 AND abs(w.dx + r.i) <= 48 AND abs(w.dy + r.j) <= 48 AND w.x + w.dx + r.i BETWEEN 0 AND 32 - w.size AND w.y + w.dy + r.j BETWEEN 0 AND 32 - w.size) a
                     JOIN fpix b ON b.video_id = a.video_id AND b.ref_f = a.ref_f AND b.chan = a.chan AND b.rx = a.rx AND b.ry = a.ry GROUP BY ALL)
                 GROUP BY ALL)))
        SELECT * FROM walk) WHERE radius = 0""",
    **{name: f"""SELECT r.video_id, r.f, r.ref_f, ref, x + dx AS pos_x, y + dy AS pos_y, -dx AS span_x, -dy AS span_y, size, cost, x, y FROM
        (SELECT *, row_number() OVER (PARTITION BY video_id, f, x, y, size ORDER BY cost, ref_f, dy, dx) AS place FROM ({src})) r JOIN refs USING (video_id, f, ref_f) WHERE place = 1"""
       for name, src in (("lvec", "SELECT * FROM lcost"), ("hvec", "SELECT * FROM lcost UNION ALL SELECT * FROM hexa"))},
    # one join a step here too
    **{f"{n}cur_y": f"SELECT v.video_id, v.f, v.x, v.y, v.size, ref_f, i, j, ym AS am, pos_x + i AS rx, pos_y + j AS ry FROM {n}vec v JOIN leaf_y a ON a.video_id = v.video_id AND a.f = v.f AND a.x = v.x AND a.y = v.y AND a.size = v.size" for n in "lh"},
    **{f"{n}cur_c": f"SELECT v.video_id, v.f, v.x, v.y, v.size, ref_f, i, j, um AS ua, vm AS va, pos_x // 2 + i AS rx, pos_y // 2 + j AS ry FROM {n}vec v JOIN leaf_c a ON a.video_id = v.video_id AND a.f = v.f AND a.x = v.x AND a.y = v.y AND a.size = v.size" for n in "lh"},
    **{f"{n}pair_c": f"SELECT p.*, ua - um AS du, va - vm AS dv FROM {n}cur_c p JOIN chroma b ON b.video_id = p.video_id AND b.f = ref_f AND b.cx = rx AND b.cy = ry" for n in "lh"},
    **{f"{n}resid": f"""SELECT p.video_id, p.f, p.x, p.y, size, 'Y' AS chan, i, j, CASE WHEN abs(am - ym) > 1000 THEN am - ym ELSE 0 END AS d FROM {n}cur_y p JOIN luma b ON b.video_id = p.video_id AND b.f = ref_f AND b.x = rx AND b.y = ry
        UNION ALL SELECT video_id, f, x, y, size, 'U', i, j, CASE WHEN abs(du) > 2000 THEN du ELSE 0 END FROM {n}pair_c
        UNION ALL SELECT video_id, f, x, y, size, 'V', i, j, CASE WHEN abs(dv) > 2000 THEN dv ELSE 0 END FROM {n}pair_c""" for n in "lh"},
    **{f"{n}part": f"SELECT video_id, f, x AS lx, y AS ly, size, chan, (i // m) * (side // m) + j // m AS sub, i % m AS x, j % m AS y, m, d / 1000.0 AS val FROM (SELECT *, CASE WHEN chan = 'Y' THEN size ELSE size // 2 END AS side, CASE WHEN chan = 'Y' THEN 8 ELSE 4 END // CASE WHEN size = 4 THEN 2 ELSE 1 END AS m FROM {n}resid)" for n in "lh"},
    **{f"{n}p{k}": f"SELECT * FROM {n}part WHERE {where}" for n in "lh" for k, where in _PARTS.items()},
    **{f"{n}c{k}": _dct(f"{n}p{k}", "video_id, f, lx, ly, size, chan, sub", int(k[-1])) for n in "lh" for k in _PARTS},
    **{f"{n}levels": " UNION ALL ".join(f"SELECT video_id, f, lx AS x, ly AS y, size, chan, sub, v, u, CAST(floor(coef / q + 0.5) AS INT) AS level FROM {n}c{k} JOIN q{k} USING (v, u)" for k in _PARTS) for n in "lh"},
    "sized": "SELECT video_id, f, CAST(sum(7 + size * size + 2 * (size // 2) * (size // 2)) + 1 AS BIGINT) AS bytes FROM lvec GROUP BY ALL",
    "recs": """SELECT v.video_id, v.f, v.x, v.y, printf('%04X%04X%02X%02X%02X', pos_x, pos_y, abs(span_x) + CASE WHEN span_x < 0 THEN 128 ELSE 0 END, abs(span_y) + CASE WHEN span_y < 0 THEN 128 ELSE 0 END, ref * 16 + CAST(log2(v.size) AS INT) - 1) || h AS h
        FROM lvec v JOIN (SELECT video_id, f, x, y, size, string_agg(printf('%02X', (abs(level) & 127) + CASE WHEN level < 0 THEN 128 ELSE 0 END), '' ORDER BY chan <> 'Y', chan, sub, v, u) AS h FROM llevels GROUP BY ALL) USING (video_id, f, x, y, size)""",
    "rebuilt": "SELECT video_id, f, ax AS x, ay AS y, CAST(bm + d AS BIGINT) AS ym FROM pair_y",
    # blocks without a vector count as leftovers
    **{f"{n}left": f"SELECT video_id, f, count(*) AS n_uncoded, CAST(sum(size * size) AS BIGINT) AS uncoded_area FROM (SELECT video_id, f, x, y, size FROM lchanged EXCEPT SELECT video_id, f, x, y, size FROM {n}vec) GROUP BY ALL" for n in "lh"},
    **{f"{n}stat": f"""SELECT video_id, f, coalesce(n_vectors, 0) AS n_vectors, coalesce(area, 0) AS area, coalesce(error, 0) AS mean_error, coalesce(n_uncoded, 0) AS n_uncoded, coalesce(uncoded_area, 0) AS uncoded_area
        FROM (SELECT video_id, f, count(*) AS n_vectors, CAST(sum(size * size) AS BIGINT) AS area, CAST(sum(cost * (16384 // (size * size))) AS DOUBLE) / (count(*) * (4e6 * 16384)) AS error FROM {n}vec GROUP BY ALL) FULL JOIN {n}left USING (video_id, f)""" for n in "lh"},
    **{f"{n}total": f"SELECT video_id, f, count(DISTINCT size) AS n_sizes, count(*) AS n_levels, CAST(sum(level) AS BIGINT) AS level_sum, CAST(sum(abs(level)) AS BIGINT) AS level_abs FROM {n}levels GROUP BY ALL" for n in "lh"},
}


def _edges(vertical: bool) -> str:
    places = "bx * 8 + o AS ex, by * 8 AS ey" if vertical else "bx * 8 AS ex, by * 8 + o AS ey"
    join = "l.x = ex AND l.y BETWEEN ey - 3 AND ey + 2" if vertical else "l.y = ey AND l.x BETWEEN ex - 3 AND ex + 2"
    s = "l.y - ey" if vertical else "l.x - ex"
    picks = ", ".join(f"max(CASE WHEN {s} = {i} THEN ym END) AS {n}" for i, n in zip(range(-3, 3), ("p2", "p1", "p0", "q0", "q1", "q2"), strict=True))
    return f"SELECT e.video_id, e.f, ex, ey, {picks} FROM (SELECT DISTINCT video_id, f, {places} FROM vec, {_axis(8)} t(o) WHERE bx > 0 AND by > 0) e JOIN luma l ON l.video_id = e.video_id AND l.f = e.f AND {join} GROUP BY ALL"


def _smooth(vertical: bool) -> str:
    name = "edges_v" if vertical else "edges_h"
    at = lambda s: f"ex AS x, ey + {s} AS y" if vertical else f"ex + {s} AS x, ey AS y"
    cut = lambda x, lo, hi: f"greatest({lo}, least({hi}, {x}))"
    half = lambda x, n: f"CAST(floor(({x}) / {float(n)}) AS BIGINT)"
    outer = lambda far, near: cut(half(f"trunc(({far}) / 1000.0 + mean - trunc({near} / 1000.0) * 2)", 2), "-4", "4")
    return f"""WITH e AS (SELECT *, abs(q0 - q2) < 29000 AS sq, abs(p0 - p2) < 29000 AS sp, {half("trunc((q0 + p0) / 1000.0 + 1)", 2)} AS mean,
            {half("trunc((q0 - p0) / 1000.0) * 4 + trunc((p1 - q1) / 1000.0) + 4", 8)} AS raw FROM {name} WHERE abs(p0 - q0) < 28000 AND abs(p1 - p0) < 29000 AND abs(q0 - q1) < 29000),
        m AS (SELECT *, {cut("raw", "-(4 + sq::INT + sp::INT)", "4 + sq::INT + sp::INT")} AS delta FROM e),
        n AS (SELECT video_id, f, {at(-1)}, {cut("trunc(p0 / 1000.0) + delta", 0, 255)} * 1000 AS new FROM m
            UNION ALL SELECT video_id, f, {at(0)}, {cut("trunc(q0 / 1000.0) - delta", 0, 255)} * 1000 FROM m
            UNION ALL SELECT video_id, f, {at(1)}, {cut("trunc(q1 / 1000.0) + " + outer("q2", "q1"), 0, 255)} * 1000 FROM m WHERE sq
            UNION ALL SELECT video_id, f, {at(-2)}, {cut("trunc(p1 / 1000.0) + " + outer("p2", "p1"), 0, 255)} * 1000 FROM m WHERE sp)
        SELECT video_id, f, x, y, CAST(coalesce(new, ym) AS BIGINT) AS ym FROM luma LEFT JOIN n USING (video_id, f, x, y)"""


CTES |= {"edges_h": _edges(False), "edges_v": _edges(True)}

_RESIZED = """WITH p AS (SELECT * FROM px WHERE x < 30 AND y < 31), g AS (SELECT DISTINCT video_id, f, tx, ty,
        greatest(0, least(((2 * tx + 1) * 30 * 512) // 28 - 512, 29 * 1024)) AS sx, greatest(0, least(((2 * ty + 1) * 31 * 512) // 28 - 512, 30 * 1024)) AS sy FROM p, (SELECT unnest(range(28)) AS tx), (SELECT unnest(range(28)) AS ty)),
    k AS (SELECT video_id, f, tx, ty, least(sx // 1024 + i, 29) AS x, least(sy // 1024 + j, 30) AS y, (CASE WHEN i = 1 THEN sx % 1024 ELSE 1024 - sx % 1024 END) * (CASE WHEN j = 1 THEN sy % 1024 ELSE 1024 - sy % 1024 END) AS w
        FROM g, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j))
    SELECT video_id, f, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, CAST((sum(w * r) + 524288) // 1048576 AS INT) AS r, CAST((sum(w * g) + 524288) // 1048576 AS INT) AS g, CAST((sum(w * b) + 524288) // 1048576 AS INT) AS b
    FROM k JOIN p USING (video_id, f, x, y) GROUP BY video_id, f, tx, ty"""

_MEANS = " UNION ALL ".join(f"SELECT video_id, f, bx, by, r, g, b, size FROM b{s}" for s in (8, 16, 32))
_ARGB = "4278190080 + r * 65536 + g * 256 + b"

BODIES = {
    "frame_gaps": "SELECT video_id, CAST(unnest(range(lo, hi + 1)) AS INT) AS f FROM (SELECT video_id, min(f) AS lo, max(f) AS hi FROM px WHERE f <> 2 OR video_id % 3 <> 0 GROUP BY ALL) EXCEPT SELECT video_id, f FROM px WHERE f <> 2 OR video_id % 3 <> 0",
    "resize_mod4": _RESIZED,
    "video_catalog": "SELECT video_id, max(x) + 1 AS width, max(y) + 1 AS height, count(DISTINCT f) - 1 AS n_delta_frames FROM px GROUP BY ALL",
    "start_frame_bytes": "SELECT video_id, f, string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY x, y) AS rgb_hex FROM px WHERE f = 0 GROUP BY ALL",
    "explode_packed": "SELECT video_id, f, x, y, r, g, b FROM px",
    "frame_index": "SELECT * FROM fi",
    "part_index": """WITH p AS (SELECT video_id, n AS part_no, coalesce(bytes, 1) AS len FROM fi LEFT JOIN sized USING (video_id, f) WHERE n > 0 UNION ALL SELECT DISTINCT video_id, 0, 3072 FROM px)
        SELECT video_id, part_no, len, CAST(16 + 4 * count(*) OVER (PARTITION BY video_id) + coalesce(sum(len) OVER (PARTITION BY video_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM p""",
    "pack_parts": "SELECT video_id, f, '01' || string_agg(h, '' ORDER BY x, y) AS payload FROM recs GROUP BY video_id, f",
    "unpack_parts": """SELECT v.video_id, v.f, v.x, v.y, v.size, pos_x, pos_y, span_x, span_y, ref, level_sum FROM lvec v JOIN
        (SELECT video_id, f, x, y, size, CAST(sum(sign(level) * (abs(level) & 127) * place) AS BIGINT) AS level_sum FROM (SELECT *, row_number() OVER (PARTITION BY video_id, f, x, y, size ORDER BY chan <> 'Y', chan, sub, v, u) AS place FROM llevels) GROUP BY ALL) USING (video_id, f, x, y, size)""",
    "packing_ratio": "SELECT video_id, f, raw_bytes, bytes, raw_bytes * 1000 // bytes AS ratio_milli FROM (SELECT r.video_id, r.f, raw_bytes, coalesce(bytes, 1) AS bytes FROM (SELECT video_id, f, 3 * count(*) AS raw_bytes FROM px GROUP BY ALL) r LEFT JOIN sized s ON r.video_id = s.video_id AND r.f = s.f)",
    "changed_leaves": "SELECT * FROM lchanged",
    "pattern_search": "SELECT * FROM whole_hexa",
    "leaf_residuals": "SELECT * FROM llevels",
    "leaf_overflow": "SELECT video_id, f, n_levels, n_wide_levels, n_spans, n_wide_spans FROM (SELECT video_id, f, count(*) AS n_levels, count(*) FILTER (abs(level) > 127) AS n_wide_levels FROM llevels GROUP BY ALL) JOIN (SELECT video_id, f, 2 * count(*) AS n_spans, count(*) FILTER (abs(span_x) > 127) + count(*) FILTER (abs(span_y) > 127) AS n_wide_spans FROM lvec GROUP BY ALL) USING (video_id, f)",
    "zero_share": "SELECT 'Y' AS chan, count(*) AS n, count(*) FILTER (level = 0) AS n_zero, count(*) FILTER (level = 0) * 1000000 // count(*) AS zero_micro FROM l8",
    "encode_pattern": "SELECT video_id, f, n_vectors, area, round(mean_error, 6) AS mean_error, n_uncoded, n_sizes, n_levels, level_sum, level_abs FROM hstat JOIN htotal USING (video_id, f)",
    "assemble_raster": f"SELECT video_id, f, string_agg(CAST({_ARGB} AS VARCHAR), ',' ORDER BY y, x) AS argb FROM rgb GROUP BY ALL",
    "rgb_pack": f"SELECT video_id, f, x, y, CAST({_ARGB} AS BIGINT) AS argb, r, g, b FROM px",
    "rgb_to_yuv": "SELECT video_id, f, x, y, CAST(299 * r + 587 * g + 114 * b AS BIGINT) AS ym, CAST(128000000 - 168736 * r - 331264 * g + 500000 * b AS BIGINT) AS u_micro, CAST(128000000 + 500000 * r - 418688 * g - 81312 * b AS BIGINT) AS v_micro FROM px",
    "yuv_to_rgb": "SELECT * FROM rgb",
    "position_codec": "SELECT video_id, f, x, y, pos, printf('%04X', pos) AS code, pos AS back FROM (SELECT *, (video_id * 37 + f * 1009 + x * 61 + y) % 65536 AS pos FROM px)",
    "int32_codec": "SELECT video_id, f, x, y, num, printf('%08X', num) AS code, num AS back FROM (SELECT *, (video_id * 1000003 + f * 65537 + x * 4099 + y) % 2147483648 AS num FROM px)",
    "signmag_codec": "SELECT video_id, f, x, y, CAST(r - g AS INT) AS level, CAST((abs(r - g) & 127) + CASE WHEN r < g THEN 128 ELSE 0 END AS INT) AS code, CAST(sign(r - g) * (abs(r - g) & 127) AS INT) AS back FROM px",
    "refsize_codec": "SELECT video_id, f, x, y, ref, size, CAST(ref * 16 + k + 1 AS INT) AS code, ref AS back_ref, size AS back_size, CAST(7 + size * size + 2 * (size // 2) * (size // 2) AS BIGINT) AS bytes FROM (SELECT *, 1 + x % 4 AS ref, y % 6 AS k, CAST(4 * 2 ** (y % 6) AS INT) AS size FROM px)",
    "quadkey_order": "SELECT video_id, f, x, y, size, '00000' || CASE WHEN size <= 16 THEN CAST((x // 16) % 2 * 2 + (y // 16) % 2 AS VARCHAR) ELSE '' END || CASE WHEN size <= 8 THEN CAST((x // 8) % 2 * 2 + (y // 8) % 2 AS VARCHAR) ELSE '' END || CASE WHEN size <= 4 THEN CAST((x // 4) % 2 * 2 + (y // 4) % 2 AS VARCHAR) ELSE '' END AS quadkey FROM leaves",
    "chroma_subsample": "SELECT * FROM chroma",
    "cell_means": "SELECT * FROM cells",
    "block_means": _MEANS,
    "block_stddev": "SELECT video_id, f, bx, by, round(sqrt(CAST(dev2 AS DOUBLE) / n), 6) AS stddev FROM b8",
    "quadtree_leaves": "SELECT * FROM leaves",
    "mosaic": "SELECT p.video_id, p.f, p.x, p.y, l.r, l.g, l.b FROM px p JOIN leaves l ON p.video_id = l.video_id AND p.f = l.f AND p.x // l.size * l.size = l.x AND p.y // l.size * l.size = l.y",
    "block_mse": "SELECT * FROM change",
    "changed_blocks": "SELECT * FROM changed",
    "stream_changed_blocks": "SELECT * FROM changed",
    "stream_history": "SELECT n.video_id, n.f, coalesce(string_agg(CAST(p.f AS VARCHAR), ',' ORDER BY p.f), '') AS history FROM fi n LEFT JOIN fi p ON p.video_id = n.video_id AND p.n BETWEEN n.n - 4 AND n.n - 1 GROUP BY n.video_id, n.f",
    "overwrite_table": "SELECT video_id, f, count(*) AS n, CAST(sum((CASE WHEN video_id % 3 = 0 THEN 255 - r ELSE r END) * (x + 32 * y + 1)) AS BIGINT) AS mark FROM px GROUP BY video_id, f",
    "merge_subtiles": "SELECT tile, x, y, val FROM tiles",
    "frame_delta": "SELECT l.video_id, l.f, l.x, l.y, l.ym - p.ym AS d FROM luma_now l JOIN luma p ON p.video_id = l.video_id AND p.f = l.prev_f AND p.x = l.x AND p.y = l.y",
    "tile_blocks": """SELECT video_id, f, x // 8 AS bx, y // 8 AS by, string_agg(CAST(CASE WHEN x < 30 THEN ym ELSE 0 END AS VARCHAR), ',' ORDER BY x, y) AS plane, CAST(sum(CASE WHEN x < 30 THEN 0 ELSE 1 END) AS INT) AS oob_count FROM luma GROUP BY ALL""",
    "reference_pairs": "SELECT * FROM refs",
    "search_candidates": "SELECT * FROM cand",
    "match_cost": "SELECT * FROM cost",
    "best_match": "SELECT video_id, f, bx, by, ref_f, dx, dy, cost FROM ranked WHERE place = 1",
    "top_k_matches": "SELECT * FROM ranked WHERE place <= 3",
    "motion_search": "SELECT * EXCLUDE (bx, by) FROM vec",
    "uncoded_blocks": "SELECT video_id, f, bx, by FROM changed EXCEPT SELECT video_id, f, bx, by FROM vec WHERE cost < 64000000",
    "match_offsets": "SELECT ref, span_x, span_y, count(*) AS n FROM lvec GROUP BY ALL",
    "dct8": "SELECT * FROM d8", "dct4": _dct("sub4", "tile, sub", 4), "dct2": _dct("sub2", "tile, sub", 2), "split_subtiles": "SELECT * FROM sub4",
    "quantize": "SELECT * FROM l8",
    "dequantize": "SELECT tile, v, u, level * q AS coef FROM l8 JOIN qy8 USING (v, u)",
    "idct": "SELECT tile, b1.i AS x, b2.i AS y, round(round(sum(level * q * b1.w * b2.w), 6) + 128.0000001, 4) AS val FROM l8 JOIN qy8 USING (v, u) JOIN basis8 b1 ON b1.k = v JOIN basis8 b2 ON b2.k = u GROUP BY tile, b1.i, b2.i",
    "level_histogram": "SELECT 'Y' AS chan, level, count(*) AS n FROM l8 GROUP BY level",
    "level_overflow": "SELECT 'Y' AS chan, count(*) AS n, CAST(sum(CASE WHEN abs(floor(coef / q + 0.5)) > 127 THEN 1 ELSE 0 END) AS BIGINT) AS n_overflow FROM wide8 JOIN qy8 USING (v, u)",
    "residual_deadzone": "SELECT * FROM resid",
    "encode_residuals": "SELECT * FROM levels",
    "payload_bytes": "SELECT * FROM sized",
    "reconstruct": """SELECT video_id, f, 'Y' AS chan, x, y, ym AS value FROM rebuilt
        UNION ALL SELECT video_id, f, 'U', ax, ay, CAST(ua - du + CASE WHEN abs(du) > 2000 THEN du ELSE 0 END AS BIGINT) FROM pair_c
        UNION ALL SELECT video_id, f, 'V', ax, ay, CAST(va - dv + CASE WHEN abs(dv) > 2000 THEN dv ELSE 0 END AS BIGINT) FROM pair_c""",
    "reconstruct_one": "SELECT fi.video_id, fi.f, p.x, p.y, coalesce(r.ym, p.ym) AS ym FROM fi JOIN luma p ON p.video_id = fi.video_id AND p.f = fi.prev_f LEFT JOIN rebuilt r ON r.video_id = fi.video_id AND r.f = fi.f AND r.x = p.x AND r.y = p.y",
    "overlay": "SELECT video_id, f, x, y, CASE WHEN x % 5 = 0 THEN ym + 7 ELSE ym END AS ym FROM luma",
    "patch_union": "SELECT video_id, f, x, y, CASE WHEN x >= 8 THEN ym + 5 ELSE ym END AS ym FROM luma WHERE x < 20",
    "edge_neighbours": "SELECT * FROM edges_h",
    "deblock_columns": _smooth(False), "deblock_rows": _smooth(True),
    "frame_stats": "SELECT video_id, f, n_vectors, area, round(mean_error, 6) AS mean_error, n_uncoded, uncoded_area FROM lstat",
    "running_mean_error": "SELECT video_id, f, round(avg(mean_error) OVER (PARTITION BY video_id ORDER BY f ROWS UNBOUNDED PRECEDING), 6) AS running_error FROM lstat",
    "encode_open_loop": "SELECT video_id, f, n_vectors, area, round(mean_error, 6) AS mean_error, n_uncoded, n_sizes, n_levels, level_sum, level_abs FROM lstat JOIN ltotal USING (video_id, f)",
    "changed_per_frame": "SELECT fi.video_id, fi.f, count(c.bx) AS n_changed FROM fi LEFT JOIN changed c ON fi.video_id = c.video_id AND fi.f = c.f WHERE prev_f IS NOT NULL GROUP BY fi.video_id, fi.f",
}


def sql(name: str) -> str:
    """The query's SQL with the common tables it needs, in the order they are defined."""
    body, used, todo = BODIES[name], set(), [BODIES[name]]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = {c for c in CTES if c in words} - used
        used |= new
        todo += [CTES[c] for c in new]
    head = ", ".join(f"{c} AS MATERIALIZED ({CTES[c]})" for c in CTES if c in used)
    whole = f"WITH {head} SELECT * FROM ({body})"
    return re.sub(r"\bby\b", '"by"', whole)  # keywords are in capitals here


ORACLE_SQL = {name: sql(name) for name in BODIES}
