"""Whole segmentations as SQL: iterations written out one after another, each a materialised step."""

from __future__ import annotations

import math

from terrazzo.operators.lsc import CHROMA, COLOUR_WEIGHT, FEATURES
from terrazzo.operators.segment import COOLDOWN, MARGIN, grid_centres
from terrazzo.plans.config import SlicConfig

FIELDS = ("y", "x", "c0", "c1", "c2")


def feature_planes(s: int, compactness: float, pixels: str) -> str:
    """``lsc``: the features f0..f9 of each of ``pixels`` over its ``weight``."""
    quarter, space = "pi() / 2", COLOUR_WEIGHT * compactness / 100
    angles = [(f"{c} * ({quarter} / 255)", w) for c, w in (("c0", COLOUR_WEIGHT), ("c1", COLOUR_WEIGHT * CHROMA), ("c2", COLOUR_WEIGHT * CHROMA))]
    angles += [(f"{v} * ({quarter} / {s})", space) for v in ("x", "y")]
    raw = ", ".join(f"{f}({a}) * {w}::DOUBLE AS r{2 * n + m}" for n, (a, w) in enumerate(angles) for m, f in enumerate(("cos", "sin")))
    means = ", ".join(f"avg(r{k}) AS m{k}" for k in range(FEATURES))
    weight = " + ".join(f"m{k} * r{k}" for k in range(FEATURES))
    scaled = ", ".join(f"r{k} / weight AS f{k}" for k in range(FEATURES))
    return f"""raw AS MATERIALIZED (SELECT image_id, y, x, c0, c1, c2, {raw} FROM {pixels}),
lsc AS MATERIALIZED (SELECT image_id, y, x, c0, c1, c2, weight, {scaled} FROM (
  SELECT raw.*, {weight} AS weight FROM raw JOIN (SELECT image_id, {means} FROM raw GROUP BY image_id) USING (image_id)))"""


class Iterated:
    """SQL steps of ``Slic.iterate`` on images of one size, from a step ``px`` of their pixels to a step ``labels``."""

    def __init__(self, config: SlicConfig, h: int, w: int):
        self.c, self.h, self.w = config, h, w
        self.s = config.spacing(h, w)
        self.lsc = config.variant == "lsc"
        self.px = "lsc" if self.lsc else "px"
        self.features = [f"f{k}" for k in range(FEATURES)] if self.lsc else []

    def start(self) -> str:
        """``clusters0`` and ``labels0``."""
        centres = ", ".join(f"({n}, {y}, {x})" for n, (y, x) in enumerate(grid_centres(self.h, self.w, self.c.num_components)))
        state = f"0::BIGINT AS num_members, {COOLDOWN} AS upd, true AS active"
        steps = [f"centres(number, y, x) AS (VALUES {centres})"]
        if self.lsc:
            steps.append(feature_planes(self.s, self.c.compactness, "px"))
        r = self.s // 4
        seeds = f"""JOIN (SELECT c.number, p.image_id, {", ".join(f"avg(p.{f}) AS {f}" for f in self.features)} FROM centres c
  JOIN lsc p ON abs(p.y - c.y) <= {r} AND abs(p.x - c.x) <= {r} GROUP BY ALL) seed ON seed.number = c.number AND seed.image_id = p.image_id"""
        more = "".join(f", seed.{f}" for f in self.features)
        steps.append(
            f"""clusters0 AS MATERIALIZED (SELECT p.image_id, c.number, {", ".join(f"p.{f}::DOUBLE AS {f}" for f in FIELDS)}, {state}{more}
  FROM centres c JOIN px p ON p.y = c.y AND p.x = c.x {seeds if self.lsc else ""})"""
        )
        steps.append("labels0 AS (SELECT image_id, y, x, NULL::INT AS label FROM px)")
        return ",\n".join(steps)

    def distance(self) -> str:
        if self.lsc:
            return " + ".join(f"(p.{f} - c.{f}) * (p.{f} - c.{f})" for f in self.features)
        table = "[" + ", ".join(map(str, self.c.spatial_table(self.s))) + "]"
        near = "(abs(p.y - c.y) + abs(p.x - c.x))::BIGINT + 1"
        return f"({table})[{near}] + abs(p.c0 - c.c0) + abs(p.c1 - c.c1) + abs(p.c2 - c.c2)"

    def assign(self, k: int, to: str, rows: str) -> str:
        """Step ``to``: all labels after the pixels of ``rows`` went to the nearest active cluster of step k."""
        t = 2 * self.s + MARGIN
        ty, tx = f"(c.y::BIGINT // {t})", f"(c.x::BIGINT // {t})"
        order = f"{self.distance()}, 2 * ({ty} % 2) + {tx} % 2, {ty}, {tx}, c.number"
        awake = "true" if to == "labels" else "c.active"
        usable = f" AND NOT isnan(c.{self.features[0]})" if self.lsc else ""
        return f"""near_{to} AS MATERIALIZED (SELECT image_id, y, x, number FROM (
  SELECT p.image_id, p.y, p.x, c.number, row_number() OVER (PARTITION BY p.image_id, p.y, p.x ORDER BY {order}) AS place
  FROM {self.px} p JOIN clusters{k} c ON c.image_id = p.image_id AND {awake}{usable} AND abs(p.y - c.y) <= {self.s} AND abs(p.x - c.x) <= {self.s}
  WHERE {rows}) WHERE place = 1),
{to} AS MATERIALIZED (SELECT l.image_id, l.y, l.x, coalesce(n.number, l.label)::INT AS label
  FROM labels{k} l LEFT JOIN near_{to} n ON n.image_id = l.image_id AND n.y = l.y AND n.x = l.x)"""

    def update(self, k: int, rows: str) -> str:
        """Step ``clusters{k + 1}``."""
        wide = 2 * self.s
        counted = ""
        if self.c.preemptive and k:
            counted = f""" AND ((p.image_id) IN (SELECT image_id FROM clusters{k} GROUP BY image_id HAVING bool_and(active))
    OR (p.image_id, p.y // {wide}, p.x // {wide}) IN (SELECT (image_id, y::BIGINT // {wide}, x::BIGINT // {wide}) FROM clusters{k} WHERE active))"""
        sums = ", ".join(f"((sum(p.{f}) + count(*) // 2) // count(*))::DOUBLE AS {f}" for f in FIELDS)
        means = "".join(f", sum(p.weight * p.{f}) / sum(p.weight) AS {f}" for f in self.features)
        moved = ", ".join(f"CASE WHEN m.n IS NOT NULL AND c.upd > 0 THEN m.{f} ELSE c.{f} END AS {f}" for f in FIELDS)
        kept = "".join(f", CASE WHEN c.upd > 0 THEN coalesce(m.{f}, 'nan'::DOUBLE) ELSE c.{f} END AS {f}" for f in self.features)
        steps = [
            f"""sums{k} AS MATERIALIZED (SELECT p.image_id, l.label AS number, count(*) AS n, {sums}{means} FROM {self.px} p
  JOIN labels{k + 1} l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x WHERE {rows} AND l.label IS NOT NULL{counted} GROUP BY ALL)""",
            f"""moved{k} AS MATERIALIZED (SELECT c.image_id, c.number, {moved}, CASE WHEN c.upd > 0 THEN coalesce(m.n, 0) ELSE c.num_members END AS num_members,
  c.upd, c.active, c.y AS oy, c.x AS ox{kept} FROM clusters{k} c LEFT JOIN sums{k} m ON m.image_id = c.image_id AND m.number = c.number)""",
        ]
        more = "".join(f", {f}" for f in self.features)
        if not self.c.preemptive:
            steps.append(f"clusters{k + 1} AS (SELECT image_id, number, {', '.join(FIELDS)}, num_members, upd, active{more} FROM moved{k})")
            return ",\n".join(steps)
        limit = max(math.floor(wide * self.c.preemptive_thres + 0.5), 1)
        left = f"CASE WHEN upd = 0 THEN 0 WHEN abs(y - oy) + abs(x - ox) < {limit} THEN upd - 1 ELSE {COOLDOWN} END"
        steps.append(f"cooled{k} AS MATERIALIZED (SELECT * REPLACE ({left} AS upd) FROM moved{k})")
        steps.append(
            f"""clusters{k + 1} AS MATERIALIZED (SELECT image_id, number, {", ".join(FIELDS)}, num_members, upd, EXISTS (SELECT 1 FROM cooled{k} o
  WHERE o.image_id = c.image_id AND o.upd > 0 AND abs(o.y - c.y) <= {wide} AND abs(o.x - c.x) <= {wide}) AS active{more} FROM cooled{k} c)"""
        )
        return ",\n".join(steps)

    def steps(self, max_iter: int) -> str:
        out, stride = [self.start()], self.c.subsample_stride
        for k in range(max_iter):
            rows = f"p.y % {stride} = {k % stride}"
            out += [self.assign(k, f"labels{k + 1}", rows), self.update(k, rows)]
        return ",\n".join([*out, self.assign(max_iter, "labels", "true")])
