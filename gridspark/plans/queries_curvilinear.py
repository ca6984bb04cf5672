"""Queries of the regridding of curvilinear sources (J7, J8), with their oracles.

The source is the month climatology of the grid that grows with ``lineitem``, on
a rotated and bent grid of centres: ``u`` and ``v`` follow neither rows nor
columns. The oracles join by range and compute the overlap of two cells by
another formula (the parts of each cell's edges inside the other cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curvilinear, resample
from ..session import written
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from .catalog import register

STEP, INSET = 1.3, 0.17
COARSE, COARSE_INSET = 2.7, 0.4

_SOURCE_SQL = """clim as (select cast(month(time) as int) as time, y, x, avg(o) as o from grid_wide group by 1, 2, 3),
geo as (select distinct y, x, 8e-1 * x - 6e-1 * y + 2e-2 * x * x as u, 6e-1 * x + 8e-1 * y + 1e-2 * x * x as v from clim),
ext as (select min(u) as lou, max(u) as hiu, min(v) as lov, max(v) as hiv from geo)"""


def _lattice_sql(step: float, inset: float) -> str:
    n = lambda c: f"cast(floor((hi{c} - lo{c} - 2e0 * {inset}e0) / {step}e0 + 1e-9) as int)"
    return f"""lat as (
  select ty, tx, lou + {inset}e0 + tx * {step}e0 as u, lov + {inset}e0 + ty * {step}e0 as v
  from (select *, unnest(range(0, {n('u')} + 1)) as tx from (select *, unnest(range(0, {n('v')} + 1)) as ty from ext) r) c)"""


_BILINEAR_SQL = f"""with {_SOURCE_SQL}, {_lattice_sql(STEP, INSET)},
q as (
  select a.y, a.x, a.u as au, a.v as av, b.u - a.u as eu, b.v - a.v as ev, d.u - a.u as fu, d.v - a.v as fv,
         a.u - b.u + c.u - d.u as gu, a.v - b.v + c.v - d.v as gv,
         least(a.u, b.u, c.u, d.u) as lu, greatest(a.u, b.u, c.u, d.u) as hu, least(a.v, b.v, c.v, d.v) as lv, greatest(a.v, b.v, c.v, d.v) as hv
  from geo a join geo b on b.y = a.y and b.x = a.x + 1 join geo c on c.y = a.y + 1 and c.x = a.x + 1 join geo d on d.y = a.y + 1 and d.x = a.x),
k as (
  select ty, tx, q.*, u - au as pu, v - av as pv, gu * fv - gv * fu as k2,
         (eu * fv - ev * fu) + ((u - au) * gv - (v - av) * gu) as k1, (u - au) * ev - (v - av) * eu as k0
  from lat join q on u between lu - 1e-9 and hu + 1e-9 and v between lv - 1e-9 and hv + 1e-9),
r as (select *, -0.5e0 * (k1 + case when k1 < 0 then -1 else 1 end * sqrt(k1 * k1 - 4 * k0 * k2)) as qq from k where k1 * k1 - 4 * k0 * k2 >= 0),
roots as (select *, 1 as n, qq / nullif(k2, 0) as t from r union all select *, 2 as n, k0 / nullif(qq, 0) as t from r),
st as (
  select *, case when abs(eu + gu * t) >= abs(ev + gv * t) then (pu - fu * t) / nullif(eu + gu * t, 0) else (pv - fv * t) / nullif(ev + gv * t, 0) end as s
  from roots where t is not null and not isnan(t)),
hit as (
  select *, row_number() over (partition by ty, tx order by y, x, n) as place from st
  where s between -1e-9 and 1 + 1e-9 and t between -1e-9 and 1 + 1e-9),
one as (
  select ty, tx, y, x, case when s < 1e-9 then 0e0 when s > 1 - 1e-9 then 1e0 else s end as s,
         case when t < 1e-9 then 0e0 when t > 1 - 1e-9 then 1e0 else t end as t from hit where place = 1),
w as (
  select ty, tx, y, x, (1 - s) * (1 - t) as w from one union all select ty, tx, y, x + 1, s * (1 - t) from one
  union all select ty, tx, y + 1, x + 1, s * t from one union all select ty, tx, y + 1, x, (1 - s) * t from one),
kept as (select *, count(*) over (partition by ty, tx) as k from w where w > 0)
select clim.time, cast(ty as int) as y, cast(tx as int) as x, case when count(o) = max(k) then sum(w * o) end as o
from clim join kept on clim.y = kept.y and clim.x = kept.x group by 1, 2, 3"""


def _cells_sql(name: str, src: str, row: str, col: str) -> str:
    """Cells around centres: the grid continued by a row and a column on each side, corners as means of four."""
    return f"""{name}_l as (select min({row}) as r0, max({row}) as r1, min({col}) as c0, max({col}) as c1 from {src}),
{name}_r as (
  select {row} as r, {col} as c, u, v from {src}
  union all select a.{row} - 1, a.{col}, 2 * a.u - b.u, 2 * a.v - b.v from {src} a join {src} b on b.{row} = a.{row} + 1 and b.{col} = a.{col} join {name}_l on a.{row} = r0
  union all select a.{row} + 1, a.{col}, 2 * a.u - b.u, 2 * a.v - b.v from {src} a join {src} b on b.{row} = a.{row} - 1 and b.{col} = a.{col} join {name}_l on a.{row} = r1),
{name}_g as (
  select * from {name}_r
  union all select a.r, a.c - 1, 2 * a.u - b.u, 2 * a.v - b.v from {name}_r a join {name}_r b on b.r = a.r and b.c = a.c + 1 join {name}_l on a.c = c0
  union all select a.r, a.c + 1, 2 * a.u - b.u, 2 * a.v - b.v from {name}_r a join {name}_r b on b.r = a.r and b.c = a.c - 1 join {name}_l on a.c = c1),
{name}_v as (
  select a.r, a.c, (a.u + b.u + c.u + d.u) / 4 as u, (a.v + b.v + c.v + d.v) / 4 as v
  from {name}_g a join {name}_g b on b.r = a.r and b.c = a.c + 1 join {name}_g c on c.r = a.r + 1 and c.c = a.c + 1 join {name}_g d on d.r = a.r + 1 and d.c = a.c),
{name} as (
  select a.r + 1 as r, a.c + 1 as c, [a.u, b.u, c.u, d.u] as us, [a.v, b.v, c.v, d.v] as vs
  from {name}_v a join {name}_v b on b.r = a.r and b.c = a.c + 1 join {name}_v c on c.r = a.r + 1 and c.c = a.c + 1 join {name}_v d on d.r = a.r + 1 and d.c = a.c)"""


def _inside_sql(mine: str, other: str) -> str:
    """Sums of cross products over the parts of the edges of ``mine`` that lie inside ``other``."""
    return f"""select sy, sx, ty, tx, sum((pu + t0 * du) * (pv + t1 * dv) - (pv + t0 * dv) * (pu + t1 * du)) as turns
  from (select sy, sx, ty, tx, i, any_value(pu) as pu, any_value(pv) as pv, any_value(du) as du, any_value(dv) as dv,
               greatest(0, max(case when along > 0 then -off / along end)) as t0, least(1, min(case when along < 0 then -off / along end)) as t1,
               bool_or(along = 0 and off < 0) as outside
        from (select sy, sx, ty, tx, i, pu, pv, du, dv, eu * dv - ev * du as along, eu * (pv - ov) - ev * (pu - ou) as off
              from (select sy, sx, ty, tx, i, {mine}u[i + 1] as pu, {mine}v[i + 1] as pv, {mine}u[(i + 1) % 4 + 1] - {mine}u[i + 1] as du, {mine}v[(i + 1) % 4 + 1] - {mine}v[i + 1] as dv,
                           {other}u[j + 1] as ou, {other}v[j + 1] as ov, {other}u[(j + 1) % 4 + 1] - {other}u[j + 1] as eu, {other}v[(j + 1) % 4 + 1] - {other}v[j + 1] as ev
                    from pairs, (select unnest(range(0, 4)) as i) a, (select unnest(range(0, 4)) as j) b) e) h
        group by sy, sx, ty, tx, i) l
  where not outside and t0 < t1 group by sy, sx, ty, tx"""


_CONSERVATIVE_SQL = f"""with {_SOURCE_SQL}, {_lattice_sql(COARSE, COARSE_INSET)},
{_cells_sql('sc', 'geo', 'y', 'x')}, {_cells_sql('tc', 'lat', 'ty', 'tx')},
pairs as (
  select sc.r as sy, sc.c as sx, tc.r as ty, tc.c as tx, [z - tc.us[1] for z in sc.us] as su, [z - tc.vs[1] for z in sc.vs] as sv,
         [z - tc.us[1] for z in tc.us] as tu, [z - tc.vs[1] for z in tc.vs] as tv
  from sc join tc on list_min(sc.us) < list_max(tc.us) and list_min(tc.us) < list_max(sc.us)
                 and list_min(sc.vs) < list_max(tc.vs) and list_min(tc.vs) < list_max(sc.vs)),
w as (
  select sy, sx, ty, tx, sum(turns) / 2 as w
  from ({_inside_sql('s', 't')} union all {_inside_sql('t', 's')}) parts group by 1, 2, 3, 4)
select clim.time, cast(ty as int) as y, cast(tx as int) as x, sum(w * o) / sum(case when o is not null then w end) as o
from clim join w on clim.y = sy and clim.x = sx where w > 1e-9 group by 1, 2, 3"""


def source(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The month climatology and the centres of its grid."""
    clim = resample.climatology(fx.grid_wide(spark, sf).select("time", "y", "x", "o"), ["o"], by="month").withColumnRenamed("month", "time")
    clim = written(clim, "climatology")   # read for the extent, the centres and the values
    y, x = F.col("y"), F.col("x")
    centres = clim.select("y", "x").distinct().select(
        "y", "x", (0.8 * x - 0.6 * y + 0.02 * x * x).alias("u"), (0.6 * x + 0.8 * y + 0.01 * x * x).alias("v"))
    return clim, centres


@register("regrid_curvilinear", with_fixtures(_BILINEAR_SQL, "grid_wide"), ("o",))
def q_regrid_curvilinear(spark, sf):
    """A rotated, bent grid to a lattice by bilinear weights."""
    clim, centres = source(spark, sf)
    weights = curvilinear.bilinear_weights(centres, curvilinear.lattice(centres, STEP, INSET, listed=False))
    return curvilinear.apply_bilinear(clim, ["o"], weights)


@register("regrid_curvilinear_conservative", with_fixtures(_CONSERVATIVE_SQL, "grid_wide"), ("o",))
def q_regrid_curvilinear_conservative(spark, sf):
    """The same grid to a coarser lattice by areas of overlap."""
    clim, centres = source(spark, sf)
    weights = curvilinear.conservative_weights(centres, curvilinear.lattice(centres, COARSE, COARSE_INSET, listed=False)).where(F.col("w") > 1e-9)
    return curvilinear.apply_conservative(clim, ["o"], weights)
