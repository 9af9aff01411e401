"""Least-cost fields and routes on the 8-connected lattice.

A step costs the mean of the two cells times its length (1 or sqrt 2). A field is settled tile by tile over a fixed table of tiles: a
round runs only the tiles that improved border cells of a neighbour touch, and writes only the cells that fell, so that what a round
writes follows the frontier. A cell's distance is the least of what the rounds wrote of it.

Routes are traced back through the settled field. Each cell points to the neighbour that its distance came from; inside a tile these
pointers are followed at once, and the legs between border cells are joined over tiles by pointer doubling, in as many rounds as the
logarithm of the tiles that a route crosses. No task holds more than one tile.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.core import Steps, materialize
from cellweave.functions.algebra import WALL

TILE = 1024
#: Tiles of a round that are named in filters.
NAMED_TILES = 200
#: How far a vehicle works its way off the network, in metres, and what a cell of that costs (fixed values).
SPUR_M, SPUR_COST = 1500.0, 0.50
_STEPS = [(a, b, math.hypot(a, b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


class _Tile:
    """A tile's costs and distances as arrays with a frame of one cell, which holds what neighbours sent."""

    def __init__(self, tr: int, tc: int, side: int):
        self.r0, self.c0, self.side = tr * side, tc * side, side
        self.cost, self.dist = np.full((2, side + 2, side + 2), np.inf)

    def place(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("r").to_numpy() - self.r0 + 1, t.column("c").to_numpy() - self.c0 + 1

    def put(self, t: pa.Table) -> None:
        """Costs where rows have them, and the least of the distances."""
        at = self.place(t)
        for name, into in (("cost", self.cost), ("dist", self.dist)):
            values = t.column(name).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(values)
            np.minimum.at(into, (at[0][known], at[1][known]), values[known])

    @functools.cached_property
    def lengths(self) -> list[np.ndarray]:
        """What a step from each neighbour costs, for the cells inside the frame."""
        n, inner = self.side + 1, self.cost[1:-1, 1:-1]
        return [step * (self.cost[1 + a : n + a, 1 + b : n + b] + inner) / 2 for a, b, step in _STEPS]

    def settle(self) -> None:
        """Relax until no cell inside falls, from what is nearest on: of the cells that fell, those within a stride of the least are spread next."""
        n = self.side + 4  # one more frame, so that steps from the first stay in the array
        pad = lambda a: np.pad(a, 1, constant_values=np.inf).ravel()
        dist, cost = pad(self.dist), pad(self.cost)
        inside = np.zeros((n, n), bool)
        inside[2:-2, 2:-2] = True
        inside = inside.ravel() & np.isfinite(cost)
        todo = np.flatnonzero(np.isfinite(dist) & np.isfinite(cost))
        usual = cost[np.isfinite(cost)]
        stride = math.inf  # first all that is known spreads one step, and what was settled before falls out
        waits = np.zeros(n * n, bool)
        while len(todo):
            far = dist[todo]
            near = far <= far.min() + stride
            at, rest = todo[near], todo[~near]
            waits[at] = False
            fell = [rest]
            for a, b, step in _STEPS:
                to = at + (a * n + b)
                length = dist[at] + step * (cost[at] + cost[to]) / 2
                less = (length < dist[to]) & inside[to]
                to = to[less]
                dist[to] = length[less]
                new = to[~waits[to]]
                waits[new] = True
                fell.append(new)
            waits[rest] = True
            todo, stride = np.unique(np.concatenate(fell)), 2 * float(usual.mean())
        self.dist = dist.reshape(n, n)[1:-1, 1:-1].copy()

    def pointers(self) -> np.ndarray:
        """For each cell inside, which of _STEPS leads to the neighbour that its distance came from (ties: the smaller row, then column), or -1."""
        n, inner = self.side + 1, self.dist[1:-1, 1:-1]
        out = np.full(inner.shape, -1, np.int8)
        for k, ((a, b, _), length) in enumerate(zip(_STEPS, self.lengths)):
            near = self.dist[1 + a : n + a, 1 + b : n + b]
            out[(out < 0) & np.isfinite(inner) & (near < inner) & (near + length == inner)] = k
        return out


_NEWS = "tr int, tc int, r int, c int, cost double, dist double"
_FOUND = f"{_NEWS}, own boolean"


def _round(side: int):
    def run(key, t):
        """What falls in a tile: rows are its cells (no dist), what earlier rounds found (known) and news from its neighbours or seeds."""
        tile = _Tile(key[0].as_py(), key[1].as_py(), side)
        known = t.column("known").to_numpy(zero_copy_only=False)
        tile.put(t.filter(pa.array(known)))
        before = tile.dist[1:-1, 1:-1].copy()
        tile.put(t.filter(pa.array(~known)))
        tile.settle()
        dist, cost = tile.dist[1:-1, 1:-1], tile.cost[1:-1, 1:-1]
        r, c = np.nonzero((dist < before) & np.isfinite(cost))
        up, left = np.where(r == 0, -1, np.where(r == side - 1, 1, 0)), np.where(c == 0, -1, np.where(c == side - 1, 1, 0))
        if side == 1:
            shown = [(a, b, np.arange(len(r))) for a, b, _ in _STEPS]
        else:  # of the other tiles, those that see a border cell are above or below it, beside it, and across the corner
            shown = [(a, b, np.flatnonzero(((a == 0) | (up == a)) & ((b == 0) | (left == b)))) for a, b, _ in _STEPS]
        at = np.concatenate([np.arange(len(r)), *[i for _, _, i in shown]])
        tr, tc = (np.concatenate([np.full(len(r), key[k].as_py()), *[np.full(len(x[2]), key[k].as_py() + x[k]) for x in shown]]).astype(np.int32) for k in (0, 1))
        columns = [tr, tc, (r + tile.r0).astype(np.int32)[at], (c + tile.c0).astype(np.int32)[at], cost[r, c][at], dist[r, c][at], np.arange(len(at)) < len(r)]
        return pa.table(dict(zip(("tr", "tc", "r", "c", "cost", "dist", "own"), map(pa.array, columns))))

    return run


def _legs(side: int):
    def run(key, tiles, ends):
        """Where the way back from each border cell and each end leaves the tile: the cell it enters next, or none at a seed."""
        tile = _Tile(key[0].as_py(), key[1].as_py(), side)
        tile.put(tiles)
        way = tile.pointers().ravel().astype(np.int64)
        steps = np.array([(a, b) for a, b, _ in _STEPS] + [(0, 0)])
        r, c = np.divmod(np.arange(side * side), side)
        to_r, to_c = r + steps[way, 0], c + steps[way, 1]
        stays = (way >= 0) & (to_r >= 0) & (to_r < side) & (to_c >= 0) & (to_c < side)
        jump, count = np.where(stays, to_r * side + to_c, r * side + c), stays.astype(np.int64)
        while True:  # pointer doubling inside the tile
            further = jump[jump]
            if (further == jump).all():
                break
            count, jump = count + count[jump], further
        inner = tile.dist[1:-1, 1:-1].ravel()
        border = (r == 0) | (r == side - 1) | (c == 0) | (c == side - 1)
        asked = np.zeros(side * side, bool)
        at = tile.place(ends)
        asked[(at[0] - 1) * side + at[1] - 1] = True
        entry = np.flatnonzero((border | asked) & np.isfinite(inner))
        last = jump[entry]
        leaves = way[last] >= 0
        columns = [
            pa.array((r[entry] + tile.r0).astype(np.int32)), pa.array((c[entry] + tile.c0).astype(np.int32)),
            pa.array((to_r[last] + tile.r0).astype(np.int32), mask=~leaves), pa.array((to_c[last] + tile.c0).astype(np.int32), mask=~leaves), pa.array(count[entry] + leaves),
        ]
        return pa.table(dict(zip(("r", "c", "nr", "nc", "steps"), columns)))

    return run


def _walk(side: int):
    def run(key, tiles, entries):
        """The cells of each leg that begins in the tile, counted on from how far its entry is from the route's end."""
        tile = _Tile(key[0].as_py(), key[1].as_py(), side)
        tile.put(tiles)
        way = tile.pointers()
        out: list[tuple[int, int, int, int]] = []
        for route, r, c, back in zip(*(entries.column(x).to_pylist() for x in ("route", "r", "c", "back"))):
            a, b = r - tile.r0, c - tile.c0
            while True:
                out.append((route, back, a + tile.r0, b + tile.c0))
                k = way[a, b]
                if k < 0:
                    break
                a, b, back = a + _STEPS[k][0], b + _STEPS[k][1], back + 1
                if not (0 <= a < side and 0 <= b < side):
                    break
        route, back, r, c = zip(*out) if out else ((),) * 4
        return pa.table({"route": pa.array(route, pa.int64()), "back": pa.array(back, pa.int64()), "r": pa.array(r, pa.int32()), "c": pa.array(c, pa.int32())})

    return run


class Field:
    """Least costs from the seeds, kept as a table of tiles so that any number of routes can be traced through it. close() deletes it."""

    def __init__(self, cells: DataFrame, cost: str, seeds: Column, tile: int = TILE):
        """Cells without cost or at WALL are closed."""
        self.tile, self.steps = tile, Steps(cells.sparkSession, "field")
        place = [F.expr(f"cast(floor({x} / {tile}) as int)").alias(f"t{x}") for x in ("r", "c")]
        open_cells = cells.where(F.col(cost).isNotNull() & (F.col(cost) < WALL)).select(*place, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(cost).cast("double").alias("cost"), F.coalesce(seeds, F.lit(False)).alias("seed"))
        self.base = self.steps.table(open_cells.repartition("tr", "tc").sortWithinPartitions("tr", "tc"), "cells")
        low_r, low_c, high_r, high_c = self.base.agg(F.min("tr"), F.min("tc"), F.max("tr"), F.max("tc")).head()
        self.inside = F.lit(False) if low_r is None else F.col("tr").between(low_r, high_r) & F.col("tc").between(low_c, high_c)
        self.fallen: DataFrame | None = None
        self.rounds = 0
        news = self.base.where("seed").select("tr", "tc", "r", "c", "cost", F.lit(0.0).alias("dist"))
        while True:
            active = news.select("tr", "tc").distinct().limit(NAMED_TILES + 1).collect()
            if not active:
                break
            news = self.round(news, active)

    def border(self, cells: DataFrame) -> DataFrame:
        """cells (tr, tc, r, c, ..) at the border of their tile, once for each other tile that sees them."""
        edge = lambda x: F.pmod(F.col(x), F.lit(self.tile)).isin(0, self.tile - 1)
        of = lambda x, d: F.floor((F.col(x) + d) / self.tile).cast("int")
        near = F.array_distinct(F.array(*[F.struct(of("r", a).alias("tr"), of("c", b).alias("tc")) for a, b, _ in _STEPS]))
        spread = cells.where(edge("r") | edge("c")).withColumn("t", F.explode(near)).where((F.col("t.tr") != F.col("tr")) | (F.col("t.tc") != F.col("tc")))
        return spread.withColumns({"tr": F.col("t.tr"), "tc": F.col("t.tc")}).drop("t").where(self.inside)

    def round(self, news: DataFrame, active: list) -> DataFrame:
        """Run the tiles that have news; remembers what fell and returns what other tiles see of it. Up to NAMED_TILES tiles are named to the scans, more are joined."""
        known = self.base.select("tr", "tc", "r", "c", "cost", F.lit(None).cast("double").alias("dist"))
        if self.fallen is not None:
            known = known.unionByName(self.fallen.withColumn("cost", F.lit(None).cast("double")))
        if len(active) <= NAMED_TILES:
            rows, cols = {x.tr for x in active}, {x.tc for x in active}
            known = known.where(F.col("tr").isin(rows) & F.col("tc").isin(cols) & F.struct("tr", "tc").isin([F.struct(F.lit(x.tr).alias("tr"), F.lit(x.tc).alias("tc")) for x in active]))
        else:
            known = known.join(news.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        rows = known.withColumn("known", F.lit(True)).unionByName(news.withColumn("known", F.lit(False)))
        found = self.steps.table(rows.groupBy("tr", "tc").applyInArrow(_round(self.tile), _FOUND), f"fallen/round={self.rounds}")
        self.rounds += 1
        self.fallen = self.steps.spark.read.schema(_FOUND).parquet(*[f"{self.steps.folder}/fallen/round={k}" for k in range(self.rounds)]).where("own").drop("own")
        return found.where("not own").where(self.inside).drop("own")

    def settled(self) -> DataFrame:
        """(tr, tc, r, c, cost, dist) of every open cell; dist is null where no route leads."""
        known = self.base.select("tr", "tc", "r", "c", "cost", F.lit(None).cast("double").alias("dist"))
        if self.fallen is not None:
            known = known.unionByName(self.fallen)
        return known.groupBy("tr", "tc", "r", "c").agg(F.max("cost").alias("cost"), F.min("dist").alias("dist"))

    def routes(self, ends: DataFrame) -> DataFrame:
        """(route, step, r, c): for each of ends (route, r, c) a least-cost route from a seed (step 0) to it. Ends that no route reaches give no rows.

        Ties of a step go to the smaller row, then column. A way back ends where no neighbour is cheaper, so steps between cells of cost 0 are not traced.
        """
        place = lambda df: df.withColumns({"tr": F.floor(F.col("r") / self.tile).cast("int"), "tc": F.floor(F.col("c") / self.tile).cast("int")})
        settled = self.steps.table(self.settled().where("dist is not null"), f"settled-{self.rounds}")
        framed = settled.unionByName(self.border(settled))
        asked = place(ends.select(F.col("route").cast("long").alias("route"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")))
        asked = self.steps.table(asked.join(settled.select("r", "c"), ["r", "c"], "left_semi"), f"ends-{self.rounds}")
        by = lambda df: df.groupBy("tr", "tc")
        legs = by(framed).cogroup(by(asked)).applyInArrow(_legs(self.tile), "r int, c int, nr int, nc int, steps long")
        legs = self.steps.table(legs, f"legs-{self.rounds}-0").where("nr is not null")
        entries = [asked.select("route", "r", "c", F.lit(0).cast("long").alias("back"))]
        for k in range(64):
            reached = entries[0] if k == 0 else functools.reduce(DataFrame.unionByName, entries)
            more = reached.join(legs, ["r", "c"]).select("route", F.col("nr").alias("r"), F.col("nc").alias("c"), (F.col("back") + F.col("steps")).alias("back"))
            more = self.steps.table(more, f"entries-{self.rounds}-{k}")
            if more.isEmpty():
                break
            entries.append(more)
            on = legs.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("mr"), F.col("nc").alias("mc"), F.col("steps").alias("more"))
            legs = self.steps.table(legs.join(on, ["nr", "nc"]).select("r", "c", F.col("mr").alias("nr"), F.col("mc").alias("nc"), (F.col("steps") + F.col("more")).alias("steps")), f"legs-{self.rounds}-{k + 1}")
        entries = place(functools.reduce(DataFrame.unionByName, entries))
        crossed = framed.join(entries.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        walked = materialize(by(crossed).cogroup(by(entries)).applyInArrow(_walk(self.tile), "route long, back long, r int, c int"), "routes")
        length = walked.groupBy("route").agg(F.max("back").alias("length"))
        return walked.join(length, "route").select("route", (F.col("length") - F.col("back")).cast("int").alias("step"), "r", "c")

    def close(self) -> None:
        self.steps.close()


def cost_field(cells: DataFrame, cost: str, seeds: Column, out: str, tile: int = TILE) -> DataFrame:
    """(r, c, out): least cost from the nearest seed; null where no route leads. Cells without cost or at WALL are closed."""
    field = Field(cells, cost, seeds, tile)
    done = materialize(field.settled().select("r", "c", F.col("dist").alias(out)), "field")
    field.close()
    return done


def corridor(cells: DataFrame, cost: str, start: Column, end: Column, eps: float = 1e-9) -> DataFrame:
    """(r, c, from_start, from_end, total): the cells of all least-cost routes between the starts and the ends."""
    both = cost_field(cells, cost, start, "from_start").join(cost_field(cells, cost, end, "from_end"), ["r", "c"])
    both = materialize(both, "both")
    total = both.agg(F.min(F.col("from_start") + F.col("from_end")).alias("total"))
    return both.crossJoin(F.broadcast(total)).where(F.col("from_start") + F.col("from_end") <= F.col("total") * (1 + eps) + eps)  # total is one row


def least_cost_path(cells: DataFrame, cost: str, start: Column, end: Column, tile: int = TILE) -> DataFrame:
    """(step, r, c), in order of step, of one least-cost route from a start to the end that is cheapest to reach (ties: the smaller row, then column)."""
    field = Field(cells, cost, start, tile)
    ends = field.settled().where("dist is not null").join(cells.where(end).select("r", "c"), ["r", "c"])
    best = ends.agg(F.min(F.struct("dist", "r", "c")).alias("e")).where("e is not null").select(F.lit(0).alias("route"), "e.r", "e.c")
    route = field.routes(best)
    field.close()
    return route.select("step", "r", "c").orderBy("step")


def transfer(ride: DataFrame, walk: DataFrame) -> DataFrame:
    """(r, c, total, ride): where to leave the vehicle, i.e. the cell of the network with the least ride + walk."""
    both = ride.join(walk, ["r", "c"]).where("ride is not null and walk is not null")
    best = F.min_by(F.struct("r", "c", "ride"), F.struct((F.col("ride") + F.col("walk")).alias("t"), "r", "c"))
    return both.agg(best.alias("at"), F.min(F.col("ride") + F.col("walk")).alias("total")).select("at.r", "at.c", "total", "at.ride")


def around(anchors: DataFrame, reach: float) -> DataFrame:
    """(r, c): every place within reach, in cells, of one of the anchors (r, c)."""
    rows = anchors.select("r", "c", F.explode(F.sequence(F.lit(-math.floor(reach)), F.lit(math.floor(reach)))).alias("dr"))
    half = F.floor(F.sqrt(F.lit(float(reach) ** 2) - F.col("dr") * F.col("dr"))).cast("int")
    return rows.select((F.col("r") + F.col("dr")).alias("r"), F.explode(F.sequence(F.col("c") - half, F.col("c") + half)).alias("c")).distinct()


def mode_route(
    cells: DataFrame, walk_cost: str, net: Column, ride_cost: float, start: Column, end: Column, *, res: float = 40.0, end_drivable: bool = False, launch: Column | None = None, spur_m: float = SPUR_M, spur_cost: float = SPUR_COST
) -> DataFrame:
    """(mode, r, c, total, walk_only): one vehicle leg from the start over the network, then on foot; on foot all the way unless riding is cheaper.

    Both are geometric costs. r, c is where the vehicle stays behind, null on foot.

    The vehicle is at the start. From a start off the network it works its way over any cell within spur_m metres (res metres a cell) at
    spur_cost, but it stays behind on the network only. With end_drivable the end is a place to drive to: it has a spur as well, and a
    ride all the way is taken if it is cheaper than walking.

    With launch the vehicle is a boat: no spur and no drivable end. From a start off the water it is put in at the cells of the network
    where launch holds, at no cost of the way there, which total leaves out; where the best place to leave it is where it is put in, one walks.
    """
    flag = lambda x: F.coalesce(x, F.lit(False))
    marked = cells.withColumns({"_net": flag(net), "_start": flag(start), "_end": flag(end), "_launch": flag(F.lit(False) if launch is None else launch)}).select("r", "c", "_net", "_start", "_end", "_launch")
    marked, seeds, price = materialize(marked, "marked"), F.col("_start"), F.when(F.col("_net"), F.lit(ride_cost))
    if launch is not None:
        if marked.where("_start and _net").isEmpty():
            seeds = F.col("_launch") & F.col("_net")
    else:
        off = marked.where((F.col("_start") | (F.col("_end") & F.lit(end_drivable))) & ~F.col("_net")).select("r", "c")
        if not off.isEmpty():
            marked = marked.join(around(off, spur_m / res).withColumn("_near", F.lit(True)), ["r", "c"], "left")
            price = price.otherwise(F.when(F.col("_near"), F.lit(spur_cost)))
    ride = materialize(cost_field(marked.withColumn("_ride", price), "_ride", seeds, "ride"), "ride").join(marked.select("r", "c", "_net", "_end"), ["r", "c"])
    walk = materialize(cost_field(cells, walk_cost, end, "walk"), "walk")
    on_foot = walk.join(cells.where(start).select("r", "c"), ["r", "c"]).agg(F.min("walk").alias("walk_only"))
    whole = F.struct(F.col("ride").alias("total"), "r", "c")
    drivable = ride.where(F.col("_end") & F.lit(end_drivable and launch is None) & F.col("ride").isNotNull()).agg(F.min(whole).alias("w"))
    best = transfer(ride.where("_net").select("r", "c", "ride"), walk).crossJoin(on_foot).crossJoin(drivable)  # one row each
    cheaper = lambda x: F.coalesce(x < F.col("walk_only"), x.isNotNull())
    out = F.when(cheaper(F.col("w.total")), F.col("w")).when(cheaper(F.col("total")) & (F.col("ride") > 0), F.struct("total", "r", "c"))
    best = best.select(out.alias("v"), "walk_only")
    return best.select(F.when(F.col("v").isNotNull(), "vehicle").otherwise("foot").alias("mode"), "v.r", "v.c", F.coalesce("v.total", "walk_only").alias("total"), "walk_only")
