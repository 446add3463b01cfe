"""Solids of balls, tile by tile of their grids.

Only balls are shuffled: each goes to the tiles, cubes of ``TILE`` voxels, that it reaches with a margin. A task then has all
that the voxels of a tile depend on, so owners, boundary, cells of the surface and quads need no further shuffle, and what a task
holds at once is one tile, however large or crowded the structure is: equal balls of a tile are one row, that of their first atom."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solids import union

TILE, MARGIN = 64, 4
FREE = np.iinfo(np.int64).max
_KEY = ["structure_id", "ti", "tj", "tk"]
_CORNERS = [(n & 1, n >> 1 & 1, n >> 2 & 1) for n in range(8)]
#: Cells of a quad's corners, from the cell that names it.
PLANES = {"xz": ((0, 0, 0), (-1, 0, 0), (-1, 0, -1), (0, 0, -1)), "yz": ((0, 0, 0), (0, -1, 0), (0, -1, -1), (0, 0, -1)), "xy": ((0, 0, 0), (-1, 0, 0), (-1, -1, 0), (0, -1, 0))}


def dealt(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """``placed`` balls (see ``solids.chords``; ``limit`` is how near to the boundary voxels are carved off) once for each tile
    they reach, partitioned by tile."""
    if "limit" not in placed.columns:
        placed = placed.withColumn("limit", F.lit(0.0))
    w = F.floor("ball").cast("int") + MARGIN
    for t, n in zip("ijk", "xyz", strict=True):
        first, last = F.floor((F.col(f"c{t}") - w) / tile).cast("int"), F.floor((F.col(f"c{t}") + w) / tile).cast("int")
        most = F.floor((F.col(f"n{n}") - 1) / tile).cast("int")
        first, last = F.greatest(first, F.lit(0)), F.least(last, most)
        placed = placed.withColumn(f"t{t}", F.explode(F.when(first <= last, F.sequence(first, last))))
    return placed.repartition(*_KEY).groupBy(*_KEY, "ci", "cj", "ck", "ball", "nx", "ny", "nz", "limit").agg(F.min("atom_idx").alias("atom_idx"))


@lru_cache(maxsize=256)
def _stencil(ball: float) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the voxels of a ball and their squared distances."""
    w = int(ball)
    o = np.array([(a, b, c) for a, b, c in product(range(-w, w + 1), repeat=3) if ball * ball - a * a - b * b >= 0 and abs(c) <= int(np.sqrt(ball * ball - a * a - b * b))], dtype=np.int64)
    return o, (o * o).sum(1)


class Tile:
    """The voxels of a tile and of a margin around it, empty where the grid ends."""

    def __init__(self, key: tuple, balls: pa.Table, tile: int) -> None:
        column = lambda c: balls[c].to_numpy()
        centre, ball, atom = np.stack([column(f"c{v}") for v in "ijk"], 1).astype(np.int64), column("ball"), column("atom_idx").astype(np.int64)
        self.id, self.size, self.limit = key[0], np.array([balls[f"n{v}"][0].as_py() for v in "xyz"]), balls["limit"][0].as_py()
        w = int(ball.max())
        low, high = centre.min(0) - w, centre.max(0) + w
        box = high - low + 1
        stride = np.array([box[1] * box[2], box[2], 1])
        best = np.full(box.prod(), FREE)
        for b in np.unique(ball):
            offsets, d2 = _stencil(float(b))
            own = ball == b
            starts, owners, some = (centre[own] - low) @ stride, atom[own], max(1, (1 << 20) // len(d2))
            for at in range(0, len(starts), some):
                nodes, owner = starts[at : at + some, None] + offsets @ stride, owners[at : at + some, None]
                np.minimum.at(best, nodes.ravel(), ((d2 << 32) + owner).ravel())
        start = np.array([k.as_py() for k in key[1:]]) * tile
        end = start + tile - 1
        self.first, last = np.clip(low, start, end) - MARGIN, np.clip(high, start, end) + MARGIN
        self.best = np.full(last - self.first + 1, FREE)
        a, b = np.maximum(np.maximum(self.first, low), 0), np.minimum(np.minimum(last, high), self.size - 1)
        if (a <= b).all():
            cut = lambda origin: tuple(slice(x, y) for x, y in zip(a - origin, b - origin + 1, strict=True))
            self.best[cut(self.first)] = best.reshape(box)[cut(low)]
        self.inside = self.best != FREE
        # nothing is made more than a voxel beyond the balls, and the outermost voxels of the margin see past its ends
        self.own = self.box(np.maximum(start, self.first + 2), np.minimum(np.minimum(end, last - 2) + 1, self.size))

    def box(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each voxel lies from ``start`` to before ``end``."""
        within = [(at >= a) & (at < b) for at, a, b in zip([f + np.arange(n) for f, n in zip(self.first, self.inside.shape, strict=True)], start, end, strict=True)]
        return within[0][:, None, None] & within[1][None, :, None] & within[2][None, None, :]

    def boundary(self) -> np.ndarray:
        """Voxels inside with one of 26 neighbours in the grid outside."""
        full = self.inside | ~self.box(np.zeros(3), self.size)
        for axis in range(3):
            full = full & np.roll(full, 1, axis) & np.roll(full, -1, axis)
        return self.inside & ~full

    def solid(self) -> np.ndarray:
        """Voxels inside, without those nearer than ``limit`` (squared) to the boundary; at most 4, so only neighbours are."""
        if self.limit <= 0:
            return self.inside
        bound = self.boundary()
        near = [np.roll(bound, o, (0, 1, 2)) for o in product((-1, 0, 1), repeat=3) if sum(c * c for c in o) < self.limit]
        return self.inside & ~reduce(np.logical_or, near)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The mask of corners in the solid of each cell, and whether it has a vertex."""
        solid = self.solid().astype(np.int64)
        mask = sum(np.roll(solid, (-a, -b, -c), (0, 1, 2)) << n for n, (a, b, c) in enumerate(_CORNERS))
        return mask, (mask > 0) & (mask < 255) & self.box(np.zeros(3), self.size - 1)

    def table(self, at: np.ndarray, **columns: np.ndarray) -> pa.Table:
        given = {"structure_id": pa.repeat(self.id, len(at))} | {v: pa.array((at[:, n] + self.first[n]).astype(np.int32)) for n, v in enumerate("ijk")}
        return pa.table(given | {k: pa.array(c) for k, c in columns.items()})


def _middles() -> np.ndarray:
    """By mask: the mean of the middles of the cell edges that cross, from the cell's place."""
    out = np.zeros((256, 3))
    edges = [(n, n | 1 << axis) for axis in range(3) for n in range(8) if not n >> axis & 1]
    for mask in range(1, 255):
        crossed = [(n, m) for n, m in edges if (mask >> n & 1) != (mask >> m & 1)]
        out[mask] = [sum((_CORNERS[n][v] + _CORNERS[m][v]) / 2 for n, m in crossed) / len(crossed) for v in range(3)]
    return out


_MIDDLE = _middles()


def _each(placed: DataFrame, make: Callable[[Tile], pa.Table], columns: str, tile: int) -> DataFrame:
    schema = f"structure_id {placed.schema['structure_id'].dataType.simpleString()}, {columns}"
    return dealt(placed, tile).groupBy(*_KEY).applyInArrow(lambda key, balls: make(Tile(key, balls, tile)), schema)


def voxels(placed: DataFrame, part: str = "solid", tile: int = TILE) -> DataFrame:
    """structure_id, i, j, k, atom_idx, d2 of the voxels of the "solid" or its "boundary"; the owner is the nearest centre, the
    first atom on ties."""

    def make(t: Tile) -> pa.Table:
        at = np.argwhere((t.solid() if part == "solid" else t.boundary()) & t.own)
        best = t.best[tuple(at.T)]
        return t.table(at, atom_idx=(best & 0xFFFFFFFF).astype(np.int32), d2=(best >> 32).astype(np.int32))

    return _each(placed, make, "i int, j int, k int, atom_idx int, d2 int", tile)


def runs(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """structure_id, i, j, lo, hi: the solid as runs along k. Those that reach a face of their tile are put together by column."""

    def make(t: Tile) -> pa.Table:
        solid = np.pad(t.solid() & t.own, ((0, 0), (0, 0), (1, 1))).astype(np.int8)
        turn = np.diff(solid, axis=2)
        lo, hi = np.argwhere(turn == 1), np.argwhere(turn == -1)  # both in order of column, so they belong together
        got = t.table(lo).rename_columns(["structure_id", "i", "j", "lo"])
        return got.append_column("hi", pa.array((hi[:, 2] - 1 + t.first[2]).astype(np.int32)))

    each = _each(placed, make, "i int, j int, lo int, hi int", tile)
    meets = (F.pmod("lo", F.lit(tile)) == 0) | (F.pmod("hi", F.lit(tile)) == tile - 1)
    return each.filter(~meets).unionByName(union(each.filter(meets)))


def vertices(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """structure_id, i, j, k (cell), x, y, z (grid units) of the vertices of ``surface.net_vertices``, and the atom that owns the
    nearest grid node, null for nodes outside of all balls."""

    def make(t: Tile) -> pa.Table:
        mask, mixed = t.cells()
        at = np.argwhere(mixed & t.own)
        place = at + t.first + _MIDDLE[mask[tuple(at.T)]]
        node = np.clip(np.floor(place + 0.5).astype(np.int64), 0, t.size - 1) - t.first
        best = t.best[tuple(node.T)]
        return t.table(at, **{c: place[:, n] for n, c in enumerate("xyz")}).append_column("atom_idx", pa.array((best & 0xFFFFFFFF).astype(np.int32), mask=best == FREE))

    return _each(placed, make, "i int, j int, k int, x double, y double, z double, atom_idx int", tile)


def _quads(t: Tile) -> list[tuple[str, np.ndarray, list[np.ndarray]]]:
    """By plane: the cells that name a quad, in the tile's frame, and the places of its four corners."""
    mask, mixed = t.cells()
    out = []
    for plane, offsets in PLANES.items():
        at = np.argwhere(reduce(np.logical_and, [np.roll(mixed, tuple(-x for x in o), (0, 1, 2)) for o in offsets]) & t.own)
        at = at[at[:, 2] + t.first[2] > 0] if plane == "xy" else at
        out.append((plane, at, [c + t.first + _MIDDLE[mask[tuple(c.T)]] for c in (at + np.array(o) for o in offsets)]))
    return out


def _gradient(t: Tile, centre: np.ndarray) -> np.ndarray:
    """The gradient of the field, 1 at voxels inside before carving, by trilinear samples half a voxel to each side."""
    field, shape, out = t.inside.astype(float).ravel(), t.inside.shape, np.zeros(centre.shape)
    stride = np.array([shape[1] * shape[2], shape[2], 1])
    for axis, side in product(range(3), (-1, 1)):
        probe = centre + side * 0.5 * np.eye(3)[axis]
        low = np.floor(probe)
        after = (probe - low).T
        weight, node = (1 - after, after), (low.astype(np.int64) - t.first) @ stride
        for a, b, c in _CORNERS:
            out[:, axis] -= side * (weight[a][0] * weight[b][1] * weight[c][2]) * field[node + np.array([a, b, c]) @ stride]
    return out


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({v: f"q{v}" for v in "ijk"})


def _corner(corner: Column, place: str) -> Column:
    """A quad's corner with its cell and its place (columns x, y, z followed by ``place``)."""
    cell = [F.coalesce(*[F.when((F.col("plane") == p) & (corner == n), F.col(f"q{v}") + o[a]) for p, offsets in PLANES.items() for n, o in enumerate(offsets)]).alias(v) for a, v in enumerate("ijk")]
    return F.struct(corner.alias("corner"), *cell, *[F.col(f"{c}{place}").alias(c) for c in "xyz"])


def quads(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """structure_id, qi, qj, qk, plane, v: the quads of ``surface.net_quads``."""

    def make(t: Tile) -> pa.Table:
        return pa.concat_tables(
            t.table(at, **{f"{c}{n}": p[:, a] for n, p in enumerate(place) for a, c in enumerate("xyz")}).append_column("plane", pa.repeat(plane, len(at))) for plane, at, place in _quads(t)
        )

    columns = "i int, j int, k int, " + ", ".join(f"{c}{n} double" for n in range(4) for c in "xyz") + ", plane string"
    got = _named(_each(placed, make, columns, tile))
    return got.select("structure_id", "qi", "qj", "qk", "plane", F.array(*[_corner(F.lit(n), str(n)) for n in range(4)]).alias("v"))


def triangles(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """The triangles of ``surface.triangles`` of the surface's quads."""

    def make(t: Tile) -> pa.Table:
        parts = []
        for plane, at, place in _quads(t):
            turned = (np.cross(place[1] - place[0], place[2] - place[0]) * _gradient(t, sum(place) / 4)).sum(1) < 0
            for half, (m, n) in enumerate(((1, 2), (2, 3))):
                p, q = (np.where(turned[:, None], place[x], place[y]) for x, y in ((n, m), (m, n)))
                normal = np.cross(p - place[0], q - place[0])
                columns = {f"{c}{r}": v[:, a] for r, v in enumerate((place[0], p, q)) for a, c in enumerate("xyz")} | {f"n{c}": normal[:, a] for a, c in enumerate("xyz")}
                columns |= {"half": np.full(len(at), half, np.int32), "second": np.where(turned, n, m).astype(np.int32), "third": np.where(turned, m, n).astype(np.int32)}
                parts.append(t.table(at, **columns).append_column("plane", pa.repeat(plane, len(at))).filter(pa.array((normal * normal).sum(1) > 1e-10)))
        return pa.concat_tables(parts)

    columns = "i int, j int, k int, " + ", ".join(f"{c}{n} double" for n in range(3) for c in "xyz") + ", nx double, ny double, nz double, half int, second int, third int, plane string"
    got = _named(_each(placed, make, columns, tile))
    f = F.array(_corner(F.lit(0), "0"), _corner(F.col("second"), "1"), _corner(F.col("third"), "2"))
    return got.select("structure_id", "qi", "qj", "qk", "plane", "half", f.alias("f"), "nx", "ny", "nz")


def areas(placed: DataFrame, tile: int = TILE) -> DataFrame:
    """structure_id, qi, qj, qk, plane, half, area of the ``triangles``. Which way a triangle is turned does not change its area, so
    no field is sampled, and no corner leaves its task: a row a quad does, with the areas of both halves."""

    def make(t: Tile) -> pa.Table:
        parts = []
        for number, (_, at, place) in enumerate(_quads(t)):
            sides, halves = [(p - place[0]).T for p in place[1:]], {}
            for half, (u, v) in enumerate(zip(sides, sides[1:], strict=False)):
                x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
                size = x * x + y * y + z * z
                halves[f"area_{half}"] = pa.array(np.sqrt(size) / 2, mask=size <= 1e-10)
            parts.append(t.table(at, plane=np.full(len(at), number, np.int8), **halves))
        return pa.concat_tables(parts).combine_chunks()

    got = _named(_each(placed, make, "i int, j int, k int, plane byte, area_0 double, area_1 double", tile))
    plane = F.coalesce(*[F.when(F.col("plane") == n, p) for n, p in enumerate(PLANES)])
    each = F.array(*[F.struct(F.lit(n).alias("half"), F.col(f"area_{n}").alias("area")) for n in (0, 1)])
    return got.select("structure_id", "qi", "qj", "qk", plane.alias("plane"), F.inline(each)).filter("area is not null")
