"""From splats to depth images, from a sampled field to a surface, and from one cloud onto another."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from geofuse.functions import camera as cam
from geofuse.functions import splat as sp
from geofuse.operators.cloud import cloud_stats, decode
from geofuse.operators.telemetry import fit_sim3
from geofuse.plans.rank import ranked
from geofuse.plans.shared import few, salt_of, settled, stored, with_groups

c = F.col
# Pixels of a tile, the widest splat, the low-pass, the least alpha, opacity and coverage, and when a pixel is full.
TILE, MOST_RADIUS, DILATION, LEAST_ALPHA, LEAST_OPACITY, LEAST_COVER, FULL = 16, 96.0, 0.3, 1 / 255, 0.02, 0.62, 1e-3
#: The side of a cell, in pixels and in cells of a tile; every so many-th splat shows first how deep a cell can be seen.
CELL, CELLS, SPARSE = 4, TILE // 4, 64


def composite_depth(splats: DataFrame, views: DataFrame, most_pixels: int) -> DataFrame:
    """Depth images: image_id, py, px, depth, cover, nx, ny, nz of the pixels that splats cover well enough.

    Each splat is an ellipse on each view (whose longer side is scaled to most_pixels or less); the pixels that it
    may touch are those of the tiles its three-sigma square meets. A row a splat and tile is shuffled, and put in
    order of depth in the tile (ties by splat_id). Front to back, a pixel takes alpha of what light is left, until it is full;
    splats behind full pixels are passed over. Views are broadcast: the cameras of one model, whose number is checked.

    Before the rows of all splats are dealt out, those of every SPARSE-th are composited, which tells where these few alone let through
    half of what a full pixel may. With all splats less light comes so far, so a splat behind that in all cells of pixels that it can
    touch changes nothing, and its row isn't dealt out. How many rows of a tile are left doesn't grow with the splats where it fills up.
    """
    s = stored(_on_tiles(splats.filter(F.pmod(F.xxhash64("splat_id"), F.lit(SPARSE)) == 0), views, most_pixels), "sparse-splats")
    tile, order = ["image_id", "_tx", "_ty"], ["depth", "splat_id"]
    kind = views.schema["image_id"].dataType.simpleString()

    def dealt(rows: DataFrame, kernel, shape: str) -> DataFrame:
        rows = rows.repartition(*tile).sortWithinPartitions(*tile, *order)
        return rows.select(*tile, *[k for k in s.columns if k not in (*tile, "splat_id", "_cell")]).mapInArrow(kernel, shape)

    behind = stored(dealt(s, _hidden, f"image_id {kind}, _tx long, _ty long, _behind array<double>"), "hidden")
    rows = _on_tiles(splats, views, most_pixels).join(behind, tile, "left")
    rows = rows.filter(c("_behind").isNull() | (c("depth") <= F.get("_behind", c("_cell"))))
    return dealt(rows, _composited, f"image_id {kind}, py int, px int, depth double, cover double, nx double, ny double, nz double")


def _on_tiles(splats: DataFrame, views: DataFrame, most_pixels: int) -> DataFrame:
    """A row for each tile of a view that a splat touches; _cell is the number of the rectangle of cells that holds what it touches there."""
    s = F.least(F.lit(1.0), most_pixels / F.greatest("width", "height"))
    v = views.select(
        "image_id", (c("f") * s).alias("vf"), F.greatest(F.round(c("width") * s), F.lit(1.0)).alias("vw"), F.greatest(F.round(c("height") * s), F.lit(1.0)).alias("vh"),
        (c("width") / 2 * s).alias("vx"), (c("height") / 2 * s).alias("vy"), *[c(k).alias(f"v_{k}") for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")],
    )
    d = settled(decode(splats).filter(c("opacity") >= LEAST_OPACITY).select("splat_id", *"xyz", "opacity", "sx", "sy", "sz", "uw", "ux", "uy", "uz"))
    own = sp.rotation(c("uw"), c("ux"), c("uy"), c("uz"))
    cov = sp.covariance(own, [c("sx"), c("sy"), c("sz")])
    thin = F.when((c("sx") <= c("sy")) & (c("sx") <= c("sz")), 0).when(c("sy") <= c("sz"), 1).otherwise(2)
    normal = {f"n{k}": F.when(thin == 0, own[i][0]).when(thin == 1, own[i][1]).otherwise(own[i][2]) for i, k in enumerate("xyz")}
    d = settled(d.withColumns(cov | normal).select("splat_id", *"xyz", "opacity", F.greatest("sx", "sy", "sz").alias("widest"), *cov, *normal))
    q, t = tuple(c(f"v_{k}") for k in ("qw", "qx", "qy", "qz")), tuple(c(f"v_{k}") for k in ("tx", "ty", "tz"))
    p = cam.world_to_cam(q, t, (c("x"), c("y"), c("z")))
    eye, turn = cam.centre(q, t), sp.rotation(*q)
    toward = sum((c(f"n{k}") * (eye[i] - c(k)) for i, k in enumerate("xyz")), F.lit(0.0))
    b = d.join(few(v, what="views")).withColumns({"ax": p[0], "ay": p[1], "depth": p[2], "flip": F.when(toward < 0, -1.0).otherwise(1.0)})
    b = settled(b.withColumns({"u": c("vf") * c("ax") / c("depth") + c("vx"), "w": c("vf") * c("ay") / c("depth") + c("vy")})).filter("depth >= 1e-3")
    # Were it as wide all round as at its widest, it would reach so far at most: most splats beside the image end here.
    for at, axis, size in (("u", "ax", "vw"), ("w", "ay", "vh")):
        slope, scale = c(axis) / c("depth"), c("vf") / c("depth") * c("widest")
        far = F.sqrt(24 * (scale * scale * (1 + slope * slope) + DILATION)) + 1e-6
        b = b.filter((c(at) + far >= 0) & (c(at) - far <= c(size)))
    b = b.drop("widest")
    sigma = [[c(f"c{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    # The rows of (Jacobian of the projection) x (rotation of the view), and the 2 x 2 covariance on the image.
    j = [(c("vf") / c("depth"), None, -c("vf") * c("ax") / (c("depth") * c("depth"))), (None, c("vf") / c("depth"), -c("vf") * c("ay") / (c("depth") * c("depth")))]
    b = b.withColumns({f"m{r}{k}": sum((j[r][i] * turn[i][k] for i in range(3) if j[r][i] is not None), F.lit(0.0)) for r in range(2) for k in range(3)})
    b = settled(b)
    flat = lambda a, e: sum((c(f"m{a}{i}") * sigma[i][k] * c(f"m{e}{k}") for i in range(3) for k in range(3)), F.lit(0.0))
    b = settled(b.withColumns({"e0": flat(0, 0) + DILATION, "e1": flat(0, 1), "e2": flat(1, 1) + DILATION}))
    det = c("e0") * c("e2") - c("e1") * c("e1")
    half = (c("e0") + c("e2")) / 2
    radius = 3 * F.sqrt(half + F.sqrt(F.greatest(half * half - det, F.lit(0.0))))
    b = b.withColumns({"det": det, "radius": radius})
    b = settled(b).filter((c("det") > 1e-12) & (c("radius") <= MOST_RADIUS) & (c("u") + c("radius") >= 0) & (c("w") + c("radius") >= 0) & (c("u") - c("radius") < c("vw")) & (c("w") - c("radius") < c("vh")))

    # No alpha counts where the exponent is less than -12, or so low that the opacity comes under the least alpha.
    reach = 2 * F.least(F.lit(12.0), F.log(c("opacity") / LEAST_ALPHA)) + 1e-9

    def span(at: str, var: str, size: str):
        """The first and last pixel that it may touch in the tiles which its square meets."""
        far = F.sqrt(reach * c(var))
        low = F.greatest(F.floor((c(at) - c("radius")) / TILE) * TILE, F.lit(0), F.ceil(c(at) - far - 0.5))
        high = F.least(F.floor((c(at) + c("radius")) / TILE) * TILE + TILE - 1, c(size).cast("long") - 1, F.floor(c(at) + far - 0.5))
        return low, high

    def cells(k: str):
        first = F.greatest(F.floor(c(f"_{k}0") / CELL) - c(f"_t{k}") * CELLS, F.lit(0))
        last = F.least(F.floor(c(f"_{k}1") / CELL) - c(f"_t{k}") * CELLS, F.lit(CELLS - 1))
        return first * CELLS + last

    values = ["depth", "opacity", "u", "w", "e0", "e1", "e2", "det", "nx", "ny", "nz", "vw", "vh"]
    ends = dict(zip(("_x0", "_x1", "_y0", "_y1"), (*span("u", "e0", "vw"), *span("w", "e2", "vh"))))
    b = settled(b.withColumns({f"n{k}": c(f"n{k}") * c("flip") for k in "xyz"} | ends)).filter("_x0 <= _x1 AND _y0 <= _y1")
    for k in "xy":
        b = b.withColumn(f"_t{k}", F.explode(F.sequence(F.floor(c(f"_{k}0") / TILE), F.floor(c(f"_{k}1") / TILE))))
    return b.select("image_id", "_tx", "_ty", "splat_id", (cells("x") * CELLS * CELLS + cells("y")).cast("int").alias("_cell"), *values)


class _Tile:
    """The pixels of a tile while splats come front to back: the light left, sums of what was seen, and how deep it was full."""

    def __init__(self, x: int, y: int, full: float = FULL):
        self.py, self.px = (v.ravel() for v in np.mgrid[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE])
        self.light, self.sums = np.ones(TILE * TILE), np.zeros((5, TILE * TILE))
        self.size, self.full, self.deep = (0, 0), full, np.full(TILE * TILE, np.inf)

    def _open(self) -> np.ndarray:
        """Pixels of the image that aren't full."""
        return (self.light >= self.full) & (self.px < self.size[0]) & (self.py < self.size[1])

    def add(self, s: dict[str, np.ndarray]) -> None:
        """Splats, in order; those that reach no open pixel are passed over."""
        self.size = int(s["vw"][0]), int(s["vh"][0])
        reach = 2 * np.clip(np.log(s["opacity"] / LEAST_ALPHA), 0, 12) + 1e-6
        ends = []
        for at, var, first in (("u", "e0", self.px[0]), ("w", "e2", self.py[0])):
            far = np.sqrt(reach * s[var])
            ends += [np.clip(np.ceil(s[at] - far - 0.5) - first, 0, TILE).astype("int64"), np.clip(np.floor(s[at] + far + 0.5) - first, 0, TILE).astype("int64")]

        def touching(rows: np.ndarray) -> np.ndarray:
            seen = np.zeros((TILE + 1, TILE + 1), "int64")
            seen[1:, 1:] = self._open().reshape(TILE, TILE).cumsum(0).cumsum(1)
            x0, x1, y0, y1 = (e[rows] for e in ends)
            return rows[(x0 < x1) & (y0 < y1) & (seen[y1, x1] - seen[y0, x1] - seen[y1, x0] + seen[y0, x0] > 0)]

        rows = touching(np.arange(len(s["u"])))
        for i in range(0, len(rows), TILE * TILE):
            part = touching(rows[i : i + TILE * TILE])
            if len(part):
                self._piece({k: v[part] for k, v in s.items()})

    def _piece(self, s: dict[str, np.ndarray]) -> None:
        open_ = np.flatnonzero(self._open())
        dx, dy = self.px[open_] + 0.5 - s["u"][:, None], self.py[open_] + 0.5 - s["w"][:, None]
        power = -0.5 * (s["e2"][:, None] * dx * dx - 2 * s["e1"][:, None] * dx * dy + s["e0"][:, None] * dy * dy) / s["det"][:, None]
        alpha = np.minimum(s["opacity"][:, None] * np.exp(np.minimum(power, 0)), 0.99)
        alpha[(power > 0) | (power < -12) | (alpha < LEAST_ALPHA)] = 0
        left = np.exp(np.cumsum(np.log1p(-alpha), axis=0))
        light = self.light[open_] * np.vstack([np.ones(len(open_)), left[:-1]])
        share = np.where(light >= FULL, light * alpha, 0)
        self.sums[:, open_] += np.stack([share.sum(0), *[(share * s[k][:, None]).sum(0) for k in ("depth", "nx", "ny", "nz")]])
        after = self.light[open_] * left
        over = np.flatnonzero(after[-1] < self.full)
        self.deep[open_[over]] = s["depth"][(after[:, over] < self.full).argmax(0)]
        self.light[open_] = after[-1]

    def behind(self, key: tuple) -> pa.RecordBatch:
        """For each rectangle of cells, by its first and last column and row, the depth behind which all its pixels are full."""
        deep = np.where((self.px < self.size[0]) & (self.py < self.size[1]), self.deep, -np.inf)
        deep = deep.reshape(CELLS, CELL, CELLS, CELL).max((1, 3))
        n, none = range(CELLS), np.inf
        out = [deep[c : d + 1, a : b + 1].max() if a <= b and c <= d else none for a in n for b in n for c in n for d in n]
        return pa.RecordBatch.from_pydict({**{k: [v] for k, v in zip(("image_id", "_tx", "_ty"), key)}, "_behind": [out]})

    def pixels(self, image) -> pa.RecordBatch:
        fine = np.flatnonzero((self.sums[0] >= LEAST_COVER) & (self.px < self.size[0]) & (self.py < self.size[1]))
        cover, depth, *n = self.sums[:, fine]
        n = np.stack(n) / np.maximum(cover, 1e-300)
        length = np.sqrt((n**2).sum(0))
        n = np.where(length > 1e-6, n / np.maximum(length, 1e-300), 0.0)
        out = {"image_id": [image] * len(fine), "py": self.py[fine].astype("int32"), "px": self.px[fine].astype("int32"), "depth": depth / np.maximum(cover, 1e-300), "cover": cover}
        return pa.RecordBatch.from_pydict(out | dict(zip(("nx", "ny", "nz"), n)))


def _tiles(batches: Iterator[pa.RecordBatch], full: float) -> Iterator[tuple[tuple, _Tile]]:
    """Tiles whose splats follow each other, done; one is held at a time, and a piece of its splats."""
    at, tile = None, None
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        values = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names[3:]}
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b == a:
                continue
            key = tuple(k[a] for k in keys)
            if key != at:
                if tile:
                    yield at, tile
                at, tile = key, _Tile(int(key[1]), int(key[2]), full)
            tile.add({k: v[a:b] for k, v in values.items()})
    if tile:
        yield at, tile


def _composited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for at, tile in _tiles(batches, FULL):
        yield tile.pixels(at[0])


def _hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half of what a full pixel may let through leaves room for sums in another order."""
    for at, tile in _tiles(batches, FULL / 2):
        if np.isfinite(tile.deep).any():
            yield tile.behind(at)


# Surfaces -------------------------------------------------------------------------------------------------------
#: Samples that a task cuts at once.
ROWS = 1 << 16
# A corner is a number of three bits, its steps along x, y and z; an edge is its lower corner and its axis.
EDGES = [(low, axis) for axis in range(3) for low in range(8) if not low >> axis & 1]
NUMBER = {e: i for i, e in enumerate(EDGES)}


def _face(axis: int, side: int) -> list[int]:
    """The corners of a face, counterclockwise as seen from outside the cube."""
    u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
    ring = [0, u, u | v, v] if side else [0, v, u | v, u]
    return [k | side << axis for k in ring]


FACES = [_face(axis, side) for axis in range(3) for side in (0, 1)]


@functools.cache
def cube_triangles(inside: int, joined: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles, as numbers of edges, of a cube with those corners inside; on the faces of joined, inside corners that face each other are connected.

    On each face the surface runs from where a walk around it leaves the inside to where it enters it. Every
    crossed edge is left on one of its faces and entered on the other, so the runs close to loops; each is a fan.
    """
    after: dict[int, int] = {}
    for f, ring in enumerate(FACES):
        within = [inside >> k & 1 for k in ring]
        number = [NUMBER[(min(a, b), (a ^ b).bit_length() - 1)] for a, b in zip(ring, ring[1:] + ring[:1])]
        for i in (i for i in range(4) if within[i] and not within[(i + 1) % 4]):
            # Without a choice there is one place to enter; else the next along the walk, or the one just before.
            ways = [(i + d) % 4 for d in ((1, 2, 3) if joined >> f & 1 else (3, 2, 1))]
            after[number[i]] = number[next(k for k in ways if not within[k] and within[(k + 1) % 4])]
    out, left = [], set(after)
    while left:
        loop = [min(left)]
        while after[loop[-1]] != loop[0]:
            loop.append(after[loop[-1]])
        left -= set(loop)
        out += [(loop[0], b, a) for a, b in zip(loop[1:], loop[2:])]
    return tuple(out)


def vertex_id(at: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """One number for a vertex: its edge's lower sample, 20 bits an axis, and the axis."""
    half = 1 << 19
    if len(at) and np.abs(at).max() >= half:
        raise ValueError("the lattice is too wide for vertex numbers")
    x, y, z = (at[:, i] + half for i in range(3))
    return (((x << 20) + y << 20) + z) * 4 + axis


def _cut(corners: np.ndarray, colours: np.ndarray, base: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """The surface in some cubes: corners (cube, 8), colours (cube, 8, channels), base (cube, 3), the lowest corner's place, group (cube).

    Vertices, each once in its group: group, number, sample and axis of its edge, place on it (t), colours; and triangles: group, three vertices.
    """
    inside = ((corners < 0) * (1 << np.arange(8))).sum(1)
    joined = np.zeros(len(corners), "int64")
    for f, ring in enumerate(FACES):
        a, b, g, h = (corners[:, i] for i in ring)
        below = a + g - b - h
        saddle = np.where(np.abs(below) < 1e-20, 0.0, (a * g - b * h) / np.where(below == 0, 1.0, below))
        joined |= (saddle < 0).astype("int64") << f
    cubes, edges = [], []
    for case in np.unique(inside * 64 + joined):
        rows = np.flatnonzero(inside * 64 + joined == case)
        for triangle in cube_triangles(int(case) >> 6, int(case) & 63):
            cubes.append(rows)
            edges.append(np.broadcast_to(np.array(triangle), (len(rows), 3)))
    cube, edge = np.repeat(np.concatenate(cubes), 3), np.concatenate(edges).ravel()
    low, axis = np.array(EDGES)[edge].T
    at = base[cube] + (low[:, None] >> np.arange(3) & 1)
    number = vertex_id(at, axis)
    order = np.lexsort((number, group[cube]))
    new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(group[cube][order]) != 0))
    first, vertex = order[new], np.empty(len(order), "int64")
    vertex[order] = np.cumsum(new) - 1
    triangles = group[cube[::3]], vertex.reshape(-1, 3)
    cube, low, axis_ = cube[first], low[first], axis[first]
    a, b = corners[cube, low], corners[cube, low | 1 << axis_]
    t = np.clip(np.where(np.abs(b - a) < 1e-20, 0.5, -a / np.where(b == a, 1.0, b - a)), 0, 1)
    ends = colours[cube, low], colours[cube, low | 1 << axis_]
    return group[cube], number[first], at[first], axis_, t, ends[0] + t[:, None] * (ends[1] - ends[0]), *triangles


def iso_surface(voxels: DataFrame, by: list[str], iso: float = 0.0, colours: tuple[str, ...] = (), brick: int = 32, places: bool = False) -> tuple[DataFrame, DataFrame]:
    """Where the sampled field crosses iso: vertices (by, v, vx, vy, vz, axis, x, y, z, colours) and triangles (by, v0, v1, v2).

    With places, triangles have their corners' coordinates as well: x0, y0, z0 to x2, y2, z2.

    voxels has by, vx, vy, vz, value and the columns colours; a sample that is absent or null was not observed, and only cubes with
    all eight corners make a surface; of repeated samples the greatest counts. Triangles turn toward growing values. Coordinates are
    in steps of the lattice. A vertex's colours are those of its edge's ends, in proportion.

    Samples are dealt out by bricks of the lattice, those on a brick's lower sides to the bricks below as well: about
    (1 + 1 / brick) ** 3 rows a sample, and a task cuts small bricks many at once: ROWS samples, or one brick. A face's four
    values alone decide how it is cut where that is open, so bricks agree.
    """

    def bricks(k: str):
        own = F.floor(c(k) / brick)
        return F.explode(F.when(F.pmod(c(k), F.lit(brick)) == 0, F.array(own, own - 1)).otherwise(F.array(own)))

    rows = voxels.select(*by, *[c(f"v{a}").cast("long").alias(f"v{a}") for a in "xyz"], (c("value") - iso).alias("_value"), *[c(k).cast("double").alias(f"_c_{k}") for k in colours])
    rows = rows.filter(c("_value").isNotNull() & ~F.isnan("_value"))
    for a in "xyz":
        rows = rows.withColumn(f"_b{a}", bricks(f"v{a}"))
    by = [f.name for f in voxels.schema if f.name in by]
    spots = [f"{a}{k}" for k in range(3) for a in "xyz"] * places
    names = [*[f"v{i}" for i in range(3)], "vx", "vy", "vz", "axis", "t", *[f"_c_{k}" for k in colours], *spots]
    keys, sample = [*by, "_bx", "_by", "_bz"], ["vx", "vy", "vz"]
    steps = np.array([(k & 1) * (brick + 1) ** 2 + (k >> 1 & 1) * (brick + 1) + (k >> 2) for k in range(8)])

    def starts(table: pa.Table) -> np.ndarray:
        """Where bricks begin in rows that are in order."""
        new = np.arange(table.num_rows) == 0
        for k in keys:
            own = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(new)

    def cut(table: pa.Table) -> pa.Table:
        first = starts(table)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        at = np.stack([table[a].to_numpy() for a in sample], 1)
        own = at - np.stack([table[f"_b{a}"].to_numpy() for a in "xyz"], 1) * brick
        code = ((group * (brick + 1) + own[:, 0]) * (brick + 1) + own[:, 1]) * (brick + 1) + own[:, 2]
        last = np.flatnonzero(np.append(code[1:] != code[:-1], True))  # of repeated samples the greatest
        code, value = code[last], table["_value"].to_numpy()[last]
        low = np.flatnonzero((own[last] < brick).all(1))
        met = np.zeros((len(low), 8), "int64")
        met[:, 0] = low
        for k in range(1, 8):
            place = np.minimum(np.searchsorted(code, code[met[:, 0]] + steps[k]), len(code) - 1)
            met[:, k] = place
            met = met[code[place] == code[met[:, 0]] + steps[k]]  # only cubes with all their corners
        corners = value[met]
        met = met[(corners.min(1) < 0) & (corners.max(1) >= 0)] if len(met) else met
        if not len(met):
            return out_schema.empty_table()
        tint = np.stack([np.nan_to_num(table[f"_c_{k}"].to_numpy().astype("float64"))[last] for k in colours], 1) if colours else np.zeros((len(last), 0))
        base = last[met[:, 0]]
        of, number, edge, axis, t, shade, of_triangle, triangles = _cut(value[met], tint[met], at[base], group[base])
        none, n = np.full(len(number), -1), len(triangles)
        spot = edge + t[:, None] * (axis[:, None] == np.arange(3))
        kinds = [
            [number, none, none, *edge.T, axis, t, *shade.T, *[np.zeros(len(number))] * len(spots)],
            [*number[triangles].T, *[np.zeros(n, "int64")] * 3, np.full(n, -1), *[np.zeros(n)] * (1 + len(colours)), *(spot[triangles].reshape(n, 9).T if places else ())],
        ]
        picked = pa.array(first[np.concatenate([of, of_triangle])])
        columns = [table[k].combine_chunks().take(picked) for k in by] + [pa.array(np.concatenate(x)) for x in zip(*kinds)]
        return pa.table(columns, names=out_schema.names).cast(out_schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                table = pa.Table.from_batches(held)
                whole = int(starts(table)[-1])
                if whole:
                    yield from cut(table.slice(0, whole)).to_batches()
                held, size = table.slice(whole).to_batches(), table.num_rows - whole
                most = max(ROWS, 2 * size)
        if size:
            yield from cut(pa.Table.from_batches(held)).to_batches()

    double = lambda k: k == "t" or k.startswith("_c_") or k in spots
    types = [f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema if f.name in by]
    types += [f"{k} {'double' if double(k) else 'int' if k == 'axis' else 'long'}" for k in names]
    kinds_of = to_arrow_schema(voxels.select(*by).schema)
    out_schema = pa.schema([*kinds_of, *[pa.field(k, pa.float64() if double(k) else pa.int32() if k == "axis" else pa.int64()) for k in names]])
    rows = rows.select(*keys, *sample, "_value", *[f"_c_{k}" for k in colours])
    cutting = rows.repartition(*keys).sortWithinPartitions(*keys, *sample, "_value").mapInArrow(pieces, ", ".join(types))
    # Only vertices between bricks come more than once.
    vertices = cutting.filter("axis >= 0").withColumnRenamed("v0", "v").dropDuplicates([*by, "v"])
    along = [(c(f"v{a}") + F.when(c("axis") == i, c("t")).otherwise(0.0)).alias(a) for i, a in enumerate("xyz")]
    vertices = vertices.select(*by, "v", "vx", "vy", "vz", "axis", *along, *[c(f"_c_{k}").alias(k) for k in colours])
    return vertices, cutting.filter("axis < 0").select(*by, "v0", "v1", "v2", *spots)


# Alignment ------------------------------------------------------------------------------------------------------
# The widest log-scale, the largest turn in degrees with a change of scale, and the gates of the result.
LOG_SCALE, TURN, CHANGE, FAR, SPREAD = 1.2, 90.0, 0.15, 4.0, 0.3


def align_cloud(source: DataFrame, reference: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per group the similarity that lays source over reference, by pairs of equal place in their orders: by, n, scale, r00..r22, tx, ty, tz, degrees, accepted.

    All points take part: each of the larger cloud once, paired with the point of the other whose place is the same share of its
    size. The scale is held within e to the plus or minus 1.2. It is not accepted with fewer than eight points on a side, with
    a turn of over 90 degrees and a change of scale, or if the moved cloud then lies far off or has another spread.
    """
    clouds = {"l": source, "q": reference}
    counts = [cloud.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{side}")) for side, cloud in clouds.items()]
    sizes = stored(counts[0].join(counts[1], by), "cloud-sizes")
    placed = []
    for (side, cloud), other in zip(clouds.items(), "ql"):
        places = ranked(cloud.select(*by, *order, *"xyz"), by, order, "__i").select(*by, c("__i").cast("long").alias("__i"), salt_of(*order).alias("salt"), *[c(k).cast("double").alias(f"{side}{k}") for k in "xyz"])
        k = F.when(c(f"n_{side}") > c(f"n_{other}"), F.expr(f"__i * n_{other} div n_{side}")).otherwise(c("__i"))
        placed.append(with_groups(places, sizes, by).withColumn("k", k).select(*by, "k", *[f"{side}{a}" for a in "xyz"]))
    pairs = stored(placed[0].join(placed[1], [*by, "k"]), "paired-points")
    fit = fit_sim3(pairs, by).join(sizes, by)
    means = pairs.groupBy(*by).agg(*[F.avg(f"l{k}").alias(f"ml{k}") for k in "xyz"])
    held = F.greatest(F.lit(math.exp(-LOG_SCALE)), F.least(F.lit(math.exp(LOG_SCALE)), c("scale")))
    fit = fit.join(means, by).withColumn("held", held)
    # The translation belongs to the scale: what was held back moves the centre of the source.
    shift = {f"t{a}": c(f"t{a}") + (c("scale") - c("held")) * sum((c(f"r{i}{j}") * c(f"ml{k}") for j, k in enumerate("xyz")), F.lit(0.0)) for i, a in enumerate("xyz")}
    fit = fit.withColumns(shift).withColumn("scale", c("held"))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (c("r00") + c("r11") + c("r22") - 1) / 2))))
    fit = fit.withColumn("degrees", turn).drop("held", *[f"ml{k}" for k in "xyz"])
    before = cloud_stats(source.select(*by, *"xyz"), by).select(*by, *[c(f"m{k}").alias(f"s{k}") for k in "xyz"], c("rms").alias("s_rms"))
    after = cloud_stats(reference.select(*by, *"xyz"), by).select(*by, *[c(f"m{k}").alias(f"g{k}") for k in "xyz"], c("rms").alias("g_rms"))
    fit = fit.join(before, by, "left").join(after, by, "left")
    # A similarity moves the centre as any point and multiplies the radius, so the moved cloud isn't made.
    moved = [c("scale") * sum((c(f"r{i}{j}") * c(f"s{k}") for j, k in enumerate("xyz")), F.lit(0.0)) + c(f"t{a}") for i, a in enumerate("xyz")]
    off = F.sqrt(sum(((m - c(f"g{k}")) * (m - c(f"g{k}")) for m, k in zip(moved, "xyz")), F.lit(0.0)))
    radius = c("scale") * c("s_rms")
    near = (radius >= 1e-5) & (c("g_rms") >= 1e-5) & (off < FAR * c("g_rms")) & (F.abs(F.log(radius / c("g_rms"))) < LOG_SCALE + SPREAD)
    wild = (c("degrees") > TURN) & (F.abs(F.log("scale")) > CHANGE)
    ok = (c("n_l") >= 8) & (c("n_q") >= 8) & ~wild & near
    return fit.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("n_l", "n_q", *[f"{p}{k}" for p in "sg" for k in "xyz"], "s_rms", "g_rms")
