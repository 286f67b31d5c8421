"""Rays over a grid: horizons, shadows, lines of sight.

Cells are packed into square tiles.  A ray is never a row: every target tile meets, one after
another, the tiles that its rays cross, nearest first, and numpy takes one ray step for all cells of
the pair at once, as a shifted slice.  A task holds one target and one source tile, so neither the reach
nor the grid is bounded by memory; a target's sources are found by the direction of the rays, so a
shadow moves a strip of tiles and not the whole grid.  Tiles carry the first row and column of their
neighbours, for samples between cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

#: Cells of a tile's side, at most.
TILE = 256
#: Metres after which a horizon ray ends.
MAX_DISTANCE = 10_000.0
#: Bytes of an Arrow batch: tiles must not pile up by thousands.
BATCH_BYTES = 16 << 20


def extent(cells: DataFrame) -> tuple[int, int, int, int]:
    """First and last row, first and last column; of no cells 0, -1, 0, -1."""
    r = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    return tuple(r) if r[0] is not None else (0, -1, 0, -1)


def steps_across(cells: DataFrame) -> int:
    """Whole steps after which a ray has left the grid, from whatever cell: 1.5 times its longer side."""
    r0, r1, c0, c1 = extent(cells)
    return math.ceil(1.5 * (max(r1 - r0, c1 - c0) + 1))


def _side(box: tuple[int, int, int, int]) -> int:
    longest = max(box[1] - box[0], box[3] - box[2]) + 1
    return max(8, min(TILE, longest))


def tiles(cells: DataFrame, side: int, z: str = "z") -> DataFrame:
    """ty, tx, z (doubles of side + 1 rows and columns; NaN: no data), own (one byte for each own cell: 1 where there is a row)."""

    def pack(pdf):
        import numpy as np
        import pandas as pd

        a, own = np.full((side + 1, side + 1), np.nan), np.zeros((side, side), np.uint8)
        r, c = pdf["__r"].to_numpy(), pdf["__c"].to_numpy()
        a[r, c] = pdf["__z"].to_numpy(float)
        inside = (r < side) & (c < side)
        own[r[inside], c[inside]] = 1
        return pd.DataFrame([(pdf["ty"].iloc[0], pdf["tx"].iloc[0], a.tobytes(), own.tobytes())], columns=["ty", "tx", "z", "own"])

    twice = lambda c: F.explode(F.sequence(F.lit(0), F.when(F.pmod(F.col(c), F.lit(side)) == 0, 1).otherwise(0)))
    rows = cells.select("row", "col", F.col(z).cast("double").alias("__z")).withColumn("__a", twice("row")).withColumn("__b", twice("col"))
    rows = rows.withColumn("ty", (F.floor(F.col("row") / side) - F.col("__a")).cast("int")).withColumn("tx", (F.floor(F.col("col") / side) - F.col("__b")).cast("int"))
    rows = rows.select("ty", "tx", "__z", (F.col("row") - F.col("ty") * side).cast("int").alias("__r"), (F.col("col") - F.col("tx") * side).cast("int").alias("__c"))
    return rows.groupBy("ty", "tx").applyInPandas(pack, "ty int, tx int, z binary, own binary")


def _visit(cells: DataFrame, z: str, side: int, sources, begin: Callable, add: Callable, finish: Callable, schema: str) -> DataFrame:
    """Runs begin(ty, tx, z, own), add(state, ty, tx, sy, sx, z) for every source tile, and finish(state) -> columns, for each tile.

    sources: a column of array<struct<dy, dx>> for each target, or a list of such offsets.  Nearest sources come first, in the
    order in which a ray crosses them; a source without cells comes as tile without data.
    """
    spark = cells.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    packed = tiles(cells, side, z)
    targets = packed.where(F.instr(F.hex("own"), "01") > 0)
    if isinstance(sources, list):
        spans = spark.createDataFrame([tuple(map(int, o)) for o in sources] or [(0, 0)], "dy int, dx int")
        pairs = targets.select("ty", "tx", "own").crossJoin(F.broadcast(spans))  # offsets within reach: as many as tiles beside a tile
    else:
        pairs = targets.select("ty", "tx", "own", F.explode(sources).alias("o")).select("ty", "tx", "own", "o.*")
    pairs = pairs.select("ty", "tx", F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("own")).alias("own"), (F.col("ty") + F.col("dy")).alias("sy"), (F.col("tx") + F.col("dx")).alias("sx"), (F.abs("dy") + F.abs("dx")).alias("far"))
    joined = pairs.join(packed.select(F.col("ty").alias("sy"), F.col("tx").alias("sx"), "z"), ["sy", "sx"], "left")
    ordered = joined.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "far", "sy", "sx").select("ty", "tx", "sy", "sx", "own", "z")

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        state = None
        blank = np.full((side + 1, side + 1), np.nan)
        for part in parts:
            for i in range(part.num_rows):
                ty, tx, sy, sx = (part.column(k)[i].as_py() for k in range(4))
                raw = part.column(5)[i]
                block = np.frombuffer(raw.as_buffer(), float).reshape(side + 1, side + 1) if raw.is_valid else blank
                if (ty, tx) == (sy, sx):
                    if state is not None:
                        yield pa.RecordBatch.from_pydict(finish(state))
                    state = begin(ty, tx, block, np.frombuffer(part.column(4)[i].as_buffer(), np.uint8).reshape(side, side) > 0)
                add(state, ty, tx, sy, sx, block)
        if state is not None:
            yield pa.RecordBatch.from_pydict(finish(state))

    return ordered.mapInArrow(run, schema)


def _offsets(shifts: list[tuple[int, int]], side: int) -> list[tuple[int, int]]:
    """Tile offsets that a tile's cells reach by the given shifts (rows, columns) of whole cells, its own first."""
    found = {(0, 0)}
    for r, c in shifts:
        y, x = r // side, c // side
        found |= {(a, b) for a in (y, y + (r % side > 0)) for b in (x, x + (c % side > 0))}
    return sorted(found)


def _overlap(shift: int, side: int) -> tuple[slice, slice]:
    """Target and source slices where source = target + shift lies within the source tile."""
    return slice(max(0, -shift), min(side, side - shift)), slice(max(0, shift), min(side, side + shift))


def _steps(dy: float, dx: float, reach: int) -> list[tuple[int, int]]:
    """Rows and columns of the nearest cell at each whole step along (dy, dx); halves go to the larger number."""
    return [(-math.ceil(k * dy - 0.5), math.floor(k * dx + 0.5)) for k in range(1, reach + 1)]


def horizon_arrays(cells: DataFrame, azimuths: list[float], size: float = 1.0, reach: int | None = None, radius: float | None = None, z: str = "z") -> DataFrame:
    """row, col, heights: array of the largest elevation angle (degrees, at least 0) along each azimuth, null where a cell has no data.

    Azimuths count counter-clockwise from east.  With a body radius, a cell at distance d drops by d^2 / (2 radius).
    Without a reach, rays end at the edge of the grid or after MAX_DISTANCE.  Cells without data don't block.
    """
    box = extent(cells)
    side = _side(box)
    reach = reach or min(math.ceil(1.5 * (max(box[1] - box[0], box[3] - box[2]) + 1)), max(1, int(MAX_DISTANCE / size)))
    reach = min(reach, box[1] - box[0] + box[3] - box[2] + 2)
    rays = [_steps(math.sin(math.radians(a)), math.cos(math.radians(a)), reach) for a in azimuths]
    drops = [(k * size) ** 2 / (2 * radius) if radius else 0.0 for k in range(1, reach + 1)]
    n = len(azimuths)

    def begin(ty, tx, block, own):
        import numpy as np

        z0 = block[:side, :side]
        return {"at": (ty, tx), "own": own, "z0": np.where(np.isnan(z0), np.inf, z0), "best": np.zeros((n, side, side)), "low": np.zeros(n)}

    def add(s, ty, tx, sy, sx, block):
        import numpy as np

        src = np.where(np.isnan(block[:side, :side]), -np.inf, block[:side, :side])
        oy, ox, top, floor = (ty - sy) * side, (tx - sx) * side, src.max(), s["z0"].min()
        if top == -np.inf:
            return
        for a, ray in enumerate(rays):
            best, touched = s["best"][a], False
            for k, (r, c) in enumerate(ray, 1):
                y, x, d = oy + r, ox + c, k * size
                # a tile too low for every cell of the target is skipped
                if abs(y) >= side or abs(x) >= side or (top - floor - drops[k - 1]) / d <= s["low"][a]:
                    continue
                (ta, sa), (tb, sb) = _overlap(y, side), _overlap(x, side)
                rise = src[sa, sb] - s["z0"][ta, tb]
                if drops[k - 1]:
                    rise -= drops[k - 1]
                rise /= d
                np.maximum(best[ta, tb], rise, out=best[ta, tb])
                touched = True
            if touched:
                s["low"][a] = best[s["own"]].min(initial=np.inf)

    def finish(s):
        import numpy as np
        import pyarrow as pa

        r, c = np.nonzero(s["own"])
        some = np.isfinite(s["z0"][r, c])
        angles = np.degrees(np.arctan(s["best"][:, r, c].T)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(r) + 1, n, dtype=np.int32)), pa.array(angles), mask=pa.array(~some))
        return {"row": pa.array((r + s["at"][0] * side).astype(np.int32)), "col": pa.array((c + s["at"][1] * side).astype(np.int32)), "heights": lists}

    offsets = _offsets([shift for ray in rays for shift in ray], side)
    return _visit(cells, z, side, offsets, begin, add, finish, "row int, col int, heights array<double>")


def horizon(cells: DataFrame, azimuths: list[float], size: float = 1.0, reach: int | None = None, radius: float | None = None, z: str = "z") -> DataFrame:
    """row, col, azimuth, height: horizon_arrays, one row for each azimuth; cells without data have null heights."""
    wide = horizon_arrays(cells, azimuths, size, reach, radius, z)
    at = F.array(*[F.lit(float(a)) for a in azimuths])
    none = F.array_repeat(F.lit(None).cast("double"), len(azimuths))
    return wide.select("row", "col", F.explode(F.arrays_zip(at.alias("azimuth"), F.coalesce("heights", none).alias("height"))).alias("h")).select("row", "col", "h.azimuth", "h.height")


def shadow(cells: DataFrame, azimuth: float, elevation: float, size: float = 1.0, reach: int | None = None, z: str = "z", pixels: bool = False) -> DataFrame:
    """row, col, lit: 0 where a cell within reach (without one: of the grid) along the sun's azimuth (clockwise from north) stands above the ray.

    pixels: the ray rises by tan(elevation) for each cell rather than each metre.  A sun at or below
    the horizon lights nothing.  A ray looks at nearest cells at whole steps; no data doesn't block and has no row.
    """
    if elevation <= 0:
        return cells.where(F.col(z).isNotNull()).select("row", "col", F.lit(0).alias("lit"))
    box = extent(cells)
    side = _side(box)
    reach = min(reach or math.ceil(1.5 * (max(box[1] - box[0], box[3] - box[2]) + 1)), box[1] - box[0] + box[3] - box[2] + 2)
    a = math.radians(azimuth)
    ray = _steps(math.cos(a), math.sin(a), reach)
    rise = math.tan(math.radians(elevation)) * (1 if pixels else size)

    def begin(ty, tx, block, own):
        import numpy as np

        z0 = block[:side, :side]
        return {"at": (ty, tx), "own": own & ~np.isnan(z0), "z0": np.where(np.isnan(z0), np.inf, z0), "dark": np.zeros((side, side), bool)}

    def add(s, ty, tx, sy, sx, block):
        import numpy as np

        src = np.where(np.isnan(block[:side, :side]), -np.inf, block[:side, :side])
        oy, ox, top, floor = (ty - sy) * side, (tx - sx) * side, src.max(), s["z0"].min()
        for k, (r, c) in enumerate(ray, 1):
            y, x = oy + r, ox + c
            if abs(y) < side and abs(x) < side and top > floor + rise * k:
                (ta, sa), (tb, sb) = _overlap(y, side), _overlap(x, side)
                s["dark"][ta, tb] |= src[sa, sb] > s["z0"][ta, tb] + rise * k

    def finish(s):
        import numpy as np

        r, c = np.nonzero(s["own"])
        return {"row": (r + s["at"][0] * side).astype(np.int32), "col": (c + s["at"][1] * side).astype(np.int32), "lit": (~s["dark"][r, c]).astype(np.int32)}

    return _visit(cells, z, side, _offsets(ray, side), begin, add, finish, "row int, col int, lit int")


def sun_mask(cells: DataFrame, azimuth: float, elevation: float, ns_res: float = 1.0, ew_res: float = 1.0, z: str = "z") -> DataFrame:
    """row, col, mask: 1 lit, 0 in shadow, 255 no data.  The sun's azimuth is clockwise from north.

    A ray takes half-cell steps, samples bilinearly (edge cells repeat), and ends at the edge of the grid or at the
    first sample that touches a cell without data or without a row.  Its length counts metres by both cell sizes.
    """
    box = extent(cells)
    if elevation <= 0 or box[1] < box[0]:
        return cells.select("row", "col", F.when(F.col(z).isNull(), 255).otherwise(0).alias("mask"))
    side = _side(box)
    a = math.radians(azimuth)
    dc, dr = math.sin(a), -math.cos(a)
    metres = math.hypot(dr * ns_res, dc * ew_res) or (ns_res + ew_res) / 2
    tan = math.tan(math.radians(elevation))
    (first_r, last_r, first_c, last_c), most = box, (box[1] - box[0] + box[3] - box[2] + 2) * 2.0
    steps = [0.5 * k for k in range(1, int(most / 0.5) + 1) if 0.5 * k * max(abs(dr), abs(dc)) <= max(box[1] - box[0], box[3] - box[2]) + 1]

    def begin(ty, tx, block, own):
        import numpy as np

        z0 = block[:side, :side].copy()
        return {"at": (ty, tx), "own": own, "z0": z0, "on": ~np.isnan(z0), "dark": np.zeros((side, side), bool)}

    def add(s, ty, tx, sy, sx, block):
        import numpy as np

        src = block.copy()
        if 0 <= last_r - sy * side < side:  # the last row and column stand in for what lies beyond
            src[last_r - sy * side + 1] = src[last_r - sy * side]
        if 0 <= last_c - sx * side < side:
            src[:, last_c - sx * side + 1] = src[:, last_c - sx * side]
        row, col = np.arange(side) + ty * side - first_r, np.arange(side) + tx * side - first_c
        holes, top, floor = bool(np.isnan(src[: max(0, last_r - sy * side + 1), : max(0, last_c - sx * side + 1)]).any()), np.nanmax(src, initial=-np.inf), np.nanmin(s["z0"], initial=np.inf)
        for d in steps:
            if not holes and top <= floor + d * metres * tan:
                continue  # neither stops a ray nor darkens a cell
            rc, cc = row + d * dr, col + d * dc
            r0, c0 = np.floor(rc).astype(int), np.floor(cc).astype(int)
            y, x = r0 + first_r - sy * side, c0 + first_c - sx * side
            # own cells whose sample lies in this tile
            here_r, here_c = np.flatnonzero((y >= 0) & (y < side)), np.flatnonzero((x >= 0) & (x < side))
            if not len(here_r) or not len(here_c):
                continue
            ta, tb = slice(here_r[0], here_r[-1] + 1), slice(here_c[0], here_c[-1] + 1)
            y, x, fr, fc = y[ta], x[tb], (rc - r0)[ta, None], (cc - c0)[None, tb]
            if y[-1] - y[0] == len(y) - 1 and x[-1] - x[0] == len(x) - 1:
                pick = lambda i, j: src[y[0] + i : y[-1] + i + 1, x[0] + j : x[-1] + j + 1]
            else:  # rounding moved a line
                pick = lambda i, j: src[np.ix_(y + i, x + j)]
            h = (1 - fr) * (1 - fc) * pick(0, 0) + (1 - fr) * fc * pick(0, 1) + fr * (1 - fc) * pick(1, 0) + fr * fc * pick(1, 1)
            beyond = (rc[ta, None] < 0) | (rc[ta, None] >= last_r - first_r + 1) | (cc[None, tb] < 0) | (cc[None, tb] >= last_c - first_c + 1)
            on = s["on"][ta, tb]
            on &= ~(beyond | np.isnan(h))
            hit = on & (h > s["z0"][ta, tb] + d * metres * tan)
            s["dark"][ta, tb] |= hit
            on &= ~hit

    def finish(s):
        import numpy as np

        r, c = np.nonzero(s["own"])
        value = np.where(np.isnan(s["z0"][r, c]), 255, np.where(s["dark"][r, c], 0, 1))
        return {"row": (r + s["at"][0] * side).astype(np.int32), "col": (c + s["at"][1] * side).astype(np.int32), "mask": value.astype(np.int32)}

    shifts = [(math.floor(d * dr) + e, math.floor(d * dc) + f) for d in steps for e in (0, 1) for f in (0, 1)]
    return _visit(cells, z, side, _offsets(shifts, side), begin, add, finish, "row int, col int, mask int")


def viewshed(cells: DataFrame, row: int, col: int, height: float = 0.0, size: float = 1.0, z: str = "z") -> DataFrame:
    """row, col, visible: 1 where no nearest cell between the observer and the cell rises above the line between them.

    Each target tile meets the tiles between it and the observer.  Cells without data don't block and have no row; an
    observer on such a cell sees all.
    """
    box = extent(cells)
    side = _side(box)
    eye = cells.where((F.col("row") == row) & (F.col("col") == col)).select(F.col(z).cast("double")).first()
    eye = float(eye[0]) + height if eye is not None and eye[0] is not None else math.inf
    oy, ox = row // side, col // side

    @F.pandas_udf("array<struct<dy:int,dx:int>>")
    def between(ty, tx):
        """Offsets of the tiles that touch the hull of the observer and a tile (its own first)."""
        import numpy as np
        import pandas as pd

        out = []
        for y, x in zip(ty.tolist(), tx.tolist()):
            gy, gx = (g.ravel() for g in np.mgrid[min(y, oy) : max(y, oy) + 1, min(x, ox) : max(x, ox) + 1])
            corner = np.array([(y * side + i, x * side + j) for i in (0, side) for j in (0, side)], float)
            hull = np.vstack([corner, [[row, col]]])
            keep = np.ones(len(gy), bool)
            for q in corner - [row, col]:
                normal = np.array([-q[1], q[0]])
                own = hull @ normal
                square = np.stack([((gy + i) * side + (2 * i - 1)) * normal[0] + ((gx + j) * side + (2 * j - 1)) * normal[1] for i in (0, 1) for j in (0, 1)])
                keep &= (square.max(0) >= own.min()) & (square.min(0) <= own.max())
            keep[(gy == y) & (gx == x)] = True
            out.append([{"dy": int(a - y), "dx": int(b - x)} for a, b in zip(gy[keep], gx[keep])])
        return pd.Series(out)

    def begin(ty, tx, block, own):
        import numpy as np

        z0 = block[:side, :side]
        r, c = np.nonzero(own & ~np.isnan(z0))
        down, right = r + ty * side - row, c + tx * side - col
        return {"row": r + ty * side, "col": c + tx * side, "down": down, "right": right, "n": np.maximum(abs(down), abs(right)), "z0": z0[r, c], "seen": np.ones(len(r), bool)}

    def add(s, ty, tx, sy, sx, block):
        import numpy as np

        # a line moves one cell a step along its longer side, so its step number is its distance
        near = max(sy * side - row, row - (sy + 1) * side + 1, sx * side - col, col - (sx + 1) * side + 1, 1)
        far = max(abs(sy * side - row), abs((sy + 1) * side - row), abs(sx * side - col), abs((sx + 1) * side - col)) + 1
        for k in range(max(1, near - 1), min(far, int(s["n"].max(initial=0)) - 1) + 1):
            i = np.flatnonzero(s["seen"] & (s["n"] > k))
            if not len(i):
                continue
            part = k / s["n"][i]
            r, c = np.floor(row + s["down"][i] * part + 0.5).astype(int) - sy * side, np.floor(col + s["right"][i] * part + 0.5).astype(int) - sx * side
            here = (r >= 0) & (r < side) & (c >= 0) & (c < side)
            i, r, c, part = i[here], r[here], c[here], part[here]
            with np.errstate(invalid="ignore"):
                s["seen"][i[block[r, c] > eye + (s["z0"][i] - eye) * part]] = False

    def finish(s):
        import numpy as np

        return {"row": s["row"].astype(np.int32), "col": s["col"].astype(np.int32), "visible": s["seen"].astype(np.int32)}

    return _visit(cells, z, side, between("ty", "tx"), begin, add, finish, "row int, col int, visible int")


def any_visible(sheds: DataFrame) -> DataFrame:
    """row, col, visible over the viewsheds of many observers."""
    return sheds.groupBy("row", "col").agg(F.max("visible").alias("visible"))


def largest_horizon(horizons: DataFrame) -> DataFrame:
    return horizons.groupBy("row", "col").agg(F.max("height").alias("height"))


def _wide(horizons: DataFrame) -> DataFrame:
    """row, col, heights by rising azimuth."""
    if "heights" in horizons.columns:
        return horizons.select("row", "col", "heights")
    turn = F.array_sort(F.collect_list(F.struct("azimuth", "height")))
    return horizons.where(F.col("height").isNotNull()).groupBy("row", "col").agg(F.transform(turn, lambda h: h["height"]).alias("heights"))


def _above(horizons: DataFrame, track: list[tuple[float, float]], columns: Callable, schema: str, offset: float = 0.0, clockwise: bool = False) -> DataFrame:
    """columns(lit, heights) of cells, for what stands at (azimuth, elevation) of each step; lit(step) says where it is above the horizon.

    The horizon between two azimuths is interpolated linearly.
    """
    horizons.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in parts:
            lists = part.column(2)
            n = len(lists[0].as_py()) if part.num_rows else 1
            h = lists.flatten().to_numpy().reshape(-1, n)

            def lit(step: int):
                azimuth, elevation = track[step]
                azimuth = ((90.0 - azimuth) if clockwise else azimuth) % 360.0
                k = int(azimuth // (360.0 / n))
                w = azimuth / (360.0 / n) - k
                return elevation > h[:, k % n] * (1 - w) + h[:, (k + 1) % n] * w + offset

            yield pa.RecordBatch.from_pydict({"row": part.column(0), "col": part.column(1), **columns(lit, len(h))})

    return _wide(horizons).where(F.col("heights").isNotNull()).mapInArrow(run, f"row int, col int, {schema}")


def illumination(cells: DataFrame, horizons: DataFrame, sun: DataFrame, least: float = 0.0, grazing: float = 5.0) -> DataFrame:
    """row, col, fraction, variability, psr, grazing: over the steps of sun (step, azimuth, elevation) above least.

    horizons: of horizon() or horizon_arrays(), at azimuths evenly around the circle from 0.  Every cell has one row and goes once over
    the steps; cells without data have no row, and without a step above least nothing has.
    """
    track = [(float(r["azimuth"]), float(r["elevation"])) for r in sun.where(F.col("elevation") > least).orderBy("step").collect()]  # a setting: one row a step
    if not track:
        return cells.limit(0).select("row", "col", F.lit(0.0).alias("fraction"), F.lit(0.0).alias("variability"), F.lit(0).alias("psr"), F.lit(0.0).alias("grazing"))

    def columns(lit, n):
        import numpy as np

        up, low = np.zeros(n), np.zeros(n)
        for k, (_, elevation) in enumerate(track):
            now = lit(k)
            up += now
            if elevation < grazing:
                low += now
        share = up / len(track)
        return {"fraction": share, "variability": np.sqrt(np.maximum(0.0, share - share * share)), "psr": (up == 0).astype(np.int32), "grazing": low}

    return _above(horizons, track, columns, "fraction double, variability double, psr int, grazing double")


def visibility(horizons: DataFrame, track: DataFrame, min_elevation: float = 0.0, least: float = -10.0, threshold: float = 0.5) -> DataFrame:
    """row, col, fraction, mask: how often a body (or relay) at (step, azimuth clockwise from north, elevation) clears the horizon.

    Steps below least are left out; a step counts where the elevation exceeds the horizon by more than min_elevation.  mask is
    1 where the fraction is threshold or more.  Without a step left fractions are 0.
    """
    steps = [(float(r["azimuth"]), float(r["elevation"])) for r in track.where(F.col("elevation") >= least).orderBy("step").collect()]

    def columns(lit, n):
        import numpy as np

        up = np.zeros(n)
        for k in range(len(steps)):
            up += lit(k)
        share = up / max(1, len(steps))
        return {"fraction": share, "mask": (share >= threshold).astype(np.int32)}

    return _above(horizons, steps, columns, "fraction double, mask int", min_elevation, clockwise=True)


def elevation_azimuth(lat: float, lon: float, body_lat, body_lon) -> tuple:
    """Elevation and azimuth (degrees, clockwise from north), at a surface point, of what is overhead at (body_lat, body_lon)."""
    la, lb, h = math.radians(lat), F.radians(body_lat), F.radians(body_lon - lon)
    elevation = F.degrees(F.asin(math.sin(la) * F.sin(lb) + math.cos(la) * F.cos(lb) * F.cos(h)))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(h) * F.cos(lb), math.cos(la) * F.sin(lb) - math.sin(la) * F.cos(lb) * F.cos(h))), F.lit(360.0))
    return elevation, azimuth
