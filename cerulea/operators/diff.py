"""What changed between two scans: detections matched one to one by their distance."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cerulea.functions.geo import METRES_PER_DEGREE
from cerulea.sinks.shared import stored

#: Fixed value: metres between centres below which two detections are one.
NEAR = 5.0
#: Side of a block in units of the distance, rows that a task takes up at once (whole blocks, so one at least), and pairs that it forms at once.
BLOCK, ROWS, PAIRS = 12, 50_000, 1 << 20
#: The distance is met ring by ring, so that few pairs are held; no ring is narrower than this part of it.
FINEST = 4096
#: Kinds of rows that a block hands on: a pair inside it, a pair across its border, and what it cannot decide of either scan.
INSIDE, ACROSS, OPEN_A, OPEN_B = range(4)


def dealt(points: DataFrame, metres: float, shift: float) -> DataFrame:
    """``points`` with the block they lie in and with those whose border is less than two distances away. x and y are metres from the block's corner; x is taken at the
    block's end farther from the equator, so it is never more than the true distance. ``shift`` moves the blocks by a part of their side."""
    side, halo = BLOCK * metres, 2 * metres + 0.01
    reach = lambda at: F.sequence(*[F.floor((at + d) / side + shift).cast("long") for d in (-halo, halo)])
    rows = points.withColumn("north", F.col("lat") * METRES_PER_DEGREE).withColumn("row", F.explode(reach(F.col("north"))))
    far = F.greatest(F.abs((F.col("row") - shift) * side - halo), F.abs((F.col("row") + 1 - shift) * side + halo)) / METRES_PER_DEGREE
    rows = rows.withColumn("east", F.col("lon") * METRES_PER_DEGREE * F.cos(F.radians(F.least(far, F.lit(90.0)))))
    rows = rows.withColumn("column", F.explode(reach(F.col("east"))))
    place = [(F.col(at) - (F.col(cell) - shift) * side).alias(n) for at, cell, n in (("east", "column", "x"), ("north", "row", "y"))]
    return rows.select("row", "column", "a", "b", "lon", "lat", *place)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of rows that come block by block."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= ROWS:
            row, column = batch["row"].to_numpy(), batch["column"].to_numpy()
            starts = np.flatnonzero((row != np.append(key[0], row[:-1])) | (column != np.append(key[1], column[:-1])))
            if len(starts):
                yield pa.Table.from_batches([*held, batch.slice(0, starts[0])])
                held, batch = [], batch.slice(starts[0])
        held.append(batch)
        key = batch["row"][-1].as_py(), batch["column"][-1].as_py()
    if held:
        yield pa.Table.from_batches(held)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to below its high, and which of the ranges each is from."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of], of


class _Places:
    """The detections of one scan in some blocks by place: those at one place are met together, the smallest name first."""

    def __init__(self, tile: pa.Table, name: str, metres: float) -> None:
        rows = np.flatnonzero(tile[name].is_valid().to_numpy())
        rank = pc.rank(tile[name].take(pa.array(rows)), tiebreaker="first").to_numpy()
        place = [tile[c].to_numpy()[rows] for c in ("row", "column", "lon", "lat", "x", "y")]
        order = np.lexsort((rank, *place[3::-1]))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in place[:4]])
        at = np.flatnonzero(new)
        self.row, self.column, self.lon, self.lat, self.x, self.y = (c[order][at] for c in place)
        self.rows, self.rank, self.of = rows[order], rank[order].tolist(), np.cumsum(new) - 1
        self.next, self.end = at.tolist(), np.append(at[1:], len(order)).tolist() if len(at) else []
        side = BLOCK * metres
        outside = lambda d: (np.minimum(self.x, self.y) < -d) | (np.maximum(self.x, self.y) >= side + d)
        self.core, self.unknown = ~outside(0), outside(metres + 0.001).tolist()  # unknown: a nearer partner may not be seen here, or may be taken

    def left(self) -> np.ndarray:
        return np.array(self.next, np.int64) < np.array(self.end, np.int64)

    def open(self) -> np.ndarray:
        """Rows of the table that lie in their block and cannot be decided in it."""
        unknown = np.array(self.unknown, bool) & self.core
        return self.rows[unknown[self.of] & (np.arange(len(self.of)) >= np.array(self.next, np.int64)[self.of])]


def _cells(p: _Places, block: np.ndarray, size: float, wide: int) -> np.ndarray:
    """A number for each place by block, line and column of cells of a size; cells beside each other in a line have successive numbers."""
    line, column = (np.floor(v / size).astype(np.int64) + wide // 2 for v in (p.y, p.x))
    return (block * wide + line) * wide + column


def _near(a: _Places, b: _Places, blocks: tuple[np.ndarray, np.ndarray], low: float, size: float, metres: float) -> tuple[np.ndarray, ...] | None:
    """(micrometres, place of a, place of b), sorted: pairs from ``low`` to below ``size`` metres, one of them known at least. None if they are too many and a smaller
    ``size`` would do; pairs are formed in slices, so only those within the bounds are held."""
    wide, left = 2 * int((BLOCK + 4) * metres / size + 4), [np.flatnonzero(p.left()) for p in (a, b)]
    cells = [_cells(p, block, size, wide)[held] for p, block, held in zip((a, b), blocks, left, strict=True)]
    unknown = [np.array(p.unknown, bool) for p in (a, b)]
    order = np.argsort(cells[1], kind="stable")
    there, bounds, found, kept = cells[1][order], [round(v * 1e6) for v in (low, size)], [], 0
    spans = [(np.searchsorted(there, cells[0] + d * wide - 1), np.searchsorted(there, cells[0] + d * wide + 1, "right")) for d in (-1, 0, 1)]
    if sum(int((high - first).sum()) for first, high in spans) > PAIRS and size > max(2 * low, metres / FINEST):
        return None
    for first, high in spans:
        part = np.cumsum(high - first) // PAIRS
        for k in np.unique(part):
            chosen = np.flatnonzero(part == k)
            at, of = _ranges(first[chosen], high[chosen])
            i, j = left[0][chosen[of]], left[1][order[at]]
            known = ~(unknown[0][i] & unknown[1][j])
            i, j = i[known], j[known]
            across = (b.lon[j] - a.lon[i]) * METRES_PER_DEGREE * np.cos(np.radians((a.lat[i] + b.lat[j]) / 2))
            up = (b.lat[j] - a.lat[i]) * METRES_PER_DEGREE
            micro = np.rint(np.sqrt(across * across + up * up) * 1e6).astype(np.int64)  # to the micrometre, so that ties are ties
            within = (micro >= bounds[0]) & (micro < bounds[1])
            found.append((micro[within], i[within], j[within]))
            kept += len(found[-1][0])
            if kept > PAIRS and size > low + metres / FINEST:
                return None
    micro, i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(micro, kind="stable")
    return micro[order], i[order], j[order]


def _take(a: _Places, b: _Places, ia: list, ib: list) -> list[tuple[int, int]]:
    """Matches among pairs of places of one distance, by names: the smallest of ``a`` with its smallest partner. What meets the unknown becomes unknown."""
    partners, out = {}, []
    for i, j in zip(ia, ib, strict=True):
        if a.next[i] < a.end[i] and b.next[j] < b.end[j]:
            partners.setdefault(i, []).append(j)
    heap = [(a.rank[a.next[i]], i) for i in partners]
    heapify(heap)
    while heap:
        i = heap[0][1]
        left = [j for j in partners[i] if b.next[j] < b.end[j]]
        first = min(left, key=lambda j: b.rank[b.next[j]], default=None)
        if first is None or a.unknown[i] or b.unknown[first]:
            if left:
                a.unknown[i] = True
                for j in left:
                    b.unknown[j] = True
            heappop(heap)
            continue
        out.append((a.next[i], b.next[first]))
        a.next[i] += 1
        b.next[first] += 1
        if a.next[i] < a.end[i]:
            heapreplace(heap, (a.rank[a.next[i]], i))
        else:
            heappop(heap)
    return out


def _decided(tile: pa.Table, metres: float) -> pa.Table:
    """Pairs of whole blocks, nearest first, as far as what lies beyond the blocks cannot change them, and what is left open of their own detections."""
    a, b = (_Places(tile, name, metres) for name in "ab")
    keys = np.unique(np.concatenate([np.stack([p.row, p.column], 1) for p in (a, b)]), axis=0, return_inverse=True)[1].ravel()
    blocks, low, met = (keys[: len(a.row)], keys[len(a.row) :]), 0.0, []
    while low < metres:
        size = min(metres, 2 * low) if low else metres
        while (near := _near(a, b, blocks, low, size, metres)) is None:
            size = max(size * 0.7, low + metres / FINEST) if size > 2 * low else max((size + low) / 2, low + metres / FINEST)
        micro, (i, j) = near[0], (c.tolist() for c in near[1:])
        ends = [*(np.flatnonzero(np.diff(micro)) + 1).tolist(), len(micro)]
        for first, end in zip([0, *ends], ends):  # noqa: B905
            met += [(*rows, micro[first]) for rows in _take(a, b, i[first:end], j[first:end])]
        low = size
    at_a, at_b, micro = np.array(met, np.int64).reshape(-1, 3).T
    core = a.core[a.of[at_a]].astype(int) + b.core[b.of[at_b]]
    at_a, at_b, micro, core = (c[core > 0] for c in (at_a, at_b, micro, core))
    pairs = [np.where(core == 2, INSIDE, ACROSS), tile["a"].take(pa.array(a.rows[at_a])), tile["b"].take(pa.array(b.rows[at_b])), micro / 1e6]
    rows = np.concatenate([a.open(), b.open()])
    kinds = np.repeat([OPEN_A, OPEN_B], [len(a.open()), len(b.open())])
    names = ["kind", "a", "b", "metres", "lon", "lat"]
    left = tile.take(pa.array(rows))
    return pa.concat_tables([
        pa.table([pa.array(pairs[0], pa.int32()), *pairs[1:3], pa.array(pairs[3]), pa.nulls(len(core), pa.float64()), pa.nulls(len(core), pa.float64())], names=names),
        pa.table([pa.array(kinds, pa.int32()), left["a"], left["b"], pa.nulls(len(rows), pa.float64()), left["lon"], left["lat"]], names=names),
    ])


def matched(points: DataFrame, metres: float = NEAR) -> DataFrame:
    """(a, b, metres) of (a, b, lon, lat), detections of two scans with a name in a or in b: pairs under ``metres`` one to one, from the nearest on, ties to the smaller a,
    then b.

    All pairs are never formed at once, and none is shuffled or written that is not matched: blocks of ground are matched each by itself, with what lies around them. What
    depends on ground beyond is left open and matched anew in blocks that lie half a side farther. A round decides at least the nearest pair of each neighbourhood.
    """
    types = {c: t for c, t in points.dtypes}
    schema = f"kind int, a {types['a']}, b {types['b']}, metres double, lon double, lat double"
    finite = (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    left, found, shift = points.where(finite), None, 0.0

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _blocks(batches):
            yield from _decided(tile, metres).to_batches()

    while True:
        blocks = dealt(left, metres, shift).repartition("row", "column").sortWithinPartitions("row", "column")
        rows = stored(blocks.mapInArrow(decided, schema), "matched")
        across = rows.where(F.col("kind") == ACROSS).select("a", "b", "metres").distinct()  # the blocks on both sides may have it
        pairs = rows.where(F.col("kind") == INSIDE).select("a", "b", "metres").union(across)
        found = pairs if found is None else found.union(pairs)
        sides = [rows.where(F.col("kind") == kind).join(across.select(name), name, "left_anti").select("a", "b", "lon", "lat") for name, kind in (("a", OPEN_A), ("b", OPEN_B))]
        left, shift = stored(sides[0].union(sides[1]), "open"), 0.5 - shift
        if left.isEmpty():
            return found


def scan_diff(before: DataFrame, after: DataFrame, metres: float = NEAR, key: str = "cluster") -> DataFrame:
    """(op, before, after, metres): every detection of either scan once, as ``unchanged`` with its partner in the other, ``removed`` or ``added``.

    Both tables have a key that is unique and not null, lon and lat; rows without a place are matched with nothing. An empty scan makes all of the other added or removed.
    """
    names = [before.schema[key].dataType, after.schema[key].dataType]
    place = [F.col(c).cast("double").alias(c) for c in ("lon", "lat")]
    points = before.select(F.col(key).alias("a"), F.lit(None).cast(names[1]).alias("b"), *place).union(after.select(F.lit(None).cast(names[0]), F.col(key), *place))
    pairs = matched(points, metres)
    old = before.select(F.col(key).alias("a")).join(pairs, "a", "left").select(F.when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("op"), F.col("a").alias("before"), F.col("b").alias("after"), "metres")
    new = after.select(F.col(key).alias("b")).join(pairs.select("b"), "b", "left_anti")
    return old.union(new.select(F.lit("added"), F.lit(None).cast(names[0]), "b", F.lit(None).cast("double")))
