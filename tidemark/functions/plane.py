"""Nearest places on maps of two dimensions: the plane is cut in cells of a few thousand places, and a place looks only into the cells that its circle meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.learning import _matrix
from tidemark.sources.files import kept

#: Places of a cell, cells of a map at most, and places of a cell that tell where to cut (they decide where rows go, not results).
CELL, MOST, TOLD = 2048, 8192, 32
#: Distances that a task holds at once.
HELD = 1 << 18
#: A cell's number is its map's times this, plus its own.
STRIDE = 1 << 20


class Cells:
    """A plane cut in two again and again: the cell that a place is in, and the cells that a circle meets."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple] = []  # (axis, cut, low, high), or (number of the cell,)
        self.boxes: list[np.ndarray] = []
        self.cells = 0
        self._cut(sample, cells, np.array([[-np.inf, -np.inf], [np.inf, np.inf]]))

    def _cut(self, sample: np.ndarray, cells: int, box: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        self.boxes.append(box)
        spread = np.ptp(sample, axis=0) if len(sample) else np.zeros(2)
        if cells < 2 or not spread.max() > 0:
            self.nodes[at] = (self.cells,)
            self.cells += 1
            return at
        axis, less = int(spread.argmax()), cells // 2
        v = np.sort(sample[:, axis])
        cut = v[max(0, len(v) * less // cells - 1)]
        if cut == v[-1]:
            cut = v[v < cut][-1]
        low, high = box.copy(), box.copy()
        low[1, axis] = high[0, axis] = cut
        own = sample[:, axis] <= cut
        self.nodes[at] = (axis, cut, self._cut(sample[own], less, low), self._cut(sample[~own], cells - less, high))
        return at

    def of(self, p: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(p), np.int64), [(0, np.arange(len(p)))]
        while open_:
            at, own = open_.pop()
            node = self.nodes[at]
            if len(node) == 1:
                out[own] = node[0]
                continue
            low = p[own, node[0]] <= node[1]
            open_ += [(n, x) for n, x in ((node[2], own[low]), (node[3], own[~low])) if len(x)]
        return out

    def met(self, p: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell) of each cell that has a part within the reach, a squared distance; rounding never hides one, as it keeps the order of numbers."""
        out, open_ = [], [(0, np.arange(len(p)))]
        while open_:
            at, own = open_.pop()
            box = self.boxes[at]
            off = np.maximum(np.maximum(box[0] - p[own], p[own] - box[1]), 0)
            own = own[off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] <= reach[own]]
            if not len(own):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                out.append((own, np.full(len(own), node[0])))
            else:
                open_ += [(node[2], own), (node[3], own)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


class Known:
    """The places of a cell, each once, with the least of the ids that are there."""

    def __init__(self, p: np.ndarray, ids: pa.ListArray, most: int):
        self.values = ids.flatten()
        number = np.unique(self.values.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        self.p, self.place = np.unique(p + 0.0, axis=0, return_inverse=True)
        self.place = self.place.ravel()
        where = np.repeat(self.place, size)
        order = np.lexsort((number, where))
        first = np.searchsorted(where[order], np.arange(len(self.p)))
        order = order[np.arange(len(order)) - first[where[order]] < most]
        self.row, self.number, self.most = order, number[order], most
        self.first = np.searchsorted(where[order], np.arange(len(self.p) + 1))

    def nearest(self, q: np.ndarray, reach: np.ndarray):
        """Of places q, strip by strip: (who, far, row), at most `most` ids of each within its reach, by distance and id; row is where the id is in `values`."""
        x, y = np.ascontiguousarray(self.p.T)
        step = max(1, HELD // len(x))
        d2, other = np.empty((2, min(step, len(q)), len(x)))
        for lo in range(0, len(q), step):
            own = q[lo : lo + step]
            d, e = d2[: len(own)], other[: len(own)]
            np.subtract(own[:, :1], x, out=d)
            np.subtract(own[:, 1:], y, out=e)
            np.multiply(d, d, out=d)
            np.multiply(e, e, out=e)
            np.add(d, e, out=d)
            within = reach[lo : lo + step]
            if len(x) > self.most:
                np.copyto(e, d)
                e.partition(self.most - 1, axis=1)
                within = np.minimum(within, e[:, self.most - 1])
            r, c = np.nonzero(d <= within[:, None])
            far = d[r, c]
            ok = far < np.inf
            r, c, far = r[ok], c[ok], far[ok]
            size = self.first[c + 1] - self.first[c]
            at = np.repeat(self.first[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            r, far = np.repeat(r, size), np.repeat(far, size)
            order = np.lexsort((self.number[at], far, r))
            first = np.searchsorted(r[order], np.arange(len(own)))
            order = order[np.arange(len(order)) - first[r[order]] < self.most]
            yield lo, len(own), r[order], far[order], self.row[at[order]]


def nearest_ids(groups: DataFrame, names: list[str], k: int, *, cell: int = CELL) -> DataFrame:
    """(key, m0, m1, ...): in each map the k ids nearest to a group's place, its own ones too, by distance and then by id; groups: (key, ids, a place per name).

    A group's ids are the least ones that are there, k at most, in order.  Places that are not finite
    have no neighbours and are none (null).  A place looks for its k ids in its own cell,
    and then in those others that the circle through the farthest of them meets.
    """
    spark = groups.sparkSession
    groups = kept(groups.select("key", "ids", *names))
    n = groups.count()
    cells = max(1, min(-(-n // cell), MOST))
    share = min(1 << 20, -(-cells * TOLD * (1 << 20) // max(1, n)))
    told = groups.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share).select(*names).toArrow()
    cut = []
    for c in names:
        p = _matrix(told[c]) if told.num_rows else np.zeros((0, 2))
        cut.append(Cells(p[np.isfinite(p).all(axis=1)], cells))
    at = spark.sparkContext.broadcast(cut)
    key, id_ = (groups.schema[c].dataType for c in ("key", "ids"))
    id_ = id_.elementType.simpleString()
    place = f"cell long, key {key.simpleString()}, x double, y double"

    def deal(batches):
        for batch in batches:
            for m in range(len(names)):
                p = _matrix(batch.column(2 + m))
                own = np.flatnonzero(np.isfinite(p).all(axis=1)) if len(p) else np.zeros(0, np.int64)
                if len(own):
                    some = batch.take(pa.array(own))
                    number = at.value[m].of(p[own]) + m * STRIDE
                    yield pa.RecordBatch.from_arrays([pa.array(number), some.column(0), pa.array(p[own, 0]), pa.array(p[own, 1]), some.column(1)], names=["cell", "key", "x", "y", "ids"])

    dealt = kept(groups.mapInArrow(deal, f"{place}, ids array<{id_}>"))

    def both(table: pa.Table) -> tuple[np.ndarray, pa.ListArray]:
        ids = table["ids"].combine_chunks()
        return np.stack([table["x"].to_numpy(), table["y"].to_numpy()], axis=1), ids

    def within(cell, table):
        p, ids = both(table)
        m, own = divmod(cell[0].as_py(), STRIDE)
        known = Known(p, ids, k)
        of_place = np.argsort(known.place, kind="stable")
        first = np.searchsorted(known.place[of_place], np.arange(len(known.p) + 1))
        out = []
        for lo, n, who, far, row in known.nearest(known.p, np.full(len(known.p), np.inf)):
            size = np.bincount(who, minlength=n)
            last = np.cumsum(size) - 1
            reach = np.where(size >= k, far[np.maximum(last, 0)] if len(far) else np.inf, np.inf)
            near = _lists(size, pa.StructArray.from_arrays([pa.array(far), known.values.take(pa.array(row))], ["d2", "id"]))
            who, met = at.value[m].met(known.p[lo : lo + n], reach)
            who, met = who[met != own], met[met != own]
            order = np.argsort(who, kind="stable")
            visits = _lists(np.bincount(who, minlength=n), pa.array(met[order] + m * STRIDE))
            rows = of_place[first[lo] : first[lo + n]]  # the groups at these places
            which = pa.array(known.place[rows] - lo)
            some = table.take(pa.array(rows))
            out.append(pa.table([pa.array(np.full(len(rows), m)), some["key"], some["x"], some["y"], pa.array(reach).take(which), near.take(which), visits.take(which)], names=["m", "key", "x", "y", "reach", "near", "visits"]))
        return pa.concat_tables(out)

    near = f"near array<struct<d2:double,id:{id_}>>"
    first = kept(dealt.groupBy("cell").applyInArrow(within, f"m long, key {key.simpleString()}, x double, y double, reach double, {near}, visits array<long>"))
    visits = first.select(F.explode("visits").alias("cell"), "key", "x", "y", F.lit(None).cast(f"array<{id_}>").alias("ids"), "reach")

    def visited(cell, table):
        lives = table["ids"].is_valid().combine_chunks()
        there, come = table.filter(lives), table.filter(pc.invert(lives))
        out = []
        if there.num_rows and come.num_rows:
            known = Known(*both(there), k)
            q = np.stack([come["x"].to_numpy(), come["y"].to_numpy()], axis=1)
            for lo, n, who, far, row in known.nearest(q, come["reach"].to_numpy()):
                size = np.bincount(who, minlength=n)
                some = np.flatnonzero(size)
                values = pa.StructArray.from_arrays([pa.array(far), known.values.take(pa.array(row))], ["d2", "id"])
                m = np.full(len(some), cell[0].as_py() // STRIDE)
                out.append(pa.table([pa.array(m), come["key"].slice(lo, n).take(pa.array(some)), _lists(size[some], values)], names=["m", "key", "near"]))
        kind = pa.schema([("m", pa.int64()), table.schema.field("key"), ("near", pa.list_(pa.struct([("d2", pa.float64()), ("id", table.schema.field("ids").type.value_type)])))])
        return pa.concat_tables([t.cast(kind) for t in out]) if out else kind.empty_table()

    second = dealt.withColumn("reach", F.lit(None).cast("double")).unionByName(visits).groupBy("cell").applyInArrow(visited, f"m long, key {key.simpleString()}, {near}")
    found = first.select("m", "key", "near").unionByName(second)
    best = found.groupBy("m", "key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    ids = F.transform("near", lambda v: v["id"])
    return best.groupBy("key").agg(*(F.first(F.when(F.col("m") == m, ids), ignorenulls=True).alias(c) for m, c in enumerate(names)))
