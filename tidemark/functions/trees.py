"""Gini trees grown level by level: one aggregation of (node, feature, value, class) counts a level.

A numeric feature splits between neighbouring values (at most the threshold goes
left), a categorical one off a single category.  A gain more than 1e-12 higher wins,
else the smaller `feature|value`.  A missing number counts as 0 but makes no
threshold; a missing category is the empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import kept


@dataclass
class Tree:
    labels: list[str]
    #: By number: prediction, n, counts, depth; inner ones also feature, kind, value, gain, left, right.  Node 0 is the root.
    nodes: dict[int, dict] = field(default_factory=dict)

    def importances(self) -> dict[str, float]:
        """Gain times rows of each feature, as shares of 1."""
        raw: dict[str, float] = {}
        for node in self.nodes.values():
            if "feature" in node:
                raw[node["feature"]] = raw.get(node["feature"], 0.0) + node["gain"] * node["n"]
        total = sum(raw.values())
        return {f: v / total for f, v in raw.items()} if total > 0 else {}

    def top_importances(self, n: int = 12) -> list[tuple[str, float]]:
        return sorted(self.importances().items(), key=lambda x: (-x[1], x[0]))[:n]

    def depth(self) -> int:
        return max((node["depth"] for node in self.nodes.values()), default=0)

    def place(self, depth: int | None = None, at: int = 0) -> Column:
        """Number of the node that a row ends in, `depth` levels down at most."""
        node = self.nodes[at]
        if "feature" not in node or depth is not None and node["depth"] >= depth:
            return F.lit(at)
        if node["kind"] == "numeric":
            left = F.coalesce(F.col(f"`{node['feature']}`").cast("double"), F.lit(0.0)) <= node["value"]
        else:
            left = F.coalesce(F.col(f"`{node['feature']}`").cast("string"), F.lit("")) == node["value"]
        return F.when(left, self.place(depth, node["left"])).otherwise(self.place(depth, node["right"]))

    def predicted(self, depth: int | None = None, at: int = 0) -> Column:
        """The label of the node that a row ends in."""
        node = self.nodes[at]
        if "feature" not in node or depth is not None and node["depth"] >= depth:
            return F.lit(node["prediction"])
        if node["kind"] == "numeric":
            left = F.coalesce(F.col(f"`{node['feature']}`").cast("double"), F.lit(0.0)) <= node["value"]
        else:
            left = F.coalesce(F.col(f"`{node['feature']}`").cast("string"), F.lit("")) == node["value"]
        return F.when(left, self.predicted(depth, node["left"])).otherwise(self.predicted(depth, node["right"]))


#: Ranges of a number's values; each is put in order by itself.
RANGES = 64


def splits(df: DataFrame, label: str, numeric: list[str], categorical: list[str], min_leaf: int) -> DataFrame:
    """The best split of each node of rows with a column _node: node, feature, kind, value (a string) and gain; nodes without one are left out.

    Going along the values, a class count that grows from l to l + n adds
    (l + n)^2 - l^2 to the squares on the left, and takes as much as it should from
    those on the right: running sums tell both sides' impurity, however many classes
    there are.
    """
    kind = "array<struct<feature:int,is_number:boolean,x:double,seen:boolean,s:string>>"
    numbers = F.transform(F.array(*(F.col(f"`{f}`").cast("double") for f in numeric)), lambda x, i: F.struct(i.alias("feature"), F.lit(True).alias("is_number"), F.coalesce(x, F.lit(0.0)).alias("x"), x.isNotNull().alias("seen"), F.lit("").alias("s")))
    words = F.transform(F.array(*(F.col(f"`{f}`").cast("string") for f in categorical)), lambda x, i: F.struct((i + len(numeric)).alias("feature"), F.lit(False).alias("is_number"), F.lit(0.0).alias("x"), F.lit(True).alias("seen"), F.coalesce(x, F.lit("")).alias("s")))
    parts = [p.cast(kind) for p, own in ((numbers, numeric), (words, categorical)) if own]
    flat = df.select(F.col("_node").alias("node"), F.col(f"`{label}`").alias("label"), F.explode(F.concat(*parts)).alias("t")).select("node", "label", "t.*")
    each = flat.groupBy("node", "feature", "is_number", "x", "s", "label").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("seen"))
    # Values go to ranges, so that no task orders a whole feature; few sums of ranges tell what lies before each.
    cuts = df.agg(*(F.percentile_approx(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), [k / RANGES for k in range(1, RANGES)], 1000).alias(f"c{i}") for i, f in enumerate(numeric))).first() if numeric else []
    bounds = F.array(*(F.array(*(F.lit(float(c)) for c in sorted(set(own or [])))).cast("array<double>") for own in cuts)) if numeric else F.array().cast("array<array<double>>")
    each = kept(each.withColumn("range", F.when(F.col("is_number"), F.size(F.filter(F.get(bounds, F.col("feature")), lambda c: c < F.col("x")))).otherwise(0)))
    before = lambda by: Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    of_class = ["node", "feature", "label"]
    ranges = each.groupBy(*of_class, "range").agg(F.sum("n").alias("m"))
    ranges = ranges.select(*of_class, "range", F.coalesce(F.sum("m").over(before(of_class)), F.lit(0)).alias("lower"), F.sum("m").over(Window.partitionBy(*of_class)).alias("all"))
    run = Window.partitionBy(*of_class, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(ranges, [*of_class, "range"]).withColumn("l", F.when(F.col("is_number"), F.col("lower") + F.coalesce(F.sum("n").over(run), F.lit(0))).otherwise(0))
    square = lambda c: c * c
    left = square(F.col("l") + F.col("n")) - square(F.col("l"))
    right = square(F.col("all") - F.col("l") - F.col("n")) - square(F.col("all") - F.col("l"))
    value = kept(each.groupBy("node", "feature", "is_number", "range", "x", "s").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"), F.sum(left).alias("left"), F.sum(right).alias("right")))
    totals = ranges.select(*of_class, "all").distinct().groupBy("node", "feature").agg(F.sum(square(F.col("all"))).alias("squares"), F.sum("all").alias("total"))
    of_feature, sums = ["node", "feature"], ("n", "left", "right")
    lower = value.groupBy(*of_feature, "range").agg(*(F.sum(c).alias(c) for c in sums))
    lower = lower.select(*of_feature, "range", *(F.coalesce(F.sum(c).over(before(of_feature)), F.lit(0)).alias(f"lower_{c}") for c in sums))
    order = Window.partitionBy(*of_feature, "range").orderBy("x", "s")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda c: F.when(F.col("is_number"), F.col(f"lower_{c}") + F.sum(c).over(upto)).otherwise(F.col(c))
    v = value.join(lower, [*of_feature, "range"]).join(F.broadcast(totals), of_feature)
    v = v.select("node", "feature", "is_number", "range", "x", "s", "seen", *(so_far(c).alias(c) for c in sums), "squares", "total", F.row_number().over(order).alias("_k"))
    row = F.struct("x", "seen", *sums)
    # The two values after a range's last ones are among the first two of the ranges after it.
    heads = v.where("_k <= 2").groupBy(*of_feature).agg(F.sort_array(F.collect_list(F.struct("range", "_k", row.alias("row")))).alias("heads"))
    of_range = F.transform(F.array_distinct(F.transform("heads", lambda h: h["range"])), lambda r: F.struct(r.alias("range"), F.slice(F.filter("heads", lambda h: h["range"] > r), 1, 2).alias("after")))
    v = v.join(heads.select(*of_feature, F.explode(of_range).alias("h")).select(*of_feature, "h.range", "h.after"), [*of_feature, "range"])
    one, two = (F.lead(row, k).over(order) for k in (1, 2))
    v = v.withColumns({"one": one, "two": two})
    later = lambda k: F.get("after", F.lit(k))["row"]
    v = v.withColumns({"two": F.coalesce("two", F.when(F.col("one").isNotNull(), later(0)).otherwise(later(1))), "one": F.coalesce("one", later(0))})
    v = v.select("node", "feature", "is_number", "x", "s", "seen", *sums, "squares", "total", *(F.col(f"{name}.{c}").alias(f"{c}{k}") for k, name in ((1, "one"), (2, "two")) for c in ("x", "seen", *sums)))
    # Missing numbers stand at 0, where there may be no number: then the neighbour is one further on, and they go left if the threshold is not below 0.
    skips = ~F.col("seen1")
    after = F.when(skips, F.col("x2")).otherwise(F.col("x1"))
    v = v.withColumn("at", (F.col("x") + after) / 2)
    takes = skips & (F.col("at") >= 0)
    picked = lambda c: F.when(F.col("is_number") & takes, F.col(f"{c}1")).otherwise(F.col(c))
    v = v.where(~F.col("is_number") | (F.col("seen") & F.col("at").isNotNull()))
    v = v.select("node", "feature", "is_number", "at", "s", "squares", F.col("total").cast("double").alias("total"), picked("n").cast("double").alias("nl"), picked("left").alias("left"), (picked("right") + F.col("squares")).alias("right")).withColumn("nr", F.col("total") - F.col("nl"))
    told = F.when(F.col("is_number"), _told("at")).otherwise(F.col("s"))
    impurity = lambda squares, n: 1 - F.col(squares) / (F.col(n) * F.col(n))
    gain = impurity("squares", "total") - (F.col("nl") / F.col("total") * impurity("left", "nl") + F.col("nr") / F.col("total") * impurity("right", "nr"))
    name = F.element_at(F.array(*(F.lit(f) for f in [*numeric, *categorical])), F.col("feature") + 1)
    gained = v.where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf)).select("node", name.alias("feature"), F.when(F.col("is_number"), "numeric").otherwise("categorical").alias("kind"), F.when(F.col("is_number"), F.col("at").cast("string")).otherwise(F.col("s")).alias("value"), told.alias("told"), gain.alias("gain"))
    return _best(gained)


def _told(c: str) -> Column:
    """A threshold as it stands in a split's name: whole ones without a fraction."""
    return F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))


def _best(gained: DataFrame) -> DataFrame:
    near = gained.withColumn("most", F.max("gain").over(Window.partitionBy("node"))).where(F.col("gain") >= F.col("most") - 1e-12)
    return near.groupBy("node").agg(F.min_by(F.struct("feature", "kind", "value", "gain"), F.concat_ws("|", "feature", "told")).alias("b")).select("node", "b.*")


#: How often a class has a value at a node; the node and the class by their numbers, the class as -1 - number where the value is missing.
ENTRY = np.dtype([("x", "<f8"), ("n", "<i8"), ("node", "<i4"), ("label", "<i4")])
#: Entries of a range, about, and ranges of a feature at most.
RANGE_ENTRIES, MOST_RANGES = 1 << 16, 4096


def range_bounds(df: DataFrame, numeric: list[str], entries: int | None = None) -> list[np.ndarray]:
    """Where the values of each feature are cut in ranges of some `entries` rows; none where they are few."""
    ranges = min(-(-df.count() // (entries or RANGE_ENTRIES)), MOST_RANGES)
    if ranges < 2:
        return [np.zeros(0) for _ in numeric]
    shares = [k / ranges for k in range(1, ranges)]
    cuts = df.agg(*(F.percentile_approx(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)), shares, max(1000, 10 * ranges)).alias(f"c{i}") for i, f in enumerate(numeric))).first()
    return [np.unique(np.asarray(c or [], np.float64)) for c in cuts]


def _differs(x: np.ndarray) -> np.ndarray:
    """Whether a number is another one than the number before it."""
    return (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))


def _merged(e: np.ndarray) -> np.ndarray:
    """Entries by node, value and class, each once."""
    e = e[np.lexsort((e["label"], e["x"], e["node"]))]
    first = np.ones(len(e), bool)
    if len(e):
        first[1:] = (e["node"][1:] != e["node"][:-1]) | _differs(e["x"]) | (e["label"][1:] != e["label"][:-1])
    at = np.flatnonzero(first)
    if len(at) < len(e):
        n = np.add.reduceat(e["n"], at)
        e = e[at]
        e["n"] = n
    return e


def _running(e: np.ndarray, value: np.ndarray, before: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to each value, of entries in order: rows on the left, and the summed squares of the classes on the left and on the right; before and every: what classes of nodes have to begin with, and in all."""
    by = np.lexsort((value, e["label"], e["node"]))  # each class of a node along its values
    node, label, n = e["node"][by], e["label"][by], e["n"][by]
    new = np.ones(len(by), bool)
    new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
    begin = np.flatnonzero(new)
    upto = np.cumsum(n)
    upto += np.repeat(before[node[begin], label[begin]] - (upto[begin] - n[begin]), np.diff(np.append(begin, len(by))))
    low, rest = upto - n, every[node, label] - upto
    more = np.empty((3, len(by)), np.int64)
    more[:, by] = n, upto * upto - low * low, rest * rest - (rest + n) * (rest + n)
    first = np.flatnonzero(np.diff(value, prepend=-1))
    of = e["node"][first]  # the node of each value
    sums = np.cumsum(np.add.reduceat(more, first, axis=1), axis=1)
    new = np.flatnonzero(np.diff(of, prepend=-1))
    start = np.stack([before.sum(axis=1), (before * before).sum(axis=1), ((every - before) ** 2).sum(axis=1)])[:, of[new]]
    earlier = np.concatenate([np.zeros((3, 1), np.int64), sums], axis=1)[:, new]
    sums += np.repeat(start - earlier, np.diff(np.append(new, len(first))), axis=1)
    return sums[0], sums[1], sums[2]


def number_splits(df: DataFrame, nodes: list[int], label: str, labels: list[str], numeric: list[str], min_leaf: int, bounds: list[np.ndarray]) -> DataFrame:
    """splits() of numbers only, for many features: a range of a feature's values is one row, its entries in arrays.

    Rows are dealt as entries to the ranges of every feature; a task puts a range in order and tells
    its class counts, the ranges of a feature tell each other what lies before and
    after, and a range then tries its thresholds.  Missing numbers are apart: they go
    left where the threshold is not below 0.
    """
    own, shape = np.sort(np.asarray(nodes, np.int64)), (len(nodes), len(labels))
    number = F.array_position(F.array(*(F.lit(c) for c in labels)), F.col(f"`{label}`")).cast("int") - 1
    rows = df.select(F.col("_node").cast("long").alias("node"), number.alias("label"), *(F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(numeric)))

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, code = np.searchsorted(own, batch.column(0).to_numpy()), batch.column(1).to_numpy()
            features, ranges, data = [], [], []
            for f, cuts in enumerate(bounds):
                column = batch.column(2 + f)
                e = np.empty(batch.num_rows, ENTRY)
                e["x"], e["n"], e["node"] = pc.fill_null(column, 0.0).to_numpy() + 0.0, 1, node
                e["label"] = np.where(pc.is_valid(column).to_numpy(zero_copy_only=False), code, -1 - code) if column.null_count else code
                if len(np.unique(e["x"])) * 2 < len(e):
                    e = _merged(e)
                at = np.searchsorted(cuts, e["x"])
                order = np.argsort(at, kind="stable")
                e, at = e[order], at[order]
                upto = np.searchsorted(at, np.arange(len(cuts) + 2))
                for k in np.flatnonzero(np.diff(upto)).tolist():
                    features.append(f)
                    ranges.append(k)
                    data.append(e[upto[k] : upto[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), pa.array(ranges, pa.int32()), pa.array(data, pa.binary())], names=["feature", "range", "data"])

    def order(key, table):
        e = _merged(np.concatenate([np.frombuffer(b.as_buffer(), ENTRY) for chunk in table["data"].chunks for b in chunk]))
        counts, missing, head = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(len(own))
        gone = e["label"] < 0
        np.add.at(missing, (e["node"][gone], -1 - e["label"][gone]), e["n"][gone])
        e = e[~gone]
        np.add.at(counts, (e["node"], e["label"]), e["n"])
        there, first = np.unique(e["node"], return_index=True)
        head[there] = e["x"][first]
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([v.tobytes()], pa.binary()) for v in (e, counts, missing, head)], names=["feature", "range", "data", "counts", "missing", "head"])

    def among(key, table):
        table = table.sort_by("range")
        counts, missing = (np.stack([np.frombuffer(b.as_py(), np.int64).reshape(shape) for b in table[c]]) for c in ("counts", "missing"))
        head = np.stack([np.frombuffer(b.as_py(), np.float64) for b in table["head"]])
        upto, every, gone = np.cumsum(counts, axis=0), counts.sum(axis=0), missing.sum(axis=0)
        after, follows, out = np.zeros(len(own)), np.zeros(len(own), bool), []
        for k in range(len(counts) - 1, -1, -1):
            out.append([v.tobytes() for v in (upto[k] - counts[k], every, gone, after, follows)])
            some = counts[k].any(axis=1)
            after, follows = np.where(some, head[k], after), follows | some
        out = list(zip(*out[::-1], strict=True))
        return pa.table([table["feature"], table["range"], *(pa.array(v, pa.binary()) for v in out)], names=["feature", "range", "before", "every", "gone", "after", "follows"])

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                e = np.frombuffer(r["data"], ENTRY)
                if not len(e):
                    continue
                before, every, gone = (np.frombuffer(r[c], np.int64).reshape(shape) for c in ("before", "every", "gone"))
                after, follows = np.frombuffer(r["after"], np.float64), np.frombuffer(r["follows"], bool)
                new = np.ones(len(e), bool)
                new[1:] = (e["node"][1:] != e["node"][:-1]) | _differs(e["x"])
                first = np.flatnonzero(new)
                node, x = e["node"][first].astype(np.int64), e["x"][first]
                last = np.append(node[1:] != node[:-1], True)
                then = np.where(last, after[node], np.append(x[1:], 0.0))
                at = (x + then) / 2
                value, both = np.cumsum(new) - 1, every + gone
                nl, left, right = _running(e, value, before, both)
                if gone.any():
                    takes = at >= 0
                    nl, left, right = (np.where(takes, a, b) for a, b in zip(_running(e, value, before + gone, both), (nl, left, right), strict=True))
                total = both.sum(axis=1).astype(np.float64)[node]
                squares, nl = (both * both).sum(axis=1)[node], nl.astype(np.float64)
                nr = total - nl
                ok = (~last | follows[node]) & (nl >= min_leaf) & (nr >= min_leaf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (1 - squares / (total * total)) - (nl / total * (1 - left / (nl * nl)) + nr / total * (1 - right / (nr * nr)))
                node, at, gain = node[ok], at[ok], gain[ok]
                most = np.full(len(own), -np.inf)
                np.maximum.at(most, node, gain)
                near = gain >= most[node] - 1e-12
                yield pa.RecordBatch.from_arrays([pa.array(own[node[near]]), pa.array(np.full(int(near.sum()), r["feature"]), pa.int32()), pa.array(at[near]), pa.array(gain[near])], names=["node", "number", "at", "gain"])

    ordered = kept(rows.mapInArrow(pack, "feature int, range int, data binary").groupBy("feature", "range").applyInArrow(order, "feature int, range int, data binary, counts binary, missing binary, head binary"))
    context = ordered.drop("data").groupBy("feature").applyInArrow(among, "feature int, range int, before binary, every binary, gone binary, after binary, follows binary")
    tried = ordered.select("feature", "range", "data").join(context, ["feature", "range"]).mapInArrow(score, "node long, number int, at double, gain double")
    name = F.element_at(F.array(*(F.lit(f) for f in numeric)), F.col("number") + 1)
    return _best(tried.select("node", name.alias("feature"), F.lit("numeric").alias("kind"), F.col("at").cast("string").alias("value"), _told("at").alias("told"), "gain"))


#: Nodes of a tree, at most: a node's number among several trees is the tree's number times this, plus its own.
STRIDE = 1 << 20


def grow(df: DataFrame, *, label: str, labels: list[str], numeric: list[str], categorical: list[str] | None = None, max_depth: int = 3, min_split: int = 10, min_leaf: int = 5, min_gain: float = 1e-9) -> Tree:
    """A tree over all rows whose label is one of `labels`; a shallower one is its beginning: place() and predicted() take a depth."""
    (tree,) = grow_many(df.withColumn("_tree", F.lit(0)), 1, label=label, labels=labels, numeric=numeric, categorical=categorical, max_depth=max_depth, min_split=min_split, min_leaf=min_leaf, min_gain=min_gain)
    return tree


def grow_many(df: DataFrame, n: int, *, label: str, labels: list[str], numeric: list[str], categorical: list[str] | None = None, max_depth: int = 3, min_split: int = 10, min_leaf: int = 5, min_gain: float = 1e-9) -> list[Tree]:
    """n trees, each over the rows whose column _tree has its number: a level of all trees is one search for splits."""
    categorical = categorical or []
    if not numeric and not categorical:
        raise ValueError("a tree needs features")
    grown = [Tree(list(labels), {0: {"depth": 0}}) for _ in range(n)]
    own = F.upper(F.col(f"`{label}`").cast("string"))
    rows = df.withColumn(label, own).where(F.col(f"`{label}`").isin(labels))
    bounds = None if categorical else range_bounds(rows, numeric)
    open_ = [(t, 0) for t in range(n)]
    while open_:
        place = F.lit(None).cast("long")
        for t in sorted({t for t, _ in open_}):
            place = F.when(F.col("_tree") == t, grown[t].place() + F.lit(t * STRIDE)).otherwise(place)
        at = rows.withColumn("_node", place).where(F.col("_node").isin([t * STRIDE + k for t, k in open_]))
        counts = {t * STRIDE + k: dict.fromkeys(labels, 0) for t, k in open_}
        for r in at.groupBy("_node", label).agg(F.count(F.lit(1)).alias("n")).collect():  # labels by open nodes
            counts[r["_node"]][r[label]] = r["n"]
        wide = []
        for t, k in open_:
            node, told = grown[t].nodes[k], counts[t * STRIDE + k]
            node |= {"n": sum(told.values()), "counts": told, "prediction": max(labels, key=lambda c, told=told: (told[c], -labels.index(c)))}
            if node["depth"] < max_depth and node["n"] >= min_split and sum(c > 0 for c in told.values()) > 1:
                wide.append(t * STRIDE + k)
        open_ = []
        if not wide:
            continue
        own = at.where(F.col("_node").isin(wide))
        told = splits(own, label, numeric, categorical, min_leaf) if categorical else number_splits(own, wide, label, labels, numeric, min_leaf, bounds)
        for r in told.orderBy("node").collect():  # a row per open node
            if r["gain"] > min_gain:
                t, k = divmod(r["node"], STRIDE)
                nodes = grown[t].nodes
                a, b = len(nodes), len(nodes) + 1
                nodes[k] |= {"feature": r["feature"], "kind": r["kind"], "value": float(r["value"]) if r["kind"] == "numeric" else r["value"], "gain": r["gain"], "left": a, "right": b}
                nodes[a], nodes[b] = {"depth": nodes[k]["depth"] + 1}, {"depth": nodes[k]["depth"] + 1}
                open_ += [(t, a), (t, b)]
    return grown
