"""Unsupervised signal: isolation forest and local outlier factor over four features.

Both see a work only through its sanctioned amount, spend and age, so works that agree on those
three are one weighted point. A pile of identical works, however large, is one row here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksift.config import SETTINGS
from worksift.functions.dates import months_elapsed
from worksift.plans.ranking import global_rank
from worksift.plans.storage import written

POINT = ["point_sanctioned", "point_spent", "point_months"]
FEATURES = ["f_sanctioned", "f_spent", "f_ratio", "f_months"]


def point_columns(as_of: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        POINT[0]: F.greatest(zero, F.coalesce("sanctioned_amount_inr", zero)),
        POINT[1]: F.greatest(zero, F.coalesce("expenditure_amount_inr", zero)),
        POINT[2]: F.coalesce(months_elapsed(F.col("sanction_date"), as_of), F.lit(0)),
    }


def _raw_features() -> dict[str, Column]:
    sanctioned, spent, months = (F.col(c) for c in POINT)
    ratio = F.when(sanctioned > 0, F.least(spent / sanctioned, F.lit(SETTINGS.ratio_feature_cap)))
    return {
        FEATURES[0]: F.log1p(sanctioned),
        FEATURES[1]: F.log1p(spent),
        FEATURES[2]: F.coalesce(ratio, F.lit(0.0)),
        FEATURES[3]: months.cast("double"),
    }


def _standardised(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """Features of ``raw`` scaled by the population mean and deviation over ``rows``."""
    stats = rows.agg(
        *[fn(f).alias(f"{label}_{f}") for f in FEATURES for label, fn in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    scaled = {
        f: (F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"std_{f}") > 0, F.col(f"std_{f}")).otherwise(1.0)
        for f in FEATURES
    }
    drop = [f"{label}_{f}" for f in FEATURES for label in ("mean", "std")]
    return raw.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*drop)  # one row of statistics


def anomaly_features(works: DataFrame, as_of: Column) -> DataFrame:
    """Standardised features of every work."""
    raw = works.select("work_id", *[c.alias(n) for n, c in point_columns(as_of).items()]).withColumns(_raw_features())
    return _standardised(raw, raw).select("work_id", *FEATURES)


def feature_points(works: DataFrame, as_of: Column) -> DataFrame:
    """Distinct points with their ``weight`` (number of works), a stable ``point`` number and
    standardised features; written once for both models."""
    raw = works.select(*[c.alias(n) for n, c in point_columns(as_of).items()])
    points = raw.groupBy(*POINT).agg(F.count("*").alias("weight"))
    points = points.withColumns(_raw_features())
    rows = raw.withColumns(_raw_features())
    numbered = global_rank(points, [F.col(c) for c in POINT], "point")
    return written(_standardised(numbered, rows), "points")


# -- isolation forest -------------------------------------------------------------------------


def _average_path(n):
    """Expected depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    depth = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, depth))


_FEATURE_DECIMALS = 9  # floating noise must not decide on which side of a cut a work falls
_NODE_SCHEMA = "seed int, tree int, rows int, node int, axis int, cut double, depth double"
_DRAW = 1 << 32


def _digits(text: str) -> tuple[int, int]:
    """Two numbers below 2**32 from the md5 of a text: draws that any engine can repeat."""
    digest = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    """One random tree over at most ``forest_sample`` rows, nodes numbered like a heap. A node's draws
    choose one of the features that vary in it, and the place of the cut between its lowest and highest value."""
    seed, tree = int(rows["seed"].iloc[0]), int(rows["tree"].iloc[0])
    x = rows[FEATURES].to_numpy()
    height = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, waiting = [], [(0, 0, np.arange(len(x)))]
    while waiting:
        node, level, inside = waiting.pop()
        low, high = x[inside].min(axis=0), x[inside].max(axis=0)
        varying = np.flatnonzero(high > low)
        if level == height or len(varying) == 0:
            nodes.append((seed, tree, len(x), node, -1, 0.0, level + float(_average_path(len(inside)))))
            continue
        which, where = _digits(f"{seed}:{tree}:{node}")
        axis = varying[which % len(varying)]
        cut = low[axis] + (high[axis] - low[axis]) * (where / _DRAW)
        if cut >= high[axis]:
            cut = low[axis]
        nodes.append((seed, tree, len(x), node, int(axis), float(cut), 0.0))
        left = x[inside, axis] <= cut
        waiting += [(2 * node + 1, level + 1, inside[left]), (2 * node + 2, level + 1, inside[~left])]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODE_SCHEMA.split(", ")])


def _forest_sample(rows: DataFrame, total: int, seeds: Sequence[int], trees: int) -> DataFrame:
    """``forest_sample`` works per seed and tree: those with the tree's smallest draws.

    Every work draws for every tree, at any number of works: a + m * b modulo 2**32, with a and b from
    the md5 of the work id and m from seed and tree. A draw above the cut-off, which leaves a tree about
    four times its sample, is dropped where it is made, so what is shuffled is bounded by the
    forest's size and not by the data.
    """
    sample = SETTINGS.forest_sample
    cutoff = min(_DRAW, -(-4 * sample * _DRAW // max(total, 1)))
    factors = [(seed * 65_537 + tree) % (1 << 24) for seed in seeds for tree in range(trees)]

    @F.pandas_udf("array<bigint>")
    def drawn(a: pd.Series, b: pd.Series) -> pd.Series:
        """Draws below the cut-off, with the number of their tree above the draw's 32 bits."""
        a, b = a.to_numpy(), b.to_numpy()
        if not len(a):
            return pd.Series([], dtype=object)
        rows, draws = [], []
        for number, m in enumerate(factors):
            pick = (a + m * b) & (_DRAW - 1)
            at = np.flatnonzero(pick < cutoff)
            rows.append(at)
            draws.append(pick[at] + number * _DRAW)
        rows, draws = np.concatenate(rows), np.concatenate(draws)
        ends = np.cumsum(np.bincount(rows, minlength=len(a)))[:-1]
        return pd.Series(np.split(draws[np.argsort(rows, kind="stable")], ends))

    number = lambda at: F.conv(F.substring(F.md5(F.col("work_id").cast("binary")), at, 8), 16, 10).cast("bigint")
    numbered = rows.where(F.col("work_id").isNotNull()).select(
        "work_id", *[F.round(f, _FEATURE_DECIMALS).alias(f) for f in FEATURES], number(1).alias("_a"), number(9).bitwiseOR(F.lit(1)).alias("_b")
    )
    tree = F.shiftright("_draw", 32)
    offered = numbered.select("work_id", *FEATURES, F.explode(drawn("_a", "_b")).alias("_draw")).select(
        "work_id",
        *FEATURES,
        F.get(F.array(*[F.lit(s) for s in seeds]), F.floor(tree / trees).cast("int")).alias("seed"),
        (tree % trees).cast("int").alias("tree"),
        F.col("_draw").bitwiseAND(F.lit(_DRAW - 1)).alias("pick"),
    )
    place = F.row_number().over(Window.partitionBy("seed", "tree").orderBy("pick", "work_id"))
    return offered.withColumn("_place", place).where(F.col("_place") <= sample).drop("_place", "pick")


def forest_nodes(rows: DataFrame, total: int, seeds: Sequence[int], trees: int) -> DataFrame:
    """The forests of several seeds as one table of nodes (``seed, tree, rows, node, axis, cut, depth``),
    grown in one job, one task per tree, on fixed-size samples of ``rows`` (every work's features).
    ``axis`` is -1 in leaves. The first trees of a seed are the same in forests of any size."""
    chosen = _forest_sample(rows, total, seeds, trees)
    return written(chosen.groupBy("seed", "tree").applyInPandas(_grow, _NODE_SCHEMA), "forest")


def isolation_runs(points: DataFrame, rows: DataFrame, seeds: Sequence[int], sizes: Sequence[int]) -> DataFrame:
    """Adds ``runs`` to ``points``: isolation by the first ``size`` trees of each seed, an array by seed and
    then by size. A forest of a size is the first trees of the largest one, so all runs are one pass."""
    total = points.agg(F.sum("weight")).first()[0] or 0
    sizes = sorted(sizes)
    nodes = forest_nodes(rows, total, seeds, sizes[-1])
    supply = min(SETTINGS.forest_sample, total)
    short = nodes.groupBy("seed", "tree").agg(F.min("rows").alias("rows"))
    if total and (short.count() < len(seeds) * sizes[-1] or not short.where(F.col("rows") < supply).isEmpty()):
        raise RuntimeError(f"a tree of the forest got fewer than {supply} works")
    size = 2 ** (int(np.ceil(np.log2(max(supply, 2)))) + 1) - 1
    arrays = {s: [(np.full(size, -1), np.zeros(size), np.zeros(size)) for _ in range(sizes[-1])] for s in seeds}
    # Trees times at most 511 nodes, whatever the number of works.
    for r in nodes.collect():
        for values, value in zip(arrays[r["seed"]][r["tree"]], (r["axis"], r["cut"], r["depth"]), strict=True):
            values[r["node"]] = value
    forest = points.sparkSession.sparkContext.broadcast([arrays[s] for s in seeds])
    normal = float(_average_path(supply))
    marks = set(sizes)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy() for c in columns])
            row, out = np.arange(len(x)), []
            for trees in forest.value:
                path = np.zeros(len(x))
                for count, (axes, cuts, depth) in enumerate(trees, 1):
                    node = np.zeros(len(x), dtype=np.int64)
                    while (inner := axes[node] >= 0).any():
                        right = x[row, np.maximum(axes[node], 0)] > cuts[node]
                        node = np.where(inner, 2 * node + 1 + right, node)
                    path += depth[node]
                    if count in marks:
                        out.append(2.0 ** (-path / count / normal) if normal else np.zeros(len(x)))
            yield pd.Series(list(np.stack(out, axis=1)))

    return points.withColumn("runs", score(*[F.round(f, _FEATURE_DECIMALS) for f in FEATURES]))


def isolation_forest(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``isolation`` to ``points``: higher is stranger."""
    runs = isolation_runs(points, rows, [SETTINGS.forest_seed], [SETTINGS.forest_trees])
    return runs.withColumn("isolation", F.col("runs")[0]).drop("runs")


# -- local outlier factor ---------------------------------------------------------------------

_CELL_POINTS = 500  # distinct points aimed at per cell, and at least
_TASK_POINTS = 20_000  # distinct points of a task's cell at most, which is cut into cells again
_CELLS_PER_CORE = 4
_MAX_CELLS = 1 << 14  # larger cells are cut again inside their task
_CELL_SAMPLE = 100
_BRUTE_POINTS = 4_000
_QUERIES_PER_TASK = 20_000
_DISTANCE_DECIMALS = 9  # equally spaced points tie; floating noise must not order them


def _cut_cells(sample: np.ndarray, wanted: int) -> dict[str, np.ndarray]:
    """A median-split tree over a bounded sample of points, as plain arrays; leaves are the cells.

    Only speed depends on the sample: every search checks the boxes themselves.
    """
    tree = {"axis": [], "cut": [], "low": [], "high": [], "child": []}

    def add(low, high) -> int:
        for name, value in (("axis", -1), ("cut", 0.0), ("low", low), ("high", high), ("child", [-1, -1])):
            tree[name].append(value)
        return len(tree["axis"]) - 1

    everywhere = np.full(4, np.inf)
    levels = int(np.ceil(np.log2(max(wanted, 1))))
    waiting = [(add(-everywhere, everywhere), sample, levels)]
    least = 2 * SETTINGS.lof_neighbours  # a cell answers its own points from at least this many
    while waiting:
        node, x, level = waiting.pop()
        if level == 0 or len(x) <= 2 * least:
            continue
        for axis in np.argsort(x.min(axis=0) - x.max(axis=0)):
            cut = np.median(x[:, axis])
            if cut == x[:, axis].max():
                cut = x[x[:, axis] < cut, axis].max(initial=-np.inf)
            left = x[:, axis] <= cut
            if min(left.sum(), (~left).sum()) > least:
                break
        else:
            continue
        high, low = tree["high"][node].copy(), tree["low"][node].copy()
        high[axis] = low[axis] = cut
        a, b = add(tree["low"][node], high), add(low, tree["high"][node])
        tree["axis"][node], tree["cut"][node], tree["child"][node] = axis, cut, [a, b]
        waiting += [(a, x[left], level - 1), (b, x[~left], level - 1)]
    return {name: np.array(values) for name, values in tree.items()}


def _home(cells: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    axis, cut, child = cells["axis"], cells["cut"], cells["child"]
    node, row = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while (axis[node] >= 0).any():
        inner = axis[node] >= 0
        right = x[row, np.maximum(axis[node], 0)] > cut[node]
        node = np.where(inner, child[node, right.astype(int)], node)
    return node


def _touched(cells: dict[str, np.ndarray], x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell whose box lies within ``radius`` of the row's point."""
    rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    found = []
    while len(rows):
        leaf = cells["axis"][nodes] < 0
        found.append((rows[leaf], nodes[leaf]))
        rows, nodes = np.repeat(rows[~leaf], 2), cells["child"][nodes[~leaf]].ravel()
        gap = np.maximum(0, np.maximum(cells["low"][nodes] - x[rows], x[rows] - cells["high"][nodes]))
        near = (gap * gap).sum(axis=1) <= radius[rows] ** 2 * (1 + 1e-12)
        rows, nodes = rows[near], nodes[near]
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


_NEAR_COLUMNS = ["point", "neighbour", "distance", "weight"]


def _first_k(point, neighbour, distance, weight, k: int) -> pd.DataFrame:
    """Per point the closest neighbours (ties by number) until their weights reach ``k``."""
    order = np.lexsort((neighbour, distance, point))
    point, neighbour, weight = (v[order].astype(np.int64) for v in (point, neighbour, weight))
    distance = distance[order].astype(float)
    before = np.cumsum(weight) - weight
    before = before - before[np.searchsorted(point, point, side="left")]
    kept = (weight > 0) & (before < k)
    return pd.DataFrame(dict(zip(_NEAR_COLUMNS, (v[kept] for v in (point, neighbour, distance, weight)))))


def _pairwise(q, asking, bound, x, ids, weights, k: int) -> list[np.ndarray]:
    """Candidates of every query among ``x``: all points up to the ``k+1``-th distance, or up to
    ``bound`` where that is nearer, as columns of ``_NEAR_COLUMNS``."""
    out = []
    keep, step = min(k + 1, len(ids)), max(1, 4_000_000 // max(len(ids), 1))
    for start in range(0, len(q), step):
        part = slice(start, start + step)
        distance = np.zeros((len(q[part]), len(ids)))
        for d in range(q.shape[1]):
            gap = q[part, d, None] - x[None, :, d]
            distance += gap * gap
        distance = np.round(np.sqrt(distance), _DISTANCE_DECIMALS)
        far = np.minimum(np.partition(distance, keep - 1, axis=1)[:, keep - 1], bound[part])
        row, col = np.nonzero(distance <= far[:, None])
        # A point stands for its own duplicates too, but not for the work asking.
        weight = weights[col] - (ids[col] == asking[part][row])
        out.append((asking[part][row], ids[col], distance[row, col], weight))
    return [np.concatenate(c) for c in zip(*out)]


def _nearest(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The closest of ``points`` to each query, within its ``radius`` if it has one. Many points
    are cut into cells here too, asked like the cells of the whole."""
    x, ids, weights = points[FEATURES].to_numpy(), points["point"].to_numpy(), points["weight"].to_numpy()
    q, asking = queries[FEATURES].to_numpy(), queries["point"].to_numpy()
    bound = queries["radius"].to_numpy() if "radius" in queries else np.full(len(q), np.inf)
    if len(x) <= _BRUTE_POINTS:
        return _first_k(*_pairwise(q, asking, bound, x, ids, weights, k), k)
    cells = _cut_cells(x, len(x) // _CELL_POINTS)
    members = pd.Series(np.arange(len(x))).groupby(_home(cells, x)).apply(np.asarray)

    def ask(rows: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        found = []
        for cell, who in pd.Series(rows).groupby(at):
            who, here = who.to_numpy(), members[cell]
            found.append(_pairwise(q[who], asking[who], bound[who], x[here], ids[here], weights[here], k))
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return _first_k(*[np.concatenate(c) for c in zip(none, *found)], k)

    home = _home(cells, q)
    own = ask(np.arange(len(q)), home)
    total = own.groupby("point").agg(found=("weight", "sum"), reach=("distance", "max")).reindex(asking)
    reached = np.where(total["found"].to_numpy() >= k, total["reach"].to_numpy() + 10.0**-_DISTANCE_DECIMALS, np.inf)
    bound = np.minimum(bound, reached)
    rows, at = _touched(cells, q, bound)
    away = at != home[rows]
    both = pd.concat([own, ask(rows[away], at[away])])
    return _first_k(*[both[c].to_numpy() for c in _NEAR_COLUMNS], k)


_ANSWER_SCHEMA = "cell int, point bigint, neighbour bigint, distance double, weight bigint"
_NO_ONE = -1  # in the place of a neighbour: ``distance`` is a value of the point


def _reach(near: pd.DataFrame, k: int) -> pd.Series:
    """Per point the distance within which its neighbours must lie, where ``k`` are found."""
    total = near.groupby("point").agg(found=("weight", "sum"), reach=("distance", "max"))
    return (total["reach"] + 10.0**-_DISTANCE_DECIMALS).where(total["found"] >= k, np.inf)


def answered_cells(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Points with the cell each lies in (``cell, point, weight`` and features), and what other cells
    have answered to the points of a cell: ``cell, point, neighbour, distance, weight``.

    Each cell answers its own points first. The distance found bounds the true one, so only the
    cells whose box lies inside it are asked again. A cell asked by very many points is copied to
    several tasks. Neighbours inside a cell are not stored: they are 20 rows a point, and found again
    by the tasks that need them (``_per_cell``). Large cells have few points that ask others.
    """
    spark = points.sparkSession
    count = points.count()
    size = min(_TASK_POINTS, max(_CELL_POINTS, count // (_CELLS_PER_CORE * spark.sparkContext.defaultParallelism)))
    wanted = min(_MAX_CELLS, max(1, count // max(size, 1)))
    share = min(1.0, _CELL_SAMPLE * wanted / max(count, 1)) if wanted > 1 else 0.0
    picked = F.xxhash64("point") / F.lit(2.0**64) + 0.5 < share
    # At most about 100 points for each of 16,384 cells.
    sample = points.where(picked).select(*FEATURES).toPandas().to_numpy() if share else np.zeros((0, 4))
    cells = spark.sparkContext.broadcast(_cut_cells(sample, wanted))  # at most 2**15 nodes

    @F.pandas_udf("int")
    def home(*columns: pd.Series) -> pd.Series:
        return pd.Series(_home(cells.value, np.column_stack([c.to_numpy() for c in columns])))

    placed = points.select(home(*FEATURES).alias("cell"), "point", "weight", *FEATURES)

    def asks(here: pd.DataFrame) -> pd.DataFrame:
        radius = _reach(_nearest(here, here, k), k).reindex(here["point"]).fillna(np.inf).to_numpy()
        rows, found = _touched(cells.value, here[FEATURES].to_numpy(), radius)
        away = found != here["cell"].iloc[0]
        out = here.iloc[rows[away]][["cell", "point", *FEATURES]]
        return out.assign(ask_cell=found[away], radius=radius[rows[away]])

    features = ", ".join(f"{f} double" for f in FEATURES)
    asked = written(placed.groupBy("cell").applyInPandas(asks, f"cell int, point bigint, {features}, ask_cell int, radius double"), "asked")
    load = asked.groupBy("ask_cell").agg(F.ceil(F.count("*") / _QUERIES_PER_TASK).cast("int").alias("_copies"))
    load = F.broadcast(load)  # one row per cell
    copy = F.pmod(F.xxhash64("point"), F.col("_copies")).cast("int")
    queries = asked.join(load, "ask_cell").withColumn("ask_copy", copy).drop("_copies")
    every = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))
    copies = placed.withColumnRenamed("cell", "ask_cell").join(load, "ask_cell").withColumn("ask_copy", every).drop("_copies")

    def answer(asked_here: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if asked_here.empty or here.empty:
            return pd.DataFrame(columns=["cell", *_NEAR_COLUMNS])
        homes = asked_here.set_index("point")["cell"]
        near = _nearest(asked_here, here, k)
        return near.assign(cell=homes.loc[near["point"]].to_numpy())

    keys = ["ask_cell", "ask_copy"]
    others = queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(answer, _ANSWER_SCHEMA)
    return placed, written(others, "answers")


def _per_cell(placed: DataFrame, others: DataFrame, k: int, fn, schema: str, values: DataFrame | None = None) -> DataFrame:
    """``fn`` over each cell's points, their exact neighbours (``point, neighbour, distance, weight`` in
    order, the weights of a point adding up to ``k``) and the ``values`` (``cell, point, value``) sent to it."""
    if values is not None:
        nobody = [F.lit(_NO_ONE).cast("bigint").alias("neighbour"), F.col("value").alias("distance"), F.lit(0).cast("bigint").alias("weight")]
        others = others.unionByName(values.select("cell", "point", *nobody))

    def each(here: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        answers = more[more["neighbour"] != _NO_ONE]
        own = _nearest(here, here, k)
        near = _first_k(*[np.concatenate([own[c].to_numpy(), answers[c].to_numpy()]) for c in _NEAR_COLUMNS], k)
        before = near.groupby("point")["weight"].cumsum() - near["weight"]
        near["weight"] = np.minimum(near["weight"], k - before)
        return fn(here, near, more[more["neighbour"] == _NO_ONE].set_index("point")["distance"])

    return placed.groupBy("cell").cogroup(others.groupBy("cell")).applyInPandas(each, schema)


def _mean(near: pd.DataFrame, value: np.ndarray) -> pd.Series:
    """Per point the mean of a value over its neighbours by weight."""
    sums = (near["weight"] * value).groupby(near["point"]).sum()
    return sums / near.groupby("point")["weight"].sum()


def local_outlier_factor(points: DataFrame) -> DataFrame:
    """Adds ``outlier_factor``: how much sparser a point is than its neighbours.

    Cells exchange one value for each neighbour that lies in another cell, its k-distance and then its
    density, and never lists of neighbours.
    """
    total = points.agg(F.sum("weight")).first()[0] or 0
    k = max(1, min(SETTINGS.lof_neighbours, total - 1))
    placed, others = answered_cells(points, k)
    schema = "cell int, point bigint, value double"

    def rows(here: pd.DataFrame, value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"cell": here["cell"].iloc[0], "point": value.index, "value": value.to_numpy()})

    def distances(here: pd.DataFrame, near: pd.DataFrame, sent: pd.Series) -> pd.DataFrame:
        # Points of other cells whose values this cell needs follow, with -1.
        foreign = np.setdiff1d(near["neighbour"].to_numpy(np.int64), here["point"].to_numpy(np.int64))
        reach = near.groupby("point")["distance"].max()
        return rows(here, pd.concat([reach, pd.Series(-1.0, foreign)]))

    def densities(here: pd.DataFrame, near: pd.DataFrame, sent: pd.Series) -> pd.DataFrame:
        reach = pd.concat([near.groupby("point")["distance"].max(), sent])
        other = reach.loc[near["neighbour"]].to_numpy()
        return rows(here, 1 / (_mean(near, np.maximum(other, near["distance"].to_numpy())) + 1e-10))

    def factors(here: pd.DataFrame, near: pd.DataFrame, sent: pd.Series) -> pd.DataFrame:
        around = _mean(near, sent.loc[near["neighbour"]].to_numpy())
        return rows(here, around / sent.loc[around.index])

    reach = written(_per_cell(placed, others, k, distances, schema), "reach")
    own = F.col("value") >= 0
    wanted = reach.where(~own).select("cell", "point")
    sent = wanted.join(reach.where(own).select("point", "value"), "point")
    density = written(_per_cell(placed, others, k, densities, schema, sent), "density")
    sent = density.unionByName(wanted.join(density.select("point", "value"), "point").select(*density.columns))
    out = _per_cell(placed, others, k, factors, schema, sent)
    return points.join(out.select("point", F.col("value").alias("outlier_factor")), "point")


# -- both -------------------------------------------------------------------------------------


def _unit(value: str) -> Column:
    low, high = F.col(f"low_{value}"), F.col(f"high_{value}")
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(value) - low) / (high - low))


def ensemble_score(works: DataFrame, as_of: Column) -> DataFrame:
    """``ensemble`` in [0, 1] per point: the mean of both signals, each scaled to its range."""
    points = feature_points(works, as_of)
    if (points.agg(F.sum("weight")).first()[0] or 0) < 2:
        return points.select(*POINT, F.lit(0.0).alias("ensemble"))
    lof = local_outlier_factor(points).select("point", "outlier_factor")
    both = written(isolation_forest(points, anomaly_features(works, as_of)).join(lof, "point"), "signals")
    signals = ("isolation", "outlier_factor")
    ranges = both.agg(
        *[fn(s).alias(f"{label}_{s}") for s in signals for label, fn in (("low", F.min), ("high", F.max))]
    )
    mean = (_unit(signals[0]) + _unit(signals[1])) / 2
    return both.crossJoin(F.broadcast(ranges)).select(*POINT, mean.alias("ensemble"))  # one row
