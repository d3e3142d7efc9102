"""Random forests grown on Spark: the top of each tree by sums over all rows, each subtree by a task that also takes the rows to be judged to its leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bagged rows of a node that one task takes over; nodes of more are split by sums over all tasks.
ROWS = 50_000
#: Bins of a feature, of about equal weight; parts of each class's values by which weights are found.
BINS, CELLS = 32, 256
#: Weights and votes are whole parts of these, so that their sums are exact in any order.
WEIGHT_PARTS, VOTE_PARTS = 1 << 20, 1 << 30
# Chances of 0, 1, 2, ... at most in a Poisson distribution of mean 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_of(seed: int, tree: int) -> np.ndarray:
    return _mixed(np.array([seed * 1_000_003 + tree], np.uint64))


def children(paths: np.ndarray) -> np.ndarray:
    """Names of the two children of each node, one behind the other."""
    return _mixed(np.repeat(paths, 2) ^ np.tile(np.array([0x5851F42D, 0x14057B7E], np.uint64), len(paths)))


def drawn(paths: np.ndarray, features: int) -> np.ndarray:
    """The features that a node may be split by, drawn by its name: the root of their number, rounded up."""
    lots = _mixed(paths[:, None] + _mixed(np.arange(features))[None, :])
    return np.argsort(lots, axis=1, kind="stable")[:, : int(np.ceil(np.sqrt(features)))]


def bagged(bag: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree takes each row: Poisson of mean 1 by a hash of row and tree."""
    return np.searchsorted(POISSON, _mixed(bag + _mixed(np.array([tree + 1]))) / 2.0**64, side="right")


def purity(sums: np.ndarray) -> np.ndarray:
    """Sum of squares over sum: what a split raises most where Gini's impurity falls most."""
    return (sums * sums).sum(-1) / np.maximum(sums.sum(-1), 1e-300)


def gains(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    found = purity(left) + purity(whole - left) - purity(whole)
    return np.where(found > 1e-9 * whole.sum(-1), found, 0.0)


@dataclass
class Top:
    """The top of a tree: for each node its name, feature (-1: none), last bin to the left, left child (the right one follows), and the class sums of a node that stays a leaf for good."""

    paths: list[int]
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    leaf: dict[int, np.ndarray] = field(default_factory=dict)

    def node(self, x: np.ndarray) -> np.ndarray:
        """The node of the top that each row comes to."""
        feature, last, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            own = at[rows]
            at[rows] = left[own] + (x[rows, feature[own]] > last[own])
            rows = rows[feature[at[rows]] >= 0]
        return at


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, judged: np.ndarray, path: int, depth: int, classes: int) -> np.ndarray:
    """Shares of the classes in the leaf that each judged row comes to, in a tree grown on rows x (bins) of classes y with weights w.

    Level by level, all nodes at once: rows are sorted by node and bin of a drawn feature, and every place where the bin
    changes inside a node is a split. A level costs the rows that lie in nodes which can still be split.
    """
    out = np.zeros((len(judged), classes))
    if not len(x):
        return out
    paths, at, where, seen = np.array([path], np.uint64), np.zeros(len(x), np.int64), np.zeros(len(judged), np.int64), np.arange(len(judged))
    for level in range(depth + 1):
        whole = np.bincount(at * classes + y, weights=w, minlength=len(paths) * classes).reshape(-1, classes)
        best, feature, last = np.zeros(len(paths)), np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        if level < depth:
            choice = drawn(paths, x.shape[1])
            open_ = np.flatnonzero(((whole > 0).sum(1) > 1)[at])
            for slot in range(choice.shape[1]) if len(open_) else ():
                own = at[open_]
                key = own * BINS + x[open_, choice[own, slot]]
                order = np.argsort(key, kind="stable")
                key, rows = key[order], open_[order]
                node = key // BINS
                upto = np.cumsum(np.where(y[rows][:, None] == np.arange(classes), w[rows][:, None], 0.0), axis=0)
                heads = np.flatnonzero(np.diff(node, prepend=-1))
                before = np.zeros((len(paths), classes))
                before[node[heads[1:]]] = upto[heads[1:] - 1]
                cuts = np.flatnonzero((key[1:] != key[:-1]) & (node[1:] == node[:-1]))
                if not len(cuts):
                    continue
                of = node[cuts]
                gain = gains(upto[cuts] - before[of], whole[of])
                firsts = np.flatnonzero(np.diff(of, prepend=-1))
                most = np.maximum.reduceat(gain, firsts)
                reached = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(firsts, len(of)))))
                nodes, places = np.unique(of[reached], return_index=True)
                better = most > best[nodes]
                nodes, cut = nodes[better], cuts[reached[places[better]]]
                best[nodes], feature[nodes], last[nodes] = most[better], choice[nodes, slot], key[cut] % BINS
        split = best > 0
        stays = ~split[where]
        out[seen[stays]] = whole[where[stays]] / whole[where[stays]].sum(1, keepdims=True)
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        here, there = split[at], ~stays
        x, y, w, at, seen, where = x[here], y[here], w[here], at[here], seen[there], where[there]
        at = 2 * rank[at] + (x[np.arange(len(x)), feature[at]] > last[at])
        where = 2 * rank[where] + (judged[seen, feature[where]] > last[where])
        paths = children(paths[split])
    return out


def _bins(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]).astype(np.uint8)


def _number(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _edges(known: DataFrame, cells: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """Of each feature's cells (last values of them) those that divide it into BINS bins of about equal weight."""
    names = list(cells)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(cells[c]) + 1) for c in names]
        for batch in batches:
            w = _number(batch, "w")
            for c, sums in zip(names, total, strict=True):
                sums += np.bincount(np.searchsorted(cells[c], _number(batch, c)), weights=w, minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], names=["sums"])

    sums = sum(np.frombuffer(r["sums"], float) for r in known.mapInArrow(weigh, "sums binary").collect())
    edges = {}
    for c, own in zip(names, np.split(sums, np.cumsum([len(cells[c]) + 1 for c in names])[:-1]), strict=True):
        upto = np.cumsum(own)
        at = np.searchsorted(upto, np.arange(1, BINS) / BINS * upto[-1])
        edges[c] = [float(v) for v in cells[c][np.unique(at[at < len(cells[c])])]]
    return edges


def predict_forest(train: DataFrame, test: DataFrame, columns: list[str], label: str, weight: str, key: list[str], scratch: str, trees: int = 100, depth: int = 30, seed: int = 42) -> DataFrame:
    """test with `predicted`, by a forest grown on train: Gini's impurity, 32 bins of equal weight a feature, the root of the features drawn a node, Poisson bags, shares of the leaves summed.

    A forest without a limit of leaves is about as large as all its bags together, so it is never brought together:
    every row goes to the task of each tree's subtree, and rows to be judged come back with the shares of their leaf.
    Work and shuffles: trees times rows. The driver holds the tops of the trees, some rows a node of over ROWS rows.
    Draws hang on `key` (of train) and node names, sums are whole numbers: results do not hang on ROWS, nor on
    partitions but by the bins, whose quantiles are approximate (1/10,000 of a class).
    Rows to be judged with a label that train has not are left out, and with a null feature have no prediction.
    scratch: a folder that driver and executors share.
    """
    spark, n, names = train.sparkSession, len(columns), [f"x{i}" for i in range(len(columns))]
    known = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("string").alias("y"), F.round(F.col(weight) * WEIGHT_PARTS).cast("double").alias("w"), F.xxhash64(*key).alias("bag")).dropna().where("w > 0")
    known.write.parquet(f"{scratch}/known")
    known = spark.read.parquet(f"{scratch}/known")
    found = known.groupBy("y").agg(F.count("*").alias("n"), *[F.percentile_approx(c, [k / CELLS for k in range(1, CELLS)], 10_000).alias(c) for c in names]).orderBy("y").collect()
    classes, size = [r["y"] for r in found], sum(r["n"] for r in found)
    test.where(F.col(label).isin(classes)).withColumn("__id", F.monotonically_increasing_id()).write.parquet(f"{scratch}/judged")
    judged = spark.read.parquet(f"{scratch}/judged")
    if not classes:
        return judged.drop("__id").withColumn("predicted", F.lit(None).cast("string"))
    edges = _edges(known, {c: np.unique([v for r in found for v in r[c]]) for c in names})
    binned = lambda c, of: F.coalesce(*[F.when(F.col(of) <= e, F.lit(k)) for k, e in enumerate(edges[c])], F.lit(len(edges[c]))).cast("int").alias(c) if edges[c] else F.lit(0).alias(c)
    numbers = F.coalesce(*[F.when(F.col("y") == c, F.lit(k)) for k, c in enumerate(classes)], F.lit(0)).cast("int")
    rows = known.select(*[binned(c, c) for c in names], numbers.alias("y"), "w", "bag")
    asked = judged.dropna(subset=columns).select(*[binned(c, o) for c, o in zip(names, columns, strict=True)], "__id")
    tops = _tops(rows, size, n, len(classes), trees, depth, seed)
    shared = spark.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch, tree and node below the top: the rows in one piece."""
        for batch in batches:
            x, learns = _bins(batch, n), "bag" in batch.schema.names
            if learns:
                bag, w, y = _number(batch, "bag").view(np.uint64), _number(batch, "w"), _number(batch, "y").astype(np.uint8)
            else:
                ids = _number(batch, "__id")
            for tree, top in enumerate(shared.value):
                own, at = np.arange(len(x)), top.node(x)
                if learns:
                    times = bagged(bag, tree)
                    own = own[times > 0]
                own = own[~np.isin(at[own], list(top.leaf))] if top.leaf else own
                own = own[np.argsort(at[own], kind="stable")]
                heads = np.flatnonzero(np.diff(at[own], prepend=-1))
                pieces = np.split(own, heads[1:]) if len(own) else []
                if pieces:
                    blobs = [x[p].tobytes() + (y[p].tobytes() + (w[p] * times[p]).tobytes() if learns else ids[p].tobytes()) for p in pieces]
                    columns_ = [pa.array([tree] * len(pieces), pa.int32()), pa.array(at[own[heads]].astype(np.int32)), pa.array([learns] * len(pieces)), pa.array([len(p) for p in pieces], pa.int32()), pa.array(blobs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns_, names=["tree", "node", "learns", "n", "piece"])

    def subtree(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        parts = {True: [], False: []}
        for learns, m, piece in zip(table["learns"].to_pylist(), table["n"].to_pylist(), table["piece"].to_pylist(), strict=True):
            x = np.frombuffer(piece, np.uint8, m * n).reshape(m, n)
            parts[learns].append((x, np.frombuffer(piece, np.uint8, m, m * n), np.frombuffer(piece, np.float64, m, m * (n + 1))) if learns else (x, np.frombuffer(piece, np.int64, m, m * n)))
        if not parts[False]:
            return votes(np.zeros(0, np.int64), np.zeros((0, len(classes))))
        asked_x, ids = map(np.concatenate, zip(*parts[False], strict=True))
        x, y, w = map(np.concatenate, zip(*parts[True], strict=True)) if parts[True] else (np.zeros((0, n), np.uint8), np.zeros(0, np.uint8), np.zeros(0))
        top = shared.value[tree]
        return votes(ids, grow(x, y.astype(np.int64), w, asked_x, top.paths[node], depth - top.depth[node], len(classes)))

    def votes(ids: np.ndarray, shares: np.ndarray) -> pa.Table:
        whole = np.rint(shares * VOTE_PARTS).astype(np.int64)
        return pa.table({"__id": ids} | {f"v{k}": whole[:, k] for k in range(len(classes))})

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Votes of the leaves that the tops have, summed over the trees."""
        for batch in batches:
            x, total = _bins(batch, n), np.zeros((batch.num_rows, len(classes)), np.int64)
            for top in shared.value:
                at = top.node(x) if top.leaf else None
                for node, sums in top.leaf.items():
                    total[at == node] += np.rint(sums / sums.sum() * VOTE_PARTS).astype(np.int64)
            yield from pa.table({"__id": _number(batch, "__id")} | {f"v{k}": total[:, k] for k in range(len(classes))}).to_batches()

    piece = "tree int, node int, learns boolean, n int, piece binary"
    vote = ", ".join(["__id long", *(f"v{k} long" for k in range(len(classes)))])
    cast = rows.mapInArrow(deal, piece).unionByName(asked.mapInArrow(deal, piece)).groupBy("tree", "node").applyInArrow(subtree, vote)
    if any(top.leaf for top in tops):
        cast = cast.unionByName(asked.mapInArrow(at_once, vote))
    totals = cast.groupBy("__id").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(classes))])
    best = F.greatest(*[F.col(f"v{k}") for k in range(len(classes))]) if len(classes) > 1 else F.col("v0")
    predicted = F.coalesce(*[F.when(F.col(f"v{k}") == best, F.lit(c)) for k, c in enumerate(classes)])
    return judged.join(totals.select("__id", predicted.alias("predicted")), "__id", "left").drop("__id")


def _tops(rows: DataFrame, size: int, n: int, classes: int, trees: int, depth: int, seed: int) -> list[Top]:
    """The tops of all trees, a level at a time, while a node has over ROWS bagged rows. Each pass sends a split a node to the driver."""
    tops = [Top([int(root_of(seed, tree)[0])]) for tree in range(trees)]
    large = [(tree, 0) for tree in range(trees)] if size > ROWS else []
    while large:
        found, large = _level(rows, tops, large, n, classes), []
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            top, node = tops[r["tree"]], r["node"]
            if r["feature"] < 0 or top.depth[node] >= depth:
                top.leaf[node] = np.frombuffer(r["whole"], float)
                continue
            top.feature[node], top.bin[node], top.left[node] = r["feature"], r["bin"], len(top.paths)
            for side, (path, rows_there) in enumerate(zip(children(np.array([top.paths[node]], np.uint64)).tolist(), (r["left"], r["right"]), strict=True)):
                if rows_there > ROWS:
                    large.append((r["tree"], top.left[node] + side))
                top.paths.append(path)
                for values, new in ((top.feature, -1), (top.bin, 0), (top.left, 0), (top.depth, top.depth[node] + 1)):
                    values.append(new)
    return tops


def _level(rows: DataFrame, tops: list[Top], large: list[tuple[int, int]], n: int, classes: int) -> list:
    """The best split of each large node, with the numbers of rows on its sides and its class sums."""
    shared = rows.sparkSession.sparkContext.broadcast((tops, large))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each large node: weights and numbers of rows by drawn feature, bin and class."""
        known, wanted = shared.value
        total = {at: 0 for at in wanted}
        nodes = {tree: [v for t, v in wanted if t == tree] for tree, _ in wanted}
        for batch in batches:
            x, y, w, bag = _bins(batch, n), _number(batch, "y").astype(np.int64), _number(batch, "w"), _number(batch, "bag").view(np.uint64)
            for tree, mine in nodes.items():
                times, at = bagged(bag, tree), known[tree].node(x)
                for node in mine:
                    own = np.flatnonzero((at == node) & (times > 0))
                    blocks = []
                    for f in drawn(np.array([known[tree].paths[node]], np.uint64), n)[0].tolist():
                        slot = x[own, f].astype(np.int64) * classes + y[own]
                        blocks += [np.bincount(slot, weights=w[own] * times[own], minlength=BINS * classes), np.bincount(slot, minlength=BINS * classes).astype(float)]
                    total[tree, node] = total[tree, node] + np.concatenate(blocks)
        kept = [(t, v, s.tobytes()) for (t, v), s in total.items() if not isinstance(s, int)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int32()), pa.array([k[1] for k in kept], pa.int32()), pa.array([k[2] for k in kept], pa.binary())], names=["tree", "node", "sums"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        both = sum(np.frombuffer(b, float) for b in table["sums"].to_pylist()).reshape(-1, 2, BINS, classes)
        whole, best = both[0, 0].sum(0), (0.0, -1, 0, 0, 0)
        for f, (weights, counts) in zip(drawn(np.array([shared.value[0][tree].paths[node]], np.uint64), n)[0].tolist(), both, strict=True):
            number = counts.sum(1)
            gain = np.where(number[:-1] > 0, gains(np.cumsum(weights, 0)[:-1], whole), 0.0)
            gain[np.cumsum(number)[:-1] >= number.sum()] = 0.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, int(number[: k + 1].sum()), int(number[k + 1 :].sum()))
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([best[1]], pa.int32()), "bin": pa.array([best[2]], pa.int32()), "left": [best[3]], "right": [best[4]], "whole": pa.array([whole.tobytes()], pa.binary())})

    return rows.mapInArrow(sums, "tree int, node int, sums binary").groupBy("tree", "node").applyInArrow(choose, "tree int, node int, feature int, bin int, left long, right long, whole binary").collect()
