"""Forests of many deep trees on dense features, without a model on the driver.

All trees grow together, level by level, while a node has more rows than one task should hold: parts of the rows count their bins, the counts are
added up by tree, and only the splits reach the driver. Then the rows of a node go to one task, which grows the rest
of its tree and scores the rows that are to be scored, so trees are never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.metrics import class_weights
from corpusloom.sources.scratch import forget, stored

BINS = 32
"""Bins of a feature, by quantiles."""
NODE_ROWS = 20_000
"""Drawn rows up to which a node is finished by one task."""
PART_ROWS = 50_000
"""Rows of which one task counts bins."""
TREE_ROWS = 20_000_000
"""Trees times rows that are dealt to nodes at a time, about a hundred bytes each."""
SCALE = 1 << 40
"""Probabilities are added up as whole numbers of this part, so that sums don't depend on their order."""


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, for each of some other 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(seed: int, tree: int) -> np.uint64:
    return _mixed(np.array([seed * 1_000_003 + tree + 1], dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


#: What a Poisson variable of mean 1 exceeds, by a uniform one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def drawn(hashes: np.ndarray, key: np.uint64) -> np.ndarray:
    """How often a tree's bootstrap sample has each row: a Poisson number of mean 1, by the hash of the row."""
    return np.searchsorted(_POISSON, (_mixed(hashes ^ key) >> np.uint64(11)) / float(1 << 53), side="right")


def subsets(ids: np.ndarray, key: np.uint64, n_features: int, k: int) -> np.ndarray:
    """The k features, in order, among which each node may split."""
    if k >= n_features:
        return np.tile(np.arange(n_features), (len(ids), 1))
    mixed = _mixed(_mixed(ids.astype(np.uint64) ^ key)[:, None] + np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(mixed, k, axis=1)[:, :k], axis=1)


def counted(bins: np.ndarray, label: np.ndarray, times: np.ndarray, node: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Drawn rows by node, place in the node's features, bin and label, flat."""
    n, k = features.shape
    cell = (node[:, None] * k + np.arange(k)) * BINS + np.take_along_axis(bins, features[node], axis=1)
    return np.bincount((cell * 2 + label[:, None]).ravel(), weights=np.repeat(times, k), minlength=n * k * BINS * 2).astype(np.int64)


def best_splits(counts: np.ndarray, features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none gains), the last bin on the left, and the drawn rows on the left by label, of each node. Ties: the lower feature and bin."""
    n, k = features.shape
    c = counts.reshape(-1, 2)
    cell = np.flatnonzero(c.any(axis=1))
    c, place = c[cell], cell // BINS
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sums = c.cumsum(axis=0)
    before = np.repeat(sums[first] - c[first], np.diff(np.r_[first, len(cell)]), axis=0)
    left = sums - before
    total = np.repeat(np.add.reduceat(c, first, axis=0), np.diff(np.r_[first, len(cell)]), axis=0)
    right = total - left

    def impure(x):
        w = x * weights
        s = w.sum(axis=1)
        return s - (w * w).sum(axis=1) / np.where(s > 0, s, 1)

    gain = np.where(right.any(axis=1), impure(total) - impure(left) - impure(right), 0.0)
    node = place // k
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    top = np.maximum.reduceat(gain, starts)
    at = np.flatnonzero((gain == np.repeat(top, np.diff(np.r_[starts, len(cell)]))) & (gain > 1e-9))
    found, which = np.unique(node[at], return_index=True)
    at = at[which]
    feature, last, lefts = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros((n, 2), dtype=np.int64)
    feature[found] = features[found, place[at] % k]
    last[found], lefts[found] = cell[at] % BINS, left[at]
    return feature, last, lefts


def probability(totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of label 1, by drawn rows of both labels."""
    w = totals * weights
    return w[:, 1] / np.maximum(w.sum(axis=1), 1e-300)


def finish(bins: np.ndarray, label: np.ndarray, times: np.ndarray, root: int, key: np.uint64, weights: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Grows the tree below one node to the end, on rows with times > 0, and gives all rows the probability of their leaf. root: 1 for the tree's, 2i and 2i + 1 below i."""
    p = np.zeros(len(bins))
    rows, node, ids = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), np.array([root], dtype=np.int64)
    for level in range(root.bit_length() - 1, depth + 1):
        train = times[rows] > 0
        r, at = rows[train], node[train]
        totals = np.bincount(at * 2 + label[r], weights=times[r], minlength=2 * len(ids)).reshape(-1, 2)
        split, last = np.full(len(ids), -1), np.zeros(len(ids), dtype=np.int64)
        mixed = np.flatnonzero(totals.all(axis=1)) if level < depth else np.array([], dtype=np.int64)
        if len(mixed):
            place = np.full(len(ids), -1)
            place[mixed] = np.arange(len(mixed))
            inside = place[at] >= 0
            features = subsets(ids[mixed], key, bins.shape[1], k)
            r, at = r[inside], place[at[inside]]
            split[mixed], last[mixed], _ = best_splits(counted(bins[r], label[r], times[r], at, features), features, weights)
        ended = split[node] < 0
        p[rows[ended]] = probability(totals, weights)[node[ended]]
        rows, node = rows[~ended], node[~ended]
        if not len(rows):
            break
        parents = np.flatnonzero(split >= 0)
        right = bins[rows, split[node]] > last[node]
        node = 2 * np.searchsorted(parents, node) + right
        ids = np.stack([2 * ids[parents], 2 * ids[parents] + 1], axis=1).ravel()
    return p


@dataclass
class Top:
    """The upper nodes of one tree: what they split by (-1: nothing), their left child, and whether rows below are still to be split."""

    ids: list[int] = field(default_factory=lambda: [1])
    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    p: list[float] = field(default_factory=lambda: [0.0])
    large: list[bool] = field(default_factory=lambda: [True])
    leaf: list[bool] = field(default_factory=lambda: [False])

    def split(self, node: int, feature: int, last: int, totals: np.ndarray, weights: np.ndarray, depth: int, most: int) -> None:
        """totals: the drawn rows of both children by label."""
        self.feature[node], self.last[node], self.left[node], self.large[node] = feature, last, len(self.ids), False
        for side in (0, 1):
            child = 2 * self.ids[node] + side
            leaf = not totals[side].all() or child.bit_length() - 1 >= depth
            self.ids.append(child)
            self.feature.append(-1)
            self.last.append(0)
            self.left.append(0)
            self.p.append(float(probability(totals[side : side + 1], weights)[0]))
            self.leaf.append(leaf)
            self.large.append(not leaf and int(totals[side].sum()) > most)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The lowest of these nodes in which each row is."""
        feature, last, left = np.array(self.feature), np.array(self.last), np.array(self.left)
        node, moving = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while len(moving := moving[feature[node[moving]] >= 0]):
            f = node[moving]
            node[moving] = left[f] + (bins[moving, feature[f]] > last[f])
        return node


_BINNED = pa.schema([("pos", pa.int64()), ("hash", pa.int64()), ("label", pa.int8()), ("bins", pa.binary())])


def _binned(thresholds: list[list[float]]):
    """pos, hash, label and the bin of each feature as a byte; the last bin has what is above all thresholds."""
    edges = [np.array(t) for t in thresholds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("hash"), b.column("label"), pa.array([r.tobytes() for r in bins], pa.binary())], schema=_BINNED)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """pos, hash, label (-1: to be scored) and bins of a part."""
    if not (some := [b for b in batches if b.num_rows]):
        return None
    t = pa.Table.from_batches(some)
    bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
    return t.column("pos").to_numpy(), t.column("hash").to_numpy().view(np.uint64), t.column("label").to_numpy().astype(np.int64), bins


_COUNTS = pa.schema([("tree", pa.int32()), ("counts", pa.binary())])


def _level(tops: dict[int, Top], seed: int, k: int):
    """tree and the counts of its large nodes' bins in a part."""

    def run(batches):
        if (part := _rows(batches)) is None:
            return
        _, hashes, label, bins = part
        for tree, top in tops.items():
            key = _key(seed, tree)
            times, node, large = drawn(hashes, key), top.route(bins), np.flatnonzero(top.large)
            place = np.full(len(top.ids), -1)
            place[large] = np.arange(len(large))
            r = np.flatnonzero((times > 0) & (place[node] >= 0))
            features = subsets(np.array(top.ids)[large], key, bins.shape[1], k)
            made = counted(bins[r], label[r], times[r], place[node[r]], features).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([made.tobytes()], pa.binary())], schema=_COUNTS)

    return run


_SPLITS = "tree int, node int, feature int, last int, totals array<bigint>"


def _splits(tops: dict[int, Top], seed: int, n_features: int, k: int, weights: np.ndarray):
    """The best split of each large node of a tree, and the drawn rows of the children (the node itself, if nothing gains) by label."""

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        top, counts = tops[tree], 0
        for c in table.column("counts"):
            counts = counts + np.frombuffer(c.as_buffer(), dtype=np.int32).astype(np.int64)
        large = np.flatnonzero(top.large)
        features = subsets(np.array(top.ids)[large], _key(seed, tree), n_features, k)
        feature, last, left = best_splits(counts, features, weights)
        total = counts.reshape(len(large), k, BINS, 2)[:, 0].sum(axis=1)
        return pa.table({
            "tree": pa.array([tree] * len(large), pa.int32()), "node": pa.array(large, pa.int32()), "feature": pa.array(feature, pa.int32()), "last": pa.array(last, pa.int32()),
            "totals": pa.array(np.concatenate([left, total - left], axis=1).tolist(), pa.list_(pa.int64())),
        })

    return run


_DEALT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("pos", pa.binary()), ("label", pa.binary()), ("times", pa.binary()), ("bins", pa.binary()), ("p", pa.binary())])


def _dealt(tops: dict[int, Top], seed: int):
    """The rows of a part by tree and open node; what is in leaves already comes with probabilities, summed over the trees, under tree -1."""

    def run(batches):
        if (part := _rows(batches)) is None:
            return
        pos, hashes, label, bins = part
        score, ended = label < 0, np.zeros(len(pos), dtype=np.int64)

        def put(tree, node, r, times, p=None):
            blobs = (pos[r][label[r] < 0], label[r].astype(np.int8), times.astype(np.uint8), bins[r], p if p is not None else pos[:0])
            return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], schema=_DEALT)

        for tree, top in tops.items():
            node, leaf = top.route(bins), np.array(top.leaf)
            times = np.where(score, 0, drawn(hashes, _key(seed, tree)))
            here = score & leaf[node]
            ended[here] += np.rint(np.array(top.p)[node[here]] * SCALE).astype(np.int64)
            r = np.flatnonzero((score | (times > 0)) & ~leaf[node])
            r = r[np.argsort(node[r], kind="stable")]
            at = node[r]
            for i, j in zip(*(np.r_[0, cuts], np.r_[cuts, len(r)]) if len(r) and (cuts := np.flatnonzero(np.diff(at)) + 1) is not None else ((), ()), strict=True):
                yield put(tree, int(at[i]), r[i:j], times[r[i:j]])
        r = np.flatnonzero(score)
        if len(r):
            yield put(-1, int(pos[r[0]] % 1_000_000), r, times[r], ended[r])

    return run


_SCORED = pa.schema([("pos", pa.int64()), ("p", pa.int64())])


def _finished(tops: dict[int, Top], seed: int, n_features: int, k: int, weights: np.ndarray, depth: int):
    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        pos = joined("pos", np.int64)
        if tree < 0:
            return pa.table({"pos": pos, "p": joined("p", np.int64)}, schema=_SCORED)
        label, times, bins = joined("label", np.int8).astype(np.int64), joined("times", np.uint8).astype(np.int64), joined("bins", np.uint8).reshape(-1, n_features)
        # The order of parts is that of their arrival; nothing below depends on it.
        p = finish(bins, label, times, tops[tree].ids[node], _key(seed, tree), weights, k, depth)
        return pa.table({"pos": pos, "p": np.rint(p[label < 0] * SCALE).astype(np.int64)}, schema=_SCORED)

    return run


def _thresholds(rows: DataFrame, n_features: int) -> list[list[float]]:
    """Up to BINS - 1 quantiles of each feature."""
    each = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j")
    parts = [i / BINS for i in range(1, BINS)]
    found = {r.j: sorted(set(r.q)) for r in each.agg(F.percentile_approx("v", parts, 10_000).alias("q")).collect()}
    return [found.get(j, []) for j in range(n_features)]


def grown_scores(train: DataFrame, rows: DataFrame, trees: int = 300, depth: int = 30, seed: int = 42, node_rows: int = NODE_ROWS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The rows with score, the probability of label 1 by a random forest: the mean of its trees.

    sqrt(features) per split, Gini impurity, balanced class weights of all rows, 32 bins, bootstrap samples by a hash of row_id, so
    the order and partitioning of rows don't matter. train: row_id, features (dense vectors of one length), label (0 or 1). rows: row_id, features.
    """
    spark = train.sparkSession
    weight = {r.label: r.weight for r in class_weights(train, "label", 2).collect()}
    weights = np.array([weight[0], weight[1]])
    x = vector_to_array("features").alias("x")
    fitted = train.where("label IS NOT NULL").select("row_id", F.col("label").cast("byte").alias("label"), x)
    n_features = fitted.select(F.size("x")).first()[0]
    n_train, n_rows = fitted.count(), rows.count()
    k = math.ceil(math.sqrt(n_features))
    # The place of a row is stored with it, and its number of trees' probabilities joined back by it.
    scored = stored(rows.withColumn("__pos", F.monotonically_increasing_id()), "scored")
    both = fitted.withColumn("pos", F.lit(-1).cast("long")).unionByName(scored.select("row_id", F.lit(-1).cast("byte").alias("label"), x, F.col("__pos").alias("pos")))
    plain = both.select("pos", F.xxhash64("row_id").alias("hash"), "label", "x").mapInArrow(_binned(_thresholds(fitted, n_features)), "pos long, hash long, label byte, bins binary")
    at_once = spark.sparkContext.defaultParallelism
    binned = stored(plain.repartition(max(at_once, math.ceil((n_train + n_rows) / PART_ROWS)), "hash"), "binned")
    parts = max(at_once, math.ceil(n_train / PART_ROWS))

    tops = {t: Top() for t in range(trees)}
    for top in tops.values():
        top.large[0] = n_train > node_rows
    while growing := {t: top for t, top in tops.items() if any(top.large)}:
        counts = binned.where("label >= 0").repartition(parts, "hash").mapInArrow(_level(growing, seed, k), "tree int, counts binary")
        found = counts.repartition(at_once, "tree").groupBy("tree").applyInArrow(_splits(growing, seed, n_features, k, weights), _SPLITS).collect()
        for r in found:
            totals, top = np.array(r.totals).reshape(2, 2), tops[r.tree]
            if r.feature < 0:
                whole = totals.sum(axis=0, keepdims=True)
                top.large[r.node], top.leaf[r.node], top.p[r.node] = False, True, float(probability(whole, weights)[0])
            else:
                top.split(r.node, r.feature, r.last, totals, weights, depth, node_rows)

    some = max(1, min(trees, tree_rows // max(1, n_train + n_rows)))
    done = []
    for first in range(0, trees, some):
        mine = {t: tops[t] for t in range(first, min(trees, first + some))}
        n_groups = max(4 * at_once, math.ceil(len(mine) * (n_train + n_rows) / 200_000))
        dealt = binned.repartition(parts, "hash").mapInArrow(_dealt(mine, seed), "tree int, node int, pos binary, label binary, times binary, bins binary, p binary")
        p = dealt.repartition(n_groups, "tree", "node").groupBy("tree", "node").applyInArrow(_finished(mine, seed, n_features, k, weights, depth), "pos long, p long")
        done.append(stored(p.groupBy("pos").agg(F.sum("p").alias("p")), "trees"))
    forget(binned)
    total = done[0]
    for more in done[1:]:
        total = total.unionByName(more)
    score = total.groupBy(F.col("pos").alias("__pos")).agg((F.sum("p") / F.lit(float(SCALE) * trees)).alias("score"))
    return scored.join(score, "__pos").select(*rows.columns, "score")
