"""Gradient boosted trees with second-order leaf weights, grown level by level from binned histograms.

Rows are binned once and stored as blocks of codes. For every level each task adds up the gradients and Hessians
of its rows per (node, feature, bin); the sums of all tasks are one aggregation, and what reaches the driver has one
row per node and bin, bounded by the model and not by the data. The finished trees become one of Spark's own
boosted models, so scoring, saving and explaining work as for any other.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratescope.runtime import scratch_path, settle

#: Rows that are binned and stored together.
BLOCK_ROWS = 1 << 15
#: Covers are stored as whole numbers of this part of a Hessian.
COVER = 1e-6


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    rows_share: float = 0.8
    columns_share: float = 0.8
    penalty: float = 1.0
    least_weight: float = 1.0
    least_gain: float = 0.0
    bins: int = 256
    seed: int = 42
    #: Rounds after which the rows' margins are written, so no task goes through more trees than this.
    written_every: int = 16


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no left child. ``cover`` is the sum of Hessians of the rows it was grown from."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for row, x in zip((self.feature, self.code, self.left, self.right, self.value, self.cover, self.gain), (-1, -1, -1, -1, float(value), float(cover), 0.0), strict=True):
            row.append(x)
        return len(self.left) - 1

    def leaves_of(self, codes: np.ndarray) -> np.ndarray:
        """The node at which each row of ``codes`` (features × rows) ends."""
        at = np.zeros(codes.shape[1], dtype=np.int64)
        feature, code, left, right = (np.array(x) for x in (self.feature, self.code, self.left, self.right))
        rows = np.arange(codes.shape[1])
        while (inner := left[at] >= 0).any():
            here = at[inner]
            goes = codes[feature[here], rows[inner]] <= code[here]
            at[inner] = np.where(goes, left[here], right[here])
        return at

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(codes)]


# --- binning ---------------------------------------------------------------------------------


def feature_cuts(numbers: DataFrame, width: int, bins: int, rows: DataFrame | None = None) -> list[np.ndarray]:
    """Per feature the borders between its bins; a row's code is the number of borders below its value.

    ``numbers`` has the features as array x. A scan finds the features that are only 0 and 1, which need no sketch.
    Borders lie halfway between neighbouring values of the sketch, so up to ``bins`` different values have a bin each.
    If ``numbers`` are different rows with weights, ``rows`` are all rows: only features with more than ``bins`` values
    are sketched, from these.
    """
    switch = F.transform("x", lambda v: F.when((v == 0) | (v == 1), F.lit(0)).otherwise(F.lit(1)))
    other = [F.max(F.get("s", F.lit(i))).alias(f"f{i}") for i in range(width)]
    found = numbers.select(switch.alias("s")).agg(*other).first()
    wide = [i for i in range(width) if found[i]]
    cuts = [np.array([0.5])] * width

    def pairs(features):
        return F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.get("x", F.lit(i)).cast("double").alias("value")) for i in features]))

    if wide and rows is not None:
        values = settle(numbers.select(pairs(wide)).distinct())
        few = [r["feature"] for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= bins).collect()]
        found = values.where(F.col("feature").isin(*few)).toPandas() if few else None
        for i in few:
            own = np.sort(found["value"][found["feature"] == i].to_numpy())
            cuts[i] = (own[1:] + own[:-1]) / 2
        wide, numbers = [i for i in wide if i not in few], rows
    if wide:
        grid = [i / bins for i in range(bins + 1)]
        sketches = numbers.select(pairs(wide)).groupBy("feature").agg(F.percentile_approx("value", grid, 40 * bins).alias("q"))
        for row in sketches.collect():
            values = np.unique(row["q"])
            cuts[row["feature"]] = (values[1:] + values[:-1])[: bins - 1] / 2
    return cuts


def _blocks(numbers: DataFrame, cuts: list[np.ndarray], start: float) -> DataFrame:
    """(block, rows, codes, labels, margins, weights): up to BLOCK_ROWS rows each, the codes feature by feature."""
    kind = np.dtype(np.uint8) if max(len(c) for c in cuts) < 256 else np.dtype(np.uint16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(kind)
                labels = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                margins = np.full(part.num_rows, start)
                weights = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                columns = [[number], [part.num_rows], *[[v.tobytes()] for v in (codes, labels, margins, weights)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)],
                    names=["block", "rows", "codes", "labels", "margins", "weights"],
                )
                number += 1

    return settle(numbers.mapInArrow(cut, "block long, rows long, codes binary, labels binary, margins binary, weights binary"))


def _read(batch: pa.RecordBatch, k: int, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    block, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
    raw = [np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint8) for c in (2, 3, 4, 5)]
    codes = raw[0].view(np.uint8 if len(raw[0]) == rows * width else np.uint16).reshape(width, rows)
    return block, codes, raw[1], raw[2].view(np.float64), raw[3].view(np.int64)


def _advanced(blocks: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The blocks with the trees' values added to their margins, written."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for k in range(batch.num_rows):
                _, codes, _, margins, _ = _read(batch, k, width)
                new.append((margins + sum(t.values_of(codes) for t in trees)).tobytes())
            yield batch.set_column(4, "margins", pa.array(new, pa.binary()))

    return settle(blocks.mapInArrow(advance, blocks.schema))


# --- one tree --------------------------------------------------------------------------------


def _histograms(blocks: DataFrame, earlier: list[Tree], tree: Tree, nodes: list[int], columns: np.ndarray, offsets: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """Sums of gradients and Hessians, nodes × bins × 2, over the rows that this round draws."""
    width, cells = len(offsets) - 1, int(offsets[-1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.left), -1)
        place[nodes] = np.arange(len(nodes))
        sums = np.zeros((2, len(nodes) * cells))
        for batch in batches:
            for k in range(batch.num_rows):
                block, codes, labels, margins, weights = _read(batch, k, width)
                # of the equal rows that one stands for, each is drawn on its own
                drawn = np.random.Generator(np.random.Philox(key=[s.seed, (number << 40) + block % (1 << 40)])).binomial(weights, s.rows_share)
                at = place[tree.leaves_of(codes)]
                used = np.flatnonzero((drawn > 0) & (at >= 0))
                codes, at, drawn = codes[:, used], at[used], drawn[used]
                margin = margins[used] + sum(t.values_of(codes) for t in earlier)
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                for i, weight in enumerate((drawn * (p - labels[used]), drawn * p * (1 - p))):
                    for f in columns:
                        cell = at * cells + offsets[f] + codes[f]
                        sums[i] += np.bincount(cell, weights=weight, minlength=sums.shape[1])
        full = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[0][full]), pa.array(sums[1][full])], names=["cell", "g", "h"])

    parts = blocks.mapInArrow(add, "cell long, g double, h double")
    total = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((len(nodes) * cells, 2))
    out[total["cell"].to_numpy()] = total[["g", "h"]].to_numpy()
    return out.reshape(len(nodes), cells, 2)


def best_split(sums: np.ndarray, columns: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, last code on the left, sums of the left side) of one node, or None.

    The gain of a split is half of what G²/(H + penalty) of both sides exceeds that of the node by. Both sides need a Hessian of
    ``least_weight``. Equal gains go to the first feature and bin.
    """
    best = None
    for f in columns:
        part = sums[offsets[f] : offsets[f + 1]]
        left = np.cumsum(part, axis=0)[:-1]
        whole = part.sum(axis=0)
        right = whole - left
        worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.penalty)
        gains = (worth(left) + worth(right) - worth(whole)) / 2
        gains[(left[:, 1] < s.least_weight) | (right[:, 1] < s.least_weight)] = -np.inf
        if len(gains) and (best is None or gains.max() > best[0] + 1e-12):
            k = int(gains.argmax())
            best = (float(gains[k]), int(f), k, left[k])
    return best if best and best[0] > max(s.least_gain, 1e-6) else None


def _grown(blocks: DataFrame, earlier: list[Tree], cuts: list[np.ndarray], number: int, s: Settings) -> Tree:
    offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    width = len(cuts)
    rng = np.random.default_rng([s.seed, number])
    columns = np.sort(rng.choice(width, max(1, round(s.columns_share * width)), replace=False))
    weight = lambda g, h: -s.rate * g / (h + s.penalty)
    tree, level = Tree(), [0]
    tree.add(0.0, 0.0)
    for depth in range(s.depth):
        sums = _histograms(blocks, earlier, tree, level, columns, offsets, number, s)
        below = []
        for node, own in zip(level, sums, strict=True):
            whole = own[offsets[columns[0]] : offsets[columns[0] + 1]].sum(axis=0)
            if not depth:
                tree.value[0], tree.cover[0] = float(weight(*whole)), float(whole[1])
            split = best_split(own, columns, offsets, s)
            if split:
                gain, f, code, left = split
                tree.feature[node], tree.code[node], tree.gain[node] = f, code, gain
                tree.left[node] = tree.add(weight(*left), left[1])
                tree.right[node] = tree.add(weight(*(whole - left)), whole[1] - left[1])
                below += [tree.left[node], tree.right[node]]
        level = below
        if not level:
            break
    return tree


# --- the model -------------------------------------------------------------------------------


def fit_trees(
    encoded: DataFrame, features: str, label: str, s: Settings, weight: str | None = None, rows: DataFrame | None = None
) -> tuple[float, list[Tree], list[np.ndarray]]:
    """The starting margin, the trees and the features' cuts. ``encoded`` may be different rows with the ``weight`` of
    each, with all ``rows`` beside them (see ``feature_cuts``)."""
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    numbers = encoded.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), n.alias("n"))
    total, share, width = numbers.select(F.sum("n"), F.sum(F.col("y") * F.col("n")) / F.sum("n"), F.max(F.size("x"))).first()
    if not total or share in (0.0, 1.0):
        raise ValueError("boosting needs rows of both classes")
    every = rows.select(vector_to_array(features).alias("x")) if weight and rows is not None else None
    cuts = feature_cuts(numbers, width, s.bins, every)
    start = float(np.log(share / (1 - share)))
    blocks, pending, trees = _blocks(numbers, cuts, start), [], []
    for number in range(s.rounds):
        if len(pending) == s.written_every:
            blocks, pending = _advanced(blocks, pending, width), []
        tree = _grown(blocks, pending, cuts, number, s)
        trees.append(tree)
        pending.append(tree)
    if len(trees) != s.rounds:
        raise RuntimeError(f"{len(trees)} of {s.rounds} rounds were completed")
    return start, trees, cuts


def as_spark_model(spark: SparkSession, start: float, trees: list[Tree], cuts: list[np.ndarray], features: str, label: str, s: Settings) -> GBTClassificationModel:
    """The trees as a model of Spark's, whose margin is half of theirs (its link doubles it).

    A one-row model of the same width is saved for its format, its trees are replaced by these, and the result is
    loaded. The first tree is a leaf with the starting margin.
    """
    shape, path = scratch_path(spark, "shape"), scratch_path(spark, "boosted")
    rows = [(Vectors.sparse(len(cuts), {0: float(k)}), float(k)) for k in (0, 1)]
    small = GBTClassifier(maxIter=1, maxDepth=1, featuresCol=features, labelCol=label, stepSize=s.rate, seed=s.seed)
    small.fit(spark.createDataFrame(rows, [features, label])).write().save(shape)
    first = Tree()
    first.add(start, 0.0)
    nodes = []
    for number, tree in enumerate([first, *trees]):
        # Spark numbers nodes in the order in which a walk to the left meets them
        stack, order = [0], []
        while stack:
            node = stack.pop()
            order.append(node)
            if tree.left[node] >= 0:
                stack += [tree.right[node], tree.left[node]]
        place = {node: k for k, node in enumerate(order)}
        for node in order:
            inner = tree.left[node] >= 0
            split = (tree.feature[node], [float(cuts[tree.feature[node]][tree.code[node]])], -1) if inner else (-1, [], -1)
            cover = round(tree.cover[node] / COVER)
            children = (place[tree.left[node]], place[tree.right[node]]) if inner else (-1, -1)
            nodes.append((number, (place[node], tree.value[node] / 2, 0.0, [0.0, 0.0, 0.0], cover, tree.gain[node] if inner else -1.0, *children, split)))
    saved = spark.read.parquet(f"{shape}/data")
    spark.createDataFrame(nodes, saved.schema).coalesce(1).write.parquet(f"{path}/data")
    about = spark.read.parquet(f"{shape}/treesMetadata")  # tree, its description, weight
    description = about.first()[1]
    described = spark.createDataFrame([(k, description, 1.0) for k in range(len(trees) + 1)], about.schema)
    described.coalesce(1).write.parquet(f"{path}/treesMetadata")
    metadata = json.loads(spark.read.text(f"{shape}/metadata").first()[0])
    metadata["paramMap"] |= {"maxIter": s.rounds, "maxDepth": s.depth, "maxBins": max(2, s.bins)}
    metadata |= {"numTrees": len(trees) + 1, "numFeatures": len(cuts)}
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)


@dataclass(frozen=True)
class SecondOrder:
    """Boosted trees whose leaves weigh -G / (H + penalty), with shrinkage, rows drawn per round and columns per tree.

    ``fit`` takes rows with a vector and a label of 0 or 1. The margin starts at the logit of the positive share. The result
    depends on the seed and on how the rows are dealt over partitions; rows with the same features are
    drawn one by one, also where they are one row with a ``weight``. Both classes must occur.
    """

    features: str
    label: str
    settings: Settings
    weight: str | None = None

    def fit(self, encoded: DataFrame, rows: DataFrame | None = None) -> GBTClassificationModel:
        start, trees, cuts = fit_trees(encoded, self.features, self.label, self.settings, self.weight, rows)
        return as_spark_model(encoded.sparkSession, start, trees, cuts, self.features, self.label, self.settings)


# Tasks get these helpers with the function itself, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
