"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.llm.common import sorted_distinct, spread_join
from ratescope.llm.components import components
from ratescope.runtime import settle

#: Vectors by which a node is judged dense.
PROBE = 128
#: A task splits nodes of so many leaves' vectors at most by itself, and of so many bytes at most in double precision.
TASK_LEAVES, TASK_BYTES = 32, 64 << 20
#: Links that a task holds before it hands them on.
TASK_LINKS = 1 << 20


@lru_cache(maxsize=4096)
def _direction(tree: int, node: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, node, size]).standard_normal(size)


def near_share(vectors: np.ndarray, least: float) -> float:
    """The share of the pairs of different rows whose cosine is ``least`` or more."""
    n = len(vectors)
    return (np.count_nonzero(vectors @ vectors.T >= least) - n) / max(1, n * (n - 1))


def grow_tree(
    sample: np.ndarray, tree: int, spill: float, leaf: int, seed: int, least: float, dense: float, top: int = 1
) -> tuple[dict[int, tuple[float, float]], list[np.ndarray]]:
    """Node number -> (low, high) of a tree over a sample, and the rows of each leaf; node k has the children 2 k and 2 k + 1, the first is ``top``.

    A node projects its vectors on a random direction. Those up to ``high`` go left and those from ``low``
    go right; between lies the ``spill`` share of them around the median, which goes both ways. A node
    is a leaf if it has ``leaf`` vectors or fewer, or if the share ``dense`` of the pairs of its first vectors is near.
    """
    nodes, leaves, work = {}, [], [(top, np.arange(len(sample)))]
    while work:
        node, rows = work.pop()
        if len(rows) <= leaf or node >= 1 << 40 or near_share(sample[rows[:PROBE]], least) >= dense:
            leaves.append(rows)
            continue
        along = sample[rows] @ _direction(tree, node, sample.shape[1], seed)
        low, high = np.quantile(along, [0.5 - spill / 2, 0.5 + spill / 2])
        left, right = rows[along <= high], rows[along >= low]
        if len(left) == len(rows) or len(right) == len(rows):
            leaves.append(rows)
            continue
        nodes[node] = (float(low), float(high))
        work += [(2 * node, left), (2 * node + 1, right)]
    return nodes, leaves


def _leaves(vectors: np.ndarray, tree: int, nodes: dict, seed: int) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of vectors let down a tree."""
    out, work = [], [(1, np.arange(len(vectors)))]
    while work:
        node, rows = work.pop()
        if not len(rows):
            continue
        if node not in nodes:
            out.append((node, rows))
            continue
        along = vectors[rows] @ _direction(tree, node, vectors.shape[1], seed)
        low, high = nodes[node]
        work += [(2 * node, rows[along <= high]), (2 * node + 1, rows[along >= low])]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(found: list[bytes] | np.ndarray, kind: str) -> np.ndarray:
    """Unit vectors in double precision from the bytes of vectors of one length, numbers of ``kind``."""
    return _unit(np.frombuffer(b"".join(found), dtype=kind).reshape(len(found), -1).astype("<f8"))


def _near(x: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows whose cosine is ``least`` or more, each as one number: the smaller row times the rows of ``x``, plus the larger.

    Products in single precision decide, unless one is within its rounding error of the limit: then all are made in double precision.
    """
    own = x[left].astype(np.float32)
    cosine = (own @ (own if right is left else x[right].astype(np.float32)).T).ravel()
    error = (x.shape[1] + 4) * float(np.finfo(np.float32).eps)
    near = np.flatnonzero(cosine >= least - error)
    if (cosine[near] < least + error).any():
        near = np.flatnonzero(x[left] @ x[right].T >= least)
    i, j = left[near // len(right)], right[near % len(right)]
    if right is left:
        i, j = i[i < j], j[i < j]
    return np.minimum(i, j) * len(x) + np.maximum(i, j)


def _near_within(x: np.ndarray, leaf: np.ndarray, most: int, least: float) -> Iterator[np.ndarray]:
    """``_near`` of a leaf's rows, in pairs of blocks of ``most`` of them."""
    blocks = [leaf[k : k + most] for k in range(0, len(leaf), most)]
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            yield _near(x, left, right, least)


def _split_further(placed: DataFrame, vectors: DataFrame, kind: str, most: int | Column, spill: float, seed: int, rounds: int, least: float, dense: float) -> DataFrame:
    """Split leaves of more than ``most`` vectors again, at quantiles of all their vectors.

    A leaf is final, and its tree number negative, if the share ``dense`` of the pairs of about ``PROBE`` of its vectors is near
    or if one side would keep all of its vectors.
    """
    keys = ["size", "tree", "leaf"]
    columns = ["size", "tree", "leaf", "row"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, trees, leaves = (batch.column(c).to_numpy() for c in range(3))
            values = np.empty(len(sizes))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column(4).take(pa.array(at)).to_numpy(zero_copy_only=False), kind)
                ways = [_direction(int(t), int(n) % (1 << 62), int(size), seed) for t, n in zip(trees[at], leaves[at], strict=True)]
                values[at] = np.einsum("ij,ij->i", x, np.stack(ways))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(values)], names=[*columns, "along"])

    @F.pandas_udf("double")
    def share(probes: pd.Series) -> pd.Series:
        return probes.map(lambda p: near_share(_matrix(list(p), kind), least)).astype("float64")

    for _ in range(rounds):
        sizes = placed.where("tree >= 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        large = settle(sizes)
        if large.isEmpty():
            break
        probed = placed.join(large, keys).where(F.pmod(F.xxhash64("row", F.lit(seed)), F.col("n")) < PROBE).join(vectors, "row")
        shares = probed.groupBy(*keys).agg(F.collect_list("vector").alias("probes")).select(*keys, (share("probes") >= dense).alias("final"))
        large = settle(large.join(shares, keys, "left").select(*keys, F.coalesce("final", F.lit(False)).alias("final")))
        final = placed.join(large.where("final"), keys).withColumn("tree", -2 - F.col("tree")).select(*columns)
        opened = placed.join(large.where("not final"), keys).join(vectors, "row").select(*columns, "vector")
        opened = settle(opened.mapInArrow(project, "size int, tree int, leaf long, row long, along double"))
        quantiles = F.percentile_approx("along", [0.5 - spill / 2, 0.5 + spill / 2], 1000).alias("cut")
        cuts = opened.groupBy(*keys).agg(quantiles, F.min("along").alias("least"), F.max("along").alias("most"))
        cut = opened.join(cuts.withColumn("whole", (F.col("most") <= F.col("cut")[1]) | (F.col("least") >= F.col("cut")[0])), keys)
        final = final.union(cut.where("whole").withColumn("tree", -2 - F.col("tree")).select(*columns))
        left = F.when(F.col("along") <= F.col("cut")[1], F.lit(0))
        right = F.when(F.col("along") >= F.col("cut")[0], F.lit(1))
        split = cut.where("not whole").withColumn("side", F.explode(F.array_compact(F.array(left, right))))
        split = split.withColumn("leaf", F.xxhash64("leaf", "side")).select(*columns)
        placed = settle(placed.join(large.select(*keys), keys, "left_anti").select(*columns).union(final).union(split))
    return placed


def similar_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    least: float = 0.9,
    trees: int = 12,
    spill: float = 0.15,
    leaf: int = 16,
    most_leaf: int = 1024,
    sample_rows: int = 8192,
    rounds: int = 40,
    seed: int = 7,
    dense: float = 0.1,
) -> DataFrame:
    """Vectors linked by a cosine of at least ``least``: number of links and smallest id reachable.

    Vectors of equal direction (to 12 decimals) are one class, known from an aggregate, so a vector that fills a third of all rows
    is a single row from then on. Each tree splits the classes by random directions at the median,
    with the ``spill`` share around it on both sides, while a node has over ``most_leaf`` vectors; its upper nodes are fitted on at most
    ``sample_rows`` vectors (those with the smallest hashes; ``leaf`` of them or more to a node), and leaves with over ``most_leaf`` vectors are split on at
    quantiles of all their vectors. A node of no more than ``TASK_LEAVES`` times that (and ``TASK_BYTES``) is split on and compared by one task, so a vector is
    sent there once for all leaves below; only larger ones are split by the whole cluster. A node where the share ``dense`` of the pairs is near is not split, so groups in which
    all vectors link stay whole, and at least about that share of its comparisons gives links. Vectors are compared within leaves with the results of double precision,
    large leaves in pairs of blocks. Pairs found in several trees count once. One leaf holds all vectors of a length, and is exact, if
    they are ``most_leaf`` or fewer or dense as a whole. Links are rows, so their number is the square of a group's size.

    A pair is missed if every tree parts it: tests require 0.97 of the links that brute force finds (pairs near the
    limit included). Vectors that are null, zero, or hold null or non-finite numbers link with nothing; vectors of
    different lengths do not link. Rows with equal ids are one node; rows with null ids link with nothing. Returns id, n_links, component_id, kept.
    """
    element = vectors.schema[vector_column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    numbers = F.col(vector_column) if isinstance(element, T.FloatType) else F.col(vector_column).cast("array<double>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, lists = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ways, made = [None] * len(lengths), [None] * len(lengths)
            for size in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(known & (lengths == size))
                raw = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), size)
                x = raw.astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    square = (x * x).sum(axis=1)
                valid = np.isfinite(square) & (square > 0)
                # a sum with 0.0 makes -0.0 positive
                for k, vector, way in zip(at[valid], raw[valid], np.round(_unit(x[valid]), 12) + 0.0, strict=True):
                    ways[k], made[k] = hashlib.sha256(way.tobytes()).digest(), vector.tobytes()
            arrays = [batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(ways, pa.binary()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "part", "size", "way", "vector"])

    # from here on the vectors themselves are read for classes only; rows know their class by length and digest, which are null for no vector
    kept_id = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("id"), F.spark_partition_id().alias("part"), numbers.alias("vector"))
    rows = settle(rows.mapInArrow(read, f"id {kept_id}, part int, size int, way binary, vector binary"))
    valid = F.col("way").isNotNull()
    lead = F.min(F.struct(F.col("id").cast("long").alias("name"), "vector"))
    classes = rows.where(valid).groupBy("way", "size").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes.select("size", "way", F.col("lead.name").alias("name"), F.col("lead.vector").alias("vector"), "n", F.monotonically_increasing_id().alias("row")))
    sizes = {r["size"]: r["count"] for r in classes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(64).collect()}
    forest = {}
    for size, n in sizes.items():
        taken = classes.where(F.col("size") == size).orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(sample_rows).select("vector").collect()
        sample = _matrix([r["vector"] for r in taken], kind)
        if n <= most_leaf or near_share(sample[:PROBE], least) >= dense:
            forest[size] = {-1: {}}
            continue
        # by half, so that few nodes turn out too large for a task
        at_once = max(most_leaf, min(TASK_LEAVES * most_leaf, TASK_BYTES // (8 * size)) // 2)
        fewest = max(leaf, at_once * len(sample) // n)
        forest[size] = {tree: grow_tree(sample, tree, spill, fewest, seed, least, dense)[0] for tree in range(trees)}
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for size in np.unique(every):
                at = np.flatnonzero(every == size)
                part = batch.take(pa.array(at))
                matrix = _matrix(part.column(2).to_numpy(zero_copy_only=False), kind)
                for tree, nodes in shared.value.get(int(size), dict.fromkeys(range(trees), {})).items():
                    found = _leaves(matrix, tree, nodes, seed)
                    rows = np.concatenate([r for _, r in found])
                    leaves = np.concatenate([np.full(len(r), n, dtype=np.int64) for n, r in found])
                    take = pa.array(rows)
                    same = pa.array(np.full(len(rows), size, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [same, pa.array(np.full(len(rows), tree, dtype=np.int32)), pa.array(leaves), part.column(1).take(take)],
                        names=["size", "tree", "leaf", "row"],
                    )

    # the leaves hold row numbers, since a vector is in several leaves of every tree; vectors are joined where they are compared
    by_row = classes.select("row", "vector")
    placed = settle(classes.select("size", "row", "vector").mapInArrow(place, "size int, tree int, leaf long, row long"))
    at_once = F.greatest(F.lit(most_leaf), F.least(F.lit(TASK_LEAVES * most_leaf), F.floor(F.lit(TASK_BYTES // 8) / F.col("size"))))
    placed = _split_further(placed, by_row, kind, at_once, spill, seed, rounds, least, dense)
    # final leaves, and what is still too large for a task, are compared in pairs of blocks; others (no blocks) are split on where they are compared
    keys = ["size", "tree", "leaf"]
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("tree") < 0) | (F.col("n") > at_once))
    counted = settle(counted.select(*keys, F.ceil(F.col("n") / most_leaf).cast("int").alias("blocks")))
    blocked = placed.join(counted, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    parts = F.greatest("blocks", F.lit(1))
    blocked = blocked.withColumn("mine", F.pmod(F.xxhash64("row"), parts).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocked = blocked.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, node, blocks, low, high = (k.as_py() for k in key[1:])
        group = pa.Table.from_batches(list(batches))
        _, first = np.unique(group["row"].to_numpy(), return_index=True)
        group = group.take(pa.array(first))
        x, names, mine = _matrix(group["vector"].to_numpy(), kind), group["name"].to_numpy(), group["mine"].to_numpy()
        if blocks:
            left = np.flatnonzero(mine == low)
            found = iter([_near(x, left, left if low == high else np.flatnonzero(mine == high), least)])
        else:
            _, leaves = grow_tree(x, tree, spill, most_leaf, seed, least, dense, node % (1 << 30))
            found = (near for rows in leaves for near in _near_within(x, rows, most_leaf, least))
        held, n = [], 0
        for near in found:
            held.append(near)
            n += len(near)
            if n >= TASK_LINKS:
                yield linked(held, names)
                held, n = [], 0
        if held:
            yield linked(held, names)

    def linked(held: list[np.ndarray], names: np.ndarray) -> pa.RecordBatch:
        i, j = np.divmod(sorted_distinct(np.concatenate(held)), len(names))
        a, b = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    blocked = blocked.join(classes.select("row", "name", "vector"), "row")
    pairs = blocked.select(*keys, "blocks", "low", "high", "mine", "row", "name", "vector").groupBy(*keys, "blocks", "low", "high")
    # merged after the shuffle only: the trees that find a pair are in different tasks, and what each could merge before took more memory than it saved
    links = settle(pairs.applyInArrow(compare, "a long, b long").repartition("a", "b").distinct())
    roots = components(links, "a", "b")
    both = links.union(links.select("b", "a"))
    partners = both.join(classes.select(F.col("name").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    facts = (
        classes.join(partners, F.col("name") == F.col("a"), "left")
        .join(roots, F.col("name") == F.col("node"), "left")
        .select("way", "size", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "name").alias("component_id"))
    )
    found = spread_join(rows.where(valid).select("id", "way", "size", "part"), facts, ["way", "size"], "part").select("id", "n_links", "component_id")
    alone = rows.where(~valid).select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    every = found.union(alone)
    return every.select(
        F.col("id").alias(id_column),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("id")).alias("kept"),
    )
