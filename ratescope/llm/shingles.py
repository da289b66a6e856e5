"""N-gram Jaccard join: prefix tiles by size band, bit-count bounds, exact intersection of sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.llm.common import give_back, in_pieces, small_batches, sorted_distinct, spread_join, with_row_numbers
from ratescope.llm.components import components
from ratescope.runtime import settle

#: Odd multipliers for the words of a shingle, then those of the finalizer.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * FINAL[0]
    x = (x ^ (x >> np.uint64(27))) * FINAL[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words; a shorter text is one shingle.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    span = min(width, n)
    total = np.full(n - span + 1, span, dtype=np.uint64)
    for k in range(span):
        total += hashes[k : n - span + 1 + k] * (ODD[k % 5] + np.uint64(2 * (k // 5)))
    return sorted_distinct(_mixed(total))


def set_name(shingles: np.ndarray) -> int:
    """One number for the whole set."""
    total = np.array([len(shingles)], dtype=np.uint64) * ODD[0] + shingles.sum(dtype=np.uint64)
    return int(_mixed(total).view(np.int64)[0])


#: Rows of the counting table that travel together.
CHUNK = 4096
#: Names of sets that a task remembers, so as not to send a set twice.
MOST_SEEN = 200_000


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle hash among 64, 128, 256 … bits, at least four per shingle."""
    width = max(64, 1 << int(4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap of ``words`` words: hashes keep their low bits, so halves are laid over each other."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def _sets_and_counts(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Per row its set's size, name and bitmap; and per task how many shingles fell on each of 2**bits counters."""
    schema = T.StructType(
        [
            docs.schema["id"],
            T.StructField("part", T.IntegerType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set", T.LongType()),
            T.StructField("bitmap", T.BinaryType()),
            T.StructField("chunk", T.IntegerType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
    id_type = pa.null()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << bits, dtype=np.int64), id_type
        for batch in in_pieces(batches, 2):
            kind = batch.schema.field(0).type
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            n = len(sets)
            every = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
            counts += np.bincount((every >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_name(s) for s in sets], pa.int64()),
                    pa.array([bitmap_of(s).tobytes() for s in sets], pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=schema.names,
            )
        if counts.any():
            parts = counts.astype("<u4").reshape(-1, min(CHUNK, 1 << bits))
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, kind),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.binary()),
                    pa.array(range(n), pa.int32()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=schema.names,
            )

    return docs.select("id", F.spark_partition_id().alias("part"), "text").mapInArrow(read, schema)


def _total_counts(chunks: DataFrame, bits: int) -> np.ndarray:
    """The counters of all tasks added up: 2**bits numbers, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(counts.as_buffer(), dtype="<u4").astype("<i8")
                if chunk in sums:
                    sums[chunk] += got
                else:
                    sums[chunk] = got
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["chunk", "counts"]
            )

    dealt = chunks.select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    total = np.zeros(1 << bits, dtype=np.int64)
    size = min(CHUNK, 1 << bits)
    for row in dealt.collect():
        total[row["chunk"] * size : (row["chunk"] + 1) * size] += np.frombuffer(row["counts"], dtype="<i8")
    return total


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, bits: int, percent: int) -> DataFrame:
    """The rarest shingles of each set: those of which two linked sets must share one.

    Sets of a and b shingles, a <= b, link if they share at least percent * (a + b) / (100 + percent). Ordered by one
    order of all shingles, they then share one of the first b - ceil(percent / 100 * b) + 1 of the larger
    and of the first a - ceil(2 percent / (100 + percent) * a) + 1 of the smaller set (``short``). The
    order is by counter, so shingles of passages that many texts share come last. A set is sent once per
    task, or again when the task has met MOST_SEEN others. ``salts`` deals very frequent shingles over several tasks.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in (("shingle", T.LongType()), ("salt", T.IntegerType()), ("salts", T.IntegerType()), ("set", T.LongType()), ("size", T.IntegerType()), ("short", T.BooleanType()))])
    usual = int(counts.mean())
    rank = docs.sparkSession.sparkContext.broadcast(counts.clip(max=2**32 - 1).astype("<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = rank.value, set()
        for batch in in_pieces(batches, 0):
            found, names, sizes, shorts = [], [], [], []
            if len(seen) > MOST_SEEN:
                seen.clear()
            for text in batch.column(0):
                s = shingle_set(text.as_py(), width)
                n = len(s)
                if not n:
                    continue
                name = set_name(s)
                if name in seen:
                    continue
                seen.add(name)
                long_prefix = n - -(-percent * n // 100) + 1
                short_prefix = n - -(-2 * percent * n // (100 + percent)) + 1
                count = order[(s >> np.uint64(64 - bits)).astype(np.int64)]
                first = s[np.argsort(count, kind="stable")[:long_prefix]]
                found.append(first)
                names.append(np.full(len(first), name, dtype=np.int64))
                sizes.append(np.full(len(first), n, dtype=np.int32))
                shorts.append(np.arange(len(first)) < short_prefix)
            if not found:
                continue
            shingles, owner = np.concatenate(found), np.concatenate(names)
            more = order[(shingles >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64) - 2 * usual
            salts = 1 + np.maximum(more, 0) // 1024
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shingles.view(np.int64)),
                    pa.array((_mixed(owner.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)),
                    pa.array(np.minimum(salts, 2**31 - 1).astype(np.int32)),
                    pa.array(owner),
                    pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(shorts)),
                ],
                names=schema.names,
            )

    return docs.select("text").mapInArrow(read, schema)


def _set_arrays(docs: DataFrame, width: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 0):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "shingles"]
            )

    return docs.select("text").mapInArrow(read, "set long, shingles binary")


def _needed(size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection that links a set of ``size`` with sets of ``sizes``."""
    return -(-percent * (size + sizes) // (100 + percent))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


class Tile:
    """Sets in order of size, with bitmaps of one width, of which pairs are to be compared.

    A pair has one set in ``left`` and one in ``right`` (blocks of a large tile), at least one of them of the tile's own
    size band (``lower``). The bits that one set has and the other lacks are shingles not shared, so
    counting them bounds the intersection from above.
    """

    def __init__(self, sizes, bitmaps, lower, left, right, percent: int):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = np.asarray(sizes, dtype=np.int64)[self.order]
        words = min(len(b) for b in bitmaps)
        self.bitmaps = np.stack([_folded(bitmaps[i], words) for i in self.order])
        self.lower, self.left, self.right = (np.asarray(x)[self.order] for x in (lower, left, right))
        self.percent = percent

    def near(self, i: int, group: np.ndarray | None = None) -> np.ndarray:
        """Places after i that the bound lets through; those of i's own group are left out."""
        end = np.searchsorted(self.sizes, self.sizes[i] * 100 // self.percent, side="right")
        rest = slice(i + 1, end)
        may = ((self.left[i] & self.right[rest]) | (self.right[i] & self.left[rest])) & (self.lower[i] | self.lower[rest])
        if group is not None:
            may &= group[rest] != group[i]
        others = np.flatnonzero(may) + i + 1
        mine, theirs = self.bitmaps[i], self.bitmaps[others]
        bound = np.minimum(
            self.sizes[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
            self.sizes[others] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64),
        )
        return others[bound >= _needed(self.sizes[i], self.sizes[others], self.percent)]


def near_pairs(names: np.ndarray, tile: Tile) -> list[tuple[int, int]]:
    """Pairs of set names that the bitmaps do not tell apart."""
    names = names[tile.order]
    return [(int(names[i]), int(names[j])) for i in range(len(names) - 1) for j in tile.near(i)]


def forest(names: np.ndarray, groups: np.ndarray, arrays: list[np.ndarray], tile: Tile) -> list[tuple[int, int]]:
    """Links between groups of a tile, exactly intersected: enough of them to join all groups that link."""
    names, arrays = names[tile.order], [arrays[i] for i in tile.order]
    group, found = np.unique(groups[tile.order], return_inverse=True)[1], []
    for i in range(len(names) - 1):
        for j in tile.near(i, group):
            if group[i] != group[j] and _shared(arrays[i], arrays[j]) >= _needed(tile.sizes[i], tile.sizes[j], tile.percent):
                found.append((int(names[i]), int(names[j])))
                group[group == group[j]] = group[i]
    return found


def _linked(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                good.append(_shared(x, y) >= _needed(len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        give_back()

    a = arrays.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    b = arrays.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
    bits: int = 20,
    small: int = 64,
    block_rows: int = 1024,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """For every row its number of distinct shingles and the smallest id it is linked to, directly or not.

    Two rows link if 100 * |intersection| >= ``percent`` * |union| of their shingle sets. All links
    between different sets are found or implied by others found; equal sets are one set throughout, so
    copies are never compared. Steps:

    1. One pass names each row's set, makes its bitmap (about a byte per word) and counts shingles in
       2**bits counters (a fixed table).
    2. A second pass sends each set's rarest shingles (see ``_prefixes``); a window keeps those that
       two sets share, and of shingles with the same sets one is kept.
    3. A shingle's sets form tiles by size band (factor 100/percent: linked sets are in one band or in
       neighbours). In a tile of at most ``small`` sets the bitmaps are compared and the pairs left
       are intersected exactly, once each. In a larger tile all sets are intersected with one of them.
    4. Larger tiles that are not yet one component are cut into blocks, and pairs of blocks compared
       by bitmap and, between components, exactly; only links that join components leave a task,
       which never holds more than two blocks.
    5. Links become components; the result reaches the rows through (set, part) pairs.

    So a large group of near copies costs one comparison per member and rare shingle, unless it holds
    sets that do not link; then bitmaps are compared in the square of the tile, blockwise.

    Null and empty texts have no shingles and link with nothing: their component is their own id.
    A null id is smallest only if its whole component has no other. Repeated rows are copies.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    first = settle(_sets_and_counts(source, width, bits))
    rows = first.where(F.col("n_shingles").isNotNull()).select("id", "part", "n_shingles", "set")
    counts = _total_counts(first.where(F.col("chunk").isNotNull()), bits)
    sets = settle(
        first.where("n_shingles > 0").groupBy("set").agg(F.min("id").alias("id"), F.first("bitmap").alias("bitmap"))
    )

    tile = Window.partitionBy("shingle", "salt")
    shared = (
        _prefixes(source, counts, width, bits, percent)
        .withColumn("n", F.count(F.lit(1)).over(tile))
        .where("n > 1 or salts > 1")
        .select("shingle", "set", "size", "short")
    )
    shared = settle(shared.dropDuplicates(["shingle", "set"]))
    name = F.xxhash64("set").cast("decimal(20,0)")
    same_sets = (
        shared.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(name).alias("members"), F.bit_xor("set").alias("mixed"), F.max("short").alias("short"))
        .where("n > 1 and short")
        .groupBy("n", "members", "mixed")
        .agg(F.min("shingle").alias("shingle"))
        .select("shingle")
    )
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    own = F.struct(band.alias("tile"), F.lit(True).alias("lower"))
    below = F.struct((band - 1).alias("tile"), F.lit(False).alias("lower"))
    banded = shared.join(same_sets, "shingle").select("shingle", "set", "size", F.explode(F.array(own, below)).alias("t"))
    banded = banded.select("shingle", "t.tile", "set", "size", "t.lower")
    tiles = (
        banded.groupBy("shingle", "tile")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("lower").alias("any_lower"),
            F.sum("size").alias("n_shingles"),
            F.min(F.when(F.col("lower"), F.col("set"))).alias("leader"),
        )
        .where("n > 1 and any_lower")
    )
    members = settle(banded.join(tiles, ["shingle", "tile"]))

    def compare_small(frame: pd.DataFrame) -> pd.DataFrame:
        every = np.ones(len(frame), dtype=bool)
        bitmaps = [np.frombuffer(b, dtype="<u8") for b in frame["bitmap"]]
        tile = Tile(frame["size"].to_numpy(), bitmaps, frame["lower"].to_numpy(), every, every, percent)
        return pd.DataFrame(near_pairs(frame["set"].to_numpy(), tile), columns=["a", "b"], dtype="int64")

    bitmaps = sets.select("set", "bitmap")
    from_small = members.where(F.col("n") <= small).select("shingle", "tile", "set", "size", "lower").join(bitmaps, "set")
    from_small = from_small.groupBy("shingle", "tile").applyInPandas(compare_small, "a long, b long")
    from_large = members.where((F.col("n") > small) & (F.col("set") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("set").alias("b"))
    pairs = from_small.union(from_large).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = settle(pairs.distinct())

    def arrays_of(wanted: DataFrame) -> DataFrame:
        """Sorted shingles of the wanted sets, from one text each."""
        owners = settle(sets.join(wanted, "set", "left_semi").select("id").distinct())
        texts = source.join(owners, source["id"].eqNullSafe(owners["id"]), "left_semi")
        return _set_arrays(texts, width).groupBy("set").agg(F.first("shingles").alias("shingles"))

    first_links = settle(_linked(pairs, settle(arrays_of(pairs.select("a").union(pairs.select("b")).toDF("set"))), percent))
    roots = components(first_links, "a", "b")

    grouped = members.where(F.col("n") > small).join(roots, members["set"] == roots["node"], "left")
    grouped = grouped.select("shingle", "tile", "set", "size", "lower", F.coalesce("component", "set").alias("group"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("n_shingles") * 8 / block_bytes)).cast("int")
    alive = (
        grouped.groupBy("shingle", "tile")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_shingles"), F.min("group").alias("least"), F.max("group").alias("most"))
        .where("least != most")
        .select("shingle", "tile", blocks.alias("blocks"))
    )
    compared = settle(
        grouped.join(alive, ["shingle", "tile"])
        .withColumn("mine", F.pmod(F.xxhash64("set", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shingle", "tile", "set", "lower", "group", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    )

    def compare_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(b, dtype="<u8") for b in frame["shingles"]]
        mine = frame["mine"].to_numpy()
        tile = Tile(
            [len(a) for a in arrays],
            [bitmap_of(a) for a in arrays],
            frame["lower"].to_numpy(),
            mine == frame["low"].to_numpy(),
            mine == frame["high"].to_numpy(),
            percent,
        )
        found = forest(frame["set"].to_numpy(), frame["group"].to_numpy(), arrays, tile)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rest = compared.join(arrays_of(compared.select("set")), "set")
    rest = rest.groupBy("shingle", "tile", "low", "high").applyInPandas(compare_blocks, "a long, b long")
    roots = components(roots.toDF("a", "b").union(rest), "a", "b")

    labelled = sets.select("set", "id").join(roots, sets["set"] == roots["node"], "left").withColumn("root", F.coalesce("component", "set"))
    smallest = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = settle(labelled.select("set", "root").join(smallest, "root").select("set", "component_id"))
    found = spread_join(rows, labels, ["set"], "part")
    return found.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", written: bool = False, **settings) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all columns unchanged.

    A ``written`` table is not copied (see ``with_row_numbers``).
    """
    numbered, row = with_row_numbers(docs, written)
    found = jaccard_components(numbered.select(F.col(row).alias("at"), F.col(text_column).alias("text")), "at", "text", **settings)
    linked = settle(found.where("n_shingles > 0").select("at", "component_id"))
    groups = linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    ids = numbered.select(F.col(row).alias("at"), F.col(id_column).alias("id"))
    members = settle(linked.join(groups, "component_id").join(ids, "at"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "at")).alias("first"))
    dropped = settle(members.join(first, "component_id").where("at != first.at").select(F.col("at").alias(row)))
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)
