"""Merkle manifest of a dataset: every few levels are stored, proofs recompute what lies between them.

Rows of a group (a language) stand in order; neighbouring nodes become their parent until one is left, the
group's subroot. The subroots stand in order and likewise give the root. A stored level is one table of
digests; from it to the next stored one lie ``stride`` levels that are never written. A subtree of 2**stride
stored nodes is aligned, so its inside follows from its own nodes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.llm.common import unused_name
from ratescope.runtime import settle

#: Levels from one stored level to the next: 16 stored nodes below each.
STRIDE = 4
#: What a leaf covers, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it is hashed: - for null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _parents(nodes: Column) -> Column:
    """Every two neighbours become the hash of both; a last one alone becomes the hash of itself."""
    half = F.shiftright(F.size(nodes) + 1, 1)
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), half - 1), pair)


def in_order(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds place (from 0 without gaps within the group) and nodes (how many the group has).

    Rows are dealt by ranges of (group, order), so a group with most rows is many tasks; each numbers
    its own rows, and the sizes of the ranges before it are added. Nulls come first. The ranges are written
    with the rows, so later readings agree.
    """
    ways = [F.asc_nulls_first(c) for c in [group, *order]]
    part, number = unused_name(nodes, "part_"), unused_name(nodes, "number_")
    ranged = settle(nodes.repartitionByRange(*ways).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(group).alias("group_k"), F.col(part).alias("part_k")).agg(F.count(F.lit(1)).alias("size_k"))
    within = Window.partitionBy("group_k")
    before = within.orderBy("part_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "group_k", "part_k", F.coalesce(F.sum("size_k").over(before), F.lit(0)).alias("start_k"), F.sum("size_k").over(within).alias("nodes")
    )
    numbered = ranged.withColumn(number, F.row_number().over(Window.partitionBy(group, part).orderBy(*ways[1:])) - 1)
    return (
        numbered.join(starts, F.col(group).eqNullSafe(F.col("group_k")) & (F.col(part) == F.col("part_k")))
        .withColumn("place", F.col("start_k") + F.col(number))
        .drop("group_k", "part_k", "start_k", part, number)
    )


def _subtrees(level: DataFrame, group: str, stride: int, riders: list[str] = ()) -> DataFrame:
    """A row per aligned subtree of a stored level: its digests in order, and the ``rise`` levels to its top.

    ``level`` has group, place, digest and nodes. A group with few nodes ends below the next stored level.
    The ``riders`` are further columns of the nodes, kept in the same order as an array of structs.
    """
    rise = sum(((F.first("nodes") > (1 << k)).cast("int") for k in range(stride)), F.lit(0))
    members = F.array_sort(F.collect_list(F.struct("place", "digest", *[r for r in riders if r != "digest"])))
    return (
        level.groupBy(group, F.shiftright("place", stride).alias("place"))
        .agg(members.alias("members"), F.first("nodes").alias("nodes"), rise.alias("rise"))
        .withColumns({"held": F.col("members.digest"), "riders": F.transform("members", lambda x: F.struct(x["place"], *[x[r] for r in riders]))})
        .drop("members")
    )


def stored_levels(nodes: DataFrame, group: str, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels of all groups' trees, leaves first; the last has one node per group.

    ``nodes`` has group, digest, place and nodes, and is settled. Each level is a table in the shared folder, a
    sixteenth (2**-stride) as long as the one below it.
    """
    level = nodes
    levels = [level]
    while (level.agg(F.max("nodes")).first()[0] or 0) > 1:
        parent = _subtrees(level, group, stride)
        for k in range(stride):
            parent = parent.withColumn("held", F.when(F.col("rise") > k, _parents(F.col("held"))).otherwise(F.col("held")))
        above = F.ceil(F.col("nodes") / F.pow(F.lit(2.0), "rise")).cast("long")
        level = settle(parent.select(group, "place", F.element_at("held", 1).alias("digest"), above.alias("nodes")))
        levels.append(level)
    return levels


def _steps(stride: int) -> Column:
    """For every stored node of a subtree its siblings up to the subtree's top, with the side they stand on.

    An entry is L or R and the digest, or empty where the node is alone. The levels inside are made here and
    live no longer than the row.
    """

    def sibling(i: Column, k: int) -> Column:
        nodes, at = F.col(f"inside_{k}"), F.shiftright(i, k)
        other = F.get(nodes, at.bitwiseXOR(F.lit(1)))
        return F.coalesce(F.concat(F.when(at % 2 == 1, "L").otherwise("R"), other), F.lit(""))

    every = lambda i: F.slice(F.array(*[sibling(i, k) for k in range(stride)]), F.lit(1), F.col("rise"))
    return F.transform(F.sequence(F.lit(0), F.size("held") - 1), every)


def sibling_paths(levels: list[DataFrame], tops: DataFrame, group: str, riders: list[str] = (), stride: int = STRIDE) -> DataFrame:
    """Per leaf the siblings on its way up, as column path, with the ``riders`` of the leaves' level.

    From the top down: a subtree's nodes get their siblings inside the subtree, followed by the path of
    its top, which the level above has made. ``tops`` starts it with group, place 0 and path (empty, or
    what lies above the groups' tops); its other columns go down to all leaves. Joins are one row per subtree,
    and the leaves' paths, the bulk of the result, are made after the last of them.
    """
    paths = tops
    for level in reversed(levels[:-1]):
        last = level is levels[0]
        trees = _subtrees(level, group, stride, riders if last else ())
        for k in range(stride):  # columns one after another, so no level is computed again for the next
            below = F.col("held") if k == 0 else F.col(f"inside_{k - 1}")
            trees = trees.withColumn(f"inside_{k}", below if k == 0 else F.when(F.col("rise") >= k, _parents(below)).otherwise(below))
        handed = [c for c in paths.columns if c not in (group, "place", "path")]
        top = paths.select(F.col(group).alias("group_t"), F.col("place").alias("place_t"), F.col("path").alias("path_t"), *handed)
        both = trees.join(top, F.col(group).eqNullSafe(F.col("group_t")) & (F.col("place") == F.col("place_t")))
        each = both.select(group, "path_t", *handed, F.explode(F.arrays_zip(_steps(stride).alias("steps"), "riders")).alias("each"))
        paths = each.select(
            group,
            F.col("each.riders.place").alias("place"),
            F.concat("each.steps", "path_t").alias("path"),
            *handed,
            *([F.col(f"each.riders.{r}").alias(r) for r in riders] if last else []),
        )
        paths = paths if last else settle(paths)
    if len(levels) == 1:  # every leaf is the top of its group
        paths = paths.join(levels[0].select(F.col(group).alias("group_t"), *riders), F.col(group).eqNullSafe(F.col("group_t"))).drop("group_t")
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    step = lambda node, entry: F.sha2(
        F.when(F.startswith(entry, F.lit("L")), F.concat(F.substr(entry, F.lit(2)), node)).otherwise(F.concat(node, F.substr(entry, F.lit(2)))), 256
    )
    return F.aggregate(path, leaf, step)


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = LEAF_COLUMNS, group: str = "lang", order: str = "doc_id", extra: dict[str, Column] | None = None, stride: int = STRIDE
) -> DataFrame:
    """Leaf, subroot, root and proof of every row.

    Returns the order and group columns (as they were), the ``extra`` columns, leaf, subroot, root and
    proof: an array of the siblings from the leaf over the subroot to the root, each L or R (the side it
    stands on) and a digest, or empty where the node has no sibling at that level. Rows of a group ascend by ``order``,
    null first; rows with equal order stand by leaf, and wholly equal rows in any order with the same
    digests. A null group is a group, the first; groups stand in byte order. Null values are hashed
    as such. An empty table has no rows and no root. Only the number of levels reaches the driver.
    """
    extra = extra or {}
    digest = leaf_hash([F.col(c) for c in columns]).alias("digest")
    # written first: finding the ranges reads the rows once more, and should not hash the texts again
    rows = settle(docs.select(F.col(order).alias("order_"), F.col(group).alias("group_"), digest, *[c.alias(f"x_{n}") for n, c in extra.items()]))
    placed = settle(in_order(rows, "group_", ["order_", "digest"]))
    levels = stored_levels(placed, "group_", stride)
    # the groups' subroots are the leaves of one more tree
    nothing = F.array().cast("array<string>").alias("path")
    subroots = levels[-1].select(F.lit(0).alias("all_"), F.col("group_").alias("of_"), "digest")
    subroots = settle(in_order(subroots, "all_", ["of_"]))
    upper = stored_levels(subroots, "all_", stride)
    root = upper[-1].select("all_", "place", nothing, F.col("digest").alias("root"))
    tops = sibling_paths(upper, root, "all_", ["of_", "digest"], stride)
    tops = settle(tops.select(F.col("of_").alias("group_"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"))
    names = [f"x_{n}" for n in extra]
    return sibling_paths(levels, tops, "group_", ["order_", "digest", *names], stride).select(
        F.col("order_").alias(order),
        F.col("group_").alias(group),
        *[F.col(f"x_{n}").alias(n) for n in extra],
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.col("path").alias("proof"),
    )


def verified_manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, with rows tampered with.

    Where 7 divides the CRC-32 of the decimal doc_id, 1 is added to n_chars (a null stays) before the leaf is
    hashed again and folded up along the untouched siblings. A row with a null doc_id is not tampered with.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars")).cast("decimal(20,0)")
    tampered = leaf_hash([changed if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])
    found = merkle_manifest(docs, extra={"tampered": tampered}, stride=stride)
    bare = F.transform("proof", lambda e: F.substr(e, F.lit(2)))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(bare, ""), 256).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
