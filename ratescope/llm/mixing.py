"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratescope.llm.common import WORD, text_of, with_row_numbers
from ratescope.runtime import settle

#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) with the words each source is to give, as ``target``.

    The targets add up to all sizes. A source gives its share by weight, but at most ``most`` times
    its size; what is above goes to the others by weight. Sources reach their limit in the order of
    limit per unit of weight, so the level at which all is given is found with two running sums over
    the sources. A total of 0 gives targets of 0. ``sizes`` has one row per source; the null source is last.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    priced = placed.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(up_to), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    )
    # the level while this source is the next to reach its limit; the first source that stays below settles it
    tried = priced.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") <= F.col("limit"))
    first = F.min(F.when(F.col("below"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "place", "level"))).over(whole)
    settled = tried.withColumn("level", first["level"])
    return settled.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("limit")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add ``quota``: the group's ``seats`` go to its parties with the highest votes / (2 k + 1).

    With V votes, M seats and n parties the last seat's quotient votes / (k + 1/2) lies between
    V / (M + n/2) and V / (M - n/2). Seats above the upper bound are given at once; only the quotients
    between, 2 n at most, are ranked. Ties go by ``order``. A group without votes gets no seats.
    """
    all_of = Window.partitionBy(*group)
    v, m = F.col(votes), F.col(seats)
    counted = parties.withColumn("total_", F.sum(votes).over(all_of)).withColumn("half_", F.count(F.lit(1)).over(all_of) / 2)
    live = (v > 0) & (m > 0)
    # a hair wider than the bounds, against rounding; the ranking settles what lies between
    sure = F.floor(v * (m - F.col("half_")) / F.col("total_") + 0.5 - 1e-6)
    most = F.floor(v * (m + F.col("half_")) / F.col("total_") + 0.5 + 1e-6)
    bounded = (
        counted.withColumn("sure_", F.when(live, F.greatest(sure, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("most_", F.when(live, most).otherwise(0).cast("long"))
        .withColumn("left_", m - F.sum("sure_").over(all_of))
    )
    between = F.when(F.col("most_") > F.col("sure_"), F.sequence(F.col("sure_"), F.col("most_") - 1))
    asked = bounded.withColumn("k_", F.explode_outer(between)).withColumn("quotient_", v / (2 * F.col("k_") + 1))
    place = Window.partitionBy(*group).orderBy(F.desc_nulls_last("quotient_"), *order)
    won = F.col("k_").isNotNull() & (F.row_number().over(place) <= F.col("left_"))
    return (
        asked.withColumn("won_", won.cast("long"))
        .groupBy(*parties.columns)
        .agg((F.first("sure_") + F.sum("won_")).alias("quota"))
    )


def mix_plan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    most: float = 3.0,
    block: int = 16,
    shard_words: int = 1 << 17,
    most_shards: int = 1 << 20,
    seed: int = 7,
    row_column: str | None = None,
) -> DataFrame:
    """How many words of each row the mix takes.

    A source's rows are dealt over shards by a seeded hash and stand there in seeded order; the
    shard's words are cut into blocks of ``block`` words. The blocks of the mix are apportioned by
    Sainte-Laguë: first to the sources by target, then each source's to its shards by words. A shard
    with q of its n blocks to give gives all of them q div n times, and q mod n more: a seeded run
    of blocks, which wraps around. So texts come whole but for those at the ends of the run, and no row is
    taken more than ``most`` (rounded up) times.

    The number of shards follows from the words alone (``shard_words`` each, more if there would
    be over ``most_shards``), so reruns agree on any cluster, and a source with a third of all
    rows is as many tasks as it has shards. Rows with equal hashes stand by id and size.

    Returns id, size, source, source_size, target, taken, first (the first word of the part taken
    once more than the rest), extra (its length; it may wrap around), times and row (``row_column``, if given). A null text has 0 words; the null
    source is a source.
    """
    text = text_of("text")
    number = F.col(row_column) if row_column else F.monotonically_increasing_id()
    rows = settle(
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(source_column).alias("source"), number.alias("row")).select(
            "id",
            "source",
            word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col("id"), F.crc32(F.encode(text, "UTF-8"))).alias("draw"),
            "row",
        )
    )
    sizes = settle(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    per_shard = max(shard_words, -(-total // most_shards))
    targets = source_targets(sizes, weights, most).withColumn("seats", F.lit(round(total / block))).withColumn("all", F.lit(0))
    sources = settle(
        sainte_lague(targets, ["all"], "target", "seats", ["source"])
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)))
        .select(F.col("source").alias("of"), "source_size", "target", F.col("quota").alias("source_quota"), "n_shards")
    )
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "draw"), F.col("n_shards")))
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").cast("long").alias("shard_words"), F.first("source_quota").alias("source_quota")
    )
    quotas = sainte_lague(shards, ["source"], "shard_words", "source_quota", ["shard"])
    n = F.ceil(F.col("shard_words") / block)
    quotas = (
        quotas.withColumn("n", n)
        .withColumn("quota", F.least(F.col("quota"), F.floor(F.col("n") * most)))
        .select(
            F.col("source").alias("source_q"),
            F.col("shard").alias("shard_q"),
            "shard_words",
            F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long").alias("times"),
            F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(0).cast("long").alias("more"),
            F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("n"))).otherwise(0).alias("from"),
        )
    )
    stands = Window.partitionBy("source", "shard").orderBy("draw", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    standing = dealt.withColumn("at", F.coalesce(F.sum("size").over(stands), F.lit(0)))
    both = standing.join(quotas, F.col("source").eqNullSafe(F.col("source_q")) & (F.col("shard") == F.col("shard_q")))
    # the run is [begin, end) and, where it wraps around, [0, rest)
    begin, end = F.col("from") * block, F.least((F.col("from") + F.col("more")) * block, F.col("shard_words"))
    rest = F.greatest(F.lit(0), (F.col("from") + F.col("more") - F.ceil(F.col("shard_words") / block)) * block)
    stop = F.col("at") + F.col("size")
    low, high = F.greatest(F.col("at"), begin), F.least(stop, end)
    after = F.greatest(F.lit(0), high - low)
    front = F.greatest(F.lit(0), F.least(stop, rest) - F.col("at"))
    return both.select(
        "id",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("times") * F.col("size") + after + front).cast("long").alias("taken"),
        F.when(after > 0, low - F.col("at")).otherwise(0).cast("long").alias("first"),
        (after + front).cast("long").alias("extra"),
        "times",
        "row",
    ).withColumnRenamed("id", id_column)


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", written: bool = False, **settings
) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it is taken whole, then its cut part.

    The cut part keeps the taken words in their order, joined by single spaces; it occurs only at
    the ends of a shard's run. Rows of which nothing is taken go. Columns stay as they are,
    so one that counts the text still counts the whole. A ``written`` table is not copied (see ``with_row_numbers``).
    """
    numbered, row = with_row_numbers(docs, written)
    plan = mix_plan(numbered, id_column, text_column, source_column, row_column=row, **settings).withColumnRenamed("row", row)
    plan = plan.where("size > 0 and (times > 0 or extra > 0)").select(row, F.struct("size", "times", "first", "extra").alias(f"{row}plan"))
    p = F.col(f"{row}plan")
    whole = p["times"] + (p["extra"] >= p["size"]).cast("int")
    cut = (p["extra"] > 0) & (p["extra"] < p["size"])
    copies = F.explode(F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    words = F.regexp_extract_all(F.col(text_column), F.lit(f"({WORD})"), F.lit(1))
    # a run that covers the end of a text and, wrapped around, its start: the start comes first
    begins = F.least(p["first"] + p["extra"], p["size"]) - p["first"]
    taken = F.concat(F.slice(words, 1, (p["extra"] - begins).cast("int")), F.slice(words, p["first"].cast("int") + 1, begins.cast("int")))
    out = numbered.join(plan, row).withColumn(f"{row}cut", copies)
    text = F.when(F.col(f"{row}cut"), F.array_join(taken, " ")).otherwise(F.col(text_column))
    return out.withColumn(text_column, text).select(*docs.columns)
