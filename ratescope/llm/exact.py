"""Exact duplicates: sorted digest runs of the partitions, merged as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescope.llm.common import spread_join, text_of, with_row_numbers
from ratescope.runtime import settle

#: What has to agree for two texts to count as equal: SHA-256, a second hash and the length.
KEY = ["text_sha256", "second_hash", "n_bytes"]


def _merge(runs: DataFrame, run, best, size) -> DataFrame:
    """One run per value of ``run``: entries with the same key become one that keeps the best row.

    The aggregate of a struct is computed over rows sorted by key on both sides of the exchange: each
    task sorts and merges what it has, sends one entry per key and run, and the receiver merges the
    sorted pieces.
    """
    return runs.groupBy(*KEY, run.alias("run")).agg(best.alias("best"), size.alias("group_size"))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    fan_in: int = 8,
    row_column: str | None = None,
) -> DataFrame:
    """For every row the row that stays of those with the same text.

    Each partition of ``docs`` makes a run: its digests in order, each with the row to keep and a
    count. In every round ``fan_in`` neighbouring runs (2 gives the binomial tree) meet and are
    merged, until one is left; after r rounds an entry stands for ``fan_in ** r`` partitions. An entry
    is merged with another only if SHA-256, a second independent hash and the byte length agree, at
    every level. A text that fills a third of all rows is one entry per run from the start.

    The result goes back along the runs: the merged entry meets the (text, run) pairs that occur,
    and rows join on text and run, so no key of a join has more rows than one partition.

    ``keep`` is "smallest" or "largest" id; rows with a null id stay only if all of them have
    none, and of rows with equal ids one stays. ``row_column`` names a column that numbers the rows, if there is one. Null texts count as empty. Returns id, keep_id,
    group_size, kept, text_sha256 and the row number ``row``; the text is compared unchanged.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    text = text_of("text")
    number = F.col(row_column) if row_column else F.monotonically_increasing_id()
    rows = settle(
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), number.alias("row")).select(
            "id",
            F.sha2(text, 256).alias("text_sha256"),
            F.xxhash64(text).alias("second_hash"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            "row",
            F.spark_partition_id().alias("run"),
        )
    )
    best = F.min if keep == "smallest" else F.max
    known = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    entry = F.struct(known.alias("known"), F.col("id"), F.col("row"))
    width = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = _merge(rows, F.floor(F.col("run") / fan_in), best(entry), F.count(F.lit(1)))
    while width > fan_in:
        width = -(-width // fan_in)
        level = _merge(level, F.floor(F.col("run") / fan_in), best("best"), F.sum("group_size"))
    copies = level.where("group_size > 1").drop("run")
    return spread_join(rows, copies, KEY, "run").select(
        F.col("id").alias(id_column),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", written: bool = False
) -> DataFrame:
    """``docs`` with one row of each text, all columns unchanged.

    Numbers give every row a name, so rows with null or repeated ids are told apart; they need no copy of a
    ``written`` table (see ``with_row_numbers``). The list of rows to drop is settled: Spark knows its size and
    broadcasts it only where it is small.
    """
    numbered, row = with_row_numbers(docs, written)
    found = exact_duplicates(numbered, id_column, text_column, keep, row_column=row)
    dropped = settle(found.where(~F.col("kept")).select(F.col("row").alias(row)))
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)
