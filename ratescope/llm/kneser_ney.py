"""Interpolated modified Kneser-Ney bigrams: counts as sorted hash arrays, exchanged between texts and shards.

The texts are cut into runs of some million tokens. A run's distinct bigrams are one sorted array of 64-bit hashes
with the number of times that its learning texts have each; the array is cut into shards by hash. The worker
that has a shard keeps all its arrays in a memory-mapped file, merges them into the shard's part of the model (again sorted hashes
and counts) and answers every run with the counts of the whole corpus. So a bigram travels once per run and
not once per occurrence, a frequent one is as many entries as there are runs, and counting and looking up are one
shuffle. The distinct words of the runs are exchanged in the same way after the bigrams, with what the bigrams say about them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.llm.common import text_of
from ratescope.runtime import settle

U = np.uint64
#: Hashes of the two marks that stand around every text.
BEGIN, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Odd multipliers: of a bigram's words, of the byte weights, and of the finalizer.
FIRST, SECOND, WEIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
FINAL = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of text that are hashed, and array entries that are merged, at a time.
TEXT_BYTES, MERGED = 2 << 20, 4 << 20
#: Bytes of answers that are handed on together.
SENT_BYTES = 4 << 20
#: What the entries of the two exchanges carry: sums over the runs.
BIGRAM_VALUES = ("count",)
WORD_VALUES = ("count", "continuations", "followed_once", "followed_twice", "followed_more")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * FINAL[0]
    x = (x ^ (x >> U(27))) * FINAL[1]
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in ``data``, and how many each text has.

    A word's hash is the sum of its bytes (A-Z in lower case, plus one) times a weight per place, mixed; two
    words agree with a chance below 2**-56. Places and sums are found for all words at once.
    """
    solid = ~SPACE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | fresh[1 : len(data)]
    starts = np.flatnonzero(begins)
    words = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    if not len(starts):
        return np.empty(0, dtype=np.uint64), words
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    weights = mixed((np.arange(int(lengths.max()), dtype=np.uint64) + U(1)) * WEIGHT)
    sums = np.add.reduceat((LOWER[data[at]].astype(np.uint64) + U(1)) * weights[place], first)
    return mixed(sums + lengths.astype(np.uint64) * FIRST), words


def bigram_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before * FIRST + SECOND) + word * SECOND)


# --- arrays as bytes -------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, so that the zero bytes of small numbers lie together and compress away."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return packed(np.diff(keys, prepend=U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted ``keys`` starts; shards are equal ranges of hashes."""
    first = np.array([-(-(k << 64) // shards) for k in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])


# --- runs ------------------------------------------------------------------------------------


@dataclass
class Run:
    """The tokens of some texts: local word numbers, with the words' sorted hashes."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    learn: np.ndarray

    @staticmethod
    def of(row: dict) -> Run:
        return Run(unpacked_keys(row["words"]), unpacked(row["tokens"]).astype(np.int32), np.asarray(row["sizes"]), np.asarray(row["learn"], dtype=bool))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct bigrams' hashes in order, where each starts among the sorted tokens, that order, and the token before each token.

        Number len(words) stands for the begin of a text.
        """
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        keys = bigram_hashes(np.append(self.words, BEGIN)[before], self.words[self.tokens])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[starts], starts, order, before

    def learned(self) -> np.ndarray:
        """1 per token of a learning text, else 0."""
        return np.repeat(self.learn, self.sizes).astype(np.int64)


def _runs(docs: DataFrame, run_tokens: int, buckets: int) -> DataFrame:
    """The texts' runs as a table bucketed by run, which later joins read without a shuffle."""
    schema = T.StructType(
        [
            T.StructField("run", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)),
            T.StructField("learn", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("words", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        number, total = TaskContext.get().partitionId() << 32, 0

        def run() -> pa.RecordBatch:
            nonlocal number, total
            sizes = np.concatenate([h[2] for h in held])
            words, tokens = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            lists = [pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), pa.array(sizes, pa.int64())]
            at = pa.array([0, len(sizes)], pa.int32())
            columns = [pa.array([number], pa.int64()), *[pa.ListArray.from_arrays(at, x) for x in lists]]
            columns += [pa.array([x], pa.binary()) for x in (packed_keys(words), packed(tokens))]
            held.clear()
            number, total = number + 1, 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            row = 0
            while row < len(texts):
                upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + TEXT_BYTES, side="right")) - 1)
                part = bounds[row : upto + 1]
                hashes, counts = word_hashes(data[part[0] : part[-1]], part - part[0])
                hashes = np.insert(hashes, np.cumsum(counts), END)
                held.append((batch.column(0).slice(row, upto - row), batch.column(1).slice(row, upto - row), counts + 1, hashes))
                total += len(hashes)
                row = upto
                if total >= run_tokens:
                    yield run()
        if held:
            yield run()

    name = f"runs_{uuid.uuid4().hex}"
    made = docs.select("id", "learn", "text").mapInArrow(cut, schema)
    made.write.option("compression", "zstd").bucketBy(buckets, "run").saveAsTable(name)
    return docs.sparkSession.table(name)


# --- the exchange ----------------------------------------------------------------------------


def _block_schema(values: tuple[str, ...]) -> T.StructType:
    """A run's sorted entries that fall to one shard; run -1 holds entries of a model."""
    kinds = [("run", T.LongType()), ("shard", T.IntegerType()), ("keys", T.BinaryType()), *[(v, T.BinaryType()) for v in values]]
    return T.StructType([T.StructField(*k) for k in kinds])


def _blocks(run: int, keys: np.ndarray, values: list[np.ndarray], shards: int) -> Iterator[list]:
    bounds = shard_bounds(keys, shards)
    for shard in range(shards):
        a, b = bounds[shard], bounds[shard + 1]
        if b > a:
            yield [run, shard, packed_keys(keys[a:b]), *[packed(v[a:b]) for v in values]]


def _merged(blocks: DataFrame, values: tuple[str, ...], shards: int) -> DataFrame:
    """Every shard's sums, and every run's answer.

    Rows of kind "answer" have for a run's entries the sums over all runs and the model, in the run's order, with one
    bit per entry that is set in one run only; those of kind "model" are the shard's sorted hashes and their sums; those
    of kind "tally" how many of the model's entries have a first value of 1 to 4, and the sums of the values.
    A shard's arrays lie in a file that has no name and is mapped, so a shard may be larger than memory.
    """
    plain = [("kind", T.StringType()), ("run", T.LongType()), ("shard", T.IntegerType()), ("keys", T.BinaryType())]
    schema = T.StructType([T.StructField(*k) for k in [*plain, *[(v, T.BinaryType()) for v in values], ("owned", T.BinaryType()), ("tally", T.ArrayType(T.LongType()))]])

    def shard_rows(shard: int, runs: list[int], ends: list[int], spool) -> Iterator[list]:
        spool.flush()
        entries = np.memmap(spool, dtype=np.uint64, mode="r+", shape=(ends[-1], 1 + len(values)))
        blocks = [entries[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        pieces = max(1, -(-ends[-1] // MERGED))
        low, high = -(-(shard << 64) // shards), -(-((shard + 1) << 64) // shards)
        inner = np.array([low + (high - low) * k // pieces for k in range(1, pieces)], dtype=np.uint64)
        cuts = [np.concatenate([[0], np.searchsorted(b[:, 0], inner), [len(b)]]) for b in blocks]
        owned = [np.zeros(len(b), dtype=bool) for b in blocks]
        tally = np.zeros(4 + len(values), dtype=np.int64)
        for piece in range(pieces):
            spans = [(k, c[piece], c[piece + 1]) for k, c in enumerate(cuts) if c[piece + 1] > c[piece]]
            if not spans:
                continue
            keys, first, place = np.unique(np.concatenate([blocks[k][a:b, 0] for k, a, b in spans]), return_index=True, return_inverse=True)
            sums = np.zeros((len(values), len(keys)), dtype=np.uint64)
            for v in range(len(values)):
                np.add.at(sums[v], place, np.concatenate([blocks[k][a:b, 1 + v] for k, a, b in spans]))
            mine, done = np.zeros(len(place), dtype=bool), 0
            mine[first] = True
            for k, a, b in spans:
                here = slice(done, done + b - a)
                blocks[k][a:b, 1:] = sums[:, place[here]].T
                owned[k][a:b] = mine[here]
                done += b - a
            known = sums[0] > 0
            if known.any():
                yield ["model", -1, shard, packed_keys(keys[known]), *[packed(s[known]) for s in sums], None, None]
            tally[:4] += np.bincount(np.minimum(sums[1 if len(values) > 1 else 0], U(5)).astype(np.int64), minlength=6)[1:5]
            # the begin mark is no word of the vocabulary, so its count is left out
            counted = sums * (keys != BEGIN).astype(np.uint64)
            tally[4:] += counted.sum(axis=1).astype(np.int64)
            yield ["tally", -1, shard, None, *[None for _ in values], None, [*tally.tolist(), int((counted[0] > 0).sum())]]
            tally[:] = 0
        for k, run in enumerate(runs):
            if run >= 0:
                yield ["answer", run, shard, None, *[packed(blocks[k][:, 1 + v]) for v in range(len(values))], np.packbits(owned[k]).tobytes(), None]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards_in() -> Iterator[list]:
            shard, runs, ends, spool = None, [], [], None
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                    if row[1] != shard:
                        if runs:
                            yield from shard_rows(shard, runs, ends, spool)
                            spool.close()
                        shard, runs, ends, spool = row[1], [], [], tempfile.TemporaryFile()
                    table = np.stack([unpacked_keys(row[2]), *[unpacked(v) for v in row[3:]]], axis=1)
                    spool.write(table.tobytes())
                    runs.append(row[0])
                    ends.append((ends[-1] if ends else 0) + len(table))
            if runs:
                yield from shard_rows(shard, runs, ends, spool)
                spool.close()

        yield from _batches(shards_in(), schema)

    arranged = blocks.repartitionById(shards, "shard").sortWithinPartitions("shard", "run")
    return settle(arranged.mapInArrow(merge, schema))


def _batches(rows: Iterator[list], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= SENT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _answered(rows: pa.Table, values: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """A run's sums and owner bits, over all shards in order."""
    rows = rows.sort_by("shard")
    sums = [[unpacked(x.as_py()) for x in rows[v]] for v in values]
    bits = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(s)) for x, s in zip(rows["owned"], sums[0], strict=True)]
    return [np.concatenate(s).astype(np.int64) for s in sums], np.concatenate(bits).astype(bool)


def _bigram_blocks(runs: DataFrame, shards: int) -> DataFrame:
    schema = _block_schema(BIGRAM_VALUES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[list]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    run = Run.of(row)
                    keys, starts, order, _ = run.bigrams()
                    yield from _blocks(row["run"], keys, [np.add.reduceat(run.learned()[order], starts)], shards)

        yield from _batches(rows(), schema)

    return runs.select("run", "learn", "sizes", "words", "tokens").mapInArrow(blocks, schema)


def _word_blocks(runs: DataFrame, answers: DataFrame, shards: int, adding: bool) -> DataFrame:
    """Each run's words with their count and with what its own bigrams add to the words' statistics.

    A bigram counts for the run that owns it; beside a finished model (not ``adding``) it adds nothing.
    """
    schema = _block_schema(WORD_VALUES)

    def blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        run = Run.of(row)
        keys, starts, order, before = run.bigrams()
        (count,), owned = _answered(right, BIGRAM_VALUES)
        new = owned & (count > 0) & adding
        n = len(run.words) + 1
        picked, size = order[starts[new]], count[new]
        word, context = run.tokens[picked], before[picked]
        learned = run.learned()
        numbers = np.bincount(run.tokens, weights=learned, minlength=n).astype(np.int64)
        numbers[n - 1] = run.learn.sum()
        values = [numbers, np.bincount(word, minlength=n), *[np.bincount(context[k], minlength=n) for k in (size == 1, size == 2, size > 2)]]
        hashes = np.append(run.words, BEGIN)
        at = np.argsort(hashes)
        return pa.Table.from_batches(_batches(_blocks(row["run"], hashes[at], [v[at] for v in values], shards), schema))

    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(blocks, schema)


# --- the model -------------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and above, from how many entries have counts 1 to 4.

    Where a corpus is too small for them (one of the numbers is 0), or they leave [0, count], 1/2, 1 and 3/2 stand in.
    """
    n1, n2, n3, n4 = n
    usual = (0.5, 1.0, 1.5)
    if not (n1 and n2 and n3):
        return usual
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 <= d <= k + 1 for k, d in enumerate(found)) else usual


@dataclass
class Totals:
    """The corpus-wide numbers of a model."""

    tokens: int
    vocabulary: int
    bigrams: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float

    def word_probability(self, continuations: np.ndarray) -> np.ndarray:
        """By the number of different words before it, interpolated with equal shares of all words and the unknown."""
        equal = 1.0 / (self.vocabulary + 1)
        if not self.bigrams:
            return np.full(len(continuations), equal)
        cut = np.array([0.0, *self.word_discounts])[np.minimum(continuations, 3)]
        return (continuations - cut) / self.bigrams + self.word_left * equal


def _totals(bigrams: DataFrame, words: DataFrame) -> Totals:
    def summed(table: DataFrame, n: int) -> list[int]:
        row = table.where("kind = 'tally'").agg(*[F.sum(F.col("tally")[k]).alias(f"t{k}") for k in range(n)]).first()
        return [int(x or 0) for x in row]

    two = summed(bigrams, 4 + len(BIGRAM_VALUES) + 1)
    one = summed(words, 4 + len(WORD_VALUES) + 1)
    tokens, different, vocabulary = one[4], one[5], one[-1]
    d = discounts(one[:4])
    more = one[-1] - one[0] - one[1]
    left = (d[0] * one[0] + d[1] * one[1] + d[2] * more) / different if different else 1.0
    return Totals(tokens, vocabulary, different, discounts(two[:4]), d, left)


def _scores(runs: DataFrame, answers: DataFrame, totals: Totals, id_type: T.DataType) -> DataFrame:
    fields = [("id", id_type), ("learned", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    cuts = np.array([0.0, *totals.bigram_discounts])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        run = Run.of(left.drop_columns(["ids"]).to_pylist()[0])
        keys, starts, order, before = run.bigrams()
        order_of = right["order"].to_numpy()
        (count,), _ = _answered(right.filter(pa.array(order_of == 2)), BIGRAM_VALUES)
        hashes = np.append(run.words, BEGIN)
        at = np.argsort(hashes)
        sums, _ = _answered(right.filter(pa.array(order_of == 1)), WORD_VALUES)
        known, continuations, once, twice, more = (np.empty_like(s) for s in sums)
        for mine, s in zip((known, continuations, once, twice, more), sums, strict=True):
            mine[at] = s
        unigram = totals.word_probability(continuations)
        context_left = cuts[1] * once + cuts[2] * twice + cuts[3] * more
        picked = order[starts]
        word, context = run.tokens[picked], before[picked]
        seen = known[context]
        p = unigram[word]
        p = np.where(seen > 0, ((count - cuts[np.minimum(count, 3)]) + context_left[context] * p) / np.maximum(seen, 1), p)
        logs = np.empty(len(order))
        logs[order] = np.repeat(np.log10(p), np.diff(np.append(starts, len(order))))
        base = np.log10((known + 1) / (totals.tokens + totals.vocabulary + 1))
        first = np.cumsum(run.sizes) - run.sizes
        columns = [
            left["ids"].combine_chunks().flatten(),
            pa.array(run.learn),
            pa.array(run.sizes, pa.int64()),
            pa.array(np.add.reduceat((known[run.tokens] > 0).astype(np.int64), first)),
            pa.array(np.add.reduceat(base[run.tokens], first)),
            pa.array(np.add.reduceat(logs, first)),
        ]
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

    return runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(score, schema)


def _answers(merged: DataFrame, values: tuple[str, ...], order: int) -> DataFrame:
    missing = [F.lit(None).cast("binary").alias(v) for v in WORD_VALUES if v not in values]
    return merged.where("kind = 'answer'").select("run", "shard", *values, *missing, "owned", F.lit(order).alias("order"))


@dataclass
class Model:
    """Sorted hash arrays and their counts, per shard: ``bigrams`` and ``words``, with the corpus-wide ``totals``."""

    bigrams: DataFrame
    words: DataFrame
    totals: Totals
    shards: int


def _exchange(docs: DataFrame, model: Model | None, run_tokens: int) -> tuple[DataFrame, Model]:
    """Scores of ``docs`` (id, learn, text), and the model: the given one, or that of the rows to learn from."""
    shards = model.shards if model else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _runs(docs, run_tokens, shards)
    blocks = _bigram_blocks(runs, shards)
    two = _merged(blocks.union(model.bigrams) if model else blocks, BIGRAM_VALUES, shards)
    answers = _answers(two, BIGRAM_VALUES, 2)
    blocks = _word_blocks(runs, answers, shards, model is None)
    one = _merged(blocks.union(model.words) if model else blocks, WORD_VALUES, shards)
    if model is None:
        stored = [t.where("kind = 'model'").select("run", "shard", "keys", *v) for t, v in ((two, BIGRAM_VALUES), (one, WORD_VALUES))]
        model = Model(*stored, _totals(two, one), shards)
    both = answers.unionByName(_answers(one, WORD_VALUES, 1))
    return _scores(runs, both, model.totals, docs.schema["id"].dataType), model


def _named(docs: DataFrame, id_column: str, text_column: str, learn: Column) -> DataFrame:
    picked = docs.select(F.col(id_column).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_column).alias("text"))
    return picked.select("id", "learn", text_of("text").alias("text"))


def learn_and_score(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", run_tokens: int = 1 << 22
) -> tuple[DataFrame, Model]:
    """Learn a bigram model from the rows where ``learn`` holds, and score all rows with it.

    Words are runs of anything but ASCII white space, with A-Z in lower case; one end token follows them and is
    scored too. Returns the rows (id, learned, n_tokens, n_known, base_score, score), and the model. score is the
    sum of the tokens' log10 probabilities; base_score that of single words with one added to each count, an
    unknown word counted as one more. A null text counts as empty; a null ``learn`` as false; rows with equal ids
    are rows of their own; an empty table has no rows, and where nothing is learned from every token has
    probability 1. A text is never cut; a run holds ``run_tokens`` tokens, and a longer text is a run of its own.

    Two passes over the distinct bigrams and words of the runs go through the shuffle, and the runs themselves
    are a table bucketed by run, so what is moved grows with the distinct bigrams per run. The number of shards
    is that of shuffle partitions.
    """
    return _exchange(_named(docs, id_column, text_column, learn), None, run_tokens)


def score_texts(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", run_tokens: int = 1 << 22) -> DataFrame:
    """The same columns for ``docs`` under a model that was learned before, from its stored arrays; learned is false."""
    return _exchange(_named(docs, id_column, text_column, F.lit(False)), model, run_tokens)[0]


def corpus_scores(docs: DataFrame, folds: int = 7, held: int = 2, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; the rows whose CRC-32 of the decimal doc_id leaves ``held`` are not learned from (a null id is)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    found, model = learn_and_score(docs, F.coalesce(fold != held, F.lit(True)), **settings)
    return found.select(
        F.col("id").alias("doc_id"),
        (~F.col("learned")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.totals.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
