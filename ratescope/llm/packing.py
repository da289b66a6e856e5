"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.llm.common import in_pieces, ranks_within, small_batches, text_of
from ratescope.runtime import settle


#: How byte-level tokenizers write a byte: printable Latin-1 as it is, the others from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTED)}


#: Letters, digits and marks up to U+024F but the dotted capital I: lower case goes letter by letter there, and nothing composes.
SIMPLE = re.compile("[!-\u012f\u0131-\u024f]+")
#: What the tokenizer takes for the pieces of a word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordTokens(dict):
    """Words and their token ids, as little-endian unsigned 32-bit numbers; filled as words are met.

    For tokenizers that drop white space and never merge across it, the ids of a text are those of
    its words. So a word is tokenized once and a text is put together by look-ups. Of simple words
    (see ``SIMPLE``) the tokenizer's preparation changes the case only, so their pieces' merges are asked for
    directly, half the work, and once for all cases of their letters. A comma or full stop after a letter is a token of
    its own and looked up apart, unless the letter's lower case ends in a mark, which would join the stop. With ``most_words`` / 2 words the table starts anew; the one before stays at hand
    until then, so words that come often are not forgotten.
    """

    def __init__(self, vocabulary: str, most_words: int = 600_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.most_words = most_words

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word[-1:] in (",", ".") and word[-2:-1].isalpha() and word[-2].lower()[-1].isalpha():
                ids = self[word[:-1]] + self[word[-1]]
            elif SIMPLE.fullmatch(word) and word != (small := word.lower()) and "<|" not in word:
                ids = self[small]
            else:
                ids = self._encode(word)
        if 2 * len(self) >= self.most_words:
            self.older = self.copy()
            self.clear()
        self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        if not SIMPLE.fullmatch(word) or "<|" in word:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        small, ids = word.lower(), []
        for piece in [small] if small.isalpha() else PIECES.findall(small):
            letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids += [t.id for t in self.merges.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        # split() also splits at these four, which the tokenizers take for symbols
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return b"".join(map(self._encode, text.split(" ")))
        return b"".join(map(self.__getitem__, text.split()))


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(vocabulary: str) -> WordTokens:
    """The tokenizer of this worker, loaded once."""
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = WordTokens(vocabulary)
    return _TOKENS[vocabulary]


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut where they exceed ``capacity``."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"))
    source = source.select("id", "row", text_of("text").alias("text"))
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([*source.schema.fields[:2], *[T.StructField(*f) for f in fields]])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in in_pieces(batches, 2):
            places, pieces, starts, lengths, sums = [], [], [], [], []
            for place, text in enumerate(batch.column(2)):
                ids = tokens.ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    places.append(place)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            at = pa.array(places, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(pieces, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(cut, schema)


def _complement(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Lengths on hand, one to three of them, that add up to ``gap``; the longest first."""
    if gap < len(counts) and counts[gap]:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        top = min(most, total - 1)
        low = (total + 1) // 2
        if top < low:
            return None
        longer = np.arange(top, low - 1, -1)
        hit = (counts[longer] > 0) & (counts[total - longer] > 0) & ((longer * 2 != total) | (counts[longer] > 1))
        at = int(hit.argmax())
        return (int(longer[at]), total - int(longer[at])) if hit[at] else None

    most = min(gap, len(counts) - 1)
    found = pair(gap, most)
    if found:
        return found
    for first in np.flatnonzero(counts[: most + 1])[::-1]:
        first = int(first)
        if first * 3 < gap:
            break
        counts[first] -= 1
        rest = pair(gap - first, first)
        counts[first] += 1
        if rest:
            return (first, *rest)
    return None


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many such sequences), from the number of pieces of each length.

    The longest length on hand opens a sequence. If one, two or three lengths exactly fill its gap,
    they close it; else the longest that fits goes in (best fit) and the search is made again. A
    combination is used as often as all its lengths are on hand, so each step uses one length up
    (or leaves less than one more sequence needs), and the number of steps depends on the
    capacity, not on the number of pieces.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            chosen, gap = [longest], capacity - longest
            counts[longest] -= 1
            while gap:
                closing = _complement(counts, gap)
                if closing is None:
                    fitting = np.flatnonzero(counts[: gap + 1])
                    if not len(fitting):
                        break
                    closing = (int(fitting[-1]),)
                for length in closing:
                    counts[length] -= 1
                    chosen.append(length)
                    gap -= length
            lengths, used = np.unique(chosen, return_counts=True)
            more = int((counts[lengths] // used).min())
            counts[lengths] -= more * used
            plan.append((chosen, 1 + more))
    return plan


def plan_table(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: piece number rank in [first, last) of a length goes to sequence
    ``sequence + (rank - first) div per`` at ``offset + (rank - first) mod per * length``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(set(chosen), reverse=True):
            per = chosen.count(length)
            first = used.get(length, 0)
            used[length] = first + per * times
            rows.append((length, first, used[length], sequence, per, offset))
            offset += per * length
        sequence += times
    return pd.DataFrame(rows, columns=["of_length", "first", "last", "sequence", "per", "offset"], dtype="int64")


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    rows_per_part: int = 50_000,
) -> DataFrame:
    """Every piece of every text with its sequence and place there.

    Only the number of pieces per length (at most ``capacity`` rows) reaches the driver. The plan made
    from it is a table of length and rank ranges; its rows are bounded by the capacity too, so it
    may be broadcast. Pieces get their rank among those of their length in parts, so that a
    frequent length is many tasks. Null and empty texts are one piece that holds the end id alone;
    rows with equal ids are packed one by one.
    """
    pieces = settle(token_pieces(docs, vocabulary, capacity, end_id, id_column, text_column))
    spark = docs.sparkSession
    counted = pieces.groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in counted}
    plan = spark.createDataFrame(plan_table(packing_plan(histogram, capacity)), "of_length long, first long, last long, sequence long, per long, offset long")
    parts = max(16, -(-max(histogram.values(), default=0) // rows_per_part))
    ranked = ranks_within(pieces, ["length"], ["row", "piece"], "rank", F.xxhash64("row", "piece"), parts)
    inside = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    at = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(plan), inside).select(
        F.col("id").alias(id_column),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per"))).alias("sequence_id"),
        (F.col("offset") + at % F.col("per") * F.col("length")).alias("offset"),
    )
