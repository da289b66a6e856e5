"""Fill-in-the-middle by displacement scatter: every byte of a batch moves by a shift that its segment sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescope.llm.common import text_of, unused_name

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = len(PREFIX)
#: Forms by number, as the batches carry them.
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes of text that are rearranged at a time; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """``count`` (at most 8) unsigned 32-bit numbers from the SHA-256 of ``seed``, a colon and the key in decimal."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def cut_plan(docs: DataFrame, id_column: str, text_column: str, plain_percent: int, spm_percent: int, seed: int) -> DataFrame:
    """``docs`` with n, form and the cuts: where the prefix and the middle end, in code points."""
    text = text_of(text_column)
    n = F.char_length(text).cast("long")
    h1, h2, h3, h4 = draws(F.col(id_column), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (n == 0) | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cuts = F.array(h1 % (n + 1), h2 % (n + 1))
    return docs.select(
        "*",
        n.alias("n"),
        form.alias("form"),
        F.when(form != "plain", F.array_min(cuts)).alias("first_cut"),
        F.when(form != "plain", F.array_max(cuts)).alias("second_cut"),
    )


def _running(deltas_at: np.ndarray, deltas: np.ndarray, size: int) -> np.ndarray:
    """The sum of all deltas at or before each of ``size`` places."""
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, deltas_at, deltas.astype(np.int32))
    return np.cumsum(steps[:size], dtype=np.int32)


def scattered(data: np.ndarray, bounds: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rearranged bytes of a batch and the bounds of its outputs.

    ``bounds`` are the n + 1 byte bounds of the texts, the cuts are counted in code points. The cuts'
    bytes are found by one scan for first bytes of code points. Each segment has one shift for all its
    bytes; the shifts' differences are put where segments start, their running sum is every byte's
    displacement, and one scatter writes all outputs. The marks are a second scatter.
    """
    begin, end = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(heads, begin)
    heads = np.append(heads, len(data))
    moved = form != PLAIN
    # a cut at the end of a text is where the next text starts, whose first byte is the next head
    a = np.where(moved, heads[np.minimum(before + first, len(heads) - 1)], begin)
    b = np.where(moved, heads[np.minimum(before + second, len(heads) - 1)], begin)
    out = np.concatenate([[0], np.cumsum(end - begin + 3 * MARK * moved)])
    start, suffix = out[:-1], end - b
    psm = form == PSM
    # where the segments go: prefix, middle, suffix; a plain text is all suffix
    to_prefix = start + np.where(psm, MARK, 2 * MARK + suffix)
    to_middle = start + 3 * MARK + (a - begin) + suffix
    to_suffix = start + np.where(moved, np.where(psm, 2 * MARK + a - begin, MARK), 0)
    shifts = np.stack([to_prefix - begin, to_middle - a, to_suffix - b])
    at = np.stack([begin, a, b]).T.ravel()
    deltas = np.diff(shifts.T.ravel(), prepend=0)
    shift = _running(at, deltas, len(data))
    result = np.empty(out[-1], dtype=np.uint8)
    result[np.arange(len(data), dtype=np.int32) + shift] = data
    for mark, place in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        for k, byte in enumerate(mark.encode()):
            result[place[moved] - MARK + k] = byte
    return result, out


def gathered(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts again, from outputs and forms alone: the inverse gather.

    The marks are searched in the outputs. They start with < and end with >, and no text of these forms holds
    one, so none arises across the end of a segment. A moved output without its three marks is an error.
    """
    begin, end = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    moved = form != PLAIN
    opens = np.flatnonzero((data[:-2] == PREFIX.encode()[0]) & (data[2:] == PREFIX.encode()[2])) if len(data) > 2 else np.empty(0, np.int64)
    owner = np.searchsorted(end, opens, side="right")
    opens = opens[moved[owner] & (opens + MARK <= end[owner])]
    found = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found[mark] = opens[data[opens + 1] == mark.encode()[1]]
        if len(found[mark]) != moved.sum() or (np.searchsorted(end, found[mark], side="right") != np.flatnonzero(moved)).any():
            raise ValueError(f"an output does not hold {mark} exactly once")
    p, s, m = (found[mark] for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = form[moved] == PSM
    lengths = end - begin - 3 * MARK * moved
    back = np.concatenate([[0], np.cumsum(lengths)])
    start = back[:-1]
    # what prefix, middle and suffix are read from, and where they start in the text
    n_prefix = np.where(psm, s, m) - p - MARK
    n_middle = end[moved] - m - MARK
    at = np.stack([start, start, start])
    shifts = np.stack([begin - start] * 3)
    at[1, moved] += n_prefix
    at[2, moved] += n_prefix + n_middle
    shifts[0, moved] = p + MARK - at[0, moved]
    shifts[1, moved] = m + MARK - at[1, moved]
    shifts[2, moved] = s + MARK - at[2, moved]
    shift = _running(at.T.ravel(), np.diff(shifts.T.ravel(), prepend=0), int(back[-1]))
    return data[np.arange(back[-1], dtype=np.int32) + shift], back


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows with about PIECE_BYTES together; a longer row is alone."""
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        limit = (ends[row - 1] if row else 0) + PIECE_BYTES
        upto = max(row + 1, int(np.searchsorted(ends, limit, side="right")))
        yield slice(row, upto)
        row = upto


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the bounds of its texts, from 0."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers).cast(pa.string())


def _mapped(df: DataFrame, inputs: list[str], output: str, change) -> DataFrame:
    """``df`` with a text column ``output``, made batch by batch from ``inputs`` (the text first).

    A batch is worked through in pieces of some megabytes, and every piece is handed on before the next one.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            sizes = np.diff(_buffers(taken[0])[1])
            for rows in _pieces(sizes):
                n = rows.stop - rows.start
                data, bounds = _buffers(taken[0].slice(rows.start, n))
                rest = [c.slice(rows.start, n).fill_null(0).to_numpy(zero_copy_only=False) for c in taken[1:]]
                made = _strings(*change(data, bounds, *rest))
                yield pa.RecordBatch.from_arrays([*batch.slice(rows.start, n).columns, made], names=names)

    return df.mapInArrow(work, schema)


def _form_number(form: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in FORMS]), form).cast("int") - 1


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
) -> DataFrame:
    """``docs`` cut for fill-in-the-middle training, one row per row.

    Adds n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.
    Both cuts, the form and the order follow from the seed and the id alone, so repeated
    tasks and reruns agree; rows with equal ids and texts get equal outputs. A text is plain if it is
    empty, holds a mark, or by ``plain_percent``. A null text counts as empty, a null id as an empty key.
    Columns of ``docs`` that have the name of an added one are replaced by it, but for the id and the text.
    """
    clash = {"n", "form", "first_cut", "second_cut", "prefix_chars", "middle_chars", "output"} - {id_column, text_column}
    kept = docs.drop(*clash)
    planned = cut_plan(kept, id_column, text_column, plain_percent, spm_percent, seed)
    number = unused_name(planned, "number_")
    missing = unused_name(planned, "missing_")
    ready = planned.withColumns({number: _form_number(F.col("form")), missing: F.col(text_column).isNull(), text_column: text_of(text_column)})
    out = _mapped(ready, [text_column, number, "first_cut", "second_cut"], "output", scattered)
    out = out.withColumn(text_column, F.when(~F.col(missing), F.col(text_column)))
    return out.select(
        *kept.columns,
        "n",
        "form",
        F.col("first_cut").alias("prefix_chars"),
        (F.col("second_cut") - F.col("first_cut")).alias("middle_chars"),
        "output",
    )


def restore(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``rows`` with the texts that ``output`` was made from, as column ``restored``.

    Only the outputs and their forms are read. An output whose form says that it has marks but that lacks
    one, or has one twice, is an error.
    """
    number = unused_name(rows, "number_")
    ready = rows.withColumn(number, _form_number(F.col(form)))
    return _mapped(ready, [output, number], restored, gathered).drop(number)


def middle_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    out = restore(fill_in_middle(docs.select(id_column, text_column), id_column, text_column).drop(text_column))
    return out.select(
        id_column,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
