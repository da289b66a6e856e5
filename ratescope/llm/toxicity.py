"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import Binarizer, HashingTF, RegexTokenizer, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.llm.common import text_of, unused_name
from ratescope.runtime import settle

#: Counters that terms are hashed to.
BUCKETS = 1 << 18
#: A counter makes one 0/1 feature for each of these: whether it exceeds the number.
OVER = (0.5, 1.5, 3.5)


def held_out(identifier: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: its id, as text, has a CRC-32 divisible by ``folds``. A null id is kept out."""
    return F.coalesce(F.crc32(identifier.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _hashed() -> PipelineModel:
    """How often each term occurs in a whole text, as a sparse vector.

    Terms are runs of letters in lower case, and their beginnings of four and six letters, which
    words of one stem share.
    """
    split = RegexTokenizer(inputCol="text", outputCol="terms", pattern=r"[^\p{L}]+")
    begin = "transform(filter(terms, x -> length(x) > {0}), x -> concat(substr(x, 1, {0}), '-'))"
    stems = SQLTransformer(statement=f"SELECT *, concat(terms, {begin.format(4)}, {begin.format(6)}) AS stems FROM __THIS__")
    return PipelineModel([split, stems, HashingTF(inputCol="stems", outputCol="hashed", numFeatures=BUCKETS)])


def _features(chosen: list[int]) -> list:
    slicer = VectorSlicer(inputCol="hashed", outputCol="chosen", indices=chosen)
    steps = [Binarizer(inputCol="chosen", outputCol=f"over_{k}", threshold=x) for k, x in enumerate(OVER)]
    return [slicer, *steps, VectorAssembler(inputCols=[f"over_{k}" for k in range(len(OVER))], outputCol="features")]


def _telling(counts: dict[float, tuple[int, np.ndarray]], terms: int, least: int, telling: float) -> list[int]:
    """The counters with the highest chi-square between the classes, of at least ``telling``; at least one."""
    (n0, with0), (n1, with1) = counts[0.0], counts[1.0]
    n, hit = n0 + n1, with0 + with1
    expected = hit * n1 / n
    spread = hit * (1 - hit / n) * n1 / n * n0 / n
    chi = np.where((hit >= least) & (spread > 0), (with1 - expected) ** 2 / np.maximum(spread, 1e-12), 0.0)
    best = np.lexsort((np.arange(len(chi)), -chi))[:terms]
    chosen = [int(i) for i in best if chi[i] >= telling]
    return sorted(chosen) or [int(best[0])]


class ToxicityModel:
    """Scores texts; made by ``fit_toxicity``. Without both classes the score is the share of toxic rows."""

    def __init__(self, stages: list | None, share: float):
        self.stages, self.share = stages, share

    def score(self, docs: DataFrame, text_column: str = "text", name: str = "score") -> DataFrame:
        """``docs`` and the column ``name``: a row-wise step, without a shuffle. Null and empty texts are texts without terms."""
        inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text_column).alias("text"))
        if self.stages is None:
            scored = inner.withColumn("probability_1", F.lit(self.share))
        else:
            scored = PipelineModel([*_hashed().stages, *self.stages]).transform(inner)
            scored = scored.withColumn("probability_1", vector_to_array("probability")[1])
        return scored.select("row.*", F.col("probability_1").alias(name))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    most_labels: int = 20_000,
    terms: int = 1024,
    least: int = 5,
    telling: float = 10.8,
    factors: int = 4,
    rounds: int = 80,
    step: float = 0.1,
    penalty: float = 1e-3,
    seed: int = 7,
) -> ToxicityModel:
    """Learn the score from labelled rows that are not held out.

    The score of a text is sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over its terms: the
    factors v learn pairs, such as an insult together with the mention of a group, that are more or
    less toxic than their parts. Training takes at most ``most_labels`` labelled ids, those with the
    smallest hashes; that bound also makes the list of ids safe to broadcast to the scan of the texts. Of several labels
    of one id the highest counts; null ids and labels are left out. Terms are hashed
    to BUCKETS counters; the ``terms`` of them that tell the classes apart best (chi-square) are used, among those
    that ``least`` training rows have and whose chi-square is at least ``telling`` (one counter in a
    thousand gets there by chance), so that the machine cannot explain labels by chance terms.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_labels)
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    hashed = _hashed().transform(texts.join(F.broadcast(known), "id"))
    train = settle(hashed.select("label", "hashed"))
    found = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), Summarizer.numNonZeros(F.col("hashed")).alias("with"))
    counts = {r["label"]: (r["n"], r["with"].toArray()) for r in found.collect()}
    if set(counts) != {0.0, 1.0}:
        n = sum(v[0] for v in counts.values())
        return ToxicityModel(None, counts.get(1.0, (0,))[0] / n if n else 0.0)
    steps = _features(_telling(counts, terms, least, telling))
    machine = FMClassifier(
        featuresCol="features", labelCol="label", factorSize=factors, regParam=penalty, maxIter=rounds, stepSize=step, seed=seed, initStd=0.01, tol=1e-6
    )
    return ToxicityModel([*steps, machine.fit(PipelineModel(steps).transform(train))], 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """id, held_out, score and predicted (1 from a score of 0.5) of every row of ``docs``."""
    model = fit_toxicity(docs, labels, id_column, text_column, **settings)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return model.score(texts).select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows predicted to be toxic, all columns unchanged."""
    name = unused_name(docs, "score")
    model = fit_toxicity(docs, labels, id_column, text_column, **settings)
    return model.score(docs, text_column, name).where(F.col(name) < 0.5).select(*docs.columns)
