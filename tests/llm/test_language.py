"""Bigram scores against a plain Python model, on odd rows too."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratescope.llm import kneser_ney as kn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, learn string, run int, shard int, keys string"


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


class Plain:
    """The model by the textbook, with dictionaries."""

    def __init__(self, texts):
        self.pairs, self.count = Counter(), Counter()
        for text in texts:
            tokens = tokens_of(text)
            self.count.update(tokens)
            self.pairs.update(zip(["<begin>", *tokens[:-1]], tokens, strict=True))
        self.total, self.size = sum(self.count.values()), len(self.count)
        self.after, self.before = defaultdict(list), Counter()
        for (v, w), n in self.pairs.items():
            self.after[v].append(n)
            self.before[w] += 1
        self.d2 = self.cuts(self.pairs.values())
        self.d1 = self.cuts(self.before.values())

    @staticmethod
    def cuts(numbers):
        n = Counter(numbers)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, *[k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]]
        return d if all(0 <= d[k] <= k for k in range(4)) else [0, 0.5, 1, 1.5]

    def one(self, w):
        if not self.pairs:
            return 1 / (self.size + 1)
        left = sum(self.d1[min(n, 3)] for n in self.before.values()) / len(self.pairs)
        n = self.before[w]
        return (n - self.d1[min(n, 3)]) / len(self.pairs) + left / (self.size + 1)

    def two(self, v, w):
        if v not in self.after:
            return self.one(w)
        total = sum(self.after[v])
        n = self.pairs[v, w]
        return (n - self.d2[min(n, 3)]) / total + sum(self.d2[min(x, 3)] for x in self.after[v]) / total * self.one(w)

    def row(self, text):
        tokens = tokens_of(text)
        known = sum(self.count[t] > 0 for t in tokens)
        base = sum(math.log10((self.count[t] + 1) / (self.total + self.size + 1)) for t in tokens)
        score = sum(math.log10(self.two(v, w)) for v, w in zip(["<begin>", *tokens[:-1]], tokens, strict=True))
        return len(tokens), known, base, score


def invented(n, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(n):
        at, text = int(rng.zipf(1.5)) % 300, []
        for _ in range(int(rng.integers(0, 60))):
            text.append(words[at].upper() if rng.random() < 0.1 else words[at])
            at = (at * 7 + int(rng.zipf(1.7))) % 300
        texts.append(" ".join(text))
    return texts


ODD = [None, "", " \t\n", "a", "A a\x0ba\x85e é É", "the " * 3000, "x" * 5000, "same text", "same text", "\x00 \x01"]


def check(rows, plain, texts):
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["id"]].append((r["n_tokens"], r["n_known"], r["base_score"], r["score"]))
    want = defaultdict(list)
    for k, text in texts:
        want[k].append(plain.row(text))
    assert set(by_id) == set(want)
    for k, found in by_id.items():
        for a, b in zip(sorted(found), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


@pytest.mark.parametrize("run_tokens", [50, 1 << 22])
def test_scores_are_those_of_a_plain_model(spark, run_tokens):
    texts = [*enumerate([*invented(200), *ODD]), (3, "twice the same id"), (None, "no id")]
    held = lambda k: k is not None and k % 5 == 0
    frame = spark.createDataFrame([(k, t, "x", 1, 2, "y") for k, t in texts], SCHEMA).repartition(3)
    found, model = kn.learn_and_score(frame, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)), run_tokens=run_tokens)
    plain = Plain([t for k, t in texts if not held(k)])
    rows = found.collect()
    check(rows, plain, texts)
    assert all(r["learned"] != held(r["id"]) for r in rows)
    assert (model.totals.tokens, model.totals.vocabulary, model.totals.bigrams) == (plain.total, plain.size, len(plain.pairs))
    # a model is a distribution: over all words, the end and one unknown word
    for v in ("<begin>", "w1", "unheard"):
        assert sum(plain.two(v, w) for w in plain.count) + plain.two(v, "unknown") == pytest.approx(1)
    # new texts under the stored arrays
    fresh = [(k, t) for k, t in enumerate([*invented(30, seed=9), *ODD])]
    later = kn.score_texts(spark.createDataFrame(fresh, "doc_id long, text string"), model, run_tokens=run_tokens)
    check(later.collect(), plain, fresh)


def test_shards_larger_than_a_merge(spark, monkeypatch):
    texts = list(enumerate(invented(60)))
    blocks = list(kn._blocks(0, np.array([1, 5, 2**63, 2**64 - 1], dtype=np.uint64), [np.array([1, 2, 3, 4])], 3))
    assert [b[1] for b in blocks] == [0, 1, 2]
    assert [kn.unpacked_keys(b[2]).tolist() for b in blocks] == [[1, 5], [2**63], [2**64 - 1]]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(kn, "MERGED", 100)
    found, _ = kn.learn_and_score(frame, F.lit(True), run_tokens=300)
    check(found.collect(), Plain([t for _, t in texts]), texts)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert kn.learn_and_score(none, F.lit(True))[0].count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    found, model = kn.learn_and_score(one, F.lit(None).cast("boolean"))
    row = found.first()
    assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"], model.totals.tokens) == (3, 0, 0, 0, 0)


def test_query_columns_and_folds(spark):
    texts = list(enumerate(invented(80)))
    held = {k for k, _ in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    rows = kn.corpus_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    plain = Plain([t for k, t in texts if k not in held])
    assert {r["doc_id"] for r in rows if r["held_out"]} == held and {r["train_tokens"] for r in rows} == {plain.total}


def test_word_hashes_follow_the_words():
    texts = ["a B\tab", "", "ab a", "A", "é\x0bÉ", "b" * 300 + " " + "b" * 299, " "]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    hashes, counts = kn.word_hashes(data, bounds)
    words = [w for t in texts for w in tokens_of(t)[:-1]]
    assert counts.tolist() == [len(tokens_of(t)) - 1 for t in texts]
    assert len(hashes) == len(words)
    assert len(set(zip(hashes.tolist(), words, strict=True))) == len(set(hashes.tolist())) == len(set(words))
