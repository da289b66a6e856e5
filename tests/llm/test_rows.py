"""Exact duplicates, mixing, shards and packing on odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratescope.llm import common, exact, mixing, packing, shards, shingles
from ratescope.llm.common import in_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, run int, size long, best string, id long"
LONG = "wörd, Word. " * 9000
TEXTS = [None, "", "a", "a", "A", " a", LONG, LONG, "İstanbul ΣΑΣ don't <|endoftext|> x\x1cy", "é. x́, 日本語. 12,3", "a b\tc\x0bd\x85e\xa0f"]
ROWS = [(k, t, "en", s, 3, 1, 2, 5, "b", 9) for k, (t, s) in enumerate(zip(TEXTS, ["x", None, "y", "x"] * 3, strict=False))]
ROWS += [(2, "a", "en", "y", 3, 1, 2, 5, "b", 9), (2, "a", "en", "y", 3, 1, 2, 5, "b", 9), (None, "a", "en", None, 0, 1, 2, 5, "b", 9), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep,fan_in", [("largest", 2), ("smallest", 8)])
def test_exact_duplicates(docs, keep, fan_in):
    groups = defaultdict(list)
    for row in ROWS:
        groups[row[1] or ""].append(row[0])
    found = exact.exact_duplicates(docs, keep=keep, fan_in=fan_in).collect()
    assert len(found) == len(ROWS)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    pick = max if keep == "largest" else min
    for r in found:
        ids = by_digest[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == pick((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(list(by_digest))


def test_drop_exact_duplicates_keeps_columns(docs, none):
    kept = exact.drop_exact_duplicates(docs, keep="largest")
    assert kept.columns == docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({t or "" for t in TEXTS})
    assert exact.drop_exact_duplicates(none).count() == 0


def test_written_rows_are_numbered_without_a_copy(spark, docs, none, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/docs")
    docs.where("doc_id = 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    written, copied = spark.read.parquet(f"{tmp_path}/docs"), []
    for module in (common, exact, mixing, shingles):
        monkeypatch.setattr(module, "settle", lambda df, of=module.settle: copied.append(df.columns) or of(df))
    numbered, row = common.with_row_numbers(written, written=True)
    first, again = (Counter(tuple(r) for r in x.collect()) for x in (numbered, numbered.repartition(3)))
    assert first == again and row == "row_" and len({r[row] for r in numbered.collect()}) == len(ROWS) + 1
    for step in (lambda d, **s: exact.drop_exact_duplicates(d, keep="largest", **s), shingles.drop_near_duplicates, mixing.mix):
        got = step(written, written=True)
        assert got.columns == docs.columns
        texts = Counter(r["text"] for r in got.collect())
        assert copied and not any("text" in c for c in copied)
        assert texts == Counter(r["text"] for r in step(written).collect())
        copied.clear()
    none.write.parquet(f"{tmp_path}/none")
    assert mixing.mix(spark.read.parquet(f"{tmp_path}/none"), written=True).count() == 0


def water_filled(sizes, weights, most):
    """Share by weight, fix what is above its limit, share the excess again."""
    left, fixed = set(sizes), {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        for s in above:
            fixed[s] = most * sizes[s]
            left.remove(s)


def test_targets_are_water_filled(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 1, "e": 0, "é": 77, "z": 5}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = water_filled(sizes, weights, 3)
    assert got == pytest.approx(want)


def test_sainte_lague_takes_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for seats in (0, 1, 7, 100):
        votes = {f"p{k:02}": int(v) for k, v in enumerate(rng.integers(0, 60, 12))}
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() if v for k in range(seats)), key=lambda x: (x[0], x[1]))[:seats]
        want = Counter(p for _, p in quotients)
        frame = spark.createDataFrame([(1, p, float(v), seats) for p, v in votes.items()], "g int, p string, votes double, seats int")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(frame, ["g"], "votes", "seats", ["p"]).collect()}
        assert got == {p: want[p] for p in votes}


def test_mix(spark, docs, none):
    texts = [f"w{k} " * (k % 40) for k in range(600)]
    frame = spark.createDataFrame([(k, t, "abc"[k % 7 % 3], 1) for k, t in enumerate(texts)], "doc_id long, text string, source string, size long")
    plan = mixing.mix_plan(frame, shard_words=1 << 10)
    rows = plan.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 32
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(frame.repartition(3), shard_words=1 << 10).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mix(frame, shard_words=1 << 10)
    assert mixed.columns == frame.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {k: v for k, v in again.items() if v}
    assert mixing.mix(none).count() == 0 and mixing.mix_plan(none).count() == 0
    odd = mixing.mix_plan(docs).collect()
    assert len(odd) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in odd)
    assert mixing.mix(docs).columns == docs.columns


def test_shards(docs, none, spark):
    rows = shards.shard_rows(docs, 24, rows_per_part=2).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.shard_rows(none, 24).count() == 0
    keys = spark.range(20000)
    moved = keys.select(*[shards.jump_shard(keys["id"], n).alias(f"n{n}") for n in (1, 7, 8, 24, 25)]).collect()
    assert all(r["n1"] == 0 and (r["n8"] == r["n7"] or r["n8"] == 7) and (r["n25"] == r["n24"] or r["n25"] == 24) for r in moved)
    assert abs(sum(r["n25"] == 24 for r in moved) / 20000 - 1 / 25) < 0.006
    counts = Counter(r["n24"] for r in moved)
    assert len(counts) == 24 and max(counts.values()) < 1.25 * 20000 / 24


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokens_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokens = packing.WordTokens(VOCABULARY, most_words=12)
    for text in [t or "" for t in TEXTS] + ["<|EndOfText|>. ªº µ ß, ÀÞ.", "U.S.A., it's 's x's. a..b", "ﬁ Å Ω ſ"]:
        assert tokens.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_random_words_have_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokens = packing.WordTokens(VOCABULARY)
    rng = np.random.default_rng(17)
    letters = [*"abcIiEstzĞİıŞßéÀÿªº", "ﬁ", "Ω", "ſ", "Ǆ", "ŉ", "\u0307", "\u0301", "日", "я", "𝐀", *".,.,-'’!?0123 \t\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 9))))
        assert tokens.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)
    for text in ("İ.", "TÜRKİYE TARİHİ. son", "İ,"):
        assert tokens.ids(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_pieces_are_all_rows_in_order(most):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["", None, "abc", "x" * 50, "", "é", "y"])], names=["k", "t"])
    pieces = list(in_pieces(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), 1, most))
    assert [k for p in pieces for k in p.column(0).to_pylist()] == [*range(7), 2, 3, 4]
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= most for p in pieces)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack(docs, none, capacity):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for k, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[at : at + capacity], dtype="<u4").tobytes()
            want[(k, piece, at, len(part) // 4, zlib.crc32(part))] += 1
    rows = packing.pack(docs, VOCABULARY, capacity, rows_per_part=3).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(none, VOCABULARY, capacity).count() == 0


def test_plan_fills_gaps_exactly():
    rng = np.random.default_rng(5)
    lengths = Counter(np.minimum(4096, rng.lognormal(6, 1, 20000).astype(int) + 1).tolist())
    plan = packing.packing_plan(dict(lengths), 4096)
    used = Counter()
    for chosen, times in plan:
        assert sum(chosen) <= 4096
        for length in chosen:
            used[length] += times
    assert used == lengths
    least = -(-sum(k * v for k, v in lengths.items()) // 4096)
    assert sum(times for _, times in plan) <= 1.002 * least + 1
    assert packing.packing_plan({}, 4096) == []
