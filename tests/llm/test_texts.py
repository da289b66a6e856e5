"""Jaccard join, toxicity, personal data, licences, pages and vectors on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratescope.llm import licenses, neighbours, pages, personal, shingles, toxicity
from ratescope.llm.components import components

LETTERS = "abcdefghij"


def near_copies(seed):
    """Texts with copies, near copies around the threshold, chains, shared passages and odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  ", "one", "One", "one two", "a b c d e", "A b c d\te ", "x " * 3000]
    for size in (12, 40, 150, 400):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base + passage))
        texts.append(" ".join(base[: int(size * 0.82)]))
    chain = [word() for _ in range(120)]
    for _ in range(12):
        chain = [*chain[2:], word(), word()]
        texts.append(" ".join(chain))
    base = [word() for _ in range(100)]
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    return texts


def brute_components(rows):
    sets, parent = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("settings", [{}, {"small": 4, "block_rows": 16, "bits": 10}])
def test_jaccard_components(spark, settings):
    rows = list(enumerate(near_copies(1)))
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, `set` int").repartition(5).cache()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.jaccard_components(docs, **settings).collect()}
    want = brute_components(rows)
    assert got == want
    if settings:
        kept = shingles.drop_near_duplicates(docs, **settings)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (n, c) in want.items() if n == 0 or c == k)


def test_jaccard_without_rows_and_with_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert shingles.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "q"), (None, None)], schema)
    got = sorted(map(repr, (tuple(r) for r in shingles.jaccard_components(docs).collect())))
    assert got == sorted(map(repr, [(None, 2, 5), (5, 2, 5), (5, 2, 5), (5, 1, 5), (None, 0, None)]))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 8), (3, 1), (7, 6), (6, 5), (5, 4), (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4, 5: 4, 6: 4, 7: 4}
    assert components(links.limit(0), "a", "b").count() == 0


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(1500):
        words = ["".join(rng.choice(LETTERS) for _ in range(3)) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Dolt,", "knave", "OAF."])
        rows.append((k, " ".join(words), 1.0))
        marks.append((k, int(bad)))
    rows += [(None, None, 1.0), (9001, "", 1.0), (9002, "dolt " * 20000, 1.0), (9003, None, 1.0), (9003, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [(bool(y), bool(got[k]["predicted"])) for k, y in marks if got[k]["held_out"]]
    assert sum(y and p for y, p in held) >= 0.9 * sum(y for y, _ in held)
    assert sum(p and not y for y, p in held) <= 0.02 * len(held)
    assert got[9002]["predicted"] == 1 and got[9001]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 9003").count() == 2
    nothing = toxicity.score_toxicity(docs.limit(0), labels.limit(0))
    assert nothing.count() == 0


FORMATS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(6)
    texts = [None, "", "é a.b@c.d_e@f.g.h! 1.2.3.4.5.6.7.8 001.2.3.256 0255.0.0.1", "4111 1111-1111 1111 +1 (555) 010-9999. +12 4", "1" * 30000, "a" * 30000 + "@b.c", "x@y", "+1 2 3 4 5 6 7 8 9 ) 4111111111111111", "9@9.9@9.9"]
    texts += ["".join(rng.choice("01 .+@-a(é") for _ in range(60)) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789") if rng.random() < 0.9 else rng.choice(" -.+") for _ in range(80)) for _ in range(200)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start int, email string")
    got = {r["doc_id"]: r for r in personal.personal_data(docs).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        spans, counts = [], []
        for kind, pattern in FORMATS:
            found = [m for m in re.finditer(pattern, t or "") if passes(kind, m.group(0))]
            counts.append(len(found))
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        r = got[k]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, t
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",") if r["spans"] else [])
    assert personal.personal_data(docs.limit(0)).count() == 0


def test_context_reveals_identifiers(spark):
    rng = random.Random(8)
    rows = [(k, f"Please call me at +1 555 {rng.randint(1000000, 9999999)} today") for k in range(40)]
    rows += [(100 + k, f"Please call me at 0{rng.randint(100000000, 999999999)} today") for k in range(5)]
    rows += [(200 + k, f"the year of {rng.randint(1000, 9999)} was good") for k in range(20)]
    got = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k]["spans"] == "phone:18:28" and got[100 + k]["n_found"] == 1 and got[100 + k]["n_phone"] == 0 for k in range(5))
    assert all(got[200 + k]["spans"] == "" for k in range(20))


def test_licences(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice(LETTERS) for _ in range(5)) for _ in range(n))
    rows = [(k, "\n".join(filler(20) for _ in range(4)), 1) for k in range(150)]
    rows[3] = (3, f"{filler(9)}\nReleased under the MIT License.\n{filler(9)}", 1)
    rows[4] = (4, f"{filler(300)} Licensed under the Apache License, Version 2.0. {filler(300)}", 1)
    rows[5] = (5, f"{filler(9)}\r\nThis work is licensed under the GNU General Public License, version 3.", 1)
    rows[6] = (6, "A license to drive is not a public notice, says the general version.", 1)
    rows += [(None, None, 1), (7, "", 1), (7, "\n\n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = {(r["doc_id"], r["family"]) for r in licenses.scan_licences(docs, copies=30).collect()}
    assert got == {(3, "mit"), (4, "apache-2.0"), (5, "gpl")}


def test_related_licences(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation."
    names = ["General Public License", "Lesser General Public License", "Affero General Public License"]
    filler = lambda k: f"Notes of day {k} on rivers, bridges and the {k * 7 % 13} markets of the old town."
    rows = [(k, filler(k)) for k in range(60)] + [(100 + k, f"{filler(k)}\n{notice.format(name)}\n{filler(k + 1)}") for k, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["family"]) for r in licenses.scan_licences(docs, copies=30).collect()}
    assert got == {(100, "gpl"), (101, "lgpl"), (102, "agpl")}


def test_licences_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(None, None, "x", 1), ("a", "", "y", 2), ("a", notice, "z", 3), ("a", notice, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, family string, paragraph int")
    got = [(r["doc_id"], r["paragraph"], r["family"], r["text"]) for r in licenses.scan_licences(docs, copies=10).collect()]
    assert got == [("a", 0, "mit", notice)] * 2
    assert licenses.scan_licences(docs.limit(0), copies=10).count() == 0


def test_pages(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site, news.</header>"
        "<nav class=menu><ul><li><a>One</a><li><a>Two</a></ul></nav><div class='cookie-notice'>We use cookies, sorry.</div>"
        "<article><header><h1>Caf&eacute; &amp;  more</h1></header><p>First <b>bold</b>,\n text.<br>Next.<p>Second one; unclosed &lt;tag&gt;."
        "<aside>Read also, this.</aside><ul><li>item a<li>item b</ul><form>Mail: <input> send</form><script>var x='</p>';</script>"
        "<div id=comments><p>Nice, I liked it.</p></div></article><div class=sidebar>Buy, now.</div><footer>&copy; 2020, us.</footer>"
    )
    want = "Café & more\n\nFirst bold, text. Next.\n\nSecond one; unclosed <tag>.\n\nitem a\n\nitem b"
    assert pages.main_text(page) == want
    plain = "<body><ul><li><a href=1>Home page</a><li><a href=2>All news</a></ul><div><p>" + "Long text, of words. " * 20 + "</p><p>Short one.</p></div></body>"
    assert pages.main_text(plain) == ("Long text, of words. " * 20).strip() + "\n\nShort one."
    rows = [(1, "u", page, 5), (2, None, None, 5), (2, None, "", 5), (None, "v", "<p>" + "x, y. " * 60000, 5), (4, "w", "<div><", 5)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, tag int"))
    assert got.columns == ["page_id", "url", "tag", "text", "n_chars"]
    found = got.collect()
    assert [len(r["text"]) for r in found] == [r["n_chars"] for r in found] and found[0]["text"] == want
    assert [r["n_chars"] for r in found[1:4]] == [0, 0, 359999]
    assert pages.extract_pages(got.select("page_id", F.col("text").alias("html")).limit(0)).count() == 0


def vectors(seed, n=600, size=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size))
    for k in range(0, n - 3, 6):
        for j in (1, 2):
            noise = rng.standard_normal(size)
            x[k + j] = x[k] + noise * np.linalg.norm(x[k]) / np.linalg.norm(noise) * rng.choice([0.2, 0.42, 0.5])
    x[50:80] = x[49]
    return x.astype(np.float32)


@pytest.mark.parametrize("settings", [{}, {"sample_rows": 40, "leaf": 8, "most_leaf": 60}])
def test_similar_vectors(spark, settings):
    x = vectors(3)
    bad = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None, *[1.0] * 23]), (1004, [float("inf")] * 24), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0, 2.0])]
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + [(*b, 1) for b in bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, hash int")
    got = {r["vec_id"]: r for r in neighbours.similar_vectors(frame, **settings).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    assert sum(got[k]["n_links"] for k in range(len(x))) >= 0.97 * near.sum()
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in range(len(x)))
    assert got[60]["component_id"] <= 49 and got[60]["n_links"] >= 30
    assert all(got[b[0]]["n_links"] == 0 for b in bad[:6]) and got[1007]["component_id"] == 1006
    links = defaultdict(int)
    for k in range(len(x)):
        links[got[k]["component_id"]] += 1
    assert neighbours.similar_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{}, {"sample_rows": 200, "most_leaf": 200}])
def test_similar_vectors_in_dense_groups(spark, settings):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 32))
    groups = [(0, 1000, 0.95), (1000, 1300, 0.95), (1300, 1600, 0.99)]
    for start, end, cosine in groups:
        noise = rng.standard_normal((end - start, 32)) * np.sqrt((1 - cosine) / cosine / 32)
        x[start:end] = x[start] / np.linalg.norm(x[start]) + noise
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neighbours.similar_vectors(frame, **settings).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    for start, end, _ in groups:
        assert sum(got[k]["n_links"] for k in range(start, end)) >= 0.9 * near[start:end].sum() > 0
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))


def test_similar_vectors_of_equal_direction(spark):
    rows = [(k, [float(k + 1), 0.0]) for k in range(300)] + [(300 + k, [0.0, 3.0 * (k + 1), 0.0, 1.0 * (k + 1)]) for k in range(300)]
    frame = spark.createDataFrame([*rows, (900, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in neighbours.similar_vectors(frame, sample_rows=40, leaf=8, most_leaf=60, rounds=3).collect()}
    assert all(got[k]["n_links"] == 299 and got[k]["component_id"] == k // 300 * 300 for k in range(600))
    assert got[900]["n_links"] == 0 and got[900]["kept"]


def test_leaf_that_does_not_split_is_final(spark):
    vector = np.array([1.0, 0.0]).tobytes()
    placed = spark.createDataFrame([(2, 0, 1, k) for k in range(100)], "size int, tree int, leaf long, row long")
    by_row = spark.createDataFrame([(k, vector) for k in range(100)], "row long, vector binary")
    split = neighbours._split_further(placed, by_row, "<f8", 60, 0.15, 7, 4, 0.9, 2.0)
    assert split.count() == 100 and split.where("tree = -2").count() == 100


def test_nodes_that_fit_a_task_are_split_there(spark, monkeypatch):
    placed, split_further = [], neighbours._split_further
    monkeypatch.setattr(neighbours, "_split_further", lambda rows, *rest: placed.append(rows) or split_further(rows, *rest))
    x = np.random.default_rng(12).standard_normal((3000, 16))
    x[1500:1700] = x[:200] * 3 + 0.1
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neighbours.similar_vectors(frame, sample_rows=200, most_leaf=200).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)).sum(axis=1)
    assert sum(got.values()) >= 0.97 * near.sum() > 0 and all(got[k] <= near[k] for k in got)
    # one row per tree and vector, however many leaves of 200 a tree has
    assert placed[0].count() == 12 * 3000


def test_vectors_are_not_shuffled_to_give_rows_their_links(spark):
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(vectors(5, 100))], "vec_id long, embedding array<float>")
    plan = neighbours.similar_vectors(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "vector#" not in plan


def test_leaf_in_blocks_gives_each_pair_once():
    x = np.random.default_rng(4).standard_normal((70, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [i * 70 + j for i in range(0, 70, 2) for j in range(i + 2, 70, 2) if x[i] @ x[j] >= 0.8]
    for most in (10, 35, 100):
        found = np.concatenate(list(neighbours._near_within(x, np.arange(0, 70, 2), most, 0.8)))
        assert sorted(found.tolist()) == want and len(want) > 20


@pytest.mark.parametrize("rounds", [0, 1, 40])
def test_nodes_too_large_for_a_task_are_split_by_the_cluster_or_compared_in_blocks(spark, monkeypatch, rounds):
    monkeypatch.setattr(neighbours, "TASK_LEAVES", 1)
    x = vectors(3)
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.similar_vectors(frame, sample_rows=40, leaf=8, most_leaf=60, rounds=rounds).collect()
    got = {r["vec_id"]: r["n_links"] for r in found}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = ((y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)).sum(axis=1)
    assert len(got) == len(found) == len(x) and sum(got.values()) >= 0.97 * near.sum() and all(got[k] <= near[k] for k in got)


def test_limit_holds_in_double_precision():
    above = np.concatenate([[1.0], 0.9 + np.arange(-20, 20) * 1e-9 + 5e-10])
    x = np.stack([above, np.sqrt(1 - above**2), np.zeros(41)], axis=1)
    x[1::2, 1] *= -1
    own, other = np.arange(1), np.arange(1, 41)
    want = [j for j in range(1, 41) if above[j] >= 0.9]
    assert neighbours._near(x, own, other, 0.9).tolist() == want and len(want) == 20
    every = np.arange(41)
    both = neighbours._near(x, every, every, 0.9)
    assert both[both < 41].tolist() == want


MIT_TEXT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above notice."""
GPL_TEXT = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_wrapped_licences(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join("".join(rng.choice(LETTERS) for _ in range(5)) for _ in range(n))
    rows = [(k, "\n".join(filler(12) for _ in range(8))) for k in range(150)]
    rows += [(200, MIT_TEXT), (201, BSD_TEXT), (202, GPL_TEXT), (203, f"{filler(70)}\n{filler(9)}\n{MIT_TEXT}\n\n{filler(12)}")]
    rows += [(204, f"{filler(9)}\nReleased under the MIT License.\n{filler(9)}")]
    got = licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), copies=30).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(200, "mit"), (201, "bsd"), (202, "gpl"), (203, "mit"), (204, "mit")}
    assert [(r["paragraph"], r["window"]) for r in got if r["doc_id"] == 204] == [(1, 0)]
    assert len({(r["doc_id"], r["paragraph"], r["window"]) for r in got}) == len(got)


PROSE = "Long text, of words; more of it. " * 12


def test_ratios_decide_inside_articles():
    links = "<div><ul>" + "".join(f"<li><a href={k}>Another story number {k}</a></li>" for k in range(3)) + "</ul></div>"
    article = f"<article><h1><a href=x>Title</a></h1><p>{PROSE}</p>{links}<p>{PROSE}</p></article>"
    want = f"Title\n\n{PROSE.strip()}\n\n{PROSE.strip()}"
    assert pages.main_text(f"<body>{article}<p>Outside, it is.</p></body>") == want
    without = f"<body><div><h1>Title</h1><p>{PROSE}</p>{links}<p>{PROSE}</p></div></body>"
    assert pages.main_text(without) == want


@pytest.mark.parametrize("wrapper", ["div class='site has-sidebar'", "form id=aspnetForm", "div class=search-widget"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_do_not_lose_the_article(wrapper, inner):
    page = f"<body><{wrapper}><div class=sidebar>Buy, now.</div><{inner}><div class=post-header><h1>Title</h1></div><p>{PROSE}</p><div class=ad>Buy, now.</div></{inner}></{wrapper.split()[0]}></body>"
    assert pages.main_text(page) == f"Title\n\n{PROSE.strip()}"


def test_related_articles_are_furniture():
    page = f"<body><article><p>{PROSE}</p></article><div class=related><article><p>A teaser, short.</p></article></div></body>"
    assert pages.main_text(page) == PROSE.strip()


def test_context_reveals_grouped_identifiers(spark):
    rng = random.Random(13)

    def card(good):
        body = f"4{rng.randint(10**13, 10**14 - 1):014d}"
        last = next(d for d in range(10) if passes("card", f"{body}{d}") == good)
        return " ".join(f"{body}{last}"[k : k + 4] for k in range(0, 16, 4))

    rows = [(k, f"Please call me at +1 555 {rng.randint(1000000, 9999999)} today") for k in range(40)]
    rows += [(50 + k, f"my card number {card(True)} expires") for k in range(40)]
    rows += [(100 + k, f"Please call me at (555) 010-{rng.randint(1000, 9999)} today") for k in range(5)]
    rows += [(200 + k, f"my card number {card(False)} expires") for k in range(5)]
    rows += [(300, "Please call me at 555.010.9999, today"), (301, "of 1999 2000 and of 12 3 was good"), (302, "Please call me at " + "1 " * 20000)]
    got = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + k]["spans"] for k in range(5)] == ["phone:18:32"] * 5
    assert [got[200 + k]["spans"] for k in range(5)] == ["card:15:34"] * 5
    assert got[300]["spans"] == "phone:18:30" and got[301]["spans"] == "" and got[302]["n_found"] == 0
