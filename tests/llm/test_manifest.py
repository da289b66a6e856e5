"""Merkle manifest and fill-in-the-middle on odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from ratescope.llm import infill, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, digest string, nodes int, order_ string, form string, output string, number_ int"
REST = (5, "d", 1, "o", "f", "out", 0)
LONG = "é𝄞x " * 20000
TEXTS = [None, "", "a", "ab", "<P>", "a<S>b", "x<", "<S", "P>", "é𝄞", LONG, LONG, "<<<>>>", "tail <M", " \n"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, n_chars):
    return h(*[field(x) for x in (row[0], row[3], row[2], n_chars, row[1])])


def tree(nodes):
    """All levels, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other], other < place) if other < len(level) else None)
        place //= 2
    return out


def fold(node, path):
    for entry in path:
        node = h(node) if entry is None else h(entry[0], node) if entry[1] else h(node, entry[0])
    return node


def by_the_book(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = tree([leaf(r, r[4]) for r in groups[lang]])
    over = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, row in enumerate(groups[lang]):
            path = siblings(trees[lang], place) + siblings(over, k)
            hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            back = fold(leaf(row, row[4] + 1 if hit else row[4]), path)
            proof = h(*[e[0] for e in path if e])
            out.append((row[0], trees[lang][0][place], trees[lang][-1][0], over[-1][0], proof, back, back == over[-1][0]))
    return sorted(out, key=repr)


def rows_of(sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k * 37 % 1000 - 5, TEXTS[k % len(TEXTS)], lang, [None, "s", "é"][k % 3], None if k % 5 == 0 else k * 10**15, *REST))
            k += 1
    return rows


@pytest.mark.parametrize("stride", [1, 4])
@pytest.mark.parametrize("sizes", [{"en": 33, None: 1, "de": 2, "": 17, "zz": 16, "é": 5, "Z": 1}, {"en": 100}, {"en": 1}, {None: 3}])
def test_manifest(spark, sizes, stride):
    rows = rows_of(sizes)
    if len(sizes) > 1:  # repeated rows, equal ids with different texts, null ids
        rows += [rows[3], rows[3], (rows[3][0], "other", "en", "s", 9, *REST), (None, "x", "en", "s", 9, *REST), (None, None, None, None, None, *REST)]
    got = merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), stride=stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = by_the_book(rows)
    # equal ids stand by leaf, so equal rows may swap their proofs but not the set of them
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    assert not all(r[-1] for r in want) or len(rows) < 5


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_manifest(none).count() == 0


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) as the contract says it."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(k, TEXTS[k % len(TEXTS)], "en", "s", 1, *REST) for k in range(300)]
    rows += [(None, "no id", "en", "s", 1, *REST), rows[2], rows[2]]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = infill.fill_in_middle(frame)
    assert out.columns == [c for c in frame.columns if c not in ("form", "output")] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(r[0], r[1], *plain(r[0], r[1])) for r in rows], key=repr)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    back = infill.restore(out.drop("text").withColumnRenamed("output", "made"), output="made")
    want = {r[0]: r[1] or "" for r in rows}
    assert all(r["restored"] == want[r["doc_id"]] for r in back.select("doc_id", "restored").collect())
    digests = infill.middle_digests(frame).collect()
    assert all(r["restored_sha256"] == h(want[r["doc_id"]]) and r["output_sha256"] == h(plain(r["doc_id"], want[r["doc_id"]])[4]) for r in digests)


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(infill, "PIECE_BYTES", 3)
    rows = [(k, TEXTS[k % len(TEXTS)][:7] if TEXTS[k % len(TEXTS)] else None) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = infill.restore(infill.fill_in_middle(frame)).collect()
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) for r in out)
    assert all(r["restored"] == (r["text"] or "") for r in out)


def test_nothing_to_cut_and_broken_outputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.middle_digests(none).count() == 0
    broken = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="exactly once"):
        infill.restore(broken).collect()
