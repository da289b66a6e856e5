"""The corpus queries over the given tables, with their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratescope.llm import exact, infill, kneser_ney, licenses, merkle, mixing, neighbours, packing, pages, personal, shards, shingles, toxicity
from ratescope.llm.common import table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"), 24)


@query
def op5_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of every document, with tampered ones; see ``merkle.merkle_manifest`` for odd rows."""
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


#: CRC-32 of a decimal id: per byte one exclusive or, then eight shifts; -1 stands for a shift.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels_sql(name: str, first: str) -> str:
    """All levels of the trees of ``first`` (of, nodes), as a recursive table (of, nodes, level)."""
    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    return f"""{name} AS (SELECT of, nodes, 0 AS level FROM {first}
  UNION ALL SELECT of, {up}, level + 1 FROM {name} WHERE len(nodes) > 1)"""


_SIBLING_SQL = """list(CASE WHEN (place >> level) & 1 = 1 THEN 'L' || nodes[place >> level]
  ELSE coalesce('R' || nodes[(place >> level) + 2], '') END ORDER BY level) FILTER (len(nodes) > 1)"""

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         {_leaf_sql("(n_chars::HUGEINT + (" + CRC32_SQL + " % 7 = 0)::INT)")} AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents),
lang_leaves AS (SELECT lang AS of, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang),
{_levels_sql("low", "lang_leaves")},
subroots AS (SELECT of AS lang, nodes[1] AS subroot, row_number() OVER (ORDER BY of NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
all_subroots AS (SELECT 0 AS of, list(subroot ORDER BY place) AS nodes FROM subroots HAVING count(*) > 0),
{_levels_sql("high", "all_subroots")},
root AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
over AS (SELECT s.lang, any_value(s.subroot) AS subroot, {_SIBLING_SQL} AS path FROM subroots s, high GROUP BY s.lang),
under AS (SELECT doc_id, any_value(lang) AS lang, any_value(leaf) AS leaf, any_value(tampered) AS tampered, {_SIBLING_SQL} AS path
  FROM leaves JOIN low ON low.of IS NOT DISTINCT FROM leaves.lang GROUP BY doc_id),
proofs AS (SELECT u.doc_id, u.leaf, u.tampered, o.subroot, list_concat(coalesce(u.path, []), coalesce(o.path, [])) AS path
  FROM under u JOIN over o ON o.lang IS NOT DISTINCT FROM u.lang),
folds AS (SELECT *, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(tampered, path), lambda node, e: CASE WHEN e[1] = 'L' THEN sha256(e[2:] || node) ELSE sha256(node || e[2:]) END) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds, root
"""


@query
def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document; see ``kneser_ney.learn_and_score`` for odd rows."""
    return kneser_ney.corpus_scores(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut for fill-in-the-middle and rebuilt; see ``infill.fill_in_middle`` for odd rows."""
    return infill.middle_digests(table(spark, sf_dir, "documents"))


SQL["op13_fill_in_middle"] = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
