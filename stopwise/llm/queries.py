"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.llm.alignment import align_corpus
from stopwise.llm.common import table
from stopwise.llm.language import label_languages
from stopwise.llm.decontamination import decontaminate, digest
from stopwise.llm.divergence import audit_divergence
from stopwise.llm.fingerprints import compare_with_edited
from stopwise.llm.mixing import mix
from stopwise.llm.near_duplicates import near_duplicates
from stopwise.llm.neighbours import nearest
from stopwise.llm.secret_scan import digest as secrets_digest, scan_secrets
from stopwise.llm.extraction import extract_main_text
from stopwise.llm.licences import digest as licences_digest, scan_licences
from stopwise.llm.toxicity import held_out, learn, score_toxicity
from stopwise.llm.repeats import digest as repeats_digest, remove_repeats


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences_digest(scan_licences(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("longest")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item AS (SELECT item_id, w, least(len(w), 10) AS l FROM bw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM item)),
lens AS (SELECT DISTINCT l FROM item),
pos AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= l)),
occ AS (SELECT p.doc_id, p.i, p.l, win.item_id FROM pos p JOIN win ON p.l = win.l AND p.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS x FROM occ) GROUP BY 1),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS v FROM occ GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(v), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(v, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_languages(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).drop("mark")


OP9_SQL = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(len(w), 4) AS l, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda w: translate(w, '{_UPPER}', '{_LOWER}')) AS w
  FROM documents),
occ AS (SELECT lang, source, id, unnest(w) AS item FROM (SELECT *, row_number() OVER () AS id FROM d)),
kept AS (SELECT lang, item, count(*) AS n FROM occ GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, item, count(*) AS n FROM occ JOIN kept USING (lang, item) GROUP BY 1, 2, 3),
g AS (
  SELECT lang, source, coalesce(s.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) s USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
cross_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cross_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 200
"""


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_corpus(table(spark, sf_dir, "documents"), hashed=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_html": Query(op1_html),
    "op2_toxicity": Query(op2_toxicity),
    "op3_licences": Query(op3_licences),
    "op4_decontamination": Query(op4_decontamination, OP4_SQL),
    "op5_cross_polytope": Query(op5_cross_polytope),
    "op6_mixing": Query(op6_mixing),
    "op7_language": Query(op7_language),
    "op8_secrets": Query(op8_secrets),
    "op9_minhash": Query(op9_minhash, OP9_SQL),
    "op10_suffix_array": Query(op10_suffix_array),
    "op11_divergence": Query(op11_divergence, OP11_SQL),
    "op12_fingerprint": Query(op12_fingerprint),
    "op13_alignment": Query(op13_alignment),
}
