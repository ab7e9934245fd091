"""How the sources of a language differ in their words: an audit in exact integers.

Terms are runs of letters, A-Z lowered. A language keeps the terms that occur in at least ``LEAST_DOCS`` of its
documents. A share is ``p = 1 + floor(10**9 * (count + 1) / (N + V))`` of a term's count in a group (or in the
language, then called ``q``), ``N`` the counts of all kept terms there and ``V`` their number; the divergence
of two shares is ``floor((p - q)**2 / q)``.

The terms a source has more often than its language are ranked by a dominance skyband: a term cannot be among
the first ``k`` if ``k`` others have at least its group count, at most its language count and an earlier name,
because each of them diverges at least as much and comes first in a tie. Every partition keeps the terms that
fewer than ``k`` others dominate there, skybands are merged sixteen at a time, and what is left is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stopwise.llm.common import pieces, release, staged, utf8
from stopwise.llm.hashing import LETTERS, lowered, words

LEAST_DOCS, TOP = 3, 200
UNIT_STEPS, UNIT_BASE = 3, 1000  # 1000 ** 3 shares make a whole
PIECES = 16  # of text whose counts are added up before they leave a task
SLOT_TERMS = 20_000  # terms of a language in one partition of the first skybands
MERGED = 16  # skybands that are merged at a time
BUCKET_TERMS, BLOCK = 2000, 256  # terms and sources on a side of one cell of source pairs


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of every term in every group, and documents that have it."""

    def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple:
        """Group, term and numbers of every combination, the terms as entries of a dictionary."""
        low = lowered(data)
        found = words(low, offsets, LETTERS)
        names = _slices(low, found.start, found.end).dictionary_encode()
        term, many = names.indices.to_numpy().astype(np.int64), max(len(names.dictionary), 1)
        own = np.unique(found.doc * many + term, return_counts=True)
        key, at = np.unique(group[own[0] // many] * many + own[0] % many, return_inverse=True)
        n, docs = np.bincount(at, own[1]).astype(np.int64), np.bincount(at)
        return key // many, pa.DictionaryArray.from_arrays(pa.array(key % many, pa.int32()), names.dictionary), n, docs

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            spans = list(pieces(offsets))
            for first in range(0, len(spans), PIECES):
                made = [counted(data[offsets[i] : offsets[j]], offsets[i : j + 1], group[i:j]) for i, j in spans[first : first + PIECES]]
                groups, names, n, docs = zip(*made)
                names = pa.chunked_array(names).unify_dictionaries().combine_chunks()
                term, many = names.indices.to_numpy().astype(np.int64), max(len(names.dictionary), 1)
                key, at = np.unique(np.concatenate(groups) * many + term, return_inverse=True)
                sums = [np.bincount(at, np.concatenate(x), len(key)).astype(np.int64) for x in (n, docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(key // many // len(source.dictionary))),
                        source.dictionary.take(pa.array(key // many % len(source.dictionary))),
                        names.dictionary.take(pa.array(key % many)).cast(pa.string()),
                        *map(pa.array, sums),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    found = docs.mapInArrow(scan, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow column: every second entry between alternating bounds."""
    if not len(start):
        return pa.array([], pa.large_binary())
    bounds = np.empty(2 * len(start), np.int64)
    bounds[0::2], bounds[1::2] = start, end
    both = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return both.take(pa.array(np.arange(0, len(bounds) - 1, 2)))


def share(count: Column, whole: Column) -> Column:
    """``1 + floor(10**9 * (count + 1) / whole)`` by long division, exact while ``1000 * whole`` fits a long."""
    rest, digits = count + 1, F.lit(0).cast("long")
    for _ in range(UNIT_STEPS):
        scaled = rest * UNIT_BASE
        digits, rest = digits * UNIT_BASE + F.call_function("div", scaled, whole), scaled % whole
    return digits + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Skyband:
    """Terms in order of their names; keeps those that fewer than ``k`` of the kept ones dominate.

    A dropped term need not be remembered: whatever it dominates is dominated by those that dominate it.
    """

    def __init__(self, k: int) -> None:
        self.k, self.size = k, 0
        self.count, self.total = np.empty(256, np.int64), np.empty(256, np.int64)

    def keep(self, count: np.ndarray, total: np.ndarray, chunk: int = 256) -> np.ndarray:
        kept = np.zeros(len(count), bool)
        for low in range(0, len(count), chunk):
            c, t = count[low : low + chunk], total[low : low + chunk]
            first = self.size
            over = (self.count[:first, None] >= c) & (self.total[:first, None] <= t)
            above = over.sum(axis=0)
            for x in np.flatnonzero(above < self.k):
                new = slice(first, self.size)
                more = np.count_nonzero((self.count[new] >= c[x]) & (self.total[new] <= t[x]))
                if above[x] + more < self.k:
                    kept[low + x] = True
                    self._add(c[x], t[x])
        return kept

    def _add(self, count: int, total: int) -> None:
        if self.size == len(self.count):
            self.count, self.total = (np.concatenate([x, np.empty_like(x)]) for x in (self.count, self.total))
        self.count[self.size], self.total[self.size] = count, total
        self.size += 1


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of every ``lang, source, slot``. A task holds the kept counts of one at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, band = None, None
        for batch in batches:
            ids = [batch.column(c) for c in ("lang", "source", "slot")]
            fresh = np.zeros(max(len(batch) - 1, 0), bool)
            for c in ids:
                fresh |= pc.not_equal(c.slice(1), c.slice(0, max(len(batch) - 1, 0))).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(batch)] if len(batch) else []
            kept = np.zeros(len(batch), bool)
            n, total = batch.column("n").to_numpy(), batch.column("lang_n").to_numpy()
            for i, j in zip(starts, starts[1:]):
                group = tuple(c[i].as_py() for c in ids)
                if group != last:
                    last, band = group, Skyband(k)
                kept[i:j] = band.keep(n[i:j], total[i:j])
            yield batch.filter(pa.array(kept))

    order = ["lang", "source", "slot"]
    return rows.repartition(*order).sortWithinPartitions(*order, "item").mapInArrow(scan, rows.schema)


def _leading_terms(rows: DataFrame, slots: int, top: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the ``top`` terms of every group."""
    slot = F.pmod(F.xxhash64("item"), F.lit(slots)).cast("int")
    left = _skybands(rows.withColumn("slot", slot), top)
    while slots > 1:
        slots = -(-slots // MERGED)
        left = _skybands(left.withColumn("slot", F.floor(F.col("slot") / MERGED).cast("int")), top)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = left.withColumn("value", divergence(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def _cell(group: pd.DataFrame) -> pd.DataFrame:
    """Both directions of every pair between two blocks of sources, over the terms of one bucket."""
    first = group.iloc[0]
    i, j, v = int(first["i"]), int(first["j"]), int(first["v"])
    heads = group[group["item"].isna()].sort_values("source")
    names, block = heads["source"].to_numpy(), heads["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = group[group["item"].notna()]
    term, many = pd.factorize(found["item"])[0], found["item"].nunique()
    zero = heads["p"].fillna(1).to_numpy(np.int64)
    p = np.tile(zero, (many + 1, 1))  # the last row stands for a term that no source here has
    p[term, np.searchsorted(names, found["source"].to_numpy())] = found["p"].to_numpy(np.int64)
    more = v if int(first["bucket"]) == 0 else 0
    out = []
    for a, others in [(a, right) for a in left] + [(a, left) for a in right if i != j]:
        others = others[others != a]
        f = (p[:, a, None] - p[:, others]) ** 2 // p[:, others]
        value = f[:-1].sum(axis=0) + (more - many) * f[-1]
        out.append(pd.DataFrame({"source": names[a], "item": names[others], "part": value if v else 0}))
    return pd.concat(out).assign(lang=first["lang"])[["lang", "source", "item", "part"]]


def _pairs(rows: DataFrame, groups: DataFrame, block: int, bucket_terms: int) -> DataFrame:
    """``lang, source, item, value, rank``: every source of a language against every other.

    Sources come in blocks and terms in buckets; a cell holds two blocks and one bucket, so neither a language
    with many sources nor one with many terms meets in a task. A cell sums over the terms that occur in it;
    those that do not contribute one and the same amount each, added by their number.
    """
    blocks = F.ceil(F.count("*") / block).cast("int")
    wide = groups.join(groups.groupBy("lang").agg(blocks.alias("blocks")), "lang")
    wide = wide.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("int")
    wide = wide.withColumn("buckets", buckets)
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    empty = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("whole")))
    heads = wide.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    heads = heads.select("lang", "source", "block", "v", "bucket", F.lit(None).cast("string").alias("item"), empty.alias("p"), cells.alias("c"))
    filled = rows.select("lang", "source", "item", "p").join(wide.select("lang", "source", "block", "blocks", "buckets", "v"), ["lang", "source"])
    filled = filled.withColumn("bucket", F.pmod(F.xxhash64("item"), "buckets").cast("int"))
    filled = filled.select("lang", "source", "block", "v", "bucket", "item", "p", cells.alias("c"))
    both = heads.union(filled).select("lang", "source", "block", "v", "bucket", "item", "p", "c.i", "c.j")
    parts = both.groupBy("lang", "i", "j", "bucket").applyInPandas(_cell, "lang string, source string, item string, part long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def audit_divergence(
    docs: DataFrame,
    top: int = TOP,
    least_docs: int = LEAST_DOCS,
    slot_terms: int = SLOT_TERMS,
    block: int = BLOCK,
    bucket_terms: int = BUCKET_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` compares sources, part ``term`` lists terms.

    Null ``text``, ``lang`` and ``source`` read as empty text; other columns are not looked at. Every row is a
    document, repeated rows too. Ties go to the item whose UTF-8 is smaller. A group without terms still has
    its pairs, with 0 where the language keeps no term; an empty table gives no row.
    """
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = staged(term_counts(known), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = staged(kept.filter(F.col("docs") >= least_docs).drop("docs"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_whole"))
    rows = staged(counts.join(kept, ["lang", "term"]).withColumnRenamed("term", "item").drop("docs"), "counted")
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = known.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["own", "v", "lang_whole"])
    groups = staged(groups.withColumns({"whole": F.col("own") + F.col("v"), "lang_whole": F.col("lang_whole") + F.col("v")}), "groups")
    rows = rows.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("whole")), "q": share(F.col("lang_n"), F.col("lang_whole"))})
    rows = staged(rows.drop("whole", "lang_whole"), "shares")
    largest = groups.agg(F.max("v")).first()[0] or 0
    terms = _leading_terms(rows.filter("p > q"), max(1, -(-largest // slot_terms)), top)
    pairs = _pairs(rows, groups, block, bucket_terms)
    release(counts, kept)
    labelled = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return labelled(pairs, "pair").union(labelled(terms, "term"))
