"""Benchmark decontamination: every shard of documents gets a suffix array over its words, every benchmark
suffix is looked up in it by binary search.

A shard is a piece of an Arrow batch. Documents never meet each other, so there is no shuffle: the
benchmark goes to the documents, in blocks of a bounded number of bytes, one pass over the documents per
block. A suffix that starts at a word no benchmark item has, or that meets such a word before a shortest
window ends, cannot match and is not sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stopwise.llm.common import pieces, staged, texts, utf8
from stopwise.llm.hashing import ALPHANUMERIC, lowered, words

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text sent to the executors at once

MATCH = "struct<item_id:string,item_word:int,doc_word:int,n_words:int>"
SCHEMA = f"doc_id long, n_words long, hits array<struct<first:int,last:int>>, items array<string>, matches array<{MATCH}>"


class Benchmark:
    """Windows of the items as numbers of vocabulary words, sorted by nothing: they are the queries."""

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        self.window, self.items = window, [r[0] for r in rows]
        data, offsets = utf8(pa.array([r[1] for r in rows], pa.string()))
        found = words(lowered(data), offsets, ALPHANUMERIC)
        self.vocabulary = np.unique(found.hash)
        numbers = np.searchsorted(self.vocabulary, found.hash) + 1
        n_words = np.bincount(found.doc, minlength=len(rows))
        self.width = np.minimum(n_words, window)
        first = np.cumsum(n_words) - n_words
        starts, of = [], []
        for k in np.flatnonzero(n_words):
            starts.append(first[k] + np.arange(n_words[k] - self.width[k] + 1))
            of.append(np.full(len(starts[-1]), k))
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.of = np.concatenate(of) if of else np.empty(0, np.int64)
        self.item_word = self.start - first[self.of] if len(self.start) else self.start
        self.length = self.width[self.of]
        self.shortest = int(self.width[self.width > 0].min()) if len(self.start) else 0
        self.low = wide(numbers, self.start, self.length, window, 0)
        self.high = wide(numbers, self.start, self.length, window, _TOP)


# Vocabulary numbers of 31 bits, two to a wide character.
_BITS, _EACH = 31, 2
_TOP = (1 << _BITS) - 1


def wide(numbers: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, pad: int) -> np.ndarray:
    """The first ``length`` words from each start, filled up with ``pad``, two words to a column."""
    at = np.arange(-(-window // _EACH) * _EACH)
    index = np.minimum(start[:, None] + at, max(len(numbers) - 1, 0))
    taken = np.where(at < length[:, None], numbers[index] if len(numbers) else 0, pad).astype(np.uint64)
    columns = taken.reshape(len(start), len(at) // _EACH, _EACH)
    shifts = np.array([_BITS, 0], np.uint64)
    return (columns << shifts).sum(axis=2, dtype=np.uint64)


def binary_search(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For every row of ``wanted`` the first row of the sorted ``keys`` not below it (``after``: above it)."""
    low = np.zeros(len(wanted), np.int64)
    high = np.full(len(wanted), len(keys), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        probe = keys[np.minimum(middle, len(keys) - 1)]
        differs = probe != wanted
        where = differs.argmax(axis=1)
        rows = np.arange(len(wanted))
        below = probe[rows, where] < wanted[rows, where]
        if after:
            below |= ~differs.any(axis=1)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def spread_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(k, position)`` for every position of every range ``first[k]:last[k]``."""
    count = last - first
    of = np.repeat(np.arange(len(first)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


def shard_matches(data: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, ...]:
    """Words per document, and ``(window, document, word in the document)`` of every occurrence."""
    found = words(lowered(data), offsets, ALPHANUMERIC)
    n_docs = len(offsets) - 1
    n_words = np.bincount(found.doc, minlength=n_docs)
    nothing = np.empty(0, np.int64)
    if not len(found.hash) or not bench.shortest:
        return n_words, nothing, nothing, nothing
    near = np.minimum(np.searchsorted(bench.vocabulary, found.hash), len(bench.vocabulary) - 1)
    numbers = np.where(bench.vocabulary[near] == found.hash, near + 1, 0)
    position = np.arange(len(numbers))
    # words up to the next one that no item has, or to the end of the document
    first_of = np.cumsum(n_words) - n_words
    stop = np.where(numbers == 0, position, len(numbers))
    run = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], (first_of + n_words)[found.doc]) - position
    suffix = np.flatnonzero(run >= bench.shortest)
    if not len(suffix):
        return n_words, nothing, nothing, nothing
    keys = wide(numbers, suffix, np.minimum(run[suffix], bench.window), bench.window, 0)
    order = np.lexsort(keys.T[::-1])
    suffix, keys = suffix[order], keys[order]
    window, at = spread_ranges(binary_search(keys, bench.low, False), binary_search(keys, bench.high, True))
    at = suffix[at]
    return n_words, window, found.doc[at], at - first_of[found.doc[at]]


def _lists(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.Array:
    """Lists per document out of values sorted by document."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that begin where ``breaks`` is set."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks))[: len(first)] - 1


def described(n_words, window, doc, word, bench: Benchmark) -> list[pa.Array]:
    n_docs = len(n_words)
    # maximal verbatim matches: windows of one item that follow each other in item and document alike
    order = np.lexsort((word, word - bench.item_word[window], bench.of[window], doc))
    w, d, p = window[order], doc[order], word[order]
    item, diagonal = bench.of[w], p - bench.item_word[w]
    new = np.ones(len(w), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)
    a, b = _runs(new)
    names = np.array(bench.items, object)
    matches = pa.StructArray.from_arrays(
        [
            pa.array(names[item[a]], pa.string()),
            pa.array(bench.item_word[w[a]].astype(np.int32)),
            pa.array(p[a].astype(np.int32)),
            pa.array((p[b] - p[a] + bench.length[w[b]]).astype(np.int32)),
        ],
        ["item_id", "item_word", "doc_word", "n_words"],
    )
    in_matches = _lists(d[a], n_docs, matches)
    seen = np.unique(np.stack([d, item]), axis=1) if len(d) else np.empty((2, 0), np.int64)
    in_items = _lists(seen[0], n_docs, pa.array(names[seen[1]], pa.string()))
    # hit words, as maximal ranges
    order = np.lexsort((word, doc))
    d, p, e = doc[order], word[order], (word + bench.length[window])[order]
    reach = np.maximum.accumulate(e + d * (1 << 40)) - d * (1 << 40) if len(d) else e
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > reach[:-1])
    a, b = _runs(new)
    spans = pa.StructArray.from_arrays(
        [pa.array(p[a].astype(np.int32)), pa.array(reach[b].astype(np.int32))], ["first", "last"]
    )
    return [pa.array(n_words.astype(np.int64)), _lists(d[a], n_docs, spans), in_items, in_matches]


def matched(docs: DataFrame, rows: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """Occurrences of one block of items in every document."""
    bench = docs.sparkSession.sparkContext.broadcast(Benchmark(rows, window))
    names = ["doc_id", "n_words", "hits", "items", "matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                part = shard_matches(data[offsets[i] : offsets[j]], offsets[i : j + 1], bench.value)
                columns = described(*part, bench.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names)

    return texts(docs).mapInArrow(scan, SCHEMA)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``limit`` bytes (one item at least), fetched one partition at a time.

    A longer item is a block of its own.
    """
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    block, size = [], 0
    for row in items.dropna(subset=["text"]).toLocalIterator():
        if block and size + len(row[1]) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Verbatim matches of benchmark items in documents.

    Per row of ``docs``: ``doc_id``, ``n_words``, ``hits`` (maximal ranges of hit words, end exclusive),
    ``items`` (ids of the items with an occurring window), ``matches`` (maximal verbatim matches with
    their places in item and document) and ``longest`` (words of the longest).

    A null or empty text has no words and matches nothing. Items without words or text match nothing.
    Items without an id hit like others; together they are one item, whose id is null. Repeated documents are
    judged one by one; repeated ``item_id`` values count once. A benchmark of more than one block is looked up
    block by block over numbered rows: the matches of a block are written before the block after next is fetched.
    """
    rest = blocks(benchmark, block_bytes)
    block, after = next(rest), next(rest, None)
    if after is None:
        whole = matched(docs, block, window)
    else:
        numbered = staged(texts(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
        keyed = numbered.select(F.col("row").alias("doc_id"), "text")
        found = []
        while block is not None:
            found.append(staged(matched(keyed, block, window), "matches"))
            block, after = after, next(rest, None)
        whole = _united(found)
        whole = whole.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row")
        whole = whole.select("doc_id", "n_words", "hits", "items", "matches")
    return whole.withColumn("longest", F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0)))


def _united(parts: list[DataFrame]) -> DataFrame:
    """Blocks of items put together: lists are joined, ranges that touch are united."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    ranges = F.array_sort(F.flatten(F.collect_list("hits")))
    joined = F.aggregate(
        ranges,
        F.expr("CAST(array() AS array<struct<first:int,last:int>>)"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= r["first"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["first"].alias("first"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["last"], r["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )
    return every.groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"),
        joined.alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, in which no window of any item occurs, also of items without an id.

    One pass over the documents; every block of the benchmark is held by the executors until it ends.
    """
    kept = docs
    at = docs.columns.index("text")
    for block in blocks(benchmark, block_bytes):
        kept = kept.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(Benchmark(block, window)), at), docs.schema)
    return kept


def _without(bench, at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            hit = np.zeros(batch.num_rows, bool)
            for i, j in pieces(offsets):
                hit[i + shard_matches(data[offsets[i] : offsets[j]], offsets[i : j + 1], bench.value)[2]] = True
            yield batch.filter(pa.array(~hit))

    return scan


def digest(found: DataFrame) -> DataFrame:
    """The columns the registered query returns, out of :func:`decontaminate`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("longest").cast("long").alias("longest"),
    )

