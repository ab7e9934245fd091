"""MinHash near-duplicates by an LSH forest, confirmed on the full shingle sets.

Documents with the same set are one class from the start. Every class gets a signature of 128 minima, cut
into 16 orders (trees) of 8. Sorted by an order, the classes that share the longest prefix stand next to
each other, so the candidates of a class are the next few in each order, as long as at least ``SHALLOW``
minima agree: in a sparse region those are all that share a short prefix, in a crowded one only those that
share a long one. The sort is a range partitioning with sampled bounds; what stands on the two sides of a
bound is compared as well. A group of thousands of near copies costs a few candidates per class and order.

What those few leave out is found exactly. A block is the classes that share ``SHALLOW`` minima of an order;
one with more classes than a window reaches, which are not all of one component by then, is first compared
with the class in it that has most links (the original of many copies). The classes of the blocks that this
leaves with several components are joined on their rarest shingles (a prefix filter), and every pair of different
components that meets is compared on its full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stopwise.llm.common import binary, fixed, pieces, release, row_key, staged, texts, utf8
from stopwise.llm.components import components
from stopwise.llm.hashing import NOT_SPACE, lowered, mix, words

SHINGLE, PERCENT = 5, 80
TREES, DEPTH, SHALLOW, NEIGHBOURS = 16, 8, 3, 8
BINS = TREES * DEPTH
KEY = 16
EXPLODED = 1 << 16  # shingles of a set in one batch

_RANDOM = np.random.default_rng(20240229)
# Where an empty bin looks for a minimum: itself, then the other bins in an order of its own.
_LOOK = np.array([[b, *_RANDOM.permutation(np.delete(np.arange(BINS), b))] for b in range(BINS)])
_FACTORS = _RANDOM.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BOUNDS = np.arange(BINS + 1, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For every row the sorted hashes of its distinct shingles of ``width`` words.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    found = words(lowered(data), offsets, NOT_SPACE)
    count = np.bincount(found.doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    many = max(len(found.hash) - width + 1, 0)
    rolling = np.zeros(many, np.uint64)
    for k in range(width):
        rolling += found.hash[k : k + many] * _FACTORS[k % 64]
    rolling = mix(rolling)
    for n, at in zip(count.tolist(), first.tolist()):
        if n >= width:
            yield np.unique(rolling[at : at + n - width + 1])
        elif n:
            short = found.hash[at : at + n]
            yield mix(np.array([(short * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=KEY).digest()


def signature(shingles: np.ndarray) -> bytes:
    """One minimum per bin of the hash range; an empty bin borrows in the order that is its own."""
    first = np.searchsorted(shingles, _BOUNDS[:-1])
    last = np.append(first[1:], len(shingles))
    filled = last > first
    source = _LOOK[np.arange(BINS), filled[_LOOK].argmax(axis=1)]
    minima = shingles[first[source]]
    return (minima & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()


def shingled(docs: DataFrame, width: int, with_set: bool) -> DataFrame:
    """``doc_id, mark, n, key`` and the signature, or the set itself; ``mark`` is the row's own key."""
    what = "shingles" if with_set else "signature"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                sets = list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1], width))
                made = [(s.tobytes() if with_set else signature(s)) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array(made, pa.binary()),
                    ],
                    ["doc_id", "mark", "n", "key", what],
                )

    rows = texts(docs).withColumn("mark", row_key())
    return rows.mapInArrow(scan, f"doc_id long, mark string, n long, key binary, {what} binary")


_PLACE = np.random.default_rng(7).permutation(BINS).reshape(TREES, DEPTH)  # the minima of every order
_PAIR = "a binary, b binary, bound int, tree int, label binary, n long"


def _neighbours(tree, label, key, n, reach: int, percent: int):
    """Pairs of rows at most ``reach`` apart that share ``SHALLOW`` minima and may be similar by size."""
    a, b = [], []
    for d in range(1, min(reach, len(tree) - 1) + 1):
        same = (label[:-d, :SHALLOW] == label[d:, :SHALLOW]).all(axis=1) & (tree[:-d] == tree[d:])
        small, large = np.minimum(n[:-d], n[d:]), np.maximum(n[:-d], n[d:])
        at = np.flatnonzero(same & (100 * small >= percent * large))
        a.append(at)
        b.append(at + d)
    if not a:
        return key[:0], key[:0]
    a, b = key[np.concatenate(a)], key[np.concatenate(b)]
    swap = np.array([x.tobytes() > y.tobytes() for x, y in zip(a, b)], bool)
    a[swap], b[swap] = b[swap], a[swap].copy()
    return a, b


def _ordered(classes: DataFrame, trees: list[int], depth: int) -> DataFrame:
    """``tree, label, key, n``: the first ``depth`` minima of every class in the given orders."""
    label = lambda t: F.concat(*[F.substring("signature", 4 * int(c) + 1, 4) for c in _PLACE[t][:depth]])
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), label(t).alias("label")) for t in trees]))
    return classes.select(entries.alias("e"), "key", "n").select("e.tree", "e.label", "key", "n")


def candidates(classes: DataFrame, trees: list[int], reach: int, percent: int) -> DataFrame:
    """``a``, ``b``: keys of neighbours in the given orders, each pair once."""
    rows = _ordered(classes, trees, DEPTH)
    order = ["tree", "label", "key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, head, tail = TaskContext.get().partitionId(), 0, None

        def edges(tree, labels, keys, n, bound):
            none = pa.nulls(len(tree), pa.binary())
            return pa.RecordBatch.from_arrays(
                [none, binary(keys), pa.array(np.full(len(tree), bound, np.int32)), pa.array(tree), binary(labels), pa.array(n)],
                ["a", "b", "bound", "tree", "label", "n"],
            )

        for batch in batches:
            part = [
                batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32),
                fixed(batch.column(1), 4 * DEPTH),
                fixed(batch.column(2), KEY),
                batch.column(3).to_numpy(zero_copy_only=False),
            ]
            if head < reach:  # the first rows of the partition meet the last of the one before
                yield edges(*[x[: reach - head] for x in part], here - 1)
                head += len(part[0])
            whole = part if tail is None else [np.concatenate([x, y]) for x, y in zip(tail, part)]
            minima = np.ascontiguousarray(whole[1]).view(">u4")
            a, b = _neighbours(whole[0], minima, whole[2], whole[3], reach, percent)
            yield pa.RecordBatch.from_arrays(
                [binary(a), binary(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())],
                ["a", "b", "bound", "tree", "label", "n"],
            )
            tail = [x[-reach:] for x in whole]
        if tail is not None:
            yield edges(*tail, here)

    def across(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(bytes=[bytes(x) for x in group["label"]], key=[bytes(x) for x in group["b"]])
        group = group.sort_values(["tree", "bytes", "key"])
        stack = lambda c, w: np.frombuffer(b"".join(group[c]), np.uint8).reshape(-1, w)
        a, b = _neighbours(
            group["tree"].to_numpy(), np.ascontiguousarray(stack("bytes", 4 * DEPTH)).view(">u4"), stack("key", KEY),
            group["n"].to_numpy(), reach, percent,
        )
        return pd.DataFrame({"a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]})

    found = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, _PAIR), "neighbours")
    stitched = found.filter("bound IS NOT NULL").groupBy("bound").applyInPandas(across, "a binary, b binary")
    pairs = staged(found.filter("bound IS NULL").select("a", "b").union(stitched).distinct(), "pairs")
    release(found)
    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(scan, "a binary, b binary")


def mixed_blocks(classes: DataFrame, roots: DataFrame, degrees: DataFrame, reach: int) -> DataFrame:
    """Blocks of more classes than a window reaches that are not all of one component.

    ``tree, label``; ``hub`` and ``hub_root``, the class with most links and its component.
    """
    rows = _rooted(_ordered(classes, list(range(TREES)), SHALLOW), roots)
    rows = rows.join(degrees, "key", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    each = rows.groupBy("tree", "label", "root").agg(F.count("*").alias("rows"), F.max(F.struct("links", "key")).alias("hub"))
    whole = each.groupBy("tree", "label").agg(
        F.count("*").alias("roots"), F.sum("rows").alias("rows"), F.max(F.struct("hub.links", "hub.key", "root")).alias("hub")
    )
    whole = whole.filter((F.col("roots") > 1) & (F.col("rows") > reach + 1))
    return whole.select("tree", "label", F.col("hub.key").alias("hub"), F.col("hub.root").alias("hub_root"))


def _exploded(sets: DataFrame) -> DataFrame:
    """``key, n, shingle``: a row for every shingle of every set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                shingles = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                for low in range(0, len(shingles), EXPLODED):
                    part = shingles[low : low + EXPLODED]
                    key = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), batch.column(0).slice(k, 1))
                    yield pa.RecordBatch.from_arrays(
                        [key.dictionary_decode(), pa.array(np.full(len(part), len(shingles))), pa.array(part)], ["key", "n", "shingle"]
                    )

    return sets.select("key", "shingles").mapInArrow(scan, "key binary, n long, shingle long")


def prefix_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: pairs of sets of different components that can reach the similarity, each once.

    ``classes`` has ``key, root, shingles``. A set of ``n`` shingles shares one of its ``n - ceil(t n) + 1``
    rarest with every set that is as similar as ``t``, whatever the order of equally rare ones, as long as it is
    the same for all. What only one set has leads nowhere and is not joined, so a set takes part with the few
    rare shingles that others have too; what a whole region has in common stands last and is hardly ever met.
    Where two sets meet first, all they share lies from there on, and must be enough (a positional filter):
    copies with edits of their own fall out here before they become pairs.
    """
    rows = staged(_exploded(classes), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    met = rows.join(often, "shingle").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("met"))
    least = F.floor((F.col("n") * percent + 99) / 100)
    length = F.col("n") - least + 1 - (F.col("n") - F.size("met"))  # of the prefix, without what only this set has
    prefix = F.posexplode(F.slice("met", 1, F.greatest(length, F.lit(0)).cast("int"))).alias("at", "m")
    rest = F.size("met") - F.col("at")  # of the set, from this shingle on
    short = met.select("key", "n", "met", prefix).select("key", "n", "m.shingle", rest.alias("rest"))
    short = short.join(classes.select("key", "root"), "key")
    short = staged(short, "prefixes")
    other = short.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("rest").alias("restb"), "shingle")
    both = short.withColumnsRenamed({"key": "a", "root": "ra"}).join(other, "shingle")
    size = (100 * F.col("n") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("n"))
    enough = F.least("rest", "restb") * (100 + percent) >= percent * (F.col("n") + F.col("nb"))
    new = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
    pairs = staged(both.filter(new & size & enough).select("a", "b").distinct(), "pairs")
    release(rows, short)
    return pairs


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("node").alias("key"), "root")
    return rows.join(to, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links."""
    links = _renamed(_renamed(links, "a", roots), "b", roots)
    joined = components(staged(links, "links"))
    return staged(_renamed(roots, "root", joined).union(joined.join(roots, "node", "left_anti")), "roots")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, kept`` for every row of ``docs``; ``mark`` is :func:`row_key`.

    Words are what stands between white space, A-Z lowered. ``component_id`` is the smallest ``doc_id``
    reachable over links of at least ``percent`` Jaccard similarity, ``kept`` is that row. Null and empty
    texts have an empty set and no link. Rows that repeat are linked like any two equal sets; a repeated
    ``doc_id`` that is the smallest is kept with all its rows. Without a ``doc_id`` a row is kept only if
    no row of its component has one.
    """
    marked = staged(shingled(docs, width, False), "signatures")
    classes = marked.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("mark").alias("source"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    classes = staged(classes, "classes")
    # First one neighbour in a few orders: it joins most of every group, so that of the many candidates of
    # the second pass only those between different components are left to confirm.
    near = candidates(classes, [0, 1], 1, percent)
    wide = candidates(classes, list(range(TREES)), NEIGHBOURS, percent)
    named = wide.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    members = classes.join(named, "key", "left_semi").select(F.col("source").alias("mark"), F.col("key").alias("wanted"))
    sets = _sets(docs, members, width)
    first = staged(confirmed(near, sets, percent), "links")
    roots = components(first)
    rest = _renamed(_renamed(wide.withColumns({"ra": F.col("a"), "rb": F.col("b")}), "ra", roots), "rb", roots)
    rest = staged(rest.filter("ra <> rb").select("a", "b"), "rest")
    more = staged(confirmed(rest, sets, percent), "links")
    ends = _merged(roots, more)
    links = first.union(more)
    ends_of = [links.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("links")) for c in ("a", "b")]
    degrees = ends_of[0].union(ends_of[1]).groupBy("key").agg(F.sum("links").alias("links"))
    ends = _completed(docs, classes, ends, staged(degrees, "degrees"), sets, width, percent)
    placed = classes.select("key", "least").join(ends.withColumnRenamed("node", "key"), "key", "left")
    placed = staged(placed.withColumn("root", F.coalesce("root", "key")), "placed")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = staged(placed.join(lowest, "root").select("key", "component_id"), "owners")
    release(near, wide, sets, rest, placed, classes)
    out = marked.select("doc_id", "mark", F.col("n").alias("n_shingles"), "key").join(owner, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select(
        "doc_id", "mark", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``key, shingles`` of the classes ``wanted``, each read from one of its rows."""
    sources = texts(docs).withColumn("mark", row_key()).join(staged(members, "members"), "mark").select("doc_id", "text", "wanted")
    sets = shingled(sources, width, True).dropDuplicates(["key"])
    return staged(sets.select("key", "shingles"), "sets")


def _completed(
    docs: DataFrame, classes: DataFrame, roots: DataFrame, degrees: DataFrame, sets: DataFrame, width: int, percent: int
) -> DataFrame:
    """``roots`` with every link inside the blocks that no window covers."""
    blocks = staged(mixed_blocks(classes, roots, degrees, NEIGHBOURS), "blocks")
    if blocks.isEmpty():
        return roots
    rows = _ordered(classes, list(range(TREES)), SHALLOW).join(blocks.select("tree", "label"), ["tree", "label"])
    lacking = staged(rows.select("key").distinct().join(sets, "key", "left_anti"), "lacking")
    members = classes.join(lacking, "key", "left_semi").select(F.col("source").alias("mark"), F.col("key").alias("wanted"))
    if not lacking.isEmpty():
        more = _sets(docs, members, width)
        sets = staged(sets.union(more.join(lacking, "key", "left_semi")), "sets")
        release(more)
    star = _rooted(_ordered(classes, list(range(TREES)), SHALLOW).join(blocks, ["tree", "label"]), roots)
    star = star.filter("root <> hub_root").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    star = staged(star, "star")
    roots = _merged(roots, confirmed(star, sets, percent))
    release(star, blocks)
    blocks = staged(mixed_blocks(classes, roots, degrees, NEIGHBOURS), "blocks")
    if blocks.isEmpty():
        return roots
    inside = _ordered(classes, list(range(TREES)), SHALLOW).join(blocks.select("tree", "label"), ["tree", "label"])
    inside = _rooted(inside.select("key").distinct(), roots).join(sets, "key")
    pairs = prefix_pairs(staged(inside, "crowded"), percent)
    return _merged(roots, confirmed(pairs, sets, percent))


def _renamed(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(to, rows[column] == to["_node"], "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")
