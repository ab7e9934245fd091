"""Removal of long repeated passages by a sparse suffix array over the bytes of all documents.

Every string of ``length`` bytes contains an anchor: the position of the smallest hash of 8 bytes among
those that have ``LEAD`` bytes after them inside the string. It depends on the string alone, so two equal
strings have it at the same place, and about one position in 150 is an anchor. Only suffixes at anchors are
sorted: sampled splitters partition them by their leading bytes, a bucket is sorted by multikey quicksort
with characters of 8 bytes, and a suffix that shares its lead with no neighbour, across bucket borders
too, is in no repeat. Ties are split between buckets by row and position, so a passage that a third of all
documents share fills many buckets.

What is left is decided exactly, by 128-bit hashes. The strings of an anchor are cut into blocks of
``BLOCK`` starts. If the hull of a block (all its bytes) occurs twice, all its strings do. If its core (the
bytes all its strings share) occurs once, none does. Only the rest, at the ends of repeats, is compared
string by string, together with one block of every repeated hull that has the same core. All counting is
``groupBy`` with partial sums; texts are moved once, into buckets by row, and later joins come to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stopwise.llm.common import binary, fixed, pieces, release, staged, texts, utf8
from stopwise.llm.hashing import byte_values, prefix_sums, range_hashes
from stopwise.session import scratch_dir

LENGTH, LEAD, BLOCK, GRAM = 400, 100, 32, 8
BUCKET_BYTES = 32 << 20
SMALL = 512 << 10  # bytes of text whose arrays stay in the processor's cache
_POSITION = np.uint64((1 << 32) - 1)
_SECOND = byte_values(2)


def bucketed(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Written once, hashed by ``column``, so that joins on it do not move the rows again."""
    spark = rows.sparkSession
    path = scratch_dir(spark, "bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = rows.repartition(n, column).write.bucketBy(n, column).option("path", path)
    writer.option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def anchors(data: np.ndarray, base: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``position, first, last`` (places in ``data``): the starts ``first..last`` have their anchor there."""
    nothing = np.empty(0, np.int64)
    width = length - lead + 1
    if len(data) < length:
        return nothing, nothing, nothing
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    low = range_hashes(sums, at, at + GRAM) & ~_POSITION | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:  # minimum over ``span`` positions, doubled
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    begin, size = base[:-1], np.diff(base)
    valid = np.zeros(len(data) + 1, np.int8)
    long = size >= length
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, (base[1:] - length + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(valid[:-1])[: len(low)])
    if not len(start):
        return nothing, nothing, nothing
    anchor = (low[start] & _POSITION).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return anchor[head], start[head], start[np.append(head[1:], len(start)) - 1]


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of characters; ``order`` and the number of the group of equal rows each place is in.

    Each round parts every group on its next character into smaller, equal and larger; only equal rows
    go on to the character after it.
    """
    n = len(keys)
    order, group, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for c in range(keys.shape[1]):
        char = keys[order[open_], c]
        by = np.lexsort((char, group[open_]))
        order[open_] = order[open_[by]]
        char = char[by]
        cut = np.zeros(n, bool)
        cut[0:1] = True
        cut[1:] = group[1:] != group[:-1]
        cut[open_[1:]] |= (char[1:] != char[:-1]) | (group[open_[1:]] != group[open_[:-1]])
        group = np.cumsum(cut)
        alone = np.bincount(group, minlength=group[-1] + 1)[group] == 1 if n else cut
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
    return order, group


_ANCHOR = "row long, position int, first int, last int"


def anchor_rows(numbered: DataFrame, length: int, lead: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, SMALL):
                part, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                position, first, last = anchors(part, base, length, lead)
                doc = np.searchsorted(base, position, "right") - 1
                leads = np.lib.stride_tricks.sliding_window_view(part, lead)[position] if len(position) else np.empty((0, lead), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[i + doc]), *(pa.array((x - base[doc]).astype(np.int32)) for x in (position, first, last)), binary(leads)],
                    ["row", "position", "first", "last", "lead"],
                )

    return numbered.select("row", "text").mapInArrow(scan, f"{_ANCHOR}, lead binary")


def shared_anchors(found: DataFrame, lead: int) -> DataFrame:
    """Anchors whose lead another anchor has: neighbours in the sorted buckets, or across their borders."""
    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(found.count() * (lead + 28) / BUCKET_BYTES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        lead_bytes = np.concatenate([fixed(b.column(4), lead) for b in got])
        padded = np.zeros((len(lead_bytes), -(-lead // 8) * 8), np.uint8)
        padded[:, :lead] = lead_bytes
        order, group = multikey_order(padded.view(">u8").astype(np.uint64))
        shared = np.bincount(group)[group] > 1
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        keep = np.flatnonzero(shared | edge)
        out = rows.take(pa.array(order[keep]))
        leads = [lead_bytes[order[k]].tobytes() if e else None for k, e in zip(keep, edge[keep])]
        out = out.set_column(4, "lead", pa.array(leads, pa.binary()))
        out = out.append_column("shared", pa.array(shared[keep]))
        out = out.append_column("bucket", pa.array(np.full(len(keep), TaskContext.get().partitionId(), np.int32)))
        yield from out.combine_chunks().to_batches()

    spread = found.repartitionByRange(n, "lead", "row", "position")
    sorted_ = staged(spread.mapInArrow(scan, f"{_ANCHOR}, lead binary, shared boolean, bucket int"), "sorted")
    borders = sorted_.filter("lead IS NOT NULL")
    meeting = borders.groupBy("lead").agg(F.countDistinct("bucket").alias("buckets")).filter("buckets > 1")
    across = borders.filter("NOT shared").join(meeting, "lead", "left_semi")
    return sorted_.filter("shared").unionByName(across).select("row", "position", "first", "last")


def _with_texts(spans: DataFrame, numbered: DataFrame, *columns: str) -> DataFrame:
    """``row, text, spans``: the spans of a row are at most as many as its bytes."""
    lists = spans.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return numbered.join(lists, "row").select("row", "text", "spans")


def _per_text(batches, work, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``work(sums1, sums2, base, fields)`` for pieces of ``row, text, spans``; fields are places in the piece."""
    for batch in batches:
        row = batch.column(0).to_numpy()
        data, offsets = utf8(batch.column(1))
        lists = batch.column(2)
        ends, values = lists.offsets.to_numpy(), lists.values
        fields = [values.field(k).to_numpy() for k in range(values.type.num_fields)]
        for i, j in pieces(offsets, SMALL):
            part = data[offsets[i] : offsets[j]]
            doc = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
            shift = offsets[doc] - offsets[i]
            inside = [f[ends[i] : ends[j]] for f in fields]
            out = work(prefix_sums(part), prefix_sums(part, _SECOND), shift, inside, row[doc])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)


def _pair(one: np.ndarray, two: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [range_hashes(s, start, end).view(np.int64) for s in (one, two)]


def blocks(shared: DataFrame, numbered: DataFrame, length: int) -> DataFrame:
    """``row, first, last`` of every block of starts, with the hashes of its hull and its core."""

    def work(one, two, shift, inside, row):
        position, first, last = (x.astype(np.int64) for x in inside)
        lo, hi = (position - last) // BLOCK, (position - first) // BLOCK  # blocks count back from the anchor
        of = np.repeat(np.arange(len(position)), hi - lo + 1)
        block = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[of]
        near = position[of] - block * BLOCK  # the last start a whole block would have
        x, y = np.maximum(first[of], near - BLOCK + 1), np.minimum(last[of], near)
        s = shift[of]
        hull = _pair(one, two, s + x, s + y + length)
        core = _pair(one, two, s + near, s + near - BLOCK + 1 + length)
        return [row[of], x.astype(np.int32), y.astype(np.int32), *hull, *core]

    names = ["row", "first", "last", "h1", "h2", "c1", "c2"]
    kinds = "row long, first int, last int, h1 long, h2 long, c1 long, c2 long"
    joined = _with_texts(shared, numbered, "position", "first", "last")
    return joined.mapInArrow(lambda b: _per_text(b, work, names), kinds)


def strings(parts: DataFrame, numbered: DataFrame, length: int) -> DataFrame:
    """``row, first, mine`` and the hash of every single string of the given blocks."""

    def work(one, two, shift, inside, row):
        first, last, mine = inside
        first, last = first.astype(np.int64), last.astype(np.int64)
        count = last - first + 1
        of = np.repeat(np.arange(len(first)), count)
        start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        return [row[of], start.astype(np.int32), mine[of], *_pair(one, two, shift[of] + start, shift[of] + start + length)]

    joined = _with_texts(parts, numbered, "first", "last", "mine")
    return joined.mapInArrow(
        lambda b: _per_text(b, work, ["row", "first", "mine", "s1", "s2"]), "row long, first int, mine int, s1 long, s2 long"
    )


def repeated_spans(numbered: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """``row, first, last``: ranges of starts whose ``length`` bytes start anywhere else as well."""
    found = staged(anchor_rows(numbered, length, lead), "anchors")
    shared = staged(shared_anchors(found, lead), "shared")
    release(found)
    cut = staged(blocks(shared, numbered, length), "blocks")
    release(shared)
    hull, core = ["h1", "h2"], ["c1", "c2"]
    one = F.min(F.struct("row", "first", "last", *core)).alias("one")
    hulls = staged(cut.groupBy(*hull).agg(F.count("*").alias("n"), one).filter("n > 1"), "hulls")
    cores = staged(cut.groupBy(*core).agg(F.count("*").alias("n")).filter("n > 1").select(*core), "cores")
    whole = cut.join(hulls, hull, "left_semi").select("row", "first", "last")
    unsure = staged(cut.join(hulls, hull, "left_anti").join(cores, core, "left_semi"), "unsure")
    open_cores = staged(unsure.select(*core).distinct(), "open")
    partners = hulls.select("one.*").join(open_cores, core, "left_semi")
    parts = unsure.select("row", "first", "last", F.lit(1).alias("mine")).union(
        partners.select("row", "first", "last", F.lit(0).alias("mine"))
    )
    single = staged(strings(parts, numbered, length), "strings")
    release(cores, open_cores, unsure)
    twice = staged(single.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("s1", "s2"), "twice")
    ends = single.filter("mine = 1").join(twice, ["s1", "s2"], "left_semi")
    spans = staged(whole.union(ends.select("row", "first", F.col("first").alias("last"))), "spans")
    release(cut, hulls, single, twice)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row of ``docs``.

    ``removed`` holds the maximal ranges of bytes (end exclusive) covered by a string of ``length`` bytes
    that also starts anywhere else in any row, the same one included; ``kept`` is the rest, as bytes. A
    null text is empty. Repeated rows are each other's copies. A row shorter than ``length`` keeps all.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = bucketed(texts(docs).withColumn("row", F.monotonically_increasing_id()), "row", n)
    spans = repeated_spans(numbered, length, lead)
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    joined = numbered.join(lists, "row", "left").select("doc_id", "text", "spans")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            removed, kept = [], []
            for k, spans in enumerate(batch.column(2)):
                raw = data[offsets[k] : offsets[k + 1]]
                runs: list[list[int]] = []
                if spans.is_valid:
                    first, last = (spans.values.field(c).to_numpy() for c in (0, 1))
                    reach = np.maximum.accumulate(last) + length
                    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
                    runs = [[int(first[a]), int(reach[b])] for a, b in zip(new, np.append(new[1:], len(first)) - 1)]
                removed.append([{"first": a, "last": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    return joined.mapInArrow(scan, "doc_id long, n_bytes long, removed array<struct<first:int,last:int>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
