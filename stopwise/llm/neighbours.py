"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform and is hashed to the
nearest signed axis; a table joins as many such hashes as the number of vectors asks for, the last one over
a part of the axes. Every vector stands once in every table; a query looks into the buckets of the axes that
come next as well, into more of them the more buckets there are. Rows and queries of a bucket meet in one
sorted stream, crowded buckets in a grid of several, and every candidate is ranked by its exact inner product.

Inner products are searched, not angles: where norms differ, a vector is scaled by the largest norm and gets
one more component that makes it a unit vector, and a query gets a zero there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stopwise.llm.common import staged

TABLES, PROBES, SEED = 8, 16, 11
PROBE_RATE = 0.875  # probes of a table per square root of its buckets, which holds recall while the share looked at falls
REACH = 64  # a table's probed buckets should hold so many times k candidates, on average
BUCKET_ROWS = 1024  # vectors a bucket should hold at most, on average
CROWD_ROWS = 50_000  # rows, and queries, of a bucket that one task compares; a fuller bucket is spread over several
ASKED_ROWS = 4096  # queries of a task compared with rows at once


class CrossPolytope:
    def __init__(self, width: int, norm: float, level: bool, rows: int, tables: int, seed: int) -> None:
        self.width, self.norm, self.level, self.tables = width, norm, level, tables
        self.axes = 1 << max(0, (width + (not level) - 1).bit_length())
        wanted = max(1, rows / BUCKET_ROWS)
        self.parts = [self.axes]
        while math.prod(2 * p for p in self.parts) < wanted:
            missing = wanted / math.prod(2 * p for p in self.parts)
            self.parts.append(min(self.axes, 1 << max(0, math.ceil(math.log2(missing)) - 1)))
        random = np.random.default_rng(seed)
        self.signs = random.choice([-1.0, 1.0], (tables, len(self.parts), 3, self.axes))

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        norms = np.linalg.norm(x, axis=1)
        scale = norms if query or self.level else np.full(len(x), self.norm)
        out[:, : self.width] = x / np.where(scale > 0, scale, 1)[:, None]
        if not self.level and not query:
            out[:, self.width] = np.sqrt(np.maximum(0, 1 - (norms / self.norm) ** 2))
        return out

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        return x[:, : self.parts[part]]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of every vector."""
        code = np.zeros(len(x), np.int64)
        for k, size in enumerate(self.parts):
            y = self.turned(x, table, k)
            axis = np.abs(y).argmax(axis=1)
            code = code * 2 * size + axis + size * (y[np.arange(len(x)), axis] < 0)
        return code

    def probes(self, x: np.ndarray, table: int, many: int) -> np.ndarray:
        """The ``many`` buckets next to every vector, by the squared distances given up for other axes."""
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k, size in enumerate(self.parts):
            y = self.turned(x, table, k)
            signed = np.concatenate([y, -y], axis=1)
            away = (signed.max(axis=1, keepdims=True) - signed) ** 2
            code = (code[:, :, None] * 2 * size + np.arange(2 * size)).reshape(len(x), -1)
            cost = (cost[:, :, None] + away[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :many]
            code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
        return code

    def probed(self, k: int, rows: int, least: int = PROBES) -> int:
        """Buckets that a query looks into per table to find ``k`` neighbours among ``rows`` vectors."""
        buckets = math.prod(2 * p for p in self.parts)
        reach = buckets * min(1.0, REACH * k / max(rows, 1))
        return min(buckets, max(least, math.ceil(PROBE_RATE * math.sqrt(buckets)), math.ceil(reach)))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


_ENTRY = "tab int, bucket long, kind int, id long, vec binary"
_NAMES = ["tab", "bucket", "kind", "id", "vec"]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _entries(rows: DataFrame, hashing: CrossPolytope, kind: str, probes: int) -> DataFrame:
    """``id, vec`` once per table, or as queries with ``probes`` buckets per table."""
    shared = rows.sparkSession.sparkContext.broadcast(hashing)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = shared.value.lifted(_matrix(batch.column(1), kind).astype(np.float64), probes > 0)
                for t in range(shared.value.tables):
                    codes = shared.value.probes(x, t, probes) if probes else shared.value.buckets(x, t)[:, None]
                    of = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(codes.size, t, np.int32)),
                            pa.array(codes.reshape(-1)),
                            pa.array(np.full(codes.size, 0 if probes else 1, np.int32)),
                            batch.column(0).take(of),
                            batch.column(1).take(of),
                        ],
                        _NAMES,
                    )

    return rows.select("id", "vec").mapInArrow(scan, _ENTRY)


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows of every query; ties go to the smaller row."""
    order = np.lexsort((row, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def _ranked(entries: DataFrame, kind: str, k: int) -> DataFrame:
    """``query, id, score``: the ``k`` best candidates of every query in every bucket it looked into."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, queries, kept = None, [], [], []

        def done():
            if not kept:
                return
            q, r, s = (np.concatenate(x) for x in zip(*kept))
            at = _best(q, r, s, k)
            yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(r[at]), pa.array(s[at])], ["query", "id", "score"])

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                place = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
                cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if group != tuple(place[a]):
                        yield from done()
                        group, ids, queries, kept = tuple(place[a]), [], [], []
                    part = batch.slice(a, b - a)
                    is_row = part.column(3).to_numpy()
                    split = int(np.searchsorted(is_row, 1))
                    if split:
                        ids.append(part.column(4).slice(0, split).to_numpy())
                        queries.append(_matrix(part.column(5).slice(0, split), kind).astype(np.float64))
                    if split < len(is_row) and ids:
                        names, asked = np.concatenate(ids), np.concatenate(queries)
                        ids, queries = [names], [asked]
                        rows = _matrix(part.column(5).slice(split), kind).astype(np.float64)
                        row_ids = part.column(4).slice(split).to_numpy()
                        for few in range(0, len(asked), ASKED_ROWS):
                            rough = asked[few : few + ASKED_ROWS] @ rows.T
                            least = np.partition(rough, -k, axis=1)[:, -k] if k < len(rows) else np.full(len(rough), -np.inf)
                            slack = 1e-9 * (np.abs(rough).max() if rough.size else 0)
                            q, r = np.nonzero(rough >= (least - slack)[:, None])
                            q += few
                            exact = (asked[q] * rows[r]).sum(axis=1)
                            at = _best(names[q], row_ids[r], exact, k)
                            kept.append((names[q][at], row_ids[r][at], exact[at]))
                        if len(kept) > 16 + len(asked) // ASKED_ROWS:
                            q, r, s = (np.concatenate(x) for x in zip(*kept))
                            at = _best(q, r, s, k)
                            kept = [(q[at], r[at], s[at])]
        yield from done()

    return entries.select("tab", "bucket", "salt", "kind", "id", "vec").mapInArrow(scan, "query long, id long, score double")


def _spread(inside: DataFrame, asking: DataFrame) -> DataFrame:
    """Rows and queries with the ``salt`` of their cell: 0, but for crowded buckets, which are a grid.

    Rows of a crowded bucket are split into ``ways`` and its queries into ``groups``; every part of the rows
    goes to every group and the reverse, so that each pair meets in one cell.
    """
    bucket = ["tab", "bucket"]
    parts = lambda n: F.ceil(F.col(n) / CROWD_ROWS).cast("int")
    crowded = inside.groupBy(*bucket).agg(F.count("*").alias("n")).filter(f"n > {CROWD_ROWS}")
    crowded = staged(crowded.select(*bucket, parts("n").alias("ways")), "crowded")
    if crowded.isEmpty():
        return inside.unionByName(asking).withColumn("salt", F.lit(0))
    asked = asking.join(crowded, bucket).groupBy(*bucket, "ways").agg(F.count("*").alias("n"))
    grid = staged(asked.select(*bucket, "ways", parts("n").alias("groups")), "grid")
    ways, groups = F.coalesce("ways", F.lit(1)), F.coalesce("groups", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = inside.join(grid, bucket, "left").withColumn("group", every(groups)).withColumn("way", F.pmod(F.hash("id"), ways))
    queries = asking.join(grid, bucket, "left").withColumn("way", every(ways)).withColumn("group", F.pmod(F.hash("id"), groups))
    both = rows.unionByName(queries).withColumn("salt", F.col("group") * ways + F.col("way"))
    return both.drop("ways", "groups", "way", "group")


def nearest(
    vectors: DataFrame,
    asked: str,
    k: int,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products found for every query.

    ``vectors`` has ``vec_id`` and ``embedding``; ``asked`` is an SQL condition on ``vec_id`` that names the
    queries, which are compared with every row but their own. Scores are sums in double precision of the
    original components. Vectors that are null, zero, or hold a null or a non-finite component take no part,
    nor do rows without ``vec_id``; shorter vectors count as filled up with zeros. Of equal vectors only the
    ``k + 1`` smallest ids can be among the nearest of anything, so only those are candidates; equal queries
    are searched once. A repeated ``vec_id`` is one vector if its rows are equal, and otherwise a row each.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind, cast = ("<f4", "float") if element == "float" else ("<f8", "double")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{cast}>").alias("embedding"))
    fit = fit.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(sound).withColumn("norm", norm).filter("norm > 0")
    width, least, most, count = fit.agg(F.max(F.size("embedding")), F.min("norm"), F.max("norm"), F.count("*")).first()
    width = width or 1
    padded = F.concat("embedding", F.array_repeat(F.lit(0).cast(cast), F.lit(width) - F.size("embedding")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width) + 0.0
            packed = pa.array([v.tobytes() for v in values.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "vec"])

    packed = staged(fit.select("vec_id", padded.alias("e")).mapInArrow(pack, "vec_id long, vec binary"), "vectors")
    equal = Window.partitionBy("vec").orderBy("vec_id")
    rows = packed.dropDuplicates(["vec_id", "vec"]).withColumn("place", F.row_number().over(equal)).filter(f"place <= {k + 1}")
    rows = rows.select(F.col("vec_id").alias("id"), "vec")
    wanted = packed.filter(asked)
    queries = staged(wanted.groupBy("vec").agg(F.min("vec_id").alias("id")), "queries")
    hashing = CrossPolytope(width, most or 1.0, not most or most - least <= 1e-6 * most, count, tables, seed)
    inside = staged(_entries(rows, hashing, kind, 0), "rows")
    asking = _entries(queries, hashing, kind, hashing.probed(k, count, probes))
    place = ["tab", "bucket", "salt"]
    both = _spread(inside, asking)
    stream = both.repartition(*place).sortWithinPartitions(*place, "kind", "id")
    found = _ranked(stream, kind, k + 1).groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("place", F.row_number().over(best)).filter(f"place <= {k + 1}")
    top = staged(top.select("query", "id", "score"), "top")
    each = staged(wanted.dropDuplicates(["vec_id", "vec"]).join(queries, "vec").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "asked")
    merged = each.join(top, "query").filter("query_id <> id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        merged.withColumn("rank", F.row_number().over(last))
        .filter(f"rank <= {k}")
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
