"""Quartile bucket digests: fingerprints of texts that stay close under edits.

Every three consecutive bytes of a text are hashed into one of ``BUCKETS`` counters. A bucket's digit says in
which quarter of all counters its count lies (0 to 3); the digest is a code of the length and the digits, two
bits each. Two digests differ by the sum of their digits' distances (a distance of 3 counts 6) and of their
length codes; ``BOUND`` and more is a likeness of 0, no difference one of 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from stopwise.llm.common import PIECE, pieces, utf8

BUCKETS = 512
LENGTH_STEPS = 16  # of the length code for a factor of e
LENGTH_WEIGHT = 4
BOUND = 2 * BUCKETS
ROWS = 512  # texts whose counters are held at a time
PARTS_PER_TASK = 8

_DISTANCE = np.array([0, 1, 2, 6], np.int64)
_SHIFTS = np.array([6, 4, 2, 0], np.uint8)


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the triplet that starts at every byte but the last two."""
    wide = data.astype(np.uint32)
    x = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    x = (x + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a length code and ``BUCKETS`` digits. A text of one or two bytes is one triplet padded by zeros."""
    length = np.diff(offsets)
    many = len(length)
    if many == 1:  # may be a very long text
        slices = range(0, max(int(length[0]) - 2, 0), PIECE)
        count = sum((np.bincount(_buckets(data[k : k + PIECE + 2]), minlength=BUCKETS) for k in slices), np.zeros((1, BUCKETS), np.int64))
    else:
        padded = np.append(data, np.zeros(2, np.uint8))
        row = np.repeat(np.arange(many), length)
        place = np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]
        whole = place + 2 < length[row]
        count = np.bincount(row[whole] * BUCKETS + _buckets(padded)[whole], minlength=many * BUCKETS).reshape(many, BUCKETS)
    for i in np.flatnonzero((length > 0) & (length < 3)):
        low = offsets[i] - offsets[0]
        short = np.append(data[low : low + length[i]], np.zeros(3 - length[i], np.uint8))
        count[i, _buckets(short)[0]] += 1
    ranked = np.sort(count, axis=1)
    digits = sum(count > ranked[:, k * BUCKETS // 4 - 1, None] for k in (1, 2, 3))
    code = np.minimum(np.rint(LENGTH_STEPS * np.log1p(length)), 255)
    return np.concatenate([code[:, None], digits], axis=1).astype(np.uint8)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digests of all rows of a text column, a bounded number at a time; see ``common.utf8``."""
    found = [np.empty((0, BUCKETS + 1), np.uint8)]
    for i, j in pieces(offsets):
        for k in range(i, j, ROWS):
            last = min(j, k + ROWS)
            found.append(_digests(data[offsets[k] : offsets[last]], offsets[k : last + 1]))
    return np.concatenate(found)


def to_text(rows: np.ndarray) -> list[str]:
    digits = rows[:, 1:].reshape(len(rows), BUCKETS // 4, 4)
    packed = (digits << _SHIFTS).sum(axis=2, dtype=np.uint8)
    return [x.tobytes().hex() for x in np.concatenate([rows[:, :1], packed], axis=1)]


def from_text(texts: list[str]) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1)
    digits = (packed[:, 1:, None] >> _SHIFTS) & 3
    return np.concatenate([packed[:, :1], digits.reshape(len(texts), BUCKETS)], axis=1)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.abs(a.astype(np.int64) - b)
    difference = _DISTANCE[apart[:, 1:]].sum(axis=1) + LENGTH_WEIGHT * apart[:, 0]
    return 1 - np.minimum(difference, BOUND) / BOUND


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints, 0 to 1; null where one is null."""

    @pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        both = x.notna() & y.notna()
        if both.any():
            out[both] = likeness_of(from_text(list(x[both])), from_text(list(y[both])))
        return out

    return compared(a, b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint``; a null text reads as empty. Equal texts have equal fingerprints."""
    kept = [c for c in docs.columns if c != "fingerprint"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = to_text(digests(*utf8(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], [*kept, "fingerprint"])

    schema = docs.select(*kept).withColumn("fingerprint", F.lit("")).schema
    return docs.select(*kept, F.col("text").cast("string").alias("fingerprint")).mapInArrow(scan, schema)


def _edited(own: bytes, following: bytes) -> bytes:
    """The last half of the code points replaced by as many from the start of the next text, or all it has."""
    starts = np.flatnonzero((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)
    half = len(starts) // 2
    if not half:
        return own
    other = np.flatnonzero((np.frombuffer(following[: 4 * half + 4], np.uint8) & 0xC0) != 0x80)
    head = following[: other[half]] if len(other) > half else following
    return own[: starts[len(starts) - half]] + head


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
_NAMES = [c.split(" ")[0] for c in _RESULT.split(", ")]


def _compared(rows: list[tuple[int | None, bytes, int]], last: bytes) -> Iterator[pa.RecordBatch]:
    """Results of successive documents ``(id, text, repeats)``; ``last`` is the text after them."""
    texts = [text for _, text, _ in rows]
    edited = [_edited(a, b) for a, b in zip(texts, [*texts[1:], last])]
    made = digests(*utf8(pa.array([*texts, last, *edited], pa.large_binary())))
    own, after, changed = made[: len(rows)], made[1 : len(rows) + 1], made[len(rows) + 1 :]
    chars = [int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)) for t in texts]
    columns = [
        pa.array([i for i, _, _ in rows], pa.int64()),
        pa.array(chars, pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
        pa.array(to_text(own), pa.string()),
        pa.array(to_text(changed), pa.string()),
        pa.array(likeness_of(own, changed)),
        pa.array(likeness_of(own, after)),
    ]
    found = pa.RecordBatch.from_arrays(columns, _NAMES)
    many = np.repeat(np.arange(len(rows)), [n for _, _, n in rows])
    for k in range(0, len(many), 4096):
        yield found.take(pa.array(many[k : k + 4096]))


def _parts(docs: DataFrame, splits: np.ndarray) -> DataFrame:
    """Adds ``part``: how many of the splits are at or below ``doc_id``; null ids come first."""

    @pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(splits, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), 0, found).astype(np.int32))

    return docs.withColumn("part", part("doc_id"))


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness; and the likeness to the next text.

    Documents stand in order of ``doc_id`` (null first), then of their texts, and the first follows the last.
    The last half of a text's code points, rounded down, is replaced by as many from the start of the next.
    A null text is empty; it is like another empty text. Rows that agree in ``doc_id`` and text are one
    document and have equal results; the next document is another one, unless there is no other. An empty
    table gives no row; other columns are not looked at.

    Texts move once: ids are cut into ranges at approximate quantiles, each range also gets the first document
    of the one after it, and a task walks through its ranges in order with one text in hand.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    many = PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / many for k in range(1, many)]
    splits = texts.agg(F.percentile_approx("doc_id", cuts, 10 * many)).first()[0] or []
    placed = _parts(texts, np.unique(np.array(splits, np.int64)))
    # One row per range comes to the driver: its first id.
    lowest = _parts(texts.select("doc_id"), np.unique(np.array(splits, np.int64)))
    lowest = lowest.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    lowest = sorted((r["part"], r["first"]["doc_id"]) for r in lowest.collect())
    before = [(part, doc_id, lowest[k - 1][0]) for k, (part, doc_id) in enumerate(lowest)]
    heads = F.broadcast(spark.createDataFrame(before, "part int, head long, into int"))
    first = placed.join(heads, "part").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("into", "doc_id").agg(F.min("text").alias("text"))
    own = placed.select("part", F.lit(False).alias("foreign"), "doc_id", "text")
    rows = own.union(first.select("into", F.lit(True), "doc_id", "text"))
    order = ["part", "foreign", F.asc_nulls_first("doc_id"), "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes, int]] = []
        for batch in batches:
            foreign, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            data, offsets = utf8(batch.column(3))
            for i, j in pieces(offsets):
                for k in range(i, j):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    if foreign[k]:
                        yield from _compared(held, text)
                        held = []
                    elif held and held[-1][0] == ids[k] and held[-1][1] == text:
                        held[-1] = (*held[-1][:2], held[-1][2] + 1)
                    else:
                        held.append((ids[k], text, 1))
                if len(held) > 1:
                    yield from _compared(held[:-1], held[-1][1])
                    held = held[-1:]

    return rows.repartition(many // PARTS_PER_TASK, "part").sortWithinPartitions(*order).mapInArrow(scan, _RESULT)
