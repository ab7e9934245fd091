"""Alignment of two tokenizers over the same text, and how often their tokens meet in the corpus.

A is a byte-level BPE over a space and the text, B a piece model over the text (it puts the space itself). Each
token covers bytes; the ``end: index`` dictionaries of both sides are intersected, and the common ends, in order,
slice both lists of ids into groups. Ends are small distinct integers, so a dictionary is a table addressed by the
end itself: a hash without collisions whose keys are read in order. Within a slice no two ends coincide, so every
end of either side closes exactly one link, a pair of tokens whose bytes overlap.

Links are kept per document as distinct pairs of ids with their numbers. Their corpus-wide counts are summed by
Spark and looked up again in blocks of at most ``BLOCK_PAIRS`` pairs, one broadcast and one pass over the kept
links each, so no link moves for the lookup and memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from stopwise.llm.common import pieces, release, staged, utf8

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_PAIRS = 2_000_000  # about 34 MB
FAST_CHARS = 100_000  # longer texts take the library of the vocabulary file, which has no limit on runs of spaces
SLICE = 1 << 20

# The pattern that cuts text before the merges of this kind of vocabulary, and the bytes that stand
# for themselves in its entries; the others are numbered from 256.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE_MARK = "▁"


class _Tokens:
    """Bytes and lengths of every id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.bytes = entries
        self.length = np.array([len(e) for e in entries], np.int64)

    def cover(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


class ByteSide(_Tokens):
    """Ids of a byte-level BPE file. Where ids are the ranks of the merges, a faster library gives the same ids."""

    def __init__(self, file: bytes) -> None:
        self._whole = Tokenizer.from_str(file.decode())
        self._whole.encode_special_tokens = True
        model = json.loads(file)["model"]
        hidden = [b for b in range(256) if b not in SHOWN]
        byte_of = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = model["vocab"]
        entries = [b""] * (max([*vocabulary.values(), self._whole.get_vocab_size() - 1]) + 1)
        for name, number in vocabulary.items():
            if all(c in byte_of for c in name):
                entries[number] = bytes(byte_of[c] for c in name)
        super().__init__(entries)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranked = all(vocabulary.get(name) == 256 + rank for rank, name in enumerate(merged))
        ranks = {entries[i]: i for i in range(256 + len(merged))} if ranked else {}
        self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked else None

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None and len(text) <= FAST_CHARS:
            return np.array(self._fast.encode_ordinary(text), np.int64)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int64)


class PieceSide(_Tokens):
    """Ids of a piece model with byte fallback."""

    def __init__(self, file: bytes) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        ids = range(self._model.get_piece_size())
        plain = lambda i: self._model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        byte = lambda i: bytes([int(self._model.id_to_piece(i)[1:-1], 16)])
        super().__init__([byte(i) if self._model.is_byte(i) else plain(i) for i in ids])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.int64)


@cache
def _sides(byte_file: bytes, piece_file: bytes) -> tuple[ByteSide, PieceSide, np.ndarray]:
    """Once per Python worker; with the text of every id and what may follow it in a list of groups."""
    a, b = ByteSide(byte_file), PieceSide(piece_file)
    written = [f"{i}{sep}" for side, seps in ((a, ",|"), (b, ",;")) for sep in seps for i in range(len(side.bytes))]
    width = max(map(len, written))
    marks = np.frombuffer("".join(w.ljust(width, "\0") for w in written).encode(), np.uint8).reshape(len(written), width)
    return a, b, marks


def dictionaries(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Two rows, A and B: at every byte offset the index of the token that ends there, or -1."""
    index = np.full((2, int(ends_a[-1]) + 1), -1, np.int32)
    index[0, ends_a], index[1, ends_b] = np.arange(len(ends_a)), np.arange(len(ends_b))
    return index


def common_ends(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every offset where tokens of both sides end, in order, the index of either token."""
    both = np.flatnonzero((index >= 0).all(axis=0))
    return index[0, both], index[1, both]


def links_of(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked tokens, in order of the bytes where they meet: as many ends as lie before."""
    ends = index >= 0
    ends = ends[:, ends.any(axis=0)]
    return np.cumsum(ends[0]) - ends[0], np.cumsum(ends[1]) - ends[1]


def _written(a, b, last_a, last_b, marks: np.ndarray, size_a: int, size_b: int) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` piece by piece, from the index of every group's last tokens."""
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a], order[place_b] = a, b + 2 * size_a
    order[place_a[last_a]] += size_a
    order[place_b[last_b]] += size_b
    for k in range(0, len(order), SLICE):
        text = marks[order[k : k + SLICE]]
        yield text[text != 0].tobytes()


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, numbers binary"
_NAMES = [c.split(" ")[0] for c in _ALIGNED.split(", ")]


def _file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def align(
    docs: DataFrame,
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
    hashed: bool = False,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, numbers`` for every row of ``docs``.

    ``groups`` writes the ids of each group as ``a1,a2|b1;a3|b2,b3``, or with ``hashed`` its SHA-256 in hex.
    ``pairs`` holds the distinct linked pairs of ids as ``a * (ids of B) + b``, ascending, as unsigned numbers of
    8 bytes, and ``numbers`` how many links of the document have them. Null and empty texts, and texts that the
    tokens of a side do not spell, have no tokens: zeros and empty columns. Special tokens are plain text.
    Repeated rows are rows of their own. A task needs memory for its longest text.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((_file(spark, byte_vocabulary), _file(spark, piece_vocabulary)))

    def one(text: bytes) -> tuple:
        side_a, side_b, marks = _sides(*files.value)
        plain = text.decode()
        a, b = side_a.encode(" " + plain), side_b.encode(plain)
        if not (text and side_a.cover(a, b" " + text) and side_b.cover(b, b" " + text)):
            return 0, 0, 0, 0, "", b"", b""
        index = dictionaries(side_a.length[a].cumsum(), side_b.length[b].cumsum())
        last_a, last_b = common_ends(index)
        link_a, link_b = links_of(index)
        code = a[link_a].astype(np.uint64) * np.uint64(len(side_b.bytes)) + b[link_b].astype(np.uint64)
        pairs, numbers = np.unique(code, return_counts=True)
        written = _written(a, b, last_a, last_b, marks, len(side_a.bytes), len(side_b.bytes))
        if hashed:
            digest, ended = hashlib.sha256(), len(a) + len(b)
            for part in written:
                ended -= SLICE
                digest.update(part if ended > 0 else part[:-1])
            groups = digest.hexdigest()
        else:
            groups = b"".join(written)[:-1].decode()
        return len(a), len(b), len(last_a), len(code), groups, pairs.tobytes(), numbers.astype(np.uint32).tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets):
                rows = [one(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], _NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, _ALIGNED)


def _packed(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(dtype) if raw.ctypes.data % 8 == 0 else raw.copy().view(dtype), (ends - ends[0]) // np.dtype(dtype).itemsize


def pair_counts(aligned: DataFrame, pieces_of_b: int) -> DataFrame:
    """``pair, n, best``: links of the corpus per pair of ids; ``best`` if no pair with that id of B has more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, numbers = _packed(batch.column(0), np.uint64)[0], _packed(batch.column(1), np.uint32)[0]
            distinct, at = np.unique(pairs, return_inverse=True)
            n = np.bincount(at, numbers, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(n)], ["pair", "n"])

    found = aligned.select("pairs", "numbers").mapInArrow(scan, "pair long, n long")
    found = found.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % pieces_of_b)  # at most one row per id of A
    return found.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _looked_up(aligned: DataFrame, block: DataFrame) -> DataFrame:
    """``row, n_best, count_sum``: what the pairs of one block add to every document."""
    spark = aligned.sparkSession
    known = block.toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast(tuple(known[c].to_numpy(t) for c, t in (("pair", np.uint64), ("n", np.int64), ("best", bool))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            pairs, begin = _packed(batch.column(1), np.uint64)
            numbers = _packed(batch.column(2), np.uint32)[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
            numbers[pair[at] != pairs] = 0
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (numbers * best[at], numbers * n[at])]
            columns = [pa.array(s[begin[1:]] - s[begin[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "n_best", "count_sum"])

    found = aligned.select("row", "pairs", "numbers").mapInArrow(scan, "row long, n_best long, count_sum long")
    found = staged(found, "looked-up")
    table.destroy()
    return found


def link_statistics(aligned: DataFrame, pieces_of_b: int, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` and ``count_sum``.

    ``count_sum`` adds up, over a document's links, how many links of the corpus join the same two ids;
    ``n_best`` counts the links of which none with the same id of B is more frequent, ties included.
    """
    aligned = staged(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(aligned, pieces_of_b), "pair-counts")
    blocks = -(-counts.count() // block_pairs)
    found = aligned.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for k in range(blocks):
        found = found.union(_looked_up(aligned, counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    release(counts)
    return aligned.drop("pairs", "numbers").join(found, "row").drop("row")


def align_corpus(
    docs: DataFrame,
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
    hashed: bool = False,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """:func:`align` with :func:`link_statistics`. An empty table gives no row."""
    spark = docs.sparkSession
    size = sentencepiece.SentencePieceProcessor(model_proto=_file(spark, piece_vocabulary)).get_piece_size()
    return link_statistics(align(docs, byte_vocabulary, piece_vocabulary, hashed), size, block_pairs)
