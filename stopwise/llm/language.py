"""Language of a text by a bidirectional gated recurrent network over bytes.

A sequence is a word: its bytes between white space, A-Z lowered, cut every ``LONGEST`` bytes. The network
labels every byte with the probabilities of the languages; a document's are the mean over all its bytes.
As a state never crosses white space, a task runs the network once for each different word it meets and
keeps the sums of a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stopwise.llm.common import PIECE, pieces, utf8
from stopwise.llm.hashing import NOT_SPACE, lowered, prefix_sums, range_hashes, words
from stopwise.llm.recurrent import Adam, backward, forward, random, softmax

HIDDEN, LONGEST, BATCH, RATE, SEED = 16, 32, 512, 0.01, 5
# Bounds of the training sample: documents and words of a language, words of a document. Beyond so many
# languages each has fewer words; none is left out.
DOCUMENTS, WORDS, WORDS_EACH, LANGUAGES, EPOCHS = 300, 15_000, 100, 200, 4
BROADCAST_ROWS = 500_000  # names of chosen documents that are sent to every task, at most; each is about 50 bytes
REMEMBERED = 400_000  # words whose sums a task keeps
UNDETERMINED = "und"


class ByteNetwork:
    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {f"{k}{d}": random(rng, *shape) for d in "fb" for k, shape in (("x", (257, 3 * HIDDEN)), ("h", (HIDDEN, 3 * HIDDEN)))}
        for d in "fb":
            self.p[f"x{d}"] *= 8
        self.p["out"] = random(rng, 2 * HIDDEN, len(labels))
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def _states(self, codes: np.ndarray, mask: np.ndarray, keep: bool):
        return [forward(self.p[f"x{d}"][codes], mask, self.p[f"h{d}"], d == "b", keep) for d in "fb"]

    def sums(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Per sequence the sum over its positions of the label probabilities."""
        h = np.concatenate(self._states(codes, mask, False), axis=2)
        return (softmax(h @ self.p["out"] + self.p["bias"]) * mask[:, :, None]).sum(axis=0)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        (hf, tf), (hb, tb) = self._states(codes, mask, True)
        h = np.concatenate([hf, hb], axis=2)
        p = softmax(h @ self.p["out"] + self.p["bias"])
        p[:, np.arange(len(label)), label] -= 1
        d = p * (mask[:, :, None] / mask.sum())
        dh = d @ self.p["out"].T
        flat = d.reshape(-1, d.shape[2])
        grads = {"out": h.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0)}
        for name, tape, part in (("f", tf, dh[:, :, :HIDDEN]), ("b", tb, dh[:, :, HIDDEN:])):
            d_in, grads[f"h{name}"] = backward(tape, part, self.p[f"h{name}"])
            grads[f"x{name}"] = np.zeros_like(self.p[f"x{name}"])
            np.add.at(grads[f"x{name}"], codes.reshape(-1), d_in.reshape(-1, d_in.shape[2]))
        return grads


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences side by side, ``[time, sequence]``; 256 fills up the shorter ones."""
    size = int((end - start).max())
    at = start[None, :] + np.arange(size)[:, None]
    mask = at < end[None, :]
    return np.where(mask, data[np.minimum(at, len(data) - 1)], 256), mask.astype(np.float32)


def cut(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of at most ``LONGEST`` bytes and the word each is of."""
    n = -(-(end - start) // LONGEST)
    of = np.repeat(np.arange(len(start)), n)
    first = start[of] + LONGEST * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    return of, first, np.minimum(first + LONGEST, end[of])


class Labeller:
    """Sums of label probabilities per row of a batch, remembering the words it has seen."""

    def __init__(self, network: ByteNetwork) -> None:
        self.network = network
        self.share = _share(len(network.labels))
        self.known = np.empty(0, np.uint64)
        self.value = np.empty((0, len(network.labels)), np.float32)

    def _looked_up(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(fresh):
            made = np.empty((len(fresh), len(self.network.labels)), np.float32)
            size = end[fresh] - start[fresh]
            order = np.argsort(size, kind="stable")
            many = max(1, int(4096 * self.share))
            for k in range(0, len(order), many):  # of like length, so that little is filled up
                part = order[k : k + many]
                made[part] = self.network.sums(*coded(data, start[fresh[part]], end[fresh[part]]))
            if len(self.known) + len(fresh) > REMEMBERED * self.share:
                self.known, self.value = self.known[:0], self.value[:0]
                if len(fresh) < len(hashes):
                    return self._looked_up(hashes, start, end, data)
            names = np.concatenate([self.known, hashes[fresh]])
            by = np.argsort(names)
            self.known, self.value = names[by], np.concatenate([self.value, made])[by]
            at = np.searchsorted(self.known, hashes)
        return self.value[at]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data = lowered(data)
        found = words(data, offsets, NOT_SPACE)
        total = np.zeros((len(offsets) - 1, len(self.network.labels)))
        if len(found.doc):
            of, start, end = cut(found.start, found.end)
            whole = range_hashes(prefix_sums(data), start, end)
            hashes, first, back = np.unique(whole, return_index=True, return_inverse=True)
            value = self._looked_up(hashes, start[first], end[first], data)
            doc = found.doc[of]
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(doc, value[back, k], len(total))
        return total


def _share(languages: int) -> float:
    """What a language keeps of its words, and a task of its rows and words, where there are very many."""
    return min(1.0, LANGUAGES / max(languages, 1))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id counts as its own text, ``''``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_words(docs: DataFrame) -> list[tuple[str, bytes]]:
    """``(language, word)`` of a bounded sample: by hash of the text, at most the constants above."""
    labelled = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("_hash"))
    distinct = hashed.groupBy("lang", "_hash").agg(F.min("doc_id").alias("doc_id"))  # copies count once
    # a share by hash that holds some four times what is wanted, so that few rows of a language meet in a task
    number = distinct.groupBy("lang").agg(F.count("*").alias("_n"))
    languages = number.count()
    words_each = max(1, int(WORDS_EACH * _share(languages)))
    distinct = distinct.join(F.broadcast(number), "lang").filter(F.pmod("_hash", F.lit(1 << 20)) * F.col("_n") < 4 * DOCUMENTS * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    chosen = distinct.withColumn("place", rank).filter(f"place <= {DOCUMENTS}").select("lang", "_hash", "doc_id")
    if languages * DOCUMENTS <= BROADCAST_ROWS:  # then the texts are filtered where they are read
        chosen = F.broadcast(chosen)
    chosen = hashed.join(chosen, ["lang", "_hash", "doc_id"]).dropDuplicates(["lang", "_hash"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for k in range(batch.num_rows):
                raw = lowered(data[offsets[k] : offsets[k + 1]])
                found = words(raw, np.array([0, len(raw)]), NOT_SPACE)
                of, start, end = cut(found.start, found.end)
                take = np.random.default_rng(len(raw)).permutation(len(of))[:words_each]
                tokens = [raw[start[i] : end[i]].tobytes() for i in take]
                lang = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(tokens), np.int32)))
                yield pa.RecordBatch.from_arrays([lang, pa.array(tokens, pa.binary())], ["lang", "word"])

    sample = chosen.select("lang", "text").mapInArrow(scan, "lang string, word binary")
    return sorted((r["lang"], bytes(r["word"])) for r in sample.collect())


def train(sample: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork | None:
    """Position-wise cross-entropy by backpropagation through time; languages weigh the same."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    network = ByteNetwork(labels, seed)
    by: dict[str, list[bytes]] = {k: [] for k in labels}
    for lang, word in sample:
        by[lang].append(word)
    size = min(max(1, int(WORDS * _share(len(labels)))), max(map(len, by.values())))
    rule = Adam(network.p, RATE)
    for epoch in range(epochs):
        rule.rate = RATE * (1 - epoch / epochs) + 0.001
        tokens, target = [], []
        for k, name in enumerate(labels):
            tokens += [by[name][i] for i in rng.integers(len(by[name]), size=size)]
            target += [k] * size
        lengths = np.array([len(t) for t in tokens])
        batches = np.array_split(np.lexsort((rng.random(len(tokens)), lengths)), max(1, len(tokens) // BATCH))
        for k in rng.permutation(len(batches)):
            part = batches[k]
            data = np.frombuffer(b"".join(tokens[i] for i in part), np.uint8)
            end = np.cumsum(lengths[part])
            codes, mask = coded(data, end - lengths[part], end)
            rule.update(network.gradients(codes, mask, np.array([target[i] for i in part])))
    return network


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row has a letter of any script; rows without an ASCII letter are looked at one by one."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    seen = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    A null text, and one without a letter, is ``und`` with score 0, as is everything where nothing could be
    learned. Whole texts are read; equal texts get equal answers; ties go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        labels = np.array([*(shared.value.labels if shared.value else []), UNDETERMINED], object)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in pieces(offsets, int(PIECE * (labeller.share if labeller else 1))):
                part, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if labeller:
                    total = labeller(part, base)
                    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                    best = np.where(has_letter(part, base), share.argmax(axis=1), len(labels) - 1)
                else:
                    share, best = np.zeros((j - i, 1)), np.zeros(j - i, np.int64)
                score = np.append(share, np.zeros((j - i, 1)), axis=1)[np.arange(j - i), best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(labels[best], pa.string()), pa.array(np.clip(score, 0, 1))],
                    ["doc_id", "lang_pred", "score"],
                )

    found = rows.mapInArrow(scan, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, train(training_words(docs)))
