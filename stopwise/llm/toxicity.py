"""Toxicity of a text by a bidirectional gated recurrent network with attention pooling.

A word's input is a vector of its own plus the sum of vectors of its character pieces (runs of 4 to 8 bytes,
with the word's borders), as far as the training documents show that they go with a label. The network reads windows of
``WINDOW`` words that overlap by half, pools the states of a window by attention and scores it; a document
has the score of its worst window, so a few words in a long text are not diluted.

Labels are of documents, not windows. Training therefore begins with all windows of a toxic document as
positive, and goes on with the window that scores highest in each and the worst few of each clean one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stopwise.llm.common import pieces, utf8
from stopwise.llm.hashing import lowered, mix, prefix_sums, range_hashes, words
from stopwise.llm.language import held_out
from stopwise.llm.recurrent import Adam, backward, forward, random, sigmoid, softmax

WINDOW, STRIDE = 16, 8
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
GRAMS = (4, 5, 6, 8)
# Bounds of the training sample: documents of each label, vocabulary; evidence a feature must have.
TOXIC, CLEAN, VOCABULARY, EVIDENCE = 800, 2000, 4_000, 20.0
TOXIC_SHARE = 0.3  # of the loss
FIRST_EPOCHS, FIRST_WINDOWS, LATER_EPOCHS, WORST, BATCH, RATE, SEED = 2, 8, 6, 2, 256, 0.02, 3
LEAST_STEPS = 40  # of an epoch

SMALL = 256 << 10  # bytes of the sample worked on at once

# What stands between white space and ASCII punctuation.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Tokens:
    """Words of a piece of text, and the features of each different one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = lowered(data)
        found = words(data, offsets, WORD)
        self.count = np.bincount(found.doc, minlength=len(offsets) - 1)
        _, first, self.of = np.unique(found.hash, return_index=True, return_inverse=True)
        self.feature, self.word = self._features(data, found.start[first], found.end[first], found.hash[first])

    @staticmethod
    def _features(data, start, end, hashes) -> tuple[np.ndarray, np.ndarray]:
        """``(feature, word)``: the word itself and its character pieces."""
        if not len(start):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        size = end - start + 2
        place = np.cumsum(size) - size
        text = np.full(int(size.sum()), 0x20, np.uint8)  # every word between two borders
        of = np.repeat(np.arange(len(start)), end - start)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(end - start) - (end - start), end - start)
        text[place[of] + 1 + inside] = data[start[of] + inside]
        sums = prefix_sums(text)
        feature, word = [mix(hashes + np.uint64(1))], [np.arange(len(start))]
        for n in GRAMS:
            many = np.maximum(size - n + 1, 0)
            of = np.repeat(np.arange(len(start)), many)
            at = place[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            feature.append(range_hashes(sums, at, at + n))
            word.append(of)
        return np.concatenate(feature), np.concatenate(word)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """``(document, words [window, WINDOW])``: every word is in a window; -1 fills up."""
        n = np.where(self.count > 0, 1 + -(-np.maximum(self.count - WINDOW, 0) // STRIDE), 0)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(self.count) - self.count
        at = first[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        index = at[:, None] + np.arange(WINDOW)
        valid = index < (first + self.count)[doc][:, None]
        return doc, np.where(valid, self.of[np.minimum(index, max(len(self.of) - 1, 0))] if len(self.of) else -1, -1)


class WindowNetwork:
    def __init__(self, vocabulary: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.p = {"e": (rng.standard_normal((len(vocabulary) + 1, WIDTH)) * 0.1).astype(np.float32)}
        self.p["e"][-1] = 0
        for d in "fb":
            self.p[f"x{d}"] = random(rng, WIDTH, 3 * HIDDEN)
            self.p[f"h{d}"] = random(rng, HIDDEN, 3 * HIDDEN)
            self.p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"u": random(rng, 2 * HIDDEN, ATTENTION), "v": random(rng, ATTENTION), "w": random(rng, 2 * HIDDEN)}
        self.p["bias"] = np.zeros(1, np.float32)

    def known(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """``(row of the vocabulary, word)`` of the features the network has."""
        at = np.minimum(np.searchsorted(self.vocabulary, tokens.feature), max(len(self.vocabulary) - 1, 0))
        hit = np.flatnonzero(self.vocabulary[at] == tokens.feature) if len(self.vocabulary) else np.empty(0, np.int64)
        return at[hit], tokens.word[hit]

    def vectors(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Inputs of ``n`` words and, at the end, of the filling."""
        out = np.zeros((n + 1, WIDTH), np.float32)
        for k in range(WIDTH):
            out[:, k] = np.bincount(word, self.p["e"][row, k], n + 1)
        return out

    def _pooled(self, states: np.ndarray, mask: np.ndarray):
        a = np.tanh(states @ self.p["u"])
        e = np.where(mask > 0, a @ self.p["v"], -1e9)
        weight = softmax(e.T).T
        context = (weight[:, :, None] * states).sum(axis=0)
        return a, weight, context

    def scores(self, vectors: np.ndarray, window: np.ndarray) -> np.ndarray:
        mask = (window.T >= 0).astype(np.float32)
        states = [
            forward((vectors @ self.p[f"x{d}"] + self.p[f"c{d}"])[window.T], mask, self.p[f"h{d}"], d == "b") for d in "fb"
        ]
        _, _, context = self._pooled(np.concatenate(states, axis=2), mask)
        return sigmoid(context @ self.p["w"] + self.p["bias"])

    def gradients(self, row, word, window, label, weight) -> dict[str, np.ndarray]:
        n = int(window.max()) + 1
        vectors = self.vectors(row, word, n)
        mask = (window.T >= 0).astype(np.float32)
        x = vectors[window.T]
        both = [forward(x @ self.p[f"x{d}"] + self.p[f"c{d}"], mask, self.p[f"h{d}"], d == "b", True) for d in "fb"]
        states = np.concatenate([both[0][0], both[1][0]], axis=2)
        a, share, context = self._pooled(states, mask)
        p = sigmoid(context @ self.p["w"] + self.p["bias"])
        d = ((p - label) * weight).astype(np.float32)
        grads = {"w": context.T @ d, "bias": d.sum(keepdims=True)}
        d_context = d[:, None] * self.p["w"]
        d_share = (states * d_context).sum(axis=2)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        grads["v"] = (a * d_e[:, :, None]).sum(axis=(0, 1))
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a * a)
        grads["u"] = states.reshape(-1, 2 * HIDDEN).T @ d_a.reshape(-1, ATTENTION)
        d_states = share[:, :, None] * d_context + d_a @ self.p["u"].T
        d_x = np.zeros_like(x)
        for k, name in enumerate("fb"):
            d_in, grads[f"h{name}"] = backward(both[k][1], d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN], self.p[f"h{name}"])
            grads[f"x{name}"] = x.reshape(-1, WIDTH).T @ d_in.reshape(-1, 3 * HIDDEN)
            grads[f"c{name}"] = d_in.sum(axis=(0, 1))
            d_x += d_in @ self.p[f"x{name}"].T
        d_vectors = np.zeros_like(vectors)
        np.add.at(d_vectors, window.T.reshape(-1), d_x.reshape(-1, WIDTH))
        grads["e"] = np.zeros_like(self.p["e"])
        np.add.at(grads["e"], row, d_vectors[word])
        grads["e"] += 1e-6 * self.p["e"]
        return grads


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """A bounded sample of labelled rows outside the held-out fifth: by hash of the text, so many of each label.

    The label of every chosen id, and ``(doc_id, text)`` of the rows. Rows with a null label, id or text are left out.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = known.select("doc_id", F.xxhash64("text").alias("place")).join(marked, "doc_id")
    hashed = hashed.groupBy("place").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))  # copies count once
    # a share by hash that holds some four times what is wanted, so that few rows of a label meet in a task
    number = {r["toxic"]: r["count"] for r in hashed.groupBy("toxic").count().collect()}
    wanted = F.when(F.col("toxic") == 1, 4 * TOXIC / max(1, number.get(1, 1))).otherwise(4 * CLEAN / max(1, number.get(0, 1)))
    hashed = hashed.filter(F.pmod(F.col("place"), F.lit(1 << 20)) < wanted * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("place", "doc_id"))
    most = F.when(F.col("toxic") == 1, TOXIC).otherwise(CLEAN)
    chosen = hashed.withColumn("rank", rank).filter(f"rank <= {max(TOXIC, CLEAN)}").filter(F.col("rank") <= most)
    ids = {r["doc_id"]: r["toxic"] for r in chosen.select("doc_id", "toxic").collect()}
    return ids, known.filter(F.col("doc_id").isin(list(ids)))


def likelihood_ratio(bad: np.ndarray, n: np.ndarray, toxic: int, documents: int) -> np.ndarray:
    """G-squared of having a feature against being toxic: how sure it is that the two belong together."""
    total = np.zeros(len(n))
    for seen, row, column in (
        (bad, n, toxic),
        (n - bad, n, documents - toxic),
        (toxic - bad, documents - n, toxic),
        (documents - toxic - n + bad, documents - n, documents - toxic),
    ):
        expected = np.maximum(row * column / documents, 1e-12)
        total += 2 * seen * np.log(np.maximum(seen, 1e-12) / expected)
    return total


def chosen_features(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The features that surely go with a label, by the documents that have them; piece by piece."""
    names = n = bad = None
    for i, j in pieces(offsets, SMALL):
        tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        doc = np.repeat(np.arange(j - i), tokens.count)
        known = np.unique(tokens.of.astype(np.int64) * (j - i) + doc)  # words with the documents they are in
        order = np.argsort(tokens.word, kind="stable")
        begin = np.searchsorted(tokens.word[order], known // (j - i))
        many = np.searchsorted(tokens.word[order], known // (j - i), "right") - begin
        of = np.repeat(np.arange(len(known)), many)
        at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        found, place = np.unique(tokens.feature[order[at]], return_inverse=True)
        pairs = np.unique(place.astype(np.int64) * (j - i) + (known % (j - i))[of])
        feature = pairs // (j - i)
        here = np.bincount(feature, minlength=len(found))
        here_bad = np.bincount(feature, toxic[i + pairs % (j - i)], len(found))
        if names is None:
            names, n, bad = found, here, here_bad
        else:
            whole, place = np.unique(np.concatenate([names, found]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, here]), len(whole))
            bad = np.bincount(place, np.concatenate([bad, here_bad]), len(whole))
            names = whole
    evidence = likelihood_ratio(bad, n, int(toxic.sum()), len(toxic))
    enough = np.flatnonzero(evidence >= EVIDENCE)
    return np.sort(names[enough[np.argsort(-evidence[enough], kind="stable")][:VOCABULARY]])


def gathered(network: WindowNetwork, data: np.ndarray, offsets: np.ndarray):
    """Each different window of a document once, with its share of the document's windows.

    Words with a feature are numbered from 1, word 0 stands for all others, -1 fills up. Also returned are
    the features of the words (row of the vocabulary and word, by word) and the number of words.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    top = 1
    for i, j in pieces(offsets, SMALL):
        tokens = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        doc, window = tokens.windows()
        if not len(doc):
            continue
        row, word = network.known(tokens)
        has = np.unique(word)
        number = np.zeros(int(tokens.of.max()) + 2, np.int64)
        number[has] = top + np.arange(len(has))
        number[-1] = -1
        top += len(has)
        plain = number[window]
        code = (mix(plain.astype(np.uint64)) @ _PLACES).view(np.int64)
        by = np.lexsort((code, doc))
        new = np.ones(len(by), bool)
        new[1:] = (doc[by][1:] != doc[by][:-1]) | (code[by][1:] != code[by][:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(by)))
        first = by[first]
        order = np.argsort(word, kind="stable")
        for k, part in enumerate(
            (doc[first] + i, plain[first], times / np.bincount(doc)[doc[first]], row[order], number[word[order]])
        ):
            out[k].append(part)
    if not out[0]:
        out = [[np.empty(0, np.int64)], [np.empty((0, WINDOW), np.int64)], [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    return *(np.concatenate(x) for x in out), top


def train(sample: list[tuple[int, str]], seed: int = SEED) -> WindowNetwork | None:
    if len({toxic for toxic, _ in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    data, offsets = utf8(pa.array([t for _, t in sample], pa.string()))
    toxic = np.array([x for x, _ in sample])
    network = WindowNetwork(chosen_features(data, offsets, toxic), seed)
    doc, window, share, row, word, n_words = gathered(network, data, offsets)
    ends = np.searchsorted(word, np.arange(n_words + 1))
    label = toxic[doc].astype(np.float32)
    even = np.where(label == 1, TOXIC_SHARE / max(1, toxic.sum()), (1 - TOXIC_SHARE) / max(1, (1 - toxic).sum()))
    rule = Adam(network.p, RATE)
    for epoch in range(FIRST_EPOCHS + LATER_EPOCHS):
        rule.rate = RATE * (1 - epoch / (FIRST_EPOCHS + LATER_EPOCHS))
        by = np.lexsort((rng.random(len(doc)), doc))
        rank = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
        use = by[rank < FIRST_WINDOWS]
        weight = even * share / np.bincount(doc[use], share[use])[doc]
        if epoch >= FIRST_EPOCHS:
            score = np.concatenate([network.scores(network.vectors(row, word, n_words), window[k : k + 4096]) for k in range(0, len(window), 4096)])
            by = np.lexsort((-score, doc))
            rank = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
            use, weight = by[rank < np.where(label[by] == 1, 1, WORST)], even
        use = rng.permutation(use)
        batches = np.array_split(use, max(min(LEAST_STEPS, len(use)), len(use) // BATCH))
        for part in batches:
            inside, back = np.unique(window[part], return_inverse=True)
            real = inside[inside >= 1]
            local = np.where(inside >= 1, np.arange(len(inside)) - (len(inside) - len(real)), np.where(inside == 0, len(real), -1))
            local = local[back].reshape(window[part].shape)
            own = np.concatenate([np.empty(0, np.int64), *(np.arange(ends[w], ends[w + 1]) for w in real)])
            to = np.repeat(np.arange(len(real)), (ends[1:] - ends[:-1])[real])
            scaled = (weight[part] * len(batches)).astype(np.float32)
            rule.update(network.gradients(row[own], to, local, label[part], scaled))
    return network


def distinct(window: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different windows, and which of them each window is. Words without a feature are all alike."""
    alike = np.full(n + 1, n)
    alike[word] = word
    alike[n] = -1
    plain = alike[window]  # the filling, -1, takes the last place
    _, first, back = np.unique(mix(plain.astype(np.uint64)) @ _PLACES, return_index=True, return_inverse=True)
    return plain[first], back


_PLACES = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def score_batches(network: WindowNetwork | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of every row: that of its worst window; 0 without words or without a network."""
    out = np.zeros(len(offsets) - 1)
    tokens = Tokens(data, offsets)
    if network is None or not len(tokens.of):
        return out
    doc, window = tokens.windows()
    row, word = network.known(tokens)
    window, back = distinct(window, word, int(tokens.of.max()) + 1)
    vectors = network.vectors(row, word, int(tokens.of.max()) + 1)
    score = np.concatenate([network.scores(vectors, window[k : k + 4096]) for k in range(0, len(window), 4096)])
    np.maximum.at(out, doc, score[back])
    return out


def score_toxicity(docs: DataFrame, network: WindowNetwork | None, column: str = "toxicity") -> DataFrame:
    """Rows and columns of ``docs`` with the score (0 to 1) as ``column``.

    Null and empty texts, and texts without a word, score 0, as does everything where nothing could be
    learned. A column of that name is replaced. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    plain = docs.drop(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    at = plain.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            scores = [
                score_batches(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in pieces(offsets)
            ]
            score = pa.array(np.clip(np.concatenate([np.empty(0), *scores]), 0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, column])

    return plain.mapInArrow(scan, f"{schema}, `{column}` double")


def learn(docs: DataFrame, labels: DataFrame) -> WindowNetwork | None:
    """Trained in one task on the sample, of which neither texts nor arrays come to the driver."""
    ids, picked = training_rows(docs, labels)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        network = train(sorted((ids[doc_id], text) for batch in rows for doc_id, text in batch))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    if len(set(ids.values())) < 2:
        return None
    # coalesced after a shuffle: the filter still runs in many tasks
    found = picked.repartition(8).coalesce(1).mapInArrow(fit, "network binary").collect()
    return pickle.loads(found[0]["network"])
