"""Source divergence, quartile digests and tokenizer alignment against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import lower
from stopwise.llm import alignment, fingerprints
from stopwise.llm.common import table
from stopwise.llm.divergence import Skyband, audit_divergence

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


# --- divergence


def plain_audit(rows, top=200, least=3):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, g, s in rows]
    own, whole, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for g, s, w in docs:
        own[g, s].update(w)
        whole[g].update(w)
        seen[g].update(set(w))
    out = []
    for g in {g for g, _, _ in docs}:
        kept = [t for t, n in seen[g].items() if n >= least]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 1) // (n + v) for t in kept}

        q = shares(whole[g])
        p = {s: shares(own[g, s]) for s in {s for x, s, _ in docs if x == g}}
        f = lambda x, y: (x - y) * (x - y) // y
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[g, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(g, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in audit_divergence(docs, **options).collect())


def corpus(n, seed):
    draw = random.Random(seed)
    words = [a + b for a in ("ka", "Lo", "é", "漢", "zz", "m") for b in ("", "na", "RI", "x", "ß")]
    text = lambda: " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randint(0, 40)))
    return [
        (draw.choice([None, "", text(), text(), text()]), draw.choice(["en", "fr", None, ""]), draw.choice(["a", "b", "c", None, "d"]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"top": 3, "slot_terms": 2, "block": 2, "bucket_terms": 4}])
def test_divergence_equals_plain(spark, options):
    rows = corpus(150, 1)
    assert audited(spark, rows, **options) == plain_audit(rows, options.get("top", 200))


def test_divergence_edges(spark):
    assert audited(spark, []) == []
    none_kept = [("one two", "en", "a"), (None, "en", "b"), ("one", None, None)]
    assert audited(spark, none_kept) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    repeated = [("Same same", "en", "a")] * 3 + [("other", "en", "b")]
    assert audited(spark, repeated) == plain_audit(repeated)
    long = [("word " * 200_000, "en", "a"), ("word x", "en", "b"), ("word y", "en", "b")]
    assert audited(spark, long) == plain_audit(long)


def test_divergence_reads_only_its_columns(spark):
    rows = corpus(40, 2)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    more = docs.withColumns({c: F.lit(7) for c in ("item", "term", "n", "p", "q", "rank", "part", "slot", "v")})
    assert sorted(tuple(r) for r in audit_divergence(more).collect()) == plain_audit(rows)


def test_skyband_keeps_what_fewer_than_k_dominate():
    draw = np.random.default_rng(3)
    count, total = draw.integers(1, 12, 400), draw.integers(1, 12, 400)
    for k in (1, 3, 20):
        expected = [sum(count[:i] >= count[i]) and int(((count[:i] >= count[i]) & (total[:i] <= total[i])).sum()) < k or i == 0 or
                    int(((count[:i] >= count[i]) & (total[:i] <= total[i])).sum()) < k for i in range(400)]
        band = Skyband(k)
        got = np.concatenate([band.keep(count[i : i + 37], total[i : i + 37], 16) for i in range(0, 400, 37)])
        assert got.tolist() == [bool(x) for x in expected]


# --- fingerprints


def plain_digest(text):
    b = list(text.encode())
    if 0 < len(b) < 3:
        b += [0] * (3 - len(b))
    count = [0] * fingerprints.BUCKETS
    for x, y, z in zip(b, b[1:], b[2:]):
        h = ((x | y << 8 | z << 16) + 1) * 0x9E3779B1 & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
        count[h >> 23] += 1
    ranked = sorted(count)
    quarters = [ranked[len(count) * k // 4 - 1] for k in (1, 2, 3)]
    return [min(round(16 * math.log1p(len(text.encode()))), 255)] + [sum(c > q for q in quarters) for c in count]


def plain_likeness(a, b):
    apart = 4 * abs(a[0] - b[0]) + sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1:], b[1:]))
    return 1 - min(apart, 1024) / 1024


def plain_comparison(rows):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    out = {}
    for k, (known, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, other = plain_digest(text), plain_digest(edited), plain_digest(after)
        out[i if known else None, text] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, plain_likeness(own, changed), plain_likeness(own, other),
        )
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def compared(docs):
    read = lambda text: fingerprints.from_text([text])[0].tolist()
    rows = fingerprints.compare_with_edited(docs).collect()
    made = [(r.doc_id, r.n_chars, r.edited_sha256, read(r.fingerprint), read(r.edited_fingerprint), r.near_edited, r.near_next) for r in rows]
    return sorted(made, key=repr)


def test_fingerprints_equal_plain(spark):
    docs = table(spark, SMALL, "documents")
    expected = plain_comparison([(r.doc_id, r.text) for r in docs.collect()])
    assert compared(docs) == expected


def test_fingerprints_edges(spark):
    odd = [(5, "é漢😀" * 9), (1, None), (None, "x"), (None, "y" * 7), (2, ""), (3, "ab"), (3, "ab"), (3, "zebra"), (9, "a" * 3_000_000), (7, "0123456789")]
    for rows in ([], [(4, "alone at home")], [(1, "same"), (1, "same")], odd):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        clashing = docs.withColumns({c: F.lit("x") for c in ("part", "foreign", "fingerprint", "head", "n_chars")})
        assert compared(clashing) == plain_comparison(rows)


def test_likeness_column(spark):
    docs = spark.createDataFrame([(1, "one text here", "one text here"), (2, None, ""), (3, "abcdefgh", "something else")], "id int, text string, other string")
    made = fingerprints.fingerprints(docs)
    both = fingerprints.fingerprints(made.withColumnsRenamed({"fingerprint": "first", "text": "old", "other": "text"}))
    near = {r.id: r.l for r in both.select("id", fingerprints.likeness(F.col("first"), F.col("fingerprint")).alias("l")).collect()}
    assert near[1] == near[2] == 1.0 and near[3] == plain_likeness(plain_digest("abcdefgh"), plain_digest("something else"))


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = fingerprints.compare_with_edited(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.98 * len(rows)


# --- alignment


def plain_alignment(rows):
    whole = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    found, total = [], Counter()
    for i, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        sides = [[bytes(byte[c] for c in whole.id_to_token(x)) for x in a], [piece(x) for x in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append((i, [], [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, at = [], [], [0, 0]
        for cut in cuts:
            to = [e.index(cut, x) + 1 for e, x in zip(ends, at)]
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), at, to)))
            for x, y in itertools.product(range(at[0], to[0]), range(at[1], to[1])):
                if max(ends[0][x] - len(sides[0][x]), ends[1][y] - len(sides[1][y])) < min(ends[0][x], ends[1][y]):
                    links.append((a[x], b[y]))
            at = to
        total.update(links)
        found.append((i, a, b, groups, links))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return sorted(
        ((i, len(a), len(b), len(g), len(k), ";".join(g), sum(total[x] == best[x[1]] for x in k), sum(total[x] for x in k)) for i, a, b, g, k in found),
        key=repr,
    )


def aligned(docs, **options):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    return sorted((tuple(r) for r in alignment.align_corpus(docs, **options).select(*names).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_pairs": 3000}])
def test_alignment_equals_plain(spark, options):
    docs = table(spark, SMALL, "documents").limit(60)
    assert aligned(docs, **options) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


ODD = [
    (1, None), (2, ""), (3, " "), (4, "▁a b"), (5, "a\x00b\r\n\t  c  "), (6, "<|endoftext|> </s> <s> <unk> <0x41>"), (None, "no id"),
    (7, "😀漢字 é é ﻿ x"), (8, "  lead"), (9, " " * 3000 + "x"), (10, "ﬁ ½ Å   z"), (10, "ﬁ ½ Å   z"), (11, "x" * 51 + " " * (alignment.FAST_CHARS + 5) + "y"),
]


def test_alignment_edges(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("x") for c in ("row", "pairs", "n", "groups", "best", "n_a")})
    assert aligned(clashing) == plain_alignment(ODD)
    assert aligned(docs.limit(0)) == []


def test_alignment_digest_is_of_the_groups(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    written = {tuple(r[:5]): r.groups for r in alignment.align(docs).collect()}
    hashed = {tuple(r[:5]): r.groups for r in alignment.align(docs, hashed=True).collect()}
    assert hashed == {k: g and hashlib.sha256(g.encode()).hexdigest() for k, g in written.items()}
