"""Phrases against counting in Python, with slices, summaries and bitmaps made small."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import phrases


def counted(rows, longest, threshold, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    out = []
    for p, a in found.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q))) and 100 * b >= share * a for q, b in found.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(o[0], i, *o[1:]) for i, o in enumerate(own, 1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    words = np.array([*"abcdefgh", "Ä", "ß", "it's", "Æ-z"])
    seps = np.array([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"])
    texts = [(str(r.choice(["en", "de"])), "".join(w + s for w, s in zip(r.choice(words, 60), r.choice(seps, 60), strict=True))) for _ in range(60)]
    return [*texts, *texts[:3], (None, "x y z. " * 30), ("und", "x Y z, x y"), ("en", None), ("en", ""), ("fr", " ,\t. "), (None, None), ("es", "very long " * 3000), ("es", "w" * 9000 + " a b " * 12)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_brute_force(spark, rows, monkeypatch, longest):
    monkeypatch.setattr(phrases, "BITS_MOST", 1 << 11)
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, size int, phrase string").repartition(4)
    got = phrases.collocations(docs, longest=longest, threshold=10, share=50, top=40)
    assert [c for c, _ in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == counted(rows, longest, 10, 50, 40)


@pytest.mark.parametrize("size", [1, 7, 40, 700])
def test_slices_lose_and_repeat_nothing(rows, monkeypatch, size):
    """In this process, so that the bound holds: n-grams of small slices are those of the texts taken whole."""
    batch = pa.record_batch([pa.array([lang or "und" for lang, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])

    def grams():
        out = Counter()
        for words, langs in phrases.slices(iter([batch.slice(2, 20), batch.slice(22)]), 2):
            text = words.distinct.to_pylist()
            places = {1: np.arange(words.own)} | {n: words.starts(n) for n, _ in words.hashes(3, langs)}
            for n, at in places.items():
                out.update((langs[words.lang[i]], *(text[words.code[i + k]] for k in range(n))) for i in at.tolist())
        return out

    whole = grams()
    monkeypatch.setattr(phrases, "SLICE", size)
    assert grams() == whole and sum(whole.values()) > 10_000


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_products_pass_64_bits(spark):
    """The score's arithmetic, on counts no test can hold: the expression of the operator over large longs."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    row = spark.range(1).select(F.expr(f"({wide('9000000000000L')} * {wide('9000000000000L')} * 1000000) DIV ({wide('9000000000001L')} * {wide('9100000000000L')})")).first()
    assert row[0] == 1_000_000 * 9_000_000_000_000**2 // (9_000_000_000_001 * 9_100_000_000_000)


@pytest.mark.parametrize("capacity", [1, 7, 60])
def test_summary_keeps_what_is_frequent(capacity):
    r = np.random.default_rng(capacity)
    stream = np.concatenate([r.integers(0, 1000, 3000), np.repeat(np.arange(5), 700)])
    r.shuffle(stream)
    summary = phrases.Summary(capacity)
    for part in np.array_split(stream, 23):
        keys, counts = np.unique(part.astype(np.uint32), return_counts=True)
        summary.merge(keys, counts)
    summary.shrink()
    truth = Counter(stream.tolist())
    assert len(summary.keys) <= capacity and summary.lost * (capacity + 1) <= len(stream)
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert all(n - summary.lost <= held.get(k, 0) <= n for k, n in truth.items())
    threshold = len(stream) // capacity + 1
    assert {k for k, n in truth.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())
