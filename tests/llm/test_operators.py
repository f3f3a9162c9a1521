"""Every operator against brute force on small tables with nulls, ties, repeats, long texts and clashing columns."""

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import byte_bpe, common, exact_dedup, lang_id, packing, passages, repeats, simhash, simple8b, topk, toxicity, word_tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def text_of(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(n))


LONG = text_of(1, 3000)
ROWS = [(0, ""), (1, None), (2, "Hello, it's  ME\n"), (3, LONG), (4, LONG[:9000] + " changed " + LONG[9000:]), (5, LONG), (6, "größe ΑΣ ñ <|endoftext|> don't 12"), (7, text_of(2, 80)), (7, text_of(2, 80)), (None, "Hello, it's  ME\n"), (8, text_of(3, 60) + " " + text_of(2, 80))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", -1, "y") for i, t in ROWS], "doc_id long, text string, h string, row int, node string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def test_exact(docs, empty):
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str)
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        best = max((j for j in same if j is not None), default=None)
        want.append((i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_distinct_documents(docs, empty, parts):
    twice = docs.union(docs).repartition(3)
    got = sorted(((r["doc_id"], r["text"] or "") for r in exact_dedup.distinct_documents(twice, partitions=parts).collect()), key=str)
    want = {}
    for i, t in ROWS:
        best = want.get(t or "")
        want[t or ""] = i if best is None else min(best, i if i is not None else best)
    assert got == sorted(((i, t) for t, i in want.items()), key=str)
    assert exact_dedup.distinct_documents(empty).count() == 0 and exact_dedup.distinct_documents(docs).columns == docs.columns


def test_distinct_documents_with_clashing_names(docs):
    clashing = docs.withColumnsRenamed({"h": "digest", "row": "part", "node": "edge"}).withColumn("best", F.lit(1)).withColumn("_digest", F.lit(2))
    got = exact_dedup.distinct_documents(clashing, partitions=3)
    assert got.columns == clashing.columns
    assert {(r["digest"], r["part"], r["edge"], r["best"], r["_digest"]) for r in got.collect()} == {("x", -1, "y", 1, 2)}


def test_simhash(docs, empty):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[0] == got[1] == 0 and got[3] == got[4] == got[5] == 3 and got[7] == 7 and got[2] == got[None] == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_close_pairs_by_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)), base ^ np.uint64(7)]))
    node = np.sort(r.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), node))
    node, fp = node[order], fp[order]
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(fp, node, 3) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if node[a] == node[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}


def test_busiest_neighbours():
    pairs = [(np.array([0, 1, 2, 2]), np.array([2, 2, 3, 4]))]
    assert simhash.busiest_neighbours(6, lambda: iter(pairs)).tolist() == [2, 2, 0, 2, 2, -1]


def test_copies_of_a_later_original(spark):
    """Copies that are alike to 0.8 only with their original, which isn't the first of them, stay one class."""
    words = text_of(9, 400).split()
    edits = [np.random.default_rng(k).choice(400, 8, replace=False) for k in range(12)]
    copies = [" ".join("changed" if i in set(e.tolist()) else w for i, w in enumerate(words)) for e in edits]
    rows = [*enumerate(copies), (12, " ".join(words))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t in rows]
    assert all(len(s & sets[12]) >= 0.8 * len(s | sets[12]) > 0 for s in sets) and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_similar_documents(docs, empty):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert got[3] == got[4] == got[5] == 3 and got[8] == 8 and got[7] == 7
    assert simhash.similar_documents(empty).count() == 0


@pytest.mark.parametrize("part", [1, 1024])
def test_repeats(docs, empty, monkeypatch, part):
    monkeypatch.setattr(repeats, "PART", part)
    raw = [(i, (t or "").encode()) for i, t in ROWS]
    counts: dict[bytes, int] = {}
    for _, b in raw:
        for k in range(len(b) - 199):
            counts[b[k : k + 200]] = counts.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in raw:
        mark = bytearray(len(b))
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                mark[k : k + 200] = b"\1" * 200
        want.append((i, len(b), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == sorted(want, key=str)
    assert repeats.remove_repeats(empty).count() == 0


def test_passages(docs, empty):
    got = {(r["doc_id"], r["source_doc_id"]) for r in passages.shared_passages(docs).collect()}
    assert {(4, 3), (5, 3), (8, 7)} <= got and not {d for d, _ in got} & {0, 1, 2, 3, 6, None}
    assert passages.shared_passages(empty).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in passages.remove_passages(docs).collect()}
    assert (3, LONG) in kept and (1, None) in kept and (8, text_of(3, 60) + " ") in kept


def test_chains_prefer_order():
    assert passages.chains([0, 10, 20, 30], [5, 15, 2, 35])[0] == [0, 1, 3]
    assert passages.chains([0, 0, 0], [1, 2, 3]) == []


def test_simple8b(docs, empty):
    t, at, want = Tokenizer.from_file(WORD), 0, []
    for i, text in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, simple8b.read_ids(simple8b.write_ids(docs, WORD, 1)).collect()), key=str) == sorted(want, key=str)
    assert simple8b.read_ids(simple8b.write_ids(empty, WORD, 1)).count() == 0


@pytest.mark.parametrize("top", [1, 2**16, 2**33, 2**64])
def test_simple8b_round_trip(top):
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        a = r.integers(0, top, n, dtype=np.uint64, endpoint=False) >> r.integers(0, 64, n).astype(np.uint64)
        offsets, words = simple8b.pack(a)
        assert (simple8b.unpack(n, offsets, words) == a).all()


def test_packing(docs, empty):
    t, rows = Tokenizer.from_file(WORD), packing.pack_documents(docs, WORD, 2).collect()
    spans: dict[int, list] = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= 4096
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ROWS)
    assert sum(r["length"] for r in rows) == want
    assert packing.pack_documents(empty, WORD, 2).count() == 0


@pytest.mark.parametrize("histogram", [{100: 1000}, {10: 100_000}, {3000: 10, 50: 2000}, {4096: 3, 1: 5}, {2049: 7, 2047: 9, 3: 1}, {}])
def test_patterns_hold_every_piece_with_little_padding(histogram):
    found = packing.patterns(histogram, 4096)
    placed: dict[int, int] = {}
    for count, inside in found:
        assert count > 0 and sum(n * t for n, t in inside) <= 4096
        for n, t in inside:
            placed[n] = placed.get(n, 0) + count * t
    assert placed == histogram
    total = sum(n * t for n, t in histogram.items())
    assert sum(c for c, _ in found) <= 1.05 * total / 4096 + 4


def test_packing_pieces(docs):
    """start, ids_crc32 and doc_tokens of every piece, against the library."""
    t = Tokenizer.from_file(WORD)
    want = []
    for i, x in ROWS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, a, min(256, len(ids) - a), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)) for a in range(0, len(ids), 256)]
    got = packing.pack_documents(docs, WORD, 2, size=256).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_words_are_those_of_the_library():
    """Apostrophes, punctuation, digits and letters in any order are cut as the library cuts them."""
    r, t = np.random.default_rng(2), Tokenizer.from_file(WORD)
    texts = ["".join(r.choice(list("ab'stremvld  .,!_19\nÉß×İ"), r.integers(0, 30))) for _ in range(3000)]
    got = word_tokens.WordTokens(WORD, remembered=50).encode_many(texts)
    assert all(x.tolist() == t.encode(y, add_special_tokens=False).ids for x, y in zip(got, texts, strict=True))


def test_byte_bpe(docs, empty):
    ranks = byte_bpe.load_ranks(BYTES)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in ROWS:
        ids = own.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.round_trip(docs, BYTES, public_tokenizers.PATTERN).collect()), key=str) == sorted(want, key=str)
    assert byte_bpe.round_trip(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_topk(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(r.standard_normal(8), 1)]) for i in range(200)] + [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (None, [1.0] * 8)]
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows[:200]}
    want = {(q, k, i, int(s)) for q in v if q % 20 == 0 for k, (s, i) in enumerate(sorted(((-(v[q] @ v[i]), i) for i in v if i != q))[:20], 1) for s in [-s]}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(x) for x in topk.top_k(table).collect()} == want
    assert topk.top_k(table.where("vec_id < 0")).count() == 0
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], table.schema)
    with pytest.raises(ValueError):
        topk.top_k(odd)


@pytest.mark.parametrize("components, fewest", [(1 << 22, 128), (40, 3)])
def test_topk_over_blocks_with_ties_repeated_ids_and_clashing_names(spark, monkeypatch, components, fewest):
    monkeypatch.setattr(topk, "COMPONENTS", components)
    monkeypatch.setattr(topk, "FEWEST", fewest)
    monkeypatch.setattr(topk, "MOST", fewest)
    r = np.random.default_rng(6)
    rows = [(i // 2 * 2, [float(x) for x in r.integers(-3, 4, 5)], 1, 2, 3, "x", "y") for i in range(160)]
    rows += [(400, [0.0] * 5, 1, 2, 3, "x", "y"), (420, [-2.0, 7e3, 0.0, 0.0, 1.0], 1, 2, 3, "x", "y")]
    v = [(i, (64 * np.array(x)).astype(int)) for i, x, *_ in rows]
    want = []
    for q, x in v:
        if q % 20 == 0:
            want += [(q, -s, i) for s, i in sorted((-int(x @ y), i) for i, y in v if i != q)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block long, chunk long, spread long, v string, maps string")
    # an id on two rows asks twice: its rows are ranked together
    expected: dict[int, list] = {}
    for q, s, i in want:
        expected.setdefault(q, []).append((-s, i))
    full = {(q, n, i, -s) for q, found in expected.items() for n, (s, i) in enumerate(sorted(found)[:20], 1)}
    assert {tuple(x) for x in topk.top_k(table).collect()} == full


def test_lang_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.identify(blank).collect()} == {"und"}
    assert lang_id.identify(empty.withColumn("lang", F.lit("en"))).count() == 0


def test_network_gradients():
    n, r = lang_id.Network(["a", "b"], units=3), np.random.default_rng(0)
    raw, y = r.integers(0, 256, (6, 4), dtype=np.uint8), np.array([0, 1, 1, 0])
    for p in n.parameters():
        p[...] = p.astype(np.float32)
    _, grads = n.gradients(raw, y)
    for p, g in zip(n.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up, _ = n.gradients(raw, y)
        p[at] = old - 1e-2
        down, _ = n.gradients(raw, y)
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.02 * abs(g[at]) + 1e-3


def test_toxicity(spark, docs, empty):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.detect(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    assert {r["score"] for r in toxicity.detect(docs, labels.where("1 = 0")).collect()} == {0.0}
    assert toxicity.detect(empty, labels).count() == 0


def test_automaton_is_one_edit():
    a = toxicity.Automaton(["stupid", "idiot", "vile*"])
    assert a.find("stupid") == (0, 0) and a.find("stpid") == (1, 0) and a.find("stupiid") == (1, 0) and a.find("idoit") is None
    assert a.find("idiots") == (1, 1) and a.find("vileness") == (0, 2) and a.find("harmless") is None


def test_pipeline_stages_keep_columns(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == table.columns
        docs = spark.createDataFrame(docs.collect(), table.schema)
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def jaccard_classes(rows, shingle=5, similarity=0.8):
    sets = {i: {tuple(t.lower().split()[k : k + shingle]) for k in range(max(1, len(t.split()) - shingle + 1))} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_similar_documents_of_block_edits(spark):
    """Pairs at 0.80 to 0.87 by truncation, appending and substitution: none is lost."""
    rows, r = [], np.random.default_rng(21)
    for k in range(90):
        words = text_of(500 + k, int(r.integers(150, 400))).split()
        rows.append((2 * k, " ".join(words)))
        n = len(words)
        if k % 3 == 0:
            other = words[: int(np.ceil(n * 0.82))]
        elif k % 3 == 1:
            other = words + text_of(900 + k, int(n * 0.2)).split()
        else:
            other = [text_of(1300 + k, 1) + "x" if i % 47 == 20 else w for i, w in enumerate(words)]
        rows.append((2 * k + 1, " ".join(other)))
    want = jaccard_classes(rows)
    assert sum(i != c for i, c in want.items()) > 75
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == want


def test_similar_documents_of_one_word_set(spark):
    """Texts of one set of words share all fingerprints; their smallest row, which is like none of them, hides no pair."""
    words = text_of(31, 300).split()
    mixed = [words[i] for i in np.random.default_rng(4).permutation(300)]
    moved = words[30:] + words[:30]
    rows = [(0, " ".join(mixed)), (1, " ".join(words)), (2, "  ".join(words).upper()), (3, " ".join(moved))]
    want = jaccard_classes(rows)
    assert want == {0: 0, 1: 1, 2: 1, 3: 1}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == want


def test_repeats_at_chunk_borders(spark):
    """A text of several chunks: each anchor once, and nothing removed that occurs once."""
    text = np.random.default_rng(8).choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), 1_200_000).tobytes()
    one = np.concatenate([place for _, place, _, _ in repeats.Anchors(200).of([text])])
    assert len(np.unique(one)) == len(one) and np.diff(one).max() <= 169
    got = repeats.remove_repeats(spark.createDataFrame([(1, text.decode())], "doc_id long, text string")).first()
    assert got["n_removed"] == 0 and got["n_spans"] == 0


def test_stems_leave_misspellings(spark):
    """Every learnt word of five letters or more is found with one edit in its first letters, whether a stem has it or not."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null")
    rows = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("out"))
    rows = rows.where("toxic = 1").unionByName(rows.where("toxic = 0").orderBy("doc_id").limit(2500)).toPandas()
    learnt, held = rows[~rows["out"]], rows[rows["out"] & (rows["toxic"] == 1)]
    terms = toxicity.lexicon([t[:4000] for t in learnt["text"]], learnt["toxic"].to_numpy())
    model = toxicity.Model(terms)
    words = {w for t in learnt["text"][learnt["toxic"] == 1] for w in toxicity._WORD.findall(t.lower())} & {t for t in terms if len(t) >= 5 and not t.endswith("*")}
    covered = {w for w in words if any(w[:k] + "*" in terms for k in range(3, len(w) + 1))}
    assert len(covered) >= 20
    letter = lambda w: ("x" if w[0] != "x" else "y") + w[1:]
    assert all(model.automaton.find(f(w)) for w in words for f in (letter, lambda w: w[0] + w, lambda w: w[1:]))
    missed = total = 0
    for text in held["text"]:
        found = [w for w in toxicity._WORD.findall(text.lower()) if w in words]
        for w in found:
            total += 1
            missed += model.automaton.find(letter(w)) is None
    assert total >= 20 and not missed


def test_passages_of_many_sources(spark):
    """A verbatim passage is found though each of its five-word strings occurred before in some other document."""
    plain = text_of(71, 50).split()
    decoys = [text_of(700 + i, 30) + " " + " ".join(plain[i : i + 5]) + " " + text_of(800 + i, 30) for i in range(46)]
    rows = [*enumerate(decoys), (46, text_of(72, 40) + " " + " ".join(plain) + " " + text_of(73, 40)), (47, text_of(74, 40) + " " + " ".join(plain) + " " + text_of(75, 40))]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["source_doc_id"], r["source_start"]) for r in found] == [(47, 40, 90, 46, 40)]


def test_passages_by_brute_force(spark):
    """Each string of 50 words that an earlier document has lies in a passage."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    found = {}
    for r in passages.shared_passages(docs).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen, lost = {}, 0
    for row, x in enumerate(docs.select("doc_id", "text").collect()):
        words = (x["text"] or "").encode().lower().split()
        for k in range(len(words) - 49):
            first = seen.setdefault(tuple(words[k : k + 50]), row)
            lost += first != row and not set(range(k, k + 50)) <= found.get(x["doc_id"], set())
    assert not lost


@pytest.mark.parametrize("size, every", [(60, 10), (60, 15), (60, 20), (100, 10)])
def test_edited_passages(spark, size, every):
    """Passages with one word replaced in so many are found, whatever words surround them."""
    rows, r = [], np.random.default_rng(size + every)
    for k in range(60):
        words = text_of(5000 + 7 * k + every, size).split()
        edited = [text_of(9000 + 100 * k + i, 1) + "z" if i % every == every // 2 else w for i, w in enumerate(words)]
        for n, p in enumerate((words, edited)):
            around = [text_of(int(r.integers(20000, 90000)), 40) for _ in range(2)]
            rows.append((2 * k + n, f"{around[0]} {' '.join(p)} {around[1]}"))
    got = {(x["doc_id"], x["source_doc_id"]) for x in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert sum((2 * k + 1, 2 * k) in got for k in range(60)) >= 57


def test_passages_met_by_seeds_among_other_words(spark):
    """Ten words unchanged, three put in, and so on: the only seeds have two or three equal words on either side."""
    r, runs = np.random.default_rng(3), []
    while len(runs) < 5:
        words = [f"r{i}" for i in r.integers(0, 10**6, 10)]
        at = passages.seeds_of(*passages.word_hashes(pa.array([" ".join(words)])))[0].tolist()
        if at and set(at) <= {2, 3}:
            runs.append(words)
    put_in = [w for k, run in enumerate(runs) for w in [*run, *(f"p{3 * k + i}" for i in range(3 if k < 4 else 0))]]
    rows = [(0, f"{text_of(91, 40)} {' '.join(sum(runs, []))} {text_of(92, 40)}"), (1, f"{text_of(93, 40)} {' '.join(put_in)} {text_of(94, 40)}")]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(x["doc_id"], x["start_word"], x["end_word"], x["source_doc_id"], x["source_start"], x["source_end"]) for x in found] == [(1, 40, 102, 0, 40, 90)]


def test_passages_with_few_words_after_an_edit(spark):
    """Every sixth of sixty words is left out, so two words stand after the last edit; without them the copy is too short."""
    rows, seeded = [], []
    for k in range(20):
        words = [f"d{i}" for i in np.random.default_rng(k).integers(0, 10**6, 60)]
        at = passages.seeds_of(*passages.word_hashes(pa.array([" ".join(words)])))[0]
        seeded += [k] * any(i % 6 == 4 for i in at.tolist())
        for n, p in enumerate((words, [w for i, w in enumerate(words) if i % 6 != 3])):
            rows.append((2 * k + n, f"{text_of(3000 + 4 * k + n, 40)} {' '.join(p)} {text_of(3002 + 4 * k + n, 40)}"))
    found = {(x["doc_id"], x["source_doc_id"]) for x in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert len(seeded) > 9 and all((2 * k + 1, 2 * k) in found for k in seeded)


def test_words_have_codes_of_their_own():
    words = [c * n for c in ("a", "b", "é") for n in (1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200)] + ["a" * 64 + "b", "a" * 8 + "b"]
    codes, bounds = passages.word_hashes(pa.array([" ".join(words), None, "", " \t B  b\n", "a" * 200]))
    assert bounds.tolist() == [0, len(words), len(words), len(words), len(words) + 2, len(words) + 3]
    assert len(set(codes[: len(words)].tolist())) == len(set(words))
    assert codes[-3] == codes[-2] == codes[words.index("b")] and codes[-1] == codes[words.index("a" * 200)]


def test_covers_are_chosen_by_whole_rows(spark, monkeypatch):
    """Rows whose chains come in several batches get the cover of all their chains, and nothing is joined for it."""
    r = np.random.default_rng(4)
    chains = [(row, k, 0, [int(a)], [0], [int(n)]) for row in range(40) for k, (a, n) in enumerate(zip(r.integers(0, 300, 30), r.integers(5, 90, 30), strict=True))]
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    common.bound_batches(spark)
    chosen = passages._covering(spark.createDataFrame(chains, "row long, other long, chain int, x array<int>, y array<int>, size array<int>"))
    assert "SortMergeJoin" not in chosen._jdf.queryExecution().toString()
    got = sorted((x["row"], x["from"], -x["to"], x["other"], x["first"], x["x"][0] + x["size"][0]) for x in chosen.collect())
    monkeypatch.undo()
    common.bound_batches(spark)
    assert len(got) == len(chains) and all(-x[2] == x[5] for x in got)
    for row in range(40):
        mine = [x for x in got if x[0] == row]
        assert [i for i, x in enumerate(mine) if x[4]] == passages.least_cover([(x[1], -x[2]) for x in mine])


def test_gaps_are_aligned_by_brute_force():
    @functools.cache
    def best(a, b):
        """Fewest edits and then most words matched, as (edits, -matched)."""
        if not a or not b:
            return len(a) + len(b), 0
        steps = [(best(a[1:], b[1:]), a[0] != b[0], -(a[0] == b[0])), (best(a[1:], b), 1, 0), (best(a, b[1:]), 1, 0)]
        return min((e + x, m + y) for (e, m), x, y in steps)

    r = np.random.default_rng(8)
    for _ in range(300):
        a, b = (r.integers(0, 5, r.integers(0, 9)) for _ in range(2))
        edits, matched = best(tuple(a.tolist()), tuple(b.tolist()))
        assert passages._between(a, b) == (-matched, edits)


@pytest.mark.parametrize("run", [passages.remove_passages, repeats.remove_repeats, simhash.similar_documents])
def test_row_numbers_hold_when_splits_move(spark, tmp_path, monkeypatch, run):
    """Scans of later jobs may be split otherwise: the result stays the same."""
    for k in range(8):
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") % 8 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted(map(str, run(table).collect()))
    old, turn = common.stash, [0]

    def moved(df, *rest):
        out = old(df, *rest)
        turn[0] += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", str((128 << 20, 1 << 16)[turn[0] % 2]))
        spark.conf.set("spark.sql.files.openCostInBytes", str((64 << 20, 1 << 10)[turn[0] % 2]))
        return out

    try:
        monkeypatch.setattr(common, "stash", moved)
        assert sorted(map(str, run(table).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
