"""Seeds that unrelated texts share by chance don't reach the alignment; what goes has no passage."""

import numpy as np
import pyarrow as pa

from lectern.llm import common, passages


def beside(words, at):
    """The codes of a seed at this place of one text."""
    left, right = passages.beside_seeds(words, np.array([0, len(words)]), np.array([at]))
    return left, right


def test_stuck_seeds_are_those_whose_alignment_ends():
    """Texts of few words, edited at random: whatever is stuck gets at most one word further, on either side, and most unrelated texts are."""
    r = np.random.default_rng(3)
    vocabulary = r.integers(0, 2**63, 300, dtype=np.uint64)
    stuck = total = 0
    for n in range(3000):
        words = vocabulary[: (8, 40, 300)[n % 3]]
        seed = r.choice(words, passages.K)
        sides = [r.choice(words, r.integers(0, 40)) for _ in range(2)]
        others = []
        for side in sides:
            if n % 2:  # an edit near the seed
                at, gap = int(r.integers(0, 6)), int(r.integers(0, 9))
                others.append(np.concatenate([side[:at], r.choice(words, r.integers(0, 9)), side[at + gap :]]))
            else:
                others.append(r.choice(words, r.integers(0, 40)))
        a, b = (np.concatenate([x[::-1], seed, y]) for x, y in (sides, others))
        codes = [beside(w, len(x[0])) for w, x in ((a, sides), (b, others))]
        small = [(w >> np.uint64(32)).astype(np.uint32) for w in (a, b)]
        for k in range(2):
            it_is = bool(passages.stuck(codes[0][k], codes[1][k])[0])
            ends = [w[len(x[0]) + passages.K :] if k else w[: len(x[0])][::-1] for w, x in zip(small, (sides, others), strict=True)]
            trace = passages._trace(*ends)
            assert not it_is or not trace or max(trace[-1][:2]) <= 1
            if n % 6 == 2 and min(map(len, ends)) >= 12:
                stuck, total = stuck + it_is, total + 1
    assert total > 100 and stuck > 0.8 * total
    assert not passages.stuck(np.array([-1]), np.array([5]))[0]  # words that aren't known


def chance_rows(r, n):
    vocabulary = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(20)]
    return [(i, " ".join(r.choice(vocabulary, 400))) for i in range(n)]


def test_seeds_shared_by_chance_are_not_aligned(spark, monkeypatch):
    """Of the seeds that unrelated texts share few make a chain that is aligned."""
    matches, aligned, old, linked = [], [], passages._aligned, passages._linked

    def watched(packed, chains, *rest):
        aligned.append(chains.count())
        return old(packed, chains, *rest)

    def counted(*args):
        out = common.stash(linked(*args), "counted")
        matches.append(out.where("kind = 0").count())
        return out

    monkeypatch.setattr(passages, "_aligned", watched)
    monkeypatch.setattr(passages, "_linked", counted)
    rows = chance_rows(np.random.default_rng(8), 240)
    passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).count()
    assert matches[0] > 200 and sum(aligned) < 0.5 * matches[0], (matches, aligned)


def test_passages_among_chance_seeds(spark, monkeypatch):
    """Passages with edits in such texts: the same are found when every chain is aligned."""
    r = np.random.default_rng(11)
    rows = chance_rows(r, 60)
    for i in range(40):
        words = rows[i][1].split()[100:180]
        for at in range(int(r.integers(3, 9)), 80, int(r.integers(6, 20))):
            words[at] = "edit%d" % r.integers(1000)
        rows.append((1000 + i, " ".join([*rows[(i * 7) % 60][1].split()[:90][::-1], *words])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = lambda: {(x["doc_id"], x["source_doc_id"], x["start_word"], x["end_word"]) for x in passages.shared_passages(docs).collect()}
    mine, chained = found(), passages._chained
    monkeypatch.setattr(passages, "_chained", lambda matches: chained(matches.drop("alone").selectExpr("*", "false AS alone")))
    assert len(mine) > 20 and mine == found()


def test_frequent_anchors_of_any_hash(spark):
    """An anchor whose others may be in other tasks stays, be the highest bit of its hash set or not."""
    for h in (5, -5):
        found = spark.createDataFrame([(h, 7, 10, 3 << 32 | 2, 1, 0, 0)], passages._SEEDS)
        got = passages._linked(found, np.array([h], np.int64).view(np.uint64), 12).collect()
        assert [(x["kind"], x["row"], x["x"]) for x in got] == [(1, 10, 3)]


def test_codes_end_with_the_text():
    codes, bounds = passages.word_hashes(pa.array(["a b c d e f g", "h i j k l"]))
    left, right = passages.beside_seeds(codes, bounds, np.array([1, 7]))
    assert left[1] == right[1] == 0 and left[0] >> passages.CODE == 0 == right[0] >> passages.CODE
