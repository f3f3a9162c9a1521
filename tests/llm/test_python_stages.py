"""No stage of the pipeline runs two Python operators: an executor would keep two workers a core."""

import re

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import common


def python_of_stages(plan: str) -> list[int]:
    """The numbers of Python operators from each of them up to the next exchange, itself included, in a final plan."""
    above, out = [], []  # (depth, Python operators in this stage)
    for line in plan.split("Initial Plan")[0].splitlines():
        found = re.search(r"[A-Z]\w+", line)
        if not found:
            continue
        while above and above[-1][0] >= found.start():
            above.pop()
        n = above[-1][1] if above else 0
        if n is None or found[0] == "EmptyRelation":  # below it is what did not run
            n = None
        elif "Exchange" in found[0]:
            n = 0
        elif re.match("MapIn|ArrowEvalPython|BatchEvalPython|FlatMap", found[0]):
            n += 1
            out.append(n)
        above.append((found.start(), n))
    return out


@pytest.mark.parametrize("stage", ["language", "exact", "near", "passages", "packing"])
def test_one_python_operator_a_stage(spark, monkeypatch, stage):
    r = np.random.default_rng(9)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(2000)]
    texts = [" ".join(r.choice(vocabulary, 200)) for _ in range(40)]
    texts += [" ".join([*t.split()[:195], "zzz", *t.split()[196:]]) for t in texts[:10]]  # near copies
    texts += [" ".join([*t.split()[20:90], *r.choice(vocabulary, 150)]) for t in texts[10:20]]  # passages
    rows = [(i, t, "en", len(t)) for i, t in enumerate(texts)]
    counts, old = [], common.stash

    def look(df):
        df.collect()
        counts.extend(python_of_stages(df._jdf.queryExecution().executedPlan().toString()))

    def watched(df, name, *rest):
        look(df)
        return old(df, name, *rest)

    monkeypatch.setattr(common, "stash", watched)
    look(dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), ""))
    assert counts and max(counts) == 1
