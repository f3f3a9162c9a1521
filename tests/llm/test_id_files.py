"""The files of token ids: opened by themselves and decoded; attempts that don't count leave nothing."""

from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

from lectern.llm import simple8b

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_files_by_themselves(spark, tmp_path, monkeypatch):
    texts = [(5, "b b b " * 30), (None, "null id"), (1, "one"), (1, None), (9, "x, y. " * 400), (7, "seven"), *((i, "some words " * 6) for i in range(20, 40))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(simple8b, "SEGMENT_IDS", 20)
    manifest = simple8b.write_ids(docs, WORD, end_id=1, partitions=3, folder=f"{tmp_path}/ids")
    rows = manifest.orderBy("shard", "seq").collect()
    assert sorted({r["file"] for r in rows}) == sorted(str(p) for p in Path(f"{tmp_path}/ids").iterdir()) and len(rows) > 3
    t, got = Tokenizer.from_file(WORD), []
    for path in sorted(Path(f"{tmp_path}/ids").iterdir()):
        raw = path.read_bytes()
        own = [r for r in rows if r["file"] == str(path)]
        assert sum(r["size"] for r in own) == len(raw) and raw[:8] == b"S8BSEG1\0"
        for r in own:
            ids, known, lengths, flat = simple8b.read_segment(raw[r["at"] : r["at"] + r["size"]])
            assert r["n_docs"] == len(ids) and r["n_ids"] == len(flat)
            ends = lengths.cumsum()
            got += [(int(i) if k else None, flat[e - n : e].tolist()) for i, k, n, e in zip(ids, known, lengths, ends, strict=True)]
    want = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    order = [i for i, _ in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert simple8b.read_ids(manifest).count() == len(texts)
