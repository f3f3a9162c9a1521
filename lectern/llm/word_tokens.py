"""Token ids of the word-level BPE, by the tokenizers library, each distinct word once.

The library encodes a text word by word: it normalises, splits into words and merges inside each word. Words repeat, so
a worker gives the library every distinct word once and looks the rest up. Texts with characters for which Python and the library might differ (see PLAIN), or that spell one of the
added tokens, go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Characters whose normalisation and classes are the same for Python and the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ɏ]*")
#: The words of the vocabulary file's splitting pattern that aren't runs of letters, over lower-cased plain text.
OTHERS = r"('s|'t|'re|'ve|'m|'ll|'d|\d|[^\p{L}\d\s]+)"
#: Distinct words that a worker remembers (later ones are encoded again), and characters taken together.
REMEMBERED = 400_000
TOGETHER = 4_000_000


class WordTokens:
    def __init__(self, path: str, end_id: int | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        self.words: dict[str, bytes] = {}
        self.remembered = remembered

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Have the library encode words, a thousand in one text."""
        out = {}
        for at in range(0, len(words), 1000):
            chunk = words[at : at + 1000]
            e = self.tokenizer.encode(" ".join(chunk), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if of.size == 0 or of[-1] != len(chunk) - 1:  # the library splits them otherwise: one by one
                out |= {w: self._whole(w) for w in chunk}
                continue
            raw, cut = np.array(e.ids, np.uint32).tobytes(), (4 * np.searchsorted(of, np.arange(len(chunk) + 1))).tolist()
            out |= {w: raw[x:y] for w, x, y in zip(chunk, cut[:-1], cut[1:], strict=True)}
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, null as empty, with the end id if there is one; some TOGETHER characters at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        low = [(t or "").lower() for t in texts]
        plain = [PLAIN.fullmatch(t or "") is not None and not any(a in x for a in self.added) for t, x in zip(texts, low, strict=True)]
        # Arrow splits the plain texts and numbers their distinct words; only these are looked up one by one
        apart = pc.replace_substring_regex(pa.array([x if p else "" for x, p in zip(low, plain, strict=True)], pa.string()), OTHERS, r" \1 ")
        words = pc.ascii_split_whitespace(apart)
        bounds, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids = [self.words.get(w) if w else b"" for w in distinct]  # white space at the ends of a text leaves an empty word
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            met = self._learn([distinct[i] for i in missing])
            for i in missing:
                ids[i] = met[distinct[i]]
            if len(self.words) < self.remembered:  # frequent words come early, so the first ones stay
                self.words.update(met)
        flat, sizes = np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) for x in ids], np.int64) // 4
        taken = sizes[which] if len(which) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(taken)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], taken) + np.arange(ends[-1]) if len(which) else taken
        every, cut, tail = flat[at], ends[bounds].tolist(), np.frombuffer(self.tail, np.uint32)
        return [np.concatenate([every[a:b], tail]) if p else np.frombuffer(self._whole(t) + self.tail, np.uint32) for p, t, a, b in zip(plain, texts, cut[:-1], cut[1:], strict=True)]


_CODERS: dict[tuple, WordTokens] = {}


def coder(path: str, end_id: int | None, remembered: int = REMEMBERED) -> WordTokens:
    """One a worker process, so that what a task has learnt serves the next."""
    if (path, end_id) not in _CODERS:
        _CODERS[path, end_id] = WordTokens(path, end_id)
    found = _CODERS[path, end_id]
    found.remembered = remembered
    common.claim(f"words {path} {end_id}", found.words)
    return found
