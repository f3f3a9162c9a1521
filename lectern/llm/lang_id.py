"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a minimal gated unit: one gate both forgets and admits. A network labels every byte of a text from
the states of both directions, and a document's probabilities are the mean over its bytes. It is trained in numpy by
backpropagation through time on a bounded sample of labelled rows; prediction reads whole texts, in windows of WINDOW
bytes that are run side by side.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if there is no
labelled row to learn from; an empty table gives no rows; null and repeated ids stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows are learnt from, in SLICES slices of so many characters each from anywhere in a longer text.
SAMPLE_ROWS, SLICES, SLICE_CHARS = 1500, 4, 250
UNITS, WINDOW, SIDE_BY_SIDE = 8, 256, 1024


class Network:
    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 0):
        r = np.random.default_rng(seed)
        f4 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.labels, self.units = labels, units
        # by direction: what a byte adds to the gate and the candidate, and what the state adds
        self.table = f4(2, 256, 2 * units, scale=0.3)
        self.table[:, :, :units] -= 1.0  # the gate starts rather closed, so that states live long
        self.inner = f4(2, 2 * units, units, scale=0.5 / np.sqrt(units))
        self.out = f4(len(labels), 2 * units, scale=0.5)
        self.bias = np.zeros((len(labels), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias]

    def gradients(self, raw: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time. raw: bytes (time, texts)."""
        steps, n = raw.shape
        u = self.units
        states, kept = [], []
        for d in range(2):
            h = np.zeros((steps + 1, u, n), np.float32)
            own = []
            for t in range(steps):
                x = self.table[d][raw[t if d == 0 else steps - 1 - t]].T
                z = self.inner[d] @ h[t]
                gate = 1 / (1 + np.exp(-(x[:u] + z[:u])))
                new = np.tanh(x[u:] + gate * z[u:])
                h[t + 1] = h[t] + gate * (new - h[t])
                own.append((gate, new, z[u:]))
            states.append(h)
            kept.append(own)
        both = np.concatenate([states[0][1:], states[1][1:][::-1]], axis=1)
        logits = np.einsum("cu,tun->tcn", self.out, both) + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        right = p[:, label, np.arange(n)]
        loss = float(-np.log(np.maximum(right, 1e-9)).mean())
        p[:, label, np.arange(n)] -= 1
        p /= steps * n
        g_out = np.einsum("tcn,tun->cu", p, both)
        g_bias = p.sum((0, 2))[:, None]
        d_both = np.einsum("cu,tcn->tun", self.out, p)
        g_table, g_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        for d in range(2):
            h, dh = states[d], np.zeros((u, n), np.float32)
            outer = d_both[:, :u] if d == 0 else d_both[::-1, u:]
            for t in range(steps - 1, -1, -1):
                gate, new, zn = kept[d][t]
                dh = dh + outer[t]
                d_new = dh * gate * (1 - new * new)
                d_gate = (dh * (new - h[t]) + d_new * zn) * gate * (1 - gate)
                dz = np.concatenate([d_gate, d_new * gate])
                g_inner[d] += dz @ h[t].T
                np.add.at(g_table[d], raw[t if d == 0 else steps - 1 - t], np.concatenate([d_gate, d_new]).T)
                dh = dh * (1 - gate) + self.inner[d].T @ dz
        return loss, [g_table, g_inner, g_out, g_bias]

    def train(self, texts: list[bytes], labels: list[int], rounds: int = 250, batch: int = 128, steps: int = 64, seed: int = 1) -> None:
        """Adam over random slices, every label drawn alike."""
        r = np.random.default_rng(seed)
        of = [[i for i, y in enumerate(labels) if y == c] for c in range(len(self.labels))]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for k in range(1, rounds + 1):
            raw, y = np.zeros((steps, batch), np.uint8), r.integers(0, len(of), batch)
            for j in range(batch):
                text = texts[of[y[j]][r.integers(len(of[y[j]]))]]
                a = int(r.integers(0, max(1, len(text) - steps + 1)))
                piece = text[a : a + steps]
                raw[:, j] = np.frombuffer((piece * (steps // len(piece) + 1))[:steps], np.uint8)
            _, grads = self.gradients(raw, y)
            rate = 0.03 * min(1, 2 * (1 - k / (rounds + 1)))
            for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        """(time, labels, texts) for bytes (time, texts)."""
        steps, n = raw.shape
        u = self.units
        both = np.empty((steps, 2 * u, n), np.float32)
        half = np.concatenate([np.full(u, 0.5, np.float32), np.ones(u, np.float32)])  # a logistic gate is a scaled tanh
        for d in range(2):
            table, inner = np.ascontiguousarray((self.table[d] * half).T), self.inner[d] * half[:, None]
            h = np.zeros((u, n), np.float32)
            x, z = np.empty((2 * u, n), np.float32), np.empty((2 * u, n), np.float32)
            gate, new = x[:u], z[u:]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table, raw[t], axis=1, out=x, mode="clip")
                np.matmul(inner, h, out=z)
                gate += z[:u]
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                new *= gate
                new += x[u:]
                np.tanh(new, out=new)
                new -= h
                new *= gate
                h += new
                both[t, u * d : u * d + u] = h
        logits = np.matmul(self.out, both)
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text: (texts, labels). Empty texts: zeros."""
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // WINDOW)
        total, first = int(parts.sum()), np.cumsum(parts) - parts
        out = np.zeros((len(texts), len(self.labels)))
        if not total:
            return out
        flat = np.frombuffer(b"".join([t.ljust(WINDOW * p, b" ") for t, p in zip(texts, parts.tolist(), strict=True)]), np.uint8).reshape(total, WINDOW)
        last = np.full(total, WINDOW)
        last[(first + parts - 1)[parts > 0]] = (sizes - WINDOW * (parts - 1))[parts > 0]
        sums = np.zeros((total, len(self.labels)))
        order = np.argsort(-last, kind="stable")  # windows of like length side by side: short ones end early
        for a in range(0, total, SIDE_BY_SIDE):
            w = order[a : a + SIDE_BY_SIDE]
            steps = int(last[w].max())
            raw = np.ascontiguousarray(flat[w, :steps].T)
            p = self.probabilities(raw)
            if last[w[-1]] < steps:
                p *= (np.arange(steps)[:, None] < last[w])[:, None, :]
            sums[w] = p.sum(0).T
        of = np.repeat(np.arange(len(texts)), parts)
        np.add.at(out, of, sums)
        return out / np.maximum(sizes, 1)[:, None]

    def label_positions(self, text: bytes) -> list[tuple[int, int, str]]:
        """Runs (first byte, end, label) of a text's bytes."""
        if not text:
            return []
        best = self.probabilities(np.frombuffer(text, np.uint8)[:, None])[:, :, 0].argmax(1)
        cut = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(text)]
        return [(a, b, self.labels[best[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, slices: int = SLICES, slice_chars: int = SLICE_CHARS) -> Network | None:
    """A network from at most sample_rows rows for which `labelled` holds, drawn by a hash of the id; None without any.

    Of a text longer than slices * slice_chars so many slices of so many characters are learnt from, from anywhere in it.
    """
    rows = docs.where(labelled & F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    text, size = F.col(text_col).cast("string"), F.length(text_col)
    start = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(size - slice_chars, F.lit(0)) + 1).cast("int") + 1
    some = F.concat_ws(" ", *[F.substr(text, start(k), F.lit(slice_chars)) for k in range(slices)])
    body = F.when(size <= slices * slice_chars, text).otherwise(some)
    rows = rows.select(F.xxhash64(F.col(id_col), text).alias("draw"), F.col(label_col).cast("string").alias("label"), body.alias("body"))
    # a bound on the draw instead of a sort: about a quarter more than needed comes, repeated rows once
    share = min(1.0, 1.25 * sample_rows / max(1, rows.count()))
    sample = rows.where(F.col("draw") <= F.lit(int(2**64 * share - 2**63) - (share == 1.0))).distinct().collect()
    sample = sorted(sample, key=lambda r: (r["draw"], r["label"], r["body"]))[:sample_rows]
    labels = sorted({r["label"] for r in sample})
    if not labels:
        return None
    network = Network(labels)
    network.train([r["body"].encode() for r in sample], [labels.index(r["label"]) for r in sample])
    return network


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        common.claim("language")
        known = [t.encode() if isinstance(t, str) and any(map(str.isalpha, t)) else b"" for t in texts]
        if network is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(known), "score": [0.0] * len(known)})
        p = network.pool(known)
        best = p.argmax(1)
        return pd.DataFrame({"lang_pred": [network.labels[b] if t else "und" for b, t in zip(best, known, strict=True)], "score": np.where([len(t) > 0 for t in known], np.clip(p.max(1), 0, 1), 0.0)})

    found = common.fresh("identified", docs.columns)
    return docs.withColumn(found, identify(F.col(text_col).cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], f"{found}.lang_pred", f"{found}.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score. Learns from rows that aren't held out."""
    out = common.held_out(F.col(id_col))
    network = fit(docs, ~out, id_col, text_col, label_col)
    return predict(docs.select(F.col(id_col), F.col(text_col)), network, text_col).select(F.col(id_col).cast("long").alias(id_col), out.alias("held_out"), "lang_pred", "score")
