"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads windows of ``WINDOW`` bytes in both directions, each with states of ``HIDDEN`` numbers that start at
zero; a byte enters through a table of gate inputs. Every position gets a softmax over the languages from its two
states, and a document's probabilities are the means over all positions of all its windows. Training
follows the gradient back through time (Adam, cross entropy at each position).

The gates are piecewise linear (``clip(x / 4 + 1 / 2, 0, 1)``) and the candidate state is ``x / (1 + |x|)``.

Fitting sees a bounded sample: at most ``PER_LANGUAGE`` windows of a language and ``MOST_WINDOWS`` in all, one for each chosen
document, documents being chosen and windows placed by hashes of their text. Prediction covers every byte of every document.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .rolling import slices

WINDOW, HIDDEN = 128, 8
PER_LANGUAGE, MOST_WINDOWS, STEPS, BATCH, TRAIN_WIDTH = 600, 40_000, 260, 128, 64
_ROWS = 768  # windows run together
UNDECIDED = "und"


@dataclass
class Network:
    """``table`` (3, 2, 256, h): inputs of the update gate, the reset gate and the candidate, by direction and byte;
    ``u`` (3, 2, h, h): the same from the state; ``v`` (2h, classes) and ``c`` (classes): the output."""

    table: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    names: list[str]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, table=self.table, u=self.u, v=self.v, c=self.c, names=np.array(self.names))
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Network:
        f = np.load(io.BytesIO(data))
        return Network(f["table"], f["u"], f["v"], f["c"], [str(x) for x in f["names"]])


def _states(net: Network, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States (T, B, 2h) for ``codes`` (T, B); ``keep`` gets what the gradient needs."""
    steps, rows = codes.shape
    h = net.u.shape[3]
    out = np.empty((steps, rows, 2 * h), np.float32)
    state = np.zeros((2, rows, h), np.float32)
    x, g = np.empty((3, 2, rows, h), np.float32), np.empty((3, 2, rows, h), np.float32)
    size = np.empty_like(state)
    if keep is not None:
        keep |= {"state": [], "gate": [], "cand": [], "un": []}
    for t in range(steps):
        for k in range(3):
            np.take(net.table[k, 0], codes[t], axis=0, out=x[k, 0], mode="clip")
            np.take(net.table[k, 1], codes[steps - 1 - t], axis=0, out=x[k, 1], mode="clip")
        np.matmul(state, net.u, out=g)
        gate, un, cand = g[:2], g[2], x[2]
        gate += x[:2]
        gate *= 0.25
        gate += 0.5
        np.minimum(gate, 1, out=gate)
        np.maximum(gate, 0, out=gate)
        if keep is not None:
            keep["state"].append(state.copy())
            keep["gate"].append(gate.copy())
            keep["un"].append(un.copy())
        un *= gate[1]
        cand += un
        np.abs(cand, out=size)
        size += 1
        cand /= size
        state -= cand
        state *= gate[0]
        state += cand
        if keep is not None:
            keep["cand"].append(cand.copy())
        out[t, :, :h] = state[0]
        out[steps - 1 - t, :, h:] = state[1]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _gradient(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    keep: dict = {}
    h, (steps, rows) = net.u.shape[3], codes.shape
    states = _states(net, codes, keep)
    p = _softmax(states @ net.v + net.c)
    at = p[:, np.arange(rows), labels]
    loss = float(-np.log(at + 1e-9).mean())
    p[:, np.arange(rows), labels] -= 1
    p /= steps * rows
    dv, dc = states.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1))
    ds = p @ net.v.T
    dtable, du = np.zeros_like(net.table), np.zeros_like(net.u)
    dstate = np.zeros((2, rows, h), np.float32)
    dx = np.empty((steps, 3, 2, rows, h), np.float32)
    ut = np.ascontiguousarray(net.u.transpose(0, 1, 3, 2))
    for t in range(steps - 1, -1, -1):
        state, gate, cand, un = (keep[k][t] for k in ("state", "gate", "cand", "un"))
        dstate[0] += ds[t, :, :h]
        dstate[1] += ds[steps - 1 - t, :, h:]
        own = dx[t]
        own[2] = dstate * (1 - gate[0]) * (1 - np.abs(cand)) ** 2
        own[0] = dstate * (state - cand)
        own[1] = own[2] * un
        own[:2] *= 0.25 * ((gate > 0) & (gate < 1))
        dg = own.copy()
        dg[2] *= gate[1]
        du += state.transpose(0, 2, 1) @ dg
        dstate = dstate * gate[0] + (dg @ ut).sum(axis=0)
    for side in (0, 1):
        code = codes if side == 0 else codes[::-1]
        hot = np.zeros((steps * rows, 256), np.float32)
        hot[np.arange(steps * rows), code.ravel()] = 1
        for k in range(3):
            dtable[k, side] = hot.T @ dx[:, k, side].reshape(-1, h)
    return loss, [dtable, du, dv, dc]


def train(samples: list[tuple[bytes, str]], seed: int = 5, steps: int = STEPS, hidden: int = HIDDEN) -> Network:
    """A network fitted to (window, language) pairs, the same for the same pairs in any order."""
    samples = sorted(set(samples))
    names = sorted({x for _, x in samples})
    rng = np.random.default_rng(seed)
    init = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    net = Network(init(3, 2, 256, hidden, by=0.5), init(3, 2, hidden, hidden, by=0.4), init(2 * hidden, max(1, len(names)), by=0.3), np.zeros(max(1, len(names)), np.float32), names)
    if len(names) < 2:
        return net
    data = np.zeros((len(samples), TRAIN_WIDTH), np.uint8)
    for i, (window, _) in enumerate(samples):
        whole = window * (TRAIN_WIDTH // max(1, len(window)) + 1) if window else b" " * TRAIN_WIDTH
        data[i] = np.frombuffer(whole[:TRAIN_WIDTH], np.uint8)
    labels = np.array([names.index(x) for _, x in samples])
    groups = [np.flatnonzero(labels == k) for k in range(len(names))]
    own = [net.table, net.u, net.v, net.c]
    first, second = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
        _, grads = _gradient(net, np.ascontiguousarray(data[pick].T), labels[pick])
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, s in zip(own, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all positions of each text, in double precision; of an empty text, equal shares."""
    k = net.v.shape[1]
    total = np.zeros((len(texts), k))
    owner = np.repeat(np.arange(len(texts)), [-(-len(x) // WINDOW) for x in texts])
    filled = np.concatenate([np.frombuffer(x + b" " * (-len(x) % WINDOW), np.uint8) for x in texts] or [np.empty(0, np.uint8)])
    windows = filled.reshape(-1, WINDOW)
    first = np.concatenate([[0], np.cumsum([-(-len(x) // WINDOW) for x in texts])])
    sizes = np.array([len(x) for x in texts])
    for a in range(0, len(windows), _ROWS):
        own = owner[a : a + _ROWS]
        p = _softmax(_states(net, np.ascontiguousarray(windows[a : a + _ROWS].T)) @ net.v + net.c)
        last = np.minimum(WINDOW, sizes[own] - (np.arange(a, a + len(own)) - first[own]) * WINDOW)
        for i in np.flatnonzero(last < WINDOW):
            p[last[i] :, i] = 0
        np.add.at(total, own, p.sum(axis=0))
    return np.where(sizes[:, None] > 0, total / np.maximum(1, sizes)[:, None], 1 / k)


_NETWORKS: dict[int, Network] = {}


def _predicting(net: Network):
    """A function from a column of texts to slices of it with their languages and scores."""
    data = net.dump()
    key = zlib.crc32(data)

    def told(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
        if key not in _NETWORKS:
            _NETWORKS.clear()
            _NETWORKS[key] = Network.load(data)
        own = _NETWORKS[key]
        for a, b in slices(column):  # about a megabyte at once
            texts, letters = [], []
            for x in column[a:b].to_pylist():
                letters.append(any(map(str.isalpha, x or "")))
                texts.append(x.encode() if letters[-1] else b"")
            p = probabilities(own, texts)
            known = np.array(letters, bool) & bool(own.names)
            names = [own.names[i] if k else UNDECIDED for i, k in zip(p.argmax(axis=1), known, strict=True)]
            yield a, b, pa.array(names, pa.string()), pa.array(np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0), pa.float64())

    return told


def predict(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or the network knows no language; the first by
    name of equally likely languages. Rows stand alone: repeated rows repeat, no shuffle. A
    column of another name is not read.
    """
    told = _predicting(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, names, scores in told(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], names, scores], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(net: Network, text: Column) -> Column:
    """``struct<lang_pred, score>`` of a text as ``predict`` gives them; the other columns of its row don't leave the JVM."""
    told = _predicting(net)

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [(names, scores) for _, _, names, scores in told(column)]
            names, scores = (pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], t) for i, t in enumerate((pa.string(), pa.float64())))
            yield pa.StructArray.from_arrays([names, scores], ["lang_pred", "score"])

    return run(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(df: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """At most ``per_language`` windows of each language, and fewer of each where those would be more than ``MOST_WINDOWS``.

    Documents come in the order of a hash of their text, equal texts once; the window's place follows from
    that hash. Texts are thinned to about three times what is needed before they are ranked, by the same hash, so a language with
    a third of all rows isn't gathered in one task. The share follows from the number of different texts: copies share a hash.
    More than ``MOST_WINDOWS`` languages are refused: none is left out silently.
    """
    text = F.col(text_col).cast("string")
    rows = df.filter(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    texts = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    n = {r["lang"]: r["texts"] for r in texts.limit(MOST_WINDOWS + 1).collect()}
    if not n:
        return []
    if len(n) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} languages")
    per_language = max(1, min(per_language, MOST_WINDOWS // len(n)))
    shares = F.broadcast(df.sparkSession.createDataFrame([(k, min(1.0, 3 * per_language / c)) for k, c in n.items()], "lang string, share double"))
    share, hashed = F.col("share"), hashed.join(shares, "lang")
    thin = hashed.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - TRAIN_WIDTH)).cast("int") + 1
    windows = thin.select("lang", "h", F.substr("text", place, F.lit(TRAIN_WIDTH)).alias("w")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "w"))
    return [(r["w"].encode(), r["lang"]) for r in windows.withColumn("k", rank).filter(F.col("k") <= per_language).collect()]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network from the labelled rows of ``df``; without any it predicts ``und`` throughout."""
    return train(sample(df, text_col, lang_col))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learnt from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
