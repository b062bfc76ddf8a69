"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is read as UTF-8 bytes in segments of `SEGMENT` bytes, so that many segments advance
together, one matrix product a step. A forward and a backward GRU read each segment; a softmax over
both states labels every position; a document's probabilities are the mean over its positions.
Training is plain backpropagation through time with Adam, on the driver, from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import counted_only, kept, shared_dir, with_text
from tidemark.llm.wordhash import flat, slices

SEGMENT = 64
HIDDEN = 8
PAD = 256
#: Segments that advance together.
TOGETHER = 4096
#: Text bytes taken at a time.
STEP = 2 << 20
#: Parts of a language among which its sample is chosen first.
SALTS = 8


@dataclass
class Model:
    """Parameters by name, and the labels. f* reads forwards, b* backwards; gates stand as reset, update, candidate."""

    labels: list[str]
    p: dict[str, np.ndarray]


def fresh(labels: list[str], seed: int = 0, hidden: int = HIDDEN) -> Model:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[d + "E"] = r.normal(0, 0.3, (257, 3 * hidden))
        p[d + "U"] = r.normal(0, 0.3, (hidden, 3 * hidden))
        p[d + "c"] = np.zeros(hidden)
    p["W"] = r.normal(0, 0.3, (2 * hidden, len(labels)))
    p["b"] = np.zeros(len(labels))
    return Model(labels, {k: v.astype(np.float32) for k, v in p.items()})


def _gru(p: dict, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, hidden, segments) in the order of the text; what the way back needs, if `keep`."""
    steps, n = x.shape
    hidden = len(p[d + "c"])
    table, turn, c = np.ascontiguousarray(p[d + "E"].T), np.ascontiguousarray(p[d + "U"].T), p[d + "c"][:, None]
    h = np.zeros((hidden, n), np.float32)
    out, trace = np.empty((steps, hidden, n), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        e = table.take(x[t], axis=1)
        u = turn @ h
        gates = e[: 2 * hidden]
        gates += u[: 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:hidden], gates[hidden:]
        q = u[2 * hidden :]
        q += c
        candidate = q * r
        candidate += e[2 * hidden :]
        np.tanh(candidate, out=candidate)
        if keep:
            trace.append((t, h, r, z, q, candidate))
        h = candidate + z * (h - candidate)
        out[t] = h
    return out, trace


def _softmax(logit: np.ndarray) -> np.ndarray:
    logit = np.exp(logit - logit.max(axis=-2, keepdims=True))
    return logit / logit.sum(axis=-2, keepdims=True)


def positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (steps, labels, segments) of every position of segments x (steps, segments)."""
    p = model.p
    hidden = len(p["fc"])
    w = p["W"].T
    forward, _ = _gru(p, "f", x, False)
    backward, _ = _gru(p, "b", x, False)
    return _softmax(w[:, :hidden] @ forward + w[:, hidden:] @ backward + p["b"][:, None])


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all real positions of x (steps, segments) with labels y, and its gradients."""
    p, hidden = model.p, len(model.p["fc"])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    states, traces = {}, {}
    for d in "fb":
        states[d], traces[d] = _gru(p, d, x, True)
    both = np.concatenate([states["f"], states["b"]], axis=1)
    prob = _softmax(p["W"].T @ both + p["b"][:, None])
    real = (x != PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    loss = float(-(np.log(prob[:, y, np.arange(x.shape[1])] + 1e-9) * real).sum() / total)
    delta = prob.copy()
    delta[:, y, np.arange(x.shape[1])] -= 1
    delta *= (real / total)[:, None, :]
    g["W"] += np.einsum("thn,tkn->hk", both, delta, optimize=True)
    g["b"] += delta.sum(axis=(0, 2))
    back = p["W"] @ delta
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        dh = np.zeros((hidden, x.shape[1]), np.float32)
        u = p[d + "U"]
        for t, before, r, z, q, cand in reversed(traces[d]):
            dh = dh + back[t, part]
            d_cand = dh * (1 - z) * (1 - cand * cand)
            d_z = dh * (before - cand) * z * (1 - z)
            d_r = d_cand * q * r * (1 - r)
            d_q = d_cand * r
            gates = np.concatenate([d_r, d_z, d_cand])
            np.add.at(g[d + "E"], x[t], gates.T)
            recurrent = np.concatenate([d_r, d_z, d_q])
            g[d + "U"] += before @ recurrent.T
            g[d + "c"] += d_q.sum(axis=1)
            dh = dh * z + u @ recurrent
    return loss, g


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 300, size: int = 192, rate: float = 0.03, seed: int = 0) -> Model:
    """A model fitted to segments x (segments, SEGMENT) with label numbers y."""
    model, r = fresh(labels, seed), np.random.default_rng(seed + 1)
    if len(labels) < 2 or not len(x):
        return model
    m, v = ({k: np.zeros_like(a) for k, a in model.p.items()} for _ in range(2))
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(rows, -(-size // len(labels))) for rows in by_label if len(rows)])
        _, g = gradients(model, np.ascontiguousarray(x[pick].T), y[pick])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / (norm + 1e-9))
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            model.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as segments (segments, SEGMENT), padded at each text's end; and each segment's row."""
    sizes = np.diff(offsets)
    per = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][row] + number * SEGMENT
    at = start[:, None] + np.arange(SEGMENT)
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.zeros((0, SEGMENT), np.int16), row
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), PAD), row


def fit(labelled: DataFrame, rows_per_label: int = 400, segments_per_row: int = 8, most_labels: int = 1000, steps: int = 300) -> Model:
    """A model from `labelled` (doc_id, text, lang).

    The sample: of each language the `rows_per_label` rows with the smallest hash of doc_id and text (equal
    rows count once), and of each of these up to `segments_per_row` segments spread over the whole text.
    Rows with a null lang or a text without a letter are left out. Every language is learned; more than
    `most_labels` of them are an error, as lang is then no language.

    The rows are chosen by (lang, hash) alone, first inside salted parts of each language, so that no
    text is moved for it and a language of most rows is no single task; then the chosen texts are read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                segments, row = cut(*flat(part.column("text")))
                lang = part.column("lang").to_pylist()
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                chosen = [np.unique(np.linspace(a, b - 1, segments_per_row).astype(int)) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                chosen = np.concatenate(chosen) if chosen else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array([lang[row[i]] for i in chosen], pa.string()), pa.array([segments[i].astype(np.int16).tobytes() for i in chosen], pa.binary())], ["lang", "segment"])

    shared_dir(labelled.sparkSession)
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    usable = labelled.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h")
    best = Window.partitionBy("lang").orderBy("h")
    rows = usable.select("lang", "h").withColumn("n", F.row_number().over(salted)).where(F.col("n") <= rows_per_label)
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rows_per_label).select("lang", "h").checkpoint()
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most_labels + 1).collect())
    if len(labels) > most_labels:
        raise ValueError(f"lang has more than {most_labels} values")
    sample = usable.join(F.broadcast(rows.distinct()), ["lang", "h"]).dropDuplicates(["lang", "h"])  # rows_per_label * most_labels ids at most
    got = sample.select("text", "lang").mapInArrow(encode, "lang string, segment binary").toPandas()
    got = got.sort_values(["lang", "segment"])
    x = np.stack([np.frombuffer(s, np.int16) for s in got["segment"]]) if len(got) else np.zeros((0, SEGMENT), np.int16)
    return train(x, got["lang"].map({k: i for i, k in enumerate(labels)}).to_numpy().astype(int), labels, steps)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with lang_pred and score, the pooled probability of that language.

    A text that is null or has no letter gets `und` and score 0, and so does every text if nothing
    was learned. Of equal probabilities the first label in order wins. Kept columns named like a result
    are replaced by it; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep, columns, types = kept(docs, keep, ["lang_pred", "score"])
    columns, words = with_text(docs, keep, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.labels, "und"], object)
        for batch in batches:
            for part in slices(batch, words, STEP):
                text = part.column(words)
                segments, row = cut(*flat(text))
                pooled = np.zeros((part.num_rows, max(1, len(model.labels))))
                for a in range(0, len(segments), TOGETHER) if model.labels else ():
                    x = np.ascontiguousarray(segments[a : a + TOGETHER].T)
                    prob = positions(model, x)
                    prob *= (x != PAD)[:, None, :]
                    np.add.at(pooled, row[a : a + TOGETHER], prob.sum(axis=0).T)
                pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)
                spoken = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                spoken = spoken & bool(model.labels)
                best = np.where(spoken, pooled.argmax(axis=1), len(model.labels))
                score = np.where(spoken, pooled.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f"k{i}") for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(score)], [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"]
                )

    ddl = ", ".join([*([types] if types else []), "lang_pred string, score double"])
    return docs.select(*columns).mapInArrow(counted_only(run), ddl).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
