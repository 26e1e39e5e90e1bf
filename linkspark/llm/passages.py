"""Quality scores by attention over the passages of a text, learned from labels of whole texts.

A text is a bag of passages of ``PASSAGE`` words. Each passage becomes a vector of word buckets and shares, a layer encodes
it, and gated attention weighs the encoded passages of the text; their weighted sum is scored. Only the label of the
text is known, so the weights are learned with everything else, on a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import words
from linkspark.llm.tables import held_out, small_batches, text_slices

#: Words of a passage, and buckets of word hashes.
PASSAGE, BUCKETS = 64, 128
#: The bounded training sample: labelled texts at most, and evenly spread passages of each.
TRAINING_DOCS, TRAINING_PASSAGES = 3000, 24
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 24, 12, 250, 0.01, 1e-4
SHARES = 10


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the first passage of each text; a text without words is one passage of zeros."""
    n = len(offsets) - 1
    at = words.split_words(data, offsets)
    hashes = words.span_hashes(words.running(words.lower_ascii(data)), at.starts, at.ends)
    text, counts = at.text_of(), at.counts
    passages = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)])
    owner = first[text] + (np.arange(len(hashes)) - at.offsets[text]) // PASSAGE
    total = int(first[-1])
    size = np.bincount(owner, minlength=total).astype(np.float32)
    out = np.zeros((total, BUCKETS + SHARES), np.float32)
    bucket = owner * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    out[:, :BUCKETS] = np.bincount(bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(out[:, :BUCKETS] / np.maximum(size, 1)[:, None])

    def of_words(x):
        return np.bincount(owner, weights=x, minlength=total) / np.maximum(size, 1)

    def of_bytes(flag):
        running = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return of_words(running[at.ends] - running[at.starts])

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    keys = words.keyed(hashes, owner)
    different = np.bincount(owner[np.unique(keys, return_index=True)[1]], minlength=total)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A, dtype=np.int64)])
    breaks = np.zeros(len(hashes))
    breaks[1:] = lines[at.starts[1:]] - lines[at.ends[:-1]]
    breaks[at.offsets[:-1][counts > 0]] = 0
    lower = (data | 0x20) - np.uint8(0x61) < 26
    shares = [
        np.log1p(size),
        of_words(at.ends - at.starts),
        np.sqrt(of_bytes((data >= 0x41) & (data <= 0x5A))),
        np.sqrt(of_bytes((data >= 0x30) & (data <= 0x39))),
        np.sqrt(of_bytes(~at.space & ~lower & (data < 0x80))),
        np.sqrt(of_bytes(data >= 0xC0)),
        different / np.maximum(size, 1),
        of_words(same),
        of_words(words.repeated(at, hashes, 5)),
        np.sqrt(of_words(breaks)),
    ]
    out[:, BUCKETS:] = np.stack(shares, axis=1)
    assert len(first) == n + 1
    return out, first


@dataclass
class Model:
    """Gated attention over passages; ``None`` weights if nothing was learned."""

    center: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray] | None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.weights, first[:-1]
        doc = np.repeat(np.arange(len(starts)), np.diff(first))
        h = np.tanh((x - self.center) / self.spread @ w["encode"] + w["shift"])
        t, s = np.tanh(h @ w["value"]), sigmoid(h @ w["gate"])
        e = (t * s) @ w["attend"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "score": sigmoid(z @ w["out"] + w["bias"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, 0.5) if self.weights is None else self.forward(x, first)["score"].astype(float)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(model: Model, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, back from the score to the encoder."""
    w, f = model.weights, model.forward(x, first)
    doc, h, t, s, a = f["doc"], f["h"], f["t"], f["s"], f["a"]
    dy = (f["score"] - label) / len(label)
    dz = (dy[:, None] * w["out"])[doc]
    da = (dz * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[doc])
    gated = de[:, None] * w["attend"]
    dt, ds = gated * s * (1 - t * t), gated * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["value"].T + ds @ w["gate"].T) * (1 - h * h)
    scaled = (x - model.center) / model.spread
    return {
        "encode": scaled.T @ dh, "shift": dh.sum(axis=0), "value": h.T @ dt, "gate": h.T @ ds,
        "attend": (t * s).T @ de, "out": f["z"].T @ dy, "bias": dy.sum(),
    }


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Model:
    """Adam over the whole sample."""
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, None)
    random = np.random.default_rng(7)
    shape = {"encode": (x.shape[1], HIDDEN), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION), "attend": (ATTENTION,), "out": (HIDDEN,)}
    w = {k: random.normal(0, 1 / np.sqrt(v[0]), v).astype(np.float32) for k, v in shape.items()}
    model.weights = w | {"shift": np.zeros(HIDDEN, np.float32), "bias": np.float32(0)}
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        for k, g in gradients(model, x, first, label).items():
            g = g + DECAY * model.weights[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            move = RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            model.weights[k] = (model.weights[k] - move).astype(np.float32)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label: str) -> list:
    """``(label, passages)`` of the labelled training texts with the smallest hashes, in that order."""
    wanted = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAINING_DOCS)
    )

    def run(batches):
        for batch in batches:
            ids, found = batch.column(0), []
            for _, _, data, offsets in text_slices(batch.column(2)):
                x, first = features(data, offsets)
                for i in range(len(first) - 1):
                    part = x[first[i] : first[i + 1]]
                    if len(part) > TRAINING_PASSAGES:
                        part = part[np.linspace(0, len(part) - 1, TRAINING_PASSAGES).astype(int)]
                    found.append(part.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])

    small_batches(docs.sparkSession)
    # at most TRAINING_DOCS rows, so the broadcast is bounded
    some = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "_label", "text")
    rows = some.mapInArrow(run, "doc_id long, label double, x binary").collect()
    return sorted(((r.doc_id, bytes(r.x), r.label) for r in rows), key=lambda r: r[:2])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    sample = training_sample(docs, labels, label)
    width = BUCKETS + SHARES
    if not sample:
        return Model(np.zeros(width), np.ones(width), None)
    parts = [np.frombuffer(x, np.float32).reshape(-1, width) for _, x, _ in sample]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts), first, np.array([y for *_, y in sample], np.float32))


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every whole text. Null and empty texts are scored as one passage without words."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            found = [model.score(*features(d, o)) for _, _, d, o in text_slices(batch.column(len(keep)))]
            if found:
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(np.concatenate(found))], names=[*keep, "score"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]
    return kept.mapInArrow(run, ", ".join([*types, "score double"]))
