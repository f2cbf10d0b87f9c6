"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut into stretches of STRETCH bytes that are run side by side, forwards and backwards from a zero state; every byte
gets label probabilities from both states, and their mean over all bytes of the text is the document's. Training goes
back through time over stretches of a bounded sample: about SAMPLE documents a language, chosen by a hash of doc_id, and
PIECES stretches of each at hashed places.

Nulls: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. Rows with null
lang or doc_id aren't learned from. Repeated rows count and are labelled as often as they stand. An empty table gives no
rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.llm.common import slices

UNKNOWN = "und"
HIDDEN = 8
STRETCH = 128
#: Documents a language, stretches of each, and their bytes for training.
SAMPLE, PIECES, LENGTH = 600, 6, 64
EPOCHS, BATCH, RATE = 8, 256, 0.02
#: Stretches run side by side.
SIDE = 2048


def start(labels: int, seed: int = 7) -> dict[str, Any]:
    """Weights, both directions in the first axis: reset r, update z, candidate n, and the output o."""
    import numpy as np

    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    w = {f"w{g}": draw(2, 256, HIDDEN) for g in "rzn"} | {f"u{g}": draw(2, HIDDEN, HIDDEN) for g in "rzn"}
    return w | {"b": np.zeros((2, HIDDEN), np.float32), "o": draw(2, HIDDEN, labels), "c": np.zeros(labels, np.float32)}


def states(w: dict[str, Any], ids, keep: bool = False):
    """States of both directions at every byte of ``ids`` (bytes by rows), [2, time, row, hidden]; and what training needs."""
    import numpy as np

    time, rows = ids.shape
    out = np.empty((2, time, rows, HIDDEN), np.float32)
    saved = []
    a, b = np.empty((rows, HIDDEN), np.float32), np.empty((rows, HIDDEN), np.float32)
    for d in (0, 1):
        h = np.zeros((rows, HIDDEN), np.float32)
        wr, wz, wn = (w[f"w{g}"][d] for g in "rzn")
        ur, uz, un = (w[f"u{g}"][d] for g in "rzn")
        half = np.float32(0.5)
        wr, wz, ur, uz = wr * half, wz * half, ur * half, uz * half  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        for t in range(time) if d == 0 else range(time - 1, -1, -1):
            x = ids[t]
            r = wr.take(x, axis=0)
            r += np.matmul(h, ur, out=a)
            np.tanh(r, out=r)
            r += 1
            r *= half
            z = wz.take(x, axis=0)
            z += np.matmul(h, uz, out=a)
            np.tanh(z, out=z)
            z += 1
            z *= half
            np.matmul(h, un, out=a)
            a += w["b"][d]
            n = wn.take(x, axis=0)
            n += np.multiply(r, a, out=b)
            np.tanh(n, out=n)
            if keep:
                saved.append((h, r, z, n, a.copy()))
            new = out[d, t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
    return out, saved


def probabilities(w: dict[str, Any], h):
    """Label probabilities at every byte, [time, row, label]."""
    import numpy as np

    y = h[0] @ w["o"][0]
    y += h[1] @ w["o"][1]
    y += w["c"]
    y -= y.max(axis=-1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=-1, keepdims=True)
    return y


def gradients(w: dict[str, Any], ids, labels) -> dict[str, Any]:
    """Of the mean cross-entropy over all bytes, back through time."""
    import numpy as np

    h, saved = states(w, ids, keep=True)
    time, rows = ids.shape
    y = probabilities(w, h)
    y[:, np.arange(rows), labels] -= 1
    y /= time * rows
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["c"] += y.sum(axis=(0, 1))
    for d in (0, 1):
        g["o"][d] = np.tensordot(h[d], y, ((0, 1), (0, 1)))
        into = y @ w["o"][d].T
        flow = np.zeros((rows, HIDDEN), np.float32)
        order = range(time - 1, -1, -1) if d == 0 else range(time)
        for k, t in enumerate(order):
            before, r, z, n, a = saved[d * time + time - 1 - k]
            flow = flow + into[t]
            dn = flow * (1 - z) * (1 - n * n)
            dz = flow * (before - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = dn * r
            for name, v in (("wr", dr), ("wz", dz), ("wn", dn)):
                np.add.at(g[name][d], ids[t], v)
            g["ur"][d] += before.T @ dr
            g["uz"][d] += before.T @ dz
            g["un"][d] += before.T @ da
            g["b"][d] += da.sum(axis=0)
            flow = flow * z + dr @ w["ur"][d].T + dz @ w["uz"][d].T + da @ w["un"][d].T
    return g


def train(ids, labels, count: int, epochs: int = EPOCHS) -> dict[str, Any]:
    """Adam over shuffled batches. ``ids`` is [row, byte]."""
    import numpy as np

    w, rng = start(count), np.random.default_rng(11)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    steps = epochs * -(-len(ids) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            rows = order[at:at + BATCH]
            g = gradients(w, np.ascontiguousarray(ids[rows].T), labels[rows])
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return w


def label(w: dict[str, Any], texts: list[bytes]):
    """Mean label probabilities of each text over all its bytes."""
    import numpy as np

    pooled = np.zeros((len(texts), len(w["c"])))
    waiting: list[tuple[int, bytes]] = []
    space = b" " * STRETCH

    def run() -> None:
        ids = np.frombuffer(b"".join((s + space)[:STRETCH] for _, s in waiting), np.uint8).reshape(len(waiting), STRETCH)
        n = np.array([len(s) for _, s in waiting])
        p = probabilities(w, states(w, np.ascontiguousarray(ids.T))[0])
        p *= (np.arange(STRETCH)[:, None] < n)[:, :, None]
        np.add.at(pooled, [i for i, _ in waiting], p.sum(axis=0))
        waiting.clear()

    for i, raw in enumerate(texts):
        for at in range(0, len(raw), STRETCH):
            waiting.append((i, raw[at:at + STRETCH]))
            if len(waiting) == SIDE:
                run()
    if waiting:
        run()
    return pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-12)


def learn(docs: DataFrame, seen: Column) -> tuple[list[str], dict[str, Any] | None]:
    """The learned languages and the weights, from rows for which ``seen`` holds."""
    import numpy as np

    rows = docs.where(seen & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE / n))))[F.col("lang")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    raw = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - LENGTH + 1, F.lit(1))
    pieces = F.array(*(F.substring(raw, (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(LENGTH)) for k in range(PIECES)))
    sample = rows.where(part < share).select("lang", F.xxhash64("doc_id").alias("h"), F.explode(pieces).alias("piece")).collect()
    sample.sort(key=lambda r: (r.lang, r.h, bytes(r.piece)))
    names = sorted(counts)
    ids = np.frombuffer(b"".join((bytes(r.piece) + b" " * LENGTH)[:LENGTH] for r in sample), np.uint8).reshape(-1, LENGTH)
    labels = np.array([names.index(r.lang) for r in sample], np.int64)
    return names, train(ids, labels, len(names)) if len(ids) else None


def identify(docs: DataFrame, seen: Column, keep: list[str], into: str = "found") -> DataFrame:
    """The columns ``keep`` of every document and a struct ``into`` of lang and score."""
    import pyarrow as pa

    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, seen))
    work = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import regex

        names, w = model.value
        letter = regex.compile(r"\p{L}")
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if w is not None and t and letter.search(t)]
            out: list[dict] = [{"lang": UNKNOWN, "score": 0.0}] * len(texts)
            if known:
                p = label(w, [texts[i].encode() for i in known])
                for i, best, score in zip(known, p.argmax(axis=1), p.max(axis=1)):
                    out[i] = {"lang": names[best], "score": float(np.clip(score, 0, 1))}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "_" + into])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)
    return work.mapInArrow(run, f"{shape}, `_{into}` struct<lang:string,score:double>").select(*keep, F.col("_" + into).alias(into))
