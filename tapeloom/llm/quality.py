"""Quality score by a regularised quadratic discriminant over document statistics.

Each text becomes a few statistics (sizes, shares of kinds of characters, repetition of words and lines), transformed so that
classes look roughly normal. Class means and covariances come from sums over all labelled training rows, each covariance is
shrunk towards the pooled one and its diagonal, and a document's score is the posterior of the difference of the two
log densities, with Mahalanobis distances through the Cholesky factors that are worked out once.

Nulls: a null text is an empty one, and both have a score; labels that are null or neither 0 nor 1 aren't learned from, nor
rows with a null doc_id. Repeated rows count and are scored as often as they stand. With labels of one class the score is that
class; without labels it is 0.5. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.llm.common import slices
from tapeloom.session import cut_lineage

STATISTICS = (
    "log_bytes", "word_length", "word_length_spread", "capitals", "marks", "symbols", "digits", "beyond_ascii",
    "lines_per_word", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "short_words",
)
#: How far a class covariance goes to the pooled one, and the pooled one to its diagonal; a ridge in units of the variance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.15, 0.1, 1e-3


def statistics(text: str | None) -> list[float]:
    import math
    from collections import Counter
    from operator import eq

    import numpy as np

    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    big, small, digits = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    beyond, blank = int(by[128:].sum()), int(by[9:14].sum() + by[32])
    marks = int(by[44] + by[46] + by[59] + by[58] + by[39] + by[45])
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    counts = Counter(words)
    root = lambda share: math.sqrt(max(0.0, share))
    return [
        math.log1p(len(raw)), math.log1p(lengths.mean() if len(words) else 0.0), math.log1p(lengths.std() if len(words) else 0.0),
        root(big / max(1, big + small)), root(marks / size), root((len(raw) - big - small - digits - beyond - blank - marks) / size), root(digits / size), root(beyond / size),
        root(len(lines) / n), len(counts) / n ** 0.8, root(max(counts.values(), default=0) / n), root(sum(map(eq, words, words[1:])) / n),
        root(1 - len(set(lines)) / max(1, len(lines))), root(int((lengths <= 3).sum()) / n),
    ]


@dataclass
class Discriminant:
    """Class densities with their Cholesky factors; ``score`` is the probability of class 1."""

    means: Any = None
    factors: Any = None
    offsets: Any = None
    fixed: float | None = None

    def score(self, x):
        import numpy as np

        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T)  # lower triangular
            logs.append(offset - 0.5 * (z ** 2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(sums: dict[int, tuple[float, Any, Any]]) -> Discriminant:
    """From count, sum and sum of outer products of each class."""
    import numpy as np

    seen = [c for c in (0, 1) if c in sums and sums[c][0] > 0]
    if len(seen) < 2:
        return Discriminant(fixed=float(seen[0]) if seen else 0.5)
    n = np.array([sums[c][0] for c in (0, 1)])
    means = [sums[c][1] / sums[c][0] for c in (0, 1)]
    covs = [sums[c][2] / sums[c][0] - np.outer(m, m) for c, m in zip((0, 1), means)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    centre = (n[0] * means[0] + n[1] * means[1]) / n.sum()
    scale = np.maximum(np.diag(pooled) + (n[0] * (means[0] - centre) ** 2 + n[1] * (means[1] - centre) ** 2) / n.sum(), 1e-9)
    calm = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    factors = [np.linalg.cholesky((1 - TO_POOLED) * s + TO_POOLED * calm + RIDGE * np.diag(scale)) for s in covs]
    offsets = [np.log(k / n.sum()) - np.log(np.diag(f)).sum() for k, f in zip(n, factors)]
    return Discriminant(means, factors, offsets)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every whole text."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def learn(x: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """Fit on the labelled rows of measured documents; sums are added up in Spark, a few hundred numbers reach the driver."""
    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        sums: dict[int, Any] = {}
        for frame in batches:
            for c, rows in frame.groupby("c"):
                m = np.column_stack([np.ones(len(rows)), np.array(rows["x"].tolist())])
                sums[c] = sums.get(c, 0) + m.T @ m
        yield pd.DataFrame([(int(c), s.ravel().tolist()) for c, s in sums.items()], columns=["c", "m"])

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("c"))
    rows = x.join(known, "doc_id").select("c", "x").mapInPandas(partial, "c int, m array<double>")
    cells = rows.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    import numpy as np

    d = len(STATISTICS) + 1
    sums = {}
    for c in {r.c for r in cells}:
        m = np.zeros(d * d)
        for r in cells:
            if r.c == c:
                m[r.i] = r.v
        m = m.reshape(d, d)
        sums[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return fit(sums)


def score(docs: DataFrame, labels: DataFrame, unseen: Column, label: str = "quality") -> DataFrame:
    """doc_id and score of every document; rows for which ``unseen`` holds (by doc_id) aren't learned from."""
    x = cut_lineage(measured(docs))
    model = learn(x.where(~unseen), labels, label)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in batches:
            rows = np.array(frame["x"].tolist()).reshape(len(frame), len(STATISTICS))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": model.score(rows)})

    return x.mapInPandas(run, "doc_id long, score double")
