"""Benchmark decontamination: exact containment of item windows by a prefix-filtered join.

A window is 13 consecutive words of an item (the whole item if it is shorter). Containment needs every shingle of a window, so
any one of them is a necessary prefix: the rarest by its count over all documents is looked up in the documents. Each
match fixes where the window would start; places before the document's first word or beyond its last are out of bounds,
and the rest is verified word by word over the whole window.

The benchmark side is collected in blocks of at most BLOCK windows, one block at a time; a benchmark of several blocks takes
as many rounds over the documents, which carry what was found so far. Documents are never shuffled.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A null or empty text has no words; an
item without words has no window. A null item_id counts as an empty one; items of equal id and windows of equal words
count once. Repeated documents are judged alike. Empty tables: no rows, or documents without hits.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import slices
from tapeloom.session import cut_lineage

WINDOW = 13
SHINGLE = 3
BLOCK = 100_000
#: ASCII bytes that are no digit or letter split words; capitals become small.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FOUND = "n_words long, n_hit long, spans array<struct<start:int,stop:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_SPLIT).split() if text else []


def windows_table(items: DataFrame, size: int) -> DataFrame:
    """(words, items): each distinct window with the ids of its items, numbered by ``w``."""
    def cut(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                words = words_of(text)
                rows += {(item, b" ".join(words[i:i + size]).decode()) for i in range(max(1, len(words) - size + 1)) if words}
            yield pd.DataFrame(rows, columns=["item", "words"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInPandas(cut, "item string, words string")
    return cut_lineage(rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("w", F.monotonically_increasing_id()))


class Index:
    """Windows of one block as word numbers."""

    def __init__(self, rows: list, size: int) -> None:
        import numpy as np

        split = [r.words.encode().split() for r in rows]
        self.number: dict[bytes, int] = {}
        for ws in split:
            for w in ws:
                self.number.setdefault(w, len(self.number))
        self.items = [list(r.items_) for r in rows]
        self.length = np.array([len(ws) for ws in split], np.int64)
        self.words = np.full((len(rows), size), -2, np.int64)
        for i, ws in enumerate(split):
            self.words[i, : len(ws)] = [self.number[w] for w in ws]
        self.base = max(2, len(self.number))
        self.size = size
        #: by shingle length: the sorted shingle numbers of all windows
        self.shingles = {s: np.unique(np.concatenate([self.keys(self.words[i, :n], s) for i, n in enumerate(self.length) if min(SHINGLE, n) == s])) for s in sorted({min(SHINGLE, int(n)) for n in self.length})}

    def numbers(self, words: list[bytes]):
        import numpy as np

        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int64)

    def keys(self, ids, s: int):
        """Number of the shingle at each place; negative where a word is unknown."""
        import numpy as np

        n = len(ids) - s + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key, known = ids[:n].copy(), ids[:n] >= 0
        for j in range(1, s):
            key = key * self.base + ids[j:j + n]
            known &= ids[j:j + n] >= 0
        key[~known] = -1
        return key

    def order_by(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle as its prefix."""
        import numpy as np

        chosen: dict[int, list[tuple[int, int, int]]] = {s: [] for s in self.shingles}
        for w, n in enumerate(self.length):
            s = min(SHINGLE, int(n))
            keys = self.keys(self.words[w, :n], s).tolist()
            at = min(range(len(keys)), key=lambda i: (counts.get((s, keys[i]), 0), keys[i], i))
            chosen[s].append((keys[at], w, at))
        self.prefix: dict[int, Any] = {}
        for s, rows in chosen.items():
            key, w, at = np.array(sorted(rows), np.int64).T
            keys, first = np.unique(key, return_index=True)
            self.prefix[s] = (keys, np.append(first, len(key)), w, at)

    def find(self, ids) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of a document, the items found, and the number of hit words."""
        import numpy as np

        cover, met = None, set()
        for s, (keys, first, w, at) in self.prefix.items():
            here = self.keys(ids, s)
            place = np.searchsorted(keys, here)
            hit = np.flatnonzero((place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == here))
            if not len(hit):
                continue
            k = place[hit]
            many = first[k + 1] - first[k]
            row = np.repeat(first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            window, start = w[row], np.repeat(hit, many) - at[row]
            n = self.length[window]
            inside = (start >= 0) & (start + n <= len(ids))
            window, start, n = window[inside], start[inside], n[inside]
            j = np.arange(self.size)
            same = (ids[np.minimum(start[:, None] + j, len(ids) - 1)] == self.words[window]) | (j >= n[:, None])
            real = same.all(axis=1)
            if real.any():
                if cover is None:
                    cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, start[real], 1)
                np.add.at(cover, start[real] + n[real], -1)
                met.update(np.unique(window[real]).tolist())
        if cover is None:
            return [], set(), 0
        on = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(on))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist())), {x for m in met for x in self.items[m]}, int(on.sum())


def find(docs: DataFrame, items: DataFrame, keep: list[str], found: str = "found", size: int = WINDOW) -> DataFrame:
    """The columns ``keep`` of every document and a struct ``found``: words, hit words, hit spans (in words), sorted items."""
    import pyarrow as pa

    spark = docs.sparkSession
    table = windows_table(items, size)
    total = table.count()
    numbered = table.select("words", F.col("items").alias("items_"), "w") if total <= BLOCK else table.select("words", F.col("items").alias("items_"), F.pmod(F.xxhash64("words"), F.lit(-(-2 * total // BLOCK))).alias("w"))
    blocks = [None] if total <= BLOCK else list(range(-(-2 * total // BLOCK)))  # hashing fills blocks by half on average
    carried = "_" + found
    work = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])

    for k, block in enumerate(blocks):
        index = Index((numbered if block is None else numbered.where(F.col("w") == block)).collect(), size)
        shipped = spark.sparkContext.broadcast(index)  # BLOCK windows at most

        def count(batches: Iterator) -> Iterator:
            import numpy as np
            import pandas as pd

            index = shipped.value
            sums = {s: np.zeros(len(keys), np.int64) for s, keys in index.shingles.items()}
            for batch in slices(batches):
                for text in batch.column(0).to_pylist():
                    ids = index.numbers(words_of(text))
                    for s, keys in index.shingles.items():
                        here = index.keys(ids, s)
                        here = here[here >= 0]
                        place = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                        sums[s] += np.bincount(place[keys[place] == here], minlength=len(keys))
            for s, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"s": np.full(len(some), s, np.int64), "key": index.shingles[s][some], "n": n[some]}), preserve_index=False)

        counts = work.select("text").mapInArrow(count, "s long, key long, n long").groupBy("s", "key").agg(F.sum("n").alias("n")) if index.length.size else None
        index.order_by({(r.s, r.key): r.n for r in counts.collect()} if counts is not None else {})
        ordered = spark.sparkContext.broadcast(index)
        final = k == len(blocks) - 1

        def look(batches: Iterator, ordered=ordered, k=k) -> Iterator:
            index = ordered.value
            for batch in slices(batches):
                before = batch.column(carried).to_pylist() if k else []
                out = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    words = words_of(text)
                    spans, names, hit = index.find(index.numbers(words)) if words and index.length.size else ([], set(), 0)
                    if k and before[i]["spans"]:
                        at = {x for a, b in [*spans, *((s["start"], s["stop"]) for s in before[i]["spans"])] for x in range(a, b)}
                        edges = sorted(x for x in at if x - 1 not in at), sorted(x + 1 for x in at if x + 1 not in at)
                        spans, names, hit = list(zip(*edges)), names | set(before[i]["items"]), len(at)
                    out.append({"n_words": len(words), "n_hit": hit, "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(names)})
                columns = [batch.column(c) for c in batch.schema.names if c != carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], [*(c for c in batch.schema.names if c != carried), carried])

        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name != carried)
        work = work.mapInArrow(look, f"{shape}, `{carried}` struct<{', '.join(':'.join(x.split(' ', 1)) for x in FOUND.split(', '))}>")
        if not final:
            work = cut_lineage(work)
    return work.select(*keep, F.col(carried).alias(found))
