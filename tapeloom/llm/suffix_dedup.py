"""Removal of long repeated byte strings by a hash-compared suffix sort.

Every string of ``length`` bytes holds ``gram``-byte strings at length - gram + 1 places; the one with the least hash (leftmost on ties) is its
anchor, so equal strings have equal anchors wherever they stand and only anchors that occur twice can lie in a repeat. Those
are known by a bitmap of hash prefixes (32 MB at most; beyond that it lets more anchors pass, which then drop out); only they are written.
An anchor's context is what strings around it may reach. Contexts that occur twice are repeats in full. Of the others, each
anchor's contexts are sorted twice, by what follows the anchor and by what goes before it, read backwards: mergesort in which
two suffixes are compared through prefix polynomial hashes, a binary search for their common extension and the byte after
it. Neighbours' common extensions are verified on the bytes. From both orders follows, for each string around the anchor,
whether another context has it, and so how far repeats reach on either side.

An anchor with more than TOGETHER different contexts is not sorted in one task: its strings are halved into blocks of start
places instead, whose common core and whole extent are counted by hash; a block is settled if its extent occurs twice or
its core once, else it is halved again down to single strings. Both ways are exact.

Only texts that have places to look up, or repeats to lose, are shuffled; they too are known by a bitmap, of their keys.

Nulls: a null text is an empty one; a null doc_id is carried along. Repeated rows are documents of their own, so all their
strings of ``length`` bytes repeat. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import PIECE, bitmap_of, chosen, slices, within
from tapeloom.session import cut_lineage, discard, last_table

LENGTH, GRAM = 400, 128
TOGETHER = 256
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Start places of strings that a block holds at first.
BLOCK = 64


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def anchors(texts: list[bytes], length: int, gram: int):
    """Row, place, hash and context hash of all anchors of texts of ``length`` bytes or more."""
    import numpy as np

    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    most = length - gram  # bytes before an anchor that its strings may reach
    width = most + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(raw), BASE, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        back = np.cumprod(np.full(len(raw) + 1, pow(BASE, -1, 1 << 64), np.uint64))
        grams = _mix((total[gram:] - total[:-gram]) * back[: len(raw) - gram + 1])
    # the upper half of the hash, ties by place
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full((blocks + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    # strings that lie inside one text
    inside = np.ones(len(raw) - length + 1, bool)
    for s in stop[:-1].tolist():
        inside[max(0, s - length + 1):s] = False
    starts = np.flatnonzero(inside)
    place = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    row = np.searchsorted(stop, place, side="right")
    first = stop[row] - size[row]
    left, right = np.maximum(first, place - most), np.minimum(stop[row], place + length)
    with np.errstate(over="ignore"):
        context = _mix(_mix((total[right] - total[left]) * back[left]) + ((place - left) * (1 << 20) + (right - place)).astype(np.uint64))
    return row, place - first, grams[place].view(np.int64), context.view(np.int64), place - left, right - place


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Documents with a key of two hashes, equal for rows of equal id and text only."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text"), *columns)


def members(docs: DataFrame, length: int, gram: int, known=None) -> DataFrame:
    """(anchor) of all anchors; with ``known``, a broadcast bitmap, (k1, k2, at, anchor, context, before, after) of those in it."""
    names = ["k1", "k2", "at", "anchor", "context", "before", "after"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def several(part: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            row, at, anchor, *rest = anchors([t for *_, t in part], length, gram)
            if known is None:
                return pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
            ok = within(known, anchor)
            keys = np.array([x[:2] for x in part], np.int64)[row[ok]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[:, 0], keys[:, 1], *(c[ok] for c in (at, anchor, *rest)))], names)

        for batch in slices(batches):
            part, size = [], 0
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                raw = text.encode()
                if len(raw) >= length:
                    part.append((k1, k2, raw))
                    size += len(raw)
                if size > PIECE:
                    yield several(part)
                    part, size = [], 0
            if part:
                yield several(part)

    return keyed(docs).mapInArrow(run, "anchor long" if known is None else ", ".join(f"{n} long" for n in names))


class Suffixes:
    """Suffixes of equal start, as rows of bytes with their lengths, compared through prefix hashes."""

    def __init__(self, rows: list[bytes], width: int) -> None:
        import numpy as np

        self.size = np.array([len(r) for r in rows], np.int64)
        self.bytes = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(width, BASE, np.uint64))
            self.hashes = np.zeros((len(rows), width + 1), np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=self.hashes[:, 1:])

    def common(self, a, b):
        """Length of the common extension, by binary search over prefix hashes."""
        import numpy as np

        low, high = np.zeros(a.shape, np.int64), np.minimum(self.size[a], self.size[b])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes[a, mid] == self.hashes[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def verified(self, a, b):
        """The same, checked on the bytes; where a hash has collided, the bytes decide."""
        import numpy as np

        found = self.common(a, b)
        shortest = np.minimum(self.size[a], self.size[b])
        differ = (self.bytes[a] != self.bytes[b]) | (np.arange(self.bytes.shape[1]) >= shortest[:, None])
        real = np.where(differ.any(axis=1), differ.argmax(axis=1), shortest)
        return np.where(found == real, found, real)

    def before(self, a, b):
        """Whether suffix a comes before b; equal suffixes are in no order."""
        import numpy as np

        n = self.common(a, b)
        ends_a, ends_b = n >= self.size[a], n >= self.size[b]
        at = np.minimum(n, self.bytes.shape[1] - 1)
        return np.where(ends_a | ends_b, ends_a & ~ends_b, self.bytes[a, at] < self.bytes[b, at])

    def sort(self, groups):
        """Mergesort of every row of ``groups`` [group, member], a power of two wide, all groups at once."""
        import numpy as np

        order, width = groups.copy(), 1
        while width < order.shape[1]:
            runs = order.reshape(len(order), -1, 2, width)
            a, b = runs[:, :, 0], runs[:, :, 1]
            merged = np.empty_like(runs.reshape(len(order), -1, 2 * width))
            for own, other, equal_first in ((a, b, True), (b, a, False)):
                # rank among the other run, by binary search
                low, high = np.zeros(own.shape, np.int64), np.full(own.shape, width, np.int64)
                while (low < high).any():
                    mid = np.minimum((low + high) // 2, width - 1)
                    there = np.take_along_axis(other, mid, axis=2)
                    goes = (self.before(there.ravel(), own.ravel()) if equal_first else ~self.before(own.ravel(), there.ravel())).reshape(own.shape) & (low < high)
                    low, high = np.where(goes, mid + 1, low), np.where(goes, high, np.minimum(mid, high))
                np.put_along_axis(merged, low + np.arange(width), own, axis=2)
            order = merged.reshape(len(order), -1)
            width *= 2
        return order


def reaches(groups: list[list[tuple[bytes, bytes]]], length: int, most_before: int) -> list[list[tuple[int, int] | None]]:
    """How far repeats reach before and after the anchor, per group of contexts (before, after); None without a repeat."""
    import numpy as np

    out: list[list[tuple[int, int] | None]] = [[None] * len(g) for g in groups]
    by_width: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        by_width.setdefault(1 << max(1, (len(g) - 1).bit_length()), []).append(i)
    for width, chosen in by_width.items():
        for at in range(0, len(chosen), max(1, 4096 // width)):
            part = chosen[at:at + max(1, 4096 // width)]
            rows = [c for i in part for c in [*groups[i], *[(b"", b"")] * (width - len(groups[i]))]]
            table = np.arange(len(rows)).reshape(len(part), width)
            same = []
            for side, most in ((0, most_before), (1, length)):
                suffixes = Suffixes([r[side][::-1] if side == 0 else r[side] for r in rows], most)
                order = suffixes.sort(table)
                common = suffixes.verified(order[:, :-1].ravel(), order[:, 1:].ravel()).reshape(len(part), width - 1)
                # place in order, and the class of suffixes equal in the first so many bytes: one number per member and length
                need = np.arange(most_before + 1) if side == 0 else length - np.arange(most_before + 1)
                classes = np.zeros((len(part), width, len(need)), np.int32)
                np.cumsum(common[:, :, None] < need, axis=1, out=classes[:, 1:])
                member = np.empty_like(classes)
                np.put_along_axis(member, np.broadcast_to((order - table[:, :1])[:, :, None], classes.shape).copy(), classes, axis=1)
                same.append(member)
            key = same[0] * width + same[1]
            order = np.argsort(key, axis=1, kind="stable")
            key = np.take_along_axis(key, order, axis=1)
            twin = key[:, 1:] == key[:, :-1]
            twice = np.zeros(key.shape, bool)
            twice[:, 1:] |= twin
            twice[:, :-1] |= twin
            again = np.empty_like(twice)
            np.put_along_axis(again, order, twice, axis=1)
            some = again.any(axis=2)
            most, least = most_before - again[:, :, ::-1].argmax(axis=2), again.argmax(axis=2)
            for k, i in enumerate(part):
                out[i] = [(int(most[k, m]), length - int(least[k, m])) if some[k, m] else None for m in range(len(groups[i]))]
    return out


REACH = "anchor long, context long, before long, after long"


def sorted_reaches(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Reach of each (anchor, context), from rows with their bytes ``head`` and ``tail``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def some(rows: list[tuple]) -> pa.RecordBatch:
            groups: list[list[tuple]] = []
            for r in rows:
                if not groups or groups[-1][0][0] != r[0]:
                    groups.append([])
                groups[-1].append(r)
            found = reaches([[(r[2], r[3]) for r in g] for g in groups], length, length - gram)
            out = [(r[0], r[1], *reach) for g, rs in zip(groups, found) for r, reach in zip(g, rs) if reach]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], ["anchor", "context", "before", "after"])

        rows: list[tuple] = []
        for batch in slices(batches):
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "head", "tail"))):
                if len(rows) >= 16_384 and rows[-1][0] != r[0]:
                    yield some(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield some(rows)

    return contexts.select("anchor", "context", "head", "tail").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, REACH)


def counted_reaches(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts, by counting hashes of halved blocks; no group meets in one task."""
    def hashes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            cores, extents = [], []
            for head, tail, low, high in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "low", "high"))):
                whole = head + tail
                cut = lambda a, b: hashlib.md5(whole[len(head) - a:len(head) + b]).digest()  # noqa: B023, E731
                fits = low <= len(head) and length - high <= len(tail)
                cores.append(cut(low, length - high) if fits else None)
                extents.append(cut(high, length - low) if high <= len(head) and length - low <= len(tail) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cores, pa.binary()), pa.array(extents, pa.binary())], [*batch.schema.names, "core", "extent"])

    starts = F.array(*(F.lit(x) for x in range(0, length - gram + 1, BLOCK)))
    now = contexts.select("anchor", "context", "head", "tail", F.explode(starts).alias("low")).withColumn("high", F.col("low") + BLOCK - 1)
    shape = "anchor long, context long, head binary, tail binary, low int, high int, core binary, extent binary"
    size, found, read = BLOCK, None, []
    while size:
        whole = cut_lineage(now.mapInArrow(hashes, shape).where("core is not null"))
        discard(*read)
        times = lambda c: whole.where(f"{c} is not null").groupBy("anchor", "low", c).agg(F.count("*").alias(f"n_{c}")).where(f"n_{c} > 1")  # noqa: B023, E731
        rows = whole.join(times("core"), ["anchor", "low", "core"]).join(times("extent"), ["anchor", "low", "extent"], "left")
        rows = cut_lineage(rows.select("anchor", "context", "head", "tail", "low", "high", F.col("n_extent").isNotNull().alias("all")))
        discard(whole)
        done = cut_lineage(rows.where("all").select("anchor", "context", F.col("high").cast("long").alias("before"), (length - F.col("low")).cast("long").alias("after")))
        read = [rows]
        found = done if found is None else found.unionByName(done)
        size //= 2
        if size:
            half = F.explode(F.array(F.col("low"), F.col("low") + size)).alias("low")
            now = rows.where("not all").select("anchor", "context", "head", "tail", half).withColumn("high", F.col("low") + size - 1)
    return found.groupBy("anchor", "context").agg(F.max("before").alias("before"), F.max("after").alias("after"))


def packed(docs: DataFrame, known, *columns: str) -> DataFrame:
    """Keyed documents whose key ``k1`` is in ``known``, a broadcast bitmap, with their text compressed, for shuffles."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in slices(batches):
            batch, press = chosen(batch, known, "k1"), zstandard.ZstdCompressor(level=3)
            texts = pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            at = batch.schema.names.index("text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1:]], batch.schema.names[:at] + ["packed"] + batch.schema.names[at + 1:])

    rows = keyed(docs, *columns)
    shape = ", ".join(f"`{'packed' if i == 2 else f.name}` {'binary' if i == 2 else f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields))
    return rows.mapInArrow(run, shape)


def repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, spans): byte spans of repeated strings, overlapping and in no order, of documents that have any."""
    return last_table(lambda: _spans(docs, length, gram))


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    twice = cut_lineage(members(docs, length, gram).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    known = docs.sparkSession.sparkContext.broadcast(bitmap_of(twice, "anchor"))
    discard(twice)
    again = cut_lineage(members(docs, length, gram, known))
    kinds = cut_lineage(again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"), F.max("before").alias("before"), F.max("after").alias("after")))
    known.unpersist()
    # tables of their own, so that joins have two plain shuffles and hot anchors can be split
    groups = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds"))
    wanted = cut_lineage(kinds.join(groups, "anchor").select("one.*", "anchor", "context", "before", "after", "kinds"))
    asked = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("k1").distinct(), "k1"))
    whole = cut_lineage(kinds.where("n > 1").select("anchor", "context", "before", "after"))
    discard(groups, kinds)
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "anchor", "context", "before", "after", "kinds")).alias("wanted"))  # of one document

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in slices(batches):
            lift, out = zstandard.ZstdDecompressor(), []
            for text, places in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                raw = lift.decompress(text)
                out += [(p["anchor"], p["context"], raw[p["at"] - p["before"]:p["at"]], raw[p["at"]:p["at"] + p["after"]], p["kinds"]) for p in places]
                if len(out) > 20_000:
                    yield table(out)
                    out = []
            yield table(out)

    def table(rows: list[tuple]):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["anchor", "context", "head", "tail", "kinds"])

    # a document that stands in several rows serves once per row; equal rows drop out below
    texts = packed(docs, asked)
    written = cut_lineage(texts.join(lists, ["k1", "k2"]).mapInArrow(fetch, "anchor long, context long, head binary, tail binary, kinds long"))
    discard(wanted)
    contexts = written.withColumn("many", F.col("kinds") > TOGETHER)
    reach = sorted_reaches(contexts.where("not many"), length, gram)
    crowded = contexts.where("many")
    if not crowded.isEmpty():
        reach = reach.unionByName(counted_reaches(crowded.dropDuplicates(["anchor", "context"]), length, gram))
    # a table of its own, so that the join below has two plain shuffles and hot contexts can be split
    reach = cut_lineage(whole.unionByName(reach).groupBy("anchor", "context").agg(F.max("before").alias("to_left"), F.max("after").alias("to_right")))
    discard(written, whole)
    spans = again.select("k1", "k2", "at", "anchor", "context").join(reach, ["anchor", "context"])
    span = F.struct((F.col("at") - F.col("to_left")).alias("start"), (F.col("at") + F.col("to_right")).alias("stop"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))  # of one document


def remove(docs: DataFrame, keep: list[str], found: str = "found", as_text: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The columns ``keep`` and a struct ``found``: n_bytes, removed spans (maximal runs of bytes) and what is kept.

    Strings of ``length`` bytes that recur go; a smaller ``gram`` (at least 16 or so) means fewer anchors, more of which recur by chance.

    What is kept comes as bytes, or as text; characters of which only a part is left are not part of a text.
    """
    import pyarrow as pa

    shown = pa.string() if as_text else pa.binary()
    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", shown)])

    def cut(raw: bytes, spans: list) -> dict:
        runs: list[list[int]] = []
        for a, b in sorted((s["start"], s["stop"]) for s in spans):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        edges = [0, *(x for r in runs for x in r), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return {"n_bytes": len(raw), "spans": [{"start": a, "stop": b} for a, b in runs], "kept": kept.decode(errors="ignore") if as_text else kept}

    def with_found(batch, out: list[dict]):
        columns = [c for c in batch.schema.names if c not in ("k1", "k2", "text", "packed", "spans")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, kind)], [*columns, "_" + found])

    def some(batches: Iterator) -> Iterator:
        import zstandard

        for batch in slices(batches):
            lift = zstandard.ZstdDecompressor()
            yield with_found(batch, [cut(lift.decompress(text), spans or []) for text, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist())])

    def none(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            batch = chosen(batch, known, "k1", there=False)
            yield with_found(batch, [cut(text.encode(), []) for text in batch.column("text").to_pylist()])

    spans = repeats(docs, length, gram)
    known = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans, "k1"))
    renamed = {c: f"_c{i}" for i, c in enumerate(keep)}  # no clash with the key's names
    rows = docs.select(*{"doc_id", "text"} - set(keep), *keep, *(F.col(f"`{c}`").alias(n) for c, n in renamed.items()))
    whole = keyed(rows, *renamed.values())
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields if f.name in renamed.values())
    shape += f", `_{found}` struct<n_bytes:long,spans:array<struct<start:long,stop:long>>,kept:{'string' if as_text else 'binary'}>"
    out = packed(rows, known, *renamed.values()).join(spans, ["k1", "k2"], "left").mapInArrow(some, shape).unionByName(whole.mapInArrow(none, shape))
    return out.select(*(F.col(n).alias(c) for c, n in renamed.items()), F.col("_" + found).alias(found))
