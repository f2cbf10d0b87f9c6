"""Phrases whose words stand together more often than apart, mined by shard (SON) and counted exactly.

Texts are cut into numbered words once and kept as a table. The corpus is dealt into ``SHARDS`` shards, each some of Spark's partitions. A phrase of support s in all of it has support
s / SHARDS or more in one of them at least, whatever their sizes, so each shard is mined completely at that lowered support;
longer phrases only where both their parts are frequent. The union over shards is thinned by the most that a phrase
can reach (what was found, and less than the local support in every shard without it), and then all candidates are counted in
all texts. Mining counts 64-bit hashes, where a collision can only add candidates; the last count is by the words themselves.

Candidates travel as a bitmap of hash prefixes whose size follows from their number and ends at ``MOST_BITS`` (32 MB).
Beyond that more phrases that are none pass it and get counted in vain; results stay exact.

Nulls: a null text is an empty one, a null language ``und``. Texts without words add nothing. Repeated rows count each.
Equal scores go by count, then by phrase in byte order. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.llm.common import slices
from tapeloom.session import cut_lineage, discard

SHARDS = 2
#: Tokens that a task counts at a time.
TOKENS = 2_000_000
MOST_BITS = 28
#: A word, or one character that ends a piece; pieces end with texts.
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
ENDS = (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")


class Block:
    """Some texts of one language as numbers of words; 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.words, self.parts, self.size = lang, dict.fromkeys(ENDS, 0), [], 0

    def add(self, text: str) -> None:
        import numpy as np

        raw = text.encode().lower() + b"\n"  # bytes lower A-Z only
        found = TOKEN.findall(raw) if len(raw) < 1 << 22 else None
        rest = iter(TOKEN.finditer(raw)) if found is None else None
        words = self.words
        while found := found or [m.group() for m in islice(rest or (), 1 << 20)]:  # a long text in parts
            for w in set(found):
                words.setdefault(w, len(words))
            self.parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            self.size += len(found)
            found = None

    def close(self) -> tuple[bytes, bytes]:
        """After the last text: the words by their numbers, and the numbers of the texts, both compressed."""
        import numpy as np
        import zstandard

        names = [b""] * (max(self.words.values()) + 1)
        for w, i in self.words.items():
            names[i] = w
        names[0] = b""
        press = zstandard.ZstdCompressor(level=1)
        return press.compress(b"\n".join(names)), press.compress(np.concatenate(self.parts).tobytes())

    def open(self, words: bytes, at: bytes) -> Block:
        import numpy as np
        import xxhash
        import zstandard

        lift = zstandard.ZstdDecompressor()
        self.names, self.at = lift.decompress(words).split(b"\n"), np.frombuffer(lift.decompress(at), np.int32)
        self.word_hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.names), np.uint64, len(self.names))
        self.start = np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), seed=1))
        return self

    def places(self, n: int):
        """Where phrases of n words start, as a mask."""
        import numpy as np

        ok = np.ones(max(0, len(self.at) - n + 1), bool)
        for i in range(n):
            ok &= self.at[i:i + len(ok)] != 0
        return ok

    def hashes(self, n: int):
        """Hash of the n words at each place, whether they are a phrase or not."""
        import numpy as np

        size = max(0, len(self.at) - n + 1)
        h = np.full(size, self.start, np.uint64)
        for i in range(n):
            h ^= self.word_hashes[self.at[i:i + size]]
            h *= np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio
            h ^= h >> np.uint64(29)
        return h

    def phrases(self, n: int, ok):
        """Distinct phrases of n words at the places of a mask, as rows of word numbers, and their counts."""
        import numpy as np

        parts = [self.at[i:i + len(ok)][ok].astype(np.int64) for i in range(n)]
        bits = 63 // n
        if len(self.names) >= 1 << bits:  # too many words for one number a phrase
            return np.unique(np.stack(parts, 1), axis=0, return_counts=True)
        key = np.zeros(len(parts[0]), np.int64)
        for part in parts:
            key = key << bits | part
        key, counts = np.unique(key, return_counts=True)
        return np.stack([key >> bits * (n - 1 - i) & (1 << bits) - 1 for i in range(n)], 1), counts


def numbered(texts: DataFrame) -> DataFrame:
    """(shard, lang, words, at): the texts (lang, text) cut into words once, in blocks of about ``TOKENS``, for all later counts."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % SHARDS

        def closed() -> Iterator:
            while open_:
                block = open_.popitem()[1]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, block.lang, *block.close()), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["shard", "lang", "words", "at"])

        open_: dict[str, Block] = {}
        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = open_.setdefault(lang, Block(lang))
                before, known = block.size, len(block.words)
                block.add(text)
                size += block.size - before + 4 * (len(block.words) - known)  # a new word takes more than its number
                if size >= TOKENS:
                    yield from closed()
                    size = 0
        yield from closed()

    return texts.mapInArrow(run, "shard int, lang string, words binary, at binary")


def blocks(batches: Iterator) -> Iterator[tuple[int, Block]]:
    """Shards and blocks, one at a time in memory."""
    for batch in batches:
        for shard, lang, words, at in zip(*batch.columns):
            yield shard.as_py(), Block(lang.as_py()).open(words.as_py(), at.as_py())


def inside(bitmap, hashes):
    import numpy as np

    slot = hashes >> np.uint64(64 - bitmap[0])
    return (bitmap[1][(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(mined: DataFrame):
    """Bits of the hash prefixes of candidates: (number of bits as a power of 2, words of 64 bits)."""
    import numpy as np

    bits = min(MOST_BITS, max(16, (32 * mined.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = mined.select(F.shiftrightunsigned(slot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    made = np.zeros(1 << bits - 6, np.int64)
    made[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return bits, made.view(np.uint64)


def mined(cut: DataFrame, n: int, support: int, parts) -> DataFrame:
    """(h) of phrases of n words that can reach the support; ``parts``: the bitmap of shorter ones (a broadcast), or none."""
    local = -(-support // SHARDS)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for shard, block in blocks(batches):
            ok = block.places(n)
            if parts is not None:
                shorter = inside(parts.value, block.hashes(n - 1))
                ok &= shorter[:-1] & shorter[1:]
            h, counts = np.unique(block.hashes(n)[ok], return_counts=True)
            if len(h):
                yield from slices([pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), shard, np.int32)), pa.array(counts)], names=["h", "shard", "n"])], 100_000)

    found = cut.mapInArrow(count, "h long, shard int, n long").groupBy("h", "shard").agg(F.sum("n").alias("n")).where(F.col("n") >= local)
    reach = F.sum("n") + (SHARDS - F.count("*")) * (local - 1)
    return found.groupBy("h").agg(reach.alias("reach")).where(F.col("reach") >= support).select("h")


def counted(cut: DataFrame, bitmaps: dict) -> DataFrame:
    """(lang, k, phrase, a): all words (k = 1) and the candidates of each length, counted by their words in all texts."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for _, block in blocks(batches):
            for k in [1, *bitmaps]:
                ok = block.places(k)
                if k > 1:
                    ok &= inside(bitmaps[k].value, block.hashes(k))
                rows, counts = block.phrases(k, ok)
                names = pa.array([w.decode() for w in block.names], pa.string())
                for at in range(0, len(rows), 100_000):
                    some = rows[at:at + 100_000]
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(some[:, i])) for i in range(k)), " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block.lang), len(some)), pa.repeat(pa.scalar(k, pa.int32()), len(some)), phrase, pa.array(counts[at:at + 100_000])], names=["lang", "k", "phrase", "a"])

    return cut.mapInArrow(count, "lang string, k int, phrase string, a long").groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))


def score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def phrases(docs: DataFrame, support: int = 10, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of 2 to 3 words in ``docs`` (lang, text)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cut = cut_lineage(numbered(texts))
    two = spark.sparkContext.broadcast(bitmap_of(cut_lineage(mined(cut, 2, support, None))))
    three = spark.sparkContext.broadcast(bitmap_of(cut_lineage(mined(cut, 3, support, two))))
    all_counts = cut_lineage(counted(cut, {2: two, 3: three}).where((F.col("k") == 1) | (F.col("a") >= support)))
    discard(cut)
    total = all_counts.where("k = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    of = lambda k, name: all_counts.where((F.col("k") == k) & (F.col("a") >= support)).select("lang", F.col("phrase").alias(name), F.col("a").alias(f"n_{name}"))
    word = lambda c, i: F.split(c, " ")[i]

    pairs = of(2, "phrase").withColumnRenamed("n_phrase", "a").withColumn("w1", word("phrase", 0)).withColumn("w2", word("phrase", 1))
    triples = of(3, "phrase").withColumnRenamed("n_phrase", "a").withColumn("w1", word("phrase", 0)).withColumn("w3", word("phrase", 2))
    triples = triples.withColumn("head", F.concat_ws(" ", "w1", word("phrase", 1))).withColumn("tail", F.concat_ws(" ", word("phrase", 1), "w3"))
    longer = triples.select("lang", "a", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    pairs = pairs.join(longer, ["lang", "phrase"], "left").where("longest is null or 100 * longest < 50 * a")
    pairs = pairs.join(of(1, "w1"), ["lang", "w1"]).join(of(1, "w2"), ["lang", "w2"]).select("lang", "phrase", "a", F.col("n_w1").alias("l"), F.col("n_w2").alias("r"))
    triples = triples.join(of(1, "w1"), ["lang", "w1"]).join(of(1, "w3"), ["lang", "w3"]).join(of(2, "head"), ["lang", "head"]).join(of(2, "tail"), ["lang", "tail"])
    early, late = score(F.col("a"), F.col("n_w1"), F.col("n_tail")), score(F.col("a"), F.col("n_head"), F.col("n_w3"))
    triples = triples.select("lang", "phrase", "a", F.when(late < early, F.col("n_head")).otherwise(F.col("n_w1")).alias("l"), F.when(late < early, F.col("n_w3")).otherwise(F.col("n_tail")).alias("r"))
    scored = pairs.unionByName(triples).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # few rows of each part reach a language's one task
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
