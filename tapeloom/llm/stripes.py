"""How far the sources of a language differ in their words: in-mapper stripes.

A task folds whole documents into hash stripes, one a term: documents that hold it, and its count in every source. It spills
them when they hold ``HELD`` entries and at its end; spilled stripes meet by (language, term), and a sorted stream merges
neighbours, so no more than one stripe a term is held. Merged stripes of terms in ``least`` documents or more are kept.

With the totals of each group a stripe emits its divergences. For shares p of one group and q of another, f = (p - q)**2 // q.
The sum of f over all kept terms is that of terms in neither group (one number, times their count), plus what counts in one
of both groups change (from the distinct counts of each group, far fewer than terms), plus what terms in both change; only
the last comes from pairs of the sources inside one stripe. All numbers are whole: shares by long division, sums as decimals.

Nulls: a null text, language or source is an empty one. Texts without terms count as documents of their group alone; groups
without kept terms have value 0 and no terms. Repeated rows are documents of their own. Equal values go by item in byte
order. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.llm.common import slices
from tapeloom.session import cut_lineage

#: Letters of UTF-8, after lower-casing A-Z only.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Entries (term and source) that a task holds before it spills, some 200 MB; pairs of one stripe's sources worked on at a time.
HELD = 1_000_000
PAIRS = 1 << 20
#: Shares are in billionths.
SCALE = 1_000_000_000
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def fold(batches: Iterator) -> Iterator:
    """Stripes of the documents (lang, source, text) of one task."""
    import numpy as np
    import pyarrow as pa

    docs_with: dict[str, Counter] = {}
    counts: dict[str, dict[str, Counter]] = {}

    def spill() -> Iterator:
        for lang, df in docs_with.items():
            at = {t: i for i, t in enumerate(df)}
            names = list(counts[lang])
            term = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in counts[lang].values()])
            source = np.repeat(np.arange(len(names)), [len(c) for c in counts[lang].values()])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts[lang].values()])
            order = np.argsort(term, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(at)))]).astype(np.int32))
            whole = pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang), len(at)), pa.array([t.decode() for t in at], pa.string()), pa.array(np.fromiter(df.values(), np.int64, len(df))),
                pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(source[order]))), pa.ListArray.from_arrays(offsets, pa.array(n[order])),
            ], names=[x.split()[0] for x in STRIPE.split(", ")])
            yield from slices([whole], 20_000)
        docs_with.clear()
        counts.clear()

    held = 0
    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = TERM.findall(text.encode().translate(LOWER))
            if words:
                df, c = docs_with.setdefault(lang, Counter()), counts.setdefault(lang, {}).setdefault(source, Counter())
                before = len(c)
                df.update(set(words))
                c.update(words)
                held += len(c) - before
                if held >= HELD:
                    yield from spill()
                    held = 0
    yield from spill()


def merge(batches: Iterator) -> Iterator:
    """Equal (lang, term) of a sorted stream become one stripe."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def merged(rows):
        lang, term = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
        new = np.ones(len(term), bool)
        new[1:] = ~(np.asarray(pc.equal(lang[1:], lang[:-1]).to_numpy(False)) & np.asarray(pc.equal(term[1:], term[:-1]).to_numpy(False)))
        starts = np.flatnonzero(new)
        sources, n = rows.column(3).combine_chunks(), rows.column(4).combine_chunks()
        owner = np.repeat(np.cumsum(new) - 1, np.diff(np.asarray(sources.offsets)))
        coded = sources.flatten().dictionary_encode()
        key = owner * len(coded.dictionary) + np.asarray(coded.indices)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key[first] // len(coded.dictionary), minlength=len(starts)))]).astype(np.int32))
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([
            lang.take(at), term.take(at), pa.array(np.add.reduceat(rows.column(2).to_numpy(), starts)),
            pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(key[first] % len(coded.dictionary)))),
            pa.ListArray.from_arrays(offsets, pa.array(np.add.reduceat(n.flatten().to_numpy()[order], first))),
        ], names=rows.schema.names)

    last = None
    for batch in batches:
        if batch.num_rows:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[x.split()[0] for x in STRIPE.split(", ")])
            done = merged(pa.Table.from_batches([batch] if last is None else [last.cast(batch.schema), batch]))
            yield done.slice(0, done.num_rows - 1)
            last = pa.RecordBatch.from_pylist(done.slice(done.num_rows - 1).to_pylist(), done.schema)  # holds no more than itself
    if last is not None:
        yield last


def stripes(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, df, sources, counts) of terms in ``least`` documents of their language or more."""
    spilled = docs.mapInArrow(fold, STRIPE)
    return spilled.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, STRIPE).where(F.col("df") >= least)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total); NULL without a total."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def inside(batches: Iterator) -> Iterator:
    """(lang, source, item, value): what terms in both groups add to the parts that know one of both. Rows are (lang, entries of source, n, total)."""
    import numpy as np
    import pyarrow as pa

    def share(a, total):
        q = np.zeros(len(a), np.int64)
        for _ in range(3):  # long division by thousands, so that products stay below 64 bits
            a = a * 1000
            q, a = q * 1000 + a // total, a % total
        return 1 + q

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        k = np.diff(np.asarray(lists.offsets))
        entry = lists.flatten()
        owner = np.repeat(np.arange(len(k)), k)
        langs, names = batch.column(0).dictionary_encode(), entry.field(0).dictionary_encode()
        lang, source = np.asarray(langs.indices)[owner].astype(np.int64), np.asarray(names.indices).astype(np.int64)
        total = entry.field(2).to_numpy()
        p, zero = share(entry.field(1).to_numpy() + 1, total), share(np.ones(len(total), np.int64), total)
        begin, mine = np.repeat(np.cumsum(k) - k, k), np.repeat(k, k)  # of each entry's stripe
        blocks = np.cumsum(mine) // PAIRS
        for rows in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(blocks)) + 1):
            n = mine[rows]
            left = np.repeat(rows, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rows], n)
            left, right = left[left != right], right[left != right]
            f = lambda a, b: (a - b) ** 2 // b
            more = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
            key, at = np.unique((lang[left] * len(names.dictionary) + source[left]) * len(names.dictionary) + source[right], return_inverse=True)
            value = np.zeros(len(key), np.int64)
            np.add.at(value, at, more)
            item, rest = key % len(names.dictionary), key // len(names.dictionary)
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(rest // len(names.dictionary))), names.dictionary.take(pa.array(rest % len(names.dictionary))), names.dictionary.take(pa.array(item)), pa.array(value),
            ], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, least: int = 3, terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text), for part ``pair`` (other sources) and ``term``."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut_lineage(stripes(read, least))
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(whole).alias("lang_total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    total, v = F.coalesce("total", F.lit(0)), F.coalesce("v", F.lit(0))
    groups = cut_lineage(groups.select("lang", "source", v.alias("v"), (total + v).alias("of"), (F.coalesce("lang_total", F.lit(0)) + v).alias("lang_of")))
    groups = groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("of")))
    # every stripe meets the totals of its language; Spark broadcasts them while they are few, and splits a hot language else
    by_lang = cut_lineage(groups.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "of"))).alias("ofs"), F.first("lang_of").alias("lang_of")))
    told = kept.join(by_lang, "lang").select("lang", "term", "lang_of", whole.alias("in_lang"), F.arrays_zip(
        F.col("sources").alias("source"), F.col("counts").alias("n"), F.transform("sources", lambda s: F.element_at("ofs", s)).alias("of")).alias("entries"))
    known = told.select("lang", "term", "lang_of", "in_lang", F.explode("entries").alias("e")).select("lang", "term", "lang_of", "in_lang", "e.source", "e.n", "e.of")

    scored = known.withColumn("p", share(F.col("n"), F.col("of"))).withColumn("q", share(F.col("in_lang"), F.col("lang_of"))).where("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = scored.select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    top = top.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= terms).withColumn("part", F.lit("term"))

    big = lambda c: c.cast("decimal(38,0)")
    here, there = groups.alias("a"), groups.alias("b")
    both = here.join(there, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    neither = both.select("a.lang", "a.source", F.col("b.source").alias("item"), F.coalesce(big(F.col("a.v")) * big(apart(F.col("a.zero"), F.col("b.zero"))), big(F.lit(0))).alias("value"))
    sizes = known.groupBy("lang", "source", "n", "of").agg(F.count("*").alias("times")).withColumn("p", share(F.col("n"), F.col("of"))).withColumn("zero", share(F.lit(0).cast("long"), F.col("of"))).alias("c")
    one = sizes.join(there, (F.col("c.lang") == F.col("b.lang")) & (F.col("c.source") != F.col("b.source")))
    p, mine, other = F.col("c.p"), F.col("c.zero"), F.col("b.zero")
    left = one.select("c.lang", "c.source", F.col("b.source").alias("item"), (big(F.col("times")) * big(apart(p, other) - apart(mine, other))).alias("value"))
    right = one.select("c.lang", F.col("b.source").alias("source"), F.col("c.source").alias("item"), (big(F.col("times")) * big(apart(other, p) - apart(other, mine))).alias("value"))
    within = told.where(F.size("entries") > 1).select("lang", "entries").mapInArrow(inside, "lang string, source string, item string, value long").withColumn("value", big(F.col("value")))
    pairs = neither
    for part in (left, right, within):
        pairs = pairs.unionByName(part.groupBy("lang", "source", "item").agg(F.sum("value").cast("decimal(38,0)").alias("value")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", "rank")
