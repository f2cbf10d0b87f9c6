"""Small column helpers shared by the operators."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

DEC = "decimal(38,10)"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r(x, n: int) -> Column:
    """Round for output; both sides of a comparison round alike."""
    return F.round(c(x), n)


def dec(x) -> Column:
    return c(x).cast(DEC)


def series(*keys: str, order: str = "trade_date"):
    """Window of one ordered series. A series holds at most one row per key and open day."""
    return Window.partitionBy(*keys).orderBy(order)


def full(agg, col, w, start: int, end: int, n: int) -> Column:
    """Aggregate over a row frame, NULL unless all ``n`` values are there."""
    f = w.rowsBetween(start, end)
    return F.when(F.count(c(col)).over(f) == n, agg(c(col)).over(f))


def trailing(agg, col, w, n: int) -> Column:
    return full(agg, col, w, -n + 1, 0, n)


def previous(agg, col, w, n: int) -> Column:
    return full(agg, col, w, -n, -1, n)


def nonzero(x, default: float = 1.0) -> Column:
    """NULL or zero becomes the default."""
    return F.coalesce(F.nullif(c(x), F.lit(0.0)), F.lit(default))


def week_of(d) -> Column:
    """Monday of the ISO week, used as the week key."""
    return F.trunc(c(d), "week")


def short_hash(*cols, n: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[c(x) for x in cols]), 256), 1, n)


#: Columns that tell the order in which rows were delivered; paths name day and run.
DELIVERY = ("file_path", "row_no")


def one_per_key(df: DataFrame, key: list[str], last: bool = True, order: tuple[str, ...] = DELIVERY) -> DataFrame:
    """The last (or first) row of each key by delivery order, by content where the order is unknown or equal, so reruns agree."""
    rest = [x for x in df.columns if x not in key]
    at = [x for x in order if x in rest]
    best = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*at, *[x for x in rest if x not in at]))
    return df.groupBy(*key).agg(best.alias("_one")).select(*[x if x in key else F.col(f"_one.{x}").alias(x) for x in df.columns])


def ordered_price(order: Column, px) -> Column:
    """A price behind its place in the order, as one decimal: the least or greatest of a group is that of the first or last.

    A decimal is a buffer that a hash aggregate updates in place, so nothing is sorted. Places take 13 digits, prices 8 before
    the point and 16 after it; equal places go by price.
    """
    return (order.cast("decimal(13,0)") * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(37,16)") + c(px).cast("decimal(24,16)")


def price_of(ordered) -> Column:
    return (c(ordered) % F.lit(10**8).cast("decimal(9,0)")).cast("double")


#: Terms that one automaton holds; more of them mean more passes over the texts.
TERMS = 100_000


def occurrences(texts: DataFrame, terms: DataFrame, not_before: str = "") -> DataFrame:
    """(event_id, term) for every term that stands in a text (event_id, text), not followed by a character of ``not_before``.

    An automaton over the terms (Aho-Corasick) reads each text once, whatever their number; terms come in blocks of about
    ``TERMS``, dealt by hash, so what is sent to the workers is bounded. Null and empty terms stand nowhere.
    """
    t = terms.where("term <> ''").select("term").distinct()
    blocks = max(1, -(-t.count() // TERMS))
    schema = StructType([texts.schema["event_id"], StructField("term", StringType())])
    out = None
    for i in range(blocks):
        part = t if blocks == 1 else t.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i)
        found = texts.select("event_id", "text").mapInArrow(_finder([r.term for r in part.toLocalIterator()], not_before, schema["event_id"].dataType), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(words: list[str], not_before: str, kind):
    def find(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        arrow = to_arrow_type(kind)
        for batch in batches:
            ids, terms = [], []
            for event, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if words and text:
                    hits = {w for end, w in automaton.iter(text) if not (not_before and text[end + 1:end + 2] in not_before and end + 1 < len(text))}
                    ids += [event.as_py()] * len(hits)
                    terms += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(terms, pa.string())], ["event_id", "term"])
    return find
