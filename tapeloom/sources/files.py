"""Raw vendor files: layout raw/{source}/{data_type}/{date}/{run}/file.csv."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.session import cut_lineage

# fixed values: (source, data type) pairs that have a parser
ROUTES = (
    "tdx/kline", "tdx/index", "tdx/announcement", "tdx/quotes", "tdx/financials",
    "stock_finance_data/price", "stock_finance_data/financials", "stock_finance_data/announcement", "stock_finance_data/forecast",
    "stock_finance_data/index", "yahoo_finance/price", "yahoo_finance/fx", "yahoo_finance/stock_actions", "yahoo_finance/index",
    "tianyancha/announcement", "akshare/price", "akshare/financials", "akshare/index", "akshare/telegraph", "akshare/announcement",
    "akshare/forecast", "akshare/stock_info", "akshare/calendar", "akshare/macro", "akshare/flow", "akshare/industry",
    "akshare/balance_sheet", "akshare/cash_flow", "akshare/fin_abstract", "akshare/gdhs",
)
LAYOUT = r"(?:^|/)raw/([^/]+)/([^/]+)/([^/]+)/(?:[^/]+/)*([^/]+)\.csv$"
SYMBOL_MARKS = r"_is_|_bs_|_cf_|_abstract_|_gdhs"


def scan(spark: SparkSession, root: str, *routes: str) -> DataFrame:
    """Files below ``root`` of the given ``source/data_type`` routes (all, if none is given): path, length, SHA-256 and content.

    Content is read only where it is selected. Folders of other routes are not listed; Spark leaves out files without bytes.
    """
    below = [f"{root}/{r}" for r in routes] or [root]
    def one(path: str) -> DataFrame:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "file_path string, length long, content_hash string, content binary")
        return found.select(F.col("path").alias("file_path"), "length", F.sha2("content", 256).alias("content_hash"), "content")
    parts = [one(p) for p in below]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def read_layout(files: DataFrame, columns: list[str]) -> DataFrame:
    """Records of CSV files (file_path, content) as text columns, found by the names in each file's own header.

    ``row_no`` counts a file's records from 1, whatever machine reads it. A column that a file lacks is NULL, others are
    ignored. ``corrupt`` holds the whole record where it has more or fewer fields than the header, or bytes that are no
    UTF-8; what can be read of it is there too. Quoted fields may hold line ends. Empty lines give no rows.
    """
    schema = "file_path string, row_no long, " + ", ".join(f"`{c}` string" for c in columns) + ", corrupt string"

    def rows(batches: Iterator) -> Iterator:
        import csv
        import io

        import pyarrow as pa

        names = ["file_path", "row_no", *columns, "corrupt"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(columns) + 1)]
        made: list[list] = [[] for _ in names]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                reader = csv.reader(io.TextIOWrapper(pa.BufferReader(content.as_buffer()), "utf-8-sig", "replace", newline=""))
                head = next((r for r in reader if r), [])
                place = {c: i for i, c in enumerate(head)}
                wanted = [place.get(c) for c in columns]
                for no, r in enumerate((r for r in reader if r), 1):
                    bad = len(r) != len(head) or any("\ufffd" in x for x in r)
                    for out, i in zip(made[2:-1], wanted):
                        out.append(r[i] if i is not None and i < len(r) else None)
                    made[0].append(path)
                    made[1].append(no)
                    made[-1].append(",".join(r) if bad else None)
                    if len(made[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names)
                        made = [[] for _ in names]
        if made[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds)], names)

    return files.select("file_path", "content").mapInArrow(rows, schema)


def part(path, i: int) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, LAYOUT, i)


def stem_symbol(stem: Column) -> Column:
    return F.element_at(F.split(stem, SYMBOL_MARKS), 1)


def route_raw(files: DataFrame) -> DataFrame:
    """Source, type, date and stem of each file, and whether it feeds bars; forward-adjusted price files do not."""
    x = files.withColumns({"source": part("file_path", 1), "data_type": part("file_path", 2), "ingest_date": part("file_path", 3),
                           "stem": part("file_path", 4)})
    known = F.concat_ws("/", "source", "data_type").isin(*ROUTES)
    forward = (F.col("data_type") == "price") & F.contains("stem", F.lit("_forward"))
    return x.withColumns({"routed": known, "outcome": F.when(~known, "unrouted").when(forward, "forward_skipped").otherwise("parse")})


def classify_files(files: DataFrame, watch: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """Pool file, forward file of the pool, other, unrouted, or filtered out by source."""
    x = route_raw(files)
    mark = (F.when((F.col("data_type") == "price") & F.contains("stem", F.lit("_forward")), F.element_at(F.split("stem", "_forward"), 1))
            .when((F.col("data_type") == "kline") & F.col("stem").rlike("_tq1|_tq2|_forward"), F.element_at(F.split("stem", "_tq1|_tq2|_forward"), 1)))
    x = x.withColumns({"_fwd": mark, "symbol": F.coalesce(mark, stem_symbol(F.col("stem")))})
    pool = watch.select("symbol", F.lit(True).alias("_pool")).distinct()
    x = x.join(pool, "symbol", "left")
    drop = ~F.col("source").isin(*sources) if sources else F.lit(False)
    kind = (F.when(~F.col("routed"), "unrouted").when(drop, "filtered").when(F.col("_fwd").isNotNull() & F.col("_pool"), "forward")
            .when(F.col("_fwd").isNotNull(), "other").when(F.col("_pool"), "pool").otherwise("other"))
    return x.withColumn("kind", kind).drop("_fwd", "_pool")


def skip_seen(files: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """Files whose content has not been ingested before; equal content inside the batch counts once."""
    done = raw_objects.where("fetch_status = 'ok'").select("content_hash")
    fresh = files.join(done, "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min("file_path").alias("file_path"))


class Ledger:
    """Which file contents have been ingested, and the facts that came of them.

    A run writes its facts, then one row per file, then one row that says that it is done. Only runs with that last row count,
    for what has been seen as for the facts. So a run that dies anywhere leaves nothing that is visible, and the next one
    ingests the same files again; once done, equal content is never parsed twice. Files that ``parse`` rejects are noted as
    such and tried again by later runs. Runs follow each other; two at a time are not meant to share a ledger.
    """

    ROWS = "run_id string, raw_object_id string, content_hash string, file_path string, source string, data_type string, fetch_status string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema=None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _done(self, name: str, schema=None) -> DataFrame | None:
        runs, rows = self._read("done", "run_id string"), self._read(name, schema)
        return None if runs is None or rows is None else rows.join(runs.distinct(), "run_id", "left_semi")

    def objects(self) -> DataFrame:
        """One row per file of the runs that are done."""
        found = self._done("objects", self.ROWS)
        return self.spark.createDataFrame([], self.ROWS) if found is None else found

    def facts(self) -> DataFrame | None:
        """Facts of the runs that are done, or none yet."""
        return self._done("facts")

    def prepare(self, run_id: str, files: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        """Parse what has not been seen and write it, not yet visible. ``parse`` takes (file_path, content) and gives facts with
        their file_path, and the file_path of rejected files."""
        fresh = skip_seen(files, self.objects())
        objects = fresh.select(
            F.lit(run_id).alias("run_id"), F.concat(F.lit("raw_"), F.substring("content_hash", 1, 16)).alias("raw_object_id"), "content_hash", "file_path",
            part("file_path", 1).alias("source"), part("file_path", 2).alias("data_type"))
        paths = cut_lineage(objects)
        kept, rejected = parse(files.join(paths.select("file_path"), "file_path", "left_semi").select("file_path", "content"))
        bad = cut_lineage(rejected.select("file_path").distinct())
        kept.join(bad, "file_path", "left_anti").join(paths.select("file_path", "raw_object_id", "run_id"), "file_path").write.mode("overwrite").parquet(f"{self.folder}/facts/{run_id}")
        status = F.when(F.col("_bad"), "rejected").otherwise("ok")
        told = paths.join(bad.withColumn("_bad", F.lit(True)), "file_path", "left").withColumn("fetch_status", status)
        told.select(*[x.split()[0] for x in self.ROWS.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/objects/{run_id}")

    def commit(self, run_id: str) -> None:
        """One row in one file: from here on the run counts."""
        self.spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")

    def ingest(self, run_id: str, files: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        """Nothing, if the run is done already."""
        done = self._read("done", "run_id string")
        if done is None or done.where(F.col("run_id") == run_id).isEmpty():
            self.prepare(run_id, files, parse)
            self.commit(run_id)
