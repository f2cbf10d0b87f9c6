"""A training corpus from ``documents``: five stages, each on all that the one before it kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import chosen_path, decontaminate, language, packing, suffix_dedup
from tapeloom.llm.common import bitmap_of, held_out, read, thinned
from tapeloom.llm.queries import decontaminated, vocabulary
from tapeloom.session import cut_lineage, small_batches

#: Mean label probability below which a document's language counts as unknown.
LEAST_SCORE = 0.35
#: Bytes that a repeated passage of over 50 words has, but for few; ``suffix_dedup`` removes repeats of so many, found by anchors of 40.
REPEAT, ANCHOR = 240, 40
#: Similarity in a hundred from which two documents are near-duplicates.
NEAR = 80


def _fresh(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    name = "found"
    while {name, "_" + name} & set(docs.columns):
        name += "_"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents without letters or whose language the network can't tell go. Null texts go."""
    small_batches(spark)
    found = _fresh(docs)
    told = language.identify(docs, ~held_out("doc_id", 4, 2), docs.columns, found)
    return told.where((F.col(found)["lang"] != language.UNKNOWN) & (F.col(found)["score"] >= LEAST_SCORE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates; of each group the row of the smallest id stays, and one row only. Rows without words all stay.

    Rows are known by a hash of all their columns. Only those that may have to go are shuffled.
    """
    small_batches(spark)
    row = _fresh(docs)
    keyed = docs.withColumn(row, F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"), F.lit(NEAR)))
    doubtful = chosen_path.doubtful_rows(keyed, row, NEAR).withColumnRenamed("row", row)
    known = spark.sparkContext.broadcast(bitmap_of(doubtful, row))
    kept = thinned(keyed, known, row, there=False).unionByName(thinned(keyed, known, row).join(doubtful, row, "left_anti"))
    several = doubtful.where("stays")
    if not several.isEmpty():
        known = spark.sparkContext.broadcast(bitmap_of(several, row))
        kept = kept.unionByName(thinned(keyed, known, row).join(several, row, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup; texts lose long repeated strings, and n_chars follows. All documents stay."""
    small_batches(spark)
    found = _fresh(docs)
    cut = suffix_dedup.remove(docs, docs.columns, found, as_text=True, length=REPEAT, gram=ANCHOR)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(found)["kept"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(F.col(found)["spans"]) > 0, F.char_length(F.col(found)["kept"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents that count as contaminated go."""
    small_batches(spark)
    found = _fresh(docs)
    judged = decontaminate.find(docs, read(spark, sf_dir, "benchmark"), docs.columns, found)
    return judged.where(~decontaminated(F.col(found))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language), ("MinHash near-dedup", one_of_each), ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", uncontaminated), ("best-fit packing", packed),
]
#: SQL can't express the network, the tokenizer or the byte strings; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what all stages keep of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
