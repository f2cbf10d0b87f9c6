"""What tables and plans leave behind and do twice."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom import session
from tapeloom.llm import chosen_path, common, suffix_dedup, words
from tapeloom.llm.queries import vocabulary
from tapeloom.sources import messages

LONG = " ".join(f"word{i} of a passage" for i in range(40))


def _folders(monkeypatch, tmp_path):
    names = iter(range(10_000))
    monkeypatch.setattr(session, "work_folder", lambda spark: f"{tmp_path}/work-{next(names)}")
    return lambda: [x for x in os.listdir(tmp_path) if x.startswith("work-")]


def _docs(spark):
    rows = [(1, "first " + LONG), (2, LONG + " second"), (3, "short"), (4, None), (5, "first " + LONG + " more")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    left = _folders(monkeypatch, tmp_path)
    before = spark.conf.get(session.CLEANUP, None)
    suffix_dedup.remove(_docs(spark), ["doc_id"], length=240, gram=40)
    assert len(left()) == 1  # the spans
    kept = chosen_path.first_rows(_docs(spark).withColumn("row", F.col("doc_id")), "row", corpus_pipeline.NEAR)
    assert len(left()) == 2  # and the rows that stay
    assert {r.row for r in kept.collect()} == {1, 3, 4}
    assert spark.conf.get(session.CLEANUP, None) == before


def test_near_duplicates_leave_no_copy(spark, tmp_path, monkeypatch):
    """Neither a table with all texts nor a shuffle of them; of rows with equal id and text one stays, whatever else they hold."""
    left = _folders(monkeypatch, tmp_path)
    rows = [(1, LONG, "a"), (1, LONG, "b"), (1, LONG, "a"), (2, LONG + " second", "a"), (3, "alone " * 9, "c"), (3, "alone " * 9, "c"), (4, None, "d"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert len(left()) == 1 and spark.read.parquet(f"{tmp_path}/{left()[0]}").columns == ["row", "stays"]
    assert sorted((r.doc_id, r.text) for r in got.where("doc_id < 4").collect()) == [(1, LONG), (3, "alone " * 9)]
    assert got.where("doc_id = 4").count() == 2


def test_bitmaps_thin_out(spark):
    ids = spark.range(2000).select("id", F.xxhash64("id").alias("x"))
    known = spark.sparkContext.broadcast(common.bitmap_of(ids.where("id % 10 = 0"), "x"))
    some, rest = ({r.id for r in common.thinned(ids, known, "x", there).collect()} for there in (True, False))
    assert some >= set(range(0, 2000, 10)) and len(some) < 400 and rest == set(range(2000)) - some
    none = spark.sparkContext.broadcast(common.bitmap_of(ids.where("id < 0"), "x"))
    assert common.thinned(ids, none, "x").count() == 0


def test_only_hashes_go_to_python(spark):
    """Other columns may even be of a kind that Arrow doesn't take."""
    ids = spark.range(200).select("id", F.xxhash64("id").alias("x"), F.expr("make_interval(0, cast(id AS int))").alias("other"))
    known = spark.sparkContext.broadcast(common.bitmap_of(ids.where("id < 20"), "x"))
    some, rest = (common.thinned(ids, known, "x", there) for there in (True, False))
    assert some.schema == ids.schema and some.count() + rest.count() == 200 and some.where("id < 20").count() == 20


def test_batches_of_texts_are_small(spark, tmp_path, monkeypatch):
    _folders(monkeypatch, tmp_path)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    before = spark.conf.get(session.BATCH_BYTES, None)
    got = session.cut_lineage(texts.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 5 << 20
    assert spark.conf.get(session.BATCH_BYTES, None) == before


def test_many_contexts_leave_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 1)
    left = _folders(monkeypatch, tmp_path)
    cut = suffix_dedup.remove(_docs(spark), ["doc_id"], length=240, gram=40)
    assert len(left()) == 1
    assert {r.doc_id: r.found.kept.decode() for r in cut.collect() if r.doc_id in (3, 4)} == {3: "short", 4: ""}


def test_nested_last_tables(spark, tmp_path, monkeypatch):
    left = _folders(monkeypatch, tmp_path)

    def outer():
        inner = session.last_table(lambda: session.cut_lineage(spark.range(3)).where("id > 0"))
        return inner.join(session.cut_lineage(spark.range(2)), "id")

    assert [r.id for r in session.last_table(outer).collect()] == [1] and len(left()) == 1


def test_md_tables(spark):
    table = "| a |  | a |\n|---|:-:|---|\\n | 1 | x  y |\t|\nno row\n| 1 | x  y | |\n||2|3|4||\n| 5 | 6 |\n|a||b|\n| - | : | - |"
    rows = [(2, table), (1, "| a |  | a |\n|4|5|6|\n| 1 |x  y||"), (None, "|a|"), (4, None), (5, "no bars"), (None, "|z|\n|9|"), (6, "|z|\n| 9 |")]
    df = spark.createDataFrame(rows, "doc_id long, table_markdown string")
    got = messages.explode_md_table(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.replace("filter", "")  # a filter split every table a second time
    want = [(1, 0, "a", "4"), (1, 0, "_col2", "5"), (1, 0, "a_2", "6"), (2, 2, "a", "2"), (2, 2, "_col2", "3"), (2, 2, "a_2", "4"), (2, 3, "a", "a"), (2, 3, "_col2", ""), (2, 3, "a_2", "b"),
            (2, 0, "a", "1"), (2, 0, "_col2", "x  y"), (2, 0, "a_2", ""), (None, 0, "z", "9")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_words_are_encoded_without_their_marks():
    """One word and its forms with marks reach the tokenizer once, also with letters beyond ASCII; ids equal the library's."""
    for kind, file in (("lower_words", "word_bpe_49k.json"), ("byte_words", "byte_bpe_50k.json")):
        memo = {"lower_words": words.LowerWords, "byte_words": words.ByteWords}[kind](vocabulary(file))
        asked, bare = [], memo.bare

        class Bare:
            def encode_batch_fast(self, texts, **options):
                asked.extend(texts[0])  # noqa: B023
                return bare.encode_batch_fast(texts, **options)  # noqa: B023

            def encode(self, *given, **options):
                return bare.encode(*given, **options)  # noqa: B023

        memo.bare = Bare()
        texts = ["of straße straße!! straße. straße.%%% of", "xy xy... xy&&& xy' xy", "Éa ªº éa!! ¿éa a² 'xy's xy'.", "x<| x<|endoftext|> <|x|> ĀĀ. é\u0301!"]
        assert memo(texts[:2]) == [memo.library(t) for t in texts[:2]]
        assert asked.count(memo.letters[0]) == (3 if kind == "lower_words" else 5)  # the first words of byte-level texts have no space
        assert memo(texts) == [memo.library(t) for t in texts] == memo([t.encode() for t in texts])


def test_known_words_with_marks_are_not_learnt(monkeypatch):
    """Once no more words are remembered, a known word with marks needs neither the library nor a place of its own."""
    for kind, file in (("lower_words", "word_bpe_49k.json"), ("byte_words", "byte_bpe_50k.json")):
        memo = {"lower_words": words.LowerWords, "byte_words": words.ByteWords}[kind](vocabulary(file))
        memo(["x of of of house house"])
        monkeypatch.setattr(words, "REMEMBERED", len(memo.words))
        asked, learn = [], memo.learn
        monkeypatch.setattr(memo, "learn", lambda ws: asked.extend(ws) or learn(ws))  # noqa: B023
        texts = ["x of, of&&& house!! of.", "x of's of<|endoftext|> of<| house.of éa. of́, Of."]
        assert memo(texts[:1]) == [memo.library(texts[0])] and not {b"of,", b"of&&&", b"house!!", b"of."} & set(asked)
        assert memo(texts) == [memo.library(t) for t in texts] == memo([t.encode() for t in texts])
        monkeypatch.undo()


def test_arrays_of_a_task_are_small(spark, monkeypatch):
    """Arrays are made for a piece of text at a time, not for a megabyte: that took some 100 MB a task."""
    import tracemalloc

    import pyarrow as pa

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run

    texts = [f"{i} " + " ".join(str(i * j % 9973) for j in range(2000)) for i in range(400)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts), *[pa.array(range(len(texts)))] * 5], ["text", "doc_id", "row", "h", "k1", "k2"])
    for make in (lambda f: suffix_dedup.members(f, 240, 40), lambda f: chosen_path.sketched(f, 5)):
        frame = Frame()
        monkeypatch.setattr(suffix_dedup, "keyed", lambda docs: docs)
        make(frame)
        tracemalloc.start()
        assert sum(x.num_rows for x in frame.run(iter([batch]))) >= 400
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40 << 20


def test_stages_ask_for_small_batches(spark, monkeypatch):
    """Also where the caller writes a stage's frame; a session's own setting stays."""
    before = spark.conf.get(session.BATCH_BYTES, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(session.BATCH_BYTES)
            monkeypatch.setattr(corpus_pipeline, "_fresh", None)  # only the first line of the stage counts
            monkeypatch.setattr(corpus_pipeline.packing, "pack", None)
            with pytest.raises(TypeError):
                stage(spark, _docs(spark), "")
            assert spark.conf.get(session.BATCH_BYTES) == session.BATCH
        spark.conf.set(session.BATCH_BYTES, "3m")
        session.small_batches(spark)
        assert spark.conf.get(session.BATCH_BYTES) == "3m"
    finally:
        spark.conf.unset(session.BATCH_BYTES) if before is None else spark.conf.set(session.BATCH_BYTES, before)
