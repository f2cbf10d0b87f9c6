"""Edge cases and brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapeloom.llm import ball_tree, chosen_path, decontaminate, language, link_graph, packing, quality, suffix_dedup, token_files
from tapeloom.llm.queries import CHECKS, QUERIES, vocabulary
from tapeloom.session import work_folder

SHAPE = "doc_id long, text string, found string, k1 long, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "té") for b in ("n", "st", "ra", "x", "lo")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(300), say(90)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "one two"), (6, "one two"), (7, say(40) + passage + say(30)), (8, say(10) + passage + say(20)),
            (9, "Hent " * 300), (None, say(50)), (10, say(4000)), (11, "ONE, two"), (12, "漢字 \x1c é́ <|endoftext|>  x\n\ny "), (13, base + " " + base)]
    return spark.createDataFrame([(d, t, "clash", 1, "xx" if (d or 0) % 2 else "yy") for d, t in rows], SHAPE)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def encoded(rows, name):
    tok = Tokenizer.from_str(vocabulary(name))
    return [(d, tok.encode(t, add_special_tokens=False).ids) for d, t in rows]


def test_near_duplicates(docs, rows):
    sets = []
    for d, t in rows:
        w = t.encode().lower().split()
        sets.append((d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    comp = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {c: min((d for k, (d, _) in enumerate(sets) if comp[k] == c and d is not None), default=None) for c in comp}
    want = sorted(((d, len(s), least[c]) for (d, s), c in zip(sets, comp)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in chosen_path.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_large_nodes(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(400)] = f"x{rng.random()}"
        texts.append((i, " ".join(w)))
    got = chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_least_share(spark):
    assert [(chosen_path.trees_for(x), chosen_path.likely_from(x)) for x in (85, 80)] == [(4, 36), (5, 42)]
    texts = []
    for k in range(150):  # of each pair, one is the first 81 of the other's 100 shingles: similarity 0.81, and sizes as far apart
        w = [f"v{k}w{i}" for i in range(104)]
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:85]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, 80).collect()}
    assert got == {d: d - d % 2 for d, _ in texts}
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()}
    assert got == {d: d for d, _ in texts}
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [2 * k for k in range(150)]


def test_one_row_of_each(spark):
    say = lambda k: " ".join(f"v{k}w{i}" for i in range(200))
    near = say(1).replace("v1w100 ", "other ")
    rows = [(1, say(0), "a"), (1, say(0), "b"), (1, say(0), "a"), (3, say(1), ""), (5, near, ""), (5, say(2), ""), (None, say(3), ""), (None, near, ""), (None, say(4), ""), (None, say(4), ""),
            (9, None, ""), (9, None, ""), (None, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = corpus_pipeline.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, say(0)), (3, say(1)), (5, say(2)), (None, say(3)), (None, say(4)), (9, None), (9, None), (None, "")]
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(map(str, want))
    assert all(r.text == t for r, (_, t) in zip(sorted(corpus_pipeline.without_repeats(spark, got.where("doc_id = 1"), "").collect()), want))


def brute_removal(rows, n=400):
    texts, seen = [t.encode() for _, t in rows], {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i:i + n]] = seen.get(t[i:i + n], 0) + 1
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        yield d, len(t), bytes(c for c, g in zip(t, gone) if not g), sum(a and not b for a, b in zip(gone, [0, *gone]))


@pytest.mark.parametrize("together, length, gram", [(256, 400, 128), (1, 400, 128), (256, 240, 40), (1, 100, 16)])
def test_suffix_dedup(docs, rows, together, length, gram, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    got = suffix_dedup.remove(docs, ["doc_id", "found", "k1"], "cut", length=length, gram=gram).collect()
    assert sorted(((r.doc_id, r.cut.n_bytes, bytes(r.cut.kept), len(r.cut.spans)) for r in got), key=str) == sorted(brute_removal(rows, length), key=str)


def test_reaches():
    rng = random.Random(1)
    group = [(bytes(rng.choice(b"ab") for _ in range(6)) + b"c" * rng.choice([100, 262]), b"d" * rng.choice([140, 300, 390]) + bytes(rng.choice(b"ab") for _ in range(6))) for _ in range(13)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = []
    for i, (h, t) in enumerate(group):
        pairs = [(common(h[::-1], x[::-1]), common(t, y)) for j, (x, y) in enumerate(group) if j != i]
        good = [(a, b) for a, b in pairs if a + b >= 400]
        want.append((max(a for a, _ in good), max(b for _, b in good)) if good else None)
    assert suffix_dedup.reaches([group], 400, 272) == [want]


def test_tokens(spark, docs, rows):
    path = work_folder(spark)
    token_files.write_tokens(docs, path, vocabulary("word_bpe_49k.json"), "lower_words", 1)
    want = sorted(((d, len(ids) + 1, zlib.crc32(np.array(ids + [1], "<u4").tobytes())) for d, ids in encoded(rows, "word_bpe_49k.json")), key=str)
    got = token_files.digests(spark, path).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_packing(docs, rows):
    got = packing.pack(docs.repartition(9), vocabulary("byte_bpe_50k.json"), size=256, with_ids=True).collect()
    want = {d: np.array(ids + [0], "<u4").tobytes() for d, ids in encoded(rows, "byte_bpe_50k.json") if d != 6}
    filled, texts = {}, {}
    for r in sorted(got, key=lambda r: r.piece):
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts[r.doc_id] = texts.get(r.doc_id, b"") + bytes(r.ids)
        assert zlib.crc32(r.ids) == r.ids_crc32 and (r.piece == 0 or r.length == 256)
    assert {d: x for d, x in texts.items() if d != 6} == want
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    first = docs.where("doc_id = 7").first().text.split()
    items = spark.createDataFrame([("a", " ".join(first[45:70])), ("b", "one TWO"), (None, "changed"), ("c", ""), ("d", None), ("a", " ".join(first[45:70]))], "item_id string, text string")
    told = lambda: sorted(((r.doc_id, r.found, tuple(r.f)) for r in decontaminate.find(docs, items, ["doc_id", "found"], "f").collect()), key=str)
    whole = told()
    hits = {d: f[1] for d, _, f in whole}
    assert hits[6] == 2 and hits[11] == 2 and hits[3] == 1 and hits[7] == 25 and hits[4] == 0
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    assert told() == whole


def test_models(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (10, 1), (6, 0), (99, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.score(docs, labels, F.lit(False)).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}
    found = language.identify(docs, F.lit(True), ["doc_id", "found"], "f").collect()
    assert {r.f.lang for r in found if r.doc_id in (4, 5)} == {"und"} and {r.f.lang for r in found} <= {"xx", "yy", "und"}
    assert {r.f.lang for r in language.identify(docs, F.lit(False), ["doc_id"], "f").collect()} == {"und"}


def test_gradients():
    ids, labels = np.random.default_rng(0).integers(97, 105, (5, 4)), np.array([0, 1, 0, 1])
    w = {k: v.astype(np.float64) for k, v in language.start(2).items()}
    loss = lambda: -np.log(language.probabilities(w, language.states(w, ids)[0])[:, np.arange(4), labels]).mean()
    g = language.gradients(w, ids, labels)
    for k, at in (("wr", (0, 99, 3)), ("un", (1, 2, 5)), ("uz", (0, 1, 1)), ("b", (1, 4)), ("o", (0, 3, 1))):
        w[k][at] += 1e-2
        up = loss()
        w[k][at] -= 2e-2
        assert abs((up - loss()) / 2e-2 - g[k][at]) < 1e-3
        w[k][at] += 1e-2


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)] + [(300 + i, [0.1] * 6) for i in range(9)] + [(400, None), (401, [float("nan")] * 6), (402, [1.0, None]), (None, [0.5] * 6), (500, [])]
    got = ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=5)
    ints = {i: np.floor(1024 * np.array(v or [0.0] * 6)) for i, v in rows if i is not None and v is not None and i not in (401, 402)}
    want = {(q, r + 1, i, int(-s)) for q in ints if q % 100 == 0 for r, (s, i) in enumerate(sorted((-float(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5])}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("name,table,rows", [
    ("op5_link_graph", "pages", [(1, None, None), (2, "no host", "x"), (3, "http://A.example.org/es/1", '<a href="http://bad.net/x">'), (4, "http://bad.net/q", "<a class=x href='//b.example.com/de/'>"), (5, "https://b.example.com/de/1", ""), (6, "http://sub.com/fr/?a", None), (6, "http://sub.com/fr/?a", None), (7, "http://good.net", '<A HREF=http://b.example.com/de/1>')]),
    ("op7_chat_tree", "conversations", [(1, 0, "user", "hi <s>\\l[INST]"), (1, 1, "assistant", "yes\n[/INST]"), (2, 0, "user", "hi <s>\\l[INST]"), (2, 1, "assistant", None), (None, 0, None, "é"), (3, 0, "user", "hi <s>\\l[INST]"), (3, 1, "assistant", "yes\n[/INST]"), (3, 1, "assistant", "yes\n[/INST]")]),
])
def test_against_sql(spark, tmp_path, name, table, rows):
    shape = {"pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string"}[table]
    for some in (rows, []):
        path = tmp_path / f"{len(some)}"
        spark.createDataFrame(some, shape).coalesce(1).write.parquet(str(path / f"{table}.parquet"))
        got = QUERIES[name](spark, str(path))
        con = duckdb.connect()
        con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
        want = con.sql(f"select {', '.join(got.columns)} from ({CHECKS[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_links_far_and_many(spark):
    rules = [link_graph.Rule("block", "bad.test", "/x"), link_graph.Rule("block", "hub.test", "/0/")]
    link = lambda host, n=1: f"<a href='//{host}/'>" * n
    rows = [(0, "http://bad.test/x", "")] + [(k, f"http://h{k}.test/", link(f"h{k - 1}.test" if k > 1 else "bad.test")) for k in range(1, 16)]
    rows += [(100, "http://one.test/", link("hub.test")), (101, "http://many.test/", link("hub.test", 90_000)), (102, "http://none.test/", link("else.test"))]
    hub = spark.range(10_000).selectExpr("1000 + id as page_id", "concat('http://hub.test/', id, '/') as url", "'' as html")  # page 0 is blocked
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(hub)
    got = {r.page_id: r.verdict for r in link_graph.judge(pages, rules).where("page_id <= 1000").collect()}
    assert got == {**dict.fromkeys([*range(16), 100, 101, 1000], "block"), 102: "allow"}


def test_ranks_on_a_circle(spark):
    """Against the limit in fractions; a circle of two hosts never runs dry by itself."""
    seeds = spark.createDataFrame([("a", link_graph.SEED, 0)], "host string, trust long, distrust long")
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("b", "a", 5)], "src string, dst string, w long")
    got = {r.host: int(r.trust) for r in link_graph.propagate(seeds, edges).collect()}
    a = Fraction(15, 100) / (1 - Fraction(85, 100) ** 2 * Fraction(2, 3))
    want = {"a": a, "b": a * Fraction(85, 100) * Fraction(2, 3), "c": a * Fraction(85, 100) / 3}
    assert set(got) == set(want)
    assert all(0 <= want[h] * link_graph.SEED - got[h] < 1000 for h in want)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert chosen_path.near_duplicates(none).count() == 0
    assert suffix_dedup.remove(none, ["doc_id"]).count() == 0
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert language.identify(none, F.lit(True), ["doc_id"]).count() == 0
    assert decontaminate.find(none, none.select(F.col("found").alias("item_id"), "text"), ["doc_id"]).count() == 0
