"""Archives, source divergence and collocations: SQL on the given tables, brute force and edge cases on small ones."""
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tapeloom.llm import archives, collocations, stripes
from tapeloom.llm.queries import CHECKS, QUERIES
from tapeloom.session import work_folder
from tests.compare import duck, norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_arc_to_warc", "op12_stripes", "op13_collocations"])
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    want = duck(SF).execute(CHECKS[name])
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), [d[0] for d in want.description])


# ---------------------------------------------------------------------------------------------- archives

def test_arc_parsing():
    v2 = archives.FIELDS[2].encode()
    about = b"2 0 x\n" + v2 + b"\n\n"
    raw = b"".join(map(archives.member, [
        b"filedesc://a 0.0.0.0 2001 text/plain %d\n" % len(about) + about,
        b"http://a/ b 1.2.3.4 20010203 text/html 200 - - 0 f 9\nHTTP/1.1 \n",  # an address with a space
        b"dns:a 1.2.3.4 20010203040506 text/dns 0 - - 0 f 3\nabc\n", b"too few 3\nabc\n", b"x 1 2001 m 200 - - 0 f nine\nabc", b"x 1 2001 m 200 - - 0 f 90\nabc", b"",
    ]))
    got = [(r["kind"], r["fields"].get("URL"), r["block"], r["truncated"]) for r in archives.parse_arc(raw + archives.member(b"cut off" * 100)[:20])]
    assert got[1:6] == [("response", "http://a/ b", b"HTTP/1.1 ", False), ("resource", "dns:a", b"abc", False), ("unknown", None, b"", False), ("unknown", "x", b"", False), ("resource", "x", b"abc", True)]
    assert got[0][0] == "warcinfo" and gzip.decompress(raw)
    assert [archives.iso_time(x) for x in ("20010203040506", "2001", "200102030405", "no", "")] == ["2001-02-03T04:05:06Z", "2001-01-01T00:00:00Z", "2001-02-03T04:05:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert archives.payload_of(b"HTTP/1.0 200\nA: 1\n\nx\r\n\r\ny") == (b"HTTP/1.0 200\nA: 1\n\n", b"x\r\n\r\ny") and archives.payload_of(b"x\n\ny") == (b"", b"x\n\ny")


def test_conversion(spark, monkeypatch):
    monkeypatch.setattr(archives, "ROLL", 2000)  # several files
    long = "né<>\r\n\r\n" * 500_000
    bodies = [(1, "same"), (2, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (-5, "minus"), (6, long), (7, "x\0y")] + [(100 + i, f"page {i % 40} " * 30) for i in range(80)]
    head = lambda i: b"HTTP/1.1 200 OK\r\n" + (b"" if i is None else b"X-Rank: %d\r\n" % i) + b"\r\n"
    rows = [(f"http://a/{i} é\n", None, "text/html", head(i) + (b or "").encode(), 1) for i, b in bodies]
    captures = spark.createDataFrame(rows, "url string, date string, mime string, block binary, value int")
    for least in (0, 5):
        arcs, warcs = work_folder(spark), work_folder(spark)
        archives.write_arc(captures.limit(30), f"{arcs}/v1", 1)
        archives.write_arc(captures.subtract(captures.limit(30)).unionByName(captures.subtract(captures.limit(30)).where("url like '%/2 %'")), f"{arcs}/v2", 2)
        archives.convert(spark, arcs, warcs, "X-Rank", least)
        got = archives.read_warc(spark, warcs).where("type <> 'warcinfo'").collect()
        assert all(r.intact for r in got) and len({r.record_id for r in got}) == len(got) == len(rows)
        groups = defaultdict(list)
        for r in got:
            groups[r.payload_digest].append(r)
        want = Counter((b or "") for _, b in bodies)
        assert Counter({k: len(v) for k, v in groups.items()}) == Counter({archives.base32_sha1(b.encode()): n for b, n in want.items()})
        for b in want:
            some = groups[archives.base32_sha1(b.encode())]
            first = [r for r in some if r.type == "response"]
            assert {r.payload_bytes for r in some} == {len(b.encode())} and all(bytes(r.payload) == b.encode() for r in first)
            if len(b) >= least:
                top = max((i for i, x in bodies if (x or "") == b and i is not None), default=None)
                assert len(first) == 1 and all(r.refers_to == first[0].record_id for r in some if r.type == "revisit")
                assert archives.number(archives.field(bytes(first[0].head), "x-rank")) == top
            else:
                assert len(first) == len(some)


def test_no_captures(spark):
    arcs, warcs = work_folder(spark), work_folder(spark)
    none = spark.createDataFrame([], "url string, date string, mime string, block binary")
    archives.write_arc(none, arcs, 1)
    archives.convert(spark, arcs, warcs, "X-Rank")
    assert archives.read_warc(spark, warcs).count() == 0


# ---------------------------------------------------------------------------------------------- stripes

@pytest.mark.parametrize("held", [1, 1_000_000])
def test_divergences(spark, held, monkeypatch):
    monkeypatch.setattr(stripes, "HELD", held)
    monkeypatch.setattr(stripes, "PAIRS", 7)
    words = [a + b for a in "abcdeé" for b in ("x", "Y", "漢")]
    text = lambda i: " ".join(words[(i * i + j * (i % 7 + 1)) % len(words)] for j in range(i % 11))
    rows = [(("en", "de", None)[i % 3], f"s{i % 4}" if i % 9 else None, text(i), i, "clash") for i in range(70)] * 2 + [("fr", "a", "1 2", 0, ""), ("fr", "b", None, 0, ""), ("fr", "b", "zz " * 9, 0, "")]
    rows.append(("en", "s1", "ax " * 200_000, 5, ""))  # one long text
    df = spark.createDataFrame(rows, "lang string, source string, text string, value long, rank string")
    got = sorted(tuple(r) for r in stripes.divergences(df.repartition(5), terms=4).collect())
    df_, n, groups = Counter(), Counter(), set()
    for lang, source, t, *_ in rows:
        lang, source, ws = lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        groups.add((lang, source))
        df_.update((lang, w) for w in set(ws))
        n.update((lang, source, w) for w in ws)
    want = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in df_.items() if x == lang and k >= 3]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in [*sources, ...]:
            count = lambda w: sum(n[lang, x, w] for x in (sources if s is ... else [s]))  # noqa: B023, E731
            total = sum(map(count, kept))
            p[s] = {w: 1 + 10**9 * (count(w) + 1) // (total + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(p[s][w], p[...][w]), w.encode(), w) for w in kept if n[lang, s, w] and p[s][w] > p[...][w])[:4]
            want += [(lang, s, part, item, -v, i) for part, some in (("pair", pair), ("term", term)) for i, (v, _, item) in enumerate(some, 1)]
    assert got == sorted(want)
    assert stripes.divergences(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------------------------- collocations

def brute_phrases(rows, support, first):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        rows_ = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:-1], q[1:]) for q, b in some.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("tokens", [50, 3_000_000])
def test_phrases(spark, tokens, monkeypatch):
    monkeypatch.setattr(collocations, "TOKENS", tokens)
    words = ["Ab", "cd", "éf", "x-1", "漢", "of", "the"]
    say = lambda i: "".join(words[(i * 5 + j * j * (i % 3 + 1)) % 7] + (" ", "\t ", ". ", "\n")[(i + j) % 13 % 4] for j in range(i % 40))
    rows = [(("en", "de", None)[i % 3], say(i), i, "clash") for i in range(90)] * 2 + [("en", None, 0, ""), ("en", "", 0, ""), ("xx", "a b", 0, ""), ("fr", "new york city " * 500_000, 0, "")]
    df = spark.createDataFrame(rows, "lang string, text string, rank long, score string").repartition(5)
    got = sorted(tuple(r) for r in collocations.phrases(df, 10, 12).collect())
    assert got == brute_phrases([r[:2] for r in rows], 10, 12)
    assert collocations.phrases(df.limit(0)).count() == 0


def test_many_words():
    block = collocations.Block("en")
    block.add(" ".join(f"w{i}" for i in range(1 << 18)) + " w0 w1 w2")
    block = collocations.Block("en").open(*block.close())
    block.names += [b""] * (1 << 21)  # more words than fit into one number a phrase
    rows, counts = block.phrases(3, block.places(3))
    assert len(rows) == 1 << 18 and counts.max() == 2


def test_digest():
    assert archives.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").digest()
