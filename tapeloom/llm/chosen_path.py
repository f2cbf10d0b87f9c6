"""Near-duplicates by a chosen-path similarity join over five-word shingles.

Documents with the same shingle set are one class from the start. Each class has SLOTS minwise tokens for each tree. In each of
the independent trees every node sends its classes to two children by the minwise tokens at two coordinates of that node's
own; nodes of at most SMALL classes are compared exhaustively, larger ones branch on, LEVELS deep. A pair of
similarity s stays together at a node with probability 1 - (1 - s q)**2, where q is that of the level below. There are as many
trees as miss at most one pair in a million of the least similarity asked for: at 0.85 a tree finds it with 0.9695 and four are
enough, at 0.80 with 0.9409 and it takes five; more similar pairs are missed less.

Members of a node that have a likely partner by their minwise tokens meet there with their texts, and all pairs are compared on
full sets at once; a node hands on a spanning forest of its links, never its pairs. Nodes that are still large at the bottom
hold real groups of near copies; those with the same least member are merged, as a group stands in many of them. They are
split into parts of SMALL with a few common members, which tie the group together; whoever isn't in the group's main
component then meets all others, in cells of at most twice CELL.

Words are split at ASCII white space, with A-Z in lower case; fewer than five words are one shingle. A null or empty text has no
shingle and is linked with nothing. A null doc_id is linked like others; the smallest known id names the component. Rows with
equal ids are documents of their own. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.llm.common import PIECE, bitmap_of, chosen, slices, thinned
from tapeloom.llm.components import components
from tapeloom.session import cut_lineage, last_table

SHINGLE = 5
LEVELS, SLOTS = 3, 16
SMALL = 64
CELL = 256
#: Share of the pairs of the least similarity that all trees may miss.
MISSED = 1e-6
MIX_1, MIX_2, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15 | 1


def trees_for(share: int) -> int:
    """Number of trees that miss at most MISSED of the pairs of similarity ``share`` in a hundred."""
    if not 0 < share <= 100:
        raise ValueError("the share is from 1 to 100")
    together = 1.0
    for _ in range(LEVELS):
        together = 1 - (1 - share / 100 * together) ** 2
    return 1 if together == 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - together)))


def likely_from(share: int) -> int:
    """Equal minwise tokens of a likely pair: six deviations below what is expected at similarity ``share`` in a hundred."""
    tokens = SLOTS * trees_for(share)
    return max(1, int(tokens * share // 100 - 6 * math.sqrt(tokens * share * (100 - share)) / 100))


def _mix(x):
    """Spread 64-bit numbers; wraps around."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list:
    """Sorted distinct shingle hashes of each text, with few passes over all bytes at once."""
    import numpy as np

    raw = np.frombuffer((b" " + b" ".join(texts) + b" ").lower(), np.uint8)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    gap = blank[raw]
    first, last = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(raw), BASE, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        back = np.cumprod(np.full(len(raw) + 1, pow(BASE, -1, 1 << 64), np.uint64))
        words = _mix((total[last] - total[first]) * back[first])
        ends = np.cumsum([len(t) + 1 for t in texts]) + 1  # the byte after each text's blank
        until = np.searchsorted(first, ends - 1)
        out, at = [], 0
        for stop in until.tolist():
            w = words[at:stop]
            at = stop
            n = max(1, len(w) - size + 1) if len(w) else 0
            h = np.zeros(n, np.uint64)
            for j in range(min(size, len(w))):
                h = h * np.uint64(MIX_2) + w[j:j + n]
            out.append(np.unique(_mix(h + np.uint64(min(len(w), size)))))
    return out


def names_of(sets: list) -> list[bytes]:
    """A 128-bit name of each set."""
    import numpy as np

    with np.errstate(over="ignore"):
        return [np.array([_mix(s).sum(dtype=np.uint64), _mix(s + np.uint64(BASE)).sum(dtype=np.uint64)]).tobytes() for s in sets]


def signatures(sets: list, coordinates: int) -> tuple[list[bytes], list[bytes]]:
    """A 128-bit name of each set, and its minwise tokens as 32-bit numbers."""
    import numpy as np

    with np.errstate(over="ignore"):
        full = [i for i, s in enumerate(sets) if len(s)]
        tokens = np.zeros((len(sets), coordinates), np.uint32)
        if full:
            flat = np.concatenate([sets[i] for i in full])
            begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
            salts = _mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(BASE))
            for c in range(coordinates):
                mixed = (flat ^ salts[2 * c]) * (salts[2 * c + 1] | np.uint64(1))
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(MIX_1)
                tokens[full, c] = (np.minimum.reduceat(mixed, begin) >> np.uint64(32)).astype(np.uint32)
    return names_of(sets), [t.tobytes() for t in tokens]


def sketched(docs: DataFrame, trees: int) -> DataFrame:
    """(doc_id, row, h, n, name, tokens) of every document; name is null without shingles."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            n, names, tokens, at = [], [], [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < PIECE):
                    size += len(texts[stop])
                    stop += 1
                sets = shingle_sets(texts[at:stop])
                more = signatures(sets, SLOTS * trees)
                n += [len(s) for s in sets]
                names += [x if len(s) else None for x, s in zip(more[0], sets)]
                tokens += [x if len(s) else None for x, s in zip(more[1], sets)]
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("h"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "row", "h", "n", "name", "tokens"])

    return docs.select("doc_id", "row", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "doc_id long, row long, h long, n long, name binary, tokens binary")


def _child(node: Column, place: Column) -> Column:
    """Name of the node that a class reaches by its token at ``place``; places are numbered through all trees."""
    return F.xxhash64(node, place, F.substring("tokens", place * 4 + 1, F.lit(4)))


def grow(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """(node, tree, at, name) of small nodes, and (node, name) of those that are large at the bottom."""
    # nodes of a tree are numbered as in a heap; node i uses coordinate i - 1 of its tree's SLOTS
    slots = F.array(*(F.struct(F.lit(r).alias("tree"), F.lit(at).alias("at")) for r in range(trees) for at in (1, 2)))
    rows = classes.select("name", "tokens", F.explode(slots).alias("s")).select("name", _child(F.col("s.tree").cast("long"), F.col("s.tree") * SLOTS + F.col("s.at") - 1).alias("node"), "s.tree", "s.at")
    small = []
    for level in range(1, LEVELS + 1):
        rows = cut_lineage(rows)
        # a table of its own, so that the join has two plain shuffles and hot nodes can be split
        sizes = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"))
        known = rows.sparkSession.sparkContext.broadcast(bitmap_of(sizes, "node"))
        rows = cut_lineage(thinned(rows, known, "node").join(sizes, "node"))
        small.append(rows.where(F.col("size") <= SMALL).select("node", "tree", "at", "name"))
        large = rows.where(F.col("size") > SMALL)
        if level < LEVELS:
            known = rows.sparkSession.sparkContext.broadcast(bitmap_of(large.select(F.xxhash64("name").alias("x")).distinct(), "x"))
            down = large.select("node", "name", "tree", F.explode(F.array(F.col("at") * 2 + 1, F.col("at") * 2 + 2)).alias("at"))
            tokens = thinned(classes.select("name", "tokens", F.xxhash64("name").alias("x")), known, "x")
            rows = down.join(tokens, "name").select("name", _child(F.col("node"), F.col("tree") * SLOTS + F.col("at") - 1).alias("node"), "tree", "at")
    both = small[0]
    for s in small[1:]:
        both = both.unionByName(s)
    return both, large.select("node", "name")


def _by_node(rows: DataFrame, columns: list[str], task, schema: str) -> DataFrame:
    """Run ``task`` on tables of whole nodes, several nodes at a time."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            node = table.column("node").to_numpy()
            whole = int(np.searchsorted(node, node[-1])) if len(node) else 0  # the last node may go on
            if whole:
                yield from task(table.slice(0, whole))
            kept = table.slice(whole)
        if kept is not None and kept.num_rows:
            yield from task(kept)

    return rows.select(*columns).repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def with_partner(rows: DataFrame, share: int) -> DataFrame:
    """(node, name) of the members of small nodes that have a likely partner there.

    A pair counts in one node only: in the first tree, and there on the first path, on which its tokens agree all the way down,
    for on that path it is compared for certain; where there is none, in every node that it shares.
    """
    trees, least = trees_for(share), likely_from(share)

    def task(table) -> Iterator:
        import numpy as np
        import pyarrow as pa

        node, n, tree, at = (table.column(c).to_numpy() for c in ("node", "n", "tree", "at"))
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32).reshape(len(node), SLOTS * trees)
        partner, k, rows = np.zeros(len(node), bool), 1, np.arange(len(node))
        while True:
            rows = rows[rows + k < len(node)]
            rows = rows[node[rows] == node[rows + k]]  # sorted by node: a row without a k-th neighbour has none further off
            if not len(rows):
                break
            sized = rows[100 * np.minimum(n[rows], n[rows + k]) >= share * np.maximum(n[rows], n[rows + k])]
            equal = tokens[sized] == tokens[sized + k]
            likely = equal.sum(axis=1) >= least
            i, equal = sized[likely], equal[likely]
            first = np.full((len(i), trees), 99)  # the first leaf number on which the pair agrees all the way, by tree
            for r in range(trees):
                for leaf in range(14, 6, -1):
                    way = [leaf, (leaf - 1) // 2, ((leaf - 1) // 2 - 1) // 2]
                    first[equal[:, [SLOTS * r + x - 1 for x in way]].all(axis=1), r] = leaf
            earlier = (first < 99) & (np.arange(trees) < tree[i][:, None])
            own = first[np.arange(len(i)), tree[i]]
            levels = np.where(at[i] > 6, 0, np.where(at[i] > 2, 1, 2))
            above = own.copy()
            for level in (1, 2):
                above = np.where(levels >= level, (above - 1) // 2, above)
            here = i[~earlier.any(axis=1) & ((own == 99) | (above == at[i]))]
            partner[here] = partner[here + k] = True
            k += 1
        names = table.column("name").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(node[partner]), names.filter(pa.array(partner))], ["node", "name"])

    return _by_node(rows, ["node", "tree", "at", "name", "n", "tokens"], task, "node long, name binary")


def links_within(rows: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between members of (node, name, root, packed), all compared on full sets: a spanning forest over the roots of each node."""
    def task(table) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        lift = zstandard.ZstdDecompressor()
        node, names, roots = table.column("node").to_numpy(), table.column("name").to_pylist(), table.column("root").to_pylist()
        texts, sets = {}, {}
        for name, text in zip(names, table.column("packed").to_pylist()):
            texts.setdefault(name, text)
        todo = list(texts)
        for at in range(0, len(todo), 200):
            sets.update(zip(todo[at:at + 200], shingle_sets([lift.decompress(texts[x]) for x in todo[at:at + 200]])))
        edges = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            group = list(dict.fromkeys(zip(names[lo:hi], roots[lo:hi])))
            pairs = _similar([sets[name] for name, _ in group], share)
            up = {root: root for _, root in group}

            def top(x: bytes) -> bytes:
                while up[x] != x:  # noqa: B023
                    up[x] = up[up[x]]  # noqa: B023
                    x = up[x]  # noqa: B023
                return x

            for i, j in pairs:
                a, b = top(group[i][1]), top(group[j][1])
                if a != b:
                    up[a] = b
                    out.append((group[i][0], group[j][0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.binary()) for c in (0, 1)], ["a", "b"])

    return _by_node(rows, ["node", "name", "root", "packed"], task, "a binary, b binary")


def _similar(sets: list, share: int) -> list[tuple[int, int]]:
    """Pairs of sets that are similar enough, from the counts of all shingles that two or more of them have."""
    import numpy as np

    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    column = np.cumsum(shared) - 1
    both = np.zeros((len(sets), len(sets)))
    keep = shared[number]
    owner, column = owner[keep], column[number[keep]]
    for at in range(0, int(shared.sum()), 8192):  # so many shingles at a time
        part = slice(*np.searchsorted(column, [at, at + 8192]))
        has = np.zeros((len(sets), 8192), np.float32)
        has[owner[part], column[part] - at] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    good = 100 * both >= share * (size[:, None] + size[None] - both)
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(good, 1)))]


def texts_of(names: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, packed): a compressed text of each class of ``names``; other texts are neither compressed nor shuffled."""
    needed = cut_lineage(names.distinct().join(classes.select("name", "h"), "name"))
    known = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed, "h"))

    def squeeze(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in slices(batches):
            batch, press = chosen(batch, known, "h"), zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["h", "packed"])

    texts = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(squeeze, "h long, packed binary")
    return cut_lineage(needed.hint("merge").join(texts, "h").groupBy("name").agg(F.min("packed").alias("packed")))


def _rooted(docs: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of (doc_id, row, text), and (name, doc_id, first, root) of their classes: the smallest id, the first row, the component."""
    sketches = cut_lineage(sketched(docs, trees_for(share)))
    classes = cut_lineage(sketches.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "h", "row")).alias("first"), F.min("h").alias("h"), F.max("n").alias("n"), F.max("tokens").alias("tokens")))
    small, large = grow(classes, trees_for(share))
    facts = classes.select("name", "n", "tokens")
    paired = cut_lineage(with_partner(small.join(facts, "name"), share))

    # nodes with the same least member hold about the same group, in other trees or on other paths: they become one, of 32 nodes at most
    least = cut_lineage(large.groupBy("node").agg(F.min(F.xxhash64("name")).alias("like")))
    large = cut_lineage(large.join(least, "node").select(F.col("like").alias("node"), "name").distinct())
    sizes = cut_lineage(large.groupBy("node").agg(F.ceil(F.count("*") / SMALL).alias("parts")))
    # in parts of SMALL, each with a few members that all parts of the node share
    large = cut_lineage(large.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("name", F.lit(7)), F.col("parts"))))
    ties = large.groupBy("node").agg(F.max("parts").alias("parts"), *(F.min(F.struct(F.xxhash64("name", F.lit(k)).alias("h"), "name")).alias(f"t{k}") for k in range(4)))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)
    tied = ties.select("node", "parts", F.explode(F.array_distinct(F.array(*(F.col(f"t{k}.name") for k in range(4))))).alias("name")).select("node", "name", F.explode(upto("parts")).alias("part"))
    parts = large.select("node", "name", "part").unionByName(tied).select(F.xxhash64("node", "part").alias("node"), "name").distinct()
    texts = texts_of(paired.select("name").unionByName(large.select("name")), classes, docs)
    rows = paired.unionByName(parts).join(texts, "name").withColumn("root", F.col("name"))
    links = cut_lineage(links_within(rows, share).distinct())
    roots = cut_lineage(components(links))

    # members of large nodes that aren't in the node's main component meet all other members, in cells of two slices
    rooted = cut_lineage(large.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")))
    counts = rooted.groupBy("node", "root").agg(F.count("*").alias("k"))
    main = cut_lineage(counts.groupBy("node").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all")).select("node", F.col("m.root").alias("main"), "all", (F.col("all") - F.col("m.k")).alias("odd")).where("odd > 0"))
    if not main.isEmpty():
        cells = rooted.select("node", "name", "root").join(main, "node").withColumn("columns", F.ceil(F.col("all") / CELL)).withColumn("lines", F.ceil(F.col("odd") / CELL))
        hashed = lambda salt, n: F.pmod(F.xxhash64("name", F.lit(salt)), F.col(n))
        everyone = cells.select("node", "name", "root", hashed(1, "columns").alias("column"), F.explode(upto("lines")).alias("line"))
        odd = cells.where("root <> main").select("node", "name", "root", F.explode(upto("columns")).alias("column"), hashed(2, "lines").alias("line"))
        grid = everyone.unionByName(odd).select(F.xxhash64("node", "column", "line", F.lit(3)).alias("node"), "name", "root").distinct()
        links = cut_lineage(links.unionByName(links_within(grid.join(texts, "name"), share)).distinct())
        roots = cut_lineage(components(links))

    return sketches, classes.select("name", "doc_id", "first").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))


def near_duplicates(docs: DataFrame, share: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are confirmed at ``share`` in a hundred."""
    sketches, named = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "text"), share)
    least = cut_lineage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    own = cut_lineage(named.join(least, "root").select("name", "component_id"))
    linked = sketches.where("name is not null").join(own, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sketches.where("name is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_rows(docs: DataFrame, row: str, share: int = 85) -> DataFrame:
    """(row) of one row of each component: the smallest known id, on ties the least hash of id and text, then the least ``row``.

    ``row`` is a column of distinct longs that stays the same however often ``docs`` is read. A row without shingles is a component of its own.
    """
    def rows() -> DataFrame:
        sketches, named = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text"), share)
        return named.groupBy("root").agg(F.min("first").alias("first")).select("first.row").unionByName(sketches.where("name is null").select("row"))

    return last_table(rows)


def doubtful_rows(docs: DataFrame, row: str, share: int = 85) -> DataFrame:
    """(row, stays) of rows that can't simply stay: ``stays`` is false where another row of the component comes first, else the row stands several times.

    The first row is chosen as in ``first_rows``, but equal rows have equal longs ``row`` here.
    """
    def rows() -> DataFrame:
        sketches, named = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), "text"), share)
        first = named.groupBy("root").agg(F.min("first").alias("first")).select("first.row").distinct().withColumn("stays", F.lit(True))
        times = sketches.where("name is not null").groupBy("row").agg(F.count("*").alias("n"))
        return times.join(first, "row", "left").select("row", F.coalesce("stays", F.lit(False)).alias("stays"), "n").where("n > 1 or not stays").drop("n")

    return last_table(rows)
