"""Conversations as a prefix tree: turns that several conversations start with are emitted once.

A turn becomes ``<s>[INST] role [/INST]text</s>`` in token ids; inside roles and texts a backslash escapes itself and the
first character of every control string, so no control string can stand in a text. Conversations are sorted by the chain of
their turns' hashes, which is the depth-first order of the tree; a turn belongs to the first conversation in that order
that has it. Each node carries its place in the emitted stream, its position ids (they go on from its ancestors) and the stream
intervals of its ancestors, which with the node's own earlier tokens is all that it may attend to.

Nulls: a null text or role is an empty one; rows with a null conv_id are one conversation; a null turn comes first. Rows of
equal turn follow by role and text, repeated rows are turns of their own. An empty table gives no rows. Other columns
are not read. A single conversation is held by one task.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import once, slices
from tapeloom.llm.words import encoder
from tapeloom.session import cut_lineage

LEARNED_ROLE = "assistant"
TURN = re.compile(r"<s>\[INST\] (.*) \[/INST\](.*)</s>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "b": "["}[m[1]], text)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def build(rows: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (start, tokens, position, loss_from, loss_to, attends) in stream order, and conversations (conv_id, starts)."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file of a few MB
    empty = F.lit("")
    talks = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def chain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            paths = []
            for turns in batch.column("turns").to_pylist():
                at, path = b"", []
                for t in turns:
                    at = hashlib.sha256(at + escape(t["role"]).encode() + b"[" + t["text"].encode()).digest()[:16]
                    path.append(at)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array(paths, pa.list_(pa.binary()))], ["conv_id", "turns", "path"])

    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, turns array<struct<turn:{kind['turn']},role:string,text:string>>, path array<binary>"
    ordered = cut_lineage(talks.mapInArrow(chain, schema).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
    ranked = cut_lineage(ordered.withColumn("r", F.monotonically_increasing_id()).select("r", "conv_id", "path", "turns"))
    steps = ranked.select("r", F.posexplode("path").alias("depth", "node"))
    owners = cut_lineage(steps.groupBy("node").agg(F.min("r").alias("owner")))

    # the conversations' own turns, in tokens
    own_from = steps.join(owners, "node").where("r = owner").groupBy("r").agg(F.min("depth").alias("first"))

    def emit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids_of = encoder("byte_words", shipped.value)
        before = 0
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                position = 0
                for depth, t in enumerate(row["turns"]):
                    head, body, tail = ids_of([f"<s>[INST] {escape(t['role'])} [/INST]", escape(t["text"]), "</s>"])
                    a, b = len(head) // 4, (len(head) + len(body)) // 4
                    ids = np.frombuffer(head + body + tail, "<i4")
                    if row["first"] is not None and depth >= row["first"]:
                        learned = t["role"] == LEARNED_ROLE
                        out.append((row["path"][depth], TaskContext.get().partitionId(), before, position, a if learned else None, b if learned else None, ids))
                        before += len(ids)
                    position += len(ids)
            names = ["node", "part", "place", "position", "loss_from", "loss_to", "tokens"]
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[at:at + 5000]), kinds)], names)

    made = cut_lineage(
        ranked.join(own_from, "r", "left").select("r", "path", "turns", "first").repartitionByRange("r").sortWithinPartitions("r")
        .mapInArrow(emit, "node binary, part int, place long, position long, loss_from int, loss_to int, tokens array<int>")
    )
    base, before = [(-1, 0)], 0
    for part, n in sorted((r.part, r.n) for r in made.groupBy("part").agg(F.sum(F.size("tokens")).alias("n")).collect()):  # a row per partition
        base.append((part, before))
        before += n
    placed = made.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part").withColumn("start", F.col("base") + F.col("place"))

    spans = placed.select("node", "start", F.size("tokens").alias("n"))
    walks = cut_lineage(
        steps.join(spans, "node").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "n"))).alias("walk"))
        .join(ranked.select("r", "conv_id"), "r").join(own_from, "r", "left").select("conv_id", "walk", "first")
    )

    def ancestors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            starts, attends = [], []
            for row in batch.to_pylist():
                so_far: list[tuple[int, int]] = []
                for step in row["walk"]:
                    if row["first"] is not None and step["depth"] >= row["first"]:
                        starts.append(step["start"])
                        attends.append([{"start": a, "stop": b} for a, b in so_far])
                    so_far = merge([*so_far, (step["start"], step["start"] + step["n"])])
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(attends, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["start", "attends"])

    seen = walks.where("first is not null").mapInArrow(ancestors, "start long, attends array<struct<start:long,stop:long>>")
    nodes = placed.join(seen, "start").select("start", "tokens", "position", "loss_from", "loss_to", "attends")
    return cut_lineage(nodes), walks.select("conv_id", F.transform("walk", lambda x: x["start"]).alias("starts"))


def read_back(nodes: DataFrame, talks: DataFrame, vocabulary: str) -> DataFrame:
    """Each conversation from the emitted tokens: turns (role, text, learned text) and its formatted length."""
    spark = nodes.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    kind = dict(talks.dtypes)["conv_id"]

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from tokenizers import Tokenizer

        tok = once(("decoder", len(shipped.value)), lambda: Tokenizer.from_str(shipped.value))
        say = lambda ids: tok.decode(ids, skip_special_tokens=False)
        for batch in slices(batches):
            out = []
            for nodes in batch.column("nodes").to_pylist():
                turns, chars = [], 0
                for n in nodes:
                    whole = say(n["tokens"])
                    role, text = TURN.fullmatch(whole).groups()
                    learned = None if n["loss_from"] is None else unescape(say(n["tokens"][n["loss_from"]:n["loss_to"]]))
                    turns.append({"role": unescape(role), "text": unescape(text), "learned": learned})
                    chars += len(whole)
                out.append({"turns": turns, "chars": chars})
            kinds = pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("learned", pa.string())]))), ("chars", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, kinds)], ["conv_id", "read"])

    met = talks.withColumn("_k", F.monotonically_increasing_id()).select("conv_id", "_k", F.posexplode("starts").alias("depth", "start")).join(nodes, "start")
    whole = met.groupBy("_k").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "tokens", "loss_from", "loss_to"))).alias("nodes"))
    return whole.select("conv_id", "nodes").mapInArrow(decode, f"conv_id {kind}, read struct<turns:array<struct<role:string,text:string,learned:string>>,chars:long>").select("conv_id", "read.turns", "read.chars")
