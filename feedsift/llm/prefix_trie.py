"""The trie of conversations' common beginnings (operator 13).

Turns are sorted by conversation and place over all partitions; a scan that runs across them numbers each conversation's turns
and gives every prefix a hash of 128 bits: two sums of turn hashes times powers of odd bases modulo 2^64. Prefixes of other
conversations are put in front of a rest by arithmetic on these sums alone, so no text moves. Equal prefixes are
a node; totals over subtrees come from tree contraction (see contraction)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.operators import scan

from .common import joined, stored
from .contraction import subtree_totals

#: Odd bases of the two sums, and what marks the second turn hash off from the first.
BASES, SECOND = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), 13
WORD = (1 << 64) - 1
KEY = ["depth", "k1", "k2"]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2^64."""
    out, base, left = np.ones(len(exponents), dtype=np.uint64), base & WORD, np.asarray(exponents, dtype=np.int64)
    while left.any():
        out = np.where(left & 1, out * np.uint64(base), out)
        base, left = base * base & WORD, left >> 1
    return out


def join_sums(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """(length, sum, sum) of one run of turns and the next."""
    return (a[0] + b[0], *((x + pow(base, a[0], 1 << 64) * y) & WORD for base, x, y in zip(BASES, a[1:], b[1:], strict=True)))


def local_prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a partition's sorted (conv, t1, t2, bytes): each turn's place and sums within the partition's part of its
    conversation, and the sums before it."""
    number, conv, held = TaskContext.get().partitionId(), None, (0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(0).to_numpy()
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[1:] != own[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        goes_on = conv is not None and own[0] == conv
        place = np.arange(1, len(own) + 1) - starts[group] + np.where((group == 0) & goes_on, held[0], 0)
        columns, ends = [], [int(place[-1])]
        for k, base in enumerate(BASES):
            term = batch.column(1 + k).to_numpy().view(np.uint64) * power(base, place)
            total = np.cumsum(term, dtype=np.uint64)
            sums = total - (total - term)[starts][group]
            if goes_on:
                sums[group == 0] += np.uint64(held[1 + k])
            columns += [pa.array(sums.view(np.int64)), pa.array((sums - term).view(np.int64))]
            ends.append(int(sums[-1]))
        conv, held = own[-1], tuple(ends)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number, dtype=np.int32)), batch.column(0), pa.array(place), columns[0], columns[2], columns[1], columns[3], batch.column(3)], names=["part", "conv", "pos", "s1", "s2", "p1", "p2", "bytes"])


def prefixes(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, s1, s2, p1, p2, bytes) of each turn: its place in its conversation, the sums up to it and before it, the bytes
    of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(SECOND), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    dealt = scan.ranged(turns, F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t1").asc(), F.col("t2").asc())
    names = ["conv", "pos", "s1", "s2", "p1", "p2", "bytes"]
    local = stored(dealt.select("conv", "t1", "t2", "bytes").mapInArrow(local_prefixes, "part int, " + ", ".join(f"{c} long" for c in names)), "turns")
    last = F.max_by(F.struct("conv", "pos", "s1", "s2"), F.struct("conv", "pos")).alias("last")
    parts = local.groupBy("part").agg(F.min("conv").alias("first"), last).collect()  # a row for each partition
    brought = scan.carried([(r["part"], r["first"], (r["last"]["conv"], (r["last"]["pos"], r["last"]["s1"] & WORD, r["last"]["s2"] & WORD)), r["first"] == r["last"]["conv"]) for r in parts], join_sums, (0, 0, 0))
    size = max(brought, default=-1) + 1
    first, carry = np.zeros(size, dtype=np.int64), np.zeros((3, size), dtype=np.uint64)
    for r in parts:
        first[r["part"]], carry[:, r["part"]] = r["first"], np.array(brought[r["part"]], dtype=np.uint64)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, pos, *sums, _ = (c.to_numpy() for c in batch.columns)
            here = np.where(conv == first[part], part, size)  # only what goes on from the partition before carries
            before = [np.append(c, np.uint64(0))[here] for c in carry]
            offset = before[0].astype(np.int64)
            shifted = [(before[1 + k % 2] + power(BASES[k % 2], offset) * s.view(np.uint64)).view(np.int64) for k, s in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pos + offset), *map(pa.array, shifted), batch.column(7)], names=names)

    return local.mapInArrow(whole, ", ".join(f"{c} long" for c in names))


def moved_sums(h1: pa.Array, h2: pa.Array, b1: pa.Array, b2: pa.Array, s1: pa.Array, s2: pa.Array, p1: pa.Array, p2: pa.Array, shift: pa.Array) -> pa.Array:
    """The sums of a prefix made of another one (h) and of what lies behind b in a conversation (s, and p before its last turn),
    `shift` places further to the front."""
    head, base, sums, prev, back = (h1, h2), (b1, b2), (s1, s2), (p1, p2), shift.to_numpy()
    number = lambda a: a.to_numpy(zero_copy_only=False).view(np.uint64)
    out = [(number(head[k]) + (number(x[k]) - number(base[k])) * power(pow(BASES[k], -1, 1 << 64), back)).view(np.int64) for x in (sums, prev) for k in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["k1", "k2", "p1", "p2"])


def rebuilt(turns: DataFrame, heads: Column, least: int, source: Column) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, k1, k2, p1, p2, bytes, last) for the turns of the rebuilt conversations, and (conv, size) of all.

    Each conversation is rebuilt of the first `heads` turns (a column over conv, `least` at most) of the conversation `source`
    (a column over conv) and its own turns behind its first `heads`."""
    at = turns.withColumn("h", heads)
    convs = at.groupBy("conv").agg(F.max("pos").alias("len"), F.max("h").cast("long").alias("h"), F.max(F.when(F.col("pos") == F.col("h"), F.struct("s1", "s2"))).alias("cut"))
    first = turns.filter(F.col("pos") <= least).groupBy(F.col("conv").alias("of")).agg(F.array_sort(F.collect_list(F.struct("pos", "s1", "s2", "p1", "p2", "bytes"))).alias("head"))  # `least` turns each
    known = convs.withColumn("of", source).join(first, "of", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos: long, s1: long, s2: long, p1: long, p2: long, bytes: long>>")), F.lit(1), F.col("h").cast("int")))
    known = known.withColumn("m", F.size("head").cast("long")).withColumn("top", F.when(F.col("m") > 0, F.element_at("head", -1)))
    known = stored(known.select("conv", "len", "h", "m", "head", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in (("top.s1", "h1"), ("top.s2", "h2"), ("cut.s1", "b1"), ("cut.s2", "b2")))), "conversations")
    put = known.select("conv", "len", "h", "m", F.explode("head").alias("x")).select("conv", F.col("x.pos").alias("depth"), F.col("x.s1").alias("k1"), F.col("x.s2").alias("k2"), F.col("x.p1").alias("p1"), F.col("x.p2").alias("p2"), F.col("x.bytes").alias("bytes"), ((F.col("x.pos") == F.col("m")) & (F.col("len") <= F.col("h"))).alias("last"))
    total = known.agg(F.sum("len")).first()[0] or 0
    own = joined(turns, known.drop("head"), ["conv"], F.col("len") > total * 0.001).filter(F.col("pos") > F.col("h"))
    behind = F.arrow_udf(moved_sums, "struct<k1: long, k2: long, p1: long, p2: long>")
    own = own.withColumn("n", behind("h1", "h2", "b1", "b2", "s1", "s2", "p1", "p2", F.col("h") - F.col("m")))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "n.k1", "n.k2", "n.p1", "n.p2", "bytes", (F.col("pos") == F.col("len")).alias("last"))
    return put.union(own), known.select("conv", (F.col("m") + F.greatest(F.lit(0), F.col("len") - F.col("h"))).alias("size"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, conv): the ids that end at a node, ascending, joined by commas.

    Ids are sorted over all partitions and joined there to texts of one batch each; a node's texts are then hashed in their order,
    one after the other, so even a node at which a third of all conversations end holds a batch in memory at a time."""
    dealt = scan.ranged(ends.select(*KEY, "conv"), *(F.col(c).asc() for c in (*KEY, "conv")))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([c.to_numpy() for c in batch.columns])
            starts = np.flatnonzero(np.concatenate([[True], (values[:3, 1:] != values[:3, :-1]).any(axis=0)]))
            ids = values[3].tolist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[starts]) for v in values), pa.array(texts)], names=[*KEY, "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield table(done)
        if node:
            yield table([(*node, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*KEY, "ends_sha256"])

    texts = dealt.mapInArrow(chunks, "depth long, k1 long, k2 long, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, heads: Column | None = None, least: int = 8, every: int = 5, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the rebuilt conversations' trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), as op13 defines them. heads: how many turns come from the conversation of id c - c % `every`, as SQL has
    remainders (a column over conv; `least` at most; none without it, so that conversations stay as they are).

    Turns are ordered by turn (null first), equal ones by role and then by hashes of role and text; null roles and texts are
    empty; a repeated row is one more turn. Rows without a conv_id belong to no conversation and are left. Other columns are
    ignored. An empty table has no node."""
    conv = F.col("conv")
    turns = prefixes(rows, id_col, turn_col, role_col, text_col)
    steps, sizes = rebuilt(turns, F.lit(0) if heads is None else heads, least, conv - conv % every)
    steps = stored(steps, "steps")
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    grouped = steps.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes"))
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(*zero, "conv_id", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "bytes")))
    nodes = stored(grouped.select(*root.columns).union(root).withColumn("id", F.monotonically_increasing_id()), "nodes")  # written once: the ids stay
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings")).filter("siblings > 0")
    hung = joined(nodes.filter("depth > 0"), parents, ["depth", "p1", "p2"], F.col("siblings") > nodes.count() * 0.001)
    tree = stored(hung.select(*nodes.columns, "parent", "parent_conv_id").union(nodes.filter("depth = 0").select(*nodes.columns, *(F.lit(None).cast("long").alias(c) for c in ("parent", "parent_conv_id")))), "tree")
    leaf, saved = (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    totals = subtree_totals(tree.select("id", "parent", leaf, saved), ["n_leaves", "saved_tokens"])
    ends = stored(steps.filter("last").select(*KEY, "conv").union(sizes.filter("size = 0").select(*zero, "conv")), "ends")
    out = tree.join(totals, "id").join(ends_digests(ends), KEY, "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
