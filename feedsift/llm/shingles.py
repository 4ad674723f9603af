"""SimHash near copies at a similarity of word shingles (operator 4 for the pipeline's third stage).

Rows of equal words are one node. A node's distinct shingles give a SimHash: COMPARED bits that are compared, and for each
table further bits that are its key. A pair just at similarity 0.8 differs in a bit with probability 0.15 (DIFFER at most, but
for four shingles against five, 0.1875). Keys get as many bits as leave about half a BLOCK of nodes to a bucket, and there are
as many tables as let such a pair share a key but for a chance of MISSED; it differs in more than RADIUS bits with less than
that. In a bucket, fingerprints are compared bit-sliced, and what is close is judged exactly, on the whole sets of shingles:
first, in buckets larger than a block, all with the bucket's leader, then each node with the first of those close to it, which
joins most of what belongs together; then, in blocks that still hold several classes, all close pairs of different classes
that were not judged yet where they meet: the texts go to the block, pairs never leave it, and of its links a spanning forest goes on."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET, bucket_of, joined, small_batches, stored, whole_groups, whole_text
from .graph import components, forest
from .simhash import close

#: Words of a shingle; the least similarity of near copies as a fraction; bits compared, and bits apart; the chance of a bit to
#: differ at the least similarity, and of such a pair to share no key.
WIDTH, ALIKE, COMPARED, RADIUS, DIFFER, MISSED = 5, (4, 5), 192, 60, 0.1611, 1e-6
#: Shingles counted at once (counts are bytes); nodes of a comparison block, of blocks compared together, and asked at once; bytes
#: of text in a bucket of pairs; bytes of a slab of pairs and of a bit matrix.
SLAB, BLOCK, TOGETHER, ASKED, BUCKET_BYTES, PAIR_BYTES, MATRIX_BYTES = 255, 1024, 128, 256, 8_000_000, 16_000_000, 32_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def key_bits(nodes: int) -> int:
    """Bits of a key that leave half a block of the nodes, or less, to a bucket on average."""
    return max(0, math.ceil(math.log2(max(1, nodes) / (BLOCK / 2))))


def tables(bits: int) -> int:
    """Tables, with keys of as many bits of their own, of which a pair shares one but for a chance of MISSED."""
    return math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** bits))) if bits else 1


def mixers(bits: int) -> np.ndarray:
    """(2, words): flips and odd factors that make of a shingle's hash the words of `bits` bits or more."""
    made = np.random.default_rng(5).integers(0, 1 << 63, (-(-bits // 64), 2), dtype=np.uint64) * np.uint64(2)
    return made.T + np.array([[0], [1]], dtype=np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """(n, 2): the distinct 128-bit hashes of the shingles of the text's words, sorted by the first number; fewer words than a
    shingle's make one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and only 20 and 09-0D are white space
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    hashes = np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]), dtype="<u8").reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def fingerprint(hashes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The SimHash, in 64-bit words, one of each of the mixers' columns: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64 * mixed.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), SLAB):
        x = (np.take(hashes[at : at + SLAB], np.arange(mixed.shape[1]) % 2, axis=1) ^ mixed[0]) * mixed[1]
        x ^= x >> np.uint64(29)
        x *= _MIX
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")


def table_keys(mark: np.ndarray, bits: int) -> np.ndarray:
    """The key of each table: its number and its own bits of the SimHash, behind those that are compared."""
    n = tables(bits)
    own = np.unpackbits(mark.view(np.uint8), bitorder="little")[COMPARED : COMPARED + n * bits].reshape(n, bits)
    return (np.arange(n) << bits) + own @ (1 << np.arange(bits))


MARKS = [f"f{k + 1}" for k in range(COMPARED // 64)]


def prints(rows: DataFrame, row_col: str, text_col: str, bits: int) -> DataFrame:
    """(row, k1, k2, f1 to f3, keys) of each row: the 128-bit key of its words, what is compared of its fingerprint, and table keys
    of as many bits (none without a word)."""
    mixed, columns = mixers(COMPARED + tables(bits) * bits), ["k1", "k2", *MARKS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, marks, keys = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                hashes = shingles(text)
                mark = fingerprint(hashes, mixed)
                names.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())))
                marks.append(mark[: len(MARKS)])
                keys.append(table_keys(mark, bits) if len(hashes) else np.zeros(0, dtype=np.int64))
            name, mark = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2), np.array(marks, dtype=np.int64).reshape(-1, len(MARKS))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), np.concatenate([np.zeros(0, dtype=np.int64), *keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.copy()) for x in np.hstack([name, mark]).T), lists], names=["row", *columns, "keys"])

    schema = ", ".join(["row long", *(f"{c} long" for c in columns), "keys array<long>"])
    return small_batches(rows).select(F.col(row_col).cast("long"), whole_text(text_col).alias("__text")).mapInArrow(run, schema)


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets[left[k]] and sets[right[k]] have at least the similarity, exactly. Shingles that two sets or more hold
    are columns of a bit matrix; what two sets share is counted in the bits that both of their rows have. Where the matrix might
    be too large, the pairs are cut in two, by the left set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    out = small * ALIKE[1] >= large * ALIKE[0]  # else even all of the smaller set would not do
    at = np.flatnonzero(out)
    if not len(at):
        return out
    if len(at) > 1 and len(sets) * sizes.sum() // 16 > MATRIX_BYTES:  # half of the pairs have fewer sets
        for half in np.array_split(at[np.argsort(left[at], kind="stable")], 2):
            rows, own = np.unique(np.concatenate([left[half], right[half]]), return_inverse=True)
            out[half] = alike([sets[k] for k in rows.tolist()], own[: len(half)], own[len(half) :])
        return out
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    held = n[column] > 1
    row, column = row[held], common[column[held]]
    words = max(1, -(-int((n > 1).sum()) // 64))
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    cell = row * words + column // 64
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    bits = np.zeros(len(sets) * words, dtype=np.uint64)
    if len(first):
        bits[cell[first]] = np.bitwise_or.reduceat(np.uint64(1) << (column % 64).astype(np.uint64), first)
    bits = bits.reshape(len(sets), words)
    for part in np.array_split(at, -(-len(at) * words * 8 // PAIR_BYTES)):
        both = np.bitwise_count(bits[left[part]] & bits[right[part]]).sum(axis=1, dtype=np.int64)
        out[part] = both * ALIKE[1] >= (sizes[left[part]] + sizes[right[part]] - both) * ALIKE[0]
    return out


def dealt_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, a, b) of the pairs, by leader (b); the pairs of a leader whose partners' texts fill more than a bucket are dealt to
    as many parts as they fill, by a hash of the partner."""
    sizes = pairs.join(texts.select(F.col("node").alias("a"), F.octet_length("text").cast("long").alias("n")), "a").groupBy("b").agg(F.sum("n").alias("n"))
    sizes = stored(sizes, "leaders")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_BYTES)).cast("long")
    cut = joined(pairs, sizes, ["b"], F.col("n") > 0.001 * total).withColumn("part", F.pmod(F.xxhash64("a"), parts))
    return cut.select(bucket_of(max(1, -(-int(total) // BUCKET_BYTES)), "b", "part").alias(BUCKET), "a", "b")


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are near copies. A bucket of pairs is told each of its texts once, so a node
    of many pairs is no large group."""
    dealt = dealt_pairs(pairs, texts)
    asked = dealt.select(BUCKET, F.explode(F.array("a", "b")).alias("node")).distinct()

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        node = right.column("node").to_numpy()
        order = np.argsort(node)
        sets = [shingles(t.as_py())[:, 0] for t in right.column("text")]
        a, b = (left.column(x).to_numpy() for x in ("a", "b"))
        same = alike(sets, *(order[np.searchsorted(node[order], x)] for x in (b, a)))  # by leader
        return pa.table({"a": a[same], "b": b[same]})

    answers = asked.join(texts, "node").select(F.col(BUCKET).alias("__asker"), "node", "text")
    return dealt.groupBy(BUCKET).cogroup(answers.groupBy("__asker")).applyInArrow(judge, "a long, b long")


KEYS = ["key", "__low", "__high"]
ROWS = [*KEYS, "__chunk", "node", *MARKS, "class"]


def large_buckets(bands: DataFrame, prints: DataFrame) -> DataFrame:
    """(key, lead, l1 to l3) of the buckets of more than a block. A leader is the first by a hash that is the same in all buckets,
    so that it leads many of them."""
    first = F.xxhash64("node")
    found = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).filter(F.col("n") > BLOCK), "large")
    leads = prints.select(first.alias("first"), F.col("node").alias("lead"), *(F.col(f).alias(f"l{k}") for k, f in enumerate(MARKS, 1)))
    return stored(found.join(leads, "first").drop("n", "first").dropDuplicates(["key"]), "leads")


def apart_bits() -> Column:
    """Bits in which a row differs from its bucket's leader."""
    return sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"l{k}"))) for k, f in enumerate(MARKS, 1)), F.lit(0))


def comparison_blocks(bands: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of bands (key, node, f1 to f3, class) in blocks of about BLOCK rows, or fewer, for comparison; large: (key, own) of
    the buckets that are cut, with their leader's class.

    Each two chunks of a large bucket make a block, but for two of the leader's class, which need not meet: so a bucket
    that one class fills grows in proportion to it."""
    inside = F.col("class") == F.col("own")
    counts = bands.join(large, "key").groupBy("key", "own").agg(F.ceil(F.count_if(inside) / BLOCK).cast("int").alias("led"), F.ceil(F.count_if(~inside) / BLOCK).cast("int").alias("rest"))
    cut, scattered = F.col("own").isNotNull(), F.xxhash64("node", F.lit("chunk"))
    of_class, of_rest = F.pmod(scattered, F.greatest("led", F.lit(1))), F.col("led") + F.pmod(scattered, F.greatest("rest", F.lit(1)))
    chunk = F.when(~cut, 0).when(inside, of_class).otherwise(of_rest).cast("int")
    last = F.col("led") + F.col("rest") - 1
    others = F.when(~cut, F.array(F.lit(0))).when(~inside, F.sequence(F.lit(0), last)).when(F.col("rest") > 0, F.sequence("led", last))
    out = bands.join(stored(counts, "counts"), "key", "left").withColumn("__chunk", chunk).withColumn("__other", F.explode(others))
    return out.withColumn("__low", F.least("__chunk", "__other")).withColumn("__high", F.greatest("__chunk", "__other")).select(*ROWS)


def close_pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions (i, j) in the table, sorted by KEYS, of pairs of one block that are close and of different classes. Small
    blocks are compared together."""
    columns = [group.column(x).to_numpy() for x in KEYS]
    own, chunk = (group.column(x).to_numpy() for x in ("class", "__chunk"))
    mark = np.stack([group.column(f).to_numpy() for f in MARKS], axis=1).view(np.uint64)
    new = np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in columns], axis=0)
    block, starts = np.cumsum(new), [*np.flatnonzero(new).tolist(), group.num_rows]
    crossed = columns[1] != columns[2]  # blocks of two chunks
    at = 0
    while at < len(starts) - 1:
        upto = at + 1
        while upto < len(starts) - 1 and not crossed[starts[at]] and not crossed[starts[upto]] and starts[upto + 1] - starts[at] <= TOGETHER:
            upto += 1
        here = np.arange(starts[at], starts[upto])
        left, right = (here[chunk[here] == c[starts[at]]] for c in columns[1:]) if crossed[starts[at]] else (here, here)
        for part in range(0, len(left), ASKED):
            asked, others = left[part : part + ASKED], right if crossed[starts[at]] else right[part:]
            if not len(others):
                break
            i, j = close(mark[asked], mark[others], RADIUS)
            i, j = asked[i], others[j]
            apart = (own[i] != own[j]) & (block[i] == block[j]) & ((i < j) | crossed[i])
            yield i[apart], j[apart]
        at = upto


def met(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that have a close partner of another class in their block, with the first of these (lead) by a hash that is
    the same in all blocks, or null where the row itself comes before them, and whether it is in a pair with no lead's (more)."""

    def involved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, KEYS, BLOCK):
            found = list(close_pairs(group))
            i, j = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[k] for f in found)]) for k in (0, 1))
            if not len(i):
                continue
            node = group.column("node").to_numpy()
            rank = (node.astype(np.uint64) + np.uint64(1)) * _MIX
            own, other = np.concatenate([i, j]), np.concatenate([j, i])
            order = np.lexsort((rank[other], own))
            rows, first = np.unique(own[order], return_index=True)
            lead = other[order][first]
            later = rank[lead] > rank[rows]
            first_of = np.full(group.num_rows, -1)
            first_of[rows[~later]] = lead[~later]
            told = (first_of[i] == j) | (first_of[j] == i)
            more = np.isin(rows, np.concatenate([i[~told], j[~told]]))
            yield from group.take(rows).append_column("lead", pa.array(node[lead], pa.int64(), mask=later)).append_column("more", pa.array(more)).combine_chunks().to_batches()

    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ROWS) + ", lead long, more boolean"
    return blocks.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(involved, schema)


def met_links(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join whatever near copies of different classes share a block. First each block tells which of its nodes
    have a close partner; only their texts then go there."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, KEYS, BLOCK):
            sets: dict[int, np.ndarray] = {}
            node, text = group.column("node").to_numpy(), group.column("text")
            for i, j in close_pairs(group):
                rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                if not len(rows):
                    continue
                sets = {int(node[k]): sets[int(node[k])] if int(node[k]) in sets else shingles(text[k].as_py())[:, 0] for k in rows.tolist()}
                i, j = at[: len(i)], at[len(i) :]
                same = alike([sets[int(node[k])] for k in rows.tolist()], i, j)
                a, b = forest(len(rows), i[same], j[same])
                yield pa.RecordBatch.from_arrays([pa.array(node[rows[a]]), pa.array(node[rows[b]])], names=["a", "b"])

    asked = met(blocks).drop("lead", "more").join(texts, "node")
    return asked.repartition(*KEYS).sortWithinPartitions(*KEYS).select(*ROWS, "text").mapInArrow(link, "a long, b long").distinct()


def classed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the class of their node by the links."""
    return rows.join(components(links), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")


def survivors(rows: DataFrame, row_col: str, order: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """(row) of one row of each class of near copies, that which comes first by the order columns (nulls last) and then by
    row. row_col: unique whole numbers, none null, the same whenever rows is read.

    Null texts and texts without a word are one class; a text of fewer words than a shingle's is near those of the same words
    only. Equal rows are one class. Other columns are ignored; an empty table gives an empty result."""
    rank = F.struct(*(x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"null{k}"), F.col(c).alias(f"by{k}"))), F.col(row_col).cast("long").alias("row"))
    found = stored(prints(rows, row_col, text_col, key_bits(rows.count())), "prints")
    ranked = found.select("row", "k1", "k2").join(rows.select(F.col(row_col).cast("long").alias("row"), rank.alias("rank")), "row") if order else found.withColumn("rank", F.struct("row"))
    nodes = stored(ranked.groupBy("k1", "k2").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("node"), "rank"), "nodes")
    marked = stored(found.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi").select("node", *MARKS, "keys"), "marked")
    texts = rows.select(F.col(row_col).cast("long").alias("node"), whole_text(text_col).alias("text"))

    def texts_of(some: DataFrame) -> DataFrame:
        return stored(texts.join(some.distinct(), "node", "left_semi"), "texts")

    bands = marked.select("node", *MARKS, F.explode("keys").alias("key"))
    leads = large_buckets(bands, marked)
    pairs = bands.join(leads, "key").filter((F.col("node") != F.col("lead")) & (apart_bits() <= RADIUS))
    pairs = stored(pairs.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    led = stored(judged(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))), "led")
    known = stored(classed(marked, led), "known")
    large = leads.select("key", F.col("lead").alias("node")).join(known.select("node", F.col("class").alias("own")), "node").select("key", "own")
    blocks = comparison_blocks(known.select("node", *MARKS, "class", F.explode("keys").alias("key")), stored(large, "large"))
    close_rows = stored(met(blocks), "met")
    texts = texts_of(close_rows.select("node"))
    pairs = stored(close_rows.filter("lead IS NOT NULL").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    led = stored(led.union(judged(pairs, texts)), "led")
    left = classed(close_rows.filter("more").drop("class", "lead", "more"), led)
    mixed = left.groupBy(*KEYS).agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select(*KEYS)
    left = stored(left.join(mixed, KEYS).select(*ROWS), "left")
    named = classed(nodes, led.union(met_links(left, texts)))
    return named.groupBy("class").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
