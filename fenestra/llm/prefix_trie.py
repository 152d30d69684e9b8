"""Prefix tries of conversations (operator 13).

A node is a distinct sequence of first turns; it is named by a chained digest, so
that its name needs only its parent's name and its last turn. Conversations are read
in order, turn by turn, and equal nodes meet in one aggregation, before which every
task has already added up its own copies.

Nodes that many conversations share are the upper levels; below them the nodes fall
into shards by the first node on their path that few share. Each shard becomes a
succinct trie in level order (LOUDS): a bit vector with a one for every child and a
zero at the end of every node, and an array of labels. Sums over subtrees are made in
reverse level order. The upper levels, whose number is bounded, are a trie of the
same kind, to which the shards' roots have added their sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.llm.common import Scratch

#: Bytes of a node's name, cut from BLAKE2b; of a turn's digest, cut from SHA-256.
NAME = 16
ROOT = bytes(NAME)
#: A node that more conversations share belongs to the upper levels, which MAX_UPPER bounds.
SHARED_BY = 64
MAX_UPPER = 500_000
#: Nodes of a shard, about; what one light root has below it stays together.
SHARD_NODES = 50_000
#: Identifiers in one stretch of a list of ends.
STRETCH = 4096

NODE_FIELDS = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


class Louds:
    """A forest in level order below a root of its own: one bit per edge and one per node.

    Node 0 is the added root; children of a node are consecutive. `labels[i - 1]` is
    the name of node i. `order` gives, for node i, the row that it came from.
    """

    def __init__(self, names: np.ndarray, parents: np.ndarray):
        by_name = np.argsort(names, kind="stable")
        found = np.searchsorted(names, parents, sorter=by_name).clip(max=max(len(names) - 1, 0))
        row = by_name[found] if len(names) else found
        up = np.where(names[row] == parents, row, -1) if len(names) else row
        first = np.argsort(up, kind="stable")  # rows by parent, roots first
        begins = np.searchsorted(up[first], np.arange(-1, len(names) + 1))
        level, levels = np.array([-1]), []
        while True:
            n = begins[level + 2] - begins[level + 1]
            if not n.sum():
                break
            ends = np.cumsum(n)
            below = first[np.repeat(begins[level + 1] - ends + n, n) + np.arange(ends[-1])]
            owner = np.repeat(np.arange(len(level)), n)
            level = below[np.lexsort((names[below], owner))]
            levels.append(level)
        self.order = np.concatenate(levels) if levels else np.zeros(0, dtype=np.int64)
        self.bounds = np.cumsum([1, *map(len, levels)])  # node numbers where levels begin
        degree = np.concatenate([begins[1:2] - begins[:1], (begins[2:] - begins[1:-1])[self.order]]) if len(names) else np.zeros(1, dtype=np.int64)
        self.bits = np.ones(len(self.order) + len(degree), dtype=bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.labels = names[self.order]
        self._index()

    def _index(self) -> None:
        zeros = np.cumsum(~self.bits)
        self.ends = np.flatnonzero(~self.bits)
        self.parent = np.concatenate([[-1], zeros[self.bits]])  # zeros before the bit of node i
        self.degree = np.diff(self.ends, prepend=-1) - 1

    @classmethod
    def stored(cls, bits: bytes, labels: bytes) -> Louds:
        """From `bits` and `labels` of a row of `tries`."""
        self = cls.__new__(cls)
        self.labels = np.frombuffer(labels, dtype=f"S{NAME}")
        self.bits = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=2 * len(self.labels) + 1).astype(bool)
        self._index()
        return self

    def children(self, node: int) -> range:
        begin = (int(self.ends[node - 1]) + 1 if node else 0) - node + 1
        return range(begin, begin + int(self.degree[node]))

    def find(self, name: bytes, node: int) -> int:
        """The child of `node` with that name, or -1; children are in the order of their names."""
        own, name = self.children(node), np.bytes_(name.rstrip(b"\0"))  # as the labels are compared
        at = own.start - 1 + int(np.searchsorted(self.labels[own.start - 1 : own.stop - 1], name))
        return at + 1 if at + 1 < own.stop and self.labels[at] == name else -1

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, of values by node (node 0 first), in reverse level order."""
        sums = values.copy()
        for a, b in zip(self.bounds[-2::-1], self.bounds[:0:-1], strict=True):
            np.add.at(sums, self.parent[a:b], sums[a:b])
        return sums


def names_of(column: pa.ChunkedArray) -> np.ndarray:
    """As fixed-size bytes; no node is named "none", which stands for no parent."""
    return np.array([b"none" if v is None else v for v in column.to_pylist()], dtype=f"S{NAME}")


def roll_up(nodes: pa.Table) -> pa.Table:
    """A shard's nodes with their sums; `up` is the name of the parent where that is in another trie."""
    trie = Louds(names_of(nodes["node"]), names_of(nodes["parent"]))
    at = {c: nodes[c].to_numpy()[trie.order] for c in ("conv_id", "depth", "n_convs", "size", "more_children", "more_leaves", "more_saved")}
    degree = trie.degree[1:] + at["more_children"]
    leaves = trie.add_up(np.concatenate([[0], np.where(degree == 0, 1, at["more_leaves"])]))[1:]
    saved = trie.add_up(np.concatenate([[0], (at["n_convs"] - 1) * at["size"] + at["more_saved"]]))[1:]
    parent, top = trie.parent[1:], trie.parent[1:] == 0
    out = {
        "node": nodes["node"].take(pa.array(trie.order)), "up": pa.array([p if t else None for p, t in zip(nodes["parent"].take(pa.array(trie.order)).to_pylist(), top, strict=True)], pa.binary()),
        "conv_id": pa.array(at["conv_id"]), "depth": pa.array(at["depth"]), "parent_conv_id": pa.array(at["conv_id"][np.maximum(parent - 1, 0)], mask=top), "n_convs": pa.array(at["n_convs"]),
        "n_children": pa.array(degree), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved),
    }
    return pa.table(out)


def turn_rows(conversations: DataFrame, family: int) -> DataFrame:
    """(base, conv_id, turn, digest, size): turns without their texts."""
    conv, role, text = F.col("conv_id").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % family).alias("base"), conv.alias("conv_id"), F.col("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * NAME)).alias("digest"), F.octet_length(text).cast("bigint").alias("size")
    )


def paths(turns: DataFrame, shares: Callable[[int], int], most: int, upper: frozenset[bytes], n_shards: int, parts: int) -> DataFrame:
    """(conv_id, depth, node, parent, size, ends, shard): a row for each conversation at each depth from 0.

    `ends` is 1 at its last turn. `shard` is -1 in the upper levels. Turns pass by in
    order, one at a time: what is kept of a family are the first turns of its first
    conversation, `most` at most, which `shares` never exceeds. Turns of one
    conversation with the same number are in the order of their digests.
    """
    spark = turns.sparkSession
    known = spark.sparkContext.broadcast(upper)
    ordered = turns.repartition(parts, "base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, digest_of = known.value, hashlib.blake2b
        base = conv = None
        lead: list[tuple[bytes, int]] = []
        rows: list[list] = []
        name, depth, shard, skip = ROOT, 0, -1, 0

        def step(digest: bytes, size: int) -> None:
            nonlocal name, depth, shard
            parent, name, depth = name, digest_of(name + digest, digest_size=NAME).digest(), depth + 1
            if shard < 0 and name not in upper:
                shard = int.from_bytes(name[:8], "little") % n_shards
            rows.append([conv, depth, name, parent, size, 0, shard])

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "depth", "node", "parent", "size", "ends", "shard"])

        for batch in batches:
            for b, c, digest, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != base:
                    base, lead = b, []
                if c != conv:
                    if rows:
                        rows[-1][5] = 1
                    conv, name, depth, shard = c, ROOT, 0, -1
                    rows.append([c, 0, ROOT, None, 0, 0, -1])
                    skip = 0 if c == b else shares(c)
                    for first in lead[:skip]:
                        step(*first)
                if c == b and len(lead) < most:
                    lead.append((digest, size))
                if skip:
                    skip -= 1
                else:
                    step(digest, size)
            if len(rows) > 1:  # the last row waits: it may be its conversation's end
                yield batch_of(rows[:-1])
                del rows[:-1]
        if rows:
            rows[-1][5] = 1
            yield batch_of(rows)

    return ordered.select("base", "conv_id", "digest", "size").mapInArrow(walk, "conv_id bigint, depth bigint, node binary, parent binary, size bigint, ends bigint, shard bigint")


def end_lists(rows: DataFrame, parts: int) -> DataFrame:
    """(node, ends_sha256): the hash of the ids of conversations that end at a node, ascending, joined by commas.

    Ids are put into stretches first, where many tasks share a node; the hash, which
    is sequential, then reads a row for each stretch.
    """
    ends = rows.where("ends = 1").select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, list[int]]] = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out and out[-1][0] == node and len(out[-1][2]) < STRETCH:
                    out[-1][2].append(conv)
                else:
                    out.append((node, conv, [conv]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([",".join(map(str, o[2])) for o in out])], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    pieces = ends.mapInArrow(stretches, "node binary, first bigint, ids string")
    return pieces.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def no_shares(conv_id: int) -> int:
    return 0


def crc_shares(conv_id: int) -> int:
    """As the query's contract has it: 0 to 8, by the CRC-32 of the decimal identifier."""
    return zlib.crc32(str(conv_id).encode()) % 9


def trie_nodes(kept: Scratch, conversations: DataFrame, family: int, shares: Callable[[int], int], most: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows of `paths`, and distinct nodes (shard, node, parent, conv_id, depth, n_convs, size)."""
    spark = conversations.sparkSession
    turns = kept.put(turn_rows(conversations, family))
    n, parts = turns.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = max(parts, n // 500_000)
    shared_by = max(SHARED_BY, (2 + most) * n // MAX_UPPER)  # of n turns, at most (2 + most) * n rows are made
    common = paths(turns, shares, most, frozenset(), 1, parts).groupBy("node").count().where(F.col("count") > shared_by).select("node")
    upper = frozenset(common.toArrow()["node"].to_pylist())  # at most MAX_UPPER names
    n_shards = max(4 * parts, n // SHARD_NODES)
    rows = kept.put(paths(turns, shares, most, upper, n_shards, parts))
    nodes = rows.groupBy("shard", "node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("size").alias("size"))
    return rows, kept.put(nodes)


def prefix_trie(conversations: DataFrame, *, family: int = 1, shares: Callable[[int], int] = no_shares, most: int = 0) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first turns (role, text) of a conversation,
    and is named by its smallest conversation and its depth. With `shares`, every
    conversation c first has that many (at most `most`) of the first turns of
    conversation c - c % family, and then its own from there on.

    conv_id is an integer; rows without one belong to no conversation and are left
    out. Null roles and texts are empty, a null turn comes first, turns of equal
    number are in the order of their digests; rows that repeat are turns of their own.
    An empty table has no node. Other columns are not read. One conversation's turns
    are read by one task, one after the other.
    """
    spark = conversations.sparkSession
    kept = Scratch(spark, "op13")
    rows, nodes = trie_nodes(kept, conversations, family, shares, most)
    kind = f"node binary, up binary, {NODE_FIELDS}"
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("more_children", "more_leaves", "more_saved")]
    below = kept.put(nodes.where("shard >= 0").select("*", *nothing).groupBy("shard").applyInArrow(roll_up, kind))
    gained = below.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    upper = nodes.where("shard < 0").join(gained, "node", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
    top = kept.put(upper.select(*nodes.columns, "more_children", "more_leaves", "more_saved").groupBy("shard").applyInArrow(roll_up, kind))
    above = top.select(F.col("node").alias("up"), F.col("conv_id").alias("above"))  # at most MAX_UPPER rows
    every = top.union(below.join(F.broadcast(above), "up", "left").select(*below.columns[:4], F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *below.columns[5:]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    hashes = end_lists(rows, parts)
    return every.join(hashes, "node", "left").select(*(c.split()[0] for c in NODE_FIELDS.split(", ")), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def tries(conversations: DataFrame) -> DataFrame:
    """The succinct tries themselves: shard (-1: the upper levels), n, bits, labels, conv_ids.

    `Louds.stored(bits, labels)` reads one; a path is followed from node 0 by `find`,
    with names made by BLAKE2b of 16 bytes over the parent's name and the turn's digest.
    """

    def encode(nodes: pa.Table) -> pa.Table:
        trie = Louds(names_of(nodes["node"]), names_of(nodes["parent"]))
        convs = nodes["conv_id"].take(pa.array(trie.order)).combine_chunks()
        return pa.table({"shard": nodes["shard"][:1], "n": pa.array([len(trie.labels)], pa.int64()), "bits": pa.array([np.packbits(trie.bits).tobytes()], pa.binary()), "labels": pa.array([trie.labels.tobytes()], pa.binary()), "conv_ids": pa.array([convs.to_pylist()], pa.list_(pa.int64()))})

    _, nodes = trie_nodes(Scratch(conversations.sparkSession, "op13-tries"), conversations, 1, no_shares, 0)
    return nodes.groupBy("shard").applyInArrow(encode, "shard bigint, n bigint, bits binary, labels binary, conv_ids array<bigint>")
