"""Evidence: segments, Merkle trees and proofs, checkpoints, seals, versions and their differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions import columns as C


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


class Tree:
    """The root of an ordered tree, leaf by leaf: holds one hash for each level, however many leaves there are.

    A perfect subtree is closed as soon as it is full; the rest are joined from the right, which is the split at the
    largest power of two below the number of leaves (RFC 6962).
    """

    def __init__(self):
        self.open: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.open and self.open[-1][0] == level:
            leaf, level = node(self.open.pop()[1], leaf), level + 1
        self.open.append((level, leaf))

    def root(self) -> bytes:
        if not self.open:
            return hashlib.sha256(b"").digest()
        out = self.open[-1][1]
        for _, left in reversed(self.open[:-1]):
            out = node(left, out)
        return out


def split(n: int) -> int:
    return 1 << (n - 1).bit_length() - 1


def root(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def proof(leaves: list[bytes], index: int) -> list[tuple[str, bytes]]:
    """Siblings from the leaf up, each with its side."""
    if len(leaves) == 1:
        return []
    k = split(len(leaves))
    if index < k:
        return [*proof(leaves[:k], index), ("right", root(leaves[k:]))]
    return [*proof(leaves[k:], index - k), ("left", root(leaves[:k]))]


def verify(leaf: bytes, path: list[tuple[str, bytes]], want: bytes) -> bool:
    for side, sibling in path:
        leaf = node(sibling, leaf) if side == "left" else node(leaf, sibling)
    return leaf == want


def leaves(records: DataFrame) -> DataFrame:
    """(segment, offset, leaf) of records (segment, offset, length, raw_hash), hashed in the JVM."""
    return records.select("segment", "offset", C.merkle_leaf(F.col("segment").cast("string"), F.col("offset"), F.col("length"), F.col("raw_hash")).alias("leaf"))


def rooted(leaves: DataFrame, key: str, order: str, leaf: str = "leaf") -> DataFrame:
    """(key, n, root) over hex leaves: dealt out by key, sorted within tasks and streamed; a tree is never in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, n = None, Tree(), 0
        for b in batches:
            done = []
            for k, leaf in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n and k != now:
                    done.append((now, n, tree.root().hex()))
                    tree, n = Tree(), 0
                now = k
                tree.add(bytes.fromhex(leaf))
                n += 1
            if done:
                yield rows(done, b.schema)
        if n:
            yield rows([(now, n, tree.root().hex())], b.schema)

    def rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema.field(0).type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=[key, "n", "root"])

    kind = leaves.schema[key].dataType.simpleString()
    return leaves.repartition(key).sortWithinPartitions(key, order).select(key, leaf).mapInArrow(run, f"`{key}` {kind}, n long, root string")


def roots(records: DataFrame) -> DataFrame:
    """(segment, n, root) of records."""
    return rooted(leaves(records), "segment", "offset")


LABEL, FIRST = "siltline-checkpoint-v1", "0" * 64


def checkpoint_hash(key: object, n: int, root: str, prev: str) -> str:
    return hashlib.sha256("|".join((LABEL, str(key), str(n), root, prev)).encode()).hexdigest()


def checkpoints(segment_roots: DataFrame, minute: str = "minute") -> DataFrame:
    """(minute, n_segments, root, prev, hash): ``root`` is the tree over the minute's segment roots, ``prev`` the hash of the whole
    checkpoint before, and ``hash`` that of this one, which so depends on all before it.

    A chain has one order: checkpoints, a row for each minute, are streamed through one task; trees are not.
    """
    own = rooted(segment_roots.select(minute, "segment", "root"), minute, "segment", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = FIRST
        for b in batches:
            before, made = [], []
            for key, n, root in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                before.append(prev)
                prev = checkpoint_hash(key, n, root, prev)
                made.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(made, pa.string())], names=[minute, "n_segments", "root", "prev", "hash"])

    kind = own.schema[minute].dataType.simpleString()
    return own.coalesce(1).sortWithinPartitions(minute).mapInArrow(run, f"`{minute}` {kind}, n_segments long, root string, prev string, hash string")


def chain_findings(stored: DataFrame, head: str | None = None, minute: str = "minute") -> DataFrame:
    """(minute, finding) of checkpoints whose hash isn't that of what they say, or whose ``prev`` isn't the hash before; and of the
    last, ``head``, if its hash isn't the published one: whoever rewrites a checkpoint has to rewrite all that follow, and then this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, last = FIRST, None
        for b in batches:
            found = []
            for key, n, root, before, made in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if before != prev:
                    found.append((key, "prev"))
                if made != checkpoint_hash(key, n, root, before):
                    found.append((key, "hash"))
                prev, last = made, (key, b.column(0).type)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], b.column(0).type), pa.array([f for _, f in found])], names=[minute, "finding"])
        if head is not None and prev != head:
            yield pa.RecordBatch.from_arrays([pa.array([last and last[0]], last[1] if last else None), pa.array(["head"])], names=[minute, "finding"])

    kind = stored.schema[minute].dataType.simpleString()
    return stored.select(minute, "n_segments", "root", "prev", "hash").coalesce(1).sortWithinPartitions(minute).mapInArrow(run, f"`{minute}` {kind}, finding string")


def daily(stored: DataFrame, minute: str = "minute", day: str = "day") -> DataFrame:
    """(day, n, root): the tree over each day's checkpoints, in order."""
    return rooted(stored.select(day, minute, "hash"), day, minute, "hash")


def covering(segments: DataFrame, stored: DataFrame, id: str = "checkpoint") -> DataFrame:
    """(segment, checkpoints, first): how many checkpoints name a segment, and the first that does; 0 and null if it isn't committed."""
    named = stored.select(id, F.explode("segments").alias("segment")).groupBy("segment").agg(F.count_distinct(id).alias("n"), F.min(id).alias("first"))
    return segments.select("segment").join(named, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("checkpoints"), "first")


def deletable(segments: DataFrame, receipts: DataFrame, stored: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """(segment, deletable, why): the first condition that a local segment (segment, sealed, sealed_ms, sha256) fails, if any.

    It must be sealed, have an archive receipt (segment, sha256 as read back) of equal hash, be named by a checkpoint, and have
    been kept long enough.
    """
    committed = covering(segments, stored).select("segment", (F.col("checkpoints") > 0).alias("committed"))
    held = segments.join(receipts.select("segment", F.col("sha256").alias("shipped")), "segment", "left").join(committed, "segment")
    why = (
        F.when(~F.col("sealed"), "open").when(F.col("shipped").isNull(), "no_receipt").when(F.col("shipped") != F.col("sha256"), "hash")
        .when(~F.col("committed"), "not_committed").when(F.col("sealed_ms") > now_ms - keep_ms, "young")
    )
    return held.select("segment", why.isNull().alias("deletable"), why.alias("why"))


def undelivered(records: DataFrame, delivered: DataFrame, gap: str = "gap") -> DataFrame:
    """Records (segment, offset) after the last delivered one, without gap records; all of them if nothing was delivered."""
    last = delivered.agg(F.max(F.struct("segment", "offset")).alias("_last"))  # one row
    after = F.col("_last").isNull() | (F.struct("segment", "offset") > F.col("_last"))
    return records.where(~F.col(gap)).join(F.broadcast(last), after).drop("_last")


def sliced(quarantine: DataFrame, store: DataFrame) -> DataFrame:
    """Quarantine records (segment, start, length, raw_hash) with their bytes out of the stored segments (segment, raw), and whether these are as hashed.

    ``state``: ok, altered, or missing where the segment isn't in the store.
    """
    cut = F.substr(F.col("raw").cast("binary"), F.col("start") + 1, F.col("length"))
    both = quarantine.join(store.select("segment", "raw"), "segment", "left").withColumn("slice", cut)
    return both.withColumn("state", F.when(F.col("raw").isNull(), "missing").when(C.evidence_hash("slice") == F.col("raw_hash"), "ok").otherwise("altered")).drop("raw")


def verified(stored: DataFrame, derived: DataFrame, key: str = "segment") -> DataFrame:
    """Findings: segments that are missing, unexpected, or whose roots differ."""
    both = stored.select(key, F.col("root").alias("stored")).join(derived.select(key, F.col("root").alias("derived")), key, "full_outer")
    why = F.when(F.col("derived").isNull(), "missing").when(F.col("stored").isNull(), "unexpected").when(F.col("stored") != F.col("derived"), "tampered")
    return both.withColumn("finding", why).where("finding IS NOT NULL")


def seals(records: DataFrame) -> DataFrame:
    """(segment, n, bytes, first, last, index_hash): what a sealed segment's manifest says."""
    line = F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), "raw_hash")
    return records.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("index_hash"))


def segments(records: DataFrame, most_events: int = 50_000, most_bytes: int = 32 << 20, most_ms: int = 2_000_000_000) -> DataFrame:
    """Records (peer, sequence, bytes, at) with segment, offset: rotation by events, bytes and age, in order by peer.

    The limits reset when a segment rotates, which no window expresses; rows stream through in order instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peer, segment, n, size, since, fresh = None, 0, 0, 0, 0, True
        for b in batches:
            segment_of, offset_of = [], []
            for p, length, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if fresh or p != peer:
                    peer, segment, n, size, since, fresh = p, 0, 0, 0, at, False
                elif n >= most_events or size + length > most_bytes or at - since >= most_ms:
                    segment, n, size, since = segment + 1, 0, 0, at
                segment_of.append(segment)
                offset_of.append(size)
                n, size = n + 1, size + length
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment_of, pa.int64()), pa.array(offset_of, pa.int64())], names=[*b.schema.names, "segment", "offset"])

    own = records.select("peer", "sequence", "bytes", "at")
    schema = own.select("*", F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("offset")).schema
    return own.repartition("peer").sortWithinPartitions("peer", "sequence").mapInArrow(run, schema)


def located(local: DataFrame, archive: DataFrame, key: str = "event_id") -> DataFrame:
    """Each record once: from the local store if it is there, else from the archive."""
    both = local.withColumn("_place", F.lit(0)).unionByName(archive.withColumn("_place", F.lit(1)))
    rest = [c for c in local.columns if c != key]
    one = both.groupBy(key).agg(F.min_by(F.struct(*rest), "_place").alias("r"), F.when(F.min("_place") == 0, "local").otherwise("archive").alias("store"))
    return one.select(key, "r.*", "store")
