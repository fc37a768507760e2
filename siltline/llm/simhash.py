"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 64 bits: each is the majority of that bit over the XXH64 of the text's word shingles. Two
fingerprints link if they differ in at most ``radius`` bits (3).

Search: every bit position gets a nonzero vector of F2^(radius+1); table v keeps the positions whose vector has an odd
product with v. Up to ``radius`` positions can't span the space, so some v is orthogonal to all positions in which a
linked pair differs: the pair agrees on all that table v keeps. 15 tables of about 34 bits find every link.

Groups: exact copies count as one fingerprint before anything is shuffled. A bucket gives a spanning forest of its links,
never its pairs. A bucket of more than ``bucket`` fingerprints isn't searched as it is: the same construction on the
positions that its table left free deals it out to 15 tables of about 49 bits, then of 56, where at most a few hundred
fingerprints can share a key. So memory is bounded and no link is lost.

Three differing bits are nearly the same text: of two texts that share 0.8 of their five-word shingles, most differ in
four to eleven. ``one_of_each`` therefore also joins texts by their shingles, exactly. Shingles have one order (hash, but
those that a sample of the rows shows to be frequent come last); two texts that are ``least`` alike share one of the first
n - ceil(least n) + 1 of each. Rows with such a shingle in common are a bucket, and all pairs of a bucket are looked at but
those that are in one group already. Of a bucket of more than ``GROUP`` rows each is first held against the least only;
what that joins is a group, and the pairs across groups follow, those nearest by signature first, in rounds that end when no
pair across groups is left. Pairs that sizes or ``signature`` rule out (bounds, not
estimates) are dropped; all others are verified by the distinct shingles of the whole texts, as words.

Defined cases: a null text is empty, an empty text has fingerprint zero and links like any other; repeated rows and ids
give a row each; a row without id takes part, but never names a component (a component without any id is null); extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import free_name, hot_keys, joined, raw_texts, scratch, slices, words, written
from siltline.llm.components import components
from siltline.llm.decontaminate import Hashes, rolled, shingles

BITS = 64
#: Tables below tables; at the last, buckets are searched whole.
DEPTH = 3
#: Words whose hashes a task of near-dedup keeps: workers hold on to the memory from stage to stage.
CACHE = 100_000
#: Rows of a bucket of shingles whose pairs are all looked at in the first round.
GROUP = 64
#: Partners of a row in a larger bucket that are looked at in the first round across groups; in each later one eight times as many.
NEAREST = 4
#: Bits of a signature.
SIGNATURE = 512
#: Frequent shingles that are ordered last: those of at least ``OFTEN`` rows of one in ``SAMPLE``, at most ``HEAVY``. Any
#: order finds the same pairs; this one keeps buckets small.
SAMPLE, OFTEN, HEAVY = 8, 3, 1 << 17


def simhash(raw: bytes, width: int = 3, seed: int = 42) -> bytes:
    """The fingerprint's 8 bytes, most significant first."""
    found = words(raw)
    if not found:
        return bytes(8)
    if len(found) < width:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    rows = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), 1 << 15):
        ones += np.unpackbits(rows[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(rows)).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 3, seed: int = 42) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    fp = free_name(chosen, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keep)):
            bits = b"".join([simhash(x, width, seed) for x in raw_texts(b.column(len(keep)))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], names=[*b.schema.names[:-1], fp])

    return chosen.mapInArrow(run, chosen.select(*keep, F.lit(0).cast("long").alias(fp)).schema)


@lru_cache(maxsize=None)
def kept(path: tuple[int, ...], radius: int = 3) -> int:
    """The positions that table ``path`` keeps: one table number for each level."""
    if not path:
        return 0
    before = kept(path[:-1], radius)
    free = [i for i in range(BITS) if not before >> i & 1]
    size = (1 << radius + 1) - 1
    return before | sum(1 << i for n, i in enumerate(free) if ((7 * n % size + 1) & path[-1]).bit_count() & 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(x: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (node, other) that join what links of at most ``radius`` bits join in ``x``: fewer than its rows."""
    rest, out = x, []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            more = []
            for i in range(0, len(front), 64):
                part = front[i : i + 64]
                near = np.bitwise_count(rest[:, None] ^ part[None, :]) <= radius
                hit = near.any(axis=1)
                if hit.any():
                    out.append((rest[hit], part[near[hit].argmax(axis=1)]))
                    more.append(rest[hit])
                    rest = rest[~hit]
                if not len(rest):
                    break
            front = np.concatenate(more) if more else rest[:0]
    return out


def search(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Rows (path, key, x) dealt out by key; gives links (path 0, key: other, x) and, of large buckets, rows of the next level."""
    size = (1 << radius + 1) - 1

    def path_of(code: int) -> tuple[int, ...]:
        digits = []
        while code:
            digits.append(code & size)
            code >>= radius + 1
        return tuple(reversed(digits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(path: np.ndarray, key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(x.view(np.int64))], names=["path", "key", "x"])

        def links(other: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return table(np.zeros(len(x)), other, x)

        def deeper(code: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for v in range(1, size + 1):
                mask = np.uint64(kept((*path_of(code), v), radius))
                yield table(np.full(len(x), code << radius + 1 | v), x & mask, x)

        def done(path: np.ndarray, key: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
            count = np.diff(np.r_[new, len(x)])
            each = np.repeat(count, count)
            for lag in (1, 2, 3):
                at = np.flatnonzero((each[lag:] <= 4) & (path[lag:] == path[:-lag]) & (key[lag:] == key[:-lag]))
                at = at[np.bitwise_count(x[at] ^ x[at + lag]) <= radius]
                if len(at):
                    yield links(x[at], x[at + lag])
            for i in np.flatnonzero(count > 4):
                part = x[new[i] : new[i] + count[i]]
                if count[i] > bucket and len(path_of(int(path[new[i]]))) < DEPTH:
                    yield from deeper(int(path[new[i]]), part)
                elif found := forest(part, radius):
                    yield links(np.concatenate([f[1] for f in found]), np.concatenate([f[0] for f in found]))

        path, key, x = (np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64))
        large = None  # the bucket whose rows go on to the next level as they come
        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            path, key, x = np.r_[path, got[0]], np.r_[key, got[1].view(np.uint64)], np.r_[x, got[2].view(np.uint64)]
            if large is not None and len(x):
                n = int(np.argmin(np.r_[(path == large[0]) & (key == large[1]), False]))
                if n:
                    yield from deeper(large[0], x[:n])
                    path, key, x = path[n:], key[n:], x[n:]
            if not len(x):
                continue
            last = len(x) - int(np.argmin(np.r_[((path == path[-1]) & (key == key[-1]))[::-1], False]))
            if last:
                yield from done(path[:last], key[:last], x[:last])
                path, key, x, large = path[last:], key[last:], x[last:], None
            if len(x) > bucket and len(path_of(int(path[0]))) < DEPTH:
                large = (int(path[0]), key[0])
                yield from deeper(large[0], x)
                path, key, x = path[:0], key[:0], x[:0]
        if len(x):
            yield from done(path, key, x)

    return rows.repartition("path", "key").sortWithinPartitions("path", "key", "x").mapInArrow(run, "path long, key long, x long")


def links(distinct: DataFrame, radius: int = 3, bucket: int = 512) -> DataFrame:
    """Links (a, b) between the values ``fp`` of ``distinct`` (one row each) that join all that differ in ``radius`` bits or fewer."""
    if bucket < 1 << 8:
        raise ValueError("bucket must be 256 or more: the deepest tables can't split smaller ones")
    tables = [F.struct(F.lit(v).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(signed(kept((v,), radius)))).alias("key")) for v in range(1, 1 << radius + 1)]
    rows = distinct.select(F.explode(F.array(*tables)).alias("t"), F.col("fp").alias("x")).select("t.path", "t.key", "x")
    found = []
    for _ in range(DEPTH):
        level = written(search(rows, radius, bucket), "simhash-links")
        found.append(level.where("path = 0").select(F.col("x").alias("a"), F.col("key").alias("b")))
        rows = level.where("path > 0")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, bucket: int = 512) -> DataFrame:
    """A row for each row of ``docs``: ``id``, fingerprint (16 hex digits), component_id (the smallest id it can reach)."""
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        prints = written(fingerprints(base, keep=["id"], width=width), "simhash-prints", keep=True)
        total = prints.count()
        least = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        nodes = components(links(least.select("fp"), radius, bucket), name="simhash-components")
        of_root = nodes.join(least, nodes.node == least.fp).groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
        linked = joined(nodes, of_root.select("root", "component_id"), "root", hot_keys(of_root, "root", total)).select(F.col("node").alias("fp"), "component_id")
        named = written(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "simhash-named", keep=True)
    return joined(prints, named.drop("n"), "fp", hot_keys(named, "fp", total)).select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_hashes(raw: bytes, hashes: Hashes, shingle: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles, ascending."""
    found = words(raw)
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    return np.unique(rolled(own, min(shingle, len(own))))


def signature(own: np.ndarray) -> np.ndarray:
    """Parities of the hashes that share their lowest bits, as longs: two differ in no more bits than the sets in hashes."""
    odd = np.bincount((own % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(own: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first hashes in the common order, of which texts that are ``least`` alike share one."""
    known, place = heavy
    most = len(own) - ceil(least * len(own) - 1e-9) + 1
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hot = known[at] == own
        own = np.r_[own[~hot], own[hot][np.argsort(place[at[hot]])]]
    return own[:most]


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles by hash, and their places in the order: the most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        hashes.most = CACHE
        for b in slices(batches, 1):
            own = [shingle_hashes(raw, hashes) for raw in raw_texts(b.column(1))]
            h, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = rows.select("row", "text").where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(HEAVY).collect()
    known = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], (len(known) - np.arange(len(known)))[order]


def bucketed(rows: DataFrame, least: float, most: int) -> DataFrame:
    """Rows (h, row, n, label) by h: pairs (a, b) across labels; of buckets of more than ``most``, those with its first row, and its rows (a, -1).

    ``n`` is the size, times 2^31, and the place of h. Texts of x and y shingles that are alike share least / (1 + least) (x + y)
    or more, so the first that they share has no more than x, and y, less that many before it: other pairs are left out.
    """
    share = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, a, b)], names=["h", "a", "b"])

        def pairs(got: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            (h, row, n, label) = got
            place, n = n & (1 << 31) - 1, n >> 31
            both = share * (n[x] + n[y]) - 1e-6
            at = (label[x] != label[y]) & (n[x] - place[x] >= both) & (n[y] - place[y] >= both)
            if at.any():
                yield table(np.zeros(at.sum()), np.maximum(row[x[at]], row[y[at]]), np.minimum(row[x[at]], row[y[at]]))

        def large(got: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield table(got[0], got[1], np.full(got.shape[1], -1))
            yield from pairs(np.c_[first, got], np.zeros(got.shape[1], np.int64), np.arange(1, got.shape[1] + 1))

        def done(got: np.ndarray) -> Iterator[pa.RecordBatch]:
            h = got[0]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[new, len(h)])
            at, lag = np.flatnonzero(np.repeat(count, count) <= most), 1
            while len(at):
                at = at[at + lag < len(h)]
                at = at[h[at] == h[at + lag]]
                yield from pairs(got, at, at + lag)
                lag += 1
            for i in np.flatnonzero(count > most):
                part = got[:, new[i] : new[i] + count[i]]
                yield from large(part, part[:, :1])

        held, first = np.zeros((4, 0), np.int64), None  # first: of the large bucket whose rows go on as they come
        for b in batches:
            held = np.c_[held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])]
            if first is not None and held.shape[1]:
                n = int(np.argmin(np.r_[held[0] == first[0, 0], False]))
                if n:
                    yield from large(held[:, :n], first)
                    held = held[:, n:]
            if not held.shape[1]:
                continue
            last = held.shape[1] - int(np.argmin(np.r_[(held[0] == held[0, -1])[::-1], False]))
            if last:
                yield from done(held[:, :last])
                held, first = held[:, last:], None
            if held.shape[1] > most:
                first = held[:, :1]
                yield from large(held, first)
                held = held[:, :0]
        if held.shape[1]:
            yield from done(held)

    return rows.repartition("h").sortWithinPartitions("h", "row").mapInArrow(run, "h long, a long, b long")


def crossed(rows: DataFrame, least: float, most: int) -> DataFrame:
    """Rows (h, row, n, label, sign) by h: of the pairs (a, b) across labels that sizes and signatures allow, for each row the ``most`` nearest by signature.

    Of each pair one row is asked, so without a row (-1, -1), which says that some row had more, these are all pairs.
    """

    def bucket(row: np.ndarray, n: np.ndarray, label: np.ndarray, sign: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Pairs within a label are never made: the rows of the largest one come last, and are only others' partners.
        _, own, count = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((row, own, count[own]))
        row, n, label, sign, more = row[order], n[order], label[order], sign[order], False
        for i in range(0, len(row) - int(count.max()), 64):
            near = np.zeros((3, 0), np.int64)  # asked row, differing bits, partner
            for j in range(i, len(row), 4096):
                x, y = slice(i, min(i + 64, len(row))), slice(j, j + 4096)
                fit = (label[x, None] != label[None, y]) & (np.minimum(n[x, None], n[None, y]) >= least * np.maximum(n[x, None], n[None, y]) - 1e-9)
                p, q = np.nonzero(fit)
                p, q = p + i, q + j
                p, q = p[p < q], q[p < q]
                differ = np.bitwise_count(sign[p] ^ sign[q]).sum(axis=1, dtype=np.int64)
                at = differ * (1 + least) <= (1 - least) * (n[p] + n[q]) + 1e-6
                near = np.c_[near, np.stack([p[at], differ[at], q[at]])]
                near = near[:, np.lexsort((near[2], near[1], near[0]))]
                new = np.flatnonzero(np.r_[True, near[0, 1:] != near[0, :-1]][: near.shape[1]])
                nth = np.arange(near.shape[1]) - np.repeat(new, np.diff(np.r_[new, near.shape[1]]))
                more = more or bool((nth >= most).any())
                near = near[:, nth < most]
            if near.shape[1]:
                a, b = row[near[0]], row[near[2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for b in batches:
            h = b.column(0).to_numpy()
            for i, j in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]), strict=True):
                if i == j:
                    continue
                if parts and h[i] != held:
                    yield from bucket(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                    parts = []
                one, held = b.slice(i, j - i), h[i]
                sign = one.column(4).flatten().to_numpy().view(np.uint64).reshape(-1, SIGNATURE // 64)
                parts.append((one.column(1).to_numpy(), one.column(2).to_numpy().astype(np.int64), one.column(3).to_numpy(), sign))
        if parts:
            yield from bucket(*(np.concatenate(p) for p in zip(*parts, strict=True)))

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int = 5) -> DataFrame:
    """The pairs (a, b) whose texts (row, text) share ``least`` of their shingles."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = written(texts.select("row", "text").join(ends, "row", "left_semi"), "simhash-texts")
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, set()
        for whole in slices(batches, 2):
            for b in slices(iter([whole]), 3):
                keep = []
                for x, y, row in zip(raw_texts(b.column(2)), raw_texts(b.column(3)), b.column(1).to_pylist(), strict=True):
                    if row != last:
                        last, other = row, set(shingles(words(y), shingle))
                    own = set(shingles(words(x), shingle))
                    keep.append(len(own & other) >= least * len(own | other) - 1e-9)
                yield pa.RecordBatch.from_arrays(list(b.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).columns), names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def alike(docs: DataFrame, exact: DataFrame, least: float, most: int = GROUP) -> DataFrame:
    """Links (a, b) that, with those of ``exact`` (row, first), join all rows (row, text) whose texts are ``least`` alike."""
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        hashes.most = CACHE
        for b in slices(batches, 1):
            own = [shingle_hashes(raw, hashes) for raw in raw_texts(b.column(1))]
            columns = [
                pa.array([len(o) for o in own], pa.int32()),
                pa.array([xxhash.xxh128_digest(o.tobytes()) for o in own], pa.binary()),
                pa.array([signature(o) for o in own], pa.list_(pa.int64())),
                pa.array([prefix(o, heavy.value, least).view(np.int64) for o in own], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["row", "n", "digest", "sign", "first"])

    prints = written(docs.select("row", "text").mapInArrow(run, "row long, n int, digest binary, sign array<long>, first array<long>"), "simhash-shingles")
    # One row stands for all with the same shingles.
    least_of = prints.groupBy("digest").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = joined(prints.select("row", "digest"), least_of.drop("n"), "digest", hot_keys(least_of, "digest", prints.count()))
    same = written(copies.where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b")), "simhash-same")
    ones = prints.where("n > 0").join(same.select(F.col("a").alias("row")), "row", "left_anti")
    spread = ones.join(exact.withColumnRenamed("first", "label"), "row").select(F.posexplode("first").alias("place", "h"), "row", "n", "label")
    spread = spread.select("h", "row", (F.col("n").cast("long") * (1 << 31) + F.col("place")).alias("n"), "label")
    level = written(bucketed(spread, least, most), "simhash-candidates")

    signs = prints.select("row", "n", "sign")
    pairs = level.where("b >= 0").select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(signs.select(F.col("row").alias(end), F.col("n").alias(f"n{end}"), F.col("sign").alias(f"s{end}")), end)
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    tried = written(pairs.where(differ * (1 + least) <= (F.col("na") + F.col("nb")) * (1 - least) + 1e-6).select("a", "b"), "simhash-pairs")
    links = same.union(written(verified(tried, docs, least), "simhash-alike"))
    rows = level.where("b < 0").select("h", F.col("a").alias("row"))
    if rows.isEmpty():
        return links
    # Nearest pairs first: what they join needs no more pairs. Rounds go on until no row has any left.
    ask, first = NEAREST, exact.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    while True:
        nodes = written(components(first.union(links), name="simhash-joined"), "simhash-labels")
        named = rows.join(nodes.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("root", "row")).drop("root")
        mixed = named.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
        rest = named.join(mixed, "h").join(signs, "row").select("h", "row", "n", "label", "sign")
        got = written(crossed(rest, least, ask).distinct(), "simhash-crossed")
        fresh = written(got.where("a >= 0").join(tried, ["a", "b"], "left_anti"), "simhash-fresh")
        links, tried = links.union(written(verified(fresh, docs, least), "simhash-across")), tried.union(fresh)
        if got.where("a < 0").isEmpty():
            return links
        ask *= 8


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, bucket: int = 512, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of its smallest id, and of rows with this id the first.

    Groups join rows whose fingerprints link within ``radius`` bits, and rows whose texts are ``least`` alike in five-word
    shingles. Rows are told apart by a row id that is written with them, so repeated or missing ids lose nothing else.
    """
    row = free_name(docs, "_row")
    with scratch(docs.sparkSession):
        held = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-documents", keep=True)
        rows = held.select(F.col(row).alias("row"), F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(row).alias("row")).alias("key"), F.col(text).alias("text"))
        exact = written(near_duplicates(rows, id="row", text="text", width=width, radius=radius, bucket=bucket).select("row", F.col("component_id").alias("first")), "simhash-exact")
        with scratch(docs.sparkSession):
            more = written(alike(rows, exact, least), "simhash-links", keep=True)
        linked = exact.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b")).union(more)
        nodes = written(components(linked, name="simhash-groups"), "simhash-nodes")
        keys = rows.select("row", "key").join(nodes.withColumnRenamed("node", "row"), "row")
        chosen = keys.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.row").alias("row"))
        gone = written(nodes.select(F.col("node").alias(row)).join(chosen.withColumnRenamed("row", row), row, "left_anti"), "simhash-gone", keep=True)
    return held.join(gone, row, "left_anti").select(*docs.columns)
