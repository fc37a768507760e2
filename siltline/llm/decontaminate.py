"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is in a document if at least ``threshold`` (0.8) of the item's distinct five-word shingles are in it. Documents may
be of any length, so the Jaccard similarity of the two is useless, and banded MinHash would need thousands of bands.
Items are instead partitioned by size, and each size class probes with as many of its items' smallest shingle hashes as
containment demands: of q shingles at most q - ceil(0.8 q) may be missing, so among the q - ceil(0.8 q) + 1 with the
smallest hashes (a bottom-k MinHash sketch) one must be in the document. Any document with such a hash is a candidate;
nothing that passes the threshold can be missed. Candidates are verified in the same task against the item's shingles as
words, not hashes.

Items go in blocks of at most ``block`` shingles, so what is broadcast is bounded whatever the benchmark's size; each
block is one pass over the documents, and neither texts nor shingles are shuffled.

Words: ``[^\x20\x09-\x0D]+`` with A-Z lower-cased. Defined cases: an item of fewer than five words is one shingle, its
whole sequence, looked for among the documents' sequences of that many words; an item without words is in no document; a
null text is empty; repeated rows give their result each; null ids stay null; extra columns are kept; empty tables give
none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import free_name, raw_texts, slices, words

MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """XXH64 of words, emptied at ``most``."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` words in a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= MIX
        out ^= out >> np.uint64(29)
        out += hashes[k : k + n]
    return out


def shingles(found: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """The distinct ones in order, or the whole sequence if it is shorter; none without words."""
    if not found:
        return []
    return list(dict.fromkeys(zip(*(found[k:] for k in range(min(width, len(found)))), strict=False)))


class Block:
    """Items ready to be looked for."""

    def __init__(self, items: list[tuple[int, list[tuple[bytes, ...]]]], threshold: float):
        self.items, self.need, probes = items, [], defaultdict(lambda: defaultdict(list))
        for n, (_, parts) in enumerate(items):
            need = max(1, math.ceil(threshold * len(parts) - 1e-9))
            self.need.append(need)
            width = len(parts[0])
            flat = np.array([xxhash.xxh64_intdigest(w) for p in parts for w in p], np.uint64).reshape(-1, width)
            own = np.sort(np.array([rolled(row, width)[0] for row in flat], np.uint64))
            for h in own[: len(parts) - need + 1]:
                probes[width][int(h)].append(n)
        self.probes = {}
        for width, by_hash in probes.items():
            keys = np.sort(np.fromiter(by_hash, np.uint64, len(by_hash)))
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.probes[width] = keys, bits, dict(by_hash)

    def search(self, texts: list[bytes], hashes: Hashes) -> dict[int, list[tuple[int, int, int]]]:
        """For each text's place: (item, its shingles, those in the text) of the items that it holds."""
        split = [words(t) for t in texts]
        flat = np.fromiter((h for s in split for h in map(hashes.__getitem__, s)), np.uint64, sum(map(len, split)))
        starts = np.cumsum([0, *map(len, split)])
        likely: dict[int, set[int]] = defaultdict(set)
        for width, (keys, bits, items) in self.probes.items():
            own = rolled(flat, width)  # some run over into the next text: verification sees to those
            at = np.flatnonzero(bits[own >> np.uint64(44)])
            at = at[np.isin(own[at], keys)]
            for place, h in zip(np.searchsorted(starts, at, "right") - 1, own[at], strict=True):
                likely[int(place)].update(items[int(h)])
        out = {}
        for place, candidates in likely.items():
            held: dict[int, set] = {}
            found = []
            for n in sorted(candidates):
                item, parts = self.items[n]
                width = len(parts[0])
                if width not in held:
                    held[width] = set(zip(*(split[place][k:] for k in range(width)), strict=False))
                both = sum(map(held[width].__contains__, parts))
                if both >= self.need[n]:
                    found.append((item, len(parts), both))
            if found:
                out[place] = found
        return out


def blocks(benchmark: DataFrame, id: str, text: str, threshold: float, width: int, block: int) -> Iterator[Block]:
    """Reads the items row by row; holds one block of them."""
    items, size = [], 0
    for row in benchmark.select(F.col(id).cast("long"), F.col(text)).toLocalIterator():
        if parts := shingles(words((row[1] or "").encode()), width):
            items.append((row[0], parts))
            size += len(parts)
        if size >= block:
            yield Block(items, threshold)
            items, size = [], 0
    if items:
        yield Block(items, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5, block: int = 1_000_000, into: str = "benchmark_items") -> DataFrame:
    """``docs`` with an array ``into`` of the items that each row holds: structs of item_id, n_shingles, n_found."""
    spark, place = docs.sparkSession, docs.columns.index(text)
    into = free_name(docs, into)
    out = docs.withColumn(into, F.array().cast("array<struct<item_id:long,n_shingles:int,n_found:int>>"))
    for one in blocks(benchmark, item_id, item_text, threshold, width, block):
        sent = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes, items = Hashes(), sent.value
            for b in slices(batches, place, 2 << 20):
                found = items.search(raw_texts(b.column(place)), hashes)
                if found:
                    column = b.column(b.num_columns - 1)
                    held = column.to_pylist()
                    for n, more in found.items():
                        held[n] = [*held[n], *({"item_id": i, "n_shingles": s, "n_found": f} for i, s, f in more)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(held, column.type)], schema=b.schema)
                else:
                    yield b

        out = out.mapInArrow(run, out.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) for every document and item that it holds."""
    held = matches(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), benchmark, **options)
    one = held.select("id", F.explode("benchmark_items").alias("i"))
    return one.select(F.col("id").alias(id), "i.item_id", F.col("i.n_shingles").cast("long").alias("n_shingles"), F.col("i.n_found").cast("long").alias("n_found"), (F.col("i.n_found") / F.col("i.n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    held = matches(docs, benchmark, text=text, **options)
    return held.where(F.size(held[held.columns[-1]]) == 0).select(*docs.columns)
