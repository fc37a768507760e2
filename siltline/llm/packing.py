"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for where they go, and there are at most ``capacity`` lengths. So the
plan is made on the driver from that histogram, whose size doesn't depend on the corpus, and says for runs of equal
pieces which run of sequences they fill; every piece then finds its place from its length and its rank among pieces of
this length. Ranks are counted within tasks as the pieces are written, and the tasks' counts are summed up by a window
over (task, length): no group of equal pieces ever comes together.

Reduction (Martello and Toth, 1990), longest piece first: if nothing fits beside it, it is fixed alone; if one partner
fills the sequence, or no two further pieces fit, or the largest partner is as long as any two that fit together, it is
fixed with that partner; if at most two fit and the largest with the best second dominates every such pair, it is fixed
with both. The first piece that none of this decides, with all shorter ones, would stop the reduction; as in the paper
it goes on to the next length, and what remains is packed by best-fit decreasing.

Defined cases: a null text is empty; an empty document is its end mark alone, a piece of one token; repeated rows are
packed as often as they come; a null id stays null; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.common import slices, written
from siltline.llm.tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
#: length; ranks from (with) to (without); first sequence; pieces in each sequence; offset of the first of them.
PLACES = "length long, low long, high long, sequence long, each long, offset long"


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The documents' pieces with their rank among those of the same length in the same task (and their ids if wanted)."""
    chosen = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    mark, most = end.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_ids(vocabulary).text, TaskContext.get().partitionId(), Counter()
        for b in slices(batches, 1):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + mark
                for n, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    size = len(part) // 4
                    rows.append((doc, n, at // 4, size, zlib.crc32(part), task, seen[size], *([part] if with_ids else ())))
                    seen[size] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    schema = PIECES + ", ids binary" * with_ids
    return chosen.mapInArrow(run, schema)


class Stock:
    """How many pieces of each length are left, and the places of those that are gone."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for size, n in counts.items():
            if not 1 <= size <= capacity:
                raise ValueError(f"a piece of {size} tokens doesn't fit {capacity}")
            self.left[size] += n
        self.used, self.places, self.sequences, self.capacity = [0] * (capacity + 1), [], 0, capacity

    def put(self, size: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.places.append((size, self.used[size], self.used[size] + n, sequence, each, offset))
        self.used[size] += n
        self.left[size] -= n

    def fix(self, *sizes: int) -> None:
        """As many sequences of just these sizes as there are pieces for."""
        need = Counter(sizes)
        n, offset = min(self.left[s] // k for s, k in need.items()), 0
        for size, k in need.items():
            self.put(size, n * k, self.sequences, k, offset)
            offset += size * k
        self.sequences += n

    def largest(self, room: int, *without: int) -> int:
        """The largest size of at most ``room`` of which there is one besides those taken out; 0 if none."""
        return next((s for s in range(min(room, self.capacity), 0, -1) if self.left[s] > without.count(s)), 0)


def best_pairs(stock: Stock, room: int, first: int) -> tuple[int, int, int]:
    """Over pairs x >= y that fit in ``room`` beside ``first``: the largest sum, the largest y, and whether any three could fit (their least sum)."""
    sizes = [s for s in range(1, min(room, stock.capacity) + 1) if stock.left[s] > (s == first)]
    total = least_of = 0
    low, high = 0, len(sizes) - 1
    while low <= high:
        x, y = sizes[high], sizes[low]
        if x + y > room or (low == high and stock.left[x] - (x == first) < 2):
            high -= 1
        else:
            total, least_of, low = max(total, x + y), max(least_of, y), low + 1
    three, n = 0, 3
    for s in sizes:
        k = min(n, stock.left[s] - (s == first))
        three, n = three + k * s, n - k
        if not n:
            break
    return total, least_of, three if not n else room + 1


def reduce(stock: Stock) -> None:
    """Fixes dominating sets of at most three pieces, longest first."""
    for size in range(stock.capacity, 0, -1):
        while stock.left[size]:
            room, before = stock.capacity - size, stock.sequences
            one = stock.largest(room, size)
            if not one:
                stock.fix(size)
            else:
                pair, second, three = best_pairs(stock, room, size) if one < room else (0, 0, 0)
                # A partner alone is safe only if no three pieces could take its place, nor any two do better.
                if one == room or (pair <= one and three > room):
                    stock.fix(size, one)
                elif three > room and (two := stock.largest(room - one, size, one)) and two >= second:
                    stock.fix(size, one, two)
            if stock.sequences == before:
                break


def best_fit(stock: Stock) -> None:
    """Best-fit decreasing; sequences alike in what is free in them are runs (first, number)."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for size in range(stock.capacity, 0, -1):
        for free in sorted(f for f in runs if f >= size):
            each, held = free // size, runs.pop(free)
            while held:
                first, n = held.pop()
                if not stock.left[size]:
                    runs.setdefault(free, []).append((first, n))
                    continue
                full = min(n, stock.left[size] // each)
                if full:
                    stock.put(size, full * each, first, each, stock.capacity - free)
                    runs.setdefault(free - each * size, []).append((first, full))
                    first, n = first + full, n - full
                if n and (rest := stock.left[size]):
                    stock.put(size, rest, first, rest, stock.capacity - free)
                    runs.setdefault(free - rest * size, []).append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    runs.setdefault(free, []).append((first, n))
        if stock.left[size]:
            each = stock.capacity // size
            full, rest = divmod(stock.left[size], each)
            for n, k in ((full, each), (1, rest)):
                if n and k:
                    stock.put(size, n * k, stock.sequences, k, 0)
                    runs.setdefault(stock.capacity - k * size, []).append((stock.sequences, n))
                    stock.sequences += n
        runs.pop(0, None)


def plan(counts: dict[int, int], capacity: int = 2048) -> tuple[list[tuple[int, ...]], int, int]:
    """The places (see ``PLACES``), the number of sequences, and how many of them the reduction fixed."""
    stock = Stock(counts, capacity)
    reduce(stock)
    fixed = stock.sequences
    best_fit(stock)
    return stock.places, stock.sequences, fixed


def pack(docs: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    held = written(pieces(docs, capacity=capacity, **options), "packing-pieces")
    by_task = written(held.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places, _, _ = plan(counts, capacity)
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = held.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # A few places for each of at most `capacity` lengths, whatever the corpus: its size doesn't follow the data.
    where = F.broadcast(spark.createDataFrame(places, PLACES).withColumnRenamed("length", "size"))
    found = ranked.join(where, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return found.select(
        *(c for c in held.columns if c not in ("task", "rank")),
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
