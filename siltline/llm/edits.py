"""Edit-aware token counts.

A document keeps its pre-tokens in the leaves of a segment tree: each leaf a run of pre-tokens, each node the characters
and tokens below it. An edit finds its leaves by the sums of characters, re-encodes the pre-tokens that it touches with
some context, and updates the sums on the paths to the root; counting is then the root's sum, and a range's count a
descent.

Context: where a pre-token starts, what follows doesn't depend on what came before, so encoding starts ``BACK`` pre-tokens
before the edit (none looks further ahead than that) and stops where a new pre-token starts on an old one's start after
the edit.

Trees are kept: ``trees`` writes a row for each document, with its pre-tokens leaf by leaf and each leaf's characters and
tokens, and ``edited`` takes such rows, applies edits and gives rows of the same kind, from which the next edits go on. Of a
row it reads the sums; of the leaves, only those that an edit touches are cut into their pre-tokens and encoded. All others
go on as they are. What was encoded is counted (``n_encoded``), and so can be held against the size of an edit.

A byte-level vocabulary encodes each pre-token apart, so counts are sums over pre-tokens and equal those of encoding the
whole text.

Defined cases: a null text is empty and has no tokens; edits past the end append; an edit's range is cut to the text;
negative starts count as 0; null replacements delete; repeated rows give a row each; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltline.llm.common import slices, written
from siltline.llm.tokens import PieceCounts, piece_counts

#: Pre-tokens before an edit that it can change: a run of white space gives its last character to the next one, and a
#: contraction is an apostrophe and up to two letters, each of which may be a pre-token before the edit.
BACK = 3
LEAF = 32


class Tree:
    """Sums over leaves in an array of twice a power of two: node i's children are 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        delta = (chars - self.sums[i, 0], tokens - self.sums[i, 1])
        while i:
            self.sums[i] += delta
            i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last with characters, past the end), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if place >= start + self.sums[i, 0] and self.sums[i + 1, 0]:
                start += int(self.sums[i, 0])
                i += 1
        return i - self.size, start

    def before(self, leaf: int) -> tuple[int, int]:
        """Characters and tokens of the leaves before ``leaf``."""
        i, out = self.size + leaf, np.zeros(2, np.int64)
        while i > 1:
            if i & 1:
                out += self.sums[i - 1]
            i //= 2
        return int(out[0]), int(out[1])


class Leaf:
    """Pre-tokens, cut out of the leaf's text when they are asked for."""

    __slots__ = ("pieces", "said", "sizes")

    def __init__(self, pieces: list[str] | None, said: str = "", sizes: bytes = b""):
        self.pieces, self.said, self.sizes = pieces, said, sizes

    def cut(self) -> list[str]:
        if self.pieces is None:
            ends = np.cumsum(np.frombuffer(self.sizes, "<u4")).tolist()
            self.pieces = [self.said[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return self.pieces

    def stored(self) -> tuple[str, bytes]:
        if self.pieces is None:
            return self.said, self.sizes
        return "".join(self.pieces), np.array([len(p) for p in self.pieces], "<u4").tobytes()


class Leaves(list):
    """Lists of pre-tokens, of which stored ones are cut when they are read."""

    def __getitem__(self, k):
        found = list.__getitem__(self, k)
        return [x.cut() for x in found] if isinstance(k, slice) else found.cut()

    def __iter__(self):
        return (x.cut() for x in list.__iter__(self))

    def __setitem__(self, k: int, pieces: list[str]) -> None:
        list.__setitem__(self, k, Leaf(pieces))

    def stored(self) -> list[tuple[str, bytes]]:
        return [x.stored() for x in list.__iter__(self)]


class Counted:
    """A text whose number of tokens follows its edits. ``encoded`` sums up the characters that were encoded."""

    def __init__(self, text: str, counts: PieceCounts):
        self.counts, self.encoded, self.edits = counts, len(text), 0
        self.deal(counts.find(text))

    @classmethod
    def of_stored(cls, leaves: list[tuple[str, bytes]], chars: list[int], tokens: list[int], counts: PieceCounts) -> Counted:
        """What ``stored`` gave; nothing is encoded, and no leaf is cut."""
        out = object.__new__(cls)
        out.counts, out.encoded, out.edits, out.leaves, out.tree = counts, 0, 0, Leaves(Leaf(None, *x) for x in leaves), Tree(chars, tokens)
        return out

    def stored(self) -> tuple[list[tuple[str, bytes]], list[int], list[int]]:
        own = self.tree.sums[self.tree.size : self.tree.size + len(self.leaves)]
        return self.leaves.stored(), own[:, 0].tolist(), own[:, 1].tolist()

    def deal(self, pieces: list[str]) -> None:
        """Leaves and tree anew."""
        found = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.leaves = Leaves(Leaf(x) for x in found)
        self.tree = Tree([sum(map(len, x)) for x in found], [sum(map(self.counts.__getitem__, x)) for x in found])

    @property
    def tokens(self) -> int:
        return int(self.tree.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.tree.sums[1, 0])

    def text(self) -> str:
        return "".join(p for x in self.leaves for p in x)

    def tokens_before(self, place: int) -> int:
        """Tokens of the pre-tokens that end at or before ``place``."""
        leaf, at = self.tree.find(place)
        out = self.tree.before(leaf)[1]
        for piece in self.leaves[leaf]:
            at += len(piece)
            if at > place:
                break
            out += self.counts[piece]
        return out

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters from ``start`` to ``stop``."""
        self.edits += 1
        start = min(max(0, start), self.chars)
        stop = min(max(start, stop), self.chars)
        first, at = self.tree.find(max(0, start - 1))
        spare = 0  # whole pre-tokens before the edit in the leaves that will be read
        while first:
            held, spare = at, 0
            for piece in self.leaves[first]:
                held += len(piece)
                spare += held < start
            if spare >= BACK:
                break
            first -= 1
            while first and not self.leaves[first]:
                first -= 1
            at -= sum(map(len, self.leaves[first]))
        last, _ = self.tree.find(stop)
        old, kept, begin = [], [], at
        for piece in (p for x in self.leaves[first : last + 1] for p in x):
            old.append((at, piece))
            at += len(piece)
        n = max(0, sum(a + len(p) < start for a, p in old) - BACK)
        kept, old = [p for _, p in old[:n]], old[n:]
        origin = old[0][0] if old else at
        text = "".join(p for _, p in old)
        head, rest = text[: start - origin] + new, text[stop - origin :]
        text, shift = head + rest, len(new) - (stop - start)
        starts = {a + shift - origin: i for i, (a, _) in enumerate(old) if a >= stop}
        end, tail = last + 1, []
        while True:
            made, at_end = self.encode(text, starts, len(head))
            if at_end is not None:
                tail = [p for _, p in old[at_end:]]
                break
            if end >= len(self.leaves):
                break
            more, at = self.leaves[end], origin + len(text) - shift
            for piece in more:
                old.append((at, piece))
                starts[at + shift - origin] = len(old) - 1
                at += len(piece)
            text += "".join(more)
            end += 1
        self.put(first, end, [*kept, *made, *tail])

    def encode(self, text: str, starts: dict[int, int], least: int) -> tuple[list[str], int | None]:
        """New pre-tokens up to the first that starts on an old one's start after the edit, and which that is."""
        made, at = [], 0
        for m in self.counts.scan(text):
            if m.start() >= least and m.start() in starts:
                self.encoded += at
                return made, starts[m.start()]
            made.append(m[0])
            at = m.end()
        self.encoded += at
        return made, None

    def put(self, first: int, end: int, pieces: list[str]) -> None:
        """Deals ``pieces`` out over the leaves from ``first`` to ``end``; builds the tree anew once a leaf is far too full."""
        share = -(-len(pieces) // (end - first))
        for k in range(first, end):
            part = pieces[(k - first) * share : (k - first + 1) * share]
            self.leaves[k] = part
            self.tree.set(k, sum(map(len, part)), sum(map(self.counts.__getitem__, part)))
        if share > 64 * LEAF:
            self.deal([p for x in self.leaves for p in x])


#: A stored tree: the texts of its leaves, the sizes of each leaf's pre-tokens (unsigned 32-bit numbers), and the leaves' sums.
STORED = "leaves array<string>, sizes array<binary>, chars array<int>, tokens array<int>, n_encoded long, n_edits long"
KINDS = [pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]


def rows_of(docs: list[Counted]) -> list[pa.Array]:
    """The columns ``STORED``."""
    held = [d.stored() for d in docs]
    columns = [[x for x, _ in h[0]] for h in held], [[x for _, x in h[0]] for h in held], [h[1] for h in held], [h[2] for h in held], [d.encoded for d in docs], [d.edits for d in docs]
    return [pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)]


def wide(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def trees(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The columns ``keep`` (``doc_id``) and a stored tree for every row of ``docs``; all its characters are encoded."""
    chosen = docs.select(*(["doc_id"] if keep is None else keep), F.col(text).alias("_text"))
    n, schema = len(chosen.columns) - 1, wide(chosen.drop("_text").schema, STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for b in slices(batches, n):
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *rows_of([Counted(x or "", counts) for x in b.column(n).to_pylist()])], names=schema.names)

    return chosen.mapInArrow(run, schema)


def loaded(b: pa.RecordBatch, at: int, counts: PieceCounts) -> Iterator[Counted]:
    """The trees of a batch whose columns ``STORED`` begin at ``at``."""
    for leaves, sizes, chars, tokens in zip(*(b.column(at + k).to_pylist() for k in range(4)), strict=True):
        yield Counted.of_stored(list(zip(leaves, sizes, strict=True)), chars, tokens, counts)


def edited(stored: DataFrame, edits, id: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``stored`` trees after edits; ``n_edits`` is their number, ``n_encoded`` how many characters they encoded.

    ``edits`` is a column of ``stored`` with an array of structs (start, stop, new), applied in order, each to the text as it
    then is; or a function from (id, characters) to a list of such triples.
    """
    columns = [c for c in stored.columns if c not in StructType.fromDDL(STORED).names]
    schema = wide(stored.select(*columns).schema, STORED)
    n, place, of = len(columns), columns.index(edits if isinstance(edits, str) else id), None if isinstance(edits, str) else edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for b in slices(batches, n):
            docs = []
            for doc, own in zip(loaded(b, n, counts), b.column(place).to_pylist(), strict=True):
                for start, stop, new in of(own, doc.chars) if of else [(e["start"] or 0, e["stop"] or 0, e["new"]) for e in own or () if e]:
                    doc.edit(start, stop, new or "")
                docs.append(doc)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *rows_of(docs)], names=schema.names)

    return stored.select(*columns, *StructType.fromDDL(STORED).names).mapInArrow(run, schema)


def total(sums: str) -> Column:
    """The root's sum."""
    return F.aggregate(sums, F.lit(0).cast("long"), lambda s, x: s + x)


def token_counts(docs: DataFrame, edits, id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, n_chars, n_tokens, n_edits, n_chars_edited, n_tokens_edited, n_encoded) for every row of ``docs``.

    The trees of all documents are written once, packed by zstd, and edited from there (see ``edited``); counts are their roots'
    sums.
    """
    keep = [F.col(id).alias("id"), *([F.col(edits).alias("edits")] if isinstance(edits, str) else [])]
    stored = written(trees(docs.select(*keep, F.col(text).alias("text")), keep=["id", *(["edits"] if isinstance(edits, str) else [])], vocabulary=vocabulary), "edits-trees", codec="zstd")
    stored = stored.withColumns({"n_chars": total("chars"), "n_tokens": total("tokens")})
    done = edited(stored, "edits" if isinstance(edits, str) else edits, "id", vocabulary)
    return done.select(F.col("id").alias(id), "n_chars", "n_tokens", "n_edits", total("chars").alias("n_chars_edited"), total("tokens").alias("n_tokens_edited"), "n_encoded")


def revision(id: int | None, chars: int) -> list[tuple[int, int, str]]:
    """An editor's pass over a document, the same for the same id: a correction, a deletion, an insertion and a last line."""
    h = xxhash.xxh64_intdigest(str(id).encode())
    at = [(h >> 16 * k & 0xFFFF) * chars >> 16 for k in range(3)]
    return [(at[0], at[0] + 5, "it's"), (at[1], at[1] + 40, ""), (at[2], at[2], " (see note 12)\n"), (chars, chars, "\nRevised.")]
