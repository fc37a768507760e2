r"""Chat formatting in budgeted windows.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``. In texts and roles, ``<``, backslashes and ``|`` get one more backslash,
so no control string can come from a text and removing one backslash gives it back; a role's line breaks are escaped too.

A conversation's turns, in order, have prefix sums of their tokens. A window is the longest span of turns whose sum, with
the system turn, stays in the budget. Each later window retains the system turn and repeats the last turns before it, as
many as ``history`` tokens and the room beside its first new turn allow. Where a span begins and ends is found in the prefix
sums, by binary search. The loss mask covers the text of new assistant turns alone, so that a repeated target is never learnt
twice. A turn that alone exceeds the budget gets a window of its own, whole, marked ``over_budget``.

Turns are counted where they are. They are then dealt out by ranges of (conversation, order), so that a conversation of any
size is spread over tasks; a turn's number in its conversation is its place in its task plus the offset of the one
conversation, if any, that has turns in the tasks before. A conversation is cut at every ``segment`` turns, where a window
ends: each segment makes its windows by itself, from its turns, a copy of the system turn, and copies of the turns before it
that may be its history. So no task has more than a segment of one conversation together, and streams it: memory holds a
window's turns.

Defined cases: null texts and roles are empty; an empty text is a turn with an empty mask; ties and repeated rows are turns
like others, ordered by turn (nulls first), role and text; rows without a conversation id are one conversation; only a
first turn of the system's is retained; windows are numbered upwards, with a gap after each segment; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltline.llm.common import slices, written
from siltline.llm.tokens import piece_counts

START, END = "<|im_start|>", "<|im_end|>"
WINDOW = "conv_id long, window long, text string, loss array<struct<start:long,stop:long>>, first_turn long, n_turns long, n_repeated long, n_tokens long, over_budget boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def line(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unline(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


class Segment:
    """Takes a segment's turns in order and gives windows as soon as they are full.

    ``sums[i]`` are the tokens of all turns before the i-th held one, and so of any span by one subtraction.
    """

    def __init__(self, id: int | None, number: int, budget: int, history: int):
        self.id, self.number, self.budget, self.history = id, number, budget, history
        self.system, self.first, self.turns, self.sums, self.new, self.windows = None, False, [], [0], 0, 0

    def retain(self, turn: tuple, first: bool) -> None:
        """The system turn; ``first`` if this is where it stands."""
        self.system, self.first = turn, first

    def before(self, turn: tuple) -> None:
        """A turn of the segment before."""
        self.hold(turn)
        self.new = len(self.turns)

    def hold(self, turn: tuple) -> None:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])

    def drop(self, n: int) -> None:
        self.turns, self.sums, self.new = self.turns[n:], self.sums[n:], self.new - n

    def room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0)

    def repeat(self, size: int) -> None:
        """Keeps the history that a window may have whose first new turn has ``size`` tokens."""
        self.new = len(self.turns)
        self.drop(min(bisect_left(self.sums, self.sums[-1] - min(self.history, self.room() - size)), self.new))

    def add(self, turn: tuple) -> Iterator[dict]:
        if self.new == len(self.turns):  # the segment's first
            self.repeat(turn[2])
        elif self.sums[-1] + turn[2] - self.sums[0] > self.room():
            yield self.window()
            self.repeat(turn[2])
        self.hold(turn)

    def window(self) -> dict:
        """All held turns, of which those from ``new`` on are new."""
        own, retained = self.turns, [self.system] if self.system else []
        fresh = len(own) - self.new + self.first
        text, loss, at = "".join(t[1] for t in (*retained, *own)), [], 0
        for n, (role, whole, _, head, body, _) in enumerate((*retained, *own)):
            if role == "assistant" and n >= len(retained) + self.new:
                loss.append({"start": at + head, "stop": at + head + body})
            at += len(whole)
        size = self.sums[-1] - self.sums[0] + sum(t[2] for t in retained)
        first_turn = retained[0][5] if self.first else own[self.new][5]
        self.windows, self.first = self.windows + 1, False
        return {"conv_id": self.id, "window": self.number + self.windows - 1, "text": text, "loss": loss, "first_turn": first_turn, "n_turns": fresh, "n_repeated": len(own) + len(retained) - fresh, "n_tokens": size, "over_budget": size > self.budget}

    def end(self) -> Iterator[dict]:
        if len(self.turns) > self.new or (self.first and not self.windows):
            yield self.window()


#: What a turn of a segment is: the conversation's system turn, one of the segment before, one of its own.
SYSTEM, BEFORE, OWN = 0, 1, 2


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (c, n, r, t, row, ...) with their number ``i`` in their conversation, by n, r and t; no conversation has to fit a task."""
    ranged = rows.repartitionByRange("c", "n", "r", "t", "row").sortWithinPartitions("c", "n", "r", "t", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, at = TaskContext.get().partitionId(), (), 0
        for b in batches:
            c = b.column(0).to_pylist()
            place = []
            for x in c:
                last, at = (last, at + 1) if last == (x,) else ((x,), 0)
                place.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array([task] * len(c), pa.int64())], names=[*b.schema.names, "i", "task"])

    placed = written(ranged.mapInArrow(run, StructType([*rows.schema.fields, StructField("i", LongType()), StructField("task", LongType())])), "chat-placed")
    # A task's last row is of the one conversation that can go on in the next: a row for each task, however many turns.
    ends = placed.groupBy("task").agg(F.max_by(F.struct("c", "i"), F.struct(F.col("c").isNotNull(), "c", "i")).alias("e"), F.min(F.struct(F.col("c").isNotNull(), "c")).alias("b"))
    offsets, last, so_far = [], (), 0
    for x in sorted(ends.collect(), key=lambda x: x.task):
        held = so_far if last == (x.b.c,) else 0  # turns of its first conversation in the tasks before
        if held:
            offsets.append((x.task, x.b.c, held))
        last, so_far = (x.e.c,), x.e.i + 1 + (held if x.e.c == x.b.c else 0)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "task long, c_off long, off long"))
    found = placed.join(offsets, (placed.task == offsets.task) & placed.c.eqNullSafe(offsets.c_off), "left").drop(offsets.task)
    return found.withColumn("i", F.col("i") + F.coalesce("off", F.lit(0))).drop("task", "c_off", "off")


def segmented(turns: DataFrame, segment: int, history: int) -> DataFrame:
    """Numbered turns (c, i, r, ...) by segment ``s``, each with copies of the system turn and of those that may be its history."""
    s = F.floor(F.col("i") / segment)
    # A formatted turn has at least one token, so no more than ``history`` turns are history.
    tail = (F.col("i") % segment >= segment - history) & (F.col("i") > 0)
    system = (F.col("i") == 0) & (F.col("r") == "system")
    copies = F.when(system, F.array(F.struct(s.alias("s"), F.lit(SYSTEM).alias("k")))).when(
        tail, F.array(F.struct(s.alias("s"), F.lit(OWN).alias("k")), F.struct((s + 1).alias("s"), F.lit(BEFORE).alias("k")))
    ).otherwise(F.array(F.struct(s.alias("s"), F.lit(OWN).alias("k"))))
    own = turns.select("*", F.explode(copies).alias("p"))
    # Conversations that go on after their first segment need their system turn there too.
    large = turns.where(F.col("i") % segment == 0).where("i > 0").groupBy("c").agg(F.max("i").alias("last"))
    first = turns.where(system).join(large.withColumnRenamed("c", "c_large"), F.col("c").eqNullSafe(F.col("c_large")))
    more = first.select(*turns.columns, F.explode(F.sequence(F.lit(1), F.floor(F.col("last") / segment))).alias("s")).select(*turns.columns, F.struct("s", F.lit(SYSTEM).alias("k")).alias("p"))
    return own.unionByName(more).select("c", "p.s", "p.k", *(x for x in turns.columns if x != "c"))


def windows(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, segment: int = 4096, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The windows of every conversation (see ``WINDOW``)."""
    if segment <= history:
        raise ValueError("segment must be larger than history")
    rows = conversations.select(F.col(id).cast("long").alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    schema = conversations.sparkSession.createDataFrame([], WINDOW).schema
    kinds = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), *((c, pa.int64()) for c in ("first_turn", "n_turns", "n_repeated", "n_tokens")), ("over_budget", pa.bool_())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counts(vocabulary).count
        for b in slices(batches, 3):
            tokens = [count(f"{START}{line(r)}\n{escaped(t)}{END}\n") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.int64())], names=[*b.schema.names, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in slices(batches, 4):
            out = []
            for c, s, k, r, t, i, tokens in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if now is None or (now.id, now.number) != (c, s * segment):
                    if now is not None:
                        out += now.end()
                    now = Segment(c, s * segment, budget, history)
                head, body = f"{START}{line(r)}\n", escaped(t)
                held = (r, f"{head}{body}{END}\n", tokens, len(head), len(body), i)
                if k == SYSTEM:
                    now.retain(held, s == 0)
                elif k == BEFORE:
                    now.before(held)
                else:
                    out += now.add(held)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(now.end()), kinds)

    turns = numbered(rows.mapInArrow(counted, StructType([*rows.schema.fields, StructField("tokens", LongType())])))
    dealt = segmented(turns, segment, history).select("c", "s", "k", "r", "t", "i", "tokens").repartition("c", "s").sortWithinPartitions("c", "s", "k", "i")
    return dealt.mapInArrow(run, schema)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    found, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        found.append((unline(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"text after the last turn at {at}")
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, from the windows' texts and masks alone: its turns, targets and sizes (see ``READ``).

    A digest over all turns in order has no parallel form: one task streams a conversation's windows, a batch at a time.
    """
    names = ["conv_id", "text", "loss", "n_repeated"]
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row() -> dict:
            return dict(zip(kinds.names, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]), strict=True))

        for b in batches:
            out = []
            for c, text, loss, repeated in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        out.append(row())
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns_of(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["stop"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
                now[6] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row()], kinds)

    return formatted.select(*names, "window").repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, READ)
