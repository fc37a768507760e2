"""Tokens, token counts under edits, packing, chat: without Spark where it isn't needed."""

import os
import random
from array import array
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.llm import chat, packing
from siltline.llm.edits import Counted, revision, token_counts
from siltline.llm.tokens import piece_counts, word_ids

PIECES = st.text(st.sampled_from("ab  \n'sretdl.1é!\t"), max_size=60)


@given(st.text(st.sampled_from("aB's tRéΣİ\x1c\x85<|endoftext|>9٣.,中\U0001f600J̌\t\n"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_word_ids_are_the_tokenizers(text):
    ids = word_ids("word_bpe_49k.json")
    assert ids.text(text) == array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@given(PIECES, st.lists(st.tuples(st.integers(-1, 70), st.integers(0, 40), PIECES), max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_follow_edits(text, edits):
    counts = piece_counts("byte_bpe_50k.tiktoken")
    doc = Counted(text, counts)
    for start, size, new in edits:
        a = min(max(0, start), len(text))
        b = min(max(a, start + size), len(text))
        text = text[:a] + new + text[b:]
        doc.edit(start, start + size, new)
        assert doc.text() == text and doc.chars == len(text)
        assert doc.tokens == len(counts.encoding.encode_ordinary(text))
        place = len(text) // 2
        at, want = 0, 0
        for piece in counts.find(text):
            at += len(piece)
            want += counts[piece] if at <= place else 0
        assert doc.tokens_before(place) == want


def test_edits_encode_little():
    doc = Counted("some plain words here " * 5000, piece_counts("byte_bpe_50k.tiktoken"))
    before = doc.encoded
    doc.edit(50_000, 50_005, "other")
    assert doc.encoded - before < 200


def test_token_counts(spark):
    rows = [(1, "Some text, it's here.", 7), (1, "Some text, it's here.", 7), (2, None, 7), (3, "", 7), (None, "word " * 40_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    counts = piece_counts("byte_bpe_50k.tiktoken")
    out = token_counts(docs, revision).collect()
    want = []
    for id, text, _ in rows:
        now = text or ""
        for a, b, new in revision(id, len(now)):
            a, b = min(a, len(now)), min(b, len(now))
            now = now[:a] + new + now[b:]
        want.append((id, len(text or ""), counts.count(text or ""), 4, len(now), counts.count(now)))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted(want, key=key)
    assert token_counts(docs.limit(0), revision).collect() == []
    own = spark.createDataFrame([(1, "abc", [(0, 1, "x"), (9, 9, None)])], "doc_id long, text string, e array<struct<start:long,stop:long,new:string>>")
    assert token_counts(own, "e").first().n_tokens_edited == counts.count("xbc")


def test_stored_trees_go_on_from_edit_to_edit(spark):
    from siltline.llm import edits

    counts, n = piece_counts("byte_bpe_50k.tiktoken"), 20_000
    said = {1: "some plain words here " * n, 2: "", 3: "untouched text, " * 50, 4: None}
    docs = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    stored = edits.written(edits.trees(docs), "test-trees")
    assert {x.doc_id: x.n_encoded for x in stored.collect()} == {k: len(v or "") for k, v in said.items()}
    text = {k: v or "" for k, v in said.items()}
    for start, stop, new in ((200_000, 200_005, "other"), (7, 7, "\n\nand more"), (10**9, 10**9, " the end")):
        own = spark.createDataFrame([(k, [(start, stop, new)]) for k in (1, 2)], "doc_id long, e array<struct<start:long,stop:long,new:string>>")
        stored = edits.written(edits.edited(stored.join(own, "doc_id", "left"), "e").drop("e"), "test-trees")
        for k in (1, 2):
            a, b = min(start, len(text[k])), min(stop, len(text[k]))
            text[k] = text[k][:a] + new + text[k][b:]
        got = {x.doc_id: x for x in stored.collect()}
        assert {k: "".join(x.leaves) for k, x in got.items()} == text
        assert {k: sum(x.tokens) for k, x in got.items()} == {k: len(counts.encoding.encode_ordinary(t)) for k, t in text.items()}
        assert 0 < got[1].n_encoded < 300 and got[3].n_encoded == got[4].n_encoded == 0
    assert edits.edited(stored.limit(0), edits.revision).collect() == []


def test_only_touched_leaves_are_cut():
    counts = piece_counts("byte_bpe_50k.tiktoken")
    doc = Counted.of_stored(*Counted("some plain words here " * 5000, counts).stored(), counts)
    doc.edit(50_000, 50_005, "other")
    cut = sum(x.pieces is not None for x in list.__iter__(doc.leaves))
    assert 0 < cut <= 4 < len(doc.leaves) and doc.encoded < 200


def filled(counts, capacity):
    places, n, fixed = packing.plan(counts, capacity)
    bins, seen = defaultdict(list), defaultdict(set)
    for size, low, high, first, each, offset in places:
        for r in range(low, high):
            assert r not in seen[size]
            seen[size].add(r)
            bins[first + (r - low) // each].append((offset + (r - low) % each * size, size))
    assert {s: len(r) for s, r in seen.items() if r} == {s: c for s, c in counts.items() if c}
    assert sorted(bins) == list(range(n)) and fixed <= n
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    return n


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k + items[i] <= capacity:
                j = bins.index(k)
                go(i + 1, [*bins[:j], k + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@given(st.dictionaries(st.integers(1, 20), st.integers(0, 30), max_size=15))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    n = filled(counts, 20)
    assert n >= -(-sum(s * c for s, c in counts.items()) // 20)


def test_reduction_never_costs_a_bin():
    r = random.Random(5)
    for n in range(1500):
        capacity = 12 if n < 300 else r.choice((24, 30, 40))
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 8 if n < 300 else 10))]
        stock = packing.Stock({s: items.count(s) for s in items}, capacity)
        packing.reduce(stock)
        left = [s for s in range(1, capacity + 1) for _ in range(stock.left[s])]
        assert stock.sequences + fewest(left, capacity) == fewest(items, capacity), (capacity, items)


def test_reduction_leaves_a_pair_that_three_pieces_could_replace():
    items = [60, 39, 39, 22, 14, 13, 13]
    stock = packing.Stock({s: items.count(s) for s in items}, 100)
    packing.reduce(stock)
    left = [s for s in range(1, 101) for _ in range(stock.left[s])]
    assert stock.sequences + fewest(left, 100) == 2 == fewest(items, 100)


def test_plan_refuses_pieces_that_do_not_fit():
    with pytest.raises(ValueError):
        packing.plan({21: 1}, 20)


@given(st.text(st.sampled_from("<|im_start>\\n\n"), max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    assert chat.unline(chat.line(text)) == text and "\n" not in chat.line(text)


def test_chat_windows(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "Be brief."), *((1, n, ("user", "assistant")[n % 2 == 0], f"Turn {n} says " + "word " * 60) for n in range(1, 40))]
    rows += [(2, 0, "user", said), (2, 1, "assistant", said), (3, 0, "assistant", None), (None, 5, None, ""), (4, 1, "user", "long " * 3000), (4, 2, "assistant", "a"), (4, 2, "assistant", "a"), (5, 0, "system", "alone")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    windows = chat.windows(table, budget=300, history=100)
    held = windows.collect()
    for w in held:
        turns = chat.turns_of(w.text)
        assert w.n_tokens <= 300 or (w.over_budget and w.n_turns == 1)
        assert len(turns) == w.n_turns + w.n_repeated
    first = [w for w in held if w.conv_id == 1]
    assert len(first) > 5 and all(chat.turns_of(w.text)[0] == ("system", "Be brief.") for w in first)
    assert all(w.n_repeated > 1 for w in first[1:])
    import hashlib

    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for id in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == id), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = back[id]
        assert (got.n_turns, got.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got.formatted_chars == sum(len(w.text) for w in held if w.conv_id == id)
    assert chat.read_back(chat.windows(table.limit(0))).collect() == []


def test_windows_by_plain_search_and_split_conversations(spark):
    """Every window against a plain greedy choice, where segments are small, and the same turns whatever the partitions."""
    r = random.Random(12)
    rows = []
    for c in (None, *range(6)):
        start = c is not None and c % 2
        rows += [(c, 0, "system", "Say little.")] * start
        rows += [(c, n + start, ("user", "assistant")[n % 2], "word " * r.choice([0, 1, 5, 30, 200])) for n in range((7, 300, 64, 65, 63, 128, 1)[-1 if c is None else c])]
    rows += [(7, 1, "user", "same")] * 150  # one key, cut nowhere by its value
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    budget, history, segment = 150, 40, 64
    count = piece_counts("byte_bpe_50k.tiktoken").count
    size = lambda t: count(f"{chat.START}{chat.line(t[2])}\n{chat.escaped(t[3])}{chat.END}\n")
    got = defaultdict(list)
    for w in chat.windows(table, budget=budget, history=history, segment=segment).collect():
        got[w.conv_id].append((w.first_turn, w.n_turns, w.n_repeated, w.n_tokens, w.window))
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2], x[3]))
        system = own[0] if own[0][2] == "system" else None
        room, at, want = budget - (size(system) if system else 0), int(system is not None), []
        while at < len(own):
            back, total = at, 0
            while at > (system is not None) and back > (system is not None) and total + size(own[back - 1]) <= min(history, room - size(own[at])):
                back -= 1
                total += size(own[back])
            stop = at
            while stop < len(own) and (stop == at or (total + size(own[stop]) <= room and stop % segment)):
                total += size(own[stop])
                stop += 1
            first = system is not None and not want
            want.append((0 if first else at, stop - at + first, at - back + (system is not None) - first, total + budget - room))
            at = stop
        mine = sorted(got[c], key=lambda w: w[4])
        assert [w[:4] for w in mine] == want, c
        assert len({w[4] for w in mine}) == len(mine)


def test_numbers_do_not_depend_on_partitions(spark):
    table = spark.createDataFrame([(n % 3 if n < 900 else None, n // 7, "r", str(n % 5), n) for n in range(1000)], "c long, n int, r string, t string, row long")
    want = None
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted((repr(x.c), x.i, x.n, x.t) for x in chat.numbered(table).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = want or got
        assert got == want
    assert [x[1] for x in want if x[0] == "None"] == list(range(100))


def test_stored_trees_take_little_more_than_their_texts(spark, tmp_path, monkeypatch):
    from siltline.llm import edits

    r, places = random.Random(40), []
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(3000)]
    said = [" ".join(r.choices(vocabulary, k=400)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents"))

    def kept(*args, of=edits.written, **options):
        out = of(*args, **options)
        places.append(out.written_to)
        return out

    monkeypatch.setattr(edits, "written", kept)
    assert edits.token_counts(docs, edits.revision).count() == 600
    size = lambda p: sum(os.path.getsize(os.path.join(p, f)) for f in os.listdir(p))
    assert len(places) == 1 and size(places[0]) < 1.3 * size(tmp_path / "documents")
