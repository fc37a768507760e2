"""Secret scans with corpus-wide ownership frequency.

Base kinds (always reported): ``assign`` (a credential name, an assignment and a value), ``access`` (access key ids) and
``hex`` (long hexadecimal strings). The method looks for weaker candidates as well: prefixed service tokens, private key
blocks, credentials in urls, bearer and signed web tokens, random-looking values of names that the base kinds don't know, and
long mixed-class strings; none of them inside a base match. Every candidate's value, base or not, is hashed, and hashes are
aggregated over the whole corpus by distinct owners and repositories. A weak candidate becomes a span if its value belongs
to few owners (``most_owners``) and repositories (``most_repositories``) and so looks live; what many share is a copied
example. The base spans that look live by the same test are told apart in ``live``.

Aggregation is by (hash, repository, owner) and then by hash, so that a value that a third of all rows hold has been
reduced to its distinct owners before the last shuffle; candidates of such values meet a broadcast of them, and the others
are joined by hash. Texts are never shuffled: candidates are written to the shared folder, with a row id, as they are found;
text is only joined again where it is redacted, and then only of rows with spans.

Places are code points, ends exclusive. Every pattern looks at a character a bounded number of times, whatever the text, and
none has an upper bound on what it matches. Defined cases: a null text is empty; a null repository or owner is an owner of
its own kind (one for all such rows); repeated rows and ids give a row each; extra columns are ignored, or kept by
``redacted``; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltline.llm.common import free_name, hot_keys, joined, slices, written

#: Fixed by the query's contract, in the order in which kinds are listed. Groups: the value's.
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    # A run of 32 or more is where the first match of 32 or more begins, so this equals dropping shorter runs.
    ("hex", r"([0-9a-f]{32,})", 32),
)
WEAK = (
    ("service", r"((?:gh[pousr]_|glpat-|xox[abpr]-|sk_live_|rk_live_|AIza|ya29\.|npm_|SG\.)[A-Za-z0-9_.-]{16,})", 20),
    ("key", r"(-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----[A-Za-z0-9+/=\s]++-----END)", 48),
    # The scheme, before the match, is looked at afterwards.
    ("url", r"://[^\s/:@]++:([^\s/@]++)@", 6),
    ("bearer", r"[Bb]earer\s++([A-Za-z0-9+/_.=~-]++)", 16),
    ("signed", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", 24),
    ("named", r"""(?:[Aa][Uu][Tt][Hh]|[Cc][Rr][Ee][Dd]|[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll][Ss]?|[Pp][Ww][Dd]|[Kk][Ee][Yy]|[Pp][Ii][Nn]|[Ss][Ii][Gg][Nn][Aa][Tt][Uu][Rr][Ee])["']?\s*+[:=]\s*+["']?([A-Za-z0-9+/_.=-]++)""", 12),
    ("mixed", r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{24,}+)", 24),
)
#: Distinct owners, and repositories, up to which the registered query and the pipeline take a value for live: a leaked
#: document and its copies in a few other sources stay under it, an example copied about doesn't.
WIDELY = 10
KINDS = {kind: n for n, (kind, _, _) in enumerate((*BASE, *WEAK))}
FINDERS = [(kind, re.compile(pattern), least) for kind, pattern, least in (*BASE, *WEAK)]
#: Without one of these a text can't match the kind; looked for in the text without upper case.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "service": ("gh", "glpat-", "xox", "k_live_", "aiza", "ya29.", "npm_", "sg."), "key": ("private key",), "url": ("://",), "bearer": ("bearer",), "signed": ("eyj",), "named": ("auth", "cred", "pwd", "key", "pin", "signature")}


def mixed(value: str) -> bool:
    """Lower case, upper case and digits, and no letter pattern of a plain word."""
    digits = sum(c.isdigit() for c in value)
    return 3 <= digits and any(c.islower() for c in value) and any(c.isupper() for c in value)


def random_looking(value: str) -> bool:
    """Digits and letters, and at least three bits to a character."""
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    return sum(-n / len(value) * log2(n / len(value)) for n in Counter(value).values()) >= 3


#: What a weak value must look like besides.
LOOKS = {"mixed": mixed, "named": random_looking, "bearer": random_looking}


def scheme(text: str, end: int, after: int) -> int | None:
    """Where the scheme of a url begins that ends at ``end``, no earlier than ``after``: at the first letter of its characters."""
    start = end
    while start > after and text[start - 1] in "abcdefghijklmnopqrstuvwxyz0123456789+.":
        start -= 1
    return next((i for i in range(start, end) if text[i].isalpha()), None)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    low, out = text.lower(), []
    for kind, finder, least in FINDERS:
        if kind in HINTS and not any(h in low for h in HINTS[kind]):
            continue
        after = 0
        for m in finder.finditer(text):
            if len(m[1]) < least or (kind in LOOKS and not LOOKS[kind](m[1])):
                continue
            start = m.start()
            if kind == "url":
                start, after = scheme(text, start, after), m.end()
            if start is not None:
                out.append((kind, start, m.end(), m[1]))
    out.sort(key=lambda c: (c[1], KINDS[c[0]]))
    kept, stop = [], -1
    for c in out:  # a weak match inside a base one says nothing new
        if KINDS[c[0]] < len(BASE):
            stop = max(stop, c[2])
        elif c[2] <= stop:
            continue
        kept.append(c)
    return kept


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCAN = "row string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:string,start:long,stop:long,hash:long>>"
SPAN = "struct<kind:string,start:long,stop:long>"


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the base counts, and all candidates with their values' hashes; ``row`` tells rows apart once this is written."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    n = len(keep)
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.int64())]))
    names = [*keep, "row", "n_assign", "n_access", "n_hex", "base_sha256", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, n):
            rows, counts, digests, found = [], [], [], []
            for text in b.column(n).to_pylist():
                all_ = candidates(text or "")
                base = [c[:3] for c in all_ if KINDS[c[0]] < len(BASE)]
                rows.append(f"{task}-{at}")
                counts.append([sum(c[0] == kind for c in base) for kind, _, _ in BASE])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                found.append([{"kind": c[0], "start": c[1], "stop": c[2], "hash": xxhash.xxh64_intdigest(c[3].encode()) - (1 << 63)} for c in all_])
                at += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(found, shape)], names=names)

    schema = chosen.drop("_text").schema
    for field in StructType.fromDDL(SCAN).fields:
        schema = schema.add(field)
    return chosen.mapInArrow(run, schema)


def ownership(held: DataFrame) -> DataFrame:
    """(hash, repositories, owners, n: all occurrences) over all candidates."""
    each = held.select(F.explode("found.hash").alias("hash"), F.struct("repository").alias("repository"), F.struct("owner").alias("owner"))
    each = each.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


def spans(held: DataFrame, most_owners: int = 1, most_repositories: int = 2) -> DataFrame:
    """(row, spans: base and live-looking weak ones in order, live: those that look live, n_live, n_copied) of the rows that have candidates."""
    each = held.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    owned = written(ownership(held), "secrets-owners")
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = joined(each, owned.drop("n"), "hash", hot_keys(owned, "hash", total))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    order = F.create_map(*(F.lit(x) for k, n in KINDS.items() for x in (k, n)))
    base = F.col("kind").isin(*(k for k, _, _ in BASE))
    place = F.struct("start", order[F.col("kind")].alias("n"), "kind", "stop")
    rows = each.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base | live, place))).alias("s"), F.array_sort(F.collect_list(F.when(live, place))).alias("l"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"),
    )

    def bare(column: str) -> Column:
        return F.transform(column, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))

    return rows.select("row", bare("s").alias("spans"), bare("l").alias("live"), "n_live", "n_copied")


def repository_of(docs: DataFrame) -> Column:
    """In tables of documents, an owner is a source, and has a repository for each language (if there is such a column)."""
    return F.concat_ws("/", *(c for c in ("source", "lang") if c in docs.columns))


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", repository: str | Column = "source", owner: str | Column = "source", **options) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live) for every row of ``docs``."""
    base = docs.select(F.col(id).alias("id"), column(repository).alias("repository"), column(owner).alias("owner"), F.col(text).alias("text"))
    held = written(scan(base, ["id", "repository", "owner"]), "secrets-candidates")
    out = held.drop("found", "repository", "owner").join(spans(held, **options), "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return out.select(
        F.col("id").alias(id), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("live", none).alias("live"),
    )


def without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with a mark for each run of overlapping spans."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", repository: str | Column = "source", owner: str | Column = "source", length: str | None = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with all spans of a text replaced by ``mark``; ``length``, if such a column is there, follows."""
    base = docs.select(F.struct(*docs.columns).alias("d"), column(repository).alias("repository"), column(owner).alias("owner"), F.col(text).alias("text"))
    held = written(scan(base, ["d", "repository", "owner"]), "secrets-documents")
    # Only rows with candidates meet the corpus-wide result; all others stay where they are.
    some = held.where(F.size("found") > 0).select("row", "d").join(spans(held, **options), "row")
    whole = held.where(F.size("found") == 0).select("d.*")
    new = free_name(docs, "_new")
    changed = some.select("d", F.col("spans").alias("cut"), F.col(f"d.{text}").alias("t"))
    schema = changed.select("d", F.col("t").alias(new)).schema

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [without(t, [(s["start"], s["stop"]) for s in p], mark) for t, p in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["d", new])

    done = changed.mapInArrow(swap, schema)
    columns = [F.col(new).alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == length else F.col(f"d.{c}").alias(c) for c in docs.columns]
    return whole.union(done.select(*columns))
