"""Secret scan with one combined automaton.

All rules are compiled into one minimal automaton, and every byte is read once
for all of them.  It tells where matches of each rule end; the start of a match
is found by the rule's mirrored automaton, read backwards from its first end,
and its last end by the anchored one.  A rule must therefore be such that of
two overlapping matches the one that starts first also has the first end, which
holds for a keyword or prefix followed by a run; the tests hold every rule
against Python's regexes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm import automaton
from pairloom.llm.common import encoded, map_arrow, slices, spare


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern count where the group has at least `least` bytes; others are dropped, yet consumed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Eight in the automaton keep it small; shorter runs can't count.
    Rule("hex", r"[0-9a-f]{8,}", 0, 24),
)
# Public formats of well-known services.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA


@cache
def _machines(rules: tuple[Rule, ...]):
    one = automaton.compile_rules([r.pattern for r in rules])
    forth = [automaton.compile_rules([r.pattern], anchored=True) for r in rules]
    back = [automaton.compile_rules([r.pattern], anchored=True, mirrored=True) for r in rules]
    alone = [automaton.compile_rules([r.pattern]) for r in rules]
    return one, forth, back, alone, [re.compile(r.pattern.encode()) for r in rules]


def find(texts: Sequence[bytes], rules: tuple[Rule, ...] = RULES, machines=None) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule) in bytes for each text, by start and rule; leftmost and non-overlapping per rule.

    Linear: a backward read ends where the match before it ended, and an end
    whose start lies before that is skipped by one forward read, which goes on
    behind the match it finds.
    """
    one, forth, back, alone, plain = machines or _machines(rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends, bits = automaton.scan(one, np.frombuffer(b"\xff".join(texts), np.uint8))
    owner = np.searchsorted(starts, ends - 1, side="right") - 1
    for number, rule in enumerate(rules):
        own = ends[bits >> number & 1 > 0]
        whose = owner[bits >> number & 1 > 0]
        i = free = 0
        doc = -1
        while i < len(own):
            if whose[i] != doc:
                doc, free = int(whose[i]), 0
            text, base = texts[doc], int(starts[doc])
            start = back[number].last_accept(text, int(own[i]) - base, free, -1)
            if start < 0:
                # What was accepted here starts before `free`: the next end of a match that does not.
                end = alone[number].first_accept(text, free)
                start = back[number].last_accept(text, end, free, -1) if end >= 0 else -1
            if start < 0:
                i = int(np.searchsorted(own, base + len(text), side="right"))
                continue
            free = forth[number].last_accept(text, start, len(text), 1)
            if not rule.least or len(plain[number].fullmatch(text, start, free)[rule.group]) >= rule.least:
                out[doc].append((start, free, number))
            i = int(np.searchsorted(own, base + free, side="right"))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with places counted in code points."""
    if not spans or text.isascii():
        return spans
    places = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))
    return [(int(places[a]), int(places[b]), k) for a, b, k in spans]


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def with_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end) in code points, by start, then the order of the rules.

    A null or empty text has no spans.  Repeated rows each get a row, an empty
    table gives an empty one.  Texts are scanned whole, in pieces of some
    megabytes; a longer one makes a piece of its own.  No shuffle.
    """
    raw = spare(docs, "__bytes")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kinds, machines = [r.kind for r in rules], _machines(rules)
    result = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for piece in slices(batch, last):
                texts = piece.column(last).to_pylist()
                found = [
                    [{"kind": kinds[k], "start": a, "end": b} for a, b, k in in_code_points(t, s)]
                    for t, s in zip(texts, find(texts, rules, machines))
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found, result)], names=[*names, into])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into, SPANS)])
    return map_arrow(docs.select(*columns, encoded(text).alias(raw)), run, schema)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digests(spans: DataFrame, base: Sequence[str] = tuple(r.kind for r in BASE)) -> DataFrame:
    """The contract columns from an array of spans: counts, the digest of the base spans, all spans as text."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ours = F.filter("secrets", lambda s: s["kind"].isin(*base))
    return spans.select(
        "doc_id",
        *[F.size(F.filter("secrets", _is(k))).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(F.transform(ours, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", said), ",").alias("spans"),
    )


def masked(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by [kind]; overlapping secrets by the first one's kind.

    A null text stays null, repeated rows each get a row, an empty table gives
    an empty one, all other columns stay as they are.
    """
    raw = spare(docs, "__bytes")
    names = docs.columns
    place = names.index(text)
    kinds, machines = [r.kind for r in rules], _machines(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for piece in slices(batch, last):
                texts = piece.column(last).to_pylist()
                found = find(texts, rules, machines)
                columns = list(piece.columns[:-1])
                if any(found):
                    old = columns[place].to_pylist()
                    columns[place] = pa.array([_cut(t, s, kinds) if s else o for t, s, o in zip(texts, found, old)], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = [F.col(f"`{c}`") for c in names]
    return map_arrow(docs.select(*columns, encoded(text).alias(raw)), run, docs.schema)


def _cut(text: bytes, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kinds[kind]}]".encode()]
        at = max(at, end)
    return b"".join([*out, text[at:]]).decode()
