"""Large JSON documents read in byte ranges.

A document of any size is cut into ranges, each a task's work of its own.  Three
passes over the ranges find where rows begin, without a task that reads a whole
document:

1. Each range counts its quotes and brackets, once as if it began inside a
   string and once as if not.  Added up in order this tells every range whether
   it begins in a string, and how deep.
2. Knowing that, each range tells what later ones have to know: the last key of
   the document's object, the kind of the container below it, and how many
   elements it has gone through.
3. Each range hands out the items whose leading delimiter lies in it, as JSON
   text; the last one is read to its end beyond the range.

Items are what stands one level below a list document, or two levels below an
object (one where a value is not a container).  A task holds one range and one
item.  Only a few numbers per range are shuffled between passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.session import map_arrow, materialise
from pairloom.sources.file_lists import FILES, HELD, ROWS, list_tree, located

RANGE_BYTES = 8 << 20
_MORE = 1 << 20
# Bytes before a delimiter that are looked at first.
_NEAR = 256
_QUOTE, _ESCAPE = 34, 92
_BLANK = b" \t\r\n"
_MARK = np.zeros(256, bool)
_MARK[list(b"{}[],:")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


class _File:
    """Byte ranges of a file."""

    def __init__(self, uri: str) -> None:
        system, path = located(uri)
        self.file = system.open_input_file(path)

    def read(self, start: int, stop: int) -> bytes:
        return self.file.read_at(max(0, stop - start), start) if stop > start else b""

    def escapes_before(self, at: int) -> bool:
        """Whether an odd number of backslashes stands right before a place."""
        count = 0
        while at > 0:
            part = self.read(max(0, at - 64), at)
            own = len(part) - len(part.rstrip(b"\\"))
            count += own
            if own < len(part):
                break
            at -= len(part)
        return count % 2 == 1


def marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of unescaped quotes and of brackets, commas and colons, and how many of the quotes stand before each of those."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == _QUOTE)
    slashes = np.flatnonzero(a == _ESCAPE)
    if len(quotes) and (len(slashes) or escaped):
        # Runs of backslashes: a quote right behind one of odd length is escaped.
        first = np.flatnonzero(np.concatenate([[True], np.diff(slashes) > 1])) if len(slashes) else np.zeros(0, np.int64)
        begins, ends = slashes[first], np.append(slashes[first[1:] - 1], slashes[-1:]) + 1
        lengths = ends - begins + ((begins == 0) & escaped)
        behind = set(ends[lengths % 2 == 1].tolist()) | ({0} if escaped and not (len(begins) and begins[0] == 0) else set())
        quotes = quotes[~np.isin(quotes, list(behind))]
    places = np.flatnonzero(_MARK[a])
    return quotes, places, np.searchsorted(quotes, places)


class _Tokens(NamedTuple):
    """Brackets, commas and colons of the two upper levels: place, character, depth before and after."""

    place: list[int]
    char: list[int]
    before: list[int]
    after: list[int]
    inside: bool
    depth: int


def tokens(data: bytes, escaped: bool, inside: bool, depth: int) -> _Tokens:
    quotes, places, passed = marks(data, escaped)
    places = places[(passed + inside) % 2 == 0]
    chars = np.frombuffer(data, np.uint8)[places]
    after = depth + np.cumsum(_STEP[chars])
    before = after - _STEP[chars]
    bracket = _STEP[chars] != 0
    keep = np.where(bracket, np.minimum(before, after) <= 1, np.where(chars == ord(","), (before >= 1) & (before <= 2), before == 1))
    lists = [x[keep].tolist() for x in (places, chars, before, after)]
    return _Tokens(*lists, bool((len(quotes) + inside) % 2), int(after[-1]) if len(after) else depth)


def _key_before(file: _File, data: bytes, start: int, colon: int) -> str | None:
    """The string that ends before a colon at data[colon]; its beginning may lie before the data.

    Only as much is looked at as the string and what stands behind it are long.
    """
    low = max(0, colon - _NEAR)
    text, base = data[low:colon], start + low
    while True:
        body = text.rstrip(_BLANK)
        if body:
            if body[-1] != _QUOTE:
                return None
            at = len(body) - 1
            while (at := body.rfind(b'"', 0, at)) >= 0:
                slashes = at - len(body[:at].rstrip(b"\\"))
                if slashes % 2 == 0 and (slashes < at or base == 0):
                    own = body[at + 1 : -1]
                    if own.isascii() and _ESCAPE not in own and (plain := own.decode()).isprintable():
                        return plain
                    try:
                        return json.loads(body[at:])
                    except ValueError:
                        return None
        if base == 0:
            return None
        more = max(0, base - max(1024, len(text)))
        held = data[max(0, more - start) : base - start] if base > start else b""
        text, base = file.read(more, base - len(held)) + held + text, more


# --- first pass: quotes and brackets ---------------------------------------------------------------------------


def ranges(spark: SparkSession, paths: Sequence[str], size: int) -> DataFrame:
    """(file, length, start, stop) of the ranges of all documents, dealt out over tasks."""
    return _spread(_cut(list_tree(spark, list(paths), recursive=False), size), size)


def _cut(files: DataFrame, size: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("length", F.lit(1)) - 1, F.lit(size).cast("bigint")))
    parts = files.select(F.col("path").alias("file"), "length", starts.alias("start"))
    return parts.withColumn("stop", F.least(F.col("start") + size, "length"))


def _spread(parts: DataFrame, size: int) -> DataFrame:
    """Ranges over as many tasks as their number and size ask for, and none if there are none.

    The number of partitions is given, for rows as small as these would be put
    into one task otherwise.
    """
    known = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).first()
    at_once = -(-(known["bytes"] or 0) // size) + parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(max(1, min(known["n"], max(at_once, -(-known["n"] // FILES)))), "file", "start")


def _each_range(run, names: list[str], kinds: list[pa.DataType]):
    """mapInArrow function that calls run(file, row) -> rows for each range."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        name, file = None, None
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], _File(row["file"])
                # What many small ranges give is handed on together.
                for found in run(file, row):
                    rows.append(found)
                    held += len(found[-1]) if isinstance(found[-1], bytes) else 0
                    if held > HELD or len(rows) >= ROWS:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    return over


def _count(file: _File, row: dict):
    data = file.read(row["start"], row["stop"])
    quotes, places, passed = marks(data, file.escapes_before(row["start"]))
    steps = _STEP[np.frombuffer(data, np.uint8)[places]]
    yield row["file"], row["length"], row["start"], row["stop"], len(quotes) % 2, int(steps[passed % 2 == 0].sum()), int(steps[passed % 2 == 1].sum())


_RANGE = "file string, length bigint, start bigint, stop bigint"


def _in_order(fold):
    """applyInArrow function: the rows of a document's ranges in order, folded."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        return pa.Table.from_pylist(fold(rows), schema=fold.schema)

    return run


_LONG, _TEXT = pa.int64(), pa.string()


def _states(rows: list[dict]) -> list[dict]:
    inside = depth = 0
    out = []
    for r in rows:
        out.append({k: r[k] for k in ("file", "length", "start", "stop")} | {"inside": inside, "depth": depth})
        depth += r["delta_in"] if inside else r["delta_out"]
        inside ^= r["odd"]
    whole = inside == 0 and depth == 0
    return [r | {"whole": whole} for r in out]


_states.schema = pa.schema(
    [("file", _TEXT), ("length", _LONG), ("start", _LONG), ("stop", _LONG), ("inside", _LONG), ("depth", _LONG), ("whole", pa.bool_())]
)
_STATES = f"{_RANGE}, inside bigint, depth bigint, whole boolean"


_LOOKED = (*(f.name for f in _states.schema), "first", "trail", "key", "box", "ones", "twos", "fresh")


# --- second pass: what later ranges have to know ---------------------------------------------------------------


def _look(file: _File, row: dict):
    data = file.read(row["start"], row["stop"])
    found = tokens(data, file.escapes_before(row["start"]), bool(row["inside"]), row["depth"])
    first = trail = key = box = None
    ones = twos = 0
    fresh = False
    if row["depth"] == 0 and not row["inside"]:
        rest = data.lstrip(_BLANK)
        first = chr(rest[0]) if rest else None
    for place, char, before, after in zip(*found[:4]):
        if char == ord(","):
            ones += before == 1
            twos += before == 2
        elif char == ord(":"):
            key = place
        elif before == 1 and after == 2:
            box, twos, fresh = chr(char), 0, True
        elif after <= 0:
            trail = bool(data[place + 1 :].strip(_BLANK)) or after < 0
    if key is not None:
        key = _key_before(file, data, row["start"], key)
    yield row["file"], row["length"], row["start"], row["stop"], row["inside"], row["depth"], row["whole"], first, bool(trail), key, box, ones, twos, fresh


def _contexts(rows: list[dict]) -> list[dict]:
    top = key = box = None
    ones = twos = 0
    fault = not all(r["whole"] for r in rows)
    out = []
    for r in rows:
        fault = fault or r["trail"] or top is not None and r["first"] is not None
        out.append({k: r[k] for k in ("file", "length", "start", "stop", "inside", "depth")} | {"key": key, "box": box, "ones": ones, "twos": twos, "before": top})
        top = top or r["first"]
        key, box = r["key"] or key, r["box"] or box
        ones += r["ones"]
        twos = r["twos"] + (0 if r["fresh"] else twos)
    return [r | {"top": top or "", "fault": bool(fault) or top is None} for r in out]


_contexts.schema = pa.schema(
    [("file", _TEXT), ("length", _LONG), ("start", _LONG), ("stop", _LONG), ("inside", _LONG), ("depth", _LONG), ("key", _TEXT), ("box", _TEXT)]
    + [("ones", _LONG), ("twos", _LONG), ("before", _TEXT), ("top", _TEXT), ("fault", pa.bool_())]
)
_CONTEXTS = f"{_RANGE}, inside bigint, depth bigint, key string, box string, ones bigint, twos bigint, before string, top string, fault boolean"


# --- third pass: items -----------------------------------------------------------------------------------------


def _items(file: _File, row: dict):
    """(file, column, kind, place, text) of the items whose leading delimiter lies in the range.

    Kinds: record (of a list), map and list (cells of a column), scalar (an
    entry that is no container), box (a column begins), whole (a document that is
    no container), bad.
    """
    start, own = row["start"], row["stop"] - row["start"]
    data = file.read(start, row["stop"])
    name, top, key, box = row["file"], row["top"], row["key"], row["box"]
    ones, twos, at, pending = row["ones"], row["twos"], 0, None
    if top not in ("{", "["):
        if start == 0:
            yield name, None, "whole", 0, data if row["length"] <= own else b""
        return
    inside, depth, escaped = bool(row["inside"]), row["depth"], file.escapes_before(start)
    closes = {"{": ord("}"), "[": ord("]")}
    while True:
        found = tokens(data[at:], escaped, inside, depth)
        for place, char, before, after in zip(*found[:4]):
            place += at
            if place >= own and pending is None:
                return
            sep, opens = char == ord(","), after > before
            level = 1 if top == "[" else min(2, before if not opens else after)
            if char == ord(":"):
                if place < own or pending is not None:
                    key = _key_before(file, data, start, place)
                continue
            if opens and after == 2 and top == "[" or before == 2 and top == "[":
                # Inside a record.
                continue
            if not opens and not sep:
                if char != closes.get(top if before == 1 else box, char):
                    yield name, None, "bad", 0, b""
            if opens and after == 2:
                if pending is not None:
                    # The entry is a column; its cells have delimiters of their own.
                    pending = None
                    if _of(data, place) != ord(":"):
                        yield name, None, "bad", 0, b""
                    yield name, key, "box", 0, bytes([char])
                if place >= own:
                    return
                box, twos, pending = chr(char), 0, (place, 2, "open")
                continue
            if opens:
                pending = (place, 1, "open")
                continue
            # A comma or a closing bracket ends what is pending at its level.
            if pending is not None and pending[1] == level:
                begin, _, behind = pending
                text = data[begin + 1 : place]
                kind = "record" if top == "[" else "scalar" if level == 1 else "map" if box == "{" else "list"
                if behind == "column":
                    if text.strip(_BLANK):
                        yield name, None, "bad", 0, b""
                elif text.strip(_BLANK):
                    yield name, None if level == 1 else key, kind, ones if level == 1 else twos, text
                elif behind == "comma" or sep:
                    yield name, None, "bad", 0, b""
            pending = None
            ones += sep and level == 1
            twos += sep and level == 2
            if place >= own:
                return
            if sep or before == 2:
                # Behind a column only blanks may stand before the next delimiter.
                pending = (place, level, "comma") if sep else (place, 1, "column")
        if pending is None and at + len(data[at:]) >= own or start + len(data) >= row["length"]:
            return
        inside, depth, at = found.inside, found.depth, len(data)
        data += file.read(start + len(data), min(row["length"], start + len(data) + max(_MORE, len(data) // 2)))
        tail = data[:at]
        escaped = (len(tail) - len(tail.rstrip(b"\\"))) % 2 == 1


def _of(data: bytes, place: int) -> int:
    """The last byte before a place that is not blank."""
    while place > 0:
        low = max(0, place - _NEAR)
        before = data[low:place].rstrip(_BLANK)
        if before:
            return before[-1]
        place = low
    return ord(":")


ITEMS = "file string, column string, kind string, place bigint, text binary"


class _Held(_File):
    """A file whose bytes have been read."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def read(self, start: int, stop: int) -> bytes:
        return self.data[start:stop]


_COUNTED = ("file", "length", "start", "stop", "odd", "delta_out", "delta_in")


def _at_once(file: _File, row: dict):
    """All passes over a document of one range: its items, and a row of kind document with `top` and whether there is a fault."""
    held = _Held(file.read(0, row["length"]))
    (state,) = _states([dict(zip(_COUNTED, next(_count(held, row))))])
    top, trail = _ends(held.data)
    fault = not state["whole"] or trail or not top
    if not fault:
        # Nothing stands before the range, so there is nothing to know of what does.
        yield from _items(held, state | {"top": top, "key": None, "box": None, "ones": 0, "twos": 0})
    yield row["file"], top, "document", int(fault), None


def _ends(data: bytes) -> tuple[str, bool]:
    """The first character that is not blank, and whether anything follows the document's last bracket."""
    rest = data.lstrip(_BLANK)
    found = tokens(data, False, False, 0)
    after = np.array(found.after, np.int64)
    closing = np.flatnonzero((after <= 0) & np.isin(found.char, list(b"]}")))
    if not len(closing):
        return chr(rest[0]) if rest else "", False
    return chr(rest[0]), bool(data[found.place[closing[-1]] + 1 :].strip(_BLANK)) or bool(after[closing[-1]] < 0)


def read_items(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(items, documents): file, column, kind, place, text; and file, top, fault per document.

    `text` is an entry ("key": value) for scalar and map items, a value for the
    others; `place` numbers the elements of lists from 0.  `fault` says that the
    document's brackets or strings don't end, or that something follows it; text
    inside an item is judged by whoever parses it.  Both are stored.
    """
    files = list_tree(spark, paths, recursive=False)
    names, kinds = ["file", "column", "kind", "place", "text"], [_TEXT, _TEXT, _TEXT, _LONG, pa.binary()]
    # Documents of one range are read once, by one task; most folders hold no others.
    at_once = materialise(map_arrow(_spread(_cut(files.where(F.col("length") <= range_bytes), range_bytes), range_bytes), _each_range(_at_once, names, kinds), ITEMS))
    is_doc = F.col("kind") == "document"
    found, docs = at_once.where(~is_doc), at_once.where(is_doc).select("file", F.col("column").alias("top"), (F.col("place") == 1).alias("fault"))
    large = files.where(F.col("length") > range_bytes)
    if large.isEmpty():
        return found, docs
    more, others = _in_passes(_spread(materialise(_cut(large, range_bytes)), range_bytes))
    return found.unionByName(more), docs.unionByName(others)


def _in_passes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_items for documents of many ranges."""
    at_once = parts.rdd.getNumPartitions()
    counted = map_arrow(
        parts,
        _each_range(_count, list(_COUNTED), [_TEXT] + [_LONG] * 6),
        f"{_RANGE}, odd bigint, delta_out bigint, delta_in bigint",
    )
    states = materialise(counted.groupBy("file").applyInArrow(_in_order(_states), _STATES))
    kinds = [f.type for f in _states.schema] + [_TEXT, pa.bool_(), _TEXT, _TEXT, _LONG, _LONG, pa.bool_()]
    schema = f"{_STATES}, first string, trail boolean, key string, box string, ones bigint, twos bigint, fresh boolean"
    looked = map_arrow(states.repartition(at_once, "file", "start"), _each_range(_look, list(_LOOKED), kinds), schema)
    contexts = materialise(looked.groupBy("file").applyInArrow(_in_order(_contexts), _CONTEXTS))
    # Stored, for callers judge all items of a document before they use any.
    found = map_arrow(
        contexts.where("NOT fault").repartition(at_once, "file", "start"),
        _each_range(_items, ["file", "column", "kind", "place", "text"], [_TEXT, _TEXT, _TEXT, _LONG, pa.binary()]),
        ITEMS,
    )
    return materialise(found), contexts.where("start = 0").select("file", "top", "fault")
