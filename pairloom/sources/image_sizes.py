"""Sizes of images from their files' headers: JPEG, PNG and the three forms of WebP.

Only headers are read: a few bytes of a PNG or WebP, the segments before the
frame of a JPEG, whose contents are skipped.  A file that is cut off, or is no
image, has a reason instead of a size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.operators.latents import expected_spatial
from pairloom.session import map_arrow
from pairloom.sources.file_lists import list_tree, located

# Fixed values of the formats.
PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8"
RIFF, WEBP = b"RIFF", b"WEBP"
# Markers of JPEG frames: all from C0 to CF but the tables C4 and CC and the reserved C8.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
# Markers without a length: TEM and RST0 to RST7.
BARE = frozenset({0x01, *range(0xD0, 0xD8)})
SCAN, FINISH = 0xDA, 0xD9
# Files that one task looks into.
FILES = 2048

Read = Callable[[int, int], bytes]
Size = tuple[str | None, int | None, int | None, str | None]


def _jpeg(read: Read) -> Size:
    at = len(JPEG)
    while True:
        head = read(at, 4)
        if len(head) < 2:
            return "jpeg", None, None, "cut"
        if head[0] != 0xFF:
            return "jpeg", None, None, "broken"
        marker = head[1]
        if marker == 0xFF:
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in (SCAN, FINISH):
            return "jpeg", None, None, "no_frame"
        elif len(head) < 4:
            return "jpeg", None, None, "cut"
        else:
            length = int.from_bytes(head[2:], "big")
            if length < 2:
                return "jpeg", None, None, "broken"
            if marker not in FRAMES:
                at += 2 + length
                continue
            frame = read(at + 4, 5)
            if len(frame) < 5:
                return "jpeg", None, None, "cut"
            height, width = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big")
            return ("jpeg", width, height, None) if width and height else ("jpeg", None, None, "no_size")


def _png(read: Read) -> Size:
    head = read(8, 16)
    if len(head) < 16:
        return "png", None, None, "cut"
    width, height = int.from_bytes(head[8:12], "big"), int.from_bytes(head[12:], "big")
    if head[4:8] != b"IHDR":
        return "png", None, None, "broken"
    return ("png", width, height, None) if width and height else ("png", None, None, "no_size")


def _webp(read: Read) -> Size:
    head = read(12, 18)
    kind, body = head[:4], head[8:]
    needed = {b"VP8 ": 10, b"VP8L": 5, b"VP8X": 10}.get(kind)
    if needed is None:
        return "webp", None, None, "cut" if len(head) < 4 else "broken"
    if len(body) < needed:
        return "webp", None, None, "cut"
    little = lambda a, b: int.from_bytes(body[a:b], "little")
    if kind == b"VP8X":
        return "webp", little(4, 7) + 1, little(7, 10) + 1, None
    if kind == b"VP8L":
        bits = little(1, 5)
        return ("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, None) if body[0] == 0x2F else ("webp", None, None, "broken")
    width, height = little(6, 8) & 0x3FFF, little(8, 10) & 0x3FFF
    if body[3:6] != b"\x9d\x01\x2a":
        return "webp", None, None, "broken"
    return ("webp", width, height, None) if width and height else ("webp", None, None, "no_size")


def size_of(read: Read) -> Size:
    """(format, width, height, reason) from read(start, count); reason is null where there is a size.

    Reasons: format (none of the three), cut, broken, no_frame, no_size.
    """
    head = read(0, 12)
    if head.startswith(JPEG):
        return _jpeg(read)
    if head.startswith(PNG):
        return _png(read)
    if head[:4] == RIFF and head[8:] == WEBP:
        return _webp(read)
    whole = head and (PNG.startswith(head) or JPEG.startswith(head) or len(head) < 12 and RIFF.startswith(head[:4]) and WEBP.startswith(head[8:]))
    return None, None, None, "cut" if whole else "format"


def image_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, format, width, height, reason) of all files below a folder; empty ones are left out."""
    files = list_tree(spark, path, glob).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                system, place = located(uri)
                with system.open_input_file(place) as file:
                    found.append(size_of(lambda start, count: file.read_at(count, start) if start < file.size() else b""))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found) if found else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", "format", "width", "height", "reason"])

    # The number is given: a list of files is small, but not the work on it.
    tasks = max(1, -(-files.count() // FILES))
    return map_arrow(files.repartition(tasks, "path"), run, "path string, format string, width bigint, height bigint, reason string")


def expected_latents(sizes: DataFrame, multiple: float) -> DataFrame:
    """sizes with latent_height and latent_width, null without a size."""
    size = expected_spatial(F.col("height"), F.col("width"), multiple)
    return sizes.withColumns({"latent_height": size["h"], "latent_width": size["w"]})
