"""Tensors in zip containers (data.pkl beside data/<key>), read and written without running what a file names.

The description in data.pkl is followed opcode by opcode: what is on no list
below (an opcode, a name, a storage type) makes a reason of the file, and
nothing is imported or called.  Of the data only the bytes a tensor spans are
read, so a task holds one tensor at a time; files are dealt out by their sizes.
"""

from __future__ import annotations

import io
import json
import math
import pickletools
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pairloom.session import map_arrow
from pairloom.sources.file_lists import list_tree, located

# Fixed values of the format: storage types, and the width of their items in numpy's terms (bfloat16 is the upper half of a float).
STORAGES = {
    "FloatStorage": "f4",
    "HalfStorage": "f2",
    "BFloat16Storage": "bf",
    "DoubleStorage": "f8",
    "LongStorage": "i8",
    "IntStorage": "i4",
    "ShortStorage": "i2",
    "CharStorage": "i1",
    "ByteStorage": "u1",
    "BoolStorage": "b1",
}
NAMES = {
    "f4": "float32", "f2": "float16", "bf": "bfloat16", "f8": "float64", "i8": "int64",
    "i4": "int32", "i2": "int16", "i1": "int8", "u1": "uint8", "b1": "bool",
}
TENSOR, MAPPING = ("torch._utils", "_rebuild_tensor_v2"), ("collections", "OrderedDict")
# Names a bundle keeps its tensor under, the first one present counts.
BUNDLE_KEYS = ("latent", "image_embeds", "tensor")
# A row holds at most this many values (Spark's rows end at 2 GB).
LARGEST = 1 << 28
# Numpy's limit.
DIMENSIONS = 64
# A task gets about this many files or bytes, whichever is reached first.
FILES, BYTES = 2048, 256 << 20

# What a container that is no whole one makes the zip reader raise.
BROKEN = (zipfile.BadZipFile, EOFError, NotImplementedError, ValueError, OverflowError, struct.error)

SCHEMA = "path string, key string, dtype string, shape array<bigint>, vals array<{}>, meta string, reason string"


class Refused(ValueError):
    """Why a file or a tensor is not read."""


@dataclass(frozen=True)
class _Name:
    module: str
    name: str


@dataclass(frozen=True)
class _Storage:
    kind: str
    key: str
    count: int


@dataclass(frozen=True, eq=False)
class _Tensor:
    storage: _Storage
    offset: int
    shape: tuple[int, ...]
    stride: tuple[int, ...]

    @property
    def size(self) -> int:
        return math.prod(self.shape)


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def _storage(given: object) -> _Storage:
    if not (isinstance(given, tuple) and len(given) == 5 and given[0] == "storage" and isinstance(given[1], _Name)):
        raise Refused("broken")
    _, kind, key, _, count = given
    if kind.module != "torch" or kind.name not in STORAGES:
        raise Refused(f"storage_type {kind.module}.{kind.name}")
    if not isinstance(key, str) or not _whole(count):
        raise Refused("broken")
    return _Storage(STORAGES[kind.name], key, count)


def _called(what: object, given: object) -> object:
    """The two calls a description may hold, made of plain values; any other name is a reason."""
    if not isinstance(what, _Name) or not isinstance(given, tuple):
        raise Refused("broken")
    named = (what.module, what.name)
    if named == MAPPING and not given:
        return {}
    if named != TENSOR:
        raise Refused(f"name {what.module}.{what.name}")
    if len(given) < 4 or not isinstance(given[0], _Storage):
        raise Refused("broken")
    storage, offset, shape, stride = given[:4]
    for sizes in (shape, stride):
        if not isinstance(sizes, tuple) or not all(map(_whole, sizes)):
            raise Refused("strides")
    if not _whole(offset) or len(shape) != len(stride) or len(shape) > DIMENSIONS:
        raise Refused("strides")
    return _Tensor(storage, offset, shape, stride)


def described(data: bytes) -> object:
    """The value a data.pkl stands for: plain values, lists, tuples, dicts, and tensors not yet read."""
    stack: list = []
    marks: list[int] = []
    memo: dict[int, object] = {}

    def since_mark() -> list:
        at = marks.pop()
        taken = stack[at:]
        del stack[at:]
        return taken

    def pairs(flat: list) -> None:
        if len(flat) % 2 or not isinstance(stack[-1], dict):
            raise Refused("broken")
        for key, value in zip(flat[::2], flat[1::2]):
            if not isinstance(key, str | int | float | bool | None):
                raise Refused("key")
            stack[-1][key] = value

    def entries(values: list) -> None:
        if not isinstance(stack[-1], list):
            raise Refused("broken")
        stack[-1].extend(values)

    try:
        for op, arg, _ in pickletools.genops(data):
            name = op.name
            if name in ("PROTO", "FRAME"):
                pass
            elif name == "STOP":
                return stack.pop()
            elif name in ("BININT", "BININT1", "BININT2", "LONG1", "BINFLOAT", "BINUNICODE", "SHORT_BINUNICODE"):
                stack.append(arg)
            elif name in ("NONE", "NEWTRUE", "NEWFALSE"):
                stack.append({"NONE": None, "NEWTRUE": True, "NEWFALSE": False}[name])
            elif name in ("EMPTY_DICT", "EMPTY_LIST", "EMPTY_TUPLE"):
                stack.append({"EMPTY_DICT": dict, "EMPTY_LIST": list, "EMPTY_TUPLE": tuple}[name]())
            elif name == "MARK":
                marks.append(len(stack))
            elif name == "TUPLE":
                stack.append(tuple(since_mark()))
            elif name in ("TUPLE1", "TUPLE2", "TUPLE3"):
                n = int(name[-1])
                if len(stack) < n:
                    raise Refused("broken")
                stack[-n:] = [tuple(stack[-n:])]
            elif name in ("BINPUT", "LONG_BINPUT"):
                memo[arg] = stack[-1]
            elif name == "MEMOIZE":
                memo[len(memo)] = stack[-1]
            elif name in ("BINGET", "LONG_BINGET"):
                stack.append(memo[arg])
            elif name == "GLOBAL":
                stack.append(_Name(*arg.split(" ", 1)))
            elif name == "STACK_GLOBAL":
                stack[-2:] = [_Name(str(stack[-2]), str(stack[-1]))]
            elif name == "BINPERSID":
                stack.append(_storage(stack.pop()))
            elif name == "REDUCE":
                given = stack.pop()
                stack.append(_called(stack.pop(), given))
            elif name in ("SETITEM", "APPEND"):
                n = 2 if name == "SETITEM" else 1
                taken = stack[-n:]
                del stack[-n:]
                (pairs if n == 2 else entries)(taken)
            elif name in ("SETITEMS", "APPENDS"):
                taken = since_mark()
                (pairs if name == "SETITEMS" else entries)(taken)
            else:
                raise Refused(f"opcode {name}")
    except Refused:
        raise
    except (ValueError, IndexError, KeyError, TypeError, struct.error) as error:
        raise Refused("broken") from error
    raise Refused("broken")


class _Ranged(io.RawIOBase):
    """A file read at places; beyond its end there is nothing, so that only real failures of the store are OSErrors."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.at, self.size = file, 0, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, self.size)[whence]
        if at < 0:
            raise ValueError("before the start")
        self.at = at
        return at

    def tell(self) -> int:
        return self.at

    def read(self, size: int = -1) -> bytes:
        left = max(0, self.size - self.at)
        count = left if size is None or size < 0 else min(size, left)
        data = self.file.read_at(count, self.at) if count else b""
        self.at += len(data)
        return data


class Container:
    """One file: its description, and the values of its tensors when asked for."""

    def __init__(self, file: pa.NativeFile) -> None:
        try:
            self.zip = zipfile.ZipFile(_Ranged(file))
            # Only stored members: nothing can grow beyond the file's own size.
            if any(i.compress_type != zipfile.ZIP_STORED or i.flag_bits & 1 for i in self.zip.infolist()):
                raise Refused("compressed")
            # The first folder's name is free.
            found = [n for n in self.zip.namelist() if n == "data.pkl" or n.count("/") == 1 and n.endswith("/data.pkl")]
            if len(found) != 1:
                raise Refused("no_description")
            self.root = found[0].removesuffix("data.pkl")
            order = f"{self.root}byteorder"
            self.order = ">" if order in self.zip.namelist() and self.zip.read(order).strip() == b"big" else "<"
            description = self.zip.read(found[0])
        except Refused:
            raise
        except BROKEN as error:
            raise Refused("broken") from error
        # A member may be reached more than once, but not more often than the description is long.
        self.value, self.steps = described(description), 16 + 16 * len(description)

    def values(self, tensor: _Tensor) -> np.ndarray:
        """The tensor's values in row order, whatever its strides."""
        storage, width = tensor.storage, 2 if tensor.storage.kind == "bf" else int(tensor.storage.kind[1])
        if tensor.size > LARGEST:
            raise Refused("too_large")
        reach = 1 + sum((n - 1) * s for n, s in zip(tensor.shape, tensor.stride)) if tensor.size else 0
        if tensor.offset + reach > storage.count:
            raise Refused("bounds")
        # Gaps between values are read too, so what is read has the bound of what is returned times the storage's own.
        if reach > LARGEST:
            raise Refused("too_large")
        try:
            with self.zip.open(f"{self.root}data/{storage.key}") as member:
                member.seek(tensor.offset * width)
                data = member.read(reach * width)
        except KeyError as error:
            raise Refused("no_storage") from error
        except BROKEN as error:
            raise Refused("broken") from error
        if len(data) < reach * width:
            raise Refused("cut")
        if storage.kind == "bf":
            flat = (np.frombuffer(data, f"{self.order}u2").astype(np.uint32) << 16).view(np.float32)
        else:
            flat = np.frombuffer(data, f"{self.order if width > 1 else '|'}{storage.kind}")
        if not tensor.size:
            return flat[:0]
        strides = [s * flat.itemsize if n > 1 else 0 for n, s in zip(tensor.shape, tensor.stride)]
        return np.lib.stride_tricks.as_strided(flat, tensor.shape, strides, writeable=False).reshape(-1)

    def plain(self, value: object, at: tuple = (), found: list | None = None, inside: frozenset = frozenset()) -> object:
        """The value without its tensors, which are added to `found` with their keys; those of one entry become numbers."""
        self.steps -= 1
        if self.steps < 0 or len(at) > 64 or id(value) in inside:
            raise Refused("nested")
        if isinstance(value, _Tensor):
            if found is not None:
                found.append(("/".join(map(str, at)), value))
            try:
                return self.values(value).tolist()[0] if value.size == 1 else None
            except Refused:
                return None
        if isinstance(value, dict | list | tuple):
            below = inside | {id(value)}
            if isinstance(value, dict):
                # A number's key is its text; it never takes the place of a text's.
                return {str(k): self.plain(v, (*at, k), found, below) for k, v in value.items() if isinstance(k, str) or str(k) not in value}
            return [self.plain(v, (*at, i), found, below) for i, v in enumerate(value)]
        if isinstance(value, _Name | _Storage):
            raise Refused("broken")
        return value


def _shown(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def tensors_of(file: pa.NativeFile, kind: str = "float", bundle: Sequence[str] | None = None) -> Iterator[tuple]:
    """(key, dtype, shape, vals, meta, reason) for each tensor of an open file; see tensor_files."""
    try:
        held = Container(file)
        found: list[tuple[str, _Tensor]] = []
        rest = held.plain(held.value, (), found)
        meta = json.dumps(rest)
        if bundle is not None and not isinstance(held.value, _Tensor):
            named = [k for k in bundle if k in held.value] if isinstance(held.value, dict) else []
            if named and not isinstance(held.value[named[0]], _Tensor):
                raise Refused("not_a_tensor")
            found = [(k, held.value[k]) for k in named[:1]]
        if not found:
            raise Refused("no_tensor")
    except Refused as why:
        yield None, None, None, None, None, _shown(str(why))
        return
    target = {"float": np.float32, "double": np.float64}[kind]
    for key, tensor in found:
        dtype, shape = NAMES[tensor.storage.kind], list(tensor.shape)
        try:
            if tensor.storage.kind != "bf" and not np.can_cast(np.dtype(tensor.storage.kind), target):
                raise Refused(f"storage_type {dtype}")
            yield _shown(key), dtype, shape, held.values(tensor).astype(target), meta, None
        except Refused as why:
            yield _shown(key), dtype, shape, None, meta, str(why)


def tensor_files(spark: SparkSession, path: str, glob: str = "*.pt", kind: str = "float", bundle: Sequence[str] | None = None) -> DataFrame:
    """(path, key, dtype, shape, vals, meta, reason): a row per tensor of all files below a folder.

    key is the way to the tensor through dicts and lists, joined by slashes, and
    empty where the file is a tensor itself; meta is the rest of the file as JSON,
    with tensors of one entry as numbers.  With `bundle` only the tensor under the
    first of these names is read.  vals are floats or doubles (`kind`); integers
    and doubles that it can't hold are refused, 64-bit integers round in doubles.
    A file that can't be read is one row with a null key and a reason: broken,
    compressed, no_description, no_tensor, not_a_tensor, nested, key, opcode ...,
    name ..., storage_type ...; a tensor's own reasons are strides, bounds, cut,
    no_storage, too_large (over 2^28 values) and storage_type.  Empty files
    are left out.
    """
    files = list_tree(spark, path, glob)
    schema = SCHEMA.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.float32() if kind == "float" else pa.float64()
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(item), pa.string(), pa.string()]
        names = ["path", "key", "dtype", "shape", "vals", "meta", "reason"]
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, place = located(uri)
                with system.open_input_file(place) as file:
                    for row in tensors_of(file, kind, bundle):
                        rows.append((uri, *row))
                        held += 256 + (0 if row[3] is None else row[3].nbytes)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    facts = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-facts[0] // FILES), -(-facts[1] // BYTES))
    return map_arrow(files.repartition(tasks, "path").select("path"), run, schema)


def container_latents(tensors: DataFrame, fields: str) -> DataFrame:
    """Latent rows for the manifest from readable rows of tensor_files: the fields of meta, vals, shape, dtype, latent_path.

    `fields` is the schema of the plain values to take, e.g. "uid string, scaled string".
    """
    taken = F.from_json(F.coalesce("meta", F.lit("{}")), fields)
    rows = tensors.where("reason IS NULL").select(F.col("path").alias("latent_path"), "vals", "shape", "dtype", taken.alias("m"))
    return rows.select("latent_path", "vals", "shape", "dtype", "m.*")


# --- writing ------------------------------------------------------------------------------------------


def _text(value: str) -> bytes:
    raw = value.encode("utf-8", "surrogatepass")
    return b"X" + struct.pack("<I", len(raw)) + raw


def _number(value: int) -> bytes:
    if -(1 << 31) <= value < 1 << 31:
        return b"J" + struct.pack("<i", value)
    raw = value.to_bytes(value.bit_length() // 8 + 1, "little", signed=True)
    return b"\x8a" + bytes([len(raw)]) + raw


def _plain(value: object) -> bytes:
    """The opcodes of a plain value."""
    if value is None or isinstance(value, bool):
        return {None: b"N", True: b"\x88", False: b"\x89"}[value]
    if isinstance(value, int):
        return _number(value)
    if isinstance(value, float):
        return b"G" + struct.pack(">d", value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, Tensor):
        return value.opcodes()
    if isinstance(value, Mapping):
        return b"}(" + b"".join(_plain(k) + _plain(v) for k, v in value.items()) + b"u"
    if isinstance(value, tuple):
        return b"(" + b"".join(map(_plain, value)) + b"t"
    if isinstance(value, list):
        return b"](" + b"".join(map(_plain, value)) + b"e"
    raise TypeError(f"no form for {type(value).__name__}")


@dataclass(frozen=True)
class Tensor:
    """A tensor to write: a view of the storage `key`, row by row unless a stride is given."""

    key: str
    storage_type: str
    count: int
    shape: tuple[int, ...]
    stride: tuple[int, ...] | None = None
    offset: int = 0

    def opcodes(self) -> bytes:
        stride = self.stride
        if stride is None:
            stride = tuple(math.prod(self.shape[i + 1 :]) for i in range(len(self.shape)))
        name = lambda module, of: b"c" + f"{module}\n{of}\n".encode()
        storage = b"(" + _text("storage") + name("torch", self.storage_type) + _text(self.key) + _text("cpu") + _number(self.count) + b"tQ"
        given = storage + _number(self.offset) + _plain(self.shape) + _plain(stride) + b"\x89" + name(*MAPPING) + b")R"
        return name(*TENSOR) + b"(" + given + b"tR"


def container(value: object, storages: Mapping[str, bytes]) -> bytes:
    """The bytes of a file that holds the value (plain values and Tensors) and the storages' little-endian items."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as target:
        members = {"data.pkl": b"\x80\x02" + _plain(value) + b".", "byteorder": b"little", "version": b"3\n"}
        for name, data in (members | {f"data/{k}": v for k, v in storages.items()}).items():
            target.writestr(zipfile.ZipInfo(f"archive/{name}"), data)
    return out.getvalue()


def items(values: np.ndarray, storage_type: str) -> bytes:
    """Little-endian items of a storage; bfloat16 rounds to even, and what is too large becomes infinite."""
    if STORAGES[storage_type] != "bf":
        with np.errstate(over="ignore"):
            return np.ascontiguousarray(values).astype(f"<{STORAGES[storage_type]}").tobytes()
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32).astype(np.uint64)
    near = (bits + 0x7FFF + (bits >> 16 & 1)) >> 16
    return np.where(np.isnan(values), 0x7FC0, near).astype("<u2").tobytes()


def with_containers(df: DataFrame, fields: Sequence[str] = (), vals: str = "vals", shape: str = "shape", storage_type: str | Column = "FloatStorage") -> DataFrame:
    """df with `payload`, a file of each row's tensor under "latent" beside the named fields, for write_payloads.

    Null vals give a null payload; null entries become NaN; vals that don't fill their shape fail.
    """
    given = df.withColumn("__v", F.col(vals).cast("array<double>")).withColumn("__s", F.col(shape).cast("array<bigint>"))
    given = given.withColumn("__t", F.lit(storage_type))
    given = given.withColumn("__m", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                values = row.column("__v")[0]
                data = None
                if values.is_valid:
                    numbers = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    sizes = tuple(row.column("__s")[0].as_py())
                    if math.prod(sizes) != len(numbers):
                        raise ValueError(f"{len(numbers)} values don't fill the shape {sizes}")
                    made = json.loads(row.column("__m")[0].as_py())
                    kind = row.column("__t")[0].as_py()
                    made["latent"] = Tensor("0", kind, len(numbers), sizes)
                    data = container(made, {"0": items(numbers, kind)})
                kept = [c for c in range(row.num_columns) if row.schema.names[c] not in ("__v", "__s", "__m", "__t")]
                columns = [row.column(c) for c in kept] + [pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[row.schema.names[c] for c in kept] + ["payload"])

    schema = T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType())])
    return map_arrow(given, run, schema)
