"""Tensor containers: what is read, what is refused, and that nothing in a file runs."""

import io
import json
import math
import os
import pickle
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import latents as L
from pairloom.sources import payload_files as PF, tensor_files as TF
from pairloom.sources.tensor_files import Tensor


def read(data, **options):
    return list(TF.tensors_of(pa.BufferReader(data), **options))


def zipped(description, members=(), method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as target:
        for name, data in {"x/data.pkl": description, **dict(members)}.items():
            target.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("kind", list(TF.STORAGES))
def test_every_storage_type_is_exact_in_doubles(kind):
    values = np.array([0, 1, 0, 1] if kind in ("BoolStorage",) else [0, 1, 100, 5] if kind == "ByteStorage" else [0, -1, 100, -5], float)
    ((key, dtype, shape, got, meta, reason),) = read(TF.container(Tensor("0", kind, 4, (2, 2)), {"0": TF.items(values, kind)}), kind="double")
    assert (key, dtype, shape, reason) == ("", TF.NAMES[TF.STORAGES[kind]], [2, 2], None) and got.tolist() == values.tolist()
    ((*_, single, _, reason),) = read(TF.container(Tensor("0", kind, 4, (2, 2)), {"0": TF.items(values, kind)}))
    wide = kind in ("DoubleStorage", "LongStorage", "IntStorage")
    assert (single is None and reason == f"storage_type {dtype}") if wide else single.tolist() == values.tolist()


def test_special_values_and_rounding_of_short_floats():
    values = np.array([np.nan, np.inf, -np.inf, -0.0, 1 + 2**-8, 1 + 3 * 2**-8, 3.4e38])
    for kind in ("FloatStorage", "HalfStorage", "BFloat16Storage"):
        ((*_, got, _, _),) = read(TF.container(Tensor("0", kind, 7, (7,)), {"0": TF.items(values, kind)}))
        assert math.isnan(got[0]) and got[1] == np.inf and got[2] == -np.inf and math.copysign(1, got[3]) == -1
        if kind == "BFloat16Storage":
            # Halves round to even.
            assert got[4] == 1.0 and got[5] == 1 + 2**-6


def test_views_share_a_storage_and_follow_their_strides():
    base = np.arange(24.0)
    views = {
        "whole": Tensor("s", "FloatStorage", 24, (2, 3, 4)),
        "turned": Tensor("s", "FloatStorage", 24, (4, 3, 2), (1, 4, 12)),
        "column": Tensor("s", "FloatStorage", 24, (6,), (4,), 3),
        "spread": Tensor("s", "FloatStorage", 24, (3, 2), (0, 1), 22),
        "none": Tensor("s", "FloatStorage", 24, (0, 5)),
        "last": Tensor("s", "FloatStorage", 24, (), None, 23),
    }
    data = TF.container({"deep": [views], "uid": "é", "n": 1 << 40, "x": 0.5, "no": None, "yes": True}, {"s": TF.items(base, "FloatStorage")})
    got = {key: (shape, values.tolist()) for key, _, shape, values, _, reason in read(data) if reason is None}
    cube = base.reshape(2, 3, 4)
    want = {"whole": cube, "turned": cube.transpose(2, 1, 0), "column": base[3::4], "spread": np.array([[22, 23]] * 3), "none": np.zeros((0, 5)), "last": np.array(23.0)}
    assert got == {f"deep/0/{k}": (list(v.shape), v.reshape(-1).tolist()) for k, v in want.items()}
    meta = json.loads(read(data)[0][4])
    assert meta.pop("deep")[0] == {k: 23.0 if k == "last" else None for k in views}
    assert meta == {"uid": "é", "n": 1 << 40, "x": 0.5, "no": None, "yes": True}


class _Runs:
    def __init__(self, path):
        self.path = path

    def __reduce__(self):
        return os.mkdir, (self.path,)


def test_hostile_files_have_a_reason_and_run_nothing(tmp_path):
    path = str(tmp_path / "made")
    for protocol in (2, 3, 4, 5):
        ((key, *_, reason),) = read(zipped(pickle.dumps({"latent": _Runs(path)}, protocol)))
        assert key is None and reason.startswith(("name ", "opcode ")), reason
    assert not os.path.exists(path)
    reason = lambda data, **o: read(data, **o)[0][5]
    assert reason(b"") == reason(b"PK") == reason(b"text" * 99) == "broken"
    assert reason(zipped(b"}.", method=zipfile.ZIP_DEFLATED)) == "compressed"
    assert reason(zipped(b"}.", {"y/data.pkl": b"}."})) == "no_description" and reason(zipped(b"}.")) == "no_tensor"
    # Lists that hold each other ten at a time, and one that holds itself.
    bomb: list = []
    for _ in range(30):
        bomb = [bomb] * 10
    loop: list = []
    loop.append(loop)
    assert reason(zipped(pickle.dumps(bomb, 2))) == reason(zipped(pickle.dumps(loop, 2))) == "nested"
    assert reason(zipped(pickle.dumps({(1, 2): 3}, 2))) == "key" and reason(zipped(b"\x80\x02u.")) == "broken"
    assert reason(zipped(b"\x80\x02cos\nsystem\n.")) == "broken"
    lone = zipped(b"\x80\x02c\xed\xa0\x80a\nb\n)R.")
    assert reason(lone) is not None and pa.array([reason(lone)])
    held = lambda t, data=b"\0" * 40: reason(TF.container({"latent": t}, {"0": data}))
    assert held(Tensor("0", "FloatStorage", 10, (10,))) is None
    assert held(Tensor("0", "FloatStorage", 10, (11,))) == held(Tensor("0", "FloatStorage", 10, (2,), (9,), 1)) == "bounds"
    assert held(Tensor("0", "FloatStorage", 10, (2,), (-1,), 9)) == held(Tensor("0", "FloatStorage", 10, (2, 2), (1,))) == "strides"
    assert held(Tensor("0", "FloatStorage", 99, (11,))) == "cut" and held(Tensor("1", "FloatStorage", 10, (10,))) == "no_storage"
    assert held(Tensor("0", "FloatStorage", 10, (1 << 40,), (0,))) == "too_large" and held(Tensor("0", "FloatStorage", 10, (1,) * 65)) == "strides"
    assert held(Tensor("0", "QInt8Storage", 10, (10,))) == "storage_type torch.QInt8Storage"


def test_damaged_files_never_stop_a_task():
    whole = TF.container({"latent": Tensor("0", "HalfStorage", 50, (5, 10)), "uid": "a", "stats": {"min": 0.5}}, {"0": TF.items(np.arange(50.0), "HalfStorage")})
    draw = random.Random(3)
    for turn in range(3000):
        data = bytearray(whole)
        for _ in range(draw.randint(1, 4)):
            data[draw.randrange(len(data))] = draw.randrange(256)
        data = bytes(data[: draw.randint(0, len(data))] if turn % 4 == 0 else data)
        for row in TF.tensors_of(pa.BufferReader(data), bundle=TF.BUNDLE_KEYS):
            assert (row[3] is None) == (row[5] is not None)
            pa.array([row[0], row[4], row[5]], pa.string())


def test_bundles_take_the_first_name_present():
    t = Tensor("0", "FloatStorage", 2, (2,))
    store = {"0": TF.items(np.array([1.0, 2.0]), "FloatStorage")}
    picked = lambda value: [(r[0], r[5]) for r in read(TF.container(value, store), bundle=TF.BUNDLE_KEYS)]
    assert picked({"other": t, "tensor": t, "latent": t}) == [("latent", None)] and picked(t) == [("", None)]
    assert picked({"other": t}) == [(None, "no_tensor")] and picked({"latent": 5, "tensor": t}) == [(None, "not_a_tensor")] and picked([t]) == [(None, "no_tensor")]


def test_folder_of_containers_becomes_a_manifest(spark, tmp_path, rows):
    path = str(tmp_path / "pt")
    given = spark.createDataFrame(
        [("a", [1.0, 2.0], [2, 1], True, None), ("b", [3.0, None], [2], False, 5), ("c", None, [1], None, 6), ("d", [], [0, 3], None, None)],
        "uid string, vals array<float>, shape array<int>, apply_scaling boolean, payload_size int",
    )
    PF.write_payloads(TF.with_containers(given, ["uid", "apply_scaling"]), path, "pt")
    (tmp_path / "pt" / "more").mkdir()
    (tmp_path / "pt" / "more" / "e.pt").write_bytes(b"nothing of the kind")
    read = TF.tensor_files(spark, path, bundle=TF.BUNDLE_KEYS)
    got = rows(read.select(F.regexp_extract("path", "([^/]*)$", 1), "dtype", "shape", F.transform("vals", lambda v: F.when(~F.isnan(v), v)), "reason"))
    assert got == [("a.pt", "float32", [2, 1], [1.0, 2.0], None), ("b.pt", "float32", [2], [3.0, None], None), ("d.pt", "float32", [0, 3], [], None), ("e.pt", None, None, None, "broken")]
    manifest = L.build_manifest(TF.container_latents(read, "uid string, apply_scaling string"))
    assert rows(manifest, "uid", "shape", "scaled") == [("a", [2, 1], True), ("b", [2], False), ("d", [0, 3], None)]
    with pytest.raises(Exception, match="don't fill the shape"):
        TF.with_containers(given.select("uid", "vals", F.array(F.lit(7)).alias("shape"))).collect()


def test_files_are_dealt_out_by_number_and_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "pt")
    rows = spark.range(40).select(F.col("id").cast("string").alias("uid"), F.array_repeat(F.lit(0.5), 100).alias("vals"), F.array(F.lit(100)).alias("shape"))
    PF.write_payloads(TF.with_containers(rows), path, "pt")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.pt"))
    monkeypatch.setattr(TF, "FILES", 8)
    assert TF.tensor_files(spark, path).rdd.getNumPartitions() == 5
    monkeypatch.setattr(TF, "BYTES", size // 10)
    assert TF.tensor_files(spark, path).rdd.getNumPartitions() in (10, 11)
