"""Feed-forward encoders of relative positions and shapes. Weights are inputs (their generator isn't reproducible here);
``drawn`` makes a deterministic untrained set of its own."""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SHAPES = {"f_rel": (64, 128, 64), "f_mag": (128, 256, 128), "f_phase": (256, 256, 128), "f_geom": (256, 256, 128)}
Weights = dict[str, dict[str, np.ndarray]]
EPS = 1e-5


def drawn(seed: int = 20260727) -> Weights:
    """Uniform weights within 1 / sqrt(inputs), unit norms."""
    rng, out = np.random.default_rng(seed), {}
    for name, (a, b, c) in SHAPES.items():
        uniform = lambda n, *shape: rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(math.sqrt(n))
        out[name] = {"w1": uniform(a, b, a), "b1": uniform(a, b), "g": np.ones(b, np.float32), "h": np.zeros(b, np.float32), "w2": uniform(b, c, b), "b2": uniform(b, c)}
        if name == "f_geom":
            out[name] |= {"g2": np.ones(c, np.float32), "h2": np.zeros(c, np.float32)}
    return out


def digest(weights: Weights) -> str:
    """SHA-256 over names, shapes and little-endian bytes, in order of name."""
    h = hashlib.sha256()
    for block in sorted(weights):
        for name in sorted(weights[block]):
            value = np.ascontiguousarray(weights[block][name], "<f4")
            h.update(f"{block}.{name}:{value.shape}".encode() + value.tobytes())
    return h.hexdigest()


def _norm(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + EPS) * g + h


_ERF = np.vectorize(math.erf, otypes=[np.float64])


def forward(block: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Linear, layer norm, GELU, linear, and another norm where the block has one; dropout is off."""
    x = _norm(np.asarray(x, np.float32) @ block["w1"].T + block["b1"], block["g"], block["h"])
    x = (x * 0.5 * (1 + _ERF(x / math.sqrt(2)))).astype(np.float32) @ block["w2"].T + block["b2"]
    return (_norm(x, block["g2"], block["h2"]) if "g2" in block else x).astype(np.float32)


def embed_shape(weights: Weights, magnitude: np.ndarray, phase: np.ndarray) -> np.ndarray:
    both = np.concatenate([forward(weights["f_mag"], magnitude), forward(weights["f_phase"], phase)], axis=-1)
    return forward(weights["f_geom"], both)


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(values) * width:
        raise ValueError(f"vectors must have {width} numbers")
    return flat.reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1).astype(np.float32)))


def relative_embedding(spark: SparkSession, code: Column, weights: Weights) -> Column:
    """64 numbers of a relative code."""
    shared = spark.sparkContext.broadcast(pickle.dumps(weights["f_rel"]))

    @F.arrow_udf("array<float>")
    def run(codes: pa.Array) -> pa.Array:
        return _lists(forward(pickle.loads(shared.value), _matrix(codes, 64)))

    return run(code)


def shape_embedding(spark: SparkSession, magnitude: Column, phase: Column, weights: Weights) -> Column:
    """128 numbers of a shape's magnitudes and phases."""
    shared = spark.sparkContext.broadcast(pickle.dumps(weights))

    @F.arrow_udf("array<float>")
    def run(m: pa.Array, p: pa.Array) -> pa.Array:
        return _lists(embed_shape(pickle.loads(shared.value), _matrix(m, 128), _matrix(p, 256)))

    return run(magnitude, phase)
