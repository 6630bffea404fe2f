"""Vectors: exact cosine, rotation, scalar quantisation, bit packing and sign projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType

from quillmark.constants import BOUNDARIES, CENTROIDS

#: Seeds are parameters: data quantised elsewhere are read with the seeds they were written with.
ROTATION_SEED, SIGN_SEED = "quillmark-rotation", "quillmark-signs"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths, empty ones, and norms whose product is next to nothing."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (size < 1.19e-7), 0.0).otherwise(dot(a, b) / size)


class Words32:
    """A stream of 32-bit numbers from a text seed: two registers, shifts and sums modulo 2**32."""

    def __init__(self, seed: str):
        a = b = 0
        for octet in seed.encode():
            a, b = (a * 31 + octet) % 2**32, (b * 37 + octet) % 2**32
        self.state = (a or 0x12345678, b or 0x87654321)

    def __next__(self) -> int:
        old, keep = self.state
        old ^= old << 23 & 0xFFFFFFFF
        old ^= old >> 17
        new = old ^ keep
        new ^= keep >> 26
        self.state = (keep, new)
        return (keep + new) % 2**32


def signs(n: int, seed: str = ROTATION_SEED) -> np.ndarray:
    stream = Words32(seed)
    return np.array([1.0 if next(stream) % 2 else -1.0 for _ in range(n)])


def padded(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(n)


def rotate(x: np.ndarray, seed: str = ROTATION_SEED) -> np.ndarray:
    """Rows padded to a power of two, signs flipped, transformed."""
    n = padded(x.shape[1])
    wide = np.pad(x.astype(float), ((0, 0), (0, n - x.shape[1])))
    return (wide * signs(n, seed)) @ hadamard(n)


def quantise(x: np.ndarray, bits: int = 2, seed: str = ROTATION_SEED) -> np.ndarray:
    """Code of each rotated coordinate: how many boundaries lie below it. Zero vectors have code 0 throughout."""
    size = np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    turned = rotate(np.divide(x, size, out=np.zeros(x.shape), where=size > 0), seed)
    codes = np.searchsorted(np.array(BOUNDARIES[bits]) / np.sqrt(turned.shape[1]), turned, "left")
    return np.where(size > 0, codes, 0).astype(np.int8)


def dequantise(codes: np.ndarray, norms: np.ndarray, dim: int, bits: int = 2, seed: str = ROTATION_SEED) -> np.ndarray:
    n = codes.shape[1]
    levels = np.array(CENTROIDS[bits]) / np.sqrt(n)
    return ((levels[np.clip(codes, 0, len(levels) - 1)] @ hadamard(n)) * signs(n, seed) * np.asarray(norms)[:, None])[:, :dim]


def pack_codes(codes: list[int], bits: int) -> bytes:
    """Codes side by side, least bit first."""
    if bits not in CENTROIDS:
        raise ValueError(f"1 to 4 bits, not {bits}")
    value = sum((c & (2**bits - 1)) << (i * bits) for i, c in enumerate(codes))
    return value.to_bytes((len(codes) * bits + 7) // 8, "little")


def unpack_codes(data: bytes, bits: int, n: int) -> list[int]:
    if bits not in CENTROIDS:
        raise ValueError(f"1 to 4 bits, not {bits}")
    value = int.from_bytes(data, "little")
    return [value >> (i * bits) & (2**bits - 1) for i in range(n)]


def sign_bits(x: np.ndarray, m: int, seed: str = SIGN_SEED) -> np.ndarray:
    """Signs of m random projections of each row, Gaussian rows drawn from 'seed:row' in pairs."""
    n = x.shape[1]
    rows = np.empty((m, n + n % 2))
    for i in range(m):
        stream = Words32(f"{seed}:{i}")
        u = np.array([(next(stream) + 1.0) / 4294967297.0 for _ in range(rows.shape[1])]).reshape(-1, 2)
        r = np.sqrt(-2 * np.log(u[:, 0]))
        rows[i, 0::2], rows[i, 1::2] = r * np.cos(2 * np.pi * u[:, 1]), r * np.sin(2 * np.pi * u[:, 1])
    return (x @ rows[:, :n].T >= 0).astype(np.int8)


@F.pandas_udf(ArrayType(ByteType()))
def codes_2bit(v: pd.Series) -> pd.Series:
    return pd.Series(list(quantise(np.stack(v.to_numpy()), 2))) if len(v) else pd.Series([], dtype=object)


@F.pandas_udf(ArrayType(DoubleType()))
def rotated(v: pd.Series) -> pd.Series:
    return pd.Series(list(rotate(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)


def code_cosine(query: np.ndarray, codes: Column, bits: int = 2) -> Column:
    """Cosine of a query against codes, on the codes: sum of rotated query times centroid over the query's norm."""
    size = float(np.linalg.norm(query))
    turned = rotate(query[None, :])[0] / (size or 1.0)
    levels = F.array(*(F.lit(float(c / np.sqrt(len(turned)))) for c in CENTROIDS[bits]))
    q = F.array(*map(F.lit, map(float, turned)))
    return F.aggregate(F.zip_with(q, codes, lambda x, c: x * F.element_at(levels, c.cast("int") + 1)), F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(ArrayType(ByteType()))
def sign_bits_64(v: pd.Series) -> pd.Series:
    return pd.Series(list(sign_bits(np.stack(v.to_numpy()).astype(float), 64))) if len(v) else pd.Series([], dtype=object)
