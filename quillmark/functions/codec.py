"""Quantised vectors as bytes: a versioned header, packed codes and, in the unbiased mode, signs of the residual."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quillmark.constants import CENTROIDS
from quillmark.functions import vector as V

# fixed values
VERSION, HEADER, FAST, UNBIASED, LEAST_RESIDUAL = 1, "<BBBHHffH", 0, 1, 1e-10
_HEADER_BYTES = struct.calcsize(HEADER)
FIELDS = (ST.StructType().add("bits", ST.IntegerType()).add("mode", ST.IntegerType()).add("dim", ST.IntegerType()).add("padded", ST.IntegerType())
          .add("norm", ST.FloatType()).add("residual_norm", ST.FloatType()).add("codes", ST.ArrayType(ST.ByteType())).add("signs", ST.BinaryType()))


def encode(x: np.ndarray, bits: int = 2, mode: int = FAST, seed: str = V.ROTATION_SEED, sign_seed: str = V.SIGN_SEED) -> list[bytes]:
    """A blob for each row. In the unbiased mode codes take a bit less (one at least), and the signs of a random projection of what they leave follow."""
    own = bits if mode == FAST else max(1, bits - 1)
    norms, codes = np.linalg.norm(x.astype(float), axis=1), V.quantise(x, own, seed)
    padded, residual, marks = codes.shape[1], np.zeros(len(x)), [b""] * len(x)
    if mode == UNBIASED:
        unit = np.divide(x, norms[:, None], out=np.zeros(x.shape), where=norms[:, None] > 0)
        left = V.rotate(unit, seed) - np.array(CENTROIDS[own])[codes] / np.sqrt(padded)
        left = np.where(norms[:, None] > 0, left, 0.0) @ V.hadamard(padded) * V.signs(padded, seed)
        residual = np.linalg.norm(left, axis=1)
        some = residual > LEAST_RESIDUAL
        signs = V.sign_bits(np.divide(left, residual[:, None], out=np.zeros(left.shape), where=some[:, None]), padded, sign_seed)
        marks = [V.pack_codes(s.tolist(), 1) if some[i] else b"" for i, s in enumerate(signs)]
    out = []
    for i in range(len(x)):
        body = V.pack_codes(codes[i].tolist(), own)
        out.append(struct.pack(HEADER, VERSION, bits, mode, x.shape[1], padded, norms[i], residual[i], len(body)) + body + struct.pack("<H", len(marks[i])) + marks[i])
    return out


def decode(blob: bytes | None) -> dict | None:
    """The fields of a blob; None if it is damaged."""
    if blob is None or len(blob) < _HEADER_BYTES:
        return None
    version, bits, mode, dim, padded, norm, residual, n = struct.unpack_from(HEADER, blob)
    end = _HEADER_BYTES + n
    if version != VERSION or not 1 <= bits <= 4 or mode not in (FAST, UNBIASED) or not 0 < dim <= padded or len(blob) < end + 2:
        return None
    (m,) = struct.unpack_from("<H", blob, end)
    if len(blob) < end + 2 + m:
        return None
    own = bits if mode == FAST else max(1, bits - 1)
    return {"bits": bits, "mode": mode, "dim": dim, "padded": padded, "norm": norm, "residual_norm": residual, "codes": V.unpack_codes(blob[_HEADER_BYTES:end], own, padded), "signs": blob[end + 2 : end + 2 + m] or None}


def to_blob(vector: Column | str, bits: int = 2, mode: int = FAST) -> Column:
    @F.pandas_udf(ST.BinaryType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(encode(np.stack(v.to_numpy()), bits, mode)) if len(v) else pd.Series([], dtype=object)

    return run(vector)


@F.pandas_udf(FIELDS)
def from_blob(blob: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(b) or dict.fromkeys(FIELDS.names) for b in blob], columns=FIELDS.names)


def storage(bits: int, dim: int) -> dict:
    """Bytes of a vector in the unbiased mode, and how many times fewer than as 32-bit floats."""
    codes, signs = (dim * max(1, bits - 1) + 7) // 8, (dim + 7) // 8
    total = codes + signs + 8
    return {"mse_bytes": codes, "qjl_bytes": signs, "norm_bytes": 8, "total_bytes": total, "original_bytes": dim * 4, "compression_ratio": dim * 4 / total}
