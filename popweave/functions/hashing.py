"""Seeded, partition-independent uniforms.

``u = int(md5('seed:k1:k2...')[:13], 16) / 2**52`` — a double in [0, 1)
that depends only on the seed and the key, so a draw is reproducible on any
partitioning, after any executor loss, and in any engine that has md5
(the DuckDB form is ``('0x'||substr(md5(s),1,13))::BIGINT / 2^52``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2 ** 52)


def hash_key(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.concat_ws(":", *parts)


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    hexpart = F.substring(F.md5(hash_key(seed, *keys)), 1, 13)
    return (F.conv(hexpart, 16, 10).cast("long").cast("double") / F.lit(TWO_POW_52))


def py_hash_uniform(seed: int | str, *keys: object) -> float:
    """Same value in plain Python (for tests)."""
    import hashlib

    s = ":".join([str(seed)] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode()).hexdigest()[:13], 16) / TWO_POW_52
