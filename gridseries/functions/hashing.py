"""Repeatable draws and identities from SHA-256 / MD5.

Draws depend only on their key, never on partitioning, so a lost executor or a
different cluster size gives the same sample. The modulo bias for n far below
2**32 is negligible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*parts) -> Column:
    """Parts joined by ``|`` (columns or plain values)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash32(text: Column) -> Column:
    """First eight hex digits of SHA-256 as a non-negative bigint."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def hash_mod(text: Column, n) -> Column:
    """hash32 modulo n."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hash32(text), n.cast("bigint"))


def hash64_mod(text: Column, n: int) -> Column:
    """First sixteen hex digits modulo n; 64 unsigned bits need a decimal."""
    wide = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit(int(n)).cast("decimal(20,0)")).cast("bigint")


def stable_seed(base: int, *parts) -> Column:
    """Seed = base + first eight hex digits of the hash of the parts."""
    return F.lit(int(base)).cast("bigint") + hash32(key_text(*parts))
