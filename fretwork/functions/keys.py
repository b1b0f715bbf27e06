"""Row keys that stay the same when a task or a batch is repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *cols: Column, digits: int = 16) -> Column:
    """``H-0123456789ABCDEF``: a digest of the business columns.

    A random id would change when Spark repeats a lost task, and eight hex digits collide after some
    ten thousand rows; the digest does neither at the default width.
    """
    text = F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]))
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, digits)))
