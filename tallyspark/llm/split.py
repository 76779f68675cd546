"""The fixed split of labelled rows into those a model may learn from and those held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out, but no model learns from it either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.col(id_col).isNotNull() & ~held_out(id_col)
