"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: labels go to all tasks in blocks of about so many; each block is a pass over the ids, and no text is shuffled
LABEL_BLOCK = 2_000_000


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a row without id falls to 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_label`` (0 or 1), only rows that have one. Labels of one id count once; where they differ, 1 wins."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_marked")).agg(F.max(label).cast("int").alias("_label"))
    blocks = max(1, -(-labels.count() // LABEL_BLOCK))
    found = None
    for block in range(blocks):
        some = marks.where(F.pmod(F.xxhash64("_marked"), F.lit(blocks)) == block)
        rows = docs.join(F.broadcast(some), docs[id_col] == some["_marked"]).drop("_marked")
        found = rows if found is None else found.unionByName(rows)
    return found


def sizes(rows: DataFrame, by: str) -> dict:
    """Number of rows of each value of ``by``."""
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}


def bounded(rows: DataFrame, by: str, most: int, id_col: str = "doc_id", salt: int = 0, counts: dict | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``by``, drawn by a hash of the id; all of a value that has no more.

    Reads the column ``by`` once to count, if ``counts`` does not say how many each value has.
    """
    counts = sizes(rows, by) if counts is None else counts
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        keep |= F.col(by).eqNullSafe(F.lit(value)) & (draw < int(min(1.0, most / n) * (1 << 30)))
    return rows.where(keep)


def weights(drawn: np.ndarray, counts: dict) -> np.ndarray:
    """For each drawn row how many rows of its class it stands for, so that the classes weigh what they weigh undrawn."""
    out = np.ones(len(drawn))
    for value, n in counts.items():
        of = drawn == value
        out[of] = n / max(1, of.sum())
    return out
