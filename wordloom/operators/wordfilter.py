"""A Bloom filter over a table of words, as a small broadcast table.

A word sets three bits of one 64-bit cell that its hash picks.  Cells are kept in
rows of ``ROW_CELLS``; the whole filter has at most ``MAX_BITS`` bits (16 MB)
whatever the number of words, so it can be broadcast.  Every word of the table
passes, other words pass by chance (about 2 % at ten bits a word; more for more
than 13 M words, which costs work but no result).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import cut_lineage

BITS_PER_WORD = 10
MAX_BITS = 1 << 27
ROW_CELLS = 512


@dataclass(frozen=True)
class WordFilter:
    rows: DataFrame  # part, cells: array<bigint>
    n_cells: int

    def marked(self, df: DataFrame, word: str = "word", name: str = "maybe") -> DataFrame:
        """``df`` and whether its word may be in the table: a broadcast hash join, no exchange."""
        cell, mask = _place(F.col(word), self.n_cells)
        part = F.shiftright(cell, ROW_CELLS.bit_length() - 1)
        inside = F.get("cells", cell.bitwiseAND(ROW_CELLS - 1).cast("int"))
        found = df.join(F.broadcast(self.rows), part == F.col("part"), "left")  # every part has a row
        return found.select(*df.columns, F.coalesce(inside.bitwiseAND(mask) == mask, F.lit(False)).alias(name))

    def keep(self, df: DataFrame, word: str = "word") -> DataFrame:
        """Rows of ``df`` whose word may be in the table."""
        return self.marked(df, word, "_maybe").where("_maybe").drop("_maybe")


def _place(word: Column, n_cells: int) -> tuple[Column, Column]:
    """The cell (their number is a power of two) and the three bits in it."""
    h, one = F.xxhash64(word), F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 40 + 8 * i).bitwiseAND(63).cast("int")) for i in range(3)]
    return h.bitwiseAND(n_cells - 1), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def word_filter(words: DataFrame, n_words: int, word: str = "word", max_bits: int = MAX_BITS,
                cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> WordFilter:
    """A filter over the distinct values of ``word``, ``n_words`` of them at most."""
    wanted = min(max(n_words * BITS_PER_WORD, 64 * ROW_CELLS), max_bits)
    n_cells = 1 << max((wanted // 64 - 1).bit_length(), ROW_CELLS.bit_length() - 1)
    cell, mask = _place(F.col(word), n_cells)
    cells = words.select(cell.alias("cell"), mask.alias("bits")).unionByName(
        words.sparkSession.range(n_cells).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("bits")))
    cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    rows = cells.groupBy(F.shiftright("cell", ROW_CELLS.bit_length() - 1).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "bits"))), lambda c: c["bits"]).alias("cells"))
    return WordFilter(cut(rows), n_cells)
