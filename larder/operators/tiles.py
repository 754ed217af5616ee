"""Two large sides met in tiles: every row of one block with every row of one block of the other.

Queries are dealt into ``a`` blocks and rows into ``b`` blocks; a query goes to
the b tiles of its block and a row to the a tiles of its own, so each pair meets
in exactly one tile.  Tiles are as large as their bound allows, which keeps the
copies few, and there are at least as many as cores while the rows suffice: the
work lies in the pairs, not in the bytes.  Nothing passes the driver but the two
counts, nothing is broadcast, and the plan has two scans whatever the sizes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest rows of a tile that is made for the sake of parallel work.
LEAST_ROWS = 256


class Grid(NamedTuple):
    """The numbers of blocks of either side."""

    a: int
    b: int

    @property
    def tiles(self) -> int:
        return self.a * self.b


def grid(queries: int, rows: int, most_queries: int, most_rows: int, cores: int, least_rows: int = LEAST_ROWS) -> Grid:
    a, b = max(1, -(-queries // most_queries)), max(1, -(-rows // most_rows))
    wanted = min(-(-2 * cores // a), -(-rows // least_rows))
    return Grid(a, max(b, wanted))


def cores(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def _block(by: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def query_tiles(queries: DataFrame, by: list[str], g: Grid) -> DataFrame:
    """Each query with the ``_tile`` numbers of its block; ``by`` decides the block."""
    return queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(g.b - 1))).alias("_b")).withColumn("_tile", F.col("_b") * g.a + _block(by, g.a)).drop("_b")


def row_tiles(rows: DataFrame, by: list[str], g: Grid) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(g.a - 1))).alias("_a")).withColumn("_tile", _block(by, g.b) * g.a + F.col("_a")).drop("_a")


#: Most tasks of a tiled job; with more tiles a task has several.
MOST_TASKS = 20_000


def gathered(df: DataFrame, g: Grid) -> DataFrame:
    """The rows of a tile in one partition."""
    n = min(g.tiles, MOST_TASKS)
    return df.repartitionById(n, F.pmod(F.col("_tile"), F.lit(n)).cast("int"))
