"""Lines in ranges of lines: ranges are cut into dyadic blocks, so a position meets a range by an equal key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of 1, 2, 4, ... lines; no range is longer than the largest.
LEVELS = 62


def range_blocks(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``ranges`` with a row for each of the aligned blocks (``level``, ``block``) that make up the lines from start to end.

    A range of n lines has at most two blocks a level and about two log n in all. An empty range or one with a null end
    has none.
    """
    # At level k the range holds the whole blocks from s to e - 1; an odd s, and the last before an odd e, are in no larger one.
    s, e = f"shiftright({start} + shiftleft(1L, k) - 1, k)", f"shiftright({end} + 1, k)"
    left = f"IF({s} & 1 = 1 AND {s} < {e}, {s}, NULL)"
    right = f"IF({e} & 1 = 1 AND {s} + ({s} & 1) < {e}, {e} - 1, NULL)"
    levels = f"sequence(0, CAST(ceil(log2({end} - {start} + 2)) AS INT))"
    blocks = f"filter(flatten(transform({levels}, k -> array(named_struct('level', k, 'block', {left}), named_struct('level', k, 'block', {right})))), x -> x.block IS NOT NULL)"
    rows = ranges.withColumns({start: F.col(start).cast("long"), end: F.col(end).cast("long")}).where(f"{start} <= {end}")
    return rows.select(*ranges.columns, F.inline(F.expr(blocks)))


def position_blocks(positions: DataFrame, line: str, levels: list[int]) -> DataFrame:
    """``positions`` with a row for each of the ``levels``: the ``block`` of that level that holds the line."""
    at = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col(line).cast("long"), k).alias("block")) for k in levels))
    return positions.select(*positions.columns, F.inline(at))


def levels_of(blocks: DataFrame) -> list[int]:
    """The levels in use, LEVELS at most."""
    return sorted(r["level"] for r in blocks.select("level").distinct().collect()) or [0]


def innermost(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``positions`` (path, line, ...) with the ``nid`` of the shortest range (path, nid, line_start, line_end) that holds
    the line; of equal ones the one that starts last, then the smallest nid. Positions in no range are left out.

    Of the ranges that have a block only the best one counts, so a block is one row and a position meets one row a level,
    however many ranges a file has and however deep they nest. Files of any size are split by their blocks. Sizes that
    Spark estimates for blocks are those of the table that they were made from, so joins are told to sort: a side that is
    broadcast would go through the driver whole.
    """
    blocks = range_blocks(ranges.select("path", "nid", "line_start", "line_end"), "line_start", "line_end")
    rank = F.struct((F.col("line_end") - F.col("line_start")).alias("span"), (-F.col("line_start")).alias("start"), "nid")
    best = blocks.groupBy("path", "level", "block").agg(F.min(rank).alias("best"))
    asked = position_blocks(positions.select("path", "line").distinct(), "line", levels_of(blocks))
    found = asked.join(best.hint("merge"), ["path", "level", "block"]).groupBy("path", "line").agg(F.min("best").alias("best"))
    return positions.join(found.hint("merge"), ["path", "line"]).select(*positions.columns, F.col("best.nid").alias("nid"))


def holding(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``positions`` (path, line, ...) with the ``nid`` of each range that holds the line: as many rows as there are hits."""
    blocks = range_blocks(ranges.select("path", "nid", "line_start", "line_end"), "line_start", "line_end").select("path", "nid", "level", "block")
    return position_blocks(positions, "line", levels_of(blocks)).join(blocks.hint("merge"), ["path", "level", "block"]).select(*positions.columns, "nid")
