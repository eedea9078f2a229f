"""The node list: ``label|path|status|pid`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.functions.text import strip, to_int


def parse_node_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """All lines with their fields; ``reason`` is null for lines of exactly four fields."""
    parts = F.split(strip(F.col(value)), r"\|", -1)
    good = F.size(parts) == 4
    pick = lambda i: F.when(good, F.get(parts, i))
    return lines.withColumns(
        {
            "label": pick(0),
            "path": pick(1),
            "status": pick(2),
            "pid": to_int(pick(3)),
            "reason": F.when(~F.coalesce(good, F.lit(False)), "expected four fields"),
        }
    )


def read_node_registry(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good nodes and rejected lines; together they account for every input line."""
    parsed = parse_node_lines(lines, value)
    good = parsed.filter("reason is null").drop("reason")
    return good, parsed.filter("reason is not null").drop("label", "path", "status", "pid")


def node_line(label: Column, path: Column, status: Column, pid: Column) -> Column:
    """One line of the list; a dead node has an empty pid."""
    return F.concat_ws("|", label, path, status, F.coalesce(pid.cast("string"), F.lit("")))
