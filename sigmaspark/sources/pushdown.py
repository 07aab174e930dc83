"""What the file sources share: reading only the files, frames and columns that a query asks for.

Columns are pruned by the schema a reader is given: ``spark.read.format("dsf").schema("path
string, frame_no long")`` never reads sound. Filters are pushed down with option ``push``, for
which ``spark.sql.python.filterPushdown.enabled`` must be set; ``open_source`` does both. Bounds on
a frame's number become byte or sector ranges, a file's name leaves out other files, and an area
chooses what is read of a disc. Spark checks every filter again, so a bound only spares reading.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from .files import Span, shares

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Wanted:
    """The rows that pushed filters leave: bounds of numbers (both counted in) and sets of values."""

    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    values: dict[str, set] = field(default_factory=dict)

    def _bound(self, name: str, low: float = -math.inf, high: float = math.inf) -> None:
        a, b = self.bounds.get(name, (-math.inf, math.inf))
        self.bounds[name] = max(a, low), min(b, high)

    def _one_of(self, name: str, values: Iterable) -> None:
        self.values[name] = self.values.get(name, set(values)) & set(values)
        if self.values[name] and all(isinstance(v, int) for v in self.values[name]):
            self._bound(name, min(self.values[name]), max(self.values[name]))

    def take(self, filters: Iterable[ds.Filter]) -> None:
        for f in filters:
            if len(getattr(f, "attribute", ())) != 1 or isinstance(v := getattr(f, "value", None), (list, dict)) or v is None:
                continue
            name = f.attribute[0]
            if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
                self._one_of(name, [v])
            elif isinstance(f, ds.In):
                self._one_of(name, [x for x in v if x is not None])
            elif isinstance(v, int):
                if isinstance(f, ds.GreaterThan):
                    self._bound(name, low=v + 1)
                elif isinstance(f, ds.GreaterThanOrEqual):
                    self._bound(name, low=v)
                elif isinstance(f, ds.LessThan):
                    self._bound(name, high=v - 1)
                elif isinstance(f, ds.LessThanOrEqual):
                    self._bound(name, high=v)

    def allows(self, name: str, value) -> bool:
        low, high = self.bounds.get(name, (-math.inf, math.inf))
        return value in self.values.get(name, {value}) and (not isinstance(value, (int, float)) or low <= value <= high)

    def range(self, name: str, n: int) -> tuple[int, int]:
        """Begin and end of the numbers 0 to n - 1 that are asked for."""
        low, high = self.bounds.get(name, (-math.inf, math.inf))
        begin = int(max(low, 0)) if low < n else n
        return begin, max(begin, int(min(high + 1, n)))


class TableReader(ds.DataSourceReader):
    """Plans shares of files from their sizes; ``columns`` are those of the schema that is asked for."""

    endings: tuple[str, ...] = ()
    shared: tuple[str, ...] = ("frames",)  # tables whose files are read in shares

    def __init__(self, options: dict, schema: StructType, default: str = "frames"):
        self.path, self.table = options["path"], options.get("table", default)
        self.options, self.columns, self.wanted = dict(options), schema.names, Wanted()

    def has(self, column: str) -> bool:
        return column in self.columns

    def row(self, **values) -> tuple:
        return tuple(values[c] for c in self.columns)

    def broken(self, path: str, error: Exception) -> tuple:
        """The row of a file that can't be read, in a table that tells so."""
        return tuple(path if c == "path" else str(error) if c == "error" else None for c in self.columns)

    def partitions(self):
        planned = shares(self.path, self.endings, self.table not in self.shared)
        return [Span(*x) for x in planned if self.wanted.allows("path", x[0])] or [Span("")]


class Pushing:
    """Beside a reader: takes filters, and leaves all of them for Spark to check again."""

    def pushFilters(self, filters):
        self.wanted.take(filters)
        return filters


def reader_of(plain: type, pushed: type, options, schema: StructType, *more):
    return (pushed if options.get("push", "false").lower() == "true" else plain)(options, schema, *more)


def open_source(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table of a registered source with filters pushed down; ``schema`` names the columns that are read, with their types."""
    spark.conf.set(PUSHDOWN, "true")
    r = spark.read.format(kind).options(push="true", **options)
    return (r.schema(schema) if schema else r).load(path)
