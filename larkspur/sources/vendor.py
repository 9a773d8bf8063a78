"""Daily prices as a vendor gives them: a data source with one partition for each block of symbols.

``spark.read.format("vendor_prices").schema(...).option("path", ...).option("symbols", "A,B,...").load()``

Each symbol has a folder ``symbol=<its name>`` of CSV files with a header. Only
the columns of the schema are read; a filter on ``symbol`` leaves out other
symbols' files. A symbol whose files are missing or can't be read gives one row with its
``error`` instead of stopping the others. Memory is bounded by one symbol.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume long, error string"
READ = {"date": date.fromisoformat, "double": float, "long": int, "bigint": int, "string": str}


@dataclass
class Block(InputPartition):
    symbols: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, symbols: list[str], block: int):
        self.columns = [(f.name, READ[f.dataType.simpleString()]) for f in schema]
        self.path, self.symbols, self.block = path.rstrip("/"), symbols, block

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Symbols that are asked for; Spark checks the other filters, and these once more."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("symbol",):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif isinstance(f, In) and f.attribute == ("symbol",):
                self.symbols = [s for s in self.symbols if s in f.value]
            yield f

    def partitions(self) -> list[Block]:
        return [Block(tuple(self.symbols[i : i + self.block])) for i in range(0, len(self.symbols), self.block)] or [Block(())]

    def read(self, partition: Block) -> Iterator[tuple]:
        for symbol in partition.symbols:
            try:
                yield from list(self._symbol(symbol))
            except (OSError, ValueError, KeyError) as e:
                said = {"symbol": symbol, "error": f"{type(e).__name__}: {e}".split("\n")[0][:200]}
                yield tuple(said.get(name) for name, _ in self.columns)

    def _symbol(self, symbol: str) -> Iterator[tuple]:
        found, base = pafs.FileSystem.from_uri(self.path)
        names = dict.fromkeys((quote(symbol, safe=" "), symbol.replace("/", "%2F")))  # writers differ in what they escape
        folders = [pafs.FileSelector(f"{base}/symbol={name}", allow_not_found=True) for name in names]
        files = [f.path for s in folders for f in found.get_file_info(s) if f.is_file and not f.base_name.startswith(("_", "."))]
        if not files:
            raise FileNotFoundError(f"no prices of {symbol}")
        for path in sorted(files):
            with found.open_input_stream(path) as raw:
                for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline="")):
                    yield tuple(symbol if name == "symbol" else None if name == "error" else read(row[name]) if row[name] else None for name, read in self.columns)


class VendorPrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        symbols = [s for s in self.options.get("symbols", "").split(",") if s]
        return Reader(schema, self.options["path"], symbols, int(self.options.get("block", "50")))


def prices(spark: SparkSession, folder: str, symbols: list[str], columns: str = SCHEMA, block: int = 50) -> DataFrame:
    """Prices of the symbols; ``columns`` (names and types) are all that is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorPrices)
    return spark.read.format("vendor_prices").schema(columns).option("path", folder).option("symbols", ",".join(symbols)).option("block", block).load()


def wide(rows: DataFrame, symbols: list[str], fields: list[str]) -> DataFrame:
    """(d, one column ``<field>_<symbol>`` for each): the frame that a download of several symbols gives."""
    cells = [F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{f}_{s}") for f in fields for s in symbols]
    return rows.where("d IS NOT NULL").groupBy("d").agg(*cells)
