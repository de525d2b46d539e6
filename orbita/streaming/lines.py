"""A growing log file as a stream: complete lines after a byte offset; a line its writer has not finished waits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from orbita.sources.files import _opened

#: Bytes of a log that one batch takes at most.
BATCH_BYTES = 16 << 20


def complete_lines(path: str, start: int, most: int = BATCH_BYTES) -> tuple[list[str], int]:
    """Lines of a file from byte ``start`` to the last line end within ``most`` bytes, and the byte after it. A line longer than that
    is read whole."""
    with _opened(path) as f:
        size = f.size()
        while True:
            f.seek(start)
            block = f.read(min(most, size - start))
            end = block.rfind(b"\n") + 1
            if end or start + len(block) >= size:
                return [x for x in block[:end].decode("utf-8", "replace").split("\n") if x.strip()], start + end
            most *= 2


class LineReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        lines, end = complete_lines(self.path, start["byte"])
        return iter([(x,) for x in lines]), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        at, out = start["byte"], []
        while at < end["byte"]:
            lines, at = complete_lines(self.path, at)
            out += [(x,) for x in lines]
        return iter(out)

    def commit(self, end: dict) -> None:
        pass


class GrowingLog(DataSource):
    """``spark.readStream.format("growing_log").load(path)``: column ``line``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> StructType:
        return StructType().add("line", "string")

    def simpleStreamReader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"])


def growing_log(spark: SparkSession, path: str):
    """A stream of the complete lines of one file that grows."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").load(path)
