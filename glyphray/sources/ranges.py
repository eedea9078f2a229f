"""Files read by ranges: only the bytes that a question needs leave the store, not the pixels behind a header.

A scan that does not use ``content`` lists files without reading them. The functions here open such a file by its path
where the task runs, through Arrow's file systems, and fetch pages as they are touched.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.operators import packed
from glyphray.sources.files import MAGIC, MAGIC_OFFSET

PAGE = 1 << 14


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or address, and the path in it."""
    path = path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranged:
    """A file as bytes: slices fetch the pages they touch, which are kept. ``fetched`` counts the bytes."""

    def __init__(self, path: str):
        system, inner = located(path)
        self.file = system.open_input_file(inner)
        self.size, self.pages, self.fetched = self.file.size(), {}, 0

    def __len__(self) -> int:
        return self.size

    def page(self, number: int) -> bytes:
        if number not in self.pages:
            at = number * PAGE
            self.pages[number] = self.file.read_at(min(PAGE, self.size - at), at)
            self.fetched += len(self.pages[number])
        return self.pages[number]

    def __getitem__(self, places: slice) -> bytes:
        start, stop, _ = places.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // PAGE, (stop - 1) // PAGE
        if first == last:
            return self.page(first)[start - first * PAGE:stop - first * PAGE]
        whole = b"".join(self.page(n) for n in range(first, last + 1))
        return whole[start - first * PAGE:stop - first * PAGE]

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def read_range(path: Column, at: int, size: int) -> Column:
    """``size`` bytes from ``at`` on (fewer where the file ends), and the reason where the file can't be read."""

    def run(paths: pa.Array) -> pa.Array:
        out = []
        for name in paths.to_pylist():
            try:
                with Ranged(name) as file:
                    out.append({"bytes": file.file.read_at(max(0, min(size, len(file) - at)), at), "error": None})
            except Exception as e:  # the row carries the failure
                out.append({"bytes": None, "error": str(e) or type(e).__name__})
        return pa.array(out, pa.struct([("bytes", pa.binary()), ("error", pa.string())]))

    run.__annotations__ = {"paths": pa.Array, "return": pa.Array}
    return packed.once(F.arrow_udf(run, "struct<bytes:binary,error:string>"))(path)


def with_magic(scanned: DataFrame, offset: int = MAGIC_OFFSET, magic: bytes = MAGIC, path: str = "path") -> DataFrame:
    """Adds ``accepted`` and ``magic_error``; of every file only the bytes at ``offset`` are read, of short files none.

    ``scanned`` is a scan with ``length`` (``files.scan_files``). A file that can't be opened is not accepted and says why.
    """
    long_enough = F.col("length") >= offset + len(magic)
    read = scanned.withColumn("__range", read_range(F.when(long_enough, F.col(path)), offset, len(magic)))
    return read.select(
        *scanned.columns, F.coalesce(F.col("__range.bytes") == F.lit(magic), F.lit(False)).alias("accepted"),
        F.when(long_enough, F.col("__range.error")).alias("magic_error"),
    )
