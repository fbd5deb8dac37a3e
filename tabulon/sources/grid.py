"""Files of a folder as a Spark source: ``spark.read.format("grid").load(folder)`` after ``register(spark)``.

A partition is a file. The options ``files`` and ``sheets``, JSON lists of names, leave out all others before anything is opened; they
belong to one load, so scans of one plan may ask for different files. Filters aren't pushed down to the reader: Spark
4.1 keeps the reader of the first filtered query of a frame for all later ones, which would then lack rows. Folders are reached by
pyarrow's file systems; ``read_grid`` reads through Spark's own and splits large delimited files.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.sources.sheets import DELIMITED, GRID, UNREADABLE, WORKBOOKS, file_rows
from tabulon.tables import ship


@dataclass
class File(InputPartition):
    path: str
    name: str


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    scheme = urlsplit(folder).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(folder).path) if scheme else folder
    return fs.FileSystem.from_uri(folder)


class GridReader(DataSourceReader):
    def __init__(self, folder: str, files: set[str] | None, sheets: set[str] | None):
        self.folder, self.files, self.sheets = folder, files, sheets

    def partitions(self) -> list[File]:
        system, path = _system(self.folder)
        found = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and not x.base_name.startswith("~$")]
        known = [x for x in found if x.base_name.rpartition(".")[2].lower() in (*WORKBOOKS, *DELIMITED, *UNREADABLE)]
        if all(x.base_name.rpartition(".")[2].lower() in UNREADABLE for x in known):
            raise FileNotFoundError(f"no file of {', '.join((*WORKBOOKS, *DELIMITED))} in {self.folder}")
        return [File(x.path, x.base_name) for x in sorted(known, key=lambda x: x.path) if self.files is None or x.base_name in self.files]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file is left
            return
        with _system(self.folder)[0].open_input_stream(partition.path, compression=None) as f:
            content = f.read()
        yield from file_rows(partition.name, content, self.sheets)


class GridSource(DataSource):
    """Rows of GRID."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return GRID

    def reader(self, schema) -> GridReader:
        files, sheets = (set(json.loads(self.options[k])) if k in self.options else None for k in ("files", "sheets"))
        return GridReader(self.options["path"], files, sheets)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(GridSource)


def load(spark: SparkSession, folder: str, files: Iterable[str] | None = None, sheets: Iterable[str] | None = None) -> DataFrame:
    """Rows of GRID, only of the named files and sheets if given; of a file that is named, warnings come with the rows."""
    register(spark)
    asked = {k: json.dumps(sorted(v)) for k, v in (("files", files), ("sheets", sheets)) if v is not None}
    return spark.read.format("grid").options(**asked).load(folder)
