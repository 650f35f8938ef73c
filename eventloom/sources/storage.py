"""Files for the data sources: listing, reading of ranges, and writing that shows a finished job's files only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def at(address: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(address)
    return system, path.rstrip("/")


def listing(address: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder with one of the suffixes; staged files don't count."""
    system, path = at(address)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(suffixes) and "/_staging-" not in x.path)


@dataclass
class Written(WriterCommitMessage):
    """Files of a finished task: names relative to the staging folder, and the rows in all."""

    names: list[str]
    rows: int = 0
    skipped: int = 0


@dataclass
class StagedWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder; the job's commit moves the files of the attempts that finished to their
    places, and removes what others left. ``keep``: a file that exists already stays as it is."""

    address: str
    overwrite: bool = False
    keep: bool = False
    suffix: str = ""
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def staging(self) -> str:
        return f"{self.address.rstrip('/')}/_staging-{self.job}"

    def open(self, name: str):
        """A stream to a new staged file that will be called ``name`` below the sink's folder."""
        system, path = at(f"{self.staging}/{name}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)

    def exists(self, name: str) -> bool:
        system, path = at(self.address)
        return system.get_file_info(f"{path}/{name}").type == fs.FileType.File

    def attempt(self) -> str:
        """A folder of this attempt's own, so that two attempts of a task never write to one file."""
        return uuid.uuid4().hex

    def _done(self) -> None:
        system, path = at(self.staging)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = at(self.address)
        if self.overwrite:
            for path, _ in listing(self.address, (self.suffix,)):
                system.delete_file(path)
        made = {root}
        for name in self._names(messages):
            _, _, final = name.partition("/")  # without the attempt
            folder = f"{root}/{final}".rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            if not (self.keep and self.exists(final)):
                system.move(f"{at(self.staging)[1]}/{name}", f"{root}/{final}")
        self._done()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._done()

    @staticmethod
    def _names(messages: list[WriterCommitMessage | None]) -> Iterator[str]:
        for m in messages:
            if m is not None:
                yield from m.names
