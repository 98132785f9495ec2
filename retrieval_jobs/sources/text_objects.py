"""A sink that writes each row's text as an object of its own."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_objects(path: str, locations: Iterable[str]) -> Iterator[str | None]:
    """The texts of the objects at these locations below the path; null where there is none."""
    system, base = _open(path.rstrip("/"))
    for location in locations:
        try:
            with system.open_input_stream(f"{base}/{location}") as data:
                text = data.read().decode()
        except FileNotFoundError:
            text = None
        yield text


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    objects: int
    size: int


class TextObjectsWriter(DataSourceWriter):
    """Rows of (location, text): the text goes to the object at location, below the path.

    An object is written beside its place and then moved there, so nobody sees half of one, and a task that is run again puts the same
    object there again. When all tasks are done, a file in _commits tells how many objects the job wrote.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = _open(self.path)
        objects, size, made = 0, 0, set()
        for location, text in iterator:
            place = posixpath.normpath(location)
            if place.startswith(("/", "..")):
                raise ValueError(f"{location} lies outside {self.path}")
            folder, name = posixpath.split(f"{base}/{place}")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            data, aside = text.encode(), f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write(data)
            system.move(aside, f"{folder}/{name}")
            objects, size = objects + 1, size + len(data)
        return Written(objects, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        system.create_dir(f"{base}/_commits", recursive=True)
        told = [m for m in messages if m is not None]
        with system.open_output_stream(f"{base}/_commits/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"objects": sum(m.objects for m in told), "bytes": sum(m.size for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Objects that are there already stay: no row points to them before the rows are written, and the next try replaces them."""


class TextObjects(DataSource):
    """df.write.format("text_objects").mode("append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "text_objects"

    def schema(self) -> str:
        return "location string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TextObjectsWriter:
        if overwrite or schema.names != ["location", "text"]:
            raise ValueError("text_objects appends rows of location and text")
        return TextObjectsWriter(self.options["path"])
