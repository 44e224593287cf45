"""A data source of answers that lead on by cursors: chains are read in parallel, and a stream goes on where the last one stopped.

An answer is a JSON file {"items": [...], "end_cursor": ..., "has_next": ...} in the folder of its chain, named by the cursor that asks for it
(FIRST for the chain's first page). Items of any form are handed on as JSON texts. The folders are reached by pyarrow's file systems (file, hdfs, s3, gs).

    spark.dataSource.register(CursorPages)
    spark.read.format("cursor_pages").load(path)                                          # whole chains
    spark.readStream.format("cursor_pages").option("progress", place).option("pages", 5)  # so many pages of each chain a batch

The stream's offset is the number of rounds. Where each chain stands after a round is written to the progress folder by the task that has read
it, before the round ends; a round that is run again begins where the round before has stopped. So nothing grows on the driver but the list of chains.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIRST = "first"
SCHEMA = "chain string, page int, cursor string, place int, item string"
_ARROW = pa.schema([("chain", pa.string()), ("page", pa.int32()), ("cursor", pa.string()), ("place", pa.int32()), ("item", pa.string())])
#: Chains of a partition share one task; more partitions than this are not made.
PARTITIONS = 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def file_of(cursor: str | None) -> str:
    return f"{quote(cursor, safe='') if cursor is not None else FIRST}.json"


class Chains(InputPartition):
    """Some chains, and the round to be read of them (None: whole chains)."""

    def __init__(self, names: list[str], round_: int | None = None):
        super().__init__(0)
        self.names, self.round = names, round_


class _Reader:
    def __init__(self, options: dict):
        self.path, self.progress = options["path"], options.get("progress")
        self.pages = int(options.get("pages", 0)) or None

    def partitions_of(self, round_: int | None) -> list[Chains]:
        system, inner = _open(self.path)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory)
        groups: dict[int, list[str]] = {}
        for n in names:
            groups.setdefault(zlib.crc32(n.encode()) % PARTITIONS, []).append(n)
        return [Chains(g, round_) for _, g in sorted(groups.items())]

    def read(self, part: Chains) -> Iterator[pa.RecordBatch]:
        system, inner = _open(self.path)
        for name in part.names:
            page, cursor, more = (0, None, True) if part.round is None else self._mark(name, part.round - 1)
            until = None if self.pages is None else page + self.pages
            while more and (until is None or page < until):
                file = f"{inner}/{name}/{file_of(cursor)}"
                if system.get_file_info(file).type != fs.FileType.File:
                    break  # not there yet: a later round asks again
                with system.open_input_stream(file) as f:
                    answer = json.loads(f.read())
                items = [json.dumps(x) for x in answer.get("items") or []]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([name] * len(items), [page] * len(items), [cursor] * len(items), range(len(items)), items), _ARROW, strict=True)], schema=_ARROW)
                more, page, cursor = bool(answer.get("has_next")) and answer.get("end_cursor") is not None, page + 1, answer.get("end_cursor")
            if part.round is not None:
                self._set_mark(name, part.round, page, cursor, more)

    def _place(self, name: str, round_: int) -> tuple[fs.FileSystem, str]:
        system, inner = _open(self.progress)
        return system, f"{inner}/round={round_}/{name}.json"

    def _mark(self, name: str, round_: int) -> tuple[int, str | None, bool]:
        """Where a chain stands after a round: number of its pages, the next cursor, and whether it goes on."""
        system, file = self._place(name, round_)
        if round_ < 0 or system.get_file_info(file).type != fs.FileType.File:
            return 0, None, True  # a chain that has come since begins at its first page
        with system.open_input_stream(file) as f:
            m = json.loads(f.read())
        return m["page"], m["cursor"], m["more"]

    def _set_mark(self, name: str, round_: int, page: int, cursor: str | None, more: bool) -> None:
        system, file = self._place(name, round_)
        system.create_dir(file.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(file) as f:
            f.write(json.dumps({"page": page, "cursor": cursor, "more": more}).encode())


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Chains]:
        return self.partitions_of(None)


class StreamReader(_Reader, DataSourceStreamReader):
    """Each batch is a round."""

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """One round more than the progress folder has begun, or as many if every chain that it knows has ended and no other has come."""
        system, inner = _open(self.progress)
        info = system.get_file_info(inner)
        rounds = [int(f.base_name[6:]) for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("round=")] if info.type == fs.FileType.Directory else []
        if not rounds:
            return {"round": 1}
        last = max(rounds)
        names = {n for p in self.partitions_of(None) for n in p.names}
        return {"round": last + 1 + any(self._mark(n, last)[2] for n in names)}

    def partitions(self, start: dict, end: dict) -> list[Chains]:
        if end["round"] == start["round"]:
            return []
        if end["round"] - start["round"] != 1:
            raise ValueError("a batch is one round, as a round needs the marks of the one before")
        return self.partitions_of(start["round"])

    def commit(self, end: dict) -> None:
        pass


def save_answers(pages: DataFrame, path: str) -> None:
    """Write answers (chain, cursor: null for the first page, answer: JSON text) as files of this layout, each by the task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _open(path)
        for b in batches:
            for chain, cursor, answer in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                system.create_dir(f"{inner}/{chain}", recursive=True)
                with system.open_output_stream(f"{inner}/{chain}/{file_of(cursor)}") as f:
                    f.write(answer.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    pages.select("chain", "cursor", "answer").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


class CursorPages(DataSource):
    """format("cursor_pages"); options: path, and for streams progress (a folder) and pages (of each chain a round)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        if "progress" not in self.options or "pages" not in self.options:
            raise ValueError("a stream of cursor_pages needs the options progress and pages")
        return StreamReader(self.options)
