"""A compressed block file as a Spark data source, for reading and writing.

A file holds a header (magic, version, codec names), the coded blocks one after another, and a footer
with each block's place, sizes, flags and checksum, so that a reader takes any range of blocks. Each
task writes a file of its own under a temporary name; commit renames them, abort removes them. Paths
go through pyarrow's file systems (local, HDFS, S3 and others by URI).

    spark.dataSource.register(BlockFileSource)
    blocks.write.format("blockloom").option("transform", "BWT+MTF").option("entropy", "ANS").mode("append").save(path)
    spark.read.format("blockloom").load(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockloom.functions.hashing import CHECK_SEED, xxh32
from blockloom.operators.codecs import ENTROPY, TRANSFORMS, decode_block, encode_block, pair

MAGIC, VERSION = b"BLMF", 1
SCHEMA = "stream_id bigint, block_id int, payload binary"
ENDING = ".blk"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, at = _open(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(ENDING) and not f.base_name.startswith("_"))


def read_footer(system: fs.FileSystem, at: str) -> dict:
    """The file's index; a ValueError where it is no whole block file."""
    size = system.get_file_info(at).size
    with system.open_input_file(at) as f:
        if size < 16 or f.read(5) != MAGIC + bytes([VERSION]):
            raise ValueError(f"{at} is no block file of version {VERSION}")
        f.seek(size - 12)
        tail = f.read(12)
        n = int.from_bytes(tail[:8], "big")
        if tail[8:] != MAGIC or n + 17 > size:
            raise ValueError(f"{at} ends too early")
        f.seek(size - 12 - n)
        return json.loads(f.read(n))


@dataclass
class Range(InputPartition):
    """Some blocks of one file."""

    path: str
    transform: str
    entropy: str
    blocks: list


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = int(options.get("blocksPerTask", 64))
        self.fail_fast = options.get("mode", "FAILFAST").upper() == "FAILFAST"

    def partitions(self) -> list[Range]:
        system, _ = _open(self.path)
        out = []
        for at in _files(self.path):
            index = read_footer(system, at)
            blocks = index["blocks"]
            out += [Range(at, index["transform"], index["entropy"], blocks[i : i + self.per_task]) for i in range(0, len(blocks), self.per_task)]
        return out or [Range("", "NONE", "NONE", [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.blocks:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            for stream, block, offset, length, n_in, used, checksum in partition.blocks:
                f.seek(offset)
                try:
                    data = decode_block(f.read(length), n_in, used, partition.transform, partition.entropy)
                    if xxh32(data, CHECK_SEED) != checksum:
                        raise ValueError("its checksum differs")
                except Exception as broken:  # any damage may break any coder
                    if self.fail_fast:
                        raise ValueError(f"block {block} of stream {stream} in {partition.path}: {broken}") from broken
                    data = None
                yield stream, block, data


class BlockWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.transform, self.entropy = options.get("transform", "BWT+MTF"), options.get("entropy", "HUFFMAN")
        pair(TRANSFORMS, self.transform), pair(ENTROPY, self.entropy)

    def write(self, rows: Iterator) -> Written:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        name = f"{at.rstrip('/')}/{{}}part-{uuid.uuid4().hex}{ENDING}"
        temporary, final = name.format("_"), name.format("")
        index, offset = [], 5
        with system.open_output_stream(temporary) as f:
            f.write(MAGIC + bytes([VERSION]))
            for row in rows:
                data = bytes(row.payload or b"")
                coded, _, used = encode_block(data, self.transform, self.entropy)
                f.write(coded)
                index.append([row.stream_id, row.block_id, offset, len(coded), len(data), used, xxh32(data, CHECK_SEED)])
                offset += len(coded)
            footer = json.dumps({"transform": self.transform, "entropy": self.entropy, "blocks": index}).encode()
            f.write(footer + len(footer).to_bytes(8, "big") + MAGIC)
        return Written(temporary, final)

    def commit(self, messages: list) -> None:
        system, _ = _open(self.path)
        if self.overwrite:
            for old in _files(self.path):
                system.delete_file(old)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class BlockFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)
