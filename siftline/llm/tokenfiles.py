"""Token ids in binary files, as a Spark data source.

A shard holds the ids of consecutive documents one behind the other, then the
ends of the documents and their doc_ids as Elias-Fano lists.  ``write_tokens``
sorts by id over range partitions; each task streams its rows into shards of
its own, and only shards named in the manifest, which the driver writes when
all tasks are done, belong to the table, so repeated or lost attempts leave no
trace in it.  Reading splits a shard at any number of ids: a reader finds its
documents by searching the list of ends.

Layout of a shard, little-endian: ids of ``width`` bytes, list of ends, list of
doc_ids less the first one, and a tail of six 64-bit numbers and the magic.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siftline.llm.chunks import byte_pairs
from siftline.llm.eliasfano import EliasFano, encoded
from siftline.llm.tables import whole

FORMAT = "token_ids"
MANIFEST = "_manifest.json"
#: A task starts a new shard beyond so many ids; the manifest has one entry for each.
SHARD_IDS = 1 << 27
#: Documents of a shard at most, which bounds the ends a task keeps.
SHARD_DOCS = 1 << 22
#: Ids that one read task, and one Arrow batch, covers.
READ_IDS = 1 << 23
BATCH_IDS = 1 << 20
_MAGIC = b"TOKIDEF1"
#: documents, null doc_ids, first doc_id, width, bytes of ends, bytes of doc_ids
_TAIL = struct.Struct("<QQqQQQ8s")


def _store(path: str):
    """File system and path of a URI or a local name."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Streams documents to one file."""

    def __init__(self, store, path: str, width: int):
        self.out, self.width, self.total = store.open_output_stream(path), width, 0
        self.ends: list[int] = []
        self.docs: list[int] = []
        self.nulls = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None and not self.docs:
            self.nulls += 1
        elif doc_id is None or (self.docs and doc_id < self.docs[-1]):
            raise ValueError("rows must be in ascending order of doc_id, missing ones first")
        else:
            self.docs.append(doc_id)
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.ends.append(self.total)

    def close(self) -> None:
        first = self.docs[0] if self.docs else 0
        ends, docs = encoded(self.ends), encoded([d - first for d in self.docs])
        self.out.write(ends + docs + _TAIL.pack(len(self.ends), self.nulls, first, self.width, len(ends), len(docs), _MAGIC))
        self.out.close()


class Shard:
    """Random access to the documents of one file."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TAIL.size, size - _TAIL.size)
        self.n, self.nulls, self.first, self.width, ends, docs, magic = _TAIL.unpack(tail)
        if magic != _MAGIC:
            raise ValueError(f"not a token file: {path}")
        at = size - _TAIL.size - ends - docs
        self.ends = EliasFano(self.file.read_at(ends, at))
        self.docs = EliasFano(self.file.read_at(docs, at + ends))

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids at the places first .. last - 1 of the shard."""
        data = self.file.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.start(i), self.ends.select(i))

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        missing = min(max(self.nulls - first, 0), last - first)
        found = self.docs.values(first + missing - self.nulls, last - self.nulls) if first + missing < last else []
        return [None] * missing + [self.first + int(d) for d in found]

    def starting_in(self, first: int, last: int) -> tuple[int, int]:
        """The documents whose first id lies in [first, last): from, to (exclusive)."""
        begin = lambda x: self.ends.below(x) + 1 if x > 0 else 0  # noqa: E731  document i begins where document i - 1 ends
        return min(begin(first), self.n), min(begin(last), self.n)


@dataclass
class Written(WriterCommitMessage):
    shards: list  # (task, number, name, documents, ids)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, shard_ids: int, overwrite: bool):
        self.path, self.width, self.shard_ids, self.overwrite = path.rstrip("/"), width, shard_ids, overwrite

    def write(self, iterator) -> Written:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        task, attempt, shards, shard = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None

        def close():
            shard.close()
            shards[-1] += (len(shard.ends), shard.total)

        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                if shard is None or shard.total >= self.shard_ids or len(shard.ends) >= SHARD_DOCS:
                    if shard:
                        close()
                    name = f"part-{task:06d}-{len(shards):05d}-{attempt}.ids"
                    shards.append((task, len(shards), name))
                    shard = ShardWriter(store, f"{base}/{name}", self.width)
                shard.add(doc_id, ids.as_buffer())
        if shard:
            close()
        return Written(shards)

    def commit(self, messages) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        old = []
        if store.get_file_info(f"{base}/{MANIFEST}").type.name == "File":
            if not self.overwrite:
                raise FileExistsError(f"{self.path} holds a table of token ids")
            with store.open_input_stream(f"{base}/{MANIFEST}") as f:
                old = [name for name, *_ in json.loads(f.read())["shards"]]
        shards = sorted(shard for m in messages if m for shard in m.shards)
        with store.open_output_stream(f"{base}/{MANIFEST}.new") as f:
            f.write(json.dumps({"width": self.width, "shards": [shard[2:] for shard in shards]}).encode())
        store.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")
        for name in old:
            store.delete_file(f"{base}/{name}")

    def abort(self, messages) -> None:
        store, base = _store(self.path)
        for m in messages:
            for shard in m.shards if m else []:
                store.delete_file(f"{base}/{shard[2]}")


@dataclass
class _Range(InputPartition):
    """Documents of a shard whose first id lies in [first, last); ``before`` ids stand in earlier shards."""

    name: str
    first: int
    last: int
    before: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self):
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        out, before = [], 0
        for name, _, ids in shards:
            out += [_Range(name, a, min(a + READ_IDS, ids), before) for a in range(0, ids, READ_IDS)]
            before += ids
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range):
        import pyarrow as pa

        if not part.name:
            return
        store, base = _store(self.path)
        shard = Shard(store, f"{base}/{part.name}")
        at, end = shard.starting_in(part.first, part.last)
        while at < end:
            start = shard.start(at)
            upto = max(at + 1, min(end, shard.ends.below(start + BATCH_IDS), at + 100_000))
            ends = shard.ends.values(at, upto).astype(np.int64)
            starts = np.append(start, ends[:-1])
            ids = shard.ids(start, int(ends[-1])).astype("<u4")
            cuts = pa.py_buffer((4 * (np.append(start, ends) - start)).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids(at, upto), pa.int64()), pa.array(starts + part.before), pa.array(ends - starts),
                    pa.Array.from_buffers(pa.large_binary(), upto - at, [None, cuts, pa.py_buffer(ids)]).cast(pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            at = upto


class TokenSource(DataSource):
    """``spark.read.format("token_ids").load(path)``: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if names != [("doc_id", "bigint"), ("ids", "binary")]:
            raise ValueError(f"columns must be doc_id long, ids binary; not {names}")
        return _Writer(self.options["path"], int(self.options.get("width", 4)), int(self.options.get("shardIds", SHARD_IDS)), overwrite)


def _encode(json_path: str, ranks_path: str, pattern: str, end_id: int, width: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_pairs(json_path, ranks_path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [np.frombuffer(table.encode(text) + end, "<u4").astype(f"<u{width}").tobytes() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return encode


def write_tokens(
    df: DataFrame, path: str, json_path: str, ranks_path: str, pattern: str, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS,
) -> None:
    """Ids of every text and the end id behind it, in ascending order of an integer id.

    A null or empty text is the end id alone.  Rows without an id come first;
    rows that share an id stand in the order of a hash of their texts.
    An empty table gives an empty table of tokens; other columns are ignored.
    """
    spark = df.sparkSession
    spark.dataSource.register(TokenSource)
    width = 2 if max(end_id, byte_pairs(json_path, ranks_path, pattern).tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)  # before the ids exist: texts pack better than ids
    (
        ordered.mapInPandas(_encode(json_path, ranks_path, pattern, end_id, width), "doc_id long, ids binary")
        .write.format(FORMAT).option("width", width).option("shardIds", shard_ids).mode("append").save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids."""
    spark.dataSource.register(TokenSource)
    return spark.read.format(FORMAT).load(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
