"""Token ids as Arrow files of equal-length sequences with masks.

Documents are put in order of their keys by a range shuffle; each range becomes one *part* of two Arrow IPC files. The
data file holds record batches with two fixed-size-list columns: ``ids`` and ``mask`` (1 where an id belongs to a
document, 0 where the last sequence is filled up). Nothing in it is compressed and every list has the same length, so
a reader maps the file and gets any sequence, or any run of ids, as a view of the mapped memory. The index file has
a row per document: key, place of its first id in the part, number of ids.

A task writes under a name of its own and reports it; a part is what the one successful task reported. A task that is
run again, or twice at once, leaves files that no manifest names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rowloom.llm.slices import slices
from rowloom.llm.tokens import coder
from rowloom.session import materialize, scratch_path

SEQUENCE = 2048
# Sequences of one record batch.
BATCH = 256
END_ID = 0

MANIFEST = "part int, path string, n_docs long, n_ids long, n_sequences long"


class SequenceWriter:
    """Fills sequences of fixed length from documents' ids and writes them batch by batch."""

    def __init__(self, sink, index_sink, key: pa.Field, dtype: np.dtype, length: int, batch: int):
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([key, ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.file = ipc.new_file(sink, self.schema)
        self.index = ipc.new_file(index_sink, self.index_schema)
        self.length = length
        self.room = np.zeros(length * batch, dtype)
        self.filled = self.n_ids = self.n_docs = self.n_sequences = 0

    def add(self, keys: pa.Array, documents: list[np.ndarray]) -> None:
        sizes = np.array([len(d) for d in documents], np.int64)
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([keys, pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        for ids in documents:
            at = 0
            while at < len(ids):
                n = min(len(ids) - at, len(self.room) - self.filled)
                self.room[self.filled : self.filled + n] = ids[at : at + n]
                self.filled += n
                at += n
                if self.filled == len(self.room):
                    self._flush()
        self.n_ids += int(sizes.sum())
        self.n_docs += len(documents)

    def _flush(self) -> None:
        rows = -(-self.filled // self.length)
        if not rows:
            return
        self.room[self.filled : rows * self.length] = 0
        mask = np.arange(rows * self.length) < self.filled
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
            for flat in (self.room[: rows * self.length].copy(), mask)
        ]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += rows
        self.filled = 0

    def close(self) -> None:
        self._flush()
        self.file.close()
        self.index.close()


@dataclass(frozen=True)
class SequenceFile:
    """A part's data file, opened for random access without copies."""

    reader: ipc.RecordBatchFileReader
    length: int
    per_batch: int

    @staticmethod
    def open(path: str) -> SequenceFile:
        system, inner = fs.FileSystem.from_uri(path)
        # Local and mounted files are mapped; other stores are read by range.
        source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
        reader = ipc.open_file(source)
        per_batch = reader.get_batch(0).num_rows if reader.num_record_batches else 1
        return SequenceFile(reader, reader.schema.field("ids").type.list_size, per_batch)

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a record batch as one view."""
        return self.reader.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of a sequence, both views of the file."""
        found = self.reader.get_batch(number // self.per_batch)
        at = number % self.per_batch
        ids = found.column(0).flatten().to_numpy(zero_copy_only=True)
        return ids[at * self.length : (at + 1) * self.length], found.column(1)[at].values

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + count`` of the part, as views, one per record batch they lie in."""
        size = self.length * self.per_batch
        while count > 0:
            at = start % size
            n = min(count, size - at)
            yield self.flat(start // size)[at : at + n]
            start += n
            count -= n


def write_sequences(
    df: DataFrame, key: str, text: str, vocabulary: str, folder: str, length: int = SEQUENCE, end_id: int = END_ID
) -> DataFrame:
    """Write every row's ids, each followed by ``end_id``, in ascending order of keys; the manifest comes back.

    ``folder`` is one that all executors share. Null and empty texts have the end id alone; null keys come first;
    rows with one key follow each other in the order of a hash of their texts. Parts are numbered in key order.
    """
    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = StructType.fromDDL(MANIFEST)
    ordered = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary)
        end = np.array([end_id], encode.dtype)
        number, writer = TaskContext.get().partitionId(), None
        path = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}"
        store, at = fs.FileSystem.from_uri(path)
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    sinks = [store.open_output_stream(f"{at}.{name}.arrow") for name in ("data", "index")]
                    writer = SequenceWriter(*sinks, pa.field("key", part.schema.field("key").type), encode.dtype, length, BATCH)
                writer.add(
                    part.column("key"),
                    [
                        np.concatenate([np.frombuffer(encode.encode(x), encode.dtype), end])
                        for x in part.column("text").to_pylist()
                    ],
                )
        if writer is not None:
            writer.close()
            for sink in sinks:
                sink.close()
            row = [number, path, writer.n_docs, writer.n_ids, writer.n_sequences]
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, to_arrow_schema(kind), strict=True)], schema=to_arrow_schema(kind))

    return materialize(ordered.mapInArrow(run, kind), "manifest")


def read_documents(manifest: DataFrame, key: str, key_type: str) -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files that a manifest names.

    Only the manifest, a row per part, passes through the driver, which adds up how many ids come before each part.
    """
    spark = manifest.sparkSession
    kind = StructType.fromDDL(f"{key} {key_type}, start long, n_tokens long, ids_crc32 long")
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], r["path"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(rows, "part int, path string, before long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                data = SequenceFile.open(f"{path}.data.arrow")
                system, inner = fs.FileSystem.from_uri(f"{path}.index.arrow")
                with system.open_input_file(inner) as source, ipc.open_file(source) as index:
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        checks = []
                        for start, count in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            check = 0
                            for view in data.ids(start, count):
                                check = zlib.crc32(view.astype("<u4").tobytes(), check)
                            checks.append(check)
                        starts = docs.column(1).to_numpy() + first
                        columns = [docs.column(0), pa.array(starts), docs.column(2), pa.array(checks, pa.int64())]
                        yield pa.record_batch(columns, schema=target)

    return files.mapInArrow(run, kind)


def encode_to_files(
    df: DataFrame, key: str, text: str, vocabulary: str, length: int = SEQUENCE, folder: str | None = None
) -> DataFrame:
    """Write the files, and return their documents as read back.

    In a given ``folder`` (one that all executors share) the files stay, and its subfolder ``manifest`` names them:
    :func:`read_documents` reads them again in any session. Without one they go into a new folder of the shared place
    and are deleted when the application ends.
    """
    manifest = write_sequences(df, key, text, vocabulary, folder or scratch_path(df.sparkSession, "sequences"), length)
    if folder:
        manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return read_documents(manifest, key, df.schema[key].dataType.simpleString())
