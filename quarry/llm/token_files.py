"""Token-ID output: Arrow files of equal-length sequences and masks, with zero-copy random access.

Documents are range-partitioned and sorted by doc_id.  Each task writes one
shard: an Arrow IPC file (the stream format with a footer of batch places)
whose batches hold two fixed-size lists, ``ids`` and ``mask``, of
``SEQUENCE`` entries a row.  The ids of all documents of a shard run through
its rows; the last row is padded, with mask 0.  A second small Arrow file holds
each document's id and length.  Rows sit at fixed places in a memory-mapped
file, so any sequence is read without copying or scanning (``Shard``).

A task writes to a name of its own attempt and returns it; only names that
succeeded reach the manifest, so a repeated task or a lost executor leaves no
shard twice.

Defined cases: null texts count as empty and have the end id alone; an empty
table writes no shard; rows that share a doc_id follow each other by the hash
of their text; rows without an id and other
columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, partitions, shared_path, stage
from .encode import encoder

SEQUENCE = 1024
BATCH_ROWS = 1024


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI (the shared folder of the cluster)."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ShardWriter:
    """Collects ids and writes full batches; memory is one batch."""

    def __init__(self, out, dtype: np.dtype, sequence: int):
        self.sequence, self.held, self.parts, self.dtype = sequence, 0, [], dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = ipc.new_file(out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.sequence * BATCH_ROWS:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.parts])
        full = len(ids) if last else len(ids) // (self.sequence * BATCH_ROWS) * self.sequence * BATCH_ROWS
        self.parts, self.held = [ids[full:]], len(ids) - full
        padded = -(-full // self.sequence) * self.sequence
        flat, mask = np.zeros(padded, self.dtype), np.zeros(padded, bool)
        flat[:full], mask[:full] = ids[:full], True
        step = self.sequence * BATCH_ROWS
        for a in range(0, padded, step):
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x[a:a + step]), self.sequence) for x in (flat, mask)], schema=self.schema))

    def close(self) -> None:
        self._write(last=True)
        self.writer.close()


class Shard:
    """Random access to the sequences of one file; arrays are views of the mapped file."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{path}/{name}") if local else system.open_input_file(f"{path}/{name}")
        self.reader = ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids as a view of the file; the mask's bits, eight entries a byte, as a view too (``unpack`` spreads them)."""
        b = self.reader.get_batch(i)
        bits = np.frombuffer(b.column(1).values.buffers()[1], np.uint8)
        return b.column(0).values.to_numpy(zero_copy_only=True).reshape(-1, self.sequence), bits

    def unpack(self, bits: np.ndarray, rows: int) -> np.ndarray:
        return np.unpackbits(bits, count=rows * self.sequence, bitorder="little").reshape(rows, self.sequence).astype(bool)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; all batches but the last hold BATCH_ROWS."""
        ids, bits = self.batch(i // BATCH_ROWS)
        return ids[i % BATCH_ROWS], self.unpack(bits, len(ids))[i % BATCH_ROWS]

    def tokens(self) -> Iterator[np.ndarray]:
        """All ids without padding, batch by batch."""
        for i in range(self.reader.num_record_batches):
            ids, bits = self.batch(i)
            yield ids.reshape(-1)[: int(self.unpack(bits, len(ids)).sum())]


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Write the shards; returns the manifest: shard, name, n_docs, n_tokens and start (ids in the shards before)."""
    spark = docs.sparkSession
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    rows = documents(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, out, name, shard, lengths, doc_ids = encoder(path), None, "", 0, [], []
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                part = pdf.iloc[a:a + 1000]
                if out is None:
                    system, root = open_folder(folder)
                    shard = int(part["shard"].iloc[0])
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(f"{root}/{name}.arrow")
                    out = ShardWriter(stream, enc.dtype, sequence)
                for ids in enc.batch(part["text"].tolist()):
                    out.add(np.append(ids, enc.dtype.type(end_id)))
                    lengths.append(len(ids) + 1)
                doc_ids.append(part["doc_id"].to_numpy(np.int64))
        if out is None:
            return
        out.close()
        stream.close()
        index = pa.table({"doc_id": np.concatenate(doc_ids), "n_tokens": np.array(lengths, dtype=np.int64)})
        with system.open_output_stream(f"{root}/{name}.docs.arrow") as f, ipc.new_file(f, index.schema) as w:
            w.write_table(index, max_chunksize=1 << 16)
        yield pd.DataFrame({"shard": [shard], "name": [name], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)]})

    manifest = stage(rows.mapInPandas(write, "shard int, name string, n_docs long, n_tokens long"), "token-manifest")
    # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stage(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_folder(folder)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with system.open_input_file(f"{root}/{row.name}.docs.arrow") as f:
                    index = ipc.open_file(f).read_all()
                lengths = index["n_tokens"].to_numpy()
                ends = np.cumsum(lengths)
                # cut each batch where documents end; a checksum goes on over the batches that a document spans
                crcs, crc, at, doc = np.zeros(len(ends), np.int64), 0, 0, 0
                for ids in Shard(folder, f"{row.name}.arrow").tokens():
                    wide = ids.astype("<u4").tobytes()
                    a, stop = at, at + len(ids)
                    while doc < len(ends) and ends[doc] <= stop:
                        crcs[doc] = zlib.crc32(wide[4 * (a - at):4 * (int(ends[doc]) - at)], crc)
                        a, crc, doc = int(ends[doc]), 0, doc + 1
                    crc = zlib.crc32(wide[4 * (a - at):], crc)
                    at = stop
                yield pd.DataFrame({"doc_id": index["doc_id"].to_numpy(), "start": row.start + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Write the documents' ids as files in the shared folder and read them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end_id, sequence), folder)
