"""Token ids in flat binary files.

Format, one set of files per range of document ids (``part-00007``):

* ``.bin``: all ids of the part, flat little-endian unsigned integers, 16 bits where the vocabulary
  allows, else 32;
* ``.off``: documents + 1 offsets into ``.bin``, in ids, flat little-endian 64-bit integers;
* ``.docs``: the documents' ids, an Arrow file.

Parts hold ascending ranges of ids, each sorted; the place of a part in the whole corpus is the prefix
sum of the parts before it, so files never have to be rewritten. Files are written under a name of
the attempt and then renamed, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.byte_ids import END_ID, byte_ids, model_path
from brindle.llm.shared import bounded_batches, fresh_folder, table, written

MANIFEST = "part int, dtype string, n_docs bigint, n_ids bigint"


def write_token_files(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Writes the ids of every whole text, each with the end id after it, in ascending order of ``key``.

    Returns the manifest, one row per part, with ``base``: the ids of all parts before it. One shuffle
    of key and text by ranges of the key; a task streams its range in order and holds one batch.
    Null and empty texts: the end id alone. Very long texts: whole. Null keys come first. Rows of equal keys: by text. Other
    columns are ignored. An empty table: no part.
    """
    path = model or model_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_ids(path)
        dtype = "<u2" if encoder.size <= 1 << 16 else "<u4"
        end = np.array([END_ID], dtype).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, tmp = f"{root}/part-{part:05d}", f"{root}/_{part:05d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out, off = fs.open_output_stream(f"{tmp}.bin"), fs.open_output_stream(f"{tmp}.off")
                off.write(np.zeros(1, "<i8").tobytes())
                sink = fs.open_output_stream(f"{tmp}.docs")
                docs = pa.ipc.new_file(sink, pa.schema([batch.schema.field(0)]))
            ends = np.empty(batch.num_rows, "<i8")
            for i, t in enumerate(batch.column(1)):
                ids = np.frombuffer(encoder.encode(t.as_py()), "<u4").astype(dtype).tobytes() + end
                out.write(ids)
                n_ids += len(ids) // len(end)
                ends[i] = n_ids
            off.write(ends.tobytes())
            docs.write_batch(pa.record_batch([batch.column(0)], schema=docs_schema(batch)))
            n_docs += batch.num_rows
        if out is not None:
            docs.close()
            for f in (sink, off, out):
                f.close()
            for kind in ("docs", "off", "bin"):
                fs.move(f"{tmp}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "dtype": [dtype], "n_docs": [n_docs], "n_ids": [n_ids]},
                pa.schema([("part", pa.int32()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    ordered = (
        bounded_batches(df).select(F.col(key), F.col(text))
        .repartitionByRange(F.col(key).asc_nulls_first())
        .sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    )
    parts = written(ordered.mapInArrow(write, MANIFEST), "token-parts")
    # one row per part: the only window without a key, over the parts alone
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("bigint")))


def docs_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([batch.schema.field(0)])


def read_token_files(manifest: DataFrame, folder: str, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """Per document, from the files: its id, named ``key``, start (ids of all documents before it), n_tokens, ids_crc32
    (over the ids as little-endian unsigned 32-bit integers). Files are memory-mapped where local."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)

        def flat(name: str, dtype: str) -> np.ndarray:
            if isinstance(fs, pafs.LocalFileSystem):
                return np.memmap(name, dtype, mode="r")
            with fs.open_input_file(name) as f:
                return np.frombuffer(f.read_buffer(), dtype)

        for row in (r for b in batches for r in b.to_pylist()):
            name = f"{root}/part-{row['part']:05d}"
            ids, off = flat(f"{name}.bin", row["dtype"]), flat(f"{name}.off", "<i8")
            at = 0
            with fs.open_input_file(f"{name}.docs") as f:
                docs = pa.ipc.open_file(f)
                for i in range(docs.num_record_batches):
                    keys = docs.get_batch(i).column(0)
                    cut = off[at : at + len(keys) + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        [key, "start", "n_tokens", "ids_crc32"],
                    )
                    at += len(keys)

    spread = manifest.repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents``, written and read back."""
    folder = fresh_folder(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder)
