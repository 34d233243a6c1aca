"""Token ids as flat binary files.

Each part holds ``<part>.bin`` (unsigned little-endian ids, one document after the
other), ``<part>.idx`` (n_docs + 1 offsets into it, int64) and ``<part>.doc`` (document
ids, int64; ``NULL_ID`` for null). Parts follow one another in ascending document id;
``index.json`` lists them with their base, the number of ids before the part: a prefix
sum over the parts' totals.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, shared_dir, table
from .encoders import batch_encoder

NULL_ID = -(2**63)
BLOCK_DOCS = 1000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, content: list[bytes]) -> None:
    """Write a file under a name of this attempt's own, then move it: a repeated task replaces it by the same bytes."""
    fs, path = _open(uri)
    task = TaskContext.get()
    tmp = f"{path}/_tmp-{task.taskAttemptId()}-{name}"
    with fs.open_output_stream(tmp) as out:
        for piece in content:
            out.write(piece)
    fs.move(tmp, f"{path}/{name}")


def _in_parts(docs: DataFrame, n_parts: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text in ``n_parts`` partitions of ascending ids, sorted. Only the ids are read to find the splitters.

    Rows of an id that many splitters fall on are dealt over the partitions between these.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long"))
    shares = [(k + 1) / n_parts for k in range(n_parts - 1)]
    cuts = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * n_parts)).alias("cuts")).first().cuts if shares else None
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    if cuts:
        listed = F.array(*[F.lit(c).cast("long") for c in cuts])
        low = F.size(F.filter(listed, lambda c: c < F.col("doc_id")))
        high = F.size(F.filter(listed, lambda c: c <= F.col("doc_id")))
        rows = rows.withColumn("part", (low + F.pmod(F.xxhash64("row"), high - low + 1)).cast("int"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    return rows.repartitionById(n_parts, "part").sortWithinPartitions("doc_id", "row").select("doc_id", "text")


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, dtype: str = "<u2",
                      id_col: str = "doc_id", text_col: str = "text", n_parts: int | None = None) -> dict:
    """Encode every text, append ``end_id`` and write all ids in ascending document id. Returns the index.

    ``dtype`` is ``<u2`` or ``<u4``; ``n_parts`` the number of files, that of the session's
    shuffle partitions if not given. Null texts are empty and give the end id alone. Null
    ids come first; rows with equal ids lie side by side. Other columns are not read. An
    empty table gives an index without parts. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    fs, local = _open(path)
    fs.create_dir(local, recursive=True)
    ranged = _in_parts(docs, n_parts or int(spark.conf.get("spark.sql.shuffle.partitions")), id_col, text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer_path, dtype)
        part = f"part-{TaskContext.get().partitionId():06d}"
        fs, local = _open(path)
        task = TaskContext.get().taskAttemptId()
        total, sizes, ids, tmp = 0, [], [], f"{local}/_tmp-{task}-{part}.bin"
        with fs.open_output_stream(tmp) as out:
            for batch in batches:
                for portion in portions(batch, 8_000_000):
                    found, n = encode(portion.column("text"))
                    size = n + 1
                    content = np.empty(len(found) + len(n), dtype)
                    own = np.ones(len(content), bool)
                    own[np.cumsum(size) - 1] = False
                    content[own], content[~own] = found, end_id
                    out.write(content.tobytes())
                    sizes.append(size)
                    ids.append(portion.column("doc_id").to_numpy())
        if sizes:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            total = int(offsets[-1])
            fs.move(tmp, f"{local}/{part}.bin")
            _put(path, f"{part}.idx", [offsets.astype("<i8").tobytes()])
            _put(path, f"{part}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(offsets) - 1], "n_tokens": [total]})
        else:
            fs.delete_file(tmp)

    # one row per part reaches the driver
    parts = sorted(tuple(r) for r in ranged.mapInArrow(write, "part string, n_docs bigint, n_tokens bigint").collect())
    bases = np.concatenate([[0], np.cumsum([n for _, _, n in parts], dtype=np.int64)]).tolist()
    index = {"dtype": dtype, "end_id": end_id, "parts": [{"part": p, "n_docs": d, "n_tokens": n, "base": b} for (p, d, n), b in zip(parts, bases, strict=False)]}
    with fs.open_output_stream(f"{local}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


class _File:
    """Numbers of a file by their position: mapped where the file is local, read by ranges elsewhere."""

    def __init__(self, uri: str, name: str, dtype: str):
        fs, path = _open(uri)
        self.dtype = np.dtype(dtype)
        self.mapped = np.memmap(f"{path}/{name}", dtype, "r") if isinstance(fs, pafs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else fs.open_input_file(f"{path}/{name}")

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[at]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * width, at.start * width), self.dtype)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (over the ids as ``<u4``) and, if asked for, ids.

    Files are memory-mapped where they are local and read by ranges elsewhere, so that at
    most a few documents' ids are held at a time. Null ids come back as null; an index
    without parts gives an empty result.
    """
    fs, local = _open(path)
    with fs.open_input_stream(f"{local}/index.json") as f:
        index = json.loads(f.read())
    dtype, parts = index["dtype"], index["parts"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p["part"], p["n_docs"], p["base"]) for p in parts], "part string, n_docs bigint, base bigint").repartition(min(len(parts), 10_000), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n_docs, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offsets, docs = (_File(path, f"{part}.{x}", t) for x, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for at in range(0, n_docs, BLOCK_DOCS):
                    stop = min(n_docs, at + BLOCK_DOCS)
                    ends, own = offsets[at : stop + 1], docs[at:stop]
                    for a, b in _blocks(ends):
                        block = memoryview(ids[int(ends[a]) : int(ends[b])].astype("<u4"))
                        each = [block[int(x - ends[a]) : int(y - ends[a])] for x, y in zip(ends[a:b], ends[a + 1 : b + 1], strict=True)]
                        out = {
                            "doc_id": pa.array(own[a:b], pa.int64(), mask=own[a:b] == NULL_ID),
                            "start": pa.array(base + ends[a:b], pa.int64()),
                            "n_tokens": pa.array(np.diff(ends[a : b + 1]), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([x.tolist() for x in each], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(out)

    return listed.mapInArrow(read, schema)


def _blocks(ends: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most so many ids together, a document at least."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_token_files(spark, path)
