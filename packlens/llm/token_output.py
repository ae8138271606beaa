"""Token ids as files: each document compressed on its own with one shared zstandard dictionary.

The dictionary is trained on the serialized id arrays of a bounded sample: at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_BYTES`` bytes of text, drawn by hash. Documents are range-partitioned and sorted by doc_id; each partition is
one file, written under a name of its attempt and then renamed, so that a task may run again.

File: magic, SHA-256 of the dictionary, one zstandard frame for each document (little-endian ids of 2 or 4 bytes), an
index row (doc_id, null flag, frame's offset, frame's length, ids, ids before it in the file) for each document, and a
footer (offset of the index, documents, ids, bytes an id, magic). A reader takes one document from its index row. The folder also has
``dictionary`` and ``manifest.json`` (files in order with their counts).

Defined results: a null text has only the end id; null doc_ids come first; rows with equal doc_ids follow one another
in the order of a hash of their text; an empty table gives a folder without documents. Only doc_id and text are written.

The folder must be one that ``pyarrow.fs`` opens on the driver and on every executor (a shared file system, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text
from .tokens import encoder, id_width

MAGIC = b"PLTOKEN1"
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 65_536
#: Bytes of text that a file, and so a task, has on average.
FILE_BYTES = 256 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("size", "<u4"), ("offset", "<u8"), ("ids", "<u8"), ("before", "<u8")])
FOOTER = "<QQQQ8s"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith(("file:", "/")) else (pyarrow.fs.LocalFileSystem(), uri)


def _packed(ids: bytes, end: int | None, width: str) -> bytes:
    array = np.frombuffer(ids, "<u4")
    return (array if end is None else np.append(array, end)).astype(width).tobytes()


def train(docs: DataFrame, tokenizer: str, end: int, width: str, n: int) -> bytes:
    """The dictionary; empty if the sample is too small to train one. ``n``: rows of ``docs``."""
    n = max(n, 1)
    text = whole_text()
    sample = (
        docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
        .where((F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod("h", F.lit(n)) < 2 * SAMPLE_DOCS))
        .orderBy("h", "doc_id")
        .limit(SAMPLE_DOCS)
    )

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_packed(x, end, width) for x in code.batches(batch.column("text").to_pylist())], pa.binary())], ["ids"]
            )

    samples = sorted(bytes(r[0]) for r in sample.mapInArrow(ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, tokenizer: str, path: str, end: int, files: int | None = None, width: str | None = None) -> list[dict]:
    """Writes the folder ``path`` and returns its manifest.

    ``files``: by default as many as the session's shuffle partitions, or more so that none has more than ``FILE_BYTES`` of
    text on average. ``width``: of the ids, by default from the tokenizer's vocabulary.
    """
    spark = docs.sparkSession
    width = width or id_width(tokenizer, end)
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(whole_text()))).first()
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // FILE_BYTES))
    dictionary = train(docs, tokenizer, end, width, n)
    shared = spark.sparkContext.broadcast(dictionary)
    hashed = hashlib.sha256(dictionary).digest()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = _open(path)
        code, index, at, total = encoder(tokenizer), bytearray(), len(MAGIC) + 32, 0
        zdict = _zdict(shared.value)
        press = zstandard.ZstdCompressor(level=3, dict_data=zdict) if zdict else zstandard.ZstdCompressor(level=3)
        temporary = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            out.write(MAGIC + hashed)
            for batch in batches:
                made, rows = code.batches(batch.column("text").to_pylist()), []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), made, strict=True):
                    ids = _packed(ids, end, width)
                    frame = press.compress(ids)
                    n = len(ids) // int(width[-1])
                    rows.append((doc or 0, doc is None, len(frame), at, n, total))
                    out.write(frame)
                    at, total = at + len(frame), total + n
                index += np.array(rows, INDEX).tobytes()
            many = len(index) // INDEX.itemsize
            out.write(index)
            out.write(struct.pack(FOOTER, at, many, total, int(width[-1]), MAGIC))
        final = f"{root}/part-{part:06d}.ids"
        fs.move(temporary, final)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [many], "ids": [total]}, schema=pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    text = whole_text()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = ordered.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    done = sorted(ordered.select("doc_id", "text").mapInArrow(put, "part bigint, docs bigint, ids bigint").collect())
    starts = accumulate((r["ids"] for r in done), initial=0)
    manifest = [{"file": f"part-{r['part']:06d}.ids", "docs": r["docs"], "ids": r["ids"], "start": s} for r, s in zip(done, starts, strict=False)]
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dictionary": hashed.hex(), "files": manifest}).encode())
    return manifest


class IdFile:
    """Random access to one file of a folder."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, dictionary: bytes) -> None:
        self.source = fs.open_input_file(path)
        size = self.source.size()
        at, n, self.ids, width, magic = struct.unpack(FOOTER, self.source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        head = self.source.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token file")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.width = f"<u{width}"
        self.index = np.frombuffer(self.source.read_at(n * INDEX.itemsize, at), INDEX)
        zdict = _zdict(dictionary)
        self.press = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()

    def document(self, row: int) -> np.ndarray:
        x = self.index[row]
        frame = self.source.read_at(int(x["size"]), int(x["offset"]))
        return np.frombuffer(self.press.decompress(frame), self.width)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of a folder."""
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/manifest.json") as source:
        files = json.loads(source.read())["files"]
    names = spark.createDataFrame([(n, f["file"], f["start"]) for n, f in enumerate(files)], "n int, file string, start bigint")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        with fs.open_input_stream(f"{root}/dictionary") as source:
            dictionary = source.read()
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = IdFile(fs, f"{root}/{name}", dictionary)
                for at in range(0, len(file.index), 256):
                    part = file.index[at : at + 256]
                    ids = [file.document(at + k).astype("<u4").tobytes() for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["doc_id"], pa.int64(), mask=part["null"].astype(bool)),
                            pa.array(part["before"].astype(np.int64) + start),
                            pa.array(part["ids"].astype(np.int64)),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    # one file a task: a file is as large as its writer's partition
    return names.repartitionById(max(len(files), 1), "n").mapInArrow(get, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
