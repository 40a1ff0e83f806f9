"""Token ids of a corpus in flat binary files.

A data set is a folder of parts, in ascending doc_id order over parts and within them:

* ``part-00000.ids``: the ids of its documents, end to end, as little-endian unsigned integers of
  2 bytes where every id of the vocabulary fits, else of 4;
* ``part-00000.off``: little-endian signed 64-bit: the number n of documents, their n doc_ids, then
  n + 1 offsets, counted in ids from the start of the part.

The base of a part, the ids of all parts before it, is a prefix sum over the parts' totals. The driver
sees one row for each part: its number, documents and ids. Parts are written under a name of their own
and renamed, so a task that runs twice, or an executor that is lost, leaves one whole part.

Ids are those of the library's ``encode`` with ``add_special_tokens=False``: the string of a special token in
a text is that token. Texts that hold one are encoded whole, all others chunk by chunk.

Defined cases: a null text has no ids but the end id. Rows without doc_id come first and keep a null
doc_id. Rows of one doc_id stand side by side, ordered by text, and are dealt by the text's first HEAD
characters too, so that many of them are no one task's work. An empty table has no files. Texts are read
whole, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.base import caches, enter, new_path, spread
from tidewire.llm.bpe import Encoder, parted

#: Chunks that are encoded end to end.
JOINED = 8000
#: Memory of the ids that a worker keeps.
CACHE_BYTES = 400_000_000
#: Characters of a text by which rows of one doc_id are dealt.
HEAD = 32
#: A blank in the vocabulary's byte alphabet.
BLANK = "\u0120"
#: Stands in the files for a missing doc_id.
NO_ID = -(2**63)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> tuple[Callable[[Iterable[str | None]], Iterator[bytes]], int]:
    """An encoder of texts by the tokenizers library, and the bytes of an id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "<u2" if tokenizer.get_vocab_size() <= 2**16 else "<u4"

    blank = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        blank[i] = token.startswith(BLANK)

    def learn(chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        # chunks that start with their one blank are encoded end to end: each begins where a token has a blank
        joined = [c for c in chunks if c[0] == " " and not c.isspace()]
        rest = [c for c in chunks if c[0] != " " or c.isspace()]
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, kind)
            starts = np.flatnonzero(blank[ids])
            if len(starts) == len(some):
                ends, flat = (starts * ids.itemsize).tolist(), ids.tobytes()
                yield from zip(some, [flat[i:j] for i, j in zip(ends, [*ends[1:], None], strict=True)], strict=True)
            else:
                rest += some
        if rest:
            yield from zip(rest, [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)], strict=True)

    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    encoder = Encoder(learn, CACHE_BYTES)

    def encode(texts: Iterable[str | None]) -> Iterator[bytes]:
        texts = [t or "" for t in texts]
        whole = [any(s in t for s in special) for t in texts]
        plain = encoder(t for t, w in zip(texts, whole, strict=True) if not w)
        for t, w in zip(texts, whole, strict=True):
            yield np.array(tokenizer.encode(t, add_special_tokens=False).ids, kind).tobytes() if w else next(plain)

    return encode, int(kind[-1])


caches("token_files", library_encoder.cache_clear)


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path there."""
    if uri.startswith(("/", "file:")):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Write ``docs`` (doc_id, text); the folder, and (part, documents, ids) of every part that has any."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_files")
        part = TaskContext.get().partitionId()
        encode, width = library_encoder(tokenizer)
        end = end_id.to_bytes(width, "little")
        fs, at = open_folder(folder)
        own = f"{at}/.{uuid.uuid4().hex}"
        ids, sizes = [], []
        with fs.open_output_stream(f"{own}.ids") as out:
            for whole in batches:
                for batch in parted(whole, "text"):
                    ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy())
                    for found in encode(t.as_py() for t in batch.column("text")):
                        out.write(found)
                        out.write(end)
                        sizes.append(len(found) // width + 1)
        total = sum(sizes)
        if sizes:
            with fs.open_output_stream(f"{own}.off") as out:
                out.write(np.concatenate([[len(sizes)], *ids, [0], np.cumsum(sizes)]).astype("<i8").tobytes())
            for kind in ("ids", "off"):
                fs.move(f"{own}.{kind}", f"{at}/part-{part:05d}.{kind}")
        else:
            fs.delete_file(f"{own}.ids")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(sizes)], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(spread(rows), F.asc_nulls_first("doc_id"), F.left("text", F.lit(HEAD))).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    parts = dealt.mapInArrow(written, "part int, docs long, ids long").collect()
    return folder, sorted((p, d, n) for p, d, n in parts if d)


def read(spark, folder: str, parts: list[tuple[int, int, int]], width: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    bases = [0, *accumulate(n for _, _, n in parts)]
    table = spark.createDataFrame([(p, b) for (p, _, _), b in zip(parts, bases, strict=False)], "part int, base long").repartition(max(1, len(parts)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        for batch in batches:
            for part, base in zip(*(batch.column(k).to_pylist() for k in ("part", "base")), strict=True):
                raw = np.frombuffer(_mapped(fs, f"{at}/part-{part:05d}.off"), "<i8")
                n = int(raw[0])
                names, offsets = raw[1 : n + 1], raw[n + 1 :]
                ids = np.frombuffer(_mapped(fs, f"{at}/part-{part:05d}.ids"), f"<u{width}")
                sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                doc = pa.array(names, pa.int64(), mask=names == NO_ID)
                yield pa.RecordBatch.from_arrays([doc, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(found, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _mapped(fs: pa.fs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where the file system is local, else read."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` and read the files back."""
    folder, parts = write(docs, tokenizer, end_id)
    return read(docs.sparkSession, folder, parts, library_encoder(tokenizer)[1])
