"""Token ids in Arrow files: batches of fixed-size lists, read at any place without copying or decoding."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, free_name
from hazardlake.session import shared_folder

END_ID, SEQUENCE, BATCH_SEQUENCES = 1, 2048, 512
CACHED_WORDS, LONGEST_CACHED = 600_000, 64


# --- ids

def vocabulary() -> str:
    """The tokenizer file; looked up on the executor that runs."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# The tokenizer file's pattern, spelt out for the lower-case letters and the numbers below U+0180.
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t\n\r\x20{_LETTERS}{_NUMBERS}]+"
# A part with any other character, or with what might be a special token, goes through the library as it is.
_OTHER = "[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017f]|<\\|"


class WordEncoder:
    """Ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, computed once for each new word.

    Printable characters below U+0180 are in composed form and have lower case one by one, so texts of them are cut here
    by the tokenizer's own pattern, and each new cut goes to its merging model.  Other texts are first cut at ASCII white
    space: the tokenizer drops it and never joins what stands on its two sides (its pattern has no match across it, and
    neither composition nor lower-casing reaches over it); parts with other characters go through the whole library call.
    The ids of short cuts are kept, in a bounded number.
    """

    def __init__(self, path: str, kind: str):
        import re

        from tokenizers import Tokenizer
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        # fixed values: byte-level characters (visible bytes stand for themselves)
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        characters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}
        model, number = self.tokenizer.model, [np.array(k, kind).tobytes() for k in range(self.tokenizer.get_vocab_size())]

        class Cuts(dict):
            def __missing__(self, piece: str) -> bytes:
                plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(characters)
                found = b"".join([number[t.id] for t in model.tokenize(plain)])
                if len(piece) <= LONGEST_CACHED:
                    self[piece] = found
                return found

        self.cuts, self.cut, self.other = Cuts(), re.compile(_PATTERN).findall, re.compile(_OTHER).search

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cuts.__getitem__, self.cut(text.lower())))

    def ids(self, data: bytes | None) -> bytes:
        """The ids of UTF-8 bytes, as little-endian numbers."""
        if len(self.cuts) > CACHED_WORDS:
            self.cuts.clear()
        text = (data or b"").decode()
        if not self.other(text):
            return self._plain(text)
        parts = [p.decode() for p in (data or b"").split()]  # of bytes: at exactly the six ASCII characters
        odd = list({p for p in parts if self.other(p)})
        encoded = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        found = {p: np.array(e.ids, self.kind).tobytes() for p, e in zip(odd, encoded, strict=True)}
        return b"".join([found[p] if p in found else self._plain(p) for p in parts])


def word_encoder(path: str, kind: str) -> WordEncoder:
    """The process's encoder: Spark gives a worker process one task after another, and later ones find the words of earlier ones."""
    import tokenizers
    kept = vars(tokenizers).setdefault("_word_encoders", {})  # task functions bring their own copy of this module each time
    if (path, kind) not in kept:
        kept[path, kind] = WordEncoder(path, kind)
    return kept[path, kind]


# --- files

def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes a run of ids as one Arrow file: ``ids`` and ``mask`` (a bit, set for an id and not for padding) of a fixed size for each sequence.

    Every batch but the last has the same number of sequences, so the place of an id gives batch, row and column.  Nothing
    is compressed: a memory map is the array.  A batch is written when it is full; no more than that waits in memory.
    """

    def __init__(self, uri: str, kind: str, sequence: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES):
        system, path = _open(uri)
        self.kind, self.sequence, self.room = np.dtype(kind), sequence, sequence * batch_sequences
        own = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(own, sequence)), ("mask", pa.list_(pa.bool_(), sequence))],
                                metadata={"sequence": str(sequence), "batch_sequences": str(batch_sequences)})
        self.sink = system.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting = bytearray()
        self.written = 0

    def add(self, ids: bytes) -> int:
        """Append ids; returns the place of the first."""
        place = self.written + len(self.waiting) // self.kind.itemsize
        self.waiting += ids
        full = self.room * self.kind.itemsize
        while len(self.waiting) >= full:
            self._batch(bytes(self.waiting[:full]))
            del self.waiting[:full]
        return place

    def _batch(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.kind)
        self.written += len(ids)
        padding = -len(ids) % self.sequence
        mask = np.arange(len(ids) + padding) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence) for values in (np.pad(ids, (0, padding)), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._batch(bytes(self.waiting))
        self.file.close()
        self.sink.close()


class SequenceFile:
    """Random access to one file.  A local file is memory-mapped: arrays are views of it.  Elsewhere a batch is fetched when it is used."""

    def __init__(self, uri: str):
        from pyarrow import fs
        system, path = _open(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        described = self.file.schema.metadata
        self.sequence, self.batch_sequences = int(described[b"sequence"]), int(described[b"batch_sequences"])
        self._held: tuple = (-1, np.zeros(0), pa.array([], pa.bool_()), 0)

    def __len__(self) -> int:
        """Number of sequences."""
        n = self.file.num_record_batches
        return (n - 1) * self.batch_sequences + self.file.get_batch(n - 1).num_rows if n else 0

    def _batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray, int]:
        """Ids and masks of a batch as views, and how many ids it holds."""
        if self._held[0] != k:
            ids, mask = (c.flatten() for c in self.file.get_batch(k).columns)
            self._held = (k, ids.to_numpy(zero_copy_only=True), mask, mask.true_count)
        return self._held[1:]

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, row = divmod(k, self.batch_sequences)
        ids, mask, _ = self._batch(batch)
        return ids[row * self.sequence:(row + 1) * self.sequence], mask.slice(row * self.sequence, self.sequence)

    def pieces(self, start: int, length: int) -> Iterator[np.ndarray]:
        """Views of the ids in a range, one for each batch it touches; fewer ids if the range reaches into padding."""
        room = self.sequence * self.batch_sequences
        while length > 0 and start // room < self.file.num_record_batches:
            ids, _, n = self._batch(start // room)
            view = ids[start % room:min(start % room + length, n)]
            if not len(view):
                return
            yield view
            start, length = start + len(view), length - len(view)

    def close(self) -> None:
        self._held = (-1, np.zeros(0), pa.array([], pa.bool_()), 0)
        self.source.close()


# --- over the table

@dataclass(frozen=True)
class TokenFolder:
    """A written folder: ``sequences/*.arrow``, named in order, and ``documents``, a Parquet table of
    ``(doc_id, part, file, position, n_tokens)`` that says where in which file a document's ids are.

    Files of tasks that failed or were repeated may lie beside the others; only what ``documents`` names belongs to the result.
    """

    folder: str
    schema: T.StructType

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/documents")


def write_sequences(docs: DataFrame, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES, kind: str = "<u2") -> TokenFolder:
    """Write the ids of ``docs(doc_id, text)``, an end id behind each document, by ascending ``doc_id`` (nulls first).

    Documents are range-partitioned by id, equal ids by their place in the source, so that no id fills a task; every
    task writes one file.  Only the last sequence of a file is padded.  ``kind`` must hold all ids of the vocabulary.
    """
    bounded_batches(docs.sparkSession)
    taken = ["doc_id", "bytes"]
    tie = free_name(taken, "tie")
    plain = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias(tie))
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).drop(tie)
    schema = T.StructType([field(docs, "doc_id"), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()),
                           T.StructField("position", T.LongType()), T.StructField("n_tokens", T.LongType())])
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:06d}-{context.taskAttemptId()}.arrow"
        encoder, out = None, None
        for batch in batches:
            if out is None:
                encoder, out = word_encoder(vocabulary(), kind), SequenceWriter(f"{folder}/sequences/{name}", kind, sequence, batch_sequences)
            places, sizes = [], []
            for data in batch.column(1):
                ids = encoder.ids(data.as_py()) + end
                places.append(out.add(ids))
                sizes.append(len(ids) // out.kind.itemsize)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=schema.names)
        if out is not None:
            out.close()

    system, path = _open(f"{folder}/sequences")
    system.create_dir(path, recursive=True)
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/documents")
    return TokenFolder(folder, schema)


def read_documents(spark: SparkSession, written: TokenFolder) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, last_id, file, position)`` of every document, read from the files by random access.

    ``start`` counts the ids of all documents before it, over all files.  Files are dealt to tasks, and a task reads a
    file's documents in order, so a batch of a file is mapped or fetched once.
    """
    index = written.documents(spark)
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    tasks = max(1, files.count())
    # A file's documents are small rows beside its ids, by which Spark would judge a broadcast.
    placed = index.join(starts.hint("merge"), "file").repartitionByRange(tasks, "part").sortWithinPartitions("file", "position")
    schema = T.StructType([written.schema["doc_id"]] + [T.StructField(n, t) for n, t in [
        ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("last_id", T.LongType()), ("file", T.StringType()), ("position", T.LongType())]])
    folder = written.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, data = None, None
        for batch in batches:
            rows = []
            for file, position, n_tokens, start in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if file != name:
                    if data is not None:
                        data.close()
                    name, data = file, SequenceFile(f"{folder}/sequences/{file}")
                crc, n, last = 0, 0, None
                for view in data.pieces(position, n_tokens):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                    n, last = n + len(view), int(view[-1])
                rows.append((start, n, crc, last, file, position))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=schema.names)
        if data is not None:
            data.close()

    return placed.select("doc_id", "file", "position", "n_tokens", (F.col("before") + F.col("position")).alias("start")).mapInArrow(run, schema)


def token_sequences(docs: DataFrame, folder: str | None = None, **layout) -> DataFrame:
    """``read_documents`` of what ``write_sequences`` makes of all ``docs(doc_id, text)`` in the folder, or in a new shared one.

    Null and empty texts have the end id alone; repeated rows, and rows with one id, each have their own place, in the order of
    the source; rows without an id come first; an empty table gives an empty result; other columns are ignored.  The
    special tokens' names inside a text are what the tokenizer file makes of them: one id.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    return read_documents(spark, write_sequences(docs, folder, **layout))
