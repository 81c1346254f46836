"""Token ids as Arrow stream files of fixed-size lists, for reads in place.

Documents in ascending doc_id order are tokenised and their ids, each document closed by an end id, packed end to end
into sequences of ``SEQUENCE`` ids. A file is one Arrow stream: record batches of ``BATCH`` sequences with columns
``ids`` and ``mask``, fixed-size lists, uncompressed, so that sequence k of a file is a slice of a mapped buffer.
The last sequence of a file is filled with end ids, which the mask marks as false. Ids are 16-bit where the
vocabulary allows it.

Spark deals documents out by ranges of doc_id and sorts each range; a task tokenises its range and writes its files
under the shared folder, each under another name first and then renamed, so a repeated or speculative task writes
the same file again and no reader meets half of one. What a task returns says for each document in which file and
where its ids are. File offsets come from sums by file, and every file is read by one task through a memory map.

The encoder is the tokenizers library as loaded, without special tokens added. It cuts texts at white space before
anything else, so equal words have equal ids: texts are cut at the spaces and line breaks where a new pre-token surely
starts, Arrow tells which different words a batch has, the library encodes those that weren't met before, and lists of
ids are taken by word. Words go to the library joined by a control sign that no merge of the vocabulary has, so that they can't
touch each other. A text that holds the string of an added token goes there whole.

Defined results: a null or empty text is the end id alone; invalid UTF-8 reads as replacement characters; null
doc_ids come first, and rows of equal doc_id are ordered by their text; other columns are not read; an empty table
gives no rows and no files.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, id_and_text, materialize, utf8, work_dir

SEQUENCE, BATCH, END = 2048, 64, 2
#: Ids of a file, about, and bytes of text of a task, about.
FILE_IDS, TASK_BYTES = 16_000_000, 64_000_000
#: Bytes of text whose words are looked at together, words that go to the library in one text, words kept for the next
#: texts, and the longest of them in bytes.
BLOCK, JOINED, KEPT, KEPT_BYTES = 12_000_000, 2000, 1_000_000, 64


#: White space of one byte, first bytes of longer ones, and these in UTF-8: fixed values, the White_Space of Unicode.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
LONG_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
LEADS = np.isin(np.arange(256), [x[0] for x in LONG_SPACES])


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are of white space."""
    out = SPACES[data]
    lead = np.flatnonzero(LEADS[data])
    if len(lead):
        next1, next2 = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
        for x in LONG_SPACES:
            hit = (data[lead] == x[0]) & (next1 == x[1]) & (len(x) < 3 or next2 == x[-1]) & (lead + len(x) <= len(data))
            for k in range(len(x)):
                out[lead[hit] + k] = True
    return out


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spaces and line breaks at which a pre-token surely starts, in texts that are joined.

    A run of white space ends the pre-token before it. All but its last sign are one pre-token, unless nothing follows
    it, when all of it is; so the first sign of a run starts one, and so does the last where something follows.
    """
    gap, edge = white(data), np.zeros(len(data) + 1, bool)
    edge[starts] = True
    at = np.flatnonzero((data == 32) | (data == 10))
    first = edge[at] | ~gap[at - 1]
    last = ~edge[at + 1] & ~gap[np.minimum(at + 1, len(data) - 1)]
    return at[(first | last) & ~edge[at]]


class Encoder:
    """Ids of texts by a tokenizers model as loaded."""

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(blob)
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        pre = str(self.model.pre_tokenizer)
        self.by_space = "ByteLevel" in pre and "add_prefix_space=False" in pre and "use_regex=True" in pre and self.model.normalizer is None
        self.kind = "<u2" if self.model.get_vocab_size() <= 2**16 else "<u4"
        self.sign, self.sign_id = self._sign() if self.by_space else (None, -1)
        self.known, self.lists = pa.array([], pa.binary()), pa.array([], pa.list_(pa.from_numpy_dtype(self.kind)))

    def _sign(self) -> tuple[int | None, int]:
        """A control sign whose token is part of no other, and its id."""
        tokens = self.model.get_vocab()
        for sign in (*range(9), *range(14, 28)):
            ids = self.model.encode(chr(sign), add_special_tokens=False).ids
            if len(ids) == 1 and sum(self.model.id_to_token(ids[0]) in t for t in tokens) == 1:
                return sign, ids[0]
        return None, -1

    def _whole(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts that hold the string of an added token."""
        text, hit = data.tobytes(), set()
        for x in self.added:
            at = text.find(x)
            while at >= 0:
                hit.add(int(np.searchsorted(starts, at, "right")) - 1)
                at = text.find(x, at + 1)
        return np.array(sorted(hit), np.int64)

    def _words(self, words: pa.BinaryArray) -> pa.ListArray:
        """Ids of different words; those met before are known, and most of the others are kept."""
        if not len(words):
            return self.lists.slice(0, 0)
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        lists = self._encode(new)
        where = at.fill_null(0).to_numpy().astype(np.int64)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        where[missing] = len(self.known) + np.arange(len(new))
        out = pa.concat_arrays([self.lists, lists]).take(pa.array(where))
        if len(self.known) + len(new) > KEPT:
            self.known, self.lists, new, lists = words, out, words.slice(0, 0), out.slice(0, 0)
        short = pc.less_equal(pc.binary_length(new), KEPT_BYTES)
        self.known, self.lists = pa.concat_arrays([self.known, new.filter(short)]), pa.concat_arrays([self.lists, lists.filter(short)])
        return out

    def _encode(self, words: pa.BinaryArray) -> pa.ListArray:
        """Ids of words by the library; no word stands for the end of a text.

        Words go joined if their only white space is a space or break before them.
        """
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        gaps, signs = (np.concatenate([[0], np.cumsum(x)]) for x in (white(data), data == self.sign if self.sign is not None else np.ones(len(data), bool)))
        first = np.append(data, 0)[offsets[:-1]]
        size = np.diff(offsets)
        plain = (size > 0) & ((first == 32) | (first == 10)) & (np.diff(gaps[offsets]) == 1) & (np.diff(signs[offsets]) == 0)
        order = [np.flatnonzero(plain), np.flatnonzero(~plain & (size > 0)), np.flatnonzero(size == 0)]
        found = [np.zeros(0, self.kind)]
        counts = [np.zeros(0, np.int64)]
        joined = words.take(pa.array(order[0])).to_pylist()
        texts = [bytes([self.sign or 0]).join(joined[i : i + JOINED]).decode("utf-8", "replace") for i in range(0, len(joined), JOINED)]
        for text in texts:  # one at a time: what the library makes of a text is many times its size
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            signs = ids == self.sign_id
            found.append(ids[~signs].astype(self.kind))
            counts.append(np.diff(np.concatenate([[-1], np.flatnonzero(signs), [len(ids)]])) - 1)
        rest = [w.decode("utf-8", "replace") for w in words.take(pa.array(order[1])).to_pylist()]
        for i in range(0, len(rest), JOINED):
            for e in self.model.encode_batch_fast(rest[i : i + JOINED], add_special_tokens=False):
                found.append(np.array(e.ids, self.kind))
                counts.append(np.array([len(e.ids)]))
        found.append(np.full(len(order[2]), END, self.kind))
        counts.append(np.ones(len(order[2]), np.int64))
        place = np.empty(len(words), np.int32)
        place[np.concatenate(order)] = np.arange(len(words))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))).take(pa.array(place))

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined texts, each followed by the end id, and how many ids each text has."""
        at = cuts(data, starts[:-1]) if self.by_space and len(data) else np.zeros(0, np.int64)
        whole = self._whole(data, starts)
        if len(whole):
            at = at[~np.isin(np.searchsorted(starts, at, "right") - 1, whole)]
        # where words start; the end of a text is an empty word, before the first word of the next text
        heads = np.sort(np.concatenate([at * 2 + 1, starts[:-1][np.diff(starts) > 0] * 2 + 1, starts[1:] * 2]))
        offsets = np.append(heads >> 1, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._words(words.dictionary)
        sizes = pc.list_value_length(found).to_numpy()
        upto = np.cumsum(sizes[words.indices.to_numpy()], dtype=np.int64)[heads % 2 == 0]
        return found.take(words.indices).flatten().to_numpy(), np.diff(upto, prepend=0)


def schema(kind: str, length: int) -> pa.Schema:
    ids = pa.uint16() if kind == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(pa.field("item", ids, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


def record_batch(ids: np.ndarray, length: int, kind: str) -> pa.RecordBatch:
    """Whole sequences of ids, the last one filled up."""
    n = -(-len(ids) // length)
    full = np.full(n * length, END, kind)
    full[: len(ids)] = ids
    mask = np.arange(n * length) < len(ids)
    s = schema(kind, length)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full), type=s[0].type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=s[1].type)], schema=s)


class FileWriter:
    """Writes ids into numbered files of a folder; a file gets its name when it is whole."""

    def __init__(self, folder: str, shard: int, kind: str, length: int, batch: int):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.kind, self.length, self.batch = shard, kind, length, batch
        self.number, self.sink, self.held, self.n, self.in_file = -1, None, [], 0, 0

    def name(self, number: int) -> str:
        return f"shard-{self.shard:06d}-{number:04d}.arrows"

    def add(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The file and place of each document's ids; a document lies in one file."""
        ends = np.cumsum(counts)
        starts, files, places, i = ends - counts, [], [], 0
        while i < len(counts):
            if self.sink is None or self.in_file >= FILE_IDS:
                self._next()
            at = starts[i:] - starts[i] + self.in_file
            j = i + int(np.searchsorted(at, FILE_IDS))  # the first document goes in, as the file has room
            files.append(np.full(j - i, self.name(self.number), object))
            places.append(at[: j - i])
            self.held.append(ids[starts[i] : ends[j - 1]])
            n = int(ends[j - 1] - starts[i])
            self.n, self.in_file, i = self.n + n, self.in_file + n, j
            if self.n >= self.batch * self.length:
                self._flush(self.n // (self.batch * self.length))
        return np.concatenate(files) if files else np.zeros(0, object), np.concatenate(places) if places else np.zeros(0, np.int64)

    def _next(self) -> None:
        self.close()
        self.number, self.in_file = self.number + 1, 0
        self.fs.create_dir(self.path, recursive=True)
        self.temp = posixpath.join(self.path, f"_{self.name(self.number)}-{uuid.uuid4().hex}")
        self.sink = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_stream(self.sink, schema(self.kind, self.length))

    def _flush(self, batches: int) -> None:
        """Writes whole batches of what is held."""
        all_ids, size = np.concatenate(self.held), self.batch * self.length
        for k in range(batches):
            self.writer.write_batch(record_batch(all_ids[k * size : (k + 1) * size], self.length, self.kind))
        self.held, self.n = [all_ids[batches * size :]], len(all_ids) - batches * size

    def close(self) -> None:
        if self.sink is None:
            return
        if self.n:
            self.writer.write_batch(record_batch(np.concatenate(self.held), self.length, self.kind))
        self.held, self.n = [], 0
        self.writer.close()
        self.sink.close()
        self.fs.move(self.temp, posixpath.join(self.path, self.name(self.number)))
        self.sink = None


class FileReader:
    """Random access to the ids of one file; the buffers are those of the file where it can be mapped."""

    def __init__(self, folder: str, name: str):
        where, path = fs.FileSystem.from_uri(folder)
        path = posixpath.join(path, name)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema[0].type.list_size if self.batches else 1
        self.ends = np.cumsum([b.num_rows * self.length for b in self.batches])

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids, without a copy, and mask of sequence k."""
        b = int(np.searchsorted(self.ends, k * self.length, "right"))
        row = k - int((self.ends[b - 1] if b else 0) // self.length)
        ids, mask = (self.batches[b].column(c).slice(row, 1).flatten() for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from a place on, over sequences and batches."""
        out, at = [], start
        while n > 0:
            b = int(np.searchsorted(self.ends, at, "right"))
            first = at - int(self.ends[b - 1] if b else 0)
            part = self.batches[b].column(0).flatten().slice(first, n).to_numpy(zero_copy_only=True)
            out.append(part)
            at, n = at + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(blob: bytes) -> Encoder:
    key = zlib.crc32(blob)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(blob)
    return _ENCODERS[key]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = SEQUENCE, batch_rows: int = BATCH) -> DataFrame:
    """Writes the files and gives the index: shard, file, seq (order in the shard), doc_id, place (in the file), n_tokens."""
    spark = docs.sparkSession
    with open(tokenizer or tokenizer_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary, one or two megabytes
    d = id_and_text(docs).select("doc_id", utf8(F.col("text")).alias("raw"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // TASK_BYTES))
    # equal ids are dealt out by the first bytes of their texts too
    dealt = d.repartitionByRange(shards, "doc_id", F.substring("raw", 1, 16)).sortWithinPartitions("doc_id", "raw")
    dealt = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "raw")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, seq = encoder_of(shared.value), None, 0
        for batch in batches:
            if not len(batch):
                continue
            shard = batch.column("shard")
            if writer is None:
                writer = FileWriter(folder, shard[0].as_py(), encoder.kind, length, batch_rows)
            counts, files, places = [], [], []
            for data, starts in texts_of(batch.column("raw")):
                ids, n = encoder.encode(data, starts)
                file, place = writer.add(ids, n)
                counts.append(n)
                files.append(file)
                places.append(place)
            made = [pa.array(np.concatenate(files), pa.string()), pa.array(np.arange(seq, seq + len(batch))), batch.column("doc_id"), pa.array(np.concatenate(places)), pa.array(np.concatenate(counts))]
            seq += len(batch)
            yield pa.RecordBatch.from_arrays([shard, *made], names=["shard", "file", "seq", "doc_id", "place", "n_tokens"])
        if writer is not None:
            writer.close()

    return materialize(dealt.mapInArrow(write, "shard int, file string, seq long, doc_id long, place long, n_tokens long"), "index")


def texts_of(raw: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts joined, and where each starts and the last ends, about ``BLOCK`` bytes at a time."""
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data, a = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the files."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # a row a file: names sort in the order of ids, and a file holds millions of them
    starts = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = index.join(starts.select("file", "before"), "file").withColumn("start", F.col("before") + F.col("place"))

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        file = FileReader(folder, pdf["file"].iloc[0])
        crc = [zlib.crc32(file.ids(a, n).astype("<u4").tobytes()) for a, n in zip(pdf["place"], pdf["n_tokens"], strict=True)]
        return pdf.assign(ids_crc32=crc)[["doc_id", "start", "n_tokens", "ids_crc32"]]

    return placed.groupBy("file").applyInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-files")
    return read_files(write_files(documents(spark, sf_dir), folder), folder)
