"""Token ids as length-delimited binary records, with an offset index beside each file for shuffled reads.

File `part-<k>.records` holds records one after another, little-endian throughout:

    length of the payload (8 bytes) | masked checksum of these 8 bytes (4) | payload | masked checksum of it (4)

The payload is one sequence: 1 byte for whether it has an id, the id (8), the bytes per token id (1), the
token ids. The checksum is CRC-32 (the one in zlib), rotated right by 15 bits plus a constant, so that the
checksum of data that holds checksums stays sound. File `part-<k>.index` holds the byte offset of each record
and, last, the size of the record file, 8 bytes each.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.blocks import map_batches
from tallyspark.session import stored

# Fixed values of the record format.
MASK = 0xA282EAD8
HEAD, TAIL, PREFIX = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqB")
KNOWN_WORDS = 1 << 20
MARK, TOGETHER = "|", 256
# Letters of ASCII and Latin-1, then signs; the steps below turn such a word into its letters in lower case and, apart, its signs.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?&#*%$]*)")
SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [{"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return PREFIX.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = PREFIX.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=PREFIX.size)


def read_record(stream) -> bytes | None:
    """The next payload, or None at the end. Raises ValueError for a damaged or cut record."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or HEAD.unpack(head)[1] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = HEAD.unpack(head)[0]
    body = stream.read(size + TAIL.size)
    if len(body) < size + TAIL.size or TAIL.unpack(body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


def qualified(spark, path: str) -> str:
    """A path without a scheme is one of the cluster's default file system, for the tasks as for Spark."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return path if ":/" in path or default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All sequences of one record file, in order, without holding the file in memory."""
    store, where = open_folder(path)
    with store.open_input_stream(where, buffer_size=1 << 20) as raw:
        while (payload := read_record(raw)) is not None:
            yield unpack(payload)


def read_at(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records with these numbers, in the order asked for: one index lookup and one seek each."""
    store, where = open_folder(path)
    with store.open_input_file(where.removesuffix(".records") + ".index") as raw:
        index = np.frombuffer(raw.read(), "<u8")
    out = []
    with store.open_input_file(where) as raw:
        for n in numbers:
            raw.seek(int(index[n]))
            out.append(unpack(read_record(io.BytesIO(raw.read(int(index[n + 1] - index[n]))))))
    return out


class Encoder:
    """Token ids of whole texts. The tokenizer drops white space and never joins across it, so each distinct
    word is encoded once and remembered; the memory is emptied when it holds KNOWN_WORDS words. New words go to the
    tokenizer TOGETHER at a time with a mark between them, whose id tells them apart again. Where the steps before the
    model are known ones (NORMAL, SPLIT), letters go straight to the model, once whatever their case and the signs after them."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        said = json.loads(self.tokenizer.to_str())
        ending = said["model"].get("end_of_word_suffix")
        self.straight = None
        if ((said["normalizer"] or {}).get("normalizers") == NORMAL and (said["pre_tokenizer"] or {}).get("pretokenizers") == SPLIT
                and said["model"]["type"] == "BPE" and ending and said["model"]["dropout"] is None and said["truncation"] is None
                and all("<" in t["content"] for t in said["added_tokens"])):
            self.straight = Tokenizer.from_str(json.dumps(said | {
                "normalizer": None, "post_processor": None, "added_tokens": [],
                "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, SPLIT[1]]}}))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in said["model"]["vocab"].items() if t.endswith(ending)]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)
        self.used = 0

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        if self.straight is None:
            return self.learn_marked(words)
        found = [PLAIN.fullmatch(w) for w in words]
        plain = [m for m in found if m]
        letters, signs = [m[1].decode().lower().encode() for m in plain], [m[2] for m in plain]
        self.learn_marked(list({w for w, m in zip(words, found) if not m} | set(signs).difference(self.number)))
        new = list(set(letters).difference(self.number))
        groups = [new[lo : lo + TOGETHER] for lo in range(0, len(new), TOGETHER)]
        lists = [np.array(e.ids, np.uint32) for e in self.straight.encode_batch_fast(
            [b" ".join(g).decode() for g in groups], add_special_tokens=False)]
        if new:
            ids = np.concatenate(lists)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(new):
                raise ValueError("the tokenizer does not end each word with its suffix")
            self.keep(new, ids, np.diff(last, prepend=-1))
        other = [(m[0], c, e) for m, c, e in zip(plain, letters, signs) if e or m[0] != c]
        if other:
            pairs = np.array([(self.number[c], self.number[e]) for _, c, e in other]).ravel()
            ids, total = self.gathered(pairs)
            self.keep([w for w, _, _ in other], ids, np.diff(total[::2]))

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers, one after another, and where each begins and the last ends."""
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)], total

    def learn_marked(self, words: list[bytes]) -> None:
        apart = [w for w in words if MARK.encode() in w or len(self.mark) != 1]
        plain = [w for w in words if MARK.encode() not in w] if len(self.mark) == 1 else []
        groups = [plain[lo : lo + TOGETHER] for lo in range(0, len(plain), TOGETHER)]
        words, lists, sizes = [], [], []
        for group, ids in zip(groups, self.encoded([f" {MARK} ".join(w.decode() for w in g) for g in groups])):
            marked = ids == self.mark[0]
            marks = np.flatnonzero(marked)
            if len(marks) != len(group) - 1:  # words that hold the mark in another form
                apart += group
                continue
            words += group
            lists.append(ids[~marked])
            sizes.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
        alone = self.encoded([w.decode() for w in apart])
        new = np.concatenate([np.zeros(0, np.uint32), *lists, *alone])
        sizes = np.concatenate([*sizes, np.fromiter(map(len, alone), np.int64, len(alone))])
        self.keep(words + apart, new, sizes)

    def keep(self, words: list[bytes], new: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.used : self.used + len(new)] = new
        self.bounds[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(new)
        self.number.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        if len(self.number) > KNOWN_WORDS:
            self.clear()
        fresh = list(set().union(*words).difference(self.number))
        if fresh:
            self.learn(fresh)
        ends = np.cumsum([len(ws) for ws in words], dtype=np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(ends[-1]) if words else 0)
        ids, total = self.gathered(at)
        cuts = total[np.concatenate([[0], ends])]
        return [ids[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]


def pieces(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column as bytes, a few megabytes at a time; null is empty."""
    column = column.cast(pa.large_binary())
    lo, held, size = 0, [], 0
    for i in range(len(column)):
        held.append(column[i].as_py() or b"")
        size += len(held[-1])
        if size >= limit:
            yield lo, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, held


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encode every whole text, end each with `end_id`, and write record and index files in ascending doc_id
    order: shard k holds smaller ids than shard k + 1. Returns one row per file: shard, path, records, tokens.

    Ids are whole numbers. A null id comes first; rows with the same id are ordered by a hash of their text and all kept; null and
    empty texts give a sequence of `end_id` alone; other columns are not read. A task writes to a name of its
    own and renames the file when it is whole, so a repeated or speculative task leaves the same file.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches):
        encoder, task = Encoder.of(tokenizer), TaskContext.get()
        shard = task.partitionId()
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        store, where = open_folder(folder)
        store.create_dir(where)
        name, draft = f"{where}/part-{shard:06d}", f"{where}/_draft-{shard:06d}-{task.taskAttemptId()}"
        offsets, tokens = [0], 0
        with store.open_output_stream(f"{draft}.records") as out:
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for lo, texts in pieces(batch.column("text")):
                    for i, ids in enumerate(encoder.encode(texts)):
                        record = frame(pack(doc_ids[lo + i], np.append(ids, np.uint32(end_id)), width))
                        out.write(record)
                        offsets.append(offsets[-1] + len(record))
                        tokens += len(ids) + 1
        with store.open_output_stream(f"{draft}.index") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        for kind in ("records", "index"):
            store.move(f"{draft}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "path": [f"{folder}/part-{shard:06d}.records"],
            "records": pa.array([len(offsets) - 1], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return stored(map_batches(rows, write, "shard int, path string, records bigint, tokens bigint"), "token-manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the ids as
    32-bit numbers. Only the manifest, one row per file, is summed in one place."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                for doc_id, ids in read_shard(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _digest_batch(rows)
                        rows = []
                yield _digest_batch(rows)

    return map_batches(files.select("path", "start").repartition(n), read,
                       "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=list(names))
