"""Token ids in binary shards of compressed planes.

A shard holds the documents of one range of ids, in ascending order of id. Its ids, as unsigned 32-bit
little-endian integers, are cut into chunks of `CHUNK`; each chunk is transposed into its four byte
planes or its 32 bit planes, and each plane is compressed with zstandard. Layout of a shard:

    MAGIC | compressed planes ... | index (JSON, zstandard) | size of the index (8 bytes) | MAGIC

The index lists, per chunk, the number of ids and the offset and size of each plane, so that a reader
can fetch any range of ids, and per document its id (null allowed) and its number of ids. A task writes
one shard and holds one chunk of it; its name is unique to the attempt. The manifest, a Parquet table
written when all tasks are done, lists the shards that count: what a lost attempt left is not read.

Defined cases: a null text is an empty one, so it holds the end id alone; null ids come first; rows that
repeat an id are in order of their ids' checksum; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts, slices
from marketreach.llm.memo import look_up
from marketreach.session import shared_folder, stage

MAGIC = b"IDPLANE1"
CHUNK = 1 << 16
LEVEL = 3
END = 1
HELD = 1_000_000  # words a task remembers
JOINED = 256  # words encoded as one text
BATCH = 4096
SLICE = 1_000_000
ENDS = re.compile(r"[.,;:!?](?<=[a-zß-öø-ÿ].)(?![^ \n])")  # a sign the tokenizer cuts off anyway
LATIN = re.compile(r"[\x00-\xff]*")  # letters that the normaliser lower-cases one by one and else leaves alone
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")  # a word that is one piece for the tokenizer
LAST = "</w>"  # end of the last token of a piece
MARK = "\x01"  # between words of one text; a word of its own, with an id that no other word has


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Encoder of a task. The tokenizer drops white space, so words are encoded one by one and kept."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str | None) -> Words:
        if path not in cls._made:
            cls._made[path] = cls(path or default_tokenizer())
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-case Latin-1 words are the same before and after the normaliser
        self.light = Tokenizer.from_file(path)
        self.light.normalizer = normalizers.Sequence([])
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith(LAST)]] = True
        self.held: dict[str, bytes] = {}

    def _ids(self, texts: list[str], light: bool = False) -> list[np.ndarray]:
        tokenizer = self.light if light else self.tokenizer
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.width) for x in found]

    def _learn(self, words: list[str]) -> None:
        """Encode words: many as one text where its marks cut it into as many pieces."""
        alone = [w for w in words if MARK in w or "<|" in w]  # a special token is found in raw text only
        rest = [w for w in words if MARK not in w and "<|" not in w]
        whole = [w for w in rest if LETTERS.fullmatch(w)]
        mixed = [w for w in rest if not LETTERS.fullmatch(w)]
        plain = [w for w in mixed if w == w.lower() and (w.isascii() or LATIN.fullmatch(w))]
        (mark,) = self._ids([MARK])
        for kind, chosen in (("whole", whole), ("plain", plain), ("rest", list(set(mixed) - set(plain)))):
            between = " " if kind == "whole" else f" {MARK} "
            for at in range(0, len(chosen), BATCH):
                part = chosen[at : at + BATCH]
                groups = [part[i : i + JOINED] for i in range(0, len(part), JOINED)]
                for group, ids in zip(groups, self._ids([between.join(g) for g in groups], kind != "rest")):
                    if kind == "whole":
                        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                        starts = [0, *ends[:-1]]
                        fits = len(ends) == len(group) and ends[-1] == len(ids)
                    else:
                        cuts = np.flatnonzero(ids == mark[0]).tolist() if len(mark) == 1 else []
                        starts, ends = [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]
                        fits = len(cuts) == len(group) - 1
                    if fits:
                        data, k = ids.tobytes(), ids.itemsize
                        self.held.update((w, data[k * a : k * b]) for w, a, b in zip(group, starts, ends))
                    else:
                        alone += group
        for at in range(0, len(alone), BATCH):
            part = alone[at : at + BATCH]
            self.held.update((w, ids.tobytes()) for w, ids in zip(part, self._ids(part)))

    @staticmethod
    def _words(text: str | None) -> list[str]:
        """Words cut at blanks and line ends only; other white space is left to the tokenizer."""
        text = text or ""
        if "<|" not in text:
            if text.isascii() or LATIN.fullmatch(text):
                text = text.lower()
            text = ENDS.sub(r" \g<0>", text)
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as unsigned little-endian integers of `width`."""
        parts = [self._words(t) for t in texts]
        found = look_up(parts, self.held, HELD, lambda new: self._learn(list(new)))
        end = np.array([END], self.width).tobytes()
        return [ids + end for ids in found]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id) and width, their NumPy type: 16 bits if the vocabulary allows."""

    def run(texts: list) -> dict:
        words = Words.of(path)
        return {"ids": words.encode(texts), "width": [words.width] * len(texts)}

    return map_texts(docs, ["doc_id"], "text", run, "ids binary, width string", limit=SLICE)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes, or bit planes, of unsigned 32-bit integers; the lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        table = np.unpackbits(rows, axis=1, bitorder="little").T
        return [np.packbits(row, bitorder="little").tobytes() for row in table]
    return [row.tobytes() for row in rows.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Unsigned 32-bit integers from what `to_planes` made of `n` of them."""
    if len(planes) == 32:
        table = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        rows = np.packbits(np.stack(table, axis=1), axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def _place(uri: str):
    """File system and path of a URI; a plain path is local to all machines."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """Writer of one shard."""

    def __init__(self, stream, bits: bool):
        self.stream, self.bits = stream, bits
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.at = stream.write(MAGIC) or len(MAGIC)
        self.chunks: list = []
        self.docs: list = []
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= CHUNK:
            line = np.concatenate(self.rest)
            full = len(line) - len(line) % CHUNK
            for i in range(0, full, CHUNK):
                self._chunk(line[i : i + CHUNK])
            self.rest, self.waiting = [line[full:]], len(line) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = []
        for plane in to_planes(ids, self.bits):
            data = self.pack.compress(plane)
            self.stream.write(data)
            planes.append((self.at, len(data)))
            self.at += len(data)
        self.chunks.append((len(ids), planes))

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.rest))
        index = json.dumps({"chunks": self.chunks, "docs": self.docs}, separators=(",", ":")).encode()
        data = self.pack.compress(index)
        self.stream.write(data + len(data).to_bytes(8, "little") + MAGIC)


def write(encoded: DataFrame, folder: str, bits: bool = False) -> DataFrame:
    """Write `encoded` (doc_id, ids, width) as shards below `folder`; returns the manifest.

    Manifest: shard, path, n_docs, n_ids and first (ids of all shards before it).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = stream = path = None
        number = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "ids"):
                if shard is None:
                    system, base = _place(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{folder}/{number:06d}-{uuid.uuid4().hex}.planes"
                    stream = system.open_output_stream(_place(path)[1], compression=None)
                    shard = Shard(stream, bits)
                for doc_id, ids, width in zip(*(part.column(c) for c in ("doc_id", "ids", "width"))):
                    shard.add(doc_id.as_py(), np.frombuffer(ids.as_buffer(), width.as_py()).astype("<u4"))
        if shard is not None:
            shard.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [number], "path": [path], "n_docs": [len(shard.docs)], "n_ids": [shard.total]}
            )

    # equal rows may not fill one shard: the last key tells them apart
    keyed = encoded.select(
        "doc_id", "ids", "width", F.crc32("ids").alias("c"), F.monotonically_increasing_id().alias("k")
    )
    order = [F.asc_nulls_first("doc_id"), "c", "k"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "width")
    manifest = stage(ranged.mapInArrow(run, "shard long, path string, n_docs long, n_ids long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document.

    A task reads one shard: the number of partitions is asked for, so adaptive execution, which sees
    only the few bytes of the manifest, does not put them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                system, place = _place(path)
                with system.open_input_file(place) as file:
                    yield from _documents(file, unpack, first)

    shards = manifest.select("path", "first").repartition(max(manifest.count(), 1))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_index(file, unpack) -> dict:
    """Index of an open shard."""
    end = file.size()
    tail = file.read_at(8 + len(MAGIC), end - 8 - len(MAGIC))
    if tail[8:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a shard of id planes")
    size = int.from_bytes(tail[:8], "little")
    return json.loads(unpack.decompress(file.read_at(size, end - 8 - len(MAGIC) - size)))


def _documents(file, unpack, start: int) -> Iterator[pa.RecordBatch]:
    """Documents of a shard, chunk by chunk; a document longer than a chunk is put together."""
    index = read_index(file, unpack)
    chunks = iter(index["chunks"])
    line = np.zeros(0, "<u4")
    rows: list = []
    at = 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    for doc_id, n in index["docs"]:
        if len(line) - at < n:
            parts = [line[at:]]
            have = len(parts[0])
            while have < n:
                size, planes = next(chunks)
                data = [unpack.decompress(file.read_at(length, offset)) for offset, length in planes]
                parts.append(from_planes(data, size))
                have += size
            line, at = np.concatenate(parts), 0
            if rows:
                yield batch()
                rows = []
        rows.append((doc_id, start, n, line[at : at + n].tobytes()))
        at, start = at + n, start + n
    if rows:
        yield batch()


def op9_planes(spark, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the shards."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    target = f"{shared_folder(spark)}/planes/{uuid.uuid4().hex}"
    manifest = write(stage(encode(docs)), target)
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as unsigned 32-bit little-endian integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
