"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; from it a tokenizer is rebuilt: normaliser, the metaspace marker for
blanks, unigram scores or BPE merges (whichever the model holds) and byte fallback. No piece of a model
that splits at blanks has a marker after other characters, so a text falls into segments (markers, then
the rest) that are encoded one by one; tasks keep the ids of segments they have met. Each new segment
goes through the tokenizer in multithreaded batches, and its ids are compared with those of the
sentencepiece library; where the two differ, sentencepiece's are used and the text is marked. Every
text is decoded again and compared with what went in.
Models with other normalisers are encoded text by text, with the same comparison.

Defined cases: a null text is an empty one and has no ids; repeated rows each get a row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts
from marketreach.llm.memo import look_up

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
HELD = 400_000  # segments a task remembers
BATCH = 4096  # segments encoded at a time
JOINED = 256  # segments encoded as one text; a piece with a marker starts the next one
SLICE = 1_000_000  # bytes of text encoded at a time
THREADS = 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(field number, value) of a protobuf message: integers, raw 4 or 8 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """What the encoder needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def segmented(self) -> bool:
        """Whether texts may be encoded segment by segment."""
        plain = not self.charsmap and not self.squeeze and self.dummy_prefix
        return plain and not any(MARK in p.lstrip(MARK) or k == USER for p, _, k in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """BPE merges, best piece first: each cut of a piece into two other pieces."""
        found = []
        for piece, score, kind in self.pieces:
            if kind in (NORMAL, USER):
                for cut in range(1, len(piece)):
                    left, right = piece[:cut], piece[cut:]
                    if left in self.ids and right in self.ids:
                        found.append((-score, self.ids[piece], self.ids[left], self.ids[right], left, right))
        return [(m[4], m[5]) for m in sorted(found)]

    def tokenizer(self):
        """The same model in the tokenizers library."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = self.pieces[self.unknown][0]
        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocabulary, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback
            )
        else:
            scores = [(p, s) for p, s, _ in self.pieces]
            model = models.Unigram(scores, self.unknown, self.byte_fallback)
        made = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        made.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
            + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])
        )
        made.add_tokens([AddedToken(p, normalized=False) for p, _, k in self.pieces if k == USER])
        return made


class Codec:
    """Encoder and decoder of a task, with the segments it has met."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str | None, threads: int = THREADS) -> Codec:
        if (path, threads) not in cls._made:
            cls._made[path, threads] = cls(path or default_model(), threads)
        return cls._made[path, threads]

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        with open(path, "rb") as file:
            self.model = PieceModel(file.read())
        self.tokenizer = self.model.tokenizer()
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.segmented = self.model.segmented
        self.bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN
            else p.replace(MARK, " ").encode()
            for p, _, k in self.model.pieces
        ]
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.held: dict[str, bytes] = {}
        self.odd: set[str] = set()  # segments whose ids differed

    def _verified(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether both libraries gave the same."""
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            theirs = self.check.encode(part, num_threads=self.threads)
            yield from ((np.array(b, np.int32), a == b) for a, b in zip(ours, theirs))

    def _joined(self, segments: list[str]) -> Iterator[tuple[str, np.ndarray, bool]]:
        """Segments without blanks and their ids, encoded many at a time."""
        for at in range(0, len(segments), BATCH):
            part = segments[at : at + BATCH]
            groups = [part[i : i + JOINED] for i in range(0, len(part), JOINED)]
            for group, (ids, ok) in zip(groups, self._verified([" ".join(g) for g in groups])):
                starts = np.flatnonzero(self.marked[ids]).tolist()
                if ok and len(starts) == len(group):
                    yield from ((g, ids[a:b], True) for g, a, b in zip(group, starts, [*starts[1:], None]))
                else:
                    yield from ((g, *found) for g, found in zip(group, self._verified(group)))

    def _segments(self, text: str) -> list[str]:
        """Segments without their first marker, blanks for further ones."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            return [s[1:].replace(MARK, " ") for s in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the two libraries agreed on all of it."""
        if not self.segmented:
            found = list(self._verified(texts))
            return [i for i, _ in found], [ok for _, ok in found]
        if len(self.held) > HELD:  # marks of segments forgotten before; they are set again when met
            self.odd &= self.held.keys()
        parts = [self._segments(t) for t in texts]
        ids = [np.frombuffer(i, np.int32) for i in look_up(parts, self.held, HELD, self._learn)]
        return ids, [not self.odd or self.odd.isdisjoint(p) for p in parts]

    def _learn(self, new: set[str]) -> None:
        """Encode segments not met before."""
        if "" in new:  # a lone marker
            mark = self.model.ids.get(MARK)
            ids = (mark,) if mark is not None else tuple(self.check.encode(" ")[1:])
            self.held[""] = np.array(ids, np.int32).tobytes()
        plain = [s for s in new if s and " " not in s]
        spaced = [s for s in new if " " in s]
        found = chain(self._joined(plain), ((s, *f) for s, f in zip(spaced, self._verified(spaced))))
        for segment, ids, ok in found:
            self.held[segment] = ids.tobytes()
            if not ok:
                self.odd.add(segment)

    def decode(self, ids) -> str:
        """Text of a list of ids."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encode(docs: DataFrame, keep: list[str], path: str | None = None, threads: int = THREADS) -> DataFrame:
    """`keep` columns, ids, whether both libraries agree, and whether decoding gives the text back."""

    def run(texts: list) -> dict:
        import pyarrow as pa

        codec = Codec.of(path, threads)
        texts = [t or "" for t in texts]
        ids, same = codec.encode(texts)
        back = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts)]
        ends = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return {"ids": lists, "parity": same, "lossless": back}

    return map_texts(docs, keep, "text", run, "ids array<int>, parity boolean, lossless boolean", limit=SLICE)


def decode(rows: DataFrame, keep: list[str], path: str | None = None, threads: int = THREADS) -> DataFrame:
    """`keep` columns and the text of `ids`; null ids give an empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([rows.schema[c] for c in keep] + [StructField("text", StringType())])

    def run(batches):
        import pyarrow as pa

        codec = Codec.of(path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [codec.decode(i or []) for i in part.column("_ids").to_pylist()]
                columns = [part.column(c) for c in keep] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text"])

    return rows.select(*keep, F.col("ids").alias("_ids")).mapInArrow(run, schema)


def op7_sentencepiece(spark, folder: str) -> DataFrame:
    """Ids of every document, with what decoding and the comparison of both libraries say."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return encode(docs, ["doc_id"]).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "parity", "lossless")
