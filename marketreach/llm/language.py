"""Language identification as a mixture of languages.

Character trigrams of labelled documents are counted per language, hashed into `BUCKETS` buckets, so
the model has a fixed size per language. For a document, expectation-maximisation estimates the share
of each language in its trigrams. Language sets are nested by that share; the set is grown while the
likelihood, less half the logarithm of the trigram count per language (BIC), goes up. The predicted
language has the largest share in the chosen set.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if there is
no labelled document to learn from; ties go to the language that comes first by name; a null doc_id is
not held out; repeated rows each get a row; other columns are ignored or, in `keep_known`, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.llm.arrow import map_texts, slices

BUCKETS = 1 << 16
MAX_LANGUAGES = 512  # more are refused: the model, 8 bytes a bucket and language, is broadcast
SMOOTHING = 0.5
ROUNDS = 60
CLOSE = 1e-4
UNKNOWN = "und"
MIN_SHARE = 0.0

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def buckets(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text; other than letters is one blank."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first blank after a letter
    line = np.concatenate(([32], np.where(letter, codes, 32)[kept], [32])).astype(np.uint32)
    h = line[:-2] * np.uint32(0x9E3779B1) + line[1:-1] * np.uint32(0x85EBCA77) + line[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents of `docs` with a language; summed in each task first."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    found = buckets(text)
                    if len(found):
                        own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        own += np.bincount(found, minlength=BUCKETS) if len(found) > 4096 else 0
                        if len(found) <= 4096:
                            np.add.at(own, found, 1)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                names=["lang", "bucket", "n"],
            )

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Trigram probabilities per language; the languages are in order of name."""

    def __init__(self, names: list[str], totals: np.ndarray):
        self.names = names
        self.p = (totals + SMOOTHING) / (totals.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)

    @classmethod
    def learn(cls, docs: DataFrame) -> Model:
        """From all documents with text and language. At most MAX_LANGUAGES x BUCKETS counts return."""
        found = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        names = sorted(r.lang for r in found.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        totals = np.zeros((len(names), BUCKETS))
        table = counts(docs).toArrow()
        place = {n: i for i, n in enumerate(names)}
        rows = np.array([place[n] for n in table.column("lang").to_pylist()], np.int64)
        totals[rows, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        seen = totals.sum(axis=1) > 0
        return cls([n for n, s in zip(names, seen) if s], totals[seen])

    def mix(self, p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares that make trigrams with counts `n` likely, and their log-likelihood."""
        total = n.sum()
        for _ in range(ROUNDS):
            new = share * (p @ (n / (share @ p))) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < CLOSE:
                break
        return share, float(n @ np.log(share @ p))

    def judge(self, text: str | None) -> tuple[str, float, str]:
        """Language, its share among all languages, and the chosen set with shares."""
        found = buckets(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0, ""
        at, n = np.unique(found, return_counts=True)
        p, n = self.p[:, at], n.astype(float)
        k = len(self.names)
        full, _ = self.mix(p, n, np.full(k, 1 / k))
        order = np.argsort(-full, kind="stable")
        single = np.log(p) @ n
        best = int(np.argmax(single))
        chosen, share = [best], np.ones(1)
        cost = 0.5 * np.log(n.sum())
        value = single[best] - cost
        order = [best, *(i for i in order if i != best)]
        for size in range(2, k + 1):
            members = order[:size]
            start = np.maximum(full[members], 0.01)
            trial, likely = self.mix(p[members], n, start / start.sum())
            if likely - cost * size <= value:
                break
            chosen, share, value = members, trial, likely - cost * size
        first = max(range(len(chosen)), key=lambda i: (share[i], -chosen[i]))
        lang = self.names[chosen[first]]
        listed = ",".join(f"{self.names[c]}:{s:.3f}" for c, s in sorted(zip(chosen, share)))
        return lang, float(min(max(full[chosen[first]], 0.0), 1.0)), listed


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str], train: DataFrame | None = None) -> DataFrame:
    """`keep` columns, lang_pred, score and languages of every row; learns from `train`."""
    model = Model.learn(docs.filter(~held_out()) if train is None else train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        found = [shared.value.judge(t) for t in texts]
        return dict(zip(("lang_pred", "score", "languages"), map(list, zip(*found))))

    return map_texts(docs, keep, "text", run, "lang_pred string, score double, languages string")


def keep_known(docs: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """Rows whose text has a language that takes at least `least` of it; the rest goes."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "doc_id", "lang")
    judged = identify(row, ["row"], docs.filter(~held_out()))
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op4_language(spark, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, ["doc_id", "held_out"], docs.filter(~held_out()))
