"""Language identification by the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import texts_in_batches

#: Dimensions of the hashed n-gram space, centroids per language, and the bound of the training sample per language.
DIMS, CENTROIDS, SAMPLE = 8192, 4, 800
#: A text is rejected if its cosine to the nearest centroid is under this share of the least one in training.
REJECT_SHARE = 0.5
#: Languages beyond this number mean that the label column holds something else.
MAX_LANGS = 500
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed letter bigrams and trigrams over a whole text, words set off by one space; and the number of letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[codes]
    n = int(letter.sum())
    codes = np.where(letter, codes, 32).astype(np.uint64)
    padded = np.concatenate(([32], codes, [32])).astype(np.uint64)
    padded = padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]
    # Fixed odd multipliers spread neighbouring code points over the dimensions.
    two = padded[:-1] * np.uint64(0x9E3779B97F4A7C15) + padded[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + padded[2:] * np.uint64(0x27D4EB2F165667C5)
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    return np.bincount(np.concatenate((two >> shift, three >> shift)).astype(np.int64), minlength=DIMS), n


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt(v @ v)
        return (v / norm if norm else v).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether the distance says that it is none of the learned ones."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, True
        counts, letters = ngram_counts(text)
        if not letters:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(cosines.argmax())
        lang = int(self.owner[best])
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[lang], score, score < self.floor[lang]


def cluster(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from the row nearest the mean and then the rows furthest from all starts."""
    mean = rows.mean(axis=0)
    starts = [int((rows @ mean).argmax())]
    while len(starts) < min(k, len(rows)):
        starts.append(int((rows @ rows[starts].T).max(axis=1).argmin()))
    centres = rows[starts]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on about `sample` labelled, not held-out rows of each language, chosen by a hash of their id; whole texts.

    What reaches the driver is bounded by sample x languages x DIMS. Rows without id, text, label or letters are left out.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30)).alias("u"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages in {lang_col}")
    if not sizes:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chosen = texts_in_batches(rows).where(F.col("u") < share[F.col("lang")] * (1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, keep, row = [], [], [], 0
            for texts in texts_of(batch, "text"):
                for text in texts:
                    counts, letters = ngram_counts(text)
                    if letters:
                        used = np.flatnonzero(counts)
                        at.append(used.astype("<u2").tobytes())
                        values.append(counts[used].astype("<f4").tobytes())
                        keep.append(row)
                    row += 1
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(rows), batch.column("u").take(rows), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["lang", "u", "at", "n"])

    got = sorted((r["lang"], r["u"], bytes(r["at"]), bytes(r["n"])) for r in chosen.mapInArrow(features, "lang string, u bigint, at binary, n binary").collect())
    langs = sorted({r[0] for r in got})
    if not langs:
        return Model([], np.ones(DIMS), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    seen = np.zeros(DIMS)
    for _, _, at, _ in got:
        seen[np.frombuffer(at, "<u2")] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    per, floor = [], []
    for lang in langs:
        # One language's vectors at a time, so that the driver holds sample x DIMS numbers.
        own = [r for r in got if r[0] == lang]
        vectors = np.zeros((len(own), DIMS), np.float32)
        for row, (_, _, at, n) in zip(vectors, own, strict=True):
            row[np.frombuffer(at, "<u2")] = np.log1p(np.frombuffer(n, "<f4"))
        vectors *= idf
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        per.append(cluster(vectors, centroids))
        floor.append(REJECT_SHARE * (vectors @ per[-1].T).max(axis=1).min())
    return Model(langs, idf, np.concatenate(per), np.concatenate([np.full(len(c), k) for k, c in enumerate(per)]), np.array(floor))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected added; columns of these names are replaced.

    The whole text decides; null texts and texts without a letter give `und`, 0 and rejected. One pass, no shuffle.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    rows = texts_in_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"))
    kind = docs.select(*[F.col(f"`{c}`") for c in names]).schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(text) for texts in texts_of(batch, "text") for text in texts]
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["row", "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "lang_pred", "score", "rejected")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
