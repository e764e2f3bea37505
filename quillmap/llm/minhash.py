"""Near-duplicate classes of documents by DartMinHash signatures, banded joining and exact verification.

Darts are thrown by hashing: an element's weight axis is cut into regions (0-1, 1-2, 2-4, ...), and each region of an
element has its own stream of darts, a Poisson process of ranks whose rate is the region's width. A dart counts for a
document if it falls under the element's weight there and its rank is under a limit that makes the expected number of
darts the same for every document, long or short. Each dart names one coordinate of the signature, and each coordinate
keeps its earliest dart. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import forget, materialise, texts_in_batches

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Coordinates of a signature, and the share of pairs at the least similarity that may meet in no band.
COORDINATES, MISSED = 125, 1e-4
#: Neighbours in a bucket's order that a document is compared with; all of them up to this size of bucket.
WINDOW = 64
#: Counters of how frequent shingles are, by which a text's shingles are put in order.
SLOTS = 1 << 18
#: Remembered word hashes.
MEMORY = 300_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def rows_of_band(similarity: float) -> int:
    """The most rows of a band with which at most MISSED of the pairs of that similarity meet in no band; 5 at 0.8, 2 at 0.5, 1 at least."""
    return max([1, *(r for r in range(1, 33) if (1 - similarity**r) ** (COORDINATES // r) <= MISSED)])


def least_agreement(similarity: float, coordinates: int) -> int:
    """Coordinates in which a pair must agree to be verified: 6 standard deviations under what the similarity gives."""
    return max(0, int(coordinates * similarity - 6 * (coordinates * similarity * (1 - similarity)) ** 0.5))


class Shingler:
    """Hashed shingles of words as lower-cased text between white space; a text of fewer words is one shingle."""

    def __init__(self, words: int = WORDS):
        self.words, self.memory = words, {}

    def _word(self, w: str) -> int:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        h = self.memory[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and how often each occurs."""
        get, new = self.memory.get, self._word
        h = np.array([get(w) or new(w) for w in text.lower().split()], np.uint64)
        if not len(h):
            return h, np.zeros(0, np.int64)
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            s = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                s = mix(s + h[j : len(h) - k + 1 + j] + _U(j + 1))
        return np.unique(s, return_counts=True)


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """One row of k dart names for each document; documents without elements get zeros."""
    sizes = np.array([len(e) for e in elements])
    out = np.zeros((len(elements), k), np.uint64)
    todo, limit = np.flatnonzero(sizes), k * np.log(k) + 2 * k
    while len(todo):
        doc = np.repeat(np.arange(len(todo)), sizes[todo])
        h = np.concatenate([elements[d] for d in todo])
        w = np.concatenate([weights[d] for d in todo]).astype(float)
        top = limit / np.bincount(doc, w)
        best, name = np.full(len(todo) * k, np.inf), np.zeros(len(todo) * k, np.uint64)
        low, width, region = 0.0, 1.0, 0
        while len(h):
            _throw(doc, h, w, low, width, region, top, k, best, name)
            low, width, region = low + width, width if not region else width * 2, region + 1
            more = w > low
            doc, h, w = doc[more], h[more], w[more]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        out[todo[full]] = name.reshape(-1, k)[full]
        todo, limit = todo[~full], limit * 2
    return out


def _throw(doc, h, w, low, width, region, top, k, best, name) -> None:
    """All darts of one weight region, the next one of every element at a time while its rank is under the limit."""
    rank, number = np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        stream = mix(h + _U(0x9E3779B97F4A7C15) * _U(region + 1))
        while len(doc):
            number += 1
            x = mix(stream + _U(0xD1B54A32D192ED03) * _U(number))
            rank = rank - np.log(((x >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width
            alive = rank < top[doc]
            doc, w, rank, stream, x = doc[alive], w[alive], rank[alive], stream[alive], x[alive]
            dart = mix(x + _U(0x8CB92BA72F3D8DD7))
            if region or (w < width).any():
                under = low + width * ((mix(dart + _U(1)) >> _U(11)).astype(float) * 2.0**-53) < w
                at, r, d = doc[under] * k + (dart[under] % _U(k)).astype(np.int64), rank[under], dart[under]
            else:
                at, r, d = doc * k + (dart % _U(k)).astype(np.int64), rank, dart
            np.minimum.at(best, at, r)
            first = best[at] == r
            name[at[first]] = d[first]


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of that many coordinates; those left over are in no band."""
    with np.errstate(over="ignore"):
        grouped = sig[:, : sig.shape[1] // rows * rows].reshape(len(sig), -1, rows)
        h = np.zeros(grouped.shape[:2], np.uint64) + np.arange(grouped.shape[1], dtype=np.uint64)
        for j in range(rows):
            h = mix(h * _U(0x2545F4914F6CDD1D) + grouped[:, :, j])
    return h.view(np.int64)


def _expanded(shingles: np.ndarray, counts: np.ndarray, weighting: str) -> np.ndarray:
    """32-bit names, sorted, whose plain Jaccard similarity is the weighted one: an element of weight c gives c of them."""
    if weighting == "count" and (counts > 1).any():
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        shingles = mix(np.repeat(shingles, counts) + nth.astype(np.uint64) * _U(0xA0761D6478BD642F))
    return np.unique((shingles >> _U(32)).astype(np.uint32))


def sign(docs: DataFrame, id_col: str, text_col: str, words: int, weighting: str, rows_: int) -> DataFrame:
    """(id, digest, bands, sig, names) of every whole text, in one pass; sig is the low byte of each coordinate."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            at = 0
            for texts in texts_of(batch, "text", 256):
                texts = [t or "" for t in texts]
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                pairs = [shingle(t) for t in texts]
                weights = [c if weighting == "count" else np.ones(len(c)) for _, c in pairs]
                sig = signatures([s for s, _ in pairs], weights)
                bands = band_hashes(sig, rows_)
                some = [len(s) > 0 for s, _ in pairs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(digests, pa.binary()), pa.array([b if x else [] for b, x in zip(bands, some, strict=True)], pa.list_(pa.int64())),
                     pa.array([s.tobytes() if x else b"" for s, x in zip(sig.astype(np.uint8), some, strict=True)], pa.binary()), pa.array([_expanded(s, c, weighting).tobytes() for s, c in pairs], pa.binary())],
                    ["id", "digest", "bands", "sig", "names"],
                )
                at += len(texts)

    rows = texts_in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>, sig binary, names binary")


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _neighbours(least: float):
    """Links between rows that stand within WINDOW of each other in a bucket, as far as they join what was not joined yet."""

    agree = least_agreement(least, COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        failed: set[tuple[int, int]] = set()

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        tail = None
        for batch in batches:
            new = (batch.column("bucket").to_numpy(), batch.column("id").to_numpy(), np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1), batch.column("names").to_pylist())
            old = 0 if tail is None else len(tail[0])
            bucket, ids, sig, names = new if tail is None else (np.concatenate([tail[0], new[0]]), np.concatenate([tail[1], new[1]]), np.concatenate([tail[2], new[2]]), tail[3] + new[3])
            found = []
            for back in range(1, min(WINDOW, len(ids) - 1) + 1):
                same = np.flatnonzero(bucket[back:] == bucket[:-back])
                same = same[same + back >= old]
                if not len(same):
                    break
                close = same[(sig[same] == sig[same + back]).sum(axis=1) >= agree]
                for i in close:
                    a, b = int(ids[i]), int(ids[i + back])
                    pair = (a, b) if a < b else (b, a)
                    if a == b or pair in failed or (x := root(a)) == (y := root(b)):
                        continue
                    if _similar(np.frombuffer(names[i], np.uint32), np.frombuffer(names[i + back], np.uint32), least):
                        parent[max(x, y)] = min(x, y)
                        found.append(pair)
                    elif len(failed) < 1_000_000:
                        failed.add(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])
            cut = max(0, len(ids) - WINDOW)
            tail = (bucket[cut:], ids[cut:], sig[cut:], names[cut:])

    return run


def _slot(names: np.ndarray) -> np.ndarray:
    return (mix(names.astype(_U)) >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _frequencies(members: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each slot; SLOTS numbers at any size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column("names").to_pylist()), np.uint32)
            total += np.bincount(_slot(names), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in members.select("names").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def _pairs_by_rare_shingles(members: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of members (id, label, names) of different labels that may reach the similarity; none that do are missing.

    Each text's shingles are put in one order for all, the rarest first as far as the frequencies of SLOTS slots tell; any
    order is exact. Of a pair at the similarity, the first shingle in common stands among the first (1 - 2 s / (1 + s)) of
    the shorter text's and among the first (1 - s) of the longer one's, and from there on both have enough left for the
    overlap that is needed. So only these beginnings move, without shingles that no other text can hold, and what many
    texts share comes last, where nobody looks it up: a passage that all of them hold makes no pairs.
    """
    often, edge = _frequencies(members), 1e-9

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = np.frombuffer(batch.column("names")[k].as_buffer(), np.uint32).astype(np.int64)
                n, held = len(names), often[_slot(names)]
                order = np.lexsort((names, held))[: int(n - np.ceil(least * n - edge) + 1)]
                at = np.flatnonzero(held[order] > 1)
                same = [pa.array(np.full(len(at), v), pa.int64()) for v in (batch.column("id")[k].as_py(), batch.column("label")[k].as_py(), n)]
                first = at < n - np.ceil(2 * least / (1 + least) * n - edge) + 1
                yield pa.RecordBatch.from_arrays([*same, pa.array(names[order[at]]), pa.array(at, pa.int64()), pa.array(first)], ["id", "label", "size", "name", "at", "first"])

    prefixes = materialise(members.select("id", "label", "names").mapInArrow(ahead, "id bigint, label bigint, size bigint, name bigint, at bigint, first boolean"), "prefixes")
    short = prefixes.where("first").select("name", *[F.col(c).alias(f"s_{c}") for c in ("id", "label", "size", "at")])
    shorter = (F.col("s_size") < F.col("size")) | ((F.col("s_size") == F.col("size")) & (F.col("s_id") < F.col("id")))
    left = F.least(F.col("s_size") - F.col("s_at"), F.col("size") - F.col("at"))
    enough = (left >= least / (1 + least) * (F.col("s_size") + F.col("size")) - edge) & (F.col("s_size") >= least * F.col("size") - edge)
    return prefixes.join(short, "name").where(shorter & (F.col("s_label") != F.col("label")) & enough).select(F.col("s_id").alias("a"), F.col("id").alias("b")).distinct()


def _joined(entries: DataFrame, data: DataFrame, labels: DataFrame, check, least: float) -> DataFrame:
    """labels, with the classes joined that have a link between members of wide buckets.

    Wide buckets whose texts are of one class by now need nothing more. The texts of the others are joined by their rare
    shingles, exactly, however large the buckets are.
    """
    wide = entries.where("wide").select("bucket", "id").distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    wide = materialise(wide, "wide")
    mixed = wide.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rest = materialise(wide.join(mixed, "bucket").select("id", "label").distinct(), "mixed")
    members = materialise(rest.join(data.select("id", "names"), "id"), "members")
    pairs = materialise(_pairs_by_rare_shingles(members, least), "pairs")
    near = pairs.join(members.select(F.col("id").alias("a"), F.col("names").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("names").alias("y")), "b")
    near = near.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")
    side = lambda c: rest.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    more = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    more = materialise(more, "more")
    if more.isEmpty():
        return labels
    classes = components(more).select(F.col("id").alias("was"), F.col("label").alias("joined"))
    every = labels.unionByName(wide.select("id", "label")).distinct()
    return every.join(classes, F.col("label") == F.col("was"), "left").select("id", F.coalesce("joined", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links (a, b) reach from each id, by rounds of neighbours' labels and pointer jumps."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        done, labels = labels, materialise(step.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "was"), "labels")
        forget(done)
        if labels.where(F.col("label") != F.col("was")).isEmpty():
            forget(edges)
            return labels.select("id", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, weighting: str = "set", with_digest: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, class_id (the smallest id of its class), kept (whether it is that one); and
    with_digest the SHA-256 of its text, which tells rows without an id apart.

    A class is a connected component of links; documents are linked by equal text or by a similarity of their word
    shingles of at least `similarity`: the Jaccard similarity of the sets, or with weighting="count" of the multisets.
    Null and empty texts are equal texts; texts without words are duplicates of the very same text only. Rows with the
    same id are one document; rows with a null id join the class of an equal text that has an id, else their class is
    null and they are kept. Other columns are not looked at; an empty table gives no rows.

    Bands and the agreement that is asked before a pair is verified follow from `similarity`. Copies meet by digest,
    pre-aggregated, and one of each text goes on. It is linked with the first document of each
    of its buckets and with its neighbours in the bucket's order, which sorts by further bands. Buckets of up to
    WINDOW + 1 texts stay in one task, so that all their pairs are compared; wider ones are ranged over many tasks by that
    order, and their texts that are still of different classes are then joined exactly by their rarest shingles.
    """
    table = materialise(sign(docs, id_col, text_col, words, weighting, rows_of_band(similarity)), "signatures")
    # Rows find their text's class by digest and share, so that a text that a third of all rows hold is spread out.
    shares = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = table.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"))
    pairs = materialise(row.groupBy("digest", "share").agg(F.min("id").alias("low")), "pairs")
    firsts = materialise(pairs.groupBy("digest").agg(F.min("low").alias("first")), "firsts")
    one = table.join(firsts.select(F.col("first").alias("id"), "digest"), ["id", "digest"], "left_semi")
    n = F.size("bands")
    entries = one.select("id", F.posexplode("bands").alias("band", "bucket"), "bands").select(
        "bucket", F.col("id").cast("long").alias("id"), F.get("bands", (F.col("band") + 1) % n).alias("o1"), F.get("bands", (F.col("band") + 7) % n).alias("o2")
    )
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).where("n > 1")
    buckets = buckets.select("bucket", "head", (F.col("n") > WINDOW + 1).alias("wide"))
    # Without an order of its own a bucket falls into one range, hence into one task.
    ordered = [F.when(F.col("wide"), F.col(o)).otherwise(0).alias(o) for o in ("o1", "o2")]
    entries = materialise(entries.join(buckets, "bucket").select("bucket", "id", *ordered, "head", "wide"), "entries")
    # Only documents that share a bucket are compared; their signatures and shingles move once, to meet that list.
    data = table.select(F.col("id").cast("long").alias("id"), "sig", "names")
    data = materialise(data.join(materialise(entries.select("id").distinct(), "shared"), "id", "left_semi"), "candidates")
    least = similarity

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_similar(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    stars = entries.where(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(data.select(F.col("id").alias("b"), F.col("names").alias("y")), "b").join(data.select(F.col("id").alias("a"), F.col("names").alias("x")), "a")
    stars = stars.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = entries.join(data, "id").repartitionByRange(parts, "bucket", "o1", "o2").sortWithinPartitions("bucket", "o1", "o2", "id")
    near = rows.select("bucket", "id", "sig", "names").mapInArrow(_neighbours(least), "a bigint, b bigint")
    links = materialise(reduce(DataFrame.unionByName, [stars, near]).distinct(), "links")
    labels = _joined(entries, data, components(links), check, least)
    classes = firsts.join(labels.select(F.col("id").alias("first"), "label"), "first", "left").select("digest", F.coalesce("label", "first").alias("class_id"))
    out = row.join(pairs.select("digest", "share").join(classes, "digest"), ["digest", "share"])
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), *(["digest"] if with_digest else []))
