"""Document fingerprints by a homomorphic multiset hash (operator 5).

A text is a multiset of paragraphs, its lines. Each paragraph is hashed to a wide vector, and the vectors are summed lane by lane:

* 4 lanes of 64 bits of its BLAKE2b digest, modulo 2^64: equality of the multisets of paragraphs;
* 256 lanes of Cauchy values (fixed point, modulo 2^32) for each of its *pieces* -- as lines can be long, the sentences of a line, and the
  runs of words of a long sentence (cut after words chosen by their hash, so that a cut moves with the text): a sum of k such values is k
  times as wide whether they are of one piece or of k, so the median of the difference of two sums estimates in how many pieces two
  texts differ, each copy counted once;
* one lane that counts the pieces, modulo 2^64.

Blank pieces are not counted and have no Cauchy values: blank paragraphs take part in equality, not in the likeness. With 4 fractional
bits, the lanes tell differences of up to about 10^7 pieces.

The sum does not depend on order, and adding or subtracting a paragraph's vector inserts or deletes the paragraph.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import documents, small_batches

LANES, WIDE = 256, 4
#: One unit of a Cauchy lane, and pieces per numpy table.
_UNIT, _CHUNK = 16, 256
_SENTENCE = re.compile(rb"[^.!?]*[.!?]+|[^.!?]+")
LONG = 64
_CUT = 256


def paragraphs(text: str | None) -> list[bytes]:
    """The lines of a text, as UTF-8; none of a null or empty text. An empty line is a paragraph too."""
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def pieces_of(lines: Iterable[bytes]) -> list[bytes]:
    """The pieces of paragraphs, one after the other."""
    out: list[bytes] = []
    for line in lines:
        if len(line) <= LONG and line.count(b".") < 2:
            out.append(line)
            continue
        for sentence in _SENTENCE.findall(line):
            if len(sentence) <= LONG:
                out.append(sentence)
            else:
                out.extend(_runs(sentence))
    return out


def pieces(text: str | None) -> list[bytes]:
    """The pieces of a text."""
    return pieces_of(paragraphs(text))


def _runs(sentence: bytes) -> Iterator[bytes]:
    start, at = 0, 0
    for word in sentence.split(b" "):
        at += len(word) + 1
        if len(word) > 4 * _CUT:  # no words to speak of
            for i in range(start, at, _CUT):
                yield sentence[i:min(i + _CUT, at)]
            start = at
        elif zlib.crc32(word) & 3 == 0:
            yield sentence[start:at]
            start = at
    if start < len(sentence):
        yield sentence[start:]


def _quantile(share: np.ndarray) -> np.ndarray:
    """Fixed-point Cauchy values, modulo 2^32."""
    return np.rint(np.tan(np.pi * (share - 0.5)) * _UNIT).astype(np.int64).astype(np.uint32)


#: Steps from a piece's hash to the words of its draws (multiples of the golden ratio's 64-bit fraction).
_STEPS = np.arange(1, LANES // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_CAUCHY = _quantile((np.arange(1 << 16) + 0.5) / (1 << 16))


class MultisetHash:
    """The sum; ``add`` and ``remove`` change it paragraph by paragraph."""

    __slots__ = ("lanes", "count", "wide")

    def __init__(self, some: Iterable[bytes] = ()):
        self.lanes, self.count, self.wide = np.zeros(LANES, np.uint32), np.zeros(1, np.uint64), np.zeros(WIDE, np.uint64)
        self.add(some)

    def add(self, some: Iterable[bytes]) -> None:
        some = list(some)
        self.change(new=some, new_pieces=pieces_of(some))

    def remove(self, some: Iterable[bytes]) -> None:
        some = list(some)
        self.change(old=some, old_pieces=pieces_of(some))

    def change(self, old: Iterable[bytes] = (), new: Iterable[bytes] = (), old_pieces: Iterable[bytes] = (), new_pieces: Iterable[bytes] = ()) -> None:
        """Replaces paragraphs ``old`` by ``new``; of their pieces only those that differ need be given."""
        (less, fewer), (more, further) = _piece_sums(old_pieces), _piece_sums(new_pieces)
        self.lanes, self.count = self.lanes - less + more, self.count - fewer + further
        self.wide = self.wide - _paragraph_sum(old) + _paragraph_sum(new)

    def copy(self) -> MultisetHash:
        out = MultisetHash()
        out.lanes, out.count, out.wide = self.lanes, self.count, self.wide
        return out

    def hex(self) -> str:
        return self.lanes.astype(">u4").tobytes().hex() + np.concatenate([self.count, self.wide]).astype(">u8").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> MultisetHash:
        out, raw = cls(), bytes.fromhex(text)
        out.lanes = np.frombuffer(raw[:4 * LANES], ">u4").astype(np.uint32)
        rest = np.frombuffer(raw[4 * LANES:], ">u8").astype(np.uint64)
        out.count, out.wide = rest[:1], rest[1:]
        return out

    def likeness(self, other: MultisetHash) -> float:
        """Estimated share of common pieces (twice the common ones over all of both), 0 to 1; 1 exactly for equal sums."""
        if np.array_equal(self.lanes, other.lanes) and np.array_equal(self.count, other.count) and np.array_equal(self.wide, other.wide):
            return 1.0
        whole = int(self.count[0]) + int(other.count[0])
        apart = float(np.median(np.abs((self.lanes - other.lanes).astype(np.int32).astype(np.float64)))) / _UNIT
        return min(1.0, max(0.0, 1.0 - apart / whole)) if whole else 0.0


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """LANES draws of 16 bits for each 64-bit hash: the hash stepped on and mixed (the finaliser of SplitMix64) once per four draws."""
    z = hashes[:, None] + _STEPS
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view("<u2")


def _paragraph_sum(some: Iterable[bytes]) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(p, digest_size=8 * WIDE).digest() for p in some])
    return np.frombuffer(raw, "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)


def _piece_sums(some: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    copies = Counter(some)
    lanes, count = np.zeros(LANES, np.uint32), np.zeros(1, np.uint64)
    counted = [(p, n) for p, n in copies.items() if p.strip()]
    for at in range(0, len(counted), _CHUNK):
        part = counted[at:at + _CHUNK]
        n = np.fromiter((k for _, k in part), np.uint64, len(part))
        count += n.sum(dtype=np.uint64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p, _ in part), np.uint64, len(part))
        drawn = _mixed(hashes)
        values = _CAUCHY[drawn]
        # the outermost steps of the table are drawn finer, as sums of many pieces need the far tails
        for i, k in zip(*np.nonzero((drawn + np.uint16(1)) <= 1)):
            fine = int.from_bytes(hashlib.blake2b(part[i][0], digest_size=4, salt=b"%d" % k).digest(), "little")
            values[i, k] = _quantile(np.float64((float(drawn[i, k]) + (fine + 0.5) / (1 << 32)) / (1 << 16)))
        if (n > 1).any():
            values = values * n.astype(np.uint32)[:, None]
        lanes += values.sum(axis=0, dtype=np.uint32)
    return lanes, count


def fingerprint(text: str | None) -> MultisetHash:
    return MultisetHash(paragraphs(text))


def edited(text: str, following: str) -> str:
    """``text`` with its last third (of code points) replaced by the first as many of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _rest(old: list[bytes], new: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Both without their common beginning."""
    same = next((k for k, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
    return old[same:], new[same:]


def _result(doc, text: str, own: MultisetHash, following: str, after: MultisetHash) -> tuple:
    change = edited(text, following)
    # the head stays; the sum of the edited text needs what changed only
    old, new = _rest(paragraphs(text), paragraphs(change))
    old_pieces, new_pieces = _rest(pieces_of(old), pieces_of(new))
    of_change = own.copy()
    of_change.change(old, new, old_pieces, new_pieces)
    return (doc, len(text), hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(),
            of_change.hex(), own.likeness(of_change), own.likeness(after))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (part, ghost, descending id): each is finished by the row after it."""
    before = None
    for batch in batches:
        out = []
        for part, ghost, doc, text in zip(batch["part"], batch["ghost"], batch["doc_id"], batch["text"]):
            own = fingerprint(text)
            if before is not None and before[0] == part:
                out.append(_result(*before[1:], text, own))
            before = None if ghost else (part, None if pd.isna(doc) else int(doc), text, own)
        table = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        yield table.astype({"doc_id": "Int64"})


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 5_000,
              max_parts: int = 20_000) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses (see ``_OUT``). The next document of
    a row follows it in descending order of id (null ids last; equal ids by the hash of their texts); after the last comes the first.

    The text is shuffled once: rows are dealt by ranges of the id, whose bounds are approximate quantiles, and
    streamed in order. The first row of each range (one of at most ``max_parts``) is sent to the range before it as well.
    Null texts are empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, min(max_parts, ceil(rows.count() / rows_per_part)))
    if parts > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", F.lit([i / parts for i in range(1, parts)]), F.lit(10 * max_parts))).first()[0]
    else:
        cuts = []
    edges = np.unique(np.array(cuts or [], np.int64))
    top = len(edges)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), top, np.int32)  # null ids come last
        at[known] = top - np.searchsorted(edges, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(at, dtype="int32")

    ranked = rows.withColumn("part", part_of("doc_id")).withColumn("hash", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")
    firsts = sorted(ranked.groupBy("part").agg(F.max(order).alias("first")).collect(), key=lambda r: r["part"])
    ghosts = spark.createDataFrame(
        [(firsts[i - 1]["part"], r["first"]["doc_id"], r["first"]["hash"]) for i, r in enumerate(firsts)],
        "to_part int, first_id long, first_hash long")
    # one row per range: bounded by max_parts
    tagged = ranked.join(F.broadcast(ghosts), ranked["doc_id"].eqNullSafe(ghosts["first_id"])
                         & (ranked["hash"] == ghosts["first_hash"]), "left")
    target = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")))
    ghost = F.array(F.struct(F.col("to_part").alias("part"), F.lit(True).alias("ghost")))
    dealt = (tagged.withColumn("at", F.explode(F.when(F.col("to_part").isNull(), target).otherwise(F.concat(target, ghost))))
             .select("at.part", "at.ghost", "doc_id", "hash", "text"))
    n = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (dealt.repartitionById(n, "part")   # a task per range
               .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), F.col("hash").desc()))
    return ordered.select("part", "ghost", "doc_id", "text").mapInPandas(_stream, _OUT)


def op5(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents."""
    return with_next(documents(spark, sf_dir, "doc_id", "text"))
