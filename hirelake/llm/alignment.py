"""Alignment of two tokenizers over the same texts (operator 11).

Both tokenizers give spans: the byte-level BPE character offsets, sentencepiece the spans of its proto (the installed version gives
them as ``proto``, the successor of the immutable one). These are the coarse cuts. Where several tokens
share a character, or pieces are byte fallbacks, the cuts inside it come from the tokens' decoded bytes. Byte offsets at which tokens of both end
part a text into groups, and every pair of tokens inside a group is a link.

Texts are cut first where neither tokenizer's merges can cross (before a single space, around a single line break), so a
piece of text repeats very often; its alignment is kept by the worker that made it (bounded, see ``_KEPT``) and used again. Tokens, groups and
links of a document are those of its pieces, one after the other.

How many documents hold an id pair is counted by a shuffle over each document's distinct pairs (pre-aggregated). The
counts come back to the documents by a join: the pairs in at least 1/``common`` of all (document, pair) rows are at most ``common`` and broadcast, all
others are joined by shuffle, where none of them holds more than that share of the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import documents, small_batches, stored
from hirelake.llm.vocab import SPACE, byte_bpe, cuts_at_spaces, model_bytes, public_path, sentencepieces

#: Pieces of text whose alignment a task keeps, and the longest of them.
_KEPT, _LONGEST = 420_000, 64
#: Pieces encoded as one string.
_AT_ONCE = 1_000
_FALLBACK = re.compile(r"<0x([0-9A-F]{2})>")
# a place before one space, or on either side of one line break, between characters that are neither white space nor a piece's space
_CUT = re.compile(f"(?<=[^\\s{SPACE}])(?=[ \\n][^\\s{SPACE}])|(?<=[^\\s{SPACE}]\\n)(?=[^\\s{SPACE}])")
# a piece as text_pieces cuts them from ordinary text
_PLAIN = re.compile(f" ?[^\\s{SPACE}]+")


def text_pieces(text: str) -> list[str]:
    """Parts of space+``text`` that both tokenizers encode alone as they do in the whole."""
    words = text.split()
    gaps = max(len(words) - 1, 0)
    # ordinary: every white space is one space or line break between two words
    if text.count(" ") + text.count("\n") != gaps or sum(map(len, words)) + gaps != len(text) or SPACE in text:
        return _CUT.split(" " + text)
    out = []
    for k, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if k:
            out.append("\n")
            out.append(words[0])
            out += [" " + w for w in words[1:]]
        else:
            out += [" " + w for w in words]
    return out


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies to bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their coarse byte spans. A token that shares a character with the next one, or whose span
    is empty (all but the last of a character's fallback bytes), ends where its decoded bytes do."""
    inside = spans[:, 0] == spans[:, 1]
    inside[:-1] |= spans[1:, 0] < spans[:-1, 1]
    return np.where(inside, np.cumsum(sizes), spans[:, 1])


class _Numbers(dict):
    """Numbers pieces of text in the order they come; ``new`` holds those that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


class Aligner:
    """Aligns texts; a worker process keeps one. Each distinct piece of text gets a number and is aligned once: ordinary pieces many
    at a time in one string (they are cut apart where both tokenizers cut, so the string's tokens are theirs), others one by one."""

    def __init__(self, a_model: bytes, b_model: bytes):
        self.a = byte_bpe(a_model, special_as_text=True)
        self.b = sentencepieces(b_model, prefix=False)
        alphabet = _byte_alphabet()
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        # an added token is no byte-level entry; as plain text it never occurs
        self.a_bytes = [bytes(alphabet[c] for c in t) if t and all(c in alphabet for c in t) else b"" for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) and _FALLBACK.fullmatch(p) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        most = max(len(tokens), len(pieces))
        self.comma, self.bar, self.semicolon = ([f"{i}{mark}" for i in range(most)] for mark in ",|;")
        self.whole = not cuts_at_spaces(b_model)
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.names: list[str] = []                     # per piece: its groups as text
        self.counts = np.zeros((0, 5), np.int64)       # per piece: tokens of A, of B, groups, links, whether its bytes differ
        self.first = np.zeros((0, 2), np.int64)        # per piece: where its linked pairs begin, and how many there are
        self.pairs = np.zeros(1 << 16, np.int64)       # linked id pairs of all pieces
        self.times = np.zeros(1 << 16, np.int32)       # how often each is linked
        self.filled = 0
        self.used = np.zeros(0, np.int64)              # per piece: how often it came

    def _forget_rare(self) -> None:
        """Keeps at most half as many pieces, those that came most often (counts are halved, so old ones fade)."""
        least = 2
        while (self.used >= least).sum() > _KEPT // 2:
            least *= 2
        kept = np.flatnonzero(self.used >= least)
        pieces, names, counts, (first, size), times, pairs = list(self.number), self.names, self.counts[kept], self.first[kept].T, self.times, self.pairs
        used = self.used[kept] // 2
        self.forget()
        for k in kept.tolist():
            self.number[pieces[k]]
        self.number.new = []
        self.names, self.counts, self.used = [names[k] for k in kept.tolist()], counts, used
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        self._store(pairs[at], times[at])
        self.first = np.stack([np.cumsum(size) - size, size], axis=1)

    def _store(self, pairs: np.ndarray, times: np.ndarray | int) -> int:
        at, self.filled = self.filled, self.filled + len(pairs)
        if self.filled > len(self.pairs):
            more = max(self.filled, 2 * len(self.pairs))
            self.pairs, self.times = (np.concatenate([x, np.zeros(more - len(x), x.dtype)]) for x in (self.pairs, self.times))
        self.pairs[at:self.filled], self.times[at:self.filled] = pairs, times
        return at

    def _spans(self, text: str):
        """Ids and byte ends of both tokenizers' tokens of ``text``; None if either's bytes are not the text's."""
        raw = text.encode("utf-8", "surrogatepass")
        enc = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(text, num_threads=1, return_type="proto").pieces
        ids_a, ids_b = enc.ids, [p.id for p in proto]
        if b"".join([self.a_bytes[i] for i in ids_a]) != raw or b"".join([self.b_bytes[i] for i in ids_b]) != raw:
            return None
        spans = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        if len(raw) != len(text):   # characters to bytes
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            spans = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[spans]
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        in_b = np.stack([np.fromiter([p.begin for p in proto], np.int64, len(b)), np.fromiter([p.end for p in proto], np.int64, len(b))], axis=1)
        return a, _ends(spans, self.a_size[a]), b, _ends(in_b, self.b_size[b])

    def _single(self, piece: str) -> None:
        """A piece of its own: any white space, any length (a group without inner cuts may be long, but has few distinct ids)."""
        number = self.number[piece]
        spans = self._spans(piece)
        if spans is None:
            self.counts[number] = (0, 0, 0, 0, 1)
            return
        a, ends_a, b, ends_b = spans
        cuts = np.intersect1d(ends_a, ends_b)
        names, pairs, links, i, j = [], defaultdict(int), 0, 0, 0
        for k, m in zip(np.searchsorted(ends_a, cuts, "right").tolist(), np.searchsorted(ends_b, cuts, "right").tolist()):
            ga, gb = a[i:k].tolist(), b[j:m].tolist()
            i, j = k, m
            names.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links += len(ga) * len(gb)
            many_b = Counter(gb)
            for x, n in Counter(ga).items():
                for y, c in many_b.items():
                    pairs[x << 32 | y] += n * c
        self.counts[number] = (len(a), len(b), len(cuts), links, 0)
        self.names[number] = ";".join(names)
        at = self._store(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.first[number] = at, len(pairs)

    def _block(self, pieces: list[str]) -> None:
        """Ordinary pieces (one space or none before, no other white space) as one string; those without a space stand behind a line break."""
        parts, own = [], []
        for p in pieces:
            if p[0] != " ":
                parts.append("\n")
                own.append(False)
            parts.append(p)
            own.append(True)
        spans = self._spans("".join(parts))
        ends = np.cumsum([len(p.encode()) for p in parts])
        if spans is None:
            ok = False
        else:
            a, ends_a, b, ends_b = spans
            in_a, in_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_b[-1] + 1, bool)
            in_a[ends_a], in_b[ends_b] = True, True
            stop_a, stop_b = in_b[ends_a], in_a[ends_b]   # tokens with which a group ends
            ok = in_a[ends].all() and in_b[ends].all()
        if not ok:
            for p in pieces:
                self._single(p)
            return
        cuts = ends_a[stop_a]   # ends of the groups
        of_a, of_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b   # group of each token
        n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        # all pairs of tokens within a group: each A token with its group's B tokens
        per_a = n_b[of_a]
        first = np.repeat(np.cumsum(per_a) - per_a, per_a)
        at_b = np.repeat((last_b - n_b)[of_a], per_a) + np.arange(len(first)) - first
        start = self._store((np.repeat(a, per_a) << 32) | b[at_b], 1)
        # the groups as text: every token with what follows it, A tokens of a group before its B tokens
        text = np.empty(len(a) + len(b), object)
        comma, bar, semicolon = self.comma, self.bar, self.semicolon
        text[np.arange(len(a)) + (last_b - n_b)[of_a]] = [
            comma[i] if more else bar[i] for i, more in zip(a.tolist(), (np.arange(1, len(a) + 1) < last_a[of_a]).tolist())]
        text[np.arange(len(b)) + last_a[of_b]] = [
            comma[i] if more else semicolon[i] for i, more in zip(b.tolist(), (np.arange(1, len(b) + 1) < last_b[of_b]).tolist())]
        text = text.tolist()
        group = np.searchsorted(cuts, ends)   # the last group of each part
        upto = np.stack([last_a[group], last_b[group], group + 1, np.cumsum(n_a * n_b)[group], np.zeros_like(group)], axis=1)
        counts = np.diff(upto, axis=0, prepend=0)
        keep = np.array(own)
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.counts[numbers] = counts[keep]
        self.first[numbers] = np.stack([start + upto[:, 3] - counts[:, 3], counts[:, 3]], axis=1)[keep]
        stop = (upto[:, 0] + upto[:, 1])[keep].tolist()
        begin = (upto[:, 0] + upto[:, 1] - counts[:, 0] - counts[:, 1])[keep].tolist()
        for n, x, y in zip(numbers.tolist(), begin, stop):
            self.names[n] = "".join(text[x:y])[:-1]

    def _learn(self) -> None:
        """Aligns the pieces that are new."""
        new, self.number.new = self.number.new, []
        self.names += [""] * len(new)
        self.counts = np.concatenate([self.counts, np.zeros((len(new), 5), np.int64)])
        self.first = np.concatenate([self.first, np.zeros((len(new), 2), np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        plain, others = [], []
        for p in new:
            (plain if len(p) <= _LONGEST and _PLAIN.fullmatch(p) else others).append(p)
        for at in range(0, len(plain), _AT_ONCE):
            self._block(plain[at:at + _AT_ONCE])
        for p in others:
            self._single(p)

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pair ids, numbers) of each text."""
        if len(self.number) > _KEPT:
            self._forget_rare()
        ids, number = [], self.number.__getitem__
        for t in texts:
            parts = ([" " + t] if self.whole else text_pieces(t)) if t else []
            ids.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        return [self._document(x) for x in ids]

    def _document(self, ids: np.ndarray) -> tuple:
        n_a, n_b, n_groups, n_links, differ = self.counts[ids].sum(axis=0).tolist()
        if differ or not n_links:
            return 0, 0, 0, 0, "", [], []
        names = hashlib.sha256(";".join(map(self.names.__getitem__, ids.tolist())).encode()).hexdigest()
        kinds, often = np.unique(ids, return_counts=True)
        self.used[kinds] += often
        start, size = self.first[kinds].T
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        distinct, place = np.unique(self.pairs[at], return_inverse=True)
        total = np.bincount(place, self.times[at] * np.repeat(often, size)).astype(np.int64)
        return n_a, n_b, n_groups, n_links, names, distinct, total


@lru_cache(maxsize=1)
def _aligner(a_model: bytes, b_model: bytes) -> Aligner:
    return Aligner(a_model, b_model)


def aligned(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (a number of its own), ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the distinct
    linked id pairs ``pairs`` (A id times 2^32 plus B id) with their numbers of links ``links``. Stored."""
    small_batches(docs.sparkSession)
    a_model, b_model = model_bytes(a_path), model_bytes(b_path)
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]

    def run(batches):
        aligner = _aligner(a_model, b_model)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            cols = list(zip(*aligner.documents(batch.column(2).to_pylist()))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).cast("string"))
    kind = docs.schema[id].dataType.simpleString()
    return stored(src.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                      "pairs array<long>, links array<long>"), "aligned")


def pair_counts(alignment: DataFrame) -> DataFrame:
    """Every linked id pair: ``pair``, ``docs`` (documents that hold it linked), ``best`` (the most of its A id, ties included)."""
    counts = alignment.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    # at most the B vocabulary per A id
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("docs") == most)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", common: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: ``id`` (as named), ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in most documents of
    its A id's), ``count_sum`` (documents of the links' pairs, summed over the links), ``groups_sha256``.

    ``a_path``: a byte-level BPE ``.json`` (encodes space+text); ``b_path``: a sentencepiece ``.model`` (adds the space itself), read on the driver;
    strings of special tokens are plain text. Null and empty texts, and texts that a tokenizer does not give back byte for byte (as with
    U+2581), have no tokens: zeros and ''. Repeated rows and null or equal ids keep a row each and count as documents of their own.
    Texts of any length are aligned whole; an empty table gives no rows. Other columns are not returned, whatever their names; the id column
    may have no name of a result column. ``common`` bounds the broadcast table (see the module's text).
    """
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if id in results:
        raise ValueError(f"rename the id column {id}: a result column has that name")
    rows = aligned(docs, a_path, b_path, id, text)
    counts = stored(pair_counts(rows), "pairs")
    total = rows.agg(F.sum(F.size("pairs"))).first()[0] or 0
    is_common = F.col("docs") * F.lit(common) >= F.lit(total)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    top = F.broadcast(counts.where(is_common))   # at most `common` rows of 17 bytes
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum")]
    near = each.join(top, "pair").groupBy("row").agg(*sums)
    far = each.join(F.broadcast(counts.where(is_common).select("pair")), "pair", "left_anti").join(counts.where(~is_common), "pair").groupBy("row").agg(*sums)
    both = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    got = rows.drop("pairs", "links").join(both, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return got.select(F.col("id").alias(id), *results)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """byte_bpe_50k.json and piece_bpe_32k.model aligned over every whole text of ``documents``."""
    return alignment_report(documents(spark, sf_dir, "doc_id", "text"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
