"""Merkle manifest of a table (operator 12): one root over all rows, and for each row the proof that it belongs to it.

A node is 64 hexadecimal characters (SHA-256), and a level of an aligned block of 256 nodes is **one string** of them. Fixed-width
substrings of 1,024 characters are the runs of 16 whose hash is a parent, so a block's two levels above are two string expressions; what a
block ends in is a node of the next round, in which 256 times fewer nodes are left (the groups' roots then recurse likewise to the root). For the
proof, the substrings before and after a node inside its run are its siblings; they come down from the root, block by block, by joins on a
node's place. No row or group ever holds more than 256 nodes, however many rows a group has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import documents, stored

#: Children of a node, and hexadecimal characters of a digest.
RUN, WIDTH = 16, 64
#: Nodes of a block: two levels of the tree.
BLOCK = RUN * RUN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: string, r: string>>"


def _h(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: of its fields' forms, one after the other."""
    return _h(F.concat(*[field(v) for v in values]))


def _nodes(level: Column) -> Column:
    return (F.length(level) / WIDTH).cast("int")


def _run(level: Column, i: Column) -> Column:
    return F.substring(level, i * (RUN * WIDTH) + 1, F.lit(RUN * WIDTH))


def _runs(level: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((_nodes(level) - 1) / RUN).cast("int"))


def _flank(run: Column, at: Column) -> Column:
    """Siblings of node ``at`` of a run, left and right."""
    at = at.cast("int")
    return F.struct(F.substring(run, F.lit(1), at * WIDTH).alias("l"), F.substring(run, (at + 1) * WIDTH + 1, F.lit(RUN * WIDTH)).alias("r"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` (leaf to root) give."""
    return F.aggregate(path, leaf, lambda node, s: _h(F.concat(s["l"], node, s["r"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's to the root's, left to right."""
    return _h(F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"]))))


def _ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``r``, a row's place (from 0) within its ``g`` by ``order``, and ``n``, the rows of ``g``. A group may span many
    range partitions: places are counted per (partition, group), and only those counts are summed along a group."""
    cols = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = stored(nodes.repartitionByRange(*cols).sortWithinPartitions(*cols)
                    .withColumns({"pid": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}), name)
    parts = ranged.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("c"), F.min("mid").alias("first"))
    along = Window.partitionBy("g")
    parts = parts.select("pid", "g", "first", F.sum("c").over(along).alias("n"), (F.sum("c").over(along.orderBy("pid")) - F.col("c")).alias("before"))
    return ranged.join(parts, ["pid", "g"]).withColumn("r", F.col("before") + F.col("mid") - F.col("first")).drop("pid", "mid", "first", "before")


def _blocks(nodes: DataFrame, members: bool, name: str) -> DataFrame:
    """One row per aligned block of 256 nodes: its levels ``l0``, ``l1`` and what it ends in, ``top``."""
    b = F.floor(F.col("r") / BLOCK).alias("b")
    rows = F.struct("r", "h", *(["member"] if members else []))
    got = nodes.groupBy("g", b).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(rows)).alias("rows"))
    got = got.select("g", "b", "n", F.array_join(F.col("rows.h"), "").alias("l0"), *([F.col("rows.member").alias("members")] if members else []))
    # parents of the runs; levels go on while the whole group has several nodes
    got = got.withColumn("l1", F.when(F.col("n") > RUN, F.array_join(F.transform(_runs(F.col("l0")), lambda i: _h(_run(F.col("l0"), i))), "")))
    top = F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= RUN, _h(F.col("l0"))).otherwise(_h(F.col("l1")))
    return stored(got.withColumn("top", top), name)


def _tree(nodes: DataFrame, members: bool, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks over ``nodes`` (g, r, n, h[, member]), and each group's root (``g``, ``top``)."""
    rounds, ends = [], None
    while True:
        blocks = _blocks(nodes, members and not rounds, f"{name}-{len(rounds)}")
        rounds.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("g", "top")
        ends = done if ends is None else ends.unionByName(done)
        nodes = blocks.where(F.col("n") > BLOCK).select("g", F.col("b").alias("r"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("h"))
        if (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:   # one number per round; rounds: log256 of the largest group
            return rounds, ends


def _up(blocks: DataFrame) -> DataFrame:
    """Nodes of ``blocks`` (with ``path``, from the block's top to the root) with their own paths, a run of 16 at a time."""
    l0, l1 = F.col("l0"), F.col("l1")
    runs = blocks.select("*", F.explode(_runs(l0)).alias("i"))
    over = F.when(F.col("n") > RUN, F.array(_flank(l1, F.col("i")))).otherwise(F.array().cast(_PATH))
    runs = runs.withColumns({"run": _run(l0, F.col("i")), "path": F.concat(over, F.col("path"))}).drop("l0", "l1", "top")
    nodes = runs.select("*", F.explode(F.sequence(F.lit(0), _nodes(F.col("run")) - 1)).alias("j"))
    own = F.when(F.col("n") > 1, F.array(_flank(F.col("run"), F.col("j")))).otherwise(F.array().cast(_PATH))
    place = F.col("i") * RUN + F.col("j")
    out = nodes.select("g", (F.col("b") * BLOCK + place).alias("r"), "subroot", F.concat(own, F.col("path")).alias("path"),
                       F.substring(F.col("run"), F.col("j") * WIDTH + 1, F.lit(WIDTH)).alias("h"),
                       *([F.get("members", place).alias("member")] if "members" in blocks.columns else []))
    return out


def _down(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Paths of the lowest round's nodes; ``ends`` has ``g``, ``subroot`` and ``path`` for each group's root."""
    above = None
    for blocks in reversed(rounds):
        whole = blocks.where(F.col("n") <= BLOCK).join(ends, "g")
        if above is not None:
            step = above.select("g", F.col("r").alias("b"), "subroot", "path")
            whole = whole.unionByName(blocks.where(F.col("n") > BLOCK).join(step, ["g", "b"]))
        above = _up(whole)
    return above


@dataclass
class Manifest:
    """A built tree. ``root`` is None over an empty table."""

    root: str | None
    rows: DataFrame

    def proofs(self) -> DataFrame:
        """A row of the table each: the kept columns as struct ``member``, ``leaf``, ``subroot``, ``path`` (siblings from leaf to root, each
        ``l`` and ``r``). ``fold(leaf, path)`` gives ``root`` if and only if the leaf is the one hashed in."""
        return self.rows


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """Builds the manifest of ``docs``: a leaf per row over ``fields``, a subtree per value of ``group``, rows by ``order`` in it.

    Null fields have a form of their own; a null group is a group and comes first, a null order value stands first; rows equal in group and order
    stand by their leaf, so equal tables have equal roots whatever their files (repeated rows each keep a leaf). Texts of any length are
    hashed whole. An empty table has root None and no rows. Only ``fields``, ``group``, ``order`` and ``keep`` (name to column of ``docs``, returned
    as struct ``member``) are read, so other columns may have any names."""
    # a name before each value keeps null apart and first, and the order bytewise
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    member = F.struct(*[c.alias(n) for n, c in (keep or {}).items()]) if keep else F.struct(F.lit(None).alias("none"))
    leaves = stored(docs.select(key.alias("g"), F.col(order).alias("o"), leaf(*[F.col(c) for c in fields]).alias("h"),
                                F.monotonically_increasing_id().alias("tie"), member.alias("member")), "leaves")
    rounds, tops = _tree(_ranked(leaves, ["o", "h", "tie"], "ranked").drop("o", "tie"), True, "blocks")
    groups = tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("h"))
    over, root = _tree(_ranked(groups, ["name"], "groups").select("g", "r", "n", "h", F.struct("name").alias("member")), True, "groups")
    root = root.first()
    top = root["top"] if root else None
    ends = over[0].sparkSession.range(1).select(F.lit("").alias("g"), F.lit(top).cast("string").alias("subroot"), F.array().cast(_PATH).alias("path"))
    ends = _down(over, ends).select(F.col("member.name").alias("g"), F.col("h").alias("subroot"), "path")
    return Manifest(top, _down(rounds, ends).select("member", F.col("h").alias("leaf"), "subroot", "path"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` and each row's proof, checked against a copy in which texts of every fifth CRC are lower-cased."""
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, leaf(*[lowered if c == "text" else F.col(c) for c in FIELDS]))
    m = build(documents(spark, sf_dir, *FIELDS), keep={"doc_id": F.col("doc_id"), "changed": changed})
    got = m.proofs().select("member.doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                            fold(F.coalesce("member.changed", "leaf"), F.col("path")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same from the contract's words: levels by recursion over all nodes, CRC-32 by its table (polynomial 0xEDB88320).
OP12_SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT i, v FROM bits WHERE k = 8),
crc(id, k, v) AS (
  SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents
  UNION ALL SELECT id, k + 1, xor(c.v >> 8, t.v) FROM crc c, crc_table t
  WHERE k < length(id::VARCHAR) AND t.i = xor(c.v, ascii(substr(id::VARCHAR, k + 1, 1))::BIGINT) & 255),
hit AS (SELECT id FROM crc WHERE k = length(id::VARCHAR) AND xor(v, 4294967295) % 5 = 0),
forms AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text FROM documents),
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low FROM forms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
nodes(lvl, g, pos, h, n) AS (
  SELECT 0, g, pos, h, count(*) OVER (PARTITION BY g) FROM ranked
  UNION ALL SELECT any_value(lvl) + 1, g, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY g, pos // 16),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, lvl FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM subroots
  UNION ALL SELECT any_value(lvl) + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM tops WHERE n > 1 GROUP BY pos // 16),
flanks AS (
  SELECT a.lvl, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.g = b.g AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY 1, 2, 3),
top_flanks AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY 1, 2),
steps AS (
  SELECT d.g, d.pos AS place, f.lvl, f.l, f.r FROM ranked d JOIN flanks f ON f.g = d.g AND f.pos = d.pos // (16 ** f.lvl)::BIGINT
  UNION ALL SELECT d.g, d.pos, s.lvl + f.lvl, f.l, f.r FROM ranked d JOIN subroots s ON s.g = d.g JOIN top_flanks f ON f.pos = s.pos // (16 ** f.lvl)::BIGINT),
folded(g, place, lvl, node) AS (
  SELECT g, pos, 0, CASE WHEN doc_id IN (SELECT id FROM hit) THEN low ELSE h END FROM ranked
  UNION ALL SELECT f.g, f.place, f.lvl + 1, sha256(s.l || f.node || s.r) FROM folded f JOIN steps s ON s.g = f.g AND s.place = f.place AND s.lvl = f.lvl),
ends AS (SELECT g, place, max_by(node, lvl) AS node FROM folded GROUP BY 1, 2),
proofs AS (SELECT g, place, string_agg(l || r, '' ORDER BY lvl) AS p FROM steps GROUP BY 1, 2)
SELECT d.doc_id, d.h AS leaf, s.h AS subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.node AS folded_root, e.node = t.h AS verified
FROM ranked d JOIN subroots s ON s.g = d.g JOIN ends e ON e.g = d.g AND e.place = d.pos LEFT JOIN proofs p ON p.g = d.g AND p.place = d.pos, (SELECT h FROM tops WHERE n = 1) t
"""
