"""A Merkle manifest of a dataset: a tree for each group over its ordered leaves, one tree over the groups' roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Settled, settle

#: Children of a node.
FAN = 8
#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """Bytes, a colon and the value; a dash for null: no two rows of values come out alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: str) -> Column:
    """A string that sorts as the group does by its UTF-8 bytes, with null as the least."""
    return F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, a row's place in its ``key`` by ``order``, and n, the rows of its key. Written to the shared folder.

    Rows are dealt by range and sorted inside their part, so a key may fill as many parts as it needs; the places of the
    parts come from their counts, of which there is one row per part and key. Rows equal in all of ``order`` are told
    apart by a number that deals them to several parts.
    """
    tie = F.monotonically_increasing_id()
    sort = ["key", *[F.col(c).asc_nulls_first() for c in order], "tie"]
    dealt = rows.withColumn("tie", tie).repartitionByRange(*sort).sortWithinPartitions(*sort)
    spot = F.monotonically_increasing_id()
    placed = Settled(dealt.drop("tie").withColumns({"part": F.shiftright(spot, 33), "spot": spot.bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    runs = placed.df.groupBy("key", "part").agg(F.min("spot").alias("least"), F.count("*").alias("size"))
    by_part = W.partitionBy("key").orderBy("part")
    starts = runs.select(
        "key", "part", F.sum("size").over(W.partitionBy("key")).alias("n"),
        (F.coalesce(F.sum("size").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("least")).alias("shift"),
    )
    out = settle(placed.df.join(starts, ["key", "part"]).withColumn("idx", F.col("spot") + F.col("shift")).drop("part", "spot", "shift"), "numbered")
    placed.drop()
    return out


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, idx, n, digest, ...) with up, the place of the parent, slot, left and right.

    left and right are the digests of the other children in one string each: lag and lead columns of fixed offsets,
    masked by the node's slot and by the length of its run, which is less than FAN only at the end of a level.
    """
    placed = nodes.withColumns({"up": F.floor(F.col("idx") / FAN).cast("long"), "slot": (F.col("idx") % FAN).cast("int")})
    placed = placed.withColumn("run", F.least(F.lit(FAN), F.col("n") - F.col("up") * FAN).cast("int"))
    run = W.partitionBy("key", "up").orderBy("idx")
    before = [F.when(F.col("slot") >= k, F.lag("digest", k).over(run)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < F.col("run"), F.lead("digest", k).over(run)) for k in range(1, FAN)]
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)}).drop("run")


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all keys, from the leaves (key, idx, n, digest) up. A key ends at the level where its n is 1.

    The first child of a run hashes the parent. Each level is written; it has an eighth of the rows of the one below it.
    """
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(levels[-1].where("n > 1").select("key", "idx", "n", "digest")).where("slot = 0")
        parent = first.select("key", F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))
        levels.append(settle(parent, "level"))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(key, digest): the root of each key."""
    found = [level.where("n = 1").select("key", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


STEP = "array<struct<left:string,right:string>>"


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest of ``levels`` with path, the left and right siblings at each step from a node up, and what ``above`` has more.

    ``above`` has key, path and other columns for the root of each key; a node's path ends with that path. A level is
    joined with the one over it by its parent, under which there are FAN rows at most, so no key is a hot one.
    """
    handed = [c for c in above.columns if c not in ("key", "path")]
    paths = None
    for k, level in reversed(list(enumerate(levels))):
        ended = level.where("n = 1").join(above, "key")
        if paths is not None:
            own = F.array(F.struct("left", "right")).cast(STEP)
            moved = with_siblings(level.where("n > 1")).join(paths, ["key", "up"]).withColumn("path", F.concat(own, "path"))
            ended = moved.drop("up", "slot", "left", "right").unionByName(ended)
        paths = ended.select("key", F.col("idx").alias("up"), "path", *handed) if k else ended
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, step by step, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def manifest(docs: DataFrame, group: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, path (left and right siblings at each step), and altered, the leaf of the tampered row.

    Leaves are digests of FIELDS. In each group they go by doc_id, nulls first, equal ids by their digests, so that the
    order of rows in files says nothing; rows that are alike throughout are leaves of their own. Groups go by their UTF-8
    bytes, null is a group and the first one. The subroot of a single leaf is the leaf, the root of a single group its
    subroot; then the path is short or empty. Texts are hashed whole; an empty text isn't a null one. A null id is never
    tampered with. An empty table gives an empty result; columns beyond FIELDS take no part.
    """
    narrow = docs.select(*FIELDS)
    changed = [tampered(F.col("doc_id"), F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    hashed = narrow.select(
        group_key(group).alias("key"), "doc_id", digest(*[framed(F.col(c)) for c in FIELDS]).alias("digest"), digest(*map(framed, changed)).alias("altered"),
    )
    leaves = Settled(hashed, "leaves")
    levels = climb(numbered(leaves.df, ["doc_id", "digest", "altered"]))
    leaves.drop()
    upper = climb(numbered(tops(levels).select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"]))
    whole = tops(upper).select("key", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    groups = settle(descend(upper, whole).select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"), "root"), "groups")
    return descend(levels, groups).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "altered")


def verified(docs: DataFrame, group: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per row of ``docs``; see ``manifest``.

    folded_root is what the tampered row's leaf and the siblings lead to; it is the root where nothing was changed.
    """
    found = manifest(docs, group)
    folded = found.withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


MANIFEST_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS g,
  sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')
    || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  source, n_chars, text FROM documents),
crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT for _ in range(8)]),
    lambda x, _z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
lv AS (SELECT g, doc_id, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n,
  CASE WHEN xor(crc.c, 4294967295::UBIGINT) % 3 = 0 THEN
  sha256(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')
    || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE leaf END AS altered
  FROM d LEFT JOIN crc USING (doc_id)),
up AS (SELECT g, 0 AS lvl, idx, n, leaf AS h FROM lv
  UNION ALL SELECT g, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY g, lvl, n, idx // 8),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, n, h FROM sub
  UNION ALL SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, n, idx // 8),
nodes AS (SELECT g, lvl, idx // 8 AS p, list(h ORDER BY idx) AS hs FROM up WHERE n > 1 GROUP BY g, lvl, idx // 8),
tops AS (SELECT lvl, idx // 8 AS p, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY lvl, idx // 8),
walk AS (SELECT row_number() OVER () AS r, g, 0 AS lvl, idx, altered AS h, '' AS proof FROM lv
  UNION ALL SELECT r, walk.g, walk.lvl + 1, walk.idx // 8,
    sha256(array_to_string(hs[:walk.idx % 8], '') || walk.h || array_to_string(hs[walk.idx % 8 + 2:], '')),
    proof || array_to_string(hs[:walk.idx % 8], '') || array_to_string(hs[walk.idx % 8 + 2:], '')
  FROM walk JOIN nodes ON nodes.g = walk.g AND nodes.lvl = walk.lvl AND nodes.p = walk.idx // 8),
done AS (SELECT r, g, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM walk GROUP BY r, g),
high AS (SELECT r, 0 AS lvl, sub.idx, done.h, proof FROM done JOIN sub USING (g)
  UNION ALL SELECT r, high.lvl + 1, high.idx // 8,
    sha256(array_to_string(hs[:high.idx % 8], '') || high.h || array_to_string(hs[high.idx % 8 + 2:], '')),
    proof || array_to_string(hs[:high.idx % 8], '') || array_to_string(hs[high.idx % 8 + 2:], '')
  FROM high JOIN tops ON tops.lvl = high.lvl AND tops.p = high.idx // 8),
fin AS (SELECT r, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM high GROUP BY r)
SELECT lv.doc_id, lv.leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(fin.proof) AS proof_sha256, fin.h AS folded_root,
  fin.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM (SELECT *, row_number() OVER () AS r FROM lv) lv JOIN sub USING (g) JOIN fin USING (r)
"""
