"""Merkle manifest of a dataset: one tree per group, their roots joined in one tree, and a proof for every row.

Every digest is a lowercase hexadecimal sha256; a parent is the digest of its children's digests as text, side by side. A
level's nodes are numbered within their group, and every `arity` consecutive ones form a run (the last may be shorter, even
one node). A level is one equijoin of the nodes with themselves: a node meets the siblings whose indices follow from its
own (index XOR 1 in a binary tree, otherwise the other slots of its run), and then the rows of slot zero emit the parents.
What a node has met is stored, so going down again every node takes its parent's path and puts its own siblings before it.
Rows of a level shrink by `arity`, so all levels together move little more than the leaves.

Leaves get their numbers without a window over a group: the digests are range-sorted by group and order, and a row's number
is its place in its partition plus the rows of the partitions before it. A group that holds most rows is thus spread like
any other, and so are rows that agree in all columns, which a running number keeps apart. Texts are read once, by the task
that hashes them; only digests are shuffled. Each level is a written table, so a lost executor costs no more than one level.

Defined cases: a null group is a group of its own and comes first; rows of one id, or with a null one (first), are ordered
by their leaf; equal rows are leaves each and get proofs of their own; an empty table has no tree. A group of one row is
its own subroot, and a dataset of one group has that subroot as its root. A result column whose name the input has gets an
underscore behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames
from .components import stored
from .ordering import positions

#: Siblings to the left and to the right of a node in its run, as one text each.
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that cannot be taken for another: its length in bytes, a colon, the value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with what stands left and right of it in its run: `nodes` joined with itself by the siblings' indices."""
    slot = F.pmod(F.col("_index"), F.lit(arity))
    if arity == 2:
        others = [F.col("_index").bitwiseXOR(F.lit(1).cast("long"))]
    else:
        others = [F.col("_index") - slot + F.pmod(slot + k, F.lit(arity)) for k in range(1, arity)]
    out = nodes
    for k, other in enumerate(others):
        met = nodes.select(F.col("_tree").alias(f"_t{k}"), F.col("_index").alias(f"_i{k}"), F.col("_digest").alias(f"_d{k}"))
        out = out.join(met, (F.col("_tree") == F.col(f"_t{k}")) & (other == F.col(f"_i{k}")), "left")
    met = F.array_sort(F.array(*[F.struct(F.col(f"_i{k}").alias("i"), F.col(f"_d{k}").alias("d")) for k in range(len(others))]))

    def side(wanted):
        return F.array_join(F.transform(F.filter(met, wanted), lambda s: s["d"]), "")
    step = F.struct(side(lambda s: s["i"] < F.col("_index")).alias("left"), side(lambda s: s["i"] > F.col("_index")).alias("right"))
    return out.select(*nodes.columns, step.alias("_step"))


def _parents(met: DataFrame, arity: int) -> DataFrame:
    """The rows of slot zero, each as its run's parent."""
    return met.where(F.pmod("_index", F.lit(arity)) == 0).select(
        "_tree", F.expr(f"_index div {arity}").alias("_index"), F.expr(f"(_size + {arity - 1}) div {arity}").alias("_size"),
        digest(F.col("_digest"), F.col("_step.right")).alias("_digest"))


def forest(leaves: DataFrame, longest: int, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves (_tree, _index, _size, _digest, and others on the lowest level only), each
    with its nodes' siblings, and the top of each tree: _tree, _height, _digest. A tree of one leaf has no level.
    `longest` is the largest size."""
    levels, nodes, tops = [], leaves, []
    while True:
        tops.append(nodes.where("_size = 1").select("_tree", F.lit(len(levels)).alias("_height"), "_digest"))
        if longest <= 1:
            return levels, reduce(DataFrame.union, tops)
        levels.append(stored(_siblings(nodes.where("_size > 1"), arity), "level"))
        nodes, longest = _parents(levels[-1], arity), -(-longest // arity)


def paths(levels: list[DataFrame], tops: DataFrame, arity: int = 2) -> DataFrame | None:
    """The nodes of the lowest level with `_path`, their siblings from the bottom up, followed by the path that `tops` (_tree,
    _height, _digest, _path) have for their tree, and `_top`, the digest of their tree. None if there is no level."""
    below = None
    for height in range(len(levels) - 1, -1, -1):
        own = levels[height]
        up = tops.where(F.col("_height") == height + 1).select(F.col("_tree").alias("_t"), F.lit(0).cast("long").alias("_i"),
                                                               F.col("_path").alias("_up"), F.col("_digest").alias("_top"))
        if below is not None:
            up = up.unionByName(below.select(F.col("_tree").alias("_t"), F.col("_index").alias("_i"), F.col("_path").alias("_up"), "_top"))
        below = own.join(up, (F.col("_tree") == F.col("_t")) & (F.expr(f"_index div {arity}") == F.col("_i"))).select(
            *[c for c in own.columns if c != "_step"], F.concat(F.array("_step"), "_up").alias("_path"), "_top")
        if height and height % 8 == 0:
            below = stored(below, "paths")
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """The siblings of all levels, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(rows: DataFrame, leaf: str, row_id: str = "doc_id", group: str = "lang", arity: int = 2) -> DataFrame:
    """The columns of `rows`, where `leaf` holds each row's digest, and subroot (of the row's group), root, and path: an
    array of (left, right), the siblings' digests from the leaf up. Groups are ordered by their name, null first, rows by
    `row_id` within a group."""
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    spark, others = rows.sparkSession, [c for c in rows.columns if c != leaf]
    rest = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")])
    hashed = stored(rows.select(F.col(f"`{group}`").alias("_group"), F.col(f"`{row_id}`").alias("_id"), F.col(f"`{leaf}`").alias("_digest"),
                                rest.alias("_rest"), F.monotonically_increasing_id().alias("_nth")), "hashed")
    placed = positions(hashed, [F.col(c) for c in ("_group", "_id", "_digest", "_nth")])
    groups = stored(placed.groupBy("_group").agg(F.min("_at").alias("_tree"), F.count("*").alias("_size")), "groups")
    n_groups, longest = groups.agg(F.count("*"), F.max("_size")).first()
    leaves = stored(placed.join(groups.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g")))
                    .select("_tree", (F.col("_at") - F.col("_tree")).alias("_index"), "_size", "_digest", "_rest"), "leaves")
    levels, tops = forest(leaves, longest or 0, arity)

    # A tree's number is the place of its first leaf, so trees are in the order of their groups.
    subroots = stored(positions(tops, [F.col("_tree")]).select(
        F.lit(0).cast("long").alias("_tree"), F.col("_at").alias("_index"), F.lit(n_groups).cast("long").alias("_size"), "_digest",
        F.struct("_tree", "_height").alias("_of")), "subroots")
    upper, top = forest(subroots, n_groups, arity)
    top = top.first()  # one digest
    root, end = top and top["_digest"], F.array().cast(f"array<{STEP}>")
    crown = spark.range(1).select(F.col("id").alias("_tree"), F.lit(len(upper)).alias("_height"), F.lit(root).alias("_digest"), end.alias("_path"))
    over = paths(upper, crown, arity) if upper else subroots.withColumn("_path", end)
    tops = stored(over.select("_of.*", "_digest", "_path"), "tops")

    # The row of a group of one is its tree's top.
    single = leaves.where("_size = 1").join(tops.select("_tree", "_path", F.col("_digest").alias("_top")), "_tree")
    proven = single.select("_digest", "_rest", "_path", "_top")
    if levels:
        proven = proven.unionByName(paths(levels, tops, arity).select("_digest", "_rest", "_path", "_top"))
    out = proven.select("_rest", F.col("_digest").alias(leaf), F.col("_top").alias("subroot"), F.lit(root).cast("string").alias("root"), F.col("_path").alias("path"))
    kept = [F.col(f"`{c}`") if c == leaf else F.col("_rest")[c].alias(c) for c in rows.columns]
    return out.select(*kept, *frames.unless_taken(rows, "subroot", "root", "path"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(n_chars):
        return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"),
                       F.when(tampered, leaf(F.try_add("n_chars", F.lit(1)))).alias("tampered"))
    out = manifest(rows, "leaf").withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the text of `{0}` in SQL: eight steps for every byte, the byte joining the first of them.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''),
  lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, source, n_chars, text, CASE WHEN CRC % 7 = 0 THEN 1 ELSE 0 END AS more FROM documents),
raw AS (
  SELECT doc_id, lang, LEAF(n_chars) AS leaf, LEAF(n_chars + more) AS found FROM docs),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM raw),
nodes AS (
  SELECT g, 0 AS level, i, size, leaf AS digest FROM numbered
  UNION ALL
  SELECT g, any_value(level) + 1, i // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE size > 1 GROUP BY g, i // 2),
subroots AS (SELECT g, level AS height, digest FROM nodes WHERE size = 1),
upper AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM subroots) AS size, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE size > 1 GROUP BY i // 2),
folds AS (
  SELECT n.g, n.i AS nth, 0 AS step, n.i AS i, n.found AS digest, '' AS proof FROM numbered n
  UNION ALL
  SELECT f.g, f.nth, f.step + 1, CASE WHEN f.step + 1 = s.height THEN f.g ELSE f.i // 2 END,
    sha256(CASE WHEN f.i % 2 = 1 THEN coalesce(n.digest, u.digest) || f.digest ELSE f.digest || coalesce(n.digest, u.digest, '') END),
    f.proof || coalesce(n.digest, u.digest, '')
  FROM folds f JOIN subroots s ON s.g = f.g
    LEFT JOIN nodes n ON f.step < s.height AND n.g = f.g AND n.level = f.step AND n.i = xor(f.i, 1)
    LEFT JOIN upper u ON f.step >= s.height AND u.level = f.step - s.height AND u.i = xor(f.i, 1)
  WHERE f.step < s.height + (SELECT max(level) FROM upper))
SELECT n.doc_id, n.leaf, s.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM numbered n JOIN subroots s ON s.g = n.g JOIN upper r ON r.size = 1
  JOIN folds f ON f.g = n.g AND f.nth = n.i AND f.step = s.height + (SELECT max(level) FROM upper)
"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
for _n in ("n_chars + more", "n_chars"):
    ORACLE = ORACLE.replace(f"LEAF({_n})", "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", f"({_n})", "text")) + ")")
ORACLE = ORACLE.replace("CRC", CRC32.format("doc_id"))
