"""Prefix trie of conversations: which beginnings they share, how often, and what sharing them saves.

A node of depth d is a distinct sequence of the first d turns (role, text); the root is the empty one. Conversations are
cut into blocks of `block` turns. A block's digest covers its turns, and the digest of a prefix of whole blocks follows from
those of the blocks before it, in groups of bounded width (`prefixes`): a conversation of any length is no long chain.
Equal blocks behind equal prefixes are one entry, with its smallest conversation and its number of conversations, so
copies of a conversation, however many, fold where they are read. Only where several entries follow one prefix, siblings
that diverge somewhere in the block, are turn boundaries looked at: their beginnings of 1, 2, ... turns are digested and
grouped once more. A block without siblings is a run of nodes that need no digests.

A node belongs to its smallest conversation, so the nodes of a conversation are the end of its path: a chain, hung on a node
of a smaller conversation. Sums over subtrees are sums over the tree of chains, by pointers that double their reach in every
round, and then sums along each chain, cut into stretches so that a very long conversation is many tasks.

Turns get their numbers by a range sort, not by a window over a conversation. Ids that end at one node are joined to pieces of
bounded size in parallel; a digest over them, which is sequential by nature, streams through these pieces.

Defined cases: null roles and texts are empty; turns of a conversation are ordered by turn, null first, then role and text,
and equal ones count each; rows without a conversation id take no part; an empty table has no node; other columns of the
input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored
from .merkle import CRC32
from .ordering import positions

#: Turns in a block; blocks, or groups of them, digested together; turns of a chain summed together.
BLOCK, WIDTH, STRETCH = 4, 64, 4096
#: Characters of ids in a piece of a list.
PIECE = 1 << 16


def _hash(*parts: Column) -> Column:
    """A digest of 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _root() -> Column:
    """The digest of the prefix without turns."""
    return F.lit("root").cast("binary")


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))


def numbered(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns (c, digest, chars, _at: their place among all), and conversations (c, first: the place of its first turn, n)."""
    r = rows.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"), F.monotonically_increasing_id().alias("nth"))
    digest = _hash(*[p.cast("binary") for p in (F.octet_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x"))])
    turns = positions(r, [F.col(k) for k in ("c", "t", "r", "x", "nth")], ["c", digest.alias("digest"), F.char_length("x").alias("chars")])
    return turns, turns.groupBy("c").agg(F.min("_at").alias("first"), F.count("*").alias("n"))


def rebuilt(turns: DataFrame, conversations: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation begins with the first `head` turns of the conversation `base` (both follow from its id `c`; fewer if that
    has fewer, none if it is absent) and goes on with its own after the first `head`. A base gives at most `most` rows to
    each. Turns (c, at from 1, digest, chars, length) and conversations (c, length)."""
    wanted = conversations.select("*", base.alias("base"), head.cast("long").alias("head"))
    sizes = conversations.select(F.col("c").alias("base"), F.col("n").alias("there"))
    plan = wanted.join(sizes, "base", "left").withColumn("given", F.least("head", F.coalesce("there", F.lit(0))))
    plan = stored(plan.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "rebuilt")
    at = F.col("_at") - F.col("first") + 1
    placed = turns.join(plan.select("c", "first", "head", "given", "length"), "c").withColumn("at", at)
    own = placed.where("at > head").select("c", (F.col("at") - F.col("head") + F.col("given")).alias("at"), "digest", "chars", "length")
    heads = placed.where(F.col("at") <= most).select(F.col("c").alias("base"), "at", "digest", "chars")
    heads = heads.join(plan.where("given > 0").select("base", "c", "given", "length"), "base").where("at <= given")
    return own.unionByName(heads.select("c", "at", "digest", "chars", "length")), plan.select("c", "length")


def prefixes(items: DataFrame, most: int, width: int) -> DataFrame:
    """Items (c, j from 0, digest, item) with the digests `before` and `after` of their prefixes. Items are digested in groups of
    `width`; what precedes a group is the prefix of the groups before it, found alike. `most` is the largest j."""
    group = items.groupBy("c", F.expr(f"j div {width}").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("j", "digest", "item"))).alias("own"))
    start, end = _root(), F.lit(None).cast("binary")
    if most >= width:
        group = stored(group, "groups")
        whole = group.select("c", F.col("g").alias("j"), _hash(_joined(F.transform("own", lambda x: x["digest"]))).alias("digest"),
                             F.lit(0).alias("item"))
        above = prefixes(whole, most // width, width).select("c", F.col("j").alias("g"), "before", "after")
        group, start, end = group.join(above, ["c", "g"]), F.col("before"), F.col("after")
    empty = F.array().cast("array<struct<before:binary,after:binary>>")

    def step(a, x):
        after = F.coalesce(F.when(x["j"] % width == width - 1, end), _hash(a["now"], x["digest"]))
        return F.struct(after.alias("now"), F.concat(a["all"], F.array(F.struct(a["now"].alias("before"), after.alias("after")))).alias("all"))
    chain = F.aggregate("own", F.struct(start.alias("now"), empty.alias("all")), step)["all"]
    out = group.select("c", F.explode(F.arrays_zip(F.col("own"), chain.alias("found"))).alias("p"))
    return out.select("c", "p.own.j", "p.own.item", "p.found.before", "p.found.after")


def blocks(turns: DataFrame, longest: int, block: int, width: int) -> DataFrame:
    """Blocks (c, length, j, before, after, turns): `after` is the digest of the prefix that ends with the block."""
    cut = turns.groupBy("c", F.expr(f"(at - 1) div {block}").alias("j")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"), F.max("length").alias("length"))
    digests = F.transform("turns", lambda x: x["digest"])
    cut = cut.select("c", "j", _hash(_joined(digests)).alias("digest"), F.struct("length", "turns").alias("item"))
    known = prefixes(cut, (longest - 1) // block, width).select("c", "j", "before", "after", "item.*")
    return known.withColumn("after", F.when(F.size("turns") == block, F.col("after")).otherwise(
        _beginning(F.col("before"), digests)))


def _beginning(before: Column, digests: Column) -> Column:
    """The digest of a prefix that ends inside a block."""
    return _hash(before, F.lit("turns").cast("binary"), _joined(digests))


def nodes_of(entries: DataFrame, block: int) -> DataFrame:
    """Nodes (owner, length: its turns, depth, n_convs, chars, key, parent) of distinct blocks. Inside a block without siblings only
    the last node has a key and only the first a parent's: nothing else hangs there."""
    alone = entries.groupBy("before").agg(F.count("*").alias("siblings"), F.min("after").alias("after")).where("siblings = 1").select("after")
    plain = entries.join(alone, "after", "left_semi").select("c", "length", "n", "before", "after", F.size("turns").alias("size"), F.posexplode("turns"))
    plain = plain.select(F.struct("c", "length").alias("owner"), F.col("col.at").alias("depth"), F.col("n").alias("n_convs"), "col.chars",
                         F.when(F.col("pos") == F.col("size") - 1, F.col("after")).alias("key"),
                         F.when(F.col("pos") == 0, F.col("before")).alias("parent"))
    digests = F.transform("turns", lambda x: x["digest"])
    keys = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda t: F.when(t == F.size("turns"), F.col("after")).otherwise(
        _beginning(F.col("before"), F.slice(digests, F.lit(1), t))))
    diverging = entries.join(alone, "after", "left_anti").withColumn("keys", keys)
    turns = diverging.select("c", "length", "n", "before", "keys", F.posexplode("turns"))
    turns = turns.select(F.struct("c", "length").alias("owner"), F.col("col.at").alias("depth"), "n", "col.chars",
                         F.get("keys", F.col("pos")).alias("key"),
                         F.when(F.col("pos") == 0, F.col("before")).otherwise(F.get("keys", F.col("pos") - 1)).alias("parent"))
    # Turns, length and prefix follow from the key; the smallest conversation owns the node.
    split = turns.groupBy("key").agg(F.min("owner").alias("owner"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"),
                                     F.min("chars").alias("chars"), F.min("parent").alias("parent"))
    return plain.unionByName(split).select("owner.c", "owner.length", "depth", "n_convs", "chars", "key", "parent")


def totals(chains: DataFrame, root_owner: int, max_rounds: int = 64) -> DataFrame:
    """Chains (c, up: the chain they hang on, leaves, saved) with sums over all that hangs on them, at any distance."""
    state = stored(chains.select("c", "up", "leaves", "saved"), "sums")
    for _ in range(max_rounds):
        if state.where("up is not null").isEmpty():
            return state.drop("up")
        more = state.where("up is not null").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # Nothing is above the root's chain, on which most may hang.
        far = state.where(F.col("up") != root_owner).select(F.col("c").alias("of"), F.col("up").alias("via")).join(
            state.select(F.col("c").alias("via"), "up"), "via").select(F.col("of").alias("c"), "up")
        state = stored(state.drop("up").join(more.withColumnRenamed("up", "c"), "c", "left").join(far, "c", "left").select(
            "c", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "sums")
    raise RuntimeError(f"sums did not settle in {max_rounds} rounds")


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, c) to (key, first, ids): the ids of a key joined by commas, in pieces of about `size` characters."""
    key, first, ids, length = None, 0, [], 0
    out = []

    def flush():
        if ids:
            out.append((key, first, ",".join(ids)))
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or length >= size:
                flush()
                key, first, ids, length = k, c, [], 0
            ids.append(str(c))
            length += len(ids[-1]) + 1
        if out:
            yield _batch(out, [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
            out = []
    flush()
    yield _batch(out, [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (key, ends_sha256), one row for each key."""
    key, state, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield _batch(out, [("key", pa.binary()), ("ends_sha256", pa.string())])
        out = []
    if state is not None:
        yield _batch([(key, state.hexdigest())], [("key", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [f for f, _ in fields])


def id_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, c) to (key, ends_sha256): of the ids of each key, ascending, joined by commas."""
    cut = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(
        functools.partial(_pieces, size=piece), "key binary, first bigint, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def trie(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         base: Column | None = None, head: Column | None = None, most: int = 0, block: int = BLOCK, width: int = WIDTH,
         stretch: int = STRETCH, piece: int = PIECE) -> DataFrame:
    """One row per node: the smallest conversation of it (`conversation`), depth, parent_<conversation>, n_convs, n_children,
    n_leaves and saved_tokens (in its subtree), ends_sha256 (digest of the ids that end there).

    With `base` and `head`, columns over a conversation's id `c`, conversations are rebuilt first (see `rebuilt`).
    """
    turns, conversations = numbered(rows, conversation, turn, role, text)
    turns, lengths = rebuilt(turns, conversations, F.col("c") if base is None else base, F.lit(0) if head is None else head, most)
    count, owner, longest = lengths.agg(F.count("*"), F.min(F.struct("c", "length")), F.max("length")).first()
    cut = stored(blocks(turns, longest or 0, block, width), "blocks")
    entries = stored(cut.groupBy("after").agg(F.count("*").alias("n"), F.min(F.struct("c", "length", "before", "turns")).alias("e"))
                     .select("after", "n", "e.*"), "entries")
    nodes = nodes_of(entries, block)
    spark = rows.sparkSession
    if count:
        root = spark.range(1).select(F.lit(owner["c"]).cast("long").alias("c"), F.lit(owner["length"]).cast("long").alias("length"),
                                     F.col("id").alias("depth"), F.lit(count).cast("long").alias("n_convs"),
                                     F.lit(0).alias("chars"), _root().alias("key"), F.lit(None).cast("binary").alias("parent"))
        nodes = nodes.unionByName(root)
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    top_owner = owner["c"] if count else 0

    # Chains, and where they hang.
    chains = nodes.groupBy("c").agg(F.min(F.struct("depth", "parent")).alias("top"), F.max("length").alias("length"), F.sum("saved").alias("saved"))
    chains = chains.select("c", "length", "saved", F.col("top.depth").alias("top"), "top.parent")
    hung = chains.where("top > 1").join(nodes.where("key is not null").select(F.col("key").alias("parent"), F.col("c").alias("up")), "parent")
    chains = chains.where("top <= 1").withColumn("up", F.when(F.col("top") == 1, F.lit(top_owner).cast("long"))).unionByName(hung)
    chains = stored(chains.select("c", "length", "saved", "top", "up"), "chains")
    points = chains.where("up is not null").select(F.col("up").alias("c"), (F.col("top") - 1).alias("depth"), F.col("c").alias("chain"))
    ending = chains.join(points.select("c", F.col("depth").alias("length")).distinct(), ["c", "length"], "left_anti").select("c", F.lit(1).alias("leaf"))
    sums = totals(chains.join(ending, "c", "left").withColumn("leaves", F.coalesce("leaf", F.lit(0)).cast("long")), top_owner)
    sums = sums.select(F.col("c").alias("chain"), "leaves", "saved")
    hanging = points.join(sums, "chain").groupBy("c", "depth").agg(
        F.count("*").alias("hanging"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))

    keyed = nodes.where("key is not null").select("key", "c", "depth")
    last = cut.where(F.col("length") == F.element_at("turns", -1)["at"]).select(F.col("after").alias("key"), "c")
    none = lengths.where("length = 0").select(_root().alias("key"), "c")
    ends = id_digests(last.unionByName(none), piece).join(keyed, "key").drop("key")

    heads = chains.select("c", F.col("top").alias("depth"), "up", F.lit(True).alias("is_head"))
    zero = F.lit(0)
    known = nodes.select("c", "length", "depth", "n_convs", "saved").join(hanging, ["c", "depth"], "left") \
        .join(heads, ["c", "depth"], "left").join(ends, ["c", "depth"], "left").select(
        "c", "depth", F.when(F.col("is_head"), F.col("up")).otherwise(F.col("c")).alias("parent"), "n_convs",
        ((F.col("depth") < F.col("length")).cast("long") + F.coalesce("hanging", zero)).alias("n_children"),
        (F.col("saved") + F.coalesce("hung_saved", zero)).alias("saved"), F.coalesce("hung_leaves", zero).alias("leaves"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.expr(f"depth div {stretch}").alias("stretch"))
    known = known.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long"))

    # From each node down to the end of its chain: inside its stretch, and the stretches behind.
    inside = Window.partitionBy("c", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("c").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    known = stored(known, "known")
    stretches = known.groupBy("c", "stretch").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).select(
        "c", "stretch", F.coalesce(F.sum("s").over(behind), zero).alias("later_saved"), F.coalesce(F.sum("l").over(behind), zero).alias("later_leaves"))
    summed = known.withColumn("own_saved", F.sum("saved").over(inside)).withColumn("own_leaves", F.sum("leaves").over(inside)).join(stretches, ["c", "stretch"])
    return summed.select(F.col("c").alias(conversation), "depth", F.col("parent").alias(f"parent_{conversation}"), "n_convs", "n_children",
                         (F.col("own_leaves") + F.col("later_leaves")).alias("n_leaves"),
                         (F.col("own_saved") + F.col("later_saved")).alias("saved_tokens"), "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    return trie(rows, base=F.col("c") - F.col("c") % 100, head=head, most=5)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT c, c - c % 100 AS b, CRC % 6 AS h FROM (SELECT DISTINCT c FROM rows)),
parts AS (
  SELECT plan.c, 0 AS own, p, r, x FROM plan JOIN rows ON rows.c = plan.b AND p <= h
  UNION ALL SELECT plan.c, 1, p, r, x FROM plan JOIN rows ON rows.c = plan.c AND p > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, r, x FROM parts),
paths AS (
  SELECT c, d, length(x) AS chars, sha256(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM turns
  UNION ALL SELECT c, 0, 0, 'root' FROM plan),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT k, any_value(d) AS d, min(paths.c) AS m, count(*) AS n, any_value(chars) AS chars,
    string_agg(paths.c::VARCHAR, ',' ORDER BY paths.c) FILTER (d = lengths.n) AS ends
  FROM paths JOIN lengths USING (c) GROUP BY k),
parents AS (SELECT u.k, p.m AS parent_m, p.k AS parent_k FROM nodes u JOIN paths a ON a.c = u.m AND a.d = u.d - 1 JOIN nodes p ON p.k = a.k),
children AS (SELECT parent_k AS k, count(*) AS n_children FROM parents GROUP BY parent_k),
sums AS (
  SELECT a.k, count(*) FILTER (ch.k IS NULL) AS n_leaves, sum((u.n - 1) * u.chars) AS saved
  FROM nodes u LEFT JOIN children ch USING (k) JOIN paths a ON a.c = u.m AND a.d <= u.d GROUP BY a.k)
SELECT m AS conv_id, d AS depth, parent_m AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes LEFT JOIN parents USING (k) LEFT JOIN children USING (k) JOIN sums USING (k)
""".replace("CRC", CRC32.format("c"))
