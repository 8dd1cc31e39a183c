"""Prefix trie of conversations that share their first turns.

Conversations are rebuilt (head turns from the first conversation of their hundred, then
their own), and every prefix gets a digest: the exclusive-or of a 128-bit hash of each
turn and its place, so that prefixes are running aggregates and a very long
conversation is worked on in segments.  ``minima`` holds for each digest its smallest
conversation, which owns the node.  A conversation that owns a prefix owns all longer
ones of its own, so its first owned depth is found by binary search: in rounds of halved
strides all conversations probe one depth each, the smallest prober of each digest is
joined with the minima, and who isn't the owner moves on by the stride.  A round's
probes are at depths with the same count of trailing zero bits, so that all rounds
together read each prefix and each minimum once.

The nodes that a conversation owns are a chain; chains hang on the node above their
first one and so form the tree.  Leaves and saved tokens are added up bottom-up by
chains: in each round every chain hands what it has gathered to the ancestor twice as
far up, which takes as many rounds as the nesting of chains has binary digits.  Running
sums from a chain's end then give each of its nodes.

Nothing is keyed by what many conversations share without being pre-aggregated or split
(``join_hot``), and no conversation, however long, is one task's: turns are numbered
by a range partitioning with carried counts, and segments hold ``SEGMENT`` turns.  The
ids of the conversations that end at a node are hashed from streamed pieces.

Defined cases: rows without conv_id belong to no conversation and go; null role or text
is the empty one; null turns come first, equal turns are ordered by the MD5 of role and
text; repeated rows are turns of their own; a conversation that is left without turns
is a member of the root only; a remainder takes the sign of a negative conv_id; an empty
table has no conversation, no root and gives no rows; texts of any length only enter by
their digest and count of code points; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_hot, saved, shuffle_partitions, tidy

#: Head turns are fewer than this; conversations of a block share their heads.
HEADS, BLOCK = 6, 100
#: Depths in a segment of a running aggregate.
SEGMENT = 1024
#: Bytes of a piece of the ids of conversations that end at one node.
PIECE = 1 << 20

_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), x (MD5 of role and text), n (code points of the text).

    A range partitioning deals a conversation of any length over tasks; numbers are
    counted within a task's part and carried over to the next."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    x = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", x.alias("x"), F.length(text).cast("long").alias("n"))
    place = [F.asc_nulls_first("turn"), F.asc("x")]
    # many equal rows are no one task's either
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", *place, "salt")
    dealt = saved(ranged.drop("salt").withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a part can continue one conversation only: there are fewer of these rows than parts
    carried = dealt.groupBy("conv_id", "part").count().withColumn("before", F.sum("count").over(before)).filter("before IS NOT NULL").select("conv_id", "part", "before")
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*place)).cast("long")
    return dealt.withColumn("at", at).join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "x", "n")


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (hashes of turn and depth), n of the rebuilt conversations;
    ``convs``: conv_id, own (count of turns), h, head, taken."""
    # the rows of a long conversation meet their conversation's row by segments
    shift = convs.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {SEGMENT}"))).alias("seg"))
    own = turns.withColumn("seg", F.expr(f"at div {SEGMENT}")).join(shift, ["conv_id", "seg"]).filter("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "x", "n")
    first = turns.filter(F.col("at") < HEADS).withColumnRenamed("conv_id", "head")
    heads = convs.filter("taken > 0").select("conv_id", "head", "taken").join(first, "head").filter("at <= taken").select("conv_id", F.col("at").alias("depth"), "x", "n")
    lanes = [F.xxhash64(F.lit(1), "depth", "x").alias("a"), F.xxhash64("x", F.lit(2), "depth").alias("b")]
    return own.unionByName(heads).select("conv_id", "depth", *lanes, "n")


def running(rows: DataFrame, columns: list[str], total, plus, backward: bool = False) -> DataFrame:
    """``rows`` (a written table with conv_id, depth) with each column's aggregate over
    the conversation up to its depth, or, backward, from it on."""
    order = F.desc if backward else F.asc
    cut = rows.withColumn("seg", F.expr(f"depth div {SEGMENT}"))
    inside = Window.partitionBy("conv_id", "seg").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy(order("seg")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("conv_id", "seg").agg(*[total(c).alias(c) for c in columns])
    carried = totals.select("conv_id", "seg", *[total(F.col(c)).over(before).alias(f"{c}_before") for c in columns]).filter(F.col(f"{columns[0]}_before").isNotNull())
    out = cut.withColumns({c: total(F.col(c)).over(inside) for c in columns}).join(carried, ["conv_id", "seg"], "left")
    return out.withColumns({c: plus(F.col(c), F.coalesce(f"{c}_before", F.lit(0).cast("long"))) for c in columns}).drop("seg", *[f"{c}_before" for c in columns])


def _level(depth: Column) -> Column:
    """Trailing zero bits of a depth."""
    return F.bit_count(depth.bitwiseAND(-depth) - 1)


def first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame, longest: int) -> DataFrame:
    """conv_id, first: the least depth whose prefix the conversation owns, or one more
    than its turns."""
    state = convs.select("conv_id", F.lit(0).cast("long").alias("below"))
    for k in reversed(range(longest.bit_length())):
        probe = state.select("conv_id", (F.col("below") + (1 << k)).alias("depth"))
        probes = prefixes.filter(F.col("level") == k).join(probe, ["conv_id", "depth"]).select("conv_id", "a", "b")
        smallest = probes.groupBy("a", "b").agg(F.min("conv_id").alias("owner"))
        owners = smallest.join(minima.filter(F.col("level") == k).select("a", "b", "owner"), ["a", "b", "owner"]).select(F.col("owner").alias("conv_id"))
        moved = probes.select("conv_id").join(owners, "conv_id", "left_anti").withColumn("step", F.lit(1 << k).cast("long"))
        state = saved(state.join(moved, "conv_id", "left").select("conv_id", (F.col("below") + F.coalesce("step", F.lit(0).cast("long"))).alias("below")), "owned")
    return state.select("conv_id", (F.col("below") + 1).alias("first"))


def chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """conv_id, leaves, tokens of each chain with all chains below it; ``chains``:
    conv_id, parent (null for the root's), leaves and tokens of its own."""
    sums = saved(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "tokens"), "chains")
    while sums.filter("up IS NOT NULL").limit(1).count():
        given = sums.filter("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("tokens").alias("more_tokens")).withColumnRenamed("up", "conv_id")
        far = saved(sums.filter((F.col("up") != root) & F.col("up").isNotNull()).select("conv_id", "up"), "far")
        hop = join_hot(far, sums.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up").select("conv_id", "next")
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c)
        sums = saved(sums.join(given, "conv_id", "left").join(hop, "conv_id", "left").select("conv_id", F.col("next").alias("up"), more("leaves"), more("tokens")), "chains")
    return sums.drop("up")


def _pieces(batches):
    """Sorted (a, b, conv_id) to (a, b, first, ids): comma-joined ids of one node, in pieces."""
    key, first, held, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (first, pa.int64()), (",".join(held), pa.string()))], ["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != key or size > PIECE:
                if held:
                    yield piece()
                key, first, held, size = (a, b), conv_id, [], 0
            held.append(str(conv_id))
            size += len(held[-1])
    if held:
        yield piece()


def _hashed(batches):
    """Sorted (a, b, first, ids) to (a, b, ends_sha256)."""
    key, sha, done = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (a, b) == key:
                sha.update(b",")
            else:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256()
            sha.update(ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), ["a", "b", "ends_sha256"])
            done = []
    if key:
        done.append((*key, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), ["a", "b", "ends_sha256"])


def ends(whole: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of each digest that a conversation ends with."""
    n = shuffle_partitions(whole.sparkSession)
    by = ["a", "b", "conv_id"]
    pieces = whole.select(by).repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_pieces, "a long, b long, first long, ids string")
    by = ["a", "b", "first"]
    return pieces.repartition(n, "a", "b").sortWithinPartitions(*by).mapInArrow(_hashed, "a long, b long, ends_sha256 string")


@tidy
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: see the contract of op12."""
    spark = conversations.sparkSession
    turns = saved(numbered_turns(conversations), "numbered")
    own = saved(turns.groupBy("conv_id").agg(F.max("at").alias("own")), "lengths")
    head = F.col("conv_id") - F.col("conv_id") % BLOCK
    listed = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEADS, "head": head})
    convs = listed.join(own.select(F.col("conv_id").alias("head"), F.col("own").alias("there")), "head", "left")
    convs = saved(convs.select("conv_id", "own", "h", "head", F.least("h", F.coalesce("there", F.lit(0).cast("long"))).alias("taken")), "convs")
    rebuilt = saved(rebuilt_turns(turns, convs), "rebuilt")
    ended = rebuilt.groupBy("conv_id").agg(F.count("*").alias("len"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = saved(convs.select("conv_id").join(ended, "conv_id", "left").fillna(0), "whole")
    root, longest, n = whole.agg(F.min("conv_id"), F.max("len"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], _OUT)

    marked = running(rebuilt, ["a", "b"], F.bit_xor, Column.bitwiseXOR).withColumn("level", _level(F.col("depth")))
    prefixes = saved(marked.sortWithinPartitions("level"), "prefixes")
    nodes = prefixes.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n").alias("n"), F.max("depth").alias("depth"), F.max("level").alias("level"))
    minima = saved(nodes.sortWithinPartitions("level"), "minima")

    # chains: the depths from top to len that a conversation owns, and where they hang
    top = F.when(F.col("conv_id") == root, 0).otherwise(F.col("first"))
    chains = saved(first_owned(prefixes, minima, whole, longest).join(whole.select("conv_id", "len"), "conv_id").select("conv_id", top.cast("long").alias("top"), "len").filter("top <= len"), "first-owned")
    node = F.struct("a", "b").alias("node")
    hung = saved(chains.filter("top > 1").join(prefixes.select("conv_id", (F.col("depth") + 1).alias("top"), node), ["conv_id", "top"]), "hung")
    above = join_hot(hung, minima.select(node, F.col("owner").alias("parent")), "node").select("conv_id", "parent")
    parent = F.when(F.col("top") == 1, root).otherwise(F.col("parent"))
    chains = saved(chains.join(above, "conv_id", "left").select("conv_id", "top", "len", parent.alias("parent")), "hanging")

    hanging = chains.filter("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"), F.col("conv_id").alias("chain"))
    saves = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("n")).alias("tokens"))
    full = hanging.select("conv_id", F.col("depth").alias("len")).distinct().withColumn("more", F.lit(True))
    of_own = chains.join(saves, "conv_id", "left").join(full, ["conv_id", "len"], "left")
    totals = chain_totals(of_own.select("conv_id", "parent", F.when(F.col("more"), 0).otherwise(1).cast("long").alias("leaves"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens")), root)

    # nodes: what hangs on them, their chain's ends, sums from the chain's end up
    below = hanging.join(totals.withColumnRenamed("conv_id", "chain"), "chain").groupBy("conv_id", "depth").agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    zero = F.lit(0).cast("long")
    at_root = whole.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).select(zero.alias("a"), zero.alias("b"), "owner", "n_convs", zero.alias("n"), zero.alias("depth"))
    rows = minima.drop("level").unionByName(at_root).withColumnRenamed("owner", "conv_id")
    rows = rows.join(below, ["conv_id", "depth"], "left").join(chains.select("conv_id", F.col("top").alias("depth"), "parent", F.lit(True).alias("is_top")), ["conv_id", "depth"], "left").join(chains.select("conv_id", F.col("len").alias("depth"), F.lit(1).alias("is_last")), ["conv_id", "depth"], "left").join(ends(whole), ["a", "b"], "left")
    hung = F.coalesce("hung", zero)
    leaf = F.when(F.col("is_last").isNotNull() & (hung == 0), 1).otherwise(0)
    rows = rows.select(
        "conv_id",
        "depth",
        F.when(F.col("is_top").isNull(), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (hung + F.when(F.col("is_last").isNull(), 1).otherwise(0)).alias("n_children"),
        (F.coalesce("leaves", zero) + leaf).alias("n_leaves"),
        (F.coalesce("tokens", zero) + (F.col("n_convs") - 1) * F.col("n")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    out = running(saved(rows, "nodes"), ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b, backward=True)
    return out.select(*[c.split()[0] for c in _OUT.split(", ")])


def query(spark, sf_dir):
    """op12_conversation_trie: see the contract."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BIT = "xor(v >> 1, 3988292384 * (v & 1))"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, s: list_reduce(list_prepend(xor(c, s), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: {_BIT})))"""
ORACLE_SQL = f"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos, x, n
  FROM (SELECT conv_id, turn, md5(strlen(role)::VARCHAR || ':' || role || text) AS x, length(text) AS n FROM said)
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT c.conv_id, t.pos, t.x, t.n FROM convs c JOIN turns t ON t.conv_id = c.head AND t.pos <= c.h
), taken AS (SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id),
rebuilt AS (
  SELECT conv_id, pos AS depth, x, n FROM heads
  UNION ALL SELECT t.conv_id, t.pos - c.h + coalesce(k, 0), t.x, t.n FROM turns t JOIN convs c ON c.conv_id = t.conv_id LEFT JOIN taken ON taken.conv_id = t.conv_id WHERE t.pos > c.h
), prefixes AS MATERIALIZED (
  SELECT conv_id, depth, n, array_to_string(list(x) OVER (PARTITION BY conv_id ORDER BY depth), ',') AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS MATERIALIZED (
  SELECT key, depth, min(conv_id) AS owner, count(*) AS n_convs, max(n) AS n FROM prefixes GROUP BY key, depth
), lens AS (SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id),
up AS MATERIALIZED (
  SELECT c.key, p.key AS above, p.owner AS parent FROM nodes c JOIN prefixes f ON f.conv_id = c.owner AND f.depth = c.depth - 1 JOIN nodes p ON p.key = f.key
), children AS (SELECT above AS key, count(*) AS n_children FROM up GROUP BY above),
gathered AS (
  SELECT p.key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * d.n)::BIGINT AS saved_tokens
  FROM nodes d JOIN prefixes p ON p.conv_id = d.owner AND p.depth <= d.depth LEFT JOIN children ON children.key = d.key GROUP BY p.key
), ended AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM prefixes JOIN lens USING (conv_id) WHERE depth = len GROUP BY key
)
SELECT owner AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens,
  coalesce(sha, '{hashlib.sha256().hexdigest()}') AS ends_sha256
FROM nodes LEFT JOIN up USING (key) LEFT JOIN children USING (key) JOIN gathered USING (key) LEFT JOIN ended USING (key)"""
