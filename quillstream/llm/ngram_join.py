"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

1.  Every text becomes its set of word shingles; texts with equal sets are one
    class, so that groups of copies are one row from here on.
2.  Shingles are dealt by ranges of their hashes, as packed blocks of a few
    million, and counted over all documents.  What comes back to a document are
    its shingles that some other document has; shingles of one document alone
    cannot match and only count.  Hot shingles (of which there can be no more than
    64 times the mean set size) are found beforehand, stay out of the dealing and
    rank last: those that have 1/64 of all documents in the batches of which they
    have 1/64.  So one that is dealt is in less than 2/64 of all documents (and
    less than two more for each batch of fewer than 128).
3.  Shingles are ranked by document frequency.  A document of n shingles with
    match count l has a prefix of n - ceil(0.8 n) + l; two similar documents
    share at least min(l, l') shingles of their prefixes.  Each document takes
    the l whose prefix costs least by the frequencies in it: touching the
    prefix's postings and verifying the postings / l candidates that remain.
4.  Candidates are verified exactly on the shared shingles.  First, for a few
    rounds, each document meets the one most often first among its prefix
    shingles; that links the members of a group of near copies to a few hubs.
    Then every pair that shares enough prefix shingles and is not yet in one
    component is verified, as packed lists of candidates in tasks of bounded size.
    So all candidate pairs are decided, but pairs of a group are never rows.
5.  Components of the links: tasks contract theirs to stars, and where those are too
    many for one task, labels propagate between them.

Shingles are known by hashes: sets by 128 bits, classes by 64, and shingles, when
counted and verified, by ``LOW_BITS`` and the bits of their range.  The result is
exact but for equal hashes of different shingles.

What it moves: a block sends a row to each range that it has shingles of, and a
range answers it with one.  A range without any gets none, so there are never more
rows than blocks have distinct shingles, in all no more than the corpus has words;
below that there are blocks times ranges of them.  The lists of candidates of
step 4 are packed numbers, as many as pairs of sets of different components that
share enough prefix shingles: sets that are alike but just not similar enough are
the worst case.

Defined cases: null, empty or wordless text has the empty set, is linked with
nothing and is its own component; a null ``doc_id`` never names a component
(one of only such rows has a null component_id); repeated rows are copies;
an empty table gives an empty result; extra columns are ignored by ``join`` and
carried through by ``one_of_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import squeeze_keys, unsqueeze_keys
from .components import components
from .memory import trimmed
from .shared import join_hot, release, replayable, row_key, saved, tidy
from .textnum import U, mix, shingle_set, windows, words_by_run

WORDS = 5
#: Similar: 100 * shared >= 80 * union.
PERCENT = 80
#: A shingle in more than one of so many documents is hot.
HOT = 64
#: Shingles in a block, and in a range, about.
BLOCK = 2_000_000
#: Match counts that a document may choose from; cost of a verification in postings.
MATCHES, VERIFY_COST = 4, 20.0
#: Bits of a shingle's hash below its range that are kept for counting and verifying.
LOW_BITS = 40
#: Keys of rows (16 bytes each) that are broadcast to leave rows out.
KEYS_AT_ONCE = 1_000_000


def sets_of(column):
    """(row, sorted distinct shingle hashes) for every row."""
    for a, b, w in words_by_run(column, lower=True):
        grams = windows(w.hashes, WORDS)
        for d in range(b - a):
            yield a + d, shingle_set(w.hashes, grams, w.first[d], w.first[d + 1], WORDS)


def _fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little", signed=True)


MEMBERS = "doc_id bigint, row_key struct<a:bigint,b:bigint>, node bigint, n bigint, token bigint, docs bigint"
_MEMBER_NAMES = [c.split()[0] for c in MEMBERS.split(", ")]


@trimmed
def _members(batches):
    """A row for each document, and one for each shingle in 1/HOT of a batch."""
    for batch in batches:
        nodes, sizes, parts = [], [], []
        for _, tokens in sets_of(batch.column(2)):
            nodes.append(_node(_fingerprint(tokens)) if len(tokens) else None)
            sizes.append(len(tokens))
            parts.append(tokens)
        n = len(nodes)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _MEMBER_NAMES)
        every = np.sort(np.concatenate([*parts, np.zeros(0, U)]))
        least = max(2, -(-n // HOT))
        if len(every) >= least:
            # sorted: a shingle with so many documents equals the one least - 1 places on
            often = np.unique(every[: len(every) - least + 1][every[: len(every) - least + 1] == every[least - 1 :]])
            count = np.searchsorted(every, often, side="right") - np.searchsorted(every, often)
            m = len(often)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, batch.column(1).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())] + [pa.array(often.view(np.int64)), pa.array(count)], _MEMBER_NAMES)


BLOCKS = "key bigint, block bigint, kind int, tokens binary, doc binary, extra binary"


def _blocks(ranges: int, hot: np.ndarray):
    """Shingles of distinct sets by range, and for each block a row with its documents."""
    edges = np.array([(r << 64) // ranges for r in range(ranges)], dtype=U)

    def flush(seen: dict, parts: list):
        order = np.argsort(np.array([_node(fp) for fp in seen], np.int64), kind="stable")
        fps = [list(seen)[i] for i in order]
        sets = [parts[i] for i in order]
        block = int.from_bytes(hashlib.blake2b(b"".join(fps), digest_size=8).digest(), "little", signed=True)
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="<u4"), sizes)
        at = np.searchsorted(hot, tokens)
        is_hot = (hot[np.minimum(at, len(hot) - 1)] == tokens) if len(hot) else np.zeros(len(tokens), bool)
        extra = np.array([_node(fp) for fp in fps], "<i8").tobytes() + sizes.astype("<i8").tobytes()
        rows = [(block % ranges, block, 1, tokens[is_hot].tobytes(), docs[is_hot].tobytes(), extra)]
        tokens, docs = tokens[~is_hot], docs[~is_hot]
        order = np.argsort(tokens)
        tokens, docs = tokens[order], docs[order]
        cut = np.append(np.searchsorted(tokens, edges), len(tokens))
        for r in np.flatnonzero(np.diff(cut)):
            t, d = tokens[cut[r] : cut[r + 1]] - edges[r], docs[cut[r] : cut[r + 1]]
            t = t >> U(max(0, 64 - LOW_BITS - int(np.log2(ranges))))
            wide = "<u4" if len(sets) > 65535 else "<u2"
            rows.append((int(r), block, 0 if wide == "<u2" else 2, squeeze_keys(t), d.astype(wide).tobytes(), b""))
        kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

    @trimmed
    def run(batches):
        seen, parts, total = {}, [], 0
        for batch in batches:
            for _, tokens in sets_of(batch.column(0)):
                if not len(tokens) or (fp := _fingerprint(tokens)) in seen:
                    continue
                seen[fp] = None
                parts.append(tokens)
                total += len(tokens)
                if total >= BLOCK:
                    yield flush(seen, parts)
                    seen, parts, total = {}, [], 0
        if seen:
            yield flush(seen, parts)

    return run


@trimmed
def _count(table: pa.Table) -> pa.Table:
    """Within a range: the shingles of at least two documents, with their frequency."""
    rows = table.to_pylist()
    tokens, sizes = [], []
    for r in rows:
        if r["kind"] != 1:
            tokens.append(unsqueeze_keys(r["tokens"]))
            sizes.append(len(tokens[-1]))
    every = np.concatenate([*tokens, np.zeros(0, U)])
    held = iter(tokens)
    order = np.argsort(every)
    s = every[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    df = np.empty(len(s), "<u4")
    df[order] = np.repeat(np.diff(np.append(starts, len(s))), np.diff(np.append(starts, len(s))))
    out, at = [], 0
    for r in rows:
        if r["kind"] == 1:
            out.append(r)
            continue
        mine = next(held)
        f = df[at : at + len(mine)]
        at += len(mine)
        keep = f > 1
        if keep.any():
            pick = lambda name, kind: np.frombuffer(r[name], kind)[keep].tobytes()  # noqa: E731, B023
            out.append(r | {"tokens": squeeze_keys(mine[keep]), "doc": pick("doc", "<u4" if r["kind"] == 2 else "<u2"), "extra": f[keep].tobytes()})
    return pa.Table.from_pylist(out, table.schema)


SETS = "node bigint, n bigint, matches int, shared binary, prefix array<bigint>"


def least_shared(n):
    """Shingles that a set of n shares at least with any similar set."""
    return -(-n * PERCENT // 100)


def choose_prefix(n: int, alone: int, df: np.ndarray) -> tuple[int, int]:
    """Match count and number of shared shingles in the prefix, by estimated cost.

    ``alone``: shingles of this document only, which rank first; ``df``:
    ascending frequencies of the others."""
    cost = np.concatenate([[0.0], np.cumsum(df - 1.0)])
    best, choice = None, (1, 0)
    for matches in range(1, min(MATCHES, least_shared(n)) + 1):
        k = min(len(df), max(0, n - least_shared(n) + matches - alone))
        c = cost[k] * (1 + VERIFY_COST / matches)
        if best is None or c < best:
            best, choice = c, (matches, k)
    return choice


def _assemble(ranges: int, hot_df: float):
    shift = max(0, 64 - LOW_BITS - int(np.log2(ranges)))

    @trimmed
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = [r for r in rows if r["kind"] == 1]
        if not head:
            raise RuntimeError("a block lost its documents: its input was read in another order by a repeated task; store the input first")
        n = len(head[0]["extra"]) // 16
        nodes, sizes = np.frombuffer(head[0]["extra"], "<i8", n), np.frombuffer(head[0]["extra"], "<i8", n, 8 * n)
        # a shingle's number: its hash without the bits that weren't kept; hot ones keep theirs apart
        doc, token, df = [np.frombuffer(head[0]["doc"], "<u4").astype(np.int64)], [np.frombuffer(head[0]["tokens"], U) >> U(1) | U(1 << 63)], [np.full(len(head[0]["doc"]) // 4, hot_df)]
        for r in rows:
            if r["kind"] != 1:
                token.append((unsqueeze_keys(r["tokens"]) + U((r["key"] << 64) // ranges >> shift)) & U((1 << 63) - 1))
                doc.append(np.frombuffer(r["doc"], "<u4" if r["kind"] == 2 else "<u2").astype(np.int64))
                df.append(np.frombuffer(r["extra"], "<u4").astype(np.float64))
        doc, token, df = np.concatenate(doc), np.concatenate(token), np.concatenate(df)
        order = np.lexsort((mix(token), df, doc))
        doc, token, df = doc[order], token[order], df[order]
        cut = np.searchsorted(doc, np.arange(n + 1))
        out = [[] for _ in range(5)]
        for d in np.flatnonzero(np.diff(cut) >= least_shared(sizes)):
            a, b, size = cut[d], cut[d + 1], int(sizes[d])
            matches, k = choose_prefix(size, size - (b - a), df[a:b])
            if k:
                for column, value in zip(out, (int(nodes[d]), size, matches, np.sort(token[a:b]).tobytes(), token[a : a + k].view(np.int64))):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in SETS.split(", ")])

    return run


def _verify(batches):
    """Pairs whose sets are similar, by their sizes and shared shingles."""
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        keep = np.zeros(len(a), bool)
        last, y = None, None
        for i, (x, other) in enumerate(zip(batch.column(4), batch.column(5))):
            x = np.frombuffer(x.as_buffer(), U)
            if last != b[i]:
                last, y = b[i], np.frombuffer(other.as_buffer(), U)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep[i] = 100 * both >= PERCENT * (int(na[i]) + int(nb[i]) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("xa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("xb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_verify, "a bigint, b bigint")


def _similar_sizes(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _hub_pairs(labelled: DataFrame, k: int) -> DataFrame:
    """(a, b): for each set the hub that comes first, in the order of round k, in
    most of its prefix shingles, if it is of another component."""
    rank = F.xxhash64("node", F.lit(k))
    first = labelled.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "node", "comp", "n")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    first = first.select("token", F.col("h.node").alias("hub"), F.col("h.comp").alias("hub_comp"), F.col("h.n").alias("hub_n"))
    met = labelled.join(first, "token").filter((F.col("comp") != F.col("hub_comp")) & _similar_sizes("n", "hub_n")).groupBy("node", "hub").count()
    return met.groupBy("node").agg(F.max(F.struct("count", "hub")).alias("m")).select(F.col("node").alias("a"), F.col("m.hub").alias("b"))


LISTS = "x bigint, x_matches int, top bigint, ys binary, counts binary, matches binary"
_LIST_NAMES = [c.split()[0] for c in LISTS.split(", ")]


def _list_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], _LIST_NAMES)


@trimmed
def _enumerate(table: pa.Table) -> pa.Table:
    """Candidates by set, from some shingles' postings, as one packed list for each set.

    Postings stand by (size of component, component): a set's candidates are
    those beyond its own component, so each pair has one direction everywhere."""
    table = table.sort_by([("token", "ascending"), ("salt", "ascending"), ("size", "ascending"), ("comp", "ascending"), ("node", "ascending")])
    token, salt, node, n, matches, comp, is_x = (table.column(c).to_numpy() for c in ("token", "salt", "node", "n", "matches", "comp", "is_x"))
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
    cuts = np.append(np.flatnonzero(new), len(node))
    ends = np.append(np.flatnonzero(np.concatenate([[False], new[1:] | (comp[1:] != comp[:-1])])), len(node))
    beyond = ends[np.searchsorted(ends, np.arange(len(node)), side="right")]
    last = cuts[np.searchsorted(cuts, np.arange(len(node)), side="right")]
    found: dict[int, list] = {}
    for i in np.flatnonzero(is_x & (beyond < last)):
        y = slice(beyond[i], last[i])
        fits = np.flatnonzero((n[y] * 100 >= n[i] * PERCENT) & (n[i] * 100 >= n[y] * PERCENT))
        if len(fits):
            # (size, component) of the last candidate: where most of them are
            found.setdefault(int(node[i]), [int(matches[i]), int(comp[last[i] - 1]), []])[2].append(fits + beyond[i])
    rows = []
    for x, (need, top, parts) in found.items():
        at = np.concatenate(parts)
        ys, first, counts = np.unique(node[at], return_index=True, return_counts=True)
        rows.append((x, need, top, ys.astype("<i8").tobytes(), np.minimum(counts, 65535).astype("<u2").tobytes(), matches[at[first]].astype("u1").tobytes()))
    return _list_table(rows)


@trimmed
def _merge_lists(table: pa.Table) -> pa.Table:
    """Candidates of each set that share enough prefix shingles with it."""
    found: dict[int, list] = {}
    for r in table.to_pylist():
        f = found.setdefault(r["x"], [r["x_matches"], r["top"], [], [], []])
        for k, (name, kind) in enumerate((("ys", "<i8"), ("counts", "<u2"), ("matches", "u1"))):
            f[2 + k].append(np.frombuffer(r[name], kind))
    rows = []
    for x, (need, top, ys, counts, matches) in found.items():
        distinct, first, place = np.unique(np.concatenate(ys), return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(distinct))
        keep = total >= np.minimum(need, np.concatenate(matches)[first])
        if keep.any():
            rows.append((x, need, top, distinct[keep].tobytes(), b"", b""))
    return _list_table(rows)


#: Sets and candidates that one verification task holds.
TASK_SETS, TASK_CANDIDATES = 256, 4000
TASKS = "task bigint, node bigint, ys binary"


def _plan(table: pa.Table) -> pa.Table:
    """Tasks for some sets with like candidates: every set that a task names comes to it once."""
    rows = table.to_pylist()
    group = rows[0]["group"]
    every = np.unique(np.concatenate([np.frombuffer(r["ys"], "<i8") for r in rows]))
    parts = -(-len(every) // TASK_CANDIDATES)
    out = []
    for k in range(parts):
        task = int(mix(np.array([(group * 1_000_003 + k) & (1 << 64) - 1], U)).view(np.int64)[0])
        mine = every[k * TASK_CANDIDATES : (k + 1) * TASK_CANDIDATES]
        out += [(task, int(y), None) for y in mine]
        for r in rows:
            ys = np.frombuffer(r["ys"], "<i8")
            ys = ys[(ys >= mine[0]) & (ys <= mine[-1])]
            if len(ys):
                out.append((task, r["x"], ys.tobytes()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["task", "node", "ys"])


@trimmed
def _verify_task(table: pa.Table) -> pa.Table:
    """Links (a, b) of a task: for each set one candidate of each component it is similar to."""
    rows = table.to_pylist()
    right = sorted((r for r in rows if r["ys"] is None), key=lambda r: r["node"])
    names = np.array([r["node"] for r in right], np.int64)
    sizes, comps = (np.array([r[c] for r in right], np.int64) for c in ("n", "comp"))
    sets = [np.frombuffer(r["shared"], U) for r in right]
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    there = np.zeros(len(tokens) + 1, bool)
    a, b = [], []
    for r in rows:
        if r["ys"] is None:
            continue
        x = np.frombuffer(r["shared"], U)
        at = np.searchsorted(tokens, x)
        at = at[tokens[np.minimum(at, len(tokens) - 1)] == x]
        there[at] = True
        both = np.bincount(owner[there[ids]], minlength=len(sets))
        there[at] = False
        y = np.searchsorted(names, np.frombuffer(r["ys"], "<i8"))
        y = y[100 * both[y] >= PERCENT * (r["n"] + sizes[y] - both[y])]
        _, first = np.unique(comps[y], return_index=True)
        a += [r["node"]] * len(first)
        b += names[y[first]].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Rounds in which sets meet hubs; postings of a shingle that one task pairs.
HUB_ROUNDS, SALTED, POSTINGS = 3, 2000, 100_000


def _rest(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components: every pair of sets of different components that
    shares enough prefix shingles is verified; no pair is a row."""
    nodes = saved(labelled.select("node", "comp").distinct(), "nodes")
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("token", "c")
    rows = saved(join_hot(saved(labelled.join(mixed, "token"), "mixed"), sizes, "comp"), "mixed")
    n = rows.count()
    if not n:
        return sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    ranges = -(-n // POSTINGS)
    salts = F.ceil(F.col("c") / SALTED).cast("int")
    rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    rows = rows.withColumn("is_x", F.pmod(F.xxhash64("node"), salts) == F.col("salt")).withColumn("key", F.pmod(F.xxhash64("token", "salt"), F.lit(ranges)))
    lists = rows.groupBy("key").applyInArrow(_enumerate, LISTS)
    lists = saved(lists.withColumn("key", F.pmod(F.xxhash64("x"), F.lit(ranges))).groupBy("key").applyInArrow(_merge_lists, LISTS).select("x", "top", "ys"), "candidates")
    alike = lists.groupBy("top").count()
    grouped = join_hot(lists, alike, "top").withColumn("group", F.xxhash64("top", F.pmod(F.xxhash64("x"), F.ceil(F.col("count") / TASK_SETS))))
    tasks = grouped.select("group", "x", "ys").groupBy("group").applyInArrow(_plan, TASKS)
    full = tasks.join(sets.select("node", "n", "shared"), "node").join(nodes, "node")
    return full.groupBy("task").applyInArrow(_verify_task, "a bigint, b bigint")


@tidy
def links(sets: DataFrame) -> DataFrame:
    """node, comp of every set that is linked with another, from ``sets`` (SETS)."""
    spark = sets.sparkSession
    postings = saved(sets.select(F.explode("prefix").alias("token"), "node", "n", "matches"), "postings")
    edges, comps = None, None
    for k in range(HUB_ROUNDS):
        labelled = postings.withColumn("comp", F.col("node")) if comps is None else postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        more = saved(_links(_hub_pairs(labelled, k), sets), "links")
        if more.isEmpty():
            break
        edges = more if edges is None else edges.unionByName(more)
        comps = components(edges)
        release(spark)
    labelled = postings.withColumn("comp", F.col("node")) if comps is None else postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    more = saved(_rest(saved(labelled, "postings"), sets), "links")
    if comps is not None and more.isEmpty():
        return comps
    return components(more if edges is None else edges.unionByName(more))


@tidy
def label(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id for every row of ``docs`` (doc_id,
    text); also comp, which names the component of a non-empty set."""
    spark = docs.sparkSession
    docs = replayable(docs.select("doc_id", "text"), "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    found = saved(rows.mapInArrow(_members, MEMBERS), "members")
    members = found.filter("n IS NOT NULL").select("doc_id", "row_key", "node", "n")
    n_docs, total = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(8, -(-n_docs // HOT))
    hot = [r["token"] for r in found.filter("docs IS NOT NULL").groupBy("token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).collect()]
    if len(hot) * least > total:
        raise AssertionError("more hot shingles than their documents can hold")
    hot = np.sort(np.array(hot, np.int64).view(U))
    ranges = max(1, -(-total // BLOCK))
    blocks = docs.select("text").mapInArrow(_blocks(ranges, hot), BLOCKS)
    counted = blocks.groupBy("key").applyInArrow(_count, BLOCKS)
    sets = counted.groupBy("block").applyInArrow(_assemble(ranges, n_docs / HOT), SETS)
    # a class that several blocks saw comes from each of them
    sets = saved(sets.dropDuplicates(["node"]), "sets")
    release(spark)
    comps = links(sets)
    release(spark)
    classes = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = saved(classes.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least"), "classes")
    # a component may have most classes, and a class most documents
    named = saved(join_hot(named, named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "comp", "component_id"), "named")
    out = join_hot(members, named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "comp")


@tidy
def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    return label(docs).select("doc_id", "n_shingles", "component_id")


@tidy
def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, that with the least doc_id, with the
    columns of ``docs``; documents without words are groups of their own."""
    rows = saved(label(docs).select("doc_id", "row_key", "comp"), "labels")
    first = rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("m")).select(F.col("m.row_key").alias("row_key"))
    keep = first.unionByName(rows.filter("comp IS NULL").select("row_key").distinct()).withColumn("stays", F.lit(1))
    keys = rows.groupBy("row_key").agg(F.count("*").alias("n")).join(keep, "row_key", "left")
    # texts that stay and stand once pass as they are: only the others' keys go to them
    others = saved(keys.filter("stays IS NULL OR n > 1").select("row_key", "stays"), "others")
    few = others.count() <= KEYS_AT_ONCE
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("row_key"))

    def matched(keys: DataFrame, how: str) -> DataFrame:
        return packed.join(F.broadcast(keys), "row_key", how) if few else join_hot(packed, keys, "row_key", how)

    alone = matched(others.select("row_key"), "left_anti").select("row")
    # repeated rows share a key: the one whose other columns hash least, found on the map side first
    repeated = matched(others.filter("stays IS NOT NULL").select("row_key"), "left_semi")
    one = repeated.groupBy("row_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return alone.unionByName(one).select("row.*")


def query(spark, sf_dir):
    """op3_ngram_jaccard_join: see the contract."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.root, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = w.doc_id
"""
