"""Prefix tries of conversations by bursting: containers of suffixes are split by their next turns while they are
large, and then sorted and swept into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .components import checkpoint, join_hot

#: The first turns that are taken from another conversation are at most this many less one ...
HEADS = 9
#: ... and that conversation is the one at the multiple of this number.
FAMILY = 5
#: A container with more turns than this is burst.
LIMIT = 1 << 13
#: Turns of a conversation that a row holds; what follows is a suffix under the head at which it begins.
STRATUM = 1 << 12
#: Conversations of more turns than this are numbered in cells.
LONG = 1 << 16
#: Ids that are joined to one string before digests are taken.
PACKED = 4096

_NODE = (
    "container boolean, k1 long, k2 long, p1 long, p2 long, place int, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, above array<struct<k1: long, k2: long>>"
)


def _numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (a hash of role and text), size of every turn of a conversation with an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    large = checkpoint(d.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > LONG).select("conv_id"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    if large.isEmpty():
        d = d.withColumn("pos", F.row_number().over(order).cast("long"))
    else:
        rest = d.join(large, "conv_id", "left_anti").withColumn("pos", F.row_number().over(order).cast("long"))
        first = F.coalesce("turn", F.lit(-(1 << 63)))
        long_ = d.join(large, "conv_id", "left_semi").withColumns({"place": first, "known": F.col("turn").isNotNull()})
        d = rest.unionByName(numbered(long_, ["conv_id"], "place", ["known", "role", "text"], "pos").drop("place", "known"))
    return d.select("conv_id", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.octet_length("text").cast("long").alias("size"))


def rebuilt_segments(conversations: DataFrame) -> DataFrame:
    """conv_id, stratum, turns (array of place, m1, m2, size; by place) of every rebuilt conversation: the first h turns
    of the conversation conv_id - conv_id % FAMILY, then its own from the one after its h-th, where h is
    crc32(conv_id) % HEADS. m1, m2 are the turn's id: a hash of its place, role and text. One row for each STRATUM
    turns; stratum 0 is there even without turns."""
    turns = checkpoint(_numbered_turns(conversations))
    first = F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "t1", "t2", "size")))
    convs = checkpoint(turns.groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("first")))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    convs_h = convs.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), "first")
    headed = convs_h.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    headed = checkpoint(headed.withColumn("first", F.expr("filter(first, x -> x.pos <= h)")))
    head = headed.select("conv_id", F.inline("first")).withColumnRenamed("pos", "place")
    own = join_hot(turns, headed.select("conv_id", "n", "h", "taken"), ["conv_id"], ["pos"]).filter("pos > h")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("place"), "t1", "t2", "size")
    rows = head.select("conv_id", "place", "t1", "t2", "size").unionByName(own)
    turn = F.struct("place", F.xxhash64("place", "t1", "t2").alias("m1"), F.xxhash64("t2", F.lit(2), "place", "t1").alias("m2"), "size")
    rows = rows.select("conv_id", F.expr(f"(place - 1) div {STRATUM}").alias("stratum"), turn.alias("turn"))
    rows = rows.unionByName(headed.select("conv_id", F.lit(0).cast("long").alias("stratum"), F.lit(None).cast("struct<place: long, m1: long, m2: long, size: long>").alias("turn")))
    return rows.groupBy("conv_id", "stratum").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


_SEGMENT = "conv_id long, stratum long, m1 array<long>, m2 array<long>, sizes array<long>, k1 array<long>, k2 array<long>, x1 long, x2 long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running XOR of turn ids (the key of the node at each place, counted from the stratum's start)."""
    for batch in batches:
        turns = batch.column(2)
        offsets, flat = turns.offsets, turns.values
        m1, m2, sizes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("m1", "m2", "size"))
        at = offsets.to_numpy()
        keys, total = [np.empty_like(m1), np.empty_like(m2)], np.zeros((2, batch.num_rows), dtype=np.int64)
        for r, (a, b) in enumerate(zip(at[:-1], at[1:])):
            for x, (m, k) in enumerate(zip((m1, m2), keys)):
                if b > a:
                    np.bitwise_xor.accumulate(m[a:b], out=k[a:b])
                    total[x, r] = k[b - 1]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (m1, m2, sizes, *keys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *map(pa.array, total)], ["conv_id", "stratum", "m1", "m2", "sizes", "k1", "k2", "x1", "x2"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container (h1, h2) and turn ids become nodes: from a row to the next, the open nodes beyond
    their common prefix are closed and added to their parents, and the rest of the next row is opened. A row for each
    container follows its nodes, with what it adds to its head and the nodes above it."""
    names = ["container", "k1", "k2", "p1", "p2", "place", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "above"]
    kinds = [pa.bool_(), *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 6, pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))]
    head, before, at, above = None, None, 0, None
    nodes: list[list] = []  # of the open container: key, parent (its number, or -1), place, conv, n, children, leaves, saved, size
    stack: list[int] = []
    out: list[tuple] = []
    totals = [0, 0, 0]

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = nodes[stack.pop()]
            if not node[5]:
                node[6] = 1
            node[7] += (node[4] - 1) * node[8]
            if stack:
                up = nodes[stack[-1]]
                up[3] = min(up[3], node[3])
                up[4] += node[4]
                up[5] += 1
                up[6] += node[6]
                up[7] += node[7]
            else:
                totals[0] += 1
                totals[1] += node[6]
                totals[2] += node[7]

    def finish() -> None:
        nonlocal nodes
        close(0)
        for key, parent, place, conv, n, children, leaves, saved, _ in nodes:
            (p1, p2), of = (head, None) if parent < 0 else (nodes[parent][0], nodes[parent][3])
            out.append((False, *key, p1, p2, place, conv, of, n, children, leaves, saved, None))
        out.append((True, *head, None, None, None, None, None, None, *totals, above))
        nodes = []
        totals[:] = [0, 0, 0]

    def taken():
        columns = zip(*out) if out else ((),) * len(kinds)
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            h1, h2, start, k1, k2, sizes, conv, n, children, leaves, saved, begin = row
            keys = list(zip(k1, k2))
            if head != (h1, h2):
                if head is not None:
                    finish()
                head, at, before = (h1, h2), start, []
                above = [{"k1": a, "k2": b} for a, b in [begin, *keys[: start]]]
            same = 0
            for x, y in zip(keys[at:], before):
                if x != y:
                    break
                same += 1
            close(same)
            before = keys[at:]
            for i in range(at + same, len(keys)):
                nodes.append([keys[i], stack[-1] if stack else -1, i + 1, conv, 0, 0, 0, 0, sizes[i]])
                stack.append(len(nodes) - 1)
            if stack:  # the row ends at this node, and adds what lies below it
                node = nodes[stack[-1]]
                node[3] = min(node[3], conv)
                node[4] += n
                node[5] += children
                node[6] += leaves
                node[7] += saved
            if len(out) >= 50_000:
                yield taken()
    if head is not None:
        finish()
    yield taken()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _stratum(rows: DataFrame, root: bool) -> tuple[DataFrame, DataFrame]:
    """The nodes under the heads (s1, s2) at which the rows begin, as _NODE has them, and what they add to these heads:
    s1, s2, n_children, n_leaves, saved_tokens.

    rows: s1, s2, m1, m2, sizes, k1, k2 (keys from the root), conv_id (the least of the n equal segments), n, and
    children, leaves, saved of what lies below their last node."""
    open_ = rows.withColumn("at", F.lit(0))
    ready, heads, ended, step = [], [], [], 1
    key = lambda i: F.when(i > 0, F.struct(F.get("k1", i - 1).alias("k1"), F.get("k2", i - 1).alias("k2"))).otherwise(F.struct(F.col("s1").alias("k1"), F.col("s2").alias("k2")))
    begin = F.struct(F.col("s1").alias("k1"), F.col("s2").alias("k2"))
    above = lambda i: F.concat(F.array(begin), F.transform(F.slice("k1", 1, F.greatest(i - 1, F.lit(0))), lambda x, j: F.struct(x.alias("k1"), F.get("k2", j).alias("k2"))))
    if root:
        top = rows.groupBy("s1", "s2").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
        nothing = F.lit(None).cast("long")
        heads.append(top.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), nothing.alias("p1"), nothing.alias("p2"), F.lit(0).alias("place"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), F.expr("slice(array(struct(0L AS k1, 0L AS k2)), 1, 0)").alias("above")))
    while True:
        open_ = checkpoint(open_.withColumn("h", key(F.col("at"))).withColumns({"h1": F.col("h.k1"), "h2": F.col("h.k2")}).drop("h"))
        load = checkpoint(open_.groupBy("h1", "h2").agg(F.sum(F.size("k1") - F.col("at") + 1).alias("load"), F.count("*").alias("n")))
        loaded = checkpoint(join_hot(open_.withColumnRenamed("n", "_n"), load, ["h1", "h2"], ["conv_id"]).withColumnRenamed("_n", "n"))
        ready.append(loaded.filter(F.col("load") <= LIMIT))
        large = loaded.filter(F.col("load") > LIMIT)
        if large.isEmpty():
            break
        until = F.least(F.col("at") + step, F.size("k1"))
        passed = large.filter(F.size("k1") > F.col("at")).withColumn("i", F.explode(F.sequence(F.col("at") + 1, until)))
        i = F.col("i")
        passed = passed.select(key(i).alias("k"), key(i - 1).alias("p"), i.alias("place"), "conv_id", "n", F.get("sizes", i - 1).alias("size"), above(i).alias("above"))
        nodes = passed.groupBy(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).agg(
            F.first("p.k1").alias("p1"), F.first("p.k2").alias("p2"), F.first("place").alias("place"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("size").alias("size"), F.first("above").alias("above")
        )
        heads.append(checkpoint(nodes))
        at_end = large.filter((F.size("k1") <= F.col("at") + step) & ((F.col("children") > 0) | (F.col("leaves") > 0)))
        ended.append(at_end.select(key(F.size("k1")).alias("k"), above(F.size("k1")).alias("above"), "children", "leaves", "saved"))
        open_ = large.filter(F.size("k1") > F.col("at") + step).withColumn("at", F.col("at") + step).drop("load", "h1", "h2")
        step *= 2
    swept = _union(ready).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "m1", "m2")
    swept = swept.select("h1", "h2", "at", "k1", "k2", "sizes", "conv_id", "n", "children", "leaves", "saved", F.array("s1", "s2").alias("begin"))
    swept = checkpoint(swept.mapInArrow(_sweep, _NODE))
    # what containers, and rows that end at a head, add to heads
    adds = swept.filter("container").select(F.struct("k1", "k2").alias("k"), "above", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    if ended:
        last = _union(ended)
        adds = adds.unionByName(last.select("k", F.concat("above", F.array("k")).alias("above"), "children", "leaves", "saved"))
    if heads:
        burst = _union(heads)
        own = burst.filter("p1 IS NOT NULL").select(F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("k"), F.lit(1).cast("long").alias("children"))
        children = adds.select("k", "children").unionByName(own).groupBy("k.k1", "k.k2").agg(F.sum("children").alias("n_children"))
        burst = checkpoint(burst.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
        weights = burst.select(F.concat("above", F.array(F.struct("k1", "k2"))).alias("above"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
        sums = adds.select("above", "leaves", "saved").unionByName(weights)
    else:
        children = adds.select("k", "children").groupBy("k.k1", "k.k2").agg(F.sum("children").alias("n_children"))
        sums = adds.select("above", "leaves", "saved")
    sums = sums.select(F.explode("above").alias("k"), "leaves", "saved").groupBy("k.k1", "k.k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    sums = checkpoint(sums)
    nodes = swept.filter("not container").select("k1", "k2", "p1", "p2", "place", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    if heads:
        done = burst.join(sums, ["k1", "k2"]).withColumn("parent_conv_id", F.lit(None).cast("long"))
        nodes = nodes.unionByName(done.select(*nodes.columns))
    starts = rows.select("s1", "s2").distinct().join(children.withColumnsRenamed({"k1": "s1", "k2": "s2"}), ["s1", "s2"]).join(sums.withColumnsRenamed({"k1": "s1", "k2": "s2"}), ["s1", "s2"])
    return nodes, starts


def _digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 for k1, k2, conv_id: the digest of the ids in order, joined by commas. Ids are sorted over
    all tasks and joined to strings of up to PACKED of them; only these strings of a node meet in a task, one after
    the other, as a digest has no parts."""

    def packed(batches):
        key, ids, out = None, [], []

        def flush():
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def taken():
            columns = list(zip(*out)) if out else [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "first", "ids"])

        for batch in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns)):
                if key != (k1, k2) or len(ids) >= PACKED:
                    flush()
                    key = (k1, k2)
                ids.append(c)
            yield taken()
        flush()
        yield taken()

    def digested(batches):
        key, digest, out = None, None, []

        def taken():
            columns = list(zip(*out)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            for k1, k2, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if key == (k1, k2):
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
            yield taken()
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield taken()

    order = ["k1", "k2", "conv_id"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, "k1 long, k2 long, first long, ids string")
    return strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digested, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of
    every node of the trie of the rebuilt conversations (see `rebuilt_segments`).

    1. Turns are numbered, conversations rebuilt and equal ones counted as one row.
    2. All rows form a container of suffixes under the root. A container of over LIMIT turns is burst: its rows move
       on to containers under the heads made by their next turn id (the next 1, 2, 4, ... ids in later rounds, so that
       a long prefix shared by many needs few rounds), and the heads passed become nodes by an aggregate.
    3. The other containers are sorted and swept into nodes, with the sums of their subtrees; these and the heads'
       own are added to the heads above them.
    4. Digests come from ids that are sorted over all tasks.

    A null turn comes first, equal turns go by role and text; a null role or text is empty. Rows without a conv_id
    belong to no conversation and are left out. Repeated rows are turns of their own. Other columns are ignored; an
    empty table gives an empty result. Turns are compared by 128 bits of place, role and text. A row holds STRATUM
    turns at most; a longer conversation goes on in further strata, which are built from the deepest up, one after
    the other, so time grows with the longest conversation over STRATUM."""
    segments = checkpoint(rebuilt_segments(conversations).mapInArrow(_keyed, _SEGMENT))
    deepest = segments.agg(F.max("stratum")).first()[0]
    if deepest is None:
        kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return conversations.sparkSession.createDataFrame([], kind)
    if deepest:
        earlier = Window.partitionBy("conv_id").orderBy("stratum")
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        start = [F.coalesce(F.expr(f"bit_xor({x})").over(before), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))]
        segments = checkpoint(segments.select("*", *start, F.lead("stratum").over(earlier).isNull().alias("ends")))
    else:
        zero = F.lit(0).cast("long")
        segments = segments.select("*", zero.alias("s1"), zero.alias("s2"), F.lit(True).alias("ends"))
    last = [F.col(s).bitwiseXOR(F.col(x)) for s, x in (("s1", "x1"), ("s2", "x2"))]
    equal = ["stratum", "s1", "s2", "x1", "x2", "ends"]
    classes = segments.groupBy(*equal).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("m1", "m2", "sizes", "k1", "k2")])
    for k, s in (("k1", "s1"), ("k2", "s2")):
        classes = classes.withColumn(k, F.expr(f"transform({k}, x -> x ^ {s})"))
    classes = checkpoint(classes.withColumns({"e1": last[0], "e2": last[1]}))
    found, below = [], None
    for stratum in range(deepest, -1, -1):
        rows = classes.filter(F.col("stratum") == stratum)
        if below is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:  # rows of one last node end there alike: the least of them, not each, brings what lies below
            under = below.select(F.col("s1").alias("e1"), F.col("s2").alias("e2"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(False).alias("ends"))
            rows = rows.join(under, ["e1", "e2", "ends"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("children", "leaves", "saved")})
        nodes, below = _stratum(rows.drop("stratum", "x1", "x2", "e1", "e2", "ends"), stratum == 0)
        found.append(nodes.withColumn("depth", (F.col("place") + stratum * STRATUM).cast("long")))
        below = checkpoint(below) if stratum else None
    nodes = checkpoint(_union(found))
    wanted = nodes.filter("parent_conv_id IS NULL AND p1 IS NOT NULL")
    parents = wanted.groupBy("p1", "p2").agg(F.count("*").alias("n")).join(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of")), ["p1", "p2"])
    named = join_hot(wanted, checkpoint(parents), ["p1", "p2"], ["k1"]).withColumn("parent_conv_id", F.col("of")).select(*nodes.columns)
    nodes = nodes.filter("parent_conv_id IS NOT NULL OR p1 IS NULL").unionByName(named)
    ends = _digests(segments.filter("ends").select(last[0].alias("k1"), last[1].alias("k2"), "conv_id"))
    out = nodes.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
