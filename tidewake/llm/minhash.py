"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .batches import map_batches, whole_texts
from .components import checkpoint, components, join_hot, joined_components

#: A center's pairs are verified in parts of about this many shingles.
PART = 1 << 15
#: Members of a group that shares a shingle are compared in blocks of about this many.
BLOCK = 4096
#: Shingles are counted in this many cells (a power of two) to tell the rare from the frequent.
COUNT_BITS = 18


def _sketch(doc_ids, texts):
    sets = [shingles.shingle_set(t) for t in texts]
    full = [i for i, s in enumerate(sets) if len(s)]
    keys = [shingles.set_key(s) if len(s) else (None, None) for s in sets]
    bands = shingles.band_keys(np.stack([shingles.signature(sets[i]) for i in full])) if full else np.empty((0, shingles.BANDS), dtype=np.int64)
    sizes = np.zeros(len(sets), dtype=np.int64)
    sizes[full] = shingles.BANDS
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return doc_ids, [len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys], pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))


def _checked(percent: int):
    """Rows (a, part, b, text) in order, each part led by its center (b null), to a, b, linked."""

    def check(batches):
        at, centers = None, []
        for batch in batches:
            out = []
            for a, part, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b is None:  # several texts may share the id
                    centers = [*(centers if at == (a, part) else []), shingles.shingle_set(text)]
                    at = (a, part)
                elif at == (a, part):
                    own = shingles.shingle_set(text)
                    out.append((a, b, any(shingles.linked(c, own, percent) for c in centers)))
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    return check


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; with size_a, size_b, the sizes of their sets) whose whole shingle sets reach the
    threshold. texts: doc_id, text. Sizes alone refute many. The others are dealt by a, and in parts where a has
    many, so that the text of a travels once a part."""
    near = checkpoint(pairs.filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent).select("a", "b", "size_b").distinct())
    per = checkpoint(near.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.sum("size_b") / PART).cast("int").alias("parts")))
    dealt = join_hot(near, per, ["a"], ["b"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    centers = per.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    centers = centers.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    both = members.select("a", "part", "b", "text").unionByName(centers.select("a", "part", "b", "text"))
    ordered = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(_checked(percent), "a long, b long, linked boolean").filter("linked").select("a", "b")


def _shingle_rows(doc_ids, texts):
    sets = [shingles.shingle_set(t).view(np.int64).tolist() for t in texts]
    return doc_ids, [len(s) for s in sets], sets


def _open_nodes(members: DataFrame, parts: DataFrame) -> DataFrame:
    """node, component of the members of buckets that still hold several components beside their center's pairs."""
    placed = members.filter("node <> center").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = checkpoint(placed.select("band", "node", "component"))
    per = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    per = checkpoint(per.filter("low <> high").select("band", "n"))
    return join_hot(placed, per, ["band"], ["node"]).select("node", "component").distinct()


def _rest(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b, size_a, size_b: pairs of nodes (node, component) of different components, none of which that reaches
    the threshold is left out.

    Shingles are put in one order, by counts of their hashes in 2**COUNT_BITS cells (which alone reach the
    driver): first those whose cell holds one component only, then the rare before the frequent. If two sets of
    m and n shingles share o >= percent (m + n) / (100 + percent) of them, the first that they share stands at
    most at m - o and n - o (from 0) in the two; so only so many of the first shingles of a set are compared, and
    pairs by sizes and places. Groups of a shingle are compared in blocks of bounded size."""
    sets = map_batches(texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), _shingle_rows, "node long, size long, shingles array<long>")
    held = checkpoint(sets.join(nodes, "node"))
    cell = F.col("shingle").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int").alias("cell")
    counts = held.select("component", F.explode("shingles").alias("shingle")).groupBy(cell).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    counted = counts.filter("low <> high").select("cell", "n").toArrow()  # 2**COUNT_BITS rows at most
    often = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    often[counted["cell"].to_numpy()] = counted["n"].to_numpy()

    def first_shingles(ids, components_, sizes, sets):
        out = []
        for node, component, size, held_ in zip(ids, components_, sizes, sets):
            s = np.array(held_, dtype=np.int64)
            n = often[s & (len(often) - 1)]
            order = np.lexsort((s, n))[: size - (size * percent + 99) // 100 + 1]
            out += [(node, component, size, i, int(s[x])) for i, x in enumerate(order) if n[x]]
        return [list(c) for c in zip(*out)] if out else [[]] * 5

    first = checkpoint(map_batches(held.select("node", "component", "size", "shingles"), first_shingles, "node long, component long, size long, place long, shingle long"))
    groups = first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    groups = checkpoint(groups.select("shingle", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = checkpoint(join_hot(first, groups, ["shingle"], ["node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda s, i, j: dealt.withColumn(j, other).select("shingle", F.col("own").alias(i), j, *[F.col(c).alias(f"{s}_{c}") for c in ("node", "component", "size", "place")])
    both = side("a", "i", "j").join(side("b", "j", "i"), ["shingle", "i", "j"]).filter("a_node < b_node and a_component <> b_component")
    share = "least(a_size - a_place, b_size - b_place)"  # what they can share from here on
    both = both.filter(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and {100 + percent} * {share} >= {percent} * (a_size + b_size)")
    return both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_size").alias("size_a"), F.col("b_size").alias("size_b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked are documents with
    100 * intersection >= percent * union of their sets of 5-word shingles.

    1. One pass makes of each whole text the set's size, a 128-bit key and 32 band keys of 6 circulant
       MinHash coordinates (a pair at 0.85 shares no band with probability 3e-7).
    2. Documents of equal sets form a class under their least doc_id; only classes go on.
    3. In every bucket all members are paired with the least one (linear, hot buckets too), and the
       pairs verified on the full sets; the links give first components.
    4. Members of buckets that still hold several components are compared with those of other components by
       their first shingles in a common order, which leaves out no pair at the threshold, and the pairs that
       remain are verified on the full sets. So each pair that shares a band is linked, refuted by an exact
       bound or in full, or in one component already.
    5. Components of all links; kept is doc_id = component_id.

    A text that is null or has no words has no shingles, links with nothing and is its own component.
    A row with a null doc_id takes the component of the documents of its set, else null, and is kept
    only if that is null. Rows that share a doc_id count as one node; repeated rows come through.
    Other columns are ignored; an empty table gives an empty result.
    """
    texts = whole_texts(docs)
    sketches = checkpoint(map_batches(texts, _sketch, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    key = ["n_shingles", "k1", "k2"]
    classes = checkpoint(sketches.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    banded = classes.filter("node is not null").select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    least = F.min(F.struct("node", "size"))
    buckets = banded.groupBy("band").agg(least.alias("c"), F.max("node").alias("last"), F.count("*").alias("n")).filter("c.node < last")
    buckets = checkpoint(buckets.select("band", F.col("c.node").alias("center"), F.col("c.size").alias("center_size"), "n"))
    members = checkpoint(join_hot(banded, buckets, ["band"], ["node"]))
    pairs = members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"), F.col("center_size").alias("size_a"), F.col("size").alias("size_b"))
    needed = checkpoint(texts.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    links = checkpoint(verify(pairs, needed, percent))
    parts = components(links)
    nodes = checkpoint(_open_nodes(members, parts))
    if not nodes.isEmpty():
        more = checkpoint(verify(_rest(nodes, needed, percent), needed, percent))
        parts = parts if more.isEmpty() else joined_components(parts, more)
    parts = parts.withColumnRenamed("component", "component_id")
    named = classes.select(*key, "node").join(parts, "node", "left").select(*key, F.coalesce("component_id", "node").alias("component_id"))
    out = sketches.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
