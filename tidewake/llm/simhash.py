"""Near-duplicate documents: SimHash fingerprints, joined by deletion variants of their segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, whole_texts
from .components import checkpoint, components, join_hot

WORDS, SEED = 3, 42
BITS, MOST_BITS = 64, 2
#: So few segments that of MOST_BITS differing bits one segment holds one at most.
SEGMENTS = MOST_BITS // 2 + 1
WIDTH = BITS // SEGMENTS
#: Fingerprints that share a variant are compared pair by pair up to this many; larger buckets go another way.
PAIRED = 16
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, signed: those set in over half of the XXH64 of the runs of 3 words, repeats included; of the whole
    sequence if it is shorter; zero without words. A-Z are lower-cased, words split at ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - size + 1)
    often = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        raw = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        often += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * often > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long) of each whole text. No shuffle."""
    return map_batches(whole_texts(docs), lambda ids, texts: (ids, list(map(fingerprint, texts))), "doc_id long, fingerprint long")


def _variants(prints: DataFrame) -> DataFrame:
    """fingerprint, segment, place, rest: each segment with each of its bits in turn left out."""
    seg, place = F.expr(f"cast(i div {WIDTH} as int)"), F.expr(f"cast(i % {WIDTH} as int)")
    d = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")).select("fingerprint", seg.alias("segment"), place.alias("place"))
    part = F.expr(f"shiftrightunsigned(fingerprint, segment * {WIDTH}) & {(1 << WIDTH) - 1}L")
    return d.withColumn("rest", part.bitwiseAND(F.expr("~shiftleft(1L, place)")))


def links(prints: DataFrame) -> DataFrame:
    """a, b: links of distinct fingerprints (column fingerprint) whose components are those of all pairs with
    MOST_BITS or fewer differing bits. Every link given is such a pair.

    1. Deletion variants: two fingerprints with at most 2 differing bits agree in one half but for one bit, so
       they share that half's variant with this bit left out. Variants are joined on equality, and the pairs of a
       bucket verified on all bits; a pair comes from one variant of a half.
    2. In a bucket of more than PAIRED fingerprints no pairs are formed. Each of its members is put under itself
       and under the 64 neighbours at one bit; those that meet under one value differ in 2 bits at most, and any
       two that do so meet. A value has 65 such neighbours at most, of which all are tied to the least.
    """
    key = ["segment", "place", "rest"]
    variants = _variants(prints)
    buckets = checkpoint(variants.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"))
    members = checkpoint(join_hot(variants, buckets.withColumn("large", F.col("n") > PAIRED), key, ["fingerprint"]))
    side = lambda c: members.filter("not large").select(*key, F.col("fingerprint").alias(c))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    here = F.expr(f"shiftrightunsigned(a ^ b, segment * {WIDTH}) & {(1 << WIDTH) - 1}L")
    pairs = side("a").join(side("b"), key).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= MOST_BITS) & ((here != 0) | (F.col("place") == 0)))
    near = members.filter("large").select("fingerprint").distinct()
    flips = F.explode(F.expr(f"concat(array(fingerprint), transform(sequence(0, {BITS - 1}), i -> fingerprint ^ shiftleft(1L, i)))"))
    met = near.select("fingerprint", flips.alias("z")).groupBy("z").agg(F.sort_array(F.collect_list("fingerprint")).alias("all")).filter("size(all) > 1")
    stars = met.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, BITS)).alias("b"))
    return pairs.select("a", "b").unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row; fingerprints link at MOST_BITS or fewer
    differing bits, and component_id is the least doc_id that is reached.

    Documents of one fingerprint form a class at once, so copies are never paired; only distinct fingerprints go
    through `links` and the components over them. The result is joined back with hot fingerprints salted.

    A text that is null or has no words has fingerprint zero and is linked like any other. A null doc_id takes the
    component of its fingerprint, which is null only if no row of the component has a doc_id; repeated rows come
    through; other columns are ignored; an empty table gives an empty result."""
    prints = checkpoint(fingerprints(docs))
    classes = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = components(links(classes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    placed = classes.join(parts, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(placed.select("component", "fingerprint", F.col("n").alias("rows")), checkpoint(least), ["component"], ["fingerprint"])
    named = checkpoint(named.select("fingerprint", "component_id", F.col("rows").alias("n")))
    out = join_hot(prints, named, ["fingerprint"], ["doc_id"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
