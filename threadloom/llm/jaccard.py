"""Operator 4: n-gram Jaccard self-join with signature trees.

Documents link when the Jaccard similarity of their 5-word shingle sets is 0.8 or more; the result is
each document's component. Nothing is approximate beyond 64-bit hashes of shingles:

1. Equal sets are one class, represented by its smallest id; copies are never paired.
2. Two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each in any common
   order (the prefix). The order puts frequent shingles last, so they are rarely in a prefix. Which
   shingles count as frequent is a bounded list; it steers cost, never results.
3. Leaders: classes of like size with an equal minimum hash are compared with the smallest of them.
   Verified pairs give first components, so a large group of near copies is a star, not all pairs.
4. Only prefix shingles that are shared by different components go on, one of those with the same documents.
   Each such group is a signature tree: nodes hold the OR of their documents' shingle bitmaps, their range of sizes and
   the most shingles that share a bit. Two nodes are traversed together and dropped as soon as the
   largest overlap they allow is below what 0.8 needs, or both lie in one component. Pairs of leaves are bounded once more, in the
   task, by signatures that grow with the documents (2 to 4 bits a shingle); only what they leave is put out.
   Groups over BLOCK rows are dealt into blocks; rows of the group's main component meet only the
   others, and every key holds at most 2 * BLOCK rows.
5. Each distinct pair is verified on the whole sets; links are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import words as W
from threadloom.llm.common import components, finish, if_small, lists, mix, released, settle, stage, staged_so_far, text_slices

SHINGLE = 5
BITS = 1024
LEADERS = 4
FREQUENT = 65_536  # entries of the list of frequent shingles: half a megabyte, sent to every task
FREQUENT_AT = 3  # documents of one task's chunk that hold a shingle before it is reported
CHUNK_SHINGLES = 2_000_000
BLOCK = 256
SMALL_SIDE = 1_000_000  # rows of (long) keys, 8 MB, up to which a side travels to the other one
FANOUT = 8
PAIRS = 4096  # pairs whose signatures are compared together


def _at_least(n: np.ndarray) -> np.ndarray:
    """Least intersection of a set of n shingles with any set of similarity 0.8."""
    return -(-4 * n // 5)


# ---------------------------------------------------------------- frequent shingles


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= FREQUENT_AT
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["t", "n"])

    for _, data, off in text_slices(batches, "text", 1 << 20):
        sets = W.shingle_sets(data, off, SHINGLE)
        held += sets
        size += sum(map(len, sets))
        if size >= CHUNK_SHINGLES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT shingle hashes, rarest first; deterministic for given input partitions."""
    rows = (docs.select("text").mapInArrow(_report, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "t").limit(FREQUENT).toPandas())
    return rows["t"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


# ---------------------------------------------------------------- signatures


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set of hashes by their top bits: a power of two of bits, BITS at least, 2 to 4 for each hash."""
    power = max(BITS.bit_length() - 1, int(2 * len(s) - 1).bit_length() if len(s) else 0)
    marks = np.zeros(1 << power, bool)
    marks[s >> np.uint64(64 - power)] = True
    return np.packbits(marks).view(np.uint64)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with ``size`` bits: neighbours are ORed."""
    if 64 * len(bits) == size:
        return bits
    marks = np.unpackbits(bits.view(np.uint8))
    return np.packbits(marks.reshape(size, -1).any(1)).view(np.uint64)


def may_reach(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with signatures ``a[k]``, ``b[k]`` (rows of one width) and these sizes may have similarity 0.8."""
    ca, cb, both = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b, a & b))
    # a bit of one alone is a shingle of it that the other lacks; shingles beyond one a bit may be shared
    most = np.minimum(both + np.minimum(na - ca, nb - cb), np.minimum(na - (ca - both), nb - (cb - both)))
    return 9 * most >= 4 * (na + nb)


def reachable(signatures: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``may_reach`` of the pairs (i, j) of sets, each at the lesser of its two widths; pairs of equal widths are tested as matrices."""
    width = np.array([len(x) for x in signatures], np.int64)
    out = (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
    least = np.minimum(width[i], width[j])
    for w in np.unique(least[out]).tolist():
        at = np.flatnonzero(out & (least == w))
        used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        rows = np.stack([fold(np.frombuffer(signatures[k], np.uint64), 8 * w) for k in used.tolist()])
        x, y = back[:len(at)], back[len(at):]
        for s in range(0, len(at), PAIRS):  # so that the matrices of a chunk stay small
            part = slice(s, s + PAIRS)
            out[at[part]] = may_reach(rows[x[part]], size[i[at[part]]], rows[y[part]], size[j[at[part]]])
    return out


# ---------------------------------------------------------------- features of a document


def _features(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        order = np.argsort(hot)
        hot_sorted = hot[order]
        seed = np.uint64(0x5851F42D4C957F2D)
        for rows, data, off in text_slices(batches, "text", 1 << 20):
            sets = W.shingle_sets(data, off, SHINGLE)
            n = np.array([len(s) for s in sets], np.int64)
            prefixes, mins, maps, wides, key1, key2 = [], [], [], [], [], []
            for s in sets:
                key1.append(mix(s).sum(dtype=np.uint64))
                key2.append(mix(s ^ seed).sum(dtype=np.uint64))
                take = len(s) - int(_at_least(len(s))) + 1 if len(s) else 0
                at = np.minimum(np.searchsorted(hot_sorted, s), max(len(hot) - 1, 0))
                often = hot_sorted[at] == s if len(hot) else np.zeros(len(s), bool)
                first = s[~often][:take]
                if len(first) < take:
                    last = s[often][np.argsort(order[at[often]])]
                    first = np.concatenate([first, last[:take - len(first)]])
                prefixes.append(first)
                mins.append(s[:LEADERS])
                wide = signature(s)
                maps.append(fold(wide, BITS).tobytes() if len(s) else None)
                wides.append(wide.tobytes() if len(wide) > BITS // 64 else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n), pa.array(np.array(key1, np.uint64).view(np.int64)),
                 pa.array(np.array(key2, np.uint64).view(np.int64)),
                 lists(np.concatenate(prefixes).view(np.int64), list(map(len, prefixes)), pa.int64()),
                 lists(np.concatenate(mins).view(np.int64), list(map(len, mins)), pa.int64()), pa.array(maps, pa.binary()),
                 pa.array(wides, pa.binary())], names=["doc_id", "n", "k1", "k2", "prefix", "mins", "bits", "wide"])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in text_slices(batches, "text", 1 << 20):
        sets = W.shingle_sets(data, off, SHINGLE)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), lists(np.concatenate(sets).view(np.int64), list(map(len, sets)), pa.int64())], names=["doc_id", "shingles"])


# ---------------------------------------------------------------- signature trees


class Tree:
    """Levels of (OR bitmaps, least size, greatest size, most shingles beyond one a bit, least and greatest component)."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray):
        # like sizes and like bitmaps next to each other, so that nodes stay narrow
        self.order = np.lexsort((bits[:, 0], size, side))
        bits, size, comp, side = bits[self.order], size[self.order], comp[self.order], side[self.order]
        extra = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, extra, comp, comp, side, side)]
        while len(self.levels[-1][0]) > FANOUT:
            at = np.arange(0, len(self.levels[-1][0]), FANOUT)
            b, lo, hi, ex, c0, c1, s0, s1 = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(ex, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at),
                                np.minimum.reduceat(s0, at), np.maximum.reduceat(s1, at)))


def may_link(level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some document below node i and some below node j may reach similarity 0.8."""
    bits, lo, hi, extra, c0, c1, s0, s1 = level
    # one component, or both inside the group's main component: nothing to find
    out = ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j])) & ~((s0[i] == 1) & (s0[j] == 1))
    out &= (5 * hi[i] >= 4 * lo[j]) & (5 * hi[j] >= 4 * lo[i])
    at = np.flatnonzero(out)
    i, j = i[at], j[at]
    # shared shingles lie on shared bits; further ones only where a document has several on a bit
    shared = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(extra[i], extra[j])
    most = np.minimum(shared, np.minimum(hi[i], hi[j]))
    # J >= 0.8 needs 9 * overlap >= 4 * (sum of sizes)
    out[at] = 9 * most >= 4 * (lo[i] + lo[j])
    return out


def tree_pairs(bits: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of different components that the traversal of the tree with itself leaves."""
    tree = Tree(bits, size, comp, side)
    n = len(tree.levels[-1][0])
    i, j = np.triu_indices(n)
    for depth in range(len(tree.levels) - 1, -1, -1):
        keep = may_link(tree.levels[depth], i, j)
        i, j = i[keep], j[keep]
        if not depth:
            break
        n = len(tree.levels[depth - 1][0])
        step = np.arange(FANOUT)
        ci = np.repeat(i * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(i))
        cj = np.repeat(j * FANOUT, FANOUT * FANOUT) + np.tile(np.tile(step, FANOUT), len(j))
        ok = (ci < n) & (cj < n) & (ci <= cj)
        i, j = ci[ok], cj[ok]
    different = i != j
    i, j = tree.order[i[different]], tree.order[j[different]]
    return i, j


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (t, x, y), one signature tree for each key; emits the pairs that whole signatures leave."""
    tail = None

    def pairs(table: pa.Table):
        rep, comp, size, side = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
        signatures = table.column("bits").to_pylist()
        bits = np.stack([fold(np.frombuffer(x, np.uint64), BITS) for x in signatures])
        key = np.stack([table.column(c).to_numpy() for c in ("t", "x", "y")], 1)
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        length = np.diff(begin, append=len(key))
        left, right = [], []
        level = (bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64), comp, comp, side, side)
        for m in range(2, FANOUT + 1):  # trees of one node, all of one size together
            at = begin[length == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                keep = np.flatnonzero(may_link(level, a, b))
                left.append(a[keep])
                right.append(b[keep])
        for at, m in zip(begin[length > FANOUT].tolist(), length[length > FANOUT].tolist()):
            part = slice(at, at + m)
            a, b = tree_pairs(bits[part], size[part], comp[part], side[part])
            left.append(a + at)
            right.append(b + at)
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        # equal pairs of several groups are tested once
        _, once = np.unique(np.stack([np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])], 1), axis=0, return_index=True)
        a, b = a[once], b[once]
        keep = (rep[a] != rep[b]) & reachable(signatures, size, a, b)
        a, b = rep[a[keep]], rep[b[keep]]
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
        if table.num_rows == 0:
            continue
        last = [table.column(c)[table.num_rows - 1].as_py() for c in ("t", "x", "y")]
        same = np.ones(table.num_rows, bool)
        for c, v in zip(("t", "x", "y"), last):
            same &= table.column(c).to_numpy() == v
        cut = int(np.argmax(same))
        tail = table.slice(cut)
        if cut and (out := pairs(table.slice(0, cut))) is not None:
            yield out
    if tail is not None and (out := pairs(tail)) is not None:
        yield out


# ---------------------------------------------------------------- the join


def _verified(docs: DataFrame, near: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of ``near`` whose whole shingle sets reach similarity 0.8, staged."""
    wanted = stage(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = settle(docs.join(if_small(wanted, SMALL_SIDE), "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, shingles array<bigint>"), f"{name}-sets")
    met = (near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
           .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    return settle(met.where(100 * both >= 80 * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct(), f"{name}-links")


def _pairs_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        size = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
        at = np.arange(n)
        keep = reachable(batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist(), size, at, at + n) if n else np.zeros(0, bool)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _bounded(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave."""
    def side(x: str) -> DataFrame:
        return reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.coalesce("wide", "bits").alias(f"bits_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(_pairs_left), "a bigint, b bigint")


def _leader_pairs(reps: DataFrame) -> DataFrame:
    """Each class with the smallest class that has an equal minimum hash and a size of the same order."""
    like = reps.select("rep", "n", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))).alias("order"), F.explode("mins").alias("t"))
    lead = like.groupBy("t", "order").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    return (like.join(lead, ["t", "order"]).where("rep <> lead.rep and 5 * least(n, lead.n) >= 4 * greatest(n, lead.n)")
            .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct())


def _blocks(rows: DataFrame) -> DataFrame:
    """Add keys (x, y) and ``side`` so that a key holds at most 2 * BLOCK rows; small groups have one key."""
    small = rows.where(f"c <= {BLOCK}").select("t", "rep", "comp", F.lit(0).alias("side"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    large = rows.where(f"c > {BLOCK}")
    # the component with most rows in a group, from counts that are summed before they are shuffled
    main = (large.groupBy("t", "comp").count().groupBy("t")
            .agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("total"))
            .select("t", F.col("m.comp").alias("main"), F.ceil(F.col("m.count") / BLOCK).cast("int").alias("ins"),
                    F.ceil((F.col("total") - F.col("m.count")) / BLOCK).cast("int").alias("outs")))
    met = large.join(main, "t").withColumn("side", (F.col("comp") == F.col("main")).cast("int"))
    dealt = F.when(F.col("side") == 1, F.pmod(F.xxhash64("rep"), "ins")).otherwise(F.pmod(F.xxhash64("rep"), "outs")).cast("int")
    met = met.withColumn("own", dealt)
    inner = F.expr("transform(sequence(0, outs - 1), j -> struct(-1 - own as x, j as y))")
    outer = F.concat(F.expr("transform(sequence(0, ins - 1), i -> struct(-1 - i as x, own as y))"),
                     F.expr("transform(sequence(0, outs - 1), j -> struct(least(own, j) as x, greatest(own, j) as y))"))
    met = met.withColumn("key", F.explode(F.when(F.col("side") == 1, inner).otherwise(outer)))
    return small.unionByName(met.select("t", "rep", "comp", "side", F.col("key.x").alias("x"), F.col("key.y").alias("y")))


def _hash_dealt(spread: DataFrame, *keys: str) -> DataFrame:
    return spread.repartition(*keys).sortWithinPartitions(*keys)


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (columns ``doc_id, text``; others ignored).

    Null, empty and wordless texts have no shingles and are their own component. Rows with a null id
    link with nothing and have a null component. Rows of one id are one document with several texts:
    it has the links of all of them. An empty table gives an empty result.
    """
    first_step = staged_so_far()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(frequent_shingles(docs))
    features = stage(docs.mapInArrow(_features(frequent), "doc_id bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>, "
                                                          "mins array<bigint>, bits binary, wide binary"), "shingle-features")
    known = features.where("doc_id is not null and n > 0")
    payload = [F.first(c).alias(c) for c in ("prefix", "mins", "bits", "wide")]
    reps = settle(known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), *payload), "shingle-classes")
    first_links = _verified(docs, settle(_bounded(reps, _leader_pairs(reps)), "leaders-near"), "leaders")
    first = stage(components(first_links), "first-components")
    labelled = reps.select("rep", "prefix").join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("comp"), F.explode("prefix").alias("t"))
    # shingles with the same documents (a passage has many) are one group, told by 128 bits of its documents' ids
    members = labelled.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("s1"),
                                        F.bit_xor(F.xxhash64("rep", F.lit(SHINGLE))).alias("s2"))
    groups = settle(members.where("lo < hi").groupBy("c", "s1", "s2").agg(F.min("t").alias("t")).select("t", "c"), "shared-shingles")
    rows = settle(labelled.join(if_small(groups, SMALL_SIDE), "t"), "shared-rows")
    keyed = _blocks(rows).join(reps.select("rep", "n", F.coalesce("wide", "bits").alias("bits")), "rep")
    found = _hash_dealt(keyed, "t", "x", "y").mapInArrow(released(_traverse), "a bigint, b bigint")
    pairs = settle(found.distinct(), "candidate-pairs")
    links = first_links.unionByName(_verified(docs, pairs, "trees"))
    n, ids = known.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n != ids:  # rows of one id are one document: it links the classes of its texts
        several = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
        links = links.unionByName(known.join(several, "doc_id").join(reps.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"])
                                  .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = stage(components(links), "components").withColumnRenamed("node", "rep")
    classes = reps.select("k1", "k2", F.col("n").alias("n_shingles"), "rep").join(final, "rep", "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    linked = (known.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(classes, ["k1", "k2", "n_shingles"])
              .select("doc_id", "n_shingles", "component_id"))
    alone = features.where("doc_id is null or n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"))
    return finish(first_step, linked.unionByName(alone))[0]


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when of each group of similar documents the smallest id stays."""
    groups = similar_groups(docs)
    keep = stage(groups.where("doc_id is null or doc_id = component_id"), "kept-ids")
    kept = if_small(stage(keep.where("doc_id is not null").select("doc_id").distinct(), "kept-distinct"), SMALL_SIDE)
    stay = docs.join(kept, docs["doc_id"] == kept["doc_id"], "left_semi")
    n, ids = keep.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n != ids:  # repeated rows: one of each id stays
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where("doc_id is null"))
