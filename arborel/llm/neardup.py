"""Classes of similar sets: banding, candidate clusters, verified links, components. Used by documents and by lines.

The input is a table of sketches, one row an item: `digest` (binary, of the item's set or text; null for an empty one), `n` (set size, or a
bound above it), `sig` (the registers, 16 bits each) and `place` (a long by which the item's row is found again). Sets are not kept: `fetch` makes those of
candidates anew from their rows.

1. Items of equal digest are one node. 2. Nodes that share a band key are compared by the estimate from their registers; nodes linked so make
candidate clusters. (Of a band key of over BUCKET nodes all nodes fall into one cluster, without pairs.) 3. Each cluster is searched for
verified links by breadth-first search over blocks of at most BLOCK nodes plus a few anchors. 4. Nodes of a cluster of several blocks that are
still outside its largest class are compared, in blocks, with all the cluster's nodes of other classes. So no pair of a cluster goes unexamined
unless both its ends are already connected, and no task holds more than one bucket or two blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attach, components, discard, maybe_in, stored

#: Most nodes of a cluster in one block, and anchors that a block is given besides.
BLOCK, ANCHORS = 500, 8
#: Registers of a band; keys that a worker gathers before it sends them; keys that a task compares.
ROWS, PACK, COUNTED = 4, 1 << 21, 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Most nodes of a band key that are compared in one task.
BUCKET = 2000
#: Standard deviations that the estimate may lie below the threshold before a pair is dropped unverified.
SLACK = 5.0


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def registers(hashes: np.ndarray, bits: int, mantissa: int) -> np.ndarray:
    """HyperMinHash registers of a sorted array of distinct 64-bit hashes: the top `bits` choose the bucket; of the bucket's
    smallest remainder, the register keeps the count of leading zeros (plus one) and the next `mantissa` bits, in 16 bits; 0 is empty."""
    out = np.zeros(1 << bits, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first of a bucket is its smallest
    rest = hashes[first] << np.uint64(bits)
    top = (rest >> np.uint64(11)).astype(np.float64)  # 53 bits are exact
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    most = np.uint64((1 << (16 - mantissa)) - 2)
    zeros = np.minimum(zeros, most)
    below = (rest << zeros) << np.uint64(1)  # without the leading one
    out[bucket[first]] = (((zeros + np.uint64(1)) << np.uint64(mantissa)) | (below >> np.uint64(64 - mantissa))).astype(np.uint16)
    return out


def band_keys(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands that aren't all empty, and the index of the signature that each belongs to. A band's ROWS registers are 8 bytes."""
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grid = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)
    key = mix(grid + PRIME * np.arange(1, grid.shape[1] + 1, dtype=np.uint64))
    owner, band = np.nonzero(grid)
    return key[owner, band].view(np.int64), owner


def packed(buckets: int):
    """(sig) to (bucket, keys): many keys a row, so a key takes 8 bytes of a shuffle. Of PACK keys two of each go at most, as more say no more."""

    def emit(parts):
        keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        keys = keys[np.r_[np.ones(min(2, len(keys)), bool), keys[2:] != keys[:-2]]]
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, bucket = keys[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[edges[1:], len(keys)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int64()), pa.array([keys[i:j].tobytes() for i, j in zip(edges, ends)], pa.binary())], names=["bucket", "keys"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(band_keys(batch["sig"].to_pylist())[0])
            n += len(parts[-1])
            if n >= PACK:
                yield emit(parts)
                parts, n = [], 0
        yield emit(parts)

    return run


def repeated(group: pa.Table) -> pa.Table:
    """The keys that occur more than once."""
    keys = np.sort(np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64))
    return pa.table({"band": pa.array(np.unique(keys[1:][keys[1:] == keys[:-1]]), pa.int64())})


def banded(batches):
    """(node, sig) to (node, band)."""
    for batch in batches:
        keys, owner = band_keys(batch["sig"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(batch["node"].to_numpy()[owner], pa.int64()), pa.array(keys, pa.int64())], names=["node", "band"])


def likely(regs: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, threshold: float, mantissa: int, exact: bool = True) -> np.ndarray:
    """Those of `others` whose similarity with i may reach the threshold."""
    return others[alike(regs, sizes, i, others, threshold, mantissa, exact)] if len(others) else others


def alike(regs: np.ndarray, sizes: np.ndarray, i, j, threshold: float, mantissa: int, exact: bool) -> np.ndarray:
    """Of each pair (i, j) whether sizes and the collision-corrected estimate of the Jaccard similarity don't rule `threshold` out.

    Registers of unequal minima agree by chance in about one of 2 ** mantissa of the buckets that both fill with equal leading-zero
    counts (a third of them); the estimate takes this from the share of agreeing buckets. The filled buckets sample the union without
    repeats, so the error vanishes for sets that are small beside the number of buckets."""
    a, b = regs[i], regs[j]
    filled = np.maximum(((a > 0) | (b > 0)).sum(axis=-1), 1)
    agree = ((a == b) & (a > 0)).sum(axis=-1) / filled
    chance = 2.0**-mantissa / 3
    estimate = (agree - chance) / (1 - chance)
    union = np.maximum((sizes[j] + sizes[i]) / (1 + threshold), filled)
    error = np.sqrt(threshold * (1 - threshold) / filled * (1 - filled / union))
    fits = estimate >= threshold - SLACK * error - 1.5 / filled
    if exact:  # the sizes alone rule some out
        fits &= np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i]) - 1e-9
    return fits


def jaccard_at_least(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Of sorted arrays of distinct values; in whole numbers of hundredths, so that ties are exact."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum()) if len(b) else 0
    return 100 * shared >= round(100 * threshold) * (len(a) + len(b) - shared)


def search(regs, sizes, sets, threshold: float, mantissa: int, label=None) -> list[tuple[int, int]]:
    """Verified links that connect what is connected. label: classes known before; pairs within one are not examined, and only links
    between different classes are returned."""
    links, n = [], len(sizes)
    if label is None:
        left = np.arange(n)
        while len(left):
            front, left = [int(left[0])], left[1:]
            while front and len(left):
                i = front.pop()
                hit = [j for j in likely(regs, sizes, i, left, threshold, mantissa) if jaccard_at_least(sets[i], sets[j], threshold)]
                links += [(i, int(j)) for j in hit]
                front += [int(j) for j in hit]
                left = np.setdiff1d(left, hit, assume_unique=True)
        return links
    label, query = label[0], label[1]
    for i in np.flatnonzero(query):
        for j in likely(regs, sizes, int(i), np.flatnonzero(label != label[i]), threshold, mantissa):
            if label[i] != label[j] and jaccard_at_least(sets[i], sets[j], threshold):
                links.append((int(i), int(j)))
                label[label == label[i]] = label[j]
    return links


def spanned(regs, sizes, threshold: float, mantissa: int, exact: bool) -> list[tuple[int, int]]:
    """Links by the estimate alone that connect what it connects."""
    links, left = [], np.arange(len(sizes))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = likely(regs, sizes, i, left, threshold, mantissa, exact)
            links += [(i, int(j)) for j in hit]
            front += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return links


def bucketed(threshold: float, mantissa: int, exact: bool):
    """Links within each band key; rows (band, node, n, sig) come sorted by band, and a key's rows may run over several batches."""

    def linked(band, nodes, sizes, sigs):
        edges = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        regs = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)
        counts = np.diff(edges)
        pairs = edges[:-1][counts == 2]  # most keys: all at once
        near = pairs[alike(regs, sizes, pairs, pairs + 1, threshold, mantissa, exact)]
        out = list(zip(nodes[near].tolist(), nodes[near + 1].tolist()))
        for a, n in zip(edges[:-1][counts > 2].tolist(), counts[counts > 2].tolist()):
            out += [(int(nodes[a + i]), int(nodes[a + j])) for i, j in spanned(regs[a : a + n], sizes[a : a + n], threshold, mantissa, exact)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            band = rows["band"].to_numpy()
            cut = int(np.searchsorted(band, band[-1]))  # the last key may go on
            if cut:
                done = rows.slice(0, cut)
                yield linked(band[:cut], done["node"].to_numpy(), done["n"].to_numpy(), done["sig"].to_pylist())
            rest = rows.slice(cut)
        if rest is not None:
            yield linked(rest["band"].to_numpy(), rest["node"].to_numpy(), rest["n"].to_numpy(), rest["sig"].to_pylist())

    return run


def searched(decode, bits: int, mantissa: int, threshold: float, keys: list[str]):
    """Search of blocks: rows come sorted by `keys`, those of one block one after the other, perhaps over several batches. decode makes the sorted
    uint64 array of a payload's set. Rows with comp and query are those of blocks whose classes are known in part."""

    def block(group: pa.Table) -> list[tuple[int, int]]:
        nodes, keep = np.unique(group["node"].to_numpy(), return_index=True)
        if len(nodes) < 2:
            return []
        payloads = group["payload"].to_pylist()
        sets = [decode(payloads[i]) for i in keep]
        regs = np.array([registers(x, bits, mantissa) for x in sets])
        label = None
        if "comp" in group.column_names:
            label = (group["comp"].to_numpy()[keep].copy(), group["query"].to_numpy()[keep])
        return [(int(nodes[i]), int(nodes[j])) for i, j in search(regs, np.array([len(x) for x in sets]), sets, threshold, mantissa, label)]

    def run(batches):
        for groups in grouped(batches, keys):
            links = [link for g in groups for link in block(g)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def grouped(batches, keys: list[str]):
    """For each batch the groups of equal keys that end in it, as tables. Spares a stream of its own for each of many small groups."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([*rest, batch])
        starts = np.flatnonzero(np.logical_or.reduce([np.r_[True, (c := rows[k].to_numpy())[1:] != c[:-1]] for k in keys]))
        yield [rows.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:])]
        rest = rows.slice(starts[-1]).to_batches()
    if rest:
        yield [pa.Table.from_batches(rest)]


def classes(sketches: DataFrame, fetch, decode, threshold: float, bits: int, mantissa: int, exact: bool = True) -> DataFrame:
    """(digest, node, comp, copies, linked): for each distinct set its node, the smallest node of its class, its number of items, and whether it has links.
    sketches is a stored table with a unique long `rid`; a node is the smallest rid of its digest. fetch takes (place, digest, ...) of candidates
    and returns those rows with their payload (and without place and digest); decode makes the set of a payload. exact: n is the set's size."""
    some = sketches.where("digest is not null")
    groups = stored(some.groupBy("digest").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies")))
    # the first row of each digest, by a bitmap and no shuffle; should another row pass, it only is a node more, linked by its equal set
    firsts = maybe_in(some, "rid", groups.select(F.col("node").alias("rid"))).select(F.col("rid").alias("node"), "place", "digest", "n", "sig")
    near = stored(likely_links(firsts, groups.count() * ((1 << bits) // ROWS), threshold, mantissa, exact))

    # only numbers move until sets are fetched once
    clusters = components(near).select("node", F.col("comp").alias("cluster"))
    discard(near)
    where = firsts.select("node", "place", "digest")
    known = search_clusters(placed(clusters), lambda rows: fetch(stored(where.join(rows, "node"))), lambda keys: searched(decode, bits, mantissa, threshold, keys))
    return groups.join(known, "node", "left").select("digest", "node", F.coalesce("comp", "node").alias("comp"), "copies", F.col("comp").isNotNull().alias("linked"))


def placed(clusters: DataFrame) -> DataFrame:
    """clusters(cluster, node) with the number of blocks of a cluster, and the node's. Stored."""
    sizes = stored(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")))
    met = attach(clusters, sizes, "cluster", "node", "inner").select("cluster", "node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    return stored(met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))


def search_clusters(where: DataFrame, get, task) -> DataFrame:
    """(node, comp) of the nodes that verified links connect, within the clusters of where(cluster, node, blocks, block). get adds payloads to rows with nodes;
    task(keys) is a search of sorted blocks, such as `searched`."""
    search_by = lambda rows, keys: rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task(keys), "a bigint, b bigint")
    several = where.where("blocks > 1")
    dealt = where.select("cluster", "node", "block")
    if large := bool(several.take(1)):
        # a few of the cluster's nodes go to every block of a cluster that has several
        picked = several.select("cluster", "blocks", F.struct(F.xxhash64("node").alias("h"), "node").alias("x"))
        picked = picked.withColumn("s", F.pmod(F.col("x.h"), F.lit(ANCHORS))).groupBy("cluster", "s", "blocks").agg(F.min("x").alias("x"))
        dealt = dealt.union(picked.select("cluster", F.col("x.node").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))).distinct()
    links = stored(search_by(get(dealt), ["cluster", "block"]))
    known = components(links)
    discard(links)
    if not large:
        return known
    # clusters of several blocks: what lies outside the largest class against all
    big = stored(several.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    counted = big.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = counted.groupBy("cluster").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    open_ = attach(big, main.where("kinds > 1"), "cluster", "node", "inner").withColumn("query", F.col("comp") != F.col("top.comp"))
    open_ = stored(open_.select("cluster", "node", "blocks", "block", "comp", "query"))
    parts = open_.where("query").groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    open_ = attach(open_, parts, "cluster", "node", "inner")
    against = open_.withColumn("query", F.lit(False)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = open_.where("query").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = asking.unionByName(against).groupBy("cluster", "block", "part", "node", "comp").agg(F.max("query").alias("query"))
    more = search_by(get(both), ["cluster", "block", "part"])
    # classes known so far are stars, so they stand for the links already found
    return components(known.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))


def likely_links(firsts: DataFrame, keys: int, threshold: float, mantissa: int, exact: bool) -> DataFrame:
    """(a, b): links by the estimate that connect all that share a band and may be similar. keys: about how many band keys there are. Keys that only
    one node has are dropped by a bitmap before any row with a node moves; of bands with the same nodes one is looked at."""
    buckets = max(16, keys // COUNTED)
    shared = firsts.select("sig").mapInArrow(packed(buckets), "bucket bigint, keys binary").groupBy("bucket").applyInArrow(repeated, "band bigint")
    shared = stored(shared)
    rows = maybe_in(firsts.select("node", "sig").mapInArrow(banded, "node bigint, band bigint"), "band", shared)
    met = stored(rows.join(shared, "band").select("band", "node"))
    facts = met.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"))
    chosen = stored(facts.groupBy("least", "most", "m", "x").agg(F.min("band").alias("band")).select("band", "least", "m"))
    met = stored(met.join(chosen, "band"))
    whole = met.where(F.col("m") > BUCKET).select(F.col("node").alias("a"), F.col("least").alias("b"))
    small = met.where(F.col("m") <= BUCKET).select("band", "node")
    sigs = maybe_in(firsts.select("node", "n", "sig"), "node", small)
    wide = small.join(sigs, "node").select("band", "node", "n", "sig")
    return wide.repartition("band").sortWithinPartitions("band").mapInArrow(bucketed(threshold, mantissa, exact), "a bigint, b bigint").union(whole)
