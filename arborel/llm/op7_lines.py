"""Line dedup of fuzzy lines by MinHash.

A line's set holds its distinct shingles of `shingle` characters (a shorter line is one shingle): FINE in the query op7_lines, where one changed
character inside a line of 49 and more still leaves a similarity of 0.8; SHINGLE by default in the functions. A line's signature are the
registers of 256 buckets, of which the empty ones borrow from others in an order that is the same for all lines, so that short lines, too, agree in a
register as often as they are similar. BANDS bands of ROWS registers find candidates; links have an exact Jaccard similarity of THRESHOLD and more;
distributed union-find makes components, of which the first line (smallest doc_id, then line number) stays. A pair at the threshold is missed by
all bands with a chance of 7e-4, one of 0.85 with 1e-5; two lines of a similarity of 0.05 share a band with one of 4e-7.

Lines meet by what they say: a line is known by a 64-bit hash of its text while candidates are found, by two (128 bits) where lines are judged.
Only hashes of lines move, besides the texts of candidates, each once a group. Band keys travel packed, 12 bytes each; of a key that many lines have, a worker
sends MOST to the key's task and deals the rest out, and its lines are searched in blocks.

Lines are what stands between line feeds. White lines are separators: they are always kept and linked with nothing. Null and empty
texts have one empty line. Rows that repeat give lines of their own, so all but one copy go; of equal (doc_id, line number) the first read
stays. A null doc_id is the smallest. Equal lines, even if they are a third of all, are one node, and very long lines are read whole. An empty table
gives no rows; other columns aren't read, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, free, maybe_in, small_batches, stored, table
from .neardup import BLOCK, grouped, mix, placed, search_clusters

SHINGLE, FINE, THRESHOLD, BUCKET_BITS, MANTISSA = 9, 5, 0.8, 8, 10
ROWS, BANDS = 6, 24
#: Characters whose shingles are hashed at once (few, so that their hashes stay in a core's cache), characters and lines that are sketched or searched at once.
PIECE, CHUNK, LINES = 1 << 15, 1 << 18, 1024
#: Band keys that a worker gathers before it sends them; lines of a key that it sends of them to the key's own task; keys that a task compares.
PACK, MOST, COUNTED = 1 << 20, 16, 1 << 20
#: Lines that a worker remembers, so as to sketch equal ones once.
SEEN = 1 << 18
SEED = 42  # of the built-in xxhash64
WHITE = " \t\r\x0b\x0c"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def rolled(chars: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` characters: polynomials in PRIME, from those of half the width."""
    out, span = chars, 1
    for bit in f"{width:b}"[1:]:
        out = out[:-span] * np.uint64(pow(int(PRIME), span, 1 << 64)) + out[span:]
        span *= 2
        if bit == "1":
            out = out[:-1] * PRIME + chars[span:]
            span += 1
    return mix(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def char_set(line: bytes | str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a line's shingles."""
    chars = codes(line.decode("utf-8", "surrogatepass") if isinstance(line, bytes) else line)
    return distinct(rolled(chars, min(shingle, len(chars)))) if len(chars) else np.zeros(0, np.uint64)


def char_sets(lines: list[str], shingle: int) -> list[np.ndarray]:
    """The set of each line; shingles of many lines are hashed at once."""
    out, at = [], 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + len(lines[end]) <= PIECE):
            total += len(lines[end])
            end += 1
        hashes = rolled(codes("".join(lines[at:end])), shingle) if total >= shingle else None
        start = 0
        for line in lines[at:end]:
            n = len(line)
            out.append(distinct(hashes[start : start + n - shingle + 1]) if n >= shingle else char_set(line, shingle))
            start += n
        at = end
    return out


def sketch(lines: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Registers of several lines at once: lines x buckets, as neardup.registers makes them of each line's set."""
    least = np.full(len(lines) << BUCKET_BITS, ~np.uint64(0))
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + len(lines[end]) <= PIECE):
            total += len(lines[end])
            end += 1
        part = lines[at:end]
        lengths = np.array([len(x) for x in part])
        ends = np.cumsum(lengths)
        chars = codes("".join(part))
        if total >= shingle:
            hashes = rolled(chars, shingle)
            rest = hashes << np.uint64(BUCKET_BITS)
            over = (ends[:, None] - np.arange(1, shingle)).ravel()  # windows that run into the next line
            rest[over[(over >= 0) & (over < len(rest))]] = ~np.uint64(0)
            bucket = np.repeat(np.arange(at, end) << BUCKET_BITS, lengths)[: len(hashes)]
            bucket += (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            np.minimum.at(least, bucket, rest)
        for width in sorted({n for n in lengths.tolist() if n < shingle}):
            some = np.flatnonzero(lengths == width)
            h = rolled(chars, width)[ends[some] - width]
            least[((at + some) << BUCKET_BITS) + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] = h << np.uint64(BUCKET_BITS)
        at = end
    filled = least != ~np.uint64(0)
    top = (least >> np.uint64(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64((1 << (16 - MANTISSA)) - 2))
    below = (least << zeros) << np.uint64(1)
    regs = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | (below >> np.uint64(64 - MANTISSA))
    return np.where(filled, regs, 0).astype(np.uint16).reshape(len(lines), 1 << BUCKET_BITS)


ORDER = np.argsort(np.random.default_rng(64).random((1 << BUCKET_BITS, 1 << BUCKET_BITS)), axis=1).astype(np.int16)
#: By step, then by bucket.
TURNS = ORDER.T.astype(np.int64)


def filled(regs: np.ndarray) -> np.ndarray:
    """The first ROWS * BANDS registers of each line, where an empty one takes the first that isn't in its bucket's ORDER of buckets."""
    out = regs[:, : ROWS * BANDS].ravel()
    spot = np.flatnonzero(out == 0)
    line, bucket = np.divmod(spot, ROWS * BANDS)
    start, regs = line * regs.shape[1], regs.ravel()
    for turn in TURNS:
        if not len(spot):
            break
        found = regs[start + turn[bucket]]
        out[spot] = found
        empty = np.flatnonzero(found == 0)
        spot, start, bucket = spot[empty], start[empty], bucket[empty]
    return out.reshape(-1, ROWS * BANDS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Lines x BANDS keys."""
    grid = filled(regs).astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for k in range(ROWS):
        out = mix(out * PRIME + grid[:, :, k])
    return out


def packs(buckets: int, shingle: int):
    """Texts to (part, home, kind, tags, lines): of bucket `home` the band keys' lower halves and the hashes of the lines that have them. Kind 0: of
    keys that few of the PACK have; 1: MOST of each other key; 2: the rest of those, dealt out."""

    def emit(keys, lines, salt):
        order = np.argsort(keys)
        keys, lines = keys[order], lines[order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        counts = np.diff(edges)
        # homes ascend with the keys
        home = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        tags = keys.astype(np.uint32)
        kind = np.zeros(len(keys), np.int64)
        if counts.max() > MOST:
            rank = np.arange(len(keys)) - np.repeat(edges[:-1], counts)
            kind = np.where(np.repeat(counts, counts) <= MOST, 0, np.where(rank < MOST, 1, 2))
            order = np.argsort(home * 3 + kind, kind="stable")
            home, kind, tags, lines = home[order], kind[order], tags[order], lines[order]
        group = home * 3 + kind
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        first = edges[:-1]
        part = np.where(kind[first] == 2, buckets + np.int64(salt), home[first])
        cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        columns = [pa.array(part, pa.int64()), pa.array(home[first], pa.int64()), pa.array(kind[first], pa.int32()), pa.array([tags[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([lines[a:b].tobytes() for a, b in cut], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "home", "kind", "tags", "lines"])

    def run(batches):
        seen: set[int] = set()
        fresh, hashes, size, parts, held = [], [], 0, [], 0

        def sketched():
            nonlocal fresh, hashes, size, held
            if fresh:
                keys = band_keys(sketch(fresh, shingle))
                parts.append((keys, np.array(hashes, np.uint64)))
                held += keys.size
            fresh, hashes, size = [], [], 0

        def sent():
            nonlocal held
            keys, lines = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            held = 0
            salt = int(lines[0] & np.uint64(0xFFFFFF))
            lines, once = np.unique(lines, return_index=True)
            return emit(keys[once].ravel(), np.repeat(lines, BANDS), salt)

        for batch in batches:
            for at in range(0, len(batch), 64):
                for text in batch["text"][at : at + 64].to_pylist():
                    for line in text.split("\n"):
                        if not line.strip(WHITE):
                            continue
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed=SEED)
                        if h in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        fresh.append(line)
                        hashes.append(h)
                        size += len(line)
                        if size >= CHUNK or len(fresh) >= LINES:
                            sketched()
                            if held >= PACK:
                                yield sent()
        sketched()
        if held:
            yield sent()

    return run


def gathered(group: pa.Table) -> pa.Table:
    """A bucket's packs to (nodes, band, node): nodes are the lines of a key, where they are all known here and BLOCK at most; else a row a line."""
    kinds, homes = group["kind"].to_numpy(), group["home"].to_numpy()
    tags = [np.frombuffer(x, np.uint32) for x in group["tags"].to_pylist()]
    lines = [np.frombuffer(x, np.uint64) for x in group["lines"].to_pylist()]
    loose = [k for k, x in enumerate(kinds) if x == 2]
    bands, alone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in loose:
        bands.append(homes[k] << 32 | tags[k].astype(np.int64))
        alone.append(lines[k].view(np.int64))
    own = [k for k, x in enumerate(kinds) if x != 2]
    values, offsets = np.zeros(0, np.int64), [0]
    if own:
        tag, line = np.concatenate([tags[k] for k in own]), np.concatenate([lines[k] for k in own]).view(np.int64)
        more = np.repeat(kinds[own] == 1, [len(tags[k]) for k in own])
        # most keys have one line, which meets nothing
        order = np.argsort(tag)
        same = np.r_[False, tag[order[1:]] == tag[order[:-1]], False]
        order = order[same[1:] | same[:-1]]
        tag, line, more = tag[order].astype(np.int64), line[order], more[order]
        order = np.lexsort((line, tag))
        tag, line, more = tag[order], line[order], more[order]
        edges = np.flatnonzero(np.r_[np.ones(min(1, len(tag)), bool), tag[1:] != tag[:-1]])
        hot = np.repeat(np.logical_or.reduceat(more, edges), np.diff(np.r_[edges, len(tag)])) if len(tag) else more
        new = np.r_[np.ones(min(1, len(tag)), bool), (tag[1:] != tag[:-1]) | (line[1:] != line[:-1])]
        tag, line, hot = tag[new], line[new], hot[new]
        edges = np.unique(np.r_[0, np.flatnonzero(tag[1:] != tag[:-1]) + 1, len(tag)])
        counts = np.diff(edges)
        loose = np.repeat(hot[edges[:-1]] | (counts > BLOCK), counts)
        bands.append(homes[own[0]] << 32 | tag[loose])
        alone.append(line[loose])
        together = ~loose & np.repeat(counts > 1, counts)
        values = line[together]
        sizes = counts[(counts > 1) & ~loose[edges[:-1]]]
        offsets = np.r_[0, np.cumsum(sizes)]
    band, node = np.concatenate(bands), np.concatenate(alone)
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
    n, m = len(nodes), len(band)
    return pa.table({"nodes": pa.concat_arrays([nodes, pa.nulls(m, nodes.type)]), "band": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(band, pa.int64())]), "node": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(node, pa.int64())])})


def linked_lines(threshold: float, shingle: int):
    """For sorted blocks (cluster, block, ..., node, payload) the verified links that connect what is similar in a block. Rows with comp and query are
    those of blocks whose classes are known in part."""
    bar = round(100 * threshold)

    def two(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < bar * max(len(a), len(b)):
            return False
        both = np.sort(np.concatenate([a, b]))
        both = int((both[1:] == both[:-1]).sum())
        return 100 * both >= bar * (len(a) + len(b) - both)

    def like(sets: list[np.ndarray]):
        """A function of i: which sets are similar to set i, by the distinct shingles of all, each known by a number."""
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        number = np.empty(len(every), np.int64)
        number[order] = np.cumsum(np.r_[0, every[order[1:]] != every[order[:-1]]])
        holds = np.zeros(len(every), np.int32)

        def similar(i: int) -> np.ndarray:
            own = number[ends[i] - sizes[i] : ends[i]]
            holds[own] = 1
            both = np.add.reduceat(holds[number], ends - sizes)
            holds[own] = 0
            return 100 * both >= bar * (sizes[i] + sizes - both)

        return similar

    def block(nodes: np.ndarray, sets: list[np.ndarray], label=None, query=None) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        if label is None and len(nodes) == 2:
            return [(int(nodes[0]), int(nodes[1]))] if two(*sets) else []
        similar, out = like(sets), []
        if label is not None:
            for i in np.flatnonzero(query):
                for j in np.flatnonzero(similar(i) & (label != label[i])):
                    if label[i] != label[j]:
                        out.append((int(nodes[i]), int(nodes[j])))
                        label[label == label[i]] = label[j]
            return out
        left = np.ones(len(nodes), bool)
        while left.any():
            front = [int(left.argmax())]
            left[front[0]] = False
            while front and left.any():
                i = front.pop()
                for j in np.flatnonzero(similar(i) & left).tolist():
                    left[j] = False
                    out.append((int(nodes[i]), int(nodes[j])))
                    front.append(j)
        return out

    def task(keys: list[str]):
        def run(batches):
            for groups in grouped(batches, keys):
                links, known = [], "comp" in groups[0].column_names if groups else False
                some, size = [], 0
                for k, g in enumerate(groups):
                    nodes, keep = np.unique(g["node"].to_numpy(), return_index=True)
                    lines = g["payload"].take(pa.array(keep)).to_pylist()
                    some.append((nodes, lines, g["comp"].to_numpy()[keep].copy() if known else None, g["query"].to_numpy(zero_copy_only=False)[keep] if known else None))
                    size += sum(map(len, lines))
                    if size >= CHUNK or k == len(groups) - 1:
                        sets = iter(char_sets([x for _, part, _, _ in some for x in part], shingle))
                        for nodes, lines, label, query in some:
                            links += block(nodes, [next(sets) for _ in lines], label, query)
                        some, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        return run

    return task


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def full(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09\x0b-\x0d]")


def judged_rows(docs: DataFrame, threshold: float, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(rid, doc_id, k1, k2, n_lines, gone): a row for each row; gone lists the numbers of lines that go, null for none; k1 and k2 are hashes of id and text."""
    small_batches(docs.sparkSession)
    hashed = F.transform(split_lines(text_column), lambda x: F.when(full(x), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"))))
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(id_column, text_column).alias("k1"), F.xxhash64(text_column, id_column, F.lit(1)).alias("k2"), hashed.alias("h"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.size("h"))).first()[0] or 0
    known = line_classes(docs, total, threshold, text_column, shingle)

    lines = rows.select("rid", "doc_id", F.posexplode("h").alias("line", "x")).where("x is not null").select("rid", "doc_id", "line", F.col("x").alias("same"), F.col("x.h1").alias("h1"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "line", "rid")
    groups = stored(lines.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.col("same.h1")))
    # should two lines ever share the first hash, the one of the smaller second hash was searched
    searched = known.join(groups, "node").groupBy("node", "comp").agg(F.min(F.struct("same", "first")).alias("x")).select("comp", "x.same", "x.first")
    searched = stored(searched)
    least = searched.groupBy("comp").agg(F.min("first").alias("stays"))
    several = attach(searched, least, "comp", "same", "inner").select("same", "stays")
    alone = groups.where("copies > 1").select("same", F.col("first").alias("stays")).join(several.select("same"), "same", "left_anti")
    met = stored(several.union(alone).withColumn("h1", F.col("same.h1")))
    # a line that no other is like meets nothing
    near = maybe_in(lines, "h1", met).drop("h1")
    gone = attach(near, met.select("same", "stays"), "same", "rid", "inner").where((F.col("rid") != F.col("stays.rid")) | (F.col("line") != F.col("stays.line")))
    gone = gone.groupBy("rid").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    return rows.select("rid", "doc_id", "k1", "k2", F.size("h").alias("n_lines")).join(gone, "rid", "left")


def joined(groups: DataFrame) -> DataFrame:
    """The groups (nodes), each once; those that have their least node in common are one, if that has BLOCK nodes at most. A node is in one group a band
    at most, so few meet, most of them in the same lines."""
    by = groups.groupBy(F.col("nodes")[0].alias("least")).agg(F.collect_set("nodes").alias("sets"))
    every = F.array_sort(F.array_distinct(F.flatten("sets")))
    return by.select("sets", every.alias("every")).select(F.explode(F.when(F.size("every") <= BLOCK, F.array("every")).otherwise(F.col("sets"))).alias("nodes"))


def line_classes(docs: DataFrame, total: int, threshold: float, text_column: str, shingle: int) -> DataFrame:
    """(node, comp): the lines, by their 64-bit hashes, that links connect, with the smallest of each component."""
    buckets = max(16, total * BANDS // COUNTED)
    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    packed = texts.mapInArrow(packs(buckets, shingle), "part bigint, home bigint, kind int, tags binary, lines binary")
    found = stored(packed.groupBy("part").applyInArrow(gathered, "nodes array<bigint>, band bigint, node bigint"))
    groups = joined(found.where("nodes is not null"))
    where = stored(groups.select(F.xxhash64("nodes").alias("cluster"), F.explode("nodes").alias("node"), F.lit(1).alias("blocks"), F.lit(0).alias("block")))
    hot = stored(found.where("band is not null").select(F.xxhash64("band", F.lit(1)).alias("cluster"), "node").distinct())
    if hot.take(1):
        where = where.union(placed(hot))

    def get(wanted: DataFrame) -> DataFrame:
        wanted = stored(wanted)
        lines = texts.select(F.explode(split_lines("text")).alias("payload")).where(full(F.col("payload"))).withColumn("node", F.xxhash64("payload"))
        lines = maybe_in(lines, "node", wanted).groupBy("node").agg(F.min(F.struct(F.xxhash64("payload", F.lit(1)).alias("h2"), "payload")).alias("x"))
        return wanted.join(lines, "node").withColumn("payload", F.col("x.payload")).drop("x")

    return search_clusters(where, get, linked_lines(threshold, shingle))


def fuzzy_lines(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, line, kept): a row for each line; k1 and k2 are hashes of its row's id and text."""
    found = judged_rows(docs, threshold, id_column, text_column, shingle)
    marks = F.expr("transform(sequence(0, n_lines - 1), i -> gone is null or not array_contains(gone, i))")
    return found.select("doc_id", "k1", "k2", F.posexplode(marks).alias("line", "kept"))


def without_fuzzy_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the lines that stay; all columns are kept. Repeated rows are taken together: a line stays in all if it stays in one."""
    k1, k2, gone = free(docs, "_k1", "_k2", "_gone")
    found = stored(judged_rows(docs, threshold, "doc_id", "text", SHINGLE))
    gone_in = found.select("k1", "k2", F.explode(F.coalesce("gone", F.array().cast("array<int>"))).alias("line")).groupBy("k1", "k2", "line").agg(F.count(F.lit(1)).alias("n"))
    rows = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    lost = gone_in.join(rows, ["k1", "k2"]).where("n = rows").groupBy("k1", "k2").agg(F.collect_list("line").alias(gone)).toDF(k1, k2, gone)
    keyed = docs.withColumn(k1, F.xxhash64("doc_id", "text")).withColumn(k2, F.xxhash64("text", "doc_id", F.lit(1))).join(lost, [k1, k2], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return keyed.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).drop(k1, k2, gone)


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped): a row for each row; dropped lists line numbers, from 0, ascending."""
    found = judged_rows(table(spark, sf_dir, "documents"), THRESHOLD, "doc_id", "text", FINE)
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - lost).cast("long").alias("n_kept"), F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))
