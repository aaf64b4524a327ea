"""Near-duplicate documents: MinHash candidates, sequential Bayesian pruning, exact verification.

Documents with equal shingle sets are one representative. Signatures of
representatives are banded so that a pair at the threshold shares a band but
for about one in 10**7 or fewer; a band's bucket proposes pairs. Signatures of a pair
are compared a batch at a time, and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold (uniform prior)
is below `miss`. Survivors are verified on their full shingle sets.

Pairs whose set sizes alone rule out the threshold are never compared. A bucket
of up to eight members proposes all its pairs as rows. A larger one first
proposes each member against one hub, the member that shares its buckets with
most others, as the text that a group was copied from does; those links join
most of a group of copies. All other pairs of a large bucket whose members are
then in different components are compared in blocks: the bucket is dealt into
parts of about 2,048 members by a hash, two parts meet in a block, and a block
compares signatures as arrays and returns only the pairs that Bayesian pruning
leaves. So every pair of every bucket is either inside one component already or
compared; nothing is capped. Blocks compare long signatures, the lowest byte of
each of 1,024 further hashes, where chance can only raise the number of matches.
A pair that shares several buckets is returned by the first of them alone.
The arithmetic of blocks, not their rows, grows with the square of those members
of a bucket that link with nobody near.

Texts without words have no shingles and link with nothing; fewer than `words`
words are one shingle. Null counts as empty. Rows without doc_id are left out.
Rows that repeat a doc_id are judged by their own texts and linked like any
others; equal rows share one decision, one row each. Ties of sets go to the
smallest doc_id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import discard, frequent, joined, small_batches, written

HASHES, ROWS, SMALL, BATCH = 128, 4, 8, 16
#: Members of a bucket in one part; bytes of a long signature, compared so many at a time; those that a block compares for all its pairs; ways to deal a bucket's rows in a join.
PART, LONG, STEP, DENSE, SALT = 2048, 1024, 32, 64, 16


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row's begin."""
    data = K.LOWER[data]
    starts, ends, ranges = K.words(data, offsets, K.SPACE_WORDS)
    values, size = K.span_hashes(data, starts, ends), np.diff(ranges)
    grams = K.gram_hashes(values, n)
    row = np.repeat(np.arange(len(size)), size)[: len(grams)]
    whole = np.arange(len(grams)) + n <= ranges[row + 1]
    parts, rows = [grams[whole]], [row[whole]]
    for m in range(1, n):
        short = np.flatnonzero(size == m)
        if len(short):
            parts.append(K.mix64(K.gram_hashes(values, m)[ranges[short]] + K.U64(m)))
            rows.append(short)
    h, r = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16) if len(size) < 1 << 16 else r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(size) + 1))


def _family(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, size, dtype=np.uint64) * K.U64(2) + K.U64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


def _sketch(n: int):
    a, b = _family(20240501, HASHES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_slices(batch, "text", 1 << 20):
                h, at = _shingles(data, offsets, n)
                count = np.diff(at)
                some = np.flatnonzero(count)
                sig = np.zeros((hi - lo, HASHES), np.uint32)
                if len(some):
                    for i in range(HASHES):
                        sig[some, i] = np.minimum.reduceat((h * a[i] + b[i]) >> K.U64(32), at[some])
                raw, digests = h.tobytes(), []
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    digests.append(xxhash.xxh3_128_digest(raw[8 * s : 8 * e]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in (0, 1)), pa.array(count), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    return rows


def _sets(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_slices(batch, "text", 1 << 20):
                h, at = _shingles(data, offsets, n)
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([raw[8 * s : 8 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["node", "hashes"])

    return rows


def least_matches(percent: int, miss: float, hashes: int = HASHES, batch: int = BATCH) -> np.ndarray:
    """After n = batch, 2*batch.. hashes: the fewest matches with P(similarity >= percent/100) >= miss.

    With a uniform prior that posterior is P(Binomial(n + 1, percent/100) <= matches).
    """
    t, out = min(percent / 100, 1 - 1e-12), []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        out.append(m)
    return np.array(out)


def _prune(percent: int, miss: float):
    least = least_matches(percent, miss)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            live, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for step, m in enumerate(least):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches[live] += (x[live, part] == y[live, part]).sum(1)
                live = live[matches[live] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(live)) for i in (0, 1)], ["a", "b"])

    return rows


def _block(percent: int, miss: float):
    """Pairs of a block in different components that sizes and signatures don't rule out."""
    least = least_matches(percent, miss, LONG, STEP)

    def compared(bucket: int, low: int, high: int, part: np.ndarray, node: np.ndarray, n: np.ndarray, component: np.ndarray, buckets: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        columns = np.ascontiguousarray(sig[right].T)
        for s in range(0, len(left), 64):
            i = left[s : s + 64]
            big, small = np.maximum(n[i][:, None], n[right]), np.minimum(n[i][:, None], n[right])
            live = (component[i][:, None] != component[right]) & (100 * small >= percent * big)
            if low == high:
                live &= node[i][:, None] < node[right]
            if not live.any():
                continue
            matches = np.zeros(live.shape, np.uint8)
            for step in range(DENSE // STEP):
                for h in range(step * STEP, (step + 1) * STEP):
                    matches += sig[i, h][:, None] == columns[h]
                live &= matches >= least[step]
            x, y = np.nonzero(live)
            total = matches[x, y].astype(np.int64)
            x, y = i[x], right[y]
            for step in range(DENSE // STEP, len(least)):
                at = slice(step * STEP, (step + 1) * STEP)
                total += (sig[x, at] == sig[y, at]).sum(1)
                keep = total >= least[step]
                x, y, total = x[keep], y[keep], total[keep]
            shared = buckets[x] == buckets[y]
            first = buckets[x, shared.argmax(1)] == bucket
            x, y = x[first], y[first]
            yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                bucket, low, high = (batch.column(i)[row].as_py() for i in range(3))
                part, node, n, component, buckets, sig = batch.column(3)[row].values.flatten()
                buckets = buckets.flatten().to_numpy().reshape(-1, HASHES // ROWS)
                sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, LONG)
                for a, b in compared(bucket, low, high, part.to_numpy(), node.to_numpy(), n.to_numpy(), component.to_numpy(), buckets, sig):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long signatures of shingle sets."""
    a, b = _family(20240502, LONG)
    for batch in batches:
        out = []
        for hashes in batch.column(1):
            h, low = np.frombuffer(hashes.as_buffer(), np.uint64), np.full(LONG, (1 << 64) - 1, np.uint64)
            for s in range(0, len(h), 1024):
                low = np.minimum(low, (h[s : s + 1024, None] * a + b).min(0))
            out.append((low >> K.U64(32)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "long_sig"])


def _verify(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) * 100 < percent * len(q) or len(q) * 100 < percent * len(p):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return rows


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash of each document.

    percent: least Jaccard similarity of linked documents; words: words of a
    shingle; miss: posterior probability at which a candidate is given up.
    text_hash: xxhash64 of the text, which tells rows of one doc_id apart.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketch = texts.mapInArrow(_sketch(words), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")
    # rows get numbers when they are written, so that a node is one row whatever its doc_id
    sketch = written(sketch.withColumn("node", F.monotonically_increasing_id()), "sketch")
    first = F.min(F.struct("doc_id", "node", "text_hash", "sig")).alias("first")
    one = sketch.where("n_shingles > 0").groupBy("n_shingles", "digest").agg(first, F.count(F.lit(1)).alias("copies"))
    reps = written(one.select("n_shingles", "digest", "copies", "first.*"), "representatives")
    of_bands = F.expr(f"transform(sequence(0, {HASHES // ROWS - 1}), i -> xxhash64(substring(sig, i * {4 * ROWS} + 1, {4 * ROWS}), i))")
    bands = reps.select("node", F.col("n_shingles").alias("n"), F.posexplode(of_bands).alias("band", "bucket"))
    crowd = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = written(bands.select("bucket", "node", "n").join(crowd, "bucket"), "members")
    inside = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    sets = texts.join(inside.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "text").mapInArrow(_sets(words), "node long, hashes binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    sigs = reps.select("node", "sig")

    def links(pairs: DataFrame) -> DataFrame:
        left, right = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        likely = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent, miss), "a long, b long")
        return verified(written(likely, "likely"))

    def verified(likely: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "ab")
        return likely.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")

    def fitting(x: str, y: str) -> str:
        """Whether sets of these sizes can be similar enough."""
        return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"

    small = members.where(F.col("members") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("nodes"))
    every_pair = "flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> struct(x, y))))"
    pairs = small.select(F.explode(F.expr(every_pair)).alias("p"))
    pairs = pairs.where(fitting("p.x.n", "p.y.n")).select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"))
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    large = written(members.where(F.col("members") > SMALL).join(weight, "node"), "crowded")
    leader = F.min(F.struct((-F.col("weight")).alias("rank"), F.xxhash64("node").alias("turn"), "node", "n"))
    hubs = large.groupBy("bucket").agg(leader.alias("hub")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(hubs, ["bucket", "salt"])
    met = met.where("node != hub.node").where(fitting("n", "hub.n"))
    met = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    edges = written(links(pairs.unionByName(met)), "edges")
    labels = components(edges)
    discard(members)

    # pairs of large buckets that are still in different components meet in blocks
    apart = large.join(labels, "node", "left").select("bucket", "node", "n", "members", F.coalesce("component", "node").alias("component"))
    apart = apart.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / PART)).cast("int"))
    apart = written(apart, "apart")
    reach = apart.groupBy("bucket", "part").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    other = reach.select("bucket", F.col("part").alias("high"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    blocks = reach.withColumnRenamed("part", "low").join(other, "bucket").where("low <= high and least(least, least2) < greatest(most, most2)")
    blocks = written(blocks.select("bucket", "low", "high"), "blocks")
    sides = [apart.join(blocks.where(test).withColumn("part", F.col(side)), ["bucket", "part"]) for side, test in (("low", "true"), ("high", "low < high"))]
    dealt = written(sides[0].unionByName(sides[1]), "dealt")
    nodes = dealt.select("node").distinct()
    long_sig = written(sets.join(nodes, "node", "left_semi").select("node", "hashes").mapInArrow(_long, "node long, long_sig binary"), "long")
    rows = dealt.join(long_sig, "node").join(reps.select("node", of_bands.alias("buckets")), "node")
    whole = F.collect_list(F.struct("part", "node", "n", "component", "buckets", "long_sig"))
    blocks = rows.groupBy("bucket", "low", "high").agg(whole.alias("rows"))
    rest = written(blocks.select("bucket", "low", "high", "rows").mapInArrow(_block(percent, miss), "a long, b long"), "rest")
    found = written(verified(rest), "edges")
    if not found.isEmpty():
        labels = components(edges.unionByName(found))

    linked = reps.select("n_shingles", "digest", "node", "doc_id").join(labels, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = linked.join(least, "component").select("n_shingles", "digest", "component_id")
    alone = reps.select("n_shingles", "digest", F.col("doc_id").alias("own"))
    of_sets = written(alone.join(grouped, ["n_shingles", "digest"], "left").select("n_shingles", "digest", F.coalesce("component_id", "own").alias("component_id")), "components")
    discard(large, sets, apart, dealt, long_sig)
    same = ["n_shingles", "digest"]
    out = joined(sketch.select("doc_id", "text_hash", *same), of_sets, same, frequent(reps, same, "copies"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "text_hash")
