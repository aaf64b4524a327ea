"""Where texts repeat: the part that the two substring operators share.

A window is `length` consecutive tokens (words or bytes) of one document. The
windows of a document fall into runs that share their minimizer k-gram, so
equal windows always have equal anchors. That gives about 2/(length-k+2) rows
a token rather than one, and rows whose anchor occurs once in the corpus are
dropped before any text moves. What is left is described by
(anchor, content digest): the occurrences of one content are one path.

A document is a row's text under its doc_id. Equal rows are one document, cut
alike; other texts under the same doc_id are documents of their own, told apart
by a slot that the high bits of positions hold (0 for all but these). Rows
without doc_id have no place in the order and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, key_filter, may_hold, small_batches, written

PATHS = "anchor long, c1 long, c2 long, doc_id long, pos long, run int, content binary"
LINKS = "b1 long, b2 long, a1 long, a2 long"
#: Positions take the low bits: a text has fewer than 2**31 bytes.
SLOT = 32
PLACE = (1 << SLOT) - 1


@dataclass(frozen=True)
class Windows:
    """unit: 'word' or 'byte'; length: tokens in a window; k: tokens in an anchor."""

    unit: str
    length: int
    k: int
    slice_bytes: int = 1 << 20

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """(values, row ranges, normalised bytes, where tokens begin in them)."""
        if self.unit == "byte":
            return data.astype(K.U64) + K.U64(1), offsets, data, None
        starts, ends, ranges = K.words(data, offsets, K.SPACE_WORDS)
        return K.span_hashes(data, starts, ends), ranges, *K.joined_words(data, starts, ends)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, slot and text of each row with a doc_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    texts = texts.withColumn("hash", F.xxhash64("text"))
    several = texts.groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least != most").select("doc_id")
    slots = texts.select("doc_id", "hash").join(several, "doc_id", "left_semi").distinct()
    slots = slots.withColumn("slot", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1)
    slots = written(slots, "slots")
    return texts.join(slots, ["doc_id", "hash"], "left").select("doc_id", F.coalesce("slot", F.lit(0)).alias("slot"), "text")


def _scan(spec: Windows, held: Broadcast | None = None, anchors: bool = False):
    """The runs of each text, or their anchors alone; with a filter, those whose anchor it may hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, offsets in K.text_slices(batch, "text", spec.slice_bytes):
                values, ranges, _, _ = spec.tokens(data, offsets)
                row_end = np.repeat(ranges[1:], np.diff(ranges))
                first, run, off, anchor = K.super_kmers(values, row_end, spec.length, spec.k)
                if held is not None:
                    maybe = may_hold(held, anchor)
                    first, run, anchor = first[maybe], run[maybe], anchor[maybe]
                if anchors:
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(anchor))], ["anchor"])
                    continue
                row = np.searchsorted(ranges, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(anchor)), pa.array(ids[lo + row]), pa.array(first - ranges[row] + (slot[lo + row].astype(np.int64) << SLOT)), pa.array(run.astype(np.int32))], ["anchor", "doc_id", "pos", "run"])

    return rows


def _paths(spec: Windows, names: list[str], links: bool):
    """For each document its repeated runs with their content's digest.

    The content comes with a row that is the content's first in the task, or
    lies before all rows seen so far, so the first of all is among these.
    links: with the digests of the runs that touch it before and after, 0 where none does.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            ids, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            runs = batch.column(3)
            at = runs.offsets.to_numpy()
            flat = runs.flatten()
            pos, run, anchor = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for lo, hi, data, offsets in K.text_slices(batch, "text", spec.slice_bytes):
                _, ranges, raw, begin = spec.tokens(data, offsets)
                raw = raw.tobytes()
                n = at[lo : hi + 1] - at[0]
                row = np.repeat(np.arange(hi - lo), np.diff(n))
                p, r, h = pos[n[0] : n[-1]] & PLACE, run[n[0] : n[-1]], anchor[n[0] : n[-1]]
                order = np.lexsort((p, row))
                p, r, h = p[order], r[order], h[order]
                s = ranges[row] + p
                e = s + r + spec.length - 1
                if begin is not None:
                    s, e = begin[s], begin[e] - 1
                place = p + (slot[lo + row].astype(np.int64) << SLOT)
                spans = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                digests = [xxhash.xxh3_128_digest(x) for x in spans]
                c1, c2 = (K.signed(x) for x in np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).T.astype(K.U64))
                content = []
                for span, digest, here in zip(spans, digests, zip(ids[lo + row].tolist(), place.tolist(), strict=True), strict=True):
                    known = seen.get(digest)
                    new = known is None or here < known
                    if new:
                        seen[digest] = here
                    content.append(span if new else None)
                if len(seen) > 500_000:
                    seen.clear()
                out = [*map(pa.array, (h, c1, c2, ids[lo + row], place, r)), pa.array(content, pa.binary())]
                if links:
                    near = np.zeros((4, len(s)), np.int64)
                    touch = (row[1:] == row[:-1]) & (p[:-1] + r[:-1] == p[1:])
                    near[0, 1:], near[1, 1:] = np.where(touch, c1[:-1], 0), np.where(touch, c2[:-1], 0)
                    near[2, :-1], near[3, :-1] = np.where(touch, c1[1:], 0), np.where(touch, c2[1:], 0)
                    out += map(pa.array, near)
                yield pa.RecordBatch.from_arrays(out, names)

    return rows


def paths(texts: DataFrame, spec: Windows, within: bool, links: bool = False) -> DataFrame:
    """A written table of runs of numbered texts whose anchor repeats: PATHS, and LINKS if asked for. content is null where another row has it.

    within: an anchor that repeats in one document alone counts too.
    """
    row = "anchor long, doc_id long, pos long, run int"
    runs = texts.mapInArrow(_scan(spec, anchors=within), "anchor long" if within else row)
    many = F.count(F.lit(1)) > 1 if within else F.min("doc_id") < F.max("doc_id")
    repeated = written(runs.groupBy("anchor").agg(many.alias("many")).where("many").select("anchor"), "anchors")
    # runs of other anchors end where they are found, but for the few that the filter can't tell apart
    runs = texts.mapInArrow(_scan(spec, key_filter(repeated)), row)
    kept = runs.join(repeated.hint("shuffle_hash"), "anchor", "left_semi").withColumn("slot", F.shiftright("pos", SLOT).cast("int"))
    kept = written(kept.groupBy("doc_id", "slot").agg(F.collect_set(F.struct("pos", "run", "anchor")).alias("runs")), "kept")
    discard(repeated)
    schema = f"{PATHS}, {LINKS}" if links else PATHS
    found = texts.join(kept.hint("shuffle_hash"), ["doc_id", "slot"]).select("doc_id", "slot", "text", "runs")
    found = found.mapInArrow(_paths(spec, schema.replace(",", "").split()[::2], links), schema)
    found = written(found, "paths")
    discard(kept)
    return found


def unique_paths(found: DataFrame, *more) -> DataFrame:
    """One row for each (anchor, content): where it first occurs, the content itself, and more aggregates."""
    key = ["anchor", "c1", "c2"]
    first = found.groupBy(key).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.first("run").alias("run"), *more)
    content = found.where("content is not null").select(*key, "content").dropDuplicates(key)
    return first.join(content, key).withColumns({"first_doc": F.col("first.doc_id"), "first_pos": F.col("first.pos")}).drop("first")


def distinct_paths(found: DataFrame) -> DataFrame:
    """What `unique_paths` returns without more aggregates, from the rows with content alone, which move once."""
    key = ["anchor", "c1", "c2"]
    rows = found.where("content is not null").repartition(*key)
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    rows = rows.groupBy(key).agg(first, F.first("run").alias("run"), F.first("content").alias("content"))
    return rows.select(*key, "run", "content", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def _cut(spec: Windows):
    """(doc_id, size, removed, spans, sha256 of what stays) of each document."""
    import hashlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(count)])
            flat = lists.flatten()
            b, e = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            size, gone, spans, kept = [], [], [], []
            for lo, hi, data, offsets in K.text_slices(batch, "text", spec.slice_bytes):
                _, ranges, raw, begin = spec.tokens(data, offsets)
                row = np.repeat(np.arange(hi - lo), count[lo:hi])
                cut = K.covered(int(ranges[-1]), ranges[row] + b[at[lo] : at[hi]], ranges[row] + e[at[lo] : at[hi]])
                new = cut.copy()
                new[1:] &= ~cut[:-1]
                inner = ranges[:-1][ranges[:-1] < ranges[1:]]
                new[inner] = cut[inner]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (cut, new)]
                keep = ~cut if begin is None else np.repeat(~cut, np.diff(begin))
                edges = ranges if begin is None else begin[ranges]
                left = np.concatenate([[0], np.cumsum(keep)])[edges]
                raw = raw[keep].tobytes()
                for i in range(hi - lo):
                    text = raw[left[i] : left[i + 1]]
                    kept.append(hashlib.sha256(text if begin is None else text[:-1]).hexdigest())
                size += np.diff(ranges).tolist()
                gone += np.diff(sums[0][ranges]).tolist()
                spans += np.diff(sums[1][ranges]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "size", "n_removed", "n_spans", "kept_sha256"])

    return rows


def without(texts: DataFrame, ranges: DataFrame, spec: Windows, *spent: DataFrame) -> DataFrame:
    """Each numbered text after removing `ranges` (doc_id, slot, cuts array<struct<b,e>> of token positions).

    spent: tables that only `ranges` reads; they go before whole texts move.
    """
    cuts = written(ranges.groupBy("doc_id", "slot").agg(F.flatten(F.collect_set("cuts")).alias("cuts")), "cuts")
    discard(*spent)
    rows = texts.join(cuts.hint("shuffle_hash"), ["doc_id", "slot"], "left").select("doc_id", "slot", "text", "cuts")
    return rows.mapInArrow(_cut(spec), "doc_id long, size long, n_removed long, n_spans long, kept_sha256 string")
