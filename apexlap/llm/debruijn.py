"""Substring dedup of long word passages by De Bruijn compaction.

The graph's vertices are the overlaps of 49 words, its edges the windows of 50.
Edges are found as runs of windows that share a minimizer (see `repeats`); of a
minimizer with a single content, the run is a stretch of edges that never
branches. Each stretch knows which stretch follows and precedes it wherever it
occurs. If that is always the same one, and it is mutual, the two are joined to
one path: degrees come from one aggregate, and pointer jumping joins chains of
stretches in about log2(length) joins. A document that begins or ends inside a
chain counts as a branch, so all stretches of a path occur in the same documents
and the path's first document is that of its head. A minimizer with several
contents is where paths branch: its runs are taken apart into single edges, and
the first document of each comes from a join on the edge's digest.

Source coordinates (doc_id, word position) of heads and edges lead back to the
texts: a path is a long repeated span, verified by the 128-bit digests of all
its stretches, and its words are cut.

Null and empty texts have no words. Rows without doc_id are left out; of rows
that repeat a doc_id, equal ones are one document, cut alike, and none of the
others comes before another. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import PLACE, SLOT, Windows, numbered, paths, unique_paths, without
from .storage import discard, written

KEY = ["anchor", "c1", "c2"]


def compacted(stretches: DataFrame) -> DataFrame:
    """The head of each stretch's path: c1, c2, h1, h2.

    stretches: c1, c2 and the least and greatest of what precedes (b) and
    follows (a), as struct<x1,x2>, zeros where nothing does.
    """
    single = lambda s: (F.col(f"{s}_least") == F.col(f"{s}_most")) & (F.col(f"{s}_least.x1") != 0)
    onward = stretches.where(single("a")).select(F.col("c1").alias("h1"), F.col("c2").alias("h2"), F.col("a_least.x1").alias("c1"), F.col("a_least.x2").alias("c2"))
    back = stretches.where(single("b")).select("c1", "c2", F.col("b_least.x1").alias("h1"), F.col("b_least.x2").alias("h2"))
    linked = back.join(onward, ["c1", "c2", "h1", "h2"], "left_semi")
    # a stretch that isn't entered by a link is the head of its path
    heads = written(stretches.select("c1", "c2").join(linked, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("h1", "c1").alias("h1"), F.coalesce("h2", "c2").alias("h2"), F.col("h1").isNull().alias("done")), "heads")
    while not heads.where("not done").isEmpty():
        of = heads.select(F.col("c1").alias("h1"), F.col("c2").alias("h2"), F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.col("done").alias("jumped"))
        open_ = heads.where("not done").join(of, ["h1", "h2"]).select("c1", "c2", F.col("j1").alias("h1"), F.col("j2").alias("h2"), F.col("jumped").alias("done"))
        jumped = written(heads.where("done").unionByName(open_), "heads")
        discard(heads)
        heads = jumped
    return heads


def remove_repeated_passages(docs: DataFrame, window: int = 50, k: int = 8) -> DataFrame:
    """Cut words covered by a window that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256.
    """
    spec = Windows("word", window, min(k, window))
    texts = numbered(docs)
    found = paths(texts, spec, within=False, links=True)
    near = {x: F.struct(F.col(f"{x}1").alias("x1"), F.col(f"{x}2").alias("x2")) for x in "ba"}
    ends = [f(near[x]).alias(f"{x}_{n}") for x in "ba" for n, f in (("least", F.min), ("most", F.max))]
    distinct = written(unique_paths(found, *ends), "unique")
    branches = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"), "branches")
    unique = distinct.join(branches, "anchor", "left")

    # stretches on the one hand, on the other single edges where paths branch
    stretches = written(unique.where("contents is null").select(*KEY, "first_doc", "run", *(f"{x}_{n}" for x in "ba" for n in ("least", "most"))), "stretches")
    split = unique.where("contents is not null").select(*KEY, "first_doc", "run", F.split(F.col("content").cast("string"), " ").alias("word"))
    edge = F.transform(F.sequence(F.lit(0), F.col("run") - 1), lambda i: F.unhex(F.md5(F.array_join(F.slice("word", i + 1, window), " ").cast("binary"))))
    edges = written(split.select(*KEY, "first_doc", F.posexplode(edge).alias("delta", "edge")), "edges")
    discard(branches, distinct)

    # the paths that stretches join to
    heads = compacted(stretches)
    members = stretches.join(heads, ["c1", "c2"])
    total = members.groupBy("h1", "h2").agg(F.sum("run").alias("d1"))
    places = stretches.select(*KEY, "first_doc").join(total, (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")))
    whole = places.select(*KEY, F.array(F.struct(F.lit(0).cast("long").alias("d0"), "d1", "first_doc")).alias("firsts"))

    # the first document of each edge
    first = written(edges.groupBy("edge").agg(F.min("first_doc").alias("first_doc")), "first")
    each = F.struct(F.col("delta").cast("long").alias("d0"), (F.col("delta") + 1).cast("long").alias("d1"), "first_doc")
    parts = edges.drop("first_doc").join(first, "edge").groupBy(KEY).agg(F.collect_list(each).alias("firsts"))

    firsts = written(whole.unionByName(parts), "firsts")
    discard(edges, first, stretches, heads)
    cuts = F.expr(f"transform(filter(firsts, x -> x.first_doc < doc_id), x -> struct((pos & {PLACE}L) + x.d0 as b, (pos & {PLACE}L) + x.d1 + {window - 1} as e))")
    ranges = found.select(*KEY, "doc_id", "pos").join(firsts, KEY).select("doc_id", F.shiftright("pos", SLOT).cast("int").alias("slot"), cuts.alias("cuts")).where("size(cuts) > 0")
    return without(texts, ranges, spec, found, firsts).withColumnRenamed("size", "n_words")
