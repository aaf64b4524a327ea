"""Spelling variants: words one inserted, deleted or replaced code point apart, found by pairs of trie nodes.

The words are sorted and each node of their trie is numbered; so are the nodes
of the trie of the reversed words. A place in a word is then two integers, the
node of what is before it and the node of what is behind it. Words that agree on
both around a skipped code point replace each other there; a word whose code
point is skipped meets the word that has nothing at that place. Of equal
neighbouring code points only the first is skipped for the latter, so each pair
of words meets once and numbers are compared, never strings. A pair of nodes
holds one word without and at most one word for each letter of the alphabet
with a code point between, so the groups are bounded, and each gives one row a
member with what the others amount to, not its pairs.

Numbering takes a range partitioning of the sorted words. A task numbers the
nodes that its words open; those on the path to its first word that the range
before has too get that range's numbers from a table of one path a partition.
Rows grow with the length of words, not with its square.

Null texts have no words. A run in a document without doc_id is judged as if
that id were empty. Repeated rows count again, an empty table gives an empty
result, extra columns are ignored. Words of equal count go by their code points.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, small_batches, written

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits for what a task numbers or counts, below those of its partition.
BITS = 33


def word_counts(docs: DataFrame, least_length: int = 6, least_n: int = 5, damage: int = 199) -> DataFrame:
    """word, n: the words of all whole texts that are long and frequent enough.

    Of a run whose crc32 of `<doc_id>:<run>` is divisible by damage the code
    point at crc32 modulo its length is taken out first.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    hurt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, hurt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words with the numbers of their nodes; those of the first word's path follow its partition's own number."""
    base = (TaskContext.get().partitionId() << BITS) + 1
    used, before, path = 0, "", []
    for batch in batches:
        paths = []
        for word in batch.column(0).to_pylist():
            shared = len(os.path.commonprefix((before, word)))
            path = path[:shared] + list(range(base + used, base + used + len(word) - shared))
            used += len(word) - shared
            before = word
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int64()))], [*batch.schema.names, "path"])


def _shared_paths(ends: list) -> list[tuple[int, list[int]]]:
    """For each partition, in order, the numbers that the first nodes of its first word's path have in those before it."""
    out, last, known = [], "", []
    for r in ends:
        shared = len(os.path.commonprefix((last, r.first["word"])))
        alias = known[:shared]
        out.append((r.part, alias))
        own = min(shared, len(os.path.commonprefix((r.first["word"], r.last["word"]))))
        last, known = r.last["word"], alias[:own] + list(r.last["path"])[own:]
    return out


def trie_paths(words: DataFrame) -> DataFrame:
    """words (word, ...) in order, with place, a number that grows with the word, and path, the numbers of the nodes at lengths 1, 2, ...

    Words must be distinct. The driver sees the first and last word of each partition.
    """
    spark = words.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.repartitionByRange(partitions, "word").sortWithinPartitions("word")
    ordered = ordered.select(*words.columns, F.monotonically_increasing_id().alias("place"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", path array<long>"
    numbered = written(ordered.mapInArrow(_numbered, schema), "trie")
    part = F.shiftright("place", BITS)
    row = F.struct("word", "path")
    ends = numbered.groupBy(part.alias("part")).agg(F.min(row).alias("first"), F.max(row).alias("last")).orderBy("part").collect()
    shared = spark.createDataFrame(_shared_paths(ends), "part long, alias array<long>")
    both = numbered.join(F.broadcast(shared), part == shared.part)
    own = F.shiftleft(part, BITS) + 1
    path = F.transform("path", lambda x, i: F.when((x == own + i) & (i < F.size("alias")), F.get("alias", i)).otherwise(x))
    return both.select(*words.columns, "place", path.alias("path"))


def _places(letters: Column, before: Column, behind: Column) -> Column:
    """Each place of a word as (p, s, kind): 0 has nothing there, 1 and 2 a code point that is skipped, 2 if it repeats the one before."""
    n = F.size(letters)
    p = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(before, i - 1))
    s = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(behind, k - 1))
    repeats = lambda i: (i > 0) & (F.get(letters, i) == F.get(letters, i - 1))
    with_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(p(i).alias("p"), s(n - 1 - i).alias("s"), F.when(repeats(i), 2).otherwise(1).alias("kind")))
    without = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(p(i).alias("p"), s(n - i).alias("s"), F.lit(0).alias("kind")))
    return F.concat(with_, without)


def neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (word, n) with their place, and for each place with near words how many and the best (n, -place) of them."""
    forward = written(trie_paths(words), "forward")
    turned = forward.select(F.reverse("word").alias("word"), F.col("place").alias("of"))
    backward = trie_paths(turned).select(F.col("of").alias("place"), F.col("path").alias("behind"))
    both = forward.join(backward, "place")
    both = both.select("place", "n", "path", "behind", F.split("word", "").alias("letters"))
    both = both.select("place", "n", _places(F.col("letters"), F.col("path"), F.col("behind")).alias("at"))
    groups = _groups(both.select("place", "n", F.explode("at").alias("at")))
    found = groups.groupBy("place").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))
    return forward.select("word", "n", "place"), found


def _groups(at: DataFrame) -> DataFrame:
    """One row (place, near, best) for each member of a pair of nodes that others share with it."""
    word = F.struct("n", (-F.col("place")).alias("back"))
    g = at.select("at.p", "at.s", "at.kind", word.alias("w")).groupBy("p", "s").agg(F.collect_list(F.struct("w", "kind")).alias("g")).where(F.size("g") > 1)
    g = g.select(F.reverse(F.array_sort("g")).alias("g"))  # the most frequent first
    near = lambda x, y: (y["w"] != x["w"]) & (((x["kind"] > 0) & (y["kind"] > 0)) | ((x["kind"] == 0) & (y["kind"] == 1)) | ((x["kind"] == 1) & (y["kind"] == 0)))
    rows = g.select(F.explode(F.transform("g", lambda x: F.struct((-x["w"]["back"]).alias("place"), F.filter("g", lambda y: near(x, y)).alias("others")))).alias("r"))
    return rows.select("r.place", F.size("r.others").alias("near"), F.get("r.others", F.lit(0))["w"].alias("best")).where("near > 0")


def group_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, damage: int = 199, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    form: the near word of largest n if that is at least `times` the word's own;
    root: where forms lead to. Counts grow with each form, so a chain is as long
    as a logarithm of the largest count; its ends are found by doubling.
    """
    small_batches(docs.sparkSession)
    words = written(word_counts(docs, least_length, least_n, damage), "words")
    named, near = neighbours(words)
    named = written(named.join(near, "place", "left"), "named")
    form = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.back"))
    named = named.select("word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_place"))
    roots = written(named.where("form_place is not null").select("place", F.col("form_place").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("place").alias("root"), F.col("root").alias("further"))
        stepped = written(roots.join(onward, "root", "left").select("place", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = stepped.drop("moved")
        roots._staged_at = stepped._staged_at
        if stepped.where("moved").isEmpty():
            break
    text = named.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    forms = named.select(F.col("place").alias("form_place"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    led = roots.join(text, "root").select("place", "root_word")
    out = named.join(forms, "form_place", "left").join(led, "place", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
