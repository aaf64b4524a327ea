"""The fixed-size filter, token counts with a warm cache, and revisits on odd rows and at random."""

import random

from pyspark.sql import functions as F

from apexlap.llm import counts, tokens, warc
from apexlap.llm.storage import among


def test_a_filter_loses_no_key(spark):
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("k"))
    rows, key = spark.range(60_000), F.xxhash64("id")
    got = among(rows, key, keys)
    assert got.columns == ["id"] and got.where("id % 3 = 0").count() == 20_000 and got.where("id % 3 != 0").count() < 400
    marked = among(rows, key, keys, "maybe")
    assert marked.count() == 60_000 and marked.where("maybe").count() == got.count()
    assert among(rows, key, keys.limit(0)).count() == 0 and among(rows.limit(0), key, keys).count() == 0


def test_a_warm_cache_with_one_miss(spark, tmp_path):
    path, cache = tokens.tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    rows = [(i, f"some words number {i}") for i in range(300)]
    schema = "doc_id long, text string, digest string, n_tokens int"
    frame = lambda r: spark.createDataFrame([(*x, "d", 1) for x in r], schema).repartition(3)
    counts.count_tokens(frame(rows), path, cache).count()
    more = [*rows, (300, "a new text"), (301, "a new  text"), (302, None), (None, "a new text")]
    got = {(r.doc_id, r.n_tokens) for r in counts.count_tokens(frame(more), path, cache).collect()}
    assert got == {(i, len(tokens.load(path).encode(x or "", add_special_tokens=False).ids)) for i, x in more}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == 302


SCHEMA = "record_id long, url string, time long, kind string, headers map<string,string>, range string, near string, status string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)


def model(rows):
    """Each record after the records before it, one at a time."""
    out, last = [], {}
    order = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[3] != "response", r[0]))
    for i, url, _, kind, headers in order:
        own = {k: v for k, v in (headers or {}).items() if v is not None}
        if kind == "response":
            out.append((i, "response", None, own))
            last[url] = (i, own)
            continue
        if url not in last:
            out.append((i, "no_response", None, own))
            continue
        source, theirs = last[url]
        tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        if "etag" in own:
            fits = tag(own) == tag(theirs)
        elif "last-modified" in own:
            fits = own["last-modified"] == theirs.get("last-modified")
        else:
            fits = True
        merged = {**theirs, **{k: v for k, v in own.items() if k in warc.PERMITTED}} if fits else own
        out.append((i, "resolved" if fits else "mismatch", source, merged))
    for i, url, time, kind, headers in rows:
        if url is None or time is None:
            out.append((i, "response" if kind == "response" else "no_response", None, {k: v for k, v in (headers or {}).items() if v is not None}))
    return sorted(out)


def found(spark, rows):
    return sorted((r.record_id, r.status, r.source_id, dict(r.headers)) for r in warc.resolve_revisits(frame(spark, rows)).collect())


def test_revisits_at_random(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        headers = {k: rng.choice(["x", "y", "W/x", None]) for k in rng.sample(["etag", "last-modified", "date", "content-length", "age"], rng.randint(0, 4))}
        rows.append((i, rng.choice(["a.org/hot"] * 5 + ["b.org/1", "c.org/2", None]), rng.choice([None, *range(40)]), rng.choice(["response", "revisit", "revisit"]), rng.choice([headers, headers, None])))
    rows.append((800, "long.org/" + "p" * 40_000, 1, "response", {"etag": "z"}))
    rows.append((801, "long.org/" + "p" * 40_000, 2, "revisit", {"etag": "z"}))
    assert found(spark, rows) == model(rows)


def test_revisits_on_odd_rows(spark):
    assert warc.resolve_revisits(frame(spark, [])).count() == 0
    rows = [(1, "a.org", 1, "response", {"etag": "t"}), (1, "a.org", 1, "response", {"etag": "t"}), (2, "a.org", 5, "revisit", {"etag": None, "date": "d"}), (2, "a.org", 5, "revisit", {"etag": None, "date": "d"}), (3, "a.org", 6, None, {"etag": "t"}), (4, "", 7, "revisit", {})]
    got = found(spark, rows)
    # a null value is no header; a record without kind is neither a response nor resolved to one
    assert [x for x in got if x[0] == 2] == [(2, "resolved", 1, {"etag": "t", "date": "d"})] * 2
    assert [x[1] for x in got if x[0] in (1, 3, 4)] == ["response", "response", "unknown", "no_response"]
