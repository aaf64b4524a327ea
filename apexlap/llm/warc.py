"""Not-modified revisits of a web archive, resolved to the responses they stand for.

A revisit record stores no content: the server said 304. It stands for the
latest earlier full response of the same canonical URL, if its validators agree
with that response's: the entity tag where the revisit has one (weak tags
compare by their opaque part), else the modification date. A resolved revisit
has the response's headers, updated by those headers that a 304 may change.

The as-of join neither pairs records nor puts a URL into one task: records are
dealt out by ranges of (URL, time), so that a busy URL spans as many ranges as
its records fill. A window finds the latest response within a range, and what
earlier ranges of the URL leave behind is carried over, one row for each URL and
range.

At equal times a response comes before a revisit, then the smaller record_id.
Records without URL or time pass by all of this and are kept, unresolved, as are
those without a kind, whose status is 'unknown'. Null headers count as none, and
a header without a value as absent. A revisit without validators is resolved to the latest
response unchecked, as nothing contradicts it. Repeated rows give repeated
results; an empty table gives an empty one. Extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Headers of a 304 that update a stored response.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]


def canonical_url(url: Column) -> Column:
    """Host without case, `www.` and default port; no scheme, fragment, utm_ parameters or final slash."""
    c = F.regexp_replace(url, "#.*$", "")
    c = F.regexp_replace(c, "^[A-Za-z]+://", "")
    c = F.concat(F.lower(F.regexp_extract(c, "^[^/?]*", 0)), F.regexp_extract(c, "^[^/?]*(.*)$", 1))
    c = F.regexp_replace(c, "^www\\.", "")
    c = F.regexp_replace(c, "^([^/?]*):(80|443)([/?]|$)", "$1$3")
    c = F.regexp_replace(c, "([?&])utm_[a-z]+=[^&]*", "$1")
    c = F.regexp_replace(c, "&+", "&")
    c = F.regexp_replace(F.regexp_replace(c, "\\?&", "?"), "[?&]+$", "")
    return F.regexp_replace(c, "/$", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, kind, canonical, status, source_id, headers of each record.

    records: record_id long, url string, time (a number or a timestamp), kind
    'response' or 'revisit', headers map<string,string> with lower-case names.
    status: 'response', 'resolved', 'mismatch', 'no_response' or 'unknown';
    source_id is the response that was found.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "time", "kind", F.map_filter(F.coalesce("headers", empty), lambda _, v: v.isNotNull()).alias("headers"))
    r = r.withColumn("later", (F.col("kind") != "response").cast("int"))
    placed = F.col("canonical").isNotNull() & F.col("time").isNotNull() & F.col("kind").isNotNull()
    order = ["time", "later", "record_id"]
    # the range of each record is stored, so that it can't change when a task is run again
    dealt = written(r.where(placed).repartitionByRange("canonical", *order).withColumn("range", F.spark_partition_id()), "records")
    full = F.when(F.col("kind") == "response", F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers")))
    left = dealt.groupBy("canonical", "range").agg(F.max_by(full, F.when(full.isNotNull(), F.struct(*order))).alias("last"))
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("canonical", "range", F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    inside = Window.partitionBy("canonical", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(full, ignorenulls=True).over(inside)).join(carried, ["canonical", "range"], "left")
    found = near.withColumn("found", F.coalesce("near", "carried"))
    unplaced = r.where(~placed).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    columns = ["record_id", "kind", "canonical", "headers", "found"]
    found = found.select(columns).unionByName(unplaced.select(columns))
    etag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    own, theirs = F.col("headers"), F.col("found.headers")
    agrees = F.when(own["etag"].isNotNull(), etag(own) == etag(theirs)).when(own["last-modified"].isNotNull(), own["last-modified"] == theirs["last-modified"]).otherwise(F.lit(True))
    status = F.when(F.col("kind").isNull(), "unknown").when(F.col("kind") == "response", "response").when(F.col("found").isNull(), "no_response").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    found = found.withColumn("status", status)
    allowed = F.map_filter(own, lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter(theirs, lambda k, _: ~F.map_contains_key(allowed, k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(kept, allowed)).otherwise(own)
    return found.select("record_id", "kind", "canonical", "status", F.when(F.col("kind") == "revisit", F.col("found.id")).alias("source_id"), merged.alias("headers"))
