"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    out = identify_languages(_table(spark, sf_dir, "documents"), F.coalesce(_crc() % 4 != 2, F.lit(False)))
    return out.select("doc_id", (_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import tokenizer_path

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False).drop("ids")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a response, and a later not-modified revisit of every page.

    The revisit asks for another spelling of the URL. By page_id its validators
    are an entity tag, a weak tag, a date, a stale tag or none.
    """
    p = _table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("digest"))
    day = F.format_string("day %d", F.pmod("page_id", F.lit(400)))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    response = p.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("time"), F.lit("response").alias("kind"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.format_string("t%d", "page_id"), F.lit("etag"), tag, F.lit("last-modified"), day).alias("headers"))
    case = F.pmod("page_id", F.lit(5))
    time = F.col("page_id") + 1 + F.pmod(F.col("page_id") * 7919, F.lit(5000))
    date = [F.lit("date"), F.format_string("t%d", time), F.lit("content-length"), F.lit("0")]
    headers = F.when(case == 0, F.create_map(*date, F.lit("etag"), tag)).when(case == 1, F.create_map(*date, F.lit("etag"), F.concat(F.lit("W/"), tag))).when(case == 2, F.create_map(*date, F.lit("last-modified"), day)).when(case == 3, F.create_map(*date, F.lit("etag"), F.lit('"stale"'))).otherwise(F.create_map(*date))
    revisit = p.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), time.alias("time"), F.lit("revisit").alias("kind"), headers.alias("headers"))
    return response.unionByName(revisit)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import resolve_revisits

    out = resolve_revisits(_records(spark, sf_dir))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "kind", "canonical", "status", "source_id", line.alias("headers"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _crc() % 5 != 0)
    return out.select("doc_id", (_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import remove_repeated_passages

    return remove_repeated_passages(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeated_bytes

    return remove_repeated_bytes(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wumanber import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import count_tokens
    from .tokens import tokenizer_path

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents
    from .tokens import tokenizer_path

    out = encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group_variants

    return group_variants(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample

    out = importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    found = (op1_language_id, op2_packing, op3_revisits, op4_toxicity, op5_near_dedup, op6_substrings, op7_exact_dedup, op8_suffix_array, op9_decontamination, op10_token_counts, op11_sentencepiece, op12_spelling_variants, op13_resampling)
    return {f.__name__: f for f in found}


OP3_SQL = r"""
with pages_ as (select page_id, url, substr(md5(html), 1, 16) as tag from pages),
recs as (
  select page_id * 2 as record_id, url, page_id as time, 'response' as kind, page_id, tag from pages_
  union all
  select page_id * 2 + 1, url || '#again', page_id + 1 + (page_id * 7919) % 5000, 'revisit', page_id, tag from pages_),
c1 as (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') as u from recs),
c2 as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')) || regexp_extract(u, '^[^/?]*(.*)$', 1), '^www\.', ''), '^([^/?]*):(80|443)([/?]|$)', '\1\3') as v from c1),
c3 as (select *, regexp_replace(regexp_replace(v, '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&+', '&', 'g') as w from c2),
r as (select *, regexp_replace(regexp_replace(regexp_replace(w, '\?&', '?', 'g'), '[?&]+$', ''), '/$', '') as canonical from c3),
j as (
  select r.*, last_value(case when kind = 'response' then record_id end ignore nulls) over w as source,
    last_value(case when kind = 'response' then page_id end ignore nulls) over w as source_page,
    last_value(case when kind = 'response' then tag end ignore nulls) over w as source_tag
  from r window w as (partition by canonical order by time, case when kind = 'response' then 0 else 1 end, record_id rows between unbounded preceding and 1 preceding)),
s as (
  select *, case when kind = 'response' then 'response' when source is null then 'no_response'
    when page_id % 5 in (0, 1) then case when tag = source_tag then 'resolved' else 'mismatch' end
    when page_id % 5 = 2 then case when page_id % 400 = source_page % 400 then 'resolved' else 'mismatch' end
    when page_id % 5 = 3 then 'mismatch' else 'resolved' end as status from j)
select record_id, kind, canonical, status, case when kind = 'revisit' then source end as source_id,
  case when kind = 'response' then 'content-type=text/html;date=t' || page_id || ';etag="' || tag || '";last-modified=day ' || (page_id % 400)
    when status = 'resolved' then 'content-type=text/html;date=t' || time || ';etag=' || case when page_id % 5 = 1 then 'W/' else '' end || '"' || case when page_id % 5 in (0, 1) then tag else source_tag end || '";last-modified=day ' || case when page_id % 5 = 2 then page_id % 400 else source_page % 400 end
    else 'content-length=0;date=t' || time || case when page_id % 5 = 0 then ';etag="' || tag || '"' when page_id % 5 = 1 then ';etag=W/"' || tag || '"' when page_id % 5 = 2 then ';last-modified=day ' || (page_id % 400) when page_id % 5 = 3 then ';etag="stale"' else '' end end as headers
from s
"""

OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) end) as gs from w),
n as (select doc_id, len(gs) as n from g),
e as (select doc_id, unnest(gs) as s from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
both_ as (select a, b from l union all select b, a from l),
reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, b.b from reach r join both_ b on b.a = r.other),
c as (select doc_id, min(other) as component_id from reach group by 1)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c on c.doc_id = n.doc_id
"""

OP6_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, len(ws) as n, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
d as (select doc_id, unnest(range(1, greatest(len(ws) - 48, 1))) as i, unnest(list_transform(range(1, greatest(len(ws) - 48, 1)), lambda i: md5(array_to_string(list_slice(ws, i, i + 49), ' ')))) as h from w),
f as (select h, min(doc_id) as first_doc from d group by 1),
b as (select d.doc_id, d.i from d join f on f.h = d.h where f.first_doc < d.doc_id),
m as (select p.doc_id, p.i, p.word, max(b.i) over (partition by p.doc_id order by p.i rows between 49 preceding and current row) is not null as cut
  from p left join b on b.doc_id = p.doc_id and b.i = p.i),
k as (select doc_id, count(*) filter (cut) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (not cut), '')) as kept_sha256 from m group by 1)
select w.doc_id, len(ws) as n_words, coalesce(k.n_removed, 0) as n_removed, coalesce(k.kept_sha256, sha256('')) as kept_sha256 from w left join k on k.doc_id = w.doc_id
"""

OP7_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents)
select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  doc_id = min(doc_id) over (partition by x) as kept, sha256(x) as text_sha256 from t
"""

OP8_SQL = r"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, unnest(range(1, greatest(len(x) // 2 - 98, 1))) as i, unnest(list_transform(range(1, greatest(len(x) // 2 - 98, 1)), lambda i: md5(substr(x, 2 * i - 1, 200)))) as k from h),
b as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as nth from w) where nth > 1),
p as (select doc_id, unnest(range(1, len(x) // 2 + 1)) as i, unnest(list_transform(range(1, len(x) // 2 + 1), lambda i: substr(x, 2 * i - 1, 2))) as byte from h),
m as (select p.doc_id, p.i, p.byte, max(b.i) over (partition by p.doc_id order by p.i rows between 99 preceding and current row) is not null as cut
  from p left join b on b.doc_id = p.doc_id and b.i = p.i),
n as (select *, cut and not coalesce(lag(cut) over (partition by doc_id order by i), false) as begins from m),
k as (select doc_id, count(*) filter (cut) as n_removed, count(*) filter (begins) as n_spans, sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (not cut), ''))) as kept_sha256 from n group by 1)
select h.doc_id, len(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256 from h left join k on k.doc_id = h.doc_id
"""

OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
i as (select item_id, least(10, len(ws)) as m, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda j: array_to_string(list_slice(ws, j, j + least(10, len(ws)) - 1), ' '))) as x from b where len(ws) > 0),
m as (select distinct m from i),
d as (select doc_id, m.m, unnest(range(1, greatest(len(ws) - m.m + 2, 1))) as j, unnest(list_transform(range(1, greatest(len(ws) - m.m + 2, 1)), lambda j: array_to_string(list_slice(ws, j, j + m.m - 1), ' '))) as x from w, m),
h as (select d.doc_id, d.m, d.j, i.item_id from d join i on i.m = d.m and i.x = d.x),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(j, j + m)) as q from h) group by 1),
n as (select doc_id, count(*) as n_items, sha256(string_agg(x, ',' order by x)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as x from h) group by 1)
select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c on c.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
"""


def _crc_sql(value: str) -> str:
    """The CRC-32 of a text column's UTF-8 bytes, byte by byte over the column t of `crc_table`."""
    x = f"hex(encode({value}))"
    byte = f"list_transform(range(1, len({x}) // 2 + 1), lambda i: ('0x' || substr({x}, 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


CRC_TABLE = """crc_table as (select list(r order by k) as t from (
  select k, list_reduce(list_prepend(k, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) as r from (select unnest(range(256)) as k)))"""

OP12_SQL = rf"""
with recursive {CRC_TABLE},
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
u as (select doc_id, run, count(*) as c from r where length(run) >= 6 group by 1, 2),
h as (select *, {_crc_sql("doc_id || ':' || run")} as h from u, crc_table),
d as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
w as (select word, sum(c)::bigint as n from d where length(word) >= 6 group by 1 having sum(c) >= 5),
i as (select word, n, unnest(range(0, length(word) + 1)) as i from w),
k as (select word, n, i, substr(word, 1, i) as p, substr(word, i + 2) as s, substr(word, i + 1) as whole from i),
near as (
  select a.word as a, a.n as an, b.word as b, b.n as bn from k a join k b on a.p = b.p and a.s = b.s and a.i < length(a.word) and b.i < length(b.word) and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from k a join k b on a.i < length(a.word) and a.p = b.p and a.s = b.whole
  union
  select b.word, b.n, a.word, a.n from k a join k b on a.i < length(a.word) and a.p = b.p and a.s = b.whole),
t as (select a as word, count(*) as n_near, arg_max(b, (bn, -row)) as form, max(bn) as form_n, any_value(an) as n from (select *, row_number() over (order by b collate "binary") as row from near) group by 1),
f as (select word, form, form_n from t where form_n >= 5 * n),
chain(word, reached) as (select word, word from w union all select c.word, f.form from chain c join f on f.word = c.reached),
ends as (select c.word, c.reached as root from chain c where c.reached not in (select word from f))
select w.word, f.form, e.root, w.n, coalesce(t.n_near, 0)::bigint as n_near, f.form_n from w left join t on t.word = w.word left join f on f.word = w.word join ends e on e.word = w.word
"""

OP13_SQL = rf"""
with {CRC_TABLE},
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
e as (select doc_id, unnest(ws) as word from w),
ek as (select doc_id, word, count(*) as c from e group by 1, 2),
words as (select distinct word from (select word from ek union all select word from b)),
k as (select word, {_crc_sql("word")} % 10000 as bucket from words, crc_table),
s as (select bucket, sum(c) as n from ek join k on k.word = ek.word group by 1),
t as (select bucket, count(*) as n from b join k on k.word = b.word group by 1),
totals as (select (select coalesce(sum(n), 0) from s)::double as sn, (select coalesce(sum(n), 0) from t)::double as tn),
g as (select q.bucket, floor(1000.0::double * ln((coalesce(t.n, 0) + 1.0::double) * (sn + 10000.0::double) / ((coalesce(s.n, 0) + 1.0::double) * (tn + 10000.0::double))))::bigint as gain
  from (select unnest(range(10000)) as bucket) q left join s on s.bucket = q.bucket left join t on t.bucket = q.bucket, totals),
f as (select doc_id, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from ek join k on k.word = ek.word join g on g.bucket = k.bucket group by 1),
h as (select w.doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::bigint as h from w left join f on f.doc_id = w.doc_id),
z as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from h),
o as (select doc_id, row_number() over (order by score desc, doc_id) as r from z where n_words >= 20),
n as (select count(*) * 10 // 100 as drawn from o)
select z.doc_id, n_features, weight, score, case when r <= drawn then r end as rank from z left join o on o.doc_id = z.doc_id, n
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_revisits": OP3_SQL, "op5_near_dedup": OP5_SQL, "op6_substrings": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_suffix_array": OP8_SQL, "op9_decontamination": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_resampling": OP13_SQL}
