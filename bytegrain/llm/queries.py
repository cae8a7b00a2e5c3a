"""The queries of this folder, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, line_dedup, lm, quality, recompress, simhash, url_filter, warc
from .exchange import shared_folder

RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)
#: Hosts that are blocked, with all below them, where no rule speaks.
BLOCKED = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")
TOKENS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES, BLOCKED)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(docs, line_dedup.LineIndex.build(docs, min_docs=10), keep_text=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    records = warc.payloads(table(spark, sf_dir, "pages"))
    warc.write(records, warc.revisits(records), folder)
    return warc.read(spark, folder, blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3, masks=simhash.choices(3, 2))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents"), size=13, keep_text=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(table(spark, sf_dir, "documents"), measures=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENS)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).drop("vocabulary")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op3_line_dedup, op4_warc, op5_simhash, op6_language_id, op7_substring_dedup, op8_quality_rules, op9_byte_bpe, op10_lm_scoring)}

_SPACE = r"[\x20\x09-\x0D]"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_url_filter": rf"""
with p as (select page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
r(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b(h) as (values {", ".join(f"('{h}')" for h in BLOCKED)}),
u as (select distinct host, path from p),
m as (select u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(r.v, length(r.h || r.p)) as v from u, r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) group by all)
select page_id, p.host, p.path, m.rule, coalesce(m.v, case when exists (select 1 from b where p.host = b.h or ends_with(p.host, '.' || b.h)) then 'block' else 'allow' end) as verdict
from p left join m on p.host = m.host and p.path = m.path""",
    "op2_decontamination": rf"""
with dw as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dp as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hit as (select dp.doc_id, dp.n, dp.i, win.item_id from dp join win on dp.s = win.s and dp.n = win.n),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hit) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)""",
    "op3_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from documents),
k as (select doc_id, i, line, {_LOW.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.key)::bigint as n_dropped, sha256(coalesce(string_agg(case when f.key is null then line end, chr(10) order by i), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id""",
    "op7_substring_dedup": rf"""
with w as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, hash(w[i:i + 12]) as h, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
bad as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h, s) as least from win) where doc_id > least),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from bad),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from w)
select w.doc_id, len(any_value(w.w))::bigint as n_words, count(gone.k)::bigint as n_removed, sha256(coalesce(string_agg(case when gone.k is null then word end, ' ' order by words.k), '')) as kept_sha256
from w left join words on w.doc_id = words.doc_id left join gone on words.doc_id = gone.doc_id and words.k = gone.k group by w.doc_id""",
    "op8_quality_rules": rf"""
with w as (select doc_id, coalesce(text, '') as t, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
tri as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
rep as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 3)) as k from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) where c > 1) group by 1),
dup as (select doc_id, sum(c - 1) as n from (select doc_id, l, count(*) as c from (select doc_id, unnest(ls) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by all) group by 1),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
 len(ls) as n_lines, len(list_filter(ls, lambda x: x = '')) as empty_lines, length(regexp_replace(t, '[^a-zA-Z\x{{80}}-\x{{10FFFF}}]', '', 'g')) as letters from w left join dup using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or word_chars < 2 * n_words or word_chars > 14 * n_words or 10 * n_symbols > n_words or 2 * letters < word_chars or 10 * n_dup_lines > 3 * n_lines or 10 * empty_lines > 8 * n_lines) as kept from m""",
    "op4_warc": r"""
with p as (select page_id, coalesce(html, '') as t from pages),
h as (select page_id, octet_length(encode(t))::bigint as payload_bytes, bin(('0x' || substring(sha1(t), 1, 10))::bigint) as b1, bin(('0x' || substring(sha1(t), 11, 10))::bigint) as b2, bin(('0x' || substring(sha1(t), 21, 10))::bigint) as b3, bin(('0x' || substring(sha1(t), 31, 10))::bigint) as b4, t from p),
d as (select page_id, payload_bytes, t, lpad(b1, 40, '0') || lpad(b2, 40, '0') || lpad(b3, 40, '0') || lpad(b4, 40, '0') as bits from h),
e as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (substring(bits, (5 * i + 1)::int, 1)::int * 16 + substring(bits, (5 * i + 2)::int, 1)::int * 8 + substring(bits, (5 * i + 3)::int, 1)::int * 4 + substring(bits, (5 * i + 4)::int, 1)::int * 2 + substring(bits, (5 * i + 5)::int, 1)::int + 1), 1)), '') as payload_digest, max(page_id) over (partition by t) as top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to from e""",
}
