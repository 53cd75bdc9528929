"""Registered queries of this subpackage: each applies one operator to its whole table; SQL where it can say the same."""
import public_tokenizers
from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


# links l(a, b) in both directions to the smallest reachable key
CLOSURE = """r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a as {KEY}, least(a, min(b)) as lo from r group by a)"""


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    from floetrack.llm import bytebpe
    return bytebpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_warc", r"""
with p as (select page_id, url, encode(coalesce(html, '')) as body from pages),
d as (select page_id, url, octet_length(body) as payload_bytes, sha256(body) as h, sha1(body) as x from p),
b as (select *, max(page_id) over (partition by h) as top from d),
k as (select *, page_id is distinct from top as again from b),
t as (select *, 'WARC/1.1..WARC-Type: ' || case when again then 'revisit' else 'response' end || '..WARC-Record-ID: <urn:uuid:' || repeat('x', 36) || '>..WARC-Date: 2024-01-01T00:00:00Z..'
  || coalesce('WARC-Target-URI: ' || url || '..', '') || coalesce('X-Page-ID: ' || page_id || '..', '') || 'WARC-Payload-Digest: sha1:' || repeat('x', 32) || '..'
  || case when again then 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest..WARC-Refers-To: <urn:uuid:' || repeat('x', 36) || '>..X-Refers-To-Page-ID: ' || top || '..' else '' end
  || 'Content-Type: text/html..Content-Length: ' || case when again then 0 else payload_bytes end || '......' as head from k)
select page_id, payload_bytes, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as int), 1), '' order by i) from range(32) t(i)) as payload_digest,
 case when again then 'revisit' else 'response' end as record_type,
 case when again then top end as refers_to, octet_length(encode(head)) + 2 + case when again then 0 else payload_bytes end as record_bytes
from t""")
def op1(spark, sf_dir):
    from floetrack.llm import warc
    return warc.listing(spark, warc.write_archive(_table(spark, sf_dir, "pages")))


@query("op10_exact_dedup", r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents),
g as (select n, count(*) as group_size, arg_min(doc_id, struct_pack(a := -length(t), b := doc_id)) as keep_id from d group by n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from d join g using (n)""")
def op10(spark, sf_dir):
    from floetrack.llm import exact
    return exact.dedup(_table(spark, sf_dir, "documents")).drop("locator")


@query("op2_packing")
def op2(spark, sf_dir):
    from floetrack.llm import packing
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_language_id")
def op9(spark, sf_dir):
    from floetrack.llm import centroid
    return centroid.identify(_table(spark, sf_dir, "documents")).drop("distant")


@query("op3_katz_lm")
def op3(spark, sf_dir):
    from floetrack.llm import katz
    return katz.score_held_out(_table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    from floetrack.llm import crf
    return crf.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "spans")


@query("op5_suffix_dedup", """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as m from d, unnest(range(0, greatest(0, length(h) // 2 - 399))) t(i)),
st as (select doc_id, i, case when i <= lag(i) over o + 400 then 0 else 1 end as fresh from w where m in (select m from w group by m having count(*) > 1) window o as (partition by doc_id order by i)),
n as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from st),
s as (select doc_id, k, min(i) as a, max(i) + 400 as z from n group by 1, 2),
p as (select doc_id, coalesce(lag(z) over (partition by doc_id order by k), 0) as a, a as z from s union all select doc_id, coalesce(max(z), 0), max(length(h)) // 2 from d left join s using (doc_id) group by 1),
t as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) as h from p join d using (doc_id) group by 1)
select d.doc_id, length(d.h) // 2 as n_bytes, (length(d.h) - length(t.h)) // 2 as n_removed, (select count(*) from s where s.doc_id = d.doc_id) as n_spans,
  sha256(unhex(t.h)) as kept_sha256 from d join t using (doc_id)""")
def op5(spark, sf_dir):
    from floetrack.llm import pfp
    return pfp.cut_repeats(_table(spark, sf_dir, "documents")).drop("spans")


@query("op8_ngram_jaccard", rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) < 4 then list_filter([array_to_string(w, ' ')], lambda x: len(w) > 0) else list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, a.n + b.n as n, count(*) as k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2, 3),
l as (select a, b from p where 100 * k >= 85 * (n - k)),
{CLOSURE}
select s.doc_id, len(s.s) as n_shingles, coalesce(lo, s.doc_id) as component_id from s left join c using (doc_id)""".replace("{KEY}", "doc_id"))
def op8(spark, sf_dir):
    from floetrack.llm import jaccard
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op6_vector_forest", f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
{CLOSURE}
select vec_id, coalesce(n, 0) as n_links, coalesce(lo, vec_id) as component_id, coalesce(lo, vec_id) = vec_id as kept
from v left join (select a as vec_id, count(*) as n from l group by 1) using (vec_id) left join c using (vec_id)""".replace("{KEY}", "vec_id"))
def op6(spark, sf_dir):
    from floetrack.llm import forest
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


@query("op12_mixing", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as mark from documents),
s as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from d group by source),
o as (select *, row_number() over x as k, 1.5::double * sum(source_size) over () - (sum(2 * source_size) over x - 2 * source_size)::double as pool, sum(w) over x as upto, sum(w) over () as all_w from s window x as (order by (2 * source_size)::double / w, source nulls last rows between unbounded preceding and current row)),
l as (select arg_min(pool / (all_w - upto + w), k) as level from o where pool / (all_w - upto + w) * w <= 2 * source_size),
t as (select source, source_size, case when level is null or level * w > 2 * source_size then (2 * source_size)::double else level * w end as target from s, l),
n as (select *, floor(target + 0.5)::bigint as need, case when source_size > 0 then floor(target + 0.5)::bigint // source_size else 0 end as whole from t),
c as (select d.*, sum(size) over (partition by source order by mark, doc_id rows unbounded preceding) - size as before from d)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, need - whole * source_size - before)))::bigint as taken from c join n on c.source is not distinct from n.source""")
def op12(spark, sf_dir):
    from floetrack.llm import mixing
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("repeats", "cut")


@query("op13_divergence", r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select i, lang, source, unnest(w) as t from d),
k as (select lang, t, count(*) as c from o group by 1, 2 having count(distinct i) >= 10),
n as (select lang, source, t, count(*) as c from o semi join k using (lang, t) group by 1, 2, 3),
v as (select lang, count(*) as v, sum(c) as nl from k group by 1),
s as (select lang, source, sum(c) as n from n group by 1, 2),
g as (select lang, source, coalesce(n, 0) + 2 * coalesce(v, 0) as m, coalesce(nl, 0) + 2 * coalesce(v, 0) as ml from (select distinct lang, source from d) left join s using (lang, source) left join v using (lang)),
p as (select lang, source, t, coalesce(n.c, 0) as c, 1 + 1000000000::hugeint * (coalesce(n.c, 0) + 2) // m as p, 1 + 1000000000::hugeint * (k.c + 2) // ml as q from g join k using (lang) left join n using (lang, source, t)),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3),
y as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
 union all select lang, source, 'term', t, (p - q) * (p - q) // (p + q) from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from y)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10""")
def op13(spark, sf_dir):
    from floetrack.llm import divergence
    return divergence.audit(_table(spark, sf_dir, "documents"))


@query("op11_collocations", r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as s from documents),
w as (select lang, regexp_extract_all(s, '[^\x20\x09]+') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by 1),
g as (select lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as x from w, range(1, 5) q(k) where len(w) >= k),
f as materialized (select lang, array_to_string(x, ' ') as s, any_value(x) as x, count(*) as a from g group by 1, 2),
c as materialized (select lang, len(x) as k, s, x, a from f where len(x) >= 2 and a >= 30),
v as materialized (select lang, s, a, unnest([{'j': j, 'l': array_to_string(x[1:j], ' '), 'r': array_to_string(x[j + 1:], ' ')} for j in range(1, k)]) as v from c),
u as (select v.lang, v.s, v.a, v.v.j as j, lf.a as l, rf.a as r, 2000000::hugeint * v.a // (lf.a + rf.a) as score from v join f lf on lf.lang = v.lang and lf.s = v.v.l join f rf on rf.lang = v.lang and rf.s = v.v.r),
b as (select lang, s, a, min({'score': score, 'j': j, 'l': l, 'r': r}) as m from u group by 1, 2, 3),
z as (select lang, a, array_to_string(x[i:i + m - 1], ' ') as s from c, range(2, 4) y(m), range(1, 4) q(i) where m < k and i + m - 1 <= k),
d as (select lang, s, max(a) as longer from z group by 1, 2),
r as (select b.lang, row_number() over (partition by b.lang order by m.score desc, b.a desc, b.s) as rank, b.s as phrase, b.a, m.l, m.r, n, m.score::bigint as score
 from b join t on b.lang = t.lang left join d on d.lang = b.lang and d.s = b.s where longer is null or 100 * longer < 80 * b.a)
select * from r where rank <= 2000""")
def op11(spark, sf_dir):
    from floetrack.llm import collocations
    return collocations.collocations(_table(spark, sf_dir, "documents"))
