"""The registered query of each operator, with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if check:
            CHECKS[name] = check
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = r"""
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
known as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
          from labels where doc_id is not null and (quality is not null or toxic is not null) group by 1),
hosts as (select host, count(bad) as n, coalesce(sum(bad), 0)::double as bad, string_split(host, '.') as ls
          from parts left join known using (page_id) group by host),
named as (select *, case when array_to_string(ls[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in')
                         then 2 else 1 end as k from hosts),
units as (select host, n, bad, array_to_string(ls[-k:], '.') as suffix, array_to_string(ls[-(k + 1):], '.') as domain from named),
root as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as m from units),
s1 as (select suffix, sum(n) as n, sum(bad) as bad, least(greatest(any_value(m), 0.001), 0.999) as m from units, root group by suffix),
f1 as (select 1.0 / least(greatest(coalesce((sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.5) - 1.0 as s from s1),
p1 as (select suffix, (m * s + bad) / (s + n) as mean from s1, f1),
s2 as (select suffix, domain, sum(units.n) as n, sum(units.bad) as bad, least(greatest(any_value(mean), 0.001), 0.999) as m from units join p1 using (suffix) group by all),
f2 as (select 1.0 / least(greatest(coalesce((sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.5) - 1.0 as s from s2),
p2 as (select domain, (m * s + bad) / (s + n) as mean from s2, f2),
s3 as (select host, n, bad, least(greatest(mean, 0.001), 0.999) as m from units join p2 using (domain)),
f3 as (select 1.0 / least(greatest(coalesce((sum((bad - n * m) * (bad - n * m) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.5) - 1.0 as s from s3),
p3 as (select host, (m * s + bad) / (s + n) as mean, s + n as total from s3, f3),
bound as (select host, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) as low from p3 where (select sum(n) from units) > 0),
rules(rh, rp, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit as (select page_id, host, path, max_by(rh || rp, length(rh || rp)) as rule, max_by(v, length(rh || rp)) as v
        from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select parts.page_id, parts.host, parts.path, rule, coalesce(v, case when low > 0.30 then 'block' else 'allow' end) as verdict
from parts left join fit on parts.page_id is not distinct from fit.page_id and parts.host = fit.host and parts.path = fit.path
left join bound on parts.host = bound.host
"""


@query("op2_url_reputation", URL_SQL)
def url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page outcome is the label row with the page's id: bad if of low quality or toxic."""
    from .url_reputation import judge_urls

    known = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), known.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
l as (select rid, unnest(string_split(t, chr(10))) as line from d),
nl as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
g as (select rid, i, array_to_string(ws[i:i + 4], ' ') as win from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select rid, i from g qualify count(*) over (partition by rid, win) > 1),
cov as (select rid, count(distinct p) as n_rep from (select rid, unnest(range(i, i + 5)) as p from rep) group by rid),
m as (select rid, doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as lettered
      from w),
a as (select m.*, coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_rep, 0)::bigint as n_repeat_words
      from m left join nl using (rid) left join cov using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (n_symbols / greatest(n_words, 1) > 0.1 or n_dup_lines / greatest(n_lines, 1) > 0.5
         or word_chars / greatest(n_words, 1) < 2.0 or word_chars / greatest(n_words, 1) > 20.0 or lettered / greatest(n_words, 1) < 0.5) as kept
from b
"""


@query("op6_quality_cascade", QUALITY_SQL)
def quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_bit_planes")
def bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import tokens_of

    return tokens_of(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_language_spans")
def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op5_license_diagonals")
def license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op4_pareto_mix")
def pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
with d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as win
       from (select item_id, ws, least(10, len(ws)) as k, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) as i from b where len(ws) > 0)),
ks as (select distinct k from bw),
dw as (select rid, i, k, array_to_string(ws[i:i + k - 1], ' ') as win
       from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, ks where len(ws) >= k)),
m as (select rid, i, k, item_id from dw join bw using (k, win)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from m) group by rid),
it as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from m) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join it using (rid)
"""


@query("op10_positional_index", DECONTAMINATION_SQL)
def positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near_items")


JACCARD_SQL = r"""
with recursive d as (select row_number() over () as rid, doc_id,
     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct rid, array_to_string(ws[i:i + 4], ' ') as g from (select rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select rid, count(*) as n from s group by rid),
p as (select a.rid as a, b.rid as b, count(*) as c from s a join s b on a.g = b.g and a.rid <> b.rid group by all),
l as (select a, b from p join n x on x.rid = a join n y on y.rid = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select rid as a, rid as b from d union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(doc_id) as component_id from r join d on d.rid = r.b group by a),
k as (select a, count(*) as n_links from l group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from d left join n using (rid) join c on c.a = d.rid left join k on k.a = d.rid
"""


@query("op3_ngram_jaccard", JACCARD_SQL)
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_suffix_repeats")
def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


LINE_SQL = r"""
with l as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents),
d as (select *, list_transform(ls, lambda x: len(regexp_extract_all(x,
        '[^\x20\x09-\x0D\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]+|[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]'))) as ws from l),
w as (select rid, doc_id, k, i, array_to_string(ls[i:i + k - 1], chr(10)) as win
      from (select *, unnest(range(1, len(ls) - k + 2)) as i from d, (values (1), (2), (3)) as ks(k) where len(ls) >= k)
      where list_sum(ws[i:i + k - 1]) >= case when k = 3 then 1 else 50 end),
c as (select rid, k, i from w qualify row_number() over (partition by k, win order by doc_id nulls last, rid, i) > 1),
g as (select distinct rid, unnest(range(i, i + k)) as p from c),
n as (select rid, count(*) as n_deleted, count(*) filter (b is null or b <> p - 1) as n_runs, list(p) as gone
      from (select rid, p, lag(p) over (partition by rid order by p) as b from g) group by rid)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(n_deleted, 0)::bigint as n_deleted, coalesce(n_runs, 0)::bigint as n_runs,
       md5(case when gone is null then text else coalesce(array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i)), chr(10)), '') end) as kept_md5
from d left join n using (rid)
"""


@query("op8_line_runs", LINE_SQL)
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, and of one or two with 50 words."""
    from .line_dedup import clean_lines

    found = clean_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "n_runs", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


MERKLE_SQL = r"""
with recursive d as (
  select row_number() over () as rid, doc_id, source, lang, n_chars, text,
         case when doc_id is not null and xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))), 4294967295) % 3 = 0
         then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as claimed from documents),
e as (select rid, doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
             coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(claimed) || ':' || claimed, '-') as other from d),
l as (select rid, doc_id, lang, sha256(head || body) as leaf, sha256(head || other) as claim from e),
p as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 as place from l),
tree as (
  select 0 as lvl, g, place, leaf as digest from p
  union all
  select lvl + 1, g, place // 8, sha256(string_agg(digest, '' order by place)) from (select *, count(*) over (partition by g) as n from tree) where n > 1 group by lvl, g, place // 8),
sub as (select g, max(lvl) as h from tree group by g),
subroot as (select g, digest as subroot, h from tree join sub using (g) where lvl = h),
top as (
  select 0 as lvl, g as place, subroot as digest from subroot
  union all
  select lvl + 1, place // 8, sha256(string_agg(digest, '' order by place)) from (select *, count(*) over () as n from top) where n > 1 group by lvl, place // 8),
root as (select max(lvl) as h, max_by(digest, lvl) as root from top),
steps as (
  select rid, t.lvl as step, coalesce(string_agg(n.digest, '' order by n.place) filter (n.place < p.place // (8 ** t.lvl)::bigint), '') as before,
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place > p.place // (8 ** t.lvl)::bigint), '') as after
  from p join subroot using (g) join (select distinct lvl from tree) t on t.lvl < h
  join tree n on n.g = p.g and n.lvl = t.lvl and n.place // 8 = p.place // (8 ** (t.lvl + 1))::bigint group by rid, t.lvl
  union all
  select rid, subroot.h + t.lvl, coalesce(string_agg(n.digest, '' order by n.place) filter (n.place < p.g // (8 ** t.lvl)::bigint), ''),
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place > p.g // (8 ** t.lvl)::bigint), '')
  from p join subroot using (g) join root on true join (select distinct lvl from top) t on t.lvl < root.h
  join top n on n.lvl = t.lvl and n.place // 8 = p.g // (8 ** (t.lvl + 1))::bigint group by rid, subroot.h, t.lvl),
folds as (
  select rid, 0 as step, claim as digest from p
  union all
  select rid, step + 1, sha256(before || digest || after) from folds join steps using (rid, step)),
ends as (select rid, max_by(digest, step) as folded_root from folds group by rid),
proofs as (select rid, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from steps group by rid)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from p join subroot using (g) join ends using (rid) join root on true left join proofs using (rid)
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; a third of the claims is about a lower-cased text."""
    from . import merkle

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = {c: F.col(c) for c in merkle.COLUMNS} | {"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    manifest = merkle.build_manifest(table(spark, sf_dir, "documents"), carry={"claim": merkle.leaf_digest(claimed)})
    return merkle.verify(manifest, manifest.leaves).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).alias("root"), merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified"
    )


SEARCH_SQL = r"""
with d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select row_number() over () as bid, item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
s as (select count(*)::bigint as nd, sum(len(ws))::bigint as l from d where len(ws) > 0),
q as (select distinct bid, unnest(ws) as t from b),
f as (select rid, t, count(*)::bigint as tf from (select rid, unnest(ws) as t from d) where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by t),
i as (select rid, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * nd) // l))) as v from f join w using (t) join d using (rid), s),
r as (select bid, rid, sum(v)::bigint as score from q join i using (t) group by all having sum(v) > 0),
k as (select bid, doc_id, score, row_number() over (partition by bid order by score desc, doc_id nulls last, rid) as rank from r join d using (rid))
select item_id, rank::integer as rank, doc_id, score from k join b using (bid) where rank <= 50
"""


@query("op12_treap_search", SEARCH_SQL)
def treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_quality_mil")
def quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import classify

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
