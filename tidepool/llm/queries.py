"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.alignment import align_tokenizers
from tidepool.llm.decontamination import contained_items
from tidepool.llm.hamming import embedding_links
from tidepool.llm.jaccard import jaccard_components
from tidepool.llm.language import identify_languages
from tidepool.llm.licenses import COPYRIGHT_LINE, SPELLINGS, scan_licenses
from tidepool.llm.license_texts import TEXTS
from tidepool.llm.mixing import mix_sources, quality_weights, word_count
from tidepool.llm.phrases import collocations
from tidepool.llm.secret_spans import scan_secrets, train_field
from tidepool.llm.tokens import count_tokens
from tidepool.llm.toxicity import held_out, labelled_lexicon, score_toxicity
from tidepool.llm.urls import filter_urls
from tidepool.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(quality_weights(docs, _table(spark, sf_dir, "labels"))).drop("source")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


#: Fixed values: (host, path, verdict).
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, labelled_lexicon(docs, _table(spark, sf_dir, "labels")), extra=[held_out()])


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan_secrets(docs, train_field(docs))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_hamming": op3_hamming,
    "op4_jaccard": op4_jaccard,
    "op5_urls": op5_urls,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_tokens": op8_tokens,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_secrets": op11_secrets,
    "op12_alignment": op12_alignment,
    "op13_phrases": op13_phrases,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical form of licence texts in DuckDB."""
    t = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"regexp_replace({t}, {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for one, other in SPELLINGS:
        t = f"replace({t}, ' {one} ', ' {other} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


#: Words, shingle sets and links as in the operator; components by repeated reach.
_SHINGLES = r"""
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words)"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
with best as (select doc_id, max(quality) as quality from labels group by doc_id),
d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    -ln((cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 12) as bigint) + 0.5::double) / 281474976710656::double)
      / case when quality >= 1 then 1.0::double when quality <= 0 then 0.25::double else 0.5::double end as key
  from documents left join best using (doc_id)),
s as (
  select source, sum(size)::bigint as source_size,
    ([5, 2, 1])[(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::double as w
  from d group by source),
c as (select *, source_size * 2::double as cap from s),
f as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (o rows between current row and unbounded following) as level
  from c window o as (order by cap / w, source asc nulls last)),
g as (select *, case when level <= cap / w then level end as ok from f),
l as (select *, first_value(ok ignore nulls) over (order by cap / w, source asc nulls last rows between unbounded preceding and current row) as lv from g),
t as (select source, source_size, coalesce(lv * w, cap) as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as full_,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(full_ * size + least(size, greatest(0, floor(target)::bigint - full_ * source_size - before)) as bigint) as taken
from p""",
    "op2_decontamination": f"""
with {_SHINGLES},
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from benchmark),
item_sets as (
  select item_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from item_words),
items as (select item_id, len(s) as n, unnest(s) as e from item_sets),
elements as (select doc_id, unnest(s) as e from sets)
select doc_id, item_id, cast(any_value(n) as bigint) as n_item, count(*) as n_shared, count(*) / any_value(n)::double as containment
from elements join items using (e) group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n)""",
    "op3_hamming": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as lo from reach group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(lo, vec_id)) as component_id,
  vec_id <= coalesce(lo, vec_id) as kept
from embeddings e left join low on low.a = e.vec_id left join n on n.a = e.vec_id""",
    "op4_jaccard": f"""
with recursive {_SHINGLES},
elements as (select doc_id, len(s) as n, md5(unnest(s)) as e from sets),
common as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
  from elements a join elements b on a.e = b.e and a.doc_id <> b.doc_id
    and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by 1, 2),
links as (select a, b from common where 100 * k >= 75 * (na + nb - k)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, cast(len(s) as bigint) as n_shingles, least(d.doc_id, coalesce(m.lo, d.doc_id)) as component_id
from sets d left join (select a, min(b) as lo from reach group by a) m on m.a = d.doc_id""",
    "op5_urls": f"""
with r(host, path, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
s as (select page_id, case when contains(url, '://') then url[position('://' in url) + 3:] else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as host from s),
p as (
  select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest[len(host) + 1:], '^[^?#]*') as path
  from h)
select page_id, any_value(p.host) as host, any_value(p.path) as path, max_by(r.host || r.path, len(r.host || r.path)) as rule,
  coalesce(max_by(r.verdict, len(r.host || r.path)), 'allow') as verdict
from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
group by page_id""",
    "op7_licenses": f"""
with known(license_id, digest) as (
  select min(k), sha256({_canonical_sql("t")}) from (values {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in TEXTS.items())}) v(k, t) group by 2),
forms as (select doc_id, {_canonical_sql("text")} as form from documents),
d as (select doc_id, case when form <> '' then sha256(form) end as digest, len(form)::bigint as n_canonical from forms)
select doc_id, d.digest, n_canonical, license_id from d left join known on known.digest = d.digest""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (
  select page_id, h, max(page_id) over (partition by h) as latest,
    list_reduce(list_transform(range(0, 40, 1), lambda k: lpad(bin(instr('0123456789abcdef', sha1(h)[k + 1]) - 1), 4, '0')), lambda a, b: a || b) as bits
  from p)
select page_id, strlen(h)::bigint as payload_bytes,
  list_reduce(list_transform(range(0, 32, 1), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * k + 1]::int + 8 * bits[5 * k + 2]::int
    + 4 * bits[5 * k + 3]::int + 2 * bits[5 * k + 4]::int + bits[5 * k + 5]::int]), lambda a, b: a || b) as payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type, case when page_id < latest then latest end as refers_to, null::varchar as problem
from d""",
    "op13_phrases": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as v from w, (values (1), (2), (3), (4)) s(k) where len(w) >= k),
f as (select lang, k, v, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select * from f where k >= 2 and f >= 30),
cuts as (select lang, v, k, f, unnest(range(1, k)) as j from c),
scored as (
  select cuts.lang, cuts.v, cuts.f, j, l.f as l, r.f as r, (2000000::hugeint * cuts.f) // (l.f::hugeint + r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.v = cuts.v[1:j] join f r on r.lang = cuts.lang and r.v = cuts.v[j + 1:]),
best as (select * from scored qualify row_number() over (partition by lang, v order by score, j) = 1),
inner_ as (
  select lang, v[i:i + m - 1] as v, max(f) as longer
  from (select lang, v, k, f, m, unnest(range(1, k - m + 2)) as i from c, (values (2), (3)) s(m) where k > m) group by all),
kept as (
  select b.*, array_to_string(b.v, ' ') as phrase from best b left join inner_ i on i.lang = b.lang and i.v = b.v
  where longer is null or 100::hugeint * longer < 80::hugeint * b.f)
select kept.lang, row_number() over (partition by kept.lang order by score desc, f desc, phrase) as rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r,
  n::bigint as n, score::bigint as score
from kept join n using (lang) qualify rank <= 2000""",
}
