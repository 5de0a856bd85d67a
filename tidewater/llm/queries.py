"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import best_fit, collocations, embedding_dedup, fingerprints, line_dedup, mixing, ngram_join, pitman_yor, quality, sentencepieces, source_audit, token_counts, url_lists
from tidewater.llm.common import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP2_SQL = """
with recursive given as (select vec_id, label, embedding::double[] as v from embeddings),
fit as (
  select * from given where label is not null and v is not null and len(v) > 0
  and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reached as (select vec_id, vec_id as root from given union select l.b, r.root from reached r join links l on l.a = r.vec_id),
roots as (select vec_id, min(root) as component_id from reached group by vec_id),
counts as (select a, count(*) as n from links group by a)
select g.vec_id, coalesce(c.n, 0) as n_links, r.component_id, g.vec_id = r.component_id as kept
from given g join roots r using (vec_id) left join counts c on c.a = g.vec_id
"""


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a dated list. The tables hold neither fetch days nor lists, so both follow from page_id: a page is fetched on day
    page_id * 37 mod 365; hosts of some pages are listed and delisted on other days, and some pages and domains are listed."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", (F.col("page_id") * 37 % 365).cast("int"))
    host, page = url_lists.host(F.col("url")), url_lists.page(F.col("url"))
    found = pages.select("page_id", host.alias("host"), page.alias("page")).where("host <> ''")

    def entries(every: int, rest: int, pattern, step: int, listed: bool) -> DataFrame:
        return found.where(F.col("page_id") % every == rest).select(pattern.alias("pattern"), (F.col("page_id") * step % 365).cast("int").alias("day"), F.lit(listed).alias("listed"))

    domain = F.concat(F.lit("."), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1))
    listing = entries(7, 0, F.col("host"), 13, True).union(entries(11, 3, F.col("host"), 29, False)).union(entries(5, 1, F.concat(F.lit("="), F.col("page")), 17, True)).union(entries(97, 5, domain, 41, True)).union(entries(101, 7, domain, 43, False))
    return url_lists.evaluate(captures, listing)


OP5_SQL = r"""
with found as (
  select page_id, page_id * 37 % 365 as fetch_day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as rest
  from pages),
named as (select *, string_split(host, '.') as labels from found where coalesce(host, '') <> ''),
domains as (select *, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) as domain from named),
entries as (
  select host as pattern, page_id * 13 % 365 as day, true as listed from domains where page_id % 7 = 0
  union all select host, page_id * 29 % 365, false from domains where page_id % 11 = 3
  union all select '=' || host || rest, page_id * 17 % 365, true from domains where page_id % 5 = 1
  union all select '.' || domain, page_id * 41 % 365, true from domains where page_id % 97 = 5
  union all select '.' || domain, page_id * 43 % 365, false from domains where page_id % 101 = 7),
states as (select pattern, day, bool_or(listed) as listed from entries group by all),
asks as (
  select page_id, fetch_day, 1 as rank, '=' || host || rest as pattern from named
  union all select page_id, fetch_day, 2, host from named
  union all select page_id, fetch_day, k + 1, '.' || array_to_string(labels[k:], '.') from (select *, unnest(range(2, len(labels))) as k from named)),
latest as (select a.page_id, a.fetch_day, a.rank, a.pattern, max(s.day) as day
  from asks a join states s on a.pattern = s.pattern and s.day <= a.fetch_day group by all),
hits as (
  select l.page_id, count(*) as n_listed, arg_min(l.pattern, l.rank) as pattern, arg_min(l.day, l.rank) as listed_since
  from latest l join states s on l.pattern = s.pattern and l.day = s.day where s.listed group by l.page_id)
select f.page_id, f.fetch_day::int as fetch_day, coalesce(h.n_listed, 0) as n_listed, h.pattern, h.listed_since::int as listed_since, h.page_id is not null as blocked
from found f left join hits h using (page_id)
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
with recursive split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents),
sets as (
  select doc_id, list_distinct(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as held
  from split),
shingles as (select doc_id, len(held) as n, unnest(list_transform(held, lambda x: hash(x))) as shingle from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, x.n as n, y.n as m, count(*) as common
  from shingles x join shingles y on x.shingle = y.shingle and x.doc_id <> y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by all),
links as (select a, b from shared where 100 * common >= 80 * (n + m - common)),
reached as (select doc_id, doc_id as root from sets union select l.b, r.root from reached r join links l on l.a = r.doc_id)
select doc_id, (select len(held) from sets s where s.doc_id = reached.doc_id) as n_shingles, min(root) as component_id from reached group by doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs)
    return kept.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), line_dedup.sha256_hex(F.col("text")).alias("kept_sha256"))


OP8_SQL = r"""
with lines as (
  select doc_id, line, place, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as place
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
common as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select l.*, c.key is not null as gone from lines l left join common c on l.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op9_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, in digest, and whether they decode to it again."""
    decoded = sentencepieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), decoded="_decoded")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), line_dedup.sha256_hex(F.col("_decoded")).alias("decoded_sha256"), (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, weights)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from (select row_number() over () as doc_id, text, lang, source from documents)),
found as (select doc_id, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*)::hugeint as n from found group by all having count(distinct doc_id) >= 3),
groups as (select distinct lang, source from docs),
own as (select lang, source, term, count(*)::hugeint as n from found group by all),
filled as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, k.n as lang_n
  from groups g join kept k using (lang) left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
summed as (select *, sum(n) over (partition by lang, source) as own_total, sum(lang_n) over (partition by lang, source) as lang_total, count(*) over (partition by lang, source) as v from filled),
shares as (select lang, source, term, n, 1 + 1000000000 * (n + 1) // (own_total + v)::hugeint as p, 1 + 1000000000 * (lang_n + 1) // (lang_total + v)::hugeint as q from summed),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item)) from terms)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200
"""


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
with pieces as (
  select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from (select coalesce(lang, 'und') as lang, text from documents)),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
found as (
  select lang, 1 as m, unnest(words) as phrase from split
  union all select lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) from split where len(words) > 1
  union all select lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) from split where len(words) > 2),
f as (select lang, m, phrase, count(*)::hugeint as n from found group by all having count(*) >= 10),
totals as (select lang, count(*) as n from found where m = 1 group by lang),
cuts as (
  select lang, m, phrase, n as a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') as beginning, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as ending
  from (select *, unnest(range(1, m)) as k from f where m > 1)),
scored as (select c.*, x.n as l, y.n as r, 1000000 * c.a * c.a // (x.n * y.n) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.beginning join f y on y.lang = c.lang and y.phrase = c.ending),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) as phrase, n from f where m = 3),
longest as (select lang, phrase, max(n) as n from longer group by all),
left_over as (select s.* from lowest s left join longest g on s.lang = g.lang and s.phrase = g.phrase where g.n is null or 100 * g.n < 50 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n as n, score::bigint as score
from left_over join totals t using (lang) qualify rank <= 2000
"""


QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_embedding_dedup": op2_embedding_dedup, "op3_pitman_yor": op3_pitman_yor, "op4_token_counts": op4_token_counts, "op5_url_lists": op5_url_lists, "op6_mixing": op6_mixing, "op7_ngram_join": op7_ngram_join, "op8_line_dedup": op8_line_dedup, "op9_sentencepieces": op9_sentencepieces, "op10_quality": op10_quality, "op11_source_audit": op11_source_audit, "op12_best_fit": op12_best_fit, "op13_collocations": op13_collocations}
ORACLE_SQL = {"op2_embedding_dedup": OP2_SQL, "op7_ngram_join": OP7_SQL, "op5_url_lists": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_source_audit": OP11_SQL, "op13_collocations": OP13_SQL}
