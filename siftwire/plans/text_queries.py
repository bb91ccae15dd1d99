"""Registered queries on text, URLs and rules, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, dates, text, urls
from ..operators import rules
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Stand-ins for the lexicons of a deployment: topics, exclusions, ordered rules.  They only exercise the operators.
TOPICS = {"credit": ("credit", "loan", "تمويل", "crédit"), "payments": ("payment", "wallet", "مدفوعات"), "savings": ("saving", "bank", "للادخار"), "leasing": ("leasing", "factoring", "للتخصيم")}
EXCLUDED = ("drops bid", "تنسحب")
RULES = [
    rules.Rule("excluded", "Other", {"title_l": ("drops bid", "تنسحب")}, score=0),
    rules.Rule("regulator", "Regulation", {"title_l": ("regulator", "الرقابة", "régulateur")}, score=95),
    rules.Rule("board", "Governance", {"title_l": ("board of", "مجلس إدارة")}, {"title_l": ("capital call",)}, score=80),
    rules.Rule("funding", "Funding", {"title_l": ("securitization", "facility", "توريق", "titrisation"), "source_l": ("wire", "post", "المالي", "daily")}, score=70),
]


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles without exact redeliveries."""
    return table(spark, d, "articles").dropDuplicates(["id"])


A = "(select * from (select *, row_number() over (partition by id) rn from articles) where rn = 1)"
_KEPT = "list_filter(string_split(regexp_extract(coalesce(url,''), '\\?([^#]*)', 1), '&'), lambda p: contains(p,'=') and split_part(p,'=',2) <> '' and lower(split_part(p,'=',1)) not in ({drop}))"
_IN = lambda names: ",".join(f"'{n}'" for n in names)


@query(f"""with u as (select id, trim(coalesce(url,'')) url from {A}), p as (select id, url, {_KEPT.format(drop=_IN(urls.FEED_TRACKING))} q,
 regexp_extract(url,'^[a-zA-Z]+://([^/?#]*)',1) host, regexp_extract(url,'^[a-zA-Z]+://[^/?#]*([^?#]*)',1) path, regexp_extract(url,'^([a-zA-Z]+):',1) scheme from u)
 select id, lower(scheme) || '://' || lower(host) || case when path='/' then '/' else regexp_replace(path,'/+$','') end || case when len(q)>0 then '?' || array_to_string(list_sort(q),'&') else '' end as url from p""")
def q_url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", urls.canonical_url(F.col("url")).alias("url"))


@query(f"""with p as (select id, url, {_KEPT.format(drop=_IN(urls.TRACKING))} q from {A})
 select id, regexp_extract(url,'^([^?#]*)',1) || case when len(q)>0 then '?' || array_to_string(q,'&') else '' end || regexp_extract(url,'(#.*)$',1) as url from p""")
def q_tracking_params(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", urls.strip_tracking(F.col("url")).alias("url"))


@query(f"""select lower(regexp_replace(split_part(split_part(regexp_replace(trim(coalesce(url,'')),'^https?://(?:www\\.)?','','i'),'#',1),'?',1),'/+$','')) as url_key, count(*) as n, min(id) as first_id
 from {A} group by 1 having count(*) > 1""")
def q_url_key(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).groupBy(urls.url_key(F.col("url")).alias("url_key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"""select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(coalesce(title,''),'İ','i' || chr(775))),'\\s+[-|–—]\\s+[^|–—]+$',''),'[^\\p{{L}}\\p{{N}}_\\s]',' ','g'),'\\s+',' ','g')) as title_key,
 trim(regexp_replace(lower(replace(coalesce(title,''),'İ','i' || chr(775))),'[^\\p{{L}}\\p{{N}}_\\s]','','g')) as title_words from {A}""")
def q_title_norm(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", text.title_key(F.col("title")).alias("title_key"), text.title_words(F.col("title")).alias("title_words"))


@query(f"""select id, lower(trim(regexp_replace(translate(regexp_replace(replace(coalesce(title,''),'İ','i' || chr(775)),'["''“”‘’«»()\\[\\]{{}}]',' ','g'),'أإآىة','ااايه'),'\\s+',' ','g'))) as folded from {A}""")
def q_arabic_fold(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", text.fold_arabic(F.col("title")).alias("folded"))


_SQUEEZE = "trim(regexp_replace({0},'[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+',' ','g'))"


@query(f"""with t as (select id, {_SQUEEZE.format("regexp_replace(coalesce(content,''),'<[^>]+>',' ','g')")} as t from {A}) select id, length(t) as chars, md5(t) as digest from t""")
def q_tag_strip(spark: SparkSession, d: str) -> DataFrame:
    t = text.strip_tags(F.col("content"))
    return _articles(spark, d).select("id", F.length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


@query("""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text,''),'([.!?])\\s+','\\1' || chr(1),'g'),chr(1)), lambda x: regexp_replace(x,'^[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$','','g')), lambda x: x <> '') as s from documents),
 l as (select doc_id, s, list_transform(s, lambda x: lower(x)) as l from s)
 select doc_id, md5(coalesce(array_to_string(list_filter(s, lambda x, i: list_position(l, lower(x)) = i),' '),'')) as digest from l""")
def q_sentence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.distinct_sentences(F.col("text"))).alias("digest"))


_PHRASES = "|".join(text.BOILERPLATE)


@query(f"""select doc_id, length(regexp_replace(coalesce(text,''),'(?is)(?:{_PHRASES}).*|\\[?\\.\\.\\.\\]?','','g')) as compatible,
 length(regexp_replace(coalesce(text,''),'(?i)\\b(?:{_PHRASES})\\b[^\\n]*|\\[?\\.\\.\\.\\]?','','g')) as bounded from documents""")
def q_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda compat: F.length(text.strip_boilerplate(F.col("text"), compat)).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n(True).alias("compatible"), n(False).alias("bounded"))


@query(f"""select sha256(lower(replace(trim(coalesce(title,'')),'İ','i' || chr(775))) || '|' || lower(replace(trim(coalesce(content,'')),'İ','i' || chr(775)))) as content_hash, count(*) as n, min(id) as first_id from {A} group by 1 having count(*) > 1""")
def q_content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).groupBy(text.content_hash(F.col("title"), F.col("content")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"""select case when regexp_matches(coalesce(title,'') || ' ' || coalesce(content,''),'[\\x{{0600}}-\\x{{06FF}}]') then 'ar' else 'en' end as script, count(*) as n,
 count(*) filter (where case when regexp_matches(title,'[\\x{{0600}}-\\x{{06FF}}]') then false when regexp_matches(title,'[A-Za-z]') then true else coalesce(language = 'en', false) end) as english from {A} group by 1""")
def q_lang_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d)
    return rows.groupBy(text.script_language(F.col("title"), F.col("content")).alias("script")).agg(F.count("*").alias("n"), F.count_if(text.is_english(F.col("title"), F.col("language"))).alias("english"))


_RX = lambda terms: "(?i)" + "|".join(terms)


@query("with t as (select concat_ws('+'," + ",".join(f"case when regexp_matches(coalesce(title,''),'{_RX(v)}') then '{k}' end" for k, v in TOPICS.items()) + f") as topics from {A}) select topics, count(*) as n from t group by 1")
def q_topic_tags(spark: SparkSession, d: str) -> DataFrame:
    t = F.array_join(rules.topics(F.coalesce("title", F.lit("")), TOPICS), "+")
    return _articles(spark, d).groupBy(t.alias("topics")).agg(F.count("*").alias("n"))


@query(f"""select case when regexp_matches(coalesce(title,''),'{_RX(EXCLUDED)}') then 'excluded title' when regexp_matches(substring(coalesce(content,''),1,500),'{_RX(EXCLUDED)}') then 'excluded text'
 when coalesce(source_tier,9) > 2 then 'source' when regexp_matches(coalesce(title,'') || ' ' || coalesce(content,''),'{_RX(sum(TOPICS.values(), ()))}') then 'kept' else 'no term' end as reason, count(*) as n from {A} group by 1""")
def q_keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    reason = (
        F.when(urls.contains_any(title, list(EXCLUDED)), "excluded title")
        .when(urls.contains_any(F.substring(content, 1, 500), list(EXCLUDED)), "excluded text")
        .when(F.coalesce("source_tier", F.lit(9)) > 2, "source")
        .when(urls.contains_any(F.concat_ws(" ", title, content), list(sum(TOPICS.values(), ()))), "kept")
        .otherwise("no term")
    )
    return _articles(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def _case(r: rules.Rule) -> str:
    terms = [f"regexp_matches({c},'{_RX(v)}')" for c, v in r.any_of.items()] + [f"not regexp_matches({c},'{_RX(v)}')" for c, v in r.none_of.items()]
    return f"when {' and '.join(terms)} then '{r.name}'"


@query(f"""with t as (select lower(coalesce(title,'')) title_l, lower(coalesce(source_name,'')) source_l from {A}), c as (select case {' '.join(map(_case, RULES))} else 'none' end as rule from t) select rule, count(*) as n from c group by 1""")
def q_rule_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).select(F.lower(F.coalesce("title", F.lit(""))).alias("title_l"), F.lower(F.coalesce("source_name", F.lit(""))).alias("source_l"))
    return rows.groupBy(rules.first_match(RULES)["rule"].alias("rule")).agg(F.count("*").alias("n"))


@query(f"""select id, case when length(trim(regexp_extract(coalesce(title,''),'^.* - (.*)$',1))) > 0 and length(regexp_extract(coalesce(title,''),'^.* - (.*)$',1)) < 40 then trim(regexp_extract(title,'^.* - (.*)$',1)) end as publisher from {A}""")
def q_publisher_suffix(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", text.publisher_suffix(F.col("title")).alias("publisher"))


@query(f"""select id, (epoch(cast(regexp_extract(url,'/((?:19|20)\\d{{2}})/',1) || '-' || lpad(regexp_extract(url,'/(?:19|20)\\d{{2}}/(\\d{{1,2}})/',1),2,'0') || '-01' as timestamp)) + 43200)::bigint as noon from {A}
 where regexp_matches(url,'/(?:19|20)\\d{{2}}/(?:0?[1-9]|1[0-2])/') and not regexp_matches(url,'/(?:19|20)\\d{{2}}/\\d{{1,2}}/\\d{{1,2}}/')""")
def q_date_of_path(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", urls.date_of_path(F.col("url")).alias("noon")).filter("noon is not null")


@query("""select id, 'https://news.example/rss?q=' || replace(url_encode(name),'%20','+') as feed from competitors""")
def q_feed_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "competitors").select("id", urls.feed_url("https://news.example/rss?q=", F.col("name")).alias("feed"))


SPELLINGS = [("(?i)\\bsteel\\b", "Steel"), ("(?i)\\b(small|large)\\s+(\\w+)", "$1-$2"), ("-+", "-")]


@query("""select p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name,'\\bsteel\\b','Steel','gi'),'\\b(small|large)\\s+(\\w+)','\\1-\\2','gi'),'-+','-','g') as name from part""")
def q_brand_spelling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.rewrite(F.col("p_name"), SPELLINGS).alias("name"))


@query("""with s as (select id, string_split(name || ' <desk' || id || '@' || regexp_replace(url,'^https?://(www\\.)?|/$','','g') || '>; alt' || id || '@mail.example',';') p from sources)
 select id, trim(regexp_extract(p[1],'<([^>]+)>',1)) as first, trim(p[2]) as second from s""")
def q_recipients(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    listed = F.concat(F.col("name"), F.lit(" <desk"), F.col("id"), F.lit("@"), F.regexp_replace("url", "^https?://(www\\.)?|/$", ""), F.lit(">; alt"), F.col("id"), F.lit("@mail.example"))
    return s.select("id", text.recipients(listed).alias("r")).select("id", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("second"))


@query("""select distinct doc_id % 400 as days, case when doc_id % 400 <= 1 then 'Daily Brief' when doc_id % 400 between 6 and 8 then 'Weekly Brief' when doc_id % 400 between 13 and 15 then 'Bi-Weekly Brief' when doc_id % 400 between 28 and 31 then 'Monthly Brief'
 when doc_id % 400 between 58 and 62 then 'Bi-Monthly Brief' when doc_id % 400 between 85 and 95 then 'Quarterly Brief' when doc_id % 400 between 175 and 185 then 'Semi-Annual Brief' when doc_id % 400 between 360 and 366 then 'Annual Brief' else (doc_id % 400) || '-Day Brief' end as brief from documents""")
def q_brief_name(spark: SparkSession, d: str) -> DataFrame:
    days = (F.col("doc_id") % 400).alias("days")
    return table(spark, d, "documents").select(days).distinct().select("days", dates.brief_name(F.col("days")).alias("brief"))


@query("""select doc_id, '<untrusted>' || chr(10) || substring(coalesce(text,''),1,3000) || chr(10) || '</untrusted>' as prompt from documents""")
def q_prompt_wrap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.wrap_untrusted(F.col("text"), 3000).alias("prompt"))


@query("""select event_id, try_cast(json_extract_string(props,'$.k') as integer) as k, json_extract_string(props,'$.note') as note from events""")
def q_json_extract(spark: SparkSession, d: str) -> DataFrame:
    j = arrays.model_reply(F.col("props"), "k int, note string")
    return table(spark, d, "events").select("event_id", j["k"].alias("k"), j["note"].alias("note"))


@query("""with t as (select id, list_distinct(list_filter(flatten(list_transform(list_prepend(name, coalesce(aliases, [])), lambda x: list_transform(string_split(x,'/'), lambda y: trim(y)))), lambda z: z <> '')) as dummy,
 list_filter(flatten(list_transform(list_prepend(name, coalesce(aliases, [])), lambda x: list_transform(string_split(x,'/'), lambda y: trim(y)))), lambda z: z <> '') as l from competitors)
 select id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i),1,4),' OR ') as terms from t""")
def q_search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "competitors").select("id", F.array_join(arrays.first_terms(F.col("name"), F.col("aliases"), 4), " OR ").alias("terms"))
