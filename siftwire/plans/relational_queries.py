"""Registered queries on joins, aggregates, ranking, the ledger, clustering and windows, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, text, urls
from ..operators import dedup, ledger, rules, vectors
from ..sources.tables import table
from .text_queries import QUERIES as _TEXT
from .text_queries import SQL as _TEXT_SQL
from .text_queries import TOPICS, A, _articles

QUERIES = dict(_TEXT)
SQL = dict(_TEXT_SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def us(c: str):
    return F.unix_micros(F.col(c))


C = "(select distinct * from article_classifications)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_classifications").distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_articles").distinct()


L = "(select distinct * from event_articles)"

# --- Scans and lookups ---------------------------------------------------------------------------------------------------


@query("select id, name, row_number() over (order by tier, priority, id) as place from sources where active")
def q_active_sources(spark: SparkSession, d: str) -> DataFrame:
    # The register of sources is a small dimension; one ordered window over it is a catalogue listing.
    w = Window.orderBy("tier", "priority", "id")
    return table(spark, d, "sources").filter("active").select("id", "name", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"select id, epoch_us(retrieved_at) as retrieved_us from {A} where retrieved_at between timestamptz '2024-06-01 00:00:00+00' and timestamptz '2024-06-30 23:59:59+00'")
def q_window_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).filter(F.col("retrieved_at").between(F.timestamp_seconds(F.lit(1717200000)), F.timestamp_seconds(F.lit(1719791999))))
    return rows.select("id", us("retrieved_at").alias("retrieved_us"))


@query("""with t as (select id, unnest(list_prepend(name, coalesce(aliases, []))) as term from competitors) select term, min(id) as first_id, count(distinct id) as owners from t where trim(term) <> '' group by term""")
def q_alias_flatten(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "competitors")
    terms = c.select("id", F.explode(F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("term"))
    return terms.filter("trim(term) <> ''").groupBy("term").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("owners"))


@query(f"select id, url from {A} where content_hash in (select content_hash from {A} where source_id = 1)")
def q_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    return a.join(a.filter("source_id = 1").select("content_hash"), "content_hash", "left_semi").select("id", "url")


@query(f"""select id, case when retrieved_at is null then true else retrieved_at >= timestamptz '2024-03-01 00:00:00+00' end as passes from {A}""")
def q_null_window(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("id", F.coalesce(F.col("retrieved_at") >= F.timestamp_seconds(F.lit(1709251200)), F.lit(True)).alias("passes"))


# --- Joins and gates -----------------------------------------------------------------------------------------------------


@query(f"""select id, title from {A} a where exists (select 1 from {C} c where c.article_id = a.id and c.is_relevant and c.relevance_score >= 50)""")
def q_relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    return rules.relevance_gate(_articles(spark, d), _classes(spark, d)).select("id", "title")


@query(f"""with j as (select e.id, e.category, string_agg(a.content,' ' order by a.id) as body from news_events e join {L} l on l.event_id = e.id join {A} a on a.id = l.article_id group by 1,2)
 select id from j where length(trim(coalesce(body,''))) >= 80 and coalesce(category,'Other') <> 'Other'""")
def q_substance_gate(spark: SparkSession, d: str) -> DataFrame:
    # The length of the joined contents is the sum of their lengths and blanks: no text is shuffled.
    a = _articles(spark, d).select(F.col("id").alias("article_id"), F.length("content").alias("n"))
    e = table(spark, d, "news_events").select("id", "category")
    size = _links(spark, d).join(a, "article_id").groupBy(F.col("event_id").alias("id")).agg((F.sum("n") + F.count("n") - 1).alias("n"))
    return e.join(size, "id").filter("n >= 80 and coalesce(category, 'Other') <> 'Other'").select("id")


@query("select id, importance_score from news_events where importance_score >= 60")
def q_importance_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_events").filter("importance_score >= 60").select("id", "importance_score")


@query(f"""with h as (select id, length(content) n, source_tier from {A} where starts_with(url,'http')) select id, n < 200 and source_tier = 1 as hydrate from h where n is not null""")
def q_hydration(spark: SparkSession, d: str) -> DataFrame:
    h = _articles(spark, d).filter(F.col("url").startswith("http") & F.col("content").isNotNull())
    return h.select("id", ((F.length("content") < 200) & (F.col("source_tier") == 1)).alias("hydrate"))


@query(f"""with s as (select id, epoch_us(created_at) as sent_us, canonical_url, canonical_title from news_events where verification_status = 'OFFICIAL'),
 x as (select distinct l.event_id, a.url from {L} l join {A} a on a.id = l.article_id), seen as (select distinct url from x where event_id in (select id from s)),
 nowt as (select max(epoch_us(created_at)) as n from news_events)
 select e.id from news_events e where not exists (select 1 from s where s.id = e.id) and not exists (select 1 from s where s.canonical_url = e.canonical_url)
 and not exists (select 1 from x where x.event_id = e.id and x.url in (select url from seen))
 and not exists (select 1 from s, nowt where s.sent_us >= nowt.n - 48::bigint*3600000000 and lower(s.canonical_title) = lower(trim(e.canonical_title)))""")
def q_ledger_anti(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "news_events")
    sent = e.filter("verification_status = 'OFFICIAL'").select("id", us("created_at").alias("sent_us"), "canonical_url", "canonical_title")
    now = e.agg(F.max(us("created_at"))).first()[0]
    return ledger.unsent(e.select("id", "canonical_url", "canonical_title"), sent, _links(spark, d), _articles(spark, d).select("id", "url"), F.lit(now)).select("id")


@query(f"""with e as (select article_id, entities, lag(entities) over (partition by event_id order by article_id) as other, event_id from (select l.event_id, c.article_id, c.entities, c.id, row_number() over (partition by l.event_id, c.article_id order by c.id) k from {L} l join {C} c on c.article_id = l.article_id) where k = 1),
 s as (select event_id, article_id, list_distinct(list_transform(coalesce(entities,[]), lambda x: lower(x))) a, list_distinct(list_transform(coalesce(other,[]), lambda x: lower(x))) b from e)
 select event_id, article_id, len(a) > 0 and len(b) > 0 and len(list_intersect(a,b)) >= greatest(1, least(len(a),len(b)) // 2) as overlap from s""")
def q_entity_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = _classes(spark, d).groupBy("article_id").agg(F.min_by("entities", "id").alias("entities"))
    j = _links(spark, d).join(c, "article_id").withColumn("other", F.lag("entities").over(Window.partitionBy("event_id").orderBy("article_id")))
    return j.select("event_id", "article_id", arrays.entity_overlap(F.col("entities"), F.col("other")).alias("overlap"))


@query("""with g as (select event_id, user_id, epoch_us(ts) t, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) p from events) select event_id, p is null or t - p <= 36::bigint*3600000000 as near from g""")
def q_time_proximity(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", dates.within_hours(us("ts"), F.lag(us("ts")).over(w), 36).alias("near"))


@query(f"""with m as (select l.event_id, a.id seq, a.url, a.source_tier tier, e.canonical_source_tier et, e.canonical_url eu from {L} l join {A} a on a.id = l.article_id join news_events e on e.id = l.event_id),
 g as (select event_id, arg_min(url, seq) filter (where regexp_matches(url,'(?i)press\\.example|daily\\.example')) off, arg_min(url, seq) filter (where tier <= 2 or regexp_matches(coalesce(url,''),'(?i)news\\.example')) ver, min(et) et, min(eu) eu from m group by 1)
 select event_id, case when off is not null or et = 1 then 'OFFICIAL' when ver is not null then 'VERIFIED' else 'UNVERIFIED' end as status, case when off is not null then off when et = 1 then eu else ver end as source from g""")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).select(F.col("id").alias("article_id"), "url", F.col("source_tier").alias("tier"))
    e = table(spark, d, "news_events").select(F.col("id").alias("event_id"), F.col("canonical_source_tier").alias("event_tier"), F.col("canonical_url").alias("event_url"))
    m = _links(spark, d).join(a, "article_id").join(e, "event_id").withColumn("seq", F.col("article_id"))
    return dedup.provenance(m, ["press.example", "daily.example"], ["news.example"])


# --- Aggregates ----------------------------------------------------------------------------------------------------------


@query("select verification_status, count(*) as n, count(*) filter (where importance_score >= 60) as important from news_events group by 1")
def q_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_events").groupBy("verification_status").agg(F.count("*").alias("n"), F.count_if(F.col("importance_score") >= 60).alias("important"))


@query(f"""select (select count(*) from articles) as collected, (select count(*) from {A} where length(trim(coalesce(title,''))) >= 5) as preprocessed,
 (select count(distinct article_id) from {C} where is_relevant and relevance_score >= 50) as relevant, (select count(*) from news_events) as events, (select count(*) from news_events where verification_status <> 'UNVERIFIED') as verified""")
def q_run_counters(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").agg(F.count("*").alias("collected"))
    p = _articles(spark, d).agg(F.count_if(F.length(F.trim(F.coalesce("title", F.lit("")))) >= 5).alias("preprocessed"))
    r = _classes(spark, d).filter(F.col("is_relevant") & (F.col("relevance_score") >= 50)).agg(F.count_distinct("article_id").alias("relevant"))
    e = table(spark, d, "news_events").agg(F.count("*").alias("events"), F.count_if(F.col("verification_status") != "UNVERIFIED").alias("verified"))
    # Four relations of one row each.
    return a.crossJoin(p).crossJoin(r).crossJoin(e)


@query("""select coalesce(r_name,'market') as pillar, count(*) as customers, round(sum(c_acctbal),2) as balance from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey group by 1""")
def q_pillar_rollup(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.groupBy(F.coalesce("r_name", F.lit("market")).alias("pillar")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""with m as (select l.event_id, a.id, a.content, not regexp_matches(coalesce(a.title,''),'[\\x{{0600}}-\\x{{06FF}}]') as en from {L} l join {A} a on a.id = l.article_id where a.content is not null),
 p as (select event_id, row_number() over (partition by event_id order by (en and length(content) >= 80) desc, length(content) desc, id) k, id from m) select event_id, id as article_id from p where k = 1""")
def q_longest_content(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).filter("content is not null").select(F.col("id").alias("article_id"), F.length("content").alias("n"), (~F.coalesce("title", F.lit("")).rlike("[\\u0600-\\u06FF]")).alias("en"))
    key = F.struct((~(F.col("en") & (F.col("n") >= 80))).alias("later"), (-F.col("n")).alias("shorter"), "article_id")
    return _links(spark, d).join(a, "article_id").groupBy("event_id").agg(F.min(key)["article_id"].alias("article_id"))


@query(f"""with r as (select is_relevant y, relevance_score >= 50 p from {C}), n as (select count(*) filter (where y and p) tp, count(*) filter (where not coalesce(y,false) and p) fp, count(*) filter (where y and not coalesce(p,false)) fn, count(*) filter (where not coalesce(y,false) and not coalesce(p,false)) tn from r)
 select tp, fp, fn, tn, round(tp/(tp+fp),3) as precision, round(tp/(tp+fn),3) as recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),3) as f1 from n""")
def q_eval_prf(spark: SparkSession, d: str) -> DataFrame:
    return rules.confusion(_classes(spark, d).withColumn("p", F.col("relevance_score") >= 50), "is_relevant", "p")


@query("""select max(epoch_us(ts)) filter (where event_type = 'purchase') as last_us, least(coalesce(max(epoch_us(ts)) filter (where event_type = 'purchase') - 6::bigint*3600000000, max(epoch_us(ts))), max(epoch_us(ts)) - 168::bigint*3600000000) as start_us from events""")
def q_window_plan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").agg(F.max(F.when(F.col("event_type") == "purchase", us("ts"))).alias("last_us"), F.max(us("ts")).alias("now"))
    return e.select("last_us", dates.window_start(F.col("last_us"), F.col("now")).alias("start_us"))


# --- Ranking and sets ----------------------------------------------------------------------------------------------------


@query(f"select id, epoch_us(retrieved_at) as retrieved_us from {A} order by retrieved_at desc nulls last, id limit 15")
def q_topk_recent(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).orderBy(F.desc_nulls_last("retrieved_at"), "id").limit(15).select("id", us("retrieved_at").alias("retrieved_us"))


@query(f"""with r as (select content_hash, id, count(*) over (partition by content_hash) members, row_number() over (partition by content_hash order by (length(coalesce(content,'')) < 80), (not case when regexp_matches(title,'[\\x{{0600}}-\\x{{06FF}}]') then false when regexp_matches(title,'[A-Za-z]') then true else coalesce(language = 'en', false) end),
 coalesce(source_tier,9), -length(coalesce(content,'')), -coalesce(epoch_us(retrieved_at),0), id) k from {A} where content_hash is not null) select content_hash, id, members from r where k = 1""")
def q_canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).filter("content_hash is not null")
    rows = a.select("content_hash", "id", text.is_english(F.col("title"), F.col("language")).alias("english"), F.col("source_tier").alias("tier"), "content", us("retrieved_at").alias("at_us"))
    return dedup.canonical_pick(rows, "content_hash")


@query("""select distinct o_custkey as c_custkey from orders except select c_custkey from customer where c_acctbal < 0""")
def q_set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).subtract(table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("""select 'customer' as kind, c_nationkey as nation, count(*) as n from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2""")
def q_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).select(F.lit("customer").alias("kind"), "nation", "n")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).select(F.lit("supplier").alias("kind"), "nation", "n")
    return c.unionByName(s)


@query("""select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders""")
def q_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey").intersect(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


# --- Upserts and the run log ---------------------------------------------------------------------------------------------


@query("""with b as (select c_custkey, c_name, c_acctbal, 0 v from customer where c_custkey % 3 <> 0 union all select c_custkey, c_name, c_acctbal + 1, 1 from customer where c_custkey % 2 = 0), r as (select *, row_number() over (partition by c_custkey order by v desc) k from b) select c_custkey, c_name, c_acctbal from r where k = 1""")
def q_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ledger.upsert(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query(f"""with s as (select url, min(id) sid from {A} where source_id = 1 and url is not null group by 1) select a.id, coalesce(s.sid, a.id) as stored_id from {A} a left join s on s.url = a.url""")
def q_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    _, mapped = ledger.insert_absent(a.filter("source_id = 1").select("id", "url"), a.select(F.col("id").alias("own"), "id", "url"), "url")
    return mapped.select(F.col("own").alias("id"), F.col("id").alias("stored_id"))


@query("""select id, active and tier <= 2 as active from sources""")
def q_seed_deactivate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    return ledger.deactivate_missing(s.select("id", "name", "active"), s.filter("tier <= 2").select("name"), "name").select("id", "active")


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice < 1000 then 'FAILED' when o_orderstatus = 'F' then 'PARTIAL' else 'COMPLETED' end as status from orders""")
def q_status_rule(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("o_orderstatus") == "F", F.lit("error"))
    return table(spark, d, "orders").select("o_orderkey", ledger.run_status(error, F.when(F.col("o_totalprice") >= 1000, 1).otherwise(0)).alias("status"))


# --- Clustering and search -----------------------------------------------------------------------------------------------


def greedy_input(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    key = text.title_key(F.col("title"))
    return a.select("id", urls.canonical_url(F.col("url")).alias("k1"), "content_hash", F.when(F.length(key) > 20, key).alias("k3"))


@query(f"""with k as (select id, lower(regexp_replace(split_part(split_part(regexp_replace(trim(coalesce(url,'')),'^https?://(?:www\\.)?','','i'),'#',1),'?',1),'/+$','')) u, content_hash h from {A}),
 e as (select id a, min(id) over (partition by u) b from k where u <> '' union all select id, min(id) over (partition by h) from k where h is not null),
 s as (select a, b from e where a <> b), ab as (select a, b from s union select b, a from s),
 r as (with recursive w(n, c) as (select a, a from ab union select ab.b, w.c from w join ab on ab.a = w.n) select n, min(c) c from w group by n)
 select k.id as node, coalesce(r.c, k.id) as component from k left join r on r.n = k.id""")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d).withColumn("u", urls.url_key(F.col("url")))
    edges = dedup.star_edges(a, "id", F.col("u")).unionByName(dedup.star_edges(a, "id", F.col("content_hash")))
    return dedup.components(a.select(F.col("id").alias("node")), edges)


#: |LCS| of strings x and y in SQL: bit-parallel on 128-bit integers where the shorter one fits, else by rows of the plain table.
_BITS = """(length(x) - bit_count(list_reduce(list_prepend((1::hugeint << length(x)) - 1, list_transform(string_split(y,''), lambda ch: list_reduce(list_prepend(0::hugeint, list_transform(range(length(x)), lambda i: case when x[i + 1] = ch then 1::hugeint << i::int else 0::hugeint end)), lambda p, q: p | q))),
 lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::hugeint << length(x)) - 1))))"""
_ROWS = """(list_reduce(list_prepend(list_transform(range(length(y) + 1), lambda i: 0::bigint), list_transform(string_split(x,''), lambda ch: [unicode(ch)::bigint])), lambda r, ch: list_reduce(list_prepend([0::bigint], list_transform(range(1, length(y) + 1), lambda j: [case when unicode(y[j]) = ch[1] then r[j] + 1 else r[j + 1] end])), lambda acc, e: list_append(acc, greatest(acc[-1], e[1])))))[-1]"""
#: Letters beyond ASCII as one byte each, some together: the distance of bytes is then no greater than that of characters.
_BYTES = "regexp_replace(translate({0},'ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيپچژگکیöüçğışéèêàâîôûäß','ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{{|}}`A'),'[^\\x00-\\x7F]','~','g')"
_TOPIC = "case " + " ".join(f"when regexp_matches(coalesce(a.title,''),'(?i){'|'.join(v)}') then '{k}'" for k, v in TOPICS.items()) + " else 'OTHER' end"


@query(f"""with recursive w0 as ({_TEXT_SQL['q_title_norm']}), ent as (select article_id, list_sort(list_distinct(list_transform(coalesce(arg_min(coalesce(entities,[]), id),[]), lambda e: lower(e)))) as es from {C} group by 1),
 a as (select a.id, lower(regexp_replace(split_part(split_part(regexp_replace(trim(coalesce(a.url,'')),'^https?://(?:www\\.)?','','i'),'#',1),'?',1),'/+$','')) as u, a.content_hash as h, epoch_us(a.retrieved_at) as t, {_TOPIC} as topic, coalesce(ent.es,[]) as es,
  array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(w0.title_words,'[^\\p{{L}}\\p{{N}}_]+',' ','g')),' '), lambda z: z <> '')),' ') as s from {A} a join w0 using (id) left join ent on ent.article_id = a.id),
 b as (select *, {_BYTES.format('s')} as o from a), c as (select levenshtein(p.o, q.o) as lev, p.id as i, q.id as j, p.es as pe, q.es as qe, case when length(p.s) <= length(q.s) then p.s else q.s end as x, case when length(p.s) <= length(q.s) then q.s else p.s end as y from b p join b q on p.id < q.id and (p.t is null or q.t is null or abs(p.t - q.t) <= 129600000000) and (p.topic = q.topic or p.topic = 'OTHER' or q.topic = 'OTHER')
  where p.s <> '' and q.s <> '' and levenshtein(p.o, q.o) <= 0.325 * (length(p.s) + length(q.s))),
 d as (select *, length(list_intersect(pe, qe)) as k, least(length(pe), length(qe)) as n from c), f as (select i, j, k, n, case when x = y then 100 else round_even(200.0 * case when length(x) <= 120 then {_BITS} else {_ROWS} end / (length(x) + length(y)), 0) end as ratio from d where x = y or lev <= 0.155 * (length(x) + length(y)) or n > 0 and k >= greatest(1, n // 2)),
 star as (select id as i, min(id) over (partition by u) as j from a where u <> '' union all select id, min(id) over (partition by h) from a where h is not null and h <> '' union all select id, min(id) over (partition by topic) from a where topic <> 'OTHER'
  union all select i, j from f where ratio >= 85 or ratio >= 68 and n > 0 and k >= greatest(1, n // 2)),
 e as (select distinct i, j from star where i <> j union select distinct j, i from star where i <> j),
 r(n, c) as (select id, id from a union select e.j, r.c from r join e on e.i = r.n and r.c < e.j)
 select n as node, min(c) as component from r group by 1""")
def q_event_clusters(spark: SparkSession, d: str) -> DataFrame:
    a = _articles(spark, d)
    c = _classes(spark, d).groupBy("article_id").agg(F.min_by("entities", "id").alias("entities"))
    topic = F.coalesce(F.try_element_at(rules.topics(F.coalesce("title", F.lit("")), TOPICS), F.lit(1)), F.lit("OTHER"))
    rows = a.join(c, a["id"] == c["article_id"], "left").select(
        F.col("id").alias("node"), urls.url_key(F.col("url")).alias("url_key"), "content_hash", topic.alias("topic"),
        us("retrieved_at").alias("at_us"), text.title_words(F.col("title")).alias("title"), "entities",
    )
    return dedup.event_clusters(rows)


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) s from q, embeddings e where e.vec_id <> q.vec_id),
 r as (select query_id, vec_id, row_number() over (partition by query_id order by round(s,9) desc, vec_id) as rank from s) select query_id, rank, vec_id from r where rank <= 10""")
def q_cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.filter("vec_id % 100 = 0"), 10)


# --- Digest --------------------------------------------------------------------------------------------------------------


@query("""with e as (select category, coalesce(subcategory,'') sub, coalesce(canonical_title,'') t, importance_score, id from news_events where importance_score >= 60), r as (select *, row_number() over (partition by category order by importance_score desc, id) k from e)
 select coalesce(category,'Other') as category, string_agg('- ' || t || case when sub <> '' then ' (' || sub || ')' else '' end, chr(10) order by k) as block from r where k <= 5 group by 1""")
def q_digest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "news_events").filter("importance_score >= 60")
    w = Window.partitionBy("category").orderBy(F.desc("importance_score"), "id")
    line = F.concat(F.lit("- "), F.coalesce("canonical_title", F.lit("")), F.when(F.coalesce("subcategory", F.lit("")) != "", F.concat(F.lit(" ("), F.col("subcategory"), F.lit(")"))).otherwise(""))
    top = e.withColumn("k", F.row_number().over(w)).filter("k <= 5").select(F.coalesce("category", F.lit("Other")).alias("category"), "k", line.alias("line"))
    return top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("block"))


@query("""select id, case when category = 'Competitor' then coalesce(subcategory,'Competitor') when subcategory is not null and subcategory <> '' then category || ' — ' || subcategory else category end as label from news_events""")
def q_category_label(spark: SparkSession, d: str) -> DataFrame:
    sub = F.col("subcategory")
    label = F.when(F.col("category") == "Competitor", F.coalesce(sub, F.lit("Competitor"))).when(sub.isNotNull() & (sub != ""), F.concat(F.col("category"), F.lit(" — "), sub)).otherwise(F.col("category"))
    return table(spark, d, "news_events").select("id", label.alias("label"))


# --- Windows over time, and what the reference lacks -----------------------------------------------------------------------


@query("select epoch_us(time_bucket(interval '1 day', ts)) as day_us, event_type, count(*) as n, round(sum(value),2) as total from events group by 1,2")
def q_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(us("w.start").alias("day_us"), "event_type", "n", "total")


@query("""with h as (select epoch_us(ts) t from events), s as (select (t // 21600000000 - k) * 21600000000 as start_us from h, range(4) r(k)) select start_us::bigint as start_us, count(*) as n from s group by 1""")
def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(us("w.start").alias("start_us"), "n")


@query("""with g as (select user_id, epoch_us(ts) t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 1800000000 then 0 else 1 end b, event_id from events),
 s as (select *, sum(b) over (partition by user_id order by t, event_id) k from g) select user_id, min(t) as start_us, count(*) as n from s group by user_id, k""")
def q_session(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", us("w.start").alias("start_us"), "n")


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity),2) as quantity from lineitem group by rollup(l_returnflag, l_linestatus)""")
def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'view') as view from events group by 1""")
def q_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@query("""select o_orderkey, (sum(round(o_totalprice*100)::bigint) over w)::bigint as moving, round(o_totalprice*100)::bigint - lag(round(o_totalprice*100)::bigint) over (partition by o_custkey order by o_orderdate, o_orderkey) as change, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey) as quarter from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)""")
def q_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", F.sum(cents).over(w.rowsBetween(-2, 0)).alias("moving"), (cents - F.lag(cents).over(w)).alias("change"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query("""select o.o_orderkey, max_by(e.event_id, (e.ts, e.event_id)) as event_id from orders o left join events e on e.user_id = o.o_custkey and e.ts <= o.o_orderdate group by 1""")
def q_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last event of the customer at or before each order: one sorted pass over the union, no range join."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(1).alias("side"), "o_orderkey", F.lit(None).cast("bigint").alias("event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("k").orderBy("t", "side", F.coalesce("event_id", F.lit(-1)))
    both = o.unionByName(e).withColumn("last", F.last("event_id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return both.filter("side = 1").select("o_orderkey", F.col("last").alias("event_id"))
