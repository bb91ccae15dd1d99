"""Registered queries on feeds, rules, dates, clocks, graphs and joins, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, text, urls
from ..operators import dedup, ledger, rules, vectors
from ..sources import feeds
from ..sources.tables import table
from .relational_queries import C, L, _classes, _links, greedy_input, us
from .text_queries import _RX, EXCLUDED, RULES, SQL as _TEXT_SQL, TOPICS, A, _articles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Stand-ins of a deployment's tables, as in ``text_queries``.
TOPIC_RULES = [
    rules.Rule("rates", "RATES", {"t": ("cost", "rate", "taux", "faiz")}, all_of=(("t", ("bank", "banque", "بنك")),)),
    rules.Rule("securitisation", "SECURITISATION", {"t": ("securitization", "titrisation", "verbriefung", "توريق")}),
    rules.Rule("capital", "CAPITAL", {"t": ("capital", "زيادة")}, {"t": ("capital call",)}),
]
CONCEPTS = {"securitisation": ("securitization", "titrisation", "verbriefung", "توريق"), "credit": ("credit", "crédit", "kredit", "تمويل"), "savings": ("savings", "للادخار")}
LABELS = {"Regulation": "Rules", "Governance": "Boards", "Funding": "Money"}
PAGES = "(select id, url, content as html from " + A + " where content is not null)"

# --- Feeds and pages -----------------------------------------------------------------------------------------------------


@query(f"""select url, title, href from (select distinct on (id, href) id, url, title, href, pos from (
  select id, url, pos, trim(regexp_replace(ts[pos],'\\s+',' ','g')) as title, regexp_extract(url,'^([a-zA-Z]+://[^/?#]+)',1) || hs[pos] as href from (
   select id, url, regexp_extract_all(html,'<a href="(/[^"]*)"[^>]*>([^<]*)</a>',1) hs, regexp_extract_all(html,'<a href="(/[^"]*)"[^>]*>([^<]*)</a>',2) ts, unnest(range(1, len(regexp_extract_all(html,'<a href="(/[^"]*)"[^>]*>([^<]*)</a>',1)) + 1)) pos from {PAGES}))
  where length(title) >= 12 order by id, href, pos)
 qualify row_number() over (partition by id order by pos) <= 30""")
def q_html_links(spark: SparkSession, d: str) -> DataFrame:
    pages = _articles(spark, d).filter("content is not null").select("url", F.col("content").alias("html"))
    return feeds.html_links(pages)


@query(f"""select sha256(concat_ws('|', u.url, t.title)) as id, t.title, u.url, epoch_us(a.retrieved_at) as published_us, case when regexp_matches(t.title || ' ' || t.content,'[\\x{{0600}}-\\x{{06FF}}]') then 'ar' else 'en' end as language, sha256(lower(replace(t.title,'İ','i' || chr(775))) || '|' || lower(replace(t.content,'İ','i' || chr(775)))) as content_hash
 from {A} a join ({_TEXT_SQL['q_url_canonical']}) u on u.id = a.id
 join (select id, trim(regexp_replace(regexp_replace(coalesce(title,''),'<[^>]+>',' ','g'),'[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+',' ','g')) as title, trim(regexp_replace(regexp_replace(coalesce(content,''),'<[^>]+>',' ','g'),'[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+',' ','g')) as content from {A}) t on t.id = a.id where t.title <> '' and u.url <> ''""")
def q_make_articles(spark: SparkSession, d: str) -> DataFrame:
    """Feed rows as articles; what the feed says of the time is the retrieval, written out."""
    a = _articles(spark, d)
    raw = a.select("title", "url", "content", us("retrieved_at").cast("string").alias("published_text"), F.col("source_name"))
    made = feeds.make_articles(raw, F.timestamp_seconds(F.lit(1767225600)))
    return made.select("id", "title", "url", us("published_at").alias("published_us"), "language", "content_hash")


@query(f"""select title, url, content, strftime(timezone('UTC', retrieved_at), '%Y-%m-%d %H:%M:%S') as published_text, source_name from {A} where source_id is not null""")
def q_search_results(spark: SparkSession, d: str) -> DataFrame:
    """Search replies in JSON, one per source, as rows again."""
    a = _articles(spark, d).filter("source_id is not null")
    hit = F.struct("title", F.col("url").alias("link"), F.col("content").alias("snippet"), F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("source_name").alias("source"))
    replies = a.select(F.to_json(F.struct(F.array(hit).alias("news_results"))).alias("reply"))
    return feeds.search_results(replies)


@query("""select o_orderkey, coalesce(o_orderkey % 7 <> 0 and c = 200 and o_custkey % 3 >= 1, false) as available, case when o_orderkey % 7 = 0 then 'no_key' when c is null then 'network' when c = 429 then 'quota' when c in (401,403) then 'denied' when c <> 200 then 'http_error' when o_custkey % 3 < 1 then 'exhausted' else 'ok' end as reason
 from (select *, case o_orderkey % 6 when 0 then 200 when 1 then 429 when 2 then 401 when 3 then 500 when 4 then 200 end as c from orders)""")
def q_quota_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    code = F.when(k.isin(0, 4), 200).when(k == 1, 429).when(k == 2, 401).when(k == 3, 500)
    s = feeds.quota_status(code, F.col("o_custkey") % 3, F.when(F.col("o_orderkey") % 7 != 0, "key"))
    return table(spark, d, "orders").select("o_orderkey", s["available"].alias("available"), s["reason"].alias("reason"))


@query("""select id, name, row_number() over (order by priority, name) as place from competitors where active""")
def q_active_competitors(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("priority", "name")  # a listing of the register, a small dimension
    return table(spark, d, "competitors").filter("active").select("id", "name", F.row_number().over(w).cast("bigint").alias("place"))


@query("""with t as (select id, unnest(list_filter(flatten(list_transform(list_prepend(name, coalesce(aliases, [])), lambda x: list_transform(string_split(x,'/'), lambda y: trim(y)))), lambda z: z <> '')) as term from competitors where active)
 select id, 'offers ' || term as ask from t union select id, 'market ' || term from t""")
def q_search_asks(spark: SparkSession, d: str) -> DataFrame:
    """Two asks for every name of every active competitor."""
    c = table(spark, d, "competitors").filter("active")
    terms = c.select("id", F.explode(arrays.first_terms(F.col("name"), F.col("aliases"), 2**30)).alias("term"))
    return terms.select("id", F.explode(F.array(F.concat(F.lit("offers "), "term"), F.concat(F.lit("market "), "term"))).alias("ask"))


# --- Gates and rules -----------------------------------------------------------------------------------------------------


@query(f"""with t as (select id, lower(coalesce(title,'')) t from {A}) select case when regexp_matches(t,'(?i)cost|rate|taux|faiz') and regexp_matches(t,'(?i)bank|banque|بنك') then 'RATES' when regexp_matches(t,'(?i)securitization|titrisation|verbriefung|توريق') then 'SECURITISATION' when regexp_matches(t,'(?i)capital|زيادة') and not regexp_matches(t,'(?i)capital call') then 'CAPITAL' else 'OTHER' end as topic, count(*) as n from t group by 1""")
def q_topic_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).select(F.lower(F.coalesce("title", F.lit(""))).alias("t"))
    return rows.groupBy(rules.first_match(TOPIC_RULES)["label"].alias("topic")).agg(F.count("*").alias("n"))


@query(f"""with j as (select e.id, coalesce(e.canonical_title,'') t, e.category, coalesce(trim(string_agg(a.content,' ' order by a.id)),'') as body from news_events e left join {L} l on l.event_id = e.id left join {A} a on a.id = l.article_id group by all)
 select id, not regexp_matches(t,'{_RX(EXCLUDED)}') and length(body) >= 80 and coalesce(category,'Other') <> 'Other' and (category <> 'FRA' or regexp_matches(t || ' ' || body,'{_RX(TOPICS['credit'])}')) as kept from j""")
def q_substance_terms(spark: SparkSession, d: str) -> DataFrame:
    """The whole substance gate: excluded titles, joined contents, category, and terms that one category must hold.

    Contents are not joined: their lengths and what the terms find in each are summed up, as no term reaches over the blank between.
    """
    term = urls.contains_any(F.col("content"), list(TOPICS["credit"]))
    a = _articles(spark, d).select(F.col("id").alias("article_id"), F.length("content").alias("n"), term.alias("hit"), F.length(F.regexp_extract("content", "^ *", 0)).alias("lead"), F.length(F.regexp_extract("content", " *$", 0)).alias("tail"))
    g = _links(spark, d).join(a, "article_id").filter("n is not null").groupBy(F.col("event_id").alias("id")).agg((F.sum("n") + F.count("n") - 1 - F.min_by("lead", "article_id") - F.max_by("tail", "article_id")).alias("n"), F.bool_or("hit").alias("hit"))
    e = table(spark, d, "news_events").select("id", F.coalesce("canonical_title", F.lit("")).alias("t"), "category").join(g, "id", "left")
    kept = ~urls.contains_any(F.col("t"), list(EXCLUDED)) & (F.coalesce("n", F.lit(0)) >= 80) & (F.coalesce("category", F.lit("Other")) != "Other") & ((F.col("category") != "FRA") | urls.contains_any(F.col("t"), list(TOPICS["credit"])) | F.coalesce("hit", F.lit(False)))
    return e.select("id", kept.alias("kept"))


@query(f"""select id, coalesce(length(content),0) < 200 and starts_with(coalesce(url,''),'http') and (coalesce(source_tier,9) = 1 or regexp_matches(coalesce(title,'') || ' ' || coalesce(content,''),'{_RX(sum(TOPICS.values(), ()))}')) as hydrate from {A}""")
def q_hydration_terms(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    need = (F.coalesce(F.length("content"), F.lit(0)) < 200) & F.coalesce(F.col("url"), F.lit("")).startswith("http") & ((F.coalesce("source_tier", F.lit(9)) == 1) | urls.contains_any(said, list(sum(TOPICS.values(), ()))))
    return _articles(spark, d).select("id", need.alias("hydrate"))


@query("""select id, length(coalesce(summary,'')) as chars, summary is not null and length(summary) >= 50 and not regexp_matches(summary,'[\\x{0600}-\\x{06FF}]') and not starts_with(summary,')') and not starts_with(summary,'?*') and not contains(lower(summary),'?* yes') and not contains(lower(summary),'?* no')
 and not contains(lower(summary),'professional english? yes') and not contains(lower(summary),'concrete facts? yes') and not regexp_matches(lower(summary),'no_substance|contains only the title|without disclosing any concrete figures|no specific figures|no specific dates, rates, or institutional decisions|metadata and date of this listing committee|provides only the metadata') as valid from news_events""")
def q_valid_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_events").select("id", F.length(F.coalesce("summary", F.lit(""))).cast("bigint").alias("chars"), text.valid_summary(F.col("summary")).alias("valid"))


@query("""select p_partkey, p_name || chr(10) || 'Rates of ' || p_brand || ' rose.' as summary from part""")
def q_scrub_summary(spark: SparkSession, d: str) -> DataFrame:
    """Replies with fences, headings and checklists around two lines of prose."""
    reply = F.concat(F.lit("```text\n**Summary:** "), F.col("p_name"), F.lit("\n\n* Concrete facts? Yes\n Rates of "), F.col("p_brand"), F.lit(" rose.  \n```"))
    return table(spark, d, "part").select("p_partkey", text.scrub_summary(reply).alias("summary"))


@query(f"""select id, count(*) over () as n from {A} where regexp_matches(coalesce(title,''),(select '(?i)(^|[^\\p{{L}}\\p{{N}}_])(' || string_agg(distinct regexp_replace(trim(x),'([^\\p{{L}}\\p{{N}}\\s])','\\\\\\1','g'),'|') || ')([^\\p{{L}}\\p{{N}}_]|$)' from (select unnest(list_prepend(name, coalesce(aliases,[]))) x from competitors where active) where length(trim(x)) > 3))""")
def q_alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose title names an active competitor as a word; the register is a small dimension, read as one alternation."""
    c = table(spark, d, "competitors").filter("active").select(F.explode(F.array_prepend(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("x"))
    names = [r.x for r in c.filter("length(trim(x)) > 3").distinct().limit(feeds.REGISTER + 1).collect()]
    if len(names) > feeds.REGISTER:
        raise ValueError(f"the register holds more than {feeds.REGISTER} names")
    found = rules.aliases_in(_articles(spark, d).withColumn("t", F.coalesce("title", F.lit(""))), "t", names).select("id")
    return found.join(found.agg(F.count("*").alias("n")))


@query(f"""with r as (select case when c.category = n.category then 1 else 0 end as same from {C} c join {L} l on l.article_id = c.article_id join news_events n on n.id = l.event_id where c.category is not null and n.category is not null) select count(*) as n, sum(same)::bigint as hits, round(sum(same)/count(*),3) as accuracy from r""")
def q_category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    c = _classes(spark, d).select("article_id", F.col("category").alias("said"))
    n = table(spark, d, "news_events").select(F.col("id").alias("event_id"), F.col("category").alias("label"))
    return rules.accuracy(c.join(_links(spark, d), "article_id").join(n, "event_id"), "label", "said")


@query("""select id, coalesce(case category when 'Regulation' then 'Rules' when 'Governance' then 'Boards' when 'Funding' then 'Money' end, category || coalesce(' — ' || nullif(subcategory,''),'')) as label from news_events""")
def q_mapped_label(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    sub = F.coalesce(F.concat(F.lit(" — "), F.nullif(F.col("subcategory"), F.lit(""))), F.lit(""))
    return table(spark, d, "news_events").select("id", F.coalesce(F.try_element_at(names, F.col("category")), F.concat("category", sub)).alias("label"))


@query(f"""select id, case when regexp_matches(lower(coalesce(title,'')),'offer|discount|عرض|خصم') then 'Offers' else 'Market' end as sub from {A}""")
def q_subcategory(spark: SparkSession, d: str) -> DataFrame:
    offers = [rules.Rule("offers", "Offers", {"t": ("offer", "discount", "عرض", "خصم")})]
    return _articles(spark, d).withColumn("t", F.lower(F.coalesce("title", F.lit("")))).select("id", rules.first_match(offers, "Market")["label"].alias("sub"))


# --- Dates and numbers ---------------------------------------------------------------------------------------------------


@query("""with s as (select o_orderkey, o_orderkey % 900000 as s from orders) select o_orderkey, case when s <= 172800 then 'day' when s <= 691200 then 'week' else 'month' end as bucket from s""")
def q_recency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.recency_bucket(F.col("o_orderkey") % 900000).alias("bucket"))


@query("""select o_orderkey, coalesce(case when o_orderkey % 5 = 0 then (o_orderkey % 30)::int end, case when o_orderkey % 3 <> 0 then round_even((o_orderkey % 1000000) / 86400.0, 0)::int end, 7) as days from orders""")
def q_effective_days(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = F.when(k % 5 == 0, (k % 30).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.effective_days(given, F.when(k % 3 != 0, F.lit(0)), (k % 1000000) * 1_000_000).alias("days"))


@query("""select event_id, strftime(timezone('Africa/Cairo', ts at time zone 'UTC'), '%d %b %Y, %H:%M') || ' Cairo' as shown from events""")
def q_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.display(F.col("ts"), "Africa/Cairo", "Cairo").alias("shown"))


@query(f"""select id, trunc(confidence * 100)::int as score, coalesce(try_cast(category as int), 0) as number from {C}""")
def q_safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).select("id", arrays.percent(F.col("confidence")).alias("score"), arrays.safe_int(F.col("category")).alias("number"))


@query("""select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 129600000000 preceding and 129600000000 following) - 1 as near from events""")
def q_near_events(spark: SparkSession, d: str) -> DataFrame:
    """How many other events of the user lie within 36 hours of each: a range frame, where a self-join would list all pairs."""
    w = Window.partitionBy("user_id").orderBy(us("ts")).rangeBetween(-36 * 3_600_000_000, 36 * 3_600_000_000)
    return table(spark, d, "events").select("user_id", "event_id", (F.count("*").over(w) - 1).alias("near"))


@query("""with r as (select epoch_us(ts) as t, case user_id % 4 when 0 then 'FAILED' when 1 then 'PARTIAL' else 'COMPLETED' end as status, (value * 10)::int % 3 as sent from events) select max(t) filter (where status in ('COMPLETED','PARTIAL') and sent > 0) as started_us from r""")
def q_last_good_run(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 4
    runs = table(spark, d, "events").select(us("ts").alias("started_us"), F.when(k == 0, "FAILED").when(k == 1, "PARTIAL").otherwise("COMPLETED").alias("status"), (F.round(F.col("value") * 10).cast("int") % 3).alias("events_sent"))
    return ledger.last_good_run(runs)


# --- Graphs --------------------------------------------------------------------------------------------------------------


@query(f"""with recursive u as (select id, url from ({_TEXT_SQL['q_url_canonical']})), t as (select id, title_key from ({_TEXT_SQL['q_title_norm']})),
 p as (select id, unnest(list_filter(['1' || u.url, '2' || a.content_hash, case when length(t.title_key) > 20 then '3' || t.title_key end], lambda x: x is not null)) as key from {A} a join u using (id) join t using (id)),
 m as (select id, hash(key) as h from p qualify count(*) over (partition by key) > 1), k as (select row_number() over (order by id) as i, id, list(h) as ks from m group by id),
 r(i, claimed, id) as (select 0::bigint, []::ubigint[], null::varchar union all select k.i, case when list_has_any(r.claimed, k.ks) then r.claimed else list_concat(r.claimed, k.ks) end, case when not list_has_any(r.claimed, k.ks) then k.id end from r join k on k.i = r.i + 1)
 select id from r where id is not null union all select id from {A} where id not in (select id from m)""")
def q_greedy_distinct(spark: SparkSession, d: str) -> DataFrame:
    return dedup.greedy_distinct(greedy_input(spark, d), "id", ["k1", "content_hash", "k3"]).select("id")


_MATCH = f"(select article_id, min(competitor_match) as m from {C} where competitor_match is not null group by 1)"
_CONCEPT = " union all ".join(f"select id, m, topic, '{k}' as concept from a where regexp_matches(t,'{_RX(v)}')" for k, v in CONCEPTS.items())


@query(f"""with recursive a as (select a.id, c.m, lower(coalesce(a.title,'')) as t, case {' '.join(f"when regexp_matches(coalesce(a.title,''),'{_RX(v)}') then '{k}'" for k, v in TOPICS.items() if k != 'savings')} else 'OTHER' end as topic from {A} a join {_MATCH} c on c.article_id = a.id),
 g as ({_CONCEPT}), e as (select distinct x.id a, y.id b from g x join g y on x.m = y.m and x.concept = y.concept and x.id <> y.id and (x.topic = 'OTHER' or y.topic = 'OTHER' or x.topic = y.topic) where x.topic = 'OTHER' or y.topic = 'OTHER'),
 w(n, c) as (select a, a from e union select e.b, w.c from w join e on e.a = w.n)
 select n as node, min(c) as component from w group by 1""")
def q_concept_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one competitor that share a concept, as components; against all pairs in the SQL."""
    m = _classes(spark, d).filter("competitor_match is not null").groupBy("article_id").agg(F.min("competitor_match").alias("competitor"))
    lexicon = {k: v for k, v in TOPICS.items() if k != "savings"}
    topic = F.coalesce(F.try_element_at(rules.topics(F.coalesce("title", F.lit("")), lexicon), F.lit(1)), F.lit("OTHER"))
    rows = _articles(spark, d).join(m, F.col("id") == F.col("article_id")).select(F.col("id").alias("node"), "competitor", F.lower(F.coalesce("title", F.lit(""))).alias("title"), topic.alias("topic"))
    edges = dedup.concept_edges(rows, CONCEPTS)
    return dedup.components(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), edges)


@query("""with recursive v as (select vec_id, embedding::double[] as x, (vec_id % 997) * 3600000000 * 12 as t from embeddings where vec_id % 50 > 0), e as (select p.vec_id a, q.vec_id b from v p join v q on p.vec_id <> q.vec_id and abs(p.t - q.t) <= 36::bigint * 3600000000 and round(list_cosine_similarity(p.x, q.x),9) >= 0.4),
 w(n, c) as (select a, a from e union select e.b, w.c from w join e on e.a = w.n) select n as node, min(c) as component from w group by 1
 union all select p.vec_id, p.vec_id from embeddings p where p.vec_id % 50 > 0 and not exists (select 1 from e where e.a = p.vec_id)""")
def q_vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors within 36 hours of one another (times are made up) and of a cosine of 0.4, as components."""
    v = table(spark, d, "embeddings").filter("vec_id % 50 > 0").select(F.col("vec_id").alias("node"), ((F.col("vec_id") % 997) * 12 * 3_600_000_000).alias("at_us"), F.col("embedding").alias("vector"))
    return dedup.components(v.select("node"), dedup.vector_links(v, 0.4))


@query(f"""select event_id, min(article_id) as first, count(*) as n from {L} group by 1""")
def q_group_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of their first members."""
    return dedup.group_order(_links(spark, d), "event_id", "article_id").groupBy("event_id", "first").agg(F.count("*").alias("n")).orderBy("first", "event_id")


# --- Joins and cubes that Spark adds -------------------------------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)""")
def q_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""select coalesce(c.c_nationkey, s.s_nationkey) as nation, c.n as customers, s.n as suppliers from (select c_nationkey, count(*) n from customer where c_nationkey % 3 <> 0 group by 1) c full join (select s_nationkey, count(*) n from supplier where s_nationkey % 2 = 0 group by 1) s on c.c_nationkey = s.s_nationkey""")
def q_full_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@query("""select n_name, count(o_orderkey) as orders from orders join customer on c_custkey = o_custkey and c_acctbal > 5000 right join nation on n_nationkey = c_nationkey group by 1""")
def q_right_join(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rich = o.join(c.filter("c_acctbal > 5000"), o["o_custkey"] == c["c_custkey"])
    return rich.join(n, rich["c_nationkey"] == n["n_nationkey"], "right").groupBy("n_name").agg(F.count("o_orderkey").alias("orders"))


@query("""select l_returnflag, true as near from lineitem group by 1""")
def q_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketch of distinct orders by flag is within a tenth of the exact number."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("about"), F.count_distinct("l_orderkey").alias("exact"))
    return g.select("l_returnflag", (F.abs(F.col("about") - F.col("exact")) <= F.col("exact") / 10).alias("near"))
