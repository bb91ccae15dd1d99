"""The best representative of each duplicate group: a latent two-sided quality model, then field-wise survivorship.

Whether a value of a field is true (usable for its group) is latent.  Two kinds of sources speak about it, each with a sensitivity
(how often it stands by a true value) and a specificity (how often it stands against an untrue one), all inferred by
expectation-maximisation:

* Witnesses are rules on the value alone; every value is told by all of them.  An untrue value is untrue for one reason, and each
  witness knows one reason, so the latent state is "true" or "untrue for reason i": specificity is that of a witness for its own
  reason.  EM needs the counts of witness patterns only, at most 2^WITNESSES a field.
* Publishers are the rows' own sources: a publisher claims the values of its rows and, by silence, denies the other values of the
  groups that it covers.  What each round sums are expectations by value, group and publisher.  Denials are not listed: a group's sum
  of denials plus, for each claim, what it changes, is the same and linear in the rows.  Publishers copy one another, so their
  evidence is averaged over the publishers of the group: a group of any size moves a value by a bounded amount.

The posterior joins both.  ``true_values`` keeps every value judged true, several of a field if need be; ``survivors`` takes, of the
rows whose value is judged true, the one of the best tier, then the latest.

Defined results: null and blank values are untrue; a group without a true value has no row for the field; ties in tier and time go to
the smallest event id; repeated rows are made distinct; events outside any group take no part; null group numbers neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encoding import SUSPECT, repair
from .lookalike import fold

FIELDS = ("canonical_title", "canonical_url", "canonical_source_name")
#: Words that stand in for a missing value.
STAND_INS = (
    "n/a|na|none|null|nil|nan|undefined|unknown|untitled|no title|test|tbd|default|feed|rss|www|admin|source|web|site|-+|\\?+|\\.+|loading|just a moment|page not found|404.*|403.*|500.*|access denied|error|sans titre|ohne titel|başlıksız|inconnu|unbekannt|"
    "بدون عنوان|بلا عنوان|غير معروف|غير محدد|بی‌عنوان|نامشخص"
)
#: Path steps that lead to no story.
NOT_STORIES = "(?:search|login|signin|sign-in|logout|register|account|subscribe|tag|tags|category|redirect|r|out|go|share|print|feed|rss)"
WITNESSES = 6
#: Characters of a title, at least.
SHORTEST = 20


def _bare(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(v, "(?U)^[\\s(\\[{<\"']+|[\\s)\\]}>\"'.…!]+$", "")))


def title_witnesses(v: Column, cut: Column) -> list[Column]:
    """Each is true where it accepts a title: says something, is no stand-in, is not cut by a mark, is readable, is of some
    length, and does not break off (``cut``: see ``broken_titles``)."""
    t = F.trim(v)
    return [
        F.length(F.regexp_replace(t, "[^\\p{L}]", "")) >= 3,
        ~_bare(v).rlike(f"(?iU)^(?:{STAND_INS})$"),
        ~t.rlike("(?:\\.\\.\\.|…|\\[\\.\\.\\.\\]|\\[…\\]|\\(\\.\\.\\.\\))$"),
        ~F.coalesce(garbled(v), F.lit(False)),
        F.length(t) >= SHORTEST,
        ~cut,
    ]


def url_witnesses(v: Column) -> list[Column]:
    """Each is true where it accepts a URL: absolute, a public host, a path below the root, a path of a story, no shortener or
    redirect, no query that leads elsewhere."""
    u = F.lower(F.trim(v))
    host = F.regexp_extract(u, "^https?://([^/?#:]+)", 1)
    path = F.regexp_extract(u, "^https?://[^/?#]+(/[^?#]*)?", 1)
    steps = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    return [
        u.rlike("^https?://[^\\s/?#]+"),
        host.rlike("^(?:[a-z0-9-]+\\.)+[a-z]{2,}$") & ~host.rlike("(?:^|\\.)(?:localhost|local|internal|test|invalid)$"),
        F.length(F.regexp_replace(path, "/", "")) > 0,
        ~path.rlike(f"^/{NOT_STORIES}(?:/|$)"),
        (steps >= 2) & ~host.rlike("^(?:go|l|t|r|click|link|out|redirect|track)\\."),
        ~u.rlike("[?&](?:u|url|next|goto|target|redirect|to|dest)=") & ~u.rlike("\\s"),
    ]


def name_witnesses(v: Column, begun: Column) -> list[Column]:
    """Each is true where it accepts a publisher's name: says something, is no stand-in, is no address, is not cut by a mark, has
    several words or is well known, and does not break off within another name (``begun``)."""
    t = F.trim(v)
    return [
        F.length(F.regexp_replace(t, "[^\\p{L}]", "")) >= 3,
        ~_bare(v).rlike(f"(?iU)^(?:{STAND_INS})$"),
        ~t.rlike("(?i)://|@|^www\\.|^[^\\s]+\\.[a-z]{2,}(?:/.*)?$"),
        ~t.rlike("(?:\\.\\.\\.|…)$"),
        ~F.coalesce(garbled(v), F.lit(False)),
        ~begun,
    ]


def garbled(v: Column) -> Column:
    """Whether a text is garbled; only suspects leave the JVM with their text."""

    @F.pandas_udf("boolean")
    def judge(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: repair(t)[1] if t is not None else None)

    return judge(F.when(v.rlike(SUSPECT), v)) & v.rlike(SUSPECT)


_TAIL = re.compile(r"\s+[-|–—]\s+[^-|–—]{3,40}$")
_EDGE = re.compile(r"^[\s\"'«“‘(\[]+|[\s.?؟!½\"'»”’)\]،,;:]+$")
_NUMBER = re.compile(r"[0-9]+(?:[.,٫٬][0-9]+)*")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
#: Words of context before the end of a title, longest first; and from which share of endings a context is one that ends titles.
CONTEXT, ENDS = (4, 3, 2, 1), 0.2


def _number(m: re.Match) -> str:
    """The shape of a number: how many digits, or that its groups are broken."""
    head, *groups = re.split("[.,٫٬]", m[0])
    whole = len(groups) > 1 or len(groups) == 1 and len(groups[0]) == 3
    return f"#{len(head) + sum(map(len, groups))}" if not groups or not whole or all(len(g) == 3 for g in groups) else "#broken"


def title_shape(title: str, names: dict[str, list[tuple[str, ...]]]) -> list[str]:
    """The words of a title with numbers and known names masked, without a publisher's name at the end."""
    t = _EDGE.sub("", _TAIL.sub("", _EDGE.sub("", fold(title)))).casefold().translate(_DIGITS)
    words = _NUMBER.sub(_number, t).split()
    out, i = [], 0
    while i < len(words):
        w = re.sub("['’]s?$|[,:]$", "", words[i])
        w = w if w in names else w[1:] if w[:1] == "و" and w[1:] in names else w
        for n in names.get(w, ()):
            if tuple(re.sub("['’]s?$|[,:]$", "", x) for x in words[i + 1 : i + len(n)]) == n[1:]:
                out.append("@")
                i += len(n)
                break
        else:
            out.append(words[i])
            i += 1
    return out


def known_names(competitors: DataFrame | None) -> dict[str, list[tuple[str, ...]]]:
    """Names of the register by their first word, longest first, and first words alone.  The register is a small dimension; it is
    read through a limit that is checked."""
    out: dict[str, set[tuple[str, ...]]] = {}
    if competitors is not None:
        rows = competitors.select("name", "aliases").limit(REGISTER + 1).collect()
        if len(rows) > REGISTER:
            raise ValueError(f"the register of names holds more than {REGISTER} rows")
        for r in rows:
            for n in (r.name, *(r.aliases or ())):
                words = tuple(fold(n or "").casefold().split())
                if words and len(words[0]) > 3:
                    out.setdefault(words[0], set()).update({words, words[:1]})
    return {k: sorted(v, key=lambda n: (-len(n), n)) for k, v in out.items()}


#: Rows of the register of names, at most.
REGISTER = 100_000


def broken_titles(values: DataFrame, corpus: DataFrame, names: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """(value): titles that break off without a mark.

    A title breaks off if it goes on in another title of its group, or if its last words are not words that titles end with: of
    all titles that hold them (numbers and names masked), fewer than ENDS end there.  The longest context that the corpus knows
    decides.  ``values``: group_no, value; ``corpus``: title.
    """
    v = values.filter("trim(value) != ''").select("group_no", F.trim("value").alias("value")).distinct()
    # A title that another one of its group begins with stands right before it in order, but for titles that it begins as well.
    # Both share their first letters, so even a hot group is sorted in many parts; shorter titles are useless anyway.
    w = Window.partitionBy("group_no", F.substring("value", 1, SHORTEST)).orderBy("value")
    rest = F.expr("substr(after, length(value) + 1)")
    goes_on = v.withColumn("after", F.lead("value").over(w)).filter(F.col("after").startswith(F.col("value")) & rest.rlike("^\\s?[\\p{L}\\p{N}]")).select("value")
    named = values.sparkSession.sparkContext.broadcast(names)
    deepest = CONTEXT[0]

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list[int]] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                shape = ["^"] * deepest + title_shape(t, named.value)
                for i in range(deepest, len(shape)):
                    for k in CONTEXT:
                        n = seen.setdefault((k, " ".join(shape[i - k + 1 : i + 1])), [0, 0])
                        n[i == len(shape) - 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([c for _, c in seen], pa.string()), *[pa.array([n[i] for n in seen.values()], pa.int64()) for i in (0, 1)]], ["k", "context", "within", "ends"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ks, cs = [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                shape = ["^"] * deepest + title_shape(t, named.value)
                for k in CONTEXT:
                    at.append(i)
                    ks.append(k)
                    cs.append(" ".join(shape[-k:]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ks, pa.int32()), pa.array(cs, pa.string())], ["value", "k", "context"])

    whole = corpus.filter("trim(title) != '' and not title rlike '(?:[.]{3}|…|\\\\])\\\\s*$'").select("title").distinct()
    known = whole.mapInArrow(endings, "k int, context string, within bigint, ends bigint").groupBy("k", "context").agg(F.sum("within").alias("within"), F.sum("ends").alias("ends"))
    own = v.select("value").distinct().mapInArrow(contexts, "value string, k int, context string")
    told = own.join(known.filter("within + ends >= 4"), ["k", "context"]).groupBy("value").agg(F.max(F.struct("k", (F.col("ends") / (F.col("ends") + F.col("within"))).alias("share"))).alias("best"))
    ends = own.select("value").distinct().join(told.filter(F.col("best.share") >= ENDS), "value", "left_anti")
    return goes_on.unionByName(ends.select("value")).distinct()


#: Means of the priors: witnesses pass true values, and see the reason they know.  They weigh as much as all rows together, 1000 at least.
PASSES, SEES = 0.999, 0.95


def fit(patterns: list[tuple[int, int]], witnesses: int = WITNESSES, rounds: int = 200) -> dict[int, float]:
    """Posterior that a value is true, by witness pattern (bit i: witness i accepts), from the counts of all patterns.

    States: true, and untrue for the reason that witness i knows.  Beta priors say that witnesses pass true values
    and see their own reason; what a witness says of the other reasons is free.
    """
    if not patterns:
        return {}
    no = 1.0 - np.array([[p >> i & 1 for i in range(witnesses)] for p, _ in patterns], float)
    n = np.array([c for _, c in patterns], float)
    # At first the reason is the one that the first rejecting witness knows; witnesses stand in order, the simplest first.
    z = np.eye(witnesses + 1)[np.where(no.any(axis=1), no.argmax(axis=1) + 1, 0)] + 0.01
    z /= z.sum(axis=1, keepdims=True)
    heavy = max(n.sum(), 1000.0)
    prior = np.ones((witnesses + 1, witnesses))  # of a rejection, by state and witness
    weight = np.full_like(prior, 2.0)
    prior[0], weight[0] = heavy * (1 - PASSES), heavy
    own = np.arange(witnesses)
    prior[own + 1, own], weight[own + 1, own] = heavy * SEES, heavy
    for _ in range(rounds):
        mass = z * n[:, None]
        share = (mass.sum(axis=0) + 1) / (n.sum() + witnesses + 1)
        rejects = (mass.T @ no + prior) / (mass.sum(axis=0)[:, None] + weight)
        log = np.log(share) + no @ np.log(rejects).T + (1 - no) @ np.log(1 - rejects).T
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - z).max() < 1e-9:
            break
        z = new
    return {p: float(v) for (p, _), v in zip(patterns, z[:, 0])}


def judged(events: DataFrame, groups: DataFrame, articles: DataFrame | None = None, competitors: DataFrame | None = None) -> DataFrame:
    """(group_no, event_id, tier, created_at, publisher, field, value, pattern): each grouped row's value of each field, with its
    witness pattern.  How titles end is taken from ``articles``, whose titles are whole (without it, from the events
    themselves); names of ``competitors`` are masked in them."""
    g = groups.filter("group_no is not null and event_id is not null").select("group_no", "event_id").distinct()
    e = events.filter("id is not null").select(F.col("id").alias("event_id"), *FIELDS, F.col("canonical_source_tier").alias("tier"), "created_at").dropDuplicates()
    rows = g.join(e, "event_id")
    corpus = events.select(F.col("canonical_title").alias("title")) if articles is None else articles.select("title")
    broken = broken_titles(rows.select("group_no", F.col("canonical_title").alias("value")), corpus, known_names(competitors)).select(F.col("value").alias("title_key"), F.lit(True).alias("cut"))
    names = rows.filter("trim(canonical_source_name) != ''").groupBy(F.trim("canonical_source_name").alias("name")).agg(F.count("*").alias("n"))
    # Names that go on another one share its first letters with it; shorter ones say nothing.
    w = Window.partitionBy(F.substring("name", 1, 3)).orderBy("name")
    begun = names.withColumn("after", F.lead("name").over(w)).filter(F.col("after").startswith(F.col("name")) & (F.col("after") != F.col("name"))).select(F.col("name").alias("name_key"), F.lit(True).alias("begun"))
    rows = rows.withColumn("title_key", F.trim("canonical_title")).withColumn("name_key", F.trim("canonical_source_name"))
    rows = rows.join(broken, "title_key", "left").join(begun, "name_key", "left")
    no = F.lit(False)
    said = {
        "canonical_title": title_witnesses(F.col("canonical_title"), F.coalesce("cut", no)),
        "canonical_url": url_witnesses(F.col("canonical_url")),
        "canonical_source_name": name_witnesses(F.col("canonical_source_name"), F.coalesce("begun", no)),
    }
    pattern = lambda f: sum((F.when(F.coalesce(c, no), 1 << i).otherwise(0) for i, c in enumerate(said[f])), F.lit(0))
    rows = rows.select("group_no", "event_id", "tier", "created_at", F.col("canonical_source_name").alias("publisher"), *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), pattern(f).alias("pattern")).alias(f"s_{f}") for f in FIELDS])
    return rows.select("group_no", "event_id", "tier", "created_at", "publisher", F.inline(F.array(*[F.col(f"s_{f}") for f in FIELDS]))).filter("trim(value) != ''")


#: Rounds of EM over the publishers, and the prior counts of (claims, denials) of a publisher for true and for untrue values.
ROUNDS, TRUE_PRIOR, UNTRUE_PRIOR = 2, (5.0, 5.0), (2.0, 8.0)

_FACT = ["group_no", "field", "v"]
_GROUP = ["group_no", "field"]


def posteriors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(group_no, field, v, p): how sure it is that a value is true; ``v`` is the 64-bit hash of the trimmed value within its group
    and field.  ``rows``: as of ``judged``, written.
    """
    from ..context import cut

    counts: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("field", "pattern").count().collect():  # at most 2^WITNESSES rows a field
        counts.setdefault(r.field, []).append((r["pattern"], r["count"]))
    told = {(f, p): v for f, ps in counts.items() for p, v in fit(ps).items()}
    odds = F.lit(-30.0)
    if told:
        odds = F.try_element_at(F.create_map(*[F.lit(x) for (f, p), v in told.items() for x in (f"{f}|{p}", float(np.clip(np.log(v / max(1 - v, 1e-13)), -30, 30)) if v > 0 else -30.0)]), F.concat_ws("|", "field", F.col("pattern").cast("string")))
    publisher = F.lower(F.trim(F.coalesce("publisher", F.lit(""))))
    claims = cut(rows.select(*_GROUP, F.xxhash64(F.trim("value")).alias("v"), odds.alias("odds"), F.xxhash64("field", publisher).alias("s")).groupBy(*_FACT, "s").agg(F.min("odds").alias("odds")))
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    facts = claims.groupBy(*_FACT).agg(F.min("odds").alias("odds")).withColumn("p", sigmoid(F.col("odds")))
    cover = claims.select(*_GROUP, "s").distinct()
    for _ in range(rounds):
        p, q = F.sum("p"), F.sum(1 - F.col("p"))
        groups = facts.groupBy(*_GROUP).agg(p.alias("t"), q.alias("u"))
        all_ = cover.join(groups, _GROUP).groupBy("s").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
        own = claims.select(*_FACT, "s").join(facts.select(*_FACT, "p"), _FACT).groupBy("s").agg(p.alias("ct"), q.alias("cu"))
        sens = (F.col("ct") + TRUE_PRIOR[0]) / (F.col("t") + sum(TRUE_PRIOR))
        slip = (F.col("cu") + UNTRUE_PRIOR[0]) / (F.col("u") + sum(UNTRUE_PRIOR))
        denies = F.log((1 - sens) / (1 - slip))
        quality = cut(all_.join(own, "s").select("s", denies.alias("denies"), (F.log(sens / slip) - denies).alias("claims")))
        base = cover.join(quality, "s").groupBy(*_GROUP).agg(F.sum("denies").alias("base"), F.count("*").alias("n"))
        said = claims.join(quality, "s").groupBy(*_FACT).agg(F.min("odds").alias("odds"), F.sum("claims").alias("said"))
        facts = cut(said.join(base, _GROUP).select(*_FACT, "odds", sigmoid(F.col("odds") + (F.col("base") + F.col("said")) / F.col("n")).alias("p")))
    return facts.select(*_FACT, "p")


def _told(events: DataFrame, groups: DataFrame, articles: DataFrame | None, competitors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(judged rows with ``v``, posteriors)."""
    from ..context import cut

    rows = cut(judged(events, groups, articles, competitors))
    return rows.withColumn("v", F.xxhash64(F.trim("value"))), posteriors(rows)


def true_values(events: DataFrame, groups: DataFrame, articles: DataFrame | None = None, competitors: DataFrame | None = None) -> DataFrame:
    """(group_no, field, value, p, rows): every value of each group and field that is judged true; a field may keep several."""
    rows, p = _told(events, groups, articles, competitors)
    values = rows.groupBy(*_FACT).agg(F.min(F.trim("value")).alias("value"), F.count("*").alias("rows"))
    return values.join(p.filter("p >= 0.5"), _FACT).select("group_no", "field", "value", F.round("p", 6).alias("p"), "rows")


def survivors(events: DataFrame, groups: DataFrame, articles: DataFrame | None = None, competitors: DataFrame | None = None) -> DataFrame:
    """(group_no, field, event_id): for each group and field the row that supplies it, of the values judged true the one of the best
    tier, then the latest.  One aggregation by value and one by group; no group is collected."""
    rows, p = _told(events, groups, articles, competitors)
    key = F.struct(F.coalesce("tier", F.lit(2**31 - 1)).alias("tier"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "event_id")
    # The best row of each value first: a hot group is reduced before it meets the posteriors.
    best = rows.groupBy(*_FACT).agg(F.min(key).alias("best")).join(p.filter("p >= 0.5"), _FACT).groupBy(*_GROUP).agg(F.min("best").alias("best"))
    return best.select("group_no", "field", F.col("best.event_id").alias("event_id"))
