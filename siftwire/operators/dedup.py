"""Greedy distinct, connected components, event clustering, canonical choice."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import cut
from ..functions import arrays, text


#: Rounds after which what is left of long chains of conflicts is finished by component; rows of a component that one task finishes.
ROUNDS, COMPONENT = 6, 1_000_000


def greedy_distinct(rows: DataFrame, seq: str, keys: list[str], rounds: int = ROUNDS, largest: int = COMPONENT) -> DataFrame:
    """The rows that a scan in order of ``seq`` keeps when it drops every row of which any key was claimed by a kept row.

    ``seq`` is unique; null keys claim nothing.  In each round, a row that comes first among the undecided for all its keys is
    kept, and the rows that share a key with a kept one before them are dropped: every chain of conflicts gets shorter at once.
    What ``rounds`` rounds leave are long chains.  Rows that no key connects cannot conflict, so each connected component of up to
    ``largest`` undecided rows is scanned in order by one task; larger ones go on in rounds, however many they need.
    """
    slim = cut(rows.select(F.col(seq).alias("seq"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    # One row per (key, row): a hot key is min-aggregated per task before it is shuffled.
    claims = cut(slim.select("seq", F.posexplode(F.array(*[F.col(f"k{i}").cast("string") for i in range(len(keys))])).alias("which", "key")).filter("key is not null"))
    kept = slim.join(claims, "seq", "left_anti").select("seq")
    open_, done = claims, 0
    while True:
        first = open_.groupBy("which", "key").agg(F.min("seq").alias("first"))
        state = open_.join(first, ["which", "key"]).groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("first")).alias("leads"))
        won = cut(state.filter("leads").select("seq"))
        if won.isEmpty():
            return rows.join(kept.select(F.col("seq").alias(seq)), seq, "left_semi")
        kept = kept.unionByName(won)
        taken = open_.join(won, "seq", "left_semi").select("which", "key").distinct()
        lost = open_.join(taken, ["which", "key"], "left_semi").select("seq").distinct()
        open_ = cut(open_.join(lost, "seq", "left_anti"))
        done += 1
        if done % rounds == 0 and not open_.isEmpty():
            scanned, open_ = _scanned(open_, largest)
            kept = kept.unionByName(scanned)


def _scanned(open_: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """(seq kept, what is still open): every component of at most ``largest`` undecided rows scanned in order."""
    first = open_.groupBy("which", "key").agg(F.min("seq").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = open_.join(first, ["which", "key"]).select(F.col("seq").alias("src"), "dst").filter("src != dst")
    c = components(open_.select(F.col("seq").alias("node")).distinct(), edges)
    small = cut(c.join(c.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= largest), "component").select(F.col("node").alias("seq"), "component"))
    kind = open_.schema["seq"].dataType.simpleString()

    def scan(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        claimed, kept = set(), []
        for seq, own in pdf.sort_values("seq", kind="stable").groupby("seq", sort=False):
            claims = set(zip(own.which, own.key))
            if claimed.isdisjoint(claims):
                claimed |= claims
                kept.append(seq)
        return pd.DataFrame({"seq": kept})

    scanned = cut(open_.join(small, "seq").groupBy("component").applyInPandas(scan, f"seq {kind}"))
    return scanned, cut(open_.join(small.select("seq"), "seq", "left_anti"))


def star_edges(rows: DataFrame, node: str, key: Column) -> DataFrame:
    """(src, dst): each row linked with the first row of its key, never all pairs of a group."""
    keyed = rows.select(F.col(node).alias("src"), key.alias("key")).filter("key is not null and key != ''")
    centre = keyed.groupBy("key").agg(F.min("src").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(centre, "key").filter("src != dst").select("src", "dst").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node is connected with.

    Alternating large-star and small-star steps: each node's neighbours are linked with its smallest one, so that paths halve and
    the rounds grow with the logarithm of the longest path.  Stars that are no longer changed have as many edges and the same sum of
    hashes as before.  ``nodes``: node; ``edges``: src, dst.
    """
    e = cut(edges.filter("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == seen:
            return nodes.join(e.select(F.col("a").alias("node"), "b"), "node", "left").groupBy("node").agg(F.coalesce(F.min("b"), F.first("node")).alias("component"))
        seen = now


#: Rows of one side of a comparison, at most; a time bucket with more is split into sub-blocks that meet pairwise.
BLOCK = 1000
#: The bucket of what has no time.
_NO_TIME = -(2**62)


def meetings(rows: DataFrame, first: str, last: str, hours: int) -> DataFrame:
    """``rows`` once for each comparison (tb, ti, tj) that they take part in, with their side in it: 0 and 1, or 2 where a sub-block meets
    itself.  Rows whose times (``first`` to ``last``, within one bucket of ``hours``) may be within ``hours`` meet once; rows without a
    time meet all.  No comparison holds more than two sub-blocks of about BLOCK rows.
    """
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col(first) / (hours * 3_600_000_000)), F.lit(_NO_TIME)))
    size = cut(rows.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("s")))
    own, before, after = size, size.select((F.col("b") + 1).alias("b"), F.col("s").alias("sp")), size.select((F.col("b") - 1).alias("b"), F.col("s").alias("sn"))
    timeless = F.col("b") == _NO_TIME
    n = size.agg(F.coalesce(F.sum(F.when(timeless, F.col("s"))), F.lit(0)).alias("none"), F.coalesce(F.sum(F.when(~timeless, F.col("s"))), F.lit(0)).alias("some")).first()
    spread = F.xxhash64(F.lit("meeting"), *[c for c in rows.columns if c != "b"])
    rows = rows.join(own, "b").join(before, "b", "left").join(after, "b", "left").withColumn("i", F.pmod(spread, F.col("s")).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n.isNotNull() & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(none)
    place = lambda b, i, j, side: F.struct(b.alias("tb"), i.cast("int").alias("ti"), j.cast("int").alias("tj"), F.lit(side).alias("side"))
    b, i = F.col("b"), F.col("i")
    places = [
        # Same bucket: sub-blocks x <= y, coded as (b, x, y).
        F.transform(upto(F.col("s")), lambda j: F.struct(b.alias("tb"), F.least(i, j).alias("ti"), F.greatest(i, j).alias("tj"), F.when(i < j, 0).when(i > j, 1).otherwise(2).alias("side"))),
        # This bucket with the one before: (b, i, -1 - j).
        F.transform(upto(F.col("sp")), lambda j: place(b, i, -1 - j, 0)),
        F.transform(upto(F.col("sn")), lambda j: place(b + 1, j, -1 - i, 1)),
    ]
    if n.none and n.some:  # what has no time with all that has one
        mine = F.pmod(spread, F.lit(int(n.some))).cast("int")
        places.append(F.when(timeless, F.transform(upto(F.lit(int(n.some))), lambda j: place(b, i, -1 - j, 0))).otherwise(F.transform(upto(F.lit(int(n.none))), lambda j: place(F.lit(_NO_TIME), j, -1 - mine, 1))))
    return rows.select(*[c for c in rows.columns if c not in ("b", "s", "sp", "sn", "i")], F.inline(F.concat(*places)))


def _near(first, last, x: int, other, step: int):  # noqa: ANN001, ANN202
    """Whether spans of time come within ``step``; what has no time is near all."""
    import numpy as np

    gap = np.maximum(first[other] - last[x], first[x] - last[other])
    return ~(gap > step)


def fuzzy_links(rows: DataFrame, threshold: int = 85, loose: int = 68, hours: int = 36) -> DataFrame:
    """(src, dst): links between rows within ``hours`` whose titles have a token-sort ratio of ``threshold``, or of ``loose`` with
    overlapping entities, unless their topics differ; enough of them to connect all rows that are so linked.

    Rows of one bucket of time with equal title, topic and entities are linked as a star first and compared as one, so copies cost
    nothing however many they are.  The distance of the bags of characters is a lower bound of the indel distance, and a common bit
    of the entities' hashes is a condition of overlap; both are computed for whole blocks at once, and what they leave is compared
    exactly.  Nothing is lost.  Rows without a time are within reach of all.  ``rows``: node, at_us, title, topic, entities.
    """
    step = hours * 3_600_000_000
    known = F.array_sort(F.array_distinct(F.transform(F.coalesce("entities", F.array().cast("array<string>")), F.lower)))
    rows = rows.filter("title != ''").select("node", "at_us", "title", "topic", known.alias("entities"), F.floor(F.col("at_us") / step).alias("bucket"))
    like = ["bucket", "title", "topic", "entities"]
    units = cut(rows.groupBy(*like).agg(F.min("node").alias("rep"), F.min("at_us").alias("t0"), F.max("at_us").alias("t1"), F.count("*").alias("n")))
    many = units.filter("n > 1").select(*like, "rep")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}")) for c in like]
    stars = rows.alias("r").join(many.alias("u"), reduce(lambda a, b: a & b, same)).select(F.col("r.node").alias("src"), F.col("u.rep").alias("dst")).filter("src != dst")
    tasks = meetings(units.select("rep", "t0", "t1", "title", "topic", "entities"), "t0", "t1", hours)
    kind = rows.schema["node"].dataType.simpleString()

    def compare(pdf):  # noqa: ANN001, ANN202
        import zlib

        import numpy as np
        import pandas as pd

        pdf = pdf.reset_index(drop=True)
        sorted_ = [" ".join(sorted(re.sub(r"\W+", " ", t.lower()).split())) for t in pdf.title]
        length = np.array([len(t) for t in sorted_])
        bag = np.zeros((len(pdf), 64), np.int16)
        for k, t in enumerate(sorted_):
            np.add.at(bag[k], np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, 1)
        entity = [frozenset(es) for es in pdf.entities]
        bits = np.array([sum({1 << (zlib.crc32(e.encode("utf-8", "surrogatepass")) & 63) for e in es}) for es in entity], np.uint64)
        first, last = pdf.t0.to_numpy(float), pdf.t1.to_numpy(float)
        topic, side = pdf.topic.tolist(), pdf.side.to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        root = list(range(len(pdf)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x in left:
            other = right[right > x] if side[x] == 2 else right
            if not len(other) or not length[x]:
                continue
            both = (length[x] + length[other]) / 100
            apart = np.abs(bag[other] - bag[x]).sum(axis=1)
            near = (apart <= (100.5 - threshold) * both) | (apart <= (100.5 - loose) * both) & ((bits[other] & bits[x]) != 0)
            near &= _near(first, last, x, other, step)
            for y in other[near]:
                rx, ry = find(int(x)), find(int(y))
                if rx == ry or topic[x] != topic[y] and "OTHER" not in (topic[x], topic[y]):
                    continue
                r = text.token_sort_ratio(sorted_[x], sorted_[y])
                if r < threshold:
                    a, c = entity[x], entity[y]
                    if r < loose or not a or not c or len(a & c) < max(1, min(len(a), len(c)) // 2):
                        continue
                root[rx] = ry
                out.append((pdf.rep[x], pdf.rep[y]))
        return pd.DataFrame(out, columns=["src", "dst"])

    return stars.unionByName(tasks.groupBy("tb", "ti", "tj").applyInPandas(compare, f"src {kind}, dst {kind}"))


def vector_links(rows: DataFrame, least: float = 0.88, hours: int = 36) -> DataFrame:
    """(src, dst): links between rows within ``hours`` whose vectors have a cosine of ``least``, enough to connect all that are so linked.

    Whole blocks are multiplied at once; every pair within reach is compared, none is listed but those that connect.  Null and zero
    vectors match nothing; rows without a time are within reach of all.  ``rows``: node, at_us, vector.
    """
    rows = rows.filter("vector is not null").select("node", "at_us", "vector")
    kind, step = rows.schema["node"].dataType.simpleString(), hours * 3_600_000_000

    def compare(pdf):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        v = np.stack(pdf.vector.to_list()).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        at, side, node = pdf.at_us.to_numpy(float), pdf.side.to_numpy(), pdf.node.to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        close = np.round(v[left] @ v[right].T, 9) >= least
        root = list(range(len(pdf)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in np.flatnonzero(close.any(axis=1)):
            x = int(left[i])
            hit = right[close[i]]
            for y in hit[_near(at, at, x, hit, step)]:
                rx, ry = find(x), find(int(y))
                if rx != ry:
                    root[rx] = ry
                    out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["src", "dst"])

    return meetings(rows, "at_us", "at_us", hours).groupBy("tb", "ti", "tj").applyInPandas(compare, f"src {kind}, dst {kind}")


def concept_edges(rows: DataFrame, concepts: dict[str, tuple[str, ...]]) -> DataFrame:
    """(src, dst): rows of one competitor whose titles share a concept, a set of terms in any language.

    Different topics part two rows, OTHER parts none: the star's centre is the first row of the topic OTHER, which may be linked with every
    other.  Where a group has none, only rows of one topic could be linked, and their topic links them.  ``rows``: node, competitor,
    title, topic.
    """
    from . import rules

    keyed = rows.filter("competitor is not null").select("node", "competitor", "topic", F.explode(rules.topics(F.col("title"), concepts)).alias("concept"))
    centre = keyed.filter("topic = 'OTHER'").groupBy("competitor", "concept").agg(F.min("node").alias("dst"))
    return keyed.join(centre, ["competitor", "concept"]).select(F.col("node").alias("src"), "dst").filter("src != dst").distinct()


def event_clusters(rows: DataFrame, threshold: int = 85, loose: int = 68, hours: int = 36, generic: tuple[str, ...] = (), concepts: dict[str, tuple[str, ...]] | None = None, vectors: DataFrame | None = None, least: float = 0.88) -> DataFrame:
    """(node, component): reports of one happening.

    ``rows``: node, url_key, content_hash, topic ("OTHER" for none), at_us, title (normalised), entities, and with ``concepts`` also
    competitor (null unless the report is about one).  Edges: equal URL keys; equal hashes; equal topics other than OTHER;
    ``concept_edges``; ``fuzzy_links``; and, with ``vectors`` (node, vector), ``vector_links`` between rows of the topic OTHER.
    ``generic`` entities do not count.
    """
    rows = cut(rows)  # read once for each kind of edge
    edges = [star_edges(rows, "node", F.col("url_key")), star_edges(rows, "node", F.col("content_hash")), star_edges(rows, "node", F.when(F.col("topic") != "OTHER", F.col("topic")))]
    if concepts:
        edges.append(concept_edges(rows.select("node", "competitor", "title", "topic"), concepts))
    told = rows.withColumn("entities", arrays.without(F.col("entities"), list(generic))) if generic else rows
    edges.append(fuzzy_links(told.select("node", "at_us", "title", "topic", "entities"), threshold, loose, hours))
    if vectors is not None:
        edges.append(vector_links(rows.filter("topic = 'OTHER'").join(vectors, "node").select("node", "at_us", "vector"), least, hours))
    return components(rows.select("node").distinct(), reduce(DataFrame.unionByName, edges))


def group_order(members: DataFrame, group: str, seq: str) -> DataFrame:
    """``members`` with ``first``, the smallest ``seq`` of their group: groups in the order of their first members are sorted by it."""
    return members.join(members.groupBy(group).agg(F.min(seq).alias("first")), group)


def canonical_pick(rows: DataFrame, group: str) -> DataFrame:
    """The representative of each ``group``: enough content first, then English, tier, length, date, and the first id.

    A minimum of a struct: partial per task, so a hot group costs no skew.  ``rows``: id, english, tier, content, at_us.
    """
    n = F.length(F.coalesce("content", F.lit("")))
    key = F.struct((n < 80).alias("short"), (~F.coalesce("english", F.lit(False))).alias("foreign"), F.coalesce("tier", F.lit(9)).alias("tier"), (-n).alias("shorter"), (-F.coalesce("at_us", F.lit(0))).alias("older"), F.col("id").alias("id"))
    return rows.groupBy(group).agg(F.min(key).alias("best"), F.count("*").alias("members")).select(group, F.col("best.id").alias("id"), "members")


def provenance(members: DataFrame, official: list[str], reputable: list[str]) -> DataFrame:
    """(event_id, status, source): OFFICIAL by an official host or a first-tier canonical row, VERIFIED by a reputable host or
    tier 2, else UNVERIFIED; the source is the first member (by seq) that says so.  ``members``: event_id, seq, url, tier,
    event_tier, event_url."""
    from ..functions.urls import contains_any

    first = lambda cond: F.min(F.when(cond, F.struct("seq", "url")))["url"]
    g = members.groupBy("event_id").agg(
        first(contains_any(F.col("url"), official)).alias("official"),
        first((F.col("tier") <= 2) | contains_any(F.col("url"), reputable)).alias("verified"),
        F.min("event_tier").alias("event_tier"),
        F.min("event_url").alias("event_url"),
    )
    status = F.when(F.col("official").isNotNull() | (F.col("event_tier") == 1), "OFFICIAL").when(F.col("verified").isNotNull(), "VERIFIED").otherwise("UNVERIFIED")
    source = F.when(F.col("official").isNotNull(), F.col("official")).when(F.col("event_tier") == 1, F.col("event_url")).otherwise(F.col("verified"))
    return g.select("event_id", status.alias("status"), source.alias("source"))
