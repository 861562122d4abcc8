"""URL filters: rules first, then trust and distrust along the host graph.

A page's url gets the longest rule that fits.  For the rest, hosts are judged
by link propagation: personalised PageRank from trusted hosts (those with
pages that a rule allows, by their number) along links, and the same from
blocked hosts along reversed links, so that who links to blocked hosts gathers
distrust.  A host whose distrust exceeds ``ratio`` times its trust is blocked.

Edges between hosts are the links in the pages' HTML, counted per pair of
hosts before any shuffle of single links, plus a link between each host and
the domain above it, by which subdomains of one site share their standing
(not across registries such as co.uk).  Everything is DataFrame expressions;
each round joins the scores with an edge table of one row per pair of hosts,
and scores are checkpointed.  Rounds go on until what can still move is at
most ``tolerance`` of the seeds' weight.

Urls that are null or lack ``://`` have an empty host and path: no rule fits,
the host has no links and is allowed.  Null html has no links.  Repeated rows
count again as seeds.  Very long html is read whole.  Empty tables give empty results; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
#: Weight of the link between a host and the domain above it, in links.
PARENT_LINKS = 1.0
#: Labels that registries put before a country's domain, so that the domain above is nobody's site.
REGISTRY = r"^(ac|co|com|edu|gob|go|gov|gouv|ltd|me|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$"
#: A host with more than one in this many pages is joined apart.
HOT_SHARE = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules are configuration, not data."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, links: one row for each pair of different hosts."""
    src, _ = host_and_path(F.col(url))
    linked = pages.select(src.alias("src"), F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)).alias("to"))
    links = linked.select("src", F.explode("to").alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))
    hosts = pages.select(src.alias("host")).filter("host <> ''").distinct()
    above = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).filter((F.col("parent") != "") & ~F.col("parent").rlike(REGISTRY))
    up = above.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(PARENT_LINKS).alias("links"))
    down = above.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(PARENT_LINKS).alias("links"))
    return links.union(up).union(down).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def rounds_for(tolerance: float, damping: float) -> int:
    """Rounds after which the scores' total change stays under ``tolerance``: it is at most 2 * damping**rounds."""
    return max(1, math.ceil(math.log(tolerance / 2) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 0.01, damping: float = 0.85) -> DataFrame:
    """host, trust, distrust: personalised PageRank both ways.

    ``seeds``: host, trusted, blocked (weights).  A host without onward links
    passes nothing on, so scores sum to one at most; handing its weight back to
    the seeds would scale all scores of a kind alike.
    """
    rounds = rounds_for(tolerance, damping)
    shared_dir(edges.sparkSession)
    ahead = edges.join(edges.groupBy("src").agg(F.sum("links").alias("n")), "src").select(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("links") / F.col("n")).alias("w"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("links").alias("n")), "dst").select(F.lit(1).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("links") / F.col("n")).alias("w"))
    moves = ahead.union(back).checkpoint()
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = seeds.select(F.lit(0).alias("kind"), F.col("host").alias("at"), (F.col("trusted") / F.lit(float(total["t"] or 1))).alias("r")).union(
        seeds.select(F.lit(1), F.col("host"), F.col("blocked") / F.lit(float(total["b"] or 1)))
    )
    start = start.filter("r > 0").checkpoint()
    now = start
    for k in range(rounds):
        flow = now.join(moves, ["kind", "at"]).select("kind", F.col("to").alias("at"), (F.col("r") * F.col("w") * damping).alias("r"))
        now = flow.union(start.select("kind", "at", (F.col("r") * (1 - damping)).alias("r"))).groupBy("kind", "at").agg(F.sum("r").alias("r"))
        if k % 5 == 4:
            now = now.checkpoint()
    return now.groupBy(F.col("at").alias("host")).agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], tolerance: float = 0.01, damping: float = 0.85, ratio: float = 1.0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust for every page."""
    host, path = host_and_path(F.col(url))
    rule, says = _rule(rules, F.col("host"), F.col("path"))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_uf_says": says})
    seeds = judged.filter("host <> '' and rule is not null").groupBy("host").agg(F.count(F.when(F.col("_uf_says") == "allow", 1)).cast("double").alias("trusted"), F.count(F.when(F.col("_uf_says") == "block", 1)).cast("double").alias("blocked"))
    scores = propagate(host_edges(pages, url, html), materialize(seeds, "url-seeds"), tolerance, damping)
    # Hosts with over a thousandth of all pages: fewer than a thousand, so their scores are broadcast and
    # their pages, dealt out by id, take no part in the join with the other hosts' scores.
    counts = materialize(judged.groupBy("host").agg(F.count("*").alias("n")), "url-hosts")
    pages_seen = int(counts.agg(F.sum("n").alias("n")).first()["n"] or 0)
    hot = counts.filter(F.col("n") * HOT_SHARE > pages_seen).select("host").join(scores, "host", "left")
    hot = hot.select("host", F.lit(True).alias("_uf_hot"), F.col("trust").alias("_uf_trust"), F.col("distrust").alias("_uf_distrust"))
    dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(id_col), F.lit(4096)).cast("string"))
    keyed = judged.join(F.broadcast(hot), "host", "left").withColumn("_uf_key", F.when(F.col("_uf_hot"), dealt).otherwise(F.col("host")))
    found = keyed.join(scores.withColumnRenamed("host", "_uf_key"), "_uf_key", "left")
    trust, distrust = F.coalesce("trust", "_uf_trust", F.lit(0.0)), F.coalesce("distrust", "_uf_distrust", F.lit(0.0))
    return found.select(
        F.col(id_col), "host", "path", "rule",
        F.coalesce("_uf_says", F.when(distrust > trust * ratio, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )


def oracle(rules: list[tuple[str, str]], tolerance: float = 0.01, damping: float = 0.85, ratio: float = 1.0) -> str:
    """The same verdicts in DuckDB SQL over ``pages`` (scores left out)."""
    ranked, rounds = sorted(rules, key=lambda r: (-len(r[0]), r[0])), rounds_for(tolerance, damping)
    fits = {t: f"((host = '{t.partition('/')[0]}' or suffix(host, '.{t.partition('/')[0]}')) and prefix(path, '/{t.partition('/')[2]}'))" for t, _ in ranked}
    case = lambda value: "case " + " ".join(f"when {fits[r[0]]} then '{value(r)}'" for r in ranked) + " end"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    steps = "".join(
        f""", r{k + 1} as (select kind, spot, sum(r) r from (
            select kind, goal spot, r * w * {damping} r from r{k} join moves using (kind, spot)
            union all select kind, spot, r * {1 - damping} from r0) group by kind, spot)"""
        for k in range(rounds)
    )
    return f"""
    with split as (select page_id, html, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end after from pages),
    parts as (select page_id, html, translate(regexp_extract(coalesce(after, ''), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') host, regexp_extract(coalesce(after, ''), '^[^/?#]*([^?#]*)', 1) path from split),
    judged as (select page_id, html, host, path, {case(lambda r: r[0])} rule, {case(lambda r: r[1])} says from parts),
    seeds as (select host, count(*) filter (says = 'allow') t, count(*) filter (says = 'block') b from judged where host <> '' and rule is not null group by host),
    links as (select src, translate(d, '{UPPER}', '{LOWER}') dst from (select host src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) d from parts)),
    above as (select * from (select distinct host, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) parent from parts where host <> '') where not regexp_matches(parent, '{REGISTRY}')),
    edges as (select src, dst, sum(n) links from (
        select src, dst, 1.0::double n from links where src <> '' and dst <> '' and src <> dst
        union all select host, parent, {PARENT_LINKS}::double from above where parent <> ''
        union all select parent, host, {PARENT_LINKS}::double from above where parent <> '') group by src, dst),
    moves as (select 0 kind, src spot, dst goal, links / sum(links) over (partition by src) w from edges
        union all select 1, dst, src, links / sum(links) over (partition by dst) from edges),
    r0 as (select 0 kind, host spot, t / (select sum(t) from seeds) r from seeds where t > 0 union all select 1, host, b / (select sum(b) from seeds) from seeds where b > 0)
    {steps},
    scores as (select spot host, coalesce(sum(r) filter (kind = 0), 0) trust, coalesce(sum(r) filter (kind = 1), 0) distrust from r{rounds} group by spot)
    select page_id, host, path, rule, coalesce(says, case when distrust > trust * {ratio} then 'block' else 'allow' end) verdict
    from judged left join scores using (host)"""
