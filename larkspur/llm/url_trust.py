"""URL filter by rules, then by trust and distrust propagated over the host graph.

Hosts are linked by the absolute links of their pages. Trust is a personalised
PageRank from hosts with pages that a rule allows; distrust is the same on
reversed links from hosts with pages that a rule blocks, so that it reaches who
links to them. Such masses are divided among all who link to a host, so that
verdicts rest on shares instead: how much of what links to a host is trusted,
and how much of its own links leads, directly or onwards, to blocked pages.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host with over 1 / HEAVY of the pages (there are fewer than HEAVY such) is dealt into SALTS parts for the last join.
HEAVY, SALTS = 1000, 64
#: The links of a host with at least HUB_LINKS of them, one way, are dealt into HUB_PARTS parts by their other end.
HUB_LINKS, HUB_PARTS = 100_000, 64
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, rounds: int) -> DataFrame:
    """(kind, host, mass): (1 - damping) * seed + damping * what links bring, for each kind of mass apart.

    edges: kind, src, dst, share (the shares of a src sum to 1 where mass is
    divided, those of a dst where it is averaged); seeds: kind, host, seed.
    Mass that reaches a host without links ends there. Rounds end
    when the masses change by less than tolerance in sum.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part")
    hubs = edges.groupBy("kind", "src").agg(F.count("*").alias("n")).where(F.col("n") >= HUB_LINKS).select("kind", "src", F.lit(True).alias("hub")).checkpoint()
    dealt = F.when(F.coalesce("hub", F.lit(False)), F.pmod(F.xxhash64("dst"), F.lit(HUB_PARTS)).cast("int")).otherwise(0)
    edges = edges.join(hubs, ["kind", "src"], "left").select("kind", "src", dealt.alias("part"), "dst", "share").checkpoint()
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("base"))
    mass = start.select("kind", "host", F.col("base").alias("mass")).checkpoint()
    for _ in range(rounds):
        held = mass.select("kind", F.col("host").alias("src"), "mass").join(hubs, ["kind", "src"], "left")
        held = held.where("hub is null").select("kind", "src", F.lit(0).alias("part"), "mass").unionByName(held.where("hub").select("kind", "src", parts, "mass"))
        brought = edges.join(held, ["kind", "src", "part"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("share") * F.col("mass")) * damping).alias("mass"))
        both = start.select("kind", "host", F.col("base").alias("mass")).unionByName(brought)
        new = both.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).checkpoint()
        change = new.unionByName(mass.select("kind", "host", (-F.col("mass")).alias("mass"))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("d"))
        total = change.agg(F.coalesce(F.sum("d"), F.lit(0.0)), F.coalesce(F.max("d"), F.lit(0.0))).first()
        mass = new
        if total[1] < tolerance:
            break
    return mass


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, threshold: float = 0.5, tolerance: float = 1e-6, rounds: int = 30) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, leads, vouched) for every page.

    A url without ``://``, or null, has an empty host and path. A host's seeds
    are the shares of its pages that rules allow and block. Where no rule fits,
    the host decides: leads is the share of its pages that is blocked plus the
    damped mean of leads over its links, vouched the share of its pages that is
    allowed plus the damped mean of vouched over the links that reach it. The
    host's pages are blocked if leads exceeds vouched by over threshold: with
    one half and nothing that vouches, if its links go to blocked pages only,
    at up to four links' distance. Both are
    averages over links, so that it doesn't count how many others link alike,
    as it would for trust and distrust, whose mass is divided among them. Null
    pages have no links; null and repeated ids keep their rows; an empty table
    gives no row; other columns are not read.
    """
    spark = C.prepare(pages.sparkSession)
    C.shared_dir(spark)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    of_host = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    of_host = of_host.where("host <> ''").select("host", "n", (F.col("allowed") / F.col("n")).alias("trusted"), (F.col("blocked") / F.col("n")).alias("blamed")).checkpoint()

    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")).checkpoint()
    leaving, reaching = links.groupBy("src").agg(F.sum("n").alias("all")), links.groupBy("dst").agg(F.sum("n").alias("all"))
    forth = links.join(leaving, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    back = links.join(reaching, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    vouched = links.join(reaching, "dst").select(F.lit("vouched").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    leads = links.join(leaving, "src").select(F.lit("leads").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    edges = forth.unionByName(back).unionByName(vouched).unionByName(leads).checkpoint()
    seed = lambda column, *kinds: of_host.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "host", F.col(column).alias("seed"))
    seeds = seed("trusted", "trust", "vouched").unionByName(seed("blamed", "distrust", "leads")).where("seed > 0")
    mass = propagate(edges, seeds, damping, tolerance, rounds)
    kinds = ["trust", "distrust", "vouched", "leads"]
    by_host = mass.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind) for kind in kinds))
    amounts = {"trust": F.col("trust"), "distrust": F.col("distrust"), "leads": F.col("leads") / (1 - damping), "vouched": F.col("vouched") / (1 - damping)}
    scores = of_host.join(by_host, "host", "left").select("host", "n", *(F.coalesce(x, F.lit(0.0)).alias(kind) for kind, x in amounts.items()))
    scores = scores.withColumn("bad", F.col("leads") - F.col("vouched") > threshold)
    heavy = F.col("n") * HEAVY > F.lit(of_host.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = F.broadcast(of_host.where(heavy).select("host", F.lit(True).alias("hot")))
    parts = F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("part")
    part = F.when(F.col("hot") | (F.col("host") == ""), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = judged.join(hot, "host", "left").withColumn("part", part)
    joined = dealt.join(scores.select("host", parts, "trust", "distrust", "leads", "vouched", "bad"), ["host", "part"], "left")
    method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("trust", "distrust", "leads", "vouched")))
