"""URL filters: path rules, and link-graph propagation for hosts that no rule decides.

Nodes are hosts; edges are the links between pages of different hosts, weighted by their number. Hosts with pages that a rule
allows are trusted seeds, those with pages that a rule blocks are distrusted ones, each by the share of its pages, so one
blocked host among many trusted ones weighs no more than any of them. Trust is a personalised PageRank along the edges,
distrust the same against them: who links to the blocked is distrusted. A host whose distrust exceeds `threshold` times its
trust is blocked, else it is allowed; a page goes by the longest rule that fits it, and else by its host.

Where no page links to another host, there is no edge, and a host that no rule decides goes by the share of its own pages
that rules allow and block. With domain_ties, off unless asked for, hosts are also tied to their ancestor domains of two
labels and more, with or without pages (a single label, which unrelated hosts share, only if it has pages), one link each way.

Edges are aggregated per pair of hosts before anything else is shuffled, so the many pages of a hot host are one row per
linked host. An iteration is a join and an aggregate; lineage is cut every few iterations. After i of them each score is
within damping^i of its limit for each unit of seeds, so they go on until that is below TOLERANCE and below what separates
any host from its threshold, or below TIE. A host that one kind alone can ever reach is settled however small its score is: the
hosts that a kind reaches only grow in number, and once they don't, none is reached later. Scores that then differ by the share EQUAL at most are equal, and don't block. All of it is DataFrame functions.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, and is allowed; null html has no
links; repeated rows and null ids are judged each; html of any length is read whole; a host without seeds in reach has no
scores and is allowed; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import Run, cut

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DAMPING, CUT_EVERY = 0.85, 5
TOLERANCE, TIE = 1e-4, 1e-12
#: Scores whose ratio differs from the threshold by less than this share are as good as equal.
EQUAL = 1e-9
MAX_BROADCAST = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINK = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct of its length, text and verdict; null if none does."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def host_edges(pages: DataFrame, hosts: DataFrame, domain_ties: bool = False) -> DataFrame:
    """src, dst, n for hosts that differ. pages: host, html; hosts: host."""
    link = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.filter(F.contains("html", F.lit("//"))).select(F.col("host").alias("src"), link.alias("to"))
    to = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    links = links.select("src", host_and_path(to)[0].alias("dst"), F.lit(1).alias("n"))
    if domain_ties:
        links = links.union(_ties(hosts))
    return links.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _ties(hosts: DataFrame) -> DataFrame:
    """src, dst, n: a host and its parent domain, that and its own, and so on, both ways."""
    parts = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = F.transform(F.slice(chain, 1, F.size(chain) - 1), lambda d, i: F.struct(d.alias("src"), F.get(chain, i + 1).alias("dst")))
    named = hosts.filter(F.contains("host", F.lit(".")) & ~F.col("host").rlike(r"[.][0-9]+(:[0-9]*)?$"))
    up = named.select(F.explode(steps).alias("s")).select("s.src", "s.dst").filter("src <> '' and dst <> ''").distinct()
    single = hosts.filter(~F.contains("host", F.lit("."))).select(F.col("host").alias("dst"))
    up = up.filter(F.contains("dst", F.lit("."))).union(up.join(single, "dst", "left_semi").select("src", "dst")).select("src", "dst", F.lit(1).alias("n"))
    return up.union(up.select("dst", "src", "n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int | None = None, threshold: float = 1.0, cut=cut) -> DataFrame:
    """host, kind, score, after so many iterations or until it is settled. seeds: host, kind (trust or distrust), seed; trust runs along the edges, distrust against them."""
    forth = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = forth.union(back)
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    steps = cut(both.join(out, ["kind", "host"]).select("kind", "host", "to", (damping * F.col("n") / F.col("all")).alias("share")))
    base = seeds.select("host", "kind", ((1 - damping) * F.col("seed")).alias("score"))
    scores = seeds.select("host", "kind", F.col("seed").alias("score"))
    mass = max(1.0, seeds.agg(F.max("seed")).first()[0] or 0.0, *(r["s"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("s")).collect()))
    # without edges nothing moves, and one step is the limit
    most = iterations if iterations is not None else 1 if not steps.limit(1).count() else math.ceil(math.log(TIE / mass) / math.log(damping))
    reached, closed = -1, False
    gap = F.sum(F.when(F.col("kind") == "trust", threshold * F.col("score")).otherwise(-F.col("score")))
    for i in range(1, most + 1):
        moved = scores.join(steps, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"))
        scores = moved.unionByName(base).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if i % CUT_EVERY == 0 or i == most:
            scores = cut(scores)
            error = mass * damping**i
            if iterations is None and error <= TOLERANCE * mass:
                if not closed:
                    closed, reached = (n := scores.count()) == reached, n
                open_ = F.abs("gap") <= (1 + threshold) * error
                by_host = scores.groupBy("host").agg(gap.alias("gap"), F.count("*").alias("kinds"))
                if not by_host.filter(open_ & (F.col("kinds") > 1) if closed else open_).limit(1).count():
                    break
    return scores


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = DAMPING, iterations: int | None = None, threshold: float = 1.0, domain_ties: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per page."""
    run, last = Run(pages.sparkSession), Run(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    # urls are read and judged once; the pages' own text is read once more, for links
    ruled = last.cut(parsed.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")))
    counts = run.cut(ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad")))
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("n")).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("n")).alias("seed"))))
    seeds = run.cut(counts.select("host", kinds.alias("k")).select("host", "k.kind", "k.seed").filter("seed > 0"))
    edges = host_edges(parsed.select("host", "html"), counts.select("host"), domain_ties)
    scores = propagate(edges, seeds, damping, iterations, threshold, run.cut)
    wide = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    own = last.cut(wide.join(counts.select("host"), "host", "left_semi").select(F.col("host").alias("h"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    run.clear()
    small = own.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    out = ruled.join(F.broadcast(own) if small else own, F.col("host") == F.col("h"), "left")
    by_host = F.when(F.coalesce(F.col("distrust") > threshold * (1 + EQUAL) * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
