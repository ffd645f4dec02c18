"""URL filters: rules, then trust and distrust spread over the link graph of hosts.

Only DataFrame functions are used. Pages that a rule allows seed trust at their
host, pages that one blocks seed distrust. Trust is personalised PageRank along
links; distrust is the same against their direction (a host that links to a
distrusted one becomes distrusted). Steps go on until no host is reached anew and
no mass grows by more than ``TOLERANCE`` of itself, so that the smallest masses settle
as the largest do. A page without a rule gets its host's verdict: block where distrust
exceeds ``RATIO`` times trust.

Links are counted by pair of hosts before anything else, so that a host with many
pages is one row an edge; each step joins two written tables, so that a host with
many edges can be split, and sums before it shuffles.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule
and is allowed; null html has no links; links to the own host do not count; equal
lengths of rules go to the smaller rule; repeated rows are judged one by one but
each counts as a seed; empty tables give no rows; without seeds all is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed rules of the query: (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING, TOLERANCE, RATIO = 0.85, 1e-6, 1.0
BROADCAST_ROWS = 200_000  # of host verdicts; beyond it the join is shuffled
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    has = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """The pages with host, path and the longest rule that fits (rule, ruled); null where none does."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted((Rule.parse(*x) for x in rules), key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = F.explode(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), F.lit(1)))
    pairs = pages.where("host <> ''").select(F.col("host").alias("src"), links.alias("dst"))
    return pairs.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, mass) that seeds (host, kind, mass) settle at; kind is trust or distrust.

    Sums begin with the seeds' own part and so only grow: the set of reached hosts and every mass have an end.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    )
    out = scratch.write(flows.groupBy("kind", "host").agg(F.sum("links").alias("all_links")), "out")
    flows = scratch.write(scratch.write(flows, "flows").join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all_links")).alias("share")), "shares")
    base = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    if flows.isEmpty():  # nothing flows: every step gives the same
        return base
    mass = scratch.write(base, "mass0")
    for k in count(1):
        moved = flows.join(mass, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        both = moved.union(base).withColumn("before", F.lit(0.0)).union(mass.select("kind", "host", F.lit(0.0), "mass"))
        sums = scratch.write(both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before")), f"mass{k}")
        mass = sums.select("kind", "host", "mass")
        scratch.drop(f"mass{k - 1}")
        if sums.where(F.col("mass") - F.col("before") > tolerance * F.col("mass")).isEmpty():
            break
    return mass


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, **options) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict (the rule's, else its host's)."""
    scratch = Scratch(pages.sparkSession)
    ruled = with_rule(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    edges = scratch.write(host_edges(ruled), "edges")
    plain = scratch.write(ruled.select("page_id", "host", "path", "rule", "ruled"), "pages")
    kind = F.when(F.col("ruled") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    counts = plain.where("ruled is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    counts = scratch.write(counts, "counts")
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    whole = F.when(F.col("kind") == "trust", F.lit(float(total.get("trust", 1)))).otherwise(F.lit(float(total.get("distrust", 1))))
    seeds = scratch.write(counts.select("kind", "host", (F.col("n") / whole).alias("mass")), "seeds")
    mass = propagate(edges, seeds, scratch, **options)
    by_host = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    blocked = scratch.write(by_host.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("blocked")), "blocked")
    small = blocked.count() <= BROADCAST_ROWS
    joined = plain.join(F.broadcast(blocked) if small else blocked, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
