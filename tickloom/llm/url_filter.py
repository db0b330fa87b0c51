"""URL filters by host and path rules, carried over redirects and canonical links.

In DataFrame operations only. A page's own rule (longest host, then longest path) decides. Pages
without a rule take the decision of their component over redirect and canonical-link edges: a
block on any alias, page or mere link target, blocks them. An explicit allow rule has precedence
over a block that comes from an alias. Otherwise pages are allowed.

Edges are ``<link rel=canonical href>``, ``<meta http-equiv=refresh content="..;url=..">`` and
rows of an optional redirects(src, dst) table. Nodes are urls without their fragment, with scheme
and host in small letters and / for an empty path, so that ways to write one address are one node.
Null urls have no host, no edges and are allowed; null html has no edges. Repeated rows are
judged alike. A very long url or html is read whole. Other columns play no part, whatever their
names. Empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL as FEW
from .common import cut, join_groups, let
from .components import components

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tasks that pages of one url are spread over.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool


RULES = (Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path))):  # later ones, being longer, win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.host + r.path).otherwise(name)
        verdict = F.when(fits, "block" if r.block else "allow").otherwise(verdict)
    return name, verdict


def _node(url: Column) -> Column:
    """url without its fragment, scheme and host in small letters, and with / for an empty path.

    Every part is computed once a row: what is repeated in branches grows past what can be compiled.
    """

    def of(bare: Column) -> Column:
        def joined(head: Column) -> Column:
            rest = F.substr(bare, F.length(head) + 1)
            slash = lambda r: F.when((r == "") | r.startswith("?"), F.concat(F.lit("/"), r)).otherwise(r)
            return F.when(head == "", bare).otherwise(F.concat(F.translate(head, CAPITALS, SMALL), let(rest, slash)))

        return let(F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1), joined)

    return let(F.regexp_replace(url, "(?s)#.*$", ""), of)


def _absolute(link: Column, url: Column) -> Column:
    def of(t: Column) -> Column:
        folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
        return (
            F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), t))
            .when(t.startswith("/"), F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), t))
            .when(t != "", F.concat(F.regexp_replace(folder, r"(?s)(?<!/)$", "/"), t))
        )

    return let(F.replace(F.btrim(link), F.lit("&amp;"), F.lit("&")), of)


def edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) between different urls."""
    some = pages.where("url is not null and html is not null").select("url", "html")
    value = r"""\s*=\s*["']?([^"'\s>]+)"""
    tag = lambda name, need: F.regexp_extract("html", rf"(?is)(<{name}\b(?=[^>]*{need})[^>]*>)", 1)
    holds = lambda word: F.lower("html").contains(word)
    canonical = F.when(holds("canonical"), F.regexp_extract(tag("link", r"""\brel\s*=\s*["']?canonical\b"""), r"(?is)\bhref" + value, 1))
    refresh = F.when(holds("refresh"), F.regexp_extract(tag("meta", r"""http-equiv\s*=\s*["']?refresh\b"""), r"""(?is)url\s*=\s*["']?([^"'\s>]+)""", 1))
    # Exploding parts what finds a link from what resolves it, so that neither is repeated in the other.
    found = some.select("url", F.explode(F.array_distinct(F.array_compact(F.array(canonical, refresh)))).alias("to")).where("to <> ''")
    found = found.select(F.explode(F.array(F.struct(_node(F.col("url")).alias("src"), _node(_absolute(F.col("to"), F.col("url"))).alias("dst")))).alias("e")).select("e.src", "e.dst")
    if redirects is not None:
        found = found.unionByName(redirects.select(F.explode(F.array(F.struct(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")))).alias("e")).select("e.src", "e.dst"))
    return found.where("src is not null and dst is not null and src <> dst")


def _tainted(links: DataFrame, rules) -> DataFrame:
    """(_node) of components with a blocked node. A component's verdict goes to its nodes by
    ``join_groups``, as one may hold a third of all."""
    parts = cut(components(links))
    _, verdict = rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)
    roots = parts.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.bool_or(F.coalesce(verdict == "block", F.lit(False))).alias("blocked"))
    return cut(join_groups(parts, cut(roots.where("blocked").drop("blocked")), "root", "nodes").select(F.col("node").alias("_node")))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every page.

    Pages without a rule ask for their component. Its nodes go to every task while there are few;
    more of them are copied SALTS times, so that pages that repeat one url spread.
    """
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("_own"))
    columns = ["page_id", "url", "host", "path", "rule"]
    links = cut(edges(pages, redirects))
    bad = None if links.isEmpty() else _tainted(links, rules)
    if bad is None or not (many := bad.count()):
        return rows.select(*columns, F.coalesce("_own", F.lit("allow")).alias("verdict"))
    asks = F.col("_own").isNull() & F.col("url").isNotNull()
    open_ = rows.where(asks).select("*", F.explode(F.array(_node(F.col("url")))).alias("_at"))
    if many <= FEW:
        found = open_.join(F.broadcast(bad), F.col("_at") == F.col("_node"), "left")
    else:
        open_ = open_.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        copies = bad.select("_node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
        found = open_.join(copies, (F.col("_at") == F.col("_node")) & (F.col("_salt") == F.col("_part")), "left")
    found = found.select(*columns, F.when(F.col("_node").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return found.unionByName(rows.where(~asks).select(*columns, F.coalesce("_own", F.lit("allow")).alias("verdict")))
