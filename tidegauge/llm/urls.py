"""Allow and block decisions on urls, carried over redirects and canonical links.

A url's own rule decides first: the longest one whose host it lies under and whose path it begins
with. Urls that redirect to one another, name one another as canonical, or share a normal form are
one component (distributed connected components). A url without a rule is blocked if a rule blocks
some member of its component and none allows one explicitly; otherwise it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.components import connected
from tidegauge.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track a visit (fixed values).
TRACKING = "utm_[^=]*|ref|gclid|fbclid"
CANONICAL_TAG = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH_TAG = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'>\s;]+)"""


#: Ways an address writes "&" inside an attribute (fixed values).
AMPERSAND = "(?i)&(amp|#38|#x26);"
ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"
OTHER_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """The url under https, without default port, closing slash, tracking parameters and fragment; other schemes stay."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    asked = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(url.rlike("(?i)^https?://"), F.concat(F.lit("https://"), host, F.regexp_replace(path_of(url), "/+$", ""), asked)).otherwise(url)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct with ``rule`` and ``verdict``; null if none does.

    Equal lengths go to the longer host, then to allow. The rules are a short stated list.
    """
    by_host: dict[str, list[Column]] = {}
    for verdict, rule_host, rule_path in rules:
        fields = {"size": len(rule_host) + len(rule_path), "host_size": len(rule_host), "allows": int(verdict == "allow"),
                  "path": rule_path, "rule": rule_host + rule_path, "verdict": verdict}
        by_host.setdefault(rule_host, []).append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    table = F.create_map(*[x for k, v in by_host.items() for x in (F.lit(k), F.array(*v))])
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lists = F.filter(F.transform(above, lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull())
    return F.array_max(F.filter(F.flatten(lists), lambda r: F.startswith(path, r["path"])))


def without_dots(path: Column) -> Column:
    """An absolute path with its "." and ".." steps carried out; one step up from the root stays at the root."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    closing = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(walked, "/"), closing)).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """A link's target as a full address, seen from the page's url; null if it leads nowhere else.

    Relative targets start at the page's folder, those of a query alone at its path. Targets that are empty or only a
    fragment, other kinds of address (mailto:), and relative ones on a url without :// give null.
    """
    site = F.concat(F.lit("https://"), host_of(url))
    to_path, rest = F.regexp_extract(target, "(?s)^[^?#]*", 0), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(url), "(?s)^.*/", 0)
    below = F.concat(F.when(folder == "", "/").otherwise(folder), to_path)
    return (F.when((target == "") | F.startswith(target, F.lit("#")), None)
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("https:"), target))
            .when(target.rlike(ABSOLUTE), target)
            .when(target.rlike(OTHER_SCHEME) | ~F.contains(url, F.lit("://")), None)
            .when(F.startswith(target, F.lit("/")), F.concat(site, without_dots(to_path), rest))
            .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(url), target))
            .otherwise(F.concat(site, without_dots(below), rest)))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): redirect and canonical-link edges of pages (url, html), and each end's edge to its normal form."""
    def targets(tag: str, address: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)),
                           lambda t: F.regexp_replace(F.regexp_extract(t, address, 1), AMPERSAND, "&"))

    to = F.concat(targets(CANONICAL_TAG, HREF), targets(REFRESH_TAG, REFRESH_URL))
    found = (pages.where("url is not null").select("url", F.explode(to).alias("to"))
             .withColumn("to", resolved(F.col("url"), F.col("to"))))
    direct = found.where("to is not null").select(F.col("url").alias("a"), F.col("to").alias("b"))
    ends = pages.where("url is not null").select("url").union(direct.select("b")).distinct()
    return direct.union(ends.select("url", normal_form(F.col("url"))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages`` (page_id, url, html).

    A url that is null or has no :// has an empty host and path, no rule and, without links, is
    allowed. A null html has no links; all canonical tags and refreshes of a page count.
    Rows may repeat; other columns are not read; no pages give no rows.
    """
    edges = cut_lineage(links(pages.select("url", "html")))
    parts = cut_lineage(connected(edges))
    member = parts.select("component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("verdict"))
    blocked = (member.groupBy("component").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"), F.max((F.col("verdict") == "allow").cast("int")).alias("allows"))
               .where("blocks = 1 and coalesce(allows, 0) = 0").select("component", F.lit(True).alias("blocked")))
    known = cut_lineage(parts.join(blocked, "component", "left").select("node", "component", "blocked"))
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return (own.join(known, F.col("url") == F.col("node"), "left")
            .select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                    F.coalesce("own.verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
                    F.coalesce("component", "url").alias("component")))
