"""URL filters: rules by host and path, and block decisions carried over redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.llm.components import components
from worksift.plans.storage import written

MAX_RULES = 10_000  # rules are a parameter of the job and are compiled into its plan
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path as one string) that fits, or null. A rule fits its host and
    all subdomains if the path starts with the rule's. Looked up, not scanned: the candidates are
    the host's suffixes with the path's prefixes of the lengths that rules have."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    lengths = sorted({len(path) for _, path, _ in rules})
    if not rules:
        return F.lit(None).cast("string")
    names = F.array(*[F.lit(h + p) for h, p, _ in rules])
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    # A prefix shorter than its length would repeat a shorter one: it only counts when whole.
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    tried = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    fits = F.array_intersect(tried, names)
    return F.when(host != "", F.array_max(F.transform(fits, lambda r: F.struct(F.length(r), r.alias("rule"))))["rule"])


def node_of(url: Column) -> Column:
    """What links point at: host, path and query. Scheme and fragment do not matter, and an empty
    path is ``/``. Null where there is no host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), _query_of(url)))


def _absolute(target: Column, url: Column) -> Column:
    """A link's target resolved against its page."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target != "", F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: a page's node and that of its canonical link or immediate redirect (``<link
    rel=canonical>``, ``<meta http-equiv=refresh>``), for all such tags outside comments."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->", "")

    def targets(tag: str, attribute: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(rf"""(?i)<{tag}\b[^>]*>"""), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, rf"""(?i){attribute}\s*=\s*["']?([^"'\s>]+)""", 1))

    both = F.concat(
        targets(r"""link\b[^>]*\brel\s*=\s*["']?canonical""", r"(?<![\w-])href"),
        targets(r"""meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh""", r"\burl"),
    )
    found = pages.select("url", F.explode(both).alias("target")).where("target <> ''")
    edges = found.select(
        node_of(F.col("url")).alias("a"), node_of(_absolute(F.trim("target"), F.col("url"))).alias("b")
    )
    return edges.where("a is not null and b is not null").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_of`` of every page (``page_id, url, html``).

    ``rules`` are (host, path, allow or block). A page that a rule fits has that rule's verdict. Any
    other shares the decision of its redirect equivalence class: allow if an allow rule fits a
    member (explicit allow goes first), else block if a block rule does, else allow. Members are the
    nodes joined by ``edges`` (default: ``link_edges``), pages or not; ``alias_of`` is the class's
    smallest node, null without links. Null urls and urls without ``://`` have an empty host and
    path, no rule, and are allowed. Repeated rows and page ids are judged alike, row by row.
    """
    verdicts = F.create_map(*[F.lit(x) for h, p, v in rules for x in (h + p, v)]) if rules else None
    explicit = lambda rule: verdicts[rule] if rules else F.lit(None).cast("string")
    edges = written(link_edges(pages) if edges is None else edges.select("a", "b"), "links")
    classes = written(components(edges), "classes")
    member = F.concat(F.lit("http://"), F.col("node"))
    ruled = classes.select("component", explicit(rule_for(host_of(member), path_of(member), rules)).alias("v"))
    decided = ruled.groupBy("component").agg(
        F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").alias("shared")
    )
    aliases = classes.join(decided, "component").select("node", F.col("component").alias("alias_of"), "shared")
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return own.join(aliases, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(explicit(F.col("rule")), "shared", F.lit("allow")).alias("verdict"),
        "alias_of",
    )
