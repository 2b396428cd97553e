"""URL verdicts: explicit rules, and block decisions carried to aliases.

A page's URL, its normal form (where servers usually redirect to), and the URLs it names
as its canonical form or redirects to at once are aliases; connected components over
these edges make classes of aliases. The longest rule
that fits a URL decides it. A URL without a rule is blocked if a rule blocks any URL of
its class, else allowed. An explicit allow rule always wins over what aliases carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.components import connected_components
from casegrain.llm.shared import column
from casegrain.workspace import written

#: Fixed values: (verdict, host, beginning of the path). A parameter.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: host, path and query. Scheme and fragment do not make another page."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(_after_scheme(url).isNotNull(), F.concat(host_of(url), path_of(url), query))


#: Host prefixes, path endings and query parameters that do not make another page. Parameters.
HOST_PREFIX = r"^(?:www|m|mobile)\."
PATH_ENDING = r"/(?:index\.html?)?$"
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"


def normal_form(url: Column) -> Column:
    """The address a site usually redirects to: no www or mobile host, no index page, no tracking."""
    host = F.regexp_replace(host_of(url), HOST_PREFIX, "")
    path = F.regexp_replace(path_of(url), PATH_ENDING, "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"^{TRACKING}(?:=|$)") & (p != "")), "&")
    return F.when(
        _after_scheme(url).isNotNull(),
        F.concat(F.lit("://"), host, F.when(path == "", "/").otherwise(path),
                 F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, of equally long ones an allow; else null.

    A rule is a short list entry, compared in the row; ties cannot depend on their order.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    for verdict, rule_host, beginning in reversed(order):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(beginning)
        named = F.struct(F.lit(rule_host + beginning).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, named).otherwise(best)
    return best


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


def absolute(reference: Column, base: Column) -> Column:
    """A reference found on the page ``base``, as an absolute URL."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    host = F.regexp_extract(base, r"://([^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(reference.isNull() | (reference == ""), None)
        .when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), reference)
        .when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(scheme, F.lit("://"), host, reference))
        .when(reference.rlike(r"^[?#]"), F.concat(scheme, F.lit("://"), host, path_of(base), reference))
        .when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(scheme, F.lit("://"), host, folder, reference))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` URLs: a page and its canonical form, or the page it redirects to at once."""
    tags = pages.select(
        column(url_col).alias("src"),
        F.explode(F.regexp_extract_all(column(html_col), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"),
    )
    canonical = F.when(
        F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"),
        _attribute(F.col("tag"), "href"),
    )
    refreshed = F.when(
        F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh",
        F.regexp_replace(
            F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*(.*)$", 1),
            r"""^["']|["']$""", ""),
    )
    target = F.trim(F.coalesce(canonical, refreshed))
    return (
        tags.select("src", absolute(target, F.col("src")).alias("dst"))
        .where("src IS NOT NULL AND dst IS NOT NULL")
    )


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
    normal_forms: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page, and its ``class`` of aliases, null without one.

    ``normal_forms=False`` takes no edges to normal forms. ``redirects`` may add edges (``src``, ``dst`` URLs) seen while fetching. A null URL, or one
    without ``://``, has an empty host and path, fits no rule, has no aliases and is allowed.
    Equal URLs are judged alike; an empty table gives no rows.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(
            column("src").cast("string").alias("src"), column("dst").cast("string").alias("dst")))
    if normal_forms:
        edges = edges.unionByName(pages.select(
            column(url_col).alias("src"), normal_form(column(url_col)).alias("dst")))
    edges = written(edges, "alias-edges")
    classes = written(
        connected_components(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))),
        "alias-classes",
    )
    # A node without scheme is judged like its URL: a blocked target need not be a page here.
    as_url = F.concat(F.lit("://"), F.col("node"))
    # Written, so that Spark can split a class with very many nodes in the join.
    blocked = written(
        classes.where(fitting_rule(host_of(as_url), path_of(as_url), rules)["verdict"] == "block")
        .select("component").distinct().withColumn("carried", F.lit(True)),
        "blocked-classes",
    )
    known = written(classes.join(blocked, "component", "left"), "alias-verdicts")
    url = column(url_col)
    rows = pages.select(
        column(id_col).alias("page_id"), node_of(url).alias("node"),
        host_of(url).alias("host"), path_of(url).alias("path"),
    ).withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    return rows.join(known, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("carried"), "block"), F.lit("allow")).alias("verdict"),
        F.col("component").alias("class"),
    )
