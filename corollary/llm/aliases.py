"""URL filters: rules on hosts and paths, and their decisions carried along redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """The name under which a URL is an alias: host, path and query, without scheme and fragment; null without a host."""
    query = F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1), F.lit(""))
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, the first of equals; null if none does."""
    listed = F.array(*(
        F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"))
        for r in sorted(rules, key=lambda r: -len(r.name))
    ))
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(listed, fits), F.lit(0)) if rules else F.lit(None).cast("struct<name:string,verdict:string>")


def targets_of(html: Column) -> Column:
    """Array of the addresses that a page's canonical links and refreshes name, as written."""
    html = F.coalesce(html, F.lit(""))
    none = F.array().cast("array<string>")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: F.rlike(t, F.lit(r"""(?i)\srel\s*=\s*["']?canonical\b""")))
    refresh = F.filter(tags, lambda t: F.rlike(t, F.lit(r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b""")))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    named = F.transform(F.filter(found, lambda t: t != ""), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))
    return F.when(F.rlike(html, F.lit("(?i)canonical|refresh")), named).otherwise(none)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as an address of its own: relative ones are taken from ``url``."""
    scheme = F.substring_index(url, "://", 1)
    folder = F.regexp_extract(path_of(url), "^.*/", 0)
    return (
        F.when(F.rlike(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), target))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(url), F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``a``, ``b`` between the keys of pages and those of the addresses that their html sends readers to."""
    url = F.col("__url")
    pairs = F.transform(
        targets_of(F.col("__html")), lambda t: F.struct(key_of(url).alias("a"), key_of(resolved(url, t)).alias("b"))
    )
    sent = pages.select(F.col(url_col).alias("__url"), F.col(html_col).alias("__html")).select(F.explode(pairs).alias("e"))
    return sent.select("e.a", "e.b").where("a is not null and b is not null")


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``verdict``.

    A page's own rule, the longest that fits its host and path, decides. Else its aliases do: keys (host, path and query) that
    redirects and canonical links connect, over any number of steps, whether or not they are pages themselves. If a rule
    allows one of them the page is allowed, else if a rule blocks one it is blocked; else it is allowed. ``redirects``
    (``source``, ``target``) may add redirects that a crawler saw to those of the html. ``rules`` is a parameter, a list
    of the length that fits an expression.

    A null url, or one without ``://``, has an empty host and path, no rule and no aliases. Null html names nothing. Pages that
    repeat a url get the same verdict and stay rows of their own; an empty table gives an empty result; other columns are not read.
    Only addresses are shuffled, never html; a url with a third of all rows is split by adaptive execution, being one side's key of the last join.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        source, target = F.col("source"), F.col("target")
        pair = F.array(F.struct(key_of(source).alias("a"), key_of(resolved(source, target)).alias("b")))
        edges = edges.unionAll(redirects.select(F.explode(pair).alias("e")).select("e.a", "e.b"))
    members = connected_components(edges)
    full = F.concat(F.lit("x://"), F.col("node"))
    named = members.withColumn("host", host_of(full)).withColumn("path", path_of(full))
    ruled = named.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)["verdict"])
    decided = (
        ruled.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
        .select("root", F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block")).alias("spread")).where("spread is not null")
    )
    aliases = members.join(decided, "root").select("node", "spread")
    url = F.col("__url")
    own = (
        pages.select(F.col(id_col), F.col(url_col).alias("__url"))
        .select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("__key"))
        .withColumn("__own", rule_for(F.col("host"), F.col("path"), rules))
    )
    joined = own.join(aliases, F.col("__key") == F.col("node"), "left")
    return joined.select(
        id_col, "host", "path", F.col("__own.name").alias("rule"), F.coalesce("__own.verdict", "spread", F.lit("allow")).alias("verdict")
    )
