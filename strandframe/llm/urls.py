"""URL filters: rules on hosts and paths, carried to aliases over redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components

#: (verdict, host, path) in force for the pages table.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_rest(url: Column) -> Column:
    """What follows the first "://"; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def url_host(url: Column) -> Column:
    """From after :// to the first / ? # or the end; only A-Z are lower-cased."""
    return F.translate(F.regexp_extract(url_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From after the host to the first ? or # or the end."""
    return F.regexp_extract(url_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls. A rule fits its host and subdomains."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


#: Tags that name another address of the page, and the address in them.
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def plain_path(path: Column) -> Column:
    """A path from / with its . and .. segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    at_folder = path.rlike(r"/\.\.?$")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(at_folder & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def resolved(base: Column, to: Column) -> Column:
    """The address that a target names on the page at `base`; null for schemes without "://"."""
    own, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), url_path(base)
    head, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    target = F.when(head == "", path).when(head.startswith("/"), plain_path(head)).otherwise(plain_path(F.concat(folder, head)))
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(own, target, tail))


def alias_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url: redirect and canonical links of each page's html, without repeats.

    Relative targets are resolved against the page's own address; targets of schemes without
    "://", such as mailto:, name no page and are left out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1))))
    out = pages.where(F.instr("url", "://") > 0).select(F.col("url").alias("from_url"), F.explode(found).alias("to"))
    return out.select("from_url", resolved(F.col("from_url"), F.col("to")).alias("to_url")).where("to_url is not null").distinct()


def url_node(url: Column) -> Column:
    """Host and path: scheme, query and fragment do not part aliases."""
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), url_path(url)))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of `pages`.

    A page's own rule decides. Without one, the pages that redirect and canonical links join
    decide together: allowed if any member has an allow rule, else blocked if any member has a
    block rule, else allowed. Null urls and urls without "://" have an empty host and path, fit
    no rule and are allowed. Repeated rows come back each; null html has no link. Columns beside
    page_id, url and html are not read. DataFrame functions only.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), url_node(F.col("url")).alias("node")).withColumns({"rule": text, "own": verdict})
    links = alias_links(pages).select(url_node(F.col("from_url")).alias("u"), url_node(F.col("to_url")).alias("v"))
    members = connected_components(links)
    split = F.instr("node", "/")
    at_host = F.when(split > 0, F.substr("node", F.lit(1), split - 1)).otherwise(F.col("node"))
    at_path = F.when(split > 0, F.substr("node", split)).otherwise(F.lit(""))
    _, of_node = rule_of(F.col("h"), F.col("p"), rules)
    each = members.withColumns({"h": at_host, "p": at_path}).select("component", of_node.alias("own"))
    whole = each.groupBy("component").agg(F.when(F.bool_or(F.col("own") == "allow"), F.lit("allow")).when(F.bool_or(F.col("own") == "block"), F.lit("block")).alias("shared"))
    by_node = members.join(whole, "component")
    out = judged.join(by_node, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"), "component")
