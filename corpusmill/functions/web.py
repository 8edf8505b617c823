"""HTML and URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that plain pages use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(c: Column) -> Column:
    """Text without scripts, styles, comments and tags; named entities decoded, white space squeezed."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0b\f\r]+", " "))


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r'href="([^"]*)"'), 1)


def url_host(c: Column) -> Column:
    """Lower-case host without a leading ``www.`` or ``m.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^(www|m)\.", "")


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(c: Column) -> Column:
    """Host and path without query, fragment and trailing slash: the fingerprint of a page."""
    return F.concat(url_host(c), F.regexp_replace(F.lower(url_path(c)), r"/+$", ""))


def host_within(host: Column, domains: list[str]) -> Column:
    """Equal to a domain or below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | F.endswith(host, F.lit("." + d))
    return hit


def glob_pattern(glob: str) -> str:
    """``**`` is anything, ``*`` anything but a slash."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_-." else "\\" + glob[i]), i + 1
    return out


def boundary_pattern(glob: str) -> str:
    """A glob that holds for whole names: a folder (with a slash at its end) for all below it, a name up to a slash or the end."""
    tail = ".*" if glob.endswith("/") else "" if glob.endswith("*") else "(?:/|$)"
    return glob_pattern(glob) + tail
