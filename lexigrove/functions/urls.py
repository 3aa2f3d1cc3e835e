"""URL rules as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path endings that are never crawled.
BLACKLIST = [".js", ".pdf", ".png", ".zip", ".jpg", ".css", ".doc", ".ppt", ".mp3", ".gif", ".swf"]
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def normalize(url: Column) -> Column:
    """http unless there is a scheme; the fragment goes and the query stays."""
    bare = without_fragment(F.trim(url))
    return F.when(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", 0) != "", bare).otherwise(F.concat(F.lit("http://"), F.regexp_replace(bare, "^//", "")))


def crawlable(href: Column) -> Column:
    """Not empty, not a fragment, http or https or relative, and no blacklisted ending of the path (in this case only, the query does not count)."""
    ending = None
    for e in BLACKLIST:
        ending = path(href).endswith(e) if ending is None else ending | path(href).endswith(e)
    return (href != "") & ~href.startswith("#") & scheme(href).isin("", "http", "https") & ~ending


def absolute(href: Column, page: Column, rfc: bool = False) -> Column:
    """Scheme and host come from the page where the link has none; a relative path is taken from the root, or, with ``rfc``, from the page's folder."""
    bare = without_fragment(href)
    own_host = host(bare)
    prefix = F.concat(F.when(scheme(bare) != "", scheme(bare)).otherwise(scheme(page)), F.lit("://"), F.when(own_host != "", own_host).otherwise(host(page)))
    own_path = path(bare)
    if rfc:
        folder = F.regexp_replace(path(page), "[^/]*$", "")
        own_path = F.when((own_path == "") & (own_host == ""), path(page)).when(own_path.startswith("/") | (own_host != ""), own_path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own_path))
    rooted = F.when((own_path != "") & ~own_path.startswith("/"), F.concat(F.lit("/"), own_path)).otherwise(own_path)
    query = F.regexp_extract(bare, QUERY, 1)
    return F.concat(prefix, rooted, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def domain(name: Column) -> Column:
    """The last two labels of a host; registered_domain() in operators.links takes a suffix list."""
    return F.regexp_extract(name, r"([^.:]+\.[^.:]+)(?::\d+)?$", 1)
