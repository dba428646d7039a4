"""URL scalars and the classification of recorded probes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that block probes and count as valid.
WHITELIST = (
    "academic.oup.com", "axios.com", "barrons.com", "bloomberg.com", "economist.com", "fastcompany.com", "forbes.com", "ft.com", "marketwatch.com", "nytimes.com",
    "onlinelibrary.wiley.com", "politico.com", "qz.com", "reuters.com", "science.org", "sciencedirect.com", "smithsonianmag.com", "thehill.com", "wsj.com",
)
#: Substrings of links that are left out.
EXCLUDED = ("pqarchiver.com", "pqasb.pqarchiver.com", "archive.org", "web.archive.org", "scribd.com", "jstor.org", "link.springer.com", "proquest.com", "ebscohost.com", "facebook.com")
#: Paths of a site's home, and words of an error's message with the issue they stand for, in order.
HOME = ("/", "/index", "/index.html", "/index.htm")
ISSUES = (
    ("connection_timeout", ("timeout", "timed out")),
    ("dns_failed", ("name resolution", "nodename", "getaddrinfo")),
    ("connection_refused", ("connection refused",)),
    ("ssl_error", ("ssl", "certificate")),
)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def scheme(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def origin(url: Column) -> Column:
    """scheme://host, with a port that isn't the scheme's own; null for what is no URL."""
    port = F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit(""))
    own = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port.isNull() | (port == own), "").otherwise(F.concat(F.lit(":"), port)))


def whitelisted(url: Column) -> Column:
    return F.coalesce(bare_host(url).isin(*WHITELIST), F.lit(False))


def excluded(url: Column, patterns=EXCLUDED) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(url), p))


def bare_path(url: Column) -> Column:
    """The path without one closing slash; a root path stays."""
    return F.coalesce(F.nullif(F.regexp_replace(path(url), "/$", ""), F.lit("")), F.lit("/"))


def comparable(url: Column) -> Column:
    """Scheme, host, bare path, query; port and fragment don't count."""
    query = F.nullif(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    return F.concat(scheme(url), F.lit("://"), host(url), bare_path(url), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def differ(a: Column, b: Column) -> Column:
    return F.coalesce(comparable(a) != comparable(b), a != b)


def same_site(a: Column, b: Column) -> Column:
    x, y = bare_host(a), bare_host(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def is_home(url: Column) -> Column:
    """Whether the path is a site's home; case counts. False for what is no URL."""
    return host(url).isNotNull() & bare_path(url).isin(*HOME)


def to_home(url: Column, final: Column) -> Column:
    return F.coalesce(same_site(url, final) & is_home(final), F.lit(False))


def issue_of_error(message: Column) -> Column:
    """The first issue whose words the message holds; connection_failed if none."""
    low, out = F.lower(message), F.lit("connection_failed")
    for issue, words in reversed(ISSUES):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), issue).otherwise(out)
    return out


def safe_url(url: Column, site: str | None = None) -> Column:
    """The URL if it is one of http or https, else '#'. With a site, what has no scheme is a path of it."""
    if site:
        url = F.when(F.regexp_like(url, F.lit("(?i)^[a-z][a-z0-9+.-]*:")), url).when(url != "", F.concat(F.lit(site.rstrip("/") + "/"), F.regexp_replace(url, "^/", "")))
    known = F.regexp_like(F.coalesce(url, F.lit("")), F.lit(r"(?i)^https?://[^/?#\s]")) & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    return F.when(known, url).otherwise("#")


def classified(url: Column, status: Column, status_text: Column, final: Column, error: Column, aborted: Column) -> Column:
    """struct(link_status, issue_type, detail) of a recorded probe, conditions in order."""
    row = lambda s, i, d: F.struct(F.lit(s).alias("link_status"), (i if isinstance(i, Column) else F.lit(i).cast("string")).alias("issue_type"), (d if isinstance(d, Column) else F.lit(d)).alias("detail"))
    http = F.trim(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), F.coalesce(status_text, F.lit(""))))
    code = F.concat(F.lit("http_"), status.cast("string"))
    issue = issue_of_error(error)
    return (
        F.when(whitelisted(url), row("whitelisted", None, ""))
        .when(F.coalesce(aborted, F.lit(False)), row("timeout", "connection_timeout", "connection timeout"))
        .when(error.isNotNull() & (issue == "connection_timeout"), row("forbidden", issue, "connection timeout"))
        .when(error.isNotNull(), row("invalid", issue, F.replace(issue, F.lit("_"), F.lit(" "))))
        .when(status.isin(401, 403), row("forbidden", code, http))
        .when(status.isin(404, 410, 405, 429), row("invalid", code, http))
        .when(status.between(400, 499), row("invalid", "http_4xx", http))
        .when(~status.between(200, 299), row("invalid", "http_5xx", http))
        .when(differ(url, final) & to_home(url, final), row("invalid", "redirect_to_home", F.concat(F.lit("redirects to site home (page likely gone): "), final)))
        .when(differ(url, final), row("probably_valid", "redirect", F.concat(F.lit("redirects to different URL: "), final)))
        .otherwise(row("probably_valid", None, ""))
    )
