"""Web addresses and hosts, by regular expressions inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
#: Hosts of social platforms (fixed values).
SOCIAL = {"facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "x", "x.com": "x", "youtube.com": "youtube", "tiktok.com": "tiktok"}


def with_scheme(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", None).when(t.rlike(_SCHEME), t).otherwise(F.concat(F.lit("https://"), t))


def host(c: Column) -> Column:
    """Lower-case host without credentials, port, www and final dot; null for blank."""
    h = F.lower(F.regexp_extract(with_scheme(c), r"^[^:]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"\.$", ""), F.lit(""))


def port(c: Column) -> Column:
    """':' and the port of an address, '' for the default ones."""
    p = F.regexp_extract(with_scheme(c), r"^[^:]+://(?:[^/@?#]*@)?[^/:?#]+(:\d+)", 1)
    return F.when(p.isin(":80", ":443"), "").otherwise(p)


def path(c: Column) -> Column:
    return F.regexp_extract(with_scheme(c), r"^[^:]+://[^/?#]*([^?#]*)", 1)


def query_text(c: Column) -> Column:
    return F.regexp_extract(with_scheme(c), r"\?([^#]*)", 1)


def canonical_url(c: Column) -> Column:
    """Form for comparison: https, no www, no default port, no slash at the end, no fragment."""
    q = query_text(c)
    return F.when(host(c).isNotNull(), F.concat(F.lit("https://"), host(c), port(c), F.regexp_replace(path(c), r"/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def research_url(c: Column) -> Column:
    """As canonical_url, with tracking parameters dropped, the others sorted and double slashes made single."""
    kept = F.array_sort(F.filter(F.split(query_text(c), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid|ref|ref_src|source|trk)(=|$)")))
    p = F.regexp_replace(F.regexp_replace(path(c), r"/{2,}", "/"), r"/$", "")
    return F.when(host(c).isNotNull(), F.concat(F.lit("https://"), host(c), port(c), p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def second_level_label(h: Column) -> Column:
    parts = F.split(h, r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))


def host_suffixes(h: Column) -> Column:
    """h and its parent domains: equal to one of them means equal or a subdomain."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def social_platform(c: Column) -> Column:
    """Platform of a profile address that has a path; else null."""
    h = host(c)
    out = F.lit(None).cast("string")
    for name, platform in SOCIAL.items():
        out = F.when(((h == name) | h.endswith("." + name)) & (F.regexp_replace(path(c), "/", "") != ""), platform).otherwise(out)
    return out


def redacted(c: Column) -> Column:
    """Credentials and the values of secret parameters replaced."""
    t = F.regexp_replace(c, r"://[^/@\s]+@", "://***@")
    return F.regexp_replace(t, r"(?i)([?&](?:api_?key|token|secret|password|key|auth)=)[^&#]*", "$1***")


def is_public(c: Column) -> Column:
    """Whether an address is http(s), without credentials, with a named host or a globally routed IPv4 address."""
    h = host(c)
    private = h.rlike(r"^(localhost|.*\.local|.*\.internal|\[|(0|10|127|22[4-9]|23\d|24\d|25[0-5]|169\.254|192\.168|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7]))\.\d[\d.]*$)")
    return F.coalesce(F.lower(with_scheme(c)).rlike("^https?://") & ~with_scheme(c).rlike("^[^:]+://[^/?#]*@") & h.isNotNull() & h.contains(".") & ~private & (F.length(c) <= 2048), F.lit(False))
