"""Addresses and ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import PLATFORM_DOMAINS, TRACKING_NAMES, TRACKING_PREFIXES


def domain(url: Column) -> Column:
    """Host in lower case without port and www.; '' if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def under(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def platform(host: Column) -> Column:
    return under(F.regexp_replace(F.lower(host), r"^www\.", ""), PLATFORM_DOMAINS)


def norm_source(source: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " ")))


def blocked(source: Column, link: Column, sources: list[str], domains: list[str]) -> Column:
    return norm_source(source).isin(sources) | under(domain(link), domains)


def internal(source: Column, link: Column, sources: list[str], domains: list[str]) -> Column:
    """Ours by host or by source name (lists given by the caller)."""
    return norm_source(source).isin(sources) | under(domain(link), domains)


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme and authority, path, query; the fragment is left out."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    return F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*)", 1), F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?]*([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)


def _name(param: Column) -> Column:
    return F.lower(F.substring_index(param, "=", 1))


def normalize(url: Column) -> Column:
    """Canonical address: base in lower case, parameters sorted without those whose name begins like a tracking
    parameter, no fragment, no slash at the end of a path (a lone slash stays)."""
    base, path, query = _parts(url)
    drop = lambda p: F.exists(F.array(*[F.lit(x) for x in TRACKING_PREFIXES]), lambda t: _name(p).startswith(t))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~drop(p))), "&")
    p = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(F.lower(base), p, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def strip_tracking(url: Column) -> Column:
    """The address without utm_ and exactly named tracking parameters and fragment; order kept."""
    base, path, query = _parts(url)
    drop = lambda p: _name(p).startswith("utm_") | _name(p).isin(TRACKING_NAMES)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~drop(p)), "&")
    return F.concat(base, path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def redirect_target(url: Column) -> Column:
    """What a redirecting address carries in url, q or link, decoded; else the address."""
    found = [F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1), F.lit(""))) for k in ("url", "q", "link")]
    found = [F.when(x.rlike("^https?://"), x) for x in found]
    return F.coalesce(*found, url)


def article_id(source: Column, link: Column) -> Column:
    """First 16 hex digits of SHA-256 over source and canonical link."""
    return F.substring(F.sha2(F.concat(norm_source(source), F.lit("|"), link), 256), 1, 16)
