"""Web addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that don't name the content.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid yclid ref ref_src ref_url oc cmpid smid partner campaign_id source output"
# Hosts of publishers and the host they count as.
HOSTS = {
    "m.nytimes.com": "www.nytimes.com", "mobile.nytimes.com": "www.nytimes.com", "nytimes.com": "www.nytimes.com", "amp.theguardian.com": "www.theguardian.com", "theguardian.com": "www.theguardian.com", "m.theguardian.com": "www.theguardian.com",
    "reuters.com": "www.reuters.com", "m.reuters.com": "www.reuters.com", "washingtonpost.com": "www.washingtonpost.com", "m.washingtonpost.com": "www.washingtonpost.com", "wapo.st": "www.washingtonpost.com",
    "bbc.com": "www.bbc.com", "m.bbc.com": "www.bbc.com", "bbc.co.uk": "www.bbc.co.uk", "m.bbc.co.uk": "www.bbc.co.uk", "ft.com": "www.ft.com", "m.ft.com": "www.ft.com", "techcrunch.com": "techcrunch.com", "m.techcrunch.com": "techcrunch.com",
    "theverge.com": "www.theverge.com", "m.theverge.com": "www.theverge.com", "arstechnica.com": "arstechnica.com", "m.arstechnica.com": "arstechnica.com", "wired.com": "www.wired.com", "m.wired.com": "www.wired.com", "www.wired.com": "www.wired.com",
    "usatoday.com": "www.usatoday.com", "m.usatoday.com": "www.usatoday.com", "foxbusiness.com": "www.foxbusiness.com", "m.foxbusiness.com": "www.foxbusiness.com", "americanbanker.com": "www.americanbanker.com", "medium.com": "medium.com", "m.medium.com": "medium.com",
    "time.com": "time.com", "m.time.com": "time.com", "vanityfair.com": "www.vanityfair.com", "m.vanityfair.com": "www.vanityfair.com", "newyorker.com": "www.newyorker.com", "m.newyorker.com": "www.newyorker.com", "foxnews.com": "www.foxnews.com", "m.foxnews.com": "www.foxnews.com",
}
AGGREGATOR = "news.google.com"
# Hosts whose short addresses name a lasting object, and the host of models.
CODE_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
MODEL_HOSTS = ["huggingface.co", "www.huggingface.co"]


def _host(host: Column) -> Column:
    """Mobile and other names of known publishers become their usual host."""
    known = F.create_map(*(F.lit(x) for pair in HOSTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, host), host)


def canonical_url(url: Column) -> Column:
    """https, usual host, no fragment, no closing slash, no tracking or blank parameters; empty for other addresses.

    Parameters keep their order and spelling. An aggregator's address loses its parameters.
    """
    parts = lambda i: F.regexp_extract(url, r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host, path = _host(F.lower(F.trim(parts(2)))), parts(3)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    drop = "|".join(TRACKING.split())
    kept = F.filter(F.split(parts(4), "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike(f"^(?:{drop})="))
    query = F.when(host.contains(AGGREGATOR), "").otherwise(F.array_join(kept, "&"))
    full = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(parts(1) != "", full).otherwise("")


def reading_key(url: Column, title: Column) -> Column:
    """Host and path in lower case; without an address the first 120 characters of the title."""
    place = F.lower(F.concat(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")))
    return F.when(F.coalesce(place, F.lit("")) != "", place).otherwise(F.substring(F.lower(F.trim(title)), 1, 120))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url)


def url_set(canonical: Column, target: Column, community: str = "://forum.example/") -> Column:
    """Distinct outside addresses of an item, closing slash trimmed."""
    trimmed = F.transform(F.array(canonical, target), lambda u: F.regexp_replace(F.coalesce(u, F.lit("")), "/+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda u: (u != "") & ~u.contains(community)))


def _parts(url: Column) -> tuple[Column, Column]:
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1))
    return host, F.filter(F.split(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def is_lasting(url: Column) -> Column:
    """An address of a site, a code repository, a model or a collection: it tells no event."""
    host, parts = _parts(url)
    n = F.size(parts)
    shelf = (n <= 3) & F.coalesce(F.get(parts, F.lit(0)), F.lit("")).isin("datasets", "spaces")
    return (n == 0) | (host.isin(CODE_HOSTS) & (n <= 2)) | (host.isin(MODEL_HOSTS) & ((n <= 2) | shelf))


def is_model(url: Column) -> Column:
    host, parts = _parts(url)
    return host.isin(MODEL_HOSTS) & (F.size(parts) == 2)
