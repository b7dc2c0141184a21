"""The page an address leads to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that track or position the reader, and host labels of the same site for other devices.
TRACKING = r"^(utm_[a-z_]*|gclid|dclid|gbraid|wbraid|fbclid|msclkid|yclid|twclid|ttclid|igshid|igsh|mc_cid|mc_eid|cmpid|ref|ref_src|referrer|_ga|_gl|spm|vero_id|oly_enc_id|icid|ncid)="
SAME_SITE = r"^(?:(?:www|m|mobile|amp)\.)+(?=[^.]+\.)"
#: Addresses without user, port, capitals, escapes and parameters: one look at them gives host and path as page_key does.
PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:(?:(?:www|m|mobile|amp)\.)+(?=[^./]+\.))?+([a-z0-9.-]*[a-z0-9-](?:/[a-z0-9._~-]+)+)/*(?:#(?s:.*))?\z"


def _decoded(text: Column) -> Column:
    """Percent escapes resolved; a text with a broken escape stays as it is. A plus sign is itself."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def page_key(url: Column) -> Column:
    """host/path?parameters of the page, equal for all spellings of one address; null if the address names no page.

    Scheme, user, standard port, case and percent-spelling of host and path, `www.`, `m.` and
    `amp.` hosts, doubled and closing slashes, the fragment and tracking parameters don't
    matter; other parameters do, in any order. Null, empty and relative addresses and a
    host's front page name no page.
    """
    plain = F.regexp_extract(F.trim(url), PLAIN, 1)
    return F.when(plain != "", plain).otherwise(_spelled(url))


def _spelled(url: Column) -> Column:
    """page_key of any address, step by step."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1))
    port = F.regexp_extract(rest, r"^[^/?]*?(:\d+)(?:[/?]|$)", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    host = F.concat(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), SAME_SITE, ""), port)
    path = F.lower(_decoded(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)))
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    given = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    named = F.filter(given, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.sort_array(F.transform(named, _decoded)), "&")  # compiled, as array_sort is not
    return F.when((host != "") & ((path != "") | (query != "")), F.concat_ws("?", F.concat(host, path), F.nullif(query, F.lit(""))))
