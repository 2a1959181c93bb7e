"""Public-URL keys, bounded lines and strict dates of the evidence ledger."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that are never public, and the longest URL and host.
PRIVATE_HOSTS, MAX_URL, MAX_HOST = ("localhost", "local", "internal"), 2048, 253
LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")


def _public_host(name: str) -> str | None:
    """A host in one spelling: a global address in short form, or an ASCII name of two labels or more; None for others."""
    name = name.casefold().rstrip(".")
    try:
        address = ipaddress.ip_address(name)
        return address.compressed if address.is_global else None
    except ValueError:
        pass
    labels = name.encode("idna").decode("ascii").casefold().split(".")
    public = len(labels) > 1 and labels[-1] not in PRIVATE_HOSTS and len(".".join(labels)) <= MAX_HOST and all(map(LABEL.fullmatch, labels))
    return ".".join(labels) if public else None


def url_key_of(url: str) -> str | None:
    """``https://host[:port]/path`` in one spelling, or None for a URL that is not public HTTPS."""
    plain = len(url) <= MAX_URL and "\\" not in url and url.isprintable() and url == url.strip()
    try:
        parts = urlsplit(url) if plain else None
        if not parts or parts.scheme != "https" or parts.query or "@" in parts.netloc or not parts.hostname or parts.port == 0:
            return None
        host = _public_host(parts.hostname)
    except ValueError:
        return None
    port = f":{parts.port}" if parts.port not in (None, 443) else ""
    return host and f"https://{host}{port}{parts.path or '/'}"


@F.pandas_udf(T.StringType())
def url_key(urls: pd.Series) -> pd.Series:
    return urls.map(url_key_of, na_action="ignore")


def native_url_key(url: Column) -> Column:
    """The same for hosts that are plain ASCII names; null for all others, addresses included."""
    host = F.lower(F.regexp_extract(url, r"^https://([A-Za-z0-9.-]+?)\.*(?::[0-9]+)?(?:[/#]|$)", 1))
    port = F.regexp_extract(url, r"^https://[A-Za-z0-9.-]+:0*([0-9]+)", 1)
    path = F.regexp_extract(url, r"^https://[^/?#]*(/[^?#]*)", 1)
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    fine = host.rlike(rf"^{label}(\.{label})+$") & ~host.rlike(r"(^|\.)(localhost|local|internal)$|^[0-9.]+$") & ~url.rlike(r"\?[^#]|[\\@\s]") & (F.char_length(url) <= 2048) & (port != "0")
    return F.when(fine, F.concat(F.lit("https://"), host, F.when(port.isin("", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path)))


def any_url_key(url: Column) -> Column:
    """``url_key``, with built-in functions wherever these can tell it, and Python for the others."""
    known = native_url_key(url)
    return F.coalesce(known, url_key(F.when(known.isNull() & url.startswith("https://"), url)))


def bounded_line(value: Column, most: int, least: int = 1) -> Column:
    """Printable, on one line, stripped, within a number of code points."""
    return F.coalesce(F.char_length(value).between(least, most) & ~value.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$|[\p{C}\p{Zl}\p{Zp}]"), F.lit(False))


def iso_date(text: Column) -> Column:
    """The date of a strict ISO calendar text, else null."""
    day = F.try_to_date(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)
