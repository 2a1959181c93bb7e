"""Categories of private content in a text (built-in regular expressions; ASCII word boundaries as look-arounds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 5 * 1024 * 1024
#: Paths of home folders, credentials, markers of private keys, fields of JSON records, generic names that give nothing away.
HOME = r"(?i)[a-z]:[\\/](?:Users|Documents and Settings)[\\/][^\\/\s]|/(?:Users|home)/[^/\s]"
TOKEN = r"github_pat_[A-Za-z0-9_]{20}|gh[pousr]_[A-Za-z0-9]{20}|sk-[A-Za-z0-9_-]{20}|AKIA[A-Z0-9]{16}"
KEY_MARKERS = ("-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----")
ZONE_FIELDS, PLATFORM_FIELDS = ("timezone",), ("platform_details", "os_description")
ZONES = ("utc", "etc/utc", "gmt", "z")
PLATFORMS = ("aix", "darwin", "freebsd", "linux", "netbsd", "openbsd", "testos", "unknown", "windows")

#: ASCII word boundaries.
B, E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def _field(names: tuple[str, ...]) -> str:
    """The value of a JSON field of one of these names."""
    return rf'(?i)"(?:{"|".join(names)})"\s*:\s*"([^"]+)"'


MAIL = rf"(?i){B}[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}{E}"
#: Offsets from UTC, written behind its name or a time; the group has the hours and minutes.
OFFSETS = (rf"(?i){B}(?:UTC|GMT)\s*[+-]\s*([0-9]{{1,2}}(?::?[0-9]{{2}})?){E}", rf"{B}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}}(?:\.[0-9]+)?)?[+-]([0-9]{{2}}:?[0-9]{{2}}){E}")
#: Four numbers with points between them that are no part of a longer one.
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"


def address_number(text: Column) -> Column:
    """An IPv4 address as a number; null if an octet is over 255 or has a leading zero."""
    octets = F.split(text, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(F.forall(octets, lambda x: (x.cast("long") <= 255) & ((x == "0") | ~x.startswith("0"))), number)


def private_address(number: Column) -> Column:
    """10/8, 172.16/12, 192.168/16, 100.64/10 or link-local; loopback is none."""
    net = lambda a, b, bits: number.between((a << 24) + (b << 16), (a << 24) + (b << 16) + (1 << (32 - bits)) - 1)
    return F.coalesce(net(10, 0, 8) | net(172, 16, 12) | net(192, 168, 16) | net(100, 64, 10) | net(169, 254, 16), F.lit(False))


def addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))


def _any(text: Column, pattern: str, is_finding) -> Column:
    """Whether a group of some match is a finding; matches are taken out only of the few texts that have any."""
    return F.when(text.rlike(pattern), F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), is_finding)).otherwise(False)


def categories(text: Column, allowed_mail: str | None = None) -> Column:
    """Sorted categories found; ``allowed_mail`` is a pattern of addresses that are no finding. Null text: none."""
    body = F.coalesce(text, F.lit(""))
    foreign = body.rlike(MAIL) if allowed_mail is None else _any(body, f"({MAIL})", lambda x: ~F.lower(x).rlike(allowed_mail))
    other_than = lambda known: lambda x: ~F.lower(F.trim(x)).isin(*known)
    zone = _any(body, _field(ZONE_FIELDS), other_than(ZONES))
    for offset in OFFSETS:
        zone = zone | _any(body, offset, lambda x: x.rlike("[1-9]"))
    rules = [
        ("absolute_user_home_path", body.rlike(HOME)),
        ("credential_token_shape", body.rlike(TOKEN)),
        ("exact_host_platform_metadata", _any(body, _field(PLATFORM_FIELDS), other_than(PLATFORMS))),
        ("local_timezone_metadata", zone),
        ("non_noreply_email", body.contains("@") & foreign),
        ("private_key_material", body.contains(KEY_MARKERS[0]) | body.contains(KEY_MARKERS[1])),
        ("private_or_cgnat_network_address", _any(body, f"({IPV4})", lambda x: private_address(address_number(x)))),
    ]
    return F.filter(F.array(*[F.when(rule, name) for name, rule in rules]), lambda x: x.isNotNull())


def scannable(data: Column) -> Column:
    """Within the size limit and without NUL; what is not must be reported, never skipped in silence."""
    return (F.octet_length(data) <= MAX_BYTES) & ~data.cast("string").contains("\x00")
