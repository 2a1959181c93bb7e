"""PII: format-preserving Feistel pseudonyms (native: DataFrame functions only).

Values are found by one pattern, validated (Luhn, mod 97, calendar, octet and numbering-plan ranges) and replaced by a
keyed permutation within their format, so the pseudonym of a card is a card, that of a date a date. A value becomes symbols
with a radix each (a digit 10, an octet 256, a day of the 400-year calendar cycle 189 * 773 in two symbols). The symbols
are dealt into two halves; in each round every symbol of one half is shifted, modulo its radix, by a keyed hash of the other
half. Each round can be undone, so this is a permutation of the format: equal values get equal pseudonyms in every
document and different values different ones. Check digits are left out and computed anew. Who has the key can invert.

Kinds: mail address (local part; letters of all scripts are part of it, those outside ASCII stay), phone number (North American plan, international with or
without separators, or an area code and a subscriber's number, which alone is permuted), payment card, IBAN, social security number, IPv4 address, IPv6
address of eight groups, date (ISO, day/month/year or month/day/year with slashes, or with dots), access key, token known by its start, and assigned
secret. What fails its validation stays: a number without separators and + has none, and a date outside the years 1000 to 9799 is none. The
text goes through no shuffle and is read once; texts without a digit, @, = or : are passed through. The key must be given: who has it can invert.

Equal dates are linked in whatever form they are written. A date that can only be month/day/year (its day is over 12) is read as that, any other with
slashes as day/month/year, and no permutation crosses from one to the other, so the form of a pseudonym tells how to invert it. Where small numbers have one
digit, a pseudonym may have two; its inverse is the date, not the number of digits. So for groups of an IPv6 address with leading zeros. Patterns repeat groups
a bounded number of times, so no text makes the regular expression engine recurse far.

Edge cases: a null text stays null, with no values; empty and very long texts are ordinary; repeated rows get equal results;
a local part of a mail address of over 512 characters is none. An empty table gives no rows. Other columns
stay, whatever their names; one named n_values is replaced by the count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import table

ROUNDS = 8
DEMO_KEY = "provena demonstration key"

MAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,511}+@(?:[\p{L}\p{N}-]{1,63}\.){1,40}\p{L}{2,63}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
DAY_DATE = r"[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])"
#: The same in small letters; addresses of eight groups; numbers of which only the subscriber's part is not grouped; tokens known by how they start.
LOW_IBAN = r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"
LOCAL = r"(?:\+[1-9][0-9]{0,2}[ ./-]?(?:\(0\) ?)?[1-9][0-9]{1,3}|0[1-9][0-9]{1,3})[ /-][0-9]{5,9}(?![0-9])"
TOKEN = r"(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-)[0-9A-Za-z_-]{16,255}(?![0-9A-Za-z_-])"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])"
E164 = r"\+[1-9][0-9]{7,14}(?![0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ACCESS = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[0-9A-Za-z_+/-]{8,64}(?![0-9A-Za-z_+/-])"
ANY = r"(?<![0-9A-Za-z])(?:" + "|".join([MAIL, ACCESS, TOKEN, SECRET, IPV6, IBAN, LOW_IBAN, ISO_DATE, DAY_DATE.replace(r"([/.])", r"(?<sep>[/.])").replace(r"\1", r"\k<sep>"), IPV4, SSN, E164, CARD, PHONE, LOCAL]) + ")"
#: Days from 1800-01-01 of one calendar cycle of 400 years: 146097, of which to the 12th of a month 57600 = 240 * 240, and after it 88497 = 9 * 9833.
FIRST_DAY, CYCLE, EARLY_RADIX, LATE_RADIX = "1800-01-01", 146_097, (240, 240), (9, 9833)
#: Cycles before and after that of the first day whose years have four digits.
CYCLES = (-2, 19)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _split(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def feistel(symbols: Column, radix: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """The symbols (array of long, each below its radix) permuted."""
    n = F.size(symbols)
    half = F.floor(n / 2).cast("int")
    left, right = (lambda a: F.slice(a, F.lit(1), half)), (lambda a: F.slice(a, half + 1, n - half))

    def shifted(target: Column, other: Column, radices: Column, r: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        digest, most = F.sha2(seed, 512), 32  # shifts in a digest; further ones come from digests with the number of their own
        shift = lambda i: F.when(i < most, F.substr(digest, 4 * i + 1, F.lit(4))).otherwise(F.substr(F.sha2(F.concat_ws("|", seed, F.floor(i / most).cast("string")), 512), 4 * (i % most) + 1, F.lit(4)))
        return F.transform(target, lambda x, i: F.pmod(x + (-1 if inverse else 1) * F.conv(shift(i), 16, 10).cast("long"), F.get(radices, i)))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        a = F.when(even, shifted(acc["a"], acc["b"], left(radix), r)).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(shifted(acc["b"], acc["a"], right(radix), r))
        return F.struct(a.alias("a"), b.alias("b"))

    order = F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])
    return F.aggregate(order, F.struct(left(symbols).alias("a"), right(symbols).alias("b")), step, lambda acc: F.concat(acc["a"], acc["b"]))


def _refilled(v: Column, digits: Column) -> Column:
    """The digits in the places that v has digits."""
    return F.array_join(F.transform(_split(v), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.char_length(_digits(F.substr(v, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _by_class(v: Column, kind: str, key: str, inverse: bool) -> Column:
    """Digits, small and capital letters permuted within their class, all else in its place."""
    low = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c))
    wide = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")
    chars = _split(v)
    new = feistel(F.transform(chars, lambda c: (F.ascii(c) - low(c)).cast("long")), F.transform(chars, wide), kind, key, inverse)
    return F.array_join(F.zip_with(chars, new, lambda c, x: F.when(c.rlike("[0-9a-zA-Z]"), F.char(low(c) + x)).otherwise(c)), "")


def _numbers(digits: Column) -> Column:
    return F.transform(_split(digits), lambda c: c.cast("long"))


def _luhn_sum(digits: Column) -> Column:
    """Sum of a number whose last digit is not doubled."""
    d = F.reverse(_numbers(digits))
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def _tens(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(10).cast("long"))


def _card(v: Column, key: str, inverse: bool) -> Column:
    d = _digits(v)
    body = F.substr(d, F.lit(2), F.char_length(d) - 2)
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), F.array_join(feistel(_numbers(body), _tens(F.char_length(body)), "card", key, inverse), ""))
    check = F.pmod(10 - _luhn_sum(F.concat(new, F.lit("0"))) % 10, F.lit(10))
    return F.when((_luhn_sum(d) % 10 == 0) & d.rlike("[1-9]"), _refilled(v, F.concat(new, check.cast("string"))))


def _phone(v: Column, key: str, inverse: bool) -> Column:
    """A number of the North American plan within the plan, one that only looks like it (+1 and ten digits) outside of it; others behind their country code."""
    d, plus = _digits(v), v.startswith("+")
    valid, alike = d.rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), d.rlike("^1[0-9]{10}$")
    national = _numbers(F.right(d, F.lit(10)))
    # where the plan asks for 2 to 9 such a digit stays one, and 0 or 1 stays 0 or 1
    led = lambda i: (i == 0) | (i == 3)
    lows = F.transform(national, lambda x, i: F.when(led(i) & (x > 1), 2).otherwise(0).cast("long"))
    radix = F.transform(national, lambda x, i: F.when(~led(i), 10).when(x > 1, 8).otherwise(2).cast("long"))
    new = F.array_join(F.zip_with(feistel(F.zip_with(national, lows, lambda x, b: x - b), radix, "phone", key, inverse), lows, lambda x, b: x + b), "")
    within = _refilled(v, F.concat(F.substr(d, F.lit(1), F.char_length(d) - 10), new))
    code = F.char_length(F.regexp_extract(v, r"^\+([0-9]{1,3})[ .(-]", 1))
    code = F.when(code > 0, code).otherwise(3)
    rest = F.substr(d, code + 1, F.char_length(d) - code)
    abroad = _refilled(v, F.concat(F.substr(d, F.lit(1), code), F.array_join(feistel(_numbers(rest), _tens(F.char_length(rest)), "phone+", key, inverse), "")))
    return F.when(F.when(plus, alike).otherwise(valid), within).when(plus & F.char_length(d).between(8, 15), abroad)


def _ipv4(v: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    radix = F.array(F.lit(255), F.lit(256), F.lit(256), F.lit(256)).cast("array<bigint>")
    moved = F.transform(octets, lambda x, i: F.when(i == 0, x - 1).otherwise(x))
    new = F.transform(feistel(moved, radix, "ipv4", key, inverse), lambda x, i: F.when(i == 0, x + 1).otherwise(x))
    return F.when(F.forall(octets, lambda x: x <= 255) & (F.get(octets, 0) > 0), F.array_join(new, "."))


def _ssn(v: Column, key: str, inverse: bool) -> Column:
    p = F.transform(F.split(v, "-"), lambda x: x.cast("long"))
    area, group, serial = (F.get(p, i) for i in range(3))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = feistel(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)).cast("array<bigint>"), "ssn", key, inverse)
    back = F.get(new, 0)
    return F.when(fine, F.format_string("%03d-%02d-%04d", F.when(back >= 665, back + 2).otherwise(back + 1), F.get(new, 1) + 1, F.get(new, 2) + 1))


def _moved(n: Column, radix: tuple[int, int], kind: str, key: str, inverse: bool) -> Column:
    """A number below the product of two radices permuted."""
    new = feistel(F.array(F.floor(n / radix[1]).cast("long"), n % radix[1]), F.array(*[F.lit(x) for x in radix]).cast("array<bigint>"), kind, key, inverse)
    return F.get(new, 0) * radix[1] + F.get(new, 1)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is named: the value is the element of an array."""
    return F.get(F.transform(F.array(value), of), 0)


#: Forms of dates: what they look like, day first, and month first where the day is over 12. Numbers may have one digit where the form says so.
FORMS = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", None), (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy", "MM/dd/yyyy"), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy", "M/d/yyyy"),
    (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "dd.MM.yyyy", None), (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy", None),
)


def _date(v: Column, key: str, inverse: bool) -> Column:
    """The date that stands for one, in the same form; null if it is none.

    A date keeps its cycle of 400 years. Days to the 12th are permuted among themselves, numbered by month and day, and so are
    those after it, numbered in order; so one permutation holds for all forms, and a month/day/year stays one that cannot be a day/month/year."""
    first = F.lit(FIRST_DAY).cast("date")
    day_first, month_first = (F.coalesce(*[F.when(v.rlike(f"^(?:{form[0]})$"), F.lit(form[k])) for form in FORMS]) for k in (1, 2))
    parsed = F.struct(*[F.try_to_timestamp(v, form).cast("date").alias(name) for name, form in (("a", day_first), ("b", month_first))])
    read = _let(parsed, lambda p: F.when(p["a"].isNotNull(), F.struct(p["a"].alias("day"), day_first.alias("form"))).when(F.dayofmonth(p["b"]) > 12, F.struct(p["b"].alias("day"), month_first.alias("form"))))

    def numbered(r: Column) -> Column:
        whole = F.datediff(r["day"], first).cast("long")
        at = F.floor(whole / CYCLE).cast("long")
        months = 12 * (F.year(r["day"]) - 1800 - 400 * at) + F.month(r["day"])  # to the end of its own
        return F.struct(F.pmod(whole, F.lit(CYCLE)).alias("n"), at.alias("at"), months.cast("long").alias("months"), F.dayofmonth(r["day"]).cast("long").alias("of_month"), r["form"].alias("form"))

    def after_early(moved: Column) -> Column:
        return (F.datediff(F.add_months(first, F.floor(moved / 12).cast("int")), first) + moved % 12).cast("long")

    def after_late(moved: Column) -> Column:
        """Days from the first one. The month that holds the number is next to the one it would be in if all were of equal length."""
        guess = F.floor(moved * 4800 / (LATE_RADIX[0] * LATE_RADIX[1])).cast("int")
        before = lambda m: (F.datediff(F.add_months(first, m), first) - 12 * m).cast("long")
        month = F.array_max(F.filter(F.sequence(F.greatest(guess - 3, F.lit(0)), F.least(guess + 3, F.lit(4799))), lambda m: before(m) <= moved))
        return (moved + 12 * (month + 1)).cast("long")

    def replaced(d: Column) -> Column:
        early = _let(_moved(12 * (d["months"] - 1) + d["of_month"] - 1, EARLY_RADIX, "early date", key, inverse), after_early)
        late = _let(_moved(d["n"] - 12 * d["months"], LATE_RADIX, "late date", key, inverse), after_late)
        day = F.date_add(first, (d["at"] * CYCLE + F.when(d["of_month"] > 12, late).otherwise(early)).cast("int"))
        return F.when(d["at"].between(*CYCLES), F.call_function("date_format", day, d["form"]))

    return _let(_let(read, numbered), replaced)


def _subscriber(v: Column, key: str, inverse: bool) -> Column:
    """A number whose last digits are permuted; what is before their separator stays."""
    last = F.regexp_extract(v, "([0-9]+)$", 1)
    return F.concat(F.substr(v, F.lit(1), F.char_length(v) - F.char_length(last)), F.array_join(feistel(_numbers(last), _tens(F.char_length(last)), "subscriber", key, inverse), ""))


def _ipv6(v: Column, key: str, inverse: bool) -> Column:
    """Groups permuted as numbers and written with as many digits at least as they had, in the case of the value."""
    groups = F.split(F.lower(v), ":")
    new = feistel(F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")), F.transform(groups, lambda g: F.lit(65_536).cast("long")), "ipv6", key, inverse)
    out = F.array_join(F.transform(new, lambda x: F.lower(F.hex(x))), ":")
    return F.when(v == F.upper(v), F.upper(out)).otherwise(out)


def _mod97(text: Column) -> Column:
    """Of digits and capital letters read as two digits each."""
    return F.aggregate(_split(text), F.lit(0).cast("long"), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + c.cast("long")) % 97).otherwise((acc * 100 + (F.ascii(c) - 55).cast("long")) % 97))


def _iban(v: Column, key: str, inverse: bool) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    head, body = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.char_length(flat))
    new = _by_class(body, "iban", key, inverse)
    check = F.format_string("%02d", 98 - _mod97(F.concat(new, head, F.lit("00"))))
    whole = F.concat(head, check, new)
    spaced = F.array_join(F.transform(_split(v), lambda c, i: F.when(c == " ", c).otherwise(F.substr(whole, F.char_length(F.replace(F.substr(v, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.when(F.char_length(flat).between(15, 34) & (_mod97(F.concat(body, F.substr(flat, F.lit(1), F.lit(4)))) == 1), spaced)


def pseudonym(v: Column, key: str, inverse: bool = False) -> Column:
    """What stands for a value that ANY matched; the value itself if it fails its validation."""
    whole: Callable[[str], Column] = lambda p: v.rlike(f"^(?:{p})$")
    at = F.instr(v, "@")
    mail = F.concat(_by_class(F.substr(v, F.lit(1), at - 1), "mail", key, inverse), F.substr(v, at, F.char_length(v)))
    lead = F.char_length(F.regexp_extract(v, r"^([^=:]*[=:][ \t]*[\"']?)", 1))
    secret = F.concat(F.substr(v, F.lit(1), lead), _by_class(F.substr(v, lead + 1, F.char_length(v)), "secret", key, inverse))
    access = F.concat(F.substr(v, F.lit(1), F.lit(4)), _by_class(F.substr(v, F.lit(5), F.lit(16)), "access", key, inverse))
    head = F.char_length(F.regexp_extract(v, "^(gh[pousr]_|github_pat_|sk-|xox[abprs]-)", 1))
    token = F.concat(F.substr(v, F.lit(1), head), _by_class(F.substr(v, head + 1, F.char_length(v)), "token", key, inverse))
    new = (
        F.when(whole(MAIL), mail).when(whole(ACCESS), access).when(whole(TOKEN), token).when(whole(SECRET), secret).when(whole(IPV6), _ipv6(v, key, inverse))
        .when(whole(IBAN), _iban(v, key, inverse)).when(whole(LOW_IBAN), F.lower(_iban(F.upper(v), key, inverse)))
        .when(whole("|".join(form[0] for form in FORMS)), _date(v, key, inverse)).when(whole(IPV4), _ipv4(v, key, inverse))
        .when(whole(SSN), _ssn(v, key, inverse)).when(whole(E164), _phone(v, key, inverse)).when(whole(CARD), F.coalesce(_card(v, key, inverse), F.when(v.rlike(PHONE), _phone(v, key, inverse)))).when(whole(PHONE), F.coalesce(_phone(v, key, inverse), F.when(v.rlike(f"^(?:{LOCAL})$"), _subscriber(v, key, inverse)))).when(whole(LOCAL), _subscriber(v, key, inverse))
    )
    return F.coalesce(new, v)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and n_values, how many were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_body"))
    body = F.col("_body")
    out = whole.withColumn("_found", F.when(body.rlike("[0-9@=:]"), F.regexp_extract_all(body, F.lit(ANY), F.lit(0))))
    out = out.withColumn("_new", F.transform("_found", lambda v: pseudonym(v, key, inverse)))
    new = F.zip_with(F.split(body, ANY), "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.zip_with("_found", "_new", lambda a, b: (a != b).cast("long"))
    n = F.coalesce(F.aggregate(changed, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))
    replaced = F.when(F.size("_found") > 0, F.array_join(new, "")).otherwise(body)
    rest = [(replaced if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c != "n_values"]
    return out.select(*rest, n.alias("n_values"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the session's key; without one under the demonstration key, which is public and hides nothing from who knows it."""
    return pseudonymised(table(spark, sf_dir, "documents", "doc_id", "text"), spark.conf.get("spark.provena.pii.key", DEMO_KEY))
