"""Personal data: format-preserving pseudonyms by keyed Feistel permutations. Native expressions only."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import free_name, named

ROUNDS = 10

# Repeated groups are bounded throughout: the engine goes one call deeper with each repetition.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:" + _LABEL + r"\.){1,126}[A-Za-z]{2,24}"
_TEN_DIGITS = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
_PHONE = _TEN_DIGITS + (
    r"|(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8,15}(?![ .()-]{0,2}\d))\d{1,3}(?:[ .-]\(?\d{1,12}\)?){1,5}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DATE = (
    r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:|(?![\w/-]))"
    r"|\d{1,2}/\d{1,2}/\d{4}(?![\w/-])|\d{1,2}\.\d{1,2}\.\d{4}(?![\w/-]))(?!\.\d)"
)
_IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)(?!\.\d)"
_IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}(?![\w:])(?!\.\d)"
_CARD = r"(?<!\w)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\w)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
PATTERN = "|".join((_EMAIL, _IBAN, _PHONE, _SSN, _DATE, _IP, _IPV6, _CARD))
KINDS = ("email", "phone", "ssn", "date", "ip", "card", "ipv6", "iban")

# 1900-01-01 to 2099-12-31 are 73,049 = 17 * 4,297 days.
_FIRST_DAY, _DAY_PARTS = "1900-01-01", (17, 4297)
# Social security numbers: areas 001-899 without 666, groups 01-99, serials 0001-9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _keyed(key: str, tweak: str, *parts: Column) -> Column:
    """A non-negative number below 2**60 from a keyed hash.

    The plan holds a key of the kind only, from which ``key`` cannot be told. Whoever reads plans or
    event logs can still undo pseudonyms, so those logs need the same care as the key.
    """
    own = hmac.new(key.encode(), tweak.encode(), hashlib.sha256).hexdigest()
    digest = F.sha2(F.concat_ws(":", F.lit(own), *[part.cast("string") for part in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(number: Column, left: Column | int, right: Column | int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1; the two moduli need not be equal.

    Each round adds a keyed function of one half to the other, which can be undone whatever the
    function is, so different numbers stay different and equal ones equal.
    """
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))
    start = F.struct(F.call_function("div", number, right).alias("l"), (number % right).alias("r"))

    def one(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        changed = F.when(even, (state["l"] + _keyed(key, tweak, turn, state["r"])) % left).otherwise(
            (state["r"] + _keyed(key, tweak, turn, state["l"])) % right
        )
        return F.struct(
            F.when(even, changed).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise(changed).alias("r")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda state: state["l"] * right + state["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(mask: Column, digits: Column) -> Column:
    """``mask`` with its digits replaced by those of ``digits`` in order."""
    filled = F.aggregate(
        F.split(mask, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda state, c: F.when(
            c.rlike("^[0-9]$"),
            F.struct(
                F.concat(state["out"], F.substring(digits, state["at"], F.lit(1))).alias("out"),
                (state["at"] + 1).alias("at"),
            ),
        ).otherwise(F.struct(F.concat(state["out"], c).alias("out"), state["at"].alias("at"))),
    )
    return filled["out"]


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _checked_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is not doubled."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )


def valid_card(value: Column) -> Column:
    return _checked_sum(_digits(value)) % 10 == 0


def _power(exponent: Column) -> Column:
    return F.rpad(F.lit("1"), exponent + 1, "0").cast("long")


def _card(value: Column, key: str) -> Column:
    """All digits but the check digit are permuted; the check digit follows them, so the result is valid."""
    digits = _digits(value)
    width = F.char_length(digits) - 1
    half = F.call_function("div", width, F.lit(2)).cast("int")
    body = feistel(
        F.substring(digits, F.lit(1), width).cast("long"), _power(half), _power(width - half), key, "card"
    )
    text = _padded(body, width)
    check = (10 - _checked_sum(F.concat(text, F.lit("0"))) % 10) % 10
    return _fill(value, F.concat(text, check.cast("string")))


def _country(value: Column) -> Column:
    """Digits of a phone number before its last ten, or before its first gap where groups vary."""
    digits = _digits(value)
    fixed = value.rlike(f"^(?:{_TEN_DIGITS})$") | ~F.startswith(value, F.lit("+"))
    lead = F.regexp_extract(value, r"^\+(\d+)", 1)
    return F.when(fixed, F.substring(digits, F.lit(1), F.char_length(digits) - 10)).otherwise(lead)


def valid_phone(value: Column) -> Column:
    """8 to 15 digits, and not one digit all over. Numbering plans are not consulted."""
    digits = _digits(value)
    number = F.substring(digits, F.char_length(_country(value)) + 1, F.lit(15))
    return F.char_length(digits).between(8, 15) & (F.char_length(number) >= 6) & ~number.rlike(r"^(\d)\1*$")


def _phone(value: Column, key: str) -> Column:
    digits, country = _digits(value), _country(value)
    width = F.char_length(digits) - F.char_length(country)
    half = F.call_function("div", width, F.lit(2)).cast("int")
    number = F.substring(digits, F.char_length(country) + 1, width).cast("long")
    hidden = feistel(number, _power(half), _power(width - half), key, "phone")
    return _fill(value, F.concat(country, _padded(hidden, width)))


def _ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    return tuple(F.split_part(value, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))


def valid_ssn(value: Column) -> Column:
    area, group, serial = _ssn_parts(value)
    return (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(value)
    place = area - 1 - (area > 666).cast("long")
    number = feistel((place * _GROUPS + group - 1) * _SERIALS + serial - 1, _AREAS * _GROUPS, _SERIALS, key, "ssn")
    rest, serial = F.call_function("div", number, F.lit(_SERIALS)), number % _SERIALS + 1
    place, group = F.call_function("div", rest, F.lit(_GROUPS)), rest % _GROUPS + 1
    area = place + 1 + (place + 1 >= 666).cast("long")
    return F.concat_ws("-", _padded(area, 3), _padded(group, 2), _padded(serial, 4))


def valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.cast("int") < 256)


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))
    mixed = feistel(number, 1 << 16, 1 << 16, key, "ip")
    parts = [F.pmod(F.shiftright(mixed, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


# Separator, and the places of year, month and day between two of them.
_FORMATS = (("-", (1, 2, 3)), ("/", (3, 1, 2)), (".", (3, 2, 1)))


def _parsed(value: Column) -> Column:
    day = F.lit(None).cast("date")
    for mark, places in _FORMATS:
        # Through the calendar, so that 31 February is no date.
        parts = [F.split_part(value, F.lit(mark), F.lit(place)) for place in places]
        iso = F.concat_ws("-", parts[0], *[F.lpad(part, 2, "0") for part in parts[1:]])
        day = F.when(F.contains(value, F.lit(mark)), iso.try_cast("date")).otherwise(day)
    return day


def valid_date(value: Column) -> Column:
    day = _parsed(value)
    return day.isNotNull() & (F.year(day) >= 1900) & (F.year(day) <= 2099)


def _date(value: Column, key: str) -> Column:
    """Another day in the same form; months and days keep their zeros unless the original leaves them out."""
    days = F.datediff(_parsed(value), F.to_date(F.lit(_FIRST_DAY))).cast("long")
    day = F.date_add(F.to_date(F.lit(_FIRST_DAY)), feistel(days, *_DAY_PARTS, key, "date").cast("int"))
    shown = F.date_format(day, "yyyy-MM-dd")
    for mark, long_form, short_form in (("/", "MM/dd/yyyy", "M/d/yyyy"), (".", "dd.MM.yyyy", "d.M.yyyy")):
        whole = F.when(F.char_length(value) == 10, F.date_format(day, long_form)).otherwise(F.date_format(day, short_form))
        shown = F.when(F.contains(value, F.lit(mark)), whole).otherwise(shown)
    return shown


def valid_ipv6(value: Column) -> Column:
    """Eight groups, or fewer around one double colon."""
    groups = F.size(F.split(value, ":"))
    double = F.char_length(F.regexp_replace(value, "::", ":")) == F.char_length(value) - 1
    return ((groups == 8) & ~F.contains(value, F.lit("::"))) | (double & (groups <= 8) & (groups >= 3))


_CLASSES = (("a", 26, "^[a-z]$"), ("A", 26, "^[A-Z]$"), ("0", 10, "^[0-9]$"))


def _moved(text: Column, key: str, tweak: str, classes: tuple = _CLASSES) -> Column:
    """Characters move within their class, each half by keyed amounts that hang on the other half."""
    letters = F.split(text, "")
    size = F.call_function("div", F.size(letters) + 1, F.lit(2)).cast("int")
    start = F.struct(
        F.slice(letters, 1, size).alias("l"), F.slice(letters, size + 1, F.size(letters) - size).alias("r")
    )

    def moved(half: Column, other: Column, turn: Column) -> Column:
        def shift(c: Column, i: Column) -> Column:
            by = _keyed(key, tweak, turn, i, F.array_join(other, ""))
            found = c
            for first, count, pattern in classes:
                within = F.char((F.ascii(c) - ord(first) + by) % count + ord(first))
                found = F.when(c.rlike(pattern), within).otherwise(found)
            return found

        return F.transform(half, shift)

    def one(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, moved(state["l"], state["r"], turn)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(moved(state["r"], state["l"], turn)).alias("r"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), start, one, lambda state: F.array_join(F.concat(state["l"], state["r"]), "")
    )


def _ipv6(value: Column, key: str) -> Column:
    """Decimal digits move among themselves and so do the letters of either case; colons stay."""
    return _moved(value, key, "ipv6", (("a", 6, "^[a-f]$"), ("A", 6, "^[A-F]$"), ("0", 10, "^[0-9]$")))


def _rest_of(text: Column, modulus: int) -> Column:
    """The remainder of a number written in digits and letters (A is 10, Z is 35)."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("long"),
        lambda rest, c: F.when(c.rlike("^[0-9]$"), (rest * 10 + (F.ascii(c) - 48)) % modulus).otherwise(
            (rest * 100 + (F.ascii(c) - 55)) % modulus
        ),
    )


def valid_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    return (F.char_length(plain) <= 34) & (_rest_of(turned, 97) == 1)


def _iban(value: Column, key: str) -> Column:
    """The account's letters and digits move within their class; the check digits follow them."""
    plain = F.replace(value, F.lit(" "))
    country = F.substring(plain, 1, 2)
    account = _moved(F.substring(plain, 5, 30), key, "iban")
    check = 98 - _rest_of(F.concat(account, country, F.lit("00")), 97)
    whole = F.concat(country, _padded(check, 2), account)
    groups = F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")
    return F.when(F.contains(value, F.lit(" ")), groups).otherwise(whole)


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the local part move within their class; the host stays."""
    hidden = _moved(F.split_part(value, F.lit("@"), F.lit(1)), key, "email")
    return F.concat(hidden, F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))


def _kind(value: Column) -> Column:
    """The kind of a match, null if its number or date is not valid."""
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(f"^(?:{_IBAN})$"), F.when(valid_iban(value), "iban"))
        .when(value.rlike(f"^(?:{_SSN})$"), F.when(valid_ssn(value), "ssn"))
        .when(value.rlike(f"^(?:{_DATE})$"), F.when(valid_date(value), "date"))
        .when(value.rlike(f"^(?:{_IP})$"), F.when(valid_ip(value), "ip"))
        .when(value.rlike(f"^(?:{_IPV6})$"), F.when(valid_ipv6(value), "ipv6"))
        .when(value.rlike(f"^(?:{_CARD})$"), F.when(valid_card(value), "card"))
        .otherwise(F.when(valid_phone(value), "phone"))
    )


_PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "ipv6": _ipv6,
    "iban": _iban,
    "phone": _phone,
    "ssn": _ssn,
    "date": _date,
    "ip": _ip,
    "card": _card,
}


def pseudonymise(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_<kind> for each kind, found.

    ``found`` lists (kind, original, pseudonym) in text order. Equal values become equal pseudonyms in every
    document, since each is a permutation of its format under ``key``; an IPv6 address is linked as it is
    spelt. What fails its check stays as it is: Luhn sums of cards, remainders of IBANs, the calendar
    (1900 to 2099), ranges of address and social security numbers, the number of digits of phones.

    Forms: dates 2024-05-01 (also before a time), 5/1/2024 (month first) and 1.5.2024 (day first); cards
    of 13 to 19 digits, in fours, or as 4-6-4 and 4-6-5; phones with ``+`` and groups, or three, three and
    four digits; IPv4, IPv6 without an IPv4 tail; IBANs in one piece or in fours; e-mail addresses of up to
    126 labels, whose hosts and letters beyond a-z stay. Other forms, names and addresses are not looked for.

    A null text stays null with no findings; empty texts, repeated rows and rows without id are treated one
    by one, and an empty table gives no rows. Texts of any length are searched whole; no pattern's depth
    grows with them. Columns other than the two named are left out, whatever their names. Nothing is
    shuffled, and texts without a digit or an at-sign are not searched.
    """
    text = named(text_column)
    source = docs.select(named(id_column).alias("doc_id"), text.cast("string").alias("text"))
    none = F.expr("cast(array() as array<struct<kind:string,original:string,pseudonym:string>>)")

    def entry(value: Column) -> Column:
        kind = _kind(value)
        hidden = value
        for name, pseudonym in _PSEUDONYMS.items():
            hidden = F.when(kind == name, pseudonym(value, key)).otherwise(hidden)
        return F.struct(kind.alias("kind"), value.alias("original"), hidden.alias("pseudonym"))

    suspicious = F.regexp_like("text", F.lit("[0-9@]"))
    pattern = F.lit(PATTERN)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    entries, gaps = free_name(source, "entries"), free_name(source, "gaps")
    found = source.withColumn(entries, F.when(suspicious, F.transform(matches, entry)).otherwise(none)).withColumn(
        gaps, F.when(F.size(entries) > 0, F.split("text", PATTERN, -1))
    )
    shown = F.array_append(F.transform(entries, lambda e: e["pseudonym"]), F.lit(""))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, shown, lambda gap, value: F.array(gap, value))), "")
    kept = F.filter(F.coalesce(entries, none), lambda e: e["kind"].isNotNull())

    def count(kind: str) -> Column:
        return F.size(F.filter(entries, lambda e: e["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        F.when(named(gaps).isNotNull(), rebuilt).otherwise(F.col("text")).alias("text"),
        *[F.greatest(count(kind), F.lit(0)).alias(f"n_{kind}") for kind in KINDS],
        kept.alias("found"),
    )
