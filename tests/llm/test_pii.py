import hashlib
import hmac
import re
from datetime import date, timedelta

import pyspark.sql.functions as F
import pytest
from conftest_llm import empty

from segmart.llm import pii

KEY = "test"


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def hide(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("left", "right"), [(17, 4297), (10, 100), (1, 7), (16, 16)])
def test_feistel_is_a_permutation(spark, left, right):
    size = left * right
    found = [r[0] for r in spark.range(size).select(pii.feistel(F.col("id"), left, right, KEY, "t")).collect()]
    assert sorted(found) == list(range(size))


def test_formats_and_checks_hold(spark):
    (row,) = hide(
        spark,
        "bob.smith99@mail7.example.com +1 (017) 555-7713 97.51.17.173. 4845168114407329 4111 1111 1111 1111 "
        "123-45-6789 1987-02-28 12/31/1999 31.12.2001",
    )
    by_kind = {}
    for f in row.found:
        by_kind.setdefault(f.kind, []).append((f.original, f.pseudonym))
    shape = lambda text: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text))
    assert {kind: len(found) for kind, found in by_kind.items()} == {"email": 1, "phone": 1, "ip": 1, "card": 2, "ssn": 1, "date": 3}
    for kind, found in by_kind.items():
        for original, pseudonym in found:
            assert original != pseudonym and original not in row.text and pseudonym in row.text
            if kind != "ip":
                assert shape(original) == shape(pseudonym)
    assert all(luhn(p) for _, p in by_kind["card"])
    assert all(0 <= int(part) < 256 for part in by_kind["ip"][0][1].split("."))
    area, group, serial = map(int, by_kind["ssn"][0][1].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial
    date.fromisoformat(by_kind["date"][0][1])


def test_invalid_values_stay(spark):
    text = "4845168114407328 02/30/1990 300.1.1.1 000-12-3456 666-12-3456 v1.2.3.4 12345 2020"
    (row,) = hide(spark, text)
    assert row.text == text and row.found == []


def test_equal_values_stay_linked(spark):
    a, b = hide(spark, "write to bob@example.com on 1987-02-28", "bob@example.com was born 1987-02-28, 4111111111111111")
    assert {f.original: f.pseudonym for f in a.found}.items() <= {f.original: f.pseudonym for f in b.found}.items()


def test_edges(edges):
    rows = pii.pseudonymise(edges, KEY).collect()
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in edges.collect())
    assert pii.pseudonymise(empty(edges), KEY).count() == 0


def test_whole_long_text(spark):
    text = ("plain words " * 50_000) + "bob@example.com"
    (row,) = hide(spark, text)
    assert row.n_email == 1 and row.text.endswith("@example.com") and not row.text.endswith(" bob@example.com")


def rest97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def test_more_forms(spark):
    values = [
        "2024-05-01", "5/1/2024", "1.5.2024", "3782 822463 10005", "3782-822463-10005", "+44 20 7946 0958", "+49 (30) 1234567",
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000",
    ]
    kinds = ["date"] * 3 + ["card"] * 2 + ["phone"] * 2 + ["ipv6"] * 2 + ["iban"] * 2
    (row,) = hide(spark, "at " + values[0] + "T10:00, " + " and ".join(values[1:]) + ".")
    assert [(f.kind, f.original) for f in row.found] == list(zip(kinds, values))
    hidden = [f.pseudonym for f in row.found]
    assert "T10:00" in row.text and all(v not in row.text and h in row.text for v, h in zip(values, hidden))
    date.fromisoformat(hidden[0])
    month, day, year = map(int, hidden[1].split("/"))
    assert date.fromisoformat(hidden[0]) == date(year, month, day) == date(*map(int, hidden[2].split(".")[::-1]))
    assert luhn(hidden[3]) and hidden[3].replace(" ", "-") == hidden[4] and hidden[5].startswith("+44 ")
    assert all(rest97(h.replace(" ", "")) == 1 for h in hidden[9:]) and hidden[9].startswith("GB") and hidden[9][4] == " "
    shape = lambda text: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text)))
    assert all(shape(values[i]) == shape(hidden[i]) for i in (0, 3, 4, 5, 6, 7, 8, 9, 10))


def test_more_invalid_values_stay(spark):
    card = next(f for f in hide(spark, "+5 4111 1111 1111 1111 +1 2024-05-01")[0].found)
    assert (card.kind, card.original) == ("card", "4111 1111 1111 1111")
    text = "GB82 WEST 1234 5698 7654 33 +44 20 1 (999) 999-9999 1:2:3 13/13/2024 3782 822463 10006 10:30:45 a::b::c"
    (row,) = hide(spark, text)
    assert row.text == text and row.found == []


@pytest.mark.parametrize("labels", [3000, 50_000])
def test_hosts_of_very_many_labels(spark, labels):
    texts = ["x@" + "a." * labels + "com", "x@" + "a." * labels, "+1" + " 2" * labels, "1:" * labels]
    texts += ["1." * labels, "1-" * labels, "a@" * labels, "1" * labels, "." * labels + "@b.com", "bob@" + "a." * 120 + "com"]
    # Some of these are valid by chance.
    texts.append("AB12" + " CD34" * labels)
    *rows, email, ibans = hide(spark, *texts)
    assert [row.text for row in rows] == texts[:-2] and email.n_email == 1 and len(ibans.text) == len(texts[-1])


def plain_feistel(number, left, right, key, tweak):
    own = hmac.new(key.encode(), tweak.encode(), hashlib.sha256).hexdigest()
    a, b = divmod(number, right)
    for turn in range(pii.ROUNDS):
        other = b if turn % 2 == 0 else a
        by = int(hashlib.sha256(f"{own}:{turn}:{other}".encode()).hexdigest()[:15], 16)
        a, b = ((a + by) % left, b) if turn % 2 == 0 else (a, (b + by) % right)
    return a * right + b


def plain_moved(text, key, tweak, classes):
    own = hmac.new(key.encode(), tweak.encode(), hashlib.sha256).hexdigest()
    size = (len(text) + 1) // 2
    halves = [text[:size], text[size:]]
    for turn in range(4):
        mine, other = halves if turn % 2 == 0 else halves[::-1]
        out = ""
        for i, c in enumerate(mine):
            by = int(hashlib.sha256(f"{own}:{turn}:{i}:{other}".encode()).hexdigest()[:15], 16)
            first, count = next(((f, n) for f, n in classes if f <= c < chr(ord(f) + n)), (None, 0))
            out += chr((ord(c) - ord(first) + by) % count + ord(first)) if first else c
        halves[turn % 2] = out
    return "".join(halves)


def fill(mask, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in mask)


def plain(kind, value):
    """The pseudonym in plain Python."""
    digits = "".join(c for c in value if c.isdigit())
    every = (("a", 26), ("A", 26), ("0", 10))
    if kind == "email":
        local, host = value.split("@")
        return plain_moved(local, KEY, "email", every) + "@" + host
    if kind == "ipv6":
        return plain_moved(value, KEY, "ipv6", (("a", 6), ("A", 6), ("0", 10)))
    if kind == "iban":
        own = value.replace(" ", "")
        account = plain_moved(own[4:], KEY, "iban", every)
        whole = own[:2] + f"{98 - rest97(own[:2] + '00' + account):02}" + account
        return re.sub("(.{4})(?=.)", r"\1 ", whole) if " " in value else whole
    if kind == "card":
        width = len(digits) - 1
        half = width // 2
        body = str(plain_feistel(int(digits[:-1]), 10**half, 10 ** (width - half), KEY, "card")).zfill(width)
        return fill(value, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "phone":
        country = digits[:-10] if re.fullmatch(r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}|[^+].*", value) else re.match(r"\+(\d+)", value)[1]
        width = len(digits) - len(country)
        number = plain_feistel(int(digits[len(country) :]), 10 ** (width // 2), 10 ** (width - width // 2), KEY, "phone")
        return fill(value, country + str(number).zfill(width))
    if kind == "ip":
        number = plain_feistel(int.from_bytes(map(int, value.split("."))), 1 << 16, 1 << 16, KEY, "ip")
        return ".".join(map(str, number.to_bytes(4)))
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        number = plain_feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, KEY, "ssn")
        rest, serial = divmod(number, 9999)
        area, group = rest // 99 + 1, rest % 99 + 1
        return f"{area + (area >= 666):03}-{group + 0:02}-{serial + 1:04}"
    days = plain_feistel((date.fromisoformat(value) - date(1900, 1, 1)).days, 17, 4297, KEY, "date")
    return (date(1900, 1, 1) + timedelta(days)).isoformat()


def test_every_kind_against_plain_python(spark):
    text = (
        "bob.smith99@mail7.example.com X_y1@b.org +1 (017) 555-7713 (212) 555-0199 212-555-0143 +44 20 7946 0958, 97.51.17.173 "
        "0.0.0.255 4845168114407329 3782-822463-10005 123-45-6789 899-99-9999 1987-02-28 2099-12-31 1900-01-01 "
        "2001:DB8::8a2e:370:7334 GB82 WEST 1234 5698 7654 32, DE89370400440532013000"
    )
    (row,) = hide(spark, text)
    assert {f.kind for f in row.found} == set(pii.KINDS) and len(row.found) == 18
    assert [(f.original, f.pseudonym) for f in row.found] == [(f.original, plain(f.kind, f.original)) for f in row.found]


def test_the_key_is_not_in_the_plan(spark, edges):
    assert "very-secret" not in pii.pseudonymise(edges, "very-secret")._jdf.queryExecution().toString()
