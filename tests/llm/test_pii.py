"""The permutation and the formats against a plain Python version."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import regex
from pyspark.sql import functions as F

from storeflow.llm import pii

from .helpers import clashing, frame, odd_docs, rows_of

KEY = "test key"


def permute(values, radices, key):
    h = len(values) // 2
    a, ma, b, mb = list(values[:h]), list(radices[:h]), list(values[h:]), list(radices[h:])
    for i in range(1, pii.STEPS + 1):
        seed = f"{key}|{i}|{','.join(map(str, b))}"
        moved = [(v + int(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:15], 16)) % m
                 for k, (v, m) in enumerate(zip(a, ma))]
        a, ma, b, mb = b, mb, moved, ma
    return a + b


def inverse(values, radices, key):
    h = len(values) // 2
    a, ma, b, mb = list(values[:h]), list(radices[:h]), list(values[h:]), list(radices[h:])
    for i in range(pii.STEPS, 0, -1):
        # the step made (a, b) = (old b, shifted old a)
        seed = f"{key}|{i}|{','.join(map(str, a))}"
        back = [(v - int(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:15], 16)) % m
                for k, (v, m) in enumerate(zip(b, mb))]
        a, ma, b, mb = back, mb, a, ma
    return a + b


def text_permuted(s, key, alphabets):
    where = [next((a for a in alphabets if c in a), None) for c in s]
    moved = permute([a.index(c) if a else 0 for c, a in zip(s, where)], [len(a) if a else 1 for a in where], key)
    return "".join(a[v] if a else c for c, a, v in zip(s, where, moved))


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10


def refill(m, new, keep):
    it = iter(new)
    return "".join(next(it) if keep(c) else c for c in m)


def replaced(m):
    """Pseudonym of a found value and its kind."""
    def is_(name):
        return regex.fullmatch(pii.KINDS[name].replace(r"\2", r"\1"), m)

    def k(name):
        return f"{KEY}|{name[:4]}"

    if is_("secret"):
        value = regex.search(r"[A-Za-z0-9+/_\-]{16,}$", m).group()
        alphabet = [pii.HEX] if regex.fullmatch("[0-9a-f]+", value) else (
            [pii.HEX_UPPER] if regex.fullmatch("[0-9A-F]+", value) else pii.PLAIN)
        return m[:-len(value)] + text_permuted(value, k("secret"), alphabet), "secret"
    if is_("email"):
        local, domain = m.split("@")
        return text_permuted(local, k("email"), pii.PLAIN) + "@" + domain, "email"
    if is_("iban"):
        p = m.replace(" ", "")

        def mod(s):
            return int("".join(str(int(c, 36)) for c in s)) % 97
        if not 15 <= len(p) <= 34 or mod(p[4:] + p[:4]) != 1:
            return m, None
        account = text_permuted(p[4:], k("iban"), [pii.DIGITS, pii.UPPER])
        return refill(m, p[:2] + f"{98 - mod(account + p[:2] + '00'):02d}" + account, str.isalnum), "iban"
    for name in ("date_ymd", "date_dmy"):
        if is_(name):
            sep = regex.search("[-./]", m).group()
            x, y, z = m.split(sep)
            if name == "date_ymd":
                order = ("y", "m", "d")
            elif sep == "/" and int(x) <= 12:
                order = ("m", "d", "y")
            else:
                order = ("d", "m", "y")
            f = dict(zip(order, (x, y, z)))
            try:
                day = dt.date(int(f["y"]), int(f["m"]), int(f["d"]))
            except ValueError:
                return m, None
            if not 1800 <= day.year <= 2199:
                return m, None
            n = (day - dt.date(1800, 1, 1)).days
            hi, lo = permute([n // 233, n % 233], [627, 233], k(name))
            new = dt.date(1800, 1, 1) + dt.timedelta(days=hi * 233 + lo)
            parts = {"y": f"{new.year:04d}", "m": new.month, "d": new.day}
            return sep.join(
                parts[o] if o == "y" else (f"{parts[o]:02d}" if len(f[o]) == 2 else str(parts[o])) for o in order), name
    if is_("ssn"):
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m, None
        areas = [x for x in range(1, 900) if x != 666]
        a, g, s = permute([areas.index(area), group - 1, serial - 1], [898, 99, 9999], k("ssn"))
        return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}", "ssn"
    if is_("ip"):
        octets = [int(o) for o in m.split(".")]
        if max(octets) > 255:
            return m, None
        return ".".join(map(str, permute(octets, [256] * 4, k("ip")))), "ip"
    digits = "".join(c for c in m if c.isdigit())
    if is_("card"):
        if luhn(digits):
            return m, None
        body = text_permuted(digits[:-1], k("card"), [pii.DIGITS])
        return refill(m, body + str(-luhn(body + "0") % 10), str.isdigit), "card"
    code = regex.match(r"^\+\d{1,3}(?=[ .(-])", m)
    code = code.group() if code else ""
    if not 10 <= len(digits) <= 15:
        return m, None
    rest = m[len(code):]
    new = text_permuted("".join(c for c in rest if c.isdigit()), k("phone"), [pii.DIGITS])
    return code + refill(rest, new, str.isdigit), "phone"


def brute(text):
    if text is None:
        return None, []
    kinds = []

    def one(m):
        new, kind = replaced(m.group())
        if kind:
            kinds.append(kind)
        return new

    return regex.sub(pii.ANY, one, text), kinds


VALUES = [
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "378282246310005",
    "3782 822463 10005", "+1 (017) 555-7713", "+49 30 1234 5678", "(212) 555-0199", "212-555-0199", "192.168.1.254",
    "999.1.1.1", "1.2.3", "und.34@mail7.example.com", "élan.5@mail.example.org", "A_b+c@x.io",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!',
    "api_key: Zx81-abcdefGHIJKL_99", "password=short", "2024-02-29", "2023-02-29", "1800-01-01", "2199/12/31",
    "31.12.1999", "1/2/2003", "13/2/2003", "30/30/2003", "1.1.0300", "123-45-6789", "666-45-6789", "000-12-3456",
    "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB29NWBK60161331926819", "version 2.0.",
    "4111111111111111 5500005555555559", "x4111111111111111", "tel:+12125550199 end",
]


def test_formats_against_python(spark):
    rng = random.Random(3)
    rows = [(i, v, "en", "s", 1) for i, v in enumerate(VALUES)]
    for i in range(60):
        words = [rng.choice(VALUES + ["the", "of,", "é", "\n", "9", "a@b", "##"]) for _ in range(rng.randint(1, 9))]
        rows.append((1000 + i, rng.choice([" ", "  ", ", ", "!! "]).join(words), "en", "s", 1))
    rows += [(5000 if r[0] is None else 2000 + r[0], *r[1:]) for r in odd_docs()]
    got = rows_of(pii.pseudonymise(clashing(frame(spark, rows)), key=KEY))
    for r in got:
        source = next(x for x in rows if x[0] == r["doc_id"])
        candidates = [brute(x[1]) for x in rows if x[0] == r["doc_id"]]
        assert (r["text"], r["pii_found"]) in candidates, source
    found = [k for r in got for k in r["pii_found"]]
    assert set(found) == set(pii.KINDS)
    assert sum(r["text"] != dict((x[0], x[1]) for x in rows)[r["doc_id"]] for r in got if r["doc_id"] < len(VALUES)) > 20


def test_equal_values_stay_linked_and_keys_differ(spark):
    rows = [(i, f"say {i} 4111111111111111 and 4111 1111 1111 1111", "en", "s", 1) for i in range(5)]
    got = rows_of(pii.pseudonymise(frame(spark, rows), key=KEY))
    cards = {tuple("".join(c for c in w if c.isdigit()) for w in (r["text"].split()[2], "".join(r["text"].split()[4:])))
             for r in got}
    assert len(cards) == 1 and len(set(cards.pop())) == 1
    other = rows_of(pii.pseudonymise(frame(spark, rows), key="another"))
    assert other[0]["text"] != got[0]["text"]


def test_permutation_is_one_to_one(spark):
    """Every value of a small format has its own pseudonym, and the steps
    can be taken back."""
    cols = pii.permute(F.array((F.col("id") / 12).cast("long"), F.col("id") % 12), F.array(F.lit(9), F.lit(12)).cast("array<long>"), F.lit(KEY))
    got = {r["id"]: tuple(r["p"]) for r in spark.range(108).select("id", cols.alias("p")).collect()}
    assert len(set(got.values())) == 108
    for i, p in got.items():
        assert p == tuple(permute([i // 12, i % 12], [9, 12], KEY))
        assert inverse(list(p), [9, 12], KEY) == [i // 12, i % 12]


def test_long_text_and_empty(spark):
    rows = [(1, "a1." * 200_000, "en", "s", 1), (2, "9" * 300_000, "en", "s", 1), (3, "@" * 100_000, "en", "s", 1)]
    got = {r["doc_id"]: r["text"] for r in rows_of(pii.pseudonymise(frame(spark, rows), key=KEY))}
    assert got == {r[0]: r[1] for r in rows}
    assert rows_of(pii.pseudonymise(frame(spark, []))) == []


def test_values_end_where_their_rule_ends(spark):
    values = {
        "BE68 5390 0754 7034": ["USD", "2023", "AND MORE"], "ES91 2100 0418 4502 0005 1332": ["2024", "EUR"],
        "AT61 1904 3002 3457 3201": ["PAID", "12"], "+49 30 1234 5678": ["2023", "2023 1999"],
        "+1 212 555 0199": ["20", "2023", "111 22"], "2021-03-04": ["T10:00:00Z", "t23:59"]}
    rows = [(100 * i + j, v + ("" if t[0] in "Tt" and v[0] == "2" else " ") + t, v, t, 1)
            for i, (v, tails) in enumerate(values.items()) for j, t in enumerate(["end", *tails]) if v[0] != "2" or j]
    got = rows_of(pii.pseudonymise(frame(spark, rows), key=KEY))
    linked = {}
    for r in got:
        assert len(r["pii_found"]) == 1 and r["text"].endswith(r["source"]), r
        new = r["text"][:-len(r["source"])].rstrip()
        assert new != r["lang"] and linked.setdefault(r["lang"], new) == new, r
    assert set(linked) == set(values)
