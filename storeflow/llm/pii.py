"""Personal data: format-preserving Feistel pseudonyms, DataFrame only.

Values that a pattern finds and a rule validates are permuted under a key
within their own format, so the same value gets the same pseudonym in every
document and nothing but the key links it to the original:

* card numbers (13-19 digits, Luhn): all digits but the last are permuted,
  the last is recomputed, so a pseudonym is a valid number;
* IBANs (mod 97, of the country's registered length): the account part is permuted within digits and letters,
  the check digits are recomputed;
* dates (of 1800 to 2199, year first, or day and month first with ``.`` or
  ``/``): permuted within those 400 years (146,097 = 627 * 233 days);
* social security numbers (valid areas, groups and serials only), IPv4
  addresses (octets up to 255), phone numbers (10 to 15 digits; a country
  code after ``+`` stays; a number with the length of its country, else up to
  the last group within 15 digits: a short number that follows after a space
  may be taken for its end), local parts of e-mail addresses (the domain
  stays) and values after ``token =`` and the like (hex stays hex).

Numbers that fail their rule stay as they are.

The permutation works on a vector of numbers with a radix each (a digit:
10; an octet: 256; ...): the halves take turns in being shifted by a keyed
SHA-256 of the other half, ``STEPS`` times.  Separators stay in place.

Defined results
---------------
* null text stays null, empty text empty; both hold nothing.
* rows without an id, repeated rows and an empty table are mapped row by
  row like any others; other columns are kept as they are.
* very long texts: patterns use bounded or possessive repeats only, so the
  search is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

DEFAULT_KEY = "storeflow-demo-key"  # give your own secret in production
STEPS = 10  # even: the halves are back in their places

# Alphabets within which a character stays.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
LATIN_LOWER = "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
LATIN_UPPER = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
PLAIN = [DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER]

# The formats.
SECRET = r"(?i:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{16,}+"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}"
# Registered lengths: a value ends there, whatever follows it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
IBAN = (r"(?<![\p{L}\p{N}])(?:"
        + "".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}"
                  + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![\p{L}\p{N}])|" for n, c in IBAN_LENGTHS.items())
        + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))")
DATE_YMD = r"(?<![\p{L}\p{N}.+-])\d{4}([-/.])\d{2}\1\d{2}(?!(?![Tt]\d)[\p{L}\p{N}])"
DATE_DMY = r"(?<![\p{L}\p{N}.+-])\d{1,2}([./])\d{1,2}\2\d{4}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}.+-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
IP = r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)"
CARD = (r"(?<![\p{L}\p{N}.+-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})"
        r"(?![\p{L}\p{N}])")
# Digits after the country codes whose numbers have one length; others end
# with the last group that leaves them 15 digits at most.
PHONE_DIGITS = {8: "45|47", 9: "31|33|34|41|48|61", 10: "1|7|91"}
# Written out: a look-behind takes no repeated groups.
NEXT_DIGIT = r"[ .()-]{0,2}\d"
PHONE_END = "|".join(f"(?:{c})" + NEXT_DIGIT * n for n, c in PHONE_DIGITS.items())
PHONE_MOST = r"\d" + f"(?:{NEXT_DIGIT}" * 14 + ")?" * 14
PHONE_PLUS = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}]|[.-]\d)"
PHONE = (rf"(?<![\p{{L}}\p{{N}}])(?:{PHONE_PLUS}(?<=\+(?:{PHONE_END}))"
         rf"|{PHONE_PLUS}(?<=\+{PHONE_MOST})"
         r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}]|[.-]\d)")
KINDS = {"secret": SECRET, "email": EMAIL, "iban": IBAN, "date_ymd": DATE_YMD, "date_dmy": DATE_DMY,
         "ssn": SSN, "ip": IP, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
# Every format holds one of these characters.
HINT = r"[0-9@:=]"


# ----------------------------------------------------------- permutation


def _number(digest: Column) -> Column:
    """A number of 60 bits from a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute(values: Column, radices: Column, key: Column) -> Column:
    """The Feistel permutation of ``values`` (array<long>), each below its
    entry of ``radices``."""
    def step(acc: Column, i: Column) -> Column:
        seed = F.concat_ws("|", key, i.cast("string"), F.array_join(acc["b"].cast("array<string>"), ","))
        shifted = let(seed, lambda s: F.transform(
            F.arrays_zip(acc["a"].alias("v"), acc["ma"].alias("m")),
            lambda x, k: F.pmod(x["v"] + _number(F.sha2(F.concat_ws("|", s, k.cast("string")), 256)), x["m"])))
        return F.struct(
            acc["b"].alias("a"), acc["mb"].alias("ma"), shifted.alias("b"), acc["ma"].alias("mb"))

    def run(both: Column) -> Column:
        v, m = both["v"], both["m"]
        half = F.floor(F.size(v) / 2).cast("int")
        start = F.struct(
            F.slice(v, 1, half).alias("a"), F.slice(m, 1, half).alias("ma"),
            F.slice(v, half + 1, F.size(v) - half).alias("b"), F.slice(m, half + 1, F.size(v) - half).alias("mb"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(F.struct(values.alias("v"), radices.alias("m")), run)


def _longs(*cols: Column) -> Column:
    return F.array(*[c.cast("long") for c in cols])


def permute_text(text: Column, key: Column, alphabets: list[str]) -> Column:
    """Every character of an alphabet stays in it; others stay in place."""
    tables = F.array(*[F.lit(a) for a in alphabets], F.lit(""))

    def code(c: Column) -> Column:
        which = F.lit(len(alphabets))
        for k in reversed(range(len(alphabets))):
            which = F.when(F.instr(F.lit(alphabets[k]), c) > 0, k).otherwise(which)
        return F.struct(c.alias("c"), F.get(tables, which).alias("a"))

    def run(coded: Column) -> Column:
        moved = permute(
            F.transform(coded, lambda x: F.when(x["a"] == "", 0).otherwise(F.instr(x["a"], x["c"]) - 1).cast("long")),
            F.transform(coded, lambda x: F.greatest(F.length(x["a"]), F.lit(1)).cast("long")), key)
        return F.array_join(F.zip_with(
            coded, moved,
            lambda x, v: F.when(x["a"] == "", x["c"]).otherwise(
                F.substring(x["a"], (v + 1).cast("int"), F.lit(1)))), "")

    return F.when(F.length(text) == 0, text).otherwise(let(F.transform(F.split(text, ""), code), run))


# ----------------------------------------------------------------- formats


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(m: Column, new: Column, what: str = "[^0-9]") -> Column:
    """``m`` with its value characters (those not in ``what``) replaced by
    those of ``new`` in turn."""
    def walk(n: Column) -> Column:
        def at(c: Column, k: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(m, F.lit(1), k + 1), what, ""))
            return F.when(c.rlike(what), c).otherwise(F.substring(n, place, F.lit(1)))
        return F.array_join(F.transform(F.split(m, ""), at), "")
    return let(new, walk)


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn rule with the last digit counted once."""
    def one(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, twice).otherwise(d)
    parts = F.transform(F.split(F.reverse(digits), ""), one)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: Column) -> Column:
    def checked(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))
    return _fill(m, let(permute_text(_drop_last(_digits(m)), key, [DIGITS]), checked))


def _drop_last(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - 1)


def _mod97(text: Column) -> Column:
    """Remainder of the number that letters (A = 10 ...) and digits spell."""
    spelt = F.array_join(
        F.transform(F.split(text, ""),
                    lambda c: F.when(F.instr(F.lit(DIGITS), c) > 0, c)
                    .otherwise((F.instr(F.lit(UPPER), c) + 9).cast("string"))), "")
    return F.aggregate(F.split(spelt, ""), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))


def _plain(m: Column) -> Column:
    return F.regexp_replace(m, "[^A-Z0-9]", "")


def _iban(m: Column, key: Column) -> Column:
    plain = _plain(m)
    country = F.substring(plain, 1, 2)

    def checked(account: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, account)

    account = permute_text(F.substring(plain, F.lit(5), F.length(plain)), key, [DIGITS, UPPER])
    return _fill(m, let(account, checked), "[^A-Z0-9]")


def _iban_valid(m: Column) -> Column:
    plain = _plain(m)
    n = F.length(plain)
    return (n >= 15) & (n <= 34) & (
        _mod97(F.concat(F.substring(plain, F.lit(5), n), F.substring(plain, 1, 4))) == 1)


def _fields(m: Column, ymd: bool) -> tuple[Column, Column, Column, Column]:
    """Year, month, day, and whether the month stands before the day."""
    part = F.split(m, "[-./]")
    a, b, c = (F.element_at(part, k).cast("int") for k in (1, 2, 3))
    if ymd:
        return a, b, c, F.lit(True)
    # With "/" the month comes first unless only the other order is a date.
    first = (F.instr(m, "/") > 0) & (a <= 12)
    return c, F.when(first, a).otherwise(b), F.when(first, b).otherwise(a), first


def _date_valid(m: Column, ymd: bool) -> Column:
    y, mo, d, _ = _fields(m, ymd)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return y.between(1800, 2199) & mo.between(1, 12) & (d >= 1) & (d <= days)


def _date(m: Column, key: Column, ymd: bool) -> Column:
    y, mo, d, month_first = _fields(m, ymd)
    begin = F.lit("1800-01-01").cast("date")
    part = F.split(m, "[-./]")
    sep = F.regexp_extract(m, "[-./]", 0)

    def shown(value: Column, old: Column) -> Column:
        return F.when(F.length(old) == 2, F.lpad(value.cast("string"), 2, "0")).otherwise(value.cast("string"))

    def text(new: Column) -> Column:
        year, month, day = F.lpad(F.year(new).cast("string"), 4, "0"), F.month(new), F.dayofmonth(new)
        if ymd:
            return F.concat(year, sep, shown(month, F.element_at(part, 2)), sep, shown(day, F.element_at(part, 3)))
        return F.concat(
            shown(F.when(month_first, month).otherwise(day), F.element_at(part, 1)), sep,
            shown(F.when(month_first, day).otherwise(month), F.element_at(part, 2)), sep, year)

    n = F.date_diff(F.make_date(y, mo, d), begin)
    moved = permute(_longs(F.floor(n / 233), n % 233), _longs(F.lit(627), F.lit(233)), key)
    new = let(moved, lambda v: F.date_add(begin, (F.get(v, F.lit(0)) * 233 + F.get(v, F.lit(1))).cast("int")))
    return let(new, text)


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.element_at(F.split(m, "-"), k).cast("int") for k in (1, 2, 3))


def _ssn_valid(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    at = F.when(area > 666, area - 2).otherwise(area - 1)  # areas without 666, from 0
    moved = permute(_longs(at, group - 1, serial - 1), _longs(F.lit(898), F.lit(99), F.lit(9999)), key)

    def text(v: Column) -> Column:
        a, g, n = (F.get(v, F.lit(k)) for k in range(3))
        return F.concat_ws(
            "-", F.lpad(F.when(a >= 665, a + 2).otherwise(a + 1).cast("string"), 3, "0"),
            F.lpad((g + 1).cast("string"), 2, "0"), F.lpad((n + 1).cast("string"), 4, "0"))

    return let(moved, text)


def _ip_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def _ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    moved = permute(octets, F.array_repeat(F.lit(256).cast("long"), 4), key)
    return F.array_join(moved.cast("array<string>"), ".")


def _phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _fill(rest, permute_text(_digits(rest), key, [DIGITS])))


def _phone_valid(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _email(m: Column, key: Column) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, PLAIN), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: Column) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_\-]{16,})$", 1)
    lead = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(lead, F.when(value.rlike("^[0-9a-f]+$"), permute_text(value, key, [HEX]))
                    .when(value.rlike("^[0-9A-F]+$"), permute_text(value, key, [HEX_UPPER]))
                    .otherwise(permute_text(value, key, PLAIN)))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(m: Column) -> Column:
    """Kind of a found value, null when its rule refuses it.  The branches
    are tried in the order of the search pattern."""
    def alone(name: str) -> Column:
        return m.rlike(_whole(KINDS[name].replace(r"\2", r"\1")))
    return (
        F.when(alone("secret"), F.lit("secret"))
        .when(alone("email"), F.lit("email"))
        .when(alone("iban"), F.when(_iban_valid(m), F.lit("iban")))
        .when(alone("date_ymd"), F.when(_date_valid(m, True), F.lit("date_ymd")))
        .when(alone("date_dmy"), F.when(_date_valid(m, False), F.lit("date_dmy")))
        .when(alone("ssn"), F.when(_ssn_valid(m), F.lit("ssn")))
        .when(alone("ip"), F.when(_ip_valid(m), F.lit("ip")))
        .when(alone("card"), F.when(_luhn(_digits(m)) % 10 == 0, F.lit("card")))
        .when(alone("phone"), F.when(_phone_valid(m), F.lit("phone")))
    )


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    made = {"secret": _secret, "email": _email, "iban": _iban, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone,
            "date_ymd": lambda v, k: _date(v, k, True), "date_dmy": lambda v, k: _date(v, k, False)}
    out = F.when(kind.isNull(), m)
    for name, f in made.items():
        out = out.when(kind == name, f(m, F.concat_ws("|", key, F.lit(name[:4]))))
    return out


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = DEFAULT_KEY,
                 found_col: str | None = "pii_found") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and, with ``found_col``, the
    replaced values' kinds (array<string>, in the order of the text)."""
    text = F.col(f"`{text_col}`")
    secret = F.lit(key)

    def judged(values: Column) -> Column:
        return F.transform(values, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))

    def replaced(made: Column) -> Column:
        new = F.transform(made, lambda x: pseudonym(x["value"], x["kind"], secret))
        between = F.split(text, ANY, -1)
        joined = F.array_join(
            F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        kinds = F.filter(F.transform(made, lambda x: x["kind"]), lambda k: k.isNotNull())
        return F.struct(joined.alias("text"), kinds.alias("kinds"))

    # One expression: texts without a hint are never searched, and what is
    # found is judged and replaced once.
    found = let(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
        lambda values: F.when(F.size(values) > 0, let(judged(values), replaced)))
    rows = docs.withColumn("__found", F.when(text.rlike(HINT), found))
    out = [F.coalesce(F.col("__found.text"), text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if found_col:
        out.append(F.coalesce(F.col("__found.kinds"), F.array().cast("array<string>")).alias(found_col))
    return rows.select(*out)
