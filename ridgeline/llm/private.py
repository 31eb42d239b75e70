"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel networks in SQL expressions.

One pattern finds candidates; checks (Luhn, octets, calendar, mod 97, area codes) decide
whether one is a value; a value is permuted within its format under the key, so equal
values get equal pseudonyms in every document and no two values get the same one.
Validated numbers stay valid: check digits are made anew, social numbers and telephone
numbers of the North American plan are permuted among the valid ones. Where the check of
a card or IBAN candidate fails, the longest valid one that begins and ends at borders of
its groups is the value.

Whoever knows the key can undo the pseudonyms, so the caller has to give one. Repeated
rows get equal results. A null text stays null, texts without values stay as they are,
whatever their length. Pseudonyms are as long as their values, but for IP addresses
and dates without leading zeros. Dates are those of the pattern below; `2020/01/15` and
`12-25-1990` are none. Other columns are kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import fresh

ROUNDS = 8
#: Candidates, by kind; the order decides where two could begin at one place.
PATTERNS = {
    # a run of the name's characters is tried from its beginning only, so it may have any length
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d-])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # a group of an international number is not the beginning of an address that follows it
    "phone": r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?(?!\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d)",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"(?<![0-9A-Za-z_-])(?:sk-|gh[opsru]_|xox[abprs]-)[0-9A-Za-z_-]{16,}+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: What every value of a kind holds, so that texts without any of it need not be searched. Hexadecimal runs without a digit are letters.
HINTS = {"email": "@", "key": "AKIA", "token": "sk-|gh[opsru]_|xox[abprs]-", "secret": "[0-9]|[a-f]{32}|[A-F]{32}"} | {k: "[0-9]" for k in ("ip", "iban", "date", "social", "phone", "card")}
HINT = "|".join(sorted({h for kind in PATTERNS for h in HINTS[kind].split("|")}))
DAYS_LEFT, DAYS_RIGHT = 256, 286  # dates from 1900-01-01 over 256 * 286 days, to 2100-06-16
_hex = lambda c: F.conv(c, 16, 10).cast("long")


def feistel(n: Column, left: Column, right: Column, tweak: str, key: str) -> Column:
    """A keyed permutation of the numbers below left * right."""
    start = F.struct((n / right).cast("long").alias("a"), F.pmod(n, right).alias("b"), left.alias("m"), right.alias("k"))

    def step(s: Column, i: Column) -> Column:
        noise = _hex(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), left, right, i, s["b"]), 256), 1, 15))
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + noise, s["m"]).alias("b"), s["k"].alias("m"), s["m"].alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * right + s["b"])


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def feistel_text(text: Column, tweak: str, key: str, letters: int = 26) -> Column:
    """A keyed permutation of ASCII texts of one shape: digits stay digits, letters stay letters of their case.

    A round hashes one half once; its digest and a counter give the noise for the other half, so the cost grows with the length.
    """
    codes = F.transform(characters(text), lambda c: F.ascii(c))
    half = F.floor(F.size(codes) / 2).cast("int")
    start = F.struct(F.slice(codes, F.lit(1), half).alias("a"), F.slice(codes, half + 1, F.size(codes) - half).alias("b"))

    def moved(c: Column, by: Column) -> Column:
        within = lambda low, n: F.lit(low) + F.pmod(c - low + by, F.lit(n))
        return F.when(c.between(48, 57), within(48, 10)).when(c.between(65, 64 + letters), within(65, letters)).when(c.between(97, 96 + letters), within(97, letters)).otherwise(c).cast("int")

    def step(s: Column, i: Column) -> Column:
        half = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i, F.array_join(s["b"].cast("array<string>"), ",")), 256)
        block = lambda h, j: F.sha2(F.concat_ws("|", h, F.floor(j / 16)), 256)
        noise = lambda h, j: _hex(F.substr(block(h, j), (F.pmod(j, F.lit(16)) * 4 + 1).cast("int"), F.lit(4)))
        # an array of one element holds the digest, so that it is not made anew for every character
        shifted = F.get(F.transform(F.array(half), lambda h: F.transform(s["a"], lambda c, j: moved(c, noise(h, j)))), F.lit(0))
        return F.struct(s["b"].alias("a"), shifted.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.array_join(F.transform(F.concat(s["a"], s["b"]), lambda c: F.char(c)), ""))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    is_digit = lambda c: c.between("0", "9")
    put = lambda s, c: F.struct(F.concat(s["out"], F.when(is_digit(c), F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit(c).cast("int")).alias("k"))
    return F.aggregate(characters(shape), start, put, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """The Luhn sum; 0 modulo 10 for valid numbers."""
    doubled = F.transform(F.reverse(characters(digits)).cast("array<int>"), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def permute_digits(digits: Column, tweak: str, key: str) -> Column:
    """Digits of any length from 2 to 18, permuted within their length."""
    n = F.length(digits)
    right = F.pow(F.lit(10.0), F.floor(n / 2)).cast("long")
    left = F.pow(F.lit(10.0), n - F.floor(n / 2)).cast("long")
    return F.lpad(feistel(digits.cast("long"), left, right, tweak, key).cast("string"), n, "0")


def card(value: Column, key: str) -> Column:
    body = permute_digits(F.substr(digits_of(value), F.lit(1), F.length(digits_of(value)) - 1), "card", key)
    return refill(value, F.concat(body, F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def social(value: Column, key: str) -> Column:
    """A permutation of the valid numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda at, n: F.substring(value, at, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    new = feistel((area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), "social", key)
    at = (new / (99 * 9999)).cast("long")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", digits(at + F.when(at >= 665, 2).otherwise(1), 3), digits(F.pmod((new / 9999).cast("long"), F.lit(99)) + 1, 2), digits(F.pmod(new, F.lit(9999)) + 1, 4))


def national(digits: Column, key: str) -> Column:
    """Ten digits of the North American plan: area and exchange keep whether they begin with 2 to 9, as they have to."""
    first = lambda at: F.substring(digits, at, 1).cast("long")
    base = lambda at: F.when(first(at) >= 2, 200).otherwise(0).cast("long")
    count = lambda at: F.when(first(at) >= 2, 800).otherwise(200).cast("long")
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    left = count(1) * count(4)
    new = feistel(((part(1, 3) - base(1)) * count(4) + part(4, 3) - base(4)) * 10000 + part(7, 4), left, F.lit(10000).cast("long"), "national", key)
    of = (new / 10000).cast("long")
    area, exchange = (of / count(4)).cast("long") + base(1), F.pmod(of, count(4)) + base(4)
    return F.concat(*(F.lpad(c.cast("string"), n, "0") for c, n in ((area, 3), (exchange, 3), (F.pmod(new, F.lit(10000)), 4))))


def phone(value: Column, key: str) -> Column:
    """The country code stays."""
    code = F.coalesce(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0), F.lit(""))
    rest = F.substr(value, F.length(code) + 1)
    own = code.isin("", "+1") & (F.length(digits_of(rest)) == 10)
    return F.concat(code, refill(rest, F.when(own, national(digits_of(rest), key)).otherwise(permute_digits(digits_of(rest), "phone", key))))


def octets(value: Column) -> Column:
    return F.split(value, r"\.").cast("array<int>")


def ip(value: Column, key: str) -> Column:
    n = F.aggregate(octets(value), F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    new = feistel(n, F.lit(65536).cast("long"), F.lit(65536).cast("long"), "ip", key)
    return F.concat_ws(".", *(F.pmod(F.floor(new / (256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))


def calendar(value: Column) -> tuple[Column, Column]:
    """The date that a value writes (null if none), and whether its year comes first."""
    first = value.rlike(r"^\d{4}-")
    part = lambda k: F.lpad(F.get(F.split(value, "[./]"), F.lit(k)), 2, "0")
    year = F.get(F.split(value, "[./]"), F.lit(2))
    month_and_day = lambda m, d: F.try_to_date(F.concat_ws("-", year, part(m), part(d)), "yyyy-MM-dd")
    return F.when(first, F.try_to_date(value, "yyyy-MM-dd")).when(value.contains(".") | european(value), month_and_day(1, 0)).otherwise(month_and_day(0, 1)), first


def european(value: Column) -> Column:
    """Whether a date with slashes has its day first: else its month would be above 12."""
    return value.rlike(r"^(1[3-9]|[2-9][0-9])/")


def date(value: Column, key: str) -> Column:
    """Dates with points have their day first, those with slashes their month, unless it would be above 12; so are the new ones written.

    A date without leading zeros stays without.
    """
    found, first = calendar(value)
    n = F.datediff(found, F.lit("1900-01-01").cast("date")).cast("long")
    new = F.date_add(F.lit("1900-01-01").cast("date"), feistel(n, F.lit(DAYS_LEFT).cast("long"), F.lit(DAYS_RIGHT).cast("long"), "date", key).cast("int"))
    short = value.rlike(r"^\d[./]|[./]\d[./]")
    written = lambda m, d: F.when(short, F.date_format(new, m)).otherwise(F.date_format(new, d))
    slashes = F.when(european(value) & (F.dayofmonth(new) > 12), written("d/M/yyyy", "dd/MM/yyyy")).otherwise(written("M/d/yyyy", "MM/dd/yyyy"))
    return F.when(first, F.date_format(new, "yyyy-MM-dd")).when(value.contains("."), written("d.M.yyyy", "dd.MM.yyyy")).otherwise(slashes)


def remainder_97(text: Column) -> Column:
    """The number that digits and letters (A = 10) write, modulo 97."""
    put = lambda a, c: F.when(c <= 57, F.pmod(a * 10 + (c - 48), F.lit(97))).otherwise(F.pmod(a * 100 + (c - 55), F.lit(97)))
    return F.aggregate(F.transform(characters(text), lambda c: F.ascii(c)), F.lit(0), put)


def iban_text(value: Column) -> Column:
    flat = F.replace(value, F.lit(" "), F.lit(""))
    return F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))


def iban(value: Column, key: str) -> Column:
    flat = F.replace(value, F.lit(" "), F.lit(""))
    body = feistel_text(F.substr(flat, F.lit(5)), "iban", key)
    check = F.lit(98) - remainder_97(F.concat(body, F.substring(flat, 1, 2), F.lit("00")))
    new = F.concat(F.substring(flat, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    put = lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(new, s["k"], F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k"))
    return F.aggregate(characters(value), start, put, lambda s: s["out"])


def alphabets(key: str) -> tuple[str, str]:
    """The letters and digits, and a keyed order of each kind, for names of one character, which a network can't mix."""
    order = lambda s: "".join(sorted(s, key=lambda c: hashlib.sha256(f"{key}|one|{c}".encode()).digest()))
    kinds = (string.ascii_lowercase, string.ascii_uppercase, string.digits)
    return "".join(kinds), "".join(order(k) for k in kinds)


def email(value: Column, key: str) -> Column:
    """The letters and digits of the name before the @ change; the domain stays."""
    at = F.instr(value, "@")
    name, domain = F.substr(value, F.lit(1), at - 1), F.substr(value, at + 1)
    return F.concat(F.when(F.length(name) == 1, F.translate(name, *alphabets(key))).otherwise(feistel_text(name, "email", key)), F.lit("@"), domain)


def token(value: Column, key: str) -> Column:
    """The prefix that tells whose token it is stays."""
    prefix = F.regexp_extract(value, "^(?:sk-|gh[opsru]_|xox[abprs]-)", 0)
    return F.concat(prefix, feistel_text(F.substr(value, F.length(prefix) + 1), "token", key))


def kind_of(v: Column) -> Column:
    """The kind of a candidate, null if its checks fail."""
    whole = lambda kind: v.rlike(rf"^(?:{PATTERNS[kind]})$")
    n = F.length(digits_of(v))
    days, _ = calendar(v)
    in_range = days.between(F.lit("1900-01-01").cast("date"), F.date_add(F.lit("1900-01-01").cast("date"), DAYS_LEFT * DAYS_RIGHT - 1))
    return (
        F.when(v.contains("@"), "email")
        .when(whole("key"), "key")
        .when(whole("token"), "token")
        .when(whole("secret"), "secret")
        .when(whole("ip"), F.when(F.forall(octets(v), lambda o: o <= 255), "ip"))
        .when(whole("date"), F.when(in_range, "date"))
        .when(whole("social"), F.when(~v.rlike(r"^(000|666|9)|-00-|-0000$"), "social"))
        .when(whole("iban"), F.when(remainder_97(iban_text(v)) == 1, "iban"))
        .when(whole("phone"), F.when(n.between(7, 15), "phone"))
        .when(whole("card"), F.when(luhn(digits_of(v)) % 10 == 0, "card"))
    )


def inner_value(v: Column, kind: Column) -> Column:
    """Where the value of a candidate begins and how long it is: all of it, or where its check fails
    the longest valid card or IBAN (the first of equal length) between borders of its groups."""
    at_border = lambda n: F.substr(v, n, F.lit(1)).isin(" ", "-")
    places = F.sequence(F.lit(1), F.length(v))
    begins = F.filter(places, lambda n: (n == 1) | at_border(n - 1))
    ends = F.filter(places, lambda n: (n == F.length(v)) | at_border(n + 1))
    spans = F.flatten(F.transform(begins, lambda b: F.transform(F.filter(ends, lambda e: e - b >= 12), lambda e: F.struct((b - e - 1).alias("less"), b.alias("begin")))))
    text = lambda s: F.substr(v, s["begin"], -s["less"])
    is_card = lambda s: F.length(digits_of(text(s))).between(13, 19) & (luhn(digits_of(text(s))) % 10 == 0)
    is_iban = lambda s: text(s).rlike(rf"^(?:{PATTERNS['iban']})$") & (remainder_97(iban_text(text(s))) == 1)
    valid = F.when(v.rlike("^[A-Z]{2}[0-9]{2}"), F.filter(spans, is_iban)).when(v.rlike("^[0-9][0-9 -]{12,}$"), F.filter(spans, is_card))
    best = F.get(F.array_sort(valid), F.lit(0))
    everything = F.struct((-F.length(v)).alias("less"), F.lit(1).alias("begin"))
    return F.when(kind.isNull(), F.coalesce(best, everything)).otherwise(everything)


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", email(v, key))
        .when(kind == "ip", ip(v, key))
        .when(kind == "date", date(v, key))
        .when(kind == "social", social(v, key))
        .when(kind == "iban", iban(v, key))
        .when(kind == "phone", phone(v, key))
        .when(kind == "card", card(v, key))
        .when(kind == "key", F.concat(F.lit("AKIA"), feistel_text(F.substr(v, F.lit(5)), "key", key)))
        .when(kind == "token", token(v, key))
        .when(kind == "secret", feistel_text(v, "secret", key, 6))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "private") -> DataFrame:
    """docs with the text's values replaced, and a column `found_col`: an array of (kind, pseudonym) in order of place.

    A column of docs that has that name is replaced.
    """
    text = F.col(text_col)
    some = text.rlike(HINT)
    taken = [c for c in docs.columns if c.lower() != found_col.lower()]
    found, parts = fresh([*docs.columns, found_col], "found", "parts")
    cut = docs.select(*taken, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias(found), F.when(some, F.split(text, ANY, -1)).alias(parts))
    pairs = F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    sized = F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["kind"].alias("kind"), inner_value(p["value"], p["kind"]).alias("at")))
    own = lambda p: F.coalesce(p["kind"], F.when(-p["at"]["less"] < F.length(p["value"]), F.when(p["value"].rlike("^[A-Z]"), "iban").otherwise("card")))
    piece = lambda p, a, n=None: F.substr(p["value"], a, n) if n is not None else F.substr(p["value"], a)
    told = F.transform(sized, lambda p: F.struct(piece(p, p["at"]["begin"], -p["at"]["less"]).alias("value"), own(p).alias("kind"), piece(p, F.lit(1), p["at"]["begin"] - 1).alias("head"), piece(p, p["at"]["begin"] - p["at"]["less"]).alias("tail")))
    new = F.transform(told, lambda p: F.struct(p["kind"].alias("kind"), pseudonym(p["value"], p["kind"], key).alias("value"), p["head"].alias("head"), p["tail"].alias("tail")))
    known = cut.withColumn(found, F.when(F.size(found) > 0, new))
    joined = F.array_join(F.concat(F.zip_with(F.slice(parts, F.lit(1), F.size(found)), F.col(found), lambda a, v: F.concat(a, v["head"], v["value"], v["tail"])), F.slice(parts, F.lit(-1), F.lit(1))), "")
    kept = F.transform(F.filter(found, lambda v: v["kind"].isNotNull()), lambda v: F.struct(v["kind"].alias("kind"), v["value"].alias("value")))
    columns = [F.when(F.col(found).isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in taken]
    return known.select(*columns, F.coalesce(kept, F.array().cast("array<struct<kind:string,value:string>>")).alias(found_col))
