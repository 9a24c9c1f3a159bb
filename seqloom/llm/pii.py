"""Operator 2: personal data becomes format-preserving pseudonyms, in DataFrame functions only.

Numbers and dates that pass their own validation (Luhn for cards, ISO 7064 for IBANs, ranges for IPv4
addresses, social security numbers, North American telephone numbers and calendar dates) are permuted within
the set of valid values of their format by a keyed Feistel network, so the same value has the same
pseudonym in every document and no two values of a format share one. The network's domain is the format's
own set; only dates whose written form holds fewer days than the calendar (one digit for the month or day, or
a day that must exceed 12 to be told from a month) walk on until a day fits the form, and a walk that has not
ended after WALK steps (never seen; below 1e-26) is an error, not a result. An IBAN has the length of its
country; of digits in groups that are no card as a whole, the longest valid card they begin with is taken (what
follows it in the same run of up to 19 digits is not scanned again). Mail addresses (in lower case, all but the
last label) and quoted secrets have no validation: their characters are permuted, whatever their number, each
within its class (digit, small letter, capital), by a Feistel network over the two halves; access keys as two
halves in base 36. What fails its validation stays as it is.

The key comes from the session (KEY_NAME). Where none is set, one is drawn for the application, so that
pseudonyms can't be reversed by who knows this code; they are then linked within that application alone.

Defined results: a null text stays null and an empty one empty, with no replacements; repeated rows are
treated alike; other columns are kept, but for those named kinds and n_replaced, which are replaced; an
empty table gives no rows; dates before 1900 and after the first day of 2100 stay.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 256
#: Where the session holds the key.
KEY_NAME = "spark.seqloom.pii.key"
_DRAWN: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The session's key, or one drawn for this application."""
    own = spark.conf.get(KEY_NAME, None)
    return own or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


#: Length of an IBAN: countries.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
EXACT = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())

#: kind: what it looks like. Order matters: the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_=.~-]{8,}+[\"']?",
    "iban": rf"(?<![A-Za-z0-9])(?:{EXACT}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])",
}


def _digest(key: str, tweak: str, x: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), x.cast("string")), 256)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: str) -> Column:
    """struct<l, r>: a keyed permutation of pairs with 0 <= l < a and 0 <= r < b."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))

    def mixed(i: Column, x: Column) -> Column:
        return F.conv(F.substr(_digest(key, tweak, F.concat_ws(":", i, x)), F.lit(1), F.lit(13)), 16, 10).cast("bigint")

    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        pair(left.cast("bigint"), right.cast("bigint")),
        lambda s, i: F.when(i % 2 == 0, pair((s["l"] + mixed(i, s["r"])) % a, s["r"])).otherwise(pair(s["l"], (s["r"] + mixed(i, s["l"])) % b)),
    )


def permuted(value: Column, a: int, b: int, key: str, tweak: str, fits=None, steps: Column | int = WALK) -> Column:
    """A keyed permutation of 0 .. a * b - 1; with fits, of the values that fit (value does), by walking on to the next that does."""

    def once(v: Column) -> Column:
        return F.element_at(F.transform(F.array(feistel(F.floor(v / F.lit(b)).cast("bigint"), v % F.lit(b).cast("bigint"), a, b, key, tweak)), lambda s: s["l"] * F.lit(b).cast("bigint") + s["r"]), 1)

    if fits is None:
        return once(value.cast("bigint"))
    steps = steps if isinstance(steps, Column) else F.lit(steps)
    end = F.aggregate(F.sequence(F.lit(1), steps), value.cast("bigint"), lambda v, i: F.when((i == 1) | ~fits(v), once(v)).otherwise(v))
    return F.element_at(F.transform(F.array(end), lambda v: F.when(fits(v), v).otherwise(F.raise_error(F.lit("a walk left its format")).cast("bigint"))), 1)


def permuted_text(x: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings with the same class of character at each place: digits, small letters, capitals; others stay."""
    at = F.transform(F.split(x, ""), lambda c: F.ascii(c))
    half = F.floor(F.char_length(x) / 2).cast("int")

    def moved(c: Column, by: Column) -> Column:
        of = lambda low, n: (c - low + by) % n + low
        return F.when(c.between(48, 57), of(48, 10)).when(c.between(97, 122), of(97, 26)).when(c.between(65, 90), of(65, 26)).otherwise(c).cast("int")

    def side(one: Column, other: Column, i: Column) -> Column:
        seed = _digest(key, tweak, F.concat_ws(":", i, F.array_join(other.cast("array<string>"), ",")))
        by = lambda h, j: F.conv(F.substr(F.sha2(F.concat_ws(":", h, j), 256), F.lit(1), F.lit(13)), 16, 10).cast("bigint")
        return F.element_at(F.transform(F.array(seed), lambda h: F.transform(one, lambda c, j: moved(c, by(h, j)))), 1)

    pair = lambda l, r: F.struct(l.alias("l"), r.alias("r"))
    start = F.element_at(F.transform(F.array(at), lambda c: pair(F.slice(c, F.lit(1), half), F.slice(c, half + 1, F.char_length(x)))), 1)
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, i: F.when(i % 2 == 0, pair(side(s["l"], s["r"], i), s["r"])).otherwise(pair(s["l"], side(s["r"], s["l"], i))))
    return F.element_at(F.transform(F.array(end), lambda s: F.array_join(F.transform(F.concat(s["l"], s["r"]), lambda c: F.char(c)), "")), 1)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def permuted_digits(d: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits (two at least)."""
    n = F.char_length(d)
    h = F.floor((n + 1) / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")
    s = feistel(F.substr(d, F.lit(1), h).cast("bigint"), F.substr(d, h + 1, n).cast("bigint"), power(h), power(n - h), key, tweak)
    return F.element_at(F.transform(F.array(s), lambda p: F.concat(F.lpad(p["l"].cast("string"), h, F.lit("0")), F.lpad(p["r"].cast("string"), n - h, F.lit("0")))), 1)


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by others, in order."""
    at = F.sequence(F.lit(1), F.char_length(shape))
    put = lambda i: F.when(F.substr(shape, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.char_length(digits_of(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1)))
    return F.array_join(F.transform(at, put), "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a string of digits whose last one is the check digit."""
    at = F.sequence(F.lit(1), F.char_length(d))
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    doubled = lambda i: (F.char_length(d) - i) % 2 == 1
    return F.aggregate(at, F.lit(0), lambda s, i: s + F.when(doubled(i), (digit(i) * 2) % 10 + F.floor(digit(i) / 5).cast("int")).otherwise(digit(i)))


def _card(x: Column, key: str) -> Column:
    """The longest valid card that x begins with and that ends at a group, and the rest of x as it is."""
    head = lambda i: F.substr(x, F.lit(1), i)

    def valid(i: Column) -> Column:
        d = digits_of(head(i))
        return F.substr(x, i, F.lit(2)).rlike("^[0-9](?:[ -]|$)") & F.char_length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike(r"^([0-9])\1*$")

    ends = F.filter(F.sequence(F.lit(13), F.char_length(x)), valid)
    made = F.transform(ends, lambda i: F.concat(_whole_card(head(i), key), F.substr(x, i + 1, F.char_length(x))))
    return F.get(made, F.size(made) - 1)


def _whole_card(x: Column, key: str) -> Column:
    d = digits_of(x)
    n = F.char_length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
    whole = F.element_at(F.transform(F.array(body), lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))), 1)
    return F.when((n >= 13) & (luhn_sum(d) % 10 == 0) & ~d.rlike(r"^([0-9])\1*$"), refilled(x, whole))


def mod97(s: Column) -> Column:
    """Remainder of an IBAN in its checking order; letters count from 10."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    at = F.sequence(F.lit(1), F.char_length(s))
    return F.aggregate(at, F.lit(0), lambda r, i: F.when(value(F.substr(s, i, F.lit(1))) > 9, r * 100 + value(F.substr(s, i, F.lit(1)))).otherwise(r * 10 + value(F.substr(s, i, F.lit(1)))) % 97)


def _iban(x: Column, key: str) -> Column:
    s = F.replace(x, F.lit(" "), F.lit(""))
    body = F.substr(s, F.lit(5), F.char_length(s))
    d = digits_of(body)
    body = F.when(F.char_length(d) >= 2, refilled(body, permuted_digits(d, key, "iban"))).otherwise(body)
    check = lambda b: F.lpad((98 - mod97(F.concat(b, F.substr(s, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    digits = F.element_at(F.transform(F.array(body), lambda b: F.concat(check(b), digits_of(b))), 1)
    ok = (mod97(F.concat(F.substr(s, F.lit(5), F.char_length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1) & F.char_length(s).between(15, 34)
    return F.when(ok, refilled(x, digits))


def _ip(x: Column, key: str) -> Column:
    o = [F.get(F.split(x, r"\."), k).cast("int") for k in range(4)]
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    low = lambda v: v % 256
    high = lambda v: F.floor(v / 256).cast("bigint")
    new = F.element_at(F.transform(F.array(s), lambda p: F.concat_ws(".", high(p["l"]), low(p["l"]), high(p["r"]), low(p["r"]))), 1)
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), new)


#: Days from the first of 1900 to the first of 2100: 487 * 150.
DAYS, FIRST_DAY = 73050, "1900-01-01"


def _date(x: Column, key: str) -> Column:
    """Permuted among the days that the same written form can hold: same order, separator and widths."""
    p = F.split(x, "[-/.]")
    year_first = F.char_length(F.get(p, 0)) == 4
    one, two = F.when(year_first, F.get(p, 1)).otherwise(F.get(p, 0)), F.when(year_first, F.get(p, 2)).otherwise(F.get(p, 1))
    year = F.when(year_first, F.get(p, 0)).otherwise(F.get(p, 2))
    # with dots the day comes first, else the month, unless it can't be one
    dotted = ~year_first & x.contains(".")
    too_large = ~year_first & ~dotted & (one.cast("int") > 12)
    day_first = dotted | too_large
    month, day = F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two)
    first = F.lit(FIRST_DAY).cast("date")
    n = F.datediff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), first)
    short = lambda c: F.char_length(c) == 1

    def fits(v: Column) -> Column:
        at = F.date_add(first, v.cast("int"))
        return (~short(month) | (F.month(at) < 10)) & (~short(day) | (F.dayofmonth(at) < 10)) & (~too_large | (F.dayofmonth(at) > 12))

    def shaped(v: Column) -> Column:
        at = F.date_add(first, v.cast("int"))
        m, d = (F.when(short(c), f(at).cast("string")).otherwise(F.lpad(f(at).cast("string"), 2, "0")) for c, f in ((month, F.month), (day, F.dayofmonth)))
        sep = F.regexp_extract(x, "[-/.]", 0)
        y = F.year(at).cast("string")
        return F.when(year_first, F.concat(y, sep, m, sep, d)).when(day_first, F.concat(d, sep, m, sep, y)).otherwise(F.concat(m, sep, d, sep, y))

    steps = F.when(short(month) | short(day) | too_large, F.lit(WALK)).otherwise(F.lit(1))
    moved = F.element_at(F.transform(F.array(permuted(n, 487, 150, key, "date", fits, steps)), shaped), 1)
    return F.when(n.between(0, DAYS - 1), moved)


def _ssn(x: Column, key: str) -> Column:
    a, g, s = (F.get(F.split(x, "-"), k).cast("bigint") for k in range(3))
    area = F.when(a > 666, a - 2).otherwise(a - 1)
    v = permuted((area * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, key, "ssn")

    def shaped(v: Column) -> Column:
        k = F.floor(v / (99 * 9999)).cast("int")
        return F.concat_ws("-", F.lpad(F.when(k >= 665, k + 2).otherwise(k + 1).cast("string"), 3, "0"), F.lpad((F.floor(v / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    ok = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)
    return F.when(ok, F.element_at(F.transform(F.array(v), shaped), 1))


def _phone(x: Column, key: str) -> Column:
    d = digits_of(x)
    american = ~x.startswith("+") | (x.startswith("+1") & (F.char_length(d) == 11))
    ten = F.substring(d, -10, 10)
    part = lambda i, n: F.substr(ten, F.lit(i), F.lit(n)).cast("bigint")
    value = (part(1, 3) - 200) * 8_000_000 + (part(4, 3) - 200) * 10_000 + part(7, 4)
    v = permuted(value, 80_000, 80_000, key, "phone")
    shaped = lambda v: F.concat(F.when(F.char_length(d) == 11, F.substr(d, F.lit(1), F.lit(1))).otherwise(F.lit("")), (F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0"))
    us = F.when((part(1, 3) >= 200) & (part(4, 3) >= 200), F.element_at(F.transform(F.array(v), lambda v: refilled(x, shaped(v))), 1))
    n = F.char_length(d)
    other = F.when(n.between(8, 15), refilled(x, F.concat(F.substr(d, F.lit(1), F.lit(2)), permuted_digits(F.substr(d, F.lit(3), n - 2), key, "phone"))))
    return F.when(american, us).otherwise(other)


def _email(x: Column, key: str) -> Column:
    low = F.lower(x)
    last = F.regexp_extract(low, r"\.[^.]*$", 0)
    return F.concat(permuted_text(F.substr(low, F.lit(1), F.char_length(low) - F.char_length(last)), key, "email"), last)


def _key(x: Column, key: str) -> Column:
    number = lambda i: F.conv(F.substr(x, F.lit(i), F.lit(8)), 36, 10).cast("bigint")
    text = lambda v: F.lpad(F.conv(v.cast("string"), 10, 36), 8, "0")
    s = feistel(number(5), number(13), 36**8, 36**8, key, "key")
    return F.element_at(F.transform(F.array(s), lambda p: F.concat(F.substr(x, F.lit(1), F.lit(4)), text(p["l"]), text(p["r"]))), 1)


def _secret(x: Column, key: str) -> Column:
    label = F.regexp_extract(x, r"^[^=:]*[=:]\s*[\"']?", 0)
    value = F.regexp_replace(F.substr(x, F.char_length(label) + 1), "[\"']$", "")
    end = F.regexp_extract(x, "[\"']$", 0)
    return F.concat(label, permuted_text(value, key, "secret"), end)


MAKERS = {"email": _email, "key": _key, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _combined() -> str:
    """All patterns in one; each group reference is renumbered to its place."""
    out, groups = [], 0
    for p in PATTERNS.values():
        if p == PATTERNS["date"]:
            p = p.replace(r"\1", rf"\{groups + 1}").replace(r"\2", rf"\{groups + 2}")
            groups += 2
        out.append(p)
    return "|".join(f"(?:{p})" for p in out)


def _kind(x: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        found = F.when(x.rlike(rf"^(?:{p})$"), F.lit(kind)).otherwise(found)
    return found


def replacement(found: Column, key: str) -> Column:
    """struct<kind, text>: the pseudonym of a match, or kind null and the match itself if it isn't valid."""
    kind = F.transform(F.array(found), lambda x: F.struct(x.alias("x"), _kind(x).alias("k")))

    def made(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, f in MAKERS.items():
            out = F.when(s["k"] == k, f(s["x"], key)).otherwise(out)
        return out

    new = F.transform(kind, lambda s: F.struct(s["x"].alias("x"), s["k"].alias("k"), made(s).alias("new")))
    return F.element_at(F.transform(new, lambda s: F.struct(F.when(s["new"].isNotNull(), s["k"]).alias("kind"), F.coalesce(s["new"], s["x"]).alias("text"))), 1)


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with its text replaced, and kinds (one for each replacement, in order) and n_replaced; the session's key unless another is given."""
    key = key or key_of(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("kinds", "n_replaced")]
    every = _combined()
    some = F.col("text").rlike("[0-9@=:]")
    out = docs.select(
        *keep,
        F.when(some, F.transform(F.regexp_extract_all("text", F.lit(every), F.lit(0)), lambda x: replacement(x, key))).alias("_found"),
    )
    hit = F.size("_found") > 0
    gaps = F.split("text", every, -1)
    put = F.zip_with(gaps, "_found", lambda g, m: F.concat(g, F.coalesce(m["text"], F.lit(""))))
    kinds = F.filter(F.transform("_found", lambda m: m["kind"]), lambda k: k.isNotNull())
    kinds = F.when(hit, kinds).otherwise(F.array().cast("array<string>"))
    text = F.when(hit, F.array_join(put, "")).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in keep], kinds.alias("kinds"), F.size(kinds).alias("n_replaced"))
