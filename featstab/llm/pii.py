"""Format-preserving pseudonyms for personal data, in native expressions only.

One pattern finds the candidates; each is validated (check digits, ranges, calendar) and then permuted by a keyed Feistel network
within its own format: a card number becomes another with a right check digit, a date another date, an address another address.
The permutation depends on the key and the value alone, not on its spelling or its document, so equal values stay linked across
documents, and two values of one length never become one.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Where the key of a deployment is configured.
KEY_SETTING = "spark.featstab.pseudonymKey"
#: Kinds in the order in which a candidate is tried.
KINDS = ("email", "iban", "ip6", "ip", "date", "ssn", "phone", "abroad", "card")
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
# Characters of an account number by country (ISO 13616).
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of telephones with one and with two digits (ITU E.164); all others have three.
ONE_DIGIT, TWO_DIGITS = ("1", "7"), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    spaced = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})(?![0-9A-Za-z])"


#: Account numbers of the countries above have their length; those of others may have any.
_KNOWN, _OTHER = "|".join(_account(*x) for x in ACCOUNT_LENGTHS.items()), "|".join(" ".join(ACCOUNT_LENGTHS.values()).split())
#: A network address with groups left out, if it is one of a host (global, of a site or of a link): words and code have double colons too.
_SHORT = r"(?:[23][0-9A-Fa-f]{3}|[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee][89AaBb][0-9A-Fa-f])(?::[0-9A-Fa-f]{1,4}){0,6}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
SHAPES = {
    "email": r"(?<![\p{L}\p{N}\p{M}._%+-])[\p{L}\p{N}\p{M}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ])(?:{_KNOWN}|(?!{_OTHER})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?))",
    "ip6": rf"(?<!:)(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{7}}|{_SHORT})(?!:[0-9A-Fa-f])",
    "ip": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "date": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "abroad": r"\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,12}){1,5}",
    "card": r"[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19}",
}
#: What may follow a value; the time of day may follow a date.
_BEHIND = {"date": r"(?:(?![0-9A-Za-z])|(?=T[0-9]{2}:))"}
PATTERN = r"(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{SHAPES[k]})" + _BEHIND.get(k, "(?![0-9A-Za-z])") for k in KINDS) + ")"
# Ranges of code points that are letters, or digits, of one script throughout (Unicode).
SCRIPTS = (
    (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x24F), (0x3AC, 0x3CE), (0x430, 0x45F), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x660, 0x669), (0x904, 0x939), (0x966, 0x96F),
    (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3),
)
#: Letters and digits of no such range move among so many neighbours.
NEIGHBOURS = 16


def _long(x: Column) -> Column:
    return x.cast("long")


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256)


def _part(digest: Column, at: Column, length: int) -> Column:
    """``length`` hexadecimal digits of the digest from ``at`` (from 0) on, as a number; ``at`` wraps around."""
    return _long(F.conv(F.substr(digest, F.pmod(at, F.lit(64 - length)).cast("int") + 1, F.lit(length)), 16, 10))


def permuted_number(key: str, kind: str, left: Column, right: Column, n_left: int, n_right: int) -> Column:
    """Struct (l, r) of a permuted pair of numbers under ``n_left`` and ``n_right``."""

    def turn(pair: Column, i: Column) -> Column:
        shift = lambda x, other, n: F.pmod(x + _part(_hash(key, kind, i, other), F.lit(0), 12), F.lit(n).cast("long"))
        l, r = pair["l"], pair["r"]
        even = i % 2 == 0
        return F.struct(F.when(even, shift(l, r, n_left)).otherwise(l).alias("l"), F.when(even, r).otherwise(shift(r, l, n_right)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), turn)


def permuted_text(key: str, kind: str, value: Column, alphabet: Callable[[Column, Column], Column]) -> Column:
    """``value`` permuted character by character within the alphabets that alphabet(character, position from 0) gives.

    A character's alphabet holds it and is the same for all of its members, so the result is as permutable as the value."""
    places = F.sequence(F.lit(0), F.length(value) - 1)
    chars = F.transform(places, lambda i: F.struct(F.substr(value, i + 1, F.lit(1)).alias("c"), alphabet(F.substr(value, i + 1, F.lit(1)), i).alias("a")))
    half = F.floor(F.length(value) / 2).cast("int")
    text = lambda part: F.array_join(F.transform(part, lambda x: x["c"]), "")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        digest = _hash(key, kind, i, text(other))
        return F.transform(part, lambda x, j: F.struct(F.substr(x["a"], F.pmod(F.instr(x["a"], x["c"]) - 1 + _part(digest, 2 * j, 6), F.length(x["a"])).cast("int") + 1, F.lit(1)).alias("c"), x["a"].alias("a")))

    def turn(pair: Column, i: Column) -> Column:
        l, r = pair["l"], pair["r"]
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(l, r, i)).otherwise(l).alias("l"), F.when(even, r).otherwise(shifted(r, l, i)).alias("r"))

    start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.length(value) - half).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda pair: F.concat(text(pair["l"]), text(pair["r"])))
    return F.when(F.length(value) > 0, done).otherwise(value)


def permuted_letters(key: str, kind: str, value: Column) -> Column:
    """``value``, letters and digits of any script in lower case, each permuted within its own range of code points."""
    code = lambda i: _long(F.ascii(F.substr(value, i, F.lit(1))))

    def place(i: Column) -> Column:
        c = code(i)
        base, size = c - c % NEIGHBOURS, F.lit(NEIGHBOURS)
        for first, last in SCRIPTS:
            base, size = F.when(c.between(first, last), first).otherwise(base), F.when(c.between(first, last), last - first + 1).otherwise(size)
        latin, digit = c.between(97, 122), c.between(48, 57)
        at = F.when(latin, c - 97).when(digit, c - 22).otherwise(c - base)  # a-z and 0-9 are one alphabet
        return F.struct(at.alias("c"), F.when(latin | digit, -1).otherwise(base).cast("long").alias("b"), F.when(latin | digit, 36).otherwise(size).cast("long").alias("n"))

    places = F.transform(F.sequence(F.lit(1), F.length(value)), place)
    half = F.floor(F.length(value) / 2).cast("int")
    shown = lambda part: F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["b"], x["c"])), ",")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        digest = _hash(key, kind, i, shown(other))
        return F.transform(part, lambda x, j: F.struct(F.pmod(x["c"] + _part(digest, 3 * j, 8), x["n"]).alias("c"), x["b"].alias("b"), x["n"].alias("n")))

    def turn(pair: Column, i: Column) -> Column:
        l, r = pair["l"], pair["r"]
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(l, r, i)).otherwise(l).alias("l"), F.when(even, r).otherwise(shifted(r, l, i)).alias("r"))

    def written(x: Column) -> Column:
        plain = F.substr(F.lit(LETTERS + DIGITS), x["c"].cast("int") + 1, F.lit(1))
        return F.when(x["b"] < 0, plain).otherwise(F.decode(F.unhex(F.lpad(F.hex(x["b"] + x["c"]), 8, "0")), "UTF-32"))

    start = F.struct(F.slice(places, F.lit(1), half).alias("l"), F.slice(places, half + 1, F.length(value) - half).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda pair: F.array_join(F.transform(F.concat(pair["l"], pair["r"]), written), ""))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _respelt(m: Column, kept: str, value: Column) -> Column:
    """``m`` with its characters of class ``kept`` replaced by those of ``value``, last by last."""
    n = F.length(F.regexp_replace(m, f"[^{kept}]", "")) - F.length(value)  # so many come first and stay

    def char(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substr(m, F.lit(1), i), f"[^{kept}]", "")) - n
        return F.when(c.rlike(f"[{kept}]") & (at > 0), F.substr(value, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled``: 1 if the last digit counts once, 0 if it counts twice."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _long(F.substr(digits, n - i, F.lit(1)))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), add)


def _mod97(account: Column) -> Column:
    """Remainder of an account number, its letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    at = lambda i: F.substr(account, i, F.lit(1))
    add = lambda total, i: _long((total * F.when(at(i).rlike("[0-9]"), 10).otherwise(100) + value(at(i))) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0).cast("long"), add)


def _ymd(m: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a date in any of the spellings; slashes: month first where that can be."""
    part = F.split(m, "[-/.]")
    n = [_long(F.get(part, F.lit(i))) for i in range(3)]
    year_first, dots = F.length(F.get(part, F.lit(0))) == 4, F.instr(m, ".") > 0
    month_first = ~dots & (n[0] <= 12)
    year = F.when(year_first, n[0]).otherwise(n[2])
    month = F.when(year_first, n[1]).when(month_first, n[0]).otherwise(n[1])
    return year, month, F.when(year_first, n[2]).when(month_first, n[1]).otherwise(n[0])


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    year, month, day = _ymd(m)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    digits, flat = _digits(m), F.regexp_replace(m, " ", "")
    octets = F.transform(F.split(m, "\\."), lambda o: _long(o) <= 255)
    full = {k: m.rlike(f"^(?:{SHAPES[k]})$") for k in KINDS}
    short = (F.length(digits) >= 8) & (F.length(digits) <= 15)
    found = F.when(F.instr(m, "@") > 0, F.when(m.rlike(r"^[^@]*[\p{L}\p{N}]"), "email"))
    found = found.when(full["iban"], F.when(_mod97(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))) == 1, "iban"))
    groups = F.size(F.split(F.replace(m, F.lit("::"), F.lit(":")), ":"))
    found = found.when(full["ip6"], F.when((F.instr(m, "::") == 0) | (groups < 8), "ip6")).when(full["ip"], F.when(F.forall(octets, lambda o: o), "ip"))
    found = found.when(full["date"], F.when(year.between(1800, 2199) & month.between(1, 12) & day.between(1, 31) & (day <= days), "date"))
    found = found.when(full["ssn"], F.when(~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
    return found.when(full["phone"], "phone").when(full["abroad"], F.when(short, "abroad")).when(full["card"], F.when((_luhn(digits, 1) % 10 == 0) & (F.translate(digits, "0", "") != ""), "card"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Another value of the same kind and spelling."""
    digit = F.lit(DIGITS)
    # e-mail: the name before the @, in lower case; the domain stays
    name = F.lower(F.regexp_extract(m, "^[^@]*", 0))
    plain = _respelt(name, "a-z0-9", permuted_text(key, "email", F.regexp_replace(name, "[^a-z0-9]", ""), lambda c, i: F.lit(LETTERS + DIGITS)))
    of_any_script = _respelt(name, r"\p{L}\p{N}", permuted_letters(key, "email", F.regexp_replace(name, r"[^\p{L}\p{N}]", "")))
    email = F.concat(F.when(name.rlike(r"[^\x00-\x7F]"), of_any_script).otherwise(plain), F.regexp_extract(m, "@.*$", 0))
    # account number: digits and letters of the part after the check digits, which are computed anew
    flat = F.regexp_replace(m, " ", "")
    body = permuted_text(key, "iban", F.substr(flat, F.lit(5)), lambda c, i: F.when(c.rlike("[0-9]"), digit).otherwise(F.lit(LETTERS.upper())))
    check = F.lpad((98 - _mod97(F.concat(body, F.substr(flat, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    iban = _respelt(m, "A-Z0-9", F.concat(F.substr(flat, F.lit(1), F.lit(2)), check, body))
    # network address of eight groups: all of its 32 digits, leading noughts of a group left out; groups left out are written
    sides = F.split(F.lower(m), "::")
    first, last = F.split(F.get(sides, F.lit(0)), ":"), F.coalesce(F.split(F.get(sides, F.lit(1)), ":"), F.array().cast("array<string>"))
    nibbles = F.array_join(F.transform(F.concat(first, F.array_repeat(F.lit("0"), 8 - F.size(first) - F.size(last)), last), lambda g: F.lpad(g, 4, "0")), "")
    moved6 = permuted_text(key, "ip6", nibbles, lambda c, i: F.lit(HEX))
    ip6 = F.element_at(F.transform(F.array(moved6), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(x, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":")), 1)
    # network address: two pairs of octets
    o = [_long(F.get(F.split(m, "\\."), F.lit(i))) for i in range(4)]
    pair = permuted_number(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16)
    halves = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    ip = F.element_at(F.transform(F.array(pair), lambda p: F.concat_ws(".", halves(p["l"]), halves(p["r"]))), 1)
    # date: a day of the 400 years from 1800 on, 189 x 773 days
    year, month, day = _ymd(m)
    ordinal = F.date_diff(F.make_date(year.cast("int"), month.cast("int"), day.cast("int")), F.lit("1800-01-01").cast("date"))
    moved = F.transform(F.array(permuted_number(key, "date", F.floor(ordinal / 773), ordinal % 773, 189, 773)), lambda p: F.date_add(F.lit("1800-01-01").cast("date"), (p["l"] * 773 + p["r"]).cast("int")))

    def spelt(d: Column) -> Column:
        part = F.split(m, "[-/.]")
        width = lambda i: F.length(F.get(part, F.lit(i)))
        two = lambda x, i: F.when(width(i) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        y, mo, da = F.lpad(F.year(d).cast("string"), 4, "0"), F.month(d), F.dayofmonth(d)
        sep, month_first = F.regexp_extract(m, "[-/.]", 0), (F.instr(m, ".") == 0) & (_long(F.get(part, F.lit(0))) <= 12)
        late = F.when(month_first, F.concat(two(mo, 0), sep, two(da, 1), sep, y)).otherwise(F.concat(two(da, 0), sep, two(mo, 1), sep, y))
        return F.when(width(0) == 4, F.concat(y, sep, two(mo, 1), sep, two(da, 2))).otherwise(late)

    date = F.element_at(F.transform(moved, spelt), 1)
    digits = _digits(m)
    # social security number: noughts and, in front, sixes keep their places, so it stays valid
    zero = lambda c, rest: F.when(c == "0", F.lit("0")).otherwise(rest)
    ssn = _respelt(m, "0-9", permuted_text(key, "ssn", digits, lambda c, i: zero(c, F.when(i > 2, F.lit("123456789")).when(c == "6", F.lit("6")).when(i == 0, F.lit("1234578")).otherwise(F.lit("12345789")))))
    # telephone: the last ten digits; area and exchange keep to 2-9 where they do
    starts = lambda c, i: F.when((i == 0) | (i == 3), F.when(c.isin("0", "1"), F.lit("01")).otherwise(F.lit("23456789"))).otherwise(digit)
    phone = _respelt(m, "0-9", permuted_text(key, "phone", F.substr(digits, F.length(digits) - 9, F.lit(10)), starts))
    # other telephones: what follows the country's code; its first digit keeps to 1-9 where it does
    own = F.when(digits.rlike(f"^(?:{'|'.join(ONE_DIGIT)})"), 1).when(digits.rlike(f"^(?:{'|'.join(TWO_DIGITS)})"), 2).otherwise(3)
    inside = F.concat(F.substr(digits, F.lit(1), own), permuted_text(key, "abroad", F.substr(digits, own + 1), lambda c, i: F.when(i > 0, digit).when(c == "0", F.lit("0")).otherwise(F.lit("123456789"))))
    abroad = _respelt(m, "0-9", inside)
    # card: all but the check digit, which is computed anew
    head = F.transform(F.array(permuted_text(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1), lambda c, i: digit)), lambda h: F.concat(h, F.pmod(-_luhn(h, 0), F.lit(10)).cast("string")))
    card = _respelt(m, "0-9", F.element_at(head, 1))
    made = {"email": email, "iban": iban, "ip6": ip6, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "abroad": abroad, "card": card}
    found = F.when(kind.isNull(), m)
    for k in KINDS:
        found = found.when(kind == k, made[k])
    return found


def pseudonymised(docs: DataFrame, key: str, text: str = "text", chars: str | None = None) -> DataFrame:
    """The rows of ``docs``, columns as they are but for ``text``, plus ``n_<kind>`` for each kind: replacements in the row.

    Null stays null with counts 0; empty texts and texts without valid values stay as they are. Values are replaced wherever they
    stand, in texts of any length. A number that only looks like a kind (wrong check digit, 31 February, octet over 255) stays.
    Letters and digits of an e-mail name move within their own script, its marks stay (those of rarer scripts among sixteen neighbours); a name without
    any is no address. The key stands in the plan, so a deployment redacts it there (spark.redaction.string.regex).
    Slashed dates count as month first where that is possible. Network addresses of eight groups are spelt in full, without
    leading noughts. Columns of ``docs`` named like a count are replaced by it. ``chars`` names a column for the new length. Equal values
    become equal values in every row; repeated rows stay equal. No shuffle."""
    rows = docs.select(F.struct("*").alias("_row"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)).alias("_m"))
    rows = rows.select("_row", F.transform("_m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))).alias("_found"))
    rows = rows.withColumn("_new", F.transform("_found", lambda x: pseudonym(x["m"], x["k"], key)))
    old = F.col("_row")[text]
    gaps = F.split(old, PATTERN, -1)
    woven = F.concat(F.array_join(F.transform("_new", lambda n, i: F.concat(F.get(gaps, i), n)), ""), F.element_at(gaps, -1))
    rows = rows.select("_row", "_found", F.when(F.exists("_found", lambda x: x["k"].isNotNull()), woven).otherwise(old).alias("_text"))

    def count(kind: str) -> Column:
        return F.when(F.col("_found").isNull(), 0).otherwise(F.size(F.filter("_found", lambda x: x["k"] == kind))).cast("long")

    counts = {f"n_{k}": count(k) for k in KINDS}
    changed = {text: F.col("_text")} | ({chars: F.length("_text").cast(docs.schema[chars].dataType)} if chars else {})
    return rows.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns if c not in counts), *(v.alias(c) for c, v in counts.items()))


@lru_cache
def _own_key(application: str) -> str:
    """A random key for an application without a configured one."""
    del application
    return secrets.token_hex(32)


def configured_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING. Where it is unset, a random one that lasts as long as the application: values are linked within it,
    and nobody can link or invert them later."""
    return spark.conf.get(KEY_SETTING, None) or _own_key(spark.sparkContext.applicationId)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised, and what was replaced."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))
