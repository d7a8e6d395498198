import datetime
import hashlib
import ipaddress
import re

import pytest
import regex

from featstab.llm import pii
from featstab.llm.common import table

from .helpers import AWKWARD, documents

KEY = "k"


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_text(kind, value, alphabets):
    """The Feistel network written down plainly."""
    half = len(value) // 2
    sides = [list(zip(value[:half], alphabets[:half], strict=True)), list(zip(value[half:], alphabets[half:], strict=True))]
    for i in range(pii.ROUNDS):
        mine, other = (0, 1) if i % 2 == 0 else (1, 0)
        digest = hashlib.sha256(f"{KEY}|{kind}|{i}|{''.join(c for c, _ in sides[other])}".encode()).hexdigest()
        moved = []
        for j, (c, a) in enumerate(sides[mine]):
            at = 2 * j % 58
            moved.append((a[(a.index(c) + int(digest[at : at + 6], 16)) % len(a)], a))
        sides[mine] = moved
    return "".join(c for side in sides for c, _ in side)


def run(spark, texts):
    rows = pii.pseudonymised(documents(spark, list(enumerate(texts))), KEY).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)], sorted(rows, key=lambda r: r.doc_id)


def test_cards_keep_their_check_digit_spelling_and_links(spark):
    got, rows = run(spark, ["pay 4111111111111111 now", "4111-1111-1111-1111", "4111 1111 1111 1111.", "4111111111111112 stays", "5500005555555559x 5500005555555559"])
    card = re.search(r"\d{16}", got[0])[0]
    head = brute_text("card", "411111111111111", [pii.DIGITS] * 15)
    assert card[:-1] == head and luhn(card) and card != "4111111111111111"
    assert got[1].replace("-", "") == card and got[2].replace(" ", "") == card + "."
    assert got[3] == "4111111111111112 stays" and got[4].startswith("5500005555555559x ") and not got[4].endswith("5500005555555559")
    assert [r.n_card for r in rows] == [1, 1, 1, 0, 1]


def test_telephones(spark):
    got, _ = run(spark, ["+1 (269) 555-3296 5500005555555559", "269-555-3296"])
    want = brute_text("phone", "2695553296", ["23456789", *[pii.DIGITS] * 2, "23456789", *[pii.DIGITS] * 6])
    assert re.match(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) ", got[0]).groups() == (want[:3], want[3:6], want[6:])
    assert got[1] == f"{want[:3]}-{want[3:6]}-{want[6:]}" and "5500005555555559" not in got[0]


def test_addresses_and_account_numbers(spark):
    got, _ = run(spark, ["bosbt.42@mail8.example.com, 70.123.182.155 and 300.1.1.1 and v1.2.3.4.5", "GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432", "GB83WEST12345698765432"])
    name = brute_text("email", "bosbt42", [pii.LETTERS + pii.DIGITS] * 7)
    assert got[0].startswith(f"{name[:5]}.{name[5:]}@mail8.example.com, ") and got[0].endswith(" and 300.1.1.1 and v1.2.3.4.5")
    ip = got[0].split()[1]
    assert ip != "70.123.182.155" and all(0 <= int(o) <= 255 for o in ip.split("."))
    a, b = got[1].split(" or ")
    assert a.replace(" ", "") == b and b != "GB82WEST12345698765432" and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", a)
    assert int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
    assert got[2] == "GB83WEST12345698765432"


def test_dates(spark):
    got, rows = run(spark, ["born 1984-02-29", "29.02.1984", "2/29/1984", "29/2/1984", "1983-02-29", "1984-13-01 1984-2-29"])
    iso = datetime.date.fromisoformat(got[0][5:])
    assert iso != datetime.date(1984, 2, 29) and 1800 <= iso.year < 2200
    assert got[1] == iso.strftime("%d.%m.%Y") and got[2] == f"{iso.month}/{iso.day:02d}/{iso.year}" and got[3] == f"{iso.day:02d}/{iso.month}/{iso.year}"
    assert got[4] == "1983-02-29" and got[5] == f"1984-13-01 {iso.year}-{iso.month}-{iso.day:02d}"
    assert [r.n_date for r in rows] == [1, 1, 1, 1, 0, 1]


def test_permutations_have_no_collisions(spark):
    texts = [str(datetime.date(1990, 1, 1) + datetime.timedelta(i)) for i in range(800)] + [f"10.0.{i // 256}.{i % 256}" for i in range(800)] + [f"536-{i:02d}-4321" for i in range(1, 100)]
    got, _ = run(spark, texts)
    assert len(set(got)) == len(texts)
    assert all(re.fullmatch(r"\d{3}-\d\d-\d{4}", x) and not re.match("000|666|9|...-00|.*-0000", x) for x in got[-99:])


def test_awkward_rows_other_columns_and_empty_table(spark):
    docs = documents(spark, [r[:2] for r in AWKWARD]).selectExpr("*", "7 AS _row", "8 AS n_card", "9 AS k", "10 AS m")
    got = pii.pseudonymised(docs, KEY)
    assert sorted(map(str, got.select("doc_id", "text", "_row", "k", "m").collect())) == sorted(map(str, docs.select("doc_id", "text", "_row", "k", "m").collect()))
    assert got.where("n_card + n_phone > 0").count() == 0
    assert pii.pseudonymised(docs.where("false"), KEY).count() == 0


def test_long_text_and_gaps_survive(spark):
    text = "".join(f"é {i} a{i}@b.example.org\n" for i in range(3000))
    got, rows = run(spark, [text])
    assert rows[0].n_email == 3000 and re.sub(r"\w+@", "@", got[0]) == re.sub(r"\w+@", "@", text)


@pytest.mark.parametrize("key", ["a", "b"])
def test_key_matters(spark, key):
    row = pii.pseudonymised(documents(spark, [(1, "4111111111111111")]), key).first()
    other = pii.pseudonymised(documents(spark, [(1, "4111111111111111")]), "c").first()
    assert row.text != other.text


def test_plan_is_native(spark):
    plan = pii.pseudonymised(documents(spark, [(1, "x")]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_numbers(kind, left, right, n_left, n_right):
    for i in range(pii.ROUNDS):
        digest = int(hashlib.sha256(f"{KEY}|{kind}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:12], 16)
        if i % 2 == 0:
            left = (left + digest) % n_left
        else:
            right = (right + digest) % n_right
    return left, right


def respelt(value, new, kept):
    """``value`` with its last characters of a class replaced by those of ``new``."""
    new, out = list(new), []
    for c in reversed(value):
        out.append(new.pop() if new and re.fullmatch(f"[{kept}]", c) else c)
    return "".join(reversed(out))


def remainder(account):
    return int("".join(str(int(c, 36)) for c in account)) % 97


def brute_value(m):
    """(kind, pseudonym) of a candidate, written down case by case; None if it isn't valid."""
    digits = re.sub(r"\D", "", m)
    if "@" in m:
        name, _, domain = m.partition("@")
        if not name.isascii():
            moved = iter(brute_letters("".join(c for c in name.lower() if regex.match(r"[\p{L}\p{N}]", c))))
            return "email", "".join(next(moved) if regex.match(r"[\p{L}\p{N}]", c) else c for c in name.lower()) + "@" + domain
        letters = re.sub("[^a-z0-9]", "", name.lower())
        if not letters:
            return None
        return "email", respelt(name.lower(), brute_text("email", letters, [pii.LETTERS + pii.DIGITS] * len(letters)), "a-z0-9") + "@" + domain
    if re.match("[A-Z]{2}[0-9]{2}[A-Z0-9 ]", m):
        flat = m.replace(" ", "")
        if remainder(flat[4:] + flat[:4]) != 1:
            return None
        body = brute_text("iban", flat[4:], [pii.DIGITS if c.isdigit() else pii.LETTERS.upper() for c in flat[4:]])
        return "iban", respelt(m, f"{flat[:2]}{98 - remainder(body + flat[:2] + '00'):02d}{body}", "A-Z0-9")
    if m.count(":") == 7 or "::" in m:
        try:
            x = brute_text("ip6", ipaddress.IPv6Address(m).exploded.replace(":", ""), [pii.HEX] * 32)
        except ValueError:
            return None
        return "ip6", ":".join(f"{int(x[i : i + 4], 16):x}" for i in range(0, 32, 4))
    if re.fullmatch(r"\d+(\.\d+){3}", m) and not re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        left, right = brute_numbers("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16)
        return "ip", ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if re.fullmatch(r"\d{4}([-/])\d{1,2}\1\d{1,2}|\d{1,2}([./])\d{1,2}\2\d{4}", m):
        part, sep = re.split("[-/.]", m), re.search("[-/.]", m)[0]
        order = "ymd" if len(part[0]) == 4 else "mdy" if sep != "." and int(part[0]) <= 12 else "dmy"
        by = dict(zip(order, part, strict=True))
        try:
            day = datetime.date(int(by["y"]), int(by["m"]), int(by["d"]))
        except ValueError:
            return None
        if not 1800 <= day.year < 2200:
            return None
        a, b = brute_numbers("date", *divmod((day - datetime.date(1800, 1, 1)).days, 773), 189, 773)
        new = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
        shown = {"y": f"{new.year:04d}"} | {k: f"{x:0{2 if len(by[k]) == 2 else 1}d}" for k, x in (("m", new.month), ("d", new.day))}
        return "date", sep.join(shown[k] for k in order)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        if re.match("000|666|9|...-00|.*-0000", m):
            return None
        sets = ["0" if c == "0" else "123456789" if i > 2 else "6" if c == "6" else "1234578" if i == 0 else "12345789" for i, c in enumerate(digits)]
        return "ssn", respelt(m, brute_text("ssn", digits, sets), "0-9")
    if re.fullmatch(r"(\+1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m):
        last = digits[-10:]
        sets = [("01" if c in "01" else "23456789") if i in (0, 3) else pii.DIGITS for i, c in enumerate(last)]
        return "phone", respelt(m, brute_text("phone", last, sets), "0-9")
    if m[0] == "+":
        if not 8 <= len(digits) <= 15:
            return None
        code = 1 if digits[0] in pii.ONE_DIGIT else 2 if digits[:2] in pii.TWO_DIGITS else 3
        sets = [pii.DIGITS if i else "0" if c == "0" else "123456789" for i, c in enumerate(digits[code:])]
        return "abroad", respelt(m, digits[:code] + brute_text("abroad", digits[code:], sets), "0-9")
    if not luhn(digits) or not digits.strip("0"):
        return None
    head = brute_text("card", digits[:-1], [pii.DIGITS] * (len(digits) - 1))
    return "card", respelt(m, head + next(c for c in pii.DIGITS if luhn(head + c)), "0-9")


def compare(spark, rows, got):
    for (d, text), r in zip(sorted(rows), sorted(got, key=lambda r: r.doc_id), strict=True):
        found = []

        def new(m, found=found):
            value = brute_value(m[0])
            found.append(value and value[0])
            return value[1] if value else m[0]

        want = None if text is None else regex.sub(pii.PATTERN, new, text)
        assert (d, want) == (r.doc_id, r.text)
        assert [found.count(k) for k in pii.KINDS] == [r[f"n_{k}"] for k in pii.KINDS]


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        compare(spark, rows, pii.op1_feistel_pseudonyms(spark, sf).collect())
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_every_kind_equals_brute_force(spark):
    texts = [
        "BE68 5390 0754 7034 PAID and BE68539007547034, BE68 5390 0754 7035 or DE89 3704 0044 0532 0130 00 AB",
        "ZZ79 1234 5678 9012 3456 is of no known country",
        "j\u00fcrgen.m\u00fcller@x.de, J\u00dcRGEN@x.de and a+b_c%d@sub.example.co.uk",
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334 2001:DB8:85A3:0:0:8A2E:370:7334, 12:30:45 and 1:2:3:4:5:6:7:8:9",
        "2001:db8::8a2e:370:7334 and 2001:0DB8:0:0::8A2E:0370:7334 are 2001:db8:0:0:0:8a2e:370:7334; fe80::1, fd12:3:4:5:6:7::8; std::abs, dead::beef, a::b, ::1, 2001:db8::/32, 2001:1:2:3:4:5:6::7:8",
        "+49 30 1234567, +44 (0)20 7946 0958, +358.9.123.456 and +12 or +1 212 555 0100 (212) 555-0100 212.555.0100",
        "10.0.0.1 255.255.255.256 1984-02-29 31.12.1999 7/4/1976 078-05-1120 000-12-3456 4111 1111 1111 1111 378282246310005",
    ]
    got = pii.pseudonymised(documents(spark, list(enumerate(texts))), KEY).collect()
    compare(spark, list(enumerate(texts)), got)
    by = {r.doc_id: r for r in got}
    assert by[0].n_iban == 3 and "BE68 5390 0754 7034" not in by[0].text and " PAID and " in by[0].text and by[0].text.endswith(" AB")
    assert by[2].n_email == 3 and "j\u00fcrgen" not in by[2].text.lower()
    assert by[3].n_ip6 == 2 and len(set(re.findall(r"(?:[0-9a-f]+:){7}[0-9a-f]+", by[3].text.split(", ")[0]))) == 1
    assert by[4].n_ip6 == 5 and len(set(re.findall(r"(?:[0-9a-f]+:){7}[0-9a-f]+", by[4].text.split("; ")[0]))) == 1
    assert by[4].text.endswith("; std::abs, dead::beef, a::b, ::1, 2001:db8::/32, 2001:1:2:3:4:5:6::7:8")
    assert by[5].n_abroad == 3 and by[5].n_phone == 3 and by[5].text.startswith("+49 ") and "+44 (0)" in by[5].text


def test_key_is_configured_or_lasts_for_the_application(spark):
    assert pii.configured_key(spark) == pii.configured_key(spark) and len(pii.configured_key(spark)) == 64
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.configured_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def brute_letters(value):
    """The network over letters and digits of any script, written down plainly."""

    def place(c):
        n = ord(c)
        if c in pii.LETTERS + pii.DIGITS:
            return (pii.LETTERS + pii.DIGITS).index(c), -1, 36
        for first, last in pii.SCRIPTS:
            if first <= n <= last:
                return n - first, first, last - first + 1
        return n % 16, n - n % 16, 16

    half = len(value) // 2
    sides = [list(map(place, value[:half])), list(map(place, value[half:]))]
    for i in range(pii.ROUNDS):
        mine, other = (0, 1) if i % 2 == 0 else (1, 0)
        digest = hashlib.sha256(f"{KEY}|email|{i}|{','.join(f'{b}:{c}' for c, b, _ in sides[other])}".encode()).hexdigest()
        sides[mine] = [((c + int(digest[3 * j % 56 : 3 * j % 56 + 8], 16)) % n, b, n) for j, (c, b, n) in enumerate(sides[mine])]
    return "".join((pii.LETTERS + pii.DIGITS)[c] if b < 0 else chr(b + c) for side in sides for c, b, _ in side)


def test_names_of_any_script(spark):
    names = ["иван", "ИВАН", "李", "jürgen", "Jürgen.Ö", "δημήτρης", "김철수", "やまだ.7", "محمد", "दिल", "𝒜bc", "x²", "ꙗꙗ", "a.é-_b9"]
    got, rows = run(spark, [f"mail {n}@mail.ru, thanks" for n in names] + ["_%-@x.com", "иван@mail.ru иван@mail.ru"])
    for name, text, row in zip(names, got, rows, strict=False):
        low = name.lower()
        letters = iter(brute_letters(re.sub(r"[._%+-]", "", "".join(c for c in low if regex.match(r"[\p{L}\p{N}]", c)))))
        assert text == "mail " + "".join(next(letters) if regex.match(r"[\p{L}\p{N}]", c) else c for c in low) + "@mail.ru, thanks" and row.n_email == 1
    assert got[0] == got[1] and "иван" not in got[0] and "李" not in got[2] and "ü" not in got[3][5:11].replace(brute_letters("jürgen"), "")
    assert got[-2] == "_%-@x.com" and rows[-2].n_email == 0
    one, two = got[-1].split()
    assert one == two == got[0].split()[1].rstrip(",") and rows[-1].n_email == 2
    assert regex.fullmatch(r"\p{Cyrillic}{4}@mail\.ru", one)


def test_names_of_one_script_stay_apart(spark):
    letters = "абвгдежз"
    names = [a + b + c for a in letters for b in letters for c in letters]
    got, _ = run(spark, [" ".join(f"{n}@x.de" for n in names)])
    assert len(set(got[0].split())) == len(names) and not set(got[0].split()) <= {f"{n}@x.de" for n in names}


def test_time_stamps(spark):
    got, rows = run(spark, ["at 2020-02-03T10:00:00Z", "2020-02-03Total", "2020-02-03"])
    assert [r.n_date for r in rows] == [1, 0, 1] and got[0] == f"at {got[2]}T10:00:00Z" and got[2] != "2020-02-03"
