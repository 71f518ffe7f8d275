"""Format-preserving Feistel pseudonyms for personal data and secrets, in DataFrame expressions only.

One pattern finds candidates; each is validated by kind (payment cards by Luhn's check digit, dates by the calendar, IPv4
addresses and social security numbers by their ranges, phone numbers by the North American plan) and then permuted
within its format by a keyed alternating Feistel network over Z_m x Z_n: a value is a pair (a, b), even
rounds add a keyed hash of b to a modulo m, odd rounds one of a to b modulo n. The same value becomes the same pseudonym
in every document and spelling, different values stay different, and the pseudonym passes the same validation.

- cards: found in runs of digit groups also beside other numbers, groups whole; the first digit stays, the middle ones are permuted, the check digit is made anew
- dates: permuted among the 146,097 days from 1700 to 2099, in the notation found (yyyy-MM-dd, M/d/yyyy, d.M.yyyy, and
  d/M/yyyy where M/d/yyyy makes no date, with leading zeros unless a part has one digit; a slashed date that could be both is
  read month first, so slashed pseudonyms of the two notations can be spelt alike)
- IPv4, social security numbers: permuted among all valid ones
- phones: the leading digit of area and exchange stays, the other eight are permuted, marks stay
- e-mail addresses, key-like tokens and passwords: letters permuted among letters of their case, digits among digits (or
  hexadecimal among hexadecimal), blocks of up to 20 characters; a domain, and what names the secret, stays

Not covered, and left as they are: phone numbers of other plans (+44 20 7946 0958) and without an area code (555-0199), IBANs, IPv6
addresses, tokens without a name before them (sk_live_...), names, street addresses, dates with month names.

Edge cases: null texts stay null and count nothing; empty ones are unchanged. Rows are kept as they are, repeated ones too;
other columns stay. Numbers that fail their validation are left alone, and so is what stands after a digit, after a digit
with '.' or '-' (a part of a longer number), and phones and cards after '+' (numbers of other plans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import own_prefix

ROUNDS = 8
KINDS = ("email", "secret", "ssn", "ip", "date", "phone", "card")
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_key)(?: ?[=:] ?)\"?[A-Za-z0-9+/_-]{8,}"
SSN = r"\d{3}-\d{2}-\d{4}(?![-\d])"
IP = r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"\d{4}-\d{2}-\d{2}(?![-\d])|\d{1,2}/\d{1,2}/\d{4}(?![/\d])|\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)"
PHONE = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)"
#: 13 digits or more in groups, up to where another kind begins: `cards_in` finds the cards in it.
RUN = rf"(?=\d(?:[ -]?\d){{12}})\d++(?:-\d++| (?!{SSN}|{IP}|{DATE}|{PHONE})\d++)*+"
SHAPES = (r"[2-5]\d{3}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{1,3}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{4,5}", r"\d{13,19}")
NETWORK = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|220[0-4]\d{12,15}|3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|5[06-9]\d{11,17}|6\d{12,18})$"
#: No part of a longer number: after brackets, signs and full stops values count, unless those follow a digit.
START = r"(?<!\d)(?<!\d[.-])"
PATTERN = rf"(?<![A-Za-z0-9._%+-])(?:{EMAIL})|(?<![A-Za-z0-9])(?:{SECRET})|{START}(?:{SSN}|{IP}|{DATE}|(?<!\+)(?:{PHONE}|{RUN}))|(?<![\w.])(?:\+1[ .-]?)?\(\d{{3}}\) ?[2-9]\d{{2}}[ .-]\d{{4}}(?!\d)|(?<![\w.])\+1[ .-]?[2-9]\d{{2}}[ .-][2-9]\d{{2}}[ .-]\d{{4}}(?!\d)"
DAYS, FIRST_DAY = (189, 773), "1700-01-01"  # 189 * 773 days: four centuries
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def feistel(a: Column, m: Column, b: Column, n: Column, tweak: Column, key: str) -> Column:
    """The pair (a, b) of 0 <= a < m, 0 <= b < n permuted: a struct of x and y."""

    def digest(i, half, k):
        h = F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), F.lit(1), F.lit(15)), 16, 10)
        return F.pmod(h.cast("long"), k)

    def step(acc, i):
        even = i % 2 == 0
        x = F.when(even, F.pmod(acc["x"] + digest(i, acc["y"], m), m)).otherwise(acc["x"])
        y = F.when(even, acc["y"]).otherwise(F.pmod(acc["y"] + digest(i, acc["x"], n), n))
        return F.struct(x.alias("x"), y.alias("y"))

    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _radix(c: Column, hexadecimal: Column) -> Column:
    low_hex = F.lower(c).rlike("^[0-9a-f]$")
    return (
        F.when(hexadecimal & low_hex, 16).when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)
    )


def _place(c: Column, radix: Column) -> Column:
    alphabet = F.when(radix == 10, F.lit(DIGITS)).when(radix == 16, F.lit(HEX)).otherwise(F.lit(LOWER))
    return F.when(radix == 1, F.lit(0)).otherwise(F.instr(alphabet, F.lower(c)) - 1)


def _char(c: Column, radix: Column, place: Column) -> Column:
    at = (place + 1).cast("int")
    got = F.when(radix == 10, F.substr(F.lit(DIGITS), at, F.lit(1))).when(radix == 16, F.substr(F.lit(HEX), at, F.lit(1))).otherwise(F.substr(F.lit(LOWER), at, F.lit(1)))
    return F.when(radix == 1, c).when(c.rlike("^[A-Z]$"), F.upper(got)).otherwise(got)


def _number(chars: Column, hexadecimal: Column) -> Column:
    """A half as a number in mixed radix, and the number of values it could have."""
    zero = F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("m"))

    def step(acc, c):
        return _let(_radix(c, hexadecimal), lambda r: F.struct((acc["v"] * r + _place(c, r)).cast("long").alias("v"), (acc["m"] * r).cast("long").alias("m")))

    return F.aggregate(chars, zero, step)


def _written(chars: Column, value: Column, hexadecimal: Column) -> Column:
    """The half's characters for a number, the last character first in the fold."""
    zero = F.struct(value.cast("long").alias("v"), F.lit("").alias("s"))

    def step(acc, c):
        return _let(
            _radix(c, hexadecimal),
            lambda r: F.struct(F.floor(acc["v"] / r).cast("long").alias("v"), F.concat(_char(c, r, acc["v"] % r), acc["s"]).alias("s")),
        )

    return F.aggregate(F.reverse(chars), zero, step)["s"]


def permute_text(s: Column, tweak: Column, key: str, hexadecimal: Column | None = None) -> Column:
    """Letters and digits permuted within their kinds, other characters as they are; blocks of 20 characters."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / 20), F.lit(0)).cast("int"))

    def block(k):
        part = F.substr(s, k * 20 + 1, F.lit(20))
        size = F.length(part)
        cut = F.floor(size / 2).cast("int")
        left = F.filter(F.split(F.substr(part, F.lit(1), cut), ""), lambda c: c != "")
        right = F.filter(F.split(F.substr(part, cut + 1), ""), lambda c: c != "")
        halves = F.struct(left.alias("l"), right.alias("r"))
        label = F.concat_ws("/", tweak, F.length(s).cast("string"), k.cast("string"))

        def numbers(h):
            pair = F.struct(h["l"].alias("l"), h["r"].alias("r"), _number(h["l"], hexadecimal).alias("a"), _number(h["r"], hexadecimal).alias("b"))
            return _let(pair, lambda p: _let(
                feistel(p["a"]["v"], p["a"]["m"], p["b"]["v"], p["b"]["m"], label, key),
                lambda z: F.concat(_written(p["l"], z["x"], hexadecimal), _written(p["r"], z["y"], hexadecimal)),
            ))

        return _let(halves, numbers)

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(starts, block), ""))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Luhn's sum over the digits, from the right; whether the rightmost counts double."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def value(c, i):
        d = c.cast("int")
        double = (i % 2 == 0) if last_doubled else (i % 2 == 1)
        return F.when(double, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(chars, value), F.lit(0), lambda acc, x: acc + x)


def _respell(found: Column, digits: Column) -> Column:
    """The digits written into the places of the digits found, other characters kept."""
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))

    def step(acc, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct((acc["i"] + is_digit.cast("int")).alias("i"), F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(F.filter(F.split(found, ""), lambda c: c != ""), zero, step)["s"]


def _groups(m: Column) -> Column:
    """A run's groups of digits, each with the separator after it."""
    return F.split(m, "(?<=[ -])")


def _joined(groups: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(groups, at + 1, n), "")


def _valid_card(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, False), F.lit(10)) == 0


def cards_in(m: Column) -> Column:
    """The cards of a run, from left to right, as an array of structs: first group and number of groups.

    At each group the windows that are spelt as cards are and begin as a network's cards do come first. Where none of those
    is touched, other windows of a network's numbers follow, the longest first, then at the run's start what is
    spelt as a card or is longest, and groups that are a number by themselves.
    """
    none = F.array().cast("array<struct<at:int,n:int>>")

    def spelt(groups, i):
        w = _joined(groups, i, F.lit(19))
        shaped = F.array(*[F.regexp_extract(w, rf"^(?:{x})(?!\d)", 0) for x in SHAPES])
        good = F.filter(shaped, lambda x: (x != "") & _digits(x).rlike(NETWORK) & _valid_card(_digits(x)))
        n = F.coalesce(F.size(F.split(F.get(good, F.lit(0)), "[ -]")), F.lit(0))
        return F.when(w.rlike(r"^(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|\d{4}[ -]\d{6}[ -]\d|\d{13})"), n).otherwise(0)

    def other(groups, first, i):
        def window(n):
            text = F.regexp_replace(_joined(groups, i, n), "[ -]$", "")
            return F.struct(n.alias("n"), text.alias("text"), _digits(text).alias("digits"))

        most = F.least(F.size(groups) - i, F.lit(19))
        windows = F.filter(
            F.transform(F.reverse(F.sequence(F.lit(1), most)), window),
            lambda x: F.length(x["digits"]).between(13, 19) & ~F.exists(F.slice(first, i + 2, x["n"] - 1), lambda k: k > 0),
        )

        def likely(x, j):
            spelling = F.lit(False)
            for shape in SHAPES[1:4]:
                spelling = spelling | x["text"].rlike(f"^{shape}$")
            return x["digits"].rlike(NETWORK) | (x["n"] == 1) | ((i == 0) & ((j == 0) | spelling))

        good = F.filter(windows, lambda x, j: likely(x, j) & _valid_card(x["digits"]))
        return F.coalesce(F.get(good, F.lit(0))["n"], F.lit(0))

    def picked(groups, first):
        picks = F.transform(first, lambda k, i: F.struct(i.alias("at"), F.when(k > 0, k).otherwise(other(groups, first, i)).alias("n")))

        def step(acc, x):
            free = (F.size(acc) == 0) | (x["at"] >= F.coalesce(F.element_at(acc, -1)["at"] + F.element_at(acc, -1)["n"], F.lit(0)))
            return F.when(free, F.concat(acc, F.array(x).cast("array<struct<at:int,n:int>>"))).otherwise(acc)

        return F.aggregate(F.filter(picks, lambda x: x["n"] > 0), none, step)

    found = _let(_groups(m), lambda g: _let(F.transform(g, lambda _, i: spelt(g, i)), lambda first: picked(g, first)))
    return F.when(m.rlike("^[0-9][0-9 -]*$") & (F.length(_digits(m)) >= 13), found).otherwise(none)


def _run(m: Column, key: str) -> Column:
    """The run with its cards permuted, the other numbers as they are."""

    def made(groups, cards):
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))

        def step(acc, x):
            s = F.concat(acc["s"], _joined(groups, acc["at"], x["at"] - acc["at"]), _card(_joined(groups, x["at"], x["n"]), key))
            return F.struct((x["at"] + x["n"]).alias("at"), s.alias("s"))

        return _let(F.aggregate(cards, zero, step), lambda z: F.concat(z["s"], _joined(groups, z["at"], F.size(groups))))

    return _let(_groups(m), lambda g: _let(cards_in(m), lambda c: made(g, c)))


def _card(m: Column, key: str) -> Column:
    def made(d):
        middle = F.substr(d, F.lit(2), F.length(d) - 2)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_text(middle, F.lit("card"), key))
        return _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, True), F.lit(10)).cast("string")))

    return _let(_let(_digits(m), made), lambda d: _respell(m, d))


def _phone(m: Column, key: str) -> Column:
    def made(d):
        free = permute_text(F.concat(F.substr(d, F.lit(2), F.lit(2)), F.substr(d, F.lit(5), F.lit(6))), F.lit("phone"), key)
        new = _let(free, lambda f: F.concat(F.substr(d, F.lit(1), F.lit(1)), F.substr(f, F.lit(1), F.lit(2)), F.substr(d, F.lit(4), F.lit(1)), F.substr(f, F.lit(3), F.lit(6))))
        return F.concat(F.when(F.length(_digits(m)) == 11, F.lit("1")).otherwise(F.lit("")), new)

    return _let(_let(F.right(_digits(m), F.lit(10)), made), lambda d: _respell(m, d))


def _ip(m: Column, key: str) -> Column:
    def made(p):
        z = feistel(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.lit(65536), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), F.lit(65536), F.lit("ip"), key)
        return _let(z, lambda z: F.concat_ws(".", *[F.floor(z[h] / 256).cast("string") if top else (z[h] % 256).cast("string") for h in ("x", "y") for top in (True, False)]))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), made)


def _ssn(m: Column, key: str) -> Column:
    def made(p):
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        a = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
        z = feistel(a, F.lit(898 * 99), serial - 1, F.lit(9999), F.lit("ssn"), key)

        def spelt(z):
            k = F.floor(z["x"] / 99)
            return F.concat_ws("-", F.lpad(F.when(k >= 665, k + 2).otherwise(k + 1).cast("string"), 3, "0"), F.lpad((z["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((z["y"] + 1).cast("string"), 4, "0"))

        return _let(z, spelt)

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), made)


NOTATIONS = {"-": ("yyyy-MM-dd",), "/": ("MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy"), ".": ("dd.MM.yyyy", "d.M.yyyy")}


def _notation(m: Column) -> Column:
    """How the date is written: month first wherever that makes a date, without leading zeros if a part has one digit."""
    short = m.rlike(r"^\d[/.]|[/.]\d[/.]")
    pick = lambda long, brief: F.when(short, brief).otherwise(long)
    month_first = F.try_to_date(m, "M/d/yyyy").isNotNull()
    return F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("/"), F.when(month_first, pick("MM/dd/yyyy", "M/d/yyyy")).otherwise(pick("dd/MM/yyyy", "d/M/yyyy"))).otherwise(pick("dd.MM.yyyy", "d.M.yyyy"))


def _day(m: Column) -> Column:
    """The date that is written, or null."""
    slashed = F.coalesce(F.try_to_date(m, "M/d/yyyy"), F.try_to_date(m, "d/M/yyyy"))
    return F.when(m.contains("-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.contains("/"), slashed).otherwise(F.try_to_date(m, "d.M.yyyy"))


def _date(m: Column, key: str) -> Column:
    def written(d):
        notation, out = _notation(m), F.lit(None).cast("string")
        for known in [n for of in NOTATIONS.values() for n in of]:
            out = F.when(notation == known, F.date_format(d, known)).otherwise(out)
        return out

    def made(n):
        z = feistel(F.floor(n / DAYS[1]), F.lit(DAYS[0]), n % DAYS[1], F.lit(DAYS[1]), F.lit("date"), key)
        day = _let(z, lambda z: F.date_add(F.lit(FIRST_DAY).cast("date"), (z["x"] * DAYS[1] + z["y"]).cast("int")))
        return _let(day, written)

    return _let(F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")), made)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, F.lit("@"))
    return F.concat(permute_text(F.substr(m, F.lit(1), at - 1), F.lit("email"), key), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    head = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.regexp_extract(m, r"^[A-Za-z_]+(?: ?[=:] ?)\"?", 0))
    return _let(head, lambda h: _let(F.substr(m, F.length(h) + 1), lambda v: F.concat(h, permute_text(v, F.lit("secret"), key, v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")))))


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes validation, or null; a run with cards in it is a card."""
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    area = F.substr(m, F.lit(1), F.lit(3))
    day = _day(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Za-z]"), "secret")
        .when(m.rlike(f"^(?:{SSN})$"), F.when(~area.isin("000", "666") & ~area.startswith("9") & (F.substr(m, F.lit(5), F.lit(2)) != "00") & ~m.endswith("0000"), F.lit("ssn")))
        .when(m.rlike(f"^(?:{IP})$"), F.when(F.forall(octets, lambda x: x <= 255), F.lit("ip")))
        .when(m.rlike(f"^(?:{DATE})$"), F.when((F.year(day) >= 1700) & (F.year(day) <= 2099), F.lit("date")))
        .when(m.rlike(f"^(?:{PHONE})$"), "phone")
        .when(F.size(cards_in(m)) > 0, "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "secret": _secret, "ssn": _ssn, "ip": _ip, "date": _date, "phone": _phone, "card": _run}
    out = None
    for name in KINDS:
        out = F.when(kind == name, made[name](m, key)) if out is None else out.when(kind == name, made[name](m, key))
    return out.otherwise(m)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """The documents with pseudonyms in the text; `found` names a column for the kinds met (array<string>). Whoever has the key can undo them."""
    if not key:
        raise ValueError("pseudonyms need a key")
    names, t = docs.columns, F.col(text)
    o = own_prefix(names)
    values, rest, kinds_, new_ = (f"{o}{n}" for n in ("found", "rest", "kinds", "new"))
    cut = docs.withColumns({values: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), rest: F.split(t, PATTERN)})
    kinds = cut.withColumn(kinds_, F.transform(values, kind_of))
    new = F.transform(F.arrays_zip(values, kinds_), lambda z: pseudonym(z[values], z[kinds_], key))
    done = kinds.withColumn(new_, F.when(F.size(values) > 0, new))
    joined = F.array_join(F.transform(F.arrays_zip(rest, new_), lambda z: F.concat(z[rest], F.coalesce(z[new_], F.lit("")))), "")
    out = done.withColumn(text, F.when(F.size(values) > 0, joined).otherwise(t))
    if found:
        each = lambda z: F.when(z[kinds_] == "card", F.array_repeat(z[kinds_], F.size(cards_in(z[values])))).otherwise(F.array(z[kinds_]))
        out = out.withColumn(found, F.flatten(F.transform(F.filter(F.arrays_zip(values, kinds_), lambda z: z[kinds_].isNotNull()), each)))
    return out.select(*names, *([found] if found else []))


def pii_report(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count for each kind."""
    out = pseudonymize(docs.select("doc_id", F.col(text).alias("text")), key, "text", "kinds")
    counts = [F.coalesce(F.size("kinds") - F.size(F.array_remove("kinds", kind)), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", "text", F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_found"), *counts)
