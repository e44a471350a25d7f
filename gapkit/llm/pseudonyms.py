"""Format-preserving Feistel pseudonyms for numbers, dates and addresses in texts, in built-in functions only.

Values are found by one pattern, validated (check digits, number ranges, calendar), and permuted inside their format by a
keyed Feistel network: a card number becomes another valid card number with the same separators, a date another date. The
permutation depends on the kind, the key and the value's format, never on the document, so equal values stay equal
across documents and different ones stay different. What fails validation stays as it is.

Round functions are SHA-256 of key, kind, round and the other half. Characters move inside their class (digits, small and
capital letters); dates and IPv4 addresses are pairs of numbers in a product domain of exactly their size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gapkit.llm.fingerprint import let

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Kinds and their patterns; a value is of the first kind that matches it whole. Repeats without a bound are possessive or of single
# characters, which Java's regular expressions go through in a loop; it matches other repeated groups by recursion, and a long
# text would overflow the stack.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ipv4": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)",
    "national": r"(?<![\w+.-])(?:\([2-9]\d\d\) ?|[2-9]\d\d[.-])[2-9]\d\d[.-]\d{4}(?![\w-]|\.\d)",
    # an ISO date may begin a time stamp
    "date": r"(?<![\w./-])(?:\d{4}-\d\d-\d\d(?=T\d\d)|(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))",
    "ssn": r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "hex": r"(?<!\w)(?=[a-fA-F]*\d)(?=\d*[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)",
}
ANY = "|".join(PATTERNS.values())
MAIL_LENGTH = 320  # an address has 64 characters, the sign and 255 characters at most
_FIRST_DAY, _A, _B = "1900-01-01", 319, 229  # 319 * 229 days are exactly the years 1900 to 2099


def _stream(key: str, kind: str, step: Column, other: Column, size: Column) -> Column:
    """SHA-256 in hexadecimal of all that a round depends on."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), size.cast("string"), other), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def permuted_pair(a: Column, b: Column, m: int, n: int, key: str, kind: str) -> Column:
    """A permutation of all pairs (a < m, b < n), as a struct of two longs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        move = _number(_stream(key, kind, i, F.when(even, s["b"]).otherwise(s["a"]).cast("string"), F.lit(m)))
        return F.struct(F.when(even, F.pmod(s["a"] + move % m, F.lit(m))).otherwise(s["a"]).alias("a"),
                        F.when(even, s["b"]).otherwise(F.pmod(s["b"] + move % n, F.lit(n))).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shifted(half: Column, stream: Column, letters: int) -> Column:
    """Move each code point of a half inside its class by a byte of the stream."""

    def move(c: Column, i: Column) -> Column:
        # two bytes of the stream, other ones after each turn through it
        by = F.conv(F.substring(stream, (i * 4) % 61 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 15).cast("int")

        def turn(low: str, size: int) -> Column:
            return F.lit(ord(low)) + F.pmod(c - ord(low) + by, F.lit(size))

        return (F.when(c.between(48, 57), turn("0", 10)).when(c.between(97, 96 + letters), turn("a", letters))
                .when(c.between(65, 64 + letters), turn("A", letters)).otherwise(c).cast("int"))

    return F.transform(half, move)


def permuted_text(value: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A permutation of all texts with the same classes of characters at the same places; other characters stay."""

    def network(codes: Column) -> Column:
        n = F.size(codes)
        cut = F.floor(n / 2).cast("int")
        start = F.struct(F.slice(codes, F.lit(1), cut).alias("l"), F.slice(codes, cut + 1, n - cut).alias("r"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            other = F.array_join(F.when(even, s["r"]).otherwise(s["l"]), ",")
            return let(_stream(key, kind, i, other, n), lambda stream: F.struct(
                F.when(even, _shifted(s["l"], stream, letters)).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(_shifted(s["r"], stream, letters)).alias("r")))

        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["l"], s["r"]))

    chars = F.split(value, "")
    # a character below 128 is rebuilt from its number, any other one stays
    return let(chars, lambda c: let(
        network(F.transform(c, lambda x: F.when(F.length(x.cast("binary")) == 1, F.ascii(x)).otherwise(F.lit(200)))),
        lambda codes: F.array_join(F.zip_with(c, codes, lambda x, y: F.when(y < 128, F.char(y)).otherwise(x)), "")))


def _refilled(shape: Column, fill: Column) -> Column:
    """``shape`` with its letters and digits replaced by those of ``fill`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        taken = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(s["out"], F.when(taken, F.substring(fill, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (s["i"] + taken.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, last_is_check: bool = True) -> Column:
    """The sum of Luhn's check; without a check digit, as if a zero followed."""
    odd = 1 if last_is_check else 0

    def add(s: Column, x: Column) -> Column:
        d = x["d"] * F.when(x["i"] % 2 == odd, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(places, F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder of a text of digits and capital letters (A is 10) by 97."""

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(v: Column, key: str) -> Column:
    def fill(digits: Column) -> Column:
        body = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        full = let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, False), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _refilled(v, full))

    return let(F.regexp_replace(v, r"\D", ""), fill)


def _iban(v: Column, key: str) -> Column:
    def fill(s: Column) -> Column:
        country = F.substring(s, 1, 2)
        body = permuted_text(F.substring(s, F.lit(5), F.length(s) - 4), key, "iban")
        full = let(body, lambda b: F.concat(country, F.lpad(
            (F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1, _refilled(v, full))

    return let(F.regexp_replace(v, r"\s", ""), fill)


def _ipv4(v: Column, key: str) -> Column:
    def fill(o: Column) -> Column:
        number = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        pair = permuted_pair(number[0] * 256 + number[1], number[2] * 256 + number[3], 1 << 16, 1 << 16, key, "ipv4")
        return let(pair, lambda p: F.concat_ws(".", *[
            F.pmod(F.shiftright(p[c], by), F.lit(256)).cast("string") for c in ("a", "b") for by in (8, 0)]))

    return let(F.split(v, r"\."), fill)


def _date(v: Column, key: str) -> Column:
    """ISO, day.month.year, and month/day/year or else day/month/year, with two digits or without leading zeros."""
    two = r"^\d\d/\d\d/"
    forms = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d\.", "dd.MM.yyyy"), (two, "MM/dd/yyyy"), (two, "dd/MM/yyyy"), (r"/", "M/d/yyyy"), (r"/", "d/M/yyyy"))

    def in_form(form: str) -> Callable[[Column], Column]:
        def fill(day: Column) -> Column:
            number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
            pair = permuted_pair(F.floor(number / _B), F.pmod(number, F.lit(_B)), _A, _B, key, "date")
            to = let(pair, lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["a"] * _B + p["b"]).cast("int")))
            return F.when(number.between(0, _A * _B - 1), F.date_format(to, form))

        return fill

    return F.coalesce(*[F.when(v.rlike(shape), let(F.try_to_timestamp(v, F.lit(form)).cast("date"), in_form(form)))
                        for shape, form in forms])


def _phone(v: Column, key: str) -> Column:
    country = F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    return F.concat(country, permuted_text(rest, key, "phone"))


def _national(v: Column, key: str) -> Column:
    """Three digits from 200 on, three from 200 on, four."""
    def fill(d: Column) -> Column:
        area, exchange, line = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
        pair = permuted_pair(area - 200, (exchange - 200) * 10_000 + line, 800, 800 * 10_000, key, "national")
        new = let(pair, lambda p: F.concat((p["a"] + 200).cast("string"), F.lpad((p["b"] + 2_000_000).cast("string"), 7, "0")))
        return _refilled(v, new)

    return let(F.regexp_replace(v, r"\D", ""), fill)


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = permuted_pair(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new = let(pair, lambda p: F.concat_ws("-", F.lpad((p["a"] + 1 + F.when(p["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
                                          F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
                                          F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a value found by ``ANY``, null if it fails validation."""
    ways: dict[str, Callable[[Column, str], Column]] = {
        # all but the last label of the domain, so that short names do not stand alone
        "email": lambda v, k: F.when(F.length(v) <= MAIL_LENGTH, F.concat(
            permuted_text(F.regexp_extract(v, r"^(.*)\.[^.]+$", 1), k, "email"), F.regexp_extract(v, r"\.[^.]+$", 0))),
        "ipv4": _ipv4, "phone": _phone, "national": _national, "date": _date, "ssn": _ssn, "card": _card, "iban": _iban,
        "hex": lambda v, k: permuted_text(v, k, "hex", 6),
    }
    out = None
    for kind, way in ways.items():
        test = value.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(test, way(value, key)) if out is None else out.when(test, way(value, key))
    return out


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with validated values in ``text`` replaced, and ``n_values``, their number. All other columns stay; a column
    ``n_values`` of ``docs`` is replaced.

    Null texts stay null, empty ones empty, with no values. Rows are changed one by one, so repeated rows stay as many and
    equal. The pattern runs over whole texts of any length, in time that grows with them; where nothing matches, nothing else
    does. What looks like an address but is longer than an address can be stays. An empty table gives no rows.
    """
    name = "__values"
    while name in docs.columns:
        name += "_"
    text = F.col("text")

    def rebuild(found: Column) -> Column:
        """The replaced text, and the number of replaced values."""
        new = F.transform(found, lambda v: pseudonym(v, key))

        def join(n: Column) -> Column:
            values = F.zip_with(found, n, lambda v, x: F.coalesce(x, v))
            pieces = F.zip_with(F.split(text, ANY, -1), values, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
            return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(n, lambda x: x.isNotNull())).alias("n"))

        return let(new, join)

    done = F.when(text.rlike(ANY), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), rebuild))
    return docs.withColumn(name, done).withColumns({
        "text": F.coalesce(F.col(f"{name}.text"), text), "n_values": F.coalesce(F.col(f"{name}.n"), F.lit(0)).cast("long"),
    }).drop(name)
