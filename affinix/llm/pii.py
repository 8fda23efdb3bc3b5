"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that validate are permuted within their format by a keyed
Feistel network: a card number stays a card number (first digit, length and
Luhn check), a telephone number one of its numbering plan, a date a date of
1900-2099, an IPv4 address an address.  The permutation depends on the key and
the kind alone, so equal values have equal pseudonyms in all documents, and
different ones of one kind differ.  Telephone, card and social security numbers
that don't validate are kinds of their own, permuted among all such digits.  Mail addresses are no numbers: the local part becomes a
keyed digest of it, the domain stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import free_name

ROUNDS = 10
#: For tests and examples; pass a secret of your own.
KEY = "affinix-pseudonym-key"

#: The shapes, in the order in which they are tried at a place.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,30}(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])",
}
PATTERN = "|".join(SHAPES.values())
_PHONE = r"^(\+1[ .-]?\(?)([0-9]{3})(\)?[ .-]?)([0-9]{3})([ .-]?)([0-9]{4})$"


def feistel(a: Column, a_size: Column | int, b: Column, b_size: Column | int, kind: str, key: str) -> Column:
    """A keyed permutation of the pairs (a, b), 0 <= a < a_size and 0 <= b < b_size, as a struct of a and b.

    Halves take turns: one is shifted, modulo its size, by a digest of the other;
    each round can be undone, so no two pairs meet.
    """
    wide = [F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a_size, b_size)]
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), wide[0].alias("m"), wide[1].alias("n"))

    def turn(s: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), s["y"].cast("string"), s["m"].cast("string")).cast("binary"), 256)
        shift = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), ((s["x"] + shift % s["m"]) % s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    done = F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn)
    return F.struct(done["x"].alias("a"), done["y"].alias("b"))


def bound(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often use mentions it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def luhn_digit(digits: Column) -> Column:
    """The check digit to stand behind a string of digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _digits_back(m: Column, digits: Column) -> Column:
    """digits in the places that m's digits have."""
    walk = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
    )
    return walk["out"]


def kind_of(m: Column) -> Column:
    """Which shape a match has: a match is of the first that fits it whole."""
    out = None
    for kind, shape in SHAPES.items():
        test = m.rlike(f"^(?:{shape})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def _email(m: Column, key: str) -> Column:
    local = F.lower(F.substring_index(m, "@", 1))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 10), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    high, low = (F.element_at(octets, i).cast("long") * 256 + F.element_at(octets, i + 1).cast("long") for i in (1, 3))
    return bound(feistel(high, 65536, low, 65536, "ip", key), lambda f: F.concat_ws(".", F.floor(f["a"] / 256), f["a"] % 256, F.floor(f["b"] / 256), f["b"] % 256))


def _phone(m: Column, key: str) -> Column:
    """Area code and exchange of 200-999 stay in that range; other numbers are permuted among all ten-digit ones."""
    part = [F.regexp_extract(m, _PHONE, i) for i in range(7)]
    area, exchange, line = (part[i].cast("long") for i in (2, 4, 6))
    plan = bound(feistel((area - 200) * 800 + exchange - 200, 640_000, line, 10_000, "phone", key), lambda f: F.concat(F.floor(f["a"] / 800) + 200, f["a"] % 800 + 200, _padded(f["b"], 4)))
    loose = bound(feistel(area * 100 + F.floor(exchange / 10), 100_000, exchange % 10 * 10_000 + line, 100_000, "loose-phone", key), lambda f: F.concat(_padded(f["a"], 5), _padded(f["b"], 5)))
    ten = F.when((area >= 200) & (exchange >= 200), plan).otherwise(loose)
    return bound(ten, lambda t: F.concat(part[1], F.substring(t, 1, 3), part[3], F.substring(t, 4, 3), part[5], F.substring(t, 7, 4)))


def _card(m: Column, key: str) -> Column:
    """The first digit stays; a number with a right check digit gets one again."""

    def inner(digits: Column, width: Column, kind: str) -> Column:
        left = F.floor(width / 2).cast("int")
        right = (width - left).cast("int")
        f = feistel(F.substring(digits, F.lit(2), left).cast("long"), _ten(left), F.substring(digits, left + 2, right).cast("long"), _ten(right), kind, key)
        return bound(f, lambda f: F.concat(F.substring(digits, 1, 1), _padded(f["a"], left), _padded(f["b"], right)))

    def made(digits: Column) -> Column:
        n = F.length(digits)
        valid = bound(F.substring(digits, F.lit(1), n - 1), luhn_digit) == F.substring(digits, n, F.lit(1))
        card = bound(inner(digits, n - 2, "card"), lambda body: F.concat(body, luhn_digit(body)))
        return F.when(valid, card).otherwise(inner(digits, n - 1, "number"))

    digits = F.regexp_replace(m, "[^0-9]", "")
    return bound(bound(digits, made), lambda d: _digits_back(m, d))


def _ssn(m: Column, key: str) -> Column:
    """Numbers that can have been issued stay such; others are permuted among all nine-digit ones."""

    def made(digits: Column) -> Column:
        area, rest = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 6).cast("long")
        group, serial = F.floor(rest / 10_000), rest % 10_000
        issued = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        f = feistel(F.when(area > 666, area - 2).otherwise(area - 1), 898, (group - 1) * 9_999 + serial - 1, 99 * 9_999, "ssn", key)
        new = bound(f, lambda f: F.concat(_padded(F.when(f["a"] >= 665, f["a"] + 2).otherwise(f["a"] + 1), 3), _padded(F.floor(f["b"] / 9_999) + 1, 2), _padded(f["b"] % 9_999 + 1, 4)))
        loose = bound(feistel(area, 1_000, rest, 1_000_000, "loose-ssn", key), lambda f: F.concat(_padded(f["a"], 3), _padded(f["b"], 6)))
        return F.when(issued, new).otherwise(loose)

    return bound(bound(F.replace(m, F.lit("-"), F.lit("")), made), lambda n: F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 4)))


def _date(m: Column, key: str) -> Column:
    """Days since 1900-01-01; up to 2099-12-31 there are 73,049 = 17 * 4,297.  What isn't in the calendar stays."""
    zero = F.lit("1900-01-01").cast("date")
    day = F.datediff(m.try_cast("date"), zero).cast("long")
    new = bound(feistel(F.floor(day / 4_297), 17, day % 4_297, 4_297, "date", key), lambda f: F.date_add(zero, (f["a"] * 4_297 + f["b"]).cast("int")).cast("string"))
    return F.when(day.isNull(), m).otherwise(new)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match."""
    made = {"email": _email, "ip": _ip, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date}

    def chosen(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, f in made.items():
            out = F.when(kind == k, f(m, key)).otherwise(out)
        return F.coalesce(out, m)

    return bound(kind_of(m), chosen)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with pseudonyms in text, and n_pii, the number of matches, added; one pass, no shuffle.

    Null stays null with 0 matches; empty and very long texts are treated like
    others.  Texts without a digit or an @ skip the search.  Rows that repeat get the same text, as
    equal values have equal pseudonyms.  Where shapes overlap, the match that begins first holds, and of those that begin together the
    one that comes first in SHAPES.  An empty table gives an empty one.  All columns stay, but
    for an n_pii that docs has already, which is replaced.
    """
    kept, found_in = docs.drop("n_pii"), free_name(docs, "_found")
    text = F.col("text")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    with_found = kept.withColumn(found_in, F.coalesce(found, F.array().cast("array<string>")))
    pieces = F.split(text, PATTERN, -1)
    filled = F.zip_with(pieces, F.transform(found_in, lambda m: pseudonym(m, key)), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    made = F.when(F.size(found_in) > 0, F.array_join(filled, "")).otherwise(text)
    return with_found.withColumn("text", made).withColumn("n_pii", F.size(found_in).cast("long")).select(*kept.columns, "n_pii")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
