"""Personal data replaced by format-preserving pseudonyms.

Card numbers, phone numbers, social security numbers, IP addresses, dates, mail
addresses and secret keys are found in a text, validated, and put through a keyed
Feistel permutation of their own format: a 16-digit card number becomes another
that passes the same check, an address another address, a date another date.
Under one key the permutation is the same everywhere, so equal values stay
linked across documents however they are punctuated, and different values never
meet. The key is the caller's secret; whoever has it can permute back.

Of a number only the digits count: they are permuted and put back between the
separators where they were. What is permuted is a pair of numbers, each moved in
turn, modulo its size, by a keyed hash of the other: the two halves of the digits
(a card's last digit follows from the others); a social security number's area
and group, and its serial, among those that are valid; the halves of an address;
years and days of a date, modulo 200 and 365 (in a period of 73,000 days). Mail
addresses and keys are lists of symbols, each of a class of characters with its
own size (10 digits, 16 hexadecimal digits, 26 small or capital letters), whose
halves are changed in the same way; everything else keeps its place.

Numbers that may be cards are tried first, at every group of digits and in every
length that ends with a group; those that pass the check are looked for by name.

Built of DataFrame functions only. One regular expression cuts a text into
alternating gaps and values; values are changed inside the row and joined up
again, so nothing is shuffled and no text leaves its task. No group is repeated
without bound but possessively, so a match needs no stack that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is looked for; in this order where several begin at one place.
KINDS = {
    # A label of the host is taken where, within eight labels, one follows that may be the last.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?=(?:[A-Za-z0-9-]{1,63}\.){0,8}[A-Za-z]{2}))++[A-Za-z]{2,}+",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "card": r"(?:(?<![\w.-])|(?<=\d-))\d(?:[ -]?\d){12,18}(?!\w|-(?!\d))",
    "phone": r"(?<![\w])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ghp_|sk-|xox[abp]-)[A-Za-z0-9-]{12,}|[0-9a-fA-F]{32,128})(?![A-Za-z0-9])",
}
#: All kinds but cards, which each text adds itself.
PATTERN = "|".join(p for k, p in KINDS.items() if k != "card")
#: Where a card may begin and end; 13 to 19 digits from there and the next two characters.
BEGIN, END = r"(?:(?<![\w.-])|(?<=\d-))", r"(?!\w|-(?!\d))"
CANDIDATE = rf"(?s){BEGIN}(?=(\d(?:[ -]?\d){{12,18}}.{{0,2}}))"
ROUNDS = 8
#: Where the query finds its key; over the synthetic test data, where none is set, it takes one that protects nothing.
KEY_SETTING, TEST_KEY = "spark.tessella.pseudonyms.key", "not a secret: for synthetic test data only"
#: Valid areas (001 to 899 without 666) times groups (01 to 99), and serials (0001 to 9999), of social security numbers.
SSN_FRONTS, SSN_SERIALS = 898 * 99, 9999
#: Days of a period of dates (200 * 365), and its first day.
YEARS, DAYS, EPOCH = 200, 365, "1900-01-01"


def _hash(key: str, *parts: Column) -> Column:
    """32 unsigned bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def _turns(a: Column, b: Column, step, rounds: int = ROUNDS) -> Column:
    """struct(a, b) after ``rounds`` changes of the left side by ``step(left, right, round)`` and exchanges of sides."""
    start = F.struct(a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, i: F.struct(s["b"].alias("a"), step(s["a"], s["b"], i).alias("b")))


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def moved_pair(pair: Column, sizes: tuple[Column, Column], key: str, kind: str | Column) -> Column:
    """struct(a, b) for a struct of two numbers below ``sizes``: in odd rounds a, in even rounds b moves by a keyed hash of the round and the other."""
    name = F.lit(kind) if isinstance(kind, str) else kind

    def step(s: Column, r: Column) -> Column:
        a = F.pmod(s["a"] + _hash(key, name, r, s["b"]), sizes[0])
        b = F.pmod(s["b"] + _hash(key, name, r, s["a"]), sizes[1])
        return F.when(r % 2 == 1, F.struct(a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), b.alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, step)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(_long(a).alias("a"), _long(b).alias("b"))


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _padded(number: Column, width: Column) -> Column:
    return F.right(F.concat(F.lit("0" * 18), number.cast("string")), width)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """As many digits (2 to 34) for a string of digits; each length is permuted on its own."""
    n = F.length(digits)
    front = F.floor(n / 2).cast("int")
    powers = F.array(*(F.lit(10**k).cast("long") for k in range(18)))
    sizes = (F.get(powers, front), F.get(powers, n - front))
    pair = _pair(F.substring(digits, F.lit(1), front), F.substring(digits, front + 1, n))
    end = moved_pair(pair, sizes, key, F.concat(F.lit(kind), n.cast("string")))
    return _let(end, lambda t: F.concat(_padded(t["a"], front), _padded(t["b"], n - front)))


def punctuated(digits: Column, like: Column) -> Column:
    """The digits between the separators of a value that has as many."""
    chars = F.filter(F.split(like, ""), lambda c: c != "")
    place = lambda i: F.length(_digits(F.substring(like, F.lit(1), i.cast("int")))) + 1
    return _let(digits, lambda d: F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(d, place(i), F.lit(1))).otherwise(c)), ""))


DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _size(c: Column, hexadecimal: Column) -> Column:
    """Size of a character's class; 0 for characters that stay."""
    return F.when(hexadecimal & c.rlike("^[0-9a-f]$"), 16).when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[a-zA-Z]$"), 26).otherwise(0)


def _code(c: Column, size: Column) -> Column:
    low = F.when(size == 16, F.instr(F.lit(DIGITS + "abcdef"), c)).when(size == 10, F.instr(F.lit(DIGITS), c)).otherwise(F.instr(F.lit(SMALL), F.lower(c)))
    return (low - 1).cast("long")


def _char(code: Column, c: Column, size: Column) -> Column:
    at = (code + 1).cast("int")
    letter = F.when(c.rlike("^[A-Z]$"), F.substring(F.lit(LARGE), at, F.lit(1))).otherwise(F.substring(F.lit(SMALL), at, F.lit(1)))
    return F.when(size == 0, c).when(size == 16, F.substring(F.lit(DIGITS + "abcdef"), at, F.lit(1))).when(size == 10, F.substring(F.lit(DIGITS), at, F.lit(1))).otherwise(letter)


def permuted(value: Column, key: str, kind: str, hexadecimal: Column | None = None) -> Column:
    """The value with its symbols permuted within their classes; kinds are permuted apart."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    symbols = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), _size(c, hexadecimal).alias("n")))
    coded = F.transform(symbols, lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), F.when(x["n"] > 0, _code(x["c"], x["n"])).otherwise(F.lit(0).cast("long")).alias("v")))
    half = lambda s: F.floor(F.size(s) / 2).cast("int")

    def moved(s: Column, by: Column, r: Column) -> Column:
        drive = F.array_join(F.transform(by, lambda x: F.concat(F.when(x["n"] == 0, x["c"]).otherwise(F.lit("")), x["v"].cast("string"))), ",")
        return F.transform(s, lambda x, i: F.struct(x["c"].alias("c"), x["n"].alias("n"), F.when(x["n"] > 0, F.pmod(x["v"] + _hash(key, F.lit(kind), r, i, drive), x["n"].cast("long"))).otherwise(x["v"]).alias("v")))

    # The number of rounds is even, so that the halves are back in their places.
    turned = F.transform(F.array(coded), lambda s: _turns(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, F.size(s)), moved))
    return F.get(F.transform(turned, lambda t: F.array_join(F.transform(F.concat(t["a"], t["b"]), lambda x: _char(x["v"], x["c"], x["n"])), "")), F.lit(0))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the digits of a string, every second from the right doubled; ``doubled_last``: beginning with the last."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, i: F.when((i % 2 == 0) == F.lit(doubled_last), c.cast("int") * 2).otherwise(c.cast("int"))
    return F.aggregate(F.transform(each, lambda c, i: value(c, i) - F.when(value(c, i) > 9, 9).otherwise(0)), F.lit(0), lambda a, x: a + x)


def card(value: Column, key: str) -> Column:
    """A card number for a card number, separators in their places; null if the check digit is wrong."""
    digits = _digits(value)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = _let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - luhn_sum(x, True) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits, False) % 10 == 0, punctuated(whole, value))


def phone(value: Column, key: str) -> Column:
    """A number for a number, separators in their places; with and without a country's digits are two numbers."""
    return punctuated(permuted_digits(_digits(value), key, "phone"), value)


def ssn(value: Column, key: str) -> Column:
    """A valid number for a valid one, separators in their places; null if the number is not."""
    digits = _digits(value)
    part = lambda at, n: F.substring(digits, F.lit(at), F.lit(n)).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    end = moved_pair(_pair(area * 99 + part(4, 2) - 1, part(6, 4) - 1), (_long(SSN_FRONTS), _long(SSN_SERIALS)), key, "ssn")

    def number(t: Column) -> Column:
        place = F.floor(t["a"] / 99)
        return F.concat(_padded(place + F.when(place >= 665, 2).otherwise(1), F.lit(3)), _padded(t["a"] % 99 + 1, F.lit(2)), _padded(t["b"] + 1, F.lit(4)))

    return F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), punctuated(_let(end, number), value))


def cards(text: Column) -> Column:
    """The card numbers outside a text's other values that pass their check, longest first."""
    of_length = lambda w: F.array(*(F.regexp_extract(w, rf"^(\d(?:[ -]?\d){{{n - 1}}}){END}", 1) for n in range(19, 12, -1)))
    rest = F.when(text.rlike(r"\d(?:[ -]?\d){12}"), F.regexp_replace(text, PATTERN, ";")).otherwise(F.lit(""))
    tried = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(CANDIDATE), F.lit(1)), of_length))
    valid = F.array_distinct(F.filter(tried, lambda v: (v != "") & (luhn_sum(_digits(v), False) % 10 == 0)))
    return F.transform(F.sort_array(F.transform(valid, lambda v: F.struct(F.length(_digits(v)).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"])


def address(value: Column, key: str) -> Column:
    """An IPv4 address for an address; null if a part is above 255."""
    parts = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    pair = _pair(F.get(parts, F.lit(0)) * 256 + F.get(parts, F.lit(1)), F.get(parts, F.lit(2)) * 256 + F.get(parts, F.lit(3)))
    number = lambda x: F.concat_ws(".", F.floor(x / 256).cast("int").cast("string"), (x % 256).cast("string"))
    end = moved_pair(pair, (_long(65536), _long(65536)), key, "ip")
    return F.when(F.forall(parts, lambda x: x <= 255), _let(end, lambda t: F.concat_ws(".", number(t["a"]), number(t["b"]))))


def date(value: Column, key: str) -> Column:
    """A date for a date, within its period of 73,000 days, however it is punctuated; null if there is no such day."""
    day = F.try_to_date(F.regexp_replace(value, "/", "-"), "yyyy-MM-dd")
    number = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
    period, place = F.floor(number / (YEARS * DAYS)), F.pmod(number, _long(YEARS * DAYS))
    end = moved_pair(_pair(F.floor(place / DAYS), place % DAYS), (_long(YEARS), _long(DAYS)), key, "date")
    out = _let(end, lambda t: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (period * (YEARS * DAYS) + t["a"] * DAYS + t["b"]).cast("int")), "yyyy-MM-dd"))
    return F.when(day.isNotNull(), F.when(value.contains("/"), F.regexp_replace(out, "-", "/")).otherwise(out)).cast("string")


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value; the value itself if it is not valid after all."""
    whole = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    mail = F.concat(permuted(F.regexp_extract(value, r"^([^@]*)@", 1), key, "mail name"), F.lit("@"), permuted(F.regexp_extract(value, r"@(.*)\.[^.]*$", 1), key, "mail host"), F.regexp_extract(value, r"(\.[^.]*)$", 1))
    prefix = F.regexp_extract(value, r"^(AKIA|ghp_|sk-|xox[abp]-|)", 1)
    # Upper-case hexadecimal keys get the pseudonym of the lower-case ones, in upper case; mixed ones keep each letter's case.
    upper = value.rlike("^[0-9A-F]*[A-F][0-9A-F]*$")
    body = F.regexp_extract(F.when(upper, F.lower(value)).otherwise(value), r"^(?:AKIA|ghp_|sk-|xox[abp]-|)(.*)$", 1)
    secret = F.concat(prefix, permuted(body, key, "secret", upper | value.rlike("^[0-9a-f]+$")))
    secret = F.when(upper, F.upper(secret)).otherwise(secret)
    out = F.when(value.contains("@"), mail).when(whole("date"), date(value, key)).when(whole("ssn"), ssn(value, key))
    out = out.when(whole("ip"), address(value, key)).when(whole("phone"), phone(value, key)).when(whole("card"), card(value, key)).otherwise(secret)
    return F.coalesce(out, value)


def kind_of(value: Column) -> Column:
    """The kind of a found value."""
    tests = [F.when(value.contains("@"), "email"), *(F.when(value.rlike(f"^(?:{KINDS[k]})$"), k) for k in ("date", "ssn", "ip", "phone", "card"))]
    return F.coalesce(*tests, F.lit("secret"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs`` with its text's private values replaced, and ``n_private``, their number; other columns kept.

    ``key`` is a secret of the caller's; an empty one is an error.

    Found values that fail their check (card numbers with a wrong check digit,
    days that no month has) stay as they are and are not counted. Null texts stay
    null, empty ones empty; very long ones are read whole; repeated rows get equal
    results; an empty table gives no rows; a column named n_private is replaced.
    """
    if not key:
        raise ValueError("a key is needed: without a secret of your own, pseudonyms can be permuted back by anyone")
    base = docs.drop("n_private")
    names = base.columns
    cut = base.withColumn("_cards", cards(F.coalesce("text", F.lit(""))))
    named = F.concat(F.lit(f"{PATTERN}|{BEGIN}(?:"), F.array_join("_cards", "|"), F.lit(f"){END}"))
    cut = cut.withColumn("_pattern", F.when(F.size("_cards") > 0, named).otherwise(F.lit(PATTERN)))
    cut = cut.withColumn("_values", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.concat(F.lit("("), F.col("_pattern"), F.lit(")")), F.lit(1)))
    some = F.size("_values") > 0
    new = F.transform("_values", lambda v: pseudonym(v, key))
    cut = cut.withColumn("_new", F.when(some, new).otherwise(F.array().cast("array<string>")))
    gaps = F.split("text", F.col("_pattern"), -1)
    joined = F.array_join(F.zip_with(gaps, F.col("_new"), lambda g, v: F.concat(F.coalesce(g, F.lit("")), F.coalesce(v, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("_values", "_new", lambda a, b: a != b), lambda x: x)).cast("long")
    out = cut.withColumns({"text": F.when(some, joined).otherwise(F.col("text")), "n_private": changed})
    return out.select(*names, "n_private")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the key that the session sets in ``KEY_SETTING``."""
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), key).select("doc_id", "n_private", "text")
