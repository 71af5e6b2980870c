r"""Format-preserving Feistel pseudonyms for personal data.

Numbers that pass their check (card numbers by Luhn, social security numbers, IP
addresses, telephone numbers) and dates that exist are permuted within their
format by a keyed Feistel network; so are mail addresses and credentials, letter
for letter. Equal values get equal pseudonyms in every document. All of it is
DataFrame operations: one expression, no shuffle.

A permutation of strings: the value's letters and digits are split in two halves;
in turn each is shifted, place by place and within the kind of its character, by
a keyed SHA-256 of the other. Numbers and dates are split in quotient and remainder
instead. A shift can be undone, so different values of a format stay different."""

from __future__ import annotations

import logging
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh

ROUNDS = 6
#: The session setting that holds the key ("secret" in its name: Spark redacts it).
KEY_CONF = "spark.evenbag.pseudonym.secret"
#: Dates are permuted among all days from year 1 to 9999: SIDES[0] * SIDES[1] of them.
FIRST_DAY, SIDES = "0001-01-01", (1717, 2127)
#: Day-first dates with slashes go round among days after the 12th; each round stays
#: there with odds of 0.6.
WALK = 100

#: No match begins inside a word; kind, pattern. Earlier kinds win where two begin at
#: one place. The patterns run over a text once, joined.
_AT_EDGE = r"(?<![0-9A-Za-z])"
_KEYWORD = r"(?i:password|passwd|pwd|token|secret|api_key)"
PATTERNS = (
    ("mail", r"(?<![_.+@-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("key", r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?<!_)" + _KEYWORD + r"[\x20]?[=:][\x20]?\"?[A-Za-z0-9]{8,}+\"?"),
    ("date", r"(?<![.,/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])"),
    ("ip", r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    ("ssn", r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<!\+)\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"),
    ("card", r"(?<!-)(?:(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z-])"),
)
PATTERN = f"{_AT_EDGE}(?:{'|'.join(p for _, p in PATTERNS)})"


def session_key(spark: SparkSession) -> str:
    """The key that KEY_CONF holds. Where it is unset, a random one, made once and
    kept for this session: values stay linked in all its results, and nobody who
    reads them can undo them; another session's differ."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
        logging.getLogger(__name__).warning("%s is not set: pseudonyms get a random key for this session", KEY_CONF)
    return key


def _shift(text: Column, by: Column) -> Column:
    """text with digits, a-f, g-z, A-F and G-Z shifted, place by place, within their
    kind (so hexadecimal stays so); by: hex digits, of which each place takes four,
    over and over."""

    def one(c, i):
        n = F.conv(F.substring(by, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        a, out = F.ascii(c), c
        for low, high in ("09", "af", "gz", "AF", "GZ"):
            to = F.lit(ord(low)) + (a - ord(low) + n) % (ord(high) - ord(low) + 1)
            out = F.when(c.between(low, high), F.char(to.cast("int"))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute_text(text: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """text with its letters and digits permuted in their format: of two halves each
    in turn is shifted by a keyed hash of the other."""
    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def step(acc, i):
        return F.struct(acc.r.alias("l"), _shift(acc.l, F.sha2(F.concat_ws("|", key, i.cast("string"), acc.r), 256)).alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.concat(end.l, end.r)


def permute_number(n: Column, sides: tuple[int, int], key: Column, rounds: int = ROUNDS) -> Column:
    """A number below sides[0] * sides[1] to another: in turn its quotient and its
    remainder by sides[1] are shifted by a keyed hash of the other."""
    a, b = sides
    start = F.struct(F.floor(n / b).cast("long").alias("l"), (n % b).cast("long").alias("r"))

    def step(acc, i):
        left = i % 2 == 1
        other = F.when(left, acc.r).otherwise(acc.l)
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", key, i.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(12)), 16, 10).cast("long")
        return F.struct(F.when(left, (acc.l + drawn % a) % a).otherwise(acc.l).alias("l"), F.when(left, acc.r).otherwise((acc.r + drawn % b) % b).alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return end.l * b + end.r


def _fill(format_: Column, digits: Column) -> Column:
    """format_ with its digits replaced in turn."""
    return F.array_join(F.zip_with(F.split(format_, "[0-9]"), F.split(digits, ""), lambda p, d: F.concat(F.coalesce(p, F.lit("")), F.coalesce(d, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits of which the last counts once."""
    def add(acc, x):
        return acc + x

    def value(d, i):
        v = d.cast("int")
        doubled = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.when((F.length(digits) - 1 - i) % 2 == 1, doubled).otherwise(v)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), add)


_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def _read(text: Column, format_: str) -> Column:
    """The date that text names in this format; null if there is none (nor a year 0)."""
    return F.when(~text.rlike("0000$|^0000"), F.try_to_timestamp(text, F.lit(format_)).cast("date"))


def _date(text: Column) -> Column:
    """The date of a match; null if there is no such day. With slashes the month
    stands first, unless there is no such date."""
    return F.coalesce(*(_read(text, f) for f in _FORMATS))


def _number(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long")


def _day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def permute_date(text: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A date to another in its format. Day-first dates with slashes, which have a
    day after the 12th, go on through the permutation until they have one again, so
    that they stay day-first and different from all others."""
    next_ = lambda n: permute_number(n, SIDES, key, rounds)
    once = _day(next_(_number(_date(text))))
    month_first = _read(text, "MM/dd/yyyy")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), next_(_number(_read(text, "dd/MM/yyyy"))), lambda n, _: F.when(F.day(_day(n)) > 12, n).otherwise(next_(n)))
    return F.when(text.contains("-"), F.date_format(once, _FORMATS[0])).when(text.contains("."), F.date_format(once, _FORMATS[1])).when(month_first.isNotNull(), F.date_format(once, _FORMATS[2])).otherwise(F.date_format(_day(walk), _FORMATS[3]))


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.cast("long"))


def kind_of(text: Column) -> Column:
    """The kind of a match that passes its check, else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    checks = {
        "mail": text.contains("@"), "key": text.startswith("AKIA"), "secret": text.rlike("^" + _KEYWORD + "[ ]?[=:]"),
        "date": text.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$") & _date(text).isNotNull(),
        "ip": text.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(_octets(text), lambda x: x < 256),
        "ssn": text.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"),
        "card": text.rlike(r"^[0-9 -]+$") & n.between(13, 19) & ~text.rlike(r"^\(|^\d{3}-\d{2}-\d{4}$") & (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & ~digits.rlike(r"^(\d)\1*$"),
        "phone": (text.startswith("+") | text.rlike(r"^\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}$")) & n.between(7, 15),
    }
    out = F.lit(None).cast("string")
    for kind, check in reversed(checks.items()):
        out = F.when(check, F.lit(kind)).otherwise(out)
    return out


def pseudonym(text: Column, kind: Column, key: str, rounds: int = ROUNDS) -> Column:
    """The pseudonym of a match of this kind; the match itself if it has none."""
    k = lambda name: F.lit(f"{key}|{name}")
    digits = F.regexp_replace(text, "[^0-9]", "")
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), k("card"), rounds)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = _fill(text, F.concat(body, check))
    o = lambda i: F.element_at(_octets(text), i)
    address = permute_number(((o(1) * 256 + o(2)) * 256 + o(3)) * 256 + o(4), (65536, 65536), k("ip"), rounds)
    ip = F.concat_ws(".", *(F.pmod(F.floor(address / s), F.lit(256)).cast("string") for s in (1 << 24, 1 << 16, 1 << 8, 1)))
    # Area numbers run from 001 to 899 without 666: 898; then 99 and 9999 more.
    a, g, s = (F.substring(digits, F.lit(i), F.lit(m)).cast("long") for i, m in ((1, 3), (4, 2), (6, 4)))
    area = a - 1 - F.when(a > 666, 1).otherwise(0)
    n = permute_number((area * 99 + g - 1) * 9999 + s - 1, (898 * 99, 9999), k("ssn"), rounds)
    area2 = F.floor(n / (99 * 9999))
    ssn = F.format_string("%03d-%02d-%04d", area2 + 1 + F.when(area2 >= 665, 1).otherwise(0), F.floor(n / 9999) % 99 + 1, n % 9999 + 1)
    local, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    lead = F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[^0-9])|\+)?", 0)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    phone = F.concat(lead, _fill(rest, permute_text(F.regexp_replace(rest, "[^0-9]", ""), k("phone"), rounds)))
    name = F.regexp_extract(text, r'^[A-Za-z_]+[ ]?[=:][ ]?"?', 0)
    secret = F.concat(name, permute_text(F.substring(text, F.length(name) + 1, F.length(text)), k("secret"), rounds))
    made = {"mail": F.concat(permute_text(local, k("mail"), rounds), F.lit("@"), host), "key": F.concat(F.lit("AKIA"), permute_text(F.substring(text, F.lit(5), F.lit(16)), k("key"), rounds)), "secret": secret, "date": permute_date(text, k("date"), rounds), "ip": ip, "ssn": ssn, "card": card, "phone": phone}
    out = text
    for name_, value in made.items():
        out = F.when(kind == name_, value).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None, rounds: int = ROUNDS, counts: bool = False) -> DataFrame:
    """docs with personal data in the text replaced; with counts also n_private, the
    number of values replaced. The key is the session's if none is given.

    A null text stays null and has none. Texts are searched whole; what fails its
    check stays as it is. No row is added or lost, ties and repeated rows are
    treated alike, other columns stay as they are."""
    text = col(docs, text_col)
    key = key or session_key(docs.sparkSession)
    found, new = fresh(docs, "found", "made")
    # Most texts without a digit or one of these have no value; the rest are searched.
    may = text.rlike(r"[0-9@=:]|AKIA")
    none = F.array().cast("array<string>")
    x = docs.withColumn(found, F.when(text.isNotNull(), F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)))
    kinds = F.transform(found, lambda m: F.struct(m.alias("text"), kind_of(m).alias("kind")))
    x = x.withColumn(new, F.transform(kinds, lambda m: pseudonym(m.text, m.kind, key, rounds)))
    # The text between the matches, and a pseudonym after each but the last piece.
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    whole = F.when(F.size(found) > 0, joined).otherwise(text)
    out = x.select(*(whole.alias(c) if c == text_col else col(docs, c) for c in docs.columns), found, new)
    if counts:
        n = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda y: y))
        total, = fresh(out, "n_private")
        out = out.withColumn(total, F.when(text.isNull(), 0).otherwise(n).cast("long"))
    return out.drop(found, new)
