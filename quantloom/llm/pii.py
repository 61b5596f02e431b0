"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds a candidate at every place where one can begin; each is validated (Luhn, calendar, octets, numbering-plan and IBAN
rules) and permuted by a keyed Feistel network within the set of valid values of its format. A
pseudonym is therefore again a valid value of the same form, equal values have equal pseudonyms
in all documents, different values of a format stay different, and ``reverse`` with the key
restores them. The network keeps two parts l < a and r < b and adds a keyed digest of one to the
other in turns, so it permutes any domain of a * b values without cycle walking.

Mail addresses and credentials are not numbers: they get keyed digests of the same kind of
characters, linked across documents but not reversible.

Formats: payment cards (Luhn; the check digit is recomputed), North American and international
telephone numbers, social security numbers, IPv4 addresses, dates (yyyy-mm-dd, dd.mm.yyyy,
dd/mm/yyyy or mm/dd/yyyy; from 1900 on, 90,000 days), IBANs (check digits recomputed), mail
addresses, access keys, ``password=`` and ``token =`` values. Separators stay in place.

Defined results: a text of any length is read whole; a mail host goes on to its last label that
begins with two letters, whatever its length; null text stays null with 0 found; candidates that fail validation stay as they
are and hide nothing: the search goes on at the next place, also within them. Valid matches are
taken left to right without overlap in the input; other columns are untouched. Of a card candidate
the usual groupings are tried first (4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-3, no separators); digits in other
groups count as a card at the start of a run of digits, or at its end in groups of one or of four
and more (else rows of numbers would pass by chance), if no value of a usual form is among them. Of an IBAN candidate the longest valid part is taken. A date
with slashes is read day first where both readings exist, so the pseudonym of a month-first date can
read as another date when it is reversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS_SIDE = "1900-01-01", 300
STEP, _PAIRS = 128, "__pii_pairs"

# A group that repeats without bound is possessive throughout: Java then loops over it, where it would
# recurse for every repetition otherwise, so that a text of any length needs the same stack.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.(?=[A-Za-z]{2})[A-Za-z0-9-]++)++"
_ADDRESS = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
_ISO = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"
_DAY_FIRST = r"(?<![\w./])\d{2}(?<sep>[./])\d{2}\k<sep>\d{4}(?![\w/]|\.\d)"
_PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-])"
_WORLD = r"(?<![\w+])\+[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\w)"
_SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_FOURS = r"\d{4}(?<by>[ -])\d{4}\k<by>\d{4}\k<by>\d{4}(?![\w-])"
#: Before four groups of four, a year or other number that no card begins with is not the first group.
_CARD = r"(?<![\w-])(?!(?:[01789]\d|20)\d\d[ -]\d{4}(?<on>[ -])\d{4}\k<on>\d{4}\k<on>\d{4}(?![\w-]))(?:(?<!\d )\d(?:[ -]?\d){12,18}(?![\w-])|(?=\d{4,}+(?:[ -]\d{4,}+){0,4}+(?![\w-])(?! \d))\d(?:[ -]?\d){12,18}(?![\w-])(?! \d)|\d(?: \d){12,18}(?![\w-])(?! \d)|\d{13,19}(?![\w-])|\d{4}(?<as>[ -])(?:\d{4}\k<as>\d{4}\k<as>\d{4}(?:\k<as>\d{3})?|\d{6}\k<as>\d{4,5})(?![\w-]))"
#: What a card candidate may begin with, in the order in which it is tried; the last one is all of it.
_CARD_FORMS = (_FOURS, r"\d{4}(?<by>[ -])\d{6}\k<by>\d{4,5}(?![\w-])", r"\d{4}(?<by>[ -])\d{4}\k<by>\d{4}\k<by>\d{4}\k<by>\d{3}(?![\w-])", r"\d{13,19}(?![\w-])", r".+$")
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_ACCESS = r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
_SECRET = r"(?i:password|passwd|secret|token|api_key)\s?[=:]\s?[\x22']?[A-Za-z0-9_/+.-]{8,}"
#: Values of a usual form within a card candidate of other groups.
_USUAL = "|".join((_ISO, _PHONE, _SOCIAL, rf"(?<![\w-]){_FOURS}", r"(?<=[ -])\d{13,19}(?![\w-])"))
CANDIDATE = "|".join((_EMAIL, _ACCESS, _SECRET, _ADDRESS, _ISO, _DAY_FIRST, _PHONE, _SOCIAL, _WORLD, _CARD, _IBAN))
#: A text without any of these holds no candidate.
_HINT = r"[0-9][ -]?[0-9]|@|[=:]|AKIA|\+[1-9]"


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, reverse: bool) -> Column:
    """A struct (l, r) with l < a and r < b: the keyed permutation of (left, right), or its inverse."""
    sign = F.lit(-1 if reverse else 1).cast("long")
    rounds = range(ROUNDS - 1, -1, -1) if reverse else range(ROUNDS)

    def step(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        digest = F.conv(F.substring(_keyed(key, tweak, i, F.when(i % 2 == 0, r).otherwise(l)), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, F.pmod(l + sign * F.pmod(digest, a), a)).otherwise(l).alias("l"), F.when(i % 2 == 0, r).otherwise(F.pmod(r + sign * F.pmod(digest, b), b)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, step)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def permute_number(value: Column, a: int, b: int, key: str, tweak: str, reverse: bool) -> Column:
    """The permutation of a whole number below a * b."""
    pair = feistel(F.floor(value / F.lit(b)).cast("long"), F.pmod(value, F.lit(b)), F.lit(a), F.lit(b), key, F.lit(tweak), reverse)
    return _bind(pair, lambda p: p["l"] * F.lit(b) + p["r"])


def permute_digits(digits: Column, key: str, tweak: str, reverse: bool) -> Column:
    """The permutation of digit strings of one length (2 to 36)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    pair = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n), ten(u), ten(n - u), key, F.concat(F.lit(tweak), n.cast("string")), reverse)
    return _bind(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, F.lit("0")), F.lpad(p["r"].cast("string"), n - u, F.lit("0"))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """The match with its digits replaced in order; the other characters stay."""
    step = lambda acc, ch: F.when(ch.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substring(acc["d"], F.lit(1), F.lit(1))).alias("s"), F.substring(acc["d"], F.lit(2), F.length(acc["d"])).alias("d"))).otherwise(F.struct(F.concat(acc["s"], ch).alias("s"), acc["d"].alias("d")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), digits.alias("d")), step, lambda acc: acc["s"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string with its check digit."""
    n = F.length(digits)
    every = F.transform(F.split(digits, ""), lambda ch, i: F.when((n - i) % 2 == 0, F.pmod(ch.cast("int") * 2, F.lit(10)) + F.floor(ch.cast("int") * 2 / 10).cast("int")).otherwise(ch.cast("int")))
    return F.aggregate(every, F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Remainder modulo 97 of the digits of an IBAN's rearranged form (A is 10 to Z is 35)."""
    value = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, ch: F.pmod(F.when(ch.rlike("[0-9]"), s * 10).otherwise(s * 100) + value(ch), F.lit(97)))


def _card(m: Column, key: str, reverse: bool) -> Column:
    def with_check(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))

    return _bind(permute_digits(F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 1), key, "card", reverse), lambda body: _refill(m, with_check(body)))


def _first(values: list[Column], fits) -> Column:
    """The first that fits; null if none does."""
    return F.get(F.filter(F.array(*values), lambda x: (x != "") & fits(x)), F.lit(0))


def _card_in(m: Column) -> Column:
    usual = m.rlike(_USUAL)
    forms = [F.regexp_extract(m, f"^{rx}", 0) for rx in _CARD_FORMS[:-1]]
    luhn = lambda x: (F.pmod(luhn_sum(_digits(x)), F.lit(10)) == 0)
    return F.when(m.rlike("^[0-9][0-9 -]+$") & F.length(_digits(m)).between(13, 19), _first([*forms, F.when(~usual, m).otherwise("")], luhn))


def _iban_in(m: Column) -> Column:
    def fits(x: Column) -> Column:
        plain = F.regexp_replace(x, " ", "")
        body = F.substring(plain, F.lit(5), F.length(plain))
        return (F.length(_digits(body)) >= 2) & F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)

    groups = [F.regexp_extract(m, rf"^[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}(?!\w)", 0) for n in range(7, 1, -1) for tail in ("(?: ?[A-Z0-9]{1,3})", "")]
    return F.when(m.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]+)+$"), _first(groups, fits))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """Area and exchange codes start with 2 to 9: 800 * 800 * 10,000 numbers."""
    d = F.substring(_digits(m), F.length(_digits(m)) - 9, F.lit(10))
    part = lambda at: F.substring(d, at, 3).cast("long") - 200
    value = (part(1) * 800 + part(4)) * 10_000 + F.substring(d, 7, 4).cast("long")
    new = _bind(permute_number(value, 80_000, 80_000, key, "phone", reverse), lambda v: F.concat((F.floor(v / F.lit(8_000_000)) + 200).cast("string"), (F.pmod(F.floor(v / F.lit(10_000)), F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(v, F.lit(10_000)).cast("string"), 4, "0")))
    return _refill(m, F.concat(F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 10), new))


def _world(m: Column, key: str, reverse: bool) -> Column:
    """The country code's first digit stays."""
    return _refill(m, F.concat(F.substring(_digits(m), 1, 1), permute_digits(F.substring(_digits(m), F.lit(2), F.length(_digits(m))), key, "world", reverse)))


def _social(m: Column, key: str, reverse: bool) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    d = _digits(m)
    area = F.substring(d, 1, 3).cast("long")
    value = ((area - 1 - (area > 666).cast("long")) * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1

    def back(v: Column) -> Column:
        a = F.floor(v / F.lit(99 * 9999))
        a = a + 1 + (a >= 665).cast("long")
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(v / F.lit(9999)), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return _refill(m, _bind(permute_number(value, 898 * 99, 9999, key, "social", reverse), back))


def _address(m: Column, key: str, reverse: bool) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    octet = lambda v, k: F.pmod(F.floor(v / F.lit(256**k)), F.lit(256)).cast("string")
    return _bind(permute_number(value, 65536, 65536, key, "address", reverse), lambda v: F.concat_ws(".", *[octet(v, k) for k in (3, 2, 1, 0)]))


def _day_number(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, form: str, key: str, reverse: bool) -> Column:
    n = _day_number(F.try_to_timestamp(m, F.lit(form)).cast("date")).cast("long")
    new = permute_number(n, DAYS_SIDE, DAYS_SIDE, key, "date", reverse)
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)


def _iban(m: Column, key: str, reverse: bool) -> Column:
    """Digits of the account part are permuted, letters stay, check digits are recomputed."""
    plain = F.regexp_replace(m, " ", "")
    body = F.substring(plain, F.lit(5), F.length(plain))
    new_body = _refill(body, permute_digits(_digits(body), key, "iban", reverse))

    def whole(b: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(b, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return _refill(m, F.concat(check, _digits(b)))

    return _bind(new_body, whole)


def _token(m: Column, key: str) -> Column:
    """Keeps the name before the value; the value becomes hexadecimal digits of the same length."""
    head = F.regexp_extract(m, r"^(?i:password|passwd|secret|token|api_key)\s?[=:]\s?[\x22']?", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m))
    long = F.concat(_keyed(key, F.lit("token"), value), _keyed(key, F.lit("token2"), value))
    return F.concat(head, F.rpad(F.substring(long, F.lit(1), F.least(F.length(value), F.lit(128))), F.length(value), F.lit("0")))


def _dates() -> list[tuple[str, str]]:
    return [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy")]


def kinds(m: Column, key: str, reverse: bool) -> list[tuple]:
    """(name, test, pseudonym, and the matched length where it may be less than all of m) in the order in which they are tried."""
    whole = lambda rx: m.rlike(f"^(?:{rx})$")
    d = _digits(m)
    ip = whole(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
    out = [
        ("email", m.contains("@"), F.concat(F.lit("p"), F.substring(_keyed(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@example.invalid"))),
        ("access_key", whole("AKIA[0-9A-Z]{16}"), F.concat(F.lit("AKIA"), F.upper(F.substring(_keyed(key, F.lit("access"), m), 1, 16)))),
        ("secret", m.rlike(r"^[A-Za-z_]+\s?[=:].*[0-9]"), _token(m, key)),
        ("address", ip & F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), _address(m, key, reverse)),
    ]
    for start, form in _dates():
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        fits = whole(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}") & m.rlike(start)
        out.append(("date", fits & _day_number(day).between(0, DAYS_SIDE * DAYS_SIDE - 1), _date(m, form, key, reverse)))
    phone = whole(r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}")
    social = whole(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
    card, iban = _card_in(m), _iban_in(m)
    return out + [
        ("phone", phone, _phone(m, key, reverse)),
        ("social", social, _social(m, key, reverse)),
        ("phone", m.startswith("+") & F.length(d).between(8, 15), _world(m, key, reverse)),
        ("card", card.isNotNull(), _bind(card, lambda x: _card(x, key, reverse)), F.length(card)),
        ("iban", iban.isNotNull(), _bind(iban, lambda x: _iban(x, key, reverse)), F.length(iban)),
    ]


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", reverse: bool = False, replace_only: bool = False) -> DataFrame:
    """Replaces ``text`` and adds n_pseudonyms and pii_kinds (names of the kinds found, in text order).

    A projection: no shuffle, no state. ``reverse`` restores numbers and dates made with the key.
    ``replace_only`` adds no columns; without it a table that has them already is refused.
    """
    if not key:
        raise ValueError("a key is needed")
    if not replace_only and (clash := {"n_pseudonyms", "pii_kinds"} & set(docs.columns)):
        raise ValueError(f"the table has {', '.join(sorted(clash))} already; rename them or use replace_only")

    def convert(m: Column) -> Column:
        case = None
        for name, test, new, *n in kinds(m, key, reverse):
            value = F.struct(F.lit(name).alias("kind"), new.alias("new"), (n[0] if n else F.length(m)).alias("n"))
            case = F.when(test, value) if case is None else case.when(test, value)
        return case.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"), F.length(m).alias("n")))

    def take(acc: Column, x: Column) -> Column:
        """``over`` is how far the last match reaches into what follows; x is a candidate and the text up to the next one."""
        part, found = x["part"], x["found"]
        size, over = F.length(part), acc["over"]
        free = (over == 0) & found["kind"].isNotNull()
        gone = F.when(free, found["n"]).otherwise(over)
        text = F.concat(F.when(free, found["new"]).otherwise(F.lit("")), F.substring(part, gone + 1, size))
        kind = F.when(free, F.array(found["kind"])).otherwise(none)
        return F.struct(F.greatest(gone - size, F.lit(0)).alias("over"), F.concat(acc["parts"], F.array(text)).alias("parts"), F.concat(acc["kinds"], kind).alias("kinds"))

    def take_block(acc: Column, block: Column) -> Column:
        """``STEP`` candidates at a time, since every step copies what its block has so far."""
        begin = F.struct(acc["over"].alias("over"), none.alias("parts"), none.alias("kinds"))
        got = F.aggregate(F.slice(F.col(_PAIRS), block * STEP + 1, F.lit(STEP)), begin, take, lambda x: F.struct(x["over"].alias("over"), F.array_join(x["parts"], "").alias("text"), x["kinds"].alias("kinds")))
        return _bind(got, lambda x: F.struct(x["over"].alias("over"), F.concat(acc["parts"], F.array(x["text"])).alias("parts"), F.concat(acc["kinds"], F.array(x["kinds"])).alias("kinds")))

    t, none = F.col(text), F.array().cast("array<string>")
    lead = F.concat(F.lit("\n"), t)  # what stands before the first candidate is then never empty
    found = F.when(t.rlike(_HINT), F.regexp_extract_all(lead, F.lit(f"(?=({CANDIDATE}))"), F.lit(1)))
    step = docs.withColumn("__pii_found", found).withColumn("__pii_new", F.when(F.size("__pii_found") > 0, F.transform("__pii_found", convert)))
    step = step.withColumn("__pii_new", F.when(F.exists("__pii_new", lambda x: x["kind"].isNotNull()), F.col("__pii_new")))
    step = step.withColumn("__pii_parts", F.when(F.col("__pii_new").isNotNull(), F.split(lead, f"(?={CANDIDATE})", -1)))
    parts = F.col("__pii_parts")
    step = step.withColumn(_PAIRS, F.zip_with(F.slice(parts, F.lit(2), F.size("__pii_new")), F.col("__pii_new"), lambda a, b: F.struct(a.alias("part"), b.alias("found"))))
    begin = F.struct(F.lit(0).alias("over"), F.array(F.substring(parts[0], F.lit(2), F.length(parts[0]))).alias("parts"), F.array(none).alias("kinds"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(_PAIRS) - 1) / STEP).cast("int"))
    step = step.withColumn("__pii_out", F.when(F.col("__pii_new").isNotNull(), F.aggregate(blocks, begin, take_block, lambda acc: F.struct(F.array_join(acc["parts"], "").alias("text"), F.flatten(acc["kinds"]).alias("kinds")))))
    kinds_found = F.coalesce(F.col("__pii_out")["kinds"], none)
    out = step.select(*[(F.when(F.col("__pii_out").isNotNull(), F.col("__pii_out")["text"]).otherwise(t).alias(text) if c == text else F.col(c)) for c in docs.columns],
                      kinds_found.alias("__pii_kinds"))
    if replace_only:
        return out.drop("__pii_kinds")
    return out.select(*docs.columns, F.size("__pii_kinds").alias("n_pseudonyms"), F.col("__pii_kinds").alias("pii_kinds"))


#: The query's key. A deployment passes its own secret.
QUERY_KEY = "quantloom query key"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY)
