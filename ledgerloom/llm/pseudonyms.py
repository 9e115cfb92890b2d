"""Format-preserving pseudonyms by Feistel networks, in DataFrame functions only.

What is found and validated is replaced by a value of the same format, permuted under a key, so that equal values get equal pseudonyms in
every document and the key's owner can undo it:

* card numbers (13 to 19 digits, single spaces or hyphens anywhere between them, right check digit): the digits before the last are
  permuted, the check digit is made anew. In a longer row of digit groups a card is the one that ends first, and of those the longest;
  where new digits would move it, they are permuted again (cycle walking);
* phone numbers (``+`` and 8 to 15 digits, single separators and brackets anywhere between them): the digits after the country code,
  which ends at the first separator or, in a number that starts with more than three digits, as the numbering plan has it;
* social security numbers ``ddd-dd-dddd`` that can be issued (area not 000, 666 or 900 and over, group not 00, serial not 0000): all
  nine digits are permuted, again and again until the result can be issued too (cycle walking);
* IPv4 addresses: the 32-bit number;
* dates (``yyyy-mm-dd``, ``dd.mm.yyyy``, ``dd/mm/yyyy``) from 1900-01-01 on for 73,170 days (to 2100-04-30): the day's number;
* e-mail addresses: letters and digits before the ``@``; the domain stays.

Strings are split in halves; in each of ``ROUNDS`` rounds every letter and digit of one half moves within its own kind (a-z, A-Z, 0-9) by
SHA-256 of key, kind, round, place and the other half. Numbers (addresses, days) are split into a quotient and a remainder that are
treated alike.

Values that fail their validation stay as they are. Null texts stay null with zero counts; empty texts stay empty. Rows are treated one
by one, so repeated rows give repeated results and an empty table an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "pseudonym-key-1"
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 271, 270
#: Steps of cycle walking; about one number in eight cannot be issued, so a walk outlasts them with a chance below 1e-20.
WALK = 24
#: The same for cards in rows of digit groups, where each other place for a card holds by chance in one of ten.
CARD_WALK = 256
#: A card has at most 19 groups, and one that overlaps it starts at most 18 before.
OPEN_GROUPS = 37

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "date": r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
}
#: What a row of digit groups must not run into.
_OTHERS = "|".join(f"(?:{p})" for p in _FORMATS.values())
_PLAIN_CARD = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{13}"
FORMATS = {
    "email": _FORMATS["email"],
    "phone": rf"(?<![\d+])\+\d(?:(?:(?:[ .-]?\(|\)[ .-]?|[ .-])(?!{_OTHERS}|{_PLAIN_CARD}))?\d){{7,14}}(?!\d)",
    "date": _FORMATS["date"],
    "ssn": _FORMATS["ssn"],
    "ip": _FORMATS["ip"],
    "card": rf"(?<!\d)\d(?:(?:[ -](?!{_OTHERS}))?\d){{12,}}+",
}
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
_ORDER = list(FORMATS)


def _digest(key: str, *parts: Column | str) -> Column:
    """52 bits of SHA-256 as a long."""
    parts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in (key, *parts)]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("long")


def _rounds(back: bool) -> Column:
    return F.array(*[F.lit(k) for k in (reversed(range(ROUNDS)) if back else range(ROUNDS))])


def permute_string(value: Column, kind: str, key: str, back: bool = False) -> Column:
    """Moves letters and digits within their kinds; everything else stays in its place."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.array(F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.length(value)))
    sign = -1 if back else 1

    def moved(char: Column, by: Column) -> Column:
        code = F.ascii(char)

        def within(first: str, size: int) -> Column:
            return F.chr(F.pmod(code - ord(first) + sign * by, F.lit(size)) + ord(first))

        return (F.when(char.between("0", "9"), within("0", 10)).when(char.between("a", "z"), within("a", 26))
                .when(char.between("A", "Z"), within("A", 26)).otherwise(char))

    def shifted(own: Column, other: Column, k: Column) -> Column:
        chars = F.transform(F.split(own, ""), lambda c, i: moved(c, _digest(key, kind, k, i, other)))
        return F.when(own == "", own).otherwise(F.array_join(chars, ""))

    def step(halves: Column, k: Column) -> Column:
        left, right = halves[0], halves[1]
        return F.when(k % 2 == 0, F.array(shifted(left, right, k), right)).otherwise(F.array(left, shifted(right, left, k)))

    return F.aggregate(_rounds(back), start, step, lambda halves: F.concat(halves[0], halves[1]))


def permute_number(value: Column, high: int, low: int, kind: str, key: str, back: bool = False) -> Column:
    """A permutation of the numbers below ``high * low``."""
    sign = -1 if back else 1
    start = F.array(F.floor(value / low).cast("long"), F.pmod(value, F.lit(low)).cast("long"))

    def step(halves: Column, k: Column) -> Column:
        left, right = halves[0], halves[1]
        even = F.array(F.pmod(left + sign * F.pmod(_digest(key, kind, k, right), F.lit(high)), F.lit(high)), right)
        odd = F.array(left, F.pmod(right + sign * F.pmod(_digest(key, kind, k, left), F.lit(low)), F.lit(low)))
        return F.when(k % 2 == 0, even).otherwise(odd)

    return F.aggregate(_rounds(back), start, step, lambda halves: halves[0] * low + halves[1])


def check_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weigh(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), weigh)


def kind_of(found: Column) -> Column:
    """Name of the format of a found value if it is valid, else null."""
    digits = F.regexp_replace(found, r"\D", "")
    day = F.datediff(_day(found), F.lit(FIRST_DAY).cast("date"))
    return (F.when(found.contains("@"), "email").when(found.startswith("+"), F.when(F.length(digits) >= 8, "phone"))
            .when(found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
            .when(found.rlike(r"^\d{3}-\d\d-\d{4}$"), F.when(_issued(found), "ssn"))
            .when(F.length(digits) == 8, F.when(day.between(0, DAYS_HIGH * DAYS_LOW - 1), "date")))


def _issued(number: Column) -> Column:
    return ~(number.rlike(r"^(?:000|666|9)") | number.rlike(r"^\d{3}-00") | number.rlike(r"0000$"))


def _shape(found: Column) -> Column:
    return F.when(found.contains("-"), "yyyy-MM-dd").when(found.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")


def _day(found: Column) -> Column:
    """The date, or null where there is none of that name."""
    iso = F.when(found.contains("-"), found).otherwise(F.concat(
        F.substring(found, 7, 4), F.lit("-"), F.substring(found, 4, 2), F.lit("-"), F.substring(found, 1, 2)))
    return iso.try_cast("date")


def _card(found: Column, key: str, back: bool) -> Column:
    body = F.substring(found, F.lit(1), F.length(found) - 1)
    new = permute_string(body, "card", key, back)
    sum_ = check_sum(F.concat(F.regexp_replace(new, r"\D", ""), F.lit("0")))
    return F.concat(new, F.pmod(-sum_, F.lit(10)).cast("string"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(found: Column) -> Column:
    return F.regexp_extract_all(found, F.lit(r"\d+[ -]?"), F.lit(0))


def _card_start(groups: Column) -> Column:
    """Number (from 1) of the first group of the longest card that ends with the last group, else null."""
    def is_card(start: Column) -> Column:
        return _let(F.regexp_replace(F.array_join(F.slice(groups, start, F.size(groups)), ""), r"\D", ""),
                    lambda digits: F.length(digits).between(13, 19) & (check_sum(digits) % 10 == 0))

    return F.get(F.filter(F.sequence(F.lit(1), F.size(groups)), is_card), F.lit(0))


def _walked_card(before: Column, card: Column, key: str, back: bool) -> Column:
    """The permuted card; among the groups ``before`` it is found at the same place again."""
    def at_place(new: Column) -> Column:
        def check(groups: Column) -> Column:
            sooner = F.exists(F.sequence(F.lit(1), F.size(groups)), lambda k: (k < F.size(groups)) & _card_start(F.slice(groups, F.lit(1), k)).isNotNull())
            return (_card_start(groups) == F.size(before) + 1) & ~sooner
        return _let(F.concat(before, _groups(new)), check)

    def step(now: Column, _: Column) -> Column:
        moved = _let(_card(now["card"], key, back), lambda new: F.struct(new.alias("card"), at_place(new).alias("done")))
        return F.when(now["done"], now).otherwise(moved)

    start = F.struct(card.alias("card"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CARD_WALK)), start, step, lambda now: now["card"])


def _cards(found: Column, key: str, back: bool) -> Column:
    """``text, n``: a row of digit groups with its cards replaced, and their number."""
    none = F.array().cast("array<string>")

    def step(now: Column, group: Column) -> Column:
        def placed(row: Column) -> Column:
            groups, start = row["groups"], row["start"]
            before = F.slice(groups, F.lit(1), start - 1)
            card = F.regexp_replace(F.array_join(F.slice(groups, start, F.size(groups)), ""), r"[ -]$", "")
            hit = F.struct(F.concat(now["text"], F.array_join(before, ""), _walked_card(before, card, key, back), F.regexp_extract(group, r"[ -]?$", 0)).alias("text"),
                           none.alias("open"), (now["n"] + 1).alias("n"))
            full = F.struct(F.concat(now["text"], F.get(groups, F.lit(0))).alias("text"), F.slice(groups, F.lit(2), F.lit(OPEN_GROUPS)).alias("open"), now["n"].alias("n"))
            more = F.struct(now["text"].alias("text"), groups.alias("open"), now["n"].alias("n"))
            return F.when(start.isNotNull(), hit).when(F.size(groups) > OPEN_GROUPS, full).otherwise(more)

        return _let(F.concat(now["open"], F.array(group)), lambda groups: _let(
            F.struct(groups.alias("groups"), _card_start(groups).alias("start")), placed))

    zero = F.struct(F.lit("").alias("text"), none.alias("open"), F.lit(0).alias("n"))
    return F.aggregate(_groups(found), zero, step, lambda end: F.struct(F.concat(end["text"], F.array_join(end["open"], "")).alias("text"), end["n"].alias("n")))


def _phone(found: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(found, rf"^\+(?:\d{{1,3}}(?!\d)|{_COUNTRY})", 0)
    return F.concat(code, permute_string(F.substring(found, F.length(code) + 1, F.length(found)), "phone", key, back))


def _ssn(found: Column, key: str, back: bool) -> Column:
    start = permute_string(found, "ssn", key, back)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda now, _: F.when(_issued(now), now).otherwise(permute_string(now, "ssn", key, back)))


def _ip(found: Column, key: str, back: bool) -> Column:
    number = F.aggregate(F.split(found, r"\."), F.lit(0).cast("long"), lambda total, octet: total * 256 + octet.cast("long"))
    new = permute_number(number, 65536, 65536, "ip", key, back)
    return F.concat_ws(".", *[F.pmod(F.shiftright(new, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)])


def _date(found: Column, key: str, back: bool) -> Column:
    number = F.datediff(_day(found), F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(number, DAYS_HIGH, DAYS_LOW, "date", key, back).cast("int"))
    return (F.when(found.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(found.contains("/"), F.date_format(new, "dd/MM/yyyy"))
            .otherwise(F.date_format(new, "dd.MM.yyyy")))


def _email(found: Column, key: str, back: bool) -> Column:
    at = F.instr(found, "@")
    return F.concat(permute_string(F.substring(found, F.lit(1), at - 1), "email", key, back), F.substring(found, at, F.length(found)))


_NEW = {"email": _email, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date}


def pseudonymize(docs: DataFrame, key: str = KEY, back: bool = False) -> DataFrame:
    """``doc_id, text, n_email, n_phone, n_date, n_ssn, n_ip, n_card`` for every row; ``back`` undoes it."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    values = F.transform(F.regexp_extract_all("text", F.lit(PATTERN), 0), lambda v: F.struct(
        v.alias("old"), kind_of(v).alias("kind"), F.when(v.rlike(r"^\d[\d -]{12,}$"), _cards(v, key, back)).alias("cards")))
    rows = rows.withColumn("found", F.when(F.col("text").rlike(r"[0-9@]"), values))

    def new(value: Column) -> Column:
        out = F.when(value["cards"].isNotNull(), value["cards"]["text"]).when(value["kind"].isNull(), value["old"])
        for kind, make in _NEW.items():
            out = out.when(value["kind"] == kind, make(value["old"], key, back))
        return out

    parts = F.split("text", PATTERN, -1)
    joined = F.zip_with(F.slice(parts, F.lit(1), F.size("found")), F.transform("found", new), lambda a, b: F.concat(a, b))
    changed = F.concat(F.array_join(joined, ""), F.element_at(parts, -1))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda v: v["kind"] == kind)), F.lit(0))
    cards = F.aggregate("found", F.lit(0), lambda total, v: total + F.coalesce(v["cards"]["n"], F.lit(0)))
    return rows.select("doc_id", F.when(F.size("found") > 0, changed).otherwise(F.col("text")).alias("text"),
                       *[F.when(F.col("found").isNull(), 0).otherwise(cards if kind == "card" else count(kind)).cast("long").alias(f"n_{kind}") for kind in _ORDER])
