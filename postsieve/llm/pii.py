"""Format-preserving pseudonyms of personal data, by a keyed Feistel network. Only DataFrame functions run.

Found in a text: e-mail addresses, payment card numbers (14, 15, 16 or 19 digits that pass the Luhn check), bank account numbers (IBAN of their
country's length that pass the check modulo 97), telephone numbers, IPv4 addresses (four numbers up to 255), calendar dates and secrets (long hex
tokens). Domains of e-mail addresses stay, as do countries of accounts and telephones; IPv6 addresses are not looked for. Each is a row of digits in some mixed radix: decimal digits, letters,
bytes or a day within its century. Eight Feistel rounds with a keyed hash permute the rows of a format among themselves, so a pseudonym has the
format of what it stands for, and equal values have equal pseudonyms in all documents. Check digits of cards and accounts are computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

ROUNDS = 8

# Lengths of bank account numbers (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT ST",
    26: "IS TR",
    27: "FR GR IT MC MR SM",
    28: "AL AZ CY DO GT HU LB PL",
    29: "BR PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
}
_ACCOUNTS = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# Groups of the digits of payment cards: 19 digits that begin with 62, 15 with 34 or 37, 14 with 30, 36 or 38, and any 16.
_CARDS = "62[0-9]{2}(?:[ -]?[0-9]{4}){3}[ -]?[0-9]{3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3[068][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{4}|[0-9]{4}(?:[ -]?[0-9]{4}){3}"
# What the kinds of personal data look like. Tried in this order at each place of a text. All repeats of groups are bounded, so that no text, however long,
# makes the matcher recurse; the name of a domain has 127 parts at most.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ACCOUNTS})(?![0-9A-Za-z])",
    "card": rf"(?<![0-9])(?:{_CARDS})(?![0-9])",
}
# A group of a telephone number is not the start of another find, and its third one ends where no decimals follow.
_GROUP = rf"(?![ -]?(?:{KINDS['ip']}|{KINDS['date']}|{KINDS['card']}(?![ -][0-9]{{4}})))[ -]?[0-9]{{2,4}}"
KINDS["phone"] = rf"\+[0-9]{{1,3}} ?\(?[0-9]{{2,4}}\)?(?:{_GROUP}){{2}}(?:{_GROUP}(?![0-9]|\.[0-9]))?(?![0-9])"
# The country code of a telephone number: set off by a blank or parenthesis, else by the length that calling codes have.
_COUNTRY = r"^\+(?:[0-9]{1,3}(?: |(?=\())|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: All kinds; the characters that a match can start with come first, so most places of a text are passed over at once.
PATTERN = r"(?=[0-9A-Za-z._%+-])(?:" + "|".join(KINDS.values()) + ")"
#: What a text must hold to have a match at all.
HINT = r"[0-9@]"
_KIND_TESTS = {k: f"^(?:{p})$" for k, p in KINDS.items()}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of an array of decimal digits whose last one is the check digit."""
    n = F.size(digits)
    weighted = F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def feistel(digits: Column, radix: Column, key: str, label: Column) -> Column:
    """``digits`` (array<int>, each below its ``radix``) permuted among all such arrays of this label.

    The halves take turns: every digit of one half is moved by a keyed hash of the other half, modulo its radix. Undone by the
    same moves backwards, so two values never meet. A single digit is moved by a keyed constant.
    """
    n = F.size(digits)
    half = F.floor(n / 2).cast("int")

    def move(state: Column, turn: Column) -> Column:
        left_turn = F.pmod(turn, F.lit(2)) == 0
        still = F.when(left_turn, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, F.lit(1), half))
        seed = F.concat_ws(",", F.lit(key), label, turn.cast("string"), F.array_join(F.transform(still, lambda d: d.cast("string")), "."))
        # a hash has room for five digits of twelve hex digits each
        # a long seed goes in as its own hash, so the time stays linear
        short = F.when(n > 128, F.sha2(seed, 256)).otherwise(seed)
        hashes = bound(short, lambda s: F.transform(F.sequence(F.lit(0), F.floor(n / 5).cast("int")), lambda j: F.sha2(F.concat_ws(":", s, j.cast("string")), 256)))

        def shifted(d: Column, i: Column, hashed: Column) -> Column:
            part = F.substr(F.get(hashed, F.floor(i / 5).cast("int")), F.pmod(i, F.lit(5)) * 12 + 1, F.lit(12))
            own = F.when(left_turn, i < half).otherwise(i >= half)
            return F.when(own, F.pmod(d + F.conv(part, 16, 10).cast("long"), F.get(radix, i)).cast("int")).otherwise(d)

        return bound(hashes, lambda hashed: F.transform(state, lambda d, i: shifted(d, i, hashed)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), digits, move)


def _permuted_characters(value: Column, key: str, label: str, letters: int = 26, spaced: bool = True) -> Column:
    """Digits, small letters and capitals permuted within their class, letters among the first ``letters``; other characters stay where they are.

    Not ``spaced``: the other characters do not bear on what stands for the known ones."""
    sets = ["0123456789", LETTERS, LETTERS.upper()]
    which = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    spell = lambda c, d: F.substr(F.element_at(F.array(*[F.lit(s) for s in sets]), which(c) + 1), d + 1, F.lit(1))

    def permuted(chars: Column, known: Column) -> Column:
        digits = F.transform(known, lambda c: F.when(which(c) == 0, F.ascii(c) - 48).when(which(c) == 1, F.ascii(c) - 97).otherwise(F.ascii(c) - 65))
        radix = F.transform(known, lambda c: F.when(which(c) == 0, 10).otherwise(letters))
        shape = F.array_join(F.transform(chars, lambda c: F.when(which(c) < 3, which(c).cast("string")).otherwise(c)), "") if spaced else F.lit("")
        moved = bound(digits, lambda d: bound(radix, lambda r: bound(F.concat(F.lit(label), shape), lambda s: feistel(d, r, key, s))))
        # the characters again: each known one is the next of the moved ones
        at = F.transform(chars, lambda c, i: F.when(F.size(known) == F.size(chars), i).otherwise(F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: which(x) < 3)) - 1))
        return bound(moved, lambda m: F.array_join(F.zip_with(chars, at, lambda c, a: F.when(which(c) < 3, spell(c, F.get(m, a))).otherwise(c)), ""))

    return bound(F.split(value, ""), lambda chars: bound(F.filter(chars, lambda c: which(c) < 3), lambda known: permuted(chars, known)))


def _laid_out(value: Column, made: Column) -> Column:
    """``value`` with its digits and letters replaced by the characters of ``made`` in turn; blanks and hyphens stay where they are."""
    plain = lambda c: ~c.isin(" ", "-")
    at = lambda chars, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), plain))
    return bound(made, lambda m: bound(F.split(value, ""), lambda chars: F.array_join(F.transform(chars, lambda c, i: F.when(plain(c), F.substr(m, at(chars, i), F.lit(1))).otherwise(c)), "")))


def _pseudo_card(value: Column, key: str) -> Column:
    """All digits of 16 but the check digit are permuted; of other lengths, which tell by their first two digits, those stay."""
    digits = F.transform(F.split(F.regexp_replace(value, "[ -]", ""), ""), lambda c: c.cast("int"))
    check = lambda body: F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.array(F.lit(0)))), F.lit(10)), F.lit(10))

    def made(d: Column) -> Column:
        n = F.size(d)
        first = F.when(n == 16, F.slice(d, 1, 0)).otherwise(F.slice(d, 1, 2))
        free = n - 1 - F.size(first)
        label = F.concat(F.lit("card"), F.when(n == 16, F.lit("")).otherwise(F.concat(n.cast("string"), F.lit(","), F.array_join(first.cast("array<string>"), ""))))
        moved = F.concat(first, feistel(F.slice(d, F.size(first) + 1, free), F.array_repeat(F.lit(10), free), key, label))
        return bound(moved, lambda body: F.array_join(F.transform(F.concat(body, F.array(check(body))), lambda x: x.cast("string")), ""))

    return _laid_out(value, bound(digits, made))


def iban_rest(account: Column) -> Column:
    """What an account number without blanks leaves modulo 97, its first four characters put last and letters read as 10 to 35; 1 if it is valid."""
    chars = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(step(a, c), F.lit(97)))


def _pseudo_iban(value: Column, key: str) -> Column:
    """The country stays; digits and letters after the check digits are permuted within their class."""

    def made(account: Column) -> Column:
        country = F.substr(account, F.lit(1), F.lit(2))
        check = lambda rest: F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
        return bound(_permuted_characters(F.substr(account, F.lit(5)), key, "iban"), lambda rest: F.concat(country, check(rest), rest))

    return _laid_out(value, bound(F.regexp_replace(value, " ", ""), made))


def _pseudo_ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    return F.array_join(F.transform(feistel(parts, F.array_repeat(F.lit(256), 4), key, F.lit("ip")), lambda d: d.cast("string")), ".")


def _pseudo_date(value: Column, key: str) -> Column:
    """A day of the same century. Days are pairs of digits of radix 192, which go on being permuted while they lie past the century's end."""
    first = F.to_date(F.concat(F.substring(value, 1, 2), F.lit("00-01-01")))
    days = F.datediff(F.add_months(first, 1200), first)
    number = F.datediff(F.try_to_date(value), first)
    once = lambda pair: feistel(pair, F.array_repeat(F.lit(192), 2), key, F.concat(F.lit("date"), F.substring(value, 1, 2)))
    pair = F.array(F.floor(number / 192).cast("int"), F.pmod(number, F.lit(192)).cast("int"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), once(pair), lambda p, _: F.when(p[0] * 192 + p[1] < days, p).otherwise(once(p)))
    return bound(walked, lambda p: F.date_format(F.date_add(first, p[0] * 192 + p[1]), "yyyy-MM-dd"))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null where it does not pass its check (Luhn, modulo 97, calendar)."""
    digits = F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int"))
    out = F.when(F.lit(False), F.lit(""))
    for kind, test in _KIND_TESTS.items():
        good = F.lit(True)
        if kind == "card":
            good = F.pmod(luhn_sum(digits), F.lit(10)) == 0
        elif kind == "iban":
            good = bound(F.regexp_replace(value, " ", ""), iban_rest) == 1
        elif kind == "date":
            good = F.try_to_date(value).isNotNull()
        out = out.when(value.rlike(test), F.when(good, F.lit(kind)))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """What stands for ``value``; ``value`` itself where the kind is null."""
    at = F.instr(value, "@").cast("int")
    prefix = F.regexp_extract(value, _COUNTRY, 0)  # of a telephone number: its country code stays
    phone = F.concat(prefix, _permuted_characters(F.substr(value, F.length(prefix) + 1), key, "phone", spaced=False))
    email = F.concat(_permuted_characters(F.substr(value, F.lit(1), at - 1), key, "email"), F.substr(value, at))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", _pseudo_card(value, key))
        .when(kind == "iban", _pseudo_iban(value, key))
        .when(kind == "ip", _pseudo_ip(value, key))
        .when(kind == "date", _pseudo_date(value, key))
        .when(kind == "phone", phone)
        .when(kind == "secret", _permuted_characters(value, key, "secret", 6))
        .otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by one that has pseudonyms, and pii (array of kind, value length and pseudonym for each found one, in order).

    The text is cut at the matches and put together again, so all else stays as it was. A null text stays null and has no
    finds; an empty text stays empty. A number that fails its check (a card's Luhn sum, an account's check digits, a day that no calendar has) is left alone.
    A column pii is replaced; others stay. Repeated rows get equal results. The ``key`` must be kept secret to keep pseudonyms so: who has it can undo them.
    """
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    rest = [c for c in docs.columns if c not in (text_col, "pii")]
    cut = docs.select(packed(docs, rest), text.alias("text_"), found.alias("found_")) if rest else docs.select(text.alias("text_"), found.alias("found_"))
    cut = cut.withColumn("found_", F.coalesce("found_", F.array().cast("array<string>")))
    made = F.transform("found_", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    cut = cut.withColumn("found_", made).withColumn("made_", F.transform("found_", lambda x: pseudonym(x["value"], x["kind"], key)))
    pieces = F.split("text_", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat("made_", F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    finds = F.filter(F.zip_with("found_", "made_", lambda x, m: F.struct(x["kind"].alias("kind"), F.length(x["value"]).alias("length"), m.alias("pseudonym"))), lambda x: x["kind"].isNotNull())
    names = [c for c in docs.columns if c != "pii"]
    out = cut.withColumn("new_", F.when(F.size("made_") > 0, joined).otherwise(F.col("text_")))
    return out.select(*[F.col("new_").alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in names], finds.alias("pii"))
