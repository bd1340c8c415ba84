"""PII surrogates: detected entities get keyed replacements of the same kind, everywhere the same, each its own.

DataFrame functions only. One pass of one pattern marks the entities; a text is cut at the marks, and its pieces are joined
again around the replacements. All different entities of a corpus make one table. Numbers get theirs from a keyed
permutation of all values of their form (a Feistel network that walks on until the form is right), so that they differ by
construction; addresses and the words of names from a keyed digest. A replacement that occurs as an entity, or is taken,
is drawn again, by another permutation or a longer word. Where a form has no free value left, a tag stands in.
"""

from __future__ import annotations

import os
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = "Mr|Mister|Sir|Herr|Herrn|Monsieur|Señor|Don|Господин|Κύριος"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Doña|Госпожа|Κυρία"
_EITHER = "Dr|Dra|Doctor|Doktor|Docteur|Prof|Professor|Professorin|Professeur|Profesor|Profesora|Rev|Доктор|Профессор|Δρ|Καθηγητής"


def _titles(words: str) -> str:
    """A title, or several: "Prof. Dr.", "Frau Dr."."""
    return rf"(?:{words})\.?(?: (?:{words})\.?){{0,3}} "


_MIXED = "|".join([_MALE, _FEMALE, _EITHER])
_TITLES, _CAPITAL_TITLES = _titles(_MIXED), _titles(_MIXED.upper())
_ANY_TITLES = f"(?:{_TITLES}|{_CAPITAL_TITLES})"
#: A word of a name, also like O'Brien and McDonald, and one in capitals.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_CAPITALS = r"\p{Lu}(?:['’]?\p{Lu})+"
#: Calling codes of countries (fixed values): those of one digit and of two; all others have three.
_COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_L = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{Mn}"
#: Kinds of entities, in the order in which they are tried at a place. Every run of word characters is entered at its start
#: alone, and without going back, so that long runs take linear time.
KINDS = {
    "email": rf"(?<![{_L}0-9._%+\-])[{_L}0-9._%+\-]++@(?:[{_L}0-9\-]++\.){{1,126}}(?:[A-Za-z]{{2,24}}(?![A-Za-z0-9])|\p{{IsCyrillic}}{{2,24}}(?!\p{{L}}))",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])\+?1?[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+.\-])(?:\+?1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w\-])|(?<![\w+])\+\d(?:(?:[ .\-/]|[ .\-/]?\(|\)[ .\-/]?)?\d){7,14}(?!\w)|(?<![\w+.,/:\-])(?<!\d )0(?=[1-9]\d{0,4} )(?: ?\d){8,13}(?![\w/:\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]\(?\d{2,4}\)?){2,4}(?!\w)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)",
    "person": rf"(?<![\p{{L}}\d])(?:{_TITLES}{_NAME}(?:[ \-]{_NAME}){{0,2}}|{_CAPITAL_TITLES}{_CAPITALS}(?:[ \-]{_CAPITALS}){{0,2}})(?!\p{{L}})",
}
#: Draws until an entity without a free replacement gets a tag.
DRAWS = 12


def _first(words: str) -> str:
    return "".join(sorted({w[0] for w in words.split("|")}))


#: What an entity of a kind starts with, looked at before the pattern itself.
_STARTS = {"ip": "(?=[0-9])", "ssn": "(?=[0-9])", "phone": "(?=[0-9+(])", "card": "(?=[0-9])", "iban": "(?=[A-Z]{2}[0-9])", "ip6": "(?=[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:])", "person": f"(?=[{_first(_MALE + '|' + _FEMALE + '|' + _EITHER)}])"}


def _any(kinds: list[str]) -> str:
    named = {k: KINDS[k].replace(r"([ \-])", r"(?<sep>[ \-])").replace(r"\1", r"\k<sep>") for k in kinds}
    return "|".join(f"{_STARTS.get(k, '')}(?:{named[k]})" for k in kinds)


ANY, ANY_BUT_EMAIL = _any(list(KINDS)), _any([k for k in KINDS if k != "email"])
#: Stands around entities in a marked text; texts that hold it themselves are cut by two passes instead.
MARK = "\ufdd0"

#: Syllables of made-up names by script; a name is a few of them, then an ending by gender.
_SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до за зо ка ки ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ро са се со та те ти то".split(),
    "greek": "βα βε βο γα γο δα δε δο ζα ζο θα θε κα κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρο σα σε σο τα τε τι το".split(),
}
_ENDINGS = {"latin": ("r", "a"), "cyrillic": ("р", "я"), "greek": ("ς", "α")}


def _digest(secret: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(secret), *parts), 512)


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th byte of a digest (from 0; it starts over after 64), as an integer."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(items: str | list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items)) + 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _recoded(text: Column, digest: Column) -> Column:
    """Digits become digits, ASCII letters letters of the same case, other letters ASCII letters; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), _pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("^[A-Z]$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).when(c.rlike(r"^[\p{L}\p{Mn}]$"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one not doubled."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        e = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(e > 9, e - 9).otherwise(e)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), one), F.lit(0), lambda s, x: s + x)


def kind_of(found: Column) -> Column:
    # names without a title are entities because of one with it
    return reduce(lambda c, k: c.when(found.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)), KINDS, F.when(F.lit(False), F.lit(""))).when(found.rlike(r"^\p{Lu}"), F.lit("person"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _national(found: Column) -> Column:
    """Digits of a phone number without its country's code and the 0 that stands for it at home."""
    digits = _digits(found)
    abroad = F.regexp_replace(digits, _COUNTRY, "")
    abroad = F.when(found.rlike(r"\(0"), F.regexp_replace(abroad, "^0", "")).otherwise(abroad)
    home = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, F.lit(2), F.lit(10))).otherwise(F.regexp_replace(digits, "^0", ""))
    return F.when(found.startswith("+"), abroad).otherwise(home)


def normal(kind: Column, found: Column) -> Column:
    """What makes occurrences one entity: digits of numbers, of phones those within the country, letters of addresses in lower
    case, words of names.

    Names keep their gender, if a title tells it; a number of digits that is no card by its check digit gets none, and stays as it is.
    """
    digits = _digits(found)
    titles = F.regexp_extract(found, rf"^({_ANY_TITLES})", 1)
    male, female = (rf"(?:^| )(?:{w}|{w.upper()})[. ]" for w in (_MALE, _FEMALE))
    gender = F.when(titles.rlike(male), "m").when(titles.rlike(female), "f").otherwise("n")
    name = F.lower(F.substring(found, F.length(titles) + 1, F.length(found)))
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind == "phone", _national(found))
        .when(kind == "ip6", F.lower(found))
        .when(kind == "card", F.when(_luhn_sum(digits) % 10 == 0, digits))
        .when(kind == "ssn", digits)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "person", F.concat(gender, F.lit(":"), name))
        .otherwise(found)
    )


def _name(digest: Column, word: Column, gender: Column, tries: Column) -> Column:
    """A made-up word for a word of a name, in its script; given names whose gender is known end by it. Later draws are longer."""

    def built(script: str) -> Column:
        n = F.lit(2) + F.least(tries, F.lit(6))
        body = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(_SYLLABLES[script], _byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1))), "")
        male, female = _ENDINGS[script]
        return F.concat(body, F.when(gender == "m", male).when(gender == "f", female).otherwise(""))

    return F.when(word.rlike(r"^\p{IsCyrillic}"), built("cyrillic")).when(word.rlike(r"^\p{IsGreek}"), built("greek")).otherwise(built("latin"))


def _feistel(secret: str, label: Column, left: Column, right: Column, n_left: Column, n_right: Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs (left below n_left, right below n_right)."""
    def mixed(i: int, half: Column, other: Column, n: Column) -> Column:
        return F.pmod(half + F.conv(F.substring(_digest(secret, label, F.lit(str(i)), other.cast("string")), 1, 12), 16, 10).cast("long"), n)

    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for i in range(4):
        step = (lambda p, i=i: F.struct(mixed(i, p["l"], p["r"], n_left).alias("l"), p["r"].alias("r"))) if i % 2 == 0 else (lambda p, i=i: F.struct(p["l"].alias("l"), mixed(i, p["r"], p["l"], n_right).alias("r")))
        pair = F.get(F.transform(F.array(pair), step), 0)  # a lambda's argument is worked out once
    return F.transform(F.array(pair), lambda p: p["l"]), F.transform(F.array(pair), lambda p: p["r"])


def _permuted(secret: str, label: Column, digits: Column) -> Column:
    """Another string of as many digits (30 at most), by a keyed permutation of all of them."""
    n = F.length(digits)
    a = n - (n / 2).cast("int")  # a single digit is a left half
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = _feistel(secret, label, F.substring(digits, F.lit(1), a).cast("long"), F.coalesce(F.substring(digits, a + 1, n).try_cast("long"), F.lit(0)), ten(a), ten(n - a))
    return F.concat(F.lpad(F.get(left, 0).cast("string"), a, F.lit("0")), F.when(n > a, F.lpad(F.get(right, 0).cast("string"), n - a, F.lit("0"))).otherwise(""))


def _walked(value: Column, step, form) -> Column:
    """step(value), and on until it has the form of the value: a permutation of the values of each form."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(value), lambda x, _: F.when(form(x) == form(value), x).otherwise(step(x)))


def _phone_form(digits: Column) -> Column:
    """Numbers of the North American plan have neither 0 nor 1 before area and exchange; others keep their length, and a 0 at
    their start or its absence."""
    return F.when(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), "plan").when(digits.startswith("0"), "zero").otherwise("free")


def _ssn_form(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|9)|^...00|0000$")


def _ip_form(address: Column) -> Column:
    return F.when(address.rlike(r"^(?:0|1[02]7|10|2[2-9][0-9])\.|^22[0-3]\.|^192\.168\."), F.regexp_extract(address, r"^(192\.168|[0-9]+)\.", 1)).otherwise("public")


def _ip_step(secret: str, label: Column):
    """Permutes the octets behind the network of private, loopback and reserved addresses, or all of them."""
    def step(address: Column) -> Column:
        o = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))
        kept = F.when(_ip_form(address) == "public", 0).when(address.startswith("192.168."), 2).otherwise(1)
        at = lambda i: F.get(o, i)
        left = F.when(kept == 0, at(0) * 256 + at(1)).when(kept == 1, at(1)).otherwise(at(2))
        right = F.when(kept == 2, at(3)).otherwise(at(2) * 256 + at(3))
        wide, far = F.when(kept == 0, 65536).otherwise(256).cast("long"), F.when(kept == 2, 256).otherwise(65536).cast("long")
        left, right = (F.get(x, 0) for x in _feistel(secret, F.concat(label, _ip_form(address)), left, right, wide, far))
        own = F.when(kept == 0, F.array((left / 256).cast("int"), left % 256)).when(kept == 1, F.array(at(0), left)).otherwise(F.array(at(0), at(1), left))
        rest = F.when(kept == 2, F.array(right)).otherwise(F.array((right / 256).cast("int").cast("long"), right % 256))
        return F.array_join(F.transform(F.concat(own.cast("array<long>"), rest.cast("array<long>")), lambda x: x.cast("string")), ".")

    return step


def _iban(secret: str, label: Column, norm: Column) -> Column:
    """Country, check digits, then digits permuted and letters moved on by a key that depends on these digits."""
    body = F.substring(norm, F.lit(5), F.length(norm))
    digits = _digits(body)
    new = F.when(digits == "", "").otherwise(_permuted(secret, F.concat(label, F.substring(norm, 1, 2)), F.concat(digits)))
    d = _digest(secret, label, digits)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        letter = F.char(F.pmod(F.ascii(c) - 65 + _byte(d, acc["i"]), F.lit(26)) + 65)
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(new, acc["n"] + 1, F.lit(1))).otherwise(letter)).alias("out"), (acc["n"] + digit.cast("int")).alias("n"), (acc["i"] + 1).alias("i"))

    text = F.aggregate(_chars(body), start, step, lambda acc: acc["out"])
    # the remainder of the account, the country and 00 by 97, letters as 10 to 35
    whole = F.concat(text, F.substring(norm, 1, 2), F.lit("00"))
    rest = F.aggregate(_chars(whole), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substring(norm, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), text)


def _ip6(digest: Column, norm: Column) -> Column:
    """Other hexadecimal digits behind the first group, none of them a 0 at the start of a group."""
    def one(c: Column, i: Column) -> Column:
        first = F.substring(norm, i, F.lit(1)) == ":"
        return F.when(c == ":", c).when(first, _pick("123456789abcdef", _byte(digest, i))).otherwise(_pick("0123456789abcdef", _byte(digest, i)))

    kept = F.instr(norm, ":") - 1
    return F.array_join(F.transform(_chars(norm), lambda c, i: F.when(i < kept, c).otherwise(one(c, i))), "")


def surrogate(secret: str, kind: Column, norm: Column, tries: Column, gender: Column | None = None) -> Column:
    """The replacement of an entity in its normal form."""
    label = F.concat_ws("/", kind, tries.cast("string"))
    d = _digest(secret, label, norm)
    ip = _walked(norm, _ip_step(secret, label), _ip_form)
    top = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    # later draws have letters more
    longer = F.array_join(F.transform(F.slice(F.array(*[F.lit(i) for i in range(DRAWS)]), F.lit(1), F.greatest(tries - 1, F.lit(0))), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _byte(d, i + 40))), "")
    email = F.concat(longer, _recoded(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), d), top)
    body = F.concat(F.substring(norm, 1, 1), _permuted(secret, F.concat(label, F.substring(norm, 1, 1)), F.substring(norm, F.lit(2), F.length(norm) - 2)))
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    phone = _walked(norm, lambda x: _permuted(secret, label, x), _phone_form)
    ssn = _walked(norm, lambda x: _permuted(secret, label, x), _ssn_form)
    return F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", _iban(secret, label, norm)).when(kind == "ssn", ssn).when(kind == "ip6", _ip6(d, norm)).when(kind == "word", _name(d, norm, F.lit("n") if gender is None else gender, tries))


def in_form(kind: Column, found: Column, replacement: Column) -> Column:
    """The replacement in the form of an occurrence: its separators, its case, its title, its country's code."""
    digits = _digits(found)
    before = F.when(kind == "phone", F.length(digits) - F.length(replacement)).otherwise(0)  # code and trunk 0 stay

    def placed(keep: str) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

        def step(acc: Column, c: Column) -> Column:
            own = c.rlike(keep)
            new = F.when(acc["n"] < before, c).otherwise(F.substring(replacement, acc["n"] + 1 - before, F.lit(1)))
            return F.struct(F.concat(acc["out"], F.when(own, new).otherwise(c)).alias("out"), (acc["n"] + own.cast("int")).alias("n"))

        return F.aggregate(_chars(found), start, step, lambda acc: acc["out"])

    shout = lambda x, name: F.when(F.upper(name) == name, F.upper(x)).otherwise(x)
    titles = F.regexp_extract(found, rf"^({_ANY_TITLES})", 1)
    person = F.concat(titles, shout(replacement, F.substring(found, F.length(titles) + 1, F.length(found))))
    return F.when(replacement.startswith("["), replacement).when(kind.isin("email", "ip6"), shout(replacement, found)).when(kind == "ip", replacement).when(kind == "person", person).when(kind == "iban", placed("^[A-Z0-9]$")).otherwise(placed("^[0-9]$"))


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, norm, replacement for all different entities: no replacement serves two, and none is an entity itself.

    A draw that fails is repeated for the entities that failed alone, DRAWS times at most. What then has no replacement, as
    its form has too few free values, gets a tag: its kind and 16 hexadecimal digits of its keyed digest, in brackets.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    known = entities.where("kind is not null and norm is not null")
    if "gender" not in entities.columns:
        known = known.withColumn("gender", F.lit("n"))
    # a word's gender is the one that more of its titles tell
    tells = F.sum((F.col("gender") == "m").cast("int")) - F.sum((F.col("gender") == "f").cast("int"))
    real = stored(known.groupBy("kind", "norm").agg(F.when(tells > 0, "m").when(tells < 0, "f").otherwise("n").alias("gender")), "entities")
    occurs = real.select("kind", F.col("norm").alias("replacement")).distinct()
    todo, taken = real, None
    for n in range(DRAWS):
        drawn = stored(todo.withColumn("replacement", surrogate(secret, F.col("kind"), F.col("norm"), F.lit(n), F.col("gender"))), "drawn")
        # of those that drew one value, the smallest keeps it
        free = drawn.groupBy("kind", "replacement").agg(F.min("norm").alias("norm")).join(occurs, ["kind", "replacement"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "replacement"), ["kind", "replacement"], "left_anti")
        free = stored(free.select("kind", "norm", "replacement"), "surrogates")
        taken = free if taken is None else taken.unionAll(free)
        todo = stored(todo.join(free, ["kind", "norm"], "left_anti"), "again")
        if todo.isEmpty():
            return taken
    return taken.unionAll(todo.select("kind", "norm", F.concat(F.lit("["), F.col("kind"), F.lit("-"), F.substring(_digest(secret, F.lit("tag"), F.col("kind"), F.col("norm")), 1, 16), F.lit("]"))))


def _units(kind: Column, norm: Column) -> Column:
    """The entities whose replacements make up that of an entity: itself, or the words of a name. A word is one entity wherever it
    stands, so that a full name, its parts and the surname alone stay one person; given names bring the title's gender."""
    words = F.split(F.substring(norm, F.lit(3), F.length(norm)), r"[ \-]")
    keyed = F.transform(words, lambda w, i: F.struct(F.lit("word").alias("kind"), w.alias("norm"), F.when(i < F.size(words) - 1, F.substring(norm, 1, 1)).otherwise("n").alias("gender")))
    return F.when(kind == "person", keyed).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), F.lit("n").alias("gender"))))


def _genitives(parts: DataFrame) -> DataFrame:
    """Parts with a column ending: a word that is another one with an s is that one, and an s."""
    words = parts.where("kind = 'word'").select("norm").distinct()
    ends = words.where(F.col("norm").endswith("s") & (F.length("norm") > 3)).select("norm", F.expr("substring(norm, 1, length(norm) - 1)").alias("base"))
    ends = ends.join(words.select(F.col("norm").alias("base")), "base").withColumn("kind", F.lit("word"))
    return parts.join(ends, ["kind", "norm"], "left").withColumn("ending", F.when(F.col("base").isNotNull(), "s").otherwise("")).withColumn("norm", F.coalesce("base", "norm")).drop("base")


def _named(cut: Column) -> Column:
    """A cut text, cut again at its persons' names where they stand without a title: whole names and their words."""
    title = rf"^({_ANY_TITLES})"
    persons = F.filter(cut, lambda x, i: (i % 2 == 1) & x.rlike(title))
    names = F.transform(persons, lambda x: F.regexp_replace(x, title, ""))
    words = F.array_distinct(F.concat(names, F.filter(F.flatten(F.transform(names, lambda x: F.split(x, "[ -]"))), lambda w: F.length(w) > 1)))
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: F.concat(F.lit("\\Q"), x["w"], F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?<![\p{L}\d])(?=\p{Lu})(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\d])"))

    def again(t: Column, p: Column) -> Column:
        return F.flatten(F.zip_with(F.regexp_extract_all(t, p, F.lit(0)), F.split(t, p, -1), lambda e, x: F.when(e.isNull(), F.array(x)).otherwise(F.array(x, e))))

    # a lambda's argument is worked out once
    once = F.get(F.transform(F.array(pattern), lambda p: F.flatten(F.transform(cut, lambda t, i: F.when(i % 2 == 0, again(t, p)).otherwise(F.array(t))))), 0)
    return F.when(F.exists(cut, lambda x: x.rlike(title)), once).otherwise(cut)


def _pieces(c: Column) -> Column:
    """The text cut at its entities: text, entity, text, ..., text. One pass marks them."""
    marked = F.regexp_replace(c, F.when(F.instr(c, "@") > 0, F.lit(ANY)).otherwise(F.lit(ANY_BUT_EMAIL)), f"{MARK}$0{MARK}")
    two = F.concat(F.flatten(F.zip_with(F.regexp_extract_all(c, F.lit(ANY), F.lit(0)), F.split(c, ANY, -1), lambda e, t: F.when(e.isNull(), F.array(t)).otherwise(F.array(t, e)))))
    return F.when(F.instr(c, MARK) > 0, two).otherwise(F.split(marked, MARK, -1))


def pseudonymised(docs: DataFrame, secret: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with every entity of a text replaced, and `count`, the number of replaced occurrences.

    Rows without entities, null and empty texts included, pass unchanged. Repeated rows get equal replacements, and so do
    equal entities of different rows; of entities that draw one replacement, the smallest keeps it. `count` replaces a
    column of that name; no other column changes. Whole texts are searched. An empty key is refused.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    c = F.col(f"`{text}`")
    columns = [x for x in docs.columns if x.lower() != count.lower()]
    row, cut = free_name(docs, "row_"), free_name(docs, "found_")
    own = [F.col(f"`{x}`") for x in columns]
    # stored, so that the pattern runs over each text once; row numbers are those of the written table
    marked = stored(docs.select(*own, F.when(c.rlike("[0-9@\\p{Lu}]"), _pieces(c)).alias(cut)).select(*own, F.when(F.size(cut) > 1, _named(F.col(cut))).alias(cut), F.monotonically_increasing_id().alias(row)), "pii")
    clean = marked.where(F.col(cut).isNull()).select(*own, F.lit(0).cast("long").alias(count))
    hit = marked.where(F.col(cut).isNotNull())
    each = hit.select(row, F.posexplode(cut).alias("pos", "found")).where("pos % 2 = 1")
    kinds = each.select("found").distinct().withColumn("kind", kind_of(F.col("found"))).withColumn("norm", normal(F.col("kind"), F.col("found")))
    kinds = stored(kinds.where("norm is not null"), "found")
    parts = kinds.select("found", F.col("kind").alias("whole"), F.posexplode(_units(F.col("kind"), F.col("norm"))).alias("place", "u")).select("found", "whole", "place", "u.*")
    parts = stored(_genitives(parts), "parts")
    given = parts.join(surrogates(parts, secret), ["kind", "norm"])
    spelt = F.when((F.col("kind") == "word") & ~F.col("replacement").startswith("["), F.concat(F.initcap("replacement"), "ending")).otherwise(F.col("replacement"))
    joined = given.groupBy("found", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", spelt.alias("r")))), lambda x: x["r"]), " ").alias("replacement"))
    replaced = stored(joined.select("found", in_form(F.col("whole"), F.col("found"), F.col("replacement")).alias("new")), "replacements")
    lists = each.join(replaced, "found", "left").groupBy(row).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "found").alias("new")))).alias("news"), F.count("new").alias(count))
    around = F.filter(F.col(cut), lambda _, i: i % 2 == 0)
    whole = F.array_join(F.flatten(F.zip_with(around, F.col("news"), lambda p, x: F.array(p, F.coalesce(x["new"], F.lit(""))))), "")
    done = hit.join(lists, row).select(*[whole.alias(x) if x == text else F.col(f"`{x}`") for x in columns], F.col(count))
    return clean.unionByName(done)


def configured_key(spark: SparkSession) -> str:
    """The key of spark.lorekeep.pii.key or LOREKEEP_PII_KEY. Without either, a new one: what it gives cannot be linked to
    any other run, nor be inverted by anyone."""
    return spark.conf.get("spark.lorekeep.pii.key", "") or os.environ.get("LOREKEEP_PII_KEY") or secrets.token_hex(32)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, configured_key(spark)).select("doc_id", "text", "n_entities")
