"""Keyed surrogates for personal data, with DataFrame operations only.

Entities: e-mail addresses, telephone numbers, IPv4 addresses, card numbers (with a right check digit), social
security numbers, IBANs and names after one of the titles below, which further titles may follow ("Herr Prof. Dr. Weber") and small words
like "van der" precede. Titles in lower case, numbers without a country code or the separators of PHONE, and names without
any title in their text aren't found. One pattern finds them all, so spans don't overlap.

Where a text has a name with a title, it is replaced wherever else that text has it: whole, as given name and surname, or one of these alone (of three letters
or more), as it was written or in capitals. The rest of the text stays as it is.

A surrogate is made from a keyed digest of the
entity's normal form, so an entity has the same surrogate wherever and in whatever
formatting it occurs. It keeps type and format: separators, country codes, lengths, right check digits (cards, IBANs; a wrong one
of an IBAN stays wrong), titles and their gender, small words, the script of letters, hyphens and apostrophes of names, and names in
capitals. Surrogates of social security numbers begin with 9, as no real one does: beyond some ten million distinct numbers they collide more often
than attempts allow, and the job ends with an error; so it does for any kind that runs out.

A name is made of parts that are entities of their own: its surname, the person (gender, given name, surname), and the whole name
where there are names between. Surnames are settled first, persons with the surnames that they got, whole names last. So "Mr. Ann B.
Weil", "Mr. Ann Weil" and "Mr. Weil" stay together, families stay distinct, and so do their members.

Collision check: the distinct entities of all texts (small rows, summed before the shuffle) are
grouped by surrogate. Where two share one, or a surrogate is itself an entity of the texts, all
but the least get the next digest, until none collides. Only then, and only by text key,
are those exceptions joined to the texts.

The key is the caller's: whoever knows it can tell which surrogate an entity has.

Defined results: null text stays null, empty text empty; texts without entities
are unchanged; repeated rows stay repeated; an empty table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import written

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|(?<![\p{L}\p{N}.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
SSN = r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
#: Titles, and the gender they tell.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
#: Titles that may follow, and small words before a surname.
FURTHER = "Dr|Prof|Professor|Professorin|Doktor|Doctor|Docteur|Doctora|Doctor|Dra|Dipl|Ing|med|phil|jur|rer|nat|Sir|Lord|Lady|Baron|Graf|Don|Doña"
SMALL = "van|von|vom|de|der|den|del|della|di|da|dos|das|du|la|le|zu|zum|zur|ter|ten"
TITLES = "(?:" + "|".join(FEMALE + MALE) + rf")\.? (?:(?:{FURTHER})(?:\.-|\.? ))*+"
WORD = rf"(?:(?:{SMALL}) )*+\p{{Lu}}[\p{{L}}'’\-]*+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLES}(?:\p{{Lu}}\. (?=\p{{Lu}}))?{WORD}(?:(?: \p{{Lu}}\.(?= \p{{Lu}}))? {WORD}(?!\.\p{{L}})){{0,2}}"
ENTITY = "|".join([EMAIL, IP, SSN, CARD, PHONE, IBAN, NAME])
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Emma", "Irene", "Julia", "Laura", "Marta", "Nina", "Olivia", "Paula", "Rosa", "Sara", "Sofia", "Teresa", "Vera"],
    ("m", "latin"): ["Adam", "Daniel", "David", "Felix", "Hugo", "Jonas", "Leo", "Lucas", "Martin", "Oscar", "Paul", "Robert", "Samuel", "Simon", "Thomas", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("m", "cyrillic"): ["Антон", "Виктор", "Даниил", "Иван", "Максим", "Олег", "Пётр", "Роман"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Σοφία"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Μιχάλης", "Νίκος", "Πέτρος"],
}
#: Syllables of invented surnames: consonant and vowel for each hexadecimal digit pair.
CONSONANTS, VOWELS = {"latin": "bdfghklmnprstvwz", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ"}, {"latin": "aeio", "cyrillic": "аеио", "greek": "αειο"}
HEX = "0123456789abcdef"
MAX_ATTEMPTS = 64
#: Texts with entities that needed further attempts, up to which these are sent to all executors.
MOST_SENT = 65_536
SEP = "\u001f"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(x: Column) -> Column:
    """The kind of what the pattern found; null for a long number that isn't a card's."""
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(x.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(x.rlike(r"^\p{L}"), "name")
        .when(x.rlike(r"^\d(?:[ \-]?\d){12,18}$"), F.when(let(F.regexp_replace(x, r"\D", ""), lambda n: luhn(F.substr(n, F.lit(1), F.length(n) - 1)) == F.right(n, F.lit(1))), "card"))
        .otherwise("phone")
    )


def bare_name(x: Column) -> Column:
    return F.regexp_replace(x, "^" + TITLES, "")


def core(bare: Column) -> Column:
    """A name without its small words."""
    return F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}])(?:{SMALL}) ", "")


def normal(kind: Column, x: Column) -> Column:
    return F.when(kind == "email", F.lower(x)).when(kind == "ip", x).when(kind == "iban", F.regexp_replace(x, " ", "")).when(kind == "name", F.lower(core(bare_name(x)))).otherwise(F.regexp_replace(x, r"\D", ""))


def gender(x: Column) -> Column:
    return F.when(F.regexp_extract(x, r"^\p{L}+", 0).isin(FEMALE), "f").otherwise("m")


def entries(kind: Column, x: Column) -> Column:
    """(kind, norm, plain) of the entities that x stands for; plain is how another text would show it."""
    one = lambda k, n, p: F.struct(k.alias("kind"), n.alias("norm"), p.alias("plain"))

    def named(n: Column) -> Column:
        surname, given = F.substring_index(n, " ", -1), F.substring_index(n, " ", 1)
        words = F.size(F.split(n, " "))
        parts = [
            one(F.lit("surname"), surname, surname),
            F.when(words > 1, one(F.lit("person"), F.concat_ws(" ", gender(x), given, surname), F.concat_ws(" ", given, surname))),
            F.when(words > 2, one(F.lit("name"), F.concat_ws(" ", gender(x), n), n)),
        ]
        return F.filter(F.array(*parts), lambda e: e.isNotNull())

    return let(normal(kind, x), lambda n: F.when(kind == "name", named(n)).otherwise(F.array(one(kind, n, n))))


def digest(key: str, kind: Column | str, value: Column, attempt: Column | int) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    return F.sha2(F.concat_ws(SEP, F.lit(key), kind, value, attempt.cast("string")), 256)


def digits_of(d: Column) -> Column:
    return F.translate(d, "abcdef", "246813")


def fill(x: Column, letters: Column, digits: Column) -> Column:
    """x with its n-th digit or letter replaced by the n-th digit or letter given; case and other signs are kept, and don't count."""

    def step(a: Column, c: Column) -> Column:
        at = F.pmod(a.i, F.lit(64)) + 1
        letter = F.substr(letters, at, F.lit(1))
        new = F.when(c.rlike(r"\d"), F.substr(digits, at, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)
        return F.struct(F.concat(a.out, new).alias("out"), (a.i + c.rlike(r"[\p{L}\d]").cast("int")).alias("i"))

    return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda a: a.out)


def put_digits(x: Column, digits: Column) -> Column:
    """x with its n-th digit replaced by the n-th of `digits`."""

    def step(a: Column, c: Column) -> Column:
        isd = c.rlike(r"\d")
        return F.struct(F.concat(a.out, F.when(isd, F.substr(digits, a.i + 1, F.lit(1))).otherwise(c)).alias("out"), (a.i + isd.cast("int")).alias("i"))

    return F.aggregate(F.split(x, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda a: a.out)


def luhn(body: Column) -> Column:
    """The check digit of a number without it."""

    def step(a: Column, c: Column) -> Column:
        twice = c.cast("int") * (2 - a.i % 2)
        return F.struct((a.s + F.floor(twice / 10).cast("int") + twice % 10).alias("s"), (a.i + 1).alias("i"))

    return F.aggregate(F.reverse(F.split(body, "")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), step, lambda a: ((10 - a.s % 10) % 10).cast("string"))


def card(x: Column, n: Column, d: Column) -> Column:
    short = F.length(n) - 1
    body = let(d, lambda h: F.concat(F.substr(n, F.lit(1), F.lit(1)), F.substr(digits_of(h), F.lit(1), short - 1)))
    valid = luhn(F.substr(n, F.lit(1), short)) == F.right(n, F.lit(1))
    last = lambda b: F.when(valid, luhn(b)).otherwise(((luhn(b).cast("int") + 1) % 10).cast("string"))
    return put_digits(x, let(body, lambda b: F.concat(b, last(b))))


def phone(x: Column, n: Column, d: Column) -> Column:
    country = F.regexp_replace(F.regexp_extract(x, r"^\+(\d{1,3})(?=[ .\-(])", 1), r"\D", "")
    return put_digits(x, F.concat(country, F.translate(F.substr(digits_of(d), F.lit(1), F.lit(1)), "01", "23"), F.substr(digits_of(d), F.lit(2), F.lit(40))))


def ip(d: Column) -> Column:
    octet = lambda i: (F.conv(F.substr(d, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int") % 254 + 1).cast("string")
    return F.concat_ws(".", *[octet(i) for i in range(4)])


def email(key: str, x: Column, d: Column, attempt: Column) -> Column:
    local = F.substring_index(x, "@", 1)
    host = digest(key, "host", F.lower(F.substring_index(x, "@", -1)), 0)
    letters = F.translate(d, HEX, CONSONANTS["latin"])
    # Short names soon run out of surrogates of their length; later attempts are longer.
    more = F.when(attempt > 0, F.concat(F.lit("."), F.substr(letters, F.lit(33), F.lit(8)))).otherwise("")
    return F.concat(fill(local, letters, digits_of(d)), more, F.lit("@h"), F.substr(host, F.lit(1), F.lit(10)), F.lit(".example.net"))


def script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def by_script(n: Column, of: dict[str, str]) -> Column:
    """The text for the script that n is written in."""
    x = script(n)
    return F.when(x == "cyrillic", of["cyrillic"]).when(x == "greek", of["greek"]).otherwise(of["latin"])


def syllables(d: Column, n: Column, like: Column) -> Column:
    """n syllables in the script of `like` from a digest, the first letter upper-case."""
    spelt = lambda of, i: F.call_function("translate", F.substr(d, i, F.lit(1)), F.lit(HEX), by_script(like, of))
    vowels = {k: v * 4 for k, v in VOWELS.items()}
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(spelt(CONSONANTS, 2 * i + 1), spelt(vowels, 2 * i + 2))), ""))


def new_surname(key: str, surname: Column, attempt: Column) -> Column:
    """Four syllables; more in later attempts, so that there is room for any number of families. Hyphens and apostrophes are where the surname has its first."""
    made = syllables(digest(key, "surname", surname, attempt), 4 + F.least(attempt, F.lit(8)), surname)
    other = syllables(digest(key, "second surname", surname, attempt), F.lit(2), surname)
    marked = F.when(surname.rlike(r"^\p{L}['’]"), F.concat(F.left(other, F.lit(1)), F.substr(surname, F.lit(2), F.lit(1)), made)).otherwise(made)
    return F.concat(marked, F.when(surname.contains("-"), F.concat(F.lit("-"), other)).otherwise(""))


def new_given(key: str, person: Column, attempt: Column) -> Column:
    """A given name for a person (gender, given name, surname). The lists are short; later attempts have a second, invented one."""
    at = F.conv(F.substr(digest(key, "given", person, attempt), F.lit(1), F.lit(8)), 16, 10).cast("long")
    names = {g: by_script(F.substr(person, F.lit(3)), {s: " ".join(x) for (of, s), x in GIVEN.items() if of == g}) for g in "fm"}
    first = let(F.split(F.when(F.left(person, F.lit(1)) == "f", names["f"]).otherwise(names["m"]), " "), lambda a: F.get(a, (at % F.size(a)).cast("int")))
    second = F.concat(F.lit("-"), syllables(digest(key, "second", person, attempt), 1 + F.least(attempt, F.lit(8)), F.substr(person, F.lit(3))))
    return F.concat(first, F.when((attempt > 0) | F.get(F.split(person, " "), F.lit(1)).contains("-"), second).otherwise(""))


def new_middle(key: str, whole: Column, attempt: Column) -> Column:
    """An initial for the names between; a short word in later attempts."""
    word = syllables(digest(key, "middle", whole, attempt), 1 + F.least(attempt, F.lit(8)), F.substr(whole, F.lit(3)))
    return F.when(attempt > 0, word).otherwise(F.concat(F.left(word, F.lit(1)), F.lit(".")))


def capitals(like: Column, made: Column) -> Column:
    """`made` in capitals where `like` is, and has more than one letter."""
    return F.when((F.upper(like) == like) & like.rlike(r"\p{Lu}['’\-]?\p{Lu}"), F.upper(made)).otherwise(made)


def forms(key: str, x: Column, n: Column, tries) -> Column:
    """(whole, short, last, given) of a name in the parts' surrogates, short without what is between; `tries` gives the attempt of a part by kind and norm."""
    bare = bare_name(x)
    words = F.size(F.split(n, " "))
    surname, person, whole = F.substring_index(n, " ", -1), F.concat_ws(" ", gender(x), F.substring_index(n, " ", 1), F.substring_index(n, " ", -1)), F.concat_ws(" ", gender(x), n)
    given = F.when(words > 1, F.concat(let(tries("person", person), lambda a: new_given(key, person, a)), F.lit(" "))).otherwise("")
    middle = F.when(words > 2, F.concat(let(tries("name", whole), lambda a: new_middle(key, whole, a)), F.lit(" "))).otherwise("")
    small = F.regexp_extract(bare, rf"(?<![\p{{L}}\p{{N}}'’\-])((?:(?:{SMALL}) )*)[\p{{L}}'’\-]+$", 1)
    last = let(tries("surname", surname), lambda a: new_surname(key, surname, a))
    parts = F.struct(given.alias("given"), middle.alias("middle"), last.alias("last"))
    put = lambda p: F.struct(F.concat(p.given, p.middle, small, p.last).alias("whole"), F.concat(p.given, small, p.last).alias("short"), p.last.alias("last"), F.rtrim(p.given).alias("given"))
    styled = lambda f: F.struct(*[capitals(bare, f[c]).alias(c) for c in ("whole", "short", "last", "given")])
    return let(let(parts, put), styled)


def name(key: str, x: Column, n: Column, tries) -> Column:
    """A name in the parts' surrogates, with its titles."""
    return F.concat(F.regexp_extract(x, "^" + TITLES, 0), forms(key, x, n, tries)["whole"])


def mentions(key: str, names: Column, tries) -> Column:
    """(said, new) of all ways in which a text may mention its names without a title, the longest first."""

    def of(x: Column) -> Column:
        bare, n = bare_name(x), normal(F.lit("name"), x)

        def pairs(f: Column) -> Column:
            one = lambda said, new: F.struct(F.length(said).alias("size"), said.alias("said"), new.alias("new"))
            last = F.regexp_extract(bare, r"[\p{L}'’\-]+$", 0)
            short = F.concat(F.regexp_extract(bare, r"^[\p{L}'’\-]+\.? ", 0), F.regexp_extract(bare, rf"(?<![\p{{L}}\p{{N}}'’\-])((?:(?:{SMALL}) )*[\p{{L}}'’\-]+)$", 1))
            first = F.when(f.given != "", F.regexp_extract(bare, r"^[\p{L}'’\-]+(?= )", 0)).otherwise("")
            ways = [(bare, f.whole), (short, f.short), (last, f.last), (first, f.given)]
            # Bound, since the optimizer would push a bare upper() into the branches and take that of the constant '' in the driver, where
            # the first use of ICU's case mappings makes 3 GB of garbage.
            ways += [(let(a, F.upper), let(b, F.upper)) for a, b in ways]
            return F.array(*[one(a, b) for a, b in ways])

        return let(forms(key, x, n, tries), pairs)

    every = F.filter(F.array_distinct(F.flatten(F.transform(names, of))), lambda m: (m["size"] > 2) & m.said.rlike(r"^\p{L}+.*\p{L}"))
    return F.reverse(F.array_sort(every))


def with_mentions(text: Column, known: Column) -> Column:
    """The text with all that `known` (said, new) says replaced."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(known, lambda m: F.concat(F.lit("\\Q"), m.said, F.lit("\\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    new = lambda x: F.get(F.filter(known, lambda m: m.said == x), F.lit(0)).new
    put = lambda p: F.concat_ws("", F.zip_with(F.split(text, p, -1), F.transform(F.regexp_extract_all(text, p, F.lit(0)), new), lambda between, x: F.concat(between, F.coalesce(x, F.lit("")))))
    return F.when(F.size(known) > 0, let(pattern, put)).otherwise(text)


def remainder(bban: Column, country: Column, check: Column) -> Column:
    """An IBAN's number modulo 97; letters count as two digits."""
    value = lambda c: F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike(r"\d"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(F.concat(bban, country, check), ""), F.lit(0), step)


def iban(x: Column, n: Column, d: Column) -> Column:
    """Country, spaces and lengths stay; the check digits are right if they were."""
    country = F.left(n, F.lit(2))
    valid = remainder(F.substr(n, F.lit(5)), country, F.substr(n, F.lit(3), F.lit(2))) == 1
    rest = fill(F.substr(x, F.lit(5)), F.translate(d, HEX, CONSONANTS["latin"]), digits_of(d))

    def checked(r: Column) -> Column:
        right = 98 - remainder(F.regexp_replace(r, " ", ""), country, F.lit("00"))
        return F.concat(country, F.lpad(F.when(valid, right).otherwise(right % 97 + 1).cast("string"), 2, "0"), r)

    return let(rest, checked)


def number(key: str, x: Column, kind: Column, n: Column, attempt: Column) -> Column:
    """The surrogate of anything but a name."""

    def made(d: Column) -> Column:
        return (
            F.when(kind == "email", email(key, x, d, attempt))
            .when(kind == "ip", ip(d))
            .when(kind == "card", card(x, n, d))
            .when(kind == "phone", phone(x, n, d))
            .when(kind == "ssn", put_digits(x, F.concat(F.lit("9"), digits_of(d))))
            .otherwise(iban(x, n, d))
        )

    return let(digest(key, kind, n, attempt), made)


def surrogate(key: str, x: Column, kind: Column, n: Column, tries) -> Column:
    """The surrogate of x; `tries` gives the attempt of an entity by kind and norm."""
    return F.when(kind == "name", name(key, x, n, tries)).otherwise(let(tries(kind, n), lambda a: number(key, x, kind, n, a)))


def found_in(text: Column) -> Column:
    """All that the pattern finds in a text, in order. Texts without a digit, an @ or a title are passed over at once."""
    hint = text.rlike("[0-9@]")
    for t in FEMALE + MALE:
        hint = hint | text.contains(t + " ") | text.contains(t + ".")
    return F.when(hint, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def every_entry(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """(kind, norm, plain, x) of all that is found, x being one way of writing it."""
    x = docs.select(*more, F.explode(found_in(F.col(f"`{text_col}`"))).alias("x")).withColumn("kind", kind_of(F.col("x"))).where("kind is not null")
    return x.withColumn("e", F.explode(entries(F.col("kind"), F.col("x")))).drop("kind").select("*", "e.*").drop("e")


def settled(spark: SparkSession, known: DataFrame, new: Column) -> DataFrame:
    """(kind, norm, attempt) of rows (kind, norm, plain, ...), with attempts under which all `new` differ and none is a plain form."""
    real = known.select("kind", F.col("plain").alias("new"), F.lit(True).alias("real")).distinct()
    now = known.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        made = written(spark, now.withColumn("new", new), "surrogates")  # read twice
        first = made.groupBy("kind", "new").agg(F.min(F.struct(F.col("attempt") == 0, "norm")).alias("first"), F.count("*").alias("n"))
        told = made.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        again = told.withColumn("clash", F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.col("first.norm") != F.col("norm"))))
        now = written(spark, again.select(*known.columns, (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"), "clash"), "entities")
        if now.where("clash").isEmpty():
            return now.select("kind", "norm", "attempt")
        now = now.drop("clash")
    raise ValueError(f"entities still collide after {MAX_ATTEMPTS} attempts")


def collisions(spark: SparkSession, docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(kind, norm, attempt) of the entities that need another digest than the first."""
    every = written(spark, every_entry(docs, text_col).groupBy("kind", "norm").agg(F.min("plain").alias("plain"), F.min("x").alias("x")), "entities")
    norm, attempt = F.col("norm"), F.col("attempt")
    others = settled(spark, every.where("kind not in ('surname', 'person', 'name')"), normal(F.col("kind"), number(key, F.col("x"), F.col("kind"), norm, attempt)))
    surnames = every.where("kind = 'surname'").select("kind", "norm", "plain")
    if surnames.isEmpty():
        return others.where("attempt > 0")
    families = settled(spark, surnames, F.lower(new_surname(key, norm, attempt)))
    taken = families.select(norm.alias("surname"), F.col("attempt").alias("surname_attempt"))
    last = new_surname(key, F.col("surname"), F.col("surname_attempt"))
    people = every.where("kind = 'person'").select("kind", "norm", "plain", F.substring_index("norm", " ", -1).alias("surname")).join(taken, "surname")
    people = settled(spark, people.select("kind", "norm", "plain", "surname", "surname_attempt"), F.lower(F.concat_ws(" ", new_given(key, norm, attempt), last)))
    first = people.select(norm.alias("person"), F.col("attempt").alias("person_attempt"))
    whole = every.where("kind = 'name'").select("kind", "norm", "plain", F.substring_index("norm", " ", -1).alias("surname"))
    whole = whole.withColumn("person", F.concat_ws(" ", F.substring_index("norm", " ", 2), "surname")).join(taken, "surname").join(first, "person")
    whole = settled(spark, whole.select("kind", "norm", "plain", "surname", "surname_attempt", "person", "person_attempt"), F.lower(F.concat_ws(" ", new_given(key, F.col("person"), F.col("person_attempt")), new_middle(key, norm, attempt), last)))
    return others.union(families).union(people).union(whole).where("attempt > 0")


def pseudonymised(spark: SparkSession, docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with `row` (all columns as they were), `found` (entities) and `safe` (the new text)."""
    late = written(spark, collisions(spark, docs, key, text_col), "late")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t")).withColumn("every", found_in(F.col("t")))
    if late.isEmpty():
        rows = rows.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        # Few texts hold such entities. Their table is written and counted before the texts are joined to it: up to a bound it is
        # broadcast, and no text is shuffled.
        seen = every_entry(docs, text_col, F.md5(text).alias("th")).select("th", "kind", "norm")
        seen = seen.join(late, ["kind", "norm"]).distinct()
        hit = seen.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(SEP, "kind", "norm"), "attempt"))).alias("attempts"))
        hit = written(spark, hit, "attempts")
        hit = F.broadcast(hit) if hit.count() <= MOST_SENT else hit
        rows = rows.withColumn("th", F.md5("t")).join(hit, "th", "left").drop("th")

    def tries(kind: Column | str, n: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.coalesce(F.get(F.transform(F.array(F.col("attempts")), lambda m: m[F.concat_ws(SEP, kind, n)]), F.lit(0)), F.lit(0))

    def replaced(x: Column) -> Column:
        return let(kind_of(x), lambda kind: F.when(kind.isNull(), x).otherwise(let(normal(kind, x), lambda n: surrogate(key, x, kind, n, tries))))

    safe = F.concat_ws("", F.zip_with(F.split("t", ENTITY, -1), F.transform("every", replaced), lambda between, new: F.concat(between, F.coalesce(new, F.lit("")))))
    rows = rows.select("row", "t", "attempts", F.when(F.size("every") > 0, safe).otherwise(F.col("t")).alias("safe"), F.filter("every", lambda x: kind_of(x).isNotNull()).alias("found"))
    names = F.filter("found", lambda x: kind_of(x) == "name")
    known = F.when(F.exists("found", lambda x: kind_of(x) == "name"), mentions(key, names, tries)).otherwise(F.expr("CAST(array() AS array<struct<size: int, said: string, new: string>>)"))
    return rows.withColumn("known", known).select("row", "t", with_mentions(F.col("safe"), F.col("known")).alias("safe"), "found")


def safe_documents(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """`docs` with its text made safe; n_chars, where there is one, follows the new text."""
    out = pseudonymised(spark, docs, key)
    cols = [F.col("safe").alias("text") if c == "text" else F.length("safe").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols)
