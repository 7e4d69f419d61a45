"""Personal data: detected entities receive keyed, type-consistent surrogates.

Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

# Titles and given names by the gender that they tell (f, m, or n for neither).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "n": ["Dr"],
}
GIVEN = {
    "f": [
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Maria", "Marie", "Sophie", "Claire", "Julie", "Isabelle", "Nathalie",
        "Laura", "Carmen", "María", "Lucía", "Elena", "Katharina", "Julia", "Monika", "Ursula", "Sabine", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна",
    ],
    "m": [
        "John", "James", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Peter", "Paul", "Pierre", "Jean", "Michel", "Philippe", "Nicolas", "Juan",
        "José", "Carlos", "Luis", "Miguel", "Antonio", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Михаил",
    ],
}
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? "
_GIVEN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ") "
_NAME = r"\p{Lu}[\p{L}'-]{1,40}+"

#: Fixed patterns by type, tried in this order at every place.  Every repetition is
#: bounded and every start is anchored by a look-behind, so time stays linear.
_W = r"\p{L}\p{N}"
PATTERNS = (
    ("email", rf"(?<![{_W}._%+-])[{_W}._%+-]{{1,64}}+@[{_W}-]{{1,63}}+(?:\.[{_W}-]{{1,63}}+){{1,8}}+"),
    ("secret", r"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{32,128}+)|(?:[0-9A-F]{32,128}+)|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}+)(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9+])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("person", rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{_TITLE}{_NAME}(?: {_NAME})?|{_GIVEN}{_NAME})"),
)
ANY = "|".join(p for _, p in PATTERNS)
#: A text without any of these holds no entity: a cheap test before the patterns.
MAYBE = rf"[0-9@]|sk-|AKIA|(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})\p{{Lu}}"

#: Fixed given names by script and gender, for surrogates.
NAMES = {
    "latin_f": ["Ada", "Bea", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Irma", "Jana", "Klara", "Lena", "Marta", "Nora", "Olga", "Petra"],
    "latin_m": ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Nils", "Oskar", "Paul"],
    "latin_n": ["Alex", "Andrea", "Chris", "Eden", "Jules", "Kim", "Luca", "Morgan", "Noa", "Quinn", "Robin", "Sacha", "Sam", "Sky", "Toni", "Val"],
    "cyrillic_f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
}
SYLLABLES = {
    "latin": ["ba", "be", "do", "fa", "ga", "hol", "ka", "lin", "mar", "ne", "po", "ra", "sen", "ta", "vo", "wen"],
    "cyrillic": ["ба", "ве", "до", "за", "ка", "лин", "мар", "не", "по", "ра", "сен", "та", "фо", "хол", "це", "шу"],
}
#: Attempts after which surrogates get longer, by one character each, until there is room.
ROOMY = 3


def entity_type(entity: Column) -> Column:
    """Name of the first pattern that matches the whole entity, or "other"."""
    out = F.lit("other")
    for name, pattern in reversed(PATTERNS):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _hex(h: Column, at: Column | int, n: int = 2) -> Column:
    """n hex digits of a 128-digit hash, as a number; positions wrap."""
    start = (at % 62) * 2 + 1 if isinstance(at, int) else (F.pmod(at, F.lit(62)) * 2 + 1).cast("int")
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(h.substr(start, F.lit(n)), 16, 10).cast("int")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _same_format(entity: Column, h: Column, keep: Column | None = None) -> Column:
    """Each digit becomes a digit, each letter one of its kind (hex stays hex); all else stays."""
    hexa = entity.rlike("^[0-9a-f]{32,}$") | entity.rlike("^[0-9A-F]{32,}$")
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = F.filter(F.split(entity, ""), lambda c: c != "")

    def swap(c: Column, i: Column) -> Column:
        v = _hex(h, i)
        at = lambda s, n: F.substr(F.lit(s), (F.pmod(v, F.lit(n)) + 1).cast("int"), F.lit(1))
        new = (
            F.when(hexa & c.rlike("[0-9a-f]"), at("0123456789abcdef", 16))
            .when(hexa & c.rlike("[0-9A-F]"), at("0123456789ABCDEF", 16))
            .when(c.rlike("[0-9]"), at(digits, 10))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), F.upper(_pick(list("абвгдезиклмнопрст"), v)))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(list("абвгдезиклмнопрст"), v))
            .when(c.rlike(r"\p{Lu}"), at(upper, 26))
            .when(c.rlike(r"\p{L}"), at(lower, 26))
            .otherwise(c)
        )
        return F.when(i < keep, c).otherwise(new) if keep is not None else new

    return F.array_join(F.transform(chars, swap), "")


def _luhn(number: Column) -> Column:
    """Sum of a card number's digits by the Luhn rule; separators are skipped."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^{_TITLE}", 0)


def units_of(entity: Column, kind: Column) -> Column:
    """What gets a surrogate of its own, as an array of (kind, space, unit).

    An email address is one whatever its case.  A person is a given name, where there are
    two, and a family name, so that "Mr. John Smith" and "Mr. Smith" share their family
    name's surrogate; a given name's kind tells gender, by the title or else the name.
    Surrogates are distinct within a space: given names, family names, all else.
    """
    title = _title(entity)
    names = F.split(entity.substr(F.length(title) + 1, F.length(entity)), " ")
    word = F.regexp_extract(title, r"^[^. ]+", 0)
    gender = F.lit("given_n")
    for g in ("m", "f"):
        gender = F.when(F.get(names, F.lit(0)).isin(GIVEN[g]), f"given_{g}").otherwise(gender)
    for g in ("m", "f"):
        gender = F.when(word.isin(TITLES[g]), f"given_{g}").otherwise(gender)
    unit = lambda k, space, u: F.struct(k.alias("kind"), F.lit(space).alias("space"), u.alias("unit"))
    family = unit(F.lit("family"), "family", F.element_at(names, -1))
    person = F.when(F.size(names) > 1, F.array(unit(gender, "given", F.get(names, F.lit(0))), family)).otherwise(F.array(family))
    return F.when(kind == "person", person).when(kind == "email", F.array(unit(kind, "other", F.lower(entity)))).otherwise(F.array(unit(kind, "other", entity)))


def surrogate(unit: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement of one unit: a function of key, kind, unit and attempt; longer from attempt ROOMY on."""
    h = F.sha2(F.concat_ws("\n", F.lit(key), kind, attempt.cast("string"), unit), 512)
    extra = F.least(F.greatest(attempt - (ROOMY - 1), F.lit(0)), F.lit(40))
    more_digits = F.translate(h.substr(F.lit(80), extra), "abcdef", "012345")
    more_letters = F.translate(h.substr(F.lit(80), extra), "0123456789", "ghijklmnop")
    more_hex = F.when(unit.rlike("[A-Z]"), F.upper(h.substr(F.lit(80), extra))).otherwise(h.substr(F.lit(80), extra))
    plain = _same_format(unit, h)
    # a card that satisfied the Luhn rule still does: its last digit is made to fit
    number = F.concat(plain, more_digits)
    base = F.concat(number.substr(F.lit(1), F.length(number) - 1), F.lit("0"))
    card = F.when(_luhn(unit) % 10 == 0, F.concat(base.substr(F.lit(1), F.length(base) - 1), F.pmod(-_luhn(base), F.lit(10)).cast("string"))).otherwise(number)
    # an address keeps the end of its domain from the first dot on
    local = F.substring_index(unit, "@", 1)
    name_end = F.length(local) + 1 + F.length(F.substring_index(F.substring_index(unit, "@", -1), ".", 1))
    masked = _same_format(unit.substr(F.lit(1), name_end), h)
    email = F.concat(masked.substr(F.lit(1), F.length(local)), more_letters, masked.substr(F.length(local) + 1, name_end), unit.substr(name_end + 1, F.length(unit)))
    # there are four thousand million addresses; only when they run out does one get a port
    ip = F.concat(F.concat_ws(".", *[_hex(h, 4 * i).cast("string") for i in range(4)]), F.when(extra > 8, F.concat(F.lit(":"), more_digits)).otherwise(F.lit("")))
    phone = F.concat(_same_format(unit, h, F.when(unit.startswith("+"), F.length(F.regexp_extract(unit, r"^\+[0-9]{1,3}(?=[ .(-])", 0))).otherwise(F.lit(0))), more_digits)
    iban = F.concat(_same_format(unit, h, F.lit(2)), more_digits)
    cyr = unit.rlike(r"\p{IsCyrillic}")
    hashed = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("\n", h, i.cast("string")), 256), 1, 6), 16, 10).cast("int")
    # few given names exist: each attempt adds one more, with a hyphen
    one = lambda i: (
        F.when(cyr & (kind == "given_f"), _pick(NAMES["cyrillic_f"], hashed(i))).when(cyr, _pick(NAMES["cyrillic_m"], hashed(i)))
        .when(kind == "given_f", _pick(NAMES["latin_f"], hashed(i))).when(kind == "given_m", _pick(NAMES["latin_m"], hashed(i)))
        .otherwise(_pick(NAMES["latin_n"], hashed(i)))
    )
    given = F.array_join(F.transform(F.sequence(F.lit(0), attempt), one), "-")
    syllable = lambda i: F.when(cyr, _pick(SYLLABLES["cyrillic"], hashed(i))).otherwise(_pick(SYLLABLES["latin"], hashed(i)))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), extra + 3), syllable), ""))
    return (
        F.when(kind == "card", card).when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone)
        .when(kind == "iban", iban).when(kind == "family", family).when(kind.startswith("given"), given)
        .when(kind == "secret", F.concat(plain, more_hex)).when(kind == "ssn", F.concat(plain, more_digits)).otherwise(F.concat(plain, more_letters))
    )


def _settled(units: DataFrame, key: str) -> DataFrame:
    """(kind, space, unit, surrogate) of distinct units, no surrogate twice in a space and none a real unit.

    Collision check: of units with one surrogate the smallest keeps it, and the others, and
    those whose surrogate is a real unit, hash again with the next attempt, until no collision
    is left; surrogates get longer, so there is always room.  The check is a grouped count
    over distinct units, so nothing is collected.
    """
    kind, unit = F.col("kind"), F.col("unit")
    made = materialize(units.select("kind", "space", "unit", surrogate(unit, kind, key, F.lit(0)).alias("surrogate")), "surrogates")
    real = units.select(F.col("space").alias("rs"), F.col("unit").alias("ru")).distinct()
    attempt = 0
    while True:
        attempt += 1
        first = made.groupBy("space", "surrogate").agg(F.min(F.struct("unit", "kind")).alias("first"), F.count("*").alias("n"))
        held = first.join(real, (F.col("space") == F.col("rs")) & (F.col("surrogate") == F.col("ru")), "left").where((F.col("n") > 1) | F.col("ru").isNotNull())
        held = materialize(held.select(F.col("space").alias("hs"), F.col("surrogate").alias("s"), "first", F.col("ru").isNotNull().alias("taken")), "collisions")
        if held.isEmpty():
            return made
        joined = made.join(held, (F.col("space") == F.col("hs")) & (F.col("surrogate") == F.col("s")), "left")
        again = F.col("s").isNotNull() & (F.col("taken") | (F.struct("unit", "kind") != F.col("first")))
        new = materialize(joined.select("kind", "space", "unit", F.when(again, surrogate(unit, kind, key, F.lit(attempt))).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
        discard(made, held)
        made = new


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate) for distinct entities.

    Two entities have one surrogate only if they are spellings of one (an address in another
    case); no surrogate is a real entity, and none of its names is a real name.
    """
    real = entities.select("entity").distinct().select("entity", entity_type(F.col("entity")).alias("kind"))
    parts = real.select("entity", F.col("kind").alias("of"), F.posexplode(units_of(F.col("entity"), F.col("kind"))).alias("at", "u"))
    parts = materialize(parts.select("entity", "of", "at", "u.*"), "units")
    named = _settled(materialize(parts.select("kind", "space", "unit").distinct(), "distinct"), key)
    named = named.select(F.col("kind").alias("nk"), F.col("unit").alias("nu"), "surrogate")
    met = parts.join(named, (F.col("unit") == F.col("nu")) & (F.col("kind") == F.col("nk")))
    # two parts at most
    per = met.groupBy("entity", "of").agg(F.min_by("surrogate", "at").alias("head"), F.max_by("surrogate", "at").alias("tail"), F.count("*").alias("n"))
    person = F.concat(_title(F.col("entity")), F.when(F.col("n") > 1, F.concat_ws(" ", "head", "tail")).otherwise(F.col("tail")))
    return materialize(per.select("entity", F.col("of").alias("kind"), F.when(F.col("of") == "person", person).otherwise(F.col("head")).alias("surrogate")), "entities")


def pseudonymize(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text with surrogates, n_entities long, kinds array<string>.

    Equal entities get equal surrogates in all documents (coreference), different ones
    different surrogates; addresses are equal whatever their case, and people share what
    their names share.  People are found by a title, or a listed given name, before a
    capitalised name.  Only texts with entities are shuffled, once, to meet their
    surrogates; all others pass in a narrow scan.

    Edge cases: null text stays null; empty text stays empty; repeated rows stay (they
    are told apart by nothing and all rewritten); other columns are ignored; an
    empty table gives an empty result; very long texts are scanned once, in linear time.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ents = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    src = src.select("id", "text", ents.alias("ents"))
    found = materialize(src.where(F.size("ents") > 0), "found")
    none = src.where(F.col("text").isNull() | (F.size("ents") <= 0))
    spots = found.select("id", F.xxhash64("text").alias("t"), F.posexplode("ents").alias("pos", "entity"))
    named = surrogates(spots, key)
    met = spots.withColumn("e", F.xxhash64("entity")).join(named.select(F.col("entity").alias("ne"), F.xxhash64("entity").alias("e"), "kind", "surrogate"), "e").where(F.col("entity") == F.col("ne"))
    per = met.groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("pos", "surrogate", "kind"))).alias("s")).select(F.col("id").alias("pid"), F.col("t").alias("pt"), "s")
    joined = found.withColumn("t", F.xxhash64("text")).join(per, F.col("id").eqNullSafe(F.col("pid")) & (F.col("t") == F.col("pt")))
    joined = joined.select("id", F.split("text", ANY, -1).alias("parts"), "s", "ents")
    body = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("s.surrogate"), i), F.lit("")))), "")
    done = joined.select(F.col("id").alias(id_col), body.alias("text"), F.size("ents").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("s.kind")).alias("kinds"))
    rest = none.select(F.col("id").alias(id_col), "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return done.unionByName(rest)
