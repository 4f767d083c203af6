"""Personal data and secrets replaced by surrogates, with DataFrame and SQL functions only.

Entities are found by one pattern with an alternative for each type, in one pass that puts a mark around each; what is between the marks is
kept as an array, and the text is put together again from it. In a text that names a person with an honorific, the family name alone is
an entity too. Every distinct entity gets a surrogate from keyed hashes (SHA-2 over the key, the type, the entity and the attempt) that
keeps its type and format: lengths, separators, letter case, country code, card brand, Luhn and IBAN check digits; e-mail domains become
reserved ones; names keep honorific, gender, script and number of parts. The same entity has the same surrogate everywhere, and so has
a family name with any given name. Surrogates that two entities share, or that are themselves entities of the texts, are drawn again
until none is left; after ``ATTEMPTS`` rounds, what a format is too small to keep apart gets a longer form.

The table is written once with the arrays, each row under a number of its own, so that ids decide nothing. Texts without entities are not shuffled.

Cases: null texts stay null and have no entities. Empty texts stay empty. Repeated rows are replaced alike; null and repeated ids are
rows like others. An empty table gives an empty result. The other columns of the table are kept, whatever their names. The noncharacters that
serve as marks are escaped while they are in a text. Names without an honorific, and family names of fewer than three letters alone, are no entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, join_spread, materialize

ATTEMPTS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"
#: Honorifics by gender; those of either gender last (fixed values).
MALE = ["Mr", "Mister", "Herr", "Hr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Signor", "господин", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Fr", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Madam", "Signora", "госпожа", "Госпожа"]
EITHER = ["Dr", "Prof", "Professor", "Doctor", "Dra", "Rev", "Mx", "доктор", "Доктор", "профессор", "Профессор"]
#: Those that are also written in small letters, with a full stop (fixed values).
ABBREVIATED = ["mr", "mrs", "ms", "dr", "prof", "sr", "sra", "mme", "hr", "fr"]
#: Given names by gender and script (fixed values).
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Petra", "Sara"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
}
#: Syllables of made-up family names by script (fixed values).
SYLLABLES = {
    "latin": ["bar", "ben", "dor", "el", "fin", "gar", "hol", "kan", "lam", "mor", "nel", "par", "ros", "san", "tor", "win"],
    "cyrillic": ["бар", "бел", "вор", "дан", "гор", "жил", "зай", "кам", "лом", "мар", "нов", "пет", "рос", "сев", "тол", "чер"],
}
_WHOLE = sorted([*MALE, *FEMALE, *EITHER, *(x.upper() for x in ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau"))], key=len, reverse=True)
#: The first letters are tested before the list is.
_HONORIFIC = (
    rf"(?=[A-Z])(?:{'|'.join(x for x in _WHOLE if x[0] < 'a')})\.?|(?=[{''.join(sorted({x[0] for x in ABBREVIATED}))}]\p{{Ll}}{{1,3}}\.)(?:{'|'.join(ABBREVIATED)})\."
    rf"|(?=\p{{IsCyrillic}})(?:{'|'.join(x for x in _WHOLE if x[0] > 'z')})\.?"
)
_TITLE = rf"(?:(?:{_HONORIFIC})[ ]){{1,2}}"
_NAME = r"(?:\p{Lu}[\p{Ll}\p{M}]+|\p{Lu}{2,})(?:[-'’](?:\p{Lu}[\p{Ll}\p{M}]+|\p{Lu}{2,}))*(?!\p{L})"
_LABEL = r"(?i:password|passwd|passphrase|pwd|secret|secret[_-]key|token|api[_-]?key|access[_-]key|auth[_-]key|private[_-]key|credential)"
_PHONE_LABEL = r"(?i:tel|telephone|phone|mobile|fon|telefon|fax|тел)"

#: Types and their patterns, in order of precedence.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<=[=:] ?[\"']?)(?<={_LABEL} ?[=:] ?[\"']?)[A-Za-z0-9+/_.-]{{8,}}(?<![.])|\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\w:]|\.[0-9])",
    "card": r"(?<![0-9-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}(?![0-9-])|(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-.])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-.])"
    rf"|(?=0[0-9])(?<={_PHONE_LABEL}[.:]{{0,2}} {{0,2}})0[0-9]{{1,5}}(?:[ /.-]?[0-9]{{2,8}}){{1,4}}(?![0-9])",
    "name": rf"{_TITLE}{_NAME}(?:[ ]{_NAME})?",
}
#: Within a word no entity begins: most places of a text are tested no further.
ENTITY = r"(?<!\p{L})(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What each type looks like without its surroundings, where that is not its pattern.
_BARE = {"phone": PATTERNS["phone"] + r"|0[0-9]{1,5}(?:[ /.-]?[0-9]{2,8}){1,4}", "name": rf"{PATTERNS['name']}|{_NAME}"}
#: A mark around entities, and what escapes it in texts that have it.
_MARK, _ESCAPE = "\ufdd0", "\ufdd1"


def _with_parts(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a text's parts: an array that alternates what is kept and an entity, from the former; null for a text without entities and for null. In
    a text with persons their family names, where they stand alone, are further entities. Each step is a column of its own, so that it is
    computed once."""
    text, families = F.col(text_col), free_name(docs, "entity_families")
    plain = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))
    out = docs.withColumn(name, F.split(F.regexp_replace(plain, ENTITY, f"{_MARK}$0{_MARK}"), _MARK, -1))
    out = out.withColumn(name, F.when(F.size(name) > 1, F.col(name)))
    persons = F.filter(name, lambda x, i: (i % 2 == 1) & x.rlike(f"^{_TITLE}"))
    last = F.transform(persons, lambda x: F.element_at(F.split(x, " "), -1))
    out = out.withColumn(families, F.array_distinct(F.filter(last, lambda x: F.length(x) > 2)))
    quoted = F.transform(families, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    out = out.withColumn(families, F.when(F.size(families) > 0, F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\p{L})"))))
    again = F.transform(name, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.regexp_replace(x, F.col(families), F.lit(f"{_MARK}$0{_MARK}"))))
    return out.withColumn(name, F.when(F.col(families).isNotNull(), F.split(F.array_join(again, _MARK), _MARK, -1)).otherwise(F.col(name))).drop(families)


def entity_type(value: Column) -> Column:
    """The type of an entity: the first whose whole pattern it is (a secret without its label counts as one)."""
    out = None
    for name, pattern in PATTERNS.items():
        if name == "secret":
            continue
        test = value.rlike(f"^(?:{_BARE.get(name, pattern)})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("secret")


def _stream(value: Column, kind: Column, attempt: Column, key: str, label: str) -> Column:
    """128 keyed hex digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(label), kind, attempt.cast("string"), value), 512)


def _number(stream: Column, at, digits: int = 4) -> Column:
    """A number from some hex digits of a stream, from a place (0-based) on, wrapping around."""
    start = F.pmod(F.lit(at) if isinstance(at, int) else at, F.lit(128 - digits)) + 1
    return F.conv(stream.substr(start.cast("int"), F.lit(digits)), 16, 10).cast("int")


def _recode(value: Column, stream: Column, keep: int = 0, hexes: bool = False) -> Column:
    """Every letter and digit (after the first keep characters) replaced by one of its class; the rest stays."""
    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i * 3, 4)
        small, large, ten = F.lit("abcdef" if hexes else "abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("0123456789")
        pick = lambda letters, m: letters.substr((F.pmod(n, F.lit(m)) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c).when(c.rlike("^[0-9]$"), pick(ten, 10)).when(c.rlike("^[a-z]$"), pick(small, 6 if hexes else 26))
            .when(c.rlike("^[A-Z]$"), pick(large, 6 if hexes else 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(value: Column, stream: Column) -> Column:
    new = _recode(value, stream, keep=1)
    digits = F.regexp_replace(new, "[^0-9]", "")
    body = digits.substr(F.lit(1), F.length(digits) - 1)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    valid = F.pmod(_luhn_sum(F.regexp_replace(value, "[^0-9]", "")), F.lit(10)) == 0
    return F.when(valid, F.concat(new.substr(F.lit(1), F.length(new) - 1), check)).otherwise(new)


def _email(value: Column, stream: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    own = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    label = F.concat(F.lit("mail"), _number(own, 0, 6).cast("string"))
    top = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (F.pmod(_number(own, 8), F.lit(3)) + 1).cast("int"))
    return F.concat(_recode(local, stream), F.lit("@"), label, F.lit(".example."), top)


def _ip(value: Column, stream: Column) -> Column:
    four = F.concat_ws(".", *[(F.pmod(_number(stream, 8 * i, 6), F.lit(254)) + 1).cast("string") for i in range(4)])
    return F.when(F.contains(value, F.lit(":")), _recode(value, stream, hexes=True)).otherwise(four)


def _mod97(iban: Column) -> Column:
    """The remainder of an account number without blanks, its first four characters last and letters read as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), iban.substr(F.lit(1), F.lit(4)))
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    step = lambda a, c: F.pmod(a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + digit(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(value: Column, stream: Column) -> Column:
    """The country stays; the check digits fit where they did."""
    new = _recode(value, stream, keep=2)
    bare = lambda c: F.regexp_replace(c, " ", "")
    zeroed = F.concat(bare(new).substr(F.lit(1), F.lit(2)), F.lit("00"), F.substr(bare(new), F.lit(5)))
    check = F.lpad((98 - _mod97(zeroed)).cast("string"), 2, "0")
    return F.when(_mod97(bare(value)) == 1, F.concat(new.substr(F.lit(1), F.lit(2)), check, F.substr(new, F.lit(5)))).otherwise(new)


def _phone(value: Column, stream: Column) -> Column:
    """The country code and a leading 0 stay; else an area code doesn't begin with 0 or 1."""
    head = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 1)
    rest = value.substr(F.length(head) + 1, F.length(value))
    new = _recode(rest, stream)
    first = F.regexp_extract(new, r"^([^0-9]*)", 1)
    lead = F.when(rest.startswith("0"), "0").otherwise((F.pmod(_number(stream, 100), F.lit(8)) + 2).cast("string"))
    return F.concat(head, first, lead, new.substr(F.length(first) + 2, F.length(new)))


def _family_of(value: Column) -> Column:
    """The last part of a name."""
    return F.element_at(F.split(value, " "), -1)


def _family(value: Column, attempt: Column, key: str) -> Column:
    """A made-up family name in the script and letter case of another."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("family"), attempt.cast("string"), F.lower(value)), 256)
    pick = lambda s: F.concat(*[F.element_at(F.array(*map(F.lit, SYLLABLES[s])), (F.pmod(_number(h, 8 * i), F.lit(16)) + 1).cast("int")) for i in range(4)])
    made = F.initcap(F.when(value.rlike(r"\p{IsCyrillic}$"), pick("cyrillic")).otherwise(pick("latin")))
    made = F.when(value == F.upper(value), F.upper(made)).otherwise(made)
    return F.when(attempt < ATTEMPTS, made).otherwise(F.concat(made, F.lit("-"), F.initcap(F.translate(h.substr(F.lit(1), F.lit(16)), "0123456789", "ghijklmnop"))))


def _name(value: Column, family: Column, attempt: Column, key: str) -> Column:
    """The honorific, a given name of its gender and script where there is one, and the surrogate of the family name. From the fourth attempt on the
    given name is a double one."""
    title = F.regexp_extract(value, rf"^(?:{_TITLE})?", 0)
    parts = F.split(F.substr(value, F.length(title) + 1), " ")
    own, cyrillic = F.element_at(parts, 1), value.rlike(r"\p{IsCyrillic}$")
    address = F.lower(F.regexp_extract(title, r"^([^. ]*)", 1))
    either = own.isin(*GIVEN["f", "latin"], *GIVEN["f", "cyrillic"]) | own.rlike("[aа]$")
    female = address.isin([x.lower() for x in FEMALE]) | (~address.isin([x.lower() for x in MALE]) & either)
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("given"), attempt.cast("string"), own), 256)

    def pick(place: int) -> Column:
        at = (F.pmod(_number(h, place), F.lit(16)) + 1).cast("int")
        one = lambda g, s: F.element_at(F.array(*map(F.lit, GIVEN[g, s])), at)
        return F.when(cyrillic, F.when(female, one("f", "cyrillic")).otherwise(one("m", "cyrillic"))).otherwise(F.when(female, one("f", "latin")).otherwise(one("m", "latin")))

    given = F.when(attempt > 2, F.concat(pick(0), F.lit("-"), pick(8))).otherwise(pick(0))
    return F.concat(title, F.when((F.length(title) > 0) & (F.size(parts) > 1), F.concat(given, F.lit(" "))).otherwise(""), family)


def surrogate(key: str) -> Column:
    """The surrogate of the columns value, kind, family (of names) and attempt. From ATTEMPTS on it is longer than the format."""
    value, kind, attempt = F.col("value"), F.col("kind"), F.col("attempt")
    stream = _stream(value, kind, attempt, key, "surrogate")
    hexes = value.rlike("^[0-9a-f]+$")
    secret = F.when(hexes, _recode(value, stream, hexes=True)).when(value.rlike("^A[KS]IA"), _recode(value, stream, keep=4)).otherwise(_recode(value, stream))
    out = (
        F.when(kind == "email", _email(value, stream, key)).when(kind == "ip", _ip(value, stream)).when(kind == "card", _card(value, stream))
        .when(kind == "phone", _phone(value, stream)).when(kind == "iban", _iban(value, stream))
        .when(kind == "name", _name(value, F.col("family"), attempt, key)).when(kind == "ssn", _recode(value, stream)).otherwise(secret)
    )
    return F.when(attempt < ATTEMPTS, out).otherwise(F.concat(out, F.lit("-"), stream.substr(F.lit(1), F.lit(16))))


def _draw_apart(known: DataFrame, draw: Column) -> DataFrame:
    """known (value, ...) with attempt and surrogate: drawn again until the surrogates are distinct and none of them is a value."""
    now = materialize(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw), "surrogates")
    for _ in range(ATTEMPTS + 3):
        taken = now.groupBy("surrogate").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("surrogate", "first")
        clash = now.join(taken, "surrogate").filter("value != first").select("value")
        same = now.select(F.col("surrogate").alias("s"), "value").join(now.select(F.col("value").alias("s")), "s").select("value")
        again = clash.unionByName(same).distinct()
        if again.isEmpty():
            return now
        marked = now.join(again.withColumn("redo", F.lit(True)), "value", "left")
        nxt = materialize(
            marked.withColumn("attempt", F.col("attempt") + F.when(F.col("redo"), 1).otherwise(0)).drop("surrogate", "redo")
            .withColumn("surrogate", draw).select(*now.columns), "surrogates"
        )
        discard(now)
        now = nxt
    raise RuntimeError("surrogates still clash")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) of distinct entities (value), the surrogates distinct and none of them an entity."""
    known = materialize(entities.groupBy("value").agg(F.count(F.lit(1)).alias("places")).select("value", entity_type(F.col("value")).alias("kind")), "known")
    words = known.filter("kind = 'name'").select(_family_of(F.col("value")).alias("value")).distinct()
    families = _draw_apart(words, _family(F.col("value"), F.col("attempt"), key))
    named = join_spread(
        known.filter("kind = 'name'").withColumn("last", _family_of(F.col("value"))), families.select(F.col("value").alias("last"), F.col("surrogate").alias("family")), "last", "value"
    ).select("value", "kind", "family")
    rest = known.filter("kind != 'name'").withColumn("family", F.lit(None).cast("string"))
    out = _draw_apart(named.unionByName(rest), surrogate(key)).select("value", "kind", "surrogate")
    discard(known)
    discard(families)
    return out


def replace_entities(docs: DataFrame, key: str = "tessera-surrogates", id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The table with surrogates in its texts; with counts, also n_entities and one count for each type (n_email, ...). Ids are not looked at."""
    parts, row, found = (free_name(docs, x) for x in ("entity_parts", "entity_row", "entities_found"))
    names = ["n_entities", *(f"n_{x}" for x in PATTERNS)] if counts else []
    order = [*(c for c in docs.columns if c not in names), *names]
    known = _with_parts(docs, text_col, parts).withColumn(row, F.monotonically_increasing_id())
    known = materialize(known.withColumn(text_col, F.when(F.col(parts).isNull(), F.col(text_col))), "marked")
    touched = known.filter(F.col(parts).isNotNull())
    places = touched.select(F.col(row).alias("row"), F.posexplode(parts).alias("at", "value")).filter("at % 2 = 1")
    table = surrogates(places.select("value"), key)
    placed = join_spread(places, table, "value", "row")
    lists = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate", "kind"))).alias(found)).withColumnRenamed("row", row)
    touched = touched.join(lists, row)
    new = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.get(F.col(found), ((i - 1) / 2).cast("int"))["surrogate"])), "")
    plain = F.replace(F.replace(new, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
    if counts:
        touched = touched.withColumn("n_entities", F.size(found).cast("long"))
        kinds = F.transform(found, lambda x: x["kind"])
        for name in PATTERNS:
            touched = touched.withColumn(f"n_{name}", (F.size(found) - F.size(F.array_remove(kinds, name))).cast("long"))
    touched = touched.withColumn(text_col, plain)
    rest = known.filter(F.col(parts).isNull())
    for name in names:
        rest = rest.withColumn(name, F.lit(0).cast("long"))
    return rest.select(*order).unionByName(touched.select(*order))
