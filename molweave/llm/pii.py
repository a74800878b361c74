"""Personal data replaced by keyed surrogates (operator 10), in built-in functions only.

One pattern finds e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, US social security
numbers, IBANs, access keys and names after a form of address, and in the same document repeats of these names without
it. An entity becomes a surrogate of its own type that a secret key and its parts determine, so the same entity has the
same surrogate in every document, however it is written: a mailbox counts in lower case, a telephone number, card or
IBAN without its separators, and given and family name are drawn apart, without title and possessive. Letters stay letters
of their case and script and digits stay digits; cards keep a right check digit, IBANs right check digits, addresses
stay addresses; a name gets given or family names of its script and of the gender of the form of address.

Collision checks run over all distinct parts: two of one surrogate, or a surrogate that is itself an
entity of the corpus, are drawn again until every surrogate is new and distinct. From the third new draw on a surrogate
grows by one more character a draw (letters of a name or a mailbox, digits of a telephone or social security number, a
number after an IPv4 address), as the format of a short entity may have fewer surrogates than the corpus has entities;
cards, IBANs and access keys have over 10^10 of each format and never grow. Almost all entities need no second
draw and are computed in place; the others reach their texts by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.session import materialise

from .common import table

#: the key of the registered query, whose texts are made up; real data need a secret of their own
QUERY_KEY = "change-me"
#: new draws that keep the format of an entity; later ones add a character each
SAME_FORM = 2

#: fixed values: forms of address by gender, as words of a pattern
MALE = "Mr|Mister|Herr|Señor|Monsieur|Signor|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Signora|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Professor|Doctor"

#: fixed values: names by script and gender, and family names by script
NAMES = {
    "latin": {
        "m": ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon"],
        "f": ["Alma", "Clara", "Diana", "Elsa", "Flora", "Helena", "Julia", "Laura", "Marta", "Nora", "Olga", "Sara"],
        "n": ["Alex", "Andrea", "Charlie", "Eden", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni"],
        "last": ["Abel", "Berger", "Costa", "Duval", "Ebner", "Fabre", "Garner", "Holm", "Ibsen", "Jansen", "Keller", "Lemaire", "Molina", "Norton", "Ortega", "Palmer", "Quint", "Romero", "Sander", "Thorne", "Ulrich", "Vidal", "Weber", "Young", "Zeller"],
    },
    "cyrillic": {
        "m": ["Алексей", "Борис", "Виктор", "Денис", "Иван", "Максим", "Павел", "Роман"],
        "f": ["Алина", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
        "n": ["Женя", "Саша", "Валя", "Шура"],
        "last": ["Абрамс", "Гришко", "Довженко", "Кравчук", "Лысенко", "Мельник", "Остапчук", "Руденко", "Савченко", "Ткаченко"],
    },
    "greek": {
        "m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
        "f": ["Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"],
        "n": ["Αλέξης", "Χάρις"],
        "last": ["Αγγέλου", "Βασιλείου", "Γεωργίου", "Δούκα", "Ιωάννου", "Λάμπρου", "Μάρκου", "Νικολάου", "Παύλου", "Σταύρου"],
    },
}

INITIALS = "".join(sorted({word[0] for word in f"{MALE}|{FEMALE}|{NEUTRAL}".split("|")}))

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ACCESS_KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])(?=\+(?:[ .-]?[0-9]){7})\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
TITLES = f"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\\.? )+"
#: a capital and what follows it, with capitals inside after a mark or after small letters (O’Neil, Jones-Lee, McDonald)
WORD = r"\p{Lu}(?:[\p{Ll}\p{M}]|['’-](?=\p{L})\p{Lu}?|(?<=\p{Ll})\p{Lu}(?=\p{Ll}))+"
NAME = rf"(?=[{INITIALS}])(?<!\p{{L}}){TITLES}{WORD}(?: {WORD})?"
#: an entity begins where no Latin letter or digit stands before it, which settles most places at once; earlier
#: alternatives win at the same place
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join([EMAIL, ACCESS_KEY, IBAN, IP, SSN, PHONE, CARD, NAME]) + ")"


def kind_of(value: Column) -> Column:
    """The type of a match or part; null for a number that only looks like a card."""
    plain = F.regexp_replace(value, "[^0-9]", "")
    card = luhn_digit(F.substring(plain, F.lit(1), F.length(plain) - 1)) == F.substring(plain, -1, 1)
    full = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), "email").when(value.startswith("tel:"), "phone").when(value.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key").when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(full(PHONE), "phone").when(value.rlike("^[0-9]"), F.when(card, "card")).otherwise("name")
    )


def _digest(key: str, value: Column, attempt: Column, block: Column | int) -> Column:
    """64 hexadecimal digits that the key, the value, the attempt and a block number determine."""
    return F.sha2(F.concat_ws("\u0000", F.lit(key), value, attempt.cast("string"), F.lit(block).cast("string") if isinstance(block, int) else block.cast("string")), 256)


def _stream(key: str, value: Column, attempt: Column, length: Column) -> Column:
    """Hexadecimal digits, four for each of ``length`` characters."""
    blocks = F.sequence(F.lit(0), F.floor((length * 4 + 63) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: _digest(key, value, attempt, b)), "")


def _number(stream: Column, at: Column) -> Column:
    """The number at place ``at`` (from 0) of the stream, below 65,536."""
    return F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


#: fixed values: what may stand for a character
ALPHABETS = [("0", "9", "0123456789"), ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]


def _shaped(value: Column, stream: Column) -> Column:
    """Every ASCII digit and letter replaced by one of its kind; other characters stay."""

    def char(c: Column, i: Column) -> Column:
        out = c
        for first, last, letters in ALPHABETS:
            out = F.when((c >= first) & (c <= last), F.substring(F.lit(letters), F.pmod(_number(stream, i), F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, char), "")


def _grown(value: Column, stream: Column, attempt: Column, letters: str | Column) -> Column:
    """The characters that a late draw adds: none up to draw ``SAME_FORM``, then one more each time."""
    pool = F.lit(letters) if isinstance(letters, str) else letters
    pick = lambda i: F.substring(pool, F.pmod(_number(stream, F.length(value) + 3 + i), F.length(pool)) + 1, F.lit(1))
    return F.when(attempt > SAME_FORM, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - SAME_FORM, F.lit(1))), pick), "")).otherwise("")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: a one-element transform."""
    return F.transform(F.array(value), body)[0]


def _filled(shape: Column, characters: Column, kind: str) -> Column:
    """``shape`` with its characters of the class ``kind`` replaced, in order, by ``characters``; the rest of these follows."""
    empty = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(
        c.rlike(kind), F.struct(F.concat(acc["out"], F.substring(characters, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    done = F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), empty, step)
    return _let(done, lambda d: F.concat(d["out"], F.substring(characters, d["at"], F.length(characters))))


def _cased(shape: Column, lower: Column) -> Column:
    """``lower`` with capitals where ``shape`` has them, both read from their ends."""
    more = F.length(lower) - F.length(shape)
    chars = F.filter(F.split(lower, ""), lambda c: c != "")
    capital = lambda i: (i >= more) & F.substring(shape, i - more + 1, F.lit(1)).rlike("[A-Z]")
    return F.when(shape == F.lower(shape), lower).otherwise(F.array_join(F.transform(chars, lambda c, i: F.when(capital(i), F.upper(c)).otherwise(c)), ""))


def luhn_digit(digits: Column) -> Column:
    """The check digit for a string of digits."""
    places = F.sequence(F.lit(1), F.length(digits))
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(10 - F.aggregate(places, F.lit(0), add) % 10, F.lit(10)).cast("string")


def _card(value: Column, stream: Column) -> Column:
    """A card number without separators."""
    body = F.concat(F.substring(value, 1, 1), F.substring(_shaped(value, stream), F.lit(2), F.length(value) - 2))
    return _let(body, lambda b: F.concat(b, luhn_digit(b)))


def _iban(value: Column, stream: Column) -> Column:
    country = F.substring(value, 1, 2)
    part = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))

    def checked(shaped: Column) -> Column:
        body = F.regexp_replace(F.substring(shaped, F.lit(5), F.length(shaped)), " ", "")
        letters = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
        digits = F.filter(F.split(F.array_join(F.transform(letters, part), ""), ""), lambda c: c != "")
        rest = F.aggregate(digits, F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(shaped, F.lit(5), F.length(shaped)))

    return _let(_shaped(value, stream), checked)


def _ip(stream: Column) -> Column:
    octets = [F.pmod(_number(stream, F.lit(k)), F.lit(223 if k == 0 else 254)) + 1 for k in range(4)]
    return F.concat_ws(".", *(o.cast("string") for o in octets))


def _email(value: Column, stream: Column, attempt: Column) -> Column:
    """Local part and host labels in their shape; the last label stays."""
    more = _grown(value, stream, attempt, ALPHABETS[1][2])
    return F.concat(more, _shaped(F.regexp_replace(value, r"\.[A-Za-z]+$", ""), stream), F.regexp_extract(value, r"\.[A-Za-z]+$", 0))


TITLE = f"^{TITLES}"
POSSESSIVE = "(?:['’]s?|-)+$"


def _names(value: Column) -> Column:
    """The one or two names of a match, without titles and possessive."""
    return F.split(F.regexp_replace(F.regexp_replace(value, TITLE, ""), POSSESSIVE, ""), " ")


def _gender(value: Column) -> Column:
    among = lambda titles: value.rlike(rf"^(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? )*(?:{titles})\.? ")
    return F.when(among(MALE), "m").when(among(FEMALE), "f").otherwise("n")


def _name(part: Column, stream: Column, attempt: Column) -> Column:
    """A family name, or a given name after its gender, of the same script."""
    script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.regexp_extract(part, "^([mfn]) ", 1)
    letters = F.when(script == "latin", "aeiounrst").when(script == "cyrillic", "аеионрсту").otherwise("αεινορστυ")
    first = F.lit(None).cast("string")
    for s, lists in NAMES.items():
        for g, names in lists.items():
            pool = F.split(F.lit(",".join(names)), ",")
            first = F.when((script == s) & (gender == ("" if g == "last" else g)), pool[F.pmod(_number(stream, F.lit(0)), F.lit(len(names)))]).otherwise(first)
    # letters follow a family name, and a given name drawn again, so that distinct persons can stay distinct
    tail = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda i: F.substring(letters, F.pmod(_number(stream, i), F.lit(9)) + 1, F.lit(1))), "")
    last = F.concat(first, F.when((gender == "") | (attempt > 0), tail).otherwise(""), _grown(part, stream, attempt, letters))
    return F.when(gender == "", last).otherwise(F.concat_ws(" ", gender, last))


#: fixed pattern: a plus sign and the country code after it
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def parts_of(value: Column, gender: Column) -> Column:
    """What surrogates are drawn for: the parts of a match in one form, however it is written; none if it stays."""

    def split(kind: Column) -> Column:
        names = _names(value)
        given = F.concat_ws(" ", gender, names[0])
        return (
            F.when(kind == "email", F.array(F.lower(value))).when(kind == "phone", F.array(F.concat(F.lit("tel:"), F.regexp_replace(value, "[^0-9+]", ""))))
            .when(kind == "card", F.array(F.regexp_replace(value, "[^0-9]", ""))).when(kind == "iban", F.array(F.regexp_replace(value, " ", "")))
            .when(kind == "name", F.when(F.size(names) > 1, F.array(given, names[1])).otherwise(F.array(names[0])))
            .when(kind.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
        )

    return _let(kind_of(value), split)


def written(value: Column, parts: Column) -> Column:
    """The surrogates of a match's parts in the form of the match."""

    def form(kind: Column) -> Column:
        digits = F.regexp_replace(parts[0], "[^0-9]", "")
        name = F.concat(
            F.regexp_extract(value, TITLE, 0), F.when(F.size(parts) > 1, F.concat(F.substring(parts[0], F.lit(3), F.length(parts[0])), F.lit(" "), parts[1])).otherwise(parts[0]),
            F.regexp_extract(value, POSSESSIVE, 0),
        )
        return (
            F.when(F.size(parts) == 0, value).when(kind == "email", _cased(value, parts[0])).when(kind.isin("phone", "card"), _filled(value, digits, "[0-9]"))
            .when(kind == "iban", _filled(value, parts[0], "[^ ]")).when(kind == "name", name).otherwise(parts[0])
        )

    return _let(kind_of(value), form)


def surrogate(value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a part at a draw. A card number whose check digit is wrong is none and stays."""

    def drawn(bound: Column) -> Column:
        kind, stream = bound["kind"], bound["stream"]
        digits = _grown(value, stream, attempt, ALPHABETS[0][2])
        number = F.substring(value, F.lit(5), F.length(value))
        phone = F.concat(F.lit("tel:"), F.regexp_extract(number, COUNTRY + "|^", 0), _shaped(F.regexp_replace(number, COUNTRY, ""), stream), digits)
        return (
            F.when(kind == "email", _email(value, stream, attempt)).when(kind == "key", F.concat(F.substring(value, 1, 4), _shaped(F.substring(value, 5, 16), stream)))
            .when(kind == "iban", _iban(value, stream)).when(kind == "ip", F.concat(_ip(stream), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""))).when(kind == "card", _card(value, stream))
            .when(kind == "name", _name(value, stream, attempt)).when(kind == "phone", phone).when(kind == "ssn", F.concat(_shaped(value, stream), digits)).otherwise(value)
        )

    bound = F.struct(kind_of(value).alias("kind"), _stream(key, value, attempt, F.length(value) + 8 + attempt).alias("stream"))
    return _let(bound, drawn)


def entities_of(text: Column, pattern: Column | str = PATTERN) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, 0), F.array().cast("array<string>"))


def pattern_of(titled: Column) -> Column:
    """The pattern of a document: repeats of its titled names without the title are found too, the whole name first."""
    names = F.transform(titled, _names)
    whole = F.transform(F.filter(names, lambda n: F.size(n) > 1), lambda n: F.array_join(n, " "))
    family = F.transform(names, lambda n: F.element_at(n, -1))
    # longer ones first, as the first alternative that fits is taken
    bare = F.array_join(F.reverse(F.array_sort(F.array_distinct(F.concat(whole, family)))), "|")
    return F.when(F.size(titled) > 0, F.concat(F.lit(PATTERN[:-1] + r"|(?<!\p{L})(?:"), bare, F.lit(r")(?!\p{L}))"))).otherwise(F.lit(PATTERN))


def _gender_in(value: Column, titled: Column) -> Column:
    """The gender of a name: by a Mr, Mrs and so on before the same names in the document, else none."""
    same = F.filter(titled, lambda t: F.array_join(_names(t), " ") == F.array_join(_names(value), " "))
    return F.coalesce(F.filter(F.transform(same, _gender), lambda g: g != "n")[0], F.lit("n"))


def replacements(values: DataFrame, key: str) -> DataFrame:
    """(value, attempt, replacement) of distinct values; no two replacements are equal and none is a value."""
    # few bytes, but many draws: spread over all tasks, which adaptive execution would join into one
    values = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")
    drawn = materialise(values.select("value", F.lit(0).alias("attempt"), surrogate(F.col("value"), F.lit(0), key).alias("replacement")), "surrogates")
    while True:
        first = drawn.groupBy("replacement").agg(F.min(F.struct("attempt", "value")).alias("m"), F.count("*").alias("n"))
        taken = drawn.select(F.col("value").alias("replacement"), F.lit(True).alias("real"))
        judged = first.join(taken, "replacement", "left").where((F.col("n") > 1) | F.col("real"))
        again = drawn.join(judged.select("replacement", F.col("m.value").alias("keeps"), F.coalesce("real", F.lit(False)).alias("real")), "replacement")
        again = materialise(again.where(F.col("real") | (F.col("value") != F.col("keeps"))).select("value", (F.col("attempt") + 1).alias("attempt")), "redrawn")
        if again.isEmpty():
            return drawn
        redrawn = again.select("value", "attempt", surrogate(F.col("value"), F.col("attempt"), key).alias("replacement"))
        drawn = materialise(drawn.join(again.select("value"), "value", "left_anti").unionByName(redrawn), "surrogates")


def replace_pii(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its texts rewritten and ``n_entities`` (bigint) and ``kinds`` (sorted distinct types) added.

    ``key`` is a secret: who has it can tell which surrogate an entity gets. It must not be empty.
    Null texts stay null and hold no entity, empty texts stay empty, texts of any length are read whole. Repeated
    rows get equal results; an empty table gives an empty one; input columns named like an added one are replaced.
    """
    if not key:
        raise ValueError("surrogates need a key")
    kept = [c for c in df.columns if c not in ("n_entities", "kinds")]
    # written once: the pattern runs over every text a single time (again where it has names), and the draws below read the entities alone
    found = df.select(*kept, entities_of(F.col(text)).alias("__found"))
    found = found.withColumn("__titled", F.array_distinct(F.filter("__found", lambda v: v.rlike(TITLE))))
    found = found.withColumn("__pattern", pattern_of(F.col("__titled")))
    found = found.withColumn("__found", F.when(F.size("__titled") > 0, entities_of(F.col(text), F.col("__pattern"))).otherwise(F.col("__found")))
    parts = F.transform("__found", lambda v: parts_of(v, F.when(F.size("__titled") > 0, _gender_in(v, F.col("__titled"))).otherwise("n")))
    found = materialise(found.withColumn("__parts", parts), "entities")
    values = found.select(F.explode(F.flatten("__parts")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    redrawn = replacements(values, key).where("attempt > 0").select("value", "replacement")
    if redrawn.isEmpty():
        new_part = lambda p: surrogate(p, F.lit(0), key)
    else:
        # texts that hold a redrawn part get their own small map, by the hash of the text
        holds = found.select(F.sha2(text, 256).alias("__text"), F.explode(F.array_distinct(F.flatten("__parts"))).alias("value")).distinct()
        maps = holds.join(redrawn, "value").groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct("value", "replacement"))).alias("__redrawn"))
        found = found.withColumn("__text", F.sha2(text, 256)).join(maps, "__text", "left")
        new_part = lambda p: F.coalesce(F.col("__redrawn")[p], surrogate(p, F.lit(0), key))
    found = found.withColumn("__new", F.zip_with("__found", "__parts", lambda v, ps: _let(F.transform(ps, new_part), lambda new: written(v, new))))
    pieces = F.when(F.size("__titled") > 0, F.split(F.col(text), F.col("__pattern"), -1)).otherwise(F.split(F.col(text), PATTERN, -1))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col("__new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    new = F.when(F.size("__found") > 0, joined).otherwise(F.col(text)).alias(text)
    types = F.filter(F.transform("__found", kind_of), lambda k: k.isNotNull())
    found = found.withColumn("__types", types)
    return found.select(*(new if c == text else F.col(c) for c in kept), F.size("__types").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("__types")).alias("kinds"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
