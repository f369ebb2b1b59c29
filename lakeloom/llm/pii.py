"""Personal data replaced by keyed surrogates, in DataFrame operations alone.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers, IBANs, US social
security numbers, secret tokens, and names behind a form of address, with their other mentions in the same text (a surname
that is also a word, such as May, is replaced wherever that text has it with a capital). Particles such as von stay. A surrogate has its entity's
type and format: letters stand for letters of the same case and script, digits for digits, signs and
spacing stay; a card number passes its check digit, an IBAN keeps its country, a telephone number
its international prefix, and a given name the gender that a form of address before it tells anywhere (female, where they
differ). One entity has one surrogate everywhere, whatever its spelling or form of address (coreference; hexadecimal tokens in any case); two entities never share one, and no
surrogate equals an entity that the texts hold (collision checks over all of them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import counted, fresh, seen, written

# Forms of address by the gender that they tell.
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Signora", "Госпожа"]
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин"]
NEUTRAL = ["Dr", "Prof"]

# Syllables from which names are made, by script, and name endings by gender.
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dan", "del", "fen", "gar", "hal", "jor", "kel", "lan", "lor", "mar", "mel", "nor", "pel", "ran", "ros", "sal", "tam", "tor", "van", "wil", "zan"],
    "cyrillic": ["бар", "бел", "вер", "гор", "дан", "жар", "зор", "кал", "лан", "мар", "мил", "нор", "пол", "рад", "сел", "тор"],
    "greek": ["βαλ", "γερ", "δαν", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παλ", "ραν", "σελ", "τορ"],
}
ENDINGS = {
    "latin": {"given_f": ["a", "ina", "elle"], "given_m": ["o", "ard", "us"], "given_n": ["en", "is", "y"], "surname": ["mann", "son", "ez", "ier", "well"]},
    "cyrillic": {"given_f": ["а", "ина"], "given_m": ["ан", "ор"], "given_n": ["и", "е"], "surname": ["енко", "ич", "ук"]},
    "greek": {"given_f": ["α", "ινα"], "given_m": ["ος", "ης"], "given_n": ["ι", "υ"], "surname": ["ιδης", "ακης"]},
}

# Small words inside of surnames, which stay as they are.
PARTICLES = ["von", "vom", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "ten", "bin", "ibn", "al", "el"]

_TITLES = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + ")"
#: A form of address, with a full stop or a blank behind it.
_TITLE = rf"{_TITLES}(?:\.\x20{{0,3}}|\x20{{1,3}})"
#: A capital and letters, also behind an apostrophe or hyphen if that starts with a capital again; a form of address is none.
_NAME = rf"(?!{_TITLES}(?![\p{{L}}]))(?=\p{{Lu}}[\p{{L}}'’-])\p{{Lu}}\p{{L}}*+(?:['’-]\p{{Lu}}\p{{L}}*+)*+"
_SURNAME = rf"(?:(?:{'|'.join(PARTICLES)})\x20{{1,3}}){{0,3}}{_NAME}"
_PREFIX = "(?:sk|pk|ghp|gho|xox[bp])[-_]"
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: What is an entity. Every alternative starts where its run of characters starts, so scanning is linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "token": rf"(?<![A-Za-z0-9])(?:(?=[A-Fa-f]*+[0-9])[A-Fa-f0-9]{{32,}}+|AKIA[0-9A-Z]{{16}}|{_WEB_TOKEN}|{_PREFIX}[A-Za-z0-9_-]{{16,}}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\p{L}0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*+[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}0-9:]|\.[0-9])",
    "ip": r"(?<![\p{L}0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}0-9]|\.[0-9])",
    "ssn": r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}0-9]|-[0-9])",
    "card": r"(?<![\p{L}0-9.,-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![\p{L}0-9]|[.,-][0-9])",
    "phone": r"(?<![\p{L}0-9.,-])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,5}\)[\x20.-]?)?[0-9]{2,5}(?:[\x20./-]?[0-9]{2,5}){1,4}|\([0-9]{2,5}\)[\x20.-]?[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){1,3}|[0-9]{3}[.\x20-][0-9]{3}[.\x20-][0-9]{4}|[2-9][0-9]{2}[2-9][0-9]{6}|0[0-9]{1,4}[\x20/-][0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,3})(?![\p{L}0-9]|[.,-][0-9])",
    "name": rf"(?<![\p{{L}}0-9]){_TITLE}(?:{_NAME}\x20{{1,3}}(?={_SURNAME}(?![\p{{L}}0-9])))?{_SURNAME}(?![\p{{L}}0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Each pattern needs a digit or @, the start of a token or a form of address; a text without them needs no more than this test.
HINT = rf"[0-9@]|AKIA|eyJ|{_PREFIX}|(?<![\p{{L}}0-9]){_TITLE}"

_ALNUM_ELSE = r"[^\p{L}\p{N}]"
STREAM = 512


def stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """512 hexadecimal digits that depend on the key, the entity and the attempt."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(f"{key}\x1f{block}"), kind, value, attempt.cast("string")), 512) for block in range(STREAM // 128)])


def _byte(hexes: Column, i: Column) -> Column:
    """The i-th byte (from 0) of a stream, as a number."""
    return F.conv(hexes.substr((F.pmod(i, F.lit(STREAM // 2)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(base: int, span: int, b: Column) -> Column:
    return F.lit("".join(chr(base + k) for k in range(span))).substr((F.pmod(b, F.lit(span)) + 1).cast("int"), F.lit(1))


def masked(raw: Column, hexes: Column, hexadecimal: Column, skip: Column) -> Column:
    """``raw`` with each letter and digit after the first ``skip`` of them replaced by one of its kind.

    The k-th letter or digit depends on the stream's k-th byte alone, so spellings that differ in
    signs, spaces or case get spellings of one surrogate.
    """

    def one(given: Column):
        def changed(c: Column, k: Column) -> Column:
            b = _byte(given["hexes"], k)
            return (
                F.when(k <= given["skip"], c)
                .when(c.between("0", "9"), F.pmod(b, F.lit(10)).cast("string"))
                .when(given["hexadecimal"] & c.between("a", "f"), _letter(97, 6, b))
                .when(c.between("a", "z"), _letter(97, 26, b)).when(c.between("A", "Z"), _letter(65, 26, b))
                .when(c.rlike(r"^\p{IsCyrillic}$") & c.rlike(r"^\p{Ll}$"), _letter(0x430, 32, b)).when(c.rlike(r"^\p{IsCyrillic}$"), _letter(0x410, 32, b))
                .when(c.rlike(r"^\p{IsGreek}$"), _letter(0x3B1, 17, b)).when(c.rlike(r"^\p{Ll}$"), _letter(97, 26, b)).when(c.rlike(r"^\p{Lu}$"), _letter(65, 26, b))
                .when(c.rlike(r"^\p{L}$"), _letter(0x4E00, 64, b)).otherwise(c)
            )

        return changed

    return _bound(F.struct(hexes.alias("hexes"), hexadecimal.alias("hexadecimal"), skip.alias("skip")), lambda given: _counted(raw, one(given)))


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _counted(raw: Column, one, size: int = 256) -> Column:
    """``raw`` with each letter or digit c, the k-th of them (from 1), replaced by ``one(c, k)``.

    Counting goes on along blocks of ``size`` characters, so time follows the length.
    """

    def step(done: Column, c: Column) -> Column:
        plain = c.between("0", "9") | c.between("a", "z") | c.between("A", "Z") | (c > "\x7f") & c.rlike(r"^[\p{L}\p{N}]$")
        k = done["k"] + F.when(plain, 1).otherwise(0)
        return F.struct(F.concat(done["out"], F.when(plain, one(c, k)).otherwise(c)).alias("out"), k.alias("k"))

    def block(done: Column, b: Column) -> Column:
        here = F.array(F.struct(b.alias("text"), done["k"].alias("k")))
        return F.struct(F.concat(done["blocks"], here).alias("blocks"), (done["k"] + F.length(F.regexp_replace(b, _ALNUM_ELSE, ""))).alias("k"))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(raw) / size) - 1, F.lit(0)).cast("int")), lambda i: raw.substr(i * size + 1, F.lit(size)))
    none = F.struct(F.array().cast("array<struct<text:string,k:int>>").alias("blocks"), F.lit(0).alias("k"))
    counted = F.aggregate(blocks, none, block, lambda done: done["blocks"])
    return F.array_join(F.transform(counted, lambda x: F.aggregate(F.split(x["text"], "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), x["k"].alias("k")), step, lambda done: done["out"])), "")


def luhn(number: Column) -> Column:
    """The check digit that completes ``number``."""
    digits = F.reverse(F.transform(F.split(number, "(?!^)(?!$)"), lambda c: c.cast("int")))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda a, d: a + d)
    return F.pmod(-total, F.lit(10)).cast("string")


def made_name(kind: Column, raw: Column, hexes: Column, attempt: Column) -> Column:
    """A name in the script of ``raw``: two syllables (a surname three), more after some attempts, and the ending of the kind."""

    def by_script(of) -> Column:
        return F.when(raw.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(raw.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    def ends(script: str) -> Column:
        return reduce(lambda a, k: a.when(kind == k, words(ENDINGS[script][k])), list(ENDINGS[script])[1:], F.when(kind == "given_f", words(ENDINGS[script]["given_f"])))

    def pick(values: Column, i: int) -> Column:
        return F.element_at(values, (F.pmod(_byte(hexes, F.lit(2 * i)) * 256 + _byte(hexes, F.lit(2 * i + 1)), F.size(values)) + 1).cast("int"))

    def of(given: Column) -> Column:
        s = given["syllables"]
        more = [F.when(attempt >= F.when(kind == "surname", early).otherwise(late), pick(s, 2 + late)).otherwise("") for early, late in ((0, 1), (1, 3), (2, 5), (3, 9), (5, 20))]
        return F.initcap(F.concat(pick(s, 0), pick(s, 1), *more, pick(given["ends"], 9)))

    words = lambda values: F.split(F.lit(" ".join(values)), " ")
    return _bound(F.struct(by_script(lambda script: words(SYLLABLES[script])).alias("syllables"), by_script(ends).alias("ends")), of)


def surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical value, as a canonical value; ``gender`` (f, m or null) matters to given names.

    Its stream and masked value are bound, so the expression names each once: the driver holds and rewrites it in every plan.
    """
    return _bound(stream(key, kind, value, attempt), lambda h: _surrogate(kind, value, gender, attempt, key, h))


def _surrogate(kind: Column, value: Column, gender: Column, attempt: Column, key: str, h: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    named = domain.substr(F.lit(1), F.length(domain) - F.length(top))
    domain_stream = stream(key, F.lit("domain"), domain, F.floor(attempt / 4))
    octets = [F.when(F.lit(i == 0) & (attempt < 4), 10).otherwise(F.pmod(_byte(h, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    # What stays as it is: a card's first digit, an IBAN's country, a telephone number's international prefix and a token's own.
    skip = (
        F.when(kind == "card", 1).when(kind == "iban", 2)
        .when((kind == "phone") & value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(1|7|[0-9]{2})", 1)))
        .when(kind == "token", F.length(F.regexp_extract(value, "^(AKIA|eyJ|sk|pk|gh[po]|xox[bp])(?=[A-Za-z0-9_-])", 1))).otherwise(0)
    )
    # A short address has few others of its form; after some attempts it grows.
    grown = F.concat(local, F.repeat(F.lit("x"), F.floor(attempt / 8).cast("int")))
    part = F.when(kind == "email", grown).when(kind == "card", value.substr(F.lit(1), F.length(value) - 1)).otherwise(value)
    spelled = kind.isin("email", "card", "iban", "phone", "token", "ssn", "ipv6")
    made = F.when(spelled, masked(part, h, (kind == "ipv6") | (kind == "token") & value.rlike("^[a-f0-9]+$"), skip))
    name = made_name(F.when(kind == "given", F.concat(F.lit("given_"), F.coalesce(gender, F.lit("n")))).otherwise(kind), value, h, attempt)
    whole = lambda new: (
        F.when(kind == "email", F.concat(new, F.lit("@"), masked(named, domain_stream, F.lit(False), F.lit(0)), top))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "card", F.concat(new, luhn(new)))
        .when(spelled, new).otherwise(name)
    )
    return _bound(made, whole)


def laid_out(raw: Column, canonical: Column) -> Column:
    """A surrogate spelled as ``raw`` was: its letters and digits in the places of raw's."""
    letters = F.split(F.regexp_replace(canonical, _ALNUM_ELSE, ""), "(?!^)(?!$)")

    def one(known: Column):
        def changed(c: Column, k: Column) -> Column:
            s = F.coalesce(F.get(known, k - 1), F.lit(""))
            return F.when(c.between("0", "9"), s).when(c.rlike(r"^\p{Lu}$"), F.upper(s)).otherwise(s)

        return changed

    return _bound(letters, lambda known: _counted(raw, one(known)))


def kind_of(match: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        whole = match.rlike(f"^(?:{p})$")
        out = F.when(whole, k) if out is None else out.when(whole, k)
    return out


def parts_of(match: Column) -> Column:
    """A match as an array of (kind, raw, gender): one entity, or a form of address and the names behind it, or names alone."""
    none = F.lit(None).cast("string")
    part = lambda kind, raw, gender=none: F.struct(kind.alias("kind"), raw.alias("raw"), gender.alias("gender"))
    title = F.regexp_extract(match, f"^{_TITLE}", 0)
    name = match.substr(F.length(title) + 1, F.length(match))
    bare = F.regexp_replace(title, r"[.\x20]", "")
    gender = F.when(bare.isin(FEMALE), "f").when(bare.isin(MALE), "m")
    last = F.regexp_extract(name, f"{_NAME}$", 0)
    first = F.when(F.length(name) > F.length(last), F.regexp_extract(name, f"^{_NAME}(?=\\x20)", 0)).otherwise("")
    # Blanks and particles.
    between = name.substr(F.length(first) + 1, F.length(name) - F.length(first) - F.length(last))
    keep = F.lit("keep")
    two = F.array(part(keep, title), part(F.lit("given"), first, gender), part(keep, between), part(F.lit("surname"), last))
    one = F.array(part(keep, title), part(keep, between), part(F.lit("surname"), last))
    kind = kind_of(match)
    return F.when(F.coalesce(kind, F.lit("name")) == "name", F.when(first != "", two).otherwise(one)).otherwise(F.array(part(kind, match)))


def pattern_of(text: Column) -> Column:
    """What is an entity in this text: ``ANY``, and the full names and surnames that stand behind a form of address somewhere in it."""
    names = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda m: F.regexp_replace(m, f"^{_TITLE}", ""))
    known = F.array_distinct(F.concat(names, F.transform(names, lambda m: F.regexp_extract(m, f"{_NAME}$", 0))))
    # Longer names first, so that a full name isn't taken for its surname.
    longest = F.transform(F.array_sort(F.transform(known, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: x["m"])
    return F.when(F.size(known) == 0, ANY).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}0-9])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}0-9])")))


def national_of_one(raw: Column) -> Column:
    """Whether a telephone number is written as ten digits, which is what follows the international prefix 1."""
    return ~raw.startswith("+") & F.regexp_replace(raw, "[^0-9]", "").rlike("^[2-9][0-9]{9}$")


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(raw)).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").when(national_of_one(raw), "+1").otherwise(""), digits)).when((kind == "token") & raw.rlike("^[A-Fa-f0-9]+$"), F.lower(raw)).when(kind.isin("token", "ip"), raw).otherwise(F.initcap(F.lower(raw)))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """A surrogate for each different (kind, value): no two of a kind share one, and none is a value itself.

    Each round proposes a surrogate for every entity without one. A proposal falls if it is an
    entity's value or taken already, or if a smaller value proposes it too. Those that fall try
    again with the next attempt; a round leaves few. A given name has the smallest ``gender`` that is known of it.
    """
    entities = counted(entities.groupBy("kind", "value").agg(F.min("gender").alias("gender")), "entities")
    real = entities.select("kind", F.col("value").alias("surrogate"))
    todo, done, attempt = entities, None, 0
    while True:
        tried = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(attempt), key))
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate")
        good = good if done is None else done.unionByName(good)
        done = counted(good, "surrogates")
        if seen(done) == seen(entities):
            return done
        todo = written(entities.join(done, ["kind", "value"], "left_anti"), "open-entities")
        attempt += 1
        if attempt > 200:
            raise ValueError("no free surrogates are left")


def replace_pii(docs: DataFrame, key: str, count: str = "n_entities") -> DataFrame:
    """The documents with every entity in ``text`` replaced, and a column ``count``, how many there were.

    All other columns stay as they are, one named like ``count`` aside, which is replaced. Null and empty texts stay (0 entities). Repeated rows and
    null or repeated doc_ids each keep their row: rows are told apart by a number of their own. An
    empty table gives no rows. Texts without an entity are not moved between tasks.
    """
    text = F.col("text")
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    own, news, seen = (fresh(n, docs) for n in ("_row_of_pii", "_surrogates_of_pii", "_pattern_of_pii"))
    clean = docs.where(~has).withColumn(count, F.lit(0))
    hits = written(docs.where(has).withColumn(own, F.monotonically_increasing_id()).withColumn(seen, pattern_of(text)), "with-entities")
    found = hits.select(own, F.posexplode(F.regexp_extract_all("text", seen, F.lit(0))).alias("i", "match"))
    parts = found.select(own, "i", F.posexplode(parts_of(F.col("match"))).alias("j", "part")).select(own, "i", "j", "part.kind", "part.raw", "part.gender")
    parts = written(parts.withColumn("value", canonical(F.col("kind"), F.col("raw"))), "entity-parts")
    given = assign(parts.where("kind <> 'keep'").select("kind", "value", "gender"), key)
    raw, kind = F.col("raw"), F.col("kind")
    national = (kind == "phone") & national_of_one(raw)
    laid = laid_out(raw, F.when(national, F.col("surrogate").substr(3, 10)).otherwise(F.col("surrogate")))
    cased = ((kind == "email") & (F.length("surrogate") == F.length(raw))) | (kind == "ipv6") | (kind == "token") & raw.rlike("^[A-Fa-f0-9]+$")
    shouted = kind.isin("given", "surname") & (F.length("raw") > 1) & (raw == F.upper("raw"))
    new = (
        F.when(F.col("surrogate").isNull(), raw)
        .when(kind.isin("phone", "card", "iban", "ssn") | cased & raw.rlike("[A-Z]"), laid)
        .when(shouted, F.upper("surrogate")).otherwise(F.col("surrogate"))
    )
    swapped = parts.join(given, ["kind", "value"], "left").select(own, F.struct("i", "j", new.alias("new")).alias("s"))
    lists = swapped.groupBy(own).agg(F.array_sort(F.collect_list("s")).alias(news))
    rest = F.split(text, F.col(seen), -1)
    joined = F.transform(rest, lambda p, i: F.concat(p, F.array_join(F.transform(F.filter(F.col(news), lambda x: x["i"] == i), lambda x: x["new"]), "")))
    changed = hits.join(lists, own).withColumn(count, F.size(rest) - 1).withColumn("text", F.array_join(joined, "")).drop(own, news, seen)
    return clean.unionByName(changed.select(clean.columns))
