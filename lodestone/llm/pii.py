"""PII: detected entities get keyed surrogates of the same type and form, in DataFrame operations only.

Telephone, card, social-security and network numbers go through keyed permutations of their digits (a
Feistel network over decimal halves), so different numbers of a kind can't get the same
surrogate; separators, country code and the state of a card's check digit stay.  Area codes and exchanges keep to the digits that they may begin with, and a
social-security number is permuted again until it could be one.  Mail
addresses, hexadecimal secrets and names are drawn by a keyed hash, secrets in their own length, each word in
the case of the original.  A surname has one surrogate wherever it stands, whatever the title; a full name's surname
goes on with syllables drawn from the whole name, so that people of one family stay distinct, and its given name is of the title's gender; both are of the
original's script (Latin, Cyrillic, Greek or Armenian, the scripts with capitals that titles are known for).

Who is named with a title in a text is named there again without it, or by the surname alone: those mentions get the same surrogate.  They are
told by whole words in the same case, so in that text a word that is also the surname is taken for it.

Hashed surrogates are checked over the whole corpus, without titles and in lower case: none may be shared by two
entities or be an entity that stands in the corpus.  Only those that are get another draw, so that all others are the same in
every run.  What the check writes are keyed hashes of entities and surrogates, never an entity, and they are deleted with it.  With 40 bits a surname and 64 an address that
happens to a handful in millions; the check raises beyond
EXCEPTIONS of them, which only a broken key could give.

Detected are addresses, 32 to 64 hexadecimal digits, 16-digit cards, North American telephone numbers, social-security
numbers, IPv4 addresses, and names after a title; nothing else is.

Null texts stay null, with no entities; texts without entities pass unchanged.  Repeated rows and long
texts are nothing special: every alternative of the pattern starts at a token's
beginning, so a long token is read once.  Extra columns are kept by `mask`, rows of any doc_id too.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scratch

WORD = r"\p{L}\p{N}._%+-"
#: Titles by gender, as they are written before a name.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος", "Պարոն"], "f": ["Mrs", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία", "Տիկին"]}
_TITLES = "|".join(t for g in ("f", "m") for t in TITLES[g])
#: Kind and pattern of the entities.
PATTERNS = [
    ("email", rf"(?<![{WORD}])[{WORD}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+"),
    ("token", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"),
    ("card", r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d)"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLES})\.?[ ]\p{{Lu}}[\p{{L}}'-]+(?:[ ]\p{{Lu}}[\p{{L}}'-]+)?"),
]
PATTERN = "|".join(p.replace("([ -]?)", "(?<sep>[ -]?)").replace(r"\1", r"\k<sep>") for _, p in PATTERNS)
#: What a name without a title may not follow, and what may not follow it: letters, or a part joined to it; a genitive s may.
LEFT, RIGHT = r"(?<!\p{L})(?<!\p{L}['-])", r"(?!\p{L}|-\p{L}|'\p{L}\p{L})"
#: A text that matches none of this holds no entity.
HINT = rf"[0-9@]|(?:{_TITLES})[. ]"
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Noel", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Юрий"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"],
    ("m", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Ιωάννης", "Κώστας", "Λεωνίδας", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Φώτης", "Χρήστος"],
    ("f", "greek"): ["Αθηνά", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηλέκτρα", "Θάλεια", "Ιωάννα", "Κατερίνα", "Μαρία", "Νίκη", "Όλγα", "Ράνια", "Σοφία", "Χριστίνα"],
    ("m", "armenian"): ["Արամ", "Արմեն", "Աշոտ", "Գագիկ", "Գարիկ", "Դավիթ", "Էդգար", "Հայկ", "Կարեն", "Հովիկ", "Մհեր", "Նարեկ", "Սարգիս", "Տիգրան", "Վահե", "Րաֆֆի"],
    ("f", "armenian"): ["Անահիտ", "Անի", "Գայանե", "Լիլիթ", "Լուսինե", "Հասմիկ", "Կարինե", "Մարիամ", "Մերի", "Նանե", "Նարինե", "Շուշան", "Սոնա", "Սիրուն", "Սյուզի", "Վարդուհի"],
}
#: Parts of the syllables of made-up surnames by script: 16 beginnings, 8 middles and 8 ends.
SYLLABLES = {
    "latin": (["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z"], ["a", "e", "i", "o", "u", "ai", "au", "ei"], ["", "l", "m", "n", "r", "s", "t", "nd"]),
    "cyrillic": (["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"], ["а", "е", "и", "о", "у", "я", "ё", "ю"], ["", "л", "м", "н", "р", "с", "т", "в"]),
    "greek": (["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ", "ψ"], ["α", "ε", "η", "ι", "ο", "υ", "ω", "ου"], ["", "λ", "μ", "ν", "ρ", "κ", "τ", "ξ"]),
    "armenian": (["բ", "գ", "դ", "զ", "թ", "լ", "խ", "կ", "հ", "մ", "ն", "պ", "ս", "տ", "վ", "ք"], ["ա", "ե", "է", "ի", "ո", "ու", "ը", "օ"], ["", "լ", "մ", "ն", "ր", "ս", "տ", "կ"]),
}
SCRIPTS = ["latin", "cyrillic", "greek", "armenian"]
#: Entities that may have another draw than the first.
EXCEPTIONS = 1000


def _hash(key: str, kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256)


def _number(key: str, kind: str, value: Column) -> Column:
    return F.conv(F.substring(_hash(key, kind, value), 1, 12), 16, 10).cast("long")


def _permuted(key: str, kind: str, digits: Column, n: int) -> Column:
    """A keyed permutation of the n-digit strings."""
    a, b = n // 2, n - n // 2
    pair = F.struct(F.substring(digits, 1, a).cast("long").alias("l"), F.substring(digits, a + 1, b).cast("long").alias("r"))
    # one element at a time, so that a round's result is made once
    out = F.aggregate(
        F.array(*[F.lit(i) for i in range(6)]),
        pair,
        lambda s, i: F.when(
            i % 2 == 0,
            F.struct(F.pmod(s["l"] + _number(key, kind, F.concat_ws("|", i, s["r"])), F.lit(10**a)).alias("l"), s["r"].alias("r")),
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _number(key, kind, F.concat_ws("|", i, s["l"])), F.lit(10**b)).alias("r"))),
        lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), b, "0")),
    )
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced, one by one, by those of digits."""
    return F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], F.substring(digits, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))
        ),
        lambda acc: acc["s"],
    )


def _luhn(fifteen: Column) -> Column:
    """The check digit that makes fifteen digits a valid card number."""
    total = F.aggregate(
        F.transform(F.filter(F.split(fifteen, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))).otherwise(c.cast("int"))),
        F.lit(0), lambda acc, x: acc + x,
    )
    return F.pmod(10 - total % 10, F.lit(10))


def kind_of(value: Column) -> Column:
    """Kind of an entity that PATTERN found."""
    return (
        F.when(F.contains(value, F.lit("@")), "email").when(value.rlike(r"^[0-9A-Fa-f]{32,64}$"), "token").when(value.rlike(rf"^(?:{_TITLES})\.?[ ]"), "name")
        .when(F.length(_digits(value)) == 16, F.when(value.rlike(r"^[0-9 -]+$"), "card").otherwise("phone"))
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").otherwise("phone")
    )


def bare_name(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:{_TITLES})\.?[ ]", "")


def surname(value: Column) -> Column:
    return F.substring_index(bare_name(value), " ", -1)


def canonical(value: Column) -> Column:
    """What two mentions of the same entity have in common."""
    kind = kind_of(value)
    return F.when(kind.isin("email", "token", "name"), F.lower(F.when(kind == "name", bare_name(value)).otherwise(value))).otherwise(_digits(value))


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "bcdfghjklmnpqrst")


def _cased(original: Column, made: Column) -> Column:
    """made in upper case where the original is, in lower case where it begins so, else with capitals."""
    first = F.substring(original, 1, 1)
    return F.when((F.upper(original) == original) & (F.lower(original) != original), F.upper(made)).when(F.lower(first) == first, F.lower(made)).otherwise(made)


def _salted(value: Column, salts: dict[str, int]) -> Column:
    """The value with the number of its draw, where it isn't the first."""
    if not salts:
        return value
    known = F.create_map(*[x for k, n in sorted(salts.items()) for x in (F.lit(k), F.lit(str(n)))])
    return F.concat_ws("#", value, F.try_element_at(known, value))


def _once(value: Column, use) -> Column:
    """use(value) with value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def script_of(value: Column) -> Column:
    """The place in SCRIPTS of a name's script."""
    return F.when(value.rlike(r"\p{IsCyrillic}"), 1).when(value.rlike(r"\p{IsGreek}"), 2).when(value.rlike(r"\p{IsArmenian}"), 3).otherwise(0)


def _pick(options: list[list[str]], script: Column, digit: Column) -> Column:
    """The option of that number, of the script's."""
    return F.get(F.split(F.get(F.array(*[F.lit(",".join(o)) for o in options]), script), ","), digit % len(options[0]))


def _syllables(h: Column, place: int, n: int, script: Column) -> Column:
    """n syllables from three hexadecimal digits each."""
    digit = lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int")
    one = lambda i: F.concat(*[_pick([SYLLABLES[w][k] for w in SCRIPTS], script, digit(i + k)) for k in range(3)])
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(place), F.lit(place + 3 * n - 3), F.lit(3)), one), ""))


def hashed(value: Column, key: str, salts: dict[str, int] | None = None) -> Column:
    """The surrogate of an address, a secret, or a bare name (one word: a surname; more: given names and a surname), in plain case; for names by gender and script use `named`."""
    known = _salted(F.lower(value), salts or {})
    domain = F.substring_index(F.lower(value), "@", -1)
    top = F.regexp_extract(domain, r"([^.]+)$", 1)
    fake_domain = F.concat(_letters(F.substring(_hash(key, "domain", domain), 1, 8)), F.lit(".example"), F.when(top.isin("com", "net", "org"), F.concat(F.lit("."), top)).otherwise(""))
    email = lambda h: F.concat(_letters(F.substring(h, 1, 16)), F.lit("@"), fake_domain)
    token = lambda h: F.substring(F.concat(h, _hash(key, "more", known)), F.lit(1), F.length(value))
    return _once(_hash(key, "entity", known), lambda h: F.when(F.contains(value, F.lit("@")), email(h)).otherwise(token(h)))


def family_name(value: Column, key: str, salts: dict[str, int] | None = None) -> Column:
    """The surrogate of a surname."""
    return _once(_hash(key, "surname", _salted(F.lower(value), salts or {})), lambda h: _cased(value, _syllables(h, 1, 4, script_of(value))))


def named(value: Column, key: str, salts: dict[str, int] | None = None) -> Column:
    """The surrogate of a name with its title."""
    female = value.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.?[ ]")

    def parts(x: Column) -> Column:
        bare, family, script = x["bare"], x["family"], x["script"]
        given = F.substring(bare, F.lit(1), F.length(bare) - F.length(family) - 1)
        # in plain case first: what follows the family's part is drawn from the whole name
        last = _once(_hash(key, "surname", _salted(F.lower(family), salts or {})), lambda h: _syllables(h, 1, 4, script))
        second = _once(_hash(key, "full", _salted(F.lower(bare), salts or {})), lambda h: F.lower(_syllables(h, 1, 3, script)))
        digit = F.conv(F.substring(_hash(key, "given", F.lower(given)), 1, 1), 16, 10).cast("int")
        # both genders' names of each script, one after the other
        first = _once(digit + F.when(female, 16).otherwise(0), lambda d: _pick([GIVEN[("m", w)] + GIVEN[("f", w)] for w in SCRIPTS], script, d))
        return F.when(given == "", _cased(family, last)).otherwise(F.concat(_cased(given, first), F.lit(" "), _cased(family, F.concat(last, second))))

    title = F.regexp_extract(value, rf"^(?:{_TITLES})\.?[ ]", 0)
    return F.concat(title, _once(F.struct(bare_name(value).alias("bare"), surname(value).alias("family"), script_of(bare_name(value)).alias("script")), parts))


def _telephone(key: str, ten: Column) -> Column:
    """A keyed permutation of ten-digit numbers that takes no first digit of area and exchange to 0 or 1 from another, or back."""
    rest = _permuted(key, "phone", F.concat(F.substring(ten, 2, 2), F.substring(ten, 5, 6)), 8)

    def first(place: int, kind: str, others: Column) -> Column:
        d = F.substring(ten, place, 1).cast("int")
        shift = _number(key, kind, others)
        return F.when(d > 1, 2 + F.pmod(d - 2 + shift, F.lit(8))).otherwise(F.pmod(d + shift, F.lit(2))).cast("string")

    return _once(rest, lambda r: F.concat(first(1, "area", r), F.substring(r, F.lit(1), F.lit(2)), first(4, "exchange", r), F.substring(r, F.lit(3), F.lit(6))))


def _social(key: str, nine: Column) -> Column:
    """A keyed permutation of nine digits, repeated until they could be a social-security number, eight times at most; no two end alike."""
    could = lambda d: ~d.rlike(r"^(?:000|666|9)|^...00|0000$")
    start = F.struct(nine.alias("d"), F.lit(False).alias("done"))
    step = lambda s, i: F.when(s["done"], s).otherwise(_once(_permuted(key, "ssn", s["d"], 9), lambda d: F.struct(d.alias("d"), could(d).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda s: s["d"])


def surrogate(value: Column, key: str, salts: dict[str, int] | None = None) -> Column:
    """The surrogate of one detected entity; salts: the draws of entities (canonical) that aren't the first."""
    digits = _digits(value)
    upper = (F.upper(value) == value) & (F.lower(value) != value)
    drawn = _once(hashed(value, key, salts), lambda d: F.when(upper, F.upper(d)).otherwise(d))

    fifteen = F.substring(digits, 1, 15)
    offset = F.pmod(F.substring(digits, 16, 1).cast("int") - _luhn(fifteen), F.lit(10))
    fake = _permuted(key, "card", fifteen, 15)
    card = F.transform(F.array(fake), lambda d: _refilled(value, F.concat(d, F.pmod(_luhn(d) + offset, F.lit(10)).cast("string"))))[0]

    last = F.substring(digits, -10, 10)
    phone = _refilled(value, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), _telephone(key, last)))
    ssn = _refilled(value, _social(key, digits))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    halves = F.struct((octets[0] * 256 + octets[1]).alias("l"), (octets[2] * 256 + octets[3]).alias("r"))
    ip = F.aggregate(
        F.array(*[F.lit(i) for i in range(4)]),
        halves,
        lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _number(key, "ip", F.concat_ws("|", i, s["r"])), F.lit(65536)).alias("r")),
        lambda s: F.concat_ws(".", F.expr("0").cast("long") + F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256),
    )
    return _once(
        kind_of(value),
        lambda kind: F.when(kind.isin("email", "token"), drawn).when(kind == "name", named(value, key, salts))
        .when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(ip),
    )


def entities(text: Column) -> Column:
    """All detected entities of a text, in order; an empty array where there are none."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def people(found: Column) -> Column:
    """The names with titles among a text's entities."""
    return F.filter(found, lambda e: e.rlike(rf"^(?:{_TITLES})\.?[ ]"))


def named_pattern(titled: Column) -> Column:
    """PATTERN, and the names of these people without a title, or their surnames, as whole words; longer ones first."""
    names = F.array_distinct(F.flatten(F.transform(titled, lambda t: F.array(bare_name(t), surname(t)))))
    names = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(f"({PATTERN}|{LEFT}(?:"), F.array_join(names, "|"), F.lit(f"){RIGHT})"))


def check(docs: DataFrame, key: str) -> dict[str, int]:
    """The draws of those entities of docs whose surrogate would be another's, or an entity that stands there; few (see above)."""
    found = docs.select(F.explode(F.array_distinct(entities(F.col("text").cast("string")))).alias("e")).withColumn("kind", kind_of(F.col("e"))).filter(F.col("kind").isin("email", "token", "name"))
    # a surname is an entity of its own; titles say only the gender of a given name
    alone = found.filter(F.col("kind") == "name").select(F.concat(F.lit("Mr "), surname(F.col("e"))).alias("e"), F.lit("name").alias("kind"))
    known = found.union(alone).withColumn("c", canonical(F.col("e"))).groupBy("kind", "c").agg(F.min("e").alias("e"))
    salts: dict[str, int] = {}
    tables = scratch.Tables()
    hidden = lambda value: _hash(key, "check", value)
    while True:
        made = F.lower(F.when(F.col("kind") == "name", bare_name(named(F.col("e"), key, salts))).otherwise(hashed(F.col("e"), key, salts)))
        drawn = tables.table(known.select("kind", hidden(F.col("c")).alias("c"), hidden(made).alias("s")), "hashes")
        both = drawn.select("kind", "s", "c").union(drawn.select("kind", F.col("c").alias("s"), F.lit(None).cast("string").alias("c")))
        # of those that share one the first keeps it, unless it stands in the corpus
        taken = both.groupBy("kind", "s").agg(F.count("*").alias("n"), F.count_if(F.col("c").isNull()).alias("real"), F.min("c").alias("least")).filter("n > 1 AND least IS NOT NULL")
        again = drawn.join(taken, ["kind", "s"]).filter("real > 0 OR c <> least").select("c").distinct()
        hashes = scratch.few(again, EXCEPTIONS)
        tables.drop(drawn)
        if hashes is None:
            raise RuntimeError(f"more than {EXCEPTIONS} entities share surrogates: use another key")
        if not hashes:
            return salts
        for r in known.filter(hidden(F.col("c")).isin([h["c"] for h in hashes])).select("c").distinct().collect():
            salts[r["c"]] = salts.get(r["c"], 0) + 1


def mask(docs: DataFrame, key: str, salts: dict[str, int] | None = None) -> DataFrame:
    """docs with each entity of text replaced, and a column n_entities (as `_n_entities` if that name is taken)."""
    salts = check(docs, key) if salts is None else salts
    name = scratch.fresh("n_entities", docs.columns)
    found, titled, gaps = (scratch.fresh(c, docs.columns) for c in ("found", "titled", "gaps"))
    text = F.col("text").cast("string")
    rows = docs.withColumn(found, entities(text)).withColumn(titled, people(F.col(found)))
    pattern = F.when(F.size(titled) > 0, named_pattern(F.col(titled))).otherwise(F.lit(f"({PATTERN})"))
    some = F.size(found) > 0
    rows = rows.withColumn(gaps, F.when(some, F.split(text, pattern, -1))).withColumn(found, F.when(F.size(titled) > 0, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.col(found)))

    def replaced(e: Column) -> Column:
        """A mention without a title takes the surrogate of the first with one that it may mean."""
        bare = F.get(F.filter(titled, lambda t: bare_name(t) == e), F.lit(0))
        family = F.exists(titled, lambda t: surname(t) == e)
        return F.when(bare.isNotNull(), bare_name(named(bare, key, salts))).when(family, family_name(e, key, salts)).otherwise(surrogate(e, key, salts))

    made = F.transform(found, replaced)
    pieces = F.zip_with(gaps, made, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    rows = rows.withColumn(name, F.size(found).cast("long"))
    return rows.withColumn("text", F.when(some, F.array_join(pieces, "")).otherwise(text)).select(*docs.columns, name)
