"""PII surrogates by SQL functions alone: keyed, type-consistent replacements.

Entities: e-mail addresses, IPv4 addresses, phone and card numbers, social
security numbers, IBANs, long hexadecimal secrets, and the names of persons after
a title.  Given and family names are entities of their own, so that "Mr Smith"
and "Mrs Anna SMITH" stay one family; initials stay.  Each entity has a canonical
form without case and separators; a keyed SHA-256 of it yields the surrogate, so
every mention, in any document or format, gets the same one, dressed as the
mention is: separators, letter case, lengths, a title and its gender (after
titles of either gender, names in -a count as female), the script of letters, a
country code, valid Luhn and mod 97 sums where the original has them.  Addresses
get names below ``.example``, which nobody can own.

Collision check: the distinct entities' surrogates are compared with each other
and with all entities of the kind.  Of entities with one surrogate all but the
first, and any whose surrogate is another real entity, are drawn again, until
none is left.  A name gets a syllable more each time, an address more letters
from the fourth on, numbers a digit more from the 24th on; so it ends for any
number of entities.

Entities that were drawn again, few of them, set bits of a bitmap of fixed size.
Texts none of whose entities' bits are set are replaced where they stand; only the
others, and just the mentions in them, are joined to the entities drawn again.

Nulls: a null text stays null with no entities; an empty one stays empty.
Texts, rows and other columns are otherwise kept as they are; repeated rows get
equal results.  The count's column is named anew (``_n_entities``) if there is
one of its name.  Very long texts are taken as others.  An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"]
_EITHER = ["Dr", "Prof", "Доктор"]


def _titles(titles: list[str], *cases) -> str:
    return "|".join(case(t) for case in cases for t in titles)


_ANY = [*_MALE, *_FEMALE, *_EITHER]
_NAME, _CAPITALS = r"\p{Lu}[\p{L}'’-]*\p{L}", r"\p{Lu}[\p{Lu}'’-]*\p{Lu}"
_INITIALS = r"(?:\p{Lu}\. ?){0,2}"
#: What each kind looks like; of kinds that match at one place the first counts.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "phone": rf"{_BEFORE}(?:\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:(?:[ .-]?\d{{3,4}}){{2}}|(?:[ .-]?\d{{2}}){{3,4}})(?!\d)|\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d))",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": rf"{_BEFORE}(?:\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}}|\d{{13,19}}){_AFTER}",
    "secret": rf"{_BEFORE}(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{{32,128}}{_AFTER}",
    "iban": rf"{_BEFORE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_AFTER}",
    "person": rf"{_BEFORE}(?:(?:{_titles(_ANY, str, str.lower)})\.? {_INITIALS}{_NAME}(?: {_NAME})?|(?:{_titles(_ANY, str.upper)})\.? {_INITIALS}{_CAPITALS}(?: {_CAPITALS})?)",
}
PATTERN = "|".join(KINDS.values())
#: Bits of the bitmap of entities that were drawn again.
BITS = 1 << 18
_SYLLABLES = ["ba", "de", "fi", "go", "ha", "jo", "ka", "le", "mi", "no", "pe", "ra", "si", "to", "ve", "zu"]
_CYRILLIC = ["ба", "де", "фи", "го", "ха", "йо", "ка", "ле", "ми", "но", "пе", "ра", "си", "то", "ве", "зу"]


def kind(m: Column) -> Column:
    """The kind of a match."""
    out = F.lit("person")
    tests = [("iban", r"^[A-Z]{2}\d{2}"), ("secret", r"^[0-9a-fA-F]{32,}$"), ("card", r"^[0-9][0-9 -]{12,}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("phone", r"^[+(]"), ("ip", r"^[0-9]+\.[0-9.]+$"), ("email", "@")]
    for name, shape in tests:
        out = F.when(m.rlike(shape), name).otherwise(out)
    return out


def _names(m: Column) -> Column:
    """The names of a person's mention, without title and initials."""
    return F.split(F.regexp_replace(m, rf"^\S+ {_INITIALS}", ""), " ")


def _gender(m: Column) -> Column:
    """Of the given name in a person's mention: f or m."""
    title = F.lower(F.regexp_extract(m, r"^[^\s.]+", 0))
    woman = title.isin([t.lower() for t in _FEMALE]) | title.isin([t.lower() for t in _EITHER]) & F.lower(_names(m)[0]).rlike("[aа]$|я$")
    return F.when(woman, "f").otherwise("m")


def parts(m: Column) -> Column:
    """The entities of a mention: kind and canonical form, the form that mentions of one share."""
    k = kind(m)
    c = F.when(k == "phone", F.regexp_replace(m, "[^0-9+]", "")).when(k.isin("card", "ssn"), F.regexp_replace(m, "[^0-9]", "")).when(k == "iban", F.regexp_replace(m, " ", "")).otherwise(F.lower(m))

    def entity(k, c):
        return F.struct(k.alias("k"), c.alias("c"))

    family = entity(F.lit("family"), F.lower(F.element_at(_names(m), -1)))
    given = entity(F.lit("given"), F.concat(_gender(m), F.lit(" "), F.lower(_names(m)[0])))
    return F.when(k != "person", F.array(entity(k, c))).when(F.size(_names(m)) > 1, F.array(family, given)).otherwise(F.array(family))


def _stream(secret: str, *parts: Column) -> Column:
    """64 hexadecimal digits, keyed."""
    return F.sha2(F.concat_ws("\x1f", F.lit(secret), *parts), 256)


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "274906")


def _letters(c: Column, h: Column) -> Column:
    """A character of the class and script of ``c``, by the hexadecimal digit ``h``."""
    v = F.conv(h, 16, 10).cast("int")
    return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), F.substring(F.lit("абвгдежзиклмнопр"), 1, 16).substr(v + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.lit("abcdefghiklmnopr").substr(v + 1, F.lit(1))).otherwise(c)


def _spelled(text: Column, h: Column) -> Column:
    """Each letter and digit of a text replaced by one of its class."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _letters(c, h.substr(i % 64 + 1, F.lit(1)))), "")


def _syllables(h: Column, first: int, n: int, cyrillic: Column) -> Column:
    at = [F.conv(F.substring(h, first + i, 1), 16, 10).cast("int") + 1 for i in range(n)]
    latin = F.concat(*[F.element_at(F.array(*map(F.lit, _SYLLABLES)), i) for i in at])
    return F.when(cyrillic, F.concat(*[F.element_at(F.array(*map(F.lit, _CYRILLIC)), i) for i in at])).otherwise(latin)


def _longer(h: Column, first: int, attempt: Column, cyrillic: Column) -> Column:
    """A syllable for each attempt after the first, so that every round has 16 times the names of the one before."""
    def spelled(syllables):
        return F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.element_at(F.array(*map(F.lit, syllables)), F.conv(h.substr((i + first - 2) % 64 + 1, F.lit(1)), 16, 10).cast("int") + 1)), "")

    return F.when(attempt > 0, F.when(cyrillic, spelled(_CYRILLIC)).otherwise(spelled(_SYLLABLES))).otherwise("")


def _mod97(iban: Column) -> Column:
    """The remainder that tells whether an IBAN is valid (then it is 1)."""
    def step(a, c):
        return F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4)), ""), F.lit(0), step)


def key_stream(k: Column, c: Column, attempt: Column, secret: str) -> Column:
    """The keyed digits that an entity's surrogate is made from."""
    return _stream(secret, k, c, attempt.cast("string"))


def surrogate(k: Column, c: Column, attempt: Column, h: Column, secret: str) -> Column:
    """The canonical form of an entity's surrogate; ``h`` is its ``key_stream``."""
    d = _digits(h)
    more = F.when(attempt >= 24, F.substring(F.reverse(d), 1, 40).substr(F.lit(1), attempt - 23)).otherwise("")
    octets = [F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int") for i in range(4)]
    ip = F.concat_ws(".", (octets[0] % 223 + 1).cast("string"), *[o.cast("string") for o in octets[1:3]], (octets[3] % 254 + 1).cast("string"))
    ip = F.concat(ip, F.when(attempt >= 24, F.concat(F.lit("."), more)).otherwise(""))
    body = d.substr(F.lit(1), F.length(c) - 1)
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.concat(body, x.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    card = F.concat(F.when(F.call_function("luhn_check", c), check).otherwise(F.concat(body, F.substring(d, 64, 1))), more)
    plus = c.startswith("+")
    area = (F.conv(F.substring(h, 60, 1), 16, 10).cast("int") % 8 + 2).cast("string")
    phone = F.when(plus, F.concat(F.substring(c, 1, 2), area, d.substr(F.lit(1), F.length(c) - 3))).otherwise(F.concat(area, d.substr(F.lit(1), F.length(c) - 1)))
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    host = _spelled(F.regexp_replace(domain, r"\.[^.]*$", ""), _stream(secret, F.lit("domain"), domain))
    email = F.concat(_spelled(local, h), F.when(attempt >= 4, F.substring(h, 50, 8)).otherwise(""), F.lit("@"), host, F.lit(".example"))
    long = F.concat(h, _stream(secret, h)).substr(F.lit(1), F.length(c))
    account = F.upper(_spelled(F.lower(F.substring(c, 5, 99)), h))
    digits = F.lpad((98 - _mod97(F.concat(F.substring(c, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(c, 1, 2), F.when(_mod97(c) == 1, digits).otherwise(F.substring(d, 61, 2)), account, more)
    script = c.rlike(r"\p{IsCyrillic}")
    family = F.concat(_syllables(h, 1, 3, script), _longer(h, 4, attempt, script))
    ending = F.when(script, F.when(c.startswith("f"), "на").otherwise("н")).otherwise(F.when(c.startswith("f"), "na").otherwise("n"))
    given = F.concat(F.substring(c, 1, 2), family, ending)
    ssn = F.concat(d.substr(F.lit(1), F.lit(9)), more)
    return F.when(k == "ip", ip).when(k == "card", card).when(k == "phone", F.concat(phone, more)).when(k == "ssn", ssn).when(k == "email", email).when(k == "secret", long).when(k == "iban", iban).when(k == "given", given).otherwise(family)


def dressed(m: Column, k: Column, s: Column, given: Column) -> Column:
    """Canonical surrogates in the format of a mention; ``given`` is a person's given name's, or null."""
    def sign(c, i):
        before = F.length(F.regexp_replace(m.substr(F.lit(1), i), "[^0-9A-Z+]", ""))
        return F.when(c.rlike("[0-9A-Z+]"), s.substr(before + 1, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.split(m, ""), sign), "")
    filled = F.concat(filled, s.substr(F.length(F.regexp_replace(m, "[^0-9A-Z+]", "")) + 1, F.length(s)))
    cased = F.when((F.upper(m) == m) & (F.lower(m) != m), F.upper(s)).otherwise(s)

    def named(name, was):
        return F.when((F.upper(was) == was) & (F.length(was) > 1), F.upper(name)).otherwise(F.initcap(name))

    before = F.regexp_extract(m, rf"^\S+ {_INITIALS}", 0)
    person = F.concat(before, F.coalesce(F.concat(named(F.substring(given, 3, 9999), _names(m)[0]), F.lit(" ")), F.lit("")), named(s, F.element_at(_names(m), -1)))
    return F.when(k == "family", person).when(k.isin("phone", "card", "ssn", "iban"), filled).otherwise(cased)


def entities(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The distinct entities of the texts: kind, canonical."""
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(docs[text], F.lit(PATTERN), F.lit(0)))).alias("m"))
    return found.select(F.explode(parts(F.col("m"))).alias("e")).select(F.col("e.k").alias("kind"), F.col("e.c").alias("canonical")).distinct()


def assign(found: DataFrame, secret: str) -> DataFrame:
    """kind, canonical, attempt, surrogate of each entity: no two surrogates of a kind are the same, and none is an entity."""
    def drawn(rows: DataFrame) -> DataFrame:
        args = F.col("kind"), F.col("canonical"), F.col("attempt")
        rows = rows.withColumn("h", key_stream(*args, secret))
        return common.written(rows.withColumn("surrogate", surrogate(*args, F.col("h"), secret)).drop("h"), "entities")

    now = drawn(found.withColumn("attempt", F.lit(0)))
    while True:
        shared = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n")).where("n > 1")
        losers = now.join(shared, ["kind", "surrogate"]).where(F.col("canonical") != F.col("first.canonical")).select("kind", "canonical")
        real = now.select("kind", F.col("canonical").alias("surrogate"))
        losers = common.written(losers.union(now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canonical")).distinct(), "losers")
        if losers.isEmpty():
            return now
        again = now.join(losers.withColumn("lost", F.lit(1)), ["kind", "canonical"], "left")
        now = drawn(again.select("kind", "canonical", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt")))


def _bit(k: Column, c: Column) -> Column:
    return F.pmod(F.xxhash64(k, c), F.lit(BITS))


def _bitmap(drawn: DataFrame) -> Column:
    """The bits of entities in an array of longs: a constant of ``BITS / 8`` bytes, whatever the number of entities."""
    bit = _bit(F.col("kind"), F.col("canonical"))
    words = drawn.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("b")).collect()
    held = [0] * (BITS // 64)
    for r in words:
        held[r["w"]] = r["b"]
    return F.from_json(F.lit(str(held)), "array<long>")


def replace(docs: DataFrame, *, secret: str = "surrogates", text: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates for the entities in its texts, and their number."""
    found, again, row = (common.free_name(docs, x) for x in ("found_", "again_", "row_"))
    count_col = common.free_name(docs, count_col)
    drawn = common.written(assign(entities(docs, text=text), secret).where("attempt > 0").select("kind", "canonical", "attempt"), "redrawn")
    # an array in an array, so that matches are made once and not again for each use
    rows = docs.select("*", F.explode(F.array(F.regexp_extract_all(docs[text], F.lit(PATTERN), F.lit(0)))).alias(found))

    def replaced(rows: DataFrame, attempt) -> DataFrame:
        # step by step, so that each step's value is made once for each mention
        steps = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.transform(parts(m), lambda e, j: F.struct(e.k.alias("k"), e.c.alias("c"), attempt(i, j).alias("a"))).alias("p")))
        steps = F.transform(steps, lambda x: F.struct(x.m.alias("m"), F.transform(x.p, lambda e: F.struct(e.k.alias("k"), e.c.alias("c"), e.a.alias("a"), key_stream(e.k, e.c, e.a, secret).alias("h"))).alias("p")))
        steps = F.transform(steps, lambda x: F.struct(x.m.alias("m"), F.transform(x.p, lambda e: F.struct(e.k.alias("k"), surrogate(e.k, e.c, e.a, e.h, secret).alias("s"))).alias("p")))
        made = F.transform(steps, lambda x: dressed(x.m, x.p[0].k, x.p[0].s, F.try_element_at(x.p, F.lit(2)).s))
        whole = F.array_join(F.zip_with(F.split(F.col(text), PATTERN, -1), F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        out = F.when(F.size(found) > 0, whole).otherwise(F.col(text)).alias(text)
        count = F.coalesce(F.greatest(F.size(found), F.lit(0)), F.lit(0)).alias(count_col)
        return rows.select(*[out if c == text else F.col(f"`{c}`") for c in docs.columns], count)

    if drawn.isEmpty():
        return replaced(rows, lambda i, j: F.lit(0))
    bits = _bitmap(drawn)

    def marked(e):
        bit = _bit(e.k, e.c)
        return F.getbit(F.element_at(bits, (F.shiftright(bit, 6) + 1).cast("int")), (bit % 64).cast("int")) == 1

    may = F.coalesce(F.exists(F.flatten(F.transform(found, parts)), marked), F.lit(False))
    some = common.written(rows.where(may).withColumn(row, F.monotonically_increasing_id()), "mentions")
    each = some.select(row, F.posexplode(found).alias("i", "m")).select(row, "i", F.posexplode(parts(F.col("m"))).alias("j", "e"))
    each = each.select(row, (F.col("i") * 2 + F.col("j")).alias("at"), F.col("e.k").alias("kind"), F.col("e.c").alias("canonical")).join(drawn, ["kind", "canonical"])
    attempts = each.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias(again))
    some = some.join(attempts, row, "left")
    return replaced(rows.where(~may), lambda i, j: F.lit(0)).unionByName(replaced(some, lambda i, j: F.coalesce(F.try_element_at(F.col(again), i * 2 + j), F.lit(0))))
