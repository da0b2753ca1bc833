"""Keyed surrogates for personal data.

Detected entities (mail and network addresses, card, account, social security and phone numbers,
secrets, names behind a form of address) are replaced by made-up ones of the same type and
format: digits by digits, letters by letters of the same case, octets by octets of the same
length (where these are used up, of any length), names by syllables of the same script with an ending of the same gender.

A surrogate is drawn from SHA-512 of the key, the type, the canonical entity and an attempt
number. Mentions that differ only in case or punctuation have one canonical form, so they stay
coreferent in the whole corpus. Surrogates are checked against each other and against all
originals of their type: of those that collide all but one draw again.

Only DataFrame functions are used. Texts without anything like an entity skip the search. No pattern
looks further than a bounded way from a place where it finds nothing (the part of a mail address
before the @ has at most 64 characters, as the standard says), so long unbroken texts take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, lookup, text_key

KEY = "corpus-surrogates"
MOST_ATTEMPTS = 40
#: After every so many draws names, mail and network addresses have a larger space.
WIDEN_AFTER = 4
MALE = "Mr|Herr|Monsieur|Señor|Don|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Doña|госпожа"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
TYPES = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?<=(?i:token|secret|passw|password|key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+=-]{8,}"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "male": rf"\b(?:{MALE})\.? {_NAME}(?: {_NAME})?",
    "female": rf"\b(?:{FEMALE})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: What every entity has somewhere; cheap to look for.
HINT = rf"[0-9@]|(?i:token|secret|passw|key)|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
_SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke la le li lo ma me mi mo na ne ra re ri ro sa se ta te to va ve vi".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ла ле ли ло ма ме ми мо на не ра ре ри ро са се та те то ва ве ви".split(),
}
_ENDINGS = {
    ("latin", "male"): ["ro", "lan", "tor", "mund"],
    ("latin", "female"): ["na", "lia", "ine", "tte"],
    ("cyrillic", "male"): ["ров", "лин", "ский", "мин"],
    ("cyrillic", "female"): ["рова", "лина", "ская", "мина"],
}


def mentions(text: Column) -> Column:
    """Entities of a text in order, repeats included."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first whose pattern is the whole of it."""
    hex_only = r"^[0-9A-Fa-f]{32,128}$"
    kind = F.when(mention.rlike(f"^(?:{TYPES['email']})$"), "email")
    for name in ("male", "female"):
        kind = kind.when(mention.rlike(f"^(?:{TYPES[name]})$"), name)
    kind = kind.when(mention.rlike(hex_only), "secret")
    for name in ("iban", "ip", "ssn", "card", "phone"):
        kind = kind.when(mention.rlike(f"^(?:{TYPES[name]})$"), name)
    return kind.otherwise("secret")


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity share. A person is known by the last name."""
    return (
        F.when(kind.isin("male", "female"), F.lower(F.element_at(F.split(mention, " "), -1)))
        .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(mention, r"[^\d]", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(mention))
        .otherwise(mention)
    )


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.encode(F.concat(seed, F.lit(f"|{i}")), "UTF-8"), 512) for i in range(2)])


def _number(stream: Column, place: Column, below: int) -> Column:
    """The number in [0, below) at a place of the stream; places repeat after 64."""
    part = F.substring(stream, (F.pmod(place, F.lit(64)) * 4 + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(part, 16, 10).cast("int"), F.lit(below))


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(values)), " "), number + 1)


def _by_character(mention: Column, stream: Column, place: Column, hexes: Column) -> Column:
    """Characters of the format kept; `place(i)` is the place in the stream of character i."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c: Column, i: Column) -> Column:
        at = place(i)
        letters = F.when(hexes, _number(stream, at, 6)).otherwise(_number(stream, at, 26)) + 1
        return (
            F.when(c.rlike("[0-9]"), _number(stream, at, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.lit(lower), letters, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit(upper), letters, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def _name(name: Column, kind: Column, stream: Column, start: int, more: Column) -> Column:
    """A name of 3 and `more` syllables with the script, gender and capitals of `name`."""

    def of(script: str, gender: str) -> Column:
        parts = [_pick(_SYLLABLES[script], _number(stream, F.lit(start + i), 32)) for i in range(3)]
        longer = F.transform(F.sequence(F.lit(0), more), lambda i: _pick(_SYLLABLES[script], _number(stream, i + 16, 32)))
        parts.append(F.array_join(F.slice(longer, F.lit(1), more), ""))
        return F.concat(*parts, _pick(_ENDINGS[script, gender], _number(stream, F.lit(start + 3), 4)))

    made = F.when(name.rlike(r"\p{IsCyrillic}"), F.when(kind == "male", of("cyrillic", "male")).otherwise(of("cyrillic", "female")))
    made = made.otherwise(F.when(kind == "male", of("latin", "male")).otherwise(of("latin", "female")))
    return F.when((F.upper(name) == name) & (F.length(name) > 1), F.upper(made)).otherwise(F.initcap(made))


def code_digits(mention: Column) -> Column:
    """Length of the country code that a phone mention shows, null where it shows none."""
    return F.nullif(F.length(F.regexp_extract(mention, r"^\+(\d{1,3})(?=[ .(-])", 1)), F.lit(0))


def surrogate(kind: Column, mention: Column, stream: Column, code: Column, attempt: Column) -> Column:
    """The replacement of one mention. `code` digits of a phone number stay, the same for all its mentions.
    Later attempts draw longer names and mail addresses and octets of any length."""
    more = F.floor(attempt / WIDEN_AFTER).cast("int")
    digit_rank = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^\d]", ""))
    no = F.lit(False)
    same = lambda i: i
    flat = lambda i: F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))

    def phone_digit(c: Column, i: Column) -> Column:
        drawn = c.rlike("[0-9]") & (digit_rank(i) >= code)
        return F.when(drawn, _number(stream, digit_rank(i), 10).cast("string")).otherwise(c)

    def octet(o: Column, i: Column) -> Column:
        return (
            F.when(more > 0, _number(stream, i, 256))
            .when(F.length(o) == 1, _number(stream, i, 10))
            .when(F.length(o) == 2, _number(stream, i, 90) + 10)
            .otherwise(_number(stream, i, 156) + 100)
            .cast("string")
        )

    top = F.regexp_extract(mention, r"\.[A-Za-z]{2,}$", 0)
    before_top = F.substring(mention, F.lit(1), F.length(mention) - F.length(top))
    title = F.regexp_extract(mention, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    names = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    given_stream = F.sha2(F.concat(stream, F.lower(F.get(names, F.lit(0)))), 512)
    given = F.when(F.size(names) > 1, F.concat(_name(F.get(names, F.lit(0)), kind, F.concat(given_stream, given_stream), 8, F.lit(0)), F.lit(" "))).otherwise("")
    return (
        F.when(kind == "email", F.concat(F.substring(stream, F.lit(201), more), _by_character(before_top, stream, same, no), top))
        .when(kind == "ip", F.array_join(F.transform(F.split(mention, r"\."), octet), "."))
        .when(kind.isin("male", "female"), F.concat(title, given, _name(F.element_at(names, -1), kind, stream, 0, more)))
        .when(kind == "phone", F.array_join(F.transform(F.split(mention, ""), phone_digit), ""))
        .when(kind.isin("card", "ssn"), _by_character(mention, stream, digit_rank, no))
        .when(kind == "iban", F.concat(F.substring(mention, 1, 2), _by_character(F.substring(mention, F.lit(3), F.lit(64)), stream, lambda i: flat(i + 2), no)))
        .otherwise(_by_character(mention, stream, same, mention.rlike(r"^[0-9A-Fa-f]+$")))
    )


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt, code) of distinct (kind, canon), so that no two entities of a kind share a
    surrogate and no surrogate is an entity of its kind."""
    pending = entities.select("kind", "canon", "sample", "code").withColumn("attempt", F.lit(0))
    originals = entities.select("kind", F.col("canon").alias("made"))
    settled = None
    for _ in range(MOST_ATTEMPTS):
        stream = _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))
        drawn = pending.withColumn("drawn", surrogate(F.col("kind"), F.col("sample"), stream, F.col("code"), F.col("attempt")))
        drawn = drawn.withColumn("made", canonical(F.col("kind"), F.col("drawn"))).drop("drawn")
        taken = originals if settled is None else originals.union(settled.select("kind", "made"))
        free = drawn.join(taken.withColumn("used", F.lit(True)).distinct(), ["kind", "made"], "left")
        first = F.row_number().over(W.partitionBy("kind", "made").orderBy("canon")) == 1
        judged = checkpoint(free.withColumn("good", F.col("used").isNull() & first))
        good = judged.filter("good").select("kind", "canon", "attempt", "made", "code")
        settled = good if settled is None else settled.union(good)
        pending = judged.filter("not good").select("kind", "canon", "sample", "code", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled.select("kind", "canon", "attempt", "code")
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} draws")


def replace_entities(docs: DataFrame, key: str = KEY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_entities), one row per row of `docs`, entities replaced.

    Texts without entities come back as they are, null as null. Ids are only carried along, so
    they may be null or repeated; equal texts get equal replacements. An empty table gives no
    rows, other columns are not looked at.
    """
    source = docs.select(
        F.col(id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("key")
    )
    texts = (
        source.select("key", F.array_distinct(mentions(F.col("text"))).alias("own"))
        .filter(F.size("own") > 0)
        .groupBy("key")
        .agg(F.first("own").alias("own"), F.count("*").alias("n"))
    )
    texts = checkpoint(texts)
    pairs = texts.select("key", F.explode("own").alias("mention"))
    known = pairs.groupBy("mention").agg(F.count("*").alias("uses")).withColumn("kind", kind_of(F.col("mention")))
    known = checkpoint(known.withColumn("canon", canonical(F.col("kind"), F.col("mention"))))
    entities = known.groupBy("kind", "canon").agg(
        F.min("mention").alias("sample"), F.coalesce(F.min(code_digits(F.col("mention"))), F.lit(0)).alias("code")
    )
    drawn = known.join(assign(checkpoint(entities), key), ["kind", "canon"])
    stream = _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    changes = checkpoint(
        drawn.select(
            "mention", "uses", surrogate(F.col("kind"), F.col("mention"), stream, F.col("code"), F.col("attempt")).alias("made")
        )
    )
    by_text = (
        lookup(pairs, changes, "mention", "uses", ["key"])
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("mention", "made"))).alias("changes"))
        .join(texts.select("key", "n"), "key")
    )
    joined = lookup(source, checkpoint(by_text), "key", "n", ["doc_id"])
    parts = joined.select(
        "doc_id",
        "text",
        "changes",
        F.when(F.col("changes").isNotNull(), F.split("text", PATTERN, -1)).alias("between"),
        F.when(F.col("changes").isNotNull(), mentions(F.col("text"))).alias("found"),
    )
    rebuilt = F.array_join(
        F.zip_with(
            "between",
            "found",
            lambda gap, m: F.concat(gap, F.coalesce(F.element_at(F.col("changes"), m), m, F.lit(""))),
        ),
        "",
    )
    return parts.select(
        "doc_id",
        F.when(F.col("changes").isNotNull(), rebuilt).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"),
    )
