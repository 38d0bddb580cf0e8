"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Mentions are found by one pattern. A mention's entity is its type and canonical value (an e-mail address in
lower case, the digits of a number, a surname), so all spellings of one entity share one surrogate: text stays
coreferent. Candidates are drawn from a hash of key, type, value and attempt, in the format of the value:
letters for letters, digits for digits, a phone's country code and a card's first digit and checksum kept,
octets for octets, surnames in their script, given names of the same gender and script. In rounds, a candidate
that another entity holds or that is itself a real value in the corpus is drawn again, until all surrogates are
distinct. Each mention is then written in its own punctuation and case.

Only distinct entities are gathered, pre-aggregated. Documents with mentions are joined by the digest of their
text to one row of replacements per distinct text; hot entities and hot texts are salted. Documents without
mentions are never shuffled.

Defined cases: null texts stay null, empty texts empty; repeated rows are replaced alike; a text of any length
is scanned whole; an empty table gives no rows; all columns are kept as they were, n_chars (if there) is counted
anew. IBAN check digits are drawn like the other digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, salted_join, stored, union_all

ROUNDS = 64
# Given names by script and gender; a name is replaced by another of its list.
NAMES = {
    "latin_f": ["Maria", "Julia", "Sophia", "Emma", "Olivia", "Laura", "Klara", "Camille", "Lucía", "Carmen", "Charlotte", "Zoë"],
    "latin_m": ["James", "Robert", "Michael", "William", "David", "Thomas", "Lukas", "Pierre", "Carlos", "Miguel", "Jürgen", "Hugo"],
    "cyrillic_f": ["Мария", "Ольга", "Елена", "Наталья", "Светлана", "Татьяна"],
    "cyrillic_m": ["Иван", "Сергей", "Дмитрий", "Николай", "Владимир", "Борис"],
}
# Titles by gender; the title itself stays.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Señora", "Госпожа"], "m": ["Mr", "Herr", "Señor", "Господин"]}
SYLLABLES = {
    "latin": ["bar", "col", "den", "fal", "gor", "hal", "kem", "lin", "mor", "nev", "pol", "ros", "sul", "tam", "vel", "wick"],
    "cyrillic": ["бар", "вол", "гор", "дан", "жар", "зим", "кол", "лис", "мор", "нов", "пет", "руд", "сав", "тур", "фед", "яс"],
}
_GIVEN = "|".join(n for names in NAMES.values() for n in names)
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}\p{L}++"
# One alternative per type, in order of precedence; possessive runs behind a boundary keep the scan linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}._+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "card": r"(?<![\p{L}\p{N}.])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? (?:{_WORD} )?{_WORD}|(?:{_GIVEN}) {_WORD})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def type_of(mention: Column) -> Column:
    """The first type whose pattern is the whole mention."""
    out = F.lit("name")
    for name in reversed(list(PATTERNS)[:-1]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    last = F.substring_index(mention, " ", -1)
    return (
        F.when(kind.isin("email", "secret"), F.lower(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.lit("+")).otherwise(F.lit("")), _digits(mention)))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "name", F.initcap(last)).otherwise(mention)
    )


def _draw(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hexadecimal digits of a keyed hash."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(key))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _byte(draw: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(draw, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, draw: Column) -> Column:
    """Digits for digits and letters of the same case for letters; other characters stay."""

    def one(i: Column) -> Column:
        c, b = F.substring(value, i + 1, F.lit(1)), _byte(draw, i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.char(F.lit(65) + F.pmod(b, F.lit(26))))
            .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + F.pmod(b, F.lit(26)))).otherwise(c)
        )

    return F.when(F.length(value) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")).otherwise(F.lit(""))


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string modulo 10; 0 for a valid card."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.pmod(F.aggregate(F.transform(chars, one), F.lit(0), lambda a, x: a + x), F.lit(10))


def candidate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A surrogate in the format of ``canon``. Late attempts leave the narrowest formats for wider ones."""
    draw = _draw(key, kind, canon, attempt)
    local, wider = F.substring_index(canon, "@", 1), F.when(attempt > 8, F.substring(draw, 100, 8)).otherwise(F.lit(""))
    email = F.concat(_shaped(local, draw), wider, F.lit("@m"), F.substring(draw, 90, 4), F.lit(".example.org"))
    code = F.regexp_extract(canon, r"^(\+1|\+7|\+\d{2})?", 0)
    phone = F.concat(code, _shaped(F.substring(canon, F.length(code) + 1, F.length(canon)), draw))
    body = F.concat(F.substring(canon, 1, 1), _shaped(F.substring(canon, F.lit(2), F.length(canon) - 2), draw))
    valid = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    # a number that was not a valid card gets none
    last = F.when(_luhn(canon) == 0, valid).otherwise(F.pmod(valid + F.lit(1) + F.pmod(_byte(draw, 40), F.lit(9)), F.lit(10)))
    octets = F.concat_ws(".", (F.lit(1) + F.pmod(_byte(draw, 1), F.lit(223))).cast("string"), *[_byte(draw, i).cast("string") for i in (2, 3, 4)])
    script = lambda name: F.array(*[F.lit(x) for x in SYLLABLES[name]])
    made = F.when(canon.rlike(r"\p{IsCyrillic}"), script("cyrillic")).otherwise(script("latin"))
    many = F.lit(3) + F.when(attempt > 2, F.lit(2)).otherwise(F.lit(0))
    surname = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), many), lambda i: F.element_at(made, F.pmod(_byte(draw, i), F.lit(16)) + 1)), ""))
    hexed = F.when(canon.rlike("^[0-9a-f]+$"), F.substring(draw, F.lit(1), F.length(canon))).otherwise(
        F.concat(F.regexp_extract(canon, "^(?:akia|ghp_|sk-)", 0), _shaped(F.regexp_replace(canon, "^(?:akia|ghp_|sk-)", ""), draw)))
    iban = F.concat(F.substring(canon, 1, 2), _shaped(F.substring(canon, F.lit(3), F.length(canon)), draw))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", F.concat(body, last.cast("string")))
        .when(kind == "ssn", _shaped(canon, draw)).when(kind == "ip", octets).when(kind == "secret", hexed).when(kind == "iban", iban)
        .otherwise(surname)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, n) -> the same with ``surrogate``: distinct within a kind, and no value of the input."""
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    left, done = entities.withColumn("attempt", F.lit(0)), []
    for _ in range(ROUNDS):
        drawn = left.withColumn("surrogate", candidate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        taken = union_all([real, *[d.select("kind", "surrogate") for d in done]])
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(taken, ["kind", "surrogate"], "left_anti")
        drawn = checkpointed(drawn.join(first.withColumn("won", F.lit(True)), ["kind", "canon", "surrogate"], "left"))
        done.append(drawn.where("won").select("kind", "canon", "n", "surrogate"))
        left = drawn.where("won IS NULL").select("kind", "canon", "n", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return union_all(done)
    raise RuntimeError("a format is too narrow for its entities; raise ROUNDS")


def _given(mention: Column, key: str, draw: Column) -> Column:
    """The mention's title and given name, the latter replaced within its gender and script."""
    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\.? )", 1)
    word = F.regexp_extract(F.substring(mention, F.length(title) + 1, F.length(mention)), rf"^({_WORD}) {_WORD}$", 1)
    woman = F.rtrim(F.replace(title, F.lit("."), F.lit(""))).isin(TITLES["f"])
    out = None
    for group, names in NAMES.items():
        listed = F.array(*[F.lit(n) for n in names])
        # a keyed rotation: no name stays, no two names meet
        turn = F.lit(1) + F.pmod(F.xxhash64(F.lit(f"{key}{group}")), F.lit(len(names) - 1)).cast("int")
        moved = F.element_at(listed, F.pmod(F.array_position(listed, word).cast("int") - 1 + turn, F.lit(len(names))) + 1)
        out = F.when(word.isin(names), moved) if out is None else out.when(word.isin(names), moved)
    for script, cyrillic in (("cyrillic", True), ("latin", False)):
        fits = word.rlike(r"\p{IsCyrillic}") if cyrillic else F.lit(True)
        for gender, is_it in (("f", woman), ("m", ~woman)):
            names = F.array(*[F.lit(n) for n in NAMES[f"{script}_{gender}"]])
            out = out.when((word != "") & fits & is_it, F.element_at(names, F.pmod(_byte(draw, 7), F.size(names)) + 1))
    return F.concat(title, F.when(word == "", F.lit("")).otherwise(F.concat(out, F.lit(" "))))


def rendered(kind: Column, mention: Column, surrogate: Column, key: str) -> Column:
    """``surrogate`` in the punctuation and case of ``mention``."""
    bare = F.regexp_replace(surrogate, "[^0-9A-Za-z]", "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(a: Column, c: Column) -> Column:
        use = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(a["s"], F.when(use, F.substring(bare, a["i"], F.lit(1))).otherwise(c)).alias("s"),
            (a["i"] + F.when(use, F.lit(1)).otherwise(F.lit(0))).alias("i"),
        )

    dotted = F.aggregate(F.split(mention, ""), start, step, lambda a: a["s"])
    cased = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    name = F.concat(_given(mention, key, _draw(key, kind, mention, F.lit(0))), surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), dotted).when(kind.isin("email", "secret"), cased)
        .when(kind == "name", name).otherwise(surrogate)
    )


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and ``n_replaced``."""
    keep = [c for c in docs.columns if c != "n_replaced"]
    found = F.col(text).rlike(PATTERN)
    rows = docs.select(*keep)
    hits = stored(
        rows.where(found).select(F.struct(*keep).alias("row"), F.col(text).alias("body"), F.sha2(text, 256).alias("sha")), "with-mentions"
    )
    mentions = hits.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("body").alias("body"))
    spoken = mentions.select("sha", "copies", F.posexplode(F.regexp_extract_all("body", F.lit(PATTERN), F.lit(0))).alias("pos", "mention"))
    kind = type_of(F.col("mention"))
    spoken = checkpointed(
        spoken.withColumn("kind", kind).withColumn("canon", canonical(F.col("kind"), F.col("mention")))
        .withColumn("entity", F.concat_ws("\x1f", "kind", "canon"))
    )
    entities = checkpointed(spoken.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n")))
    table = surrogate_table(entities, key).select(F.concat_ws("\x1f", "kind", "canon").alias("entity"), "n", "surrogate")
    named = salted_join(spoken, checkpointed(table), "entity", "n", F.xxhash64("sha", "pos"), "inner")
    written = named.withColumn("out", rendered(F.col("kind"), F.col("mention"), F.col("surrogate"), key))
    by_text = written.groupBy("sha").agg(
        F.max("copies").alias("copies"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]).alias("out")
    )
    pieces = F.split("body", PATTERN, -1)
    new = F.array_join(F.flatten(F.zip_with(pieces, F.col("out"), lambda p, o: F.array(p, F.coalesce(o, F.lit(""))))), "")
    joined = salted_join(hits, checkpointed(by_text), "sha", "copies", F.xxhash64("row"), "inner")
    others = [F.col("row")[c].alias(c) for c in keep if c != text]
    changed = joined.select(*others, new.alias(text), F.size("out").alias("n_replaced"))
    out = rows.where(~F.coalesce(found, F.lit(False))).withColumn("n_replaced", F.lit(0)).unionByName(changed)
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*keep, "n_replaced")
