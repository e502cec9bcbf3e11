"""PII: detected entities are replaced by keyed surrogates of their type.

Detected are secrets (keyed hexadecimal strings and quoted tokens), e-mail addresses, IPv4 addresses, telephone, payment
card and social security numbers, and names after a title.  A surrogate depends on a secret key, the kind and the
normalised entity: the same entity has the same surrogate everywhere (coreference; case is matched per mention), names
are replaced word by word, so a surname alone and with a given name stay the same person.  Formats stay: lengths,
separators, country codes, top-level domains, issuer digits and valid check digits of cards, the gender of given names,
Latin, Cyrillic or Greek script.

Distinctness is checked, not hoped for: of entities of one kind whose surrogates collide with one another or with an
entity of the corpus, one at most keeps its surrogate, the others try again, until no collision is left.

All DataFrame functions.  Entities are counted before they are joined; only rows with entities are rebuilt.

Defined cases: a null text stays null; a text without entities stays as it is, byte by byte; rows equal in doc_id and
text are treated alike.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prunella.llm.common import table, written

KEY = "prunella-surrogates"
#: Turns of the collision check; each leaves a fraction of the collisions of the one before.
MAX_TURNS = 30
#: Up to so many mentions (each at most some hundred bytes, by the patterns) go to all executors; more are joined by a shuffle.
BROADCAST_MENTIONS = 100_000

# Titles with the gender of the given name that follows, and names by gender and script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "Госпожа", "Κυρία"),
    "": ("Dr", "Prof", "Professor", "Professorin", "Доктор", "Δρ"),
}
NAMES = {
    ("given_m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Noel Oscar Paul Robin Simon Tomas Victor",
    ("given_f", "latin"): "Alma Berta Clara Diana Elena Flora Greta Helena Irma Julia Karla Lea Maria Nora Olga Paula Rosa Sofia Tina Vera",
    ("surname", "latin"): "Abel Brand Costa Dorn Engel Falk Grau Hahn Iver Jansen Keller Lang Moser Nagel Ortiz Petri Roth Stein Thoma Vogt Weber Zorn",
    ("given_m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён",
    ("given_f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга Раиса Софья",
    ("surname", "cyrillic"): "Орлов Белов Волков Громов Зорин Карпов Лебедев Морозов Носков Панин Рыбин Соколов",
    ("given_m", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Νίκος Πέτρος",
    ("given_f", "greek"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία",
    ("surname", "greek"): "Αγγέλου Βασιλείου Γεωργίου Δήμου Κωστής Λάμπρου Μάνος Νικολάου",
}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(t for own in TITLES.values() for t in own)
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
KINDS = {
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
    r"|(?<=(?i:token|secret|password|passwd|api.?key) ?[=:] ?[\"'])[A-Za-z0-9+/_=-]{8,128}(?=[\"'])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,6}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\.?\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(KINDS.values())
#: What every entity has: texts without are passed by.
HINT = rf"[0-9@]|[\"']|(?:{_TITLE})\.? "


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def kind_of(match: Column) -> Column:
    whole = lambda p: match.rlike(rf"^(?:{p})$")
    out = F.lit("secret")
    for kind in ("card", "ssn", "phone", "ip", "email"):
        out = F.when(whole(KINDS[kind]), kind).otherwise(out)
    return F.when(match.rlike(rf"^(?:{_TITLE})\.? {_NAME}(?: {_NAME})?$"), "name").otherwise(out)


def mentions(docs: DataFrame) -> DataFrame:
    """rk, pos, part, kind, norm, lead and loud (all capitals) of each part of each entity of each text."""
    some = docs.where(F.col("text").rlike(HINT)).select(row_key().alias("rk"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("m"))
    one = some.where(F.size("m") > 0).select("rk", F.posexplode("m").alias("pos", "m")).withColumn("kind", kind_of(F.col("m")))
    words = F.split("m", " ")
    said = lambda own: F.col("m").rlike(rf"^(?:{'|'.join(TITLES[own])})\.? ")
    # A title for all goes with the gender of a known given name.
    women = [n.lower() for (kind, _), names in NAMES.items() if kind == "given_f" for n in names.split()]
    gender = F.when(said("m") | said("") & ~F.lower(F.try_element_at(words, F.lit(2))).isin(women), "given_m").otherwise("given_f")
    part = lambda kind, norm, lead: F.struct(kind.alias("kind"), norm.alias("norm"), lead.alias("lead"))
    surname = F.lit("surname")
    named = F.when(
        F.size(words) > 2,
        F.array(part(gender, words[1], F.concat(words[0], F.lit(" "))), part(surname, F.try_element_at(words, F.lit(3)), F.lit(" "))),
    ).otherwise(F.array(part(surname, F.try_element_at(words, F.lit(2)), F.concat(words[0], F.lit(" ")))))
    parts = F.when(F.col("kind") == "name", named).otherwise(F.array(part(F.col("kind"), F.col("m"), F.lit(""))))
    all_ = one.select("rk", "pos", F.posexplode(parts).alias("part", "p")).select("rk", "pos", "part", "p.kind", "p.norm", "p.lead")
    loud = (F.col("norm") == F.upper("norm")) & (F.col("norm") != F.lower("norm"))
    return all_.withColumn("loud", loud).withColumn("norm", F.lower("norm"))


def _keyed(norm: str, alphabet: str, keep: str = "false") -> str:
    """SQL: norm with each digit and letter replaced by one the key draws; `keep` tells characters (c at i) that stay."""
    v = "cast(conv(substr(h, 2 * (i % 64) + 1, 2), 16, 10) as int)"
    letters = f"""CASE WHEN c RLIKE '[\\\\p{{IsCyrillic}}]' THEN substr('{CYRILLIC}', {v} % {len(CYRILLIC)} + 1, 1)
        WHEN c RLIKE '[\\\\p{{IsGreek}}]' THEN substr('{GREEK}', {v} % {len(GREEK)} + 1, 1)
        WHEN c RLIKE '[\\\\p{{L}}]' THEN substr('{LATIN}', {v} % 26 + 1, 1) ELSE c END"""
    if alphabet == "hex":
        letters = f"CASE WHEN c BETWEEN 'a' AND 'f' THEN substr('0123456789abcdef', {v} % 16 + 1, 1) ELSE {letters} END"
        digits = f"substr('0123456789abcdef', {v} % 16 + 1, 1)"
    else:
        digits = f"cast({v} % 10 as string)"
    return f"""array_join(transform(split({norm}, ''), (c, i) -> CASE WHEN {keep} THEN c WHEN c BETWEEN '0' AND '9' THEN {digits} ELSE {letters} END), '')"""


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum, modulo 10, of a string of digits."""
    d = "cast(c as int)"
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN {d}
        ELSE 2 * {d} - IF(2 * {d} > 9, 9, 0) END), 0, (a, x) -> a + x) % 10"""


def _picked(names: Column, times: Column) -> Column:
    """`times` names that the key draws."""

    def one(k: Column) -> Column:
        drawn = F.sha2(F.concat_ws("|", "h", k.cast("string")).cast("binary"), 256)
        return F.element_at(names, F.conv(F.substring(drawn, 1, 6), 16, 10).cast("int") % F.size(names) + 1)

    return F.transform(F.sequence(F.lit(1), times), one)


def surrogates(entities: DataFrame) -> DataFrame:
    """entities (kind, norm, attempt) with `sur`, what key, kind, norm and attempt give."""
    rows = entities.withColumn("h", F.sha2(F.concat_ws("|", F.lit(KEY), "kind", F.col("attempt").cast("string"), "norm").cast("binary"), 512))
    octets = "concat_ws('.', transform(sequence(0, 3), k -> cast(cast(conv(substr(h, 6 * k + 1, 6), 16, 10) as int) % 254 + 1 as string)))"
    rows = rows.withColumn("tail", F.regexp_extract("norm", r"\.[^.@]+$", 0))
    email = f"concat({_keyed('substr(norm, 1, length(norm) - length(tail))', 'text')}, tail)"
    code = "length(regexp_extract(norm, '^[+][0-9]{1,3}', 0))"
    rows = rows.withColumn("drawn", F.expr(_keyed("norm", "text", "i = 0")))
    valid = F.expr(_luhn("regexp_replace(norm, '[^0-9]', '')")) == 0
    # With the last digit 0, the sum tells the check digit.
    body = "substr(drawn, 1, length(drawn) - 1)"
    check = f"cast((10 - {_luhn(f'''regexp_replace(concat({body}, '0'), '[^0-9]', '')''')}) % 10 as string)"
    card = F.when(valid, F.expr(f"concat({body}, {check})")).otherwise(F.col("drawn"))
    script = F.when(F.col("norm").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("norm").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    rows = rows.withColumn("script", script)
    # From the second attempt on names are double, from the fourth on triple, so that their number is never exhausted.
    times = F.expr("1 + int(attempt > 0) + attempt div 4")
    name = F.lit(None).cast("string")
    for (kind, s), names in NAMES.items():
        own = F.array(*(F.lit(n.lower()) for n in names.split()))
        pick = _picked(own, times)
        name = F.when((F.col("kind") == kind) & (F.col("script") == s), F.array_join(pick, "-")).otherwise(name)
    # A format that has few surrogates, or none but itself, grows by characters: one more every four attempts.
    more = "substr(translate(sha2(concat('more|', h), 256), '0123456789', {to}), 1, attempt div 4)"
    letters, digits = more.format(to="'ghijklmnop'"), f"translate({more.format(to=chr(39) + '0123456789' + chr(39))}, 'abcdef', '012345')"
    sur = (
        F.when(F.col("kind") == "secret", F.expr(f"concat({_keyed('norm', 'hex')}, {digits})"))
        .when(F.col("kind") == "email", F.expr(f"concat({letters}, {email})"))
        .when(F.col("kind") == "ip", F.expr(octets))
        .when(F.col("kind") == "phone", F.expr(f"concat({_keyed('norm', 'text', f'i < {code}')}, {digits})"))
        .when(F.col("kind") == "card", F.concat(card, F.expr(digits)))
        .when(F.col("kind") == "ssn", F.expr(f"concat({_keyed('norm', 'text')}, {digits})"))
        .otherwise(name)
    )
    return rows.select("kind", "norm", "attempt", sur.alias("sur"))


def distinct_surrogates(entities: DataFrame) -> DataFrame:
    """(kind, norm, sur) with surrogates that are different from each other and from all entities of their kind."""
    now = written(surrogates(entities.select("kind", "norm", F.lit(0).alias("attempt"))), "surrogates")
    taken = entities.select("kind", F.col("norm").alias("sur"), F.lit(True).alias("real"))
    for _ in range(MAX_TURNS):
        owner = now.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "norm")).alias("o"))
        seen = now.join(owner, ["kind", "sur"]).join(taken, ["kind", "sur"], "left")
        clash = F.col("real").isNotNull() | (F.col("norm") != F.col("o.norm"))
        seen = written(seen.select("kind", "norm", "attempt", "sur", clash.alias("clash")), "checked")
        if not seen.where("clash").limit(1).count():
            return seen.select("kind", "norm", "sur")
        again = surrogates(seen.where("clash").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        now = written(seen.where("not clash").select("kind", "norm", "attempt", "sur").union(again), "surrogates")
    raise ArithmeticError(f"surrogates still collide after {MAX_TURNS} turns")


def pseudonymised(docs: DataFrame) -> DataFrame:
    """doc_id, n_entities and text (with surrogates) of each row of docs."""
    found = written(mentions(docs), "mentions")
    entities = written(found.select("kind", "norm").distinct(), "entities")
    chosen = distinct_surrogates(entities)
    title = F.when(F.col("kind").isin("given_m", "given_f", "surname"), F.initcap(F.regexp_replace("sur", "-", "- "))).otherwise(F.col("sur"))
    shown = F.when(F.col("loud"), F.upper("sur")).otherwise(F.regexp_replace(title, "- ", "-"))
    said = found.join(chosen, ["kind", "norm"]).select("rk", "pos", "part", F.concat("lead", shown).alias("said"))
    # Rows equal in id and text have equal mentions: a set keeps one of each.
    rows = said.groupBy("rk").agg(F.sort_array(F.collect_set(F.struct("pos", "part", "said"))).alias("said"))
    rows = written(rows, "said")
    few = (rows.agg(F.sum(F.size("said"))).first()[0] or 0) <= BROADCAST_MENTIONS
    both = docs.select("doc_id", "text", row_key().alias("rk")).join(F.broadcast(rows) if few else rows, "rk", "left")
    both = both.withColumn("gaps", F.when(F.col("said").isNotNull(), F.split("text", PATTERN)))
    one = "array_join(transform(filter(said, s -> s.pos = i), s -> s.said), '')"
    text = F.expr(f"array_join(transform(gaps, (g, i) -> concat(g, {one})), '')")
    n = F.coalesce(F.size(F.array_distinct("said.pos")), F.lit(0)).cast("long")
    return both.select("doc_id", n.alias("n_entities"), F.when(F.col("said").isNull(), F.col("text")).otherwise(text).alias("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"))
