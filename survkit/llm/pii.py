"""Surrogates for personal data: every detected entity gets a keyed replacement of its own kind and format.

DataFrame functions only. Entities (e-mail and IP addresses, phone, card and social security numbers, secrets
after a key word, personal names after a title or with a listed given name) are found by one pattern. Each
distinct entity of the corpus gets one surrogate derived from a keyed hash of its canonical form (digits of a
number, lower-cased address, all groups of an IPv6 address, surname), so all mentions of it change alike, whatever their formatting. Rounds of
collision checks derive a surrogate anew while it equals another entity's surrogate or any real entity; where a
short entity's space has no free one, it gets longer from attempt to attempt. Formats stay: separators, lengths
(but for those), a number's first digit, a card's check digit, a name's title, gender, script and case.

Defined results: a null text stays null, an empty one empty; texts without entities are unchanged; repeated rows
and rows with a null id are treated like any other row; equal texts get equal replacements; all columns of the
input stay, n_chars follows the new text. Extra columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sealed, store

#: Titles and given names by script and gender; words that introduce a secret.
TITLES = {"m": "Mr Herr Monsieur Señor Sir", "f": "Mrs Ms Miss Frau Madame Mme Señora Lady", "": "Dr Prof"}
GIVEN = {
    ("latin", "m"): "James Robert Michael William David Thomas Charles Daniel Matthew Christopher Andreas Stefan Wolfgang Jürgen François Philippe Jacques Carlos Fernando Javier",
    ("latin", "f"): "Mary Patricia Jennifer Elizabeth Barbara Susan Margaret Katherine Victoria Deborah Sabine Ursula Brigitte Monika Geneviève Françoise Camille Carmen Lucía Dolores",
    ("cyrillic", "m"): "Александр Дмитрий Сергей Владимир Николай Михаил Алексей Андрей",
    ("cyrillic", "f"): "Екатерина Ольга Татьяна Наталья Светлана Людмила Галина Марина",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Βασίλης",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Γεωργία",
}
SYLLABLES = {"latin": "bar ten mor lin wes gal hol ker dan ros fel wick stan mar ley ton", "cyrillic": "бар тен мор лин вес гал хол кер дан рос фел вик стан мар лей тон", "greek": "παπ αδο νικ ολα κωσ τασ μαρ ινο λαμ προ δημ γεω στα θεο καρ βασ"}
SECRET_WORDS = "token|password|passwd|secret|api_key|apikey|access_key"

CAP, LOW = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я", "a-zß-öø-ÿά-ώа-яё"
_NAME = rf"[{CAP}][{LOW}]+(?:-[{CAP}][{LOW}]+)?"
#: A word that may be a name, whole.
WORD_NAME = rf"(?<![{CAP}{LOW}]){_NAME}(?![{LOW}])"
_TITLES = "|".join(" ".join(TITLES.values()).split())
_GIVENS = "|".join(" ".join(GIVEN.values()).split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: One alternative per kind; a look at the next character spares most places of a text the rest of it.
PATTERNS = {
    "secret": rf"(?<![A-Za-z_])(?=[tpsaTPSA])(?i:{SECRET_WORDS})\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[+/_\-]*[A-Za-z0-9])[A-Za-z0-9+/_\-]{{8,}}",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ip6": rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![0-9A-Za-z_:.])(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{7}}|(?!:{{0,2}}{_HEX}(?::{{1,2}}{_HEX}){{7}})(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z_:]|\.\d)",
    "card": r"(?=\d)(?<![\d.])\d{4}(?:[ \-]?\d{4}){3}(?!\d)|(?=3)(?<![\d.])3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?!\d)",
    "ssn": r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    # international with brackets, with a plus or 00 and up to 15 digits in groups of any length, shorter ones in groups;
    # national with an area code in brackets, as 3-3-4 digits, after a trunk 0 with one kind of separator
    "phone": r"\+\d{1,3}[ .\-]?\(\d{1,4}\)(?:[ .\-]?\d){4,12}(?!\d)|(?:(?<!\d)\+|(?=0)(?<![\d.\-/])00)[1-9](?:[ .\-]?\d){6,14}(?!\d)|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)"
    r"|(?=\()(?<!\d)\((?:\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|0\d{1,4}\)[ .\-]?\d{2,8}(?:[ .\-]\d{2,8}){0,3})(?!\d)|(?=\d)(?<![\d.\-])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![.\-]?\d)"
    r"|(?=0)(?<![\d.\-/])(?=\d+(?<sep>[ .\-/]))(?=(?:\d\k<sep>?){8,12}\d(?!\d))0[1-9]\d{0,3}\k<sep>\d{2,8}(?:\k<sep>\d{2,8}){0,4}(?!\d)",
    "name": rf"(?=[{CAP}])(?<![{CAP}{LOW}])(?:(?:{_TITLES})\.? (?:{_NAME} )?{_NAME}|(?:{_GIVENS}) {_NAME})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts that match none of these hold no entity.
HINT = rf"[0-9@=:]|(?=[{CAP}])(?:(?:{_TITLES})\.?|{_GIVENS}) [{CAP}]"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _given(key: str) -> dict[str, str]:
    """Each listed given name's replacement: a keyed rotation of its script's and gender's list."""
    out = {}
    for (script, gender), names in GIVEN.items():
        x = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
        out |= dict(zip(x, x[1:] + x[:1]))
    return out


def kind(e: Column) -> Column:
    """The kind of a matched string; the alternatives are tried in the pattern's order."""
    out = None
    for k, p in PATTERNS.items():
        hit = e.rlike(f"^(?:{p})$")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise("name")


SURNAME = rf"({_NAME})$"
SECRET_HEAD = rf"^((?i:{SECRET_WORDS})\s*[=:]\s*[\"']?)"


def _groups(e: Column) -> Column:
    """An IPv6 address as eight groups of four digits."""
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(e, "::"), F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(side(0)) - F.size(side(1)))
    return F.array_join(F.transform(F.concat(side(0), zeros, side(1)), lambda x: F.lpad(x, 4, "0")), ":")


def canonical(k: Column, e: Column) -> Column:
    return (
        F.when(k == "email", F.lower(e))
        .when(k == "ip", e)
        .when(k == "ip6", _groups(F.lower(e)))
        .when(k == "secret", F.regexp_replace(e, SECRET_HEAD, ""))
        .when(k == "name", F.lower(F.regexp_extract(e, SURNAME, 1)))
        .otherwise(F.regexp_replace(e, "[^0-9]", ""))
    )


#: SQL over (kind, canon, h): h has 64 hex digits of the keyed hash; byte i of it is a number below 256.
_BYTE = "CAST(conv(substr(h, CAST(({i} - 1) % 31 AS INT) * 2 + 1 + CAST(({i} - 1) / 31 AS INT) % 2, 2), 16, 10) AS INT)"
_B = _BYTE.format(i="i")
#: Attempts at an entity's own length; each later one adds a character, so that the rounds end.
OWN_LENGTH = 8
_MORE = f"greatest(0, attempt - {OWN_LENGTH - 1})"


def _chars(canon: str, keep: str = "false") -> str:
    """Each character by another of its class: digit, lower-case or upper-case letter; hexadecimal strings stay so."""
    return f"""array_join(transform(sequence(1, length({canon}) + {_MORE}), i -> CASE
        WHEN {keep} THEN substr({canon}, i, 1)
        WHEN {canon} rlike '^[0-9a-f]+$' THEN substr('0123456789abcdef', {_B} % 16 + 1, 1)
        WHEN i > length({canon}) OR substr({canon}, i, 1) rlike '[0-9]' THEN CAST({_B} % 10 AS STRING)
        WHEN substr({canon}, i, 1) rlike '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', {_B} % 26 + 1, 1)
        WHEN substr({canon}, i, 1) rlike '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', {_B} % 26 + 1, 1)
        ELSE substr({canon}, i, 1) END), '')"""


def _digits(canon: str) -> str:
    """Each digit but the first by another."""
    return f"array_join(transform(sequence(1, length({canon}) + {_MORE}), i -> IF(i = 1, substr({canon}, 1, 1), CAST({_B} % 10 AS STRING))), '')"


def _luhn(body: str) -> str:
    """The check digit of a card number without it."""
    d = f"CAST(substr({body}, length({body}) - i + 1, 1) AS INT)"
    return f"CAST((10 - aggregate(sequence(1, length({body})), 0, (s, i) -> s + IF(i % 2 = 1, IF({d} > 4, 2 * {d} - 9, 2 * {d}), {d})) % 10) % 10 AS STRING)"


def _surname(script: str) -> str:
    """Two syllables and one more per attempt."""
    s = SYLLABLES[script].split()
    arr = "array(" + ", ".join(f"'{x}'" for x in s) + ")"
    return f"array_join(transform(sequence(1, 3 + attempt), i -> element_at({arr}, {_B} % {len(s)} + 1)), '')"


def _script(canon: str) -> str:
    return f"CASE WHEN {canon} rlike '[а-яё]' THEN 'cyrillic' WHEN {canon} rlike '[α-ωά-ώ]' THEN 'greek' ELSE 'latin' END"


def surrogate() -> Column:
    """SQL of the surrogate's canonical form, from kind, canon, attempt and h."""
    local = "regexp_extract(canon, '^([^@]+)@', 1)"
    top = r"regexp_extract(canon, '\\.([a-z]+)$', 1)"
    body = "substr(filled, 1, length(filled) - 1)"
    # the feminine ending of a Cyrillic surname stays
    fem = "IF(canon rlike '(?:ова|ева|ина)$', 'ова', 'ов')"
    host = "array_join(transform(sequence(20, 25), i -> substr('abcdefghijklmnopqrstuvwxyz', " + _B + " % 26 + 1, 1)), '')"
    return F.expr(f"""CASE kind
        WHEN 'email' THEN concat({_chars(local)}, '@', {host}, '.example.', {top})
        WHEN 'ip' THEN concat_ws('.', {_BYTE.format(i="1")} % 223 + 1, {_BYTE.format(i="2")}, {_BYTE.format(i="3")}, {_BYTE.format(i="4")} % 254 + 1)
        WHEN 'ip6' THEN array_join(transform(sequence(1, 8), i -> substr(h, 4 * i - 3, 4)), ':')
        WHEN 'secret' THEN {_chars("canon")}
        WHEN 'card' THEN concat({body}, {_luhn(body)})
        WHEN 'name' THEN CASE {_script("canon")} WHEN 'cyrillic' THEN concat({_surname("cyrillic")}, {fem}) WHEN 'greek' THEN concat({_surname("greek")}, 'ς') ELSE {_surname("latin")} END
        ELSE filled END""")


def formatted(key: str) -> Column:
    """The replacement of a matched string ``e`` of ``kind`` with surrogate ``sur``, in the format of ``e``."""
    fill = "concat(array_join(transform(sequence(1, length(e)), i -> IF(substr(e, i, 1) rlike '[0-9]', substr(sur, length(regexp_replace(substr(e, 1, i), '[^0-9]', '')), 1), substr(e, i, 1))), ''), substr(sur, length(regexp_replace(e, '[^0-9]', '')) + 1))"
    head = F.regexp_extract("e", SECRET_HEAD, 1)
    front = F.regexp_replace("e", SURNAME, "")
    given = F.regexp_extract(front, rf"({_NAME}) $", 1)
    titled = F.regexp_extract(front, rf"^((?:{_TITLES})\.? )", 1)
    first = given.isin(*_TITLES.split("|"))
    # a given name that isn't listed is treated as a surname-like word of its own: its listed replacement, else an initial
    other = F.coalesce(F.element_at(_map(_given(key)), given), F.concat(F.substring(given, 1, 1), F.lit(".")))
    name = F.when((given == "") | first, front).otherwise(F.concat(titled, other, F.lit(" ")))
    return (
        F.when(F.col("kind").isin("email", "ip", "ip6"), F.col("sur"))
        .when(F.col("kind") == "secret", F.concat(head, "sur"))
        .when(F.col("kind") == "name", F.concat(name, F.initcap("sur")))
        .otherwise(F.expr(fill))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur) of distinct entities (kind, canon); no two of a kind share one and none is a real entity."""
    pending, done = entities.withColumn("attempt", F.lit(0)), None
    while True:
        seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
        c = pending.withColumn("h", F.sha2(seed, 256)).withColumn("filled", F.expr(_digits("canon")))
        # each step stored: the next one names its columns many times, and inlining would work them out each time
        c = store(store(c, "pii-hashes").withColumn("sur", surrogate()).select("kind", "canon", "attempt", "sur"), "pii-candidates")
        first = c.groupBy("kind", "sur").agg(F.min("canon").alias("keeper"))
        taken = entities.select("kind", F.col("canon").alias("sur"))
        if done is not None:
            taken = taken.union(done.select("kind", "sur"))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        c = c.join(first, ["kind", "sur"]).join(taken, ["kind", "sur"], "left")
        c = store(c.withColumn("ok", F.col("taken").isNull() & (F.col("canon") == F.col("keeper"))).drop("taken", "keeper"), "pii-surrogates")
        good = c.where("ok").select("kind", "canon", "sur")
        done = good if done is None else done.union(good)
        pending = c.where("NOT ok").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done


def _named() -> Column:
    """Words of a personal name ``e`` with their replacements in ``new``: the surname's, and a given name's if there is one."""
    given = F.regexp_extract(F.regexp_replace("e", SURNAME, ""), rf"({_NAME}) $", 1)
    fresh = F.regexp_extract("new", r"(\S+) \S+$", 1)
    pairs = F.array(
        F.struct(F.regexp_extract("e", SURNAME, 1).alias("key"), F.initcap("sur").alias("value")),
        F.struct(F.when(~given.isin("", *_TITLES.split("|")), given).alias("key"), fresh.alias("value")),
    )
    return F.when(F.col("kind") == "name", F.filter(pairs, lambda p: p["key"].isNotNull()))


def replace(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``counts`` also n_entities and kinds (sorted, distinct), in place of columns so named.

    ``key`` is the caller's secret: who has it can work out the replacements. A surname or given name that is found
    once in a document is replaced wherever the document has that word.
    """
    if not key:
        raise ValueError("surrogates need a key")
    pat, name_pat = (p.replace("\\", "\\\\").replace("'", "\\'") for p in (PATTERN, WORD_NAME))
    d, opened = sealed(docs, "doc_id", "text", "n_chars")
    d = d.withColumn("__maybe", F.coalesce(F.col("text").rlike(HINT), F.lit(False)))
    some = d.where("__maybe").drop("__maybe")
    hits = some.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("es"))
    # stored before the filter, which would otherwise be pushed below and match the pattern a second time
    hits = store(hits, "pii-hits").where("size(es) > 0").dropDuplicates(["__id", "__th"])
    each = hits.select("__id", "__th", F.posexplode_outer("es").alias("pos", "e")).withColumn("kind", kind(F.col("e"))).withColumn("canon", canonical(F.col("kind"), F.col("e")))
    each = store(each, "pii-mentions")
    found = surrogates(store(each.select("kind", "canon").distinct(), "pii-entities"), key)
    new = each.join(found, ["kind", "canon"]).withColumn("new", formatted(key)).withColumn("named", _named())
    new = new.groupBy("__id", "__th").agg(
        F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("__new"),
        F.sort_array(F.collect_set("kind")).alias("__kinds"),
        F.array_distinct(F.flatten(F.collect_set("named"))).alias("__pairs"),
    )
    # of a word with several replacements (a given name that is a surname elsewhere) the least counts
    least = "aggregate(array_sort(__pairs), array(cast(null as struct<key:string,value:string>)), (s, x) -> IF(exists(s, y -> y.key = x.key), s, concat(s, array(x))), s -> map_from_entries(filter(s, y -> y.key IS NOT NULL)))"
    new = new.withColumn("__new", F.expr("transform(__new, x -> x.new)")).withColumn("__named", F.expr(least)).drop("__pairs")
    some = some.withColumn("__h", F.xxhash64("text")).join(new, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    # between the entities: other mentions of the names
    words = f"array_join(transform(arrays_zip(split(p, '{name_pat}', -1), regexp_extract_all(p, '{name_pat}', 0)), z -> concat(z.`0`, coalesce(element_at(__named, z.`1`), z.`1`, ''))), '')"
    between = f"IF(size(__named) > 0 AND p != '', {words}, p)"
    text = F.expr(f"array_join(transform(split(text, '{pat}', -1), (p, i) -> concat({between}, coalesce(get(__new, i), ''))), '')")
    some = some.withColumn("text", F.when(F.col("__new").isNull(), F.col("text")).otherwise(text))
    rest = d.where("NOT __maybe").drop("__maybe")
    extra = []
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    if counts:
        extra = ["n_entities", "kinds"]
        some = some.withColumn("n_entities", F.coalesce(F.size("__new"), F.lit(0)).cast("long")).withColumn("n_entities", F.greatest("n_entities", F.lit(0).cast("long")))
        some = some.withColumn("kinds", F.coalesce("__kinds", F.expr("CAST(array() AS array<string>)")))
        rest = rest.withColumn("n_entities", F.lit(0).cast("long")).withColumn("kinds", F.expr("CAST(array() AS array<string>)"))
    return opened(some, *extra).union(opened(rest, *extra))


#: The key of the registered query and of the pipeline over the given tables, which hold invented data.
TABLES_KEY = "invented data"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(read(spark, sf_dir, "documents").select("doc_id", "text"), TABLES_KEY, counts=True)
