"""Surrogates for personal data.

Detected entities get replacements of the same type, format, script and
gender, drawn by a keyed hash, so one identity has one surrogate everywhere.
An identity is an entity's canonical form: case, spacing and punctuation left
out where the type ignores them, titles of persons left out.  A person's given
names and surname are identities of their own, so "Mr. John Smith", "Mr Smith"
and a later bare "Smith" of the same text agree; the gender is that of the
title, else of the titles that the same full name has elsewhere, else of a
known given name.  Persons are found behind titles and from known given names
(``GIVEN``) followed by capitalised words; each of their name words is looked
up again in the same text.  Surrogates are
made per distinct identity; two that got the same surrogate, or a surrogate
that is a real identity of the corpus, are drawn again until none collide.
All expressions are built-in SQL functions.

Formats: digits stay digits and letters letters of their case and script;
card numbers keep their first digit and a valid check digit, IBANs their
country and check digits, addresses of hosts their four octets, keys their
prefix, mail addresses their top-level domain, persons their title, gender,
particles and number of names (names outside the Latin and Cyrillic scripts get
Latin ones).

Results of odd input: a null text stays null, an empty one empty, with no
entities; repeated rows are treated alike; an empty table gives an empty
result; a text without entities is untouched; the longest alternative found
first at a place wins; further columns are carried along, clashing ones
replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, stored

TITLES = {
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mlle", "Doña", "Госпожа"],
    "n": ["Dr", "Prof", "Mx"],
}
#: Given names that start a person's name without a title, by gender; names of both genders are in "n".
GIVEN = {
    "f": "Alice Amelia Andrea Angela Anna Anne Barbara Beatrice Birgit Camille Carla Carmen Caroline Catherine Charlotte Chiara Chloe Christina Claire Claudia "
         "Cristina Daniela Deborah Diana Dorothy Elena Elisabeth Elizabeth Ella Emily Emma Eva Fatima Franziska Françoise Gabriela Giulia Greta Hanna Hannah Heike Helen Helena "
         "Ida Ines Ingrid Irene Isabel Isabella Jane Jennifer Jessica Joan Johanna Judith Julia Juliette Karen Karin Katharina Katherine Laura Lena Linda Lisa Louise Lucia "
         "Lucy Luisa Margaret Maria Marie María Martha Mary Melissa Michelle Monica Monika Nancy Natalie Nicole Nina Nora Olga Olivia Patricia Paula Petra Pilar Rachel Rebecca Rosa Ruth "
         "Sabine Sandra Sara Sarah Silvia Sofia Sophia Sophie Stephanie Susan Susanne Teresa Ursula Valentina Valérie Vanessa Vera Victoria Virginia Yvonne "
         "Анна Вера Елена Ирина Мария Наталья Нина Ольга Светлана Тамара Татьяна Юлия",
    "m": "Adam Albert Alejandro Alexander Alfred Andreas Andrew Anthony Antoine Anton Antonio Arthur Benjamin Bernard Bernd Brian Bruno Carl Carlos Charles Christian Christopher Daniel "
         "David Diego Dieter Donald Edward Emil Enrique Eric Felix Fernando François Francisco Franz Frederick Friedrich Gabriel George Georg Gerard Giovanni Giuseppe Gregory Günter Hans Heinrich "
         "Henri Henry Hugo Ian Isaac Ivan Jack Jacques Jakob James Jan Javier Jeffrey Jens Johann Johannes John Jonas Jonathan Jorge Joseph José Joshua Juan Julian Jürgen Karl Kenneth Kevin "
         "Klaus Laurent Leonard Lucas Luis Lukas Manuel Marco Mario Martin Matthew Matthias Max Michael Michel Miguel Mohamed Mohammed Muhammad Nicholas Nicolas Oliver Olivier Oscar Pablo Patrick "
         "Paul Pedro Peter Philip Philippe Pierre Ralph Raymond Richard Robert Roger Ronald Samuel Sebastian Simon Stefan Stephen Steven Thomas Timothy Tobias Tom Victor Vincent Walter "
         "Werner William Wolfgang Xavier Александр Алексей Андрей Антон Борис Виктор Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей",
    "n": "Alex Ariel Billie Casey Charlie Dana Eden Finley Jamie Jordan Kim Lee Leslie Morgan Quinn Remy Riley Robin Sam Sasha Taylor Toni Саша Женя",
}
_KNOWN = {g: "|".join(v.split()) for g, v in GIVEN.items()}
_GIVEN = "|".join(n if n.isupper() else f"{n}|{n.upper()}" for v in GIVEN.values() for n in v.split())
_NAME = r"(?:\p{Lu}(?:\p{L}+(?:['’-]\p{L}{2,})*|(?:['’-]\p{L}{2,})+))"
_PARTICLES = "von|van|de|der|den|da|del|della|di|du|la|le|dos|das|zu|zur|ten|ter|bin|ibn|al|el|y"
#: A name word with the initials and particles before it.
_MORE = rf"(?:\p{{Lu}}\. ){{0,3}}(?:(?:{_PARTICLES}) ){{0,3}}{_NAME}"
#: What stands before a secret's value; it is part of the entity and stays.
_KEYED = r"""(?:(?i:password|passwd|pwd|token|secret|api_key|apikey|api-key)\s{0,3}[=:]\s{0,3}["']?)"""
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_TITLES = rf"(?:(?:{_TITLE})\.? )"

#: Words that make what stands before them a place or an organisation.
PLACE_HEADS = ("Airport Avenue Bank Bay Beach Boulevard Bridge Canyon Cape Castle Cathedral Church City Coast College Council County Court "
               "Creek Desert District Falls Forest Foundation Garden Gardens Glacier Group Gulf Harbor Harbour Highway Hill Hills Hospital "
               "Hotel House Inc Institute Island Islands Lake Library Ltd Memorial Mountain Mountains Museum Park Pass Peak Plaza Point "
               "Press Prize Province Ridge River Road School Sea Square Stadium Station Street Theatre Tower University Valley Village Ward")
_PLACE = "|".join(PLACE_HEADS.split())
#: Not a person: a known given name before a place word, as in "Victoria Falls".
_NO_PLACE = rf"(?!(?: \p{{Lu}}\p{{L}}+){{0,3}} (?:{_PLACE})(?!\p{{L}}))"

#: type -> pattern; earlier types win where several match at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"""{_KEYED}[A-Za-z0-9_+/.-]{{7,}}[A-Za-z0-9_+/=-]"""
              r"|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}|\b[0-9a-f]{32,64}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<!\d)\+\d{9,15}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]\d{2,4}){3,5}(?!\d)|(?<![\d.-])\d{2}(?:[ .]\d{2}){4}(?![\d.-]*\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{4} \d{4} \d{1,7})(?!\d)",
    "person": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLES}+{_MORE}(?: {_MORE}){{0,4}}|(?:{_GIVEN})(?:-\p{{Lu}}\p{{L}}+)?{_NO_PLACE}(?: {_MORE}){{1,4}})",
}
#: The same without look-around, to tell the type of an entity that was cut out; anything else is a secret.
WHOLE = PATTERNS | {
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{9,15}|\+\d{1,3}(?:[ .-]\d{2,4}){3,5}|\d{2}(?:[ .]\d{2}){4}",
    "card": r"\d{13,19}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{4} \d{4} \d{1,7}",
    "person": rf"(?:{_TITLES}+{_MORE}|(?:{_GIVEN})(?:-\p{{Lu}}\p{{L}}+)?)(?: {_MORE}){{0,4}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Given names by gender (Latin script), and by gender in Cyrillic.
NAMES = {
    "f": "Anna Clara Elena Emma Eva Flora Greta Hanna Ida Julia Laura Lena Maria Martha Nina Olga Paula Rosa Sara Sofia Tessa Vera",
    "m": "Adam Albert Anton Carl David Emil Felix Hugo Ivan Jan Jonas Leon Lukas Martin Max Oscar Paul Peter Robin Simon Tom Victor",
    "n": "Alex Ariel Billie Casey Charlie Dana Eden Finley Jamie Jordan Kim Lee Marlo Morgan Quinn Remy Riley Robin Sam Sky Taylor Toni",
    "fc": "Анна Вера Елена Ирина Мария Нина Ольга Тамара",
    "mc": "Антон Борис Виктор Иван Лев Марк Олег Павел",
    "nc": "Саша Женя Валя Слава",
}
_SYLLABLES = "ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no pa pe ra re ri ro sa se so ta te to va ve vo".split()
_SYLLABLES_C = "ба бе бо ва ве га да де до ка ко ла ле ма ми на не но па ра ре ро са со та то".split()
ROUNDS = 50


_QUOTE = "\\x27"  # an apostrophe inside a quoted pattern


def _lit_array(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _type_of(e: str) -> Column:
    out = F.lit("secret")
    for name in ("person", "card", "phone", "ssn", "ip", "iban", "email"):
        out = F.when(F.col(e).rlike(f"^(?:{WHOLE[name]})$"), F.lit(name)).otherwise(out)
    return out


def may_hold(text: str) -> Column:
    """Cheap test that leaves out most texts: every entity has a digit, an at
    sign, a title or a known given name, or is a secret behind a keyword or key prefix or of
    letters from a to f."""
    t = F.col(text)
    named = t.rlike(rf"(?=\p{{Lu}})(?:(?:{_TITLE})\.? |(?:{_GIVEN})[ -])")
    keyed = F.lit(False)
    for word in ("passw", "pwd", "token", "secret", "api_key", "apikey", "api-key"):
        keyed = keyed | F.contains(F.lower(t), F.lit(word))
    keyed = (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & keyed
    for prefix in ("AKIA", "ASIA", *[f"{p}{c}" for p in ("sk", "pk", "ghp", "gho", "xoxb", "xoxp") for c in "-_"]):
        keyed = keyed | F.contains(t, F.lit(prefix))
    return t.rlike("[0-9@]") | named | keyed | t.rlike("[a-f]{32}")


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_e``: entities in order, without name words alone."""
    return docs.withColumn("_e", F.when(may_hold(text), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))


def with_name_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``found`` texts with ``_e`` (all entities in order), ``_p`` (the text
    between) and ``_b`` (the name words of its persons, which are entities of
    the text wherever they stand alone)."""
    person = f"x rlike r'^(?:{WHOLE['person'].replace("'", _QUOTE)})$'"
    words = f"split(regexp_replace(x, r'^{_TITLES}+', ''), '[ .]')"
    names = F.expr(f"""CASE WHEN size(_e) > 0 THEN array_sort(array_distinct(flatten(transform(filter(_e, x -> {person}),
        x -> filter({words}, w -> w rlike r'^{_NAME.replace("'", _QUOTE)}$'))))) END""")
    # as written and in capitals, the longest first
    bare = F.expr("array_sort(array_distinct(concat(_b, transform(_b, w -> upper(w)))), (l, r) -> length(r) - length(l))")
    with_e = docs.withColumn("_b", names).withColumn("_b", F.when(F.size("_b") > 0, bare))
    again = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}\\p{{N}}])(?:"), F.array_join("_b", "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    with_e = with_e.withColumn("_e", F.when(F.col("_b").isNull(), F.col("_e")).otherwise(F.regexp_extract_all(F.col(text), again, F.lit(0))))
    between = F.when(F.col("_b").isNull(), F.split(F.col(text), ANY, -1)).otherwise(F.split(F.col(text), again, -1))
    return with_e.withColumn("_p", F.when(F.size("_e") > 0, between)).withColumn("_b", F.coalesce("_b", F.expr("CAST(array() AS array<string>)")))


def identities(entities: DataFrame) -> DataFrame:
    """Distinct entities (column ``e``) with type and canonical form; persons
    with gender."""
    t = entities.withColumn("type", _type_of("e"))
    bare = F.regexp_replace("e", rf"^{_TITLES}+", "")
    canonical = (
        F.when(F.col("type") == "person", F.lower(bare)).when(F.col("type") == "secret", F.regexp_replace("e", f"^{_KEYED}", ""))
        .when(F.col("type").isin("phone", "card", "ssn"), F.regexp_replace("e", "[^0-9]", ""))
        .when(F.col("type") == "iban", F.regexp_replace("e", " ", ""))
        .when(F.col("type") == "email", F.lower("e")).otherwise(F.col("e")))
    titled = F.lit(None).cast("string")
    for g in ("m", "f"):
        titled = F.when(F.col("e").rlike(rf"^{_TITLES}*(?:{'|'.join(TITLES[g])})\.? "), F.lit(g)).otherwise(titled)
    t = t.withColumn("canonical", canonical).withColumn("_t", F.when(F.col("type") == "person", titled))
    seen = t.filter("_t IS NOT NULL").groupBy("canonical").agg(F.min("_t").alias("_l"), F.max("_t").alias("_r")).filter("_l = _r")
    known = F.lit("n")
    for g in ("m", "f"):
        known = F.when(F.col("canonical").rlike(rf"(?iu)^(?:{_KNOWN[g]})\b"), F.lit(g)).otherwise(known)
    gender = F.when(F.col("type") == "person", F.coalesce("_t", "_l", known))
    t = t.join(seen.select("canonical", "_l"), "canonical", "left")
    return t.withColumn("gender", gender).select("e", "type", "canonical", "gender")


def name_words(persons: DataFrame) -> DataFrame:
    """The words of persons (``e``, ``gender``) with place ``at`` and, for
    given names and surnames, type, canonical form and gender."""
    words = persons.select("e", "gender", F.regexp_extract("e", rf"^({_TITLES}+)", 1).alias("title"),
                           F.split(F.regexp_replace("e", rf"^{_TITLES}+", ""), " ").alias("ws"))
    each = words.select("e", "gender", "title", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "word"))
    every = "|".join(_KNOWN.values())
    given = F.col("word").rlike(rf"(?iu)^(?:{every})(?:-\p{{L}}+)?$") & ((F.col("at") < F.col("n") - 1) | (F.col("n") == 1)) | (F.col("at") == 0) & (F.col("n") > 1)
    kind = F.when(F.col("word").rlike(rf"^{_NAME}$"), F.when(given, F.lit("given")).otherwise(F.lit("family")))
    each = each.withColumn("type", kind)
    return each.withColumn("canonical", F.when(F.col("type").isNotNull(), F.lower("word"))).withColumn(
        "gender", F.when(F.col("type") == "given", F.col("gender")))


def _drawn(persons: DataFrame, key: str) -> DataFrame:
    """``surrogate``: the canonical surrogate of (type, canonical, gender,
    attempt).  ``h`` is a keyed stream of hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key_literal(key)), "type", "canonical", F.col("attempt").cast("string"))
    df = persons.withColumn("h", F.concat(F.sha2(F.concat(seed, F.lit("a")), 512), F.sha2(F.concat(seed, F.lit("b")), 512)))

    def byte(i: str) -> str:  # 0 to 255 at position i of the stream
        return f"CAST(conv(substr(h, 2 * (({i}) % 128) + 1, 2), 16, 10) AS int)"

    def letters(c: str, i: str, first: str, n: int) -> str:
        return f"char(ascii('{first}') + ({byte(i)} + ascii({c})) % {n})"

    def shaped(word: str, off: str = "0") -> str:
        """Letter for letter, digit for digit, in case and script."""
        cyr_up, cyr_low = "АБВГДЕЖЗИКЛМНОПРСТУФХ", "абвгдежзиклмнопрстуфх"
        pos = f"i + {off}"
        return f"""array_join(transform(split({word}, ''), (c, i) -> CASE
          WHEN c rlike '[0-9]' THEN CAST(({byte(pos)} + ascii(c)) % 10 AS string)
          WHEN c rlike '[a-z]' THEN {letters('c', pos, 'a', 26)}
          WHEN c rlike '[A-Z]' THEN {letters('c', pos, 'A', 26)}
          WHEN c rlike '[\\\\u00DF-\\\\u00F6\\\\u00F8-\\\\u00FF]' THEN substr('àáâäçèéêëìíîïñòóôöùúûü', {byte(pos)} % 22 + 1, 1)
          WHEN c rlike '[\\\\u00C0-\\\\u00D6\\\\u00D8-\\\\u00DE]' THEN substr('ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ', {byte(pos)} % 22 + 1, 1)
          WHEN c rlike '[\\\\u0430-\\\\u044F]' THEN substr('{cyr_low}', {byte(pos)} % 21 + 1, 1)
          WHEN c rlike '[\\\\u0410-\\\\u042F]' THEN substr('{cyr_up}', {byte(pos)} % 21 + 1, 1)
          ELSE c END), '')"""

    hexed = f"""array_join(transform(split(canonical, ''), (c, i) -> CASE WHEN c rlike '[0-9a-f]'
        THEN lower(hex(({byte('i')} + ascii(c)) % 16)) ELSE c END), '')"""
    luhn = """(10 - aggregate(sequence(1, length(body)), 0, (s, k) -> s + CASE WHEN (length(body) - k) % 2 = 0 THEN
        CASE WHEN CAST(substr(body, k, 1) AS int) * 2 > 9 THEN CAST(substr(body, k, 1) AS int) * 2 - 9 ELSE CAST(substr(body, k, 1) AS int) * 2 END
        ELSE CAST(substr(body, k, 1) AS int) END) % 10) % 10"""
    mod97 = """aggregate(split(concat(body, substr(canonical, 1, 2), '00'), ''), 0, (s, c) -> CASE
        WHEN c = '' THEN s WHEN c rlike '[0-9]' THEN (s * 10 + CAST(c AS int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"""
    kind = "CASE WHEN canonical rlike '\\\\p{IsCyrillic}' THEN 'c' ELSE '' END"
    given = "CASE concat(gender, " + kind + ") " + " ".join(
        f"WHEN '{g}' THEN element_at({_lit_array(v.split())}, {byte('0')} % {len(v.split())} + 1)" for g, v in NAMES.items()) + " END"
    def syllables(first: str, last: str, at: str) -> str:
        return f"""array_join(transform(sequence({first}, {last}), i -> CASE WHEN canonical rlike '\\\\p{{IsCyrillic}}' THEN
          element_at({_lit_array(_SYLLABLES_C)}, {byte(at)} % {len(_SYLLABLES_C)} + 1) ELSE
          element_at({_lit_array(_SYLLABLES)}, {byte(at)} % {len(_SYLLABLES)} + 1) END), '')"""

    # when the names run out, syllables make more of them
    given = f"concat({given}, CASE WHEN attempt < 4 THEN '' ELSE {syllables('1', 'least(attempt - 3, 8)', 'i')} END)"
    family = f"initcap({syllables('0', '2 + least(attempt, 8)', 'i + 1')})"
    df = df.withColumn("body", F.expr(f"""CASE type
        WHEN 'card' THEN concat(substr(canonical, 1, 1), substr({shaped('substr(canonical, 2, length(canonical) - 2)')}, 1))
        WHEN 'iban' THEN {shaped('substr(canonical, 5)')} ELSE '' END"""))
    return df.withColumn("surrogate", F.expr(f"""CASE type
        WHEN 'card' THEN concat(body, CAST({luhn} AS string))
        WHEN 'iban' THEN concat(substr(canonical, 1, 2), lpad(CAST(98 - {mod97} AS string), 2, '0'), body)
        WHEN 'ip' THEN array_join(transform(sequence(0, 3), i -> CAST(1 + ({byte('2 * i')} * 256 + {byte('2 * i + 1')}) % 223 AS string)), '.')
        WHEN 'ssn' THEN concat(CAST(100 + ({byte('0')} * 256 + {byte('1')}) % 565 AS string), {shaped('substr(canonical, 4)', '2')})
        WHEN 'phone' THEN concat(substr(canonical, 1, length(canonical) - 9), CAST(2 + {byte('0')} % 8 AS string), {shaped('substr(canonical, length(canonical) - 7)', '1')})
        WHEN 'email' THEN concat({shaped("regexp_extract(canonical, '^(.*)\\\\.([a-z]+)$', 1)")}, '.', regexp_extract(canonical, '^(.*)\\\\.([a-z]+)$', 2))
        WHEN 'given' THEN {given} WHEN 'family' THEN {family}
        ELSE CASE WHEN canonical rlike '^(AKIA|ASIA)[A-Z0-9]{{16}}$' THEN concat(substr(canonical, 1, 4), {shaped('substr(canonical, 5)')})
            WHEN canonical rlike '^[0-9a-f]+$' THEN {hexed}
            WHEN canonical rlike '^(sk|pk|ghp|gho|xoxb|xoxp)[-_]' THEN concat(regexp_extract(canonical, '^([a-z]+[-_])', 1), {shaped("regexp_replace(canonical, '^[a-z]+[-_]', '')")})
            ELSE {shaped('canonical')} END END""")).drop("h", "body")


def settled(persons: DataFrame, key: str) -> DataFrame:
    """(type, canonical, gender, surrogate) with distinct surrogates per type,
    none of them a real identity.  Each round keeps what collides with nothing
    and draws the rest again."""
    real = persons.select("type", F.lower("canonical").alias("s")).distinct()
    wait = persons.withColumn("attempt", F.lit(0))
    done = None
    for _ in range(ROUNDS):
        drawn = stored(_drawn(wait, key).withColumn("s", F.lower("surrogate")), "drawn")
        taken = real if done is None else real.union(done.select("type", F.lower("surrogate").alias("s")))
        free = drawn.join(taken, ["type", "s"], "left_anti")
        # of several with one surrogate the first identity has it
        first = free.groupBy("type", "s").agg(F.min(F.struct("canonical", F.coalesce("gender", F.lit("")).alias("g"))).alias("w"))
        first = first.select("type", "s", F.col("w.canonical").alias("canonical"), F.col("w.g").alias("g"))
        won = stored(drawn.join(first.withColumnRenamed("g", "_g"), ["type", "s", "canonical"]).filter(
            F.coalesce("gender", F.lit("")) == F.col("_g")).select("type", "canonical", "gender", "surrogate"), "settled")
        done = won if done is None else done.union(won)
        lost = drawn.withColumn("_g", F.coalesce("gender", F.lit(""))).join(
            won.select("type", "canonical", F.coalesce("gender", F.lit("")).alias("_g")), ["type", "canonical", "_g"], "left_anti")
        wait = stored(lost.select("type", "canonical", "gender", (F.col("attempt") + 1).alias("attempt")), "to-draw-again")
        if wait.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")


def _in_format() -> Column:
    """The canonical surrogate ``surrogate`` in the format of the entity ``e``."""
    digits = """array_join(transform(split(e, ''), (c, i) -> CASE WHEN c rlike '[0-9]'
        THEN substr(surrogate, length(regexp_replace(substr(e, 1, i + 1), '[^0-9]', '')), 1) ELSE c END), '')"""
    grouped = """array_join(transform(split(e, ''), (c, i) -> CASE WHEN c <> ' '
        THEN substr(surrogate, length(replace(substr(e, 1, i + 1), ' ', '')), 1) ELSE c END), '')"""
    cased = """array_join(transform(split(e, ''), (c, i) -> CASE WHEN c rlike '[A-Z]' THEN upper(substr(surrogate, i + 1, 1))
        ELSE substr(surrogate, i + 1, 1) END), '')"""
    shown = F.expr(f"""CASE WHEN type IN ('phone', 'card', 'ssn') THEN {digits} WHEN type = 'iban' THEN {grouped}
        WHEN type = 'email' THEN {cased} ELSE surrogate END""")
    return F.when(F.col("type") == "secret", F.concat(F.regexp_extract("e", f"^({_KEYED})", 1), "surrogate")).otherwise(shown)


def _cased(word: str, like: str) -> str:
    return f"CASE WHEN {like} = upper({like}) THEN upper({word}) ELSE {word} END"


def _persons(words: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(e, s): the surrogates of persons from those of their ``name_words``;
    initials become other ones, particles and titles stay."""
    g = F.coalesce("gender", F.lit("")).alias("_g")
    parts = words.select("*", g).join(drawn.select("type", "canonical", g, "surrogate"), ["type", "canonical", "_g"], "left")
    seed = f"pmod(xxhash64('{key_literal(key)}', lower(word)), 25)"
    initial = f"concat(char(65 + (pmod(ascii(word) - 65, 26) + 1 + {seed}) % 26), '.')"
    shown = F.expr(f"""CASE WHEN surrogate IS NOT NULL THEN {_cased('surrogate', 'word')}
        WHEN word rlike r'^(?:\\p{{Lu}}[.])+' THEN {initial} ELSE word END""")
    whole = parts.withColumn("shown", shown).groupBy("e").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("at", "shown"))).alias("ws"))
    return whole.select("e", F.expr("concat(title, array_join(ws.shown, ' '))").alias("s"))


def key_literal(key: str) -> str:
    """Hexadecimal digits that stand for the key inside an expression: plans
    and logs show these, never the key."""
    return hashlib.sha256(key.encode()).hexdigest()


def replaced(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with entities replaced, ``n_entities`` and, per entity of the
    text, (type, entity, surrogate) in ``entities``."""
    own = ["n_entities", "entities"]
    aside = Aside(docs, [doc_id, text])
    every = found(aside.rows, text)
    columns = aside.rows.columns
    kind = "array<struct<type:string,entity:string,surrogate:string>>"
    clean = every.filter(F.coalesce(F.size("_e"), F.lit(0)) <= 0).select(
        *columns, F.lit(0).cast("long").alias("n_entities"), F.expr(f"CAST(array() AS {kind})").alias("entities"))
    # stored first: the patterns of the second pass would repeat those of the first
    some = stored(every.filter(F.size("_e") > 0), "texts-with-finds")
    some = stored(with_name_words(some, text).withColumn("_key", F.xxhash64(doc_id, text)), "texts-with-entities")
    pairs = some.select("_key", F.explode(F.expr("array_distinct(array_except(_e, _b))")).alias("e")).distinct()
    each = stored(identities(pairs.select("e").distinct()), "entities")
    words = stored(name_words(each.filter("type = 'person'")), "name-words")
    drawn = settled(each.filter("type <> 'person'").select("type", "canonical", "gender").union(
        words.filter("type IS NOT NULL").select("type", "canonical", "gender")).distinct(), key)
    shown = each.filter("type <> 'person'").join(drawn.select("type", "canonical", "surrogate"), ["type", "canonical"]).select("type", "e", _in_format().alias("s"))
    persons = _persons(words, drawn, key).select(F.lit("person").alias("type"), "e", "s")
    shown = stored(shown.unionByName(persons), "surrogates")
    maps = pairs.join(shown, "e").groupBy("_key").agg(F.collect_list(F.struct("e", F.struct("type", "s"))).alias("m"))
    filled = some.join(maps.withColumn("m", F.map_from_entries("m")), "_key")
    # a name word alone has the surrogate that it has in the persons of its text
    filled = filled.withColumn("_n", F.expr("""flatten(transform(array_sort(filter(map_entries(m), x -> x.value.type = 'person')),
        x -> zip_with(split(x.key, ' '), split(x.value.s, ' '), (w, s) -> named_struct('w', lower(w), 's', s))))"""))
    alone = f"""named_struct('type', 'person', 's', transform(slice(filter(_n, x -> x.w = lower(e) OR upper(x.w) = upper(e)), 1, 1), x ->
        CASE WHEN e = upper(e) THEN upper(x.s) ELSE initcap(x.s) END)[0])"""
    filled = filled.withColumn("_s", F.expr(f"transform(_e, e -> coalesce(m[e], {alone}))"))
    new = F.expr("array_join(transform(_p, (p, i) -> concat(p, CASE WHEN i < size(_e) THEN _s[i].s ELSE '' END)), '')")
    listed = F.expr(f"CAST(zip_with(_e, _s, (e, s) -> named_struct('type', s.type, 'entity', e, 'surrogate', s.s)) AS {kind})")
    out = filled.withColumn("n_entities", F.size("_e").cast("long")).withColumn("entities", listed).withColumn(text, new)
    return aside.restored(clean.unionByName(out.select(*columns, *own)), own)
