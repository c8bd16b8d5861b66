"""Keyed surrogates for personal data and secrets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import BROADCAST_ROWS, dropped, written

#: Titles that mark a person, by gender.
MALE = "Mr|Herr|Monsieur|Señor"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora"
TITLE = rf"\b(?:{MALE}|{FEMALE})\.? "
NAME = r"\p{Lu}\p{Ll}+"
#: One alternation finds every kind, leftmost first. A person's first and last names are found one by one, after a title or after a titled name.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?<!\d)(?:\d{1,3}[ -]?)?\(\d{3}\)[ -]?\d{3}-\d{4}|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4})(?!\d)",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?<=password=)[^\s\"']+|(?<=token = \")[^\"\n]+",
    "name": rf"(?=\p{{Lu}})(?:(?<={TITLE})|(?<={TITLE}\p{{Lu}}\p{{Ll}}{{1,30}} )){NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Kinds whose surrogates keep the places of separators and change digits alone.
NUMBERS = ("phone", "card", "national_id")
#: Syllables of invented names in either script, and the endings of first names by gender.
SYLLABLES = {"latin": "al be cor dan el fer gar hel is jo kal lor mer nor ol per".split(), "cyrillic": "ал бе вор дан ел гар ил кал лор мер нор ол пер рос тал вел".split()}
ENDINGS = {("latin", "m"): "an or ik us".split(), ("latin", "f"): "a ia ina elle".split(), ("cyrillic", "m"): "ан ор ин ев".split(), ("cyrillic", "f"): "а ия ина ева".split()}


def kind_of(value: Column, before: Column) -> Column:
    """The kind of a found value, by what stands before it and by its own pattern; what no pattern fits is a name."""
    out = F.when(before.rlike(r'(?:password=|token = ")$') | value.rlike("^AKIA[0-9A-Z]{16}$"), "secret")
    for kind in ("email", "ip6", "iban", "ip", "card", "national_id"):
        out = out.when(value.rlike(f"^(?:{KINDS[kind]})$"), kind)
    return out.when(value.rlike(r"^[+(\d]"), "phone").otherwise("name")


def canonical(kind: Column, value: Column, role: Column) -> Column:
    """What stays the same when one entity is written in another way: digits of numbers, lower case of addresses, letters without blanks of accounts;
    of a name its lower case with its role (a last name, or a first name of either gender), so that one first name of two genders is two."""
    plain = F.when(kind.isin(*NUMBERS), F.regexp_replace(value, r"\D", "")).when(kind.isin("email", "ip6"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
    return plain.when(kind == "name", F.concat(F.lower(value), F.lit("|"), role)).otherwise(value)


def _draw(hexes: str, i: str, most: int) -> str:
    return f"int(conv(substr({hexes}, ({i}) % 62 * 2 + 1, 4), 16, 10)) % {most}"


def _replaced(rows: DataFrame) -> DataFrame:
    """Adds ``canon_new`` to (kind, canon, attempt, key): drawn by a keyed digest of kind, canon and attempt.

    From the third attempt on a surrogate is lengthened, by one more sign an attempt, so that every entity finds one that is free even where its
    own form has few or no others."""
    seed = F.concat_ws("|", "key", "kind", "canon", F.col("attempt").cast("string"))
    rows = rows.withColumn("hexes", F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("#")), 256)))
    mapped = f"""array_join(transform(split(canon, ''), (c, i) -> CASE
        WHEN kind = 'phone' AND i < greatest(length(canon) - 10, 2) THEN c
        WHEN kind = 'card' AND i = 0 THEN c
        WHEN kind = 'iban' AND i < 2 THEN c
        WHEN kind = 'secret' AND i < 4 AND canon rlike '^AKIA[0-9A-Z]{{16}}$' THEN c
        WHEN kind = 'email' AND i >= length(canon) - length(substring_index(canon, '.', -1)) THEN c
        WHEN kind = 'ip6' AND c rlike '[0-9a-f]' THEN substr('123456789abcdef', {_draw("hexes", "i", 15)} + 1, 1)
        WHEN c rlike '[0-9]' THEN string({_draw("hexes", "i", 10)})
        WHEN c rlike '[a-z]' THEN char(97 + IF(kind = 'secret' AND canon rlike '^[0-9a-f]+$', {_draw("hexes", "i", 6)}, {_draw("hexes", "i", 26)}))
        WHEN c rlike '[A-Z]' THEN char(65 + {_draw("hexes", "i", 26)})
        WHEN kind = 'secret' AND c rlike '[\\\\u0430-\\\\u044F]' THEN substr('абвгдежзийклмнопрстуфхцчшщъыьэюя', {_draw("hexes", "i", 32)} + 1, 1)
        ELSE c END), '')"""
    octets = "concat_ws('.', " + ", ".join(f"string(1 + {_draw('hexes', str(7 * k), 254)})" for k in range(4)) + ")"

    def name(script: str) -> str:
        syl = "array(" + ",".join(f"'{x}'" for x in SYLLABLES[script]) + ")"
        end = {g: "array(" + ",".join(f"'{x}'" for x in ENDINGS[script, g]) + ")" for g in "mf"}
        more = f"array_join(transform(sequence(1, greatest(attempt, 1)), k -> IF(k > 1, {syl}[{_draw('hexes', 'k * 3 + 4', 16)}], '')), '')"
        tail = f"CASE substring_index(canon, '|', -1) WHEN 'f' THEN {end['f']}[{_draw('hexes', '6', 4)}] WHEN 'm' THEN {end['m']}[{_draw('hexes', '6', 4)}] ELSE {syl}[{_draw('hexes', '8', 16)}] END"
        return f"concat({syl}[{_draw('hexes', '0', 16)}], {syl}[{_draw('hexes', '2', 16)}], {more}, {tail})"

    rows = rows.withColumn("mapped", F.expr(mapped))
    luhn = "aggregate(sequence(1, length(mapped) - 1), 0, (t, k) -> t + int(int(substr(mapped, k, 1)) * (1 + (length(mapped) - k) % 2) / 10) + int(substr(mapped, k, 1)) * (1 + (length(mapped) - k) % 2) % 10)"
    card = f"concat(substr(mapped, 1, length(mapped) - 1), string((10 - {luhn} % 10) % 10))"
    spare = f"array_join(transform(sequence(1, greatest(attempt - 1, 1)), k -> IF(attempt > 1, IF(kind IN ('phone', 'card', 'national_id', 'ip', 'iban'), string({_draw('hexes', 'k * 5', 10)}), char(97 + {_draw('hexes', 'k * 5', 26)})), '')), '')"
    new = f"""CASE kind WHEN 'ip' THEN {octets} WHEN 'card' THEN {card} WHEN 'name' THEN IF(canon rlike '[\\\\u0400-\\\\u04FF]', {name("cyrillic")}, {name("latin")})
        WHEN 'email' THEN concat({spare}, mapped) WHEN 'ip6' THEN mapped ELSE concat(mapped, {spare}) END"""
    return rows.withColumn("canon_new", F.expr(new)).drop("hexes", "mapped")


def _formatted(kind: Column, value: Column, new: Column) -> Column:
    """``new`` in the way ``value`` is written: its separators, its capitals. What a lengthened surrogate has beyond the value's places comes last."""
    places = "length(regexp_replace(value, '[^0-9]', ''))"
    digits = F.expr(f"concat(array_join(transform(split(value, ''), (c, i) -> IF(c rlike '[0-9]', substr(canon_new, length(regexp_replace(substr(value, 1, i + 1), '[^0-9]', '')), 1), c)), ''), substr(canon_new, {places} + 1))")
    capitals = F.expr("concat(substr(canon_new, 1, length(canon_new) - length(value)), array_join(transform(split(value, ''), (c, i) -> IF(c rlike '[A-Z]', upper(substr(canon_new, length(canon_new) - length(value) + i + 1, 1)), substr(canon_new, length(canon_new) - length(value) + i + 1, 1))), ''))")
    spaced = F.expr("concat(array_join(transform(split(value, ''), (c, i) -> IF(c = ' ', c, substr(canon_new, i + 1 - (length(substr(value, 1, i)) - length(replace(substr(value, 1, i), ' ', ''))), 1))), ''), substr(canon_new, length(replace(value, ' ', '')) + 1))")
    return F.when(kind.isin(*NUMBERS), digits).when(kind == "email", capitals).when(kind == "iban", spaced).when(kind == "name", F.initcap(new)).otherwise(new)


def entity_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, canon_new) for every different entity; surrogates are distinct and none is an entity of the data.

    Where several draw the same, or an existing one, all but the smallest draw again, until no collision is left."""
    plain = F.substring_index("canon", "|", 1)  # of names the letters alone: a first name must not be anybody's last name either
    names = written(found.select("kind", "canon").distinct().withColumn("key", F.lit(key)))
    taken = names.select("kind", F.when(F.col("kind") == "name", plain).otherwise(F.col("canon")).alias("canon_new")).distinct()
    done, rest, attempt = None, names.withColumn("attempt", F.lit(0)), 0
    while True:
        drawn = written(_replaced(rest))
        first = drawn.groupBy("kind", "canon_new").agg(F.min("canon").alias("canon"))
        ok = drawn.join(first, ["kind", "canon_new", "canon"], "left_semi").join(taken, ["kind", "canon_new"], "left_anti")
        if done is not None:
            ok = ok.join(done.select("kind", "canon_new"), ["kind", "canon_new"], "left_anti")
        ok = written(ok.select("kind", "canon", "canon_new"))
        done = ok if done is None else done.unionByName(ok)
        rest = drawn.join(ok, ["kind", "canon"], "left_anti").select("kind", "canon", "key")
        attempt += 1
        rest = written(rest.withColumn("attempt", F.lit(attempt)))
        dropped(drawn)
        if rest.isEmpty():
            return done


def with_surrogates(docs: DataFrame, key: str = "surrogate-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with personal data or secrets, replaced: doc_id, text, entities (kind, value, surrogate in order of place).

    Mail addresses, phone, card, account and national numbers, IPv4 and IPv6 addresses, secrets and names after a title get surrogates drawn with ``key``
    and their own canonical form, so one entity has one surrogate everywhere however it is written. First and last names have surrogates of their own, so
    a person named in full, by title and last name, or later in the same text by either name alone, stays one person; a first name's surrogate
    follows the title's gender. Kind, separators, capitals and script are kept, card numbers pass the check digit, and surrogates collide neither with
    each other nor with entities of the data; where a form has no other value left (as a secret of signs alone), its surrogate is longer.

    Only texts with an entity are returned, whole. Null and empty texts have none. Rows that repeat id and text give one row each; a null id is
    an id like any other. Empty tables give no rows. Other columns are ignored.
    """
    hit = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(PATTERN)).withColumn("h", F.xxhash64("doc_id", "text"))
    # names after titles, which then count wherever the text has them
    values = F.regexp_extract_all("text", F.lit(rf"{TITLE}({NAME})(?: ({NAME}))?"), F.lit(0))
    people = F.transform(values, lambda v: F.struct(
        F.when(v.rlike(rf"^(?:{FEMALE})\b"), "f").otherwise("m").alias("gender"), F.regexp_extract_all(v, F.lit(NAME), F.lit(0)).alias("words")))
    hit = hit.withColumn("people", F.when(F.col("text").rlike(TITLE), people).otherwise(F.array().cast("array<struct<gender:string,words:array<string>>>")))
    # words: the title's word, then one (a last name) or two (first and last)
    roles = """flatten(transform(people, p -> IF(size(p.words) > 2,
        array(named_struct('name', p.words[1], 'role', p.gender), named_struct('name', p.words[2], 'role', 's')), array(named_struct('name', p.words[1], 'role', 's')))))"""
    hit = hit.withColumn("roles", F.expr(roles)).drop("people")
    names = F.array_distinct(F.transform("roles", lambda r: r["name"]))
    pattern = F.when(F.size("roles") > 0, F.concat(F.lit(PATTERN + r"|\b(?:"), F.array_join(names, "|"), F.lit(r")\b"))).otherwise(F.lit(PATTERN))
    hit = hit.withColumn("pattern", pattern)
    hit = written(hit.withColumn("parts", F.split("text", F.col("pattern"))).withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    each = F.expr("transform(found, (v, i) -> named_struct('value', v, 'before', right(parts[i], 24), 'joined', i > 0 AND parts[i] = ' ', 'earlier', IF(i > 0, right(parts[i - 1], 24), '')))")
    rows = hit.select("h", "roles", F.posexplode(each).alias("place", "e")).select("h", "roles", "place", "e.*")
    female = F.when(F.col("joined") & ~F.col("before").rlike(TITLE + "$"), F.col("earlier")).otherwise(F.col("before")).rlike(rf"\b(?:{FEMALE})\.? $")
    male = F.when(F.col("joined") & ~F.col("before").rlike(TITLE + "$"), F.col("earlier")).otherwise(F.col("before")).rlike(rf"\b(?:{MALE})\.? $")
    same = F.filter("roles", lambda r: r["name"] == F.col("value"))
    # beside a title its gender decides between a name's roles, elsewhere the first mention does
    beside = F.filter(same, lambda r: (female & (r["role"] == "f")) | (male & (r["role"] == "m")))
    lastly = F.filter(same, lambda r: r["role"] == "s")
    role = F.when(F.col("joined") & (F.size(lastly) > 0), "s").when(F.size(beside) > 0, "x").when((female | male) & (F.size(lastly) > 0), "s").otherwise(F.coalesce(F.get(same, F.lit(0))["role"], F.lit("s")))
    role = F.when(role == "x", F.when(female, "f").otherwise("m")).otherwise(role)
    rows = rows.withColumn("kind", kind_of(F.col("value"), F.col("before"))).withColumn("role", role)
    rows = written(rows.withColumn("canon", canonical(F.col("kind"), F.col("value"), F.col("role"))).select("h", "place", "value", "kind", "canon"))
    entities = entity_table(rows, key)
    entities = F.broadcast(entities) if entities.count() <= BROADCAST_ROWS // 10 else entities
    new = rows.join(entities, ["kind", "canon"]).withColumn("surrogate", _formatted(F.col("kind"), F.col("value"), F.col("canon_new")))
    new = new.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("place", "kind", "value", "surrogate"))).alias("entities"))
    out = hit.join(new, "h")
    text = F.array_join(F.zip_with("parts", "entities", lambda t, e: F.concat(F.coalesce(t, F.lit("")), F.coalesce(e["surrogate"], F.lit("")))), "")
    return out.select("doc_id", text.alias("text"), F.transform("entities", lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), e["surrogate"].alias("surrogate"))).alias("entities"))
