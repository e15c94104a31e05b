"""PII surrogates: detected entities get keyed replacements of the same kind, script and format.

An entity's canonical form (an e-mail in lower case, the digits of a phone or card, ...) goes through a keyed
permutation of all canonical forms of its format: character after character is shifted, within its own class
(digits, vowels or consonants of a script, by case), by a hash of the key and all other characters, twice round.
Each shift can be undone, so different entities have different surrogates, and one entity has one surrogate in
every document and layout: coreference needs no table. What makes a value valid is kept: the octets of addresses,
the issuer digit and check digit of cards, country codes, the top-level domain.

Names are found after a title, or where a known given name stands before capitalised words; hyphens and apostrophes join
parts of a word, particles (de la, van der) stand between words, and both may be in capitals. They are replaced part by part, so that
"Maria Lopez", "MARIA LOPEZ" and "Mrs. Lopez" stay one family. A known given name, and an unknown one between a title
that says the gender and a surname, gets a name of its gender and script: the known ones change places in a keyed ring; where
that is real in the corpus, two names of the list are joined by a hyphen, later more. Any other part is permuted, keeping the last
letter, which carries gender where words do. The title, particles and single letters stay.

Labels and hexadecimal digits count in either case, and secrets of any length. One of more than PART characters
is permuted part by part, each with a key of its place. Runs of 13 to 19 digits are cards only if the check digit is right.

Collision check. No surrogate may be a real value of the corpus, and no two entities may share one. The distinct
entities are a table; they are grouped with their surrogates by value. An entity whose surrogate is real, or
belongs to another (one of several keeps it), draws again with the next attempt's key, against all real values and all surrogates
given so far, until none is left. After WIDE attempts the format is made one character longer with each attempt (names, e-mails, secrets, phones),
so that a small format in which every value is taken is left behind; a format that cannot grow raises an error
after ATTEMPTS rather than keep a real value. A value is a whole replacement: a part of a name, or a hyphenated given name.

All of it is DataFrame expressions, no Python runs over rows.

Cases: null texts stay null, texts without entities are returned as they are; repeated rows are rewritten alike;
overlapping kinds go to the first that matches from the left; other columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# ---- Fixed values: given names by gender and script. ----
GIVEN = {
    "female, Latin": "Anna Maria Elena Laura Sofia Julia Emma Olivia Charlotte Isabella Camille Chloé Claire Inès Léa Manon Marie Sophie Katharina Lena Johanna Hannah Greta Ingrid Carmen Lucía Paula Marta Mary Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Emily".split(),
    "male, Latin": "Carlos Juan José Miguel Antonio Pedro Diego Javier Pablo Luis Jean Pierre Michel Louis Antoine Nicolas Hugo Lucas Thomas Hans Peter Klaus Wolfgang Jürgen Stefan Matthias Felix James John Robert Michael William David Richard Joseph Charles Daniel Matthew".split(),
    "female, Cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Полина".split(),
    "male, Cyrillic": "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел Олег Виктор".split(),
}
# ---- End of fixed values. ----
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Madame|Госпожа|MRS|FRAU"
_MALE = r"Mr|Herr|Señor|Monsieur|Господин|MR|HERR"
_TITLES = rf"{_FEMALE}|{_MALE}|Dr|Prof|DR|PROF"
_GIVEN = "|".join(w for names in GIVEN.values() for n in names for w in (n, n.upper()))
#: A word of a name: hyphens and apostrophes join its parts, but for the possessive.
_WORD = r"(?:\p{Lu}\p{L}{1,30}|\p{Lu}(?=['’]\p{Lu}))(?:[-'’](?!s(?!\p{L}))\p{L}{1,30}){0,3}"
#: Particles between the words of a name; they stay.
_PARTICLES = r"(?:(?:de|del|della|di|da|dos|van|von|der|den|du|la|las|le|los|bin|al|ter|zu) ){0,3}"
_MORE = rf"(?: {_PARTICLES}{_WORD})"
_LABELS = "token|secret|passwd|password|api_key|apikey|access_key"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Pattern of each kind, tried in this order at each place. Look-behinds are bounded, and short ones stand before
#: long ones, which are tried in few places then; no repeat holds another that can match the same text in two ways.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<=[=:\"' ])(?<=[=:][ ]{0,2}[\"']?)(?<=(?i:@LABELS@)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_/+-]{8,}+|(?<![0-9A-Za-z_])(?i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Z0-9]{36})(?![0-9A-Za-z_])|(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])".replace("@LABELS@", _LABELS),
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9.])(?:[0-9]{13,19}+|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?<= )(?<=\b(?:{_TITLES})\.? ){_WORD}{_MORE}{{0,2}}|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_])(?:{_GIVEN})(?:(?:-{_WORD})?{_MORE}{{1,2}}|-{_WORD})",
}
PATTERN = "|".join(KINDS.values())
#: A text without any of these holds no entity.
_HINT = rf"[0-9]|@|(?i:token|secret|passw|key)|\b(?:{_TITLES})\b|(?=\p{{Lu}})(?:{_GIVEN})[ -]"
#: Attempts in a format as it is, and attempts in all.
WIDE, ATTEMPTS = 8, 200
#: Longer secrets are permuted in parts of so many characters: each step hashes all that it is permuted with.
PART = 256
#: Classes whose characters change places with one another only.
CLASSES = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "áàâäéèêëíìîïóòôöúùûü", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "çñß", "ÇÑ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ"]


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_sql(e: str) -> str:
    """The kind of an entity, from its form; hex is a secret of hexadecimal digits only, HEX one with capitals."""
    return (
        f"CASE WHEN instr({e}, '@') > 0 THEN 'email' WHEN {e} rlike {_q('^' + KINDS['ip'] + '$')} THEN 'ip' WHEN {e} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' "
        f"WHEN {e} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' THEN if({_valid_sql(e)}, 'card', 'number') WHEN {e} rlike '^[+(0-9][0-9 ().+-]{{6,}}$' AND {e} rlike '[ ().+-]' THEN 'phone' WHEN {e} rlike '^[0-9a-f]{{8,}}$' THEN 'hex' "
        f"WHEN {e} rlike '^[0-9A-Fa-f]{{8,}}$' AND {e} rlike '[0-9]' THEN 'HEX' "
        f"WHEN {e} rlike {_q(rf'^{_WORD}{_MORE}{{0,2}}$')} THEN 'name' ELSE 'secret' END"
    )


def _valid_sql(e: str) -> str:
    """Whether the check digit of a card's digits is right."""
    d = f"regexp_replace({e}, '[^0-9]', '')"
    return f"element_at(transform(array({d}), n -> ({_luhn_sql('n')} + int(substr(n, -1))) % 10 = 0), 1)"


def canonical_sql(kind: str, e: str) -> str:
    return f"CASE WHEN {kind} = 'email' THEN lower({e}) WHEN {kind} IN ('phone', 'card', 'ssn') THEN regexp_replace({e}, '[^0-9]', '') ELSE {e} END"


def _class_sql(kind: str, c: str) -> str:
    cases = " ".join(f"WHEN instr('{x}', {c}) > 0 THEN '{x}'" for x in CLASSES)
    return f"CASE WHEN {c} = '' THEN '' WHEN {kind} = 'hex' THEN '0123456789abcdef' WHEN {kind} = 'HEX' THEN CASE WHEN instr('ABCDEF', {c}) > 0 THEN 'ABCDEF' WHEN instr('abcdef', {c}) > 0 THEN 'abcdef' ELSE '0123456789' END {cases} ELSE '' END"


def _shift_sql(key: str, kind: str, turn: str, rest: str) -> str:
    """A number below 2**48 from the key and everything that does not change in this step."""
    return f"bigint(conv(substr(sha2(concat_ws('|', {_q(key)}, {kind}, {turn}, {rest}), 256), 1, 12), 16, 10))"


def _moves_sql(kind: str, s: str, i: str) -> str:
    """Whether the character at place i may change; depends only on what never does."""
    n = f"length({s})"
    return (
        f"CASE {kind} WHEN 'email' THEN {i} < {n} - locate('.', reverse({s})) + 1 WHEN 'phone' THEN {i} > {n} - 10 WHEN 'card' THEN {i} > 1 AND {i} < {n} "
        f"WHEN 'name' THEN {i} < {n} AND substr({s}, {i} + 1, 1) <> ' ' ELSE true END"
    )


def _luhn_sql(s: str) -> str:
    """Sum of the digits before the check digit, every second one from the right doubled."""
    return f"aggregate(sequence(1, length({s}) - 1), 0, (z, j) -> z + if((length({s}) - j) % 2 = 1, int(substr({s}, j, 1)) * 2 - if(int(substr({s}, j, 1)) > 4, 9, 0), int(substr({s}, j, 1))))"


def _text_sql(key: str, kind: str, s: str, turn: str) -> str:
    """Character after character shifted within its class, twice round."""
    c = "substr(acc, i, 1)"
    put = f"concat(substr(acc, 1, i - 1), substr(a, int(pmod(instr(a, {c}) - 1 + {_shift_sql(key, kind, turn, 'concat(substr(acc, 1, i - 1), chr(0), substr(acc, i + 1))')}, length(a))) + 1, 1), substr(acc, i + 1))"
    # a let: the lambda over a one-element array names the place and the class once
    step = f"element_at(transform(array(named_struct('i', k % length({s}) + 1)), t -> element_at(transform(array(named_struct('i', t.i, 'a', {_class_sql(kind, 'substr(acc, t.i, 1)')})), u -> if(u.a = '' OR NOT ({_moves_sql(kind, 'acc', 'u.i')}), acc, {put.replace('(a,', '(u.a,').replace('length(a)', 'length(u.a)').replace('acc, i,', 'acc, u.i,').replace('i - 1)', 'u.i - 1)').replace('i + 1)', 'u.i + 1)')})), 1)), 1)"
    return f"aggregate(sequence(0, 2 * length({s}) - 1), {s}, (acc, k) -> {step})"


def permute_sql(key: str, kind: str, s: str) -> str:
    """The permutation of canonical forms of a kind."""
    text = _text_sql(key, kind, s, "k")
    # a secret may be of any length
    parts = f"transform(sequence(0, (length({s}) - 1) div {PART}), b -> named_struct('b', b, 's', substr({s}, b * {PART} + 1, {PART})))"
    text = f"CASE WHEN {kind} IN ('secret', 'hex', 'HEX') AND length({s}) > {PART} THEN array_join(transform({parts}, w -> {_text_sql(key, kind, 'w.s', "concat(w.b, '/', k)")}), '') ELSE {text} END"
    others = "array_join(transform(acc, (y, l) -> if(l = k % 4, -1L, y)), ',')"
    octets = f"array_join(aggregate(sequence(0, 11), transform(split({s}, '[.]'), o -> bigint(o)), (acc, k) -> transform(acc, (o, j) -> if(j = k % 4, pmod(o + {_shift_sql(key, kind, 'k', others)}, 256), o))), '.')"
    card = f"element_at(transform(array({text}), v -> concat(substr(v, 1, length(v) - 1), string(pmod(int(substr({s}, -1)) + {_luhn_sql(s)} - ({_luhn_sql('v')}), 10)))), 1)"
    return f"CASE WHEN {s} = '' THEN {s} WHEN {kind} = 'ip' THEN {octets} WHEN {kind} = 'card' THEN {card} ELSE {text} END"


def layout_sql(kind: str, e: str, s: str) -> str:
    """A canonical surrogate in the layout of the entity: its separators, its capitals."""
    digits = f"aggregate(sequence(1, length({e})), named_struct('o', '', 'n', 0), (a, i) -> if(substr({e}, i, 1) rlike '[0-9]', named_struct('o', concat(a.o, substr({s}, a.n + 1, 1)), 'n', a.n + 1), named_struct('o', concat(a.o, substr({e}, i, 1)), 'n', a.n)), a -> concat(a.o, substr({s}, a.n + 1)))"
    cased = f"array_join(transform(sequence(1, length({s})), i -> if(substr({e}, i, 1) rlike '[A-Z]', upper(substr({s}, i, 1)), substr({s}, i, 1))), '')"
    return f"CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN {digits} WHEN {kind} = 'email' THEN {cased} ELSE {s} END"


def _found(text: str) -> str:
    """SQL of the entities of a text column, in order: e (as it stands), kind, canonical. Numbers that are no card keep their place, as kind 'number'."""
    each = f"CASE WHEN {text} rlike {_q(_HINT)} THEN regexp_extract_all({text}, {_q(PATTERN)}, 0) ELSE array() END"
    # what stands before a value tells a secret of digits or letters only from a number or a name
    label = _q(rf"(?i:{_LABELS})[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?$")
    said = lambda titles: _q(rf"\b(?:{titles})\.? $")
    before = f"slice(split({text}, {_q(PATTERN)}, -1), 1, size(a.each))"
    formed = f"zip_with(a.each, {before}, (e, p) -> named_struct('e', e, 'secret', p rlike {label}, 'gender', CASE WHEN p rlike {said(_FEMALE)} THEN 'f' WHEN p rlike {said(_MALE)} THEN 'm' ELSE '' END))"
    kinds = f"transform({formed}, x -> named_struct('e', x.e, 'gender', x.gender, 'kind', element_at(transform(array({kind_sql('x.e')}), k -> if(x.secret AND k IN ('number', 'name'), 'secret', k)), 1)))"
    whole = f"transform({kinds}, x -> named_struct('e', x.e, 'kind', x.kind, 'parts', {_parts_sql('x.kind', 'x.e', 'x.gender')}))"
    return f"element_at(transform(array(named_struct('each', {each})), a -> if(size(a.each) = 0, array(), {whole})), 1)"


_CODES = {"female, Latin": "given:fl", "male, Latin": "given:ml", "female, Cyrillic": "given:fc", "male, Cyrillic": "given:mc"}


def _array_sql(names: list[str]) -> str:
    return "array(" + ", ".join(map(_q, names)) + ")"


def _parts_sql(kind: str, e: str, gender: str) -> str:
    """What an entity is replaced by, part by part: w (as it stands), kind ('' stays as it is) and canonical. A name's parts are its runs of letters.

    A known given name has the kind of its list. So has the first of several words after a title that says the gender.
    Other words are of kind name; particles and single letters stay.
    """
    known = " ".join(f"WHEN array_contains({_array_sql(GIVEN[label])}, y.c) THEN '{code}'" for label, code in _CODES.items())
    script = "if(y.c rlike '\\\\p{IsCyrillic}', 'c', 'l')"
    part = f"CASE WHEN length(y.w) < 2 OR substr(y.w, 1, 1) = lower(substr(y.w, 1, 1)) THEN '' {known} WHEN y.i = 0 AND {gender} <> '' AND {e} rlike '[ -]' THEN concat('given:', {gender}, {script}) ELSE 'name' END"
    words = f"transform(transform(regexp_extract_all({e}, '\\\\p{{L}}+', 0), (w, i) -> named_struct('w', w, 'i', i, 'c', concat(upper(substr(w, 1, 1)), lower(substr(w, 2))))), y -> named_struct('w', y.w, 'kind', {part}, 'canonical', y.c))"
    return f"CASE {kind} WHEN 'number' THEN array() WHEN 'name' THEN {words} ELSE array(named_struct('w', {e}, 'kind', {kind}, 'canonical', {canonical_sql(kind, e)})) END"


def _seen(documents: DataFrame, *columns: str) -> DataFrame:
    """columns and `found`, the entities of each text that has any; read once, and written."""
    # generated, not projected: a filter on it would be pushed below a projection, and texts searched twice
    found = documents.select(*columns, F.explode(F.array(F.expr(_found("string(text)")))).alias("found"))
    return C.written(found.where("exists(found, x -> x.kind <> 'number')"), "pii-found")


def _asked(seen: DataFrame, *columns: str) -> DataFrame:
    """kind and canonical of each value to be replaced in each text."""
    parts = seen.select(*columns, F.explode(F.expr("flatten(transform(found, x -> x.parts))")).alias("x")).where("x.kind <> ''")
    return parts.select(*columns, F.col("x.kind").alias("kind"), F.col("x.canonical").alias("canonical"))


def _joined(seen: DataFrame) -> DataFrame:
    """value: the hyphenated names of the texts, which are real too."""
    whole = seen.select(F.explode("found").alias("x")).where("x.kind = 'name' and instr(x.e, '-') > 0")
    return whole.select(F.explode(F.regexp_extract_all("x.e", F.lit(r"\p{L}+(?:-\p{L}+)+"), F.lit(0))).alias("w")).select(F.initcap(F.regexp_replace("w", "-", " ")).alias("value")).select(F.regexp_replace("value", " ", "-").alias("value")).distinct()


def entities(documents: DataFrame) -> DataFrame:
    """kind and canonical, the distinct values of all texts that need a surrogate."""
    return _asked(_seen(documents)).distinct()


def _attempt(key: str, n: int) -> str:
    """SQL of the surrogate that the n-th attempt draws for kind, canonical."""
    more = max(0, n - WIDE + 1)
    grown = "canonical" if not more else (
        f"CASE kind WHEN 'name' THEN concat(substr(canonical, 1, length(canonical) - 1), repeat(if(canonical rlike '[а-яё]', 'а', 'a'), {more}), substr(canonical, -1)) "
        f"WHEN 'email' THEN concat(repeat('a', {more}), canonical) WHEN 'card' THEN canonical WHEN 'ip' THEN canonical WHEN 'ssn' THEN canonical ELSE concat(canonical, repeat('0', {more})) END"
    )
    again = f"{key}#{n}" if n else key
    return f"CASE WHEN kind LIKE 'given:%' THEN {_given_sql(again, n)} ELSE {permute_sql(again, 'kind', f'({grown})' if more else 'canonical')} END"


def _given_sql(key: str, n: int) -> str:
    """A given name's surrogate: first a name of its list (listed names change places in one keyed ring), then two names of it with a hyphen, later more."""
    cases = []
    for label, code in _CODES.items():
        names = GIVEN[label]
        drawn = lambda j, names=names: f"element_at({_array_sql(names)}, int(pmod({_shift_sql(key, 'kind', str(j), 'canonical')}, {len(names)})) + 1)"
        if n:
            several = ", ".join(drawn(j) for j in range(2 + max(0, n - WIDE + 1) // 4))
            cases.append(f"WHEN '{code}' THEN concat_ws('-', {several})")
        else:
            ring = sorted(names, key=lambda x: hashlib.sha256(f"{key}|{label}|{x}".encode()).digest())
            after = dict(zip(ring, ring[1:] + ring[:1], strict=True))
            cases.append(f"WHEN '{code}' THEN coalesce(element_at({_array_sql([after[x] for x in names])}, nullif(int(array_position({_array_sql(names)}, canonical)), 0)), {drawn(0)})")
    return f"CASE kind {' '.join(cases)} END"


def surrogates(real: DataFrame, key: str, besides: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """kind, canonical and the surrogate drawn first; and the same of those that drew again, with what they got (None if there is none).

    real: distinct kind, canonical. All surrogates that hold are distinct, and none is a value of `real` of any kind, or of `besides` (one column).
    """
    first = C.written(real.select("kind", "canonical", F.expr(_attempt(key, 0)).alias("surrogate")), "pii-first")
    me = F.struct("kind", "canonical")
    known = first.select("canonical") if besides is None else first.select("canonical").unionByName(besides.toDF("canonical"))
    by_value = first.select(F.col("surrogate").alias("v"), me.alias("of")).unionByName(known.select(F.col("canonical").alias("v"), F.lit(None).cast("struct<kind:string,canonical:string>").alias("of")))
    # a value counts once for each that got it, and as taken if it is real; of several the smallest keeps it
    met = by_value.groupBy("v").agg(F.count_if(F.col("of").isNull()).alias("real"), F.count("of").alias("n"), F.min("of").alias("winner")).where("(real > 0 and n > 0) or n > 1")
    met = met.select(F.col("v").alias("surrogate"), "real", F.col("winner.kind").alias("wk"), F.col("winner.canonical").alias("wc"))
    going = C.written(first.join(met, "surrogate").where("real > 0 or kind <> wk or canonical <> wc").select("kind", "canonical"), "pii-again")
    if going.isEmpty():
        return first, None
    taken = known.toDF("surrogate").unionByName(first.select("surrogate"))
    done = None
    for n in range(1, ATTEMPTS):
        drawn = C.written(going.select("kind", "canonical", F.expr(_attempt(key, n)).alias("surrogate")), "pii-drawn")
        hit = drawn.join(taken if done is None else taken.unionByName(done.select("surrogate")), "surrogate", "left_semi").select("surrogate")
        one = drawn.groupBy("surrogate").agg(F.min(me).alias("w")).join(hit.distinct(), "surrogate", "left_anti")
        one = C.written(one.select("w.kind", "w.canonical", "surrogate"), "pii-moved")
        done = one if done is None else done.unionByName(one)
        going = C.written(going.join(one, ["kind", "canonical"], "left_anti"), "pii-again")
        if going.isEmpty():
            return first, C.written(done, "pii-moved")
    raise ValueError(f"no free surrogate left for {going.select('kind').distinct().limit(5).collect()}")


def _final(first: DataFrame, moved: DataFrame | None) -> DataFrame:
    """kind, canonical and the surrogate that holds."""
    if moved is None:
        return first
    return first.join(moved.select("kind", "canonical"), ["kind", "canonical"], "left_anti").unionByName(moved)


def collisions(documents: DataFrame, key: str) -> DataFrame:
    """Surrogates of two entities, or that are a real one, as `replace` gives them: kind, surrogate, n. For audits: always empty. Given names count like all others."""
    seen = _seen(documents)
    final = _final(*surrogates(C.written(_asked(seen).distinct(), "pii-entities"), key, _joined(seen)))
    real = final.select("kind", F.col("canonical").alias("surrogate")).unionByName(_joined(seen).select(F.lit("name").alias("kind"), F.col("value").alias("surrogate")))
    drawn = final.select("surrogate", "kind", F.lit(1).alias("given")).unionByName(real.select("surrogate", "kind", F.lit(0).alias("given")))
    return drawn.groupBy("surrogate").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("given").alias("given")).where("given > 0 and n > 1").select("kind", "surrogate", "n")


def replace(documents: DataFrame, key: str) -> DataFrame:
    """documents with text rewritten, and n_entities, the entities replaced in it.

    Texts are searched once: what was found goes to a table by row. The distinct values get their surrogates there, and only
    rows that have an entity, which a broadcast filter flags, are joined with theirs.
    """
    base = documents.drop("n_entities")
    rid, flag, found, over = (C.free_name(base, n) for n in ("_rid", "_flag", "_found", "_over"))
    rows = C.numbered(base, rid)
    seen = _seen(rows, rid)
    asked = _asked(seen, rid).distinct()
    final = _final(*surrogates(C.written(asked.select("kind", "canonical").distinct(), "pii-entities"), key, _joined(seen)))
    given = asked.join(final, ["kind", "canonical"]).groupBy(rid).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canonical"), "surrogate"))).alias(over))
    own = C.written(seen.withColumnRenamed("found", found).join(given, rid), "pii-own")
    asked_rows = C.flagged(rows, F.col(rid), own.select(rid), flag)
    plain = asked_rows.where(~F.col(flag)).drop(flag, rid).withColumn("text", F.col("text").cast("string")).withColumn("n_entities", F.lit(0).cast("long"))
    return plain.unionByName(_rewritten(asked_rows.where(flag).drop(flag).join(own, rid, "left").drop(rid), found, over))


def _rewritten(rows: DataFrame, found: str, over: str) -> DataFrame:
    """Rows with their texts rewritten by what was found in them (null: nothing) and its surrogates by kind|canonical."""
    pieces = C.free_name(rows, "_pieces")
    rows = rows.withColumn(pieces, F.when(F.col(found).isNotNull(), F.split(F.col("text").cast("string"), PATTERN, -1)))
    value = f"element_at(`{over}`, concat_ws('|', q.kind, q.canonical))"
    by_sign = "array_join(transform(sequence(1, length(v)), i -> if(substr(q.w, i, 1) = lower(substr(q.w, i, 1)), substr(v, i, 1), upper(substr(v, i, 1)))), '')"
    word = f"if(q.kind = '', q.w, element_at(transform(array({value}), v -> CASE WHEN length(v) = length(q.w) THEN {by_sign} WHEN q.w = upper(q.w) THEN upper(v) ELSE v END), 1))"
    name = f"array_join(zip_with(split(x.e, '\\\\p{{L}}+', -1), concat(transform(x.parts, q -> {word}), array('')), (gap, w) -> concat(gap, w)), '')"
    other = f"element_at(transform(x.parts, q -> {layout_sql('x.kind', 'x.e', value)}), 1)"
    out = f"transform(`{found}`, x -> CASE x.kind WHEN 'number' THEN x.e WHEN 'name' THEN {name} ELSE {other} END)"
    joined = f"array_join(zip_with(`{pieces}`, concat({out}, array('')), (p, s) -> concat(p, s)), '')"
    n = F.expr(f"coalesce(size(filter(`{found}`, x -> x.kind <> 'number')), 0)").cast("long")
    rows = rows.withColumn("n_entities", F.when(F.col(found).isNull(), 0).otherwise(n).cast("long"))
    return rows.withColumn("text", F.when(F.col("n_entities") > 0, F.expr(joined)).otherwise(F.col("text").cast("string"))).drop(found, pieces, over)
