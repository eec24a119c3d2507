"""Format-preserving pseudonyms for personal numbers and dates, by DataFrame functions alone.

Found and validated: payment cards (Luhn), bank accounts (IBAN, mod 97), social security numbers (issued ranges), phone
numbers (North American, or international with +), IPv4 addresses (octets), dates (calendar, 1900 to 2099) and the local
part of e-mail addresses. What doesn't validate stays as it is.

Each value becomes a row of symbols with a modulus each, without its separators: digits, letters, an address's two
halves, a day's two coordinates. A keyed Feistel network permutes such rows: one half is shifted, symbol by symbol, by a
hash of key, kind, round and the other half. So a pseudonym has its value's format and validates too (check digits are
made anew), different values of one format have different pseudonyms, and equal values get equal ones in all documents
and in any notation, without any table of values.

The key has no default. It travels as a row of a table, so neither SQL text nor plans nor event logs hold it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.llm.common import free

ROUNDS = 10

_A, _B = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
#: The lengths of IBANs and the countries that have them (registry of ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(n: int) -> str:
    """Pattern of n characters in groups of four, with or without spaces."""
    return f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "")


#: By the length of the country; of others, any length.
IBAN = _A + "(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{_grouped(n - 4)}{_B}" for n, c in IBAN_LENGTHS.items()) + rf"|(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_B})"
#: With a time behind it or not.
DATE = _A + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:(?![0-9A-Za-z])|(?=[Tt][0-9]{2}:?[0-9]{2}))"
CARD = _A + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _B
SSN = _A + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _B
PHONE = r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _B
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]{1,4}\)?){2,6}" + _B
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
#: In the order in which they are tried at a place.
PATTERNS = {"email": EMAIL, "iban": IBAN, "date": DATE, "card": CARD, "ssn": SSN, "phone": PHONE, "abroad": ABROAD, "ipv4": IPV4}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without this have nothing to find.
HINT = "[0-9@]"
#: Kinds of the result's counts.
KINDS = ("email", "iban", "date", "card", "ssn", "phone", "ipv4")

#: Days from 1900-01-01 to 2099-12-31 as a grid.
DAYS_A, DAYS_B = 17, 4297


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def permuted(symbols: str, moduli: str, kind: str, key: str) -> str:
    """SQL: the array of symbols, each below its modulus, under the keyed permutation of such rows. key names a column."""

    def shifted(half: str, offset: str, other: str) -> str:
        hashed = f"conv(substring(sha2(concat_ws('|', {key}, '{kind}', cast(r AS STRING), array_join({other}, ','), cast(i AS STRING)), 256), 1, 12), 16, 10)"
        return f"transform({half}, (x, i) -> pmod(x + cast({hashed} AS BIGINT), element_at(s.m, i + 1 + {offset})))"

    start = f"named_struct('m', transform({moduli}, x -> cast(x AS BIGINT)), 'l', slice(v.a, 1, v.h), 'r', slice(v.a, v.h + 1, size(v.a)))"
    left = f"if(r % 2 = 0, {shifted('s.l', '0', 's.r')}, s.l)"
    right = f"if(r % 2 = 1, {shifted('s.r', 'size(s.l)', 's.l')}, s.r)"
    kind_of = "STRUCT<m: ARRAY<BIGINT>, l: ARRAY<BIGINT>, r: ARRAY<BIGINT>>"
    net = f"aggregate(sequence(1, {ROUNDS}), cast({start} AS {kind_of}), (s, r) -> cast(named_struct('m', s.m, 'l', {left}, 'r', {right}) AS {kind_of}), s -> concat(s.l, s.r))"
    return let("v", f"named_struct('a', transform({symbols}, x -> cast(x AS BIGINT)), 'h', cast(ceil(size({symbols}) / 2) AS INT))", net)


def let(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def characters(text: str) -> str:
    """SQL: the array of a string's characters."""
    return f"filter(split({text}, ''), x -> x <> '')"


def refilled(form: str, new: str, what: str) -> str:
    """SQL: form with its characters that match ``what`` replaced by the characters of new, in order."""
    step = f"if(x RLIKE '{what}', named_struct('o', concat(s.o, substring({new}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, x), 'k', s.k))"
    return f"aggregate({characters(form)}, named_struct('o', '', 'k', 1), (s, x) -> {step}, s -> s.o)"


def luhn_sum(number: str) -> str:
    """SQL: the weighted sum of a digit string, its last digit counting once."""
    d = "cast(substring(n, i, 1) AS INT)"
    return let("n", f"reverse({number})", f"aggregate(sequence(1, length(n)), 0, (s, i) -> s + if(i % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))")


def mod97(number: str) -> str:
    """SQL: the remainder by 97 of an IBAN rearranged (letters count 10 to 35)."""
    value = "if(x RLIKE '[0-9]', ascii(x) - 48, ascii(x) - 55)"
    return f"aggregate({characters(number)}, 0, (s, x) -> if(x RLIKE '[0-9]', (s * 10 + {value}) % 97, (s * 100 + {value}) % 97))"


def joined(symbols: str) -> str:
    return f"array_join({symbols}, '')"


def _classed(text: str, kind: str, key: str) -> str:
    """SQL: letters and digits permuted within their classes, other characters as they are."""
    base = "CASE WHEN x RLIKE '[0-9]' THEN 48 WHEN x RLIKE '[a-z]' THEN 97 ELSE 65 END"
    body = let("z", f"filter({characters(text)}, x -> x RLIKE '[0-9A-Za-z]')", let("y", permuted(f"transform(z, x -> ascii(x) - {base})", "transform(z, x -> if(x RLIKE '[0-9]', 10, 26))", kind, key), joined(f"zip_with(y, z, (q, x) -> chr(cast(q AS INT) + {base}))")))
    return let("new", body, refilled(text, "new", "[0-9A-Za-z]"))


def _email(m: str, key: str) -> str:
    at = f"instr({m}, '@')"
    return f"concat({_classed(f'substring({m}, 1, {at} - 1)', 'email', key)}, substring({m}, {at}))"


def _card(m: str, key: str) -> str:
    body = "substring(d, 2, length(d) - 2)"
    new = joined(permuted(characters(body), f"transform({characters(body)}, x -> 10)", "card", key))
    check = f"cast(pmod(10 - {luhn_sum('concat(p, 0)')} % 10, 10) AS STRING)"
    return let("d", digits(m), let("p", f"concat(substring(d, 1, 1), {new})", let("new", f"concat(p, {check})", refilled(m, "new", "[0-9]"))))


def _phone(m: str, key: str) -> str:
    high = lambda i: f"if(i IN (0, 3), if(element_at(z, {i} + 1) > 1, 8, 2), 10)"
    low = "if(i IN (0, 3) AND x > 1, 2, 0)"
    z = f"transform({characters('right(' + digits(m) + ', 10)')}, x -> cast(x AS INT))"
    new = joined(f"zip_with({permuted(f'transform(z, (x, i) -> x - {low})', f'transform(z, (x, i) -> {high("i")})', 'phone', key)}, transform(z, (x, i) -> {low}), (q, w) -> cast(q AS INT) + w)")
    return let("z", z, let("new", f"concat(left({digits(m)}, length({digits(m)}) - 10), {new})", refilled(m, "new", "[0-9]")))


def _abroad(m: str, key: str) -> str:
    d = characters(f"substring({digits(m)}, 2, 40)")
    return let("new", f"concat(substring({digits(m)}, 1, 1), {joined(permuted(d, f'transform({d}, x -> 10)', 'abroad', key))})", refilled(m, "new", "[0-9]"))


def _ipv4(m: str, key: str) -> str:
    o = lambda k: f"cast(element_at(o, {k}) AS INT)"
    new = permuted(f"array({o(1)} * 256 + {o(2)}, {o(3)} * 256 + {o(4)})", "array(65536, 65536)", "ipv4", key)
    return let("o", f"split({m}, '[.]')", let("y", new, "concat_ws('.', cast(floor(y[0] / 256) AS STRING), cast(y[0] % 256 AS STRING), cast(floor(y[1] / 256) AS STRING), cast(y[1] % 256 AS STRING))"))


def _ssn(m: str, key: str) -> str:
    """Areas 001 to 665 and 667 to 899, groups 01 to 99, serials 0001 to 9999."""
    area = f"cast(substring({m}, 1, 3) AS INT)"
    row = f"array(({area} - if({area} > 666, 2, 1)) * 99 + cast(substring({m}, 5, 2) AS INT) - 1, cast(substring({m}, 8, 4) AS INT) - 1)"
    area2 = "cast(floor(y[0] / 99) AS INT)"
    return let("y", permuted(row, f"array({898 * 99}, 9999)", "ssn", key), f"concat_ws('-', lpad(cast({area2} + if({area2} > 664, 2, 1) AS STRING), 3, '0'), lpad(cast(y[0] % 99 + 1 AS STRING), 2, '0'), lpad(cast(y[1] + 1 AS STRING), 4, '0'))")


def _day(m: str) -> str:
    """SQL: the date that a match gives, day first where both orders are dates; null if none."""
    dmy = f"try_to_date(concat(substring({m}, 7, 4), substring({m}, 4, 2), substring({m}, 1, 2)), 'yyyyMMdd')"
    mdy = f"try_to_date(concat(substring({m}, 7, 4), substring({m}, 1, 2), substring({m}, 4, 2)), 'yyyyMMdd')"
    return f"CASE WHEN {m} LIKE '____-%' THEN try_to_date(replace({m}, '-', ''), 'yyyyMMdd') WHEN {m} LIKE '__/%' THEN coalesce({dmy}, {mdy}) ELSE {dmy} END"


def _date(m: str, key: str) -> str:
    n = f"datediff({_day(m)}, DATE'1900-01-01')"
    american = f"{m} LIKE '__/%' AND cast(substring({m}, 4, 2) AS INT) > 12"
    row = f"array(cast(floor(n / {DAYS_B}) AS INT), n % {DAYS_B})"
    shape = f"date_format(date_add(DATE'1900-01-01', cast(y[0] * {DAYS_B} + y[1] AS INT)), CASE WHEN {m} LIKE '____-%' THEN 'yyyy-MM-dd' WHEN {american} THEN 'MM/dd/yyyy' WHEN {m} LIKE '__/%' THEN 'dd/MM/yyyy' ELSE 'dd.MM.yyyy' END)"
    return let("n", n, let("y", permuted(row, f"array({DAYS_A}, {DAYS_B})", "date", key), shape))


def _iban(m: str, key: str) -> str:
    return let("d", f"replace({m}, ' ', '')", let("q", _classed("substring(d, 5, 40)", "iban", key), let("new", f"concat(substring(d, 1, 2), lpad(cast(98 - {mod97('concat(q, substring(d, 1, 2), 0, 0)')} AS STRING), 2, '0'), q)", refilled(m, "new", "[0-9A-Z]"))))


def kind(m: str) -> str:
    """SQL: the kind of a match, null if it doesn't validate."""
    whole = {k: _quoted(f"^(?:{p})$") for k, p in PATTERNS.items()}
    octets = f"forall(split({m}, '[.]'), x -> cast(x AS INT) < 256)"
    area, group, serial = f"cast(substring({m}, 1, 3) AS INT)", f"substring({m}, 5, 2)", f"substring({m}, 8, 4)"
    iban = let("d", f"replace({m}, ' ', '')", f"length(d) BETWEEN 15 AND 34 AND {mod97('concat(substring(d, 5, 40), substring(d, 1, 4))')} = 1")
    return f"""CASE WHEN {m} LIKE '%@%' THEN 'email'
      WHEN {m} RLIKE {whole['iban']} THEN if({iban}, 'iban', NULL)
      WHEN {m} RLIKE {whole['date']} THEN if({_day(m)} BETWEEN DATE'1900-01-01' AND DATE'2099-12-31', 'date', NULL)
      WHEN {m} RLIKE {whole['card']} AND {luhn_sum(digits(m))} % 10 = 0 THEN 'card'
      WHEN {m} RLIKE {whole['ssn']} THEN if({area} NOT IN (0, 666) AND {area} < 900 AND {group} <> '00' AND {serial} <> '0000', 'ssn', NULL)
      WHEN {m} RLIKE {whole['phone']} THEN 'phone'
      WHEN {m} RLIKE {whole['abroad']} THEN if(length({digits(m)}) BETWEEN 8 AND 15, 'abroad', NULL)
      WHEN {m} RLIKE {whole['ipv4']} THEN if({octets}, 'ipv4', NULL) END"""


def pseudonym(m: str, key: str) -> str:
    """SQL: struct(kind, value) of a match; kind is null and value the match itself if it doesn't validate. key names a column."""
    by = {"email": _email, "iban": _iban, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "ipv4": _ipv4}
    cases = " ".join(f"WHEN '{k}' THEN {f(m, key)}" for k, f in by.items())
    return let("kind", kind(m), f"named_struct('kind', if(kind = 'abroad', 'phone', kind), 'value', CASE kind {cases} ELSE {m} END)")


def keys(spark: SparkSession, key: str) -> DataFrame:
    """The key as a table of one row, whose plan doesn't show it."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return spark.createDataFrame(pa.table({"key": [key]}))


def counts_name(docs: DataFrame) -> str:
    """The name of the column that pseudonymise() adds: _pii, with underscores behind it if docs has that already."""
    return free("_pii", docs.columns)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and a struct (counts_name()) of how many values of each of KINDS were replaced.

    A null text stays null and counts nothing; an empty one stays empty. Texts without values come out as they were; texts
    of any length are read as a whole. Repeated rows give repeated results, an empty table an empty one; all columns are
    kept, whatever their names. Values are found at the leftmost place, in the order of PATTERNS (so where two kinds could
    begin, the first one has it), and don't overlap.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.col(f"_row.`{text_col}`")
    rows = docs.select(row).withColumn("_found", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    some = F.coalesce(F.size("_found") > 0, F.lit(False))
    rows = rows.withColumn("_key", keys(docs.sparkSession, key).scalar())
    rows = rows.withColumn("_new", F.when(some, F.expr(f"transform(_found, m -> {pseudonym('m', '_key')})")))
    between = F.split(text, ANY, -1)
    whole = F.array_join(F.zip_with(between, F.concat(F.transform("_new", lambda x: x["value"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    new = F.when(F.col("_new").isNotNull(), whole).otherwise(text)
    columns = [new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    n = {k: F.expr(f"size(filter(_new, x -> x.kind = '{k}'))") for k in KINDS}
    counts = F.struct(*[F.when(F.col("_new").isNull(), F.lit(0)).otherwise(c).cast("long").alias(f"n_{k}") for k, c in n.items()])
    return rows.select(*columns, counts.alias(counts_name(docs)))
