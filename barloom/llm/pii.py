r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

A kind has a pattern, a validator and a score. ``email``, ``ip``, ``card`` (Luhn) and ``phone`` form the
base: what their validator confirms is reported whatever its score. ``iban`` (mod 97) and ``secret`` (long
hexadecimal strings) are added by the method where the score, raised by context words shortly before the
span, reaches ``THRESHOLD``.

Spans are code points, end exclusive. Java's matches are the leftmost, non-overlapping ones; possessive
quantifiers and the look-behinds change nothing in what is matched, they keep long runs of word
characters or digits from being scanned again from each of their characters. Everything is a map over
documents with built-in functions; nothing is shuffled.

Null texts count as empty and hold nothing. Repeated rows give repeated results, empty tables empty
ones. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import let, running_total, whole

#: fixed values: characters of an IBAN by country code
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV",
    29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
THRESHOLD = 0.7
CONTEXT_CHARS = 24
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The check digit of a string of digits holds."""
    def step(total, digit):
        # odd totals of digits seen are kept in the sign bit of a pair (sum, place)
        doubled = digit * 2
        add = F.when(total["place"] % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)
        return F.struct((total["sum"] + add).alias("sum"), (total["place"] + 1).alias("place"))

    each = F.transform(F.split(F.reverse(value), ""), lambda d: d.cast("int"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("place"))
    return F.aggregate(each, zero, step, lambda t: t["sum"] % 10 == 0)


def card(value: Column) -> Column:
    return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def address(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False)))


def phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def mod97(value: Column) -> Column:
    """The country code and check digits, moved to the end, make the number 1 modulo 97."""
    def step(rest, ch):
        code = F.ascii(ch) - 55
        return F.when(code < 10, (rest * 10 + F.ascii(ch) - 48) % 97).otherwise((rest * 100 + code) % 97)

    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # as fast in Java as it gets
    plain: str  # the same matches in any dialect without look-behind
    valid: Callable[[Column], Column] | None
    base: bool
    score: float
    gain: float  # for a context word
    context: str  # words, as a pattern
    hint: str | None = None  # text without it has no match


def iban_pattern() -> str:
    """Of each country as many characters as its numbers have, in groups of four, so that no word after a
    number is taken for a part of it."""
    def shape(length: int, countries: str) -> str:
        groups, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}"

    return "(?:" + "|".join(shape(n, c) for n, c in IBAN_LENGTHS.items()) + ")"


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", None, True, 0.8, 0.2, "mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", address, True, 0.6, 0.3, "ip|address|server|host"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+",
         r"[0-9](?:[ -]?[0-9])+", card, True, 0.7, 0.3, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         r"\+[0-9][ ().0-9-]+[0-9]", phone, True, 0.6, 0.3, "phone|call|tel|mobile", "+"),
    # the look-ahead changes no match; it spares the countries' list where none can begin
    Kind("iban", r"(?=[A-Z]{2}[0-9]{2})" + iban_pattern(), iban_pattern(), mod97, False, 0.8, 0.2, "iban|account|bank|konto"),
    Kind("secret", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}+",
         r"[0-9A-Fa-f]{32,}", None, False, 0.4, 0.4, "token|secret|key|password|credential"),
)


def spans_of(body: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, by start."""
    pattern = F.lit(kind.pattern)

    def build(found):
        between = F.transform(F.split(body, kind.pattern), lambda s: F.length(s).cast("bigint"))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, value: gap + F.length(value))

        def assemble(ends):
            def span(value, i):
                end = F.element_at(ends, i + 1)
                start = end - F.length(value)
                first = F.greatest(start - CONTEXT_CHARS, F.lit(0).cast("bigint"))
                before = F.lower(F.substr(body, (first + 1).cast("int"), (start - first).cast("int")))
                score = F.lit(kind.score) + F.when(before.rlike(kind.context), F.lit(kind.gain)).otherwise(F.lit(0.0))
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"),
                                F.round(score, 2).alias("score"), value.alias("value"))

            return F.transform(found, span)

        return let(running_total(steps), assemble)

    found = F.regexp_extract_all(body, pattern, F.lit(0))
    spans = let(found, lambda f: F.when(F.size(f) > 0, build(f)).otherwise(F.array().cast(SPAN)))
    if kind.hint:
        spans = F.when(F.contains(body, F.lit(kind.hint)), spans).otherwise(F.array().cast(SPAN))
    keep = kind.valid or (lambda value: F.lit(True))
    wanted = lambda s: keep(s["value"]) if kind.base else keep(s["value"]) & (s["score"] >= THRESHOLD)
    return F.filter(spans, wanted)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per document: doc_id, and for each kind a column of its spans with value and score."""
    body = docs.select(F.col("doc_id"), whole("text").alias("body"))
    return body.select("doc_id", *[spans_of(F.col("body"), k).alias(k.name) for k in kinds])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all of them, as kind:start:end)."""
    found = find_spans(docs)

    def listed(names):
        spans = F.flatten(F.array(*names)) if len(names) > 1 else F.col(names[0])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(base), 256).alias("base_sha256"), listed([k.name for k in KINDS]).alias("spans"),
    )


def _kind_sql(k: Kind) -> str:
    valid = {
        "ip": "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS hugeint), 256) > 255)) = 0",
        "card": """len(dg) BETWEEN 13 AND 19 AND (
          SELECT sum(CASE WHEN (len(dg) - i) % 2 = 1 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END)
          FROM (SELECT i, CAST(dg[i] AS int) AS x FROM range(1, len(dg) + 1) r(i)) ds) % 10 = 0""",
        "phone": "len(dg) BETWEEN 9 AND 15",
        "iban": """len(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
          string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: ascii(c))),
          lambda r, c: CASE WHEN c < 65 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1""",
    }.get(k.name, "true")
    score = f"""{k.score} + CASE WHEN regexp_matches(lower(substr(body, greatest(s - {CONTEXT_CHARS}, 0) + 1,
      s - greatest(s - {CONTEXT_CHARS}, 0))), '{k.context}') THEN {k.gain} ELSE 0 END >= {THRESHOLD - 0.001}"""
    return f"""SELECT doc_id, {KINDS.index(k)} AS k, '{k.name}' AS kind, s, s + len(v) AS e FROM (
      SELECT doc_id, body, v, regexp_replace(v, '[^0-9]', '', 'g') AS dg,
        (list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0))::bigint AS s
      FROM (SELECT doc_id, body, found, string_split_regex(body, '{k.plain}') AS gaps, unnest(found) AS v,
              unnest(range(1, len(found) + 1)) AS i
            FROM (SELECT doc_id, body, regexp_extract_all(body, '{k.plain}') AS found FROM d) f WHERE len(found) > 0) u) w
      WHERE {valid}""" + ("" if k.base else f" AND {score}")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(k) for k in KINDS)}),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card,
    count(*) FILTER (k = 3) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
