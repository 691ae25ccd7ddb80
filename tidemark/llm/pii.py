"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Each kind has a pattern, whose matches are taken from left to right without overlap, a check that a match
must pass (Luhn for card numbers, mod-97 for IBANs, ranges of parts, counts of digits), and a score in
hundredths. A word of the kind near a match raises its score by CONTEXT, a word of examples and of other numbers
lowers it as much. "Near" are NEAR characters on either side, up to the next match of the same pattern. Spans of
BASE kinds stay whatever their score; those of other kinds stay from LEAST on.

Only built-in functions are used and nothing is shuffled: a match's place is the length of all pieces and matches
before it, added up in blocks, so that a text of very many matches takes time in proportion to them. Patterns are
written so that they never go back over a long run of characters.

Spans are in code points, ends exclusive, by kind and then start. A null text counts as empty. Rows are never merged, and a null id
changes nothing. An empty table gives an empty one. A column of the input that is named spans is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEAR, CONTEXT, LEAST = 48, 25, 60
#: Matches whose lengths are added up as one block.
BLOCK = 64
#: Words beside which any number is rather an example than somebody's.
COUNTER = "example|sample|dummy|version|release|isbn|sku"


@dataclass(frozen=True)
class Pattern:
    """sql: as it is defined; java: the same matches, but each run of characters is read once; hint: texts without it have no match."""

    sql: str
    java: str
    hint: str


# The possessive forms are equal because what follows a run is never part of its class. A match starts within
# a run only where the last match ended (\G), since if it could start inside, it could start at the run's beginning.
PATTERNS = {
    "email": Pattern(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": Pattern(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": Pattern(r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": Pattern(r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": Pattern(*[r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?"] * 2, ""),
    "ssn": Pattern(*[r"[0-9]{3}-[0-9]{2}-[0-9]{4}"] * 2, "-"),
    "local": Pattern(*[r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"] * 2, ""),
}

_PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(\.{_PART}){{3}}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m["text"])).between(least, most) & F.call_function("luhn_check", _digits(m["text"]))


def _apart(m: Column, chars: str) -> Column:
    return ~m["before"].rlike(f"[{chars}]$") & ~m["after"].rlike(f"^[{chars}]")


def _mod_97(m: Column) -> Column:
    compact = F.replace(m["text"], F.lit(" "))
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(compact).between(15, 34) & _apart(m, "A-Za-z0-9") & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


@dataclass(frozen=True)
class Kind:
    """name of the kind, the pattern that proposes it, its score and its words; check: of a match, as a column and as SQL on s, prev and next."""

    name: str
    pattern: str
    score: int
    words: str
    check: Callable[[Column], Column]
    sql: str


_LUHN_SQL = "list_sum(list_transform(string_split(reverse(dg), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS BIGINT) ELSE CAST(c AS BIGINT) * 2 // 10 + CAST(c AS BIGINT) * 2 % 10 END)) % 10 = 0"
_APART_SQL = "NOT regexp_matches(prev, '[{0}]$') AND NOT regexp_matches(nxt, '^[{0}]')"
_MOD_97_SQL = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(s, ' ', ''), 5) || left(s, 4), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1"

BASE = (
    Kind("email", "email", 90, "mail|contact|write|reply", lambda m: F.lit(True), "true"),
    Kind("ip", "ip", 60, "address|host|server|client|login|ip", lambda m: m["text"].rlike(_IP), f"regexp_matches(s, '{_IP}')"),
    Kind("card", "card", 85, "card|visa|credit|debit|payment|account", _card(16, 19), f"length(dg) BETWEEN 16 AND 19 AND {_LUHN_SQL}"),
    Kind("phone", "phone", 70, "phone|call|mobile|cell|fax", lambda m: F.length(_digits(m["text"])).between(8, 15), "length(dg) BETWEEN 8 AND 15"),
)
MORE = (
    Kind("iban", "iban", 85, "iban|account|bank|transfer|konto|compte|cuenta", _mod_97, f"length(replace(s, ' ', '')) BETWEEN 15 AND 34 AND {_APART_SQL.format('A-Za-z0-9')} AND {_MOD_97_SQL}"),
    Kind("short_card", "card", 45, "card|amex|credit|debit|payment", _card(13, 15), f"length(dg) BETWEEN 13 AND 15 AND {_LUHN_SQL}"),
    Kind("ssn", "ssn", 45, "ssn|social|security|tax", lambda m: _apart(m, "0-9-") & ~m["text"].rlike("^(000|666|9)|-00-|-0000$"), f"{_APART_SQL.format('0-9-')} AND NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$')"),
    Kind("local", "local", 45, "phone|call|mobile|cell|fax|tel", lambda m: _apart(m, "0-9+.-"), _APART_SQL.format("0-9+.-")),
)
KINDS = BASE + MORE

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:int>>"


def _matches(text: Column, p: Pattern) -> Column:
    found = F.regexp_extract_all(text, F.lit(p.java), F.lit(0))
    return F.when(F.contains(text, F.lit(p.hint)), found).otherwise(F.array().cast("array<string>")) if p.hint else found


def _blocks(lengths: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))


def _total(lengths: Column, first: Column, last: Column) -> Column:
    """The sum of some elements, which are read in place: a slice would copy the array."""
    return F.aggregate(F.sequence(first, F.least(last, F.size(lengths))), F.lit(0).cast("bigint"), lambda a, k: a + F.element_at(lengths, k))


def _before(lengths: Column) -> Column:
    """Running totals up to each block of an array."""
    sums = F.transform(_blocks(lengths), lambda b: _total(lengths, b * BLOCK + 1, b * BLOCK + BLOCK))
    return F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def _ends(lengths: Column, before: Column) -> Column:
    """Running totals of an array, from those up to each block. Both are columns of their own, so that no element computes them anew."""
    block = lambda k: F.floor((k - 1) / BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda k: F.element_at(before, block(k) + 1) + _total(lengths, block(k) * BLOCK + 1, k))
    return F.when(F.size(before) > 1, each)


def _placed(name: str) -> Column:
    """Matches of a pattern with their places and what stands beside them, from the columns of matches, pieces and ends."""
    m, piece, end = F.col(f"m_{name}"), F.col(f"p_{name}"), F.col(f"e_{name}")
    return F.transform(m, lambda x, i: F.struct(
        x.alias("text"), (F.element_at(end, i + 1) - F.length(x)).alias("start"), F.element_at(end, i + 1).alias("end"),
        F.right(F.element_at(piece, i + 1), F.lit(NEAR)).alias("before"), F.left(F.element_at(piece, i + 2), F.lit(NEAR)).alias("after"),
    ))


def _judged(kind: Kind, base: bool) -> Column:
    def span(m: Column) -> Column:
        beside = F.lower(F.concat(m["before"], F.lit(" "), m["after"]))
        score = F.lit(kind.score) + F.when(beside.rlike(kind.words), CONTEXT).otherwise(0) - F.when(beside.rlike(COUNTER), CONTEXT).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].cast("bigint").alias("start"), m["end"].cast("bigint").alias("end"), F.least(score, F.lit(100)).alias("score"))

    spans = F.transform(F.filter(F.col(f"c_{kind.pattern}"), kind.check), span)
    return spans if base else F.filter(spans, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs (with text) and spans: array of (kind, start, end, score)."""
    kept = [c for c in docs.columns if c.lower() != "spans"]
    raw = F.coalesce("text", F.lit(""))
    names = list(dict.fromkeys(k.pattern for k in kinds))
    none = F.array().cast("array<struct<text:string,start:bigint,end:bigint,before:string,after:string>>")
    # Columns are derived step by step within one struct, so that no name can clash with those of docs.
    out = docs.select(F.struct(*kept).alias("row"), raw.alias("raw"))
    out = out.select("row", "raw", *(_matches(F.col("raw"), PATTERNS[n]).alias(f"m_{n}") for n in names))
    out = out.select("row", *(f"m_{n}" for n in names), *(F.when(F.size(f"m_{n}") > 0, F.split("raw", PATTERNS[n].java, -1)).alias(f"p_{n}") for n in names))
    lengths = lambda n: F.zip_with(F.slice(f"p_{n}", F.lit(1), F.size(f"m_{n}")), f"m_{n}", lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
    out = out.select("*", *(F.when(F.size(f"m_{n}") > 0, lengths(n)).alias(f"l_{n}") for n in names))
    out = out.select("*", *(F.when(F.size(f"m_{n}") > 0, _before(F.col(f"l_{n}"))).alias(f"b_{n}") for n in names))
    out = out.select("*", *(_ends(F.col(f"l_{n}"), F.col(f"b_{n}")).alias(f"e_{n}") for n in names))
    out = out.select("row", *(F.when(F.size(f"m_{n}") > 0, _placed(n)).otherwise(none).alias(f"c_{n}") for n in names))
    return out.select("row.*", F.concat(*(_judged(k, k in BASE).cast(_SPAN) for k in kinds)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its personal data; scores: of the spans, in their order."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in BASE]))
    return found.select(
        "doc_id", *(of(k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _oracle() -> str:
    steps, spans = [], []
    for n, p in PATTERNS.items():
        steps.append(
            f"r_{n} AS (SELECT doc_id, regexp_extract_all(t, '{p.sql}') AS m, regexp_split_to_array(t, '{p.sql}') AS p FROM d), "
            f"u_{n} AS (SELECT doc_id, unnest(m) AS s, generate_subscripts(m, 1) AS i, p FROM r_{n}), "
            f"c_{n} AS (SELECT doc_id, s, regexp_replace(s, '[^0-9]', '', 'g') AS dg, sum(length(p[i]) + length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS e, right(p[i], {NEAR}) AS prev, left(p[i + 1], {NEAR}) AS nxt FROM u_{n})"
        )
    for rank, k in enumerate(KINDS):
        near = "lower(prev || ' ' || nxt)"
        score = f"least({k.score} + CASE WHEN regexp_matches({near}, '{k.words}') THEN {CONTEXT} ELSE 0 END - CASE WHEN regexp_matches({near}, '{COUNTER}') THEN {CONTEXT} ELSE 0 END, 100)"
        stays = "true" if k in BASE else f"{score} >= {LEAST}"
        spans.append(f"SELECT doc_id, '{k.name}' AS kind, {rank} AS rank, e - length(s) AS b, '{k.name}:' || CAST(e - length(s) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span, {score} AS score FROM c_{k.pattern} WHERE {k.sql} AND {stays}")
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in BASE)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(steps) + ", spans AS (" + " UNION ALL ".join(spans) + f"""),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY rank, b) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY rank, b) AS spans, string_agg(score, ',' ORDER BY rank, b) AS scores FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)"""
    )


ORACLE = _oracle()
