"""Personal data: regular expressions propose spans, checks confirm them, words near them adjust the score.

The four base kinds keep every confirmed span.  Of the further kinds only spans with a score of LEAST or
more are kept: an account number of a registered country and length has that by itself; one of another
country, a social security number and a secret (a long run of letters and digits) need a word that says so.

All of it is column expressions: the gaps and the matches of one expression, in turn, give each match's
place.  The expressions neither restart inside a run nor backtrack into a group, so they stay linear
and need no stack on very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let

_LOCAL = r"[A-Za-z0-9._%+-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must contain for it to be tried, a score in hundredths, and words near a span that raise it."""

    name: str
    pattern: str
    needs: str
    score: int
    context: str
    mask: str
    more: int = 10
    least: int = 0


LEAST = 50
#: Characters before and after a span that are searched for context words.
NEAR = 30
#: Characters of an account number by country, as the register of account numbers has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An account number of its country's length that no letter or digit follows; else of any length, greedily."""
    tail = lambda n: rf"\x20?[A-Z0-9]{{{n}}}" if n else ""
    known = (rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{tail(n % 4)}\b" for n, countries in IBAN_LENGTHS.items())
    other = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    return "|".join((*known, other))


_REGISTERED = "^(?:" + "|".join(f"(?:{countries.replace(' ', '|')}).{{{n - 2}}}" for n, countries in IBAN_LENGTHS.items()) + ")$"
_RUN = "[A-Za-z0-9_+/-]"
#: The further kinds' patterns as SQL has them; here a look ahead or behind saves time, and an end of word is that of ASCII.
_IBAN, _SSN, _SECRET = _iban(), r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _RUN + "{20,}"
_WORD = "[A-Za-z0-9_]"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90, "e?-?mails?|contact|write|reach", "[EMAIL]"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 70, "ips?|hosts?|servers?|address|addresses", "[IP]"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "", 80, "cards?|visa|mastercard|pay|credit", "[CARD]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 70, "phones?|call|tel|mobile|fax", "[PHONE]"),
    Kind("iban", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})".replace(r"\b", f"(?!{_WORD})"), "", 80, "iban|accounts?|bank|konto", "[IBAN]", 20, LEAST),
    Kind("ssn", rf"(?<!{_WORD})[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!{_WORD})", "-", 30, "ssn|social security", "[SSN]", 40, LEAST),
    Kind("secret", rf"(?<!{_RUN}){_RUN}{{20,}}+", "", 30, "tokens?|secrets?|passwords?|passwd|api[ _-]?keys?|access[ _-]?keys?|credentials?|bearer", "[SECRET]", 40, LEAST),
)
_SPANS = "array<struct<s:bigint,kind:int,e:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has Luhn's checksum."""
    ordered = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(ordered, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 once its first four characters stand last and letters are 10 to 35."""
    turned = F.filter(F.split(F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4)), ""), lambda x: x != "")
    return F.aggregate(turned, F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return let(F.regexp_replace(match, r"[\x20-]", ""), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") if kind == "secret" else F.lit(True)


def _near_words(context: str) -> str:
    return f"(?:^|[^a-z0-9_])(?:{context})(?:$|[^a-z0-9_])"


def _points(kind: Kind, match: Column, text: Column, s: Column, e: Column) -> Column:
    """The score in hundredths: the kind's own (half for an account number of no registered form), and more with a context word near."""
    own = F.lit(kind.score)
    if kind.name == "iban":
        own = F.when(F.translate(match, " ", "").rlike(_REGISTERED), kind.score).otherwise(kind.score // 2)
    before = F.substr(text, F.greatest(F.lit(1), s - NEAR + 1).cast("int"), F.least(F.lit(NEAR), s).cast("int"))
    after = F.substr(text, (e + 1).cast("int"), F.lit(NEAR))
    return own + F.when(F.lower(F.concat(before, F.lit("  "), after)).rlike(_near_words(kind.context)), kind.more).otherwise(0)


def _spans(text: Column, number: int, kind: Kind) -> Column:
    none = F.array().cast(_SPANS)
    pattern = F.lit(kind.pattern)

    def placed(matches: Column) -> Column:
        def walk(gaps: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("j"), none.alias("out"))

            def step(a: Column, m: Column) -> Column:
                s = a["at"] + F.length(F.get(gaps, a["j"]))
                e = s + F.length(m)

                def scored(points: Column) -> Column:
                    span = F.struct(s.alias("s"), F.lit(number).alias("kind"), e.alias("e"), (points / 100.0).alias("score"))
                    return F.when(points >= kind.least, F.concat(a["out"], F.array(span))).otherwise(a["out"])

                out = F.when(_confirmed(kind.name, m), let(_points(kind, m, text, s, e), scored)).otherwise(a["out"])
                return F.struct(e.alias("at"), (a["j"] + 1).alias("j"), out.alias("out"))

            return F.aggregate(matches, start, step)["out"]

        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, kind.pattern), walk))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds `pii`: spans (s, kind as a number of KINDS, e, score) in order of start, then kind; code points, end exclusive.

    A null text is empty and has none.  Matches that fail their check are dropped, and nothing is tried
    again inside them.  Spans of different kinds may overlap.  A column `pii` is replaced; others stay.
    """
    return docs.withColumn("pii", _all_spans(text_col, kinds))


def _all_spans(text_col: str, kinds: tuple[Kind, ...]) -> Column:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.array_sort(F.concat(*(_spans(text, i, k) for i, k in enumerate(kinds))))


def redact_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Puts a mark such as [EMAIL] for every span; overlapping spans share the first one's mark.  Null stays null."""
    text = F.col(f"`{text_col}`").cast("string")
    marks = F.array(*(F.lit(k.mask) for k in kinds))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        piece = F.array(F.substr(text, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.get(marks, x["kind"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    def masked(spans: Column) -> Column:
        done = let(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, (a["at"] + 1).cast("int"))))
        return F.when(F.size(spans) == 0, text).otherwise(done)

    return docs.withColumn(text_col, let(_all_spans(text_col, kinds), masked))


def span_digest(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): counts of the base kinds, the hash of their spans, all spans as text, and their scores in hundredths."""
    found = find_pii(docs).select("doc_id", "pii")
    names = F.array(*(F.lit(k.name) for k in KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")
    count = lambda i: F.size(F.filter("pii", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{KINDS[i].name}") for i in range(4)), F.sha2(listed(F.filter("pii", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",").alias("scores"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_kind(number: int, pattern: str, check: str) -> str:
    kind = KINDS[number]
    own = f"CASE WHEN regexp_matches(replace(m, ' ', ''), '{_REGISTERED}') THEN {kind.score} ELSE {kind.score // 2} END" if kind.name == "iban" else str(kind.score)
    return f"""SELECT r, {number} AS k, '{kind.name}' AS name, m, s, {own} + CASE WHEN regexp_matches(lower(substr(text, greatest(1, s - {NEAR - 1}), least({NEAR}, s)) || '  ' || substr(text, s + length(m) + 1, {NEAR})), '{_near_words(kind.context)}') THEN {kind.more} ELSE 0 END AS points
    FROM (SELECT r, m, CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS j FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM d))
    WINDOW w AS (PARTITION BY r ORDER BY j) QUALIFY {check}) JOIN d USING (r) WHERE points >= {kind.least}"""


_LUHN = "CASE WHEN length(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 14 AND 19 THEN list_sum(list_transform(string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) ELSE CAST(x AS INT) * 2 - CASE WHEN CAST(x AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 ELSE false END"
_MOD97 = "CAST(array_to_string(list_transform(string_split(replace(m, ' ', '')[5:] || m[:4], ''), lambda x: CASE WHEN x >= 'A' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), '') AS VARCHAR)"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
a AS ({_sql_kind(0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
UNION ALL {_sql_kind(1, "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) <= 255))")}
UNION ALL {_sql_kind(2, "[0-9](?:[ -]?[0-9])+", _LUHN)}
UNION ALL {_sql_kind(3, "[+][0-9][ ().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15")}
UNION ALL {_sql_kind(4, _IBAN, f"list_reduce(list_transform(string_split({_MOD97}, ''), lambda x: CAST(x AS INT)), lambda p, q: (p * 10 + q) % 97) = 1")}
UNION ALL {_sql_kind(5, _SSN, "NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$')")}
UNION ALL {_sql_kind(6, _SECRET, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
s AS (SELECT r, k, name || ':' || s || ':' || s + length(m) AS t, s, points FROM a),
g AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, string_agg(t, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(t, ',' ORDER BY s, k) AS spans, string_agg(CAST(points AS VARCHAR), ',' ORDER BY s, k) AS scores FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (r)
"""
