"""Personal data, built from SQL functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97
for bank account numbers, part values, digit counts), and words close before a
span raise its score.

The patterns are written so that Java's matcher neither backtracks through a
run twice nor recurses: a start is taken only at the beginning of a run, and
repeated groups have a fixed count. Places and pieces come from ``spans``, so a text of
any length with any number of spans costs about linear time.

Results by case: a null text counts as empty and has no spans; an empty table
gives no rows; repeated rows each give their own row; columns of the input are
kept, apart from those named as the output's own, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import filled
from eventloom.llm.spans import blocks, let, piece, running, running_sums

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: Kinds in their fixed order. ``iban`` is this operator's own addition.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++\.{_HOST}[A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that, close before a span, make its kind more likely (fixed values).
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.75, "phone": 0.6, "iban": 0.85}
CONTEXT_SCORE = 0.15
CONTEXT_CHARS = 40


def matches(text: Column, pattern: str) -> Column:
    """All matches with places: array of (start, end, value), in code points, end exclusive.

    Matches and the text between them alternate, so running lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("skip"), m.alias("value")))

    def placed(held: Column) -> Column:
        ends = running_sums(F.transform(held, lambda p: p["skip"] + F.length(p["value"])))
        return F.zip_with(held, ends, lambda p, e: F.struct((e - F.length(p["value"])).alias("start"), e.alias("end"), p["value"].alias("value")))

    return let(pairs, placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda d, i: d.cast("int") * (1 + i % 2) - F.when(d.cast("int") * (1 + i % 2) > 9, 9).otherwise(0),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    digits = F.transform(
        F.regexp_extract_all(moved, F.lit("[A-Z0-9]"), F.lit(0)),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return rest == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


_CONFIRM = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "iban": mod97,
}


def _gates(text: Column) -> dict[str, Column]:
    """Cheap tests that every text with a span of the kind passes."""
    digit = text.rlike("[0-9]")
    return {
        "email": text.contains("@"),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]"),
        "card": digit & text.rlike("[0-9](?:[ -]?[0-9]){15}"),
        "phone": text.contains("+"),
        "iban": digit & text.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]"),
    }


def detect(df: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Add ``output``: array of (kind, start, end, value, score), by kind as listed, then start."""
    whole = filled(text)
    gates = _gates(whole)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")

    def of(kind: str) -> Column:
        def scored(cut: Column, span: Column) -> Column:
            before = piece(cut, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["start"])
            near = before.rlike(rf"(?i)\b(?:{CONTEXT[kind]})")
            score = F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), score.alias("score"))

        spans = F.filter(matches(whole, PATTERNS[kind]), lambda s: _CONFIRM[kind](s["value"]))
        found = let(spans, lambda held: F.when(F.size(held) == 0, none).otherwise(let(blocks(whole), lambda cut: F.transform(held, lambda s: scored(cut, s)))))
        return F.when(gates[kind], found).otherwise(none)

    return df.withColumn(output, F.concat(*[of(kind) for kind in KINDS]))


def places(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """Counts per kind, the hash of the base spans and the places of all, one row per document."""
    every = F.col(spans)
    base = F.filter(every, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(places(base), 256).alias("base_sha256"),
        places(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(found: DataFrame, spans: str = "pii", text: str = "text") -> DataFrame:
    """Replace every span by ``[KIND]``; overlapping spans become one, named by the first."""
    slim = F.transform(F.col(spans), lambda s: F.struct(s["start"], s["end"], s["kind"]))

    def cleaned(held: Column, reach: Column, cut: Column) -> Column:
        """Spans in order, how far they and those before reach, and the text in blocks."""
        n = F.size(held)
        # A span begins a new one if none before it reaches it.
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(held, i)["start"] >= F.get(reach, i - 1)))

        def written(at: Column) -> Column:
            def one(head: Column, k: Column) -> Column:
                begin = F.when(k == 0, F.lit(0)).otherwise(F.get(reach, head - 1))
                span = F.get(held, head)
                return F.concat(piece(cut, begin, span["start"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))

            return F.concat(F.array_join(F.transform(at, one), ""), piece(cut, F.get(reach, n - 1), F.length(text)))

        return let(heads, written)

    whole = let(
        F.array_sort(slim),
        lambda held: let(
            running(F.transform(held, lambda s: s["end"]), lambda a, b: F.greatest(a, b)),
            lambda reach: let(blocks(F.col(text)), lambda cut: cleaned(held, reach, cut)),
        ),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop(spans)


#: The stated base patterns, and the added one, as plain regular expressions for the SQL below (fixed values).
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
}


def oracle() -> str:
    """The same in DuckDB SQL, from the plain patterns: places by running lengths of matches and of what stands between."""
    branches = " UNION ALL ".join(
        f"SELECT doc_id, text, '{kind}' AS kind, {i} AS ord, regexp_extract_all(text, '{rx}') AS found, string_split_regex(text, '{rx}') AS gaps FROM docs"
        for i, (kind, rx) in enumerate(PLAIN.items())
    )
    near = " ".join(f"WHEN '{kind}' THEN regexp_matches(before, '(?i)\\b(?:{words})')" for kind, words in CONTEXT.items())
    score = " ".join(f"WHEN '{kind}' THEN {value}" for kind, value in BASE_SCORE.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({branches}),
each AS (SELECT doc_id, text, kind, ord, unnest(range(len(found))) AS k, unnest(found) AS v, unnest(gaps[:len(found)]) AS g FROM hits),
placed AS (
  SELECT *, CAST(sum(len(v) + len(g)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d,
    substr(replace(v, ' ', ''), 5) || substr(v, 1, 4) AS moved FROM each),
checked AS (
  SELECT *, e - len(v) AS s, CASE kind WHEN 'email' THEN true WHEN 'ip' THEN regexp_full_match(v, '(?:{_PART}\\.){{3}}{_PART}')
    WHEN 'card' THEN len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(len(d)), lambda i:
      CAST(d[len(d) - i] AS INTEGER) * (1 + i % 2) - CASE WHEN CAST(d[len(d) - i] AS INTEGER) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
    WHEN 'phone' THEN len(d) BETWEEN 8 AND 15
    ELSE list_reduce(list_concat([0], list_transform(range(1, len(moved) + 1), lambda i:
      CASE WHEN moved[i] BETWEEN '0' AND '9' THEN ascii(moved[i]) - 48 ELSE ascii(moved[i]) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
    END AS ok FROM placed),
span AS (
  SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || e AS place, substr(text, greatest(s - {CONTEXT_CHARS}, 0) + 1, s - greatest(s - {CONTEXT_CHARS}, 0)) AS before
  FROM checked WHERE ok),
found AS (
  SELECT doc_id, {counts}, string_agg(place, ',' ORDER BY ord, s) AS spans, string_agg(place, ',' ORDER BY ord, s) FILTER (ord < {len(BASE_KINDS)}) AS base,
    max(CASE kind {score} END + CASE WHEN CASE kind {near} END THEN {CONTEXT_SCORE} ELSE 0 END)::DOUBLE AS top_score FROM span GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(top_score, 0.0) AS top_score FROM docs LEFT JOIN found USING (doc_id)"""
