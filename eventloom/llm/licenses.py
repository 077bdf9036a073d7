"""License statements, built from SQL functions only.

Ordered signature rules are regular expressions over the words of a text. A rule
runs only where its two key words occur. Detections are intervals of words; one
that lies inside another of the same or a better priority is suppressed.

Texts are brought to words first: `` word  word `` with a space on either side
of each word, so that every pattern consumes its own borders. All repeated parts
of the rules have a fixed count: no recursion and no backtracking over the text.

Results by case: a null text counts as empty (no words, no labels, score 0); an
empty table gives no rows; repeated rows each give their own row; the output has
its own columns only, so other input columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import filled
from eventloom.llm.spans import let, running_sums

#: What separates words: ASCII apart from digits and letters. The ASCII letters A-Z are lower-cased later.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels (fixed values).
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: License families (fixed values): label, key word, names. In a name ``[w]`` is optional and ``a|b`` a choice.
FAMILIES = [
    ("mit", "mit", ["mit license", "mit expat license"]),
    ("apache-2", "apache", ["apache license [version|v] 2|v2 [0]", "apache 2 0 license"]),
    ("apache-1.1", "apache", ["apache [software] license [version] 1 1"]),
    ("cc-by-nc", "nc", ["cc by nc [4|3|2] [0|5]"]),
    ("cc-by-nc-sa", "nc", ["cc by nc sa [4|3|2] [0|5]"]),
    ("cc-by-nc-nd", "nc", ["cc by nc nd [4|3|2] [0|5]"]),
    ("cc-by", "by", ["cc by 4|3|2 [0|5]", "creative commons attribution [4|3] [0] [international] license"]),
    ("cc-by-sa", "sa", ["cc by sa [4|3|2] [0|5]"]),
    ("cc-by-nd", "nd", ["cc by nd [4|3|2] [0|5]"]),
    ("cc-by-sa", "sharealike", ["creative commons attribution sharealike [4|3] [0] [international] license"]),
    ("cc-by-nc", "noncommercial", ["creative commons attribution noncommercial [4|3] [0] [international] license"]),
    ("cc0-1.0", "cc0", ["cc0 [1] [0] [universal]"]),
    ("gpl-2.0", "general", ["gnu general public license [version|v] 2|v2"]),
    ("gpl-2.0", "gpl", ["gpl [version|v] 2|v2"]),
    ("gpl-3.0", "general", ["gnu general public license [version|v] 3|v3"]),
    ("gpl-3.0", "gpl", ["gpl [version|v] 3|v3"]),
    ("gpl-2.0-or-later", "later", ["gnu general public license [version|v] 2|v2 or [any] [at] [your] [option] later"]),
    ("gpl-3.0-or-later", "later", ["gnu general public license [version|v] 3|v3 or [any] [at] [your] [option] later"]),
    ("gpl-2.0", "gplv2", ["gplv2"]),
    ("gpl-3.0", "gplv3", ["gplv3"]),
    ("gpl", "general", ["gnu general public license"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license [version|v] 2|v2 1"]),
    ("lgpl-3.0", "lesser", ["gnu lesser general public license [version|v] 3|v3"]),
    ("lgpl", "lesser", ["gnu lesser general public license"]),
    ("lgpl-2.0", "library", ["gnu library general public license [version|v] 2|v2"]),
    ("agpl-3.0", "affero", ["gnu affero general public license [version|v] 3|v3", "gnu affero general public license"]),
    ("gfdl", "documentation", ["gnu free documentation license [version] [1]"]),
    ("mpl-2.0", "mozilla", ["mozilla public license [version|v] 2|v2 [0]"]),
    ("mpl-1.1", "mozilla", ["mozilla public license [version|v] 1|v1 1"]),
    ("epl-1.0", "eclipse", ["eclipse public license [version|v] 1|v1 [0]"]),
    ("epl-2.0", "eclipse", ["eclipse public license [version|v] 2|v2 [0]"]),
    ("bsd-2-clause", "bsd", ["bsd 2|two clause license", "2|two clause bsd license", "simplified bsd license"]),
    ("bsd-3-clause", "bsd", ["bsd 3|three clause license", "3|three clause bsd license", "new|revised|modified bsd license"]),
    ("bsd-4-clause", "bsd", ["bsd 4|four clause license", "4|four clause bsd license", "original bsd license"]),
    ("bsd", "bsd", ["bsd license", "bsd style license"]),
    ("isc", "isc", ["isc license"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"]),
    ("unlicense", "unlicense", ["the unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("cddl-1.0", "cddl", ["cddl [version|v] 1|v1 0"]),
    ("cddl-1.0", "distribution", ["common development and distribution license"]),
    ("boost-1.0", "boost", ["boost software license [version] [1] [0]"]),
    ("artistic-2.0", "artistic", ["artistic license [version] 2 [0]"]),
    ("artistic-1.0", "artistic", ["artistic license [version] 1 [0]"]),
    ("psf-2.0", "python", ["python software foundation license [version] [2]"]),
    ("ofl-1.1", "sil", ["sil open font license [version] [1] [1]"]),
    ("postgresql", "postgresql", ["postgresql license"]),
    ("openssl", "openssl", ["openssl license"]),
    ("ms-pl", "microsoft", ["microsoft public license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"]),
    ("eupl-1.2", "european", ["european union public licence [version|v] 1|v1 2", "european union public license [version|v] 1|v1 2"]),
    ("eupl-1.1", "european", ["european union public licence [version|v] 1|v1 1", "european union public license [version|v] 1|v1 1"]),
    ("odbl-1.0", "database", ["open database license"]),
    ("odc-by-1.0", "commons", ["open data commons attribution license"]),
    ("afl-3.0", "academic", ["academic free license [version|v] [3]"]),
    ("osl-3.0", "open", ["open software license [version|v] 3|v3"]),
    ("zpl-2.1", "zope", ["zope public license [version] [2] [1]"]),
    ("php-3.01", "php", ["php license [version] [3] [01]"]),
    ("ruby", "ruby", ["ruby license"]),
    ("vim", "vim", ["vim license"]),
    ("w3c", "w3c", ["w3c software [notice] [and] license"]),
    ("x11", "x11", ["x11 license"]),
    ("ncsa", "illinois", ["university of illinois ncsa open source license"]),
    ("cpl-1.0", "common", ["common public license [version] [1] [0]"]),
    ("ipl-1.0", "ibm", ["ibm public license [version] [1] [0]"]),
    ("apsl-2.0", "apple", ["apple public source license [version] [2]"]),
    ("upl-1.0", "universal", ["universal permissive license [version] [1] [0]"]),
    ("busl-1.1", "business", ["business source license [version] [1] [1]"]),
    ("sspl-1.0", "server", ["server side public license [version] [1]"]),
    ("elastic-2.0", "elastic", ["elastic license [version|v] 2|v2 [0]"]),
    ("llama", "community", ["community license agreement"]),
    ("bloom-rail", "responsible", ["responsible ai license"]),
]
#: Statement forms (fixed values): priority, words before the name. Lower is better; base phrases have priority 0.
FORMS = [
    (1, "licensed|released|distributed|published under [the] [terms] [of] [the]"),
    (1, "subject to the terms of the"),
    (2, ""),
]
#: Statements without a family (fixed values): label, key word, phrase. Priority 3.
HINTS = [
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("public-domain", "domain", "in the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("spdx", "spdx", "spdx license identifier"),
    ("unstated", "license", "see license file"),
    ("unstated", "license", "terms of the license"),
]
#: Document gate words (fixed values): every rule's pattern holds one of them.
GATES = ["license", "licence", "apache", "cc", "cc0", "gpl", "gplv2", "gplv3", "unlicense", "wtfpl", "cddl", "reserved", "domain", "proprietary", "gnu"]
CONFIDENCE = [1.0, 0.95, 0.85, 0.6]


def pattern(phrase: str) -> str:
    """A phrase as a regular expression over spaced words."""

    def one(word: str) -> str:
        optional = word.startswith("[")
        choices = word.strip("[]").split("|")
        body = " " + ("(?:" + "|".join(map(re.escape, choices)) + ")" if len(choices) > 1 else re.escape(choices[0])) + " "
        return f"(?:{body})?" if optional else body

    return "".join(one(word) for word in phrase.split())


def _gate(phrase: str) -> str:
    words = [w for part in phrase.split() if not part.startswith("[") for w in [part] if "|" not in part]
    return next(g for g in GATES if g in words)


def rules() -> list[tuple[int, str, str, str, str]]:
    """All rules in order: priority, gate word, key word, label, pattern."""
    found = [(0, _gate(phrase), "license" if "license" in phrase else "cc", label, pattern(phrase)) for label, phrase in BASE]
    for priority, form in FORMS:
        for label, key, names in FAMILIES:
            for name in names:
                found.append((priority, _gate(name), key, label, pattern(f"{form} {name}")))
    for label, key, phrase in HINTS:
        found.append((3, _gate(phrase), key, label, pattern(phrase)))
    return found


def spaced(text: Column) -> Column:
    """Words with a space on either side of each; two spaces where there is no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, "  ")), F.lit(" "))


def _word_count(part: Column) -> Column:
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(words: Column, regex: Column) -> Column:
    """Matches of a rule as intervals of words, both ends included."""
    found = F.regexp_extract_all(words, regex, F.lit(0))
    pairs = F.zip_with(
        found,
        F.slice(F.split(words, regex, -1), F.lit(1), F.size(found)),
        lambda m, gap: F.struct(_word_count(gap).alias("skip"), _word_count(m).alias("n")),
    )

    def placed(held: Column) -> Column:
        ends = running_sums(F.transform(held, lambda p: p["skip"] + p["n"]))
        return F.zip_with(held, ends, lambda p, e: F.struct((e - p["n"]).alias("start"), (e - 1).alias("last")))

    return let(pairs, placed)


_FOUND = "array<struct<start:int,before:int,priority:int,label:string>>"


def detect(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words`` and ``detections``: array of (start, before, priority, label) in order.

    ``before`` is the negated last word, so that of two detections with one start the longer comes first.
    """
    table = F.array(
        *[
            F.struct(F.lit(p).alias("priority"), F.lit(f" {g} ").alias("gate"), F.lit(f" {k} ").alias("word"), F.lit(label).alias("label"), F.lit(rx).alias("regex"))
            for p, g, k, label, rx in rules()
        ]
    )
    plain = F.col("_plain")
    lowered = F.col("_words")

    def of(rule: Column) -> Column:
        return F.transform(
            _places(lowered, rule["regex"]),
            lambda s: F.struct(s["start"].alias("start"), (-s["last"]).alias("before"), rule["priority"].alias("priority"), rule["label"].alias("label")),
        )

    tried = F.filter(table, lambda r: lowered.contains(r["gate"]) & lowered.contains(r["word"]))
    gate = plain.rlike(f"(?i) (?:{'|'.join(GATES)}) ")
    words = df.select(F.col(key), spaced(filled(text)).alias("_plain"))
    gated = words.select(
        key,
        F.when(plain != "  ", _word_count(plain)).otherwise(0).cast("long").alias("n_words"),
        F.when(gate, F.translate(plain, UPPER, LOWER)).alias("_words"),
    )
    found = F.when(lowered.isNotNull(), F.array_sort(F.flatten(F.transform(tried, of)))).otherwise(F.array().cast(_FOUND))
    return gated.select(key, "n_words", found.alias("detections"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base places, base labels, all labels that survive suppression, and a score, one row per document."""
    every = F.col("detections")
    base = F.filter(every, lambda d: d["priority"] == 0)
    nothing = F.struct(*[F.lit(-1).alias(f"last{p}") for p in range(4)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        # Earlier detections start no later: d lies inside one of them if that one ends no earlier.
        last = -d["before"]
        inside = F.lit(False)
        for p in range(4):
            inside = inside | ((d["priority"] >= p) & (acc[f"last{p}"] >= last))
        kept = (d["priority"] == 0) | ~inside
        sure = F.element_at(F.array(*map(F.lit, CONFIDENCE)), d["priority"] + 1)
        return F.struct(
            *[F.when(d["priority"] == p, F.greatest(acc[f"last{p}"], last)).otherwise(acc[f"last{p}"]).alias(f"last{p}") for p in range(4)],
            F.when(kept, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(kept, F.greatest(acc["score"], sure)).otherwise(acc["score"]).alias("score"),
        )

    return found.withColumn("_kept", F.aggregate(every, nothing, step)).select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.col("_kept.labels")), ",").alias("labels"),
        F.col("_kept.score").alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB SQL: positions by window sums, suppression by an anti join."""

    def quote(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    table = ", ".join("(" + ", ".join(map(quote, (i, *rule))) + ")" for i, rule in enumerate(rules()))
    words = "(len({0}) - len(replace({0}, ' ', ''))) // 2"
    return f"""
WITH spaced AS (
  SELECT doc_id, ' ' || trim(regexp_replace(coalesce(text, ''), '{SEPARATORS}', '  ', 'g')) || ' ' AS plain FROM documents
), docs AS (
  SELECT doc_id, translate(plain, '{UPPER}', '{LOWER}') AS words,
         CASE WHEN plain = '  ' THEN 0 ELSE {words.format('plain')} END AS n_words FROM spaced
), rule(id, priority, gate, word, label, regex) AS (VALUES {table}),
tried AS (
  SELECT d.doc_id, r.*, regexp_extract_all(d.words, r.regex) AS found, string_split_regex(d.words, r.regex) AS gaps
  FROM docs d JOIN rule r ON contains(d.words, ' ' || r.gate || ' ') AND contains(d.words, ' ' || r.word || ' ')
), each AS (
  SELECT doc_id, id, priority, label, unnest(range(1, len(found) + 1)) AS k, unnest(found) AS hit, unnest(gaps[:len(found)]) AS gap FROM tried
), sized AS (
  SELECT *, {words.format('hit')} AS n, {words.format('gap')} AS skip FROM each
), placed AS (
  SELECT doc_id, id, priority, label, sum(n + skip) OVER (PARTITION BY doc_id, id ORDER BY k) - n AS s, n FROM sized
), det AS (
  SELECT DISTINCT doc_id, priority, label, s, s + n - 1 AS e FROM placed
), kept AS (
  SELECT a.* FROM det a WHERE a.priority = 0 OR NOT EXISTS (
    SELECT 1 FROM det b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e AND b.priority <= a.priority
      AND (b.s < a.s OR b.e > a.e OR b.priority < a.priority OR b.label < a.label))
), label AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CASE priority WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.6 END)::DOUBLE AS score FROM kept GROUP BY doc_id
), base AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM placed WHERE priority = 0 GROUP BY doc_id
)
SELECT d.doc_id, d.n_words::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
       b.last_word::BIGINT AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0.0) AS score
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN label l USING (doc_id)"""
