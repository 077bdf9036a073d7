"""Byte-pair learning and encoding as DuckDB statements, to check the registered queries with.

A recursive statement holds every distinct word with one character per symbol. A
round takes the pair of the greatest weight (ties: the lower symbols) and replaces it
everywhere; words that train nothing have weight 0 and are merged along, so the last
round is also their encoding. One row without a word carries the symbols' strings.
"""

from __future__ import annotations

from catalog.fixtures import with_views
from eventloom.operators.bpe import byte_characters

SYMBOL_BASE = 0x100


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def learning(words: str, specials: list[str], vocab_size: int, suffix: str = "", once: bool = False, min_weight: int = 1, reuse: bool = True) -> dict[str, str]:
    """CTEs from ``words`` (word, freq) to ``bp_vocab`` (token, str), ``bp_merges`` and ``bp_words`` (word, ids)."""
    n = len(specials)
    last = f" || CASE WHEN i = len(word) THEN {quoted(suffix)} ELSE '' END" if suffix else ""
    pieces = f"list_transform(range(1, len(word) + 1), lambda i: word[i]{last})"
    pairs = "list_transform(range(1, len(form)), lambda i: form[i:i+1])"
    pairs = f"list_distinct({pairs})" if once else pairs
    grown = "len(state.syms)" if reuse else f"(SELECT count(*) FROM bp_first) + {n} + state.n"
    return {
        "bp_split": f"SELECT word, freq, {pieces} AS pieces FROM {words} WHERE word <> ''",
        "bp_first": f"""SELECT piece, row_number() OVER (ORDER BY piece) - 1 + {n} AS id
          FROM (SELECT DISTINCT unnest(pieces) AS piece FROM bp_split WHERE freq > 0)""",
        "bp_start": f"""SELECT word, any_value(freq) AS freq, string_agg(chr(CAST({SYMBOL_BASE} + coalesce(id, 0) AS INTEGER)), '' ORDER BY k) AS form
          FROM (SELECT word, freq, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM bp_split) LEFT JOIN bp_first USING (piece) GROUP BY word""",
        "bp_run": f"""SELECT 0 AS n, word, freq, form, NULL::VARCHAR[] AS syms, NULL::VARCHAR AS l, NULL::VARCHAR AS r FROM bp_start
          UNION ALL SELECT 0, NULL, 0, '', list_concat({sql_list(specials)}, (SELECT list(piece ORDER BY id) FROM bp_first)), NULL, NULL
          UNION ALL (
            WITH state AS (SELECT n, syms FROM bp_run WHERE word IS NULL),
            best AS (
              SELECT pair, sum(freq) AS w FROM (SELECT unnest({pairs}) AS pair, freq FROM bp_run WHERE freq > 0)
              GROUP BY pair HAVING sum(freq) >= {min_weight} ORDER BY w DESC, pair LIMIT 1),
            named AS (
              SELECT pair, syms, syms[unicode(pair[1]) - {SYMBOL_BASE - 1}] AS l, syms[unicode(pair[2]) - {SYMBOL_BASE - 1}] AS r
              FROM best, state WHERE {grown} < {vocab_size}),
            placed AS (
              SELECT pair, l, r, coalesce(list_position(syms, l || r), len(syms) + 1) AS at, syms FROM named)
            SELECT b.n + 1, b.word, b.freq, replace(b.form, p.pair, chr(CAST({SYMBOL_BASE - 1} + p.at AS INTEGER))),
              CASE WHEN b.word IS NULL THEN CASE WHEN p.at > len(p.syms) THEN list_append(p.syms, p.l || p.r) ELSE p.syms END END,
              CASE WHEN b.word IS NULL THEN p.l END, CASE WHEN b.word IS NULL THEN p.r END
            FROM bp_run b, placed p)""",
        "bp_merges": "SELECT CAST(n - 1 AS INTEGER) AS rank, l AS \"left\", r AS \"right\", l || r AS merged FROM bp_run WHERE l IS NOT NULL",
        "bp_last": "SELECT syms FROM bp_run WHERE word IS NULL ORDER BY n DESC LIMIT 1",
        "bp_vocab": "SELECT CAST(unnest(range(len(syms))) AS INTEGER) AS token, unnest(syms) AS str FROM bp_last"
        if reuse
        else f"""SELECT CAST(max(id) AS INTEGER) AS token, str FROM (
            SELECT unnest(range({n})) AS id, unnest({sql_list(specials)}) AS str UNION ALL SELECT id, piece FROM bp_first
            UNION ALL SELECT rank + {n} + (SELECT count(*) FROM bp_first), merged FROM bp_merges) GROUP BY str""",
        "bp_numbers": """SELECT list(token ORDER BY k) AS ids FROM (SELECT unnest(syms) AS str, unnest(range(len(syms))) AS k FROM bp_last) JOIN bp_vocab USING (str)""",
        "bp_words": f"""SELECT word, list_transform(range(1, len(form) + 1), lambda i: ids[unicode(form[i]) - {SYMBOL_BASE - 1}]) AS ids
          FROM bp_run, bp_numbers WHERE word IS NOT NULL AND n = (SELECT max(n) FROM bp_run)""",
    }


def checked(statement: str, *views: str, **ctes: str) -> str:
    """A statement over fixture views whose CTEs may be recursive."""
    return with_views(statement, *views, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


SPELLED = {"spelled": "SELECT runs.*, ids FROM runs JOIN shown_runs USING (run) JOIN bp_words USING (word)"}
POSITIONED = """SELECT subject_id, any_value(split) AS split, string_agg(array_to_string(ids, '|'), '|' ORDER BY k) AS tokens,
array_to_string(range(CAST(sum(len(ids)) AS BIGINT)), '|') AS timestamps FROM spelled GROUP BY subject_id"""


def text_learning(chosen: str, text: str, size: int, others: dict[str, str] | None = None) -> dict[str, str]:
    """CTEs of a byte-level vocabulary of the training texts of ``chosen``; ``others`` are CTEs of runs that train nothing."""
    more = "".join(f" UNION ALL SELECT run, 0 FROM {name}" for name in others or {})
    return {
        "chosen": chosen,
        "runs": f"SELECT subject_id, split, unnest(range(len(ws))) AS k, unnest(ws) AS run FROM (SELECT *, {byte_level(text)} AS ws FROM chosen)",
        **(others or {}),
        "shown_runs": f"""SELECT run, {shown_bytes('run')} AS word, sum(n) AS freq
          FROM (SELECT run, CAST(split = 'train' AS INTEGER) AS n FROM runs{more}) GROUP BY run""",
        "all_words": "SELECT word, freq FROM shown_runs",
        **learning("all_words", ["<unk>", "<bos>", "<eos>"], size, min_weight=2),
    }


def timelines(tokens: str, order: str) -> str:
    """Timelines of ``tokens`` (subject_id, split, t, ids and order columns) of all subjects of ``ev``."""
    return f"""SELECT s.subject_id, any_value(s.split) AS split,
  '1|' || coalesce(string_agg(array_to_string(ids, '|'), '|' ORDER BY {order}) FILTER (len(ids) > 0) || '|', '') || '2' AS tokens,
  '0|' || coalesce(string_agg(array_to_string(list_transform(ids, lambda x: coalesce(t, 0)), '|'), '|' ORDER BY {order}) FILTER (len(ids) > 0) || '|', '') ||
    CAST(coalesce(any_value(last_t), 0) AS VARCHAR) AS timestamps
FROM (SELECT subject_id, any_value(split) AS split, max(t) AS last_t FROM ev GROUP BY subject_id) s
JOIN {tokens} USING (subject_id) GROUP BY s.subject_id"""


def byte_level(text: str) -> str:
    """Byte-level words of an expression, a list. Holds for texts whose white space is blanks and line ends."""
    segments = rf"regexp_extract_all({text}, '\p{{N}}|[^\p{{N}}]+')"
    # A run of white space before a word gives its last character to the word.
    parts = rf"flatten(list_transform({segments}, lambda s: string_split(regexp_replace(s, '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1))))"
    runs = r"""'''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'"""
    return f"flatten(list_transform({parts}, lambda s: regexp_extract_all(s, {runs})))"


def shown_bytes(word: str) -> str:
    """A word with the printable character of each of its UTF-8 bytes."""
    table = sql_list(byte_characters())
    return f"""array_to_string(list_transform(range(len(hex({word})) // 2), lambda i: {table}[CAST('0x' || hex({word})[2*i+1:2*i+2] AS INTEGER) + 1]), '')"""
