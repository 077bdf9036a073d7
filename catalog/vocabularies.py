"""Vocabularies, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import byte_pairs
from catalog.byte_pairs import checked
from catalog.events import ME
from catalog.fixtures import with_views
from catalog.registry import joined, query
from catalog.sequences import TOKEN_ORDER, TOKENS, standard_tokens
from eventloom.operators.bpe import (
    END_OF_WORD,
    BytePairTokens,
    TextBpe,
    WhitespaceBpe,
    char_split,
    merges_table,
    text_eval,
    vocab_counts,
    vocab_table,
)
from eventloom.operators.pair_index import neighbour_pairs
from eventloom.operators.tokens import SPECIAL_TOKENS, Markers
from eventloom.operators.word_vocab import WordLevel, token_counts, vocabulary, with_strings
from eventloom.plans.text_vocab import counted_words, vocab_experiments
from eventloom.sources.events import in_splits, text_column

VOCAB_SIZE = 120
TEXT = "text_sequence_with_time"

VOCAB = {
    **TOKENS,
    "counts": "SELECT token AS str, count(*) AS c FROM toks WHERE split = 'train' GROUP BY token",
    "ranked": f"""SELECT CAST(row_number() OVER (ORDER BY c DESC, str) + 2 AS INTEGER) AS token, str, c AS count FROM counts
      QUALIFY row_number() OVER (ORDER BY c DESC, str) <= {VOCAB_SIZE - 3}""",
    "vocab": """SELECT 0 AS token, '<unknown>' AS str, (SELECT sum(c) FROM counts) - (SELECT sum(count) FROM ranked) AS count
      UNION ALL SELECT 1, '<start>', 0 UNION ALL SELECT 2, '<end>', 0 UNION ALL SELECT token, str, count FROM ranked""",
}


def train_tokens(rows):
    return rows.with_df(rows.df.where("split = 'train'"))


def trained(f):
    rows = standard_tokens(f)
    return WordLevel(VOCAB_SIZE).train(train_tokens(rows)), rows


@query(
    "agg_token_counts",
    with_views("SELECT token, count(*) AS count FROM toks GROUP BY token", ME, **TOKENS),
)
def agg_token_counts(f):
    return token_counts(standard_tokens(f).df)


@query(
    "word_vocab_train",
    with_views("SELECT token, str, CAST(count AS BIGINT) AS count FROM vocab", ME, **VOCAB),
)
def word_vocab_train(f):
    return trained(f)[0].vocab


@query(
    "word_vocab_unknown_count",
    with_views("SELECT str, CAST(count AS BIGINT) AS count FROM vocab WHERE token < 3", ME, **VOCAB),
)
def word_vocab_unknown_count(f):
    rows = train_tokens(standard_tokens(f))
    return vocabulary(token_counts(rows.df), VOCAB_SIZE).where("token < 3").select("str", "count")


ENCODED_SQL = f"""SELECT s.subject_id, any_value(s.split) AS split,
  '1|' || coalesce(string_agg(CAST(coalesce(v.token, 0) AS VARCHAR), '|' ORDER BY {TOKEN_ORDER}) || '|', '') || '2' AS tokens,
  '0|' || coalesce(string_agg(CAST(coalesce(t, 0) AS VARCHAR), '|' ORDER BY {TOKEN_ORDER}) || '|', '') ||
    CAST(coalesce(any_value(last_t), 0) AS VARCHAR) AS timestamps
FROM (SELECT subject_id, any_value(split) AS split, max(t) AS last_t FROM ev GROUP BY subject_id) s
JOIN toks USING (subject_id) LEFT JOIN vocab v ON toks.token = v.str GROUP BY s.subject_id"""


def shown_timelines(timelines):
    times = F.transform("timestamps", lambda t: F.round(t * 1e6).cast("bigint").cast("string"))
    return timelines.select(
        "subject_id", "split", joined("tokens"), F.array_join(times, "|").alias("timestamps")
    )


@query("word_encode", with_views(ENCODED_SQL, ME, **VOCAB))
def word_encode(f):
    tokenizer, rows = trained(f)
    return shown_timelines(tokenizer.encode(rows))


@query(
    "word_decode",
    with_views(
        f"""SELECT subject_id, '<start> ' || string_agg(coalesce(v.str, '<unknown>'), ' ' ORDER BY {TOKEN_ORDER}) || ' <end>' AS text
FROM toks LEFT JOIN vocab v ON toks.token = v.str GROUP BY subject_id""",
        ME,
        **VOCAB,
    ),
)
def word_decode(f):
    tokenizer, rows = trained(f)
    return tokenizer.decode(tokenizer.encode(rows)).select("subject_id", "text")


# ---- byte pairs over event strings


@query("bpe_word_freq", with_views("SELECT token, count(*) AS count FROM toks GROUP BY token", ME, **TOKENS))
def bpe_word_freq(f):
    return token_counts(standard_tokens(f).df)


SPLIT_SQL = r"""list_transform(range(1, len(token) + 1), lambda i: token[i] || CASE WHEN i = len(token) THEN '</w>' ELSE '' END)"""


@query(
    "bpe_char_split",
    with_views(
        f"SELECT token, array_to_string({SPLIT_SQL}, '|') AS pieces FROM (SELECT DISTINCT token FROM toks)", ME, **TOKENS
    ),
)
def bpe_char_split(f):
    words = standard_tokens(f).df.where("token is not null").select("token").distinct()
    return words.select("token", F.array_join(char_split(F.col("token")), "|").alias("pieces"))


@query(
    "bpe_pair_count",
    with_views(
        """SELECT pair, CAST(sum(freq) AS BIGINT) AS weight FROM (
  SELECT unnest(list_distinct(list_transform(range(1, len(token)), lambda i: token[i:i+1]))) AS pair, freq
  FROM (SELECT token, count(*) AS freq FROM toks GROUP BY token)) GROUP BY pair""",
        ME,
        **TOKENS,
    ),
)
def bpe_pair_count(f):
    words = token_counts(standard_tokens(f).df)
    pairs = F.array_distinct(neighbour_pairs(F.col("token")))
    return words.select(F.explode(pairs).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("weight"))


def trained_bpe(f, vocab_size: int = 110):
    rows = standard_tokens(f)
    return BytePairTokens(vocab_size).train(train_tokens(rows)), rows


# Words of all strings; those that train nothing have weight 0.
EVENT_BPE = {
    **TOKENS,
    "all_words": "SELECT token AS word, count(*) FILTER (split = 'train') AS freq FROM toks GROUP BY token",
    **byte_pairs.learning("all_words", SPECIAL_TOKENS, 110, suffix=END_OF_WORD, once=True, reuse=False),
}
EVENT_BPE_TIMELINES = {**EVENT_BPE, "spelled": "SELECT toks.*, ids FROM toks JOIN bp_words ON toks.token = bp_words.word"}
VOCAB_ROWS = "SELECT token, str, CAST(0 AS BIGINT) AS count FROM bp_vocab"


@query("bpe_train", checked(VOCAB_ROWS, ME, **EVENT_BPE))
def bpe_train(f):
    tokenizer, _ = trained_bpe(f)
    return vocab_table(f.spark, tokenizer.model)


@query("bpe_merges", checked("SELECT * FROM bp_merges", ME, **EVENT_BPE))
def bpe_merges(f):
    tokenizer, _ = trained_bpe(f)
    return merges_table(f.spark, tokenizer.model)


@query("bpe_encode", checked(byte_pairs.timelines("spelled", TOKEN_ORDER), ME, **EVENT_BPE_TIMELINES))
def bpe_encode(f):
    tokenizer, rows = trained_bpe(f)
    return shown_timelines(tokenizer.encode(rows))


@query(
    "bpe_decode",
    with_views(
        f"""SELECT subject_id, '<start>' || string_agg(token, ' ' ORDER BY {TOKEN_ORDER}) || ' <end>' AS text
FROM toks GROUP BY subject_id""",
        ME,
        **TOKENS,
    ),
)
def bpe_decode(f):
    rows = standard_tokens(f)
    tokenizer = BytePairTokens(110).train(rows)
    return tokenizer.decode(tokenizer.encode(rows)).select("subject_id", "text")


# ---- byte pairs over text


def whitespace_bpe(f):
    rows = standard_tokens(f)
    return WhitespaceBpe(120).train(train_tokens(rows)), rows


WORDS = r"regexp_extract_all({0}, '\w+|[^\w\s]+')"
SPACE_SPECIALS = [*SPECIAL_TOKENS, *Markers().tokens()]
SPACE_BPE = {
    **TOKENS,
    "used": f"""SELECT unnest({WORDS.format('token')}) AS word, CAST(split = 'train' AS INTEGER) AS n FROM toks
      UNION ALL SELECT unnest({WORDS.format('edge')}), CAST(split = 'train' AS INTEGER)
      FROM (SELECT DISTINCT subject_id, split FROM ev), (VALUES ('<start>'), ('<end>')) AS edges(edge)""",
    "all_words": "SELECT word, sum(n) AS freq FROM used GROUP BY word",
    **byte_pairs.learning("all_words", SPACE_SPECIALS, 120),
}


@query("text_bpe_whitespace_train", checked(VOCAB_ROWS, ME, **SPACE_BPE))
def text_bpe_whitespace_train(f):
    return vocab_table(f.spark, whitespace_bpe(f)[0].model)


@query(
    "text_bpe_whitespace_encode",
    checked(
        byte_pairs.timelines("spelled", f"{TOKEN_ORDER}, place"),
        ME,
        **SPACE_BPE,
        pieces=f"SELECT *, unnest({WORDS.format('token')}) AS word, unnest(range(len({WORDS.format('token')}))) AS place FROM toks",
        spelled="SELECT pieces.*, ids FROM pieces JOIN bp_words USING (word)",
    ),
)
def text_bpe_whitespace_encode(f):
    tokenizer, rows = whitespace_bpe(f)
    return shown_timelines(tokenizer.encode(rows))


def texts(f, split: str | None = None):
    rows = text_column(f.view("text_rows"), TEXT, "subject_id", "split")
    return rows if split is None else in_splits(rows, [split])


def text_bpe(f, vocab_size: int = 150) -> TextBpe:
    return TextBpe(vocab_size, min_frequency=2).train_texts(F.col(TEXT), texts(f, "train"))


TEXT_BPE = byte_pairs.text_learning(f"SELECT * FROM text_rows WHERE {TEXT} <> ''", TEXT, 150)
SPELLED = byte_pairs.SPELLED
EVAL_SQL = f"""SELECT CAST({{size}} AS BIGINT) AS vocab_size, round(total / n, 2) AS avg_seq_length, round(chars / total, 2) AS compression_ratio, total AS total_tokens_in_test
FROM (SELECT CAST(sum(len(ids)) AS BIGINT) AS total FROM spelled WHERE split = 'test'), (SELECT count(*) AS n, sum(len({TEXT})) AS chars FROM chosen WHERE split = 'test')"""


@query("text_bpe_bytelevel_train", checked(VOCAB_ROWS, "text_rows", **TEXT_BPE))
def text_bpe_bytelevel_train(f):
    return vocab_table(f.spark, text_bpe(f).model)


@query("text_bpe_eval", checked(EVAL_SQL.format(size=150), "text_rows", **TEXT_BPE, **SPELLED))
def text_bpe_eval(f):
    tokenizer = text_bpe(f)
    return text_eval(counted_words(tokenizer, texts(f, "test"), TEXT), tokenizer.model, [tokenizer.vocab_size])


@query(
    "text_bpe_vocab_counts",
    checked(
        """SELECT v.token, v.str, coalesce(c.n, 0) AS count FROM bp_vocab v
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM spelled WHERE split = 'test') GROUP BY id) c ON c.id = v.token""",
        "text_rows",
        **TEXT_BPE,
        **SPELLED,
    ),
)
def text_bpe_vocab_counts(f):
    tokenizer = text_bpe(f)
    return vocab_counts(counted_words(tokenizer, texts(f, "test"), TEXT), tokenizer)


@query(
    "vocab_sweep",
    checked(
        f"""SELECT CAST(size AS BIGINT) AS vocab_size, round(total / n, 2) AS avg_seq_length, round(chars / total, 2) AS compression_ratio,
CAST(total AS BIGINT) AS total_tokens_in_test
FROM (SELECT size, sum(len(form)) AS total FROM reached JOIN bp_run USING (n) JOIN shown_runs USING (word) JOIN runs USING (run) WHERE split = 'test' GROUP BY size),
  (SELECT count(*) AS n, sum(len({TEXT})) AS chars FROM chosen WHERE split = 'test')""",
        "text_rows",
        **TEXT_BPE,
        reached="""SELECT size, min(n) AS n FROM bp_run, (VALUES (120), (135), (150)) AS sizes(size)
          WHERE word IS NULL AND len(syms) >= size GROUP BY size""",
    ),
)
def vocab_sweep(f):
    return vocab_experiments(texts(f, "train"), texts(f, "test"), TEXT, [120, 135, 150])


@query(
    "text_encode",
    checked(
        byte_pairs.POSITIONED,
        "text_rows",
        **TEXT_BPE,
        **SPELLED,
    ),
)
def text_encode(f):
    from eventloom.plans.text_vocab import encode_texts

    timelines = encode_texts(text_bpe(f), texts(f), TEXT)
    return timelines.select("subject_id", "split", joined("tokens"), joined("timestamps"))


@query(
    "text_round_trip",
    with_views(f"SELECT subject_id, {TEXT} AS text FROM text_rows WHERE {TEXT} <> ''", "text_rows"),
)
def text_round_trip(f):
    """Decoding the ids of every text gives the text back."""
    tokenizer = TextBpe(150, min_frequency=2).train_texts(F.col(TEXT), texts(f))
    encoded = tokenizer.encode_texts(texts(f), TEXT).select("subject_id", "tokens")
    return tokenizer.decode(encoded)


@query(
    "positional_timestamps",
    with_views(
        f"SELECT subject_id, array_to_string(range(len(string_split({TEXT}, ' '))), '|') AS timestamps FROM text_rows WHERE {TEXT} <> ''",
        "text_rows",
    ),
)
def positional_timestamps(f):
    from eventloom.plans.text_vocab import positional

    words = texts(f).withColumn("tokens", F.split(TEXT, " "))
    return words.select("subject_id", positional(F.col("tokens")).alias("timestamps")).select(
        "subject_id", joined("timestamps")
    )


@query(
    "decode_preview",
    checked(
        f"""SELECT subject_id, string_agg(array_to_string(ids, '|'), '|' ORDER BY k) AS ids,
string_agg(array_to_string(list_transform(ids, lambda i: strs[i + 1]), '|'), '|' ORDER BY k) AS pieces, any_value({TEXT}) AS text
FROM spelled JOIN chosen USING (subject_id), (SELECT list(str ORDER BY token) AS strs FROM bp_vocab) GROUP BY subject_id""",
        "text_rows",
        **TEXT_BPE,
        **SPELLED,
    ),
)
def decode_preview(f, length: int | None = None):
    """The ids of every text (its first ``length`` where given) with their pieces."""
    tokenizer = text_bpe(f)
    kept = F.col("tokens") if length is None else F.slice("tokens", 1, length)
    encoded = tokenizer.encode_texts(texts(f), TEXT).select("subject_id", kept.alias("tokens"))
    named = with_strings(encoded, vocab_table(f.spark, tokenizer.model).drop("count"), "|")
    # A filter before the lookup would be pushed down with the encoding inside, and texts encoded twice.
    shown = named.where(F.size("tokens") > 0)
    pieces = shown.select("subject_id", "tokens", joined("tokens").alias("ids"), F.col("strings").alias("pieces"))
    return tokenizer.decode(pieces)
