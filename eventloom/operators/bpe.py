"""Byte-pair vocabularies over event strings and over text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.pieces import (
    Merges,
    encode_column,
    encode_list_column,
    event_encoder,
    learn,
    lengths_at,
    merge_ranks,
    special_aware_encoder,
    symbol,
    text_encoder,
    words_encoder,
)
from eventloom.operators.tokens import SPECIAL_TOKENS, Markers, assemble
from eventloom.operators.word_vocab import spoken, token_counts
from eventloom.ordering import Ordered
from eventloom.session import materialize

END_OF_WORD = "</w>"


def characters(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)(.)"), F.lit(1))


def char_split(word: Column, suffix: str = END_OF_WORD) -> Column:
    """Characters of a word, the last with the end-of-word suffix."""
    letters = characters(word)
    last = F.size(letters) - 1
    return F.transform(letters, lambda c, i: F.when(i == last, F.concat(c, F.lit(suffix))).otherwise(c))


def first_strings(words: DataFrame, pieces: Column) -> list[str]:
    """Distinct starting pieces, sorted. Bounded by the alphabet, not by the data."""
    found = words.select(F.explode(pieces).alias("piece")).distinct().orderBy("piece")
    return [r["piece"] for r in found.collect()]


def in_symbols(text: Column, pieces: list[str], first: int, suffix: str = "") -> Column:
    """Replace each character by its symbol; ``pieces[i]`` without suffix is symbol ``first + i``."""
    pairs = [(p[: len(p) - len(suffix)], symbol(first + i)) for i, p in enumerate(pieces)]
    pairs = [(c, s) for c, s in pairs if len(c) == 1]
    return F.translate(text, "".join(c for c, _ in pairs), "".join(s for _, s in pairs))


def vocab_table(spark: SparkSession, model: Merges) -> DataFrame:
    rows = [(i, s, 0) for i, s in model.vocab_rows()]
    return spark.createDataFrame(rows, "token int, str string, count bigint")


def merges_table(spark: SparkSession, model: Merges) -> DataFrame:
    rows = [(rank, *merge) for rank, merge in enumerate(model.merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string, merged string")


class BytePairTokens:
    """Merges learned inside event strings; a pair counts once per word.

    Ties between pairs go to the earlier symbols (characters in sorted order,
    then merged strings as they were made).
    """

    def __init__(self, vocab_size: int = 1000, end_of_word_suffix: str = END_OF_WORD):
        self.vocab_size = vocab_size
        self.suffix = end_of_word_suffix
        self.model: Merges | None = None

    def train(self, rows: Ordered) -> "BytePairTokens":
        return self.train_words(token_counts(rows.df))

    def train_words(self, counts: DataFrame) -> "BytePairTokens":
        """Learn from (``token``, ``count``) of distinct words."""
        words = materialize(counts.where(F.col("token") != ""), "bpe-word-counts")
        pieces = first_strings(words, char_split(F.col("token"), self.suffix))
        first = len(SPECIAL_TOKENS)
        # A piece's symbol depends on whether it carries the suffix.
        inner = [p for p in pieces if len(p) == 1]
        numbers = {p: i for i, p in enumerate(pieces)}
        size = F.length("token")
        body = F.substring(F.col("token"), F.lit(1), size - 1)
        tail = F.substring(F.col("token"), size, F.lit(1))
        as_symbols = F.concat(
            F.translate(body, "".join(inner), "".join(symbol(first + numbers[p]) for p in inner)),
            in_symbols(tail, pieces, first, self.suffix),
        )
        prepared = words.select(as_symbols.alias("word"), F.col("count").alias("freq"))
        self.model = learn(prepared, pieces, SPECIAL_TOKENS, self.vocab_size, once_per_word=True)
        return self

    def encoder(self):
        whole = {s: i for i, s in enumerate(SPECIAL_TOKENS)}
        return partial(event_encoder, self.model, self.suffix, whole)

    def encode(self, rows: Ordered) -> DataFrame:
        """Timelines of piece ids; each piece has its word's time."""
        if self.model is None or not self.model.merges:
            raise ValueError("train before encoding")
        return assemble(rows, encode_column(self.encoder(), F.col("token")), *self.edge_ids(), "tokens")

    def token_ids(self, tokens: DataFrame) -> DataFrame:
        """Token rows with ``ids``, what each token becomes."""
        return tokens.withColumn("ids", encode_column(self.encoder(), F.col("token")))

    def edge_ids(self) -> tuple[int, int]:
        """Ids that open and close a timeline."""
        return SPECIAL_TOKENS.index("<start>"), SPECIAL_TOKENS.index("<end>")

    def decode(self, timelines: DataFrame) -> DataFrame:
        return decode_pieces(timelines, vocab_table(timelines.sparkSession, self.model), self.suffix)


def decode_pieces(timelines: DataFrame, vocab: DataFrame, suffix: str = END_OF_WORD) -> DataFrame:
    """Join the pieces of a timeline, looked up inside its array; the suffix becomes a blank. Unknown ids fail."""
    joined = spoken(timelines, vocab.select("token", "str"), "", strict=True).drop("tokens", "timestamps")
    return joined.withColumn("text", F.trim(F.replace("text", F.lit(suffix), F.lit(" "))))


# Fixed pattern: the contraction, word, number, symbol and blank runs of byte-level splitting.
BYTE_LEVEL_RUNS = (
    r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
)
DIGIT_OR_REST = r"(?s)(\p{N}|[^\p{N}]+)"
# The same words in one pass over a text: a digit ends the text around it.
DIGITS_AND_RUNS = (
    r"(?U)(\p{N}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?![^\s\p{N}])|\s+)"
)
WORD_OR_MARKS = r"(?U)(\w+|[^\w\s]+)"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def spelled_in_bytes(word: str) -> str:
    """One printable character per UTF-8 byte."""
    return word.encode().decode("latin-1").translate(_SHOWN_BYTES)


_SHOWN_BYTES = dict(enumerate(byte_characters()))
_BYTE_OF = {shown: byte for byte, shown in enumerate(byte_characters())}


def _as_bytes(text: Column) -> Column:
    """One printable character per UTF-8 byte."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(chr(b) for b in range(256)), "".join(byte_characters()))


def byte_level_words(text: Column) -> Column:
    """Digits one by one, then byte-level runs; words as printable byte characters."""
    segments = F.regexp_extract_all(text, F.lit(DIGIT_OR_REST), F.lit(1))
    runs = F.flatten(
        F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(BYTE_LEVEL_RUNS), F.lit(1)))
    )
    return F.transform(runs, _as_bytes)


def byte_level_runs(text: Column) -> Column:
    """The words of ``byte_level_words`` as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(DIGITS_AND_RUNS), F.lit(1))


def whitespace_words(text: Column) -> Column:
    """Runs of word characters and runs of other marks."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARKS), F.lit(1))


class _TextBytePairs:
    """Merges learned from text; every place a pair occurs counts."""

    split = staticmethod(byte_level_words)
    #: The same words as they stand in the text, and how one of them is spelled in pieces.
    runs = staticmethod(byte_level_runs)
    spell = staticmethod(_as_bytes)
    spell_word = staticmethod(spelled_in_bytes)

    def __init__(self, vocab_size: int, specials: list[str], unknown: str, min_frequency: int):
        self.vocab_size = vocab_size
        self.specials = specials
        self.unknown = unknown
        self.min_frequency = min_frequency
        self.model: Merges | None = None

    def train_texts(self, texts: Column, rows: DataFrame) -> "_TextBytePairs":
        words = rows.select(F.explode(type(self).runs(texts)).alias("token"))
        counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
        return self.train_words(counts.withColumn("token", type(self).spell(F.col("token"))))

    def train_words(self, counts: DataFrame) -> "_TextBytePairs":
        words = materialize(counts, "text-word-counts")
        pieces = first_strings(words, characters(F.col("token")))
        prepared = words.select(
            in_symbols(F.col("token"), pieces, len(self.specials)).alias("word"), F.col("count").alias("freq")
        )
        self.model = learn(
            prepared, pieces, self.specials, self.vocab_size,
            once_per_word=False, min_weight=max(self.min_frequency, 1), reuse_ids=True,
        )
        return self

    def encoder(self):
        return partial(text_encoder, self.model, self.unknown)

    def run_encoder(self):
        """Encoder of lists of words as they stand in the text."""
        return partial(words_encoder, self.model, self.unknown, type(self).spell_word)

    def encode_texts(self, rows: DataFrame, text: str, name: str = "tokens") -> DataFrame:
        """Add the ids of every text; narrow, one pass."""
        return rows.withColumn(name, encode_list_column(self.run_encoder(), type(self).runs(F.col(text))))


class TextBpe(_TextBytePairs):
    """Byte-level vocabulary of a text column."""

    def __init__(self, vocab_size: int = 4000, min_frequency: int = 2):
        super().__init__(vocab_size, ["<unk>", "<bos>", "<eos>"], "<unk>", min_frequency)

    def cut(self, vocab_size: int) -> "TextBpe":
        smaller = TextBpe(vocab_size, self.min_frequency)
        smaller.model = self.model.cut(vocab_size)
        return smaller

    @classmethod
    def load(cls, spark: SparkSession, folder: str, min_frequency: int = 2) -> "TextBpe":
        """A vocabulary from the ``vocab.csv`` and ``merges`` of its folder."""
        from eventloom.sources.events import read_vocab

        # As many rows as the vocabulary has entries.
        ids = {r["str"]: r["token"] for r in read_vocab(spark, f"{folder}/vocab.csv").collect()}
        rows = spark.read.parquet(f"{folder}/merges").orderBy("rank").collect()
        merges = [(r["left"], r["right"], r["merged"]) for r in rows]
        loaded = cls(len(ids), min_frequency)
        loaded.model = Merges(ids, merges, len(ids) - len({merged for _, _, merged in merges}))
        return loaded

    def decode(self, timelines: DataFrame) -> DataFrame:
        """Text of byte-level ids."""
        spark = timelines.sparkSession
        joined = spoken(timelines, vocab_table(spark, self.model).select("token", "str"), "", strict=True, as_bytes=bytes_of)
        # A cut-off sequence may end inside a character: bytes that are no text become U+FFFD.
        return joined.drop("tokens", "timestamps").withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))


def bytes_of(piece: str) -> bytes:
    """The bytes that a piece's printable characters stand for."""
    return b"".join(bytes([_BYTE_OF[c]]) if c in _BYTE_OF else c.encode("latin-1") for c in piece)


class WhitespaceBpe(_TextBytePairs):
    """Vocabulary of subject strings joined by blanks, split into words and marks."""

    split = staticmethod(whitespace_words)
    runs = staticmethod(whitespace_words)
    spell = staticmethod(lambda word: word)
    spell_word = None

    def __init__(
        self, vocab_size: int = 10_000, markers: Markers = Markers(), special_tokens: list[str] | None = None
    ):
        specials = list(dict.fromkeys([*(special_tokens or []), *SPECIAL_TOKENS, *markers.tokens()]))
        super().__init__(vocab_size, specials, "<unknown>", min_frequency=0)

    def train(self, rows: Ordered) -> "WhitespaceBpe":
        # Joining a subject's strings by blanks and splitting again is splitting each
        # string, so the words are counted from token rows. Every sequence also has a
        # start and an end.
        counted = rows.df.where("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        subjects = rows.df.select(*rows.keys).distinct().agg(F.count(F.lit(1)).alias("n"))
        edges = subjects.select(F.explode(F.array(F.lit("<start>"), F.lit("<end>"))).alias("token"), "n")
        words = counted.unionByName(edges).select(
            F.explode(whitespace_words(F.col("token"))).alias("token"), "n"
        )
        return self.train_words(words.groupBy("token").agg(F.sum("n").alias("count")))

    def encoder(self):
        return partial(special_aware_encoder, self.model, self.unknown, self.specials)

    def encode(self, rows: Ordered) -> DataFrame:
        """Timelines of piece ids; each piece has its string's time."""
        return assemble(rows, encode_column(self.encoder(), F.col("token")), *self.edge_ids(), "tokens")

    def token_ids(self, tokens: DataFrame) -> DataFrame:
        """Token rows with ``ids``, what each token becomes."""
        return tokens.withColumn("ids", encode_column(self.encoder(), F.col("token")))

    def edge_ids(self) -> tuple[int, int]:
        """Ids that open and close a timeline."""
        return self.model.ids["<start>"], self.model.ids["<end>"]


def text_words(
    rows: DataFrame, text: str, split: Callable[[Column], Column], spell: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Distinct words of a text column and how often they occur, from one scan.

    The row of the null word counts the texts and their characters. ``spell`` rewrites the distinct words.
    """
    none = F.lit(None).cast("string")
    words = F.explode(F.array_append(split(F.col(text)), none)).alias("word")
    each = rows.select(words, F.length(text).cast("long").alias("chars"))
    chars = F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("chars"))), F.lit(0))
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), chars.alias("chars"))
    return counted if spell is None else counted.withColumn("word", spell(F.col("word")))


def text_eval(words: DataFrame, model: Merges, sizes: list[int]) -> DataFrame:
    """Sequence length, characters per token and token total for every vocabulary size, from ``text_words``.

    Each distinct word is merged once, whatever the number of sizes.
    """
    ranks = merge_ranks(model.merges)
    cuts = [len(merge_ranks(model.cut(size).merges)) for size in sizes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, texts, chars = [0] * len(cuts), 0, 0
        for batch in batches:
            for word, n, c in zip(*[batch.column(name).to_pylist() for name in ("word", "n", "chars")]):
                if word is None:
                    texts, chars = texts + n, chars + c
                else:
                    tokens = [t + n * length for t, length in zip(tokens, lengths_at(word, ranks, cuts))]
        row = {"place": list(range(len(cuts))), "tokens": tokens, "texts": [texts] * len(cuts), "chars": [chars] * len(cuts)}
        yield pa.RecordBatch.from_pydict(row)

    sums = words.mapInArrow(count, "place long, tokens long, texts long, chars long").groupBy("place").agg(
        F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"), F.sum("chars").alias("chars")
    )
    asked = words.sparkSession.createDataFrame(list(enumerate(sizes)), "place long, vocab_size long").join(sums, "place", "left")
    total, n = F.coalesce("tokens", F.lit(0)), F.coalesce("texts", F.lit(0))
    return asked.select(
        "vocab_size",
        F.when(n > 0, F.round(total / n, 2)).otherwise(0.0).alias("avg_seq_length"),
        F.when(total > 0, F.round(F.coalesce("chars", F.lit(0)) / total, 2)).otherwise(0.0).alias("compression_ratio"),
        total.alias("total_tokens_in_test"),
    )


def vocab_counts(words: DataFrame, tokenizer: "_TextBytePairs") -> DataFrame:
    """Occurrences of every vocabulary id in the texts that ``text_words`` counted."""
    vocab = vocab_table(words.sparkSession, tokenizer.model).drop("count")
    ids = encode_column(tokenizer.encoder(), F.col("word"))
    each = words.where("word is not null").select(F.explode(ids).alias("token"), "n")
    counts = each.groupBy("token").agg(F.sum("n").alias("count"))
    joined = vocab.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    specials = F.col("str").isin(tokenizer.specials)
    return joined.orderBy(F.desc(specials), F.desc("count"), "token").select("token", "str", "count")


# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
