"""From translated texts to vocabularies of several sizes, and to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.bpe import TextBpe, merges_table, text_eval, text_words, vocab_counts
from eventloom.session import materialize
from eventloom.sources.events import in_splits, read_text_splits, text_column
from eventloom.sources.sinks import write_mode, write_report, write_timelines, write_vocab

# Defaults of the text vocabulary tools.
DEFAULT_COLUMN = "text_sequence_with_time"
DEFAULT_VOCAB_SIZES = [4000]
DEFAULT_MIN_FREQUENCY = 2


def train_to_largest(train: DataFrame, column: str, vocab_sizes: list[int], min_frequency: int) -> TextBpe:
    """One training to the greatest size: a smaller vocabulary is a prefix of its merges."""
    return TextBpe(max(vocab_sizes), min_frequency).train_texts(F.col(column), train)


def counted_words(tokenizer: TextBpe, rows: DataFrame, column: str = DEFAULT_COLUMN) -> DataFrame:
    return text_words(rows, column, type(tokenizer).runs, type(tokenizer).spell)


def vocab_experiments(
    train: DataFrame,
    test: DataFrame,
    column: str = DEFAULT_COLUMN,
    vocab_sizes: list[int] = DEFAULT_VOCAB_SIZES,
    min_frequency: int = DEFAULT_MIN_FREQUENCY,
) -> DataFrame:
    """One row of test metrics per vocabulary size: one training, one scan of the test texts."""
    largest = train_to_largest(train, column, vocab_sizes, min_frequency)
    return text_eval(counted_words(largest, test, column), largest.model, vocab_sizes)


def positional(tokens: Column) -> Column:
    """0, 1, 2, ... beside the tokens: flattened text has no event times."""
    none = F.array().cast("array<int>")
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(none)


def encode_texts(
    tokenizer: TextBpe, rows: DataFrame, column: str = DEFAULT_COLUMN
) -> DataFrame:
    """Timelines of a text column with positions as times."""
    keep = [c for c in ("subject_id", "split") if c in rows.columns]
    kept = text_column(rows, column, *keep)
    encoded = tokenizer.encode_texts(kept, column)
    return encoded.select(*keep, "tokens", positional(F.col("tokens")).alias("timestamps"))


def vocab_folder(output_dir: str, size: int) -> str:
    return f"{output_dir.rstrip('/')}/vocab_{size}"


def run_text_vocab(
    spark,
    data_root: str,
    output_dir: str,
    column: str = DEFAULT_COLUMN,
    vocab_sizes: list[int] = DEFAULT_VOCAB_SIZES,
    min_frequency: int = DEFAULT_MIN_FREQUENCY,
    encode_size: int | None = None,
    overwrite: bool = False,
) -> TextBpe:
    """Train, evaluate and save each size; with ``encode_size`` also encode both splits."""
    texts = text_column(read_text_splits(spark, data_root), column, "subject_id", "split")
    train, test = in_splits(texts, ["train"]), in_splits(texts, ["test"])
    mode = write_mode(overwrite=overwrite)
    largest = train_to_largest(train, column, vocab_sizes, min_frequency)
    words = materialize(counted_words(largest, test, column), "test-words")
    for size in vocab_sizes:
        tokenizer = largest.cut(size)
        folder = vocab_folder(output_dir, size)
        write_vocab(vocab_counts(words, tokenizer), f"{folder}/vocab.csv", mode)
        merges_table(spark, tokenizer.model).write.mode(mode).parquet(f"{folder}/merges")
    write_report(text_eval(words, largest.model, vocab_sizes), f"{output_dir}/experiment_metrics.csv", mode)
    chosen = largest.cut(encode_size) if encode_size else largest
    if encode_size:
        write_timelines(encode_texts(chosen, texts, column), f"{output_dir}/encoded_{encode_size}", mode)
    return chosen
