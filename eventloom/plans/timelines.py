"""From events to token timelines: fit on train, learn a vocabulary, encode every split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.base import Operator
from eventloom.operators.sequence import SequenceOperator, build_sequence
from eventloom.operators.tokens import Markers, token_rows
from eventloom.operators.word_vocab import WordLevel
from eventloom.operators.bpe import merges_table, vocab_table
from eventloom.operators.pieces import Merges
from eventloom.ordering import Ordered
from eventloom.plans.chain import apply_operators, fit_operators, number_operators
from eventloom.plans.registry import build_postprocessors, build_preprocessors, build_tokenizer
from eventloom.session import materialize
from eventloom.sources.events import path_exists, read_events
from eventloom.sources.sinks import write_mode, write_timelines, write_vocab

REQUIRED = ("data", "save_path", "tokenization")


class TimelineRun:
    """A configured run. ``fit`` then ``encode``; the token rows feed both vocabulary and ids."""

    def __init__(
        self,
        preprocessors: list[Operator],
        postprocessors: list[SequenceOperator],
        tokenizer,
        markers: Markers = Markers(),
        fit_mode: str = "joint",
    ):
        self.preprocessors = preprocessors
        self.postprocessors = postprocessors
        self.tokenizer = tokenizer
        self.markers = markers
        self.fit_mode = fit_mode

    @classmethod
    def from_config(cls, config: dict, fit_mode: str = "joint") -> "TimelineRun":
        tokenizer, markers = build_tokenizer(config["tokenization"])
        return cls(
            build_preprocessors(config.get("preprocessing")),
            build_postprocessors(config.get("postprocessing")),
            tokenizer,
            markers,
            fit_mode,
        )

    def fit(self, events: DataFrame) -> "TimelineRun":
        fit_operators(self.preprocessors, train_part(events), self.fit_mode)
        return self

    def tokens(self, events: DataFrame) -> Ordered:
        """Token rows of every subject."""
        rows = build_sequence(apply_operators(self.preprocessors, events), events)
        for operator in self.postprocessors:
            rows = operator.apply(rows)
        return token_rows(rows, self.markers)

    def train(self, rows: Ordered) -> "TimelineRun":
        self.tokenizer.train(rows.with_df(train_part(rows.df)))
        return self

    def encode(self, rows: Ordered) -> DataFrame:
        return self.tokenizer.encode(rows)

    def vocab(self, like: DataFrame) -> DataFrame:
        if isinstance(self.tokenizer, WordLevel):
            return self.tokenizer.vocab
        return vocab_table(like.sparkSession, self.tokenizer.model)

    def run(self, events: DataFrame) -> DataFrame:
        """Fit, train and encode; timelines for every split in ``events``.

        The token rows are written to the shared folder between vocabulary and
        encoding: a lost executor does not cost the run its events again.
        """
        if self.preprocessors:
            # Every fit and every inserting operator reads the events again. Were they not written, each would
            # also compute their columns again, and a filter once for every mention of a column.
            events = materialize(events, "events")
        rows = self.fit(events).tokens(events)
        rows = rows.with_df(materialize(rows.df, "token-rows"))
        return self.train(rows).encode(rows)


    def save(self, spark, path: str, mode: str = "errorifexists") -> None:
        """What was learned, as tables: each operator's fit, and the vocabulary with its merges."""
        for i, operator in enumerate(self.preprocessors):
            if operator.fitted is not None:
                operator.save_fit(f"{path}/operators/{i}", mode)
        if isinstance(self.tokenizer, WordLevel):
            self.tokenizer.vocab.write.mode(mode).parquet(f"{path}/vocab")
            return
        model = self.tokenizer.model
        vocab_table(spark, model).write.mode(mode).parquet(f"{path}/vocab")
        merges_table(spark, model).withColumn("n_first", F.lit(model.n_first)).write.mode(mode).parquet(f"{path}/merges")

    @classmethod
    def load(cls, spark, config: dict, path: str) -> "TimelineRun":
        """A saved run under the configuration that it was made with, ready to encode other events."""
        run = cls.from_config(config)
        number_operators(run.preprocessors)
        for i, operator in enumerate(run.preprocessors):
            if path_exists(spark, f"{path}/operators/{i}"):
                operator.load_fit(spark, f"{path}/operators/{i}")
        vocab = spark.read.parquet(f"{path}/vocab")
        if isinstance(run.tokenizer, WordLevel):
            run.tokenizer.vocab = vocab
            return run
        # As many rows as the vocabulary has entries.
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        ids = {row["str"]: row["token"] for row in vocab.collect()}
        first = merges[0]["n_first"] if merges else len(ids)
        run.tokenizer.model = Merges(ids, [(m["left"], m["right"], m["merged"]) for m in merges], first)
        return run


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train") if "split" in df.columns else df


def run_config(spark, config: dict, run_name: str, overwrite: bool = False) -> str:
    """Read the splits, run the configuration, write ``timelines`` and ``vocab.csv``."""
    missing = [field for field in REQUIRED if field not in config]
    if missing:
        raise ValueError(f"config lacks {missing}")
    target = f"{config['save_path'].rstrip('/')}/{run_name}"
    mode = write_mode(overwrite=overwrite)
    run = TimelineRun.from_config(config)
    events = read_events(spark, config["data"]["path"])
    timelines = run.run(events)
    write_timelines(timelines, f"{target}/timelines", mode)
    write_vocab(run.vocab(events), f"{target}/vocab.csv", mode)
    return target
