"""Operators by the ``type`` strings of a run's configuration."""

from __future__ import annotations

from eventloom.operators.ages import BinnedAge, DecimalAge, EthosQuantileAge, RawAge
from eventloom.operators.base import Operator
from eventloom.operators.bpe import BytePairTokens, WhitespaceBpe
from eventloom.operators.codes import CodeEnrichment, CodeTruncation
from eventloom.operators.filters import FilterEvents, TopKCodes
from eventloom.operators.measurements import DemographicAggregation
from eventloom.operators.sequence import (
    DemographicSortOrder,
    NaturalLanguageTranslation,
    RemoveNumeric,
    SequenceOperator,
    TimeIntervals,
)
from eventloom.operators.static import LoadStaticData
from eventloom.operators.tokens import Markers
from eventloom.operators.values import QuantileBin, QuantileBin3Level, RoundNumeric
from eventloom.operators.word_vocab import WordLevel

PREPROCESSORS = {
    "code_truncation": CodeTruncation,
    "quantile_bin": QuantileBin,
    "filter": FilterEvents,
    "code_enrichment": CodeEnrichment,
    "load_static_data": LoadStaticData,
    "ethos_quantile_age": EthosQuantileAge,
    "decimal_age": DecimalAge,
    "binned_age": BinnedAge,
    "quantile_bin_3level": QuantileBin3Level,
    "demographic_aggregation": DemographicAggregation,
    "round_numeric": RoundNumeric,
    "raw_age": RawAge,
    "top_k_filter": TopKCodes,
}

POSTPROCESSORS = {
    "time_interval": TimeIntervals,
    "demographic_sort_order": DemographicSortOrder,
    "remove_numeric": RemoveNumeric,
    "natural_language_translation": NaturalLanguageTranslation,
}

TOKENIZERS = {"word_level": WordLevel, "bpe": BytePairTokens, "hf_bpe": WhitespaceBpe}


def _build(kind: str, table: dict, config: dict):
    options = dict(config)
    name = options.pop("type")
    if name not in table:
        raise ValueError(f"Unknown {kind} type: {name}; expected one of {sorted(table)}")
    return table[name](**options)


def build_preprocessors(configs: list[dict]) -> list[Operator]:
    return [_build("preprocessor", PREPROCESSORS, c) for c in configs or []]


def build_postprocessors(configs: list[dict]) -> list[SequenceOperator]:
    return [_build("postprocessor", POSTPROCESSORS, c) for c in configs or []]


def build_tokenizer(config: dict):
    """The tokenizer and its markers."""
    markers = Markers(
        config.get("insert_event_tokens", True),
        config.get("insert_numeric_tokens", True),
        config.get("insert_text_tokens", True),
    )
    name = config["tokenizer"]
    if name not in TOKENIZERS:
        raise ValueError(f"Unknown tokenizer: {name}; expected one of {sorted(TOKENIZERS)}")
    if name == "hf_bpe":
        return WhitespaceBpe(config["vocab_size"], markers, config.get("special_tokens")), markers
    return TOKENIZERS[name](config["vocab_size"]), markers
