"""The text job: events to texts, texts to vocabularies, texts to ids, each stage switched by its section.

```python
run_text_job(spark, {
    "translation": {"lookup_dir": ..., "meds_root": ..., "output_root": ..., "splits": ["train", "test"], "overwrite": False},
    "bpe_training": {"data_root": ..., "output_dir": ..., "vocab_sizes": [4000], "min_frequency": 2},
    "encoding": {"data_root": ..., "tokenizer_dir": ..., "output_root": ..., "splits": ["train", "test"]},
})
```

A section that is missing or has ``enabled: false`` does not run. Folders hold one subfolder per split.
Splits without a folder are left out; a split translated already stays unless ``overwrite`` is set.
Limits on files and rows are not taken: a stage works on all it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.operators.bpe import TextBpe
from eventloom.operators.phrases import EventPhrases, patient_text
from eventloom.plans.text_vocab import DEFAULT_COLUMN, DEFAULT_MIN_FREQUENCY, encode_texts, run_text_vocab
from eventloom.schema import event_table
from eventloom.sources.events import TEXT_SPLITS, check_shards, path_exists, text_column
from eventloom.sources.sinks import write_mode, write_timelines, write_translated

SECTIONS = ("translation", "bpe_training", "encoding")


def _enabled(config: dict, section: str) -> dict | None:
    found = config.get(section)
    return found if found and found.get("enabled", True) else None


def run_text_job(spark: SparkSession, config: dict, phrases: EventPhrases | None = None) -> dict[str, list]:
    """Run the stages of ``config``; what each one did, by section.

    ``phrases`` stands for the lookup files where they are tables already.
    """
    unknown = set(config) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}, known are {SECTIONS}")
    stages = {"translation": lambda c: translate_splits(spark, c, phrases), "bpe_training": lambda c: learn_vocabularies(spark, c), "encoding": lambda c: encode_splits(spark, c)}
    return {name: stages[name](section) for name in SECTIONS if (section := _enabled(config, name)) is not None}


def _split_folders(spark: SparkSession, root: str, splits: list[str]) -> dict[str, str]:
    folders = {split: f"{root.rstrip('/')}/{split}" for split in splits}
    return {split: folder for split, folder in folders.items() if path_exists(spark, folder)}


def translate_splits(spark: SparkSession, section: dict, phrases: EventPhrases | None = None) -> list[str]:
    """Write the texts of every split; the splits written."""
    phrases = phrases or EventPhrases.from_folder(section["lookup_dir"])
    overwrite = bool(section.get("overwrite", False))
    done = []
    for split, folder in _split_folders(spark, section["meds_root"], section.get("splits", list(TEXT_SPLITS))).items():
        target = f"{section['output_root'].rstrip('/')}/{split}"
        if not overwrite and path_exists(spark, f"{target}/_SUCCESS"):
            continue
        check_shards(spark, folder)
        events = event_table(spark.read.parquet(folder))
        # A folder without its mark is left from a job that failed.
        write_translated(patient_text(phrases.translate(events), events), target, write_mode(overwrite=True))
        done.append(split)
    return done


def learn_vocabularies(spark: SparkSession, section: dict) -> list[int]:
    """Train, evaluate and save every size; the sizes."""
    sizes = list(section.get("vocab_sizes") or [])
    if not sizes:
        raise ValueError("bpe_training.vocab_sizes must name a size")
    run_text_vocab(
        spark, section["data_root"], section["output_dir"], section.get("column", DEFAULT_COLUMN), sizes,
        int(section.get("min_frequency", DEFAULT_MIN_FREQUENCY)), overwrite=bool(section.get("overwrite", True)),
    )
    return sizes


def encode_splits(spark: SparkSession, section: dict) -> list[str]:
    """Write the ids of every split with a saved vocabulary; the splits written."""
    column = section.get("column", DEFAULT_COLUMN)
    folders = _split_folders(spark, section["data_root"], section.get("splits", list(TEXT_SPLITS)))
    if not folders:
        raise ValueError(f"no split of {section.get('splits', list(TEXT_SPLITS))} under {section['data_root']}")
    tokenizer = TextBpe.load(spark, section["tokenizer_dir"])
    mode = write_mode(overwrite=bool(section.get("overwrite", True)))
    for split, folder in folders.items():
        check_shards(spark, folder)
        texts: DataFrame = text_column(spark.read.parquet(folder), column, "subject_id")
        write_timelines(encode_texts(tokenizer, texts, column), f"{section['output_root'].rstrip('/')}/{split}", mode)
    return list(folders)
