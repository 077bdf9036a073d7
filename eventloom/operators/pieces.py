"""Byte-pair merges: learning them on the distinct-word table, applying them to words.

While learning, every symbol is one character (``symbol``), so a word is a plain
string, a pair is two characters, a merge is a literal ``replace``, and the order of
strings is the order of symbol ids. ``pair_index`` holds the words and their pairs.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.pair_index import PairIndex

_SYMBOL_BASE = 0x100
_SURROGATES = 0xD800
MEMO_WORDS = 200_000
#: Merges up to which all words of a batch are merged together.
TOGETHER = 512
# Private characters: from the first on they stand for merged strings, the last one stands between words.
_MADE, _BETWEEN = 0xE000, "\uf8ff"
_PRIVATE = re.compile("[\ue000-\uf8ff]")


def symbol(number: int) -> str:
    """The character that stands for symbol ``number`` (surrogate code points are skipped)."""
    point = number + _SYMBOL_BASE
    return chr(point if point < _SURROGATES else point + 0x800)


@dataclass
class Merges:
    """A learned model: ids by string, and the merges in the order they were learned."""

    ids: dict[str, int]
    merges: list[tuple[str, str, str]]  # left, right, merged
    n_first: int  # strings that were there before the first merge

    def vocab_rows(self) -> list[tuple[int, str]]:
        return sorted((i, s) for s, i in self.ids.items())

    def cut(self, vocab_size: int) -> "Merges":
        """The model a smaller vocabulary would have learned: a prefix of the merges."""
        kept = {s: i for s, i in self.ids.items() if i < max(vocab_size, self.n_first)}
        size, merges = self.n_first, []
        for merge in self.merges:
            if size >= vocab_size:
                break
            if self.ids[merge[2]] == size:
                size += 1
            merges.append(merge)
        return Merges(kept, merges, self.n_first)


def learn(
    words: DataFrame,
    alphabet: list[str],
    specials: list[str],
    vocab_size: int,
    once_per_word: bool,
    min_weight: int = 1,
    reuse_ids: bool = False,
) -> Merges:
    """Learn merges from ``words`` (``word`` in symbols of ``alphabet``, ``freq``).

    Every merge takes the pair with the greatest weight (ties: lower symbols) and
    merges it everywhere. A merge may produce a string that exists: with ``reuse_ids``
    it keeps its id and the vocabulary does not grow, else the string moves to a new id.
    """
    symbols = [*specials, *alphabet]
    numbers = {s: i for i, s in enumerate(symbols)}
    ids = dict(numbers)
    next_id = n_first = len(ids)
    merges: list[tuple[str, str, str]] = []

    def choose(pair: str, alone: bool = True) -> tuple[str, bool] | None:
        """The symbol that a pair becomes and whether it is a new one; None: no merge."""
        nonlocal next_id
        left, right = _numbers(pair)
        text = symbols[left] + symbols[right]
        new = text not in numbers
        if next_id >= vocab_size or not (new or alone):
            return None
        merges.append((symbols[left], symbols[right], text))
        if new:
            numbers[text] = len(symbols)
            symbols.append(text)
        if text not in ids or not reuse_ids:
            ids[text] = next_id
            next_id += 1
        return symbol(numbers[text]), new

    if next_id < vocab_size:
        index = PairIndex(words, once_per_word, min_weight)
        while next_id < vocab_size and index.best() is not None:
            index.take(choose)
    return Merges(ids, merges, n_first)


def _numbers(pair: str) -> tuple[int, int]:
    def number(char: str) -> int:
        point = ord(char)
        return (point if point < _SURROGATES else point - 0x800) - _SYMBOL_BASE

    return number(pair[0]), number(pair[1])


def merge_steps(word: str, ranks: dict[tuple[str, str], int], pieces: list[str]) -> Iterator[tuple[list[str], float]]:
    """Pieces of a word before each merge, with the merge's rank: the earliest learned one, everywhere in the word.

    The last step has infinite rank: nothing applies any more.
    """
    while True:
        best = min(zip(pieces, pieces[1:]), key=lambda pair: ranks.get(pair, math.inf), default=None)
        rank = ranks.get(best, math.inf)
        yield pieces, rank
        if rank == math.inf:
            return
        joined, i = [], 0
        while i < len(pieces):
            if i + 1 < len(pieces) and (pieces[i], pieces[i + 1]) == best:
                joined.append(pieces[i] + pieces[i + 1])
                i += 2
            else:
                joined.append(pieces[i])
                i += 1
        pieces = joined


def split_word(word: str, ranks: dict[tuple[str, str], int], pieces: list[str]) -> list[str]:
    """Apply the earliest learned merge of a word everywhere in it, until none applies."""
    for pieces, _ in merge_steps(word, ranks, pieces):
        pass
    return pieces


def lengths_at(word: str, ranks: dict[tuple[str, str], int], cuts: list[int]) -> list[int]:
    """Number of pieces of a word under the first ``cut`` ranks, for every cut, from one run of its merges.

    A run with fewer ranks takes the same merges until the first one that it lacks.
    """
    lengths: list[int | None] = [None] * len(cuts)
    for pieces, rank in merge_steps(word, ranks, list(word)):
        for i, cut in enumerate(cuts):
            if lengths[i] is None and rank >= cut:
                lengths[i] = len(pieces)
        if None not in lengths:
            break
    return lengths


def _memoized(encode: Callable[[str], list[int]]) -> Callable[[str], list[int]]:
    """Remember recent words; the memo is emptied when full, so a task's memory stays bounded."""
    memo: dict[str, list[int]] = {}

    def lookup(word: str) -> list[int]:
        found = memo.get(word)
        if found is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            found = memo[word] = encode(word)
        return found

    return lookup


def merge_ranks(merges: list[tuple[str, str, str]]) -> dict[tuple[str, str], int]:
    ranks: dict[tuple[str, str], int] = {}
    for left, right, _text in merges:
        ranks.setdefault((left, right), len(ranks))
    return ranks


def event_encoder(model: Merges, suffix: str, whole: dict[str, int]) -> Callable[[str], list[int]]:
    """Encode one event string; special tokens stay whole, unknown pieces get id 0."""
    ranks = merge_ranks(model.merges)

    def encode(word: str) -> list[int]:
        if word in whole:
            return [whole[word]]
        pieces = list(word)
        if pieces:
            pieces[-1] += suffix
        return [model.ids.get(piece, 0) for piece in split_word(word, ranks, pieces)]

    return _memoized(encode)


def text_encoder(
    model: Merges, unknown: str, spell: Callable[[str], str] | None = None
) -> Callable[[str], list[int]]:
    """Encode one word of a text; ``spell`` gives the characters that its pieces are made of."""
    ranks = merge_ranks(model.merges)
    missing = model.ids[unknown]

    def encode(word: str) -> list[int]:
        word = word if spell is None else spell(word)
        return [model.ids.get(p, missing) for p in split_word(word, ranks, list(word))]

    return _memoized(encode)


def words_encoder(
    model: Merges, unknown: str, spell: Callable[[str], str] | None = None
) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """Encode many words: the ids of all, and how many each has; a null word has none.

    Few merges are applied one after the other to one text of all words. That is the order of ``merge_steps``: a
    merge makes an earlier one due again only if its product was known before. ``spell`` must go by character.
    """
    encode_word = text_encoder(model, unknown, spell)

    def one_by_one(words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        each = [() if word is None else encode_word(word) for word in words]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(lengths.sum())), lengths

    ranks = merge_ranks(model.merges)
    if len(ranks) > TOGETHER or any(len(s) == 1 and _PRIVATE.match(s) for s in model.ids):
        return one_by_one
    symbols: dict[str, str] = {}

    def as_symbol(string: str) -> str:
        return string if len(string) == 1 else symbols.setdefault(string, chr(_MADE + len(symbols)))

    steps = []
    for left, right in ranks:
        pair = as_symbol(left) + as_symbol(right)
        steps.append((pair, left + right in symbols, as_symbol(left + right)))
    codes = np.full(sys.maxunicode + 1, model.ids[unknown], np.int32)
    for string, number in model.ids.items():
        if len(string) == 1 or string in symbols:
            codes[ord(as_symbol(string))] = number
    between = "" if spell is None else spell(_BETWEEN)

    def together(words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        text = _BETWEEN.join(word or "" for word in words)
        if spell is not None:
            text = spell(text).replace(between, _BETWEEN)
        if len(_PRIVATE.findall(text)) != len(words) - 1:
            return one_by_one(words)
        step = 0
        while step < len(steps):
            pair, known, product = steps[step]
            step += 1
            if pair in text:
                text = text.replace(pair, product)
                if known:
                    step = 0
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        edges = np.flatnonzero(points == ord(_BETWEEN))
        lengths = np.diff(np.concatenate([[-1], edges, [len(points)]])) - 1
        return codes[np.delete(points, edges)], lengths

    return together


def special_aware_encoder(model: Merges, unknown: str, specials: list[str]) -> Callable[[str], list[int]]:
    """Encode a string: special tokens stay whole wherever they occur, the rest is split into words."""
    encode_word = text_encoder(model, unknown)
    whole = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    words = re.compile(r"\w+|[^\w\s]+")

    def encode(text: str) -> list[int]:
        found: list[int] = []
        for i, piece in enumerate(whole.split(text)):
            if i % 2:  # the split alternates between other text and the special tokens found
                found.append(model.ids[piece])
            else:
                found += [number for word in words.findall(piece) for number in encode_word(word)]
        return found

    return _memoized(encode)


def encode_column(make_encoder: Callable[[], Callable[[str], list[int]]], words: Column) -> Column:
    """Ids of one word per row. Narrow: no shuffle, so a frequent word skews nothing."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batch: pd.Series) -> pd.Series:
        encoder = _shared(make_encoder)
        return batch.map(lambda w: None if w is None else encoder(w))

    return encode(words)


def encode_list_column(
    make_encoder: Callable[[], Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]], words: Column
) -> Column:
    """Ids of an array of words per row, flattened."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batch: pa.Array) -> pa.Array:
        encoder = _shared(make_encoder)
        held = batch.flatten()
        # Every distinct word of a batch is encoded once.
        coded = held.dictionary_encode()
        ids, lengths = encoder(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lengths[which]
        ends = np.cumsum(sizes)
        # The place in ``ids`` of each id of each word.
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - sizes), sizes)
        counts = np.nan_to_num(pc.list_value_length(batch).to_numpy(zero_copy_only=False)).astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        offsets = pa.array(bounds, pa.int32(), mask=np.append(batch.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(ids[places], pa.int32()))

    return encode(words)


_encoders: dict[object, Callable] = {}


def _shared(make_encoder: Callable[[], Callable]) -> Callable:
    """One encoder per task, so its memo outlives a batch."""
    encoder = _encoders.get(make_encoder)
    if encoder is None:
        _encoders.clear()
        encoder = _encoders[make_encoder] = make_encoder()
    return encoder


# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
