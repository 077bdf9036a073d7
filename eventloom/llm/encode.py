"""Token ids of whole texts by a public tokenizer, with a bounded memo of words.

White space always ends a token of these tokenizers, so a text's ids are the ids
of its words one after another, and each distinct word of a slice is encoded
once. Letters followed by one of ``.,;:!?`` are cut there too: the tokenizer cuts
between letters and punctuation in any case. A text that holds ``<|`` may spell a
special token and goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered per Python worker; beyond it the memo starts anew.
MEMO_WORDS = 400_000
_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo_words = memo_words
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before and append their ids to the memo."""
        model = self.tokenizer.model
        plain = [w for w in words if w.isascii() and w.isalpha()]
        other = [w for w in words if not (w.isascii() and w.isalpha())]
        ids = [[token.id for token in model.tokenize(w)] for w in plain]
        ids += [e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
        known = len(self.place)
        self.place.update(zip(plain + other, range(known, known + len(words))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, np.fromiter((i for word in ids for i in word), np.int32, int(lengths.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the n + 1 bounds between texts. Nulls count as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            return self._encode_each(texts, special)
        lower = pc.ascii_lower(texts)
        apart = pc.replace_substring_regex(lower, r"([a-z])([.,;:!?]+[ \n]|[.,;:!?]+$)", r"\1 \2")
        lists = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.place) + len(distinct) > self.memo_words:
            self._reset()
        fresh = [w for w in distinct if w not in self.place]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        at = place[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        start, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def _encode_each(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may spell a special token by the library whole, the others as usual."""
        parts: list[np.ndarray] = []
        for i in range(len(texts)):
            if special[i]:
                ids = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
            else:
                ids, _ = self.encode(texts.slice(i, 1))
            parts.append(ids)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), bounds


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append id ``end`` to each text."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
