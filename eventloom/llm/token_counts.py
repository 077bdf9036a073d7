"""Word-piece counts by a linear longest-match automaton.

Words are what stands between ASCII white space. A word gets a word-begin mark and
is cut from the left into the longest vocabulary pieces; a word that cannot be cut
to its end is one unknown piece.

The vocabulary is a trie. Where the trie has no way on, the node's failure link
leads to the node for what is left after the pieces that longest match would have
cut off by then, and a precomputed number says how many pieces those are. Lengths
thus come from one pass over the letters, and no piece is ever built. The automaton
runs over many distinct words of a slice at once, letter by letter.

Results by case: null and empty texts count zero; an empty table gives no rows;
repeated rows each give their own row; other columns are ignored. Time is linear in
the text, however long its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import filled, segment_sums, slices

#: Word-begin mark of the vocabulary file (fixed value).
BEGIN = "▁"
#: Fewer open words than this run one by one.
SCALAR_WORDS = 24


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentence-piece file, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """Trie over UTF-8 bytes with failure links and popped-piece counts."""

    def __init__(self, pieces: list[str]) -> None:
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece.encode():
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][byte]
            whole[node] = node != 0
        n = len(children)
        fail, popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        queue = [0]
        for node in queue:  # grows while it is walked: breadth first
            for byte, child in children[node].items():
                queue.append(child)
                if whole[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                count, back = int(popped[node]), int(fail[node])
                while back >= 0 and byte not in children[back]:
                    count, back = count + int(popped[back]), int(fail[back])
                if back >= 0:
                    fail[child], popped[child] = children[back][byte], count
        self.children, self.fail, self.popped = children, fail, popped
        # Edges as one sorted array of node * 256 + byte, for lookups by the thousand.
        edges = sorted((node * 256 + byte, child) for node, found in enumerate(children) for byte, child in found.items())
        self.edges = np.array([code for code, _ in edges] + [1 << 62], np.int64)
        self.to = np.array([child for _, child in edges] + [-1], np.int32)
        node = 0
        for byte in BEGIN.encode():
            node = children[node].get(byte, -1)
            if node < 0:
                raise ValueError("the vocabulary has no word-begin mark")
        self.start = node

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Where the trie leads from each node, -1 where it has no way on."""
        code = node.astype(np.int64) * 256 + byte
        at = np.searchsorted(self.edges, code)
        return np.where(self.edges[at] == code, self.to[at], -1)

    def count_one(self, word: bytes) -> int:
        """Pieces of one word, or -1 if it is unknown."""
        children, fail, popped = self.children, self.fail, self.popped
        node, count = self.start, 0
        for byte in word:
            while byte not in children[node]:
                count += int(popped[node])
                node = int(fail[node])
                if node < 0:
                    return -1
            node = children[node][byte]
        while node:
            count += int(popped[node])
            node = int(fail[node])
            if node < 0:
                return -1
        return count

    def counts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pieces of each word (bytes between neighbouring ``bounds``), -1 where unknown. All words step together."""
        order = np.argsort(-(bounds[1:] - bounds[:-1]), kind="stable")
        begin, length = bounds[:-1][order], (bounds[1:] - bounds[:-1])[order]
        node, count = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int32)
        longest = int(length[0]) if len(length) else 0
        open_at = np.searchsorted(-length, -np.arange(longest), side="left")  # words longer than each step
        for step in range(longest):
            live = int(open_at[step])
            if live < SCALAR_WORDS and longest - step > 64:
                return self._finish_scalar(raw, order, begin, length, node, count, step, live)
            going = np.flatnonzero(node[:live] >= 0)
            byte = raw[begin[going] + step]
            while len(going):
                onward = self._next(node[going], byte)
                stuck = onward < 0
                node[going[~stuck]] = onward[~stuck]
                going, byte = going[stuck], byte[stuck]
                count[going] += self.popped[node[going]]
                node[going] = self.fail[node[going]]
                alive = node[going] >= 0
                going, byte = going[alive], byte[alive]
        return self._close(order, node, count)

    def _close(self, order: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        rest = np.flatnonzero(node > 0)
        while len(rest):
            count[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            rest = rest[node[rest] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(node < 0, -1, count)
        return out

    def _finish_scalar(self, raw, order, begin, length, node, count, step, live) -> np.ndarray:
        """The few longest words, each by itself from where it stands."""
        children, fail, popped = self.children, self.fail, self.popped
        for i in range(live):
            state, total = int(node[i]), int(count[i])
            for byte in raw[begin[i] + step : begin[i] + length[i]].tobytes():
                while state >= 0 and byte not in children[state]:
                    total += int(popped[state])
                    state = int(fail[state])
                if state < 0:
                    break
                state = children[state][byte]
            node[i], count[i] = state, total
        return self._close(order, node, count)


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton per worker and file."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``n_tokens`` (an unknown word is one) and ``n_unknown`` words, one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in slices(batches):
            lists = pc.ascii_split_whitespace(batch.column("text"))
            words = lists.flatten().dictionary_encode()
            distinct = words.dictionary
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in distinct), np.uint8)
            lengths = machine.counts(raw, bounds)
            lengths[np.diff(bounds) == 0] = 0
            each = lengths[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            real = np.diff(bounds)[words.indices.to_numpy(zero_copy_only=False)] > 0 if len(words) else np.zeros(0, bool)
            offsets = lists.offsets.to_numpy()
            offsets = (offsets - offsets[0]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(segment_sums(real.astype(np.int64), offsets)),
                    pa.array(segment_sums(np.abs(each), offsets)),
                    pa.array(segment_sums((each < 0).astype(np.int64), offsets)),
                ],
                [key, "n_words", "n_tokens", "n_unknown"],
            )

    rows = docs.select(F.col(key).cast("long").alias(key), filled(text).alias("text"))
    return rows.mapInArrow(count, f"{key} long, n_words long, n_tokens long, n_unknown long")
