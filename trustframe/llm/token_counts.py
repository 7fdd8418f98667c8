"""Exact token counts at every prefix of a text, by dynamic programming over the last token.

The encoding of a prefix ends in exactly one token whose neighbour before it is the last token of the shorter prefix
that it leaves, and two tokens may stand together exactly if their joined characters encode to these two: merges
inside a piece never depend on what lies beyond a boundary that no merge crosses. So
``count[i] = count[i - length of the last token] + 1``, and the counts of all prefixes come in one pass. Truncation and
budgets are read off the counts; nothing is encoded again.

No piece joins a character to a space mark after it, and characters outside the vocabulary join nothing, so a text
falls into words whose counts add up. Words of a slice are worked on together in numpy, a position at a time; a worker
remembers words it has seen.

Counts equal those of the public ``sentencepiece`` library without begin and end marks, for BPE models with byte
fallback and an identity normaliser; another kind of model is refused.

Nulls and edge cases: a null text reads as empty; an empty text has no bytes and no tokens. Strings that look like
special tokens are ordinary text. Ties, repeated rows and null ids change nothing. Very long texts and very long words
are counted whole. Columns beside id and text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trustframe.llm.common import map_slices

MARK = "▁"  # stands for a space inside pieces
LIMIT = 4096
# Bounds of what a Python worker remembers: words with their counts, and pairs of tokens known to fit or not.
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 2_000_000
# Longer words are counted one by one, shorter ones together.
LONG_WORD = 64


class PrefixCounter:
    """Counts of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        pieces = list(self.score)
        letters = {c for piece in pieces for c in piece}
        if any(MARK in piece.lstrip(MARK) for piece in pieces) or not letters <= self.score.keys():
            raise ValueError(f"{path} has pieces that go on beyond a word")
        if "".join(model.encode_as_pieces(" a  A\t")) != f"{MARK}{MARK}a{MARK}{MARK}A<0x09>":
            raise ValueError(f"{path} normalises texts or has no byte fallback")
        self.longest = max(map(len, pieces))
        known = "".join(map(re.escape, sorted(letters - {MARK})))
        self.pattern = re.compile(f"{MARK}*[{known}]+|{MARK}+|.", re.DOTALL)
        self.whole = [piece for piece in pieces if self._merge(piece) == [piece]]  # others never come out of merges
        self.index = {piece: i + 1 for i, piece in enumerate(self.whole)}  # 0: the start of a word
        self._build_trie()
        self.pair_keys = np.empty(0, dtype=np.int64)
        self.pair_fits = np.empty(0, dtype=bool)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, int] = {}

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text: the best pair merges first, the leftmost of equal ones."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _build_trie(self) -> None:
        """Edges ``(node, character)`` as sorted keys, with the node they lead to and the token that ends there."""
        nodes: dict[str, int] = {"": 0}
        for piece in self.whole:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes))
        edges = sorted(((nodes[name[:-1]] << 21) | ord(name[-1]), node) for name, node in nodes.items() if name)
        self.edge_keys = np.array([key for key, _ in edges], dtype=np.int64)
        self.edge_nodes = np.array([node for _, node in edges], dtype=np.int64)
        self.node_token = np.zeros(len(nodes), dtype=np.int64)
        for piece, token in self.index.items():
            self.node_token[nodes[piece]] = token

    def fits(self, before: int, token: int) -> bool:
        """Whether two tokens stand together in an encoding; any token may start a word."""
        if not before:
            return True
        key = (before << 20) | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self._forget_pairs()
            a, b = self.whole[before - 1], self.whole[token - 1]
            known = self.pairs[key] = self._merge(a + b) == [a, b]
        return known

    def _forget_pairs(self) -> None:
        self.pairs.clear()
        self.pair_keys, self.pair_fits = self.pair_keys[:0], self.pair_fits[:0]

    def _fits_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (before << 20) | token
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        known = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), dtype=bool)
        if not known.all():
            new = np.unique(keys[~known])
            answers = np.array([self.fits(int(k) >> 20, int(k) & 0xFFFFF) for k in new], dtype=bool)
            joined = np.r_[self.pair_keys, new]
            order = np.argsort(joined, kind="stable")
            self.pair_keys, self.pair_fits = joined[order], np.r_[self.pair_fits, answers][order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word of known characters, from the empty one on."""
        counts, last = [0], [0]
        index, longest = self.index, self.longest
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                token = index.get(word[start:end])
                if token is not None and self.fits(last[start], token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _count_together(self, words: list[str]) -> np.ndarray:
        """Counts of many short words at once: all tokens that match anywhere, then one step for each end position."""
        sizes = np.array([len(word) for word in words])
        width = int(sizes.max())
        letters = np.zeros((len(words), width + 1), dtype=np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        letters[np.repeat(np.arange(len(words)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        row, start = np.nonzero(letters[:, :width])
        node = np.zeros(len(row), dtype=np.int64)
        found = []
        for length in range(1, self.longest + 1):
            inside = start + length <= width
            row, start, node = row[inside], start[inside], node[inside]
            keys = (node << 21) | letters[row, start + length - 1]
            at = np.searchsorted(self.edge_keys, keys)
            at[at == len(self.edge_keys)] = 0
            ok = self.edge_keys[at] == keys
            row, start, node = row[ok], start[ok], self.edge_nodes[at[ok]]
            token = self.node_token[node]
            hit = token > 0
            found.append(np.stack([start[hit] + length, row[hit], start[hit], token[hit]]))
            if not len(row):
                break
        end, row, start, token = np.concatenate(found, axis=1)
        order = np.argsort(end, kind="stable")
        end, row, start, token = end[order], row[order], start[order], token[order]
        bounds = np.searchsorted(end, np.arange(1, width + 2))
        counts = np.zeros((len(words), width + 1), dtype=np.int32)
        last = np.zeros((len(words), width + 1), dtype=np.int64)
        for position in range(1, width + 1):
            part = slice(bounds[position - 1], bounds[position])
            r, s, t = row[part], start[part], token[part]
            before = last[r, s]
            ok = (s == 0) | (before > 0)
            inner = ok & (s > 0)
            ok[inner] = self._fits_all(before[inner], t[inner])
            r, s, t = r[ok], s[ok], t[ok]
            last[r, position] = t
            counts[r, position] = counts[r, s] + 1
        return counts[np.arange(len(words)), sizes]

    def split(self, text: str) -> list[str]:
        """Words of a text, its first one with the mark that the model puts before a text."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def _known(self, word: str) -> bool:
        return len(word) > 1 or word in self.score

    def learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        short = []
        for word in words:
            if word in self.words:
                continue
            if not self._known(word):
                self.words[word] = len(word.encode("utf-8"))
            elif len(word) > LONG_WORD:
                self.words[word] = self.prefix_counts(word)[-1]
            else:
                short.append(word)
        short.sort(key=len)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self.words.update(zip(part, self._count_together(part).tolist()))

    def count(self, words: list[str]) -> int:
        known = self.words
        return sum([known[word] for word in words])

    def fit(self, words: list[str], limit: int) -> int:
        """Characters of the longest prefix of the text with at most ``limit`` tokens."""
        used = chars = 0
        for word in words:
            total = used + self.words[word]
            if total > limit:
                if self._known(word):
                    within = [i for i, n in enumerate(self.prefix_counts(word)) if used + n <= limit]
                    chars += within[-1]
                break
            used, chars = total, chars + len(word)
        else:
            return max(0, chars - 1)
        return max(0, chars - 1)  # without the mark before the text


@lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)`` of each row.

    ``fit_chars`` is the number of characters of the longest prefix that stays within ``limit`` tokens.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(part: pa.RecordBatch) -> dict:
        model = load(path)
        texts = [text or "" for text in part.column(1).to_pylist()]
        split = [model.split(text) for text in texts]
        model.learn({word for words in split for word in words})
        counts = [model.count(words) for words in split]
        return {
            "doc_id": part.column(0),
            "n_bytes": [len(text.encode("utf-8")) for text in texts],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
            "fit_chars": [
                len(text) if n <= limit else model.fit(words, limit) for text, words, n in zip(texts, split, counts)
            ],
        }

    return map_slices(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def token_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trustframe.llm.common import read_table

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
