"""Byte-level BPE with word ends: encoding by batched numpy merge rounds, and decoding.

All words of a slice that are not known yet lie in one flat array of symbols. A round finds the rank of every changed
pair by binary search over the sorted pair keys, takes the lowest rank of each word by one segmented minimum and
merges all its occurrences, left to right. Words without a known pair leave the array.

Results equal those of the public ``tokenizers`` library with ``add_special_tokens=False`` and
``decode(ids, skip_special_tokens=False)`` for files of this kind (NFC, lower case, split, byte level, no decoder);
another kind of file is refused.

Nulls and edge cases: a null text reads as empty; an empty text has no tokens and decodes to an empty string. Special
strings inside a text become their special ids, as the library does by default. Rows stay rows: ties, repeated rows
and null ids change nothing. A very long text is cut into words like any other; only one word's symbols need to be
held together. Columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from trustframe.llm.common import map_slices

NO_RANK = np.iinfo(np.int32).max
# Pieces between white space that a Python worker remembers before it starts anew.
REMEMBERED = 200_000

# Ranges of code points that are letters or numbers in newer Unicode versions only. The library's
# pattern takes them for neither.
NOT_YET_ALPHANUMERIC = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
# Combining marks that are newer than the library's tables of composition, which neither order nor
# compose them.
UNORDERED_MARKS = (
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    r"\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    r"\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34"
    r"\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1"
    r"\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
# Lower case of letters that this Python does not know yet.
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B,
} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
# These split a text for Python, and are marks like others for the library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPLIT = (
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NOT_YET_ALPHANUMERIC}]]+|[\p{{N}}--[{NOT_YET_ALPHANUMERIC}]]"
    rf"|[[^\s\p{{L}}\p{{N}}]||[{NOT_YET_ALPHANUMERIC}]]+"
)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, steps = data["model"], [step["type"] for step in data["normalizer"]["normalizers"]]
        if model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or data["decoder"]:
            raise ValueError(f"{path} is not a vocabulary of lower-case words with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        self.tokens = {index: token for token, index in (vocab | self.special).items()}
        stand_in = byte_characters()
        self.inner = np.array([vocab[c] for c in stand_in], dtype=np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in stand_in], dtype=np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        left, right = (np.array([vocab[pair[i]] for pair in pairs], dtype=np.int64) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged
        self.pattern = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.unordered = regex.compile(f"([{UNORDERED_MARKS}])")
        self.newer = regex.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
        self.known: dict[str | tuple[str], tuple[int, str, str]] = {}

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """Normalised pieces of a text between white space; a special string is a tuple, which no plain piece equals."""
        if "<|" in text:
            parts = self.specials.split(text)
            return [c for i, part in enumerate(parts) for c in ([(part,)] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.unordered.search(text):  # each stands between texts that are composed by themselves
                text = "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(self.unordered.split(text)))
            else:
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # the library lowers each letter by itself, so no final form
            if self.newer.search(text):
                text = text.translate(NEWER_LOWER)
        text = text.lower()
        if any(c in text for c in SEPARATORS):
            return self.pattern.findall(text)
        return text.split()

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk. Most are letters with or without one mark at the end, which needs no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of (normalised, non-empty) words, one after the other, and the number of ids of each."""
        raw = [word.encode("utf-8") for word in words]
        sizes = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[flat]
        symbols[np.cumsum(sizes) - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(word)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            if done.any():
                stay = np.repeat(~done, lengths)
                ended.append((word[~stay], symbols[~stay]))
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                lowest, lengths = lowest[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])  # a a a: the pairs overlap, every other one merges
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at = place[hit]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[at] = touched[at - (at > 0)] = True
            rank[touched] = NO_RANK
            touched[:-1] &= word[:-1] == word[1:]
            touched[-1] = False
            changed = np.flatnonzero(touched)
            rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        word, symbols = (np.concatenate([part[i] for part in ended]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def decode(self, ids) -> str:
        """Tokens joined by one space, special ones included; the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])

    def learn(self, chunks: set[str | tuple[str]]) -> None:
        """Remember ``(count, ids as text, decoded)`` of new chunks."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update({(string,): (1, str(index), string) for string, index in self.special.items()})
        new = {chunk: self.words(chunk) for chunk in chunks if chunk not in self.known}
        words = list({word for found in new.values() for word in found})
        made = {}
        if words:
            ids, counts = self.merge_words(words)
            texts, tokens = [str(i) for i in ids.tolist()], [self.tokens[i] for i in ids.tolist()]
            at = 0
            for word, n in zip(words, counts.tolist()):
                made[word] = (n, " ".join(texts[at : at + n]), " ".join(tokens[at : at + n]))
                at += n
        for chunk, found in new.items():
            if len(found) == 1:
                self.known[chunk] = made[found[0]]
            else:
                n, ids, decoded = zip(*[made[word] for word in found])
                self.known[chunk] = (sum(n), " ".join(ids), " ".join(decoded))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string",
}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, outputs...)`` for each row; ``outputs`` are names of ``OUTPUTS``, digests as lowercase hex."""
    schema = "doc_id long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(part: pa.RecordBatch) -> dict:
        model = load(path)
        texts = [model.chunks(text or "") for text in part.column(1).to_pylist()]
        model.learn({chunk for chunks in texts for chunk in chunks})
        known = model.known
        columns: dict = {"doc_id": part.column(0)} | {name: [] for name in outputs}
        for chunks in texts:
            found = [known[chunk] for chunk in chunks]
            ids, decoded = " ".join([f[1] for f in found]), " ".join([f[2] for f in found])
            for name in outputs:
                columns[name].append(
                    sum([f[0] for f in found]) if name == "n_tokens"
                    else [int(i) for i in ids.split()] if name == "ids"
                    else decoded if name == "decoded"
                    else hashlib.sha256((ids if name == "ids_sha256" else decoded).encode("utf-8")).hexdigest()
                )
        return columns

    return map_slices(rows, run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of ids; null stays null."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = load(path)
        return ids.map(lambda row: None if row is None else model.decode(row))

    return rows.withColumn(out, text(ids_col))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trustframe.llm.common import read_table

    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), DIGESTS)
