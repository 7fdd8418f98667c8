"""Encoders against the public libraries, over tables and odd texts."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
import sentencepiece
from llm_tables import no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer

from trustframe.llm import bpe, token_counts
from trustframe.llm.common import read_table

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def odd_texts(n: int = 1500) -> list[str]:
    rng = random.Random(4)
    parts = ["the", "ing", " ", "  ", "'s", "Σ", "é", "12", "!!", "\n", "ation", "<|endoftext|>", "▁", "\x1c", "\x00", "é"]
    texts = ["", " ", "a" * 300, "the" * 500, " " * 50 + "a", "<s></s><unk>", "İ ΑΣ", "a<|startoftext|>b"]
    for _ in range(n):
        spare = [chr(rng.randrange(32, 0x3000)), chr(rng.choice([rng.randrange(0x4E00, 0x9000), rng.randrange(0x10000, 0x34000)]))]
        texts.append("".join(rng.choice(parts + spare) for _ in range(rng.randrange(1, 25))))
    return texts


def test_word_bpe_equals_the_library_on_odd_texts():
    library, model = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    for text, want in zip(odd_texts(), library.encode_batch(odd_texts(), add_special_tokens=False)):
        chunks = model.chunks(text)
        model.learn(set(chunks))
        found = [model.known[c] for c in chunks]
        ids = [int(i) for f in found for i in f[1].split()]
        assert ids == want.ids, repr(text)
        assert " ".join(f[2] for f in found) == library.decode(want.ids, skip_special_tokens=False) == model.decode(ids)


def test_word_bpe_knows_the_code_points_of_the_library():
    library, model = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    ranges = [range(0x580, 0x590), range(0xA7C0, 0xA7F8), range(0x10D40, 0x10D90), range(0x16EA0, 0x16EE0), range(0x323A0, 0x323C0)]
    texts = [f"a{chr(c)}1{chr(c)}" for part in ranges for c in part]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        chunks = model.chunks(text)
        model.learn(set(chunks))
        assert [int(i) for c in chunks for i in model.known[c][1].split()] == want.ids, hex(ord(text[1]))


def test_only_the_exact_special_string_is_special():
    library, model = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> a", "a <|STARTOFTEXT|> b <|startoftext|> <|endoftext|>", "<|ENDOFTEXT|><|endoftext|>"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        chunks = model.chunks(text)
        model.learn(set(chunks))
        assert [int(i) for c in chunks for i in model.known[c][1].split()] == want.ids, text
        assert " ".join(model.known[c][2] for c in chunks) == library.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("source", ["odd", "sf"])
def test_encoded_documents_round_trip(spark, source):
    docs = odd_documents(spark) if source == "odd" else read_table(spark, SF, "documents")
    library = Tokenizer.from_file(WORDS)
    rows = odd_rows() if source == "odd" else [tuple(r) for r in docs.collect()]
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), text)]
        want.append((str(row[0]), len(ids), *sha, ids, text))
    found = bpe.encode(docs, WORDS, (*bpe.DIGESTS, "ids", "decoded"))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in found.collect()]
    assert sorted(got) == sorted(want)
    again = bpe.decode(found.select("decoded", "ids"), WORDS, out="again").collect()
    assert all(r.again == r.decoded for r in again)


def test_prefix_counts_equal_the_library_at_every_prefix():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PrefixCounter(PIECES)
    texts = odd_texts()
    split = [model.split(text) for text in texts]
    model.learn({word for words in split for word in words})
    assert [model.count(words) for words in split] == [len(ids) for ids in library.encode(texts)]
    for text, words in list(zip(texts, split))[:150]:
        counts = [len(ids) for ids in library.encode([text[:n] for n in range(len(text) + 1)])]
        for limit in (0, 1, 3, 8):
            want = max(n for n, c in enumerate(counts) if c <= limit)
            assert (len(text) if counts[-1] <= limit else model.fit(words, limit)) == want, (text, limit)


def test_token_counts_of_odd_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.count_tokens(odd_documents(spark), PIECES, limit=20)
    want = []
    for row in odd_rows():
        text = row[1] or ""
        n = len(library.encode(text))
        want.append((str(row[0]), len(text.encode()), n, n > 20))
    assert sorted((str(r[0]), *r[1:4]) for r in found.collect()) == sorted(want)


def test_other_files_are_refused_and_empty_tables_stay_empty(spark):
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encode(no_documents(spark), WORDS, bpe.DIGESTS).count() == 0
    assert token_counts.count_tokens(no_documents(spark), PIECES).count() == 0


def test_marks_newer_than_the_library_are_neither_ordered_nor_composed():
    library, model = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    texts = [f"a\u0345{m}\u0334e{m}\u0323\u0301{m}x" for m in marks] + ["\u0f37\U0001e2ef"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        chunks = model.chunks(text)
        model.learn(set(chunks))
        assert [int(i) for c in chunks for i in model.known[c][1].split()] == want.ids, hex(ord(text[2]))
