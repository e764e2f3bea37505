import hashlib
import random
import struct

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from quillmap.llm import bpe  # noqa: E402
from quillmap.llm.catalog import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.PrefixBpe(tokenizer_path())


HARD = ["", " ", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "it's we'll don't 's'", "<|endoftext|", "ΑΣ ΑΣ.", "x" * 3000, "aaaa" * 500, "̈ ̈a", "a\x1cb\x1fc\x85d\xa0e", "İstanbul ẞ ŉ ǅ", "日本語 12345 ²½", "\x00\x01", "é 가"]


def test_hard_texts_equal_the_library(library, codec):
    for text in HARD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(library, codec):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyztheinER ''sßÀàéñ日1290!?.,<|>|\t\n😀̀ͅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text, enc in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(text) == enc.ids, text


def test_every_code_point_equals_the_library(library, codec):
    points = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}b{chr(c)}" for c in points[at : at + 4096])
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_contractions_equal_the_library(library, codec):
    for text in ["'s", "''s", "a's's", "they'rest", "'ll'll", "'LLama", "x'd've'm", "!'t", "'", "1's", "é'vé", "' s", "'\ns"]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_does_not_change_results(codec, monkeypatch):
    small = bpe.PrefixBpe(tokenizer_path())
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "FITS", 3)
    small._forget_words()
    texts = ["the cat, the dog; an ox", "an ox the cat", "dog the the ox cat and 12 more words", "", "ox"] * 3
    assert [small.encode(t) for t in texts] == [codec.encode(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(texts)] == [codec.encode(t) for t in texts]


def test_words_with_one_key_are_told_apart(codec, monkeypatch):
    clash = bpe.PrefixBpe(tokenizer_path())
    asked, get = [], bpe.Lookup.get

    def equal_at_first(self, keys):
        if self is clash.words and clash.salt == 0:
            asked.append(1)
            return np.zeros(len(keys), np.int32)
        return get(self, keys)

    clash.encode("alpha")
    monkeypatch.setattr(bpe.Lookup, "get", equal_at_first)
    assert clash.encode("beta gamma") == codec.encode("beta gamma")
    assert asked and clash.salt == 1


def test_tokens_that_are_kept_encode_to_themselves(codec):
    for token in [t for t in codec.vocab.values() if codec.is_whole(t) and codec.texts[t].endswith("</w>") and codec.texts[t][:-4].islower() and codec.texts[t][:-4].isalpha() and codec.texts[t].isascii()][::50]:
        assert codec.encode(codec.texts[token][:-4]) == [token]


def test_encode_frame(spark, library):
    rows = [(k, t, "x", "y") for k, t in enumerate(HARD)] + [(100, None, "x", "y"), (None, "null id", "x", "y"), (0, "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    got = bpe.encode(df, tokenizer_path()).collect()
    assert len(got) == len(rows)
    for (doc, text, *_), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, next((t for d, t, *_ in rows if d == r.doc_id), None)))), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (doc, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0
