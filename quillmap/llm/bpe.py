"""BPE encoding and decoding by one dynamic program over prefixes.

Every prefix of a word has exactly one token that can end its encoding. For each prefix, an automaton over the
vocabulary lists the tokens that are suffixes of it; a token is the prefix's last one if the rest is empty or if it is
compatible with the last token of the rest. The back-pointers then give the ids. Two neighbouring tokens are
compatible if no merge joins the symbols that stand at their border at any moment while both are being built.

The program runs over many words side by side: one step takes the next symbol of every word, as array operations.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_in_batches

#: Remembered words; all are forgotten when there are more.
WORDS = 1_000_000
#: Remembered answers of the pair test; all are forgotten when there are more.
FITS = 1_000_000
#: Texts and characters that are encoded side by side.
TOGETHER, TOGETHER_CHARS = 256, 1 << 19
_NEVER = 1 << 60
#: Stands before the first symbol of a word where a token would stand.
_START = 0xFFFF
#: Classes of characters for the split into words.
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Two bases of polynomial word hashes: odd, so that they have inverses.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


@functools.cache
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point by the library's own tables, and which ones Python's tables do not know."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join([chr(c) if not 0xD800 <= c < 0xE000 else "a" for c in range(0x110000)])
    classes = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            classes[start:end] = kind
    classes[0xD800:0xE000] = OTHER
    return classes, np.array([unicodedata.category(c) == "Cn" for c in every])


class Lookup:
    """A hash table from whole numbers to small ones that is asked and filled by arrays; absent keys give -1."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def holds(self, more: int) -> bool:
        """Whether there is room for more keys."""
        return self.n + more <= 0.7 * len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        at, todo = self._slot(keys), np.arange(len(keys))
        self.n += len(keys)
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            # Of keys that want one slot, the one written last has it.
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)


class Growing:
    """An array that is filled bit by bit."""

    def __init__(self, dtype):
        self.n, self.values = 0, np.empty(1024, dtype)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.empty(self.n + len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The first n powers of each base, and of its inverse, modulo 2**64."""

    def up(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return [up(b) for b in _BASES], [up(pow(b, -1, 1 << 64)) for b in _BASES]


class SuffixAutomaton:
    """For every prefix of a word, the tokens that are suffixes of it, longest first.

    States are the prefixes of tokens; `first` names the longest token that ends in a state, `shorter` the next one.
    """

    def __init__(self, tokens: np.ndarray, symbols: list[np.ndarray]):
        lengths = np.array([len(x) for x in symbols])
        cells = np.full((len(symbols), lengths.max()), -1, np.int64)
        cells[np.arange(cells.shape[1]) < lengths[:, None]] = np.concatenate(symbols)
        self.next = Lookup(int(lengths.sum() * 2).bit_length())
        at = np.zeros(len(symbols), np.int64)
        token, depth, fail, first, shorter = ([np.array([-1])], [np.zeros(1, np.int64)], np.zeros(1, np.int64), np.array([-1]), np.array([-1]))
        n = 1
        for d in range(cells.shape[1]):
            here = np.flatnonzero(lengths > d)
            keys, which = np.unique(at[here] << 10 | cells[here, d], return_inverse=True)
            new = np.arange(n, n + len(keys))
            at[here] = new[which]
            own = np.full(len(keys), -1)
            ends = lengths[here] == d + 1
            own[which[ends]] = tokens[here[ends]]
            self.fail = fail
            back = self.follow(fail[keys >> 10], keys & 1023) if d else np.zeros(len(keys), np.int64)
            self.next.put(keys, new.astype(np.int32))
            fail = np.concatenate([fail, back])
            first = np.concatenate([first, np.where(own >= 0, new, first[back])])
            shorter = np.concatenate([shorter, first[back]])
            token.append(own)
            depth.append(np.full(len(keys), d + 1))
            n += len(keys)
        self.fail, self.first, self.shorter, self.token, self.depth = fail, first, shorter, np.concatenate(token), np.concatenate(depth)

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        states = states.copy()
        out = self.next.get(states << 10 | symbols).astype(np.int64)
        todo = np.flatnonzero(out < 0)
        while len(todo):
            out[todo[states[todo] == 0]] = 0
            todo = todo[states[todo] > 0]
            states[todo] = self.fail[states[todo]]
            out[todo] = self.next.get(states[todo] << 10 | symbols[todo])
            todo = todo[out[todo] < 0]
        return out


class PrefixBpe:
    """Encoder and decoder for a `tokenizers` file whose model is BPE over bytes with an end-of-word suffix."""

    def __init__(self, path: str, memory: int = 1):
        """memory: how many times WORDS are remembered, at about 80 MB a time."""
        self.path, self.memory = path, memory
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.merges = {}
        self.parts = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            a, b, ab = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[a << 16 | b] = rank
            self.parts[ab] = (a, b, rank)
        self.right, self.left = {}, {}
        self.fits = Lookup(FITS.bit_length())
        whole = [i for i in self.vocab.values() if self.is_whole(i)]
        of_char = {c: b for b, c in byte_alphabet().items()}
        self.automaton = SuffixAutomaton(np.array(whole), [self._symbols(self.texts[i], of_char) for i in whole])
        self.salt = 0
        self._forget_words()

    def _symbols(self, token: str, of_char: dict[str, int]) -> np.ndarray:
        """A token's bytes, the last one raised by 256 if it ends a word."""
        ends = bool(self.suffix) and token.endswith(self.suffix)
        out = np.array([of_char[c] for c in (token[: -len(self.suffix)] if ends else token)])
        out[-1] += 256 * ends
        return out

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at a token's edge while it is built, each with the rank of the merge that takes it up."""
        known = self.right if side else self.left
        if token not in known:
            chain, up, at = [], _NEVER, token
            while True:
                # A right edge's symbol is shifted, so that it and a left one make the key of their merge.
                chain.append((at << 16 if side else at, up))
                if at not in self.parts:
                    break
                up, at = self.parts[at][2], self.parts[at][side]
            known[token] = chain
        return known[token]

    def _joined(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of rank under `before` joins a's right edge to b's left edge."""
        get, left = self.merges.get, self._edge(b, 0)
        for r, taken_r in self._edge(a, 1):
            for s, taken_s in left:
                rank = get(r | s)
                # Of two equal merges that overlap, the one further left comes first.
                if rank is not None and rank < before and rank < taken_r and rank <= taken_s:
                    return True
        return False

    def is_whole(self, token: int) -> bool:
        """Whether a token's own text encodes to the token: no other merge crosses the border of its parts first."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return not self._joined(a, b, rank)

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair (a << 16 | b) can be neighbours; everything can stand at the start of a word."""
        fit = self.fits.get(pairs)
        unknown = np.unique(pairs[fit < 0])
        if len(unknown):
            if not self.fits.holds(len(unknown)):
                self.fits = Lookup(FITS.bit_length())
            answers = np.array([a == _START or not self._joined(a, b, _NEVER) for a, b in zip((unknown >> 16).tolist(), (unknown & 0xFFFF).tolist(), strict=True)])
            if self.fits.holds(len(unknown)):
                self.fits.put(unknown, answers.astype(np.int32))
            new = np.flatnonzero(fit < 0)
            fit[new] = answers[np.searchsorted(unknown, pairs[new])]
        return fit > 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after the other, and how many each has."""
        raw = np.frombuffer(("\n" + "\n".join(words)).encode("utf-8"), np.uint8).astype(np.int64)
        # The line break before a word takes the place of its empty prefix.
        begin = np.flatnonzero(raw == 10)
        length = np.diff(begin, append=len(raw)) - 1
        raw[begin + length] += 256 * bool(self.suffix)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        last, back = np.full(len(raw), _START), np.zeros(len(raw), np.int64)
        auto, state = self.automaton, np.zeros(len(words), np.int64)
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right").tolist()
        for step, n in enumerate(active, 1):
            at = begin[:n] + step
            state = auto.follow(state[:n], raw[at])
            node = auto.first[state]
            while len(at):
                token, reach = auto.token[node], auto.depth[node]
                good = self.compatible(last[at - reach] << 16 | token)
                won = at[good]
                last[won], back[won] = token[good], reach[good]
                at, node = at[~good], auto.shorter[node[~good]]
        ends, owner, rounds = begin + length, np.arange(len(words)), []
        while len(ends):
            rounds.append((owner, last[ends]))
            ends = ends - back[ends]
            more = last[ends] != _START
            ends, owner = ends[more], owner[more]
        # The k-th round from a word's end holds its k-th last token.
        count = np.bincount(np.concatenate([o for o, _ in rounds]), minlength=len(words))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        count = count[place]
        close = np.cumsum(count)[order]
        ids = np.empty(count.sum(), "<u4")
        for k, (o, tokens) in enumerate(rounds, 1):
            ids[close[o] - k] = tokens
        return ids, count

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def _lowered(self, text: str) -> str:
        """A text in the form that the vocabulary knows; characters newer than Python's tables are looked up in the library's."""
        if text.isascii():
            return text.lower()
        if character_classes()[1][np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.library.normalizer.normalize_str(text)
        # Every character is lower-cased by itself, so the final sigma has no form of its own.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _forget_words(self) -> None:
        self.words = Lookup((WORDS * self.memory).bit_length())
        self.word_check, self.word_ids, self.word_size, self.word_end = Growing(np.uint64), Growing("<u4"), Growing(np.int32), Growing(np.int64)

    def _word_numbers(self, text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word codes[start:end], by two hashes of 63 and 64 bits; new words are encoded and remembered."""
        power, inverse = _powers(1 << max(len(codes), TOGETHER_CHARS).bit_length())
        hashes = []
        with np.errstate(over="ignore"):
            x = (codes + np.uint64(1 + (self.salt << 32))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            for k in range(2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[k][: len(x)])])
                h = (total[end] - total[start]) * inverse[k][start]
                hashes.append(h ^ (h >> np.uint64(29)))
        keys, check = (hashes[0] >> np.uint64(1)).astype(np.int64), hashes[1]
        number = self.words.get(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            if not self.words.holds(len(new)):
                self._forget_words()
                new, number = np.arange(len(keys)), np.zeros(len(keys), np.int32)
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            ids, size = self.encode_words([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            if not self.words.holds(len(fresh)):
                self.words = Lookup(len(fresh).bit_length() + 1)
            self.words.put(fresh, (self.word_size.n + np.arange(len(fresh))).astype(np.int32))
            self.word_end.add(self.word_ids.n + np.cumsum(size))
            for kept, more in ((self.word_check, check[at]), (self.word_ids, ids), (self.word_size, size)):
                kept.add(more)
            number[new] = self.words.get(keys[new])
        if (self.word_check.values[number] != check).any():
            # Two words share a key: all keys are dealt anew.
            self.salt += 1
            self._forget_words()
            return self._word_numbers(text, codes, start, end)
        return number

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens as bytes."""
        lowered = [self._lowered(t) for t in texts]
        text = "\n".join(["", *lowered, "", ""])
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = character_classes()[0][codes]
        begins = (kind != SPACE) & ((kind != np.roll(kind, 1)) | (kind == DIGIT))
        # 's 't 'm 'd 're 've 'll are words of their own where the apostrophe stands alone.
        quote = np.flatnonzero((codes == ord("'")) & begins)
        quote = quote[kind[quote + 1] == LETTER]
        one, two = codes[quote + 1], codes[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        begins[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        begins[after] |= kind[after] == LETTER
        start = np.flatnonzero(begins)
        if not len(start):
            return [b""] * len(texts)
        # A word ends before the next one or before white space, whichever comes first.
        ends = np.flatnonzero(begins | ((kind == SPACE) & (np.roll(kind, 1) != SPACE)))
        end = ends[np.searchsorted(ends, start, side="right")]
        number = self._word_numbers(text, codes.astype(np.uint64), start, end)
        size = self.word_size.values[number]
        close = np.cumsum(size, dtype=np.int64)
        flat = self.word_ids.values[np.repeat(self.word_end.values[number] - close, size) + np.arange(close[-1])].tobytes()
        bounds = np.cumsum([1, *[len(t) + 1 for t in lowered]])
        at = (4 * np.concatenate([[0], close])[np.searchsorted(start, bounds)]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        parts = [self.split_special.split(t) if "<|" in t else [t] for t in texts]
        plain = iter(self._encode_plain([p for split in parts for p in split[::2]]))
        special = lambda p: np.array([self.special[p]], "<u4").tobytes()
        return [b"".join([special(p) if k % 2 else next(plain) for k, p in enumerate(split)]) for split in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join(filter(None, map(self.texts.get, ids)))


_loaded: dict[tuple[str, int], PrefixBpe] = {}


def codec(path: str, memory: int = 1) -> PrefixBpe:
    """The codec of a file, built once in each process."""
    if (path, memory) not in _loaded:
        _loaded.clear()
        _loaded[path, memory] = PrefixBpe(path, memory)
    return _loaded[path, memory]


def texts_of(batch: pa.RecordBatch, column: str, rows: int = 64, chars: int = TOGETHER_CHARS) -> Iterator[list[str | None]]:
    """A column's texts in order, up to `rows` at a time and no more after `chars` characters, so that long texts are never all copied at once."""
    values = batch.column(column)
    for at in range(0, len(values), rows):
        part, size = [], 0
        for value in values.slice(at, rows):
            part.append(value.as_py())
            size += len(part[-1] or "")
            if size >= chars:
                yield part
                part, size = [], 0
        if part:
            yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memory: int = 1) -> DataFrame:
    """Encode and decode every whole text.

    Returns, per row: id_col, n_tokens, ids (array of int, if with_ids), ids_sha256 over the ids as little-endian
    unsigned 32-bit integers, decoded_sha256 over the decoded text in UTF-8. Null and empty texts give no tokens and
    an empty decoded text; a null id stays null; repeated rows stay repeated; other columns are not looked at. No
    shuffle: one pass, up to TOGETHER rows at a time, so a task holds one Arrow batch and the bounded memories of the codec.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    ids_type = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, memory)
        for batch in batches:
            counts, shas, decoded, all_ids = [], [], [], []
            for texts in texts_of(batch, "text", TOGETHER):
                for raw in bpe.encode_all([t or "" for t in texts]):
                    ids = np.frombuffer(raw, "<u4")
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids.tolist()).encode("utf-8")).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    out = texts_in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint{ids_type}, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
