"""Token ids of whole texts, by the tokenizers library, inside tasks.

A byte-level BPE never merges across a boundary between a character and the white space after it, so a text
is cut there into chunks (a word with the one space before it, or a run of white space), the library's BPE model
encodes each distinct chunk, and a bounded cache of the Python worker keeps its ids.  The ids are those of the whole
text; a text with an added token in it, or a tokenizer of another kind, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

BYTE_BPE = "byte_bpe_50k.json"
CACHE_ENTRIES = 600_000  # distinct chunks a worker remembers, about 120 MB; only a cache, results do not depend on it
KEPT_ENTRIES = 150_000   # of them, the first, stay from task to task: frequent ones come early
STEP_CHARS = 1 << 20     # a long text is cut into chunks about so many characters at a time
SLICE_BYTES = 8 << 20    # texts whose words are encoded together

# White space in the sense of Unicode, which is also that of the tokenizer's own pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Fixed values of the byte-level scheme: how it splits a word, and the characters its vocabulary writes bytes with.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE_CHAR = chr(_BYTE_CHARS[0x20])
_LATIN_BYTES = {c: "".join(chr(_BYTE_CHARS.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}
_LATIN = "\u024f"  # beyond it, the library also splits the words, as Unicode versions may differ
_BREAK = re.compile(f"(?<=[^{_SPACE}]) ")


def tokenizer_file(name: str) -> str:
    """A path as it is; the name of a public tokenizer as its place on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def steps(text: str) -> Iterator[str]:
    """The text in pieces of about STEP_CHARS characters, cut only before a space that follows a word."""
    at = 0
    while len(text) - at > STEP_CHARS:
        cut = _BREAK.search(text, at + STEP_CHARS)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Chunks(dict):
    """The ids of chunks, as bytes; a chunk it does not have is encoded when asked for."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.tokenize = tok, tok.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isascii() and word.isalpha():
            ids = array("I", [t.id for t in self.tokenize(chunk if word is chunk else _SPACE_CHAR + word)]).tobytes()
        elif not word or word[0].isspace() or max(word) > _LATIN:
            ids = self.whole(chunk)
        else:
            parts = [chunk] if word.isalpha() else _PARTS.findall(chunk)
            ids = array("I", [t.id for p in parts for t in self.tokenize(p.translate(_LATIN_BYTES))]).tobytes()
        self[chunk] = ids
        return ids

    def trim(self) -> None:
        """Gives memory back at the end of a task."""
        if len(self) > KEPT_ENTRIES:
            kept = list(islice(self.items(), KEPT_ENTRIES))
            self.clear()
            self.update(kept)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of texts, unsigned 32-bit; null counts as empty."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file(tokenizer))
        parts = json.loads(tok.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.by_chunk = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
                         and not parts["normalizer"])
        self.added_are_marked = not any(t.isalpha() for t in self.added)
        self.chunks = _Chunks(tok)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.by_chunk or any(t in text for t in self.added):
            return np.frombuffer(self.chunks.whole(text), "<u4")
        return np.frombuffer(b"".join(b"".join(map(self.chunks.__getitem__, _CHUNK.findall(s))) for s in steps(text)), "<u4")

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, about SLICE_BYTES of texts at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        at, total = 0, np.append(0, np.cumsum(sizes))
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, side="right")) - 1)
            if not self.by_chunk or sizes[at] > SLICE_BYTES:
                yield from (self.encode(t.as_py()) for t in texts[at:end])
            else:
                yield from self._slice(texts[at:end])
            at = end

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Splits at spaces, encodes each distinct word once, and puts the ids of the words in a row."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        # White space at a word's end joins the next space: such texts, and those with added tokens, go the plain way.
        found, odd, chunks = [], np.zeros(len(distinct), bool), self.chunks
        for k, w in enumerate(distinct):
            if w.isalpha() and self.added_are_marked:
                found.append(chunks[" " + w])
            elif not w or w[0].isspace() or odd_end(w, self.added):
                odd[k] = True
                found.append(b"")
            else:
                found.append(self._word(" " + w))
        firsts = [distinct[c] for c in codes[offsets[:-1]]]
        codes[offsets[:-1]] = len(distinct) + np.arange(len(firsts))
        plain = np.append(odd, np.zeros(len(firsts), bool))[codes]
        plain = (np.add.reduceat(plain, offsets[:-1]) > 0) | np.fromiter((not w or odd_end(w, self.added) for w in firsts), bool, len(firsts))
        found += [b"" if p else self._word(w) for w, p in zip(firsts, plain)]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(lengths) - lengths
        taken = lengths[codes]
        ends = np.cumsum(taken)
        row = ids[np.repeat(begins[codes] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.append(0, ends)[offsets]
        for k in range(len(firsts)):
            yield self.encode(texts[k].as_py()) if plain[k] else row[stops[k]:stops[k + 1]]

    def _word(self, word: str) -> bytes:
        """A word and the space before it.  The pattern never joins letters with what is no letter, so a mark after the
        last letter, and lines within the word, are encoded for themselves."""
        if len(word.split()) > 1:
            parts = word.split("\n")
            if len(parts) > 1 and all(len(p.split()) == 1 and not p[-1].isspace() for p in parts) and not any(p[0].isspace() for p in parts[1:]):
                return self.chunks["\n"].join(map(self._word, parts))
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(word)))
        if word[-1] in ".,!" and word[-2:-1].isalpha():
            return self.chunks[word[:-1]] + self.chunks[word[-1]]
        return self.chunks[word]


def odd_end(word: str, added: list[str]) -> bool:
    return word[-1].isspace() or any(t in word for t in added)


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The Python worker's encoder for this tokenizer, kept from task to task."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]
