"""Tokenizer files applied to whole texts, pre-token by pre-token.

A BPE tokenizer of the `tokenizers` library never merges across pre-tokens, so
the ids of a text are the ids of its pre-tokens one after the other. Texts made
of a plain set of characters are cut into pre-tokens many at a time, and each
distinct pre-token is encoded by the library once. Other texts are cut by the
library's own pre-tokenizer where pieces are wanted (split()); only texts that hold
one of the tokenizer's special strings go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import Memo, span_hashes

#: Classes of characters.
BREAK, LETTER, DIGIT, OTHER, SPACE, ODD = range(6)
#: The characters on whose class every library agrees; all others are ODD.
KIND = np.full(1 << 16, ODD, np.uint8)
for _first, _last, _class in (("!", "~", OTHER), ("0", "9", DIGIT), ("A", "Z", LETTER), ("a", "z", LETTER), ("À", "Ö", LETTER), ("Ø", "ö", LETTER), ("ø", "į", LETTER), ("Ĳ", "ň", LETTER), ("Ŋ", "ž", LETTER)):
    KIND[ord(_first) : ord(_last) + 1] = _class
for _char in "¡«»¿×÷–—‘’“”…€":
    KIND[ord(_char)] = OTHER
for _char in "\t\n\r ":
    KIND[ord(_char)] = SPACE
KIND[0] = BREAK  # stands between texts
#: Endings after an apostrophe that the published pattern keeps as pre-tokens.
ENDINGS = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))
MEMO = 500_000  # distinct pre-tokens that a worker remembers


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


@lru_cache(maxsize=4)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    """Ids of texts by the tokenizer file at path; one for each file and worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        kind = str(self.tok.pre_tokenizer)
        lowers = "Lowercase" in str(self.tok.normalizer)
        self.kind = "words" if lowers and "Split" in kind else "bytes" if self.tok.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") else None
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.count = Memo(np.int64, MEMO), 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 15, np.int64)

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of any text by the library's pre-tokenizer; None if the text holds a special string or the file's kind is not known."""
        if self.kind != "bytes" or "\0" in text or any(s in text for s in self.special):
            return None
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> bool:
        """Whether cut() cuts the text as the library would."""
        if self.kind is None or "\0" in text or any(s in text for s in ("<|", *self.special)):
            return False
        try:
            return not (KIND[np.frombuffer(text.encode("utf-16-le"), "<u2")] == ODD).any()
        except UnicodeEncodeError:
            return False

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All plain texts as one line, its pre-tokens' first and end characters, their hashes, and how many each text has."""
        line = "\0".join(texts) + "\0"
        if self.kind == "words":
            line = line.lower()  # keeps the length of plain texts
        c = np.frombuffer(line.encode("utf-16-le"), "<u2")
        k = KIND[c]
        start = np.empty(len(c), bool)
        start[0] = True
        np.not_equal(k[1:], k[:-1], out=start[1:])
        visible = (k >= LETTER) & (k <= OTHER)
        joined = np.zeros(len(c), bool)  # a blank that belongs to the pre-token after it
        if self.kind == "bytes":
            joined[:-1] = (c[:-1] == 0x20) & visible[1:]
            start[1:] &= ~joined[:-1]
            start[:-1] |= (k[:-1] == SPACE) & visible[1:]
        else:
            start |= k == DIGIT
        quote = np.flatnonzero((c == 0x27) & start)
        quote = quote[~joined[quote - 1] | (quote == 0)] if self.kind == "bytes" else quote
        tail = np.r_[c, np.zeros(3, c.dtype)]
        for ending in ENDINGS:
            q = quote
            for j, letter in enumerate(ending):
                q = q[tail[q + 1 + j] == ord(letter)]
            start[q + 1] = False
            after = q + 1 + len(ending)
            start[after[k[after] == LETTER]] = True
        edges = np.r_[np.flatnonzero(start), len(c)]
        starts, ends = edges[:-1], edges[1:]
        kept = k[starts] != BREAK if self.kind == "bytes" else visible[starts]
        starts, ends = starts[kept], ends[kept]
        sizes = np.diff(np.searchsorted(starts, np.r_[0, np.flatnonzero(c == 0)]))
        return line, starts, ends, span_hashes(c, starts, ends), sizes

    def piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """The model's ids of each pre-token of plain texts."""
        if not pieces:
            return []
        spelled = "\0".join(pieces).encode().decode("latin-1").translate(LETTERS).split(LETTERS[0])
        tokenize = self.tok.model.tokenize
        return [[t.id for t in tokenize(w)] for w in spelled]

    def learn(self, line: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encodes new pre-tokens of the line; returns their numbers."""
        got = self.piece_ids([line[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        n, k = self.count, len(got)
        if n + k + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), n + k + 1), np.int64)])
        self.at[n + 1 : n + k + 1] = self.at[n] + np.cumsum([len(x) for x in got])
        end = int(self.at[n + k])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.uint32)])
        self.flat[int(self.at[n]) : end] = list(chain.from_iterable(got))
        self.known.add(hashes, np.arange(n, n + k))
        self.count += k
        return np.arange(n, n + k)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The library's ids of each whole text (null: none), as uint32."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif self.plain(t):
                plain.append(i)
            else:
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        if plain:
            if self.known.full():
                self.forget()
            line, starts, ends, hashes, sizes = self.cut([texts[i] for i in plain])
            unique, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            slot, new = self.known.found(unique)
            if len(new):
                slot[new] = self.learn(line, starts[first[new]], ends[first[new]], unique[new])
            which = slot[where]
            begin = self.at[which]
            n_ids = self.at[which + 1] - begin
            stop = np.cumsum(n_ids)
            total = int(stop[-1]) if len(stop) else 0
            flat = self.flat[np.repeat(begin - (stop - n_ids), n_ids) + np.arange(total)]
            edges = np.r_[0, stop][np.r_[0, np.cumsum(sizes)]]
            for k, i in enumerate(plain):
                out[i] = flat[edges[k] : edges[k + 1]]
        return out
