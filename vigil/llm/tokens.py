"""Encoding whole texts with a public tokenizer, each distinct chunk once.

A byte-pair tokenizer never merges across a blank or a line end that stands
between two non-blank characters, so a text is cut there and each distinct chunk
is encoded once while a worker remembers it; the text's ids are the chunks' ids
in order. Texts with any other white space at a cut (double blanks, blank lines,
leading or trailing blanks) go through the library whole when the tokenizer keeps
white space. Unseen words of ASCII letters, which the library's normaliser and pattern
leave whole, go to its model directly, many to a call. All ways give the ids of encoding
the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import is_
from string import ascii_letters, ascii_lowercase

import numpy as np

CACHE_CHUNKS = 250_000      # chunks a generation holds; two generations are kept
JOIN = 40                   # chunks given to the library as one string
WORDS = 400                 # words of ASCII letters given to the library's model as one string
UNSAFE = "unsafe"           # in place of the ids of a chunk that its neighbours can change
BATCH = 64                  # texts cut at once
APART = "\x00"              # before marks that end a word; texts that hold it go through the library whole
APART_MARKS = re.compile(r"[.,;:!?$%&#*](?<=[A-Za-z].)[.,;:!?$%&#*]*(?= |\Z)").sub
MARK = "\x7f"               # stands alone between chunks where blanks leave no trace in the ids


class ChunkCache:
    """Chunk -> encoding, in two generations: chunks seen again move to the newer one.

    ``fill(chunks)`` returns the encodings of unseen chunks (UNSAFE: not to be cut out of a text).
    """

    def __init__(self, fill: Callable[[list[str]], list], size: int = CACHE_CHUNKS):
        self.fill, self.size = fill, size
        self.new: dict = {}
        self.old: dict = {}

    def lookup(self, chunks: list[str]) -> list:
        """The encodings of the chunks, in their order."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, chunks))
        unseen = list(dict.fromkeys(compress(chunks, map(is_, found, repeat(None)))))
        if unseen:
            again = {c: old[c] for c in unseen if c in old}
            if again:
                unseen = [c for c in unseen if c not in again]
            again.update(zip(unseen, self.fill(unseen)))
            new.update(again)
            found = list(map(new.__getitem__, chunks))
        return found


class ChunkTokenizer:
    """``encode(texts)`` -> ids of every text as little-endian uint32 bytes.

    ``keeps_blanks``: the blank belongs to the word after it and line ends are tokens of their
    own (byte-level BPE); otherwise the tokenizer drops white space. ``added_tokens``: their
    strings in a text become their ids, as the library does by default; otherwise they are
    ordinary text.
    """

    def __init__(self, path: str, keeps_blanks: bool, cache_chunks: int = CACHE_CHUNKS, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark spreads the work
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added_tokens
        self.library.no_truncation()
        self.library.no_padding()
        # a text that may hold an added token goes through the library whole; "" is in every text
        self.added = {"" if a.normalized and self.library.normalizer else a.content
                      for a in self.library.get_added_tokens_decoder().values()} if added_tokens else ()
        self.keeps_blanks = keeps_blanks
        self.cache = ChunkCache(self._fill, cache_chunks)
        self.line_end = b""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        model = self.library.model
        self.lead, suffix = "", getattr(model, "end_of_word_suffix", None) or ""
        edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if keeps_blanks:
            self.blank = int(self._ids([" "])[0][0])
            self.lead = self.library.id_to_token(self.blank)[0]
            edge[[i for t, i in vocabulary.items() if t.startswith(self.lead)]] = True
            self.line_end = self._ids(["\n"])[0].tobytes()
        else:
            self.mark = self._ids([MARK])[0]
            if len(self.mark) != 1:
                raise ValueError("the chunk mark must be one token")
            edge[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.edge = edge            # ids that open a word (keeps_blanks) or end one
        # The library's own model without its normaliser and pattern, which leave a word of ASCII letters whole
        self.words = None
        letters = ascii_letters if keeps_blanks else ascii_lowercase
        if keeps_blanks and not suffix and all(t in vocabulary for t in (self.lead, *letters)) \
                or suffix and all(t in vocabulary for x in letters for t in (x, x + suffix)):
            self.words = Tokenizer(model)
            self.words.pre_tokenizer = WhitespaceSplit()

    def forget(self) -> None:
        """Empty the cache."""
        self.cache.new, self.cache.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        held = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not held:
            return self._by_chunks(texts)
        apart = set(held)
        out = self._by_chunks(["" if i in apart else t for i, t in enumerate(texts)])
        for i, ids in zip(held, self._ids([texts[i] for i in held])):
            out[i] = ids.tobytes()
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(texts), BATCH):
            out += self._cut(texts[a:a + BATCH])
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        split = [self._chunks(t) for t in texts]
        ids = self.cache.lookup(list(chain.from_iterable(split)))
        out, whole, at = [], [], 0
        for i, chunks in enumerate(split):
            own = ids[at:at + len(chunks)]
            at += len(chunks)
            try:
                out.append(b"".join(own)[len(self.line_end):])
            except TypeError:       # UNSAFE
                whole.append(i)
                out.append(b"")
        for i, own in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = own.tobytes()
        return out

    def _chunks(self, text: str) -> list[str]:
        """The text's chunks. Marks that end a word stand apart, behind APART.

        A mark behind an ASCII letter never shares a pre-token with it, and none of its letters
        and marks change in the normal form.
        """
        if APART in text:
            return [APART]
        if self.keeps_blanks:       # the first chunk of a line is led by its line end, the others by a blank
            text = ("\n" + text).replace("\n", " \n")
            return APART_MARKS(f" {APART}\\g<0>", text).split(" ")[1:]
        text = text.replace("\n", " ")
        if text.isascii():
            low = text.lower()      # as the library does, but behind its look for added tokens
            text = text if any(a in low for a in self.added) else low
        return APART_MARKS(f" {APART}\\g<0>", text).split(" ")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4")
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, chunks: list[str]) -> list[bytes | str]:
        found, words, first, heads, rest = {APART: UNSAFE}, [], [], [], []
        for c in chunks:
            if c.isascii() and c.isalpha() and self.words is not None and (self.keeps_blanks or c.islower()):
                words.append(c)
            elif c[:1] == "\n":
                (first if c.isascii() and c[1:].isalpha() and self.words is not None else heads).append(c)
            elif c[:1] != APART:
                rest.append(c)
            elif c != APART:
                found[c] = self._ids([c[1:]])[0].tobytes()
        self._of_words(words, found)
        self._of_first_words(first, found)
        found.update((c, x if x is UNSAFE else self.line_end + x) for c, x in zip(heads, self._alone([c[1:] for c in heads])))
        found.update(zip(rest, self._after_blanks(rest) if self.keeps_blanks else self._alone(rest)))
        return [found[c] for c in chunks]

    def _joined(self, words: list[str], between: str, before: str = "") -> Iterator[tuple[list[str], np.ndarray]]:
        """The ids that the model gives for words, many to a call."""
        parts = [words[a:a + WORDS] for a in range(0, len(words), WORDS)]
        joined = [before + between.join(part) for part in parts]
        for part, e in zip(parts, self.words.encode_batch_fast(joined, add_special_tokens=False) if joined else ()):
            yield part, np.array(e.ids, dtype="<u4")

    def _of_words(self, words: list[str], found: dict) -> None:
        """Words of ASCII letters (behind a blank, or in lower case)."""
        for part, ids in self._joined(words, f" {self.lead}", self.lead):
            cuts = np.flatnonzero(self.edge[ids])
            cuts = [*(4 * cuts).tolist(), 4 * len(ids)] if self.keeps_blanks else [0, *(4 * cuts + 4).tolist()]
            raw = ids.tobytes()
            found.update((w, raw[lo:hi]) for w, lo, hi in zip(part, cuts[:-1], cuts[1:], strict=True))

    def _of_first_words(self, chunks: list[str], found: dict) -> None:
        """Line ends with a word of ASCII letters behind them; a lone lead, which no such word holds, stands between words."""
        for part, ids in self._joined([c[1:] for c in chunks], f" {self.lead} "):
            cuts = (4 * np.flatnonzero(ids == self.blank)).tolist()
            raw = ids.tobytes()
            found.update(("\n" + w, self.line_end + raw[lo + 4:hi])
                         for w, lo, hi in zip(part, [-4, *cuts], [*cuts, len(raw)], strict=True))

    def _unsafe(self, chunk: str) -> bool:
        return self.keeps_blanks and (not chunk or chunk[0].isspace() or chunk[-1].isspace())

    def _after_blanks(self, chunks: list[str]) -> list[bytes | str]:
        found = {c: UNSAFE for c in chunks if self._unsafe(c)}
        safe = [c for c in chunks if c not in found]
        joined = [" " + " ".join(safe[a:a + JOIN]) for a in range(0, len(safe), JOIN)]
        for at, ids in zip(range(0, len(safe), JOIN), self._ids(joined)):
            cuts = [*np.flatnonzero(self.edge[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            for c, lo, hi in zip(safe[at:at + JOIN], cuts[:-1], cuts[1:], strict=True):
                found[c] = raw[4 * lo:4 * hi]
        return [found[c] for c in chunks]

    def _alone(self, chunks: list[str]) -> list[bytes | str]:
        found = {c: UNSAFE for c in chunks if self._unsafe(c)}
        if self.keeps_blanks:
            rest = [c for c in chunks if c not in found]
        else:
            plain = [c for c in chunks if MARK not in c]
            joined = [f" {MARK} ".join(plain[a:a + JOIN]) for a in range(0, len(plain), JOIN)]
            for at, ids in zip(range(0, len(plain), JOIN), self._ids(joined)):
                marks = np.flatnonzero(ids == self.mark[0]).tolist()
                raw = ids.tobytes()
                for c, lo, hi in zip(plain[at:at + JOIN], [-1, *marks], [*marks, len(ids)], strict=True):
                    found[c] = raw[4 * lo + 4:4 * hi]
            rest = [c for c in chunks if c not in found]
        found.update((c, ids.tobytes()) for c, ids in zip(rest, self._ids(rest)))
        return [found[c] for c in chunks]


@lru_cache(maxsize=4)
def chunk_tokenizer(path: str, keeps_blanks: bool, added_tokens: bool = False,
                    cache_chunks: int = CACHE_CHUNKS) -> ChunkTokenizer:
    """One tokenizer, and so one cache, per Python worker."""
    return ChunkTokenizer(path, keeps_blanks, cache_chunks, added_tokens)
