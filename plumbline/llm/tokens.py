"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words.

The tokenizer file used here drops white space and splits a text into words
before its merges, so the ids of a text are the ids of its words in order. Most
words of a corpus repeat, hence each distinct word is tokenized once a task.
Texts with characters outside the Latin blocks, control characters or the
tokenizer's own marks take the library's path whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Entries of a cache generation; the generation before is kept until the next is full.
CACHED_WORDS = 180_000
#: Unseen pieces tokenized in one call.
TOGETHER = 1_000
#: Characters for which lower-casing and word splitting need no more than the patterns below.
_PLAIN = re.compile("[^\t\n\r -~ -įı-ɏ]")
_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        # the last id of a piece carries the end-of-word mark
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tokenize(self, unseen: list[str]) -> None:
        """Ids of pieces, spaced in one text and cut apart at the end-of-word marks."""
        for at in range(0, len(unseen), TOGETHER):
            part = unseen[at : at + TOGETHER]
            found = self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.words.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                self.words.update((p, self.whole(p)) for p in part)

    def _learn(self, missing: set[str]) -> None:
        """Cache the ids of words; a word of letters is one piece, others are put together from theirs."""
        old, words = self.old_words, self.words
        whole, split = [], []
        for w in missing:
            if w in old:
                words[w] = old[w]
            elif w.isalpha():
                whole.append(w)
            else:
                split.append(w)
        parts = [_PIECES.findall(w) for w in split]
        pieces = set(chain.from_iterable(parts)).difference(words, whole)
        known = pieces.intersection(old)
        words.update((p, old[p]) for p in known)
        self._tokenize([*whole, *pieces.difference(known)])
        of = words.__getitem__
        words.update((w, b"".join(map(of, p))) for w, p in zip(split, parts, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object for each text; the texts should be a few MB at most."""
        plain = [None if _PLAIN.search(t) or "<|" in t else t.lower().split() for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words, self.old_words = {}, self.words
        missing = set().union(*(p for p in plain if p)).difference(self.words)
        if missing:
            self._learn(missing)
        of = self.words.__getitem__
        return [self.whole(t) if p is None else b"".join(map(of, p)) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a Python worker, which keeps its words from task to task."""
    return WordTokenizer(path)


def in_portions(texts, limit: int = 2_000_000):
    """Lists of consecutive texts (null as empty) of about ``limit`` characters."""
    portion, held = [], 0
    for text in texts:
        portion.append(text or "")
        held += len(portion[-1])
        if held >= limit:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion
