"""Values of words that are computed once and found again by the words themselves.

Tokenizers whose pre-tokenizer never lets a token span ASCII white space give a text the tokens of its words one after
the other. Each distinct word is encoded by the library itself; words of later texts are found in a dictionary under
their own bytes, so that no two words are ever taken for one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable, Iterable
from itertools import chain

import numpy as np


class Memo:
    """Values of keys. ``learn`` gives the values (never None) of a list of new keys at once.

    About ``most`` keys are kept, in two generations: when the younger one is full the older one goes, and a key that is
    asked for again moves to the younger. Keys longer than ``longest`` are never kept. Neither bound changes a result.
    """

    def __init__(self, learn: Callable[[list], list], most: int = 1_000_000, longest: int = 48):
        self.learn, self.half, self.longest = learn, max(1, most // 2), longest
        self.young: dict = {}
        self.old: dict = {}

    def look(self, rows: Iterable[list[Hashable]]) -> list[list]:
        """The value of each key of each row. Rows are taken one by one and not kept."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        get = self.young.get
        out, holes = [], []
        for keys in rows:
            got = list(map(get, keys))
            if None in got:
                at = [i for i, v in enumerate(got) if v is None]
                unknown = [keys[i] for i in at]
                other = self.instead(keys, unknown)
                if other is not keys:
                    got = list(map(get, other))
                    at = [i for i, v in enumerate(got) if v is None]
                    unknown = [other[i] for i in at]
                holes.append((got, at, unknown))
            out.append(got)
        if holes:
            missing = dict.fromkeys(chain.from_iterable(unknown for *_, unknown in holes))
            here = {k: v for k in missing if (v := self.old.get(k)) is not None}
            new = [k for k in missing if k not in here]
            here.update(zip(new, self.learn(new)))
            for got, at, unknown in holes:
                for i, v in zip(at, map(here.__getitem__, unknown)):
                    got[i] = v
            self.young.update((k, here[k]) for k in self.kept(here))
        return out

    def kept(self, keys: Iterable) -> list:
        return [k for k in keys if len(k) <= self.longest]

    def instead(self, keys: list, unknown: list) -> list:
        """The keys to look for where ``unknown`` are not in the younger generation."""
        return keys


#: Symbols that may stand between words in one call of the library. One is used only where it is a token of its own and
#: no word has it; no other character normalises to it.
BETWEEN = "★●♥♪→"
#: Words that the library encodes as one text.
TOGETHER = 256


class Library:
    """The tokenizers library on single words: no special tokens added, special strings inside a text as is its default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.between, self.mark = None, -1
        for c in BETWEEN:
            ids = self.library.encode(f"a {c} b", add_special_tokens=False).ids
            around = [*self.ids("a"), *self.ids("b")]
            if len(ids) == len(around) + 1:
                self.between, self.mark = c, ids[len(self.ids("a"))]
                break

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def starts(self, text: str) -> tuple[list[int], np.ndarray]:
        """The ids of a text and the character at which each token begins."""
        got = self.library.encode(text, add_special_tokens=False)
        return got.ids, np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))

    def words(self, words: list[str], kind: str) -> list[bytes]:
        """The ids of each word, packed as the numpy type ``kind``; words have no ASCII white space."""
        out: list = []
        for lo in range(0, len(words), 64 * TOGETHER):
            groups = [words[at : at + TOGETHER] for at in range(lo, min(len(words), lo + 64 * TOGETHER), TOGETHER)]
            texts = [f" {self.between} ".join(g) for g in groups]
            for g, text, got in zip(groups, texts, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(got.ids, kind)
                at = np.flatnonzero(ids == self.mark)
                if not self.between or len(at) != len(g) - 1 or text.count(self.between) != len(at):  # a word has the symbol
                    out += [np.array(self.ids(w), kind).tobytes() for w in g]
                    continue
                packed, at = ids.tobytes(), at * ids.itemsize
                out += [packed[a:b] for a, b in zip([0, *(at + ids.itemsize).tolist()], [*at.tolist(), len(packed)])]
        return out


class WordIds:
    """The packed ids (little-endian, ``width`` bytes each) of whole texts in UTF-8."""

    def __init__(self, path: str, width: int = 4, most: int = 1_000_000):
        self.library, self.width = Library(path), width
        self.memo = Memo(self._learn, most)

    def _learn(self, words: list[bytes]) -> list[bytes]:
        return self.library.words([w.decode("utf-8", "replace") for w in words], "<u2" if self.width == 2 else "<u4")

    def packed(self, texts: list[bytes]) -> list[bytes]:
        return list(map(b"".join, self.memo.look(t.split() for t in texts)))


_WORDS: dict = {}


def word_ids(path: str, width: int = 4) -> WordIds:
    """One memo for each tokenizer in each Python worker."""
    if (path, width) not in _WORDS:
        _WORDS[path, width] = WordIds(path, width)
    return _WORDS[path, width]
