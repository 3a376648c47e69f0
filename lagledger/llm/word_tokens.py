"""Token ids of whole texts with a word-end BPE tokenizer, each distinct word encoded once per Python worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

from lagledger.llm.common import cached

MOST_WORDS = 600_000  # cached per worker; a full cache is emptied, results stay the same
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(r"[ \t\n\r\x0b\x0c]+")


class WordTokens:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False)``, then ``end_id``.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words one
    after the other. A word of Latin-1 characters is cut by the tokenizer's own word pattern and each piece is encoded
    once; any other word, and one that may hold a special token, is encoded as it is.
    """

    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        import json

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.word_end = spec["model"]["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.word_end)]] = True
        special = {regex.escape(t["content"][:2]) for t in spec["added_tokens"]}
        self.odd = regex.compile("|".join(["[^\x00-\xff]", *sorted(special)]))
        self.tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        words = [_SPLIT.split(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        wanted = set().union(*words)
        new = {w for w in wanted if w not in self.words}
        if len(self.words) + len(new) > MOST_WORDS:
            self.words.clear()
            new = wanted
        self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, w)) + self.tail for w in words]

    def _learn(self, words: set[str]) -> None:
        cut, whole = {}, []
        odd, findall = self.odd.search, self.pattern.findall
        for w in words:
            if odd(w):
                whole.append(w)
            elif w.isalpha():  # one piece
                cut[w] = (w.lower(),)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                cut[w] = (w[:-1].lower(), w[-1])
            else:
                cut[w] = findall(w.lower())
        new = {p for ps in cut.values() for p in ps if p not in self.pieces}
        if len(self.pieces) + len(new) > MOST_WORDS:
            self.pieces.clear()
            new = {p for ps in cut.values() for p in ps}
        self._learn_pieces(list(new))
        get = self.pieces.__getitem__
        for w, ps in cut.items():
            self.words[w] = b"".join(map(get, ps))
        for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Many pieces per call, with spaces between; a piece's ids end with the one id that has the word-end mark."""
        groups = [pieces[i : i + 200] for i in range(0, len(pieces), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group):
                raw, at = ids.tobytes(), 0
                for p, to in zip(group, (last * 4).tolist(), strict=True):
                    self.pieces[p] = raw[at:to]
                    at = to
            else:  # a piece that ends otherwise: one call each
                for p, one in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                    self.pieces[p] = np.array(one.ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokens(path: str, end_id: int | None) -> WordTokens:
    """One per worker process."""
    return WordTokens(path, end_id)


cached("tokens", word_tokens.cache_clear)
