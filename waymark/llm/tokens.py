"""Token ids of whole texts with a public tokenizer file, with a cache of words in each Python worker, bounded in bytes."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Bytes that a worker's cache takes at most, and what a word takes beside its characters and ids; further words are tokenised each time.
CACHE_BYTES, ENTRY_BYTES = 84 << 20, 190
#: Slots, less one, in which it notes that a word has come.
_MET = (1 << 23) - 1
#: Texts in which white space surely separates tokens and lower case is simple: plain and accented Latin.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Where the file's normaliser lowers case and its words never span white space, plain texts are looked up piece by
    piece; all others go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and not spec["model"].get("ignore_merges")
        self.special = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        end = spec["model"].get("end_of_word_suffix")
        self.by_word = self.by_word and bool(end)
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = bool(end) and token.endswith(end)
        self.met = bytearray(_MET + 1)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: many are encoded as one text and cut where an id ends a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(ends) == len(part):
                b, ends = ids.tobytes(), ends.tolist()
                out += [b[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            else:
                out += self._ids(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        other = []
        for i, t in enumerate(texts):
            if self.by_word and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                split.append((i, t.lower().split()))
            else:
                other.append(i)
        for i, b in zip(other, self._ids([texts[i] for i in other]), strict=True):
            out[i] = b
        known = self.cache
        fresh = self._fresh({w for w in set().union(*(words for _, words in split)) if w not in known})
        known.update(fresh)
        for i, words in split:
            out[i] = b"".join(map(known.__getitem__, words))
        met = self.met
        for w, ids in fresh.items():  # a word is kept once it has come in a second batch, as most come in one only
            at = hash(w) & _MET
            size = ENTRY_BYTES + len(w) + len(ids)
            if met[at] and self.held + size <= CACHE_BYTES:
                self.held += size
            else:
                del known[w]
            met[at] = 1
        return [np.frombuffer(b, self.dtype) for b in out]

    def _fresh(self, lost: set[str]) -> dict[str, bytes]:
        """Ids of words; one that ends in a mark is its stem and the mark, which the pre-tokeniser splits as well."""
        known = self.cache
        ends = {w: w[:-1] for w in lost if len(w) > 1 and w[-1] in ".,!?;:" and w[-2].isalpha()}
        need = [w for w in (lost - ends.keys()) | set(ends.values()) | set(".,!?;:") if w not in known]
        letters, others = [w for w in need if w.isalpha()], [w for w in need if not w.isalpha()]
        fresh = dict(zip(letters + others, self._letters(letters) + self._ids(others), strict=True))
        get = lambda w: fresh[w] if w in fresh else known[w]
        for w, stem in ends.items():
            fresh[w] = get(stem) + get(w[-1])
        return fresh


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for this file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encode_in_parts(path: str, texts: list[str], chars: int = 400_000):
    """Yield each text's ids in order, tokenising about ``chars`` characters at a time (whole texts)."""
    t, start = tokenizer(path), 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end]) <= chars):
            n += len(texts[end])
            end += 1
        yield from t.encode(texts[start:end])
        start = end


def id_bytes(path: str) -> int:
    """Bytes that hold any id of the file's vocabulary: 2 or 4."""
    return tokenizer(path).dtype.itemsize
