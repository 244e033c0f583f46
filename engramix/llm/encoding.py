"""Token ids of whole texts from a tokenizers file, with a bounded cache of space-separated chunks.

Where the tokenizer never joins text across a space (a pre-tokenizer that drops
white space and a normaliser that works within words), the ids of a text are those
of its chunks one after another. Each distinct chunk is encoded once by the
library; a text's ids are gathered from a pool with numpy. Tokenizers of any other
make are given the whole text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from engramix.llm.common import kept

#: A worker's cache is emptied beyond so many chunks, or characters in them.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 8 << 20


#: A place between a letter and a symbol other than an apostrophe: the tokenizer splits there too.
_EDGE = re.compile(r"(?<=[^\W\d_])(?=[^\w\s'])")
#: White space among the first 256 characters, as the tokenizer knows it: U+001C to U+001F, which Python counts, are symbols.
_SPACE = "\t\n\v\f\r \x85\xa0"
#: Which of the first 256 characters are neither letters, digits nor space.
_SYMBOL = np.array([not (chr(c).isalnum() or chr(c) in _SPACE) for c in range(256)])
#: Chunks that are a single word for the tokenizer, whatever stands around them.
_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch


class _Numbers(dict):
    """Numbers keys in the order of their first use and remembers the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class ChunkEncoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.apart = _splits_at_spaces(made)
        self.lowers = "Lowercase" in json.dumps(made.get("normalizer"))
        self.added = [a["content"] for a in made.get("added_tokens", ())]
        self.vocabulary = self.library.get_vocab_size()
        suffix = made["model"].get("end_of_word_suffix")
        #: Ids that end a word, if the model marks them.
        self.ends = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.vocabulary)])
        self._reset()

    def _reset(self) -> None:
        self.index = _Numbers()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.chars = self.known = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        """Append the ids of new chunks to the pool."""
        new, self.index.new = self.index.new, []
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            flat, sizes = self._library(part)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
            k = self.known
            while k + len(part) > len(self.start):
                self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
            self.pool[self.used : self.used + len(flat)] = flat
            self.start[k : k + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[k : k + len(part)] = sizes
            self.used += len(flat)
            self.known += len(part)
            self.chars += sum(map(len, part))

    def _library(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each chunk). Plain words are encoded as one text."""
        plain = np.fromiter((_WORD(c) is not None for c in part), bool, len(part))
        joined = [c for c, ok in zip(part, plain.tolist(), strict=True) if ok]
        ids = np.array(self.library.encode(" ".join(joined), add_special_tokens=False).ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(joined):
            plain[:], ids, last = False, ids[:0], last[:0]
        other = [e.ids for e in self.library.encode_batch_fast([c for c, ok in zip(part, plain.tolist(), strict=True) if not ok], add_special_tokens=False)]
        sizes = np.zeros(len(part), np.int64)
        sizes[plain] = np.diff(last, prepend=-1)
        sizes[~plain] = np.fromiter(map(len, other), np.int64, len(other))
        own = np.repeat(plain, sizes)
        flat = np.zeros(len(own), np.uint32)
        flat[own], flat[~own] = ids, np.fromiter(chain.from_iterable(other), np.uint32, len(own) - len(ids))
        return flat, sizes

    def _plain(self, text: str) -> str:
        """The text in lower case, with words set apart from symbols, where that cannot change its ids: no combining marks, no special token."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if not self.lowers or any(a[:2] in text for a in self.added):
            return text
        text = text.lower()
        symbol = _SYMBOL[np.frombuffer(raw, np.uint8)]
        if (symbol[1:] & symbol[:-1]).any():  # symbols in a row may be one token
            return _EDGE.sub(" ", text)
        for sign in ".,;:?!":  # each stands alone: the same, faster
            text = text.replace(sign, " " + sign)
        return text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each), without added special tokens."""
        if not self.apart:
            ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.index) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self._reset()
        number = self.index.__getitem__
        counts, at = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            parts = self._plain(text).split(" ")
            counts[i] = len(parts)
            at.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        if not texts:
            return np.zeros(0, np.uint32), counts
        flat = np.concatenate(at)
        size = self.size[flat]
        shift = self.start[flat] - (np.cumsum(size) - size)
        total = np.add.reduceat(size, np.cumsum(counts) - counts)  # every text has a chunk
        return self.pool[np.repeat(shift, size) + np.arange(len(flat) and int(size.sum()))], total


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process; its cache outlives a task."""
    return ChunkEncoder(path)


kept("encoder", encoder.cache_clear)


def _splits_at_spaces(made: dict) -> bool:
    """Whether a text's ids are those of its space-separated chunks, one after another."""

    def parts(x: dict | None, many: str) -> list[dict]:
        return [] if not x else [p for y in x[many] for p in parts(y, many)] if x["type"] == "Sequence" else [x]

    safe = {"NFC", "Lowercase", "Replace"}
    norm = parts(made.get("normalizer"), "normalizers")
    if any(n["type"] not in safe or n["type"] == "Replace" and (n["pattern"] != {"Regex": "\\s+"} or n["content"] != " ") for n in norm):
        return False
    split = [p for p in parts(made.get("pre_tokenizer"), "pretokenizers") if p["type"] == "Split"]
    drops = any(p["behavior"] == "Removed" and p["invert"] and "[^\\s" in p["pattern"].get("Regex", "") and " " not in p["pattern"]["Regex"] for p in split)
    added = any(" " in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in made.get("added_tokens", ()))
    return drops and not added and made.get("post_processor") is None
