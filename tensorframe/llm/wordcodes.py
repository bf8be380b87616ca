"""Exact tokenizer ids of whole texts, each distinct white-space chunk encoded once.

Both public vocabularies split a text before merging, and no piece of that
split spans a boundary "not white space, then a run of blanks or newlines".
Encoding such chunks one by one therefore gives the ids of the whole text. A
text with any other white space, or with the string of a special token, is handed to the tokenizer whole.

By default the library's own rule holds: a special token's string in a text becomes that token.
With ``special_as_text`` such strings are ordinary text.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress, islice
from zlib import crc32

import numpy as np

#: White space beyond blank and newline, where definitions of white space differ.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Distinct chunks held by a worker (some 250 bytes each); the earliest half of them stays when it is full.
HELD = 1_000_000
#: Chunks that the tokenizer gets in one string.
JOINED = 2_000


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def word_hash(chunk: str) -> int:
    """The same for a word with and without white space around it, and in either case."""
    return crc32(chunk.strip().lower().encode("utf-8", "replace"))


#: Bytes of Latin-1 texts in which letters, digits and ASCII signs are all there is (and no apostrophe, which can start a piece of letters).
SAFE = bytes(c for c in range(256) if (s := chr(c)).isalpha() or s in " \n" or 32 < c < 127 and s != "'")
PIECE = re.compile(r"[^\x00-\x20!-/:-@\[-`{-\x7f]+|[!-/:-@\[-`{-~]+")


def words_apart(text: str) -> list[str]:
    """Words for a vocabulary that lowers case and cuts between letters and signs; both done first merge more of them.

    In Latin-1 lower case changes single letters only, so the order doesn't matter. Signs are
    cut off only where no other kind of sign could belong to their run.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return text.lower().split() if raw.translate(None, SAFE) else PIECE.findall(text.lower())


class WordCodes:
    """``encode(texts)`` gives all ids in one array and the texts' end offsets in it."""

    def __init__(self, path: str, keep_space: bool, hashed: bool = False, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # compared in lower case, which finds too many rather than too few
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.first = set("".join(t[0] + t[0].upper() for t in self.special))
        self.split = CHUNK.findall if keep_space else words_apart
        # of byte-level pieces, a token's characters are its bytes
        self.width = None
        if keep_space:
            self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.width[i] = len(token)
        self.hashed = hashed
        self.known = Numbered()
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _odd(self, text: str) -> bool:
        if any(c in text for c in ODD):
            return True
        return any(c in text for c in self.first) and any(t in text.lower() for t in self.special)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, at: np.ndarray, sizes: np.ndarray, ids: np.ndarray, held: list[np.ndarray], before: int) -> int:
        """Notes the ids of new chunks, to be joined on later; returns how many ids there are with them."""
        self.sizes[at] = sizes
        self.starts[at] = before + np.cumsum(sizes) - sizes
        held.append(ids)
        return before + len(ids)

    def _learn(self) -> None:
        have = len(self.starts)
        new = list(islice(self.known, have, None))
        if not new:
            return
        self.starts, self.sizes = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.starts, self.sizes))
        if self.hashed:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(word_hash, new), np.int64, len(new))])
        alone, held, n = list(range(len(new))), [self.flat], len(self.flat)
        if self.width is not None:  # chunks "white space, rest" can follow each other in one string; bytes tell where each ends
            ends = [w[0] in " \n" and w[-1] not in " \n" for w in new]
            together, alone = list(compress(alone, ends)), [i for i, x in enumerate(ends) if not x]
            for a in range(0, len(together), JOINED):
                at = together[a : a + JOINED]
                ids = np.array(self._ids(["".join([new[i] for i in at])])[0], np.uint32)
                stop = np.cumsum([len(new[i].encode()) for i in at])
                last = np.searchsorted(np.cumsum(self.width[ids]), stop) + 1
                n = self._add(have + np.array(at), np.diff(last, prepend=0), ids, held, n)
        if alone:
            ids = self._ids([new[i] for i in alone])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(have + np.array(alone), sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), held, n)
        self.flat = np.concatenate(held)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _trim(self) -> None:
        if len(self.known) > HELD:
            keep = HELD // 2
            old, self.known = self.known, Numbered()
            self.known.update(islice(old.items(), keep))
            self.flat, ends = self._gather(np.arange(keep))
            self.starts, self.sizes = ends[:-1].copy(), self.sizes[:keep].copy()
            self.hashes = self.hashes[:keep].copy()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_and_hash(texts)[:2]

    def encode_and_hash(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As encode(), with the hashes of all words (none unless asked for) and the texts' end offsets in them."""
        odd = [i for i, t in enumerate(texts) if self._odd(t)]
        whole = dict(zip(odd, self._ids([texts[i] for i in odd]), strict=True)) if odd else {}
        parts = [[] if i in whole else self.split(t) for i, t in enumerate(texts)]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        self._learn()
        ids, ends = self._gather(at)
        hashes, hash_ends = self.hashes[at if self.hashed else at[:0]], np.cumsum(counts)
        text_ends = ends[hash_ends]
        self._trim()
        if whole:
            pieces = np.split(ids, text_ends[:-1])
            pieces = [np.array(whole[i], np.uint32) if i in whole else p for i, p in enumerate(pieces)]
            ids, text_ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        if whole and self.hashed:
            pieces = np.split(hashes, hash_ends[:-1])
            pieces = [np.array([word_hash(w) for w in texts[i].split()], np.int64) if i in whole else p for i, p in enumerate(pieces)]
            hashes, hash_ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        return ids, text_ends, hashes, hash_ends


_loaded: dict[tuple, WordCodes] = {}


def word_codes(path: str, keep_space: bool, hashed: bool = False, special_as_text: bool = False) -> WordCodes:
    """One encoder per worker process, so that later tasks find its chunks."""
    key = path, keep_space, hashed, special_as_text
    if key not in _loaded:
        _loaded[key] = WordCodes(*key)
    return _loaded[key]


def forget() -> None:
    """Drops the encoders of this worker process, for whoever needs their memory next."""
    _loaded.clear()


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by ``end_id``, and the new end offsets."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
