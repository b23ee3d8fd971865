"""Encoding batches of texts with a tokenizer file of the tokenizers library.

The vocabulary file's place is a parameter. A pre-tokenizer that never joins characters
across white space encodes a text as the encodings of its white-space separated chunks, one
after another, so each distinct chunk of a batch is encoded once and kept in a bounded
cache of the Python worker.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 1
CACHE_WORDS = 300_000
#: A Latin-1 word (which NFC leaves alone) with at most one run of plain marks behind it.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#|]*)")
_ENCODERS: dict[str, ChunkEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Exact ids of whole texts, by way of their chunks."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_words
        # The same vocabulary for words that need no normalising and no further splitting;
        # their ends are seen from the vocabulary's word-end suffix.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.split_words = suffix == "</w>" and self._lowers()
        if self.split_words:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.reset()

    def _lowers(self) -> bool:
        """Whether the file's own pipeline lower-cases and splits words from marks."""
        ids = self.tokenizer.encode("Aé,. b#", add_special_tokens=False).ids
        return ids == [i for t in ("aé", ",.", "b", "#") for i in self.tokenizer.encode(t, add_special_tokens=False).ids]

    def reset(self) -> None:
        self.slot: dict[str, int] = {"": 0}  # slot 0 has no ids
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0
        self.bounds = np.zeros(1 << 14, np.int64)  # start of each slot; one more at the end
        self.count = 1

    def _append(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(words), len(flat)
        if m and int(flat.max()) > 65535 and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.used : self.used + m] = flat
        self.bounds[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.used += m
        self.bounds[self.count + n] = self.used
        self.slot.update(zip(words, range(self.count, self.count + n), strict=True))
        self.count += n

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], []
        groups = [words[k : k + 400] for k in range(0, len(words), 400)]
        encoded = self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
        for group, one in zip(groups, encoded, strict=True):
            flat.append(np.array(one.ids, np.int64))
            at = np.array(one.word_ids, np.int64)
            lengths.append(np.bincount(at, minlength=len(group)) if len(at) else np.zeros(len(group), np.int64))
        return np.concatenate(flat), np.concatenate(lengths)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library for lower-case words of which each is one piece to the pre-tokenizer."""
        groups = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        encoded = self.plain.encode_batch_fast(groups, add_special_tokens=False)
        flat = np.concatenate([np.array(one.ids, np.int64) for one in encoded])
        ends = np.flatnonzero(self.is_end[flat]) + 1
        return flat, np.diff(ends, prepend=0)

    def _learn(self, words: list[str]) -> None:
        """Put chunks into the cache. A plain word with a tail of marks is two of them."""
        whole: dict[str, None] = {}
        lower: dict[str, None] = {}
        made: list[str] = []
        parts: list[str] = []
        slot = self.slot
        for w in words:
            m = _WORD.fullmatch(w) if self.split_words else None
            if m is None:
                whole[w] = None
                continue
            stem, tail = m[1].lower(), m[2]
            if stem not in slot:
                lower[stem] = None
            if tail and tail not in slot:
                lower[tail] = None
            if stem != w:
                made.append(w)
                parts += (stem, tail)
        for fresh, how in ((list(lower), self._words), (list(whole), self._library)):
            if fresh:
                self._append(fresh, *how(fresh))
        if made:
            flat, lengths = self._gather(np.fromiter((slot[x] for x in parts), np.int64, len(parts)))
            self._append(made, flat, lengths[0::2] + lengths[1::2])

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots, one after another, and how many each has."""
        starts = self.bounds[slots]
        lengths = self.bounds[slots + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
        return self.ids[index], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without nulls -> all ids, and the number of ids of each text."""
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        if pc.any(odd).as_py():
            return self._encode_mixed(texts, odd.to_numpy(zero_copy_only=False))
        if self.count > self.limit:
            self.reset()
        split = pc.utf8_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = words.dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slot = self.slot
        unknown = [w for w in unique if w not in slot]
        if unknown:
            self._learn(unknown)
        lookup = np.fromiter((slot[w] for w in unique), np.int64, len(unique))
        slots = lookup[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        ids, lengths = self._gather(slots)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[bounds[1:]] - ends[bounds[:-1]]

    def _encode_mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with texts that hold information separators given whole to the library."""
        parts, lengths = [], []
        for text, whole in zip(texts.to_pylist(), odd, strict=True):
            if whole:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
            else:
                ids, _ = self.encode(pa.array([text], pa.large_string()))
            parts.append(ids.astype(np.int64))
            lengths.append(len(ids))
        return np.concatenate(parts), np.array(lengths, np.int64)


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each document; little-endian unsigned 32-bit ids."""
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, lengths + 1
