"""Token ids of whole texts from a public tokenizer file, for Arrow batches in tasks.

The library encodes each distinct word of a slice once, many words to a call; the
ids are then laid out for all texts with array operations. Cutting a text at ASCII
white space and before closing punctuation gives the same ids as encoding it whole
for a tokenizer that splits there by itself, as ``word_bpe_49k.json`` does; tests
compare both.
"""

from __future__ import annotations

import os
import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomwork.llm.arrowtext import ranges

# A closing mark after a plain letter or digit and before white space is a word of its own.
_CLOSING = r"([0-9A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{024F}\x{0400}-\x{0481}])([.,;:!?]+)(\s|$)"
_MARKS = "<|"
_JOINED = 512
#: Distinct words whose ids a task keeps from slice to slice.
KEPT_WORDS = 300_000
# Lower-case words of letters only are one pre-token each; the first kind is its own byte form.
_ASCII = re.compile("[a-z]+")
_LATIN = re.compile("[a-zß-öø-įı-ňŊ-ſ]+")


@dataclass(frozen=True)
class TokenizerFile:
    """``path`` of the file, and a special token that serves to part joined words."""

    path: str
    special: str = "<|endoftext|>"


def shared_encoder(file: TokenizerFile) -> WordEncoder:
    """This worker process's encoder for ``file``.

    A worker outlives its tasks, so the words one task has encoded serve the next. What
    is kept is bounded by ``KEPT_WORDS`` and does not depend on which tasks ran before.
    """
    kept = sys.modules.setdefault("_loomwork_encoders", types.ModuleType("_loomwork_encoders"))
    if getattr(kept, "file", None) != (file.path, file.special):
        kept.encoder, kept.file = WordEncoder(file), (file.path, file.special)
    return kept.encoder


class WordEncoder:
    def __init__(self, file: TokenizerFile):
        # Spark fills the cores with tasks; threads inside one would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file.path)
        self.special = file.special
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("a tokenizer that marks word ends is needed")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.special_id = self.tokenizer.token_to_id(file.special)
        self.place: dict[str, int] = {}
        self.kept: list[np.ndarray] = []
        self.kept_lengths: list[int] = []

    def _joined(self, words: list[str], between: str) -> list[np.ndarray]:
        """Ids of each word, many words to a call."""
        texts = [between.join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)]
        out: list[np.ndarray] = []
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, dtype=np.uint32)
            if between == self.special:
                parts = np.split(ids, np.flatnonzero(ids == self.special_id))
                out += [parts[0], *(p[1:] for p in parts[1:])]
            else:
                out += np.split(ids, np.flatnonzero(self.ends_word[ids])[:-1] + 1)
        return out

    def _encode_words(self, words: list[str]) -> list:
        """Ids of distinct words that are not kept yet."""
        out: list = [None] * len(words)
        latin, mixed = [], []
        for i, w in enumerate(words):
            if _ASCII.fullmatch(w):
                out[i] = [t.id for t in self.tokenizer.model.tokenize(w)]
            elif _LATIN.fullmatch(w):
                latin.append(i)
            elif _MARKS in w:
                out[i] = self.tokenizer.encode(w, add_special_tokens=False).ids
            elif w:
                mixed.append(i)
            else:
                out[i] = []
        for chosen, between in ((latin, " "), (mixed, self.special)):
            if chosen:
                for i, ids in zip(chosen, self._joined([words[i] for i in chosen], between)):
                    out[i] = ids
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids per word)."""
        place = [self.place.get(w, -1) for w in words]
        fresh = [w for w, p in zip(words, place) if p < 0]
        ids = self._encode_words(fresh)
        if len(self.place) < KEPT_WORDS:
            self.place.update(zip(fresh, range(len(self.kept_lengths), len(self.kept_lengths) + len(fresh))))
            self.kept.append(np.array([t for e in ids for t in e], dtype=np.uint32))
            self.kept_lengths += [len(e) for e in ids]
            place = [self.place[w] for w in words]
            ids = []
        kept = np.concatenate([*self.kept, np.array([t for e in ids for t in e], dtype=np.uint32)])
        self.kept = [kept[: sum(len(k) for k in self.kept)]]
        lengths = np.array(self.kept_lengths + [len(e) for e in ids], dtype=np.int64)
        place = np.array(place, dtype=np.int64)
        place[place < 0] = np.arange(len(self.kept_lengths), len(self.kept_lengths) + len(ids))
        starts = np.cumsum(lengths) - lengths
        return kept[ranges(starts[place], lengths[place])], lengths[place]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text); no text is null."""
        # A special token in a text is case-sensitive, and lower-casing a letter before a
        # combining mark may change its composition: such slices keep their case here.
        special = pc.any(pc.match_substring(texts, _MARKS)).as_py()
        if not special and not pc.any(pc.match_substring_regex(texts, r"\pM")).as_py():
            texts = pc.ascii_lower(texts)
        spaced = pc.replace_substring_regex(texts, _CLOSING, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(spaced)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        ids, lengths = self._words(encoded.dictionary.to_pylist())
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        starts = (np.cumsum(lengths) - lengths).astype(np.int32)
        per_word = lengths.astype(np.int32)[codes]
        flat = ids[ranges(starts[codes], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        texts_end = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(ends[texts_end])
