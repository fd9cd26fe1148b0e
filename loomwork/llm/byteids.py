"""Token ids of whole texts for a byte-level BPE tokenizer file, for Arrow batches in tasks.

The tokenizer's own pattern starts a new pre-token at a blank (U+0020) unless white
space stands on both sides of it. Such texts, rare ones, and texts with a special
token go to the library whole. All others are cut before each blank, around line ends
beside plain characters, and before a mark that follows a plain letter, where a
pre-token ends in any case; each distinct cut of a slice is encoded once. Ids are the
library's exactly; tests compare both.
"""

from __future__ import annotations

import os
import re
import string
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from loomwork.llm.arrowtext import ranges
from loomwork.llm.tokenids import TokenizerFile

# White space on both sides of a blank, or before one that ends the text; wide on purpose.
_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_UNSAFE = f"{_SPACE} ({_SPACE}|$)"
_BLANK_WORD = re.compile(r" \S+")
# Letters only, so one pre-token.
_LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_JOINED = 512
#: Distinct cuts whose ids a task keeps from slice to slice.
KEPT_CUTS = 500_000


def _kinds() -> bytes:
    kinds = bytearray(256)
    kinds[0x20], kinds[0x0A] = _BLANK, _LINE
    for c in string.ascii_letters:
        kinds[ord(c)] = _LETTER
    for c in ".,;:!?":
        kinds[ord(c)] = _MARK
    return bytes(kinds)


def _cut_rule() -> bytes:
    """1 where a pre-token starts at a byte of kind ``now`` after kinds ``before`` and ``second``."""
    rule = bytearray(256)
    for second in range(5):
        for before in range(5):
            for now in range(5):
                rule[now + 5 * before + 25 * second] = (
                    now == _BLANK
                    or (now == _LINE and before in (_LETTER, _MARK))
                    or (now in (_LETTER, _MARK) and before == _LINE and second in (_LETTER, _MARK))
                    or (now == _MARK and before == _LETTER)
                )
    return bytes(rule)


# Kinds of bytes that decide on cuts.
_OTHER, _BLANK, _LINE, _LETTER, _MARK = range(5)
_KINDS, _CUT_RULE = _kinds(), _cut_rule()


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it is
    printable in Latin-1, and else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()
_BYTE_TABLE = str.maketrans({chr(b): c for b, c in _BYTE_LETTERS.items()})


def shared_byte_encoder(file: TokenizerFile) -> ByteEncoder:
    """This worker process's encoder for ``file``; see ``tokenids.shared_encoder``."""
    kept = sys.modules.setdefault("_loomwork_byte_encoders", types.ModuleType("_loomwork_byte_encoders"))
    if getattr(kept, "file", None) != (file.path, file.special):
        kept.encoder, kept.file = ByteEncoder(file), (file.path, file.special)
    return kept.encoder


class ByteEncoder:
    """Keeps the cuts it has encoded, up to ``KEPT_CUTS``, for the slices that follow."""

    def __init__(self, file: TokenizerFile):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file.path)
        self.special = file.special
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.starts_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.starts_word[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(blank)]] = True
        self.place: dict[str, int] = {}
        self.kept, self.kept_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids per text), as the library gives them."""
        found = [np.array(f.ids, dtype=np.uint32) for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], dtype=np.int64)

    def _encode(self, cuts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the distinct cuts in another order, their ids, number of ids of each).

        A cut that is a blank and a word goes with many others to a call; the ids are
        parted at the tokens that start with a blank.
        """
        letters, plain, rest = [], [], []
        for c in cuts:
            (letters if _LETTERS.fullmatch(c) else plain if _BLANK_WORD.fullmatch(c) else rest).append(c)
        tokenize = self.tokenizer.model.tokenize
        blank = _BYTE_LETTERS[0x20]
        written = [c.replace(" ", blank) if c.isascii() else c.encode().decode("latin-1").translate(_BYTE_TABLE) for c in letters]
        single = [[t.id for t in tokenize(w)] for w in written]
        joined, _ = self._library(["".join(plain[at : at + _JOINED]) for at in range(0, len(plain), _JOINED)])
        lengths = np.diff(np.append(np.flatnonzero(self.starts_word[joined]), len(joined))).astype(np.int64)
        ids, more = self._library(rest)
        return (
            letters + plain + rest,
            np.concatenate([np.array([t for w in single for t in w], dtype=np.uint32), joined, ids]),
            np.concatenate([np.array([len(w) for w in single], dtype=np.int64), lengths, more]),
        )

    def _cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each cut's ids start, how many it has)."""
        fresh, ids, lengths = self._encode([c for c in cuts if c not in self.place])
        now, all_ids, all_lengths = self.place, np.concatenate([self.kept, ids]), np.concatenate([self.kept_lengths, lengths])
        known = len(self.kept_lengths)
        if len(self.place) < KEPT_CUTS:
            self.place.update(zip(fresh, range(known, known + len(fresh))))
            self.kept, self.kept_lengths, fresh = all_ids, all_lengths, []
        new = {c: known + i for i, c in enumerate(fresh)}
        at = np.array([now[c] if c in now else new[c] for c in cuts], dtype=np.int64)
        starts = np.cumsum(all_lengths) - all_lengths
        return all_ids, starts[at], all_lengths[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids per text); no text is null."""
        unsafe = pc.or_(pc.match_substring(texts, self.special), pc.match_substring_regex(texts, _UNSAFE))
        whole = unsafe.to_numpy(zero_copy_only=False)
        flat = pc.if_else(unsafe, "", texts).cast(pa.large_string())
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = np.frombuffer(data.tobytes().translate(_KINDS), dtype=np.uint8)
        context = kind.copy()
        context[1:] += 5 * kind[:-1]
        context[2:] += 25 * kind[:-2]
        cut = np.frombuffer(context.tobytes().translate(_CUT_RULE), dtype=bool).copy()
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, starts, lengths = self._cuts(coded.dictionary.to_pylist())
        per_cut = lengths[codes]
        out = ids[ranges(starts[codes], per_cut)]
        totals = np.concatenate([[0], np.cumsum(per_cut)])
        per_text = np.diff(totals[np.searchsorted(at, ends)])
        if not whole.any():
            return out, per_text
        more, counts = self._library(texts.filter(unsafe).to_pylist())
        parts = np.split(out, np.cumsum(per_text)[:-1])
        for i, found in zip(np.flatnonzero(whole).tolist(), np.split(more, np.cumsum(counts)[:-1])):
            parts[i] = found
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
