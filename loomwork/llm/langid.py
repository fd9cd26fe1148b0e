"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word
may be cut into pieces in many ways; the forward algorithm sums all of them, so a
text's likelihood does not hang on one segmentation. The most likely language wins, and
the score is its posterior under equal priors.

Training is expectation maximisation over counts of distinct (language, word) pairs:
per round every task runs forward and backward over its words and adds up expected
piece counts, which are summed in Spark. What reaches the driver is languages x
vocabulary, whatever the corpus. Words of all training texts count.

A word is a white-space run in lower case with all but letters removed and the word
mark before it; a character outside the vocabulary is the unknown piece.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any
text when nothing could be learned. Rows without text or language are not learned
from. A null key counts as the empty text for the fold. Ties go to the smaller language
name. Repeated rows score alike; an empty table gives an empty result; other columns
are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomwork.llm.arrowtext import text_slices
from loomwork.llm.toxicity import fold
from loomwork.session import stored

ROUNDS = 3
MARK = "▁"
UND = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEN_BITS = 22


def public_pieces(path: str) -> list[str]:
    """Piece strings of a sentencepiece file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def letters(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code per word, distinct words of letters, words per text)."""
    lists = pc.utf8_split_whitespace(texts)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    plain = pc.replace_substring_regex(pc.utf8_lower(encoded.dictionary), r"[^\pL]+", "").dictionary_encode()
    codes = plain.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
    words = plain.dictionary.to_pylist()
    blank = words.index("") if "" in words else -1
    if blank >= 0:
        keep = codes != blank
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        codes = codes[keep]
    return codes, words, counts


class Lattice:
    """Pieces of the vocabulary in batches of words."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1  # the last is the unknown character
        self.longest = max((len(p) for p in pieces), default=1)
        hashes = np.array([self._of(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
        self.seen[(hashes >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True

    @staticmethod
    def _of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)
        return h

    def groups(self, words: list[str], at_once: int = 1 << 15):
        """Words of one length at a time: (their rows, matrix of code points with the mark)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            step = max(1, min(at_once, (1 << 22) // (n * self.longest)))
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                text = "".join(words[i] for i in some.tolist())
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n)
                yield some, np.concatenate([np.full((len(some), 1), ord(MARK), dtype=np.uint32), points], axis=1)

    def edges(self, points: np.ndarray):
        """(start, end, rows, pieces) of every vocabulary piece in the words."""
        count, n = points.shape
        for i in range(n):
            h = np.zeros(count, dtype=np.uint64)
            for j in range(i, min(n, i + self.longest)):
                with np.errstate(over="ignore"):
                    h = (h * _BASE + points[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
                rows = np.flatnonzero(self.seen[(h >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                good = self.hashes[place] == h[rows]
                rows, pieces = rows[good], self.order[place[good]]
                if i == j and len(rows) < count:
                    unknown = np.ones(count, dtype=bool)
                    unknown[rows] = False
                    other = np.flatnonzero(unknown)
                    rows = np.concatenate([rows, other])
                    pieces = np.concatenate([pieces, np.full(len(other), self.size - 1)])
                if len(rows):
                    yield i, j + 1, rows, pieces

    def forward(self, points: np.ndarray, log_p, edges: list) -> np.ndarray:
        """alpha (position, word, language); ``log_p(rows, pieces)`` gives (row, language)."""
        width = log_p(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)).shape[1]
        alpha = np.full((points.shape[1] + 1, len(points), width), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, pieces in edges:  # by start, so alpha[i] is complete
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + log_p(rows, pieces))
        return alpha

    def likelihoods(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """(word, language): log probability summed over all segmentations."""
        out = np.zeros((len(words), log_p.shape[0]))
        table = np.ascontiguousarray(log_p.T)
        for rows, points in self.groups(words):
            out[rows] = self.forward(points, lambda _, pieces: table[pieces], list(self.edges(points)))[-1]
        return out

    def expected(self, words: list[str], language: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """(language, piece): expected piece counts of words of known language."""
        total = np.zeros(log_p.size)
        flat = log_p.ravel()
        for rows, points in self.groups(words):
            base = language[rows] * self.size
            edges = list(self.edges(points))
            alpha = self.forward(points, lambda r, p: flat[base[r] + p][:, None], edges)[:, :, 0]
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            for i, j, r, p in reversed(edges):
                beta[i, r] = np.logaddexp(beta[i, r], beta[j, r] + flat[base[r] + p])
            for i, j, r, p in edges:
                share = np.exp(alpha[i, r] + flat[base[r] + p] + beta[j, r] - alpha[-1, r])
                np.add.at(total, base[r] + p, share * counts[rows[r]])
        return total.reshape(log_p.shape)


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    log_p: np.ndarray


def _normalised(counts: np.ndarray, smoothing: float = 0.05) -> np.ndarray:
    smooth = counts + smoothing
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def train(
    docs: DataFrame, pieces: list[str], key="doc_id", text="text", lang="lang", held_out: int = 4, rest: int = 2, rounds: int = ROUNDS
) -> Model:
    """Learns from the rows whose fold is not ``rest``."""
    rows = docs.filter((fold(key, held_out) != rest) & F.col(lang).isNotNull() & F.col(text).isNotNull())

    def count(batches):
        for part, texts in text_slices(batches, "__text"):
            names = part.column(0).dictionary_encode()
            of = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            codes, words, counts = letters(texts)
            pair = np.repeat(of, counts) * len(words) + codes
            distinct, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(distinct // max(1, len(words)))),
                    pa.array(words, pa.string()).take(pa.array(distinct % max(1, len(words)))),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "word", "n"],
            )

    partial = rows.select(F.col(lang).cast("string"), F.col(text).alias("__text")).mapInArrow(count, "lang string, word string, n bigint")
    words = stored(partial.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    log_p = np.zeros((len(languages), len(pieces) + 1)) - np.log(len(pieces) + 1)
    for _ in range(rounds if languages else 0):

        def expect(batches, log_p=log_p):
            lattice, total = Lattice(pieces), np.zeros(log_p.shape)
            for batch in batches:
                of = pc.index_in(batch.column(0), pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.int64)
                total += lattice.expected(batch.column(1).to_pylist(), of, batch.column(2).to_numpy().astype(float), log_p)
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

        summed = words.repartition("word").mapInArrow(expect, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(log_p.size)
        counts[summed["at"].to_numpy()] = summed["n"].to_numpy()
        log_p = _normalised(counts.reshape(log_p.shape))
    return Model(languages, pieces, log_p)


def predict(docs: DataFrame, model: Model, key="doc_id", text="text", held_out: int = 4, rest: int = 2) -> DataFrame:
    """``key``, held_out, lang_pred and score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        lattice = Lattice(model.pieces)
        for part, texts in text_slices(batches, "__text"):
            codes, words, counts = letters(texts)
            names, scores = [UND] * len(counts), np.zeros(len(counts))
            if model.languages and len(codes):
                each = lattice.likelihoods(words, model.log_p)[codes]
                owner = np.repeat(np.arange(len(counts)), counts)
                total = np.stack([np.bincount(owner, weights=w, minlength=len(counts)) for w in each.T], axis=1)
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                scores = np.where(counts > 0, 1 / odds.sum(axis=1), 0.0)
                names = [model.languages[b] if n else UND for b, n in zip(best.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)],
                names=[key, "held_out", "lang_pred", "score"],
            )

    rows = docs.select(key, (fold(key, held_out) == rest).alias("held_out"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
