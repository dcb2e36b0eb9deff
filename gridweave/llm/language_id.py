"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces.  For each language, piece
probabilities are estimated by expectation maximisation over all segmentations
of the words of a bounded labelled sample.  A text's score under a language is
the sum over its words of the log of the total probability of all
segmentations, which a forward algorithm computes.

Defined results: null text, or text without any letter: `und`, score 0.
No labelled rows at all: every text is `und`.  Rows are scored one by one, so
repeated rows and repeated ids get equal results and extra columns of the
input are ignored.  Very long texts and words are scored whole: words of more
than LONG letters by logarithms, which cannot underflow.  Languages are all that
the labelled rows have; the table of probabilities takes 8 bytes for each piece
and language.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import PerWorker, bound_batches, numbered, slices, tokenizer_path

#: Labelled rows learned from, for each language, at most about so many.
SAMPLE_ROWS = 400
#: Letters beyond which a word is worked by logarithms, and rounds of expectation maximisation.
LONG, ROUNDS = 40, 3
#: Words whose scores a worker remembers before it starts afresh.
CACHE_WORDS = 400_000
#: Probability of a letter that no piece has, and what is added to each expected count.
UNKNOWN, ADDED = 1e-9, 0.01
WORDS = re.compile(r"[^\W\d_]+")
START = "▁"


def load_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    keep = {p.lower() for p in every if p.removeprefix(START).isalpha()}
    return sorted(keep | {START})


def words_of(text: str) -> list[str]:
    found = WORDS.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numerals such as fractions
        found = [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]
    return found


def _ids(words: list[str], i: int, j: int, index: dict[str, int]) -> np.ndarray:
    return np.fromiter((index.get(w[i:j], -1) for w in words), np.int64, len(words))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    return groups


def _longest(index: dict[str, int]) -> int:
    return max(map(len, index), default=0)


def _spans(word: str, index: dict[str, int], longest: int) -> np.ndarray:
    """Number of the piece that ends at each place (row) and is so many letters long (column, from 1); -1 is none."""
    return np.array([[index.get(word[j - k : j], -1) if k <= j else -1 for k in range(1, longest + 1)] for j in range(1, len(word) + 1)], np.int64)


def _log_sums(steps: np.ndarray, unknown: float) -> np.ndarray:
    """Log of the summed probability of all segmentations up to each place.

    steps: places x lengths x languages, log probability of the piece that ends
    at the place and has the length.
    """
    n, longest, langs = steps.shape
    out = np.full((n + longest, langs), -np.inf)  # `longest` rows before the first place
    out[longest - 1] = 0
    for j in range(n):
        terms = out[j : j + longest][::-1] + steps[j]
        terms = np.concatenate([terms, out[j + longest - 1 : j + longest] + unknown])
        top = terms.max(axis=0)
        out[j + longest] = top + np.log(np.exp(terms - top).sum(axis=0))
    return out[longest - 1 :]


class _Steps:
    """Log probabilities of the pieces that end at each place, looked up place by place."""

    def __init__(self, spans: np.ndarray, logs: np.ndarray):
        self.spans, self.logs, self.shape = spans, logs, (*spans.shape, logs.shape[1])

    def __getitem__(self, j: int) -> np.ndarray:
        return self.logs[self.spans[j]]


def log_forward(words: list[str], index: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """words x languages: log of the summed probability of all segmentations.

    probs: pieces x languages, then one row of zeros for "no such piece".
    """
    out, longest = np.empty((len(words), probs.shape[1])), _longest(index)
    marked = [START + w for w in words]
    groups = _by_length(marked)
    with np.errstate(divide="ignore"):
        logs = np.log(probs) if max(groups, default=0) > LONG else None
    for n, members in groups.items():
        if n > LONG:
            for k in members:
                with np.errstate(divide="ignore"):
                    out[k] = _log_sums(_Steps(_spans(marked[k], index, longest), logs), math.log(UNKNOWN))[-1]
            continue
        group = [marked[k] for k in members]
        alpha = [np.ones((len(group), probs.shape[1]))]
        for j in range(1, n + 1):
            total = alpha[j - 1] * UNKNOWN
            for i in range(max(0, j - longest), j):
                total += alpha[i] * probs[_ids(group, i, j, index)]
            alpha.append(total)
        out[members] = np.log(np.maximum(alpha[n], 1e-300))
    return out


def expected_counts(words: list[str], weights: np.ndarray, index: dict[str, int], prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words."""
    counts, longest = np.zeros(len(prob)), _longest(index)
    marked = [START + w for w in words]
    for n, members in _by_length(marked).items():
        if n > LONG:
            for k in members:
                ids, used = _expected_long(marked[k], index, prob, longest)
                np.add.at(counts, ids, weights[k] * used)
            continue
        group, weight = [marked[k] for k in members], weights[members]
        spans = {(i, j): _ids(group, i, j, index) for j in range(1, n + 1) for i in range(max(0, j - longest), j)}
        alpha, beta = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group)))
        alpha[0] = beta[n] = 1
        for j in range(1, n + 1):
            alpha[j] = alpha[j - 1] * UNKNOWN + sum(alpha[i] * prob[spans[i, j]] for i in range(max(0, j - longest), j))
        for i in range(n - 1, -1, -1):
            beta[i] = beta[i + 1] * UNKNOWN + sum(beta[j] * prob[spans[i, j]] for j in range(i + 1, min(n, i + longest) + 1))
        scale = weight / np.maximum(alpha[n], 1e-300)
        for (i, j), ids in spans.items():
            np.add.at(counts, ids, scale * alpha[i] * prob[ids] * beta[j])
    counts[-1] = 0
    return counts


def _expected_long(word: str, index: dict[str, int], prob: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their expected uses in one word of any length."""
    n = len(word)
    spans = _spans(word, index, longest)
    with np.errstate(divide="ignore"):
        steps = np.log(prob)[spans]  # by the place where a piece ends
        # the same by the place where it begins, counted from the word's end
        turned = np.full_like(steps, -np.inf)
        for k in range(min(longest, n)):
            turned[k:, k] = steps[k:, k][::-1]
        unknown = math.log(UNKNOWN)
        forward, back = _log_sums(steps[:, :, None], unknown)[:, 0], _log_sums(turned[:, :, None], unknown)[::-1, 0]
    used = np.zeros_like(steps)
    for k in range(min(longest, n)):
        used[k:, k] = np.exp(forward[: n - k] + steps[k:, k] + back[k + 1 :] - forward[n])
    return spans.ravel(), used.ravel()


def may_learn(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def learn(docs: DataFrame, pieces: list[str], sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and the table of piece probabilities by language.

    Learns from rows with text and lang whose id allows it; of each language,
    about `sample_rows` rows, chosen by a hash of the id.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & may_learn(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["count"]))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count_words(batches):
        for b in batches:
            counts: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counts.update((lang, w) for w in words_of(text))
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    langs = sorted(r["lang"] for r in sizes)
    index = {p: i for i, p in enumerate(pieces)}
    probs = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    probs[-1] = 0
    try:
        for _ in range(ROUNDS):
            probs = _next(words, langs, index, probs)
    finally:
        words.unpersist()
    return langs, probs


def _next(words: DataFrame, langs: list[str], index: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """One round; what comes to the driver is a number for each piece and language at most."""
    shared = words.sparkSession.sparkContext.broadcast((index, probs))

    def expect(batches):
        own, table = shared.value
        total = np.zeros_like(table)
        for b in batches:
            pd = b.to_pandas()
            for lang, part in pd.groupby("lang"):
                k = langs.index(lang)
                for at in range(0, len(part), 20_000):
                    some = part.iloc[at : at + 20_000]
                    total[:, k] += expected_counts(some["word"].tolist(), some["n"].to_numpy(float), own, table[:, k])
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    counts = np.zeros_like(probs)
    rows = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    counts[:-1] += ADDED
    out = counts / counts.sum(axis=0)
    out[-1] = 0
    return out


class Scorer:
    """Best language and its posterior probability, text by text."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.index, self.probs = {p: i for i, p in enumerate(pieces)}, probs
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, probs.shape[1]))

    def _learn_words(self, found: list[list[str]]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        if new := sorted({w for ws in found for w in ws if w not in self.known}):
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, *(log_forward(new[at : at + 50_000], self.index, self.probs) for at in range(0, len(new), 50_000))])

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its language, -1 if it has none, and the score."""
        best, share = np.full(len(texts), -1), np.zeros(len(texts))
        for start, end in slices(texts) if self.probs.shape[1] else ():
            found = [words_of(t) if t else [] for t in texts[start:end]]
            self._learn_words(found)
            for k, ws in enumerate(found, start):
                if ws:
                    total = self.scores[[self.known[w] for w in ws]].sum(axis=0)
                    best[k] = total.argmax()
                    share[k] = 1 / np.exp(total - total.max()).sum()
        return best, share


def predict(docs: DataFrame, pieces: list[str], langs: list[str], probs: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    names = [*langs, "und"]
    shared = PerWorker(docs.sparkSession, Scorer, pieces, probs)

    def score(batches):
        scorer = shared.get()
        for b in batches:
            best, share = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([names[k] for k in best], pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the labelled rows of docs, then predict for every row."""
    pieces = load_pieces(path or tokenizer_path("piece_bpe_32k.model"))
    return predict(docs, pieces, *learn(docs, pieces, sample_rows))


def keep_identified(docs: DataFrame, path: str | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified
    with a score of `least` or more; without labelled rows to learn from, those
    that have a letter."""
    pieces = load_pieces(path or tokenizer_path("piece_bpe_32k.model"))
    langs, probs = learn(docs, pieces)
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = PerWorker(docs.sparkSession, Scorer, pieces, probs)
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches):
        scorer = shared.get()
        for b in batches:
            best, share = scorer(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array((best >= 0) & (share >= least)))

    return numbered(docs).mapInArrow(keep, docs.schema)
