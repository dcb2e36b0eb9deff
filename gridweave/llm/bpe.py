"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A worker gathers the distinct pre-tokens of many texts into one corpus of
symbols.  An inverted index leads from the rank of a mergeable token pair to
the positions where the pair stands.  Ranks are taken in order; a merge
touches only its two neighbours, whose new pairs enter the index.  Where a
merge gives rise to a pair of lower rank, that one comes next, so that every
word is merged exactly as if it stood alone.  A word of more than LONG bytes is
replayed by itself, with one index of (rank, place) in order, which takes
n log n steps for n bytes.

Defined results: null and empty text give no ids.  Very long texts are encoded
whole.  Rows are independent, so repeated rows and ids do no harm; further
columns of the input are ignored.  Special tokens are never produced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.common import PerWorker, slices, tokenizer_path

#: Places of a rank from which they are merged as arrays.
MANY = 12
#: Bytes beyond which a word is replayed by itself.
LONG = 400
#: Characters whose words are merged together.
CORPUS_CHARS = 6_000_000
# Letters, numbers and white space under code point 0250.
LATIN = {r"\s": "\t-\r \x85\xa0", r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼½¾"}
BEYOND_LATIN = re.compile("[^\x00-ɏ]").search
#: Pre-tokens a worker remembers before it starts afresh.
CACHE_WORDS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes words by replaying merges over all of them together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        #: (left id << 32 | right id) -> rank, which is also the merged id
        self.pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank

        keys = np.array(sorted(self.pairs), np.int64)
        self.keys, self.merged = keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(w) for w in words]
        parts = iter(self._corpus([w for w, rank in zip(words, whole) if rank is None and len(w) <= LONG]))
        return [rank.to_bytes(4, "little") if rank is not None else next(parts) if len(w) <= LONG else self._long(w) for w, rank in zip(words, whole)]

    def _long(self, word: bytes) -> bytes:
        """Merges of one word: always the lowest rank, and of its places the leftmost."""
        get, n = self.pairs.get, len(word)
        ids, before, after = [self.byte[x] for x in word], list(range(-1, n - 1)), [*range(1, n), -1]
        index = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(index)
        while index:
            r, i = heappop(index)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 32 | ids[j]) != r:
                continue  # the pair has changed since it was entered
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = r, -1, k
            if k >= 0:
                before[k] = i
                if (new := get(r << 32 | ids[k])) is not None:
                    heappush(index, (new, i))
            if h >= 0 and (new := get(ids[h] << 32 | r)) is not None:
                heappush(index, (new, h))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for those that do not merge."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], -1)

    def _corpus(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(sizes)
        # shared memory: single places are read as lists, many at once as arrays
        ids, before, after = (array("q", bytes(8 * n)) for _ in range(3))
        view = [np.frombuffer(x, np.int64) for x in (ids, before, after)] if n else [np.zeros(0, np.int64)] * 3
        view[0][:] = np.array(self.byte, np.int64)[raw]
        view[1][:], view[2][:] = np.arange(-1, n - 1), np.arange(1, n + 1)
        full = sizes > 0
        view[1][(ends - sizes)[full]] = view[2][ends[full] - 1] = -1
        word = np.repeat(np.arange(len(words)), sizes)
        self._replay(ids, before, after, *view, word)
        alive = view[0] >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        flat, cuts = view[0][alive].astype("<u4").tobytes(), (4 * kept[np.concatenate([[0], ends])]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _replay(self, ids, before, after, v_ids, v_before, v_after, word) -> None:
        """Ranks in order from the index; of one word, the leftmost place first.

        A place whose pair has changed since it was entered is passed over.  If
        a merge gives rise to a pair of lower rank, that rank comes next.
        """
        get = self.pairs.get
        place = np.flatnonzero(v_after >= 0)
        rank = self._ranks(v_ids[place], v_ids[v_after[place]])
        place, rank = place[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        place, rank = place[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1, append=-1))
        index = {int(rank[a]): [place[a:b]] for a, b in zip(cuts[:-1], cuts[1:])} if len(rank) else {}
        due = list(index)
        heapify(due)

        def enter(new: int, where) -> None:
            if new in index:
                index[new].append(where)
            else:
                index[new] = [where]
                heappush(due, new)

        while due:
            r = heappop(due)
            entries = index.pop(r, None)
            if entries is None:
                continue
            if sum(1 if isinstance(e, int) else len(e) for e in entries) >= MANY:
                self._merge_many(r, np.unique(np.concatenate([[e] if isinstance(e, int) else e for e in entries])), v_ids, v_before, v_after, word, enter)
                continue
            places = sorted({p for e in entries for p in ([e] if isinstance(e, int) else e.tolist())})
            while places:
                i = places.pop(0)
                a, j = ids[i], after[i]
                if a < 0 or j < 0 or get(a << 32 | ids[j]) != r:
                    continue
                k, h = after[j], before[i]
                ids[i], ids[j], after[i] = r, -1, k
                least = r
                if k >= 0:
                    before[k] = i
                    if (new := get(r << 32 | ids[k])) is not None:
                        enter(new, i)
                        least = min(least, new + (new == r))
                if h >= 0 and (new := get(ids[h] << 32 | r)) is not None:
                    enter(new, h)
                    least = min(least, new + (new == r))
                if least < r and places:  # the lower rank comes before what is left of this one
                    for p in places:
                        enter(r, p)
                    break

    def _merge_many(self, r: int, places: np.ndarray, ids, before, after, word, enter) -> None:
        """The leftmost valid place of each word; a word's further places wait."""
        places = places[(ids[places] >= 0) & (after[places] >= 0)]
        places = places[self._ranks(ids[places], ids[after[places]]) == r]
        if not len(places):
            return
        first = np.diff(word[places], prepend=-1) != 0
        if not first.all():
            enter(r, places[~first])
        i = places[first]
        j = after[i]
        k, h = after[j], before[i]
        ids[i], ids[j], after[i] = r, -1, k
        right, left = k >= 0, h >= 0
        before[k[right]] = i[right]
        where = np.concatenate([i[right], h[left]])
        new = np.concatenate([self._ranks(ids[i[right]], ids[k[right]]), self._ranks(ids[h[left]], ids[i[left]])])
        where, new = where[new >= 0], new[new >= 0]
        order = np.argsort(new, kind="stable")
        where, new = where[order], new[order]
        cuts = np.flatnonzero(np.diff(new, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            enter(int(new[a]), where[a:b] if b - a > 1 else int(where[a]))


def _latin(pattern: str):
    """The split for texts of code points under 0250, by the faster library;
    None if the pattern has classes that are not listed."""
    space, letters, numbers = LATIN.values()
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for name, members in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", space)):
        pattern = pattern.replace(name, f"[{members}]")
    pattern = pattern.replace(r"\S", f"[^{space}]")
    return None if r"\p" in pattern else re.compile(pattern).findall


class Tokenizer:
    """Splits texts by the pattern and encodes what is new by merge replay."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.fast = _latin(pattern)
        # \s of the ranks' library is White_Space, without the separators 1C to 1F
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.replay = MergeReplay(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        for start, end in slices(texts, CORPUS_CHARS):
            found = [(self.fast(t) if self.fast and not BEYOND_LATIN(t) else self.split(t)) if t else [] for t in texts[start:end]]
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            new = list({w for ws in found for w in ws if w not in self.known})
            self.known.update(zip(new, self.replay.encode([w.encode() for w in new])))
            get = self.known.__getitem__
            out += [b"".join(map(get, ws)) for ws in found]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(spark, path: str | None, pattern: str | None) -> PerWorker:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return PerWorker(spark, Tokenizer, load_ranks(path or tokenizer_path("byte_bpe_multi_50k.tiktoken")), pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row."""
    shared = _tokenizer(docs.sparkSession, path, pattern)

    def run(batches):
        tokenizer = shared.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokenizer.encode(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and bytes of each row of `encode`; null ids give null."""
    shared = _tokenizer(encoded.sparkSession, path, pattern)

    def run(batches):
        tokenizer = shared.get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if x is None else tokenizer.decode(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its ids, and
    the bytes that these give when decoded again."""
    shared = _tokenizer(docs.sparkSession, path, pattern)

    def run(batches):
        tokenizer = shared.get()
        for b in batches:
            ids = tokenizer.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
