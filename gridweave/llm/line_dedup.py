"""Removal of repeated multi-line chunks with content-defined boundaries.

A text is a sequence of lines; a line that holds several sentences is cut after
each of them, since a passage may begin in the middle of a line.  Every line is
hashed (without white space at its ends), and a rolling hash over ROLLED line
hashes goes along the lines.  A boundary stands before each line whose rolling
hash is no greater than that of a neighbour, so of two lines in a row one has a
boundary, and where boundaries stand depends on the lines close by alone:
inserted lines do not shift those further on.  From every boundary a chunk runs
until it has MIN_LINES lines and MIN_WORDS words; chunks may overlap, and leave
no line between them out.

Of a chunk that occurs more than once in all documents, the occurrence with
the smallest id and place is the first and stays whole.  The lines of every
other one are removed, but for lines that it shares with a first occurrence in
its own text.  So whatever is removed stands whole, line by line, in a text that
keeps it.  Chunks are found by hashes; then their bytes are compared, line by
line without the white space at the lines' ends.

Defined results: null and empty texts stay as they are.  A text of which
nothing is left becomes empty; `dedup` keeps its row and `drop_copies` does
not.  Rows without an id are documents too, after all that have one, equal
texts among them being one.  Rows with one id are one document if their texts
are equal: of equal rows all stay.  Ids must be whole numbers.  Very long texts
are read whole.  Further columns are kept as they are, whatever their names, but
for n_chars, which is set anew where a text has changed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import bound_batches, broadcast_if_small, checkpoint, numbered, slices, tidy, unused

MIN_LINES, MIN_WORDS = 2, 10
#: Percent of its words that a copy loses.
COPY = 80
#: Rows that go to a Python worker at once; texts, lines and lists are held together.
BATCH = 200
#: Lines that the rolling hash covers.
ROLLED = 2
BREAK = re.compile(r"\n\s*|[.!?]\s+")
#: Base of the polynomial hash of a chunk's line hashes.
ROLL = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
MIX = 0xFF51AFD7ED558CCD


def lines_of(text: str) -> list[int]:
    """Ends of the lines."""
    ends = [m.end() for m in BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Chunks:
    """The lines of some texts, and the chunks of each text in their order.

    Lines are numbered through all the texts; text t has those from bounds[t] to
    bounds[t + 1].  For each chunk: owner (number of the text), first and end
    line, hash, and place: the first line's number in the text.
    """

    def __init__(self, texts: list[str]):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        self.pieces: list[str] = []
        bounds = [0]
        for text in texts:
            start = 0
            for end in lines_of(text):
                self.pieces.append(text[start:end])
                start = end
            bounds.append(len(self.pieces))
        self.lines = [p.strip() for p in self.pieces]
        self.bounds, n = np.array(bounds), len(self.lines)
        hashes = np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in self.lines), np.uint64, n)
        words = self.words = np.fromiter((x.count(" ") + 1 if x else 0 for x in self.lines), np.int64, n)

        of_line = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        start, stop, line = self.bounds[of_line], self.bounds[of_line + 1], np.arange(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(ROLL, n), dtype=np.uint64)])
        back = _powers(pow(ROLL, -1, M64 + 1), n)
        rolled = (sums[np.minimum(line + ROLLED, stop)] - sums[:-1]) * back
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(MIX)
        low = np.ones(n, bool)  # the first and last line of a text have boundaries
        inner = np.flatnonzero((line > start) & (line + 1 < stop))
        low[inner] = (rolled[inner] <= rolled[inner - 1]) | (rolled[inner] <= rolled[inner + 1])
        total = np.concatenate([[0], np.cumsum(words)])
        first = np.flatnonzero(low)
        least = np.maximum(np.searchsorted(total, total[first] + MIN_WORDS), first + MIN_LINES)
        self.first, self.end = first[least <= stop[first]], least[least <= stop[first]]
        self.place = self.first - start[self.first]
        self.owner = of_line[self.first]
        self.hash = (sums[self.end] - sums[self.first]) * back[self.first]

    def listed(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks at the places that `lists` has for each text, and where in its values each is."""
        owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        width = len(self.lines) + 1
        wanted = owner * width + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own = self.owner * width + self.place  # ascending
        at = np.searchsorted(own, wanted)
        there = np.flatnonzero(at < len(own))
        there = there[own[at[there]] == wanted[there]]
        return at[there], there

    def _covered(self, chunks: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.lines) + 1, np.int64)
        np.add.at(edge, self.first[chunks], 1)
        np.add.at(edge, self.end[chunks], -1)
        return np.cumsum(edge)[:-1] > 0

    def without(self, chunks: np.ndarray, kept: np.ndarray) -> tuple[list[str], list[int]]:
        """The texts without the lines of these chunks, but for those of the kept
        chunks; and how many percent of a text's words go."""
        gone = self._covered(chunks) & ~self._covered(kept)
        sums = np.concatenate([[0], np.cumsum(np.where(gone, self.words, 0))])
        whole = np.concatenate([[0], np.cumsum(self.words)])
        out, percent = [], []
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            some = gone[a:b]
            left = "".join(p for p, g in zip(self.pieces[a:b], some.tolist()) if not g)
            out.append(left.rstrip() if some.any() else left)
            percent.append(int(100 * (sums[b] - sums[a]) // max(1, whole[b] - whole[a])))
        return out, percent


def chunks_of(text: str) -> list[tuple[int, int, int]]:
    """(hash, first line, end line) of each chunk."""
    c = Chunks([text])
    return list(zip(c.hash.tolist(), c.first.tolist(), c.end.tolist()))


KEY = ["id", "version"]
#: Stands for no id; texts without one are the last.
NO_ID = M64 >> 1


def _key() -> tuple[Column, Column]:
    """id and version of a row; the version tells the texts of one id, or of none, apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.col("doc_id").isNull(), "text")


def chunk_rows(texts: DataFrame) -> DataFrame:
    """chunk (hash), id, version, place, and whether the text had it before, of every chunk of texts (id, version, text)."""

    def run(batches):
        tidy()
        for b in batches:
            values = b.column(2).to_pylist()
            for start, end in slices(values):
                c = Chunks(values[start:end])
                again = np.ones(len(c.hash), bool)
                order = np.lexsort((c.place, c.hash, c.owner))
                owner, hashes = c.owner[order], c.hash[order]
                again[order] = np.concatenate([np.zeros(1, bool)[: len(order)], (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])])
                at = pa.array(c.owner + start)
                columns = [pa.array(c.hash.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(c.place.astype(np.int32)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", *KEY, "place", "again"])

    return texts.mapInArrow(run, "chunk long, id long, version long, place int, again boolean")


def chunk_texts(listed: DataFrame) -> DataFrame:
    """chunk and bytes of the listed chunks of rows (text, places), each pair once for some texts."""

    def run(batches):
        tidy()
        for b in batches:
            values = b.column(0).to_pylist()
            for start, end in slices(values):
                c = Chunks(values[start:end])
                found, _ = c.listed(b.column(1).slice(start, end - start))
                pairs = zip(c.hash[found].view(np.int64).tolist(), c.first[found].tolist(), c.end[found].tolist())
                once = {(h, "\n".join(c.lines[f:e])) for h, f, e in pairs}
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in once], pa.int64()), pa.array([t for _, t in once], pa.string())], ["chunk", "bytes"])

    return listed.mapInArrow(run, "chunk long, bytes string")


def collided(listed: DataFrame) -> DataFrame:
    """The comparison of bytes: chunk hashes behind which different bytes stand.

    Equal pairs of hash and bytes fall together before and in the shuffle, so a
    chunk that many texts have costs no task more than a row from each task.
    """
    return chunk_texts(listed).distinct().groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")


def occurrences(texts: DataFrame) -> DataFrame:
    """id, version, chunk, place and whether it is the first, of the chunks that occur more than once."""
    rows = checkpoint(chunk_rows(texts))
    # written, so that the join below has two plain sides and Spark can split a chunk that many documents have
    repeated = checkpoint(rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("chunk", "first"))
    first = (F.col("id") == F.col("first")) & ~F.col("again")
    return rows.join(repeated.hint("merge"), "chunk").select(*KEY, "chunk", "place", first.alias("stays"))


def _lists(found: DataFrame) -> DataFrame:
    """id, version, places and stays of the chunks that a text shares; bounded by the text's own lines."""
    one = found.groupBy(*KEY).agg(F.collect_set(F.struct("place", "stays")).alias("l"))
    return checkpoint(one.select(*KEY, F.col("l.place").alias("places"), F.col("l.stays").alias("stays")))


def _marked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two further columns, whose names come too: the places of its
    repeated chunks, and which of them are first occurrences.  A merge join at
    every size: the lists grow with the documents, and this is the one shuffle of
    the texts."""
    of, version, places, stays = unused(docs, "of", "version", "places", "stays")
    key = dict(zip((of, version), _key()))
    found = occurrences(docs.where("text is not null").select(*(c.alias(k) for k, c in zip(KEY, _key())), "text"))

    def joined(found: DataFrame) -> DataFrame:
        lists = _lists(found).withColumnsRenamed({"id": of, "version": version, "places": places, "stays": stays})
        return checkpoint(docs.withColumns(key).join(lists.hint("merge"), [of, version], "left").drop(of, version))

    out = joined(found)
    bad = checkpoint(collided(out.where(F.col(places).isNotNull()).select("text", places)))
    if not bad.isEmpty():  # hashes that do not tell chunks apart remove nothing
        out = joined(found.join(broadcast_if_small(bad), "chunk", "left_anti"))
    return out, [places, stays]


def _cut(docs: DataFrame, percent: int) -> DataFrame:
    """docs with repeated chunks cut; rows without a first occurrence that lose `percent` of their words go."""
    bound_batches(docs.sparkSession, BATCH)
    marked, last = _marked(docs)
    names = docs.columns
    at = names.index("text")
    n_at = names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        tidy()
        for b in batches:
            columns, keep = list(b.columns), np.ones(b.num_rows, bool)
            changed = np.flatnonzero(columns[-1].is_valid().to_numpy(zero_copy_only=False)).tolist()
            if changed:
                texts, rows = columns[at].to_pylist(), pa.array(changed)
                lists, stays = columns[-2].take(rows), columns[-1].take(rows)
                some, lost = [texts[k] for k in changed], [0] * len(changed)
                for start, end in slices(some):
                    c = Chunks(some[start:end])
                    found, where = c.listed(lists.slice(start, end - start))
                    first = stays.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)[where].astype(bool)
                    some[start:end], lost[start:end] = c.without(found[~first], found[first])
                n = columns[n_at].to_pylist() if n_at >= 0 else None
                for k, text, share, first in zip(changed, some, lost, stays.to_pylist()):
                    if text != texts[k]:
                        keep[k] = share < percent or any(first)
                        if n is not None:
                            n[k] = len(text)
                    texts[k] = text
                columns[at] = pa.array(texts, columns[at].type)
                if n is not None:
                    columns[n_at] = pa.array(n, columns[n_at].type)
            out = pa.RecordBatch.from_arrays(columns[:-2], names)
            yield out if keep.all() else out.filter(pa.array(keep))

    return numbered(marked.select(*(F.col(f"`{c}`") for c in names), *last)).mapInArrow(run, docs.schema)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks cut from text, and n_chars (if there is such a column) set anew."""
    return _cut(docs, 101)


def drop_copies(docs: DataFrame, percent: int = COPY) -> DataFrame:
    """As `dedup`, without the rows that are copies: those that lose `percent` or
    more of their words, unless they hold the first occurrence of a chunk.  What
    is removed from other rows so still stands whole in a row that stays."""
    return _cut(docs, percent)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_before and n_after (code points), removed and text (cleaned) of every row."""
    before = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_before"))
    after = dedup(before)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return after.select("doc_id", "n_before", n.alias("n_after"), (n < F.col("n_before")).alias("removed"), "text")
