"""Exact Jaccard join of documents as sets of word shingles.

Jaccard distance is a metric.  Regions are Voronoi cells of pivots: a document
belongs to the pivot nearest to it.  With a threshold r, a document at distance
m from its own pivot is replicated to the region of every other pivot at m + 2 r
or nearer; what is 1 - 2 r or farther from all pivots is in one more region, the
outside.  By the triangle inequality two documents that link then meet in a
region.  Regions are joined recursively, with pivots of their own, until a
region is small, does not come apart or is one component.

In the space of shingle sets almost all distances are 1, and pivots for a whole
corpus would put nearly everything outside, level after level.  So an aid cuts
the corpus first, by a filter on rare shingles (prefix filtering), which is not
part of the metric method: in a global order of shingles, two documents that
link share one of the first n - ceil(t * n) + 1 shingles of each.

1. Aid.  The smallest id that has a leading shingle is that shingle's
   document.  Every document is compared with the one with which it shares the
   most, then with those that may still add to its component.
2. Aid.  The documents of shingles that are then in several components are put
   in order anew, by exact counts among themselves: an approximate order lets
   shingles that all copies of a text have lead where their own edits should.
   What has a leading shingle in common stays if sizes and the place of the
   shingle in both sets, then all leading shingles, leave a link open to another
   component.  Shingles that share such a document make one family.
3. Families are joined by Voronoi regions: a large one in rounds of the whole
   cluster, each dealing it over many tasks, and what is small in one task by
   recursion.  Where replication would leave more than SHRINK of a region's
   pairs to its own regions (near copies of one text are all near all pivots), a
   task compares pivot by pivot, and a large region is cut into blocks by hash:
   its largest component needs no comparison within itself, so its blocks meet
   only those of the other components' documents, which also meet each other.

Shingles are hashed (64 bits each, from hashes of whole words), but a link is
decided by the words themselves.  Every pair that can link is compared, or is
known to be connected, so the components are exact.  The order of shingles
comes from counts of a share of the shingles (by hash) in all documents, the
FREQUENT most frequent of them; it is approximate by count, the same
everywhere, and bears on speed alone.

Defined results: null or blank text has no shingles and links with nothing.
Fewer words than a shingle make one shingle of the whole text.  Equal texts are
joined once.  Rows with a null id have a null component; rows with one id are
one node.  Ids must be whole numbers.  Very long texts are read whole; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import SLICE_CHARS, PerWorker, broadcast_if_small, checkpoint, shuffles_dropped, unused
from gridweave.llm.components import components

#: Frequent shingles whose counts go out with the order, at most.
FREQUENT = 500_000
#: Count from which a shingle is frequent, and the one that stands for a count not taken.
OFTEN, UNCOUNTED = 3, 20
#: Shingles that a worker counts before it reports.
LOCAL_SHINGLES = 1_000_000
#: Documents of a region that one task joins, and of one that is compared pair by pair there.
REGION, LEAF = 1500, 24
#: Pivots of a region, about; rounds of the cluster; and the share of a region's pairs that its own regions may have together.
PIVOTS, ROUNDS, SHRINK = 16, 6, 0.5
#: Words whose hashes a worker remembers.
CACHE_WORDS = 500_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """Sets of 64-bit shingle hashes, sorted; a shingle's is mixed from its
    words', which are hashes of their bytes."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.digest, self.known = width, xxhash.xxh3_64_intdigest, {}

    def words(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        try:
            return np.array([known[w] for w in found], np.uint64)
        except KeyError:
            known.update((w, self.digest(w)) for w in set(found) if w not in known)
        return np.array([known[w] for w in found], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        return distinct(self.mixed(h, min(self.width, len(h)))) if len(h) else h

    @staticmethod
    def mixed(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + n]) * np.uint64(MIX[k % len(MIX)])
            out ^= out >> np.uint64(29)
        return out

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The sets of an Arrow column of texts: its words are told apart and
        numbered all at once, and each different one is hashed once."""
        ends, h = split_words(texts, self.digest)
        whole = self.mixed(h, self.width) if len(h) >= self.width else np.zeros(0, np.uint64)
        out = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            if b - a >= self.width:
                out.append(distinct(whole[a : b - self.width + 1]))
            else:
                out.append(self.mixed(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, which is slower on short arrays."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(1, bool), x[1:] != x[:-1]])] if len(x) else x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def split_words(texts: pa.Array, digest) -> tuple[np.ndarray, np.ndarray]:
    """For each text of an Arrow column where its words end among all words, and the hashes of all words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    word = ~IS_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[1:-1] - offsets[0]
    edges = edges[edges < len(raw)]
    begins[edges] = word[edges]  # a text's first character does not go on with the text before
    last = word.copy()
    last[:-1] &= begins[1:] | ~word[1:]
    starts = np.flatnonzero(begins)
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.flatnonzero(last) - starts + 1)])
    bytes_ = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[word])])
    numbered = bytes_.dictionary_encode()
    each = np.fromiter(map(digest, numbered.dictionary.to_pylist()), np.uint64, len(numbered.dictionary))
    return np.searchsorted(starts, offsets[1:] - offsets[0]), each[numbered.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)


def parts_of(texts: pa.Array, limit: int = SLICE_CHARS):
    """(start, end) ranges of at most `limit` bytes of text, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield start, end
        start = end


def really_link(a: str | None, b: str | None, width: int, percent: int) -> bool:
    """Whether two texts link, by their words and not by hashes of them."""
    number: dict[bytes, int] = {}
    sides = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in (a, b)]
    if min(map(len, sides)) == 0:
        return False
    if min(map(len, sides)) < width:  # one of the sets is a single, shorter shingle
        return len(sides[0]) == len(sides[1]) and bool((sides[0] == sides[1]).all())
    sets = [x[: len(x) - width + 1] for x in sides]
    for k in range(1, width):  # numbers of the shingles of k + 1 words, from those of k
        pairs = np.concatenate([x * len(number) + y[k : k + len(x)] for x, y in zip(sets, sides)])
        flat = np.unique(pairs, return_inverse=True)[1]
        sets = [flat[: len(sets[0])], flat[len(sets[0]) :]]
    own, other = map(np.unique, sets)
    return bool(links(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other), percent))


def links(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Whether sets of sizes a and b with so many shared members link."""
    return 100 * shared >= percent * (a + b - shared)


def share_counted(percent: int) -> float:
    """Share of all shingles, those of the lowest hashes, whose counts are taken:
    twice what leads a set, so that there is a choice."""
    return min(1.0, 2 * (1 - percent / 100) + 0.01)


def frequent_shingles(texts: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent of the counted shingles, at most FREQUENT."""
    make = PerWorker(texts.sparkSession, Shingler, width)
    limit = np.uint64(min(int(share_counted(percent) * 2.0**64), (1 << 64) - 1))

    def count(batches):
        shingler, held, size = make.get(), [], 0

        def report():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["shingle", "n"])

        for b in batches:
            texts = b.column(0)
            for start, end in parts_of(texts):
                for members in shingler.many(texts.slice(start, end - start)):
                    held.append(members[: np.searchsorted(members, limit)].copy())
                    size += len(held[-1])
                if size > LOCAL_SHINGLES:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    with shuffles_dropped(texts.sparkSession):
        counts = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        rows = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    hashes, n = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


class Order:
    """Leading shingles of a set in the global order: by count (UNCOUNTED where
    it was not taken), then by hash."""

    def __init__(self, width: int, percent: int, hashes: np.ndarray, counts: np.ndarray):
        self.shingler, self.percent, self.hashes, self.counts = Shingler(width), percent, hashes, counts
        self.limit = np.uint64(min(int(share_counted(percent) * 2.0**64), (1 << 64) - 1))

    def leading(self, members: np.ndarray) -> np.ndarray:
        keep = len(members) - -(-self.percent * len(members) // 100) + 1
        often = np.where(members < self.limit, 0, UNCOUNTED)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, members), len(self.hashes) - 1)
            often = np.where(self.hashes[at] == members, self.counts[at], often)
        return members[np.argsort(often, kind="stable")[:keep]]


def leading_shingles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, same, n (set size) and keys (leading shingles) of each row of docs (id, same, text)."""
    make = PerWorker(docs.sparkSession, Order, width, percent, *frequent_shingles(docs, width, percent))

    def run(batches):
        order = make.get()
        for b in batches:
            texts = b.column(2)
            for start, end in parts_of(texts):
                sets = order.shingler.many(texts.slice(start, end - start))
                keys = [order.leading(s) if len(s) else s for s in sets]
                ends = np.cumsum([0, *map(len, keys)])
                flat = pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                columns = [b.column(0)[start:end], b.column(1)[start:end], pa.array([len(s) for s in sets], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "same", "n", "keys"])

    return docs.mapInArrow(run, "id long, same string, n long, keys array<long>")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can link by their sizes and leading shingles.

    Of two sets, one's leading shingles end first; what they share beyond that
    place is in that set's rest.
    """
    side = lambda x: sets.where("id is not null").select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"))
    rest = lambda x: F.col(f"n_{x}") - F.size(f"keys_{x}")
    most = F.size(F.array_intersect("keys_a", "keys_b")) + F.greatest(rest("a"), rest("b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    left = side("a").join(broadcast_if_small(pairs), "a")
    right = side("b").join(broadcast_if_small(pairs.select("b").distinct()), "b", "left_semi")
    # not made distinct here: then the join could not be split, and pairs come once already
    return left.join(right, "b").where(sizes & (most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def by_exact_counts(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """region (a shingle), id, component, n (set size) and rest of the documents
    of members (id, component), for each leading shingle that two of them have,
    in the order of its count among them.  rest: the set's shared shingles from
    there on, which is all that it can share with a document where this is the
    first common one."""
    make = PerWorker(members.sparkSession, Shingler, width)

    def run(batches):
        shingler = make.get()
        for b in batches:
            texts = b.column(3)
            for start, end in parts_of(texts):
                sets = shingler.many(texts.slice(start, end - start))
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                columns = [b.column(k)[start:end] for k in range(3)]
                columns += [pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "component", "n", "keys"])

    # an id may have several texts, each a set of its own
    rows = texts.join(broadcast_if_small(members), "id").select(F.monotonically_increasing_id().alias("row"), "id", "component", "text")
    rows = checkpoint(rows.mapInArrow(run, "row long, id long, component long, n long, keys array<long>"))
    each = rows.select("row", F.explode("keys").alias("key"))
    counts = checkpoint(each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    # shingles of one set alone come first in the order, and lead to nothing
    shared = checkpoint(each.join(counts, "key").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared")))
    lead = F.expr(f"slice(shared, 1, greatest(0, int(size(shared) - ({percent} * n + 99) div 100 + 1)))")
    placed = rows.drop("keys").join(shared, "row").select("id", "component", "n", F.size("shared").alias("all"), F.posexplode(lead).alias("place", "first"))
    return checkpoint(placed.select(F.col("first.key").alias("region"), "id", "component", "n", (F.col("all") - F.col("place")).alias("rest")))


def able(placed: DataFrame, percent: int) -> DataFrame:
    """Those of the placed documents (region, id, component, n, rest) that can
    link with one of another component in the region, by n and rest.

    No pairs are made.  Of the documents of one size the one with most rest can
    link if any can, and that of another component where it is of one's own, so
    a region's documents meet two for each size in it.
    """
    sizes = placed.groupBy("region", "n", "component").agg(F.max("rest").alias("rest"))
    most = Window.partitionBy("region", "n").orderBy(F.desc("rest"), "component")
    two = sizes.withColumn("place", F.row_number().over(most)).where("place <= 2")
    best = checkpoint(two.groupBy("region").agg(F.collect_list(F.struct("n", "rest", "component")).alias("best")).where("size(best) > 1"))
    open_ = F.expr(f"exists(best, b -> b.component != component and {percent} * (n + b.n) <= {100 + percent} * least(rest, b.rest))")
    return checkpoint(placed.join(best, "region").where(open_).select("region", "id", "component").distinct())


def compare(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; texts has id and text."""
    make = PerWorker(pairs.sparkSession, Shingler, width)
    pairs = checkpoint(possible(pairs, sets, percent))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(broadcast_if_small(pairs), "a")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(broadcast_if_small(pairs.select("b").distinct()), "b", "left_semi")
    joined = left.join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        shingler, pivots = make.get(), {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                y = y.as_py()
                other = pivots.get(b[k])
                if other is None or other[0] != y:
                    if len(pivots) > 64:
                        pivots.clear()
                    other = pivots[b[k]] = (y, shingler(y))
                own = shingler(x.as_py())
                shared = len(np.intersect1d(own, other[1], assume_unique=True))
                if links(shared, len(own), len(other[1]), percent) and really_link(x.as_py(), y, width, percent):
                    hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in hit], pa.int64()), pa.array([b[k] for k in hit], pa.int64())], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def counted(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pivot: int) -> np.ndarray:
    """How many members each set shares with that of `pivot`; sets stand one after the other in flat."""
    mark = np.zeros(int(flat.max()) + 1, bool)
    mark[flat[starts[pivot] : starts[pivot] + sizes[pivot]]] = True
    return np.add.reduceat(mark[flat], starts, dtype=np.int64)


class Region:
    """Joins a region's sets in memory; gives links that connect all that is
    connected within it.

    part: of two blocks, the block of each member; pairs within a block are
    then left to that block's own region.  label: components known before.
    check: decides on a pair whose hashes say that it links.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, part: np.ndarray | None = None, label: list | None = None, check=None):
        self.sizes, self.percent, self.reach = np.array([len(s) for s in sets], np.int64), percent, 1 - percent / 100 + 1e-9
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, int)
        self.comp = np.unique(np.array(label), return_inverse=True)[1] if label is not None else np.arange(len(sets))
        self.part, self.check, self.found, self.compared = part, check or (lambda i, j: True), [], 0
        members = np.flatnonzero(self.sizes > 0)
        if len(members) > 1:
            starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
            self.join(members, self.flat, starts[members], ())

    def settled(self, members: np.ndarray) -> bool:
        return bool((self.comp[members] == self.comp[members[0]]).all())

    def distances(self, members, flat, starts, at: int, window: np.ndarray | None = None) -> np.ndarray:
        """Distances of the members (of those in the window; NaN for others) to
        the one at place `at`; those that link with it are joined."""
        pivot, some = int(members[at]), None
        if window is not None and 2 * np.count_nonzero(window) < len(members):
            some = np.flatnonzero(window)
            some = np.concatenate([[at], some[some != at]])
            members, (flat, starts), at = members[some], self.taken(flat, starts, members, some), 0
        sizes = self.sizes[members]
        shared = counted(flat, starts, sizes, at)
        self.compared += len(members)
        hit = links(shared, sizes, sizes[at], self.percent) & (self.comp[members] != self.comp[pivot])
        if self.part is not None:
            hit &= self.part[members] != self.part[pivot]
        for k in members[hit].tolist():
            if self.comp[k] != self.comp[pivot] and self.check(pivot, k):
                self.found.append((pivot, k))
                self.comp[self.comp == self.comp[k]] = self.comp[pivot]
        d = 1 - shared / (sizes + sizes[at] - shared)
        if some is None:
            return d
        out = np.full(len(window), np.nan)
        out[some] = d
        return out

    def taken(self, flat, starts, members, some) -> tuple[np.ndarray, np.ndarray]:
        """flat and starts of some of the members alone."""
        lengths = self.sizes[members[some]]
        ends = np.cumsum(lengths)
        return flat[np.repeat(starts[some] - ends + lengths, lengths) + np.arange(ends[-1])], ends - lengths

    def join(self, members: np.ndarray, flat: np.ndarray, starts: np.ndarray, known: tuple) -> None:
        """known: distances of the members to earlier pivots."""
        if len(members) < 2 or self.settled(members):
            return
        if len(members) <= LEAF:
            self.pairs(members, flat, starts, known)
            return
        table, chosen, at = [], [], 0
        nearest = np.full(len(members), 2.0)
        for _ in range(PIVOTS):
            d = self.distances(members, flat, starts, at)
            table.append(d)
            chosen.append(at)
            nearest = np.minimum(nearest, d)
            nearest[chosen] = -1
            at = int(nearest.argmax())  # the next pivot is the member farthest from those before
        if self.settled(members):
            return
        d = np.array(table)
        least = d.min(axis=0)
        cells = [np.flatnonzero((row <= least + 2 * self.reach) & (row < 1)) for row in d]
        cells.append(np.flatnonzero(least >= 1 - 2 * self.reach))
        cells = [c for c in cells if len(c) > 1 and not self.settled(members[c])]
        known = (known + tuple(table))[-PIVOTS:]
        if sum(len(c) ** 2 for c in cells) > SHRINK * len(members) ** 2:
            self.pairs(members, flat, starts, known)
            return
        for cell in cells:
            own, first = self.taken(flat, starts, members, cell)
            own = np.unique(own, return_inverse=True)[1]
            self.join(members[cell], own, first, tuple(x[cell] for x in known))

    def pairs(self, members, flat, starts, known: tuple) -> None:
        """One pivot after the other; the distances to earlier ones narrow its window."""
        open_, known = np.ones(len(members), bool), list(known)
        while open_.any():
            # a pivot from the smallest component: what stays to the end is then one component, which needs no comparison
            ids, count = np.unique(self.comp[members[open_]], return_counts=True)
            if len(ids) == 1:
                return
            at = int(np.flatnonzero(open_ & (self.comp[members] == ids[count.argmin()]))[0])
            open_[at] = False
            window = open_ & (self.comp[members] != self.comp[members[at]])
            if self.part is not None:
                window &= self.part[members] != self.part[members[at]]
            for d in known[-PIVOTS:]:
                window &= ~(np.abs(d - d[at]) > self.reach)  # unknown distances are NaN and exclude nothing
            if window.any():
                known.append(self.distances(members, flat, starts, at, window))


def join_region(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None, label: list | None = None, check=None) -> list[tuple[int, int]]:
    return Region(sets, percent, part, label, check).found


REGION_KEY = ["region", "low", "high"]


def _cut(members: DataFrame, region: int | None = None) -> DataFrame:
    """members (region, id, component, size of the region) dealt to tasks: a
    region as a whole, or a large one as pairs of its blocks.  Blocks of its
    largest component meet only blocks of the others."""
    region = region or REGION
    half = max(1, region // 2)
    parts = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"))
    main = checkpoint(main)
    at = members.join(broadcast_if_small(main), "region")
    others = F.ceil((F.col("size") - F.col("n_main")) / half).cast("int")
    mains = F.ceil(F.col("n_main") / half).cast("int")
    single, is_main = F.col("size") <= region, F.col("component") == F.col("main")
    own = F.when(single, 0).when(is_main, others + F.pmod(F.xxhash64("id"), mains).cast("int")).otherwise(F.pmod(F.xxhash64("id"), F.greatest(others, F.lit(1))).cast("int"))
    last = F.when(is_main, others - 1).otherwise(others + mains - 1)
    other = F.when(single, F.array(F.lit(0))).when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    dealt = at.withColumn("own", own).withColumn("other", F.explode(other))
    return dealt.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "component", "id")


def _each_region(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(held rows) for each region in turn; rows begin with region, low, high."""

    def run(batches):
        now, held = None, []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            columns = [b.column(k) for k in range(3, b.num_columns)]
            for k, key in enumerate(keys):
                if key != now:
                    if len(held) > 1:
                        yield from work(now, held)
                    now, held = key, []
                held.append([c[k].as_py() for c in columns])
        if len(held) > 1:
            yield from work(now, held)

    return rows.repartition(*REGION_KEY).sortWithinPartitions(*REGION_KEY, "id").mapInArrow(run, schema)


def hopeful(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the dealt members that can link, by sizes and leading shingles,
    with a member of another component."""

    def work(key, held):
        n = np.array([h[3] for h in held])
        part, comp = np.array([h[0] for h in held]), np.unique([h[1] for h in held], return_inverse=True)[1]
        keys = [np.array(h[4], np.int64) for h in held]
        flat = np.unique(np.concatenate(keys), return_inverse=True)[1]
        lengths = np.array([len(k) for k in keys])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mark, rest, hit = np.zeros(flat.max() + 1, bool), n - lengths, np.zeros(len(held), bool)
        for k in range(len(held)):
            own = flat[starts[k] : starts[k] + lengths[k]]
            mark[own] = True
            most = np.add.reduceat(mark[flat], starts, dtype=np.int64) + np.maximum(rest, rest[k])
            mark[own] = False
            ok = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])) & (most * (100 + percent) >= percent * (n + n[k]))
            if part.min() != part.max():
                ok &= part != part[k]
            hit |= ok
            hit[k] |= ok.any()
        if hit.any():
            chosen = [held[k] for k in np.flatnonzero(hit)]
            columns = [[x] * len(chosen) for x in key] + [[h[c] for h in chosen] for c in range(3)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], [*REGION_KEY, "own", "component", "id"])

    known = sets.where("id is not null and n > 0").select("id", "n", "keys")
    rows = known.join(broadcast_if_small(members), "id").select(*REGION_KEY, "own", "component", "id", "n", "keys")
    return _each_region(rows, work, "region long, low int, high int, own int, component long, id long")


def families(members: DataFrame) -> DataFrame:
    """region, id, component and size of the regions that come of merging those
    that share a document: it is sent to one then, not to one for each shingle."""
    ids = members.select("region", "id", "component").distinct()
    first = checkpoint(ids.groupBy("region").agg(F.min("id").alias("first")))
    edges = ids.join(first, "region").select(F.col("id").alias("a"), F.col("first").alias("b"))
    merged = ids.select("id", F.col("component").alias("of")).distinct().join(checkpoint(components(edges).withColumnRenamed("component", "region")), "id")
    return _sized(checkpoint(merged.select("region", "id", F.col("of").alias("component"))))


def _sized(members: DataFrame) -> DataFrame:
    """members (region, id, component) of regions with several components, and each region's size."""
    sizes = checkpoint(members.groupBy("region").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("region", "size"))
    return checkpoint(members.join(broadcast_if_small(sizes), "region").select("region", "id", "component", "size"))


def to_pivots(members: DataFrame, texts: DataFrame, width: int, percent: int, level: int) -> DataFrame:
    """Voronoi regions of large regions (region, id, component, size): a row for
    each document with the pivots whose regions it enters (cells; -1 is the
    outside) and those that it links with (hits).

    Pivots are drawn by a hash of the id, and one is the least by that hash; a
    region's documents are dealt over tasks, and each task gets the pivots.
    """
    make, reach = PerWorker(members.sparkSession, Shingler, width), 1 - percent / 100 + 1e-9
    draw = F.xxhash64(F.lit(level), "id")
    parts = F.ceil(F.col("size") / (REGION // 2)).cast("int")
    rows = checkpoint(texts.join(broadcast_if_small(members), "id").select("region", "id", "size", "text", draw.alias("draw")))
    least = checkpoint(rows.groupBy("region").agg(F.min("draw").alias("least")))
    drawn = rows.join(broadcast_if_small(least), "region").where((F.pmod("draw", F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1))) == 0) | (F.col("draw") == F.col("least")))
    pivots = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("region", "part", F.lit(0).alias("kind"), "id", "text")
    dealt = pivots.union(rows.select("region", F.pmod(F.xxhash64("id"), parts).cast("int"), F.lit(1), "id", "text"))

    def run(batches):
        shingler, now = make.get(), None
        for b in batches:
            out = []
            for region, part, kind, id_, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (region, part) != now:
                    now, held, table = (region, part), [], None
                if kind == 0:
                    held.append((id_, text, shingler(text)))
                    continue
                if table is None:
                    every = np.unique(np.concatenate([h[2] for h in held]))
                    table = np.array([np.isin(every, h[2], assume_unique=True) for h in held]).T
                    sizes = np.array([len(h[2]) for h in held])
                own = shingler(text)
                at = np.minimum(np.searchsorted(every, own), len(every) - 1)
                shared = table[at[every[at] == own]].sum(axis=0)
                d = 1 - shared / (sizes + len(own) - shared)
                cells = [held[k][0] for k in np.flatnonzero((d <= d.min() + 2 * reach) & (d < 1))]
                if d.min() >= 1 - 2 * reach:
                    cells.append(-1)
                hits = [held[k][0] for k in np.flatnonzero(links(shared, sizes, len(own), percent)) if held[k][0] != id_ and really_link(text, held[k][1], width, percent)]
                out.append((region, id_, cells, hits))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["region", "id", "cells", "hits"])

    ordered = dealt.repartition("region", "part").sortWithinPartitions("region", "part", "kind", "id")
    return checkpoint(ordered.mapInArrow(run, "region long, id long, cells array<long>, hits array<long>"))


def join_families(members: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b), those of `found` included, after joining families (region, id, component, size)."""
    ready = None
    for level in range(ROUNDS):
        small = members.where(F.col("size") <= REGION)
        ready = small if ready is None else ready.union(small)
        large = members.where(F.col("size") > REGION)
        if large.isEmpty():
            break
        near = to_pivots(large, texts, width, percent, level)
        found = checkpoint(found.union(near.select(F.col("id").alias("a"), F.explode("hits").alias("b"))))
        known = checkpoint(components(found))
        cells = near.select("region", "id", F.explode("cells").alias("cell")).join(broadcast_if_small(known), "id", "left")
        cells = cells.select(F.xxhash64("region", "cell").alias("region"), "id", F.coalesce("component", "id").alias("component"), F.col("region").alias("of"))
        cells = checkpoint(cells)
        parents = checkpoint(cells.select("region", "of").distinct())
        members = checkpoint(_sized(cells.drop("of")))
        pairs = members.groupBy("region").agg(F.max("size").alias("size")).join(parents, "region").groupBy("of").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
        before = large.groupBy("region").agg(F.max("size").alias("before")).withColumnRenamed("region", "of")
        stuck = checkpoint(before.join(pairs, "of").where(F.col("pairs") > SHRINK * F.col("before") * F.col("before")).select("of"))
        if not stuck.isEmpty():  # these are cut as they were, with the components known now
            again = large.join(broadcast_if_small(stuck.withColumnRenamed("of", "region")), "region").drop("component").join(broadcast_if_small(known), "id", "left")
            ready = ready.union(_sized(again.select("region", "id", F.coalesce("component", "id").alias("component"))))
            gone = checkpoint(parents.join(broadcast_if_small(stuck), "of").select("region"))
            members = checkpoint(members.join(broadcast_if_small(gone), "region", "left_anti"))
    else:
        ready = ready.union(members)
    last = checkpoint(join_regions(checkpoint(_cut(checkpoint(ready))), texts, width, percent))
    return found.union(last)


def join_regions(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within regions of dealt members."""
    make = PerWorker(members.sparkSession, Shingler, width)

    def work(key, held):
        part = np.array([h[0] for h in held])
        shingler = make.get()
        check = lambda i, j: really_link(held[i][3], held[j][3], width, percent)
        hit = join_region([shingler(h[3]) for h in held], percent, part if part.min() != part.max() else None, [h[1] for h in held], check)
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][2] for i, _ in hit], pa.int64()), pa.array([held[j][2] for _, j in hit], pa.int64())], ["a", "b"])

    few = broadcast_if_small(members)
    if few is members:  # dealt to several tasks; the documents themselves may be few
        texts = texts.join(broadcast_if_small(members.select("id").distinct()), "id", "left_semi")
    rows = texts.join(few, "id").select(*REGION_KEY, "own", "component", "id", "text")
    return _each_region(rows, work, "a long, b long")


def components_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, same (hash of the text), n_shingles, component_id for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("same"), "text")
    ids = checkpoint(rows.select("id", "same"))
    # written, here and below, so that a join has two plain sides and Spark can split a hot key
    copies = checkpoint(ids.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    later = checkpoint(ids.join(copies, "same").where("id != first").select("id", "same"))  # not made distinct here: then the join could not be split
    # a join of texts that can't be a broadcast would shuffle the corpus: then narrow tables are joined in its place
    few = broadcast_if_small(later)
    if few is later:
        sets = checkpoint(checkpoint(leading_shingles(rows, width, percent)).join(later, ["id", "same"], "left_anti"))
    else:
        sets = checkpoint(leading_shingles(rows.join(few, ["id", "same"], "left_anti"), width, percent))
    keys = sets.where("id is not null").select("id", F.explode("keys").alias("key"))

    pivots = checkpoint(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"))
    near = checkpoint(keys.join(pivots, "key"))
    named = rows.where("id is not null").select("id", "text", "same")
    wanted = near.select("id").distinct()
    if few is not later and broadcast_if_small(wanted) is wanted:
        texts = named.join(few, ["id", "same"], "left_anti").drop("same")  # not written; what is compared is picked from it by broadcasts
    else:
        kept = checkpoint(sets.select("id", "same").distinct().join(broadcast_if_small(wanted), "id", "left_semi"))
        texts = checkpoint(named.join(broadcast_if_small(kept), ["id", "same"], "left_semi").drop("same"))

    pairs = checkpoint(near.where("id != pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("n")))
    nearest = pairs.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    found = checkpoint(compare(nearest, sets, texts, width, percent))
    known = checkpoint(components(found))
    apart = _apart(pairs.join(nearest, ["a", "b"], "left_anti").select("a", "b"), known)
    further = checkpoint(compare(apart, sets, texts, width, percent))
    if not further.isEmpty():
        found = found.union(further)
        known = checkpoint(components(found))

    # what a shingle's other documents have in common is not compared yet
    labelled = near.where("id != pivot").join(broadcast_if_small(known), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = checkpoint(labelled)
    ends = [F.min("component").alias("low"), F.max("component").alias("high")]
    open_ = labelled.groupBy("key").agg(*ends).where("low != high").select("key")
    members = checkpoint(labelled.join(open_, "key").select("id", "component").distinct())
    if not members.isEmpty():
        members = able(by_exact_counts(members, texts, width, percent), percent)
        signature = [F.count("*").alias("size"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 31))).alias("y")]
        # shingles with the same documents are one region
        regions = members.groupBy("region").agg(*signature, *ends).where("low != high").groupBy("size", "x", "y").agg(F.min("region").alias("region")).select("region", "size")
        members = checkpoint(members.join(checkpoint(regions), "region").select("region", "id", "component", "size"))
    if not members.isEmpty():
        kept = families(checkpoint(hopeful(checkpoint(_cut(members, REGION // 3)), sets, percent)))
        known = checkpoint(components(join_families(kept, found, texts, width, percent)))

    n = sets.groupBy("same").agg(F.min("id").alias("first"), F.max("n").alias("n_shingles"))
    labels = checkpoint(n.join(known.withColumnRenamed("id", "first"), "first", "left").select("same", "n_shingles", F.coalesce("component", "first").alias("component")))
    return ids.join(labels, "same").select(
        F.col("id").alias("doc_id"), "same", "n_shingles", F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be in one component."""
    known = broadcast_if_small(known)
    a = known.select(F.col("id").alias("a"), F.col("component").alias("of_a"))
    b = known.select(F.col("id").alias("b"), F.col("component").alias("of_b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    return components_of(docs, width, percent).drop("same")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of its smallest id.  Rows without an id,
    and rows without shingles, all stay; of equal rows one stays."""
    labels = checkpoint(components_of(docs, width, percent))
    gone = labels.where("doc_id != component_id").select("doc_id", "same")
    again = labels.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id", "same").count().where("count > 1")
    of, same = unused(docs, "of", "same")
    # both are the types of labels, whatever those of docs
    marked = docs.withColumns({of: F.col("doc_id").cast("long"), same: F.coalesce(F.sha2("text", 256), F.lit(""))})
    left = marked.join(broadcast_if_small(gone.select(F.col("doc_id").alias(of), F.col("same").alias(same))), [of, same], "left_anti")
    if not again.isEmpty():
        once = F.coalesce(F.col(of).isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        left = left.where(~once).unionByName(left.where(once).dropDuplicates([of, same]))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
