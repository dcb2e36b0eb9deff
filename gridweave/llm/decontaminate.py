"""Benchmark decontamination by template canonicalisation.

Numbers, units and names are replaced by typed placeholders, so that a question
asked with other parameters has the same template.  Windows of five template
words (or of the whole item, if it is shorter) are hash-joined with those of the
benchmark.  A window of which less than half is plain would match anything; it
stands for its very words, so that exact copies of every item are found.

On a diagonal (a fixed distance between the places in document and item) the
slots must be consistent both ways: equal fillings in the item stand for equal
fillings in the document, and different ones for different ones; windows of
other diagonals do not count.  A document holds an item if 0.8 or more of the
item's windows match on one diagonal, or on several that have one filling in
common (words put in or left out move what follows to another diagonal).

Everything runs as Spark expressions: no Python on the executors.  The windows
of all documents meet the different windows of the benchmark first, which are
broadcast if their counted number allows it and shuffled otherwise.  An item is
looked for in a document only if one of its rarest windows (by places in all
documents, as many as make 0.8 of the item impossible without one of them) is
there, so that phrases common to many items multiply nothing.

Rules of the template, word by word (words are cut at white space; characters
that are neither letters nor digits are dropped at both ends, unless there is
nothing else):
  number: begins with a digit;
  unit:   one of UNITS right after a number;
  name:   begins with a capital and a small letter, is not the first word, and
          the word before does not end a sentence;
  else the word in lower case.
A window that begins with a name counts as one that begins with that word too.

Defined results: null and blank texts match nothing.  Rows with equal id and
text are one document or item; a null id counts as an id, and rows of one id
with different texts are different documents or items.  Empty tables give no
rows.  Very long texts are read whole.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import broadcast_if_small, checkpoint, unused
from gridweave.llm.secrets import let

WIDTH, SHARE = 5, 80
#: Different windows of the benchmark that may be broadcast (a hash each).
BROADCAST_WINDOWS = 1_000_000
# Units, after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "hrs", "ms", "hz", "khz", "mhz", "ghz",
         "w", "kw", "mw", "j", "kj", "cal", "kcal", "v", "a", "n", "pa", "kpa", "c", "f", "k", "kb", "mb", "gb", "tb", "percent", "usd", "eur", "gbp", "dollars", "euros", "pounds", "cents",
         "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "degrees")
BLANK = " \t\n\r\f"
NUMBER = r"^[^\p{L}\p{N}]*[0-9]"
NAME = r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}"
SENTENCE_END = r"[.!?:][^\p{L}\p{N}]*$"
BARE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?|^[^\p{L}\p{N}]+$"
SLOTS = ("<num>", "<unit>", "<name>")


def words(text: Column) -> Column:
    return F.split(F.trim(text, F.lit(BLANK)), f"[{BLANK}]+")


def bare(word: Column) -> Column:
    return F.lower(F.regexp_extract(word, BARE, 0))


def template_word(word: Column, before: Column) -> Column:
    return (
        F.when(word.rlike(NUMBER), SLOTS[0])
        .when(before.rlike(NUMBER) & bare(word).isin(*UNITS), SLOTS[1])
        .when(word.rlike(NAME) & before.isNotNull() & ~before.rlike(SENTENCE_END), SLOTS[2])
        .otherwise(bare(word))
    )


def template(text: Column) -> Column:
    """Template words of a text, one for each of its words."""
    return let(words(text), _template)


def _template(w: Column) -> Column:
    return F.transform(w, lambda x, i: template_word(x, F.get(w, i - 1)))


def _coded(w: Column) -> Column:
    """Hashes of each word: t of its template word, b of the bare word."""
    numbers = lambda n: F.transform(w, lambda x, i: let(bare(x), lambda c: F.struct(_code(x, c, F.get(w, i - 1), F.get(n, i), F.get(n, i - 1)).alias("t"), F.xxhash64(c).alias("b"))))
    return let(F.transform(w, lambda x: x.rlike(NUMBER)), numbers)


def _code(word: Column, bared: Column, before: Column, number: Column, after_number: Column) -> Column:
    """The hash of template_word, with what is known already."""
    slots = [F.xxhash64(F.lit(s)) for s in SLOTS]
    name = before.isNotNull() & word.rlike(NAME) & ~before.rlike(SENTENCE_END)
    return F.when(number, slots[0]).when(after_number & bared.isin(*UNITS), slots[1]).when(name, slots[2]).otherwise(F.xxhash64(bared))


def windows(text: Column, widths: list[int]) -> Column:
    """(at, hash) of the window at each place of a text's template, for each of the widths."""

    def of(c: Column) -> Column:
        slots = F.transform(c, lambda x: x["t"].isin(*(F.xxhash64(F.lit(s)) for s in SLOTS)).cast("int"))
        return let(slots, lambda s: F.flatten(F.array(*[_windows(c, s, n) for n in widths])))

    return let(words(text), lambda w: let(_coded(w), of))


def _windows(c: Column, slots: Column, width: int) -> Column:
    def hashed(i: Column, first: Column, filled: Column) -> Column:
        own = [first, *(F.get(c, i + k)["t"] for k in range(1, width))]
        very = F.xxhash64(F.lit(-width), *(F.get(c, i + k)["b"] for k in range(width)))
        return F.struct(i.alias("at"), F.when(2 * (width - filled) >= width, F.xxhash64(F.lit(width), *own)).otherwise(very).alias("hash"))

    last = F.size(c) - width
    places = F.sequence(F.lit(0), last)
    count = lambda i: sum((F.get(slots, i + k) for k in range(1, width)), F.get(slots, i))
    # an item's first word is plain, but its capital makes it a name in the middle of a document's sentence
    names = F.filter(places, lambda i: F.get(c, i)["t"] == F.xxhash64(F.lit(SLOTS[2])))
    both = F.concat(F.transform(places, lambda i: hashed(i, F.get(c, i)["t"], count(i))), F.transform(names, lambda i: hashed(i, F.get(c, i)["b"], count(i) - 1)))
    return F.when(last >= 0, both).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def _texts(df: DataFrame, id_: str, key: str) -> DataFrame:
    """id, text and a key of each different row with words."""
    some = df.select(id_, "text").where(F.col("text").isNotNull() & (F.trim("text", F.lit(BLANK)) != ""))
    return some.withColumn(key, F.xxhash64(F.col(id_).isNull(), id_, "text"))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, item (key), at, hash and n_windows (different ones of the item)."""
    own = _texts(items, "item_id", "item").withColumn("n", F.least(F.size(words(F.col("text"))), F.lit(WIDTH)))
    cut = None
    for n in range(1, WIDTH + 1):
        part = own.where(F.col("n") == n).select("item_id", "item", F.explode(windows(F.col("text"), [n])).alias("w")).select("item_id", "item", "w.at", "w.hash")
        cut = part if cut is None else cut.union(part)
    cut = cut.distinct()
    return checkpoint(cut.join(cut.groupBy("item").agg(F.countDistinct("hash").alias("n_windows")), "item"))


def _enough(n: str) -> Column:
    return 100 * F.col(n) >= SHARE * F.col("n_windows")


def candidates(there: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc, item) where one of the item's rarest windows is in the document."""
    seen = there.groupBy("hash").agg(F.count("*").alias("seen"))
    each = bench.select("item", "hash", "n_windows").distinct().join(seen, "hash", "left")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("seen", F.lit(0)), "hash"))  # bounded by an item's words
    needed = F.ceil(F.col("n_windows") * SHARE / F.lit(100.0))
    rare = each.withColumn("place", place).where(F.col("place") <= F.col("n_windows") - needed + 1)
    rare = checkpoint(rare.where("seen is not null").select("item", "hash"))
    return checkpoint(there.select("doc", "hash").join(broadcast_if_small(rare), "hash").select("doc", "item").distinct())


def pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched and reparameterised (some slot is
    filled otherwise than in the item) of each document that holds an item."""
    return _pairs(docs, items).drop("doc", "item")


def _pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    own, bench = _texts(docs, "doc_id", "doc"), benchmark_windows(items)
    lengths = _texts(items, "item_id", "item").select(F.least(F.size(words(F.col("text"))), F.lit(WIDTH)).alias("n")).distinct()
    widths = sorted(r["n"] for r in lengths.collect()) or [WIDTH]  # WIDTH numbers at most
    there = own.select("doc_id", "doc", F.explode(windows(F.col("text"), widths)).alias("w")).select("doc_id", "doc", F.col("w.at").alias("place"), "w.hash")
    there = checkpoint(there.join(broadcast_if_small(bench.select("hash").distinct(), BROADCAST_WINDOWS), "hash", "left_semi"))
    chosen = candidates(there, bench)
    hits = there.join(broadcast_if_small(chosen), "doc").join(broadcast_if_small(bench, BROADCAST_WINDOWS), ["item", "hash"])
    hits = checkpoint(hits.select("doc_id", "item_id", "doc", "item", "n_windows", "hash", "at", (F.col("place") - F.col("at")).alias("diagonal")).distinct())
    one = ["doc_id", "item_id", "doc", "item", "n_windows"]
    pair = ["doc", "item"]
    hopeful = checkpoint(hits.groupBy(*one).agg(F.countDistinct("hash").alias("n")).where(_enough("n")).select(*pair))
    hits = checkpoint(hits.join(broadcast_if_small(hopeful), pair))
    filled = checkpoint(_fillings(hits, own, items))
    torn = checkpoint(_torn(filled, [*pair, "diagonal"]))
    whole = hits.join(broadcast_if_small(torn), [*pair, "diagonal"], "left_anti")
    left = filled.join(broadcast_if_small(torn), [*pair, "diagonal"], "left_anti")
    split = checkpoint(_torn(left, pair))  # no filling in common
    alone = whole.groupBy(*one, "diagonal").agg(F.countDistinct("hash").alias("n")).where(_enough("n")).groupBy(*one).agg(F.max("n").alias("alone"))
    together = whole.join(broadcast_if_small(split), pair, "left_anti").groupBy(*one).agg(F.countDistinct("hash").alias("together")).where(_enough("together"))
    found = _either(alone, together, one)
    other = left.groupBy(*pair).agg(F.max(F.col("value") != F.col("item_value")).alias("other"))
    return found.join(other, pair, "left").select("doc_id", "item_id", "n_windows", "n_matched", F.coalesce("other", F.lit(False)).alias("reparameterised"), *pair)


def _either(alone: DataFrame, together: DataFrame, one: list[str]) -> DataFrame:
    both = alone.withColumnRenamed("alone", "n").union(together.withColumnRenamed("together", "n"))
    return both.groupBy(*one).agg(F.max("n").alias("n_matched"))


def _torn(filled: DataFrame, by: list[str]) -> DataFrame:
    """Groups in which a filling of the item stands for several, or several for one."""
    two = lambda a, b: filled.groupBy(*by, "slot", a).agg(F.min(b).alias("low"), F.max(b).alias("high")).where("low != high").select(*by)
    return two("item_value", "value").union(two("value", "item_value")).distinct()


def _fillings(hits: DataFrame, own: DataFrame, items: DataFrame) -> DataFrame:
    """doc, item, diagonal, slot, item_value and value of each slot that a hit covers."""
    item_words = _texts(items, "item_id", "item").select("item", words(F.col("text")).alias("w"), template(F.col("text")).alias("t"))
    slots = (
        item_words.select("item", "w", F.size("w").alias("n"), F.posexplode("t").alias("word_at", "slot"))
        .where(F.col("slot").isin(*SLOTS))
        .select("item", "word_at", "slot", bare(F.get("w", F.col("word_at"))).alias("item_value"))
        .distinct()
    )
    sizes = item_words.select("item", F.least(F.size("w"), F.lit(WIDTH)).alias("width")).distinct()
    spread = hits.join(broadcast_if_small(sizes), "item").select("doc", "item", "diagonal", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("word_at")).distinct()
    asked = spread.join(broadcast_if_small(slots), ["item", "word_at"]).withColumn("place", F.col("word_at") + F.col("diagonal"))
    asked = checkpoint(asked)
    places = checkpoint(asked.groupBy("doc").agg(F.collect_set("place").alias("places")))  # bounded by the document's words
    read = let(words(F.col("text")), lambda w: F.transform("places", lambda p: F.struct(p.alias("place"), bare(F.get(w, p.cast("int"))).alias("value"))))
    values = own.join(_broadcast_lists(places), "doc").select("doc", F.explode(read).alias("v")).select("doc", "v.place", "v.value").distinct()
    return asked.join(values, ["doc", "place"]).select("doc", "item", "diagonal", "slot", "item_value", "value")


def _broadcast_lists(places: DataFrame) -> DataFrame:
    """A list for each document, with a broadcast hint if all of them together are short."""
    n = places.agg(F.sum(F.size("places") + 1)).first()[0] or 0
    return F.broadcast(places) if n <= BROADCAST_WINDOWS else places


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    (doc,) = unused(docs, "doc")
    found = checkpoint(_pairs(docs, items).select(F.col("doc").alias(doc)).distinct())
    marked = docs.withColumn(doc, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    return marked.join(broadcast_if_small(found), doc, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


_EDGES = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"
_SQL_BARE = f"coalesce(nullif(lower(regexp_replace(w, {_EDGES}, '', 'g')), ''), lower(w))"
_SQL_WORD = r"""CASE WHEN regexp_matches(w, '^[^\p{L}\p{N}]*[0-9]') THEN '<num>'
    WHEN i > 1 AND regexp_matches(t[i - 1], '^[^\p{L}\p{N}]*[0-9]') AND BARE IN (UNITS) THEN '<unit>'
    WHEN i > 1 AND regexp_matches(w, '^[^\p{L}\p{N}]*\p{Lu}\p{Ll}') AND NOT regexp_matches(t[i - 1], '[.!?:][^\p{L}\p{N}]*$') THEN '<name>'
    ELSE BARE END""".replace("UNITS", ", ".join(f"'{u}'" for u in UNITS)).replace("BARE", _SQL_BARE)
_SQL_WINDOW = """CASE WHEN 2 * len(list_filter(list_prepend(head, c[pos + 2:pos + width]), lambda x: x NOT IN ('<num>', '<unit>', '<name>'))) >= width
    THEN 'template ' || array_to_string(list_prepend(head, c[pos + 2:pos + width]), ' ') ELSE 'words ' || array_to_string(r[pos + 1:pos + width], ' ') END"""
_SQL_PLACES = "SELECT *, c[pos + 1] AS head FROM {p} UNION ALL SELECT *, r[pos + 1] AS head FROM {p} WHERE c[pos + 1] = '<name>'"
_SQL_TORN = """SELECT DISTINCT {by} FROM (SELECT {by} FROM {f} GROUP BY {by}, slot, item_value HAVING count(DISTINCT value) > 1
    UNION ALL SELECT {by} FROM {f} GROUP BY {by}, slot, value HAVING count(DISTINCT item_value) > 1)"""

ORACLE = rf"""
WITH d AS (SELECT DISTINCT doc_id, regexp_split_to_array(trim(text, E' \t\n\r\f'), '[ \t\n\r\f]+') AS t FROM documents WHERE trim(text, E' \t\n\r\f') <> ''),
b AS (SELECT DISTINCT item_id, regexp_split_to_array(trim(text, E' \t\n\r\f'), '[ \t\n\r\f]+') AS t FROM benchmark WHERE trim(text, E' \t\n\r\f') <> ''),
dt AS (SELECT doc_id, list_transform(t, lambda w: {_SQL_BARE}) AS r, list_transform(t, lambda w, i: {_SQL_WORD}) AS c FROM d),
bt AS (SELECT item_id, least(len(t), 5) AS width, list_transform(t, lambda w: {_SQL_BARE}) AS r, list_transform(t, lambda w, i: {_SQL_WORD}) AS c FROM b),
bp AS (SELECT *, unnest(range(len(c) - width + 1)) AS pos FROM bt),
bw AS (SELECT DISTINCT item_id, width, pos, {_SQL_WINDOW} AS win FROM ({_SQL_PLACES.format(p='bp')})),
bn AS (SELECT item_id, count(DISTINCT win) AS n_windows FROM bw GROUP BY item_id),
dp AS (SELECT doc_id, width, r, c, unnest(range(len(c) - width + 1)) AS pos FROM dt, (SELECT DISTINCT width FROM bt) WHERE len(c) >= width),
dw AS (SELECT doc_id, width, pos AS place, {_SQL_WINDOW} AS win FROM ({_SQL_PLACES.format(p='dp')})),
h AS (SELECT DISTINCT doc_id, item_id, n_windows, bw.width, win, pos, place - pos AS diagonal FROM dw JOIN bw USING (width, win) JOIN bn USING (item_id)),
ok AS (SELECT doc_id, item_id FROM h GROUP BY doc_id, item_id, n_windows HAVING 100 * count(DISTINCT win) >= 80 * n_windows),
hh AS (SELECT h.* FROM h JOIN ok USING (doc_id, item_id)),
cov AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(range(pos, pos + width)) AS word_at FROM hh),
f AS (SELECT cov.doc_id, cov.item_id, diagonal, bt.c[word_at + 1] AS slot, bt.r[word_at + 1] AS item_value, dt.r[word_at + diagonal + 1] AS value
      FROM cov JOIN bt USING (item_id) JOIN dt USING (doc_id) WHERE bt.c[word_at + 1] IN ('<num>', '<unit>', '<name>')),
torn AS ({_SQL_TORN.format(by="doc_id, item_id, diagonal", f="f")}),
w AS (SELECT * FROM hh ANTI JOIN torn USING (doc_id, item_id, diagonal)),
l AS (SELECT * FROM f ANTI JOIN torn USING (doc_id, item_id, diagonal)),
split AS ({_SQL_TORN.format(by="doc_id, item_id", f="l")}),
e AS (SELECT doc_id, item_id, n_windows, count(DISTINCT win) AS n FROM w GROUP BY doc_id, item_id, n_windows, diagonal
      UNION ALL SELECT doc_id, item_id, n_windows, count(DISTINCT win) AS n FROM w ANTI JOIN split USING (doc_id, item_id) GROUP BY doc_id, item_id, n_windows),
m AS (SELECT doc_id, item_id, n_windows, max(n) AS n_matched FROM e WHERE 100 * n >= 80 * n_windows GROUP BY doc_id, item_id, n_windows),
o AS (SELECT doc_id, item_id, bool_or(value <> item_value) AS other FROM l GROUP BY doc_id, item_id)
SELECT m.doc_id, m.item_id, n_windows, n_matched, coalesce(other, false) AS reparameterised FROM m LEFT JOIN o USING (doc_id, item_id)
"""
