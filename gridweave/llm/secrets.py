"""Secrets in text: fixed patterns, and character Markov models.

Three patterns (assignments, access keys, long hexadecimal strings) give the
base spans.  Further spans come from a likelihood ratio: the transitions of a
long token's characters under a first-order Markov model of random strings,
against one of ordinary identifiers, both trained from labelled samples.  Random
strings are digests in several alphabets; ordinary identifiers are put together
from a list of programmers' words and from short, plain words of documents, in
the ways programs join words (camel case, snake case, paths, qualified names).

Everything runs as Spark expressions: no Python on the executors.

Defined results: null text counts as empty; no match gives empty `spans`, whose
hash is that of the empty string.  Positions are code points, ends exclusive.
Texts of any length are searched whole; running sums over matches are made in
blocks, so that many matches in one text do not cost the square of their
number.  Rows are independent; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, by kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_.=-]{16,}"
#: Characters of the models; the first stands for a token's start.
ALPHABET = "^abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Log-likelihood ratio, for each character and in all, from which a token is random.
MEAN_RATIO, TOTAL_RATIO = 0.35, 10.0
#: Different characters that a random token has at least.
DISTINCT = 8
#: Random strings of each alphabet, identifiers of listed words, and documents whose words make identifiers.
RANDOM_SAMPLE, IDENTIFIER_SAMPLE, DOCUMENT_SAMPLE = 1500, 4000, 500
# Words of which programs make identifiers.
VOCABULARY = """abstract access account action adapter address admin algorithm api application array async attribute authentication background base batch bean binary boolean buffer
    builder button cache callback category channel character client collection column command common component config configuration connection constant container content context
    controller convert counter create current customer data database date default definition delete description device dictionary directory document element email enabled encoding
    engine entity environment error event exception execute export expression factory field file filter folder format function gateway generator global group handler hash header
    helper identifier image implementation import index information input instance integer interface internal invoice item iterator key language layout length library list listener
    loader local location logger manager mapper message metadata method model module monitor name network node notification number object observer operation option order output
    package page parameter parser password path pattern payment permission platform plugin pointer policy pool position process processor product profile property protocol provider
    proxy query queue reader record reference register registry remote repository request resource response result role route runtime schedule schema scope search security select
    sender server service session setting shared single source stack state status storage store stream string strategy structure subject system table target task template test text
    thread time timeout token transaction transfer transform type update upload user utility validator value variable vector version view virtual window worker wrapper writer"""
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array, by blocks."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def with_array(a: Column) -> Column:
        count = F.ceil(F.size(a) / F.lit(BLOCK)).cast("int")
        sums = F.transform(up_to(count), lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return let(
            sums,
            lambda s: let(
                F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))),
                lambda before: F.transform(a, lambda _, i: F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))),
            ),
        )

    return let(numbers, with_array)


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def spans_of(text: Column, pattern: str, kind: str, rank: int, present: Column, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches that `keep` accepts.

    keep gets a match and its group.  Where `present` is false the text has
    none.  A match ends where the pieces and matches up to it end.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.split(text, pattern, -1)
    spans = let(
        F.struct(matches.alias("m"), groups.alias("g"), pieces.alias("p")),
        lambda f: let(
            running_sums(F.zip_with(f["m"], F.slice(f["p"], F.lit(1), F.size(f["m"])), lambda m, p: (F.length(m) + F.length(p)).cast("long"))),
            lambda ends: F.filter(
                F.transform(
                    f["m"],
                    lambda m, i: F.when(
                        keep(m, F.get(f["g"], i)),
                        F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end")),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        ),
    )
    return F.when(present, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _draw(seed: int) -> Column:
    """A word of the list by a hash of the row."""
    listed = F.split(F.lit(" ".join(VOCABULARY.split())), " ")
    return F.get(listed, F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(VOCABULARY.split()))).cast("int"))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings: label (`random` or `ordinary`), token and the number of its row.

    Words of documents are taken from about DOCUMENT_SAMPLE of them, and only
    those of up to 20 letters in one case, first letter apart: what may be a
    secret is no sample of ordinary identifiers.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = F.translate(F.base64(F.unhex(digest)), "+/=", "xyz")
    forms = F.array(digest, F.base64(F.unhex(digest)), plain, F.upper(F.substring(plain, 1, 24)), F.lower(F.substring(plain, 1, 24)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_A"))
    random = spark.range(RANDOM_SAMPLE).select("id", F.lit("random").alias("label"), F.explode(forms).alias("token"))
    words = [_draw(k) for k in range(6)]
    some = F.slice(F.array(*words), 1, (2 + F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(5))).cast("int"))
    camel = F.array_join(F.transform(some, lambda w: F.initcap(w)), "")
    number = F.pmod(F.xxhash64(F.lit("number"), "id"), F.lit(1000)).cast("string")
    styles = F.array(
        camel, F.concat(words[0], camel), F.array_join(some, "_"), F.upper(F.array_join(some, "_")), F.array_join(some, "-"), F.concat(F.lit("/"), F.array_join(some, "/")), F.array_join(some, "."),
        F.concat(F.array_join(some, "."), F.lit("."), camel), F.array_join(some, ""), F.concat(F.array_join(some, "_"), F.lit("_"), number), F.concat(F.array_join(some, "/"), F.lit("."), F.substring(words[5], 1, 3)),
        F.concat(F.lit("2024-01-"), number, F.lit("/"), F.array_join(some, "-"), F.lit("-"), number),
    )
    listed = spark.range(IDENTIFIER_SAMPLE).select("id", F.lit("ordinary").alias("label"), F.explode(styles).alias("token"))
    share = min(1.0, DOCUMENT_SAMPLE / max(1, docs.count()))
    found = F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_.=-])[A-Za-z][a-z]{2,19}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    own = sampled.select(F.explode(found).alias("w")).distinct().withColumn("id", F.xxhash64("w"))
    other = _draw(7)
    joined = F.array(F.lower("w"), F.initcap("w"), F.upper("w"), *(F.concat(F.lower("w"), F.lit(mark), other) for mark in ("_", "-", "/", ".")), F.concat(F.lower("w"), F.initcap(other)))
    return random.unionByName(listed).unionByName(own.select("id", F.lit("ordinary").alias("label"), F.explode(joined).alias("token")))


def train(labelled: DataFrame) -> list[float]:
    """Log ratio of each transition, by (earlier, later) place in ALPHABET.

    Only the counts of the transitions come to the driver, at most twice the
    square of the alphabet's size.
    """
    text = F.concat(F.lit("^"), F.col("token"))
    pairs = labelled.where(F.length("token") > 0).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(text, i, F.lit(2)))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}
    table = []
    for a in ALPHABET:
        row = {}
        for label in ("random", "ordinary"):
            own = [counts.get((label, a + b), 0) + 0.5 for b in ALPHABET]
            whole = sum(own)
            row[label] = [math.log(x / whole) for x in own]
        table += [x - y for x, y in zip(row["random"], row["ordinary"])]
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """Summed log ratio of the token's transitions."""
    size = len(ALPHABET)
    # one constant, not a column: folded once when the query is planned
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token)),
        F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")),
        lambda s, i: let(code(i), lambda c: F.struct(c.alias("at"), (s["sum"] + F.get(values, s["at"] * size + c)).alias("sum"))),
        lambda s: s["sum"],
    )


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, base (spans of the patterns), more (spans of the models) and all
    of them as text, for every row of docs."""
    if table is None:
        table = train(samples(docs))
    text = F.col("text")
    ends_from = lambda least: lambda m, g: F.length(m) >= least
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        spans_of(text, ASSIGN, "assign", 0, text.rlike(ASSIGN), lambda m, g: F.length(g) >= ASSIGN_LEAST, 2).alias("assign"),
        spans_of(text, ACCESS, "access", 1, text.contains("AKIA"), ends_from(ACCESS_LEAST)).alias("access"),
        # runs shorter than the least length are no match of this form, and the longer ones are the same
        spans_of(text, r"[0-9a-f]{%d,}" % HEX_LEAST, "hex", 2, text.rlike(r"[0-9a-f]{%d}" % HEX_LEAST), ends_from(HEX_LEAST)).alias("hex"),
        tokens_of(text).alias("tokens"),
    )
    meets = lambda base, t: F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    random = lambda t: (F.size(F.array_distinct(F.split(t["kind"], ""))) >= DISTINCT) & let(ratio(t["kind"], table), lambda r: (r >= TOTAL_RATIO) & (r >= F.length(t["kind"]) * MEAN_RATIO))
    return rows.select(
        "doc_id",
        "assign",
        "access",
        "hex",
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.transform(
            F.filter("tokens", lambda t: random(t) & ~meets(F.col("assign"), t) & ~meets(F.col("access"), t) & ~meets(F.col("hex"), t)),
            lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), F.lit("markov").alias("kind"), t["end"].alias("end")),
        ).alias("more"),
    )


def tokens_of(text: Column) -> Column:
    """Spans of the long tokens; their kind is the token itself."""
    matches, pieces = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    found = let(
        F.struct(matches.alias("m"), pieces.alias("p")),
        lambda f: let(
            running_sums(F.zip_with(f["m"], F.slice(f["p"], F.lit(1), F.size(f["m"])), lambda m, p: (F.length(m) + F.length(p)).cast("long"))),
            lambda ends: F.transform(f["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(3).alias("rank"), m.alias("kind"), F.get(ends, i).alias("end"))),
        ),
    )
    return F.when(text.rlike(TOKEN), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    size = lambda c: F.size(c).cast("long")
    return scan(docs, table).select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )
