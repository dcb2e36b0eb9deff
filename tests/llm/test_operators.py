"""Corpus operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import bpe, components, decontaminate, html_extract, jaccard, language_id, line_dedup, media, queries, secrets, sharding, warc

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, same string, doc long, `of` string, version int, places array<int>, stays boolean, c0 int, hash long, item string, `a.b` int"


def docs_of(spark, texts, ids=None):
    """Documents with further columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 7, "x", None, "y", 3, [4], True, 1, 5, "z", 6) for i, t in zip(ids, texts)], SCHEMA)


AWKWARD = [None, "", " \n\t ", "word", "the same line here. And one more of it.", "the same line here. And one more of it.", "é " * 5000, "x" * 30000, "12 34 !!", "a\x00b 　c"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_every_operator_takes_awkward_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven")], "item_id long, text string")
    ids = [None, 1, 2, 3, 4, 4, 6, 7, 8, 9]
    for rows in (docs_of(spark, AWKWARD, ids), docs_of(spark, [])):
        n = rows.count()
        made = [language_id.identify(rows), secrets.find(rows), bpe.round_trip(rows), media.digests(rows), line_dedup.report(rows), jaccard.join(rows), sharding.shard(rows)]
        for out in made:
            assert out.count() == n
        assert decontaminate.pairs(rows, bench).count() == 0
        cleaned = [decontaminate.keep_clean(rows, bench), line_dedup.dedup(rows), line_dedup.drop_copies(rows), jaccard.keep_one(rows), language_id.keep_identified(rows)]
        for out in cleaned:
            assert out.columns == rows.columns and [f.dataType for f in out.schema] == [f.dataType for f in rows.schema]
        kept = [sorted(map(str, (r["doc_id"] for r in out.collect()))) for out in cleaned]
        if not n:
            assert kept == [[]] * 5
            continue
        every = sorted(map(str, ids))
        assert kept[0] == kept[1] == kept[2] == every  # equal rows of one id are one document, which stays
        assert kept[3] == sorted(set(every)) and set(kept[4]) == {"3", "4", "6", "7", "9"}
        by = lambda out: {r["doc_id"]: r.asDict() for r in out.collect()}
        lang, secret, token, audio, line, near, shard = map(by, made)
        for i, t in zip(ids, AWKWARD):
            raw = (t or "").encode()
            assert (lang[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= lang[i]["score"] <= 1
            assert (secret[i]["n_assign"], secret[i]["n_hex"], secret[i]["spans"]) == (0, 0, "")
            assert (token[i]["n_tokens"] == 0) == (not raw) and token[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
            assert audio[i]["n_bytes"] == len(raw) and audio[i]["payload_bytes"] % 64 == 0 < audio[i]["payload_bytes"]
            assert line[i]["text"] == t and not line[i]["removed"]
            words = [w for w in re.split("[ \t\n\x0b\f\r]+", (t or "").lower()) if w]
            assert near[i]["n_shingles"] == (len({tuple(words[k : k + 3]) for k in range(len(words) - 2)}) if len(words) > 2 else bool(words)) and near[i]["component_id"] == i
            assert shard[i]["size"] == len(raw) + 1 and shard[i]["text_crc32"] == zlib.crc32(raw) and shard[i]["grown_shard"] is None


def test_language_id(spark, docs):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    none = language_id.identify(docs_of(spark, ["12 !!", None, "½"])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    probs = np.array([[0.1], [0.2], [0.15], [0.05], [0.3], [0.2], [0.0]])
    index = {p: i for i, p in enumerate(pieces)}
    for word in ("a", "ab", "abab"):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[start:i])
                    start = i
            if all(p in index for p in parts):
                total += np.prod([probs[index[p], 0] for p in parts])
        assert np.exp(language_id.log_forward([word], index, probs)[0, 0]) == pytest.approx(total, rel=1e-5)


def test_long_words_are_worked_whole(monkeypatch):
    """By logarithms and not: the same sums and expected counts; and no underflow in a word of any length."""
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab", "bab", "abba"]
    index = {p: i for i, p in enumerate(pieces)}
    probs = np.vstack([np.random.default_rng(1).random((len(pieces), 3)) / 8, np.zeros((1, 3))])
    words = ["abababbab", "b", "abzab", "aaaabbabbabaabba"]
    plain, used = language_id.log_forward(words, index, probs), language_id.expected_counts(words, np.arange(1.0, 5.0), index, probs[:, 1])
    monkeypatch.setattr(language_id, "LONG", 0)
    assert np.allclose(language_id.log_forward(words, index, probs), plain)
    assert np.allclose(language_id.expected_counts(words, np.arange(1.0, 5.0), index, probs[:, 1]), used)
    whole = language_id.log_forward(["ab" * 20_000], index, probs)
    assert np.isfinite(whole).all() and (whole < -5000).all() and len(set(whole[0])) == 3


def test_language_of_a_naive_scorer(spark, docs):
    """The query's predictions are those of the learned table, summed word by word over every segmentation."""
    import public_tokenizers

    pieces = language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    some = docs.where("doc_id % 10 = 3")
    langs, probs = language_id.learn(docs, pieces)
    table = {p: probs[i] for i, p in enumerate(pieces)}

    def naive(text):
        total = np.zeros(len(langs))
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = "▁" + w
            sums = [np.ones(len(langs))]
            for j in range(1, len(w) + 1):
                sums.append(sums[j - 1] * language_id.UNKNOWN + sum(sums[i] * table[w[i:j]] for i in range(j) if w[i:j] in table))
            total += np.log(sums[-1])
        return total

    got = {r["doc_id"]: r for r in language_id.predict(some, pieces, langs, probs).collect()}
    for r in some.collect():
        total = naive(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == langs[total.argmax()]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), abs=1e-6)


def test_forward_takes_the_longest_pieces():
    import public_tokenizers

    assert "▁something" in language_id.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    index, probs = {"▁": 0, "▁something": 1}, np.array([[0.5], [0.25], [0.0]])
    assert np.exp(language_id.log_forward(["something"], index, probs)[0, 0]) == pytest.approx(0.25)
    assert language_id.expected_counts(["something"], np.array([2.0]), index, probs[:, 0])[1] == pytest.approx(2)


def test_decontamination(spark):
    item = "we know that a girl Anna drives slowly for 12 km and later with Anna there go 30 miles more so what is the whole way of the trip"
    other = item.replace("Anna", "Bert").replace("12", "17").replace("30", "8")
    torn = item.replace("Anna", "Bert", 1)
    texts = ["before it " + item + " after", other, torn, "something else without any of it at all here", None]
    bench = spark.createDataFrame([(5, item), (6, None), (7, "short")], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.pairs(docs_of(spark, texts), bench).collect()}
    assert got == {0: False, 1: True}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs_of(spark, texts), bench).collect()) == [2, 3, 4]


def test_decontamination_finds_items_of_every_length(spark):
    long = "a girl Anna met Bert and later also Carl at the station near the old town hall while it was raining very hard on that long and grey day"
    items = [(0, "Compute 12 + 7"), (1, "Who Is The King Of Spain"), (2, "12 + 30 = 42"), (3, "word"), (4, "Paul"), (5, long), (6, None), (7, "  "), (0, "Compute 12 + 7")]
    texts = {
        0: "so now Compute 12 + 7 please", 1: "so now Compute 15 + 9 please", 2: "so now Compute 12 - 7 please", 3: "and Who Is The King Of Spain now", 4: "and Who Is The Queen Of Spain now",
        5: "see 12 + 30 = 42 here", 6: "see 12 + 31 = 43 here", 7: "a word", 8: "Paul", 9: "then " + long, 10: "then " + long.replace("Anna", "Nora").replace("Bert", "Ole").replace("Carl", "Per"),
        11: "then " + long.replace("Bert", "Anna").replace("Carl", "Anna"), 12: "then " + long.replace("near the", "near to the"), 13: None, 14: "",
        15: long.replace("Anna", "Nora").replace("near the", "near to the"), 16: long.replace("Carl", "Per") + " and " + long.replace("Carl", "Ole"), None: "so now Compute 12 + 7 please",
    }
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hash string")
    rows = docs_of(spark, list(texts.values()), list(texts))
    got = {}
    for r in decontaminate.pairs(rows, bench).collect():
        got.setdefault(r["doc_id"], set()).add((r["item_id"], r["reparameterised"]))
    same = {0: 0, 3: 1, 5: 2, 7: 3, 8: 4, 9: 5, 12: 5, None: 0}
    assert got == {k: {(v, False)} for k, v in same.items()} | {1: {(0, True)}, 10: {(5, True)}, 15: {(5, True)}, 16: {(5, True)}}
    kept = {r["doc_id"] for r in decontaminate.keep_clean(rows, bench).collect()}
    assert kept == set(texts) - set(got)
    empty = bench.where("false")
    assert decontaminate.pairs(rows, empty).count() == 0 and decontaminate.keep_clean(rows, empty).count() == len(texts)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    import oracle_check

    con = duckdb.connect()
    for t in oracle_check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert oracle_check.differs(queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.ORACLES[name]).df()) == ""


def test_warc_statuses(spark):
    rows = [
        (1, "http://www.A.org/x/?b=1&a=2#f", 10, "response", 200, {"ETag": '"1"', "Content-Length": "5", "Date": "d1"}),
        (2, "https://a.org/x?a=2&b=1&utm_source=q", 20, "revisit", 304, {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0"}),
        (3, "a.org/x?a=2&b=1", 30, "response", 500, {"ETag": '"9"'}),
        (4, "http://a.org/x?a=2&b=1", 9000, "revisit", 304, {"ETag": '"9"'}),
        (5, "http://a.org/x?a=2&b=1", 5, "revisit", 304, None),
        (6, "http://a.org/x?a=2&b=1", 9001, "revisit", 304, {}),
        (7, None, 9001, "revisit", 304, {}),
        (8, "http://a.org/x?a=2&b=1", None, "revisit", 304, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, http_status int, headers map<string,string>")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {2: "resolved", 4: "mismatch", 5: "missing", 6: "no_validator", 7: "missing", 8: "missing"}
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-length": "5", "date": "d2"} and got[4]["refers_to"] == 1


def test_warc_headers_ties_and_empty_tables(spark):
    """Names that differ by case, records of one moment, equal records, clashing columns, no rows."""
    schema = "record_id long, url string, ts long, kind string, http_status int, headers map<string,string>, span long, own string"
    rows = [
        (1, "http://a.org/x", 10, "response", 200, {"ETag": '"1"', "etag": '"9"', "Vary": "a"}, 1, "x"),
        (2, "http://a.org/x", 10, "revisit", 304, {"ETAG ": '"1"', "Etag": '"7"'}, 1, "x"),
        (3, "http://a.org/x", 10, "response", 200, {"ETag": '"3"'}, 1, "x"),
        (4, "http://a.org/x", 10, "revisit", 304, {"ETag": '"3"'}, 1, "x"),
        (4, "http://a.org/x", 10, "revisit", 304, {"ETag": '"3"'}, 1, "x"),
        (5, "http://a.org/x", 10**6, "revisit", 304, {"Last-Modified": "d"}, 1, None),
        (6, "http://a.org/x", 10, None, None, None, None, None),
        (7, None, None, "revisit", None, None, None, None),
        (8, None, 5, "response", 200, {"ETag": '"3"'}, 1, "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["record_id"], r["status"], r["refers_to"]) for r in warc.resolve(df).collect())
    assert got == [(2, "resolved", 1), (4, "resolved", 3), (4, "resolved", 3), (5, "no_validator", 3), (7, "missing", None)]
    for span in (1, 7, 10**9):  # whatever the spans are
        assert sorted((r["record_id"], r["status"], r["refers_to"]) for r in warc.resolve(df, span).collect()) == got
    assert warc.resolve(df.where("false")).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>menu one</a></nav><div class="ad">Buy this now please</div>
    <article><h1>Title &amp; more</h1><p>One  two<br>three &eacute; four five six seven<p>Next <b>para</b> with some words in it</p><div class="comments">I agree with all of it</div></article>
    <footer>&copy; all rights</footer></body>"""
    table = html_extract.weights(html_extract.counts(page))
    want = "Title & more\nOne two three é four five six seven\nNext para with some words in it"
    assert html_extract.main_text(page, table) == want
    assert html_extract.main_text(None, table) == html_extract.main_text("<p></p><b", table) == ""


ARTICLE = "<article><h1>A title</h1><p>One two three four five six seven eight.</p><p>More words of it follow right here now.</p></article>"
WANT = "A title\nOne two three four five six seven eight.\nMore words of it follow right here now."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><div class="content-sidebar-wrap">{ARTICLE}</div><div class="sidebar">Other things to read</div></body>', WANT),
        (f'<body class="site has-header no-sidebar"><div class="site-header">Our site</div><div class="has-header no-sidebar">{ARTICLE}</div></body>', WANT),
        (f'<body><form id="main-form"><div class="widget">Search</div>{ARTICLE}</form></body>', WANT),
        (ARTICLE.replace("<p>", "<p title=it's>"), WANT),
        (ARTICLE.replace("<p>", "<p title='it is > all' data-x=\"a'b\">"), WANT),
        (ARTICLE.replace("four", "if a <b and c"), WANT.replace("four", "if a <b and c")),
        (ARTICLE.replace("four", "x < 4 and y<5"), WANT.replace("four", "x < 4 and y<5")),
        (ARTICLE.replace("</h1>", '</h1><div class="sponsored-content">Buy</div><ul class="related-posts"><li>Other</li></ul><div class="comments wrapper">No</div>'), WANT),
        (ARTICLE.replace("<h1>A title</h1>", "<header><h1>A title</h1></header>"), WANT),
        (ARTICLE.replace("</h1>", '</h1><div class="ad">Buy</div><section id="comment-list"><p>I agree</p></section>'), WANT),
        (f"<body><header><h1>Our site</h1></header>{ARTICLE}<footer>All rights</footer></body>", WANT),
        (f"<body><div hidden>no</div><div style='display: none'>no</div><aside>no</aside>{ARTICLE}<div role=navigation>no</div></body>", WANT),
    ],
)
def test_pages_of_many_kinds(page, want):
    table = html_extract.weights(html_extract.counts(f"<body><nav><a href=x>menu one two</a></nav>{ARTICLE}<footer>rights</footer></body>"))
    assert html_extract.main_text(page, table) == want


def test_the_scan_decides_where_no_name_helps():
    """Menus and notes in plain boxes, on pages that mark nothing; weights from pages that mark their article."""
    around = "<div><div><a href=a>Start</a> <a href=b>News of the day</a> <a href=c>All other things</a></div>{}<div>Copyright by us <a href=d>Terms</a> <a href=e>Privacy</a> and so on</div></div>"
    labelled = f"<body>{around.format(ARTICLE)}</body>"
    table = html_extract.weights(collections.Counter({k: 20 * v for k, v in html_extract.counts(labelled).items()}))
    page = "<body>" + around.format(ARTICLE.replace("article>", "div>")) + "</body>"
    found = html_extract.tokens(page, table)
    assert html_extract.text_of(found) != WANT and html_extract.main_text(page, table) == WANT
    # by all ranges: none scores higher
    score = lambda t: table[""] * len(t[1].split()) if t[0] == "text" else 0 if t[0] in ("gap", "edge") else table.get(t[1], table.get("other", html_extract.DEFAULT_TAG))
    scores = [score(t) for t in found]
    a, z = html_extract.best_region(found, table)
    assert sum(scores[a:z]) == pytest.approx(max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)))


def test_class_names_are_learned():
    odd = "<body><div class='zork'>" + "buy this thing " * 20 + "</div><article><h1>Head</h1><div class='comment'><p>" + "words of the text " * 20 + "</p><p>more of it</p></div></article></body>"
    total = collections.Counter(html_extract.counts(odd))
    for _ in range(30):
        total.update(html_extract.counts(f"<body><nav><a href=x>menu one two</a></nav>{ARTICLE}<footer>rights</footer></body>"))
    table = html_extract.weights(total)
    assert html_extract.is_marked(["zork"], table) and not html_extract.is_marked(["comment"], table) and html_extract.is_marked(["comment"], {})
    assert html_extract.is_marked(["site-header"], {}) and not html_extract.is_marked(["section-header"], {}, True) and not html_extract.is_marked(["content-sidebar-wrap"], {})
    page = ARTICLE.replace("</h1>", "</h1><div class='zork'>Buy</div>")
    assert html_extract.main_text(page, table) == WANT


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 32000):
        began = time.process_time()
        html_extract.main_text("<b>x<p>" * n + "<ul>" + "<li><i>y" * n, {})
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * took[0] + 1


def test_pages_with_awkward_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1), (2, None, "<p>" + "word " * 50_000, 1), (3, "v", "<" * 5000 + "<p>x</p>", 1)]
    schema = "page_id long, url string, html string, text int"
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0] and len(got) == 5
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["n_chars"] for r in got if r["page_id"] == 2} == {249_999}
    assert html_extract.extract(spark.createDataFrame([], schema)).columns == ["page_id", "url", "text", "n_chars"]


def test_pages(spark):
    def article(p):
        body = re.search(r"<article>(.*?)(</article>|$)", p, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want


def test_secrets(spark, docs):
    extra = docs_of(spark, ["token: token = abcdef x", "AKIA" + "Z" * 16 + " é password='hunter22' " + "0f" * 12, "key is wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY ok", "thereationtheandinghereandmore"], range(1000, 1004))
    rows = docs.select("doc_id", "text").union(extra.select("doc_id", "text"))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = {r["doc_id"]: r for r in secrets.find(rows).collect()}
    for i, t in text.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert got[1002]["spans"].startswith("markov:7:") and got[1003]["spans"] == ""


def test_character_models_on_held_out_strings(spark, docs):
    """Trained without every fifth sample, and judged on those that a scan would look at."""
    labelled = secrets.samples(docs).persist()
    table = secrets.train(labelled.where("pmod(id, 5) != 0"))
    held = labelled.where("pmod(id, 5) = 0").where(F.col("token").rlike(f"^{secrets.TOKEN}$"))
    judged = held.select("label", "token", secrets.ratio(F.col("token"), table).alias("ratio")).toPandas()
    random_ = (judged.ratio >= secrets.TOTAL_RATIO) & (judged.ratio >= judged.token.str.len() * secrets.MEAN_RATIO) & (judged.token.map(lambda t: len(set(t))) >= secrets.DISTINCT)
    is_random = judged.label == "random"
    assert (is_random & random_).sum() / is_random.sum() > 0.97, "recall"
    assert (is_random & random_).sum() / random_.sum() > 0.97, "precision"
    texts = ["AbstractSingletonProxyFactoryBeanImplementation x", "see org.apache.commons.collections.iterators.FilterIterator", "at /usr/local/share/documents/templates/default_configuration.json", "MAX_CONNECTION_TIMEOUT_MILLISECONDS", "wJalrXUtnFEMIK7MDENGbPxRfiCY"]
    got = [r["spans"] for r in secrets.find(docs_of(spark, texts), table).orderBy("doc_id").collect()]
    assert got == ["", "", "", "", f"markov:0:{len(texts[-1])}"]
    # a plain sum of logarithms
    size = len(secrets.ALPHABET)
    for r in judged.sample(50, random_state=1).itertuples():
        places = [secrets.ALPHABET.index(c) for c in "^" + r.token]
        assert r.ratio == pytest.approx(sum(table[a * size + b] for a, b in zip(places, places[1:])), abs=1e-3)


def test_running_sums(spark):
    df = spark.range(0, 300, 37).select(F.transform(F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id"))).otherwise(F.array().cast("array<bigint>")), lambda x: x % 7).alias("a"))
    for r in df.select("a", secrets.running_sums(F.col("a")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["a"]))


def test_bpe_is_tiktokens(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n\x1c\x85\xa0　'sdtéß漢ñ𝒳½²01aA!eingthr") for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["ab" * 200, "a" * 1000, "", "a" * 20_000, "abcab" * 3000, "".join(rng.choice("abe") for _ in range(9000))]
    assert own.encode(texts) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = np.array(reference.encode_ordinary(text[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    assert bpe.decode(bpe.encode(docs)).where("doc_id = 0").first()["bytes"] == text[0].encode()


def test_media(spark):
    texts = ["", None, "a" * 64, "é" * 33, "a" * 64]
    got = [r for r in media.digests(docs_of(spark, texts)).orderBy("doc_id").collect()]
    for t, r in zip(texts, got):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2][1:] == got[4][1:] and got[0][1:] == got[1][1:]
    texts = ["some text " * 3000, None, "x"]
    want = {r["doc_id"]: tuple(r)[1:] for r in media.digests(docs_of(spark, texts)).collect()}
    for r in media.media(docs_of(spark, texts)).collect():
        n, payload = media.payload_of(texts[r["doc_id"]])
        assert media.from_wav(r["wav"])[1] == payload and media.digest(n, r["wav"], r["tensors"]) == want[r["doc_id"]]
        table, found = media.read_tensors(r["tensors"])
        assert table["tensor"].type == media.tensor_type() and table.num_rows == -(-sum(table["frames"].to_pylist()) // media.BLOCK)


def test_features_are_those_of_plain_loops(monkeypatch):
    """Filtering, framing, filterbank, energies and segments written out, over a payload in one block and in several."""
    made = media.AudioFeatures()
    for text in ("x", "plain text with nothing " * 900, "".join(chr(33 + k * k % 90) for k in range(30_000)) + " " * 9000):
        payload = media.payload_of(text)[1]
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        low = np.convolve(x, made.taps)[len(made.taps) // 2 :][: len(x)][:: media.DOWN]
        frames = []
        at = 0
        while not frames or at - media.HOP + media.FRAME < len(low):
            frames.append(np.pad(low[at : at + media.FRAME], (0, media.FRAME - len(low[at : at + media.FRAME]))) * made.window)
            at += media.HOP
        mels = [[np.log10(sum(p * w for p, w in zip(np.abs(np.fft.rfft(f)) ** 2, made.bank[:, m])) / media.FRAME + 1e-10) for m in range(media.MELS)] for f in frames]
        energy = [np.log10((f * f).sum() / media.FRAME + 1e-10) for f in frames]
        is_open, segments, middle = False, [], np.median(energy)
        for k, e in enumerate(energy):
            if not is_open and e - middle >= media.OPEN + 1e-3:
                is_open, begun = True, k
            elif is_open and e - middle < media.CLOSE - 1e-3:
                is_open = False
                segments.append((begun, k))
        stored = made.stored(payload)
        table, found = media.read_tensors(stored)
        values = np.concatenate([t.as_py() if isinstance(t.as_py(), list) else np.ravel(t.as_py()) for t in table["tensor"].combine_chunks().storage]).reshape(-1, media.MELS)
        assert np.allclose(values[: len(frames)], mels, atol=2e-3) and (values[len(frames) :] == media.FLOOR).all()
        assert sum(table["frames"].to_pylist()) == len(frames) and table["end_s"][-1].as_py() == pytest.approx(((len(frames) - 1) * media.HOP + media.FRAME) / 8000)
        assert abs(len(found) - len(segments)) <= 1 + len(segments) // 3
        monkeypatch.setattr(media, "BLOCK_FRAMES", media.BLOCK)
        assert made.stored(payload) == stored
        monkeypatch.undo()


def test_segments_open_and_close_at_two_thresholds():
    e = np.array([0.0, 0.0, 0.03, 0.0, 0.01, -0.03, 0.01, 0.05, 0.0, 0.0, 0.0, 0.0])
    assert media.AudioFeatures.segments(e) == [(2, 5), (7, 12)]


def test_polyphase_equals_filtering_of_stuffed_zeros():
    x = np.random.default_rng(2).random(500).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        made = media.AudioFeatures(up=up, down=down)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, made.taps)[len(made.taps) // 2 :][: len(stuffed)][::down]
        assert np.allclose(made.resample(x), want, atol=1e-5)


def naive_chunks(text):
    """Lines of a text, and (lines, first, end) of its chunks, written out plainly."""
    import xxhash

    lines, start, m64 = [], 0, (1 << 64) - 1
    for m in re.finditer(r"\n\s*|[.!?]\s+", text):
        lines.append(text[start : m.end()])
        start = m.end()
    if start < len(text) or not lines:
        lines.append(text[start:])
    bare = [x.strip() for x in lines]
    hashes = [xxhash.xxh3_64_intdigest(x.encode()) for x in bare]

    def rolled(i):
        h = sum(x * pow(line_dedup.ROLL, k, 1 << 64) for k, x in enumerate(hashes[i : i + line_dedup.ROLLED])) & m64
        return (h ^ h >> 32) * line_dedup.MIX & m64

    roll = [rolled(i) for i in range(len(lines))]
    edge = [i in (0, len(lines) - 1) or roll[i] <= roll[i - 1] or roll[i] <= roll[i + 1] for i in range(len(lines))]
    out = []
    for i in range(len(lines)):
        if edge[i]:
            for j in range(i + line_dedup.MIN_LINES, len(lines) + 1):
                if sum(x.count(" ") + 1 for x in bare[i:j] if x) >= line_dedup.MIN_WORDS:
                    out.append((tuple(bare[i:j]), i, j))
                    break
    return lines, out


def naive_dedup(rows):
    """Texts by id as line dedup should leave them."""
    where, cut = {}, {}
    for i, text in sorted(rows.items()):
        for lines, first, end in naive_chunks(text)[1]:
            where.setdefault(lines, []).append((i, first, end))
    for i, text in rows.items():
        lines, chunks = naive_chunks(text)
        gone, kept = set(), set()
        for chunk, first, end in chunks:
            if len(where[chunk]) > 1:
                (kept if where[chunk][0] == (i, first, end) else gone).update(range(first, end))
        left = "".join(x for k, x in enumerate(lines) if k not in gone - kept)
        cut[i] = left.rstrip() if gone - kept else text
    return cut


def test_line_dedup(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == naive_dedup(text) and got != text
    passage = " ".join(f"Sentence number {k} of the passage has these words." for k in range(12))
    pair = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, ["Own start here. " + passage, "Another begin. " + passage + " Own end.", "All of this is alone."])).collect()}
    assert passage in pair[0] and len(pair[1]) < len(passage) / 2 and pair[2] == "All of this is alone."
    left = line_dedup.drop_copies(docs)
    assert left.schema == docs.schema
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()} == {i: (t, len(t)) for i, t in got.items() if not is_copy(text, i, t)}


def is_copy(text, i, left):
    """Whether a text goes with what is left of it, by counting."""
    if left == text[i]:
        return False
    where = {}
    for k, t in sorted(text.items()):
        for chunk, first, _ in naive_chunks(t)[1]:
            where.setdefault(chunk, []).append((k, first))
    count = lambda t: sum(x.strip().count(" ") + 1 for x in naive_chunks(t)[0] if x.strip())
    return count(text[i]) - count(left) >= 0.8 * count(text[i]) and not any(len(w) > 1 and w[0][0] == i for w in where.values())


def test_line_dedup_keeps_what_it_removes(spark, docs):
    """Whatever is cut stands whole in a text that stays: not only line by line, but as a run of lines."""
    bare = lambda t: [x.strip() for x in naive_chunks(t)[0]] if t else []
    before = {r["doc_id"]: bare(r["text"]) for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    runs = set()
    for text in after.values():
        lines = bare(text)
        runs.update(tuple(lines[i:j]) for i in range(len(lines)) for j in range(i + 1, min(i + 14, len(lines)) + 1))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    often = collections.Counter(c for t in text.values() for c, _, _ in naive_chunks(t)[1])
    changed = [i for i in text if after[i] != text[i]]
    assert changed and all(c in runs for c, n in often.items() if n > 1 and len(c) <= 14)
    for i in changed:  # and nothing else goes
        within = {k for c, a, z in naive_chunks(text[i])[1] if often[c] > 1 for k in range(a, z)}
        stays = [x for k, x in enumerate(before[i]) if k not in within]
        kept = iter(bare(after[i]))
        assert all(x in kept for x in stays)
    alone = ["The quick brown fox jumps over the lazy dog today.\nAnother line with quite some words follows right here.", "One two three four five six. Seven eight nine ten eleven.", "a b c d e f g h i j k.\n" * 2]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, alone)).collect()}
    assert got == dict(enumerate(alone))


@pytest.mark.parametrize("collide", [False, True])
def test_line_dedup_on_random_lines(spark, monkeypatch, collide):
    """Against plain loops where chunks overlap, repeat within a text, and stand in chains of texts; and
    where the comparison of bytes says of some hashes that they do not tell chunks apart."""
    rng = random.Random(5)
    pool = [f"line {k} has some five words{rng.choice('.!?')}" for k in range(40)]
    texts = {}
    for i in range(60):
        lines = []
        while len(lines) < rng.randint(3, 25):
            at = rng.randrange(len(pool))
            lines += pool[at : at + rng.randint(2, 9)] if rng.random() < 0.6 else [f"own {rng.random()} words of text {i}."]
        texts[i] = rng.choice([" ", "\n"]).join(lines)
    if not collide:
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, list(texts.values()))).collect()}
        assert got == naive_dedup(texts)
    else:
        monkeypatch.setattr(line_dedup, "collided", lambda listed: line_dedup.chunk_texts(listed).select("chunk").distinct())
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, list(texts.values()))).collect()}
        assert got == texts


def test_line_dedup_finds_shared_passages_in_unique_documents(spark):
    """A passage of 50 to 125 words in otherwise unique documents goes, all but the parts of lines at its edges."""
    rng = random.Random(11)
    unique = itertools.count()
    sentence = lambda n: " ".join(f"u{next(unique)}" for _ in range(n)) + rng.choice([". ", "! ", ".\n"])
    own = lambda: "".join(sentence(rng.randint(1, 16)) for _ in range(rng.randint(2, 20)))
    texts, inner = [], []
    for _ in range(150):
        passage = " ".join("".join(sentence(rng.choice([4, 9, 13])) for _ in range(40)).split(" ")[3:][: rng.randint(50, 125)])
        inner.append(passage)
        texts += [own() + "x " + passage + " " + own(), own() + "y " + passage + " " + own()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert all(got[2 * k] == texts[2 * k] for k in range(150))
    shares = []
    for k, passage in enumerate(inner):
        there = set(got[2 * k + 1].split())
        shares.append(np.mean([w not in there for w in passage.split()]))
    print("passages of which something goes", np.mean(np.array(shares) > 0), "words gone", np.mean(shares))
    assert np.mean(np.array(shares) > 0) > 0.9 and np.mean(shares) > 0.5


def test_line_dedup_of_rows_without_ids_and_clashing_columns(spark):
    passage = " ".join(f"Sentence number {k} of the passage has these words." for k in range(6))
    schema = "doc_id int, text string, `of` int, version int, places array<int>, stays string, n_chars int, `a.b` int"
    rows = [(None, passage, 1, 1, [1], "s", 5, 1), (None, "x " + passage, 1, 1, None, "s", 5, 1), (0, passage + " y", 1, 1, None, None, 5, 1), (0, passage + " y", 1, 1, None, None, 5, 1), (7, None, 1, 1, None, None, None, 1)]
    df = spark.createDataFrame(rows, schema)
    out = line_dedup.dedup(df)
    got = out.collect()
    assert out.schema == df.schema and len(got) == 5
    by = {(r["doc_id"], len(r["text"] or "")) for r in got}
    assert sum(r["text"] == passage + " y" for r in got) == 2 and (7, 0) in by and all(r["n_chars"] in (5, len(r["text"])) for r in got if r["text"] is not None)
    assert max(len(r["text"]) for r in got if r["doc_id"] is None) < len(passage)


def test_line_dedup_keeps_texts_of_one_id_apart(spark):
    passage = " ".join(f"Sentence number {k} of the passage has these words." for k in range(6))
    other = " ".join(f"Line {k} is of one document alone and stays whole." for k in range(6))
    got = line_dedup.dedup(docs_of(spark, [passage, passage, other], [1, 2, 2])).collect()
    assert sorted(r["text"] for r in got) == ["", other, passage]


def brute_components(texts, width, percent):
    """Sizes of the shingle sets, and components by comparing all pairs."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, width, percent):
    rng = random.Random(9)
    texts = []
    for family in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(2, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "ONE", "one two"]
    sizes, root = brute_components(texts, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(spark, texts), width, percent).collect()}
    assert got == {i: (sizes[i], root[i]) for i in range(len(texts))}
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(docs_of(spark, texts), width, percent).collect())
    assert kept == [i for i, r in enumerate(root) if i == r]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_of_a_table(spark, docs, width, percent):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    _, root = brute_components([r["text"] for r in rows], width, percent)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, width, percent).collect()}
    assert got == {r["doc_id"]: rows[k]["doc_id"] for r, k in zip(rows, root)}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_jaccard_of_a_large_family(spark, monkeypatch, bound):
    """Many near copies, more than a task takes, in several components that chains of edits connect or not;
    with joins that broadcast and that shuffle."""
    import gridweave.llm.common as common

    monkeypatch.setattr(jaccard, "REGION", 40)
    monkeypatch.setattr(jaccard, "PIVOTS", 6)
    monkeypatch.setattr(common.broadcast_if_small, "__defaults__", (bound,))
    rounds, of_pivots = [], jaccard.to_pivots
    monkeypatch.setattr(jaccard, "to_pivots", lambda *a: rounds.append(a[-1]) or of_pivots(*a))
    rng, texts = random.Random(3), []
    base = [f"w{k}" for k in range(70)]
    for _ in range(330):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 9])):
            copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 60)}"
        texts.append(" ".join(copy))
    sizes, root = brute_components(texts, 3, 80)
    assert 5 < len(set(root)) < len(texts) - 50
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(spark, texts), 3, 80).collect()}
    assert got == {i: (sizes[i], root[i]) for i in range(len(texts))} and rounds


def test_sets_of_a_column_are_those_of_its_texts():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB é\t\n\x0b\x1f\x85") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " ", "a", "x y", "tail"]
    for width in (1, 3, 5):
        shingler = jaccard.Shingler(width)
        column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
        assert all(np.array_equal(a, shingler(t)) for a, t in zip(shingler.many(column), texts, strict=True))
        assert [b.tolist() for s, e in jaccard.parts_of(column, 50) for b in shingler.many(column.slice(s, e - s))] == [shingler(t).tolist() for t in texts]
    assert jaccard.Shingler(3).many(pa.array([], pa.string())) == [] and list(jaccard.parts_of(pa.array([], pa.string()))) == []


def test_jaccard_does_not_mix_up_words(spark):
    """Words on which polynomial hashes modulo a power of two collide."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs_of(spark, [one, two, one.upper()])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    assert jaccard.really_link("a b c d", "A  b\nc d", 3, 90) and not jaccard.really_link("a b", "a c", 3, 90) and not jaccard.really_link("", "", 3, 90)


def test_regions_connect_as_all_pairs_do():
    rng = np.random.default_rng(4)

    def labels(found, n):
        root = list(range(n))
        for i, j in found:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        return root

    for trial in range(6):
        sets = []
        for family in range(rng.integers(1, 30)):
            base = rng.choice(3000, rng.integers(5, 80), replace=False)
            for _ in range(rng.integers(1, 40)):
                cut = rng.choice(base, max(1, len(base) - rng.integers(0, 5)), replace=False)
                sets.append(np.unique(np.concatenate([cut, rng.integers(0, 3000, rng.integers(0, 4))])).astype(np.uint64))
        n = len(sets)
        for percent in (90, 80):
            brute = [(i, j) for i in range(n) for j in range(i) if jaccard.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), percent)]
            region = jaccard.Region(sets, percent)
            assert labels(region.found, n) == labels(brute, n)
            assert set(map(frozenset, region.found)) <= set(map(frozenset, brute))
            part = np.arange(n) % 2
            cut = jaccard.join_region(sets, percent, part)
            for b in (0, 1):
                own = np.flatnonzero(part == b)
                cut += [(int(own[i]), int(own[j])) for i, j in jaccard.join_region([sets[k] for k in own], percent)]
            assert labels(cut, n) == labels(brute, n)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 70: 50, 100: 50}


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 5000, "text")).union(spark.createDataFrame([(9999, None)], "doc_id long, text string"))
    got = sharding.shard(rows).toPandas()
    text = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert len(got) == len(text) and all(got["size"] == got.doc_id.map(lambda i: len((text[i] or "").encode()) + 1))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    shards = got.groupby(got.doc_id.map(lambda i: text[i] or "")).shard.nunique()
    sums = got.groupby("shard")["size"].sum()
    assert (shards == 1).all() and sums.max() - sums.min() <= 0.02 * sums.sum() / 8


def test_sharding_in_levels(spark, docs, monkeypatch):
    """Parts differenced over several levels, against differencing all groups at once; and the least possible spread."""
    monkeypatch.setattr(sharding, "FAN", 2)
    got = sharding.shard(docs, tasks=5).toPandas()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weight = collections.Counter()
    for t in text.values():
        weight[t] += len(t.encode()) + 1
    sums = got.groupby("shard")["size"].sum()
    whole, _ = sharding.difference([([w] + [0] * 7, k) for k, w in enumerate(weight.values())])
    assert len(got) == len(text) and sums.sum() == sum(whole) and len(sums) == 8
    assert (got.groupby(got.doc_id.map(text)).shard.nunique() == 1).all()
    assert max(whole) - min(whole) <= sums.max() - sums.min() <= 0.12 * sums.sum() / 8  # parts of 40 texts; far less where they have thousands
    assert sharding.shard(docs_of(spark, [])).count() == 0
    hot = sharding.shard(docs_of(spark, ["a" * 9] * 50 + ["b" * 9, None, None, ""])).toPandas()
    assert hot.groupby("shard")["size"].sum().max() == 500 and hot.groupby("shard").slot.agg(lambda x: sorted(x) == list(range(len(x)))).all()


def test_differencing():
    assert sharding.difference([([x, 0], k) for k, x in enumerate([8, 7, 6, 5, 4])])[0] == [16, 14]


def test_pipeline_and_its_stages(spark, tmp_path):
    """Every stage of a run against plain loops over the rows that the stage before kept."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as pipeline

    rng = random.Random(21)
    source = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60 and lang is not null").orderBy("doc_id").collect()
    items = ["A traveller goes from the old harbour to the new bridge and pays 12 coins for 3 days so what does each day cost him in the end", "Name the river that flows past the seven hills of the town where the great market stands each spring and autumn"]
    texts = [(r["text"], r["lang"]) for r in source]
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    near = words(120)
    texts += [(f"The beginning of it and the end. {items[0].replace('12', '40').replace('3 days', '8 days')}. And more of the text.", "en"), (f"It was so. {items[1]}", "en")]
    texts += [(source[0]["text"], "en"), (source[0]["text"] + " And the end of it all.", "en"), (near + " the end of the text", "en"), (near + " the end of a text", "en"), (None, None), ("", "en"), ("12 34 !", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)], schema)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    state, docs = dict(enumerate(t for t, _ in texts)), rows
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "byte_bpe":
            assert docs.columns == rows.columns
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "language_id":
            assert set(state) - set(got) == {i for i, t in state.items() if not t or not any(map(str.isalpha, t))}
            want = {i: state[i] for i in got}
        elif name == "line_dedup":
            want = {i: t for i, t in naive_dedup(state).items() if not is_copy(state, i, t)}
            assert len(want) < len(state)
        elif name == "jaccard_join":
            order = sorted(state)
            root = brute_components([state[i] for i in order], 5, 80)[1]
            want = {i: state[i] for k, i in enumerate(order) if root[k] == k}
            assert len(want) < len(state)
        elif name == "decontamination":
            want = {i: t for i, t in state.items() if "goes from the old harbour" not in t and "the seven hills" not in t}
            assert len(want) == len(state) - 2
        else:
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            want = {i: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in ((i, encoding.encode_ordinary(t)) for i, t in state.items())}
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in docs.collect()}
        assert got == want
        state = got
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, str(tmp_path)).collect()} == state
