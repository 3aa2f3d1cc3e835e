import math
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from lexigrove import __main__ as cli
from lexigrove import queries
from lexigrove.functions import html, urls
from lexigrove.functions import text as X
from lexigrove.operators import analyze as A
from lexigrove.operators import export, links, verbs
from lexigrove.operators import index as I
from lexigrove.plans import search as S
from lexigrove.plans.boolean import parse, to_postfix
from lexigrove.sources import crawl, lexicons, tables
from lexigrove.streaming import ingest

DOCS = [("d1", "data science data"), ("d2", "science data labor"), ("d3", "data labor"), ("d4", "1 2 3")]


@pytest.fixture(scope="module")
def index(spark):
    return I.build_index(spark.createDataFrame(DOCS, "doc_id string, text string"))


def scores(df):
    return [(r.doc_id, round(r.score, 6)) for r in df.collect()]


def test_free(index):
    assert scores(S.free_search(index, ["data"])) == []
    assert scores(S.free_search(index, ["science"])) == [("d2", 0.176091), ("d1", 0.088046)]
    assert scores(S.free_search(index, ["science", "labor"])) == [("d2", 0.352183), ("d3", 0.176091), ("d1", 0.088046)]
    assert scores(S.free_search(index, ["science", "science"])) == [("d2", 0.352183), ("d1", 0.176091)]
    assert scores(S.search(index, ["science", "labor"], k=1)) == [("d2", 0.352183)]
    assert scores(S.free_search(index, ["unknown"])) == scores(S.free_search(index, [])) == []


@pytest.mark.parametrize(("text", "found"), [("science AND labor", ["d2"]), ("science OR labor", ["d1", "d2", "d3"]), ("science AND NOT labor", ["d1"]), ("NOT science", ["d3"]), ("data AND NOT data", []), ("data OR NOT data", ["d1", "d2", "d3"])])
def test_boolean(index, text, found):
    assert [r.doc_id for r in S.search(index, text, "boolean").collect()] == found
    assert sorted(r.doc_id for r in S.boolean_by_sets(index, parse(text)).collect()) == found


@pytest.mark.parametrize(("text", "found"), [("science data", [("d2", 0), ("d1", 1)]), ("data science data", [("d1", 0)]), ("data unknown", [])])
def test_phrase(index, text, found):
    assert [(r.doc_id, r.first_pos) for r in S.search(index, text, "phrase").collect()] == found


@pytest.mark.parametrize(("infix", "postfix"), [("Data AND NOT Science", "Data Science NOT AND"), ("a OR b AND c", "a b c AND OR"), ("a AND b OR c", "a b AND c OR"), ("(a OR b) AND c", "a b OR c AND"), ("x AND NOT (a OR b)", "x a b OR NOT AND"), ("NOT NOT a", "a NOT NOT")])
def test_postfix(infix, postfix):
    assert to_postfix(infix) == postfix


@pytest.mark.parametrize("bad", ["a b", "", "(a", "a)", "AND a", "a OR"])
def test_syntax(bad):
    with pytest.raises(ValueError):
        parse(bad)


@pytest.mark.parametrize(("text", "tokens"), [("An- und Abreise", ["Abreise"]), ("Nord-, Süd- und Ost", ["Ost"]), ("Spielspaß und -freude", ["Spielspaß"]), ("Wort-\nteil", ["Wortteil"]), ("Begriffs- klassifikation", ["Begriffsklassifikation"]), ("Data-Science", ["Data", "Science", "DataScience"]), ("IT-Abteilung", ["IT", "Abteilung", "TAbteilung"]), ("E Mail 42 Haus.Garten. a", ["Mail", "Haus.Garten"])])
def test_hyphens_and_tokens(spark, text, tokens):
    row = spark.createDataFrame([(text,)], "text string").select(X.tokens(X.normalize_hyphens(F.col("text"))).alias("t")).first()
    assert row.t == tokens


def test_analyzer(spark):
    docs = spark.createDataFrame([(1, "x d.h. Straße der Daten daten")], "doc_id int, text string")
    config = A.Analyzer([("d.h.", "das heißt")], ["der", "das"], {"Daten": "Datum"}, hyphens=True)
    assert [(r.pos, r.token) for r in A.analyze(docs, config).orderBy("pos").collect()] == [(0, "heisst"), (1, "strasse"), (2, "datum"), (3, "daten")]


def test_index_properties(index):
    tokens = index.tokens.count()
    assert index.postings.agg(F.sum("tf")).first()[0] == tokens
    assert {r[0] for r in index.postings.groupBy("doc_id").agg(F.max("norm_tf")).select("max(norm_tf)").collect()} == {1.0}
    long = {(r.token, r.doc_id): r.tfidf for r in export.tfidf_long(index.postings, index.terms, index.postings.selectExpr("4L as n").limit(1)).collect()}
    assert math.isclose(long["science", "d2"], math.log(4 / 2))


def test_matrix_is_whole(spark, index):
    """The registered matrix is the long one; the wide one has a row for each token and the cells of the long one."""
    assert "tfidf_matrix" not in queries.queries() and "tfidf_long" in queries.queries() and "tfidf_long" in queries.oracle_sql()
    n = index.postings.selectExpr("4L as n").limit(1)
    ids = [d for d, _ in DOCS]
    wide = {r.token: r for r in export.tfidf_matrix(index.postings, index.terms, n, ids).collect()}
    assert set(wide) == {"data", "science", "labor"}
    cells = {(t, d): round(r[f"tfidf_{d}"], 9) for t, r in wide.items() for d in ids if r[f"tf_{d}"]}
    assert cells == {(r.token, r.doc_id): round(r.tfidf, 9) for r in export.tfidf_long(index.postings, index.terms, n).collect()}


def test_links(spark):
    rows = [("",), ("#top",), ("mailto:q@a.de",), ("/f.pdf",), ("/f.PDF",), ("/v?f=x.pdf",), ("/p?q=1#z",), ("foo.html",), ("https://other.de/",)]
    df = spark.createDataFrame(rows, "href string").where(urls.crawlable(F.col("href"))).select("href", urls.absolute(F.col("href"), F.lit("http://www.a.de/x/y.html")).alias("url"))
    white = links.expand_whitelist(spark.createDataFrame([("a.de",), ("10.0.0.1",)], "host string"))
    assert {r.host for r in white.collect()} == {"a.de", "www.a.de", "10.0.0.1"}
    got = {r.href: r.url for r in links.internal(df, white).collect()}
    assert got == {"/f.PDF": "http://www.a.de/f.PDF", "/v?f=x.pdf": "http://www.a.de/v?f=x.pdf", "/p?q=1#z": "http://www.a.de/p?q=1", "foo.html": "http://www.a.de/foo.html"}


def test_html():
    page = '<p class="bodytext">B</p><h1 class="csc-firstHeader">H</h1><p class="csc-subheader">S</p><p>no</p>'
    assert html.extract(page) == "H. S. B. "
    assert html.extract("<p>no</p>") == html.extract(None) == ""


def test_lexicons(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x.;eins \nx.; zwei\nbad\ny;a;b\n")
    assert {r.key: r.value for r in lexicons.abbreviations(spark, str(tmp_path / "a.txt")).collect()} == {"x.": "zwei"}
    assert lexicons.stopwords(spark, str(tmp_path / "none.txt")).count() == 0
    lines = spark.createDataFrame([(0, "1 ging gehen"), (1, "2 ging laufen"), (2, "3 gehen gehen"), (3, "4 x --"), (4, "5 y")], "line_no long, value string")
    assert [(r.word, r.lemma) for r in lexicons.corpus_lemmata(lines, columns=3).collect()] == [("ging", "gehen")]


def test_verbs():
    pairs = [("fährt", "VVFIN"), ("heute", "ADV"), ("ab", "PTKVZ"), ("fährt", "VVFIN")]
    assert verbs.merge_verbs(pairs, {"abfährt"}.__contains__) == [("abfährt", "VVFIN"), ("heute", "ADV"), ("fährt", "VVFIN")]


@pytest.mark.parametrize("buckets", [1, 3, 16, 64])
def test_saved_index(spark, index, sf, tmp_path, buckets):
    """A saved index gives the same hits however many buckets it has, and reads those of its tokens only."""
    tables.save_index(index, str(tmp_path / "i"), buckets)
    again = tables.load_index(spark, str(tmp_path / "i"))
    for words in (["science"], ["science", "labor"], ["unknown"]):
        assert scores(S.free_search(again, words)) == scores(S.free_search(index, words))
    assert [r.doc_id for r in S.search(again, "NOT science", "boolean").collect()] == ["d3"]
    assert [(r.doc_id, r.first_pos) for r in S.search(again, "science data", "phrase").collect()] == [("d2", 0), ("d1", 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    built = I.build_index(docs, path=str(tmp_path / "b"), buckets=buckets)
    plain = I.build_index(docs)
    for words in (["der", "und", "die"], ["the"], ["que", "la", "of"]):
        assert scores(S.free_search(built, words)) == scores(S.free_search(plain, words)) != []
    plan = S.free_search(built, ["der"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("PartitionFilters: [isnotnull(bucket") == 2


def test_index_over_written_tables(index):
    """The number of documents is that of documents with a posting."""
    assert index.n.first()["n"] == 3 and sorted(r.doc_id for r in index.docs.collect()) == ["d1", "d2", "d3"]


def test_phrase_order(spark, index):
    docs = spark.createDataFrame([(k, "x " * 2 * (9 - k) + "yy zz") for k in range(8)] + [(9, "yy zz"), (8, "yy zz")], "doc_id int, text string").selectExpr("doc_id", "replace(text, 'x ', 'xx ') AS text")
    got = [(r.first_pos, r.doc_id) for r in S.phrase_search(I.build_index(docs), ["yy", "zz"]).collect()]
    assert got == sorted(got) and got[:2] == [(0, 8), (0, 9)] and len(got) == 10


def test_terminal(spark, index, tmp_path, capsys):
    tables.save_index(index, str(tmp_path))
    cli.main([str(tmp_path), "science"], spark)
    cli.main([str(tmp_path), "-b", "science AND NOT labor"], spark)
    cli.main([str(tmp_path), "-p", "-k", "1", "science", "data"], spark)
    cli.main([str(tmp_path), "unknown"], spark)
    head = [S.FOUND, ""]
    assert capsys.readouterr().out.splitlines() == [*head, "d2", "d1", *head, "d1", *head, "d2", S.NOTHING]


def test_save_and_load(spark, index, tmp_path):
    tables.save_index(index, str(tmp_path))
    export.index_json(I.positional_index(index.tokens), str(tmp_path / "json"))
    matrix = export.tfidf_matrix(index.postings, index.terms, index.postings.selectExpr("4L as n").limit(1), ["d1", "d2"])
    export.matrix_csv(matrix, I.lemma_words(index.tokens), str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).count() == 3


SITE = {
    "http://a.de/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret\n", ""),
    "http://a.de/": (200, "text/html", '<title>T &amp; U</title><a href="/b">b</a><a href="/secret/x">s</a><a href="/r">r</a><a href="http://c.de/">c</a><p class="bodytext">Eins</p>', ""),
    "http://a.de/b": (200, "text/html", '<title>B</title><a href="/">home</a><p class="bodytext">Zwei</p>', ""),
    "http://a.de/r": (301, "text/html", "", "/b2"),
    "http://a.de/b2": (200, "application/pdf", "x", ""),
}


def test_crawl(spark, tmp_path):
    site = dict(SITE)
    pages = crawl.crawl(spark, "http://a.de/", [], str(tmp_path / "crawl"), lambda u: site.get(u, (404, "", "", "")), polite=0)
    assert {r.url: (r.title, r.text) for r in pages.collect()} == {"http://a.de/": ("T & U", "Eins. "), "http://a.de/b": ("B", "Zwei. ")}
    crawl.write_log(pages, str(tmp_path / "log"))


def test_crawl_markup(spark, tmp_path):
    """Links of any case and quotes, titles with attributes, registered domains by suffix, robots asked once a host."""
    asked = []
    site = {
        "http://www.a.co.uk/robots.txt": (404, "", "", ""),
        "http://x.a.co.uk/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /no\nAllow: /no/yes\n", ""),
        "http://www.a.co.uk/": (200, "text/html", "<TITLE lang=en>A &lt; B</TITLE><A HREF='/one'>1</A><a class=x href=/two>2</a><a href='http://x.a.co.uk/no/1'>n</a><a href='http://x.a.co.uk/no/yes'>y</a><a href='http://b.co.uk/'>b</a>", ""),
        "http://www.a.co.uk/one": (200, "text/html", "<p class=bodytext>Eins", ""),
        "http://www.a.co.uk/two": (200, "text/html", "<title>Two</title>", ""),
        "http://x.a.co.uk/no/yes": (200, "text/html", "<title>Yes</title>", ""),
    }

    def fetcher(url):
        with open(tmp_path / "asked", "a") as f:
            f.write(url + "\n")
        return site.get(url, (404, "", "", ""))

    pages = crawl.crawl(spark, "www.a.co.uk/", ["a.co.uk"], str(tmp_path / "crawl"), fetcher, polite=0, suffixes=["uk", "co.uk"])
    got = {r.url: r.title for r in pages.collect()}
    asked = (tmp_path / "asked").read_text().split()
    assert got == {"http://www.a.co.uk/": "A < B", "http://www.a.co.uk/one": "", "http://www.a.co.uk/two": "Two", "http://x.a.co.uk/no/yes": "Yes"}
    assert len(asked) == len(set(asked)) == 6 and "http://b.co.uk/" not in asked


def test_fetch_follows_nothing():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/r" else 404 if self.path == "/n" else 200)
            self.send_header("Location", "/elsewhere")
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write("ü".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert crawl.http_fetch(f"{at}/r") == (302, "text/html", "ü", "/elsewhere")
    assert crawl.http_fetch(f"{at}/n")[0] == 404 and crawl.http_fetch(f"{at}/ä?q=ö")[:3] == (200, "text/html", "ü")
    server.shutdown()
    server.server_close()
    assert crawl.http_fetch(f"{at}/", timeout=1)[0] == crawl.http_fetch("ftp://x/")[0] == crawl.http_fetch("nothing")[0] == 0


def test_tagger(spark):
    """Features are those of the sequence so far, and the chain merges, joins and drops by sentence."""
    seen = []
    tags = {"fährt": "VVFIN", "ab": "PTKVZ", "Oh": "ITJ", "Tür": "NN", "Griff": "NN"}

    def classify(f):
        seen.append(f)
        return tags.get(f["word"], "ADV")

    assert verbs.sequential(classify)(["Er", "fährt", "GmbH"]) == ["ADV", "VVFIN", "ADV"]
    assert seen[2] == {"word": "GmbH", "lower": "gmbh", "suffix3": "mbh", "prefix1": "G", "prevword": "fährt", "prevprevword": "Er", "prevtag": "VVFIN", "prevprevtag": "ADV", "prevword+word": "fährt+GmbH", "prevtag+word": "VVFIN+GmbH", "prevprevtag+word": "ADV+GmbH", "shape": "upcase"}
    assert seen[0]["prevtag+word"] == "None+Er"
    config = A.Analyzer(tagger=verbs.sequential(lambda f: tags.get(f["word"], "ADV")), is_word={"abfährt", "Türgriff"}.__contains__, compounds=True)
    docs = spark.createDataFrame([(1, "Zug fährt heute ab. Oh Tür Griff! ab"), (2, None)], "doc_id int, text string")
    assert [r.word for r in A.analyze(docs, config).orderBy("pos").collect()] == ["Zug", "abfährt", "heute", "Türgriff", "ab"]
    got = spark.createDataFrame([("gingen",), ("x",), (None,)], "w string").select(verbs.stemmed(F.col("w"), lambda w: ["ging", "gehen"] if w == "gingen" else []).alias("s")).collect()
    assert [r.s for r in got] == ["gehen", "x", None]


def test_json_blocks(spark, index, tmp_path):
    posted = I.positional_index(index.tokens)
    rows = I.nested(posted, per_row=1).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.token, r.cf), {}).update({d: (v.norm_tf, list(v.positions)) for d, v in r.docs.items()})
    assert whole["data", 4] == {"d1": (1.0, [0, 2]), "d2": (1.0, [1]), "d3": (1.0, [0])} and len(rows) > len(whole) == 3


def test_stream_repeats(spark, tmp_path):
    """A document that comes again counts once."""
    source, schema = str(tmp_path / "in"), "doc_id string, text string"
    for part in (DOCS[:2], DOCS[1:], DOCS[:1] * 2):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "index"), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    got = ingest.ingested(spark, str(tmp_path / "index"))
    assert got.n.first()["n"] == 3 and {r.token: (r.cf, r.df) for r in got.terms.collect()} == {"data": (4, 3), "science": (2, 2), "labor": (2, 2)}


def test_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "doc_id string, text string"
    for part in (DOCS[:2], DOCS[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "index"), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    got = ingest.ingested(spark, str(tmp_path / "index"))
    assert scores(S.free_search(got, ["science", "labor"])) == [("d2", 0.352183), ("d3", 0.176091), ("d1", 0.088046)]


def exchanges(df):
    """The keys by which a plan deals out rows, and why."""
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", df._jdf.queryExecution().executedPlan().toString())
    return [(re.sub(r"#\d+L?", "", keys), why) for keys, why in found]


TEXTS = [("doc_id", "REPARTITION_BY_NUM")]


def test_tasks_follow_bytes(sf, spark, monkeypatch):
    """What one task has the texts of does not grow with the table: more bytes are more tasks, and an id stays in one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert A.tasks_for(docs) == 4 and A.tasks_for(spark.createDataFrame(DOCS, "doc_id string, text string")) == 0
    monkeypatch.setattr(A, "TASK_BYTES", 10_000)
    assert A.tasks_for(docs) == 4 * -(-os.path.getsize(f"{sf}/documents.parquet") // 40_000) > 4
    dealt = A.spread(docs.union(docs), "doc_id").select("doc_id", F.spark_partition_id().alias("p")).groupBy("doc_id").agg(F.count_distinct("p").alias("parts"), F.count("*").alias("n"))
    assert {(r.parts, r.n) for r in dealt.select("parts", "n").distinct().collect()} == {(1, 2)}
    assert A.spread(docs).select(F.spark_partition_id().alias("p")).distinct().count() > 4


#: Queries on the index, and the tables that are built for them.
NEED = [
    ("phrase_repeat", "tokens"),
    ("doc_freq", "postings terms"),
    ("phrase_2", "tokens"),
    ("bool_and", "postings"),
    ("inverted_index", "postings terms"),
]


@pytest.mark.parametrize(("name", "needed"), NEED)
def test_index_of_need(spark, sf, monkeypatch, tmp_path, name, needed):
    """Only the tables that a query reads are built, and for tokens and postings nothing but texts is dealt out."""
    monkeypatch.setattr(queries, "_SAVED", {})
    monkeypatch.setattr(tables, "scratch", lambda *_: str(tmp_path / "index"))
    dealt, save = [], tables.save_dealt
    monkeypatch.setattr(I, "save_dealt", lambda table, *args: (dealt.append(exchanges(table)), save(table, *args))[1])
    queries.queries()[name](spark, sf)
    assert {x.name for x in (tmp_path / "index").iterdir()} == set(needed.split())
    assert dealt == [TEXTS]


@pytest.mark.parametrize("part", [1, 3, 1 << 18])
def test_statistics_of_frequent_tokens(index, monkeypatch, part):
    """Whichever tokens count as frequent, the rows are those of the plain join, and rows of frequent tokens are not dealt out."""
    monkeypatch.setattr(I, "FREQUENT", part)
    got = I.with_stats(index.postings, index.terms)
    plain = index.postings.join(index.terms, "token")
    assert sorted(got.collect()) == sorted(plain.select(got.columns).collect()) and got.count() == 7
    plan = export.tfidf_long(index.postings, index.terms, index.n)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[token#\d+\], \[token#\d+\], LeftAnti", plan) and re.search(r"BroadcastHashJoin \[token#\d+\], \[token#\d+\], Inner", plan)


#: Queries that group tokens by document.
TOGETHER = [
    "positional_index",
    "token_context",
    "tagged_context",
    "rel_tf",
    "positions",
    "lemma_ambiguity",
    "norm_tf",
    "term_freq",
]


@pytest.mark.parametrize("name", TOGETHER)
def test_documents_together(spark, sf, name):
    """Only texts are dealt out, by their document: neither tokens nor counts of them are again."""
    assert exchanges(queries.queries()[name](spark, sf)) == TEXTS


def test_smaller_tasks(spark, sf):
    """Four hash tables at once are of half as many texts each."""
    plan = queries.queries()["lemma_ambiguity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan) == ["8"]


def test_hyphens_spared(spark):
    """A text without a hyphen is spared the rules of hyphens, with the same result, and a long word is read once: by each of its letters it would take minutes."""
    texts = ["", "a/b  und  c", "Haus und Hof, usw.", "a/b - c", "An- und Abreise", "ä–\nö", "Soft­ware", "x-- y", "und -tail-", "a_1- und b", "1-2.", "é-, f", None]
    rules = lambda t: X.delete_hyphens(X.split_compounds(X.join_breaks(X.drop_elisions(F.translate(X.collapse_hyphens(t), "/", " ")))))
    head = lambda t: F.regexp_replace(t, "(?U)" + X.elision_head(r"\w"), "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_hyphens(F.col("t")).alias("a"), rules(F.col("t")).alias("b"), X.drop_elisions(F.col("t")).alias("c"), F.regexp_replace(head(F.col("t")), "(?U)" + X.elision_tail(r"\w"), "").alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in rows.collect())
    plan = rows.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan
    began = time.time()
    long = spark.createDataFrame([("x" * 200_000 + " a-b",)], "t string").select(F.length(X.normalize_hyphens(F.col("t"))).alias("n")).first()
    assert long.n == 200_003 and time.time() - began < 10


def test_few_files_are_dealt_out(spark, sf, tmp_path):
    """Files a few more than the cores would leave most of these idle while the last are read."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.queries()["analyze_tokens"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobinPartitioning(4)" in plan
