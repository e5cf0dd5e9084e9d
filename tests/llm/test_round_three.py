"""Filter interactions, runs of words and page wrappers against plain versions."""

import hashlib
import html
import random
import re
import zlib
from itertools import permutations

import pyarrow as pa
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from rulewright.llm import interactions, merkle, periodic, pieces, queries, wrappers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- filter interactions


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        failed = {"A"} if len(w) < 100 else set()
        failed |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        failed |= {"E"} if i is not None and any(j is not None and j < i and (o or "") == t for j, o, _ in docs) else set()
        rows.append((lang or "", i, failed))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[2] for r in mine) - len(gone), sum(r[2] == {f} for r in mine), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone), f,
                ]
        for (p, _, _), v in out.items():
            if p == part:
                v.append(total[v[-1]])
    return out


AUDITED = [
    (1, " ".join(f"w{i}" for i in range(120)), "en"),
    (2, " ".join(f"w{i % 50}" for i in range(150)), "en"),
    (3, "SHOUTING # text", None),
    (4, "", "en"),
    (5, None, "en"),
    (6, " ".join(f"w{i}" for i in range(120)), "de"),
    (7, " ".join(f"w{i}" for i in range(120)), "en"),
    (None, "", "en"),
    (None, None, ""),
    (4, "", "en"),
    (4, "", "de"),
    (4, "quiet", "en"),
    (9, " ".join(["AB%"] * 200), "en"),
    (10, "ÄÖÜ | \U0001f642", "xx"),
    (11, " ".join(f"long{i}" for i in range(30_000)), "xx"),
]
MARKS = [(1, 1, 0), (3, 0, 1), (3, 1, None), (4, 1, 1), (None, 1, 1), (7, None, None), (1, 0, 0)]


def test_interactions_equal_removals_one_after_another(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("n", "A", "part", "digest", "good", "id", "of_id", "first")}).repartition(3)
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("n", "A", "part", "id")})
    got = interactions.audit(docs, labels).collect()
    want = plain_audit(AUDITED, MARKS)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "filter", "shapley")] for r in got} == want
    assert len(got) == len(want) == 4 * 600
    assert interactions.audit(docs.limit(0), labels).count() == 0
    none = interactions.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0]
    assert none == 0


def test_interactions_of_a_hot_text(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = interactions.audit(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (row["kept"], row["removed"]) == (2_001, 999)


def test_interactions_equal_sql(spark, data, oracle):
    got = queries.QUERIES["op11_filter_interactions"](spark, data).toPandas()
    assert canonical(got) == canonical(oracle.sql(queries.ORACLES["op11_filter_interactions"]).df())


# -- runs of words


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                found.append((s, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, length, q = best[0] if best else (None, None, None)
    return (
        doc_id, len(found), s, length, q, 1000 * length // q if best else None,
        digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped)),
    )


def word_lists(rng, count):
    for _ in range(count):
        letters = "abcdefg"[: rng.choice([1, 2, 3, 5, 7])]
        w = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.randint(3, 7)
            at = rng.randint(0, len(w))
            w[at:at] = unit[: len(unit) - rng.randint(0, 3)]
        yield w


def test_runs_equal_a_search_for_every_period():
    rng = random.Random(11)
    lists = list(word_lists(rng, 600))
    for lo in range(0, len(lists), 7):
        part = lists[lo : lo + 7]
        found = periodic.text_runs([None] * len(part), pa.array([" ".join(w) for w in part]), False)
        for w, (_, own) in zip(part, found, strict=True):
            assert [tuple(r) for r in own.tolist()] == plain_runs(w), w


def test_runs_of_a_table_with_planted_ones(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(w), "x") for i, w in enumerate(word_lists(rng, 400))]
    rows += [(None, "a " * 40, "x"), (None, None, "x"), (7, "", "x"), (7, " \x0b ", "x"), (30, "\u2003 " * 9, "x"), (30, "go " * 9, "x"), (30, "go " * 9, "x")]
    rows += [(1_000 + i, " ".join(f"w{k % (50 + i)}" for k in range(900)), "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3)
    got = sorted((tuple(r) for r in periodic.periodic_runs(docs, plant=True).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert sum(periodic.planted(i, 500) is not None for i, _, _ in rows) > 20
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    listed = periodic.periodic_runs(docs.where("doc_id = 30"), listed=True).select("doc_id", F.size("runs").alias("n")).collect()
    assert sorted(r["n"] for r in listed) == [1, 1, 1, 3]


@pytest.mark.parametrize(
    ("words", "want"),
    [
        (["a"] * 100_000, [(0, 100_000, 1)]),
        (["a", "b"] * 50_000, [(0, 100_000, 2)]),
        (["a"] * 5_000 + ["b"] + ["a"] * 5_000, [(0, 5_000, 1), (5_001, 5_000, 1)]),
        ([f"w{i % 3_000}" for i in range(60_000)], [(0, 60_000, 3_000)]),
    ],
)
def test_runs_of_very_long_texts(words, want):
    ((row, own),) = periodic.text_runs([None], pa.array([" ".join(words)]), False)
    assert [tuple(r) for r in own.tolist()] == want and row[0] == len(want)


def test_runs_of_the_corpus(spark, data):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 4000").select("doc_id", "text").collect()
    assert len(docs) > 100 and all(got[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in docs)


# -- page wrappers


def page(body, host="a.example"):
    return f"http://{host}/x", f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, wrapper string, pages int").repartition(3)
    return {r["page_id"]: r["text"] for r in wrappers.main_texts(df).collect()}


def test_pages_of_the_corpus_give_their_articles(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op13_wrapper_extraction"](spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_what_is_not_main_text_goes(spark):
    inner = (
        "<header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><main><article><h1>Title {0}</h1><p>One &amp; two\n {0}<p>Three <b>bold</b>text<br>four"
        "<aside>Aside</aside><div class=ad-slot>Buy</div><form><p>Name</p></form><ul><li>x{0}<li>y</ul><style>p{{}}</style><section id=comments><p>First!</p></section></article></main>"
        "<div id='sidebar2'>Side</div><footer>&copy;</footer>"
    )
    got = texts(spark, [page(inner.format(i)) for i in range(5)])
    assert got[3] == "Title 3\n\nOne & two 3\n\nThree boldtext four\n\nx3\n\ny"


def test_pages_without_article(spark):
    body = "<div class=top><a href=/>Home</a> <a href=/b>News</a></div><div><h2>Head {0}</h2><p>Some longer running text of page {0} is here.</p><p>More {0}</p></div><p>All rights reserved</p><div class=other><p>Short {0}</p></div>"
    got = texts(spark, [page(body.format(i)) for i in range(6)])
    assert got[2] == "Head 2\n\nSome longer running text of page 2 is here.\n\nMore 2"


def test_wrapper_has_slots_repeats_and_options():
    one, two, three = (wrappers.wrapper_of(wrappers.read_page(page(b)[1])) for b in ("<article><h1>A</h1><p>x<p>y</article><footer>F</footer>", "<article><h1>B</h1><img src=a><p>x</article><footer>F</footer>", "<article><h1>C</h1><div class=note>n</div><p>z</article><footer>F</footer>"))
    both = wrappers.aligned(wrappers.aligned(one, two), three)
    body = both[0][5][1][5]
    article, footer = body
    assert [(x[3], x[1], x[2]) for x in article[5]] == [("h1", 0, 0), ("div class=note", 1, 0), ("p", 0, 1)]
    assert article[5][0][5][0][3] is None and footer[5][0][3] is not None
    squares = wrappers.wrapper_of(wrappers.read_page("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert squares[0][5][0][0] == "g" and squares[0][5][0][2] == 1 and [x[3] for x in squares[0][5][0][3]] == ["dt", "dd"]


def test_every_page_of_a_host_is_accepted_by_its_wrapper():
    rng = random.Random(5)
    unit = ["<p>{0}", "<h2>{0}</h2>", "<ul><li>{0}<li>b</ul>", "<blockquote><p>{0}</blockquote>", "<div class=k>{0}<p>q</div>", "<table><tr><td>{0}</table>", "<hr>"]
    pages, content = [], None
    for i in range(150):
        body = "".join(rng.choice(unit).format(f"t{i}x{k}") for k in range(rng.randint(0, 60)))
        pages.append(wrappers.read_page(page(f"<nav>{'<a href=x>l</a>' * (i % 3)}</nav><article>{body}</article>")[1]))
        own = wrappers.wrapper_of(pages[-1])
        content = own if content is None else wrappers.aligned(content, own)
    wrapper = wrappers.Wrapper(content, len(pages))
    accepted = sum(wrapper.match(content, p, []) for p in pages)
    assert accepted == len(pages)


def test_odd_pages(spark):
    rows = [page("<article><p>same</article>")] * 4 + [(None, "<article>no host</article>"), ("nonsense", "plain &lt;text&gt; only"), page(""), ("http://a.example/2", None), (None, None), ("http://a.example/3", "")]
    rows += [page("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep.example"), page("<article><p>" + "word " * 200_000 + "</article>", "long.example"), page("<article><p title='a>b\">x</p><p>cut <b", "cut.example")]
    rows += [page("<article><p>a < b & c &copy; &#x41; &nbsp; d</p><!-- <p>no --><p hidden>no</p></article>", "e.example")]
    got = texts(spark, rows)
    assert [got[i] for i in range(10)] == ["same"] * 4 + ["no host", "plain <text> only", "", "", "", ""]
    assert got[10] == "deep" and len(got[11]) == 999_999 and got[13] == "a < b & c © A d"
    assert wrappers.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_in_rounds_and_by_shuffle_are_the_same(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet").repartition(9)
    want = sorted((r["page_id"], r["text"]) for r in wrappers.main_texts(pages).collect())
    monkeypatch.setattr(wrappers, "RADIX", 2)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 5_000)
    assert sorted((r["page_id"], r["text"]) for r in wrappers.main_texts(pages).collect()) == want


# -- hot rows, long runs of one character, archives of repeated and null ids


def test_rows_repeated_often_are_scored_once(spark, monkeypatch):
    from rulewright.llm import common, crossentropy

    rows = [(i, f"alpha beta w{i % 7} w{i % 5}") for i in range(60)] + [(None, "hot hot alpha")] * 50 + [(3, "gamma hot")] * 40 + [(None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    want = [canonical(crossentropy.score(docs, targets, own_counts=own).toPandas()) for own in (True, False)]
    monkeypatch.setattr(crossentropy, "BLOCK_CHARS", 800)
    assert crossentropy._repeated(docs, 2_000).count() == 2
    assert [canonical(crossentropy.score(docs, targets, own_counts=own).toPandas()) for own in (True, False)] == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert [canonical(crossentropy.score(docs, targets, own_counts=own).toPandas()) for own in (True, False)] == want
    flagged = common.marked(docs, targets.distinct(), "doc_id", "good")
    assert flagged.where("good").count() == 60 and flagged.count() == len(rows)  # 20 ids once, and the 40 repeats of id 3


def test_one_of_each_with_hot_keys(spark, monkeypatch):
    import corpus_pipeline
    from rulewright.llm import common

    rows = [(None, "same text here")] * 60 + [(7, "other text")] * 40 + [(7, "third")] * 3 + [(i, f"t{i % 40}") for i in range(100, 180)] + [(None, f"n{i}") for i in range(20)]
    docs = spark.createDataFrame([(*r, "en", "a", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = sorted(map(tuple, corpus_pipeline.exact_stage(spark, docs, "").collect()), key=repr)
    assert len(want) == 1 + 1 + 1 + 40 + 20
    monkeypatch.setattr(common, "BROADCAST_ROWS", 15)
    assert sorted(map(tuple, corpus_pipeline.exact_stage(spark, docs, "").collect()), key=repr) == want


def plain_nbest(v, text, n):
    """Scores of the n best paths, by keeping the n best of every place."""
    symbols = [chr(s) if s < 0x110000 else "\0" for s in pieces.symbols_of(text).tolist()]
    best = [[0.0]] + [[] for _ in symbols]
    for end in range(1, len(symbols) + 1):
        found = []
        for start in range(max(0, end - v.longest), end):
            piece = v.ids.get("".join(symbols[start:end]))
            s = v.scores[piece] if piece is not None else v.unknown if start == end - 1 else None
            if s is not None:
                found += [x + s for x in best[start]]
        best[end] = sorted(found, reverse=True)[:n]
    return best[-1]


@pytest.mark.parametrize("text", ["-" * 700, "a" * 1_500, "ab" * 600, "-=" * 500, "\U0001f642" * 300, " " * 900, "aaaa----" * 100, "x" + "-" * 520 + "y"])
def test_tied_paths_are_as_good_as_any(text):
    import time

    v = pieces.load_vocabulary(queries.MODEL_PATH)
    found = pieces.nbest(v, text)
    assert [round(s, 6) for s, _ in found] == [round(s, 6) for s in plain_nbest(v, text, pieces.NBEST)]
    assert len({tuple(ids) for _, ids in found}) == len(found) and all(pieces.decode(v, ids) == text for _, ids in found)
    began = time.perf_counter()
    assert all(pieces.decode(v, ids) == text * 20 for _, ids in pieces.nbest(v, text * 20))
    assert time.perf_counter() - began < 20


def test_archives_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, f"u{i % 4}", "x" * i) for i in range(6)] + [(None, f"n{i % 9}", "y") for i in range(30)] + [(2, "a", "b")] * 3 + [(5, f"c{i}", "crowd") for i in range(45)]
    records = spark.createDataFrame(rows, "record_id long, url string, html string").select("record_id", merkle.warc_record(F.col("url"), F.col("html"), F.col("record_id")).alias("record")).repartition(3)
    merkle.write_archives(records, f"file://{tmp_path}/w", file_records=10)
    got = merkle.read_archives(spark, f"file://{tmp_path}/w").select("file", "offset", "length", "digest").collect()
    layout = merkle.archive_layout(records, file_records=10)
    want = [(r["file"], r["offset"] + k * r["length"], r["length"], r["digest"]) for r in layout.collect() for k in range(r["copies"])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == len(rows)
    assert len({f for f, *_ in want if f < 0}) > 3


@pytest.mark.parametrize("name", ["license_base_places", "media_payloads"])
def test_base_columns_equal_sql(spark, data, oracle, name):
    assert canonical(queries.QUERIES[name](spark, data).toPandas()) == canonical(oracle.sql(queries.ORACLES[name]).df())
