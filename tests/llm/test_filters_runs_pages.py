"""Filter audit, periodic runs and main text against brute force, enumerations and known pages."""

import collections
import hashlib
import html
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from chartloom.llm import filter_audit, main_text, periodic_runs

DOCS = "doc_id bigint, text string, lang string, runs string, words int, hash string, copies string"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(texts):
    return [(i, t, ["en", "fr", None][i % 3], "x", 1, "h", "c") for i, t in enumerate(texts)]


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


# Filter audit


def audit_texts():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["UPPER", "a#b", "50%", "naïve", " ", " x"]
    texts = [None, "", " \t\n", "SHOUTING", "\x0b\x0c x", "a" * 50_000, "one two " * 30_000]
    texts += [" ".join(r.choices(vocabulary[: r.choice([20, 300, 406])], k=r.choice([5, 99, 100, 130]))) for _ in range(60)]
    return texts + texts[7:12] + [texts[8]] + ["ABC " * 120]


def brute_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang, *_ in rows:
        t, w = t or "", words_of(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, total = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                here = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(here) - len(gone), sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone), f)
    return {k: (*v[:-1], total[k[0], v[-1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = rows_of(audit_texts())
    rows += [rows[9], rows[9], rows[0], (None, "no id", "de", "", 1, "", ""), (None, "no id", "de", "", 1, "", ""), (None, rows[9][1], "de", "", 1, "", ""), (9, "another text of one id", "en", "", 1, "", "")]
    labels = [(i, i % 2, None if i % 5 == 0 else int(i % 3 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * 4


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None, "", 1, "", "")], DOCS), labels)
    assert one.count() == 600 and {r["removed"] for r in one.where("step = 1").collect()} == {0, 1}


# Periodic runs


def brute_runs(w, min_length, min_exponent):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            n = end - at + q
            s = w[at : at + n]
            if end > at and n >= max(min_length, min_exponent * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.add((at, n, q))
            at = max(end, at + 1)
    return sorted(out)


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (1, 2), (5, 3), (7, 2)])
def test_runs_of_words(limits):
    r, found = random.Random(7), 0
    for _ in range(1500):
        n, letters = r.randrange(60), r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.6:
            a, p = r.randrange(n), 1 + r.randrange(max(1, n // 4))
            w = [w[k] if k < a else w[min(a + (k - a) % p, n - 1)] for k in range(n)]
        want = brute_runs(w, *limits)
        found += len(want)
        assert periodic_runs.find_runs(w, *limits) == want
    assert found > 500


def test_runs_of_long_texts_take_time_in_proportion():
    r, n = random.Random(1), 60_000
    for w, want in (([0] * n, [(0, n, 1)]), ([k % (n // 5) for k in range(n)], [(0, n, n // 5)]), ([r.randrange(2) for _ in range(n)], None), ([r.randrange(900) for _ in range(n)], [])):
        began = time.time()
        got = periodic_runs.find_runs(w)
        assert time.time() - began < 30 and (want is None or got == want)


def run_texts():
    r = random.Random(11)
    texts = [None, "", " \n", "one", "a b a b a b a b", "a b " * 9, "x " * 8 + "y " * 7, "la  la\tla\nla la la", "Long text " * 30_000]
    texts += [" ".join(f"w{r.randrange(k)}" for _ in range(r.randrange(1, 200))) for k in (2, 3, 50, 500) for _ in range(60)]
    return texts


def test_runs_and_collapsed_text(spark):
    rows = rows_of(run_texts())
    rows += rows[-3:]
    frame = spark.createDataFrame(rows, DOCS).withColumn("Collapsed", F.lit(1))
    out = periodic_runs.find(frame)
    assert out.columns == ["doc_id", "text", "lang", "words", "hash", "copies", "runs", "collapsed"]
    got = collections.Counter((r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in out.collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        runs = [(0, len(w), 2)] if len(w) > 50_000 else brute_runs(w, 6, 4)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want and sum(bool(k[1]) for k in want) > 10
    assert periodic_runs.find(spark.createDataFrame([], DOCS)).count() == 0


def test_periodic_runs_query(spark, tmp_path):
    rows = [r for r in rows_of(run_texts()) if len(r[1] or "") < 50_000] + [(None, "a b c", "en", "", 1, "", "")]
    spark.createDataFrame([(i + 1000 if i is not None else None, *r) for i, *r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.query(spark, str(tmp_path)).collect()}
    made = 0
    for i, t, *_ in rows:
        i = None if i is None else i + 1000
        w = words_of(t)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            made += 1
        runs = brute_runs(w, 6, 4)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[i]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3) and r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert len(got) == len(rows) and made > 10


# Main text

P = "The quick brown fox jumps over the lazy dog &amp; goes on for a while, so that this is a paragraph of some length."
Q = html.unescape(P)
PAGES = [
    (None, ""),
    ("", ""),
    ("<html><head><title>t</title></head><body></body></html>", ""),
    ('<body><nav><a href="/">x</a></nav><footer>owner</footer></body>', ""),
    ("Hello &amp; <b>wor</b>ld&#33;", "Hello & world!"),
    (f'<body><nav><a href="/a">A</a></nav><!-- > --><div class="ad">{P}</div><article><h1>T</h1><p><b>{P}<br><p>To.</p><p>a &lt;b&gt;\n c</p></article><footer>{P}</footer>', f"T {Q} To. a <b> c"),
    (f'<body><header><h1>Site</h1></header><main><article><header><h1>T</h1><p>By one</p></header><p>{P}</p><aside><p>{P}</p></aside><form><label>Mail</label></form><p>End.</p></article><section class="comments"><article class="comment"><p>{P}</p></article></section></main></body>', f"T {Q} End."),
    (f'<body><div id="header"><h1>Site</h1></div><div id="menu"><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id="content"><h1>T</h1><p>{P}</p><p>Short.</p><p>{P} <a href=x>link</a></p></div><div class="sidebar"><p>{P}</p></div><div id="comments"><h3>2 Comments</h3><p>{P}</p></div></body>', f"T {Q} Short. {Q} link"),
    (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>T</h1><p>{P}<p>To.<p>{P}</td><td><a href=3>x</a></td></tr></table><div>Ours</div></body>", f"T {Q} To. {Q}"),
    (f'<body><form id="wraps"><div class="nav"><a href=1>x</a></div><h1>T</h1><div><p>{P}</p><p>{P}</p></div></form></body>', f"T {Q} {Q}"),
    (f'<body><div class="ad">Buy now<article><h1>T</h1><p>{P}</p></article><footer>f</footer></body>', f"T {Q}"),
    (f'<body><div class="cookie-notice">{P}</div><div class="post"><h2>T</h2><div class="entry has-sidebar"><p>{P}</p><ul><li>one</li><li>two</li></ul><p>{P}</p></div></div></body>', f"T {Q} one two {Q}"),
    (f"<body><article><h1>T</h1><p>{P}</p><h3>3 comments</h3><ul><li>{P}</li></ul></article></body>", f"T {Q}"),
    ('<script>if(a<b){"</p>"}</script><style>x{}</style><p title="a > b">1 < 2</p><noscript>no</noscript><div hidden>h</div>', "1 < 2"),
]


def test_known_pages():
    for page, want in PAGES:
        assert main_text.main_text(page) == want, page


def test_odd_pages_take_time_in_proportion():
    for part in ('<a "', "<div>", "<div class=ad>", "&amp;", "<", "<!--", "<svg>", "<a '\"", "<textarea>x", '<p class="ad">x', "<ul><li>x", "<h1><div class=nav>", "</p></div>x"):
        began = time.time()
        main_text.main_text(part * (400_000 // len(part)))
        assert time.time() - began < 15, part


def test_main_text_column(spark):
    rows = [(k, "u", page, "old", 1) for k, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[5], (None, None, PAGES[5][0], None, None)], "page_id bigint, url string, html string, text string, N_chars int")
    out = main_text.add_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter([*((k, "u", t, len(t)) for k, (_, t) in enumerate(PAGES)), (5, "u", PAGES[5][1], len(PAGES[5][1])), (None, None, PAGES[5][1], len(PAGES[5][1]))])
    assert main_text.add_text(pages.limit(0)).count() == 0


def test_html_extraction_query(spark):
    """In the given pages the article is marked: its text, decoded, block by block."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = main_text.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = pages[r["page_id"]]
        inner = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], want, len(want))
