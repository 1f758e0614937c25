import hashlib
import re
import time

import pytest

from itinera.llm import html_text, private_data, secret_scan

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
SECRETS = [
    None, "", "nothing here", f'token = "{HEX}" \U0001F600 password:hunter2hunter2', "PASSWORD=short api_key=ABCDEFGH12",
    "AKIAABCDEFGHIJKL AKIA AKIASHORT", "é" * 5 + "AKIA" + "Z9" * 8, "secret='aaaaaaaaaa' Secret : \"bb/cc+dd==\"",
    HEX.upper() + " " + HEX + HEX, "paſsword=12345678 toKen=12345678", "passwd==abcdefgh.password=abcdefgh",
    "ghp_A9x8B7c6D5e4F3g2H1i0J9k8 bare", "x" * 200_000 + " password=" + "q1" * 20,
]


def brute_secrets(text):
    out = []
    name = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                            for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")"
    for i, (p, test) in enumerate((
            (name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
            (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", lambda m: len(m[0]) >= 32))):
        out += [(m.start(), i, m.end()) for m in re.finditer(p, text) if test(m)]
    return sorted(out)


def check_secrets(rows, texts):
    for r in rows:
        want = brute_secrets(texts[r.doc_id] or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, joined, r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_secrets(spark):
    rows = [(i, t, "x" if i % 2 else None, "clash", 1) for i, t in enumerate(SECRETS)] + [(3, SECRETS[3], "x", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, spans string, key int")
    got = secret_scan.scan_secrets(docs).collect()
    assert len(got) == len(rows)
    check_secrets(got, dict(enumerate(SECRETS)))
    by = {r.doc_id: r for r in got}
    assert by[11].spans == "token:0:28" and by[11].n_live == 1
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_secret_ownership_and_redaction(spark):
    rows = [(i, f"key password=Example99value {i} token=Own{i}Secret{i}xyz", f"owner{i}") for i in range(4)]
    rows.append((None, "clean text", None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = secret_scan.scan_secrets(docs)
    by = {r.doc_id: r for r in got.collect()}
    assert [(by[i].n_live, by[i].n_example) for i in range(4)] == [(1, 1)] * 4
    assert by[0].details[0].owners == 4 and by[0].details[0].repositories == 4
    text = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs, got).collect()}
    assert text[2] == "key password=Example99value 2 [secret]" and text[None] == "clean text"
    assert secret_scan.redact_secrets(docs, got).columns == docs.columns


def test_secrets_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_secrets(secret_scan.scan_secrets(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


PRIVATE = [
    None, "", "mail a@b.c_d@e.f, x.y@z", "ip 10.0.0.256 1.2.3.4.5.6.7.8 0000255.1.1.1 999.1.1.1", "+1 (555) 010-9999) +12",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4 5", "\U0001F600 é +49 30 1234567 a@b.co\U0001F600b@c.d",
    "a@@b.c @x.y a@b. c@d", "1" * 3000 + ".1.1.1", "z" * 100_000 + "@q.r" + ".s" * 5000, "+" * 50 + "1" * 20,
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_private(text):
    out = []
    for i, (p, test) in enumerate((
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-3:]) <= 255 and not x[:-3].strip("0") for x in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15))):
        if i == 0 and len(text) > 50_000:
            continue
        out += [(i, m.start(), m.end()) for m in re.finditer(p, text) if test(m[0])]
    return out


def check_private(rows, texts):
    for r in rows:
        if len(texts[r.doc_id] or "") > 90_000:
            assert r.n_email == 1
            continue
        want = brute_private(texts[r.doc_id] or "")
        joined = ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, joined, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in want) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_private(spark):
    rows = [(i, t, "clash") for i, t in enumerate(PRIVATE)] + [(2, PRIVATE[2], "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    got = private_data.find_private(docs).collect()
    assert len(got) == len(rows)
    check_private(got, dict(enumerate(PRIVATE)))
    assert private_data.find_private(docs.limit(0)).count() == 0


def test_private_bootstraps(spark):
    rows = [(i, f"Please call office: +49 30 55512{i:02d} today. My card number is 4111 1111 1111 1111 now") for i in range(8)]
    rows += [(100, "Please call office: (030) 555 7788 today"), (101, "In the year 1999 12345 67 people met")]
    got = {r.doc_id: r for r in private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].n_found == 1 and got[100].spans == "phone:20:34" and got[101].n_found == 0
    plan = private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_private_contexts_of_as_many_unseen(spark):
    rows = [(i, f"Please call office: +49 30 55512{i:02d} today") for i in range(30)]
    rows += [(100 + i, f"Please call office: (030) 555 77{i:02d} today") for i in range(30)]
    rows += [(200 + i, f"reach desk +49 40 77712{i:02d} today") for i in range(3)] + [(210, "reach desk (040) 777 8899 today")]
    rows += [(300 + i, f"about +49 50 33312{i:02d} today") for i in range(3)] + [(310 + i, f"about 1234 56{i:02d} 78 people") for i in range(60)]
    got = {r.doc_id: r.n_found for r in private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[100 + i] == 1 for i in range(30)) and got[210] == 1
    assert not any(got[310 + i] for i in range(60))


def test_private_second_generation(spark):
    rows = [(i, f"Please call office: +49 30 55512{i:02d} today") for i in range(12)]
    rows += [(100 + i, f"Please call office: (030) 555 77{i:02d} today") for i in range(6)]
    rows += [(200 + i, f"The extension reads (030) 555 77{i:02d} today") for i in range(6)]
    rows += [(300 + i, f"The extension reads (040) 999 11{i:02d} today") for i in range(3)]
    rows += [(400 + i, f"Their hotline says (040) 999 11{i:02d} today") for i in range(3)] + [(410, "Their hotline says (050) 111 2233 today")]
    rows += [(500, "In all 1999 12345 67 people met"), (501, "The extension has 1234 5678 90 rooms")]
    found = private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.n_found for r in found.collect()}
    assert all(got[k] == 1 for k in got if 100 <= k < 500), got
    assert not got[500] and not got[501]
    assert "Python" not in found._jdf.queryExecution().toString()


def test_private_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_private(private_data.find_private(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


PAGE = """<html><head><title>No</title></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, ok?</p></div>
<nav><a href="/">Home</a></nav><div id="main"><div class="post-body"><h2>Title &amp; more</h2><p>First para, with commas, and
text   long enough.<p>Second <a href=x>link</a> para<br>line.</p><div class="advert"><p>Buy now, please, now.</p></div>
<!-- <p>hidden</p> --><blockquote>Quote&nbsp;here</blockquote></div><div class="sidebar"><p>Side</p></div>
<section id="comments"><p>Nice post, thanks, a lot, of fun.</p></section></div><form><p>Name</p></form><footer>c</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<script>var a='<p>x</p>'</script>"), (5, "u", "plain &lt;text"),
            (6, "u", '<article><h1>T</h1><p><b>T and<br><p>more &am'), (1, "u", PAGE), (7, "u", "<div>" * 2000 + "deep"),
            (8, "u", '<p>a</p><a href="open')]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id bigint, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text == "Title & more\nFirst para, with commas, and text long enough.\nSecond link para line.\nQuote here"
    assert by[1].n_chars == len(by[1].text)
    assert [by[i].text for i in (2, None, 4, 5, 6, 7, 8)] == ["", "", "", "plain <text", "T\nT and\nmore &am", "deep", "a"]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'class="hidden-print"', 'title="a hidden gem"',
                                        'class="layout has-sidebar"', 'class="article-header"', 'class="no-sidebar"', 'class="widget"'])
def test_html_containers_stay(attributes):
    article = [f"Paragraph {i}, of a story, that goes on, long enough to count." for i in range(5)]
    page = f"<body><div {attributes}>" + "".join(f"<p>{p}</p>" for p in article) + '</div><div class="top-nav"><p>Menu</p></div></body>'
    assert html_text.main_text(page) == "\n".join(article)


@pytest.mark.parametrize("attributes", ["hidden", "aria-hidden=true", 'style="color:red; display: none"', 'class="ad-banner"', 'id="comments"'])
def test_html_asides_go(attributes):
    assert html_text.main_text(f"<div><p>The article, all of it.</p><div {attributes}><p>Not this, at all.</p></div></div>") == "The article, all of it."


LONG = "A paragraph of the story, which goes on, and on, until it is long enough to count as one."


@pytest.mark.parametrize("page, want", [
    ('<p>The word <span class="notice">never</span> matters, here.</p>', "The word never matters, here."),
    (f'<div><p>{LONG}</p><p><span class="notice">Sale now</span></p></div>', LONG),
    (f'<div><p>{LONG} <span class="share-buttons">Post this</span></p></div>', LONG),
    (f"<body><div><p>{LONG}</p></div><h2>Next part</h2><ul><li>one</li><li>two</li></ul><div><p>{LONG}</p></div></body>",
     f"{LONG}\nNext part\none\ntwo\n{LONG}"),
    ("<body><div><p>Hi</p></div><div><ol>" + "".join(f"<li>Step {i} of the recipe is to stir</li>" for i in range(4)) + "</ol></div></body>",
     "\n".join(f"Step {i} of the recipe is to stir" for i in range(4))),
    (f"<main><article><p>{LONG}</p></article><article><p>Second, {LONG}</p></article></main>", f"{LONG}\nSecond, {LONG}"),
    ("<p>Let <math><mi>x</mi></math> be, press <button>OK</button> now.</p>", "Let x be, press now."),
])
def test_html_keeps_the_whole_article(page, want):
    assert html_text.main_text(page) == want


def test_html_is_linear_in_depth():
    start = time.process_time()
    assert html_text.main_text("<div>x" * 100_000).count("x") == 100_000
    assert html_text.main_text("<ul><li><span>" + "<div>" * 50_000 + "<li>x</p>" * 50_000).count("x") == 50_000
    assert time.process_time() - start < 20


def test_html_of_given_pages(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r.html)
        parts = re.split(r"</?(?:p|h1)>", inside[1] if inside else "")
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in parts]
        assert got[r.page_id] == "\n".join(p for p in plain if p)
