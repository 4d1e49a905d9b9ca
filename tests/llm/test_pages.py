import base64
import gzip
import hashlib
import random

import pytest

from ferrule.llm.html_density import extract, main_text
from ferrule.llm.warc import LoserTree, Reader, archive_index, records, url_key

SCHEMA = "page_id bigint, url string, html string, id string, n string, key string, r string, grouped string, value string"


def page_rows():
    same = "<p>same " + "x" * 300
    rows = [(1, "http://a.example/x", same), (2, "http://a.example/x", same), (3, None, same), (4, "http://b.example/", None), (5, "u\r\nv", ""),
            (6, "http://www.A.example:80/X?q#f", "body with\r\n\r\nempty\r\n\r\n\r\n\r\nlines\r\n\r\n"), (7, "", "\r\n\r\n"), (7, "", "\r\n\r\n"),
            (None, "http://c.example", same), (8, "http://a.example/x", "é漢😀" * 5000), (9, "x", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]
    return [(*r, *["clash"] * 6) for r in rows]


def test_archives_round_trip(spark):
    rows = page_rows()
    for least in (0, 100):
        want = []
        for i, _, h, *_ in rows:
            body = (h or "").encode()
            same = [x[0] for x in rows if (x[2] or "").encode() == body]
            first = max((x for x in same if x is not None), default=None)
            revisit = len(body) >= least and len(same) > 1 and i != first
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
        got = archive_index(spark.createDataFrame(rows, SCHEMA), least=least)
        cols = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
        order = lambda r: tuple((v is not None, v) for v in r)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=order) == sorted(want, key=order)
    assert archive_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_archive_is_a_readable_file(spark, tmp_path):
    from ferrule.llm.warc import write_archives

    write_archives(spark.createDataFrame(page_rows(), SCHEMA).coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("part-*.gz")))
    n = 0
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        size = int(head.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and data[size:size + 4] == b"\r\n\r\n"
        data, n = data[size + 4:], n + 1
    assert n == len(page_rows())
    assert records(spark.createDataFrame(page_rows(), SCHEMA)).count() == n


def test_payloads_that_end_in_line_ends(spark, tmp_path):
    ends = ["\r\n", "\r\n" * 2, "\r\n" * 3, "\r\n" * 4, "\r\n" * 5, "\r", "\r\r", "\n", "\r\n\r", "\r\r\n", "\n\r\n", "\r\n\n", ""]
    rows = [(2 * i + k, "u", body + e) for i, e in enumerate(ends) for k, body in enumerate(("", "<p>one\r\ntwo\r\n\r\nthree"))]
    rows += [(100, "u", "x" * 65_500 + "\r\n"), (101, "u", "y" * 200_000 + "\r\n" * 3), (102, "u", rows[1][2])]
    want = sorted((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows)
    for parts in (1, len(rows)):  # one archive; mostly one record in each
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartitionByRange(parts, "page_id")
        for least in (0, 10**6):
            path = tmp_path / f"{parts}-{least}"
            got = archive_index(pages, least, path=str(path)).collect()
            assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
            data = {f.name: gzip.open(f).read() for f in path.glob("part-*.gz")}
            for r in got:
                head = data[r.archive.rsplit("/", 1)[1]][r.at_byte:].partition(b"\r\n\r\n")[0]
                assert head.startswith(b"WARC/1.1\r\n") and f"\r\nWARC-Record-ID: <urn:x-page:{r.page_id}>\r\n".encode() in head


def test_reader_notices_a_wrong_length():
    head = b"WARC/1.1\r\nContent-Length: %d"
    for size, rest in ((3, [b"ab", b"\r\nWARC/1.1"]), (4, [b"ab", b"WARC/1.1"]), (1, [b"ab"])):
        reader = Reader()
        assert reader.feed("f", head % size) is None
        with pytest.raises(ValueError, match="longer than its Content-Length"):
            for piece in rest:
                reader.feed("f", piece)
    reader = Reader()
    assert [reader.feed("f", p) for p in (head % 4, b"ab", b"\r\n" + head % 0)][:2] == [None, None]
    assert reader.head == {"Content-Length": "0"} and reader.start == len(head % 4) + 4 + 4 + 4
    assert reader.feed("f", b"")[3] == b""


def test_history_is_globally_ordered(spark):
    r = random.Random(3)
    rows = [(i, f"http://h{r.randint(0, 3)}.example/{r.randint(0, 2)}", f"<p>{i}") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    got = [(x.url_key, x.time, x.page_id) for x in archive_index(pages).collect()]
    assert len(got) == 500 and got == sorted(got)


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.choices(range(50), k=r.randint(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for s in runs for x in s)


def test_url_key():
    assert url_key("https://www.Sub.Example.com:443/A?b=1#frag") == "com,example,sub)/a?b=1"
    assert url_key("http://u:p@e.org:8080") == "org,e:8080)/" or url_key("http://e.org:8080") == "org,e:8080)/"
    assert url_key("") == ")/"


ARTICLE = "<article><h1>Title &amp; more</h1><p>First <i>words</i>\n of   it &lt;b&gt;.<br>Next line<p>Second block, unclosed <ul><li>one<li>two</ul></article>"
TEXT = "Title & more\n\nFirst words of it <b>. Next line\n\nSecond block, unclosed\n\none\n\ntwo"


def test_main_text():
    noise = ('<nav><a href=/>Home</a><a href=/x>X</a></nav><div class="ad banner">Buy now, this is a very long advert text without any links at all</div>'
             '<form><input><label>Mail</label></form><aside>Side</aside><div id=sidebar><p>bar</div><script>var t="</p><article>";</script>'
             '<div class="cookie-notice">We use cookies</div><!-- <p>no --><style>p{}</style>')
    tail = '<section class="comments"><article class="comment"><p>A reader says much about it, and goes on for long.</article></section><footer>&copy; me</footer>'
    for page in (f"<html><head><title>T</title></head><body><header>Site</header>{noise}{ARTICLE}{tail}</body></html>",
                 f"<!DOCTYPE html><body>{noise}<main><div>{ARTICLE}{tail}</div></main>", f"{ARTICLE}{noise}"):
        assert main_text(page) == TEXT
    assert main_text('<div class=wrap><div id=content><h2>H</h2><p>Some long text of the page itself.</p><p>And a second paragraph of it.</p></div>'
                     '<div class="copyright"><a href=a>x</a></div></div>') == "H\n\nSome long text of the page itself.\n\nAnd a second paragraph of it."


def part(name, n):
    return "".join(f"<p>{name}{i} {'word ' * 60}</p>" for i in range(n))


def lines(name, n):
    return [f"{name}{i}" + " word" * 60 for i in range(n)]


def test_sibling_parts_are_all_content():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some other page {i}</a>" for i in range(8)) + "</ul>"
    want = "\n\n".join(lines("a", 10) + lines("b", 10) + lines("c", 2))
    assert main_text(f"<body><section>{part('a', 10)}</section><section>{part('b', 10)}</section><section>{part('c', 2)}</section>") == want
    assert main_text(f"<body>{links}<div><div>{part('a', 10)}</div>{links}<section>{part('b', 10)}</section></div><div>{part('c', 2)}</div>{links}") == want
    assert main_text(f"<body><div>Before <i>the</i> parts<section>{part('a', 10)}</section>and between<br>them<section>{part('b', 3)}</section></div>") == \
        "\n\n".join(["Before the parts", *lines("a", 10), "and between them", *lines("b", 3)])
    assert main_text(f"<body><a href=/>Home</a> | <a href=/x>News</a><div>{part('a', 4)}</div><div>{part('b', 4)}</div>") == "\n\n".join(lines("a", 4) + lines("b", 4))


def test_article_rule():
    two = f"<article><h2>One</h2>{part('a', 10)}</article><article>{part('b', 10)}</article>"
    assert main_text(f"<body><div>A line outside of the articles.</div>{two}") == "\n\n".join(["One", *lines("a", 10), *lines("b", 10)])
    # the part of the largest sum is outside of the article: all parts
    assert main_text(f"<body><article><p>Short one.</article><section>{part('a', 10)}</section><div>{part('b', 10)}</div>") == "\n\n".join(
        ["Short one.", *lines("a", 10), *lines("b", 10)])
    assert main_text("<nav>only a menu</nav>") == ""


def test_named_wrappers_keep_the_article():
    text, want = part("a", 10), "\n\n".join(lines("a", 10))
    noise = '<div class="ad banner">Buy now</div><div id=comments><p>A reader says much.</div><form action=/s><label>Mail</label></form>'
    inside = f"<article>{text}</article>"
    for body in (text, inside, f"<main>{text}</main>", f"<main>{inside}</main>"):
        for wrapper in ('div class="content no-sidebar"', "div id=page class='has-comments'", 'div class="post related-enabled"', "form method=post",
                        "form id=aspnetForm class=search", 'section role="search"'):
            end = f"</{wrapper.split()[0]}>"
            assert main_text(f"<body><{wrapper}>{body}{noise}{end}") == want, (body[:9], wrapper)
            assert main_text(f"<body>{noise}<{wrapper}><{wrapper}>{body}{end}{end}{noise}") == want, (body[:9], wrapper)
    assert main_text(f"<body class='single comments-open'>{text}{noise}") == want
    assert main_text(f"<article class='post comments-open'>{text}</article>{noise}") == want
    two = [f"<article><div class='entry share-enabled'>{part(k, 5)}</div>{noise}</article>" for k in "ab"]
    assert main_text("".join(two)) == "\n\n".join(lines("a", 5) + lines("b", 5))


def test_named_elements_beside_a_short_article():
    long = "<p>" + "words that are not the article " * 20
    for noise in (f"<div class=ad>{long}</div>", f"<section class=comments>{long}</section>", f"<form>{long}</form>",
                  f"<section class=comments><article class=comment>{long}</article></section>"):
        for page in (f"<body>{noise}<article><p>Short.</article>{noise}", f"<main>{noise}<article><p>Short.</article></main>", f"{noise}<main><p>Short.</main>"):
            assert main_text(page) == "Short."
    assert main_text(f"<article>{part('a', 10)}<div class=related><article>{long}</article></div></article>") == "\n\n".join(lines("a", 10))


def test_odd_pages():
    assert main_text("") == "" and main_text("plain &lt;b") == "plain <b" and main_text("<p>only") == "only"
    assert main_text("<div>" * 20000 + "deep") == "deep" and main_text("<script>never ends") == ""
    assert main_text("<p>a<!-- open comment") == "a" and main_text('<p title="x>y">t</p>') == "t"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert main_text("<p>&nbsp; a &#233; &unknown; </p>") == "a é &unknown;"


def test_extract_edges(spark):
    rows = page_rows() + [(20, "u", ARTICLE, *["clash"] * 6), (21, "long", "<p>" + "word " * 200_000, *["clash"] * 6)]
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[20].text == TEXT and by[4].text == "" and by[21].n_chars == 5 * 200_000 - 1 and by[4].url == "http://b.example/"
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
