"""Operator 11 on templates whose main text is known, and on broken markup."""

import html
import random
import time

import pytest

from riskflow.llm import consensus_paths as C

SCHEMA = "page_id long, url string, html string, host string, path string, text string, votes int, _id int"

#: templates: {title}, paragraphs {body}, a page number {n}; every second one has a container without a telling name
TEMPLATES = {
    "plain.example": "<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/a>Home page</a></li></ul></nav>"
                     "<!-- <p>hidden</p> --><div class=ad>Buy this now, it is a good offer.</div><article><h1>{title}</h1>{body}</article><footer>&copy; someone, all rights reserved.</footer></body></html>",
    "div.example": "<html><body class='has-sidebar'><div id=top class='site-header'><h1>The site's name</h1><p>A claim of the site.</p></div><div class='row-{n}'><div class='post-{n} c'><h2>{title}</h2>{body}</div>"
                   "<div class=sidebar><p>About the author of this page, a long text that says a lot of things, with commas.</p></div></div><div id=comments><p>{comment}</p><p>{comment}</p></div></body></html>",
    "table.example": "<table><tr><td><a href=1>one</a><a href=2>two</a></td><td class=main>{body}<form><p>Write to us if you like, we answer soon.</p><input name=q></form></td></tr></table>",
    "main.example": "<html><body><header><p>Header of the site, with some words.</p></header><main><article><header><h1>{title}</h1><time>Monday</time></header><section>{body}</section><section>{body2}</section>"
                    "<section class='comments'><p>{comment}</p></section></article><aside><p>Other things to read.</p></aside></main><div class='cookie-notice'>We use cookies, as all do.</div></body></html>",
}


def page(host, n, rng, words):
    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(4, 30))).capitalize() + rng.choice([".", "!", ", & < > \"quoted\"."])

    paragraphs = [sentence() for _ in range(rng.randint(2, 6))]
    more = [sentence() for _ in range(2)]
    title = " ".join(rng.choice(words) for _ in range(4))
    comment = " ".join(rng.choice(words) for _ in range(60)) + "."

    def marked(parts):
        return "".join(f"<p>{html.escape(p)}</p>\n" if rng.random() < 0.7 else f"<p class='x{rng.randint(1, 9)}'>\n <b>{html.escape(p)}</b>&nbsp;<br>" for p in parts)

    source = TEMPLATES[host].format(title=html.escape(title), body=marked(paragraphs), body2=marked(more), comment=comment, n=n)
    text = ([] if host == "table.example" else [title]) + paragraphs + (more if host == "main.example" else [])
    return source, "\n".join(text)


@pytest.fixture(scope="module")
def pages(vocabulary):
    rng = random.Random(6)
    out = []
    for n in range(120):
        host = rng.choice(list(TEMPLATES))
        source, text = page(host, n, rng, vocabulary)
        out.append((n, f"https://{host}/p/{n}?x=1", source, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "h", "p", "t", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("most", [0, C.BROADCAST_BYTES])
def test_templates(spark, pages, most):
    got = {r["page_id"]: (r["url"], r["text"]) for r in C.extract(frame(spark, pages), broadcast_bytes=most).collect()}
    assert got == {n: (url, text) for n, url, _, text in pages}


def test_votes_and_winners(spark, pages):
    df = frame(spark, [*pages, *pages[:7]])
    want = {}
    for n, url, source, _ in [*pages, *pages[:7]]:
        for path, votes in C.Page(source).votes():
            key = (url.split("/")[2], path)
            want[key] = want.get(key, 0) + votes
    got = {(r["host"], r["path"]): r["votes"] for r in C.path_votes(df).collect()}
    assert got == want
    assert "html>body>div.row-#>div.c.post-#" in {p for _, p in got}
    best = {r["host"]: r["paths"] for r in C.winning_paths(C.path_votes(df), 3).collect()}
    for host, paths in best.items():
        assert paths == [p for _, p in sorted((-v, p) for (h, p), v in want.items() if h == host)[:3]]


def test_consensus_beats_the_own_best_container(spark, vocabulary):
    rng = random.Random(1)
    rows = []
    for n in range(20):                                        # one page's longest text is beside its article
        short = n == 0
        body = "<p>Short, but it is the article.</p>" if short else "".join(f"<p>{' '.join(rng.choice(vocabulary) for _ in range(40))}.</p>" for _ in range(5))
        note = "<div class=box><p>" + " ".join(rng.choice(vocabulary) for _ in range(60 if short else 3)) + ".</p></div>"
        rows.append((n, "http://h/", f"<body><div class=content>{body}</div>{note}</body>"))
    got = {r["page_id"]: r["text"] for r in C.extract(frame(spark, rows)).collect()}
    assert got[0] == "Short, but it is the article."
    assert C.Page(rows[0][2]).text([]) != got[0]


def test_odd_pages(spark, odd_texts):
    odd = [t for t in odd_texts] + ["<", "<p", "<p class='", "</", "<!--", "<!-- x", "<script>x", "<article>", "a < b & c &amp d &am; &#65; &#x110000;", "<p>" * 2000 + "deep", "<div>" * 3000 + "deep" + "</div>" * 3000,
                                    "<p>one<p>two<br>three", "<ul><li>a, long enough to be read as text.<li>b</ul>", "<b>x<p>y</b>z</p>", "\x00<p>z.</p>"]
    rows = [(i, None if i % 3 == 0 else "no host" if i % 3 == 1 else "http://x.y/", t) for i, t in enumerate(odd)] + [(None, None, None), (1, "http://x.y/", "<article>twice</article>"), (1, "http://x.y/", "<article>twice</article>")]
    got = C.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert sum(r["text"] == "twice" for r in got) == 2
    assert C.extract(frame(spark, [])).count() == 0
    assert C.Page("<p>one<p>two<br>three &amp; &lt;b&gt;  x</p>").text([]) == "one\ntwo three & <b> x"
    assert C.Page("<article>a &am</article>").text([]) == "a &am"


@pytest.mark.parametrize("part", ["<a", "<a b=\"", "<!-", "<div>", "<p><b>x<br>", "</p>", "&amp", "<script>", "<a href=x>y", "a='>"])
def test_time_is_linear(part):
    began = time.time()
    C.Page(part * 40_000).votes()
    assert time.time() - began < 20
