import random

import numpy as np
import pytest
from corpusflow.llm import maintext as M
from pyspark.sql import functions as F

LONG = "This is a paragraph of the article with quite some text in it, so that its ratio is high. "
CASES = {
    "article": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div><div class=ad>Buy</div>"
        f"<article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>{LONG * 3}</p><form>Name <input></form><aside>More</aside></article><section id=comments><p>Nice post!</p></section><footer>&copy; x</footer></body></html>",
        f"Head & line {LONG}{LONG * 3}".strip(),
    ),
    "no article": (f"<body><div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG * 2}</p><p>{LONG}</p></div><div><a href=3>three</a></div></body>", (LONG * 3).strip()),
    "cut off": (f"<body><nav><a>m</a></nav><article><p>{LONG}</p><p>and more</p><foot", f"{LONG}and more"),
    "cut in a comment": (f"<body><article><p>{LONG}</p><!-- x <p>y", LONG.strip()),
    "references": ("<article><p>a&nbsp;&lt;b&gt;\n  &#233;&hellip;</p></article>", "a <b> é…"),
    "nothing": ("<html><body><script>x</script></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "text alone": ("just text", "just text"),
    "deep": ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    "deep navigation": (f"<article><p>{LONG}</p>" + "<div>" * 900 + "<nav>menu of the site</nav><p>still here</p>" + "</div>" * 900 + f"<p>{LONG}</p></article>", f"{LONG}still here {LONG.strip()}"),
    "wrapper named after a sidebar": (f"<body><div class='layout has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>Latest posts of this site</div></div></body>", LONG.strip()),
    "wrapper named after contents": (f"<div id=page-with-toc><article><h1>H</h1><p>{LONG}</p></article></div>", f"H {LONG.strip()}"),
    "wrapper named sidebar": (f"<div class=sidebar><article><h1>H</h1><p>{LONG}</p></article></div>", f"H {LONG.strip()}"),
    "form around all": (f"<body><form id=aspnetForm><input><nav>menu</nav><main><article><p>{LONG}</p><p>end</p></article></main></form></body>", f"{LONG}end"),
    "form around all, no article": (f"<body><form id=aspnetForm><input><div><p>{LONG * 3}</p><p>end</p></div></form></body>", f"{LONG * 3}end"),
    "form alone": ("<body><form><label>Name</label><input><button>Go</button></form></body>", ""),
    "advert left open": (f"<body><div class=ad>Buy<article><p>{LONG}</p></article></body>", LONG.strip()),
    "marked phrases": (f"<p><a class=skip href=#x>Skip</a></p><article><p>{LONG}foo<span class=ad>x</span>bar <b hidden>y</b>z</p><span class=ad></article><article>w</article>", f"{LONG}foobar z w"),
    "several articles": (f"<main><article><p>{LONG * 6}</p></article><article><p>{LONG}</p></article><article><p>short one</p></article><section class=comments><article><p>{LONG}</p></article></section></main>", f"{LONG * 7}short one"),
    "article of little": (f"<body><article><a href=/>Featured</a></article><div><h1>Head</h1><p>{LONG * 2}</p><p>end</p></div></body>", f"Head {LONG * 2}end"),
    "surplus end tags": (f"<article><p>{LONG}</p></div></div><p>more</p></article>", f"{LONG}more"),
    "comments in an article": (f"<article><p>{LONG}</p><div id=comments><p>{LONG}</p><p>{LONG}</p></div></article>", LONG.strip()),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert M.main_text(html) == want


def test_over_a_table(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(CASES.values())] + [(None, None, None), (0, "u0", CASES["article"][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = M.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = list(CASES.values())[r["page_id"]][1] if r["page_id"] is not None else ""
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert M.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page():
    assert len(M.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) == 20_000 * len(LONG) - 1


def page(rng):
    """A random page and its main text: an article among parts that aren't, with or without the tags that say so."""
    said = lambda n: " ".join(rng.choice(["stone", "river", "cloud", "letter", "morning", "on", "the", "a"]) for _ in range(n))
    paragraphs = [said(rng.randint(30, 90)) + "." for _ in range(rng.randint(4, 9))]
    body = [("h1", said(4)), *[("p", p) for p in paragraphs]]
    if rng.random() < 0.5:
        body.insert(rng.randint(3, len(body) - 1), ("p", said(2)))  # a short one amid long ones
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in body)
    at = inner.index("</p>") + 4
    inner = inner[:at] + rng.choice(["", f"<aside>{said(9)}</aside>", f"<div class=promo>{said(9)}</div>", f"<form>{said(3)}<input></form>"]) + inner[at:]
    tag = rng.choice(["article", "main", "div", "section"])
    links = lambda: "<ul>" + "".join(f"<li><a href=/x>{said(2)}</a></li>" for _ in range(rng.randint(3, 8))) + "</ul>"
    small = lambda: "<div>" + "".join(f"<div><span>{said(1)}</span><span><i>{said(1)}</i></span></div>" for _ in range(60)) + links() + "</div>"
    wrap = rng.choice(["<div class='page has-sidebar'>", "<div>", "<div id=with-toc>"])
    html = f"<body><header>{said(3)}</header><nav>{links()}</nav>{small()}{wrap}<{tag}>{inner}</{tag}></div>{small()}<section class=comments><p>{said(40)}</p></section><footer>{said(8)}</footer></body>"
    return html, " ".join(x for _, x in body), tag


def test_random_pages_and_what_the_clusters_decide(monkeypatch):
    rng = random.Random(7)
    made = [page(rng) for _ in range(300)]
    for html, want, _ in made:
        assert M.main_text(html) == want
    plain = [(h, w) for h, w, tag in made if tag in ("div", "section")]
    monkeypatch.setattr(M, "threshold", lambda values: min(values))
    assert sum(M.main_text(h) != w for h, w in plain) > 0.9 * len(plain) > 50
    monkeypatch.undo()
    monkeypatch.setattr(M, "smoothed", lambda values: [-v for v in values])
    assert sum(M.main_text(h) != w for h, w in plain) > 0.9 * len(plain)


def test_brute_force_of_ratio_smoothing_and_clusters():
    html = "<body><p>one two <b>three</b></p><div><a href=x>l</a><a href=y>m</a></div>four<p>five</p></body>"
    assert [(x.text, x.tags, x.links) for x in M.parse_lines(html).lines] == [("one two three", 3, 0), ("lm", 5, 2), ("four", 1, 0), ("five", 1, 0)]
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 60):
        values = rng.lognormal(2, 1, n)
        d = np.arange(n)[:, None] - np.arange(n)[None, :]
        w = np.where(abs(d) <= 2, np.exp(-(d**2) / 2.0), 0)
        smooth = M.smoothed(values.tolist())
        assert np.allclose(smooth, w @ values / w.sum(1))
        edge = M.threshold(smooth)
        low, high = [v for v in smooth if v <= edge], [v for v in smooth if v > edge]
        # Each value is nearest to the mean of its own cluster.
        if high:
            a, b = np.mean(low), np.mean(high)
            assert abs((a + b) / 2 - edge) < 1e-9 and all((abs(v - a) <= abs(v - b)) == (v <= edge) for v in smooth)
        else:
            assert n == 1 or max(smooth) == min(smooth)


def test_smoothing_and_threshold():
    assert M.smoothed([3.0]) == [3.0] and abs(sum(M.smoothed([0, 0, 0, 0, 9, 0, 0, 0, 0])) - 9) < 0.2
    assert 2 < M.threshold([1, 1, 2, 30, 31]) < 30 and M.threshold([5, 5]) == 5
