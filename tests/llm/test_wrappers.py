"""Wrapper inference and main text against the blocks that pages were made of."""

from __future__ import annotations

import html
import json
import random

from shopweave.llm import wrappers as W

SCHEMA = "page_id long, url string, html string, text string, n_chars string, _host string, shape string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta & co", "<gamma>", "délta", '"eps"']) for _ in range(n))


def page(rng, site, k):
    """A page of one of four layouts, and its blocks."""
    blocks = [words(rng, rng.randint(2, 9)) for _ in range(rng.randint(1, 7))]
    p = [f"<p>{html.escape(b)}" + rng.choice(["</p>", "\n"]) for b in blocks]
    p[0] = f"<p class=lead><b>{html.escape(blocks[0])}<br></b></p>"
    menu = "<nav><ul>" + "".join(f"<li><a href='/{x}'>Menu {x}</a>" for x in range(rng.randint(2, 6))) + "</ul></nav>"
    noise = ["<!-- <p>no</p> --><div class='ad box'>Buy <b>now</b></div>", "<form><input name=q><button>Go</button></form>", "<aside><p>Side</p></aside>", "<div id=cookie-notice>We use cookies</div>",
             "<script>var t = '<p>x</p>';</script>", "<section class='comments'><article class=comment><p>First!</p></article></section>", "<noscript>no</noscript>"]
    rng.shuffle(noise)
    head = f"<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style></head><body><header>Site name</header>{menu}{''.join(noise[:3])}"
    tail = f"{''.join(noise[3:])}<footer>&copy; me</footer>" + rng.choice(["</body></html>", ""])
    inner = "".join(p)
    if site == 0:
        inner = f"<article><h1>Head {k}</h1>{inner}<div class=ads><p>Advert</p></div></article>"
        blocks = [f"Head {k}", *blocks]
    elif site == 1:
        inner = f"<main><div>{inner}</div></main>"
    elif site == 2:
        inner = f"<div class='left'>Links</div><div class='post-content p{k}'>{inner}</div>"
    else:
        inner = f"<div><table><tr><td>{inner}</td></tr></table></div>"
    return head + inner + tail, "\n\n".join(" ".join(b.split()) for b in blocks)


def test_extract(spark):
    rng, rows, want = random.Random(8), [], {}
    for k in range(160):
        site = k % 4
        text, main = page(rng, site, k)
        rows.append((k, f"https://www.S{site}.example.com:80/{k}?q#x", text))
        want[k] = main
    odd = [(1000, None, None, ""), (1001, "no address", "", ""), (1002, "http://o.example/", "plain &amp; text\n here", "plain & text here"), (1003, "http://o.example/", "<p>a<p>b</div><b>c <", "a\n\nb\n\nc <"),
           (1004, "http://n.example/", "<div>" * 3000 + "deep", "deep"), (1005, "http://n.example/", "<article></article><p>x</p>", ""), (1006, "http://u.example/", "<article><p title='a>b'>x &lt;b&gt; &am &copy y</p>" + "<p>z</p>" * 20000, "x <b> &am © y" + "\n\nz" * 20000)]
    for i, url, text, main in odd:
        rows.append((i, url, text))
        want[i] = main
    rows += [rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "old", "old", "h", "s") for r in rows], SCHEMA).repartition(5)
    for how in ({}, {"broadcast_bytes": 0}):
        out = W.extract(frame, **how)
        assert set(out.columns) == set(frame.columns)
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["text"], r["n_chars"], r["_host"]) == (want[r["page_id"]], len(want[r["page_id"]]), "h"), r["page_id"]
    assert W.extract(frame.limit(0)).count() == 0


def pattern(entries):
    """The expression as text, for reading."""
    mark = lambda e: ("+" if e[2] else "") + ("?" if e[3] else "")
    return " ".join((e[0] if e[0] == "#" else f"({pattern(e[1])})" if e[0] == "(" else f"{e[0]}[{pattern(e[1])}]") + mark(e) for e in entries)


def shape(text):
    return W.Page(text).shape


def test_alignment_resolves_mismatches():
    a, b = shape("<h1>t</h1><p>x</p><div><i>d</i></div>"), shape("<h1>t</h1><p>x</p><p>y</p><hr><ul><li>1<li>2</ul><div>d</div>")
    assert pattern(W.align(a, b)) == "h1[#] p[#]+ ul[li[#]+]? div[#]"
    assert pattern(shape("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")) == "dl[(dt[#] dd[#])+]"
    assert pattern(W.align(shape("<dl>" + "<dt>a<dd>b" * 3 + "</dl>"), shape("<dl><dt>a<dd>b</dl>"))) == "dl[(dt[#] dd[#])+]"
    assert pattern(W.align(shape("<h2>a</h2><p>b</p><h2>a</h2><p>b</p>"), shape("<h2>c</h2><p>d</p><p>e</p><ul></ul>"))) == "(h2[#] p[#]+)+ ul[]?"


def covered(entries, wrapper):
    """Whether a wrapper's expression has every entry, in some order of its own."""
    names = lambda found: {(path, e[0]) for e, path in found}

    def walk(entries, path=""):
        for e in entries:
            yield e, path
            if e[0] != "#":
                yield from walk(e[1], path if e[0] == "(" else f"{path}/{e[0]}")

    flat = lambda x: {n for n in names(walk(x)) if not n[1].startswith("(")}
    return flat(entries) <= flat(wrapper)


def test_wrappers_cover_their_pages(spark):
    rng = random.Random(9)
    pages = [(f"h{k % 3}", page(rng, rng.randint(0, 3), k)[0]) for k in range(200)] + [("many", "".join(f"<{t}>x</{t}>" for t in rng.sample("abcdefghijk", 6)).replace("<", "<x-").replace("<x-/", "</x-")) for _ in range(150)]
    got = {r["_host"]: json.loads(r["wrapper"]) for r in W.infer(spark.createDataFrame(pages, "_host string, _html string")).collect()}
    assert set(got) == {h for h, _ in pages}
    assert all(covered(shape(text), got[h]) for h, text in pages)
    assert sum(W._amounts(got["many"])) == sum(len(t) for h, x in pages if h == "many" for _, t, _ in W.Page(x).slots)
