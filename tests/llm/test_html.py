import html as entities
import random
import re

import pytest

from larkspur.llm import html


def text_of(page):
    return html.kept(page)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a <b>b</b>\n c</p><p>d</p>", "a b c\nd"),
        ("<nav>menu</nav><main><p>x</p></main><footer>f</footer>", "x"),
        ("<article><h1>T</h1><p>one<p>two</article><p>outside</p>", "T\none\ntwo"),
        ("<script>if (a < b) '</p>'</script><p>kept</p><style>p{}</style>", "kept"),
        ("<p>1 &lt; 2 &amp;amp; &eacute;&nbsp;x</p>", "1 < 2 &amp; é x"),
        ("<div class='ad big'>buy</div><div class=text>body</div>", "body"),
        ("<div id=\"cookie-notice\">ok?</div><p>a</p><div class=comments><p>reader</p></div>", "a"),
        ("<!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<nav>open menu<article><p>still read</p></article>", "still read"),
        ("<p>a<br>b</p>", "a b"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("<p title='a > b'>q</p>", "q"),
        ("<form><p>name</p></form><aside>s</aside><header>h</header>", ""),
        ("<p>a < b and c</p>", "a < b and c"),
        ("", ""),
        ("plain", "plain"),
        ("<article class=comment><p>c</p></article><article><p>main</p></article>", "main"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>open <span class='ad'>advert</span> close</p>", "open\nclose"),
        ("<main><div class='widget text'><p>body</p></div></main>", "body"),
        ("<article class='story related-story'><p>told</p></article>", "told"),
        ("<article><section id='notice-of-appeal'><p>filed</p></section></article>", "filed"),
        ("<article><h1 class='article-header'>Head</h1><p>a</p></article>", "Head\na"),
        ("<article><div class='ad-slot'>buy</div><p>a</p><div class='share-buttons'>share</div><ul class=related-posts><li>x</ul></article>", "a"),
        ("<div class='comment'><p>all there is</p></div>", "all there is"),
        ("<div>story</div><article class='comment'><p>reader</p></article>", "story"),
        ("<div class='post-content header-ad'>x</div><div>y</div>", "y"),
        ("<div class='menu-of-the-day'><p>soup</p></div><div>more</div>", "soup\nmore"),
        ('<article><p title="the hidden layer">Main body</p><p>b</p></article>', "Main body\nb"),
        ('<article><p data-css="display: none">Main body</p><p style="color:red; DISPLAY : none">x</p><p hidden>y</p><p aria-hidden="true">z</p></article>', "Main body"),
        ('<p data-role="navigation" xclass="ad">a</p>', "a"),
        ("<p>a <button>Share</button> b</p>", "a b"),
        ("<p>a <script>x()</script>b<noscript>c</noscript></p>", "a b"),
        ("<p>x <![CDATA[ a > y ]]>z</p>", "x z"),
        ("<p>open <span class='ad'>an <span>advert</span> more</span> <span>close</span></p>", "open\nclose"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def test_unclosed_quotes_do_not_take_long():
    assert "x" in text_of("<p>x</p>" + "<a href=\"" * 2000)


def test_pages_against_a_plain_reading(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for p in pages.collect():
        body = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</h1>|</?p>|<br>", body)]
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def tale(i, n=5):
    """A text of words that no other page has, but for one."""
    return " ".join(f"w{i}x{k}" for k in range(n)) + " the"


def test_template_text_of_a_host_goes_and_slots_stay(spark):
    """No article element: what all pages of a host share is template, what differs is text."""
    page = "<div><div>Shop name</div><section><p>{i}</p></section><div>All rights kept</div></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i=tale(i)), "x") for i in range(6)]
    rows += [(10, "http://b.example/1", "<div>Shop name</div><p>kept here</p>", "x")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")).collect()}
    assert [got[i] for i in range(6)] == [tale(i) for i in range(6)]
    assert got[10] == "Shop name\nkept here"  # a host of one page has no template


def test_copies_do_not_make_a_template(spark):
    rows = [(i, "http://a.example/x", "<body><p>the same page</p></body>") for i in range(9)] + [(20, "http://a.example/y", "<body><p>another</p></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert got[0] == "the same page" and got[20] == "another"


def test_odd_pages(spark):
    schema = "page_id BIGINT, url STRING, html STRING, text STRING, host STRING, slots INT"
    rows = [(1, None, None, None, "h", 1), (1, None, None, None, "h", 1), (None, "http://a/", "<p>x</p>", "", None, None), (2, "not an url", "<p>" + "word " * 50_000 + "</p>", None, None, None), (3, "http://a/", "", None, None, None)]
    got = [(r.page_id, r.text[:4], r.n_chars) for r in html.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (1, "", 0), (None, "x", 1), (2, "word", 249_999), (3, "", 0)], key=str)
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


def extracted(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).orderBy("page_id").collect()]


@pytest.mark.parametrize("depth", [20, 22, 23, 24, 25, 60])
def test_depth_changes_no_decision(depth):
    deep = "<div>" * depth
    assert text_of(deep + "<p>a</p><nav><p>menu</p></nav><p>b <span class=ad>buy</span></p>") == "a\nb"
    assert text_of("<p>outside</p>" + deep + "<article><p>a</p><aside>x</aside></article>") == "a"
    assert text_of(deep + "<nav>open menu<article><p>still read</p></article>") == "still read"
    path = html.blocks(deep * 40 + "<p>a</p>")[0][0][0]
    assert len(path) < 24 * 4 + 40


def test_a_page_with_an_article_leaves_the_template_of_the_others(spark):
    page = "<div><b>Shop name</b></div><section><p>{i}</p></section><ul><li>Home<li>About</ul>"
    pages = [(f"http://a.example/{i}", page.format(i=tale(i))) for i in range(6)] + [("http://a.example/x", "<article><p>read me</p></article><p>out</p>")]
    assert extracted(spark, pages) == [tale(i) for i in range(6)] + ["read me"]


def test_classes_decide_by_block(spark):
    """A path that holds fixed and varied blocks; the fixed ones share the vector of the page's
    root. A line on every article page is template, one of a class on its own is not."""
    pages = [(f"http://a.example/{i}", f"<div>Shop name</div><div>{tale(i)}</div><div>All rights kept</div>") for i in range(6)]
    pages += [(f"http://b.example/{i}", f"<article><p>Share this</p><p>story {i}</p></article>") for i in range(6)]
    pages += [(f"http://c.example/{i}", f"<article><p>the same article</p></article><p>{i}</p>") for i in range(4)]
    got = extracted(spark, pages)
    assert got[:12] == [tale(i) for i in range(6)] + [f"story {i}" for i in range(6)]
    assert got[12:] == ["the same article"] * 4


def test_words_around_a_slot_are_template(spark):
    """Also those that the page's own text holds too: between two words of a class they are told
    apart. A class on half of the pages is template as well."""
    line = "<p>Posted on {i} May by the staff of our house</p>"
    pages = [(f"http://a.example/{i}", f"<div>{line.format(i=i + 10)}<p>{tale(i)} on {'of ' * (i % 3)}our</p><p>{'Log in to comment' if i < 4 else 'Subscribe now to read'}</p></div>") for i in range(8)]
    assert extracted(spark, pages) == [f"{i + 10}\n{tale(i)} on {'of ' * (i % 3)}our" for i in range(8)]


def test_words_in_changing_order_are_no_template(spark):
    pages = [(f"http://a.example/{i}", f"<div>{' '.join(['red', 'green', 'blue'][i % 3:] + ['red', 'green', 'blue'][:i % 3])}</div><p>{tale(i)}</p>") for i in range(6)]
    assert extracted(spark, pages)[1] == f"green blue red\n{tale(1)}"


def test_a_line_in_different_gaps_is_no_template(spark):
    """It is now above, now below the lines of another class, so it does not nest."""
    lines = ["<h2>Top of all</h2>", "<h3>Foot of all</h3>"]
    pages = []
    for i in range(8):
        moved = f"<b>Moved about line</b>" if i < 6 else ""
        parts = [lines[0], f"<p>{tale(i)}</p>", lines[1]]
        parts.insert(1 if i % 2 else 3, f"<div>{moved}</div>")
        pages.append((f"http://a.example/{i}", "".join(parts)))
    got = extracted(spark, pages)
    assert got[1] == f"Moved about line\n{tale(1)}" and got[7] == tale(7)


def brute(pages):
    """The deduction for one host without articles, with whole vectors and every pair compared."""
    own = list(dict.fromkeys(pages))
    split = {p: [((path, text), [(path, w) for w in text.split()]) for path, text in html.blocks(p)[0] if "!" not in path] for p in own}
    vector = {}
    for k, p in enumerate(own):
        for _, words in split[p]:
            for t in words:
                vector.setdefault(t, [0] * len(own))[k] += 1
    support = {t: sum(x > 0 for x in v) for t, v in vector.items()}
    frequent = {t for t in vector if support[t] >= max(3, 0.25 * len(own))} if len(own) >= 3 else set()
    members = {}
    for t in frequent:
        members.setdefault(tuple(vector[t]), set()).add(t)
    classes = {v: m for v, m in members.items() if len(m) >= 2}
    of = {t: v for v, m in classes.items() for t in m}

    def page_of(p, allowed):
        flat, open_ = [], []
        for _, words in split[p]:
            can = sum(t in frequent for t in words) >= 0.7 * len(words) and any(t in allowed for t in words)
            flat += words
            open_ += [can] * len(words)
        return flat, open_

    def found(p, allowed):
        flat, open_ = page_of(p, allowed)
        gone = set()
        while True:
            out, crossed = {}, set()
            for v in set(allowed.values()):
                at = [i for i, t in enumerate(flat) if open_[i] and allowed.get(t) == v and t not in gone]
                seen = list(dict.fromkeys(flat[i] for i in at))
                if len(seen) >= 2 and [flat[i] for i in at] == seen * (len(at) // len(seen)):
                    out[v] = (tuple(seen), [at[k : k + len(seen)] for k in range(0, len(at), len(seen))])
            all_ = [x for _, many in out.values() for x in many]
            for x in all_:
                for y in all_:
                    if x[0] < y[0] < x[-1] < y[-1]:
                        mine, other = [i for i in x if i > y[0]], [i for i in y if i < x[-1]]
                        crossed |= {flat[i] for i in (mine if len(mine) <= len(other) else other)}
            if not crossed:
                return flat, open_, out
            gone |= crossed

    told, context = {}, {}
    for k, p in enumerate(own):
        flat, open_, out = found(p, of)
        spans = [(x, v) for v, (_, all_) in out.items() for x in all_]
        for v in {of[t] for t, o in zip(flat, open_) if o and t in of}:
            if v not in out:
                told.setdefault(v, set()).add(None)
                continue
            where = set()
            for x in out[v][1]:
                around = [(y[-1] - y[0], y, w) for y, w in spans if y[0] < x[0] and y[-1] > x[0]]
                if not around:
                    where.add("out")
                else:
                    _, y, w = min(around, key=lambda a: a[0])
                    gap, end = sum(i < x[0] for i in y), sum(i < x[-1] for i in y)
                    where.add((w, gap) if gap == end else None)
            told.setdefault(v, set()).add((out[v][0], where.pop()) if len(where) == 1 and None not in where else None)
            for x in out[v][1]:
                for g, (a, b) in enumerate(zip(x, x[1:])):
                    for i in range(a + 1, b):
                        context.setdefault((v, g, flat[i]), [0] * len(own))[k] += 1
    valid = {v for v, x in told.items() if len(x) == 1 and None not in x}
    inner = {c for c, x in context.items() if c[0] in valid and tuple(x) == c[0]}
    result = []
    for p in pages:
        allowed = {t: v for t, v in of.items() if v in valid}
        flat, _, out = found(p, allowed)
        gone = {i for _, all_ in out.values() for x in all_ for i in x}
        gone |= {i for v, (_, all_) in out.items() for x in all_ for g, (a, b) in enumerate(zip(x, x[1:])) for i in range(a + 1, b) if (v, g, flat[i]) in inner}
        texts, at = [], 0
        for (path, text), words in split[p]:
            here = [at + k in gone for k in range(len(words))]
            at += len(words)
            texts.append(" ".join(t[1] for t, g in zip(words, here) if not g) if 2 * sum(here) >= len(here) else text)
        result.append("\n".join(t for t in texts if t) or "\n".join(text for (_, text), _ in split[p]))
    return result


def test_hosts_against_a_brute_force_deduction(spark):
    rng = random.Random(6)
    pages, hosts = [], []
    for h in range(30):
        vocabulary = [f"v{k}" for k in range(rng.choice([6, 30]))]
        lines = [(rng.choice(["p", "div", "h2"]), rng.sample(vocabulary, rng.randrange(1, 5)) if rng.random() < 0.5 else [f"l{h}a{k}" for k in range(rng.randrange(1, 5))], rng.random()) for _ in range(rng.randrange(1, 5))]
        own = []
        for i in range(rng.randrange(1, 9)):
            parts = []
            for tag, words, share in lines:
                if rng.random() < max(share, 0.5):
                    words = list(words)
                    if rng.random() < 0.4:
                        words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
                    parts.append(f"<{tag}>{' '.join(words)}</{tag}>")
                if rng.random() < 0.6:
                    parts.append(f"<p>{' '.join(rng.choice([rng.choice(vocabulary), f'u{h}i{i}k{k}']) for k in range(rng.randrange(1, 8)))}</p>")
            own.append("".join(parts))
        own += own[:1]  # a copy
        hosts.append(own)
        pages += [(f"http://h{h}.example/{i}", p) for i, p in enumerate(own)]
    got, want = extracted(spark, pages), [t for own in hosts for t in brute(own)]
    assert got == want
    plain = [text_of(p) for own in hosts for p in own]
    assert sum(a != b for a, b in zip(got, plain)) > 40  # the templates do something
