import random

from kelpline.llm import extraction


def test_blocks_of_marked_page():
    page = (
        '<body class="x sidebar"><header><h1>Site</h1></header><div class="sidebar"><div>x</div>y</div><main><header><h1>T</h1><p>by me</p></header>'
        "<p>A&nbsp;b<br>c &amp;amp; d</p><table><tr><td>1<td>2</tr></table><form><input><p>q</form><section id='comments'><p>hi</p></section></main><footer>f"
    )
    assert extraction.page_blocks(page) == (["T", "A b c &amp; d", "1 2"], True)
    assert extraction.page_blocks(None) == ([], False)
    assert extraction.page_blocks('<script>var t="</p>";</script><p>a<p>b') == (["a", "b"], False)


def test_words_of_a_line_and_titles_stay():
    def text(page):
        return extraction.page_blocks(page)[0]

    assert text('<article><p>Order the <em class="menu">menu</em> today</p></article>') == ["Order the menu today"]
    assert text('<p>A <span class="form">form</span> and <code class="login">login()</code></p>') == ["A form and login()"]
    assert text('<main><h2 class="search">Search</h2><p>Text.</p><table><caption class="social">Social spending</caption><tr><td>1</table></main>') == ["Search", "Text.", "Social spending", "1"]
    # Hidden ones go, and so do blocks of these names.
    assert text('<article><p>One<span hidden>x</span></p><div class="menu">m</div></article>') == ["One"]


def test_articles_do_not_vanish():
    def text(page):
        return extraction.page_blocks(page)[0]

    for frame in ("site has-sidebar", "no-comments", "page-with-nav", "sidebar", "widget"):
        assert text(f"<body><div class='{frame}'><nav>m</nav><article><h1>T</h1><p>All of it.</p></article></div><footer>f</footer>") == ["T", "All of it."]
    assert text("<form id='f'><nav>m</nav><main>A</main></form><article>B</article>") == ["A", "B"]
    assert text("<article><p class='notice'>ad<p>One.</p><p>Two.</p></article>") == ["One.", "Two."]
    assert text("<article><ul><li class='share'>s<li>One</ul><p>Two.</p></article>") == ["One", "Two."]
    assert text("<article><section><div class='share'>s<p>t</section><p>Two.</p></article>") == ["Two."]
    assert text("<article><table><tr><td class='ad'>s<td>One<tr><td>2</table><p>Two.</p></article>") == ["One", "2", "Two."]
    assert text("<main><div class='ad'>x<article>A</article></main>") == ["A"]
    # What holds no page's article still goes.
    assert text("<main><p>A</p></main><div class='related'><article>teaser</article></div>") == ["A"]
    assert text("<div>The whole post</div><section class='comments'><article>hi</article></section>") == ["The whole post"]
    assert text("<main><ul><li class='related'><article>teaser</article></li><li>B</li></ul></main>") == ["B"]


def test_lcs_mask_is_longest(monkeypatch):
    def longest(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            best = _row(best, x, b)
        return best[-1]

    def _row(prev, x, b):
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        return row

    rng = random.Random(3)
    for _ in range(600):
        monkeypatch.setattr(extraction, "MAX_BITS", rng.choice([8, 1 << 31]))
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        mask = extraction.lcs_mask(a, b)
        assert sum(mask) == longest(a, b)


def test_differencing_over_partitions(spark):
    def page(k, body, host="h.example"):
        return (k, f"http://{host}/a/{k:03d}", f"<div>Top of site</div><div>{body}</div><div>End {host}</div>")

    rows = [page(k, f"unique text of page number {k} which is long enough to be more than half of all") for k in range(40)]
    rows += [page(100 + k, "the same article on two pages, a copy which must stay whole", "copies.example") for k in range(2)]
    rows += [(7000, None, "<p>alone</p>"), (7001, "http://x/", None), (7002, "http://x/", ""), (2**60 + 1, "u", "<p>big</p>"), (None, "u", "<p>none</p>"), (0, rows[0][1], rows[0][2])]
    got = {}
    for r in extraction.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[k] == [f"unique text of page number {k} which is long enough to be more than half of all"] for k in range(2, 40))
    assert "the same article on two pages" in got[100][0] and "Top of site" in got[100][0]
    assert got[2**60 + 1] == ["big"] and got[None] == ["none"] and got[7000] == ["alone"] and got[7001] == [""] and got[7002] == [""]


def test_empty(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_doubtful_names_are_left_to_differencing():
    page = '<main><h2 id="market-share">A</h2><p>kept</p><section id="related-work">B</section><p class="reply">C</p><h2 id="search">D</h2></main>'
    assert extraction.page_lines(page) == (["A", "kept", "B", "C", "D"], [False, False, True, False, False], True)
    inner = "<article><div class='share-count'><p>a</p><div>b</div></div><p>c</p><div class='share'>d</div></article>"
    assert extraction.page_lines(inner)[:2] == (["a", "b", "c"], [True, True, False])


def plain_lcs(a, b):
    """Entries of a in a longest common subsequence, by the plain table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    mask, i, j = [False] * len(a), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            mask[i - 1] = True
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return mask


def test_whole_extraction_against_plain_differencing(spark):
    """Hosts with menus and footers of their own, longer than the articles; articles with doubtful names; one very long and one broken page."""
    rng = random.Random(11)
    pages, parts, alone = [], [], 0
    for h in range(7):
        menu = [f"Menu {h} entry {k} of the site" for k in range(rng.randrange(3, 12))]
        foot = [f"Footer {h} line {k} with all its notes" for k in range(rng.randrange(2, 9))]
        for n in range(rng.randrange(6, 30) if h else 1):
            body = [f"Host {h} page {n} line {k}" for k in range(rng.randrange(1, 5))]
            marked = rng.random() < 0.4
            share = rng.random() < 0.5
            lines = [*((x, False) for x in body), *([("Share this with your friends", True)] if share else [])] if marked else [(x, True) for x in [*menu, *body, *foot]]
            inner = "".join(f"<p>{x}</p>" for x in body)
            tail = '<div class="share-row">Share this with your friends</div>' if share and marked else ""
            outer = [f"<div>{x}</div>" for x in menu], [f"<div>{x}</div>" for x in foot]
            page = f"<body>{''.join(outer[0])}{f'<article>{inner}{tail}</article>' if marked else inner}{''.join(outer[1])}"
            pages.append((len(pages), f"https://h{h}.example/{n:04d}", page))
            parts.append((f"h{h}.example", f"/{n:04d}", lines))
    long = [f"word {k} " * 30 for k in range(3000)]
    pages.append((len(pages), "https://h1.example/0000a", "<div>" + "<br><p>".join(long)))
    parts.append(("h1.example", "/0000a", [(" ".join(x.split()), True) for x in long]))
    pages.append((len(pages), "https://h1.example/0000b", "<div <p>>x</div></div></p><<p class='a>y <b><i></b>z"))
    parts.append(("h1.example", "/0000b", [(x, True) for x in extraction.page_blocks(pages[-1][2])[0]]))
    order = sorted(range(len(parts)), key=lambda i: parts[i][:2])
    want = {}
    for at, i in enumerate(order):
        own = [x for x, _ in parts[i][2]]
        near = [[x for x, _ in parts[j][2]] for j in order[max(0, at - extraction.NEAR) : at + extraction.NEAR + 1] if j != i and parts[j][0] == parts[i][0]]
        masks = [m for m in (plain_lcs(own, x) for x in near) if not all(m)]
        alone += not masks
        gone = [masks and 2 * sum(m[k] for m in masks) >= len(masks) and parts[i][2][k][1] for k in range(len(own))]
        want[i] = "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and alone <= 0.1 * len(pages)
    assert sum("Menu" in t or "Footer" in t for t in want.values()) <= 0.1 * len(pages)
