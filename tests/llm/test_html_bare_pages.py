"""Pages that do not mark their article."""

from tidemark.llm import html_extract


def test_one_very_long_block():
    texts = [f"{i} " + "plain words " * 8 for i in range(6)]
    texts = [t.strip() for t in texts]
    long = ("row of a listing " * 300).strip()
    for page in ([*texts, long], [long, *texts], [*texts[:3], long, *texts[3:]]):
        assert html_extract.main_blocks("".join(f"<p>{t}</p>" for t in page)) == page


def test_paragraphs_of_mostly_links():
    linked = "See <a href=1>the whole long title of a paper that is quoted here</a> by Ann."
    only = "<a href=2>A sentence that is a link as a whole.</a>"
    page = "".join(f"<li><a href={i}>Part {i}</a></li>" for i in range(5)) + f"<p>{linked}</p>" + f"<p>{'more plain words ' * 9}</p><p>{only}</p><p>{'and so on with words ' * 9}</p>" + "<div><a href=7>Home</a> | <a href=8>About</a></div>"
    found = html_extract.main_blocks(page)
    assert len(found) == 4 and found[0].startswith("See the whole") and found[2] == "A sentence that is a link as a whole."


def random_page(rng):
    """A page, and its lines as (text, marked, in an article, links only), an empty text where the window should see a gap."""

    def text(n):
        return " ".join(rng.choice(["word", "a", "longer", "sentence,"]) for _ in range(n))

    gap = ("", False, False, False)
    markup, rows = [], []
    articles = rng.randrange(3)
    for _ in range(rng.randrange(1, 12)):
        kind = rng.choice(["p", "p", "div", "nav", "ad", "links", *["article"] * articles])
        inner = [text(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in inner)
        if kind == "p":
            markup.append(f"<p>{inner[0]}</p>")
            rows.append((inner[0], False, False, False))
        elif kind == "div":
            markup.append(f"<div><div>{body}</div></div>")
            rows += [*((t, False, False, False) for t in inner), gap, gap]
        elif kind in ("nav", "ad"):
            long = text(900) if rng.random() < 0.1 else inner[0]
            markup.append(f"<nav>{long}</nav>" if kind == "nav" else f"<div class='ad-slot'>{long}</div>")
            rows += [(long, True, False, False), gap]
        elif kind == "links":
            markup.append(f"<p><a href=1>{inner[0]}</a></p>")
            rows.append((inner[0], False, False, True))
        else:
            advert = text(5)
            markup.append(f"<article><div><h1>{inner[0]}</h1></div>{body}<div class='ad'>{advert}</div><p><a href=2>{inner[-1]}</a></p></article>")
            rows += [gap, gap, gap, (inner[0], False, True, False), *((t, False, True, False) for t in inner), (advert, True, True, False), (inner[-1], False, True, True), gap, gap, gap]
    return "".join(markup), rows


def weighed(rows):
    """The weights that the contract gives, from the rows as they were made."""
    with_article = any(article and not marked for _, marked, article, _ in rows)
    out = []
    for t, marked, article, links in rows:
        w = len(t) / 10 if links else float(len(t))
        out.append(w / 50 if marked else w if article else 0.0 if links else w / 10 if with_article else w)
    return out


def brute_force(rows, window=3, share=0.2, most=80):
    """A line is kept if it has weight and a window with more than the threshold can be reached over windows with weight."""
    weight, kept = weighed(rows), set()
    if all(marked for t, marked, *_ in rows if t):  # then class names say nothing, and adverts are plain lines
        return None
    for of_marked in (False, True):
        places = [i for i, (_, marked, article, _) in enumerate(rows) if of_marked or not (marked and article)]
        own = [weight[i] if rows[i][1] == of_marked else 0.0 for i in places]
        sums = [sum(own[j] for j in range(i - window + 1, i + 1) if j >= 0) for i in range(len(own))]
        level = most if of_marked else min(share * max(sums), most)
        for k in range(len(own)):
            a = z = k
            while a and sums[a - 1] > 0:
                a -= 1
            while z + 1 < len(sums) and sums[z + 1] > 0:
                z += 1
            if own[k] > 0 and max(sums[a : z + 1]) > level:
                kept.add(places[k])
    between = {i for i in range(1, len(rows) - 1) if rows[i][3] and i - 1 in kept and i + 1 in kept}
    return [rows[i][0] for i in sorted(kept | between)]


def test_windows_decide():
    """Against lines, weights and windows made without the module; leaving the windows out changes most pages."""
    import random

    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(600)]
    want = [brute_force(rows) for _, rows in pages]
    got = [html_extract.main_blocks(page) for page, _ in pages]
    checked = [(g, w) for g, w in zip(got, want, strict=True) if w is not None]
    assert len(checked) > 500 and all(g == w for g, w in checked)
    all_lines = [[r[0] for r, w in zip(rows, weighed(rows), strict=True) if w > 0] for _, rows in pages]
    assert sum(w is not None and w != every for w, every in zip(want, all_lines, strict=True)) > 300
    story = "<article><h1>Head</h1><p>Short story.</p></article><div><p>stray words here</p></div>"
    assert html_extract.main_blocks(story) == ["Head", "Short story."]


def given_pages():
    import pyarrow.parquet as pq

    return [p or "" for p in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()]


def test_windows_decide_on_the_given_pages():
    """With every line that has weight kept, all results change: adverts and footers go by their sums alone."""
    for page in given_pages():
        rows = html_extract.lines(page, 3)
        every = [r.text for r, w in zip(rows, html_extract.weights(rows), strict=True) if w > 0]
        assert html_extract.main_blocks(page) != every


def test_marked_text_of_great_length_is_main_text():
    """Markup lowers a weight and doesn't decide: a story in a form is kept, a signup form elsewhere goes."""
    long = ("A whole story stands here in a form. " * 150).strip()
    lead = [f"Lead line {i} of the page." for i in range(4)]
    page = "<form><p>Sign up for mail</p></form>" + "".join(f"<p>{t}</p>" for t in lead) + f"<form><p>{long}</p></form>"
    assert html_extract.main_blocks(page) == [*lead, long]


def test_a_very_long_page():
    texts = [f"{i} " + "plain words " * 20 for i in range(20_000)]
    page = "<nav>Home</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>(c)</footer>"
    assert html_extract.main_blocks(page) == [t.strip() for t in texts]


def test_articles_are_not_cut():
    """Short lines behind an advert, behind closed containers, at the end, and links of an article stay."""
    page = (
        f"<main><article><div><div><div><h1>T</h1></div></div></div><p>{'plain words of text ' * 30}</p><div class=ad>Buy this now</div><p>So.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>"
        "<p>End.</p></main><footer>Imprint and so on</footer>"
    )
    assert html_extract.main_blocks(page)[0] == "T" and html_extract.main_blocks(page)[2:] == ["So.", "One", "Two", "End."]


def test_only_what_is_marked_goes():
    page = (
        "<article><p>Let <math><mi>x</mi></math> be <svg><title>icon</title><text>y</text></svg></p><div class='notification-systems'><p>Systems text</p></div><p class='search-results-discussion'>Found it</p>"
        "<p>Press <button>OK</button> now</p><button>Share</button><div class='ad-slot-300x250'>Buy</div><div id='comments-area'><p>First!</p></div><noscript>Enable scripts</noscript></article>"
    )
    assert html_extract.main_blocks(page) == ["Let x be y", "Systems text", "Found it", "Press OK now"]
    bare = "".join(f"<p>{'plain words of text ' * 8}{i}</p>" for i in range(3)) + "<div>Home | About | Contact</div></div></div><div>(c) 2024</div>"
    assert len(html_extract.main_blocks(bare)) in (3, 4) and "Home" not in "".join(html_extract.main_blocks(bare))
