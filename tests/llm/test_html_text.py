import random
import time

from plumbline.llm.html_text import extract_main_text, main_text

LONG = "Some long text of the article that goes on and on for quite a while, with commas and more words."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy this now, a long advert text that goes on for very long indeed.</div>
    <article><h1>Head &amp; line</h1><p><b>{LONG}<br>same
    block<p>Short.</p><div class='promo banner'><p>Subscribe to our letter</p></div><p>&lt;p&gt; caf&eacute; &#8364;</p></article>
    <section id="comments"><p>{LONG}</p></section><footer>&copy; me</footer></body>"""
    assert main_text(page) == f"Head & line\n\n{LONG} same block\n\nShort.\n\n<p> café €"


def test_page_without_article_elements():
    page = f"<body><div class=menu><a href=x>Home</a></div><div><a href=1>One</a> <a href=2>Two</a></div><h1>Title</h1><p>{LONG}<p class=ad>BUY<p>More text<div class=comments><p>{LONG}</p></div><form>{LONG}</form>"
    assert main_text(page) == f"Title\n\n{LONG}\n\nMore text"


def test_article_keeps_linked_and_short_lines():
    body = '<h1><a href=x>Title</a></h1><div class="post-header share-price">By me</div><p>{}</p>{}<p>End.</p><p><a href=y>Read on</a></p>'
    refs = "".join(f"<li><a href={i}>Work {i}</a></li>" for i in range(5))
    kept = ["Title", "By me", LONG, *(f"Work {i}" for i in range(5)), "End.", "Read on"]
    for tag in ("article", "main"):
        page = f"<p>{LONG}</p><{tag}>{body.format(LONG, f'<ol>{refs}</ol>')}<div class='x share'>Share</div></{tag}><p>{LONG}</p>"
        assert main_text(page) == "\n\n".join(kept)
    assert main_text("<article><h2><a href=x>Only a link</a></h2></article>") == "Only a link"
    # the advert's end lies behind the article's: what follows is still outside
    assert main_text(f"<article><p>{LONG}</p><div class=ad>Buy</article><p>x</p></div><p>Not of it</p>") == LONG


def test_left_out_parts_do_not_split_a_stretch():
    ad = "<div class=ad>BUY</div>"
    assert main_text(f"<body><p>{LONG}</p>{ad}<p>Short closing sentence.</p>{ad}<p>And one.</p>") == f"{LONG}\n\nShort closing sentence.\n\nAnd one."
    assert main_text(f"<body><h1>Title</h1>{ad}{ad}<p>{LONG}</p>") == f"Title\n\n{LONG}"


def test_short_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("<p>Tiny.") == "Tiny."
    assert main_text("<article><p>Les.<br></article><footer>x</footer>") == "Les."
    assert main_text("plain text") == "plain text"
    assert main_text("<div class='ad'>never closed<p>Kept text").endswith("Kept text")
    assert main_text(f"<article><p>{LONG * 3000}</p></article>") == LONG * 3000


def test_rows(spark):
    rows = [(1, "u", "<p>Tiny.", "x", 3), (1, "u", "<p>Tiny.", "x", 3), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_main_text(frame).collect()), key=str)
    assert out == [(0, None, "", 0), (1, "u", "Tiny.", 5), (1, "u", "Tiny.", 5)]
    assert extract_main_text(frame.limit(0)).count() == 0


def brute(lines):
    """Surges and dives by hand: a line is alive if it or one of the next two weighs anything."""
    weights = [0 if linked else len(text.replace(" ", "")) for text, linked in lines]
    at = lambda i: weights[i] if 0 <= i < len(weights) else 0
    blocks = [at(i) + at(i + 1) + at(i + 2) for i in range(len(lines))]
    stretches, now = [], []
    for i, block in enumerate(blocks):
        if block:
            now.append(i)
        if now and (not block or i == len(blocks) - 1):
            stretches.append(now)
            now = []
    least = min(80, max(blocks, default=0) / 2)
    out = []
    for rows in stretches:
        if max(blocks[i] for i in rows) >= least:
            heavy = [i for i in rows if weights[i]]
            out += [lines[i][0] for i in rows if heavy[0] <= i <= heavy[-1]]
    return "\n\n".join(out)


def test_only_the_distribution_separates_text_from_links():
    """No article element, no class names, one element for every line."""
    rng = random.Random(2)
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 40)):
            linked = rng.random() < 0.5
            for _ in range(rng.randrange(1, 5)):
                lines.append((" ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice((1, 2, 25)))), linked))
        page = "".join(f"<div><a href=x>{t}</a></div>" if linked else f"<div>{t}</div>" for t, linked in lines)
        assert main_text(page) == brute(lines)
    menu = "".join(f"<div><a href={i}>Section {i}</a></div>" for i in range(6))
    page = f"<body>{menu}<div>Title</div><div>{LONG}</div><div>{LONG}</div>{menu}<div>Imprint</div>{menu}"
    assert main_text(page) == f"Title\n\n{LONG}\n\n{LONG}"


def test_text_blocks_outweigh_an_article_element_without_text():
    teaser = "<article><a href=1>Read this too</a></article>"
    assert main_text(f"<body>{teaser}<div>{LONG}</div><div>{LONG}</div>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<body><article><p>A short note of some words.</p></article><div>{LONG}</div>") == "A short note of some words."


def test_broken_markup_takes_linear_time():
    began = time.time()
    for part in ('<p "', "<p '\"", "<![CDATA[", "<!", "<script", "<script>", "</", "<a href='>", "<!--", "<div class=ad>", "<td class=ad>", "<svg "):
        main_text(part * (1_000_000 // len(part)))
    assert time.time() - began < 12 * 2
    assert main_text('<p "' * 250_000 + "><p>End.").endswith("End.")
