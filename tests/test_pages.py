"""Text of pages: worked cases, and random pages against a second version over lists of open elements."""

import random
import re

import pytest

from storyline.plans import catalogue
from storyline.sources import pages

LONG = "A paragraph that is long enough to be kept in the text"


@pytest.mark.parametrize(
    ("html", "found"),
    [
        (f"<body><p>{LONG} zero</p><article><p>{LONG} one</p></article><article><p>{LONG} two</p></article>", f"{LONG} one"),
        (f"<body><div class='poster'><p>{LONG} no</p></div><p>{LONG} yes</p></body>", f"{LONG} no\n\n{LONG} yes"),
        (f"<body><p>{LONG} no</p><div class='x Article-Body'><p>{LONG} yes</p></div></body>", f"{LONG} yes"),
        (f"<main><p>The maker of cookie ovens raised its forecast for this year</p><p>{LONG} (terms of service)</p></main>", "The maker of cookie ovens raised its forecast for this year"),
        ("<article><p>Sign up for newsletter and read more of it</p></article>", ""),
        ("<article><h1>Head</h1> text  here <script>no</script><br>more</article>", "Head\ntext here\nmore"),
        (f"<nav><article><p>{LONG} no</p></article></nav><body><p>{LONG} <b>bold</b>text<!-- x -->end</p><footer><p>{LONG}</p></footer>", f"{LONG} bold text end"),
        (f"<article><p>{LONG} outer<p>{LONG} inner</p></article>", f"{LONG} outer {LONG} inner\n\n{LONG} inner"),
        ("<p>" + "word " * 3000, ("word " * 3000)[:6000].rsplit(" ", 1)[0] + "…"),
        ("</p></div>&amp;&lt; plain", "&< plain"),
        ("", ""),
        (None, ""),
    ],
)
def test_extract(html, found):
    assert pages.extract(html) == found


def second_version(html):
    """Tokens of a page with the numbers of the elements that are open around each."""
    opened, number, spans, texts, dead = [], 0, [], [], 0
    for token in re.findall(r"<!--.*?-->|<[^>]*>|[^<]+", html, re.S):
        m = re.match(r"<(/?)(\w+)(?:\s+class='([^']*)')?", token)
        if token.startswith("<!--"):
            continue
        if not m:
            texts.append((tuple(n for n, _ in opened), any(t in pages.DROPPED for _, t in opened), token.strip()))
        elif m[1]:
            if any(t == m[2] for _, t in opened):
                while opened.pop()[1] != m[2]:
                    pass
        else:
            number += 1
            spans.append((number, m[2], m[3] or "", tuple(n for n, _ in opened), any(t in pages.DROPPED for _, t in opened) or m[2] in pages.DROPPED))
            if m[2] not in pages.VOID:
                opened.append((number, m[2]))
    live = [s for s in spans if not s[4]]
    wanted = [[s for s in live if s[1] == k] for k in ("article", "main")] + [[s for s in live if any(re.search(pages.CONTAINER_CLASS, c, re.I) for c in s[2].split())], [s for s in live if s[1] == "body"]]
    box = next((w[0][0] for w in wanted if w), 0)
    inside = lambda around, n: not n or n in around
    words = lambda n: [x for around, dead, x in texts if x and not dead and inside(around, n)]
    paragraphs = [s[0] for s in live if s[1] == "p" and inside(s[3], box)]
    if not paragraphs:
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join(words(box)))).strip()
    parts = [" ".join(words(p)) for p in paragraphs]
    text = "\n\n".join(p for p in parts if len(p) > 25 and not any(b in p.lower() for b in pages.BOILERPLATE))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def test_random_pages():
    rng = random.Random(3)
    tags = ["p", "p", "p", "div", "article", "main", "nav", "b", "br", "aside", "section", "body"]
    for _ in range(1500):
        html = ""
        for _ in range(rng.randrange(1, 25)):
            tag = rng.choice(tags)
            html += rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f"<div class='{rng.choice(['post', 'post-content', 'x story_content', 'article'])}'>", "<!-- c -->", rng.choice(["some words of the page, ", "Advertisement ", LONG + " ", " \n\t", "x"])])
        assert pages.extract(html) == second_version(html), html


def test_page_texts_of_the_table(spark):
    """The pages' articles hold a heading and paragraphs, of which the first is never closed."""
    import html as H

    sf = "/root/testdata/sf0.001"
    found = {r["page_id"]: r["text"] for r in catalogue.page_texts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        first = next((x for x in found[r["page_id"]].split("\n\n")), "")
        assert all(w in H.unescape(re.sub(r"<[^>]*>", " ", inner)) for w in first.rstrip("…").split()[:50])
