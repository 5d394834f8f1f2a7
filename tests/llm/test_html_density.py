"""Densities against a plain recomputation on small trees; names count with size, place and links only."""

import math
import random

from trackloom.llm.html import Page, main_text

P1 = "A first paragraph of the article, long enough to be dense and to carry the weight of the text."
P2 = "A second one, which goes on about the same matter at some length and without any links at all."
P3 = "The third closes the argument; it has as many words as the others and says as little as they do."


def page(inner):
    return f"<html><body><nav><a href='/'>Home</a> <a href='/b'>About us</a></nav>{inner}<footer>Imprint</footer></body></html>"


def test_names_alone_do_not_drop_article_text():
    got = main_text(page(f'<article><header><h1>Title</h1></header><p>{P1}</p><div class="related-work"><p>{P2}</p></div><p class="form-of-verbs">{P3}</p></article>'))
    assert got == f"Title\n\n{P1}\n\n{P2}\n\n{P3}"
    assert main_text(page(f'<div class="content sidebar-right"><p>{P1}</p><p>{P2}</p></div>')) == f"{P1}\n\n{P2}"
    assert main_text(page(f'<article><p>{P1}</p><p class="notice">{P2} {P3}</p></article>')) == f"{P1}\n\n{P2} {P3}"
    assert main_text(f"<body><form action='x'><input name=a><div><p>{P1}</p><p>{P2}</p></div><button>Go</button></form></body>") == f"{P1}\n\n{P2}"
    assert main_text(page(f'<article data-id="ad" data-class="promo"><p>{P1}</p></article>')) == P1


def test_furniture_goes_by_name_with_size_place_and_links():
    text = f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p>"
    for noise in (
        "<div class='ad'>Buy now, the best offer of the whole year, really</div>", "<div id='cookie-notice'>We use cookies</div>", "<aside>See also</aside>",
        "<p class='copyright'>All rights reserved</p>", "<div class='related-stories'><a href='1'>One more story</a> <a href='2'>And another</a></div>",
        f"<section class='reader-comments'><p>{P3}</p><p>{P3}</p><p>{P3}</p><p>{P3}</p><p>{P3}</p></section>", "<div role='navigation'>x y z</div>",
        "<form><label>Mail</label><input name=q>Write to us</form>", "<header class='x'><nav><a href='/'>Home</a></nav></header>", "<footer>Filed under</footer>",
    ):
        assert main_text(page(text + noise + "</article>")) == f"Title\n\n{P1}\n\n{P2}", noise
        assert main_text(page(text + "</article>" + noise)) == f"Title\n\n{P1}\n\n{P2}", noise
    assert main_text(page(f"<header><h1>Site</h1>Name of the site</header>{text}</article>")) == f"Title\n\n{P1}\n\n{P2}"


def test_dense_parts_outside_an_article_stay_chosen():
    got = main_text(page(f"<article><p>{P1} {P2}</p><p>{P2} {P3}</p></article><div><p>{P3} {P1}</p><p>{P2} {P3}</p></div>"))
    assert got == f"{P1} {P2}\n\n{P2} {P3}\n\n{P3} {P1}\n\n{P2} {P3}"


def test_nothing_in_nothing_out(spark):
    from trackloom.llm.html import extract

    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_density(tree, body):
    """tree: (tag, [children or text]) -> density, by the formula."""
    def count(node, link):
        tag, kids = node
        link = link or tag == "a"
        c = lc = t = lt = 0
        for k in kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                c, lc = c + n, lc + n * link
            else:
                x = count(k, link)
                c, lc, t, lt = c + x[0], lc + x[1], t + x[2] + 1, lt + x[3] + (k[0] == "a")
        return c, lc, t, lt

    c, lc, t, lt = count(tree, False)
    cb, lcb, _, _ = count(body, False)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + lcb / max(1, cb) * c + math.e)
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)  # counts of nothing count as one in denominators
    return c / t * (max(0.0, math.log(c / lc * t / lt, base)) if base > 1 + 1e-12 else math.log(max(1.0, c * t)))


def random_tree(rng, depth):
    kids = []
    for _ in range(rng.randint(1, 4)):
        r = rng.random()
        if depth == 0 or r < 0.35:
            kids.append(" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 12))))
        elif r < 0.5:
            kids.append(("a", ["y" * rng.randint(1, 9)]))
        else:
            kids.append((rng.choice(["div", "section", "span"]), random_tree(rng, depth - 1)))
    return kids


def html_of(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(html_of, node[1]))}</{node[0]}>"


def test_core_is_the_node_with_the_largest_sum():
    rng = random.Random(3)
    for _ in range(200):
        body = ("body", random_tree(rng, 3))
        best, order = None, []

        def walk(node):
            if isinstance(node, str):
                return
            order.append(node)
            for k in node[1]:
                walk(k)

        walk(body)
        total = [sum(plain_density(k, body) for k in x[1] if not isinstance(k, str)) for x in order]
        chars = [sum(len("".join(t.split())) for t in _texts(x)) for x in order]
        best = max(range(len(order)), key=lambda i: (round(total[i], 9), chars[i], -i))
        p = Page(html_of(body))
        chosen = p.content()
        core = best
        while core and p.tag[core + 1] not in ("section", "div", "body"):  # node 0 is the root, so ours are one further
            core = p.parent[core + 1] - 1
        covered = {i for i in range(len(p.tag)) if any(_under(p, i, c) for c in chosen)}
        assert core + 1 in covered


def _texts(node):
    for k in node[1]:
        if isinstance(k, str):
            yield k
        else:
            yield from _texts(k)


def _under(p, i, c):
    while i > 0:
        if i == c:
            return True
        i = p.parent[i]
    return False
