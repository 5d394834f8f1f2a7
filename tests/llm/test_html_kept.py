"""Article text that names, links or a place beside the core must not take away."""

import pytest

from trackloom.llm.html import main_text

LONG = "The people of this town have carried water from the river to their houses for as long as anyone here can remember, and they still do."
NAV = '<div class="nav"><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></div>'
SIDE = '<div class="sidebar"><ul><li><a href="/1">One story</a></li><li><a href="/2">Another story</a></li></ul></div>'


@pytest.mark.parametrize(("html", "want"), [
    (f'<body><div class="wrap"><div class="hd"><h1>Headline</h1><p>By A</p></div><div class="body"><p>{LONG}</p><p>{LONG}</p></div></div></body>', ["Headline", "By A", LONG, LONG]),
    (f'<body>{NAV}<div class="wrap"><h1 class="header">Title</h1><div class="meta">5 May</div><div class="body"><p>{LONG}</p><p>{LONG}</p></div></div>{SIDE}</body>', ["Title", "5 May", LONG, LONG]),
    (f'<body>{NAV}<article><h1 class="page-header">Title</h1><h2 class="social">Social effects</h2><p>{LONG}</p></article></body>', ["Title", "Social effects", LONG]),
    (f'<body><article><p>The <b class="sponsor">Acme</b> firm said: {LONG}</p></article></body>', [f"The Acme firm said: {LONG}"]),
    (f'<body><main><p class="form">Short paragraph.</p><p>{LONG}</p></main></body>', ["Short paragraph.", LONG]),
    (f'<body><article><blockquote class="social">A quoted line.</blockquote><p>{LONG}</p></article></body>', ["A quoted line.", LONG]),
    (f'<body><article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article></body>', [LONG, "So x=2 holds."]),
    (f'<body><article><p>See <a class="related" href="/r">the related report</a> for more. {LONG}</p></article></body>', [f"See the related report for more. {LONG}"]),
])
def test_kept(html, want):
    assert main_text(html) == "\n\n".join(want)


@pytest.mark.parametrize("n", [1, 24, 25, 26, 60])
def test_length_does_not_decide_what_a_paragraph_is(n):
    for name in ("form", "notice", "social"):
        words = " ".join(["word"] * n)
        assert main_text(f'<body><article><p>{LONG}</p><p class="{name}">{words}</p></article></body>') == f"{LONG}\n\n{words}"


@pytest.mark.parametrize("extra", [
    '<div class="ad">Buy now and save</div>', '<aside>Aside text</aside>', '<p class="share"><a href="/f">Share this</a></p>', '<div class="cookie">We use cookies</div>', "<form>Name <input></form>",
    '<ul class="comments"><li class="comment">I do not agree with this at all.</li></ul>', '<div class="comments"><p class="comment">First!</p></div>',
])
def test_still_dropped(extra):
    assert main_text(f"<body>{NAV}<article><h1>Title</h1><p>{LONG}</p>{extra}</article>{SIDE}<footer>All rights</footer></body>") == f"Title\n\n{LONG}"


def test_a_heading_elsewhere_is_not_the_headline():
    html = f'<body><div class="header"><h1>The Site</h1></div>{NAV}<div class="wrap"><div class="body"><p>{LONG}</p><p>{LONG}</p></div></div></body>'
    assert main_text(html) == f"{LONG}\n\n{LONG}"
    with_own = f'<body><div><h1>Other</h1></div><div class="wrap"><div class="body"><h2>Own</h2><p>{LONG}</p><p>{LONG}</p></div></div></body>'
    assert main_text(with_own) == f"Own\n\n{LONG}\n\n{LONG}"
