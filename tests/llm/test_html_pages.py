"""HTML extraction on generated pages whose main text is known, and on hostile pages."""

import html
import random
import time

import pytest

from tracelode.llm import html_text

WORDS = "the of and river stone light, window under paper often, garden seven market & <tag> caf\xe9 no’ when slowly".split()


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def page(seed):
    """(html, main text): an article among menus, notices, adverts, forms, widgets and comments in one of many layouts."""
    rng = random.Random(seed)
    esc = html.escape
    parts, main = [], []

    def block(tag, text, inner=None):
        parts.append(f"<{tag}>{inner or esc(text)}</{tag}>" if tag != "p" or rng.random() < 0.7 else f"<p>{inner or esc(text)}")
        main.append(" ".join(text.split()))

    block("h1", sentence(rng, 6))
    for _ in range(rng.randrange(2, 9)):
        text = sentence(rng, rng.randrange(8, 60))
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "mixed", "list"])
        if kind == "mixed":
            a, b = sentence(rng, 9), sentence(rng, 12)
            block("p", f"{a} {b}", f"{esc(a)}\n  <b>{esc(b)}</b>")
        elif kind == "list":
            items = [sentence(rng, 7) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{esc(x)}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
            main.extend(items)
        else:
            block(kind, text)
    parts.insert(rng.randrange(1, len(parts) + 1), f'<div class="{rng.choice(["ad", "advert-box", "promo", "share-buttons"])}">{esc(sentence(rng, 12))}</div>')
    body = "".join(parts)
    article = rng.choice(
        ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div class="content legal">{}</div>', '<div class="content discussion">{}</div>', '<div id="post-9"><div>{}</div></div>', '<article class="story"><div>{}</div></article>']
    ).format(body)
    link = lambda: f'<a href="/{rng.randrange(99)}">{esc(sentence(rng, 2))}</a>'
    menu = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(6)) + "</ul>"
    before = [f"<nav>{menu}</nav>", f'<div id="main-menu">{menu}</div>', f"<header><p>{esc(sentence(rng, 5))}</p>{menu}</header>", f'<div class="cookie-notice">{esc(sentence(rng, 20))}</div>', '<form><input name=q><button>Go</button></form>', "<script>if (a<b) { x='<p>no</p>' }</script>"]
    after = [
        f"<aside><h3>{esc(sentence(rng, 3))}</h3>{menu}</aside>", f'<div class="sidebar"><p>{esc(sentence(rng, 30))}</p></div>', f"<footer>&copy; {esc(sentence(rng, 9))}</footer>",
        '<section id="comments">' + "".join(f'<div class="comment"><p>{esc(sentence(rng, 40))}</p></div>' for _ in range(rng.randrange(1, 6))) + "</section>", "<!-- <p>hidden</p> -->", f'<div style="display: none"><p>{esc(sentence(rng, 30))}</p></div>',
    ]
    pick = lambda xs: "".join(rng.sample(xs, rng.randrange(len(xs) + 1)))
    return f"<!DOCTYPE html><html><head><title>{esc(main[0])}</title><style>p{{}}</style></head><body>{pick(before)}{article}{pick(after)}</body></html>", "\n".join(main)


@pytest.mark.parametrize("seed", range(300))
def test_generated_pages(seed):
    made, want = page(seed)
    assert html_text.main_text(made) == want


@pytest.mark.parametrize("made", ["<div>" * 200_000 + "x", "<p>word, " * 110_000, "<div>" * 50_000 + "</x>" * 150_000 + "x", "<div>" * 20_000 + "<li>x" * 150_000, "<a '" * 250_000 + "x", "<a b='x\" c=\"" * 80_000, "<table><tr><td>x" * 60_000, "<p><button>" + "<div>" * 200_000])
def test_time_is_linear(made):
    small = made[: len(made) // 8]
    began = time.process_time()
    html_text.main_text(small)
    middle = time.process_time()
    html_text.main_text(made)
    assert time.process_time() - middle < 24 * (middle - began) + 1


def test_named_containers():
    only = "Only, text here"
    assert all(html_text.main_text(f'<div class="{c}"><p>{only}</p></div>') == only for c in ("content legal", "content discussion", "notice"))
    assert html_text.main_text(f"<h1>T</h1><div class=comments><p>{'Long, comment ' * 50}</p></div>") == "T"
    assert html_text.main_text("<span>hello</span>") == "hello"


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x", 1), (1, "u", "<p>a</p>", "x", 1), (None, None, None, None, None), (2, "", "", "y", 2), (3, "v", "<p>" + "long " * 200_000, "z", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")  # names that clash
    got = sorted(((r["page_id"] or 0), r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    long = ("long " * 200_000).strip()
    assert got == [(0, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0), (3, "v", long, len(long))]
