"""Main text of layouts that the training pages don't have: articles without a known name."""

import random
import re

import pytest

from framewake.llm import htmltext

P = "Some people went to the market. They bought apples and pears there, and came back late."


@pytest.fixture(scope="module")
def model():
    return htmltext.train(htmltext.labelled_pages())


@pytest.mark.parametrize(("body", "text"), [
    (f"<p>{P}</p><p>{P}</p>", f"{P} {P}"),
    (f"<div><div><p>{P}</p><p>{P}</p></div></div>", f"{P} {P}"),
    (f"<div class='zz-body'><p>{P}</p><p>{P}</p></div>", f"{P} {P}"),
    (f"{P}<br>{P}", f"{P} {P}"),
    (f"<nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T</h1><p>{P}</p><p>See these:</p><ul><li><a href=x>First source</a></li><li><a href=y>Second source</a></li></ul><p>{P}</p></article>",
     f"T {P} See these: First source Second source {P}"),
    (f"<div class=q7><a href=a>Home</a> <a href=b>About us</a></div><div class='zz-body'><h1>Title</h1><p>{P}</p><p>{P}</p></div><footer>By us</footer>", f"Title {P} {P}"),
    (f"<table><tr><td><a href=x>Menu</a><br><a href=y>More</a></td><td><h1>Title</h1><p>{P}</p><p>{P}</p></td></tr></table>", f"Title {P} {P}"),
    (f"<article><header><h1>T</h1></header><p>{P}</p><footer>note</footer></article>", P),  # headers and footers go, an article's own too
])
def test_articles_without_known_names(model, body, text):
    assert htmltext.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>", model) == text


def strange_page(rng):
    """A page of English words in a layout of its own, and its article; names are random letters."""
    nouns = "river house winter teacher garden machine letter story border forest meeting engine reader doctor window".split()
    verbs = "found left saw made kept moved wrote heard brought closed opened followed".split()

    def sentence():
        return " ".join(rng.choice(["the", "a", "every", "no", "their"]) + " " + rng.choice(nouns) + " " + rng.choice(verbs) for _ in range(rng.randint(1, 4))).capitalize() + " the " + rng.choice(nouns) + rng.choice(".. ?!").strip() * 1 + ""

    def prose(n):
        return " ".join(sentence().rstrip() + ("" if sentence().endswith("!") else ".") for _ in range(n)).replace("..", ".").replace("?.", "?").replace("!.", "!")

    def name():
        return rng.choice(["", f' class="{"".join(rng.choice("hjkwxyz") for _ in range(4))}"', f" id=r{rng.randint(10, 99)}"])

    def title():
        return " ".join(rng.choice(nouns) for _ in range(rng.randint(2, 6))).capitalize()

    def menu():
        rows = [f"<a href=/{rng.choice(nouns)}>{rng.choice(nouns).capitalize()}</a>" for _ in range(rng.randint(3, 9))]
        return rng.choice([f"<nav{name()}>{' '.join(rows)}</nav>", f"<div{name()}>{' '.join(rows)}</div>", f"<div{name()}><ul>{''.join('<li>' + r for r in rows)}</ul></div>"])

    def end():
        return rng.choice([f"<footer{name()}>{title()}</footer>", f"<div{name()}>© {title()} <a href=/>{rng.choice(nouns)}</a></div>", menu(), ""])

    texts, body = [], []

    def add(tag, text):
        texts.append(text)
        body.append(f"<{tag}>{text}</{tag}>")

    add("h1", title())
    for _ in range(rng.randint(2, 9)):
        kind = rng.random()
        if kind < 0.75:
            add("p", prose(rng.randint(1, 5)))
        elif kind < 0.85:
            add("h2", title())
            add("p", prose(2))
        elif kind < 0.93:
            rows = [prose(1) for _ in range(rng.randint(2, 4))]
            texts.extend(rows)
            body.append("<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>")
        else:
            texts.append(x := prose(2))
            body.append(f"<blockquote{name()}>{x}</blockquote>")
    article = "".join(body)
    for _ in range(rng.randint(0, 3)):
        tag = rng.choice(["div", "section", "div", "main"])
        article = f"<{tag}{name()}>{article}</{tag}>"
    advert = rng.choice(["", f"<aside>{prose(1)}</aside>"])
    return f"<!doctype html><html><head><title>{title()}</title></head><body{name()}>{menu()}{article}{advert}{end()}{end()}</body></html>", " ".join(texts)


def test_precision_and_recall_on_strange_layouts(model):
    rng = random.Random(11)
    hit = got_all = want_all = 0
    for _ in range(150):
        html, want = strange_page(rng)
        got, want = htmltext.main_text(html, model).split(), want.split()
        left = list(want)
        for w in got:
            if w in left:
                left.remove(w)
                hit += 1
        got_all, want_all = got_all + len(got), want_all + len(want)
    print(f"precision {hit / got_all:.4f}, recall {hit / want_all:.4f}")
    assert hit >= 0.95 * got_all and hit >= 0.95 * want_all


def test_names_still_count(model):
    page = f"<html><body><div class='content'><p>{P}</p><div class='ad'>Buy now. It is cheap. Do it today, it is the last day.</div><p>{P}</p></div><div class=comments><div class=comment><p>I do not agree.</p></div></div></body></html>"
    assert htmltext.main_text(page, model) == f"{P} {P}"
    assert re.sub(r"\s", "", htmltext.main_text("<p>", model)) == ""
