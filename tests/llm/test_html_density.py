"""Main text of pages against a recursive version of the density rules, and furniture that is easily taken wrongly."""

import math
import random

import pytest

from bidlake.llm import html_text

WORDS = "Body words here. " * 9


@pytest.mark.parametrize("page, text", [
    ("<main><article><p>" + WORDS + "</article><section class=comments><article class=comment>" + "I disagree with this. " * 8 + "</article><article class=comment>Me too</article></section></main>", WORDS.strip()),
    ("<body><article><h1>T</h1><p>" + WORDS + "<section class=comments><article class=comment>no no</article></section></article>", "T\n" + WORDS.strip()),
    ("<body><article class='comment'>first!</article><article class=post><p>" + WORDS + "</article>", WORDS.strip()),
    ("<body><form id=aspnetForm><div><input><h1>T</h1><p>" + WORDS + "</div><button>Send</button></form>", "T\n" + WORDS.strip()),
    ("<body><article><p>" + WORDS + "<form><p>Your name<input></form></article>", WORDS.strip()),
    ("<body><div class=notice><h1>We use cookies</h1>accept</div><article><p>" + WORDS + "</article>", WORDS.strip()),
    ("<body><article><p class='ad-hoc'>One ad-hoc remark.<p class='share-price'>Shares fell.<p>Mass is <math><mi>E</mi><annotation>\\E</annotation></math> here.</article>", "One ad-hoc remark.\nShares fell.\nMass is E here."),
    ("<body><article><p>" + WORDS + "</article><div class='ad-slot-2'>Buy now</div><div class='top-ad'>Buy</div><section class=responses>" + "<p>I think it is bad, really bad." * 3 + "</section>", WORDS.strip()),
    ("<body><div class='sidebar-layout'><h1>T</h1><p>" + WORDS + "</div><p>x", "T\n" + WORDS.strip()),
    ("<body><div id=comments><div class=comment><p>" + "long reply of a reader. " * 30 + "</div></div><div class=entry><p>" + WORDS + "</div>", WORDS.strip()),
])
def test_furniture(page, text):
    assert html_text.main_text(page) == text


# --- a recursive, unoptimised version of the rules, on trees that need no parser ---


def grow(rng, depth):
    """A tree of (tag, children); texts are children too."""
    tag = rng.choice(("div", "div", "section", "p", "ul", "a", "span", "article", "nav"))
    if tag in ("p", "a", "span") or depth == 0:
        tag = tag if tag in ("p", "a", "span") else "p"
        return (tag, [words(rng, rng.randint(0, 3 if tag == "a" else 30))])
    return (tag, [grow(rng, depth - 1) if rng.random() < 0.8 else words(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 4))])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def to_html(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(to_html, node[1]))}</{node[0]}>"


def numbers(node, inside=False):
    """(characters, tags below, link characters, link tags below)"""
    if isinstance(node, str):
        n = sum(not c.isspace() for c in node)
        return n, 0, n if inside else 0, 0
    parts = [numbers(x, inside or node[0] == "a") for x in node[1]]
    tags = sum(not isinstance(x, str) for x in node[1])
    links = sum(not isinstance(x, str) and x[0] == "a" for x in node[1])
    return sum(p[0] for p in parts), tags + sum(p[1] for p in parts), sum(p[2] for p in parts), links + sum(p[3] for p in parts)


def dense(node, share):
    c, t, lc, lt = numbers(node, False)
    if node[0] == "a":
        lc = c
    if c == 0:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    inner = c / max(1, c - lc) * lc + share * c + math.e
    top = math.log(max(1.0, (c / max(1, lc)) * (t / lt)))
    return max(0.0, c / t * top / max(1.0, math.log(math.log(inner)) if math.log(inner) > math.e else 1.0))


def texts(node):
    """The blocks below a node."""
    out, run = [], []

    def close():
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    def visit(x):
        if isinstance(x, str):
            run.append(x)
        elif x[0] != "nav":
            block = x[0] not in ("a", "span")
            close() if block else None
            for y in x[1]:
                visit(y)
            close() if block else None

    visit(node)
    close()
    return "\n".join(out)


def plain_text(body):
    share = numbers(body)[2] / max(1, numbers(body)[0])
    total = lambda x: sum(dense(y, share) for y in x[1] if not isinstance(y, str) and y[0] != "nav")
    found = []

    def visit(x, path):
        if isinstance(x, str) or x[0] == "nav":
            return
        if numbers(x)[0]:
            found.append((total(x), path + [x]))
        for y in x[1]:
            visit(y, path + [x])

    visit(body, [])
    if not found:
        return ""
    best_total, path = max(found, key=lambda f: f[0])
    best = path[-1]
    for x in reversed(path[:-1]):
        if x is body:
            whole = total(x) > total(best) * 0.5 and dense(x, share) >= dense(body, share) and best[0] not in ("div", "section", "td")
            return texts(x if whole else best)
        if dense(x, share) < dense(body, share):
            break
        best = x
    return texts(best)


@pytest.mark.parametrize("seed", range(40))
def test_density_against_recursion(seed):
    rng = random.Random(seed)
    for _ in range(25):
        body = ("body", [grow(rng, 4) for _ in range(rng.randint(1, 4))])
        root = html_text.parse(to_html(body))
        nodes = html_text.count(root)
        parsed = next(x for x in nodes if x.tag == "body")
        assert (parsed.chars, parsed.tags, parsed.link_chars, parsed.link_tags) == numbers(body)
        html_text._skips(root, True)
        html_text.measure(nodes)
        assert "\n".join(html_text.blocks(html_text.core(nodes))) == plain_text(body)


def test_empty_table(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
