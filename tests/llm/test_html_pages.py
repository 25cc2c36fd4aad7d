"""Extraction on pages of layouts that the training pages don't have, hostile pages, repeated and very long ones."""

import random
import time

import pytest

from corvane.llm import html

SCHEMA = "page_id long, url string, html string"


def say(rng, a, b):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randint(a, b)))


def page(rng, opening, closing):
    """A page and its main text."""
    title, paragraphs = say(rng, 3, 8), [say(rng, 20, 60) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<li><a href=/{i}>{say(rng, 1, 2)}</a></li>" for i in range(6))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    text = f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class=ad>{say(rng, 3, 9)}</div>{opening}{body}{closing}<aside class=sidebar><h3>{say(rng, 1, 3)}</h3><ul>{menu}</ul></aside><footer>&copy; {say(rng, 3, 9)}</footer></body></html>"
    return text, "\n".join([title, *paragraphs])


def test_pages_of_other_layouts(spark):
    rng = random.Random(1)
    train = spark.createDataFrame([(i, "u", page(rng, "<article>", "</article>")[0]) for i in range(80)], SCHEMA)
    layouts = [("<main>", "</main>"), ("<div class='post content'>", "</div>"), ("<div id=main-content><section class=story>", "</section></div>"), ("<article>", "</article>")]
    made = [page(rng, *layouts[i % 4]) for i in range(80)]
    got = html.main_texts([p for p, _ in made], html.fit(train))
    exact = [sum(g == t for g, (_, t) in list(zip(got, made, strict=True))[k::4]) for k in range(4)]
    assert exact[3] == 20 and sum(exact) >= 72, exact


@pytest.mark.parametrize("part", ['<a "', '<a ="', "<div>", "<div></p>", "<select>", "<![CDATA[", "<", "<button><div>", "<title>", "<table><td>", "<!--", "<ul><div><li></li>", "<svg><p>", "<div class=x>y</b>"])
def test_time_is_linear(part):
    def took(n):
        began = time.process_time()
        html.main_texts([part * n], None)
        return time.process_time() - began

    took(2000)
    assert took(16_000) < 0.2 + 4 * took(8_000)


def test_edge_cases_of_a_table(spark):
    rng = random.Random(2)
    one, text = page(rng, "<article>", "</article>")
    long = one.replace("</h1>", "</h1><p>" + say(rng, 60_000, 60_000) + "</p>")
    rows = [(1, "u", one), (1, "u", one), (None, None, one), (2, "u", long), (3, "u", "<body><button>Menu <article><h1>one</h1><p>two</p></article></body>")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html.extract(df, None).collect()), key=lambda r: r[0])
    assert len({g[1] for g in got[:3]}) == 1 and text in got[0][1] and got[4][1] == "one\ntwo"
    assert got[3][2] > 200_000 and all(n == len(t) for _, t, n in got)


def test_training_sample_is_bounded_on_equal_pages(spark):
    rng = random.Random(3)
    pages = [page(rng, "<article>", "</article>")[0] for _ in range(3)]
    df = spark.createDataFrame([(7, "u", pages[i % 3]) for i in range(300)], SCHEMA)
    assert html.fit(df, max_pages=6, trees=2) is not None
