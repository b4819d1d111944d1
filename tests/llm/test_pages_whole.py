import random
from collections import Counter, defaultdict

import pytest

from feedops.llm import pages

PAGE = "page_id long, url string, html string"


def texts(spark, bodies):
    rows = [(i, f"http://one.com/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, PAGE)).collect()}
    return [got[i].split("\n\n") for i in range(len(bodies))]


def test_two_siblings_with_text_of_their_own_both_stay(spark):
    body = "<div class='intro'><p>{}</p></div><div class='story'><p>{}</p></div><div class='nav'>menu</div>"
    got = texts(spark, [body.format(f"intro {i} " * 7, f"story {i} " * 13) for i in range(6)])
    assert got == [[" ".join([f"intro {i}"] * 7), " ".join([f"story {i}"] * 13)] for i in range(6)]


def test_one_long_page_does_not_decide_for_the_others(spark):
    body = "<div class='a'><p>{}</p></div><div class='b'><p>{}</p></div>"
    got = texts(spark, [body.format(f"first {i}", f"second {i} " * (5000 if i == 0 else 1)) for i in range(6)])
    assert [g[0] for g in got] == [f"first {i}" for i in range(6)] and [g[1] for g in got[1:]] == [f"second {i}" for i in range(1, 6)]


def test_text_of_some_pages_only_and_outside_elements_stays(spark):
    story = "<div class='story'><p>{}</p></div>"
    got = texts(spark, [story.format(f"story {i} ") + ("<div class='more'>extra</div>" if i == 2 else "") for i in range(6)])
    assert got[2] == ["story 2", "extra"] and got[3] == ["story 3"]
    rows = [(i, f"http://two.com/{i}", f"<div class='story'><p>story {i}</p></div> loose {i}") for i in range(4)]
    assert sorted(r.text for r in pages.extract(spark.createDataFrame(rows, PAGE)).collect()) == [f"story {i}\n\nloose {i}" for i in range(4)]


def test_constant_text_beside_the_one_varying_place_goes(spark):
    got = texts(spark, [f"<div class='x1'>chrome without a known word</div><div class='x2'><p>story {i}</p><p>shared end</p></div>" for i in range(6)])
    assert got == [[f"story {i}", "shared end"] for i in range(6)]


MENU = "<div class='q1'><ul><li><a>Home</a></li><li><a>About</a></li></ul></div>"
END = "<div class='q9'><b>All</b> rights kept</div>"


@pytest.mark.parametrize("shell", ["{}", "<article>{}</article>", "<main><div class='w'>{}</div></main>"])
def test_only_vectors_tell_the_template_from_the_content(spark, shell):
    """Menu and end have no known name; they go because their texts have the vectors of their elements."""
    body = MENU + "<div class='q2'><p>story number {0}</p><p>the same on all pages</p></div><div class='q3'>posted {0}</div>" + END
    got = texts(spark, [shell.format(body.format(i)) for i in range(6)])
    assert got == [[f"story number {i}", "the same on all pages", f"posted {i}"] for i in range(6)]


def test_part_of_the_pages_may_share_a_template(spark):
    """A box in four of six pages has one text there: its class is valid on its own."""
    box = "<div class='q5'><p>buy this now</p></div>"
    got = texts(spark, [f"<div class='q2'>story {i}</div>" + (box if i < 4 else "") for i in range(6)])
    assert got == [[f"story {i}"] for i in range(6)]


def test_few_pages_and_copies_keep_what_they_share(spark):
    three = texts(spark, [f"<div class='q2'>story {i}</div><div class='q3'>posted {i}</div>{END}" for i in range(3)])
    assert three == [[f"story {i}", f"posted {i}", "All rights kept"] for i in range(3)]
    long = ["first paragraph of a long text " * 5, "second paragraph of this long text " * 5, "third paragraph of that long text " * 5]
    near = [f"<article><h1>head</h1><div class='q2'>{long[0]}</div><div class='q4'>{long[1]}</div><div class='q5'>{long[2]}</div><div class='q6'>note {i}</div></article>" for i in range(8)]
    assert all(len(t) == 5 for t in texts(spark, near))


def test_classes_equal_plain_vectors(spark):
    """The folded vectors group tokens just as the vectors written out."""
    rng = random.Random(8)
    names = [f"n{k}" for k in range(7)]

    def inside(depth):
        return "".join(f"<div class='{rng.choice(names)}'>{inside(depth - 1) if depth and rng.random() < 0.6 else rng.choice(['x', 'y'])}</div>" for _ in range(rng.randint(1, 3)))

    rows = [(i, f"http://h{i % 3}.com/{i}", f"<html><body>{inside(3)}</body></html>") for i in range(40)]
    found = pages.page_tokens(spark.createDataFrame(rows, PAGE)).collect()
    vectors, whole = defaultdict(Counter), defaultdict(dict)
    for i, url, page in rows:
        for path, token in pages.tokens(page)[0].items():
            vectors[url.split("/")[2], path][i] = token.times
            whole[url.split("/")[2], path][i] = token.whole and token.whole.intdigest()
    own = defaultdict(set)
    for key, vector in vectors.items():
        own[key[0], tuple(sorted(vector.items()))].add(key[1])
    folded = defaultdict(set)
    for r in found:
        folded[r.host, r.pages, r.fold].add(r.path)
        said = set(whole[r.host, r.path].values())
        assert r.constant == (len(said) == 1 and None not in said) and r.pages == len(vectors[r.host, r.path])
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, folded.values()))


def test_text_below_is_hashed_in_order():
    def whole(page, path):
        return pages.tokens(page)[0][path].whole.intdigest()

    a = "<div><p>one</p><p>two</p></div>"
    assert whole(a, "div") == whole("<div> <p>one</p>\n<p>two</p></div>", "div") != whole("<div><p>two</p><p>one</p></div>", "div")
    assert whole(a, "div") == whole("<div><p>one</p><nav>menu</nav><p>two</p></div>", "div")
    assert pages.tokens("<div><p></p></div>")[0]["div"].whole is None
