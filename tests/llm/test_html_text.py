import time
import tracemalloc

import numpy as np

from tessera.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text long, n_chars string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Shop</a></li></ul></nav>
<!-- no <p>text</p> --><div class="ad">Buy now cheap.</div><article><h1>A &amp; B&nbsp;c</h1><p><b>First   <i>line</i>
next.<br><p>Second &lt;tag&gt; caf&eacute;.</p><ul><li>one<li>two</ul><div class="comments"><p>I liked this very much.</p></div></article><form><label>Name</label> of you</form><footer>&copy; x &middot; y</footer></body></html>"""


def test_blocks_follow_the_markup():
    texts = [t for _, t in H.blocks(PAGE)]
    assert texts == ["T", "Home", "Shop", "Buy now cheap.", "A & B c", "First line next.", "Second <tag> café.", "one", "two", "I liked this very much.", "Name of you", "© x · y"]
    assert H.blocks("") == [] and H.blocks("<!-- open") == [] and H.blocks("a < b") == [((), "a < b")]
    assert [t for _, t in H.blocks('<p class="a>b">x<p title=\'"\'>y</div>z')] == ["x", "y", "z"]


def test_labeller_on_unseen_lessons():
    rng = np.random.default_rng(1234)
    lessons = [H.lesson(rng) for _ in range(150)]
    found = H.trained().label([page for page, _ in lessons])
    right = sum(int(((p >= 0.5) == (y > 0)).sum()) for p, (_, y) in zip(found, lessons, strict=True))
    assert right >= 0.98 * sum(len(y) for _, y in lessons)


def test_extract(spark):
    rows = [(1, "u", PAGE, 5, "x"), (2, "u", None, None, None), (3, None, "", None, None), (None, "u", PAGE, 5, "x"), (1, "u", PAGE, 5, "x"), (4, "u", "<html><body><article>" + "<p>word word word.</p>" * 20_000 + "</article></body></html>", 0, "")]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    want = "A & B c First line next. Second <tag> café. one two"
    assert sorted((str(r.page_id), r.text[:60], r.n_chars) for r in got) == sorted((str(i), t[:60], len(t)) for i, t in [(1, want), (1, want), (None, want), (2, ""), (3, ""), (4, " ".join(["word word word."] * 20_000))])
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, got in zip(pages.orderBy("page_id").collect(), H.extract(pages).orderBy("page_id").collect(), strict=True):
        inside = [t for path, t in H.blocks(r.html) if any(e[0] == "article" for e in path)]
        assert got.text == " ".join(inside)


def test_menus_of_table_layouts():
    for side, main in (('<td class="leftnav">', '<td class="content">'), ("<td>", "<td>"), ('<td width="150">', '<td valign="top">')):
        page = f'<html><head><title>T</title></head><body><table><tr>{side}<a href="/a">Home page</a><br><a href="/b">Our products</a></td>{main}<h1>Head line</h1><p>This is the main text of the page, which goes on for a while.</p><p>And a second one that is long enough, too.</p></td></tr></table></body></html>'
        found = H.blocks(page)
        assert [t for (_, t), p in zip(found, H.trained().label([found])[0], strict=True) if p >= 0.5] == ["Head line", "This is the main text of the page, which goes on for a while.", "And a second one that is long enough, too."]


def test_end_tags_left_out():
    page = "<table><tr><td class=menu>a<td>b<tr><td>c<table><tr><td>d</table><td>e</table><ul><li>f<div>g<li>h</ul><dl><dt>i<dd>j<dt>k</dl><select><option>l<option>m</select>n</b></i></nav>o"
    paths = {t: [e[0] for e in path] for path, t in H.blocks(page)}
    assert paths["b"] == ["table", "tr", "td"] == paths["c"] == paths["e"] and paths["d"] == ["table", "tr", "td"] * 2
    assert paths["h"] == ["ul", "li"] and paths["j"] == ["dl", "dd"] and paths["k"] == ["dl", "dt"] and paths["m"] == ["select", "option"] and paths["n"] == paths["o"] == []


def test_long_pages_take_room_in_proportion():
    """Rows without end tags, elements that are never closed, and closing tags for nothing."""
    H.trained()
    for unit in ("<tr><td>a<td>bb", "<div>a<section>bb", "<div class=x>a</section>"):
        page = "<html><body><table>" + unit * (2_000_000 // len(unit))
        begun = time.monotonic()
        tracemalloc.start()
        found = H.blocks(page)
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) >= 80_000 and used < 80_000_000 and time.monotonic() - begun < 120


def test_pieces_of_long_pages_give_the_same_labels(monkeypatch):
    rng = np.random.default_rng(5)
    pages = [H.lesson(rng)[0] * 3 for _ in range(20)] + [[]]
    whole = H.trained().label(pages)
    monkeypatch.setattr(H, "CELLS", 40)
    for a, b in zip(whole, H.trained().label(pages), strict=True):
        assert len(a) == len(b) and np.allclose(a, b, atol=1e-4)
