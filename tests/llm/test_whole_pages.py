"""Every word and every ancestor of a block counts."""

import numpy as np

from marlstone.llm import html_blocks as H


def test_all_words_and_digits_count():
    head, path = " ".join(f"w{i}" for i in range(60)), ("body", "p")
    (_, words, measures), other = H.vectors([H.Block(path, f"{head} {'x ' * 300}1234567890")]), H.vectors([H.Block(path, f"{head} {'y ' * 300}abcdefghij")])
    assert len(words[0]) == 361 and not np.array_equal(words[0], other[1][0])
    assert measures[0, 5] > other[2][0, 5] > 0
    m = H.Labeller.new()
    x = m._input(([np.array([0])], [np.arange(2000) % 512], np.zeros((1, H.MEASURES))))
    y = m._input(([np.array([0])], [np.arange(40)], np.zeros((1, H.MEASURES))))
    assert not np.array_equal(m._input(H.vectors([H.Block(path, head + " end")])), m._input(H.vectors([H.Block(path, head + " other")])))
    assert 0 < np.abs(x[0, H.EMBED : 2 * H.EMBED]).max() < 10 * np.abs(y[0, H.EMBED : 2 * H.EMBED]).max()


def elements(page):
    return [([t for t in b.path if ":" not in t], b.text) for b in H.blocks_of(page)]


def test_omitted_end_tags_are_implied():
    n = 100
    rows = "".join(f"<tr><td>a{i}<td><p>b{i}" for i in range(n))
    got = elements(f"<body><article><table><tbody>{rows}</table><p>after</article><footer>end</footer>")
    assert got[: 2 * n] == [x for i in range(n) for x in ((["body", "article", "table", "tbody", "tr", "td"], f"a{i}"), (["body", "article", "table", "tbody", "tr", "td", "p"], f"b{i}"))]
    assert got[2 * n :] == [(["body", "article", "p"], "after"), (["body", "footer"], "end")]
    items = "".join(f"<li><p>a{i}<ul><li>in{i}</ul>" for i in range(n))
    got = elements(f"<body><article><ul>{items}</ul><dl><dt>t<dd><p>d<dt>u</dl></article><div>end")
    assert all(p[:4] == ["body", "article", "ul", "li"] and len(p) <= 6 for p, _ in got[: 2 * n])
    assert got[2 * n :] == [(["body", "article", "dl", "dt"], "t"), (["body", "article", "dl", "dd", "p"], "d"), (["body", "article", "dl", "dt"], "u"), (["body", "div"], "end")]
    assert elements("<table><tr><td>a<table><tr><td>b<tr><td>c</table>d<td>e</table>") == [(["table", "tr", "td"], "a"), *[(["table", "tr", "td", "table", "tr", "td"], x) for x in "bc"], (["table", "tr", "td"], "d"), (["table", "tr", "td"], "e")]


def test_options_without_end_tags_hide_no_text():
    page = "<body><datalist><option value=a><option value=b></datalist><p>text</p><select><option>x</select><p>more"
    assert elements(page) == [(["body", "p"], "text"), (["body", "p"], "more")]
    assert [t for _, t in elements("<div><option>a<option>b</div><p>rest")] == ["a", "b", "rest"]


def test_all_ancestors_count_at_any_depth():
    got = H.blocks_of("<body><article>" + "<div>" * 100 + "deep" + "</div>" * 100 + "</article><p>out")
    assert got[0].path == ("body", "article", *["div"] * 100) and got[1].path == ("body", "p")
    # the incremental rows equal those of the whole path
    assert [b.rows for b in got] == [H.Block(b.path, "x").rows for b in got]
    many = H.blocks_of("<div class=c>t" * 50_000)
    assert len(many) == 50_000 and len(H.vectors(many[-3:])[0][0]) < 10


def test_only_the_attributes_themselves_name_an_element():
    page = '<div data-id="nav" data-role=banner title="class=menu id=\'foot\'" CLASS="a  b-c" class="second" id=x><p role=\'note\'>text</p></div>'
    assert [b.path for b in H.blocks_of(page)] == [("div", "class:a", "class:b", "class:c", "id:x", "p", "role:note")]


def test_templates_nest_and_scripts_do_not():
    assert [b.text for b in H.blocks_of("<p>a</p><template><template>x</template>y</template><p>b</p>")] == ["a", "b"]
    assert [b.text for b in H.blocks_of("<script>'<script>'</script>c<style><style></style>d")] == ["cd"]
    assert [b.text for b in H.blocks_of("<p>a</p><template><template>x</template><p>b</p>")] == ["a"]


def test_end_tags_without_an_end_are_read_once():
    import time

    start = time.time()
    H.blocks_of("<p>a</p><script>" + "</script " * 200_000)
    H.blocks_of("<template>" * 200_000)
    H.blocks_of("<p " + "a  " * 300_000 + "class=x>t")
    assert time.time() - start < 10
