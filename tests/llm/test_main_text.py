import random

import pytest

from tardy.llm import main_text as M

TAGS = {"p": -1.0, "/p": -1.0, "h1": -1.0, "/h1": -1.0, "b": -1.0, "br": -1.0, "a": -6.0, "/a": -6.0, "li": -6.0, "/li": -6.0, "div": -5.0, "/div": -5.0}


def read(page, word=6.0):
    return M.extract(page, word, TAGS)


def test_parts_are_left_out():
    body = "One two three four five six. " * 3
    page = (
        "<!DOCTYPE html><html><head><title>Not me at all</title><style>p{x:y}</style><script>var t='</p><p>words and words</p>';</script></head><body>"
        "<header class=site>Site name and slogan</header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use many cookies on this and that page, please agree to it</p></div>"
        "<div id=wrap class='has-sidebar'><article><header class='entry-header'><h1>Head &amp; line</h1></header><p>"
        + body
        + "<b>bo</b>ld &lt;b&gt; x<br>y</p><aside><p>Side text of some words</p></aside><!-- a comment --><p>Second\n\t para&nbsp;graph &copy;</p>"
        "<form><input name=q><button>Send</button>Your mail</form><div class='ad'>Buy buy buy buy</div><p>Last.</p></article></div>"
        "<section id='comments'><p>Reader: what a very fine text this is, I like it so much</p></section>"
        "<div class=sidebar><p>Other pages you may want to read some day or other</p></div><footer>&copy; Site</footer></body></html>"
    )
    assert read(page) == "\n\n".join(["Head & line", body.strip() + " bold <b> x y", "Second para graph ©", "Last."])


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("no markup  at\nall", "no markup at all"),
        ("<p>a < b &am c &unknown; 3 <3</p>", "a < b &am c &unknown; 3 <3"),
        ("<p>cut <b>short <a href='x", "cut short"),
        ("<p>kept</p><!-- never closed <p>lost</p>", "kept"),
        ("<p>kept</p><script>never closed <p>lost</p>", "kept"),
        ("<footer>open <article><p>found</p></article>", "found"),
        ("<p>text</p><footer>open to the end", "text"),
        ("<div class='banner'><article><p>inside a banner</p></article></div>", "inside a banner"),
        ("<p title='a > b' class=\"x>y\">quoted</p>", "quoted"),
        ("<p title='odd>one two three</p>", "one two three"),
        ("<P>UP</P><BR/><p hidden>gone gone gone</p>", "UP"),
        ("<ul><li>a</li></ul>", "a"),
        ("<nav>only a menu</nav>", ""),
        ("&amp;amp; &#65;&#x42;&#xD800;", "&amp; AB�"),
    ],
)
def test_edges(page, text):
    assert read(page, 20.0) == text


def test_region_is_the_maximum_of_all(spark):
    rnd = random.Random(1)
    for _ in range(200):
        page = [M.Token(rnd.choice(["", "p", "a", "div"]), "", rnd.random() < 0.5, False, rnd.randrange(4)) for _ in range(rnd.randrange(14))]
        page = [t if not t.name else t._replace(words=0) for t in page]
        score = [TAGS.get(M._key(t), -1.0) if t.name else 2.0 * t.words for t in page]
        sums = {(i, j): sum(score[i:j]) for i in range(len(page)) for j in range(i + 1, len(page) + 1)}
        top = max(sums.values(), default=0.0)
        start, end = M.best_region(page, 2.0, TAGS)
        assert sums.get((start, end), 0.0) == max(top, 0.0)


def test_links_lose_against_words():
    links = "".join(f"<li><a href=x>link number {i}</a></li>" for i in range(40))
    text = "A text of words that goes on for a while. " * 4
    assert read(f"<div><ul>{links}</ul></div><div><p>{text}</p></div><div><ul>{links}</ul></div>", 4.0) == text.strip()


def test_weights_come_from_labelled_pages(spark):
    text = "words of the text " * 12
    page = "<ul><li><a href=x>{}</a></li><li>b</li></ul><div>short line</div><article><h1>Head {}</h1><p>" + text + "</p><p>one</p></article><div>end line</div>"
    rows = [(i, "u", page.format(i, i), 1) for i in range(30)] + [(None, None, None, 2), (5, "", "", 3), (5, "", "", 3)]
    unlabelled = page.replace("article", "section").format(7, 7)
    df = spark.createDataFrame([*rows, (99, "v", unlabelled, 4)], "page_id bigint, url string, html string, text int").repartition(3)
    word, tags = M.fit_weights(df)
    assert tags["p"] == tags["/p"] == -1.0 and tags["div"] < -4 and tags["li"] < -4 and word >= 2.0
    got = M.extract_main_text(df, ["page_id", "url"], word, tags).collect()
    want = "\n\n".join(["Head {}", text.strip(), "one"])
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted(
        [(i, want.format(i), len(want.format(i))) for i in range(30)] + [(0, "", 0), (5, "", 0), (5, "", 0), (99, want.format(7), len(want.format(7)))]
    )
    nothing = df.limit(0)
    assert M.extract_main_text(nothing, ["page_id", "url"], *M.fit_weights(nothing)).count() == 0


def test_long_and_hostile_pages():
    assert read("<p>w</p>" * 30000, 20.0).count("w") == 30000
    for s in ("<a '", "<nav>", "<!--", "<script>", "</", "<div class='ad'>", "<a href=\"x>", "<form><article>"):
        read(s * 5000)
