"""Pages with known articles, and hostile pages."""

import random
import time

import pytest

pytest.importorskip("weftline.llm.html_text")

from weftline.llm.html_text import main_text  # noqa: E402

MENU = "<nav><a href=/>Home</a> <a href=/b>Blog</a></nav>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8)) + "</ul>"
PARTS = [f"Sentence {i} of the article is long enough to be read as running text, as articles have it." for i in range(6)]
PARAS = "".join(f"<p>{t}</p>" for t in PARTS)
BODY = "\n\n".join(PARTS)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<div>{}</div>", "<form>{}</form>", "<div class='layout has-sidebar'>{}</div>"])
@pytest.mark.parametrize(
    "head", ["<div class='article-header'><h1>Head</h1></div>", "<h1 class='entry-header'>Head</h1>", "<div class='form-factor'>Head</div>", "<section id='related-work'>Head</section>", "<p>He<i>a</i>d</p>", "<p><math><mi>Head</mi></math></p>"]
)
def test_marks_that_name_article_parts_drop_nothing(wrap, head):
    page = f"<html><body>{MENU}{wrap.format(head + PARAS)}<div class='ad'>Buy now, it is cheap.</div><footer>Imprint</footer></body></html>"
    assert main_text(page) == "Head\n\n" + BODY


MORE = "<p>" + "A reader wrote this, at some length, and meant it as well. " * 3 + "</p>"


@pytest.mark.parametrize(
    "extra",
    [
        "<p class=notice>Mind this.</p>", f"<section class='comment-list'><div class='comment'>{MORE}</div><div class='comment'>{MORE}</div></section>", f"<div id='comment-section'>{MORE}</div>",
        f"<ol class='commentlist'><li>{MORE}</li></ol>", f"<div class='related'><h3>Related</h3>{LINKS}</div>", f"<div class=replies>{MORE}</div>", "<div class='ad-box'>Buy a thing, it is really cheap and good, and you will like it.</div>",
        "<section class=comments><p>First!</p></section>", f"<aside>{MORE}</aside>",
    ],
)
def test_what_is_no_article_goes_from_within_it(extra):
    """The contract leaves notices out, inside an article too."""
    for page in (f"<article>{extra}{PARAS}</article>", f"<article>{PARAS}{extra}</article>", f"<main><h1>Head</h1>{PARAS}{extra}</main>"):
        assert main_text(f"<html><body>{MENU}{page}</body></html>").removeprefix("Head\n\n") == BODY, page


def test_several_articles_stay_and_teasers_go():
    other = PARAS.replace("Sentence", "Phrase")
    both = BODY + "\n\n" + BODY.replace("Sentence", "Phrase")
    assert main_text(f"<body>{MENU}<article>{PARAS}</article><article>{other}</article></body>") == both
    assert main_text(f"<body><main><article>{PARAS}</article><div><article>{PARAS}</article></div></main></body>") == BODY + "\n\n" + BODY
    assert main_text(f"<body><article>{PARAS}</article><article><a href=/x>Another story</a><p>Read it.</p></article></body>") == BODY


LAYOUTS = [
    "<div class='col-left'><p>Weather today: sun, some clouds.</p><p>Opening hours</p></div><div class='col-main'>{}</div>", "<table><tr><td class=left>Hot topics of the week</td><td>{}</td></tr></table>", "<div id=page><div>{}</div><div class=rail>Popular now and then</div></div>",
    "<div><span>12 March</span></div><section>{}</section>", "<header><p>A paper for all</p></header><div>{}</div><footer><p>Imprint</p></footer>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_columns_before_the_headline_go(layout):
    assert main_text(f"<html><body>{MENU}{layout.format('<h1>Head</h1>' + PARAS)}</body></html>") == "Head\n\n" + BODY


def test_a_tag_cut_off_by_the_end_is_no_text():
    long = "x" * 9000
    for tail in (f"<a title='{long}", f"<!-- {long}", "<", "</p", f"<p class={long}"):
        assert main_text(f"<article>{PARAS}{tail}") == BODY, tail[:9]
    assert main_text(f"<script><!-- {long} </script><article>{PARAS}<p>1 &lt; 2 and 3 < 4</p></article>") == BODY + "\n\n1 < 2 and 3 < 4"


def test_empty_tables_and_pages(spark):
    from weftline.llm.html_text import extract

    kind = "page_id long, url string, html string"
    assert extract(spark.createDataFrame([], kind)).collect() == []
    assert [(r.text, r.n_chars) for r in extract(spark.createDataFrame([(None, None, None), (1, "u", "")], kind)).collect()] == [("", 0)] * 2


def test_short_sibling_containers_stay_and_link_lists_go():
    assert main_text(f"<body>{LINKS}<div>{PARAS}</div><div>A short one.</div>{LINKS}</body>") == BODY + "\n\nA short one."


def test_generated_pages_with_known_articles():
    rng = random.Random(3)
    for _ in range(60):
        said = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 60))) for _ in range(rng.randrange(1, 9))]
        blocks = "".join(f"<{t}>{x.replace('w1', '<b>w1</b>', 1)}</{t}>" for x in said for t in [rng.choice(("p", "div", "blockquote", "h2"))])
        noise = [MENU, "<aside>See also this and that</aside>", "<div id=cookie-notice>We use cookies.</div>", "<script>x='<p>no</p>'</script>", "<form><input><label>Mail</label></form>", "<footer>All rights</footer>"]
        rng.shuffle(noise)
        assert main_text("<html><body>" + "".join(noise[:3]) + f"<article>{blocks}</article>" + "".join(noise[3:]) + "</body></html>") == "\n\n".join(said)


@pytest.mark.parametrize("unit", ["<div><p>", "<ul><li><div>x y", "<section class=ad><article>x y", "<b>", "</p>", "<table><tr><td>x"])
def test_time_is_linear_in_unclosed_tags(unit):
    took = []
    for n in (4000, 16000):
        start = time.process_time()
        main_text(unit * n + "text")
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 1
