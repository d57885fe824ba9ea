from strandline.llm import html_text
from tests.llm.conftest import prose

LONG = ("The house by the river was never as quiet as on that morning, and the people of the street were walking to the bridge "
        "in the green light of the forest.")


def page(inner, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{inner}</body></html>"


def test_article_without_surroundings():
    html = page(f"""<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-banner">We use
      cookies and the rest of it is for you to accept as it was in the past of the web</div><!-- ad --><aside><p>{LONG}</p></aside>
      <article><h1>A   short&nbsp;title</h1><p>{LONG}<p>Tom &amp; Ann&#33;</p><ul><li>one</li><li>two</li></ul>
      <div class="ad">Buy the thing of the day now and be the first of all to have it in the house</div>
      <script>var t = "</p><p>no</p>";</script><form><p>{LONG}</p><input name=q></form>
      <section id="comments"><p>{LONG}</p></section></article><footer>&copy; {LONG}</footer>""")
    assert html_text.main_text(html) == f"A short title\n{LONG}\nTom & Ann!\none\ntwo"


def test_density_rules_without_article_element():
    links = " ".join(f'<a href="{i}">link {i}</a>' for i in range(12))
    html = page(f"<div>{links}</div><div>Menu one two</div><div id=text><h2>Heading</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
                f"<div>{'word ' * 30}</div><div>tail</div><div>{links}</div>")
    assert html_text.main_text(html).split("\n")[-3:] == [LONG, "Short one.", LONG]
    assert "word word" not in html_text.main_text(html) and "link" not in html_text.main_text(html)
    assert "tail" not in html_text.main_text(html).split("\n")


def test_truncated_and_broken_pages():
    assert html_text.main_text(f"<article><p>{LONG}<p>and the <b>end") == f"{LONG}\nand the end"
    assert html_text.main_text(f"<article><p>{LONG}</p><scr") == LONG
    assert html_text.main_text(f"<article><p>{LONG}</p><script>x = 1") == LONG
    assert html_text.main_text(f"<article><p>a < b and</p></article></div></p>") == "a < b and"
    assert html_text.main_text("<article><p hidden>no</p><p>a<br>b</p></article>") == "a b"


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", page(f"<main>{'<p>' + LONG + '</p>'}</main>" * 1)),
            (3, "u", page(f"<main><p>{LONG}</p></main>")), (4, "u", "<main>" + "<p>" + prose("en", 20_000, 1) + "</p></main>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert [r["page_id"] for r in out] == [1, 2, None, 3, 3, 4] and [r["text"] for r in out[:2]] == ["", ""]
    assert out[3]["text"] == out[4]["text"] == LONG and out[3]["n_chars"] == len(LONG) and out[5]["text"] == prose("en", 20_000, 1)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_in_other_languages_without_article():
    polish = "Dom nad rzeką nie był nigdy tak cichy jak tego ranka, a ludzie z ulicy szli do mostu w zielonym świetle lasu."
    swahili = "Nyumba kando mto haikuwahi kuwa kimya kama asubuhi hiyo, watu mtaani walitembea kuelekea daraja katika mwanga kijani msitu."
    chinese = "河边的房子从来没有像那天早上那样安静，街上的人们在森林的绿光中向桥走去，孩子们在花园里读信。"
    links = " ".join(f'<a href="{i}">link {i}</a>' for i in range(12))
    for text in (polish, swahili, chinese):
        html = page(f"<div>{links}</div><div><h2>Heading</h2><p>{text}</p><p>Short one.</p><p>{text}</p></div><footer>{text}</footer>")
        assert html_text.main_text(html).split("\n")[-3:] == [text, "Short one.", text], text
        assert "link" not in html_text.main_text(html)


def test_linked_headings_items_captions_and_formulas_of_an_article():
    math = '<math><semantics><mi>x</mi><annotation encoding="application/x-tex">\\x</annotation></semantics></math>'
    inner = (f'<h1><a href="#">Title</a></h1><p>{LONG}</p><ul><li><a href="a">First item</a></li></ul>'
             f'<figure><img src="i"><figcaption>A caption</figcaption></figure><p>Where {math} is')
    assert html_text.main_text(page(f"<article>{inner}</article>")) == f"Title\n{LONG}\nFirst item\nA caption\nWhere x is"
    assert "First item" not in html_text.main_text(page(f"<article><p>{LONG}</p><nav><ul><li><a>First item</a></li></ul></nav></article>"))
