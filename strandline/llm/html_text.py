"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements. First pass: a block under a boilerplate element or name is bad; one of many
links is bad; a long one rich in stop words is good; a long one poor in them is bad; the rest, the short ones, are
ambiguous. Second pass: an ambiguous block takes the label of its nearest decided neighbours within its own container
(article, main, section, or the page); where both sides disagree or none is decided, the container decides: an article or main
element keeps its blocks, others lose them. Inside article and main, a long block poor in stop words is ambiguous as well,
as nothing but its wording speaks against it; headings, list items, captions and formulas there may be all links.

Stop words are those of OTHER_STOPS' languages besides English, German, French and Spanish. A page none of whose long blocks is
rich in those of any language is in a language not listed: there long blocks of few links are good, whatever their words.
Scripts without spaces count two letters as a word.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Common function words, and names of elements.
STOP_WORDS = frozenset("""
the of and to in a is that for it with was on as are by this be from at or an not have has but they his her which you we
der die das und ist von den zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
le la les de des du et un une en que qui dans pour sur par est pas au plus avec ce se il elle ne sont ou aux
el los las y del que en un una por con no se su para es al lo como más o pero sus le ha son
""".split())
OTHER_STOPS = tuple(frozenset(words.split()) for words in (
    "il lo la i gli le di che e un una in con per non è sono si da del della dei delle nel nella al alla come più ma anche ha su",
    "o a os as de que e do da dos das em um uma para com não por mais se na no nas nos ao como mas foi ele ela é são",
    "de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij door was uit naar dan nog wordt",
    "och att det som en på är av för med den till inte har de ett om var jag men i sig från vi så kan när",
    "og det at en på er af som for med den til ikke har de et om var jeg men i sig fra vi så kan når å av",
    "i w na z do się nie to że jest o jak po co ale za od są przez dla był tak tym ten oraz być lub",
    "a v se na je že to s z do o i ve by si ale jako pro za po od jsou byl tak jeho které který nebo při",
    "ja on ei se että oli ovat mutta kun hän tai joka myös niin kuin sen ole voi jos sekä mukaan vain",
    "a az és hogy nem is egy ez de meg volt mint ha már csak azt el még van ki vagy szerint majd",
    "ve bir bu da de için ile olarak çok daha gibi olan ne var kadar o en ama sonra değil ya her olduğu",
    "și de la în a cu nu pe este o un care din că mai sau pentru ca au fost sunt se al ale prin",
    "и в не на я что он с как а то это по к но из у за от о для же так был его она они мы или при",
    "і в не на що з як та до у за від це про є але для його був або так бути при які який",
    "и на в се да не е от за с че са по като но то към при или до има който което",
    "και το να του η της με που την από για είναι ο οι τα στο των δεν στη τον θα ένα μια ότι στην",
    "في من على أن إلى عن التي الذي هذا هذه مع ما لا كان بين كما و أو قد بعد ذلك لم كل هو هي",
    "של את על לא הוא זה עם היא כי גם אל או אם היה יש כל אבל בין אני אשר",
    "yang dan di dari untuk dengan pada ini itu dalam tidak adalah oleh ke akan juga sebagai telah atau karena bisa ada",
    "là của và có các cho không được một trong với này những người đã đến khi từ về như để ở ra",
    "के में है की और से का को पर यह एक ने हैं कि भी था नहीं लिए हो इस तो कर",
))
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
SKIPPED = frozenset("head script style noscript template iframe svg math annotation annotation-xml object canvas select textarea button title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset figcaption".split())
BLOCKS = frozenset("""
address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_ITSELF = {"p": frozenset({"p"}), "li": frozenset({"li"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
                   "tr": frozenset({"tr", "td", "th"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
KEEPING = frozenset({"article", "main"})
LINKABLE = frozenset("h1 h2 h3 h4 h5 h6 li dt dd figcaption caption math".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|"
                    r"overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|"
                    r"sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|comment\w*|replies|disqus|"
                    r"respond|footer|header|masthead|copyright|skip|search|toolbar|tags)(?:$|[\s_-])", re.I)
_TOKENS = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<",
                     re.S)
_ATTRIBUTES = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

LONG = 10  # words from which a block is decided by its own wording
STOPS_HIGH, STOPS_LOW = 0.2, 0.08
LINKS_MOST = 0.4


class _Block:
    __slots__ = ("parts", "linked", "place", "bad", "linkable")

    def __init__(self, place: int, bad: bool, linkable: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.place = place
        self.bad = bad
        self.linkable = linkable


def _marked(name: str, attributes: str) -> bool:
    """Whether an element's own attributes name it boilerplate or hide it."""
    for key, *values in _ATTRIBUTES.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key in ("class", "id", "role") and _NAMES.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", value)):
            return name not in ("body", "html", "article", "main")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return False


def blocks(page: str) -> tuple[list[_Block], list[str]]:
    """Blocks of a page in order, and the element name of each container they refer to by number."""
    stack: list[tuple[str, int, bool, bool]] = []  # element, its container, boilerplate, skipped
    places = ["body"]
    found: list[_Block] = []
    current: _Block | None = None
    place, bad, skipped, links = 0, False, False, 0
    raw_end: str | None = None
    for token in _TOKENS.finditer(page):
        text = token.group()
        if raw_end is not None:
            if not (token.group(1) and token.group(2).lower() == raw_end):
                continue
            raw_end = None
        name = token.group(2)
        if name is None:
            if text[0] == "<" and len(text) > 1 or skipped:
                continue
            if current is None:
                if not text.strip():
                    continue
                current = _Block(place, bad, places[place] in KEEPING and any(n in LINKABLE for n, *_ in reversed(stack)))
                found.append(current)
            current.parts.append(text)
            if links:
                current.linked += len(_WORD.findall(text))
            continue
        name = name.lower()
        if name == "a":
            links = 0 if token.group(1) else 1
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            current, links = None, 0
        if token.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if any(stack[i][0] in BLOCKS for i in range(depth, len(stack))):
                    current = None
                del stack[depth:]
                _, place, bad, skipped = stack[-1] if stack else ("", 0, False, False)
            continue
        if name in VOID or text.endswith("/>") and name not in BLOCKS:
            continue
        if name in ENDED_BY_ITSELF and stack:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDED_BY_ITSELF[name]:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        _, place, bad, skipped = stack[-1] if stack else ("", 0, False, False)
        if name in BLOCKS or name in SKIPPED or _marked(name, token.group(3)):
            marked = _marked(name, token.group(3))
            inside = any(places[p] in KEEPING for p in (place,)) and name in ("header", "footer")
            kept = places[place] in KEEPING
            bad = bad or marked or name in BOILERPLATE and not (inside and name == "header" or kept and name == "figcaption")
            skipped = skipped or name in SKIPPED and not (kept and name == "math")
            if name in ("article", "main", "section") and not (places[place] in KEEPING and name == "section"):
                places.append(name)
                place = len(places) - 1
            if marked and name not in BLOCKS:
                current = None
            stack.append((name, place, bad, skipped))
            if name in RAW:
                raw_end = name
    return found, places


def _length(text: str, words: list[str]) -> int:
    """Words of a text; in scripts without spaces, two letters count as one."""
    unspaced = len(_UNSPACED.findall(text)) if not text.isascii() else 0
    return max(len(words), unspaced // 2)


def _first_pass(text: str, block: _Block, keeping: bool) -> tuple[bool | None, bool]:
    """The block's own label, and whether it is a long one of few links."""
    if block.bad:
        return False, False
    words = _WORD.findall(text.lower())
    if words and block.linked / len(words) > LINKS_MOST:
        return None if block.linkable else False, False
    if _length(text, words) < LONG:
        return None, False
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops < STOPS_HIGH:
        stops = max(stops, *(sum(w in other for w in words) / len(words) for other in OTHER_STOPS))
    if stops >= STOPS_HIGH:
        return True, True
    return False if stops < STOPS_LOW and not keeping else None, True


def main_text(page: str | None) -> str:
    found, places = blocks(page or "")
    texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in found]
    rows = [(t, b) for t, b in zip(texts, found) if t]
    passed = [_first_pass(t, b, places[b.place] in KEEPING) for t, b in rows]
    fits = any(label and long for label, long in passed)
    first = [True if long and not fits else label for label, long in passed]
    # Nearest decided label before and after, within the block's container; boilerplate elements decide nothing for others.
    def nearest(order) -> list[bool | None]:
        last: dict[int, bool] = {}
        out: list[bool | None] = [None] * len(rows)
        for i in order:
            b = rows[i][1]
            if first[i] is not None and not b.bad:
                last[b.place] = first[i]
            out[i] = last.get(b.place)
        return out

    before, after = nearest(range(len(rows))), nearest(range(len(rows) - 1, -1, -1))
    kept = []
    for i, (text, b) in enumerate(rows):
        label = first[i]
        if label is None:
            sides = {s for s in (before[i], after[i]) if s is not None}
            label = sides.pop() if len(sides) == 1 else places[b.place] in KEEPING
            if places[b.place] in KEEPING:
                label = True
        if label:
            kept.append(text)
    return "\n".join(kept)


def main_text_column(page: str = "html") -> Column:
    @pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages])
    return extract(F.col(page).cast("string"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty where nothing is kept), n_chars (code points of text).

    Null html is an empty page. Null ids and urls stay null, repeated rows are answered each, an empty table gives no rows,
    other columns are not read. The work is a map over the input's partitions.
    """
    return (pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                         main_text_column(page).alias("text"))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))
