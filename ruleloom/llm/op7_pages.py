"""Main text of web pages by site template removal.

Every page is read into a tree and its element subtrees are hashed. Spark counts, for each host, in how many different pages
each subtree stands; pages with the same body count once, so copies of an article do not make it a template. Subtrees on many
pages of the host, whatever its size, are deleted when the text is taken out, beside what HTML itself marks as no article: menus, headers,
footers, sidebars, forms, scripts, and elements named as adverts, notices, comments and the like.

Only containers are templates: a paragraph or heading alone is never deleted for recurring, as many articles may share a
passage. Inside the article element only plain containers (div, section) are counted, with a higher limit.

Null and empty pages have an empty text. Rows are taken as they are: repeated rows give repeated rows, null ids and urls stay
(pages without host are counted together). An empty table gives an empty one; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import pieces
from ruleloom.llm.html_tree import BLOCKS, Element, hashes, parse
from ruleloom.staging import stage

#: A subtree is a template if it stands in so many different pages of its host, and in this share of them or in MANY.
PAGES, SHARE, MANY = 3, 0.1, 20
#: The same for containers inside an article.
INNER_PAGES, INNER_SHARE, INNER_MANY = 10, 0.5, 40
#: Copies of a template, dealt out so that pages of a large host meet it in many tasks.
COPIES = 32

# What is no article, by tag, role, and the words of class and id.
TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog head title "
    "menu audio video map datalist input label fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|promoted|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|"
    r"subscri\w+|signup|login|share|sharing|social|breadcrumbs?|nav|navbar|navigation|menu|sidebar|side-bar|footer|masthead|site-header|"
    r"page-header|topbar|comments?|commentlist|respond|disqus|related|recommend\w*|widget|pagination|pager|skip-link|toolbar|paywall)(?:$|[\s_-])"
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
#: What can be a template: containers, and fewer of them inside an article. A recurring paragraph alone is none.
CONTAINERS = frozenset("div section ul ol dl table header nav footer aside form figure menu details center hgroup fieldset".split())
INNER_CONTAINERS = frozenset("div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def plain_boilerplate(element: Element, inside: bool) -> bool:
    """Whether HTML itself, or a name, marks the element as no article. inside: it stands inside an article."""
    if element.tag in TAGS or (element.tag == "header" and not inside):
        return True
    attributes = element.attributes
    if not attributes:
        return False
    if element.tag in ("html", "body", "article", "main"):
        return "hidden" in attributes
    return hidden(element) or attributes.get("role") in ROLES or any(NAMED.search(attributes.get(k, "")) for k in ("class", "id"))


def hidden(element: Element) -> bool:
    attributes = element.attributes
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def wraps_article(element: Element) -> bool:
    """Whether an element that counts as no article by its name, or as a form, is but a wrapper: an article or main stands in it."""
    if (element.tag in TAGS and element.tag != "form") or element.tag == "header" or element.attributes.get("role") in ROLES or hidden(element):
        return False
    stack = [c for c in element.children if not isinstance(c, str)]
    while stack:
        inner = stack.pop()
        if inner.tag in ("article", "main"):
            return True
        if inner.tag not in TAGS and not hidden(inner):
            stack.extend(c for c in inner.children if not isinstance(c, str))
    return False


def article_of(root: Element) -> Element | None:
    """The article: the outermost article or main element with the most text, if there is one."""
    found: list[Element] = []
    stack = [root]
    while stack:
        element = stack.pop()
        if plain_boilerplate(element, False) and not wraps_article(element):
            continue
        if element.tag in ("article", "main") or element.attributes.get("role") in ("article", "main"):
            found.append(element)
            continue
        stack.extend(c for c in element.children if not isinstance(c, str))
    if len(found) == 1 and found[0].tag == "main":
        return article_of_main(found[0])
    return max(reversed(found), key=lambda e: len("".join(blocks(e, frozenset(), {}))), default=None)


def article_of_main(main: Element) -> Element:
    inner = [c for c in main.children if not isinstance(c, str) and c.tag == "article"]
    return inner[0] if len(inner) == 1 else main


def blocks(top: Element, templates: frozenset[int], subtree: dict[int, int]) -> list[str]:
    """Text blocks below `top` in page order, without boilerplate and without template subtrees."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    inside = top.tag in ("article", "main")
    stack: list[Element | str | None] = [top]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif node is not top and (plain_boilerplate(node, inside) or (templates and _deleted(node, inside, templates, subtree))):
            if node.tag in BLOCKS:
                flush()
        elif node.tag == "header" and inside:
            flush()
            stack.append(None)
            stack.extend(reversed([c for c in node.children if not isinstance(c, str) and c.tag in HEADINGS | {"hgroup"}]))
        elif node.tag in BLOCKS:
            flush()
            stack.append(None)
            stack.extend(reversed(node.children))
        else:
            stack.extend(reversed(node.children))
    flush()
    return out


def _deleted(node: Element, inside: bool, templates: frozenset[int], subtree: dict[int, int]) -> bool:
    return node.tag in (INNER_CONTAINERS if inside else CONTAINERS) and subtree[id(node)] in templates


def main_text(html: str, templates: frozenset[int]) -> str:
    root = parse(html)
    subtree = hashes(root) if templates else {}
    return "\n\n".join(blocks(article_of(root) or root, templates, subtree))


def countable(html: str) -> tuple[int, set[int], set[int], set[int]]:
    """(hash of the page's own text, hashes of the subtrees that templates are sought in: outside and inside the article, hashes of
    other containers, which are no templates by standing here)."""
    root = parse(html)
    subtree = hashes(root)
    article = article_of(root)
    body = "\n".join(blocks(article or root, frozenset(), subtree))
    outer: set[int] = set()
    inner: set[int] = set()
    others: set[int] = set()
    stack: list[tuple[Element, bool, bool]] = [(c, False, True) for c in root.children if not isinstance(c, str)]
    while stack:
        element, inside, counts = stack.pop()
        if element.tag in ("script", "style", "head"):
            continue
        if element is article or element.tag in ("html", "body"):
            inside = inside or element is article
        elif counts and element.tag in (INNER_CONTAINERS if inside else CONTAINERS):
            (inner if inside else outer).add(subtree[id(element)])
        if element.tag in CONTAINERS:
            others.add(subtree[id(element)])
        counts = counts and not (inside and element.tag in PROSE)
        stack.extend((c, inside, counts) for c in element.children if not isinstance(c, str))
    number = int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return number, outer, inner, others - outer - inner


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_KEY = ["host", "row", "page"]
_LISTS = ["outer", "inner", "others"]


def _subtrees(keyed: DataFrame) -> DataFrame:
    """(host, row, page, body, outer, inner, others) of every page, as `countable` finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = list(zip(*[countable(html or "") for html in part.column("html").to_pylist()], strict=True))
                lists = [pa.array(map(list, column), pa.list_(pa.int64())) for column in found[1:]]
                yield pa.RecordBatch.from_arrays([*map(part.column, _KEY), pa.array(found[0], pa.int64()), *lists], [*_KEY, "body", *_LISTS])

    lists = ", ".join(f"{name} array<bigint>" for name in _LISTS)
    return keyed.select(*_KEY, "html").mapInArrow(run, f"host string, row long, page string, body long, {lists}")


def templates(found: DataFrame) -> DataFrame:
    """(host, subtree): subtrees on many different pages of each host, among all those of `_subtrees`."""

    def marks(name: str, inside: bool) -> Column:
        return F.transform(name, lambda h: F.struct(h.alias("subtree"), F.lit(inside).alias("inside")))

    # Null stands for the page as such, so one pass counts pages and subtrees.
    page = F.array(F.struct(F.lit(None).cast("long").alias("subtree"), F.lit(False).alias("inside")))
    seen = found.select("host", "body", F.explode(F.concat(page, marks("outer", False), marks("inner", True))).alias("mark"))
    counts = seen.select("host", "body", "mark.*").distinct().groupBy("host", "subtree", "inside").agg(F.count("*").alias("n"))
    totals = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("subtree").isNotNull() & (F.col("n") >= PAGES)).join(totals, "host")
    inner = F.greatest(F.lit(INNER_PAGES), F.least(F.col("pages") * INNER_SHARE, F.lit(INNER_MANY)))
    limit = F.when(F.col("inside"), inner).otherwise(F.least(F.col("pages") * SHARE, F.lit(MANY)))
    return often.where(F.col("n") >= limit).select("host", "subtree").distinct()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row.

    A page is handed the templates that stand in it only: those of a large host may be many.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.withColumn("host", host(F.col("url"))).withColumn("row", F.xxhash64("page_id", "url"))
    keyed = keyed.withColumn("page", F.md5(F.coalesce("html", F.lit(""))))
    found = stage(_subtrees(keyed), "page-subtrees")
    known = templates(found).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    held = found.select(*_KEY, F.pmod("row", F.lit(COPIES)).cast("int").alias("copy"), F.explode(F.concat(*_LISTS)).alias("subtree"))
    own = held.join(known, ["host", "copy", "subtree"]).groupBy(*_KEY).agg(F.sort_array(F.collect_set("subtree")).alias("templates"))
    joined = keyed.join(own, _KEY, "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                sets = [frozenset(t or ()) for t in part.column("templates").to_pylist()]
                out = [main_text(h or "", t) for h, t in zip(part.column("html").to_pylist(), sets, strict=True)]
                columns = [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
