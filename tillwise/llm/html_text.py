"""HTML extraction by template deduction from equivalence classes of tokens.

A page is read as a row of tokens: tags in their role (the path of structural elements with class
and id) and text nodes in their role.  Over the pages of a host each token has an occurrence
vector, its count per page.  Tokens with equal vectors form a class; vectors are compared by a
64-bit fingerprint (the exclusive or of hashes of page and count), so they are summed up like any
aggregate and no host is brought together.  A class is valid when it occurs on enough pages of
the host and its tokens nest: each role's parent role is in the same or another valid class.
Valid classes, nested by their paths, are the host's template.  Text nodes that belong to the
template, and the slots of menus, notices and the like, are left out; the remaining slots, in
page order, are the text.

The template of a host is bounded: only tokens on at least a fifth of its pages can enter it.
Pages of a host with the same html are one page in its vectors, however often they were fetched:
else all of a page that stands there five times would be its host's template.  Headings inside
an article stay, even where each article has them: they name the slots that follow.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillwise.llm.common import table
from tillwise.sources.shared import settle, sized

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)

#: Elements that hold no article text wherever they stand.
LEFT_OUT = frozenset(
    "nav footer aside form button select option input textarea script style noscript template iframe svg "
    "math head title menu dialog object embed canvas audio video map".split()
)
#: Words in a class, id or role that mark menus, headers, notices, adverts and reader comments.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notices|"
    r"popup|modal|overlay|sidebar|widget|menu|nav|navbar|navigation|navbox|breadcrumb\w*|masthead|topbar|"
    r"site-?header|page-?header|footer|copyright|comment|comments|disqus|respond|replies|reply|share|sharing|social|"
    r"related|recommend\w*|newsletter|subscribe|signup|login|search|skip\w*|pagination|pager|toolbar|"
    r"contentinfo|complementary|alert|dialog)(?:$|[\s_-]|\d)",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|main|post-?(?:body|content)|entry-?content|article-?body|story)(?:$|[\s_-])", re.I)

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WHITE = re.compile(r"\s+")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Share of a host's pages on which a token of the template must occur, and least pages.
SUPPORT = 0.2
LEAST_PAGES = 4


class Node:
    """An open structural element: name, role path, and what it says about text inside it."""

    __slots__ = ("name", "path", "out", "content")

    def __init__(self, name, path, out, content):
        self.name, self.path, self.out, self.content = name, path, out, content


_ROOT = Node("", "", False, False)


def read(page: str | None) -> Iterator[tuple]:
    """(kind, node, text): "tag" at each structural start tag, "text" at each text node,
    "break" between blocks.  Unclosed paragraphs and elements end where their parent ends."""
    stack = [_ROOT]
    links = 0
    at, page = 0, page or ""
    while at < len(page):
        m = _TAG.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            yield "text", stack[-1], page[at:start], links > 0
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if m[1] else 1
        if name in INLINE:
            continue
        if name == "br":
            yield "text", stack[-1], " ", links > 0
            continue
        yield "break", stack[-1], "", False
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P and stack[-1].name == "p" or name == stack[-1].name and name in ("li", "dt", "dd", "td", "th", "tr", "option"):
            stack.pop()
        up = stack[-1]
        said = " ".join(x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(m[3])) if m[3] else ""
        role = f"{up.path}>{name}" + (f".{'.'.join(said.split())}" if said else "")
        content = up.content or name in ("article", "main") or bool(said and CONTENT.search(said))
        out = up.out or name in LEFT_OUT or (name == "header" and not up.content)
        if not out and said and name not in ("html", "body") and MARKS.search(said):
            out = not (CONTENT.search(said) and name in ("article", "main"))
        node = Node(name, role, out, content)
        yield "tag", node, "", False
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            stack.append(node)


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _plain(text: str) -> str:
    return _WHITE.sub(" ", html.unescape(text)).strip()


def tokens(page: str | None) -> dict[int, list]:
    """Token hash to [role, parent role or "", is a text node, count, characters in links]."""
    found: dict[int, list] = {}
    for kind, node, text, linked in read(page):
        if kind == "tag":
            k, row = _key(node.path), [node.path, node.path.rpartition(">")[0], False, 0]
        elif kind == "text" and not text.isspace():
            k, row = _key(node.path, _plain(text)), [node.path, node.path, True, 0]
        else:
            continue
        found.setdefault(k, row)[3] += 1
    return found


def extract(page: str | None, constant: frozenset[int] = frozenset(), known: frozenset[int] = frozenset()) -> str:
    """The blocks of the slots that remain, without the ``constant`` text nodes of the template.

    If some element says that it holds the article, slots inside such elements; else all slots
    that no rule leaves out.  ``known`` are the template's roles: outside of such elements, text
    in them consisting of links only is a list of links, not prose.
    """
    chosen: list[list] = []
    current: list = []
    for kind, node, text, linked in read(page):
        if kind == "text":
            current.append((node, text, linked))
        elif current:
            chosen.append(current)
            current = []
    if current:
        chosen.append(current)
    marked = any(n.content and not n.out and not t.isspace() for block in chosen for n, t, _ in block)
    out = []
    for block in chosen:
        node = block[0][0]
        if node.out or (marked and not node.content):
            continue
        plain = _plain("".join(t for _, t, _ in block))
        if not plain:
            continue
        named = marked and node.name in HEADINGS
        if not named and all(_key(node.path, _plain(t)) in constant for _, t, _ in block if not t.isspace()):
            continue
        if not marked and _key(node.path) in known and all(linked for _, t, linked in block if not t.isspace()):
            continue
        out.append(plain)
    return "\n\n".join(out)


TOKENS = "host string, token bigint, role string, parent string, is_text boolean, pages bigint, print bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, page_id, page in zip(*(batch.column(c).to_pylist() for c in ("host", "digest", "html"))):
            for token, (role, parent, is_text, n) in tokens(page).items():
                mark = _key(str(page_id), str(n))
                row = sums.setdefault((host, token), [role, parent, is_text, 0, 0])
                row[3] += 1
                row[4] ^= mark
        rows = [(h, t, *r) for (h, t), r in sums.items()]
        columns = list(zip(*rows)) or [()] * 7
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["host", "token", "role", "parent", "is_text", "pages", "print"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def with_host(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` and the host of the url ("" without one)."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return pages.select("page_id", "url", "html", host.alias("host"))


def different_pages(hosted: DataFrame) -> DataFrame:
    """``host``, ``digest`` and ``html`` of the pages, those of one host and html once.

    Only pages that stand there several times are shuffled, and these are reduced first.
    """
    html_of = F.coalesce(F.col("html"), F.lit(""))
    keyed = hosted.select("host", F.md5(html_of.cast("binary")).alias("digest"), html_of.alias("html"))
    repeated = keyed.groupBy("host", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = sized(settle(repeated.select("host", "digest")))
    alone = keyed.join(repeated, ["host", "digest"], "left_anti")
    several = keyed.join(repeated, ["host", "digest"], "left_semi")
    return alone.unionByName(several.groupBy("host", "digest").agg(F.first("html").alias("html")))


def templates(pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per host: ``roles`` and ``constants``, token hashes of valid classes.

    A class of tags is valid when on enough pages and when the parent role of each of its roles
    is on enough pages too.  A class of text nodes is valid when its vector equals that of a
    class of tags: it then occurs just where that part of the template does.
    """
    hosted = different_pages(with_host(pages))
    counted = hosted.mapInArrow(_count, TOKENS)
    counted = counted.groupBy("host", "token", "role", "parent", "is_text").agg(
        F.sum("pages").alias("pages"), F.bit_xor("print").alias("print")
    )
    totals = hosted.groupBy("host").agg(F.count("*").alias("on_host"))
    totals = settle(totals.select(F.col("host").alias("__host"), "on_host"))
    often = counted.join(totals, F.col("host") == F.col("__host")).drop("__host")
    often = settle(
        often.filter((F.col("on_host") >= least_pages) & (F.col("pages") >= F.col("on_host") * support))
    )
    tags = often.filter(~F.col("is_text"))
    parents = tags.select(F.col("host").alias("__host"), F.col("role").alias("__role"))
    nested = tags.join(
        parents, (F.col("host") == F.col("__host")) & (F.col("parent") == F.col("__role")), "left"
    ).withColumn("nests", F.col("__role").isNotNull() | (F.col("parent") == ""))
    classes = nested.groupBy("host", "print").agg(
        F.min("nests").alias("valid"), F.collect_list("token").alias("of_class")
    )
    valid = classes.filter("valid").select("host", "print", "of_class")
    texts = often.filter("is_text").select(F.col("host").alias("__host"), F.col("print").alias("__print"), "token")
    held = valid.join(
        texts, (F.col("host") == F.col("__host")) & (F.col("print") == F.col("__print")), "left"
    )
    per_class = held.groupBy("host", "print").agg(
        F.first("of_class").alias("of_class"), F.collect_list("token").alias("texts")
    )
    return per_class.groupBy(F.col("host").alias("of_host")).agg(
        F.flatten(F.collect_list("of_class")).alias("roles"),
        F.flatten(F.collect_list("texts")).alias("constants"),
    )


def main_text(pages: DataFrame, **options) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page.

    Null html gives "".  Pages without a host share the host "".  Hosts with fewer than
    ``least_pages`` pages have no template: their pages are read by the element rules alone.
    Pages of one host with the same html count as one; each still gets its text.  Other columns
    are not read.
    """
    found = sized(settle(templates(pages, **options)))
    hosted = with_host(pages)
    joined = hosted.join(found, F.col("host") == F.col("of_host"), "left")
    narrow = joined.select("page_id", "url", "html", "of_host", "roles", "constants")
    schema = StructType(
        [narrow.schema["page_id"], narrow.schema["url"], StructField("text", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            roles, constants = batch.column("roles"), batch.column("constants")
            texts = []
            for i, (host, page) in enumerate(zip(batch.column("of_host").to_pylist(), batch.column("html").to_pylist())):
                if host not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[host] = tuple(frozenset(c[i].as_py() or ()) for c in (constants, roles))
                texts.append(extract(page, *kept[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return narrow.mapInArrow(run, schema)


def op3_template_extract(spark, folder):
    texts = main_text(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
