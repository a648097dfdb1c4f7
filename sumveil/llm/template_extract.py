"""Main text of web pages by equivalence classes of tokens over same-host pages.

A page is a sequence of tokens: opening tags, told apart by their path in the page, and
text blocks at their path.  Two tokens of a host belong together if they occur equally
often in each of its pages.  Pages of a host whose text blocks are the same, leaving out
those that markup names as noise, are copies of one article and count as one page, so
copies cannot vote their own text into the template.  Such occurrence vectors are never gathered: a token's
vector is represented by its number of pages, its occurrences and a sum of hashes of
(page, occurrences), all of them partial aggregates, so the largest host is spread over
all tasks.  A class is valid if it holds tags and covers half of the host's pages; classes
nest as the paths of their tags do.  Valid classes make the host's
template.  What a page has beside it fills the template's slots.  Text that belongs to
a class of tags is boilerplate; slots are dropped if the markup names them as
navigation, header, footer, sidebar, notice, advert, form or comments, or if on the
host most of their characters are links; the other slots are the article.
Pages and templates are joined by host and one of ``PARTS`` parts, so a hot host is split.

A template has at most twice as many tokens as an average page of its host, however
many pages there are.  Hosts with few different pages are judged by markup alone.

Null or empty html gives an empty text, a null url the host ''.  Equal rows give equal
results.  An empty table gives no row.  Whole pages are read, however long.
Only page_id, url and html are read; other columns
may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

#: Share of a host's pages that a template class covers, and the fewest pages.
SHARE, FEWEST = 0.5, 3
#: A host's pages meet its template in so many parts, so no task reads a whole host.
PARTS = 32
#: A class of tags needs so many tokens.
TOKENS = 3
#: Share of a slot's characters in links above which it is navigation.
LINKED = 0.5

#: A tag's rest. Quotes count after "=" only; possessive, so a page is read once from left to right.
_REST = r"(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>"
_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)" + _REST)
#: Elements whose content is never text of the page.
_RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style template svg iframe noscript object canvas title textarea".split()}
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A block that starts inside a paragraph ends it.
_ENDS_P = _BLOCKS - {"button", "option", "select"}
_NOISE_TAGS = frozenset("nav footer aside form button select menu dialog fieldset search head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination sidebar aside rail widget footer masthead topbar toolbar comment comments disqus replies reply "
    "related recommended share sharing social newsletter subscribe subscription signup login search skip".split()
)
_MAIN_NAMES = frozenset("article content entry main post story body text".split())
#: What follows these in a compound name is a feature of the layout, not what the element holds.
_MODIFIERS = frozenset("has with without no".split())
#: Names that mark noise in any compound and however much text they hold.
_CERTAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer comment comments disqus replies reply".split()
)
#: Share of a page's unlinked text from which an element with the page's headline is a wrapper, whatever its name.
_WRAPPER = 0.5


class _Open:
    """An open element: ``marked`` by its tag or role; ``named``, the number of the innermost
    element whose name marks it (-1: none); its path as a digest, so deep pages cost no more."""

    __slots__ = ("tag", "path", "marked", "named", "main")

    def __init__(self, tag, path, marked, named, main):
        self.tag, self.path, self.marked, self.named, self.main = tag, path, marked, named, main


def _names_noise(names: str) -> tuple[bool, bool]:
    """Whether classes and ids mark noise, and whether they do so for certain."""
    noise = certain = False
    for name in names.split():
        pieces = [p.lower() for p in _NAME.findall(name)]
        pieces = pieces[: next((i for i, p in enumerate(pieces) if p in _MODIFIERS), len(pieces))]
        sure = not _CERTAIN_NAMES.isdisjoint(pieces)
        if pieces and pieces[-1] in ("main", "article") and not sure:
            return False, False
        noise |= not _NOISE_NAMES.isdisjoint(pieces) or "header" in pieces and _MAIN_NAMES.isdisjoint(_NAME.findall(names.lower()))
        certain |= sure
    return noise, certain


def _opened(tag: str, attrs: str, above: _Open | None, roots: list) -> _Open:
    marked, main, label = above is not None and above.marked, above is not None and above.main, tag
    named = above.named if above is not None else -1
    values = {}
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            values.setdefault(name.lower(), value.strip("\"'"))
    names = f"{values.get('class', '')} {values.get('id', '')}"
    pieces = {p.lower() for p in _NAME.findall(names)}
    if pieces:
        label = tag + "." + "-".join(sorted(pieces))
    role = values.get("role", "").lower()
    if tag == "main" or role == "main":
        # The page's own word for its main part outweighs names and tags around it.
        main, marked, named = True, False, -1
    elif tag == "article" or role == "article":
        main = True
    if pieces and tag not in ("html", "body", "article", "main"):
        noise, certain = _names_noise(names)
        if noise:
            roots.append([certain, 0, False, named])
            named = len(roots) - 1
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I)
    if hidden or tag in _NOISE_TAGS or role in _NOISE_ROLES or (tag == "header" and not main):
        marked = True
    path = hashlib.blake2b(f"{above.path if above is not None else ''}/{label}".encode(errors="surrogatepass"), digest_size=12).hexdigest()
    return _Open(tag, path, marked, named, main)


def _pieces(html: str):
    """(text before, closing, tag, attributes) of every tag, one pass; the last has no tag.

    Comments and raw elements are left out.  What begins like a tag and never ends is no
    text, as in browsers.
    """
    at = start = 0
    parts: list[str] = []
    while (at := html.find("<", at)) >= 0:
        following = html[at + 1 : at + 2]
        if following in ("!", "?") or following == "/" and not html[at + 2 : at + 3].isalpha():
            comment = html.startswith("<!--", at)
            end = html.find("-->" if comment else ">", at + 2)
            parts.append(html[start:at])
            at = start = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        if not (following.isascii() and following.isalpha() or following == "/"):
            at += 1
            continue
        m = _TAG.match(html, at)
        parts.append(html[start:at])
        if m is None:
            if following != "/" or html[at + 2 : at + 3].isascii():
                start = len(html)
                break
            parts.append("<")  # not a tag name
            at = start = at + 1
            continue
        at = start = m.end()
        tag = m["tag"].lower()
        if tag in _RAW and not m["close"]:
            if not m["attrs"].endswith("/") or tag != "svg":
                end = _RAW[tag].search(html, at)
                at = start = len(html) if end is None else end.end()
            continue
        yield "".join(parts), m["close"], tag, m["attrs"]
        parts.clear()
    parts.append(html[start:])
    yield "".join(parts), "", "", ""


def parse(html: str) -> tuple[list[str], list[tuple[str, str, int, bool, bool]]]:
    """(paths of opening block tags in order, blocks): a block is (path, text, characters in
    links, marked as noise, inside the main element).

    Names mark an element as noise, but not one that holds the headline and half of the
    page's unlinked text, unless the name is certain.
    """
    stack: list[_Open] = []
    opened: Counter = Counter()
    tags: list[str] = []
    blocks: list[tuple] = []
    roots: list[list] = []
    parts: list[str] = []
    linked, link, direct = 0, -1, False  # depth of the open link, and whether it holds text of its own

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else None
                n = min(linked, len(text))
                if top is None:
                    blocks.append(("", text, n, False, -1, False))
                else:
                    blocks.append((top.path, text, n, top.marked, top.named, top.main))
                    if top.named >= 0:
                        roots[top.named][1] += len(text) - n
                        roots[top.named][2] |= top.tag == "h1"
            parts.clear()
        linked = 0

    for text, close, tag, attrs in _pieces(html):
        if text:
            parts.append(text)
            if link >= 0:
                linked += len(text)
                direct |= link == len(stack) and not text.isspace()
        if tag == "br":
            flush()
        elif tag == "a":
            link, direct = -1 if close or "href" not in attrs.lower() else len(stack), False
        elif tag not in _BLOCKS:
            continue
        elif close:
            flush()
            while opened[tag]:
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
        else:
            flush()
            if link == len(stack) and direct:
                link = -1  # a link with text of its own was never closed
            if stack and (stack[-1].tag in _CLOSES.get(tag, ()) or stack[-1].tag == "p" and tag in _ENDS_P):
                opened[stack.pop().tag] -= 1
            now = _opened(tag, attrs, stack[-1] if stack else None, roots)
            if tag not in _VOID:
                stack.append(now)
                opened[tag] += 1
                tags.append(now.path)
        if link > len(stack):
            link = -1  # nor does a link outlast the block it is in
    flush()
    total = sum(len(text) - n for _, text, n, _, _, _ in blocks)
    for _, n, headline, above in reversed(roots):  # an element comes after those around it
        if above >= 0:
            roots[above][1] += n
            roots[above][2] |= headline
    noisy: list[bool] = []
    for certain, n, headline, above in roots:
        noisy.append(certain or not headline or n <= _WRAPPER * total or above >= 0 and noisy[above])
    return tags, [(path, text, n, marked or named >= 0 and noisy[named], main) for path, text, n, marked, named, main in blocks]


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


_TOKENS = "host string, token long, is_tag boolean, slot long, pages long, hits long, vector decimal(38,0), chars long, linked long"
_ARROW = pa.schema(
    [
        ("host", pa.string()), ("token", pa.int64()), ("is_tag", pa.bool_()), ("slot", pa.int64()), ("pages", pa.int64()), ("hits", pa.int64()),
        ("vector", pa.decimal128(38, 0)), ("chars", pa.int64()), ("linked", pa.int64()),
    ]
)


def _token_rows(batches):
    """Partial aggregates of a batch: one row per host and token, and one per host and slot."""
    from decimal import Decimal

    for batch in batches:
        found: dict[tuple, list] = {}
        for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
            tags, blocks = parse(html or "")
            counts: Counter = Counter((_hash(path), True, 0) for path in tags)
            slots = set()
            for path, text, links, _, _ in blocks:
                slot = _hash("slot", path)
                counts[_hash(path, text), False, slot] += 1
                entry = found.setdefault((host, slot, None, slot), [0, 0, 0, 0, 0])
                entry[0] += slot not in slots
                entry[3] += len(text)
                entry[4] += links
                slots.add(slot)
            for key, n in counts.items():
                entry = found.setdefault((host, *key), [0, 0, 0, 0, 0])
                entry[0] += 1
                entry[1] += n
                entry[2] += _hash(page, n)
        rows = [(*k, *v[:2], Decimal(v[2]), *v[3:]) for k, v in found.items()]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000]), _ARROW.types, strict=True)], schema=_ARROW)


def _articles(batches):
    """Per page: host, page and a hash of its text blocks that are not marked as noise."""
    for batch in batches:
        article = [_hash("article", *(b[1] for b in parse(html or "")[1] if not b[3])) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(article, pa.int64())], ["host", "page", "article"])


def distinct_articles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of ``rows(host, page, html)`` for each article of a host, and per host the number n of articles."""
    pages = rows.mapInArrow(_articles, "host string, page long, article long").groupBy("host", "article", "page").agg(F.count("*").alias("rows"))
    pages = materialize(pages, "template-pages")
    kept = pages.groupBy("host", "article").agg(F.count("*").alias("pages"), F.min(F.struct("page", "rows")).alias("kept"))
    hosts = kept.groupBy("host").agg(F.count("*").alias("n"))
    # Pages beside the kept ones are few as a rule, and no page moves for the others.
    again = kept.filter((F.col("pages") > 1) | (F.col("kept.rows") > 1)).select("host", "article", F.col("kept.page").alias("first"))
    again = materialize(pages.join(again, ["host", "article"]).select("host", "page", (F.col("page") == F.col("first")).alias("is_first"), "rows"), "template-copies")
    found = rows.join(again, ["host", "page"], "left").filter("is_first is null or is_first")
    single = found.filter("rows is null or rows = 1").select("host", "page", "html")
    return single.unionByName(found.filter("rows > 1").select("host", "page", "html").dropDuplicates(["host", "page"])), hosts


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, share: float = SHARE, fewest: int = FEWEST) -> DataFrame:
    """Per host: ``constants``, hashes of texts that are part of the template, and ``links``,
    hashes of slots that hold links."""
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    rows, articles = distinct_articles(rows)
    partial = rows.mapInArrow(_token_rows, _TOKENS)
    total = lambda c: F.sum(c).alias(c)
    tokens = materialize(partial.groupBy("host", "token", "is_tag", "slot").agg(*map(total, ("pages", "hits", "vector", "chars", "linked"))), "template-tokens")
    hosts = articles.filter(F.col("n") >= fewest)
    common = tokens.filter(F.col("pages") >= fewest).join(hosts, "host").filter(F.col("pages") >= share * F.col("n"))
    classes = common.filter("is_tag is not null").groupBy("host", "pages", "hits", "vector").agg(F.count("*").alias("size"), F.count_if("is_tag").alias("tags"))
    valid = classes.filter((F.col("size") >= TOKENS) & (F.col("tags") >= TOKENS - 1)).drop("size", "tags")
    constants = common.filter("not is_tag").join(valid, ["host", "pages", "hits", "vector"], "left_semi").groupBy("host").agg(F.collect_list("token").alias("constants"))
    spread = common.filter("is_tag is null").filter((F.col("linked") > LINKED * F.col("chars")) & (F.col("chars") > 0))
    linked = spread.groupBy("host").agg(F.collect_list("token").alias("links"))
    return constants.join(linked, "host", "full_outer")


def text_of(html: str, constants=frozenset(), links=frozenset()) -> str:
    """Main text of one page under its host's template."""
    blocks = parse(html)[1]
    good = []
    for path, text, linked, noise, main in blocks:
        if noise or (constants and _hash(path, text) in constants):
            continue
        if not main and (linked > LINKED * len(text) or (links and _hash("slot", path) in links)):
            continue
        good.append((text, main))
    if any(m for _, m in good):
        good = [x for x in good if x[1]]
    return "\n".join(t for t, _ in good)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if there is none) and n_chars."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    model = templates(pages).select(F.col("host").alias("_host"), "constants", "links", part.alias("_part"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).alias("part"))
    rows = rows.join(model, (F.col("host") == F.col("_host")) & (F.col("part") == F.col("_part")), "left")

    def run(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for host, html, constants, links in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "constants", "links")), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(constants or ()), frozenset(links or ())
                out.append(text_of(html or "", *known[host]))
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
