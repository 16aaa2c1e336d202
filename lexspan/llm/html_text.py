"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a few templates; its pages of equal landmarks are a cluster, for one template. A token is an open tag with its
path (tag names and classes from the body down) or a text piece at a path. Its occurrence vector says how often it is on each
distinct page of the cluster; tokens with equal vectors are an equivalence class. Classes of two tokens or more on at least half of the
cluster's distinct pages are the template's; a path nests in the template if all its prefixes do. What varies between them
are slots. A slot's words, link words and place decide once for the cluster whether it holds article text; text pieces that the
classes hold are the template's own and go. Pages and paths without such evidence are decided alone, by the same rules.

Where a page has an article or main element, only slots inside it count. The element is evidence that they hold text: short ones do too, but not those
that are mostly links, nor menus, forms, adverts, notices, comments and the like. There only classes and roles of block elements tell these, and a few
whole ids. A form around an article, or around most of a page's words, doesn't count as one. Repeated text inside is the template's only
while it is less than half of the words there: pages that share more are copies of one article, and are kept whole.

Defined results: null or empty html gives an empty text; pages without host are a host together; repeated rows are extracted alike and
count once as evidence; a page cut off in the middle of a tag or comment loses that tag or comment; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint, table

#: Templates are sent to all executors up to this many bytes; larger ones are joined by a shuffle.
SEND_BYTES = 32 << 20

#: Characters of a path that is kept as it is, and open elements that are kept before inline ones are dropped.
LONG_PATH, OPEN = 2000, 400

_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Elements and words of class, id and role that mark what isn't article text.
OUT_TAGS = frozenset("nav footer aside button dialog menu".split())
FORMS = ("form", "fieldset")
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments reply replies discussion disqus respond "
    "related recommended recommendations share sharing social widget widgets pagination pager search login toolbar skip complementary contentinfo".split()
)
#: Of these, words that articles have for parts of their own: inside an article element such a block is out only if it isn't prose, which takes so many words at least.
MAY_BE_TEXT, PROSE = frozenset("related search share sharing social notice notices discussion widget widgets menu alert skip respond complementary navigation recommended".split()), 12
#: Whole ids that do so inside an article element, where ids otherwise name its parts.
OUT_IDS = frozenset("ad ads advert advertisement comments disqus respond newsletter sidebar breadcrumb breadcrumbs pagination navbar cookie-banner cookie-notice".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Only outside an article element.
OUT_ABOVE = frozenset("header masthead topbar hero".split())
INSIDE = ("article", "main")
INSIDE_WORDS = frozenset({"articlebody", "postbody", "postcontent", "entrycontent", "articlecontent", "maincontent", "storybody"})
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_LANDMARKS = frozenset("article aside footer header main nav".split())
_SECTIONS = frozenset("center div form section table".split())
#: Tags that end an open paragraph.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Piece:
    """A run of text without a block boundary."""

    path: str
    text: str
    inside: bool
    out: bool
    linked: int
    form: bool = False  # out for a form around it alone
    doubt: int = 0  # the number of the block around it that is out unless it is prose


@dataclass
class _Open:
    tag: str
    path: str
    inside: bool
    barred: bool
    form: bool
    doubt: int = 0

    @property
    def out(self) -> bool:
        return self.barred or self.form


def _marks(rest: str) -> tuple[list[str], list[str], bool]:
    """Class, id and role values of an element's attributes, the ids alone, and whether it is hidden."""
    names, ids, hidden = [], [], False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            names += value.split()
            ids += value.split() if name == "id" else []
    return names, ids, hidden


def parse(source: str) -> tuple[list[Piece], dict[str, int]]:
    """Text pieces in page order, and how often each open tag's path occurs."""
    pieces: list[Piece] = []
    tags: dict[str, int] = {}
    stack = [_Open("", "", False, False, False)]
    text: list[str] = []
    linked = in_link = doubts = 0
    pos, end, limit = 0, len(source), OPEN

    def flush():
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                top = next((x for x in reversed(stack) if x.tag not in INLINE), stack[0])
                pieces.append(Piece(top.path, said, top.inside, stack[-1].out, linked, not stack[-1].barred and stack[-1].form, stack[-1].doubt))
        linked = 0

    while pos < end:
        m = _MARKUP.search(source, pos)
        if m is None:
            text.append(source[pos:])
            break
        if m.start() > pos:
            text.append(source[pos : m.start()])
            if in_link:
                linked += len(text[-1].split())
        pos = m.end()
        if m["cdata"] is not None:
            text.append(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                if any(x.tag not in INLINE for x in stack[depth:]) or stack[depth].out != stack[depth - 1].out:
                    flush()
                del stack[depth:]
                in_link = sum(x.tag == "a" for x in stack)
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if tag not in ("svg", "math", "object", "select") or not m["rest"].rstrip().endswith("/"):
                closing = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(source, pos)
                pos = closing.end() if closing else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        names, ids, hidden = _marks(m["rest"]) if m["rest"] else ([], [], False)
        words = {w.lower() for n in names for w in _NAME.findall(n)}
        if tag not in INLINE:
            flush()
            ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
            while True:  # ends the nearest block, with the inline elements in it
                k = len(stack) - 1
                while k > 0 and stack[k].tag in INLINE:
                    k -= 1
                if not k or stack[k].tag not in ends:
                    break
                del stack[k:]
            in_link = sum(x.tag == "a" for x in stack)
        top = stack[-1]
        doubt = top.doubt
        squeezed = {re.sub("[^a-z]", "", n.lower()) for n in names}
        inside = top.inside or tag in INSIDE or bool(words & {"main", "article"} and "role" in m["rest"].lower()) or bool(squeezed & INSIDE_WORDS)
        if not top.inside:
            said = bool(words & (OUT_WORDS | OUT_ABOVE)) or tag == "header"
        elif tag in INLINE or tag in HEADINGS:
            said = False
        else:
            found = {w.lower() for n in names if n not in ids for w in _NAME.findall(n)} & OUT_WORDS
            said = bool(found - MAY_BE_TEXT) or any(n.lower() in OUT_IDS for n in ids)
            if found and not said and not doubt:
                doubts += 1
                doubt = doubts
        out = top.barred or hidden or tag in OUT_TAGS or said and tag not in ("html", "body", "article", "main")
        if tag in ("article", "main") and words & OUT_WORDS & {"comment", "comments", "reply", "related", "ad", "sponsored"}:
            out = True
        form = tag in FORMS or top.form and (top.inside or not inside)  # a form around an article is none
        if (out or form) != top.out and tag in INLINE:
            flush()
        label = ".".join([tag, *sorted(n for n in names if not any(c.isdigit() for c in n))])
        above = top.path if len(top.path) <= LONG_PATH else f"#{key(top.path)}>"  # deep paths are told by a hash
        path = f"{above}>{label}" if tag not in ("html", "body") else tag
        if tag not in INLINE:
            tags[path] = tags.get(path, 0) + 1
        if m["rest"].rstrip().endswith("/") and tag in INLINE:
            continue
        stack.append(_Open(tag, path if tag not in INLINE else top.path, inside, out, form, doubt))
        in_link += tag == "a"
        if len(stack) > limit:  # unclosed inline tags without end; blocks stay, however deep
            stack[1:-1] = [x for x in stack[1:-1] if x.tag not in INLINE]
            in_link = sum(x.tag == "a" for x in stack)
            limit = max(OPEN, 2 * len(stack))
    flush()
    for k in range(1, doubts + 1):
        own = [p for p in pieces if p.doubt == k]
        n = sum(len(p.text.split()) for p in own)
        if n < PROSE or 2 * sum(p.linked for p in own) >= n:
            for p in own:
                p.out = True
    words = [len(p.text.split()) if p.form or not p.out else 0 for p in pieces]
    if 2 * sum(n for n, p in zip(words, pieces, strict=True) if p.form) > sum(words):  # a form that holds most of the page's words is none
        for p in pieces:
            p.out = p.out and not p.form
    return pieces, tags


def parent(path: str) -> int:
    """The key of the path above; of a deep one it is written in the path."""
    above = path.rpartition(">")[0]
    return int(above[1:-1]) if above.startswith("#") and above.find(">") == len(above) - 1 else key(above)


def landmarks(tags: dict[str, int]) -> int:
    """What a page's cluster is known by: the sections right below its body, and its landmarks at any depth."""
    own = {p for p in tags if (last := p.rpartition(">")[2].partition(".")[0]) in _LANDMARKS or last in _SECTIONS and p.count(">") == 1}
    return key("\n".join(sorted(own)))


def article(pieces: list[Piece], keep: frozenset[int] = frozenset(), drop: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset(), cluster: int = 0) -> str:
    """The main text, given the slots of the host's clusters that hold article text, those that don't, and the templates' own text."""
    whole = any(p.inside and not p.out for p in pieces)
    out = []
    for p in pieces:
        if p.out or whole and not p.inside:
            continue
        k = key(p.path) ^ cluster
        if k in drop or fixed and key(f"{p.path}\0{p.text}") ^ cluster in fixed:
            continue
        if whole or k in keep or _is_text(len(p.text.split()), p.linked, 1, p.path):
            out.append(p.text)
    return " ".join(out)


def _is_text(words: int, linked: int, pieces: int, path: str) -> bool:
    """Whether a slot with so many words, words of links and pieces holds text rather than labels."""
    last = path.rpartition(">")[2].partition(".")[0]
    return 2 * linked < words and (words >= 5 * pieces or last in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre"))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_TOKENS = "host string, token long, page long, cluster long, n int, path string, up long, words long, linked long, pieces long, around long, out boolean, inside boolean, text boolean"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to the tokens of each page; page is a hash of its html, so that copies are one; around: the words inside its article."""
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.string(), *[pa.int64()] * 5, *[pa.bool_()] * 3]
    for batch in batches:
        rows = []
        for where, source in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            page = key(source)
            pieces, tags = parse(source)
            cluster = landmarks(tags)
            whole = any(p.inside and not p.out for p in pieces)
            held: dict[str, list] = {p: [0, 0, 0, False, False] for p in tags}
            texts: dict[tuple[str, str], list[int]] = {}
            around = 0
            for p in pieces:
                h = held.setdefault(p.path, [0, 0, 0, False, False])
                words = len(p.text.split())
                if not (whole and p.inside and p.out):
                    h[0] += words
                    h[1] += p.linked
                    h[2] += 1
                    h[3] |= p.out
                h[4] |= whole and p.inside
                if not whole or p.inside and not p.out:
                    t = texts.setdefault((p.path, p.text), [0, 0])
                    t[0] += 1
                    t[1] += words
                    around += words
            rows += [(where, key(p) ^ cluster, page, cluster, tags.get(p, 0), p, parent(p) ^ cluster, *h[:3], 0, *h[3:], False) for p, h in held.items()]
            rows += [(where, key(f"{a}\0{t}") ^ cluster, page, cluster, n, None, key(a) ^ cluster, words, 0, 0, around, False, whole, True) for (a, t), (n, words) in texts.items()]
        cols = list(zip(*rows, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, html): (host, keep, drop, fixed) for hosts with a template: slots with and without article text, and its own text, of all clusters."""
    tokens = pages.mapInArrow(_tokens, _TOKENS)
    first = ("path", "up", "words", "linked", "pieces", "around", "out", "inside", "text")
    one = ["host", "cluster"]
    each = tokens.groupBy(*one, "token", "page").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in first])
    vector = F.bit_xor(F.xxhash64("page", "n"))
    sums, flags = ("words", "linked", "pieces", "around"), ("out", "inside", "text")
    by = each.groupBy(*one, "token").agg(vector.alias("vector"), F.count(F.lit(1)).alias("pages"), F.first("path").alias("path"), F.first("up").alias("up"), *[F.sum(c).alias(c) for c in sums], *[F.bool_or(c).alias(c) for c in flags])
    by = checkpoint(by)
    size = by.groupBy(*one).agg(F.max("pages").alias("n_pages"))  # every page has a root
    of_class = [*one, "vector", "pages"]
    classes = by.groupBy(*of_class).agg(F.count(F.lit(1)).alias("members"))
    valid = classes.join(size, one).where((F.col("n_pages") >= 3) & (2 * F.col("pages") >= F.col("n_pages")) & (F.col("members") >= 2))
    held = by.join(valid.select(*of_class), of_class)
    # a class is nested if the paths above its tokens are on at least as many pages
    above = by.where("not text").select(*one, F.col("token").alias("up"), F.col("pages").alias("above"))
    nested = held.join(above, [*one, "up"], "left").where(F.coalesce(F.col("above") >= F.col("pages"), ~F.col("text")))
    last = F.element_at(F.split(F.element_at(F.split("path", ">"), -1), "\\."), 1)
    prose = 2 * F.col("linked") < F.col("words")
    is_text = prose & (F.col("inside") | (F.col("words") >= 5 * F.col("pieces")) | last.isin("p", "h1", "h2", "h3", "h4", "blockquote", "pre"))
    slot = ~F.col("text") & (F.col("pieces") > 0)
    kind = F.when(F.col("text"), "fixed").when(slot & ~F.col("out") & is_text, "keep").when(slot, "drop")
    nested = checkpoint(nested.select(*of_class, "token", "words", "around", "inside", kind.alias("kind")).where("kind is not null"))
    # text inside articles is the template's while it is the lesser part of the words there, in each class and in all of them
    less = 2 * F.col("words") < F.col("around")
    own = nested.where("kind = 'fixed' and inside").groupBy(*of_class).agg(F.sum("words").alias("words"), F.max("around").alias("around")).where(less)
    total = own.groupBy(*one).agg(F.sum("words").alias("words"), F.max("around").alias("around")).where(less)
    fixed = nested.where("kind = 'fixed' and inside").join(own.join(total, one, "left_semi"), of_class, "left_semi")
    sure = nested.where("not (kind = 'fixed' and inside)").select("host", "token", "kind").union(fixed.select("host", "token", "kind"))
    return sure.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in ("keep", "drop", "fixed")])


_SCHEMA = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        none = frozenset()
        for source, *known in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            pieces, tags = parse(source)
            texts.append(article(pieces, *(frozenset(x) if x else none for x in known), landmarks(tags)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html): (page_id, url, text, n_chars)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    known = checkpoint(templates(pages.select("host", "html")))
    held = known.agg(F.sum(8 * (F.size("keep") + F.size("drop") + F.size("fixed")) + 64 + F.length("host"))).first()[0] or 0
    right = F.broadcast(known) if held <= SEND_BYTES else known  # the bound is checked
    joined = pages.join(right, "host", "left").select("page_id", "url", "html", "keep", "drop", "fixed")
    return joined.mapInArrow(_extract, _SCHEMA)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
