"""Main text of web pages, with a template deduced from equivalence classes of tokens.

A page's tokens are its elements (by path) and its text blocks outside an
article (by path and text). Over the pages of a host each token has an occurrence
vector: how often it occurs on each page. Tokens with equal vectors form an
equivalence class; a class that nearly all pages of the host share and that holds
elements is part of the host's template, nested as the paths are. What is left
between template tokens are slots; those in menus, adverts and the like are known
by their elements, the others are the page's text.

Vectors are never gathered: each is folded into one order-free hash, so hosts of
any size are summed up where their pages are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import small_batches, written

#: Different pages that a host needs for a template, and the share of them that a class must be on.
PAGES, SHARE = 5, 0.9

# Elements and names of the page parts that are no article text.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas video audio select xmp noembed noframes".split())
OUT = frozenset("nav aside form button dialog menu footer head fieldset label input datalist optgroup option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription sidebar widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus reply replies respond discussion share "
    "sharing social related recommended recommendations pagination pager toolbar login signup skip hidden".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MAIN = frozenset(("article", "main"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>""", re.S)
#: After a quote or a tag that never ends: quotes are characters like others, and no tag goes beyond the next one's start.
_SHORT_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>""", re.S)
_START = re.compile(r"<[!?/a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _signed(data: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(data.encode("utf-8", "surrogatepass")), "big", signed=True)


def _attributes(text: str) -> tuple[bool, str]:
    """Whether an element is out by its attributes, and the part of its path that they make."""
    out, label = False, ""
    if text:
        for name, value in _ATTRIBUTE.findall(text):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words = _NAME.findall(value)
                out = out or not NAMES.isdisjoint(words)
                label += ("." if name == "class" else "#") + value
            elif name == "role":
                out = out or value in ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out = True
    return out, label


_NOWHERE = ("", 0, False, False, None)


class Page:
    """One pass over the markup: text blocks with what is known of them, and the paths of elements."""

    def __init__(self, source: str):
        #: (tag, hash of its path, out, main, place of the first element that is out) of each open element.
        self.stack: list[tuple[str, int, bool, bool, int | None]] = []
        self.blocks: list[tuple[str, bool, int]] = []
        self.paths: dict[int, int] = {}
        self.parts: list[str] = []
        self.names: Counter[str] = Counter()
        self.where = _NOWHERE
        at, tags, seen = 0, _TAG, 0
        while True:
            start = _START.search(source, seen)
            if start is None:
                self.text(source[at:])
                break
            tag = tags.match(source, start.start())
            if tag is None and tags is _TAG:  # it ran to the end of the page: nothing shall do so again
                tags = _SHORT_TAG
                tag = tags.match(source, start.start())
            if tag is None:
                seen = start.end()
                continue
            self.text(source[at : tag.start()])
            at = seen = tag.end()
            if tag[2]:
                name = tag[2].lower()
                if tag[1]:
                    self.close(name)
                elif name in RAW:
                    end = _RAW_END[name].search(source, at)
                    at = seen = end.end() if end else len(source)
                    self.count(_signed(f"{self.where[1]}/{name}"))
                else:
                    self.open(name, tag[3])
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.where[2]:
            self.parts.append(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((text, self.where[3], self.where[1]))
            self.parts = []

    def count(self, path: int) -> None:
        self.paths[path] = self.paths.get(path, 0) + 1

    def cut(self, size: int) -> None:
        """Close all but the first ``size`` open elements."""
        while len(self.stack) > size:
            self.names[self.stack.pop()[0]] -= 1
        self.where = self.stack[-1] if self.stack else _NOWHERE

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
        elif name in ("br", "td", "th") and self.parts:
            self.parts.append(" ")
        if name in VOID:
            return
        if name in MAIN:  # a menu or header that was never closed ends where the article begins
            first = self.where[4]
            if first is not None and self.stack[first][0] in ("nav", "header", "footer"):
                self.cut(first)
        elif name in BLOCKS and self.stack and self.stack[-1][0] == "p":
            self.cut(len(self.stack) - 1)
        ends = CLOSES.get(name, ())
        if any(self.names[x] for x in ends):
            for i in range(len(self.stack) - 1, -1, -1):  # an open item ends where the next one begins
                top = self.stack[i][0]
                if top in ends:
                    self.cut(i)
                    break
                if top in BLOCKS or top == "td":
                    break
        _, path, out, main, first = self.where
        gone, label = _attributes(attributes)
        path = _signed(f"{path}/{name}{label}")
        main = main or name in MAIN
        out = out or name in OUT or name == "header" and not main or gone and name not in ("html", "body", "main") and not (name == "article" and "comment" not in label)
        self.count(path)
        self.where = name, path, out, main, len(self.stack) if out and first is None else first
        self.stack.append(self.where)
        self.names[name] += 1

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        elif name in ("td", "th") and self.parts:
            self.parts.append(" ")
        if self.names[name]:
            self.cut(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))


_BLOCK = pa.struct([("text", pa.string()), ("token", pa.int64())])
_TOKEN = pa.struct([("token", pa.int64()), ("element", pa.bool_()), ("n", pa.int32())])
_PARSED = pa.struct([("host", pa.string()), ("same", pa.int64()), ("blocks", pa.list_(_BLOCK)), ("tokens", pa.list_(_TOKEN))])
_DDL = "struct<host:string,same:bigint,blocks:array<struct<text:string,token:bigint>>,tokens:array<struct<token:bigint,element:boolean,n:int>>>"


def _parse(urls: pa.Array, sources: pa.Array) -> pa.Array:
    """host; a hash of the whole text; blocks, with a token for those outside an article; and the page's tokens."""
    rows = []
    for url, source in zip(urls.to_pylist(), sources.to_pylist()):
        page = Page(source or "")
        blocks, tokens = [], {p: (True, n) for p, n in page.paths.items()}
        # an article or main element, if there is one with text, holds the page's text
        inside = any(main for _, main, _ in page.blocks)
        for text, main, path in page.blocks:
            token = None if main else _signed(f"{path}\0{text}")
            if main or not inside:
                blocks.append({"text": text, "token": token})
            if token is not None:
                tokens[token] = False, tokens.get(token, (False, 0))[1] + 1
        rows.append({"host": host_of(url), "same": _signed("\n".join(t for t, _, _ in page.blocks)), "blocks": blocks,
                     "tokens": [{"token": t, "element": e, "n": n} for t, (e, n) in tokens.items()]})
    return pa.array(rows, _PARSED)


def templates(parsed: DataFrame) -> DataFrame:
    """``(host, vector, token, element)``: the template tokens of each host that has enough different pages.

    Pages of a host with equal text are one page, so a page that was copied a thousand times makes no template.
    """
    page = F.xxhash64("host", "same")
    each = parsed.select("host", page.alias("page"), F.inline("tokens"))
    counts = each.groupBy("host", "page", "token").agg(F.max("element").alias("element"), F.max("n").alias("n"))
    vectors = counts.groupBy("host", "token").agg(F.max("element").alias("element"), F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    hosts = parsed.groupBy("host", page.alias("page")).count().groupBy("host").agg(F.count("*").alias("of"))
    near = vectors.join(hosts, "host").filter((F.col("of") >= PAGES) & (F.col("pages") >= SHARE * F.col("of")))
    near = written(near.select("host", "vector", "token", "element"), "near")
    classes = near.groupBy("host", "vector").agg(F.count_if("element").alias("elements")).filter("elements > 0")
    return near.join(classes.select("host", "vector"), ["host", "vector"], "left_semi")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``(id_col, url_col, text, n_chars)``.

    * Blocks of text in page order, joined by line feeds; white space in a block is one space, character references are
      decoded. Menus, headers outside the article, footers, sidebars, notices, adverts, forms, scripts, styles, hidden
      elements and reader comments are left out, by element, role, class and id.
    * If an article or main element has text, the page's text is what is in it. Other pages give all blocks that are not
      of the host's template.
    * Broken markup is read once from start to end: from the first quote or tag that never ends, quotes are characters like
      others; elements that are never closed stay open. Time grows with the length of the markup, whatever is in it.
    * Null markup is empty, and an empty table gives no rows; a page without text gives an empty string; a url without a host stands with the others of
      that kind. Repeated rows each give a row. Other columns are ignored.
    """
    rows = small_batches(pages).select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                                       F.arrow_udf(_parse, _DDL)(F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`")).alias("p"))
    parsed = written(rows.select("rid", "id", "url", "p.host", "p.same", "p.blocks", "p.tokens"), "parsed")
    template = written(templates(parsed).filter("not element").select("host", "token"), "template")
    open_blocks = F.filter("blocks", lambda b: b["token"].isNotNull())
    free = parsed.filter(F.size(open_blocks) > 0)
    known = free.select("rid", "host", F.explode(open_blocks["token"]).alias("token")).join(template, ["host", "token"]).groupBy("rid").agg(F.collect_set("token").alias("gone"))
    known = written(known, "known")
    cut = free.join(known.hint("merge"), "rid", "left").select("id", "url", F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), b["token"])).alias("blocks"))
    done = parsed.filter(F.size(open_blocks) == 0).select("id", "url", "blocks").unionByName(cut)
    text = F.array_join(F.col("blocks.text"), "\n")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
