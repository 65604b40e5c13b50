"""Main text of web pages by templates deduced from pages of the same host.

Tokens are the container tags of a page, with the path of containers above them, and the
texts of its blocks, with the container they stand in. Tokens of a host that occur equally
often on every page have equal occurrence vectors and form an equivalence class; a vector
is compared by its number of pages and a 64-bit sum of hashes of (page, count), so no
host's pages are ever gathered. A class is valid if it covers at least half of a host's
different pages, of which there must be a few, and has more than one token. The texts of
valid classes are the host's template; they nest in the containers of their classes, and
what stands between them are the slots. Everything in the slots is extracted.

If a page has an article or main element, its text is what the outermost ones hold, also
sentences that repeat beside a slot. Template texts are left out of it where the container
they nest in, below the article, is of the template too and has no slot on the page. Otherwise it is every block that is not template text. In both cases
containers of menus, notices, adverts, forms, comments and the like are left out, with one
exception: a container that is marked so by its class only, but holds the page's sole article.

Blocks are joined by a newline, white space inside a block is one space, and
character references are decoded. Nothing inside the slots is dropped or capped.

Defined cases: a null or empty page has an empty text; pages are read whole;
unclosed and stray tags are tolerated, also a head that is not closed; a null url is a
host of its own; copies of a page are one page of its host, so they make no template;
repeated rows get the same text; if all blocks of a page or its article are template, it
keeps them;
an empty table gives an empty result; other columns are kept, one with the result's
name is replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmine.sources.scratch import materialize

# Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title")
# Containers that are never part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button select fieldset".split())
# Words in a class, an id or a role that mark a container as no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar menu nav navigation navbar breadcrumb breadcrumbs footer cookie cookies notice notices "
    "consent popup modal newsletter subscribe share sharing social related recommended comment "
    "comments widget masthead toolbar contentinfo complementary search".split()
)
# Elements that end a block, and those of them that can hold others.
CONTAINERS = frozenset(
    "html body article main section div header ul ol dl table tbody thead tr figure details".split()
) | ASIDE
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote address hr figcaption caption summary".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: A template's tokens cover at least this share of a host's pages, of which there are some.
COVER, LEAST_PAGES = 0.5, 4
#: Parts of a class name that say a container lacks something, or only holds it.
_NEGATIONS = frozenset("has no not non with without none hide hidden".split())
#: Words in a class name that an article's own containers have.
_CONTENT = frozenset("content article main post entry body story text".split())
#: Why a block is left out: not at all, its container's class, its container's tag.
FREE, MARKED, FOREIGN = 0, 1, 2


@dataclass
class Block:
    """Text of a block, the path of its container, and where it stands."""

    path: str
    text: str
    state: int  # FREE, MARKED or FOREIGN, inside the article if there is one
    article: bool  # whether it stands in an article or main element
    wrapped: bool  # whether that element stands in a marked container
    inside: int = -1  # number of its container on the page, -1 outside of all


@dataclass
class _Container:
    tag: str
    path: str
    state: int
    article: bool
    wrapped: bool
    number: int = -1


def _names(attributes: str) -> str:
    found = [a or b or c for _, a, b, c in _NAME.findall(attributes)] if attributes else []
    return " ".join(found).lower()


def _marked(names: str) -> bool:
    """Whether a class, id or role marks a container as no article."""
    marked = False
    for name in names.split():
        parts = _WORD.findall(name)
        if _CONTENT.intersection(parts):
            return False
        if not _NEGATIONS.intersection(parts):
            marked = marked or any(part in MARKS for part in parts)
    return marked


def _state(tag: str, names: str, above: _Container) -> int:
    if above.state == FOREIGN or tag in ASIDE:
        return FOREIGN
    if tag == "header":
        # The heading of an article belongs to it; the one of the page does not.
        return above.state if above.article else FOREIGN
    if tag in ("html", "body", "article", "main"):
        return above.state
    return MARKED if above.state == MARKED or _marked(names) else FREE


class _Page:
    """A page's blocks and container tags, in page order."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.tags: list[str] = []
        self.above: list[int] = []  # the container that holds each one
        self.path = [_Container("", "", FREE, False, False)]
        self.parts: list[str] = []
        at = 0
        while at < len(page):
            hit = _TOKEN.search(page, at)
            if not hit:
                self.parts.append(re.sub(r"<[a-zA-Z/!?][^<>]*$", "", page[at:]))
                break
            self.parts.append(page[at : hit.start()])
            at = hit.end()
            if hit[1]:
                self.parts.append(hit[1])
            if hit[3]:
                at = self._tag(page, hit, at)
        self._end_block()

    def _tag(self, page: str, hit: re.Match, at: int) -> int:
        """Take up a tag; where reading goes on."""
        close, tag = bool(hit[2]), hit[3].lower()
        if tag in RAW:
            if close or hit[4].endswith("/"):
                return at
            # Only the element's own end tag ends it, whatever stands in it.
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            return end.end() if end else len(page)
        if tag == "br":
            self.parts.append(" ")
        elif tag == "head" or tag in BLOCKS:
            self._end_block()
            if tag == "head":
                if close:
                    self._close(tag)
                else:
                    self.path.append(_Container(tag, "/head", FOREIGN, False, False))
                return at
            if self.path[-1].tag == "head" and tag != "html":
                self.path.pop()  # the head's end tag was left out
            if tag in CONTAINERS:
                if close:
                    self._close(tag)
                elif not hit[4].endswith("/"):
                    self._open(tag, _names(hit[4]))
        return at

    def _close(self, tag: str) -> None:
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag == tag:
                del self.path[depth:]
                break

    def _open(self, tag: str, names: str) -> None:
        above = self.path[-1]
        path = f"{above.path}/{tag}" + (f".{names.replace(' ', '.')}" if names else "")
        state = _state(tag, names, above)
        article, wrapped = above.article, above.wrapped
        if tag in ("article", "main") and not article:
            # Marks count again inside the article; around it they are remembered.
            article, wrapped = True, state == MARKED
            state = FREE if state == MARKED else state
        number = len(self.tags)
        self.tags.append(path)
        self.above.append(above.number)
        self.path.append(_Container(tag, path, state, article, wrapped, number))

    def _end_block(self) -> None:
        text = " ".join(html_lib.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            inside = self.path[-1]
            self.blocks.append(
                Block(
                    inside.path, text, inside.state, inside.article, inside.wrapped, inside.number
                )
            )


def text_token(block: Block) -> int:
    """A block's text and container as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(f"{block.path}\0{block.text}") - (1 << 63)


def tag_token(path: str) -> int:
    """A container's path as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def main_text(page: str, template: Collection[int] = (), containers: Collection[int] = ()) -> str:
    """The text of a page on a host with these template texts and the containers of their classes."""
    parsed = _Page(page)
    free = [b for b in parsed.blocks if b.state == FREE]
    slots = [text_token(b) not in template for b in free]
    article = [b.article for b in free]
    if any(article):
        bare = [a and not b.wrapped for a, b in zip(article, free, strict=True)]
        inside = bare if any(bare) else article
        filled = _filled(parsed, [b for b, slot in zip(free, slots, strict=True) if slot])
        boilerplate = [
            not slot and _nested(parsed, b) and b.inside not in filled
            and tag_token(b.path) in containers
            for b, slot in zip(free, slots, strict=True)
        ]
        kept = [i and not x for i, x in zip(inside, boilerplate, strict=True)]
        kept = kept if any(kept) else inside
    else:
        kept = slots if any(slots) else [True] * len(free)
    return "\n".join(b.text for b, keep in zip(free, kept, strict=True) if keep)


def _filled(page: _Page, slots: list[Block]) -> set[int]:
    """The containers of a page that have a slot, at any depth."""
    filled: set[int] = set()
    for block in slots:
        at = block.inside
        while at >= 0 and at not in filled:
            filled.add(at)
            at = page.above[at]
    return filled


def _nested(page: _Page, block: Block) -> bool:
    """Whether a block stands in a container below an article, not in the article itself."""
    tag = page.tags[block.inside].rsplit("/", 1)[-1].split(".", 1)[0] if block.inside >= 0 else ""
    return block.article and tag not in ("article", "main")


def templates(pages: DataFrame, *, html: str) -> DataFrame:
    """``<host, template: array<long>, containers: array<long>>`` from ``<host, page, html>``.

    These are the texts of valid classes and the containers of the same classes.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            hosts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for host, key, page in zip(hosts, keys, batch.column(2).to_pylist(), strict=True):
                found = _Page(page or "")
                counts = Counter((text_token(b), True) for b in found.blocks if b.state == FREE)
                counts.update((tag_token(t), False) for t in found.tags)
                for (token, is_text), n in counts.items():
                    vector = xxhash.xxh3_64_intdigest(f"{key} {n}") - (1 << 63)
                    rows.append((host, token, is_text, vector >> 16))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["host", "token", "is_text", "vector"],
            )

    # Copies of a page are one page, wherever they stand on the host.
    different = pages.dropDuplicates(["host", "page"])
    counted = (
        different.select("host", "page", html)
        .mapInArrow(tokens, "host string, token long, is_text boolean, vector long")
        .groupBy("host", "token", "is_text")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("vector").alias("vector"))
    )
    sizes = pages.groupBy("host").agg(F.countDistinct("page").alias("of"))
    frequent = counted.join(sizes, "host").where(
        (F.col("of") >= LEAST_PAGES) & (F.col("pages") >= COVER * F.col("of"))
    )
    # Tokens on at least half of the pages are at most twice those of a page.
    classes = frequent.groupBy("host", "pages", "vector").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("texts"),
        F.collect_list(F.when(~F.col("is_text"), F.col("token"))).alias("tags"),
    )
    return (
        classes.where((F.col("tokens") > 1) & (F.size("texts") > 0))
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("texts")).alias("template"),
            F.flatten(F.collect_list("tags")).alias("containers"),
        )
    )


def extract(
    df: DataFrame, *, url: str = "url", html: str = "html", result: str = "text"
) -> DataFrame:
    """``df`` with the main text of each page."""
    rest = df.drop(result)
    host = F.coalesce(
        F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1)), F.lit("")
    )
    pages = df.select(host.alias("host"), F.xxhash64(html).alias("page"), html)
    # Written, so that its true size decides whether the join broadcasts it; else the
    # adaptive skew join splits the pages of a large host.
    found = materialize(templates(pages, html=html), "page-templates").select(
        F.col("host").alias("__host"),
        F.col("template").alias("__template"),
        F.col("containers").alias("__containers"),
    )
    joined = rest.join(found, host == F.col("__host"), "left").drop("__host")
    names = rest.columns
    place = names.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                texts = [
                    main_text(page or "", frozenset(template or ()), frozenset(containers or ()))
                    for page, template, containers in zip(
                        part.column(place).to_pylist(),
                        part.column(len(names)).to_pylist(),
                        part.column(len(names) + 1).to_pylist(),
                        strict=True,
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], pa.array(texts, pa.string())], [*names, result]
                )

    schema = T.StructType([*rest.schema.fields, T.StructField(result, T.StringType())])
    return joined.mapInArrow(run, schema)
