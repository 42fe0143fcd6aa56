"""Main text of web pages by consensus of a host's pages on where the article is.

Each page is read into containers (elements with a path of tags and classes, digits folded, kept as a hash) and
blocks (paragraphs, headings, list items, cells, loose text). Containers are scored by the characters of the
blocks they hold, links against them. Spark sums the scores by host and path, and the path with the largest sum
wins its host. Each page is then read again: its text is that of the containers with the winning path, or of its
own best container where they hold next to nothing, without menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments.

What is cut out of the article is voted on as well. Elements of a kind (nav, footer, script) are always out. A suspect (a
class or id made of the words of such parts, a role, a form, a header) needs ENOUGH votes: its name, if it has no other
words than those of page parts, is one; lying outside <article>, being mostly links, holding controls, and being a list of
comments are one each; so is a path that a good share of the host's pages have; and the same text in that path on several
different pages of the host is two. A section of an article shares a word with a menu at most, and stays. Nothing that
holds most of the page's prose is cut.

A block's white space becomes one blank, a line break is white space, and blocks are joined by a newline in
page order. Votes are partial sums by (host, path), so a host with a third of all pages costs no more; the
winners are broadcast if they are at most BROADCAST_HOSTS hosts and otherwise joined by a salted shuffle. A host's row
holds its winning path and the voted paths to cut, which are on LEAST_SHARE of its pages at least and so are few.

Null html, or html without an article, gives the text ''. A null url is a host of its own name ''. Null and
repeated ids keep their rows; ties of votes go to the first path in order; an empty table gives an empty result;
extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common

BROADCAST_HOSTS = 100_000
ENOUGH = 2  #: votes that cut a suspect
SEVERAL, USUAL, LEAST_SHARE = 3, 0.3, 0.01  #: pages that make a path recur; share of pages for a vote, and for a repeated text
SALTS = 64

# HTML elements by kind.
CONTAINERS = frozenset(
    "html body main article section div center table tbody thead tfoot tr td th ul ol dl figure details form fieldset "
    "nav header footer aside blockquote dialog menu search hgroup".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd figcaption caption address summary legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp noembed noframes".split())
DROPPED = frozenset(
    "nav footer aside dialog menu search button select textarea datalist output legend option head title "
    "noscript template iframe object canvas svg math audio video map".split()
)
DOUBTFUL = frozenset("form fieldset header".split())  #: outside the article unless they hold it
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {  # what an open element of these kinds ends at
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# Words in class and id names that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail ad ads adv "
    "advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended pagination pager widget toolbar copyright disclaimer skip search".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
# Words that go with those in the names of page parts.
PARTS = frozenset(
    "site page main left right top bottom area box wrap wrapper inner outer container block bar list item items link links post posts "
    "form section col column primary secondary global mobile desktop button buttons icon icons content entry article module panel "
    "group row holder zone slot unit text title body thread meta view more up in out bottom sticky fixed area feed story stories".split()
)
CONTROLS = frozenset("input button textarea select".split())
MODIFIERS = frozenset("has no with without is not show hide js".split())  #: `has-sidebar` is no sidebar
OWN_HEADER = frozenset("entry post article story content section".split())  #: `entry-header` is the article's
ARTICLE = frozenset("article main".split())

ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
QUOTE = re.compile(r"=\s*([\"'])")
NAME = re.compile(r"[a-z][^\s/>]*", re.I)
NAME_WORDS = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

PLAIN, GONE, DOUBT, TALK = range(4)  #: marks: none, never of the article, unless it holds the article, reader comments


def pieces(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", tag, attributes) and ("close", tag, "") of a page, in time linear in its length."""
    at, n = 0, len(source)
    more = {'"': True, "'": True, ">": True}  # whether another may come; said once, it holds for the rest
    while at < n:
        lt = source.find("<", at)
        if lt < 0 or not more[">"]:
            break
        if lt > at:
            yield "text", "", source[at:lt]
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        close = source.startswith("/", lt + 1)
        name = NAME.match(source, lt + 1 + close)
        if not name:
            if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        end = start = name.end()
        gt = source.find(">", end)
        while 0 <= gt and (quote := QUOTE.search(source, end, gt)):
            mark = quote[1]
            shut = source.find(mark, quote.end()) if more[mark] else -1
            if shut < 0:
                more[mark] = False
                break  # never closed: the tag ends at the first >
            end = shut + 1
            if gt < end:
                gt = source.find(">", end)
        if gt < 0:
            more[">"] = source.find(">", start) >= 0
            gt = source.find(">", start) if more[">"] else -1
            if gt < 0:
                at = lt
                break
        tag = name[0].lower()
        at = gt + 1
        if close:
            yield "close", tag, ""
        elif tag in RAW:
            found = re.compile(f"</{tag}", re.I).search(source, at)
            end = source.find(">", found.end()) if found else -1
            at = n if end < 0 else end + 1
        else:
            yield "open", tag, source[start:gt]
    if at < n:
        yield "text", "", source[at:]


class Node:
    """A container or a marked element: its parent, the hash of its path, its mark, and the characters of its blocks."""

    __slots__ = ("parent", "path", "tag", "mark", "out", "own", "prose", "total", "holds", "plain", "inside", "chars", "links", "controls", "every", "votes")

    def __init__(self, parent: Node | None, label: str, tag: str, mark: int, plain: bool = False, inside: bool = False):
        """plain: its name has a word of a page part and no foreign word; inside: it lies in an <article>."""
        import xxhash

        self.parent, self.tag, self.mark, self.plain, self.inside = parent, tag, mark, plain, inside
        self.path = xxhash.xxh64_intdigest(label, parent.path) if parent else 0
        self.own = self.prose = self.total = self.every = 0.0
        self.chars = self.links = self.controls = self.votes = 0
        self.holds = tag in ARTICLE or tag == "h1"
        self.out = False


class Page:
    """Containers and blocks of one page; a block is (container, text, prose characters, its element).

    votes: what the host's pages say for cutting paths.
    """

    def __init__(self, source: str, votes: dict[int, int] | None = None):
        self.host_votes = votes or {}
        self.nodes = [Node(None, "", "", PLAIN)]
        self.blocks: list[tuple[Node, str, float, str]] = []
        self.stack: list[tuple[str, Node]] = [("", self.nodes[0])]
        self.open_blocks: list[int] = [0]  # places of containers and leaves in the stack
        self.count: dict[str, int] = {}  # open elements by tag
        self.pieces: list[str] = []
        self.link_chars = 0
        for kind, tag, rest in pieces(source):
            if kind == "text":
                self.text(rest)
            elif kind == "open":
                self.open(tag, rest)
            else:
                self.close(tag)
        self.flush()
        self.judge()

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.count.get("a"):
            self.link_chars += len(raw.strip())

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(entities.unescape("".join(self.pieces)).split())
            if text:
                leaf = self.stack[self.open_blocks[-1]][0]
                node = self.stack[-1][1]
                self.blocks.append((node, text, max(0.0, len(text) - 2.0 * self.link_chars), leaf))
                node.chars, node.links = node.chars + len(text), node.links + min(self.link_chars, len(text))
            self.pieces, self.link_chars = [], 0

    def push(self, tag: str, node: Node) -> None:
        if tag in CONTAINERS or tag in LEAVES:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, k: int) -> None:
        """Close what is open from place k on."""
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.count[tag] -= 1
        while self.open_blocks[-1] >= k:
            self.open_blocks.pop()

    def open(self, tag: str, attrs: str) -> None:
        if tag in CONTROLS:
            self.stack[-1][1].controls += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.pieces.append("\n")
            return
        if tag in CONTAINERS or tag in LEAVES:
            self.flush()
            self.end_leaf(tag)
        elif tag == "a":
            self.close("a")
        node = self.stack[-1][1]
        label, mark, plain = self.label(tag, attrs)
        if tag in CONTAINERS or mark != PLAIN:
            self.flush()  # what a marked element holds is another block
            node = Node(node, label, tag, mark, plain, bool(self.count.get("article")))
            self.nodes.append(node)
        elif tag == "h1":
            node.holds = True
        if not attrs.endswith("/") or tag not in ("svg", "math"):
            self.push(tag, node)

    def label(self, tag: str, attrs: str) -> tuple[str, int, bool]:
        """Name in a path, mark, and whether the mark's name is that of a page part and nothing else."""
        names, mark, label = [], GONE if tag in DROPPED else PLAIN, tag
        inside = any(self.count.get(t) for t in ARTICLE)
        doubt = plain = tag in DOUBTFUL and not (tag == "header" and inside)
        talk = False
        for m in ATTR.finditer(attrs) if attrs else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                if value.lower() in ROLES:
                    doubt = plain = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and NOT_SHOWN.search(value)):
                mark = GONE
            elif key in ("class", "id"):
                for name in value.split():
                    names.append((".#"[key == "id"]) + DIGITS.sub("0", name))
                    words = set(NAME_WORDS.findall(HUMPS.sub(" ", name).lower()))
                    if words & MODIFIERS or tag in ("html", "body"):
                        continue
                    own = not words - MARKS - COMMENTS - PARTS
                    if inside or words & OWN_HEADER:
                        words.discard("header")
                    spoken = bool(words & COMMENTS)
                    suspect = spoken or (tag not in ARTICLE and bool(words & MARKS))
                    talk, doubt, plain = talk or spoken, doubt or suspect, plain or (suspect and own)
        if mark == PLAIN and (talk or doubt):
            mark = TALK if talk else DOUBT
        return label + "".join(sorted(names)), mark, plain

    def end_leaf(self, tag: str) -> None:
        """An open paragraph (or item, cell, row) ends where the next block or one of its kind begins."""
        k = self.open_blocks[-1]
        open_tag = self.stack[k][0]
        if k and (open_tag == "p" or open_tag in ENDS.get(tag, ()) or (tag in HEADINGS and open_tag in HEADINGS)):
            self.cut(k)

    def close(self, tag: str) -> None:
        inline = tag not in CONTAINERS and tag not in LEAVES
        if not self.count.get(tag):
            if not inline:
                self.flush()
            return
        floor = self.open_blocks[-1] if inline else 0
        for k in range(len(self.stack) - 1, floor, -1):
            if self.stack[k][0] == tag:
                if not inline or self.stack[k][1] is not self.stack[k - 1][1]:
                    self.flush()
                self.cut(k)
                return

    def judge(self) -> None:
        """Which containers are outside the article, and the characters of prose in the others.

        A suspect that holds most of the prose is not cut: a form around the page, or a class that names its neighbour,
        must not take the article away.
        """
        for node, _, prose, _ in self.blocks:
            node.own += prose
        alike: dict[tuple[int, int], int] = {}  # containers with text by their parent and path: comments come as a list
        for node in self.nodes:
            node.prose = node.every = node.own
            if node.parent:
                key = (id(node.parent), node.path)
                alike[key] = alike.get(key, 0) + 1
        several: set[int] = set()
        for node in reversed(self.nodes):  # parents come before children
            up = node.parent
            if not up:
                continue
            if node.every and (alike[id(up), node.path] > 1 or id(node) in several):
                several.add(id(up))
            up.chars, up.links, up.controls = up.chars + node.chars, up.links + node.links, up.controls + node.controls
            if node.mark != GONE:
                up.every += node.every
            if node.mark != GONE and not (node.mark == TALK and node.plain):
                up.prose += node.prose
                up.holds = up.holds or node.holds
        whole, every = self.nodes[0].prose, self.nodes[0].every
        for node in self.nodes[1:]:
            node.votes = 0
            if node.mark == DOUBT or node.mark == TALK:
                if node.plain:
                    node.votes = 1 + (not node.inside) + (2 * node.links >= node.chars > 0) + (node.controls > 0) + (node.mark == TALK and id(node) in several)
                node.votes += self.host_votes.get(node.path, 0) if node.plain or self.host_votes.get(node.path, 0) >= ENOUGH else 0
            much = node.every >= 0.95 * every > 0 if node.mark == TALK else node.prose >= (0.3 if node.holds else 0.8) * whole and whole > 0
            node.out = node.parent.out or node.mark == GONE or (node.votes >= ENOUGH and not much)
        for node in self.nodes:
            node.total = 0.0 if node.out else node.own
        for node in reversed(self.nodes):
            if node.parent and not node.out:
                node.parent.total += node.total

    def suspects(self) -> list[tuple[int, int]]:
        """(path, hash of its text) of each element that is suspect and not cut by this page alone; paths once."""
        import xxhash

        near: dict[int, Node | None] = {}  # the innermost and the outermost suspect around each container
        far: dict[int, Node | None] = {}
        for node in self.nodes:  # parents come before children
            own = node if node.mark in (DOUBT, TALK) and not node.out else None
            up = id(node.parent) if node.parent else None
            near[id(node)], far[id(node)] = own or near.get(up), far.get(up) or own
        texts: dict[int, list[str]] = {}
        for node, text, _, _ in self.blocks:
            for path in {x.path for x in (near[id(node)], far[id(node)]) if x}:
                texts.setdefault(path, []).append(text)
        return [(path, xxhash.xxh64_intdigest("\n".join(own))) for path, own in texts.items()]

    def digest(self) -> int:
        import xxhash

        return xxhash.xxh64_intdigest("\n".join(text for _, text, _, _ in self.blocks))

    def best(self) -> tuple[Node, float] | None:
        """The container with the highest score (its own prose and half of its parts'), taken up to the article around it."""
        score = {id(n): n.own for n in self.nodes if not n.out}
        for node in self.nodes:
            if node.parent and not node.out:
                score[id(node.parent)] += 0.5 * node.own
        found = None
        for node in self.nodes:
            if not node.out and score[id(node)] > 0 and (found is None or score[id(node)] > score[id(found)]):
                found = node
        if found is None:
            return None
        value = score[id(found)]
        while (up := found.parent) and up.tag not in ("", "html", "body") and (up.total <= 2 * found.total or up.tag in ARTICLE):
            found = up
        return found, value

    def extract(self, path: int | None) -> str:
        """Text of the containers with the path, or with that of the best container if they hold next to nothing."""
        roots = [n for n in self.nodes if n.path == path and not n.out] if path is not None else []
        found = self.best()
        if not found:  # nothing but links: paragraphs of links are text, lists of links are menus
            return "\n".join(text for node, text, _, leaf in self.blocks if not node.out and (leaf == "p" or leaf in HEADINGS))
        if sum(n.total for n in roots) < 0.1 * found[0].total:
            roots = [n for n in self.nodes if n.path == found[0].path and not n.out]
        own = {id(n) for n in roots}
        inside: dict[int, bool] = {}
        for node in self.nodes:  # parents come before children
            inside[id(node)] = id(node) in own or (node.parent is not None and inside[id(node.parent)])
        return "\n".join(text for node, text, _, _ in self.blocks if not node.out and inside[id(node)])


def signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without its port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def readings(pages: DataFrame) -> DataFrame:
    """A row for each page's best container (host, path, score) and each suspect (host, path, text, page), written; pages has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                found, digest = page.best(), signed(page.digest())
                rows.append((host, signed(found[0].path) if found else None, found[1] if found else None, None, digest))
                rows += [(host, signed(path), None, signed(text), digest) for path, text in page.suspects()]
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "path", "score", "text", "page"])

    return common.materialize(pages.select("host", "html").mapInArrow(common.tidy(run), "host string, path bigint, score double, text bigint, page bigint"), "readings")


def winning_paths(read: DataFrame) -> DataFrame:
    """host, path: the path with the largest sum of scores of each host."""
    votes = read.where("score is not null").groupBy("host", "path").agg(F.sum("score").alias("score"))
    first = F.struct(F.round(-F.col("score"), 3), F.col("path"))
    return votes.groupBy("host").agg(F.min_by("path", first).alias("path"))


def cut_paths(read: DataFrame) -> DataFrame:
    """host, cut: the suspect paths (path, votes) that recur on the host: 1 for a usual path, 2 for one with a repeated text.

    Pages with the same text count once, so copies of a page do not vote for each other's sections.
    """
    pages = read.where("text is null").select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    same = read.where("text is not null").groupBy("host", "path", "text", "page").agg(F.lit(1).alias("one")).groupBy("host", "path", "text").agg(F.count("one").alias("n"))
    paths = same.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= SEVERAL, F.col("n")).otherwise(0)).alias("repeated"))
    recur = (F.col("n") >= SEVERAL) & (F.col("n") >= LEAST_SHARE * F.col("pages"))
    votes = F.when(2 * F.col("repeated") >= F.col("n"), 2).when(F.col("n") >= USUAL * F.col("pages"), 1).otherwise(0)
    voted = paths.join(pages, "host").where(recur).withColumn("votes", votes).where("votes > 0")
    return voted.groupBy("host").agg(F.collect_list(F.struct("path", "votes")).alias("cut"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    read = readings(rows)
    winners = common.materialize(winning_paths(read).join(cut_paths(read), "host", "full"), "winning-paths")
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(x or "", {c["path"] % (1 << 64): c["votes"] for c in cut or ()}).extract(None if path is None else path % (1 << 64))
                for x, path, cut in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "cut")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path", "cut").mapInArrow(common.tidy(run), f"page_id {kind}, url string, text string")
