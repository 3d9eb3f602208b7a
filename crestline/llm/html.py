"""Main text of web pages by consensus of their hosts.

Each container of a page votes with the text that it holds itself. Votes are
counted in Spark by host and path, the tags from the root with their classes or
ids, numbers made alike. The path with most text, every distinct text counted
once, is the host's content. What says the same on pages whose content differs
is boilerplate of the host, as are parts that are called so and lists of links
beside the content. Pages are then extracted anew: all of a page that their
host's votes leave, and what lies around the host's content stays, however it is
called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import slices
from crestline.llm.common import written

#: Fixed values of HTML: elements without content, with text that is no markup, that begin a block, and that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend".split())
#: An element that ends the one before it: by its start tag, the elements it ends and those that it looks no further than.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never main text, by tag and by a whole name in class or id; a name of several words counts if all are listed or only say where or what part.
DROPPED = frozenset("script style noscript template svg math canvas iframe object embed head title nav header footer aside form button select option input textarea label menu dialog audio video map search".split())
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar comment comments comentarios kommentare commentaires disqus reply replies respond notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay toolbar pagination pager skip hidden toc adbox copyright discussion disclaimer".split())
PART_WORDS = frozenset("site page global main top bottom primary secondary list items item area box block slot unit bar link links button buttons icons form section posts articles stories left right center wrap wrapper container inner outer col column row user reader readers fb holder panel".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
CONTAINERS = frozenset("article main section div td body".split())
#: What may be a list of links; like a container, it votes for itself.
VOTERS = CONTAINERS | frozenset("ul ol dl table".split())
#: Of the host's pages with different content, as many have to say the same, and half of those with the path.
LEAST_SAME = 3
#: Hundredths of a part's text in links from which it is a list of links.
LINKS = 80
P_SCOPE = frozenset("article section div td th li blockquote body button table".split())
#: Of the elements that a start tag may end: a name for each set, the set, and what ends the search for it.
NEAR = {"p": (frozenset({"p"}), P_SCOPE)} | {tag: (frozenset(found), frozenset(stop)) for tag, (found, stop) in ENDS.items()}
SCOPED = frozenset().union(*(found | stop for found, stop in NEAR.values()))
OPENING = re.compile(r"<(?:(!--)|(!)|(\?)|(/?)([a-zA-Z][^\s/>]*+))")
#: A tag up to its end, or to a quote that nothing closes.
TO_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")


class Element:
    """key is the path from the root as a number; near holds the elements that a start tag within may end.

    A voter counts the text that is nearest to it (own, and links of it) and
    hashes it; chars and linked are those of all that lies in an element.
    """

    __slots__ = ("tag", "label", "key", "parent", "dropped", "named", "n_named", "clean", "depth", "content", "near", "voter", "in_link", "own", "links", "said", "chars", "linked")

    def __init__(self, tag: str, label: str, parent: "Element | None", dropped: bool, named: bool = False):
        self.tag, self.label, self.parent, self.dropped, self.named, self.clean = tag, label, parent, dropped, named, 0
        self.content: list = []
        self.own = self.links = self.chars = self.linked = 0
        self.said = None
        if parent is None:
            self.key, self.depth, self.near, self.voter, self.in_link, self.n_named = 0, 0, {}, self, False, 0
            return
        self.key = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=parent.key)
        self.depth, self.near, self.n_named = parent.depth + 1, parent.near, parent.n_named + named
        self.voter, self.in_link = self if tag in VOTERS else parent.voter, parent.in_link or tag == "a"
        if tag in SCOPED:
            self.near = dict(parent.near)
            for name, (found, stop) in NEAR.items():
                if tag in stop:
                    self.near.pop(name, None)
                if tag in found:
                    self.near[name] = self

    def says(self, shown: str) -> None:
        if (words := shown.split()) and not self.dropped:
            n, voter = sum(map(len, words)), self.voter
            self.chars += n
            voter.own += n
            if self.in_link:
                self.linked += n
                voter.links += n
            voter.said = voter.said or xxhash.xxh3_64()
            voter.said.update(" ".join(words).encode("utf-8", "surrogatepass"))

    @property
    def path(self) -> str:
        labels, at = [], self
        while at is not None and at.parent is not None:
            labels.append(at.label)
            at = at.parent
        return "".join(f">{x}" for x in reversed(labels))


def label(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its class, or else its id, numbers made alike."""
    name = " ".join(sorted(attributes.get("class", "").lower().split())[:2]) or attributes.get("id", "").lower()
    return f"{tag}.{re.sub(r'[0-9]+', '#', name).replace(' ', '.')}" if name else tag


def is_dropped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def is_named_dropped(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a whole name in class or id is one of boilerplate: sidebar, site-footer, but not with-sidebar or menu-open."""
    # An article, main part or body is what its tag says, whatever else it is called.
    if tag in ("body", "html", "main", "article"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = WORDS.findall(name)
        if not DROPPED_WORDS.isdisjoint(words) and all(w in DROPPED_WORDS or w in PART_WORDS for w in words):
            return True
    return False


def tags(html: str):
    """(from, to, name, closing, attributes as written) of each piece of markup; name is None for comments and declarations.

    One scan forward: a quote that nothing closes counts for nothing, and once
    quotes have swallowed all that is left, the other tags end at their next >.
    """
    at, last, quoted = 0, html.rfind(">"), True
    while (m := OPENING.search(html, at)) and (m.start() < last or m[1]):
        at = m.end()
        if m[1]:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
            yield m.start(), at, None, False, ""
            continue
        end = html.find(">", at)
        if m[5] and quoted and end >= 0:
            stop = TO_END.match(html, at).end()
            if stop == len(html):
                quoted = False
            else:
                end = html.find(">", stop)
        if end < 0:
            return
        begin, at = at, end + 1
        yield m.start(), at, m[5].lower() if m[5] else None, bool(m[4]), html[begin:end]


def attributes_of(written: str) -> dict[str, str]:
    if not written.strip(" /"):
        return {}
    return {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(written)}


def tree(html: str) -> list[Element]:
    """The page's elements in order; content holds texts and elements in order. Time and memory grow with the page's length."""
    root = Element("#root", "", None, False)
    elements, open_, n_open = [root], root, Counter()

    def text(raw: str) -> None:
        if raw:
            shown = unescape(raw)
            open_.content.append(shown)
            open_.says(shown)

    def close(until: Element) -> None:
        nonlocal open_
        while open_ is not until:
            up = open_.parent
            up.chars += open_.chars
            up.linked += open_.linked
            n_open[open_.tag] -= 1
            open_ = up

    size, done, ends = len(html), 0, {}
    for start, end, tag, closing, attributes in tags(html):
        if start < done:
            continue  # within a script or the like
        text(html[done:start])
        done = end
        if tag is None:
            continue
        if closing:
            if n_open[tag]:
                found = open_
                while found.tag != tag:
                    found = found.parent
                close(found.parent)
            continue
        if tag in ENDS_P and (found := open_.near.get("p")) is not None:
            close(found.parent)
        if tag in ENDS and (found := open_.near.get(tag)) is not None:
            close(found.parent)
        named = attributes_of(attributes)
        element = Element(tag, label(tag, named), open_, open_.dropped or is_dropped(tag, named), is_named_dropped(tag, named))
        open_.content.append(element)
        elements.append(element)
        if tag in RAW:
            if ends.get(tag, 0) is not None:  # None once no end tag of this kind is left
                ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, done)
            found = ends[tag]
            if tag in ("title", "textarea"):
                element.content.append(unescape(html[done : found.start() if found else size]))
            done = found.end() if found else size
        elif tag not in VOID:
            n_open[tag] += 1
            open_ = element
    text(html[done:])
    close(root)
    return elements


def parse(html: str, winner: int | None = None, same: Collection[tuple[int, int]] = ()) -> list[Element]:
    """tree(html) with the boilerplate dropped, by the host's winning path and what its pages have in common, or by the page alone."""
    elements = tree(html)
    settle(elements, winner, same)
    return elements


def content_of(elements: list[Element], winner: int | None) -> list[Element]:
    """The elements at the winning path, or else those at the page's own: least often called boilerplate, then with most text that is no link."""
    here = [e for e in elements if e.key == winner and e.own and not e.dropped] if winner is not None else []
    if here:
        return here
    votes: dict[int, list] = {}
    for e in elements:
        if e.own > e.links and not e.dropped:
            vote = votes.setdefault(e.key, [-e.n_named, 0, []])
            vote[1] += e.own - e.links
            vote[2].append(e)
    return max(votes.values(), key=lambda v: v[:2])[2] if votes else []


def settle(elements: list[Element], winner: int | None, same: Collection[tuple[int, int]]) -> None:
    """Drops what is called boilerplate, what all pages say and lists of links beside the content, but nothing around the content.

    If that leaves no text, the page is made of such parts: then links stay, then what pages say alike, then all.
    """
    content = content_of(elements, winner)
    around, within = set(), {id(e) for e in content}
    for e in content:
        while e is not None and id(e) not in around:
            around.add(id(e))
            e = e.parent
    by_tag = {id(e) for e in elements if e.dropped}
    for rules in ("named same links", "named same", "named", ""):
        inside = set(within)
        for e in elements[1:]:
            if id(e.parent) in inside:
                inside.add(id(e))
            e.dropped = id(e) in by_tag or e.parent.dropped
            if e.dropped or id(e) in around:
                continue
            named = "named" in rules and e.named
            alike = "same" in rules and e.said is not None and (e.key, e.said.intdigest()) in same
            listed = "links" in rules and e.tag in VOTERS and id(e) not in inside and e.chars and 100 * e.linked >= LINKS * e.chars
            e.dropped = bool(named or alike or listed)
        for e in elements:
            e.clean = 0
        for e in reversed(elements):
            if not e.dropped:
                e.clean += sum(sum(map(len, x.split())) for x in e.content if isinstance(x, str))
                if e.parent is not None:
                    e.parent.clean += e.clean
        if elements[0].clean:
            return


def best_container(elements: list[Element]) -> Element | None:
    """The smallest container with all of the page's clean text, in links or not; they lie in each other, so it is the deepest."""
    total = elements[0].clean
    if not total:
        return None
    return max((e for e in elements if e.tag in CONTAINERS and not e.dropped and e.clean == total), key=lambda e: e.depth, default=elements[0])


def main_text(elements: list[Element]) -> str:
    """The blocks in the given elements: white space in a block is one space, a line each, empty ones left out."""
    blocks: list[list[str]] = [[]]
    stack = [(e, 0) for e in reversed(elements)]
    while stack:
        element, at = stack.pop()
        is_block = element.tag in BLOCKS
        if not at and is_block and blocks[-1]:
            blocks.append([])
        while at < len(element.content):
            x = element.content[at]
            at += 1
            if isinstance(x, str):
                blocks[-1].append(x)
            elif x.tag == "br":
                blocks[-1].append(" ")
            elif not x.dropped:
                stack.append((element, at))
                stack.append((x, 0))
                break
        else:
            if is_block and blocks[-1]:
                blocks.append([])
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(line for line in lines if line)


def page_host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _votes(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its html), path, said (a hash of the text), chars, links, named: a row for each path and text of a page that elements hold themselves."""

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 1):
                rows = []
                for url, html in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts, strict=True):
                    host, page = page_host(url), xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "surrogatepass"))
                    said: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for e in tree(html or ""):
                        if e.own and not e.dropped:
                            said[e.key - (1 << 63), e.said.intdigest() - (1 << 63)] = e.own, e.links, e.n_named
                    rows += [(host, page - (1 << 63), *key, *rest) for key, rest in said.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "page", "path", "said", "chars", "links", "named"])

    return pages.select("url", "html").mapInArrow(run, "host string, page long, path long, said long, chars long, links long, named long")


def verdicts(pages: DataFrame) -> DataFrame:
    """host, winner (a path), same (paths with what is said there alike), each path less 2^63.

    The winner is the path that is least often called boilerplate, then that
    with most text beside links, each distinct text counted once, then the
    least number. A text at another path is said alike if it is on
    LEAST_SAME pages or more whose content, the text at the winner, differs,
    and on half of those with that path. All are aggregates, so a host may
    have a third of all pages; what is alike lies on half of a path's pages,
    so a host has two such texts for each path at most.
    """
    votes = written(_votes(pages), "votes")
    texts = votes.groupBy("host", "path", "said").agg(F.max(F.col("chars") - F.col("links")).alias("prose"), F.min("named").alias("named"))
    paths = texts.groupBy("host", "path").agg(F.sum("prose").alias("prose"), F.min("named").alias("named")).where("prose > 0")
    # Structs compare in order: fewer names, more text, the smaller path.
    best = F.min(F.struct("named", (-F.col("prose")).alias("prose"), "path"))
    winners = written(paths.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("winner")), "winners")
    marked = votes.join(winners, "host")
    content = marked.where("path = winner").select("host", "page", "said").distinct().groupBy("host", "page").agg(F.bit_xor("said").alias("content"))
    beside = marked.where("path <> winner").select("host", "page", "path", "said").distinct().join(content, ["host", "page"], "left")
    each = beside.select("host", "path", "said", F.coalesce("content", "page").alias("content")).distinct()
    alike = each.groupBy("host", "path", "said").agg(F.count("*").alias("n"))
    whole = each.select("host", "path", "content").distinct().groupBy("host", "path").agg(F.count("*").alias("of"))
    same = alike.where(F.col("n") >= LEAST_SAME).join(whole, ["host", "path"]).where("2 * n >= of")
    listed = same.groupBy("host").agg(F.collect_list(F.struct("path", "said")).alias("same"))
    return winners.join(listed, "host", "left")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), path (of the content) of each row.

    Null html counts as empty and gives an empty text, as does a page without
    clean text. Pages whose URL is null or has no host make up one host. Ids
    play no part; repeated rows are repeated in the result, and count once
    where pages are counted.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # A small written table: Spark broadcasts it while its size allows, and else joins by host.
    found = written(verdicts(rows), "verdicts")

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([page_host(u) for u in batch.column(1).to_pylist()])], names=["page_id", "url", "html", "host"])

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch, 2):
                out, paths = [], []
                verdict = (batch.column(k).slice(start, len(texts)).to_pylist() for k in (3, 4))
                for html, winner, same in zip(texts, *verdict, strict=True):
                    alike = {(x["path"] + (1 << 63), x["said"] + (1 << 63)) for x in same or ()}
                    path = None if winner is None else winner + (1 << 63)
                    elements = parse(html or "", path, alike)
                    out.append(main_text(elements[:1]))
                    content = [e for e in content_of(elements, path) if not e.dropped]
                    paths.append(content[0].path if content else None)
                kinds = [batch.column(k).slice(start, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kinds, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    kind = rows.schema["page_id"].dataType.simpleString()
    hosted = rows.mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    joined = hosted.join(found, "host", "left").select("page_id", "url", "html", "winner", "same")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")
