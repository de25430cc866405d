"""Main-text extraction by consensus host paths.

Each page is parsed where it is read.  Its containers are scored by the text
they hold outside links and boilerplate, and the page votes for the
generalised tag-class path of its best container, and names the containers
beside it.  Votes are summed per host and path in Spark, and every page is
parsed again with its host's winning paths; a page that doesn't have them, or
whose text goes beyond them in containers that its host doesn't know, falls
back to its own container.  Sections beside the chosen container in one wrapper
stay with it, unless the host repeats their text from page to page.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _cluster as cl

#: A path counts for its host with this share of the host's votes, so it has 20 at most.
VOTES = 0.05
#: A container stands for its parent where it holds this share of the parent's score.
SHARE = 0.9
#: Text directly in a page's body below this share of it is stray.
STRAY = 0.05
#: Winning paths are broadcast up to this many bytes; beyond, a host's pages meet them in parts of so many pages.
BROADCAST_BYTES, PART = 32 << 20, 2000
#: A container beside the main text is fixed where the host's pages show at most this share of different texts in it.
VARIED = 0.5
#: A page leaves its host's path where that loses more than this share of its own choice, beside what its host knows as no main text.
LOST = 0.1

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|template|noscript|svg|iframe|select|title|object|canvas|math|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr2>[^>]*)>
    |<[!?/][^>]*>
    |<[a-zA-Z/!?][^<>]*\Z""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body article main section div td table center".split())
DROPPED = frozenset("head nav footer aside form menu dialog button input label fieldset legend option".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
# Words of class and id names that mark boilerplate, and ARIA roles that do.
BOILERPLATE = re.compile(
    r"(?:ad|ads|adv|adsense|adslot|adunit|advert\w*|sponsor\w*|promo\w*|banner\w*|side|sidebar\w*|nav|navbar\w*|navigation|menu\w*|breadcrumb\w*|footer\w*|foot|cookie\w*|consent\w*|gdpr|privacy|notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay\w*|newsletter\w*|subscri\w*|signup|login|comment\w*|disqus\w*|reply|replies|respond|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pager|pagination|copyright|skip|toolbar\w*|masthead|topbar|disclaimer)"
)
#: Such text is what its name says, however much of the page it holds.
DISCUSSION = re.compile(r"(?:comment\w*|disqus\w*|reply|replies|respond|discussion)")
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
PLAIN = frozenset("html body article main".split())


class Box:
    """A container; its path, tags and classes from the root, is kept as a digest, so that depth costs nothing."""

    __slots__ = ("own", "parent", "path", "score", "tag")

    def __init__(self, name, parent, tag):
        self.path = blake2b(f"{parent.path}/{name}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() if parent else ""
        self.parent, self.score, self.own, self.tag = parent, 0.0, 0.0, tag


def _attributes(attr: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attr)}


def _boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in ROLES:
        return True
    if tag in PLAIN and tag != "article":
        return False
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=\d)", "-", name))
        if words[0] in ("has", "with", "no", "without"):
            continue
        if any(BOILERPLATE.fullmatch(x) for x in words) or "header" in words and not in_article:
            return True
    return False


def _mixed(attrs: dict[str, str]) -> bool:
    """Whether a name that marks boilerplate also has words that don't, and none of discussion."""
    names = [re.findall(r"[a-z]+", x) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()]
    marked = [n for n in names if any(BOILERPLATE.fullmatch(x) or x == "header" for x in n)]
    return all(any(not BOILERPLATE.fullmatch(x) and x != "header" for x in n) and not any(DISCUSSION.fullmatch(x) for x in n) for n in marked)


def parse(html: str) -> tuple[list[tuple[str, Box]], list[Box]]:
    """(text blocks with their containers, containers) in page order, without boilerplate.

    An element that holds most of the page's text outside links isn't dropped
    for one word of its class or id, nor for being a form: pages of some
    frameworks are one form.
    """
    blocks, boxes, spared = _parse(html, frozenset())
    return _parse(html, spared)[:2] if spared else (blocks, boxes)


def _parse(html: str, spared: frozenset[int]) -> tuple[list[tuple[str, Box]], list[Box], frozenset[int]]:
    """Text blocks, containers, and the places of elements that would have to be spared."""
    root = Box("", None, "")
    boxes, blocks, stack = [root], [], []  # stack: (tag, box, dropped, link, place and text before it of a name to be judged)
    parts: list[str] = []
    linked = 0
    box, dropped, link, article = root, False, False, 0
    total, judged = 0, []  # characters outside links; (characters, place) of elements that their name marks

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((text, box))
                weight = max(0, len(text) - 2 * linked)
                box.own += weight
        linked = 0

    def pop():
        nonlocal box, dropped, link, article
        tag, box, dropped, link, name = stack.pop()
        if name:
            judged.append((total - name[1], name[0]))
        if tag == "article":
            article -= 1

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not link:
            total += len(html[at : m.start()].strip())
        if m.start() > at and not dropped:
            text = unescape(html[at : m.start()])
            parts.append(text)
            if link:
                linked += len(text)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and not dropped:
                parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph; list items and cells end their like
                open_tag = stack[k][0]
                if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                    while len(stack) > k:
                        pop()
                elif open_tag in SCOPES.get(tag, ()) or open_tag not in INLINE and tag not in CLOSES:
                    break
        attrs = _attributes(m["attr"] or m["attr2"] or "")
        outer = (tag, box, dropped, link)
        if tag == "article":
            article += 1
        marked, name = _boilerplate(tag, attrs, article > 0), None
        # A form is judged by what it holds, as an element is that one word of its name marks.
        if marked and not spared and not _boilerplate("div" if tag == "form" else tag, {k: v for k, v in attrs.items() if k not in ("class", "id")}, article > 0) and _mixed(attrs):
            name = (m.start(), total)
        stack.append((*outer, name))
        if marked and m.start() not in spared:
            dropped = True
        if tag == "a":
            link = True
        if tag in CONTAINERS and not dropped:
            names = ".".join(sorted(re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()))
            box = Box(f"{tag}.{names}" if names else tag, box, tag)
            boxes.append(box)
    if not link:
        total += len(html[at:].strip())
    if not dropped:
        parts.append(unescape(html[at:]))
    flush()
    while stack:
        pop()
    for b in reversed(boxes):  # children come after their parents
        b.score += b.own
        if b.parent is not None:
            b.parent.score += b.score
    return blocks, boxes, frozenset(place for n, place in judged if 2 * n > total)


def choice(boxes: list[Box]) -> Box:
    """The deepest container that holds most of what its parents hold.

    Goes no deeper than an article, nor past a container with blocks of its
    own: a heading beside a container belongs to what it heads.
    """
    children: dict[int, list[Box]] = {}
    for b in boxes[1:]:
        children.setdefault(id(b.parent), []).append(b)
    at = boxes[0]
    while True:
        inner = max(children.get(id(at), ()), key=lambda b: (b.score, b.tag == "article"), default=None)
        outer = at.tag in ("", "html", "body") and at.own < STRAY * at.score
        if inner is None or inner.score < SHARE * at.score or not inner.score or at.tag == "article" or at.own and not outer:
            return at
        at = inner


def best_path(boxes: list[Box]) -> tuple[str, float]:
    """The path and score of a page's own choice."""
    chosen = choice(boxes)
    return chosen.path, chosen.score


def beside(boxes: list[Box], chosen: Box) -> list[Box]:
    """The containers with text beside the chosen one and its parents."""
    within, line, at = set(), {id(chosen)}, chosen.parent
    while at is not None:
        within.add(id(at))
        line.add(id(at))
        at = at.parent
    return [b for b in boxes if id(b.parent) in within and id(b) not in line and b.score > 0 and b.path != chosen.path]


def texts_in(blocks: list[tuple[str, Box]], boxes: list[Box], wanted: list[Box]) -> dict[int, str]:
    """A digest of the text inside each of some containers that don't hold each other, by id."""
    owner = {id(b): id(b) for b in wanted}
    for b in boxes:  # parents come before their children
        if id(b.parent) in owner:
            owner.setdefault(id(b), owner[id(b.parent)])
    digests = {id(b): blake2b(digest_size=8) for b in wanted}
    for text, b in blocks:
        if id(b) in owner:
            digests[owner[id(b)]].update(text.encode("utf-8", "surrogatepass") + b"\n")
    return {k: d.hexdigest() for k, d in digests.items()}


def loses(boxes: list[Box], chosen: Box, path: str, asides: frozenset[str]) -> float:
    """How much of a page's own choice is neither in containers of the path nor in asides."""
    own, spoken, lost = set(), set(), 0.0
    for b in boxes:  # parents come before their children
        if b is chosen or id(b.parent) in own:
            own.add(id(b))
        if b.path == path or b.path in asides or id(b.parent) in spoken:
            spoken.add(id(b))
        elif id(b) in own:
            lost += b.own
    return lost


def widened(boxes: list[Box], path: str, fixed: frozenset[str]) -> tuple[set[int], set[int]]:
    """Containers of the path, or those around them that hold further sections beside them; and fixed ones among these, to be left out.

    What stands beside a container in the page's body itself belongs to the page.
    """
    children: dict[int, list[Box]] = {}
    for b in boxes[1:]:
        children.setdefault(id(b.parent), []).append(b)
    tops, line = set(), set()
    for b in boxes:
        if b.path != path:
            continue
        top, below, at = b, b, b.parent
        line.add(id(b))
        while at is not None and at.tag not in ("", "html", "body"):
            line.add(id(at))
            if any(c is not below and c.score > 0 and c.path != path and c.path not in fixed for c in children[id(at)]):
                top = at
            below, at = at, at.parent
        tops.add(id(top))
    return tops, {id(b) for b in boxes if b.path in fixed and id(b) not in line}


def text_of(blocks: list[tuple[str, Box]], boxes: list[Box], path: str, fixed: frozenset[str] = frozenset()) -> str:
    """Blocks inside the containers of the path and the sections beside them, joined by line feeds."""
    inside, out = widened(boxes, path, fixed)
    for b in boxes:
        if id(b.parent) in inside and id(b) not in out:
            inside.add(id(b))
    return "\n".join(text for text, b in blocks if id(b) in inside)


def extract(html: str | None, paths: list[str], asides: list[str] = (), fixed: list[str] = ()) -> str:
    """A page's main text by the first of its host's paths that loses nearly nothing, else by its own.

    Text in asides, which the host's pages have beside their main text, is no
    loss; fixed are those whose text the host repeats.
    """
    if not html:
        return ""
    blocks, boxes = parse(html)
    chosen, known = choice(boxes), frozenset(asides)
    held = {b.path for b in boxes if b.score > 0}
    for path in paths:
        if path in held and loses(boxes, chosen, path, known) <= LOST * chosen.score:
            return text_of(blocks, boxes, path, frozenset(fixed))
    return text_of(blocks, boxes, chosen.path, frozenset(fixed))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Columns of pages with text_col: the main text, empty where there is none.

    Null and empty pages give an empty text.  Pages without a host agree among
    themselves like those of a host.  A column of pages named text_col gives
    way.  Empty tables give empty results; repeated rows vote once each.  Of
    paths of equally many votes the one of the smaller digest is tried first.
    """
    cl.ship(pages.sparkSession)
    others = [c for c in pages.columns if c != text_col]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def vote(batches):
        for batch in batches:
            found = []  # (host, path, 1 for a vote, 1 for a container beside it, digest of that one's text)
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, boxes = parse(html) if html else ([], [])
                chosen = choice(boxes) if boxes else None
                if chosen is not None and chosen.score > 0:
                    found.append((name, chosen.path, 1, 0, None))
                    others = beside(boxes, chosen)
                    said = texts_in(blocks, boxes, others)
                    found.extend((name, path, 0, 1, text) for path, text in {b.path: said[id(b)] for b in others}.items())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["host", "path", "n", "aside", "said"])

    cast = pages.select(host.alias("host"), F.col(f"`{html_col}`")).mapInArrow(vote, "host string, path string, n bigint, aside bigint, said string")
    votes = cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("aside").alias("aside"), F.approx_count_distinct("said", 0.02).alias("texts"))
    of_host = Window.partitionBy("host")
    wins = F.col("n") >= VOTES * F.col("all")
    enough = votes.withColumn("all", F.sum("n").over(of_host)).where(wins | (F.col("aside") >= VOTES * F.col("all")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(wins, F.struct((-F.col("n")).alias("n"), "path")))), lambda x: x["path"])
    winners = cl.cut(enough.groupBy(F.col("host").alias("_host")).agg(listed.alias("_paths"), F.collect_list(F.when(~wins, F.col("path"))).alias("_asides"), F.collect_list(F.when((F.col("aside") > 1) & (F.col("texts") <= VARIED * F.col("aside")), F.col("path"))).alias("_fixed"), F.first("all").alias("_n")))
    dealt = pages.select(host.alias("_host"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    size = winners.agg(F.sum(F.octet_length("_host") + 64 + 32 * (F.size("_paths") + F.size("_asides") + F.size("_fixed")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = dealt.join(F.broadcast(winners.drop("_n")), "_host", "left").select("_paths", "_asides", "_fixed", "_row")
    else:
        # In turn, so that a host or a page that many rows repeat is spread as well; large hosts only, by their votes.
        large = winners.where(F.col("_n") > PART).select("_host", F.ceil(F.col("_n") / PART).cast("int").alias("_parts"))
        spread = dealt.join(F.broadcast(large) if large.count() * PART <= BROADCAST_BYTES else large, "_host", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int"))
        each = winners.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / PART).cast("int") - 1)))).drop("_n")
        joined = spread.join(each, ["_host", "_part"], "left").select("_paths", "_asides", "_fixed", "_row")
    out = T.StructType([f for f in pages.schema.fields if f.name != text_col] + [T.StructField(text_col, T.StringType())])

    def again(batches):
        for batch in batches:
            row = batch.column(3)
            columns = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
            texts = [extract(html, paths or [], asides or [], fixed or []) for paths, asides, fixed, html in zip(*[batch.column(k).to_pylist() for k in range(3)], columns[html_col].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == text_col else columns[f.name] for f in out.fields], names=[f.name for f in out.fields])

    return joined.mapInArrow(again, out)
