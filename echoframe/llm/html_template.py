"""Main text of web pages by template deduction over all pages of a host.

Pages of a host are made from a template.  A page is read as tokens in context:
opening and closing tags of containers and whole blocks of text, each with the
elements around it.  Over the pages of a host every token has an occurrence
vector, how often it is on each page; tokens with equal vectors form an
equivalence class (Arasu and Garcia-Molina, "Extracting Structured Data from Web
Pages", 2003).  A class is valid if it has enough tokens and pages, and on a
page if its tags come there in the class's order.  Elements whose tags are in
valid classes are the template's and nest by the document tree; what stands
between is in slots.  Text that the template makes has no weight, but for what
articles share; what a slot weighs is the other unlinked text, on the mean over
all pages of the host.
The slot of a page is found from the root down: into the element that outweighs
the others, until an element has varying text of its own.

1. One pass counts.  Vectors are folded to one number per token with exclusive
   or, so tasks hand on sums and no task sees a whole host.
2. Classes, elements and weights are joins and grouped sums of that table.
3. A second pass reads each page by its host's template; pages are not shuffled
   for it while all templates are few enough to be broadcast.

A host of few pages has no classes.  Its pages are read by the classes of the
whole table, if there are any, or else by their own elements and their weights.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .words import text_slices

#: A valid class has so many tokens, on so many pages and such a share of the host's.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 3, 4, 0.05
#: An element with such a share of the heaviest one's weight is main text too.
BESIDE = 0.25
#: An element with such a share of its weight outside of inner elements is not left for them.
OWN = 0.05
#: How much more the text in ``article`` and ``main`` weighs, and these elements among others.
PREFERRED = 32
#: Elements of all templates together that are broadcast, some tens of megabytes.
MOST_BROADCAST = 200_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select|button|title)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TARGET = re.compile(r"(?:^|\s)href\s*=", re.I)
_DIGITS = re.compile(r"\d+")

# Elements of HTML by what they mean here.
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3"}
_CONTEXT = _ASIDE | _MAIN | {"html", "body", "section", "div", "ul", "ol", "table", "tbody", "tr", "td", "th", "dl", "blockquote", "figure", "details", "fieldset"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_IN_HEAD = {"meta", "link", "base"}
#: Elements of these kinds can stand around a whole page, as a form does, or be left
#: open before it; an aside with so many unlinked characters of its own is such a one.
_AROUND, LEAST_AROUND = {"form", "nav", "menu", "header"}, 150
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

ROOT = 0
_EVERY = "*"  # in place of a host: the whole table
_REMEMBER = 200_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@dataclass(slots=True)
class Place:
    """An element in its context; elements of like names in like contexts are one."""

    path: int
    around: tuple[int, ...]  # from the root to itself
    name: str
    main: bool  # is or is in a main element
    asides: tuple[int, ...]  # what is aside by kind or role, of those around and itself
    opens: int = 0  # its tokens
    closes: int = 0


@dataclass(slots=True)
class Block:
    text: str
    path: int
    plain: int  # characters outside of links
    heading: bool
    at: int  # among the page's tokens
    token: int


@dataclass
class Page:
    tags: list[tuple[int, int, int]] = field(default_factory=list)  # token, place, position
    blocks: list[Block] = field(default_factory=list)
    places: dict[int, Place] = field(default_factory=dict)
    whole: set[int] = field(default_factory=set)  # asides that hold the page's main text

    def aside(self, path: int) -> bool:
        asides = self.places[path].asides
        return bool(asides) and not self.whole.issuperset(asides)

    def settle(self) -> None:
        """Find asides that the main text is in: around the only main elements there are,
        or of a kind that can stand around all and with more unlinked text of their own
        than there is outside of any aside."""
        while True:
            outer = {p: next((a for a in x.asides if a not in self.whole), None) for p, x in self.places.items()}
            if not any(outer.values()) or any(x.main and outer[p] is None for p, x in self.places.items()):
                return
            around = {outer[p] for p, x in self.places.items() if x.main and self.places[outer[p]].name not in ("nav", "menu", "footer")}
            if not around:
                # Own text: not in an aside further inside.
                own, outside = defaultdict(int), 0
                for b in self.blocks:
                    left = [a for a in self.places[b.path].asides if a not in self.whole]
                    if not left:
                        outside += b.plain
                    elif len(left) == 1:
                        own[left[0]] += b.plain
                inner = {outer[p] for p, x in self.places.items() if len([a for a in x.asides if a not in self.whole]) > 1}
                around = {
                    p for p, n in own.items()
                    if self.places[p].name in _AROUND and n > outside and (n >= LEAST_AROUND or (self.places[p].name == "form" and p in inner))
                }
            if not around:
                return
            self.whole |= around


class Reader:
    """Reads pages; what it remembers of places is bounded."""

    def __init__(self):
        self.root = Place(ROOT, (ROOT,), "", False, ())
        self.inner: dict[tuple, Place] = {}

    def enter(self, outer: Place, name: str, attributes: str) -> Place:
        key = (outer.path, name, attributes)
        known = self.inner.get(key)
        if known is not None:
            return known
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        role = found.get("role", "").lower()
        label = _DIGITS.sub("#", f"{name} {found.get('class', '')} {found.get('id', '')} {role}")  # numbers in names differ from page to page
        path = xxhash.xxh3_64_intdigest(label.encode(), outer.path & 0x7FFFFFFFFFFFFFFF) >> 2 or 1
        part = name in _MAIN or role == "main"
        own = name == "header" and outer.main  # an article's own header is kept
        asides = (*outer.asides, path) if (name in _ASIDE and not own) or role in _ASIDE_ROLES else outer.asides
        made = Place(path, (*outer.around, path), name if not part else "main", outer.main or part, asides, path << 1, path << 1 | 1)
        if len(self.inner) >= _REMEMBER:
            self.inner.clear()
        self.inner[key] = made
        return made

    def read(self, html: str) -> Page:
        page, stack, at, links, heading, count = Page(), [self.root], 0, 0, 0, 0
        last, link_in, link_deep = "", "", 0  # the last block that was opened, and those around the open link
        places = page.places
        places[ROOT] = self.root
        pieces: list[str] = []
        plain = 0

        def end() -> None:
            nonlocal plain, count
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                if stack[-1].name == "head":
                    stack.pop()  # text ends it
                place = stack[-1]
                token = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), place.path) | 1 << 63
                page.blocks.append(Block(text, place.path, plain, heading > 0, count, token))
                count += 1
            plain = 0

        def hold(piece: str) -> None:
            nonlocal plain
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if not links:
                plain += len(piece) - piece.count(" ")

        for m in _MARKUP.finditer(html):
            if m.start() > at:
                hold(html[at : m.start()])
            at = m.end()
            name = m.group(3)
            if name is None:
                if m.group(1):
                    pieces.append(" ")
                continue
            name, closing = name.lower(), m.group(2)
            if name == "a":
                # An anchor without a target is no link, and one that is left open ends with its block.
                links = 0 if closing or not _TARGET.search(m.group(4)) else 1
                link_in, link_deep = last, len(stack)
            if name in _INLINE:
                continue
            end()
            if closing and name == link_in:
                links = 0
            if not closing:
                last = name
                if stack[-1].name == "head" and name not in _IN_HEAD:
                    stack.pop()
            if name in _HEADINGS:
                heading = 0 if closing else 1
            if name not in _CONTEXT:
                continue
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name or (stack[i].name == "main" and name in _MAIN):
                        page.tags.append((stack[i].closes, stack[i].path, count))
                        count += 1
                        del stack[i:]
                        if len(stack) < link_deep:
                            links = 0
                        break
            else:
                if name in _MAIN:
                    # A menu that was left open ends where the main text begins.
                    open_menu = next((i for i, x in enumerate(stack) if x.name in ("nav", "menu")), None)
                    if open_menu is not None:
                        del stack[open_menu:]
                place = self.enter(stack[-1], name, m.group(4))
                stack.append(place)
                places[place.path] = place
                page.tags.append((place.opens, place.path, count))
                count += 1
        if at < len(html):
            hold(html[at:])
        end()
        page.settle()
        return page


def weights(page: Page) -> dict[int, tuple[float, float, float]]:
    """Of every element of one page: the weight of all in it, what is outside of
    inner elements, and how much of that is headings."""
    held, own, heads = defaultdict(float), defaultdict(float), defaultdict(float)
    for b in page.blocks:
        if not page.aside(b.path):
            weight = b.plain * (PREFERRED if page.places[b.path].main else 1)
            own[b.path] += weight
            heads[b.path] += weight * b.heading
            for p in page.places[b.path].around:
                held[p] += weight
    return {p: (held[p], own[p], heads[p]) for p in page.places}


@dataclass
class Template:
    """Elements with their class and weights, and the tags of each class in order."""

    elements: dict[int, tuple[int, tuple[float, float, float]]]
    classes: dict[int, list[int]]

    @staticmethod
    def of(text: str | None) -> "Template | None":
        if not text:
            return None
        held = json.loads(text)
        return Template(
            {e["path"]: (e["class"], (e["held"], e["own"], e["heads"])) for e in held["elements"]}, {c["class"]: c["tags"] for c in held["classes"]}
        )

    def on(self, page: Page) -> dict[int, tuple[float, float, float]]:
        """The weights of the elements of this page that valid classes make."""
        class_of = {t: c for c, tags in self.classes.items() for t in tags}
        seen: dict[int, list[int]] = defaultdict(list)
        for t, _, _ in page.tags:
            if t in class_of:
                seen[class_of[t]].append(t)
        good = {c for c, tags in seen.items() if tags == self.classes[c] * (len(tags) // len(self.classes[c]))}
        return {p: e[1] for p in page.places if (e := self.elements.get(p)) and (p == ROOT or e[0] in good)}


def main_elements(page: Page, weight: dict[int, tuple[float, float, float]]) -> list[int]:
    """The elements that hold the page's main text, given the weights of some."""
    places = page.places
    inside = defaultdict(list)
    for p in weight:
        if p != ROOT and not page.aside(p):
            inside[next((a for a in reversed(places[p].around[:-1]) if a in weight), ROOT)].append(p)
    here = defaultdict(int)  # characters on this page outside of inner elements
    for b in page.blocks:
        if not page.aside(b.path):
            here[next((a for a in reversed(places[b.path].around) if a in weight), ROOT)] += b.plain
    now = ROOT
    while inside[now]:
        kids = inside[now]
        held, own, heads = weight.get(now, (0.0, 0.0, 0.0))
        if here[now] and (heads > 0 or own > OWN * held) or (places[now].name == "main" and not any(places[k].name == "main" for k in kids)):
            break
        score = {k: weight[k][0] * (PREFERRED if places[k].name == "main" else 1) for k in kids}
        best = max(score.values())
        kept = [k for k in kids if score[k] >= BESIDE * best and best > 0]
        if len(kept) != 1:
            return kept or [now]
        now = kept[0]
    return [now]


def main_text(page: Page, templates: list[Template | None]) -> str:
    """The page's main text by the first template that makes an element of it; if
    nothing varies, as with copies of one page, a template says nothing."""
    for t in templates:
        weight = t.on(page) if t else {}
        if len(weight) > 1 and weight[ROOT][0] > 0:
            break
    else:
        weight = weights(page)
    main = set(main_elements(page, weight))
    inside = {p for p, place in page.places.items() if not page.aside(p) and not main.isdisjoint(place.around)}
    return " ".join(b.text for b in page.blocks if b.path in inside)


def count_page(page: Page, salt: int) -> list[tuple]:
    """Rows of one page: (kind, token, path, vector, times, plain, heads, salt, at,
    around), of which kind 0 are tags, 1 blocks and 2 elements."""
    times: dict[int, list] = {}
    for t, p, at in page.tags:
        row = times.setdefault(t, [0, t, p, 0, 0, 0, at])
        row[3] += 1
    for b in page.blocks:
        row = times.setdefault(b.token, [1, b.token, b.path, 0, 0, 0, b.at])
        row[3] += 1
        if not (page.aside(b.path) or page.places[b.path].main):  # what articles share is their own
            row[4] += b.plain
            row[5] += b.plain * b.heading
    out = [(k, t, p, xxhash.xxh3_64_intdigest(n.to_bytes(8, "big"), salt), n, plain, heads, salt, at, None) for k, t, p, n, plain, heads, at in times.values()]
    for p, (_, own, heads) in weights(page).items():
        out.append((2, p, p, 0, 1, int(own), int(heads), 0, 0, page.places[p].around))
    return out


_COUNTS = "host string, kind int, token long, path long, vector long, n long, times long, plain long, heads long, salt long, at int, around array<long>"


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of one key as one row; ``first`` is its place on the page of smallest salt."""
    return rows.groupBy(*keys).agg(
        F.min("path").alias("path"), F.bit_xor("vector").alias("vector"), F.sum("n").alias("n"), F.sum("times").alias("times"), F.sum("plain").alias("plain"),
        F.sum("heads").alias("heads"), F.min("first").alias("first"), F.max("around").alias("around"),
    )


def token_counts(rows: DataFrame) -> DataFrame:
    """One row per host and token, from ``rows`` (page_id, url, html, host)."""

    def flush(held: dict):
        keys, values = list(held), list(held.values())
        for lo in range(0, len(keys), 1 << 16):
            k, v = keys[lo : lo + (1 << 16)], values[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.int32()), pa.array([_signed(x[2]) for x in k], pa.int64()),
                    pa.array([x[0] for x in v], pa.int64()), pa.array([_signed(x[1]) for x in v], pa.int64()),
                    *(pa.array([x[i] for x in v], pa.int64()) for i in (2, 3, 4, 5)), pa.array([_signed(x[6]) for x in v], pa.int64()),
                    pa.array([x[7] for x in v], pa.int32()), pa.array([x[8] for x in v], pa.list_(pa.int64())),
                ],
                ["host", "kind", "token", "path", "vector", "n", "times", "plain", "heads", "salt", "at", "around"],
            )

    def run(batches):
        reader, held = Reader(), {}
        for b in batches:
            for page_id, url, html, host in _pages(b):
                salt = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass"), xxhash.xxh3_64_intdigest(f"{page_id} {url}".encode("utf-8", "surrogatepass")))
                for kind, token, path, vector, n, plain, heads, salt_, at, around in count_page(reader.read(html), salt):
                    row = held.get((host, kind, token))
                    if row is None:
                        held[host, kind, token] = [path, vector, 1, n, plain, heads, salt_, at, around]
                    else:
                        row[1] ^= vector
                        row[2] += 1
                        row[3] += n
                        row[4] += plain
                        row[5] += heads
                        if _signed(salt_) < _signed(row[6]):
                            row[6:8] = salt_, at
            if len(held) > 1 << 18:
                yield from flush(held)
                held = {}
        yield from flush(held)

    parts = rows.mapInArrow(run, _COUNTS)
    return _merged(parts.withColumn("first", F.struct("salt", "at")), "host", "kind", "token")


def _pages(batch):
    for at, n in text_slices(batch.column(2)):
        yield from zip(*[batch.column(i).slice(at, n).to_pylist() for i in range(4)])


def templates(counts: DataFrame) -> DataFrame:
    """(host, template as JSON) of every host that has valid classes, and of the
    whole table under the host ``*``.  A host's tokens that reach the least share of
    its pages are at most one over the share times those of a page, so one row
    holds what is grouped by host here."""
    every = _merged(counts, "kind", "token").withColumn("host", F.lit(_EVERY))
    both = materialize(counts.unionByName(every.select(*counts.columns)), "html-tokens")
    pages = both.where((F.col("kind") == 2) & (F.col("token") == ROOT)).select("host", F.col("n").alias("pages"))
    enough = F.greatest(F.lit(float(LEAST_PAGES)), F.col("pages") * LEAST_SHARE)
    frequent = both.where((F.col("kind") < 2) & (F.col("n") >= LEAST_PAGES)).join(pages, "host").where(F.col("n") >= enough)
    member = F.struct("first", "kind", "token", "path", "plain", "heads")
    classes = frequent.groupBy("host", "vector", "n", "times").agg(F.sort_array(F.collect_list(member)).alias("members"))
    classes = materialize(classes.where(F.size("members") >= LEAST_TOKENS), "html-classes")
    number = F.xxhash64("vector", "n", "times").alias("class")
    made = classes.select("host", number, F.explode("members").alias("m")).select("host", "class", "m.kind", "m.token", "m.path", "m.plain", "m.heads")

    # What the template itself says has no weight.
    said = made.where("kind = 1").groupBy("host", "path").agg(F.sum("plain").alias("less"), F.sum("heads").alias("less_heads"))
    spots = both.where("kind = 2").select("host", "path", "n", "plain", "heads", "around").join(said, ["host", "path"], "left")
    spots = spots.select(
        "host", "path", "n", "around", (F.col("plain") - F.coalesce("less", F.lit(0))).alias("plain"), (F.col("heads") - F.coalesce("less_heads", F.lit(0))).alias("heads")
    )
    spots = materialize(spots, "html-spots")
    elements = made.where("kind = 0").groupBy("host", "path").agg(F.min("class").alias("class"))
    elements = materialize(elements.unionByName(classes.select("host", F.lit(ROOT).cast("long").alias("path"), F.lit(0).cast("long").alias("class")).distinct()), "html-elements")
    up = spots.select("host", F.col("path").alias("spot"), "plain", "heads", F.posexplode("around").alias("deep", "path")).join(elements, ["host", "path"])
    held = up.groupBy("host", "path").agg(F.sum("plain").alias("held"))
    nearest = up.groupBy("host", "spot").agg(F.max_by("path", "deep").alias("path"), F.min("plain").alias("plain"), F.min("heads").alias("heads"))
    own = nearest.groupBy("host", "path").agg(F.sum("plain").alias("own"), F.sum("heads").alias("heads"))
    weighed = (
        elements.join(held, ["host", "path"]).join(own, ["host", "path"], "left").join(spots.select("host", "path", "n"), ["host", "path"])
        .select("host", "path", "class", *[(F.coalesce(c, F.lit(0)) / F.col("n")).alias(c) for c in ("held", "own", "heads")])
    )
    by_host = weighed.groupBy("host").agg(F.collect_list(F.struct("path", "class", "held", "own", "heads")).alias("elements"))
    tags = classes.select("host", number, F.transform(F.filter("members", lambda m: m["kind"] == 0), lambda m: m["token"]).alias("tags")).where(F.size("tags") > 0)
    tags = tags.groupBy("host").agg(F.collect_list(F.struct("class", "tags")).alias("classes"))
    out = by_host.join(tags, "host")
    return out.select("host", F.to_json(F.struct("elements", "classes")).alias("template"), F.size("elements").alias("size"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    Templates come from all pages of a host, so a page's text depends on its own
    host's pages (for a host of few pages, on all pages) and not on how they are
    dealt.  Inside the elements that hold the main text nothing is dropped but
    elements that are a menu, header, footer, sidebar, notice or form by kind or
    role, and scripts, styles and controls.

    A null or empty page has an empty text.  Pages with a null or odd url share
    one nameless host.  Null and repeated ids are allowed: every row gives a row.
    An empty table gives an empty table; other columns are ignored."""
    name = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^\w+://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"), name.alias("host"))
    made = materialize(templates(token_counts(rows)), "html-templates")
    total = made.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    every = made.where(F.col("host") == _EVERY).first()
    every = every.template if every else None
    hosts = made.where(F.col("host") != _EVERY).select("host", "template")
    read = rows.join(F.broadcast(hosts) if total <= MOST_BROADCAST else hosts, "host", "left").select("page_id", "url", "html", "template")

    def run(batches):
        reader, common, known = Reader(), Template.of(every), {}
        for b in batches:
            ids, urls, texts = [], [], []
            for page_id, link, page, template in _pages(b):
                if template not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[template] = Template.of(template)
                ids.append(page_id)
                urls.append(link)
                texts.append(main_text(reader.read(page), [known[template], common]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
