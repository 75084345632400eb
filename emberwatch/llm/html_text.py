"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides a block by where it stands
(menus, forms and the like), its length, the share of its characters inside links, and the
density of stop words.  Short or unclear blocks stay open; the second pass gives each the label
of the nearest decided block of its part of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import map_keyed

# HTML's element groups and common words of four languages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math select button canvas object video audio".split())
#: Of these, the ones whose content is text up to their end tag, or else to the end of the page.
ONLY_TEXT = frozenset("script style textarea title iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TEXT = frozenset("nav footer aside menu dialog head".split())
#: Dropped too, unless a whole page lies in one: then its article is kept.
HOLDERS = frozenset("form fieldset".split())
BODY = frozenset("article main".split())
STOP_WORDS = frozenset(
    "the of and a to in is was that for it as with be by on not he i this are or his from at which but have an had they you were "
    "there one all we can her has will if more when who would been "
    "le la les de des du et en un une est que qui dans pour par sur au aux avec il elle ce se ne pas plus son sa ses ou mais nous "
    "der die das und ist nicht von zu mit den dem des ein eine auf für im sich auch als es an werden aus er hat dass sie nach bei "
    "el los las y que en del se por con no una su para es al lo como más o pero sus le ya este sí porque".split()
)
_NAMES = (
    "ads?|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|replies|reply|"
    "respond|disqus|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|toolbar|related|recommended|"
    "share|sharing|social|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|pagination|pager|search|"
    "searchbox|skip|copyright|legal|complementary|contentinfo"
)
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?=$|[\s_-])", re.I)
#: Class words that say what stands beside an element, not what it is.
MODIFIER = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]", re.I)
#: Ids of a furniture word, or of such words and a general one; other ids are slugs of a title.
FURNITURE_ID = re.compile(
    rf"(?:(?:{_NAMES})(?:[_-](?:{_NAMES}|list|box|bar|section|container|wrapper|buttons?|links?|area|block|panel|form|posts|articles|\d+))*)\Z", re.I
)
#: Names of parts that hold other people's texts or other articles, however long they are.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|disqus|related|recommended)(?=$|[\s_-])", re.I)
SITE_HEAD = re.compile(r"(?:^|[\s_-])(?:header|head)(?=$|[\s_-])", re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*(?:>|\Z)""", re.S
)
WORD = re.compile(r"[^\W\d_]+")

#: Lengths in characters and densities of the block rules.
SHORT, LONG, STOPS, LINKS = 40, 120, 0.08, 0.33
#: A page whose article part holds at least this share of its free text is read from that part alone.
BODY_SHARE = 0.25
#: A name does not drop an element with at least this share of the page's text.
MOST = 0.5


class Block:
    __slots__ = ("text", "links", "inside", "heading", "label")

    def __init__(self, text: str, links: int, inside: bool, heading: bool):
        self.text, self.links, self.inside, self.heading, self.label = text, links, inside, heading, None


class Named:
    """A form, or an element whose class, id or role is that of page furniture: dropped unless it holds the article."""

    __slots__ = ("parent", "foreign", "holder", "size", "article", "main")

    def __init__(self, parent: int, foreign: bool, holder: bool):
        self.parent, self.foreign, self.holder = parent, foreign, holder
        self.size, self.article, self.main = 0, False, False


def blocks(page: str) -> list[Block]:
    """Blocks of a page outside unwanted elements, in page order."""
    found: list[tuple[Block, int]] = []  # with the innermost named element
    named: list[Named] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open block elements: name, unwanted, article part, named element around
    unwanted = inside = 0
    within = -1
    opened: dict[str, int] = {}  # how many elements of a name are open
    unclosed: set[str] = set()  # names without an end tag in the rest of the page
    kept_until: dict[str, int] = {}
    whole: list[int] = []
    parts: list[str] = []
    links = breaks = 0
    in_link = heading = False
    at, size = 0, len(page)

    def add(text):
        nonlocal links, breaks
        if not unwanted and text:
            plain = html.unescape(text) if "&" in text else text
            if plain and not plain.isspace():
                breaks = 0
            parts.append(plain)
            if in_link:
                links += len("".join(plain.split()))

    def close():
        nonlocal links, parts, breaks, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((Block(text, links, inside > 0, heading), within))
        parts, links, breaks, in_link = [], 0, 0, False

    def shut_from(name, pattern):
        shut = None if name in unclosed else re.compile(pattern, re.I).search(page, at)
        if shut is None:
            unclosed.add(name)
        return shut

    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name, ending, attributes = token[2].lower(), token[1], token[3] or ""
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                shut = shut_from(name, rf"</{name}\b[^>]*>?")
                if shut or name in ONLY_TEXT:
                    at = shut.end() if shut else size
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            elif not unwanted:
                parts.append(" ")
            continue
        if name == "a":
            in_link = not ending
            continue
        if name not in BLOCK:
            if not ending and name not in VOID and not attributes.endswith("/") and attributes and at >= kept_until.get(name, 0):
                hidden = is_unwanted(name, attributes, inside)
                if hidden or has_furniture_name(name, attributes, inside):
                    # An unwanted inline element: its text goes as a whole.
                    shut = shut_from(name, rf"</{name}\s*>")
                    if shut and not hidden and holds_article(page, at, shut.start(), whole):
                        kept_until[name] = shut.start()
                    elif shut:
                        at = shut.end()
            continue
        close()
        if name == "hr":
            continue
        if ending:
            for depth in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[depth][0] == name:
                    within = stack[depth][3]
                    for other, bad, body, _ in stack[depth:]:
                        opened[other] -= 1
                        unwanted -= bad
                        inside -= body
                    del stack[depth:]
                    break
            heading = False
            continue
        if name in HEADINGS or name == "p":  # never nested: a new one ends the last
            while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS):
                other, bad, body, within = stack.pop()
                opened[other] -= 1
                unwanted -= bad
                inside -= body
        heading = name in HEADINGS
        bad, body = is_unwanted(name, attributes, inside), name in BODY
        if not attributes.endswith("/"):
            stack.append((name, bad, body, within))
            opened[name] = opened.get(name, 0) + 1
            if not bad and (name in HOLDERS or has_furniture_name(name, attributes, inside)):
                foreign = any(FOREIGN.search("".join(n[1:])) for n in NAMED.findall(attributes))
                named.append(Named(within, foreign, name in HOLDERS))
                within = len(named) - 1
            unwanted += bad
            inside += body
            if body and not unwanted and within >= 0:
                named[within].article = True
                named[within].main |= name == "main"
    close()
    dropped = furniture(named, found)
    return [b for b, e in found if e < 0 or not dropped[e]]


def furniture(named: list[Named], found: list[tuple[Block, int]]) -> list[bool]:
    """Which named elements go: those that hold neither the article nor most of the page's text.

    Where an article stands outside all of them, only most of the text keeps one, and nothing keeps
    comments and the like, which may hold articles of their own.  A form goes unless the article is in it.
    """
    outside = any(b.inside for b, e in found if e < 0)
    for n in reversed(named):
        if n.parent >= 0:
            named[n.parent].article |= n.article
            named[n.parent].main |= n.main
    dropped = []
    for n in named:
        kept = n.main or (n.article and not outside)
        dropped.append((n.holder and not kept) or (n.parent >= 0 and dropped[n.parent]))
    total = 0
    for b, e in found:
        if e < 0 or not dropped[e]:
            total += len(b.text)
            if e >= 0:
                named[e].size += len(b.text)
    for n in reversed(named):
        if n.parent >= 0:
            named[n.parent].size += n.size
    for i, n in enumerate(named):
        most = n.size >= MOST * total
        kept = n.holder or n.main or (most and not n.foreign if outside else n.article or most)
        dropped[i] |= not kept or (n.parent >= 0 and dropped[n.parent])
    return dropped


def holds_article(page: str, start: int, end: int, whole: list[int]) -> bool:
    """Whether a stretch of a page opens an article or main, or holds most of the page's text."""
    def size(text):
        return len("".join(re.sub(r"<(script|style)\b.*?</\1|<[^>]*>", "", text, flags=re.S | re.I).split()))

    if re.compile(r"<(?:article|main)\b", re.I).search(page, start, end):
        return True
    if not whole:
        whole.append(size(page))
    return size(page[start:end]) >= MOST * whole[0]


def is_unwanted(name: str, attributes: str, inside: int) -> bool:
    """Whether an element's kind or state sets its text apart from an article's."""
    if name in OUTSIDE_TEXT or (name == "header" and not inside) or (name in HOLDERS and inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return bool(HIDDEN.search(attributes))


def has_furniture_name(name: str, attributes: str, inside: int) -> bool:
    """Whether an element's class, id or role is one of page furniture.

    Class words such as has-sidebar name another element.  Ids of an article's headings and paragraphs
    are free, and those of its other parts, like those of headings and paragraphs elsewhere, count only
    if they are no slug of a title.
    """
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    titled = name in HEADINGS or name == "p"
    for kind, *names in NAMED.findall(attributes):
        value = "".join(names)
        if kind.lower() == "id" and (inside or titled):
            if not (inside and titled) and FURNITURE_ID.match(value.strip()):
                return True
            continue
        value = " ".join([w for w in value.split() if not MODIFIER.search(w)])
        if UNWANTED.search(value) or (not inside and SITE_HEAD.search(value)):
            return True
    return False


def first_pass(block: Block) -> bool | None:
    """True and False where the rules decide, None where they do not."""
    size = len(block.text)
    if block.links > LINKS * size:
        return False
    words = WORD.findall(block.text.lower())
    stops = sum([w in STOP_WORDS for w in words])
    if size >= SHORT and not block.heading and stops >= STOPS * max(len(words), 1) and stops:
        return True
    if size >= LONG and block.inside and not block.heading:
        return True
    return None


def second_pass(page_blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of the same part of the page."""
    for part in (True, False):
        own = [b for b in page_blocks if b.inside is part]
        before, last, distance = [], None, 0
        for b in own:
            last, distance = (b.label, 0) if b.label is not None else (last, distance + 1)
            before.append((last, distance))
        last, distance = None, 0
        for i in range(len(own) - 1, -1, -1):  # labels inherited here do not pass on
            b = own[i]
            if b.label is not None:
                last, distance = b.label, 0
                continue
            distance += 1
            (left, left_far), right = before[i], last
            if left is None and right is None:
                b.label = part or b.links == 0
            elif left is None or (right is not None and (distance < left_far or b.heading)):
                b.label = right
            elif right is None or left_far < distance:
                b.label = left
            else:
                b.label = left or right


def main_text(page: str | None) -> str:
    """The article of a page, one block per line; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    free = sum([len(b.text) for b in found])
    body = sum([len(b.text) for b in found if b.inside])
    if body and body >= BODY_SHARE * free:
        found = [b for b in found if b.inside]
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    return "\n".join([b.text for b in found if b.label])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: key, url, ``text`` and ``n_chars`` (code points of the text).

    A null, empty or text-free page gives an empty text.  Pages are independent of each other, so
    repeated rows repeat their result and null keys pass through.
    """
    rows = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{page}`").alias("_page"))
    url_kind = rows.schema["_url"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(p) for p in frame["_page"]]
            yield pd.DataFrame({"_key": frame["_key"], "_url": frame["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    made = map_keyed(rows, run, f"_url {url_kind}, text string, n_chars long")
    return made.withColumnsRenamed({"_key": key, "_url": url})
