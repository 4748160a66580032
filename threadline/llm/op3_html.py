"""Operator 3: main text by line-block distribution.

A page becomes a list of lines, one per block element, with the markup
stripped.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are markup in this sense: they leave a gap
of empty lines.  The text lengths are summed over windows of `WINDOW` lines;
text starts at a surge (a window sum rises from zero) and ends at a dive (it
falls back to zero).  Pages that name their main part (article or main
element) have no weight outside it; on others the heaviest stretch wins,
together with those of at least `SHARE` of its weight.  Stretches that only an
element left out inside one content container keeps apart are one stretch.  A
container's content is what lies in it directly (sections, lists and paragraphs
don't count as containers), and all it holds unless it is the body or
also holds a menu, header or footer of the page.  Everything between surge and
dive is kept: no line is dropped for being short.

Role names count in classes, ids and roles.  A class counts if all its parts
between hyphens are role names ("ad-banner" goes, "related-work" and "side-effects"
stay); in the main element an id or role counts as a whole.  Outside it, names that
mean nothing else also count as one part among others ("left-sidebar",
"site-header"), unless the class says that something has one ("page-with-sidebar",
"has-header").  Forms and elements that go by such a part alone may be wrappers of
the whole page: one that holds more than half of the page's text stays, and what
lies in it is judged by itself.  Comments go whatever their size.

Null or empty html gives the empty text.  An embedded part (canvas, svg, ...) without an
end tag is no element at all.  Any other unclosed element ends where its parent or
the page ends, an unclosed paragraph, list item, cell or head also
where the next one or a block starts; an end tag without its start is ignored,
and only one of article, main, body or html ends a main part.  A stray `<` is
text.  One row per input row, so
repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import columns, table

WINDOW = 3
SHARE = 0.25
WRAPPED = 8                      # wrappers looked for one by one

# Element names by their role.
RAW = frozenset("script style textarea title".split())              # their content is no markup
QUIET = frozenset("noscript template iframe svg object canvas".split())   # left out without ending a line
SKIP = frozenset("nav aside form footer head select button dialog menu".split()) | QUIET
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul aside".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Start tags that end an open element of `ends`, looked for through `through` (None: up to a table).
PARAGRAPH_ENDS = BLOCK - {"body", "br", "html"} | {"dialog", "menu"}
ITEM = frozenset("span p div address".split())
ENDS = {"li": ({"li"}, ITEM), "dt": ({"dt", "dd"}, ITEM), "dd": ({"dt", "dd"}, ITEM), "td": ({"td", "th"}, None),
        "th": ({"td", "th"}, None), "tr": ({"tr"}, None)} | dict.fromkeys(
            ("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, None))
ROLE_NAME = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|footer|comments?|replies|disqus|respond|"
    r"share|social|related|recommended|newsletter|subscribe|login|search)")
PART_NAME = (r"(?:ads|advert\w*|sponsor\w*|cookies?|consent|popup|modal|sidebar|menu|nav|navbar|navigation|"
             r"breadcrumbs?|footer|comments|disqus|newsletter|subscribe)")
ROLE_PART = re.compile(rf"(?<!\S)(?!\S*\b(?:with|without|has|no|is|not)[_-])"
                       rf"(?:\S*[_-])?(?:{PART_NAME}|(?:site|page|main|top|global)[_-]header)(?![^\s_-])\S*", re.I)
COMMENTS = re.compile(r"(?<![^\s_-])(?:comments?|replies|disqus|respond)(?![^\s_-])", re.I)
# inside the main element; its own header stays
ROLE_CLASS = re.compile(rf"(?<!\S)(?!header(?!\S)){ROLE_NAME}(?:[_-]+{ROLE_NAME})*(?!\S)", re.I)
ROLE_ID = re.compile(rf"(?<!\S)(?!header(?!\S)){ROLE_NAME}(?!\S)", re.I)
FRAME = re.compile(r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|header|footer)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
RAW_END = {name: re.compile(f"</{name}(?![a-z0-9])", re.I | re.A) for name in RAW}
QUOTED_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
CONTAINER = frozenset("div section ul ol table header span p details figure".split())
SPAN = frozenset(["span"])
BOX = frozenset("div td th body html".split())
KEPT_OPEN = (BLOCK | CONTAINER | SKIP | MAIN) - VOID


class Open:
    """The open elements of a page, inline ones but spans left out."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.counts: Counter = Counter()
        self.mains: list[int] = []             # places of the main elements that count
        self.skip: int | None = None           # place of the element that is being left out
        self.boxes: list[tuple[int, int]] = [(-1, 0)]       # (place, number) of the open containers
        self.parent = [0]                      # of every container; 0 is the page
        self.wide = {0}                        # containers of the page rather than of its content

    def cut(self, at: int) -> None:
        """Close everything from place `at` on."""
        for name in self.names[at:]:
            self.counts[name] -= 1
        del self.names[at:]
        while self.mains and self.mains[-1] >= at:
            self.mains.pop()
        while self.boxes[-1][0] >= at:
            self.boxes.pop()
        if self.skip is not None and self.skip >= at:
            self.skip = None

    def end(self, ends: set[str], through: frozenset[str] | None) -> None:
        """Close the innermost element of `ends` that only `through` lies in."""
        if not any(self.counts[n] for n in ends):
            return
        least = self.mains[-1] if self.mains else -1
        for i in range(len(self.names) - 1, least, -1):
            if self.names[i] in ends:
                return self.cut(i)
            if self.names[i] == "table" if through is None else self.names[i] not in through:
                return

    def start(self, name: str) -> None:
        """What the start tag of `name` closes."""
        if name in BLOCK:
            self.end({"head"}, SPAN)
        if name in PARAGRAPH_ENDS:
            self.end({"p"}, SPAN)
        if name in ENDS:
            self.end(*ENDS[name])

    def push(self, name: str) -> None:
        if name in MAIN and self.skip is None:
            self.mains.append(len(self.names))
        if name in BOX and self.skip is None:
            if name in ("body", "html"):
                self.wide.add(len(self.parent))
            self.boxes.append((len(self.names), len(self.parent)))
            self.parent.append(self.boxes[-2][1])
        self.names.append(name)
        self.counts[name] += 1

    def close(self, name: str) -> None:
        """The end tag of `name`."""
        if not self.counts[name] or name == "span" and self.names[-1] != "span":
            return
        at = len(self.names) - 1
        while self.names[at] != name:
            at -= 1
        if not self.mains or at > self.mains[-1] or name in MAIN or name in ("body", "html"):
            self.cut(at)


def left_out(name: str, markup: str, inside: bool) -> tuple[bool, bool]:
    """(is this element, its attributes in `markup`, no part of the text; may it
    yet be a wrapper of the page)."""
    if name in SKIP or name == "header" and not inside:
        return True, name == "form" and not inside
    if name not in CONTAINER:
        return False, False
    part = False
    for kind, *value in ATTRIBUTE.findall(markup):
        value = next(filter(None, value), "")
        if (ROLE_ID if inside and kind.lower() != "class" else ROLE_CLASS).search(value):
            return True, False
        if not inside and ROLE_PART.search(value):
            if COMMENTS.search(value):
                return True, False
            part = True
    return part, part


def lines_of(html: str, wrappers=frozenset(), every: bool = False) -> tuple[list[tuple[str, bool, int | None]], Open, int, dict[int, int]]:
    """(text, inside the main element, container) per line, the containers, the
    characters of all text, and those of each element left out that may be a
    wrapper, by its place (all text's for embedded parts without an end tag); gaps
    are empty lines in the container of the element left out.  Elements at the places
    of `wrappers` stay, and with `every` all that may be wrappers."""
    out: list[tuple[str, bool, int | None]] = []
    parts: list[str] = []
    open_ = Open()
    whole, doubtful, hidden = 0, -1, {}
    embedded, unclosed = (-1, ""), set()

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, bool(open_.mains), open_.boxes[-1][1]))

    def gap(box: int | None = None) -> None:
        close()
        out.extend([("", bool(open_.mains), box)] * WINDOW)

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        piece = html[at:m.start() if m else size]
        whole += len(piece.strip())
        if open_.skip is None:
            parts.append(piece)
        elif doubtful >= 0:
            hidden[doubtful] += len(piece.strip())
        if not m:
            break
        if m[1]:
            end = html.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        e = QUOTED_END.match(html, m.end())
        end = e.end() if e else (html.find(">", m.end()) + 1 or size)
        at = end
        if m[2]:
            continue
        name, closing = m[4].lower(), bool(m[3])
        if name in RAW and not closing:
            if html[end - 2:end] != "/>":
                stop = RAW_END[name].search(html, end)
                at = (html.find(">", stop.end()) + 1 or size) if stop else size
            if open_.skip is None and name in BLOCK:
                close()
            continue
        if open_.skip is None and (name in BLOCK or name in MAIN):
            gap() if name in MAIN else close()
        if closing:
            skipping = open_.skip is not None
            open_.close(name)
            if skipping and open_.skip is None and embedded[0] >= 0 and name != embedded[1]:
                unclosed.add(embedded[0])
            continue
        if open_.skip is not None and name in MAIN and not open_.mains:
            open_.cut(open_.skip)               # a part left open must not swallow the article
            gap()
        open_.start(name)
        if name in VOID or name not in KEPT_OPEN or name in QUIET and html[end - 2:end] == "/>":
            continue
        markup = html[m.end():end]
        gone, unsure = left_out(name, markup, bool(open_.mains)) if open_.skip is None and name not in MAIN else (False, False)
        if gone and m.start() not in wrappers and not (unsure and every):
            doubtful = m.start() if unsure else -1
            embedded = (m.start(), name) if name in QUIET and html[end - 2:end] != "/>" else (-1, "")
            if unsure:
                hidden[doubtful] = 0
            if name not in QUIET:
                gap(open_.boxes[-1][1])
            if name in ("nav", "header", "footer", "menu") or any(
                    FRAME.search(" ".join(value)) for _, *value in ATTRIBUTE.findall(markup)):
                open_.wide.update(n for _, n in open_.boxes)
            open_.skip = len(open_.names)
        open_.push(name)
    if open_.skip is not None and embedded[0] >= 0:
        unclosed.add(embedded[0])
    close()
    return out, open_, whole, hidden | dict.fromkeys(unclosed, whole + 1)


def surges(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """[first, last) of every stretch between a surge and the dive after it."""
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    out, first = [], None
    for i in range(n):
        here = total[min(n, i + window)] - total[i]
        if here and first is None:
            first = i
        elif not here and first is not None:
            out.append((first, i))
            first = None
    return out + ([(first, n)] if first is not None else [])


def joined(lines: list[tuple[str, bool, int | None]], found: list[tuple[int, int]], boxes: Open) -> list[tuple[int, int]]:
    """The stretches, those that only elements left out of a common content
    container keep apart as one."""
    out, before = [], set()

    def around(i: int) -> set[int]:
        box, all_ = lines[i][2], set()
        while box:
            all_.add(box)
            box = boxes.parent[box]
        return all_ - boxes.wide
    for a, b in found:
        here = {box for text, _, box in lines[a:b] if text}
        if out:
            last, first = out[-1][1] - 1, next(i for i in range(a, b) if lines[i][0])
            gaps = {box for _, _, box in lines[last + 1:first] if box is not None}
            if gaps & (before & here | around(last) & around(first)):
                out[-1] = (out[-1][0], b)
                before |= here
                continue
        out.append((a, b))
        before = here
    return out


def main_text(html: str) -> str:
    wrappers: set[int] = set()
    for turn in range(WRAPPED + 1):              # a page in very many wrappers: all that may be one
        lines, boxes, whole, hidden = lines_of(html, wrappers, turn == WRAPPED)
        more = {at for at, size in hidden.items() if 2 * size > whole}
        if not more:
            break
        wrappers |= more
    named = any(inside and text for text, inside, _ in lines)
    weights = [len(text) if inside or not named else 0 for text, inside, _ in lines]
    found = surges(weights)
    if not named and found:
        found = joined(lines, found, boxes)
        most = max(sum(weights[a:b]) for a, b in found)
        found = [(a, b) for a, b in found if sum(weights[a:b]) >= SHARE * most]
    return "\n".join(lines[i][0] for a, b in found for i in range(a, b) if weights[i])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row; one scan, no shuffle."""
    src = pages.select(F.col(id_col).alias("page_id"), "url", F.col(html_col).alias("html"))
    kinds = dict(src.dtypes)

    def fn(batches):
        for b in batches:
            text = [main_text(h or "") for h in columns(b, "html")[0]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()),
                 pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return src.mapInArrow(fn, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
