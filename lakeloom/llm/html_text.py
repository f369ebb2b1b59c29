"""Main text of web pages by tag-path ratios.

Every block of text has a path of tags and classes from the root. Over a page, each path gets two ratios, text
length and punctuation for each of its blocks. The ratios are smoothed along the page with a
Gaussian window over neighbouring blocks of one section and fused into one score, which links alone, menus, headers and footers
lower. Paths whose mean score reaches a share of the scores' deviation are content, and their blocks are content nodes. The
main text is what stands in the smallest section that holds all content nodes, or in the article or main element that holds most
of their text: content nodes, and what belongs to them there. Menus, headers and footers in it go unless nothing else is content. In an article or main
element, paths go that score far under what is usual there, such as lists of links; elsewhere sections beside the content nodes' own go if they hold links
alone or lie before the first or behind the last one without a heading. The page's only h1 is kept where it stands before the content.

Parts that ratios can't tell from an article, as they hold prose too, are a second guard: what tag, class, id or role call
sidebars, notices, adverts, forms or readers' comments is left out, and what stands under a heading of comments. Inside article and main elements doubtful names (share,
related, notice) only leave out what doesn't score as prose. Such a name drops neither what holds the page (most of its text and its article, main or h1) nor everything.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame

# Elements by what they mean to a page.
DROPPED = frozenset("head script style noscript template button select option textarea iframe object svg canvas audio video map".split())
WEAK = frozenset("nav header footer menu".split())
GUARDED = frozenset("aside form dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SECTIONS = frozenset("html body main article section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag in the value's list ends an open element of the key's name, up to the elements that shield it.
ENDED_BY = {
    "p": (frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), frozenset("button td th table caption object".split())),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "tr", "tbody", "tfoot"]), frozenset(["table"])), "th": (frozenset(["td", "th", "tr", "tbody", "tfoot"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "tbody", "tfoot"]), frozenset(["table"])), "option": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "head": (frozenset(["body"]), frozenset()),
}
_RAW = "script|style|noscript|template|textarea|title|iframe|svg"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Words of a class, id or role. The first mark a part as not of the article wherever it stands; the second only outside article and main, and
# inside them where the part's path doesn't score as prose.
_MARKS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|sidebars?|nav|navbar|navigation|menus?|breadcrumbs?|comments?|commentlist|disqus|replies|reply|masthead"
    r"|newsletter\w*|popup\w*|modal|overlay|login|signup|pagination|pager|complementary|contentinfo|hidden)(?=$|[-_\s\d])",
    re.I,
)
_SOFT_MARKS = re.compile(
    r"(?:^|[-_\s])(?:promo\w*|banner\w*|notices?|notification\w*|alert|side|rail|widget\w*|discussion|respond|share|sharing|social|related|recommend\w*|footers?|headers?|subscribe\w*|subscription|paywall|register|search|toc|tags)(?=$|[-_\s\d])",
    re.I,
)
#: A heading that opens readers' comments.
_COMMENTS = re.compile(r"(?:\d+\s+)?(?:comments?|responses?|replies|reactions|kommentare?|antworten|comentarios?|respuestas?|commentaires?|réponses?)(?:\s*\(?\d+\)?)?|leave a (?:comment|reply)", re.I)
#: Names in a class that tell what a part has beside it, not what it is.
_BESIDE = re.compile(r"(?<!\S)(?:\S*[-_])?(?:has|no|with|without)[-_]\S*", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Blocks on either side that smoothing looks at, its width, and the share of the deviation that content reaches.
REACH, WIDTH, SHARE = 2, 1.0, 0.5
#: What is left of the score of a block that is links alone, and of one in a menu, header or footer.
LOWERED = 0.1
#: Inside article and main, the share of the section's usual score (weighted by length) under which a path goes, and that under which one goes whose name is doubtful.
LEAST, DOUBTFUL = 0.04, 0.5


class Block(NamedTuple):
    """Text with its path (tags and classes), the tags and numbers of the elements around it, whether links alone hold it, whether a menu, header or footer does, and whether an element in its article or main has a doubtful name."""

    path: tuple[str, ...]
    tags: tuple[str, ...]
    numbers: tuple[int, ...]
    text: str
    linked: bool
    weak: bool
    doubtful: bool = False

    @property
    def section(self) -> int:
        """The number of the innermost section, menu, header or footer around it."""
        return next((n for t, n in zip(reversed(self.tags), reversed(self.numbers), strict=True) if t in SECTIONS or t in WEAK), 0)


def _marked(tag: str, attributes: str, told: bool) -> tuple[bool, bool]:
    """Whether tag, class, id or role mark an element as not of the article, and whether they make it doubtful. ``told``: it stands in an article or main element."""
    if tag in GUARDED:
        return True, False
    if tag in ("html", "body", "main", "article") or tag in WEAK or "=" not in attributes:
        return False, False
    names = [_BESIDE.sub(" ", m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)]
    soft = any(map(_SOFT_MARKS.search, names))
    return any(map(_MARKS.search, names)) or (soft and not told), soft and told


def _class(attributes: str) -> str:
    return next((m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes) if m[1].lower() == "class"), "") if "=" in attributes else ""


def _wrappers(out, landmarks) -> set[int]:
    """Marked elements that are kept, as they hold the page: over half of its text, and the article or main element in the fewest of them (without such elements, an h1)."""
    held: dict[int, int] = defaultdict(int)
    sizes: dict[int, int] = defaultdict(int)
    for block, marks in out:
        for n in marks:
            held[n] += len(block.text)
        for n in block.numbers:
            sizes[n] += len(block.text)
    told = [(len(marks), -sizes[n], marks) for tag, n, marks in landmarks if tag != "h1" and sizes[n]]
    inside = set(min(told)[2]) if told else {n for _, _, marks in landmarks for n in marks}
    total = sum(len(block.text) for block, _ in out if not block.weak)
    return {n for n in inside if 2 * held[n] > total}


def blocks_of(page: str) -> list[Block]:
    """The blocks of text outside guarded parts, in page order."""
    stack: list[tuple[str, int, bool, tuple[int, ...], str, bool]] = []  # tag, number, inside a dropped part, marked elements around, tag and class, inside a doubtful part
    landmarks = []  # each article, main and h1: tag, number, marked elements around
    out, parts, home, number, at, linked = [], [], None, 0, 0, 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            own, marks = home
            weak = any(s[0] in WEAK for s in own)
            out.append((Block(tuple(s[4] for s in own), tuple(s[0] for s in own), tuple(s[1] for s in own), text, linked == sum(map(len, map(str.strip, parts))), weak, any(s[5] for s in own)), marks))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal home, linked
        if text and not (stack and stack[-1][2]):
            if not parts or (not "".join(parts).strip()):
                home = ([s for s in stack if s[0] not in INLINE], stack[-1][3] if stack else ())
            parts.append(html.unescape(text) if "&" in text else text)
            if any(s[0] == "a" for s in stack):
                linked += len(parts[-1].strip())

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if any(s[0] == tag for s in stack):
                if tag not in INLINE:
                    close()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close()
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDED_BY:
                starts, shields = ENDED_BY[stack[k][0]]
                if tag in starts and not any(s[0] in shields for s in stack[k + 1 :]):
                    del stack[k:]
        if m["attr"].endswith("/") and tag in INLINE:
            continue
        number += 1
        gone, marks = (stack[-1][2] or tag in DROPPED, stack[-1][3]) if stack else (tag in DROPPED, ())
        hard, soft = (False, False) if gone else _marked(tag, m["attr"], any(s[0] in ("article", "main") for s in stack))
        if hard:
            marks = (*marks, number)
        if tag in ("article", "main", "h1") and not gone:
            landmarks.append((tag, number, marks))
        stack.append((tag, number, gone, marks, f"{tag}.{_class(m['attr'])}", soft))
    add(page[at:])
    close()
    kept = _wrappers(out, landmarks) if any(marks for _, marks in out) else set()
    # Where marks would leave nothing but menus, headers and footers, they tell nothing.
    left = [block for block, marks in out if kept.issuperset(marks)]
    left = _without_comments(left)
    return left if any(not b.weak for b in left) else [block for block, _ in out]


def _without_comments(blocks: list[Block]) -> list[Block]:
    """The blocks but those from a heading of readers' comments to the end of its section."""
    out, gone = [], None
    for b in blocks:
        if gone is not None and gone not in b.numbers:
            gone = None
        if gone is None and b.tags and b.tags[-1] in HEADINGS and b.tags[-1] != "h1" and _COMMENTS.fullmatch(b.text.strip(" :.")):
            gone = b.section
        if gone is None:
            out.append(b)
    return out


def block_scores(blocks: list[Block]) -> list[float]:
    """The smoothed and fused tag-path ratios of each block."""
    sums: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in blocks:
        s = sums[b.path]
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
    ratios = [(s[1] / s[0], s[2] / s[0]) for s in (sums[b.path] for b in blocks)]
    sections = [b.section for b in blocks]
    window = [(k, math.exp(-(k * k) / (2 * WIDTH * WIDTH))) for k in range(-REACH, REACH + 1)]
    out = []
    for i, b in enumerate(blocks):
        near = [(w, ratios[i + k]) for k, w in window if 0 <= i + k < len(ratios) and sections[i + k] == sections[i]]
        total = sum(w for w, _ in near)
        length, points = (sum(w * r[c] for w, r in near) / total for c in (0, 1))
        out.append(math.sqrt(length * (points + 1 / (1 + length))) * (LOWERED if b.linked else 1) * (LOWERED if b.weak else 1))
    return out


def path_scores(blocks: list[Block], scores: list[float]) -> list[float]:
    """The mean score of each block's path."""
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0])
    for b, s in zip(blocks, scores, strict=True):
        sums[b.path][0] += s
        sums[b.path][1] += 1
    return [sums[b.path][0] / sums[b.path][1] for b in blocks]


def content_nodes(blocks: list[Block], scores: list[float], paths: list[float]) -> list[bool]:
    """Whether each block's path is content: its mean score reaches the share of the deviation of all scores. Menus, headers and footers are so only where nothing else is."""
    mean = sum(scores) / len(scores)
    least = SHARE * math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    reached = [p >= least for p in paths]
    plain = [r and not b.weak for r, b in zip(reached, blocks, strict=True)]
    return plain if any(plain) else reached


def _scoring(blocks: list[Block], paths: list[float], inside: list[int]) -> list[int]:
    """Those of the blocks inside an article or main element whose paths score: not far under the usual score there, and not under half of it where a name makes them doubtful.

    Headings stay, but for doubtful ones, as they are short and without punctuation; so do all if nothing scores.
    """
    size = sum(len(blocks[i].text) for i in inside)
    usual = sum(paths[i] * len(blocks[i].text) for i in inside) / max(1, size)
    out = [i for i in inside if (paths[i] >= DOUBTFUL * usual if blocks[i].doubtful else paths[i] >= LEAST * usual or HEADINGS.intersection(blocks[i].tags))]
    return out or inside


def _with_title(blocks: list[Block], inside: list[int]) -> list[int]:
    """With the page's only h1, where it stands before the content and outside of it."""
    titles = [i for i, b in enumerate(blocks) if "h1" in b.tags and not b.weak and not b.linked]
    numbers = {blocks[i].numbers[blocks[i].tags.index("h1")] for i in titles}
    before = [i for i in titles if i < inside[0]] if inside else []
    return before + inside if len(numbers) == 1 and len(before) == len(titles) else inside


def main_text(page: str | None) -> str:
    """The article's blocks, white space inside each turned into one blank, joined by one blank."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = block_scores(blocks)
    paths = path_scores(blocks, scores)
    chosen = content_nodes(blocks, scores, paths)
    content = [len(b.text) if c else 0 for b, c in zip(blocks, chosen, strict=True)]
    total, inside = sum(content), list(range(len(blocks)))
    depth, top = 0, ""
    while True:
        held: dict[int, list[int]] = defaultdict(list)
        for i in inside:
            if depth < len(blocks[i].tags) and blocks[i].tags[depth] in SECTIONS:
                held[blocks[i].numbers[depth]].append(i)
        best = max(held.values(), key=lambda v: sum(content[i] for i in v), default=None)
        if best is None or sum(content[i] for i in best) < 0.7 * total:
            break
        own = set(best)
        # Content nodes beside the section end the descent, unless an article or main element inside tells what is meant.
        if any(content[i] and not blocks[i].linked for i in inside if i not in own):
            told: dict[int, int] = defaultdict(int)
            for i in best:
                for tag, n in zip(blocks[i].tags[depth:], blocks[i].numbers[depth:], strict=True):
                    if tag in ("article", "main"):
                        told[n] += content[i]
            if max(told.values(), default=0) < 0.7 * total:
                break
        inside, top = best, blocks[best[0]].tags[depth]
        if top == "article":
            break
        depth += 1
    inside = [i for i in inside if chosen[i] or not blocks[i].weak]
    inside = _scoring(blocks, paths, inside) if top in ("article", "main") else _belonging(blocks, chosen, inside, depth)
    return " ".join(blocks[i].text for i in _with_title(blocks, inside))


def _belonging(blocks: list[Block], chosen: list[bool], inside: list[int], depth: int) -> list[int]:
    """Those of ``inside`` that go with its content nodes: a section beside theirs stays if it lies between two of them or has a heading, and is more than links."""
    within: dict[int, list[int]] = defaultdict(list)  # by the outermost section below the one that holds all
    for i in inside:
        within[next((n for t, n in zip(blocks[i].tags[depth:], blocks[i].numbers[depth:], strict=True) if t in SECTIONS), 0)].append(i)
    first, last = (f((i for i in inside if chosen[i]), default=0) for f in (min, max))
    out = []
    for section, own in within.items():
        beside = section and not any(chosen[i] for i in own)
        between = all(first < i < last for i in own)
        if not beside or not all(blocks[i].linked for i in own) and (between or any(HEADINGS.intersection(blocks[i].tags) for i in own)):
            out += own
    return sorted(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page; null or empty html gives an empty text.

    Repeated rows and null ids keep their rows; columns other than page_id, url and html are left out. An empty table
    gives no rows.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
