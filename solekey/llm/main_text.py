"""Main text of web pages: containers are scored, hosts vote on their path, pages are read again."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solekey.llm.frames import BROADCAST_ROWS, map_batches
from solekey.session import durable

# Comments, declarations and tags; a tag's quoted values may hold a ">".
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLANKS = re.compile(r"\s+")

# Elements by their part in a page.
RAW = frozenset("script style textarea title".split())  # up to the next closing tag, or the page's end
EMBEDDED = frozenset("noscript template iframe svg object select annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav aside form footer button dialog menu head".split()) | RAW | EMBEDDED
CONTAINERS = frozenset("html body div section article main td th center table tbody tr blockquote".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre figure figcaption address header hr thead tfoot caption details summary".split()
) | BOILERPLATE
# A tag that opens closes these, if they are the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Names of classes and ids. The first kind tells what a container holds, the second
# where it stands, the third may as well be the head or a part of an article.
CONTENT_NAMES = (
    "ad ads adv advert adverts advertisement advertising promo sponsor sponsored comment comments commentlist disqus discussion "
    "share sharing social related recommended newsletter subscribe signup login cookie cookies consent gdpr popup modal"
).split()
PLACE_NAMES = (
    "nav navbar navigation menu menus sidebar footer breadcrumb breadcrumbs search overlay toolbar pagination pager widget skip"
).split()
HEAD_NAMES = "header masthead side notice notices banner alert".split()
INLINE_NAMES = "ad ads advert adverts advertisement promo sponsored share sharing social".split()
ROLES = frozenset("navigation contentinfo complementary search dialog form menu".split())
HEAD_ROLES = frozenset("banner alert".split())


def _named(words) -> re.Pattern:
    return re.compile(rf"(?:^|[-_])(?:{'|'.join(words)})(?:[-_]|\d|$)", re.I)


CONTENT, PLACE, HEAD, INLINE = map(_named, (CONTENT_NAMES, PLACE_NAMES, HEAD_NAMES, INLINE_NAMES))
# Such a name says that something else has or lacks the part, or how parts are laid out.
QUALIFIED = re.compile(r"(?:^|[-_])(?:with|without|has|no|by)(?:[-_]|$)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSEEN = re.compile(r"style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

# A page is read without regard to a name if without its containers less than this share of the text is left.
LEAST_LEFT = 0.1

MAIN = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text)(?:[-_\s]|$)", re.I)
DIGITS = re.compile(r"\d+")

# What a level between a container and its text costs, and what a telling or too wide container gets.
LEVEL, TELLING, WIDE = 0.9, 1.5, 0.5


class _Node:
    """An open block: `noise` by its make, `named` the numbers of the containers around it that a name puts in doubt."""

    __slots__ = ("tag", "path", "noise", "parent", "article", "named")

    def __init__(self, tag, path, noise, parent, article, named=()):
        self.tag, self.path, self.noise, self.parent, self.article, self.named = tag, path, noise, parent, article, named


def _names(attributes: str) -> tuple[list[tuple[str, str]], str]:
    """Classes and ids, and the role."""
    names, role = [], ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower()
        else:
            names.append((m[1].lower(), value))
    return names, role


def _hidden(attributes: str) -> bool:
    low = (attributes or "").lower()
    if "hidden" not in low and "none" not in low:
        return False
    return bool(HIDDEN.search(QUOTED.sub("''", attributes)) or UNSEEN.search(attributes))


def _opened(tag: str, attributes: str, parent: _Node, doubts: list[bool]) -> _Node:
    """A block's node: a container's path has tags and classes without numbers, so that pages agree.

    A container whose name speaks of something else than the article gets a number in ``doubts``
    (whether the name tells what it holds). Names that may be the head of an article say nothing
    inside one.
    """
    names, role = _names(attributes)
    article = parent.article or tag in ("article", "main") or role in ("main", "article")
    noise = parent.noise or tag in BOILERPLATE or role in ROLES or _hidden(attributes)
    noise = noise or not parent.article and (tag == "header" or role in HEAD_ROLES)
    named = parent.named
    if names and not noise and tag not in ("html", "body", "article", "main"):
        tokens = [t for _, v in names for t in v.split() if not QUALIFIED.search(t)]
        content = any(CONTENT.search(t) for t in tokens)
        place = any(PLACE.search(t) for t in tokens)
        head = tag not in HEADINGS and not parent.article and any(HEAD.search(t) for t in tokens)
        if content or place or head:
            named = (*named, len(doubts))
            doubts.append(content)
    path = parent.path
    if tag in CONTAINERS:
        classes = sorted({DIGITS.sub("", c).strip("-_").lower() for k, v in names if k == "class" for c in v.split()} - {""})
        path = f"{path}>{'.'.join([tag, *classes])}"
    return _Node(tag, path, noise, parent, article, named)


def _settled(rows, doubts: list[bool], holds: set[int]) -> list[tuple[str, bool, str, float]]:
    """Blocks with the names weighed: those of containers around nearly the whole text don't count.

    A container's name is passed over if hardly any running text is left without it and it has
    most of what is missing; one whose name tells what it holds, only if it has a main heading
    or an article in it.
    """
    weight = [0.0 if noise else len(text) * (1 - links) for _, noise, _, text, links in rows]
    total, off = sum(weight), set()
    while doubts:
        left, missing = 0.0, defaultdict(float)
        for (_, _, named, _, _), w in zip(rows, weight):
            active = [n for n in named if n not in off]
            if not active:
                left += w
            else:
                missing[active[0]] += w
        if not missing or left >= LEAST_LEFT * total:
            break
        number, most = max(missing.items(), key=lambda x: (x[1], -x[0]))
        if 2 * most < total - left or doubts[number] and number not in holds:
            break
        off.add(number)
    return [(path, noise or any(n not in off for n in named), text, links) for path, noise, named, text, links in rows]


def _embedded(page: str) -> dict[int, int]:
    """Where each embedded element ends, by the end of its opening tag; open and empty ones are not in it."""
    ends, opened, at = {}, defaultdict(list), 0
    while m := MARKUP.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in EMBEDDED and m[1]:
            if opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in EMBEDDED and not _self_closed(m[3]):
            opened[tag].append(at)
        elif tag in RAW and not m[1] and not (opened["svg"] and _self_closed(m[3])):
            at = _raw_end(page, tag, at, len(page))
    return ends


def _self_closed(attributes: str) -> bool:
    return (attributes or "").rstrip().endswith("/")


def _raw_end(page: str, tag: str, at: int, missing: int) -> int:
    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
    return close.end() if close else missing


def blocks(page: str) -> list[tuple[str, bool, str, float]]:
    """All blocks of text in page order: container path, noise or not, text, share in links.

    References are decoded, white space inside a block is one blank, blocks without text are
    left out. ``br`` is white space; markup inside a block joins its parts. Scripts and the like
    run to their closing tag, as browsers read them; embedded elements end where they are closed,
    inner ones counted, and are empty if they never are. Formulas are text, without annotations.
    Hidden elements are noise; hidden parts of a block, and those named as adverts or for sharing,
    are left out of it.
    """
    root = _Node("", "", False, None, False)
    node, parts, found = root, [], []
    linked, in_link, at = 0, 0, 0
    ends = None
    doubts: list[bool] = []
    holds: set[int] = set()  # containers in doubt with a main heading or an article in them
    muted, depth = "", 0  # an element inside a block that is left out, and how many of its kind are open

    def close_block():
        nonlocal linked, muted
        if parts:
            text = BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                found.append((node.path, node.noise, node.named, text, min(1.0, linked / len(text))))
            parts.clear()
        linked, muted = 0, ""

    def add(raw):
        nonlocal linked
        if raw and not muted:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    while m := MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == muted:
            depth += -1 if m[1] else 0 if _self_closed(m[3]) else 1
            if not depth:
                muted = ""
        elif not muted and not m[1] and m[3] and tag not in BLOCKS and tag not in VOID and not _self_closed(m[3]):
            if _hidden(m[3]) or any(INLINE.search(t) for _, v in _names(m[3])[0] for t in v.split()):
                muted, depth = tag, 1
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                close_block()
                top = node
                while top.parent is not None and top.tag != tag:
                    if top.tag in ("td", "th", "article", "body") and tag not in ("table", "tr", "article", "main", "body", "html", "section", "div"):
                        break
                    top = top.parent
                if top.parent is not None and top.tag == tag:
                    node = top.parent
            continue
        if tag in RAW:
            at = _raw_end(page, tag, at, len(page))
            continue
        if tag in EMBEDDED:
            ends = _embedded(page) if ends is None else ends
            at = ends.get(at, at)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in BLOCKS and tag not in VOID:
            close_block()
            while node.tag == "p" or node.tag in CLOSES.get(tag, ()):
                node = node.parent
            if not _self_closed(m[3]):
                node = _opened(tag, m[3], node, doubts)
                if tag in ("h1", "article", "main"):
                    holds.update(node.named)
        elif tag == "hr":
            close_block()
    add(page[at:])
    close_block()
    return _settled(found, doubts, holds)


def scores(found) -> dict[str, float]:
    """How much running text each container path holds, its own more than that of inner ones."""
    by_path: dict[str, float] = defaultdict(float)
    for path, noise, text, links in found:
        if noise:
            continue
        weight, inner = len(text) * (1 - links), path
        while inner:
            last = inner.rsplit(">", 1)[1]
            tag = last.split(".", 1)[0]
            factor = WIDE if tag in ("html", "body") else TELLING if tag in ("article", "main") or MAIN.search(last.replace(".", " ")) else 1.0
            by_path[inner] += weight * factor
            weight, inner = weight * LEVEL, inner.rsplit(">", 1)[0]
    return by_path


def _inside(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + ">")


def whole_path(found, path: str) -> str:
    """The path of the whole text, of which the container rated best may be only the body.

    From the best container the outermost article around it is taken, or else the outermost main.
    Then its parents are taken as long as they add running text and either hold nothing else that
    is left out or add only what stands in them directly, such as a title or a lead. The page's body
    is taken only on the second ground, and not around an article. So text beside the body
    container is kept, and what is left out stays out by its own mark.
    """
    steps, named = path.split(">"), False
    for wanted in ("article", "main"):
        at = next((i for i, step in enumerate(steps) if step.split(".", 1)[0] == wanted), None)
        if at is not None:
            path, named = ">".join(steps[: at + 1]), True
            break
    while outer := path.rpartition(">")[0]:
        tag = outer.rsplit(">", 1)[-1].split(".", 1)[0]
        added = [x for x in found if _inside(x[0], outer) and not _inside(x[0], path)]
        kept = [x for x in added if not x[1]]
        if 2 * sum(len(t) * links for _, _, t, links in kept) > sum(len(t) for _, _, t, _ in kept):
            break
        if (tag == "body" or len(kept) < len(added)) and any(p != outer for p, _, _, _ in kept):
            break
        if tag == "html" or tag == "body" and (named or not kept):
            break
        path = outer
    return path


def best_path(found) -> tuple[str, float] | None:
    """The path of the main text and the score of its best container."""
    best = max(scores(found).items(), key=lambda x: (x[1], x[0]), default=None)
    return best and (whole_path(found, best[0]), best[1])


def text_below(found, path: str | None) -> str:
    """The blocks in containers of the path, or in the page's own best where it has none."""
    own = [t for p, noise, t, _ in found if not noise and path and _inside(p, path)]
    if not own and (best := best_path(found)):
        own = [t for p, noise, t, _ in found if not noise and _inside(p, best[0])]
    return "\n".join(own)


def host_column(url):
    after = F.substring_index(F.substring_index(F.substring_index(F.regexp_extract(url, "://(.*)$", 1), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.lower(after), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``vote_host, winner``: for each host the path that most of its pages take for their main text's.

    Votes are added up in each task before they are shuffled; ties go to the larger score, then
    to the path that sorts last. Pages without text don't vote.
    """

    def run(batches):
        votes: dict[tuple[str, str], list[float]] = {}
        for batch in batches:
            for host, page in zip(batch.column("vote_host").to_pylist(), batch.column("html").to_pylist()):
                if page and (best := best_path(blocks(page))):
                    count = votes.setdefault((host, best[0]), [0, 0.0])
                    count[0] += 1
                    count[1] += best[1]
        if votes:
            hosts, paths = zip(*votes)
            columns = [pa.array(hosts), pa.array(paths)]
            columns += [pa.array([int(v[0]) for v in votes.values()]), pa.array([float(v[1]) for v in votes.values()])]
            yield pa.RecordBatch.from_arrays(columns, ["vote_host", "path", "votes", "score"])

    own = pages.select(host_column(F.col("url")).alias("vote_host"), "html")
    votes = map_batches(own, run, "vote_host string, path string, votes long, score double")
    return (
        votes.groupBy("vote_host", "path")
        .agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
        .groupBy("vote_host")
        .agg(F.max_by("path", F.struct("votes", "score", "path")).alias("winner"))
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Pass one rates each page's containers and lets the pages of a host vote on the path of the
    main text (tags and classes without numbers); pass two reads every page again and takes the
    blocks below its host's winning path, in page order, joined by one newline. A page without
    that path is read by its own best. Menus, footers, sidebars, adverts, forms, scripts, styles,
    comments and what is hidden are left out wherever they stand, headers and notices of the page
    outside an article or main element. Names of classes and ids are passed over where a page
    would lose nearly all its text by them.

    Null and empty pages, and pages without such text, give an empty text. Null urls and urls
    without a host vote together. Repeated rows each give a row; an empty table gives an empty
    result; other columns are ignored. Winners, one narrow row for each host, are written and
    counted; up to 200,000 of them are broadcast, more are joined by Spark, which splits a host
    that very many pages share.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = durable(host_paths(pages))
    small = winners.count() <= BROADCAST_ROWS
    hosted = pages.withColumn("host", host_column(F.col("url")))
    joined = hosted.join(
        F.broadcast(winners) if small else winners, F.col("host") == F.col("vote_host"), "left"
    ).select("page_id", "url", "html", "winner")

    def run(batches):
        for batch in batches:
            texts = [
                text_below(blocks(page), winner) if page else ""
                for page, winner in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
