"""Operator 8: main text of web pages by consensus host paths.

First, each page's containers are scored by the text, outside links and boilerplate, that they hold.
The page votes for the path of the lowest one that holds all of it, a path being the tags and
generalised classes from the root down. Spark counts the votes by host and path; the path with most
votes wins its host. Then each page is extracted again: the blocks inside elements with the host's
winning path. A page without such an element, or without text there, gives the blocks of the container
that it voted for itself. So does a page of another template: one with far less of its text at the path
than those that voted for it, and most of its text in containers that these don't have.

What isn't the article is certain by tags and roles. Classes and ids are weaker: a name counts only if all its
parts say boilerplate or nothing (`post-comments`, `commentlist`, but neither `related-work` nor `has-sidebar`), and such an
element stays only where it alone has text that counts. All else is for the votes to decide.

Votes are pre-aggregated, so a host with most of the pages is no hot key. The winners are a row per
host; they are broadcast only if there are at most BROADCAST_HOSTS of them, otherwise joined by host
(both sides shuffled, with Spark splitting frequent hosts). The vote is checkpointed.

Cases: null and empty html give an empty text. A null url is a host of its own, ''. Repeated rows stay.
Unclosed elements end with those around them, an unclosed link with its block. Equal votes: more text, then
the smaller path. An empty table gives no rows. Other columns don't matter, whatever their names. A very long
page takes time and memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import by_size, read, written

#: So many hosts with their paths (of PATH_CHARS at most) are sent to every executor, not more.
BROADCAST_HOSTS = 20_000
#: Longer paths are hashed.
PATH_CHARS = 300
#: A container's path is known on a host if this part of the pages that voted for the winner have text in it.
KNOWN = 0.25

# Quotes count only behind "=", as in HTML, and a value without its closing quote ends with the tag.
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""",
    re.DOTALL,
)
#: Two letters or digits.
WORD = re.compile(r"[^\W_].*?[^\W_]", re.DOTALL)
LINK_EDGE = re.compile(r"<(/?)a(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/>"']+)""")
# Elements by what they are in HTML.
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head nav header footer aside form dialog menu".split())
#: These go as well, but stand inside a line of text and don't cut it.
DROPPED_INLINE = set("button select svg canvas video audio datalist".split())
CONTAINERS = set("body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | DROPPED | set(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre address figure figcaption fieldset legend details summary hr hgroup search".split()
)
NESTING = BLOCKS | DROPPED_INLINE
SELF_CLOSING = set("p li dt dd tr td th option".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in a class or id that mark what isn't the article.
DROPPED_WORDS = set(
    """nav navbar navigation menu sidebar aside footer masthead ad ads advert adverts advertisement advertisements advertising banner promo promotion
    sponsor sponsored cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription share sharing social breadcrumb breadcrumbs
    comment comments respond disqus related recommended pager pagination login signup topbar legal disclaimer copyright""".split()
)
#: Words that say nothing by themselves, beside one of those.
FILLERS = set(
    """the js c l u o m site page main global primary secondary post posts entry article articles story stories news blog top bottom left right upper lower
    inner outer list lists item items box boxes slot slots unit zone button buttons btn bar bars area block blocks wrap wrapper container content contents
    section sections form forms link links widget widgets panel group icons icon count title heading body text label row col holder thread policy message
    media network networks follow us toggle mobile desktop sticky fixed user users reader readers guest guests reply replies""".split()
)
#: Those that also count where they are joined with others of both kinds (`commentlist`, `usercomments`).
JOINED_WORDS = set("comment comments respond sidebar footer navigation cookie cookies consent newsletter breadcrumb breadcrumbs advert adverts advertisement popup".split())
#: Longer parts of names aren't cut.
JOINED_CHARS = 40
DROPPED_NAMES = set("header site-header page-header top-header main-header header-wrapper skip-link".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value, bare in ATTRIBUTE.findall(text):
        out.setdefault((name or bare).lower(), html.unescape(value.strip("\"'")))
    return out


def _dropped(tag: str, a: dict[str, str]) -> bool:
    if tag in DROPPED or tag in DROPPED_INLINE or a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in a.get("style", "").replace(" ", "").lower()


def _cut(part: str) -> set[str]:
    """The words of a part of a name: itself, or the known ones (of three letters at least) that it is joined of, one of JOINED_WORDS among them."""
    if part in DROPPED_WORDS or part in FILLERS or len(part) > JOINED_CHARS:
        return {part}
    words: list[set[str] | None] = [set()] + [None] * len(part)  # of each beginning
    for end in range(3, len(part) + 1):
        for start in range(end - 2):
            word = part[start:end]
            if words[start] is not None and (word in JOINED_WORDS or word in FILLERS) and (words[end] is None or word in JOINED_WORDS):
                words[end] = words[start] | {word}
    found = words[-1]
    return found if found and found & JOINED_WORDS else {part}


def _suspect(tag: str, a: dict[str, str]) -> bool:
    """Whether a class or id marks the element as boilerplate."""
    if tag in ("html", "body", "main", "article"):
        return False
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = {w for x in re.split(r"[-_\d]+", name) if x for w in _cut(x)}
        if name in DROPPED_NAMES or parts & DROPPED_WORDS and parts <= DROPPED_WORDS | FILLERS:
            return True
    return False


def _step(tag: str, a: dict[str, str]) -> str:
    """A path's part for an element: its tag and classes, without what numbers single pages."""
    names = {re.sub(r"\d+", "#", n) for n in a.get("class", "").lower().split()}
    return ".".join([tag, *sorted(n for n in names if n.strip("#-_"))])


def _path(parent: str, step: str) -> str:
    path = f"{parent}>{step}"
    return path if len(path) <= PATH_CHARS else "~" + hashlib.blake2b(path.encode(), digest_size=16).hexdigest()


def prose(text: str, links: int) -> int:
    """The characters that count: none of a block that is mostly links or has no word."""
    return len(text) - links if 2 * links <= len(text) and WORD.search(text) else 0


def _without_suspects(found: list[tuple[str, int, int]], boxes: list[tuple[str, int]], suspects: set[int]) -> list[tuple[str, int, int]]:
    """found without the blocks in suspects. Where no text that counts is left and one suspect alone has such text, that one stays, without the suspects in it."""
    if not suspects:
        return found
    over = [-1] * len(boxes)  # the innermost suspect that a container is or lies in
    own, held = [0] * (len(boxes) + 1), [0] * (len(boxes) + 1)  # what counts by innermost suspect, and with those inside; the last place is outside of all
    inner: list[list[int]] = [[] for _ in range(len(boxes) + 1)]
    for i, (_, parent) in enumerate(boxes):
        around = over[parent] if parent >= 0 else -1
        over[i] = i if i in suspects else around
        if i in suspects:
            inner[around].append(i)
    for text, links, box in found:
        own[over[box]] += prose(text, links)
    for i in sorted(suspects, reverse=True):  # a container comes behind its parent
        held[i] += own[i]
        around = over[boxes[i][1]] if boxes[i][1] >= 0 else -1
        held[around] += held[i]
    stays = {-1}
    at = -1
    while not own[at]:
        heirs = [i for i in inner[at] if held[i]]
        if len(heirs) != 1:
            break
        at = heirs[0]
        stays.add(at)
    return [x for x in found if over[x[2]] in stays]


def blocks(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    """The page's text blocks outside boilerplate as (text, characters in links, container), and its containers as (path, parent)."""
    out: list[tuple[str, int, int]] = []
    boxes: list[tuple[str, int]] = [("", -1)]
    suspects: set[int] = set()
    stack: list[tuple[str, int, bool]] = []  # name, container, dropped
    box, drop, links = 0, False, 0
    link = -1  # the stack's height where the open link began
    loose = False  # whether that link has no end of its own
    parts: list[str] = []

    def flush() -> None:
        nonlocal links, link
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, links, box))
            parts.clear()
        links = 0
        if loose:
            link = -1

    def close(i: int) -> None:
        nonlocal box, drop, link
        if box != (stack[i - 1][1] if i else 0) or any(name in BLOCKS for name, _, _ in stack[i:]):
            flush()
        if i < link:
            link = -1
        del stack[i:]
        box, drop = (stack[-1][1], stack[-1][2]) if stack else (0, False)

    def say(text: str) -> None:
        nonlocal links
        if text and not drop:
            parts.append(text)
            if link >= 0:
                links += len(text)

    at = 0
    last = page.rfind(">")  # nothing behind it is a tag
    while at <= last and (m := TOKEN.search(page, at)):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in RAW and not ending:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS and not drop:
            flush()
        elif tag in ("br", "td", "th"):
            say(" ")
        if tag == "a":
            link = -1
            if not ending:
                edge = LINK_EDGE.search(page, at)
                link, loose = len(stack), not (edge and edge[1])
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if stack and (stack[-1][0] == tag and tag in SELF_CLOSING or stack[-1][0] == "p" and tag in BLOCKS):
            close(len(stack) - 1)
        if drop:
            if stack[-1][0] == tag or tag in NESTING and tag not in SELF_CLOSING:
                stack.append((tag, box, True))
            continue
        a = _attributes(m[3]) if m[3].strip() else {}
        gone = _dropped(tag, a)
        doubt = not gone and _suspect(tag, a)
        if doubt:
            flush()
        if not gone and (doubt or tag in CONTAINERS):
            boxes.append((_path(boxes[box][0], _step(tag, a)), box))
            box = len(boxes) - 1
            if doubt:
                suspects.add(box)
        elif gone:
            pass
        elif tag not in BLOCKS or tag in SELF_CLOSING:
            continue
        drop = gone
        stack.append((tag, box, gone))
    say(page[at:])
    flush()
    return _without_suspects(out, boxes, suspects), boxes


def best_box(found: list[tuple[str, int, int]], boxes: list[tuple[str, int]]) -> tuple[int, int, int]:
    """The lowest container with all of the page's text that counts, that text's characters, and those of all blocks in it."""
    own = [0] * len(boxes)
    for text, links, box in found:
        own[box] += prose(text, links)
    if not any(own):
        for text, _, box in found:
            own[box] += len(text)
    held, heirs = own[:], [0] * len(boxes)
    heir = [0] * len(boxes)
    for i in range(len(boxes) - 1, 0, -1):  # a container comes behind its parent
        if held[i]:
            parent = boxes[i][1]
            held[parent] += held[i]
            heirs[parent] += 1
            heir[parent] = i
    best = 0
    while not own[best] and heirs[best] == 1:
        best = heir[best]
    return best, held[0]


def vote(page: str) -> tuple[str | None, int]:
    found, boxes = blocks(page)
    if not found:
        return None, 0
    best, held = best_box(found, boxes)
    return boxes[best][0], held


def _foreign(found: list[tuple[str, int, int]], boxes: list[tuple[str, int]], inside: list[bool], known: frozenset) -> bool:
    """Whether less than half of the page's text is inside and more than half in containers that the host's other pages don't have."""
    total = within = strange = 0
    for text, links, box in found:
        n = prose(text, links)
        total += n
        if inside[box]:
            within += n
        elif boxes[box][0] not in known:
            strange += n
    return 2 * within < total and 2 * strange > total


def extract(page: str, path: str | None, known: frozenset | None = None) -> str:
    """The text inside the elements with the given path, or else inside the page's own best container.

    known: paths of the containers with text on the host's other pages (all if None)."""
    found, boxes = blocks(page)
    if not found:
        return ""
    inside = [False] * len(boxes)
    for wanted in (lambda i: boxes[i][0] == path, lambda i: i == best):
        for i, (_, parent) in enumerate(boxes):
            inside[i] = wanted(i) or parent >= 0 and inside[parent]
        texts = [t for t, _, box in found if inside[box]]
        if texts and (known is None or not _foreign(found, boxes, inside, known)):
            break
        best, known = best_box(found, boxes)[0], None
    return "\n\n".join(texts)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes, known: each host's winning path, and the paths of containers with text on at least a KNOWN part of the pages that voted for it; pages has host and html."""

    def run(batches):
        for part, texts in by_size(batches, "html"):
            hosts, paths, held, seen = [], [], [], []
            for host, page in zip(part.column("host").to_pylist(), texts):
                found, boxes = blocks(page or "")
                if not found:
                    continue
                best, n = best_box(found, boxes)
                own = sorted({boxes[box][0] for _, _, box in found})
                hosts += [host] * (1 + len(own))
                paths += [boxes[best][0]] * (1 + len(own))
                held += [n] + [0] * len(own)
                seen += [None, *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(held, pa.int64()), pa.array(seen, pa.string())], ["host", "path", "held", "seen"])

    said = pages.select("host", "html").mapInArrow(run, "host string, path string, held bigint, seen string")
    counted = written(said.groupBy("host", "path", "seen").agg(F.count(F.lit(1)).alias("votes"), F.sum("held").alias("held")))
    first = F.max_by(F.struct("path", "votes"), F.struct("votes", "held", F.reverse("path")))
    winners = counted.where("seen is null").groupBy("host").agg(first.alias("w")).select("host", "w.path", "w.votes")
    shared = counted.where("seen is not null").select("host", "path", "seen", F.col("votes").alias("n")).join(winners, ["host", "path"])
    known = shared.where(F.col("n") >= F.col("votes") * KNOWN).groupBy("host").agg(F.collect_list("seen").alias("known"))
    return winners.join(known, "host", "left")


def main_texts(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url and text of all rows of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    paths = written(host_paths(rows).select("host", "path", "known"))
    few = paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path", "known")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}

    def run(batches):
        for part, texts in by_size(batches, "html"):
            known = [frozenset(x or ()) for x in part.column("known").to_pylist()]
            found = [extract(x or "", p, k) for x, p, k in zip(texts, part.column("path").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
