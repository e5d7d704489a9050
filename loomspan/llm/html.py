"""HTML main-text extraction by consensus paths of a host.

Each page scores its own containers by the text that stands in blocks below them, little of it links, and votes for the
best one's path: tags with classes, numbers generalised. Spark sums the votes by host and path; every page is then read
anew with its host's winning paths, in order of their votes, and with its own best container if it holds none of them.

Text: character references decoded; white space inside a block becomes one space, ends trimmed; blocks joined in page
order by one space. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out. Some tags, roles and names of classes or ids decide that alone (nav, advert, cookies, comments); other names
(notice, related, share) and an article's own header are doubtful: inside an article, or the best container, such a part
stays unless over half of it is links; elsewhere it goes. A form goes unless it holds an article or half of the page's text.

Defined results: null or empty html, and html without text, give an empty text; a null url, and one without a host, is
voted on together with others of the host ""; ties go to the more text, then to the path least in order; repeated rows
vote each and give equal rows; an empty table gives none; other columns are ignored. Time and memory are linear in a page's
length, however deep it is. An iframe, textarea, title, xmp, noembed or noframes that isn't closed hides nothing; a script
or style that isn't closed ends at the next tag of the page's structure.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._shared import Scratch, spread

#: Paths with at least this share of a host's votes win; so a host has at most 20.
WINNING_SHARE = 0.05
#: The winners' table is broadcast up to so many bytes of paths; beyond, pages are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?:!|\?)[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body center div main section table td html".split())
_DROPPED = frozenset("head script style noscript template iframe object svg canvas math audio video nav footer aside button select textarea input menu dialog noembed noframes map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what isn't the article, wherever it stands.
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo cookie cookies consent gdpr popup modal lightbox "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination footer colophon masthead topbar "
    "comment comments commentlist disqus respond replies newsletter subscribe subscription signup login outbrain taboola".split()
)
#: Words that mark it unless it stands inside the article and is text rather than links.
_DOUBTFUL = frozenset(
    "promotion banner banners notice notices alert overlay aside widget widgets rail toc foot copyright header toolbar reply share sharing social follow "
    "related recommended recommendations teaser teasers hidden skip".split()
)
#: A name with one of these, as "has-sidebar", is of a layout around all, not of the part named.
_LAYOUT = frozenset("has with no without".split())
_CLOSES_P = _BLOCK - {"li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary", "body", "html", "head"}
#: An opening tag ends an open one of these, looking no further up than to the third set.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


_STRUCTURE = re.compile(r"<(?=/?(?:html|head|body|article|main|section|div|p|h[1-6]|nav|header|footer|aside|ul|ol|table|form)[\s/>])", re.I)


def _marks(attributes: dict[str, str]) -> int:
    """0: nothing against the part; 1: doubtful; 2: not of the article."""
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return 2
    found = 0
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        names = {n.lower() for n in _NAME.findall(token)}
        if not names & _LAYOUT:
            found = max(found, 2 if names & _NOT_ARTICLE else 1 if names & _DOUBTFUL else 0)
    return found


def _key(above: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(above.to_bytes(8, "little") + step.encode("utf-8", "replace"))


def path_key(path: str) -> int:
    """A path as 64 bits, made step by step, so that a page's containers all have theirs without their paths."""
    found = 0
    for step in path.split(">") if path != "#" else ():
        found = _key(found, step)
    return found


class Page:
    """Elements in page order, and the blocks of text that aren't left out."""

    def __init__(self, source: str):
        #: Of each container: tag-class step, parent's number, key of its path, weight.
        self.steps: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.keys: list[int] = [0]
        self.weights: list[float] = [1.0]
        #: Of each block: container, text, characters of links, doubtful part (0: none).
        self.blocks: list[tuple[int, str, int, int]] = []
        #: Of each doubtful part: the part around it, container, whether it is a form, whether it is in or holds an article.
        self.parts: list[list] = [[-1, 0, False, False]]
        self._read(source)
        self._score()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int, bool]] = [("#", 0, False, 0, False)]  # tag, container, left out, part, inside an article
        opened: Counter = Counter()
        unclosed: set[str] = set()
        buffer: list[str] = []
        links = depth_of_links = 0

        def flush() -> None:
            nonlocal links
            text = " ".join("".join(buffer).split())
            if text and not stack[-1][2]:
                self.blocks.append((stack[-1][1], text, min(links, len(text)), stack[-1][3]))
            buffer.clear()
            links = 0

        def pop(to: int) -> None:
            nonlocal depth_of_links
            while len(stack) > to:
                if stack[-1][0] in _BLOCK or stack[-1][2:4] != stack[-2][2:4]:
                    flush()
                depth_of_links -= stack[-1][0] == "a"
                opened[stack.pop()[0]] -= 1

        def text(part: str) -> None:
            nonlocal links
            if part and not stack[-1][2]:
                part = _html.unescape(part) if "&" in part else part
                buffer.append(part)
                if depth_of_links:
                    links += len(part.strip())

        at = 0
        while found := _TOKEN.search(source, at):
            text(source[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if tag is None:
                if found["cdata"]:
                    text(found["cdata"].replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if found["end"]:
                if tag == "br":
                    text(" ")
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if tag not in _BLOCK and stack[k][0] in _BLOCK:
                        break  # an inline end tag closes nothing beyond its block
                    if tag not in ("table", "body", "html", "article", "main") and stack[k][0] in ("table", "article", "main"):
                        break
                continue
            if tag in ("br", "wbr", "hr"):
                if tag == "hr":
                    flush()
                text(" " if tag != "wbr" else "")
                continue
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = None if tag in unclosed else _RAW[tag].search(source, at)
                if end is None:
                    unclosed.add(tag)
                    if tag in ("script", "style"):
                        onward = _STRUCTURE.search(source, at)
                        at = onward.start() if onward else len(source)
                    continue
                if tag != "script" and tag != "style":
                    flush()
                at = end.end()
                continue
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if tag in _IMPLIED:
                ends, stop = _IMPLIED[tag]
                last = None
                for k in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in ends:
                        last = k
                if last:
                    pop(last)
            attributes = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(found["more"])} if "=" in found["more"] else {}
            _, own, left, part, inside = stack[-1]
            is_article = tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
            mark = _marks(attributes) if attributes and tag not in ("html", "body") else 0
            if tag in ("article", "main"):
                mark = mark if inside and mark == 2 else 0
            elif tag == "header":
                mark = max(mark, 1 if inside else 2)
            elif tag in ("label", "legend") and self.parts[part][2]:
                mark = 2
            out = left or mark == 2 or tag in _DROPPED
            new_part = not out and (mark == 1 or tag == "form")
            if tag in _BLOCK or out != left or new_part:
                flush()
            if new_part:
                self.parts.append([part, own, tag == "form", inside])
                part = len(self.parts) - 1
            if is_article and not out:
                inside = True
                around = part
                while around and not self.parts[around][3]:
                    self.parts[around][3] = self.parts[around][2]
                    around = self.parts[around][0]
            if tag in _CONTAINER and not out:
                classes = sorted({re.sub(r"\d+", "N", c).replace(">", "_") for c in attributes.get("class", "").split()})
                self.steps.append(".".join([tag, *classes]))
                self.keys.append(_key(self.keys[own], self.steps[-1]))
                self.parents.append(own)
                self.weights.append(3.0 if is_article else 1.0)
                own = len(self.steps) - 1
            stack.append((tag, own, out, part, inside))
            opened[tag] += 1
            depth_of_links += tag == "a"
        text(source[at:])
        pop(1)
        flush()

    def _score(self) -> None:
        """Scores, texts and links of containers, the container of the highest score, and the blocks that no doubt removes."""
        length, linked = [0] * len(self.parts), [0] * len(self.parts)
        for _, t, n, part in self.blocks:
            length[part] += len(t)
            linked[part] += n
        for p in range(len(self.parts) - 1, 0, -1):
            length[self.parts[p][0]] += length[p]
            linked[self.parts[p][0]] += linked[p]
        #: Of each part: 0 if it goes, 1 if it stays, 2 if it stays inside the best container only.
        stays = [1]
        for p, (around, _, is_form, article) in enumerate(self.parts[1:], 1):
            if is_form:
                own = 1 if article or 2 * length[p] >= length[0] else 0
            else:
                own = 0 if 2 * linked[p] > length[p] else 1 if article else 2
            stays.append(0 if not own or not stays[around] else max(own, stays[around]))
        scores, self.texts, self.linked = ([0.0] * len(self.steps) for _ in range(3))
        for k, t, n, part in self.blocks:
            if stays[part] == 1:
                scores[k] += (len(t) - n) * (1 - n / len(t))
                self.texts[k] += len(t)
                self.linked[k] += n
        for k in range(len(self.steps) - 1, 0, -1):
            up = self.parents[k]
            scores[up] += scores[k] / 2
            self.texts[up] += self.texts[k]
            self.linked[up] += self.linked[k]
        self.scores = [s * w for s, w in zip(scores, self.weights, strict=True)]
        self.top = max(range(len(scores)), key=lambda i: (self.scores[i], -i))
        inside = self._below({self.top})
        self.kept = [stays[part] == 1 or (stays[part] == 2 and self._owners_inside(part, inside)) for _, _, _, part in self.blocks]

    def _owners_inside(self, part: int, inside: list[bool]) -> bool:
        return not self.is_body(self.top) and inside[self.parts[part][1]]

    def _below(self, chosen: set[int]) -> list[bool]:
        inside = [k in chosen for k in range(len(self.parents))]
        for k, parent in enumerate(self.parents):
            inside[k] = inside[k] or (parent >= 0 and inside[parent])
        return inside

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(self.steps[k])
            k = self.parents[k]
        return ">".join(reversed(steps)) or "#"

    def is_body(self, k: int) -> bool:
        return self.steps[k].partition(".")[0] in ("#", "html", "body")

    def best(self) -> tuple[int, float]:
        """The container with the highest score: text outside links, whole in a block's container, half in the one above, and so on.

        Then up to a container around it (not the whole body) as long as hardly any of what that adds is links, whatever its
        length: parts left out by tag or name aren't in it.
        """
        k = self.top
        while (up := self.parents[k]) > 0 and not self.is_body(up):
            if 5 * (self.linked[up] - self.linked[k]) > self.texts[up] - self.texts[k]:
                break
            k = up
        return k, self.scores[k]

    def text_of(self, chosen: set[int]) -> str:
        inside = self._below(chosen)
        return " ".join(t for (k, t, _, _), kept in zip(self.blocks, self.kept, strict=True) if kept and inside[k])


def vote(source: str | None) -> tuple[str, float] | None:
    page = Page(source or "")
    k, score = page.best()
    return (page.path(k), score) if score > 0 else None


def extract(source: str | None, paths: list[str]) -> str:
    """The text below the first of `paths` that the page has with text, and below those of the others that are siblings of it, in page order; else below its own best container."""
    page = Page(source or "")
    if paths:
        keys = [path_key(p) for p in paths]
        by_path: dict[int, set[int]] = {k: set() for k in keys}
        for k, key in enumerate(page.keys):
            if key in by_path:
                by_path[key].add(k)
        for key in keys:
            if by_path[key] and page.text_of(by_path[key]):
                around = {page.parents[k] for k in by_path[key]}
                beside = [k for other in keys for k in by_path[other] if page.parents[k] in around and not page.is_body(page.parents[k])]
                return page.text_of(by_path[key].union(beside))
    k, score = page.best()
    return page.text_of({k}) if score > 0 else page.text_of({0})


def host(url: str) -> Column:
    """The url's host in lower case without www., a port or a user; "" if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", winning_share: float = WINNING_SHARE) -> DataFrame:
    """(host, paths): of each host the winning paths, most votes first."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(h) for h in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([v and v[0] for v in found], pa.string()), pa.array([v and v[1] for v in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "score"])

    each = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(votes, "host string, path string, score double").where("path IS NOT NULL")
    by_path = each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    by_path = Scratch(pages.sparkSession, "hosts").keep(by_path, "votes")
    total = by_path.groupBy("host").agg(F.sum("votes").alias("total"))
    ranked = by_path.join(total, "host").where(F.col("votes") >= winning_share * F.col("total"))
    ranked = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.round(-F.col("score"), 3).alias("s"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", winning_share: float = WINNING_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    winners = Scratch(pages.sparkSession, "html").keep(host_paths(pages, url_col, html_col, winning_share), "winners")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(html_col).alias("html"))
    weight = winners.agg(F.sum(F.length("host") + 16 + F.aggregate("paths", F.lit(0), lambda n, p: n + F.octet_length(p) + 16))).first()[0] or 0
    packed = weight > broadcast_bytes
    if packed:  # the shuffle carries compressed pages
        rows = rows.mapInArrow(_compressed, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, host string, html binary").join(winners, "host", "left")
    else:
        rows = rows.join(F.broadcast(winners), "host", "left")
    rows = rows.select("page_id", "url", "html", "paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [extract(undo(h).decode() if packed and h is not None else h, p or []) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        html = pa.array([None if h is None else press(h.encode("utf-8", "replace")) for h in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], html], names=batch.schema.names)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
