"""HTML extraction by deducing each host's template from equivalence classes of tokens.

1. Every page is read into *tokens*: element paths (the chain of open block elements, with their class or id) and
   whole text blocks. A token's *occurrence vector* lists how often each page of its host has it.
2. Tokens with equal vectors form an *equivalence class*. Vectors aren't gathered: a vector is known by the sum of
   its entries times a hash of the page, which partial sums add up, so a hot host is summed by all tasks.
3. Pages of a host with equal contents count once. A class is *valid* if it is found on ``SUPPORT`` of them,
   equally often on each, and holds
   more than one token. The elements of valid classes nest along their paths into the template. Repeated text
   blocks of valid classes (notices, copyright lines) are template too, unless the main slot is an article.
4. What lies between template elements are *slots*. The main slot is the template element with the most text that
   isn't link text, summed over the host, outside elements that are never main text. Text of elements that aren't
   template belongs to the nearest template element around them.
5. A page's text is the blocks of the main slot, without nested elements that are never main text. A page whose
   main slot holds nothing but repeated text keeps it.

A host of few pages has no vectors to speak of; there all elements but text blocks count as template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import materialize, small_batches

SUPPORT = 0.6
FEW_PAGES = 3

#: Elements by their part in a page (fixed values).
HIDDEN = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas",
          "textarea", "select", "option", "button", "audio", "video", "map"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt",
          "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "blockquote", "body", "html",
          "address", "figure", "fieldset", "legend", "hr", "center", "details", "summary", "figcaption", "hgroup", "search",
          *ASIDE, *HIDDEN}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Text blocks: what repeats inside them is text, not template.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "tbody", "pre", "blockquote",
          "ul", "ol", "dl", "table", "caption", "summary", "figcaption"}
#: An open element of the left kind ends where one of the right kinds begins.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}, "thead": {"tbody"},
}
#: Words in a class, id or role that mark an element which isn't main text.
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|"
    r"sidebar|aside|widget\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|signup|login|search|"
    r"comments?|replies|respond|disqus|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|"
    r"complementary|contentinfo|banner|dialog|alert|hidden)(?:$|[\s_-])", re.IGNORECASE)

_HEADER = re.compile(r"\bheader\b", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<|[^<]+", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Page:
    """A page read once: its blocks in order, each with the elements around it.

    ``blocks``: (path number, text, characters of link text); ``paths``: the chain of block elements as labels,
    with a mark for those inside elements that are never main text.
    """

    def __init__(self, source: str | None):
        self.paths: list[tuple[tuple[str, ...], bool]] = []
        self.blocks: list[tuple[int, str, int]] = []
        self.count: dict[tuple[str, ...], int] = defaultdict(int)
        self._numbers: dict = {}
        self._stack: list[tuple[str, str, bool]] = []  # element, label, not main
        self._text: list[str] = []
        self._links = self._link_chars = 0
        self._read(source or "")

    def _read(self, source: str) -> None:
        at, match = 0, _TOKEN.match
        while at < len(source) and (token := match(source, at)):
            at = token.end()
            name = token[2]
            if name is None:
                if (raw := token[0])[0] != "<" or raw == "<":
                    self._add(raw)
                continue
            if not source[at - 1:at] == ">" and at == len(source):
                break  # a tag cut off at the end
            name = name.lower()
            if token[1]:
                self._close(name)
                continue
            self._open(name, token[3] or "")
            if name in RAW and not token[3].endswith("/"):
                end = re.compile(rf"</{name}(?=[\s>/]|\Z)", re.IGNORECASE).search(source, at)
                at = end.start() if end else len(source)
        self._flush()

    def _add(self, text: str) -> None:
        if any(hidden for *_, hidden in self._stack[-1:]) and self._stack[-1][0] in HIDDEN:
            return
        self._text.append(text)
        if self._links:
            self._link_chars += len(text)

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name in VOID and name != "hr":
            return
        if name == "a":
            self._links += 1
        if name not in BLOCKS:
            return
        self._flush()
        if name == "hr":
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if name in CLOSED_BY.get(self._stack[i][0], ()):
                del self._stack[i:]
                break
            if self._stack[i][0] not in LEAVES and self._stack[i][0] != "head":
                break
        found = {a[0].lower(): (a[1] or a[2] or a[3] or "") for a in _ATTRIBUTE.findall(attributes)}
        marks = " ".join(v for k, v in found.items() if k in ("class", "id", "role"))
        hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
                  or "display:none" in found.get("style", "").replace(" ", "").lower())
        if any(e in MAIN for e, *_ in self._stack):  # an article's own header holds its title
            marks, name_off = _HEADER.sub("", marks), name in ASIDE and name != "header"
        else:
            name_off = name in ASIDE
        off = name in HIDDEN or name_off or hidden or bool(
            name not in ("html", "body") and name not in MAIN and NOT_MAIN.search(marks))
        inner = off or bool(self._stack and self._stack[-1][2])
        label = name  # with marks, but for numbers, which often tell pages apart
        if marks and name not in LEAVES:
            label = f"{name}.{_SPACE.sub('.', _DIGITS.sub('#', marks.replace('/', '-')).strip())[:80]}"
        self._stack.append((name, label, inner))
        self.count[tuple(x[1] for x in self._stack)] += 1

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        if name not in BLOCKS or name == "hr":
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                self._flush()
                del self._stack[i:]
                return
        self._flush()

    def _flush(self) -> None:
        text, links = "".join(self._text), self._link_chars
        self._text, self._link_chars = [], 0
        text = _SPACE.sub(" ", html.unescape(text)).strip()
        if not text or any(e in HIDDEN for e, *_ in self._stack):
            return
        key = (tuple(x[1] for x in self._stack), bool(self._stack and self._stack[-1][2]))
        number = self._numbers.setdefault(key, len(self.paths))
        if number == len(self.paths):
            self.paths.append(key)
        self.blocks.append((number, text, links))


def element_of(path: tuple[str, ...]) -> tuple[str, ...]:
    """The innermost element of a path that can be template: text blocks belong to what holds them."""
    end = len(path)
    while end and path[end - 1].split(".")[0] in LEAVES:
        end -= 1
    return path[:end]


def page_tokens(page: Page) -> Iterator[tuple[str, str, int, int]]:
    """(kind, token, occurrences, characters that aren't links): elements with their text, and text blocks."""
    chars: dict[tuple[str, ...], int] = defaultdict(int)
    texts: dict[str, int] = defaultdict(int)
    for number, text, links in page.blocks:
        path, off = page.paths[number]
        if not off:
            chars[element_of(path)] += max(0, len(text) - links)
        texts["/".join(element_of(path)) + "\n" + text] += 1
    for path, n in page.count.items():
        if element_of(path) == path:
            yield "element", "/".join(path), n, chars.get(path, 0)
    for token, n in texts.items():
        yield "text", token, n, 0


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def token_table(pages: DataFrame) -> DataFrame:
    """host, kind, token, n_pages, least, most, vector, chars: the tokens of each host, summed over its pages.

    ``pages`` has host, page_key (a hash of the page) and html. ``vector`` is the sum over pages of the page's hash
    times the token's occurrences, modulo 2**64: equal vectors give equal sums.
    """
    names = ["host", "kind", "token", "n_pages", "least", "most", "vector", "chars"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flush():
            if not sums:
                return
            keys, values = list(sums), np.array([v[:3] + v[4:] for v in sums.values()], np.int64)
            vector = np.array([v[3] % 2**64 for v in sums.values()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([k[i] for k in keys], pa.string()) for i in range(3)],
                 *[pa.array(values[:, i]) for i in range(3)], pa.array(vector), pa.array(values[:, 3])], names=names)
            sums.clear()

        for batch in batches:
            for part in small_batches(batch):
                for host, key, source in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    for kind, token, n, chars in page_tokens(Page(source)):
                        if kind == "text":
                            token = f"{xxhash.xxh64_intdigest(token.encode('utf-8', 'surrogatepass')):016x}"
                        had = sums.get((host, kind, token))
                        sums[host, kind, token] = (
                            (1, n, n, key * n, chars) if had is None else
                            (had[0] + 1, min(had[1], n), max(had[2], n), had[3] + key * n, had[4] + chars))
                if len(sums) > 200_000:
                    yield from flush()
        yield from flush()

    schema = "host string, kind string, token string, n_pages long, least long, most long, vector long, chars long"
    return pages.select("host", "page_key", "html").mapInArrow(task, schema).groupBy("host", "kind", "token").agg(
        F.sum("n_pages").alias("n_pages"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("chars").alias("chars"))


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, elements (path, chars), texts: each host's template."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("size"))
    tokens = materialize(token_table(pages), "tokens").join(sizes, "host")
    vector = F.pmod("vector", F.lit(str(2**64)).cast("decimal(38,0)"))
    classes = tokens.groupBy("host", vector.alias("vector")).agg(F.count("*").alias("members"))
    few = F.col("size") < FEW_PAGES
    valid = (
        tokens.withColumn("vector", vector).join(classes, ["host", "vector"])
        .where(few & (F.col("kind") == "element")
               | ~few & (F.col("n_pages") >= support * F.col("size")) & (F.col("least") == F.col("most"))
               & (F.col("members") > 1))
    )
    valid = materialize(valid.select("host", "kind", "token", "size"), "valid")
    held = slot_chars(tokens.where("kind = 'element' AND chars > 0"), valid.where("kind = 'element'"))
    valid = valid.join(held, ["host", "kind", "token"], "left").withColumn("chars", F.coalesce("chars", F.lit(0).cast("long")))
    element = F.when(F.col("kind") == "element", F.struct("token", "chars"))
    text = F.when((F.col("kind") == "text") & ~few, F.col("token"))
    return valid.groupBy("host").agg(F.collect_list(element).alias("elements"), F.collect_list(text).alias("texts"))


def slot_chars(elements: DataFrame, valid: DataFrame) -> DataFrame:
    """host, kind, token, chars: the text of ``elements``, summed by the nearest ``valid`` element on their paths."""
    parts = F.split("token", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    around = elements.select("host", "kind", F.col("token").alias("own"), "chars", F.explode(above).alias("token"))
    nearest = around.join(valid.select("host", "kind", "token"), ["host", "kind", "token"]).groupBy(
        "host", "kind", "own").agg(F.max_by("token", F.length("token")).alias("token"), F.max("chars").alias("chars"))
    return nearest.groupBy("host", "kind", "token").agg(F.sum("chars").alias("chars"))


def main_slot(elements: list[tuple[str, int]]) -> str | None:
    """The template element that holds the main text, by the text of the slots inside each."""
    best, most = None, 0
    for token, chars in elements:
        if chars > most or chars == most and best is not None and len(token) < len(best):
            best, most = token, chars
    if best is None:
        return None
    parts = best.split("/")
    for i, part in enumerate(parts):
        if part.split(".")[0] in MAIN:
            return "/".join(parts[:i + 1])
    # headings may stand beside the slot: go up while what is outside is little and only text
    own = dict(elements)
    while len(parts) > 1:
        above = "/".join(parts[:-1])
        inside = sum(c for t, c in own.items() if t == above or t.startswith(above + "/"))
        if parts[-2] in ("body", "html") or above not in own or most < 0.5 * inside:
            break
        parts = parts[:-1]
    return "/".join(parts)


def main_text(page: Page, slot: str | None, texts: set[str]) -> str:
    """Blocks of the main slot, without what is never main text and without repeated text of the template.

    A slot of repeated text alone is kept as it is. A page without the slot gives all its text outside elements that
    are never main text.
    """
    def blocks(inside: str | None, texts: set[str]):
        for number, text, _ in page.blocks:
            path, off = page.paths[number]
            place = "/".join(path)
            if off or inside is not None and place != inside and not place.startswith(inside + "/"):
                continue
            if inside is None or inside.split("/")[-1].split(".")[0] not in MAIN:
                token = "/".join(element_of(path)) + "\n" + text
                if f"{xxhash.xxh64_intdigest(token.encode('utf-8', 'surrogatepass')):016x}" in texts:
                    continue
            yield text

    found = (list(blocks(slot, texts)) or list(blocks(slot, set()))) if slot else []
    if not found:
        own = {"/".join(p[:i + 1]) for p, off in page.paths if not off for i in range(len(p))
               if p[i].split(".")[0] in MAIN}
        found = list(blocks(min(own, key=len) if own else None, texts))
    return "\n".join(found)


def distinct_pages(rows: DataFrame) -> DataFrame:
    """host, page_key, html: the pages of each host with different html. Only html that is repeated is moved."""
    hashed = rows.select("host", F.xxhash64("html").alias("page_key"), "html")
    again = materialize(hashed.groupBy("host", "page_key").count().where("count > 1").drop("count"), "repeated")
    alone = hashed.join(again, ["host", "page_key"], "left_anti")
    once = hashed.join(again, ["host", "page_key"], "left_semi").dropDuplicates(["host", "page_key"])
    return alone.unionByName(once)


def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    NULL and empty pages, and pages without main text, give an empty text. Pages without a host (no or odd URL)
    are a host of their own. Repeated rows are rows of their own, but count once for the template; other columns aren't looked at; an empty
    table gives an empty result. Texts are whole, however long.
    """
    rows = pages.select(F.col("page_id"), "url", "html", host_of("url").alias("host"))
    found = materialize(templates(distinct_pages(rows), support), "templates")
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "host", "elements", "texts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict = {}
        for batch in batches:
            for part in small_batches(batch):
                out = []
                for i, (source, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if host not in slots:
                        if len(slots) >= 1000:
                            slots.clear()
                        elements, texts = part.column(4)[i].as_py(), part.column(5)[i].as_py()
                        slots[host] = (main_slot([(e["token"], e["chars"]) for e in elements or []]), set(texts or []))
                    out.append(main_text(Page(source), *slots[host]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")
