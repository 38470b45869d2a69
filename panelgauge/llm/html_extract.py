"""Main text of web pages by equivalence-class template deduction.

A token of a page is an element (its path of tag names with class or id) or a
text block at its path. A token's occurrence vector holds its count on each
distinct page of the host (pages with the same text outside of menus and the like
are one); the vector is carried as two weighted sums over the pages, which add up
in any order, so a host of any size is summed before the shuffle and never
gathered. Tokens of one host with equal vectors form an equivalence class. Valid
classes stand on at least half of the host's distinct pages: with one occurrence
on each of them, or with more and then at least two tokens (``li`` and what each
``li`` holds). Nested by path, the valid elements are the host's template; what
stands between them, and beside no deeper one, is a slot.

A template decides for all pages of its host:
  content    the article (else main) element of the template where it holds half of
             the slots' text, else the lowest element above all slots
  menus      slots outside of the content of which more than half the text is links
  own        text blocks of a valid class outside of the content (notices and so on);
             inside only those of the content's own class, on each of at least twice
             ``min_pages`` pages, and only while they are under a tenth of its text, so
             that passages which articles share stay
The slots that are left are extracted on every page that has the content element.
A page without it, and a host without a template, go by tag and class names:
article, else main, else the whole page.

Defined results
  null or empty html    an empty text
  null url, no host     pages of one nameless host
  few pages of a host   below ``min_pages`` distinct pages no class is valid
  repeated rows, ids    each row has its own result
  copied pages          one page in the vectors, each with its own result
  very long pages       read in one pass with a stack, whole
  broken markup         unclosed elements end with their parent, a cut tag at the end is dropped; of a skipped element
                        (button, svg and the like) without a closing tag only the tag goes, as of a self-closing svg or math
  empty table           no rows
  other columns         ignored, whatever their names
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import write_cut

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title".split()  # text up to the closing tag, or the page's end
SKIPPED = "noscript template iframe svg math object select option button canvas video audio".split()  # gone with their closing tag
OUTSIDE = frozenset("head nav header footer aside form menu dialog fieldset label input".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element of the key ends open elements of the value when it starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Class and id names that mark what is not the article; of a compound name all words are among them.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>" + "|".join(SKIPPED) + r")(?=[\s/>])(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def blocks(page: str | None) -> Iterator[tuple[tuple[str, ...], bool, str | None, int]]:
    """(path, outside, text, characters in links): the elements as they open (text None) and the text blocks, in page order.

    A class or id name puts an element outside unless it is around the outermost article or main (by such names) or holds most of the page's text.
    """
    found = list(_events(page))
    chars, around, total = {}, [], 0
    for path, outside, named, text, _ in found:
        if text is None:
            if path and _is(path[-1], "article", "main"):
                around.append(named)
        elif not outside:
            total += len(text)
            for k in named:
                chars[k] = chars.get(k, 0) + len(text)
    least = min(map(len, around), default=0)
    exempt = {k for named in around if len(named) == least for k in named} | {k for k, n in chars.items() if 2 * n > total}
    for path, outside, named, text, links in found:
        yield path, outside or any(k not in exempt for k in named), text, links


def _skips(page: str) -> dict[int, int]:
    """Start of each skipped element with a closing tag of its own -> the place after that."""
    out, opened = {}, {}
    for m in _SKIPPED.finditer(page):
        name = (m["name"] or "").lower()
        if not name or name in ("svg", "math") and m["attrs"].endswith("/"):
            continue
        if not m["close"]:
            opened.setdefault(name, []).append(m.start())
        elif opened.get(name):
            out[opened[name].pop()] = m.end()
    return out


def _events(page: str | None) -> Iterator[tuple[tuple[str, ...], bool, tuple[int, ...], str | None, int]]:
    """(path, outside by element, role or hidden, numbers of the elements around that are outside by name, text, characters in links)."""
    stack: list[tuple[str, str, bool, int]] = []  # name, label, outside, number if outside by name else 0
    held: list[str] = []
    numbers, at, skips, page, linked = 0, 0, None, page or "", 0

    def at_top(text):
        return tuple(s[1] for s in stack if s[0] in BLOCKS), any(s[2] for s in stack), tuple(s[3] for s in stack if s[3]), text, linked

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html_module.unescape("".join(held)).split())
            held.clear()
            if text:
                yield at_top(text)
            linked = 0

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            held.append(m["text"])
            if any(s[0] == "a" for s in stack):
                linked += len(m["text"].strip())
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in SKIPPED:
            if not m["close"]:
                skips = _skips(page) if skips is None else skips
                at = skips.get(m.start(), at)
            continue
        if name == "br":
            held.append(" ")
            continue
        block = name in BLOCKS
        if m["close"]:
            top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if top is None or (not block and any(s[0] in BLOCKS for s in stack[top + 1 :])):
                continue
            if block:
                yield from flush()
            del stack[top:]
            continue
        if block:
            yield from flush()
            ended = ENDS.get(name)
            if ended:
                top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ended or stack[i][0] in ("ul", "ol", "dl", "table")), None)
                if top is not None and stack[top][0] in ended:
                    del stack[top:]
            top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
            if top is not None and stack[top][0] == "p":
                del stack[top:]
        if name in VOID:
            continue
        label, outside, number = name, name in OUTSIDE, 0
        if m["attrs"].strip():
            for a in _ATTR.finditer(m["attrs"]):
                kind, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if kind == "hidden":
                    outside = True
                elif kind == "role":
                    outside |= value in OUTSIDE_ROLES
                else:
                    words = _WORD.findall(value)
                    if not number and name not in ("html", "body", "article", "main") and any(_outside_name(x) for x in value.split()):
                        number = numbers = numbers + 1
                    label += ("." if kind == "class" else "#") + "-".join(words)
        stack.append((name, label, outside, number))
        if block:
            yield at_top(None)
    yield from flush()


def _outside_name(name: str) -> bool:
    words = _WORD.findall(name)
    return bool(words) and all(w in OUTSIDE_WORDS for w in words)


def _is(label: str, *names: str) -> bool:
    return re.split(r"[.#]", label, maxsplit=1)[0] in names


def _key(path: tuple[str, ...], text: str | None = None) -> str:
    return ">".join(path) if text is None else ">".join(path) + "\n" + text


def host_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _token_id(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: token, path (elements only), element it stands in (text blocks only), count, characters outside of menus and the like, characters in links.
_token = pa.struct([("token", pa.int64()), ("path", pa.string()), ("up", pa.int64()), ("n", pa.int32()), ("chars", pa.int64()), ("links", pa.int64())])
_token_ddl = "token long, path string, up long, n int, chars long, links long"


def page_tokens(page: str | None) -> tuple[int, list[tuple]]:
    """The digest of a page's text blocks outside of menus and the like, and its tokens; of an element the text that stands in it directly counts."""
    seen: dict[str, list] = {"": ["", None, 1, 0, 0]}
    words: list[str] = []
    for path, outside, text, links in blocks(page):
        place = _key(path)
        if text is None:
            seen.setdefault(place, [place, None, 0, 0, 0])[2] += 1
            continue
        got = seen.setdefault(_key(path, text), [None, _token_id(place), 0, 0, 0])
        got[2] += 1
        if not outside:
            words.append(_key(path, text))
            for t in (got, seen.setdefault(place, [place, None, 0, 0, 0])):
                t[3] += len(text)
                t[4] += min(links, len(text))
    return _token_id("\0".join(words)), [(_token_id(k), *t) for k, t in seen.items()]


_pages = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("tokens", pa.list_(_token))])


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
        found = [page_tokens(p) for p in b.column(1).to_pylist()]
        rows = [t for _, tokens in found for t in tokens]
        bounds = [0]
        for _, tokens in found:
            bounds.append(bounds[-1] + len(tokens))
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _token, strict=True)], fields=list(_token))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], schema=_pages)


@dataclass
class Template:
    """Paths of the content and menu slots, ids of the template's own text blocks."""

    content: list[str]
    menus: list[str]
    own: list[int]


def _within(path: str, root: str) -> bool:
    return not root or path == root or path.startswith(root + ">")


def nest(tokens: list[dict], n_pages: int, min_pages: int) -> Template | None:
    """The template of a host from its tokens on enough pages: token, path, up, w1, w2, pages, total, chars, links."""
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["w1"], t["w2"], t["pages"], t["total"]].append(t)
    valid = [t for c in classes.values() for t in c if t["total"] == t["pages"] or len(c) > 1]
    frame = {t["path"]: t for t in valid if t["path"]}
    if not frame:
        return None
    # nested by path: a place belongs to the deepest template element around it
    elements = {t["token"]: t["path"] for t in tokens if t["path"] is not None}
    texts = [t for t in valid if t["path"] is None and t["total"] == t["pages"]]

    def slot(path: str) -> str:
        while path and path not in frame:
            path = path.rpartition(">")[0]
        return path

    chars, links, fixed = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in texts:
        if t["up"] in elements:
            fixed[elements[t["up"]]] += t["chars"]
    for t in tokens:
        if t["path"] is not None:
            chars[slot(t["path"])] += max(0, t["chars"] - fixed[t["path"]])
            links[slot(t["path"])] += t["links"]
    slots = [s for s in chars if chars[s] > 0]
    menus = {s for s in slots if 2 * links[s] > chars[s]}
    slots = [s for s in slots if s not in menus]
    total = sum(chars[s] for s in slots)
    content: list[str] = []
    for kind in ("article", "main"):
        roots = [p for p in frame if _is(p.rpartition(">")[2], kind) and not any(_is(x, kind) for x in p.split(">")[:-1])]
        if roots and 2 * sum(chars[s] for s in slots if any(_within(s, r) for r in roots)) >= total:
            content = roots
            break
    if not content and slots:
        common = slots[0].split(">") if slots[0] else []
        for s in slots[1:]:
            steps = s.split(">") if s else []
            common = [a for i, a in enumerate(common) if steps[: i + 1] == common[: i + 1]]
        content = [">".join(common)]
    inside = lambda path: any(_within(path, r) for r in content)
    own = [t["token"] for t in texts if t["up"] in elements and not inside(elements[t["up"]])]
    held = [t for t in texts if t["up"] in elements and inside(elements[t["up"]]) and t["pages"] >= max(2 * min_pages, n_pages) and t["chars"]]
    if 10 * sum(t["chars"] for t in held) < sum(chars[s] for s in chars if inside(s)):
        own += [t["token"] for t in held]
    return Template(sorted(content), sorted(m for m in menus if not inside(m)), sorted(own))


_found = pa.schema([("host", pa.string()), ("content", pa.list_(pa.string())), ("menus", pa.list_(pa.string())), ("own", pa.list_(pa.int64()))])


def _nest(min_pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, n, tokens in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                t = nest(tokens, n, min_pages)
                if t:
                    rows.append((host, t.content, t.menus, t.own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _found, strict=True)], schema=_found)

    return run


def deduce_templates(pages: DataFrame, min_pages: int = 5, share: float = 0.5, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, content, menus, own: one row per host with a template."""
    base = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    read = base.mapInArrow(_page_tokens, f"host string, digest long, tokens array<struct<{_token_ddl.replace(' ', ':').replace(',:', ',')}>>")
    distinct = read.groupBy("host", "digest").agg(F.min("tokens").alias("tokens"))  # copies differ in menus at most; the least of them, so that reruns agree
    each = distinct.select("host", "digest", F.inline("tokens"))
    weight = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "digest"), 34) * F.col("n")
    tokens = each.groupBy("host", "token").agg(
        F.max("path").alias("path"), F.max("up").alias("up"), F.sum(weight(1)).alias("w1"), F.sum(weight(2)).alias("w2"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    tokens = write_cut(tokens.where(F.col("pages") >= min_pages), "vectors")
    sizes = tokens.where("path = ''").select("host", F.col("pages").alias("n_pages"))
    common = tokens.join(sizes, "host").where(F.col("pages") >= share * F.col("n_pages"))
    # at most a page's number of tokens, divided by share
    held = common.groupBy("host", "n_pages").agg(F.collect_list(F.struct("token", "path", "up", "w1", "w2", "pages", "total", "chars", "links")).alias("tokens"))
    return held.mapInArrow(_nest(min_pages), "host string, content array<string>, menus array<string>, own array<long>")


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text blocks of the page's slots by its host's template; without one, or without its content element, by names."""
    found = [(path, _key(path), text) for path, outside, text, _ in blocks(page) if text is not None and not outside]
    if template:
        own = set(template.own)
        named = any(_is(r.rpartition(">")[2], "article", "main") for r in template.content)
        inside = [any(_within(k, r) for r in template.content) for _, k, _ in found]
        if any(inside):
            return "\n".join(t for (p, k, t), x in zip(found, inside, strict=True) if (x or not named and not any(_within(k, m) for m in template.menus)) and _token_id(_key(p, t)) not in own)
    for kind in ("article", "main"):
        some = [t for p, _, t in found if any(_is(s, kind) for s in p)]
        if some:
            return "\n".join(some)
    return "\n".join(t for _, _, t in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("html", "content", "menus", "own")]
        texts = [main_text(p, None if c is None else Template(c, m, o)) for p, c, m, o in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id, url, text of every row."""
    templates = write_cut(deduce_templates(pages, url_col=url_col, html_col=html_col, **options), "templates")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    # the templates' size is known from the written files: Spark broadcasts them below its threshold and joins by host beyond it
    joined = base.withColumn("host", host_of("url")).join(templates, "host", "left").select("page_id", "url", "html", "content", "menus", "own")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
