"""Operator 10: main text of web pages by template deduction.

A page is a sequence of tokens: opening and closing tags, told apart by the path of elements that leads to
them (name and class, and a number among container elements of one name in one parent). Over all pages of a
host, each token has an occurrence vector (how often it stands on each page). Tokens with the same vector form
an equivalence class. Vectors are compared by a commutative fingerprint (a sum, over pages, of hash(page) times
count), so that Spark sums them however many pages a host has and no task ever holds a host. A class is valid if
both tags of each of its elements belong to it (then its tokens are ordered and properly nested); classes nest by
path. The template of a host is its valid classes; what remains between template tokens are slots, and Spark sums
what each slot says over all pages: text, text in links, and text outside elements that name themselves as
asides. From these sums the template decides what is main text:

- the container is the innermost element that stands once on its pages and whose slots hold HELD of the host's text
  (links and asides don't count); of several equal siblings that share the text the parent is taken, and an
  article or main element around it in its stead. No element is chosen for its name alone;
- slots inside the container that are links on all pages are menus and go;
- an element whose class, id or role names it an aside (ads, comments, shares) goes if such elements recur on the
  host's pages; a word that stands once is not taken for a name;
- without an article or main element, a block of text at the same path on (nearly) every different page is template.

Elements that are never main text (nav, footer, form and the like) go wherever they stand. A title (h1) next to
the container or to what holds it belongs to the text. A page without its host's container, and a host of few
pages, go by the sums of the page alone.

Defined results: null or empty html gives an empty text; a page with no slot of its own keeps its text whole;
repeated rows stay; null url and page_id are returned as they are; further columns are ignored; very deep pages
take memory in proportion to their depth.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, ready

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that mark text without ending its block.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
#: Elements that an opening tag of the same list ends when it stands open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
ENDS |= {t: {"p"} for t in ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")}
#: An implied end does not reach beyond these.
BOUNDS = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "html", "aside", "nav", "main", "form", "blockquote"}
#: Elements that are never main text.
ASIDE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "input", "textarea", "title", "head", "menu", "dialog", "svg", "object", "noembed", "noframes"}
#: Words in class or id, or roles, that mark what is not main text.
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|respond|replies|cookies?|consent|disclaimer|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo|related|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "alert", "dialog"}
#: Elements that hold the main text by definition: the innermost around the container is taken in its stead.
MAIN = ("article", "main")
#: Elements that can be the container; they are numbered among their like.
CONTAINERS = {"div", "section", "article", "main", "td", "body", "center", "figure", "details", "dd", "aside", "header", "footer", "nav", "form", "ul", "ol", "table"}
CHOSEN = {"div", "section", "article", "main", "td", "body", "center"}
#: A host's frame needs so many pages, and an element of the frame stands on this share of them.
LEAST_PAGES, SHARE = 3, 0.5
#: The container's share of the text; a sibling of its name with this share of the text makes the parent the container.
HELD, RIVAL = 0.6, 0.1
#: Links from this share of a slot's text make it a menu; names of asides recur on this share of pages, and on two.
LINKED, RECURS = 0.8, 0.05
#: A block of text on this share of a host's different pages without a main element is template.
CONSTANT = 0.9
#: Paths longer than this are written as the hash of their beginning.
LONG = 160


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def is_aside(tag: str, attrs: dict[str, str]) -> bool:
    """Never main text, by the element itself."""
    return tag in ASIDE or (bool(attrs) and tag not in ("article", "main", "body", "html") and (attrs.get("role", "").lower() in ROLES or "hidden" in attrs))


def is_hinted(tag: str, attrs: dict[str, str]) -> bool:
    """An aside by its class or id."""
    return bool(attrs) and tag not in ("article", "main", "body", "html") and bool(HINT.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def name_of(tag: str, attrs: dict[str, str]) -> str:
    own = "_".join(sorted((attrs.get("class") or attrs.get("id") or "").split()))
    return f"{tag}.{own if len(own) <= 80 else format(hash_text(own), 'x')}" if own else tag


def scan(html: str):
    """Events of a page in order: ("open", tag, attrs), ("close", tag, None), ("text", text, None)."""
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        m = TOKEN.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:
            lt = html.find("<", lt + 1)
            m = TOKEN.match(html, lt) if lt >= 0 else None
        if lt < 0:
            yield "text", html[at:], None
            return
        if lt > at:
            yield "text", html[at:lt], None
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, None
            continue
        yield "open", tag, attributes(m[3])
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            stop = html.find(">", close.start()) + 1 if close else end
            yield "raw", html[at : close.start() if close else end], None
            yield "close", tag, None
            at = stop or end


class Walk:
    """The open elements of a page; path names each by tag and class, and a container by its number among its like."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[str] = []
        self.like: list[dict[str, int]] = [{}]
        self.count: dict[str, int] = {}

    def _cut(self, k: int) -> int:
        """End the elements from the k-th on."""
        ended = len(self.tags) - k
        for t in self.tags[k:]:
            self.count[t] -= 1
        del self.tags[k:], self.paths[k:], self.like[k + 1 :]
        return ended

    def open(self, tag: str, attrs: dict[str, str]) -> tuple[int, str]:
        """Elements that end here, and the path of the new one."""
        ends = ENDS.get(tag, ())
        k = len(self.tags)
        if any(self.count.get(t) for t in ends):
            for i in range(len(self.tags) - 1, -1, -1):
                if self.tags[i] in ends:
                    k = i
                elif self.tags[i] in BOUNDS:
                    break
        ended = self._cut(k)
        name = name_of(tag, attrs)
        if tag in CONTAINERS:
            n = self.like[-1][name] = self.like[-1].get(name, 0) + 1
            if n > 1:
                name = f"{name}[{n}]"
        above = self.paths[-1] if self.paths else ""
        if len(above) > LONG:
            above = f"#{hash_text(above):x}"
        path = f"{above}/{name}" if above else name
        if tag not in VOID:
            self.tags.append(tag)
            self.paths.append(path)
            self.like.append({})
            self.count[tag] = self.count.get(tag, 0) + 1
        return ended, path

    def close(self, tag: str) -> int:
        """How many elements end with this closing tag; none if it has no opening."""
        if not self.count.get(tag):
            return 0
        i = len(self.tags) - 1
        while self.tags[i] != tag:
            i -= 1
        return self._cut(i)


#: Of a path on a page or a host: openings, closings, text (no asides by element), text outside hinted elements as well, text in links.
Sums = dict[str, list[int]]


def occurrences(events: list[tuple]) -> tuple[Sums, set[str]]:
    """Sums of every path of a page, with all that stands inside, and the names of hinted elements. Inline elements don't structure."""
    found: Sums = {}
    names: set[str] = set()
    walk = Walk()
    held: list[list[int]] = []  # text, good text, links of open elements
    aside, hinted, links = [], [], 0

    def end(n: int) -> None:
        nonlocal links
        for _ in range(n):
            own = held.pop()
            sums = found[paths.pop()]
            for k in range(3):
                sums[2 + k] += own[k]
                if held:
                    held[-1][k] += own[k]
        while aside and aside[-1] > len(held):
            aside.pop()
        while hinted and hinted[-1] > len(held):
            hinted.pop()
        if n:
            links = 0

    paths: list[str] = []
    for kind, tag, attrs in events:
        if kind == "text":
            if held and not aside:
                n = len(" ".join(tag.split()))
                held[-1][0] += n
                held[-1][1] += 0 if hinted or links else n
                held[-1][2] += n if links else 0
        elif tag == "a" and kind != "raw":
            links = kind == "open"
        elif kind == "open" and tag not in INLINE:
            ended, path = walk.open(tag, attrs)
            end(ended)
            found.setdefault(path, [0] * 5)[0] += 1
            if tag not in VOID:
                held.append([0, 0, 0])
                paths.append(path)
                if is_aside(tag, attrs):
                    aside.append(len(held))
                if is_hinted(tag, attrs):
                    hinted.append(len(held))
                    names.add(name_of(tag, attrs))
        elif kind == "close" and tag not in INLINE:
            n = walk.close(tag)
            if n:
                found[paths[-n]][1] += 1
            end(n)
    end(len(held))
    return found, names


def base_of(path: str) -> str:
    return re.sub(r"\[[0-9]+\]$", "", path)


def tag_of(path: str) -> str:
    return re.split(r"[.\[]", path.rpartition("/")[2])[0]


def around(path: str) -> str:
    """The innermost article or main element around a path, or the path itself."""
    at = path
    while at:
        if tag_of(at) in MAIN:
            return at
        at = at.rpartition("/")[0]
    return path


def own_container(found: Sums) -> str | None:
    """The container by the sums of one page: as the host's is found (see containers)."""
    once = {p: v for p, v in found.items() if v[0] == 1 and tag_of(p) in CHOSEN}
    for column in (3, 2):
        total = max((v[column] for v in found.values()), default=0)
        if total and (column == 2 or total * 10 >= max(v[2] for v in found.values())):
            like: dict[str, list[int]] = {}
            for p, v in once.items():
                like.setdefault(base_of(p), []).append(v[column])
            fit = [p for p, v in once.items() if v[column] >= HELD * total and sorted(like[base_of(p)])[-2:][0] * (len(like[base_of(p)]) > 1) < RIVAL * total]
            return around(max(fit, key=lambda p: (p.count("/"), p))) if fit else None
    return None


def extract(html: str | None, container: str | None = None, template: set[int] = frozenset(), names: set[str] | None = None, menus: set[str] = frozenset()) -> str:
    """Text inside the container (of the host, or else the page's own) without blocks of the template, menus, and asides by one of the names (all that are hinted, for None)."""
    events = list(scan(html or ""))
    found, _ = occurrences(events)
    if container not in found:
        container = own_container(found)
    return "\n".join(said for path, said in blocks_of(events, container, names, menus) if not template or block_hash(path, said) not in template)


def blocks_of(events: list[tuple], container: str | None, names: set[str] | None = None, menus: set[str] = frozenset()) -> list[tuple[str, str]]:
    """Blocks of text inside the container, or of the whole page without one, each with its path."""
    walk, blocks, text = Walk(), [], []
    inside: list[int] = []  # depths of open containers
    barred: list[int] = []  # depths of open elements that are no main text
    inline: list[str] = []
    started = False

    def flush() -> None:
        said = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if said:
            blocks.append((walk.paths[-1] if walk.paths else "", said))

    def shrink() -> None:
        depth = len(walk.tags)
        while inside and inside[-1] > depth:
            inside.pop()
        while barred and barred[-1] > depth:
            barred.pop()

    def titled() -> bool:
        """Inside a title that stands beside the container or beside what holds it."""
        return not started and walk.count.get("h1", 0) > 0 and walk.tags[-1] == "h1" and container.startswith("/".join([*walk.paths[-2:-1], ""]))

    def is_barred(tag: str, attrs: dict[str, str], path: str) -> bool:
        return is_aside(tag, attrs) or path in menus or (is_hinted(tag, attrs) and (names is None or name_of(tag, attrs) in names))

    for kind, tag, attrs in events:
        if kind == "text":
            if not barred and not inline and (container is None or inside or titled()):
                text.append(tag)
        elif kind == "open":
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag not in VOID and (inline or is_barred(tag, attrs, "")):
                    inline.append(tag)
                continue
            flush()
            inline.clear()
            _, path = walk.open(tag, attrs)
            shrink()
            if tag not in VOID:
                if path == container:
                    inside.append(len(walk.tags))
                    started = True
                # an element around the container is none of its asides
                if (container is None or inside and path != container or not container.startswith(path)) and is_barred(tag, attrs, path):
                    barred.append(len(walk.tags))
        elif kind == "close":
            if tag in INLINE:
                if inline and tag in inline:
                    while inline.pop() != tag:
                        pass
                continue
            flush()
            inline.clear()
            walk.close(tag)
            shrink()
    flush()
    return blocks


def _hash(n: int) -> int:
    n = (n * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
    n ^= n >> 31
    n = n * 0xD6E8FEB86659FD93 & (2**64 - 1)
    return n ^ n >> 32


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


#: What is summed of each path, beside the fingerprints.
SUMMED = ("pages", "opens", "closes", "said", "good", "linked")


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, path, SUMMED, open_print, close_print: totals and fingerprints of the occurrence vectors of both tags. A hinted name has the path "?name"."""

    def run(batches):
        mask, seen = 2**64 - 1, {}
        for b in batches:
            for h, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = _hash(hash_text(text))
                found, names = occurrences(list(scan(text)))
                found.update((f"?{n}", [0] * 5) for n in names)
                for path, sums in found.items():
                    v = seen.setdefault((h, path), [0] * 8)
                    v[0] += 1
                    for k in range(5):
                        v[k + 1] += sums[k]
                    v[6] = v[6] + page * sums[0] & mask
                    v[7] = v[7] + page * sums[1] & mask
            if len(seen) > 50_000:
                yield batch(seen)
                seen = {}
        yield batch(seen)

    def batch(seen):
        keys, v = list(seen), list(seen.values())
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        cols += [pa.array([x[i] for x in v], pa.int64()) for i in range(6)]
        cols += [pa.array(np.array([x[i] for x in v], np.uint64).view(np.int64)) for i in (6, 7)]
        return pa.RecordBatch.from_arrays(cols, names=["host", "path", *SUMMED, "open_print", "close_print"])

    rows = pages.where("host <> '' and html is not null").select("host", "html").mapInArrow(run, f"host string, path string, {', '.join(f'{c} bigint' for c in SUMMED)}, open_print bigint, close_print bigint")
    # sums of fingerprints go round at 64 bits: they are taken in two halves
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(F.col(c), 32)
    prints = [F.sum(part(c)).alias(f"{c}_{n}") for c in ("open_print", "close_print") for n, part in (("low", low), ("high", high))]
    sums = rows.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in SUMMED], *prints)
    whole = lambda c: F.concat_ws(":", F.pmod(F.col(f"{c}_low"), F.lit(1 << 32)), F.pmod(F.col(f"{c}_high") + F.shiftright(F.col(f"{c}_low"), 32), F.lit(1 << 32)))
    return sums.select("host", "path", *SUMMED, whole("open_print").alias("open_print"), whole("close_print").alias("close_print"))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def block_hash(path: str, said: str) -> int:
    """Of 63 bits; none is -1, which stands for the page itself."""
    return hash_text(f"{path}\n{said}") >> 1


#: No hinted name counts.
NOTHING: frozenset[str] = frozenset()


def bare(events: list[tuple]) -> bool:
    """Whether a page has no element that holds the main text by definition."""
    return not any(kind == "open" and tag in MAIN for kind, tag, _ in events)


def constant_blocks(pages: DataFrame) -> DataFrame:
    """host, blocks: hashes of the blocks that are template on the host's pages without a main element; pages of the same html are one."""

    def run(batches):
        for b in batches:
            hosts, blocks, at = [], [], []
            for h, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                events = list(scan(text))
                if bare(events):
                    page = hash_text(text) >> 1
                    found = {-1, *(block_hash(*x) for x in blocks_of(events, None, NOTHING))}
                    hosts += [h] * len(found)
                    blocks += found
                    at += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(blocks, pa.int64()), pa.array(at, pa.int64())], names=["host", "block", "page"])

    rows = pages.where("host <> '' and html is not null").select("host", "html").mapInArrow(run, "host string, block bigint, page bigint")
    counts = rows.distinct().groupBy("host", "block").agg(F.count("*").alias("n"))
    sizes = counts.where("block = -1").select("host", F.col("n").alias("of"))
    often = counts.where("block <> -1").join(sizes, "host").where((F.col("of") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("of")))
    return often.groupBy("host").agg(F.collect_list("block").alias("blocks"))


def valid(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tokens of the template, with n_pages and whether they stand once on their pages."""
    t = vectors.where("not startswith(path, '?')").join(sizes, "host").where((F.col("n_pages") >= LEAST_PAGES) & (F.col("pages") >= SHARE * F.col("n_pages")))
    # both tags in one class: each opening is closed on every page (elements whose end is implied have no closing tags)
    return t.where((F.col("open_print") == F.col("close_print")) | (F.col("closes") == 0)).withColumn("once", F.col("pages") == F.col("opens"))


def containers(vectors: DataFrame, tokens: DataFrame) -> DataFrame:
    """host, container: the innermost of the once-a-page elements that hold enough of the host's text."""
    tag, base = F.regexp_extract("path", r"([^/.\[]+)[^/]*$", 1), F.regexp_replace("path", r"\[[0-9]+\]$", "")
    all_ = vectors.groupBy("host").agg(F.max("good").alias("all_good"), F.max("said").alias("all_said"))
    mass = F.when(F.col("all_good") * 10 >= F.col("all_said"), F.col("good")).otherwise(F.col("said"))
    total = F.when(F.col("all_good") * 10 >= F.col("all_said"), F.col("all_good")).otherwise(F.col("all_said"))
    t = tokens.where("once").where(tag.isin(*sorted(CHOSEN))).join(all_, "host").select("host", "path", base.alias("base"), mass.alias("mass"), total.alias("total"))
    like = t.groupBy("host", "base").agg(F.get(F.sort_array(F.collect_list("mass"), asc=False), 1).alias("next"))
    fit = t.join(like, ["host", "base"]).where((F.col("mass") >= HELD * F.col("total")) & (F.col("mass") > 0) & (F.coalesce("next", F.lit(0)) < RIVAL * F.col("total")))
    inner = fit.groupBy("host").agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("path"))
    main = F.regexp_extract("path", rf"^(?:.*/)?(?:{'|'.join(MAIN)})(?:[.\[][^/]*)?(?=/|$)", 0)
    return inner.select("host", F.when(main != "", main).otherwise(F.col("path")).alias("container"))


def templates(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, n_pages, container, menus, names, template: what decides, and the valid classes, each with its paths, nested by its shortest one."""
    tokens = valid(vectors, sizes)
    classes = tokens.groupBy("host", "n_pages", "open_print", "pages", "opens", "once").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    classes = classes.select("host", "n_pages", F.struct("once", "pages", "opens", "paths").alias("c"))
    found = classes.groupBy("host", "n_pages").agg(F.sort_array(F.collect_list("c")).alias("template"))
    menus = tokens.where(F.col("path").rlike(r"/(?:ul|ol|div|section|table|p)(?:[.\[][^/]*)?$") & (F.col("linked") > 0) & (F.col("linked") >= LINKED * F.col("said"))).groupBy("host").agg(F.collect_set("path").alias("menus"))
    recur = vectors.where("startswith(path, '?')").join(sizes, "host").where((F.col("pages") >= 2) & (F.col("pages") >= RECURS * F.col("n_pages")))
    names = recur.groupBy("host").agg(F.collect_set(F.expr("substr(path, 2)")).alias("names"))
    return found.join(containers(vectors, tokens), "host", "left").join(menus, "host", "left").join(names, "host", "left").select("host", "n_pages", "container", "menus", "names", "template")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, by the template of its host where it has one."""
    spark = pages.sparkSession
    ready(spark, 200)
    pages = pages.select("page_id", "url", "html", host(F.coalesce("url", F.lit(""))).alias("host"))
    sizes = pages.where("host <> '' and html is not null").groupBy("host").agg(F.count("*").alias("n_pages"))
    vectors = cut(token_vectors(pages))
    frame = templates(vectors, sizes).select("host", "container", "menus", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    frame = cut(frame.join(constant_blocks(pages), "host", "full").select(F.col("host").alias("of"), "container", "menus", "names", "blocks"))
    drop(spark, vectors)
    # a row for each host: Spark broadcasts it if its size allows, else a hot host is split
    joined = pages.join(frame, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "container", "menus", "names", "blocks")

    def run(batches):
        for b in batches:
            texts = []
            for text, *row in zip(*(b.column(c).to_pylist() for c in ("html", "container", "menus", "names", "blocks")), strict=True):
                texts.append(text_of(text, *row))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def text_of(html: str | None, container: str | None, menus: list[str] | None, names: list[str] | None, blocks: list[int] | None) -> str:
    """The slots of the page inside its host's container."""
    events = list(scan(html or ""))
    found, _ = occurrences(events)
    own = container if container in found else own_container(found)
    names, menus = None if names is None else set(names), set(menus or ())
    said = blocks_of(events, own, names, menus)
    if blocks and bare(events):
        template = set(blocks)
        said = [x for x in said if block_hash(*x) not in template] or said
    return "\n".join(x for _, x in said or blocks_of(events, None, names))
