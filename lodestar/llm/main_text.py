"""Main text of web pages by equivalence classes of tokens over the pages of a host.

1. A page becomes a sequence of tokens: tags with their path of open elements, and text pieces with theirs. Pages of a host with
   equal sequences are one page. The occurrence vector of a token over the pages of its host is known by a fingerprint, the sum over
   pages of its count times a hash of the page; tokens of equal fingerprint form an equivalence class. Fingerprints add up, so a
   host with a third of all pages is counted by many tasks, one row per token and task.
2. The class of tokens that stand once on every page is the frame of the host's template. It is valid where it is ordered: its
   tokens are put in the order of their places summed over pages, and a token that breaks this order on any page leaves the frame.
   What lies between two tokens of the frame is a slot.
3. Text pieces outside the frame have one role for each slot in which they stand. Occurrence vectors are counted again by role;
   roles of equal vector form a class, which is valid if it occurs on at least half of the pages of its host and on three, and it
   nests because each role has one slot. Text of the frame and of valid roles is template text; the same words in another slot,
   or as often only over several slots, are not.
4. A page's slots are extracted by reading it again: template text goes, on pages with a marked article too, and so do menus,
   headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, which tags and class names tell. If
   the page marks an article (``article`` or ``main``), the slots in it are the text, otherwise all slots that are left.

A host with fewer than three different pages has no template; its pages are read by tags and class names alone.

Blocks are joined in page order by one space; white space inside a block becomes one space; references are decoded.

Defined results: a null page is empty and has the text ""; a page without markup is its own text; an unclosed element ends where
the page ends or an outer element closes; repeated rows give equal results; an empty table gives an empty result. Pages are
used whole.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import staged
from lodestar.llm.licenses import increasing
from lodestar.llm.url_filter import host

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
_PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split())
CLOSES = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea menu dialog head object canvas audio video".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation navigations menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adbox adsense banner banners promo promos promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager "
    "comment comments commentlist replies reply disqus respond related recommended widget widgets toolbar complementary contentinfo search form".split()
)
#: Class names with one of these say something about an element's neighbours, as in "has-sidebar".
MODIFIERS = frozenset("has with without no is open closed enabled disabled main content body wrapper page layout".split())
ARTICLE = ("article", "main")
MIN_PAGES, SUPPORT = 3, 0.5
#: The slot before the first token of a frame.
START = 0


def boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in ("html", "body", *ARTICLE):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = set(_PARTS.findall(name))
            if parts & BOILERPLATE_WORDS and not parts & MODIFIERS:
                return True
    return False


class Piece:
    """A piece of text between tags: its words so far, where it stands, and whether a block begins with it."""

    __slots__ = ("text", "path", "out", "article", "starts")

    def __init__(self, text: str, path: tuple, out: bool, article: bool, starts: bool):
        self.text, self.path, self.out, self.article, self.starts = text, path, out, article, starts


def pieces(page: str | None) -> tuple[list[Piece], list[tuple[int, tuple]]]:
    """Text pieces of a page in order, and its tags: (text pieces before it, path). Paths of pieces are of (tag, number in the page)."""
    texts: list[Piece] = []
    tags: list[tuple[int, tuple]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, number, in boilerplate, in an article
    page = page or ""
    at, number, fresh = 0, 0, True

    def add(raw: str) -> None:
        nonlocal fresh
        if raw:
            texts.append(Piece(entities.unescape(raw), tuple((s[0], s[1]) for s in stack), bool(stack) and stack[-1][2], bool(stack) and stack[-1][3], fresh))
            fresh = False

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        fresh = fresh or tag in BLOCK
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                del stack[depth:]
            continue
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            # An open inline element does not keep the block before it open.
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), -1)
            if depth >= 0 and tag in CLOSES.get(stack[depth][0], ()):
                del stack[depth:]
        number += 1
        tags.append((len(texts), (*(s[0] for s in stack), tag)))
        if tag in VOID or m[3].endswith("/"):
            continue
        out = bool(stack) and stack[-1][2] or boilerplate(tag, m[3])
        inside = bool(stack) and stack[-1][3] or tag in ARTICLE and not out or 'role="main"' in m[3] and not out
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, number, out, inside))
    add(page[at:])
    return texts, tags


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1


def _text_token(piece: Piece) -> int:
    """Odd; tokens of tags are even."""
    return _hash("/".join(tag for tag, _ in piece.path) + "#" + " ".join(piece.text.split())) | 1


def _sequence(texts: list[Piece], tags: list[tuple[int, tuple]]) -> Iterator[tuple[int, int]]:
    """(token, number of its text piece or -1) in page order; blank pieces have none."""
    at = 0
    for before, path in [*tags, (len(texts), ())]:
        for i in range(at, before):
            if texts[i].text.strip():
                yield _text_token(texts[i]), i
        at = before
        if path:
            yield _hash("/".join(path)) & ~1, -1


def sequence(page: str | None) -> list[int]:
    return [token for token, _ in _sequence(*pieces(page))]


def main_text(page: str | None, frame: Collection[int] = frozenset(), roles: Collection[tuple[int, int]] = frozenset()) -> str:
    """Text of the slots that belong to the article. A role is (token, slot); a slot is named by the frame's token before it."""
    texts, tags = pieces(page)
    free = [not t.out for t in texts]
    if frame or roles:
        slot = START
        for token, i in _sequence(texts, tags):
            inside = token in frame
            slot = token if inside else slot
            if i >= 0 and (inside or (token, slot) in roles):
                free[i] = False
    marked = any(t.article and not t.out for t in texts)
    chosen = [f and (t.article or not marked) for t, f in zip(texts, free, strict=True)]
    blocks: list[str] = []
    broken = True
    for t, c in zip(texts, chosen, strict=True):
        broken = broken or t.starts
        if not c:
            continue
        if broken or not blocks:
            blocks.append(t.text)
        else:
            blocks[-1] += t.text
        broken = False
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


def _counted(parts: Iterator[tuple[str, int, list[tuple]]], keys: int) -> list[tuple]:
    """Rows (host, *key, fingerprint, pages, times, sum of first places) of (host, hash of the page, keys of its tokens in order)."""
    found: dict[tuple, list[int]] = {}
    for name, mark, page in parts:
        own: dict[tuple, list[int]] = {}
        for place, key in enumerate(page):
            own.setdefault((name, *key), [0, place])[0] += 1
        own[(name, -1, *[-1] * (keys - 1))] = [1, 0]
        for key, (n, place) in own.items():
            seen = found.setdefault(key, [0, 0, 0, 0])
            seen[0] = (seen[0] + n * mark) & 0x3FFFFFFFFFFF
            seen[1] += 1
            seen[2] += n
            seen[3] += place
    return [(*k, *v) for k, v in found.items()]


def _summed(df: DataFrame, *key: str) -> DataFrame:
    sums = df.groupBy("host", *key).agg(F.sum("mark").alias("mark"), *(F.sum(c).alias(c) for c in ("pages", "times", "first")))
    return sums.withColumn("mark", F.pmod("mark", F.lit(0x400000000000)))


def _with_host(pages: DataFrame, found: DataFrame, own: str, how: str, max_broadcast: int) -> DataFrame:
    """Pages beside the row of their host, which goes to all tasks while all rows have at most max_broadcast tokens."""
    lists = [f.name for f in found.schema if f.dataType.typeName() == "array"]
    size = found.agg(F.sum(sum((F.size(c) for c in lists), F.lit(0)))).first()[0] or 0
    return pages.join(F.broadcast(found) if size <= max_broadcast else found, F.col(own) == F.col("_host"), how)


def _classes(pages: DataFrame, min_pages: int, support: float, url: str, page: str, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Frames (_host, _frame in order), and roles outside them of enough pages: (host, token, slot, mark, pages, times)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(name, sequence(text)) for name, text in zip(pdf["host"], pdf["_page"], strict=True)]
            yield pd.DataFrame([(name, (xxhash.xxh3_64_intdigest(array("q", seq).tobytes()) >> 1) | 1, seq) for name, seq in rows], columns=["host", "page", "tokens"])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = ((h, int(p), [(t,) for t in seq.tolist()]) for h, p, seq in zip(pdf["host"], pdf["page"], pdf["tokens"], strict=True))
            yield pd.DataFrame(_counted(rows, 1), columns=["host", "token", "mark", "pages", "times", "first"])

    def disorder(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bad = set()
            for name, seq, frame in zip(pdf["host"], pdf["tokens"], pdf["_frame"], strict=True):
                rank = {t: i for i, t in enumerate(frame.tolist())}
                places = [(i, rank[t]) for i, t in enumerate(seq.tolist()) if t in rank]
                if any(a[1] > b[1] for a, b in zip(places, places[1:], strict=False)):
                    kept = {r for _, r in increasing(places)}
                    bad |= {(name, t) for t, r in rank.items() if r not in kept}
            yield pd.DataFrame(list(bad), columns=["host", "token"])

    def count_roles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
            for name, mark, seq, frame, others in zip(pdf["host"], pdf["page"], pdf["tokens"], pdf["_frame"], pdf["_others"], strict=True):
                ordered, often, slot, out = set(frame.tolist()), set(others.tolist()), START, []
                for token in seq.tolist():
                    slot = token if token in ordered else slot
                    if token in often:
                        out.append((token, slot if token & 1 else START))
                yield name, int(mark), out

        for pdf in parts:
            yield pd.DataFrame(_counted(rows(pdf), 2), columns=["host", "token", "slot", "mark", "pages", "times", "first"])

    rows = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("_page"))
    rows = staged(rows.mapInPandas(read, "host string, page long, tokens array<long>").dropDuplicates(["host", "page"]), "page-sequences")
    counted = _summed(rows.mapInPandas(count, "host string, token long, mark long, pages long, times long, first long"), "token")
    counted = staged(counted.where(F.col("pages") >= min_pages), "page-tokens")
    sizes = counted.where("token = -1").select("host", F.col("pages").alias("all"))
    often = counted.where("token <> -1").join(sizes, "host").where(F.col("pages") >= support * F.col("all"))
    once = (F.col("pages") == F.col("all")) & (F.col("times") == F.col("all"))
    hosts = often.groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.when(once, F.struct("first", "token")))), lambda x: x["token"]).alias("_frame"), F.collect_list(F.when(~once, F.col("token"))).alias("_others")
    )
    hosts = staged(hosts.withColumnRenamed("host", "_host"), "page-classes")
    bad = staged(_with_host(rows, hosts, "host", "inner", max_broadcast).select("host", "tokens", "_frame").mapInPandas(disorder, "host string, token long").distinct(), "page-disorder")
    broken = bad.groupBy(F.col("host").alias("_host")).agg(F.collect_list("token").alias("_bad"))
    none = F.array().cast("array<long>")
    hosts = hosts.join(broken, "_host", "left").withColumn("_bad", F.coalesce("_bad", none))
    hosts = staged(hosts.select("_host", F.array_except("_frame", "_bad").alias("_frame"), F.concat("_others", "_bad").alias("_others")), "page-frames")
    roles = _with_host(rows, hosts, "host", "inner", max_broadcast).select("host", "page", "tokens", "_frame", "_others")
    roles = _summed(roles.mapInPandas(count_roles, "host string, token long, slot long, mark long, pages long, times long, first long"), "token", "slot")
    roles = staged(roles.where(F.col("pages") >= min_pages), "page-roles")
    sizes = roles.where("token = -1").select("host", F.col("pages").alias("all"))
    roles = roles.where("token <> -1").join(sizes, "host").where(F.col("pages") >= support * F.col("all"))
    return hosts, roles.select("host", "token", "slot", "mark", "pages", "times")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, url: str = "url", page: str = "html", max_broadcast: int = 200_000) -> DataFrame:
    """(host, token, slot, in_frame, place, class_size): tokens of the valid classes of each host with pages enough."""
    hosts, roles = _classes(pages, min_pages, support, url, page, max_broadcast)
    frames = hosts.select(F.col("_host").alias("host"), F.size("_frame").alias("class_size"), F.posexplode("_frame").alias("place", "token"))
    classes = roles.groupBy("host", "mark", "pages", "times").agg(F.collect_list(F.struct("token", "slot")).alias("_tokens"))
    classes = classes.select("host", F.size("_tokens").alias("class_size"), F.explode("_tokens").alias("_t"))
    return frames.select("host", "token", F.lit(None).cast("long").alias("slot"), F.lit(True).alias("in_frame"), "place", "class_size").unionByName(
        classes.select("host", "_t.token", "_t.slot", F.lit(False).alias("in_frame"), F.lit(None).cast("int").alias("place"), "class_size")
    )


def extract(pages: DataFrame, max_broadcast: int = 200_000, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Templates go to all tasks while they have at most max_broadcast tokens."""
    # Tags carry no text: of the roles only those of text pieces are needed here.
    valid = templates(pages, url=url, page=page, max_broadcast=max_broadcast).where("in_frame OR token % 2 = 1")
    frame, role = F.when(F.col("in_frame"), F.col("token")), F.when(~F.col("in_frame"), F.struct("token", "slot"))
    found = valid.groupBy("host").agg(F.collect_list(frame).alias("_frame"), F.collect_list(role).alias("_roles"))
    found = staged(found.select(F.col("host").alias("_host"), "_frame", F.col("_roles.token").alias("_tokens"), F.col("_roles.slot").alias("_slots")), "page-templates")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("_page"), host(F.col(url)).alias("_own"))

    @F.pandas_udf("string")
    def text(html: pd.Series, frames: pd.Series, tokens: pd.Series, slots: pd.Series) -> pd.Series:
        out = []
        for h, f, t, s in zip(html, frames, tokens, slots, strict=True):
            out.append(main_text(h) if f is None else main_text(h, set(f.tolist()), set(zip(t.tolist(), s.tolist(), strict=True))))
        return pd.Series(out, dtype=object)

    joined = _with_host(rows, found, "_own", "left", max_broadcast)
    out = joined.select("page_id", "url", text(F.col("_page"), F.col("_frame"), F.col("_tokens"), F.col("_slots")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
