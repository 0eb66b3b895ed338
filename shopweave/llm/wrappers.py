"""Main text of web pages by union-free wrappers inferred for each host.

A page is a stream of tags and texts, nested by its tags. Its own repetitions are folded first: siblings that
recur become a repeated group. The streams of a host are then aligned one after the other: equal tags match,
texts become slots, a tag that one side repeats becomes a repeated group, and what only one side has becomes
optional, found by searching each side for the other's next tag. The result, without any choice between
alternatives, is the host's wrapper; slots know how much text they held on all pages.

The wrapper says where the article is: in its ``article`` elements, else ``main``, else elements named after
content, else the innermost container that holds nearly all the text left. Each page gives the texts of the
slots in the first such region that it has; menus, headers, adverts, comments and the like are left out.

Pages are folded where they lie and only distinct shapes with sums are shuffled, so a host with a third of all
pages is a few rows. Shapes of a host are aligned in buckets, and the buckets' wrappers again, until one is
left; a wrapper's size follows the variety of the host's markup, not its pages.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these where they are open, not beyond the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of a class, id or role, that are no part of an article.
NOISE = frozenset("head nav footer aside form script style noscript iframe template dialog menu button select textarea object svg canvas audio video".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead toolbar related recommended share sharing social comment comments "
    "reply replies disqus respond pagination pager search contentinfo complementary dialog hidden".split())
CONTENT_WORDS = frozenset("article post entry content story main body text".split())
#: Deeper elements count as part of their ancestor; most siblings in a repeated group; wrappers aligned by one task at once.
DEPTH, PERIOD, BUCKET = 96, 4, 32
#: Bytes of all regions that may be broadcast; beyond that pages are joined with them.
BROADCAST_BYTES = 32 << 20
#: Containers that a region may be narrowed to.
CONTAINERS = frozenset("html body div section center table tbody tr td main".split())


def _signature(name: str, attributes: str) -> str:
    words: set[str] = set()
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            words.add("hidden")
        elif key != "aria-hidden":
            words.update(w for part in value.split() for w in WORD.findall(part) if not any(x.isdigit() for x in part) or w in NOISE_WORDS)
    return ".".join([name, *sorted(words)])


def _is_noise(sig: str, in_article: bool) -> bool:
    name, *words = sig.split(".")
    return name in NOISE or (not in_article and (name == "header" or "header" in words)) or (name not in ("html", "body") and not NOISE_WORDS.isdisjoint(words))


class Page:
    """``slots`` (path, text, noise), ``paths`` of elements, and ``shape``: entries [name, body, many, maybe].

    An entry is a text slot ("#", body: characters), an element (its signature, body: entries) or a group ("(", body: entries).
    """

    def __init__(self, html: str | None, decode: bool = True):
        self.decode = references.unescape if decode else str  # without, only the shape is of use
        self.slots: list[tuple[str, str, bool]] = []
        self.paths: set[str] = set()
        self.stack: list[tuple[str, str, bool, bool, list]] = [("", "", False, False, [])]  # name, path, noise, in an article, entries
        self.open: Counter = Counter()
        self.over: list[str] = []  # open elements below DEPTH
        self._read(html or "")
        while len(self.stack) > 1:
            self._pop()
        self.shape = fold(self.stack[0][4])

    def _pop(self) -> None:
        name, path, _, _, entries = self.stack.pop()
        self.open[name] -= 1
        self.stack[-1][4].append([path.rsplit("/", 1)[-1], fold(entries), False, False])

    def _end(self, names, beyond) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in beyond:
                return
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self._pop()

    def _start(self, name: str, attributes: str) -> None:
        top = self.stack[-1][0]
        if top == "p" or (top in HEADINGS and name in HEADINGS):
            self._pop()
        if name in ENDS and any(self.open[x] for x in ENDS[name][0]):
            self._end(*ENDS[name])
        if name in VOID:
            return
        if len(self.stack) > DEPTH:
            self.over.append(name)
            return
        _, path, noise, inside, _ = self.stack[-1]
        sig = _signature(name, attributes)
        path = f"{path}/{sig}" if path else sig
        self.paths.add(path)
        self.stack.append((name, path, noise or _is_noise(sig, inside), inside or name == "article", []))
        self.open[name] += 1

    def _close(self, name: str) -> None:
        if name in self.over:
            while self.over.pop() != name:
                pass
        elif self.open[name] and name not in ("html", "body"):
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def _text(self, pieces: list[str]) -> None:
        text = "".join(pieces)
        text = " ".join(text.split()) if self.decode is not str else text.strip()
        pieces.clear()
        if text:
            _, path, noise, _, entries = self.stack[-1]
            self.slots.append((path, text, noise))
            entries.append(["#", len(text), False, False])

    def _read(self, html: str) -> None:
        at, pieces = 0, []
        while at < len(html):
            found = TOKEN.search(html, at)
            pieces.append(self.decode(html[at : found.start() if found else len(html)]))
            if not found:
                break
            at, (slash, name, attributes) = found.end(), found.groups()
            if not name:
                continue
            name = name.lower()
            if name in INLINE and not self.open[name] and (slash or not attributes or not _is_noise(_signature(name, attributes), True)):
                if name == "br":
                    pieces.append(" ")
                continue
            self._text(pieces)
            if slash:
                self._close(name)
                continue
            self._start(name, attributes)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        self._text(pieces)


# --- union-free expressions ---------------------------------------------------------------


def _key(entry: list) -> str:
    return entry[0] if entry[0] != "(" else "(" + " ".join(map(_key, entry[1])) + ")"


def _join(a: list, b: list, many: bool = False) -> list:
    """Two entries of one key as one."""
    return [a[0], a[1] + b[1] if a[0] == "#" else align(a[1], b[1]), a[2] or b[2] or many, a[3] or b[3]]


def fold(entries: list) -> list:
    """Siblings that recur side by side become repeated groups, shortest periods first."""
    period = 1
    while period <= min(PERIOD, len(entries) // 2):
        out, keys, k = [], [_key(e) for e in entries], 0
        while k < len(entries):
            own, end = entries[k : k + period], k + period
            while len(own) == period and keys[end : end + period] == keys[k : k + period]:
                own = [_join(a, b) for a, b in zip(own, entries[end : end + period], strict=True)]
                end += period
            if end == k + period:
                out.append(entries[k])
                k += 1
            else:
                out.append([own[0][0], own[0][1], True, own[0][3]] if period == 1 else ["(", own, True, False])
                k = end
        period = 1 if len(out) < len(entries) and period > 1 else period + 1
        entries = out
    return entries


def _cycles(group: list, run: list) -> list:
    """A group with the entries of ``run``, all of which it knows, as further rounds of it."""
    order = {_key(e): k for k, e in enumerate(group[1])}
    body, part, last = group[1], [], -1
    for e in [*run, None]:
        place = -1 if e is None else order[_key(e)]
        if place <= last and part:
            body, part = align(body, part), []
        part, last = [*part, e], place
    return ["(", body, True, group[3]]


def align(a: list, b: list) -> list:
    """The entries that cover both lists: matches joined, what one side lacks optional, repetitions folded."""
    out: list = []
    keys_a, keys_b = [_key(e) for e in a], [_key(e) for e in b]
    where_a: dict[str, list[int]] = {}
    where_b: dict[str, list[int]] = {}
    for where, keys in ((where_a, keys_a), (where_b, keys_b)):
        for k in range(len(keys) - 1, -1, -1):
            where.setdefault(keys[k], []).append(k)  # falling: the next one is last

    def next_in(where: dict, key: str, least: int) -> int | None:
        places = where.get(key, [])
        while places and places[-1] < least:
            places.pop()
        return places[-1] if places else None

    def optional(entries: list) -> list:
        return [[e[0], e[1], e[2], True] for e in entries]

    i = j = 0
    while i < len(a) and j < len(b):
        if keys_a[i] == keys_b[j]:
            out.append(_join(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        for one, other, at in ((a[i], b, j), (b[j], a, i)):  # a repeated group against its parts
            known = set(map(_key, one[1])) if one[0] == "(" else ()
            end = at
            while end < len(other) and _key(other[end]) in known:
                end += 1
            if end > at:
                out.append(_cycles(one, other[at:end]))
                i, j = (i + 1, end) if other is b else (end, j + 1)
                break
        else:
            to_b, to_a = next_in(where_b, keys_a[i], j), next_in(where_a, keys_b[j], i)
            if to_b is not None and (to_a is None or to_b - j <= to_a - i):
                out += optional(b[j:to_b])
                j = to_b
            elif to_a is not None:
                out += optional(a[i:to_a])
                i = to_a
            else:
                out += optional(sorted((a[i], b[j]), key=_key))
                i, j = i + 1, j + 1
    return fold(out + optional(a[i:]) + optional(b[j:]))


def _amounts(entries: list, put: Iterator[int] | None = None) -> list[int]:
    """The slots' characters in order, replaced by 0 or by those of ``put``."""
    out = []
    for e in entries:
        if e[0] == "#":
            out.append(e[1])
            e[1] = next(put) if put is not None else 0
        else:
            out += _amounts(e[1], put)
    return out


def regions(wrapper: list) -> list[str]:
    """Paths that may hold the article, the likeliest first; the last is the whole page."""
    held: Counter = Counter()
    kinds: dict[str, int] = {"": 9}
    left: Counter = Counter()

    def walk(entries: list, path: str, noise: bool, kind: int) -> int:
        total = 0
        for name, body, *_ in entries:
            if name == "#":
                total += 0 if noise else body
                if kind == 9 and not noise:
                    left[path] += body
            elif name == "(":
                total += walk(body, path, noise, kind)
            else:
                tag, *words = name.split(".")
                here, hidden = f"{path}/{name}" if path else name, noise or _is_noise(name, kind == 1)
                own = 1 if tag == "article" else 2 if tag == "main" or "main" in words else 3 if tag in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(words) else 9
                if own < kind and not hidden:
                    kinds[here] = own
                n = walk(body, here, hidden, min(own, kind))
                held[here] += n
                total += n
        return total

    walk(wrapper, "", False, 9)
    found = sorted((k, -held[p], p) for p, k in kinds.items() if k < 9)
    whole, path = sum(left.values()), ""
    while whole:  # the innermost container of nearly all text outside of these
        below: Counter = Counter()
        for p, n in left.items():
            if p != path and (not path or p.startswith(path + "/")):
                below[p[len(path) + 1 if path else 0 :].split("/")[0]] += n
        name, n = min(below.items(), key=lambda x: (-x[1], x[0]), default=("", 0))
        if n * 10 < whole * 8 or name.split(".")[0] not in CONTAINERS:
            break
        path = f"{path}/{name}" if path else name
    return [p for _, _, p in found] + ([path, ""] if path else [""])


def main_text(html: str | None, places: list[str]) -> str:
    """Blocks of the first of ``places`` that the page has."""
    page = Page(html)
    place = next((p for p in places if p in page.paths), "")
    return "\n\n".join(t for p, t, noise in page.slots if not noise and (not place or p == place or p.startswith(place + "/")))


def host(url: Column) -> Column:
    """The lower-cased host of an address; empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shapes of a task's pages with the characters of their slots."""
    known: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in known], pa.string()), pa.array([s for _, s in known], pa.string()), pa.array(list(known.values()), pa.list_(pa.int64()))], names=["_host", "shape", "chars"])

    for batch in batches:
        for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shape = Page(html, decode=False).shape
            chars = _amounts(shape)
            key = (name, json.dumps(shape, separators=(",", ":")))
            known[key] = [a + b for a, b in zip(known[key], chars, strict=True)] if key in known else chars
        if len(known) > 4096:
            yield out()
            known.clear()
    if known:
        yield out()


def infer(pages: DataFrame) -> DataFrame:
    """(_host, wrapper): each host's wrapper as JSON; ``pages`` has _host and _html."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["shape"], pdf["chars"], strict=True), key=lambda r: (len(r[0]), r[0]))
        wrapper = None
        for shape, chars in rows:
            entries = json.loads(shape)
            if chars is not None and len(chars):
                _amounts(entries, iter([int(x) for x in chars]))
            wrapper = entries if wrapper is None else align(wrapper, entries)
        return pd.DataFrame({"_host": [pdf["_host"].iloc[0]], "shape": [json.dumps(wrapper, separators=(",", ":"))]})

    parts = pages.select("_host", "_html").mapInArrow(_shapes, "_host string, shape string, chars array<long>")
    total = F.aggregate(F.collect_list("chars"), F.lit(None).cast("array<long>"), lambda s, x: F.when(s.isNull(), x).otherwise(F.zip_with(s, x, lambda p, q: p + q)))
    level = materialize(parts.groupBy("_host", "shape").agg(total.alias("chars")), "shapes")  # a row a task and shape before the sum
    while True:
        sizes = level.groupBy("_host").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
        dealt = level.join(sizes, "_host").withColumn("bucket", F.pmod(F.xxhash64("shape"), F.col("buckets")))
        last = (level.groupBy("_host").count().agg(F.max("count")).first()[0] or 0) <= BUCKET
        found = materialize(dealt.groupBy("_host", "bucket").applyInPandas(merged, "_host string, shape string"), "wrappers")
        if last:
            return found.withColumnRenamed("shape", "wrapper")
        level = found.withColumn("chars", F.lit(None).cast("array<long>"))


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``text`` (the article, empty if there is none) and ``n_chars``; columns of those names are replaced.

    A block is a text between tags that are not inline; its character references are decoded and its white space
    turned into single spaces. Null pages count as empty; pages without a host share one wrapper; repeated rows are
    extracted each. The article's headings are part of it.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    own = pages.select(*[F.col(c).alias(f"_page_{c}") for c in keep], host(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_host": pdf["_host"], "_places": [regions(json.loads(w)) for w in pdf["wrapper"]]})

    found = materialize(infer(own).mapInPandas(places, "_host string, _places array<string>"), "regions")
    size = found.agg(F.sum(F.length("_host") + F.length(F.array_join("_places", " ")) + 16)).first()[0] or 0
    joined = own.join(F.broadcast(found) if size <= broadcast_bytes else found, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, p or [""]) for h, p in zip(batch.column("_html").to_pylist(), batch.column("_places").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_page_{c}") for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f"_page_{c}" for c in keep], "text", "n_chars"])

    schema = joined.select(*[f"_page_{c}" for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return joined.mapInArrow(run, schema).withColumnsRenamed({f"_page_{c}": c for c in keep})
