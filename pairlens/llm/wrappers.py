"""Main text of pages by wrappers: union-free regular expressions inferred from the token streams of each host.

1. A page becomes a stream of block tags and text slots. Stretches of equal tags that follow each other are folded into
   repeated groups, so a page's expression does not grow with its paragraphs. Block texts are kept beside it, each with
   the number of its slot.
2. The different expressions of a host are aligned one after the other: tags on both sides are merged, what stands on one
   side only becomes optional, what then repeats is folded again. Groups of a host are aligned apart and their results
   aligned last, so a host with a third of all pages is spread; memory is that of one expression.
3. Every page expression is aligned with its host's wrapper, which tells the wrapper's slot for each of its slots. Over a
   host's different pages, each slot has its characters, linked characters, and texts that most of the pages share.
4. A wrapper's slots are main text or not: by its article or main element if it has one, else by the container with most
   text that is neither linked nor shared; menus, headers, footers, sidebars, notices, adverts, forms and comments are told
   by tag, role and class. A page without any main slot of its wrapper is judged by its own expression.

Pages are parsed once; what follows goes by host and expression. Text is taken whole.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of HTML: elements without content, those whose content is no text, those that stand inside a block, and
#: those that end an open element of the same kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style noscript template svg math iframe object canvas audio video map head title select button textarea datalist applet noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
BREAKS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"ul", "ol", "dl", "table", "body", "html"}
#: Blocks that hold text for the container around them.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption caption address center hgroup header".split())
#: Elements, roles and words of class names and ids that mark what is no main text.
ASIDE = set("nav aside footer menu dialog form fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget "
    "widgets banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply share sharing social "
    "related recommended recommendations pagination pager toolbar search searchbox skip copyright hidden".split()
)
#: Words that name a part of the article where they stand with a word above that is no comment, advert or the like.
OWN, PARTS = set("article entry post story".split()), {"header"}
BODY = set("content body text".split())

#: Depth below which tags are passed over (their texts stay), period of repeated groups, groups a host is aligned in.
DEPTH, PERIOD, GROUPS = 120, 6, 16
#: Pages from which texts shared by ``SHARED`` of them are the template's; part of the largest that counts beside it.
LEAST_PAGES, SHARED, BESIDE = 4, 0.5, 0.25
FEW = 100_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_PARSED = "page_id long, url string, host string, sk long, skel string, body long, texts array<string>, slots array<int>, lens array<int>, links array<int>, hashes array<bigint>"


# ---- expressions: [label, quantifier, item, ...]; ["#", quantifier, [members]] is a text slot, "()" a group ----


def _opt(q: str) -> str:
    return {"": "?", "+": "*"}.get(q, q)


def _plus(q: str) -> str:
    return {"": "+", "?": "*"}.get(q, q)


def _both(a: str, b: str) -> str:
    q = _plus("") if {"+", "*"} & {a, b} else ""
    return _opt(q) if {"?", "*"} & {a, b} else q


def _key(x: list) -> str:
    return "(" + " ".join(map(_key, x[2:])) + ")" if x[0] == "()" else x[0]


def merge(x: list, y: list) -> list:
    """The expression of two items of one key."""
    if x[0] == "#":
        return ["#", _both(x[1], y[1]), x[2] + y[2]]
    return [x[0], _both(x[1], y[1]), *merge_items(x[2:], y[2:])]


def _absorb(items: list, groups: list) -> list:
    """Items with runs that repeat a group's body taken as that group."""
    for g in groups:
        body, out, i = [_key(b) for b in g[2:]], [], 0
        keys = [_key(b) for b in items]
        while i < len(items):
            if keys[i : i + len(body)] == body:
                one = ["()", "", *items[i : i + len(body)]]
                i += len(body)
                while keys[i : i + len(body)] == body:
                    one = merge(one, ["()", "+", *items[i : i + len(body)]])
                    i += len(body)
                out.append(one)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merge_items(x: list, y: list) -> list:
    """Two item sequences aligned: common keys merged, the rest optional, what repeats then folded."""
    if not x and not y:
        return []
    gx, gy = ([i for i in s if i[0] == "()"] for s in (x, y))
    x, y = _absorb(x, gy) if gy else x, _absorb(y, gx) if gx else y
    kx, ky = list(map(_key, x)), list(map(_key, y))
    if kx == ky:
        return [merge(a, b) for a, b in zip(x, y)]
    out, i, j = [], 0, 0
    loose = lambda part: [[p[0], _opt(p[1]), *p[2:]] for p in part]
    for m in SequenceMatcher(None, kx, ky, autojunk=False).get_matching_blocks():
        out += loose(x[i : m.a]) + loose(y[j : m.b])
        out += [merge(a, b) for a, b in zip(x[m.a : m.a + m.size], y[m.b : m.b + m.size])]
        i, j = m.a + m.size, m.b + m.size
    return fold(out)


def fold(items: list) -> list:
    """Neighbouring repeats of up to ``PERIOD`` items become one repeated item or group."""
    again = True
    while again:
        again = False
        for period in range(1, min(PERIOD, len(items) // 2) + 1):
            keys, out, i = list(map(_key, items)), [], 0
            while i < len(items):
                body = keys[i : i + period]
                end = i + period
                while len(body) == period and keys[end : end + period] == body:
                    end += period
                if end == i + period or len(body) < period:
                    out.append(items[i])
                    i += 1
                    continue
                parts = [items[k : k + period] for k in range(i, end, period)]
                if period == 1:
                    one = parts[0][0]
                    for p in parts[1:]:
                        one = merge(one, p[0])
                    out.append([one[0], _plus(one[1]), *one[2:]])
                else:
                    one = ["()", "+", *parts[0]]
                    for p in parts[1:]:
                        one = merge(one, ["()", "+", *p])
                    out.append(one)
                i = end
            if len(out) < len(items):
                items, again = out, True
                break
    return items


def slots(item: list) -> Iterator[list]:
    """Text slots of an expression, in order."""
    if item[0] == "#":
        yield item
    else:
        for x in item[2:]:
            yield from slots(x)


def paths(item: list, above: tuple = ()) -> Iterator[tuple]:
    """For each text slot, in order, the tags above it."""
    if item[0] == "#":
        yield above
    else:
        for x in item[2:]:
            yield from paths(x, above if item[0] == "()" else (*above, item[0]))


def bare(item: list) -> list:
    """The expression without members of its slots."""
    return ["#", item[1], []] if item[0] == "#" else [item[0], item[1], *map(bare, item[2:])]


def pattern(item: list) -> str:
    """An expression as text: <tag>...</tag>, # for text, quantifiers after brackets."""
    if item[0] == "#":
        return "#" + item[1].replace("+", "").replace("*", "?")
    inside = "".join(map(pattern, item[2:]))
    inside = inside if item[0] == "()" else f"<{item[0]}>{inside}</{item[0].split(' ')[0]}>"
    return f"({inside}){item[1]}" if item[1] else inside


# ---- a page ----


def _label(name: str, attributes: str) -> str:
    """Tag with the words of class and id (numbers as 0), role, and whether it is hidden."""
    if not attributes or attributes == "/":
        return name
    words: set[str] = set()
    for k, *v in ATTRIBUTE.findall(attributes):
        value = "".join(v)
        k = k.lower()
        if k in ("class", "id"):
            words.update("0" if w.isdigit() else w.lower() for w in WORD.findall(value))
        elif k == "role":
            words.add("role:" + value.strip().lower())
        elif k == "itemprop" and value.lower() == "articlebody":
            words.update(("article", "body"))
        elif k == "hidden" or k == "aria-hidden" and value.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", value):
            words.add("hidden")
    return " ".join([name, *sorted(words)])


def parse(page: str | None) -> tuple[list, list[str], list[int]]:
    """The folded expression of a page, its block texts in order, and the linked characters of each; the members of a
    slot are the positions of its texts."""
    root: list = ["html", ""]
    stack, links = [root], [0]  # open elements, and links opened in each
    texts, linked, parts = [], [], []
    page = page or ""
    at, n, skipping = 0, len(page), 0

    def end_block() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                stack[-1].append(["#", "", [len(texts)]])
                texts.append(text)
                linked.append(min(len(text), sum(len("".join(p.split())) for p, inside in parts if inside)))
            parts.clear()

    def pop() -> None:
        end_block()
        x = stack.pop()
        links.pop()
        x[2:] = fold(x[2:])

    deep = 0
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append((entities.unescape(text), any(links)))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                for k in range(len(links) - 1, -1, -1):
                    if links[k]:
                        links[k] -= 1
                        break
            elif name not in INLINE and name not in VOID:
                end_block()
                names = [s[0].split(" ")[0] for s in stack[1:]]
                if name in names:
                    for _ in range(len(names) - len(names) + names[::-1].index(name) + 1):
                        pop()
            continue
        if name in SKIP and not m[3].rstrip().endswith("/"):
            ends = rf"</{name}\s*>" if name != "head" else r"</head\s*>|(?=<body[\s>])"
            close = re.compile(ends, re.I).search(page, at)
            if close:
                at = close.end()
            elif name in ("script", "style", "head", "title", "textarea"):
                at = n if name != "head" else at
            if name in ("select", "button", "textarea") and parts:
                parts.append((" ", False))
            continue
        if name == "a":
            links[-1] += 1
        elif name == "br":
            parts.append((" ", False))
        elif name in ("html", "body"):
            end_block()
        if name in INLINE or name in VOID or name in ("html", "body"):
            if name == "hr":
                end_block()
            continue
        end_block()
        if stack[-1][0].split(" ")[0] == "p":
            pop()
        closes = BREAKS.get(name, ())
        while closes and len(stack) > 1:
            names = [s[0].split(" ")[0] for s in stack]
            k = next((k for k in range(len(names) - 1, 0, -1) if names[k] in closes or names[k] in HOLDS - {"tbody"}), 0)
            if not k or names[k] not in closes:
                break
            while len(stack) > k:
                pop()
        if len(stack) < DEPTH and not m[3].rstrip().endswith("/"):
            x = [_label(name, m[3]), ""]
            stack[-1].append(x)
            stack.append(x)
            links.append(0)
        else:
            deep += 1
    end_block()
    while len(stack) > 1:
        pop()
    root[2:] = fold(root[2:])
    return root, texts, linked


# ---- what is main text ----


def _marked(label: str) -> bool:
    """Whether tag, role or words say that this is no main text."""
    name, *words = label.split(" ")
    if name in ASIDE or any(w[5:] in ROLES for w in words if w.startswith("role:")):
        return True
    found = WORDS & set(words)
    if OWN & set(words):
        found -= PARTS
    return bool(found) and name not in ("body", "main")


def _is_main(label: str) -> str:
    name, *words = label.split(" ")
    return name if name in ("article", "main") else "main" if "role:main" in words else ""


def main_slots(tree: list, chars: list[int], linked: list[int], fixed: list[bool]) -> tuple[list[bool], bool]:
    """Whether each slot is main text, and whether an article or main element says so."""
    number = 0
    rows: list[tuple[list[int], bool]] = []  # for each slot: its elements, and whether one of them is marked
    nodes: list[tuple[str, int]] = []  # label and parent
    holds: list[bool] = []  # whether an article, a main element or a first heading stands inside

    def look(x: list, up: int) -> bool:
        if x[0] == "#":
            return False
        me = up
        if x[0] != "()":
            me = len(nodes)
            nodes.append((x[0], up))
            holds.append(False)
        inside = [look(i, me) for i in x[2:]]
        own = bool(_is_main(x[0])) and not _marked(x[0]) or x[0].split(" ")[0] == "h1"
        if me != up:
            holds[me] = any(inside)
        return own or any(inside)

    look(tree, -1)
    count = -1

    def walk(x: list, path: list[int], bad: bool, region: bool) -> None:
        nonlocal number, count
        if x[0] == "#":
            rows.append((path, bad))
            number += 1
            return
        if x[0] != "()":
            count += 1
            me = count
            name, *words = x[0].split(" ")
            region = region or bool(_is_main(x[0]))
            out = _marked(x[0]) and not (holds[me] and not {"comment", "comments", "hidden"} & set(words) and name not in ("nav", "footer", "aside"))
            bad = bad or out or name == "header" and not region
            path = [*path, me]
        for i in x[2:]:
            walk(i, path, bad, region)

    walk(tree, [], False, False)
    free = [0 if bad else max(0, c - k) for (_, bad), c, k in zip(rows, chars, linked)]

    def regions(kind: str) -> dict[int, int]:
        """Text of the outermost elements of a kind."""
        sums: dict[int, int] = {}
        for (path, _), c in zip(rows, free):
            top = next((p for p in path if _is_main(nodes[p][0]) == kind), None)
            if top is not None and c:
                sums[top] = sums.get(top, 0) + c
        return sums

    found = regions("article") or regions("main")
    if found:
        keep = {p for p, c in found.items() if c >= BESIDE * max(found.values())}
        return [not bad and bool(keep & set(path)) for path, bad in rows], True
    open_ = [0 if f or k > 0.5 * c else t for f, c, k, t in zip(fixed, chars, linked, free)]
    named: dict[int, int] = {}
    scores: dict[int, int] = {}
    for (path, _), c in zip(rows, open_):
        if not c:
            continue
        top = next((p for p in path if OWN & set(nodes[p][0].split(" ")) and BODY & set(nodes[p][0].split(" "))), None)
        if top is not None:
            named[top] = named.get(top, 0) + c
        hold = next((p for p in reversed(path) if nodes[p][0].split(" ")[0] not in TEXTUAL), path[0])
        scores[hold] = scores.get(hold, 0) + c
    if not scores:
        return [False] * len(rows), False
    best = max(named, key=lambda p: (named[p], -p)) if named else None
    if best is None or named[best] < 0.4 * sum(scores.values()):
        best = max(scores, key=lambda p: (scores[p], -p))
        least, up = BESIDE * scores[best], nodes[best][1]
        within = lambda p, q: p == q or p >= 0 and within(nodes[p][1], q)
        while up >= 0:
            if any(s >= least and within(p, up) and not within(p, best) for p, s in scores.items()):
                best = up
            up = nodes[up][1]
    title = {p for p, (label, _) in enumerate(nodes) if label.split(" ")[0] == "h1"}
    return [bool(c) and (best in path or bool(title & set(path))) for (path, _), c in zip(rows, open_)], False


# ---- Spark ----


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for page in b.column(3):
            tree, texts, linked = parse(page.as_py())
            of = [0] * len(texts)
            for k, s in enumerate(slots(tree)):
                for i in s[2]:
                    of[i] = k
            skel = json.dumps(bare(tree), separators=(",", ":"), ensure_ascii=False)
            hashes = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in texts]
            for c, v in zip(cols, (xxhash.xxh64_intdigest(skel) - (1 << 63), skel, xxhash.xxh64_intdigest(repr(hashes)) - (1 << 63), texts, of, [len(t) for t in texts], linked, hashes)):
                c.append(v)
        types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, cols, types)], names=["page_id", "url", "host", "sk", "skel", "body", "texts", "slots", "lens", "links", "hashes"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of rows with equal host and part; rows are sorted."""
    key, now = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([json.dumps(now, separators=(",", ":"), ensure_ascii=False)], pa.string())], names=["host", "part", "skel"])

    for b in batches:
        for host, part, skel in zip(*(b.column(c).to_pylist() for c in range(3))):
            tree = json.loads(skel)
            if (host, part) != key:
                if key is not None:
                    yield out()
                key, now = (host, part), tree
            else:
                now = bare(merge(now, tree))
    if key is not None:
        yield out()


def slot_map(wrapper: list, tree: list) -> list[int]:
    """The wrapper's slot for each slot of a page expression.

    Where the order of tags keeps a slot out of the alignment, it is the first below the same tags: merging keeps those.
    -1 for a slot that the wrapper has in no place.
    """
    below: dict[tuple, int] = {}
    for k, p in enumerate(paths(wrapper)):
        below.setdefault(p, k)
    places = list(paths(tree))
    for k, s in enumerate(slots(wrapper)):
        s[2] = [-1 - k]
    own = list(slots(tree))
    for k, s in enumerate(own):
        s[2] = [k]
    found = [-1] * len(own)
    for s in slots(merge(wrapper, tree)):
        theirs = [-1 - i for i in s[2] if i < 0]
        for i in s[2]:
            if i >= 0 and theirs:
                found[i] = min(theirs)
    return [below.get(p, -1) if k < 0 else k for k, p in zip(found, places)]


def _map_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, wrapper = None, ""
    for b in batches:
        out = []
        for host, w, skel in zip(*(b.column(c).to_pylist() for c in (0, 3, 2))):
            if w != last:
                last, wrapper = w, json.loads(w)
            out.append(slot_map(bare(wrapper), json.loads(skel)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["host", "sk", "map"])


def _filled(rows: list[dict] | None, n: int, *names: str) -> list[list]:
    out = [[0] * n for _ in names]
    for r in rows or []:
        if 0 <= r["slot"] < n:
            for o, c in zip(out, names):
                o[r["slot"]] = r[c] or 0
    return out


def _judge_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for host, skel, stats in zip(*(b.column(c).to_pylist() for c in range(3))):
            tree = json.loads(skel)
            n = sum(1 for _ in slots(tree))
            chars, linked, fixed = _filled(stats, n, "chars", "linked", "fixed")
            keep, sure = main_slots(tree, chars, linked, [2 * f > c for f, c in zip(fixed, chars)])
            out.append((host, keep, sure, pattern(tree)))
        types = (pa.string(), pa.list_(pa.bool_()), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["host", "main", "sure", "wrapper"])


def _judge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots to keep of each expression: its wrapper's main slots, or its own if it has none of them."""
    for b in batches:
        out = []
        for host, sk, skel, mapped, main, sure, stats in zip(*(b.column(c).to_pylist() for c in range(7))):
            keep = [0 <= w < len(main) and main[w] for w in mapped]
            chars, linked, fixed = _filled(stats, len(mapped), "chars", "linked", "fixed")
            lost = not any(k and c for k, c in zip(keep, chars))
            if lost or -1 in mapped:
                own, clear = main_slots(json.loads(skel), chars, linked, [2 * f > c for f, c in zip(fixed, chars)])
                keep, sure = (own, clear) if lost else ([o if w < 0 else k for o, w, k in zip(own, mapped, keep)], sure)
            out.append((host, sk, keep, sure))
        types = (pa.string(), pa.int64(), pa.list_(pa.bool_()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["host", "sk", "keep", "sure"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


class Wrappers:
    """Tables of one run: ``pages`` (parsed), ``wrappers`` (host, wrapper text, main slots), ``kept`` (host, expression)."""

    def __init__(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
        scratch = Scratch(pages.sparkSession, "wrappers")
        url = F.col(url_col).cast("string")
        host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
        self.pages = scratch.save(rows.mapInArrow(_parse_pages, _PARSED), compression="zstd")
        # Copies of a page count once in the statistics.
        once = scratch.save(self.pages.select("host", "sk", "body", "slots", "lens", "links", "hashes").dropDuplicates(["host", "sk", "body"]))
        skels = scratch.save(self.pages.groupBy("host", "sk").agg(F.min("skel").alias("skel")))
        parts = skels.select("host", F.pmod("sk", F.lit(GROUPS)).cast("int").alias("part"), "skel", "sk")
        parts = scratch.save(parts.repartition("host", "part").sortWithinPartitions("host", "part", "sk").drop("sk").mapInArrow(_infer, "host string, part int, skel string"))
        whole = parts.repartition("host").sortWithinPartitions("host", "part").select("host", F.lit(0).alias("part"), "skel").mapInArrow(_infer, "host string, part int, skel string")
        wrappers = scratch.save(whole.select("host", F.col("skel").alias("wrapper")))
        mapped = scratch.save(skels.select("host", "sk", "skel").join(_few(wrappers), "host").select("host", "sk", "skel", "wrapper").mapInArrow(_map_slots, "host string, sk long, map array<int>"))
        blocks = once.select("host", "sk", "body", F.explode(F.arrays_zip("slots", "lens", "links", "hashes")).alias("x"))
        texts = blocks.groupBy("host", "sk", F.col("x.slots").alias("own"), F.col("x.hashes").alias("hash")).agg(F.countDistinct("body").alias("pages"), F.sum("x.lens").alias("chars"), F.sum("x.links").alias("linked"))
        texts = texts.join(_few(mapped), ["host", "sk"]).select("host", "sk", "own", F.get("map", F.col("own")).alias("slot"), "hash", "pages", "chars", "linked")
        texts = scratch.save(texts)
        # A text is the template's if most of the host's pages have it in the slot.
        seen = once.groupBy("host", "sk").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum("n").alias("host_pages"))
        common = texts.groupBy("host", "slot", "hash").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES * SHARED)
        common = common.join(_few(scratch.save(seen)), "host").where((F.col("host_pages") >= LEAST_PAGES) & (F.col("pages") >= SHARED * F.col("host_pages")))
        common = scratch.save(common.select("host", "slot", "hash", F.lit(1).alias("common")))
        texts = texts.join(_few(common), ["host", "slot", "hash"], "left")
        sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(F.col("chars") * F.coalesce("common", F.lit(0))).alias("fixed")]
        of = F.collect_list(F.struct("slot", "chars", "linked", "fixed")).alias("stats")
        by_slot = texts.where("slot >= 0").groupBy("host", "slot").agg(*sums).groupBy("host").agg(of)
        judged = wrappers.join(by_slot, "host", "left").select("host", "wrapper", "stats").mapInArrow(_judge_wrappers, "host string, main array<boolean>, sure boolean, wrapper string")
        self.wrappers = scratch.save(judged)
        own = texts.groupBy("host", "sk", F.col("own").alias("slot")).agg(*sums).groupBy("host", "sk").agg(of)
        rows = skels.join(mapped, ["host", "sk"]).join(_few(self.wrappers.select("host", "main", "sure")), "host").join(own, ["host", "sk"], "left")
        kept = scratch.save(rows.select("host", "sk", "skel", "map", "main", "sure", "stats").mapInArrow(_judge_pages, "host string, sk long, keep array<boolean>, sure boolean"))
        # Template texts inside what no element marks as the article.
        drop = mapped.join(_few(common.groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("common"))), "host")
        drop = drop.select("host", "sk", F.transform(F.filter("common", lambda c: F.array_contains("map", c["slot"])), lambda c: F.struct(c["slot"], c["hash"])).alias("common"), "map")
        self.kept = scratch.save(kept.join(drop, ["host", "sk"], "left"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: blocks of the main text in page order, joined by line ends.

    Character references are decoded, white space inside a block is one space, blocks are trimmed and empty ones left
    out. Null or empty html gives an empty text. Urls may be null or without host (such pages share one wrapper), ids may be null or repeat; other
    columns are ignored; an empty table gives an empty table. Tags nested deeper than ``DEPTH`` are passed over, their
    texts are not.
    """
    w = Wrappers(pages, id_col, url_col, html_col)
    kept = w.kept.select("host", "sk", "keep", "sure", "common", "map")
    rows = w.pages.select("page_id", "url", "host", "sk", "texts", "slots", "hashes").join(_few(kept), ["host", "sk"], "left")
    block = F.arrays_zip("texts", "slots", "hashes")
    shared = lambda x: F.exists("common", lambda c: (c["hash"] == x["hashes"]) & (c["slot"] == F.get("map", x["slots"])))
    good = lambda x: F.coalesce(F.get("keep", x["slots"]), F.lit(False)) & (F.col("sure") | F.col("common").isNull() | ~shared(x))
    text = F.coalesce(F.array_join(F.transform(F.filter(block, good), lambda x: x["texts"]), "\n"), F.lit(""))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
