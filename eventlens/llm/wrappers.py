"""Wrappers of web pages: union-free regular expressions over token streams.

A page's tokens are balanced into elements and runs of text (``parse``).  An expression is a list of items: an element
with the expression of its inside, a text slot, or a group of neighbours; an item can be optional, repeated or both.
Within a page, neighbours that repeat become repeated items (``fold``).  Two expressions are aligned (``align``):
items of one key are merged, which turns differing texts into slots, groups of one side are looked for on the other,
and what is left over becomes optional.  A list that grows beyond ``LIMIT`` items becomes one repeated group of
optional items, so that an expression stays small however many pages it stands for.

``judge`` decides which texts of an expression are content, and ``verdicts`` reads a page through an expression.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash

#: Items of a list before it becomes a repeated group of optional ones, and kinds in such a group before attributes go.
LIMIT = 48
#: Depth beyond which elements no longer nest.
DEPTH = 60
#: Longest run of neighbours that can repeat as a group.
PERIOD = 8
#: Pages on which a fixed text must stand to be part of the template.
TEMPLATE_PAGES = 3
#: Share of a container's text above which the search for the main part goes on in one child.
MAIN_SHARE = 0.6
#: Share of a text's characters in links above which it is navigation.
LINK_SHARE = 0.5

# Elements of HTML by their part, and words that name parts of a page in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br area base col embed input link meta param source track label picture".split())
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center colgroup datalist dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main map math menu nav "
    "noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video".split()) | RAW
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
DROPPED = frozenset(
    "head script style textarea title iframe noembed noframes xmp nav footer aside form button select datalist dialog noscript object "
    "svg template canvas audio video map menu search fieldset".split())
CONTAINERS = frozenset("html body div section main center table tbody tr td form span".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit banner sponsor sponsored sponsors promo "
    "promos promoted promotion outbrain taboola "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager topbar toolbar skip "
    "footer colophon copyright sidebar aside rail widget widgets related recommended recommendations trending teaser teasers complementary "
    "cookie cookies consent gdpr notice notices popup modal overlay paywall toast alert alertdialog dialog announcement disclaimer "
    "contentinfo form forms search searchbox login signin signup register subscribe subscription newsletter "
    "comment comments commentlist disqus reply replies respond share sharing social hidden".split())
HEADERS = frozenset("header masthead branding sitename logo topheader".split())
_ENDS_BEFORE = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
                "tr": ("tr", "table"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"),
                "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select"), "optgroup": ("optgroup", "select")}
_ENDS_BEFORE = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS_BEFORE.items()}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/>]|$))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBERS = re.compile(r"\d{2,}")

SLOT, BAG = "#", "*"


class Item:
    """One item of an expression.  ``seen``: pages, characters, characters in links, least and greatest hash of its texts."""

    __slots__ = ("key", "kids", "optional", "many", "seen", "texts", "verdict")

    def __init__(self, key, kids=None, optional=False, many=False, seen=None, texts=None):
        self.key, self.kids, self.optional, self.many = key, kids if kids is not None else [], optional, many
        self.seen, self.texts, self.verdict = seen, texts, 0


@lru_cache(maxsize=1 << 14)
def element_key(tag: str, attributes: str) -> str:
    """Tag, classes, id and role; numbers of two or more digits don't count."""
    if not attributes.strip(" \t\r\n/"):
        return tag
    parts = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        parts.setdefault(name.lower(), _NUMBERS.sub("0", html.unescape(next(filter(None, values), ""))))
    out = tag + "".join("." + c for c in sorted(set(parts.get("class", "").split())))
    if parts.get("id"):
        out += "#" + "_".join(parts["id"].split())
    for name in ("role", "itemprop"):
        if parts.get(name):
            out += f"@{parts[name]}"
    return out + ("@hidden" if "hidden" in parts else "")


@lru_cache(maxsize=1 << 14)
def _tag(key: str) -> str:
    return re.match(r"[^.#@]*", key)[0]


@lru_cache(maxsize=1 << 14)
def part_of_page(key: str) -> str:
    """What an element's tag and names say: article, main, header, form, named, dropped, or nothing.

    Forms that hold an article or a main heading are frames of whole pages.
    """
    tag = _tag(key)
    if tag in DROPPED:
        return "form" if tag == "form" else "dropped"
    names = key[len(tag):]
    if tag == "main" or "@main" in names or "@articleBody" in names:
        return "main"
    words = [w.lower() for w in _WORDS.findall(names)]
    named = {w for i, w in enumerate(words) if not (i and words[i - 1] in ("with", "has", "no", "without"))}
    if "@article" in names and tag != "body":
        tag = "article"
    if tag in ("html", "body"):
        return ""
    if named & BOILERPLATE or "@navigation" in names:
        return "named"
    if tag == "article":
        return "article"
    return "header" if tag == "header" or named & HEADERS else ""


def parse(source: str) -> tuple[list[Item], list[str]]:
    """The page as a folded expression, and its texts in order; ``texts`` of a slot are their numbers."""
    root = Item("")
    stack = [("", root)]
    open_tags: dict[str, int] = {}
    texts: list[str] = []
    run: list[str] = []
    state = [0, 0]  # characters in links of this run; depth of the stack at which a link was opened, or 0

    def add(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        run.append(piece)
        if state[1]:
            state[0] += len("".join(piece.split()))

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                stack[-1][1].kids.append(Item(SLOT, seen=[1, len(text), min(state[0], len(text)), h, h], texts=[len(texts)]))
                texts.append(text)
        state[0] = 0

    def pop() -> None:
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        if len(stack) < state[1]:
            state[1] = 0

    def end_implied(tag: str) -> None:
        if tag in CLOSES_P and stack[-1][0] == "p":
            pop()
        if tag in _ENDS_BEFORE:
            ended, scope = _ENDS_BEFORE[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in ended:
                    while len(stack) > i:
                        pop()
                    break
                if len(stack) - i > DEPTH:
                    break
        elif tag[0] == "h" and len(tag) == 2 and stack[-1][0][:1] == "h" and len(stack[-1][0]) == 2 and tag != "hr":
            pop()

    at = 0
    while at < len(source):
        begin = source.find("<", at)
        if begin < 0:
            add(source[at:])
            break
        if begin > at:
            add(source[at:begin])
        m = _TOKEN.match(source, begin)
        if not m:
            add("<")
            at = begin + 1
            continue
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            state[1] = 0 if closing else len(stack)
            continue
        if closing:
            if open_tags.get(tag):
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        key = tag if tag in VOID else element_key(tag, attributes or "")
        if tag in INLINE or tag not in BLOCK and "-" not in tag:
            # formatting is part of the text, unless it is named as a part of the page
            if tag in VOID or part_of_page(key) != "named":
                if open_tags.get(tag):  # its end must not be taken for that of a named one
                    stack.append((tag, stack[-1][1]))
                    open_tags[tag] += 1
                continue
        flush()
        end_implied(tag)
        if tag in VOID:
            continue
        node = stack[-1][1]
        if len(stack) < DEPTH:
            node = Item(key)
            stack[-1][1].kids.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
        if tag in BLOCK or tag in INLINE or not (attributes or "").endswith("/"):
            stack.append((tag, node))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _fold_all(root)
    return root.kids, texts


def _fold_all(item: Item) -> None:
    for kid in item.kids:
        if kid.kids:
            _fold_all(kid)
    item.kids = fold(item.kids, False)


def _add_seen(a: Item, b: Item, across: bool) -> None:
    if b.seen is not None:
        a.seen = [a.seen[0] + b.seen[0] if across else max(a.seen[0], b.seen[0]), a.seen[1] + b.seen[1], a.seen[2] + b.seen[2],
                  min(a.seen[3], b.seen[3]), max(a.seen[4], b.seen[4])]
    if b.texts is not None:
        a.texts += b.texts


def merge(a: Item, b: Item, across: bool) -> Item:
    """``a`` standing for both; the items have one key.  ``across``: they come from different pages."""
    if a.seen is not None:
        _add_seen(a, b, across)
    elif a.kids or b.kids:
        a.kids = align(a.kids, b.kids, across)
    a.optional, a.many = a.optional or b.optional, a.many or b.many
    return a


def like(a: Item, b: Item) -> bool:
    """Whether two items can be one: of one key and, if they are containers, with at least half of the smaller one's kinds of kids in common."""
    if a.key != b.key:
        return False
    if not a.kids or not b.kids or _tag(a.key) not in CONTAINERS:
        return True
    x, y = {k.key for k in _flat(a.kids)}, {k.key for k in _flat(b.kids)}
    return 2 * len(x & y) >= min(len(x), len(y))


def _same(a: list[Item], b: list[Item]) -> bool:
    return len(a) == len(b) and all(map(like, a, b))


def _repeat(instances: list[list[Item]], across: bool) -> list[Item]:
    first = instances[0]
    for other in instances[1:]:
        first = [merge(x, y, across) for x, y in zip(first, other)]
    return first


def fold(kids: list[Item], across: bool) -> list[Item]:
    """Neighbours of one key become one repeated item, neighbouring repeats of a run one repeated group."""
    out: list[Item] = []
    for kid in kids:
        if out and like(out[-1], kid):
            optional = out[-1].optional and kid.optional
            merge(out[-1], kid, across)
            out[-1].optional, out[-1].many = optional, True
        else:
            out.append(kid)
    if not across:
        for period in range(2, min(PERIOD, len(out) // 2) + 1):
            keys, at, done = [k.key for k in out], 0, []
            while at < len(out):
                times = 1
                while keys[at + times * period:at + times * period + 1] == keys[at:at + 1] and _same(out[at:at + period], out[at + times * period:at + (times + 1) * period]):
                    times += 1
                if times > 1:
                    done.append(_group(_repeat([out[at + i * period:at + (i + 1) * period] for i in range(times)], across), True))
                    at += times * period
                else:
                    done.append(out[at])
                    at += 1
            out = done
    return _bag(out, across) if len(out) > LIMIT else out


def _group(items: list[Item], many: bool) -> Item:
    return Item("(" + " ".join(i.key for i in items) + ")", items, False, many)


def _flat(items: list[Item]):
    for item in items:
        if item.key == BAG or item.key[:1] == "(":
            yield from _flat(item.kids)
        else:
            yield item


def _bag(items: list[Item], across: bool) -> list[Item]:
    """All items as one repeated group of optional ones, each key once; too many keys lose their attributes."""
    kinds: dict[str, Item] = {}
    for item in _flat(items):
        if item.key in kinds:
            merge(kinds[item.key], item, across)
        else:
            kinds[item.key] = item
    if len(kinds) > LIMIT:
        plain: dict[str, Item] = {}
        for item in kinds.values():
            item.key = bare(item.key)
            if item.key in plain:
                merge(plain[item.key], item, across)
            else:
                plain[item.key] = item
        kinds = plain
    for item in kinds.values():
        item.optional = item.many = True
    return [Item(BAG, list(kinds.values()), False, True)]


def bare(key: str) -> str:
    """The key of an element without names, or of the kind of part that they say; unknown elements are one kind."""
    if key == SLOT:
        return key
    tag = _tag(key)
    tag = tag if tag in BLOCK or tag in INLINE else "x-other"
    return tag + {"named": ".notice", "main": "@main", "article": "" if tag == "article" else "@article", "header": "" if tag == "header" else ".header"}.get(part_of_page(key), "")


def _regroup(items: list[Item], others: list[Item]) -> list[Item]:
    """Items, with runs that are an instance of a group of the others as such a group."""
    for group in others:
        if group.key[:1] == "(":
            keys, at, out = [k.key for k in group.kids], 0, []
            while at < len(items):
                if items[at].key == keys[0] and _same(items[at:at + len(keys)], group.kids):
                    out.append(_group(items[at:at + len(keys)], False))
                    at += len(keys)
                else:
                    out.append(items[at])
                    at += 1
            items = out
    return items


def pairs(a: list[Item], b: list[Item]) -> list[tuple[int | None, int | None]]:
    """A longest common subsequence of the keys, and the rest of both sides in order."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, item = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if like(item, b[j]) else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if like(a[i], b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out + [(x, None) for x in range(i, n)] + [(None, y) for y in range(j, m)]


def align(a: list[Item], b: list[Item], across: bool = True) -> list[Item]:
    """One expression for both lists: merged where keys agree, optional where one side lacks an item."""
    if _same(a, b):
        return [merge(x, y, across) for x, y in zip(a, b)]
    if any(x.key == BAG for x in a) or any(x.key == BAG for x in b):
        return _bag(a + b, across)
    a, b = fold(_regroup(a, b), True), fold(_regroup(b, a), True)
    out = []
    for i, j in pairs(a, b):
        if i is not None and j is not None:
            out.append(merge(a[i], b[j], across))
        else:
            item = a[i] if j is None else b[j]
            item.optional = True
            out.append(item)
    return fold(out, True)


def slots(items: list[Item]):
    for item in items:
        if item.seen is not None or item.key == SLOT:
            yield item
        else:
            yield from slots(item.kids)


def frozen(items: list[Item]) -> tuple:
    """The expression without statistics, as tuples."""
    return tuple((i.key, i.optional, i.many, frozen(i.kids)) for i in items)


def thawed(form: tuple, seen=None) -> list[Item]:
    """The expression of ``frozen`` tuples, with statistics for its slots in order."""
    seen = iter(()) if seen is None else seen
    return [Item(k, thawed(kids, seen), o, m, list(next(seen, (0, 0, 0, 0, 0))) if k == SLOT else None) for k, o, m, kids in form]


DROP, MAIN, OTHER = 0, 1, 2


def _holds_article(items: list[Item]) -> bool:
    return any(part_of_page(i.key) in ("article", "main") or _holds_article(i.kids) for i in items)


def judge(items: list[Item]) -> None:
    """Set the verdict of every slot: MAIN within the marked main part, OTHER in what else reads like it, DROP else.

    Dropped are the parts that tags and names tell, and in a part whose text varies from page to page also the fixed
    text that is the same on ``TEMPLATE_PAGES`` pages or more: the template.
    """
    main, rest = [], []

    def walk(items: list[Item], scope: str, dropped: bool) -> None:
        for item in items:
            if item.key == SLOT:
                item.verdict = DROP
                if not dropped:
                    (main if scope else rest).append((item, scope))
                continue
            part = part_of_page(item.key)
            off = dropped or part == "dropped" or part == "article" and scope == "article"
            if not off and (part in ("named", "form") or part == "header" and not scope):
                off = not _holds_article(item.kids) and not (part == "form" and any(_headings(k) for k in item.kids))
            walk(item.kids, part if part in ("article", "main") and scope != "article" else scope, off)

    walk(items, "", False)
    if any(scope == "article" for _, scope in main):
        main = [x for x in main if x[1] == "article"]
    for slot in _varying([s for s, _ in main]):
        slot.verdict = MAIN
    body = {id(s) for s, _ in rest}
    kept = {id(s) for s in _varying([s for s, _ in rest]) if s.seen[2] <= LINK_SHARE * s.seen[1]}
    for slot in _densest(items, kept):
        if id(slot) in body and id(slot) in kept:
            slot.verdict = OTHER


def _varying(of: list[Item]) -> list[Item]:
    fixed = [s for s in of if s.seen[0] >= TEMPLATE_PAGES and s.seen[3] == s.seen[4]]
    if not fixed or 2 * sum(s.seen[1] for s in fixed) >= sum(s.seen[1] for s in of):
        return of
    known = {id(s) for s in fixed}
    return [s for s in of if id(s) not in known]


def _densest(items: list[Item], kept: set[int]) -> list[Item]:
    """The slots of the container that holds most of the text, and the page's main headings before it."""
    mass = {}

    def weigh(item: Item) -> float:
        own = item.seen[1] - item.seen[2] if item.key == SLOT and id(item) in kept else 0
        mass[id(item)] = out = own + sum(weigh(k) for k in item.kids)
        return out

    total, before = sum(weigh(i) for i in items), []
    while True:
        heavy = max(items, key=lambda i: mass[id(i)], default=None)
        if heavy is None or not total or heavy.many or heavy.key == SLOT or _tag(heavy.key) not in CONTAINERS or mass[id(heavy)] < MAIN_SHARE * total:
            return before + list(slots(items))
        for item in items[:next(k for k, x in enumerate(items) if x is heavy)]:
            before += _headings(item)
        items, total = heavy.kids, mass[id(heavy)]


def _headings(item: Item) -> list[Item]:
    if _tag(item.key) == "h1":
        return list(slots(item.kids))
    return [s for k in item.kids for s in _headings(k)]


def compiled(items: list[Item]) -> tuple:
    """Expression with the verdicts of its slots, as tuples."""
    return tuple((i.key, i.verdict, compiled(i.kids)) for i in items)


def opened(form: tuple) -> list[Item]:
    out = []
    for key, verdict, kids in form:
        item = Item(key, opened(kids))
        item.verdict = verdict
        out.append(item)
    return out


def read(page: list[Item], wrapper: list[Item]) -> None:
    """Give the page's slots the verdicts of the items of the wrapper that they are instances of."""
    if not _same(page, wrapper):
        if any(w.key == BAG for w in wrapper):
            kinds = {w.key: w for w in _flat(wrapper)}
            for item in _flat(page):
                _read_one(item, kinds.get(item.key) or kinds.get(bare(item.key)))
            return
        kinds = {w.key: w for w in [*_flat(wrapper), *wrapper][::-1]}
        regrouped = _regroup(page, wrapper)
        for i, j in pairs(regrouped, wrapper):
            if i is not None:
                item, found = regrouped[i], wrapper[j] if j is not None else kinds.get(regrouped[i].key)
                if found is None and item.key[:1] == "(":
                    for kid in item.kids:
                        _read_one(kid, kinds.get(kid.key))
                else:
                    _read_one(item, found)
        return
    for x, y in zip(page, wrapper):
        _read_one(x, y)


def _read_one(item: Item, found: Item | None) -> None:
    if found is None:
        return  # keeps the verdict that the page by itself has given it
    if item.key == SLOT:
        item.verdict = found.verdict
    else:
        read(item.kids, found.kids)


def main_text(page: list[Item], texts: list[str]) -> str:
    """The texts of the main part, in page order; where nothing is marked as such, those that read like it."""
    by = {MAIN: [], OTHER: []}
    for slot in slots(page):
        if slot.verdict:
            by[slot.verdict] += slot.texts
    return " ".join(texts[i] for i in sorted(by[MAIN] or by[OTHER]))
