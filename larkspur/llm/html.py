"""Main text of web pages by equivalence-class template deduction.

Where a page has an article or main element, its markup says what the text is. The tokens are then
the element paths it opens (inline elements left out; elements that are boilerplate by tag or role
carry a mark) and whole unmarked blocks, each with its path. On all other pages the tokens are the
words of unmarked blocks, each with its path. For each host, apart for the two kinds of pages:

1. A token's occurrence vector over the distinct pages is summarised by an order-free
   fingerprint, a XOR of hashes of (page, count), so vectors need never be gathered: one
   grouped aggregation gives each token's vector class and support.
2. Tokens of equal fingerprints form a class. Classes need enough support and LEAST_TOKENS tokens.
   Of blocks, a class is valid when at most one class of more support encloses its tokens. Of
   words, it is valid when on every page its tokens come in one order, again and again, and each
   of these instances lies in the same gap of the same instance around it, or in none: classes
   nest into a template. Only blocks that are made of the host's frequent words take part.
3. Words that a class's instances hold between the same two tokens are told apart from the same
   words elsewhere: those whose vector over the pages is the class's own belong to it too.
4. Pages are parsed again. Blocks in marked containers, outside the article of a page that has
   one, and fixed ones go: on pages with an article a block of a valid class that is on every page.
   On the others the template's words go from blocks of which they are half or more, and the
   slots between them stay. A page of which nothing would stay keeps what the rules keep.
   Class names and ids decide nothing but ties: where some of what is left lies in containers
   named as adverts, comments and the like, and some does not, the former goes.

Templates are broadcast while their measured size is small, else joined by host, where the
adaptive skew join splits hosts with very many pages.

A null html gives an empty text. Null urls share one empty host. Repeated rows each get
their row; repeated pages count once in a template. White space inside a block becomes one
blank; a line break element is white space, as blocks are p, headings, list items and so on.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import in_batches, written

LEAST_PAGES = 3  # distinct pages that a host needs for a template of its own
LEAST_SHARE = 0.01  # of the pages on which a template token occurs
MOST_BROADCAST = 64 << 20
EVERYWHERE = "*"
LEAST_TOKENS = 2  # of a valid class
WORD_SHARE = 0.25  # of a host's pages without an article on which a word of the template occurs
FREQUENT = 0.7  # share of frequent words from which on a block can be template
OWN = 0.5  # share of a block's words that are template, from which on they go
DEPTH = 24  # steps that a path spells out; those below are a hash, with article, main and mark

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noframes".split())
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe share sharing social comment comments reply replies disqus respond related recommended pagination pager".split())
FILLERS = frozenset("area bar block body bottom box button buttons card container content form group inline inner item items left link links list main outer page post posts reader readers right row section site slot thread top unit wrap wrapper widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

# Of those that are boilerplate, what stands in a line of text without ending it.
IN_LINE = frozenset("button select textarea svg script style noscript template iframe object canvas audio video map".split())

TAG = re.compile(r"""<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
MARK, HINT = "!", "?"


def mark_of(tag: str, attributes: str) -> str:
    """MARK where an element's tag, role or hiding says that it is no main text, HINT where
    only a name of it does: one that is made of nothing but hints and fillers."""
    if tag in ("html", "body", "main"):
        return ""
    if tag in BOILERPLATE:
        return MARK
    out = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return MARK
        if name == "role":
            if value.lower() in ROLES:
                return MARK
        elif name in ("class", "id") and tag not in HEADINGS:
            for name in value.lower().split():
                parts = set(re.split(r"[^a-z]+", name)) - {""}
                if parts & HINTS and parts <= HINTS | FILLERS:
                    out = HINT
    return out


def below(path: str, depth: int, tag: str, mark: str) -> str:
    """The path of an element at a depth. Beyond DEPTH the steps are hashed, so that paths stay
    short; the first article, main and marked step of them are still spelled out."""
    step = f"/{tag}{mark}"
    if depth <= DEPTH:
        return path + step
    above, _, deep = path.partition("/~")
    told = step if mark and mark not in path or tag in ("article", "main") and not in_article(path) else ""
    return f"{above}/~{xxhash.xxh64_hexdigest(path + step)}{deep[16:]}{told}"


def blocks(page: str) -> tuple[list[tuple[str, str]], Counter]:
    """(path, text) of each block of a page in order, and how often each path opens."""
    return tree(page)[:2]


def tree(page: str) -> tuple[list[tuple[str, str]], Counter, dict[str, str]]:
    """The same, and the path around each path."""
    stack: list[tuple[str, str]] = [("", "")]  # (tag, path)
    opened: Counter = Counter()
    inside: dict[str, str] = {}
    out: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            out.append((stack[-1][1], joined))
        text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE and tag not in RAW:
            if tag == "br":
                text.append(" ")
            # Inline elements are not on the stack, but for marked ones and what lies in them.
            held = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if closing:
                if held and stack[held][1] == stack[held - 1][1]:
                    del stack[held]
                    continue
                if not held:
                    continue
            elif tag in VOID or attributes.endswith("/"):
                continue
            elif not mark_of(tag, attributes):
                if held:
                    stack.append((tag, stack[-1][1]))
                continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            flush()
            if depth:
                del stack[depth:]
            continue
        if tag in IN_LINE and (end := re.compile(rf"</{tag}\s*>", re.I).search(page, at)):
            path = below(stack[-1][1], len(stack), tag, MARK)
            opened[path] += 1
            inside[path] = stack[-1][1]
            at = end.end()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ("article", "main") and set(MARK + HINT) & set(stack[-1][1]):
            # An article does not lie in a menu or an advert: something was left open.
            depth = next((i for i, (_, p) in enumerate(stack) if set(MARK + HINT) & set(p) and not re.search(r"/(?:article|main|section)[!?]", p)), 0)
            if depth:
                del stack[depth:]
        if tag in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("p", "table", "td", "button")), 0)
            if depth and stack[depth][0] == "p":
                del stack[depth:]
        elif tag in SIBLINGS:
            same, limit = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in limit:
                    break
                if stack[i][0] in same.split():
                    del stack[i:]
                    break
        path = below(stack[-1][1], len(stack), tag, mark_of(tag, attributes))
        opened[path] += 1
        inside[path] = stack[-1][1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not attributes.endswith("/"):
            stack.append((tag, path))
    flush()
    return out, opened, inside


def in_article(path: str) -> bool:
    return "/article" in path or "/main" in path


def by_rule(path: str, article: bool) -> bool:
    """Whether a slot may be content, without statistics; ``article``: the page has one."""
    return MARK not in path and (in_article(path) or not article)


TOKENS = "host STRING, page STRING, article BOOLEAN, path STRING, above STRING, text BIGINT, n BIGINT"


def _tokens(batches):
    """Of pages with an article a row for each path (text is null) and for each block that the
    rules keep; of others a row for each word of those blocks, and one of text 0 for the page."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(at, 256).to_pylist():
                found, opened, inside = tree(r["html"] or "")
                article = has_article(opened)
                if not article:
                    words = Counter(t for _, own in spelled(found) for t in own)
                    rows += [(r["host"], r["page"], False, None, None, t, n) for t, n in [(0, 1), *words.items()]]
                    continue
                for path, n in opened.items():
                    rows.append((r["host"], r["page"], article, path, inside[path], None, n))
                for (path, text), n in Counter(x for x in found if by_rule(x[0], article)).items():
                    rows.append((r["host"], r["page"], article, path, path, hash_block(path, text), n))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)


def hash_block(path: str, text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(f"{path}\n{text}")).view(np.int64))


def spelled(found: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """(text, word tokens) of the blocks that the rules keep on a page without an article."""
    return [(text, [hash_block(path, w) for w in text.split(" ")]) for path, text in found if by_rule(path, False)]


def stretched(blocks: list[tuple[str, list[int]]], known: dict[int, int]) -> tuple[list[int], list[bool]]:
    """All word tokens of a page in order, and which of them lie in blocks that can be template:
    blocks of frequent words, with one of a class at least."""
    words, open_ = [], []
    for _, own in blocks:
        frequent = sum(t in known for t in own)
        can = frequent >= FREQUENT * len(own) and any(known.get(t) for t in own)
        words += own
        open_ += [can] * len(own)
    return words, open_


def periods(at: dict[int, list[int]], words: list[int]) -> dict[int, list[list[int]]]:
    """The places of each class, cut into instances; of classes whose tokens repeat one order."""
    found = {}
    for c, places in at.items():
        tokens = [words[i] for i in places]
        m = len(set(tokens))
        if m >= LEAST_TOKENS and len(set(tokens[:m])) == m and tokens == tokens[:m] * (len(tokens) // m):
            found[c] = [places[k : k + m] for k in range(0, len(places), m)]
    return found


def crossings(found: dict[int, list[list[int]]]):
    """Pairs of instances of which the second begins in the first and ends behind it."""
    active: list[tuple[int, list[int]]] = []
    for c, places in sorted(((c, p) for c, all_ in found.items() for p in all_), key=lambda x: x[1][0]):
        active = [x for x in active if x[1][-1] > places[0]]
        yield from ((x, (c, places)) for x in active if x[1][-1] < places[-1])
        active.append((c, places))


def instances(words: list[int], open_: list[bool], known: dict[int, int]) -> tuple[dict[int, list[list[int]]], dict[int, int]]:
    """The instances of each class on a page, as the places of their tokens, and a hash of the
    tokens' order; classes whose tokens do not repeat one order are left out of both. Where two
    instances cross, the fewer tokens in what they share (of as many, the first one's) have
    another role there, and leave their class on this page."""
    at: dict[int, list[int]] = {}
    for i, t in enumerate(words):
        if open_[i] and (c := known.get(t)):
            at.setdefault(c, []).append(i)
    while True:
        found, gone = periods(at, words), set()
        for (c, a), (d, b) in crossings(found):
            mine, other = [i for i in a if i > b[0]], [i for i in b if i < a[-1]]
            gone |= {(c, words[i]) for i in mine} if len(mine) <= len(other) else {(d, words[i]) for i in other}
        if not gone:
            break
        at = {c: [i for i in places if (c, words[i]) not in gone] for c, places in at.items()}
    orders = {c: xxhash.xxh64_intdigest(np.array([words[i] for i in all_[0]], np.int64).tobytes()) for c, all_ in found.items()}
    return found, orders


def around(found: dict[int, list[list[int]]]) -> dict[int, int | None]:
    """For each class a hash of the class and gap that all its instances lie in (0 for none), or
    None where they lie in several, or hold a token of the instance around them."""
    spans = sorted((p[0], -p[-1], c, p) for c, all_ in found.items() for p in all_)
    out: dict[int, int | None] = {}
    stack: list[tuple[int, int, list[int]]] = []
    for first, last, c, places in spans:
        while stack and stack[-1][0] < first:
            stack.pop()
        here = 0
        if stack:
            _, outer, outer_places = stack[-1]
            gap = bisect.bisect_left(outer_places, first)
            here = xxhash.xxh64_intdigest(f"{outer} {gap}") if bisect.bisect_left(outer_places, -last) == gap else None
        out[c] = here if c not in out or out[c] == here else None
        stack.append((-last, c, places))
    return out


def contexts(words: list[int], found: dict[int, list[list[int]]]) -> list[tuple[int, int, int]]:
    """(place, class, hash of gap and word) of every word between two tokens of an instance."""
    out = []
    for c, all_ in found.items():
        for places in all_:
            for gap, (a, b) in enumerate(zip(places, places[1:])):
                out += [(i, c, int(np.uint64(xxhash.xxh64_intdigest(f"{gap} {words[i]}")).view(np.int64))) for i in range(a + 1, b)]
    return out


ROLES_OF = "host STRING, page STRING, class BIGINT, context BIGINT, told BIGINT, n BIGINT"


def _roles(batches):
    """Of each page without an article: a row for each class (context is null; told is a hash of
    its order and of what it lies in, null where it has none), and one for each of its contexts."""
    names = [x.split()[0] for x in ROLES_OF.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(at, 256).to_pylist():
                found, opened = blocks(r["html"] or "")
                if has_article(opened):
                    continue
                known = dict(zip(r["tokens"], r["classes"]))
                words, open_ = stretched(spelled(found), known)
                placed, orders = instances(words, open_, known)
                nested = around(placed)
                for c in {known[t] for t, o in zip(words, open_) if o and known.get(t)}:
                    told = None if nested.get(c) is None else int(np.uint64(xxhash.xxh64_intdigest(f"{orders[c]} {nested[c]}")).view(np.int64))
                    rows.append((r["host"], r["page"], c, None, told, 1))
                for (c, context), n in Counter((c, x) for _, c, x in contexts(words, placed)).items():
                    rows.append((r["host"], r["page"], c, context, None, n))
            types = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)


def word_templates(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(host, tokens, classes, contexts): of each host with a template of words its frequent
    words, their valid class (0 for none), and the contexts whose words belong to a class. The
    frequent words of a host are at most 1 / WORD_SHARE times those of a page."""
    words = stats.where("NOT article")
    sizes = words.where("text = 0").select("host", F.col("support").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    frequent = words.where("text <> 0").join(sizes, "host").where(F.col("support") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * WORD_SHARE))
    frequent = written(frequent.select("host", F.col("text").alias("token"), "class"), "frequent_words")
    classes = frequent.groupBy("host", "class").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TOKENS).select("host", "class", F.col("class").alias("own"))
    known = frequent.join(classes, ["host", "class"], "left").groupBy("host").agg(F.collect_list(F.struct("token", F.coalesce("own", F.lit(0)).alias("own"))).alias("k"))
    known = written(known.select("host", F.col("k.token").alias("tokens"), F.col("k.own").alias("classes")), "known_words")
    told = written(in_batches(on_hosts(pages, known, "inner").select("host", "page", "html", "tokens", "classes"), _roles, ROLES_OF), "roles")
    orders = told.where("context IS NULL").groupBy("host", "class").agg(F.min("told").alias("a"), F.max("told").alias("b"), F.count_if(F.col("told").isNull()).alias("none"))
    valid = written(orders.where("none = 0 AND a = b").select("host", "class"), "valid")
    once = told.where("context IS NOT NULL").groupBy("host", "class", "context", "page").agg(F.max("n").alias("n"))
    inside = once.groupBy("host", "class", "context").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector")).where(F.col("vector") == F.col("class"))
    inside = inside.join(valid, ["host", "class"]).groupBy("host").agg(F.collect_list(F.struct("class", "context")).alias("contexts"))
    good = valid.groupBy("host").agg(F.collect_set("class").alias("good"))
    out = known.join(good, "host").join(inside, "host", "left")
    of_class = F.transform("classes", lambda c: F.when(F.array_contains("good", c), c).otherwise(F.lit(0)))
    return written(out.select("host", "tokens", of_class.alias("classes"), "contexts"), "word_templates")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (host, page, html), where page is a hash of the content: (host, fixed), the
    hashes of the fixed blocks of pages with an article, of each host that has a template and of
    EVERYWHERE; and the templates of words."""
    tokens = written(in_batches(pages, _tokens, TOKENS), "tokens")
    # Equal pages once; then the vector's fingerprint. Both aggregate before they shuffle.
    once = tokens.groupBy("host", "article", "path", "above", "text", "page").agg(F.max("n").alias("n"))
    stats = once.groupBy("host", "article", "path", "above", "text").agg(F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.count("*").alias("support"))
    stats = written(stats, "stats")
    # All hosts together, from what each has of its own: no token is moved twice.
    own = stats.where("article").drop("article")
    every = own.groupBy("path", "above", "text").agg(F.bit_xor(F.xxhash64("host", "class")).alias("class"), F.sum("support").alias("support"))
    stats_of = written(own.unionByName(every.withColumn("host", F.lit(EVERYWHERE))), "block_stats")
    # The element that encloses all others occurs on every page that has one.
    pages_of = written(stats_of.groupBy("host").agg(F.max("support").alias("pages")).where(F.col("pages") >= LEAST_PAGES), "pages")
    frequent = written(stats_of.join(pages_of, "host").where(F.col("support") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * LEAST_SHARE)), "frequent")
    enclosing = frequent.where("text IS NULL").select("host", F.col("path").alias("above"), F.col("class").alias("class_above"), F.col("support").alias("support_above"))
    placed = written(frequent.join(enclosing, ["host", "above"], "left"), "placed")
    outer = F.when(F.col("support_above") > F.col("support"), F.col("class_above"))
    classes = placed.groupBy("host", "class").agg(F.count("*").alias("tokens"), F.min(outer).alias("first"), F.max(outer).alias("last"))
    valid = classes.where((F.col("tokens") >= LEAST_TOKENS) & (F.col("first").isNull() | (F.col("first") == F.col("last")))).select("host", "class")
    fixed = placed.where(F.col("text").isNotNull() & (F.col("support") == F.col("pages"))).join(valid, ["host", "class"]).groupBy("host").agg(F.collect_list("text").alias("fixed"))
    fixed = pages_of.join(fixed, "host", "left").select("host", F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))
    return written(fixed, "fixed"), word_templates(pages, stats)


def has_article(opened) -> bool:
    """Whether a page has an article or main element that nothing marks or hints at."""
    return any(in_article(p) and MARK not in p and HINT not in p for p in opened)


def without_template(blocks: list[tuple[str, list[int]]], known: dict[int, int], inner: set[tuple[int, int]]) -> list[str]:
    """The texts of blocks, with the template's words cut out of those that are half made of
    them; empty for a block that is nothing else."""
    words, open_ = stretched(blocks, known)
    placed, _ = instances(words, open_, known)
    template = {i for all_ in placed.values() for places in all_ for i in places}
    template |= {i for i, c, context in contexts(words, placed) if (c, context) in inner}
    out, at = [], 0
    for text, own in blocks:
        here = [i in template for i in range(at, at + len(own))]
        at += len(own)
        out.append(" ".join(w for w, t in zip(text.split(" "), here) if not t) if sum(here) >= OWN * len(own) else text)
    return out


def kept(page: str, fixed: set | frozenset = frozenset(), known: dict[int, int] | None = None, inner: set[tuple[int, int]] | None = None) -> str:
    """The text of a page. ``fixed``: hashes of fixed blocks of pages with an article; ``known``
    and ``inner``: the classes of words, and their contexts, of pages without."""
    found, opened = blocks(page)
    article = has_article(opened)
    allowed = [x for x in found if by_rule(x[0], article)]
    if article:
        left = [x for x in allowed if hash_block(*x) not in fixed] if fixed else allowed
    elif known:
        left = [(path, text) for (path, _), text in zip(allowed, without_template(spelled(allowed), known, inner or set())) if text]
    else:
        left = allowed
    left = left or allowed
    # Hints break ties: what they name goes where other text is left.
    return "\n".join(t for _, t in [x for x in left if HINT not in x[0]] or left)


def _extract(general: list):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for r in part.select(["html", "fixed", "tokens", "classes", "contexts"]).to_pylist():
                    known = dict(zip(r["tokens"] or (), r["classes"] or ()))
                    inner = {(c["class"], c["context"]) for c in r["contexts"] or ()}
                    texts.append(kept(r["html"] or "", set(general if r["fixed"] is None else r["fixed"]), known, inner))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return run


def on_hosts(rows: DataFrame, own: DataFrame, how: str) -> DataFrame:
    """Rows with what their host has, which is broadcast while its measured size is small."""
    width = sum((F.coalesce(F.size(f.name), F.lit(0)) * 16 for f in own.schema if f.name != "host"), F.lit(64) + F.octet_length("host"))
    size = own.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return rows.join(F.broadcast(own) if size <= MOST_BROADCAST else own, "host", how)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text and n_chars (its code points)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    fixed, words = templates(rows.select("host", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("page"), "html"))
    placed = on_hosts(on_hosts(rows, fixed.where(F.col("host") != EVERYWHERE), "left"), words, "left")
    # One row at most: the fixed blocks that all pages with an article have.
    general = [x for r in fixed.where(F.col("host") == EVERYWHERE).collect() for x in r.fixed]
    schema = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).schema.add("text", "string").add("n_chars", "long")
    out = in_batches(placed.select("key", "url", "html", "fixed", "tokens", "classes", "contexts"), _extract(general), schema)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
