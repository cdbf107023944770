"""Main text of web pages: every page's blocks by structure, and a host's suffixes in order for what structure leaves open.

Structure tells an article's core (first heading to last paragraph) and what holds no article text
(menus, notices, forms and the like, all outside the article). What lies between is open: an
article's blocks before and after its core, and all blocks of a page that names no article (or main)
element. The token streams of a host's pages are taken together, their suffixes are put in order, and
neighbours that have their first tokens in common on several pages are long repeated substrings.
What they cover of open blocks is boilerplate and is cut; unique runs stay.

Suffixes are ordered to the depth of the shortest repeat that counts. No more is needed to cut: a
longer repeat is a run of suffixes of which each is such a repeat. Suffixes whose first tokens are
all of a core cut nothing, as an article that quotes or copies another stays whole, and are left out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, SHARE, claim, materialize, whole

#: Elements that hold no article text.
DROPPED = frozenset("nav footer aside form script style noscript template head title iframe svg canvas object button select option textarea dialog menu audio video".split())

#: Elements whose content is no markup; it ends at their end tag only.
RAW = frozenset("script style textarea title iframe noscript".split())
_RAW_END = {name: re.compile(rf"</{name}[\t\n\f\r /][^>]*+>|</{name}>", re.I) for name in RAW}

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that end where another begins: the ones, and what ends them.
_ENDED_BY = (
    (frozenset(["p"]), BLOCKS | frozenset(["nav", "footer", "aside", "form", "menu", "dialog"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", "tbody", "tfoot"])), (frozenset(["tr"]), frozenset(["tr", "tbody", "tfoot"])),
    (frozenset(["li"]), frozenset(["li"])), (frozenset(["dt", "dd"]), frozenset(["dt", "dd"])),
)

#: Words of class, id and role names for what is no article text, whatever it holds: adverts, forms to join, what readers say.
SURE = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments cookie cookies consent disqus newsletter pagination popup promoted replies sidebar sponsor sponsored subscribe subscription".split())

#: Words for what mostly is none; it stays where it is the most of an article and no list of links.
MARKS = SURE | frozenset("banner comment disclaimer footer menu modal nav navbar navigation notice notices notification promo related reply share sharing social toolbar widget".split())

#: Words beside them that say where, whose or how, not what.
PLACES = frozenset("area article aside bar block blog body bottom box btn button buttons center col column container content dialog entry fixed form full group head header hidden icons inner item items js large left links list main mobile module outer overlay page panel post primary reader readers right row secondary section sign signup site slot small sticky story strip text thread title top unit up user users visible visitor web wide wrap wrapper zone".split())

#: A name that begins so says what a page has, not what the element is.
STATES = frozenset("has hide is no not show with without".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A tag as browsers read it: quotes open a value only after an equals sign. No part gives back what it took, so time is linear.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]*+[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >]*+))?+)*+)[\t\n\f\r /]*+>"""
)
_OPEN = re.compile(r"<(?:[a-zA-Z!?]|/[^>])")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*+([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >]*+)))?+""")


def _meaning(name: str) -> str | None:
    """What one class, id or role name says: sure, mark, content, or nothing.

    The last word that isn't about place tells what a thing is: "article-comments" are comments, a
    "key-notice-board" is a board.
    """
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1]
    core = [w for w in words if w in MARKS or w not in PLACES]
    if not core or core[0] in STATES:
        return None
    return "sure" if core[-1] in SURE else "mark" if core[-1] in MARKS else "content"


def _marked(attributes: str) -> tuple[bool, int, str]:
    """Whether an element is hidden, whether a name says that it holds no article text (1, or 2 if surely), and its role.

    An attribute says so if one of its names does and none is one of content.
    """
    if not attributes:
        return False, 0, ""
    hidden, named, role = False, 0, ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
        if name == "role":
            role = value.strip().lower()
        if name in ("class", "id", "role"):
            said = {_meaning(n) for n in value.split()}
            if "content" not in said:
                named = max(named, 2 * ("sure" in said), "mark" in said)
    return hidden, named, role


#: A block's place: outside the text, in an article's core, or open.
OUTSIDE, CORE, OPEN = range(3)


def blocks(page: str) -> tuple[list[str], bool]:
    """The page's text blocks in order, and whether they are those of an article (or main) element."""
    made, seen = parts(page)
    return [text for text, place in made if place != OUTSIDE], seen


def parts(page: str) -> tuple[list[tuple[str, int]], bool]:
    """All blocks of the page that are shown, each with its place, and whether it has an article (or main) element.

    White space in a block is one space, character references are decoded, empty blocks are left
    out. An article element tells more than a main element around it, if it holds as many words as
    the rest of that; the main element's first heading stays if the article has none. Header
    elements are dropped outside an article and kept within it, where they hold its title.
    Elements that a name marks are dropped, but headings never by their own name, not those that
    hold all articles, and not those that hold most of an article's words, few of them links,
    unless the name is sure. An article in a dropped element is none, nor is a marked one. Open
    elements at the end of a cut page are taken as closed there, and a tag that never ends is left
    out with what follows it, as browsers do.
    """
    made: list[tuple[str, int, int, bool, bool, int]] = []  # text, in main (1) and article (2), innermost marked element, a first heading, dropped, in a paragraph (1) or heading (2)
    stack: list[tuple[str, bool, int, int, bool]] = []  # name, dropped, in main and article, innermost marked element, a first heading
    open_names: Counter[str] = Counter()
    outer, holds, sure = [-1], [True], [False]  # by marked element: the one around it, whether it stays, whether its name is sure; the first is none
    linked = [0]  # by marked element: words within links
    articles: list[int] = []
    run: list[str] = []
    dropped = first = in_link = False
    level = mark = 0
    at, size = 0, len(page)

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            made.append((text, level, mark, first, dropped, 2 if any(open_names[h] for h in HEADINGS) else 1 if open_names["p"] else 0))

    def leave(depth: int) -> None:
        for gone in stack[depth:]:
            open_names[gone[0]] -= 1
        del stack[depth:]

    while at < size:
        opened = _OPEN.search(page, at)
        begin = opened.start() if opened else size
        if begin > at:
            run.append(html.unescape(page[at:begin]))
            if in_link and mark and not dropped:
                linked[mark] += len(run[-1].split())
        if not opened:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            # A declaration or the like ends at the next ">"; a tag that doesn't end takes the rest.
            end = -1 if page[begin + 1] not in "!?/" or page[begin + 1] == "/" and page[begin + 2].isalpha() else page.find(">", begin)
            at = end + 1 if end >= 0 else size
            continue
        at = tag.end()
        name = tag[2].lower()
        known = name in BLOCKS or name in DROPPED
        if name == "a":
            in_link = not tag[1]
        if name == "br":
            run.append(" ")
        elif tag[1]:
            if known:
                close()
            if open_names[name]:
                close()
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name in RAW:
            close()
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
        elif name in VOID:
            if known:
                close()
        else:
            hidden, named, role = _marked(tag[3])
            if not known and (tag[3].endswith("/") or not (hidden or named)):
                continue
            close()
            for ended, by in _ENDED_BY:
                if name in by and stack and stack[-1][0] in ended:
                    leave(len(stack) - 1)
            dropped, level, mark, first = stack[-1][1:] if stack else (False, 0, 0, False)
            page_wide = name in ("html", "body")
            body = 0 if page_wide else 2 if name == "article" or role == "article" else 1 if name == "main" or role == "main" else 0
            gone = dropped or hidden and not page_wide or name in DROPPED or name == "header" and not level
            if body and not gone and not named:
                articles.append(mark)
            inner = mark
            if named and not page_wide and name not in HEADINGS:
                inner = len(outer)
                outer.append(mark)
                holds.append(False)
                sure.append(named == 2)
                linked.append(0)
            stack.append((name, gone, level if named and not level else level | body, inner, first or name == "h1"))
            open_names[name] += 1
        dropped, level, mark, first = stack[-1][1:] if stack else (False, 0, 0, False)
    close()
    if articles and 0 not in articles:
        for k in articles:
            while not holds[k]:
                holds[k], k = True, outer[k]
    if len(outer) > 1:
        # Words of each marked element with those within it, and of the articles without any.
        words, links = [0] * len(outer), linked[:]
        for text, bits, k, _, gone, _ in made:
            if not gone and (bits or not articles):
                words[k] += len(text.split())
        for k in range(len(outer) - 1, 0, -1):
            if outer[k]:
                words[outer[k]] += words[k]
                links[outer[k]] += links[k]
        for k in range(1, len(outer)):
            holds[k] |= not sure[k] and not outer[k] and words[k] > words[0] and 2 * links[k] < words[k]
    kept = [True]
    for k in range(1, len(outer)):
        kept.append(holds[k] and kept[outer[k]])
    left = [(at, bits, h1) for at, (_, bits, k, h1, gone, _) in enumerate(made) if not gone and kept[k] and (bits or not articles)]
    own = sum(len(made[at][0].split()) for at, bits, _ in left if bits & 2)
    if own:
        around = sum(len(made[at][0].split()) for at, bits, _ in left if bits == 1)
        inside = 2 if own >= around else 1
        titled = any(h1 for _, bits, h1 in left if bits & inside)
        left = [x for x in left if x[1] & inside or x[2] and x[1] and not titled]
    places = [OUTSIDE] * len(made)
    for at, _, _ in left:
        places[at] = CORE if articles else OPEN
    if articles:
        # The core begins with the first heading or paragraph and ends with the last paragraph. Without paragraphs, or where the rest holds more words, all is core.
        named = [n for n, (at, _, _) in enumerate(left) if made[at][5]]
        last = max((n for n in named if made[left[n][0]][5] == 1), default=len(left))
        rest = [at for n, (at, _, _) in enumerate(left) if named and not named[0] <= n <= last]
        if 2 * sum(len(made[at][0].split()) for at in rest) < sum(len(made[at][0].split()) for at, _, _ in left):
            for at in rest:
                places[at] = OPEN
    return [(x[0], place) for x, place in zip(made, places, strict=True)], bool(articles)


def host(url: Column) -> Column:
    """The URL's host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _digest(host: str, found: list[str]) -> bytes:
    return hashlib.blake2b("\n".join([host, *found]).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _page(host: str, made: list[tuple[str, int]]) -> bytes:
    """Pages with one such key have the same suffixes: their host, places and blocks are the same."""
    return _digest(host, [f"{place}{text}" for text, place in made])


def _suffixes(made: list[tuple[str, int]], length: int) -> Iterator[tuple[str, int]]:
    """The first ``length`` tokens of a page's suffixes that can cut or confirm something, and where each begins.

    The text's tokens are numbered from 0, a suffix counts if its first tokens hold an open one. Those
    outside it are numbered from -1 downwards; their suffixes end where the text begins.
    """
    text: list[str] = []
    is_open: list[int] = []
    runs: list[list[str]] = [[]]
    for block, place in made:
        tokens = block.split(" ")
        if place == OUTSIDE:
            runs[-1] += tokens
        else:
            text += tokens
            is_open += [place == OPEN] * len(tokens)
            if runs[-1]:
                runs.append([])
    begin = 0
    for run in runs:
        for i in range(len(run) - length + 1):
            yield " ".join(run[i : i + length]), -1 - begin - i
        begin += len(run)
    if any(is_open):
        opened = sum(is_open[: length - 1])
        for i in range(len(text) - length + 1):
            opened += is_open[i + length - 1]
            if opened:
                yield " ".join(text[i : i + length]), i
            opened -= is_open[i]


#: So many suffixes are written at once.
ROWS = 50_000


def _placed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of the suffixes of this task's distinct pages, and at its end one row without a prefix for each page: how often it was there."""
    claim()
    uses: Counter[bytes] = Counter()
    rows: dict[tuple, list[int]] = {}
    for batch in batches:
        for source, name in zip(batch.column("_html"), batch.column("_host").to_pylist(), strict=True):
            made, _ = parts(source.as_py())
            key = _page(name, made)
            uses[key] += 1
            if uses[key] > 1:
                continue
            own = _digest(name, [text for text, place in made if place != OUTSIDE])
            for prefix, start in _suffixes(made, length):
                rows.setdefault((name, prefix, own, key), []).append(start)
                if len(rows) == ROWS:
                    yield _batch([(*k, starts) for k, starts in rows.items()], _SUFFIX)
                    rows.clear()
    yield _batch([(*k, starts) for k, starts in rows.items()], _SUFFIX)
    keys = list(uses)
    for at in range(0, len(keys), ROWS):
        yield _batch([(None, None, None, key, [uses[key]]) for key in keys[at : at + ROWS]], _SUFFIX)


_SUFFIX = pa.schema([("_host", pa.string()), ("prefix", pa.string()), ("_text", pa.binary()), ("_page", pa.binary()), ("starts", pa.list_(pa.int32()))])
_KINDS = "_host string, prefix string, _text binary, _page binary, starts array<int>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def common_prefix(one: str, other: str) -> int:
    """How many first tokens two suffixes have in common."""
    n = 0
    for a, b in zip(one.split(" "), other.split(" "), strict=False):
        if a != b:
            break
        n += 1
    return n


#: So many rows of neighbours are held at once; where more are undecided, they are decided later.
HELD = 10_000


def _neighbours(batches: Iterator[pa.RecordBatch], length: int, shared: int) -> Iterator[pa.RecordBatch]:
    """From suffixes in order: those that have ``length`` tokens in common with neighbours of ``shared`` texts.

    These are given by page and starts alone. Neighbours may go on in the task before or after, so of a
    task's first and last ones up to ``shared`` texts are given without a page, and where there are fewer,
    the rows too with host and prefix, to be decided when all texts are known.
    """
    claim()
    here, last, edge = None, None, True
    texts: list[bytes] = []
    pending: list[tuple] = []
    out: list[tuple] = []

    def end() -> None:
        if here and edge:
            out.extend((*here, text, None, None) for text in texts)
            out.extend((*here, None, *row) for row in pending)
        texts.clear()
        pending.clear()

    for batch in batches:
        for name, prefix, text, page, starts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if not here or name != here[0] or common_prefix(prefix, here[1]) < length:
                end()
                edge, here, last = not here, (name, prefix), None
            if (page, starts) == last:
                continue
            last = (page, starts)
            if len(texts) < shared and (not texts or text != texts[-1]):
                texts.append(text)
            pending.append(last)
            if len(texts) == shared:
                out.extend((None, None, None, *row) for row in pending)
                pending.clear()
            elif len(pending) == HELD:
                out.extend((*here, None, *row) for row in pending)
                pending.clear()
                edge = True
        yield _batch(out, _SUFFIX)
        out.clear()
    edge = True
    end()
    yield _batch(out, _SUFFIX)


def repeated(suffixes: DataFrame, length: int, shared: int) -> DataFrame:
    """_page and starts: where a page's tokens begin a substring of ``length`` tokens that at least ``shared`` texts of its host hold.

    ``suffixes`` has _host, prefix (``length`` tokens), _text, _page and starts; a text counts once, on
    however many pages it stands and however often the prefix comes in it. They are sorted over all tasks by host,
    prefix, text and page, so a prefix that many pages hold is dealt to several tasks, and a task
    compares neighbours. Only what its ends leave undecided is joined once the tasks' ends are added up.
    """
    keys = ["_host", "prefix", "_text", "_page"]
    in_order = suffixes.select(*keys, "starts").repartitionByRange(*keys).sortWithinPartitions(*keys, "starts")
    found = materialize(in_order.mapInArrow(lambda batches: _neighbours(batches, length, shared), _KINDS))
    ends = found.where("_page IS NULL").groupBy("_host", "prefix").agg(F.count_distinct("_text").alias("held")).where(F.col("held") >= shared)
    decided = found.where("_page IS NOT NULL AND prefix IS NULL").select("_page", "starts")
    undecided = found.where("_page IS NOT NULL AND prefix IS NOT NULL").drop("_text")
    marks = decided.unionByName(undecided.join(ends, ["_host", "prefix"]).select("_page", "starts"))
    return marks.groupBy("_page").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("starts"))


def _structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's text if nothing in it is open, else its blocks and which of them are."""
    claim()
    for whole_batch in batches:
        for at in range(0, len(whole_batch), 500):
            batch = whole_batch.slice(at, 500)
            keys, texts, left, places, outside = [], [], [], [], []
            for source, name in zip(batch.column("_html"), batch.column("_host").to_pylist(), strict=True):
                made, _ = parts(source.as_py())
                text = [t for t, place in made if place != OUTSIDE]
                is_open = [place == OPEN for _, place in made if place != OUTSIDE]
                keys.append(_page(name, made))
                texts.append(None if any(is_open) else "\n".join(text))
                left.append(text if any(is_open) else None)
                places.append(is_open if any(is_open) else None)
                outside.append(sum(t.count(" ") + 1 for t, place in made if place == OUTSIDE))
            made_of = [pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(left, pa.list_(pa.string())), pa.array(places, pa.list_(pa.bool_())), pa.array(outside, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made_of], names=["page_id", "url", "_page", "text", "blocks", "places", "n_outside"])


def cut(found: list[str], is_open: list[bool], starts: list[int], length: int) -> str:
    """The text of the blocks without the open tokens that repeats cover.

    A repeat of which at least half is core comes from a copy of the article; the open blocks beside
    the core that it reaches stay. A page that repeats cover whole is a copy of others and stays whole.
    """
    tokens = [b.split(" ") for b in found]
    opened = [o for block, o in zip(tokens, is_open, strict=True) for _ in block]
    before = [0]
    for o in opened:
        before.append(before[-1] + (not o))
    zone, n = [], 0  # runs of open tokens by number, and of core tokens between them
    for at, o in enumerate(opened):
        n += at > 0 and o != opened[at - 1]
        zone.append(n)
    covered, copied = [False] * len(opened), set()
    for s in starts:
        if 2 * (before[s + length] - before[s]) >= length:
            copied.update(zone[s : s + length])
        else:
            covered[s : s + length] = [True] * length
    kept, at = [], 0
    for block in tokens:
        end = at + len(block)
        left = [t for t, c, o, z in zip(block, covered[at:end], opened[at:end], zone[at:end], strict=True) if not (c and o) or z in copied]
        at = end
        if left:
            kept.append(" ".join(left))
    return "\n".join(kept or found)


def _cut(length: int):
    @F.pandas_udf("string")
    def made(found: pd.Series, is_open: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else "\n".join(b) if s is None else cut(list(b), list(o), [k for k in s if k >= 0], length) for b, o, s in zip(found, is_open, starts, strict=True)], dtype=object)

    return made


#: Rows of a page that very many rows repeat are joined in so many parts.
PARTS = 64


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", length: int = 12, shared: int = 3) -> DataFrame:
    """page_id, url, text (empty if none), n_chars (its code points), n_outside and n_repeated of every page.

    ``length`` tokens on ``shared`` pages of a host, told apart by their texts, make boilerplate in open
    blocks. Of the tokens outside the text (n_outside) repeats cover n_repeated; these are left out
    whether covered or not. Null and empty pages have no text; repeated rows are each returned; an
    empty table gives no rows. Pages are read twice, for suffixes and for texts; only suffixes and where they
    repeat go to scratch tables.
    """
    slim = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), whole(page).alias("_html")).withColumn("_host", host(F.col("url")))
    placed = materialize(slim.select("_host", "_html").mapInArrow(lambda batches: _placed(batches, length), _KINDS))
    marks = repeated(placed.where("prefix IS NOT NULL"), length, shared)
    covered = F.expr(f"aggregate(array_sort(transform(filter(starts, s -> s < 0), s -> -1 - s)), named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct('n', a.n + s + {length} - greatest(a.e, s), 'e', CAST(s + {length} AS LONG)), a -> a.n)")
    marks = marks.withColumn("n_repeated", covered)
    kinds = f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string"
    rows = slim.mapInArrow(_structured, f"{kinds}, _page binary, text string, blocks array<string>, places array<boolean>, n_outside long")
    uses = placed.where("prefix IS NULL").groupBy("_page").agg(F.sum(F.element_at("starts", 1)).alias("_uses"))
    total = uses.agg(F.sum("_uses")).first()[0] or 0
    on = ["_page"]
    if total > FEW_ROWS:
        often = F.broadcast(materialize(uses.where(F.col("_uses") * SHARE > total).select("_page", F.lit(True).alias("_often"))))
        rows = rows.join(often, "_page", "left").withColumn("_part", F.when(F.col("_often"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).otherwise(0)).drop("_often")
        marks = marks.join(often, "_page", "left").withColumn("_part", F.explode(F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("_often")
        on = ["_page", "_part"]
    both = rows.join(marks, on, "left")
    texts = F.coalesce("text", _cut(length)("blocks", "places", F.when(F.col("blocks").isNotNull(), F.col("starts"))))
    out = both.select(F.col("page_id").alias(key), F.col("url").alias(url), texts.alias("text"), "n_outside", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))
    return out.select(key, url, "text", F.length("text").cast("long").alias("n_chars"), "n_outside", "n_repeated")
