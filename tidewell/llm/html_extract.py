"""Main text of web pages: differencing against the pages with the nearest URLs, and markup.

1. A page becomes blocks of text. Each block has a level: 2 inside an ``article``, 1
   inside ``main``, else 0. Subtrees that say what they are (menus, headers, footers,
   sidebars, forms, scripts, notices, adverts, reader comments) yield no blocks.
2. Pages are sorted by host and URL path, and each is paired with its nearest URLs, the
   one before and the one after it. Page sequences that a host repeats word for word
   stand there once, so a run of copies does not hide the next different page. The blocks
   of a pair are aligned by longest common subsequence; what both have is shared. Pages
   that share four fifths of their words are copies of one text: they mark nothing.
3. Text of the highest level stands; below ``article``, shared blocks are deleted, and
   outside ``main`` also blocks that are links alone or notes of rights. What stands in ``main`` before its
   article, such as a title, stands too unless it is shared. Inside an article nothing is
   deleted: articles quote lines that their neighbours have, and those are main text.

Only hashes and lengths of blocks are sorted and compared. Sorting is by range, so a host
with a third of all pages spreads over many tasks; the two rows at each border between
tasks are paired in a second step, one border to a group.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise, prepare

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form template menu dialog button select option svg canvas video audio object head datalist".split())
FIELDS = frozenset("button select option input label svg".split())  # dropped within a line of text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NESTED = frozenset("html body article main section div header ul ol dl table thead tbody tfoot tr td th figure blockquote details fieldset center".split()) | DROPPED
#: Words in class, id or role by which a subtree says that it is not main text.
NOT_TEXT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond replies pagination pager search widget toolbar complementary contentinfo".split()
)
OUTER_ONLY = frozenset(["header", "masthead", "topbar"])
#: Words that may go with these in one name, as in ``comment-list`` or ``ad_box_2``.
BESIDE = frozenset("area author bar bars block body bottom box button buttons container content div drawer fixed form global group header icon icons inner item items label left link links list main my outer page panel post posts primary reader right row section site slot secondary sticky stories text thread title top unit user widget widgets wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist disqus replies".split())
NEVER = frozenset(["html", "body", "main"])
WORD = re.compile(r"[a-z0-9]+")
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)  # how a footer begins


def says(name: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is made of the words (and of what may go with them) alone:
    ``no-sidebar`` and ``search-algorithms`` are not."""
    parts = [x for x in WORD.findall(name) if not x.isdigit()]
    return any(x in words for x in parts) and all(x in words or x in NOT_TEXT or x in BESIDE for x in parts)


def unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a start tag's attributes mark a subtree that is not main text. The names
    of a page's frame say nothing of the kind, nor do an article's but for comments."""
    names = COMMENTS if tag == "article" else NOT_TEXT if inside else NOT_TEXT | OUTER_ONLY
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return True
        if name in ("class", "id", "role"):
            if tag not in NEVER and any(says(x, names) for x in html.unescape(value).strip("\"'").lower().split()):
                return True
        elif name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def blocks(page: str | None) -> list[tuple[int, str, bool]]:
    """(level, text, whether all of it is links) of each block that is not empty, in page
    order. A null page has none."""
    page = page or ""
    out: list[tuple[int, str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, dropped, level, part of a line
    dropped, level, at = False, 0, 0
    link, plain = False, False  # inside a link; the block has text outside links

    def close() -> None:
        nonlocal plain
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((level, text, not plain))
            parts.clear()
        plain = False

    def pop_to(k: int) -> None:
        nonlocal dropped, level
        if not all(x[3] for x in stack[k:]):
            close()
        del stack[k:]
        dropped, level = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    while True:
        token = TOKEN.search(page, at)
        begin, end = token.span() if token else (len(page), len(page))
        if begin > at and not dropped:
            parts.append(page[at:begin])
            plain = plain or not link and not parts[-1].isspace()
        if not token:
            break
        at = end
        tag = token.group()
        named = NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        in_line = name in INLINE or name in FIELDS
        if name == "a":
            link = tag[1] != "/"
        if tag[1] == "/":
            if not in_line:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if not in_line:
            close()
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
        if name in RAW:
            over = RAW_END[name].search(page, at)
            at = over.start() if over else len(page)
            continue
        if name in VOID:
            continue
        rest = tag[named.end() :]
        off = name in DROPPED or name == "header" and level < 1 or ("=" in rest or "hidden" in rest) and unwanted(name, rest, level > 0)
        if off or name in NESTED:
            if not in_line:
                close()
            deeper = 2 if name == "article" else 1 if name == "main" or "role" in rest and re.search(r"""role\s*=\s*["']?main\b""", rest, re.I) else 0
            dropped, level = dropped or bool(off), max(level, deeper)
            stack.append((name, dropped, level, in_line))
    close()
    return out


def undecided(found: list[tuple[int, str, bool]]) -> list[int]:
    """Numbers of the blocks that stand unless they are shared: those of the highest level
    below ``article``, outside ``main`` without links alone and notes of rights; and
    those of ``main`` before its article."""
    levels = [k for k, _, _ in found]
    top = max(levels, default=0)
    if top == 2:
        return [i for i in range(levels.index(2)) if levels[i] == 1]
    own = [i for i, k in enumerate(levels) if k == top]
    return own if top else [i for i in own if not found[i][2] and not RIGHTS.match(found[i][1])] or own


def main_text(found: list[tuple[int, str, bool]], shared: set[int]) -> str:
    """The text from blocks and the numbers of those that paired pages have too."""
    certain = [i for i, (k, _, _) in enumerate(found) if k == 2]
    open_ = undecided(found)
    kept = [i for i in open_ if i not in shared]
    return "\n\n".join(found[i][1] for i in (kept + certain if certain else kept or open_))


# --- alignment --------------------------------------------------------------------

SMALL = 1 << 22
BROADCAST_BYTES = 64 << 20


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b."""
    best = np.zeros(len(b) + 1, np.int32)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(b == x, best[:-1] + 1, 0)))
    return best


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the items of a in one longest common subsequence with b. Large
    inputs are halved (Hirschberg), so memory stays linear."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    head, tail = list(range(n)), list(range(len(a) - m, len(a)))
    a, b = a[n : len(a) - m], b[n : len(b) - m]
    here = np.isin(a, b)
    own, b = np.flatnonzero(here), b[np.isin(b, a)]
    a = a[own]
    if not len(a):
        return head + tail
    if len(a) * len(b) > SMALL and len(a) > 1:
        half = len(a) // 2
        cut = int((_row(a[:half], b) + _row(a[half:][::-1], b[::-1])[::-1]).argmax())
        middle = common(a[:half], b[:cut]) + [half + i for i in common(a[half:], b[cut:])]
    else:
        table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        for i, x in enumerate(a):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(b == x, table[i, :-1] + 1, 0)))
        middle, i, j = [], len(a), len(b)
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                middle.append(i)
        middle.reverse()
    return head + [n + int(own[i]) for i in middle] + tail


# --- pairing ----------------------------------------------------------------------

URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?)?([^?#]*)(\?[^#]*)?")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case, and path with query; both empty for a null."""
    m = URL.match(url or "")
    return (m[1] or "").lower(), (m[2] or "/") + (m[3] or "")


COPY = 0.8  # share of words from which on two pages are one text
LIGHT = "page_id long, page_hash long, host string, path string, matters boolean, content long, hashes binary, sizes binary"
PAIRED = "pid int, kind int, host string, content long, hashes binary, sizes binary, shared binary"
MARKED = "host string, content long, shared binary"
INNER, FIRST, LAST = 0, 1, 2  # kinds of rows: results, a partition's first row, its last row


def _schema(names: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))])


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, page_hash, url, page in zip(*(batch.column(c) for c in ("page_id", "page_hash", "url", "html")), strict=True):
            host, path = host_and_path(url.as_py())
            found = blocks(page.as_py())
            hashes = b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for _, t, _ in found)
            sizes = np.array([t.count(" ") + 1 for _, t, _ in found], np.uint32).tobytes()
            content = int.from_bytes(xxhash.xxh3_64_digest(hashes), "little", signed=True)
            out.append({"page_id": page_id.as_py(), "page_hash": page_hash.as_py(), "host": host, "path": path, "matters": bool(undecided(found)), "content": content, "hashes": hashes, "sizes": sizes})
        yield pa.RecordBatch.from_pylist(out, schema=_schema(LIGHT))


def shared_blocks(own: dict, other: dict) -> np.ndarray:
    """Numbers of the blocks of a page that another has too; copies share none."""
    sizes = np.frombuffer(own["sizes"], np.uint32)
    found = np.array(common(np.frombuffer(own["hashes"], np.uint64), np.frombuffer(other["hashes"], np.uint64)), np.int32)
    return found if sizes[found].sum() < COPY * sizes.sum() else found[:0]


def _pair(a: dict, b: dict, marks: dict[int, list[np.ndarray]]) -> None:
    if a["host"] == b["host"]:
        for own, other in ((a, b), (b, a)):
            marks.setdefault(own["content"], []).append(shared_blocks(own, other))


def _marked(row: dict, marks: dict[int, list[np.ndarray]]) -> dict:
    found = marks.pop(row["content"], [])
    return {"host": row["host"], "content": row["content"], "shared": np.unique(np.concatenate(found)).astype(np.int32).tobytes() if found else b""}


def _pair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within a partition; its first and last row go on to the borders, too."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    row = lambda kind, x, **more: {"pid": pid, "kind": kind, "host": x["host"], "content": x["content"], "hashes": None, "sizes": None, "shared": None} | more
    edge = lambda kind, x: row(kind, x, hashes=x["hashes"], sizes=x["sizes"])
    out: list[dict] = []
    marks: dict[int, list[np.ndarray]] = {}
    before = None
    for batch in batches:
        for now in batch.to_pylist():
            if before is None:
                out.append(edge(FIRST, now))
            else:
                _pair(before, now, marks)
                if told := _marked(before, marks)["shared"]:
                    out.append(row(INNER, before, shared=told))
            before = now
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=_schema(PAIRED))
                out = []
    if before is not None:
        if told := _marked(before, marks)["shared"]:
            out.append(row(INNER, before, shared=told))
        out.append(edge(LAST, before))
    yield pa.RecordBatch.from_pylist(out, schema=_schema(PAIRED))


def _pair_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by border, the one before it first; a border at an end has one row."""
    before = None
    for batch in batches:
        out = []
        for now in batch.to_pylist():
            if before is not None and before["border"] == now["border"]:
                marks: dict[int, list[np.ndarray]] = {}
                _pair(before, now, marks)
                out += [told for x in (before, now) if (told := _marked(x, marks))["shared"]]
            before = now
        yield pa.RecordBatch.from_pylist(out, schema=_schema(MARKED))


def shared_by_pairs(light: DataFrame) -> DataFrame:
    """host, content, shared (int32 numbers of blocks): marks by pairs of different pages."""
    one = light.groupBy("host", "content").agg(F.min(F.struct("path", "page_id", "page_hash", "hashes", "sizes")).alias("x"))
    order = ["host", "path", "page_id", "page_hash", "content"]
    dealt = one.select("host", "content", "x.*").repartitionByRange(*order).sortWithinPartitions(*order)
    paired = materialise(dealt.mapInArrow(_pair_sorted, PAIRED), "page-pairs")
    edges = paired.where(F.col("kind") != INNER)
    # borders by number: a row a partition, and partitions may be empty
    numbers = edges.select(F.col("pid").alias("p")).distinct().withColumn("number", F.row_number().over(Window.orderBy("p")))
    borders = edges.join(F.broadcast(numbers), F.col("pid") == F.col("p")).withColumn("border", F.when(F.col("kind") == FIRST, F.col("number") - 1).otherwise(F.col("number")))
    settled = borders.select("border", "kind", "host", "content", "hashes", "sizes").repartition("border").sortWithinPartitions("border", F.desc("kind"))
    return paired.where(F.col("kind") == INNER).select("host", "content", "shared").unionByName(settled.mapInArrow(_pair_borders, MARKED))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, shared in zip(batch.column("html"), batch.column("shared"), strict=True):
            marks = np.frombuffer(b"".join(shared.as_py() or ()), np.int32)
            texts.append(main_text(blocks(page.as_py()), set(marks.tolist())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by two line feeds), n_chars for every page.

    A null or empty html has the text ``''``; a null URL has an empty host and the path
    ``/``. Pages without a neighbour of their host share no blocks. Repeated rows, and
    pages of a host with the same blocks, get equal texts. Other columns are not read. An
    empty table gives no rows. A tag or raw text that a cut page leaves open ends with the
    page.

    Each page is parsed twice: for the hashes, and for the text. Marks go back to the
    pages that have a block to be decided, by broadcast within ``BROADCAST_BYTES``; only
    beyond it is html shuffled.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("page_hash", F.xxhash64("url", "html"))
    light = materialise(own.mapInArrow(_light, LIGHT), "page-blocks")
    marks = shared_by_pairs(light).withColumnsRenamed({"host": "h", "content": "c"})
    decided = light.where("matters").select("page_id", "page_hash", "host", "content").distinct().join(marks, (F.col("host") == F.col("h")) & (F.col("content") == F.col("c")))
    shared = materialise(decided.groupBy(F.col("page_id").alias("__id"), F.col("page_hash").alias("__hash")).agg(F.collect_list("shared").alias("shared")), "page-marks")
    size = shared.agg(F.sum(64 + F.aggregate("shared", F.lit(0), lambda a, x: a + F.length(x)))).first()[0] or 0
    shared = F.broadcast(shared) if size <= BROADCAST_BYTES else shared
    joined = own.join(shared, (F.col("page_hash") == F.col("__hash")) & F.col("page_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("page_id", "url", "html", "shared").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
