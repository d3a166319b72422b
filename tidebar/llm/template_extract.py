"""Main text of web pages by equivalence classes of template tokens.

Pages of one host come from one template. A token is a start or end tag, or a piece of text, together with the path
of elements it stands in, so equal tags in different places are different tokens. Tokens with the same
occurrence vector (how often in each page of the host) form an equivalence class. Classes nest: a token's parent is
the nearest element around it that has another vector, told by its path, and tokens of one vector under different
parents are different classes, as they stand in different slots. A class is valid if it
occurs in enough pages and has an element, that is a pair of tags. Equal pages count once, so copies of a page
are no evidence of a template. The valid classes with their parents are the
host's template. Text of a valid class, and text in nearly
all pages, is the template's and left out, unless its own element also holds text that varies. Other text fills the template's slots. The frame is the deepest
element, once in nearly every page, that holds all the host's slot text; the main text is what the slots hold
below it. Text that varies and yet stands beside the article (comments, related links) looks like any slot; it is
told apart by names of elements and words in class and id, which are lists, not learned.

A vector never exists as such: classes are found by an exclusive-or over the hashes of (page, count), which
partial aggregation combines, so a host with a third of all pages is no large group anywhere.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, text_of

#: A class must occur in this share of the host's different pages, and in this many; the frame's element, and text without one in its class, in this share and in two.
SUPPORT, LEAST, WHOLE = 0.3, 3, 0.9
# Names of elements, as HTML has them, and words in class and id that say what an element is for.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|title"
ASIDE = set("nav header footer aside form button dialog menu fieldset head".split())
PURPOSE = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|sidebar|menu|nav|navbar|navigation|header|footer|comments?|disqus|cookies?|consent|notice|popup|modal|share|social|related|breadcrumbs?|newsletter|subscribe|signup|login)(?:[-_\s]|$)", re.I)
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}

LEXER = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
MARK = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def piece(path: str, text: str) -> int:
    """A whole text with its path, as a number."""
    return int.from_bytes(hashlib.blake2b(f"{path} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """blocks: (path of the element that holds it, text, whether it stands in something beside the article, number of the element)."""

    def __init__(self, source: str):
        self.tokens: Counter = Counter()
        self.blocks: list[tuple[str, str, bool, int]] = []
        stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # name, path, beside, number
        held: list[str] = []

        def flush() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                inner = next(s for s in reversed(stack) if s[0] not in INLINE)
                self.blocks.append((inner[1], text, any(s[2] for s in stack), inner[3]))

        def close(upto: int) -> None:
            while len(stack) > upto:
                name, path, _, _ = stack.pop()
                if name not in INLINE:
                    self.tokens["+" + path] += 1

        for m in LEXER.finditer(source):
            if m.group("text") is not None:
                held.append(m.group("text"))
                continue
            name = (m.group("name") or "").lower()
            if not name or name in INLINE and m.group("end"):
                if name and any(s[0] == name for s in stack):
                    at = max(i for i, s in enumerate(stack) if s[0] == name)
                    if all(s[0] in INLINE for s in stack[at:]):
                        del stack[at:]
                continue
            if name not in INLINE:
                flush()
            if m.group("end"):
                if any(s[0] == name for s in stack):
                    close(max(i for i, s in enumerate(stack) if s[0] == name))
                continue
            if name in CLOSES_P and any(s[0] == "p" for s in stack):
                close(max(i for i, s in enumerate(stack) if s[0] == "p"))
            for sibling in SIBLINGS.get(name, "").split():
                if stack[-1][0] == sibling:
                    close(len(stack) - 1)
            marks = " ".join(next(filter(None, x), "") for x in MARK.findall(m.group("rest")))
            label = re.sub(r"\d+", "0", marks.split()[0]) if marks.strip() else ""
            path = f"{stack[-1][1]}/{name}.{label}" if label else f"{stack[-1][1]}/{name}"
            if name in INLINE and name not in VOID:
                stack.append((name, stack[-1][1], bool(PURPOSE.search(marks)), stack[-1][3]))
                continue
            if name not in VOID and name not in INLINE and not m.group("rest").rstrip().endswith("/"):
                stack.append((name, path, name in ASIDE or bool(PURPOSE.search(marks)), m.start()))
        flush()
        close(1)

    def main(self, frame: str | None, template: frozenset[int] = frozenset()) -> str:
        # a line beside slot text in one element is part of that slot; a page that has nothing but template keeps it
        slots = {at for p, t, beside, at in self.blocks if not beside and piece(p, t) not in template}
        own = [(p, t) for p, t, beside, at in self.blocks if not beside and (at in slots or not slots)]
        if frame and any(p == frame or p.startswith(frame + "/") for p, _ in own):
            own = [(p, t) for p, t in own if p == frame or p.startswith(frame + "/")]
        else:
            for name in ("/article", "/main"):
                if any(name in p for p, _ in own):
                    own = [(p, t) for p, t in own if name in p]
                    break
        return "\n".join(t for _, t in own)


def _occurrences(pages: DataFrame) -> DataFrame:
    """host, path, piece, page, n, chars: elements of each page (piece null) and its texts, with their counts and, for texts beside nothing, characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, text, page, n, chars = [], [], [], [], [], []
            for h, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                read = Page(value.as_py())
                found = {(token[1:], None): [k, 0] for token, k in read.tokens.items()}
                for p, t, beside, _ in read.blocks:
                    of = found.setdefault((p, piece(p, t)), [0, 0])
                    of[0] += 1
                    of[1] += 0 if beside else len(t)
                for (p, t), (k, c) in found.items():
                    host.append(h)
                    path.append(p)
                    text.append(t)
                    page.append(key)
                    n.append(k)
                    chars.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), *[pa.array(x, pa.int64()) for x in (text, page, n, chars)]], ["host", "path", "piece", "page", "n", "chars"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, path string, piece long, page long, n long, chars long")


def _above(path: str) -> Column:
    """The paths of the elements around a token of this path, its own included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _nested(framed: DataFrame) -> DataFrame:
    """framed with `parent`, the path of the nearest element around the token that is of another class; empty at the top."""
    around = framed.where("piece IS NULL").select("host", F.col("path").alias("up"), F.col("vector").alias("up_vector"))
    x = framed.withColumn("up", F.explode(_above("path"))).join(around, ["host", "up"], "left")
    nearest = F.max(F.when(F.col("up_vector") != F.col("vector"), F.struct(F.length("up").alias("l"), "up")))
    return x.groupBy(*framed.columns).agg(F.coalesce(nearest["up"], F.lit("")).alias("parent"))


def _once(pages: DataFrame) -> DataFrame:
    """Equal pages of a host once; whole pages are dealt out only if they have equals. pages: host, page (a hash of the html), html."""
    again = pages.groupBy("host", "page").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("host", "page")
    if again.isEmpty():
        return pages
    return pages.join(again, ["host", "page"], "left_anti").unionByName(pages.join(again, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]))


def templates(pages: DataFrame) -> DataFrame:
    """host, frame, template: the path below which a host's pages keep their main text, and the texts (as pieces) that are the template's."""
    pages = _once(pages)
    every = _occurrences(pages).groupBy("host", "path", "piece").agg(F.count(F.lit(1)).alias("pages"), F.expr("bit_xor(xxhash64(page, n))").alias("vector"), F.max("n").alias("most"), F.sum("chars").alias("chars"))
    # texts of one page only are slots, never template; of them only their characters count
    once = F.col("piece").isNotNull() & (F.col("pages") == 1)
    every = every.groupBy("host", "path", F.when(~once, F.col("piece")).alias("piece"), once.alias("once")).agg(F.max("pages").alias("pages"), F.max("vector").alias("vector"), F.max("most").alias("most"), F.sum("chars").alias("chars"))
    every = stored(every.where("pages > 1 OR chars > 0"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    framed = every.where("NOT once").join(total, "host").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(SUPPORT * F.col("total"))))
    whole = F.col("pages") >= WHOLE * F.col("total")
    classes = stored(_nested(framed))
    backed = F.col("pages") >= F.greatest(F.lit(LEAST), F.ceil(SUPPORT * F.col("total")))
    elements = classes.where(F.col("piece").isNull() & (backed | whole)).select("host", "vector", "pages", "parent").distinct().withColumn("valid", F.lit(True))
    texts = classes.where("piece IS NOT NULL").join(elements, ["host", "vector", "pages", "parent"], "left").where(F.col("valid") | whole)
    fixed = stored(texts.select("host", "path", "piece", "chars"))
    template = fixed.groupBy("host").agg(F.collect_list("piece").alias("template"))
    frames = framed.where((F.col("piece").isNull()) & (F.col("most") == 1) & whole).select("host", F.col("path").alias("frame"))
    signed = every.where("chars > 0").select("host", "path", "chars").unionAll(fixed.select("host", "path", -F.col("chars")))
    text = stored(signed.groupBy("host", "path").agg(F.sum("chars").alias("chars")).where("chars > 0"))
    above = text.select("host", "chars", F.explode(_above("path")).alias("frame"))
    held = above.where("frame <> ''").groupBy("host", "frame").agg(F.sum("chars").alias("held")).join(frames, ["host", "frame"])
    all_text = text.groupBy("host").agg(F.sum("chars").alias("all"))
    best = held.join(all_text, "host").where(F.col("held") == F.col("all"))
    depth = F.size(F.split("frame", "/"))
    best = best.groupBy("host").agg(F.max(F.struct(depth.alias("d"), F.col("frame"))).alias("b")).select("host", F.col("b.frame").alias("frame"))
    return best.join(template, "host", "full")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id column, url column, text (empty if none), n_chars.

    A null html counts as empty and gives an empty text. Pages without a host (null or odd urls) share one
    template as if of one host. Hosts with one page have no template; there, article or main elements
    decide, else all text beside nothing. Repeated rows and null ids are treated row by row. Other columns are not
    read. An empty table gives an empty one.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract(url_column, HOST, 1), F.lit("")))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), host.alias("host"), text_of(html_column).alias("html"))
    template = stored(templates(rows.select("host", F.xxhash64("html").alias("page"), "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py()).main(f.as_py(), frozenset(t.as_py() or ())) for h, f, t in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    found = rows.join(template, "host", "left").select("id", "url", "html", "frame", "template")
    return found.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
