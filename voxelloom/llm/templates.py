"""Main text of web pages by template deduction over equivalence classes.

Tokens are tags in their role: the path of elements above them. Over all pages of a host, a token has an occurrence
vector, how often it stands on each page. Tokens with equal vectors form an equivalence class; a class is valid if it has
enough tokens and pages and if its tokens keep one order on every page. Valid classes nest by their paths into the
host's template. What lies between template tokens are slots.

The template decides which slots are the article. From the root down, an element whose own flow of text (all that is
not inside a smaller template element) is the same on all pages is layout, and the part that holds most of its text is entered;
an element whose flow differs from page to page is a slot, and the descent ends. Marks such as ``article`` decide where no
part holds most, and end the descent. Elements of the template that say the same on all pages, or that stand on nearly every page under a
name of notices and the like, are not slots; the same name on an element of a single article is.

Vectors are never gathered: two 64-bit sums of hashes of (page, count) stand for them, and are added up before they are
shuffled, so a host may have any number of pages.

Defined results: a null page is an empty one and has no text; a null or unreadable address is a host of its own kind. Pages of
hosts with too few pages for a class are read by their own elements. Repeated rows count as pages of their own.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import pages
from .common import slices, stage, text_of

PAGES, TOKENS = 3, 3  # of a valid class, at least
MOST, EVERY = 0.5, 0.9  # share of a layout element's text in the part that is entered; share of pages with an element of the template
HOLDERS = frozenset("html body div section table tbody tr td main article".split())


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def tokens(page: str) -> dict[str, list]:
    """Per path: count, first place among the page's tags, code points of article-like text inside (links aside), hash of
    the text inside, hash of its own flow."""
    counts: Counter[str] = Counter()
    first: dict[str, int] = {}
    opened: list[pages.Element] = []
    for kind, element, text, stack in pages.walk(page):
        if kind == "open":
            counts[element.path] += 1
            first.setdefault(element.path, len(first))
            opened.append(element)
        elif kind == "text" and stack and not stack[-1].hidden and (bare := text.strip()):
            top, code = stack[-1], _hash(bare)
            top.said += code
            if not top.link:
                top.chars += len(bare)
                top.flow += code
    chars: Counter[str] = Counter()
    said: Counter[str] = Counter()
    flow: Counter[str] = Counter()
    for e in reversed(opened):  # what is inside was opened later
        if e.parent:
            e.parent.chars += e.chars
            e.parent.said += e.said
            if e.tag not in HOLDERS:
                e.parent.flow += e.flow
        if e.tag in HOLDERS and e.chars:
            chars[e.path] += e.chars
            said[e.path] += e.said
            flow[e.path] += e.flow
    return {p: [n, first[p], chars[p], _signed(said[p]), _signed(flow[p])] for p, n in counts.items()}


def _signed(x: int) -> int:
    """A number modulo 2^64 as a signed one."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per host and token of what a slice of pages holds."""
    for part in slices(batches, text="html"):
        total: dict[tuple[str, str], list[int]] = {}
        for host, key, page in zip(*(part.column(i).to_pylist() for i in range(3))):
            for path, (n, place, chars, said, flow) in tokens(page).items():
                row = total.setdefault((host, path), [0, 0, 0, 0, 0, n, n, said, said, flow, flow])
                row[0] += 1
                row[1] = (row[1] + _hash(key, n)) & 0xFFFFFFFFFFFFFFFF
                row[2] = (row[2] + _hash(n, key, "b")) & 0xFFFFFFFFFFFFFFFF
                row[3] += place
                row[4] += chars
                row[5], row[6] = min(row[5], n), max(row[6], n)
                row[7], row[8] = min(row[7], said), max(row[8], said)
                row[9], row[10] = min(row[9], flow), max(row[10], flow)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        cells = [[k[0] for k in total], [k[1] for k in total], *[list(c) for c in zip(*total.values())]] if total else [[]] * 13
        cells[3], cells[4] = [signed(x) for x in cells[3]], [signed(x) for x in cells[4]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cells)],
            ["host", "path", "n", "sig1", "sig2", "place", "chars", "least", "most", "said_low", "said_high", "flow_low", "flow_high"])


def _hosted(table: DataFrame):
    host = F.lower(F.regexp_extract(F.coalesce(table["url"], F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return host.alias("host")


def _wrapped(column: str):
    """Sum of 64-bit numbers modulo 2^64, on halves that cannot overflow."""
    low = F.sum(F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{column}_low")
    high = F.sum(F.shiftrightunsigned(column, 32)).alias(f"{column}_high")
    return [low, high]


def vectors(table: DataFrame) -> DataFrame:
    """(host, path, n, v1, v2, place, chars, least, most, constant, still): occurrence vectors of all tokens."""
    rows = table.select(_hosted(table), F.xxhash64("page_id", "url", "html", F.monotonically_increasing_id()).alias("key"),
                        text_of(table, "html").alias("html"))
    parts = rows.mapInArrow(_summed, "host string, path string, n bigint, sig1 bigint, sig2 bigint, place bigint, chars bigint, "
                                     "least bigint, most bigint, said_low bigint, said_high bigint, flow_low bigint, flow_high bigint")
    added = parts.groupBy("host", "path").agg(
        F.sum("n").alias("n"), *_wrapped("sig1"), *_wrapped("sig2"), F.sum("place").alias("place"), F.sum("chars").alias("chars"),
        F.min("least").alias("least"), F.max("most").alias("most"), (F.min("said_low") == F.max("said_high")).alias("constant"),
        (F.min("flow_low") == F.max("flow_high")).alias("still"))
    whole = {f"v{i}": F.shiftleft((F.col(f"sig{i}_high") + F.shiftright(f"sig{i}_low", 32)).bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(
        F.col(f"sig{i}_low").bitwiseAND(F.lit(0xFFFFFFFF))) for i in (1, 2)}
    return added.withColumns(whole).drop("sig1_low", "sig1_high", "sig2_low", "sig2_high")


def classes(found: DataFrame) -> DataFrame:
    """Valid equivalence classes: (host, v1, v2, paths), paths in page order.

    Equal vectors mean equal pages and counts. Where each token stands once, their order is the order of their mean
    places; an element opens after those around it on every page, so a path stands after the paths it extends.
    """
    member = F.struct((F.col("place") / F.col("n")).alias("place"), "path")
    grouped = found.where((F.col("n") >= PAGES)).groupBy("host", "v1", "v2").agg(F.sort_array(F.collect_set(member)).alias("members"))
    paths = F.transform("members", lambda m: m["path"])
    return grouped.where(F.size("members") >= TOKENS).select("host", "v1", "v2", paths.alias("paths"))


def _above(path: str):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def host_templates(found: DataFrame) -> DataFrame:
    """(host, main, fixed): per host the paths of the elements that hold the article and of those that are no slots."""
    valid = classes(found).select("host", F.explode("paths").alias("path"))
    template = found.join(valid, ["host", "path"])
    site = template.groupBy("host").agg(F.max("n").alias("pages"))
    names = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    lit = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    rows = template.join(site, "host").where(F.col("n") >= EVERY * F.col("pages")).select(
        "host", "path", "n", "chars", "constant", "still", "most", names.alias("names"), F.element_at(names, 1).alias("tag"),
        F.size(F.split("path", "/")).alias("depth")).withColumn("marked", F.col("tag").isin(*sorted(pages.MAIN_TAGS)) | F.arrays_overlap(
            F.slice("names", 2, 1 << 20), lit(pages.MAIN_WORDS)))
    rows = stage(rows)
    # Elements that stand once on each page, and what is around them.
    nodes = rows.where((F.col("most") == 1) & F.col("tag").isin(*sorted(HOLDERS)) & (F.col("chars") > 0)).withColumn("up", _above("path"))
    around = nodes.select("host", F.col("path").alias("up"), F.col("chars").alias("whole"), F.col("still").alias("layout"), F.col("marked").alias("stop"))
    parts = nodes.join(around, ["host", "up"], "left")
    best = W.partitionBy("host", "up").orderBy(F.desc("marked"), F.desc("chars"), "path")
    most = F.col("chars") > MOST * F.col("whole")
    parts = parts.withColumn("first", F.row_number().over(best) == 1).withColumn("taken", F.max(most).over(W.partitionBy("host", "up")))
    enter = F.when(F.col("up") == "", True).otherwise(
        F.col("layout") & ~F.col("stop") & (most | ~F.col("taken") & F.col("marked") & F.col("first")))
    entered = parts.where(enter).select("host", "path", "depth", "chars", "marked")
    # The descent holds the elements all of whose surroundings were entered.
    prefixes = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    steps = entered.select("*", F.explode(prefixes).alias("step")).join(
        entered.select("host", F.col("path").alias("step")), ["host", "step"], "left_semi")
    descent = steps.groupBy("host", "path", "depth", "chars", "marked").agg(F.count(F.lit(1)).alias("n")).where("n = depth")
    last = descent.groupBy("host").agg(F.max_by(F.struct("path", "depth", "chars", "marked"), F.struct("depth", "path")).alias("last"))
    # Where it ends at an element without marks, marked ones inside that hold most of its text, or the page's only ones, go first.
    inside = nodes.where("marked").join(last.where("not last.marked"), "host").where(F.col("path").startswith(F.concat("last.path", F.lit("/"))) & (
        (F.col("chars") > MOST * F.col("last.chars")) | (F.col("last.depth") <= 2)))
    outer = inside.withColumn("top", F.min("depth").over(W.partitionBy("host"))).where("depth = top").groupBy("host").agg(
        F.collect_set("path").alias("marks"))
    main = last.join(outer, "host", "left").select("host", F.coalesce("marks", F.array("last.path")).alias("main"))
    steady = main.select("host", F.explode("main").alias("path")).join(rows.select("host", "path", "constant"), ["host", "path"]).groupBy(
        "host").agg(F.max("constant").alias("steady"))
    # If the article itself is the same on all pages, what says the same is no sign.
    no_slot = (F.col("constant") & ~F.col("steady") & F.col("tag").isin(*sorted(HOLDERS - pages.MAIN_TAGS - {"html", "body"}))) | F.arrays_overlap(
        F.slice("names", 2, 1 << 20), lit(pages.WEAK_WORDS))
    fixed = rows.where(F.col("n") >= PAGES).join(steady, "host").where(no_slot).groupBy("host").agg(F.collect_set("path").alias("fixed"))
    return main.join(fixed, "host", "left")


def text_in(page: str, main: list[str] | None, fixed: list[str] | None) -> str:
    """The template's slots if the page has them, else those of the page's own marked elements, else of the whole page."""
    there, own = set(), set()
    for kind, element, _, _ in pages.walk(page):
        if kind == "open":
            there.add(element.path)
            if element.main and not element.aside:
                own.add(element.path)
    wanted = frozenset(main or ()) & there or frozenset(own)
    return pages.blocks(page, wanted, frozenset(fixed or ()) - wanted)


def extract(table: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    learnt = stage(host_templates(stage(vectors(table))))
    kinds = [table.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="html"):
            texts = [text_in(*row) for row in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # The templates are a written table whose size Spark knows: small ones are broadcast, others meet over the host.
    rows = table.select("page_id", "url", text_of(table, "html").alias("html"), _hosted(table)).join(learnt, "host", "left")
    out = rows.select("page_id", "url", "html", "main", "fixed").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
