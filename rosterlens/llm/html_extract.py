"""Main text of web pages: what the markup leaves, without what the suffix arrays of the host's pages find repeated.

A page is cut into blocks of text. What stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or comments by its tag, role, class or id is left out. If the page marks its article (``article``, ``main`` or
the role main), only the article's blocks can be text. Then repetition decides: the token streams of a host's pages are
concatenated, a suffix array finds runs of ``RUN`` tokens or more that occur on distinct pages, and a block that such
runs cover is boilerplate; unique runs stay. Pages that mark their article and pages that do not have arrays of their own.

Hosts may hold any number of pages, so their streams are dealt into pieces of bounded size. Every piece has a suffix
array; it yields one row per distinct run of ``RUN`` tokens with the smallest and largest page identity, and the pieces of a
host are merged on those rows, so a run counts as repeated no matter which pieces its pages are in. A page's identity
is the block that tells it best: the one with the most tokens for each page of the host that holds it. So copies of an
article are the same page, and their common text is not boilerplate, while a long notice under many short articles is.

Marked articles may quote each other and be copied, so a run there counts when it stands on more than half of the host's
distinct marked pages (``MANY`` or more); where such runs make up half of an article or more, the host repeats the
article itself, and it is kept whole. A run on more than half of the pages is on more than half of some piece's pages, so the
pieces only name their own (at most twice the words of a mean page each), which are then counted on all pages of the host.

Edge cases. A null or empty html gives an empty text. A page that is cut off anywhere is read as far as it goes. A null
url, or one without ``://``, is a page of the host ''. Rows that repeat a page are the same page and get the same text. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.url_filter import host_and_path
from rosterlens.llm.wordhash import mix, word_groups
from rosterlens.session import written_table

RUN = 6  # tokens
COVERED = 0.8  # share of a block's tokens that repeated runs must cover
PIECE_TOKENS = 200_000
MANY = 10  # marked pages of a host that tell its furniture

# Elements of the page's markup.
RAW = frozenset("script style noscript template textarea title iframe object svg head".split())
CHROME = frozenset("nav footer aside form button select dialog menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CHROME_NAMES = frozenset(
    "ad adbox ads adslot adunit advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookiebar cookies copyright disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar sidenav signup "
    "sitenotice skiplink social sponsor sponsored subscribe subscription toc toolbar topbar topnav widget widgets".split()
)
# Parts of class names that tell nothing about the content.
LAYOUT = frozenset(
    "area article bar block body bottom box btn button buttons card cell col column container content entry footer group head header heading holder icon icons "
    "inline inner item items js left line link links list main message messages mobile module nav outer overlay page panel post posts right row section "
    "site slot small stories story strip text thread title top unit user view wrap wrapper reader readers".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br input".split()
)
# Comments, declarations, tags with well-formed attributes, and tags with a stray quote (up to the next angle bracket).
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# An open element of the key is closed by the start of one of its values (end tags that pages leave out).
_CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}


@dataclass
class Page:
    blocks: list[tuple[str, bool]]  # text without markup, and whether a marked article holds it
    marked: bool  # the page marks its article

    def main(self) -> list[str]:
        return [text for text, inside in self.blocks if inside or not self.marked]


def _is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in CHROME or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role" and value.strip().lower() in CHROME_ROLES:
            return True
        if name.lower() in ("class", "id") and tag not in ("html", "body"):
            if inside:
                if any(_names_chrome(word) for word in value.split()):
                    return True
                continue
            names = {w for w in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", value).lower()) if w}
            if names & CHROME_NAMES or "header" in names:
                return True
    return False


def _names_chrome(word: str) -> bool:
    """Whether one class or id inside a marked article speaks of furniture throughout: all its parts do, or are plain words of layout.

    So text of the article is not lost to a part of a name (notice-board, form-of-address).
    """
    parts = [p for p in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", word).lower()) if p]
    known = [p in CHROME_NAMES for p in parts]
    return any(known) and all(k or p in LAYOUT or p.isdigit() for p, k in zip(parts, known))


def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or "role" in attributes and re.search(r"role\s*=\s*[\"']?(main|article)\b", attributes, re.I) is not None


def parse_page(html: str | None) -> Page:
    """The text blocks of a page that no markup rules out, in page order."""
    blocks: list[tuple[str, bool]] = []
    if not html:
        return Page(blocks, False)
    stack: list[tuple[str, bool, bool]] = []  # tag, chrome, main
    places: dict[str, list[int]] = {}  # where each tag stands open in the stack
    outer: list[int] = []  # where elements other than inline ones stand open
    last = html.rfind(">") + 1  # no tag ends behind it
    headless = False  # the page has no further end of the head
    chrome = mains = 0
    marked = False
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((text, mains > 0))

    def pop() -> None:
        nonlocal chrome, mains
        tag, was_chrome, was_main = stack.pop()
        places[tag].pop()
        if tag not in INLINE:
            outer.pop()
        chrome -= was_chrome
        mains -= was_main

    while True:
        match = _TOKEN.search(html, at, last) if at < last else None
        text = html[at : match.start() if match else len(html)]
        if match is None:
            open_comment = re.search(r"<!--|<!\[CDATA\[", text)
            text = text[: open_comment.start()] if open_comment else text
        if match is None and "<" in text and re.search(r"<(?:[a-zA-Z/!?][^<>]*)?$", text):
            text = text[: text.rindex("<")]  # a tag that the end of the page cuts off
        if text and not chrome:
            parts.append(references.unescape(text))
        if match is None:
            break
        at = match.end()
        if at == last and match[0].startswith(("<!--", "<![CDATA[")) and not match[0].endswith(("-->", "]]>")):
            break  # a comment that never ends
        closing, tag, attributes = match.group(1, 2, 3) if match[2] else match.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if not chrome and tag not in INLINE:
                flush()
            depth = places[tag][-1] if places.get(tag) else None
            # An inline end tag does not close blocks around it.
            if depth is not None and not (tag in INLINE and outer and outer[-1] >= depth):
                while len(stack) > depth:
                    pop()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                if tag == "head":
                    end = None if headless else re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
                    headless = end is None
                    at = end.start() if end and html[end.start() + 1] != "/" else end.end() if end else at
                    # Without an end of the head its elements are skipped one by one.
                else:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
            continue
        if tag == "br":
            if not chrome:
                parts.append(" ")
            continue
        if tag not in INLINE and not chrome:
            flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        while stack and tag in _CLOSES.get(stack[-1][0], ()):
            pop()
        if tag not in INLINE:  # a paragraph left open under inline elements
            depth = outer[-1] if outer else None
            if depth is not None and tag in _CLOSES.get(stack[depth][0], ()):
                while len(stack) > depth:
                    pop()
        is_chrome = _is_chrome(tag, attributes, mains > 0)
        is_main = not is_chrome and not chrome and _is_main(tag, attributes)
        marked |= is_main
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, is_chrome, is_main))
        chrome += is_chrome
        mains += is_main
    flush()
    return Page(blocks, marked)


def repeated_prefixes(stream: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a concatenated token stream, ordered by the first ``run`` tokens of each suffix.

    Returns the suffixes in order and, for each, the length of the group of neighbours that share its first ``run``
    tokens, as the group's first position in the order. Suffixes that run over the end of their page are left out.
    Ranks double in depth until they tell ``run`` tokens apart.
    """
    n = len(stream)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    suffixes = np.flatnonzero(whole)
    order = suffixes[np.argsort(rank[suffixes], kind="stable")]
    heads = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    return order, np.repeat(heads, np.diff(np.append(heads, len(order))))


def _tokens(blocks: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, counts, words in word_groups(pa.array(blocks, pa.large_string())):
        out += np.split(words, np.cumsum(counts)[:-1])
    return out


def _run_keys(tokens: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit key of the first ``run`` tokens of each suffix."""
    key = np.zeros(max(0, len(tokens) - run + 1), np.uint64)
    for k in range(run):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(key)])
    return key


_PARSED = "host string, page long, text string, words int, blocks array<string>, keys array<long>, sizes array<int>, tokens array<long>"
SALTS = 16  # parts of the pages that hold one block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page parsed once: text and words of its marked article, else its blocks, their tokens, and key and size of each block."""
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            page = parse_page(html)
            if page.marked or not page.blocks:
                text = "\n".join(page.main())
                rows.append((text, text.count(" ") + text.count("\n") + 1, None, None, None, None))
                continue
            blocks = page.main()
            tokens = _tokens(blocks)
            keys = mix(np.array([mix(t + np.arange(len(t), dtype=np.uint64)).sum(dtype=np.uint64) for t in tokens], np.uint64))
            rows.append((None, None, blocks, keys.view(np.int64), [len(t) for t in tokens], np.concatenate(tokens).view(np.int64)))
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        columns = [batch.column(c) for c in ("page_id", "url", "host", "page")]
        yield pa.RecordBatch.from_arrays([*columns, *found], names=["page_id", "url", "host", "page", "text", "words", "blocks", "keys", "sizes", "tokens"])


def _article_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per text and the tokens of all texts in order; 32 bits each, as they travel to the pieces."""
    groups = list(word_groups(texts))
    counts = np.concatenate([np.zeros(0, np.int64), *(g[1] for g in groups)])
    return counts, np.concatenate([np.zeros(0, np.uint64), *(g[2] for g in groups)]) >> np.uint64(32)


def _article_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each distinct marked page; copies inside a task go once."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        pages = list(zip(batch.column("host").to_pylist(), batch.column("page").to_pylist()))
        fresh = batch.take(pa.array([i for i, page in enumerate(pages) if not (page in seen or seen.add(page))], pa.int64()))
        counts, tokens = _article_tokens(fresh.column("text"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(tokens.astype(np.uint32).view(np.int32)))
        yield pa.RecordBatch.from_arrays([*(fresh.column(c) for c in ("host", "page", "deal", "deals")), lists], names=["host", "page", "deal", "deals", "tokens"])


def _common_runs(piece: pa.Table) -> pa.Table:
    """Runs on more than half of the distinct pages of a host's piece, from the suffix array of the piece."""
    piece = piece.take(pa.array(np.unique(piece["page"].to_numpy(), return_index=True)[1]))
    lists, pages, deals = piece["tokens"].combine_chunks(), piece.num_rows, piece["deals"][0].as_py()
    run = np.zeros(0, np.int64)
    if pages >= MANY or deals > 1:
        stream = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        page = np.repeat(np.arange(pages), lists.value_lengths().to_numpy())
        order, heads = repeated_prefixes(stream, page)
        if len(order):
            # Suffixes of a group stand in the order of their pages.
            first = np.concatenate([[True], (heads[1:] != heads[:-1]) | (page[order][1:] != page[order][:-1])])
            starts = np.unique(heads)
            common = starts[2 * np.add.reduceat(first.astype(np.int64), starts) > pages]
            run = _run_keys(stream, RUN)[order[common]].view(np.int64)
    return pa.table({"host": pa.array([piece["host"][0].as_py()] * len(run), pa.string()), "run": pa.array(run), "deals": pa.array([deals] * len(run), pa.int32())})


def _named_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, run) of the host's named runs on each marked page."""
    for batch in batches:
        counts, tokens = _article_tokens(batch.column("text"))
        ends, out = np.cumsum(counts), []
        for i in range(batch.num_rows):
            run = np.unique(_run_keys(tokens[ends[i] - counts[i] : ends[i]], RUN).view(np.int64))
            out.append(run[np.isin(run, batch.column("runs")[i].values.to_numpy())])
        rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(run) for run in out]))
        yield pa.RecordBatch.from_arrays([batch.column("host").take(rows), batch.column("page").take(rows), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], names=["host", "page", "run"])


def article_without(text: str, tokens: np.ndarray, runs: np.ndarray) -> str:
    """A marked article without the blocks that the host's common runs cover; whole where these make up half of it or more."""
    starts = np.flatnonzero(np.isin(_run_keys(tokens, RUN).view(np.int64), runs))
    covered = np.unique(starts[:, None] + np.arange(RUN))
    return text if 2 * len(covered) >= len(tokens) else "\n".join(kept_blocks(text.split("\n"), starts))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, tokens = _article_tokens(batch.column("text"))
        ends = np.cumsum(counts)
        texts = zip(batch.column("text").to_pylist(), np.split(tokens, ends[:-1]), batch.column("runs"))
        out = [article_without(text, own, runs.values.to_numpy()) for text, own, runs in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def common_runs(marked: DataFrame) -> DataFrame:
    """(host, runs): the runs that stand on more than half of the host's distinct marked pages, for hosts that have any."""
    # Hosts of more than a piece are at most as many as the pieces; theirs hold MANY pages or more.
    hosts = marked.select("host", "page", "words").distinct().groupBy("host").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))
    dealt = F.greatest(F.lit(1), F.least(F.ceil(F.col("words") / PIECE_TOKENS), F.floor(F.col("pages") / MANY)))
    large = written_table(hosts.where(F.col("words") > PIECE_TOKENS).select("host", "pages", dealt.cast("int").alias("deals")), "hosts")
    placed = marked.select("host", "page", "text").join(F.broadcast(large), "host", "left").where(f"pages IS NULL OR pages >= {MANY}")
    deal = placed.withColumns({"deals": F.coalesce("deals", F.lit(1)), "deal": F.pmod("page", F.coalesce("deals", F.lit(1))).cast("int")}).drop("pages")
    streams = deal.mapInArrow(_article_streams, "host string, page long, deal int, deals int, tokens array<int>")
    named = written_table(streams.groupBy("host", "deal").applyInArrow(_common_runs, "host string, run long, deals int"), "runs")
    open_runs = named.where("deals > 1").groupBy("host").agg(F.collect_set("run").alias("runs"))
    places = marked.select("host", "page", "text").join(open_runs, "host").mapInArrow(_named_runs, "host string, page long, run long")
    counted = places.distinct().groupBy("host", "run").agg(F.count("*").alias("n")).join(F.broadcast(large), "host").where("2 * n > pages")
    settled = named.where("deals = 1").select("host", "run").unionByName(counted.select("host", "run"))
    return settled.groupBy("host").agg(F.collect_set("run").alias("runs"))


def _piece_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per host, piece and distinct run, from the suffix array of the piece; rows arrive ordered by host and page."""

    def done(host: str, streams: list[np.ndarray], identities: list[int]) -> pa.RecordBatch:
        stream = np.concatenate(streams).view(np.uint64)
        sizes = [len(s) for s in streams]
        order, heads = repeated_prefixes(stream, np.repeat(np.arange(len(sizes)), sizes))
        key = np.zeros(0, np.uint64)
        low = high = np.zeros(0, np.int64)
        if len(order):
            starts = np.unique(heads)
            identity = np.repeat(np.array(identities, np.int64), sizes)[order]
            low, high = np.minimum.reduceat(identity, starts), np.maximum.reduceat(identity, starts)
            key = _run_keys(stream, RUN)[order[starts]]
        return pa.RecordBatch.from_arrays([pa.array([host] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(low), pa.array(high)], names=["host", "run", "low", "high"])

    current, streams, identities, size = None, [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            host = batch.column(0)[i].as_py()
            if streams and (host != current or size >= PIECE_TOKENS):
                yield done(current, streams, identities)
                streams, identities, size = [], [], 0
            current = host
            tokens = batch.column(2)[i].values.to_numpy()
            streams.append(tokens)
            identities.append(batch.column(1)[i].as_py())
            size += len(tokens)
    if streams:
        yield done(current, streams, identities)


def _page_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            key = _run_keys(batch.column(2)[i].values.to_numpy().view(np.uint64), RUN)
            n = len(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * n, pa.int64())), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), pa.array(key.view(np.int64)), pa.array(np.arange(n, dtype=np.int64))], names=["host", "page", "run", "at"])


def page_identities(streams: DataFrame) -> DataFrame:
    """(host, page, identity): the key of the page's block with the most tokens per page of the host that holds it."""
    own = streams.select("host", "page", F.explode(F.arrays_zip("keys", "sizes")).alias("b")).select("host", "page", F.col("b.keys").alias("key"), F.col("b.sizes").alias("size")).distinct()
    spread = own.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    weighed = own.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(spread, ["host", "key", "salt"], "left")
    # Ties by size and key, so that equal sets of blocks have one identity.
    weight = F.struct((F.col("size") / F.coalesce("n", F.lit(1))).alias("weight"), "size", "key")
    return weighed.groupBy("host", "page").agg(F.max(weight)["key"].alias("identity"))


def repeated_positions(streams: DataFrame) -> DataFrame:
    """(host, page, at): where a run starts that occurs on pages of different identity on the host."""
    pieces = streams.select("host", "identity", "tokens", "page").repartition("host", F.pmod("page", F.lit(64))).sortWithinPartitions("host", "page")
    runs = pieces.select("host", "identity", "tokens").mapInArrow(_piece_runs, "host string, run long, low long, high long")
    repeated = runs.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "run")
    places = streams.select("host", "page", "tokens").mapInArrow(_page_runs, "host string, page long, run long, at long")
    return places.join(repeated, ["host", "run"], "left_semi").select("host", "page", "at")


def kept_blocks(blocks: list[str], starts: list[int], covered: float = COVERED) -> list[str]:
    """Blocks without those that repeated runs (by their first tokens) cover."""
    tokens = _tokens(blocks)
    marks = np.zeros(sum(len(t) for t in tokens) + 1, np.int64)
    for s in starts:
        marks[s] += 1
        marks[min(s + RUN, len(marks) - 1)] -= 1
    flags, at, out = np.cumsum(marks)[:-1] > 0, 0, []
    for block, own in zip(blocks, tokens):
        if flags[at : at + len(own)].sum() < covered * max(1, len(own)):
            out.append(block)
        at += len(own)
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ["\n".join(kept_blocks(blocks, starts or [])) for blocks, starts in zip(batch.column("blocks").to_pylist(), batch.column("starts").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (the page's blocks of main text joined by line breaks) and n_chars of every row."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    keyed = rows.withColumns({"host": host_and_path(F.col("url"))[0], "page": F.xxhash64("html")})
    parsed = written_table(keyed.mapInArrow(_parsed, f"page_id {kind}, url string, {_PARSED}"), "parsed", compression="zstd")
    marked, undecided = parsed.where("text IS NOT NULL").withColumn("page", F.xxhash64("text")), parsed.where("text IS NULL")
    common = written_table(common_runs(marked.where("text <> ''")), "common")
    checked = marked.join(common, "host").select("page_id", "url", "text", "runs").mapInArrow(_checked, f"page_id {kind}, url string, text string")
    decided = marked.join(common, "host", "left_anti").select("page_id", "url", "text").unionByName(checked)
    # Pages of equal html on one host are one page; only unmarked pages take part.
    streams = written_table(undecided.select("host", "page", "keys", "sizes", "tokens").dropDuplicates(["host", "page"]), "streams")
    streams = written_table(streams.drop("keys", "sizes").join(page_identities(streams), ["host", "page"]), "streams")
    starts = written_table(repeated_positions(streams).groupBy("host", "page").agg(F.collect_set("at").alias("starts")), "starts")
    open_pages = undecided.select("page_id", "url", "host", "page", "blocks").join(starts, ["host", "page"], "left")
    texts = decided.unionByName(open_pages.mapInArrow(_decided, f"page_id {kind}, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
