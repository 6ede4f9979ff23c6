"""Text functions: names, URLs, Markdown blocks, streams of events."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that canonical URLs lose.
TRACKING = ("gclid", "fbclid", "ref", "source")


# The parts of a summary, with older names, and the run log's lines.
SOURCE_KEYS = ("topic", "video_id", "url", "title", "channel_namespace", "published_at", "fetched_at", "info_density")
SECTIONS = {"Summary": ("Executive Summary",), "Key Points & Insights": ("Key Points",), "Numbers": (), "Chances": ("Opportunities",), "Risks": (), "Unknowns": ()}
LOG_PATTERNS = {
    "start": r"Starting mining\.\.\.",
    "end": r"Aggregation completed\.",
    "wait": r"Rate limiting: waiting ([0-9.]+)s",
    "report": r"LLM report call completed: .* duration_ms=([0-9.]+)",
    "per_video": r"LLM per-video call completed: .* duration_ms=([0-9.]+)",
    "aggregate": r"LLM aggregate call completed: .* duration_ms=([0-9.]+)",
    "channels": r"Starting to process (\d+) channels",
    "prepare": r"Preparing LLM request: \d+ transcripts, \d+ chars, ~([0-9]+) tokens",
}


def first_of(*cols: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cols])


def ticker(label: Column) -> Column:
    """``Name (TICK)`` gives ``TICK``, anything else the trimmed label."""
    found = F.regexp_extract(label, r"^(.+?)\s*\(([A-Z][A-Z0-9.\-]{0,9})\)\s*$", 2)
    return F.when(found != "", found).otherwise(F.trim(label))


def channel_of(path: Column, folder: str = "/1_transcripts") -> Column:
    """The channel named by a path: without the folder at its end, else the
    part after the folder, else ``unknown``."""
    text = F.trim(path)
    tail = F.regexp_extract(text, f"{folder}/+([^/]+)", 1)
    cut = F.regexp_replace(text, f"{folder}/*$", "")
    return F.coalesce(F.when(tail != "", tail), F.when(cut != "", cut), F.lit("unknown"))


def handle(name: Column) -> Column:
    """Without leading ``@``, slashes as underscores."""
    return F.translate(F.ltrim(F.trim(name), F.lit("@")), "/\\", "__")


def video_id(filename: Column) -> Column:
    """The eleven id characters before ``.txt``, at the start or after ``_``,
    else what follows the last ``_``."""
    whole, tail = F.regexp_extract(filename, r"(?:^|_)([A-Za-z0-9_\-]{11})\.txt$", 1), F.regexp_extract(filename, r"_([^_]+)\.txt$", 1)
    return F.coalesce(F.when(whole != "", whole), F.when(tail != "", tail))


def file_base(name: Column) -> Column:
    """Anything but Unicode word characters and ``-`` as single ``_``."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), "_+", "_"), F.lit("_"))


def slug(name: Column, most: int | None = None) -> Column:
    made = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return made if most is None else F.substring(made, 1, most)


def snippet(text: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def truncated(text: Column, most: int, marker: str = "") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(marker)))


def approx_tokens(text: Column, least: int = 0) -> Column:
    return F.greatest(F.lit(least), F.floor(F.length(text) / 4).cast("int"))


def _has_word(text: Column, word: str) -> Column:
    return F.regexp_like(text, F.lit(rf"(?i)(?<![0-9A-Za-z_])\Q{word}\E(?![0-9A-Za-z_])"))


def keyword_lines(text: Column, keywords: list[str]) -> Column:
    """Trimmed lines that hold a keyword as a whole word, in any case; grouped
    by keyword, so a line with two keywords comes twice."""
    lines = F.split(text, "\n")

    def holding(word: str) -> Column:
        return F.transform(F.filter(lines, lambda x: _has_word(x, word)), lambda x: F.trim(x))

    return F.flatten(F.array(*map(holding, keywords)))


def keywords_found(text: Column, keywords: list[str]) -> Column:
    hits = [F.when(_has_word(text, w), F.lit(w)) for w in keywords]
    return F.array_compact(F.array(*hits))


def canonical_url(url: Column) -> Column:
    """Scheme https where missing, host in lower case, path ``/`` where
    missing and without one trailing slash, no tracking parameters, no
    fragment."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    text = F.when(F.regexp_like(text, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*://")), text).otherwise(F.concat(F.lit("https://"), text))
    scheme, host = F.lower(F.regexp_extract(text, "^([^:]+)://", 1)), F.lower(F.regexp_extract(text, "^[^:]+://([^/?]*)", 1))
    path = F.regexp_extract(text, r"^[^:]+://[^/?]*([^?;]*)", 1)
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(F.regexp_extract(text, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_") & ~F.split(x, "=")[0].isin(*TRACKING))
    query = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_allowed(url: Column, hosts: list[str], prefixes: list[str], assets: tuple[str, ...] = ("/assets/", "/static/")) -> Column:
    """Exact host, no asset path, and any of the path prefixes (none: all)."""
    host, path = F.regexp_extract(url, "^[^:]+://([^/?]*)", 1), F.regexp_extract(url, "^[^:]+://[^/?]*([^?#]*)", 1)
    ok = host.isin(*hosts)
    for a in assets:
        ok = ok & ~path.startswith(a)
    within = [path.startswith(p) for p in prefixes]
    for extra in within[1:]:
        within[0] = within[0] | extra
    return ok & within[0] if within else ok


def repository(url: Column) -> Column:
    """``owner/name`` without host, slashes and ``.git``."""
    text = F.regexp_replace(F.trim(url), r"^(https?://[^/]+/|git@[^:]+:)", "")
    return F.regexp_replace(F.trim(text, F.lit("/")), r"\.git$", "")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)"), 1)


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def markdown_trim(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_of_keys(pairs: Column) -> Column:
    """Map from an array of key and value; the last of equal keys wins."""

    def kept(pairs: Column) -> Column:
        later = lambda i: F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1)))
        return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(later(i), lambda y: y["key"] == x["key"])))

    return _bound(pairs, kept)


def sections(text: Column) -> Column:
    """Map of level-2 headings to the text below; the last of equal names wins."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n## "), lambda x, i: i > 0)
    return _last_of_keys(F.transform(parts, lambda x: F.struct(F.trim(F.split(x, "\n", 2)[0]).alias("key"), F.trim(F.coalesce(F.get(F.split(x, "\n", 2), F.lit(1)), F.lit("")), F.lit(" \n")).alias("value"))))


def bullets(text: Column) -> Column:
    """Lines that start with ``- ``, without it."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: F.trim(F.regexp_replace(x, "^- ", "")))


def source_block(text: Column) -> Column:
    """Map of ``- key: value`` lines, split at the first colon."""
    pairs = F.filter(bullets(text), lambda x: x.contains(":"))
    return _last_of_keys(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))))


def as_bullets(text: Column) -> Column:
    """Bulleted text as it is, other text as one bullet, blank as ``- none``."""
    t = F.trim(text, F.lit(" \n\t"))
    return F.when(F.coalesce(t, F.lit("")) == "", "- none").when(F.regexp_like(t, F.lit("(?m)^- ")), t).otherwise(F.concat(F.lit("- "), t))


def wrapped_docs(text: Column) -> Column:
    """Bodies between document marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<<<DOC_START>>>(.*?)<<<DOC_END>>>"), 1), lambda x: F.trim(x, F.lit(" \n")))


def wrapped_records(text: Column, keys: dict[str, str]) -> Column:
    """Array of (each of ``keys``, body) of the documents between marks: values
    of their front matter, by default what ``keys`` says, and the text after it."""
    fields = lambda x: [frontmatter_value(x, k, d).alias(k) for k, d in keys.items()]
    return F.transform(wrapped_docs(text), lambda x: F.struct(*fields(x), without_frontmatter(x).alias("body")))


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---\n*", "")


def frontmatter_value(text: Column, key: str, default: str = "unknown") -> Column:
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    found = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(found != "", found).otherwise(default)


def missing_parts(found: Column, wanted: list[str], code: str = "missing_section") -> Column:
    """Reason codes, in fixed order, of wanted keys that a map lacks."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.map_contains_key(found, w), F.lit(False)), F.lit(f"{code}:{w}")) for w in wanted]))


def quality_bucket(grade: Column, reasons: Column) -> Column:
    cut = F.exists(reasons, lambda x: F.lower(x).contains("truncat") | F.lower(x).contains("cuts off"))
    return F.when(F.coalesce(cut, F.lit(False)), "truncated").otherwise(F.coalesce(F.nullif(F.lower(F.trim(grade)), F.lit("")), F.lit("unknown")))


def health(text: Column, metadata_ok: Column, status: Column) -> Column:
    return (
        F.when(text.isNull(), "missing")
        .when(F.trim(text) == "", "empty")
        .when(~metadata_ok, "metadata_invalid")
        .when(F.coalesce(status, F.lit("ok")) != "ok", F.concat(F.lit("metadata_status="), status))
        .otherwise("ok")
    )


def redacted(headers: Column, names: list[str]) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*[n.lower() for n in names]), "***").otherwise(v))


def markdown_links(text: Column) -> Column:
    """Link targets without anchors and line numbers; web links left out."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), 1)
    kept = F.filter(found, lambda x: ~F.regexp_like(x, F.lit("^(https?:|mailto:|#)")))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"(#.*|:\d+)$", ""))


def sse_events(body: Column) -> Column:
    """JSON payloads of ``data:`` lines up to ``[DONE]``; bad JSON is skipped."""
    before = F.substring_index(body, "data: [DONE]", 1)
    lines = F.filter(F.split(before, "\r?\n"), lambda x: x.startswith("data:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^data:", ""))), lambda x: F.get_json_object(x, "$").isNotNull())


def sse_text(body: Column) -> Column:
    parts = F.transform(sse_events(body), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit("")))
    return F.array_join(parts, "")


def sse_tool_calls(body: Column) -> Column:
    return F.size(F.filter(sse_events(body), lambda x: F.get_json_object(x, "$.choices[0].delta.tool_calls").isNotNull()))


def sse_field(body: Column, path: str) -> Column:
    """The last value of a JSON path among the events, as for usage."""
    found = F.array_compact(F.transform(sse_events(body), lambda x: F.get_json_object(x, path)))
    return F.try_element_at(found, F.lit(-1))


def sse_has_reasoning(body: Column) -> Column:
    return F.exists(sse_events(body), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.reasoning"), F.lit("")) != "")


def uuid5(name: Column, namespace: str) -> Column:
    """Name-based UUID (version 5) of a text under a namespace UUID."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def source_id(direct: Column, meta: Column, content: Column, filename: Column) -> Column:
    """The first that is there: the field, the metadata's field, the
    ``source_id`` line in the first 3,000 characters (where front matter
    stands), the id at the end of a file name."""
    line = F.regexp_extract(F.substring(content, 1, 3000), r'(?m)^source_id:[ \t]*"?([^"\n]+)"?[ \t]*$', 1)
    tail = F.regexp_extract(filename, r"__([A-Za-z0-9_-]{6,20})\.md$", 1)
    return first_of(direct, meta, line, F.when(tail != "", F.concat(F.lit("youtube:"), tail)))


def log_line(line: Column) -> Column:
    """``ts, kind, amount`` of a line of the run log; null for other lines.
    Kinds: start, end, wait (seconds), report, per_video and aggregate
    (milliseconds), channels, prepare (tokens)."""
    ts = F.regexp_extract(line, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d{3}", 1)
    kind, amount = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, pattern in reversed(LOG_PATTERNS.items()):
        found = F.regexp_like(line, F.lit(pattern))
        kind = F.when(found, name).otherwise(kind)
        if "(" in pattern:
            amount = F.when(found, F.try_to_number(F.regexp_extract(line, pattern, 1), F.lit("999999999999999D999999")).cast("double")).otherwise(amount)
        else:
            amount = F.when(found, F.lit(None).cast("double")).otherwise(amount)
    return F.when(ts != "", F.struct(F.to_timestamp(ts).alias("ts"), kind.alias("kind"), amount.alias("amount")))


def summary_markdown(source: dict[str, Column], found: Column) -> Column:
    """A summary in its fixed order: title, source block, then the sections
    (from a map of them, by their names or older names)."""
    density = F.lower(F.trim(F.coalesce(source.get("info_density", F.lit(None)), F.lit(""))))
    values = {k: F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown")) for k, v in source.items()}
    values["info_density"] = F.when(density.isin("low", "medium", "high"), density).otherwise("medium")
    head = [F.concat(F.lit("# "), values["title"]), F.lit(""), F.lit("## Source"), *[F.concat(F.lit(f"- {k}: "), values[k]) for k in SOURCE_KEYS if k in values], F.lit("")]

    def body(found: Column) -> Column:
        parts: list[Column] = []
        for name, older in SECTIONS.items():
            text = first_of(*[found[n] for n in (name, *older)])
            parts += [F.lit(f"## {name}"), F.coalesce(text, F.lit("none")) if name == "Summary" else as_bullets(text), F.lit("")]
        return F.array_join(F.array(*parts), "\n")

    return F.concat(F.regexp_replace(F.concat_ws("\n", *head, _bound(found, body)), r"\s+$", ""), F.lit("\n"))


def summary_fault(text: Column, video: Column, channel: Column) -> Column:
    """``ok``, or the first fault in the fixed order: sections, source keys,
    then values that differ from the transcript's."""

    def first(x: Column) -> Column:
        return _first_fault(x["source"], x["parts"], video, channel)

    return _bound(text, lambda t: _bound(F.struct(source_block(t).alias("source"), sections(t).alias("parts")), first))


def _first_fault(source: Column, parts: Column, video: Column, channel: Column) -> Column:
    checks = [F.when(~F.map_contains_key(parts, F.lit(s)), F.lit(f"missing_section:{s}")) for s in ("Source", *SECTIONS)]
    checks += [F.when(F.coalesce(source[k], F.lit("")) == "", F.lit(f"missing_source_key:{k}")) for k in SOURCE_KEYS]
    checks += [F.when(source["video_id"] != video, "video_id_mismatch"), F.when(source["channel_namespace"] != channel, "channel_namespace_mismatch")]
    return F.coalesce(*checks, F.lit("ok"))


def link_target(base: Column, link: Column) -> Column:
    """A link from a file in folder ``base``, with ``.`` and ``..`` resolved."""
    parts = F.split(F.when(link.startswith("/"), link).otherwise(F.concat_ws("/", base, link)), "/")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x.isin("", "."), done).otherwise(F.concat(done, F.array(x)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def sha_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def glob_regex(pattern: str) -> str:
    """Java regex of a shell pattern; ``*`` crosses slashes, ``[..]`` is one
    of a set and ``[!..]`` one of none of it."""
    made, at = "(?s)^", 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        end = pattern.find("]", at + 1 + (pattern[at : at + 1] == "!")) if c == "[" else -1
        if end > 0:
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", pattern[at:end])
            made, at = f"{made}[{'^' + inner[1:] if inner[0] == '!' else inner}]", end + 1
        else:
            made += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return made + "$"


def glob_match(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluding patterns win; no including pattern includes all."""
    inn, out = [F.regexp_like(path, F.lit(glob_regex(p))) for p in include], [F.regexp_like(path, F.lit(glob_regex(p))) for p in exclude]
    yes = F.greatest(*inn, F.lit(False)) if inn else F.lit(True)
    return yes & ~(F.greatest(*out, F.lit(False)) if out else F.lit(False))


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """``value`` within its bounds; null stays null."""
    held = value if low is None else F.greatest(value, F.lit(low))
    held = held if high is None else F.least(held, F.lit(high))
    return F.when(value.isNotNull(), held)
