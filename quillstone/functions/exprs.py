"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import fixed


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def relevance(entity: Column, text: Column, base: float = 0.4) -> Column:
    hits = F.size(F.filter(F.split(F.lower(F.trim(entity)), r"\s+"), lambda t: (t != "") & F.contains(F.lower(text), t)))
    return F.round(F.least(F.lit(1.0), F.lit(base) + F.lit(0.2) * hits), 3)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#]*)", 1), r"^www\.", "")


def trusted(url: Column) -> Column:
    return F.exists(_array(fixed.TRUSTED_HOSTS), lambda d: F.endswith(domain(url), d))


def is_pdf(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"(?i)\.pdf($|\?)")


def boosted(score: Column, url: Column, by: float = 0.2) -> Column:
    return F.round(F.least(F.lit(1.0), score + F.when(trusted(url) | is_pdf(url), F.lit(by)).otherwise(F.lit(0.0))), 3)


def frontier_priority(rel: Column, score: Column, url: Column, depth: Column) -> Column:
    """Clamped to 0..1; the score of an unseen domain is 0.5."""
    raw = 0.6 * rel + 0.3 * F.coalesce(score, F.lit(0.5)) + F.when(is_pdf(url), 0.15).otherwise(0.0) + F.when(trusted(url), 0.1).otherwise(0.0) - 0.1 * depth
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def ratio_or(hits: Column, attempts: Column, default: float) -> Column:
    return F.when(attempts == 0, F.lit(default)).otherwise(F.round(hits / F.nullif(attempts, F.lit(0)), 3))


def on_topic(query: Column, anchors: Column) -> Column:
    q = F.lower(query)
    return F.exists(F.filter(anchors, lambda a: F.length(a) > 2), lambda a: F.contains(q, F.lower(a))) & ~F.exists(_array(fixed.OFF_TOPIC), lambda bad: F.contains(q, bad))


def plausible(entity: Column) -> Column:
    s = F.trim(entity)
    return (F.length(s) >= 3) & ~F.lower(s).isin(list(fixed.STOP_WORDS)) & ~F.replace(s, F.lit(" "), F.lit("")).rlike("^[0-9]+$")


def slug(text: Column, length: int = 48) -> Column:
    return F.substr(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(1), F.lit(length))


def safe_filename(url: Column, title: Column, source: Column) -> Column:
    name = F.regexp_replace(F.substr(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), F.lit(1), F.lit(60)), "^_+|_+$", "")
    return F.concat(name, F.lit("_"), F.substr(F.sha2(url, 256), F.lit(1), F.lit(8)), F.when(source == "gdelt", ".html").otherwise(".pdf"))


def licence(source: Column) -> Column:
    return F.coalesce(_lookup(fixed.LICENCES, source), F.lit("unknown"))


def chunk_id(filename: Column, index: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("_", filename, index.cast("string")), 256), F.lit(1), F.lit(16))


def canonical_id(label: Column, text: Column) -> Column:
    return F.substr(F.sha2(F.concat(label, F.lit("::"), F.lower(text)), 256), F.lit(1), F.lit(12))


def unresolved_id(text: Column) -> Column:
    return F.substr(F.sha2(F.trim(F.lower(text)), 256), F.lit(1), F.lit(12))


def quarter(date: Column) -> Column:
    return F.when(date.rlike(r"^[0-9]{4}.[0-9]{2}"), F.concat(F.substr(date, F.lit(1), F.lit(4)), F.lit("-Q"), F.floor((F.substr(date, F.lit(6), F.lit(2)).cast("int") - 1) / 3 + 1).cast("string"))).otherwise("unknown")


def location_key(location: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(location)), F.lit("")), F.lit("unknown"))


def year_key(date: Column) -> Column:
    return F.coalesce(F.nullif(F.substr(date, F.lit(1), F.lit(4)), F.lit("")), F.lit("unknown"))


def is_command(predicate: Column) -> Column:
    return F.exists(_array(fixed.COMMAND_STEMS), lambda s: F.contains(F.lower(predicate), s))


def xml_escape(text: Column) -> Column:
    for raw, made in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(made))
    return text


def valid_at(start: Column, end: Column, at: str | None) -> Column:
    """Whether an open-ended interval of partial ISO dates holds ``at``; text comparison."""
    if at is None:
        return F.lit(True)
    bound = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(at))
    return (bound(start) <= at) & (bound(end) >= at)


def citation_confidence(answer: Column, n: Column) -> Column:
    cited = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.contains(answer, F.concat(F.lit("[Source "), i.cast("string"), F.lit("]")))))
    return F.when(n > 0, F.round(cited / n, 3)).otherwise(0.0)


def silence_reason(intensity: Column, confidence: Column) -> Column:
    return F.when((intensity > 0.7) & (confidence < 0.3), "high-intensity event with little coverage").when(intensity > confidence + 0.3, "notable gap between intensity and coverage").otherwise("moderate gap")


def judge_band(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def first_contained(entities: list[str], title: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(_array(entities), lambda e: F.contains(F.lower(title), F.lower(e))), F.lit(1)), F.lit(entities[0]))


def inverted_abstract(index: Column, words: int = 40) -> Column:
    """Text of a map from word to positions: the first ``words`` words in order."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.slice(F.array_sort(placed), 1, words), lambda x: x["w"]), " ")


def short_date(date: Column) -> Column:
    """yyyymmdd and bare years in ISO form, else the first ten characters."""
    ymd = F.concat_ws("-", F.substr(date, F.lit(1), F.lit(4)), F.substr(date, F.lit(5), F.lit(2)), F.substr(date, F.lit(7), F.lit(2)))
    return F.when(date.rlike("^[0-9]{8}"), ymd).when(date.rlike("^[0-9]{4}$"), F.concat(date, F.lit("-01-01"))).otherwise(F.substr(date, F.lit(1), F.lit(10)))


def sampled_text(text: Column, total: int = 2000, slices: int = 5) -> Column:
    """Evenly spaced windows of a long text, joined by an ellipsis; short texts whole."""
    window = total // slices
    step = F.greatest(F.lit(1), F.floor((F.length(text) - window) / (slices - 1)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.substr(text, F.least(i * step, F.length(text) - window) + 1, F.lit(window)))
    return F.when(F.length(text) <= total, text).otherwise(F.array_join(parts, " … "))


def links(html: Column, base: Column) -> Column:
    """Absolute targets of the links of a page, without mail, script and fragment links."""
    found = F.filter(F.regexp_extract_all(html, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1)), lambda u: (u != "") & ~u.rlike("^(mailto:|javascript:|#)"))
    origin, folder = F.regexp_extract(base, "^([a-z]+://[^/?#]*)", 1), F.regexp_replace(base, "[^/]*$", "")
    return F.transform(found, lambda u: F.when(u.rlike("^[a-z]+://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), u)).when(F.startswith(u, F.lit("/")), F.concat(origin, u)).otherwise(F.concat(folder, u)))


def mean(value: Column, digits: int = 4) -> Column:
    """Average of decimals, ties up: the sum is exact, so it depends on no order of the rows."""
    return F.round(F.sum(value.cast("decimal(20,6)")).cast("double") / F.count(value) + 1e-9, digits)


def route(url: Column, content_type: Column) -> Column:
    """download for report files, page for what a browser shows, skip for the rest; an unknown content type counts as a page."""
    kind = F.lower(F.coalesce(content_type, F.lit("text/html")))
    return F.when(F.contains(kind, F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf")), "download").when(F.contains(kind, F.lit("text/html")), "page").otherwise("skip")


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles and tags, the usual entities replaced, white space single."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def passage(position: Column, source: Column, geography: Column, date: Column, text: Column, length: int = 600) -> Column:
    """A numbered passage with its source, as a search tool shows it."""
    meta = F.concat_ws(" | ", F.nullif(geography, F.lit("")), F.nullif(date, F.lit("")))
    head = F.concat(F.lit("[Passage "), position.cast("string"), F.lit("] Source: "), source, F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""), F.lit("\n"))
    return F.concat(head, F.substr(text, F.lit(1), F.lit(length)))


def example(asked: Column, answered: Column) -> Column:
    """One example of a few-shot prompt."""
    return F.concat(F.lit("Input: "), asked, F.lit("\nOutput: "), answered, F.lit("\n"))
